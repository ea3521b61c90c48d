"""From raw documents to packed training sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again for the next. All stages but
the last return the columns of ``documents``.

Null and empty texts pass through all stages: they are neither toxic nor of low quality, are
copies of each other, and what is left of them is packed as the end id alone. Texts are
taken whole, however long. Repeated rows share their fate until near-dedup, which keeps one.
Further columns stay until the last stage, whatever their names, but for names that begin
with an underscore. Empty tables give no rows; without labels only near copies go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import packing, resampling, simhash, simhash_text, toxicity
from sievework.llm.common import stored, table, texts_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity reaches the limit go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling does not draw go."""
    return resampling.kept_rows(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts stays. Linked are SimHash fingerprints 3 bits apart
    or less, by vantage-point trees, and 5-word shingle sets of a similarity of 0.8."""
    return simhash_text.deduplicate(docs, reach=simhash.RADIUS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: Fitted models and closures over similarity have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts_table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
