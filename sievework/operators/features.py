"""Training features: token ids, masks and padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.columns import col

IGNORE = -100


def code_points(value: Column | str) -> Column:
    """A stand-in tokenizer: the code points of a text, natively."""
    return F.transform(F.split(col(value), ""), lambda sign: F.ascii(sign))


def tokens(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """Any tokenizer as a column function."""
    return udfs.arrow(lambda text: list(encode(text or "")), "array<int>")


def features(prompt: Column | str, target: Column | str, most: int, answer_only: bool = True) -> list[Column]:
    """Ids of prompt and target cut to ``most``, their mask, and labels, in which the
    prompt's are ignored if only the answer is to be learnt."""
    prompt, target = col(prompt), col(target)
    ids = F.slice(F.concat(prompt, target), 1, most)
    n_prompt = F.least(F.size(prompt), F.size(ids))
    rest = F.slice(ids, n_prompt + 1, F.greatest(F.size(ids) - n_prompt, F.lit(0)))
    labels = F.concat(F.array_repeat(F.lit(IGNORE), n_prompt), rest) if answer_only else ids
    return [ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), labels.alias("labels")]


def padded(rows: DataFrame, pad: int, length: int | None = None, batch: str | None = None) -> DataFrame:
    """Pads to ``length``, or to the longest row of each ``batch``."""
    if length is None:
        if batch is None:
            raise ValueError("either a length or a batch column is needed")
        longest = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("_length"))
        rows = rows.join(longest, batch)
    else:
        rows = rows.withColumn("_length", F.lit(length))
    missing = F.greatest(F.col("_length") - F.size("input_ids"), F.lit(0))
    for name, value in (("labels", IGNORE), ("attention_mask", 0), ("input_ids", pad)):
        rows = rows.withColumn(name, F.concat(name, F.array_repeat(F.lit(value), missing)))
    return rows.drop("_length")
