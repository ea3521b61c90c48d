"""Near-duplicate texts by SimHash fingerprints and by the similarity of shingle sets.

Texts are linked in two ways, and components are made of the links of both:

1. Rows with equal texts (by two 64-bit hashes) are one class.
2. Where ``reach`` is given, classes whose fingerprints (those of ``simhash``) are that many
   bits apart or less are linked, by the vantage-point trees of ``simhash.grouped``. No
   such pair is lost, and none has to pass another check.
3. Classes whose shingle sets have a Jaccard similarity of ``similarity`` or more are linked
   as well. At 0.8 they differ in about 15 % of the bits of a fingerprint (short texts in
   many more), so a reach of few bits does not find most of them, and no tree can part points
   at a reach that does.

The third step:

a. A class has ``BANDS`` keys, each made of ``ROWS`` minima of its shingle hashes; two
   classes of similarity 0.8 share at least one key with a probability of 0.99999. The classes
   of one key are a shard. Keys of the very same classes are one shard. Shards above
   ``CHUNK`` classes are cut into chunks and compared in two passes, so no task is unbounded.
   First each chunk meets itself and the first chunk, which takes work in proportion to the
   shard. What these links connect needs no comparison any more: in each shard the largest
   component found so far is set aside, and only the classes outside of it meet each other
   and all of it, in chunks again. A pair of the shard is either inside that component or
   met, so nothing is dropped. A shard of edited copies of one text is done after the first
   pass; one of texts without links still takes all its pairs.
b. A task gets whole shingle sets and gives a spanning forest of all its pairs whose exact
   Jaccard similarity reaches the threshold (``similar_links``). Pairs are verified before
   the forest is taken, so a false candidate hides no pair.

So the one loss are pairs of the third step that share no key: (1 - s**3)**16 of those of
similarity s, one in 100,000 at 0.8 and fewer above.

Null texts are empty texts; equal empty texts are copies. Texts without words have no
shingles: the third step links them with nothing, their fingerprint is zero. Texts of fewer
words than a shingle are one shingle. Texts are taken whole, however long. Further columns stay as they
are; names that begin with an underscore are this module's own. An empty table gives no
rows. Of each component the row with the least (doc_id, text hashes) stays, of repeated rows
one; a null doc_id comes before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, joined, sized, stored, texts
from .graph import components
from .simhash import LANES, fingerprint, grouped, shingle_hashes
from .simhash import WORDS as PRINT_WORDS

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 3
CHUNK = 2_048
#: Shingles of a shard above which it is cut into more chunks (long texts).
SHINGLES = 2_000_000


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The minima of the shingle hashes under several mixes, ``ROWS`` to a key."""
    least = np.empty(BANDS * ROWS, np.uint64)
    for k in range(len(least)):
        multiplier = LANES[k % 60] ^ np.uint64(k << 8)
        least[k] = (((hashes ^ (hashes >> np.uint64(31))) * (multiplier | np.uint64(1))) >> np.uint64(5)).min()
    keys = np.zeros(BANDS, np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ part) * LANES[61]
        keys ^= keys >> np.uint64(33)
    return keys ^ np.arange(BANDS, dtype=np.uint64)


TEXT = ["_text_1", "_text_2"]


def text_key() -> list[Column]:
    """Two 64-bit hashes that name a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("_text_1"), F.xxhash64(F.lit(1), text).alias("_text_2")]


def _sketches(n_words: int, prints: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            keys, sizes, points = [], [], []
            for text in texts(batch):
                hashes = np.unique(shingle_hashes(text, n_words))
                keys.append(band_keys(hashes).view(np.int64) if len(hashes) else [])
                sizes.append(len(hashes))
                points.append(fingerprint(shingle_hashes(text, PRINT_WORDS)) if prints else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("doc_id", "_text_1", "_text_2")),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(points, np.uint64).view(np.int64)),
                ],
                ["doc_id", "_text_1", "_text_2", "keys", "size", "point"],
            )

    return run


def _task_links(similarity: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, first = np.unique(rows["id"].to_numpy(), return_index=True)
        mixed = rows["first"].iloc[0] != rows["second"].iloc[0]
        side = (rows["own"].to_numpy() != rows["first"].iloc[0])[first] if mixed else None
        a, b = similar_links(list(rows["shingles"].to_numpy()[first]), similarity, side)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return run


def similar_links(
    sets: list[np.ndarray], similarity: float, side: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of a spanning forest of all pairs of the Jaccard similarity or more;
    where ``side`` is given, of the pairs of unlike sides.

    The sets (of distinct hashes, none empty) are searched from link to link: one that was
    reached is compared with all that were not, so no pair of the forest is missed."""
    sizes = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(flat.max() + 1, np.int64)
    own = np.split(flat, sizes.cumsum()[:-1])
    open_ = np.ones(len(sets), bool)
    parts = [np.arange(len(sets))] if side is None else [np.flatnonzero(side), np.flatnonzero(~side)]
    held = [_Held(at, own, sizes) for at in parts]
    made = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for root in range(len(sets)):
        waiting = [root] if open_[root] else []
        open_[root] = False
        while waiting:
            one = waiting.pop()
            against = held[0 if side is None else int(side[one])]  # the other side
            if not against.shrunk(open_):
                continue
            mark[own[one]] = 1
            common = np.add.reduceat(mark[against.flat], against.begin)
            mark[own[one]] = 0
            similar = common >= similarity * (sizes[one] + sizes[against.at] - common)
            reached = against.at[similar & open_[against.at]]
            open_[reached] = False
            made.append((np.full(len(reached), one), reached))
            waiting.extend(reached.tolist())
    return tuple(np.concatenate(x) for x in zip(*made))


class _Held:
    """Sets laid one after the other, laid anew when half of them have been reached."""

    def __init__(self, at: np.ndarray, own: list[np.ndarray], sizes: np.ndarray):
        self.own, self.sizes = own, sizes
        self._lay(at)

    def _lay(self, at: np.ndarray) -> None:
        self.at = at
        self.flat = np.concatenate([self.own[k] for k in at]) if len(at) else np.zeros(0, np.int64)
        self.begin = self.sizes[at].cumsum() - self.sizes[at]

    def shrunk(self, open_: np.ndarray) -> bool:
        """Whether any set is left to be reached."""
        if 2 * open_[self.at].sum() <= len(self.at):
            self._lay(self.at[open_[self.at]])
        return len(self.at) > 0


def _shingle_sets(n_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            sets = [np.unique(shingle_hashes(text, n_words)).view(np.int64) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"]
            )

    return run


def _rows(docs: DataFrame, n_words: int, prints: bool) -> DataFrame:
    """Every row's doc_id, text hashes, keys, number of shingles and (if asked for) fingerprint."""
    named = docs.select("doc_id", "text", *text_key())
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    sketched = named.mapInArrow(
        _sketches(n_words, prints),
        f"doc_id {doc_id}, _text_1 long, _text_2 long, keys array<long>, size long, point long",
    )
    return stored(sketched, "sketches")


def _name_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("")).alias("_of")


def similar_pairs(docs: DataFrame, classes: DataFrame, n_words: int, similarity: float) -> DataFrame:
    """``a, b``: ids of classes of the similarity or more, which connect what all such pairs connect."""
    keyed = classes.select("id", "size", F.explode("keys").alias("key"))
    of_id = [F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(f"ids_{seed}") for seed in (10, 11)]
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), *of_id).where("n > 1")
    # Keys with the same classes have the same pairs: one of them is taken.
    counts = counts.groupBy("n", "ids_10", "ids_11").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    chunks = F.least(F.col("n"), F.ceil(F.greatest(F.col("n") / CHUNK, F.col("shingles") / SHINGLES))).cast("int")
    shards = joined(keyed, counts.select("key", "n", chunks.alias("chunks")), ["key"], "shared-keys", "n")
    shards = stored(shards.select("id", "key", "size", "chunks"), "shards")
    members = shards.select("id").distinct()
    members = joined(classes, members.withColumn("_one", F.lit(1)), ["id"], "members", "_one")
    # One copy of each text: the key has its doc_id, so copies do not meet in one task.
    members = stored(members.select("id", *TEXT, _name_of(F.col("first.doc_id"))), "member-texts")
    of_text = docs.select("text", *text_key(), _name_of(F.col("doc_id")))
    wanted = of_text.join(sized(members, members.count()), [*TEXT, "_of"]).select("id", "text")
    sets = wanted.mapInArrow(_shingle_sets(n_words), "id long, shingles array<long>").dropDuplicates(["id"])
    sets = stored(sets, "shingle-sets")
    own = _piece(F.col("chunks"))
    others = F.when(own == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(0), own))
    links = _met(shards.select("id", "key", own.alias("own"), others.alias("others")), sets, similarity)
    wide = shards.where("chunks > 1")
    if wide.isEmpty():
        return links
    links = stored(links, "first-links")
    groups = stored(components(links), "first-groups")
    more = _met(_left_over(wide, groups), sets, similarity)
    return groups.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)


def _piece(pieces: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(9), "id"), pieces).cast("int")


def _met(dealt: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links of the tasks (``key``, two of its pieces), where a row of piece
    ``own`` is in the tasks of its piece with each of ``others``."""
    tasks = dealt.withColumn("_other", F.explode("others")).select(
        "id", "key", "own", F.least("own", "_other").alias("first"), F.greatest("own", "_other").alias("second")
    )
    links = (
        tasks.join(sets, "id")
        .groupBy("key", "first", "second")
        .applyInPandas(_task_links(similarity), "a long, b long")
    )
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _left_over(wide: DataFrame, groups: DataFrame) -> DataFrame:
    """The second pass over ``wide`` shards: classes outside of a shard's largest component
    have the first pieces and meet all pieces; those inside have the others and meet the first."""
    named = groups.withColumnRenamed("node", "id").withColumn("_one", F.lit(1))
    placed = joined(wide, named, ["id"], "placed-nodes", "_one", "left")
    placed = stored(placed.withColumn("component", F.coalesce("component", "id")), "placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    largest = F.max(F.struct("n", "shingles", "component")).alias("main")
    shards = parts.groupBy("key").agg(largest, F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))

    def pieces(n: Column, shingles: Column) -> Column:
        return F.least(n, F.ceil(F.greatest(n / CHUNK, shingles / SHINGLES))).cast("int")

    outside = pieces(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles"))
    shards = shards.where(F.col("n") > F.col("main.n")).select(
        "key",
        F.col("main.component").alias("main"),
        outside.alias("outside"),
        pieces(F.col("main.n"), F.col("main.shingles")).alias("inside"),
        "n",
    )
    rows = joined(placed, shards, ["key"], "open-shards", "n")
    within = F.col("component") == F.col("main")
    first = F.sequence(F.lit(0), F.col("outside") - 1)
    every = F.sequence(F.lit(0), F.col("outside") + F.col("inside") - 1)
    return rows.select(
        "id",
        "key",
        F.when(within, F.col("outside") + _piece(F.col("inside"))).otherwise(_piece(F.col("outside"))).alias("own"),
        F.when(within, first).otherwise(every).alias("others"),
    )


def fingerprint_pairs(classes: DataFrame, reach: int) -> DataFrame:
    """``a, b``: ids of classes, which connect what fingerprints ``reach`` bits apart or less connect."""
    named = grouped(classes.select(F.col("id").alias("doc_id"), "point"), reach)
    return named.where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))


def deduplicate(
    docs: DataFrame, n_words: int = WORDS, similarity: float = SIMILARITY, reach: int | None = None
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    classes = _rows(docs, n_words, reach is not None).groupBy(*TEXT).agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("first"),
        F.count("*").alias("copies"),
        F.any_value("keys").alias("keys"),
        F.any_value("size").alias("size"),
        F.any_value("point").alias("point"),
    )
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "text-classes")
    links = similar_pairs(docs, classes, n_words, similarity)
    if reach is not None:
        links = fingerprint_pairs(classes, reach).unionByName(links)
    links = stored(links, "links")
    groups = components(links).withColumnRenamed("node", "id").withColumn("_one", F.lit(1))
    own = joined(classes.select("id", *TEXT, "first", "copies"), groups, ["id"], "text-groups", "_one", "left")
    own = stored(own.withColumn("component", F.coalesce("component", "id")), "grouped-texts")
    best = own.groupBy("component").agg(
        F.min(F.struct("first", *TEXT)).alias("best"), F.count("*").alias("members")
    )
    marked = joined(own, best.where("members > 1"), ["component"], "best-texts", "members", "left")
    # A class stays if it is alone or the best of its component; of its rows the first stays.
    stays = F.coalesce(F.struct("first", *TEXT) == F.col("best"), F.lit(True))
    marked = stored(marked.select(*TEXT, "first", "copies", stays.alias("stays")).where("not stays or copies > 1"), "marked")
    gone = marked.where("not stays").select(*TEXT)
    several = marked.where("stays").select(*TEXT, F.col("first.doc_id").alias("_first"))
    n_gone, n_several = gone.count(), several.count()
    kept = docs.select("*", *text_key()).join(sized(gone, n_gone), TEXT, "left_anti")
    if not n_several:
        return kept.select(docs.columns)
    single = kept.join(sized(several, n_several), TEXT, "left_anti")
    repeated = kept.join(sized(several, n_several), TEXT).where(F.col("doc_id").eqNullSafe(F.col("_first")))
    repeated = repeated.dropDuplicates(TEXT)
    return single.select(docs.columns).unionByName(repeated.select(docs.columns))
