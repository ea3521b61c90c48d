"""Sharding by balanced label propagation, with DataFrame operations only.

Documents that are linked (here: equal texts) should share a shard, and all shards should
have nearly equal bytes. A group of linked documents is a vertex through which its members
see each other, so a group of n costs n rows and not n * n.

1. *Start*: linked documents get shards by size classes and hashes, evenly.
2. *Propagation*: in each round every group's members are counted by shard (added up
   before the shuffle) and joined back to the members. A document moves to the shard that
   holds most of its group and has room, if more of the group is there than where it is.
   Requests are granted in the order of group hashes while the target's quota of bytes
   lasts; a group larger than a shard's quota goes on filling the next shard. Rounds end
   when nothing moves, or after ``ROUNDS`` of them: a later round could only unite more, the
   placement is whole and balanced after any.
3. *Levelling*: documents without links have no edges to cut. They fill all shards up to
   equal bytes: cells of (size class, hash), largest first, go to the emptiest shard. If
   linked documents alone overfill a shard, its surplus joins them group by group.

What reaches the driver has a fixed bound: sums by shard, and one sum for each cell. Quotas
are kept by prefix sums over cells; only the one cell that crosses a quota is ordered row
by row. The rows of a group never meet in one task: sums by group are added up before they
are shuffled, and they come back to the rows as ``common.joined`` sends them.

Law: ``bytes``. A null text has no bytes, checksum 0 and no links; empty texts are equal
texts. Texts are taken whole, however long. Repeated rows are rows of their own; further
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gapless, joined, literal_rows, spread, stored

SHARDS = 24
ROUNDS = 16
#: Cells of a quota's order: slices by group, and within each by row.
GROUP_CELLS, ROW_CELLS = 64, 16
#: Hash cells of each size class (powers of two) for levelling.
LEVEL_CELLS = 256


def _emptiest(loads: list[float], cells: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Gives each (class, cell, bytes), largest first, to the shard with the least bytes."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    given = {}
    for kind, cell, size in sorted(cells, key=lambda x: (-x[2], x[0], x[1])):
        load, shard = heapq.heappop(heap)
        given[kind, cell] = shard
        heapq.heappush(heap, (load + size, shard))
    return given


def _kind(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def _levelled(docs: DataFrame, key: Column, loads: list[float], name: str, cells: int = LEVEL_CELLS) -> DataFrame:
    """``docs`` with column ``name``: shards that fill ``loads`` up to equal bytes."""
    docs = docs.withColumn("_kind", _kind(F.col("size"))).withColumn("_cell", spread(key, cells))
    sums = docs.groupBy("_kind", "_cell").agg(F.sum("size").alias("size")).collect()
    given = _emptiest(loads, [(row["_kind"], row["_cell"], row["size"]) for row in sums])
    rows = [(kind, cell, shard) for (kind, cell), shard in given.items()]
    named = literal_rows(docs.sparkSession, rows, f"_kind int, _cell int, {name} int")
    return docs.join(F.broadcast(named), ["_kind", "_cell"]).drop("_kind", "_cell")


def _loads(docs: DataFrame, shards: int) -> list[float]:
    loads = [0.0] * shards
    for row in docs.groupBy("shard").agg(F.sum("size").alias("size")).collect():
        loads[row["shard"]] = float(row["size"])
    return loads


def within_quota(asked: DataFrame, quota: DataFrame, target: str) -> DataFrame:
    """``asked`` with column ``granted``: whether the row fits into its target's ``room``
    when rows are taken in the order of their cells."""
    cells = ["_group_cell", "_row_cell"]
    asked = asked.withColumn("_group_cell", spread(F.col("group"), GROUP_CELLS)).withColumn(
        "_row_cell", spread(F.col("uid"), ROW_CELLS)
    )
    sums = asked.groupBy(target, *cells).agg(F.sum("size").alias("_own"))
    before = Window.partitionBy(target).orderBy(*cells).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    sums = sums.join(F.broadcast(quota), target).select(
        target, *cells, (F.col("room") - F.col("_before")).alias("_left"), "_own"
    )
    # At most shards x cells rows.
    marked = asked.join(F.broadcast(sums), [target, *cells])
    whole = marked.where("_own <= _left").withColumn("granted", F.lit(True))
    none = marked.where("_left <= 0").withColumn("granted", F.lit(False))
    inside = Window.partitionBy(target, *cells).orderBy("group", "uid").rowsBetween(Window.unboundedPreceding, 0)
    part = marked.where("_own > _left AND _left > 0").withColumn("_sum", F.sum("size").over(inside))
    part = part.withColumn("granted", F.col("_sum") <= F.col("_left")).drop("_sum")
    return whole.unionByName(none).unionByName(part).drop("_left", "_own", *cells)


def propagate(linked: DataFrame, quota: float, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Moves rows of ``linked`` (uid, group, size, shard, ...) towards their groups."""
    spark = linked.sparkSession
    for _ in range(rounds):
        loads = _loads(linked, shards)
        room = [(shard, int(quota - load)) for shard, load in enumerate(loads) if quota - load >= 1]
        if not room:
            break
        rooms = literal_rows(spark, room, "wanted int, room long")
        votes = linked.groupBy("group", "shard").agg(F.count("*").alias("n"), F.min("size").alias("least"))
        # Ties between shards are broken by a hash, so that no shard is asked for more than others.
        tie = F.xxhash64("group", "shard")
        # A shard is open to a group if it can take one more member.
        votes = votes.join(F.broadcast(rooms.withColumnRenamed("wanted", "shard")), "shard", "left")
        votes = votes.withColumn("open", F.coalesce(F.col("least") <= F.col("room"), F.lit(False)))
        open_ = votes.where("open")
        best = open_.groupBy("group").agg(F.max(F.struct("n", tie.alias("tie"), F.col("shard").alias("to"))).alias("best"))
        best = best.select("group", F.col("best.to").alias("wanted"), F.col("best.n").alias("most"), F.col("best.tie").alias("tie"))
        # Of two equal parts of a group the one with the lower hash moves, or the one whose
        # shard is full, as the other cannot come there.
        equal = (F.col("most") == F.col("n")) & (~F.col("open") | (F.col("tie") > F.xxhash64("group", "shard")))
        here = votes.join(best, "group").where(
            (F.col("shard") != F.col("wanted")) & ((F.col("most") > F.col("n")) | equal)
        )
        # Only the rows that ask to move are written for the quota; most stay where they are.
        wishes = stored(here.select("group", "shard", "wanted", "n"), "wishes")
        asked = stored(joined(linked, wishes, ["group", "shard"], None, "n"), "asked")
        granted = within_quota(asked, rooms, "wanted")
        moved = granted.withColumn("shard", F.when(F.col("granted"), F.col("wanted")).otherwise(F.col("shard")))
        others = joined(linked, wishes, ["group", "shard"], None, "n", "left_anti")
        after = stored(moved.drop("wanted").unionByName(others.withColumn("granted", F.lit(False))), "labels")
        n = after.where("granted").count()
        linked = after.drop("granted")
        if not n:
            break
    return linked


def _surplus(linked: DataFrame, most: float, shards: int) -> DataFrame:
    """``linked`` with column ``stays``: false for what a shard holds beyond ``most``."""
    rooms = literal_rows(linked.sparkSession, [(shard, int(most)) for shard in range(shards)], "shard int, room long")
    return within_quota(linked, rooms, "shard").withColumnRenamed("granted", "stays")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.xxhash64(F.lit("null"), F.monotonically_increasing_id()))
        .otherwise(F.xxhash64("text", F.octet_length("text")))
        .alias("group"),
        F.monotonically_increasing_id().alias("uid"),
    )
    rows = stored(rows, "rows")
    groups = rows.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    several = groups.withColumn("several", F.lit(True))
    rows = stored(joined(rows, several, ["group"], "groups", "members", "left"), "grouped")
    linked, free = rows.where("several").drop("several"), rows.where("several is null").drop("several")

    quota = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    start = stored(_levelled(linked, F.struct("uid"), [0.0] * shards, "shard"), "start")
    linked = propagate(start, quota, shards)
    loads = _loads(linked, shards)
    if max(loads) > quota * 1.002:
        parted = stored(_surplus(linked, quota, shards), "surplus")
        linked = parted.where("stays").drop("stays")
        free = free.unionByName(parted.where("not stays").drop("stays", "shard"))
        loads = _loads(linked, shards)
    placed = linked.unionByName(_levelled(free, F.col("group"), loads, "shard"))
    slotted = gapless(placed, "shard", ["uid"], "slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
