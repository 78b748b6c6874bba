"""Sharding by a K-d tree over document metadata.

Documents with equal texts are one group. Groups are points with the dimensions of their
metadata and their bytes as weight. The tree splits each node at a weighted median along the
dimension that is widest there (its range as a share of the whole range), until leaves
reach the target bytes. For a number of leaves that is no power of two, the cut divides the
weight as the leaves are divided. Medians are found by counting: the bytes in each of BINS equal
parts of a node's range, then again inside the part where the cut falls, until a part holds less
than TOLERANCE of a shard or a single value, where a hash of the text goes on. All nodes of a
level are counted in one pass over the table of groups; the bins' sums are added up on the executors, and the driver
gets the bin of each node's cut alone: a row a node, so fewer rows than shards.

Groups too heavy for an even cut (over HEAVY of a shard, so at most shards / HEAVY of them) are placed
first, the heaviest on the emptiest shard, and the tree deals the others out to the room
that is left; the driver reads them one by one and stores their places in chunks, so it holds the shards' loads only. A group heavier than a shard can't stay whole: its documents are parted by a hash
of doc_id into pieces, which are then groups of their own.
"""

from __future__ import annotations

from heapq import heapify, heapreplace
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilesmith.llm.common import BROADCAST_ROWS, dropped, scratch_path, small, written

BINS = 4096
TOLERANCE = 1e-3
HEAVY = 0.02
#: Rows of a shard numbered in one task.
SLOT_ROWS = 50_000
#: Levels after which the table of groups is stored again.
STORE_LEVELS = 4
#: Rows of a table of numbers beyond which it is no literal, and placed groups stored at once.
LITERAL_ROWS, CHUNK_ROWS = 1000, 100_000


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def _groups(docs: DataFrame, dims: list[str], id_col: str, text_col: str) -> DataFrame:
    """A stored row for each document: id, size, hashes of its text and the dimensions as doubles."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = dict(docs.dtypes)
    place = [_number(F.col(d)) if kinds[d] not in ("string", "binary") else (F.crc32(F.coalesce(F.col(d), F.lit("")).cast("binary")).cast("double")) for d in dims]
    return written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash"),
            *(p.alias(f"d{i}") for i, p in enumerate(place)), F.octet_length(text).cast("double").alias(f"d{len(dims)}"),
        ),
        "metadata",
    )


class _Node:
    """The leaves first .. first + n - 1 hang below it."""

    def __init__(self, first: int, n: int) -> None:
        self.first, self.n = first, n


#: A tie before or after all others.
NONE_LEFT, ALL_LEFT = -1e300, 1e300


def _kinds(rows: list[tuple], names: str) -> str:
    return ", ".join(f"{c} {'double' if isinstance(x, float) else 'long'}" for c, x in zip(names.split(", "), rows[0]))


def _values(spark, rows: list[tuple], names: str) -> DataFrame:
    """A small table of numbers; its rows are bounded by the number of shards."""
    if len(rows) > LITERAL_ROWS:
        made = spark.createDataFrame(rows, _kinds(rows, names))
        return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made
    told = ", ".join("(" + ", ".join(f"{x!r}D" if isinstance(x, float) else f"{x}L" if abs(x) > 1 << 30 else str(x) for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {told} AS t({names})"))


def _at(k: int, tie: str = "by_tie") -> Column:
    """The number that a node's rows are counted by."""
    return F.when(F.col(tie) == 1, F.col("tie")).otherwise(F.element_at(F.array(*(f"d{i}" for i in range(k))), F.col("dim").cast("int") + 1))


def _cuts(groups: DataFrame, nodes: dict[int, _Node], room: list[float], spans: list[float], k: int, tolerance: float) -> list[tuple]:
    """(node, dimension, value, tie): rows with (value, tie) below a cut go left."""
    spark, dims = groups.sparkSession, [f"d{i}" for i in range(k)]
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    todo, cuts = {}, []
    for r in groups.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect():
        x = nodes[r.node]
        if x.n == 1:
            continue
        own = room[x.first : x.first + x.n]
        share = sum(own[: x.n // 2]) / (sum(own) or 1)
        wide = max(range(k), key=lambda j: ((r[f"max_d{j}"] - r[f"min_d{j}"]) / spans[j] if spans[j] else 0, -j))
        # the cut lies in [lo, hi] of the dimension, or of the tie at one value of it; want: bytes of that range that go left
        todo[r.node] = {"dim": wide, "by_tie": 0, "value": 0.0, "lo": r[f"min_d{wide}"], "hi": r[f"max_d{wide}"], "want": share * r.w}
    so_far = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while todo:
        asked = _values(spark, [(i, t["dim"], t["by_tie"], float(t["value"]), float(t["lo"]), float(t["hi"]), float(t["want"])) for i, t in todo.items()], "id, dim, by_tie, value, lo, hi, want")
        at = groups.join(asked, groups.node == F.col("id")).withColumn("x", _at(k))
        at = at.where(F.col("x").between(F.col("lo"), F.col("hi")) & ((F.col("by_tie") == 0) | (F.element_at(F.array(*dims), F.col("dim").cast("int") + 1) == F.col("value"))))
        width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
        bin_of = F.least(F.floor((F.col("x") - F.col("lo")) * BINS / width), F.lit(BINS - 1)).cast("int").alias("bin")
        sums = at.groupBy("node", bin_of).agg(F.sum("weight").alias("w"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.first("want").alias("want"))
        sums = sums.withColumn("before", F.coalesce(F.sum("w").over(so_far), F.lit(0)))
        # the first bin that reaches what should go left; where rounding leaves none, the last
        reached = F.col("before") + F.col("w") >= F.col("want")
        told = F.struct("w", "lo", "hi", "before")
        cut = sums.groupBy("node").agg(F.coalesce(F.min_by(told, F.when(reached, F.col("bin"))), F.max_by(told, "bin")).alias("r"))
        for i, r in cut.collect():  # a row a node
            t = todo.pop(i)
            before = r.before
            rest = t["want"] - before  # bytes of bin r that should go left
            if r.w <= tolerance or (t["by_tie"] and r.lo == r.hi):
                up = rest > r.w / 2  # the bin goes whole to the nearer side
                edge = r.hi if up else r.lo
                cuts.append((i, t["dim"], float(t["value"]), edge + 0.5 * up) if t["by_tie"] else (i, t["dim"], float(edge), ALL_LEFT if up else NONE_LEFT))
            elif r.lo == r.hi:  # many rows of one value
                todo[i] = t | {"by_tie": 1, "value": r.lo, "lo": 0.0, "hi": float(1 << 53), "want": rest}
            else:
                todo[i] = t | {"lo": r.lo, "hi": r.hi, "want": rest}
    return cuts


def _placed(groups: DataFrame, n: int, goal: float, same: list[str]) -> tuple[DataFrame | None, list[float]]:
    """Groups too heavy for an even cut, with their shard (columns _size, ..., shard), and the room that is left in each shard."""
    spark, names = groups.sparkSession, ", ".join([*(f"_{c}" for c in same), "shard"])
    emptiest, chunk, path = [(-goal, s) for s in range(n)], [], None
    heapify(emptiest)

    def store() -> str:
        where = path or scratch_path(spark, "placed")
        spark.createDataFrame(chunk, _kinds(chunk, names)).coalesce(1).write.mode("append").parquet(where)
        chunk.clear()
        return where

    for g in groups.where(F.col("weight") > goal * HEAVY).orderBy(F.desc("weight"), *same).toLocalIterator():  # at most n / HEAVY
        room, best = emptiest[0]
        heapreplace(emptiest, (room + g["weight"], best))
        chunk.append((*(g[c] for c in same), best))
        if len(chunk) == CHUNK_ROWS:
            path = store()
    if path and chunk:
        store()
    side = small(spark.read.parquet(path)) if path else _values(spark, chunk, names) if chunk else None
    return side, [max(0.0, -room) for room, _ in sorted(emptiest, key=lambda x: x[1])]


def kd_shards(docs: DataFrame, target_bytes: int | None = None, shards: int | None = None, dims: tuple[str, ...] = ("doc_id", "source", "lang"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of docs.

    Shards of about ``target_bytes``, or the given number of them. The dimensions are the given
    columns (text columns by their hash) and the text's bytes. size: bytes of the text plus 1; a
    null text counts as empty, a null dimension as 0. Equal texts share a shard unless together they
    are larger than one. slot: 0, 1, ... inside a shard. Repeated rows are rows of their own; an
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    meta = _groups(docs, list(dims), id_col, text_col)
    k, same = len(dims) + 1, ["size", "crc", "hash"]
    total = meta.agg(F.sum("size")).first()[0] or 0
    n = shards or max(1, ceil(total / target_bytes))
    goal = max(total / n, 1.0)

    def summed(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy(*same).agg(F.sum("size").alias("weight"), *(F.min(f"d{i}").alias(f"d{i}") for i in range(k))), "groups")

    def told(rows: DataFrame, side: DataFrame) -> DataFrame:
        return rows.join(side, [F.col(c) == F.col(f"_{c}") for c in same], "left").drop(*(f"_{c}" for c in same))

    groups = summed(meta)
    giants = groups.where(F.col("weight") > goal).collect() if n > 1 else []  # fewer than n
    if giants:
        dropped(groups)
        pieces = [(*(g[c] for c in same), ceil(g["weight"] / (goal * HEAVY / 4))) for g in giants]
        meta = told(meta, _values(spark, pieces, ", ".join([*(f"_{c}" for c in same), "pieces"])))
        meta = meta.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")).drop("pieces")
        same = [*same, "piece"]
        groups = summed(meta)
    placed, room = _placed(groups, n, goal, same)
    groups = told(groups, placed) if placed is not None else groups.withColumn("shard", F.lit(None).cast("int"))
    known = groups.where("shard is not null").select(*same, "shard")
    tree = groups.where("shard is null").drop("shard").withColumn("tie", F.shiftrightunsigned(F.xxhash64(F.lit(7), *same), 11).cast("double"))
    tree = stored = written(tree.withColumn("node", F.lit(1).cast("long")), "tree")
    ends = tree.agg(*(f(f"d{i}") for i in range(k) for f in (F.min, F.max))).first()
    spans = [(ends[2 * i + 1] or 0) - (ends[2 * i] or 0) for i in range(k)]
    nodes, level = {1: _Node(0, n)}, 0
    while any(x.n > 1 for x in nodes.values()):
        cuts = _cuts(tree, nodes, room, spans, k, goal * TOLERANCE)
        if not cuts:  # no rows are left to part
            break
        side = _values(spark, cuts, "id, dim, value, at_tie")
        x = F.element_at(F.array(*(f"d{i}" for i in range(k))), F.col("dim").cast("int") + 1)
        right = F.when((x < F.col("value")) | ((x == F.col("value")) & (F.col("tie") < F.col("at_tie"))), 0).otherwise(1)
        child = F.when(F.col("id").isNull(), F.col("node")).otherwise(2 * F.col("node") + right)
        tree = tree.join(side, tree.node == F.col("id"), "left").withColumn("node", child.cast("long")).drop("id", "dim", "value", "at_tie")
        below = {}
        for i, x in nodes.items():
            if x.n == 1:
                below[i] = x
            else:
                below |= {2 * i: _Node(x.first, x.n // 2), 2 * i + 1: _Node(x.first + x.n // 2, x.n - x.n // 2)}
        nodes, level = below, level + 1
        if level % STORE_LEVELS == 0:
            tree, before = written(tree, "tree"), stored
            dropped(before)
            stored = tree
    leaves = _values(spark, [(i, x.first) for i, x in nodes.items()], "id, shard")
    known = known.unionByName(tree.join(leaves, tree.node == F.col("id")).select(*same, "shard"))
    known = known.select(*(F.col(c).alias(f"_{c}") for c in same), "shard")
    rows = meta.join(known, [F.col(c) == F.col(f"_{c}") for c in same])
    return _slotted(rows.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard")))


def _slotted(rows: DataFrame) -> DataFrame:
    """rows with a gapless number inside their shard, made in parts of about SLOT_ROWS."""
    rows = written(rows, "shards")
    parts = max(1, ceil((rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) / SLOT_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").count().select(F.col("shard").alias("_s"), F.col("part").alias("_p"), F.col("count").alias("n"))
    # rows in the parts of a shard before each part: rows / SLOT_ROWS counts in all, summed in order
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_s", "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))
    w = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("i", F.row_number().over(w))
    joined = numbered.join(starts, (F.col("shard") == F.col("_s")) & (F.col("part") == F.col("_p")))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("i") - 1).cast("long").alias("slot"))
