"""Sharding by a k-d tree over document metadata.

Points are groups of equal texts (so copies stay together), weighted by their bytes; a group heavier than a shard is
first parted into equal sub-points by a hash of its rows.  A node of k shards is split at the weighted median (in
proportion k/2 : k/2) of its widest dimension among source, language and size, until a node is one shard, i.e. holds
the target bytes.  All nodes of a depth are split together.  A median is found by narrowing an interval of ordered
keys: each pass sums bytes in 1024 equal parts per node, map-side first, and only those sums reach the driver (at most
1024 x shards numbers, whatever the corpus), until the part left is one point.

The order along a dimension is (value, text hash, sub-point), one 62-bit key, so equal values can be parted anywhere
between two points.  The value of source and language is the rank of the whole string among the distinct ones.

Defined results: a null text counts 16 bytes and a null crc; null source or language sorts first; repeated rows are
placed one by one; an empty table gives no rows; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

OVERHEAD = 16
PARTS = 1024
DIMENSIONS = ("source", "lang", "bytes")
VALUE_BITS, TIE_BITS = 26, 36
SUB_POINTS = 128
#: Distinct strings of a dimension up to which their ranks are broadcast.
FEW_KINDS = 10_000


def metadata(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, text_id (hash of the text), numeric dimensions and a row number, `row` if it is given."""
    bits = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")).cast("long") + OVERHEAD
    crc = F.when(F.col("text").isNotNull(), F.crc32(bits))
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(
        "doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(bits, F.col("text").isNull()).alias("text_id"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), row.alias("row"),
    )


def ranked(groups: DataFrame, col: str) -> DataFrame:
    """groups with the strings of `col` replaced by their ranks (long) among the distinct ones, null first as 0."""
    spark = groups.sparkSession
    kinds = groups.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)
    kinds = common.scratch(kinds.select(col, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    parts = kinds.groupBy("part").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row a partition
    before, rows = 1, []
    for r in parts:
        rows.append((r["part"], r["least"] - before))
        before += r["n"]
    shift = F.broadcast(spark.createDataFrame(rows, "part int, shift long"))
    ranks = kinds.join(shift, "part").select(F.col(col).alias("kind"), (F.col("at") - F.col("shift")).alias("rank"))
    ranks = F.broadcast(ranks) if before <= FEW_KINDS else ranks.hint("merge")
    out = groups.join(ranks, F.col(col) == F.col("kind"), "left")
    return out.select(*(F.coalesce("rank", F.lit(0).cast("long")).alias(c) if c == col else c for c in groups.columns))


def _order_key() -> Column:
    """62-bit order key of a point inside its node: the value's place in the node's span, then the point's hash."""
    value = F.get(F.array(*DIMENSIONS), F.col("dim"))
    place = ((value - F.col("lo")).cast("double") / F.greatest(F.col("span"), F.lit(1)) * ((1 << VALUE_BITS) - 1)).cast("long")
    return F.shiftleft(F.greatest(place, F.lit(0)), TIE_BITS).bitwiseOR(F.shiftrightunsigned("point", 64 - TIE_BITS))


def _medians(at: DataFrame, spans: dict[int, tuple[int, int, int]], want: dict[int, float]) -> dict[int, int]:
    """Node -> key at which the weight below comes nearest to want.  spans: node -> (dimension, low value, span)."""
    spark = at.sparkSession
    low, high, base = dict.fromkeys(spans, 0), dict.fromkeys(spans, 1 << (VALUE_BITS + TIE_BITS)), dict.fromkeys(spans, 0.0)
    open_ = set(spans)
    while open_:
        step = {n: -(-(high[n] - low[n]) // PARTS) for n in open_}
        rows = [(n, *spans[n], low[n], high[n], step[n]) for n in open_]  # a row per node: at most the number of shards
        limits = spark.createDataFrame(rows, "node int, dim int, lo long, span long, low long, high long, step long")
        keyed = at.join(F.broadcast(limits), "node").withColumn("key", _order_key()).where("key >= low and key < high")
        sums = keyed.groupBy("node", F.expr("(key - low) div step").alias("part")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[int, list] = {n: [] for n in open_}
        for r in sums:
            by[r["node"]].append((r["part"], r["w"], r["n"]))
        for n in list(open_):
            done = base[n]
            for p, w, count in sorted(by[n]):
                if done + w >= want[n]:
                    start, end = low[n] + p * step[n], min(high[n], low[n] + (p + 1) * step[n])
                    if count == 1 or step[n] == 1:  # one point left: it goes to the nearer side
                        low[n] = high[n] = end if want[n] - done >= done + w - want[n] else start
                    else:
                        low[n], high[n], base[n] = start, end, done
                    break
                done += w
            else:
                low[n] = high[n]
            if high[n] <= low[n]:
                open_.remove(n)
    return high


def tree(points: DataFrame, shards: int) -> DataFrame:
    """points (point, weight, source, lang, bytes, ...) -> the same with shard (0 .. shards - 1)."""
    spark = points.sparkSession
    goal = {1: shards}  # nodes are numbered as in a heap
    at = points.withColumn("node", F.lit(1))
    whole: dict[str, int] = {}
    while split := [n for n, k in goal.items() if k > 1]:
        found = at.where(F.col("node").isin(split)).groupBy("node").agg(F.sum("weight").alias("w"), *(f(d).alias(f"{g}_{d}") for d in DIMENSIONS for f, g in ((F.min, "lo"), (F.max, "hi")))).collect()
        whole = whole or {d: max(1, r[f"hi_{d}"] - r[f"lo_{d}"]) for r in found[:1] for d in DIMENSIONS}
        spans, want = {}, {}
        for r in found:
            share = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d] for d in DIMENSIONS]
            widest = share.index(max(share))
            spans[r["node"]] = widest, r[f"lo_{DIMENSIONS[widest]}"], r[f"hi_{DIMENSIONS[widest]}"] - r[f"lo_{DIMENSIONS[widest]}"]
            want[r["node"]] = r["w"] * (goal[r["node"]] // 2) / goal[r["node"]]
        cut = _medians(at, spans, want)
        cuts = spark.createDataFrame([(n, *spans[n], c) for n, c in cut.items()], "node int, dim int, lo long, span long, cut long")
        moved = at.join(F.broadcast(cuts), "node", "left")
        new = common.scratch(moved.select(*points.columns, F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + (_order_key() >= F.col("cut")).cast("int")).alias("node")))
        common.drop(at)
        at = new
        for n in split:
            k = goal.pop(n)
            goal[2 * n], goal[2 * n + 1] = k // 2, k - k // 2
    order = sorted(goal, key=lambda n: n / (1 << (n.bit_length() - 1)))
    number = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "node int, shard int")
    return at.join(F.broadcast(number), "node").select(*points.columns, "shard")


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs (doc_id, text, source, lang) -> doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null)."""
    return _assigned(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _assigned(docs: DataFrame, shards: int, row: Column | None = None) -> DataFrame:
    rows = common.scratch(metadata(docs, row))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).head()["b"]
    target = max(1, total // shards)
    copies = rows.groupBy("text_id")
    groups = copies.agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("size").alias("bytes"))
    groups = common.scratch(ranked(ranked(common.scratch(groups), "source"), "lang"))
    parts = F.when(F.col("weight") > target, F.ceil(F.col("weight") * SUB_POINTS / target)).otherwise(1).cast("long")
    groups = groups.withColumn("parts", parts)
    # at most `shards` groups outweigh a shard: a list of bounded size
    heavy = {r["text_id"]: r["parts"] for r in groups.where("parts > 1").select("text_id", "parts").collect()}
    points = groups.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    points = points.select("text_id", F.xxhash64("text_id").alias("point"), "sub", (F.col("weight") / F.col("parts")).alias("weight"), "source", "lang", "bytes", "parts")
    points = common.scratch(points.withColumn("point", _with_sub(F.col("point"), F.col("sub"), F.col("parts"))))
    placed = common.scratch(tree(points, shards).select("text_id", "sub", "shard"))
    keys = F.lit(0).cast("long")
    for text_id, k in heavy.items():
        keys = F.when(F.col("text_id") == text_id, F.pmod(F.xxhash64("row"), F.lit(k))).otherwise(keys)
    rows_in = rows.withColumn("sub", keys)
    if heavy:  # rows of heavy groups meet a list of at most shards * SUB_POINTS * 2 places, the others a proper join
        few = F.broadcast(placed.where(F.col("text_id").isin(list(heavy))))
        cold = rows_in.where(~F.col("text_id").isin(list(heavy))).join(placed, ["text_id", "sub"])
        out = rows_in.where(F.col("text_id").isin(list(heavy))).join(few, ["text_id", "sub"]).unionByName(cold)
    else:
        out = rows_in.join(placed, ["text_id", "sub"])
    out = common.scratch(out.select("doc_id", "size", "text_crc32", "row", "shard"))
    return _slots(out)


def _with_sub(point: Column, sub: Column, parts: Column) -> Column:
    """Spreads the sub-points of a heavy group next to each other in the tie order: the low bits of its top 36."""
    shift = 64 - TIE_BITS
    return F.when(parts > 1, point.bitwiseAND(F.lit(~((1 << (shift + 14)) - 1))).bitwiseOR(F.shiftleft(sub, shift))).otherwise(point)


def _slots(rows: DataFrame, salts: int = 64) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: ranks inside (shard, salt), then prefix sums over the salts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sums = salted.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("row")) - 1
    return salted.withColumn("r", rank).join(F.broadcast(base), ["shard", "salt"]).withColumn("slot", F.col("base") + F.col("r"))


def write(docs: DataFrame, path: str, shards: int = 40) -> None:
    """The shards as files: path/shard=N, every row of docs once, with its own columns.  Where docs has a column of that name
    the folders are called shard_ (or as many _ as it takes)."""
    row, shard = common.unused(docs, "row"), common.unused(docs, "shard")
    numbered = common.scratch(docs.withColumn(row, F.monotonically_increasing_id()))  # so that a row keeps its number
    placed = common.scratch(_assigned(numbered, shards, F.col(row)).select(F.col("row").alias(row), F.col("shard").alias(shard)))
    out = numbered.join(placed.hint("merge"), row).drop(row)
    out.repartition(shards, shard).write.partitionBy(shard).parquet(path)
    common.drop(numbered, placed)
