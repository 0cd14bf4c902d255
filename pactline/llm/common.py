"""Shared plumbing: scratch tables, key bitmaps, connected components, linking inside buckets."""

from __future__ import annotations

import atexit
import gc
import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FALLBACK = "/tmp/checkpoints"  # only where the session names no shared folder, as in tests

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a session whose executors live in the
    driver may leave it unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def scratch(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors
    and makes row order, random values and task numbers in it final.  Removed when the driver ends, or by drop().  With
    `by`, files are laid out by that column's few values, so that a filter on it reads its own only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    _left.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove scratch tables that no later result reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)
            _left[:] = [x for x in _left if x[1] != path]


def held() -> set[str]:
    """Paths of the scratch tables there are now."""
    return {path for _, path in _left}


def drop_paths(spark: SparkSession, paths: set[str]) -> None:
    for path in paths & held():
        _delete(spark, path)
        _left[:] = [x for x in _left if x[1] != path]


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are no longer held; it waits for the driver's garbage
    collection else, and a chain of jobs would keep them all on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Size of the key bitmaps: 2 MB, whatever the number of keys.
LOG2_BITS = 24


def low_bitmap(keys: DataFrame, col: str) -> np.ndarray:
    """Bits (uint8, little-endian) set at the low LOG2_BITS bits of every value of a column of hashes.  Its size is
    fixed, so it may be broadcast; a test against it can say yes wrongly but never no wrongly, and an exact join has to
    follow."""
    at = F.col(col).bitwiseAND(F.lit((1 << LOG2_BITS) - 1))
    per = keys.select((at + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect()  # 512 rows
    out = np.zeros((1 << LOG2_BITS) // 8, np.uint8)
    for row in per:
        out[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(bytes(row["m"]), np.uint8)
    return out


def bit_set(bitmap: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return (bitmap[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart: number of rows and two sums over their hashes, both taken map-side."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit((1 << 31) - 1)))).head())


def _lowest(edges: DataFrame, *more: Column) -> DataFrame:
    """(u, m): the smallest neighbour of u.  Written out, so that a join with it deals both sides out anew and adaptive
    execution can split the partition of a hub."""
    return scratch(edges.groupBy("u").agg(F.least(F.min("v"), *more).alias("m") if more else F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, comp): comp is the smallest id reachable.  Alternating large-star and
    small-star steps until nothing moves; all state stays distributed, every round is cut by a scratch table.  Minima
    are taken map-side, and the rows of a hub are split where they meet its minimum."""
    e = scratch(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while True:
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = e.unionByName(turned)
        low = _lowest(both, F.col("u"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch(large.where("u <> v").distinct())
        low2 = _lowest(large)
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(low2.hint("merge"), "u").select(F.explode(ends).alias("x")).select("x.*")
        new = scratch(small.where("u <> v").distinct())
        drop(e, low, large, low2)
        e, before, state = new, state, _state(new)
        if state == before:
            break
    heads = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(heads)


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    m, c = members.alias("m"), comps.alias("c")
    return m.join(c, F.expr("m.node = c.node"), "left").select("m.*", F.expr("coalesce(c.comp, m.node)").alias("comp"))


def like_sizes(percent: int) -> str:
    """Condition of link_buckets: sizes at least `percent` per cent of one another."""
    return f"least(x.size, y.size) * 100L >= greatest(x.size, y.size) * {percent}L"


def rare_prefixes(sets: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """For link_buckets' refine: sets (node, comp, elements) -> buckets by the elements of each set's prefix, rarest
    first among these sets, and the condition that two sets which meet there can still be `percent` alike.  Sets about
    one much-shared passage so meet only those that share something rare with them."""
    each = sets.select("node", F.explode("elements").alias("s"))
    ranked = each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("o"))  # one set's elements
    most = (F.size("elements") - F.ceil(F.size("elements") * percent / 100) + 1).cast("int")
    sub = ranked.join(sets.select("node", "comp", F.size("elements").alias("size"), most.alias("most")), "node")
    sub = sub.select("node", "comp", "size", F.posexplode(F.slice("o", 1, F.col("most"))).alias("pos", "x")).where("x.n > 1")
    room = f"least(x.size - x.pos, y.size - y.pos) * {100 + percent}L >= {percent}L * (x.size + y.size)"
    return scratch(sub.select(F.col("x.s").alias("key"), "node", "comp", "size", "pos")), f"{like_sizes(percent)} and {room}"


#: Nodes of a bucket whose pairs are all tested.
SMALL = 12


def link_buckets(members: DataFrame, verify, near: str = "true", payload: tuple[str, ...] = ("size",), refine=None, small: int = SMALL, narrow: DataFrame | None = None, across=None) -> DataFrame:
    """members (key, node, rank, payload columns; a key has a node once): candidates are nodes x and y that share a key and meet `near`, a
    condition on their payloads.  verify(pairs a < b) keeps the true links.  Returns (node, comp) of the graph of all true
    links, without listing all pairs of a large bucket:

    1. in buckets of at most `small` nodes all pairs are tested; in larger ones each node meets the node of lowest
       rank (a star);
    2. buckets whose nodes are then still in several components test every pair of nodes in different ones.
       refine(rows of these buckets: key, node, comp, payload) may give narrower buckets and a condition for them, as
       long as it parts no two nodes that could link.  across(rows of these buckets with all keys of the node, and n, the
       nodes of the bucket) may test these pairs itself and give the true links, so that a pair need not be a row.

    Where the caller has the pairs a < b of the buckets of at most `small` nodes already, it gives them as `narrow`, and the
    others as members.

    Pairs inside one component need no test, so the components are those of all links."""
    m = members if hasattr(members, "_scratch_path") else scratch(members.select("key", "node", "rank", *payload))
    spark = m.sparkSession
    heads = scratch(m.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "node", *payload)).alias("h")).where("n > 1"))
    pair = [F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")]
    few = None
    if narrow is None:
        few = scratch(m.join(heads.where(F.col("n") <= small).select("key"), "key"))
        narrow = few.alias("x").join(few.alias("y"), F.expr(f"x.key = y.key and x.node < y.node and {near}")).select(*pair)
    star = m.alias("x").join(heads.where(F.col("n") > small).select("key", "h.*").alias("y"), F.expr("x.key = y.key")).where(F.expr(f"x.node <> y.node and {near}")).select(*pair)
    tested = scratch(narrow.unionByName(star).distinct())
    if few is not None:
        drop(few)
    release(spark)
    good = scratch(verify(tested))
    drop(tested)
    comps = scratch(components(good))
    release(spark)
    many = m if few is None else m.join(heads.where(F.col("n") > small).select("key"), "key")
    lab = scratch(_labelled(many, comps))
    open_ = lab.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    rest = scratch(lab.join(open_.select("key", "n") if across else open_.select("key"), "key"))
    if not rest.isEmpty():
        if refine:
            old = rest
            rest, near = refine(rest)
            drop(old)
            release(spark)
        else:  # a pair is met once, under the least key that both nodes have here
            keys = rest.groupBy("node").agg(F.collect_set("key").alias("keys"))  # a node's own keys
            rest = scratch(rest.join(keys, "node"))
            near = f"{near} and x.key = array_min(array_intersect(x.keys, y.keys))"
        if across and not refine:
            good2 = scratch(across(rest))
        else:
            more = rest.alias("x").join(rest.alias("y"), F.expr(f"x.key = y.key and x.node < y.node and x.comp <> y.comp and {near}")).select(*pair)
            good2 = scratch(verify(scratch(more.distinct())))
        if not good2.isEmpty():
            old = comps
            comps = scratch(components(good.unionByName(good2)))
            drop(old)
        drop(good2)
    drop(heads, good, lab, rest)
    if m is not members:
        drop(m)
    return comps
