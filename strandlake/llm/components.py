"""One group identifier for all records that are linked directly or indirectly.

Records get order-preserving numbers. Then, as long as it pays, vertices of degree one are stripped and paths of degree-two
vertices are compressed into one edge by list ranking (pointer doubling over directed edges). The reduced core is
solved by alternating star contraction, and the removed vertices take the label of the vertex that they were hung on.
Every step is a join or an aggregate over edges and is written to the shared folder, so nothing is held by the driver
and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandlake.session import cut, cut_counted, scratch_path

MAX_ROUNDS = 60
#: Pointers followed in one step of the list ranking.
HOPS = 3
#: Edges beyond which smallest neighbours are written before they are joined; the result is the same.
MANY = 5_000_000


def normal_id(c: Column) -> Column:
    """Without spaces around it and in upper case."""
    return F.upper(F.trim(c))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _degrees(edges: DataFrame) -> DataFrame:
    """``(x, d, n1, n2)``: degree, smallest and greatest neighbour of each vertex; pre-aggregated, so hubs are no burden."""
    return _both(edges).groupBy(F.col("u").alias("x")).agg(F.count("*").alias("d"), F.min("v").alias("n1"), F.max("v").alias("n2"))


def strip_leaves(edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Remove vertices of degree one: ``(child, parent)`` of each, the edges that stay, and how many. Of an isolated pair the smaller vertex stays as parent."""
    leaves = _degrees(edges).where("d = 1").select(F.col("x").alias("child"), F.col("n1").alias("parent"))
    pairs = leaves.groupBy(*_ordered("child", "parent")).agg(F.count("*").alias("_k"), F.min("child").alias("_c"))
    gone = cut(pairs, f"{name}-leaves")
    hung = gone.select(F.when(F.col("_k") == 2, F.col("v")).otherwise(F.col("_c")).alias("child"), "u", "v")
    hung = hung.select("child", F.when(F.col("child") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("parent"))
    stay, size = cut_counted(edges.join(gone.select("u", "v"), ["u", "v"], "left_anti"), f"{name}-stripped", n=F.count(F.lit(1)))
    return hung, stay, size["n"]


def compress_chains(edges: DataFrame, size: int, name: str, least_gain: float) -> tuple[DataFrame, DataFrame, int]:
    """Replace each path of degree-two vertices by an edge between its ends: ``(child, parent)`` of the path's vertices, the edges that stay, and how many.

    If fewer than ``least_gain`` of the ``size`` edges would go, nothing is done.

    List ranking: ``(x, side)`` stands for the edge that leaves path vertex ``x`` on that side; it points on to the next
    one, ``(b, turn)``, or has arrived if ``b`` is no path vertex. Each step follows the pointers of the table ``HOPS`` times, so
    their length grows by the factor ``HOPS + 1``. ``lo`` is the smallest vertex passed. A ring never ends; when a step closes no
    vertex and lowers no ``lo``, every ``lo`` has seen its whole ring and becomes the parent. A pointer that has arrived is
    written once and only read from then on.
    """
    middle, found = cut_counted(_degrees(edges).where("d = 2").select("x", "n1", "n2"), f"{name}-middle", n=F.count(F.lit(1)))
    if found["n"] <= size * least_gain:
        return middle.select(F.col("x").alias("child"), F.col("n1").alias("parent")).limit(0), edges, size
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("n1").alias("b")), F.struct(F.lit(1).alias("side"), F.col("n2").alias("b"))))
    state = middle.select("x", sides.alias("_s")).select("x", "_s.side", "_s.b").join(middle.select(F.col("x").alias("b"), "n1"), "b", "left")
    # the edge that leaves b when one comes from x is b's other one
    turn = F.when(F.col("n1") == F.col("x"), 1).when(F.col("n1").isNotNull(), 0)
    state = state.select("x", "side", "b", turn.alias("turn"), F.least("x", "b").alias("lo"))
    waits = F.col("turn").isNotNull()
    left = {"open": F.count_if(waits), "lo": F.sum(F.when(waits, F.col("lo")))}
    steps = Steps(edges.sparkSession, f"{name}-rank")
    now = steps.add(state, **left)
    before = None
    # a path with open vertices closes some of them in each step; so if none closed, only rings are open, and if no
    # "lo" fell either, windows that tile the ring agree on it: it is the ring's smallest vertex
    while now["open"] and now != before:
        before = now
        ahead = steps.all().select(F.col("x").alias("b"), F.col("side").alias("turn"), F.col("b").alias("_b"), F.col("turn").alias("_t"), F.col("lo").alias("_lo"))
        moved = steps.last().where(waits)
        for _ in range(HOPS):
            moved = moved.join(ahead, ["b", "turn"], "left")
            moved = moved.select("x", "side", F.coalesce("_b", "b").alias("b"), F.col("_t").alias("turn"), F.least("lo", "_lo").alias("lo"))
        now = steps.add(moved, **left)
    ends = steps.all().groupBy("x").agg(F.min("b").alias("e1"), F.max("b").alias("e2"), F.min("lo").alias("lo"), F.max(F.col("turn").isNotNull()).alias("ring"))
    ends = cut(ends, f"{name}-ends")
    hung = ends.where("not ring").select(F.col("x").alias("child"), F.col("e1").alias("parent"))
    hung = hung.unionByName(ends.where("ring and x != lo").select(F.col("x").alias("child"), F.col("lo").alias("parent")))
    bridges = ends.where("not ring and e1 != e2").select(F.col("e1").alias("u"), F.col("e2").alias("v"))
    touched = middle.select(F.col("x").alias("_m"))
    kept = edges.join(touched, F.col("u") == F.col("_m"), "left_anti").join(touched, F.col("v") == F.col("_m"), "left_anti")
    stay, size_ = cut_counted(kept.unionByName(bridges).distinct(), f"{name}-bridged", n=F.count(F.lit(1)))
    return hung, stay, size_["n"]


class Steps:
    """The tables of the steps of a list ranking as one: pointers that have arrived from all steps, and those of the last one that haven't."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, scratch_path(spark, name), 0

    def add(self, table: DataFrame, **counts: Column) -> dict[str, int]:
        """Write the pointers that the last step moved; gives their counts."""
        seen = Observation()
        self.schema = table.schema
        table.observe(seen, *(c.alias(k) for k, c in counts.items())).write.parquet(f"{self.path}/{self.n}")
        self.n += 1
        return {k: seen.get.get(k) or 0 for k in counts}

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.n - 1}")

    def all(self) -> DataFrame:
        if self.n == 1:
            return self.last()
        done = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{k}" for k in range(self.n - 1)))
        return done.where("turn is null").unionByName(self.last())


def _minima(around: DataFrame, size: int, name: str) -> DataFrame:
    """``(u, m)``: the smallest neighbour of each vertex. Beyond ``MANY`` edges it is written, so both sides of a join with it are plain shuffles and a hub's edges can be split among tasks."""
    low = around.groupBy("u").agg(F.min("v").alias("m"))
    return cut(low, name) if size > MANY else low


def solve_core(edges: DataFrame, size: int, name: str) -> DataFrame:
    """``(child, parent)``: every vertex of the core but the smallest of its component, hung on that one, by alternating large-star and small-star steps."""
    stars = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # u > v
    before = None
    for _ in range(MAX_ROUNDS):
        around = _both(stars)
        low = _minima(around, size, f"{name}-low").select("u", F.least("u", "m").alias("m"))
        large = cut(around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        low = _minima(large, size, f"{name}-low")
        hooked = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        counts = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))}
        stars, now = cut_counted(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-small", **counts)
        if now == before:
            return stars.select(F.col("u").alias("child"), F.col("v").alias("parent"))
        before = now
    raise RuntimeError("the core didn't settle")


def connected_groups(pairs: DataFrame, left: str = "qid", right: str = "sid", least_gain: float = 0.1) -> DataFrame:
    """``(id, group_id)``: every id of either column once, with the smallest id, in byte order, of all that are linked to it.

    Ids are compared and given out without spaces around them and in upper case.

    Defined results: a null links nothing (its partner is a row all the same); self matches, repeated rows and pairs in
    both directions add nothing; an id that is empty after trimming is an id; an empty table gives no row; other
    columns, of any name, are ignored.
    """
    links = pairs.select(normal_id(F.col(left)).alias("a"), normal_id(F.col(right)).alias("b")).distinct()
    names = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).where("id is not null").distinct()
    # sorted over all partitions, so the numbers follow the order of the ids; written, so they stay as they are
    nodes = cut(names.sort("id").withColumn("x", F.monotonically_increasing_id()), "nodes")
    linked = links.where("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = linked.join(nodes.select(F.col("id").alias("a"), F.col("x").alias("u")), "a").join(nodes.select(F.col("id").alias("b"), F.col("x").alias("v")), "b").select("u", "v")
    edges, now = cut_counted(edges, "edges", n=F.count(F.lit(1)))
    hung: list[DataFrame] = []
    size = now["n"]
    for k in range(MAX_ROUNDS):
        if not size:
            break
        was = size
        leaves, edges, size = strip_leaves(edges, f"round{k}")
        chains, edges, size = compress_chains(edges, size, f"round{k}", least_gain)
        hung += [leaves, chains]
        if size > was * (1 - least_gain):
            break
    if size:
        hung.append(solve_core(edges, size, "core"))
    # vertices of degree one and two hang on others that may have been removed later: follow the pointers to the end
    up = nodes.select(F.col("x").alias("child")).limit(0).withColumn("parent", F.col("child"))
    for h in hung:
        up = up.unionByName(h)
    up = cut(up, "hung")
    while True:
        next_ = up.select(F.col("child").alias("parent"), F.col("parent").alias("_up"))
        joined = up.join(next_, "parent", "left").select("child", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved"))
        joined, now = cut_counted(joined, "follow", moved=F.count_if("_moved"))
        up = joined.select("child", "parent")
        if not now["moved"]:
            break
    roots = nodes.join(up.withColumnRenamed("child", "x"), "x", "left").select("id", F.coalesce("parent", "x").alias("root"))
    roots = cut(roots, "roots")
    return roots.join(roots.groupBy("root").agg(F.min("id").alias("group_id")), "root").select("id", "group_id")
