"""Graph operators: strongly connected components, undirected components, cohesion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from . import local

#: Reachability is squared (few rounds) while no step makes more rows an edge than this; else colours are spread (linear).
SQUARE_ROWS = 64
#: A graph of fewer edges may make as many rows as one of so many.
LEAST_EDGES = 100_000
#: Scopes of up to so many (method, field) rows are solved within a worker; rounds are for larger ones, with the same results.
LOCAL_ROWS = 65_536


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64(*df.columns))).first())


def _pairs(r: DataFrame) -> tuple[int, int]:
    """Rows of r, and of r joined to itself end to start, counted from degrees before it is done."""
    ends = F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    nodes = r.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    n = nodes.agg(F.sum("o"), F.sum(F.col("i") * F.col("o"))).first()
    return n[0] or 0, n[1] or 0


def _by_closure(edges: DataFrame, square_rows: int) -> DataFrame | None:
    """Components by squared reachability, or None where a step would make too many rows."""
    r, was, limit = edges, None, None
    while True:
        n, pairs = _pairs(r)
        limit = square_rows * max(n, LEAST_EDGES) if limit is None else limit
        if n == was:
            break
        if pairs > limit:
            return None
        was = n
        two = r.alias("a").join(r.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        r = cut(r.union(two).distinct())
    back = r.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return r.join(back, ["src", "dst"], "left_semi").groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("root"))


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Take the least label along the edges until nothing changes."""
    was = None
    while (now := _state(labels)) != was:
        was = now
        got = edges.join(labels, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "label")
        labels = cut(labels.union(got).groupBy("node").agg(F.min("label").alias("label")))
    return labels


def _by_colour(edges: DataFrame) -> DataFrame:
    parts = []
    while True:
        was = None
        while (now := _state(edges)) != was:  # nodes without a way in or out are on no cycle
            was = now
            edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if not now[0]:
            break
        nodes = edges.select(F.col("src").alias("node"))
        colour = _spread(cut(nodes.distinct().select("node", F.col("node").alias("label"))), edges)
        same = edges.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "c2"), "dst").where("c = c2")
        inside = cut(same.select("src", "dst", "c"))
        reached, was = colour.where("node = label").select("node", F.col("label").alias("c")), None
        reached = cut(reached)
        while (now := _state(reached)) != was:
            was = now
            back = inside.join(reached, (F.col("dst") == F.col("node")) & (inside["c"] == reached["c"])).select(F.col("src").alias("node"), inside["c"])
            reached = cut(reached.union(back).distinct())
        parts.append(reached)
        gone = reached.select("node")
        edges = cut(edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    if not parts:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("node", F.col("c").alias("root"))


def strong_components(edges: DataFrame, square_rows: int = SQUARE_ROWS) -> DataFrame:
    """(node, root) of every node in a cycle of two or more; root is the least member. Self-loops are no cycles.

    Where nodes are 64-bit numbers, cycles among near numbers are found within workers, and rounds take only the
    edges that may lie on cycles that lead farther.
    """
    edges, done = edges.select("src", "dst").where("src <> dst"), None
    if all(t == "bigint" for _, t in edges.dtypes):
        edges = cut(edges)
        got = cut(local.bucket_cycles(edges, local.parts(edges, 2 * edges.count())))
        done, edges = got.where("not rest").select("node", "root"), got.where("rest").select(F.col("node").alias("src"), F.col("root").alias("dst"))
        if edges.isEmpty():
            return done
    edges = cut(edges.distinct())
    found = _by_closure(edges, square_rows)
    found = _by_colour(edges) if found is None else found
    big = found.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    found = found.join(big, "root", "left_semi").select("node", "root")
    return found if done is None else done.unionByName(found)


def cycles(edges: DataFrame) -> DataFrame:
    """One row a cycle: its sorted members, which are a set and not a walk, ordered by first member when sorted."""
    return strong_components(edges).groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("members")).select("members")


def components(pairs: DataFrame) -> DataFrame:
    """Undirected components of (a, b) as (node, root); alternating star steps, a checkpoint each round."""
    e = cut(pairs.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("p")).where("n <> p").distinct())
    was = None
    while (now := _state(e)) != was and now[0]:
        was = now
        both = e.union(e.select("p", "n")).toDF("n", "p")
        low = both.groupBy("n").agg(F.min("p").alias("m")).select("n", F.least("n", "m").alias("m"))
        star = both.where("p > n").join(low, "n").select(F.col("p").alias("n"), F.col("m").alias("p")).distinct()
        least = star.groupBy("n").agg(F.min("p").alias("m"))
        small = star.join(least, "n").select(F.explode(F.array(F.struct("n", F.col("m").alias("p")), F.struct(F.col("p").alias("n"), F.col("m").alias("p")))).alias("e"))
        e = cut(small.select("e.n", "e.p").where("n <> p").distinct())
    return e.select(F.col("n").alias("node"), F.col("p").alias("root"))


def _rounds(method_fields: DataFrame) -> DataFrame:
    key = lambda kind, c: F.concat_ws("\x01", F.lit(kind), F.col("scope").cast("string"), F.col(c).cast("string"))
    methods = method_fields.select("scope", F.when(F.col("method").isNotNull(), key("m", "method")).alias("node")).distinct()
    pairs = method_fields.where("method is not null and field is not null").select(key("m", "method").alias("a"), key("f", "field").alias("b"))
    by_scope = methods.join(components(pairs), "node", "left").groupBy("scope")
    return by_scope.agg(F.countDistinct(F.coalesce("root", "node")).cast("long").alias("lcom"))


def cohesion(method_fields: DataFrame, local_rows: int = LOCAL_ROWS, n_rows: int | None = None) -> DataFrame:
    """LCOM4 of each scope: components of methods that share a field, directly or through others.

    method_fields has (scope, method, field), field being null for a method without any; such a method is a
    component of its own, and a row with a null method marks a scope without methods, which has 0. n_rows says
    about how many rows there are, where that is known beforehand.
    """
    rows = method_fields.select("scope", "method", "field")
    if n_rows is None:
        rows = cut(rows)
        n_rows = rows.count()
    got = cut(local.scope_components(rows, local.parts(rows, n_rows), local_rows))
    small, large = got.where("lcom is not null").select("scope", "lcom"), got.where("lcom is null").select("scope", "method", "field")
    return small if large.isEmpty() else small.unionByName(_rounds(large))


def participation(cycle_rows: DataFrame) -> DataFrame:
    """For each member: how many cycles hold it, and the first of these in element order."""
    return cycle_rows.select(F.explode("members").alias("path"), "members").groupBy("path").agg(F.count("*").alias("n_cycles"), F.min("members").alias("representative"))
