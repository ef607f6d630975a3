"""Quality rules, natively: base rules, then robust multivariate outliers by language and source.

Each document's statistics become a vector of transformed values, kept as whole thousandths so that sums are
exact and reruns agree. For each (lang, source) a minimum-covariance-determinant estimate takes concentration
steps from three starts about the medians (median deviations alone, spatial signs, and hyperbolic tangents of the
scaled values): the COVERAGE share of documents nearest by Mahalanobis distance gives the next mean and covariance.
The start with the least determinant goes on alone. Documents beyond CUTOFF are rejected. A group of few documents
is judged by the estimate of its language, and one of a language of few by that of all documents. Everything
runs as column expressions; the estimates are a small table, whose triangular factor is worked out in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, BROADCAST_ROWS, SPACE, cut, join_small, let, words

MIN_WORDS, MAX_REPEATED = 50, 0.5
COVERAGE = 0.75
#: Concentration steps from each start, and those of the best one after them.
TRIAL_STEPS, LAST_STEPS = 2, 2
#: Squared distance beyond which a document goes. The 0.9999 quantile of chi-squared with six degrees of freedom
#: is 27.9, but lengths and counts have heavier tails than normal values; ten deviations leave clean texts alone.
CUTOFF = 100.0
#: Median of chi-squared with six degrees of freedom, for the scale of the estimate.
MEDIAN = 5.348
#: Least spread of each value, and the weight (in documents) of a diagonal of these in the covariance.
SPREAD = (0.8, 0.4, 0.7, 0.7, 0.15, 0.7)
PRIOR = 20.0
#: Groups of fewer documents that pass the base rules are judged by a wider estimate.
LEAST_GROUP = 20
P = len(SPREAD)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more, the first occurrence included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(found, lambda k: F.get(s, k)["i"]))

        gaps = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0), lambda n, k: n + F.coalesce(F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)), F.lit(3)))
        return let(let(ordered, places), gaps)

    twice = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, twice))


def base_statistics(text: Column) -> Column:
    """The base statistics as a struct of longs, and n_upper; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    long = lambda c, name: c.cast("long").alias(name)
    return F.struct(
        long(counts["n"], "n_words"),
        long(F.length(F.regexp_replace(text, SPACE, "")), "word_chars"),
        long(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), "n_symbols"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"),
        long(counts["r"], "n_repeat_words"),
        long(F.length(F.regexp_replace(text, r"\P{Lu}+", "")), "n_upper"),
    )


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Statistics, base verdict, group key and vector of every document, and the document as _doc if asked for."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    group = F.concat_ws("\x01", key("lang"), key("source"))
    df = docs.select("doc_id", group.alias("_g"), key("lang").alias("_lang"), F.explode(F.array(base_statistics(F.col("text")))).alias("_s"), *[F.struct("*").alias("_doc")] * whole)
    df = df.select("doc_id", "_g", "_lang", *[f"_s.{c}" for c in (*BASE, "n_upper")], *["_doc"] * whole)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    share = lambda c, of: F.col(c) / F.greatest(F.col(of), F.lit(1))
    values = (F.log1p("n_words"), share("word_chars", "n_words"), F.log1p(1000 * share("n_symbols", "word_chars")), F.log1p("n_dup_lines"), F.sqrt(share("n_repeat_words", "n_words")), F.log1p(1000 * share("n_upper", "word_chars")))
    return df.withColumns({"base_failed": failed} | {f"_x{i}": F.round(1000 * v).cast("long") for i, v in enumerate(values)})


LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
X = [f"_x{i}" for i in range(P)]
#: Place of each row's first cell in a lower triangle that is kept as an array, and its cells as SQL: place, row, column, places of both rows.
AT = [i * (i + 1) // 2 for i in range(P)]
CELLS = "array(" + ", ".join(f"struct({c} AS c, {i} AS i, {j} AS j, {AT[i]} AS a, {AT[j]} AS b)" for c, (i, j) in enumerate(LOWER)) + ")"


def factored(sums: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of each (_g, _k) from _n, _m (means) and _c (covariances), shrunk to SPREAD.

    Triangles are arrays, as named columns that build on each other make plans of a dozen wide projections, whose
    planning took most of the driver's memory.
    """
    prior = f"if(q.i = q.j, array({', '.join(f'{s ** 2}D' for s in SPREAD)})[q.i] * (1.05D - _n / (_n + {PRIOR}D)), 0D)"
    rest = f"aggregate(filter(array({', '.join(map(str, range(P)))}), k -> k < q.j), _n / (_n + {PRIOR}D) * _c[q.c] + {prior}, (v, k) -> v - l[q.a + k] * l[q.b + k])"
    cell = f"transform(array({rest}), v -> if(q.i = q.j, sqrt(v), v / l[q.b + q.j]))"
    return sums.selectExpr("_g", "_k", "_n", "_m", f"aggregate({CELLS}, cast(array() AS array<double>), (l, q) -> concat(l, {cell})) AS _l")


def distance(df: DataFrame) -> DataFrame:
    """Add _d2, the squared Mahalanobis distance by the columns of factored()."""
    value = " + ".join(f"y{i} * y{i}" for i in range(P))
    for i in reversed(range(P)):
        y = f"(_x{i} / 1000 - _m[{i}]" + "".join(f" - _l[{AT[i] + j}] * y{j}" for j in range(i)) + f") / _l[{AT[i] + i}]"
        value = f"transform(array({y}), y{i} -> {value})[0]"
    return df.withColumn("_d2", F.expr(value))


def levels(rows: DataFrame) -> DataFrame:
    """(_g, _e, _keys) of each group: the key of the estimate that judges it, and those its documents count for.

    The documents of a large group count for their own estimate, and for a wider one where a small group needs that.
    """
    n = rows.groupBy("_g", "_lang").agg(F.count("*").alias("n"))
    by_lang = n.groupBy("_lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    by_lang = by_lang.select(F.col("_lang").alias("_l"), F.when(F.col("n_lang") < LEAST_GROUP, 2).when(F.col("least") < LEAST_GROUP, 1).otherwise(0).alias("wide"))
    top = by_lang.agg((F.coalesce(F.max("wide"), F.lit(0)) == 2).alias("any"))
    t = n.join(by_lang, F.col("_lang") == F.col("_l")).crossJoin(top)  # one row on the right
    own, lang, every = F.concat(F.lit("g"), "_g"), F.concat(F.lit("l"), "_lang"), F.lit("a")
    large = F.col("n") >= LEAST_GROUP
    keys = F.filter(F.array(F.when(large, own), F.when(F.col("wide") == 1, lang), F.when(F.col("any"), every)), lambda k: k.isNotNull())
    return cut(t.select("_g", F.when(large, own).when(F.col("wide") == 1, lang).otherwise(every).alias("_e"), keys.alias("_keys")))


def starts(rows: DataFrame, joined, by: list[str]) -> DataFrame:
    """(_g, _k, _n, means, covariances): three starts of each group about its medians."""
    mid = cut(rows.groupBy(by).agg(F.count("*").alias("_n"), *[F.expr(f"percentile(_x{i}, 0.5D) AS _p{i}") for i in range(P)]))
    off = [f"max(_p{i}) AS _p{i}" for i in range(P)] + [f"percentile(abs(_x{i} - _p{i}), 0.5D) AS _w{i}" for i in range(P)]
    wide = cut(joined(rows, mid).groupBy(by).agg(F.max("_n").alias("_n"), *map(F.expr, off)))
    scaled = joined(rows, wide).selectExpr(*by, "_n", *[f"_p{i}" for i in range(P)], *[f"_w{i}" for i in range(P)], *[f"(_x{i} - _p{i}) / greatest(1.4826D * _w{i}, {500 * SPREAD[i]}D) AS _z{i}" for i in range(P)])
    scaled = scaled.selectExpr("*", "sqrt(" + " + ".join(f"_z{i} * _z{i}" for i in range(P)) + ") AS _r")
    scaled = scaled.selectExpr(*by, "_n", *[f"_{c}{i}" for c in "pw" for i in range(P)], *[f"coalesce(_z{i} / nullif(_r, 0D), 0D) AS _u{i}" for i in range(P)], *[f"tanh(_z{i}) AS _v{i}" for i in range(P)])
    cross = [f"sum(cast(round(1e6D * ({v}{i} * {v}{j})) AS bigint)) AS {s}{i}{j}" for v, s in (("_u", "_s"), ("_v", "_t")) for i, j in LOWER]
    one = scaled.groupBy(by).agg(F.max("_n").alias("_n"), *[F.expr(f"max(_{c}{i}) AS _{c}{i}") for c in "pw" for i in range(P)], *map(F.expr, cross))
    listed = lambda cells: f"array({', '.join(cells)})"
    width = listed(f"greatest(0.0014826D * _w{i}, {SPREAD[i] / 2}D)" for i in range(P))
    one = one.selectExpr(*by, "_n", f"{listed(f'_p{i} / 1000' for i in range(P))} AS _m", f"{width} AS _w", *[f"{listed(f'_{c}{i}{j}' for i, j in LOWER)} AS _{c}" for c in "st"])
    shape = lambda c: f"transform({CELLS}, q -> coalesce({P}D * _{c}[q.c] / nullif({' + '.join(f'_{c}[{AT[i] + i}]' for i in range(P))}, 0), 0D) * _w[q.i] * _w[q.j])"
    alone = f"transform({CELLS}, q -> if(q.i = q.j, _w[q.i] * _w[q.j], 0D))"
    each = f"posexplode(array({alone}, {shape('s')}, {shape('t')})) AS (_k, _c)"
    return one.selectExpr(*by, "_n", "_m", each)


def estimates(rows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Robust mean, factor and _scale for each group _h of rows, by documents that pass the base rules.

    Medians and quantiles are exact over values of bounded number (thousandths, hundredths of a logarithm), and sums
    are of whole numbers, so that reruns agree.
    """
    passed = rows.where("not base_failed")
    level = levels(passed)
    groups = level.count()
    few = lambda df: F.broadcast(df) if groups <= BROADCAST_ROWS // 8 else df
    key = level.select(F.col("_g").alias("_h"), "_keys")
    rows = cut(passed.join(few(key), F.col("_g") == F.col("_h")).select(F.explode("_keys").alias("_g"), *X))

    def joined(df: DataFrame, table: DataFrame) -> DataFrame:
        return df.join(few(table), "_g")

    def step(now: DataFrame) -> DataFrame:
        """In two small plans: the bound of each estimate, then the next estimate from the rows within it."""
        near = distance(joined(rows, now)).selectExpr("_g", "_k", "_m", "_l", f"{level_of} AS _bin")
        bound = cut(near.groupBy("_g", "_k").agg(F.expr(f"percentile(_bin, {coverage}D) AS _b"), F.first("_m").alias("_m"), F.first("_l").alias("_l")))
        inner = distance(joined(rows, bound)).where(f"{level_of} <= _b")
        sums = inner.groupBy("_g", "_k").agg(F.count("*").alias("_n"), *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(P)], *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q{i}{j}") for i, j in LOWER])
        sums = sums.selectExpr("_g", "_k", "_n", f"array({', '.join(f'_s{i} / _n / 1000' for i in range(P))}) AS _m", f"array({', '.join(f'_q{i}{j}' for i, j in LOWER)}) AS _q")
        return cut(factored(sums.selectExpr("_g", "_k", "_n", "_m", f"transform({CELLS}, q -> _q[q.c] / _n / 1e6D - _m[q.i] * _m[q.j]) AS _c")))

    level_of = "floor(100 * ln(greatest(_d2, 1e-6D)))"
    now = cut(factored(starts(rows, joined, ["_g"])))
    for _ in range(TRIAL_STEPS):
        now = step(now)
    size = " + ".join(f"ln(_l[{AT[i] + i}])" for i in range(P))
    now = now.groupBy("_g").agg(F.expr(f"min(struct(round({size}, 9) AS size, _k, _m, _l)) AS _q")).select("_g", *[f"_q.{c}" for c in ("_k", "_m", "_l")])
    for _ in range(LAST_STEPS):
        now = step(now)
    near = distance(joined(rows, now)).selectExpr("_g AS _key", "_m", "_l", f"{level_of} AS _bin")
    table = near.groupBy("_key").agg(F.expr(f"greatest(1D, exp(percentile(_bin, 0.5D) / 100) / {MEDIAN}D) AS _scale"), F.first("_m").alias("_m"), F.first("_l").alias("_l"))
    return cut(level.select(F.col("_g").alias("_h"), "_e").join(table, F.col("_e") == F.col("_key")).drop("_e", "_key"))


def judged(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add kept and the scaled squared distance; groups without a document that passes the base rules have no estimate."""
    df = join_small(rows, table, F.col("_g") == F.col("_h"), table.count(), "left")
    df = distance(df).withColumn("distance2", F.col("_d2") / F.col("_scale"))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance2") > CUTOFF, F.lit(False)))


def rules(docs: DataFrame) -> DataFrame:
    """Contract of op3: doc_id, the base statistics, base_failed, kept (and distance2).

    A null text counts as empty, has no words and fails. Null languages and sources form groups of their
    own. Repeated rows each count. Groups of fewer than LEAST_GROUP passing documents are judged by their language's
    estimate, or by that of all documents where the language has as few. An empty table gives no row. Ties at a
    quantile are all taken. Windows are compared by 64-bit hashes of their three words. Other columns are ignored.
    """
    rows = cut(measured(docs))
    return judged(rows, estimates(rows)).select("doc_id", *BASE, "base_failed", "kept", "distance2")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that rules() keeps, with all their columns: texts are measured again in place, so that only
    statistics are stored.

    Null, empty and short texts go, as they fail the base rules; repeated rows are judged alike and all stay or go. An
    empty table stays empty.
    """
    table = estimates(cut(measured(docs)))
    return judged(measured(docs, whole=True), table).where("kept").select("_doc.*")
