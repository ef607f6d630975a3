"""Scalar metric functions as column expressions: ratios, zones, grades, names and keys.

Constants are those users know: zone bounds 0.2 and 0.8, grade bounds, gate widths. Comparisons keep their
strictness, and float operations their order, because both decide boundary cases.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

GRADES = ("A", "B+", "B", "C+", "C", "F")
GRADE_BOUNDS = {"distance": (0.1, 0.2, 0.3, 0.5, 0.7), "lcom": (2, 3, 4, 5, 6)}
DUPLICATION_BOUNDS = (3.0, 5.0, 10.0, 15.0)
EMOJI = {"A": "🟢", "B+": "🟢", "B": "🟡", "C+": "🟡", "C": "🟠", "F": "🔴"}
OVERALL = {"A": "Healthy", "B+": "Healthy", "B": "Mixed", "C+": "Mixed", "C": "Needs Attention", "F": "Needs Attention"}
SEVERITY_RANK = {"red": 0, "yellow": 1, "green": 2}


def _map(values: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(values.items())))


def look_up(key: Column, values: dict, default) -> Column:
    return F.coalesce(F.element_at(_map(values), key), F.lit(default))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, and 0.0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def instability(ca: Column, ce: Column) -> Column:
    return ratio(ce, ca + ce)


def abstractness(abstract: Column, exported: Column) -> Column:
    """Not clamped: unexported abstract types can take it over 1."""
    return ratio(abstract, exported)


def distance(a: Column, i: Column) -> Column:
    return F.abs(a + i - F.lit(1.0))


def zone(i: Column, a: Column, d: Column) -> Column:
    return F.when(d < 0.2, "main-sequence").when((a < 0.2) & (i < 0.2), "zone-of-pain").when((a > 0.8) & (i > 0.8), "zone-of-uselessness").otherwise("normal")


def round4(x: Column) -> Column:
    """Half away from zero at four decimals, by way of the scaled value."""
    return F.round(x * F.lit(1e4)) / F.lit(1e4)


def percent(covered: Column, total: Column) -> Column:
    """Percent with one decimal, cut off and not rounded; 0 where there is nothing to cover."""
    return F.when(total == 0, F.lit(0.0)).otherwise((covered * 1000 - covered * 1000 % F.nullif(total, F.lit(0))) / F.nullif(total, F.lit(0)) / F.lit(10.0))


def no_negative_zero(x: Column) -> Column:
    return x + F.lit(0.0)


def identity(path: Column, language: str) -> Column:
    """Module identity of a directory: python dots its segments; "." stays."""
    bare = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(bare == "", F.raise_error(F.lit("empty module path"))).when(bare == ".", bare).otherwise(F.replace(bare, F.lit("/"), F.lit(".")) if language == "python" else bare)


def last_name(path: Column) -> Column:
    """Last dotted segment, else last path segment."""
    return F.when(path == ".", path).when(path.contains("."), F.substring_index(path, ".", -1)).otherwise(F.substring_index(path, "/", -1))


def directory_of_identity(path: Column) -> Column:
    return F.when(path == ".", path).otherwise(F.replace(path, F.lit("."), F.lit("/")))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def cycle_key(members: Column) -> Column:
    return F.array_join(F.array_sort(members), "\x00")


def cycle_chain(members: Column) -> Column:
    return F.when(F.size(members) > 0, F.array_join(F.concat(members, F.slice(members, 1, 1)), " → ")).otherwise("")


def _ladder(x: Column, bounds) -> Column:
    out = F.lit("A")
    for bound, grade in zip(bounds, GRADES[1:], strict=True):
        out = F.when(x >= F.lit(bound), grade).otherwise(out)
    return out


def distance_grade(x: Column) -> Column:
    return _ladder(x, GRADE_BOUNDS["distance"])


def lcom_grade(x: Column) -> Column:
    return _ladder(x, GRADE_BOUNDS["lcom"])


def cycle_grade(n: Column) -> Column:
    return F.when(n == 0, "A").otherwise("F")


def duplication_grade(p: Column) -> Column:
    out = F.when(p > 0, "B+").otherwise("A")
    for bound, grade in zip(DUPLICATION_BOUNDS, GRADES[2:], strict=True):
        out = F.when(p >= F.lit(bound), grade).otherwise(out)
    return out


def spread_grade(n: Column) -> Column:
    return F.when(n <= 0, "A").when(n == 1, "B").when(n == 2, "C+").otherwise("F")


def grade_rank(g: Column) -> Column:
    return look_up(g, {x: i for i, x in enumerate(GRADES)}, len(GRADES)).cast("long")


def severity_rank(s: Column) -> Column:
    return look_up(s, SEVERITY_RANK, len(SEVERITY_RANK)).cast("long")


def count_word(n: Column, noun: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, noun).otherwise(noun + "s"))


def exported_name(name: Column, language: str) -> Column:
    return name.rlike(r"^\p{Lu}") if language == "go" else ~name.startswith("_")


def sparkline(values: Column) -> Column:
    """Eight bar heights over the range of the values, at most thirty of them, sampled evenly."""
    n = F.size(values)
    some = F.when(n > 30, F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.get(values, F.floor(i * n / 30).cast("int")))).otherwise(values)
    low, high = F.array_min(some), F.array_max(some)
    bar = lambda x: F.when(high - low < 1e-10, F.lit("▄")).otherwise(F.substring(F.lit("▁▂▃▄▅▆▇█"), F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * 7).cast("int") + 1, F.lit(1)))
    return F.array_join(F.transform(some, bar), "")
