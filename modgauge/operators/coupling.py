"""Coupling and type operators over fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m


def internal_edges(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports whose target is one of the packages."""
    return imports.join(packages.select(F.col("module").alias("target")), "target", "left_semi").select("module", "target")


def coupling(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """ca: distinct internal importers; ce: distinct imports, those of foreign packages included."""
    inside = internal_edges(imports, packages).join(packages.select("module"), "module", "left_semi")
    ca = inside.groupBy(F.col("target").alias("module")).agg(F.countDistinct("module").alias("ca"))
    ce = imports.groupBy("module").agg(F.countDistinct("target").alias("ce"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return packages.select("module").join(ca, "module", "left").join(ce, "module", "left").select("module", zero("ca"), zero("ce"))


def type_counts(types: DataFrame) -> DataFrame:
    """exported_types and abstract_types: an alias counts as exported and never as abstract."""
    return types.groupBy("module").agg(
        F.count_if("exported").cast("long").alias("exported_types"), F.count_if(F.col("exported") & ~F.col("is_alias") & F.col("is_iface")).cast("long").alias("abstract_types")
    )


def python_type_counts(types: DataFrame) -> DataFrame:
    """Abstract classes count whether exported or not, so that abstractness can pass 1."""
    return types.groupBy("module").agg(F.count_if("exported").cast("long").alias("exported_types"), F.count_if("abstract").cast("long").alias("abstract_types"))


def derived(modules: DataFrame) -> DataFrame:
    """Add instability, abstractness, distance and zone to ca, ce, exported_types, abstract_types."""
    out = modules.withColumns({"instability": m.instability(F.col("ca"), F.col("ce")), "abstractness": m.abstractness(F.col("abstract_types"), F.col("exported_types"))})
    out = out.withColumn("distance", m.distance(F.col("abstractness"), F.col("instability")))
    return out.withColumn("zone", m.zone(F.col("instability"), F.col("abstractness"), F.col("distance")))


def module_table(packages: DataFrame, imports: DataFrame, types: DataFrame, lcom: DataFrame, lines: DataFrame, python: bool = False) -> DataFrame:
    """All module metrics; facts that are missing for a module count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = python_type_counts(types) if python else type_counts(types)
    wide = coupling(imports, packages).join(counts, "module", "left").join(lcom, "module", "left").join(lines, "module", "left")
    return derived(wide.select("module", "ca", "ce", zero("exported_types"), zero("abstract_types"), zero("lcom"), zero("total_lines")))


def counters(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges out of, into and beyond the packages, for each module."""
    known = packages.select(F.col("module").alias("target"), F.lit(True).alias("inside"))
    marked = edges.distinct().join(known, "target", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    out = marked.groupBy("module").agg(F.count_if("inside").alias("internal_out"), F.count_if(~F.col("inside")).alias("external_out"))
    into = marked.where("inside").groupBy(F.col("target").alias("module")).agg(F.count("*").alias("internal_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return packages.select("module").join(out, "module", "left").join(into, "module", "left").select("module", zero("internal_out"), zero("internal_in"), zero("external_out"))


def extremes(modules: DataFrame) -> DataFrame:
    """Coupling and cohesion extremes in one row; the first path wins ties. Heavy: ca over 10; review: lcom 4 or more."""
    first = lambda c, name: F.min(F.struct(c.alias("k"), F.col("module").alias("module")))["module"].alias(name)
    return modules.agg(
        first(-F.col("ca"), "most_ca"), first(-F.col("ce"), "most_ce"), first(F.col("lcom"), "least_lcom"), first(-F.col("lcom"), "most_lcom"),
        F.count_if(F.col("ce") == 0).alias("leaves"), F.count_if(F.col("ca") > 10).alias("heavy"), F.count_if(F.col("lcom") >= 4).alias("review"),
    )


def interface_width(iface_methods: DataFrame) -> DataFrame:
    """Flattened method count of each interface, and all of a module's as a map."""
    width = iface_methods.groupBy("module", "iface").agg(F.countDistinct("method").alias("width"))
    return width.groupBy("module").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("iface", "width")))).alias("interface_width"))


def implements(ifaces: DataFrame, types: DataFrame) -> DataFrame:
    """(iface, type) pairs whose method sets contain the interface's, by counted matches and no cross join.

    Candidates are the types that have the interface's rarest method, so that methods common to all types join
    nothing. Interfaces of no method are left to the caller: every type has them.
    """
    ifaces, types = ifaces.distinct(), types.distinct()
    held = types.groupBy("method").agg(F.count("*").alias("n_types"))
    wanted = ifaces.join(held, "method", "left").groupBy("iface").agg(F.count("*").alias("need"), F.min(F.struct(F.coalesce("n_types", F.lit(0)).alias("n"), "method"))["method"].alias("method"))
    candidates = wanted.join(types, "method").select("iface", "type", "need")
    have = candidates.join(ifaces, "iface").join(types, ["type", "method"], "left_semi").groupBy("iface", "type", "need").agg(F.count("*").alias("have"))
    return have.where("have = need").select("iface", "type")


def proximity(ifaces: DataFrame, types: DataFrame) -> DataFrame:
    """producer where a concrete type has the interface's methods, else consumer."""
    done = implements(ifaces, types).select("iface").distinct().withColumn("proximity", F.lit("producer"))
    return ifaces.select("iface").distinct().join(done, "iface", "left").select("iface", F.coalesce("proximity", F.lit("consumer")).alias("proximity"))
