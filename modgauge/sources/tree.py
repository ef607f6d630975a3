"""Source trees as a data source: a partition for each directory, hidden and underscored files included."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that are pruned, and the extensions that count as source.
PRUNED = ("build", "dist", "out", "target", "vendor", "third_party", "captures")
SOURCES = (".py", ".ts", ".tsx", ".js", ".jsx")
#: Marker files of languages, in order of precedence.
MARKERS = (("go", ("go.mod",)), ("python", ("pyproject.toml", "setup.py", "setup.cfg")), ("typescript", ("tsconfig.json",)))


class _Reader(DataSourceReader):
    def __init__(self, root: str, prune: bool):
        self.root, self.prune = os.path.realpath(root), prune

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise ValueError(f"{self.root} is not a directory")
        out = []
        for folder, inner, _ in os.walk(self.root):
            inner[:] = sorted(d for d in inner if not (self.prune and d in PRUNED))
            out.append(InputPartition(folder))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with os.scandir(partition.value) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                if e.is_file():
                    path, text, error = os.path.relpath(e.path, self.root), None, None
                    try:
                        with open(e.path, encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                    except OSError as x:
                        error = x.strerror
                    yield path, os.path.dirname(path) or ".", e.name, os.path.splitext(e.name)[1], text, error


class SourceTree(DataSource):
    """Options: path, prune (true leaves out build folders, never the root). The path must be seen by executors."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, dir string, name string, ext string, text string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("prune", "false").lower() == "true")


def files(spark: SparkSession, root: str, prune: bool = False) -> DataFrame:
    if ".." in root.split("/"):
        raise ValueError("a path may not hold ..")
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("path", root).option("prune", str(prune).lower()).load()


def census(files: DataFrame) -> DataFrame:
    """One row (py, ts): files by extension, in any case."""
    ext = F.lower("ext")
    return files.agg(F.count_if(ext == ".py").alias("py"), F.count_if(ext.isin(".ts", ".tsx")).alias("ts"))


def language(files: DataFrame) -> DataFrame:
    """One row: by marker files at the top, else by the census, else go."""
    top = F.col("dir") == "."
    found = [F.coalesce(F.bool_or(top & F.col("name").isin(*names)), F.lit(False)).alias(lang) for lang, names in MARKERS]
    ext = F.lower("ext")
    one = files.agg(*found, F.count_if(ext == ".py").alias("py"), F.count_if(ext.isin(".ts", ".tsx")).alias("ts"))
    word: Column = F.when(F.col("py") > F.col("ts"), "python").when(F.col("ts") > F.col("py"), "typescript").otherwise("go")
    for lang, _ in reversed(MARKERS):
        word = F.when(F.col(lang), lang).otherwise(word)
    return one.select(word.alias("language"))


def n_sources(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.lower("ext").isin(*SOURCES)).alias("n"))


def python_root(files: DataFrame) -> DataFrame:
    """One row: src if a package lies anywhere below it, else the top."""
    inside = (F.col("name") == "__init__.py") & F.col("path").startswith("src/")
    return files.agg(F.when(F.coalesce(F.bool_or(inside), F.lit(False)), "src").otherwise(".").alias("root"))


def typescript_root(files: DataFrame, levels: int = 2) -> DataFrame:
    """One row: the nearest directory with a manifest, at most levels deep and first by name; hidden and installed ones don't count."""
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == ".", 0).otherwise(F.size(parts))
    open_ = ~F.exists(parts, lambda p: (p.startswith(".") & (p != ".")) | (p == "node_modules"))
    rows = files.where(F.col("name").isin("package.json", "tsconfig.json") & open_ & (depth <= levels))
    return rows.agg(F.min(F.struct(depth.alias("depth"), "dir"))["dir"].alias("root"))


def pruned_folders(files: DataFrame) -> DataFrame:
    """Folders of a pruned name that hold sources, outermost only: one row (folders), sorted, "" if none.

    files must come from an unpruned scan.
    """
    parts = F.split("dir", "/")
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(p.isin(*PRUNED), i)), lambda i: i.isNotNull()))
    held = files.where(F.lower("ext").isin(*SOURCES)).select(F.array_join(F.slice(parts, F.lit(1), at + 1), "/").alias("folder")).where("folder is not null")
    return held.agg(F.array_join(F.array_sort(F.collect_set("folder")), ", ").alias("folders"))


def module_path(files: DataFrame) -> DataFrame:
    """The module line of the top go.mod."""
    top = files.where("dir = '.' and name = 'go.mod'")
    return top.select(F.regexp_extract("text", r"(?m)^module[ \t]+\"?([^\s\"]+)", 1).alias("module_path"))


def manifest_name(files: DataFrame, base: str) -> DataFrame:
    """The project's name by pyproject.toml ([project] or [tool.poetry]) or package.json, else base."""
    section = r"(?ms)^\[(?:project|tool\.poetry)\][^\n]*\n(?:(?!\[)[^\n]*\n)*?name = [\"']([^\"'\n]+)[\"']"
    top = files.where("dir = '.'")
    py = F.nullif(F.regexp_extract("text", section, 1), F.lit(""))
    js = F.nullif(F.get_json_object("text", "$.name"), F.lit(""))
    one = top.agg(F.max(F.when(F.col("name") == "pyproject.toml", py)).alias("py"), F.max(F.when(F.col("name") == "package.json", js)).alias("js"))
    return one.select(F.coalesce("py", "js", F.lit(base)).alias("name"))
