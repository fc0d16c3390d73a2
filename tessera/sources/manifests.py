"""Package manifests: package.json with JSON functions, TOML manifests in Arrow batches; one row a dependency."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.adapters import Graph

DEPENDENCIES = "path string, package string, section string, dependency string, version string"
# The sections that hold dependencies.
JSON_SECTIONS = ["dependencies", "devDependencies", "peerDependencies"]
CARGO_SECTIONS = ["dependencies", "dev-dependencies", "build-dependencies"]


def split_requirement(requirement: Column) -> Column:
    """Struct (name, version) of a Python requirement: markers and extras go, version is null without an operator."""
    bare = F.regexp_replace(F.trim(F.substring_index(requirement, ";", 1)), r"^([^><=!~\[]*)\[[^\]]*\]", "$1")
    version = F.trim(F.regexp_extract(bare, r"^[^><=!~]*(.*)$", 1))
    return F.struct(F.trim(F.regexp_extract(bare, r"^([^><=!~]*)", 1)).alias("name"), F.when(version != "", version).alias("version"))


def package_json(files: DataFrame) -> DataFrame:
    """Dependencies of (path, content); files without a name, or that are not JSON, give nothing."""
    schema = "name string, " + ", ".join(f"`{s}` map<string,string>" for s in JSON_SECTIONS)
    d = files.select("path", F.from_json("content", schema).alias("j")).filter("j.name IS NOT NULL AND j.name <> ''")
    sections = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.col(f"j.{s}").alias("deps")) for s in JSON_SECTIONS))).alias("s")
    return d.select("path", F.col("j.name").alias("package"), sections).select("path", "package", "s.section", F.explode("s.deps").alias("dependency", "version"))


def _version(value) -> str | None:
    if isinstance(value, dict):
        value = value.get("version")
    return str(value) if isinstance(value, (str, int, float)) else None


def _pyproject(data: dict) -> tuple[str | None, list[tuple[str, str, str | None]]]:
    """Package name, and (section, requirement or name, version; None where the requirement holds it)."""
    project, poetry = data.get("project") or {}, (data.get("tool") or {}).get("poetry") or {}
    found = [("project", r, None) for r in project.get("dependencies") or [] if isinstance(r, str)]
    found += [(f"optional:{k}", r, None) for k, rs in (project.get("optional-dependencies") or {}).items() for r in rs]
    found += [("poetry", k, _version(v) or "") for k, v in (poetry.get("dependencies") or {}).items() if k != "python"]
    return project.get("name") or poetry.get("name"), found


def _cargo(data: dict) -> tuple[str | None, list[tuple[str, str, str | None]]]:
    return (data.get("package") or {}).get("name"), [(s, k, _version(v) or "") for s in CARGO_SECTIONS for k, v in (data.get(s) or {}).items()]


def toml_manifests(files: DataFrame) -> DataFrame:
    """Dependencies of pyproject.toml and Cargo.toml files (path, content); what doesn't parse gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"]):
                try:
                    data = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                name, found = (_cargo if path.rsplit("/", 1)[-1] == "Cargo.toml" else _pyproject)(data)
                rows += [(path, name, s, d, v) for s, d, v in found if name]
            yield pd.DataFrame(rows, columns=["path", "package", "section", "requirement", "given"])

    raw = files.select("path", "content").mapInPandas(run, "path string, package string, section string, requirement string, given string")
    split = split_requirement(F.col("requirement"))
    # A given version, even an empty one, comes from a table; otherwise the requirement is split.
    return raw.select("path", "package", "section", F.when(F.col("given").isNull(), split["name"]).otherwise(F.col("requirement")).alias("dependency"), F.when(F.col("given").isNull(), split["version"]).when(F.col("given") != "", F.col("given")).alias("version"))


def manifest_rows(files: DataFrame) -> DataFrame:
    """Dependencies of every manifest among ``files``, by file name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return package_json(files.filter(name == "package.json")).unionByName(toml_manifests(files.filter(name.isin("pyproject.toml", "Cargo.toml"))))


def manifest_graph(files: DataFrame) -> Graph:
    """Files with the package that they define, packages, and depends_on edges; ids are hashes of the names."""
    d = manifest_rows(files)
    own = d.select("path", "package").distinct()
    package = own.select(F.col("package").alias("name")).unionByName(d.select(F.col("dependency").alias("name"))).distinct()
    nodes = package.select(F.lit("package").alias("kind"), "name", F.concat(F.lit("package::"), "name").alias("qualified_name"), F.lit(None).cast("string").alias("source_uri"))
    nodes = nodes.unionByName(own.select(F.lit("file").alias("kind"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.concat(F.lit("file::"), "path").alias("qualified_name"), F.col("path").alias("source_uri")).distinct())
    link = lambda src, dst, kind: F.struct(F.xxhash64(src, dst, F.lit(kind)).alias("id"), F.xxhash64(src).alias("src"), F.xxhash64(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit("extracted").alias("conf_class"), F.lit(1.0).alias("confidence"))
    named = lambda c: F.concat(F.lit("package::"), c)
    edges = own.select(link(F.concat(F.lit("file::"), "path"), named("package"), "defines").alias("e")).unionByName(d.select(link(named("package"), named("dependency"), "depends_on").alias("e"))).select("e.*").distinct()
    return Graph(nodes.withColumn("id", F.xxhash64("qualified_name")), edges)
