"""Files beside code: diagrams, document kinds, ignore rules, commit logs."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lists import filled_down

# Suffixes of the files from which concepts are taken.
CONCEPTS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "svg": "svg"}
_GLOB = "*?["


def concept_kind(path: Column) -> Column:
    """Which document source reads a file, null for none."""
    pairs = [F.lit(x) for k, v in CONCEPTS.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))


def svg_labels(files: DataFrame) -> DataFrame:
    """path, place, label: the text elements of a diagram without inner tags; empty ones are left out."""
    inner = F.regexp_extract_all("content", F.lit(r"(?s)<text[^>]*>(.*?)</text>"), 1)
    d = files.select("path", F.posexplode(inner).alias("place", "raw")).withColumn("label", F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", ""), r"^\s+|\s+$", "")))
    return d.filter("label <> ''").select("path", "place", "label")


def svg_graph_rows(files: DataFrame) -> DataFrame:
    """src, dst, kind, conf_class, score: a diagram illustrates the concepts that its labels name."""
    return svg_labels(files).select(F.concat(F.lit("diagram::"), "path").alias("src"), F.concat(F.lit("concept::"), "label").alias("dst"), F.lit("illustrates").alias("kind"), F.lit("inferred").alias("conf_class"), F.lit(0.7).alias("score")).distinct()


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression of the whole string; a star also matches slashes."""
    return "(?s)^" + fnmatch.translate(pattern).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"


def _matcher(regex: str):
    return lambda part: part.rlike(regex)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore rules leave a path out: the last rule that matches counts, ``!`` takes a path back in.

    A rule without wildcards matches a path, what is below it, and any part of that name; one with wildcards
    matches the path, what is below, and, if it has no slash, any part.
    """
    out = F.lit(False)
    parts = F.split(path, "/")
    for raw in patterns:
        rule = raw.removeprefix("!").strip("/")
        if not rule:
            continue
        if any(c in _GLOB for c in rule):
            hit = path.rlike(_glob(rule)) | path.rlike(_glob(rule + "/**"))
            if "/" not in rule:
                hit = hit | F.exists(parts, _matcher(_glob(rule)))
        else:
            hit = (path == rule) | F.startswith(path, F.lit(rule + "/")) | F.array_contains(parts, rule)
        out = F.when(hit, not raw.startswith("!")).otherwise(out)
    return out


def commit_rows(log: DataFrame) -> DataFrame:
    """commit, author, at, path: changed files of log entries (line, text), as ``--name-only`` prints them.

    A line ``commit <hash>|<author>|<time>`` opens an entry; lines until the next one are its paths. A log of any length lies in many tasks.
    """
    head = F.regexp_extract("text", r"^commit ([0-9a-f]+)\|", 1)
    filled = filled_down(log.select("source", "line", "text"), "source", F.col("line").asc(), F.when(head != "", F.col("text")), name="entry")
    d = filled.filter("text <> '' AND entry IS NOT NULL AND text <> entry")
    part = lambda i: F.element_at(F.split("entry", r"\|"), i)
    return d.select(F.regexp_extract("entry", r"^commit ([0-9a-f]+)\|", 1).alias("commit"), part(2).alias("author"), part(3).cast("long").alias("at"), F.col("text").alias("path"))
