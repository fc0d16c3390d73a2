"""Import paths that a configuration file shortens: ``@lib/x`` becomes the file it stands for.

The configuration that counts lies in the nearest folder at or above the importing file; its patterns map a module name, with one ``*`` at most, to a path. Folders
above a file and beginnings of a module name are exploded, so files meet configurations and names meet patterns by equality; what a pattern may stand for
(the path as it is, with each known ending, an index file in a folder of that name) meets the table of files by equality too.
Configurations are JSON with comments, read in the JVM.

Defined cases: the first pattern in its file's order that leads to a file wins; a configuration that is not JSON hides those above it; null names, paths and contents give
nothing; repeated rows give one result; names of known package scopes are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.editing import rename_nodes
from tessera.sources.adapters import Graph

# Endings that are tried, configuration files by precedence, scopes that are packages.
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs", ".cjs"]
CONFIGS = ["tsconfig.json", "tsconfig.app.json", "tsconfig.node.json"]
PACKAGES = ["@types", "@angular", "@ionic", "@nx", "@nrwl", "@babel", "@testing-library", "@storybook", "@mui", "@next", "@vue", "@sveltejs", "@remix-run", "@emotion", "@radix-ui", "@tanstack", "@headlessui", "@chakra-ui"]

_LAST = 1 << 20


def without_comments(text: Column) -> Column:
    """JSON without ``//`` and ``/* */`` comments; what looks like one in a string stays."""
    return F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)', "$1")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def tidy(path: Column) -> Column:
    """A path without empty parts, ``.`` and, where there is a folder to leave, ``..``."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when((p == "..") & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) == ".."), F.concat(done, F.array(p))).otherwise(up(done, p))), "/")


def is_alias(name: Column) -> Column:
    package = F.lit(False)
    for p in PACKAGES:
        package = package | (name == p) | name.startswith(p + "/")
    return name.rlike("^[@~#]") & ~package


def _above(path: Column) -> Column:
    """All folders that hold a path, deepest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest_configs(files: DataFrame, configs: DataFrame) -> DataFrame:
    """uri, config: the configuration (path) that counts for each file (uri)."""
    order = F.array_position(F.array(*map(F.lit, CONFIGS)), F.regexp_extract("path", r"([^/]+)$", 1))
    known = configs.select(folder(F.col("path")).alias("dir"), F.col("path").alias("config"), order.alias("order")).filter("order > 0").distinct()
    above = files.select("uri").filter("uri IS NOT NULL").distinct().select("uri", F.posexplode(_above(F.col("uri"))).alias("depth", "dir"))
    best = above.join(known, "dir").groupBy("uri").agg(F.min(F.struct((-F.col("depth")).alias("d"), "order", "config")).alias("b"))
    return best.select("uri", "b.config")


def patterns(configs: DataFrame) -> DataFrame:
    """config, base, place, pattern, target: the patterns of each configuration (path, content) in order; one row without a pattern for each base of its own."""
    schema = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"
    options = F.from_json(without_comments(F.col("content")), schema)["compilerOptions"]
    c = configs.select("path", "content").distinct().select(F.col("path").alias("config"), folder(F.col("path")).alias("dir"), options.alias("o"))
    c = c.select("config", F.concat_ws("/", "dir", "o.baseUrl").alias("base"), F.col("o.baseUrl").isNotNull().alias("own"), F.col("o.paths").alias("paths"))
    listed = c.select("config", "base", F.posexplode(F.map_entries("paths")).alias("place", "e")).select("config", "base", "place", F.col("e.key").alias("pattern"), F.get("e.value", F.lit(0)).alias("target"))
    own = c.filter("own").select("config", "base", F.lit(_LAST).alias("place"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("target"))
    return listed.filter("target IS NOT NULL").unionByName(own)


def alias_targets(imports: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """module, uri, target, reason for each alias import (module, uri) out of a file: the file it stands for, or why there is none.

    ``configs``: path, content; ``files``: path of every file. Reasons are resolved, no_config and not_found.
    """
    asked = imports.select("module", "uri").filter(is_alias(F.col("module"))).distinct()
    held = asked.join(nearest_configs(asked, configs), "uri", "left")
    rules = patterns(configs)
    star = F.instr("pattern", "*")
    rules = rules.withColumn("begin", F.when(star > 0, F.expr("left(pattern, instr(pattern, '*') - 1)")).otherwise(F.col("pattern"))).withColumn("rest", F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")))
    name = F.col("module")
    begins = F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.left(name, n))
    tried = held.filter("config IS NOT NULL").select("module", "uri", "config", F.explode(begins).alias("begin"))
    met = tried.join(rules.filter("pattern IS NOT NULL"), ["config", "begin"])
    exact = name == F.col("pattern")
    fits = exact | (F.col("rest").isNotNull() & name.endswith(F.col("rest")))
    middle = F.expr("substring(module, length(begin) + 1, greatest(length(module) - length(begin) - length(rest), 0))")
    path = F.when(exact, F.col("target")).otherwise(F.replace("target", F.lit("*"), middle))
    listed = met.filter(fits).select("module", "uri", "place", F.concat_ws("/", "base", path).alias("path"))
    bare = held.filter(name.startswith("@")).join(rules.filter("pattern IS NULL").select("config", "base", "place"), "config").select("module", "uri", "place", F.concat_ws("/", "base", name).alias("path"))
    candidates = listed.unionByName(bare).withColumn("path", tidy(F.col("path")))
    stem = F.regexp_replace("path", r"(?<=[^/])\.[^./]+$", "")
    tries = F.array(F.col("path"), *(F.concat(stem, F.lit(e)) for e in ENDINGS), *(F.concat("path", F.lit(f"/index{e}")) for e in ENDINGS))
    there = candidates.select("module", "uri", "place", F.posexplode(tries).alias("nth", "path")).join(files.select("path").distinct(), "path")
    best = there.groupBy("module", "uri").agg(F.min(F.struct("place", "nth", "path")).alias("b")).select("module", "uri", F.col("b.path").alias("target"))
    reason = F.when(F.col("target").isNotNull(), "resolved").when(F.col("config").isNull(), "no_config").otherwise("not_found")
    return held.join(best, ["module", "uri"], "left").select("module", "uri", "target", reason.alias("reason"))


def resolve_aliases(g: Graph, configs: DataFrame, files: DataFrame) -> Graph:
    """Module nodes that stand for a file get its name; the first edge into a module decides, nodes of one file become one."""
    module = g.nodes.filter("kind = 'module' AND qualified_name LIKE 'module::%'").select(F.col("id").alias("dst"), F.expr("substring(qualified_name, 9)").alias("module"))
    importer = g.nodes.filter("source_uri IS NOT NULL").select(F.col("id").alias("src"), F.col("source_uri").alias("uri"))
    first = g.edges.join(module, "dst").join(importer, "src").groupBy("dst", "module").agg(F.min_by("uri", "id").alias("uri"))
    found = first.join(alias_targets(first, configs, files).filter("target IS NOT NULL"), ["module", "uri"])
    last = F.regexp_extract("target", r"([^/]+)$", 1)
    named = found.select(F.col("dst").alias("id"), F.concat(F.lit("file::"), "target").alias("new_qname"), F.regexp_replace(last, r"(?<=.)\.[^.]+$", "").alias("new_name"))
    out = rename_nodes(g, named)
    nodes = out.nodes.join(named.select("id", "new_name"), "id", "left").withColumn("name", F.coalesce("new_name", "name"))
    return Graph(nodes.select(g.nodes.columns), out.edges)
