"""Parquet store of a graph: full and incremental save, resolution that follows changes, snapshots, archive, file state, text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import resolution
from tessera.runtime import materialise, path_exists
from tessera.sources.adapters import Graph
from tessera.sources.delta import DeltaTables, Piece

#: Tables and the columns that their buckets are cut by. ``incoming`` and ``names`` find edges by their target and nodes by their name; with
#: resolution, ``calls`` are the edges into placeholders by the name they ask for, ``resolved`` what was found for them.
_KEYS = {"nodes": "source_uri", "edges": "src", "incoming": "dst", "names": "name", "files": "path", "calls": "name", "resolved": "name"}
_CALLED = {"call::": ["calls"], "type::": ["inherits", "implements"]}
_TYPES = ["class", "trait", "type"]


class Store:
    """A graph in :class:`DeltaTables` under one folder; one writer at a time, and readers never see half a change.

    With ``resolve`` the graph is kept as it was extracted, beside what its placeholders stand for; :meth:`load` puts them together. A change
    resolves again only the names whose definitions, callers or direct uses it touched, and reads only their buckets.
    """

    def __init__(self, spark: SparkSession, root: str, *, resolve: bool = False) -> None:
        self.spark, self.root, self.resolve = spark, root.rstrip("/"), resolve
        self.tables = DeltaTables(spark, self.root, _KEYS)

    def version(self) -> int:
        """The last saved version, 0 if nothing is saved; a folder that can't be read is an error."""
        return self.tables.version()

    def save(self, g: Graph, files: DataFrame | None = None) -> int:
        """Write the whole graph (and the files' hashes: path, hash) as a new version."""
        v, t = self.version() + 1, self.tables
        pieces = t.stage("nodes", g.nodes, v, base=True) + t.stage("edges", g.edges, v, base=True)
        if files is not None:
            pieces += t.stage("files", files.select(F.col("path").alias("id"), "path", "hash"), v, base=True)
        if self.resolve:
            pieces += self._index(pieces, v)
            calls = self._calls(t.read("nodes", pieces=pieces), t.read("edges", pieces=pieces))
            pieces += t.stage("calls", calls, v, base=True)
            pieces += t.stage("resolved", self._resolved(pieces, None), v, base=True)
        return t.commit(pieces)

    def _index(self, pieces: list[Piece], version: int) -> list[Piece]:
        """The tables that find edges and nodes for a change; made when the first change comes."""
        if any(p.table == "incoming" for p in pieces):
            return []
        t = self.tables
        return t.stage("incoming", _incoming(t.read("edges", pieces=pieces)), version, base=True) + t.stage("names", _names(t.read("nodes", pieces=pieces)), version, base=True)

    def load(self, version: int | None = None, *, raw: bool = False) -> Graph:
        """The graph of a version; with ``raw``, placeholders are left unresolved."""
        pieces = self.tables.pieces(version)
        g = Graph(self.tables.read("nodes", pieces=pieces), self.tables.read("edges", pieces=pieces))
        if not self.resolve or raw:
            return g
        found = self.tables.read("resolved", pieces=pieces)
        for prefix in _CALLED:
            g = resolution.apply_resolution(g, found.filter(F.col("prefix") == prefix).select(F.col("id").alias("edge_id"), "target", "conf_class"), prefix)
        return g

    def resolved(self) -> DataFrame:
        """edge_id, name, target, tier, conf_class of the present version."""
        return self.tables.read("resolved").select(F.col("id").alias("edge_id"), "prefix", "name", "target", "tier", "conf_class")

    def file_state(self) -> DataFrame:
        return self.tables.read("files").select("path", "hash")

    def update(self, changed: Graph, touched: DataFrame, files: DataFrame) -> int:
        """Replace what belongs to the touched paths (path) with ``changed`` and save the result.

        Edges out of a replaced node go; those into it stay if the new rows hold that node again. An edge of ``changed`` replaces one of its
        id and starts at a node of ``changed``; a node without a file goes with the last edge into it. ``files`` tells the hashes of the touched paths that are still there.
        """
        v, t = self.version() + 1, self.tables
        pieces = t.pieces()
        pieces += self._index(pieces, v)
        read = lambda table, keys, column: t.read(table, pieces=pieces, buckets=t.buckets(keys, column))
        paths = materialise(touched.select(F.col("path").alias("source_uri")).distinct(), "touched")
        nodes = materialise(changed.nodes, "changed-nodes")
        edges = materialise(changed.edges.dropDuplicates(["id"]), "changed-edges")
        gone = materialise(read("nodes", paths, "source_uri").join(paths, "source_uri", "left_semi").select("id", "name", "qualified_name", "kind", "source_uri"), "gone")
        there = read("names", nodes, "name").join(gone.select("id"), "id", "left_anti").select("qualified_name")
        new = materialise(nodes.join(there, "qualified_name", "left_anti"), "new-nodes")
        lost = gone.join(nodes.select("id"), "id", "left_anti").select("id")
        columns = ["id", "dst", "kind"]
        out = read("edges", gone, "id").join(gone.select(F.col("id").alias("src")), "src", "left_semi").select(columns)
        into = read("incoming", lost, "id").join(lost.withColumnRenamed("id", "dst"), "dst", "left_semi").select(columns)
        dead = materialise(out.unionByName(into).unionByName(edges.select(columns)).distinct(), "dead-edges")
        left = dead.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
        still = read("incoming", left, "id").join(dead.select("id"), "id", "left_anti").select(F.col("dst").alias("id"))
        unused = left.join(still, "id", "left_anti")
        # Nodes without a file lie in the bucket of their id.
        orphans = read("nodes", unused, "id").filter("source_uri IS NULL").join(unused, "id", "left_semi").select("id", "name", "qualified_name", "kind", "source_uri")
        gone_too = materialise(gone.unionByName(orphans), "gone-nodes")

        staged = list(pieces)
        for table, rows, ids in (("nodes", new, gone_too), ("names", _names(new), gone_too), ("edges", edges, dead), ("incoming", _incoming(edges), dead)):
            staged += t.stage_dead(table, ids, v) + t.stage(table, self._like(pieces, table, rows), v)
        if any(p.table == "files" for p in pieces):
            known = paths.select(F.col("source_uri").alias("id"))
            hashes = files.select(F.col("path").alias("id"), "path", "hash").join(known, "id", "left_semi")
            staged += t.stage_dead("files", known, v) + t.stage("files", hashes, v)
        if self.resolve:
            staged = self._follow(pieces, staged, gone_too, new, dead, edges, v)
        for table in _KEYS:
            if any(p.table == table for p in staged):
                staged = t.compact(staged, table, v)
        return t.commit(staged)

    def _like(self, pieces: list[Piece], table: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns of a stored table, in its order."""
        return rows.select(self.tables.read(table, pieces=pieces).columns)

    # --- resolution ---

    @staticmethod
    def _calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
        found = None
        for prefix, kinds in _CALLED.items():
            part = resolution.placeholder_calls(Graph(nodes, edges), prefix, kinds).withColumn("prefix", F.lit(prefix))
            found = part if found is None else found.unionByName(part)
        return found.select(F.col("edge_id").alias("id"), "prefix", "name", "src_qname", "src_uri")

    def _resolved(self, pieces: list[Piece], names: DataFrame | None) -> DataFrame:
        """What the placeholder edges stand for, of all names or of ``names``; only the buckets of these are read."""
        t = self.tables
        some = lambda table: t.read(table, pieces=pieces) if names is None else t.read(table, pieces=pieces, buckets=t.buckets(names, "name")).join(names, "name", "left_semi")
        calls, known = some("calls"), some("names")
        defs = resolution.definitions(known, resolution.CALLABLE)
        at = None if names is None else t.buckets(defs, "target")
        uses = t.read("incoming", pieces=pieces, buckets=at).filter("kind = 'calls'").groupBy(F.col("dst").alias("target")).agg(F.count(F.lit(1)).alias("uses"))
        asked = calls.filter((F.col("prefix") == "call::") & ~resolution.suppressed(F.col("name"))).select(F.col("id").alias("edge_id"), "name", "src_qname", "src_uri")
        found = resolution.resolve_named(asked, defs, uses).withColumn("prefix", F.lit("call::"))
        kinds = calls.filter("prefix = 'type::'").select(F.col("id").alias("edge_id"), "name")
        types = kinds.join(resolution.only(resolution.definitions(known, _TYPES), ["name"], "target"), "name")
        types = types.select("edge_id", "name", "target", F.lit(1).alias("tier"), F.lit("extracted").alias("conf_class"), F.lit("type::").alias("prefix"))
        return found.unionByName(types).select(F.col("edge_id").alias("id"), "prefix", "name", "target", "tier", "conf_class")

    def _follow(self, before: list[Piece], staged: list[Piece], gone: DataFrame, new: DataFrame, dead: DataFrame, edges: DataFrame, version: int) -> list[Piece]:
        """``staged`` with calls brought up to date and the touched names resolved again."""
        t = self.tables
        placeholders = edges.select(F.col("dst").alias("id")).distinct()
        ends = t.read("names", pieces=staged).join(placeholders, "id", "left_semi").select("id", "qualified_name", F.lit(None).cast("string").alias("source_uri"))
        own = new.select("id", "qualified_name", "source_uri")
        calls = materialise(self._calls(own.unionByName(ends.join(own.select("id"), "id", "left_anti")), edges), "new-calls")
        old = t.read("calls", pieces=before).join(dead.select("id"), "id", "left_semi").select("name")
        direct = dead.filter("kind = 'calls'").select(F.col("dst").alias("id")).unionByName(edges.filter("kind = 'calls'").select(F.col("dst").alias("id"))).distinct()
        used = t.read("names", pieces=staged).filter(~F.col("qualified_name").startswith("call::")).join(direct, "id", "left_semi").select("name")
        names = gone.select("name").unionByName(new.select("name")).unionByName(calls.select("name")).unionByName(old).unionByName(used)
        names = materialise(names.filter("name IS NOT NULL").distinct(), "touched-names")
        staged = staged + t.stage_dead("calls", dead.select("id"), version) + t.stage("calls", calls, version)
        past = t.read("resolved", pieces=before, buckets=t.buckets(names, "name")).join(names, "name", "left_semi").select("id")
        return staged + t.stage_dead("resolved", past, version) + t.stage("resolved", self._resolved(staged, names), version)

    # --- snapshots, embeddings, archive ---

    def snapshot(self, label: str) -> None:
        g = self.load()
        g.nodes.withColumn("label", F.lit(label)).write.mode("append").partitionBy("label").parquet(f"{self.root}/snapshots/nodes")
        g.edges.withColumn("label", F.lit(label)).write.mode("append").partitionBy("label").parquet(f"{self.root}/snapshots/edges")

    def snapshots(self) -> DataFrame:
        """label, nodes: the stored snapshots."""
        if not path_exists(self.spark, f"{self.root}/snapshots/nodes"):
            return self.spark.createDataFrame([], "label string, nodes long")
        return self.spark.read.parquet(f"{self.root}/snapshots/nodes").groupBy(F.col("label").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("nodes"))

    def save_embeddings(self, model: str, vectors: DataFrame) -> None:
        """Vectors (qualified_name, vector) of one model; a later save of a model replaces the earlier one."""
        vectors.select("qualified_name", F.col("vector").cast("array<double>").alias("vector")).write.mode("overwrite").parquet(f"{self.root}/embeddings/model={model}")

    def load_embeddings(self, model: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/embeddings/model={model}")

    def load_snapshot(self, label: str) -> Graph:
        at = lambda t: self.spark.read.parquet(f"{self.root}/snapshots/{t}").filter(F.col("label") == label).drop("label")
        return Graph(at("nodes"), at("edges"))

    def archive(self, nodes: DataFrame, valid_to: str) -> None:
        """Append closed nodes; one without a beginning began when it ended."""
        _closed(nodes, valid_to).write.mode("append").parquet(f"{self.root}/node_versions")

    def archive_edges(self, edges: DataFrame, nodes: DataFrame, valid_to: str) -> None:
        """Append closed edges under the qualified names of their ends (``nodes``: id, qualified_name); ids may change, names stay."""
        name = lambda end: nodes.select(F.col("id").alias(end), F.col("qualified_name").alias(f"{end}_qname"))
        named = edges.join(name("src"), "src").join(name("dst"), "dst")
        _closed(named, valid_to).select("id", "src_qname", "dst_qname", "kind", "conf_class", "confidence", "valid_from", "valid_to").write.mode("append").parquet(f"{self.root}/edge_versions")

    def temporal_nodes(self) -> DataFrame:
        """Active and archived rows, the active one first per qualified name."""
        active = self.load().nodes
        old = self.spark.read.parquet(f"{self.root}/node_versions").select(active.columns)
        return _first(active.withColumn("turn", F.lit(0)).unionByName(old.withColumn("turn", F.lit(1))), ["qualified_name"])

    def temporal_edges(self) -> DataFrame:
        """src_qname, dst_qname, kind, conf_class, valid_from, valid_to of active and archived edges, one for each pair of names and kind, the active one first."""
        g = self.load()
        name = lambda end: g.nodes.select(F.col("id").alias(end), F.col("qualified_name").alias(f"{end}_qname"))
        dated = g.edges.select("*", *(F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_to") if c not in g.edges.columns))
        columns = ["id", "src_qname", "dst_qname", "kind", "conf_class", "valid_from", "valid_to"]
        active = dated.join(name("src"), "src").join(name("dst"), "dst").select(*columns, F.lit(0).alias("turn"))
        old = self.spark.read.parquet(f"{self.root}/edge_versions").select(*columns, F.lit(1).alias("turn"))
        return _first(active.unionByName(old), ["src_qname", "dst_qname", "kind"]).drop("id")


def _closed(rows: DataFrame, valid_to: str) -> DataFrame:
    began = F.col("valid_from") if "valid_from" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("valid_to", F.lit(valid_to)).withColumn("valid_from", F.coalesce(began, F.lit(valid_to)))


def _first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the active row (turn 0), else the archived one that ended last."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", F.desc("valid_to"), "id"))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("turn", "rank")


def _incoming(edges: DataFrame) -> DataFrame:
    return edges.select("id", "dst", "kind")


def _names(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "name", "qualified_name", "kind", "source_uri")


def graphml_rows(g: Graph) -> DataFrame:
    """One line of GraphML a node or edge, between header and footer rows; ``part`` orders them."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    n = g.nodes.select(F.lit(1).alias("part"), F.col("id"), F.format_string('<node id="n%d"><data key="kind">%s</data><data key="qname">%s</data></node>', "id", "kind", esc(F.col("qualified_name"))).alias("line"))
    e = g.edges.select(F.lit(2).alias("part"), F.col("id"), F.format_string('<edge source="n%d" target="n%d"><data key="kind">%s</data></edge>', "src", "dst", "kind").alias("line"))
    ends = g.nodes.sparkSession.createDataFrame([(0, 0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, 0, "</graph></graphml>")], "part int, id long, line string")
    return ends.unionByName(n).unionByName(e)


def cypher_rows(g: Graph) -> DataFrame:
    """MERGE statements for nodes, then edges."""
    q = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", r"\\\\"), "'", r"\\'")
    n = g.nodes.select(F.lit(1).alias("part"), F.col("id"), F.format_string("MERGE (n:%s {id: %d}) SET n.qname = '%s';", F.initcap("kind"), "id", q(F.col("qualified_name"))).alias("line"))
    e = g.edges.select(F.lit(2).alias("part"), F.col("id"), F.format_string("MATCH (a {id: %d}), (b {id: %d}) MERGE (a)-[:%s]->(b);", "src", "dst", F.upper("kind")).alias("line"))
    return n.unionByName(e)


def wiki_pages(g: Graph, communities: DataFrame, *, members: int = 20) -> DataFrame:
    """community, page: Markdown with size and first members by id of each community."""
    m = communities.join(g.nodes.select("id", "qualified_name", "kind"), "id")
    rank = F.row_number().over(Window.partitionBy("community").orderBy("id"))
    ranked = m.withColumn("rank", rank)
    lines = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= members, F.struct("rank", "qualified_name", "kind")))), lambda x: F.concat(F.lit("- `"), x["qualified_name"], F.lit("` ("), x["kind"], F.lit(")")))
    return ranked.groupBy("community").agg(F.count(F.lit(1)).alias("size"), lines.alias("lines")).select("community", F.concat(F.lit("# Community "), F.col("community").cast("string"), F.lit("\n\n"), F.col("size").cast("string"), F.lit(" members\n\n"), F.array_join("lines", "\n")).alias("page"))


def write_lines(rows: DataFrame, path: str) -> None:
    """Lines in order of (part, id) as text files, whose order is that of their names."""
    rows.orderBy("part", "id").select("line").write.mode("overwrite").text(path)
