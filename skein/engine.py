"""The query interface over one graph: each method gives a DataFrame (or text where it renders)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import render
from .bundle import GraphBundle
from .functions.storage import cut
from .operators import binaries, candidates, diffing, entrypoints, exports, findings, imports, lookup, metrics, overlay, preanalysis, prefixes, scopes, traverse, valueflow, views, visibility
from .schema import ANNOTATION_KINDS, checked_kinds
from .sources import ingest, literals, reports


class QueryEngine:
    """Names are resolved by :mod:`skein.operators.lookup`; one that nothing answers to gives an empty result.

    Methods that change the graph replace ``graph`` by a new bundle; a failed one leaves it as it was.
    """

    def __init__(self, graph: GraphBundle):
        self.graph, self.spark = graph, graph.spark

    # -- building ---------------------------------------------------------

    @classmethod
    def from_directory(cls, spark: SparkSession, path: str, language=None, detect: bool = True, overrides: str | None = None, pyproject: str | None = None, links: str | None = None, **options) -> QueryEngine:
        graph = ingest.parse_directory(spark, path, language, **options)
        if links:
            graph = imports.link(graph, reports.declared_links(spark, links))
        if not detect:
            return cls(graph)
        if overrides is None and pyproject is None and "://" not in path:
            overrides, pyproject = entrypoints.configuration(path)
        engine = cls(entrypoints.detect(graph, overrides, pyproject))
        engine.discover_candidates(path)
        return engine

    def discover_candidates(self, path: str) -> None:
        """Evidence from the declarative files of a tree whose literals name code; no node is tagged."""
        rows = literals.literal_table(literals.declarative_files(self.spark, path))
        self.graph = candidates.discover(self.graph, rows)

    @classmethod
    def from_graph(cls, graph: GraphBundle) -> QueryEngine:
        """Proxies are made; entrypoints are not detected."""
        from .operators.linking import materialise_proxies

        return cls(materialise_proxies(graph))

    def diff_against(self, before: QueryEngine) -> dict[str, DataFrame]:
        a, b = before.graph, self.graph
        return {"source_coverage": diffing.coverage(a, b), "summary": diffing.summaries(a, b), "nodes": diffing.nodes(a, b), "edges": diffing.edges(a.edges, b.edges), "entrypoints": diffing.entrypoints(a.entrypoints, b.entrypoints)}

    # -- lookup -----------------------------------------------------------

    def find(self, name: str) -> str | None:
        row = lookup.resolve(self.graph.nodes, name).select("id").first()
        return row["id"] if row else None

    def _near(self, name: str, kind: str, forward: bool) -> DataFrame:
        return views.neighbours(self.graph, self.find(name) or "", kind, forward).orderBy("id")

    # -- one edge away ----------------------------------------------------

    def callers_of(self, name: str) -> DataFrame:
        return self._near(name, "calls", False)

    def callees_of(self, name: str) -> DataFrame:
        return self._near(name, "calls", True)

    def state_read_by(self, name: str) -> DataFrame:
        return self._near(name, "reads", True)

    def state_written_by(self, name: str) -> DataFrame:
        return self._near(name, "writes", True)

    def readers_of(self, name: str) -> DataFrame:
        return self._near(name, "reads", False)

    def writers_of(self, name: str) -> DataFrame:
        return self._near(name, "writes", False)

    # -- further ----------------------------------------------------------

    def _units(self, ids: DataFrame) -> DataFrame:
        return self.graph.nodes.join(ids.select(F.col("node").alias("id")), "id", "left_semi").orderBy("id")

    def ancestors_of(self, name: str, edge_kinds: Iterable[str] | None = None) -> DataFrame:
        return self._units(traverse.ancestors_of(views.projected(self.graph, edge_kinds), self.find(name) or ""))

    def reachable_from(self, name: str, edge_kinds: Iterable[str] | None = None) -> DataFrame:
        return self._units(traverse.reachable_from(views.projected(self.graph, edge_kinds), self.find(name) or ""))

    def paths_between(self, src: str, dst: str, max_depth: int = 20, edge_kinds: Iterable[str] | None = None) -> DataFrame:
        return traverse.paths_between(views.projected(self.graph, edge_kinds), self.find(src) or "", self.find(dst) or "", max_depth)

    def connect_subgraphs(self, a: str, b: str, max_depth: int = 20, edge_kinds: Iterable[str] | None = None) -> DataFrame:
        return traverse.connect(views.projected(self.graph, edge_kinds), self._members(a), self._members(b), max_depth)

    def entrypoint_paths_to(self, name: str, max_depth: int = 20) -> DataFrame:
        return traverse.entrypoint_paths(views.projected(self.graph), self.graph.entrypoints, self.find(name) or "", max_depth)

    # -- selections -------------------------------------------------------

    def nodes_with_annotation(self, kind: str) -> DataFrame:
        checked_kinds([kind], ANNOTATION_KINDS)
        return self.graph.nodes.join(self.graph.annotations.where(F.col("kind") == kind).select(F.col("node_id").alias("id")), "id", "left_semi")

    def functions_that_raise(self, exception: str) -> DataFrame:
        return self.graph.nodes.where(F.exists("exception_types", lambda t: t == exception))

    def exception_events(self, name: str) -> DataFrame:
        return self._one(name).select("id", F.explode("exception_events").alias("e")).select("id", "e.*")

    def exception_support(self) -> DataFrame:
        """(language, status, events): which exception events the frontend of each language of the graph finds; those without any are unverified."""
        from .sources.frontends import PYTHON_EVENTS
        from .sources.scanner import EXCEPTIONS, SCANNED_EVENTS

        known = {x: list(SCANNED_EVENTS) + (["declares"] if x == "java" else []) for x in EXCEPTIONS} | {"python": list(PYTHON_EVENTS)}
        rows = [(x, "partial" if x in known else "unverified", known.get(x, [])) for x in ingest.L.EXTENSIONS]
        return self.spark.createDataFrame(rows, "language string, status string, events array<string>").join(self.graph.nodes.select("language").distinct(), "language", "left_semi")

    def attack_surface(self) -> DataFrame:
        tags = self.graph.entrypoints.withColumnRenamed("kind", "entry_kind")
        return tags.join(GraphBundle.conform(self.graph.nodes, "nodes").select(F.col("id").alias("node_id"), "name", "kind", "file_path", "start_line"), "node_id", "left").orderBy("node_id")

    def complexity_hotspots(self, threshold: int = 10) -> DataFrame:
        return metrics.hotspots(self.graph.nodes, threshold)

    def generic_parameters(self, name: str) -> DataFrame:
        return self._one(name).select("id", F.posexplode("type_parameters").alias("ordinal", "p")).select("id", "ordinal", "p.*")

    def type_references(self, name: str) -> DataFrame:
        return self.graph.type_refs.where(F.col("node_id") == (self.find(name) or "")).orderBy("role", "ordinal", "path")

    def _one(self, name: str) -> DataFrame:
        return GraphBundle.conform(self.graph.nodes, "nodes").where(F.col("id") == (self.find(name) or ""))

    def parse_diagnostics(self) -> DataFrame:
        return self.graph.diagnostics

    def source_policy(self) -> DataFrame:
        return self.graph.source_files

    def source_file_counts(self) -> DataFrame:
        return self.graph.source_files.where("language is not null").groupBy("language").count()

    # -- annotations and findings -----------------------------------------

    def annotate(self, name: str, kind: str, description: str, source: str = "manual") -> bool:
        self.graph, done = findings.annotate(self.graph, self.find(name) or "", kind, description, source)
        return done

    def annotations_of(self, name: str, kind: str | None = None) -> DataFrame:
        own = self.graph.annotations.where(F.col("node_id") == (self.find(name) or ""))
        return (own if kind is None else own.where(F.col("kind") == kind)).orderBy("seq")

    def clear_annotations(self, name: str, kind: str | None = None) -> bool:
        self.graph, done = findings.clear(self.graph, self.find(name) or "", kind)
        return done

    def findings(self, kind: str | None = None) -> DataFrame:
        return findings.by_node(self.graph, kind)

    def augment_sarif(self, text: str, replace: bool = True, root: str = "") -> dict[str, int]:
        self.graph, counts = findings.imported(self.graph, reports.sarif(self.spark, text, root), "sarif", replace)
        return counts

    def augment_weaudit(self, text: str, replace: bool = True, root: str = "") -> dict[str, int]:
        self.graph, counts = findings.imported(self.graph, reports.weaudit(self.spark, text, root), "weaudit", replace)
        return counts

    # -- entrypoints ------------------------------------------------------

    def add_entrypoint_evidence(self, rows: DataFrame) -> None:
        rows = GraphBundle.conform(rows, "evidence")
        known = self.graph.nodes.select(F.col("id").alias("node_id"))
        if not rows.where("node_id is not null").join(known, "node_id", "left_anti").isEmpty():
            raise ValueError("evidence for an unknown node")
        self.graph = self.graph.having(evidence=GraphBundle.conform(self.graph.evidence, "evidence").unionByName(rows))

    def entrypoint_evidence(self, name: str | None = None) -> DataFrame:
        out = entrypoints.evidence(self.graph)
        return out if name is None else out.where(F.col("node_id") == (self.find(name) or ""))

    def entrypoint_candidates(self, name: str | None = None) -> DataFrame:
        out = entrypoints.candidates(self.graph)
        return out if name is None else out.where(F.col("node_id") == (self.find(name) or ""))

    # -- reports ----------------------------------------------------------

    def summary(self) -> DataFrame:
        return metrics.full_summary(self.graph)

    def unresolved_calls(self, name: str | None = None) -> DataFrame:
        out = views.unresolved_calls(self.graph)
        return (out if name is None else out.where(F.col("src") == (self.find(name) or ""))).orderBy("edge_seq")

    def call_resolution(self) -> tuple[DataFrame, DataFrame]:
        return metrics.call_resolution(self.graph), metrics.unresolved_by_callee(self.graph)

    def preanalysis(self, threshold: int = preanalysis.THRESHOLD, limit: int | None = None, block: int = preanalysis.BLOCK) -> None:
        self.graph = preanalysis.run(self.graph, threshold, limit, block)

    # -- subgraphs --------------------------------------------------------

    def _members(self, name: str) -> DataFrame:
        return self.graph.subgraphs.where(F.col("name") == name).select("node_id")

    def subgraph(self, name: str) -> DataFrame:
        return self.graph.nodes.join(self._members(name).withColumnRenamed("node_id", "id"), "id", "left_semi").orderBy("id")

    def subgraph_names(self) -> DataFrame:
        return self.graph.subgraphs.select("name").distinct().orderBy("name")

    def all_subgraphs(self) -> DataFrame:
        return self.graph.subgraphs.groupBy("name").agg(F.array_sort(F.collect_set("node_id")).alias("members"))

    def add_subgraph(self, name: str, ids: Iterable[str]) -> None:
        rows = self.spark.createDataFrame([(name, i) for i in ids], "name string, node_id string")
        missing = rows.join(self.graph.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").first()
        if missing:
            raise ValueError(f"unknown node {missing['node_id']}")
        self.graph = self.graph.having(subgraphs=self.graph.subgraphs.where(F.col("name") != name).unionByName(rows))

    def subgraph_edges(self, name: str, edge_kinds: Iterable[str] | None = None) -> DataFrame:
        return views.induced(self.graph.edges, self._members(name), edge_kinds)

    # -- names and modules ------------------------------------------------

    def look_up(self, names: DataFrame) -> DataFrame:
        """(ref_id, node_id, n, distance): ``names`` (ref_id, scope, name) by the nearest unit around ``scope`` that holds a node of the name."""
        contains = self.graph.edges.where("kind = 'contains'").select("src", "dst")
        declared = contains.join(self.graph.nodes.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("scope"), "name", F.col("dst").alias("id"))
        return scopes.lookup(names, scopes.tree(contains), declared)

    def visible_modules(self, name: str) -> DataFrame:
        """(module): what a module sees through its imports, itself included."""
        found = self.find(name)
        asked = self.graph.nodes.where(F.col("id") == F.lit(found)).select(F.col("id").alias("module"))
        imports_ = self.graph.edges.where("kind = 'imports'").select("src", "dst").join(self.graph.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        seen = visibility.sight(imports_.select("src", "dst"), asked)
        return seen.pairs.join(seen.member.withColumnRenamed("component", "target"), "target").select("module").distinct().orderBy("module")

    def exported(self, requests: DataFrame, aliases: DataFrame, stars: DataFrame) -> DataFrame:
        """(module, name, node_id, n): what exports (module, name) stand for; modules declare what they hold, and pass on ``aliases`` and ``stars``."""
        held = self.graph.edges.where("kind = 'contains'").select(F.col("src").alias("module"), F.col("dst").alias("id"))
        declared = held.join(self.graph.nodes.select("id", "name"), "id").join(self.graph.nodes.where("kind = 'module'").select(F.col("id").alias("module")), "module", "left_semi")
        return exports.resolved(requests, declared.select("module", "name", "id"), aliases, stars)

    def flow_values(self, definitions: DataFrame, uses: DataFrame) -> None:
        """References from ``uses`` to the callables that arrive at them through ``definitions``; see :mod:`skein.operators.valueflow`."""
        self.graph = valueflow.references(self.graph, definitions, uses)

    def source_at_lines(self, lines: DataFrame, prefixes_: DataFrame | None = None) -> DataFrame:
        """(path, line, node_id): the smallest callable at each of ``lines`` (path, line), paths remapped by ``prefixes_`` (old, new)."""
        if prefixes_ is None:
            prefixes_ = self.spark.createDataFrame([], "old string, new string")
        return prefixes.source_lines(lines, GraphBundle.conform(self.graph.nodes, "nodes"), prefixes_)

    # -- binaries ---------------------------------------------------------

    def _functions(self) -> DataFrame:
        """(artifact, node_id, name, start, end) of the functions that the artifacts' ranges hold."""
        named = self.graph.nodes.where("kind <> 'binary_region'").select(F.col("id").alias("node_id"), "name")
        return self.graph.binary_ranges.join(named, "node_id").select("artifact", "node_id", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))

    def scan_spans(self, ranges: DataFrame, segments: DataFrame, marks: DataFrame, mode: str = "") -> DataFrame:
        """(artifact, start, end, mode): selected ranges (artifact, kind, start, end, mode) of artifacts as addresses to decode; see :mod:`skein.operators.overlay`."""
        based = self.graph.binary_artifacts.select("id", F.col("image_base").cast("long").alias("image_base"))
        return overlay.scan_spans(overlay.on_one_axis(ranges, based, segments), marks, mode)

    def binary_gaps(self, spans: DataFrame) -> DataFrame:
        """(artifact, start, end): what ``spans`` (artifact, s_start, s_end) hold outside all functions."""
        return binaries.gaps(binaries.clipped(self._functions(), spans), spans)

    def add_instructions(self, instructions: DataFrame) -> None:
        """Calls of decoded ``instructions`` (artifact, architecture, byte_order, address, size, bytes, how, target) between the functions known.

        Pairs that add to the program counter are resolved, jumps (``how`` = jump) to the start of another function are
        calls, and a target that no one function holds is left as the address, uncertain. Adding them twice changes nothing.
        """
        functions = self._functions()
        decoded = cut(binaries.pc_relative(instructions))
        tails = binaries.tail_calls(decoded.where("how = 'jump'").select("artifact", "address", "target"), functions).withColumn("confidence", F.lit("inferred"))
        calls = binaries.calls_by_owner(decoded.where("how in ('direct', 'pc_relative')").select("artifact", "address", "target", "how"), functions)
        raw = calls.join(decoded.select("artifact", "address", "target"), ["artifact", "address"])
        found = raw.select("artifact", "address", "src", F.coalesce("dst", F.concat(F.lit("address:"), "artifact", F.lit(":"), F.col("target").cast("string"))).alias("dst"), "confidence").unionByName(tails)
        edges = GraphBundle.conform(self.graph.edges, "edges")
        attrs = F.to_json(F.struct(F.col("artifact"), F.col("address").cast("string").alias("callsite")))
        made = found.withColumns({"kind": F.lit("calls"), "attrs": attrs}).join(edges.select("src", "dst", "kind", "attrs"), ["src", "dst", "kind", "attrs"], "left_anti")
        high = edges.agg(F.max("edge_seq")).first()[0] or 0
        made = made.withColumn("edge_seq", F.lit(high + 1) + F.monotonically_increasing_id())
        self.graph = self.graph.having(edges=cut(edges.unionByName(GraphBundle.conform(made, "edges"))))

    def overlaid(self, spans: DataFrame, sources: int) -> DataFrame:
        """Mappings (artifact, start, end, source and more) laid over each other: every address belongs to the first source that has it."""
        return overlay.mapped(spans, ["artifact"], sources)

    def augment_binary(self, text: str, connect_sources: bool = True) -> None:
        self.graph = imports.binary(self.graph, text, connect_sources)

    def augment_binary_file(self, path: str, key: str | None = None) -> None:
        from .sources.native import import_text

        self.graph = imports.binary(self.graph, import_text(path, key))

    def augment_binary_mapping(self, text: str) -> None:
        """Add an explicit mapping of source units to address ranges of an artifact that is there."""
        self.graph = imports.mapping(self.graph, text)

    def binary_artifacts(self) -> DataFrame:
        return self.graph.binary_artifacts.orderBy("id")

    def binary_ranges(self, name: str, artifact: str | None = None, line: int | None = None) -> DataFrame:
        return imports.coalesced_ranges(self.graph, self.find(name) or "", artifact, line).orderBy("start", "end")

    def source_at_address(self, artifact: str, address: int, kind: str = "va") -> DataFrame:
        return imports.source_at(self.graph, artifact, address, kind)

    def disassemble_binary(self, path: str, start: int, end: int, max_instructions: int = 256) -> DataFrame:
        from .sources.native import instructions

        rows = instructions(path, start, end)[:max_instructions]
        return self.spark.createDataFrame(rows, "address long, bytes string, text string")

    # -- output -----------------------------------------------------------

    def to_json(self, indent: int | None = 2) -> str:
        return render.to_json(self.graph, indent)

    def diagram(self, kind: str, focus: str | None = None, depth: int = 2, threshold: int = 10, direction: str = "TD") -> str:
        focus = self.find(focus) if focus else None
        emit = {
            "call-graph": lambda: render.call_graph(self.graph, focus, depth, direction),
            "class-hierarchy": lambda: render.class_hierarchy(self.graph, direction),
            "module-deps": lambda: render.module_deps(self.graph, direction),
            "containment": lambda: render.containment(self.graph, direction),
            "complexity": lambda: render.complexity(self.graph, threshold, direction),
            "data-flow": lambda: render.data_flow(self.graph, focus, depth, direction),
        }
        if kind not in emit:
            raise ValueError(f"unknown diagram {kind}; known are {list(emit)}")
        return emit[kind]()
