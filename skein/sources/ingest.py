"""From source files to a graph bundle: one scan, one parse a file, then linking joins."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..functions.storage import cut
from ..operators import inheritance, linking
from ..schema import SCHEMAS
from . import languages as L
from .policy import SourcePolicy

TABLES = ("nodes", "edges", "type_refs", "dependencies", "diagnostics")

#: A worker hands on so many facts, or files of so many characters, at a time.
FACTS, CHARACTERS = 10_000, 4 << 20


def named_modules(files: DataFrame) -> DataFrame:
    """``files`` (path, language) with their module ids; all files of a group that would share one are named by their full file name."""
    from .frontends import module_id

    @F.pandas_udf("string")
    def plain(path: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([module_id(p, x) for p, x in zip(path, language)])

    part = lambda p: F.regexp_replace(F.regexp_replace(p, r"\\", r"\\\\"), r"\.", r"\\.")
    wide = F.array_join(F.transform(F.split("path", "/"), part), ".")
    out = cut(files.withColumn("module", plain("path", "language")).withColumn("wide", wide))
    while True:
        shared = out.groupBy("module").agg(F.count("*").alias("n")).where("n > 1").select("module", F.lit(True).alias("shared"))
        after = cut(out.join(shared, "module", "left").withColumn("named", F.when(F.col("shared"), F.col("wide")).otherwise(F.col("module"))))
        if after.where("named <> module").isEmpty():
            return after.select(*files.columns, "module")
        out = after.withColumn("module", F.col("named")).drop("named", "shared")


def parsed(files: DataFrame) -> DataFrame:
    """(table, path, seq, payload): the facts of ``files`` (path, language, content[, module]), as JSON by table."""
    if "module" not in files.columns:
        files = files.withColumn("module", F.lit(None).cast("string"))

    def run(batches):
        from .frontends import facts

        for batch in batches:
            rows = []
            for path, language, content, module in zip(batch["path"], batch["language"], batch["content"], batch["module"]):
                text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                rows += [(table, path, k, json.dumps(row)) for k, (table, row) in enumerate(facts(path, language, text, module))]
                if len(rows) >= FACTS:
                    yield pd.DataFrame(rows, columns=["table", "path", "seq", "payload"])
                    rows = []
            yield pd.DataFrame(rows, columns=["table", "path", "seq", "payload"])

    return files.select("path", "language", "content", "module").mapInPandas(run, "table string, path string, seq long, payload string")


def assembled(spark: SparkSession, found: DataFrame) -> GraphBundle:
    """The bundle that parsed facts make, without linking. Order is that of paths, then of facts in a file."""
    # Range partitions in order, each sorted: ids that rise with them need no task that sees all facts.
    found = cut(found)
    placed = cut(found.repartitionByRange("path").sortWithinPartitions("path", "seq").withColumn("at", F.monotonically_increasing_id()))
    tables = {}
    for name in TABLES:
        rows = placed.where(F.col("table") == name).select("at", F.from_json("payload", SCHEMAS[name]).alias("x")).select("at", "x.*")
        if name in ("nodes", "edges"):
            seq = "node_seq" if name == "nodes" else "edge_seq"
            rows = rows.withColumn(seq, F.col("at"))
        if name == "dependencies":
            rows = rows.groupBy("name").agg(F.min("at").alias("seq"))
        tables[name] = cut(GraphBundle.conform(rows, name))
    return GraphBundle(spark, tables)


def linked(graph: GraphBundle) -> GraphBundle:
    """The passes after parsing, in order; the linked graph is stored."""
    return linking.normalised(linking.cross_file_calls(inheritance.inherited_calls(linking.inheritance_links(linking.lexical_calls(graph))))).materialised()


def parse_text(spark: SparkSession, files: dict[str, tuple[str, str]]) -> GraphBundle:
    """A graph of {path: (language, text)}, linked."""
    df = spark.createDataFrame([(p, lang, text) for p, (lang, text) in files.items()], "path string, language string, content string")
    modules = named_modules(df.select("path", "language"))
    return linked(assembled(spark, parsed(df.join(modules.select("path", "module"), "path"))))


def parse_file(spark: SparkSession, path: str, language: str | None = None, strict: bool = False) -> GraphBundle:
    name = os.path.basename(path)
    if language is None:
        extension = os.path.splitext(name)[1].lower()
        language = next((x for x, exts in L.EXTENSIONS.items() if extension in exts and extension != ".v"), None)
        if language is None:
            raise ValueError(f"no language for {name}")
    with open(path, encoding="utf-8", errors="replace") as f:
        graph = parse_text(spark, {name: (language, f.read())})
    return checked(graph, strict)


def checked(graph: GraphBundle, strict: bool) -> GraphBundle:
    if strict and not graph.diagnostics.isEmpty():
        first = graph.diagnostics.first()
        raise ValueError(f"{first['file_path']}:{first['start_line']}: {first['message']}")
    return graph


def parse_directory(spark: SparkSession, root: str, language: str | list[str] | None = None, allow_empty: bool = False, strict: bool = False, policy: SourcePolicy | None = None) -> GraphBundle:
    """Select, parse, link. Files are read where they are parsed."""
    policy = policy or SourcePolicy((root,))
    manifest = cut(policy.discover(spark))
    wanted = None if language in (None, "auto", "polyglot") else [language] if isinstance(language, str) else list(language)
    files = cut(L.owned(manifest.where("status = 'selected'"), wanted))
    if files.isEmpty() and not allow_empty:
        raise ValueError(f"no source files in {root}")
    roots = policy.roots
    graphs = []
    for one in roots:
        top = os.path.realpath(one)
        own = files.where(F.col("root") == one)

        def run(batches, top=top):
            for batch in batches:
                texts, begin, size = [], 0, 0
                for k, path in enumerate(batch["path"], 1):
                    with open(os.path.join(top, path), encoding="utf-8", errors="replace") as f:
                        texts.append(f.read())
                    size += len(texts[-1])
                    if size >= CHARACTERS or k == len(batch):
                        yield batch.iloc[begin:k].assign(content=texts)
                        texts, begin, size = [], k, 0

        read = named_modules(own.select("path", "language")).mapInPandas(run, "path string, language string, module string, content string")
        graph = linked(assembled(spark, parsed(read)))
        graphs.append(graph.namespaced(one) if len(roots) > 1 else graph)
    out = graphs[0]
    for more in graphs[1:]:
        out = out.merge(more)
    sources = manifest.join(files.select("root", "path", "language"), ["root", "path"], "left")
    return checked(out.having(source_files=GraphBundle.conform(sources, "source_files")), strict)


def detect_languages(spark: SparkSession, root: str) -> list[str]:
    return L.detect(SourcePolicy((root,)).discover(spark).where("status = 'selected'"))
