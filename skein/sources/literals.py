"""String literals of declarative files, with the lines they stand on."""

from __future__ import annotations

import re

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST = 8 << 20
#: The kinds of files whose literals may name code.
EXTENSIONS = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".xml": "xml", ".graphql": "graphql", ".gql": "graphql"}
_QUOTED = r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'"
_BY_KIND = {
    "json": r"\"((?:[^\"\\\n]|\\.)*)\"",
    "yaml": _QUOTED + r"|(?:^|[:\-]\s)\s*([A-Za-z_][\w.:/\\-]*)\s*(?:#.*)?$",
    "toml": _QUOTED,
    "xml": _QUOTED + r"|>\s*([^<>\s][^<>\n]*?)\s*<",
    "graphql": _QUOTED,
}


def literals(text: str, kind: str) -> list[tuple[str, int]]:
    """(literal, line) in order; texts beyond ``LARGEST`` bytes give none."""
    if len(text) > LARGEST or len(text.encode()) > LARGEST:
        return []
    found, line, at = [], 1, 0
    for m in re.finditer(_BY_KIND[kind], text, re.M):
        value = next((g for g in m.groups() if g), None)
        line += text.count("\n", at, m.start())
        at = m.start()
        if value:
            found.append((value, line))
    return found


def declarative_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the declarative files below a folder, by Spark's reader; hidden and excluded folders are left out."""
    from .policy import EXCLUDED

    top = os.path.realpath(root) if "://" not in root else root.rstrip("/")
    kinds = ",".join(f"*{e}" for e in EXTENSIONS)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + kinds + "}").load(top if "://" in top else f"file://{top}")
    below = F.instr(F.col("path"), F.lit(top))
    path = F.substring(F.col("path"), below + F.lit(len(top) + 1), F.length("path"))
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    inside = found.where(F.col("length") <= LARGEST).select(path.alias("path"), "content")
    return inside.where(~F.exists(parts, lambda p: p.startswith(".") | p.isin(*EXCLUDED)))


def literal_table(files: DataFrame) -> DataFrame:
    """(file, line, literal) of ``files`` (path, content); other kinds of files give none."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                kind = EXTENSIONS.get(path[path.rfind(".") :].lower())
                text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                rows += [(path, line, value) for value, line in literals(text, kind)] if kind else []
            yield pd.DataFrame(rows, columns=["file", "line", "literal"])

    return files.select("path", "content").mapInPandas(run, "file string, line int, literal string")
