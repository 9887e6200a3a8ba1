"""Findings and declarations of other tools, as rows."""

from __future__ import annotations

import json
import posixpath
import tomllib
from urllib.parse import unquote, urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..schema import CONFIDENCES, EDGE_KINDS

RESULT = "result_id long, file string, start long, end long, kind string, description string, source string, groups array<string>"
HOPS = 32


def local_path(uri: str, root: str = "") -> str | None:
    """A root-relative path of a file URI or plain path, decoded once; None for other schemes and for what leaves the root."""
    parts = urlsplit(uri)
    if parts.scheme not in ("", "file"):
        return None
    path = posixpath.normpath(unquote(parts.path))
    if root and path.startswith(root.rstrip("/") + "/"):
        path = path[len(root.rstrip("/")) + 1 :]
    path = path.lstrip("/") if root and not path.startswith("/") else path
    return None if path == ".." or path.startswith("../") else path


def sarif_uri(location: dict, run: dict) -> str | None:
    """The URI of an artifact location: through its index, then through the chain of base ids."""
    for _ in range(HOPS):
        if "uri" in location:
            break
        index, artifacts = location.get("index"), run.get("artifacts", [])
        if not isinstance(index, int) or not 0 <= index < len(artifacts):
            return None
        location = artifacts[index].get("location", {})
    else:
        return None
    uri, base, bases = location.get("uri"), location.get("uriBaseId"), run.get("originalUriBaseIds", {})
    for _ in range(HOPS):
        if base is None:
            return uri
        entry = bases.get(base)
        if entry is None:
            return uri
        uri = urljoin(entry["uri"], uri) if entry.get("uri") else uri
        base = entry.get("uriBaseId")
    return None


def sarif(spark: SparkSession, text: str, root: str = "") -> DataFrame:
    """The results of a SARIF 2.1.0 log; a ValueError for anything else."""
    log = json.loads(text)
    if not isinstance(log, dict) or not isinstance(log.get("runs"), list):
        raise ValueError("not a SARIF log: runs is missing")
    rows, n = [], 0
    for run in log["runs"]:
        tool = run.get("tool", {}).get("driver", {}).get("name", "unknown")
        for result in run.get("results") or []:
            level, rule = result.get("level", "warning"), result.get("ruleId", "unknown")
            message = result.get("message", {}).get("text", "")
            n += 1
            for place in result.get("locations") or [{}]:
                physical = place.get("physicalLocation", {})
                uri = sarif_uri(physical.get("artifactLocation", {}), run)
                region = physical.get("region", {})
                start = region.get("startLine")
                path = local_path(uri, root) if uri else None
                rows.append((n, path, start or 0, region.get("endLine", start) or 0, "finding", f"[{level.upper()}] {rule}: {message} ({tool})", f"sarif:{tool}", [f"sarif:{level}", f"sarif:{tool}"]))
    return spark.createDataFrame(rows, RESULT)


def weaudit(spark: SparkSession, text: str, root: str = "") -> DataFrame:
    """Entries of an audit file; its lines count from 0."""
    log = json.loads(text)
    if not isinstance(log, dict) or not isinstance(log.get("treeEntries"), list):
        raise ValueError("not an audit file: treeEntries is missing")
    author = log.get("clientRemote") or "unknown"
    rows = []
    for n, entry in enumerate([*log["treeEntries"], *(log.get("resolvedEntries") or [])]):
        details = entry.get("details") or {}
        severity, kind = details.get("severity") or "undefined", details.get("type") or "undefined"
        first = (details.get("description") or "").split("\n")[0]
        label = f"[{severity.upper()}] {entry.get('label', '')}" + (f": {first}" if first else "")
        for place in entry.get("locations") or []:
            rows.append((n, local_path(place.get("path", ""), root), int(place.get("startLine", 0)) + 1, int(place.get("endLine", place.get("startLine", 0))) + 1, "audit_note" if entry.get("entryType") == 1 else "finding", label, f"weaudit:{entry.get('author') or author}", [f"weaudit:{severity.lower()}", f"weaudit:{kind.lower()}"]))
    return spark.createDataFrame(rows, RESULT)


def declared_links(spark: SparkSession, text: str) -> DataFrame:
    """(source, target, kind, confidence, description, source_external, target_external) of a links file; a ValueError names the first wrong entry."""
    rows = []
    for n, link in enumerate(tomllib.loads(text).get("link", [])):
        kind, confidence = link.get("kind", "calls"), link.get("confidence", "certain")
        if not isinstance(link.get("source"), str) or not isinstance(link.get("target"), str):
            raise ValueError(f"link {n}: source and target are needed")
        if kind not in EDGE_KINDS or confidence not in CONFIDENCES:
            raise ValueError(f"link {n}: unknown kind or confidence")
        rows.append((link["source"], link["target"], kind, confidence, link.get("description"), bool(link.get("source_external")), bool(link.get("target_external"))))
    return spark.createDataFrame(rows, "source string, target string, kind string, confidence string, description string, source_external boolean, target_external boolean")
