"""Frontends of schema languages: SQL, Protocol Buffers, Thrift and GraphQL."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

from . import frontends as base
from . import scanner

Fact = base.Fact
_PROTO_TYPE = re.compile(r"\b(?P<kind>message|service|enum)\s+(?P<name>\w+)\s*\{")
_PROTO_RPC = re.compile(r"\brpc\s+(?P<name>\w+)\s*\(\s*(?:stream\s+)?(?P<takes>[\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?(?P<gives>[\w.]+)\s*\)")
_PROTO_FIELD = re.compile(r"(?:^|(?<=[;{}]))\s*(?:repeated\s+|optional\s+|required\s+)?(?P<type>map\s*<[^>]*>|[\w.]+)\s+(?P<name>\w+)\s*=\s*\d+")
_THRIFT_TYPE = re.compile(r"\b(?P<kind>struct|service|enum|exception|union)\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?\s*\{")
_THRIFT_CALL = re.compile(r"(?:^|(?<=[;,{}\n]))\s*(?:oneway\s+)?(?P<gives>[\w.<>, ]+?)\s+(?P<name>\w+)\s*\((?P<takes>[^)]*)\)")
_THRIFT_FIELD = re.compile(r"\d+\s*:\s*(?:required\s+|optional\s+)?(?P<type>[\w.<>, ]+?)\s+(?P<name>\w+)\s*(?=[=,;}\n(]|$)", re.M)
_GRAPH_TYPE = re.compile(r"(?P<extend>\bextend\s+)?\b(?P<kind>type|interface|input|enum|union|scalar)\s+(?P<name>\w+)(?P<head>[^{}\n]*)(?P<open>\{)?")
_GRAPH_FIELD = re.compile(r"(?:^|(?<=[{,]))[ \t]*(?P<name>\w+)\s*(?P<args>\([^)]*\))?\s*:\s*(?P<type>[\w\[\]! ]+)", re.M)
_SQL_NAME = r"(?P<name>(?:\"[^\"]+\"|\w+)(?:\.(?:\"[^\"]+\"|\w+))*)"
_SQL_CREATE = re.compile(rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:global\s+|local\s+)?(?:temp(?:orary)?\s+|materialized\s+|unlogged\s+|recursive\s+)*(?P<kind>schema|table|view|function|procedure)\s+(?:if\s+not\s+exists\s+)?{_SQL_NAME}\s*(?P<args>\([^()]*\))?")
_SQL_USE = re.compile(rf"(?i)\b(?:from|join|into|update|using|references)\s+(?:only\s+)?{_SQL_NAME}")
#: What type keywords become.
KINDS = {"message": "struct", "struct": "struct", "exception": "struct", "union": "struct", "service": "interface", "enum": "enum", "type": "interface", "interface": "interface", "input": "struct", "scalar": "struct", "schema": "schema", "table": "table", "view": "view", "function": "function", "procedure": "procedure"}
LANGUAGES = ("proto", "thrift", "graphql", "sql")


class _File:
    """Places in a text, and the rows made from them."""

    def __init__(self, path: str, language: str, text: str, module: str):
        self.path, self.language, self.text, self.module = path, language, text, module
        self.clean = scanner.cleaned(text, scanner.LOOKS[language])[0]
        self.page = scanner.Page(self.clean)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at)
        return line, at - self.starts[line - 1]

    def node(self, owner: str, sign: str, name: str, kind: str, begin: int, end: int, **attrs) -> tuple[str, list[Fact]]:
        line, col = self.place(begin)
        own = f"{owner}{sign}{name}"
        row = {"id": own, "name": name.rsplit(".", 1)[-1], "kind": kind, "origin": "source", "language": self.language, "file_path": self.path, "start_line": line, "end_line": self.place(max(begin, end - 1))[0], "start_col": col, "attrs": json.dumps(attrs, sort_keys=True)}
        return own, [("nodes", row), ("edges", {"src": owner, "dst": own, "kind": "contains", "confidence": "certain", "file_path": self.path, "start_line": line})]

    def edge(self, src: str, dst: str, kind: str, at: int) -> Fact:
        return "edges", {"src": src, "dst": dst, "kind": kind, "confidence": "certain", "file_path": self.path, "start_line": self.place(at)[0]}

    def module_row(self, **attrs) -> Fact:
        table, row = base.module_node(self.path, self.language, len(self.starts))
        name = self.module.rsplit(".", 1)[-1] if self.module == row["id"] else self.module
        return table, row | {"id": self.module, "name": name, "attrs": json.dumps(attrs, sort_keys=True)}


def facts(path: str, language: str, text: str, module: str | None = None) -> Iterator[Fact]:
    return {"proto": _proto, "thrift": _thrift, "graphql": _graphql, "sql": _sql}[language](path, text, module or base.module_id(path, language))


def _imports(file: _File, pattern: str) -> Iterator[Fact]:
    for m in re.finditer(pattern, file.text, re.M):
        yield "dependencies", {"name": m[1]}
        yield file.edge(file.module, m[1], "imports", m.start())


def _proto(path: str, text: str, module: str) -> Iterator[Fact]:
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", text, re.M)
    f = _File(path, "proto", text, package[1] if package else module)
    yield f.module_row()
    yield from _imports(f, r"^\s*import\s+(?:public\s+|weak\s+)?\"([^\"]+)\"")
    types, found = {}, []
    for m in _PROTO_TYPE.finditer(f.clean):
        end = f.page.body(m.end() - 1)[1]
        outer = next((o for o in reversed(found) if o[1] <= m.start() < o[2]), None)
        own, rows = f.node(outer[0] if outer else f.module, "." if outer else ":", m["name"], KINDS[m["kind"]], m.start(), end)
        found.append((own, m.end(), end, m["kind"]))
        types[m["name"]] = own
        yield from rows
    for own, begin, end, kind in found:
        inner = [(b, e) for o, b, e, _ in found if begin < b and e <= end]
        pattern = _PROTO_RPC if kind == "service" else _PROTO_FIELD if kind == "message" else None
        for m in pattern.finditer(f.clean, begin, end) if pattern else ():
            if any(b <= m.start("name") < e for b, e in inner):
                continue
            close = f.clean.find(";", m.end(), end)
            at, rows = f.node(own, ".", m["name"], "method", m.start() + len(m[0]) - len(m[0].lstrip()), close + 1 if close > 0 else m.end(), schema_role="rpc" if kind == "service" else "field")
            yield from rows
            used = [m["takes"], m["gives"]] if kind == "service" else re.findall(r"[\w.]+", m["type"])
            for name in dict.fromkeys(u.rsplit(".", 1)[-1] for u in used):
                if name in types:
                    yield f.edge(at, types[name], "type_uses", m.start())


def _thrift(path: str, text: str, module: str) -> Iterator[Fact]:
    f = _File(path, "thrift", text, module)
    space = re.search(r"^\s*namespace\s+[\w.*]+\s+([\w.]+)", text, re.M)
    yield f.module_row(**({"target_namespace": space[1]} if space else {}))
    yield from _imports(f, r"^\s*include\s+[\"']([^\"']+)[\"']")
    found, types = [], {}
    for m in _THRIFT_TYPE.finditer(f.clean):
        end = f.page.body(m.end() - 1)[1]
        own, rows = f.node(f.module, ":", m["name"], KINDS[m["kind"]], m.start(), end)
        found.append((own, m.end(), end, m["kind"], m["base"]))
        types[m["name"]] = own
        yield from rows
    for own, begin, end, kind, parent in found:
        if parent:
            yield "edges", {"src": own, "dst": types.get(parent, f"{f.module}:{parent}"), "kind": "inherits", "confidence": "inferred", "file_path": path, "start_line": f.place(begin)[0]}
        if kind == "enum":
            continue
        for m in (_THRIFT_CALL if kind == "service" else _THRIFT_FIELD).finditer(f.clean, begin, end):
            at, rows = f.node(own, ".", m["name"], "method", m.start() + len(m[0]) - len(m[0].lstrip()), m.end(), schema_role="service_function" if kind == "service" else "field")
            yield from rows
            used = re.findall(r"\w+", f"{m['gives']} {m['takes']}" if kind == "service" else m["type"])
            for name in dict.fromkeys(used):
                if name in types:
                    yield f.edge(at, types[name], "type_uses", m.start())


def _graphql(path: str, text: str, module: str) -> Iterator[Fact]:
    f = _File(path, "graphql", text, module)
    roots = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}
    declared = re.search(r"\bschema\b[^{}]*\{([^}]*)\}", f.clean)
    if declared:
        roots = dict(re.findall(r"(query|mutation|subscription)\s*:\s*(\w+)", declared[1]))
    names = set(re.findall(r"\b(?:type|interface)\s+(\w+)", f.clean))
    roots = {k: v for k, v in roots.items() if v in names}
    yield f.module_row(**{f"graphql_{k}_root": v for k, v in roots.items()})
    found, types = [], {}
    for m in _GRAPH_TYPE.finditer(f.clean):
        end = f.page.body(m.end() - 1)[1] if m["open"] else m.end()
        own, rows = f.node(f.module, ":", m["name"], KINDS[m["kind"]], m.start(), end, graphql_type=m["name"], graphql_extension=bool(m["extend"]))
        fresh = m["name"] not in types
        types.setdefault(m["name"], own)
        found.append((own, m.end(), end, m["kind"], m["name"]))
        if fresh:
            yield from rows
        for parent in re.findall(r"\w+", m["head"].partition("implements")[2].replace("&", " ")):
            yield "edges", {"src": own, "dst": f"{f.module}:{parent}", "kind": "implements", "confidence": "inferred", "file_path": path, "start_line": f.place(m.start())[0]}
    for own, begin, end, kind, name in found:
        if kind not in ("type", "interface", "input"):
            continue
        for m in _GRAPH_FIELD.finditer(f.clean, begin, end):
            root = name in roots.values()
            at, rows = f.node(own, ".", m["name"], "method", m.start("name"), m.end(), schema_role="root_operation" if root else "field")
            yield from rows
            for used in dict.fromkeys(re.findall(r"\w+", m["type"]) + re.findall(r":\s*\[?(\w+)", m["args"] or "")):
                if used in types:
                    yield f.edge(at, types[used], "type_uses", m.start())


def _sql(path: str, text: str, module: str) -> Iterator[Fact]:
    f = _File(path, "sql", text, module)
    yield f.module_row()
    plain = lambda name: name.replace('"', "")
    found, relations = [], {}
    hits = list(_SQL_CREATE.finditer(f.clean))
    ends = [m.start() for m in hits[1:]] + [len(f.clean)]
    for m, end in zip(hits, ends):
        kind, name = m["kind"].lower(), plain(m["name"])
        schema = name.rpartition(".")[0]
        attrs = {"sql_schema": schema}
        if kind in ("function", "procedure"):
            attrs["sql_signature"] = re.sub(r"\s+", " ", (m["args"] or "()")[1:-1].strip())
        stop = len(f.clean[m.start() : end].rstrip()) + m.start()
        own, rows = f.node(f.module, ":", name, KINDS[kind], m.start(), stop, **attrs)
        yield from rows
        found.append((own, kind, schema, m.end(), end))
        if kind in ("table", "view"):
            relations[name.lower()] = own
    for own, kind, schema, begin, end in found:
        if kind not in ("view", "function", "procedure"):
            continue
        # A routine's body may stand in a string: the raw text is searched.
        for name in dict.fromkeys(plain(m["name"]).lower() for m in _SQL_USE.finditer(f.text, begin, end)):
            near = [relations[x] for x in (name, f"{schema}.{name}".lower()) if x in relations]
            if near and near[0] != own:
                yield f.edge(own, near[0], "corresponds_to", begin)
            elif not near and "." in name:
                yield f.edge(own, f"{f.module}:{name}", "corresponds_to", begin)
