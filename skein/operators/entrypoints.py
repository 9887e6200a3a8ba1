"""Entrypoint detection as a table of rules evaluated in one pass."""

from __future__ import annotations

import os
import tomllib
from fnmatch import translate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bundle import GraphBundle
from ..schema import ASSET_VALUES, ENTRYPOINT_KINDS, TRUST_LEVELS

#: What frontends leave in ``attrs`` for the rules; it is parsed once a node.
FACTS = ("decorators", "signature", "visibility", "owner", "exported", "executable", "owner_decorators", "schema_role")
_ATTR = "coalesce(facts.{0}, '')"
_DECORATORS, _SIGNATURE, _VISIBILITY, _OWNER, _EXPORTED = (_ATTR.format(x) for x in ("decorators", "signature", "visibility", "owner", "exported"))
_CALLABLE = "kind in ('function', 'method')"
#: What a rule makes of a node.
API, CLI, TASK = ("api", "untrusted_external", "high"), ("user_input", "untrusted_external", "medium"), ("third_party", "semi_trusted_external", "medium")


def _rule(name: str, languages: str | None, when: str, tag: tuple[str, str, str] = API, layer: int = 1) -> dict:
    return {"layer": layer, "rule": name, "languages": tuple(languages.split()) if languages else None, "when": when, "as": tag}


def _has(fact: str, pattern: str) -> str:
    """SQL: the fact has a match of the pattern."""
    return f"{fact} rlike '{pattern}'".replace("\\", "\\\\")


#: Rules over ``FACTS``: the signature is the whole head, the owner its kind and head.
RULES: list[dict] = [
    _rule("main", None, f"{_CALLABLE} and name in ('main', 'vb_main') and {_ATTR.format('executable')} <> 'false'", ("user_input", "trusted_internal", "low"), 0),
    _rule("python-http", "python", _has(_DECORATORS, r"@[\w.]*\b\w+\.(route|get|post|put|patch|delete|head|options|trace|websocket)\(")),
    _rule("python-cli", "python", _has(_DECORATORS, r"@(\w+\.)*(click|typer|app|cli|group)\.(command|group|callback)\b"), CLI),
    _rule("python-task", "python", _has(_DECORATORS, r"@(\w+\.)*(shared_task|task)\b"), TASK),
    _rule("rust-http", "rust", _has(_DECORATORS, r"#\[(\w+::)*(get|post|put|patch|delete|head|options|route)\s*\(")),
    _rule("rust-export", "rust", f"{_has(_DECORATORS, 'no_mangle|export_name')} or {_has(_SIGNATURE, 'pub (unsafe )?extern "C"')}"),
    _rule("rust-main", "rust", _has(_DECORATORS, r"#\[\w+::main\b"), CLI),
    _rule("solidity", "solidity", f"kind = 'method' and {_OWNER} not like 'interface:%' and ({_VISIBILITY} in ('public', 'external') or name in ('fallback', 'receive'))"),
    _rule("java-http", "java", f"{_CALLABLE} and {_has(_DECORATORS, '@(Get|Post|Put|Delete|Patch|Request)Mapping|@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Path)(?![A-Za-z])')}"),
    _rule("java-queue", "java", f"{_CALLABLE} and {_has(_DECORATORS, '@KafkaListener')}", TASK),
    _rule("kotlin-http", "kotlin", f"{_CALLABLE} and {_has(_DECORATORS, '@(Get|Post|Put|Delete|Patch|Request)Mapping')}"),
    _rule("servlet", "java", f"kind = 'method' and name in ('doGet', 'doPost', 'doPut', 'doDelete', 'doPatch', 'doHead', 'doOptions')"),
    _rule("android", "java kotlin", "kind = 'method' and name in ('onCreate', 'onReceive', 'onStartCommand', 'onBind', 'onNewIntent', 'onHandleIntent')", CLI),
    _rule("csharp-http", "c_sharp", f"{_CALLABLE} and {_has(_DECORATORS, r'\[(\w+\.)*(Http(Get|Post|Put|Delete|Patch|Head|Options)|Route|Function|FunctionName)\b')}"),
    _rule("php-http", "php", f"{_CALLABLE} and {_has(_DECORATORS, r'#\[\\?(\w+\\)*Route\b')}"),
    _rule("nest", "typescript javascript", f"kind = 'method' and {_has(_DECORATORS, r'@(Get|Post|Put|Delete|Patch|Options|Head|All)\(')} and {_has(_ATTR.format('owner_decorators'), '@Controller')}"),
    _rule("lambda", "javascript typescript", "kind = 'function' and name in ('handler', 'lambdaHandler')"),
    _rule("file-route", "javascript typescript", f"kind = 'function' and {_has('file_path', r'(^|/)(pages/api|app/.*|routes)/')} and name in ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS', 'handler', 'loader', 'action')"),
    _rule("go-handler", "go", f"{_has(_SIGNATURE, r'http\.ResponseWriter|\*gin\.Context|echo\.Context|\*fiber\.Ctx')} or {_EXPORTED} = 'true'"),
    _rule("rails", "ruby", f"kind = 'method' and {_has('file_path', r'(^|/)app/controllers/')}"),
    _rule("sidekiq", "ruby", "kind = 'method' and name = 'perform'", TASK),
    _rule("c-export", "c cpp", f"kind in ('function', 'method') and {_has(_SIGNATURE, r'dllexport|visibility\s*\(\s*"default"\s*\)|EMSCRIPTEN_KEEPALIVE|JNIEXPORT|extern "C"')}"),
    _rule("objc-delegate", "objc", "name in ('application', 'handleOpenURL', 'userNotificationCenter', 'webView')"),
    _rule("swift-main", "swift", _has(_DECORATORS, r"@(main|UIApplicationMain|NSApplicationMain)\b"), CLI),
    _rule("dart-pragma", "dart", _has(_DECORATORS, "vm:entry-point")),
    _rule("cairo", "cairo", f"{_has(_DECORATORS, r'#\[(external|l1_handler|constructor)\b')} or {_CALLABLE} and {_has(_ATTR.format('owner_decorators'), r'#\[abi\(')}"),
    _rule("circom", "circom", f"name = 'main' and {_SIGNATURE} like 'component main%'"),
    _rule("masm", "masm", _has(_SIGNATURE, r"^(export\.|begin\b)")),
    _rule("move", "move", f"kind in ('function', 'method') and {_has(_SIGNATURE, r'\b(public|entry)\b(?!\s*\()')}"),
    _rule("tact", "tact", f"name in ('receive', 'external', 'bounced', 'init') or {_has(_SIGNATURE, r'^get\b')}"),
    _rule("func", "func", f"name in ('recv_internal', 'recv_external', 'run_ticktock', 'main') or {_has(_SIGNATURE, 'method_id')}"),
    _rule("sway", "sway", f"{_CALLABLE} and ({_has(_SIGNATURE, '^pub fn')} or {_has(_OWNER, '^(interface: abi|class: impl .* for Contract)')})"),
    _rule("haskell-main", "haskell", "name = 'main'", CLI),
    _rule("erlang-export", "erlang", f"{_EXPORTED} = 'true'", TASK),
    _rule("rego", "rego", "name in ('allow', 'deny', 'violation')"),
    _rule("rpc", None, f"{_ATTR.format('schema_role')} in ('rpc', 'service_function')"),
    _rule("graphql", "graphql", f"{_ATTR.format('schema_role')} = 'root_operation'"),
    _rule("zig-export", "zig", _has(_SIGNATURE, r"\bexport\b.*\bfn\b")),
    _rule("aiken", "aiken", f"{_OWNER} like 'contract: validator%' and name in ('spend', 'mint', 'withdraw', 'publish', 'vote', 'propose', 'else')"),
]


def tagged(nodes: DataFrame, rules: list[dict]) -> DataFrame:
    """(node_id, kind, trust_level, asset_value, description, rule): of the rules that hold the last of the highest layer wins.

    A node is held against the rules of its language and those of all languages only, from the last one down, until one holds.
    """
    if not rules:
        return nodes.select(F.col("id").alias("node_id"), *[F.lit("").alias(c) for c in ("kind", "trust_level", "asset_value", "description", "rule")]).where("false")
    order = sorted(range(len(rules)), key=lambda n: (rules[n]["layer"], n), reverse=True)

    def first(mine) -> str:
        tests = "".join(f" WHEN {rules[n]['when']} THEN {n}" for n in order if mine(rules[n].get("languages")))
        return f"CASE{tests} END" if tests else "CAST(NULL AS INT)"

    place = first(lambda languages: not languages)
    spoken = sorted({x for r in rules for x in r.get("languages") or ()})
    if spoken:
        cases = "".join(f" WHEN '{x}' THEN {first(lambda languages, own=x: not languages or own in languages)}" for x in spoken)
        place = f"CASE language{cases} ELSE {place} END"
    tags = []
    for n, r in enumerate(rules):
        kind, trust, asset = r.get("as") or (r["kind"], r["trust"], r["asset"])
        tags.append(F.struct(F.lit(kind).alias("kind"), F.lit(trust).alias("trust_level"), F.lit(asset).alias("asset_value"), F.lit(r.get("description", "")).alias("description"), F.lit(r.get("rule", f"rule-{n}")).alias("rule")))
    fields = ", ".join(f"{name} string" for name in FACTS)
    facts = f"from_json(attrs, '{fields}')" if "attrs" in nodes.columns else f"CAST(NULL AS STRUCT<{fields.replace(' ', ':')}>)".replace(",:", ",")
    # As an argument of a lambda the attributes are parsed once a node, whatever the number of rules that look at them; a
    # lambda is also evaluated branch by branch, while code generated for all rules is too long a method to be compiled.
    # The generator keeps the outcome from being computed both for the filter and for the result.
    found = F.explode_outer(F.expr(f"transform(array({facts}), facts -> {place})"))
    hits = nodes.select(F.col("id").alias("node_id"), found.alias("place")).where("place is not null")
    return hits.select("node_id", F.element_at(F.array(*tags), F.col("place") + 1).alias("t")).select("node_id", "t.*")


def overrides(text: str) -> list[dict]:
    """Rules of an ``entrypoints.toml``; an entry with a mistyped field or an unknown value is ignored."""
    found = []
    for entry in tomllib.loads(text).get("entrypoint", []):
        if not isinstance(entry, dict) or not all(isinstance(v, str) for v in entry.values()):
            continue
        kind, trust, asset = entry.get("kind", "user_input"), entry.get("trust", "untrusted_external"), entry.get("asset_value", "medium")
        if kind not in ENTRYPOINT_KINDS or trust not in TRUST_LEVELS or asset not in ASSET_VALUES:
            continue
        quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rule = {"layer": 3, "rule": "override", "as": (kind, trust, asset), "description": entry.get("description", "")}
        tests = []
        if "node" in entry:
            found.append(rule | {"node": entry["node"]})
            continue
        if "file_glob" in entry:
            tests.append(f"file_path rlike {quoted(translate(entry['file_glob']).removesuffix(chr(92) + 'z').removesuffix(chr(92) + 'Z'))}")
        if "param_type" in entry:
            tests.append(f"exists(parameters, p -> p.type = {quoted(entry['param_type'])})")
        if "name_regex" in entry:
            tests.append(f"name rlike {quoted(entry['name_regex'])}")
        if tests:
            found.append(rule | {"when": " and ".join(tests)})
    return found


def aimed(nodes: DataFrame, rules: list[dict]) -> list[dict]:
    """``rules`` with those for one ``node`` aimed at its id: the id itself, or else the only id of which it is the part after '::', or what a script of that name would be; the others of that kind go."""
    names = sorted({r["node"] for r in rules if "node" in r})
    if not names:
        return rules
    wanted = nodes.sparkSession.createDataFrame([(n,) for n in names], "wanted string")
    # A node answers to its id and to all that may follow one of its "::".
    tails = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("id", "::"))), lambda k: F.array_join(F.slice(F.split("id", "::"), k, F.size(F.split("id", "::"))), "::")), lambda t: t != F.col("id"))
    answers = nodes.select("id", F.explode(F.concat(F.array("id"), tails)).alias("wanted"))
    hits = answers.join(F.broadcast(wanted), "wanted").groupBy("wanted").agg(F.max(F.when(F.col("id") == F.col("wanted"), F.col("id"))).alias("exact"), F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    found = {r["wanted"]: r["exact"] or (r["only"] if r["n"] == 1 else None) for r in hits.collect()}
    found |= {name: unit for name, unit in script_units(nodes, [(n, n) for n in names if n not in found]) if not found.get(name)}
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return [r if "node" not in r else r | {"when": f"id = {quoted(found[r['node']])}"} for r in rules if "node" not in r or found.get(r["node"])]


def scripts(pyproject: str) -> list[tuple[str, str]]:
    """(name, 'module:function') of a project file's scripts."""
    project = tomllib.loads(pyproject).get("project", {})
    return [(name, target) for table in ("scripts", "gui-scripts") for name, target in project.get(table, {}).items() if isinstance(target, str)]


def script_units(nodes: DataFrame, targets: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(name, node id) of the scripts whose target is the id of a unit, or else the end of exactly one unit's id."""
    if not targets:
        return []
    plain = [(name, target.split("[")[0].strip()) for name, target in targets]
    wanted = nodes.sparkSession.createDataFrame(plain, "script string, target string")
    units = nodes.where("kind in ('function', 'method', 'class')").select("id", F.substring_index("id", ":", -1).alias("tail"))
    hits = wanted.withColumn("tail", F.substring_index("target", ":", -1)).join(units, "tail").where((F.col("id") == F.col("target")) | F.expr("endswith(id, concat('.', target)) or endswith(id, concat('::', target))"))
    exact = F.max(F.when(F.col("id") == F.col("target"), F.col("id")))
    found = hits.groupBy("script").agg(exact.alias("exact"), F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    return [(r["script"], r["exact"] or r["only"]) for r in found.where("exact is not null or n = 1").orderBy("script").collect()]


def configuration(path: str, name: str = "entrypoints.toml") -> tuple[str | None, str | None]:
    """Texts of the override file and the project file of the nearest folder, from ``path`` upwards, that has either."""
    at = os.path.realpath(path)
    while True:
        texts = []
        for file in (name, "pyproject.toml"):
            try:
                with open(os.path.join(at, file), encoding="utf-8") as f:
                    texts.append(f.read())
            except (FileNotFoundError, NotADirectoryError):
                texts.append(None)
        if any(texts) or os.path.dirname(at) == at:
            return texts[0], texts[1]
        at = os.path.dirname(at)


def detect(graph: GraphBundle, override_text: str | None = None, pyproject_text: str | None = None) -> GraphBundle:
    """Tags and evidence by all layers: names, frameworks, project scripts, overrides."""
    nodes = GraphBundle.conform(graph.nodes, "nodes")
    rules = list(RULES)
    for name, node_id in script_units(nodes, scripts(pyproject_text)) if pyproject_text else []:
        quoted = node_id.replace("\\", "\\\\").replace("'", "\\'")
        rules.append({"layer": 2, "rule": "script", "when": f"id = '{quoted}'", "as": CLI, "description": f"script {name}"})
    rules += aimed(nodes.where("kind <> 'proxy'"), overrides(override_text)) if override_text else []
    found = tagged(nodes.where("kind <> 'proxy'"), rules)
    evidence = found.join(nodes.select(F.col("id").alias("node_id"), "file_path", "start_line"), "node_id").select(
        F.concat(F.lit("entrypoint:"), F.substring(F.sha2(F.to_json(F.struct(F.col("node_id"), F.col("rule"))), 256), 1, 24)).alias("evidence_id"), "node_id",
        F.when(F.col("rule") == "override", "override").when(F.col("rule") == "main", "heuristic").otherwise("declaration").alias("basis"), "rule", "file_path", "start_line", F.lit("resolved").alias("binding"),
    )
    return graph.having(entrypoints=found.drop("rule"), evidence=GraphBundle.conform(evidence, "evidence"))


def candidates(graph: GraphBundle) -> DataFrame:
    """Evidence whose node is not reported as an entrypoint; evidence without node stays."""
    tags = graph.entrypoints.select(F.col("node_id").alias("tagged"))
    return graph.evidence.join(tags, F.col("node_id") == F.col("tagged"), "left_anti")


def evidence(graph: GraphBundle) -> DataFrame:
    """Evidence with whether its node is reported."""
    tags = graph.entrypoints.select("node_id", F.lit(True).alias("reported")).distinct()
    return graph.evidence.join(tags, "node_id", "left").withColumn("reported", F.coalesce("reported", F.lit(False)))
