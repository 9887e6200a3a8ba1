"""One tolerant scanner for the languages without a frontend of their own.

A small description of each language steers it: how comments, strings, types,
callables and branches look. Brackets are matched once, units are nested with a stack,
and what is found in bodies (branches, calls, exceptions, variables with a type) is
given to the innermost unit by bisection. Time grows with a text's length for the odd
texts that the tests name; a file of thousands of typed variables may still take
longer than that.
"""

from __future__ import annotations

import bisect
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from .frontends import NESTING, Fact, module_id, module_node

@dataclass(frozen=True)
class Look:
    """How a language looks: what is blanked out, and what is recognised."""

    line_comments: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    types: str = r"\b(?P<kind>class|struct|interface|trait|enum|namespace)\s+(?P<name>[A-Za-z_]\w*)"
    callables: str = r"\b(?:fn|func|function|def|fun|sub)\s+(?P<name>[A-Za-z_]\w*)\s*[(<]"
    branches: str = r"\b(?:if|for|while|case|catch|foreach|elif|elsif|elseif|when|match)\b|&&|\|\||\?(?=[^.?:])"
    imports: str = r"^[ \t]*(?:import|using|use|include|require|from|open|Require Import|EXTENDS)\b\s*[(\"'<]?\s*(?P<name>[\w./:*\\-]+)"
    heads: bool = False  # callables are what stands before a body: a name, parameters, qualifiers
    marks: bool = True  # statements end at ';' or a brace, so that what stands before a unit begins there
    body: str = "brace"  # 'end': at the closing word of the same indent; 'next': until the next callable or type
    bare: bool = True  # calls look like name(...)


_DEF = r"\b(?:fn|func|function|def|fun)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*[?!]?)"
_FORMAL = r"^[ \t]*(?:let rec|let|val|Definition|Fixpoint|Lemma|Theorem|Function|theorem|lemma|def|predicate|function|method|rule|restriction|axiom|goal|event|query|process|fun|reduc)\s+(?:rec\s+|\{:[^}]*\}\s*)?(?P<name>[A-Za-z_][\w']*)"
_TYPES = Look.types

LOOKS: dict[str, Look] = {
    **{x: Look(callables="(?!)", heads=True) for x in ("c", "cpp", "java", "c_sharp", "dart")},
    "objc": Look(types=r"@(?P<kind>interface|implementation|protocol)\s+(?P<name>\w+)", callables=r"^[-+]\s*\([^)]*\)\s*(?P<selector>\w+)", heads=True),
    "javascript": Look(quotes="\"'`", callables=r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*[(<]|\b(?:const|let|var)\s+(?P<assigned>[\w$]+)\s*(?::[^=;{}()]*)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)(?:\s*:[^=(){};]*)?\s*=>|[\w$]+\s*=>)|(?:^[ \t]+|(?<=[{};])[ \t]*)(?:(?:public|private|protected|readonly|override|async|static|get|set)\s+)*(?P<method>(?!(?:if|for|while|switch|catch|function|return)\b)[\w$]+)\s*\([^()]*\)\s*(?::[^{};()=]*)?\{", marks=False),
    "solidity": Look(types=r"\b(?P<kind>contract|interface|library|struct|enum)\s+(?P<name>\w+)", callables=r"\bfunction\s+(?P<name>\w+)\s*\(|\b(?P<special>constructor|fallback|receive)\s*\("),
    "go": Look(quotes="\"'`", types=r"\btype\s+(?P<name>\w+)\s+(?P<kind>struct|interface)", callables=r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[(\[]"),
    "rust": Look(quotes='"', types=r"\b(?P<kind>struct|enum|trait)\s+(?P<name>\w+)", callables=r"\bfn\s+(?P<name>\w+)"),
    "php": Look(line_comments=("//", "#")),
    "kotlin": Look(callables=r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\("),
    "swift": Look(types=r"\b(?P<kind>class|struct|enum|protocol|extension)\s+(?P<name>\w+)", callables=r"\bfunc\s+(?P<name>\w+)"),
    "perl": Look(line_comments=("#",), block=None, callables=r"\bsub\s+(?P<name>\w+)", types=r"\b(?P<kind>package)\s+(?P<name>[\w:]+)"),
    "bash": Look(line_comments=("#",), block=None, types="(?!)", callables=r"^[ \t]*(?:function\s+(?P<name>[\w-]+)|(?P<plain>[\w-]+)\s*\(\))", bare=False),
    "powershell": Look(line_comments=("#",), block=("<#", "#>"), callables=r"(?i)\bfunction\s+(?P<name>[\w-]+)", bare=False),
    "r": Look(line_comments=("#",), block=None, types="(?!)", callables=r"(?<![\w.])(?P<name>[A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\s*\("),
    **{x: Look(line_comments=("#",), block=None, callables=_DEF + r"|^[ \t]*(?P<short>\w+)\([^()=]*\)\s*=(?!=)" if x == "julia" else _DEF, types=r"\b(?P<kind>class|module|struct)\s+(?P<name>[A-Z]\w*)", body="end") for x in ("ruby", "julia")},
    "lua": Look(line_comments=("--",), block=("--[[", "]]"), types="(?!)", callables=r"\bfunction\s+(?:[\w.:]+[.:])?(?P<name>\w+)", body="end"),
    "vb": Look(line_comments=("'",), block=None, quotes='"', types=r"(?i)\b(?P<kind>class|structure|interface|module|enum)\s+(?P<name>\w+)", callables=r"(?i)^[ \t]*(?:(?:public|private|protected|friend|shared|overrides|overridable|async)\s+)*(?:sub|function)\s+(?P<name>\w+)", body="end"),
    "haskell": Look(line_comments=("--",), block=("{-", "-}"), quotes='"', types=r"^(?P<kind>data|newtype|class)\s+(?P<name>[A-Z]\w*)", callables=r"^(?P<name>[a-z]\w*)\s*::", body="next", bare=False),
    "erlang": Look(line_comments=("%",), block=None, types="(?!)", callables=r"^(?P<name>[a-z]\w*)\([^)]*\)\s*(?:when[^-]*)?->", body="next"),
    "masm": Look(line_comments=("#",), block=None, types="(?!)", callables=r"^[ \t]*(?:export|proc)\.(?P<name>\w+)|^[ \t]*(?P<main>begin)\b", body="next", bare=False),
    "move": Look(types=r"\b(?P<kind>module|struct)\s+(?P<name>[\w:]+)", callables=r"\bfun\s+(?P<name>\w+)"),
    "tact": Look(types=r"\b(?P<kind>contract|trait|struct|message)\s+(?P<name>\w+)", callables=r"\bfun\s+(?P<name>\w+)|\b(?P<special>receive|init|external)\s*\("),
    "func": Look(line_comments=(";;",), block=("{-", "-}"), types="(?!)", callables=r"(?<![\w~?'])(?P<name>[\w~?']+)\s*\([^()]*\)[\w \t\"]*(?=\{)"),
    "circom": Look(types=r"\b(?P<kind>template)\s+(?P<name>\w+)"),
    "zig": Look(types=r"\bconst\s+(?P<name>\w+)\s*=\s*(?:pub\s+)?(?:extern\s+|packed\s+)?(?P<kind>struct|enum|union)"),
    "rego": Look(line_comments=("#",), block=None, types="(?!)", callables=r"^(?:default\s+)?(?P<name>[a-z]\w*)(?:\([^)]*\))?\s*(?:if\b|:=|=|\{|contains\b)", body="next"),
    "proto": Look(types=r"\b(?P<kind>message|service|enum)\s+(?P<name>\w+)", callables=r"\brpc\s+(?P<name>\w+)", branches="(?!)", bare=False),
    "thrift": Look(line_comments=("//", "#"), types=r"\b(?P<kind>struct|service|enum|exception|union)\s+(?P<name>\w+)", callables=r"^[ \t]+(?:oneway\s+)?[\w<>,. ]+\s+(?P<name>\w+)\s*\(", branches="(?!)", bare=False),
    "graphql": Look(line_comments=("#",), block=('"""', '"""'), quotes='"', types=r"\b(?P<kind>type|interface|enum|input|union|scalar)\s+(?P<name>\w+)", callables=r"^[ \t]+(?P<name>\w+)\s*(?:\([^)]*\))?\s*:\s*[\w\[\]!]+", branches="(?!)", bare=False),
    "sql": Look(line_comments=("--",), quotes="'", types=r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|materialized\s+)?(?P<kind>table|view|schema)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)", callables=r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.\"]+)", branches="(?!)", body="next", bare=False),
    "lean": Look(line_comments=("--",), block=("/-", "-/"), quotes='"', types=r"^[ \t]*(?P<kind>structure|inductive|class|namespace)\s+(?P<name>[\w.]+)", callables=_FORMAL, body="next", bare=False),
    "dafny": Look(types=r"\b(?P<kind>class|datatype|trait|module)\s+(?P<name>\w+)", callables=r"\b(?:method|function|predicate|lemma)\s+(?:\{:[^}]*\}\s*)?(?P<name>\w+)"),
    **{x: Look(line_comments=("//",) if x == "fstar" else (), block=("(*", "*)"), quotes='"', types=r"^[ \t]*(?P<kind>type|Inductive|Record|module|Module|theory)\s+(?P<name>\w+)", callables=_FORMAL, body="next", bare=False) for x in ("fstar", "rocq", "whyml", "proverif")},
    "tlaplus": Look(line_comments=("\\*",), block=("(*", "*)"), quotes='"', types="(?!)", callables=r"^(?P<name>[A-Za-z]\w*)(?:\([^)]*\))?\s*==", body="next", bare=False),
    "tamarin": Look(types="(?!)", callables=r"^[ \t]*(?:rule|lemma|restriction)\s+(?P<name>\w+)", body="next", bare=False),
}
LOOKS["aiken"] = Look(types=r"\b(?P<kind>validator|type)\s+(?P<name>\w+)", callables=r"\bfn\s+(?P<name>\w+)|^[ \t]+(?P<handler>spend|mint|withdraw|publish|vote|propose|else)\s*\(", marks=False)
LOOKS["cairo"] = Look(types=r"\b(?P<kind>mod|trait|struct|enum|impl)\s+(?P<name>\w+)", callables=r"\bfn\s+(?P<name>\w+)")
LOOKS["sway"] = Look(types=r"\b(?P<kind>abi|struct|enum|trait|impl)\s+(?P<name>\w+)", callables=r"\bfn\s+(?P<name>\w+)")
LOOKS["typescript"] = LOOKS["javascript"]
#: Languages whose statements need no ';': what stands before a unit is its line and the marked lines above.
for _name in ("go", "kotlin", "swift", "perl", "bash", "powershell", "r", "zig", "rego", "haskell", "erlang", "ruby", "julia", "lua", "vb", "masm", "lean", "fstar", "rocq", "whyml", "tlaplus", "tamarin", "proverif", "sql"):
    LOOKS[_name] = replace(LOOKS[_name], marks=False)
_DEFAULT = Look(callables=_DEF)
#: What a type keyword makes of a node; others are structs.
KINDS = {"class": "class", "interface": "interface", "protocol": "interface", "trait": "trait", "enum": "enum", "namespace": "namespace", "contract": "contract", "library": "library", "template": "template", "schema": "schema", "table": "table", "view": "view", "module": "namespace", "package": "namespace", "implementation": "class", "service": "interface", "inductive": "enum", "datatype": "enum", "message": "struct", "mod": "namespace", "abi": "interface", "impl": "class", "validator": "contract"}
_WORD_CALL = re.compile(r"(?<![\w.$:>@])(?P<new>new\s+)?(?P<path>(?:[A-Za-z_$][\w$]*(?:\.|::|->|:))*)(?P<name>[A-Za-z_$][\w$]*[!?]?)\s*\(")
_NOT_CALLED = frozenset("if for while switch catch return sizeof function fn func def fun sub match elif elsif elseif foreach using lock when and or not in new throw await typeof assert super require else do synchronized".split())
_NOT_DEFINED = frozenset("if for while switch catch return sizeof elif else elsif elseif match new throw await foreach using lock fixed synchronized unchecked checked do try when with".split())
#: Names before a parenthesis that belong to a unit's head, not to the unit.
_QUALIFIERS = frozenset("__attribute__ __declspec alignas _Alignas __asm__ asm decltype noexcept throw explicit extern requires".split())
_BEFORE = re.compile(r"(?P<mark>@?)(?<![\w$])(?<!::)(?P<name>~?[A-Za-z_$][\w$]*(?:\s*::\s*~?\w+)*)\s*\(")
_SELF = ("this.", "self.", "self::", "Self::", "$this->", "this->", "super.", "parent::")
_MARKED = ("@", "#[", "[", "//go:")


def cleaned(text: str, look: Look) -> tuple[str, str]:
    """The text with comments and strings blanked, and with comments alone blanked; lines and columns stay."""
    comments = [f"{re.escape(look.block[0])}[\\s\\S]*?(?:{re.escape(look.block[1])}|\\Z)"] if look.block else []
    comments += [(r"#(?!\[)" if c == "#" else re.escape(c)) + r"[^\n]*" for c in look.line_comments]
    strings = [rf"{q}(?:\\.|[^{q}\\\n])*{q}" if q != "`" else r"`(?:\\[\s\S]|[^`\\])*`" for q in look.quotes]
    pattern = "|".join([f"(?P<comment>{'|'.join(comments)})"] * bool(comments) + strings)
    if not pattern:
        return text, text
    clean, code, at = [], [], 0
    for m in re.finditer(pattern, text):
        between, blank = text[at : m.start()], re.sub(r"[^\n]", " ", m[0])
        clean += (between, blank)
        code += (between, blank if comments and m["comment"] is not None else m[0])
        at = m.end()
    return "".join((*clean, text[at:])), "".join((*code, text[at:]))


class Page:
    """Where things are in a cleaned text: lines, matched brackets, braces, and the ends of statements."""

    def __init__(self, clean: str):
        self.clean = clean
        self.starts = [0, *(m.end() for m in re.finditer("\n", clean))]
        self.pairs: dict[int, int] = {}
        self.braces: list[int] = []
        self.ends: list[int] = []
        self.semicolons: list[int] = []
        open_: list[tuple[str, int]] = []
        for m in re.finditer(r"[{}()\[\];]", clean):
            sign, at = m[0], m.start()
            if sign in "([{":
                open_.append((sign, at))
                if sign == "{":
                    self.braces.append(at)
                    self.ends.append(at + 1)
            elif sign == ";":
                if not open_ or open_[-1][0] == "{":
                    self.semicolons.append(at)
                    self.ends.append(at + 1)
            elif sign == "}":
                while open_ and open_[-1][0] != "{":
                    open_.pop()
                if open_:
                    self.pairs[open_.pop()[1]] = at
                self.ends.append(at + 1)
            elif open_ and open_[-1][0] == {")": "(", "]": "["}[sign]:
                self.pairs[open_.pop()[1]] = at

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at)
        return line, at - self.starts[line - 1]

    def statement(self, at: int) -> int:
        """Where the statement that holds a position begins."""
        k = bisect.bisect_right(self.ends, at)
        return self.ends[k - 1] if k else 0

    def body(self, at: int) -> tuple[int | None, int]:
        """The brace of the first body from ``at`` on and the end behind it; without body the end of the declaration."""
        k, j = bisect.bisect_left(self.braces, at), bisect.bisect_left(self.semicolons, at)
        brace = self.braces[k] if k < len(self.braces) else None
        semicolon = self.semicolons[j] if j < len(self.semicolons) else None
        if brace is None or semicolon is not None and semicolon < brace:
            return None, semicolon + 1 if semicolon is not None else len(self.clean)
        return brace, self.pairs.get(brace, len(self.clean) - 1) + 1


def _heads(page: Page, types: set[str]) -> Iterator[tuple[int, int, str, str | None]]:
    """(begin, end of the head, name, type that a qualified name is a member of) of what looks like a callable before its body, each statement looked at once."""
    for brace in page.braces:
        begin = page.statement(brace - 1) if brace else 0
        head = re.sub(r"(?m)^[ \t]*#[^\n]*|\b(?:public|private|protected|signals|slots)\s*:(?!:)", lambda m: " " * len(m[0]), page.clean[begin:brace])
        at = 0
        while m := _BEFORE.search(head, at):
            close = page.pairs.get(begin + m.end() - 1)
            if close is None or close >= brace:
                break
            at = close + 1 - begin
            last = re.split(r"\s*::\s*", m["name"])[-1]
            if m["mark"] or last in _QUALIFIERS or head.count("[", 0, m.start()) > head.count("]", 0, m.start()):
                continue
            before = re.sub(r"@[\w.]+\s*(?:\([^()]*\))?", " ", head[: m.start()]).strip()
            word = re.search(r"(\w+)$", before)
            typed = bool(re.search(r"[\w>*&\])]$", before)) and not (word and word[1] in _NOT_DEFINED)
            if last not in _NOT_DEFINED and ("=" not in before or "operator" in before) and (typed or "::" in m["name"] or not before and last.lstrip("~") in types):
                first = re.search(r"\S", head)
                owner = re.split(r"\s*::\s*", m["name"])[-2:-1]
                yield begin + (first.start() if first else 0), brace, last, owner[0] if owner else None
            break


_STATE = re.compile(r"(?:^|(?<=[;{}]))\s*(?P<type>mapping\s*\([^;{}]*?\)|[A-Za-z_][\w.]*(?:\[[^\]]*\])*)\s+(?P<mods>(?:(?:public|private|internal|constant|immutable|transient|override)\s+)*)(?P<name>[A-Za-z_]\w*)\s*(?:=[^;{}]*)?;")


def _state(rows: list[tuple], clean: str, path: str, place) -> Iterator[Fact]:
    """Storage variables of contracts, and which methods read and write them; constants are no storage."""
    for begin, head, end, own, kind, _ in rows:
        if kind not in ("contract", "library"):
            continue
        inner = [r for r in rows if r[4] == "method" and begin <= r[0] < end]
        body = list(clean[begin:end])
        for r in inner:
            body[r[0] - begin : r[2] - begin] = ["}" if c != "\n" else c for c in clean[r[0] : r[2]]]
        outer = "".join(body)
        for m in _STATE.finditer(outer, outer.find("{") + 1):
            if m["type"] in ("using", "import", "event", "error", "return", "function", "emit") or re.search("constant|immutable|transient", m["mods"]):
                continue
            line, col = place(begin + m.start("name"))
            var = f"{own}.{m['name']}"
            yield "nodes", {"id": var, "name": m["name"], "kind": "state_variable", "origin": "source", "language": "solidity", "file_path": path, "start_line": line, "end_line": line, "start_col": col, "attrs": "{}"}
            yield "edges", {"src": own, "dst": var, "kind": "contains", "confidence": "certain", "file_path": path, "start_line": line}
            name = re.escape(m["name"])
            write = re.compile(rf"(?:\b{name}\b(?:\s*\[[^\]]*\]|\.\w+)*\s*(?:[-+*/%|&^]|<<|>>)?=(?!=))|(?:\b{name}\b(?:\s*\[[^\]]*\]|\.\w+)*\s*(?:\+\+|--|\.push|\.pop))|(?:(?:\+\+|--|delete\s)\s*{name}\b)")
            for r in inner:
                text = clean[r[1] : r[2]]
                if re.search(rf"\b(?:[A-Za-z_]\w*(?:\[\])?)\s+(?:memory\s+|calldata\s+)?{name}\s*[,)=;]", clean[r[0] : r[2]]) and not re.search(rf"\breturn\s+{name}\b", text):
                    continue  # a parameter or local of that name hides it
                wrote = list(write.finditer(text))
                plain = [w for w in wrote if re.search(r"[^=!<>+*/%|&^-]=(?!=)$", w[0]) and "[" not in w[0]]
                if wrote:
                    yield "edges", {"src": r[3], "dst": var, "kind": "writes", "confidence": "certain", "file_path": path, "start_line": place(r[1] + wrote[0].start())[0]}
                reads = len(re.findall(rf"(?<![.\w]){name}\b", text)) - len(plain)
                if reads > 0:
                    yield "edges", {"src": r[3], "dst": var, "kind": "reads", "confidence": "certain", "file_path": path, "start_line": place(r[1])[0]}



_TYPED = re.compile(r"\b(?P<type>[A-Z]\w*)(?:<[^<>;{}()]*>)?[?&*]*\s+[&*]?(?P<var>[a-z_]\w*)\s*[=;,):]|\b(?P<var2>[a-z_]\w*)\s*:\s*[&*]?(?P<type2>[A-Z]\w*)|\b(?P<var3>[a-z_]\w*)\s*:?=\s*(?:await\s+)?(?:new\s+|&)?(?P<type3>[A-Z]\w*)(?:\.new)?\s*[({]")
_VALUE = re.compile(r"[(,]\s*&?(?P<name>[A-Za-z_$][\w$]*)\s*(?=[,)])")
_BASES = re.compile(r"(?:\b(?P<word>extends|implements|is|with)\b|(?<!:)(?P<sign>:)(?!:)|(?P<less><)(?=\s*[A-Z]))(?P<bases>[^{;\n]*)")
_BASE = re.compile(r"[A-Za-z_][\w.]*")
_NO_BASE = frozenset("extends implements public private protected virtual with is where class struct".split())
#: What raises, handles and cleans up; languages without it have no exception facts.
_RAISES = re.compile(r"\b(?P<how>throw|raise|revert|rethrow)\b(?![ \t]*:)[ \t]*(?:new[ \t]+)?(?P<thrown>[A-Za-z_][\w.:]*)?(?P<called>\s*[({])?|\b(?P<handler>catch|rescue)\b\s*(?:\(\s*(?:const\s+|final\s+)?(?P<caught>[\w.:|\s]*)[^()]*\)|(?P<rescued>[A-Z][\w:, \t]*))?|\b(?P<cleanup>finally|ensure)\b")
SCANNED_EVENTS = ("raise", "rethrow", "handler", "cleanup")
EXCEPTIONS = ("java", "c_sharp", "kotlin", "javascript", "typescript", "php", "cpp", "swift", "dart", "ruby", "solidity", "objc", "powershell", "vb")
_DECORATOR = re.compile(r"@[\w.:$]+[ \t]*(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?")
_REGISTERS = re.compile(r"\.(?:HandleFunc|Handle|HandlerFunc|GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|Any|Get|Post|Put|Delete|Patch|Head|Options|All|Methods)\s*\(\s*[^()\n]*?,(?P<given>[^\n]*)")
_IMPORTED = re.compile(r"""\bimport\s+(?:type\s+)?(?P<what>(?:(?!\bimport\b)[^;'"])*?)\s*from\s*['"](?P<from>[^'"\n]+)['"]|\b(?:const|let|var)\s+(?P<bound>[\w$]+|\{[^{}]*\})\s*=\s*require\s*\(\s*['"](?P<required>[^'"\n]+)['"]\s*\)""")


def _decorated(page: Page, code: str, look: Look, begin: int, stop: int) -> tuple[str, str]:
    """(decorators, signature) of a unit: what stands before and in its head, whitespace joined."""
    if look.marks:
        first = page.statement(begin)
    else:
        line = page.place(begin)[0] - 1
        first = max(page.starts[line], page.statement(begin))
        while first == page.starts[line] and line > 0 and code[page.starts[line - 1] : page.starts[line]].strip().startswith(_MARKED):
            line -= 1
            first = page.starts[line]
    marks, lines = [], []
    for line in code[first:stop].split("\n"):
        own = line.strip().removeprefix("<?php").strip()
        if re.match(r"#\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|region|endregion|error|line)\b", own):
            continue
        if own.startswith(("#[", "[", "//go:")):
            end = own.rfind("]") + 1 or len(own)
            marks.append(own[:end])
            own = own[end:].strip()
        found = _DECORATOR.findall(own) if "@" in own else []
        marks += found
        for mark in found:
            own = own.replace(mark, " ", 1).strip()
        if own:
            lines.append(" ".join(own.split()))
    return "\n".join(marks), " ".join(lines)


def _imports(code: str, path: str) -> dict[str, tuple[str, str | None]]:
    """What the names bound by relative imports of a script stand for: (module, exported name or None for all of it)."""
    found: dict[str, tuple[str, str | None]] = {}
    for m in _IMPORTED.finditer(code):
        source, what = m["from"] or m["required"], (m["what"] or m["bound"]).strip()
        if not source.startswith("."):
            continue
        module = module_id(posixpath.normpath(posixpath.join(posixpath.dirname(path), source + ("" if re.search(r"\.[cm]?[jt]sx?$", source) else ".js"))), "javascript")
        for a, alias in re.findall(r"([\w$]+)(?:\s*(?:\bas\b|:)\s*([\w$]+))?", "".join(re.findall(r"\{([^{}]*)\}", what))):
            found[alias or a] = (module, a)
        if star := re.search(r"\*\s*as\s+([\w$]+)", what):
            found[star[1]] = (module, None)
        if plain := re.match(r"(?!\{|\*)(?:type\s+)?([\w$]+)", what):
            found[plain[1]] = (module, None) if m["required"] else (module, plain[1])
    return found


def _exported(language: str, clean: str) -> set[str]:
    """Names that a module declares as exported, where that is a list."""
    if language == "erlang":
        return {n for part in re.findall(r"-export\(\[([^\]]*)\]", clean) for n in re.findall(r"([a-z]\w*)\s*/", part)}
    if language == "go":
        return {n for m in _REGISTERS.finditer(clean) for n in re.findall(r"([A-Za-z_]\w*)\s*[,)]", m["given"])}
    return set()


def facts(path: str, language: str, text: str, module: str | None = None) -> Iterator[Fact]:
    look = LOOKS.get(language, _DEFAULT)
    clean, code = cleaned(text, look)
    page = Page(clean)
    place, module = page.place, module or module_id(path, language)
    yield module_node(path, language, len(page.starts), module)
    if look.body == "brace" and (open_left := clean.count("{") - clean.count("}")):
        yield "diagnostics", {"language": language, "file_path": path, "start_line": len(page.starts), "kind": "unbalanced", "message": f"{abs(open_left)} braces are not {'closed' if open_left > 0 else 'opened'}"}
    for m in re.finditer(look.imports, code, re.M):
        yield "dependencies", {"name": m["name"]}
    found: list[tuple[int, int, str, str]] = []
    for m in re.finditer(look.types, clean, re.M):
        found.append((m.start(), m.end(), KINDS.get(m["kind"].lower(), "struct"), m["name"].strip('"')))
    types, members = {f[3] for f in found}, _members(language, page)
    for m in re.finditer(look.callables, clean, re.M):
        name = next((v for v in m.groupdict().values() if v), None)
        if name and name not in _NOT_DEFINED:
            found.append((m.start() + len(m[0]) - len(m[0].lstrip()), m.end() - (m[0][-1] in "{("), "procedure" if language == "sql" else "function", name.strip('"')))
    if look.heads:
        for begin, end, name, owner in _heads(page, types):
            found.append((begin, end, "function", name))
            members[begin] = owner
    if language == "circom" and (m := re.search(r"\bcomponent\s+main\b[^;]*", clean)):
        found.append((m.start(), m.end(), "function", "main"))
    found = sorted(set(found))
    units = list(_nested(page, look, found, module, {b: t for b, t in members.items() if t}))
    exported, known, bases = _exported(language, code), {}, {}
    owners: dict[str, dict] = {}
    for u in units:
        known.setdefault(u["name"], []).append(u)
        if u["kind"] in ("class", "interface", "contract", "trait", "struct", "library"):
            owners.setdefault(u["name"], u)
    for u in units:
        if u["member_of"]:
            u["owner"] = owners.get(u["member_of"], u["owner"])
    callables = [u for u in units if u["kind"] in ("function", "method", "procedure")]
    begins = [u["begin"] for u in callables]
    place_of = {u["id"]: k for k, u in enumerate(callables)}

    def inside(at: int) -> dict | None:
        """The innermost callable whose body holds a position."""
        k = bisect.bisect_right(begins, at) - 1
        u = callables[k] if k >= 0 else None
        while u is not None and not u["head"] <= at < u["end"]:
            u = u["within"]
        return u

    for u in callables:
        u["cc"], u["events"], u["vars"] = 1, [], {}
    for m in re.finditer(look.branches, clean):
        if u := inside(m.start()):
            u["cc"] += 1
    if language in EXCEPTIONS:
        for m in _RAISES.finditer(clean):
            if u := inside(m.start()):
                u["events"].append(_event(m, place(m.start())[0]))
    if look.bare:
        for m in _TYPED.finditer(clean):
            name, kind = next(((m[a], m[b]) for a, b in (("var", "type"), ("var2", "type2"), ("var3", "type3")) if m[a]), (None, None))
            u = inside(m.start()) or _callable_at(callables, begins, m.start())
            holder = u["vars"] if u else _owner_at(units, m.start()).setdefault("fields", {}) if _owner_at(units, m.start()) else None
            if holder is not None:
                holder.setdefault(name, kind)
    for u in units:
        brace = page.body(u["head"])[0] if look.body == "brace" else None
        line_end = clean.find("\n", u["head"])
        stop = brace if brace is not None and (look.marks or line_end < 0 or brace < line_end) else line_end if line_end >= 0 and not look.marks else u["end"] if brace is None and look.marks else len(clean)
        u["decorators"], u["signature"] = _decorated(page, code, look, u["begin"], max(u["head"], min(stop, len(clean))))
    for u in units:
        decorators, signature = u["decorators"], u["signature"]
        words = set(re.findall(r"\w+", re.sub(r"\(.*", "", signature))) | set(re.findall(r"\)\s*(?:\w+\s+)*?(external|public|private|internal)\b", signature))
        visibility = next((v for v in ("external", "public", "entry", "private", "internal", "pub") if v in words), "")
        owner = u["owner"] or {}
        attrs = {"decorators": decorators, "signature": signature, "visibility": visibility, "owner": f"{owner['kind']}: {owner['signature']}" if owner else "", "owner_decorators": owner.get("decorators", "")}
        if u["name"] in exported:
            attrs["exported"] = "true"
        if u["kind"] in ("class", "interface", "contract", "trait", "struct", "library"):
            bases[u["id"]] = _bases_of(language, signature)
        row = {"id": u["id"], "name": u["name"], "kind": u["kind"], "origin": "source", "language": language, "file_path": path, "start_line": u["line"], "end_line": place(max(u["begin"], u["end"] - 1))[0], "start_col": u["col"], "attrs": json.dumps({k: v for k, v in attrs.items() if v}, sort_keys=True)}
        if u["id"] in place_of:
            if language == "java" and (m := re.search(r"\bthrows\s+([\w., ]+)", signature)):
                u["events"].append({"kind": "declares", "line": u["line"], "syntax": "throws", "expression": None, "types": [t.strip() for t in m[1].split(",") if t.strip()], "region": None, "confidence": "certain"})
            row |= {"cc": u["cc"], "exception_events": u["events"], "exception_types": list(dict.fromkeys(t for e in u["events"] if e["kind"] == "raise" for t in e["types"]))}
        yield "nodes", row
        yield "edges", {"src": owner.get("id", module), "dst": u["id"], "kind": "contains", "confidence": "certain", "file_path": path, "start_line": u["line"]}
    if language == "solidity":
        yield from _state([(u["begin"], u["head"], u["end"], u["id"], u["kind"], u["name"]) for u in units], clean, path, place)
    for u in units:
        for kind, base in bases.get(u["id"], ()):
            yield "edges", {"src": u["id"], "dst": f"{module}:{base}", "kind": kind, "confidence": "inferred", "file_path": path, "start_line": u["line"]}
    if not look.bare:
        return
    # Callables given to calls as values.
    given = set()
    for m in _VALUE.finditer(clean):
        u = inside(m.start())
        if u is None or m["name"] in u["vars"]:
            continue
        own = [x for x in known.get(m["name"], ()) if x["kind"] in ("function", "method") and (x["owner"] is None or x["owner"] is u)]
        if len(own) == 1 and own[0] is not u and (u["id"], own[0]["id"]) not in given:
            given.add((u["id"], own[0]["id"]))
            yield "edges", {"src": u["id"], "dst": own[0]["id"], "kind": "references", "confidence": "inferred", "file_path": path, "start_line": place(m.start("name"))[0]}
    imported = _imports(code, path) if language in ("javascript", "typescript") else {}
    heads = {u["named"] for u in callables}
    for m in _WORD_CALL.finditer(clean):
        if m["name"] in _NOT_CALLED or m.end() - 1 in heads or m.end() in heads:
            continue
        u = inside(m.start())
        if u is None:
            continue
        target, confidence = _target(m, u, module, known, owners, bases, imported)
        yield "edges", {"src": u["id"], "dst": target, "kind": "calls", "confidence": confidence, "file_path": path, "start_line": place(m.start())[0]}


def _members(language: str, page: Page) -> dict[int, str]:
    """Begins of callables that stand outside their type, and the type's name: receivers and implementation blocks."""
    if language == "go":
        return {m.start(): m["type"] for m in re.finditer(r"(?m)^func\s+\(\s*(?:\w+\s+)?\*?(?P<type>\w+)[^()]*\)", page.clean)}
    if language != "rust":
        return {}
    out = {}
    for m in re.finditer(r"\bimpl\b(?:\s*<[^{};]*?>)?\s+(?:[\w:]+(?:<[^{};]*?>)?\s+for\s+)?(?:\w+::)*(?P<type>\w+)[^{};]*\{", page.clean):
        for f in re.compile(r"\bfn\s+\w+").finditer(page.clean, m.end(), page.pairs.get(m.end() - 1, len(page.clean))):
            out[f.start()] = m["type"]
    return out


def _nested(page: Page, look: Look, found: list[tuple[int, int, str, str]], module: str, members: dict[int, str]) -> Iterator[dict]:
    """Units in order, with their ends, ids, and the unit and the callable around each."""
    closers: dict[str, list[int]] = {}
    if look.body == "end":
        for m in re.finditer(r"(?im)^([ \t]*)end\b", page.clean):
            closers.setdefault(m[1], []).append(m.end())
    braced = look.body == "brace" and bool(page.braces)
    ended = [m.end() for m in re.finditer(r"@end\b", page.clean)]
    counts: dict[str, int] = {}
    open_: list[dict] = []
    for k, (begin, head, kind, name) in enumerate(found):
        if ended and page.clean[begin] == "@":
            j = bisect.bisect_right(ended, head)
            end = ended[j] if j < len(ended) else len(page.clean)
        elif braced:
            end = page.body(head)[1]
        elif look.body == "end":
            indent = re.compile(r"[ \t]*").match(page.clean, page.starts[page.place(begin)[0] - 1])[0]
            ends = closers.get(indent, [])
            j = bisect.bisect_right(ends, head)
            end = ends[j] if j < len(ends) else len(page.clean)
        else:
            end = found[k + 1][0] if k + 1 < len(found) else len(page.clean)
        while open_ and open_[-1]["end"] <= begin:
            open_.pop()
        owner = open_[-1] if open_ else None
        above = owner["kind"] if owner else "module"
        if kind == "function" and above not in ("module", "function", "method", "namespace"):
            kind = "method"
        own = f"{owner['id']}.{name}" if owner else f"{module}:{name}"
        member_of = members.get(begin) if above in ("module", "namespace") else None
        if member_of:
            kind, own = "method", f"{module}:{member_of}.{name}"
        line, col = page.place(begin)
        counts[own] = counts.get(own, 0) + 1
        if counts[own] > 1:
            own = f"{own}@{line}_{col}"
        within = owner if owner and owner["kind"] in ("function", "method", "procedure") else owner["within"] if owner else None
        paren = page.clean.find("(", begin, head + 1)
        named = page.clean.find(f"{name}", begin, head + 1)
        named = page.clean.find("(", named, named + len(name) + 8) if named >= 0 and paren >= 0 else -1
        unit = {"begin": begin, "head": head, "end": end, "kind": kind, "name": name, "id": own, "line": line, "col": col, "owner": owner, "within": within, "named": named, "member_of": member_of}
        yield unit
        if len(open_) < NESTING:
            open_.append(unit)


def _callable_at(callables: list[dict], begins: list[int], at: int) -> dict | None:
    """The callable whose head (its parameters) holds a position."""
    k = bisect.bisect_right(begins, at) - 1
    return callables[k] if k >= 0 and at < callables[k]["head"] else None


def _owner_at(units: list[dict], at: int) -> dict | None:
    """The innermost unit that is open at a position."""
    k = bisect.bisect_right([u["begin"] for u in units], at) - 1 if len(units) < 64 else _last_before(units, at)
    u = units[k] if k >= 0 else None
    while u is not None and not u["begin"] <= at < u["end"]:
        u = u["owner"]
    return u


def _last_before(units: list[dict], at: int) -> int:
    lo, hi = 0, len(units)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if units[mid]["begin"] <= at else (lo, mid)
    return lo - 1


def _event(m: re.Match, line: int) -> dict:
    event = {"line": line, "expression": None, "types": [], "region": None, "confidence": "certain"}
    if m["cleanup"]:
        return event | {"kind": "cleanup", "syntax": m["cleanup"]}
    if m["handler"]:
        caught = re.findall(r"[A-Z][\w.:]*", m["caught"] or m["rescued"] or "")
        return event | {"kind": "handler", "syntax": m["handler"], "types": caught}
    name = m["thrown"]
    if not name:
        return event | {"kind": "rethrow", "syntax": m["how"]}
    known = re.match(r"[A-Z]", re.split(r"\.|::", name)[-1])
    return event | {"kind": "raise", "syntax": m["how"], "expression": name, "types": [name] if known else [], "confidence": "certain" if known else "inferred"}


def _bases_of(language: str, signature: str) -> list[tuple[str, str]]:
    """(edge kind, base) in the order of a type's head."""
    head = re.sub(r"<[^<>]*>", "", re.sub(r"\([^()]*\)", "", signature))
    out = []
    for m in _BASES.finditer(re.sub(r"^.*?\b(?:class|interface|struct|contract|trait|protocol|extension)\b\s*", "", head, count=1)):
        for part in re.split(r"\b(implements|with)\b", m["bases"]):
            for base in _BASE.findall(part):
                if base not in _NO_BASE:
                    out.append(("inherits", base))
        break
    return list(dict.fromkeys(out))


def _lookup(owner: dict | None, name: str, known: dict, owners: dict, bases: dict) -> str | None:
    """The method of a name in a type or, nearest first, in the bases that the file has; the last base named is nearest."""
    todo, seen = [owner] if owner else [], set()
    while todo:
        at = todo.pop(0)
        if at["id"] in seen:
            continue
        seen.add(at["id"])
        own = [u for u in known.get(name, ()) if u["owner"] is at and u["kind"] == "method"]
        if own:
            return own[0]["id"]
        todo += [owners[b] for _, b in reversed(bases.get(at["id"], ())) if b in owners]
    return None


def _target(m: re.Match, u: dict, module: str, known: dict, owners: dict, bases: dict, imported: dict) -> tuple[str, str]:
    """(target, confidence) of a call: by receiver, own type and its bases, enclosing units, imports, the file."""
    path, name = m["path"], m["name"]
    holder = u
    while holder is not None and holder["kind"] in ("function", "method", "procedure"):
        holder = holder["owner"]
    for own in _SELF[:6]:
        if path.startswith(own) and path != own:
            path = path[len(own) :]
            break
    if path and path not in _SELF:
        first = re.match(r"[\w$]+", path)[0]
        if re.fullmatch(r"[\w$]+(?:\.|::|->|:)", path):
            at, kind = u, None
            while at is not None and kind is None:
                kind = at.get("vars", {}).get(first) or at.get("fields", {}).get(first)
                at = at["owner"]
            kind = kind or (first if first in owners else None)
            if kind in owners:
                hit = _lookup(owners[kind], name, known, owners, bases)
                return (hit, "inferred") if hit else (f"{kind}.{name}", "inferred")
            if first in imported:
                source, exported = imported[first]
                return f"{source}:{name if exported is None else f'{exported}.{name}'}", "inferred"
            if kind:
                return f"{kind}.{name}", "inferred"
        return path + name, "inferred"
    if path or holder is not None:
        hit = _lookup(holder, name, known, owners, bases)
        if hit:
            return hit, "certain"
        if path:
            return path + name, "inferred"
    # Enclosing callables first: a name nested in one hides those outside.
    at = u
    while at is not None:
        own = [x for x in known.get(name, ()) if x["owner"] is at and x["kind"] in ("function", "method")]
        if own:
            return own[0]["id"], "certain"
        at = at["owner"]
    ids = [x["id"] for x in known.get(name, ()) if x["kind"] in ("function", "method") and (x["owner"] is None or x["kind"] == "function")]
    if not ids and name in imported:
        source, exported = imported[name]
        return f"{source}:{exported or name}", "inferred"
    if not ids and name in owners:
        return owners[name]["id"], "certain"
    if len(ids) == 1:
        return ids[0], "certain"
    return f"{module}:{name}", "certain" if not ids else "uncertain"
