"""Source files to entities.

Python is read by its own parser.  TypeScript and Rust are read by a scanner that
knows strings, comments and nesting but no full grammar: it finds functions,
methods, types, constants and imports with their lines, arguments, calls,
decorators, routes, type references and constructor parameters, not inferred
types or macros.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.trees import language

ENTITY = "file_path string, kind string, name string, line_number int, end_line int, args array<struct<name: string, type: string, has_default: boolean, default_text: string>>, return_type string, doc string, is_exported boolean, is_async boolean, bases array<string>, callees array<string>, body_text string, content_hash string, spec string, imported array<string>, error string, decorators array<struct<name: string, args: array<string>>>, http_method string, route_path string, type_refs array<string>, extends array<string>, implements array<string>, params array<struct<name: string, type: string, inject_token: string>>"
COLUMNS = re.findall(r"(\w+) (?:string|int|boolean|array)", ENTITY)

# Calls that say nothing about a code base, names of types that
# are no entities of it, and decorators that make a method a route.
STOP_CALLS = set(
    "console.log console.warn console.error console.debug Math.max Math.min Math.abs Math.round Math.floor Math.ceil Math.random Math.log Math.sqrt Math.pow "
    "JSON.stringify JSON.parse Object.keys Object.values Object.entries Object.assign Array.isArray Array.from String Number Boolean parseInt parseFloat "
    "Date.now Promise.all Promise.resolve Promise.reject setTimeout setInterval clearTimeout clearInterval".split()
)
STOP_CALLS_PY = set(
    "print len range isinstance issubclass super str int float bool list dict set tuple enumerate zip map filter sorted getattr setattr hasattr open type repr format vars iter next min max sum abs round any all".split()
)
BUILTIN_TYPES = set(
    "Array Map Set Record Promise Partial Required Readonly Pick Omit Exclude Extract NonNullable ReturnType InstanceType Parameters ConstructorParameters Awaited ReadonlyArray ReadonlyMap "
    "ReadonlySet WeakMap WeakSet Buffer Date RegExp Error String Number Boolean Object Symbol Function Uint8Array Int8Array Float32Array Float64Array ArrayBuffer SharedArrayBuffer JSX React Element".split()
)
TYPING_NAMES = set("List Dict Set Tuple Optional Union Any Callable Iterable Iterator Sequence Mapping Type Literal Annotated ClassVar Final Self None True False".split())
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
ROUTE_DECORATORS = {v.capitalize(): v.upper() for v in (*HTTP_VERBS, "all")}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _row(path: str, kind: str, name: str, line: int, end: int, body: str = "", **more) -> dict:
    base = {"file_path": path, "kind": kind, "name": name, "line_number": line, "end_line": end, "args": [], "return_type": None, "doc": None, "is_exported": False, "is_async": False, "bases": [], "callees": [], "body_text": body, "content_hash": digest(body), "spec": None, "imported": [], "error": None, "decorators": [], "http_method": None, "route_path": None, "type_refs": [], "extends": [], "implements": [], "params": []}
    return base | more


def _dotted(n: ast.AST) -> str | None:
    """``a.b.c`` of a chain of names, None for anything else."""
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else None


def _python_route(n) -> dict:
    """Method and path of the first decorator that makes a function a route:
    ``@x.get("/p")`` or ``@x.route("/p", methods=["POST"])``."""
    for d in n.decorator_list:
        name = d.func.attr if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) else d.func.id if isinstance(d, ast.Call) and isinstance(d.func, ast.Name) else ""
        path = d.args[0].value if name and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str) else None
        if path is None:
            continue
        if name.lower() in HTTP_VERBS:
            return {"http_method": name.upper(), "route_path": path}
        if name.lower() == "route":
            given = [k.value.elts for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))]
            first = next((e.value for elts in given for e in elts[:1] if isinstance(e, ast.Constant) and isinstance(e.value, str)), "GET")
            return {"http_method": first.upper(), "route_path": path}
    return {}


def parse_python(path: str, text: str) -> list[dict]:
    """Entities of a Python file (O-05); raises SyntaxError on a broken one."""
    tree = ast.parse(text)
    rows: list[dict] = []

    def source(n: ast.AST) -> str:
        return ast.get_source_segment(text, n) or ""

    def calls(n: ast.AST) -> list[str]:
        names = (_dotted(x.func) for part in n.body for x in ast.walk(part) if isinstance(x, ast.Call))
        bare = (re.sub(r"^(?:self|cls)\.", "", c) for c in names if c)
        return list(dict.fromkeys(c for c in bare if len(c) <= 80 and c not in STOP_CALLS_PY))

    def decorators(n) -> list[dict]:
        parts = [(d.func, d.args) if isinstance(d, ast.Call) else (d, []) for d in n.decorator_list]
        return [{"name": _dotted(f) or source(f), "args": [a.value if isinstance(a, ast.Constant) and isinstance(a.value, str) else source(a) for a in args]} for f, args in parts]

    def types(*notes: ast.AST | None) -> list[str]:
        named = (x.id if isinstance(x, ast.Name) else x.attr for n in notes if n is not None for x in ast.walk(n) if isinstance(x, (ast.Name, ast.Attribute)))
        return sorted({t for t in named if t[:1].isupper() and t not in TYPING_NAMES})

    def function(n, owner: str) -> None:
        a = n.args
        every = [*a.posonlyargs, *a.args]
        late: list = [None] * (len(every) - len(a.defaults)) + list(a.defaults)
        pairs = [*zip(every, late, strict=True), *zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        args = [{"name": x.arg, "type": source(x.annotation) if x.annotation else "", "has_default": d is not None, "default_text": source(d) if d is not None else None} for x, d in pairs if x.arg not in ("self", "cls")]
        rows.append(_row(path, "function", f"{owner}{n.name}", n.lineno, n.end_lineno, source(n), args=args, return_type=source(n.returns) if n.returns else "", doc=ast.get_docstring(n), is_exported=not n.name.startswith("_"), is_async=isinstance(n, ast.AsyncFunctionDef), callees=calls(n), decorators=decorators(n), type_refs=types(*(x.annotation for x, _ in pairs if x.arg not in ("self", "cls")), n.returns), **_python_route(n)))

    for n in tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(n, "")
        elif isinstance(n, ast.ClassDef):
            bases = [_dotted(b) or source(b) for b in n.bases]
            init = next((m.args for m in n.body if isinstance(m, ast.FunctionDef) and m.name == "__init__"), None)
            params = [{"name": x.arg, "type": source(x.annotation) if x.annotation else "", "inject_token": None} for x in ([*init.posonlyargs, *init.args, *init.kwonlyargs] if init else ()) if x.arg not in ("self", "cls")]
            rows.append(_row(path, "class", n.name, n.lineno, n.end_lineno, source(n), doc=ast.get_docstring(n), is_exported=not n.name.startswith("_"), bases=bases, extends=bases[:1], implements=bases[1:], decorators=decorators(n), params=params))
            for m in n.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(m, f"{n.name}.")
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                if isinstance(t, ast.Name) and t.id.isupper():
                    rows.append(_row(path, "const", t.id, n.lineno, n.end_lineno, source(n), is_exported=True))
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            rows += [_row(path, "import", a.name, n.lineno, n.end_lineno, spec=a.name) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            spec = "." * n.level + (n.module or "")
            rows.append(_row(path, "import", spec, n.lineno, n.end_lineno, spec=spec, imported=[a.name for a in n.names]))
    return rows


_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`")
_SKIP_RS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|b?r(#*)\"[\s\S]*?\"\1|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n]{1,8}|[^'\\\n])'")
_TS_FN = re.compile(r"(?P<exp>export\s+(?:default\s+)?)?(?P<asy>async\s+)?function\s*\*?\s*(?P<n1>[\w$]+)\s*(?:<[^>(]*>)?\((?P<a1>[^)]*)\)\s*(?::\s*(?P<r1>[^={;]+?))?\s*\{|(?P<exp2>export\s+)?(?:const|let)\s+(?P<n2>[\w$]+)\s*(?::[^=]+)?=\s*(?P<asy2>async\s+)?\((?P<a2>[^)]*)\)\s*(?::\s*(?P<r2>[^=]+?))?\s*=>\s*\{")
_TS_METHOD = re.compile(r"(?:^|\n)[ \t]*(?:(?:public|private|protected|static|readonly|override|abstract)\s+)*(?P<asy>async\s+)?(?:get\s+|set\s+)?(?P<n>[\w$]+)\s*(?:<[^>(]*>)?\((?P<a>[^)]*)\)\s*(?::\s*(?P<r>[^={;]+?))?\s*\{")
_TS_TYPE = re.compile(r"(?P<exp>export\s+(?:default\s+)?)?(?:abstract\s+)?(?:declare\s+)?(?P<k>class|interface|enum)\s+(?P<n>[\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+(?P<e>[\w$.,\s<>]+?))?(?:\s+implements\s+(?P<i>[\w$.,\s<>]+?))?\s*\{|(?P<exp2>export\s+)?type\s+(?P<n2>[\w$]+)\s*(?:<[^=]*>)?=")
_TS_CONST = re.compile(r"(?m)^(?P<exp>export\s+)?const\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=(?!\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=\n]+)?=>)")
_TS_IMPORT = re.compile(r"import\s+(?:type\s+)?(?:(?P<d>[\w$]+)\s*,?\s*)?(?:\{(?P<n>[^}]*)\}|\*\s+as\s+(?P<s>[\w$]+))?\s*(?:from\s*)?['\"](?P<m>[^'\"]+)['\"]")
_RS_FN = re.compile(r"(?P<exp>pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?P<asy>async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<n>\w+)\s*(?:<[^>(]*>)?\((?P<a>[^)]*)\)\s*(?:->\s*(?P<r>[^{;]+?))?\s*(?:where[^{]*)?\{")
_RS_TYPE = re.compile(r"(?P<exp>pub(?:\([^)]*\))?\s+)?(?P<k>struct|enum|trait|union)\s+(?P<n>\w+)")
_RS_IMPL = re.compile(r"\bimpl\b(?:<[^{]*?>)?\s+(?:(?P<t>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?P<n>[\w:]+)(?:<[^{]*?>)?\s*(?:where[^{]*)?\{")
_RS_MOD = re.compile(r"(?P<cfg>#\[cfg\(test\)\]\s*)?(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)\s*\{")
_RS_CONST = re.compile(r"(?P<exp>pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<n>[A-Z_][A-Z0-9_]*)\s*:")
_RS_USE = re.compile(r"\buse\s+(?P<m>[\w:]+?)(?:::\{(?P<l>[^}]*)\})?(?:\s+as\s+\w+)?\s*;")
_CALL = re.compile(r"(?<![\w$.])((?:[\w$]+(?:\.|::))*[\w$]+)\s*\(")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "match", "fn", "await", "constructor", "typeof", "new", "loop"}


def blanked(text: str, skip: re.Pattern) -> str:
    """The text with strings and comments blanked out, line breaks kept."""
    return skip.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(code: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def _args(text: str) -> list[dict]:
    out, depth, part = [], 0, ""
    for c in text + ",":
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth <= 0:
            p = part.strip()
            if p and p not in ("self", "&self", "&mut self", "mut self") and not p.startswith("this:"):
                head, eq, default = p.partition("=")
                name, _, kind = head.partition(":")
                out.append({"name": re.sub(r"^(?:mut|public|private|readonly)\s+", "", name.strip()).rstrip("?"), "type": kind.strip(), "has_default": bool(eq), "default_text": default.strip() or None})
            part = ""
        else:
            part += c
    return out


def _doc(text: str, at: int, rust: bool) -> str | None:
    before = text[:at].rstrip()
    before = re.sub(r"(?:(?:@[\w.]+(?:\([^)]*\))?|#\[[^\]]*\]|export|default|pub(?:\([^)]*\))?|async|public|private|static)\s*)+$", "", before).rstrip()
    if before.endswith("*/"):
        start = before.rfind("/**")
        return before[start:] if start >= 0 and "*/" not in before[start:-2] else None
    if rust:
        lines = re.search(r"((?:^[ \t]*///[^\n]*\n?)+)\Z", before + "\n", re.M)
        return lines[1].strip() if lines else None
    return None


def _callees(code: str, stop: set[str] = STOP_CALLS) -> list[str]:
    found = (re.sub(r"^(?:this|self)\.", "", c) for c in _CALL.findall(code))
    return list(dict.fromkeys(c for c in found if c not in stop and c.split(".")[-1].split("::")[-1] not in _WORDS and len(c) <= 80))


_DECORATOR = re.compile(r"(?<![\w$@])@(?P<n>[A-Za-z_$][\w$.]*)")


def _decorators(text: str, code: str) -> tuple[str, list[tuple[int, int, dict]]]:
    """The code with its decorators blanked out, and each with where it begins
    and where what it decorates begins."""
    found, chars = [], list(code)
    for m in _DECORATOR.finditer(code):
        end, args = m.end(), []
        if code[end : end + 1] == "(":
            depth, begin = 0, end + 1
            for i in range(end, len(code)):
                depth += (code[i] in "([{") - (code[i] in ")]}")
                if depth == 0 or depth == 1 and code[i] == ",":
                    part = text[begin:i].strip()
                    if part:
                        args.append(re.sub(r"^['\"`](.*)['\"`]$", r"\1", part, flags=re.S))
                    begin = i + 1
                if depth == 0:
                    end = i + 1
                    break
        for i in range(m.start(), end):
            chars[i] = "\n" if chars[i] == "\n" else " "
        found.append((m.start(), end, {"name": m["n"], "args": args}))
    plain = "".join(chars)
    return plain, [(a, z + len(plain[z:]) - len(plain[z:].lstrip()), d) for a, z, d in found]


def _type_refs(args: list[dict], returns: str) -> list[str]:
    """Names with a capital in the types of a signature that are no built-in ones
    (O-109), in order."""
    found = re.findall(r"\b[A-Z][A-Za-z0-9]+\b", " ".join([*(a["type"] for a in args), returns]))
    return list(dict.fromkeys(t for t in found if t not in BUILTIN_TYPES))


def _route(decorators: list[dict], prefix: str) -> dict:
    """Method and path of a controller's method (O-107)."""
    for d in decorators:
        if d["name"] in ROUTE_DECORATORS:
            parts = [p for p in (prefix, d["args"][0] if d["args"] else "") if p]
            return {"http_method": ROUTE_DECORATORS[d["name"]], "route_path": "/" + re.sub(r"/+", "/", "/".join(parts)).strip("/")}
    return {}


def _parameters(code: str, begin: int, end: int, decorators: list[tuple[int, int, dict]]) -> list[dict]:
    """Constructor parameters with the token of an ``@Inject`` before them."""
    out, at, depth = [], begin, 0
    for i in range(begin, end + 1):
        if i == end or code[i] == "," and depth == 0:
            inject = next((d["args"] for a, _, d in decorators if at <= a < i and d["name"] == "Inject"), [])
            out += [{"name": re.sub(r"^(?:(?:public|private|protected|readonly|override)\s+)+", "", x["name"]), "type": x["type"], "inject_token": inject[0] if inject else None} for x in _args(code[at:i])]
            at = i + 1
        elif i < end:
            depth += (code[i] in "([{<") - (code[i] in ")]}>")
    return out


def parse_typescript(path: str, text: str) -> list[dict]:
    """Entities of a TypeScript file (O-04)."""
    code, marked = _decorators(text, blanked(text, _SKIP))
    on = lambda at: [d for _, z, d in marked if z == at]
    line = lambda i: text.count("\n", 0, i) + 1
    rows: list[dict] = []
    inside: list[tuple[int, int]] = []
    for m in _TS_TYPE.finditer(code):
        end = _close(code, m.end() - 1) if m["n"] else (code.find(";", m.end()) + 1 or len(code))
        split = lambda s: [re.sub(r"<.*", "", x).strip() for x in (s or "").split(",") if x.strip()]
        rows.append(_row(path, m["k"] or "type", m["n"] or m["n2"], line(m.start()), line(end), text[m.start() : end], is_exported=bool(m["exp"] or m["exp2"]), doc=_doc(text, m.start(), False), bases=split(m["e"]) + split(m["i"]), extends=split(m["e"]), implements=split(m["i"]), decorators=on(m.start())))
        if m["k"] == "class":
            of_class = rows[-1]
            prefix = next((d["args"][0] for d in of_class["decorators"] if d["name"] == "Controller" and d["args"]), "")
            inside.append((m.start(), end))
            body = code[m.end() : end]
            for x in _TS_METHOD.finditer(body):
                if x["n"] in _WORDS - {"constructor"} or body[: x.start("n")].count("{") != body[: x.start("n")].count("}"):
                    continue
                a = m.end() + x.start("n")
                z = _close(code, m.end() + x.end() - 1)
                if x["n"] == "constructor":
                    of_class["params"] = _parameters(code, m.end() + x.start("a"), m.end() + x.end("a"), marked)
                head = m.end() + x.start() + len(x[0]) - len(x[0].lstrip())
                args, returns, decorated = _args(x["a"]), (x["r"] or "").strip(), on(head)
                rows.append(_row(path, "function", f"{m['n']}.{x['n']}", line(a), line(z), text[a:z], args=args, return_type=returns, is_exported=bool(m["exp"]), is_async=bool(x["asy"]), doc=_doc(text, m.end() + x.start("n"), False), callees=_callees(code[m.end() + x.end() : z]), decorators=decorated, type_refs=_type_refs(args, returns), **_route(decorated, prefix)))
    for m in _TS_FN.finditer(code):
        if any(a < m.start() < z for a, z in inside):
            continue
        z = _close(code, m.end() - 1)
        k = "1" if m["n1"] else "2"
        args, returns = _args(m["a" + k]), (m["r" + k] or "").strip()
        rows.append(_row(path, "function", m["n" + k], line(m.start()), line(z), text[m.start() : z], args=args, return_type=returns, type_refs=_type_refs(args, returns), is_exported=bool(m["exp"] or m["exp2"]), is_async=bool(m["asy"] or m["asy2"]), doc=_doc(text, m.start(), False), callees=_callees(code[m.end() : z])))
    for m in _TS_CONST.finditer(code):
        z = code.find(";", m.end()) + 1 or len(code)
        rows.append(_row(path, "const", m["n"], line(m.start()), line(z), text[m.start() : z], is_exported=bool(m["exp"])))
    plain = re.sub(r"//[^\n]*|/\*[\s\S]*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in _TS_IMPORT.finditer(plain):
        names = [re.sub(r"^type\s+", "", x.strip()).split(" as ")[0].strip() for x in (m["n"] or "").split(",") if x.strip()]
        rows.append(_row(path, "import", m["m"], line(m.start()), line(m.end()), spec=m["m"], imported=[x for x in (m["d"], *names, m["s"]) if x]))
    return rows


def parse_rust(path: str, text: str) -> list[dict]:
    """Entities of a Rust file (O-06): methods are ``Type.method``, items of inline
    modules ``mod::Item``; what is compiled for tests only is left out."""
    code = blanked(text, _SKIP_RS)
    line = lambda i: text.count("\n", 0, i) + 1
    for m in list(_RS_MOD.finditer(code)):
        if m["cfg"]:
            z = _close(code, m.end() - 1)
            code = code[: m.start()] + re.sub(r"[^\n]", " ", code[m.start() : z]) + code[z:]
    mods = [(m.start(), _close(code, m.end() - 1), m["n"]) for m in _RS_MOD.finditer(code)]
    impls = [(m.start(), _close(code, m.end() - 1), m["n"].split("::")[-1], m["t"]) for m in _RS_IMPL.finditer(code)]
    rows: list[dict] = []

    def prefix(at: int) -> str:
        return "".join(f"{n}::" for a, z, n in mods if a < at < z)

    traits: dict[str, list[str]] = {}
    for _, _, n, t in impls:
        if t:
            traits.setdefault(n, []).append(t.split("::")[-1])
    for m in _RS_TYPE.finditer(code):
        brace, semi = code.find("{", m.end()), code.find(";", m.end())
        z = semi + 1 if semi >= 0 and (brace < 0 or semi < brace) else _close(code, brace) if brace >= 0 else len(code)
        rows.append(_row(path, m["k"], prefix(m.start()) + m["n"], line(m.start()), line(z), text[m.start() : z], is_exported=bool(m["exp"]), doc=_doc(text, m.start(), True), bases=traits.get(m["n"], []), implements=traits.get(m["n"], [])))
    for m in _RS_FN.finditer(code):
        z = _close(code, m.end() - 1)
        owner = next((n for a, e, n, _ in reversed(impls) if a < m.start() < e), None)
        name = f"{owner}.{m['n']}" if owner else m["n"]
        args, returns = _args(m["a"]), (m["r"] or "").strip()
        rows.append(_row(path, "function", prefix(m.start()) + name, line(m.start()), line(z), text[m.start() : z], args=args, return_type=returns, is_exported=bool(m["exp"]), is_async=bool(m["asy"]), doc=_doc(text, m.start(), True), callees=_callees(code[m.end() : z], set()), type_refs=_type_refs(args, returns)))
    for m in _RS_CONST.finditer(code):
        z = code.find(";", m.end()) + 1 or len(code)
        rows.append(_row(path, "const", prefix(m.start()) + m["n"], line(m.start()), line(z), text[m.start() : z], is_exported=bool(m["exp"])))
    for m in _RS_USE.finditer(code):
        names = [x.strip() for x in (m["l"] or "").split(",") if x.strip()]
        spec = m["m"] if m["l"] is not None else m["m"].rpartition("::")[0] or m["m"]
        rows.append(_row(path, "import", spec, line(m.start()), line(m.end()), spec=spec, imported=names or [m["m"].rpartition("::")[2]]))
    return rows


_PARSERS = {"py": parse_python, "ts": parse_typescript, "rs": parse_rust}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[dict] = []
        for path, lang, text in zip(pdf["file_path"], pdf["_lang"], pdf["text"], strict=True):
            try:
                rows += _PARSERS[lang](path, text or "")
            except Exception as e:  # a bad file must not end the batch (O-08)
                rows.append(_row(path, "error", "", 0, 0, error=f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=COLUMNS)


def parse_sources(files: DataFrame) -> DataFrame:
    """Entities of all files (``file_path, text``) in one table (O-04 to O-08): a
    file that can't be parsed gives one row with its ``error``."""
    f = files.withColumn("_lang", language(F.col("file_path"))).filter("_lang is not null").select("file_path", "_lang", "text")
    return f.mapInPandas(_parse, ENTITY)
