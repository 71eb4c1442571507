"""Functions paired with their documentation.

Source blocks are scanned once for declarations with the comment or docstring
attached to each, and for class headers.  Documentation is resolved in order:
the stored text, the one in the code, then, for functions left without any or
with a mere pointer, the one of the method they override, joined level by level
up the class hierarchy.
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import checkpoint, latest

# ---------------------------------------------------------------- scanning

#: Comments, strings and structure of TypeScript and Rust, in order of attempt.
_TS = re.compile(r"(?P<doc>/\*\*(?!/)[\s\S]*?\*/)|(?P<com>//[^\n]*|/\*[\s\S]*?\*/)|(?P<str>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\[\s\S]|[^`\\])*`)|(?P<re>(?<=[=(,:!&|?;])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/)|(?P<p>[{}()\[\];])")
_RS = re.compile(r"(?P<doc>///(?!/)[^\n]*|/\*\*(?![*/])[\s\S]*?\*/)|(?P<com>//[^\n]*|/\*[\s\S]*?\*/)|(?P<attr>#\[doc\s*=\s*r?#*\"(?:\\.|[^\"\\])*\"#*\s*\])|(?P<str>b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n]{1,8}|[^'\\\n])')|(?P<p>[{}()\[\];])")
_TS_NAME = re.compile(r"(?:^|\s)(?:function\s*\*?\s*)?([A-Za-z_$#][\w$]*)\s*(?:<[^(]*>)?\s*\(|(?:^|\s)(?:const|let|var)?\s*([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\b\s*)?(?:function\b|\(|[\w$]+\s*=>)")
_RS_NAME = re.compile(r"\bfn\s+(?:r#)?([A-Za-z_]\w*)")
_CLASS = re.compile(r"\b(?:class|interface)\s+([\w$]+)(?:<[^{]*?>)?(?:\s+extends\s+([\w$.]+))?(?:<[^{]*?>)?(?:\s+implements\s+([\w$.,\s<>]+))?|\b(impl|trait)\b(?:<[^{]*?>)?\s+(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?([\w:]+)")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "await", "new", "super", "typeof", "import", "throw"}


def _unquote(attr: str) -> str:
    body = re.search(r'"((?:\\.|[^"\\])*)"', attr)
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), body[1]) if body else ""


def scan_braces(text: str, lang: str, in_class: bool) -> tuple[list[tuple[str, str, str]], list[str]]:
    """``(name, code, doc)`` of the functions of a block in TypeScript or Rust,
    and the bases its class header names."""
    token, names = (_RS, _RS_NAME) if lang == "rs" else (_TS, _TS_NAME)
    level = 1 if in_class else 0
    found: list[tuple[str, str, str]] = []
    bases: list[str] = []
    stack: list[str] = []
    docs: list[str] = []
    header: list[str] = []
    begin = at = 0
    open_fn: tuple[str, str, int] | None = None
    for m in token.finditer(text):
        depth = len(stack)
        if depth == level and open_fn is None:
            header.append(text[at : m.start()])
        elif in_class and depth == 0:
            header.append(text[at : m.start()])
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "h" else "str"
        if kind in ("doc", "attr"):
            if depth == level and open_fn is None:
                if not docs:
                    begin = m.start()
                docs.append(_unquote(m[0]) if kind == "attr" else m[0])
            continue
        if kind != "p":
            continue
        c = m[0]
        if c in "([":
            if depth == level and open_fn is None:
                header.append(c)
            stack.append(c)
        elif c in ")]":
            if stack:
                stack.pop()
            if len(stack) == level and open_fn is None:
                header.append(c)
        elif c == "{":
            if depth == 0 and in_class:
                h = _CLASS.search("".join(header))
                if h:
                    bases += re.findall(r"[\w$]+(?=\s*(?:<|,|$))", ", ".join(x for x in (h[2], h[3], h[5]) if x))
                docs, header, begin = [], [], m.end()
            elif depth == level and open_fn is None:
                text_before = re.sub(r"@[\w.]+\s*(\(\))?", " ", "".join(header))
                n = names.search(text_before)
                name = n and next((g for g in n.groups() if g), None)
                if name and name not in _NOT_NAMES:
                    start = begin if docs else begin + len(text[begin : m.start()]) - len(text[begin : m.start()].lstrip())
                    open_fn = (name, "\n".join(docs), start)
            stack.append(c)
        elif c == "}":
            while stack and stack[-1] != "{":
                stack.pop()
            if stack:
                stack.pop()
            if len(stack) == level:
                if open_fn:
                    found.append((open_fn[0], text[open_fn[2] : m.end()], open_fn[1]))
                open_fn, docs, header, begin = None, [], [], m.end()
        elif c == ";" and depth == level and open_fn is None:
            n = names.search("".join(header))
            name = n and next((g for g in n.groups() if g), None)
            if name and name not in _NOT_NAMES:
                # a signature without a body, or an arrow function whose body is an expression
                found.append((name, text[begin : m.end()], "\n".join(docs)))
            docs, header, begin = [], [], m.end()
        if not in_class and found and open_fn is None:
            break
    if open_fn:
        found.append((open_fn[0], text[open_fn[2] :], open_fn[1]))
    return found, bases


_PY_DEF = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(")
_PY_DOC = re.compile(r"(?s)\A\s*(?:#[^\n]*\n\s*)*[rRuU]?(\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:\\.|[^\"\\\n])*)\"|'((?:\\.|[^'\\\n])*)')")


def scan_python(text: str, in_class: bool) -> tuple[list[tuple[str, str, str]], list[str]]:
    """The same for Python, by its own parser; text it can't parse is scanned
    by indentation."""
    source = textwrap.dedent(text)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        found = []
        spans = list(_PY_DEF.finditer(source))
        for i, m in enumerate(spans):
            body = source[m.start() : spans[i + 1].start() if i + 1 < len(spans) else len(source)]
            colon = re.search(r"\)[^\n]*?:[ \t]*(?:#[^\n]*)?(?=\n|$)|\)[^\n:]*:", body)
            doc = _PY_DOC.match(body[colon.end() :]) if colon else None
            found.append((m[2], body, next((g for g in doc.groups()[1:] if g is not None), "") if doc else ""))
        head = re.search(r"class\s+\w+\s*\(([^)]*)\)", source)
        return found, re.findall(r"(\w+)\s*(?:,|$)", head[1]) if head and in_class else []
    found, bases = [], []
    nodes: list[ast.AST] = list(tree.body)
    if in_class:
        classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
        bases = [b.attr if isinstance(b, ast.Attribute) else b.id for n in classes[:1] for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
        nodes = [x for n in classes[:1] for x in n.body]
    for n in nodes:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            doc = ast.get_docstring(n, clean=False) or ""
            found.append((n.name, ast.get_source_segment(source, n) or "", doc))
    return found, bases


# ---------------------------------------------------------------- judging

_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*\*+(?!/)|\*+/|///?!?|//!|\*(?!\*)|\*\*+$)[ \t]?|\*+/[ \t]*$|^[ \t]*(?:\"\"\"|''')|(?:\"\"\"|''')[ \t]*$")
_RUST_DOC = re.compile(r"(?m)^\s*#!?\[doc\s*=\s*r?#*\"((?:\\.|[^\"\\])*)\"#*\s*\]\s*$")
_KEEP_TAGS = {"description", "desc", "summary", "remarks", "brief", "note", "details"}
_SECTION = re.compile(r"(?i)^\s*(?:#+\s*)?(args|arguments|parameters|params|other parameters|keyword args|keyword arguments|returns?|yields?|raises|throws|exceptions?|errors|panics|safety|attributes)\s*:?\s*$")
_SECTION_INLINE = re.compile(r"(?i)^\s*(args|arguments|parameters|params|returns|yields|raises|throws|errors|panics)\s*:\s*\S")
_FIELD = re.compile(r"^\s*:(?:param|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|except|exception|yields?|throws)\b[^:]*:")
_PLACEHOLDER_LINE = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|tbd|tba|hack|wip)\b")
#: Sentences that say there is no documentation, point elsewhere, or say the code was generated.
_PLACEHOLDER = re.compile(
    r"(?i)^\W*(?:(?:no|missing|without)\s+(?:\w+\s+)?(?:description|documentation|docs?|comment|summary)\b.*"
    r"|(?:please\s+)?(?:add|insert|put|write|provide|enter|fill in|describe)\s+(?:an?\s+|the\s+|your\s+|some\s+)?(?:\w+\s+)?(?:description|documentation|docs?|comment|summary|docstring|text)\b.*"
    r"|(?:the\s+|a\s+)?(?:description|documentation|docs?|summary|text|comment)\s+(?:goes|go|comes|is|are|to|will|missing|pending|needed|here|follows)\b.*"
    r"|(?:to be|not yet)\s+(?:documented|done|written|described|defined).*"
    r"|(?:undocumented|not documented|lorem ipsum|placeholder|dummy|n/?a|none|empty|stub|coming soon|work in progress|method stub|your (?:description|docs?|documentation|comment)|fill me in|docs? (?:later|missing|pending|to follow))\b.*)$"
)
_POINTER = re.compile(
    r"(?i)^\W*(?:\{@inheritdoc.*?\}|inheritdoc|inherited from|inherits? (?:the )?(?:doc|documentation|description)|(?:please\s+)?(?:see|refer|cf|compare|consult|vgl|siehe|voir|voyez|check)\b"
    r"|(?:same|identical|equal) (?:as|to)\b|(?:documented|described|explained) (?:in|at|by|on|under|elsewhere)\b|(?:for|more) (?:details|information|docs|documentation)\b.{0,40}\bsee\b|as (?:documented|described|explained) (?:in|at|by|on)\b|overrid(?:es|den|e)\s+(?:the\s+)?(?:base|super|parent|method|from)\b|docs? (?:are|is) in\b|alias (?:of|for)\b).*$"
)
_GENERATED = re.compile(
    r"(?i)^\W*(?:this\s+|the\s+|these\s+)?(?:\w+\s+){0,2}?(?:(?:is|was|were|are|has been|have been)\s+)?(?:auto(?:matically)?[\s-]*)generated\b.*"
    r"|^\W*(?:this|the)\s+(?:\w+\s+){0,2}(?:is|was|were|are|has been|have been)\s+generated\b.*|^\W*generated\s+(?:by|from|with|code|file|using|on|automatically|via|method|class|function)\b.*|^\W*code generated\b.*"
    r"|.*\b(?:do not|don't|never) (?:edit|modify|change|touch)\b.*|.*\b(?:edits?|changes?|modifications?)\b.{0,30}\b(?:lost|overwritten|discarded)\b.*"
)
_WORD = re.compile(r"[^\W_][\w'’]*(?:-[^\W_]\w*)*|\w+")
_FILLER = {"a", "an", "the", "this", "that", "these", "it", "its", "function", "method", "func", "fn", "procedure", "routine", "helper", "simply", "just"}


def description(doc: str | None) -> str:
    """What is left of a documentation without comment marks, without tags and
    sections on parameters, results and errors, and without placeholders,
    pointers and notices about generated code."""
    if not doc:
        return ""
    text = _RUST_DOC.sub(lambda m: re.sub(r"\\(.)", r"\1", m[1]), doc.replace("\r\n", "\n"))
    text = _MARKS.sub("", text)
    text = re.sub(r"\{@(?:link|code|linkcode|linkplain|literal)\s+([^}|]*)(?:\|[^}]*)?\}", r"\1", text)
    kept: list[str] = []
    skipping: str | None = None
    indent = 0
    lines = textwrap.dedent(text.strip("\n")).split("\n")
    for i, line in enumerate(lines):
        bare = line.strip()
        here = len(line) - len(line.lstrip())
        tag = re.match(r"^[ \t]*[@\\](\w+)\s*(.*)$", line)
        if tag:
            keep = tag[1].lower() in _KEEP_TAGS
            skipping = None if keep else "tag"
            if keep:
                kept.append(tag[2])
            continue
        if _FIELD.match(line):
            skipping, indent = "field", here
            continue
        header = _SECTION.match(line)
        underlined = header and i + 1 < len(lines) and re.fullmatch(r"\s*(?:-{3,}|={3,})\s*", lines[i + 1])
        if header and (bare.endswith(":") or bare.startswith("#") or underlined):
            skipping, indent = ("part" if bare.startswith("#") or underlined else "section"), here
            continue
        if _SECTION_INLINE.match(line):
            skipping, indent = "section", here
            continue
        if re.match(r"^\s*#+\s+\w", line) and skipping == "part":
            skipping = None
        if skipping == "section" and bare and here <= indent and i and _SECTION.match(lines[i - 1]):
            skipping = "flat"  # the section's lines were never indented: it ends at a blank one
        if skipping == "flat" and not bare or skipping in ("section", "field") and bare and here <= indent:
            skipping = None
        if skipping:
            continue
        kept.append(line)
    sentences: list[str] = []
    for line in kept:
        if not _PLACEHOLDER_LINE.match(line):
            sentences.append(line.strip())
    text = "\n".join(sentences)
    out = []
    for s in re.split(r"(?<=[.!?;])\s+|\n\s*\n", text):
        flat = " ".join(s.split())
        if flat and not (_PLACEHOLDER.match(flat) or _POINTER.match(flat) or _GENERATED.match(flat)):
            out.append(flat)
    return " ".join(out)


def _stem(w: str) -> str:
    w = w.lower()
    if len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) > 4 and w.endswith(("sses", "shes", "ches", "xes", "zes", "oes")):
        w = w[:-2]
    elif len(w) > 3 and w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    for end in ("ing", "ed"):
        if len(w) > len(end) + 2 and w.endswith(end):
            w = w[: -len(end)]
            if len(w) > 2 and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            break
    if len(w) > 3 and w.endswith("e"):
        w = w[:-1]
    return w[:-1] + "i" if len(w) > 3 and w.endswith("y") else w


def _name_words(name: str) -> list[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+", name)
    return [p.lower() for p in parts]


def is_trivial(doc: str | None, name: str) -> bool:
    """Whether a documentation says nothing: under four words once reduced by
    ``description``, or only the function's own name in words."""
    left = description(doc)
    words = _WORD.findall(left)
    if len(words) < 4:
        return True
    own = {_stem(w) for w in _name_words(re.split(r"\.|::", name)[-1])} | {_stem(w) for w in _name_words(name)}
    # letters of the name without borders, for words the name writes apart
    said = [_stem(x) for w in words for x in _name_words(w) if x not in _FILLER]
    return all(w in own for w in said)


# ---------------------------------------------------------------- the operator


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, owner, kind, lang, text in zip(pdf["file_path"], pdf["owner"], pdf["block_kind"], pdf["code_lang"], pdf["body_text"], strict=True):
            in_class = kind == "class"
            found, bases = scan_python(text, in_class) if lang == "py" else scan_braces(text, lang, in_class)
            if in_class:
                rows += [(path, f"{owner}.{n}", code, doc, None, None) for n, code, doc in found]
                rows += [(path, None, None, None, owner, b) for b in dict.fromkeys(bases) if b != owner]
            else:
                # a block of its own is one function, whatever its source calls it
                rows.append((path, owner, text, found[0][2] if found else "", None, None))
        yield pd.DataFrame(rows, columns=["file_path", "name", "code", "doc", "owner", "base"])


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """``file_path, name, code, doc`` of every function in the blocks, and
    ``file_path, owner, base`` of every base a class names."""
    b = blocks.filter(F.col("block_kind").isin("function", "class") & F.col("body_text").isNotNull() & F.col("function_name").isNotNull())
    named = b.select("file_path", F.col("function_name").alias("owner"), "block_kind", F.coalesce("code_lang", F.lit("ts")).alias("code_lang"), "body_text")
    return named.mapInPandas(_scan, "file_path string, name string, code string, doc string, owner string, base string")


@F.pandas_udf(T.BooleanType())
def _trivial(doc: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([is_trivial(d, n or "") for d, n in zip(doc, name, strict=True)], dtype=bool)


@F.pandas_udf(T.StringType())
def _described(doc: pd.Series) -> pd.Series:
    return doc.map(description)


def _blank(c: str):
    return F.col(c).isNull() | ~F.col(c).rlike(r"(?U)\S")


def function_docs(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per function: ``file_path, name, code, doc, description,
    doc_source, trivial``.

    ``doc_source`` is ``stored`` (``js_doc``), ``code`` or ``inherited``; a
    function without any documentation has nulls and is trivial.  A base is
    looked up in the same file, then by a name that only one class bears, up to
    the top of the hierarchy; a class met before ends the way.  Of several rows
    of a function the latest ``updated_at`` counts.  Functions without a block
    have null ``code``; null paths and names are kept; a text that can't be
    parsed gives what its lines show.  Extra columns are ignored.
    """
    f = latest(functions, ["file_path", "name"], ["updated_at", "js_doc"], ["file_path", "name", "updated_at", "js_doc"]).select("file_path", "name", "js_doc")
    b = latest(blocks, ["file_path", "function_name", "block_kind"], ["updated_at", "body_text"], ["file_path", "function_name", "block_kind", "updated_at", "body_text", "code_lang"])
    scanned = checkpoint(scan_blocks(b))
    code = scanned.filter("name is not null").groupBy("file_path", "name").agg(F.max(F.struct(F.col("doc").rlike(r"\S"), "doc", "code")).alias("_c"))
    code = code.select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), F.col("_c.doc").alias("block_doc"), F.col("_c.code").alias("code"))
    joined = f.join(code, F.col("file_path").eqNullSafe(F.col("_f")) & F.col("name").eqNullSafe(F.col("_n")), "left").drop("_f", "_n")
    stored = ~_blank("js_doc")
    doc = F.when(stored, F.col("js_doc")).when(~_blank("block_doc"), F.col("block_doc"))
    source = F.when(stored, "stored").when(~_blank("block_doc"), "code")
    own = joined.select("file_path", "name", "code", doc.alias("doc"), source.alias("doc_source"))
    own = own.withColumn("trivial", _trivial("doc", "name"))
    bases = scanned.filter("base is not null").select("file_path", "owner", "base").distinct()
    if bases.isEmpty():
        return own.withColumn("description", _described("doc"))
    return _inherit(checkpoint(own), bases, scanned).withColumn("description", _described("doc"))


def _inherit(own: DataFrame, bases: DataFrame, scanned: DataFrame) -> DataFrame:
    classes = scanned.filter("name is not null and instr(name, '.') > 0").select("file_path", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("cls"))
    classes = classes.union(bases.select("file_path", "owner")).distinct()
    here = bases.join(classes.select(F.col("file_path").alias("_f"), F.col("cls").alias("_c")), (F.col("file_path") == F.col("_f")) & (F.col("base") == F.col("_c")), "left")
    unique = classes.groupBy("cls").agg(F.count("*").alias("_k"), F.first("file_path").alias("_u")).filter("_k = 1")
    up = here.join(unique, F.col("base") == F.col("cls"), "left").select(F.col("file_path").alias("c_file"), F.col("owner").alias("c_cls"), F.coalesce("_f", "_u").alias("p_file"), F.col("base").alias("p_cls")).filter("p_file is not null")
    up = checkpoint(up.distinct())
    cls = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    method = F.regexp_extract("name", r"([^.]*)$", 1)
    docs = own.filter("not trivial").select(F.col("file_path").alias("d_file"), cls.alias("d_cls"), method.alias("d_method"), F.col("doc").alias("d_doc")).filter("d_cls <> ''")
    pending = own.filter("trivial and instr(name, '.') > 0").select("file_path", "name", method.alias("method"), F.col("file_path").alias("at_file"), cls.alias("at_cls"))
    got = None
    way = ["file_path", "name", "at_file", "at_cls"]
    seen = pending.select(*way)
    while True:
        up_one = pending.join(up, (F.col("at_file") == F.col("c_file")) & (F.col("at_cls") == F.col("c_cls"))).select("file_path", "name", "method", F.col("p_file").alias("at_file"), F.col("p_cls").alias("at_cls")).distinct()
        # a class met before closes a circle: every way ends at the top or there
        pending = checkpoint(up_one.join(seen, way, "left_anti"))
        if pending.isEmpty():
            break
        seen = seen.unionByName(pending.select(*way))
        met = pending.join(docs, (F.col("at_file") == F.col("d_file")) & (F.col("at_cls") == F.col("d_cls")) & (F.col("method") == F.col("d_method")))
        level = checkpoint(met.groupBy("file_path", "name").agg(F.min("d_doc").alias("doc")))
        got = level if got is None else got.unionByName(level)
        pending = pending.join(level.select("file_path", "name"), ["file_path", "name"], "left_anti")
    if got is None:
        return own
    found = got.select(F.col("file_path").alias("_f"), F.col("name").alias("_n"), F.col("doc").alias("_doc"))
    out = own.join(found, (F.col("file_path") == F.col("_f")) & (F.col("name") == F.col("_n")), "left")
    new = F.col("_doc").isNotNull()
    return out.select("file_path", "name", "code", F.coalesce("_doc", "doc").alias("doc"), F.when(new, "inherited").otherwise(F.col("doc_source")).alias("doc_source"), (F.col("trivial") & ~new).alias("trivial"))


def documented_pairs(functions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Code-description pairs: functions with code and a non-trivial
    documentation of their own or inherited."""
    return function_docs(functions, blocks).filter("not trivial and code is not null").select("file_path", "name", "code", "description", "doc_source")
