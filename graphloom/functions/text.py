"""Text helpers as Column expressions; none of them is a UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SECRET_MASK = "****"

# Credential shapes that are masked before a note is stored, each
# with the text that stays in front of the mask.
SECRET_SHAPES: tuple[tuple[str, str, str], ...] = (
    ("openai-style-key", r"\b(sk-)[A-Za-z0-9_\-]{16,}", "$1"),
    ("github-token", r"\b(gh[pousr]_)[A-Za-z0-9]{20,}", "$1"),
    ("aws-access-key", r"\b(AKIA)[0-9A-Z]{16}\b", "$1"),
    ("google-oauth-secret", r"\b(GOCSPX-)[A-Za-z0-9_\-]{20,}", "$1"),
    ("url-password", r"([A-Za-z][A-Za-z0-9+.\-]*://[^\s:/@]+:)[^\s@/]+(@)", "$1****$2"),
    ("jwt", r"\b(eyJ)[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", "$1"),
)


def regex_quote(text: str) -> str:
    """A literal text as a regular expression (O-103)."""
    return re.sub(r"([.*+?^${}()|\[\]\\/\-])", r"\\\1", text)


def contains_ci(c: Column, phrase: str, dotall: bool = True) -> Column:
    """Whether ``c`` holds the trimmed phrase, without regard to case (O-24, O-25).

    Without ``dotall`` the phrase must be found on a text without line breaks
    before or after it, which is what a pattern of the kind ``.*x.*`` asks for.
    """
    q = regex_quote(phrase.strip())
    return c.rlike(f"(?is){q}") if dotall else c.rlike(rf"(?i)\A.*{q}.*\z")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_comments(c: Column) -> Column:
    """Without block and then line comments, blanks collapsed (O-104); strings
    are not told apart from code."""
    return collapse(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " "))


def raw_signature(name: Column, args: Column, return_type: Column) -> Column:
    """``name(a: T, b: U): R`` from an array of argument structs (O-105)."""
    one = lambda a: F.concat(a["name"], F.when(F.coalesce(a["type"], F.lit("")) != "", F.concat(F.lit(": "), a["type"])).otherwise(F.lit("")))
    listed = F.array_join(F.transform(F.coalesce(args, F.array()), one), ", ")
    return F.concat(name, F.lit("("), listed, F.lit("): "), F.coalesce(return_type, F.lit("void")))


def normalized_signature(args: Column, return_type: Column) -> Column:
    """The signature's shape, without names: ``fn(T, U): R`` (O-105)."""
    listed = F.array_join(F.transform(F.coalesce(args, F.array()), lambda a: F.coalesce(a["type"], F.lit("any"))), ", ")
    return F.concat(F.lit("fn("), listed, F.lit("): "), F.coalesce(return_type, F.lit("void")))


def node_id(path: Column, name: Column) -> Column:
    return F.concat(path, F.lit("::"), name)


def id_name(c: Column) -> Column:
    """What follows the last ``::`` of a node id (O-106)."""
    return F.substring_index(c, "::", -1)


def id_path(c: Column) -> Column:
    """What precedes the last ``::`` of a node id (O-106)."""
    return F.when(F.instr(c, "::") > 0, F.substring(c, F.lit(1), F.length(c) - F.length(id_name(c)) - 2)).otherwise(F.lit(""))


def join_route(prefix: Column, path: Column) -> Column:
    """One leading slash, no doubled or trailing ones (O-107)."""
    joined = F.regexp_replace(F.concat(F.lit("/"), F.concat_ws("/", prefix, path)), r"/{2,}", "/")
    return F.when(F.length(joined) > 1, F.regexp_replace(joined, r"/$", "")).otherwise(joined)


def clean_callees(names: Column, stop: list[str]) -> Column:
    """Distinct callee names without ``this.``, ``self.`` and stop words (O-108)."""
    bare = F.transform(names, lambda n: F.regexp_replace(F.trim(n), r"^(?:this|self|super|cls)\.", ""))
    stops = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    return F.array_distinct(F.filter(bare, lambda n: (n != "") & ~F.array_contains(stops, F.substring_index(n, ".", -1))))


def type_refs(text: Column, builtins: list[str]) -> Column:
    """Names with a capital that are no built-in types, in order (O-109)."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(b) for b in builtins])) if builtins else found


def snippet(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\u2026"))).otherwise(c)


def redact_shapes(c: Column) -> Column:
    """Known credential shapes masked, their prefix kept (O-111)."""
    for _, shape, keep in SECRET_SHAPES:
        c = F.regexp_replace(c, shape, keep if SECRET_MASK in keep else keep + SECRET_MASK)
    return c


def shapes_found(c: Column) -> Column:
    """Names of the credential shapes a text holds, in fixed order (O-111)."""
    return F.array_compact(F.array(*[F.when(c.rlike(shape), F.lit(kind)) for kind, shape, _ in SECRET_SHAPES]))


def mask_uri(c: Column) -> Column:
    """A connection URI with its password masked (O-112)."""
    return F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^:/@\s]*):[^@\s]*@", "$1:****@")


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0)


def json_or(c: Column, schema: str, fallback: Column) -> Column:
    """Parsed JSON, or a fallback where it is null or broken (O-114)."""
    return F.coalesce(F.from_json(c, schema), fallback)


def version_parts(c: Column) -> Column:
    """A dotted version as comparable numbers; a suffix after - is ignored (O-115)."""
    core = F.regexp_replace(F.regexp_replace(c, r"^[vV]", ""), r"[-+].*$", "")
    return F.transform(F.split(core, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def dirname(c: Column) -> Column:
    return F.when(F.instr(c, "/") > 0, F.regexp_replace(c, r"/[^/]*$", "")).otherwise(F.lit("."))


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def extension(c: Column) -> Column:
    return F.regexp_extract(basename(c), r"(\.[^.]+)$", 1)


def first_line(c: Column) -> Column:
    return F.split_part(c, F.lit("\n"), F.lit(1))


def content_hash(c: Column) -> Column:
    """The first sixteen hex digits of the SHA-256 (O-86)."""
    return F.substring(F.sha2(c, 256), 1, 16)


def drift_status(recorded: Column, current: Column, exists: Column) -> Column:
    """``unchanged``, ``modified``, ``missing`` or ``unknown`` (O-119)."""
    return F.when(~exists, "missing").when(recorded.isNull(), "unknown").when(recorded == current, "unchanged").otherwise("modified")


def trigrams(c: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded by two blanks in front
    and one behind (O-73)."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two distinct arrays; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))
