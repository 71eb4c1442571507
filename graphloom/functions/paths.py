"""Paths and node references as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"(?U)^[\s\uFEFF\u200B]+|[\s\uFEFF\u200B]+$"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, BLANKS, "")


def resolve_path(c: Column) -> Column:
    """One spelling for every path that leads to the same file.

    Surrounding blanks and a URI scheme go, percent codes of a URI are decoded,
    backslashes become slashes, and empty, ``.`` and ``..`` segments are
    resolved.  Letter case stays.  Null stays null; ``..`` at the root of an
    absolute path is dropped.
    """
    p = strip(c)
    scheme = r"^(?i)[a-z][a-z0-9+.\-]+:(?://(?:localhost)?)?(?=[/\\])"
    decoded = F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    p = F.when(p.rlike(scheme) & p.contains("%"), F.coalesce(decoded, p)).otherwise(p)
    p = F.translate(F.regexp_replace(p, scheme, ""), "\\", "/")
    resolved = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((x == "..") & p.startswith("/"), acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(resolved, "/"))
    return F.when(p.rlike(r"//|(^|/)\.\.?(/|$)|./$"), joined).otherwise(p)


def ref_path(ref: Column) -> Column:
    """Path of a ``path::name`` reference (all of it where no name is given)."""
    return resolve_path(F.regexp_extract(ref, r"(?s)^(.*?)(?:::.*)?$", 1))


def ref_name(ref: Column) -> Column:
    """Name of a ``path::name`` reference: what follows the first ``::``, since
    names may hold ``::`` themselves; null where there is none or it is blank."""
    n = strip(F.regexp_extract(ref, r"(?s)^.*?::(.*)$", 1))
    return F.when(n != "", n)
