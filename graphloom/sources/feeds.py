"""Output of version control, rule files, overrides and logs as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "\x1f"


def diff_names(lines: DataFrame) -> DataFrame:
    """``file_path`` of a name-only diff (``value``), blank lines dropped (O-09)."""
    return lines.select(F.trim("value").alias("file_path")).filter("file_path <> ''").distinct()


def changed_files(changed: DataFrame, deleted: DataFrame, tree: DataFrame, reachable: bool = True) -> DataFrame:
    """``file_path, state`` of what changed since the cursor (O-09).

    ``changed`` and ``deleted`` are lines (``value``) of name-only diffs, the second
    of deletions only; a deleted path is no changed one.  If the cursor's commit
    can't be reached any more, every file of ``tree`` (``file_path``) counts as
    changed and nothing as deleted.
    """
    if not reachable:
        return tree.select("file_path").filter("file_path is not null").distinct().withColumn("state", F.lit("changed"))
    gone = diff_names(deleted)
    kept = diff_names(changed).join(gone, "file_path", "left_anti")
    return kept.withColumn("state", F.lit("changed")).unionByName(gone.withColumn("state", F.lit("deleted")))


def commit_files(commits: DataFrame, listed: DataFrame, shown: DataFrame) -> DataFrame:
    """``hash, file_path`` of each commit (O-11): the files listed with the log
    (``hash, value``) or, for a commit without any there, those shown for it."""
    files = lambda d: d.select("hash", F.trim("value").alias("file_path")).filter("file_path <> ''").distinct()
    first = files(listed)
    bare = commits.select("hash").distinct().join(first.select("hash").distinct(), "hash", "left_anti")
    return first.join(commits.select("hash").distinct(), "hash", "left_semi").unionByName(files(shown).join(bare, "hash", "left_semi"))


def status_entries(lines: DataFrame) -> DataFrame:
    """``state, file_path`` of porcelain status lines (O-10): of a rename the new
    path, quotes taken off."""
    rest = F.substring("value", F.lit(4), F.length("value"))
    path = F.when(F.instr(rest, " -> ") > 0, F.substring_index(rest, " -> ", -1)).otherwise(rest)
    clean = F.regexp_replace(F.trim(path), r'^"(.*)"$', "$1")
    return lines.filter(F.length("value") > 3).select(F.trim(F.substring("value", 1, 2)).alias("state"), clean.alias("file_path"))


def log_entries(lines: DataFrame) -> DataFrame:
    """``hash, short_hash, author, date, message`` of log lines whose fields are
    parted by a unit separator, so a message may hold anything else (O-11)."""
    p = F.split("value", FIELD, 5)
    return lines.filter(F.size(p) == 5).select(p[0].alias("hash"), p[1].alias("short_hash"), p[2].alias("author"), p[3].alias("date_raw"), F.try_to_timestamp(p[3]).alias("date"), p[4].alias("message"))


RULE = "id string, description string, scope string, scopeType string, source string, severity string, tags string"
SEVERITIES = ("must", "should", "prefer")
SCOPES = ("service", "module", "function")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Constraints of a JSON array file with what is wrong with each in ``problem``
    (O-12); tags of any form become an array of texts."""
    raw = spark.read.option("wholetext", "true").text(path)
    rows = raw.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("r"))
    get = lambda k: F.try_element_at("r", F.lit(k))
    bad = F.when(F.coalesce(get("id"), F.lit("")) == "", "id").when(F.coalesce(get("description"), F.lit("")) == "", "description").when(F.coalesce(get("scope"), F.lit("")) == "", "scope")
    bad = bad.when(~F.coalesce(get("severity").isin(*SEVERITIES), F.lit(False)), "severity").when(~F.coalesce(get("scopeType").isin(*SCOPES), F.lit(False)), "scopeType")
    tags = F.coalesce(F.from_json(get("tags"), "array<string>"), F.when(get("tags").isNotNull(), F.array(get("tags"))), F.array().cast("array<string>"))
    return rows.select(get("id").alias("id"), get("description").alias("description"), get("scope").alias("scope"), get("scopeType").alias("scope_type"), get("source").alias("source"), get("severity").alias("severity"), tags.alias("tags"), bad.alias("problem"))


def read_overrides(text: str, axes: list[str]) -> dict[str, str]:
    """Target overrides of a small JSON object: only known axes with text values;
    anything malformed gives none (O-14)."""
    try:
        got = json.loads(text)
    except ValueError:
        return {}
    return {k: v for k, v in got.items() if k in axes and isinstance(v, str)} if isinstance(got, dict) else {}


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``path, value`` of whole log files, for ``lookup.log_lines`` (O-13)."""
    return spark.read.option("wholetext", "true").option("pathGlobFilter", "*.log").text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def migration_chain(steps: list[tuple[str, str]], start: str, end: str) -> tuple[list[tuple[str, str]], str | None]:
    """The steps from one version to another, or what blocks them: ``downgrade``,
    ``cycle`` or ``missing`` (O-115)."""
    key = lambda v: [int(x) if x.isdigit() else 0 for x in v.split(".")]
    a, b = key(start), key(end)
    width = max(len(a), len(b))
    if a + [0] * (width - len(a)) > b + [0] * (width - len(b)):
        return [], "downgrade"
    path: list[tuple[str, str]] = []
    seen: set[str] = set()
    at = start
    while at != end:
        if at in seen:
            return [], "cycle"
        seen.add(at)
        step = next((s for s in steps if s[0] == at), None)
        if step is None:
            return [], "missing"
        path.append(step)
        at = step[1]
    return path, None


# Labels of domains and the fields whose change calls for a new label.
DOMAINS = ("application", "web-api", "frontend", "database", "infrastructure", "shared-utilities", "cli", "testing", "unclassified")
SIGNIFICANT = ("full", "jsDoc", "returnType", "bodyText", "args")


def is_significant(fields):
    """Whether a change touches a field that matters for the domain (O-116)."""
    return F.arrays_overlap(fields, F.array(*[F.lit(f) for f in SIGNIFICANT]))
