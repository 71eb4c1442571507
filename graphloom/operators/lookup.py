"""Looking things up: names with fallbacks, near misses, content and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import contains_ci, regex_quote


def best_tier(df: DataFrame, tier: str, by: list[str] | None = None) -> DataFrame:
    """Rows of the lowest tier at hand: a fallback inside one plan (O-23, O-26).

    The lowest tier is an aggregate of one row (per ``by``), joined back, so no
    row has to pass through a single task.
    """
    if by:
        low = df.groupBy(*by).agg(F.min(tier).alias("_low"))
        return df.join(low, by).filter(F.col(tier) == F.col("_low")).drop("_low")
    low = df.agg(F.min(tier).alias("_low"))
    return df.join(F.broadcast(low), F.col(tier) == F.col("_low")).drop("_low")


def find_by_name(nodes: DataFrame, name: str, path: str | None = None, limit: int = 5) -> DataFrame:
    """Exact name, else, for a name without a dot, names that end in ``.name``
    (O-22, O-23); ``path`` must be part of the file path, in its letter case."""
    exact = F.col("name") == name
    suffix = F.col("name").endswith(f".{name}") if "." not in name else F.lit(False)
    hit = nodes.filter(exact | suffix)
    if path:
        hit = hit.filter(F.col("file_path").contains(path))
    hit = best_tier(hit.withColumn("tier", F.when(exact, 0).otherwise(1)), "tier")
    return hit.orderBy("file_path", "name").limit(limit)


def near_names(nodes: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """``name, distance``: names whose last part is within half the query's length
    by edits, without regard to case (O-64, O-76)."""
    q = query.lower()
    most = -(-len(q) // 2)
    d = F.levenshtein(F.lower(F.substring_index("name", ".", -1)), F.lit(q), most)
    near = nodes.select("name").distinct().withColumn("distance", d).filter(F.col("distance").between(1, most))
    return near.orderBy("distance", "name").limit(limit)


def content_search(blocks: DataFrame, key: list[str], text: str, phrase: str, lines: int = 5) -> DataFrame:
    """``key, line_no, line``: the first matching lines of every text that holds
    the phrase (O-25, O-62)."""
    hit = blocks.filter(contains_ci(F.col(text), phrase)).select(*key, F.posexplode(F.split(text, "\n")).alias("_at", "line"))
    hit = hit.filter(F.col("line").rlike("(?i)" + regex_quote(phrase.strip())))
    w = Window.partitionBy(*key).orderBy("_at")
    return hit.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= lines).select(*key, (F.col("_at") + 1).alias("line_no"), "line")


def content_search_tiered(blocks: DataFrame, functions: DataFrame, key: list[str], text: str, body: str, phrase: str, lines: int = 5) -> DataFrame:
    """``content_search`` on code blocks, or, where no block holds the phrase, on
    the bodies stored with the functions themselves (O-26); ``tier`` says which."""
    first = content_search(blocks, key, text, phrase, lines).withColumn("tier", F.lit(0))
    second = content_search(functions, key, body, phrase, lines).withColumn("tier", F.lit(1))
    return best_tier(first.unionByName(second), "tier")


def log_lines(files: DataFrame) -> DataFrame:
    """``path, line_no, line`` of whole-file texts (``path, value``), blank lines
    left out (O-13)."""
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("_at", "line"))
    return rows.filter(F.trim("line") != "").select("path", (F.col("_at") + 1).alias("line_no"), "line")


def log_search(lines: DataFrame, service: str | None = None, severity: str | None = None, query: str | None = None, since: str | None = None, last: int = 20) -> DataFrame:
    """The last matching log lines, in file and line order (O-27, O-28, O-63).

    The service is the first ``[...]`` of a line, the severity the word before the
    first colon after a ``]``, the date the line's beginning.
    """
    line = F.col("line")
    found = lines
    if service:
        found = found.filter(contains_ci(F.regexp_extract(line, r"\[([^\]]*)\]", 1), service))
    if severity:
        found = found.filter(F.lower(F.regexp_extract(line, r"\]\s+(\w+):", 1)) == severity.lower())
    if query:
        found = found.filter(contains_ci(line, query))
    if since:
        found = found.filter(F.substring(line, 1, len(since)) >= since)
    newest = found.orderBy(F.desc("path"), F.desc("line_no")).limit(last)
    return newest.orderBy("path", "line_no")


def since_filter(date: Column, since: str) -> Column:
    """Dates at or after an ISO prefix, compared as texts (O-27)."""
    return date >= F.lit(since)
