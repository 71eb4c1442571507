"""Coding-style decisions: distributions, targets, flags and migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import maybe_broadcast

# The axes and the value by which each says that it does not apply.
ABSENT: dict[str, str] = {
    "var_decl": "none",
    "string_style": "none",
    "async_style": "sync",
    "array_syntax": "none",
    "export_style": "none",
}
MIN_DECIDERS = 10


def style_axes(code: Column, heads: Column) -> dict[str, Column]:
    """The five axes of a source text by its surface (O-95): an approximation by
    patterns, without a parser.  ``code`` is free of comments, ``heads`` also of
    the declarations in loop heads."""
    const, let, var = heads.rlike(r"\bconst\s"), heads.rlike(r"\blet\s"), heads.rlike(r"\bvar\s")
    tpl, cat = code.rlike(r"`[^`]*\$\{"), code.rlike(r"['\"]\s*\+|\+\s*['\"]")
    wait, then = code.rlike(r"\bawait\b"), code.rlike(r"\.then\s*\(")
    brk, gen = code.rlike(r":\s*\w+\[\]"), code.rlike(r"\bArray<")
    return {
        "var_decl": F.when(var | (const & let), "mixed").when(const, "const").when(let, "let").otherwise("none"),
        "string_style": F.when(tpl & cat, "mixed").when(tpl, "template-literal").when(cat, "concat").otherwise("none"),
        "async_style": F.when(wait, "async-await").when(then, "promise-then").otherwise("sync"),
        "array_syntax": F.when(brk & gen, "mixed").when(brk, "bracket").when(gen, "generic").otherwise("none"),
        "export_style": F.when(code.rlike(r"\bexport\s+default\b"), "default").when(code.rlike(r"\bexport\b"), "named").otherwise("none"),
    }


def facts(bodies: DataFrame, node: str, body: str) -> DataFrame:
    """``node_id, axis, value``: one row per node and axis (O-19, O-95)."""
    bare = F.regexp_replace(F.regexp_replace(F.col(body), r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    # each text is stripped once, in a projection of its own
    stripped = bodies.select(F.col(node).alias("node_id"), bare.alias("_code"))
    stripped = stripped.withColumn("_heads", F.regexp_replace("_code", r"\bfor\s*\(\s*(?:const|let|var)\b", "for ("))
    axes = style_axes(F.col("_code"), F.col("_heads"))
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), v.alias("value")) for a, v in axes.items()])
    return stripped.select("node_id", F.explode(pairs).alias("_p")).select("node_id", "_p.axis", "_p.value")


def _absent() -> Column:
    absent = F.create_map(*[F.lit(x) for kv in ABSENT.items() for x in kv])
    return F.coalesce(F.col("value") == F.try_element_at(absent, F.col("axis")), F.lit(False))


def distribution(decisions: DataFrame) -> DataFrame:
    """``axis, value, n`` (O-49)."""
    return decisions.groupBy("axis", "value").agg(F.count("*").alias("n"))


def targets(decisions: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``axis, target, deciders, source, enforced`` (O-50, O-51, O-96, O-97).

    The target is the most frequent value that says something, the smallest of
    equal ones; an override replaces it.  It is enforced with an override or from
    ten deciders on.
    """
    d = distribution(decisions)
    live = d.filter(~_absent() & F.col("value").isNotNull())
    best = live.groupBy("axis").agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("_m"), F.sum("n").alias("deciders"))
    out = d.select("axis").distinct().join(best, "axis", "left").select("axis", F.col("_m.value").alias("_mode"), F.coalesce("deciders", F.lit(0)).alias("deciders"))
    chosen = F.lit(None).cast("string")
    if overrides:
        chosen = F.try_element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), F.col("axis"))
    out = out.withColumn("_o", chosen)
    return out.select("axis", F.coalesce("_o", "_mode").alias("target"), "deciders", F.when(F.col("_o").isNotNull(), "override").otherwise("mode").alias("source"), (F.col("_o").isNotNull() | (F.col("deciders") >= MIN_DECIDERS)).alias("enforced"))


def flags(decisions: DataFrame, goals: DataFrame) -> DataFrame:
    """``node_id, axis, value, target``: decisions off an enforced target (O-98)."""
    t = maybe_broadcast(goals.filter("enforced and target is not null").select(F.col("axis").alias("_a"), "target"))
    return decisions.join(t, F.col("axis") == F.col("_a")).filter(~_absent() & (F.col("value") != F.col("target"))).select("node_id", "axis", "value", "target")


def verdict_counts(decisions: DataFrame, goals: DataFrame) -> DataFrame:
    """``n_judged, n_conforming, n_off_target, n_flags`` (O-54b)."""
    per = decisions.select("node_id").distinct().join(flags(decisions, goals).groupBy(F.col("node_id").alias("_i")).agg(F.count("*").alias("f")), F.col("node_id") == F.col("_i"), "left")
    off = F.col("f").isNotNull()
    return per.agg(F.count("*").alias("n_judged"), F.sum((~off).cast("long")).alias("n_conforming"), F.sum(off.cast("long")).alias("n_off_target"), F.sum(F.coalesce("f", F.lit(0))).alias("n_flags"))


def migration(decisions: DataFrame, goals: DataFrame) -> DataFrame:
    """``axis, at_target, off_target, considered, pct`` (O-99)."""
    d = distribution(decisions).filter(~_absent()).join(maybe_broadcast(goals.select(F.col("axis").alias("_a"), "target")), F.col("axis") == F.col("_a"))
    s = d.groupBy("axis").agg(F.sum(F.when(F.col("value") == F.col("target"), F.col("n")).otherwise(0)).alias("at_target"), F.sum("n").alias("considered"))
    pct = F.when(F.col("considered") > 0, F.col("at_target") * 100.0 / F.col("considered")).otherwise(0.0)
    return s.select("axis", "at_target", (F.col("considered") - F.col("at_target")).alias("off_target"), "considered", pct.alias("pct"))


def backlog(decisions: DataFrame, axis: str, target: str) -> DataFrame:
    """Decisions of one axis off a value, absence included (O-100)."""
    return decisions.filter((F.col("axis") == axis) & (F.col("value") != target))


def minority(decisions: DataFrame, share: float = 0.12) -> DataFrame:
    """``axis, value, n, share``: values at or under a share that aren't their
    axis' mode (O-101)."""
    d = distribution(decisions)
    w = Window.partitionBy("axis")
    d = d.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "value")))
    return d.filter((F.col("_r") > 1) & (F.col("share") <= share)).select("axis", "value", "n", "share")


def category(kind: Column) -> Column:
    """The embedding category of an entity's kind (O-102)."""
    return F.when(kind == "function", "function:body").when(kind.isin("class", "interface", "type", "enum"), "type:body").when(kind.isin("const", "constant"), "module:const")
