"""Session memory: recall, supersession, merging and caveats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import age_days, redact_shapes, trigram_similarity
from graphloom.functions.vectors import cosine_similarity
from graphloom.operators.novelty import near_duplicates
from graphloom.operators.traverse import neighbours

COSINE, LEXICAL, NEARBY, RECENT, HALF_LIFE_DAYS = 0.65, 0.35, 0.15, 0.05, 30.0


def hybrid_score(similarity: Column, lexical: Column, nearby: Column, at: Column, now: Column) -> Column:
    """Cosine and trigram similarity, a bonus for shared references, and one for
    recency that halves every thirty days; no date adds nothing (O-74)."""
    recency = F.coalesce(F.lit(RECENT) * F.pow(F.lit(0.5), age_days(at, now) / HALF_LIFE_DAYS), F.lit(0.0))
    return F.lit(COSINE) * similarity + F.lit(LEXICAL) * lexical + F.when(nearby, F.lit(NEARBY)).otherwise(F.lit(0.0)) + recency


def recall(
    items: DataFrame,
    vector: list[float],
    text: str,
    now: str,
    near_refs: list[str] | None = None,
    k: int = 5,
    only_near: bool = False,
    include_superseded: bool = False,
    kinds: list[str] | None = None,
    session_id: str | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """``kind, id, similarity, lexical, score``: the ``k`` of each kind most alike by
    cosine, ranked by the hybrid score (O-29, O-30, O-75).

    ``items``: ``kind, id, text, vec, graph_refs, created_at, status`` and, for
    ``session_id``, that column.  Kinds go through one window instead of one query
    each; its rank limit keeps ``k`` rows per task before anything is shuffled.
    ``kinds`` limits the kinds; with ``edges`` the references are widened by their
    neighbours in the graph (O-57).  ``only_near`` applies after the top ``k``.
    """
    live = items if include_superseded else items.filter(F.coalesce("status", F.lit("active")) == "active")
    if kinds is not None:
        live = live.filter(F.col("kind").isin(sorted(set(kinds))))
    if session_id is not None:
        live = live.filter(F.col("session_id") == session_id)
    sim = F.round(cosine_similarity(F.col("vec"), F.array(*[F.lit(float(x)) for x in vector])), 9)
    scored = live.withColumn("similarity", sim).filter("similarity is not null")
    w = Window.partitionBy("kind").orderBy(F.desc("similarity"), "id")
    top = scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    refs = F.array(*[F.lit(r) for r in near_refs]) if near_refs else F.array().cast("array<string>")
    if edges is not None and near_refs:
        # only the few rows on top meet the widened references
        wide = neighbours(edges, items.sparkSession.createDataFrame([(r,) for r in near_refs], "ref string")).select(F.col("neighbour").alias("_r")).distinct()
        held = top.select("kind", "id", F.explode("graph_refs").alias("_g")).join(wide, F.col("_g") == F.col("_r"), "left_semi").select(F.col("kind").alias("_k"), F.col("id").alias("_i")).distinct()
        top = top.join(held, F.col("kind").eqNullSafe(F.col("_k")) & (F.col("id") == F.col("_i")), "left").withColumn("_near", F.col("_i").isNotNull())
        near = F.col("_near")
    else:
        near = F.coalesce(F.arrays_overlap("graph_refs", refs), F.lit(False))
    if only_near:
        top = top.filter(near)
    lex = trigram_similarity(F.col("text"), F.lit(text))
    score = hybrid_score(F.col("similarity"), lex, near, F.col("created_at"), F.lit(now).cast("timestamp"))
    return top.select("kind", "id", "similarity", lex.alias("lexical"), F.round(score, 9).alias("score")).orderBy(F.desc("score"), "kind", "id")


def supersede(rows: DataFrame, replacements: DataFrame) -> DataFrame:
    """``rows`` with the ids named by ``replacements`` (``new_id, old_id``) marked as
    superseded; an unknown old id changes nothing (O-91).  Of several replacements
    the greatest id counts."""
    r = replacements.groupBy("old_id").agg(F.max("new_id").alias("_new"))
    out = rows.join(r, F.col("id") == F.col("old_id"), "left")
    return out.withColumn("status", F.when(F.col("_new").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.coalesce("_new", "superseded_by")).select(*rows.columns)


def record(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` after new entries were written and those they replace were marked,
    as one table (O-91, O-111).

    ``new`` has the columns of ``rows`` that are known (``id`` and ``text`` among
    them) and ``supersedes``, an old id or null.  Credential shapes are masked in
    ``text`` first; entries come in as ``active``.  An unknown old id still
    inserts.
    """
    ids = new.filter("supersedes is not null").select(F.col("id").alias("new_id"), F.col("supersedes").alias("old_id"))
    fresh = new.drop("supersedes").withColumns({"text": redact_shapes(F.col("text")), "status": F.lit("active"), "superseded_by": F.lit(None).cast(rows.schema["superseded_by"].dataType)})
    return supersede(rows, ids).unionByName(fresh, allowMissingColumns=True).select(*rows.columns)


def duplicates_of_new(rows: DataFrame, new: DataFrame, least: float = 0.85) -> DataFrame:
    """``id, duplicate_of, similarity``: active entries a new one nearly repeats
    (O-72): the most alike of its kind, if alike enough.  Entries that replace
    another are not asked about; nothing is blocked.  Both sides: ``id, grp, vec``;
    ``rows`` also ``status``, ``new`` also ``supersedes``."""
    active = rows.filter(F.coalesce("status", F.lit("active")) == "active")
    return near_duplicates(new.filter("supersedes is null"), active, least)


def merge_sessions(events: DataFrame, separator: str = "\n---\n") -> DataFrame:
    """``session_id, id, n_events, summary, caveats, graph_refs``: the notes of each
    session as one, in order of id: summaries joined, caveats concatenated,
    references united in order of first sight; the latest id stays (O-82, O-83,
    O-92).  A session is one row, however it is stored."""
    item = F.struct("id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("caveats", F.array().cast("array<string>")).alias("caveats"), F.coalesce("graph_refs", F.array().cast("array<string>")).alias("refs"))
    g = events.filter("session_id is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("_e"))
    pick = lambda c: F.transform("_e", lambda x: x[c])
    return g.select("session_id", F.element_at(pick("id"), -1).alias("id"), F.size("_e").cast("long").alias("n_events"), F.array_join(F.filter(pick("summary"), lambda s: s != ""), separator).alias("summary"), F.flatten(pick("caveats")).alias("caveats"), F.array_distinct(F.flatten(pick("refs"))).alias("graph_refs"))


def resolve_caveats(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """``events`` with many resolutions at once (``event_id, caveat_index,
    resolved_at, note``), as ``resolve_caveat`` puts them; of several of one caveat
    the latest counts (O-93)."""
    kind = events.schema["resolutions"].dataType
    one = resolved.groupBy("event_id", "caveat_index").agg(F.max(F.struct("resolved_at", "note")).alias("_m"))
    new = one.groupBy(F.col("event_id").alias("_e")).agg(F.sort_array(F.collect_list(F.struct("caveat_index", "_m.resolved_at", "_m.note"))).cast(kind).alias("_new"))
    empty = F.array().cast(kind)
    most = F.size(F.coalesce("caveats", F.array().cast("array<string>")))
    given = F.filter(F.coalesce("_new", empty), lambda r: (r["caveat_index"] >= 0) & (r["caveat_index"] < most))
    stay = F.filter(F.coalesce("resolutions", empty), lambda r: ~F.exists(given, lambda g: g["caveat_index"] == r["caveat_index"]))
    met = events.join(new, F.col("id") == F.col("_e"), "left")
    return met.withColumn("resolutions", F.when(F.size(given) > 0, F.concat(stay, given)).otherwise(F.col("resolutions"))).select(*events.columns)


def resolve_caveat(events: DataFrame, event_id: int, index: int, at: str, note: str | None) -> DataFrame:
    """``events`` with the resolution of one caveat put in place of any earlier one
    of the same index; an index out of range changes nothing (O-93)."""
    new = F.struct(F.lit(index).alias("caveat_index"), F.lit(at).cast("timestamp").alias("resolved_at"), F.lit(note).cast("string").alias("note"))
    old = F.coalesce("resolutions", F.array().cast(events.schema["resolutions"].dataType))
    hit = (F.col("id") == event_id) & (F.lit(index) >= 0) & (F.lit(index) < F.size(F.coalesce("caveats", F.array().cast("array<string>"))))
    changed = F.concat(F.filter(old, lambda r: r["caveat_index"] != index), F.array(new).cast(events.schema["resolutions"].dataType))
    return events.withColumn("resolutions", F.when(hit, changed).otherwise(F.col("resolutions")))


def timeline(parts: dict[str, DataFrame], session_id: str | None = None) -> DataFrame:
    """``kind, id, session_id, created_at, text`` of all kinds in order of time
    (O-81)."""
    out = None
    for kind, df in parts.items():
        p = df.withColumn("kind", F.lit(kind)).select("kind", "id", "session_id", "created_at", "text")
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    if session_id is not None:
        out = out.filter(F.col("session_id") == session_id)
    return out.orderBy("created_at", "kind", "id")
