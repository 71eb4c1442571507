"""Queries on embeddings, judged scores and stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine_distance
from graphloom.operators import memory, novelty
from graphloom.session import latest, table

PERCENTILE = 0.95


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))


def judge_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Leave-one-out calibration per label, then a verdict on every entry."""
    out = novelty.judge_pool(_pool(spark, sf), 5, PERCENTILE)
    return out.select("id", "grp", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), "verdict")


def calibrate_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.calibrate(_pool(spark, sf), 5, PERCENTILE).select("grp", F.round("threshold", 6).alias("threshold"), "sample_size")


def summary_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.nearest_rank_summary(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice").select("l_returnflag", "min_value", "median_value", "p90", "p95", "max_value", F.round("mean_value", 2).alias("mean_value"))


def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    """Ten entries most like entry 0: the query vector is one row."""
    pool = _pool(spark, sf)
    row = pool.filter("id = 0").first()
    return novelty.semantic_search(pool, list(row["vec"]), 10).select("id", "grp", F.round("similarity", 6).alias("similarity"))


def knn_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every hundredth entry, against all of its label."""
    pool = _pool(spark, sf)
    near = novelty.nearest(pool.filter("id % 100 = 0"), pool, 5)
    return near.select("id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def near_duplicate_top1(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry that replaces none against the active ones, with near copies of
    every twentieth planted, of which every second is superseded."""
    pool = _pool(spark, sf)
    near = F.transform("vec", lambda x, i: (x + 0.01 * (i % 3)).cast("float"))
    old = pool.filter("id % 20 = 0").select((F.col("id") + 1_000_000).alias("id"), "grp", near.alias("vec"), F.when(F.col("id") % 40 == 0, "superseded").otherwise("active").alias("status"))
    new = pool.withColumn("supersedes", F.when(F.col("id") % 60 == 0, 1).cast("long"))
    return memory.duplicates_of_new(old, new).select("id", "duplicate_of", F.round("similarity", 6).alias("similarity"))


def edit_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """How steadily the distance grows as more of a vector is edited."""
    v = _pool(spark, sf)
    level = F.explode(F.sequence(F.lit(1), F.lit(4)))
    e = v.select("id", "vec", level.alias("level"))
    edited = F.transform("vec", lambda x, i: F.when(i < F.col("level") * 8, x.cast("double") + 0.1).otherwise(x.cast("double")))
    scored = e.select("id", "level", F.round(cosine_distance(F.col("vec"), edited), 9).alias("distance"))
    r = novelty.ladder_rates(scored)
    return r.select("n_ladders", F.round("monotone_rate", 6).alias("monotone_rate"), F.round("step_rate", 6).alias("step_rate"))


def snippet_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Bits per token pair of every code block under the pair counts of all."""
    b = table(spark, sf, "code_blocks").groupBy(F.col("block_id").alias("id")).agg(F.max("body_text").alias("t"))
    tokens = b.select("id", F.regexp_extract_all("t", F.lit("([A-Za-z_]+|[0-9]+)"), F.lit(1)).alias("tokens"))
    return novelty.ngram_entropy(tokens, tokens).select("id", "n_grams", F.round("entropy", 6).alias("entropy"))


def approximate_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every hundredth entry by random hyperplanes."""
    pool = _pool(spark, sf)
    return novelty.nearest_approximate(pool.filter("id % 100 = 0"), pool, 5, 64, bucket_rows=64).select("id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def lof_scores(spark: SparkSession, sf: str) -> DataFrame:
    return novelty.local_outlier_factors(_pool(spark, sf), 20).select("id", F.round("lof", 6).alias("lof"))


def evaluate_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """How well judged distances tell two categories apart."""
    j = table(spark, sf, "judged_nodes").filter("category in ('function:body', 'hook:body') and distance is not null and not isnan(distance)")
    return novelty.auroc(j.select("distance", (F.col("category") == "hook:body").alias("positive")), "distance", "positive").select(F.round("auroc", 6).alias("auroc"))


def evaluate_flag_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of judged nodes above the stored threshold of their category."""
    c = table(spark, sf, "cfm_calibration").select("category", "threshold")
    j = table(spark, sf, "judged_nodes").filter("distance is not null and not isnan(distance)")
    flag = (F.col("distance") > F.coalesce("threshold", F.lit(novelty.FALLBACK_THRESHOLD))).cast("double")
    return j.join(c, "category", "left").groupBy("category").agg(F.count("*").alias("n_judged"), F.round(F.avg(flag), 6).alias("flag_rate"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors after an upsert in which the last row of a node wins, by model."""
    v = latest(table(spark, sf, "cfm_vectors"), ["node_id"], ["updated_at", "model"], ["node_id", "updated_at", "model", "category", "embedding"])
    ok = F.size("embedding") == 64
    return v.groupBy("model", "category").agg(F.count("*").alias("n_nodes"), F.sum(F.when(ok, 1).otherwise(0)).alias("n_valid"))


def stored_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every valid stored vector to the one of the first node of its
    category and model."""
    v = latest(table(spark, sf, "cfm_vectors"), ["node_id"], ["updated_at", "model"], ["node_id", "updated_at", "model", "category", "embedding"]).filter(F.size("embedding") == 64)
    first = v.groupBy("category", "model").agg(F.min(F.struct("node_id", "embedding")).alias("_f")).select(F.col("category").alias("_c"), F.col("model").alias("_m"), F.col("_f.embedding").alias("_e"))
    out = v.join(first, (F.col("category") == F.col("_c")) & (F.col("model") == F.col("_m")))
    return out.select("node_id", F.round(cosine_distance(F.col("embedding"), F.col("_e")), 6).alias("distance"))


QUERIES = {f.__name__: f for f in (judge_outliers, calibrate_thresholds, summary_nearest_rank, semantic_search, knn_nearest, near_duplicate_top1, edit_ladder, snippet_entropy, approximate_nearest, lof_scores, evaluate_auroc, evaluate_flag_rates, vector_upsert, stored_distance)}

_KNN = """
v AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.id, a.grp, b.id AS neighbour, round(1 - list_cosine_similarity(a.e, b.e), 9) AS distance FROM v a JOIN v b ON a.grp = b.grp AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS rank FROM d),
k AS (SELECT v.id, v.grp, avg(r.distance) AS distance FROM v LEFT JOIN r ON r.id = v.id AND r.rank <= 5 GROUP BY ALL),
t AS (SELECT grp, quantile_cont(coalesce(distance, 0), 0.95) AS threshold, count(*) AS sample_size FROM k GROUP BY grp)"""
_VEC = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY updated_at DESC, model DESC) AS rn FROM cfm_vectors) WHERE rn = 1)"

ORACLE = {
    "judge_outliers": f"""WITH {_KNN} SELECT k.id, k.grp, round(k.distance, 6) AS distance, round(t.threshold, 6) AS threshold,
  CASE WHEN k.distance IS NULL THEN 'unjudged' WHEN round(k.distance, 9) > round(t.threshold, 9) THEN 'outlier' ELSE 'conforming' END AS verdict
FROM k JOIN t USING (grp)""",
    "calibrate_thresholds": f"WITH {_KNN} SELECT grp, round(threshold, 6) AS threshold, sample_size FROM t",
    "summary_nearest_rank": """SELECT l_returnflag, min(l_extendedprice) AS min_value, quantile_disc(l_extendedprice, 0.5) AS median_value,
  quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS max_value, round(avg(l_extendedprice), 2) AS mean_value
FROM lineitem GROUP BY l_returnflag""",
    "semantic_search": """WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, label AS grp, round(1 - round(1 - list_cosine_similarity(embedding::DOUBLE[], q.e), 9), 6) AS similarity FROM embeddings, q ORDER BY 1 - round(1 - list_cosine_similarity(embedding::DOUBLE[], q.e), 9) DESC, id LIMIT 10""",
    "knn_nearest": f"WITH {_KNN} SELECT id, rank::INTEGER AS rank, neighbour, round(distance, 6) AS distance FROM r WHERE rank <= 5 AND id % 100 = 0",
    "near_duplicate_top1": """WITH v AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS e FROM embeddings),
o AS (SELECT id + 1000000 AS id, grp, list_transform(e, lambda x, i: (x + 0.01 * ((i - 1) % 3))::FLOAT)::DOUBLE[] AS e FROM v WHERE id % 20 = 0 AND id % 40 <> 0),
d AS (SELECT v.id, o.id AS n, round(1 - list_cosine_similarity(v.e, o.e), 9) AS distance FROM v JOIN o USING (grp) WHERE v.id % 60 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, n) AS rank FROM d)
SELECT id, n AS duplicate_of, round(1 - distance, 6) AS similarity FROM r WHERE rank = 1 AND round(1 - distance, 9) >= 0.85""",
    "edit_ladder": """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, unnest(range(1, 5)) AS level FROM embeddings),
s AS (SELECT id, level, round(1 - list_cosine_similarity(e, list_transform(e, lambda x, i: CASE WHEN i <= level * 8 THEN x + 0.1 ELSE x END)), 9) AS d FROM v),
u AS (SELECT id, (d >= lag(d) OVER (PARTITION BY id ORDER BY level))::INT AS up FROM s),
p AS (SELECT id, min(up) AS a, sum(up) AS ok, count(*) AS n FROM u WHERE up IS NOT NULL GROUP BY id)
SELECT count(*) AS n_ladders, round(avg(a), 6) AS monotone_rate, round(sum(ok) / sum(n), 6) AS step_rate FROM p""",
    "snippet_entropy": """WITH t AS (SELECT block_id AS id, regexp_extract_all(max(body_text), '([A-Za-z_]+|[0-9]+)', 1) AS t FROM code_blocks GROUP BY 1),
p AS (SELECT id, t[i] AS a, t[i + 1] AS b FROM (SELECT id, t, unnest(range(1, len(t))) AS i FROM t)),
s AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), f AS (SELECT a, sum(n) AS n FROM s GROUP BY a), k AS (SELECT count(DISTINCT w) AS k FROM (SELECT unnest(t) AS w FROM t)),
q AS (SELECT id, a, b, count(*) AS n FROM p GROUP BY ALL)
SELECT id, sum(q.n)::BIGINT AS n_grams, round((sum(q.n * -log2((s.n + 1) / (f.n + k))) / sum(q.n))::DOUBLE, 6) AS entropy FROM q JOIN s USING (a, b) JOIN f USING (a), k GROUP BY id""",
    "lof_scores": f"""WITH {_KNN}, n AS (SELECT id, neighbour, distance FROM r WHERE rank <= 20),
kd AS (SELECT id, max(distance) AS kd FROM n GROUP BY id),
lrd AS (SELECT n.id, 1.0 / greatest(avg(greatest(n.distance, kd.kd)), 1e-12) AS lrd FROM n JOIN kd ON kd.id = n.neighbour GROUP BY n.id)
SELECT n.id, round(avg(o.lrd) / any_value(s.lrd), 6) AS lof FROM n JOIN lrd o ON o.id = n.neighbour JOIN lrd s ON s.id = n.id GROUP BY n.id""",
    "evaluate_auroc": """WITH j AS (SELECT distance AS s, category = 'hook:body' AS p FROM judged_nodes WHERE category IN ('function:body', 'hook:body') AND distance IS NOT NULL AND NOT isnan(distance)),
c AS (SELECT s, count(*) FILTER (WHERE p) AS p, count(*) FILTER (WHERE NOT p) AS n FROM j GROUP BY s),
b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round((sum(p * (below + n / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auroc FROM b""",
    "evaluate_flag_rates": "SELECT j.category, count(*) AS n_judged, round(avg((distance > coalesce(threshold, 0.1))::INT), 6) AS flag_rate FROM judged_nodes j LEFT JOIN cfm_calibration c ON c.category = j.category WHERE distance IS NOT NULL AND NOT isnan(distance) GROUP BY j.category",
    "vector_upsert": f"WITH {_VEC} SELECT model, category, count(*) AS n_nodes, count(*) FILTER (WHERE len(embedding) = 64) AS n_valid FROM v GROUP BY ALL",
    "stored_distance": f"""WITH {_VEC}, ok AS (SELECT * FROM v WHERE len(embedding) = 64), f AS (SELECT category, model, arg_min(embedding, node_id) AS e FROM ok GROUP BY ALL)
SELECT node_id, round(1 - coalesce(CASE WHEN isnan(list_cosine_similarity(ok.embedding::DOUBLE[], f.e::DOUBLE[])) THEN 0 ELSE list_cosine_similarity(ok.embedding::DOUBLE[], f.e::DOUBLE[]) END, 0), 6) AS distance FROM ok JOIN f USING (category, model)""",
}
