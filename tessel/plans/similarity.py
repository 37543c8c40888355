"""Queries over vectors: nearest items, pairs, patches, merge suggestions, names, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import vectors as V
from tessel.operators import diagnostics, knn, naming, pairs
from tessel.plans import fixtures as X
from tessel.plans.registry import registry

QUERIES, ORACLES, query = registry()


def _d(name: str = "distance", places: int = 6):
    return F.round(name, places).alias(name)


# --- nearest items -----------------------------------------------------------------------------------------------

_NN_BASE = X.with_(X.IMAGES, X.MODELS, X.PATCHES, X.MEMBERS, X.QUERY)


def _model_sql(weights: dict[str, float], aggregation: str, query: str = "query", patches: bool = False) -> str:
    """CTEs that end in ``blend`` (image_id, distance)."""
    w = " UNION ALL ".join(f"SELECT '{m}' AS model, CAST({x} AS DOUBLE) AS w" for m, x in weights.items())
    size = "CASE WHEN model = 'color' THEN sqrt(list_dot_product(vec, vec)) ELSE 1.0 END"
    scaled = f"scaled AS (SELECT image_id, model, vec, {size} AS n FROM models SEMI JOIN w USING (model)), "
    if aggregation == "centroid":
        mid = f"""parts AS (SELECT model, d, avg(vec[d + 1] / n) AS x FROM scaled JOIN {query} USING (image_id), range(64) AS r(d) WHERE d < len(vec) GROUP BY model, d),
  cent AS (SELECT model, list(x ORDER BY d) AS v FROM parts GROUP BY model),
  dist AS (SELECT s.image_id, s.model, greatest(0.0, 1 - list_dot_product(list_transform(c.v, lambda x: x / sqrt(list_dot_product(c.v, c.v))), s.vec) / s.n) AS d FROM scaled s JOIN cent c USING (model))"""
        how = "avg"
    else:
        mid = f"""q AS (SELECT s.* FROM scaled s JOIN {query} USING (image_id)),
  dist AS (SELECT s.image_id, s.model, min(greatest(0.0, 1 - list_dot_product(q.vec, s.vec) / (q.n * s.n))) AS d FROM scaled s JOIN q USING (model) GROUP BY ALL)"""
        how = "min"
    rows = "SELECT image_id, d, w FROM dist JOIN w USING (model)"
    extra = ""
    if patches:
        extra = f""", ps AS (SELECT a.image_id AS i, b.image_id AS j, a.patch_idx AS pa, b.patch_idx AS pb, list_dot_product(a.vec, b.vec) AS s FROM patches a JOIN patches b ON b.image_id IN (SELECT image_id FROM {query})),
  pm AS (SELECT i, j, sum(m) AS t FROM (SELECT i, j, pa, max(s) AS m FROM ps GROUP BY i, j, pa UNION ALL SELECT i, j, pb, max(s) FROM ps GROUP BY i, j, pb) GROUP BY i, j),
  pd AS (SELECT i AS image_id, {how}(CASE WHEN i = j THEN 0.0 ELSE greatest(0.0, 1 - t / 16) END) AS d FROM pm GROUP BY i)"""
        rows += " UNION ALL SELECT image_id, d, 1.0 FROM pd"
    return f", w AS ({w}), {scaled}{mid}{extra}, blend AS (SELECT image_id, sum(w * d) / sum(w) AS distance FROM ({rows}) GROUP BY image_id)\n"


def _top_sql(where: str = "", query: str = "query", n: int = 50) -> str:
    return f"""SELECT b.image_id, round(b.distance, 6) AS distance, m.group_id, m.name FROM blend b LEFT JOIN members m USING (image_id)
WHERE b.image_id NOT IN (SELECT image_id FROM {query}) {where} ORDER BY b.distance, b.image_id LIMIT {n}"""


def _nn(spark: SparkSession, d: str, weights: dict[str, float], q: DataFrame | None = None, **options) -> DataFrame:
    got = knn.nearest(X.models(spark, d), X.query(spark) if q is None else q, weights, members=X.members(spark, d), fallback="full", **options)
    return got.select("image_id", _d(), "group_id", "name")


@query(_NN_BASE + _model_sql({"full": 1}, "centroid") + _top_sql())
def nn_centroid(spark, d):
    return _nn(spark, d, {"full": 1.0})


@query(_NN_BASE + _model_sql({"full": 1}, "min") + _top_sql())
def nn_min(spark, d):
    return _nn(spark, d, {"full": 1.0}, aggregation="min")


@query(_NN_BASE + _model_sql({"a": 1, "b": 0.5, "color": 0.25}, "centroid") + _top_sql())
def nn_multi_model(spark, d):
    return _nn(spark, d, {"a": 1.0, "b": 0.5, "color": 0.25, "full": 0.0, "unknown": 3.0})


@query(_NN_BASE + _model_sql({"a": 1, "color": 0.5}, "min") + _top_sql(n=500))
def nn_multi_model_min(spark, d):
    return _nn(spark, d, {"a": 1.0, "color": 0.5}, aggregation="min", top_n=9999)


@query(_NN_BASE + _model_sql({"full": 1}, "centroid") + _top_sql("AND m.group_id IS NOT NULL"))
def nn_filter_in_group(spark, d):
    return _nn(spark, d, {"full": 1.0}, only="in-group")


@query(_NN_BASE + _model_sql({"full": 1}, "centroid") + _top_sql("AND m.group_id IS NULL"))
def nn_filter_not_in_group(spark, d):
    return _nn(spark, d, {"full": 1.0}, only="not-in-group")


@query(_NN_BASE + _model_sql({"full": 1}, "centroid") + _top_sql("AND b.image_id IN (SELECT image_id FROM images WHERE label = 3)"))
def nn_restrict(spark, d):
    return _nn(spark, d, {"full": 1.0}, restrict=X.images(spark, d).where("label = 3"))


_MANY = ", many AS (SELECT image_id FROM images WHERE image_id < 100), ranked AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS r, count(*) OVER () AS n FROM many), " + "few AS (SELECT image_id FROM ranked JOIN (SELECT DISTINCT (i * 100) // 64 AS r FROM range(64) AS t(i)) USING (r))\n"


@query(_NN_BASE + _MANY + _model_sql({"full": 1}, "min", "few") + _top_sql(query="many"))
def nn_downsample(spark, d):
    return _nn(spark, d, {"full": 1.0}, q=X.images(spark, d).where("image_id < 100").select("image_id"), aggregation="min")


@query(_NN_BASE + _model_sql({"full": 1}, "centroid", patches=True) + _top_sql())
def nn_patch_blend(spark, d):
    return _nn(spark, d, {"full": 1.0}, patches=X.patches(spark, d))


# --- pairs -------------------------------------------------------------------------------------------------------


@query(X.with_(X.IMAGES) + """SELECT a.image_id AS i, b.image_id AS j, round(greatest(0.0, 1 - list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec)))), 6) AS d
FROM images a JOIN images b ON a.image_id < b.image_id""")
def pairwise_cosine(spark, d):
    return pairs.cosine_pairs(X.images(spark, d)).select("i", "j", _d("d"))


@query(X.with_(X.IMAGES, X.MODELS) + """, parts AS (SELECT image_id, model, CASE model WHEN 'a' THEN list_transform(vec, lambda x: x * 1.0) WHEN 'b' THEN list_transform(vec, lambda x: x * 0.5)
  ELSE list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)) * 0.25) END AS v FROM models WHERE model <> 'full'),
  joined AS (SELECT image_id, flatten(list(v ORDER BY model)) AS v FROM parts GROUP BY image_id),
  sized AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM joined)
SELECT a.image_id AS i, b.image_id AS j, round(greatest(0.0, 1 - list_dot_product(a.v, b.v) / (a.n * b.n)), 6) AS d FROM sized a JOIN sized b ON a.image_id < b.image_id""")
def pairwise_weighted_concat(spark, d):
    return pairs.weighted_pairs(X.models(spark, d), {"a": 1.0, "b": 0.5, "color": 0.25}).select("i", "j", _d("d"))


@query(X.with_(X.IMAGES, X.MODELS) + """, w AS (SELECT 'a' AS model, 1.0::DOUBLE AS w UNION ALL SELECT 'b', 0.5 UNION ALL SELECT 'color', 0.25), q AS (SELECT * FROM models SEMI JOIN w USING (model) WHERE image_id IN (3, 17, 42))
SELECT q.image_id AS i, m.image_id AS j, round(greatest(0.0, 1 - sum(w * w * list_dot_product(q.vec, m.vec)) / (sqrt(sum(w * w * list_dot_product(q.vec, q.vec))) * sqrt(sum(w * w * list_dot_product(m.vec, m.vec))))), 6) AS d
FROM q JOIN models m USING (model) JOIN w USING (model) WHERE q.image_id <> m.image_id GROUP BY ALL""")
def weighted_closed_form(spark, d):
    w = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(0.5), F.lit("color"), F.lit(0.25))
    m = X.models(spark, d).where(F.col("model") != "full")
    q = m.where(F.col("image_id").isin(X.QUERY_IDS)).select(F.col("image_id").alias("i"), "model", F.col("vec").alias("q"))
    rows = m.join(F.broadcast(q), "model").where("i <> image_id").withColumn("w2", w[F.col("model")] * w[F.col("model")])
    part = lambda a, b: F.sum(F.col("w2") * V.dot(F.col(a), F.col(b)))
    got = rows.groupBy("i", F.col("image_id").alias("j")).agg(part("q", "vec").alias("x"), part("q", "q").alias("a"), part("vec", "vec").alias("b"))
    return got.select("i", "j", F.round(V.weighted_cosine(F.col("x"), F.col("a"), F.col("b")), 6).alias("d"))


@query(X.with_(X.IMAGES) + "SELECT image_id, round(sqrt(list_dot_product(vec[1:16], vec[1:16])), 6) AS norm, round(list_dot_product(vec[1:16], vec[17:32]), 6) AS dot, round(1 - list_dot_product(vec[1:16], vec[17:32]) / (sqrt(list_dot_product(vec[1:16], vec[1:16])) * sqrt(list_dot_product(vec[17:32], vec[17:32]))), 6) AS distance, round(vec[3] / sqrt(list_dot_product(vec[1:16], vec[1:16])), 6) AS third FROM images")
def vector_functions(spark, d):
    a, b = F.slice("vec", 1, 16), F.slice("vec", 17, 16)
    return X.images(spark, d).select("image_id", F.round(V.norm(a), 6).alias("norm"), F.round(V.dot(a, b), 6).alias("dot"), F.round(V.cosine_distance(a, b), 6).alias("distance"), F.round(V.unit(a)[2], 6).alias("third"))


_PATCH_PAIRS = """ps AS (SELECT a.image_id AS i, b.image_id AS j, a.patch_idx AS pa, b.patch_idx AS pb, list_dot_product(a.vec, b.vec) AS s FROM patches a JOIN patches b ON {on}),
  scores AS (SELECT i, j, sum(m) / 16 AS score FROM (SELECT i, j, pa, max(s) AS m FROM ps GROUP BY i, j, pa UNION ALL SELECT i, j, pb, max(s) FROM ps GROUP BY i, j, pb) GROUP BY i, j)"""


@query(X.with_(X.IMAGES, X.PATCHES, _PATCH_PAIRS.format(on="a.image_id < b.image_id")) + "SELECT i, j, round(greatest(0.0, 1 - score), 6) AS d FROM scores")
def patch_match(spark, d):
    return pairs.patch_pairs(X.patches(spark, d)).select("i", "j", _d("d"))


_GROUPS = X.with_(X.IMAGES, X.PATCHES, X.MEMBERS, "mp AS (SELECT m.group_id, m.group_pos, m.member_pos, p.* FROM members m JOIN patches p USING (image_id))", """ps AS (SELECT a.group_id AS ga, b.group_id AS gb, a.group_pos AS pa, b.group_pos AS pb, a.member_pos AS ma, b.member_pos AS mb, a.image_id AS i, b.image_id AS j, a.patch_idx AS x, b.patch_idx AS y, list_dot_product(a.vec, b.vec) AS s FROM mp a JOIN mp b ON a.group_pos < b.group_pos)""",
    """sc AS (SELECT ga, gb, pa, pb, ma, mb, i, j, sum(m) / 16 AS s FROM (SELECT ga, gb, pa, pb, ma, mb, i, j, x, max(s) AS m FROM ps GROUP BY ALL UNION ALL SELECT ga, gb, pa, pb, ma, mb, i, j, y, max(s) FROM ps GROUP BY ALL) GROUP BY ALL)""",
    """sizes AS (SELECT group_id, count(*) AS n FROM members GROUP BY 1 HAVING count(*) >= 2)""",
    """gs AS (SELECT ga AS group_a, gb AS group_b, pa AS a_pos, pb AS b_pos, any_value(u.n) AS size_a, any_value(v.n) AS size_b, (list(s ORDER BY s DESC))[1 + count(*) // 2] AS patch_median, (list(s ORDER BY s DESC))[1 + 3 * count(*) // 4] AS patch_p75, max(s) AS patch_best,
    (list(i ORDER BY s DESC, ma, mb))[1] AS closest_a, (list(j ORDER BY s DESC, ma, mb))[1] AS closest_b FROM sc JOIN sizes u ON ga = u.group_id JOIN sizes v ON gb = v.group_id GROUP BY ga, gb, pa, pb)""")


@query(_GROUPS + "SELECT group_a, group_b, size_a, size_b, round(patch_median, 6) AS patch_median, round(patch_p75, 6) AS patch_p75, round(patch_best, 6) AS patch_best, closest_a, closest_b FROM gs")
def group_similarity(spark, d):
    got = pairs.group_similarity(X.members(spark, d), X.patches(spark, d))
    return got.select("group_a", "group_b", "size_a", "size_b", _d("patch_median"), _d("patch_p75"), _d("patch_best"), "closest_a", "closest_b")


@query(_GROUPS + """, two AS (SELECT group_a AS r, group_b AS o, b_pos AS p, 1 - patch_median AS d FROM gs WHERE patch_median >= 0.3 AND size_a + size_b <= 100 UNION ALL SELECT group_b, group_a, a_pos, 1 - patch_median FROM gs WHERE patch_median >= 0.3 AND size_a + size_b <= 100),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, p) AS rank, min(d) OVER (PARTITION BY r) AS best FROM two) SELECT r AS ref_group, CAST(rank AS INTEGER) AS rank, o AS similar_group, round(d, 6) AS distance, round(best, 6) AS best FROM ranked WHERE rank <= 3""")
def merge_suggestions_topk(spark, d):
    got = pairs.group_similarity(X.members(spark, d), X.patches(spark, d), max_combined=100)
    got = pairs.merge_suggestions(got, min_score=0.3, per_group=3, max_size=100, groups=X.members(spark, d))
    return got.select("ref_group", "rank", "similar_group", _d(), _d("best"))


# --- names -------------------------------------------------------------------------------------------------------

_STATS = ", stats AS (SELECT term_pos, term, avg(x) AS mean, sqrt(greatest(0.0, avg(x * x) - avg(x) * avg(x))) AS std FROM (SELECT t.term_pos, t.term, list_dot_product(i.vec, t.vec) AS x FROM images i, terms t) GROUP BY ALL)"


@query(X.with_(X.IMAGES, X.TERMS) + _STATS + "SELECT term_pos, term, round(mean, 6) AS mean, round(std, 6) AS std FROM stats")
def term_stats(spark, d):
    return naming.term_stats(X.images(spark, d), X.terms(spark, d)).select("term_pos", "term", _d("mean"), _d("std"))


@query(X.with_(X.IMAGES, X.TERMS) + _STATS + """, parts AS (SELECT label, d, avg(vec[d + 1]) AS x FROM images, range(64) AS r(d) GROUP BY label, d), raw AS (SELECT label, list(x ORDER BY d) AS v FROM parts GROUP BY label),
  cent AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM raw), z AS (SELECT label, t.term, t.term_pos, CASE WHEN std > 1e-10 THEN (list_dot_product(c.v, t.vec) - mean) / std ELSE 0.0 END AS z FROM cent c, terms t JOIN stats USING (term_pos))
SELECT label AS cluster_id, CAST(row_number() OVER (PARTITION BY label ORDER BY z DESC, term_pos) AS INTEGER) AS rank, term, round(z, 6) AS z FROM z QUALIFY row_number() OVER (PARTITION BY label ORDER BY z DESC, term_pos) <= 8""")
def cluster_tags(spark, d):
    v = X.images(spark, d)
    got = naming.cluster_tags(v.select(F.col("label").alias("cluster_id"), "image_id"), v, X.terms(spark, d))
    return got.select("cluster_id", "rank", "term", _d("z"))


@query()
def auto_names(spark, d):
    v = X.images(spark, d)
    return naming.auto_names(v.select(F.col("label").alias("cluster_id"), "image_id"), v, X.terms(spark, d))


# --- diagnostics -------------------------------------------------------------------------------------------------

_COS = "greatest(0.0, 1 - list_dot_product(a.{v}, b.{v}) / (sqrt(list_dot_product(a.{v}, a.{v})) * sqrt(list_dot_product(b.{v}, b.{v}))))"
_MEMBER_PAIRS = X.with_(X.IMAGES, X.MEMBERS, "mv AS (SELECT m.*, i.vec, i.vec[1:16] AS color FROM members m JOIN images i USING (image_id))", f"mp AS (SELECT a.group_id AS ga, b.group_id AS gb, a.group_pos AS pa, b.group_pos AS pb, a.image_id AS i, b.image_id AS j, a.member_pos AS ma, b.member_pos AS mb, {_COS.format(v='vec')} AS sd, {_COS.format(v='color')} AS cd FROM mv a JOIN mv b ON a.group_id <> b.group_id)")


def _member_vectors(spark, d):
    v = X.images(spark, d).select("image_id", "vec", F.slice("vec", 1, 16).alias("color"))
    return X.members(spark, d).join(v, "image_id")


@query(_MEMBER_PAIRS + """SELECT ga AS group_a, gb AS group_b, round(min(sd), 6) AS least, round(avg(sd), 6) AS mean, round((list(sd ORDER BY sd))[1 + CAST(floor(count(*) * 0.1) AS INTEGER)], 6) AS p10, round((list(sd ORDER BY sd))[1 + CAST(floor(count(*) * 0.25) AS INTEGER)], 6) AS p25, round((list(sd ORDER BY sd))[1 + CAST(floor(count(*) * 0.5) AS INTEGER)], 6) AS median,
  round((1 - avg(cd)) * (1 - avg(sd)), 6) AS composite FROM mp WHERE pa < pb GROUP BY ga, gb""")
def diag_pair_metrics(spark, d):
    got = diagnostics.pair_metrics(_member_vectors(spark, d))
    return got.select("group_a", "group_b", *(_d(c) for c in ("least", "mean", "p10", "p25", "median", "composite")))


@query(_MEMBER_PAIRS + """, best AS (SELECT ga, i, arg_min(gb, (sd, pb, mb)) AS gb FROM mp GROUP BY ga, i), n AS (SELECT group_id, count(*) AS n FROM members GROUP BY 1)
SELECT ga AS group_a, gb AS group_b, round(count(*) / any_value(n.n), 6) AS fraction FROM best JOIN n ON ga = n.group_id GROUP BY ga, gb""")
def diag_nn_fraction(spark, d):
    return diagnostics.nearest_fraction(_member_vectors(spark, d)).select("group_a", "group_b", _d("fraction"))


@query(_MEMBER_PAIRS + f""", inner_d AS (SELECT a.group_id AS g, {_COS.format(v='vec')} AS d FROM mv a JOIN mv b ON a.group_id = b.group_id AND a.image_id < b.image_id), med AS (SELECT g, (list(d ORDER BY d))[1 + count(*) // 2] AS t FROM inner_d GROUP BY g)
SELECT ga AS group_a, gb AS group_b, round(any_value(t), 6) AS threshold, round(avg(CASE WHEN sd < t THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM mp JOIN med ON ga = g GROUP BY ga, gb""")
def diag_overlap(spark, d):
    return diagnostics.overlap(_member_vectors(spark, d)).select("group_a", "group_b", _d("threshold"), _d("overlap"))


@query(_MEMBER_PAIRS + """, t AS (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS threshold), hit AS (SELECT ga, gb, threshold, i, max(CASE WHEN cd < threshold THEN 1.0 ELSE 0.0 END) AS h FROM mp, t GROUP BY ALL), f AS (SELECT ga, gb, threshold, avg(h) AS f FROM hit GROUP BY ALL)
SELECT a.ga AS group_a, a.gb AS group_b, a.threshold, round(a.f, 6) AS fraction_ab, round(b.f, 6) AS fraction_ba, round((a.f + b.f) / 2, 6) AS mean FROM f a JOIN f b ON a.ga = b.gb AND a.gb = b.ga AND a.threshold = b.threshold WHERE a.ga < a.gb""")
def diag_color_gate(spark, d):
    got = diagnostics.color_gate(_member_vectors(spark, d), [0.5, 0.7, 0.9])
    return got.select("group_a", "group_b", "threshold", _d("fraction_ab"), _d("fraction_ba"), _d("mean"))


@query(_MEMBER_PAIRS + """SELECT ga AS group_a, gb AS group_b, i AS image_id, round(arg_min(cd, (cd * sd, pb, mb)), 6) AS color_d, round(arg_min(sd, (cd * sd, pb, mb)), 6) AS semantic_d, round(min(cd * sd), 6) AS product FROM mp GROUP BY ga, gb, i""")
def diag_multiplicative(spark, d):
    got = diagnostics.multiplicative(_member_vectors(spark, d))
    return got.select("group_a", "group_b", "image_id", _d("color_d"), _d("semantic_d"), _d("product"))


@query(_GROUPS + f""", mv AS (SELECT m.*, i.vec FROM members m JOIN images i USING (image_id)), cs AS (SELECT a.group_id AS ga, b.group_id AS gb, 1 - {_COS.format(v='vec')} AS s FROM mv a JOIN mv b ON a.group_pos < b.group_pos),
  c AS (SELECT ga, gb, (list(s ORDER BY s DESC))[1 + count(*) // 2] AS median, (list(s ORDER BY s DESC))[1 + 3 * count(*) // 4] AS p75 FROM cs GROUP BY ga, gb)
SELECT group_a, group_b, round(c.median, 6) AS vector_median, round(c.p75, 6) AS vector_p75, round(patch_median, 6) AS patch_median, round(patch_p75, 6) AS patch_p75, round(patch_median - c.median, 6) AS delta FROM gs JOIN c ON ga = group_a AND gb = group_b""")
def diag_vector_against_patches(spark, d):
    got = diagnostics.vector_against_patches(_member_vectors(spark, d), pairs.group_similarity(X.members(spark, d), X.patches(spark, d)))
    return got.select("group_a", "group_b", *(_d(c) for c in ("vector_median", "vector_p75", "patch_median", "patch_p75", "delta")))
