"""Neighbour graphs, PageRank, and subjects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.operators import feedback, graph, search, subjects
from vectrail.plans.sql import DISTANCES, IMAGES, distances, knn_edges, pagerank
from vectrail.sources.embeddings import images

K, PPR_K, SEEDS, TOP = 5, 5, [3, 50, 121], 10
PLACES = 6


def _graph(measure):
    return lambda spark, d: graph.knn_graph(images(spark, d), K, measure).withColumn("distance", F.round("distance", PLACES))


def _trained(spark, d):
    return images(spark, d).withColumn("train", F.col("image_id") % 10 != 0)


def ppr_seed_vector(spark, d):
    return graph.label_seeds(images(spark, d), "dorsal").withColumn("mass", F.round("mass", 9))


def ppr_dominant(spark, d):
    return graph.dominant(images(spark, d), SEEDS, PPR_K, TOP).withColumn("pagerank", F.round("pagerank", 9))


def ppr_scores(spark, d):
    """Ranks of all nodes from one side's seeds."""
    rows = images(spark, d)
    return graph.pagerank(graph.transitions(graph.knn_graph(rows, PPR_K), PPR_K), graph.label_seeds(rows, "palmar")).withColumn("pagerank", F.round("pagerank", 9))


def ppr_classify(spark, d):
    return graph.classify(_trained(spark, d), F.col("train"))


def _results(spark, d):
    return search.nearest(images(spark, d), 0, 20)



def _marked(spark, d):
    """Feedback on the first results: the first three are relevant, the fourth and fifth not."""
    place = F.row_number().over(Window.orderBy("score", "image_id"))
    return _results(spark, d).withColumn("ordinal", place).where("ordinal <= 5").select("image_id", (F.col("ordinal") <= 3).alias("relevant"), "ordinal")


def ppr_feedback(spark, d):
    ranked, _ = feedback.by_pagerank(_results(spark, d), images(spark, d), _marked(spark, d))
    return ranked.withColumn("pagerank", F.round("pagerank", 9))


def _probable(compat):
    def run(spark, d):
        rows = images(spark, d)
        found = feedback.by_probability(_results(spark, d), rows, search.vector_of(rows, 0), _marked(spark, d), compat)
        return found.withColumn("score", F.round("score", PLACES))

    return run


def rocchio_query(spark, d):
    rows = images(spark, d)
    new = feedback.revised_query(search.vector_of(rows, 0), rows, _marked(spark, d).where("relevant"))
    return new.select(F.posexplode("query").alias("i", "x")).withColumn("x", F.round("x", PLACES))


def subject_means(spark, d):
    return subjects.means(images(spark, d)).select("subject", F.posexplode("features").alias("i", "x")).withColumn("x", F.round("x", PLACES))


def subject_top3(spark, d):
    return subjects.most_similar(images(spark, d), 0).withColumn("similarity", F.round("similarity", PLACES))


def _matrix(compat):
    return lambda spark, d: subjects.matrix(images(spark, d), compat).withColumn("similarity", F.round("similarity", 4))


QUERIES = {
    **{f"knn_graph_{m}": _graph(m) for m in ("euclidean", "manhattan", "cosine", "minkowski3")},
    "ppr_seed_vector": ppr_seed_vector,
    "ppr_scores": ppr_scores,
    "ppr_dominant": ppr_dominant,
    "ppr_classify": ppr_classify,
    "ppr_feedback": ppr_feedback,
    "probabilistic_feedback": _probable(None),
    "probabilistic_feedback_compat": _probable(16),
    "rocchio_query": rocchio_query,
    "subject_means": subject_means,
    "subject_top3": subject_top3,
    "subject_matrix": _matrix(False),
    "subject_matrix_compat": _matrix(True),
}

_CLASS_K = 15
_SEEDS = lambda side, where="TRUE": f"(SELECT image_id AS node, CASE WHEN aspect_of_hand LIKE '%{side}%' AND {where} THEN 1.0::DOUBLE ELSE 0 END / (SELECT count(*) FROM images WHERE aspect_of_hand LIKE '%{side}%' AND {where}) AS mass FROM images)"
_RESULTS = f"""q AS (SELECT features AS query FROM images WHERE image_id = 0),
results AS (SELECT image_id, {DISTANCES['euclidean']} AS score, features FROM images, q WHERE image_id <> 0 ORDER BY score, image_id LIMIT 20),
marked AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score, image_id) AS ordinal FROM results) WHERE ordinal <= 5)"""
_BITS = "list_transform(features, lambda x: CASE WHEN x >= list_sum(features) / len(features) THEN 1 ELSE 0 END)"
_AGREE = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: CASE WHEN {a}[i] = {b}[i] THEN 1 ELSE 0 END))"


def _probability_sql(n: float, r: float, compat: bool) -> str:
    odds = "p * (1 - u) / u * (1 - p)" if compat else "p * (1 - u) / (u * (1 - p))"
    return f"""WITH {IMAGES}, {_RESULTS}, rel AS (SELECT image_id, score, ordinal, {_BITS} AS bits FROM marked WHERE ordinal <= 3),
qb AS (SELECT {_BITS} AS q FROM images WHERE image_id = 0),
e AS (SELECT a.image_id, any_value(a.score) AS score, any_value(a.ordinal) AS ordinal, CAST(any_value({_AGREE('a.bits', 'qb.q')}) AS DOUBLE) AS n, CAST(sum({_AGREE('a.bits', 'b.bits')}) AS DOUBLE) AS r FROM rel a, rel b, qb GROUP BY 1),
pu AS (SELECT *, (r + n / {n}) / ({r} + 1) AS p, (n - r + n / {n}) / ({n - r + 1}) AS u FROM e),
o AS (SELECT *, {odds} AS odds FROM pu),
g AS (SELECT image_id, -sum(score * CASE WHEN odds > 0 THEN ln(CASE WHEN odds > 0 THEN odds ELSE 1 END) ELSE 'nan'::DOUBLE END) OVER (ORDER BY ordinal) AS score FROM o)
SELECT image_id, round(score, 6) AS score FROM g UNION ALL SELECT image_id, round(score, 6) FROM results WHERE image_id NOT IN (SELECT image_id FROM rel)"""


_MEANS = f"""{IMAGES}, m AS (SELECT subject, i, avg(features[i]) AS x FROM images, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
v AS (SELECT subject, list(x ORDER BY i) AS features FROM m GROUP BY 1)"""
_INVERSE = lambda d: f"CASE WHEN {d} = 0 THEN 100 ELSE 100 / {d} END"
_PAIR = distances("a.features", "b.features")["euclidean"]



def classified_sql(every: int) -> str:
    """Predictions for the rows whose id is a multiple of every, from the others."""
    return f"""WITH RECURSIVE {IMAGES}, {knn_edges('manhattan', _CLASS_K)}, jd AS {_SEEDS('dorsal', f'image_id % {every} <> 0')}, jp AS {_SEEDS('palmar', f'image_id % {every} <> 0')},
{pagerank(_CLASS_K, 'jd', 'pd')}, {pagerank(_CLASS_K, 'jp', 'pp')}
SELECT pd.node AS image_id, CASE WHEN pd.p > pp.p THEN 'dorsal' WHEN pd.p < pp.p THEN 'palmar' ELSE 'unknown' END AS predicted FROM pd JOIN pp ON pd.node = pp.node WHERE pd.step = 60 AND pp.step = 60 AND pd.node % {every} = 0"""


ORACLES = {
    **{f"knn_graph_{m}": f"WITH {IMAGES}, {knn_edges(m, K)} SELECT src, dst, round(distance, {PLACES}) AS distance, rank FROM edges" for m in ("euclidean", "manhattan", "cosine", "minkowski3")},
    "ppr_seed_vector": f"WITH {IMAGES} SELECT node, round(mass, 9) AS mass FROM {_SEEDS('dorsal')}",
    "ppr_scores": f"WITH RECURSIVE {IMAGES}, {knn_edges('euclidean', PPR_K)}, jump AS {_SEEDS('palmar')}, {pagerank(PPR_K, 'jump')} SELECT node, round(p, 9) AS pagerank FROM pr WHERE step = 60",
    "ppr_dominant": f"""WITH RECURSIVE {IMAGES}, {knn_edges('euclidean', PPR_K)}, jump AS (SELECT image_id AS node, CASE WHEN image_id IN ({', '.join(map(str, SEEDS))}) THEN 1.0::DOUBLE / {len(SEEDS)} ELSE 0 END AS mass FROM images), {pagerank(PPR_K, 'jump')}
SELECT node, round(p, 9) AS pagerank FROM pr WHERE step = 60 ORDER BY p DESC, node LIMIT {TOP}""",
    "ppr_classify": classified_sql(10),
    "ppr_feedback": f"""WITH RECURSIVE {IMAGES}, {_RESULTS}, {knn_edges('euclidean', 5, 'results')},
raw AS (SELECT r.image_id AS node, 1.0::DOUBLE / 20 + CASE WHEN m.ordinal <= 3 THEN 1 WHEN m.ordinal <= 5 THEN -1 ELSE 0 END AS x FROM results r LEFT JOIN marked m ON m.image_id = r.image_id),
jump AS (SELECT node, x / (SELECT sum(x) FROM raw) AS mass FROM raw), {pagerank(5, 'jump')} SELECT node AS image_id, round(p, 9) AS pagerank FROM pr WHERE step = 60""",
    "probabilistic_feedback": _probability_sql(20.0, 3.0, False),
    "probabilistic_feedback_compat": _probability_sql(40.0, 48.0, True),
    "rocchio_query": f"""WITH {IMAGES}, {_RESULTS}, m AS (SELECT i, avg(features[i]) AS x FROM marked, (SELECT unnest(range(1, 65)) AS i) WHERE ordinal <= 3 GROUP BY 1)
SELECT CAST(i - 1 AS INTEGER) AS i, round(query[i] * 0.55 + x * 0.45, 6) AS x FROM m, q""",
    "subject_means": f"WITH {_MEANS} SELECT subject, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM m",
    "subject_top3": f"""WITH {_MEANS}, d AS (SELECT a.subject, {_PAIR} AS d FROM v a, v b WHERE b.subject = 0 AND a.subject <> 0)
SELECT subject, round({_INVERSE('d')}, 6) AS similarity FROM d ORDER BY {_INVERSE('d')} DESC, subject LIMIT 3""",
    "subject_matrix": f"""WITH {_MEANS}, d AS (SELECT a.subject AS subject_a, b.subject AS subject_b, {_PAIR} AS d FROM v a, v b)
SELECT subject_a, subject_b, round(CASE WHEN subject_a = subject_b THEN 100 ELSE {_INVERSE('d')} END, 4) AS similarity FROM d""",
    "subject_matrix_compat": f"""WITH {_MEANS}, d AS (SELECT a.subject AS subject_a, b.subject AS subject_b, abs(a.features[64] - b.features[64]) AS d FROM v a, v b)
SELECT subject_a, subject_b, round(CASE WHEN subject_a = subject_b THEN 100 ELSE {_INVERSE('d')} END, 4) AS similarity FROM d""",
}
