"""Distances, nearest-neighbour searches and the layered index."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions import labels, vectors
from vectrail.operators import lsh, search
from vectrail.plans.sql import DISTANCES, IMAGES, zipped
from vectrail.sources.embeddings import images

TOP, QUERY = 10, 0
HASHES = lsh.fixed_hashes(layers=3, depth=4, dim=64, seed=20)


def _rounded(df, *columns, places: int = 6):
    for c in columns:
        df = df.withColumn(c, F.round(c, places))
    return df


def _nearest(measure):
    return lambda spark, d: _rounded(search.nearest(images(spark, d), QUERY, TOP, measure), "score")


def _nearest_by(score):
    def run(spark, d):
        rows = images(spark, d)
        query = search.vector_of(rows, QUERY)
        scored = rows.crossJoin(F.broadcast(query)).select("image_id", score(F.col("features"), F.col("query")).alias("score"))
        return _rounded(scored.where(F.col("image_id") != QUERY).orderBy("score", "image_id").limit(TOP), "score")

    return run


def _keypoints(v):
    return F.transform(F.sequence(F.lit(1), F.lit(57), F.lit(8)), lambda s: F.slice(v, s, F.lit(8)))


def knn_label_restricted(spark, d):
    return _rounded(search.nearest(images(spark, d), QUERY, TOP, where=labels.condition("palmar")), "score")


def knn_label_sentinel(spark, d):
    few = labels.condition("palmar") & labels.condition("male") & (F.col("image_id") < 40)
    return _rounded(search.nearest_with_sentinel(images(spark, d), QUERY, 15, few), "score")


def distance_scores(spark, d):
    """Every measure of every row against one query."""
    rows = images(spark, d)
    q, f = F.col("query"), F.col("features")
    return _rounded(
        rows.crossJoin(F.broadcast(search.vector_of(rows, QUERY))).select(
            "image_id", vectors.l2(f, q).alias("l2"), vectors.l1(f, q).alias("l1"), vectors.minkowski(f, q).alias("l3"), vectors.cosine_similarity(f, q).alias("cosine"),
            vectors.inverse_similarity(vectors.l2(f, q)).alias("similarity"), vectors.exponential_kernel(f, q, 1 / 64).alias("kernel"),
        ), "l2", "l1", "l3", "cosine", "similarity", "kernel", places=5,
    )


def lsh_buckets(spark, d):
    return lsh.buckets(images(spark, d), HASHES).select("image_id", "layer", F.array_join(F.col("numbers").cast("array<string>"), "-").alias("numbers"))


def lsh_index(spark, d):
    return lsh.build(images(spark, d), HASHES)


def lsh_search(spark, d):
    rows = images(spark, d)
    return _rounded(lsh.search(lsh.build(rows, HASHES), rows, QUERY, HASHES, TOP), "score")


def lsh_stats(spark, d):
    rows = images(spark, d)
    return lsh.statistics(lsh.build(rows, HASHES), rows, QUERY, HASHES)


def binarize_agreement(spark, d):
    rows = images(spark, d)
    scored = rows.crossJoin(F.broadcast(search.vector_of(rows, QUERY)))
    return scored.select("image_id", vectors.agreement(vectors.binarise(F.col("features")), vectors.binarise(F.col("query"))).cast("bigint").alias("agreeing"))


QUERIES = {
    "knn_l2": _nearest("euclidean"),
    "knn_l1": _nearest("manhattan"),
    "knn_minkowski3": _nearest("minkowski3"),
    "knn_cosine": _nearest("cosine"),
    "knn_window_l2": _nearest_by(lambda a, q: vectors.sliced_l2(a, q, 3)),
    "knn_block_hist": _nearest_by(lambda a, q: vectors.sliced_l2(a, q, 16)),
    "sift_degenerate_distance": _nearest_by(vectors.set_distance_flat),
    "sift_keypoint_distance": _nearest_by(lambda a, q: vectors.keypoint_distance(_keypoints(a), _keypoints(q))),
    "knn_label_restricted": knn_label_restricted,
    "knn_label_sentinel": knn_label_sentinel,
    "distance_scores": distance_scores,
    "lsh_buckets": lsh_buckets,
    "lsh_index": lsh_index,
    "lsh_search": lsh_search,
    "lsh_stats": lsh_stats,
    "binarize_agreement": binarize_agreement,
}


def _nearest_sql(score: str, descending: bool = False, where: str = "TRUE") -> str:
    return f"""WITH {IMAGES}, q AS (SELECT features AS query FROM images WHERE image_id = {QUERY}),
s AS (SELECT image_id, {score} AS score FROM images, q WHERE image_id <> {QUERY} AND ({where}))
SELECT image_id, round(score, 6) AS score FROM s ORDER BY s.score {'DESC' if descending else ''}, image_id LIMIT {TOP}"""


def _sliced(width: int) -> str:
    ends = f"range(1, {64 - width + 2}, {width})"
    inner = f"sqrt(list_sum(list_transform(range(s, s + {width}), lambda i: (features[i] - query[i]) * (features[i] - query[i]))))"
    return f"list_sum(list_transform({ends}, lambda s: {inner}))"


_SET = "list_sum(list_transform(query, lambda x: sqrt(list_sum(list_transform(features, lambda y: (y - x) * (y - x)))))) / len(query)"
_KEYPOINT = """list_sum(list_transform(range(0, 8), lambda a: list_min(list_transform(range(0, 8), lambda b:
  sqrt(list_sum(list_transform(range(1, 9), lambda i: (query[a * 8 + i] - features[b * 8 + i]) * (query[a * 8 + i] - features[b * 8 + i]))))))))  / 8"""


def _buckets_sql() -> str:
    """numbers(image_id, layer, numbers list) from the literal hashes."""
    parts = []
    for n, layer in enumerate(HASHES.planes):
        each = []
        for p in layer:
            v = "[" + ", ".join(f"{x:.3f}::DOUBLE" for x in p) + "]"
            size = sum(x * x for x in p) ** 0.5
            each.append(f"CAST(ceil(abs({zipped('features', v, '*')}) / {size!r}::DOUBLE / {HASHES.width!r}::DOUBLE) AS BIGINT)")
        parts.append(f"SELECT image_id, {n} AS layer, [{', '.join(each)}] AS numbers FROM images")
    return f"{IMAGES}, numbers AS ({' UNION ALL '.join(parts)})"


_INDEX = f"""{_buckets_sql()}, built AS (
  SELECT DISTINCT array_to_string(numbers[1:j], '-') AS key, image_id FROM numbers, (SELECT unnest(range(1, 5)) AS j))
, probed AS (SELECT array_to_string(numbers[1:4 - j], '-') AS key FROM (SELECT DISTINCT numbers FROM numbers WHERE image_id = {QUERY}), (SELECT unnest(range(0, 4)) AS j))
, q AS (SELECT features AS query FROM images WHERE image_id = {QUERY})"""

ORACLES = {
    "knn_l2": _nearest_sql(DISTANCES["euclidean"]),
    "knn_l1": _nearest_sql(DISTANCES["manhattan"]),
    "knn_minkowski3": _nearest_sql(DISTANCES["minkowski3"]),
    "knn_cosine": _nearest_sql(DISTANCES["cosine"], True),
    "knn_window_l2": _nearest_sql(_sliced(3)),
    "knn_block_hist": _nearest_sql(_sliced(16)),
    "sift_degenerate_distance": _nearest_sql(_SET),
    "sift_keypoint_distance": _nearest_sql(_KEYPOINT),
    "knn_label_restricted": _nearest_sql(DISTANCES["euclidean"], where="aspect_of_hand LIKE '%palmar%'"),
    "knn_label_sentinel": f"""WITH {IMAGES}, q AS (SELECT features AS query FROM images WHERE image_id = {QUERY}),
s AS (SELECT image_id, CASE WHEN aspect_of_hand LIKE '%palmar%' AND gender = 'male' AND image_id < 40 THEN {DISTANCES['euclidean']} ELSE 1e11 END AS score FROM images, q WHERE image_id <> {QUERY})
SELECT image_id, round(score, 6) AS score FROM s ORDER BY s.score, image_id LIMIT 15""",
    "distance_scores": f"""WITH {IMAGES}, q AS (SELECT features AS query FROM images WHERE image_id = {QUERY}),
s AS (SELECT image_id, {DISTANCES['euclidean']} AS l2, {DISTANCES['manhattan']} AS l1, {DISTANCES['minkowski3']} AS l3, {DISTANCES['cosine']} AS cosine FROM images, q)
SELECT image_id, round(l2, 5) AS l2, round(l1, 5) AS l1, round(l3, 5) AS l3, round(cosine, 5) AS cosine,
       round(CASE WHEN l2 = 0 THEN 100 ELSE 100 / l2 END, 5) AS similarity, round(exp(-l2 / 64), 5) AS kernel FROM s""",
    "lsh_buckets": f"WITH {_buckets_sql()} SELECT image_id, layer, array_to_string(numbers, '-') AS numbers FROM numbers",
    "lsh_index": f"WITH {_INDEX} SELECT key, image_id FROM built",
    "lsh_search": f"""WITH {_INDEX}, c AS (SELECT DISTINCT image_id FROM built WHERE key IN (SELECT key FROM probed)),
s AS (SELECT image_id, {DISTANCES['euclidean']} AS score FROM images, q WHERE image_id IN (SELECT image_id FROM c))
SELECT image_id, round(score, 6) AS score FROM s WHERE s.score <> 0 ORDER BY s.score, image_id LIMIT {TOP}""",
    "lsh_stats": f"""WITH {_INDEX}, s AS (SELECT image_id, {DISTANCES['euclidean']} AS score FROM images, q)
SELECT CAST(count(DISTINCT CASE WHEN s.score <> 0 THEN b.image_id END) AS BIGINT) AS unique_candidates, CAST(count(*) AS BIGINT) AS overall_candidates
FROM probed p JOIN built b ON b.key = p.key JOIN s ON s.image_id = b.image_id""",
    "binarize_agreement": f"""WITH {IMAGES}, b AS (SELECT image_id, list_transform(features, lambda x: CASE WHEN x >= list_sum(features) / len(features) THEN 1 ELSE 0 END) AS bits FROM images),
q AS (SELECT bits AS q FROM b WHERE image_id = {QUERY})
SELECT image_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN bits[i] = q[i] THEN 1 ELSE 0 END)) AS BIGINT) AS agreeing FROM b, q""",
}
