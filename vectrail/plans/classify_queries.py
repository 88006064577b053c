"""Classifiers and feedback by classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions import labels
from vectrail.operators import classify, feedback
from vectrail.plans import graph_queries
from vectrail.plans.metadata_queries import CONDITIONS
from vectrail.plans.sql import IMAGES, distances, latent_axes, latent_scores
from vectrail.sources.embeddings import images

CLUSTERS, STEPS = 3, 6


def _halves(spark, d):
    """Training and test rows."""
    rows = images(spark, d)
    return rows.where("image_id % 4 <> 0"), rows.where("image_id % 4 = 0")


def _truth(rows):
    return rows.select("image_id", labels.side_of(F.col("aspect_of_hand")).alias("actual"))


def accuracy_report(spark, d):
    """Per cent of labelled documents that a threshold on quality gets right."""
    truth = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("image_id"), F.col("quality").cast("int").alias("actual"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("image_id"), (F.col("n_chars") > 1000).cast("int").alias("predicted"))
    return classify.accuracy(docs.join(truth.select("image_id"), "image_id", "left_semi"), truth).withColumn("accuracy", F.round("accuracy", 6))


def label_threshold_inference(spark, d):
    found = classify.infer_label(images(spark, d), "palmar", 3)
    return found.select(F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), F.round("similarity", 5).alias("similarity"), "label")


def label_grid(spark, d):
    return classify.label_grid(images(spark, d), [3, 8])


def kmeans_assign(spark, d):
    rows = images(spark, d)
    centroids = classify.kmeans(rows, CLUSTERS, STEPS, tolerance=-1.0)
    return classify.assign(rows, centroids).select("image_id", "cluster", F.round("distance", 6).alias("distance"))


def gini_best_split(spark, d):
    rows = images(spark, d).select(F.lit(0).alias("node"), "features", (F.col("subject") % 2).cast("int").alias("target"))
    return classify.best_splits(rows).select("feature", F.round("value", 6).alias("value"), F.round("gain", 6).alias("gain"))


def svd_project_classify(spark, d):
    train, test = _halves(spark, d)
    return classify.by_projection(train, test, 4)


def two_clusterings(spark, d):
    train, test = _halves(spark, d)
    return classify.by_two_clusterings(train, test, CLUSTERS)


def _trained(method):
    def run(spark, d):
        train, test = _halves(spark, d)
        return classify.train_and_predict(train, test, method, k=4)

    return run


def classifier_accuracy(spark, d):
    """Per cent that the tree gets right on rows that it was not fitted on."""
    train, test = _halves(spark, d)
    return classify.accuracy(classify.train_and_predict(train, test, "DT", k=4), _truth(test))


def tree_training_accuracy(spark, d):
    """A full tree repeats its training rows where their features differ."""
    train, _ = _halves(spark, d)
    held = train.withColumn("target", (labels.side_of(F.col("aspect_of_hand")) == "palmar").cast("int"))
    predicted = classify.predict_tree(held, classify.fit_tree(held))
    return classify.accuracy(predicted, held.select("image_id", F.col("target").alias("actual")))


def oneclass_svm(spark, d):
    return classify.infer_label_one_class(images(spark, d), "palmar", 3).withColumn("decision", F.round("decision", 6))


def svm_feedback(spark, d):
    return feedback.by_svm(graph_queries._results(spark, d), images(spark, d), graph_queries._marked(spark, d)).withColumn("score", F.round("score", 6))


def dt_feedback(spark, d):
    return feedback.by_tree(graph_queries._results(spark, d), images(spark, d), graph_queries._marked(spark, d)).withColumn("score", F.round("score", 6))


QUERIES = {
    "accuracy_report": accuracy_report,
    "label_threshold_inference": label_threshold_inference,
    "label_grid": label_grid,
    "kmeans_assign": kmeans_assign,
    "gini_best_split": gini_best_split,
    "svd_project_classify": svd_project_classify,
    "two_clusterings": two_clusterings,
    "tree_classify": _trained("DT"),
    "svm_classify": _trained("SVM"),
    "ppr_train_classify": _trained("PPR"),
    "classifier_accuracy": classifier_accuracy,
    "tree_training_accuracy": tree_training_accuracy,
    "oneclass_svm": oneclass_svm,
    "svm_feedback": svm_feedback,
    "dt_feedback": dt_feedback,
}

_PAIR = distances("a.features", "b.features")["euclidean"]
_NEAR = distances("features", "c")["euclidean"]


def _kmeans_sql() -> str:
    steps = [f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY image_id) - 1 AS INTEGER) AS cluster, features AS c FROM rows ORDER BY image_id LIMIT {CLUSTERS})"]
    for s in range(STEPS + 1):
        steps.append(f"a{s} AS (SELECT image_id, any_value(features) AS features, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT image_id, features, cluster, {_NEAR} AS d FROM rows, c{s}) GROUP BY 1)")
        if s < STEPS:
            steps.append(f"m{s} AS (SELECT cluster, i, avg(features[i]) AS x FROM a{s}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), c{s + 1} AS (SELECT cluster, list(x ORDER BY i) AS c FROM m{s} GROUP BY 1)")
    return f"WITH {IMAGES}, rows AS (SELECT image_id, features FROM images), {', '.join(steps)} SELECT image_id, cluster, round(distance, 6) AS distance FROM a{STEPS}"


def _verdict(asked: str, condition: str, query: int) -> str:
    return f"""g AS (SELECT image_id, features FROM images WHERE {condition} OR image_id = {query}), n AS (SELECT count(*) - 1 AS n FROM g),
m AS (SELECT a.image_id, sum({_PAIR}) / any_value(n) AS mean FROM g a, g b, n GROUP BY 1),
v AS (SELECT max(mean) FILTER (image_id = {query}) AS distance, max(mean) AS threshold FROM m)"""


def _grid_sql() -> str:
    parts = []
    for asked, condition in CONDITIONS.items():
        other = labels.LABELS[asked][0]
        for q in (3, 8):
            inner = f"(WITH {_verdict(asked, condition, q)} SELECT CASE WHEN distance < threshold THEN '{asked}' ELSE '{other}' END FROM v)"
            parts.append(f"SELECT CAST({q} AS BIGINT) AS query_id, '{asked}' AS asked, {inner} AS inferred, CASE WHEN {condition} THEN '{asked}' ELSE '{other}' END AS actual FROM images WHERE image_id = {q}")
    return f"WITH {IMAGES}, all_cases AS ({' UNION ALL '.join(parts)}) SELECT query_id, asked, inferred, inferred = actual AS correct FROM all_cases"


def _projection_sql(k: int) -> str:
    sides, parts = ("dorsal", "palmar"), []
    for side in sides:
        parts += [f"t_{side} AS (SELECT * FROM images WHERE image_id % 4 <> 0 AND aspect_of_hand LIKE '%{side}%')", latent_axes(f"t_{side}", k, side)]
        parts.append(f"m_{side} AS (SELECT image_id, avg(weight) AS m FROM ({latent_scores('cells', side)}) GROUP BY 1)")
    cells = "cells AS MATERIALIZED (SELECT image_id, i, features[i] AS x FROM images, (SELECT unnest(range(1, 65)) AS i) WHERE image_id % 4 = 0)"
    return f"WITH {IMAGES}, {cells}, {', '.join(parts)} SELECT image_id, CASE WHEN d.m < p.m THEN 'dorsal' ELSE 'palmar' END AS predicted FROM m_dorsal d JOIN m_palmar p USING (image_id)"


ORACLES = {
    "svd_project_classify": _projection_sql(4),
    "ppr_train_classify": graph_queries.classified_sql(4),
    "accuracy_report": "SELECT round(100.0 * avg(CAST(CAST(n_chars > 1000 AS INTEGER) = quality AS INTEGER)), 6) AS accuracy FROM documents JOIN labels USING (doc_id)",
    "label_threshold_inference": f"""WITH {IMAGES}, {_verdict('palmar', "aspect_of_hand LIKE '%palmar%'", 3)}
SELECT round(distance, 6) AS distance, round(threshold, 6) AS threshold, round(100 / distance, 5) AS similarity, CASE WHEN distance < threshold THEN 'palmar' ELSE 'dorsal' END AS label FROM v""",
    "label_grid": _grid_sql(),
    "kmeans_assign": _kmeans_sql(),
    "gini_best_split": f"""WITH {IMAGES}, cells AS (SELECT i - 1 AS feature, features[i] AS value, subject % 2 AS target FROM images, (SELECT unnest(range(1, 65)) AS i)),
s AS (SELECT feature, value, count(*) AS n, sum(target) AS ones FROM cells GROUP BY 1, 2),
w AS (SELECT feature, value, CAST(sum(n) OVER down AS DOUBLE) AS l, CAST(sum(ones) OVER down AS DOUBLE) AS l1, CAST(sum(n) OVER whole AS DOUBLE) AS a, CAST(sum(ones) OVER whole AS DOUBLE) AS a1 FROM s
  WINDOW down AS (PARTITION BY feature ORDER BY value DESC ROWS UNBOUNDED PRECEDING), whole AS (PARTITION BY feature)),
g AS (SELECT feature, value, round((1 - pow(a1 / a, 2) - pow((a - a1) / a, 2)) - l / a * (1 - pow(l1 / l, 2) - pow((l - l1) / l, 2)) - (1 - l / a) * (1 - pow((a1 - l1) / (a - l), 2) - pow((a - l - a1 + l1) / (a - l), 2)), 12) AS gain FROM w WHERE l < a)
SELECT CAST(feature AS INTEGER) AS feature, round(value, 6) AS value, round(gain, 6) AS gain FROM g ORDER BY g.gain DESC, g.feature DESC, g.value DESC LIMIT 1""",
    "tree_training_accuracy": "SELECT 100.0::DOUBLE AS accuracy",
}
