"""Re-ranking of a result list by relevance feedback. Results are (image_id, score); feedback is (image_id, relevant, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors
from vectrail.operators import classify, graph, subjects
from vectrail.sources import store


def by_predictions(results: DataFrame, predictions: DataFrame) -> DataFrame:
    """Scores one less where the image is predicted relevant, else one more; least first. predictions: image_id, relevant."""
    moved = results.join(predictions, "image_id").select("image_id", (F.col("score") + F.when(F.col("relevant"), -1.0).otherwise(1.0)).alias("score"))
    return moved.orderBy("score", "image_id")


def by_svm(results: DataFrame, rows: DataFrame, feedback: DataFrame) -> DataFrame:
    train = rows.join(feedback, "image_id").select("image_id", "features", F.when(F.col("relevant"), 1.0).otherwise(-1.0).alias("target"))
    model = classify.fit_svm(train)
    held = rows.join(results.select("image_id"), "image_id", "left_semi")
    return by_predictions(results, classify.predict_svm(held, model).select("image_id", (F.col("sign") != -1).alias("relevant")))


def by_tree(results: DataFrame, rows: DataFrame, feedback: DataFrame) -> DataFrame:
    train = rows.join(feedback, "image_id").select("image_id", "features", F.col("relevant").cast("int").alias("target"))
    tree = classify.fit_tree(train)
    held = rows.join(results.select("image_id"), "image_id", "left_semi")
    return by_predictions(results, classify.predict_tree(held, tree).select("image_id", (F.col("predicted") == 1).alias("relevant")))


def jump_after(results: DataFrame, feedback: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """node, mass: the previous mass (uniform at first), one more where relevant and one less where not, by their sum.
    A sum that is not positive leaves the uniform mass."""
    n = results.count()
    nodes = results.select(F.col("image_id").alias("node"))
    start = nodes.withColumn("old", F.lit(1.0 / max(1, n))) if previous is None else nodes.join(previous.select("node", F.col("mass").alias("old")), "node", "left")
    votes = feedback.groupBy("image_id").agg(F.sum(F.when(F.col("relevant"), 1.0).otherwise(-1.0)).alias("vote"))
    raw = start.join(votes, F.col("node") == F.col("image_id"), "left").select("node", (F.coalesce("old", F.lit(0.0)) + F.coalesce("vote", F.lit(0.0))).alias("raw"))
    total = raw.agg(F.sum("raw").alias("total"))
    return raw.crossJoin(F.broadcast(total)).select("node", F.when(F.col("total") > 0, F.try_divide("raw", "total")).otherwise(F.lit(1.0 / max(1, n))).alias("mass"))


def by_pagerank(results: DataFrame, rows: DataFrame, feedback: DataFrame, k: int = 5, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The results by personalised PageRank over their own neighbour graph, and the jump masses for the next round."""
    jump = store.materialised(jump_after(results, feedback, previous), "jump")
    held = rows.join(results.select("image_id"), "image_id", "left_semi")
    ranked = graph.pagerank(graph.transitions(graph.knn_graph(held, k), k), jump)
    return ranked.select(F.col("node").alias("image_id"), "pagerank").orderBy(F.desc("pagerank"), "image_id"), jump


def by_probability(results: DataFrame, rows: DataFrame, query: DataFrame, feedback: DataFrame, compat_id_length: int | None = None) -> DataFrame:
    """Binary independence weights for relevant images, in feedback order: a running value loses d * log odds.

    n: places at which an image agrees with the query; r: those with all relevant images. N is the number of
    results and R of relevant ones; with compat_id_length they are twice the results and R times that length,
    and the ratio keeps its old precedence. Where the logarithm has no value the running value is NaN.
    """
    total, relevant = results.count(), feedback.where("relevant").select("image_id", "ordinal")
    marked = relevant.count()
    n_all = float(total * 2 if compat_id_length else total)
    r_all = float(marked * compat_id_length if compat_id_length else marked)
    vectors_of = rows.join(relevant, "image_id").select("image_id", "ordinal", vectors.binarise(F.col("features")).alias("bits"))
    a, b = vectors_of.alias("a"), F.broadcast(vectors_of.alias("b"))
    r = a.crossJoin(b).groupBy("a.image_id").agg(F.sum(vectors.agreement(F.col("a.bits"), F.col("b.bits"))).cast("double").alias("r"))
    q = query.select(vectors.binarise(F.col("query")).alias("q"))
    each = vectors_of.crossJoin(F.broadcast(q)).select("image_id", "ordinal", vectors.agreement(F.col("bits"), F.col("q")).cast("double").alias("n")).join(r, "image_id").join(results, "image_id")
    p = (F.col("r") + F.col("n") / n_all) / (r_all + 1)
    u = F.try_divide(F.col("n") - F.col("r") + F.col("n") / n_all, F.lit(n_all - r_all + 1))
    odds = F.try_divide(p * (1 - u), u) * (1 - p) if compat_id_length else F.try_divide(p * (1 - u), u * (1 - p))
    gain = F.col("score") * F.when(odds > 0, F.ln(odds)).otherwise(F.lit(float("nan")))
    running = F.sum(-gain).over(Window.partitionBy(F.lit(0)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))  # rows that a user marked
    moved = each.select("image_id", running.alias("score"))
    rest = results.join(relevant, "image_id", "left_anti").select("image_id", "score")
    return moved.unionByName(rest).orderBy("score", "image_id")


def revised_query(query: DataFrame, rows: DataFrame, relevant: DataFrame) -> DataFrame:
    """The query vector moved towards the mean of the relevant images."""
    mean = subjects.means(rows.join(relevant.select("image_id"), "image_id", "left_semi").withColumn("one", F.lit(0)), "one").select(F.col("features").alias("mean"))
    return query.crossJoin(F.broadcast(mean)).select(vectors.rocchio(F.col("query"), F.col("mean")).alias("query"))
