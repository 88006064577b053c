"""Commands over image folders and feature tables: python -m vectrail.cli COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import features, labels
from vectrail.operators import classify, feedback, graph, lsh, reduce, search, subjects
from vectrail.sources import images

METHODS = ("svd", "pca", "nmf", "lda")


def _rows(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A feature table as rows to search: image_id, features of the model, and metadata if there are any."""
    table = spark.read.parquet(a.table).withColumnsRenamed({"image_name": "image_id", a.model: "features"})
    if getattr(a, "metadata", None):
        table = table.join(images.metadata(spark, a.metadata).withColumnsRenamed({"image_name": "image_id", "id": "subject"}), "image_id", "left")
    return table.where(F.col("features").isNotNull())


def extract(spark, a):
    out = images.features(images.decoded(spark, a.folder, a.pattern), tuple(a.models.split(",")))
    out.write.mode("overwrite").parquet(a.table)
    return out.select("image_name")


def similar(spark, a):
    rows = _rows(spark, a)
    if a.label:
        rows = rows.where(labels.condition(a.label) | (F.col("image_id") == a.image))
    if a.method:
        rows, _ = reduce.reduce(rows, a.method, a.k)
    return search.nearest(rows, a.image, a.m, a.measure)


def latent(spark, a):
    reduced, model = reduce.reduce(_rows(spark, a), a.method, a.k)
    return reduce.term_weights(reduced, model).where(F.col("rank") <= a.m).orderBy("component", "rank")


def infer(spark, a):
    rows = _rows(spark, a)
    return classify.infer_label_one_class(rows, a.label, a.image) if a.one_class else classify.infer_label(rows, a.label, a.image)


def subject(spark, a):
    rows = _rows(spark, a)
    return subjects.most_similar(subjects.reduced_means(rows, a.method, a.k) if a.method else rows, a.subject, a.m)


def subject_matrix(spark, a):
    return subjects.matrix(_rows(spark, a)).orderBy("subject_a", "subject_b")


def metadata_latent(spark, a):
    meta = images.metadata(spark, a.metadata).withColumn("side", F.split("aspect_of_hand", " ", 2)[0]).withColumn("hand", F.split("aspect_of_hand", " ", 2)[1])
    values = {c: features.values_of(meta, c) for c in ("gender", "accessories", "side", "hand")}
    names = [f"`{c}_{v}`" for c, vs in values.items() for v in vs]
    rows = features.one_hot(meta, values).select(F.col("image_name").alias("image_id"), F.array(*[F.col(n).cast("double") for n in names]).alias("features"))
    reduced, model = reduce.reduce(rows, "nmf", a.k)
    return reduce.term_weights(reduced, model).where(F.col("rank") <= a.m).orderBy("component", "rank")


def _numbered(rows: DataFrame) -> DataFrame:
    """Graph nodes are numbers: names become hashes."""
    return rows.withColumn("image_name", F.col("image_id")).withColumn("image_id", F.xxhash64("image_id"))


def predict(spark, a):
    rows = _rows(spark, a)
    known = F.col("aspect_of_hand").isNotNull()
    train, test = rows.where(known), rows.where(~known)
    if a.classifier == "latent":
        return classify.by_projection(train, test, a.k)
    if a.classifier == "kmeans":
        return classify.by_two_clusterings(train, test, a.clusters, a.k)
    if a.classifier == "PPR":
        found = classify.train_and_predict(_numbered(train), _numbered(test), "PPR")
        return found.join(_numbered(test).select("image_id", "image_name"), "image_id").select("image_name", "predicted")
    return classify.train_and_predict(train, test, a.classifier, a.k)


def dominant(spark, a):
    rows = _numbered(_rows(spark, a))
    seeds = [r.image_id for r in rows.where(F.col("image_name").isin(a.images.split(","))).select("image_id").collect()]
    found = graph.dominant(rows, seeds, a.k, a.m)
    return found.join(rows.select(F.col("image_id").alias("node"), "image_name"), "node").orderBy(F.desc("pagerank"), "image_name").select("image_name", "pagerank")


def index(spark, a):
    rows = _rows(spark, a)
    hashes = lsh.sample_hashes(rows, layers=a.layers, depth=a.hashes, seed=a.seed)
    lsh.save(lsh.build(rows, hashes), hashes, a.index)
    return spark.read.parquet(f"{a.index}/buckets").agg(F.count("*").alias("entries"))


def probe(spark, a):
    table, hashes = lsh.load(spark, a.index)
    rows = _rows(spark, a)
    lsh.statistics(table, rows, a.image, hashes).show()
    found = lsh.search(table, rows, a.image, hashes, a.m)
    if not a.relevant and not a.irrelevant:
        return found
    marks = [(x, True) for x in filter(None, a.relevant.split(","))] + [(x, False) for x in filter(None, a.irrelevant.split(","))]
    marked = spark.createDataFrame([(x, r, n) for n, (x, r) in enumerate(marks)], "image_id string, relevant boolean, ordinal int")
    if a.classifier == "probabilistic":
        return feedback.by_probability(found, rows, search.vector_of(rows, a.image), marked)
    if a.classifier == "PPR":
        ranked, jump = feedback.by_pagerank(found, rows, marked, previous=spark.read.parquet(a.jump) if a.jump else None)
        if a.jump_out:
            jump.write.parquet(a.jump_out)
        return ranked
    if a.classifier not in ("SVM", "DT"):
        raise SystemExit(f"probe takes DT, SVM, PPR or probabilistic, not {a.classifier}")
    return (feedback.by_svm if a.classifier == "SVM" else feedback.by_tree)(found, rows, marked)


def split(spark, a):
    images.split_metadata(spark, a.folder, a.metadata, a.out)
    return spark.read.option("header", True).csv(a.out)


_OPTIONS = {
    "folder": {}, "table": {}, "metadata": {}, "out": {}, "index": {}, "image": {}, "images": {}, "label": {"choices": list(labels.LABELS)}, "model": {"default": "HOG"}, "models": {"default": "CM,LBP,HOG"},
    "pattern": {"default": "*.jpg"}, "method": {"choices": METHODS}, "measure": {"default": "euclidean"}, "k": {"type": int, "default": 10}, "m": {"type": int, "default": 10}, "subject": {"type": int},
    "classifier": {"default": "DT", "choices": ["latent", "kmeans", "DT", "SVM", "PPR", "probabilistic"]}, "clusters": {"type": int, "default": 5}, "layers": {"type": int, "default": 10}, "hashes": {"type": int, "default": 10},
    "seed": {"type": int, "default": 0}, "relevant": {"default": ""}, "irrelevant": {"default": ""}, "jump": {"default": ""}, "jump-out": {"default": ""}, "one-class": {"action": "store_true"},
}
#: command: (function, options that must be given, further options)
COMMANDS = {
    "extract": (extract, "folder table", "models pattern"),
    "similar": (similar, "table image", "model metadata label method k m measure"),
    "latent": (latent, "table method", "model k m"),
    "infer": (infer, "table metadata label image", "model one-class"),
    "subject": (subject, "table metadata subject", "model method k m"),
    "subject-matrix": (subject_matrix, "table metadata", "model"),
    "metadata-latent": (metadata_latent, "metadata", "k m"),
    "predict": (predict, "table metadata", "model classifier k clusters"),
    "dominant": (dominant, "table images", "model k m"),
    "index": (index, "table index", "model layers hashes seed"),
    "probe": (probe, "table index image", "model m relevant irrelevant classifier jump jump-out"),
    "split": (split, "folder metadata out", ""),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vectrail")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (run, needed, more) in COMMANDS.items():
        p = commands.add_parser(name)
        for o in needed.split():
            p.add_argument(f"--{o}", required=True, **{k: v for k, v in _OPTIONS[o].items() if k != "default"})
        for o in more.split():
            p.add_argument(f"--{o}", **_OPTIONS[o])
        p.set_defaults(run=run)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName("vectrail").getOrCreate(), a).show(50, truncate=False)


if __name__ == "__main__":
    main()
