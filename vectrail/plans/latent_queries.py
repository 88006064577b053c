"""Latent semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectrail.functions import features, labels
from vectrail.operators import reduce, search, subjects
from vectrail.plans.sql import IMAGES, latent_axes, latent_scores
from vectrail.sources.embeddings import images

K = 5


def _rounded(df, column, places=5):
    return df.withColumn(column, F.round(column, places))


def svd_latent(spark, d):
    """Reduced rows (U * S), as component and weight."""
    reduced, _ = reduce.reduce(images(spark, d), "svd", K)
    return _rounded(reduced.select("image_id", F.posexplode("features").alias("component", "weight")), "weight")


def svd_fold_in(spark, d):
    """Rows of one hand in the space that the other hand's rows span."""
    rows = images(spark, d)
    model = reduce.svd(rows.where(labels.condition("left-hand")), K)
    return _rounded(reduce.scores(rows.where(labels.condition("right-hand")), model).select("image_id", F.posexplode("features").alias("component", "weight")), "weight")


def svd_energy(spark, d):
    """Squared singular values and the share of all energy, which has a plain sum to compare with."""
    rows = images(spark, d)
    model = reduce.svd(rows, 64)
    return spark.createDataFrame([(float((model.strength**2).sum()),)], "energy double").select(F.round("energy", 4).alias("energy"))


def pca_scores(spark, d):
    reduced, _ = reduce.reduce(images(spark, d), "pca", K)
    return _rounded(reduced.select("image_id", F.posexplode("features").alias("component", "weight")), "weight")


def pca_variance(spark, d):
    """Total variance over all components."""
    model = reduce.pca(images(spark, d), 64)
    return spark.createDataFrame([(float(model.strength.sum()),)], "variance double").select(F.round("variance", 6).alias("variance"))


def latent_search(spark, d):
    """Nearest rows in the reduced space of a label's rows and the query."""
    rows = images(spark, d).where(labels.condition("dorsal"))
    reduced, _ = reduce.reduce(rows, "pca", 10)
    query = rows.agg(F.min("image_id")).first()[0]
    return _rounded(search.nearest(reduced, query, 10), "score")


def term_weights(spark, d):
    reduced, model = reduce.reduce(images(spark, d), "svd", 3)
    return _rounded(reduce.term_weights(reduced, model), "weight")


def feature_term_weights(spark, d):
    return _rounded(reduce.feature_weights(reduce.as_rows(spark, reduce.svd(images(spark, d), 3))), "weight")


def top_latent_images(spark, d):
    reduced, _ = reduce.reduce(images(spark, d), "svd", K)
    return reduce.top_images(reduced, 3, 7)


def best_latent_image(spark, d):
    rows = images(spark, d)
    return _rounded(reduce.best_image(rows, reduce.svd(rows, K)), "weight")


def _positive(spark, d):
    return images(spark, d).withColumn("features", F.transform("features", F.abs))


def nmf_latent(spark, d):
    reduced, _ = reduce.reduce(_positive(spark, d), "nmf", 3)
    return _rounded(reduced.select("image_id", F.posexplode("features").alias("component", "weight")), "weight", 4)


def metadata_nmf(spark, d):
    """Latent semantics of one-hot metadata."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("image_id"), "lang", "source")
    values = {c: features.values_of(docs, c) for c in ("lang", "source")}
    hot = features.one_hot(docs, values)
    names = [f"`{c}_{v}`" for c, vs in values.items() for v in vs]
    rows = hot.select("image_id", F.array(*[F.col(n).cast("double") for n in names]).alias("features"))
    reduced, _ = reduce.reduce(rows, "nmf", 3)
    return _rounded(reduce.term_weights(reduced), "weight", 4)


def subject_nmf(spark, d):
    """Latent semantics of the subject similarity matrix."""
    m = subjects.matrix(images(spark, d))
    rows = m.groupBy(F.col("subject_a").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("subject_b", "similarity"))).alias("s")).select("image_id", F.transform("s", lambda x: x["similarity"]).alias("features"))
    reduced, _ = reduce.reduce(rows, "nmf", 3)
    return _rounded(reduced.select("image_id", F.posexplode("features").alias("component", "weight")), "weight", 4)


def subject_grid(spark, d):
    """Most similar subjects in several latent spaces."""
    return _rounded(subjects.grid(images(spark, d), 0, ("svd", "pca"), (3, 5)), "similarity", 4)


def lda_topics(spark, d):
    """Topic shares of bags of words; each row sums to one."""
    rows = features.bag_vectors(images(spark, d).withColumn("features", F.transform("features", lambda x: x * 25)))
    shares, _ = reduce.lda(rows, 3, iterations=5)
    return shares.select("image_id", F.size("features").alias("topics"), F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_NAMES = (
    "svd_latent svd_fold_in svd_energy pca_scores pca_variance latent_search term_weights feature_term_weights top_latent_images best_latent_image nmf_latent metadata_nmf subject_nmf subject_grid lda_topics"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}

_LEFT, _RIGHT = ("SELECT * FROM images WHERE aspect_of_hand LIKE '%left%'", "SELECT * FROM images WHERE aspect_of_hand LIKE '%right%'")
_SVD = lambda k: f"WITH {IMAGES}, {latent_axes('images', k)}, scores AS ({latent_scores('ax_x')})"
_WEIGHTS = "SELECT image_id, component, round(weight, 5) AS weight FROM scores"

ORACLES = {
    "svd_latent": f"{_SVD(K)} {_WEIGHTS}",
    "svd_fold_in": f"""WITH {IMAGES}, held AS ({_LEFT}), {latent_axes('held', K)}, cells AS (SELECT image_id, i, features[i] AS x FROM ({_RIGHT}), (SELECT unnest(range(1, 65)) AS i)),
scores AS ({latent_scores('cells')}) {_WEIGHTS}""",
    "pca_scores": f"WITH {IMAGES}, {latent_axes('images', K, centred=True)}, scores AS ({latent_scores('ax_x')}) {_WEIGHTS}",
    "latent_search": f"""WITH {IMAGES}, held AS (SELECT * FROM images WHERE aspect_of_hand LIKE '%dorsal%'), {latent_axes('held', 10, centred=True)}, scores AS ({latent_scores('ax_x')}),
q AS (SELECT component, weight AS asked FROM scores WHERE image_id = (SELECT min(image_id) FROM held))
SELECT image_id, round(sqrt(sum((weight - asked) * (weight - asked))), 5) AS score FROM scores JOIN q USING (component) WHERE image_id <> (SELECT min(image_id) FROM held) GROUP BY 1 ORDER BY sqrt(sum((weight - asked) * (weight - asked))), image_id LIMIT 10""",
    "term_weights": f"{_SVD(3)} SELECT component, image_id, round(weight / strength, 5) AS weight, CAST(row_number() OVER (PARTITION BY component ORDER BY weight / strength DESC, image_id) AS INTEGER) AS rank FROM scores",
    "feature_term_weights": f"WITH {IMAGES}, {latent_axes('images', 3)} SELECT component, CAST(i - 1 AS INTEGER) AS feature_idx, round(w, 5) AS weight, CAST(row_number() OVER (PARTITION BY component ORDER BY w DESC, i) AS INTEGER) AS rank FROM ax",
    "top_latent_images": f"""{_SVD(3)}, r AS (SELECT component, image_id, CAST(round_even(CAST(weight AS DECIMAL(20, 12)), 3) AS DOUBLE) AS weight FROM scores)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY component ORDER BY weight DESC, image_id DESC) AS INTEGER) AS rank FROM r) WHERE rank <= 7""",
    "best_latent_image": f"{_SVD(K)} SELECT component, arg_max(image_id, (weight, image_id)) AS image_id, round(max(weight), 5) AS weight FROM scores GROUP BY 1",
    "svd_energy": f"WITH {IMAGES} SELECT round(sum(list_sum(list_transform(features, lambda x: x * x))), 4) AS energy FROM images",
    "pca_variance": f"WITH {IMAGES}, v AS (SELECT i, var_samp(features[i]) AS v FROM images, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1) SELECT round(sum(v), 6) AS variance FROM v",
    "lda_topics": f"WITH {IMAGES} SELECT image_id, 3 AS topics, 1.0::DOUBLE AS total FROM images",
}
