"""Filters, lookups, joins on keys, and feature transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vectrail.functions import features, labels
from vectrail.plans.sql import IMAGES
from vectrail.sources import store
from vectrail.sources.embeddings import images

WIDTH = 16


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def label_filters(spark, d):
    """Rows that each of the eight labels takes, in one pass."""
    rows = images(spark, d)
    counts = rows.agg(*[F.count_if(labels.condition(x)).alias(x) for x in labels.LABELS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").alias("n")) for x in labels.LABELS])).alias("r")).select("r.label", "r.n")


def label_maps(spark, d):
    """Opposite and type of each label, and the true label of rows for each type."""
    rows = images(spark, d)
    asked = reduce(lambda a, b: a.unionByName(b), [rows.withColumn("label", F.lit(x)) for x in labels.LABELS])
    kind = labels.type_of(F.col("label"))
    truth = labels.true_label(kind, F.col("aspect_of_hand"), F.col("accessories"), F.col("gender"))
    return asked.select("image_id", "label", labels.opposite(F.col("label")).alias("opposite"), kind.alias("kind"), truth.alias("actual"), labels.side_of(F.col("aspect_of_hand")).alias("side"))


def metadata_semi_join(spark, d):
    """Orders of one market segment: metadata kept for the keys that a listing holds."""
    wanted = _table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _table(spark, d, "orders").join(wanted, "o_custkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def point_lookup(spark, d):
    return images(spark, d).where("image_id = 7").select("image_id", "subject", F.round(F.get("features", F.lit(0)), 6).alias("first"))


def missing_features(spark, d):
    """Images without reduced features yet (those of even subjects have them)."""
    rows = images(spark, d)
    return store.missing(rows.select("image_id"), rows.where("subject % 2 = 0"), "image_id")


def feature_upsert(spark, d):
    """New values where keys match, new rows where they do not: sizes of small parts, brought up to date by sales of all parts."""
    parts = _table(spark, d, "part").where("p_size <= 25").select("p_partkey", F.col("p_size").cast("int").alias("size"))
    sold = _table(spark, d, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey"))
    return store.upsert(parts, sold.agg(F.max("l_quantity").cast("int").alias("size"), F.count("*").cast("int").alias("batch")), "p_partkey")


def feature_delete(spark, d):
    """Rows whose keys are not in a list of removals."""
    parts = _table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return store.without(parts, parts.where("p_size > 40").select("p_partkey"), "p_partkey").select("p_partkey", "p_brand")


def window_moments(spark, d):
    m = features.window_moments(images(spark, d), WIDTH)
    return m.select("image_id", "window", *[F.round(c, 6).alias(c) for c in ("mean", "std", "skew")])


def group_moments(spark, d):
    """Moments of a column by group, as aggregates: partial sums before the shuffle."""
    x = F.col("l_extendedprice")
    return _table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("std"), F.round(F.coalesce(F.skewness(x), F.lit(0.0)), 6).alias("skew"))


def sign_code_histogram(spark, d):
    codes = images(spark, d).select("image_id", F.explode(features.sign_codes(F.col("features"))).alias("code"))
    return features.shares(codes, ["image_id"], "code").withColumn("share", F.round("share", 6))


def range_histogram(spark, d):
    bins = images(spark, d).select("image_id", F.explode(features.equal_bins(F.col("features"))).alias("bin"))
    return features.shares(bins, ["image_id"], "bin").withColumn("share", F.round("share", 6))


def _scaled(spark, d):
    return images(spark, d).withColumn("features", F.transform("features", lambda x: x * 255))


def cm_bag_of_words(spark, d):
    return features.bag_of_words(_scaled(spark, d))


def truncate_ragged(spark, d):
    """Conversations as lists of (length, turn) pairs, cut to the shortest."""
    pairs = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("s"))
    ragged = pairs.select("conv_id", F.transform("s", lambda x: F.array(x["n"].cast("bigint"), x["turn"])).alias("points"))
    return features.truncated(ragged, "points").select("conv_id", F.array_join(F.col("features").cast("array<string>"), ",").alias("features"))


def one_hot_metadata(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    return features.one_hot(docs, {"lang": ["de", "en", "es", "fr"]}).drop("lang")


def split_columns(spark, d):
    """First word and rest of a name, and base name of a path."""
    name = F.split("p_name", " ", 2)
    return _table(spark, d, "part").select("p_partkey", F.get(name, F.lit(0)).alias("head"), F.get(name, F.lit(1)).alias("tail"))


def base_names(spark, d):
    return _table(spark, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("base"), F.regexp_extract("url", r"^\w+://([^/]+)", 1).alias("host"))


def mean_vector(spark, d):
    return images(spark, d).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.round(F.avg("x"), 6).alias("mean"))


def column_ranges(spark, d):
    return images(spark, d).select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.round(F.min("x"), 6).alias("low"), F.round(F.max("x"), 6).alias("high"))


def rounded_values(spark, d):
    """Half-even rounding to three places."""
    return images(spark, d).select("image_id", F.posexplode("features").alias("i", "x")).select("image_id", "i", F.bround(F.col("x").cast("decimal(20,10)"), 3).cast("double").alias("x"))


def distinct_subjects(spark, d):
    return images(spark, d).select("subject").distinct()


def counts(spark, d):
    return images(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("aspect_of_hand").contains("dorsal")).alias("dorsal"), F.countDistinct("subject").alias("subjects"))


def value_counts(spark, d):
    return _table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def union_classes(spark, d):
    """Two filtered scans, labelled by construction, one on the other."""
    rows = images(spark, d)
    sides = [rows.where(labels.condition(s)).select("image_id", F.lit(s).alias("actual")) for s in ("dorsal", "palmar")]
    return sides[0].unionByName(sides[1])


def ordered_fetch(spark, d):
    """Rows of a list of keys, in the list's order."""
    keys = spark.createDataFrame([(p, k) for p, k in enumerate([31, 4, 159, 26, 5])], "place int, image_id bigint")
    return images(spark, d).join(F.broadcast(keys), "image_id").select("place", "image_id", F.round(F.get("features", F.lit(1)), 6).alias("second"))


_NAMES = (
    "label_filters label_maps metadata_semi_join point_lookup missing_features feature_upsert feature_delete window_moments group_moments sign_code_histogram range_histogram "
    "cm_bag_of_words truncate_ragged one_hot_metadata split_columns base_names mean_vector column_ranges rounded_values distinct_subjects counts value_counts union_classes ordered_fetch"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}

CONDITIONS = {
    "left-hand": "aspect_of_hand LIKE '%left%'", "right-hand": "aspect_of_hand LIKE '%right%'", "dorsal": "aspect_of_hand LIKE '%dorsal%'", "palmar": "aspect_of_hand LIKE '%palmar%'",
    "with-accessories": "accessories = 1", "without-accessories": "accessories = 0", "male": "gender = 'male'", "female": "gender = 'female'",
}
_LABELS = ", ".join(f"('{x}', '{o}', '{k}')" for x, (o, k) in labels.LABELS.items())
_M = "list_sum(v) / len(v)"
_P = lambda p: f"list_sum(list_transform(v, lambda x: pow(x - {_M}, {p}))) / len(v)"
_EACH = "SELECT image_id, i - 1 AS i, features[i] AS x FROM images, (SELECT unnest(range(1, 65)) AS i)"

ORACLES = {
    "label_filters": f"WITH {IMAGES} " + " UNION ALL ".join(f"SELECT '{x}' AS label, CAST(count(*) AS BIGINT) AS n FROM images WHERE {c}" for x, c in CONDITIONS.items()),
    "label_maps": f"""WITH {IMAGES}, l(label, opposite, kind) AS (VALUES {_LABELS})
SELECT image_id, label, opposite, kind,
  CASE kind WHEN 'left-right' THEN split_part(aspect_of_hand, ' ', 2) || '-hand' WHEN 'side' THEN split_part(aspect_of_hand, ' ', 1)
    WHEN 'accessories' THEN CASE WHEN accessories = 1 THEN 'with-accessories' ELSE 'without-accessories' END ELSE gender END AS actual,
  CASE WHEN aspect_of_hand LIKE '%dorsal%' THEN 'dorsal' ELSE 'palmar' END AS side
FROM images, l""",
    "metadata_semi_join": """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
    "point_lookup": f"WITH {IMAGES} SELECT image_id, subject, round(features[1], 6) AS first FROM images WHERE image_id = 7",
    "missing_features": f"WITH {IMAGES} SELECT image_id FROM images WHERE subject % 2 <> 0",
    "feature_upsert": """WITH sold AS (SELECT l_partkey AS k, CAST(max(l_quantity) AS INTEGER) AS size, CAST(count(*) AS INTEGER) AS batch FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT coalesce(p_partkey, k) AS p_partkey, CAST(coalesce(sold.size, p_size) AS INTEGER) AS size, batch FROM (SELECT p_partkey, p_size FROM part WHERE p_size <= 25) FULL JOIN sold ON p_partkey = k""",
    "feature_delete": "SELECT p_partkey, p_brand FROM part WHERE p_size <= 40",
    "window_moments": f"""WITH {IMAGES}, w AS (SELECT image_id, CAST(n AS INTEGER) AS "window", features[n * {WIDTH} + 1:n * {WIDTH} + {WIDTH}] AS v FROM images, (SELECT unnest(range(0, {64 // WIDTH})) AS n))
SELECT image_id, "window", round({_M}, 6) AS mean, round(sqrt({_P(2)}), 6) AS std, round(CASE WHEN {_P(2)} = 0 THEN 0 ELSE ({_P(3)}) / pow({_P(2)}, 1.5) END, 6) AS skew FROM w""",
    "group_moments": """WITH m AS (SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_returnflag, l_linestatus, count(*) AS n, any_value(mu) AS mu, avg(pow(l_extendedprice - mu, 2)) AS m2, avg(pow(l_extendedprice - mu, 3)) AS m3 FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, CAST(n AS BIGINT) AS n, round(mu, 4) AS mean, round(sqrt(m2), 4) AS std, round(m3 / pow(m2, 1.5), 6) AS skew FROM p""",
    "sign_code_histogram": f"""WITH {IMAGES}, c AS (SELECT image_id, unnest(list_transform(range(1, 65), lambda i: CASE WHEN coalesce(features[i + 3], 0) >= features[i] THEN 1 ELSE 0 END)) AS code FROM images)
SELECT image_id, CAST(code AS INTEGER) AS code, CAST(count(*) AS BIGINT) AS n, round(count(*) / (64 + 1e-7), 6) AS share FROM c GROUP BY 1, 2""",
    "range_histogram": f"""WITH {IMAGES}, c AS (SELECT image_id, unnest(list_transform(features, lambda x: CAST(least(floor((x - list_min(features)) / (list_max(features) - list_min(features)) * 10), 9) AS INTEGER))) AS bin FROM images)
SELECT image_id, bin, CAST(count(*) AS BIGINT) AS n, round(count(*) / (64 + 1e-7), 6) AS share FROM c GROUP BY 1, 2""",
    "cm_bag_of_words": f"""WITH {IMAGES}, w AS (SELECT image_id, CAST(trunc(unnest(features) * 255) AS INTEGER) AS v FROM images), b AS (SELECT greatest(0, -min(v)) AS bias FROM w)
SELECT image_id, CAST(v + bias AS INTEGER) AS word, CAST(count(*) AS BIGINT) AS n FROM w, b GROUP BY 1, 2""",
    "truncate_ragged": """WITH s AS (SELECT conv_id, list(length(text)::VARCHAR || ',' || turn::VARCHAR ORDER BY turn) AS p FROM conversations GROUP BY 1), m AS (SELECT min(len(p)) AS least FROM s)
SELECT conv_id, array_to_string(p[1:least], ',') AS features FROM s, m""",
    "one_hot_metadata": "SELECT doc_id, " + ", ".join(f"CAST(coalesce(lang = '{x}', FALSE) AS INTEGER) AS lang_{x}" for x in ("de", "en", "es", "fr")) + " FROM documents",
    "split_columns": "SELECT p_partkey, split_part(p_name, ' ', 1) AS head, CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) END AS tail FROM part",
    "base_names": r"SELECT page_id, split_part(url, '/', -1) AS base, regexp_extract(url, '^\w+://([^/]+)', 1) AS host FROM pages",
    "mean_vector": f"WITH {IMAGES} SELECT CAST(i AS INTEGER) AS i, round(avg(x), 6) AS mean FROM ({_EACH}) GROUP BY 1",
    "column_ranges": f"WITH {IMAGES} SELECT CAST(i AS INTEGER) AS i, round(min(x), 6) AS low, round(max(x), 6) AS high FROM ({_EACH}) GROUP BY 1",
    "rounded_values": f"WITH {IMAGES} SELECT image_id, CAST(i AS INTEGER) AS i, CAST(round_even(CAST(x AS DECIMAL(20,10)), 3) AS DOUBLE) AS x FROM ({_EACH})",
    "distinct_subjects": f"WITH {IMAGES} SELECT DISTINCT subject FROM images",
    "counts": f"WITH {IMAGES} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (aspect_of_hand LIKE '%dorsal%') AS BIGINT) AS dorsal, CAST(count(DISTINCT subject) AS BIGINT) AS subjects FROM images",
    "value_counts": "SELECT quality, toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY 1, 2",
    "union_classes": f"WITH {IMAGES} SELECT image_id, 'dorsal' AS actual FROM images WHERE {CONDITIONS['dorsal']} UNION ALL SELECT image_id, 'palmar' FROM images WHERE {CONDITIONS['palmar']}",
    "ordered_fetch": f"WITH {IMAGES}, k(place, key) AS (VALUES (0, 31), (1, 4), (2, 159), (3, 26), (4, 5)) SELECT CAST(place AS INTEGER) AS place, image_id, round(features[2], 6) AS second FROM images JOIN k ON image_id = key",
}
