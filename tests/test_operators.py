"""Operators against numpy and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from vectrail.functions import features, labels, vectors
from vectrail.operators import classify, feedback, graph, lsh, reduce, search, subjects
from vectrail.sources import store


def frame(spark, x, **columns):
    rows = [(i, [float(a) for a in v], *(c[i] for c in columns.values())) for i, v in enumerate(x)]
    kinds = {int: "int", float: "double", str: "string"}
    return spark.createDataFrame(rows, "image_id bigint, features array<double>" + "".join(f", {n} {kinds[type(c[0])]}" for n, c in columns.items()))


def matrix(df):
    return np.array([r.features for r in df.orderBy("image_id").collect()])


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(60, 6))


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 6.0, 3.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(vectors.l2(a, b), vectors.l1(a, b), vectors.minkowski(a, b), vectors.cosine_similarity(a, b), vectors.inverse_similarity(vectors.l2(a, a)), vectors.sliced_l2(a, b, 1)).first()
    assert got[0] == 5 and got[1] == 7 and got[4] == 100 and got[5] == 7
    assert got[2] == pytest.approx((27 + 64) ** (1 / 3)) and got[3] == pytest.approx(25 / np.sqrt(14 * 61))
    zero = df.select(vectors.cosine_similarity(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), b)).first()[0]
    assert np.isnan(zero)


def test_keypoint_and_flat_set_distances(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [3.0, 4.0]], [[0.0, 1.0]])], "a array<array<double>>, q array<array<double>>")
    assert df.select(vectors.keypoint_distance(F.col("a"), F.col("q"))).first()[0] == 1.0
    same = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert same.select(vectors.set_distance_flat(F.col("v"), F.col("v"))).first()[0] == 1.0


def test_unknown_names_raise(spark, x):
    with pytest.raises(ValueError):
        labels.condition("left")
    with pytest.raises(ValueError):
        vectors.measure("chebyshev")
    with pytest.raises(ValueError):
        reduce.reduce(frame(spark, x), "ica", 2)
    with pytest.raises(ValueError):
        reduce.nmf(frame(spark, x), 2)


def test_nearest_and_restricted(spark, x):
    df = frame(spark, x)
    got = [r.image_id for r in search.nearest(df, 0, 5).collect()]
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    assert got == [i for i in np.argsort(d, kind="stable").tolist() if i != 0][:5]
    few = search.nearest_with_sentinel(df, 0, 6, F.col("image_id") < 4).collect()
    assert sorted(r.image_id for r in few[:3]) == [1, 2, 3] and {r.score for r in few[3:]} == {search.SENTINEL}


@pytest.mark.parametrize("measure", ["euclidean", "manhattan", "minkowski3", "cosine"])
def test_knn_over_several_blocks(spark, x, measure, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    rows = np.vstack([x, x[:5]])  # copies tie
    got = {(r.src, r["rank"]): r.dst for r in search.knn(frame(spark, rows), frame(spark, rows), 4, measure).collect()}
    d = search.pairwise(rows, rows, measure)
    best = np.argsort(-d if measure == "cosine" else d, axis=1, kind="stable")[:, :4]
    assert got == {(i, k + 1): int(best[i, k]) for i in range(len(rows)) for k in range(4)}


def test_pagerank_both_ways(spark, x):
    weights = graph.transitions(graph.knn_graph(frame(spark, x), 4), 4)
    jump = graph.seeds(frame(spark, x), F.col("image_id").isin([3, 9]))
    one = {r.node: r.pagerank for r in graph.pagerank(weights, jump, iterations=7, one_task=True).collect()}
    many = {r.node: r.pagerank for r in graph.pagerank(weights, jump, iterations=7, one_task=False).collect()}
    assert one.keys() == many.keys() and sum(one.values()) == pytest.approx(1)
    assert all(one[i] == pytest.approx(many[i]) for i in one)


def test_svd_pca_against_numpy(spark, x):
    df = frame(spark, x)
    model = reduce.svd(df, 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(model.strength, s[:3]) and np.allclose(np.abs(model.basis), np.abs(vt[:3].T))
    assert (model.basis[np.abs(model.basis).argmax(axis=0), range(3)] > 0).all()
    scores = matrix(reduce.scores(df, model))
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]))
    listed = reduce.term_weights(reduce.scores(df, model), model).where("component = 0 and rank = 1").first()
    assert listed.weight == pytest.approx((scores[:, 0] / s[0]).max())
    centred = matrix(reduce.scores(df, reduce.pca(df, 2)))
    assert np.allclose(centred.mean(axis=0), 0) and np.allclose(centred.var(axis=0, ddof=1), reduce.pca(df, 2).strength)
    assert np.allclose(np.array([r.p for r in df.orderBy("image_id").select(reduce.projected(F.col("features"), model.basis).alias("p")).collect()]), scores)


def test_nmf_error_falls_and_lda_sums_to_one(spark, x):
    positive = np.abs(x)
    df = frame(spark, positive)
    errors = []
    for iterations in (1, 15):
        model = reduce.nmf(df, 3, iterations=iterations)
        w = matrix(reduce.scores(df, model))
        assert (w >= 0).all() and (model.basis >= 0).all()
        errors.append(np.linalg.norm(positive - w @ model.basis.T))
    assert errors[1] < errors[0] < np.linalg.norm(positive)
    shares, _ = reduce.lda(frame(spark, np.round(positive * 5)), 2, iterations=2)
    assert np.allclose(matrix(shares).sum(axis=1), 1)


def test_trees_agree_and_fit_their_rows(spark, x):
    y = [int(a[0] * a[1] > 0) for a in x]
    df = frame(spark, x, target=y)
    small, levels = classify.fit_tree(df), classify.fit_tree(df, small=0)
    assert small == levels
    got = {r.image_id: r.predicted for r in classify.predict_tree(df, small).collect()}
    assert got == dict(enumerate(y))


def test_deep_trees_fit_their_rows(spark):
    """Alternating targets make a tree about as deep as its rows are many; both ways of fitting and whole tasks below levels."""
    y = [i % 2 for i in range(200)]
    df = frame(spark, [[i] for i in range(200)], target=y)
    tree = classify.fit_tree(df, small=196)
    assert tree == classify.fit_tree(df)
    depth = np.zeros(len(tree.feature), int)
    for k in np.flatnonzero(tree.feature >= 0):
        depth[tree.child[k] : tree.child[k] + 2] = depth[k] + 1
    assert depth.max() > 100
    assert {r.image_id: r.predicted for r in classify.predict_tree(df, tree).collect()} == dict(enumerate(y))


def test_plans_do_not_grow_with_a_trees_levels(spark, monkeypatch):
    """Nodes that end at different levels were a join each in the plan of the fit."""
    tables = []
    fit = GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: tables.append(self._df._jdf.queryExecution().analyzed().collectLeaves().size()) or fit(self, *a))
    y = [i % 2 for i in range(24)]
    df = frame(spark, [[i] for i in range(24)], target=y)
    assert classify.fit_tree(df, small=18) == classify.fit_tree(df)
    assert tables == [1, 1]


def test_trees_take_rows_with_missing_numbers(spark, x):
    df = frame(spark, x, target=[int(a[0] > 0) for a in x])
    tree = classify.fit_tree(df.unionByName(spark.createDataFrame([(99, None, 1)], "image_id bigint, features array<double>, target int")))
    assert tree == classify.fit_tree(df)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 1.0]), (4, [float("nan")])], "image_id bigint, features array<double>")
    assert {r.image_id: r.predicted for r in classify.predict_tree(odd, tree).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    none = classify.fit_tree(df.where("false"))
    assert {r.predicted for r in classify.predict_tree(df, none).collect()} == {0}


def test_svm_optimum(spark, x):
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1.0, -1.0)
    k = np.exp(-classify._distances(x) / 6)
    a = classify.solve_dual(np.outer(y, y) * k, -np.ones(60), y, 1.0, np.zeros(60))
    g = y * (k @ (a * y)) - 1
    assert abs(y @ a) < 1e-9 and (a >= -1e-12).all() and (a <= 1 + 1e-12).all()
    up, down = ((y > 0) & (a < 1)) | ((y < 0) & (a > 1e-9)), ((y > 0) & (a > 1e-9)) | ((y < 0) & (a < 1))
    assert (-y * g)[up].max() - (-y * g)[down].min() < 1e-6
    df = frame(spark, x, target=[float(v) for v in y])
    signs = {r.image_id: r.sign for r in classify.predict_svm(df, classify.fit_svm(df, bias="standard")).collect()}
    assert np.mean([signs[i] == y[i] for i in range(60)]) > 0.9


def test_one_class_machine(spark, x):
    df = frame(spark, np.vstack([x, [[40.0] * 6]]))
    model = classify.fit_one_class(df.where("image_id < 60"), gamma=0.05, nu=0.1)
    assert sum(model.weights) == pytest.approx(1)
    signs = {r.image_id: r.decision for r in classify.predict_svm(df, model).collect()}
    assert signs[60] < 0 and sum(signs[i] < -1e-9 for i in range(60)) <= 7


def violated(g, low, high):
    """By how much a gradient of a one-class machine violates the conditions of an optimum."""
    return g[~low].max() - g[~high].min()


@pytest.mark.parametrize(("rows", "gamma"), [(5_200, 0.001), (700, 0.001), (700, 0.05)])
def test_one_class_machines_of_any_size(spark, monkeypatch, rows, gamma):
    """Even gradients and bounds that hold, by the series, by the whole matrix and by the descent."""
    monkeypatch.setattr(classify, "DENSE_ROWS", 699 if gamma == 0.001 else 700)
    z = np.random.default_rng(1).normal(size=(rows, 5)) + ([0] * 5 if rows > 700 else [2, 0, 0, 0, 0])
    z /= np.linalg.norm(z, axis=1)[:, None]
    model = classify.fit_one_class(frame(spark, z), gamma=gamma)
    upper, weight = 1 / (0.08 * rows), {tuple(v): w for v, w in zip(model.vectors.tolist(), model.weights)}
    a = np.array([weight.get(tuple(v), 0.0) for v in z.tolist()])
    g = np.exp(-gamma * ((z[:, None, :] - z[None]) ** 2).sum(axis=2)) @ a if rows < 1000 else classify.Kernel(z, gamma, True).sums(z, a)
    assert a.sum() == pytest.approx(1) and a.min() >= 0 and a.max() <= upper * (1 + 1e-9)
    assert violated(g, a <= 1e-12, a >= upper - 1e-12) < 2e-9


def test_svm_of_more_rows_than_a_matrix_holds(spark):
    z = np.random.default_rng(2).normal(size=(5_200, 2))
    y = np.where(z[:, 0] + np.random.default_rng(3).normal(size=5_200) > 0, 1.0, -1.0)
    model = classify.fit_svm(frame(spark, z, target=y.tolist()), least=1e-12)
    weight = {tuple(v): w for v, w in zip(model.vectors.tolist(), model.weights)}
    a = y * np.array([weight.get(tuple(v), 0.0) for v in z.tolist()])
    g = y * classify.Kernel(z, 0.5, False).sums(z, a * y) - 1
    up, down = ((y > 0) & (a < 1 - 1e-12)) | ((y < 0) & (a > 1e-12)), ((y > 0) & (a > 1e-12)) | ((y < 0) & (a < 1 - 1e-12))
    assert abs(y @ a) < 1e-6 and a.min() >= -1e-12 and a.max() <= 1 + 1e-12
    assert (-y * g)[up].max() - (-y * g)[down].min() < 1e-8


def test_svm_sums_are_those_of_its_support_vectors(spark, x):
    y = np.where(x[:, 0] + 0.3 * x[:, 1] > 0, 1.0, -1.0)
    df = frame(spark, x, target=y.tolist())
    model = classify.fit_svm(df, bias="standard")
    sums = np.exp(-classify._distances(model.vectors) / 6) @ model.weights
    assert model.offset == pytest.approx(float(np.mean(np.sign(model.weights) - sums)))
    got = {r.image_id: r.decision for r in classify.predict_svm(df, model).collect()}
    want = np.exp(-np.sqrt(((x[:, None] - model.vectors[None]) ** 2).sum(axis=2)) / 6) @ model.weights + model.offset
    assert all(got[i] == pytest.approx(want[i]) for i in got)
    odd = spark.createDataFrame([(1, None), (2, [1.0])], "image_id bigint, features array<double>")
    assert {r.sign for r in classify.predict_svm(odd, model).collect()} == {None}


def test_kmeans_stops_and_is_a_fixed_point(spark, x):
    df = frame(spark, x)
    c = classify.kmeans(df, 3)
    got = {r.image_id: r.cluster for r in classify.assign(df, c).collect()}
    near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert got == dict(enumerate(near.tolist()))
    assert all(np.allclose(c[j], x[near == j].mean(axis=0), atol=1e-3) for j in set(near.tolist()))


def test_lsh_results_are_among_brute_force(spark, x, tmp_path):
    df = frame(spark, x)
    hashes = lsh.sample_hashes(df, layers=3, depth=2, seed=1)
    index = lsh.build(df, hashes)
    got = [(r.image_id, r.score) for r in lsh.search(index, df, 0, hashes, 60).collect()]
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    assert all(s == pytest.approx(d[i]) for i, s in got) and [s for _, s in got] == sorted(s for _, s in got)
    stats = lsh.statistics(index, df, 0, hashes).first()
    assert stats.unique_candidates == len(got) <= stats.overall_candidates
    lsh.save(index, hashes, str(tmp_path / "index"))
    again, same = lsh.load(spark, str(tmp_path / "index"))
    assert same == hashes and again.count() == index.count()


def test_feedback_moves_scores(spark, x):
    df = frame(spark, x)
    results = search.nearest(df, 0, 8)
    ids = [r.image_id for r in results.collect()]
    marks = spark.createDataFrame([(ids[0], True, 1), (ids[1], True, 2), (ids[6], False, 3), (ids[7], False, 4)], "image_id bigint, relevant boolean, ordinal int")
    before = {r.image_id: r.score for r in results.collect()}
    for method in (feedback.by_svm, feedback.by_tree):
        after = {r.image_id: r.score for r in method(results, df, marks).collect()}
        assert after.keys() == before.keys() and all(abs(abs(after[i] - before[i]) - 1) < 1e-9 for i in after)
        assert after[ids[0]] < before[ids[0]] and after[ids[7]] > before[ids[7]]
    ranked, jump = feedback.by_pagerank(results, df, marks.where("relevant"), k=3)
    assert sum(r.mass for r in jump.collect()) == pytest.approx(1) and ranked.count() == 8


def test_subject_matrix_is_symmetric(spark, x):
    df = frame(spark, x, subject=[i % 4 for i in range(60)])
    m = {(r.subject_a, r.subject_b): r.similarity for r in subjects.matrix(df).collect()}
    assert len(m) == 16 and all(m[a, b] == m[b, a] for a, b in m) and all(m[a, a] == 100 for a in range(4))


def test_moments_and_ragged_lists(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0, 1.0, 2.0, 5.0])], "image_id int, features array<double>")
    rows = features.window_moments(df, 3).orderBy("window").collect()
    assert tuple(rows[0])[2:] == (1.0, 0.0, 0.0) and rows[1].mean == 3.5 and rows[1]["std"] == 1.5
    ragged = spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[3.0]])], "image_id int, s array<array<double>>")
    assert {r.image_id: r.features for r in features.truncated(ragged, "s").collect()} == {1: [1.0], 2: [3.0]}
    points = spark.createDataFrame([([[7.0, 0.1], [8.0, 0.9]],)], "p array<array<double>>")
    assert points.select(features.strongest_first(F.col("p"))).first()[0] == [[8.0], [7.0]]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "k int, v string, w int")
    assert sorted(map(tuple, store.upsert(old, new, "k").collect())) == [(1, "a", None), (2, "c", 5), (3, "d", 6)]
    assert sorted(map(tuple, store.upsert(old, new, "k", insert=False).collect())) == [(1, "a", None), (2, "c", 5)]
