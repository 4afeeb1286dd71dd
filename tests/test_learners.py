"""Learners against brute force and by their optimality conditions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manylabel.functions.labels import to_matrix
from manylabel.operators import algebra, bayes, cuts, enrich, enrich_svm, kernels, language, laplacian, svm, tiles
from manylabel import session
from manylabel.plans import inputs, load_all
from manylabel.plans.registry import QUERIES
from manylabel.session import stage

load_all()
N, D, Q = 60, 15, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, Q, N)
    rates = rng.gamma(0.5, 1.0, (Q, D))
    tf = rng.poisson(rates[labels] + 0.1)
    tf[7] = 0  # a document without terms
    tf[11] = tf[3]  # an exact copy
    rows = [(i, f"t{j:02d}", int(tf[i, j])) for i in range(N) for j in range(D) if tf[i, j]]
    counts = stage(spark.createDataFrame(rows, "id long, term string, tf long"))
    ids = stage(spark.range(N))
    pos = stage(spark.createDataFrame(
        [(i, int(k)) for i, k in enumerate(labels)], "id long, class_id int"))
    norm = np.linalg.norm(tf, axis=1, keepdims=True)
    x = tf / np.where(norm > 0, norm, 1)
    feats = stage(spark.createDataFrame(
        [(i, f"t{j:02d}", float(x[i, j])) for i in range(N) for j in range(D) if tf[i, j]],
        "id long, term string, x double"))
    y = (labels[:, None] == np.arange(Q)).astype(int)
    return dict(tf=tf, x=x, y=y, counts=counts, feats=feats, ids=ids, pos=pos)


def pairs(df):
    return {(r["id"], r["class_id"]) for r in df.select("id", "class_id").collect()}


def nb(tf, y, alpha=1.0, v=None):
    """Margins of binary multinomial naive Bayes with unsmoothed priors."""
    out = []
    for k in range(y.shape[1]):
        c1, c0 = tf[y[:, k] == 1].sum(0), tf[y[:, k] == 0].sum(0)
        v_ = v or tf.shape[1]
        w = np.log((c1 + alpha) / (c1.sum() + alpha * v_)) - np.log(
            (c0 + alpha) / (c0.sum() + alpha * v_))
        out.append(w)
    prior = np.log(y.sum(0)) - np.log((1 - y).sum(0))
    return np.array(out).T, prior


def test_naive_bayes_margins(data):
    y = stage(to_matrix(data["pos"], Q, data["ids"]))
    got = enrich.nb_margins(data["counts"], y, data["ids"], Q).orderBy("id").collect()
    w, prior = nb(data["tf"], data["y"])
    want = data["tf"] @ w + prior
    assert np.allclose([r["m"] for r in got], want, atol=1e-6)
    assert np.allclose(got[7]["m"], prior, atol=1e-6)


def test_multiclass_ties_go_to_the_lowest(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "m array<double>")
    assert df.select(bayes.best_class("m").alias("k")).first()["k"] == 1


def test_linear_equals_explicit_similarities(data):
    sims = data["x"] @ data["x"].T
    for gamma in (5.0, 9.0):
        got = pairs(enrich.linear_well(data["feats"], data["pos"], data["ids"], Q, gamma))
        want = {
            (i, k) for i in range(N) for k in range(Q)
            if data["y"][i, k] or round(sims[i, data["y"][:, k] == 1].sum(), 6) > gamma
        }
        assert got == want


def test_linear_is_monotone(data):
    low, high = (
        pairs(enrich.linear_well(data["feats"], data["pos"], data["ids"], Q, g)) for g in (4, 12)
    )
    assert high <= low and pairs(data["pos"]) <= high


def test_rate_selection():
    cands = [(120, .05), (140, .075), (150, .09), (160, .2)]
    assert enrich.nearest_rate(cands, .08) == 140
    assert enrich.nearest_rate(cands, .08, .08) == 150
    with pytest.raises(ValueError):
        enrich.nearest_rate(cands, .08, .5)


def test_kfold_nb_against_brute_force(data):
    folds = {r["id"]: r["fold"] for r in enrich.assign_folds(data["ids"], 3).collect()}
    fold = np.array([folds[i] for i in range(N)])
    y = data["y"].copy()
    fresh = y.copy()
    for f in range(3):
        w, prior = nb(data["tf"][fold != f], y[fold != f])
        fresh[fold == f] |= (np.round(data["tf"][fold == f] @ w + prior, 6) > 0)
    got = pairs(enrich.kfold_well_nb(data["counts"], data["pos"], data["ids"], Q, max_iters=1))
    assert got == {(i, k) for i, k in zip(*np.nonzero(fresh))}


def test_result_does_not_depend_on_partitions(spark, data):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(pairs(enrich.spy_negatives(data["counts"], data["pos"], data["ids"], Q)))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_spy_negatives_are_below_the_threshold(data):
    spies = pairs(enrich.sample_spies(data["pos"]))
    hidden = data["y"].copy()
    for i, k in spies:
        hidden[i, k] = 0
    w, prior = nb(data["tf"], hidden)
    m = np.round(data["tf"] @ w + prior, 6)
    want = set()
    for k in range(Q):
        scores = sorted(m[i, k] for i, j in spies if j == k)
        limit = scores[int(len(scores) * 0.2)]
        want |= {(i, k) for i in range(N) if not data["y"][i, k] and m[i, k] < limit}
    got = pairs(enrich.spy_negatives(data["counts"], data["pos"], data["ids"], Q))
    assert got == want and not got & pairs(data["pos"])


def test_iteration_reaches_a_stable_labelling(data):
    margins, refits = enrich.iterate_bayes(data["counts"], data["pos"], data["ids"], Q)
    assert all(r <= 50 for r in refits)
    y, m = data["y"], None
    for k in range(Q):
        w, prior = nb(data["tf"], y[:, [k]])
        cur = np.round((data["tf"] @ w + prior)[:, 0], 6)
        for _ in range(50):
            t = (cur > 0).astype(int)[:, None]
            if t.min() == t.max():
                break
            w, prior = nb(data["tf"], t)
            new = np.round((data["tf"] @ w + prior)[:, 0], 6)
            moved = np.abs(1 / (1 + np.exp(-new)) - 1 / (1 + np.exp(-cur))).max()
            cur = new
            if moved <= 0.1:
                break
        m = cur[:, None] if m is None else np.hstack([m, cur[:, None]])
    got = np.array([r["m"] for r in margins.orderBy("id").collect()])
    assert np.allclose(got, m, atol=2e-5)


@pytest.mark.parametrize("pieces", [None, (100, 8 * 3 * 16)])
def test_svm_gradient_vanishes(data, monkeypatch, pieces):
    if pieces:  # many blocks of rows, and sums of their parts in two rounds
        monkeypatch.setattr(tiles, "BLOCK_ENTRIES", pieces[0])
        monkeypatch.setattr(tiles, "PIECE_BYTES", pieces[1])
        monkeypatch.setattr(tiles, "LEAST_SPAN", 4)
        monkeypatch.setattr(tiles, "FAN", 3)
    targets = stage(
        to_matrix(data["pos"], Q, data["ids"]).select("id", enrich_svm.signs().alias("s")))
    costs = [0.3, 1.0, 3.0]
    model = svm.fit(data["feats"], targets, costs, tol=1e-7)
    rows = {r["term"]: r["w"] for r in model.weights.collect()}
    names = [f"t{j:02d}" for j in range(D)] + [""]
    w = np.array([rows.get(n, [0.0] * Q) for n in names])
    x = np.hstack([data["x"], np.ones((N, 1))])
    for k in range(Q):
        s = 2 * data["y"][:, k] - 1
        gap = np.maximum(0, 1 - s * (x @ w[:, k]))
        g = w[:, k] - 2 * costs[k] * x.T @ (s * gap)
        assert np.linalg.norm(g) < 1e-4
    got = np.array([r["m"] for r in model.margins(data["feats"], data["ids"]).orderBy("id").collect()])
    assert np.allclose(got, x @ w, atol=1e-5)


def test_common_directions_do_not_add_svm_steps(spark, monkeypatch):
    """Words that most rows share, in groups, as in texts of several languages."""
    rng = np.random.default_rng(5)
    n, groups = 200, 12
    own = np.eye(groups)[np.arange(n) % groups] * np.geomspace(0.05, 4.0, groups)
    x = np.hstack([own, rng.poisson(0.4, (n, 2)) * 0.3])
    cells = [(i, f"w{j:02d}", float(x[i, j])) for i in range(n) for j in range(x.shape[1]) if x[i, j]]
    feats = stage(spark.createDataFrame(cells, "id long, term string, x double"))
    s = np.where(rng.random(n) < 0.2, 1, -1)
    targets = stage(spark.createDataFrame([(i, [v]) for i, v in enumerate(s.tolist())], "id long, s array<tinyint>"))
    sent, through = [], tiles.Tiles.through
    monkeypatch.setattr(tiles.Tiles, "through", lambda *a: sent.append(1) or through(*a))
    model = svm.fit(feats, targets, 10.0, tol=1e-4)
    assert len(sent) <= 20
    rows = {r["term"]: r["w"][0] for r in model.weights.collect()}
    w = np.array([rows[f"w{j:02d}"] for j in range(x.shape[1])] + [rows[""]])
    x = np.hstack([x, np.ones((n, 1))])
    g = w - 20 * x.T @ (s * np.maximum(0, 1 - s * (x @ w)))
    assert np.linalg.norm(g) <= 2e-4 * 20 * np.linalg.norm(x.T @ s)


def test_one_sided_tasks_are_constant(spark, data):
    targets = data["ids"].select(
        "id", F.array(F.lit(1), F.lit(-1), F.when(F.col("id") < 20, 1).otherwise(-1))
        .cast("array<tinyint>").alias("s"))
    model = svm.fit(data["feats"], stage(targets), 0.3)
    assert model.constant == [1.0, -1.0, None]
    row = model.margins(data["feats"], data["ids"]).first()
    assert row["m"][0] == 1.0 and row["m"][1] == -1.0


@pytest.fixture(scope="module")
def cloud(spark):
    """Two clusters of bags of words; half of the true positives are labelled."""
    rng = np.random.default_rng(2)
    n = 80
    rates = np.vstack([np.r_[np.full(6, 3.0), np.full(6, .3)], np.r_[np.full(6, .3), np.full(6, 3.0)]])
    truth = np.arange(n) < n // 2
    tf = rng.poisson(rates[np.where(truth, 0, 1)])
    rows = [(i, f"t{j}", int(tf[i, j])) for i in range(n) for j in range(12) if tf[i, j]]
    counts = stage(spark.createDataFrame(rows, "id long, term string, tf long"))
    norm = np.linalg.norm(tf, axis=1)
    feats = stage(spark.createDataFrame(
        [(i, t, v / float(norm[i])) for i, t, v in rows], "id long, term string, x double"))
    labels = stage(spark.createDataFrame([(i, 0) for i in range(n // 4)], "id long, class_id int"))
    return counts, feats, labels, stage(spark.range(n)), truth


@pytest.mark.parametrize("method", [enrich_svm.nb_svm, enrich_svm.spy_svm, enrich_svm.iter_spy_svm])
def test_hidden_positives_are_found(cloud, method):
    counts, feats, labels, ids, truth = cloud
    options = {"c": 1.0}
    found = {i for i, _ in pairs(method(counts, feats, labels, ids, 1, **options))}
    hidden = {i for i in range(20, 40)}
    assert len(found & hidden) >= 16
    assert len({i for i in found if not truth[i]}) <= 6


def test_kfold_svm_only_adds(data):
    got = pairs(enrich_svm.kfold_well(data["feats"], data["pos"], data["ids"], Q, max_iters=1))
    assert pairs(data["pos"]) <= got


def test_every_row_keeps_a_label(data):
    got = pairs(enrich_svm.nb_svm(data["counts"], data["feats"], data["pos"], data["ids"], Q))
    assert {i for i, _ in got} == set(range(N))


@pytest.mark.parametrize("alpha, beta, gamma", [(100, 10, 1e-3), (0.01, 100, 1e-3), (0, 10, 1e-3)])
def test_smoothing_against_enumeration(data, alpha, beta, gamma):
    rows, g = laplacian.kernel_rows(data["feats"], data["ids"], gamma)
    relaxed = stage(laplacian.relax(data["feats"], rows, data["pos"], Q, alpha, beta, g))
    got = pairs(laplacian.best_threshold(data["feats"], relaxed, alpha, beta, g))
    x = np.array([r["x"] for r in relaxed.orderBy("id").collect()])
    e = np.exp(-g * (data["x"] ** 2).sum(1))
    w = np.outer(e, e) * (1 + 2 * g * data["x"] @ data["x"].T)
    lap = np.diag(w.sum(1)) - w
    for k in range(Q):
        y = data["y"][:, k]
        m, v = alpha * lap + beta * np.diag(y), 2 * beta * y - 1
        grad, xk = 2 * m @ x[:, k] - v, np.round(x[:, k], 9)
        kkt = np.where(xk <= 0, np.minimum(grad, 0), np.where(xk >= 1, np.maximum(grad, 0), grad))
        assert np.abs(kkt).max() <= 1e-8 * max(alpha * N, beta)
        best = None
        for cut in sorted(xk)[:-1]:
            f = (xk > cut).astype(int)
            value = round(float(f @ m @ f - v @ f), 6)
            if best is None or value < best[0]:
                best = (value, f)
        assert {i for i, j in got if j == k} == set(np.flatnonzero(best[1]))


def test_weights_are_solved_together(data, monkeypatch):
    """Many small tiles give the labels that each weight alone gives."""
    rows, g = laplacian.kernel_rows(data["feats"], data["ids"], 1e-3)
    alphas = (0.0, 0.01, 1.0, 100.0)
    alone = {
        a: np.array([r["x"] for r in laplacian.relax(data["feats"], rows, data["pos"], Q, a, 50, g).orderBy("id").collect()])
        for a in (0.0, 1.0)
    }
    for name, value in (("BLOCK_ENTRIES", 60), ("LEAST_SPAN", 4), ("PIECE_BYTES", 8 * Q * 4 * 16), ("FAN", 3)):
        monkeypatch.setattr(tiles, name, value)
    x = np.array([r["x"] for r in laplacian.relax_weights(data["feats"], rows, data["pos"], Q, alphas, 50, g).orderBy("id").collect()])
    assert x.shape == (N, Q * len(alphas))
    for i, a in enumerate(alphas):
        if a in alone:
            assert np.allclose(x[:, i * Q : (i + 1) * Q], alone[a], atol=1e-8)


def test_first_order_kernel_refuses_a_large_gamma(data):
    with pytest.raises(ValueError, match="too large"):
        laplacian.kernel_rows(data["feats"], data["ids"], 0.5)


@pytest.mark.parametrize("sizes", [None, (7, 20, 4)])
def test_exact_kernel(spark, data, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("BLOCK_ROWS", "BLOCK_ENTRIES", "TERMS"), sizes):
            monkeypatch.setattr(kernels, name, value)
    a = np.random.default_rng(1).normal(size=(N, 2))
    values = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, a array<double>")
    got = np.array([r["u"] for r in kernels.rbf_times(data["feats"], values, 0.7).orderBy("id").collect()])
    x = data["x"]
    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.allclose(got, np.exp(-0.7 * square) @ a, atol=1e-9)
    assert kernels.rbf_times(data["feats"], values.limit(0), 0.7).count() == 0


def test_best_prefix_against_all_sets(spark):
    rng = random.Random(4)
    nodes = [(i, [rng.randint(0, 6) / 4.0, None if i % 5 == 0 else rng.random()], [float(i % 3 == 0), None]) for i in range(40)]
    edges = [(rng.randrange(40), rng.randrange(44), rng.randint(1, 8) / 4.0) for _ in range(150)] + [(3, 3, 9.0), (None, 2, 1.0)]
    x = spark.createDataFrame(nodes, "id long, x array<double>, y array<double>")
    w = spark.createDataFrame(edges, "src long, dst long, w double").repartition(3)
    got = {(r.class_id, r.cut): (r.size, r.value) for r in cuts.prefix_objectives(x, w, 0.5, 2.0).collect()}
    want = {}
    for k in (0, 1):
        at = {i: v[k] for i, v, _ in nodes if v[k] is not None}
        values = sorted(set(at.values()))
        tied = list(at.values()).count(values[-1]) > 1
        for c in values[1:] + [None] * tied:
            inside = {i for i, v in at.items() if c is not None and v >= c}
            value = sum(1 - 2.0 * (nodes[i][2][k] or 0) for i in inside)
            value += sum(0.5 * e for a, b, e in edges if a in at and b in at and (a in inside) != (b in inside))
            want[k, c] = (len(inside), round(value, 6))
    assert got == want
    best = {r.class_id: (r.value, -r.size) for r in cuts.best_prefix(x, w, 0.5, 2.0).collect()}
    assert best == {k: min((v, -n) for (j, _), (n, v) in want.items() if j == k) for k in (0, 1)}
    assert cuts.best_prefix(x.limit(0), w, 0.5, 2.0).count() == 0


def test_prefix_labels_keep_the_given_ones(spark):
    nodes = spark.createDataFrame([(i, [5.0 - i]) for i in range(6)], "id long, x array<double>").selectExpr("id", "x", "array(IF(id < 3, 1D, 0D)) AS y")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 0.5), (3, 4, 1.0), (4, 5, 1.0)], "src long, dst long, w double")
    labels = spark.createDataFrame([(5, 0)], "id long, class_id int")
    got = sorted(tuple(r) for r in cuts.prefix_labels(nodes, edges, labels, 1.0, 3.0).select("id", "class_id").collect())
    assert got == [(0, 0), (1, 0), (2, 0), (5, 0)]


def test_partitions_grow_with_the_input(spark, sf_dir, monkeypatch):
    """Counts of an input many times a partition's size are made in that many tasks."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", 200)
    monkeypatch.setattr(session, "_open", lambda s: s.conf.get(session.SHUFFLE) in ("200", s.conf.get(session.TUNED, None)))
    monkeypatch.setattr(session, "PARTITION_BYTES", 1 << 14)
    session.tune(own)
    assert session.shuffle_width(own) == own.sparkContext.defaultParallelism
    docs = inputs.cleaned(own, sf_dir)
    assert session.shuffle_width(own) > 3 * own.sparkContext.defaultParallelism
    counts = inputs.term_counts(docs)
    assert counts.rdd.getNumPartitions() == session.shuffle_width(own)
    session.tune(own)
    assert session.shuffle_width(own) == own.sparkContext.defaultParallelism
    own.conf.set("spark.sql.shuffle.partitions", 5)  # someone's choice stays
    inputs.cleaned(own, sf_dir)
    assert session.shuffle_width(own) == 5


def test_blocks_send_only_terms_of_several_rows(spark, monkeypatch):
    """A product is that of the matrix, and a term of a single row never leaves its block."""
    monkeypatch.setattr(tiles, "BLOCK_ENTRIES", 30)
    monkeypatch.setattr(tiles, "COLUMNS", 2)
    rng = np.random.default_rng(5)
    n, common = 40, 6
    x = np.zeros((n, common + 5 * n))
    x[:, :common] = rng.random((n, common)) * (rng.random((n, common)) < 0.4)
    x[:2, :common] = 1.0  # every common term has two rows at least
    for i in range(n):
        x[i, common + 5 * i : common + 5 * i + 5] = rng.random(5)
    cells = [(i, f"t{j}", float(x[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(x)))]
    features = stage(spark.createDataFrame(cells, "id long, term string, x double"))
    terms = stage(features.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    numbered, shared = tiles.spread_index(terms)
    assert shared == common
    entries = features.join(numbered, "term").select("id", "idx", "x")
    ids = spark.range(n).select("id", F.array(F.lit(1), F.lit(1), F.lit(1)).cast("array<tinyint>").alias("s"))
    made = tiles.Tiles(entries, ids, x.shape[1], shared, 3, len(cells), n)
    y = {r["r"]: (np.frombuffer(r["ids"], np.int64), rng.normal(size=(r["n"], 3))) for r in made.rows.collect()}
    assert len(y) > 3
    vectors = stage(spark.createDataFrame([(r, bytearray(v.tobytes())) for r, (_, v) in y.items()], "r int, v binary"))
    whole = np.zeros((n, 3))
    for at, v in y.values():
        whole[at] = v
    full = np.hstack([x, np.ones((n, 1))])
    for r in made.through(vectors, 3).collect():
        assert np.allclose(np.frombuffer(r["v"]).reshape(-1, 3), (full @ full.T @ whole)[y[r["r"]][0]])
    sent = made._sent(vectors, [(0, 3)]).filter("c >= 0").agg(F.sum(F.length("at")), F.sum(F.length("v"))).first()
    held = sum(1 + np.count_nonzero(x[at, :common].any(axis=0)) for at, _ in y.values())
    assert tuple(sent) == (4 * held, 24 * held)


def test_rows_stay_in_their_blocks(spark, data, monkeypatch):
    """A large table of terms goes to the blocks; only its answers move, the rows do not."""
    monkeypatch.setattr(algebra, "BROADCAST_BYTES", 0)
    scores = lambda rows: {r["id"]: r["s"] for r in enrich.class_similarity(rows, data["pos"], data["ids"], Q).collect()}
    want = scores(data["feats"])
    feats = session.stage_by_block(data["feats"], "feats")
    block = session.block_of(feats.columns)
    assert feats.groupBy(block).count().count() == session.block_width(block) == session.shuffle_width(spark)
    got = scores(feats)
    assert len(got) == N and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)
    table = stage(feats.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.array(F.sum("x")).alias("w")))
    with session.placed_by_block(spark):
        joined = algebra.join_terms(feats, table).groupBy(block, "id").agg(F.sum("x"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    # Neither the rows nor partial sums of their ids are dealt anew.
    assert f"ShuffledHashJoin [{block}#" in plan and "hashpartitioning(" not in plan


def test_settled_classes_take_no_part(data, monkeypatch):
    widths, fit = [], enrich.nb_margins

    def counted(counts, y, ids, q, *more):
        widths.append(q)
        return fit(counts, y, ids, q, *more)

    monkeypatch.setattr(enrich, "nb_margins", counted)
    _, refits = enrich.iterate_bayes(data["counts"], data["pos"], data["ids"], Q)
    assert widths == [Q] + [sum(r > i for r in refits) for i in range(max(refits))]
    assert sum(widths) < Q * len(widths)


@pytest.mark.parametrize("name", ["tfidf_options", "count_vectors", "linear_well", "nb_margins", "detect_language"])
def test_blocks_give_the_same_rows(spark, sf_dir, monkeypatch, name):
    found = []
    for limit in (algebra.BROADCAST_BYTES, 0):
        monkeypatch.setattr(algebra, "BROADCAST_BYTES", limit)
        table = QUERIES[name](spark, sf_dir).toArrow().to_pydict()
        found.append(sorted(zip(*(table[c] for c in sorted(table)))))
    assert len(found[0]) == len(found[1])
    for a, b in zip(*found):
        assert a == pytest.approx(b, abs=2e-6) if not any(isinstance(v, str) or v is None for v in a) else str(a)[:30] == str(b)[:30]


def test_pairs_of_blocks_are_dealt_by_their_bytes(spark, monkeypatch):
    """Pairs grow with the square of the blocks; what a task reads does not."""
    monkeypatch.setattr(kernels, "TASK_BYTES", 4000)
    for count in (4, 16):
        blocks = spark.range(count).selectExpr(
            "cast(id as int) r", *[f"cast(repeat('x', 100) as binary) {c}" for c in ("row", "idx", "x", "a")]
        )
        units = kernels.block_pairs(blocks, count, 400)
        held = [n for n in units.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
        assert sum(held) == count * count and len(held) == max(session.shuffle_width(spark), -(-count * count // 10))
        assert max(held) <= 40


def test_frequent_terms_are_broadcast_and_lone_ones_stay(spark, sf_dir, monkeypatch):
    """Beyond the limit, only rows of the terms between the two go to the blocks; results stay."""
    corpus = inputs.Corpus(spark, sf_dir)
    scores = lambda f: {r["id"]: r["s"] for r in enrich.class_similarity(f, corpus.labels, corpus.ids, inputs.Q).collect()}
    want = scores(corpus.features.drop("lone"))
    monkeypatch.setattr(algebra, "BROADCAST_BYTES", 1 << 15)
    asked, join = [], algebra.join_blocks

    def counted(rows, table, on=("term",), step=None, missing=None):
        asked.append((rows.select("term").distinct().count(), table.count(), step))
        return join(rows, table, on, step, missing)

    monkeypatch.setattr(algebra, "join_blocks", counted)
    features = inputs.tfidf(corpus.counts, corpus.n)
    terms, several, step = asked[0]
    assert several < terms and step is not None  # terms of one document are in no table
    assert features.filter("lone").select("term").distinct().count() == terms - several
    got = scores(features)
    assert all(t == several for t, _, _ in asked[1:]) and len(asked) == 2
    assert len(got) == len(want) and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)
    same = lambda f: sorted((r["id"], r["term"], r["x"]) for r in f.collect())
    for a, b in zip(same(features), same(corpus.features), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    # A vocabulary from elsewhere says nothing about these documents.
    assert "lone" not in inputs.tfidf(corpus.counts, 10, features.groupBy("term").agg(F.count("id").alias("df"))).columns


def test_no_text_is_staged(spark, sf_dir):
    with session.staging() as made:
        inputs.Corpus(spark, sf_dir)
    assert made and not any("text" in spark.read.parquet(path).columns for path, _ in made)


def test_trigrams_of_the_training_texts_are_counted_once(spark, sf_dir, monkeypatch):
    calls, count = [], language.trigram_counts

    def counted(df, *more):
        calls.append(df)
        return count(df, *more)

    monkeypatch.setattr(language, "trigram_counts", counted)
    docs = inputs.documents(spark, sf_dir).select("id", "lang", "text")
    some = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    same = lambda df: sorted((r["id"], r["lang"]) for r in df.collect())
    got = same(language.detect_language(None, some, ["en", "fr"]))
    assert len(calls) == 1
    assert got == same(language.detect_language(some.select("id", "text"), some, ["en", "fr"]))
    QUERIES["detect_language"](spark, sf_dir)
    assert len(calls) == 4


def test_ngrams_are_counted_in_more_tasks(spark, sf_dir):
    docs = inputs.cleaned(spark, sf_dir)
    width = [inputs.term_counts(docs, ngram_range=(1, n)).rdd.getNumPartitions() for n in (1, 2, 3)]
    assert width == [n * session.shuffle_width(spark) for n in (1, 2, 3)]


def test_only_moving_tasks_go_through_the_tiles(data, monkeypatch):
    """Weight zero takes part in no product, and a task does not after its labels have settled."""
    rows, gamma = laplacian.kernel_rows(data["feats"], data["ids"], 1e-3)
    columns, through = [], tiles.Tiles.through

    def counted(self, rows, count):
        columns.append(count)
        return through(self, rows, count)

    monkeypatch.setattr(tiles.Tiles, "through", counted)
    both = laplacian.relax_weights(data["feats"], rows, data["pos"], Q, [0.0, 0.01], 10.0, gamma)
    assert columns and columns[0] <= Q and columns == sorted(columns, reverse=True)
    monkeypatch.undo()
    alone = laplacian.relax(data["feats"], rows, data["pos"], Q, 0.01, 10.0, gamma)
    want = {r["id"]: r["x"] for r in alone.collect()}
    got = {r["id"]: r["x"][Q:] for r in both.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_grid_query_searches_the_whole_grid(spark, sf_dir, monkeypatch):
    searched = []

    def caught(counts, rows, q, k=3, seed=7, alphas=enrich_svm.NB_ALPHAS, costs=enrich_svm.SVM_COSTS):
        searched.append((list(alphas), list(costs)))
        raise StopIteration

    monkeypatch.setattr(enrich_svm, "grid_search", caught)
    with pytest.raises(StopIteration):
        QUERIES["grid_search"](spark, sf_dir)
    assert searched == [([10.0, 1.0, 0.1, 0.01], [3.0, 1.0, 0.3, 0.1])]


def test_svm_margins_come_from_the_solver(spark, data):
    """Scores of its rows, also of those that are in no task, equal those of the weights."""
    y = to_matrix(data["pos"], Q, data["ids"]).select("id", enrich_svm.signs().alias("s"))
    none = F.array_repeat(F.lit(0).cast("tinyint"), Q)
    targets = stage(y.select("id", F.when(F.col("id") % 5 == 0, none).otherwise(F.col("s")).alias("s")))
    model = svm.fit(data["feats"], targets, 1.0, tol=1e-7)
    want = {r["id"]: r["m"] for r in model.margins(data["feats"], data["ids"]).collect()}
    placed = session.stage_by_block(data["feats"])
    found, constant = svm.fit_margins(placed, targets, 1.0, tol=1e-7)
    got = {r["id"]: r["m"] for r in found.collect()}
    assert constant == [None] * Q and got.keys() == want.keys() and len(got) == N
    assert all(got[i] == pytest.approx(want[i], abs=2e-5) for i in want)


def test_refits_go_through_tiles(spark, data, monkeypatch):
    """Counts are cut into tiles once; margins equal those of the joins, in blocks of rows or not."""
    y = stage(to_matrix(data["pos"], Q, data["ids"]))
    want = {r["id"]: r["m"] for r in enrich.nb_margins(data["counts"], y, data["ids"], Q).collect()}
    lone = data["counts"].unionByName(spark.createDataFrame([(7, "only", 3), (9, "own", 2)], "id long, term string, tf long"))
    monkeypatch.setattr(tiles, "BLOCK_ENTRIES", 100)
    totals = bayes.class_totals(y, Q)
    got = {r["id"]: r["m"] for r in bayes.CountTiles(data["counts"], data["ids"], Q, 1.0).margins(y, Q, totals).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)
    want = {r["id"]: r["m"] for r in enrich.nb_margins(lone, y, data["ids"], Q).collect()}
    found = bayes.CountTiles(session.stage_by_block(lone), data["ids"], Q, 1.0).margins(y, Q, totals)
    got = {r["id"]: r["m"] for r in found.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)
