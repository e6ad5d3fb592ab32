import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from histomesh.functions.tails import chi2_tail, erfc, normal_two_sided
from histomesh.operators import cluster as U
from histomesh.operators import evaluate as E
from histomesh.operators import order as O
from histomesh.operators import signature as M
from histomesh.operators import survival as S


def test_tails(spark):
    xs = [0.0, 0.1, 1.0, 2.0, 2.5, 3.0, 5.0, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", erfc(F.col("x")).alias("e"), normal_two_sided(F.col("x")).alias("p"), *[chi2_tail(F.col("x"), k).alias(f"c{k}") for k in (1, 2, 3, 4)]).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=1e-9)
        assert r.p == pytest.approx(math.erfc(r.x / math.sqrt(2)), rel=1e-9)
        assert r.c1 == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-9)
        assert r.c2 == pytest.approx(math.exp(-r.x / 2), rel=1e-12)
        assert r.c4 == pytest.approx(math.exp(-r.x / 2) * (1 + r.x / 2), rel=1e-12)


@pytest.fixture(scope="module")
def skewed(spark):
    """Three quarters of the rows under one key."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(2000) < 0.75, 0, rng.integers(1, 4, 2000))
    pdf = pd.DataFrame({"k": key, "v": np.round(rng.exponential(1, 2000), 2), "i": np.arange(2000)})
    return spark.createDataFrame(pdf), pdf


def test_order_helpers(skewed):
    df, pdf = skewed
    got = {r.k: (r.q1, r.q9) for r in O.quantiles(df, ["k"], "v", {"q1": 0.1, "q9": 0.9}).collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(tuple(np.quantile(part.v, [0.1, 0.9])))
    ranks = O.average_ranks(df, ["k"], "v").toPandas()
    want = pdf.assign(r=pdf.groupby("k").v.rank()).drop_duplicates(["k", "v"]).set_index(["k", "v"]).r
    assert ranks.set_index(["k", "v"]).avg_rank.sort_index().equals(want.sort_index())
    pos = O.row_positions(df, ["k"], ["v", "i"]).toPandas().set_index("i").position
    exp = pdf.sort_values(["v", "i"]).groupby("k").cumcount()
    assert pos.sort_index().tolist() == exp.sort_index().tolist()
    holes = df.withColumn("w", F.when(F.col("i") % 7 == 0, F.col("i")))
    carried = O.carry_forward(holes, ["k"], ["i"], ["w"]).toPandas().sort_values("i")
    ref = pdf.assign(w=pdf.i.where(pdf.i % 7 == 0)).sort_values("i")
    ref["w"] = ref.groupby("k").w.ffill()
    assert carried.w.fillna(-1).astype(int).tolist() == ref.w.fillna(-1).astype(int).tolist()


def survival_table(n=300, p=3, seed=0, ties=40):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    t = np.ceil(rng.exponential(np.exp(-0.7 * x[:, 0] + 0.3 * x[:, 1]) * ties)).astype(int)
    e = (rng.random(n) < 0.7).astype(int)
    return x, t, e


def efron(beta, x, t, e):
    """Log-likelihood, gradient and information, written out from the definition."""
    p = x.shape[1]
    ll, u, info = 0.0, np.zeros(p), np.zeros((p, p))
    w = np.exp(x @ beta)
    for day in np.unique(t[e == 1]):
        risk, dead = t >= day, (t == day) & (e == 1)
        d = dead.sum()
        ll += (x[dead] @ beta).sum()
        u += x[dead].sum(axis=0)
        for l in range(d):
            ww = w * risk - (l / d) * w * dead
            m = (ww[:, None] * x).sum(axis=0) / ww.sum()
            ll -= np.log(ww.sum())
            u -= m
            info += (ww[:, None, None] * x[:, :, None] * x[:, None, :]).sum(axis=0) / ww.sum() - np.outer(m, m)
    return ll, u, info


def fit(x, t, e, penalty=0.0):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        _, u, info = efron(beta, x, t, e)
        beta = beta + np.linalg.solve(info + penalty * np.eye(len(beta)), u - penalty * beta)
    return beta


def test_univariate_cox_matches_newton(spark):
    x, t, e = survival_table()
    long = pd.concat([pd.DataFrame({"feature": f"f{j}", "sample_id": range(len(t)), "value": x[:, j], "os_time": t, "os_event": e}) for j in range(3)])
    got = {r.feature: r for r in S.univariate_cox(spark.createDataFrame(long)).collect()}
    for j in range(3):
        z = (x[:, [j]] - x[:, j].mean()) / x[:, j].std(ddof=1)
        beta = fit(z, t, e)
        se = 1 / math.sqrt(efron(beta, z, t, e)[2][0, 0])
        r = got[f"f{j}"]
        assert r.beta == pytest.approx(beta[0], abs=1e-7)
        assert (r.hr, r.z) == pytest.approx((math.exp(beta[0]), beta[0] / se), rel=1e-6)
        assert r.p == pytest.approx(math.erfc(abs(beta[0] / se) / math.sqrt(2)), rel=1e-5)


def test_cox_takes_the_last_step_too(spark):
    """A step below ``tol`` shows in z of long tables, whose factor to beta is the root of the information."""
    x, t, e = survival_table()
    long = pd.DataFrame({"feature": "f", "sample_id": range(len(t)), "value": x[:, 0], "os_time": t, "os_event": e})
    z = (x[:, [0]] - x[:, 0].mean()) / x[:, 0].std(ddof=1)
    got = S.univariate_cox(spark.createDataFrame(long), tol=0.01).first()
    assert got.beta == pytest.approx(fit(z, t, e)[0], abs=1e-4)


def test_cox_skips_constant_features_and_rare_events(spark):
    rows = [(f, i, float(i % 2 if f == "two" else i), i + 1, int(i < 3 or f == "two")) for f in ("two", "rare") for i in range(30)]
    df = spark.createDataFrame(rows, "feature string, sample_id int, value double, os_time int, os_event int")
    assert S.univariate_cox(df).count() == 0


def design_frame(spark, x, t, e):
    return spark.createDataFrame(
        [(i, int(t[i]), int(e[i]), [float(v) for v in x[i]]) for i in range(len(t))], "sample_id int, os_time int, os_event int, x array<double>"
    )


def test_ridge_matches_newton(spark):
    x, t, e = survival_table(200)
    got = M.cox_ridge(design_frame(spark, x, t, e), 3, 0.05)
    assert got == pytest.approx(fit(x, t, e, 200 * 0.05), abs=1e-6)


def lasso_by_small_steps(x, t, e, position=0.5, steps=20000, rate=None):
    """Proximal gradient with a small step on the Breslow likelihood; the penalty as in ``cox_lasso``."""
    later = t[None, :] >= t[:, None]

    def slope(b):
        w = np.exp(x @ b)
        s0, s1 = later @ w, later @ (w[:, None] * x)
        return (e[:, None] * (x - s1 / s0[:, None])).sum(axis=0)

    penalty = np.abs(slope(np.zeros(x.shape[1]))).max() * 0.01**position
    beta, rate = np.zeros(x.shape[1]), rate or 0.3 / np.linalg.norm(x, 2) ** 2
    for _ in range(steps):
        v = beta + rate * slope(beta)
        new = np.sign(v) * np.maximum(np.abs(v) - rate * penalty, 0)
        if np.abs(new - beta).max() < 1e-12:
            break
        beta = new
    return beta


def test_lasso_reaches_the_optimum_of_small_steps(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(160, 8))
    x[:, 5] = 0.9 * x[:, 0] + 0.1 * x[:, 5]  # nearly the same as the first
    x[:, 7] = 0.0
    t = 1 + np.floor(60 * rng.exponential(np.exp(-x[:, 0] + 0.6 * x[:, 1]))).astype(int) % 200
    e = (rng.random(160) < 0.7).astype(int)
    fit = M.cox_lasso(design_frame(spark, x, t, e), 8, path_position=0.8, tol=1e-6)[0]
    assert fit.settled and fit.gap <= 1e-6
    assert fit.beta == pytest.approx(lasso_by_small_steps(x, t, e, 0.8), abs=1e-4)
    assert fit.beta[7] == 0.0


def test_lasso_without_events_or_subjects(spark):
    none = spark.createDataFrame([(i, i, 0, [float(i), 1.0]) for i in range(6)], "sample_id int, os_time int, os_event int, x array<double>")
    for df in (none, none.filter("sample_id < 0")):
        out = M.lasso_cox_frequency(df, ["a", "b"], repeats=2).collect()
        assert [(r.frequency, r.settled) for r in out] == [(0.0, True)] * 2


def test_lasso_keeps_signal_and_drops_noise(spark):
    x, t, e = survival_table(300)
    rows = M.lasso_cox_frequency(design_frame(spark, x, t, e), ["a", "b", "c"], repeats=5).collect()
    freq = {r.feature: r.frequency for r in rows}
    assert all(r.settled for r in rows)
    assert freq["a"] == 1.0
    assert freq["c"] <= freq["b"] <= freq["a"]


def test_permutation_importance_orders_features(spark):
    x, t, e = survival_table(300)
    d = design_frame(spark, x, t, e)
    imp = {r.feature: r.importance for r in M.permutation_importance(d, ["a", "b", "c"], M.cox_ridge(d, 3), repeats=3).collect()}
    assert imp["a"] > imp["b"] > imp["c"] - 0.02


@pytest.mark.parametrize("n_risks", [1, 2, 5, 400, 2000])
def test_concordance_splits_bits_of_ranks_in_tasks(spark, monkeypatch, n_risks):
    from histomesh.operators import survival as V
    from tests.test_groups import moved_rows

    monkeypatch.setattr(V, "RANK_BITS", 6, raising=False)
    rng = np.random.default_rng(31)
    n = 2000 if n_risks == 2000 else 300
    t, e = rng.integers(1, 40, n), rng.integers(0, 2, n)
    r = rng.permutation(n) if n_risks == 2000 else rng.integers(0, n_risks, n)
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(t, e, r)], "os_time int, os_event int, risk double").repartition(4)
    counts = V.concordance_counts(df)
    if n_risks == 2000:
        assert moved_rows(counts) < 4 * n  # 11 bits
    got = counts.first()
    able = (e[:, None] == 1) & ((t[:, None] < t[None]) | ((t[:, None] == t[None]) & (e[None] == 0)))
    want = (able.sum(), (able & (r[:, None] > r[None])).sum(), (able & (r[:, None] == r[None])).sum())
    assert (got.comparable, got.concordant, got.tied) == want


def test_concordance_matches_pairs(spark):
    rng = np.random.default_rng(5)
    n = 150
    t, e, r = rng.integers(1, 30, n), rng.integers(0, 2, n), rng.integers(0, 12, n).astype(float)
    got = S.concordance_index(spark.createDataFrame(pd.DataFrame({"os_time": t, "os_event": e, "risk": r}))).first()
    comp = conc = tied = 0
    for i, j in itertools.permutations(range(n), 2):
        if e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
            comp += 1
            conc += r[i] > r[j]
            tied += r[i] == r[j]
    assert (got.comparable, got.concordant, got.tied) == (comp, conc, tied)


def test_logrank_three_groups(spark):
    x, t, e = survival_table(200)
    g = (np.arange(200) % 3).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "os_time": t, "os_event": e}))
    got = S.logrank_k(df, "g").first()
    z, v = np.zeros(3), np.zeros((3, 3))
    for day in np.unique(t[e == 1]):
        risk = np.array([((t >= day) & (g == k)).sum() for k in range(3)])
        dead = np.array([((t == day) & (e == 1) & (g == k)).sum() for k in range(3)])
        n, d = risk.sum(), dead.sum()
        z += dead - d * risk / n
        if n > 1:
            v += d * (n - d) / (n - 1) * (np.diag(risk / n) - np.outer(risk, risk) / n**2)
    stat = z[:2] @ np.linalg.inv(v[:2, :2]) @ z[:2]
    assert got.statistic == pytest.approx(stat, rel=1e-9)
    assert got.p == pytest.approx(math.exp(-stat / 2), rel=1e-9)


def test_wilcoxon_exact_and_tied(spark):
    d = spark.createDataFrame([([0.5, 0.3, 0.2, 0.9, 0.7, 0.1],), ([0.5, -0.3, 0.2, 0.9, -0.7, 0.1],), ([0.0, 0.0],), ([1.0, 1.0, -1.0, 2.0],)], "d array<double>")
    p = [r.p for r in d.select(E.wilcoxon_p(F.col("d")).alias("p")).collect()]
    assert p[0] == 0.03125
    ranks, low = [4, 3, 2, 6, 5, 1], 3 + 5
    ways = sum(sum(r for r, s in zip(ranks, signs) if s) <= low for signs in itertools.product([0, 1], repeat=6))
    assert p[1] == pytest.approx(min(1.0, 2 * ways / 64))
    assert p[2] is None
    z = (8 - 5) / math.sqrt(4 * 5 * 9 / 24 - (27 - 3) / 48)
    assert p[3] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_bootstrap_matches_row_resampling(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    pred = np.where(rng.random(400) < 0.8, y, rng.integers(0, 3, 400))
    got = {r.metric: r for r in E.bootstrap_ci(spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": pred}))).collect()}
    boots = [np.mean((y == pred)[rng.integers(0, 400, 400)]) for _ in range(3000)]
    assert got["accuracy"].value == pytest.approx(np.mean(y == pred))
    assert got["accuracy"].ci_lower == pytest.approx(np.percentile(boots, 2.5), abs=0.012)
    assert got["accuracy"].ci_upper == pytest.approx(np.percentile(boots, 97.5), abs=0.012)


def test_consensus_counts_match_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(rep, s, int(rng.integers(0, 3))) for rep in range(6) for s in range(20) if rng.random() < 0.8]
    home = {s: s % 3 for s in range(20)}
    labels = spark.createDataFrame(rows, "rep int, sample_id int, cluster int")
    final = spark.createDataFrame(list(home.items()), "sample_id int, cluster int")
    got = {(r.sample_id, r.cluster): (r.co, r.seen) for r in U.consensus_with_clusters(labels, final).collect()}
    by = {}
    for rep, s, c in rows:
        by.setdefault(rep, {})[s] = c
    for (s, c), pair in got.items():
        co = sum(lab[s] == lab[o] for lab in by.values() if s in lab for o in lab if o != s and home[o] == c)
        seen = sum(1 for lab in by.values() if s in lab for o in lab if o != s and home[o] == c)
        assert pair == (co, seen)


def test_k_medoids_recovers_separated_groups(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[5, 5, 1], [-5, 5, 1], [5, -5, -1.0]])
    rows = [(r, i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.2, 3)]) for r in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "rep int, sample_id int, profile array<double>")
    out, _ = U.k_medoids(df, 3, ["rep"])
    for _, part in out.toPandas().groupby("rep"):
        truth = part.sample_id % 3
        assert part.cluster.groupby(truth).nunique().eq(1).all() and part.cluster.nunique() == 3


def plain_medoids(x, drawn, k, order, candidates=16):
    """The rounds of one replicate by loops over all distances; ``order``: ids by hash."""
    dist = lambda a, b: sum(abs(p - q) / (abs(p) + abs(q)) if abs(p) + abs(q) > 0 else 0.0 for p, q in zip(a, b))
    medoids = [min(drawn, key=lambda s: (order[s], s))]
    while len(medoids) < k:
        medoids.append(min(drawn, key=lambda s: (-min(dist(x[s], x[m]) for m in medoids), s)))
    assign = lambda ms: {s: min(range(k), key=lambda c: (dist(x[s], x[ms[c]]), c)) for s in drawn}

    def better(ms, tries):
        label, out = assign(ms), list(ms)
        for c in range(k):
            own = [s for s in drawn if label[s] == c]
            if own:
                centre = np.mean([x[s] for s in own], axis=0)
                options = [ms[c], *sorted(own, key=lambda s: (dist(x[s], centre), s))[:tries]]
                out[c] = min(range(len(options)), key=lambda i: (round(sum(dist(x[s], x[options[i]]) for s in own), 9), i))
                out[c] = options[out[c]]
        return out, max(sum(v == c for v in label.values()) for c in range(k))

    checked, tries = False, candidates
    while True:
        new, largest = better(medoids, tries)
        if [list(x[a]) for a in new] != [list(x[b]) for b in medoids]:
            medoids, checked = new, False
        elif checked or tries >= largest:
            return assign(medoids)
        else:
            checked, tries = True, 4 * tries


def test_resamples_against_plain_rounds(spark):
    rng = np.random.default_rng(8)
    x = {int(i): [float(v) for v in rng.normal(0, 1, 3).round(2)] for i in rng.permutation(90)[:60]}
    df = spark.createDataFrame(list(x.items()), "sample_id int, profile array<double>")
    got = U.resample_medoids(df, 3, 5, 0.7, candidates=4)
    drawn, label = {}, {}
    for r in got.collect():
        drawn.setdefault(r.rep, []).append(r.sample_id)
        label[r.rep, r.sample_id] = r.cluster
    hashes = df.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rep")).select("sample_id", "rep", F.xxhash64(F.lit(42), "rep", "sample_id").alias("h")).collect()
    order = {(r.rep, r.sample_id): r.h for r in hashes}
    for rep, ids in drawn.items():
        assert sorted(ids) == sorted(s for s in x if order[rep, s] % (1 << 30) < int(0.7 * (1 << 30)))
        want = plain_medoids({s: np.array(v) for s, v in x.items()}, ids, 3, {s: order[rep, s] for s in ids}, 4)
        assert {s: label[rep, s] for s in ids} == want


def test_replicates_share_the_distances_to_equal_medoids(monkeypatch):
    import pyarrow as pa

    from histomesh.operators import consensus as N

    rng = np.random.default_rng(12)
    x, n_reps, pool = rng.normal(0, 1, (40, 3)), 50, rng.normal(0, 1, (6, 3))
    drawn = [sorted(rng.choice(n_reps, 30, replace=False).tolist()) for _ in x]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(x.tolist()), pa.array(drawn, pa.list_(pa.int32()))], ["sample_id", "profile", "drawn"])
    medoids, measured, plain = pool[[rng.permutation(6)[:4] for _ in range(n_reps)]], [], N._distances
    monkeypatch.setattr(N, "_distances", lambda a, b: measured.append(len(a) * len(b)) or plain(a, b))
    label = N._Batch(batch, 3, np.arange(n_reps), n_reps).labels(medoids)
    assert sum(measured) == 40 * 6
    d = np.stack([plain(x, medoids[:, c]) for c in range(4)])
    assert (label == d.argmin(0)).all()


def test_pair_consensus_against_all_pairs_and_planted_groups(spark, monkeypatch):
    from histomesh.operators import consensus as N

    monkeypatch.setattr(N, "BLOCK", 40)  # several blocks
    rng = np.random.default_rng(3)
    centres = np.array([[6, 6, 1], [-6, 6, 1], [6, -6, -1.0]])
    df = spark.createDataFrame([(f"s{i}", [float(v) for v in centres[i % 3] + rng.normal(0, 0.3, 3)]) for i in range(150)], "sample_id string, profile array<double>")
    areas = None
    for k in (2, 3, 4):
        labels = U.replicate_labels(df, k, 30)
        pairs = labels.toPandas().pivot(index="sample_id", columns="rep", values="cluster").fillna(-1).to_numpy()
        both = (pairs[:, None] >= 0) & (pairs[None] >= 0)
        co, seen = (both & (pairs[:, None] == pairs[None])).sum(2), both.sum(2)
        upper = np.triu_indices(len(pairs), 1)
        want = pd.Series(list(zip(co[upper], seen[upper]))).value_counts().to_dict()
        got = {(r.co, r.seen): r.n for r in N.pair_histogram(labels, 30).collect()}
        assert got == want
        part = U.consensus_pairs(labels, 30).withColumn("k", F.lit(k))
        areas = part if areas is None else areas.unionByName(part)
    rows = {r.k: r for r in U.consensus_cdf(areas, weight="n").collect()}
    for k, r in rows.items():
        values = [(v.consensus, v.n) for v in areas.filter(F.col("k") == k).collect()]
        flat = np.sort(np.repeat([v for v, _ in values], [n for _, n in values]))
        cdf = np.arange(1, len(flat) + 1) / len(flat)
        assert abs(r.area - ((flat[1:] - flat[:-1]) * (cdf[1:] + cdf[:-1]) / 2).sum()) < 1e-9
    assert rows[3].chosen and sum(r.chosen for r in rows.values()) == 1


def test_ecotypes_beyond_eight_all_have_a_name(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in 10 * np.eye(10)[i % 10] + rng.normal(0, 0.1, 10)]) for i in range(100)]
    final, _ = U.consensus_cluster(spark.createDataFrame(rows, "sample_id int, profile array<double>"), 10, n_reps=3)
    names = [r.ecotype for r in final.collect()]
    assert len(names) == 100 and None not in names and {"C-IX", "C-X"} <= set(names)


def test_grouped_kmeans_reaches_a_fixed_point(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"s": np.repeat([0, 1], 90), "i": np.arange(180)})
    blob = np.array([0.0, 10.0, 20.0])[np.arange(180) % 3]
    pdf["a"], pdf["b"] = blob + rng.normal(0, 0.3, 180), blob + rng.normal(0, 0.3, 180)
    out = U.grouped_kmeans(spark.createDataFrame(pdf), "s", "i", ["a", "b"], restarts=5).toPandas()
    for _, part in out.groupby("s"):
        assert sorted(part.cluster.value_counts()) == [30, 30, 30]


def test_null_outcome_is_calibrated(spark):
    rng = np.random.default_rng(7)
    long = pd.DataFrame([(f"f{j}", i, rng.normal()) for j in range(12) for i in range(150)], columns=["feature", "sample_id", "value"])
    clinical = pd.DataFrame({"sample_id": range(150), "os_time": rng.integers(1, 900, 150), "os_event": rng.integers(0, 2, 150)})
    r = M.null_calibration(spark.createDataFrame(long), spark.createDataFrame(clinical)).first()
    assert r.n_tested == 12 and r.n_significant <= 1
