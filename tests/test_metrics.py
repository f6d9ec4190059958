"""Hand cases for the binary metrics (FIXTURES §3.1) against direct Python
forms of the reference formulas."""

import math
import random

import pytest

from lexiscope.operators import metrics as M


def py_auc(t, p):
    pos = [b for a, b in zip(t, p) if a == 1]
    neg = [b for a, b in zip(t, p) if a == 0]
    if len(set(t)) != 2:
        return None
    s = sum((1.0 if x > y else 0.5 if x == y else 0.0) for x in pos for y in neg)
    return s / (len(pos) * len(neg))


def py_metrics(t, p):
    n = len(t)
    nu = sum(1 for x in p if x == 0.5)
    nc = sum(1 for a, b in zip(t, p) if b != 0.5 and a == (1.0 if b > 0.5 else 0.0))
    c1 = (1 / n) * (nc + (nu * nc / n))
    tp = sum(1 for a, b in zip(t, p) if a == 1 and b > 0.5)
    fp = sum(1 for a, b in zip(t, p) if a == 0 and b > 0.5)
    fn1 = sum(1 for a, b in zip(t, p) if a == 1 and b <= 0.5)
    fn = sum(1 for a, b in zip(t, p) if a == 1 and b < 0.5)
    f1 = None if tp + fp + fn1 == 0 else 2 * tp / (2 * tp + fp + fn1)
    den = 1.25 * tp + 0.25 * (fn + nu) + fp
    f05u = None if den == 0 else 1.25 * tp / den
    brier = 1 - sum((min(max(b, 0.0), 1.0) - a) ** 2 for a, b in zip(t, p)) / n
    auc = py_auc(t, p)
    mean = ((auc or 0) + brier + c1 + (f1 or 0) + (f05u or 0)) / 5
    conf = [[sum(1 for a, b in zip(t, p) if a == i and (b >= 0.5) == bool(j)) for j in (0, 1)] for i in (0, 1)]
    return dict(roc_auc=auc, brier=brier, c_at_1=c1, f1=f1, f05u=f05u, mean_score=mean, conf=conf)


CASES = {
    "one_class": ([1, 1, 1], [0.2, 0.7, 0.9]),
    "nobody_answers": ([0, 1, 1, 0], [0.5, 0.5, 0.5, 0.5]),
    "no_positives": ([0, 0, 0], [0.1, 0.4, 0.5]),
    "exact_half": ([1, 0, 1, 0], [0.5, 0.5, 0.8, 0.2]),
    "ties": ([1, 0, 1, 0, 1], [0.7, 0.7, 0.3, 0.3, 0.7]),
    "outside_01": ([1, 0, 1, 0], [1.4, -0.2, 0.6, 0.55]),
}


def _run(spark, t, p):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, p)], "t double, p double")
    return M.evaluate_scored(df.selectExpr("'all' AS facet", "t", "p"), ["facet"], digits=None).first()


@pytest.mark.parametrize("name", sorted(CASES))
def test_hand_cases(spark, name):
    t, p = CASES[name]
    r = _run(spark, t, p)
    e = py_metrics(t, p)
    for k in ("roc_auc", "brier", "c_at_1", "f1", "f05u", "mean_score"):
        if e[k] is None:
            assert r[k] is None, (name, k)
        else:
            assert r[k] == pytest.approx(e[k], abs=1e-12), (name, k)
    assert [[r.conf_00, r.conf_01], [r.conf_10, r.conf_11]] == e["conf"]


def test_random_against_pairwise(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(5):
        n = rnd.randint(5, 60)
        for _ in range(n):
            rows.append((f"g{g}", float(rnd.randint(0, 1)), round(rnd.uniform(-0.2, 1.2), rnd.choice([1, 2, 4]))))
    df = spark.createDataFrame(rows, "facet string, t double, p double")
    got = {r.facet: r.roc_auc for r in M.roc_auc(df, ["facet"]).collect()}
    for g in {r[0] for r in rows}:
        t = [r[1] for r in rows if r[0] == g]
        p = [r[2] for r in rows if r[0] == g]
        e = py_auc(t, p)
        assert (got[g] is None) == (e is None)
        if e is not None:
            assert got[g] == pytest.approx(e, abs=1e-12)


def py_best_offset(t, p, steps=1000):
    import numpy as np
    t, p = np.array(t, float), np.array(p, float)

    def c1(pp):
        nu = pp == 0.5
        nc = np.sum((t == (pp > 0.5))[~nu])
        return float((1 / len(t)) * (nc + (np.sum(nu) * nc / len(t))))
    best_off, best = 0.0, c1(p)
    upd = False
    for o in np.linspace(-(np.max(p) - .49), .51 - np.min(p), steps):
        s = c1(p + o)
        if s > best:
            best, best_off, upd = s, o, True
        elif upd and s < best - .01:
            break
    return best_off, best


@pytest.mark.parametrize("seed", range(6))
def test_offset_search_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(10, 80)
    t = [float(rnd.randint(0, 1)) for _ in range(n)]
    p = [0.5 if rnd.random() < 0.15 else round(rnd.random(), 4) for _ in range(n)]
    df = spark.createDataFrame(list(zip(t, p)), "t double, p double")
    r = M.best_offset(df).first()
    eo, es = py_best_offset(t, p)
    assert r.best_c_at_1 == pytest.approx(es, abs=1e-12)
    assert r.best_offset == pytest.approx(eo, abs=1e-12)


def test_facets_skip_null_values(spark):
    df = spark.createDataFrame([(1.0, 0.9, "a"), (0.0, 0.1, None)], "t double, p double, source string")
    f = M.with_facets(df, ["source"]).collect()
    assert sorted((r.facet, r.value) for r in f) == [("all", "all"), ("all", "all"), ("source", "a")]


def test_flagship_known_values(spark):
    """FIXTURES.md check values at sf0.01: per genre n, unanswered, correct, 1-Brier."""
    from lexiscope.sources import fixtures as X
    sf = "/root/testdata/sf0.01"
    j = M.with_facets(M.join_answers(X.truth(spark, sf), X.answers(spark, sf)), ["genre"])
    c = {r.value: r for r in M.binary_counts(j, ["facet", "value"]).collect() if r.facet == "genre"}
    want = {"de": (46, 12, 22, 0.80091), "en": (262, 37, 155, 0.818258),
            "es": (39, 9, 23, 0.831601), "fr": (52, 13, 26, 0.805202)}
    for g, (n, nu, nc, b) in want.items():
        r = c[g]
        assert (r.n, r.nu, r.nc) == (n, nu, nc)
        assert round(1 - r.sq / r.n, 6) == pytest.approx(b, abs=1e-6)
