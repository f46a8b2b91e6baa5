"""Rolling components, loadings fits and walk-forward regressions against fits from the raw rows."""

import datetime

import numpy as np
import pytest

from tidemark.operators import models, screens

DAY = datetime.date(2020, 1, 1)


def panel(seed, n, p, symbols="ab"):
    r = np.random.RandomState(seed)
    rows = []
    for s in symbols:
        base = r.randn(n, 2) @ r.randn(2, p) + 0.3 * r.randn(n, p) + 0.5
        rows += [(s, DAY + datetime.timedelta(days=i), *map(float, base[i])) for i in range(n)]
    return rows, "symbol string, date date, " + ", ".join(f"v{i} double" for i in range(p))


def shrunk_covariance(x, kind):
    n, p = x.shape
    c = x - x.mean(0)
    cov = c.T @ c / n
    mu = np.trace(cov) / p
    if kind == "ledoit_wolf":
        delta = ((cov - mu * np.eye(p)) ** 2).sum() / p
        beta = min(sum(((np.outer(v, v) - cov) ** 2).sum() for v in c) / (n * n * p), delta)
        s = beta / delta if beta > 0 else 0.0
    elif kind == "oas":
        a = (cov**2).mean()
        s = min((a + mu * mu) / ((n + 1) * (a - mu * mu / p)), 1.0)
    else:
        s = 0.0
    return (1 - s) * cov + s * mu * np.eye(p), s


@pytest.mark.parametrize("kind", ["ledoit_wolf", "oas", "empirical"])
def test_rolling_components_by_brute_force(spark, kind):
    p, window = 4, 20
    rows, schema = panel(1, 60, p)
    weights = [1.0, 2.0, 0.5, 1.0]
    found = models.rolling_components(spark.createDataFrame(rows, schema), p, window, 3, 0.95, kind, weights=weights).collect()
    seen = {(r.symbol, r.date, r.component): r for r in found}
    for s in "ab":
        x = np.array([r[2:] for r in rows if r[0] == s]) * np.sqrt(weights)
        before = {}
        for i in range(window, len(x)):
            cov, shrunk = shrunk_covariance(x[i - window : i], kind)
            values, vectors = np.linalg.eigh(cov)
            values, vectors = values[::-1], vectors[:, ::-1]
            k = min(3, 1 + int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95)))
            for c in range(3):
                r = seen.pop((s, DAY + datetime.timedelta(days=i), c + 1), None)
                if c >= k:
                    assert r is None
                    continue
                v = vectors[:, c]
                old = before.get(c)
                v = v * np.sign(v[np.abs(v).argmax()] if old is None else old @ v)
                before[c] = v
                assert r.n_components == k and np.allclose([r.eigenvalue, r.share, r.shrunk], [values[c], values[c] / values.sum(), shrunk], atol=1e-9)
                assert np.allclose(r.loading, v, atol=1e-6) and np.isclose(r.score, x[i] @ v)
    assert not seen


def test_cross_components_by_brute_force(spark):
    r = np.random.RandomState(5)
    x = r.randn(40, 3) @ r.randn(3, 3)
    names = [("a", 1), ("a", 2), ("b", 1)]
    rows = [(s, DAY + datetime.timedelta(days=i), c, float(x[i, j])) for i in range(40) for j, (s, c) in enumerate(names) if (i, j) != (7, 2)]
    found = models.cross_components(spark.createDataFrame(rows, "symbol string, date date, component int, score double"), names, 15, 2).collect()
    kept = np.delete(x, 7, 0)
    days = [DAY + datetime.timedelta(days=i) for i in range(40) if i != 7]
    assert len(found) == 2 * (39 - 15)
    for f in found:
        i = days.index(f.date)
        w = kept[i - 15 : i]
        z = (w - w.mean(0)) / w.std(0, ddof=1)
        values, vectors = np.linalg.eigh(z.T @ z / 14)
        v = vectors[:, ::-1][:, f.component - 1]
        assert np.isclose(f.eigenvalue, values[::-1][f.component - 1])
        assert np.isclose(abs(f.score), abs(z[-1] @ v))


def test_loadings_find_their_curve(spark):
    taus = [0.25, 0.5, 1.0, 2.0, 3.0]
    t = np.array(taus)
    curves = [(1, np.full(5, 0.4)), (2, 0.7 * (1 - np.exp(-1.3 * t))), (3, -2 * t * np.exp(-0.8 * t))]
    df = spark.createDataFrame([(c, list(map(float, y))) for c, y in curves], "component int, loading array<double>")
    found = {r.component: r for r in models.fitted_loadings(df, taus).collect()}
    assert np.isclose(found[1].a, 0.4) and found[1].beta is None
    assert np.allclose([found[2].a, found[2].beta, found[2].r2], [0.7, 1.3, 1], atol=1e-5)
    assert np.allclose([found[3].a, found[3].beta, found[3].r2], [-2, 0.8, 1], atol=1e-5)


def solved(x, y, ridge, free):
    a = x.T @ x + np.diag([0.0 if free else ridge] + [ridge] * (x.shape[1] - 1))
    return np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ (x.T @ y)


@pytest.mark.parametrize("fold", [None, "fold"])
def test_walk_forward_by_brute_force(spark, fold):
    r = np.random.RandomState(7)
    rows = []
    for s in "ab":
        for i in range(50):
            f = r.randn(2)
            y = None if i % 9 == 4 else float(1 + f @ [2, -1] + 0.1 * r.randn())
            rows.append((s, i, i // 6, float(f[0]), None if i == 11 else float(f[1]), y))
    df = spark.createDataFrame(rows, "symbol string, date int, fold int, f double, g double, y double")
    found = {(o.symbol, o.date): o for o in models.walk_forward(df, ["f", "g"], "y", ["symbol"], "date", fold, ridge=0.5, least=4).collect()}
    assert len(found) == len(rows)
    for s, i, k, f, g, _ in rows:
        train = [q for q in rows if q[0] == s and (q[1] < i if fold is None else q[2] < k) and q[4] is not None and q[5] is not None]
        o = found[s, i]
        assert o.n_train == len(train)
        if len(train) < 4 or g is None:
            assert o.predicted is None
            continue
        w = solved(np.array([(1, q[3], q[4]) for q in train]), np.array([q[5] for q in train]), 0.5, True)
        assert np.isclose(o.predicted, w @ [1, f, g])


def test_har_scores_by_brute_force(spark):
    r = np.random.RandomState(9)
    rv = np.exp(np.cumsum(0.2 * r.randn(80)) * 0.5 - 5)
    side = r.randn(80)
    df = spark.createDataFrame([("a", DAY + datetime.timedelta(days=i), float(rv[i]), float(side[i])) for i in range(80)], "symbol string, date date, rv double, side double")
    v = np.log(rv)
    for exogenous in ((), ("side",)):
        x = np.array([[1, v[t - 1], v[t - 5 : t].mean(), v[t - 22 : t].mean(), *([side[t - 1]] if exogenous else [])] for t in range(22, 80)])
        y = v[22:]
        made = np.array([x[t] @ solved(x[:t], y[:t], 1e-4, False) for t in range(20, len(y))])
        real = y[20:]
        o = screens.har_scores(df, 20, exogenous=exogenous).first()
        off = np.exp(real - made)
        r2, qlike = 1 - ((real - made) ** 2).sum() / ((real - real.mean()) ** 2).sum(), (off - np.log(off) - 1).mean()
        score = (made[-1] - made.mean()) / made.std() * max(r2, 0) / (1 + qlike)
        assert o.n == len(real) and np.allclose([o.r2, o.qlike, o.score], [r2, qlike, score], rtol=1e-5)
