"""Fits that move through time: components of rolling windows, walk-forward regressions, loadings as curves of the tenor.

Windows and expanding samples are never gathered: running sums of products give each window's moments by one
difference, and only these small matrices reach Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import by, ewms, finite, ratio


def wide(panel: DataFrame, key: str, value: str, names: list, keys: list[str], order: str) -> DataFrame:
    """keys, order and one column v0, v1, ... for each of names; rows that lack one are left out, as are NaN and infinities."""
    g = panel.groupBy(*keys, order).agg(*[F.max(F.when(F.col(key) == F.lit(n), finite(value))).alias(f"v{i}") for i, n in enumerate(names)])
    return g.where(" AND ".join(f"v{i} IS NOT NULL" for i in range(len(names))))


def tenor_returns(panel: DataFrame, taus: list[float], halflife: float = 60.0) -> DataFrame:
    """symbol, date, v0, v1, ...: daily changes of each tenor's log price over their exponentially weighted deviation, 0 without one.

    panel: symbol, date, tau, ln_f.  Only dates with all tenors count.
    """
    w = by("symbol", "date")
    out = wide(panel, "tau", "ln_f", taus, ["symbol"], "date")
    out = out.withColumns({f"v{i}": F.col(f"v{i}") - F.lag(f"v{i}").over(w) for i in range(len(taus))}).where("v0 IS NOT NULL")
    out = ewms(out, {f"s{i}": (f"v{i}", 1 - 0.5 ** (1 / halflife)) for i in range(len(taus))}, ["symbol"], ["date"], spread=True)
    return out.select("symbol", "date", *[F.coalesce(ratio(f"v{i}", f"s{i}"), F.lit(0.0)).alias(f"v{i}") for i in range(len(taus))])


def window_moments(x: DataFrame, p: int, window: int, keys: list[str], order: str) -> DataFrame:
    """x with `n` and `moments`, sums over the `window` rows before each row: of v, of v v', of |v|^2, |v|^2 v and |v|^4.

    Each sum is a difference of two running sums, so a row costs the same whatever the window.  Null without a full
    window.
    """
    w = by(keys, order)
    v = [F.col(f"v{i}") for i in range(p)]
    square = sum((c * c for c in v[1:]), v[0] * v[0])
    terms = [*v, *[v[i] * v[j] for i in range(p) for j in range(i, p)], square, *[square * c for c in v], square * square]
    sums = x.withColumn("nth", F.row_number().over(w)).withColumns({f"c{k}": F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k, t in enumerate(terms)})
    lagged = sums.withColumn("moments", F.array(*[F.col(f"c{k}") - F.coalesce(F.lag(f"c{k}", window).over(w), F.lit(0.0)) for k in range(len(terms))]))
    return lagged.withColumn("moments", F.when(F.col("nth") > window, F.col("moments"))).drop("nth", *[f"c{k}" for k in range(len(terms))])


def covariances(moments: np.ndarray, p: int, n: int, shrinkage: str) -> tuple[np.ndarray, np.ndarray]:
    """Covariance matrices of windows from their moments, and how far each is shrunk towards a multiple of one.

    "ledoit_wolf" and "oas" as their papers have it, on centred rows with divisor n; "empirical" is not shrunk.
    """
    upper = np.triu_indices(p)
    total, pairs = moments[:, :p], np.zeros((len(moments), p, p))
    pairs[:, upper[0], upper[1]] = pairs[:, upper[1], upper[0]] = moments[:, p : p + len(upper[0])]
    at = p + len(upper[0])
    squares, weighted, fourth = moments[:, at], moments[:, at + 1 : at + 1 + p], moments[:, at + 1 + p]
    mean = total / n
    cov = pairs / n - mean[:, :, None] * mean[:, None, :]
    trace = np.trace(cov, axis1=1, axis2=2)
    mu = trace / p
    if shrinkage == "ledoit_wolf":
        # the sum of |v - mean|^4 over the window
        mm = (mean * mean).sum(1)
        mxxm = np.einsum("ki,kij,kj->k", mean, pairs, mean)
        beta_ = fourth + 4 * mxxm + n * mm**2 - 4 * (weighted * mean).sum(1) + 2 * squares * mm - 4 * mm * (total * mean).sum(1)
        delta_ = (cov**2).sum((1, 2))
        beta = (beta_ / n - delta_) / (p * n)
        delta = (delta_ - 2 * mu * trace + p * mu**2) / p
        beta = np.minimum(beta, delta)
        shrunk = np.where(beta > 0, beta / np.where(delta > 0, delta, 1.0), 0.0)
    elif shrinkage == "oas":
        alpha = (cov**2).mean((1, 2))
        above, below = alpha + mu**2, (n + 1) * (alpha - mu**2 / p)
        shrunk = np.where(below == 0, 1.0, np.minimum(above / np.where(below == 0, 1.0, below), 1.0))
    else:
        shrunk = np.zeros(len(cov))
    return (1 - shrunk)[:, None, None] * cov + (shrunk * mu)[:, None, None] * np.eye(p), shrunk


def rolling_components(x: DataFrame, p: int, window: int = 252, most: int = 5, explained: float = 0.98, shrinkage: str = "ledoit_wolf", keys: tuple[str, ...] = ("symbol",), order: str = "date", weights: list[float] | None = None, correlation: bool = False) -> DataFrame:
    """keys, order, component (from 1), eigenvalue, share, cumulative, n_components, shrunk, loading (array of p), score.

    x: keys, order and v0 .. v(p-1).  Each row's components are those of the `window` rows before it, as many as explain
    the share asked for, `most` at most.  Eigenvectors have no sign of their own: the first one's largest loading is
    positive, each later one points along that of the row before.  score is the row's own value along the component;
    with `correlation` columns are standardised by the window's deviations (n - 1) and the score is that of the window's
    last row.
    """
    keys = list(keys)
    root = np.sqrt(np.asarray(weights if weights is not None else [1.0] * p))
    scaled = x.select(*keys, order, *[(F.col(f"v{i}") * float(root[i])).alias(f"v{i}") for i in range(p)])
    m = window_moments(scaled, p, window, keys, order)
    last = by(keys, order)
    own = F.array(*[F.lag(f"v{i}").over(last) if correlation else F.col(f"v{i}") for i in range(p)])
    m = m.select(*keys, order, "moments", own.alias("own")).where("moments IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            moments = np.array(batch.column("moments").to_pylist(), float)
            own = np.array(batch.column("own").to_pylist(), float)
            cov, shrunk = covariances(moments, p, window, "empirical" if correlation else shrinkage)
            if correlation:
                sd = np.sqrt(np.maximum(np.einsum("kii->ki", cov), 0) * window / (window - 1))
                ok = sd > 0
                safe = np.where(ok, sd, 1.0)
                own = np.where(ok, (own - moments[:, :p] / window) / safe, 0.0)
                cov = np.where(ok[:, :, None] & ok[:, None, :], cov * window / (window - 1) / (safe[:, :, None] * safe[:, None, :]), 0.0)
            values, vectors = np.linalg.eigh(cov)
            values, vectors = np.maximum(values[:, ::-1], 1e-10), vectors[:, :, ::-1]
            share = values / values.sum(1, keepdims=True)
            cumulative = np.cumsum(share, axis=1)
            # searched from the left, so a share met exactly needs no further component
            k = np.minimum(most, 1 + (cumulative < explained).sum(1))
            k = np.minimum(k, p)
            row = np.repeat(np.arange(len(k)), k)
            comp = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            v = vectors[row, :, comp]
            columns = [batch.column(c).take(pa.array(row)) for c in (*keys, order)]
            offsets = pa.array(np.arange(len(row) + 1) * p, pa.int32())
            columns += [pa.array(comp + 1, pa.int32()), pa.array(values[row, comp]), pa.array(share[row, comp]), pa.array(cumulative[row, comp]), pa.array(k[row], pa.int32()), pa.array(shrunk[row])]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1))), pa.array((own[row] * v).sum(1))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, order, "component", "eigenvalue", "share", "cumulative", "n_components", "shrunk", "loading", "score"])

    kinds = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in (*keys, order))
    raw = m.mapInArrow(run, f"{kinds}, component int, eigenvalue double, share double, cumulative double, n_components int, shrunk double, loading array<double>, score double")
    return aligned(raw, keys, order)


def aligned(raw: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Loadings and scores with the signs described in rolling_components: a turn at a row turns all rows after it."""
    w = by([*keys, "component"], order)
    along = F.aggregate(F.zip_with("loading", F.lag("loading").over(w), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    largest = F.array_max(F.transform("loading", lambda a: F.struct(F.abs(a).alias("size"), a.alias("value"))))["value"]
    turn = F.coalesce(along, largest) < 0
    turned = raw.withColumn("turn", turn).withColumn("odd", F.sum(F.col("turn").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    sign = F.when(F.col("odd") == 1, -1.0).otherwise(1.0)
    return turned.withColumn("loading", F.transform("loading", lambda a: a * sign)).withColumn("score", F.col("score") * sign).drop("turn", "odd")


def component_stability(components: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "date", least: float = 0.7) -> DataFrame:
    """keys, component, the mean and least correlation of a component's loadings from row to row, and how often it is above `least`."""
    w = by([*keys, "component"], order)
    a, b = F.col("loading"), F.lag("loading").over(w)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, t: s + t)
    n = F.size("loading")
    x = components.withColumns({"b": b}).where("b IS NOT NULL")
    dot = lambda p, q: total(F.zip_with(p, q, lambda s, t: s * t)) - total(p) * total(q) / n
    r = ratio(dot(a, F.col("b")), F.sqrt(F.greatest(dot(a, a) * dot(F.col("b"), F.col("b")), F.lit(0.0))))
    g = x.withColumn("r", r).where("r IS NOT NULL").groupBy(*keys, "component")
    return g.agg(F.avg("r").alias("mean_correlation"), F.min("r").alias("least_correlation"), F.avg((F.col("r") > least).cast("double")).alias("stable_share"))


def cross_components(scores: DataFrame, names: list[tuple[str, int]], window: int = 252, most: int = 3) -> DataFrame:
    """Components of the scores of several symbols' components, standardised; names: the (symbol, component) taken, in order.

    Only dates with all of them count.  The result has no key: one row a date and global component.
    """
    tagged = scores.select(F.lit("all").alias("scope"), "date", F.concat_ws("_", "symbol", F.col("component").cast("string")).alias("name"), "score")
    x = wide(tagged, "name", "score", [f"{s}_{c}" for s, c in names], ["scope"], "date")
    return rolling_components(x, len(names), window, most, 2.0, keys=("scope",), correlation=True).drop("scope", "shrunk")


def fitted_loadings(components: DataFrame, taus: list[float], most_beta: float = 10.0, least_beta: float = 0.01) -> DataFrame:
    """components with a, beta, r2 and rmse of the tenor curve that a component's loadings follow.

    Component 1 is a constant a, component 2 a (1 - exp(-beta tau)), component 3 and later ones a tau exp(-beta tau).
    For a given beta the best a is a ratio of sums, so only beta is searched: on a grid, then by golden section.
    """
    t = np.asarray(taus, float)

    def shape(beta: np.ndarray, kind: np.ndarray) -> np.ndarray:
        decay = np.exp(-beta[..., None] * t)
        return np.where(kind[..., None] == 1, 1.0, np.where(kind[..., None] == 2, 1 - decay, t * decay))

    def miss(beta, kind, y):
        f = shape(beta, kind)
        a = (f * y).sum(-1) / np.maximum((f * f).sum(-1), 1e-300)
        return ((y - a[..., None] * f) ** 2).sum(-1), a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.geomspace(least_beta, most_beta, 121)
        golden = (5**0.5 - 1) / 2
        for batch in batches:
            y = np.array(batch.column("loading").to_pylist(), float).reshape(batch.num_rows, -1)
            kind = np.array(batch.column("component").to_pylist(), int)
            errors = miss(np.broadcast_to(grid, (len(y), len(grid))), kind[:, None], y[:, None, :])[0]
            best = errors.argmin(1) if len(y) else np.zeros(0, int)
            low, high = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]
            for _ in range(60):
                a, b = high - golden * (high - low), low + golden * (high - low)
                left = miss(a, kind, y)[0] <= miss(b, kind, y)[0]
                low, high = np.where(left, low, a), np.where(left, b, high)
            beta = (low + high) / 2
            error, scale = miss(beta, kind, y)
            spread = ((y - y.mean(1, keepdims=True)) ** 2).sum(1)
            r2 = np.where(spread > 0, 1 - error / np.where(spread > 0, spread, 1.0), 0.0)
            new = [pa.array(scale), pa.array(np.where(kind == 1, np.nan, beta), from_pandas=True), pa.array(r2), pa.array(np.sqrt(error / max(len(t), 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "a", "beta", "r2", "rmse"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in components.schema.fields)
    return components.mapInArrow(run, f"{kinds}, a double, beta double, r2 double, rmse double")


def walk_forward(x: DataFrame, features: list[str], target: str, keys: list[str], order: str, fold: str | None = None, ridge: float = 0.0, least: int = 1, intercept: bool = True, penalise_intercept: bool = False) -> DataFrame:
    """x with `n_train`, `weights` and `predicted`: a ridge regression on all rows of the key that come strictly before.

    With `fold`, a column that does not fall along `order`, all rows of one value are predicted by one fit on the rows of
    smaller values, as in a walk-forward split; without, each row has its own fit.  The sample only grows, so its normal
    equations are running sums of products, solved once a row or fold.  Rows whose target is null are predicted but
    teach nothing, rows with a null feature do neither; below `least` rows there is no prediction.
    """
    ok = " AND ".join(f"`{f}` IS NOT NULL" for f in features)
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in features]] if intercept else [F.col(f).cast("double") for f in features]
    q = len(terms)
    y = F.col(target).cast("double")
    teaches = F.expr(ok) & y.isNotNull()
    products = [terms[i] * terms[j] for i in range(q) for j in range(i, q)] + [t * y for t in terms]
    only = lambda c: F.when(teaches, c).otherwise(0.0)
    if fold is None:
        before = by(keys, order).rowsBetween(Window.unboundedPreceding, -1)
        placed = x.withColumn("n_train", F.coalesce(F.sum(teaches.cast("bigint")).over(before), F.lit(0))).withColumn("sums", F.array(*[F.sum(only(c)).over(before) for c in products]))
    else:
        folds = x.groupBy(*keys, fold).agg(F.count_if(teaches).alias("m"), *[F.sum(only(c)).alias(f"f{k}") for k, c in enumerate(products)])
        before = by(keys, fold).rowsBetween(Window.unboundedPreceding, -1)
        sums = folds.select(*keys, fold, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("n_train"), F.array(*[F.sum(f"f{k}").over(before) for k in range(len(products))]).alias("sums"))
        placed = sums
    penalty = np.full(q, float(ridge))
    if intercept and not penalise_intercept:
        penalty[0] = 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(q)
        for batch in batches:
            n = np.array(batch.column("n_train").to_pylist(), int)
            weights: list = [None] * batch.num_rows
            able = np.flatnonzero(n >= max(least, 1))
            if len(able):
                sums = np.array(batch.column("sums").take(pa.array(able)).to_pylist(), float)
                a = np.zeros((len(able), q, q))
                a[:, upper[0], upper[1]] = a[:, upper[1], upper[0]] = sums[:, : len(upper[0])]
                a += np.diag(penalty)
                b = sums[:, len(upper[0]) :]
                # the least norm where the sample does not decide, as a rank-deficient fit has it
                found = np.einsum("kij,kj->ki", np.linalg.pinv(a, rcond=1e-12, hermitian=True), b)
                for i, row in zip(able.tolist(), found.tolist(), strict=True):
                    weights[i] = row
            kept = [batch.column(c) for c in batch.schema.names if c != "sums"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weights, pa.list_(pa.float64()))], [*[c for c in batch.schema.names if c != "sums"], "weights"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name != "sums")
    fits = placed.mapInArrow(run, f"{kinds}, weights array<double>")
    out = fits if fold is None else x.join(fits, [*keys, fold])
    value: Column = F.lit(0.0)
    for i, t in enumerate(terms):
        value = value + F.col("weights")[i] * t
    return out.withColumn("predicted", F.when(F.expr(ok), value))
