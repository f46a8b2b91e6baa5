"""Queries: components of rolling windows, loadings fits, walk-forward forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import by
from tidemark.operators import curves, features, models
from tidemark.plans.curves import SPREAD, W
from tidemark.plans.features import RETURNS
from tidemark.plans.registry import R, query, rounded
from tidemark.sources.tables import curve, daily_bars

TAUS = [0.1, 0.2, 0.3, 0.4, 0.5]


def _spread_moves(spark: SparkSession, sf: str) -> DataFrame:
    s = curves.spread_series(curves.sequentialise(curve(spark, sf))).where("near > 0 AND far > 0")
    w = by("symbol", "date")
    moves = s.select("symbol", "date", *[(F.ln(c) - F.ln(F.lag(c).over(w))).alias(f"v{i}") for i, c in enumerate(("near", "far"))])
    return moves.where("v0 IS NOT NULL AND v1 IS NOT NULL")


@query(f"""WITH {SPREAD}, l AS (SELECT symbol, date, ln(near) - lag(ln(near)) {W} AS x, ln(far) - lag(ln(far)) {W} AS y FROM sp WHERE near > 0 AND far > 0), z AS (SELECT *, row_number() {W} AS i FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
    j AS (SELECT a.symbol, a.date, b.x, b.y FROM z a JOIN z b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 30 AND a.i - 1 WHERE a.i > 30),
    m AS (SELECT symbol, date, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM j GROUP BY 1, 2),
    f AS (SELECT symbol, date, any_value(xx) AS xx, any_value(yy) AS yy, any_value(xy) AS xy, sum(power(power(x - mx, 2) + power(y - my, 2), 2)) AS fourth FROM j JOIN m USING (symbol, date) GROUP BY 1, 2),
    s AS (SELECT *, (xx + yy) / 2 AS mu, xx * xx + yy * yy + 2 * xy * xy AS d FROM f),
    k AS (SELECT *, (fourth / 30 - d) / 60 AS beta, (d - 2 * mu * (xx + yy) + 2 * mu * mu) / 2 AS delta FROM s),
    h AS (SELECT *, CASE WHEN least(beta, delta) > 0 THEN least(beta, delta) / delta ELSE 0 END AS shrunk, sqrt(greatest(mu * mu - (xx * yy - xy * xy), 0)) AS root FROM k),
    e AS (SELECT symbol, date, component, shrunk, mu, (1 - shrunk) * (mu + CASE component WHEN 1 THEN root ELSE -root END) + shrunk * mu AS eigenvalue FROM h, (SELECT unnest([1, 2])::INTEGER AS component))
    SELECT symbol, date, component, {R("eigenvalue", 5)} AS eigenvalue, {R("eigenvalue / (2 * mu)", 5)} AS share, {R("shrunk", 4)} AS shrunk FROM e""")
def rolling_spread_pca(spark: SparkSession, sf: str) -> DataFrame:
    out = models.rolling_components(_spread_moves(spark, sf), 2, 30, 2, 2.0).select("symbol", "date", "component", "eigenvalue", "share", "shrunk")
    return rounded(rounded(out, "eigenvalue", "share", digits=5), "shrunk", digits=4)


def _curve_components(spark: SparkSession, sf: str) -> DataFrame:
    panel = curves.constant_maturity(curves.sequentialise(curve(spark, sf)), TAUS)
    return models.rolling_components(models.tenor_returns(panel, TAUS), len(TAUS), 126, 3, 0.98)


#: Eigenvectors have no SQL form; tests compare with a brute-force fit of every window.
@query()
def rolling_curve_pca(spark: SparkSession, sf: str) -> DataFrame:
    out = models.fitted_loadings(_curve_components(spark, sf), TAUS)
    names = ["eigenvalue", "share", "cumulative", "shrunk", "a", "beta", "r2", "rmse"]
    return rounded(out.select("symbol", "date", "component", "n_components", *names), *names, digits=4)


@query()
def curve_pca_stability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.component_stability(_curve_components(spark, sf)), "mean_correlation", "least_correlation", "stable_share", digits=4)


@query()
def cross_symbol_pca(spark: SparkSession, sf: str) -> DataFrame:
    out = models.cross_components(_curve_components(spark, sf), [("A", 1), ("N", 1), ("R", 1), ("A", 2)], 126, 3)
    return rounded(out.drop("loading"), "eigenvalue", "share", "cumulative", "score", digits=4)


@query(f"""WITH {RETURNS}, x AS (SELECT symbol, date, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS before, CAST(date_trunc('month', date) AS DATE) AS month FROM rets), t AS (SELECT * FROM x WHERE ret IS NOT NULL AND before IS NOT NULL),
    f AS (SELECT symbol, month, count(*) AS n, sum(before) AS sx, sum(ret) AS sy, sum(before * before) AS sxx, sum(before * ret) AS sxy FROM t GROUP BY 1, 2),
    c AS (SELECT symbol, month, {", ".join(f"coalesce(sum({k}) OVER (PARTITION BY symbol ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {k}" for k in ("n", "sx", "sy", "sxx", "sxy"))} FROM (SELECT symbol, month, coalesce(n, 0) AS n, sx, sy, sxx, sxy FROM (SELECT DISTINCT symbol, month FROM x) LEFT JOIN f USING (symbol, month))),
    b AS (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope FROM c)
    SELECT symbol, date, CAST(n AS BIGINT) AS n_train, {R("CASE WHEN n >= 20 THEN (sy - slope * sx) / n + slope * before END", 5)} AS predicted FROM x JOIN b USING (symbol, month)""")
def walk_forward_forecast(spark: SparkSession, sf: str) -> DataFrame:
    x = features.returns(daily_bars(spark, sf)).withColumn("before", F.lag("ret").over(by("symbol", "date"))).withColumn("month", F.to_date(F.date_trunc("month", "date")))
    out = models.walk_forward(x, ["before"], "ret", ["symbol"], "date", fold="month", least=20)
    return rounded(out.select("symbol", "date", "n_train", "predicted"), "predicted", digits=5)
