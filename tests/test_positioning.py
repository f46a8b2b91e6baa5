"""Positioning by instrument and metric, curve tables, and tables stored by key."""

import datetime
import glob
import os

import pytest

from tidemark.operators import curves, positioning
from tidemark.sources.files import KeyedTable, SyntheticStore

D = datetime.date
SHAPE = "code string, name string, week date, category string, longs bigint, shorts bigint, spreads bigint, open_interest string"


@pytest.fixture
def reports(spark):
    rows = [
        (" 002602 ", "CORN - BOARD", D(2024, 1, 2), "Swap", 5, 1, 0, "10"),
        ("002602", "CORN - BOARD", D(2024, 1, 9), "Managed", 6, 2, 1, "20"),
        ("13874a", "S&P 500 (MINI)", D(2024, 1, 2), "Dealer", 7, 3, 0, "n/a"),
        (None, None, None, None, None, None, None, None),
        ("13874A", "S&P 500 (MINI)", D(2024, 1, 9), "dealer", 8, 4, 0, "5"),
    ]
    return spark.createDataFrame(rows, SHAPE)


@pytest.fixture
def dimension(spark):
    rows = [("ZC_F", "CORN", "002602"), ("ES_F", "SP_500", "13874A"), ("es_f ", "SP_500", "13874A"), ("XX_F", None, None), (None, "CORN", "1")]
    return positioning.instruments(spark.createDataFrame(rows, "s string, c string, k string"), "s", "c", "k")


def test_instruments_take_one_report_each(dimension):
    assert sorted(map(tuple, dimension.select("symbol", "code", "report").collect())) == [("ES_F", "13874A", "tff"), ("XX_F", None, "disaggregated"), ("ZC_F", "002602", "disaggregated")]


def test_find_by_every_condition(reports):
    n = lambda **k: positioning.find(reports, **k).count()
    assert n() == 5
    assert n(codes=["002602"]) == 2 and n(codes=["13874a "]) == 2 and n(codes=[]) == 0
    assert n(names=["500 (m"]) == 2 and n(names=["corn", "s&p"]) == 4 and n(names=["."]) == 0 and n(names=[]) == 0
    assert n(start="2024-01-09") == 2 and n(end="2024-01-02") == 2 and n(start="2024-01-02", end="2024-01-09") == 4
    assert n(least_open_interest=10) == 2 and n(least_open_interest=0) == 3
    assert n(categories=["DEALER"]) == 2
    first = positioning.find(reports, names=["o"], limit=1, columns=["code", "week"]).collect()
    assert [tuple(r) for r in first] == [(" 002602 ", D(2024, 1, 2))]


def test_instruments_and_names_without_code(reports, dimension):
    found = positioning.of_instruments(reports, dimension, ["zc_f", "nope"]).select("symbol", "longs").collect()
    assert sorted(map(tuple, found)) == [("ZC_F", 5), ("ZC_F", 6)]
    assert {r.report for r in positioning.of_instruments(reports, dimension, ["sp_500"], "commodity").collect()} == {"tff"}
    assert [r.symbol for r in positioning.unmapped(dimension, ["zc_f", "nope"]).collect()] == ["NOPE"]


def test_categories_side_by_side(reports):
    wide = positioning.side_by_category(reports.where("code LIKE '13%'"), ["Dealer", "Swap"], ("longs",), ("name",)).collect()
    assert [(r.dealer_longs, r.swap_longs) for r in wide] == [(15, None)]


def test_summary_and_codes(reports, dimension):
    joined = positioning.of_instruments(reports, dimension, ["ZC_F", "ES_F"])
    got = {(r.report, r.is_total): (r.n_rows, r.n_codes) for r in positioning.summary(joined).collect()}
    assert got == {("tff", 0): (2, 1), ("disaggregated", 0): (2, 1), (None, 1): (4, 2)}
    assert positioning.codes_listed(reports).count() == 3


def test_metrics_by_group(spark):
    df = spark.createDataFrame([("A", D(2024, 1, 2), 1, None, 2.5, "x"), ("A", D(2024, 1, 9), 3, 4.0, None, "y")], "symbol string, week date, net int, flow_8 double, long_short_ratio double, note string")
    long = positioning.metrics(df)
    assert sorted((r.metric, r.value) for r in long.collect()) == [("flow_8", 4.0), ("long_short_ratio", 2.5), ("net", 1.0), ("net", 3.0)]
    assert {r.metric for r in positioning.metrics(df, groups=["market_structure", "flows"]).collect()} == {"flow_8", "long_short_ratio"}
    info = {r.metric: (r.n_values, r.groups) for r in positioning.metrics_info(long).collect()}
    assert info == {"net": (2, "positioning"), "flow_8": (1, "flows"), "long_short_ratio": (1, "positioning,market_structure")}


def test_side_by_side_is_an_outer_alignment(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("B", 2, 2.0), ("B", 1, 3.0), ("C", 9, 9.0)], "symbol string, week int, v double")
    assert sorted(map(tuple, positioning.side_by_side(df, ["A", "B"], ["v"]).collect())) == [(1, 1.0, 3.0), (2, None, 2.0)]


def test_curve_tables(spark):
    rows = [("CL", D(2024, 1, 2), c, p, 10.0, 3, d) for c, p, d in ((1, 70.0, 5), (2, None, 35), (3, 72.0, 65))]
    rows += [("CL", D(2024, 1, 9), c, p, 10.0, 3, d) for c, p, d in ((1, 71.0, -2), (3, 73.0, 58))]
    curve = spark.createDataFrame(rows, "symbol string, date date, contract int, price double, volume double, oi int, dte int")
    got = {}
    for r in curves.curve_tables(curve).collect():
        got.setdefault(r.curve_type, []).append((r.date.day, r.seq, r.contract, r.value))
    assert set(got) == set(curves.CURVE_TYPES)
    assert sorted(got["seq_curve"]) == [(2, 0, "1", 70.0), (2, 1, "3", 72.0), (9, 0, "3", 73.0)]
    assert got["seq_spreads"] == [(2, 0, "1", 2.0)]
    assert sorted(got["dte"])[0] == (2, None, "1", 5.0) and len(got["dte"]) == 5 and len(got["curve"]) == 4
    assert sorted(got["front"]) == [(2, None, "1", 70.0), (9, None, "3", 73.0)]
    assert got["roll_dates"] == [(9, None, "1->3", None)]
    assert curves.curve_tables(curve, ["seq_labels"], "2024-01-09").count() == 1
    assert curves.curve_tables(curve.limit(0)).count() == 0
    with pytest.raises(ValueError):
        curves.curve_tables(curve, ["curves"])


def test_keyed_table_replaces_only_its_keys(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/metrics", ("report", "code"))
    assert not table.exists() and not table.has(report="tff")
    make = lambda *rows: spark.createDataFrame(rows, "report string, code string, week int, value double")
    table.put(make(("tff", "001602", 1, 1.0), ("tff", "001602", 2, 2.0), ("tff", "9", 1, 3.0), ("other", None, 1, 4.0)))
    kept = glob.glob(f"{tmp_path}/metrics/report=tff/code=9/*.parquet")
    times = [os.stat(f).st_mtime_ns for f in kept]
    table.put(make(("tff", "001602", 7, 7.0)))
    assert [os.stat(f).st_mtime_ns for f in kept] == times
    assert sorted((r.code or "-", r.week) for r in table.read().collect()) == [("-", 1), ("001602", 7), ("9", 1)]
    assert [r.value for r in table.read("week > 1", ["value"], code=["001602", "9"]).collect()] == [7.0]
    assert table.listed().count() == 3 and table.has(code="9")
    table.put(table.read(code="9").selectExpr("report", "code", "week", "value + 1 AS value"))
    assert [r.value for r in table.read(code="9").collect()] == [4.0]
    assert {(r.n_rows, r.first, r.last) for r in table.summary("week").where("code = '001602'").collect()} == {(1, 7, 7)}
    assert table.drop(report="tff", code="9") and not table.drop(report="tff", code="9")
    assert table.read().count() == 2
    with pytest.raises(ValueError):
        table.drop(code="9")


def test_synthetic_symbols_are_kept_and_rebuilt(spark, tmp_path):
    rows = [(s, D(2024, 1, d), 10.0 * d + k) for k, s in enumerate("ABC") for d in (1, 2, 3) if (s, d) != ("B", 3)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    legs = [("A", 1.0), ("B", -2.0)]
    store = SyntheticStore(spark, f"{tmp_path}/synthetic")
    made = curves.synthetic(bars, legs)
    store.save("A-2B", made, legs, {"unit": "bu"})
    store.save("C", curves.synthetic(bars, [("C", 1.0)]), [("C", 1.0)])
    again = lambda df: sorted((r.date.day, r.close) for r in df.collect())
    assert again(store.load(["A-2B"])) == again(store.rebuilt("A-2B", bars)) == [(1, -12.0), (2, -22.0)]
    assert again(store.load(["A-2B", "C"], start=D(2024, 1, 2), end=D(2024, 1, 2))) == [(2, -22.0), (2, 22.0)]
    assert {r.symbol: (r.legs, r.properties) for r in store.described().collect()} == {"A-2B": ({"A": 1.0, "B": -2.0}, {"unit": "bu"}), "C": ({"C": 1.0}, None)}
    with pytest.raises(ValueError):
        store.save("C", made, legs, replace=False)
    assert store.delete("C") and not store.delete("C")
    with pytest.raises(KeyError):
        store.rebuilt("C", bars)
