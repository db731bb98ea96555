"""Exploration, the covering sample and streams against plain recounts."""

from collections import Counter

import pytest

from assaykit.operators import explore, relations, smart
from assaykit.streaming import values as streaming

ROWS = [(i, "abc"[i % 3] if i % 17 else None, "xy"[i % 2], float(i % 3) * 10 + i % 5, float(i)) for i in range(300)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "row_id long, kind string, side string, size double, pos double")


def test_facts_and_ranking(spark, table):
    got = {r.field: r for r in explore.facts(table).collect()}
    assert got["row_id"].identifier_like and not got["kind"].identifier_like and got["kind"].category_like
    assert (got["kind"].present, got["kind"].distinct_values) == (sum(r[1] is not None for r in ROWS), 3)
    pairs = {(r.a, r.b): r for r in explore.category_tables(table, ["kind", "side"]).collect()}
    one = relations.association(table, "kind", "side").first()
    assert (pairs["kind", "side"].v, pairs["kind", "side"].v_corrected) == (one.v, one.v_corrected)
    best = explore.numbers_by_category(table, ["kind", "side"], ["size", "pos"]).orderBy("place").first()
    assert (best.a, best.b, best.chosen) == ("kind", "size", True)
    assert best.epsilon2 == pytest.approx(relations.correlation_ratio(table, "kind", "size").first().epsilon2, abs=1e-5)
    assert explore.number_pairs(table).count() >= 1
    assert explore.number_pairs(table.limit(0)).count() == explore.category_tables(table.limit(0)).count() == explore.numbers_by_category(table.limit(0)).count() == 0


def test_date_orders(spark):
    df = spark.sql("select date_add(date'2024-01-01', cast(id as int)) a, date_add(date'2024-01-03', cast(id as int)) b, if(id % 2 = 0, date'2020-01-01', null) c from range(100)")
    got = {(r["first"], r["second"]): (r.compared, r.holds) for r in explore.date_orders(df).collect()}
    assert got == {("a", "b"): (100, True), ("c", "a"): (50, True), ("c", "b"): (50, True)}


def test_choose():
    c = explore.Candidate
    got = {x.analysis: d for x, d in explore.choose([c("a", ("f",), 90, 10, 50), c("b", ("f",), 10, 10, 50), c("r", ("f",), 1, 10, 50, requested=True), c("w", (), 99, 10, 60, whole_row=True), c("h", ("f",), 99, 1 << 40, 1)], all_cells=120)}
    assert got == {"a": "chosen", "b": "low_utility", "r": "requested", "w": "over_budget", "h": "too_large"}


def test_smart_sample_covers(spark, table):
    rows, coverage = smart.sample(table, "row_id", ["kind", "side", "pos"], 30)
    assert rows.count() == 30 == rows.select("row_id").distinct().count()
    got = {r.target: r for r in coverage.collect()}
    assert got["kind:missing"].rows == sum(r[1] is None for r in ROWS)
    assert {"kind=a", "side=x", "pos:min", "pos:max", "pos:zero", "pos:bin9"} <= set(got)
    assert all(r.taken >= 1 for r in got.values())
    assert sorted(r.row_id for r in rows.collect()) == sorted(r.row_id for r in smart.sample(table.repartition(7), "row_id", ["kind", "side", "pos"], 30)[0].collect())
    assert smart.sample(table.limit(0), "row_id", ["kind"], 5)[0].count() == 0


def test_stream(spark, table, tmp_path):
    for part in range(3):
        table.where(f"row_id % 3 = {part}").write.parquet(str(tmp_path / f"in/{part}.parquet"))
    read = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    streaming.follow(read, str(tmp_path / "out"), str(tmp_path / "at"), ["kind", "side"]).awaitTermination(120)
    got = {(r.field, r.raw): r.cnt for r in streaming.totals(spark, str(tmp_path / "out")).collect()}
    assert got == Counter([("kind", r[1]) for r in ROWS] + [("side", r[2]) for r in ROWS])
