"""What the registered queries do not show: drivers' helpers, bounds, refusals and edge cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions import detectors
from assaykit.operators import generate, patterns, quality, ranges, relations, reports, rows, store, values
from assaykit.plans import registry
from assaykit.sources import readers


def test_percentiles_by_group(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([None, *range(9)])) for _ in range(300)]
    got = {r.g: (r.q0, r.q1) for r in ranges.percentiles(spark.createDataFrame(data, "g string, x int"), "x", (0.3, 0.5), ["g"]).collect()}
    for g in ("a", "b", None):
        xs = sorted(x for h, x in data if h == g and x is not None)
        for q, p in zip(got[g], (0.3, 0.5)):
            at = (len(xs) - 1) * p
            assert abs(q - (xs[math.floor(at)] + (xs[math.ceil(at)] - xs[math.floor(at)]) * (at - math.floor(at)))) < 1e-9
    assert ranges.percentiles(spark.createDataFrame([], "x int"), "x", (0.5,)).count() == 0


def test_binned_spearman_bounds(spark):
    rnd = random.Random(2)
    for noise in (0.0, 0.3, 5.0):
        df = spark.createDataFrame([(float(i), i + rnd.gauss(0, noise * 300)) for i in range(800)], "a double, b double")
        got, exact = relations.binned_spearman(df, "a", "b", 16).first(), relations.spearman(df, "a", "b").first()
        assert got.lower <= exact.rho <= got.upper and abs(got.rho - exact.rho) < 0.05
    one = relations.binned_spearman(df.withColumn("a", F.lit(1.0)), "a", "b").first()
    assert one.reason == "single_bin_first" and one.rho is None


def test_pearson_with_gaps(spark):
    rnd = random.Random(3)
    data = [tuple(None if rnd.random() < 0.2 else 1e6 + rnd.gauss(0, 1) + i * 0.01 * k for k in range(4)) + (7.0,) for i in range(200)]
    got = {(r.a, r.b): r for r in relations.pearson(spark.createDataFrame(data, "a double, b double, c double, d double, e double"), list("abcde")).collect()}
    for i, j in itertools.combinations(range(5), 2):
        pairs = [(r[i], r[j]) for r in data if r[i] is not None and r[j] is not None]
        r = got["abcde"[i], "abcde"[j]]
        assert r.n == len(pairs)
        if j == 4:
            assert r.reason == "constant"
            continue
        mx, my = (sum(p[k] for p in pairs) / len(pairs) for k in (0, 1))
        cov = sum((x - mx) * (y - my) for x, y in pairs)
        want = cov / math.sqrt(sum((x - mx) ** 2 for x, _ in pairs) * sum((y - my) ** 2 for _, y in pairs))
        assert abs(r.r - want) < 2e-6


def test_missing_blocks(spark):
    """Against all sets of columns."""
    rnd = random.Random(4)
    names = list("abcdef")
    for seed in range(3):
        data = []
        for _ in range(400):
            gone = set(rnd.choice([(), (), "ab", "abc", "de", "def", "a", "f"]))
            data.append(tuple(None if c in gone else "x" for c in names))
        lacks = {c: sum(r[i] is None for r in data) for i, c in enumerate(names)}
        blocks = {}
        for k in range(2, 7):
            for s in itertools.combinations(names, k):
                n = sum(all(r[names.index(c)] is None for c in s) for r in data)
                if n >= 4 and all(n >= 0.8 * lacks[c] for c in s):
                    blocks[frozenset(s)] = n
        want = {"+".join(sorted(s)): n for s, n in blocks.items() if not any(s < t for t in blocks)}
        got = {r["columns"]: r.records for r in relations.missing_blocks(spark.createDataFrame(data, ", ".join(f"{c} string" for c in names)), names).collect()}
        assert got == want


def test_sample_percent_and_allocate(spark):
    df = spark.range(1000).withColumnRenamed("id", "r")
    order = [r.r for r in df.orderBy(rows.priority(F.col("r")), "r").collect()]
    for p in (0.1, 7, 33.3, 100):
        assert {r.r for r in rows.sample_percent(df, p, "r").collect()} == set(order[: math.ceil(1000 * p / 100)])
    assert rows.sample_percent(df.limit(0), 10, "r").count() == 0
    with pytest.raises(ValueError):
        rows.allocate({"a": 2, "b": 1}, 4)


def test_unique_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, ""), (4, "c")], "k int, v string")
    got = {r.rule: (r.holds, r.broken, r.unknown) for r in generate.evaluate(df, {"k": {"unique": "k"}, "both": {"and": [{"unique": ["k", "v"]}, {"gt": ["k", 0]}]}, "not": {"not": {"unique": "k"}}}).collect()}
    assert got == {"k": (3, 2, 0), "both": (3, 0, 2), "not": (2, 3, 0)}


def test_generated_fields(spark):
    with pytest.raises(ValueError):
        generate.ordered_fields({"a": {"kind": "relative_date", "field": "b"}, "b": {"kind": "relative_date", "field": "a"}})
    got = generate.table(spark, "t", 3000, {
        "late": {"kind": "date", "start": "2020-01-01", "end": "2020-12-31", "after": "first"}, "first": {"kind": "date", "start": "2020-03-01", "end": "2020-12-31"},
        "price": {"kind": "decimal", "min": 100, "max": 100, "by_month": {"from": "first", "factors": [1, 1, 2, *[1] * 9], "inflation": 0.1, "base_year": 2019}, "round_to": 5},
        "x": {"kind": "lognormal", "mu": 1.0, "sigma": 0.5, "min": 1.5, "max": 6.0}, "y": {"kind": "pareto", "alpha": 1.2, "min": 2, "max": 9},
    }).collect()
    assert all(r.late >= r.first for r in got) and {r.price for r in got if r.first.month == 3} == {220.0} and {r.price for r in got if r.first.month != 3} == {110.0}
    assert all(1.49 <= r.x <= 6.01 and 2 <= r.y <= 9 for r in got) and len({r.y for r in got}) > 300
    middle = sorted(r.x for r in got)[1500]
    assert 2.5 < middle < 3.0  # the median of the whole law is e; the bounds move it little


def test_duplicated_rows_come_from_before(spark):
    df = spark.createDataFrame([(i, f"v{i}", i * 2) for i in range(50)], "r long, v string, n long")
    altered, journal = generate.inject(df, "r", [{"kind": "duplicate_row", "count": 10}, {"kind": "set_missing", "column": "n", "count": 5}], window=3)
    clean = {r.r: r for r in df.collect()}
    copies = [r for r in altered.collect() if r.v != clean[r.r].v]
    assert 8 <= len(copies) <= 10 and all(1 <= r.r - int(r.v[1:]) <= 3 for r in copies)
    assert altered.schema == df.schema and {r.operation for r in journal.collect()} == {"duplicate_row", "set_missing"}


def test_planning_of_files(spark, tmp_path):
    for n in ("a.csv", "b.csv", "c.txt"):
        (tmp_path / n).write_text("x")
    found = readers.resolve(spark, [f"{tmp_path}/*.csv", f"{tmp_path}/a.csv"])
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.csv", "b.csv"]
    with pytest.raises(ValueError):
        readers.resolve(spark, [f"{tmp_path}/*.json"])
    assert readers.plan_outputs(["/x/a.csv", "/x/b.csv"], "/y", ".json") == {"/x/a.csv": "/y/a.json", "/x/b.csv": "/y/b.json"}
    for bad in (["/x/a.csv", "/z/A.txt"], ["/y/a.json"]):
        with pytest.raises(ValueError):
            readers.plan_outputs(bad, "/y", ".json")
    schema = readers.json_schema(T.StructType.fromDDL("a int not null, b array<struct<c:date>>, d map<string,double>"), "t")
    assert schema["required"] == ["a"] and schema["properties"]["b"]["items"]["properties"]["c"] == {"type": "string", "format": "date"} and schema["title"] == "t"


def test_report_helpers(spark):
    assert reports.merged(["a", "b", "c", "d"], [("b", "d"), ("d", "c")]) == [["a"], ["b", "c", "d"]]
    assert reports.diverse(["aa", "ab", "zz", "zy", "mm"], 3) == ["aa", "zz", "mm"] and reports.diverse(["x"], 3) == ["x"] and reports.diverse(["x", "y"], 1) == ["x"]
    assert reports.edit_distance("kitten", "sitting") == 3 / 7 and reports.edit_distance("", "") == 0
    unique = lambda d: reports.uniqueness_case(rows.uniqueness(spark.createDataFrame(d, "id int, v string"), "id")).first()["case"]
    assert [unique(d) for d in ([(1, "a"), (2, "b")], [(1, "a"), (1, "a"), (2, "b")], [(1, "a"), (1, "b")], [(1, "a")], [(None, "a"), (2, "b")])] == ["A", "B", "C", "D", "E"]


def test_registry(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "a int, b double")
    seen, asked = [], []
    out = registry.run(df, [("profile", {}), ("quantiles", {"column": "b"})], lambda *x: seen.append(x), lambda n, c: asked.append(n) or False, (10**12, 10))
    assert seen == [] and asked == ["profile", "quantiles"] and out == {}
    out = registry.run(df, [("profile", {}), ("quantiles", {"column": "b"})], lambda *x: seen.append(x))
    assert seen == [("profile", 1, 2), ("quantiles", 2, 2)] and out[1].count() == 5
    with pytest.raises(ValueError):
        registry.register("profile", lambda d: d)
    counted, told = registry.observed(df)
    counted.write.format("noop").mode("overwrite").save()
    assert told.get["records"] == 50
    total = spark.sparkContext.accumulator(0)
    registry.for_each_record(df, lambda batch: total.add(len(batch)), 7)
    assert total.value == 50


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k long, v string, d string")
    assert quality.findings(none).count() == 0 and quality.observations(none).count() == 0 and values.profile(none).count() == 0
    assert relations.missing_blocks(none, ["k", "v"]).count() == 0 and store.limits(none).count() == 0 and rows.occurrences(none, "k").count() == 0
    assert patterns.facet_tree(none, "v").count() == 0 and detectors.date_evidence(none.select(F.col("v").alias("analytical"), F.col("k").alias("cnt"))).first().ambiguous == 0


def test_facet_tree(spark):
    data = [(f"{a}{b}-{i:03d}",) for a in "XY" for b in "PQ" for i in range(100)]
    got = {(r.path, r.level): r.distinct_values for r in patterns.facet_tree(spark.createDataFrame(data, "v string"), "v", 2).collect()}
    assert got == {("X", 1): 200, ("Y", 1): 200, ("X/0", 2): 200, ("Y/0", 2): 200} or set(got) == {("X", 1), ("Y", 1)}
    learned = patterns.patterns(spark.createDataFrame([("A1",), ("A22",), ("b-1",), ("7",)], "v string"), "v")
    kept = patterns.within_budget(learned, 2, 1, 2).where("kept")
    assert kept.count() == 2 and kept.select("structure").distinct().count() == 2
