"""What is looked at before a detector or a stage runs may cost little, but changes no result, and kinds stand for values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from assaykit.functions import detectors, normalize
from assaykit.operators import quality, values
from assaykit.plans import catalogue

PIECES = [
    *"0123456789", *"+-.,:/@%()$€£¥{}#_ ", "\n", "\r\n", "\x85", " ", "\t", "\xa0", " ", " ", "é", "É", "é", "İ", "ß", "²", "°", "a", "B", "Z", "kg", "CAD", "12", "2024", "-02-30", "T10:20", "March", "1er ", "www.", "http://", "user", "example.com", "514", "555-0123", "H2X", " 1Y4",
    "550e8400-e29b-41d4-a716-446655440000", "10.0.0.1", "::1", "fe80", "urn:uuid:", "null", "N/A", "true", "no", "😀", "ſ",
]
FORMS = ["0", "-12", ".5", "1,234", "1 234 567", "CA$ 12.50", "(1,234.50 €)", "12 TRY", "$-5", "JPY 1,234", "5 kg", "3°C", "12.5km/h", "50%", "1,5 %", "(514) 555-0005", "+1 514 555 0123", "0033 (0)1.23.45.67.89", "5145550123", "H2X 1Y4", "h2x1y4", "D2X 1Y4", "90210-1234", "a.b+c@mail.example.org", "a@b", "https://a.example/x?y=1", "WWW.example.org", "ftp://bad_host", "256.1.1.1", "1.2.3.04", "2001:db8:0:0:0:0:0:1", "{550e8400-e29b-11d4-a716-446655440000}", "550e8400-e29b-41d4-a716-44665544zzzz", "2024-02-30", "01-13-2024", "1er janvier 2024", "Mar 5, 2024", "9:05", "2024-03-05T10:20:00Z", "2024-03-05 10:20+02:00", "1-2/2024", "É2 mars 2024"]


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(5)
    made = ["".join(rnd.choices(PIECES, k=rnd.randint(1, 6))) for _ in range(6000)]
    bent = [f[:i] + rnd.choice(PIECES) + f[i + rnd.randint(0, 1) :] for f in FORMS for i in (rnd.randint(0, len(f)) for _ in range(20))]
    texts = sorted({"", *made, *bent, *FORMS, *[f + end for f in FORMS for end in ("\n", "\r\n", "\x85", " ", " ")]})
    return spark.createDataFrame([(x,) for x in [*texts, None]], "v string").repartition(4).cache()


def test_needs_lose_nothing(odd):
    v = F.col("v")
    for name, detector in detectors.DETECTORS.items():
        both = odd.where("v is not null").select("v", detectors.told(name, v, lambda r: r["state"]).alias("a"), detector(v)["state"].alias("b"))
        assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == [], name
        assert both.where("b is not null").count() > 1


def test_stages_as_they_are_told(odd):
    """Against the rules without a look before, in Python or as one expression."""
    v, space, breaks = F.col("v"), normalize.SPACE, normalize.BREAKS
    whole = F.regexp_replace(v, f"^[{space}]+|[{space}]+$", "")
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\p{Lu}", "A"), r"[\p{L}&&[^\p{Lu}A]]", "a"), r"\p{Nd}", "9")
    pairs = {
        "trim": (normalize.trim(v), whole), "collapse": (normalize.collapse(v), F.regexp_replace(v, f"[{space}&&[^{breaks}]]+", " ")), "shape": (normalize.shape(v), F.regexp_replace(flat, r"([Aa9])\1+", "$1")),
        "category": (normalize.category(v), F.when(v == "", "empty").when(v.rlike(f"^[{space}]+$"), "blank").when(F.lower(whole).isin(*normalize.MARKERS), "marker").when(v.isNotNull(), "content")),
    }
    for name, (got, want) in pairs.items():
        assert odd.select("v", got.alias("a"), want.alias("b")).where("not a <=> b").collect() == [], name
    import unicodedata

    for r in odd.select("v", normalize.analytical(v).alias("a"), normalize.comparison_key(v).alias("k")).where("v is not null").collect():
        clean = re.sub(r"[^\S\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]+", " ", unicodedata.normalize("NFC", r.v).strip())
        assert r.a == clean
        bare = "".join(c for c in unicodedata.normalize("NFD", clean.casefold()) if unicodedata.category(c) != "Mn")
        assert r.k == (unicodedata.normalize("NFC", bare) if not clean.isascii() else clean.lower())


def test_kinds_stand_for_values(spark):
    """The wide sums are made over kinds, whose number does not follow that of the values."""
    sizes = []
    for n in (500, 4000):
        df = spark.range(n).selectExpr("concat('user', 10000 + id, '@example.com') as e", "concat('C', 10000 + id) as client_id", "if(id % 3 = 0, ' a  b ', cast(10000 + id as string)) as mixed", "id")
        seen = quality.kinds(values.analysed(df)).cache()
        sizes.append(seen.count())
        got = {r.field: r for r in quality.measured_kinds(seen).collect()}
        assert (got["e"].email_matched, got["e"].distinct_values, got["client_id"].present, got["id"].strings) == (n, n, n, 0)
        a = -(-n // 3)
        assert (got["mixed"].surrounding, got["mixed"].repeated, got["mixed"].as_integer, got["mixed"].distinct_values, got["mixed"].median_length) == (a, a, n - a, n - a + 1, 5.0)
    assert sizes[0] <= sizes[1] <= 12


@pytest.mark.parametrize("name", ["findings_faults", "signals_faults", "table_summary_faults", "summary_table_faults", "classify_faults"])
def test_queries_sum_over_kinds(spark, monkeypatch, name):
    rows, whole = [], quality.measured_kinds
    monkeypatch.setattr(quality, "measured_kinds", lambda seen: rows.append(seen.count()) or whole(seen))
    n = len(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect())
    assert n > 0 and len(rows) == 1 and rows[0] < 120  # of some 4,000 distinct values


def test_profile_over_kinds(spark):
    data = [(None if i % 7 == 0 else "" if i % 11 == 0 else f" a{i % 40}  b", i % 5, "x" * (i % 3)) for i in range(400)]
    got = values.analysed(spark.createDataFrame(data, "t string, n int, s string")).cache()
    plain = values.profiled(got)
    over = values.profiled(got, quality.kinds(got)).select(plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, over.collect())) and plain.schema.simpleString() == over.schema.simpleString()


def test_values_grouped_by_position(spark):
    texts = ["a b", " a b", "a  b", "a b ", "12", "12 ", "+7", "1,234", "1,50", "€5", "USD 12", "n/a", " ", "", None, "x"]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "t string, n int")
    got = values.analysed(df)
    plan = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert len(plan) == 2 and all(x.split("Aggregate [")[1].startswith("position") and "field" not in x.split("]")[0] for x in plan)
    rows = {r.analytical: (r.cnt, r.raws, r.trimmed, r.collapsed, r.family) for r in got.where("field = 't' and category = 'content'").collect()}
    assert rows["a b"] == (4, 4, 2, 2, "text") and rows["12"] == (2, 2, 1, 0, "integer") and rows["x"] == (1, 1, 0, 0, "text")
    m = {r.field: r for r in quality.measured(got).collect()}
    assert (m["t"].number_matched, m["t"].number_ambiguous, m["t"].currency_matched, m["t"].surrounding, m["t"].repeated) == (4, 1, 2, 3, 2)
    assert (m["n"].number_matched, m["n"].distinct_values, m["n"].surrounding) == (0, 2, 0)
