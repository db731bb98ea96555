"""Patterns against a plain recount in Python, with nulls, empty, long and repeated values."""

import itertools
import os
import re
from collections import Counter, defaultdict

from assaykit.operators import patterns


def tokens_of(value):
    kinds = lambda c: "D" if c in "0123456789" else "U" if c.isascii() and c.isupper() else "L" if c.isascii() and c.islower() else "P" + c
    return [(k, "".join(g)) for k, g in itertools.groupby(value, kinds)]


def codes(n=400):
    out = [f"CLI-{i % 7}{i:04d}" for i in range(n)] + [f"AB{i % 90:02d}" for i in range(60)] + ["x", "", None, "a" * 65, "-1" * 20, "--5", "a  b"]
    return [(i, v) for i, v in enumerate(out)]


def test_structures_and_patterns(spark):
    data = codes()
    df = spark.createDataFrame(data, "id long, v string")
    count = Counter(v for _, v in data if v and len(v) <= 64 and len(tokens_of(v)) <= 32)
    by, per = defaultdict(list), defaultdict(list)
    for v, n in count.items():
        key = "".join(k for k, _ in tokens_of(v))
        by[key].append(n)
        per[key, tuple(len(t) for _, t in tokens_of(v))].append(v)
    got = {r.structure: r for r in patterns.structures(df, "v").collect()}
    assert {k: (r.distinct_values, r.occurrences) for k, r in got.items()} == {k: (len(x), sum(x)) for k, x in by.items()}
    assert got["UP-D"].material and not got["L"].material
    found = {(r.structure, tuple(r.lens)): r for r in patterns.patterns(df, "v").collect()}
    assert {k: r.distinct_values for k, r in found.items()} == {k: len(x) for k, x in per.items()}
    for k, r in found.items():
        for place, fold in enumerate(r.folds):
            same = os.path.commonprefix([tokens_of(v)[place][1] for v in per[k]])
            assert same.startswith(fold) and (len(fold) >= min(3, len(same)) or len(per[k]) == 1)
    assert found["UP-D", (3, 1, 5)].signature == "'CLI-'99999"
    assert found["UD", (2, 2)].signature == "'AB'99"
    assert found["L", (1,)].signature == "a"


def test_validation(spark):
    learned = patterns.patterns(spark.createDataFrame([("AK-10",), ("AK-23",)], "v string"), "v")
    new = [("AK-99",), ("BK-99",), ("AK-123",), ("ak",), ("z" * 70,), ("-1" * 20,), (None,), ("AK-99",)]
    got = {r.outcome: (r.distinct_values, r.occurrences) for r in patterns.validate(spark.createDataFrame(new, "v string"), "v", learned).collect()}
    assert got == {"known": (1, 2), "new_segment": (1, 1), "new_length": (1, 1), "unknown_structure": (1, 1), "too_long": (1, 1), "too_complex": (1, 1)}


def test_heads(spark):
    """Two starts hold all of the values; the digits after them are evenly spread."""
    data = [(f"{'QC' if i % 2 else 'ON'}{i * 7919 % 10000:04d}",) for i in range(2000)]
    got = [r for r in patterns.heads(spark.createDataFrame(data, "v string"), "v").collect()]
    assert {(r.place, r["head"]) for r in got} == {(0, "QC"), (0, "ON")}
    # by hand: 1000 of 2000 values fix two letters of log2(26) bits; 1000 * (9.400879 - 1) - (9.400879 + 2)
    assert abs(next(r.gain for r in got if r["head"] == "QC") - 8389.478557) < 1e-5


def test_edge_merges(spark):
    data = [(f"{a}{i:03d}",) for a in "ABC" for i in range(10)] + [(f"7{i:03d}",) for i in range(5)] + [("zz-1",), ("zz-2",)]
    got = patterns.edge_merges(spark.createDataFrame(data, "v string"), "v").collect()
    assert [(r.form, r.into, r.merged) for r in got] == [("9999", "A999", "X999")]


def test_unicode_and_empty(spark):
    got = patterns.tokenized(spark.createDataFrame([("Éa1 b",)], "v string"), "v").first()
    assert (got.tokens, got.structure) == (["Éa", "1", " ", "b"], "XDP L")
    none = spark.createDataFrame([], "v string")
    assert patterns.patterns(none, "v").count() == patterns.heads(none, "v").count() == patterns.edge_merges(none, "v").count() == 0
    assert patterns.eligibility(none, "v").first().eligible is False
    assert re.fullmatch(r"\(\?s\).*", patterns.TOKEN)
