"""Row operators against the simplest recount, with nulls, ties and empty tables."""

import random
from collections import Counter

import pytest

from assaykit.operators import relations, rows


def test_duplicate_stats_worked_example(spark):
    df = spark.createDataFrame([(101, "Alice")] * 3 + [(102, "Bob")] * 2 + [(103, "Charlie")], "id int, name string")
    got = rows.duplicate_stats(df).first()
    assert (got.total, got.distinct_rows, got.duplicate_groups, got.extra_copies, got.duplicate_group_occurrences, got.singletons, got.max_occurrences, got.twice, got.three_plus) == (6, 3, 2, 3, 5, 1, 3, 1, 1)


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_random(spark, seed):
    rnd = random.Random(seed)
    data = [(i, rnd.choice(["a", "b", "", None]), rnd.choice([1, 2, None])) for i in range(60)]
    df = spark.createDataFrame(data, "rec long, x string, y int")
    count = Counter((x, y) for _, x, y in data)
    first = {}
    for i, x, y in data:
        first.setdefault((x, y), i)
    assert {r.rec for r in rows.duplicates(df, "unique", "rec").collect()} == set(first.values())
    assert {r.rec for r in rows.duplicates(df, "duplicates", "rec").collect()} == {v for k, v in first.items() if count[k] > 1}
    assert {r.rec for r in rows.duplicates(df, "duplicates_all", "rec").collect()} == ({i for i, x, y in data if count[(x, y)] > 1} if max(count.values()) >= 3 else set())
    extra = {r.record for r in rows.marks(df, "rec").where("is_extra").collect()}
    assert extra == {i for i, x, y in data if first[(x, y)] != i}
    stats = rows.duplicate_stats(df, ["x", "y"]).first()
    assert stats.total == stats.distinct_rows + stats.extra_copies


def test_empty(spark):
    df = spark.createDataFrame([], "rec long, x string")
    assert rows.duplicate_stats(df).first().total == 0
    assert rows.sample(df, "mixed", 6, "rec").count() == 0
    assert relations.missing_patterns(df, ["x"]).count() == 0
    assert relations.position(df, "rec").count() == 0


def test_allocate():
    assert rows.allocate({"a": 97, "b": 2, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert sum(rows.allocate({"a": 33, "b": 33, "c": 34}, 10).values()) == 10
    with pytest.raises(ValueError):
        rows.allocate({"a": 1, "b": 1}, 1)


def test_position(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "r long")
    assert sorted((r.r, r.position) for r in relations.position(df, "r").collect()) == [(i, i) for i in range(101)]
