"""Whole rows: duplicates, record facts, samples and identifier uniqueness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.ranges import cumulative


def priority(record: Column, seed: str = "42") -> Column:
    """Hash order of a record number, the same on any engine with MD5."""
    return F.md5(F.concat(record.cast("string"), F.lit("|" + seed)))


def row_counts(df: DataFrame, columns: list[str] | None = None, record: str | None = None) -> DataFrame:
    """Distinct rows with their number (and first record). Nulls are equal; columns are never concatenated."""
    columns = columns or [c for c in df.columns if c != record]
    return df.groupBy(*columns).agg(F.count("*").alias("cnt"), *([F.min(record).alias("first_rec")] if record else []))


def duplicate_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: total, distinct, singletons, groups, twice, three_plus, extra copies, group occurrences, maximum, percent."""
    c = F.col("cnt")
    groups = F.count_if(c >= 2)
    return row_counts(df, columns).agg(
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("total"),
        F.count("*").alias("distinct_rows"),
        F.count_if(c == 1).alias("singletons"),
        groups.alias("duplicate_groups"),
        F.count_if(c == 2).alias("twice"),
        F.count_if(c >= 3).alias("three_plus"),
        (F.coalesce(F.sum(c), F.lit(0)) - F.count("*")).cast("long").alias("extra_copies"),
        F.coalesce(F.sum(F.when(c >= 2, c)), F.lit(0)).cast("long").alias("duplicate_group_occurrences"),
        F.coalesce(F.max(c), F.lit(0)).alias("max_occurrences"),
        F.round(F.coalesce(F.try_divide((F.sum(c) - F.count("*")) * 100.0, F.sum(c)), F.lit(0.0)), 4).alias("extra_copy_percent"),
    )


def duplicates(df: DataFrame, output: str, record: str, columns: list[str] | None = None) -> DataFrame:
    """unique (each row at its first place), duplicates (each repeated row once) or duplicates_all (every occurrence, where some row occurs three times or more)."""
    columns = columns or [c for c in df.columns if c != record]
    if output in ("unique", "duplicates"):
        out = row_counts(df, columns, record)
        out = out if output == "unique" else out.where("cnt > 1")
        return out.select(*columns, F.col("first_rec").alias(record))
    counts = row_counts(df, columns).where("cnt > 1")
    many = counts.agg(F.max("cnt").alias("most")).where("most >= 3")
    same = [df[c].eqNullSafe(counts[c]) for c in columns]
    return df.join(counts, same, "left_semi").join(F.broadcast(many), how="left_semi", on=F.lit(True))


def marks(df: DataFrame, record: str, columns: list[str] | None = None) -> DataFrame:
    """record, is_group_first, is_extra; a row's own first place is joined, so a hot row is no window."""
    columns = columns or [c for c in df.columns if c != record]
    counts = row_counts(df, columns, record)
    same = [df[c].eqNullSafe(counts[c]) for c in columns]
    joined = df.join(counts, same)
    first = F.col("first_rec") == df[record]
    return joined.select(df[record].alias("record"), ((F.col("cnt") > 1) & first).alias("is_group_first"), (~first).alias("is_extra"))


def occurrences(df: DataFrame, record: str, columns: list[str] | None = None) -> DataFrame:
    """record, occurrence: the running number of each row among its copies, in record order.

    Only rows that have copies are numbered; they are put in order by ranges of their digest and record, so a row with
    very many copies is spread over tasks.
    """
    columns = columns or [c for c in df.columns if c != record]
    digest = F.xxhash64(*columns)
    cells = df.select(F.col(record).alias("record"), digest.alias("_d"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_k")).withColumn("n", F.lit(1))
    placed = cumulative(cells, ["_d", "_k", "record"])
    first = placed.groupBy("_d", "_k").agg(F.min("_before").alias("_first"))
    return placed.join(first, ["_d", "_k"]).select("record", (F.col("_before") - F.col("_first") + 1).alias("occurrence"))


def repeated_keys(df: DataFrame, columns: list[str], record: str) -> DataFrame:
    """Repeated values of a field or key with count and first record; rows that lack a part are left out."""
    whole = df.dropna(subset=columns)
    return row_counts(whole, columns, record).where("cnt > 1")


def key_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    whole = row_counts(df.dropna(subset=columns), columns).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("values"), F.count("*").alias("distinct_values"), F.count_if(F.col("cnt") > 1).alias("repeated_values"))
    lacking = df.agg(F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1).alias("incomplete_rows"))
    return whole.crossJoin(F.broadcast(lacking)).withColumn("redundant", F.col("values") - F.col("distinct_values"))


def fingerprints(df: DataFrame, column: str) -> DataFrame:
    """Texts told apart by digest: values, distinct, redundant, most copies."""
    return df.where(F.col(column).isNotNull()).groupBy(F.md5(column).alias("digest")).agg(F.count("*").alias("cnt")).agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("values"), F.count("*").alias("distinct_values"), (F.coalesce(F.sum("cnt"), F.lit(0)) - F.count("*")).cast("long").alias("redundant"), F.max("cnt").alias("most"))


def missing_id_copies(df: DataFrame, identifier: str, columns: list[str] | None = None) -> DataFrame:
    """Rows without an identifier: rows, distinct rows, extra copies."""
    lacking = df.where(F.col(identifier).isNull() | (F.trim(F.col(identifier).cast("string")) == ""))
    return duplicate_stats(lacking, columns).select(F.col("total").alias("rows"), "distinct_rows", "extra_copies")


def lacks(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def record_facts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """records, with_missing, empty, missing_cells."""
    columns = columns or df.columns
    missing = sum((lacks(F.col(c)).cast("int") for c in columns), F.lit(0))
    return df.agg(F.count("*").alias("records"), F.count_if(missing > 0).alias("with_missing"), F.count_if(missing == len(columns)).alias("empty"), F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("missing_cells"))


def listing(df: DataFrame, kind: str, record: str, after: int | None = None, page: int = 1000, columns: list[str] | None = None) -> DataFrame:
    """A page of record numbers: with_missing, empty or duplicates, after a record number."""
    columns = columns or [c for c in df.columns if c != record]
    missing = sum((lacks(F.col(c)).cast("int") for c in columns), F.lit(0))
    rows = marks(df, record, columns).where("is_extra").select("record") if kind == "duplicates" else df.where(missing > 0 if kind == "with_missing" else missing == len(columns)).select(F.col(record).alias("record"))
    return (rows.where(F.col("record") > after) if after is not None else rows).orderBy("record").limit(page)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionAll(b.exceptAll(a))


# Samples. Each is by record number or by hash of it, so reruns and other engines agree.


def sample(df: DataFrame, method: str, n: int, record: str, seed: str = "42") -> DataFrame:
    """first, last, random or mixed (a third first, a third last, the rest at random between)."""
    r = F.col(record)
    if method == "first":
        return df.orderBy(r).limit(n)
    if method == "last":
        return df.orderBy(r.desc()).limit(n)
    if method == "random":
        return df.orderBy(priority(r, seed), r).limit(n)
    edge = n // 3
    first, last = df.orderBy(r).limit(edge), df.orderBy(r.desc()).limit(edge)
    edges = first.unionAll(last).select(record).distinct()  # at most n rows
    middle = df.join(F.broadcast(edges), record, "left_anti").orderBy(priority(r, seed), r).limit(n - 2 * edge)
    return df.join(F.broadcast(edges), record, "left_semi").unionByName(middle)


def sample_percent(df: DataFrame, percent: float, record: str, seed: str = "42") -> DataFrame:
    """ceil(N * percent / 100) rows at random: those of smallest hash.

    The hash at which they end lies in one of 65,536 ranges, found from counts by range; rows of lower ranges are all
    taken, and only that range is sorted.
    """
    h = priority(F.col(record), seed)
    part = F.substring(h, 1, 4)
    counts = sorted((r["p"], r["n"]) for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    left = math.ceil(sum(n for _, n in counts) * percent / 100)
    for p, n in counts:
        if n >= left:
            return df.where(part < p).unionByName(df.where(part == p).orderBy(h, record).limit(left))
        left -= n
    return df.limit(0)


def allocate(counts: dict[str, int], n: int) -> dict[str, int]:
    """Shares of n by largest remainder with at least one each: strata below one are held at one, the rest share what is left."""
    if not len(counts) <= n <= sum(counts.values()):
        raise ValueError(f"{n} rows can't be taken from {len(counts)} strata of {sum(counts.values())} rows")
    held: set[str] = set()
    while True:
        rest, total = n - len(held), sum(c for k, c in counts.items() if k not in held)
        low = {k for k, c in counts.items() if k not in held and c * rest < total}
        if not low:
            break
        held |= low
    quota = {k: 1 if k in held else counts[k] * rest // total for k in counts}
    over = n - sum(quota.values())
    for k in sorted((k for k in counts if k not in held), key=lambda k: (-(counts[k] * rest % total), k))[:over]:
        quota[k] += 1
    return {k: min(q, counts[k]) for k, q in quota.items()}


def ranked(df: DataFrame, strata: str, record: str, most: Column, seed: str) -> DataFrame:
    w = Window.partitionBy(strata).orderBy(priority(F.col(record), seed), record)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def sample_stratified(df: DataFrame, strata: str, n: int, record: str, seed: str = "42", most_strata: int = 100_000) -> DataFrame:
    """Proportional, at least one of each stratum. The window keeps a bounded heap per stratum (WindowGroupLimit)."""
    counts = {r[0]: r[1] for r in df.groupBy(F.col(strata).cast("string")).count().limit(most_strata + 1).collect()}
    if len(counts) > most_strata:
        raise ValueError(f"more than {most_strata} strata")
    quota = df.sparkSession.createDataFrame([(k, q) for k, q in allocate(counts, n).items()], "_stratum string, _quota int")
    joined = df.join(quota, F.col(strata).cast("string").eqNullSafe(F.col("_stratum")))
    return ranked(joined, strata, record, F.col("_quota"), seed).drop("_stratum", "_quota")


def sample_balanced(df: DataFrame, strata: str, per_value: int, record: str, seed: str = "42") -> DataFrame:
    return ranked(df, strata, record, F.lit(per_value), seed)


def strata_advice(df: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """For each column: strata, smallest and largest, and whether it suits stratification."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    per = df.select(cells.alias("x")).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))
    out = per.groupBy("field").agg(F.count("*").alias("strata"), F.min("n").alias("smallest"), F.max("n").alias("largest"))
    return out.withColumn("risk", F.when(F.col("strata") == 1, "constant").when(F.col("strata") > most, "too_many").when(F.col("smallest") < 5, "small_strata").otherwise("fit"))


# Identifier uniqueness.


def uniqueness(df: DataFrame, identifier: str, columns: list[str] | None = None) -> DataFrame:
    """One row: records, present, missing, distinct, extra row copies, and the verdicts before and after removing copies."""
    columns = columns or df.columns
    i = F.col(identifier)
    value = F.when(~lacks(i), F.trim(i.cast("string")))
    base = df.agg(F.count("*").alias("records"), F.count(value).alias("present"), F.count_distinct(value).alias("distinct_ids"))
    copies = row_counts(df, columns).agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).cast("long").alias("extra_copies"), F.coalesce(F.sum(F.when(lacks(i), F.col("cnt") - 1)), F.lit(0)).cast("long").alias("extra_copies_missing"))
    out = base.crossJoin(F.broadcast(copies)).withColumn("missing", F.col("records") - F.col("present"))
    left = F.col("present") - (F.col("extra_copies") - F.col("extra_copies_missing"))
    out = out.withColumn("residual", left - F.col("distinct_ids"))
    population = F.col("records") - F.col("extra_copies")
    tolerance = F.least(F.floor(population / 100), F.floor(F.sqrt(population.cast("double"))), F.lit(1000))
    none_missing = F.col("missing") == 0
    return (
        out.withColumn("unique_raw", none_missing & (F.col("distinct_ids") == F.col("records")) & (F.col("records") >= 2))
        .withColumn("unique_after_dedup", none_missing & (F.col("residual") == 0) & (population >= 2))
        .withColumn("near_unique", none_missing & (population >= 100) & (F.col("residual") > 0) & (F.col("residual") <= tolerance))
        .withColumn("status", F.when(none_missing, "complete").otherwise("limited"))
    )
