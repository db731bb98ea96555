"""A table as observations, what can be listed from them, and the checks that they hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.ranges import position
from assaykit.operators.values import native_type, text_of, value_table


def observations(df: DataFrame, record: str) -> DataFrame:
    """record, position, raw: a row for each cell, null cells too."""
    names = [c for c in df.columns if c != record]
    cells = F.array(*[F.struct(F.lit(i).alias("position"), text_of(df, n).alias("raw")) for i, n in enumerate(names)])
    return df.select(F.col(record).alias("record"), F.explode(cells).alias("x")).select("record", "x.*")


def fields(df: DataFrame, record: str) -> DataFrame:
    """position, field, native_type: a row for each column."""
    names = [c for c in df.columns if c != record]
    return df.sparkSession.createDataFrame([(i, n, native_type(df.schema[n].dataType)) for i, n in enumerate(names)], "position int, field string, native_type string")


def first_values(cells: DataFrame, n: int) -> DataFrame:
    """position, raw, cnt, first_rec: the first ``n`` distinct values of each field in record order, with their whole counts.

    Values are counted first, and the window keeps at most ``n`` rows of a field while it reads.
    """
    values = cells.where("raw is not null").groupBy("position", "raw").agg(F.count("*").alias("cnt"), F.min("record").alias("first_rec"))
    place = F.row_number().over(Window.partitionBy("position").orderBy("first_rec", "raw"))
    return values.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """place, value, cnt: distinct values with dense places by count down, then value, over ranges."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("cnt"))
    return position(counts, F.desc("cnt"), F.col("value"), name="place").select("place", "value", "cnt")


def validate(cells: DataFrame, known: DataFrame, records: DataFrame) -> DataFrame:
    """check, broken: what of a store of observations does not hold together.

    unknown_field: cells whose field is not listed; unknown_record: cells whose record is not; repeated_cell: cells beyond
    the first of one record and field; incomplete_record: records that lack a cell of a field.
    """
    n = known.select("position").distinct().count()
    held = cells.join(F.broadcast(known.select("position").distinct()), "position", "left_semi")
    per = held.groupBy("record", "position").agg(F.count("*").alias("n")).groupBy("record").agg(F.count("*").alias("have"), F.sum(F.col("n") - 1).alias("more"))
    one = lambda name, d: d.agg(F.lit(name).alias("check"), F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("broken"))
    ids = records.select("record").distinct()
    full = ids.join(per, "record", "left")
    return (
        one("unknown_field", cells.join(known.select("position"), "position", "left_anti").select(F.lit(1).alias("k")))
        .unionByName(one("unknown_record", cells.join(ids, "record", "left_anti").select(F.lit(1).alias("k"))))
        .unionByName(one("repeated_cell", per.select(F.col("more").alias("k"))))
        .unionByName(one("incomplete_record", full.select((F.coalesce("have", F.lit(0)) < n).cast("int").alias("k"))))
    )


def diagnostics(events: DataFrame, most: int = 10) -> DataFrame:
    """code, subject, cnt, locations: diagnostics (code, subject, record) grouped, with whole counts and the first ``most`` records."""
    counts = events.groupBy("code", "subject").agg(F.count("*").alias("cnt"))
    place = F.row_number().over(Window.partitionBy("code", "subject").orderBy("record"))
    first = events.withColumn("_n", place).where(F.col("_n") <= most).groupBy("code", "subject").agg(F.sort_array(F.collect_list("record")).alias("locations"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("code", "subject")]
    return counts.alias("c").join(first.alias("f"), same).select("c.code", "c.subject", "cnt", "locations")


def structure(df: DataFrame, most_depth: int = 8) -> DataFrame:
    """path, kind, depth, present, items: every place of a nested table, with the records (or array elements) that have
    a value there and the elements of arrays. Places deeper than ``most_depth`` are left out."""
    rows: list[tuple[str, str, int]] = []
    aggs = []

    def walk(kind: T.DataType, path: str, depth: int, frame: list, value) -> None:
        # value: an array of what stands at this place in a record
        name = f"v{len(rows)}"
        rows.append((path, native_type(kind), depth))
        there = F.filter(value, lambda x: x.isNotNull())
        aggs.append(F.coalesce(F.sum(F.size(there)), F.lit(0)).cast("long").alias(name))
        items = F.aggregate(there, F.lit(0).cast("long"), lambda a, x: a + F.size(x)) if isinstance(kind, T.ArrayType) else F.lit(None).cast("long")
        aggs.append(F.sum(items).cast("long").alias(name + "i"))
        if depth >= most_depth:
            return
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(f.dataType, f"{path}.{f.name}", depth + 1, frame, F.transform(there, lambda x, n=f.name: x[n]))
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path + "[]", depth + 1, frame, F.flatten(there))

    for f in df.schema:
        walk(f.dataType, f.name, 1, [], F.array(F.col(f"`{f.name}`")))
    cells = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.lit(d).alias("depth"), F.col(f"v{i}").alias("present"), F.col(f"v{i}i").alias("items")) for i, (p, k, d) in enumerate(rows)])
    return df.agg(*aggs).select(F.explode(cells).alias("x")).select("x.*")


#: Measures that list or bin values, and the largest size at which they do.
LIMITS = {"value_listing": 100_000, "categories": 50, "long_text": 1000}


def limits(df: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """field, measure, size, bound: every measure that stops at a bound which this table exceeds.

    value_listing and categories by distinct values, long_text by the longest one. Counts themselves have no bound.
    """
    bounds = LIMITS | (bounds or {})
    per = value_table(df).where("raw is not null").groupBy("field").agg(F.count("*").alias("d"), F.max(F.when(F.col("native_type") == "string", F.length("raw"))).cast("long").alias("longest"))
    cells = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(c).alias("size"), F.lit(bounds[k]).cast("long").alias("bound")) for k, c in (("value_listing", "d"), ("categories", "d"), ("long_text", "longest"))])
    return per.select("field", F.explode(cells).alias("x")).select("field", "x.*").where(F.col("size") > F.col("bound"))
