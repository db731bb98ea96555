"""A small sample that shows what a table holds: targets from its profile, the rows that cover them, a weighted choice.

Targets are predicates; a row's targets are one array column, computed in one pass. Two candidate
rows a target reach the driver, so what is collected grows with the targets and not with the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.operators.rows import lacks, priority
from assaykit.operators.values import native_type

LOW_CARDINALITY, WORST = 100, 3
#: Weights: base * (1 + rarity), at most TOP; shares below FLOOR count as FLOOR.
TOP, FLOOR = 20.0, 1e-6
BASE = {"missing": 6.0, "value": 4.0, "extreme": 5.0, "sign": 3.0, "bin": 2.0, "length": 3.0}


@dataclass(frozen=True)
class Target:
    name: str
    kind: str
    condition: Column
    share: float | None

    @property
    def weight(self) -> float:
        rarity = 0.0 if self.share is None else min(1.0, math.log(1 / max(self.share, FLOOR)) / math.log(1 / FLOOR))
        return min(TOP, BASE[self.kind] * (1 + rarity))


def targets(df: DataFrame, columns: list[str]) -> list[Target]:
    """Missing cells, every value of columns with few of them, extremes, signs and ten bins of numbers, extremes of length.

    Two jobs at most: one aggregation for all columns, one listing of values bounded by
    LOW_CARDINALITY a column. Targets that no row meets aren't made.
    """
    kinds = {c: native_type(df.schema[c].dataType) for c in columns}
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        aggs += [F.count_if(lacks(x)).alias(f"m{i}"), F.approx_count_distinct(x).alias(f"d{i}")]
        if kinds[c] in ("integer", "number"):
            y = F.when(~F.isnan(x.cast("double")), x.cast("double"))
            aggs += [F.min(y).alias(f"lo{i}"), F.max(y).alias(f"hi{i}"), F.count_if(y < 0).alias(f"neg{i}"), F.count_if(y == 0).alias(f"zero{i}")]
        elif kinds[c] == "string":
            aggs += [F.min(F.length(x.cast("string"))).alias(f"lo{i}"), F.max(F.length(x.cast("string"))).alias(f"hi{i}")]
    s = df.agg(*aggs).first().asDict()
    n, out = s["n"], []
    if not n:
        return out
    few = [c for i, c in enumerate(columns) if s[f"d{i}"] <= 1.2 * LOW_CARDINALITY and kinds[c] not in ("array", "object")]
    listed: dict[str, list] = {}
    if few:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in few]))
        counts = df.select(cells.alias("x")).where("x.value is not null").groupBy("x.field", "x.value").agg(F.count("*").alias("cnt"))
        for r in counts.limit(2 * LOW_CARDINALITY * len(few)).collect():
            listed.setdefault(r.field, []).append((r.value, r.cnt))
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        if s[f"m{i}"]:
            out.append(Target(f"{c}:missing", "missing", lacks(x), s[f"m{i}"] / n))
        if len(listed.get(c, [])) and len(listed[c]) <= LOW_CARDINALITY:
            out += [Target(f"{c}={v}", "value", x.cast("string") == v, k / n) for v, k in sorted(listed[c]) if v.strip()]
        elif kinds[c] in ("integer", "number") and s[f"lo{i}"] is not None:
            lo, hi, y = s[f"lo{i}"], s[f"hi{i}"], x.cast("double")
            out += [Target(f"{c}:min", "extreme", y == lo, None), Target(f"{c}:max", "extreme", y == hi, None)]
            out += [Target(f"{c}:{what}", "sign", cond, k / n) for what, cond, k in (("negative", y < 0, s[f"neg{i}"]), ("zero", y == 0, s[f"zero{i}"])) if k]
            step = (hi - lo) / 10
            if step > 0 and math.isfinite(step):
                out += [Target(f"{c}:bin{b}", "bin", (y >= lo + b * step) & ((y < lo + (b + 1) * step) if b < 9 else (y <= hi)), None) for b in range(10)]
        elif kinds[c] == "string" and s[f"lo{i}"] is not None:
            size = F.length(x.cast("string"))
            out += [Target(f"{c}:shortest", "length", size == s[f"lo{i}"], None), Target(f"{c}:longest", "length", size == s[f"hi{i}"], None)]
    return out


def covered(df: DataFrame, wanted: list[Target]) -> DataFrame:
    """Add covers: the numbers of the targets that a row meets."""
    return df.withColumn("covers", F.array_compact(F.array(*[F.when(t.condition, F.lit(i)) for i, t in enumerate(wanted)])) if wanted else F.array().cast("array<int>"))


def chosen(rows: dict, wanted: list[Target], most: int) -> list:
    """Greedy cover: the record with the largest weight of targets still open, then the smallest record."""
    open_, out = set(range(len(wanted))), []
    while open_ and len(out) < most:
        gain, record = max(((sum(wanted[i].weight for i in c if i in open_), r) for r, c in rows.items()), key=lambda p: (p[0], _least(p[1])), default=(0.0, None))
        if gain <= 0:
            break
        out.append(record)
        open_ -= set(rows.pop(record))
    return out


def _least(record) -> tuple:
    return (-record,) if isinstance(record, (int, float)) else tuple(-ord(ch) for ch in str(record))


def sample(df: DataFrame, record: str, columns: list[str], n: int, seed: str = "42", ordinary: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """The rows of the sample with reason (covers, worst or ordinary), and target, weight, rows, taken.

    Up to a fifth of n is kept for ordinary rows, by hash of the record, and WORST rows are those
    with most missing cells. Records must be unique; rows without a record aren't candidates. An
    empty table gives an empty sample.
    """
    spark, r = df.sparkSession, F.col(record)
    wanted = targets(df, columns)
    rows = covered(df.where(r.isNotNull()), wanted)
    best = F.struct((-F.size("covers")).alias("k"), priority(r, seed).alias("p"), r.alias("record"), F.col("covers"))
    each = rows.select("covers", best.alias("x")).select(F.explode("covers").alias("target"), "x").groupBy("target")
    first = each.agg(F.count("*").alias("rows"), F.min("x").alias("a"), F.min_by("x", F.col("x.p")).alias("b"))
    got = first.collect()  # a row for each target
    found = {x["record"]: x["covers"] for t in got for x in (t.a, t.b)}
    picked = chosen(found, wanted, n - math.ceil(n * ordinary) if n > 1 else n)
    holes = sum((lacks(F.col(f"`{c}`")).cast("int") for c in columns), F.lit(0))
    worst = [x[0] for x in df.where(r.isNotNull() & (holes > 0)).orderBy(holes.desc(), priority(r, seed), r).select(r).limit(min(WORST, max(0, n - len(picked)))).collect()]
    reasons = dict.fromkeys(worst, "worst") | dict.fromkeys(picked, "covers")
    kind = df.schema[record].dataType.simpleString()
    taken = spark.createDataFrame(list(reasons.items()), f"_record {kind}, reason string")  # at most n rows
    special = df.join(F.broadcast(taken), r == F.col("_record")).drop("_record")
    rest = df.where(r.isNotNull()).join(F.broadcast(taken), r == F.col("_record"), "left_anti").orderBy(priority(r, seed), r).limit(max(0, n - len(reasons)))
    out = special.unionByName(rest.withColumn("reason", F.lit("ordinary")))
    met = covered(out, wanted).select(F.explode("covers").alias("target")).groupBy("target").agg(F.count("*").alias("taken"))
    names = spark.createDataFrame([(i, t.name, round(t.weight, 6)) for i, t in enumerate(wanted)], "target int, name string, weight double")
    counted = spark.createDataFrame([(t.target, t.rows) for t in got], "target int, rows long")
    coverage = names.join(counted, "target").join(met, "target", "left").select(F.col("name").alias("target"), "weight", "rows", F.coalesce("taken", F.lit(0)).alias("taken"))
    return out, coverage
