"""Which relations of a table are worth an analysis: facts of its columns, ranked pairs, and a choice under budgets.

All pairs of a kind are computed exactly in one job, over cells counted first; only one row per
column or pair of columns reaches the driver.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import normalize
from assaykit.operators.relations import pearson, rounded
from assaykit.operators.values import value_table

# Words of names that suggest an identifier.
IDENTIFIER_TOKENS = frozenset({"id", "uid", "uuid", "guid", "key", "code", "ref", "reference", "no", "num", "number"})
#: Most distinct values of a category, and the least share of distinct values of an identifier.
CATEGORIES, UNIQUE = 50, 0.9


def facts(df: DataFrame) -> DataFrame:
    """field, native_type, present, distinct_values, identifier_like, category_like, one row per column.

    A column without values is neither; an identifier has a name that says so and nearly no value twice.
    """
    named = [c for c in df.columns if IDENTIFIER_TOKENS & set(normalize.name_tokens(c))]
    per = value_table(df).groupBy("field", "position", "native_type").agg(F.coalesce(F.sum(F.when(F.col("raw").isNotNull(), F.col("cnt"))), F.lit(0)).cast("long").alias("present"), F.count("raw").alias("distinct_values"))
    n, d = F.col("present"), F.col("distinct_values")
    return per.select("field", "native_type", "present", "distinct_values", (F.col("field").isin(named) & (n > 0) & (d >= UNIQUE * n)).alias("identifier_like"), d.between(2, CATEGORIES).alias("category_like"))


def roles(df: DataFrame) -> tuple[list[str], list[str]]:
    """Number columns and category columns, without identifiers and constants."""
    rows = [r for r in facts(df).collect() if r.distinct_values >= 2 and not r.identifier_like]
    return [r.field for r in rows if r.native_type in ("integer", "number")], [r.field for r in rows if r.category_like]


def ranked(df: DataFrame, score: str, names: list[str], auto: int, keep: int) -> DataFrame:
    """Best pairs by score, then by name: the first ``auto`` are chosen. There is a row for each pair of columns."""
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(score), *names))
    return df.withColumn("place", place).where(F.col("place") <= keep).withColumn("chosen", (F.col("place") <= auto) & (F.coalesce(F.col(score), F.lit(0.0)) > 0))


def number_pairs(df: DataFrame, columns: list[str] | None = None, auto: int = 8, keep: int = 20) -> DataFrame:
    """a, b, n, r, score, reason, place, chosen: linear correlation of all pairs, by the interval's near end."""
    columns = roles(df)[0] if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, r double, score double, reason string, place int, chosen boolean")
    return ranked(pearson(df, columns).select("a", "b", "n", "r", "score", "reason"), "score", ["a", "b"], auto, keep)


def exploded(df: DataFrame, pairs: list[tuple[str, str]], second: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("va"), F.col(f"`{b}`").cast(second).alias("vb")) for a, b in pairs])
    return df.select(F.explode(cells).alias("x")).select("x.*").where("va is not null and vb is not null")


def category_tables(df: DataFrame, columns: list[str] | None = None, auto: int = 8, keep: int = 20) -> DataFrame:
    """a, b, n, v, v_corrected, place, chosen: association of all pairs of categories, by the corrected V."""
    columns = roles(df)[1] if columns is None else columns
    pairs = list(itertools.combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, v double, v_corrected double, place int, chosen boolean")
    cells = exploded(df, pairs, "string").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("o"))
    left = cells.groupBy("a", "b", "va").agg(F.sum("o").alias("ra"))
    right = cells.groupBy("a", "b", "vb").agg(F.sum("o").alias("cb"))
    part = cells.join(left, ["a", "b", "va"]).join(right, ["a", "b", "vb"]).groupBy("a", "b").agg(F.sum("o").alias("n"), F.sum(F.col("o").cast("double") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("s"))
    t = part.join(left.groupBy("a", "b").agg(F.count("*").cast("double").alias("r")), ["a", "b"]).join(right.groupBy("a", "b").agg(F.count("*").cast("double").alias("c")), ["a", "b"])
    n, r, c, phi2 = F.col("n").cast("double"), F.col("r"), F.col("c"), F.col("s") - 1
    free = lambda k: k - (k - 1) * (k - 1) / (n - 1)
    safe = (r > 1) & (c > 1) & (n > 1)
    corrected = F.greatest(F.lit(0.0), phi2 - (r - 1) * (c - 1) / (n - 1)) / F.nullif(F.least(free(r), free(c)) - 1, F.lit(0.0))
    v = t.select("a", "b", "n", rounded(F.when(safe, F.sqrt(F.greatest(F.lit(0.0), phi2) / (F.least("r", "c") - 1)))).alias("v"), rounded(F.when(safe & (corrected >= 0), F.sqrt(corrected))).alias("v_corrected"))
    return ranked(v, "v_corrected", ["a", "b"], auto, keep)


def numbers_by_category(df: DataFrame, categories: list[str] | None = None, numbers: list[str] | None = None, auto: int = 2, keep: int = 20) -> DataFrame:
    """a (category), b (number), n, k, epsilon2, place, chosen: how far categories explain numbers."""
    found = roles(df) if categories is None or numbers is None else ([], [])
    numbers, categories = found[0] if numbers is None else numbers, found[1] if categories is None else categories
    pairs = [(a, b) for a in categories for b in numbers if a != b]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, k long, epsilon2 double, place int, chosen boolean")
    per = exploded(df, pairs, "double").groupBy("a", "b", "va").agg(F.count("*").alias("n"), F.avg("vb").alias("m"), (F.var_pop("vb") * F.count("*")).alias("w"))
    n, m = F.col("n"), F.col("m")
    total = per.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("w").alias("ssw"), (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum("n")).alias("ssb"))
    k, sst = F.col("k"), F.col("ssb") + F.col("ssw")
    eps = (F.col("ssb") - (k - 1) * F.col("ssw") / F.nullif(n - k, F.lit(0))) / F.nullif(sst, F.lit(0.0))
    out = total.select("a", "b", "n", "k", rounded(F.when(eps.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), eps)))).alias("epsilon2"))
    return ranked(out, "epsilon2", ["a", "b"], auto, keep)


def date_orders(df: DataFrame, columns: list[str] | None = None, least: float = 0.99) -> DataFrame:
    """first, second, compared, ordered, share, holds: for each pair of date columns, the order most records have."""
    columns = [c for c, kind in df.dtypes if kind in ("date", "timestamp", "timestamp_ntz")] if columns is None else columns
    pairs = list(itertools.combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "first string, second string, compared long, ordered long, share double, holds boolean")
    aggs: list[Column] = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.count_if(F.col(a) <= F.col(b)).alias(f"f{i}"), F.count_if(F.col(b) <= F.col(a)).alias(f"b{i}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}")]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"f{i}").alias("f"), F.col(f"b{i}").alias("r"), F.col(f"n{i}").alias("compared")) for i, (a, b) in enumerate(pairs)])
    t = df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")
    ahead, share = F.col("f") >= F.col("r"), F.greatest("f", "r") / F.nullif(F.col("compared"), F.lit(0))
    return t.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("second"), "compared", F.greatest("f", "r").alias("ordered"), rounded(share).alias("share"), F.coalesce(share >= least, F.lit(False)).alias("holds"))


@dataclass(frozen=True)
class Candidate:
    """An analysis that could be run: what it is worth, its state in bytes, the cells it reads."""

    analysis: str
    fields: tuple[str, ...]
    utility: int
    state_bytes: int
    cells: int
    requested: bool = False
    whole_row: bool = False


def choose(candidates: list[Candidate], least_utility: int = 45, each_bytes: int = 128 << 20, all_bytes: int = 512 << 20, all_cells: int = 100_000_000, cheap_bytes: int = 1 << 20) -> list[tuple[Candidate, str]]:
    """Each candidate with its decision: requested, chosen, low_utility, too_large or over_budget.

    Requested ones come first, then small states by utility, large ones by utility a byte, and
    analyses of whole rows last.
    """

    def order(c: Candidate) -> tuple:
        if c.requested:
            return (0, 0.0, c.analysis, c.fields)
        if c.whole_row:
            return (3, -float(c.utility), c.analysis, c.fields)
        small = c.state_bytes <= cheap_bytes
        return (1 if small else 2, -(c.utility if small else c.utility / c.state_bytes), c.analysis, c.fields)

    out, used, cells = [], 0, 0
    for c in sorted(candidates, key=order):
        if not c.requested and c.utility < least_utility:
            out.append((c, "low_utility"))
        elif c.state_bytes > each_bytes:
            out.append((c, "too_large"))
        elif used + c.state_bytes > all_bytes or cells + c.cells > all_cells:
            out.append((c, "over_budget"))
        else:
            used, cells = used + c.state_bytes, cells + c.cells
            out.append((c, "requested" if c.requested else "chosen"))
    return out
