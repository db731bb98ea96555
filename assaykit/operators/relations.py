"""Relations between columns, and numbers, dates and missing cells."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import normalize
from assaykit.operators.ranges import cumulative, percentiles
from assaykit.operators.ranges import position as place

LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


# Numbers.


def numeric_stats(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), rounded(F.sum(F.col(column).cast("decimal(38,6)")), 4).alias("sum"), rounded(F.avg(x)).alias("mean"), rounded(F.var_pop(x), 4).alias("variance"), rounded(F.stddev_pop(x)).alias("std"),
        F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), F.count_if(x == 0).alias("zero"), F.count_if(x == F.floor(x)).alias("integral"),
    ).join(percentiles(df.select(x.alias("x")), "x", (0.5,)).select(rounded(F.col("q0")).alias("median")), how="left")  # fmt: skip  # one row each


def quantiles(df: DataFrame, column: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Position (n - 1) p with linear interpolation."""
    q = percentiles(df.select(F.col(column).cast("double").alias("x")), "x", levels)
    cells = F.array(*[F.struct(F.lit(p).alias("level"), rounded(F.col(f"q{i}")).alias("value")) for i, p in enumerate(levels)])
    return q.select(F.explode(cells).alias("x")).select("x.*")


def boolean_counts(df: DataFrame, column: str) -> DataFrame:
    """Values that are true, false and missing."""
    c = F.col(column).cast("boolean")
    return df.agg(F.count_if(c).alias("true_count"), F.count_if(~c).alias("false_count"), F.count_if(c.isNull()).alias("missing"))


def histogram_dense(df: DataFrame, column: str, most: int = 65_536) -> DataFrame:
    """Count of every integer value, if the range is at most ``most``."""
    c = F.floor(F.col(column).cast("double")).cast("long")
    counts = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("cnt"))
    span = counts.agg((F.max("value") - F.min("value") + 1).alias("span"))
    return counts.crossJoin(F.broadcast(span)).where(F.col("span") <= most).drop("span")


def histogram_bins(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width bins, left-closed, the last one closed; the bounds are one row, joined."""
    x = F.col(column).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).cast("long")
    return df.where(x.isNotNull()).crossJoin(F.broadcast(bounds)).groupBy(b.alias("bin")).agg(F.count("*").alias("cnt"))


def histogram_grid(df: DataFrame, column: str, exponent: int) -> DataFrame:
    """Cells of width 2 ** exponent."""
    x = F.col(column).cast("double")
    return df.where(x.isNotNull()).groupBy(F.floor(x / float(2.0**exponent)).cast("long").alias("cell")).agg(F.count("*").alias("cnt"))


def histogram_log(df: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.where(x > 0).groupBy(F.floor(F.log10(x) + 1e-12).cast("long").alias("power")).agg(F.count("*").alias("cnt"))


def shape(df: DataFrame, column: str) -> DataFrame:
    """Skewness, excess kurtosis (population), Tukey fences with counts beyond them. Quartiles and counts come from
    the distinct values; the quartiles are one row, known before values are counted against them."""
    x = F.col(column).cast("double")
    q = percentiles(df.select(x.alias("x")), "x", (0.25, 0.75)).first()
    q1, q3 = (q["q0"], q["q1"]) if q else (None, None)
    beyond = []
    for k in (1.5, 3.0):
        low, high = (F.lit(None).cast("double"),) * 2 if q1 is None else (F.lit(q1 - (q3 - q1) * k), F.lit(q3 + (q3 - q1) * k))
        beyond += [F.count_if(x < low).alias(f"below_{k}".replace(".", "_")), F.count_if(x > high).alias(f"above_{k}".replace(".", "_"))]
    quartiles = [rounded(F.lit(v).cast("double")).alias(n) for n, v in (("q1", q1), ("q3", q3))]
    got = df.agg(F.count(x).alias("n"), rounded(F.skewness(x), 4).alias("skewness"), rounded(F.kurtosis(x), 4).alias("kurtosis"), *beyond)
    return got.select("n", "skewness", "kurtosis", *quartiles, *[c for c in got.columns[3:]])


def equal_count_edges(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, lo, hi, cnt: edges at the quantiles, so that bins hold about as many values each; equal edges are one."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    row = percentiles(x, "x", tuple(i / bins for i in range(bins + 1))).first()
    edges = sorted(set(row)) if row else []
    if len(edges) < 2:
        return x.groupBy(F.lit(0).cast("long").alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("cnt"))
    bin_of = F.least(sum((F.when(F.col("x") >= e, 1).otherwise(0) for e in edges[1:]), F.lit(0)), F.lit(len(edges) - 2)).cast("long")
    known = x.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin long, lo double, hi double")
    return x.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("cnt")).join(F.broadcast(known), "bin").select("bin", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"), "cnt")


def smallest_exponent(df: DataFrame, column: str, most: int = 64, least: int = -64) -> int | None:
    """The smallest power of two, from ``least`` on, whose grid has at most ``most`` cells between minimum and maximum."""
    x = F.col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return None
    return next(e for e in range(least, 1025) if math.floor(hi / 2.0**e) - math.floor(lo / 2.0**e) + 1 <= most)


def decimal_places(df: DataFrame, column: str) -> DataFrame:
    text = F.regexp_extract(F.col(column).cast("decimal(38,9)").cast("string"), r"\.([0-9]*[1-9])?0*$", 1)
    return df.where(F.col(column).isNotNull()).groupBy(F.length(text).cast("long").alias("places")).agg(F.count("*").alias("cnt"))


def stats_by(df: DataFrame, category: str, column: str) -> DataFrame:
    """Numbers by category and over all (category null, overall true)."""
    x = F.col(column).cast("double")
    got = df.where(x.isNotNull()).rollup(category).agg(F.count("*").alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), rounded(F.avg(x)).alias("mean"), rounded(F.stddev_pop(x), 4).alias("std"), (F.grouping(category) == 1).alias("overall"))
    values = df.select(F.col(category), x.alias("x")).where("x is not null")
    each = percentiles(values, "x", (0.5,), [category]).select(F.col(category).alias("_c"), F.lit(False).alias("_o"), "q0")
    every = each.unionAll(percentiles(values, "x", (0.5,)).select(F.lit(None).cast(values.schema[category].dataType).alias("_c"), F.lit(True).alias("_o"), "q0"))
    joined = got.join(every, F.col(category).eqNullSafe(F.col("_c")) & (F.col("overall") == F.col("_o")))
    return joined.select(category, "n", "min", "max", "mean", "std", rounded(F.col("q0")).alias("median"), "overall")


def correlation_ratio(df: DataFrame, category: str, column: str) -> DataFrame:
    """eta squared and epsilon squared (corrected, within [0, 1]) with its root as score."""
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull() & F.col(category).isNotNull())
    per = rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("ssw"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    total = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ssw").alias("ssw"), mean.alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    ssb = F.col("s2") - F.col("n") * F.col("mean") * F.col("mean")
    sst = ssb + F.col("ssw")
    eps = (ssb - (F.col("k") - 1) * F.col("ssw") / (F.col("n") - F.col("k"))) / sst
    eps = F.greatest(F.lit(0.0), F.least(F.lit(1.0), eps))
    return total.select("k", "n", rounded(ssb / sst).alias("eta2"), rounded(eps).alias("epsilon2"), rounded(F.sqrt(eps)).alias("score"))


# Pairs of columns.


def co_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """i, j, n, r, vx, vy for every pair of columns, i before j, over the rows where both have a value.

    Each batch gives its counts, sums and products for all pairs as matrix products, about the
    means of the columns so that nothing cancels; one row per pair and task is shuffled. So the
    plan does not grow with the pairs.
    """
    k = len(columns)
    cells = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    means = np.nan_to_num(np.array([x if x is not None else 0.0 for x in df.select(*cells).agg(*[F.avg(f"c{i}") for i in range(k)]).first()], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, k, k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) if len(b) else np.zeros((0, k))
            on = ~np.isnan(x)
            x = np.where(on, x - means, 0.0)
            m = on.astype(float)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(k, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t[i, j]) for t in total]], names=["i", "j", *"nabcde"])

    part = df.select(*cells).mapInArrow(run, "i long, j long, n double, a double, b double, c double, d double, e double")
    s = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nabcde"])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.greatest(F.lit(0.0), F.col("c") / n - F.col("a") * F.col("a") / (n * n)), F.greatest(F.lit(0.0), F.col("d") / n - F.col("b") * F.col("b") / (n * n))
    cov = F.col("e") / n - F.col("a") * F.col("b") / (n * n)
    return s.select("i", "j", F.col("n").cast("long").alias("n"), vx.alias("vx"), vy.alias("vy"), F.try_divide(cov, F.sqrt(vx * vy)).alias("r"))


def pearson(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """Every pair: pairs, r with a 95 % interval and the score, or the reason for none."""
    name = F.array(*map(F.lit, columns))
    rows = co_moments(df, columns).select(F.get(name, F.col("i").cast("int")).alias("a"), F.get(name, F.col("j").cast("int")).alias("b"), "n", "vx", "vy", "r")
    tiny = lambda v: v <= 1e-24
    reason = F.when(F.col("n") < least, "too_few_pairs").when(tiny(F.col("vx")) | tiny(F.col("vy")), "constant")
    r = F.when(reason.isNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))))
    half = 1.96 / F.sqrt((F.col("n") - 3).cast("double"))
    rows = rows.select("a", "b", "n", rounded(r).alias("r"), reason.alias("reason"), F.when(F.abs(r) < 1, F.tanh(F.atanh(r) - half)).otherwise(r).alias("lo"), F.when(F.abs(r) < 1, F.tanh(F.atanh(r) + half)).otherwise(r).alias("hi"))
    score = F.when(F.col("lo") * F.col("hi") > 0, F.least(F.abs("lo"), F.abs("hi"))).when(F.col("r").isNotNull(), 0.0)
    return rows.withColumn("score", rounded(score)).withColumns({"lo": rounded(F.col("lo")), "hi": rounded(F.col("hi"))})


def average_rank(table: DataFrame, column: str, cnt: str) -> DataFrame:
    """Average rank of each distinct value, over distinct values with counts."""
    return cumulative(table, [column], cnt).withColumn(f"rank_{column}", F.col("_before") + (F.col(cnt) + 1) / 2).drop("_before")


def rank_interval(r: Column, n: Column) -> Column:
    """struct(lo, hi): the 95 % interval of a rank correlation, with the variance of Bonett and Wright; null below four pairs."""
    z = F.atanh(F.greatest(F.lit(-0.999999999), F.least(F.lit(0.999999999), r)))
    error = 1.96 * F.sqrt((1 + r * r / 2) / F.nullif((n - 3).cast("double"), F.lit(0.0)))
    return F.when(n >= 4, F.struct(rounded(F.tanh(z - error)).alias("lo"), rounded(F.tanh(z + error)).alias("hi")))


def binned_spearman(df: DataFrame, a: str, b: str, bins: int = 64) -> DataFrame:
    """n, rho, lower, upper, reason: rank correlation read from a grid of bins of about equal counts, and the bounds
    that no order inside the bins can leave.

    Ranks inside a bin turn a column's centred rank vector by at most atan of the root of the bins'
    rank variance over the root of the variance between bins. Only the grid, of bins squared rows, is held by one task.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    edges = {c: sorted(set(percentiles(rows, c, tuple(i / bins for i in range(1, bins))).first() or ())) for c in "xy"}
    bin_of = lambda c: F.size(F.filter(F.array(*[F.lit(e) for e in edges[c]]), lambda e: e <= F.col(c))) if edges[c] else F.lit(0)
    grid = rows.groupBy(bin_of("x").alias("i"), bin_of("y").alias("j")).agg(F.count("*").alias("n"))
    side = lambda k: cumulative(grid.groupBy(k).agg(F.sum("n").alias("m")), [k], "m").select(k, F.col("m").alias(f"m{k}"), (F.col("_before") + (F.col("m") + 1) / 2).alias(f"c{k}"))
    si, sj = side("i"), side("j")
    n = grid.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    middle = (n + 1) / 2
    of = lambda s, k: s.agg(F.coalesce(F.sum(F.col(f"m{k}") * (F.col(f"c{k}") - middle) ** 2), F.lit(0.0)).alias(f"q{k}"), F.coalesce(F.sum(F.col(f"m{k}").cast("double") * (F.col(f"m{k}").cast("double") ** 2 - 1) / 12), F.lit(0.0)).alias(f"w{k}"), F.count("*").alias(f"h{k}")).first()
    ti, tj = of(si, "i"), of(sj, "j")
    cross = grid.join(F.broadcast(si), "i").join(F.broadcast(sj), "j").agg(F.sum(F.col("n") * (F.col("ci") - middle) * (F.col("cj") - middle))).first()[0]
    reason = "single_bin_first" if ti["hi"] < 2 else "single_bin_second" if tj["hj"] < 2 else None
    if reason:
        return df.sparkSession.createDataFrame([(n, None, None, None, reason)], "n long, rho double, lower double, upper double, reason string")
    rho = max(-1.0, min(1.0, cross / math.sqrt(ti["qi"] * tj["qj"])))
    slack = math.atan2(math.sqrt(ti["wi"]), math.sqrt(ti["qi"])) + math.atan2(math.sqrt(tj["wj"]), math.sqrt(tj["qj"]))
    turn = math.acos(rho)
    bounds = round(math.cos(min(math.pi, turn + slack)), 6), round(math.cos(max(0.0, turn - slack)), 6)
    return df.sparkSession.createDataFrame([(n, round(rho, 6), *bounds, None)], "n long, rho double, lower double, upper double, reason string")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact rank correlation: ranks are found on distinct values, then joined."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("w"))
    for c in (a, b):
        rows = rows.join(average_rank(rows.groupBy(c).agg(F.sum("w").alias("n_" + c)), c, "n_" + c).select(c, f"rank_{c}"), c)
    x, y, w = F.col(f"rank_{a}"), F.col(f"rank_{b}"), F.col("w")
    n = F.sum(w)
    mx, my = F.sum(w * x) / n, F.sum(w * y) / n
    cov, vx, vy = F.sum(w * x * y) / n - mx * my, F.sum(w * x * x) / n - mx * mx, F.sum(w * y * y) / n - my * my
    return rows.agg(n.cast("long").alias("n"), rounded(cov / F.sqrt(vx * vy), 5).alias("rho"))


def crosstab(df: DataFrame, a: str, b: str, feature: str = "value") -> DataFrame:
    """category, class, cnt: rows by category and by the value of another column, or by its prefix, length or pattern."""
    other = F.col(b) if feature == "value" else normalize.feature(F.col(b).cast("string"), feature)
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("category"), other.alias("class")).agg(F.count("*").alias("cnt"))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi squared, Cramer's V and its bias-corrected form, from cell counts; margins are joined, not windowed over rows."""
    cells = crosstab(df, a, b)
    rows, cols = cells.groupBy("category").agg(F.sum("cnt").alias("ra")), cells.groupBy("class").agg(F.sum("cnt").alias("cb"))
    total = rows.agg(F.sum("ra").alias("n"), F.count("*").alias("r")).crossJoin(cols.agg(F.count("*").alias("c")))
    # chi squared = n (sum of o^2 / (ra cb) - 1): cells without rows add nothing
    part = cells.join(rows, "category").join(cols, "class").agg(F.sum(F.col("cnt").cast("double") * F.col("cnt") / (F.col("ra").cast("double") * F.col("cb"))).alias("s"))
    t = part.crossJoin(total).withColumn("phi2", F.greatest(F.lit(0.0), F.col("s") - 1))
    n, r, c = (F.col(k).cast("double") for k in ("n", "r", "c"))
    t = t.withColumn("p", F.greatest(F.lit(0.0), F.col("phi2") - (r - 1) * (c - 1) / (n - 1))).withColumn("rr", r - (r - 1) * (r - 1) / (n - 1)).withColumn("cc", c - (c - 1) * (c - 1) / (n - 1))
    reason = F.when(r < 2, "single_category").when(c < 2, "single_class")
    small = F.least(r, c) - 1
    return t.select(F.col("n").cast("long"), F.col("r").cast("long"), F.col("c").cast("long"), rounded(F.col("phi2") * n, 4).alias("chi2"), rounded(F.when(reason.isNull(), F.sqrt(F.col("phi2") / small))).alias("v"), rounded(F.when(reason.isNull(), F.sqrt(F.col("p") / (F.least("rr", "cc") - 1)))).alias("v_corrected"), reason.alias("reason"))


def purity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Dominant class of each category, its share, and the rows that are off it."""
    cells = crosstab(df, a, b)
    per = cells.groupBy("category").agg(F.sum("cnt").cast("long").alias("n"), F.min(F.struct((-F.col("cnt")).alias("k"), F.col("class"))).alias("d"))
    return per.select("category", "n", F.col("d.class").alias("dominant"), (-F.col("d.k")).alias("dominant_cnt"), rounded(-F.col("d.k") / F.col("n")).alias("purity"), (F.col("n") + F.col("d.k")).alias("exceptions"))


def rules(df: DataFrame, a: str, b: str, least_purity: float = 0.9, support: int = 30) -> DataFrame:
    """Candidate rules category -> class."""
    return purity(df, a, b).where((F.col("purity") >= least_purity) & (F.col("n") >= support))


def exceptions(df: DataFrame, a: str, b: str, record: str, per: int = 3) -> DataFrame:
    """First rows off the dominant class of their category."""
    dominant = purity(df, a, b).select(F.col("category").alias(a), "dominant")
    off = df.where(F.col(b).isNotNull()).join(dominant, a).where(F.col(b) != F.col("dominant")).select(F.col(a).alias("category"), F.col(b).alias("class"), F.col(record).alias("record"))
    return off.withColumn("place", F.row_number().over(Window.partitionBy("category", "class").orderBy("record"))).where(F.col("place") <= per)


# Missing cells.


def missing_flags(df: DataFrame, columns: list[str]) -> list[Column]:
    return [(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).cast("int") for c in columns]


def missing_patterns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Records by the set of columns they lack."""
    lacking = F.concat_ws("+", *[F.when(f == 1, F.lit(c)) for c, f in zip(columns, missing_flags(df, columns))])
    return df.groupBy(lacking.alias("missing")).agg(F.count("*").alias("records"))


def missing_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each pair of columns, records that lack both, and the Jaccard index. Counted over distinct patterns, not rows."""
    flags = df.select(*[f.alias(f"m{i}") for i, f in enumerate(missing_flags(df, columns))]).groupBy(*[f"m{i}" for i in range(len(columns))]).agg(F.count("*").alias("k"))
    pairs = F.array(*[F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"m{i}").alias("x"), F.col(f"m{j}").alias("y")) for i, j in itertools.combinations(range(len(columns)), 2)])
    long = flags.select("k", F.explode(pairs).alias("p")).select("k", "p.*")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("k"))), F.lit(0)).cast("long")
    both, one = n((F.col("x") == 1) & (F.col("y") == 1)), n((F.col("x") == 1) | (F.col("y") == 1))
    return long.groupBy("a", "b").agg(both.alias("both"), rounded(F.coalesce(F.try_divide(both, one), F.lit(0.0))).alias("jaccard"))


def drift(df: DataFrame, column: str, record: str, slices: int = 10) -> DataFrame:
    """Ten slices in record order: records, missing, and values first seen there. Positions come from ranges of records, without one global window."""
    placed = position(df.select(F.col(record).alias("_r"), F.col(column).alias("_v")), "_r")
    n = placed.agg(F.max("position").alias("last"))
    part = placed.crossJoin(F.broadcast(n)).select(F.floor(F.col("position") * slices / (F.col("last") + 1)).cast("long").alias("slice"), "_v")
    first = part.where(F.col("_v").isNotNull()).groupBy("_v").agg(F.min("slice").alias("slice")).groupBy("slice").agg(F.count("*").alias("new_values"))
    return part.groupBy("slice").agg(F.count("*").alias("records"), F.count_if(F.col("_v").isNull()).alias("missing")).join(first, "slice", "left").withColumn("new_values", F.coalesce("new_values", F.lit(0)))


def position(df: DataFrame, record: str) -> DataFrame:
    """0-based place in the order of distinct record numbers: range partitions are sorted apart, and their sizes summed."""
    return place(df, record)


def missing_blocks(df: DataFrame, columns: list[str], share: float = 0.8, least: float = 0.01, most: int = 5) -> DataFrame:
    """columns, records, share: the largest sets of columns that go missing together.

    A set is a block if the records that lack all of it are ``share`` of those that lack each of its columns and
    ``least`` of all records. Counts come from the patterns of missing columns, of which there are at most as many as
    the table shows, and only those that lack two columns or more reach the driver.
    """
    records = df.count()
    flags = missing_flags(df, columns)
    each = df.agg(*[F.coalesce(F.sum(f), F.lit(0)) for f in flags]).first()
    lacks = {c: n for c, n in zip(columns, each) if n}
    pattern = F.array_compact(F.array(*[F.when(f == 1, F.lit(c)) for c, f in zip(columns, flags) if c in lacks])) if lacks else F.array()
    seen = {frozenset(r["p"]): r["n"] for r in df.groupBy(pattern.alias("p")).agg(F.count("*").alias("n")).where(F.size("p") >= 2).collect()}
    together = lambda s: sum(n for p, n in seen.items() if s <= p)
    holds = lambda s, n: n >= least * records and all(n >= share * lacks[c] for c in s)
    # every block is what is left of an intersection of patterns after its more often missing columns are dropped
    closed: set[frozenset] = set()
    for p in seen:
        closed |= {p} | {p & q for q in closed}
    found: dict[frozenset, int] = {}
    for s in closed:
        while len(s) >= 2:
            n = together(s)
            kept = frozenset(c for c in s if n >= share * lacks[c])
            if kept == s:
                if holds(s, n):
                    found[s] = n
                break
            s = kept
    top = [s for s in found if not any(s < t for t in found)]
    at = {c: i for i, c in enumerate(columns)}
    top = sorted(top, key=lambda s: (-found[s], sorted(at[c] for c in s)))[:most]
    rows = [("+".join(sorted(s, key=at.get)), found[s], round(min(found[s] / lacks[c] for c in s), 6)) for s in top]
    return df.sparkSession.createDataFrame(rows, "columns string, records long, share double")


# Dates.


def periods(df: DataFrame, column: str, unit: str) -> DataFrame:
    form = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    return df.where(F.col(column).isNotNull()).groupBy(F.date_format(column, form).alias("period")).agg(F.count("*").alias("cnt"))


def unit_for(df: DataFrame, column: str) -> str:
    """day for a span of at most 732 days, month for at most 60 years, else year."""
    days = df.agg(F.datediff(F.max(column), F.min(column))).first()[0] or 0
    return "day" if days <= 732 else "month" if days <= 60 * 366 else "year"


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Counts by weekday (0 is Monday) and hour."""
    c = F.col(column)
    return df.where(c.isNotNull()).groupBy(F.weekday(c).cast("long").alias("weekday"), F.hour(c).cast("long").alias("hour")).agg(F.count("*").alias("cnt"))


def date_summary(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """part (month, weekday, hour or after), value, cnt: where the dates lie, and how many are after ``as_of``."""
    c = F.col(column)
    parts = F.array(*[F.struct(F.lit(n).alias("part"), v.cast("string").alias("value")) for n, v in (("month", F.date_format(c, "yyyy-MM")), ("weekday", F.weekday(c)), ("hour", F.hour(c)), ("after", F.when(c.cast("date") > F.lit(as_of).cast("date"), "yes")))])
    return df.where(c.isNotNull()).select(F.explode(parts).alias("x")).where("x.value is not null").groupBy("x.part", "x.value").agg(F.count("*").alias("cnt"))


def decades(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(F.year(column) / 10) * 10).cast("long").alias("decade")).agg(F.count("*").alias("cnt"))


def empty_periods(df: DataFrame, column: str) -> DataFrame:
    """Months without rows between the first and the last."""
    months = df.where(F.col(column).isNotNull()).select(F.trunc(column, "month").alias("m")).distinct()
    every = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m"))
    return every.join(months, "m", "left_anti").select(F.date_format("m", "yyyy-MM").alias("period"))


def temporal_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull()).groupBy(F.year(c).cast("long").alias("year")).agg(F.count("*").alias("cnt"), F.date_format(F.min(c), "yyyy-MM-dd").alias("first"), F.date_format(F.max(c), "yyyy-MM-dd").alias("last"))


def date_order(df: DataFrame, first: str, second: str) -> DataFrame:
    """Records compared, equal, broken (first after second), and left out as missing."""
    a, b = F.col(first), F.col(second)
    return df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("compared"), F.count_if(a == b).alias("equal"), F.count_if(a > b).alias("broken"), F.count_if(a.isNull() | b.isNull()).alias("missing"))


# Near values.


def near_values(df: DataFrame, column: str, rare: int = 2, frequent: int = 10, ratio: int = 10) -> DataFrame:
    """Rare values one edit from a frequent one: both are expanded to their one-deletion forms and joined on them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))
    forms = F.array_distinct(F.concat(F.array("value"), F.transform(F.sequence(F.lit(1), F.greatest(F.length("value"), F.lit(1))), lambda i: F.concat(F.substring("value", F.lit(1), i - 1), F.substring("value", i + 1, F.length("value"))))))
    keyed = counts.withColumn("form", F.explode(forms))
    a, b = keyed.where(F.col("cnt") <= rare).alias("a"), keyed.where(F.col("cnt") >= frequent).alias("b")
    met = a.join(b, F.expr("a.form = b.form")).where("a.value <> b.value and lower(a.value) <> lower(b.value)").where(F.levenshtein(F.col("a.value"), F.col("b.value")) == 1).where(F.expr(f"b.cnt >= {ratio} * a.cnt"))
    return met.select(F.col("a.value").alias("value"), F.col("a.cnt").alias("cnt"), F.col("b.value").alias("near"), F.col("b.cnt").alias("near_cnt")).distinct()


# Arrays and objects.


def array_profile(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.size(column).cast("long").alias("length")).agg(F.count("*").alias("cnt"))


def key_sets(df: DataFrame, column: str) -> DataFrame:
    """Sets of object keys of a JSON text column."""
    return df.where(F.col(column).isNotNull()).groupBy(F.array_join(F.array_sort(F.json_object_keys(column)), ",").alias("keys")).agg(F.count("*").alias("cnt"))
