"""The tables of a report, computed from profiles, findings and relations: a row per column, pair or finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.operators import explore, quality, rows
from assaykit.operators.ranges import cut
from assaykit.operators.relations import missing_blocks
from assaykit.operators.values import analysed, bottom_k, profiled

#: Words for a bias-corrected V or the near end of a correlation's interval, below these limits.
STRENGTH = ((0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"))


def strength(score: Column) -> Column:
    out = F.when(score.isNull(), None)
    for limit, word in STRENGTH:
        out = out.when(score < limit, word)
    return out.otherwise("strong")


def overview(df: DataFrame) -> DataFrame:
    """field, kind, sentence: what a column holds, in one line."""
    values = cut(analysed(df))
    seen = cut(quality.kinds(values))
    return sentences(profiled(values, seen), quality.classified(quality.measured_kinds(seen)))


def sentences(p: DataFrame, classes: DataFrame) -> DataFrame:
    """field, kind, sentence from a profile and its classification."""
    c = classes.select("field", "family", "type", "role")
    n, d = F.col("present"), F.col("distinct_values")
    kind = (
        F.when(n == 0, "empty").when(F.col("role") == "unique_id", "unique_id").when(F.col("role") == "identifier", "identifier").when(d == 1, "constant").when(F.col("type") == "boolean", "boolean")
        .when(F.col("family") == "categorical", "enum").when(F.col("family") == "numeric", "numeric").when(F.col("family") == "temporal", "temporal").when(F.col("family").isin("contact", "geographic", "web_network", "identifier"), "shaped")
        .when(F.col("technical_type") == "mixed", "mixed").otherwise("text")
    )
    count = lambda x: F.format_number(x, 0)
    share = F.concat(F.format_number(F.col("top_count") * 100 / n, 1), F.lit(" %"))
    top = F.concat(count(d), F.lit(" values, most often "), F.col("top_value"), F.lit(" ("), share, F.lit(")"))
    sized = F.concat(count(d), F.lit(" values of "), F.col("min_length").cast("string"), F.lit(" to "), F.col("max_length").cast("string"), F.lit(" characters"))
    sentence = (
        F.when(kind == "empty", F.lit("no values")).when(kind == "unique_id", F.concat(count(n), F.lit(" values, all different"))).when(kind == "identifier", F.concat(count(d), F.lit(" different of "), count(n), F.lit(" values")))
        .when(kind == "constant", F.concat(F.lit("always "), F.col("top_value"))).when(kind.isin("boolean", "enum"), top).when(kind.isin("text", "shaped"), sized).otherwise(F.concat(count(d), F.lit(" different "), F.col("technical_type"), F.lit(" values")))
    )
    return p.join(c, "field").select("field", kind.alias("kind"), sentence.alias("sentence"))


def summary_table(df: DataFrame) -> DataFrame:
    """position, field, family, type, role, sentence, present, missing, missing_share, errors, issues, codes: a row per column."""
    values = cut(analysed(df))  # the table is read once, and its measures are made once
    seen = cut(quality.kinds(values))
    m, whole = cut(quality.measured_kinds(seen)), cut(profiled(values, seen))
    classes = quality.classified(m)
    p, c = whole.select("position", "field", "positions", "present", "missing"), classes.select("field", "family", "type", "role")
    found = quality.found(values, seen, m).groupBy("field").agg(
        F.coalesce(F.sum(F.when(F.col("class") == "error", F.col("count"))), F.lit(0)).cast("long").alias("errors"),
        F.coalesce(F.sum(F.when(F.col("class") == "issue", F.col("count"))), F.lit(0)).cast("long").alias("issues"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"),
    )  # fmt: skip  # a row per column and code
    out = p.join(c, "field").join(sentences(whole, classes).select("field", "sentence"), "field").join(found, "field", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return out.select("position", "field", "family", "type", "role", "sentence", "present", "missing", F.round(F.col("missing") / F.col("positions"), 4).alias("missing_share"), zero("errors"), zero("issues"), F.coalesce("codes", F.lit("")).alias("codes"))


def table_summary(columns: DataFrame) -> DataFrame:
    """One row from ``summary_table``: columns, columns with missing cells, with errors, with issues, and their totals."""
    return columns.agg(F.count("*").alias("columns"), F.count_if(F.col("missing") > 0).alias("with_missing"), F.count_if(F.col("errors") > 0).alias("with_errors"), F.count_if(F.col("issues") > 0).alias("with_issues"), F.sum("missing").cast("long").alias("missing_cells"), F.sum("errors").cast("long").alias("errors"), F.sum("issues").cast("long").alias("issues"))


def relations_view(df: DataFrame, numbers: list[str], categories: list[str], most: int = 20) -> DataFrame:
    """kind, a, b, n, score, word, strongest first of each kind: correlations, tables of categories, numbers by category."""
    pairs = explore.number_pairs(df, numbers, keep=most).select(F.lit("correlation").alias("kind"), "a", "b", "n", "score")
    tables = explore.category_tables(df, categories, keep=most).select(F.lit("table").alias("kind"), "a", "b", "n", F.col("v_corrected").alias("score"))
    groups = explore.numbers_by_category(df, categories, numbers, keep=most).select(F.lit("by_category").alias("kind"), "a", "b", "n", F.round(F.sqrt("epsilon2"), 6).alias("score"))
    return pairs.unionByName(tables).unionByName(groups).withColumn("word", strength(F.col("score")))


def insights(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """family, subject, text, count: cards for findings, columns that go missing together, and repeated rows."""
    columns = columns or df.columns
    found = quality.findings(df).select(F.lit("finding").alias("family"), F.col("field").alias("subject"), F.concat("code", F.lit(": "), F.col("count").cast("string"), F.lit(" of "), F.coalesce(F.col("of").cast("string"), F.lit("-"))).alias("text"), "count")
    blocks = missing_blocks(df, columns).select(F.lit("missing").alias("family"), F.col("columns").alias("subject"), F.concat(F.lit("missing together in "), F.col("records").cast("string"), F.lit(" records")).alias("text"), F.col("records").alias("count"))
    copies = rows.duplicate_stats(df).where("extra_copies > 0").select(F.lit("duplicates").alias("family"), F.lit("rows").alias("subject"), F.concat(F.col("extra_copies").cast("string"), F.lit(" rows repeat an earlier one")).alias("text"), F.col("extra_copies").alias("count"))
    return found.unionByName(blocks).unionByName(copies)


def uniqueness_case(unique: DataFrame) -> DataFrame:
    """case of ``rows.uniqueness``: A unique as it is, B once whole copies are out, C repeated between different rows, D none of these can be told (fewer than two records), E values missing."""
    case = F.when(F.col("missing") > 0, "E").when(F.col("unique_raw"), "A").when(F.col("unique_after_dedup"), "B").when(F.col("residual") > 0, "C").otherwise("D")
    return unique.select("records", "present", "missing", "distinct_ids", "extra_copies", "residual", case.alias("case"))


def evidence(df: DataFrame, identifier: str, measured: dict[str, int] | None = None) -> DataFrame:
    """figure, value, source, agrees: the figures of uniqueness as counted, against ones measured before (by the same names)."""
    got = rows.uniqueness(df, identifier)
    names = ("records", "present", "missing", "distinct_ids", "extra_copies")
    before = F.create_map(*[x for k, v in (measured or {"": 0}).items() for x in (F.lit(k), F.lit(v).cast("long"))])
    cells = F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).alias("value"), before[F.lit(n)].alias("m")) for n in names])
    long = got.select(F.explode(cells).alias("x")).select("x.*")
    return long.select("figure", "value", F.when(F.col("m").isNull(), "counted").otherwise("both").alias("source"), (F.col("m").isNull() | (F.col("m") == F.col("value"))).alias("agrees"))


def refined(classes: DataFrame, exact: DataFrame) -> DataFrame:
    """Classification with identifiers made unique_id where ``exact`` (field, present, positions, distinct_raw, distinct_values,
    from a profile) proves that every position has a value of its own and that no spelling was changed."""
    e = exact.select("field", ((F.col("positions") == F.col("present")) & (F.col("present") >= 2) & (F.col("distinct_values") == F.col("present")) & (F.col("distinct_raw") == F.col("distinct_values"))).alias("_proved"))
    role = F.when((F.col("role") == "identifier") & F.col("_proved"), "unique_id").otherwise(F.col("role"))
    return classes.join(e, "field", "left").withColumn("role", role).drop("_proved")


def overlaps(marks: DataFrame) -> DataFrame:
    """a, b, common, same: pairs of codes that concern common records, from (code, record). Equal counts prove nothing, common records do.

    The codes of one record are few, so pairs are made inside a record, not between records.
    """
    per = marks.distinct().groupBy("record").agg(F.array_sort(F.collect_set("code")).alias("c")).where(F.size("c") >= 1)
    pairs = per.select(F.explode(F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("common"))
    size = marks.distinct().groupBy("code").agg(F.count("*").alias("n"))
    joined = pairs.join(F.broadcast(size.withColumnsRenamed({"code": "a", "n": "na"})), "a").join(F.broadcast(size.withColumnsRenamed({"code": "b", "n": "nb"})), "b")
    return joined.select("a", "b", "common", ((F.col("common") == F.col("na")) & (F.col("common") == F.col("nb"))).alias("same"))


def merged(codes: list[str], proved: list[tuple[str, str]]) -> list[list[str]]:
    """Codes in groups: those tied by a proof, directly or not, in the order they come."""
    group = {c: {c} for c in codes}
    for a, b in proved:
        both = group[a] | group[b]
        for c in both:
            group[c] = both
    return [sorted(g, key=codes.index) for i, g in enumerate(map(group.get, codes)) if codes[i] == min(g, key=codes.index)]


def edit_distance(a: str, b: str) -> float:
    """Edits between two texts as a share of the longer one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1] / max(len(a), len(b), 1)


def diverse(values: list[str], n: int) -> list[str]:
    """n values far from each other: the two farthest, then always the one farthest from all taken (the earlier on a tie)."""
    if len(values) <= n:
        return list(values)
    if n == 1:
        return values[:1]
    far = {(i, j): edit_distance(values[i], values[j]) for i in range(len(values)) for j in range(i + 1, len(values))}
    taken = list(max(far, key=lambda p: (far[p], -p[0], -p[1])))
    apart = [min(far[min(i, k), max(i, k)] if i != k else 0.0 for k in taken) for i in range(len(values))]
    while len(taken) < n:
        best = max((i for i in range(len(values)) if i not in taken), key=lambda i: (apart[i], -i))
        taken.append(best)
        apart = [min(a, far[min(i, best), max(i, best)] if i != best else 0.0) for i, a in enumerate(apart)]
    return [values[i] for i in taken]


def examples(df: DataFrame, column: str, n: int = 5, sample: int = 40) -> DataFrame:
    """place, value: diverse values of a column, out of the ``sample`` distinct ones of smallest hash."""
    values = [r["value"] for r in bottom_k(df, column, sample).collect()]
    return df.sparkSession.createDataFrame(list(enumerate(diverse(values, n))), "place long, value string")


def row_sample(df: DataFrame, record: str, start: int = 50, middle: int = 50, end: int = 50, seed: str = "42") -> DataFrame:
    """The first and last rows and, of those between, the ones of smallest hash, with their origin; no row twice."""
    r = F.col(record)
    first = df.orderBy(r).limit(start).withColumn("origin", F.lit("start"))
    last = df.orderBy(r.desc()).limit(end).withColumn("origin", F.lit("end"))
    ids = first.select(record)
    last = last.join(F.broadcast(ids), record, "left_anti")  # at most ``start`` rows
    inner = df.join(F.broadcast(ids.unionByName(last.select(record))), record, "left_anti")
    rest = inner.orderBy(rows.priority(r, seed), r).limit(middle).withColumn("origin", F.lit("middle"))
    return first.unionByName(rest).unionByName(last)


def source_shape(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """records, columns, cells, missing_cells, duplicate_rows of a whole table."""
    columns = columns or df.columns
    facts, copies = rows.record_facts(df, columns), rows.duplicate_stats(df, columns).select("extra_copies")
    return facts.join(F.broadcast(copies)).select("records", F.lit(len(columns)).alias("columns"), (F.col("records") * len(columns)).alias("cells"), "missing_cells", F.col("extra_copies").alias("duplicate_rows"))
