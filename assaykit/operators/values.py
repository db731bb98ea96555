"""The long value table and what follows from it: one row per field and distinct value, with its count.

Unpivot once, aggregate by (field, value) with map-side partial counts, and compute every
per-value expression on distinct values only. No field is collected; skew on a frequent value
is taken by the partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions import detectors, normalize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def native_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, NUMERIC):
        return "number"
    return "boolean" if isinstance(kind, T.BooleanType) else "array" if isinstance(kind, T.ArrayType) else "object" if isinstance(kind, (T.StructType, T.MapType)) else "string"


def text_of(df: DataFrame, name: str) -> Column:
    """A cell as text; timestamps in ISO form, numbers in their shortest form, containers as JSON."""
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def placed(df: DataFrame, names: list[str]) -> list[Column]:
    """field, position and native_type of these columns, looked up by position."""
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("position") + 1)
    return [of(names).alias("field"), F.col("position"), of([native_type(df.schema[n].dataType) for n in names]).alias("native_type")]


def value_table(df: DataFrame, record: str | None = None) -> DataFrame:
    """field, position, native_type, raw, cnt and (with a record number column) first_rec, last_rec."""
    names = [c for c in df.columns if c != record]
    cells = F.array(*[F.struct(F.lit(i).alias("position"), text_of(df, n).alias("raw")) for i, n in enumerate(names)])
    rows = df.select(*([F.col(record).alias("rec")] if record else []), F.explode(cells).alias("x")).select("x.*", *(["rec"] if record else []))
    more = [F.min("rec").alias("first_rec"), F.max("rec").alias("last_rec")] if record else []
    # only the position is shuffled; names are looked up after
    counted = rows.groupBy("position", "raw").agg(F.count("*").alias("cnt"), *more)
    return counted.select(*placed(df, names), "raw", "cnt", *[c for c in ("first_rec", "last_rec") if record])


def normalised(lvt: DataFrame, unicode: bool = True, odd: Column | None = None) -> DataFrame:
    """Add category and analytical to each distinct value. ``odd`` tells which raw values a stage can change, if that is known."""
    raw = F.col("raw")
    is_text = F.col("native_type") == "string"
    value = F.when(raw.rlike(normalize.ODD) if odd is None else odd, normalize.analytical(raw) if unicode else normalize.collapse(normalize.trim(raw))).otherwise(raw)
    out = lvt.withColumn("category", F.when(raw.isNull(), "null").when(is_text, normalize.category(raw)).otherwise("content"))
    return out.withColumn("analytical", F.when(F.col("category") == "content", F.when(is_text, value).otherwise(raw)))


def described(lvt: DataFrame, unicode: bool = True) -> DataFrame:
    """Add category, analytical, length, and the technical family of each distinct value."""
    return typed(normalised(lvt, unicode))


def typed(values: DataFrame) -> DataFrame:
    """Add length and technical family to values with category and analytical."""
    is_text = F.col("native_type") == "string"
    out = values.withColumn("length", F.when(is_text, F.length("analytical").cast("long")))
    family = F.when(is_text, detectors.family(F.col("analytical"))).otherwise(F.col("native_type"))
    return out.withColumn("family", F.when(F.col("category") == "content", family))


def analysed(df: DataFrame) -> DataFrame:
    """One row per field, category and analytical value: cnt, raws (spellings), trimmed and collapsed (occurrences that
    each stage changes), length and family. The table is read once, and detectors see each analytical value once."""
    raw, text, odd = F.col("raw"), F.col("native_type") == "string", F.col("_odd")
    step = value_table(df).withColumn("_odd", raw.rlike(normalize.ODD))  # other values have nothing to trim or collapse
    step = normalised(step, odd=odd).withColumn("_trim", F.when(text & odd, normalize.trim(raw)).otherwise(raw))
    changed = lambda c: F.coalesce(F.sum(F.when((F.col("category") == "content") & text & odd & c, F.col("cnt"))), F.lit(0)).cast("long")
    grouped = step.groupBy("position", "category", "analytical").agg(  # as in the value table, names are looked up after
        F.sum("cnt").cast("long").alias("cnt"), F.count("*").alias("raws"), changed(raw != F.col("_trim")).alias("trimmed"),
        changed(F.col("_trim") != normalize.collapse(F.col("_trim"))).alias("collapsed"),
    ).select(*placed(df, df.columns), "category", "analytical", "cnt", "raws", "trimmed", "collapsed")
    return typed(grouped)


def technical_type(n: Column, integer: Column, number: Column, date: Column, boolean: Column, text: Column, share: float = 0.95) -> Column:
    """integer, number, date, boolean, text, mixed or empty, by shares of the values."""
    return (
        F.when(n == 0, "empty")
        .when(integer >= share * n, "integer")
        .when(integer + number >= share * n, "number")
        .when(date >= share * n, "date")
        .when(boolean >= share * n, "boolean")
        .when(text >= share * n, "text")
        .otherwise("mixed")
    )


def profile(df: DataFrame) -> DataFrame:
    """One row per field: presence, missing components, distinct values, lengths, type and top value."""
    return profiled(analysed(df))


def profiled(values: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """The profile from the values of ``analysed``; with their ``quality.kinds`` as ``seen``, the sums are made over those."""
    cnt, cat = F.col("cnt"), F.col("category")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, cnt)), F.lit(0)).cast("long")
    shown = ("integer", "number", "date", "boolean")
    content = cat == "content"
    top = F.min(F.when(content, F.struct((-cnt).alias("n"), F.col("analytical").alias("v")))).alias("_top")
    sums = (
        F.sum("cnt").cast("long").alias("positions"),
        total(content).alias("present"),
        *[total(cat == c).alias(f"n_{c}") for c in ("null", "empty", "blank", "marker")],
        F.coalesce(F.sum(F.when(content, F.col("raws"))), F.lit(0)).cast("long").alias("distinct_raw"),
        (F.count("analytical") if seen is None else F.coalesce(F.sum("values"), F.lit(0)).cast("long")).alias("distinct_values"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.round(F.sum(F.when(content, F.col("length") * cnt)) / F.sum(F.when(content, cnt)), 6).alias("mean_length"),
        *[total(F.col("family") == f).alias(f"as_{f}") for f in shown],
    )
    per = lambda d: d.groupBy("field", "position", "native_type")
    rows = per(values).agg(*sums, top) if seen is None else per(seen).agg(*sums).join(values.groupBy("field").agg(top), "field")
    text = F.col("present") - sum((F.col(f"as_{f}") for f in shown), F.lit(0))
    kind = technical_type(F.col("present"), *[F.col(f"as_{f}") for f in shown], text)
    return rows.select(*[c for c in rows.columns if c != "_top"], kind.alias("technical_type"), F.col("_top.v").alias("top_value"), (-F.col("_top.n")).alias("top_count"), (F.col("positions") - F.col("present")).alias("missing"))


def frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """value, native_type, cnt by count down, then value; all of them, or the first ``top``."""
    lvt = described(value_table(df.select(column)))
    out = lvt.where("category = 'content'").groupBy("native_type", F.col("analytical").alias("value")).agg(F.sum("cnt").cast("long").alias("cnt"))
    return out.orderBy(F.desc("cnt"), "value", "native_type").limit(top) if top else out


def ends(df: DataFrame, column: str, record: str) -> DataFrame:
    """First and last value with their record numbers."""
    c = F.col(column)
    return df.where(c.isNotNull()).agg(F.min_by(c, record).alias("first_value"), F.min(record).alias("first_record"), F.max_by(c, record).alias("last_value"), F.max(record).alias("last_record"))


def lengths(df: DataFrame, column: str) -> DataFrame:
    """How many content values have each length."""
    return described(value_table(df.select(column))).where("category = 'content'").groupBy("length").agg(F.sum("cnt").cast("long").alias("cnt"))


def length_summary(df: DataFrame, column: str) -> DataFrame:
    by = lengths(df, column)
    return by.agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"), F.round(F.sum(F.col("length") * F.col("cnt")) / F.sum("cnt"), 6).alias("mean_length"), F.percentile("length", 0.5, F.col("cnt")).alias("median_length"))


def bottom_k(df: DataFrame, column: str, k: int, seed: str = "42") -> DataFrame:
    """The k distinct values of smallest hash with their exact counts: a uniform sample of values."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("cnt"))
    return out.withColumn("priority", F.md5(F.concat(F.lit(seed + "|"), F.col("value")))).orderBy("priority", "value").limit(k)


def distinct_estimate(df: DataFrame, column: str, k: int = 256, seed: str = "42") -> DataFrame:
    """Distinct values from the k smallest hashes, (k - 1) / largest; exact when there are fewer than k."""
    kept = df.where(F.col(column).isNotNull()).select(F.md5(F.concat(F.lit(seed + "|"), F.col(column).cast("string"))).alias("h")).distinct().orderBy("h").limit(k)
    share = F.conv(F.substring(F.max("h"), 1, 12), 16, 10).cast("double") / float(1 << 48)
    n = F.count("*")
    return kept.agg(n.alias("kept"), F.when(n < k, n.cast("double")).otherwise(F.round((k - 1) / share, 3)).alias("estimate"), F.when(n < k, 0.0).otherwise(F.round(1 / F.sqrt(F.lit(k - 2.0)), 6)).alias("relative_error"))


def by_length(df: DataFrame, column: str, per: int, seed: str = "42") -> DataFrame:
    """Up to ``per`` distinct values of each length, of smallest hash."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt")).withColumn("length", F.length("value").cast("long"))
    order = Window.partitionBy("length").orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col("value"))), "value")
    return values.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per)


def stages(df: DataFrame, column: str) -> DataFrame:
    """For each normalisation stage: distinct values after it and occurrences that it changed."""
    lvt = value_table(df.select(column)).where("raw is not null")
    lvt = lvt.where(normalize.category(F.col("raw")) == "content")
    step = lvt.withColumn("s0", F.col("raw"))
    for i, f in enumerate((normalize.nfc, normalize.trim, normalize.collapse, normalize.casefold, normalize.strip_accents), 1):
        step = step.withColumn(f"s{i}", f(F.col(f"s{i - 1}")))
    parts = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(i).alias("place"), F.col(f"s{i}").alias("value"), (F.col(f"s{i}") != F.col(f"s{max(i - 1, 0)}")).alias("changed")) for i, n in enumerate(normalize.STAGES)])
    long = step.select("cnt", F.explode(parts).alias("x")).select("cnt", "x.*")
    return long.groupBy("stage", "place").agg(F.count_distinct("value").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("cnt"))), F.lit(0)).cast("long").alias("changed"))


def variant_groups(df: DataFrame, column: str) -> DataFrame:
    """Comparison keys with two or more spellings: spellings, occurrences, most frequent spelling."""
    lvt = value_table(df.select(column)).where("raw is not null")
    lvt = lvt.where(normalize.category(F.col("raw")) == "content").withColumn("key", normalize.comparison_key(F.col("raw")))
    best = F.min(F.struct((-F.col("cnt")).alias("n"), F.col("raw").alias("raw"))).getField("raw")
    return lvt.groupBy("key").agg(F.count("*").alias("spellings"), F.sum("cnt").cast("long").alias("occurrences"), best.alias("most_frequent")).where("spellings >= 2")


def flags(df: DataFrame, column: str, which: str = "characteristics") -> DataFrame:
    """Occurrences and distinct values with each flag."""
    lvt = value_table(df.select(column)).where("raw is not null")
    named = getattr(normalize, which)(F.col("raw"))
    long = lvt.select("cnt", F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), v.alias("on")) for k, v in named.items()])).alias("x")).select("cnt", "x.*")
    on = F.col("on")
    return long.groupBy("flag").agg(F.coalesce(F.sum(F.when(on, F.col("cnt"))), F.lit(0)).cast("long").alias("occurrences"), F.count_if(on).alias("distinct_values"))


def characters(df: DataFrame, column: str) -> DataFrame:
    """Every character: occurrences, and values (occurrences of them) that hold it."""
    lvt = value_table(df.select(column)).where("raw <> ''")
    chars = lvt.select("raw", "cnt", F.explode(F.split("raw", "")).alias("char")).where("char <> ''")
    per = chars.groupBy("raw", "cnt", "char").agg(F.count("*").alias("n"))
    return per.groupBy("char").agg(F.sum(F.col("n") * F.col("cnt")).cast("long").alias("occurrences"), F.sum("cnt").cast("long").alias("in_values"))


def masks(df: DataFrame, column: str, least: int = 5) -> DataFrame:
    """Masked forms and their occurrences; forms of fewer than ``least`` are summed as 'other'."""
    forms = value_table(df.select(column)).where("raw is not null").groupBy(normalize.mask(F.col("raw")).alias("form")).agg(F.sum("cnt").alias("cnt"))
    return forms.groupBy(F.when(F.col("cnt") >= least, F.col("form")).otherwise("other").alias("form")).agg(F.sum("cnt").cast("long").alias("cnt"))


def shapes(df: DataFrame, column: str) -> DataFrame:
    return value_table(df.select(column)).where("raw is not null").groupBy(normalize.shape(F.col("raw")).alias("shape")).agg(F.sum("cnt").cast("long").alias("cnt"), F.count("*").alias("distinct_values"))


def long_texts(df: DataFrame, column: str, longer_than: int = 1000, preview: int = 40) -> DataFrame:
    """Digest, preview and length of texts over a length, with how often each occurs."""
    text = df.where(F.length(column) > longer_than)
    return text.groupBy(F.md5(F.col(column)).alias("digest")).agg(F.count("*").alias("cnt"), F.first(F.substring(column, 1, preview)).alias("preview"), F.first(F.length(column)).cast("long").alias("length"))


def cases(df: DataFrame, column: str, record: str, per: int = 5) -> DataFrame:
    """First examples of each kind of stray white space."""
    c = F.col(column)
    kinds = {"leading": c.rlike(f"^[{normalize.SPACE}]"), "trailing": c.rlike(f"[{normalize.SPACE}]$"), "repeated": c.rlike(f"[{normalize.SPACE}][{normalize.SPACE}]")}
    rows = df.where(c.isNotNull()).select(F.col(record).alias("record"), c.alias("value"), F.explode(F.array(*[F.when(v, F.lit(k)) for k, v in kinds.items()])).alias("kind")).where("kind is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("record"))).where(F.col("place") <= per).select("kind", "record", "value")


def text_profile(df: DataFrame, column: str) -> DataFrame:
    """Texts by power-of-two bucket of words: texts, words, lines, multi-line texts, digits."""
    t = F.col(column)
    words = F.regexp_count(t, F.lit(r"\S+")).cast("long")
    lines = (F.regexp_count(t, F.lit("\n")) + 1).cast("long")
    digits = F.regexp_count(t, F.lit("[0-9]")).cast("long")
    rows = df.where(t.isNotNull()).select(words.alias("w"), lines.alias("l"), digits.alias("d"))
    bucket = F.when(F.col("w") == 0, 0).otherwise(F.length(F.bin("w"))).cast("long")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("texts"), F.sum("w").alias("words"), F.sum("l").alias("lines"), F.count_if(F.col("l") > 1).alias("multi_line"), F.sum("d").alias("digits"))


def character_families(df: DataFrame, column: str) -> DataFrame:
    """family (a general category and its group), occurrences, characters: the character map by what the characters are.

    Groups are letter, mark, number, punctuation, symbol, separator, other and, apart from symbols, emoji. Only distinct characters are looked at.
    """
    return characters(df, column).groupBy(normalize.character_family(F.col("char")).alias("family")).agg(F.sum("occurrences").cast("long").alias("occurrences"), F.count("*").alias("characters"))


def derived_lengths(df: DataFrame, column: str) -> DataFrame:
    """quarter (0 to 4), length: quartiles of the lengths of content values by nearest rank, over counted lengths."""
    by = lengths(df, column)  # a row for each length
    w = Window.orderBy("length")
    ranked = by.withColumn("upto", F.sum("cnt").over(w)).withColumn("all", F.sum("cnt").over(Window.partitionBy()))
    at = lambda q: F.greatest(F.ceil(F.col("all") * q / 4), F.lit(1))
    cells = F.array(*[F.struct(F.lit(q).alias("quarter"), F.when((F.col("upto") >= at(q)) & (F.col("upto") - F.col("cnt") < at(q)), F.col("length")).alias("length")) for q in range(5)])
    return ranked.select(F.explode(cells).alias("x")).where("x.length is not null").select(F.col("x.quarter").cast("long").alias("quarter"), "x.length")


def frequency_tail(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """One row: distinct values, their occurrences, how many occur once, and the shares of the most frequent value and of the ``top`` most frequent."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "v").limit(top).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("first"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    whole = counts.agg(F.count("*").alias("distinct_values"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("occurrences"), F.count_if(F.col("n") == 1).alias("once"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("occurrences")), F.lit(0.0)), 6)
    return whole.join(F.broadcast(first)).select("distinct_values", "occurrences", "once", share("most").alias("dominant_share"), share("first").alias("top_share"))


def temporal_kinds(df: DataFrame, column: str) -> DataFrame:
    """kind, cnt, distinct_values, first, last (instants in microseconds, see ``detectors.instant``): texts that are dates, by kind; ambiguous and invalid ones are kinds of their own, without instants."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n"))
    read = counts.select("n", detectors.let(detectors.date(F.col("v")), lambda d: F.struct(d["state"].alias("state"), d["format"].alias("format"))).alias("d"), detectors.instant(F.col("v")).alias("i")).where("d.state is not null")
    kind = F.when(F.col("d.state") != "matched", F.col("d.state")).when(F.col("d.format").isin("time", "datetime_naive", "datetime_aware"), F.col("d.format")).otherwise("date")
    return read.groupBy(kind.alias("kind")).agg(F.sum("n").cast("long").alias("cnt"), F.count("*").alias("distinct_values"), F.min("i").alias("first"), F.max("i").alias("last"))
