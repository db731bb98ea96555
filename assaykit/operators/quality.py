"""Interpretation of profiles: classification, observations, findings, signals and the relations worth a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import detectors, names, normalize
from assaykit.operators.ranges import cut
from assaykit.operators.rows import duplicate_stats
from assaykit.operators.values import analysed, profile, technical_type, value_table

CONTACT = ("email", "phone", "postal_code", "url", "ip_address", "uuid")
MEASURES = ("currency", "percentage", "quantity")
FAMILY = {
    "email": "contact", "phone": "contact", "postal_code": "geographic", "url": "web_network", "ip_address": "web_network", "uuid": "web_network", "date": "temporal", "datetime": "temporal", "time": "temporal",
    "integer": "numeric", "number": "numeric", "currency": "numeric", "percentage": "numeric", "quantity": "numeric", "boolean": "categorical", "enum": "categorical", "constant": "categorical",
}
#: Code: class, unit. Those that are recommended are declared, and computed from constraints only.
FINDINGS = {
    "temporal.invalid_calendar": "error", "semantic.invalid": "error", "type.outside_family": "error", "temporal.ambiguous_date": "issue", "number.ambiguous": "issue", "categorical.case_variants": "issue",
    "pattern.minority": "issue", "length.minority": "issue", "type.mixed": "issue", "identifier.repetition": "issue", "text.surrounding_whitespace": "issue", "text.repeated_whitespace": "issue",
    "presence.empty_column": "information", "values.constant_column": "information", "categorical.rare": "issue", "pattern.rare": "issue", "format.rare": "issue", "text.confusable_letters": "issue", "text.formula_risk": "issue",
    "text.lost_leading_zeros": "issue", "text.atypical_length": "issue", "temporal.two_digit_year": "issue", "temporal.excel_serial": "issue", "temporal.rounded_midnight": "issue",
    "constraint.required_missing": "error", "constraint.pattern_violated": "error", "constraint.domain_violated": "error",
}


def text_type(median: float | None) -> str:
    """Type of text by median length."""
    if median is None:
        return "text"
    bounds = ((5, "text_very_short"), (20, "text_short"), (50, "text_medium"), (255, "text_long"))
    return next((name for most, name in bounds if median <= most), "text_very_long")


def measured(values: DataFrame) -> DataFrame:
    """Per field: what classification and findings need, from the distinct values of ``analysed``."""
    return measured_kinds(kinds(values))


def kinds(values: DataFrame) -> DataFrame:
    """The distinct values counted by what is seen of them: category, family, length, and the states that detectors tell.

    Kinds are few, so each value costs one small update, and the many sums of ``measured_kinds`` are made over kinds.
    """
    shown = (F.col("native_type") == "string") & (F.col("category") == "content")
    state = {f"_{n}": detectors.told(n, F.col("analytical"), lambda r: r["state"]) for n in (*CONTACT, *MEASURES, "number")}
    # the family tells what the number detector said, and no integer has a mark of currency
    whole = F.col("family") == "integer"
    state["_number"] = F.when(whole, "matched").when(F.col("family") == "number", state["_number"])
    state["_currency"] = F.when(~whole, state["_currency"])
    day = detectors.told("date", F.col("analytical"), lambda r: F.struct(r["state"].alias("state"), r["format"].alias("format")))
    seen = values.withColumns({n: F.when(shown, s) for n, s in (state | {"_day": day}).items()})
    by = ("field", "position", "native_type", "category", "family", "length", *state, "_day")
    return seen.groupBy(*by).agg(F.count("analytical").alias("values"), *[F.sum(c).cast("long").alias(c) for c in ("cnt", "raws", "trimmed", "collapsed")])


def measured_kinds(seen: DataFrame) -> DataFrame:
    """``measured`` from ``kinds``."""
    is_text, cnt, content = F.col("native_type") == "string", F.col("cnt"), F.col("category") == "content"
    states = (*CONTACT, *MEASURES, "number")
    total = lambda c: F.coalesce(F.sum(F.when(c, cnt)), F.lit(0)).cast("long")
    aggs = [total(F.col(f"_{n}") == s).alias(f"{n}_{s}") for n in states for s in ("matched", "ambiguous", "invalid")]
    aggs += [total(F.col("_day.state") == s).alias(f"date_{s}") for s in ("matched", "ambiguous", "invalid")]
    aggs += [total((F.col("_day.state") == "matched") & (F.col("_day.format") == f)).alias(n) for f, n in (("dmy", "day_first"), ("mdy", "month_first"), ("time", "times"))]
    aggs += [total((F.col("_day.state") == "matched") & F.col("_day.format").startswith("datetime")).alias("datetimes")]
    return seen.groupBy("field", "position", "native_type").agg(
        F.sum("cnt").cast("long").alias("positions"), total(content).alias("present"), total(content & is_text).alias("strings"), *[total(F.col("category") == c).alias(f"n_{c}") for c in ("null", "empty", "blank", "marker")],
        F.coalesce(F.sum("values"), F.lit(0)).cast("long").alias("distinct_values"), F.percentile("length", 0.5, F.when(content, cnt).otherwise(0)).alias("median_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        *[total(F.col("family") == f).alias(f"as_{f}") for f in ("integer", "number", "date", "boolean", "text")], *aggs,
        F.coalesce(F.sum(F.when(is_text, F.col("trimmed"))), F.lit(0)).cast("long").alias("surrounding"), F.coalesce(F.sum(F.when(is_text, F.col("collapsed"))), F.lit(0)).cast("long").alias("repeated"),
    )


def stand_outs(values: DataFrame, seen: DataFrame) -> DataFrame:
    """field, kind, count, of, for all fields at once: variant_groups (groups of spellings, of nothing), minority_pattern
    (distinct values off a shape that 80 % have) and minority_length (strings off a length that 95 % of 20 or more have).
    ``seen`` are the ``kinds`` of the values. Keys of ASCII values need no Arrow function, so only others pass through it."""
    content = "category = 'content' and native_type = 'string'"
    text, value = values.where(content), F.col("analytical")
    key = lambda ascii, k: text.where(value.rlike(normalize.NON_ASCII) != ascii).select("field", k.alias("k"), "raws")
    both = key(True, F.lower(value)).unionByName(key(False, normalize.comparison_key(value)))
    keys = both.groupBy("field", "k").agg(F.sum("raws").alias("n")).where("n >= 2")
    variants = keys.groupBy("field").agg(F.count("*").alias("count")).select("field", F.lit("variant_groups").alias("kind"), "count", F.lit(None).cast("long").alias("of"))
    shapes = text.groupBy("field", normalize.shape(F.col("analytical")).alias("k")).agg(F.count("*").alias("n"))
    lengths = seen.where(content).groupBy("field", F.col("length").alias("k")).agg(F.sum("cnt").alias("n"))

    def rest(counts: DataFrame, kind: str, least: float, digits: int | None, values_least: int, each: bool) -> DataFrame:
        share = lambda n: n / F.col("all") if digits is None else F.round(n / F.col("all"), digits)
        whole = counts.groupBy("field").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.count("*").alias("kinds"))
        whole = whole.where((F.col("kinds") > 1) & (F.col("all") >= values_least) & (share(F.col("top")) >= least))
        few = counts.join(whole, "field").where((F.col("n") < F.col("top")) & (share(F.col("n")) <= 0.05)) if each else counts.join(whole, "field").where(F.col("n") < F.col("top"))
        return few.groupBy("field", "all").agg(F.sum("n").cast("long").alias("count")).select("field", F.lit(kind).alias("kind"), "count", F.col("all").cast("long").alias("of"))

    return variants.unionByName(rest(shapes, "minority_pattern", 0.8, 4, 1, True)).unionByName(rest(lengths, "minority_length", 0.95, None, 20, False))


CLASSES = "field string, family string, type string, hint string, role string, evidence string, alternatives string, traits string, present long, distinct_values long"


def classify(df: DataFrame, share: float = 0.95) -> DataFrame:
    """field, family, type, hint, role, evidence, alternatives, traits, present, distinct_values: a row per column.

    Types that ``share`` of the values prove compete, and the name separates them; else few distinct values make an
    enumeration, and other text goes by its median length. A name that supports an identifier gives text and whole
    numbers the role of one, unique_id if no two rows share a value and none lacks it.
    """
    return classified(measured(analysed(df)), share)


def classified(m: DataFrame, share: float = 0.95) -> DataFrame:
    """Classification from ``measured``, whose rows, one per column, come to the driver."""
    return m.sparkSession.createDataFrame([class_of(r.asDict(), share) for r in m.collect()], CLASSES)


def class_of(s: dict, share: float) -> tuple:
    n, d = s["present"], s["distinct_values"]
    told = names.hints(s["field"])
    enough = lambda k: n > 0 and k >= share * n
    technical = "empty" if not n else "integer" if enough(s["as_integer"]) else "number" if enough(s["as_integer"] + s["as_number"]) else "date" if enough(s["as_date"]) else "boolean" if enough(s["as_boolean"]) else "text" if enough(s["as_text"]) else "mixed"
    credible = [c for c in (*CONTACT, *MEASURES) if enough(s[f"{c}_matched"])]
    credible += [k for k, c in (("datetime", s["datetimes"]), ("time", s["times"]), ("date", s["date_matched"] + s["date_ambiguous"] - s["datetimes"] - s["times"])) if enough(c)]
    credible += [technical] if technical in ("integer", "number", "boolean") else []
    pairs = [(FAMILY[c], c) for c in credible]
    few = 1 < d <= 49 and n >= 10 * d
    left = names.chosen(pairs, s["field"]) if pairs else []
    if not n:
        family, kind = "other", "empty"
    elif left:
        # of what is left, the first in order: a form of its own says more than a number
        family, kind = left[0]
    elif d == 1 and n >= 2:
        family, kind = "categorical", "constant"
    elif few:
        family, kind = "categorical", "enum"
    elif technical == "mixed":
        family, kind = "other", "mixed"
    else:
        family, kind = "text", text_type(s["median_length"])
    named = next((h for h in told if h.supports and (h.family, h.type) == ("identifier", "id")), None)
    role = None
    if named and (technical == "integer" or technical == "text" and family in ("text", "categorical")) and d >= 2:
        role = "unique_id" if d == s["positions"] else "identifier"
    first = next((h for h in told if h.supports), None)
    label = lambda f, t: f"{f}/{t}" if t else f
    evidence = [f"values:{kind}"] if left else []
    evidence += [f"name:{h.strength}:{'' if h.supports else 'not '}{label(h.family, h.type)}" for h in told if h.about(family, kind) or role and h is named]
    others = [label(*p) for p in pairs if p != (family, kind)] + [label(h.family, h.type) for h in told if h.supports and not h.about(family, kind) and technical in h.technical and (h.family, h.type) not in pairs and h is not (named if role else None)]
    traits = [t for t, on in (("constant", d == 1 and n >= 2), ("high_cardinality", d > 0.5 * n and n >= 20), ("observed_unique", n >= 2 and d == s["positions"]), ("first_column", s["position"] == 0), ("fixed_length", n >= 2 and s["min_length"] is not None and s["min_length"] == s["max_length"])) if on]
    return (s["field"], family, kind, label(first.family, first.type) if first else None, role, ",".join(evidence), ",".join(others), ",".join(traits), n, d)


def findings(df: DataFrame) -> DataFrame:
    """field, code, class, count, of: what is wrong with the values of each field, for all active codes."""
    values = cut(analysed(df))  # read once for each kind of rule
    seen = cut(kinds(values))
    return found(values, seen, measured_kinds(seen))


def found(values: DataFrame, seen: DataFrame, m: DataFrame) -> DataFrame:
    """The findings from the values of ``analysed``, their ``kinds`` and ``measured``."""
    n, text = F.col("present"), F.col("native_type") == "string"
    numeric = F.col("as_integer") + F.col("as_number")
    best = F.greatest(numeric, "as_date", "as_boolean", "as_text")
    likely = lambda c: F.col(f"{c}_matched") >= F.lit(0.5) * n
    # what has not even the shape of the type that most values have is invalid too
    semantic = sum((F.when(likely(c), n - F.col(f"{c}_matched")).otherwise(0) for c in CONTACT), F.lit(0))
    dates = F.col("date_matched") + F.col("date_ambiguous")
    rules = {
        "temporal.invalid_calendar": (F.when(dates >= F.lit(0.5) * n, F.col("date_invalid")), n), "semantic.invalid": (semantic, n),
        "temporal.ambiguous_date": (F.col("date_ambiguous"), dates), "number.ambiguous": (F.col("number_ambiguous"), n),
        "type.outside_family": (F.when(text & (numeric >= 0.95 * n), n - numeric), n), "type.mixed": (F.when(text & (best < 0.95 * n), n - best), n),
        "text.surrounding_whitespace": (F.col("surrounding"), F.col("strings")), "text.repeated_whitespace": (F.col("repeated"), F.col("strings")),
        "presence.empty_column": (F.when(n == 0, F.col("positions")), F.col("positions")), "values.constant_column": (F.when((F.col("distinct_values") == 1) & (n >= 2), n), n),
    }
    out = spread_rules(m, "code", rules)
    stand = stand_outs(values, seen)
    named = F.when(F.col("kind") == "variant_groups", "categorical.case_variants").when(F.col("kind") == "minority_pattern", "pattern.minority").otherwise("length.minority")
    out = out.unionByName(stand.select("field", named.alias("code"), "count", "of"))
    ids = classified(m).where(F.col("role") == "identifier")
    again = ids.select("field", F.lit("identifier.repetition").alias("code"), (F.col("present") - F.col("distinct_values")).alias("count"), F.col("present").alias("of"))
    out = out.unionByName(again).where("count > 0")
    kind = F.element_at(F.create_map(*[F.lit(x) for p in FINDINGS.items() for x in p]), F.col("code"))
    return out.select("field", "code", kind.alias("class"), "count", "of")


def spread_rules(m: DataFrame, name: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row (field, name, count, of) for each rule whose count is above 0."""
    cells = F.array(*[F.struct(F.lit(k).alias(name), v.cast("long").alias("count"), of.cast("long").alias("of")) for k, (v, of) in rules.items()])
    return m.select("field", F.explode(cells).alias("x")).select("field", "x.*").where("count > 0")


def missing_findings(df: DataFrame) -> DataFrame:
    """field, count, of, share and the components of missing cells: null, empty, blank and marker."""
    p = profile(df).where("missing > 0")
    return p.select("field", F.col("missing").alias("count"), F.col("positions").alias("of"), F.round(F.col("missing") / F.col("positions"), 4).alias("share"), "n_null", "n_empty", "n_blank", "n_marker")


def observations(df: DataFrame, header: list[str] | None = None, excluded: int = 0) -> DataFrame:
    """field (null: of the whole table), rule, count, of: all rules. ``header`` holds the names as written in the source,
    and ``excluded`` the records that a tolerant read left out."""
    spark = df.sparkSession
    values = cut(analysed(df))
    seen = cut(kinds(values))
    m = measured_kinds(seen)
    n, numeric = F.col("present"), F.col("as_integer") + F.col("as_number")
    text = F.when(F.col("native_type") == "string", F.col("as_text")).otherwise(0)
    kind = technical_type(n, F.col("as_integer"), F.col("as_number"), F.col("as_date"), F.col("as_boolean"), text)
    best = F.greatest(numeric, "as_date", "as_boolean", text)
    inside = F.when(kind == "integer", F.col("as_integer")).when(kind == "number", numeric).when(kind == "date", F.col("as_date")).when(kind == "boolean", F.col("as_boolean"))
    rules = {
        "empty_column": (F.when(n == 0, F.col("positions")), F.col("positions")), "missing_values": (F.when(n > 0, F.col("positions") - n), F.col("positions")), "constant_column": (F.when((F.col("distinct_values") == 1) & (n >= 2), n), F.col("positions")),
        "mixed_types": (F.when(kind == "mixed", n - best), n), "type_outliers": (F.when(kind.isin("integer", "number", "date", "boolean"), n - inside), n),
        "ambiguous_dates": (F.col("date_ambiguous"), F.col("date_matched") + F.col("date_ambiguous")), "trimmed_cells": (F.col("surrounding"), F.col("strings")), "collapsed_whitespace": (F.col("repeated"), F.col("strings")),
    }
    out = spread_rules(m, "rule", rules).unionByName(stand_outs(values, seen).select("field", F.col("kind").alias("rule"), "count", "of"))
    unclear = [(x, "ambiguous_header", header.count(x), None) for x in dict.fromkeys(header or []) if not x.strip() or header.count(x) > 1]
    whole = duplicate_stats(df).select(F.lit(None).cast("string").alias("field"), F.lit("duplicate_rows").alias("rule"), F.col("extra_copies").alias("count"), F.col("total").alias("of"))
    out = out.unionByName(spark.createDataFrame(unclear, "field string, rule string, count long, of long")).unionByName(whole.where("count > 0"))
    if excluded:
        left = df.agg(F.lit(None).cast("string").alias("field"), F.lit("excluded_records").alias("rule"), F.lit(excluded).cast("long").alias("count"), (F.count("*") + excluded).alias("of"))
        out = out.unionByName(left)
    return out


def minority_lengths(df: DataFrame, column: str) -> DataFrame:
    """Values off a length that at least 95 % of 20 or more values have."""
    values = value_table(df.select(column)).where("raw <> ''").groupBy(F.length("raw").cast("long").alias("length")).agg(F.sum("cnt").cast("long").alias("cnt"))
    total = values.agg(F.sum("cnt").alias("total"), F.max_by("length", "cnt").alias("usual"), F.max("cnt").alias("most")).where("total >= 20 and most >= 0.95 * total and most < total")
    return values.join(F.broadcast(total), F.lit(True)).where("length <> usual").select("length", "cnt", "usual")


def minority_patterns(df: DataFrame, column: str) -> DataFrame:
    """Shapes held by at most 5 % of the distinct values where one holds at least 80 %."""
    values = value_table(df.select(column)).where("raw <> ''").groupBy(normalize.shape(F.col("raw")).alias("shape")).agg(F.count("*").alias("distinct_values"))
    total = values.agg(F.sum("distinct_values").alias("total"), F.max("distinct_values").alias("most")).where("most >= 0.8 * total")
    return values.join(F.broadcast(total), F.lit(True)).where("distinct_values <= 0.05 * total").select("shape", "distinct_values")


def signals(found: DataFrame) -> DataFrame:
    """Findings by class and code: fields and occurrences."""
    return found.groupBy("class", "code").agg(F.count("*").alias("fields"), F.sum("count").cast("long").alias("occurrences"))


def residuals(df: DataFrame, column: str, detector: str, record: str, top: int = 20) -> DataFrame:
    """Values that a detector leaves out or finds invalid, with count and first record."""
    c = F.col(column)
    values = df.where(c.isNotNull()).groupBy(c.alias("value")).agg(F.count("*").alias("cnt"), F.min(record).alias("first_rec"))
    state = F.coalesce(detectors.DETECTORS[detector](F.col("value"))["state"], F.lit("not_matched"))
    return values.withColumn("state", state).where("state in ('invalid', 'not_matched')").orderBy(F.desc("cnt"), "value").limit(top)


def measures(df: DataFrame, column: str) -> DataFrame:
    """Numbers with a currency or unit, by marker: how many, least, most, mean."""
    c = F.col(column)
    values = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("cnt"))
    q, m, p = detectors.quantity(F.col("v")), detectors.currency(F.col("v")), detectors.percentage(F.col("v"))
    marker = F.coalesce(F.when(q["state"] == "matched", q["value"]), F.when(m["state"] == "matched", m["value"]), F.when(p["state"] == "matched", F.lit("%")))
    amount = detectors.number_value(F.regexp_extract("v", r"([+-]?[0-9][0-9.,]*)", 1))
    rows = values.select(marker.alias("marker"), amount.alias("x"), "cnt").where("marker is not null and x is not null")
    return rows.groupBy("marker").agg(F.sum("cnt").cast("long").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.round(F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt"), 6).alias("mean"))
