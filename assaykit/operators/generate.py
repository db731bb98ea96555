"""Synthetic tables, rules with three truth values, and anomalies with a journal.

Every value is a function of seed, table, column and row number through a hash, so any
partition of the rows gives the same table and a lost task is computed again alike.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import normalize
from assaykit.operators.ranges import position


def draw(seed: str, table: str, column: str, row: Column, stream: str = "value") -> Column:
    """A uniform number in [0, 1) for this cell and stream; 48 bits of MD5, the same on any engine with it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(table), F.lit(column), F.lit(stream), row.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def pick(u: Column, values: list, weights: list[float] | None = None) -> Column:
    """One of the values by weight."""
    weights = weights or [1.0] * len(values)
    total, at, out = sum(weights), 0.0, None
    for v, w in zip(values, weights):
        at += w / total
        out = F.when(u < at, F.lit(v)) if out is None else out.when(u < at, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def normal(u: Column, v: Column) -> Column:
    """Box-Muller from two uniforms."""
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def phi(x: float) -> float:
    """The normal distribution."""
    return 0.5 * math.erfc(-x / math.sqrt(2))


def inverse_normal(p: Column) -> Column:
    """The normal deviate of a probability, to about 1e-3, from a table of the distribution and straight lines between."""
    xs = [k / 8 for k in range(-48, 49)]
    ps = [phi(x) for x in xs]
    out = F.when(p <= ps[0], F.lit(xs[0]))
    for a, b, x, y in zip(ps, ps[1:], xs, xs[1:]):
        out = out.when(p <= b, F.lit(x) + (p - a) * ((y - x) / (b - a)))
    return out.otherwise(F.lit(xs[-1]))


def catalog_row(rows: list[dict], u: Column, where: dict[str, str], weight: str | None = None) -> Column:
    """A row of a catalogue (a short list) by weight among those that agree with the columns named in ``where``, or null.

    ``where`` gives for a field of the catalogue the column of the row that it must equal.
    """
    fits = lambda r: functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.lit(r[f])) for f, c in where.items()], F.lit(True))
    names = list(rows[0])
    all_rows = F.array(*[F.struct(F.when(fits(r), F.lit(float(r[weight]) if weight else 1.0)).otherwise(F.lit(0.0)).alias("_w"), *[F.lit(r[n]).alias(n) for n in names]) for r in rows])
    total = F.aggregate(all_rows, F.lit(0.0), lambda a, r: a + r["_w"])
    start = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("int").alias("k"), F.lit(0).alias("i"))

    def step(a: Column, r: Column) -> Column:
        at = a["at"] + r["_w"]
        return F.struct(at.alias("at"), F.when(a["k"].isNull() & (r["_w"] > 0) & (u * total < at), a["i"]).otherwise(a["k"]).alias("k"), (a["i"] + 1).alias("i"))

    return F.get(all_rows, F.aggregate(all_rows, start, step)["k"])


def value(spec: dict, seed: str, table: str, name: str, row: Column) -> Column:
    """The column of one field definition, with what depends on other columns of the row applied to it."""
    u = draw(seed, table, name, row)
    if spec.get("by_case"):
        # another definition by the value of an earlier column
        source, cases = spec["by_case"]["from"], spec["by_case"]["cases"]
        rest = {k: v for k, v in spec.items() if k != "by_case"}
        out = None
        for case, more in cases.items():
            own = value(rest | more, seed, table, name, row)
            out = F.when(F.col(source) == case, own) if out is None else out.when(F.col(source) == case, own)
        return out.otherwise(value(rest, seed, table, name, row))
    c = plain_value(spec, seed, table, name, row)
    if spec.get("after"):
        # no date before that of an earlier column: one that is too early is drawn again between the two ends
        first = F.col(spec["after"])
        span = F.datediff(F.lit(spec["end"]).cast("date"), first) + 1
        c = F.when(first.isNull() | (c >= first), c).otherwise(F.date_add(first, F.floor(u * F.greatest(span, F.lit(1))).cast("int")))
    if spec.get("by_month"):
        # twelve factors by the month of a date column, and a yearly rise from a first year on
        day = F.col(spec["by_month"]["from"])
        factor = F.element_at(F.array(*[F.lit(float(x)) for x in spec["by_month"].get("factors", [1.0] * 12)]), F.month(day))
        rise = F.pow(F.lit(1 + spec["by_month"].get("inflation", 0.0)), F.year(day) - spec["by_month"].get("base_year", 2000))
        c = F.when(day.isNull(), c).otherwise(F.round(c * factor * rise, spec.get("scale", 2)))
    if spec.get("by_value"):
        factors = spec["by_value"]["factors"]
        factor = F.coalesce(F.element_at(F.create_map(*[x for k, f in factors.items() for x in (F.lit(k), F.lit(float(f)))]), F.col(spec["by_value"]["from"])), F.lit(1.0))
        c = F.round(c * factor, spec.get("scale", 2))
    if spec.get("round_to"):
        c = F.round(c / spec["round_to"]) * spec["round_to"]
    return c


def plain_value(spec: dict, seed: str, table: str, name: str, row: Column) -> Column:
    """The column of one field definition."""
    u, v = draw(seed, table, name, row), draw(seed, table, name, row, "second")
    kind = spec["kind"]
    span = lambda lo, hi: lo + u * (hi - lo)
    if kind == "constant":
        return F.lit(spec["value"])
    if kind == "sequence":
        return (row * spec.get("step", 1) + spec.get("start", 1)).cast("long")
    if kind == "choice":
        return pick(u, spec["values"], spec.get("weights"))
    if kind == "zipf":
        return pick(u, spec["values"], [1 / (i + 1) ** spec.get("exponent", 1.0) for i in range(len(spec["values"]))])
    if kind == "integer":
        return F.floor(span(spec["min"], spec["max"] + 1)).cast("long")
    if kind == "decimal":
        return F.round(span(spec["min"], spec["max"]), spec.get("scale", 2))
    if kind == "lognormal":
        # the normal law between its bounds, by the inverse of its distribution
        low, high = (phi((math.log(spec[k]) - spec["mu"]) / spec["sigma"]) if spec.get(k) else float(k == "max") for k in ("min", "max"))
        return F.round(F.exp(F.lit(spec["mu"]) + spec["sigma"] * inverse_normal(low + u * (high - low))), 2)
    if kind == "pareto":
        share = 1 - (spec["min"] / spec["max"]) ** spec["alpha"] if spec.get("max") else 1.0
        return F.round(spec["min"] / F.pow(1 - u * share, F.lit(1 / spec["alpha"])), 2)
    if kind == "catalog":
        return catalog_row(spec["rows"], u, spec.get("where", {}), spec.get("weight"))[spec["field"]]
    if kind == "bimodal":
        return F.round(F.when(v < spec.get("share", 0.5), F.lit(spec["a"])).otherwise(F.lit(spec["b"])) + spec["sigma"] * normal(u, draw(seed, table, name, row, "third")), 2)
    if kind == "boolean":
        return u < spec.get("rate", 0.5)
    if kind == "date":
        return F.date_add(F.to_date(F.lit(spec["start"])), F.floor(u * (F.datediff(F.to_date(F.lit(spec["end"])), F.to_date(F.lit(spec["start"]))) + 1)).cast("int"))
    if kind == "datetime":
        return F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(spec["start"]))) + F.floor(u * spec["seconds"]).cast("long"))
    if kind == "text":
        template, out = spec["template"].split("{n}"), []
        digits = F.lpad(F.floor(u * 10 ** spec.get("digits", 6)).cast("long").cast("string"), spec.get("digits", 6), "0")
        for i, part in enumerate(template):
            out += [F.lit(part)] + ([digits] if i < len(template) - 1 else [])
        return F.concat(*out)
    if kind == "relative_date":
        return F.date_add(F.col(spec["field"]), F.floor(span(spec["min"], spec["max"] + 1)).cast("int"))
    if kind == "conditional":
        return F.when(F.expr(spec["when"]), value(spec["then"], seed, table, name, row)).otherwise(value(spec["else"], seed, table, name, row))
    if kind == "reference":
        return (F.floor(u * spec["rows"]) * spec.get("step", 1) + spec.get("start", 1)).cast("long")
    raise ValueError(f"unknown kind {kind}")


def ordered_fields(fields: dict[str, dict]) -> list[str]:
    """Field names so that each comes after those it reads; a circle raises."""
    reads = {n: {x for x in [spec.get("after"), spec.get("field") if spec["kind"] == "relative_date" else None, *(spec.get(k, {}).get("from") for k in ("by_case", "by_month", "by_value")), *spec.get("where", {}).values(), *spec.get("reads", [])] if x} for n, spec in fields.items()}
    out: list[str] = []
    while len(out) < len(fields):
        free = [n for n in fields if n not in out and reads[n] <= set(out)]
        if not free:
            raise ValueError(f"fields read each other: {sorted(set(fields) - set(out))}")
        out.append(free[0])
    return out


def table(spark: SparkSession, name: str, rows: int, fields: dict[str, dict], seed: str = "42", cohorts: list[dict] | None = None) -> DataFrame:
    """A table by field definitions. Fields are made in an order in which those they read come first.

    ``missing`` is a rate of nulls, or {"from": column, "rates": {value: rate}, "default": rate}. ``cohorts`` are
    {id, weight, values, formats}: each row is in one, whose values replace the field's (formats map one value to
    another); a field with ``cohort`` has values in that cohort only.
    """
    df = spark.range(rows).withColumnRenamed("id", "_row")
    row = F.col("_row")
    if cohorts:
        df = df.withColumn("_cohort", pick(draw(seed, name, "cohort", row, "selection"), [c["id"] for c in cohorts], [c["weight"] for c in cohorts]))
    for field in ordered_fields(fields):
        spec = fields[field]
        c = value(spec, seed, name, field, row)
        for cohort in cohorts or []:
            on = (F.col("_cohort") == cohort["id"]) & c.isNotNull()
            if field in cohort.get("values", {}):
                c = F.when(on, F.lit(cohort["values"][field])).otherwise(c)
            for old, new in cohort.get("formats", {}).get(field, {}).items():
                c = F.when(on & (c == old), F.lit(new)).otherwise(c)
        if spec.get("cohort"):
            c = F.when(F.col("_cohort") == spec["cohort"], c)
        if missing := spec.get("missing"):
            rate = F.lit(missing) if not isinstance(missing, dict) else F.coalesce(F.element_at(F.create_map(*[x for k, r in missing["rates"].items() for x in (F.lit(k), F.lit(float(r)))]), F.col(missing["from"])), F.lit(float(missing.get("default", 0.0))))
            c = F.when(draw(seed, name, field, row, "missing") >= rate, c)
        df = df.withColumn(field, c)
    return df.select(*(["_cohort"] if cohorts else []), *fields)


# Rules. A comparison with an empty or unreadable cell is unknown, which is SQL's null.


def known(name: str) -> Column:
    return F.when(F.trim(F.col(name).cast("string")) != "", F.col(name))


def copies_name(keys: str | list[str]) -> str:
    """The column that ``evaluate`` adds for a unique rule over these keys."""
    return "_copies_" + "_".join([keys] if isinstance(keys, str) else keys)


def unique_keys(spec: dict) -> list[list[str]]:
    """The keys of all unique rules inside a rule."""
    (name, args), = spec.items()
    if name == "unique":
        return [[args] if isinstance(args, str) else list(args)]
    parts = args if name in ("and", "or", "implies") else [args] if name == "not" else []
    return [k for p in parts for k in unique_keys(p)]


def rule(spec: dict) -> Column:
    """A boolean column (null: unknown) from a rule such as {"implies": [rule, rule]} or {"gte": ["field", 3]}.

    A unique rule reads the column that ``with_copies`` adds for its keys.
    """
    (name, args), = spec.items()
    compare = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
    side = lambda x: known(x["field"]) if isinstance(x, dict) else F.lit(x)
    if name in compare:
        return compare[name](known(args[0]), side(args[1]))
    if name == "between":
        return known(args[0]).between(F.lit(args[1]), F.lit(args[2]))
    if name == "in":
        return known(args[0]).isin(args[1])
    if name == "not_in":
        return ~known(args[0]).isin(args[1])
    if name == "regex":
        return known(args[0]).cast("string").rlike(f"^(?:{args[1]})$")
    if name == "empty":
        return known(args).isNull()
    if name == "not_empty":
        return known(args).isNotNull()
    if name in ("and", "or"):
        return functools.reduce(operator.and_ if name == "and" else operator.or_, map(rule, args))
    if name == "not":
        return ~rule(args)
    if name == "implies":
        cond, then = map(rule, args)
        return F.when(~cond, True).when(then, True).otherwise(F.when(cond.isNull(), F.lit(None)).otherwise(then))
    if name == "unique":
        keys = [args] if isinstance(args, str) else args
        return F.when(functools.reduce(operator.and_, [known(k).isNotNull() for k in keys]), F.col(copies_name(keys)).isNull())
    raise ValueError(f"unknown rule {name}")


def with_copies(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Add a column for each set of unique keys: null for keys that occur once. Repeated keys are counted, then joined, so a hot key is no window."""
    for keys in {copies_name(k): k for r in rules.values() for k in unique_keys(r)}.values():
        again = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(copies_name(keys))).where(F.col(copies_name(keys)) > 1)
        df = df.join(again, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return df


def evaluate(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """rule, holds, broken, unknown."""
    df = with_copies(df, rules)
    flat = df.select(*[rule(r).alias(f"r{i}") for i, r in enumerate(rules.values())])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("v")) for i, n in enumerate(rules)])
    return flat.select(F.explode(cells).alias("x")).groupBy(F.col("x.rule").alias("rule")).agg(F.count_if("x.v").alias("holds"), F.count_if(~F.col("x.v")).alias("broken"), F.count_if(F.col("x.v").isNull()).alias("unknown"))


# Anomalies.

_at = lambda c, u: (F.floor(u * F.length(c)) + 1).cast("int")
_sub = lambda c, p, r: F.regexp_replace(c, p, r)
TRANSFORMS = {
    "upper": lambda c, u: F.upper(c), "lower": lambda c, u: F.lower(c), "title_case": lambda c, u: F.initcap(c),
    "strip": lambda c, u: F.trim(c), "double_space": lambda c, u: F.replace(c, F.lit(" "), F.lit("  ")), "trailing_space": lambda c, u: F.concat(c, F.lit(" ")), "leading_space": lambda c, u: F.concat(F.lit(" "), c), "leading_tab": lambda c, u: F.concat(F.lit("\t"), c), "surrounding_space": lambda c, u: F.concat(F.lit(" "), c, F.lit(" ")),
    "insert_space": lambda c, u: F.overlay(c, F.lit(" "), _at(c, u), F.lit(0)), "insert_double_space": lambda c, u: F.overlay(c, F.lit("  "), _at(c, u), F.lit(0)), "insert_non_breaking_space": lambda c, u: F.overlay(c, F.lit("\xa0"), _at(c, u), F.lit(0)), "insert_zero_width": lambda c, u: F.overlay(c, F.lit("​"), _at(c, u), F.lit(0)), "insert_replacement_char": lambda c, u: F.overlay(c, F.lit("�"), _at(c, u), F.lit(0)),
    "drop_char": lambda c, u: F.overlay(c, F.lit(""), _at(c, u), F.lit(1)), "double_char": lambda c, u: F.overlay(c, F.substring(c, _at(c, u), F.lit(1)), _at(c, u), F.lit(0)), "replace_char": lambda c, u: F.overlay(c, F.lit("x"), _at(c, u), F.lit(1)), "suffix_x": lambda c, u: F.concat(c, F.lit("x")), "leading_apostrophe": lambda c, u: F.concat(F.lit("'"), c), "double_hyphen": lambda c, u: F.replace(c, F.lit("-"), F.lit("--")),
    "swap_first_two": lambda c, u: _sub(c, "^(.)(.)", "$2$1"), "transpose": lambda c, u: F.concat(F.substring(c, F.lit(1), _at(c, u) - 1), F.reverse(F.substring(c, _at(c, u), F.lit(2))), F.substring(c, _at(c, u) + 2, F.length(c))), "similar_char": lambda c, u: F.translate(c, "Ool1", "00Il"),
    "negate": lambda c, u: _sub(F.concat(F.lit("-"), c), "^--", ""), "times_100": lambda c, u: (c.try_cast("double") * 100).cast("string"), "drop_digit": lambda c, u: _sub(c, "[0-9]$", ""), "decimal_comma": lambda c, u: F.replace(c, F.lit("."), F.lit(",")), "decimal_dot": lambda c, u: F.replace(c, F.lit(","), F.lit(".")), "thousands_space": lambda c, u: _sub(c, r"(?<=[0-9])(?=([0-9]{3})+(\.|$))", " "), "thousands_comma": lambda c, u: _sub(c, r"(?<=[0-9])(?=([0-9]{3})+(\.|$))", ","),
    "currency_suffix": lambda c, u: F.concat(c, F.lit(" $")), "currency_prefix": lambda c, u: F.concat(F.lit("$"), c), "currency_fr": lambda c, u: F.concat(F.replace(c, F.lit("."), F.lit(",")), F.lit(" $")), "currency_code": lambda c, u: F.concat(c, F.lit(" CAD")), "float_precision_extreme": lambda c, u: F.concat(c, F.lit("0000000001")), "drop_leading_zeros": lambda c, u: _sub(c, "^0+", ""),
    "date_slash": lambda c, u: F.replace(c, F.lit("-"), F.lit("/")), "date_dmy": lambda c, u: _sub(c, "^([0-9]{4})-([0-9]{2})-([0-9]{2})", "$3/$2/$1"), "date_iso": lambda c, u: _sub(c, "^([0-9]{2})/([0-9]{2})/([0-9]{4})", "$3-$2-$1"), "date_mdy_iso": lambda c, u: _sub(c, "^([0-9]{4})-([0-9]{2})-([0-9]{2})", "$2-$3-$1"), "date_impossible": lambda c, u: _sub(c, "-[0-9]{2}-[0-9]{2}", "-02-30"), "date_swap_month_day": lambda c, u: _sub(c, "^([0-9]{4})-([0-9]{2})-([0-9]{2})", "$1-$3-$2"), "date_plus_century": lambda c, u: F.add_months(c.try_cast("date"), 1200).cast("string"), "date_minus_decade": lambda c, u: F.add_months(c.try_cast("date"), -120).cast("string"),
    "phone_spaces": lambda c, u: _sub(c, "[-.()]", " "), "phone_double_space": lambda c, u: _sub(c, "[- ]", "  "), "phone_drop_digit": lambda c, u: _sub(c, "[0-9]$", ""), "email_invalid": lambda c, u: F.replace(c, F.lit("@"), F.lit("@@")), "email_forbidden_domain": lambda c, u: _sub(c, "@.*$", "@invalid"), "postal_no_space": lambda c, u: F.replace(c, F.lit(" "), F.lit("")), "postal_invalid_syntax": lambda c, u: _sub(c, "^.", "D"),
    "long_text": lambda c, u: F.repeat(F.concat(c, F.lit(" ")), 200), "json_text": lambda c, u: F.to_json(F.struct(c.alias("value"))), "quoted_delimiters": lambda c, u: F.concat(F.lit('"'), c, F.lit('",;')), "multiline_text": lambda c, u: F.concat(c, F.lit("\n"), c), "high_cardinality_uuid": lambda c, u: _sub(F.md5(F.concat(c, u.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), "strip_accents": lambda c, u: normalize.strip_accents(c), "unicode_nfc": lambda c, u: normalize.nfc(c), "unicode_nfd": lambda c, u: normalize.guarded("nfd", c, c), "unicode_complex": lambda c, u: F.concat(c, F.lit(" é👩‍💻ﬁ")),
    "rare_category": lambda c, u: F.concat(F.lit("rare_"), F.substring(F.md5(u.cast("string")), 1, 4)),
}


def chosen(df: DataFrame, record: str, column: str | None, name: str, op: dict, seed: str) -> DataFrame:
    """The record numbers that an operation changes: ``count`` of smallest hash, or all whose hash is below ``rate``, among
    rows with a value in the column (all rows without one) where ``when`` holds."""
    rows = df.where(F.col(column).isNotNull()) if column else df
    rows = rows.where(F.expr(op["when"])) if op.get("when") else rows
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit(name), F.lit(column or ""), F.col(record).cast("string")))
    if "rate" in op:
        return rows.where(F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / float(1 << 48) < op["rate"]).select(record)
    return rows.select(record).orderBy(order, record).limit(op["count"])


def earlier(df: DataFrame, record: str, window: int, seed: str, name: str, columns: list[str]) -> DataFrame:
    """For each record, ``columns`` (as _src_...) of one of the ``window`` records before it, drawn by hash; none for the first.

    Records are numbered by ranges, and the drawn place is joined, so no task holds a look-back window.
    """
    at = position(df.select(record, *columns), record)
    back = F.floor(draw(seed, "copy", name, F.col(record)) * F.least(F.col("position"), F.lit(window))).cast("long") + 1
    wanted = at.where("position > 0").select(record, (F.col("position") - back).alias("_place"))
    return wanted.join(at.select(F.col("position").alias("_place"), F.col(record).alias("_from"), *[F.col(c).alias(f"_src_{c}") for c in columns]), "_place").drop("_place")


def inject(df: DataFrame, record: str, operations: list[dict], seed: str = "42", window: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The changed table and the journal (record, column, operation, before, after), one row per changed cell.

    An operation is {kind, column, count or rate, when} with kind set_missing, replace (value), format (transform),
    copy_column (source), swap (with: the cells of two columns change places), duplicate (the value of a row before),
    reuse_value (a value of one of ``window`` rows before) or duplicate_row (all columns but the record number from one
    of those rows). Later operations see what earlier ones left; rows are duplicated last.
    """
    out, marks = df, []
    for i, op in enumerate(sorted(operations, key=lambda op: op["kind"] == "duplicate_row")):
        column, kind = op.get("column"), op["kind"]
        on, u = F.col(f"_on{i}"), draw(seed, kind, column or "", F.col(record), str(i))
        current = out
        out = out.join(chosen(current, record, column, f"{kind}{i}", op, seed).withColumn(f"_on{i}", F.lit(True)), record, "left")
        changed: dict[str, Column] = {}
        if kind in ("duplicate", "reuse_value", "duplicate_row"):
            names = [c for c in df.columns if c != record] if kind == "duplicate_row" else [column]
            source = earlier(current, record, 1 if kind == "duplicate" else window, seed, f"{kind}{i}", names).drop("_from")
            out = out.join(source.withColumnsRenamed({f"_src_{c}": f"_src{i}_{c}" for c in names}).withColumn(f"_has{i}", F.lit(True)), record, "left")
            changed = {c: F.when(F.col(f"_has{i}"), F.col(f"_src{i}_{c}").cast("string")).otherwise(F.col(c).cast("string")) for c in names}
        elif kind == "swap":
            changed = {column: F.col(op["with"]).cast("string"), op["with"]: F.col(column).cast("string")}
        else:
            text = F.col(column).cast("string")
            new = {"set_missing": lambda: F.lit(None).cast("string"), "replace": lambda op=op: F.lit(op.get("value")).cast("string"), "format": lambda op=op, text=text, u=u: TRANSFORMS[op["transform"]](text, u), "copy_column": lambda op=op: F.col(op["source"]).cast("string")}[kind]()
            changed = {column: new}
        named = op.get("transform", kind)
        before = {c: F.col(c).cast("string") for c in changed}
        olds = {f"_old{i}_{k}": F.when(on, before[c]) for k, c in enumerate(changed)}
        out = out.withColumns(olds | {f"_new{i}_{k}": F.when(on, v) for k, v in enumerate(changed.values())})
        for k, c in enumerate(changed):
            marks.append(F.when(on, F.struct(F.lit(c).alias("column"), F.lit(named).alias("operation"), F.col(f"_old{i}_{k}").alias("before"), F.col(f"_new{i}_{k}").alias("after"))))
        # formats, swaps and fixed values make a column text; the others keep its type
        keeps = kind in ("set_missing", "duplicate", "reuse_value", "duplicate_row")
        out = out.withColumns({c: F.when(on, F.col(f"_new{i}_{k}").cast(out.schema[c].dataType if keeps else "string")).otherwise(F.col(c) if keeps else F.col(c).cast("string")) for k, c in enumerate(changed)})
    journal = out.select(F.col(record).alias("record"), F.explode(F.array_compact(F.array(*marks))).alias("x")).select("record", "x.*").where(~F.col("before").eqNullSafe(F.col("after")))
    return out.select(*df.columns), journal


def truth(clean: DataFrame, altered: DataFrame, record: str) -> DataFrame:
    """Cells that differ between two tables of the same rows: record, column, before, after."""
    names = [c for c in clean.columns if c != record]
    side = lambda d: d.select(F.col(record).alias("record"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in names])).alias("x")).select("record", "x.column", "x.v")
    return side(clean).withColumnRenamed("v", "before").join(side(altered).withColumnRenamed("v", "after"), ["record", "column"]).where(~F.col("before").eqNullSafe(F.col("after")))


def split(df: DataFrame, group: str, shares: dict[str, float], seed: str = "42") -> DataFrame:
    """A split that keeps all rows of a group together."""
    return df.withColumn("split", pick(draw(seed, "split", group, F.col(group)), list(shares), list(shares.values())))
