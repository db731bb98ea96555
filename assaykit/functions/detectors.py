"""Semantic detectors: Column expressions that give struct(state, format, value, reason) or null.

``state`` is matched, ambiguous or invalid; null means the detector has nothing to say. Each
branch order is cheap tests first. Callers apply them to distinct analytical values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number forms, boolean words, month names, currency codes and symbols.
INTEGER = r"^[+-]?(0|[1-9][0-9]*)$"
NUMBER = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|(0|[1-9][0-9]*))([eE][+-]?[0-9]+)?$"
DOT = r"^[+-]?[1-9][0-9]{0,2}([,\x20\xa0 ][0-9]{3})+(\.[0-9]+)?$"
COMMA = r"^[+-]?([1-9][0-9]{0,2}([.\x20\xa0 ][0-9]{3})+(,[0-9]+)?|(0|[1-9][0-9]*),[0-9]+)$"
BOOLEANS = {"true": True, "yes": True, "y": True, "oui": True, "vrai": True, "false": False, "no": False, "n": False, "non": False, "faux": False}
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
    "janv": 1, "févr": 2, "fevr": 2, "avr": 4, "juil": 7, "déc": 12,
}
# ISO 4217, list one, and codes replaced since 2023 that data still hold.
CURRENCIES = tuple(
    """
    AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND
    BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF
    DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD
    HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW
    KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU
    MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR
    PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD
    SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU
    UZS VED VES VND VUV WST XAF XCD XCG XOF XPF YER ZAR ZMW ZWG ZWL
    """.split()
)
SYMBOLS = r"(?:CA\$|C\$|US\$|[$€£¥])"
ORDINALS = ("er", "re", "e", "ème", "eme", "nd", "nde", "st", "rd", "th")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, and out of the generated method of the row, which long branches would fill."""
    return F.element_at(F.transform(F.array(value), use), 1)


def result(state: str | Column, form: str | Column, value: Column | None = None, reason: str | Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(state).alias("state"), as_column(form).cast("string").alias("format"), (F.lit(None) if value is None else value).cast("string").alias("value"), as_column(reason).cast("string").alias("reason"))


def number(v: Column) -> Column:
    """Strict integers and numbers, then thousands and decimal comma; ambiguous if both readings differ (1,234)."""
    squeezed = lambda x: F.regexp_replace(x, r"[\x20\xa0 ]", "")
    as_dot = lambda x: F.regexp_replace(squeezed(x), ",", "")
    as_comma = lambda x: F.regexp_replace(F.regexp_replace(squeezed(x), r"\.", ""), ",", ".")

    def grouped(s: Column) -> Column:
        return (
            F.when(s["dot"] & s["comma"] & (as_dot(s["v"]) != as_comma(s["v"])), result("ambiguous", "number", None, "dot_or_comma"))
            .when(s["dot"], result("matched", "dot", as_dot(s["v"])))
            .when(s["comma"], result("matched", "comma", as_comma(s["v"])))
        )

    like = F.struct(v.alias("v"), v.rlike(DOT).alias("dot"), v.rlike(COMMA).alias("comma"))
    return F.when(v.rlike(INTEGER), result("matched", "integer", v)).when(v.rlike(NUMBER), result("matched", "number", v)).when(v.rlike(r"^[+-]?[0-9][0-9.,\x20\xa0 ]*[0-9]$"), let(like, grouped))


def number_value(v: Column, convention: str | None = None) -> Column:
    """The number as a double; ambiguous values only with a convention (dot or comma)."""
    n = number(v)
    squeezed = F.regexp_replace(v, r"[\x20\xa0 ]", "")
    reading = {"dot": F.regexp_replace(squeezed, ",", ""), "comma": F.regexp_replace(F.regexp_replace(squeezed, r"\.", ""), ",", "."), None: F.lit(None)}[convention]
    return F.when(n["state"] == "matched", n["value"]).when(n["state"] == "ambiguous", reading).try_cast("double")


def convention(df: DataFrame, column: str, least: int = 3) -> str | None:
    """The number convention that a column proves: ``least`` unambiguous values of one kind and none of the other."""
    v = F.col(column)
    n = df.where(v.isNotNull()).groupBy(v).agg(F.count("*").alias("n")).select("n", number(v).alias("r"))
    dots = F.sum(F.when(F.col("r.format") == "dot", F.col("n")))
    got = n.agg(F.coalesce(dots, F.lit(0)).alias("dot"), F.coalesce(F.sum(F.when(F.col("r.format") == "comma", F.col("n"))), F.lit(0)).alias("comma")).first()
    return "dot" if got["dot"] >= least and not got["comma"] else "comma" if got["comma"] >= least and not got["dot"] else None


def real_date(y: Column, m: Column, d: Column) -> Column:
    """The date, or null if the calendar has none."""
    y, m, d = y.cast("int"), m.cast("int"), d.cast("int")
    last = F.when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when((y >= 1) & m.between(1, 12) & d.between(1, last), F.make_date(y, m, d))


YMD = r"^[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}$"
DMY = r"^[0-9]{1,2}([-./])[0-9]{1,2}\1[0-9]{4}$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?$"
CLOCK = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"
DAY_NAME = r"^[0-9]{1,2}(?i:er)? [\p{L}]+\.?,? [0-9]{4}$"
NAME_DAY = r"^[\p{L}]+\.? [0-9]{1,2},? [0-9]{4}$"


def date_pieces(v: Column) -> Column:
    """form, the numbers of the text in order (p), its month name as a number, and the text."""
    form = F.when(v.rlike(YMD), "ymd").when(v.rlike(DMY), "dmy").when(v.rlike(ISO), "iso").when(v.rlike(CLOCK), "time").when(v.rlike(DAY_NAME), "day_month_name").when(v.rlike(NAME_DAY), "month_name_day")
    form = form.when(v.rlike(r"^[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}$"), "odd")
    digits = F.transform(F.regexp_extract_all(v, F.lit("([0-9]{1,9})")), lambda x: x.try_cast("int"))
    names = F.create_map(*[x for k, n in MONTHS.items() for x in (F.lit(k), F.lit(n))])
    word = F.lower(F.regexp_extract(v, r"([\p{L}]{3,})", 1))
    return F.struct(v.alias("v"), form.alias("form"), digits.alias("p"), F.when(word != "", F.element_at(names, word)).alias("month"))


def readings(s: Column) -> Column:
    """The pieces with the date as the text has it (day first for DMY) and, for DMY, the other way round."""
    form, p = s["form"], s["p"]
    at = lambda i: F.get(p, F.lit(i))
    named = form.isin("day_month_name", "month_name_day")
    first = F.struct(
        F.when(form.isin("ymd", "iso"), at(0)).when(form == "dmy", at(2)).when(named, at(1)).alias("y"),
        F.when(form.isin("ymd", "iso", "dmy"), at(1)).when(named, s["month"]).alias("m"),
        F.when(form.isin("ymd", "iso"), at(2)).when(form == "dmy", at(0)).when(named, at(0)).alias("d"),
    )
    day = let(first, lambda x: real_date(x["y"], x["m"], x["d"]))
    other = F.when(form == "dmy", let(F.struct(at(2).alias("y"), at(0).alias("m"), at(1).alias("d")), lambda x: real_date(x["y"], x["m"], x["d"])))
    return F.struct(s["v"].alias("v"), form.alias("form"), p.alias("p"), s["month"].alias("month"), day.alias("day"), other.alias("other"))


def dated(s: Column) -> Column:
    form, day, other = s["form"], s["day"], s["other"]
    bad = lambda kind: result("invalid", kind, None, "invalid_calendar_date")
    numeric = (
        F.when(day.isNotNull() & other.isNotNull() & (day != other), result("ambiguous", "dmy_or_mdy", None, "day_or_month_first"))
        .when(day.isNotNull() & other.isNotNull(), result("matched", "same_day", day))
        .when(day.isNotNull(), result("matched", "dmy", day))
        .when(other.isNotNull(), result("matched", "mdy", other))
        .otherwise(bad("dmy_or_mdy"))
    )
    clock = lambda i: (F.get(s["p"], F.lit(i)) <= 23) & (F.get(s["p"], F.lit(i + 1)) <= 59)
    second = lambda i: F.when(s["v"].rlike(":[0-9]{2}:"), F.get(s["p"], F.lit(i)) <= 59).otherwise(True)
    kind = F.when(s["v"].rlike(r"[0-9]:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9:]+)$"), "datetime_aware").otherwise("datetime_naive")
    stamp = F.when(day.isNull(), result("invalid", kind, None, "invalid_calendar_date")).when(clock(3) & second(5), result("matched", kind, s["v"])).otherwise(result("invalid", kind, None, "invalid_time"))
    named = F.when(s["month"].isNotNull(), F.when(day.isNotNull(), result("matched", form, day)).otherwise(bad(form)))
    return (
        F.when(form == "ymd", F.when(day.isNotNull(), result("matched", "ymd", day)).otherwise(bad("ymd")))
        .when(form == "dmy", numeric)
        .when(form == "iso", stamp)
        .when(form == "time", F.when(clock(0) & second(2), result("matched", "time", s["v"])).otherwise(result("invalid", "time", None, "invalid_time")))
        .when(form.isin("day_month_name", "month_name_day"), named)
        .when(form == "odd", result("invalid", "date", None, "mixed_separators"))
    )


def date(v: Column) -> Column:
    """Numeric dates by order, ISO date-times, times and month names; ambiguous if day and month can be swapped."""
    like = v.rlike(r"[0-9]") & (F.length(v) <= 40) & v.rlike(r"^[0-9\p{L}].*[0-9Z]$")
    return F.when(like, let(let(date_pieces(v), readings), dated))


def date_readings(v: Column) -> Column:
    """struct(dmy, mdy) of a text that two orders of day and month fit; null for any other."""
    both = let(let(date_pieces(v), readings), lambda s: F.when(s["day"].isNotNull() & s["other"].isNotNull() & (s["day"] != s["other"]), F.struct(s["day"].alias("dmy"), s["other"].alias("mdy"))))
    return F.when(v.rlike(DMY), both)


def date_evidence(values: DataFrame, value: str = "analytical", cnt: str = "cnt", least: int = 3) -> DataFrame:
    """day_first, month_first, ambiguous and the order that they prove: ``least`` dates of one order and none of the other."""
    d = date(F.col(value))
    rows = values.select(d["format"].alias("f"), d["state"].alias("s"), F.col(cnt).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    got = rows.agg(total((F.col("f") == "dmy") & (F.col("s") == "matched")).alias("day_first"), total((F.col("f") == "mdy") & (F.col("s") == "matched")).alias("month_first"), total(F.col("s") == "ambiguous").alias("ambiguous"))
    a, b = F.col("day_first"), F.col("month_first")
    return got.withColumn("order", F.when((a >= least) & (b == 0), "DMY").when((b >= least) & (a == 0), "MDY"))


def simulated(values: DataFrame, value: str = "analytical", cnt: str = "cnt") -> DataFrame:
    """order, period (year and month), occurrences: the ambiguous dates of a field as each order reads them."""
    rows = values.select(date_readings(F.col(value)).alias("r"), F.col(cnt).alias("n")).where("r is not null")
    both = rows.select(F.explode(F.array(*[F.struct(F.lit(k.upper()).alias("order"), F.col(f"r.{k}").alias("d")) for k in ("dmy", "mdy")])).alias("x"), "n")
    return both.groupBy(F.col("x.order").alias("order"), F.date_format("x.d", "yyyy-MM").alias("period")).agg(F.sum("n").cast("long").alias("occurrences"))


def instant(v: Column) -> Column:
    """Microseconds of a date, date-time or time of day from an origin of its kind, to put values of one kind in order.

    A time with a zone is placed by its offset; texts that are none, or ambiguous, give null.
    """

    def placed(d: Column) -> Column:
        kind, x = d["format"], d["value"]
        text = F.regexp_replace(F.regexp_replace(x, " ", "T"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
        text = F.regexp_replace(F.regexp_replace(text, r"(T.*[+-][0-9]{2})$", "$1:00"), r"(T[0-9]{2}:[0-9]{2})($|Z|[+-])", "$1:00$2")
        aware = F.unix_micros(F.try_to_timestamp(F.when(kind == "datetime_aware", text)))
        naive = F.unix_micros(F.try_to_timestamp(F.when(kind == "datetime_naive", F.concat(text, F.lit("Z")))))
        parts = F.split(x, "[:.]")
        clock = (parts[0].cast("long") * 60 + parts[1].cast("long")) * 60 + F.coalesce(F.get(parts, F.lit(2)).cast("long"), F.lit(0))
        micros = clock * 1_000_000 + F.coalesce(F.rpad(F.get(parts, F.lit(3)), 6, "0").cast("long"), F.lit(0))
        day = F.datediff(x.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000
        return F.when(d["state"] == "matched", F.when(kind == "datetime_aware", aware).when(kind == "datetime_naive", naive).when(kind == "time", micros).otherwise(day))

    return let(date(v), placed)


def boolean(v: Column) -> Column:
    low = F.lower(v)
    return F.when(low.isin(*BOOLEANS), result("matched", F.when(low.isin("true", "false"), "true_false").when(low.isin("yes", "no"), "yes_no").when(low.isin("y", "n"), "y_n").when(low.isin("oui", "non"), "oui_non").otherwise("vrai_faux"), low.isin(*[k for k, b in BOOLEANS.items() if b])))


def email(v: Column) -> Column:
    local, domain = F.substring_index(v, "@", 1), F.substring(v, F.instr(v, "@") + 1, F.length(v))
    atom = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*$"
    host = r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$"
    one = v.rlike(r"^[^\s@]+@[^\s@]+$")
    return (
        F.when(~one, None)
        .when(F.length(local) > 64, result("invalid", "email", None, "local_part_too_long"))
        .when(~local.rlike(atom), result("invalid", "email", None, "invalid_local_part"))
        .when(~domain.rlike(host) | (F.length(domain) > 253), result("invalid", "email", None, "invalid_domain"))
        .otherwise(result("matched", "email", F.lower(domain)))
    )


def url(v: Column) -> Column:
    p = r"^(?i)(?:(https?|ftp)://|(?=www\.))([^/?#\s:@]+)(?::([0-9]+))?([/?#][^\s]*)?$"
    host, port = F.regexp_extract(v, p, 2), F.nullif(F.regexp_extract(v, p, 3), F.lit("")).try_cast("int")
    good = host.rlike(r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)*[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?$")
    return (
        F.when(~v.rlike(r"(?i)^(https?://|ftp://|www\.)"), None)
        .when(~v.rlike(p), result("invalid", "url", None, "malformed"))
        .when(~good, result("invalid", "url", None, "invalid_host"))
        .when(F.coalesce(port, F.lit(1)) > 65535, result("invalid", "url", None, "invalid_port"))
        .when(v.rlike("%(?![0-9A-Fa-f]{2})"), result("invalid", "url", None, "invalid_escape"))
        .otherwise(result("matched", F.when(v.rlike("(?i)^www"), "www").otherwise(F.lower(F.regexp_extract(v, "^([A-Za-z]+):", 1))), F.lower(host)))
    )


NANP = r"^(?:(?:\+1|1)[ .-]?)?(?:\(([0-9]{3})\) ?|([0-9]{3})[ .-]?)([0-9]{3})[ .-]?[0-9]{4}$"
FRENCH = r"^(?:0|(?:\+33|0033)[ .-]?(?:\(0\) ?)?)([0-9])([ .-]?)[0-9]{2}(?:\2[0-9]{2}){3}$"
KEPT_TRUNK = r"^(?:\+33|0033)[ .-]?0[0-9]([ .-]?)[0-9]{2}(?:\1[0-9]{2}){3}$"
TOLL_FREE = ("800", "833", "844", "855", "866", "877", "888")


def phone(v: Column) -> Column:
    """North American and French numbers, national and international; the format shows digits after a prefix as 9."""
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    like = v.rlike(r"^[+(0-9][0-9 .()+-]{8,20}[0-9]$") & digits.between(10, 14)
    form = lambda x, prefix: F.concat(F.regexp_extract(x, prefix, 0), F.regexp_replace(F.regexp_replace(x, prefix, ""), "[0-9]", "9"))
    one = r"^(?:\+1|1(?=[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$))?"
    zero = r"^(?:(?:\+33|0033)(?:[ .-]?\(0\) ?)?|0)"
    bad = lambda reason: result("invalid", None, None, reason)

    def read(s: Column) -> Column:
        x, area, exchange, zone = s["v"], s["area"], s["exchange"], s["zone"]
        nanp = (area != "") & ~area.rlike("^[01]") & ~exchange.rlike("^[01]")
        wrong = F.when(area.rlike("^[01]"), bad("invalid_area_code")).when(exchange.rlike("^[01]"), bad("invalid_exchange_code")).when(zone == "0", bad("invalid_leading_digit")).when(x.rlike(KEPT_TRUNK), bad("invalid_trunk_prefix"))
        # what no form reads is told only for texts with more than digits
        return F.when(nanp, result("matched", form(x, one), F.lit("NANP"))).when((zone != "") & (zone != "0"), result("matched", form(x, zero), F.lit("FR"))).when(~x.rlike("^[0-9]+$"), wrong)

    area = F.concat(F.regexp_extract(v, NANP, 1), F.regexp_extract(v, NANP, 2))
    pieces = F.struct(v.alias("v"), area.alias("area"), F.regexp_extract(v, NANP, 3).alias("exchange"), F.regexp_extract(v, FRENCH, 1).alias("zone"))
    return F.when(like, let(pieces, read))


def phone_class(v: Column) -> Column:
    """fr_01 to fr_09 by zone, or nanp_toll_free, nanp_premium or nanp_geographic; null for what is no phone number."""
    area = F.concat(F.regexp_extract(v, NANP, 1), F.regexp_extract(v, NANP, 2))
    nanp = F.when(area.isin(*TOLL_FREE), "nanp_toll_free").when(area == "900", "nanp_premium").otherwise("nanp_geographic")
    return let(phone(v), lambda p: F.when(p["state"] == "matched", F.when(p["value"] == "NANP", nanp).otherwise(F.concat(F.lit("fr_0"), F.regexp_extract(v, FRENCH, 1)))))


def postal_code(v: Column) -> Column:
    """Canadian codes (no D F I O Q U; first letter also no W Z) and American ZIP and ZIP+4."""
    canadian = r"(?i)^[ABCEGHJ-NPRSTVXY][0-9][ABCEGHJ-NPRSTV-Z][ -]?[0-9][ABCEGHJ-NPRSTV-Z][0-9]$"
    return (
        F.when(v.rlike(canadian), result("matched", F.when(v.rlike("[ -]"), "A9A 9A9").otherwise("A9A9A9"), F.upper(F.substring(v, 1, 3))))
        .when(v.rlike(r"^[0-9]{5}(-[0-9]{4})?$"), result("matched", F.regexp_replace(v, "[0-9]", "9"), F.substring(v, 1, 3)))
        .when(v.rlike(r"(?i)^[A-Z][0-9][A-Z][ -]?[0-9][A-Z][0-9]$"), result("invalid", "canadian", None, "forbidden_letter"))
    )


def currency(v: Column) -> Column:
    """A number with a symbol or code before or after it, a sign, or in accounting brackets."""
    mark = rf"{SYMBOLS}|[A-Z]{{3}}"
    p = rf"^\(?([+-]?)({mark})?[\x20\xa0 ]?([+-]?[0-9.][0-9.,\x20\xa0 ]*?)[\x20\xa0 ]?({mark})?\)?$"
    pieces = F.struct(*[F.regexp_extract(v, p, i).alias(n) for i, n in ((2, "before"), (3, "amount"), (4, "after"))], v.alias("v"))

    def read(s: Column) -> Column:
        known = lambda c: (F.length(c) < 3) | c.contains("$") | c.isin(*CURRENCIES)
        one = ((s["before"] == "") != (s["after"] == "")) & known(s["before"]) & known(s["after"]) & (s["v"].startswith("(") == s["v"].endswith(")"))
        marker, place = F.when(s["before"] != "", s["before"]).otherwise(s["after"]), F.when(s["before"] != "", "before").otherwise("after")
        return F.when(one, let(number(s["amount"]), lambda n: F.when(n.isNotNull(), result(n["state"], place, marker, n["reason"]))))

    return F.when(v.rlike(rf"{mark}") & v.rlike("[0-9]"), let(pieces, read))


def percentage(v: Column) -> Column:
    p = r"^([+-]?[0-9.,]+)(\s?)%$"
    n = number(F.regexp_extract(v, p, 1))
    return F.when(~v.rlike(p), None).when(n.isNotNull(), result(n["state"], F.when(F.regexp_extract(v, p, 2) == "", "plain").otherwise("spaced"), n["value"], n["reason"]))


def quantity(v: Column) -> Column:
    """A number and a unit of at most 12 letters that is no currency code and no ordinal ending."""
    p = r"^([+-]?[0-9.][0-9.,]*)[\x20\xa0 ]?([\p{L}°][\p{L}°²³/·]{0,11})$"
    pieces = F.struct(F.regexp_extract(v, p, 1).alias("amount"), F.regexp_extract(v, p, 2).alias("unit"))

    def read(s: Column) -> Column:
        barred = s["unit"].isin(*CURRENCIES) | F.lower(s["unit"]).isin(*ORDINALS) | s["unit"].rlike("[/·]$")
        return F.when(~barred, let(number(s["amount"]), lambda n: F.when(n.isNotNull(), result(n["state"], "quantity", s["unit"], n["reason"]))))

    return F.when(v.rlike(p), let(pieces, read))


def uuid(v: Column) -> Column:
    p = r"^(?i)(urn:uuid:|\{)?([0-9a-f]{8}-[0-9a-f]{4}-([0-9a-f])[0-9a-f]{3}-([0-9a-f])[0-9a-f]{3}-[0-9a-f]{12})\}?$"
    body, digit = F.lower(F.regexp_extract(v, p, 2)), F.regexp_extract(v, p, 3)
    version = F.when(body == "00000000-0000-0000-0000-000000000000", "nil").when(body == "ffffffff-ffff-ffff-ffff-ffffffffffff", "max").when(digit.rlike("[1-8]"), digit).otherwise("other")
    form = F.when(v.startswith("{"), "braced").when(F.lower(v).startswith("urn"), "urn").otherwise("hyphenated")
    balanced = v.startswith("{") == v.endswith("}")
    return F.when(v.rlike(p) & balanced, result("matched", form, version)).when(v.rlike(r"^(?i)[0-9a-z]{8}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{12}$"), result("invalid", "hyphenated", None, "not_hexadecimal"))


def ip_address(v: Column) -> Column:
    """IPv4 by range, IPv6 by its leading bits."""
    four = r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$"
    o = [F.nullif(F.regexp_extract(v, four, i), F.lit("")).try_cast("int") for i in range(1, 5)]
    kind = (
        F.when(v == "0.0.0.0", "unspecified").when(o[0] == 127, "loopback").when((o[0] == 10) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168)), "private")
        .when((o[0] == 100) & o[1].between(64, 127), "shared").when((o[0] == 169) & (o[1] == 254), "link_local").when(o[0].between(224, 239), "multicast").when((o[0] == 0) | (o[0] >= 240), "reserved").otherwise("public")
    )
    six = v.rlike(r"^(?i)(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?=([^:]*:){2,8}[^:]*$)(?!.*::.*::)(?!.*:::)(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?)$")
    low = F.lower(v)
    class6 = F.when(low == "::", "unspecified").when(low == "::1", "loopback").when(low.rlike("^fe[89ab]"), "link_local").when(low.rlike("^f[cd]"), "private").when(low.startswith("ff"), "multicast").otherwise("public")
    wide = o[0] > 255
    for x in o[1:]:
        wide = wide | (x > 255)
    padded = v.rlike(r"(^|\.)0[0-9]")
    return (
        F.when(v.rlike(four), F.when(wide, result("invalid", "ipv4", None, "octet_out_of_range")).when(padded, result("invalid", "ipv4", None, "leading_zero")).otherwise(result("matched", "ipv4", kind)))
        .when(v.contains(":") & six, result("matched", "ipv6", class6))
    )


def pattern(regex: str, name: str) -> Callable[[Column], Column]:
    """A detector from a regular expression that must match the whole value."""
    if len(regex) > 1000:
        raise ValueError("a pattern has at most 1000 characters")
    return lambda v: F.when(v.rlike(f"^(?:{regex})$"), result("matched", name))


def starts(v: Column, characters: str) -> Column:
    return F.substring(v, 1, 1).isin(*characters)


def ends(v: Column, characters: str) -> Column:
    return F.substring(v, -1, 1).isin(*characters)


DIGITS, LINE_ENDS = "0123456789", "\n\r\x85\u2028\u2029"
#: What a text must have for a detector to say anything, without a regular expression. ``$`` also matches before a last line end.
NEEDS: dict[str, Callable[[Column], Column]] = {
    "number": lambda v: starts(v, DIGITS + "+-."),
    "date": lambda v: (F.length(v) <= 40) & ends(v, DIGITS + "Z" + LINE_ENDS) & (v.contains("-") | v.contains("/") | v.contains(".") | v.contains(":") | v.contains(" ")),
    "email": lambda v: v.contains("@"),
    "url": lambda v: starts(v, "hHfFwW"),
    "phone": lambda v: F.length(v).between(10, 24) & starts(v, DIGITS + "+("),
    "postal_code": lambda v: F.length(v).between(5, 12) & starts(v, DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    "currency": lambda v: starts(v, DIGITS + "(+-.ABCDEFGHIJKLMNOPQRSTUVWXYZ$€£¥\x20\xa0\u202f"),
    "percentage": lambda v: v.contains("%"),
    "quantity": lambda v: starts(v, DIGITS + "+-.") & ~ends(v, DIGITS),
    "uuid": lambda v: F.length(v).between(36, 50) & v.contains("-"),
    "ip_address": lambda v: (v.contains(".") & starts(v, DIGITS)) | v.contains(":"),
}


def told(name: str, v: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of what the detector of this name says, null where it says nothing; most texts cost a look at their ends."""
    said = let(DETECTORS[name](v), use)
    return F.when(NEEDS[name](v), said) if name in NEEDS else said


DETECTORS: dict[str, Callable[[Column], Column]] = {
    "number": number, "date": date, "boolean": boolean, "email": email, "url": url, "phone": phone, "postal_code": postal_code,
    "currency": currency, "percentage": percentage, "quantity": quantity, "uuid": uuid, "ip_address": ip_address,
}


def register(name: str, detector: Callable[[Column], Column]) -> None:
    """Add a detector of one's own."""
    if name in DETECTORS:
        raise ValueError(f"there is a detector {name}")
    DETECTORS[name] = detector


def family(v: Column) -> Column:
    """integer, number, date, boolean or text: the technical family of a content string."""
    day = lambda d: (d["state"] != "invalid") & d["format"].isin("ymd", "dmy", "mdy", "same_day", "dmy_or_mdy", "day_month_name", "month_name_day")
    both = lambda n: F.when(n["format"] == "integer", "integer").when(n.isNotNull(), "number")
    return F.coalesce(told("number", v, both), F.when(told("date", v, day), F.lit("date")), F.when((F.length(v) <= 5) & F.lower(v).isin("true", "false"), "boolean"), F.when(v.isNotNull(), "text"))


def coverage(values: DataFrame, detector: str | Callable[[Column], Column], value: str = "analytical", cnt: str = "cnt") -> DataFrame:
    """state, format, reason: occurrences and distinct values, over a table of distinct values with counts."""
    f = DETECTORS[detector] if isinstance(detector, str) else detector
    tested = values.where(F.col(value).isNotNull()).select(F.col(value), F.col(cnt), f(F.col(value)).alias("r"))
    state = F.coalesce(F.col("r.state"), F.lit("not_matched"))
    return tested.groupBy(state.alias("state"), F.col("r.format").alias("format"), F.col("r.reason").alias("reason")).agg(F.sum(cnt).cast("long").alias("occurrences"), F.count("*").alias("distinct_values"))


def enumeration(df: DataFrame, column: str, least: int = 500, most: int = 49) -> DataFrame:
    """Whether a field has many values and few distinct ones."""
    c = F.col(column)
    return df.agg(F.count(c).alias("values"), F.count_distinct(c).alias("distinct_values")).withColumn("is_enumeration", (F.col("values") >= least) & (F.col("distinct_values") <= most))


def keys(df: DataFrame, first: Column, second: Column, least_share: float = 0.95) -> DataFrame:
    """Two-level key tree (such as extension and domain) with counts, if the first key covers enough values."""
    per = df.select(first.alias("key"), second.alias("subkey")).groupBy("key", "subkey").agg(F.count("*").alias("cnt"))
    total = df.agg(F.count("*").alias("all"), F.count(first).alias("with"))
    return per.where("key is not null").crossJoin(F.broadcast(total)).where(F.col("with") >= least_share * F.col("all")).select("key", "subkey", "cnt")
