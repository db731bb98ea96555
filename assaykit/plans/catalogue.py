"""The registered queries and their DuckDB equivalents.

The driver's tables hold no nulls and no repeated rows, so many queries read a projection that
makes some: the expressions below are the same text in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import detectors
from assaykit.operators import explore, generate, patterns, population, quality, relations, rows, smart, values
from assaykit.streaming import values as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EVENT_TYPE = "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN '' WHEN event_id % 83 = 0 THEN '  ' WHEN event_id % 7 = 0 THEN upper(event_type) WHEN event_id % 11 = 0 THEN ' ' || event_type || ' ' ELSE event_type END"
DIRTY = {
    "dirty_events": ("events", {"event_id": "event_id", "kind": EVENT_TYPE, "value": "CASE WHEN event_id % 53 = 0 THEN NULL ELSE value END", "note": "CASE WHEN event_id % 19 = 0 OR event_id % 97 = 0 THEN NULL ELSE 'x' END"}),
    "dirty_numbers": ("customer", {"id": "c_custkey", "r": "c_custkey % 8", "v": "CASE c_custkey % 8 WHEN 0 THEN cast(c_custkey AS string) WHEN 1 THEN '1,' || lpad(cast(c_custkey % 1000 AS string), 3, '0') || '.50' WHEN 2 THEN '1.' || lpad(cast(c_custkey % 1000 AS string), 3, '0') || ',50' WHEN 3 THEN '1,' || lpad(cast(c_custkey % 1000 AS string), 3, '0') WHEN 4 THEN '$' || cast(c_custkey AS string) || '.25' WHEN 5 THEN cast(c_custkey AS string) || ' kg' WHEN 6 THEN cast(c_custkey % 100 AS string) || '%' ELSE 'abc' END"}),
    "dirty_dates": ("orders", {"id": "o_orderkey", "r": "o_orderkey % 6", "d": "1 + o_orderkey % 28", "v": "CASE o_orderkey % 6 WHEN 0 THEN '2024-03-' || lpad(cast(1 + o_orderkey % 28 AS string), 2, '0') WHEN 1 THEN lpad(cast(1 + o_orderkey % 28 AS string), 2, '0') || '/03/2024' WHEN 2 THEN '2024-02-30' WHEN 3 THEN '2024-03-05T10:' || lpad(cast(o_orderkey % 60 AS string), 2, '0') || ':00Z' WHEN 4 THEN cast(1 + o_orderkey % 28 AS string) || ' March 2024' ELSE 'no date' END"}),
    "dirty_ids": ("orders", {"id": "CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey END", "status": "o_orderstatus", "rec": "o_orderkey"}),
    "dup_rows": ("lineitem", {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_quantity": "l_quantity"}),
    "dup_recs": ("orders", {"rec": "o_orderkey", "status": "o_orderstatus", "priority": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END", "day": "o_orderkey % 40"}),
    "contacts": ("customer", {"id": "c_custkey", "r": "c_custkey % 5", "email": "CASE c_custkey % 5 WHEN 0 THEN 'user' || cast(c_custkey AS string) || '@example.com' WHEN 1 THEN '.bad@example.com' WHEN 2 THEN 'a@-bad-.com' WHEN 3 THEN 'nobody' ELSE 'A.b@mail.example.org' END", "phone": "CASE c_custkey % 5 WHEN 0 THEN '(514) 555-' || lpad(cast(c_custkey % 10000 AS string), 4, '0') WHEN 1 THEN '01 23 45 67 89' WHEN 2 THEN '+33 1 23 45 67 89' WHEN 3 THEN '123-45-67-8' ELSE 'none' END", "postal": "CASE c_custkey % 5 WHEN 0 THEN 'H2X 1Y4' WHEN 1 THEN '90210' WHEN 2 THEN '90210-1234' WHEN 3 THEN 'D2X 1Y4' ELSE 'zzz' END", "uuid": "CASE c_custkey % 5 WHEN 0 THEN '550e8400-e29b-41d4-a716-446655440000' WHEN 1 THEN '{550e8400-e29b-11d4-a716-446655440000}' WHEN 2 THEN '00000000-0000-0000-0000-000000000000' WHEN 3 THEN '550e8400-e29b-41d4-a716-44665544zzzz' ELSE 'x' END", "ip": "CASE c_custkey % 5 WHEN 0 THEN '10.0.0.' || cast(c_custkey % 256 AS string) WHEN 1 THEN '8.8.8.8' WHEN 2 THEN '300.1.1.1' WHEN 3 THEN '2001:db8::1' ELSE '1.2.3' END", "yes": "CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'vrai' WHEN 3 THEN 'true' ELSE 'maybe' END", "money": "CASE c_custkey % 5 WHEN 0 THEN '$1,234.50' WHEN 1 THEN '12 EUR' WHEN 2 THEN 'CAD 1,234' WHEN 3 THEN '99' ELSE 'free' END", "url": "CASE c_custkey % 5 WHEN 0 THEN 'https://Example.com/a?b=1' WHEN 1 THEN 'www.example.org' WHEN 2 THEN 'http://bad_host/' WHEN 3 THEN 'http://example.com/%zz' ELSE 'example' END"}),
    "people": ("customer", {"id": "c_custkey", "email": "'user' || cast(c_custkey AS string) || CASE WHEN c_custkey % 3 = 0 THEN '@Example.com' ELSE '@mail.example.org' END", "phone": "'(514) 555-' || lpad(cast(c_custkey % 10000 AS string), 4, '0')", "postal": "'H2X 1Y' || cast(c_custkey % 10 AS string)", "uuid": "'550e8400-e29b-41d4-a716-4466' || lpad(cast(c_custkey AS string), 8, '0')", "ip": "'10.0.' || cast(c_custkey % 200 AS string) || '.7'", "url": "'https://example.com/' || cast(c_custkey AS string)"}),
    "faults": ("orders", {
        "k": "o_orderkey", "d": "CASE WHEN o_orderkey % 25 = 0 THEN '2024-02-30' WHEN o_orderkey % 25 = 1 THEN '03-04-2024' ELSE '2024-03-' || lpad(cast(1 + o_orderkey % 28 AS string), 2, '0') END", "e": "CASE WHEN o_orderkey % 20 = 0 THEN 'bad@' ELSE 'user' || cast(o_orderkey AS string) || '@example.com' END",
        "num": "CASE WHEN o_orderkey % 40 = 0 THEN 'abc' WHEN o_orderkey % 40 = 1 THEN '1,234' ELSE cast(100 + o_orderkey % 900 AS string) END", "cat": "CASE o_orderkey % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'north' ELSE ' South  East ' END", "code": "CASE WHEN o_orderkey % 50 = 0 THEN 'X1' ELSE 'AB-' || lpad(cast(o_orderkey % 1000 AS string), 3, '0') END",
        "one": "'x'", "none": "cast(NULL AS string)", "client_id": "'C' || cast(o_orderkey - o_orderkey % 2 AS string)", "mixed": "CASE WHEN o_orderkey % 5 < 2 THEN cast(o_orderkey AS string) ELSE 'word' END",
    }),
    "gaps": ("orders", {"k": "o_orderkey", "a": "CASE WHEN o_orderkey % 4 <> 0 THEN 'x' END", "b": "CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 40 <> 1 THEN 'y' END", "c": "CASE WHEN o_orderkey % 10 <> 0 THEN 'z' END"}),
    "near": ("customer", {"v": "CASE WHEN c_custkey = 7 THEN 'Nrth' WHEN c_custkey = 11 THEN 'Soutth' WHEN c_custkey = 12 THEN 'Wast' ELSE CASE c_custkey % 3 WHEN 0 THEN 'North' WHEN 1 THEN 'South' ELSE 'East' END END"}),
    "docs_labels": ("documents LEFT JOIN labels USING (doc_id)", {"doc_id": "doc_id", "lang": "lang", "quality": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END", "toxic": "toxic", "source": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END"}),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "docs_labels":
        base = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    elif name in DIRTY:
        base = load(spark, sf_dir, DIRTY[name][0])
    else:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return base.select(*[F.expr(e).alias(a) for a, e in DIRTY[name][1].items()])


def view(name: str) -> str:
    """The projection as a subquery for DuckDB."""
    table, columns = DIRTY[name]
    return "(SELECT " + ", ".join(f"{e} AS {a}" for a, e in columns.items()) + f" FROM {table})"


def query(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(load(spark, sf_dir, table))
    if sql:
        ORACLE_SQL[name] = sql.replace("$T", view(table) if table in DIRTY else table)


def profile_sql(table: str, columns: dict[str, str]) -> str:
    """Profile of typed columns without dirty text: {column: native type}."""
    parts = []
    for c, kind in columns.items():
        text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind == "timestamp" else f"CAST({c} AS VARCHAR)"
        native = "string" if kind == "timestamp" else kind
        length = f"length({text})" if native == "string" else "CAST(NULL AS BIGINT)"
        flag = lambda f: f"CAST({'count(' + c + ')' if native == f else '0'} AS BIGINT)"  # noqa: B023, E731
        top = f"(SELECT {{}} FROM (SELECT {text} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
        parts.append(
            f"SELECT '{c}' AS field, {len(parts)}::INTEGER AS position, '{native}' AS native_type, count(*) AS positions, count({c}) AS present, count(*) - count({c}) AS n_null, 0::BIGINT AS n_empty, 0::BIGINT AS n_blank, 0::BIGINT AS n_marker, count(DISTINCT {text}) AS distinct_raw, count(DISTINCT {text}) AS distinct_values, min({length}) AS min_length, max({length}) AS max_length, round(avg({length}), 6) AS mean_length, {flag('integer')} AS as_integer, {flag('number')} AS as_number, 0::BIGINT AS as_date, 0::BIGINT AS as_boolean, '{'text' if native == 'string' else native}' AS technical_type, {top.format('v')} AS top_value, {top.format('n')} AS top_count, count(*) - count({c}) AS missing FROM {table}"
        )
    return " UNION ALL ".join(parts)


# Profiles and values.
for _t, _c in {
    "events": {"event_id": "integer", "ts": "timestamp", "user_id": "integer", "event_type": "string", "value": "number", "props": "string"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "number", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "number", "c_mktsegment": "string"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "number"},
}.items():
    query(f"profile_{_t}", _t, (lambda names: lambda d: values.profile(d.select(*names)))(list(_c)), profile_sql(_t, _c))
query("profile_dirty_events", "dirty_events", lambda d: values.profile(d.select("kind")).select("field", "positions", "present", "n_null", "n_empty", "n_blank", "distinct_raw", "distinct_values", "top_value", "top_count", "missing"), "WITH c AS (SELECT kind, CASE WHEN trim(kind) <> '' THEN trim(kind) END AS a FROM $T), f AS (SELECT a, count(*) AS n FROM c WHERE a IS NOT NULL GROUP BY a) SELECT 'kind' AS field, count(*) AS positions, count(a) AS present, count(*) FILTER (kind IS NULL) AS n_null, count(*) FILTER (kind = '') AS n_empty, count(*) FILTER (kind <> '' AND trim(kind) = '') AS n_blank, count(DISTINCT CASE WHEN a IS NOT NULL THEN kind END) AS distinct_raw, count(DISTINCT a) AS distinct_values, (SELECT a FROM f ORDER BY n DESC, a LIMIT 1) AS top_value, (SELECT n FROM f ORDER BY n DESC, a LIMIT 1) AS top_count, count(*) - count(a) AS missing FROM c")
query("freq_event_type", "events", lambda d: values.frequencies(d, "event_type"), "SELECT 'string' AS native_type, event_type AS value, count(*) AS cnt FROM $T GROUP BY 2")
query("freq_top_part_name", "part", lambda d: values.frequencies(d, "p_name", 100), "SELECT 'string' AS native_type, p_name AS value, count(*) AS cnt FROM $T GROUP BY 2 ORDER BY cnt DESC, value LIMIT 100")
query("ends_event_type", "events", lambda d: values.ends(d, "event_type", "event_id"), "SELECT arg_min(event_type, event_id) AS first_value, min(event_id) AS first_record, arg_max(event_type, event_id) AS last_value, max(event_id) AS last_record FROM $T")
query("lengths_part_name", "part", lambda d: values.lengths(d, "p_name"), "SELECT length(p_name) AS length, count(*) AS cnt FROM $T GROUP BY 1")
query("length_summary_part_name", "part", lambda d: values.length_summary(d, "p_name"), "SELECT min(length(p_name)) AS min_length, max(length(p_name)) AS max_length, round(avg(length(p_name)), 6) AS mean_length, median(length(p_name)) AS median_length FROM $T")
query("bottom_k_part_name", "part", lambda d: values.bottom_k(d, "p_name", 20), "SELECT p_name AS value, count(*) AS cnt, md5('42|' || p_name) AS priority FROM $T GROUP BY p_name ORDER BY priority, value LIMIT 20")
query("distinct_estimate_orders", "orders", lambda d: values.distinct_estimate(d, "o_orderkey"), "WITH k AS (SELECT h FROM (SELECT DISTINCT md5('42|' || CAST(o_orderkey AS VARCHAR)) AS h FROM $T) ORDER BY h LIMIT 256) SELECT count(*) AS kept, CASE WHEN count(*) < 256 THEN count(*)::DOUBLE ELSE round(255 / (('0x' || max(h)[1:12])::BIGINT::DOUBLE / 281474976710656.0), 3) END AS estimate, CASE WHEN count(*) < 256 THEN 0.0 ELSE round(1 / sqrt(254.0), 6) END AS relative_error FROM k")
query("by_length_part_type", "part", lambda d: values.by_length(d, "p_name", 3), "SELECT value, cnt, length, place FROM (SELECT p_name AS value, count(*) AS cnt, length(p_name) AS length, row_number() OVER (PARTITION BY length(p_name) ORDER BY md5('42|' || p_name), p_name)::INTEGER AS place FROM $T GROUP BY p_name) WHERE place <= 3")
query("stages_dirty_events", "dirty_events", lambda d: values.stages(d, "kind"), "WITH c AS (SELECT kind FROM $T WHERE trim(kind) <> ''), s AS (SELECT unnest(['raw', 'nfc', 'trim', 'collapse_whitespace', 'casefold', 'strip_accents']) AS stage, unnest([0, 1, 2, 3, 4, 5])::INTEGER AS place) SELECT stage, place, (SELECT count(DISTINCT CASE WHEN place < 2 THEN kind WHEN place < 4 THEN trim(kind) ELSE lower(trim(kind)) END) FROM c) AS distinct_values, CASE place WHEN 2 THEN (SELECT count(*) FROM c WHERE kind <> trim(kind)) WHEN 4 THEN (SELECT count(*) FROM c WHERE trim(kind) <> lower(trim(kind))) ELSE 0 END AS changed FROM s")
query("variant_groups_dirty_events", "dirty_events", lambda d: values.variant_groups(d, "kind"), "WITH v AS (SELECT kind, lower(trim(kind)) AS key, count(*) AS n FROM $T WHERE trim(kind) <> '' GROUP BY 1, 2) SELECT key, count(*) AS spellings, sum(n)::BIGINT AS occurrences, first(kind ORDER BY n DESC, kind) AS most_frequent FROM v GROUP BY key HAVING count(*) >= 2")
query("characteristics_dirty_events", "dirty_events", lambda d: values.flags(d, "kind").where("flag in ('surrounding_whitespace', 'repeated_whitespace', 'upper', 'lower', 'no_letters')"), "WITH v AS (SELECT kind, count(*) AS n FROM $T WHERE kind IS NOT NULL GROUP BY 1), f AS (SELECT kind, n, unnest(['surrounding_whitespace', 'repeated_whitespace', 'upper', 'lower', 'no_letters']) AS flag, unnest([regexp_matches(kind, '^\\s|\\s$'), regexp_matches(kind, '\\s\\s'), regexp_matches(kind, '[A-Z]') AND NOT regexp_matches(kind, '[a-z]'), regexp_matches(kind, '[a-z]') AND NOT regexp_matches(kind, '[A-Z]'), NOT regexp_matches(kind, '[A-Za-z]')]) AS ison FROM v) SELECT flag, coalesce(sum(n) FILTER (ison), 0)::BIGINT AS occurrences, count(*) FILTER (ison) AS distinct_values FROM f GROUP BY flag".replace("\\\\", "\\"))
query("presence_documents", "documents", lambda d: values.flags(d, "lang", "presence").where("flag in ('ascii_lower', 'ascii_digit', 'letters_only', 'ascii_only', 'starts_upper')"), "SELECT unnest(['ascii_lower', 'ascii_digit', 'letters_only', 'ascii_only', 'starts_upper']) AS flag, unnest([count(*) FILTER (regexp_matches(lang, '[a-z]')), count(*) FILTER (regexp_matches(lang, '[0-9]')), count(*) FILTER (regexp_matches(lang, '^[A-Za-z]+$')), count(*), count(*) FILTER (regexp_matches(lang, '^[A-Z]'))]) AS occurrences, unnest([count(DISTINCT lang) FILTER (regexp_matches(lang, '[a-z]')), count(DISTINCT lang) FILTER (regexp_matches(lang, '[0-9]')), count(DISTINCT lang) FILTER (regexp_matches(lang, '^[A-Za-z]+$')), count(DISTINCT lang), count(DISTINCT lang) FILTER (regexp_matches(lang, '^[A-Z]'))]) AS distinct_values FROM $T")
query("char_map_part", "part", lambda d: values.characters(d, "p_name"), "WITH v AS (SELECT p_name AS v, count(*) AS n FROM $T GROUP BY 1), c AS (SELECT v, n, unnest(regexp_extract_all(v, '.')) AS ch FROM v), p AS (SELECT v, n, ch, count(*) AS k FROM c GROUP BY ALL) SELECT ch AS char, sum(k * n)::BIGINT AS occurrences, sum(n)::BIGINT AS in_values FROM p GROUP BY ch")
query("mask_forms_phone", "contacts", lambda d: values.masks(d, "phone"), "WITH m AS (SELECT regexp_replace(regexp_replace(regexp_replace(phone, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS f, count(*) AS n FROM $T GROUP BY 1) SELECT CASE WHEN n >= 5 THEN f ELSE 'other' END AS form, sum(n)::BIGINT AS cnt FROM m GROUP BY 1")
query("shape_signature_c_name", "customer", lambda d: values.shapes(d, "c_name"), "SELECT 'Aa#9' AS shape, count(*) AS cnt, count(DISTINCT c_name) AS distinct_values FROM $T")
query("long_texts_documents", "documents", lambda d: values.long_texts(d, "text"), "SELECT md5(text) AS digest, count(*) AS cnt, any_value(substr(text, 1, 40)) AS preview, any_value(length(text)) AS length FROM $T WHERE length(text) > 1000 GROUP BY 1")
query("cases_dirty_events", "dirty_events", lambda d: values.cases(d, "kind", "event_id"), "WITH c AS (SELECT event_id AS record, kind AS value FROM $T WHERE kind IS NOT NULL), k AS (SELECT 'leading' AS kind, record, value FROM c WHERE regexp_matches(value, '^ ') UNION ALL SELECT 'trailing', record, value FROM c WHERE regexp_matches(value, ' $') UNION ALL SELECT 'repeated', record, value FROM c WHERE regexp_matches(value, '  ')) SELECT kind, record, value FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY record) AS p FROM k) WHERE p <= 5")
query("text_profile_documents", "documents", lambda d: values.text_profile(d, "text"), r"WITH w AS (SELECT len(regexp_extract_all(text, '\S+')) AS w, length(text) - length(replace(text, chr(10), '')) + 1 AS l, len(regexp_extract_all(text, '[0-9]')) AS d FROM $T) SELECT CASE WHEN w = 0 THEN 0 ELSE floor(log2(w))::BIGINT + 1 END AS bucket, count(*) AS texts, sum(w)::BIGINT AS words, sum(l)::BIGINT AS lines, count(*) FILTER (l > 1) AS multi_line, sum(d)::BIGINT AS digits FROM w GROUP BY 1")

# Detectors. The projections say what each value is, so the expected states come from how it was made.
_counted = lambda d, column: d.groupBy(F.col(column).alias("analytical")).agg(F.count("*").alias("cnt"))


def detector(name: str, table: str, column: str, which: str, expected: str) -> None:
    """``expected`` maps the remainder r to 'state|format|reason'."""
    sql = f"WITH e AS (SELECT {column} AS v, {expected} AS x FROM $T), s AS (SELECT v, string_split(x, '|') AS p FROM e) SELECT p[1] AS state, nullif(p[2], '') AS format, nullif(p[3], '') AS reason, count(*) AS occurrences, count(DISTINCT v) AS distinct_values FROM s GROUP BY 1, 2, 3"
    query(name, table, lambda d: detectors.coverage(_counted(d, column), which), sql)


detector("detect_number_dirty", "dirty_numbers", "v", "number", "CASE r WHEN 0 THEN 'matched|integer|' WHEN 1 THEN 'matched|dot|' WHEN 2 THEN 'matched|comma|' WHEN 3 THEN 'ambiguous|number|dot_or_comma' ELSE 'not_matched||' END")
detector("detect_date_dirty", "dirty_dates", "v", "date", "CASE r WHEN 0 THEN 'matched|ymd|' WHEN 1 THEN CASE WHEN d = 3 THEN 'matched|same_day|' WHEN d <= 12 THEN 'ambiguous|dmy_or_mdy|day_or_month_first' ELSE 'matched|dmy|' END WHEN 2 THEN 'invalid|ymd|invalid_calendar_date' WHEN 3 THEN 'matched|datetime_aware|' WHEN 4 THEN 'matched|day_month_name|' ELSE 'not_matched||' END")
detector("detect_email", "contacts", "email", "email", "CASE r WHEN 0 THEN 'matched|email|' WHEN 1 THEN 'invalid|email|invalid_local_part' WHEN 2 THEN 'invalid|email|invalid_domain' WHEN 3 THEN 'not_matched||' ELSE 'matched|email|' END")
detector("detect_phone", "contacts", "phone", "phone", "CASE r WHEN 0 THEN 'matched|(999) 999-9999|' WHEN 1 THEN 'matched|09 99 99 99 99|' WHEN 2 THEN 'matched|+33 9 99 99 99 99|' ELSE 'not_matched||' END")
detector("detect_postal", "contacts", "postal", "postal_code", "CASE r WHEN 0 THEN 'matched|A9A 9A9|' WHEN 1 THEN 'matched|99999|' WHEN 2 THEN 'matched|99999-9999|' WHEN 3 THEN 'invalid|canadian|forbidden_letter' ELSE 'not_matched||' END")
detector("detect_uuid", "contacts", "uuid", "uuid", "CASE r WHEN 0 THEN 'matched|hyphenated|' WHEN 1 THEN 'matched|braced|' WHEN 2 THEN 'matched|hyphenated|' WHEN 3 THEN 'invalid|hyphenated|not_hexadecimal' ELSE 'not_matched||' END")
detector("detect_ip", "contacts", "ip", "ip_address", "CASE r WHEN 0 THEN 'matched|ipv4|' WHEN 1 THEN 'matched|ipv4|' WHEN 2 THEN 'invalid|ipv4|octet_out_of_range' WHEN 3 THEN 'matched|ipv6|' ELSE 'not_matched||' END")
detector("detect_boolean", "contacts", "yes", "boolean", "CASE r WHEN 0 THEN 'matched|yes_no|' WHEN 1 THEN 'matched|yes_no|' WHEN 2 THEN 'matched|vrai_faux|' WHEN 3 THEN 'matched|true_false|' ELSE 'not_matched||' END")
detector("detect_currency", "contacts", "money", "currency", "CASE r WHEN 0 THEN 'matched|before|' WHEN 1 THEN 'matched|after|' WHEN 2 THEN 'ambiguous|before|dot_or_comma' ELSE 'not_matched||' END")
detector("detect_percentage", "dirty_numbers", "v", "percentage", "CASE r WHEN 6 THEN 'matched|plain|' ELSE 'not_matched||' END")
detector("detect_quantity", "dirty_numbers", "v", "quantity", "CASE r WHEN 5 THEN 'matched|quantity|' ELSE 'not_matched||' END")
detector("detect_url", "contacts", "url", "url", "CASE r WHEN 0 THEN 'matched|https|' WHEN 1 THEN 'matched|www|' WHEN 2 THEN 'invalid|url|invalid_host' WHEN 3 THEN 'invalid|url|invalid_escape' ELSE 'not_matched||' END")
query("detect_pattern_c_name", "customer", lambda d: detectors.coverage(_counted(d, "c_name"), detectors.pattern("Customer#[0-9]{9}", "customer")), "SELECT 'matched' AS state, 'customer' AS format, CAST(NULL AS VARCHAR) AS reason, count(*) AS occurrences, count(DISTINCT c_name) AS distinct_values FROM $T")
query("detect_enumeration", "events", lambda d: detectors.enumeration(d, "event_type"), "SELECT count(event_type) AS values, count(DISTINCT event_type) AS distinct_values, count(event_type) >= 500 AND count(DISTINCT event_type) <= 49 AS is_enumeration FROM $T")
query("email_domain_keys", "people", lambda d: detectors.keys(d, F.substring_index("email", ".", -1), F.lower(F.substring_index("email", "@", -1))), "SELECT split_part(email, '.', -1) AS key, lower(split_part(email, '@', 2)) AS subkey, count(*) AS cnt FROM $T GROUP BY 1, 2")

# Rows.
_dup = "WITH g AS (SELECT count(*) AS c FROM $T GROUP BY ALL) SELECT sum(c)::BIGINT AS total, count(*) AS distinct_rows, count(*) FILTER (c = 1) AS singletons, count(*) FILTER (c >= 2) AS duplicate_groups, count(*) FILTER (c = 2) AS twice, count(*) FILTER (c >= 3) AS three_plus, (sum(c) - count(*))::BIGINT AS extra_copies, coalesce(sum(c) FILTER (c >= 2), 0)::BIGINT AS duplicate_group_occurrences, max(c) AS max_occurrences, round((sum(c) - count(*)) * 100.0 / sum(c), 4) AS extra_copy_percent FROM g"
query("dedup_stats_lineitem", "dup_rows", rows.duplicate_stats, _dup.replace("count(*) AS c FROM $T GROUP BY ALL", "l_returnflag, l_linestatus, l_quantity, count(*) AS c FROM $T GROUP BY 1, 2, 3"))
query("dedup_unique_rows", "dup_recs", lambda d: rows.duplicates(d, "unique", "rec"), "SELECT status, priority, day, min(rec) AS rec FROM $T GROUP BY 1, 2, 3")
query("dedup_duplicates", "dup_recs", lambda d: rows.duplicates(d, "duplicates", "rec"), "SELECT status, priority, day, min(rec) AS rec FROM $T GROUP BY 1, 2, 3 HAVING count(*) > 1")
query("dedup_duplicates_all", "dup_recs", lambda d: rows.duplicates(d, "duplicates_all", "rec"), "SELECT rec, status, priority, day FROM (SELECT *, count(*) OVER (PARTITION BY status, priority, day) AS c FROM $T) WHERE c > 1")
query("dedup_marks", "dup_recs", lambda d: rows.marks(d, "rec"), "SELECT rec AS record, c > 1 AND rec = f AS is_group_first, rec <> f AS is_extra FROM (SELECT rec, count(*) OVER w AS c, min(rec) OVER w AS f FROM $T WINDOW w AS (PARTITION BY status, priority, day))")
query("dup_key_two_columns", "dup_recs", lambda d: rows.repeated_keys(d, ["status", "priority"], "rec"), "SELECT status, priority, count(*) AS cnt, min(rec) AS first_rec FROM $T WHERE status IS NOT NULL AND priority IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
query("dup_key_summary", "dup_recs", lambda d: rows.key_summary(d, ["priority", "day"]), "WITH g AS (SELECT count(*) AS c FROM $T WHERE priority IS NOT NULL GROUP BY priority, day) SELECT sum(c)::BIGINT AS values, count(*) AS distinct_values, count(*) FILTER (c > 1) AS repeated_values, (SELECT count(*) FROM $T WHERE priority IS NULL) AS incomplete_rows, (sum(c) - count(*))::BIGINT AS redundant FROM g")
query("dup_text_documents", "documents", lambda d: rows.fingerprints(d, "text"), "WITH g AS (SELECT count(*) AS c FROM $T GROUP BY text) SELECT sum(c)::BIGINT AS values, count(*) AS distinct_values, (sum(c) - count(*))::BIGINT AS redundant, max(c) AS most FROM g")
query("missing_id_copies_dirty_events", "dirty_events", lambda d: rows.missing_id_copies(d, "kind", ["kind", "note"]), "WITH g AS (SELECT kind, note, count(*) AS c FROM $T WHERE kind IS NULL OR trim(kind) = '' GROUP BY 1, 2) SELECT sum(c)::BIGINT AS rows, count(*) AS distinct_rows, (sum(c) - count(*))::BIGINT AS extra_copies FROM g")
query("record_facts_dirty_events", "dirty_events", lambda d: rows.record_facts(d, ["kind", "value", "note"]), "WITH m AS (SELECT (kind IS NULL OR trim(kind) = '')::INT + (value IS NULL)::INT + (note IS NULL)::INT AS m FROM $T) SELECT count(*) AS records, count(*) FILTER (m > 0) AS with_missing, count(*) FILTER (m = 3) AS empty, sum(m)::BIGINT AS missing_cells FROM m")
query("listing_with_missing", "dirty_events", lambda d: rows.listing(d, "with_missing", "event_id", 500, 100, ["kind", "value"]), "SELECT event_id AS record FROM $T WHERE (kind IS NULL OR trim(kind) = '' OR value IS NULL) AND event_id > 500 ORDER BY 1 LIMIT 100")
query("symmetric_difference", "dup_rows", lambda d: rows.symmetric_difference(d.where("l_quantity < 30"), d.where("l_quantity > 20")), "(SELECT * FROM $T WHERE l_quantity < 30 EXCEPT ALL SELECT * FROM $T WHERE l_quantity > 20) UNION ALL (SELECT * FROM $T WHERE l_quantity > 20 EXCEPT ALL SELECT * FROM $T WHERE l_quantity < 30)")
_p = "md5(CAST(o_orderkey AS VARCHAR) || '|42')"
query("sample_first", "orders", lambda d: rows.sample(d.select("o_orderkey", "o_orderstatus"), "first", 50, "o_orderkey"), "SELECT o_orderkey, o_orderstatus FROM $T ORDER BY o_orderkey LIMIT 50")
query("sample_last", "orders", lambda d: rows.sample(d.select("o_orderkey", "o_orderstatus"), "last", 50, "o_orderkey"), "SELECT o_orderkey, o_orderstatus FROM $T ORDER BY o_orderkey DESC LIMIT 50")
query("sample_random", "orders", lambda d: rows.sample(d.select("o_orderkey", "o_orderstatus"), "random", 50, "o_orderkey"), f"SELECT o_orderkey, o_orderstatus FROM $T ORDER BY {_p} LIMIT 50")
query("sample_mixed", "orders", lambda d: rows.sample(d.select("o_orderkey", "o_orderstatus"), "mixed", 60, "o_orderkey"), f"WITH e AS ((SELECT o_orderkey FROM $T ORDER BY 1 LIMIT 20) UNION (SELECT o_orderkey FROM $T ORDER BY 1 DESC LIMIT 20)), m AS (SELECT o_orderkey FROM $T WHERE o_orderkey NOT IN (FROM e) ORDER BY {_p} LIMIT 20) SELECT o_orderkey, o_orderstatus FROM $T WHERE o_orderkey IN (FROM e) OR o_orderkey IN (FROM m)")
query("sample_percent", "orders", lambda d: rows.sample_percent(d.select("o_orderkey"), 1.0, "o_orderkey"), f"SELECT o_orderkey FROM $T ORDER BY {_p} LIMIT (SELECT ceil(count(*) / 100.0)::BIGINT FROM $T)")
query("sample_balanced", "orders", lambda d: rows.sample_balanced(d.select("o_orderkey", "o_orderpriority"), "o_orderpriority", 7, "o_orderkey"), f"SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_p}) AS p FROM $T) WHERE p <= 7")
query("sample_stratified", "orders", lambda d: rows.sample_stratified(d.select("o_orderkey", "o_orderpriority"), "o_orderpriority", 100, "o_orderkey"), f"WITH c AS (SELECT o_orderpriority AS s, count(*) AS n, sum(count(*)) OVER () AS t FROM $T GROUP BY 1), q AS (SELECT s, n * 100 // t AS q, row_number() OVER (ORDER BY (n * 100) % t DESC, s) AS r, 100 - sum(n * 100 // t) OVER () AS o FROM c) SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_p}) AS p FROM $T) JOIN q ON s = o_orderpriority WHERE p <= q + CASE WHEN r <= o THEN 1 ELSE 0 END")
query("strata_advice_orders", "orders", lambda d: rows.strata_advice(d, ["o_orderstatus", "o_orderpriority", "o_custkey"]), "WITH g AS (SELECT 'o_orderstatus' AS field, o_orderstatus AS v, count(*) AS n FROM $T GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM $T GROUP BY 2 UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM $T GROUP BY 2) SELECT field, count(*) AS strata, min(n) AS smallest, max(n) AS largest, CASE WHEN count(*) = 1 THEN 'constant' WHEN count(*) > 50 THEN 'too_many' WHEN min(n) < 5 THEN 'small_strata' ELSE 'fit' END AS risk FROM g GROUP BY field")
query("uniqueness_dirty_ids", "dirty_ids", lambda d: rows.uniqueness(d, "id", ["id", "status"]), "WITH b AS (SELECT count(*) AS records, count(id) AS present, count(DISTINCT id) AS distinct_ids FROM $T), e AS (SELECT sum(c - 1)::BIGINT AS extra_copies, 0::BIGINT AS extra_copies_missing FROM (SELECT count(*) AS c FROM $T GROUP BY id, status)), x AS (SELECT *, records - present AS missing, present - extra_copies - distinct_ids AS residual, records - extra_copies AS u FROM b, e) SELECT records, present, distinct_ids, extra_copies, extra_copies_missing, missing, residual, missing = 0 AND distinct_ids = records AND records >= 2 AS unique_raw, missing = 0 AND residual = 0 AND u >= 2 AS unique_after_dedup, missing = 0 AND u >= 100 AND residual > 0 AND residual <= least(u // 100, floor(sqrt(u)), 1000) AS near_unique, CASE WHEN missing = 0 THEN 'complete' ELSE 'limited' END AS status FROM x")

# Numbers.
query("numeric_c_acctbal", "customer", lambda d: relations.numeric_stats(d, "c_acctbal"), "SELECT count(*) AS n, min(c_acctbal) AS min, max(c_acctbal) AS max, round(sum(c_acctbal), 4) AS sum, round(avg(c_acctbal), 6) AS mean, round(var_pop(c_acctbal), 4) AS variance, round(stddev_pop(c_acctbal), 6) AS std, count(*) FILTER (c_acctbal > 0) AS positive, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal = 0) AS zero, count(*) FILTER (c_acctbal = floor(c_acctbal)) AS integral, round(median(c_acctbal), 6) AS median FROM $T")
query("quantiles_o_totalprice", "orders", lambda d: relations.quantiles(d, "o_totalprice"), "SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS level, round(unnest(quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95])), 6) AS value FROM $T")
query("hist_dense_l_quantity", "lineitem", lambda d: relations.histogram_dense(d, "l_quantity"), "SELECT floor(l_quantity)::BIGINT AS value, count(*) AS cnt FROM $T GROUP BY 1")
query("hist_bins_o_totalprice", "orders", lambda d: relations.histogram_bins(d, "o_totalprice"), "WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM $T) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 100)), 99)::BIGINT AS bin, count(*) AS cnt FROM $T, b GROUP BY 1")
query("hist_grid_c_acctbal", "customer", lambda d: relations.histogram_grid(d, "c_acctbal", 9), "SELECT floor(c_acctbal / 512)::BIGINT AS cell, count(*) AS cnt FROM $T GROUP BY 1")
query("hist_log_l_extendedprice", "lineitem", lambda d: relations.histogram_log(d, "l_extendedprice"), "SELECT floor(log10(l_extendedprice) + 1e-12)::BIGINT AS power, count(*) AS cnt FROM $T WHERE l_extendedprice > 0 GROUP BY 1")
query("shape_l_extendedprice", "lineitem", lambda d: relations.shape(d, "l_extendedprice"), "WITH m AS (SELECT avg(l_extendedprice) AS a, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM $T) SELECT count(*) AS n, round(avg((l_extendedprice - a) ** 3) / avg((l_extendedprice - a) ** 2) ** 1.5, 4) AS skewness, round(avg((l_extendedprice - a) ** 4) / avg((l_extendedprice - a) ** 2) ** 2 - 3, 4) AS kurtosis, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1)) AS below_1_5, count(*) FILTER (l_extendedprice > q3 + 1.5 * (q3 - q1)) AS above_1_5, count(*) FILTER (l_extendedprice < q1 - 3 * (q3 - q1)) AS below_3_0, count(*) FILTER (l_extendedprice > q3 + 3 * (q3 - q1)) AS above_3_0 FROM $T, m")
query("decimal_places_c_acctbal", "customer", lambda d: relations.decimal_places(d, "c_acctbal"), "SELECT CASE WHEN c_acctbal = round(c_acctbal, 0) THEN 0 WHEN c_acctbal = round(c_acctbal, 1) THEN 1 ELSE 2 END::BIGINT AS places, count(*) AS cnt FROM $T GROUP BY 1")
query("stats_price_by_priority", "orders", lambda d: relations.stats_by(d, "o_orderpriority", "o_totalprice"), "SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 4) AS std, round(median(o_totalprice), 6) AS median, grouping(o_orderpriority) = 1 AS overall FROM $T GROUP BY ROLLUP (o_orderpriority)")
query("eta_acctbal_by_segment", "customer", lambda d: relations.correlation_ratio(d, "c_mktsegment", "c_acctbal"), "WITH g AS (SELECT count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS w FROM $T GROUP BY c_mktsegment), t AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb FROM g), e AS (SELECT *, greatest(0.0, least(1.0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw))) AS eps FROM t) SELECT k, n::BIGINT AS n, round(ssb / (ssb + ssw), 6) AS eta2, round(eps, 6) AS epsilon2, round(sqrt(eps), 6) AS score FROM e")

# Pairs.
query("pearson_lineitem", "lineitem", lambda d: relations.pearson(d, ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", "n", F.round("r", 5).alias("r"), "reason"), "SELECT unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) AS a, unnest(['l_extendedprice', 'l_discount', 'l_discount']) AS b, count(*) AS n, round(unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_extendedprice, l_discount)]), 5) AS r, CAST(NULL AS VARCHAR) AS reason FROM $T")
query("spearman_lineitem", "lineitem", lambda d: relations.spearman(d, "l_quantity", "l_extendedprice"), "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM $T) SELECT count(*) AS n, round(corr(x, y), 5) AS rho FROM r")
query("crosstab_status_priority", "orders", lambda d: relations.crosstab(d, "o_orderstatus", "o_orderpriority"), 'SELECT o_orderstatus AS category, o_orderpriority AS "class", count(*) AS cnt FROM $T GROUP BY 1, 2')
query("cramers_v_status_priority", "orders", lambda d: relations.association(d, "o_orderstatus", "o_orderpriority"), "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS o FROM $T GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb FROM c), t AS (SELECT sum(o) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS c, sum(o * o / (ra * cb)) - 1 AS phi2 FROM m) SELECT n::BIGINT AS n, r::BIGINT AS r, c::BIGINT AS c, round(phi2 * n, 4) AS chi2, round(sqrt(phi2 / (least(r, c) - 1)), 6) AS v, round(sqrt(greatest(0, phi2 - (r - 1) * (c - 1) / (n - 1)) / (least(r - (r - 1) ** 2 / (n - 1), c - (c - 1) ** 2 / (n - 1)) - 1)), 6) AS v_corrected, CAST(NULL AS VARCHAR) AS reason FROM t")
query("purity_part", "part", lambda d: relations.purity(d, "p_brand", "p_type"), "WITH c AS (SELECT p_brand AS category, p_type AS k, count(*) AS o FROM $T GROUP BY 1, 2) SELECT category, sum(o)::BIGINT AS n, first(k ORDER BY o DESC, k) AS dominant, max(o) AS dominant_cnt, round(max(o) / sum(o), 6) AS purity, (sum(o) - max(o))::BIGINT AS exceptions FROM c GROUP BY 1")
query("rules_from_crosstab", "dirty_numbers", lambda d: relations.rules(d.selectExpr("cast(r as string) r", "substring(v, 1, 1) = 'a' as k"), "r", "k"), "WITH c AS (SELECT CAST(r AS VARCHAR) AS category, v[1] = 'a' AS k, count(*) AS o FROM $T GROUP BY 1, 2) SELECT category, sum(o)::BIGINT AS n, first(k ORDER BY o DESC, k) AS dominant, max(o) AS dominant_cnt, round(max(o) / sum(o), 6) AS purity, (sum(o) - max(o))::BIGINT AS exceptions FROM c GROUP BY 1 HAVING max(o) >= 0.9 * sum(o) AND sum(o) >= 30")
query("exceptions_part", "part", lambda d: relations.exceptions(d, "p_brand", "p_type", "p_partkey"), 'WITH c AS (SELECT p_brand AS b, p_type AS k, count(*) AS o FROM $T GROUP BY 1, 2), m AS (SELECT b, first(k ORDER BY o DESC, k) AS dom FROM c GROUP BY 1) SELECT category, "class", record, place FROM (SELECT p_brand AS category, p_type AS "class", p_partkey AS record, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey)::INTEGER AS place FROM $T JOIN m ON b = p_brand WHERE p_type <> dom) WHERE place <= 3')
query("near_values", "near", lambda d: relations.near_values(d, "v"), "SELECT unnest(['Nrth', 'Soutth', 'Wast']) AS value, unnest([1, 1, 1])::BIGINT AS cnt, unnest(['North', 'South', 'East']) AS near, unnest([count(*) FILTER (v = 'North'), count(*) FILTER (v = 'South'), count(*) FILTER (v = 'East')]) AS near_cnt FROM $T")

# Missing cells and positions.
query("missing_patterns_docs_labels", "docs_labels", lambda d: relations.missing_patterns(d, ["quality", "toxic", "source"]), "SELECT concat_ws('+', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END, CASE WHEN source IS NULL THEN 'source' END) AS missing, count(*) AS records FROM $T GROUP BY 1")
query("missing_matrix_docs_labels", "docs_labels", lambda d: relations.missing_matrix(d, ["quality", "toxic", "source"]), "SELECT unnest(['quality', 'quality', 'toxic']) AS a, unnest(['toxic', 'source', 'source']) AS b, unnest([count(*) FILTER (quality IS NULL AND toxic IS NULL), count(*) FILTER (quality IS NULL AND source IS NULL), count(*) FILTER (toxic IS NULL AND source IS NULL)]) AS both, round(unnest([count(*) FILTER (quality IS NULL AND toxic IS NULL) / count(*) FILTER (quality IS NULL OR toxic IS NULL), count(*) FILTER (quality IS NULL AND source IS NULL) / count(*) FILTER (quality IS NULL OR source IS NULL), count(*) FILTER (toxic IS NULL AND source IS NULL) / count(*) FILTER (toxic IS NULL OR source IS NULL)]), 6) AS jaccard FROM $T")
query("drift_dirty_events", "dirty_events", lambda d: relations.drift(d, "kind", "event_id"), "WITH p AS (SELECT kind, (row_number() OVER (ORDER BY event_id) - 1) * 10 // (SELECT count(*) FROM $T) AS slice FROM $T), f AS (SELECT kind, min(slice) AS slice FROM p WHERE kind IS NOT NULL GROUP BY 1) SELECT slice, count(*) AS records, count(*) FILTER (kind IS NULL) AS missing, (SELECT count(*) FROM f WHERE f.slice = p.slice) AS new_values FROM p GROUP BY slice")

# Dates.
query("periods_orders_month", "orders", lambda d: relations.periods(d, "o_orderdate", "month"), "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS cnt FROM $T GROUP BY 1")
query("periods_events_day", "events", lambda d: relations.periods(d, "ts", "day"), "SELECT strftime(ts, '%Y-%m-%d') AS period, count(*) AS cnt FROM $T GROUP BY 1")
query("parts_events_weekday_hour", "events", lambda d: relations.date_parts(d, "ts"), "SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, count(*) AS cnt FROM $T GROUP BY 1, 2")
query("decades_orders", "orders", lambda d: relations.decades(d, "o_orderdate"), "SELECT (year(o_orderdate) // 10 * 10)::BIGINT AS decade, count(*) AS cnt FROM $T GROUP BY 1")
query("empty_months_orders", "orders", lambda d: relations.empty_periods(d.where("month(o_orderdate) <> 7"), "o_orderdate"), "WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM $T WHERE month(o_orderdate) <> 7) SELECT strftime(g, '%Y-%m') AS period FROM (SELECT unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH)) AS g FROM m) WHERE g::DATE NOT IN (SELECT m FROM m)")
query("temporal_orders", "orders", lambda d: relations.temporal_stats(d, "o_orderdate"), "SELECT year(o_orderdate) AS year, count(*) AS cnt, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM $T GROUP BY 1")
QUERIES["date_order_orders_ship"] = lambda spark, d: relations.date_order(load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), "o_orderdate", "l_shipdate")
ORACLE_SQL["date_order_orders_ship"] = "SELECT count(*) AS compared, count(*) FILTER (o_orderdate = l_shipdate) AS equal, count(*) FILTER (o_orderdate > l_shipdate) AS broken, 0::BIGINT AS missing FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

# Arrays and objects.
query("array_lengths_embeddings", "embeddings", lambda d: relations.array_profile(d, "embedding"), "SELECT len(embedding) AS length, count(*) AS cnt FROM $T GROUP BY 1")
query("key_sets_events_props", "events", lambda d: relations.key_sets(d, "props"), "SELECT array_to_string(list_sort(json_keys(props)), ',') AS keys, count(*) AS cnt FROM $T GROUP BY 1")

# Quality.
query("classify_contacts", "people", lambda d: quality.classify(d.select("id", "email", "phone", "postal", "uuid", "ip", "url")).select("field", "family", "type", "role"), "SELECT unnest(['id', 'email', 'phone', 'postal', 'uuid', 'ip', 'url']) AS field, unnest(['numeric', 'contact', 'contact', 'geographic', 'web_network', 'web_network', 'web_network']) AS family, unnest(['integer', 'email', 'phone', 'postal_code', 'uuid', 'ip_address', 'url']) AS type, unnest(['unique_id', NULL, NULL, NULL, NULL, NULL, NULL]) AS role")
query("minority_lengths_contacts", "faults", lambda d: quality.minority_lengths(d, "code"), "SELECT length(code) AS length, count(*) AS cnt, 6::BIGINT AS usual FROM $T WHERE length(code) <> 6 GROUP BY 1")
query("residual_dates", "dirty_dates", lambda d: quality.residuals(d, "v", "date", "id"), "SELECT v AS value, count(*) AS cnt, min(id) AS first_rec, CASE r WHEN 2 THEN 'invalid' ELSE 'not_matched' END AS state FROM $T WHERE r IN (2, 5) GROUP BY v, r")
query("measures_dirty_numbers", "dirty_numbers", lambda d: quality.measures(d, "v"), "SELECT marker, count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean FROM (SELECT CASE r WHEN 4 THEN '$' WHEN 5 THEN 'kg' ELSE '%' END AS marker, CASE r WHEN 4 THEN id + 0.25 WHEN 5 THEN id ELSE id % 100 END::DOUBLE AS x FROM $T WHERE r IN (4, 5, 6)) GROUP BY 1")

# Rules, anomalies and generated tables.
query("rules_eval_orders", "orders", lambda d: generate.evaluate(d, {"priced": {"gt": ["o_totalprice", 1000]}, "status": {"in": ["o_orderstatus", ["F", "O"]]}, "late": {"implies": [{"eq": ["o_orderstatus", "F"]}, {"lt": ["o_totalprice", 200000]}]}, "key": {"unique": "o_orderkey"}}), "SELECT unnest(['priced', 'status', 'late', 'key']) AS rule, unnest([count(*) FILTER (o_totalprice > 1000), count(*) FILTER (o_orderstatus IN ('F', 'O')), count(*) FILTER (o_orderstatus <> 'F' OR o_totalprice < 200000), count(*)]) AS holds, unnest([count(*) FILTER (o_totalprice <= 1000), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')), count(*) FILTER (o_orderstatus = 'F' AND o_totalprice >= 200000), 0]) AS broken, 0::BIGINT AS unknown FROM $T")
query("anomaly_journal_orders", "orders", lambda d: generate.inject(d.select("o_orderkey", "o_orderpriority"), "o_orderkey", [{"kind": "format", "transform": "lower", "column": "o_orderpriority", "count": 40}])[1], "SELECT o_orderkey AS record, 'o_orderpriority' AS \"column\", 'lower' AS operation, o_orderpriority AS before, lower(o_orderpriority) AS after FROM (SELECT * FROM $T ORDER BY md5('42|format0|o_orderpriority|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 40) WHERE lower(o_orderpriority) <> o_orderpriority")
query("truth_orders", "orders", lambda d: generate.truth(d.select("o_orderkey", "o_orderstatus"), d.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 10 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus"), "o_orderkey"), "SELECT o_orderkey AS record, 'o_orderstatus' AS \"column\", o_orderstatus AS before, lower(o_orderstatus) AS after FROM $T WHERE o_orderkey % 10 = 0")
query("split_orders", "orders", lambda d: generate.split(d.select("o_orderkey", "o_custkey"), "o_custkey", {"train": 0.8, "test": 0.2}), "SELECT o_orderkey, o_custkey, CASE WHEN ('0x' || md5('42|split|o_custkey|value|' || CAST(o_custkey AS VARCHAR))[1:12])::BIGINT / 281474976710656.0 < 0.8 THEN 'train' ELSE 'test' END AS split FROM $T")
QUERIES["generate_table"] = lambda spark, d: generate.table(spark, "t", 1000, {"id": {"kind": "sequence"}, "n": {"kind": "integer", "min": 1, "max": 6}, "c": {"kind": "choice", "values": ["a", "b"], "weights": [3, 1]}})
ORACLE_SQL["generate_table"] = "WITH r AS (SELECT unnest(range(1000)) AS i), u AS (SELECT i, ('0x' || md5('42|t|n|value|' || CAST(i AS VARCHAR))[1:12])::BIGINT / 281474976710656.0 AS n, ('0x' || md5('42|t|c|value|' || CAST(i AS VARCHAR))[1:12])::BIGINT / 281474976710656.0 AS c FROM r) SELECT i + 1 AS id, floor(1 + n * 6)::BIGINT AS n, CASE WHEN c < 0.75 THEN 'a' ELSE 'b' END AS c FROM u"

# Patterns.
query("pattern_structures_brand", "part", lambda d: patterns.structures(d, "p_brand"), "SELECT 'ULP#D' AS structure, count(DISTINCT p_brand) AS distinct_values, count(*) AS occurrences, 1.0::DOUBLE AS score, true AS material FROM $T")
query("pattern_signatures_brand", "part", lambda d: patterns.patterns(d, "p_brand").select("structure", "signature", "distinct_values", "occurrences", "score"), "WITH g AS (SELECT length(p_brand) AS k, count(DISTINCT p_brand) AS d, count(*) AS o FROM $T GROUP BY 1), t AS (SELECT sum(d) AS td, sum(o) AS tot FROM g) SELECT 'ULP#D' AS structure, '''Brand#''' || repeat('9', k - 6) AS signature, d AS distinct_values, o AS occurrences, round(greatest(d / td, o / tot), 9)::DOUBLE AS score FROM g, t")
query("pattern_signature_c_name", "customer", lambda d: patterns.patterns(d, "c_name").select("signature", "distinct_values", "occurrences"), "SELECT '''Customer#000''999999' AS signature, count(DISTINCT c_name) AS distinct_values, count(*) AS occurrences FROM $T")
query("pattern_validation_brand", "part", lambda d: patterns.validate(d, "p_brand", patterns.patterns(d.where("length(p_brand) = 7"), "p_brand")), "SELECT CASE WHEN length(p_brand) = 7 THEN 'known' ELSE 'new_length' END AS outcome, count(DISTINCT p_brand) AS distinct_values, count(*) AS occurrences FROM $T GROUP BY 1")
query("pattern_eligibility_c_name", "customer", lambda d: patterns.eligibility(d, "c_name"), "SELECT count(DISTINCT c_name) AS distinct_values, 1.0::DOUBLE AS top_share, true AS eligible FROM $T")
_place = "CASE WHEN o_orderkey % 2 = 0 THEN 'QC' ELSE 'ON' END"
_code = _place + " || lpad(cast(o_orderkey * 7919 % 10000 AS string), 4, '0')"
_gains = "greatest(d * (b + log2(d / ad)) - b - 2, o * (b + log2(o / ao)) - b - 2)"
query("pattern_heads_codes", "orders", lambda d: patterns.heads(d.selectExpr(_code + " v"), "v").select("structure", "place", "head", "distinct_values", "occurrences", F.round("gain", 4).alias("gain")), f"WITH v AS (SELECT {_place} AS h, {_code} AS v FROM $T), g AS (SELECT h, count(DISTINCT v) AS d, count(*) AS o FROM v GROUP BY 1), t AS (SELECT sum(d) AS ad, sum(o) AS ao, 2 * log2(26) AS b FROM g) SELECT 'UD' AS structure, 0 AS place, h AS head, d AS distinct_values, o AS occurrences, round({_gains}, 4) AS gain FROM g, t")
_plate = "CASE WHEN o_orderkey % 10 = 0 THEN '7' ELSE 'A' END || lpad(cast(o_orderkey % 1000 AS string), 3, '0')"
query("pattern_edge_merges", "orders", lambda d: patterns.edge_merges(d.selectExpr(_plate + " v"), "v"), f"SELECT '9999' AS form, 'A999' AS into, 'X999' AS merged, count(DISTINCT {_plate}) AS distinct_values, count(*) AS occurrences FROM $T WHERE o_orderkey % 10 = 0")

# Exploration, covering samples, windows.
query("explore_facts_events", "events", lambda d: explore.facts(d.select("event_id", "event_type", "user_id")), "SELECT 'event_id' AS field, 'integer' AS native_type, count(event_id) AS present, count(DISTINCT event_id) AS distinct_values, true AS identifier_like, false AS category_like FROM $T UNION ALL SELECT 'event_type', 'string', count(event_type), count(DISTINCT event_type), false, true FROM $T UNION ALL SELECT 'user_id', 'integer', count(user_id), count(DISTINCT user_id), false, count(DISTINCT user_id) BETWEEN 2 AND 50 FROM $T")
query("explore_number_pairs_lineitem", "lineitem", lambda d: explore.number_pairs(d, ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", "n", F.round("r", 5).alias("r")), "SELECT unnest(['l_quantity', 'l_quantity', 'l_extendedprice']) AS a, unnest(['l_extendedprice', 'l_discount', 'l_discount']) AS b, count(*) AS n, round(unnest([corr(l_quantity, l_extendedprice), corr(l_quantity, l_discount), corr(l_extendedprice, l_discount)]), 5) AS r FROM $T")
query("explore_category_tables_orders", "orders", lambda d: explore.category_tables(d, ["o_orderstatus", "o_orderpriority"]).drop("chosen"), "SELECT 'o_orderstatus' AS a, 'o_orderpriority' AS b, n, v, v_corrected, 1 AS place FROM (" + ORACLE_SQL["cramers_v_status_priority"] + ")")
query("explore_numbers_by_category", "customer", lambda d: explore.numbers_by_category(d, ["c_mktsegment"], ["c_acctbal"]).drop("chosen"), "SELECT 'c_mktsegment' AS a, 'c_acctbal' AS b, n, k, epsilon2, 1 AS place FROM (" + ORACLE_SQL["eta_acctbal_by_segment"] + ")")
QUERIES["explore_date_orders"] = lambda spark, d: explore.date_orders(load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")), ["o_orderdate", "l_shipdate"])
ORACLE_SQL["explore_date_orders"] = "WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderdate <= l_shipdate) AS f, count(*) FILTER (l_shipdate <= o_orderdate) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT CASE WHEN f >= b THEN 'o_orderdate' ELSE 'l_shipdate' END AS first, CASE WHEN f >= b THEN 'l_shipdate' ELSE 'o_orderdate' END AS second, n AS compared, greatest(f, b) AS ordered, round(greatest(f, b) / n, 6) AS share, greatest(f, b) / n >= 0.99 AS holds FROM c"
query("smart_coverage_orders", "orders", lambda d: smart.sample(d, "o_orderkey", ["o_orderstatus", "o_orderpriority"], 40)[1].select("target", "rows", (F.col("taken") > 0).alias("covered")), "SELECT 'o_orderstatus=' || o_orderstatus AS target, count(*) AS rows, true AS covered FROM $T GROUP BY 1 UNION ALL SELECT 'o_orderpriority=' || o_orderpriority, count(*), true FROM $T GROUP BY 1")
QUERIES["smart_sample_orders"] = lambda spark, d: smart.sample(load(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_totalprice"], 60)[0]
query("windows_events", "events", lambda d: streaming.windowed(d, "ts", "event_type", "1 hour"), "SELECT date_trunc('hour', ts) AS start, event_type AS key, count(*) AS cnt FROM $T GROUP BY 1, 2")

# Ends of tokens, related tables, labels, broken files.
_tail = "CASE WHEN o_orderkey % 2 = 0 THEN 'QC' ELSE 'ON' END"
_ending = "lpad(cast(o_orderkey * 7919 % 10000 AS string), 4, '0') || " + _tail
query("pattern_tails_codes", "orders", lambda d: patterns.tails(d.selectExpr(_ending + " v"), "v").select("structure", "place", "tail", "distinct_values", "occurrences", F.round("gain", 4).alias("gain")), f"WITH v AS (SELECT {_tail} AS h, {_ending} AS v FROM $T), g AS (SELECT h, count(DISTINCT v) AS d, count(*) AS o FROM v GROUP BY 1), t AS (SELECT sum(d) AS ad, sum(o) AS ao, 2 * log2(26) AS b FROM g) SELECT 'DU' AS structure, 1 AS place, h AS tail, d AS distinct_values, o AS occurrences, round({_gains}, 4) AS gain FROM g, t")
_u = lambda table, column, key: f"('0x' || md5('42|{table}|{column}|value|' || {key})[1:12])::BIGINT / 281474976710656.0"
QUERIES["population_customers"] = lambda spark, d: population.population(spark, 2000)["customers"].select("household_id", "customer_id", "province", "language", "email")
ORACLE_SQL["population_customers"] = f"WITH h AS (SELECT 'H' || i AS household_id FROM range(2000) t(i)), g AS (SELECT household_id, {_u('households', 'province', 'household_id')} AS p, {_u('households', 'size', 'household_id')} AS s FROM h), n AS (SELECT household_id, CASE WHEN p < 0.5 THEN 'QC' WHEN p < 0.75 THEN 'ON' WHEN p < 0.87 THEN 'BC' WHEN p < 0.96 THEN 'AB' ELSE 'NB' END AS province, unnest(range(1, CASE WHEN s < 0.3 THEN 2 WHEN s < 0.68 THEN 3 WHEN s < 0.84 THEN 4 WHEN s < 0.96 THEN 5 ELSE 6 END)) AS i FROM g), c AS (SELECT household_id, household_id || '-' || i AS customer_id, province FROM n) SELECT household_id, customer_id, province, CASE WHEN {_u('customers', 'language', 'customer_id')} < CASE WHEN province = 'QC' THEN 0.85 ELSE 0.1 END THEN 'fr' ELSE 'en' END AS language, CASE WHEN {_u('customers', 'email', 'customer_id')} < 0.9 THEN lower(customer_id) || '@example.org' END AS email FROM c"
QUERIES["population_contracts"] = lambda spark, d: population.flattened(population.population(spark, 2000))
query("ml_labels_orders", "orders", lambda d: population.labels(d, "o_orderkey", F.col("o_totalprice") > 250000), f"WITH l AS (SELECT o_orderkey, o_totalprice > 250000 AS is_fraud, {_u('labels', 'noise', 'o_orderkey')} < 0.02 AS is_noisy, {_u('labels', 'delay', 'o_orderkey')} < 0.1 AS is_delayed FROM $T) SELECT o_orderkey, is_fraud, CASE WHEN NOT is_delayed THEN is_fraud <> is_noisy END AS observed_fraud, is_noisy, is_delayed FROM l")
query("ml_latent_orders", "orders", lambda d: population.latent(population.labels(d, "o_orderkey", F.col("o_totalprice") > 250000), "o_orderkey").select("o_orderkey", F.col("latent_fraud_probability").alias("chance"), F.expr("latent_fraud_probability between 0 and 1").alias("valid")), f"SELECT o_orderkey, round(CASE WHEN o_totalprice > 250000 THEN 0.35 + 0.6 * u ELSE 0.6 * pow(u, 2) END, 4) AS chance, true AS valid FROM (SELECT *, {_u('latent', 'fraud', 'o_orderkey')} AS u FROM $T)")

from assaykit.plans import extended  # noqa: E402, F401  # registers the rest
