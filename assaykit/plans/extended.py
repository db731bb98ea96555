"""More registered queries: forms of detectors, findings, sources, stores, reports, generation and order over ranges."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions import detectors
from assaykit.operators import generate, patterns, population, quality, relations, reports, rows, store, values
from assaykit.plans.catalogue import ORACLE_SQL, QUERIES, load, query, view
from assaykit.sources import readers


def text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


# Detectors, by forms: each customer has one of them.


def forms(name: str, which: str | Callable, cases: list[tuple[str, str | None, str | None, str | None]]) -> None:
    """(value, state, format, reason) of each form; state null: not matched."""
    key = f"c_custkey % {len(cases)}"
    value = "CASE " + " ".join(f"WHEN {key} = {i} THEN {text(v)}" for i, (v, *_) in enumerate(cases)) + " END"
    table = f"(SELECT c_custkey, {key} AS r FROM customer)"
    told = ", ".join(f"({i}, {text(v)}, {text(s or 'not_matched')}, {text(f)}, {text(w)})" for i, (v, s, f, w) in enumerate(cases))
    QUERIES[name] = lambda spark, d: detectors.coverage(load(spark, d, "customer").groupBy(F.expr(value).alias("analytical")).agg(F.count("*").alias("cnt")), which)
    ORACLE_SQL[name] = f"SELECT state, format, reason, count(*) AS occurrences, count(DISTINCT v) AS distinct_values FROM {table} JOIN (VALUES {told}) t(i, v, state, format, reason) ON r = i GROUP BY 1, 2, 3"


forms("forms_currency", "currency", [("US$5", "matched", "before", None), ("CA$ 12.50", "matched", "before", None), ("C$7", "matched", "before", None), ("12 TRY", "matched", "after", None), ("5 ZAR", "matched", "after", None), ("(1,234.50 €)", "matched", "after", None), ("-$5", "matched", "before", None), ("$-5", "matched", "before", None), ("XYZ 5", None, None, None), ("JPY 1,234", "ambiguous", "before", "dot_or_comma"), ("ABC", None, None, None), ("12", None, None, None), ("£1.5", "matched", "before", None)])
forms("forms_phone", "phone", [("(514) 555-0005", "matched", "(999) 999-9999", None), ("+1 514 555 0123", "matched", "+1 999 999 9999", None), ("1-800-555-0199", "matched", "1-999-999-9999", None), ("514.555.0100", "matched", "999.999.9999", None), ("0033 (0)1.23.45.67.89", "matched", "0033 (0)9.99.99.99.99", None), ("01-23-45-67-89", "matched", "09-99-99-99-99", None), ("+33 01 23 45 67 89", "invalid", None, "invalid_trunk_prefix"), ("00 23 45 67 89", "invalid", None, "invalid_leading_digit"), ("(114) 555-0123", "invalid", None, "invalid_area_code"), ("514-155-0123", "invalid", None, "invalid_exchange_code"), ("5145550123", "matched", "9999999999", None), ("1145550123", None, None, None), ("123-45-67-8", None, None, None)])
forms("forms_date", "date", [("9:05", "matched", "time", None), ("25:00", "invalid", "time", "invalid_time"), ("1er janvier 2024", "matched", "day_month_name", None), ("31 avril 2024", "invalid", "day_month_name", "invalid_calendar_date"), ("Mar 5, 2024", "matched", "month_name_day", None), ("2024/3/5", "matched", "ymd", None), ("13-01-2024", "matched", "dmy", None), ("01-13-2024", "matched", "mdy", None), ("05.05.2024", "matched", "same_day", None), ("03/04/2024", "ambiguous", "dmy_or_mdy", "day_or_month_first"), ("32/01/2024", "invalid", "dmy_or_mdy", "invalid_calendar_date"), ("1-2/2024", "invalid", "date", "mixed_separators"), ("2024-03-05 10:20", "matched", "datetime_naive", None), ("2024-03-05T10:20:30.123+02:00", "matched", "datetime_aware", None), ("2024-03-05T24:00:00Z", "invalid", "datetime_aware", "invalid_time"), ("2024-02-30T10:00:00", "invalid", "datetime_naive", "invalid_calendar_date"), ("5 abc 2024", None, None, None), ("2024", None, None, None)])
forms("forms_number", "number", [("0", "matched", "integer", None), ("-12", "matched", "integer", None), ("007", None, None, None), ("1.5e3", "matched", "number", None), (".5", "matched", "number", None), ("1,234", "ambiguous", "number", "dot_or_comma"), ("1.234", "matched", "number", None), ("1,234,567", "matched", "dot", None), ("1.234.567,8", "matched", "comma", None), ("12,5", "matched", "comma", None), ("1 234 567", "matched", "dot", None), ("1,23,456", None, None, None), ("--1", None, None, None)])
forms("forms_quantity", "quantity", [("5 kg", "matched", "quantity", None), ("12.5km/h", "matched", "quantity", None), ("3°C", "matched", "quantity", None), ("5 ZAR", None, None, None), ("12 TRY", None, None, None), ("3rd", None, None, None), ("2ème", None, None, None), ("1,234 m²", "ambiguous", "quantity", "dot_or_comma"), ("kg", None, None, None), ("4 toolongunitname", None, None, None)])
forms("forms_ip", "ip_address", [("10.0.0.1", "matched", "ipv4", None), ("256.1.1.1", "invalid", "ipv4", "octet_out_of_range"), ("1.2.3.04", "invalid", "ipv4", "leading_zero"), ("::1", "matched", "ipv6", None), ("fe80::1", "matched", "ipv6", None), ("1::2::3", None, None, None), ("2001:db8:0:0:0:0:0:1", "matched", "ipv6", None), ("1.2.3", None, None, None)])
forms("forms_url", "url", [("https://a.example/x?y=1", "matched", "https", None), ("ftp://files.example.org", "matched", "ftp", None), ("www.example.org/a", "matched", "www", None), ("http://host:70000/", "invalid", "url", "invalid_port"), ("http://bad_host/", "invalid", "url", "invalid_host"), ("http://a.example/%zz", "invalid", "url", "invalid_escape"), ("example.org", None, None, None), ("mailto:a@b.c", None, None, None)])
forms("forms_email", "email", [("a.b+c@mail.example.org", "matched", "email", None), ("a@b", "invalid", "email", "invalid_domain"), (".a@example.com", "invalid", "email", "invalid_local_part"), ("a..b@example.com", "invalid", "email", "invalid_local_part"), ("x" * 65 + "@example.com", "invalid", "email", "local_part_too_long"), ("a@-b.com", "invalid", "email", "invalid_domain"), ("a b@example.com", None, None, None), ("a@b@c.com", None, None, None)])
forms("forms_postal", "postal_code", [("H2X 1Y4", "matched", "A9A 9A9", None), ("h2x1y4", "matched", "A9A9A9", None), ("D2X 1Y4", "invalid", "canadian", "forbidden_letter"), ("W2X 1Y4", "invalid", "canadian", "forbidden_letter"), ("90210", "matched", "99999", None), ("90210-1234", "matched", "99999-9999", None), ("9021", None, None, None)])

_classes = {"(514) 555-0005": "nanp_geographic", "1-800-555-0199": "nanp_toll_free", "+1 900 555 0100": "nanp_premium", "06 12 34 56 78": "fr_06", "+33 1 23 45 67 89": "fr_01", "none": None}
QUERIES["phone_classes"] = lambda spark, d: load(spark, d, "customer").select(F.get(F.array(*map(F.lit, _classes)), (F.col("c_custkey") % len(_classes)).cast("int")).alias("v")).groupBy("v").agg(F.count("*").alias("cnt")).select("v", detectors.phone_class(F.col("v")).alias("class"), "cnt")
ORACLE_SQL["phone_classes"] = f"SELECT v, class, count(*) AS cnt FROM customer JOIN (VALUES {', '.join(f'({i}, {text(v)}, {text(c)})' for i, (v, c) in enumerate(_classes.items()))}) t(i, v, class) ON c_custkey % {len(_classes)} = i GROUP BY 1, 2"
_dates = lambda d: d.groupBy(F.col("v").alias("analytical")).agg(F.count("*").alias("cnt"))
query("date_evidence_dirty", "dirty_dates", lambda d: detectors.date_evidence(_dates(d)), "SELECT count(*) FILTER (r = 1 AND d > 12) AS day_first, 0::BIGINT AS month_first, count(*) FILTER (r = 1 AND d <= 12 AND d <> 3) AS ambiguous, CASE WHEN count(*) FILTER (r = 1 AND d > 12) >= 3 THEN 'DMY' END AS \"order\" FROM $T")
query("date_simulated_dirty", "dirty_dates", lambda d: detectors.simulated(_dates(d)), "WITH a AS (SELECT d FROM $T WHERE r = 1 AND d <= 12 AND d <> 3) SELECT 'DMY' AS \"order\", '2024-03' AS period, count(*) AS occurrences FROM a HAVING count(*) > 0 UNION ALL SELECT 'MDY', '2024-' || lpad(d::VARCHAR, 2, '0'), count(*) FROM a GROUP BY d")
query("instants_orders", "orders", lambda d: d.select("o_orderkey", detectors.instant(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), detectors.instant(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T02:30+02:00"))).alias("zoned"), detectors.instant(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 02:30:01.5"))).alias("naive"), detectors.instant(F.lit("9:05")).alias("clock")), "SELECT o_orderkey, epoch_us(o_orderdate::DATE::TIMESTAMP) AS day, epoch_us(o_orderdate::DATE::TIMESTAMP) + 1800000000 AS zoned, epoch_us(o_orderdate::DATE::TIMESTAMP) + 9001500000 AS naive, 32700000000 AS clock FROM $T")

# Findings and observations.
_rules = {
    "d": [("temporal.ambiguous_date", "issue", "k % 25 = 1", "k % 25 <> 0"), ("temporal.invalid_calendar", "error", "k % 25 = 0", "true")],
    "e": [("semantic.invalid", "error", "k % 20 = 0", "true")],
    "num": [("type.outside_family", "error", "k % 40 = 0", "true"), ("number.ambiguous", "issue", "k % 40 = 1", "true"), ("length.minority", "issue", "k % 40 = 1", "true")],
    "cat": [("text.surrounding_whitespace", "issue", "k % 3 = 2", "true"), ("text.repeated_whitespace", "issue", "k % 3 = 2", "true")],
    "code": [("length.minority", "issue", "k % 50 = 0", "true")],
    "mixed": [("type.mixed", "issue", "k % 5 < 2", "true")],
    "one": [("values.constant_column", "information", "true", "true")],
    "none": [("presence.empty_column", "information", "true", "true")],
}
_found = [f"SELECT '{f}' AS field, '{c}' AS code, '{k}' AS class, count(*) FILTER ({n}) AS count, count(*) FILTER ({of}) AS of FROM $T" for f, xs in _rules.items() for c, k, n, of in xs]
_found += [f"SELECT '{f}', 'pattern.minority', 'issue', {n}::BIGINT, count(DISTINCT {f}) FROM $T" for f, n in (("e", 1), ("num", 2), ("code", 1), ("mixed", 1))]
_found += ["SELECT 'cat', 'categorical.case_variants', 'issue', 1::BIGINT, NULL FROM $T LIMIT 1", *[f"SELECT '{f}', 'identifier.repetition', 'issue', count({f}) - count(DISTINCT {f}), count({f}) FROM $T" for f in ("client_id",)]]
query("findings_faults", "faults", lambda d: quality.findings(d.drop("k")), " UNION ALL ".join(f"({x})" for x in _found))
query("signals_faults", "faults", lambda d: quality.signals(quality.findings(d.drop("k"))), f"SELECT class, code, count(*) AS fields, sum(count)::BIGINT AS occurrences FROM ({' UNION ALL '.join(f'({x})' for x in _found)}) GROUP BY 1, 2")
query("findings_dirty_dates", "dirty_dates", lambda d: quality.findings(d.select("v")).where("code not in ('pattern.minority', 'length.minority')"), "SELECT 'v' AS field, 'temporal.ambiguous_date' AS code, 'issue' AS class, count(*) FILTER (r = 1 AND d <= 12 AND d <> 3) AS count, count(*) FILTER (r NOT IN (2, 5)) AS of FROM $T UNION ALL SELECT 'v', 'type.mixed', 'issue', count(*) - greatest(count(*) FILTER (r IN (0, 1, 4)), count(*) FILTER (r IN (2, 3, 5))), count(*) FROM $T UNION ALL SELECT 'v', 'temporal.invalid_calendar', 'error', count(*) FILTER (r = 2), count(*) FROM $T")
_content = "kind IS NOT NULL AND trim(kind) <> ''"
query("observations_dirty_events", "dirty_events", lambda d: quality.observations(d.select("kind", "value", "note"), ["kind", "value", "note", "kind"], 3), f"""WITH t AS (SELECT kind, value, note FROM $T), n AS (SELECT count(*) AS n FROM t), o AS (
    SELECT 'kind' AS field, 'missing_values' AS rule, count(*) FILTER (NOT ({_content}) OR kind IS NULL) AS count, count(*) AS of FROM t UNION ALL SELECT 'value', 'missing_values', count(*) FILTER (value IS NULL), count(*) FROM t UNION ALL SELECT 'note', 'missing_values', count(*) FILTER (note IS NULL), count(*) FROM t
    UNION ALL SELECT 'note', 'constant_column', count(note), count(*) FROM t UNION ALL SELECT 'kind', 'trimmed_cells', count(*) FILTER ({_content} AND kind <> trim(kind)), count(*) FILTER ({_content}) FROM t
    UNION ALL SELECT 'kind', 'variant_groups', count(*), NULL FROM (SELECT lower(trim(kind)) AS k FROM t WHERE {_content} GROUP BY 1 HAVING count(DISTINCT kind) >= 2)
    UNION ALL SELECT 'kind', 'ambiguous_header', 2, NULL UNION ALL SELECT NULL, 'excluded_records', 3, n + 3 FROM n UNION ALL SELECT NULL, 'duplicate_rows', n - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)), n FROM n)
    SELECT * FROM o WHERE count > 0""")
query("missing_findings_dirty_events", "dirty_events", lambda d: quality.missing_findings(d.select("kind", "note")), "SELECT 'kind' AS field, count(*) FILTER (kind IS NULL OR trim(kind) = '') AS count, count(*) AS of, round(count(*) FILTER (kind IS NULL OR trim(kind) = '') / count(*), 4) AS share, count(*) FILTER (kind IS NULL) AS n_null, count(*) FILTER (kind = '') AS n_empty, count(*) FILTER (kind <> '' AND trim(kind) = '') AS n_blank, 0::BIGINT AS n_marker FROM $T UNION ALL SELECT 'note', count(*) FILTER (note IS NULL), count(*), round(count(*) FILTER (note IS NULL) / count(*), 4), count(*) FILTER (note IS NULL), 0, 0, 0 FROM $T")

query("classify_faults", "faults", lambda d: quality.classify(d.select("d", "e", "cat", "one", "none", "client_id", "mixed")).select("field", "family", "type", "role", "traits"), "SELECT unnest(['d', 'e', 'cat', 'one', 'none', 'client_id', 'mixed']) AS field, unnest(['temporal', 'contact', 'categorical', 'categorical', 'other', 'text', 'other']) AS family, unnest(['date', 'email', 'enum', 'constant', 'empty', 'text_' || CASE WHEN (SELECT median(length(client_id)) FROM $T) <= 5 THEN 'very_short' ELSE 'short' END, 'mixed']) AS type, unnest([NULL, NULL, NULL, NULL, NULL, 'identifier', NULL]) AS role, unnest(['first_column,fixed_length', 'high_cardinality', '', 'constant,fixed_length', '', '', '']) AS traits")

# Order over ranges, features and blocks.
query("occurrences_dup_recs", "dup_recs", lambda d: rows.occurrences(d, "rec"), "SELECT rec AS record, row_number() OVER (PARTITION BY status, priority, day ORDER BY rec) AS occurrence FROM $T")
query("frequency_table_clerk", "part", lambda d: store.frequency_table(d, "p_brand"), "SELECT row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS place, p_brand AS value, count(*) AS cnt FROM $T GROUP BY p_brand")
query("boolean_counts_labels", "docs_labels", lambda d: relations.boolean_counts(d.withColumn("b", F.col("toxic") == 1), "b"), "SELECT count(*) FILTER (toxic = 1) AS true_count, count(*) FILTER (toxic <> 1) AS false_count, count(*) FILTER (toxic IS NULL) AS missing FROM (SELECT toxic FROM documents LEFT JOIN labels USING (doc_id))")
query("equal_count_edges_acctbal", "customer", lambda d: relations.equal_count_edges(d, "c_acctbal", 4), "WITH e AS (SELECT quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]) AS q FROM $T) SELECT bin::BIGINT AS bin, round(q[bin + 1], 6) AS lo, round(q[bin + 2], 6) AS hi, count(*) AS cnt FROM (SELECT q, CASE WHEN c_acctbal >= q[4] THEN 3 WHEN c_acctbal >= q[3] THEN 2 WHEN c_acctbal >= q[2] THEN 1 ELSE 0 END AS bin FROM $T, e) GROUP BY 1, 2, 3")
query("grid_smallest_acctbal", "customer", lambda d: relations.histogram_grid(d, "c_acctbal", relations.smallest_exponent(d, "c_acctbal", 64)), "WITH s AS (SELECT min(e) AS e FROM range(-64, 64) t(e), (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM $T) WHERE floor(hi / pow(2, e)) - floor(lo / pow(2, e)) + 1 <= 64) SELECT floor(c_acctbal / pow(2, e))::BIGINT AS cell, count(*) AS cnt FROM $T, s GROUP BY 1")
query("periods_auto_orders", "orders", lambda d: relations.periods(d, "o_orderdate", relations.unit_for(d, "o_orderdate")), "WITH u AS (SELECT date_diff('day', min(o_orderdate), max(o_orderdate)) AS d FROM $T) SELECT CASE WHEN d <= 732 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN d <= 60 * 366 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS period, count(*) AS cnt FROM $T, u GROUP BY 1")
query("date_summary_orders", "orders", lambda d: relations.date_summary(d, "o_orderdate", "1996-01-01"), "SELECT 'month' AS part, strftime(o_orderdate, '%Y-%m') AS value, count(*) AS cnt FROM $T GROUP BY 2 UNION ALL SELECT 'weekday', (isodow(o_orderdate) - 1)::VARCHAR, count(*) FROM $T GROUP BY 2 UNION ALL SELECT 'hour', hour(o_orderdate)::VARCHAR, count(*) FROM $T GROUP BY 2 UNION ALL SELECT 'after', 'yes', count(*) FROM $T WHERE o_orderdate::DATE > DATE '1996-01-01' HAVING count(*) > 0")
query("crosstab_prefix_part", "part", lambda d: relations.crosstab(d, "p_brand", "p_type", "prefix"), "SELECT p_brand AS category, left(p_type, 2) AS class, count(*) AS cnt FROM $T GROUP BY 1, 2")
query("crosstab_length_part", "part", lambda d: relations.crosstab(d, "p_brand", "p_type", "length"), "SELECT p_brand AS category, length(p_type)::VARCHAR AS class, count(*) AS cnt FROM $T GROUP BY 1, 2")
query("missing_blocks_gaps", "gaps", lambda d: relations.missing_blocks(d, ["a", "b", "c"]), "SELECT 'a+b' AS columns, count(*) FILTER (k % 4 = 0) AS records, round(count(*) FILTER (k % 4 = 0) / count(*) FILTER (b IS NULL), 6) AS share FROM $T")
query("rank_interval_nations", "nation", lambda d: d.select("n_nationkey", relations.rank_interval(F.col("n_nationkey") / 30.0, F.col("n_nationkey") + 2).alias("x")).select("n_nationkey", "x.lo", "x.hi"), "WITH r AS (SELECT n_nationkey, n_nationkey / 30.0 AS r, n_nationkey + 2 AS n FROM $T), z AS (SELECT *, CASE WHEN n >= 4 THEN 1.96 * sqrt((1 + r * r / 2) / (n - 3)) END AS e FROM r) SELECT n_nationkey, round((exp(2 * (atanh(r) - e)) - 1) / (exp(2 * (atanh(r) - e)) + 1), 6) AS lo, round((exp(2 * (atanh(r) + e)) - 1) / (exp(2 * (atanh(r) + e)) + 1), 6) AS hi FROM z")
QUERIES["binned_spearman_lineitem"] = lambda spark, d: relations.binned_spearman(load(spark, d, "lineitem"), "l_quantity", "l_extendedprice")

query("character_families_part", "part", lambda d: values.character_families(d, "p_name"), "WITH c AS (SELECT unnest(regexp_extract_all(p_name, '.')) AS ch FROM $T) SELECT CASE WHEN ch = ' ' THEN 'separator/Zs' WHEN regexp_matches(ch, '[a-z]') THEN 'letter/Ll' WHEN regexp_matches(ch, '[A-Z]') THEN 'letter/Lu' WHEN regexp_matches(ch, '[0-9]') THEN 'number/Nd' WHEN ch = '-' THEN 'punctuation/Pd' ELSE 'punctuation/Po' END AS family, count(*) AS occurrences, count(DISTINCT ch) AS characters FROM c GROUP BY 1")
query("length_quartiles_part", "part", lambda d: values.derived_lengths(d, "p_name"), "WITH r AS (SELECT length(p_name) AS length, row_number() OVER (ORDER BY length(p_name)) AS i, count(*) OVER () AS n FROM $T) SELECT q AS quarter, min(length) AS length FROM r, range(5) t(q) WHERE i = greatest(ceil(n * q / 4), 1) GROUP BY q")
query("frequency_tail_clerk", "orders", lambda d: values.frequency_tail(d, "o_custkey", 5), "WITH c AS (SELECT o_custkey AS v, count(*) AS n FROM $T GROUP BY 1), f AS (SELECT sum(n) AS s, max(n) AS m FROM (SELECT n FROM c ORDER BY n DESC, v LIMIT 5)) SELECT count(*) AS distinct_values, sum(n)::BIGINT AS occurrences, count(*) FILTER (n = 1) AS once, round(any_value(m) / sum(n), 6) AS dominant_share, round(any_value(s) / sum(n), 6) AS top_share FROM c, f")
query("temporal_kinds_dirty", "dirty_dates", lambda d: values.temporal_kinds(d, "v"), "WITH k AS (SELECT v, CASE WHEN r = 5 THEN NULL WHEN r = 2 THEN 'invalid' WHEN r = 1 AND d <= 12 AND d <> 3 THEN 'ambiguous' WHEN r = 3 THEN 'datetime_aware' ELSE 'date' END AS kind, CASE WHEN r IN (0, 4) OR r = 1 AND (d > 12 OR d = 3) THEN epoch_us(make_date(2024, 3, d::INTEGER)::TIMESTAMP) WHEN r = 3 THEN epoch_us(TIMESTAMP '2024-03-05 10:00:00') + (id % 60) * 60000000 END AS i FROM $T) SELECT kind, count(*) AS cnt, count(DISTINCT v) AS distinct_values, min(i) AS first, max(i) AS last FROM k WHERE kind IS NOT NULL GROUP BY kind")

# Stores.
_cells = lambda d: store.observations(d.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
query("store_observations_orders", "orders", lambda d: _cells(d).groupBy("position", "raw").agg(F.count("*").alias("cnt")), "SELECT 0::INTEGER AS position, o_orderstatus AS raw, count(*) AS cnt FROM $T GROUP BY 2 UNION ALL SELECT 1, o_orderpriority, count(*) FROM $T GROUP BY 2")
query("store_first_values_orders", "orders", lambda d: store.first_values(_cells(d), 2), "WITH c AS (SELECT 0::INTEGER AS position, o_orderstatus AS raw, o_orderkey AS r FROM $T UNION ALL SELECT 1, o_orderpriority, o_orderkey FROM $T), g AS (SELECT position, raw, count(*) AS cnt, min(r) AS first_rec FROM c GROUP BY 1, 2) SELECT position, raw, cnt, first_rec FROM g QUALIFY row_number() OVER (PARTITION BY position ORDER BY first_rec, raw) <= 2")
query("store_validate_orders", "orders", lambda d: store.validate(_cells(d).where("not (record % 10 = 3 and position = 1)").unionByName(_cells(d).where("record % 50 = 0")), store.fields(d.select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderkey"), d.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("record"))), "SELECT 'unknown_field' AS \"check\", 0::BIGINT AS broken UNION ALL SELECT 'unknown_record', (count(*) FILTER (o_orderkey % 7 = 0) + count(*) FILTER (o_orderkey % 7 = 0 AND o_orderkey % 10 <> 3) + 2 * count(*) FILTER (o_orderkey % 7 = 0 AND o_orderkey % 50 = 0))::BIGINT FROM $T UNION ALL SELECT 'repeated_cell', 2 * count(*) FILTER (o_orderkey % 50 = 0) FROM $T UNION ALL SELECT 'incomplete_record', count(*) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % 10 = 3) FROM $T")
query("diagnostics_orders", "orders", lambda d: store.diagnostics(d.select(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'wide' ELSE 'narrow' END").alias("code"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'a' END").alias("subject"), F.col("o_orderkey").alias("record"))).select("code", "subject", "cnt", F.array_join("locations", ",").alias("locations")), "WITH e AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'wide' ELSE 'narrow' END AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'a' END AS subject, o_orderkey AS r FROM $T) SELECT code, subject, count(*) AS cnt, array_to_string(list_sort(list(r))[1:10], ',') AS locations FROM e GROUP BY 1, 2")
query("structure_embeddings", "embeddings", lambda d: store.structure(d.select("vec_id", "embedding")).select("path", "kind", "depth", "present", "items"), "SELECT 'vec_id' AS path, 'integer' AS kind, 1 AS depth, count(vec_id) AS present, NULL::BIGINT AS items FROM $T UNION ALL SELECT 'embedding', 'array', 1, count(embedding), sum(len(embedding))::BIGINT FROM $T UNION ALL SELECT 'embedding[]', 'number', 2, sum(len(list_filter(embedding, lambda x: x IS NOT NULL)))::BIGINT, NULL FROM $T")
query("limits_customer", "customer", lambda d: store.limits(d.select("c_custkey", "c_mktsegment", "c_name"), {"value_listing": 100, "long_text": 10}), "SELECT * FROM (SELECT 'c_custkey' AS field, 'value_listing' AS measure, count(DISTINCT c_custkey) AS size, 100::BIGINT AS bound FROM $T UNION ALL SELECT 'c_custkey', 'categories', count(DISTINCT c_custkey), 50 FROM $T UNION ALL SELECT 'c_name', 'value_listing', count(DISTINCT c_name), 100 FROM $T UNION ALL SELECT 'c_name', 'categories', count(DISTINCT c_name), 50 FROM $T UNION ALL SELECT 'c_name', 'long_text', max(length(c_name)), 10 FROM $T UNION ALL SELECT 'c_mktsegment', 'long_text', max(length(c_mktsegment)), 10 FROM $T) WHERE size > bound")
query("patterns_budget_part", "part", lambda d: patterns.within_budget(patterns.patterns(d, "p_name"), 2, 2, 3).groupBy("kept").agg(F.count("*").alias("n")), None)
query("facet_tree_brand", "part", lambda d: patterns.facet_tree(d, "p_brand"), None)

# Reports.
_of = lambda d: d.select("o_orderkey", "o_orderstatus", "o_orderpriority")
_top = "(SELECT {c} FROM $T GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
_share = "format('{{:.1f}}', (SELECT max(n) FROM (SELECT count(*) AS n FROM $T GROUP BY {c})) * 100.0 / count(*))"
_enum = "format('{{:,}}', count(DISTINCT {c})) || ' values, most often ' || " + _top + " || ' (' || " + _share + " || ' %)'"
query("overview_orders", "orders", lambda d: reports.overview(_of(d)), "SELECT 'o_orderkey' AS field, 'numeric' AS kind, format('{:,}', count(DISTINCT o_orderkey)) || ' different integer values' AS sentence FROM $T" + "".join(f" UNION ALL SELECT '{c}', 'enum', {_enum.format(c=c)} FROM $T" for c in ("o_orderstatus", "o_orderpriority")))
query("summary_table_faults", "faults", lambda d: reports.summary_table(d.select("e", "cat", "none")).select("position", "field", "present", "missing", "missing_share", "errors", "issues", "codes"), "SELECT 0::INTEGER AS position, 'e' AS field, count(*) AS present, 0::BIGINT AS missing, 0.0::DOUBLE AS missing_share, count(*) FILTER (k % 20 = 0) AS errors, 1::BIGINT AS issues, 'pattern.minority,semantic.invalid' AS codes FROM $T UNION ALL SELECT 1, 'cat', count(*), 0, 0.0, 0, 1 + 2 * count(*) FILTER (k % 3 = 2), 'categorical.case_variants,text.repeated_whitespace,text.surrounding_whitespace' FROM $T UNION ALL SELECT 2, 'none', 0, count(*), 1.0, 0, 0, 'presence.empty_column' FROM $T")
query("table_summary_faults", "faults", lambda d: reports.table_summary(reports.summary_table(d.select("e", "cat", "none"))), "SELECT 3::BIGINT AS columns, 1::BIGINT AS with_missing, 1::BIGINT AS with_errors, 2::BIGINT AS with_issues, count(*) AS missing_cells, count(*) FILTER (k % 20 = 0) AS errors, 2 + 2 * count(*) FILTER (k % 3 = 2) AS issues FROM $T")
query("relations_view_lineitem", "lineitem", lambda d: reports.relations_view(d, ["l_quantity", "l_extendedprice"], []), "WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM $T), z AS (SELECT n, atanh(r) - 1.96 / sqrt(n - 3) AS lo, atanh(r) + 1.96 / sqrt(n - 3) AS hi FROM c), s AS (SELECT n, CASE WHEN lo * hi > 0 THEN least(abs((exp(2 * lo) - 1) / (exp(2 * lo) + 1)), abs((exp(2 * hi) - 1) / (exp(2 * hi) + 1))) ELSE 0 END AS s FROM z) SELECT 'correlation' AS kind, 'l_quantity' AS a, 'l_extendedprice' AS b, n, round(s, 6) AS score, CASE WHEN s < 0.1 THEN 'negligible' WHEN s < 0.3 THEN 'weak' WHEN s < 0.5 THEN 'moderate' ELSE 'strong' END AS word FROM s")
query("insights_gaps", "gaps", lambda d: reports.insights(d.select("a", "b", "c")), "SELECT 'missing' AS family, 'a+b' AS subject, 'missing together in ' || count(*) FILTER (k % 4 = 0) || ' records' AS text, count(*) FILTER (k % 4 = 0) AS count FROM $T UNION ALL SELECT 'duplicates', 'rows', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b, c FROM $T))) || ' rows repeat an earlier one', count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b, c FROM $T)) FROM $T" + "".join(f" UNION ALL SELECT 'finding', '{c}', 'values.constant_column: ' || count({c}) || ' of ' || count({c}), count({c}) FROM $T" for c in "abc"))
query("uniqueness_case_ids", "dirty_ids", lambda d: reports.uniqueness_case(rows.uniqueness(d, "id")), "SELECT count(*) AS records, count(id) AS present, 0::BIGINT AS missing, count(DISTINCT id) AS distinct_ids, (SELECT count(*) - count(DISTINCT (id, status, rec)) FROM $T) AS extra_copies, count(*) - (SELECT count(*) - count(DISTINCT (id, status, rec)) FROM $T) - count(DISTINCT id) AS residual, 'C' AS \"case\" FROM $T")
query("uniqueness_evidence_ids", "dirty_ids", lambda d: reports.evidence(d, "id", {"records": 1, "missing": 0}), "SELECT 'records' AS figure, count(*) AS value, 'both' AS source, count(*) = 1 AS agrees FROM $T UNION ALL SELECT 'present', count(id), 'counted', true FROM $T UNION ALL SELECT 'missing', count(*) - count(id), 'both', true FROM $T UNION ALL SELECT 'distinct_ids', count(DISTINCT id), 'counted', true FROM $T UNION ALL SELECT 'extra_copies', count(*) - count(DISTINCT (id, status, rec)), 'counted', true FROM $T")
query("refined_orders", "orders", lambda d: reports.refined(quality.classify(d.select("o_orderkey", "o_custkey")).select("field", F.lit("identifier").alias("role")), values.profile(d.select("o_orderkey", "o_custkey"))), "SELECT 'o_orderkey' AS field, CASE WHEN count(DISTINCT o_orderkey) = count(*) THEN 'unique_id' ELSE 'identifier' END AS role FROM $T UNION ALL SELECT 'o_custkey', CASE WHEN count(DISTINCT o_custkey) = count(*) THEN 'unique_id' ELSE 'identifier' END FROM $T")
query("overlaps_faults", "faults", lambda d: reports.overlaps(d.select(F.col("k").alias("record"), F.explode(F.array_compact(F.array(F.when(F.col("k") % 3 == 2, F.lit("trim")), F.when(F.col("k") % 3 == 2, F.lit("collapse")), F.when(F.col("k") % 50 == 0, F.lit("length"))))).alias("code"))), "SELECT 'collapse' AS a, 'trim' AS b, count(*) FILTER (k % 3 = 2) AS common, true AS same FROM $T UNION ALL SELECT 'collapse', 'length', count(*) FILTER (k % 150 = 50), false FROM $T HAVING count(*) FILTER (k % 150 = 50) > 0 UNION ALL SELECT 'length', 'trim', count(*) FILTER (k % 150 = 50), false FROM $T HAVING count(*) FILTER (k % 150 = 50) > 0")
query("row_sample_report", "orders", lambda d: reports.row_sample(d.select("o_orderkey"), "o_orderkey", 5, 7, 4), "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS f, row_number() OVER (ORDER BY o_orderkey DESC) AS l FROM $T), m AS (SELECT o_orderkey FROM n WHERE f > 5 AND l > 4 ORDER BY md5(o_orderkey::VARCHAR || '|42'), o_orderkey LIMIT 7) SELECT o_orderkey, 'start' AS origin FROM n WHERE f <= 5 UNION ALL SELECT o_orderkey, 'end' FROM n WHERE l <= 4 AND f > 5 UNION ALL SELECT o_orderkey, 'middle' FROM m")
query("source_shape_gaps", "gaps", lambda d: reports.source_shape(d, ["a", "b", "c"]), "SELECT count(*) AS records, 3 AS columns, 3 * count(*) AS cells, (3 * count(*) - count(a) - count(b) - count(c))::BIGINT AS missing_cells, count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b, c FROM $T)) AS duplicate_rows FROM $T")
QUERIES["diverse_examples_part"] = lambda spark, d: reports.examples(load(spark, d, "part"), "p_name")

# Generation.


def _hash(*parts: str, of: str) -> str:
    return f"md5('{'|'.join(('42', *parts))}|' || {of}::VARCHAR)"


def _journal(name: str, op: dict, sql: str) -> None:
    query(name, "orders", lambda d: generate.inject(d.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"), "o_orderkey", [op])[1], sql)


_pick = lambda kind, column, n: f"(SELECT * FROM $T ORDER BY {_hash(kind + '0', column, of='o_orderkey')}, o_orderkey LIMIT {n})"
_line = "SELECT o_orderkey AS record, '{c}' AS \"column\", '{k}' AS operation, {b}::VARCHAR AS before, {a} AS after FROM "
_journal("anomaly_set_missing", {"kind": "set_missing", "column": "o_custkey", "count": 30}, _line.format(c="o_custkey", k="set_missing", b="o_custkey", a="NULL::VARCHAR") + _pick("set_missing", "o_custkey", 30))
_journal("anomaly_replace", {"kind": "replace", "column": "o_orderstatus", "count": 25, "value": "?"}, _line.format(c="o_orderstatus", k="replace", b="o_orderstatus", a="'?'") + _pick("replace", "o_orderstatus", 25))
_journal("anomaly_copy_column", {"kind": "copy_column", "column": "o_orderstatus", "source": "o_orderpriority", "count": 25}, _line.format(c="o_orderstatus", k="copy_column", b="o_orderstatus", a="o_orderpriority") + _pick("copy_column", "o_orderstatus", 25))
_journal("anomaly_swap", {"kind": "swap", "column": "o_orderstatus", "with": "o_orderpriority", "count": 20}, _line.format(c="o_orderstatus", k="swap", b="o_orderstatus", a="o_orderpriority") + _pick("swap", "o_orderstatus", 20) + " UNION ALL " + _line.format(c="o_orderpriority", k="swap", b="o_orderpriority", a="o_orderstatus") + _pick("swap", "o_orderstatus", 20))
_journal("anomaly_rate_when", {"kind": "set_missing", "column": "o_orderstatus", "rate": 0.2, "when": "o_orderstatus = 'F'"}, _line.format(c="o_orderstatus", k="set_missing", b="o_orderstatus", a="NULL::VARCHAR") + f"$T WHERE o_orderstatus = 'F' AND ('0x' || {_hash('set_missing0', 'o_orderstatus', of='o_orderkey')}[1:12])::BIGINT / 281474976710656.0 < 0.2")
_before = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM $T)"


def _copied(kind: str, column: str, n: int, window: int) -> str:
    u = f"('0x' || {_hash('copy', kind + '0', 'o_orderkey_', of='o_orderkey').replace('|o_orderkey_|', '|value|')}[1:12])::BIGINT / 281474976710656.0"
    return f"WITH t AS {_before}, x AS (SELECT t.*, {u} AS u FROM t), y AS (SELECT *, p - 1 - floor(u * least(p, {window}))::BIGINT AS q FROM x WHERE p > 0), h AS (SELECT o_orderkey FROM {_pick(kind, column, n)})"


_journal("anomaly_duplicate", {"kind": "duplicate", "column": "o_custkey", "count": 30}, _copied("duplicate", "o_custkey", 30, 1) + " SELECT y.o_orderkey AS record, 'o_custkey' AS \"column\", 'duplicate' AS operation, y.o_custkey::VARCHAR AS before, s.o_custkey::VARCHAR AS after FROM y JOIN t s ON s.p = y.q JOIN h ON h.o_orderkey = y.o_orderkey WHERE s.o_custkey <> y.o_custkey")
_journal("anomaly_reuse_value", {"kind": "reuse_value", "column": "o_custkey", "count": 30}, _copied("reuse_value", "o_custkey", 30, 1000) + " SELECT y.o_orderkey AS record, 'o_custkey' AS \"column\", 'reuse_value' AS operation, y.o_custkey::VARCHAR AS before, s.o_custkey::VARCHAR AS after FROM y JOIN t s ON s.p = y.q JOIN h ON h.o_orderkey = y.o_orderkey WHERE s.o_custkey <> y.o_custkey")
_journal("anomaly_duplicate_row", {"kind": "duplicate_row", "count": 20}, _copied("duplicate_row", "", 20, 1000) + ", j AS (SELECT y.o_orderkey, unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey']) AS c, unnest([y.o_orderstatus, y.o_orderpriority, y.o_custkey::VARCHAR]) AS b, unnest([s.o_orderstatus, s.o_orderpriority, s.o_custkey::VARCHAR]) AS a FROM y JOIN t s ON s.p = y.q JOIN h ON h.o_orderkey = y.o_orderkey) SELECT o_orderkey AS record, c AS \"column\", 'duplicate_row' AS operation, b AS before, a AS after FROM j WHERE a <> b")
_u = lambda c, s="value": f"('0x' || md5('42|t|{c}|{s}|' || i::VARCHAR)[1:12])::BIGINT / 281474976710656.0"
QUERIES["generate_cases"] = lambda spark, d: generate.table(spark, "t", 2000, {
    "amount": {"kind": "decimal", "min": 10, "max": 20, "by_case": {"from": "kind", "cases": {"b": {"min": 100, "max": 200}}}, "by_value": {"from": "kind", "factors": {"c": 2.0}}, "missing": {"from": "kind", "rates": {"a": 0.5}}},
    "id": {"kind": "sequence"}, "kind": {"kind": "choice", "values": ["a", "b", "c"]},
    "city": {"kind": "catalog", "rows": [{"k": "a", "city": "Oslo", "w": 1}, {"k": "a", "city": "Rome", "w": 3}, {"k": "b", "city": "Bern", "w": 1}], "field": "city", "where": {"k": "kind"}, "weight": "w"},
}, cohorts=[{"id": "x", "weight": 1, "formats": {"kind": {"c": "C"}}}, {"id": "y", "weight": 3}])
ORACLE_SQL["generate_cases"] = f"WITH r AS (SELECT i, CASE WHEN {_u('cohort', 'selection')} < 0.25 THEN 'x' ELSE 'y' END AS _cohort, {_u('kind')} AS uk, {_u('amount')} AS ua, {_u('amount', 'missing')} AS um, {_u('city')} AS uc FROM range(2000) t(i)), k AS (SELECT *, CASE WHEN uk < 1 / 3.0::DOUBLE THEN 'a' WHEN uk < 2 / 3.0::DOUBLE THEN 'b' WHEN _cohort = 'x' THEN 'C' ELSE 'c' END AS kind FROM r) SELECT _cohort, CASE WHEN um >= CASE WHEN kind = 'a' THEN 0.5 ELSE 0 END THEN CASE WHEN kind = 'b' THEN round(100 + ua * 100, 2) WHEN kind = 'c' THEN round(round(10 + ua * 10, 2) * 2, 2) ELSE round(10 + ua * 10, 2) END END AS amount, i + 1 AS id, kind, CASE WHEN kind = 'a' AND uc * 4 < 1 THEN 'Oslo' WHEN kind = 'a' THEN 'Rome' WHEN kind = 'b' THEN 'Bern' END AS city FROM k"
_csv = "(SELECT c_custkey AS k, c_name AS n, c_nationkey AS s, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer ORDER BY c_custkey LIMIT 50)"
_plain = "k || ',' || n || ',' || s || chr(10)"
_file = lambda line, cut=0: f"(SELECT hex(left(h, length(h) - {cut})) FROM (SELECT 'c_custkey,c_name,c_nationkey' || chr(10) || string_agg({line}, '' ORDER BY i) AS h FROM {_csv}))"
QUERIES["malformed_customer"] = lambda spark, d: population.malformed(load(spark, d, "customer").selectExpr("c_custkey", "c_name", "c_nationkey"), "c_custkey").select("scenario", F.hex("content").alias("content"))
ORACLE_SQL["malformed_customer"] = (
    f"SELECT 'wide_rows' AS scenario, {_file('k || chr(44) || n || chr(44) || s || CASE WHEN i % 7 = 3 THEN chr(44) || $$more,more$$ ELSE $$$$ END || chr(10)')} AS content UNION ALL SELECT 'narrow_rows', {_file('k || chr(44) || n || CASE WHEN i % 9 = 4 THEN $$$$ ELSE chr(44) || s END || chr(10)')}"
    f" UNION ALL SELECT 'open_quotes', {_file('CASE WHEN i % 11 = 5 THEN chr(34) ELSE $$$$ END || ' + _plain)} UNION ALL SELECT 'cut_file', {_file(_plain, 4)}"
    f" UNION ALL SELECT 'stray_bytes', (SELECT hex('c_custkey,c_name,c_nationkey' || chr(10) || string_agg({_plain}, '' ORDER BY i) FILTER (i < 6)) || 'C328' || hex(string_agg({_plain}, '' ORDER BY i) FILTER (i >= 6)) FROM {_csv})"
)

# Sources, over files written when the query is made.


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/sources-{uuid.uuid4().hex}"


def csv_file(spark: SparkSession, d: str, line: str) -> str:
    """Customers as CSV lines by an expression, with a header in every part."""
    import pyarrow as pa

    def headed(batches):
        yield pa.RecordBatch.from_arrays([pa.array(["id,name,nation"])], names=["value"])
        yield from batches

    path = folder(spark)
    load(spark, d, "customer").select(F.expr(line).alias("value")).mapInArrow(headed, "value string").write.text(path)
    return path


_row = "cast(c_custkey AS string) || ',\"' || c_name || '\",' || cast(c_nationkey AS string)"
QUERIES["source_csv_strict"] = lambda spark, d: readers.read_csv(spark, csv_file(spark, d, _row))
ORACLE_SQL["source_csv_strict"] = "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_nationkey::VARCHAR AS nation FROM customer"
_odd = f"CASE c_custkey % 10 WHEN 0 THEN {_row} || ',more' WHEN 1 THEN cast(c_custkey AS string) WHEN 2 THEN {_row} || ',\"a,b\",c' ELSE {_row} END"
QUERIES["source_csv_excluded"] = lambda spark, d: readers.excluded(readers.read_csv(spark, csv_file(spark, d, _odd), tolerant=True))
ORACLE_SQL["source_csv_excluded"] = "SELECT CASE WHEN c_custkey % 10 = 1 THEN 'too_few_cells' ELSE 'too_many_cells' END AS reason, CASE c_custkey % 10 WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 5 END::BIGINT AS cells, count(*) AS records FROM customer WHERE c_custkey % 10 < 3 GROUP BY 1, 2"
QUERIES["source_csv_tolerant"] = lambda spark, d: readers.read_csv(spark, csv_file(spark, d, _odd), tolerant=True).where(F.col(readers.CORRUPT).isNull()).drop(readers.CORRUPT)
ORACLE_SQL["source_csv_tolerant"] = "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_nationkey::VARCHAR AS nation FROM customer WHERE c_custkey % 10 >= 3"


def json_lines(spark: SparkSession, d: str) -> str:
    path = folder(spark)
    line = r"""CASE c_custkey % 8 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{"id": ' WHEN 2 THEN '  ' WHEN 3 THEN '{"id": 1, "id": 2}' WHEN 4 THEN '{"id": "\\ud800"}' WHEN 5 THEN '{"id": 1, "x": {"id": 2}}' ELSE '{"id": ' || cast(c_custkey AS string) || ', "name": "' || c_name || '"}' END"""
    load(spark, d, "customer").select(F.expr(line).alias("value")).write.text(path)
    return path


QUERIES["source_jsonl_states"] = lambda spark, d: readers.read_jsonl(spark, json_lines(spark, d)).groupBy("state").agg(F.count("*").alias("lines"))
ORACLE_SQL["source_jsonl_states"] = "SELECT CASE c_custkey % 8 WHEN 0 THEN 'other' WHEN 1 THEN 'invalid' WHEN 2 THEN 'blank' WHEN 3 THEN 'duplicate_key' WHEN 4 THEN 'surrogate' ELSE 'object' END AS state, count(*) AS lines FROM customer GROUP BY 1"
QUERIES["source_jsonl_records"] = lambda spark, d: readers.jsonl_records(spark, json_lines(spark, d), "id long, name string")
ORACLE_SQL["source_jsonl_records"] = "SELECT CASE WHEN c_custkey % 8 = 5 THEN 1 ELSE c_custkey END::BIGINT AS id, CASE WHEN c_custkey % 8 <> 5 THEN c_name END AS name FROM customer WHERE c_custkey % 8 >= 5"


def json_document(spark: SparkSession, d: str) -> str:
    path = folder(spark)
    load(spark, d, "nation").groupBy(F.lit("x").alias("source")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("rows")).write.json(path)
    return path


QUERIES["source_json_collection"] = lambda spark, d: readers.read_json(spark, json_document(spark, d), "rows").select("key", "name")
ORACLE_SQL["source_json_collection"] = "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation"


def workbook(names: list[str], body: list[tuple]) -> bytes:
    """The least workbook that holds these rows as inline text and numbers."""
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join("<row>" + "".join(cell(v).replace("<c", f'<c r="{chr(65 + i)}{n}"', 1) for i, v in enumerate(r)) + "</row>" for n, r in enumerate([tuple(names), *body], 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def read_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """Nations in two workbooks of one folder."""
    path = folder(spark)
    body = [(r["n_nationkey"], r["n_name"]) for r in load(spark, d, "nation").select(F.col("n_nationkey").cast("int"), "n_name").collect()]  # 25 rows
    for i in (0, 1):
        readers.write_bytes(spark, f"{path}/part{i}.xlsx", workbook(["key", "name"], body[i::2]))
    return readers.read_excel(spark, path)


QUERIES["source_excel"] = read_workbooks
ORACLE_SQL["source_excel"] = "SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation"


def line_census(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    readers.write_bytes(spark, f"{path}/a.csv", b"\xef\xbb\xbfa,b\r\n1,2\r\n3,4\n5\r6")
    return readers.line_ends(spark, path).select("bom", "crlf", "lf", "cr", "sha256")


QUERIES["source_line_ends"] = line_census
ORACLE_SQL["source_line_ends"] = "SELECT true AS bom, 2::BIGINT AS crlf, 1::BIGINT AS lf, 1::BIGINT AS cr, sha256('\\xEF\\xBB\\xBFa,b\\x0D\\x0A1,2\\x0D\\x0A3,4\\x0A5\\x0D6'::BLOB) AS sha256"


def written(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    readers.write_csv(load(spark, d, "nation").select("n_name", "n_regionkey"), path, sep=";", bom=True)
    return readers.read_csv(spark, f"{path}/part-*", sep=";")


QUERIES["sink_csv_round_trip"] = written
ORACLE_SQL["sink_csv_round_trip"] = "SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"


def changed_files(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    for name, data in (("a.txt", b"1"), ("b.txt", b"2"), ("c.txt", b"3")):
        readers.write_bytes(spark, f"{path}/{name}", data)
    before = spark.createDataFrame(readers.fingerprint(spark, path).collect(), "path string, size long, modified timestamp, sha256 string")
    readers.write_bytes(spark, f"{path}/b.txt", b"22")
    readers.write_bytes(spark, f"{path}/d.txt", b"4")
    return readers.stale(spark, path, before).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "change")


QUERIES["source_stale"] = changed_files
ORACLE_SQL["source_stale"] = "SELECT 'b.txt' AS file, 'changed' AS change UNION ALL SELECT 'd.txt', 'added'"
_ = view
