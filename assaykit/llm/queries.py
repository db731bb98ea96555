"""The corpus queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from assaykit.llm.bpe import op3_byte_bpe
from assaykit.llm.chat import op7_chat_formatting
from assaykit.llm.embedding_dedup import op5_embedding_near_dedup
from assaykit.llm.licenses import op2_license_scans
from assaykit.llm.minhash import op8_minhash_near_dedup
from assaykit.llm.mixing import op6_mixing
from assaykit.llm.pii import op4_pii
from assaykit.llm.quality import op10_quality_rules
from assaykit.llm.secrets import op1_secret_scans
from assaykit.llm.token_counts import op9_token_counts

QUERIES = {f.__name__: f for f in (op1_secret_scans, op2_license_scans, op3_byte_bpe, op4_pii, op5_embedding_near_dedup, op6_mixing, op7_chat_formatting, op8_minhash_near_dedup, op9_token_counts, op10_quality_rules)}

# Parts of operators that SQL can express, over whole tables.


def corpus_secret_counts(spark, sf_dir):
    """The counts of op1."""
    return op1_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def corpus_mix_targets(spark, sf_dir):
    """Sizes and targets of op6."""
    return op6_mixing(spark, sf_dir).selectExpr("doc_id", "size", "source_size", "round(target, 6) AS target")


def corpus_quality_base(spark, sf_dir):
    """The base columns of op10."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def corpus_text_bytes(spark, sf_dir):
    """The bytes of op9."""
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes")


QUERIES |= {f.__name__: f for f in (corpus_secret_counts, corpus_mix_targets, corpus_quality_base, corpus_text_bytes)}

ORACLE_SQL = {
    "corpus_secret_counts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
        SELECT doc_id,
            len(list_filter(regexp_extract_all(x, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda v: length(v) >= 8)) AS n_assign,
            len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 16)) AS n_access,
            len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda v: length(v) >= 32)) AS n_hex
        FROM t""",
    "corpus_mix_targets": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
        c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, w, source_size, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY 2 * source_size / w, w, source_size, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, 1.5 * sum(source_size) OVER () AS share FROM s),
        l AS (SELECT arg_min((share - before) / rest, 2 * source_size / w) FILTER (2 * source_size > (share - before) / rest * w) AS level FROM c)
        SELECT doc_id, size, source_size, round(least(2.0 * source_size, w * level), 6)::DOUBLE AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l""",
    "corpus_quality_base": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT v) AS n FROM (SELECT doc_id, unnest(string_split(x, chr(10))) AS v FROM w) WHERE regexp_matches(v, '[^\x20\x09-\x0D]') GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
            len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
        FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)""",
    "corpus_text_bytes": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents",
    "op5_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
        u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
        reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
        comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
        FROM embeddings e JOIN comp c ON c.id = e.vec_id""",
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
        comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d JOIN comp c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
