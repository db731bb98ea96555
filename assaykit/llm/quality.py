"""Quality rules: word statistics and zstandard compression bands.

Repetitive text compresses far better, and random or base64 text far worse, than prose; sparser
codes such as hexadecimal compress like prose and pass. A
document is compressed whole and in fixed chunks, and each ratio (bytes before / after) is held
against limits that depend on the length compressed, as short inputs carry more overhead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from assaykit.llm.common import map_texts

#: Limits by bytes compressed: (at least, lowest ratio, highest ratio). Below 400 bytes there is no limit.
#: Base64 reaches 1.24 at 800 bytes and 1.34 at any length; the given documents start at 1.36 and, from 800 bytes, at 1.56.
BANDS = ((400, 1.25, 6.0), (800, 1.4, 6.0), (1_000, 1.4, 8.0), (4_000, 1.4, 10.0), (16_000, 1.4, 14.0), (64_000, 1.4, 20.0))
CHUNK = 4096
#: A document is rejected if more than this share of its bytes lies in chunks outside their band.
BAD_SHARE = 0.5
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, bad_chunk_share double, reason string, kept boolean"
)
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of ``size`` words that occur at least twice, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    base, window, span = len(ids), code[:n], len(ids)
    for i in range(1, size):
        if span * base >= 1 << 62:  # codes would overflow: rank what there is so far
            seen, window = np.unique(window, return_inverse=True)
            span = len(seen)
        window = window * base + code[i : i + n]
        span *= base
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def outside(n: int, ratio: float) -> str | None:
    """'repetitive', 'incompressible' or None for n bytes at this ratio."""
    low, high = next(((lo, hi) for least, lo, hi in reversed(BANDS) if n >= least), (0.0, float("inf")))
    return "repetitive" if ratio > high else "incompressible" if ratio < low else None


def worker(level: int = 3) -> Callable[[list[str]], dict[str, list]]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

    def one(text: str) -> tuple:
        data = text.encode()
        words = data.split()
        n = len(words)
        chars = len(text) - (len(data) - len(data.translate(None, BLANKS)))
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeats = repeated_words(words)
        failed = n < 10 or 100 * repeats > 20 * n
        ratio = len(data) / len(squeeze(data)) if data else 1.0
        reason = outside(len(data), ratio)
        bad = 0
        for i in range(0, len(data), CHUNK) if len(data) > CHUNK else ():
            part = data[i : i + CHUNK]
            bad += len(part) * bool(outside(len(part), len(part) / len(squeeze(part))))
        share = bad / len(data) if data else 0.0
        reason = "words" if failed else reason or ("chunks" if share > BAD_SHARE else None)
        return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, ratio, share, reason, reason is None

    names = [x.split()[0] for x in FIELDS.split(", ")]
    return lambda texts: dict(zip(names, zip(*map(one, texts)))) if texts else {n: [] for n in names}


def assess(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add word statistics, compression ratios, the reason for a rejection and ``kept``.

    Null and empty texts have no words and so fail; repeated rows are judged alike, each on its
    own; an empty table stays empty; input columns with the names of added ones are replaced.
    No shuffle: each row is judged where it is read.
    """
    return map_texts(df, text, FIELDS, worker, keep=keep)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's quality figures and verdict. Nulls, ties and repeats as in ``assess``."""
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
