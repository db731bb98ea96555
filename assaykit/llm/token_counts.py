"""Token counts with overlap resynchronisation for huge documents.

Texts up to a chunk are cut at stable positions (below), so that each distinct run of characters
between two of them is encoded once and its count is kept in a memo. A longer text is encoded in overlapping chunks with
offsets; two neighbours are spliced at a position inside their overlap where both have a token
boundary and which is proven stable. If there is none, the overlap is widened.

Stable means that no rule of the tokenizer looks across it. Its normaliser composes characters
(never onto a following ASCII character), squeezes white space and lower-cases character by
character; its splitter drops white space and ends every match between a letter and anything
else, and around each digit; its added tokens hold no white space. So a position is stable if an
ASCII character follows it, and a space precedes it or it lies between letter and non-letter or
beside a digit, and no added token lies across it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame

from assaykit.llm.common import map_texts

VOCABULARY = "word_bpe_49k.json"
CHUNK, OVERLAP, LIMIT = 1 << 16, 1 << 10, 2048
#: Entries of the memo; when they would be more, it starts anew with the texts at hand.
MEMO = 300_000
FIELDS = "n_bytes long, n_tokens long, over_limit boolean"
# The rules for which stable positions are proven. A tokenizer file with others is refused.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def refuse_others(path: str) -> None:
    """Raise for a tokenizer file whose rules are not the ones that the cuts of this module are proven for."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal = [x["type"] for x in (rules.get("normalizer") or {}).get("normalizers", [])]
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    split = (first.get("pattern") or {}).get("Regex") == SPLIT and first.get("behavior") == "Removed" and first.get("invert") is True
    spaced = any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in rules.get("added_tokens", []))
    if normal != NORMALIZERS or not split or [x["type"] for x in steps[1:]] != ["ByteLevel"] or steps[1].get("use_regex") or spaced or rules["model"].get("type") != "BPE" or rules["model"].get("dropout"):
        raise ValueError(f"{path}: stable positions are not proven for the rules of this tokenizer")


def stable(text: str, at: int, added: list[str]) -> bool:
    """Whether tokens on both sides of this position never depend on the other side."""
    if not 0 < at < len(text):
        return True
    left, right = text[at - 1], text[at]
    if right > "\x7f" or not (right.isalnum() or left.isalpha() and left <= "\x7f"):
        return False
    if left in " \t\n\r\x0b\x0c":
        ok = True
    elif left <= "\x7f":
        ok = left.isdigit() or right.isdigit() or left.isalpha() and not right.isalpha() and not right.isspace()
    else:
        ok = False
    return ok and not any((p := text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)) >= 0 and p < at for s in added)


class Counter:
    """Counts tokens of whole texts as the library gives them."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        refuse_others(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunk, self.overlap = max(chunk, 64), max(1, overlap)
        self.memo: dict[str, int] = {}
        # Each of these cuts is stable: white space goes, and an ASCII letter or digit follows.
        self.cut = re.compile(r"[ \t\n\r\x0b\x0c](?=[0-9A-Za-z])").split

    def short(self, texts: list[str]) -> list[int]:
        runs = [self.cut(t) for t in texts]
        new = set().union(*runs).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, set().union(*runs)
        new = list(new)
        self.memo.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return [sum(map(self.memo.__getitem__, x)) for x in runs]

    def spans(self, text: str, begin: int, end: int) -> list[tuple[int, int]]:
        return [(a + begin, b + begin) for a, b in self.tokenizer.encode(text[begin:end], add_special_tokens=False).offsets]

    def splice(self, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], low: int, high: int) -> int | None:
        """The last position in (low, high) that is stable and that no token of either chunk lies across."""
        inside = [(a, b) for side in (left, right) for a, b in side if a < high and b > low and b - a > 1]
        across = {p for a, b in inside for p in range(a + 1, b)}
        return next((at for at in range(high - 1, low, -1) if at not in across and stable(text, at, self.added)), None)

    def long(self, text: str) -> int:
        total = begin = 0
        while len(text) - begin > self.chunk:
            size, back = self.chunk, self.overlap
            while True:
                end = min(begin + size, len(text))
                if end == len(text):
                    return total + len(self.spans(text, begin, end))
                left = self.spans(text, begin, end)
                right = self.spans(text, low := max(begin, end - back), min(end + back, len(text)))
                if (at := self.splice(text, left, right, low, end)) is not None:
                    break
                # nothing proven in the overlap: widen it, and the chunk with it once it covers half of it
                back *= 2
                if back > size // 2:
                    size *= 2
            total += sum(b <= at for a, b in left)
            begin = at
        return total + len(self.spans(text, begin, len(text)))

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, n in zip(short, self.short([texts[i] for i in short])):
            out[i] = n
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.long(t)
        return out


@lru_cache(2)
def counter(path: str | None = None) -> Counter:
    import public_tokenizers

    return Counter(path or public_tokenizers.path(VOCABULARY))


def worker(path: str | None, limit: int) -> Callable[[list[str]], dict[str, list]]:
    own = counter(path)

    def work(texts: list[str]) -> dict[str, list]:
        n = own.count(texts)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return work


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Add bytes, tokens and whether there are more tokens than ``limit``.

    Null is taken as empty (0 and 0); repeated rows are counted each; an empty table stays
    empty; input columns with the names of added ones are replaced. A tokenizer file (``path``) with
    other rules than those of VOCABULARY raises. No shuffle.
    """
    return map_texts(df, text, FIELDS, worker, path, limit, keep=keep)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens. Nulls, ties and repeats as in ``count_tokens``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
