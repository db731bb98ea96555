"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Token bytes are mapped to Latin-1 so that a trie over strings finds the longest token that starts
at a position that is reached. A token sequence is the one that the merges make
exactly if every adjacent pair is: so the encoder takes longest matches, tries shorter prefixes
when a pair is not compatible, and steps back when none is left. Ends that proved dead are marked,
which bounds the work to a multiple of the length. Pair compatibility is told from the halves of
both tokens, without merging their bytes again; what comes after a token on a path of the trie is memoised.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from assaykit.llm.common import map_texts

VOCABULARY = "byte_bpe_50k.tiktoken"
FIELDS = "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of the memo of encoded pieces, half of them old; that of steps holds half as many again and is emptied when full.
MEMO = 200_000
#: Ids that are decoded at once.
DECODED = 32_768


class Memo(dict):
    """Packed ids by piece; when half full, it starts anew and keeps what it held as ``old`` for once. Long pieces are not kept."""

    def __init__(self, piece: Callable[[bytes], list[int]]):
        super().__init__()
        self.piece, self.old = piece, {}

    def __missing__(self, part: str) -> bytes:
        if (ids := self.old.get(part)) is None:
            found = self.piece(part.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(part) <= 64:
            if len(self) >= MEMO // 2:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.longest = max(self.sizes.values(), default=0)
        ordered = [self.tokens.get(i, b"") for i in range(max(self.tokens, default=-1) + 1)]
        self.laid = np.frombuffer(b"".join(ordered), np.uint8)
        self.widths = np.array([len(b) for b in ordered], np.int64)
        self.places = np.cumsum(self.widths) - self.widths
        self.split = regex.compile(pattern).findall
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.first: dict[str, int] = {}
        self.shorter: dict[int, int | None] = {}
        self.steps: dict[tuple[int | None, str | int], int | None] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.memo = Memo(self.piece)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        return cls(ranks, pattern)

    def prefix(self, token: int) -> int | None:
        """The next shorter token that this one starts with."""
        if token not in self.shorter:
            data = self.tokens[token]
            self.shorter[token] = next((i for n in range(len(data) - 1, 0, -1) if (i := self.ranks.get(data[:n])) is not None), None)
        return self.shorter[token]

    def longest_at(self, path: str) -> int:
        """The longest token that a path of the trie starts with."""
        if (token := self.first.get(path)) is None:
            data = path.encode("latin-1")
            token = self.first[path] = next(i for n in range(len(data), 0, -1) if (i := self.ranks.get(data[:n])) is not None)
        return token

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The merges as they are defined, lowest rank first, until ``least`` parts are left; for the few bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if rank == 1 << 62:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def step(self, last: int | None, start: str | int) -> int | None:
        """The longest token that may come after ``last`` of those that a path of the trie starts with, or of those shorter than a token."""
        token = self.prefix(start) if isinstance(start, int) else self.longest_at(start)
        while token is not None and last is not None and not self.compatible(last, token):
            token = self.prefix(token)
        if len(self.steps) >= MEMO * 3 // 2:
            self.steps.clear()
        self.steps[last, start] = token
        return token

    def split_in(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; itself twice for a single byte; null unless it and all tokens in it
        come from merges of lower ranks."""
        if token not in self.halves:
            data = self.tokens[token]
            two = (token, token) if len(data) == 1 else tuple(self.merged(data, 2))
            good = len(data) == 1 or len(two) == 2 and max(two) < token and all(map(self.split_in, two))
            self.halves[token] = two if good else None
        return self.halves[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens merge to these two.

        Merges inside a token come in the order of their ranks, so the parts that face each other across the border are known
        for every rank: from the last, the younger of both is taken back to its half at the border, and a token of both
        parts of a lower rank than what was taken back would have been merged before (of two equal merges, the left one comes first).
        """
        if self.split_in(left) is None or self.split_in(right) is None:
            return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        tokens, ranks, halves = self.tokens, self.ranks, self.halves
        a, b, limit = tokens[left], tokens[right], 1 << 62
        while (over := ranks.get(a + b)) is None or over >= limit:
            if len(b) > 1 and (len(a) == 1 or left <= right):
                limit = right + 1
                right = halves[right][0]
                b = tokens[right]
            elif len(a) > 1:
                limit = left
                left = halves[left][1]
                a = tokens[left]
            else:
                return True
        return False

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        sizes, steps, trie, longest = self.sizes, self.steps, self.trie.longest_prefix, self.longest
        body, size = data.decode("latin-1"), len(data)
        dead: set[int] = set()
        out: list[int] = []
        at, last = 0, None
        while at < size:
            rest = body[at : at + longest]
            key = (last, rest[: trie(rest)])
            token = steps[key] if key in steps else self.step(*key)
            while token is None or dead and at + sizes[token] in dead:
                if token is not None:
                    key = (last, token)
                    token = steps[key] if key in steps else self.step(*key)
                else:  # nothing fits here: back to the token before, which ends at a dead place now
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    last = out[-1] if out else None
            out.append(token)
            at += sizes[token]
            last = token
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, gathered from all tokens laid end to end; some ids at a time, which bounds the memory."""
        out = []
        for begin in range(0, len(ids), 4 * DECODED):
            part = np.frombuffer(ids[begin : begin + 4 * DECODED], "<u4")
            size = self.widths[part]
            shift = self.places[part] - (np.cumsum(size) - size)
            out.append(self.laid[np.arange(size.sum()) + np.repeat(shift, size)].tobytes())
        return b"".join(out)


@lru_cache(2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    import public_tokenizers

    return Codec.load(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)


def worker(path: str | None, pattern: str | None, ids: bool) -> Callable[[list[str]], dict[str, list]]:
    own = codec(path, pattern)

    def work(texts: list[str]) -> dict[str, list]:
        packed = [own.encode(t) for t in texts]
        sha = [hashlib.sha256(x).hexdigest() for x in packed]
        back = [hashlib.sha256(own.decode(x)).hexdigest() for x in packed]
        got = {"n_tokens": [len(x) // 4 for x in packed], "ids_sha256": sha, "decoded_sha256": back}
        if ids:
            got["ids"] = [np.frombuffer(x, "<i4") for x in packed]
        return got

    return work


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, ids: bool = True, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add token ids (optional), their number, their digest and the digest of the bytes decoded from them.

    Null is taken as empty (no ids); repeated rows are encoded each; an empty table stays empty;
    input columns with the names of added ones are replaced. ``path`` must be readable on each
    executor; by default it is the installed vocabulary. No shuffle.
    """
    return map_texts(df, text, FIELDS if ids else FIELDS.partition(", ")[2], worker, path, pattern, ids, keep=keep)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's token ids, by number and digest, and the digest of their decoding. Nulls, ties and repeats as in ``encode``."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"], ids=False)
