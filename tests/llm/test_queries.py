"""The registered corpus queries on whole tables, and the pipeline stage by stage, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import zstandard
from assaykit.llm import common, quality
from assaykit.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(data):
    return hashlib.sha256(data).hexdigest()


def line(spans):
    return digest(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def secrets(text):
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def classes(sets, linked):
    """The smallest reachable key of each, by brute force over all pairs."""
    low = {k: k for k in sets}
    pairs = [(a, b) for a, b in combinations(sets, 2) if linked(sets[a], sets[b])]
    while True:
        before = dict(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low, Counter(x for p in pairs for x in p)


def shingles(text):
    w = WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    return 100 * len(x & y) >= 75 * len(x | y) > 0


def test_op1(spark, texts):
    got = rows(spark, "op1_secret_scans")
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = secrets(text)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert got[i].base_sha256 == line(want)
        assert {":".join(map(str, s)) for s in want} <= set((got[i].spans or "").split(","))


def test_op3(spark, texts):
    got = rows(spark, "op3_byte_bpe")
    ranks = {}
    from base64 import b64decode

    for row in open(P.path("byte_bpe_50k.tiktoken"), "rb"):
        token, rank = row.split()
        ranks[b64decode(token)] = int(rank)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in texts.items():
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest(ids.tobytes()), digest(text.encode()))


def test_op4(spark, texts):
    got = rows(spark, "op4_pii")
    kinds = ("email", "ip", "card", "phone")
    for i, text in texts.items():
        want = personal(text)
        assert [got[i][f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in want) for k in kinds]
        assert got[i].base_sha256 == line(want)
        assert {":".join(map(str, s)) for s in want} <= set(got[i].spans.split(","))


def test_op5(spark):
    data = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want, links = classes(data, lambda x, y: x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.95)
    got = QUERIES["op5_embedding_near_dedup"](spark, SF).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {k: (links[k], c, k == c) for k, c in want.items()}


def test_op6(spark, texts):
    got = rows(spark, "op6_mixing")
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total, taken = Counter(), Counter()
    for i, text in texts.items():
        assert got[i].size == len(WORD.findall(text)) and got[i].taken <= 2 * got[i].size
        total[source[i]] += got[i].size
        taken[source[i]] += got[i].taken
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(total), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    for i, r in got.items():
        assert r.source_size == total[source[i]] and r.target == pytest.approx(target[source[i]])
    assert all(abs(taken[s] - target[s]) <= max(1, 0.01 * target[s]) for s in total)


def test_op8(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    want, _ = classes(sets, alike)
    got = rows(spark, "op8_minhash_near_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), c, i == c) for i, c in want.items()}


def test_op9(spark, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = rows(spark, "op9_token_counts")
    for i, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(text.encode()), n, n > 2048)


def judged(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) by the plainest count."""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def compressed(text):
    """Whether all lengths lie in their band, or few bytes lie in chunks that do not."""
    data = text.encode()

    def bad(part):
        ratio = len(part) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(part))
        band = [b for b in quality.BANDS if len(part) >= b[0]]
        return bool(band) and not band[-1][1] <= ratio <= band[-1][2]

    parts = [data[k : k + quality.CHUNK] for k in range(0, len(data), quality.CHUNK)]
    return not bad(data) and (len(parts) < 2 or sum(len(p) for p in parts if bad(p)) <= quality.BAD_SHARE * len(data))


def test_op10(spark, texts):
    got = rows(spark, "op10_quality_rules")
    for i, text in texts.items():
        want = judged(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not want[-1] and compressed(text))


def ordered(part, whole):
    """Whether the words of ``part`` are found in ``whole`` in this order."""
    rest = iter(whole)
    return all(w in rest for w in part)


def check_stages(spark, docs):
    """Run every stage on the one before and recount its decisions; returns the last."""
    plain = lambda d: [tuple(r[c] for c in ("doc_id", "text", "source")) for r in d.collect()]
    stage = dict(corpus_pipeline.STAGES)
    run = lambda n, d: common.saved(stage[n](spark, d, SF), "test-stage")

    kept = run("quality rules", docs)
    assert Counter(plain(kept)) == Counter(r for r in plain(docs) if not judged(r[1] or "")[-1] and compressed(r[1] or ""))
    single = run("near-duplicates", kept)
    texts = sorted({r[:2] for r in plain(kept) if r[0] is not None})
    low, _ = classes({r: shingles(r[1]) for r in texts}, alike)
    left = {r[:2] for r in plain(single) if r[0] is not None}
    assert Counter(r[0] for r in plain(single)) == Counter([r[0] for r in plain(kept) if r[0] is None] + [g[0] for g in set(low.values())])
    assert left <= set(texts) and len({low[r] for r in left}) == len(left)
    clean = run("personal data", single)
    before = Counter(r[0] for r in plain(single))
    assert Counter(r[0] for r in plain(clean)) == before
    now = defaultdict(list)
    for i, t, s in plain(clean):
        now[i].append(t)
        assert not personal(t)
    mixed = run("mixture", clean)
    taken = defaultdict(int)
    for i, t, s in plain(mixed):
        assert any(ordered(WORD.findall(t), WORD.findall(x)) for x in now[i])
        taken[i] += len(WORD.findall(t))
    assert all(n <= 2 * sum(len(WORD.findall(x)) for x in now[i]) for i, n in taken.items())
    total = sum(len(WORD.findall(t)) for i, t, _ in plain(clean))
    assert abs(sum(taken.values()) - 1.5 * total) <= 2 + 0.01 * total
    for d in (kept, single, clean, mixed):
        assert d.columns == docs.columns and [f.dataType for f in d.schema] == [f.dataType for f in docs.schema]
    last = run("byte-level BPE", mixed)
    assert Counter((r.doc_id, r.decoded_sha256) for r in last.collect()) == Counter((i, digest(t.encode())) for i, t, _ in plain(mixed))
    return last


def test_pipeline(spark):
    last = check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in whole.collect()) == sorted((r.doc_id, r.ids_sha256) for r in last.collect())


def test_pipeline_edges(spark):
    rnd = random.Random(9)
    prose = lambda: " ".join(rnd.choice("stone river green walks under light seven never paper house cold tall quick about".split()) + str(rnd.randrange(300)) for _ in range(120))
    same, long = prose(), " ".join(prose() for _ in range(60))
    data = [(1, same), (1, prose()), (2, same), (3, same + " end"), (3, same + " end"), (8, prose()), (8, long + " z"), (9, long[:1500]), (9, long[:1500]), (4, None), (5, ""), (None, prose()), (6, prose() + " mail a.b@example.com now"), (7, long), (10, "x" * 3000), (11, "ab " * 900)]
    names = "doc_id long, text string, lang string, source string, n_chars int, kept string, size string, pieces string, id string, _text string, _row string, _n string, component_id string, `a b` string"
    clash = [(i, t, None, ("s", None)[(i or 0) % 2], None, "k", "z", "p", "i", "t", "r", "n", "c", None) for i, t in data]
    docs = spark.createDataFrame(clash, names)
    last = check_stages(spark, docs)
    assert {r.doc_id for r in last.collect()} == {1, None, 6, 7, 8, 9}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
