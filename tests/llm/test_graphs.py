"""Near-duplicates, mixing, chats and licences against brute force, with nulls, ties and empty tables."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm import chat, embedding_dedup, licenses, minhash, mixing
from assaykit.llm.common import components


def reach(ids, links):
    low = {i: i for i in ids}
    while True:
        old = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if old == low:
            return low


def test_components(spark):
    """Random graphs, long paths, and a hub whose edges lie in many tasks."""
    rnd = random.Random(1)
    path = list(range(2000, 2300))
    rnd.shuffle(path)
    links = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + list(zip(path, path[1:])) + [(1000, 1000 + i) for i in range(1, 150)] + [(5, 5)]
    want = reach({x for p in links for x in p}, links)
    want = {i: c for i, c in want.items() if i in {x for p in links if p[0] != p[1] for x in p}}
    df = spark.createDataFrame(links, "a long, b long").repartition(9)
    got = [(r.id, r.component) for r in components(df).collect()]
    assert dict(got) == want and len(got) == len(want)
    assert components(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rnd = random.Random(2)
    docs = []
    for i in range(150):
        base = list(rnd.choice(docs)[1].split()) if docs and rnd.random() < 0.5 else [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 120))]
        for _ in range(rnd.randrange(3)):
            base[rnd.randrange(len(base))] = f"w{rnd.randrange(60)}"
        docs.append((i, " ".join(base)))
    docs += [(200, None), (201, ""), (202, "Same"), (203, "same")]
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    want = reach(sets, links)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nested_near_duplicates(spark):
    """Short documents that come again with some words added, beyond what a sketch holds."""
    rnd = random.Random(5)
    docs = []
    for n in range(20, 26):
        for m in range(n, n * 4 // 3 + 1):
            for _ in range(8):
                words = [f"x{rnd.getrandbits(40)}" for _ in range(m + 4)]
                docs += [(len(docs), " ".join(words[: n + 4])), (len(docs) + 1, " ".join(words))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_least_shared():
    for size in (minhash.SKETCH, minhash.LONG):
        for n in range(1, size + 1):
            met = [k - max(0, m - size) for m in range(1, 2 * n + 2) for k in range(min(n, m) + 1) if 100 * k >= 75 * (n + m - k)]
            assert minhash.short_shared(n, size) == min(met)
    assert minhash.met_least(24) == 6


def heavy(rnd):
    """Two groups of edited copies, one passage in many texts, and texts that are mostly passage."""
    word = lambda: f"y{rnd.randrange(10**9)}"
    docs = []
    for size, edits in ((60, 4), (25, 9)):
        base = [word() for _ in range(150)]
        docs += [" ".join(word() if rnd.random() < edits / 150 else w for w in base) for _ in range(size)] + [" ".join(base)]
    passage = [word() for _ in range(60)]
    docs += [" ".join(passage + [word() for _ in range(rnd.randrange(5, 90))]) for _ in range(70)]
    return list(enumerate(rnd.sample(docs, len(docs))))


def brute(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return reach(sets, [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0])


def test_heavy_lists(spark, monkeypatch):
    """Lists far longer than a block, in all three ways to get through them."""
    docs = heavy(random.Random(8))
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    get = lambda **k: {r.doc_id: r.component_id for r in minhash.near_duplicates(df, **k).collect()}
    monkeypatch.setattr(minhash, "BLOCK", 8)
    assert get() == want and get(exact=True) == want
    monkeypatch.setattr(minhash, "united", lambda lists, tables: lists.select(F.struct("v").alias("unit"), "node", "c"))
    assert get() == want


def test_rows_of_one_key(spark):
    """Repeated rows, and one key with several texts, beside columns with the names of inner ones."""
    a, b = (" ".join(f"{k}{i}" for i in range(40)) for k in "ab")
    rows = [(1, a, "x", 3), (1, a, "x", 3), (1, b, "y", 4), (2, b, "y", 4), (None, a, "x", 3), (3, None, None, 0), (4, "one", "z", 1), (4, "One", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string, n int")
    got = sorted((r.id or 0, r.n_shingles, r.component_id, r.kept, r.first) for r in minhash.grouped(df).collect())
    assert got == [(0, 36, None, True, True), *[(1, 36, 1, True, True)] * 3, (2, 36, 1, False, False), (3, 0, 3, True, True), (4, 1, 4, True, False), (4, 1, 4, True, True)]


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [3.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [1.0, None]), (9, [0.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[1] == (1, 1, True) and got[2] == (1, 1, False) and got[6] == (1, 5, False) and got[9] == (0, 9, True) and got[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_few_directions(spark, monkeypatch):
    """Links cross the planes between cells far more often than in all dimensions alike."""
    monkeypatch.setattr(embedding_dedup, "CELL", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.11
    v = np.concatenate([x, y, x[:20]]) @ np.linalg.qr(rng.normal(size=(128, 6)))[0].T
    u = v / np.linalg.norm(v, axis=1)[:, None]
    met = np.argwhere(np.triu(u @ u.T >= embedding_dedup.LINK, 1))
    want = reach(range(len(v)), met.tolist())
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(rows).collect()}
    assert got == {i: (int((met == i).sum()), want[i]) for i in range(len(v))}


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    monkeypatch.setattr(mixing, "SHARD", 9_000)
    monkeypatch.setattr(mixing, "BUCKET", 6_000)
    rnd = random.Random(3)
    rows = [(i, " w" * rnd.randrange(3000), rnd.choice(["a", "b", "é", None])) for i in range(120)] + [(500, None, "a"), (None, "x y", "b")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, source string, idx string, size int")
    got = mixing.mix(df).collect()
    per = defaultdict(lambda: [0, 0])
    for r in got:
        assert r.taken == sum(p.words for p in r.pieces) <= 2 * r.size and r.idx == "k"
        # pieces of one pass are disjoint and inside the document
        for e in {p.epoch for p in r.pieces}:
            spans = sorted((p.start, p.start + p.words) for p in r.pieces if p.epoch == e)
            assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= r.size
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
    for r in got:
        assert r.source_size == per[r.source][0] and per[r.source][1] == round(r.target) and r.target <= 2 * r.source_size
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * sum(x for x, _ in per.values())) < 1e-6
    again = mixing.mix(df.repartition(7)).collect()
    plan = lambda rows: sorted((r.doc_id or -1, r.taken, str(r.pieces)) for r in rows)
    assert plan(got) == plan(again)
    # shards are as large as the tree makes them, mixed by all sources, and in the order of their places
    words = defaultdict(int)
    for r in got:
        for p in r.pieces:
            words[p.shard] += p.words
    n = len(words)
    assert n > 10 and max(words.values()) < 1.5 * sum(words.values()) / n
    texts = mixing.mixed_texts(df).collect()
    assert sum(len(r.text.split()) for r in texts) == sum(words.values())
    assert [f.name for f in mixing.mixed_texts(df).schema] == df.columns
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_texts(df.limit(0)).count() == 0


def test_tree():
    """Leaves have the sums of shards and of sources, and a source's draws are disjoint blocks of its passes."""
    counts, sizes = np.array([5, 0, 1000, 37, 1]), np.array([300, 1, 0, 442, 300])
    got = dict(mixing.leaves(counts, sizes, [1]))
    assert [int(got[k].sum()) for k in range(5)] == sizes.tolist() and sum(got.values()).tolist() == counts.tolist()
    other = dict(mixing.leaves(counts, sizes, [2]))
    assert any((got[k] != other[k]).any() for k in range(5))
    for size, target in ((1000, 2000.0), (1000, 1234.4), (7, 3.0), (64, 64.0), (130, 129.0), (5, 0.0)):
        own = mixing.Draws(3, size, target, 64, 7)
        epoch, block, end = own.taken(np.arange(own.all))
        assert int((end - block * 64).sum()) == round(target)
        assert len(set(zip(epoch.tolist(), block.tolist()))) == own.all and block.max(initial=0) < own.blocks
        assert (own.permuted(0, own.permuted(0, np.arange(own.blocks)), True) == np.arange(own.blocks)).all()


def test_targets(spark):
    """Levels of targets against resharing by hand, over more sources than one range."""
    rnd = random.Random(12)
    own = {f"s{i:03}": rnd.randrange(0, 2000) for i in range(150)} | {None: 77}
    from assaykit.llm.common import Tables

    got = {r._src: r for r in mixing.sources(spark.createDataFrame(list(own.items()), "_src string, _n long"), Tables(spark)).collect()}
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    open_, left, target = set(own), 1.5 * sum(own.values()), {}
    while over := [s for s in open_ if left / sum(weight[x] for x in open_) * weight[s] > 2 * own[s]]:
        for s in over:
            target[s] = 2 * own[s]
        open_ -= set(over)
        left = 1.5 * sum(own.values()) - sum(target.values())
    level = left / sum(weight[x] for x in open_)
    assert [got[s].idx for s in order] == list(range(len(order)))
    assert all(abs(got[s].target - target.get(s, level * weight[s])) < 1e-6 for s in own)


def cheapest(roles):
    """Least cost of a repair, trying every new role, merge and insertion, without the automaton's moves."""
    best = [1e9]

    def go(i, cost, out):
        if cost >= best[0]:
            return
        if i == len(roles):
            for more in ("", "a", "ua"):
                if re.fullmatch("s?(ua)+", out + more):
                    best[0] = min(best[0], cost + 3 * len(more))
            return
        for new in "sua":
            change = cost + 2 * (new != {"system": "s", "user": "u", "assistant": "a"}.get(roles[i]))
            if out[-1:] == new:
                go(i + 1, change + 1, out)
            for extra in ("", "s", "u", "a"):
                if re.fullmatch("s?(ua)*u?", out + extra + new):
                    go(i + 1, change + 3 * len(extra), out + extra + new)

    go(0, 0, "")
    return best[0]


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    monkeypatch.setattr(chat, "GROUP", 2)
    rnd = random.Random(4)
    roles = ["system", "user", "assistant", "tool", None]
    data = {c: [rnd.choice(roles) for _ in range(rnd.randrange(1, 6))] for c in range(60)} | {99: [rnd.choice(roles) for _ in range(70)]}
    rows = [(c, i, r, f"t{c}.{i}", 1, "x", "y") for c, rs in data.items() for i, r in enumerate(rs)] + [(None, None, "user", None, 1, "x", "y"), (99, 69, data[99][69], "t99.69", 1, "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, seq int, _seg string, rendered string")
    data[99].append(data[99][69])
    turns = chat.format_chats(df).cache()
    got = turns.collect()
    text = defaultdict(list)
    for r in got:
        text[r.conv_id].append((r.seq, r.rendered))
        if r.conv_id is not None:
            assert r.total_cost == (cheapest(data[r.conv_id]) if r.conv_id < 99 else r.total_cost)
    for c, parts in text.items():
        whole = "".join(t for _, t in sorted(parts))
        assert re.fullmatch("s?(ua)+", "".join(x[0] for x in re.findall(r"<\|(system|user|assistant)\|>", whole)))
        if c is not None:
            assert re.findall(r"t\d+\.\d+", whole) == sorted((f"t{c}.{min(i, 69)}" for i in range(len(data[c]))), key=lambda t: int(t.split(".")[1]))
    # one segment and one group give the same costs
    monkeypatch.setattr(chat, "SEGMENT", 512)
    plain = {r.conv_id: r.total_cost for r in chat.format_chats(df).collect()}
    assert {r.conv_id: r.total_cost for r in got} == plain
    monkeypatch.setattr(chat, "SEGMENT", 3)
    own = defaultdict(dict)
    for r in chat.conversations(turns).collect():
        own[r.conv_id][r.part] = r.text
        assert r.parts == 1 or len(text[r.conv_id]) > 3
    assert {c: "".join(p[k] for k in range(len(p))) for c, p in own.items()} == {c: "".join(t for _, t in sorted(p)) for c, p in text.items()}
    assert chat.format_chats(df.limit(0)).count() == 0 and chat.conversations(turns.limit(0)).count() == 0


def plain_licenses(files):
    """id -> (own, score, whole, license, inherited from, depth), by the plainest count over (id, path, text)."""
    words = lambda t: Counter(re.findall("[a-z0-9]+", (t or "").lower()))
    df = Counter(t for _, _, x in files for t in words(x))
    idf = lambda t: math.log((1 + len(files)) / (1 + df[t])) + 1

    def cosine(x, y):
        dot = sum(n * y[t] * idf(t) ** 2 for t, n in x.items())
        return dot / math.sqrt(sum((n * idf(t)) ** 2 for t, n in x.items()) * sum((n * idf(t)) ** 2 for t, n in y.items()))

    def best(text, of, least):
        found = [(-round(cosine(words(text), words(x)), 9), name) for name, xs in of.items() for x in xs]
        return [(s, n) for s, n in found if -s >= least]

    own = {}
    for i, path, text in files:
        if not licenses.CUE.search(text or ""):
            continue
        whole = best(text, licenses.WHOLE, licenses.LEAST_FILE)
        heads = [x for b in licenses.blocks(text) for x in best(b, licenses.NOTICES, licenses.LEAST_HEADER)]
        if whole or heads:
            s, name = min(whole or heads)
            own[i] = (name, -s, bool(whole))
    up = lambda p: p.rpartition("/")[0]
    is_file = {i: i in own and own[i][2] or bool(licenses.NAMES.search(p or "")) for i, p, _ in files}
    votes = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for i, p, _ in files:
        if i in own:
            votes[up(p or "")][own[i][0]][0] += is_file[i]
            votes[up(p or "")][own[i][0]][1] += 1
    declared = {}
    for d, of in votes.items():
        name, (n_files, n) = min(of.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))
        if n_files or n > licenses.MOST * sum(x[1] for x in of.values()):
            declared[d] = name
    out = {}
    for i, p, _ in files:
        name, score, _ = own.get(i, (None, None, None))
        row = (name, score, is_file[i], name, None, None)
        d, depth = up(p or ""), 0
        while name is None:
            if d in declared:
                row = (None, None, is_file[i], declared[d], d, depth)
                break
            if not d:
                break
            d, depth = up(d), depth + 1
        out[i] = row
    return out


def test_licenses(spark):
    rnd = random.Random(11)
    prose = lambda n: " ".join(rnd.choice("river stone light under copy the of version green walks software terms".split()) for _ in range(n))
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing here"), (3, "c/y.txt", "no words"), (4, "a/b/z.txt", "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text follows."), (5, None, None), (6, "", "")]
    texts = [x for of in (licenses.NOTICES, licenses.WHOLE) for xs in of.values() for x in xs]
    for i in range(7, 90):
        path = "/".join(rnd.choice(["p", "q", "r"]) for _ in range(rnd.randrange(1, 5))) + f"/f{i}"
        body = rnd.choice([prose(40), rnd.choice(texts), prose(30) + ".\n" + rnd.choice(texts) + "\n" + prose(30), prose(9) + ". All warranties end. " + prose(9)])
        files.append((i, path, body))
    files += [(90, "t/tie.txt", "SPDX-License-Identifier"), (91, "z/long.txt", prose(30_000) + ".\n" + texts[0]), (92, "z/w/COPYING", prose(10))]
    rows = [(*f, "clash", 1, "k") for f in files]
    df = spark.createDataFrame(rows, "doc_id long, p string, text string, license string, df int, _dir string")
    got = {r.doc_id: (r.own_license, r.score, r.is_license_file, r.license, r.inherited_from, r.depth) for r in licenses.scan(df, F.col("p")).collect()}
    want = plain_licenses(files)
    for i in want:
        assert got[i][0] == want[i][0] and got[i][2:] == want[i][2:], (i, got[i], want[i])
        assert got[i][1] is None and want[i][1] is None or abs(got[i][1] - want[i][1]) < 1e-6
    assert got[1][0] == "MIT" and got[2][3] == "Apache-2.0" and sum(x[2] for x in got.values()) > 5
    twice = licenses.scan(df.unionAll(df.limit(1)), F.col("p"))
    assert twice.count() == len(files) + 1 and licenses.scan(df.limit(0), F.col("p")).count() == 0
