"""MinHash near-dedup with bottom-k sketches from one hash function.

Every document's distinct word shingles are hashed once; the SKETCH smallest values are its
sketch. Documents with equal sets are one class, and only its representative goes on. Retained
values are inverted into lists of the documents that hold them; documents that share too few
values with anyone to be 75 % alike leave here, most of them before anything else is made of them.
What is left gets a longer sketch, and a list only for its rarest values: as many as it takes to
meet every partner that shares what a link must share.

Links inside lists are sought without emitting all pairs. Lists of the same members are one. Each
list has one hub, the member whose values are shared most: of a group of copies that is the text
they were made from, to which nearly all link. Members meet the hub: united sketches estimate their
resemblance, and pairs that may reach the limit are confirmed on full sets. Links contract the
graph, and a list whose members are one component is done. Lists that are not are put together
where they have members in common (or left as they are where that is less work), and members
outside the largest component meet all members in blocks of bounded size, on full sets; a block
gives links between components, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import Tables, bounded, components, map_texts

WORDS, LIMIT = 5, (75, 100)
#: Values of the sketch of every document, and of the longer one of documents that go on.
SKETCH, LONG = 24, 128
#: Probability with which a pair exactly LIMIT alike, both longer than a sketch, may share less than is asked of it.
MISS = 1e-7
#: Members of a block's side.
BLOCK = 256
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def spread(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that small values are a fair sample."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingler(size: int = WORDS) -> Callable[[str], np.ndarray]:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    step = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(size)], np.uint64)
    memo: dict[bytes, int] = {}

    def code(word: bytes) -> int:
        if (h := memo.get(word)) is None:
            if len(memo) > 200_000:
                memo.clear()
            h = memo[word] = xxhash.xxh64_intdigest(word)
        return h

    def sets(text: str) -> np.ndarray:
        words = text.encode().translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(code, words), np.uint64, len(words))
        n = min(size, len(words))
        total = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            total = spread(total + h[i : len(words) - n + 1 + i] * step[i])
        return np.unique(total)

    return sets


def sketcher() -> Callable[[list[str]], dict[str, list]]:
    import xxhash

    sets = shingler()

    def work(texts: list[str]) -> dict[str, list]:
        found = [sets(t) for t in texts]
        return {"n": [len(x) for x in found], "_set": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found], "_sketch": [x[:SKETCH].view(np.int64) for x in found]}

    return work


def set_maker() -> Callable[[list[str]], dict[str, list]]:
    sets = shingler()
    return lambda texts: {"_full": [sets(t).view(np.int64) for t in texts]}


def met_least(size: int) -> int:
    """Values of their ``size`` smallest that two longer sets LIMIT alike have in common, but for a probability of MISS.

    Each of the smallest values of their union is in both with that share, so at most a binomial tail is missed.
    """
    p, total = LIMIT[0] / LIMIT[1], 0.0
    for k in range(size + 1):
        total += comb(size, k) * p**k * (1 - p) ** (size - k)
        if total > MISS:
            return k
    return size


def short_shared(n: int, size: int = SKETCH) -> int:
    """Values of its sketch, its whole set, that a document of n <= size shingles shares at least with one that is 75 % alike.

    One of m shingles has to share LIMIT of both, of which m - size may be missing in its own sketch.
    """
    a, b = LIMIT
    return min(-(-a * (n + m) // (a + b)) - max(0, m - size) for m in range(-(-a * n // b), b * n // a + 1))


def least_shared(n: Column, size: int | None) -> Column:
    """Values of its sketch of ``size`` (None: of its whole set) that a document must share with one that is 75 % alike."""
    if size is None:
        return F.ceil(n * LIMIT[0] / LIMIT[1])
    short = F.array(*[F.lit(short_shared(i, size)) for i in range(1, size + 1)])
    return F.when(n <= size, F.get(short, n.cast("int") - 1)).otherwise(F.lit(met_least(size)))


def alike(pairs: DataFrame, full: DataFrame, size: int | None) -> DataFrame:
    """(a, b) of the pairs that are 75 % alike: estimated on united sketches, then confirmed on full sets."""
    a, b = LIMIT
    if size is not None:
        ours = lambda id, s, n: full.select(F.col("node").alias(id), F.slice("_full", 1, size).alias(s), F.col("n").alias(n))
        both = pairs.join(ours("a", "x", "na"), "a").join(ours("b", "y", "nb"), "b").where(F.least("na", "nb") * b >= F.greatest("na", "nb") * a)
        # the smallest values of both, in the order of unsigned numbers: of these, those in both sketches
        unsigned = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))
        union = F.slice(F.array_sort(unsigned(F.array_union("x", "y"))), 1, size)
        met = F.size(F.array_intersect(union, unsigned(F.array_intersect("x", "y"))))
        whole = F.greatest("na", "nb") <= size
        pairs = both.where(met >= F.when(whole, F.ceil(a * (F.col("na") + F.col("nb")) / (a + b))).otherwise(F.lit(met_least(size)))).select("a", "b")
    left = pairs.join(full.select(F.col("node").alias("a"), F.col("_full").alias("x")), "a")
    both = left.join(full.select(F.col("node").alias("b"), F.col("_full").alias("y")), "b")
    return both.mapInArrow(confirm, "a long, b long")


def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda n: batch.column(batch.schema.get_field_index(n))  # noqa: B023, E731
        x, y = get("x"), get("y")
        xs, ys = x.values.to_numpy(), y.values.to_numpy()
        xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
        ok = []
        for i in range(len(x)):
            p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
            met = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
            ok.append(LIMIT[1] * met >= LIMIT[0] * (len(p) + len(q) - met))
        yield pa.RecordBatch.from_arrays([get("a"), get("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def parted(members: DataFrame, unit: str) -> DataFrame:
    """(unit, major, left, all): the largest component of each unit, the members outside it, and all of them."""
    per = members.groupBy(unit, "c").agg(F.count("*").alias("n"))
    per = per.groupBy(unit).agg(F.max(F.struct("n", "c")).alias("m"), F.sum("n").alias("all"))
    return per.select(unit, F.col("m.c").alias("major"), (F.col("all") - F.col("m.n")).alias("left"), "all")


def united(lists: DataFrame, tables: Tables) -> DataFrame:
    """(unit, node, c) from lists (v, node, c): lists with common members are one unit, unless they are less work one by one."""
    first = lists.groupBy("v").agg(F.min("node").alias("b"))
    clump = components(lists.join(first, "v").select(F.col("node").alias("a"), "b")).select(F.col("id").alias("node"), F.col("component").alias("clump"))
    known = tables.save(lists.join(clump, "node"), "near-clumps")
    work = F.sum(F.col("left").cast("double") * F.col("all"))
    one = parted(known.select("clump", "node", "c").distinct(), "clump").groupBy("clump").agg(work.alias("whole"))
    many = parted(known, "v").join(known.groupBy("v").agg(F.min("clump").alias("clump")), "v").groupBy("clump").agg(work.alias("apart"))
    told = known.join(bounded(tables.save(one.join(many, "clump").select("clump", (F.col("whole") <= F.col("apart")).alias("whole")), "near-work")), "clump")
    unit = F.when(F.col("whole"), F.struct(F.lit(0).alias("kind"), F.col("clump").alias("v"))).otherwise(F.struct(F.lit(1).alias("kind"), "v"))
    return told.select(unit.alias("unit"), "node", "c").distinct()


def blocks(members: DataFrame, full: DataFrame, tables: Tables) -> DataFrame:
    """(a, b) of links between components inside units (unit, node, c), on full sets.

    Of each unit, the members outside its largest component meet all members, in blocks of
    bounded size. A block gives one link for each member and component, not its pairs.
    """
    size = parted(members, "unit").select("unit", "major", F.ceil(F.col("left") / BLOCK).alias("rows"), F.ceil(F.col("all") / BLOCK).alias("cols"))
    dealt = members.join(tables.save(size, "near-blocks"), "unit").join(full.select("node", "_full"), "node")
    block = F.xxhash64("node", F.lit(3))
    left = dealt.where("c <> major").select("unit", F.pmod(block, "rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"), F.lit(True).alias("left"), F.col("node").alias("id"), "c", "_full")
    right = dealt.select("unit", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(block, "cols").alias("j"), F.lit(False).alias("left"), F.col("node").alias("id"), "c", "_full")
    return left.unionAll(right).groupBy("unit", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def meet(table: pa.Table) -> pa.Table:
    is_left = table["left"].to_numpy()
    ids, comps = table["id"].to_numpy(), table["c"].to_numpy()
    column = table["_full"].combine_chunks()
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    right = np.flatnonzero(~is_left)
    owner = np.repeat(right, sizes[right])
    held = np.concatenate([values[offsets[r] : offsets[r + 1]] for r in right.tolist()]) if len(right) else values[:0]
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    found = set()
    for i in np.flatnonzero(is_left).tolist():
        own = values[offsets[i] : offsets[i + 1]]
        lo, hi = np.searchsorted(held, own), np.searchsorted(held, own, side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met = np.bincount(owner[at], minlength=len(ids))
        linked = np.flatnonzero((LIMIT[1] * met >= LIMIT[0] * (sizes[i] + sizes - met)) & (met > 0) & (comps != comps[i]))
        for k in np.unique(comps[linked], return_index=True)[1]:
            a, b = int(ids[i]), int(ids[linked[k]])
            found.add((max(a, b), min(a, b)))
    pairs = sorted(found)
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def listed(full: DataFrame, size: int | None, tables: Tables) -> DataFrame:
    """(v, node, hub): lists of the documents for which v is one of their rarest shared values, one of each set of members.

    The rarest value that two documents share is in the lists of both, if they share as many as they must.
    """
    sketch = F.col("_full") if size is None else F.slice("_full", 1, size)
    posted = full.select("node", "n", F.explode(sketch).alias("v"))
    often = tables.save(posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "near-often")
    own = Window.partitionBy("node")
    ours = posted.join(often, "v").withColumns({
        "met": F.count("*").over(own),
        "weight": F.sum(F.length(F.bin("df"))).over(own),
        "place": F.row_number().over(own.orderBy("df", "v")),
    })
    need = least_shared(F.col("n"), size)
    length = F.col("n") if size is None else F.least("n", F.lit(size))
    entries = tables.save(ours.where((F.col("met") >= need) & (F.col("place") <= F.col("met") - need + 1)).select("v", "node", (F.col("weight") / length).alias("weight")), "near-entries")
    # a set of members is known by their number and two sums of their hashes
    per = entries.groupBy("v").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t"), F.max(F.struct("weight", "node")).alias("h")).where("k > 1")
    one = tables.save(per.groupBy("k", "s", "t").agg(F.min(F.struct("v", F.col("h.node").alias("hub"))).alias("x")).select("x.v", "x.hub"), "near-hubs")
    return tables.save(entries.join(one, "v").select("v", "node", "hub"), "near-lists")


def links(full: DataFrame, size: int | None, tables: Tables) -> DataFrame:
    """(id, component) of all documents of ``full`` (node, n, _full) that are linked."""
    lists = listed(full, size, tables)
    pairs = lists.where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    edges = tables.save(alike(pairs, full, size), "near-links")
    label = components(edges).select(F.col("id").alias("node"), "component")
    now = lists.join(label, "node", "left").select("v", "node", F.coalesce("component", "node").alias("c"))
    mixed = now.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("v")
    left = tables.save(now.join(mixed, "v"), "near-left")
    tables.drop("near-often", "near-entries", "near-hubs", "near-lists")
    if left.isEmpty():
        return label.withColumnRenamed("node", "id")
    members = tables.save(united(left, tables), "near-units")
    edges = edges.unionAll(tables.save(blocks(members, full, tables), "near-links"))
    return components(edges)


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """id, hash (of the text, by xxhash64), n_shingles, component_id, kept and first for every row.

    ``first`` holds for one row of each group, and for all rows that are not compared. Rows equal
    in key and text may all be it.
    """
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("_text"))
    tables = Tables(df.sparkSession)
    made = map_texts(docs, "_text", "n long, _set binary, _sketch array<bigint>", sketcher, keep=["id", "hash"])
    table = tables.save(made.withColumn("row", F.monotonically_increasing_id()), "near-sketches")
    own = table.where("_set is not null and id is not null")
    # equal sets are one class; its representative is the row of its smallest key, which may be there many times
    same = own.groupBy("_set", "id", "hash").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("n").alias("n"))
    classes = same.groupBy("_set").agg(F.min(F.struct("id", "row", "hash", "copies")).alias("x"), F.min("n").alias("n"))
    classes = tables.save(classes.select("_set", F.col("x.row").alias("node"), "x.id", "x.hash", (F.col("x.copies") > 1).alias("many"), "n"), "near-classes")
    able = classes
    if not exact:
        # documents that share too little with all others to have a link leave here
        sketches = tables.save(own.join(classes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "n", "_sketch"), "near-representatives")
        posted = sketches.select("node", "n", F.explode("_sketch").alias("v"))
        often = tables.save(posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1").select("v"), "near-shared")
        met = posted.join(often, "v").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("met"))
        able = tables.save(classes.join(met.where(F.col("met") >= least_shared(F.col("n"), SKETCH)).select("node"), "node"), "near-able")
        tables.drop("near-representatives", "near-shared")
    met = docs.join(bounded(able.select("id", "hash", "node", "n", "many")), ["id", "hash"])
    texts = met.where(~F.col("many")).select("node", "n", "_text")
    if not able.where("many").isEmpty():
        texts = texts.unionAll(met.where("many").groupBy("node").agg(F.first("n").alias("n"), F.first("_text").alias("_text")))
    full = tables.save(map_texts(texts, "_text", "_full array<bigint>", set_maker, keep=["node", "n"]), "near-sets")
    found = links(full, None if exact else LONG, tables)
    label = classes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("group", F.coalesce("component", "node"))
    # a group is named by its smallest key, and its first row is the representative of that key's class
    name = label.groupBy("group").agg(F.min(F.struct("id", "node", "hash")).alias("x"))
    label = tables.save(label.join(name, "group").select("_set", F.col("x.id").alias("component_id"), F.col("x.hash").alias("_first")), "near-labels")
    tables.drop(*[n for n in tables.paths if n not in ("near-sketches", "near-labels")])
    out = table.select("id", "hash", "n", F.when(F.col("id").isNotNull(), F.col("_set")).alias("_set")).join(label, "_set", "left")
    alone = F.col("component_id").isNull()
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select("id", "hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), kept.alias("kept"), (alone | (kept & (F.col("hash") == F.col("_first")))).alias("first"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """doc_id (named as ``key``), n_shingles, component_id, kept for every row.

    Rows link if 100 * common shingles >= 75 * all shingles of both; shingles are compared by
    64-bit hashes, of which two of n differ with a chance of n * n / 2**65 of being equal. Null and
    empty texts have no shingles and link with nothing. Rows with a null key are not compared and
    are kept, with a null component. Every row is a node of its own, and equal keys do not link;
    repeated rows have equal results. An empty table gives an empty result. Other columns are not
    read. Keys that are no whole numbers raise. Texts of any length are read whole.

    Sets of up to SKETCH shingles, and pairs of them, are never missed; of longer pairs that are 75 %
    alike, one is missed with a probability below 2 * MISS. ``exact`` misses none: all documents
    go on, and their lists are those of full sets, at the price of a posting for every shingle.
    """
    return grouped(df, key, text, exact).select(F.col("id").alias(key), "n_shingles", "component_id", "kept")


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicates: doc_id, n_shingles, component_id, kept. Nulls, ties and repeats as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
