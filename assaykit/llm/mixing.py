"""Mixing sources to target weights.

Every source is a stream of words, its documents laid end to end in a hashed order, cut into
blocks. A source's target says how many block draws it gets: whole passes and a part of one more,
whose last block is cut so that the words come out exactly. A splitting tree deals these quotas to
output shards: each node halves its shards and draws, from a multivariate hypergeometric law seeded
by the node, how many of each source's draws go left; its leaves are the shards' quotas. A shard
takes that many of each source's draws, and which blocks those are is a keyed permutation of block
numbers, so draws of one pass are disjoint. Draws are joined with the documents that hold their
blocks, and a shard's pieces are put in the order of a keyed hash.

Sources are never collected: their order comes from range partitions, the level of their targets
from a few aggregations, and the tree works on groups of sources first and then inside each group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import Tables, give_back
from assaykit.llm.minhash import spread

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Words of a block, of a bucket in which running places are summed, and of an output shard.
BLOCK, BUCKET, SHARD = 4096, 1 << 17, 1 << 18
#: With more words than so many blocks or shards of this size hold, blocks and shards are longer. The
#: first is what numpy's hypergeometric law can take, the second bounds the tree.
MOST_BLOCKS, MOST_SHARDS = 500_000_000, 1 << 16
#: Groups of sources of the tree's upper part; largest bytes of a table of sources that is broadcast.
GROUPS, BROADCAST_BYTES = 256, 64 << 20
PIECE = "array<struct<epoch:int,shard:int,place:bigint,start:bigint,words:bigint>>"


def sources(sizes: DataFrame, tables: Tables, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """_src, source_size, idx, target from (_src, _n): weights by code point order with null last.

    Targets share ``share`` of all sizes by weight and stop at ``cap`` times their size; what is left over is
    shared again among the others until none is above. Each time is one aggregation to a row.
    """
    order = F.col("_src").asc_nulls_last()
    per = sizes.groupBy("_src").agg(F.sum("_n").alias("source_size")).repartitionByRange(order).sortWithinPartitions(order)
    per = tables.save(per.withColumn("_at", F.monotonically_increasing_id()), "mix-ordered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    bases, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in per.groupBy(part).count().collect()):  # a row for each partition
        bases.append((p, total))
        total += n
    per = per.join(F.broadcast(sizes.sparkSession.createDataFrame(bases, "_p long, _base long")), part == F.col("_p"))
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    per = per.select("_src", "source_size", (F.col("_base") + inside).alias("idx")).withColumn("w", weight)
    words, weights = per.agg(F.sum("source_size"), F.sum("w")).first()
    level, before = 0.0, -1.0
    while words and level != before:
        stops = F.col("source_size") * cap <= F.lit(level) * F.col("w")
        full, rest = per.agg(F.sum(F.when(stops, F.col("source_size"))), F.sum(F.when(~stops, F.col("w")))).first()
        if not rest:
            break
        level, before = (words * share - (full or 0) * cap) / rest, level
    return per.select("_src", "source_size", "idx", F.least(F.col("source_size") * float(cap), F.col("w") * F.lit(float(level))).alias("target"))


class Draws:
    """The block draws of one source: ``passes`` whole passes and ``last`` blocks of one more, which give ``part`` words."""

    def __init__(self, idx: int, size: int, target: float, block: int, seed: int):
        self.idx, self.size, self.block, self.seed = idx, size, block, seed
        self.blocks = -(-size // block)
        words = round(target)
        self.passes, self.part = divmod(words, size) if size else (0, 0)
        self.last = 0
        if self.part:
            self.last = -(-self.part // block)
            self.last += self.before(self.passes, self.last) < self.part
        self.all = self.passes * self.blocks + self.last

    def permuted(self, epoch: int, at: np.ndarray, back: bool = False) -> np.ndarray:
        """A bijection of [0, blocks), or its inverse: a four-round Feistel network, walked until it falls inside."""
        half = max(1, (max(self.blocks - 1, 1).bit_length() + 1) // 2)
        low, mask = np.uint64(half), np.uint64((1 << half) - 1)
        keys = np.random.default_rng([self.seed, self.idx, epoch]).integers(0, 1 << 62, 4, np.uint64)

        def once(x: np.ndarray) -> np.ndarray:
            a, b = x >> low, x & mask
            for k in keys[::-1] if back else keys:
                if back:
                    a, b = b ^ (spread(a + k) & mask), a
                else:
                    a, b = b, a ^ (spread(b + k) & mask)
            return (a << low) | b

        out = once(at.astype(np.uint64))
        while (outside := out >= self.blocks).any():
            out[outside] = once(out[outside])
        return out.astype(np.int64)

    def before(self, epoch: int, rank: int) -> int:
        """Words of the blocks of lower rank; the source's last block is shorter."""
        short = self.blocks * self.block - self.size
        return rank * self.block - short * (rank > int(self.permuted(epoch, np.array([self.blocks - 1]), True)[0]))

    def taken(self, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and its end, in words of the source, of these draws."""
        epoch, rank = draw // self.blocks, draw % self.blocks
        block = np.empty_like(draw)
        for e in np.unique(epoch).tolist():
            block[epoch == e] = self.permuted(e, rank[epoch == e])
        end = np.minimum((block + 1) * self.block, self.size)
        cut = (epoch == self.passes) & (rank == self.last - 1)
        if cut.any():
            end[cut] = np.minimum(end[cut], block[cut] * self.block + self.part - self.before(self.passes, self.last - 1))
        return epoch, block, end


def leaves(counts: np.ndarray, sizes: np.ndarray, seed: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The splitting tree: (shard, draws of each source) with these sums for sources and for shards."""
    todo = [(0, len(sizes), counts)]
    while todo:
        first, n, own = todo.pop()
        if n == 1:
            yield first, own
            continue
        half = n // 2
        rng = np.random.default_rng([*seed, first, n])
        left = rng.multivariate_hypergeometric(own, int(sizes[first : first + half].sum()), method="marginals")
        todo += [(first + half, n - half, own - left), (first, half, left)]


def counted(block: int, seed: int):
    """Add the number of draws to sources (idx, source_size, target)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [Draws(i, s, t, block, seed).all for i, s, t in zip(*(b.column(c).to_pylist() for c in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "draws"])

    return run


def dealt(seed: int):
    """The leaves of one group of sources: (idx, source_size, target, shard, first, draws), without those of no draws."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        group, counts = table["group"][0].as_py(), table["draws"].to_numpy().astype(np.int64)
        sizes = np.array(table["sizes"][0].as_py(), np.int64)
        first = np.zeros(len(counts), np.int64)
        rows, shards, firsts, draws = [], [], [], []
        for shard, own in leaves(counts, sizes, [seed, group + 1]):
            at = np.flatnonzero(own)
            rows.append(at)
            shards.append(np.full(len(at), shard))
            firsts.append(first[at])
            draws.append(own[at])
            first = first + own
        out = table.select(["idx", "source_size", "target"]).take(pa.array(np.concatenate(rows)))
        for name, parts, kind in (("shard", shards, pa.int32()), ("first", firsts, pa.int64()), ("draws", draws, pa.int64())):
            out = out.append_column(name, pa.array(np.concatenate(parts), kind))
        return out

    return run


def drawn(block: int, seed: int):
    """A row for each draw of the leaves: (idx, block, epoch, shard, place, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Draws] = {}
        for b in batches:
            for i, size, target, shard, first, n in zip(*(c.to_pylist() for c in b.columns)):
                if len(known) > 10_000:
                    known.clear()
                own = known.get(i) or known.setdefault(i, Draws(i, size, target, block, seed))
                for lo in range(first, first + n, 65_536):
                    draw = np.arange(lo, min(first + n, lo + 65_536))
                    epoch, at, end = own.taken(draw)
                    key = np.random.default_rng([seed, i, 1 << 20]).integers(0, 1 << 62, 1, np.uint64)
                    place = (spread(spread(draw.astype(np.uint64) + key) + key) >> np.uint64(1)).astype(np.int64)
                    same = lambda x, kind: pa.array(np.full(len(draw), x), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(i, pa.int64()), pa.array(at), pa.array(epoch.astype(np.int32)), same(shard, pa.int32()), pa.array(place), pa.array(end)], names=["idx", "block", "epoch", "shard", "place", "end"])

    return run


def quotas(per: DataFrame, tables: Tables, block: int, seed: int) -> DataFrame:
    """The leaves of the tree for sources (idx, source_size, target), from groups of sources first."""
    per = tables.save(per.select("idx", "source_size", "target").mapInArrow(counted(block, seed), "idx long, source_size long, target double, draws long"), "mix-counts")
    n, words = per.agg(F.count("*"), F.sum(F.round("target"))).first()
    width = max(4096, -(-n // GROUPS))
    group = F.floor(F.col("idx") / width).cast("long")
    sums = sorted((r[0], r[1]) for r in per.groupBy(group).agg(F.sum("draws")).collect())  # at most GROUPS rows
    counts = np.array([x for _, x in sums], np.int64)
    shards = max(1, min(MOST_SHARDS, -(-int(words or 0) // SHARD)))
    total = int(counts.sum())
    cuts = np.array([total * k // shards for k in range(shards + 1)], np.int64)
    share = np.zeros((len(counts), shards), np.int64)
    for shard, own in leaves(counts, np.diff(cuts), [seed, 0]):
        share[:, shard] = own
    known = per.sparkSession.createDataFrame([(g, row.tolist()) for (g, _), row in zip(sums, share)], "group long, sizes array<bigint>")
    groups = per.withColumn("group", group).join(known, "group")
    return tables.save(groups.groupBy("group").applyInArrow(dealt(seed), "idx long, source_size long, target double, shard int, first long, draws long"), "mix-leaves")


def pieces_of(docs: pa.Table, draws: pa.Table, block: int) -> list[list[dict]]:
    """For the documents of one bucket, in order from ``_base``, what the draws take of each."""
    size = docs["size"].to_numpy()
    ends = docs["_base"][0].as_py() + np.cumsum(size)
    begins = ends - size
    out: list[list[dict]] = [[] for _ in size]
    names = ("block", "epoch", "shard", "place", "end")
    for at, epoch, shard, place, end in zip(*(draws[n].to_pylist() for n in names)):
        low = at * block
        for d in range(int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(begins, end, side="left"))):
            a, b = max(low, int(begins[d])), min(end, int(ends[d]))
            if a < b:
                out[d].append({"epoch": epoch, "shard": shard, "place": place, "start": a - int(begins[d]), "words": b - a})
    return [sorted(x, key=lambda p: (p["epoch"], p["start"])) for x in out]


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, seed: int = 7, each: Callable[[pa.Table], pa.Table] | None = None, fields: T.StructType | None = None) -> DataFrame:
    """Add size, source_size, target (of the source), taken and pieces.

    ``pieces`` lists what the mix takes of a document: pass, output shard, place (order within
    the shard), first word and words. Null texts have size 0 and nothing is taken of them; null
    sources are one source, the last. Equal keys are separate rows; rows equal in key and text
    are interchangeable. An empty table stays empty. Input columns with the names of added ones
    are replaced. Reruns agree, whatever the partitions. Hot sources are dealt by bucket; a long
    text is a bucket of its own. ``each``, with the ``fields`` it gives, turns every bucket of the
    result into another table in the same Python process; rows of size 0 do not come to it.
    """
    tables = Tables(df.sparkSession)
    added = ["size", "source_size", "target", "taken", "pieces"]
    stay = [c for c in (df.columns if keep is None else keep) if c not in added]
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in stay]).alias("_row"), F.col(f"`{source}`").alias("_src"), size.alias("size"), hashed.alias("_h"))
    slim = tables.save(rows.select("_src", F.col("size").alias("_n"), "_h"), "mix-sizes")
    if text not in stay:
        rows = tables.save(rows, "mix-rows")
    per = tables.save(sources(slim, tables), "mix-sources")
    words, width = per.agg(F.sum(F.round("target")), F.sum(F.coalesce(F.octet_length("_src"), F.lit(0)) + 64)).first()
    block = max(BLOCK, -(-int(words or 0) // MOST_BLOCKS))
    if (width or 0) <= BROADCAST_BYTES:
        per = F.broadcast(per)
    same = F.col("_src").eqNullSafe(F.col("_s"))
    bucket = F.pmod(F.col("_h"), F.floor(F.col("source_size") / BUCKET) + 1).alias("_bucket")
    numbered = lambda d: d.join(per.withColumnRenamed("_src", "_s"), same).drop("_s", "_src").withColumn("_bucket", bucket)
    sums = numbered(slim).where("_n > 0").groupBy("idx", "_bucket").agg(F.sum("_n").alias("_w"))
    sums = tables.save(sums, "mix-buckets")
    base = tables.save(running(sums), "mix-bases")
    blocks = base.select("idx", "_bucket", F.explode(F.sequence(F.floor(F.col("_base") / block), F.floor((F.col("_base") + F.col("_w") - 1) / block))).alias("block"))
    leaf = quotas(per, tables, block, seed)
    draws = leaf.repartition(F.col("idx"), F.col("shard")).mapInArrow(drawn(block, seed), "idx long, block long, epoch int, shard int, place long, end long")
    draws = tables.save(draws.join(blocks, ["idx", "block"]), "mix-draws")
    ours = numbered(rows)
    placed = ours.where("size > 0").join(base.drop("_w"), ["idx", "_bucket"])
    schema = fields or T.StructType([*rows.schema["_row"].dataType, *T.StructType.fromDDL(f"size long, source_size long, target double, taken long, pieces {PIECE}")])
    kind = pa.list_(pa.struct([("epoch", pa.int32()), ("shard", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("words", pa.int64())]))

    def run(docs: pa.Table, own: pa.Table) -> pa.Table:
        docs = docs.sort_by([("_h", "ascending"), ("size", "ascending")])
        got = pieces_of(docs, own, block)
        row = docs["_row"].combine_chunks()
        columns = [row.field(c) for c in stay] + [docs[c].combine_chunks() for c in ("size", "source_size", "target")]
        out = pa.Table.from_arrays([*columns, pa.array([sum(p["words"] for p in x) for x in got], pa.int64()), pa.array(got, kind)], names=[*stay, *added])
        out = each(out) if each else out
        if text in stay:
            give_back()
        return out

    taken = placed.groupBy("idx", "_bucket").cogroup(draws.groupBy("idx", "_bucket")).applyInArrow(run, schema)
    if each:
        return taken
    none = ours.where("size = 0").select("_row.*", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast(PIECE).alias("pieces"))
    return taken.unionAll(none)


def running(sums: DataFrame) -> DataFrame:
    """Add _base, the words of a source's buckets before: sums of spans of buckets first, then inside each span."""
    span = F.floor(F.col("_bucket") / 4096).alias("_span")
    of = sums.withColumn("_span", span)
    spans = of.groupBy("idx", "_span").agg(F.sum("_w").alias("_s"))
    spans = spans.select("idx", "_span", (F.sum("_s").over(Window.partitionBy("idx").orderBy("_span")) - F.col("_s")).alias("_over"))
    inside = F.sum("_w").over(Window.partitionBy("idx", "_span").orderBy("_bucket")) - F.col("_w")
    return of.withColumn("_in", inside).join(spans, ["idx", "_span"]).select("idx", "_bucket", "_w", (F.col("_in") + F.col("_over")).alias("_base"))


def texts_of(word):
    """Turn documents with pieces (rest, text, size, pieces) into a row for each pass and shard, with the words taken."""

    def run(table: pa.Table) -> pa.Table:
        rows, texts, shards, places = [], [], [], []
        for i, (text, size, pieces) in enumerate(zip(*(table[c].to_pylist() for c in ("text", "size", "pieces")))):
            runs: dict[tuple[int, int], list] = {}
            for p in pieces:  # by pass, then start
                own = runs.setdefault((p["epoch"], p["shard"]), [p["place"]])
                if len(own) > 1 and own[-1][1] == p["start"]:
                    own[-1][1] += p["words"]
                else:
                    own.append([p["start"], p["start"] + p["words"]])
            words = None
            for (_, shard), (place, *parts) in runs.items():
                rows.append(i)
                shards.append(shard)
                places.append(place)
                if parts == [[0, size]]:
                    texts.append(text)
                    continue
                words = words or [m.span() for m in word.finditer(text)]
                texts.append("\n".join(text[words[a][0] : words[b - 1][1]] for a, b in parts))
        rest = table["rest"].take(pa.array(rows, pa.int64()))
        return pa.Table.from_arrays([rest, pa.array(texts, pa.string()), pa.array(shards, pa.int32()), pa.array(places, pa.int64())], names=["rest", "text", "shard", "place"])

    return run


def mixed_texts(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """What the mix takes, shard by shard in the order of their shuffle: the columns of ``df``, with the words taken for text.

    A row for each document, pass and output shard that takes words of it. Words that are not next to each
    other in the document are parted by a line break. Rows without words give none; the rest as in ``mix``.
    """
    import re

    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("rest")
    slim = df.select(rest, F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("_key"), F.col(f"`{source}`").alias("_source"))
    fields = T.StructType([*slim.select("rest", "text").schema, *T.StructType.fromDDL("shard int, place long")])
    out = mix(slim, "_key", "text", "_source", keep=["rest", "text"], seed=seed, each=texts_of(re.compile(WORD)), fields=fields)
    out = out.repartition("shard").sortWithinPartitions("shard", "place")
    return out.select(*[F.col("text").alias(text) if c == text else F.col("rest")[c].alias(c) for c in df.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken. Nulls, ties and repeats as in ``mix``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]).drop("pieces")
