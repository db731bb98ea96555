"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products.

Equal directions are one class with a weight. Centres are fitted on a bounded sample; every
vector goes to its nearest centre (home) and visits each other cell of a lower number whose
bisecting plane is near enough for a link to cross it, so no link is lost: if x is at home in e and
y in c, then y lies beyond the plane between e and c, and x, a unit vector too, at most the sine of
their angle before it. One of two cells is visited, and a link found there counts for both ends. Each home
vector meets all of its cell in blocks of bounded size; a block gives link counts and a spanning
forest of its links, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import Tables, bounded, components

LINK = 0.95
#: Bytes of the sample for the centres, and how many of its rows a centre must stand for: so the number of cells
#: grows with the vectors up to 131,072 / 16 centres of 64 dimensions, and cells only beyond.
SAMPLE_BYTES, PER_CENTRE = 64 << 20, 16
#: Rows a cell should have, rows of a block's side, and rows of the tiles in which a block is multiplied.
CELL, BLOCK, TILE = 4_096, 4_096, 1_024
#: How far before the plane between two cells a vector still visits the other: the sine of a link's widest angle.
REACH = math.sqrt(1 - LINK * LINK)


def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, normalised vectors in double precision and their digests; null where a vector can't link."""
    import xxhash

    for batch in batches:
        vectors, digests = [], []
        for x in batch.column(1).to_pylist():
            v = None
            if x and None not in x:
                a = np.array(x, np.float64)
                top = np.abs(a).max()
                if np.isfinite(a).all() and top > 0:
                    a = a / top
                    v = (a / np.linalg.norm(a)).tobytes()
            vectors.append(v)
            digests.append(xxhash.xxh3_128_digest(v) if v else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["id", "digest", "vec"])


def matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def centres(sample: np.ndarray, k: int, turns: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centres of the sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(turns):
        near = np.concatenate([np.argmax(part @ c.T, 1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def assign(c: np.ndarray, dim: int):
    """Rows for each cell that a vector is at home in or visits. Vectors of another length have a cell by length."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [len(x) // 8 for x in batch.column(2).to_pylist()]
            where: list[int] = []
            cells: list[int] = []
            homes: list[bool] = []
            own = [i for i, n in enumerate(size) if n == dim]
            for lo in range(0, len(own), 1024):
                part = own[lo : lo + 1024]
                sims = matrix(batch.column(2).take(pa.array(part, pa.int64()))) @ c.T
                home = np.argmax(sims, 1)
                at = np.arange(len(part))
                visits = sims[at, home][:, None] - sims <= REACH * apart[home] + 1e-9
                visits &= np.arange(len(c)) < home[:, None]
                visits[at, home] = True
                i, j = np.nonzero(visits)
                where += [part[x] for x in i.tolist()]
                cells += j.tolist()
                homes += (home[i] == j).tolist()
            for i, n in enumerate(size):
                if n != dim:
                    where.append(i)
                    cells.append(-n)
                    homes.append(True)
            taken = batch.take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(homes, pa.bool_()), *taken.columns], names=["cell", "home", *taken.schema.names])

    return run


def compare(table: pa.Table) -> pa.Table:
    """Counts of links of each row in this block, and a spanning forest of the links. Home rows meet each other from both sides, visitors only here."""
    left, right = table.filter(table["left"]), table.filter(pa.compute.invert(table["left"]))
    if not len(left) or not len(right):
        return pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    x, y = (matrix(t["vec"].combine_chunks()) for t in (left, right))
    dx, dy = np.array(left["digest"].to_pylist(), object), np.array(right["digest"].to_pylist(), object)
    idx, idy = left["id"].to_numpy(), right["id"].to_numpy()
    wx, wy, guests = left["weight"].to_numpy(), right["weight"].to_numpy(), ~right["home"].to_numpy()
    ids, at = np.unique(np.concatenate([idx, idy]), return_inverse=True)
    px, py = at[: len(idx)], at[len(idx) :]
    n, of_guests = np.zeros(len(dx), np.int64), np.zeros(len(dy), np.int64)
    label = np.arange(len(ids))
    for lo in range(0, len(x), TILE):
        for to in range(0, len(y), TILE):
            i, j = np.nonzero(x[lo : lo + TILE] @ y[to : to + TILE].T >= LINK)
            i, j = i + lo, j + to
            other = dx[i] != dy[j]
            i, j = i[other], j[other]
            np.add.at(n, i, wy[j])
            guest = guests[j]
            np.add.at(of_guests, j[guest], wx[i[guest]])
            join(label, px[i], py[j])
    moved = np.flatnonzero(label != np.arange(len(ids)))
    dx, n = np.concatenate([dx, dy]), np.concatenate([n, of_guests])
    m = np.flatnonzero(n)
    none = lambda k: [None] * k
    return pa.table({
        "digest": pa.array(dx[m].tolist() + none(len(moved)), pa.binary()),
        "n": pa.array(n[m].tolist() + none(len(moved)), pa.int64()),
        "a": pa.array(none(len(m)) + ids[moved].tolist(), pa.int64()),
        "b": pa.array(none(len(m)) + ids[label[moved]].tolist(), pa.int64()),
    })


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give places that are linked, directly or not, their smallest place."""
    while len(a):
        old = label.copy()
        low = np.minimum(label[a], label[b])
        for ends in (a, b):
            np.minimum.at(label, label[ends], low)
            np.minimum.at(label, ends, low)
        label[:] = label[label]
        if (label == old).all():
            break


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id (named as ``key``), n_links, component_id and kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    nor do vectors of different lengths. Equal vectors link with each other. Rows with a null key
    are not compared and are kept, with a null component. Equal keys are one node of the graph.
    An empty table gives an empty result. Other columns are not read.
    """
    spark, tables = df.sparkSession, Tables(df.sparkSession)
    saved = tables.save
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    table = saved(rows.mapInArrow(unit, "id long, digest binary, vec binary"), "vectors")
    own = table.where("digest is not null and id is not null")
    classes = saved(own.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "vector-classes")
    own = own.join(classes, ["digest", "id"]).dropDuplicates(["digest"]).select("id", "digest", "vec", "weight")
    own = saved(own, "vector-representatives")
    n = own.count()
    found = spark.createDataFrame([], "digest binary, n long, a long, b long")
    if n:
        # the length that most vectors have; others have a cell by length
        dim = own.groupBy(F.octet_length("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()["dim"]
        want = min(-(-n // CELL) * PER_CENTRE * 64, max(PER_CENTRE, SAMPLE_BYTES // dim))
        sample = own.where(F.octet_length("vec") == dim).orderBy("digest").limit(want).select("vec").toArrow()["vec"].combine_chunks()
        c = centres(matrix(sample), max(1, min(-(-n // CELL), len(sample) // PER_CENTRE)))
        cells = saved(own.mapInArrow(assign(c, dim // 8), "cell int, home boolean, id long, digest binary, vec binary, weight long"), "vector-cells")
        # one row per cell: a centre of the sample, or another length of vectors
        sizes = cells.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK).alias("rows"), F.ceil(F.count("*") / BLOCK).alias("cols"))
        dealt = cells.join(bounded(sizes), "cell").where("rows > 0")
        block = F.xxhash64("digest", F.lit(9))
        side = lambda d, left: d.select("cell", *([F.pmod(block, "rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j")] if left else [F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod(block, "cols").alias("j")]), F.lit(left).alias("left"), "home", "id", "digest", "vec", "weight")
        both = side(dealt.where("home"), True).unionAll(side(dealt, False))
        found = saved(both.groupBy("cell", "i", "j").applyInArrow(compare, "digest binary, n long, a long, b long"), "vector-links")
    counts = found.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("n"))
    label = components(found.where("a is not null").select("a", "b"))
    tables.drop("vector-representatives", "vector-cells")
    per = classes.join(counts, "digest", "left").join(label, "id", "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = table.join(per, "digest", "left").select("id", F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector's links and component. Nulls, ties and repeats as in ``near_duplicates``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
