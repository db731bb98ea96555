"""Helpers shared by the corpus operators: text batches, saved tables, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed to Python code in slices of about this many bytes, so a worker's memory
#: depends on this and on its longest text, not on how rows fall into Arrow batches.
SLICE_BYTES = 4 << 20

#: Largest number of 8-byte keys that is broadcast (about 64 MB as a hash relation); beyond it, joins shuffle.
BROADCAST_KEYS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where none is named on one machine, as in tests, a folder below the warehouse is used; a cluster without it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later steps start from
    files that survive lost executors, and nothing before is computed twice."""
    return Tables(df.sparkSession).save(df, name)


class Tables:
    """Tables written to the shared folder during a job, which are deleted as soon as no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables saved under these names. What reads them must have run before."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            for path in self.paths.pop(name, []):
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


def bounded(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Mark ``keys`` (one long column) for broadcast if it has at most ``most`` rows; otherwise leave it to a shuffle join."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column is called so."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about SLICE_BYTES of text (one longer text stands alone)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pa.compute.binary_length(column).to_pylist() if len(column) else []
    begin = total = 0
    for i, n in enumerate(sizes):
        n = n or 0
        if i > begin and total + n > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield batch.slice(begin)


def map_texts(
    df: DataFrame,
    text: str,
    fields: str,
    make: Callable[..., Callable[[list[str]], dict[str, list]]],
    *args,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole texts in Arrow batches.

    ``make(*args)`` is called once per task and returns a function from a list of texts (null
    comes as the empty string) to a dict of lists, one per field of the DDL string ``fields``.
    ``keep`` names the input columns that stay (all by default). An input column with the name
    of an added one is replaced by it, unless it is the text itself.
    """
    import pyarrow.compute  # noqa: F401  (pa.compute)

    added = T.StructType.fromDDL(fields)
    names = [f.name for f in added]
    stay = [c for c in (df.columns if keep is None else keep) if c not in names]
    body = text if text in stay else free("__text", [*stay, *names])
    source = df.select(*[F.col(f"`{c}`") for c in stay], *([F.col(f"`{text}`").alias(body)] if body != text else []))
    schema = T.StructType([f for f in source.schema if f.name in stay] + list(added))
    kinds = [arrow_type(f.dataType) for f in added]
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        work = make(*args)
        for whole in batches:
            for batch in slices(whole, body):
                got = work([x or "" for x in batch.column(batch.schema.get_field_index(body)).to_pylist()])
                columns = [batch.column(batch.schema.get_field_index(c)) for c in stay]
                columns += [pa.array(got[n], kind) for n, kind in zip(names, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*stay, *names])
        del work
        give_back()

    return source.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hold Arrow batches of texts to ``rows`` rows for this session, as their bytes are held by both processes at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, rows)


def give_back() -> None:
    """Return freed memory to the system at a task's end: a worker lives on for tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph of long ids.

    ``edges`` has columns a, b. Returns id, component (the smallest id reachable) for every id
    on an edge; loops count as no edge, repeated edges as one, and no edges give an empty result.
    Alternating large-star and small-star contraction: each round is two aggregations by key with
    partial minima and two joins, the number of rounds grows with the logarithm of the longest
    path, and every round is cut by a table in the shared folder, the one before then deleted.
    """
    tables = Tables(edges.sparkSession)
    e = tables.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star0")
    before = None
    for turn in range(most_rounds):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours of each node point to its smallest neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = tables.save(large, f"large{turn}")
        # small star: each node and its smaller neighbours point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = tables.save(small, f"star{turn + 1}")
        tables.drop(f"star{turn}", f"large{turn}")
    else:
        raise RuntimeError("components did not settle")
    ends = e.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    out = tables.save(ends.unionAll(ends.select(F.col("component").alias("id"), "component").distinct()), "components")
    tables.drop(*[n for n in tables.paths if n != "components"])
    return out
