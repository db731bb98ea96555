"""Sources as DataFrames of text cells, and the choice of what in a file holds the records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def labels(header: list[str]) -> list[str]:
    """Column names of a header: blank or repeated names get their position."""
    return [n if n and header.count(n) == 1 else f"{n}#{i + 1}" for i, n in enumerate(header)]


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", tolerant: bool = False) -> DataFrame:
    """Every cell as text, empty cells as the empty string. Strict: a record of another width fails the
    read; tolerant: it is kept in CORRUPT, with its cells null but for the first."""
    options = {"sep": sep, "encoding": encoding, "multiLine": True, "quote": '"', "escape": '"'}
    first = spark.read.options(**options, header=False, inferSchema=False).csv(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header")
    names = labels([(x or "").lstrip("﻿") for x in first[0]])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + ([T.StructField(CORRUPT, T.StringType())] if tolerant else []))
    mode = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} if tolerant else {"mode": "FAILFAST"}
    df = spark.read.options(**options, **mode, header=True, enforceSchema=True).schema(schema).csv(path)
    cells = [F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]
    if tolerant:
        cells = cells[:1] + [F.when(F.col(CORRUPT).isNull(), c) for c in cells[1:]]
    return df.select(*[c.alias(n) for c, n in zip(cells, names)], *([CORRUPT] if tolerant else []))


def excluded(df: DataFrame, sep: str = ",", most_bytes: int = 1 << 20) -> DataFrame:
    """Records left out of a tolerant read: reason, cells (found in the record) and records.

    A record is too large beyond ``most_bytes``; else it has more or fewer cells than the header. Cells are counted
    outside quotes.
    """
    bare = F.regexp_replace(F.col(CORRUPT), '"([^"]|"")*"?', "q")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    names = [c for c in df.columns if c != CORRUPT]
    reason = F.when(F.octet_length(CORRUPT) > most_bytes, "record_too_large").when(cells > len(names), "too_many_cells").when(cells < len(names), "too_few_cells").otherwise("malformed")
    left = df.where(F.col(CORRUPT).isNotNull()).groupBy(reason.alias("reason"), cells.cast("long").alias("cells")).agg(F.count("*").alias("records"), F.max(F.col(f"`{names[0]}`")).alias("_first"))
    # Spark refuses plans that read the corrupt record alone: the condition, which always holds, has the first cell read along
    return left.where((F.col("records") > 0) | F.col("_first").isNull()).select("reason", "cells", "records")


def line_ends(spark: SparkSession, path: str) -> DataFrame:
    """path, bom, crlf, lf, cr, sha256 of each file: how its lines end, and what its bytes are."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "ISO-8859-1")
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    return files.select("path", bom.alias("bom"), count("\r\n").alias("crlf"), count("(?<!\r)\n").alias("lf"), count("\r(?!\n)").alias("cr"), F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """A JSON document, or the elements of one of its arrays (keys joined by dots) with their index."""
    df = spark.read.option("multiLine", True).json(path)
    if not collection:
        return df
    return df.select(F.posexplode_outer(F.col(collection)).alias("index", "record")).select("index", "record.*")


def read_jsonl(spark: SparkSession, path: str, most_characters: int = 1 << 20) -> DataFrame:
    """line (text) and its state: object, other (valid, no object), duplicate_key, surrogate, too_long, invalid or blank."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    parsed = F.try_parse_json("line")
    flat = F.regexp_replace("line", r'\\\\(["\\\\])', "__")
    # half of a pair of surrogates written as an escape
    half = F.col("line").rlike(r"(?i)\\u(d[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2}\\u)d[c-f][0-9a-f]{2})")
    body = F.regexp_replace(F.regexp_replace(flat, r"[{\[][^{}\[\]]*[}\]](?=.*})", "0"), r"^\s*\{|\}\s*$", "")
    keys = F.regexp_extract_all(body, F.lit(r'(?:^|,)\s*"([^"]*)"\s*:'), F.lit(1))
    repeated = F.size(keys) > F.size(F.array_distinct(keys))
    state = F.when(F.length("line") > most_characters, "too_long").when(F.trim("line") == "", "blank").when(half, "surrogate").when(F.col("line").startswith("{") & repeated, "duplicate_key").when(parsed.isNull(), "invalid").when(F.schema_of_variant(parsed).startswith("OBJECT"), "object").otherwise("other")
    return lines.withColumn("state", state)


def jsonl_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return read_jsonl(spark, path).where("state = 'object'").select(F.from_json("line", schema).alias("r")).select("r.*")


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet of each workbook of the path as text cells below its detected header row.

    Workbooks are parsed by executors, one task each. All must have the header of the first by path, else the read fails.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parsed(batches):
        from assaykit.sources.excel import header_of, sheet_rows

        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = sheet_rows(content, sheet)
                at = header_of(rows)
                names = labels([str(x or "") for x in rows[at]]) if rows else []
                body = [["" if i >= len(r) or r[i] is None else str(r[i]) for i in range(len(names))] for r in rows[at + 1 :]]
                out = [names, *body]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array(range(-1, len(body)), pa.int64()), pa.array(out, pa.list_(pa.string()))], names=["path", "row", "cells"])

    cells = files.mapInArrow(parsed, "path string, row long, cells array<string>")
    header = cells.where("row < 0").orderBy("path").limit(1).collect()  # the names of one file
    if not header:
        raise ValueError(f"{path} has no workbook")
    names = header[0]["cells"]
    checked = F.when(F.size("cells") == len(names), F.col("cells")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(" has another header"))))
    return cells.where("row >= 0").select(checked.alias("cells")).select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": read_csv, "tsv": lambda s, p, **k: read_csv(s, p, sep="\t", **k), "json": read_json, "jsonl": read_jsonl, "ndjson": read_jsonl, "xlsx": read_excel,
    "parquet": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p),
}


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by file extension."""
    kind = re.sub(r"(\.gz)?/*$", "", path).rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind}")
    return READERS[kind](spark, path, **options)


def arrays_of(schema: T.DataType, at: tuple[str, ...] = (), depth: int = 3) -> list[tuple[str, ...]]:
    """Paths of arrays of objects reached through object keys."""
    if isinstance(schema, T.ArrayType):
        return [at] if isinstance(schema.elementType, T.StructType) else []
    if isinstance(schema, T.StructType) and len(at) < depth:
        return [p for f in schema for p in arrays_of(f.dataType, (*at, f.name), depth)]
    return []


def inspect_json(spark: SparkSession, path: str, dominance: int = 10) -> dict:
    """Which array holds the records: the root, the only one, or one that has ten times the next; else ambiguous."""
    df = spark.read.option("multiLine", True).json(path)
    paths = arrays_of(df.schema)
    if not paths:
        return {"selected": "$[]" if df.count() > 1 else "$", "reason": "root", "candidates": {}}
    sizes = df.agg(*[F.coalesce(F.sum(F.size(F.col(".".join(p)))), F.lit(0)).alias(f"n{i}") for i, p in enumerate(paths)]).first()
    found = {".".join(p): sizes[i] for i, p in enumerate(paths)}
    order = sorted(found, key=lambda p: (-found[p], p))
    if len(order) == 1:
        return {"selected": order[0], "reason": "only_eligible", "candidates": found}
    if found[order[0]] >= dominance * max(found[order[1]], 1):
        return {"selected": order[0], "reason": "dominant", "candidates": found}
    return {"selected": None, "reason": "ambiguous", "candidates": found}


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified and SHA-256 of each file of a source, to tell a changed one."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def stale(spark: SparkSession, path: str, before: DataFrame) -> DataFrame:
    """path, change (added, removed or changed) against an earlier ``fingerprint`` of the source: by size, time and digest."""
    now = fingerprint(spark, path).withColumnsRenamed({"size": "_size", "modified": "_modified", "sha256": "_sha256"})
    both = before.join(now, "path", "full")
    change = F.when(F.col("sha256").isNull(), "added").when(F.col("_sha256").isNull(), "removed").when((F.col("sha256") != F.col("_sha256")) | (F.col("size") != F.col("_size")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def resolve(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Files of these paths and globs, each once, in order of pattern and name. A pattern without a file raises."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out: list[str] = []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = sorted(f.getPath().toString() for f in path.getFileSystem(conf).globStatus(path) or [] if not f.isDirectory())
        if not found:
            raise ValueError(f"{pattern} matches no file")
        out += [f for f in found if f not in out]
    return out


def plan_outputs(sources: list[str], folder: str, suffix: str) -> dict[str, str]:
    """The output of each source: its name without extension and the suffix, in the folder. Two sources with one output, or
    an output that is a source, raise before anything is written."""
    out: dict[str, str] = {}
    for s in sources:
        target = f"{folder.rstrip('/')}/{s.rsplit('/', 1)[-1].rsplit('.', 1)[0]}{suffix}"
        clash = next((k for k, t in out.items() if t.lower() == target.lower()), None)
        if clash:
            raise ValueError(f"{clash} and {s} would both be written to {target}")
        if target in sources:
            raise ValueError(f"{target} would overwrite a source")
        out[s] = target
    return out


def json_schema(kind: T.DataType, title: str | None = None) -> dict:
    """A JSON Schema of a table's rows."""
    if isinstance(kind, T.StructType):
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable], "additionalProperties": False}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out = {"type": "string", "format": "date" if isinstance(kind, T.DateType) else "date-time"}
    else:
        integer = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        number = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
        out = {"type": "integer" if integer else "number" if number else "boolean" if isinstance(kind, T.BooleanType) else "string"}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title} | out if title else out


# Sinks.


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file of exactly these bytes, in any store that Spark reaches."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", bom: bool = False) -> DataFrame:
    """Write one CSV part per partition; returns path and SHA-256 of each. With ``bom`` the first column's name starts with a byte order mark."""
    first = df.columns[0]
    out = df.withColumnRenamed(first, "\ufeff" + first) if bom else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"').csv(path)
    return fingerprint(df.sparkSession, f"{path.rstrip('/')}/part-*").select("path", "sha256")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A driver-made document, put in place by a rename so that no reader sees half of it."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be put in place")


def html_report(profile: DataFrame, title: str) -> str:
    """A page with one table row per field; the profile has as many rows as there are columns."""
    import html

    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in r) + "</tr>"
    body = "".join(cells("td", r) for r in profile.collect())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{cells('th', profile.columns)}{body}</table>"
