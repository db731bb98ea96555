"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (assignments, access identifiers, long hex strings) are reported as such. Weak
parts - identifiers, opaque keys and endpoints - are common in clean text, so one is reported
only if complementary parts lie within SCOPE characters: parts are put in scopes of that length,
each scope is summed up by first and last start of each kind, and every weak part is joined to
the sums of its own and the two neighbouring scopes. That is exact and linear however many parts
a scope holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import saved

# The base patterns and the shortest lengths that count.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

# Weak parts, of any length from the least one on.
IDENT = r"""(?i)\b(?:user(?:_?name)?|login|client_?id|account|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"""(?i:\b(?:https?|ftps?|jdbc:[a-z]+|mongodb|postgres(?:ql)?|mysql|redis|amqps?)://[^\s"'<>]{3,})"""
#: A run of 20 signs or more with digits and letters of both cases, outside endpoints.
KEY = ENDPOINT + r"|(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2})"
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
SCOPE = 300


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used, in nested lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefix_sums(sizes: Column) -> Column:
    """Sum of the values before each position; in blocks of a square root of the number, so long arrays stay cheap."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def of(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), width - 1), lambda b: add(F.slice(a, b * width + 1, width)))
        bases = let(sums, lambda x: F.transform(x, lambda _, b: add(F.slice(x, F.lit(1), b))))
        block = lambda i: F.floor(i / width).cast("int")
        return let(bases, lambda x: F.transform(a, lambda _, i: F.element_at(x, block(i) + 1) + add(F.slice(a, block(i) * width + 1, i % width))))

    return let(sizes, of)


def located(df: DataFrame, text: str, name: str, pattern: str, where: Column, group: int = 0, least: int = 0) -> DataFrame:
    """Add ``name``: array of (start, end) of the matches of ``pattern`` in code points.

    Splitting by the pattern gives what lies between the matches, so running sums of lengths give
    the places. With ``group`` and ``least``, matches whose group is shorter are left out after matching.
    """
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    df = df.withColumn("_m", F.when(where, lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, lengths(F.split(text, pattern, -1))))
    if least:
        df = df.withColumn("_v", F.when(F.size("_m") > 0, lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, prefix_sums(F.zip_with("_m", F.slice("_g", F.lit(1), F.size("_m")), lambda m, g: m + g))))
    starts = F.zip_with("_p", F.slice("_g", F.lit(1), F.size("_m")), lambda p, g: p + g)
    spans = F.zip_with(starts, "_m", lambda s, m: F.struct(s.alias("s"), (s + m).alias("e")))
    if least:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("x"), F.col("_v").alias("v")), lambda z: z["v"] >= least), lambda z: z["x"])
    return df.withColumn(name, F.coalesce(F.when(F.size("_m") > 0, spans), none)).drop("_m", "_g", "_v", "_p")


def tagged(spans: dict[str, str]) -> Column:
    """One array of (start, kind number, end) from several arrays of spans."""
    one = lambda kind, c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))
    return F.concat(*[one(k, F.col(c)) for k, c in spans.items()])


def rendered(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256, spans (text), n_weak and findings (array of kind, start, end).

    Null is taken as empty: no findings. Repeated rows are scanned each. An empty table stays
    empty. Input columns with the names of added ones are replaced. Places count code points,
    ends are exclusive; equal starts are ordered by kind as in KINDS.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak", "findings"]
    stay = [c for c in (df.columns if keep is None else keep) if c not in added]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in stay]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    t = F.col("_t")
    rows = located(rows, "_t", "_assign", ASSIGN, t.rlike(ASSIGN), 2, ASSIGN_LEAST)
    rows = located(rows, "_t", "_access", ACCESS, t.contains("AKIA"))
    rows = located(rows, "_t", "_hex", HEX, t.rlike(HEX))
    rows = located(rows, "_t", "_ident", IDENT, t.rlike(r"(?i)user|login|client|account|access") & t.rlike(IDENT))
    rows = located(rows, "_t", "_endpoint", ENDPOINT, t.contains("://"))
    partner = F.size("_ident") + F.size("_endpoint") + F.size("_access") > 0
    rows = located(rows, "_t", "_key", KEY, partner, 1, 1)
    table = saved(
        rows.select(
            "_row",
            F.monotonically_increasing_id().alias("_id"),
            tagged({"assign": "_assign", "access": "_access", "hex": "_hex"}).alias("_base"),
            F.when(partner & (F.size("_assign") + F.size("_hex") + F.size("_key") > 0), tagged({"ident": "_ident", "key": "_key", "endpoint": "_endpoint"})).alias("_weak"),
        ),
        "secrets",
    )
    weak = linked(table.where(F.size("_weak") > 0))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["k"] == KINDS.index(kind))).cast("long")
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_sort(F.concat("_base", F.coalesce("_linked", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>"))))
    return table.join(weak, "_id", "left").select(
        *[F.col("_row")[c].alias(c) for c in stay],
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(rendered(F.col("_base")), 256).alias("base_sha256"),
        rendered(spans).alias("spans"),
        F.coalesce(F.size("_linked").cast("long"), F.lit(0).cast("long")).alias("n_weak"),
        F.transform(spans, lambda x: F.struct(F.element_at(names, x["k"] + 1).alias("kind"), x["s"].alias("start"), x["e"].alias("end"))).alias("findings"),
    )


def linked(table: DataFrame) -> DataFrame:
    """_id and the weak parts that have complementary parts in reach."""
    part = table.select("_id", F.explode(F.concat("_base", "_weak")).alias("x")).select("_id", "x", F.floor(F.col("x.s") / SCOPE).alias("scope"))
    # the value of an assignment or an identifier is no key of its own
    value = part.where(F.col("x.k").isin(0, 3)).select("_id", F.col("x.e").alias("_e"), F.lit(4).alias("_k")).distinct()
    part = part.withColumns({"_e": F.col("x.e"), "_k": F.col("x.k")}).join(value, ["_id", "_e", "_k"], "left_anti").drop("_e", "_k")
    role = F.when(F.col("x.k").isin(0, 2, 4), "secret").when(F.col("x.k").isin(1, 3), "ident").otherwise("endpoint")
    sums = part.groupBy("_id", "scope").agg(*[f(F.when(role == r, F.col("x.s"))).alias(f"{n}_{r}") for r in ("secret", "ident", "endpoint") for n, f in (("lo", F.min), ("hi", F.max))])
    reach = sums.select("_id", F.explode(F.array(*[F.col("scope") + d for d in (-1, 0, 1)])).alias("scope"), *[c for c in sums.columns if c[:2] in ("lo", "hi")])
    weak = part.where(F.col("x.k") >= 3)
    s = F.col("x.s")
    near = lambda r: F.max(F.coalesce(((s - F.col(f"hi_{r}")).between(0, SCOPE)) | ((F.col(f"lo_{r}") - s).between(0, SCOPE)) | ((F.col(f"lo_{r}") <= s) & (F.col(f"hi_{r}") >= s)), F.lit(False)))
    met = weak.join(reach, ["_id", "scope"]).groupBy("_id", "x").agg(*[near(r).alias(r) for r in ("secret", "ident", "endpoint")])
    ok = F.when(F.col("x.k") == 3, F.col("secret")).when(F.col("x.k") == 4, F.col("ident") | F.col("endpoint")).otherwise(F.col("secret") & F.col("ident"))
    return met.where(ok).groupBy("_id").agg(F.collect_list("x").alias("_linked"))


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts, digests and spans. Nulls, ties and repeats as in ``scan``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"]).drop("findings")
