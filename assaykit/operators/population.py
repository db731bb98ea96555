"""Related tables of insured households, labels for learning on them, and broken CSV files.

A child's key is its parent's key and its number there, and every cell a hash of its key, so each
table is one narrow pass over a range of households: no joins, no shuffle, and any part of a table
can be made again alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators.generate import draw, pick
from assaykit.sources import readers

PROVINCES, PROVINCE_WEIGHTS = ["QC", "ON", "BC", "AB", "NB"], [50.0, 25.0, 12.0, 9.0, 4.0]
PRODUCTS = {"auto": (600.0, 2400.0, 0.16), "home": (400.0, 1800.0, 0.10), "life": (200.0, 3000.0, 0.03), "travel": (40.0, 300.0, 0.06)}
BROKERS = 200
CLAIM_STATES, CLAIM_WEIGHTS = ["closed", "open", "refused"], [70.0, 20.0, 10.0]
TABLES = ("households", "customers", "brokers", "contracts", "claims", "payments")


def children(parents: DataFrame, number: Column, key: str, parent: str) -> DataFrame:
    """A row for each child of a parent, with ``key``; a parent without children has none."""
    rows = parents.withColumn("_n", number.cast("int")).where("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.withColumn(key, F.concat_ws("-", F.col(parent), F.col("_i").cast("string"))).drop("_n", "_i")


def population(spark: SparkSession, households: int, as_of: str = "2026-01-01", seed: str = "42") -> dict[str, DataFrame]:
    """The six tables by name.

    Every customer is in a household of one to five, every contract has a customer and (unless sold
    directly) a broker, a claim falls within its contract, and its payments, none before it, add up
    to what it paid. Dates stop at ``as_of``.
    """
    u = lambda table, column, key: draw(seed, table, column, F.col(key))
    day = F.to_date(F.lit(as_of))
    homes = spark.range(households).select(F.concat(F.lit("H"), F.col("id").cast("string")).alias("household_id"))
    homes = homes.withColumn("province", pick(u("households", "province", "household_id"), PROVINCES, PROVINCE_WEIGHTS))
    people = children(homes, pick(u("households", "size", "household_id"), [1, 2, 3, 4, 5], [30.0, 38.0, 16.0, 12.0, 4.0]), "customer_id", "household_id")
    people = people.withColumn("birth_date", F.date_sub(day, (18 * 366 + F.floor(u("customers", "age", "customer_id") * 70 * 365)).cast("int")))
    people = people.withColumn("language", F.when(u("customers", "language", "customer_id") < F.when(F.col("province") == "QC", 0.85).otherwise(0.1), "fr").otherwise("en"))
    people = people.withColumn("email", F.when(u("customers", "email", "customer_id") < 0.9, F.concat(F.lower("customer_id"), F.lit("@example.org"))))
    deals = children(people.select("customer_id", "birth_date"), pick(u("customers", "contracts", "customer_id"), [0, 1, 2, 3], [15.0, 50.0, 25.0, 10.0]), "contract_id", "customer_id")
    deals = deals.withColumn("product", pick(u("contracts", "product", "contract_id"), list(PRODUCTS), [45.0, 30.0, 15.0, 10.0]))
    by_product = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in PRODUCTS.items() for x in (k, v[i])]), F.col("product"))
    adult = F.add_months("birth_date", 18 * 12)
    oldest = F.least(F.datediff(day, adult), F.lit(3650))
    deals = deals.withColumn("start_date", F.date_sub(day, F.floor(u("contracts", "start", "contract_id") * (oldest + 1)).cast("int")))
    deals = deals.withColumn("end_date", F.when(u("contracts", "ended", "contract_id") < 0.25, F.least(day, F.date_add("start_date", F.floor(u("contracts", "length", "contract_id") * 1500).cast("int")))))
    deals = deals.withColumn("annual_premium", F.round(by_product(0) + u("contracts", "premium", "contract_id") * (by_product(1) - by_product(0)), 2))
    zipf = pick(u("contracts", "broker", "contract_id"), [f"B{i}" for i in range(BROKERS)], [1 / (i + 1) for i in range(BROKERS)])
    deals = deals.withColumn("broker_id", F.when(u("contracts", "channel", "contract_id") < 0.6, zipf)).drop("birth_date")
    brokers = spark.range(BROKERS).select(F.concat(F.lit("B"), F.col("id").cast("string")).alias("broker_id")).withColumn("province", pick(u("brokers", "province", "broker_id"), PROVINCES, PROVINCE_WEIGHTS))
    happens = u("contracts", "claims", "contract_id") < by_product(2)
    number = F.when(happens, pick(u("contracts", "n_claims", "contract_id"), [1, 2, 3], [80.0, 15.0, 5.0])).otherwise(0)
    claims = children(deals.withColumn("until", F.coalesce("end_date", day)), number, "claim_id", "contract_id")
    claims = claims.select("claim_id", "contract_id", F.date_add("start_date", F.floor(u("claims", "date", "claim_id") * (F.datediff("until", "start_date") + 1)).cast("int")).alias("claim_date"), pick(u("claims", "status", "claim_id"), CLAIM_STATES, CLAIM_WEIGHTS).alias("status"), F.round(F.col("annual_premium") * (0.3 + 6 * F.pow(u("claims", "amount", "claim_id"), 3)), 2).alias("amount"))
    claims = claims.withColumn("paid", F.when(F.col("status") == "closed", F.col("amount")).when(F.col("status") == "open", F.round(F.col("amount") / 2, 2)).otherwise(0.0))
    parts = children(claims.where("paid > 0").withColumn("_parts", pick(u("claims", "parts", "claim_id"), [1, 2, 3], [70.0, 20.0, 10.0])), F.col("_parts"), "payment_id", "claim_id")
    nth = F.element_at(F.split("payment_id", "-"), -1).cast("int")
    share = F.floor(F.col("paid") * 100 / F.col("_parts")) / 100
    paid = F.when(nth < F.col("_parts"), share).otherwise(F.round(F.col("paid") - share * (F.col("_parts") - 1), 2))
    parts = parts.select("payment_id", "claim_id", "contract_id", F.least(day, F.date_add("claim_date", (nth * 30).cast("int"))).alias("payment_date"), paid.alias("amount"))
    return dict(zip(TABLES, (homes, people, brokers, deals, claims, parts)))


def flattened(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each contract with its customer's columns and the number and sum of its claims."""
    claims = tables["claims"].groupBy("contract_id").agg(F.count("*").alias("n_claims"), F.round(F.sum("amount"), 2).alias("claimed"))
    out = tables["contracts"].join(tables["customers"], "customer_id").join(claims, "contract_id", "left")
    return out.fillna({"n_claims": 0, "claimed": 0.0})


def labels(df: DataFrame, key: str, fraud: Column, noise: float = 0.02, delayed: float = 0.1, seed: str = "42") -> DataFrame:
    """key, is_fraud, observed_fraud, is_noisy, is_delayed: what is true, and what a user of the data is told.

    A noisy label is turned round; a delayed one is not told yet (null). A null ``fraud`` counts as none.
    """
    u = lambda c: draw(seed, "labels", c, F.col(key))
    out = df.select(F.col(key), F.coalesce(fraud, F.lit(False)).alias("is_fraud"), (u("noise") < noise).alias("is_noisy"), (u("delay") < delayed).alias("is_delayed"))
    return out.select(key, "is_fraud", F.when(~F.col("is_delayed"), F.col("is_fraud") != F.col("is_noisy")).alias("observed_fraud"), "is_noisy", "is_delayed")


def latent(labelled: DataFrame, key: str, seed: str = "42") -> DataFrame:
    """key and what the generator knew but the data must not hold: probabilities of fraud, claim and renewal, a risk score.

    Kept as a table of its own, so that nothing of it leaks into the columns learnt from. The two
    classes overlap in their probability of fraud, so none is told apart by it without error.
    """
    u = lambda c: draw(seed, "latent", c, F.col(key))
    chance = F.round(F.when(F.col("is_fraud"), 0.35 + 0.6 * u("fraud")).otherwise(0.6 * F.pow(u("fraud"), 2)), 4)
    out = labelled.select(key, chance.alias("latent_fraud_probability"))
    out = out.withColumn("latent_claim_probability", F.round(0.02 + 0.3 * F.col("latent_fraud_probability") + 0.2 * u("claim"), 4))
    out = out.withColumn("latent_renewal_probability", F.round(1 - 0.5 * F.col("latent_claim_probability") - 0.3 * u("renewal"), 4))
    return out.withColumn("latent_risk_score", F.round(100 + 800 * (1 - F.col("latent_fraud_probability")), 1))


#: Faults by name: kind, and which records (record number of the file modulo ``every`` equal to ``at``) it hits, and how much.
FAULTS = {
    "wide_rows": {"kind": "wide", "every": 7, "at": 3, "cells": 2},
    "narrow_rows": {"kind": "narrow", "every": 9, "at": 4, "cells": 1},
    "open_quotes": {"kind": "quote", "every": 11, "at": 5},
    "stray_bytes": {"kind": "bytes", "at": 6, "payload": "c328"},
    "cut_file": {"kind": "cut", "characters": 4},
}


def malformed(df: DataFrame, record: str, faults: dict[str, dict] = FAULTS, rows: int = 50) -> DataFrame:
    """scenario, content: the CSV text of the first ``rows`` records with one fault each, for tests of readers.

    wide adds cells to a record and narrow drops its last ones (at least one stays); quote opens a quote before its first
    cell and never closes it; bytes puts bytes that are no UTF-8 (``payload``, in hex) before the record ``at``; cut
    leaves out the last characters of the file. Missing cells are empty. An empty table gives no rows.
    """
    first = df.orderBy(record).limit(rows)  # what the feature is: a small file
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    lines = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(record).alias("k"), cells.alias("c")))), lambda x: x["c"]).alias("r")).where(F.size("r") > 0)
    head = ",".join(df.columns) + "\n"

    def line(c: Column, i: Column, f: dict) -> Column:
        hit = i % f.get("every", 1) == f.get("at", 0)
        if f["kind"] == "wide":
            c = F.when(hit, F.concat(c, F.array_repeat(F.lit("more"), f["cells"]))).otherwise(c)
        if f["kind"] == "narrow":
            c = F.when(hit, F.slice(c, F.lit(1), F.greatest(F.size(c) - f["cells"], F.lit(1)))).otherwise(c)
        text = F.concat(F.array_join(c, ","), F.lit("\n"))
        return F.when(hit, F.concat(F.lit('"'), text)).otherwise(text) if f["kind"] == "quote" else text

    def content(f: dict) -> Column:
        text = F.transform("r", lambda c, i: line(c, i, f))
        if f["kind"] == "bytes":
            part = lambda a, n: F.array_join(F.slice(text, F.lit(a), n), "").cast("binary")
            return F.concat(F.lit(head).cast("binary"), part(1, F.lit(f["at"])), F.unhex(F.lit(f["payload"])), part(f["at"] + 1, F.size("r")))
        whole = F.concat(F.lit(head), F.array_join(text, ""))
        return (F.substring(whole, F.lit(1), F.length(whole) - f["characters"]) if f["kind"] == "cut" else whole).cast("binary")

    return lines.select(F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), content(f).alias("content")) for k, f in faults.items()])).alias("x")).select("x.*")


def write_malformed(df: DataFrame, record: str, folder: str, faults: dict[str, dict] = FAULTS, rows: int = 50) -> list[str]:
    """Write each text of ``malformed`` as one file of the folder; their paths."""
    paths = []
    for r in malformed(df, record, faults, rows).collect():
        paths.append(f"{folder.rstrip('/')}/{r.scenario}.csv")
        readers.write_bytes(df.sparkSession, paths[-1], bytes(r.content))
    return paths
