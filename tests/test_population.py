"""Related tables, labels, broken files and Unicode transforms."""

from pyspark.sql import functions as F

from assaykit.operators import generate, population


def test_related_tables(spark):
    tables = population.population(spark, 300)
    assert set(tables) == set(population.TABLES)
    assert tables["contracts"].count() > 200
    for child, parent, key in (("customers", "households", "household_id"), ("contracts", "customers", "customer_id"), ("contracts", "brokers", "broker_id"), ("claims", "contracts", "contract_id"), ("payments", "claims", "claim_id")):
        assert tables[child].where(F.col(key).isNotNull()).join(tables[parent], key, "left_anti").count() == 0
    for name, key in (("households", "household_id"), ("customers", "customer_id"), ("contracts", "contract_id"), ("claims", "claim_id"), ("payments", "payment_id")):
        assert tables[name].count() == tables[name].select(key).distinct().count()
    both = tables["claims"].join(tables["contracts"], "contract_id")
    assert both.where("claim_date < start_date or claim_date > coalesce(end_date, date'2026-01-01')").count() == 0
    sums = tables["payments"].groupBy("claim_id").agg(F.sum("amount").alias("s")).join(tables["claims"], "claim_id")
    assert sums.where("abs(s - paid) > 0.005").count() == 0
    assert tables["payments"].join(tables["claims"].select("claim_id", "claim_date"), "claim_id").where("payment_date < claim_date").count() == 0
    again = population.population(spark, 300)["payments"].repartition(3)
    assert sorted(again.collect()) == sorted(tables["payments"].collect())
    assert all(d.count() == 0 for n, d in population.population(spark, 0).items() if n != "brokers")


def test_labels(spark):
    df = spark.range(3000).withColumn("f", F.when(F.col("id") % 3 == 0, F.col("id") % 2 == 0))
    rows = population.labels(df, "id", F.col("f")).collect()
    assert all((r.observed_fraud is None) == r.is_delayed and (r.is_delayed or r.observed_fraud == (r.is_fraud != r.is_noisy)) for r in rows)
    assert sum(r.is_fraud for r in rows) == 500 and 0.01 < sum(r.is_noisy for r in rows) / 3000 < 0.03
    assert population.latent(population.labels(df, "id", F.col("f")), "id").where("latent_fraud_probability not between 0 and 1 or latent_renewal_probability not between 0 and 1").count() == 0


def test_broken_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"né{i}", None) for i in range(9)], "k long, n string, x string")
    read = {p.rsplit("/", 1)[1][:-4]: open(p, "rb").read() for p in population.write_malformed(df, "k", str(tmp_path))}
    lines = lambda name: read[name].decode().split("\n")
    assert lines("wide_rows")[4] == "3,né3,,more,more" and lines("wide_rows")[1] == "0,né0,"
    assert lines("narrow_rows")[5] == "4,né4" and lines("open_quotes")[6] == '"5,né5,'
    assert read["cut_file"].decode().endswith("\n8,n") and b"5,n\xc3\xa95,\n\xc3\x286,n" in read["stray_bytes"]
    own = population.malformed(df, "k", {"all": {"kind": "narrow", "cells": 9}}).first()
    assert bytes(own.content).decode() == "k,n,x\n" + "".join(f"{i}\n" for i in range(9))
    assert population.malformed(df.limit(0), "k").count() == 0


def test_unicode_transforms(spark):
    df = spark.createDataFrame([("é",), ("é",), ("a",), (None,)], "v string")
    t = lambda n: [r[0] for r in df.select(generate.TRANSFORMS[n](F.col("v"), F.lit(0.5))).collect()]
    assert t("unicode_nfd") == ["é", "é", "a", None] and t("unicode_nfc") == ["é", "é", "a", None] and t("strip_accents") == ["e", "e", "a", None]
