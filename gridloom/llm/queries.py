"""Queries of problems 2, 5, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import cooccur, leak, packing, quantiles, sentences
from gridloom.plans._tables import last_samples
from gridloom.runtime import cut, latest, load, spread


#: Likelihood ratio of a level of 10 percent. A pair of 8 records at twice chance has at least 8 * 2 * (ln 2 - 1/2) = 3.09.
SIGNIFICANT = 2.71


def _pairs(spark: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    return cooccur.cooccurrence(last_samples(spark, d, ["zone", "candidates"]), "zone", "candidates", least=least)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Significant pairs that are frequent and well above chance; the definition's bounds imply the significance."""
    hit = _pairs(spark, d, SIGNIFICANT).filter("both >= 8 and 200 * both >= records and both * records >= 2 * n_a * n_b")
    return hit.select(F.col("grp").alias("zone"), F.col("item_a").cast("int").alias("biome_a"), F.col("item_b").cast("int").alias("biome_b"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return p.select(F.col("grp").alias("zone"), F.col("item_a").cast("int").alias("biome_a"), F.col("item_b").cast("int").alias("biome_b"), F.col("both").alias("samples"), F.round("lift", 6).alias("lift"), F.round("llr", 3).alias("llr"))


FRACTIONS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


METRICS = ["temperatureC", "precipitationMm"]


def _climate(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Last rows of the climate samples with zone and biome, and the groupings."""
    climate = latest(load(spark, d, "climate_samples").select("sample_id", "sampled_at", "world_seed", *METRICS), ["sample_id"], "sampled_at", ["world_seed", *METRICS]).drop("sampled_at")
    joined = climate.join(last_samples(spark, d, ["zone", "biome_index"]), "sample_id", "left")
    each = F.when(F.col("zone").isNotNull() & F.col("biome_index").isNotNull() & F.col("world_seed").isNotNull(), F.concat_ws("|", "zone", "biome_index", "world_seed"))
    return joined, {"zone": F.col("zone"), "biome": F.col("biome_index"), "world": F.col("world_seed"), "zone_biome_world": each}


def _percentiles(spark: SparkSession, d: str, joined: DataFrame, groups: dict) -> DataFrame:
    # the row count stands in the files' footers; by it, never by the cluster, goes the number of buckets
    n = quantiles.buckets_for(load(spark, d, "climate_samples").count())
    return quantiles.percentiles(quantiles.sketch(joined, groups, METRICS, row=["sample_id"], buckets=n, absent=-9999.0), FRACTIONS, n)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of both climate columns per zone, per biome, per world, and per zone, biome and world together."""
    return _percentiles(spark, d, *_climate(spark, d))


def p5_within(spark: SparkSession, d: str) -> DataFrame:
    """Whether every percentile of ``p5_percentiles`` is within its bound of the exact rank, measured on all values."""
    joined, groups = _climate(spark, d)
    joined = cut(joined)
    pairs = F.array(*[F.struct(F.lit(by).alias("by"), key.cast("string").alias("key"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for by, key in groups.items() for m in METRICS])
    values = joined.select(F.explode(pairs).alias("x")).select("x.*").filter("key is not null and value is not null and not isnan(value) and value <> -9999")
    return quantiles.within_bounds(values, _percentiles(spark, d, joined, groups), FRACTIONS)


def p5_noise(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per noise family over all its probes."""
    cols = ["family", "samples", "quantile_pcts", "quantile_vals", "min_val", "max_val"]
    t = latest(load(spark, d, "noise_families").select("probe_id", "probed_at", *cols), ["probe_id"], "probed_at", cols)
    return quantiles.percentiles(quantiles.table_states(t, lo="min_val", hi="max_val"), FRACTIONS)


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_documents(spark, d))


def p7_placed(spark: SparkSession, d: str) -> DataFrame:
    """Per document: how often it is placed, and whether all of it is, split only beyond the capacity, in no container beyond its own."""
    return packing.placed(packing.pack(_documents(spark, d)))


def p7_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(packing.pack(_documents(spark, d)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(_documents(spark, d), load(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked, into how many documents, and the longest passage."""
    return leak.leaks(_documents(spark, d), load(spark, d, "eval_items")).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split(_documents(spark, d))


def p9_covered(spark: SparkSession, d: str) -> DataFrame:
    """Whether the units of every document cover its text without gaps and overlaps."""
    docs = _documents(spark, d)
    return sentences.covered(docs, sentences.split(docs))


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p5_percentiles, p5_within, p5_noise, p7_packing, p7_placed, p7_usage, p8_found, p8_items, p9_found, p9_covered)}
