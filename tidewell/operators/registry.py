"""Registries of systems and sources: merging, fallbacks, lineage, audits and field discovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.versions import valid_through


def merge(parts: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key with each column's first value that is there, in the order of the parts."""
    rows = None
    for i, part in enumerate(parts):
        have = part.select(key, F.lit(i).alias("_rank"), *[(F.col(c) if c in part.columns else F.lit(None).cast("string")).alias(c) for c in columns])
        rows = have if rows is None else rows.unionByName(have)
    return rows.groupBy(key).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct("_rank", c)))[c].alias(c) for c in columns])


def with_fallback(rows: DataFrame, registry: DataFrame, key: str, default: str) -> DataFrame:
    """Each row's registry entry, or the default entry's where its own is missing or unknown."""
    names = [c for c in registry.columns if c != key]
    first = registry.groupBy(key).agg(F.min(F.struct(*names)).alias("_r")).select(key, "_r.*")  # an id that stands twice gives its first entry
    fallback = first.filter(F.col(key) == default).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"_{c}") for c in names])
    out = rows.join(first, key, "left").withColumn("_one", F.lit(1)).join(fallback, "_one", "left")  # one row at most; without it rows stay
    return out.select(*rows.columns, *[F.coalesce(c, f"_{c}").alias(c) for c in names])


def lineage(systems: DataFrame, chain: DataFrame, at: Column) -> DataFrame:
    """Chain entries that name a system as successor, predecessor or alias and are valid then; each entry once."""
    live = chain.filter(valid_through(at, F.col("valid_from"), F.col("valid_to")))
    hits = [systems.select("pwsid").join(live.withColumn("pwsid", F.col(c)), "pwsid") for c in ("successor", "predecessor", "alias")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()


def resolve_by_points(evidence: DataFrame, key: str, candidate: str, points: str, tie: int = 20, accept: int = 70) -> DataFrame:
    """Points added up for each candidate; a lead under `tie` is a tie, a total under `accept` resolves nothing."""
    total = evidence.groupBy(key, candidate).agg(F.sum(points).alias("total"))
    top = total.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col("total"), F.col(candidate))), asc=False), 1, 2).alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    status = F.when(first["total"] < accept, "unresolved").when(first["total"] - F.coalesce(second["total"], F.lit(0)) < tie, "tie").otherwise("resolved")
    return top.select(key, first["total"].alias("total"), status.alias("status"))


def audit(rows: DataFrame, group: str, required: Sequence[str], key: Sequence[str], sources: DataFrame, source: str) -> DataFrame:
    """Missing fields, surplus rows of a key and rows of unknown sources, for each group."""
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in required), F.lit(0))
    known = sources.select(F.col(source), F.lit(True).alias("_known")).distinct()
    flagged = rows.join(known, source, "left")
    counts = flagged.groupBy(group).agg(F.count("*").alias("rows_"), F.sum(missing).alias("missing_fields"), F.count_if(F.col("_known").isNull()).alias("unknown_source"))
    surplus = rows.groupBy(group, *[k for k in key if k != group]).agg(F.count("*").alias("n")).groupBy(group).agg(F.sum(F.col("n") - 1).alias("duplicate_keys"))
    return counts.join(surplus, group)


def discover_field(features: DataFrame, feature_id: str, properties: str, hint: str, wanted: str) -> DataFrame:
    """The property that looks most like a provider's name: points for its key, its value and its length, less for bare ids."""
    each = features.select(feature_id, F.posexplode(F.array_sort(F.map_entries(properties))).alias("ordinal", "e")).select(feature_id, "ordinal", F.col("e.key").alias("key"), F.col("e.value").alias("value"))
    score = 0.2 + F.when(F.col("key").rlike(hint), 0.5).otherwise(0.0) + F.when(F.col("value").rlike(wanted), 0.3).otherwise(0.0) - F.when(F.col("value").rlike("^[0-9]+$"), 1.0).otherwise(0.0)
    scored = each.withColumn("score", F.when(F.length("value").between(3, 120), score))
    return scored.filter("score is not null").groupBy(feature_id).agg(F.max_by(F.struct("key", "value", "score"), F.struct(F.col("score"), (-F.col("ordinal")).alias("o"))).alias("b")).select(feature_id, "b.key", "b.value", "b.score")


def manifest_hash(rows: DataFrame, group: str, fingerprint: str) -> DataFrame:
    """A digest of each group's fingerprints that no order of rows changes: 64-bit parts are summed, so no group is gathered."""
    part = lambda i: F.sum(F.conv(F.substring(fingerprint, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sha2(F.concat_ws("-", F.count("*").cast("string"), *[part(i).cast("string") for i in range(4)]), 256).alias("digest"))


def blend(rows: DataFrame, key: str, fraction: str, at: Column) -> DataFrame:
    """Shares of the interconnections that are valid then; a missing fraction counts as whole."""
    live = rows.filter(valid_through(at, F.col("valid_from"), F.col("valid_to"))).withColumn("_w", F.coalesce(fraction, F.lit(1.0)))
    total = live.groupBy(key).agg(F.sum("_w").alias("_t"))
    return live.join(total, key).withColumn("share", F.col("_w") / F.col("_t")).drop("_w", "_t")


def only_member(rows: DataFrame, members: DataFrame, key: str, place: str, city: str) -> DataFrame:
    """The member whose city the place names, word by word, if there is exactly one.

    Distinct places and cities meet by shared words, then the whole city must stand in the place. A city brings the number of
    its members and one of them, so neither many rows of a place nor many members of a city make pairs.
    """
    words = lambda c: F.explode(F.array_distinct(F.split(F.upper(c), " ")))
    others = [c for c in members.columns]
    named = rows.select(key, F.col(place).alias("_place")).distinct()
    towns = members.distinct().groupBy(F.col(city).alias("_city")).agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("_m"))
    near = named.select("_place").distinct().withColumn("_w", words(F.col("_place"))).join(towns.select("_city", words(F.col("_city")).alias("_w")), "_w").select("_place", "_city").distinct()
    whole = near.filter(F.contains(F.concat(F.lit(" "), F.upper("_place"), F.lit(" ")), F.concat(F.lit(" "), F.upper("_city"), F.lit(" ")))).join(towns, "_city")
    found = whole.groupBy("_place").agg(F.sum("_n").alias("_n"), F.first("_m").alias("_m"))
    return named.join(found, "_place").groupBy(key).agg(F.sum("_n").alias("_n"), F.first("_m").alias("_m")).filter("_n = 1").select(key, "_m.*")
