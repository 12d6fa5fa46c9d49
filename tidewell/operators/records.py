"""Operators over record tables: latest rows and histories, lookups, mutations, summaries by scope, replay digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.measure import anchored_number, qualifier
from tidewell.functions.records import logical_key
from tidewell.operators import evidence

# What an evidence item can be matched to, nearest first.
SCOPES = ("exact-address", "affected-address-range", "street", "neighborhood", "system-context")


def latest_row(rows: DataFrame, key: Sequence[str], dates: Sequence[str], *ties: str) -> DataFrame:
    """Each key's row of the greatest of several dates; a row without any comes last, ties go by the columns given, descending."""
    at = F.greatest(*[F.col(d) for d in dates]) if len(dates) > 1 else F.col(dates[0])
    order = [at.desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties]]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_with_counts(rows: DataFrame, key: Sequence[str], date: str, result: str, found: str, row_id: str) -> DataFrame:
    """Each key's latest row with its parsed result, and over its whole history the records and the detected ones.

    The history itself stays in the table, ordered by `position` with :func:`history`; no group is collected into a row.
    """
    w = Window.partitionBy(*key)
    counted = rows.withColumns({"record_count": F.count("*").over(w), "positive_count": F.count_if(found).over(w)})
    out = latest_row(counted, key, [date], row_id)
    return out.withColumns({"parsed_value": anchored_number(F.col(result)), "parsed_qualifier": qualifier(F.col(result))})


def history(rows: DataFrame, key: Sequence[str], date: str, row_id: str) -> DataFrame:
    """All rows with their place in their key's history, the newest first."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(date).desc_nulls_last(), F.col(row_id).desc())))


def mutated(rows: DataFrame, row_id: str, result: str, unit: str, date: str) -> DataFrame:
    """Four faulty versions of each row: result times 100, other unit, another id, a date in the future."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("decimal-shift", "unit-flip", "duplicate", "date-future")]))
    kind = F.col("mutation")
    other = F.when(F.lower(unit) == "mg/l", "ug/L").otherwise("mg/L")
    return rows.withColumn("mutation", kinds).withColumns(
        {
            result: F.when(kind == "decimal-shift", (F.col(result).try_cast("double") * 100).cast("string")).otherwise(F.col(result)),
            unit: F.when(kind == "unit-flip", other).otherwise(F.col(unit)),
            row_id: F.when(kind == "duplicate", F.concat(F.coalesce(F.col(row_id).cast("string"), F.lit("r")), F.lit("-dup"))).otherwise(F.col(row_id).cast("string")),
            date: F.when(kind == "date-future", F.lit("2099-01-01").cast("date")).otherwise(F.col(date)),
        }
    )


def kill_rate(outcomes: DataFrame, key: Sequence[str], flagged: Column, before: Column, after: Column) -> DataFrame:
    """The share of mutations that are flagged or change nothing."""
    killed = flagged | before.eqNullSafe(after)
    return outcomes.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(killed).alias("killed"), F.avg(killed.cast("double")).alias("kill_rate"))


def sample_match(addresses: DataFrame, samples: DataFrame, hash_column: str) -> DataFrame:
    """Samples that were taken at an address, by its hash; an address without any stays, with nulls."""
    return addresses.join(samples, hash_column, "left")


def verify(rows: DataFrame, key: Sequence[str], row_id: str, result: str, origin: str, source: str, labs: DataFrame, lab_id: str, lab_name: str, date: str) -> DataFrame:
    """Corroboration, the laboratory's standing and a digest of both for each row.

    labs: lab_id, name, status, expires_on, certified. A laboratory is found by its id, else by its name; the standing is
    accredited only if it is active on the sample's date and certified.
    """
    told = [c for c in ("independent_origins", "publisher_replicas", "factual_status") if c in rows.columns]
    rows = evidence.corroborated(rows.withColumnsRenamed({c: f"_{c}" for c in told}), key, result, origin, source)
    rows = rows.drop(*told).withColumnsRenamed({f"_{c}": c for c in told})  # what rows say of themselves stays
    lab = F.struct("status", "expires_on", "certified")
    clean = lambda c: F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))
    # of several entries of a laboratory the active one, then the one that lasts longest
    first = F.struct(F.coalesce(F.col("status") == "active", F.lit(False)).cast("int"), F.col("expires_on").isNull().cast("int"), "expires_on", F.to_json(lab))
    by_id = labs.groupBy(clean("lab_id").alias("_id")).agg(F.max_by(lab, first).alias("_by_id")).filter("_id is not null")
    by_name = labs.groupBy(clean("name").alias("_name")).agg(F.max_by(lab, first).alias("_by_name")).filter("_name is not null")
    out = rows.withColumns({"_id": clean(lab_id), "_name": clean(lab_name)}).join(by_id, "_id", "left").join(by_name, "_name", "left").withColumn("_lab", F.coalesce("_by_id", "_by_name"))
    on = (F.col("_lab.status") == "active") & (F.col("_lab.expires_on").isNull() | (F.col("_lab.expires_on") >= F.col(date)))
    tier = F.when(F.col("_lab").isNull(), "unknown-accreditation").when(on & F.col("_lab.certified"), "accredited").when(F.col("_lab.status") == "expired", "expired-accreditation").otherwise("unaccredited-or-unverified")
    out = out.withColumn("accreditation", tier).drop("_id", "_name", "_by_id", "_by_name", "_lab")
    return out.withColumn("verification_hash", F.sha2(F.concat_ws("|", logical_key(*[F.col(k) for k in key]), "independent_origins", "publisher_replicas", "accreditation"), 256))


def scope_counts(items: DataFrame, key: Sequence[str], scope: str, score: str, relevant: str, item: str) -> DataFrame:
    """Relevant items by scope, and the best one that is nearer than the whole system; unknown scopes count as system context."""
    known = F.when(F.col(scope).isin(*SCOPES), F.col(scope)).otherwise(SCOPES[-1])
    near = F.col(relevant) & F.coalesce(F.col(scope) != SCOPES[-1], F.lit(False))
    best = F.max(F.when(near, F.struct(F.col(score), (-F.col(item)).alias("i"), F.col(scope).alias("s"))))
    counts = [F.count_if(F.col(relevant) & (known == s)).alias(s.replace("-", "_")) for s in SCOPES]
    out = items.groupBy(*key).agg(F.count("*").alias("items"), *counts, best.alias("_b"))
    return out.withColumns({"best_scope": F.coalesce(F.col("_b.s"), F.lit("none")), "best_item": -F.col("_b.i")}).drop("_b")


def impact(rows: DataFrame, key: Sequence[str], visitor: str, household: str, at: str, row_id: str) -> DataFrame:
    """Runs, distinct visitors, and household sizes counted once, as stated at a visitor's first run."""
    first = rows.groupBy(*key, visitor).agg(F.count("*").alias("n"), F.min_by(household, F.struct(at, row_id)).alias("size"))
    return first.groupBy(*key).agg(F.sum("n").alias("completed"), F.count(visitor).alias("visitors"), F.sum("size").alias("people"))


def same_members(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """For each key of both whether the sets of members are equal, and whether the left holds all of the right.

    Counted by one grouping on (key, member), so that no set is collected.
    """
    both = left.select(key, member, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, member, F.lit(0).alias("l"), F.lit(1).alias("r")))
    each = both.groupBy(key, member).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    out = each.groupBy(key).agg(F.max("l").alias("_l"), F.max("r").alias("_r"), F.bool_and((F.col("l") == 1) & (F.col("r") == 1)).alias("equal"), F.bool_and(F.col("l") == 1).alias("superset"))
    return out.filter("_l = 1 and _r = 1").drop("_l", "_r")


def replay(before: DataFrame, after: DataFrame, key: str, *fields: str) -> DataFrame:
    """Digests of two runs' rows by key and whether they are identical; a row that one run lacks is not."""
    digest = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256).alias(name))
    out = digest(before, "before").join(digest(after, "after"), key, "full")
    return out.withColumn("identical", F.coalesce(F.col("before") == F.col("after"), F.lit(False)))
