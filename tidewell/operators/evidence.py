"""Joins and aggregates that weigh evidence: corroboration, peers, reconciliation, coverage, claims."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.measure import first_number, normalized
from tidewell.functions.scores import clamp
from tidewell.operators.ranks import Ranks
from tidewell.operators.scan import PART, carried, in_ranges
from tidewell.streaming.folder import shared_folder


#: Steps of a logarithm's unit in which results are compared, as ranges of windows are whole numbers.
FINE = 10**12


def corroborate(rows: DataFrame, key: Sequence[str], row_id: str, result: str, origin: str, source: str, tolerance: float = 0.02) -> DataFrame:
    """For each row how many others of its logical key agree with it, from other origins and as replicas of its own.

    Two results agree if their first numbers differ by the tolerance of the larger at most, or, where either has none, if
    their texts are equal. Rows of one origin and source are one publication; the same origin from another source is a
    replica; another origin is an independent sample. Agreement is a range of logarithms, so rows are counted by range
    windows and origins by a sweep over each origin's stretches of values, and no pairs are made.
    """
    return corroborated(rows, key, result, origin, source, tolerance).select(row_id, "independent_origins", "publisher_replicas", "factual_status")


def corroborated(rows: DataFrame, key: Sequence[str], result: str, origin: str, source: str, tolerance: float = 0.02) -> DataFrame:
    """The rows with what :func:`corroborate` tells of each. Rows that are dealt by their key before aren't shuffled again up to the sweep."""
    columns = rows.columns
    number = first_number(F.col(result))
    near = math.ceil(-math.log(1 - tolerance) * FINE) + 1
    kind = F.when(number.isNull(), F.concat(F.lit("text "), normalized(F.col(result)))).otherwise(F.signum(number).cast("string"))
    at = F.when(number.isNull() | (number == 0), F.lit(0)).otherwise(F.round(F.ln(F.abs(number)) * FINE)).cast("long")
    rows = rows.withColumns({"_kind": F.coalesce(kind, F.lit("none")), "_at": at})
    group = [*key, "_kind"]
    within = lambda *more: Window.partitionBy(*group, *more).orderBy("_at").rangeBetween(-near, near)
    counted = rows.withColumns({"_origin": F.count("*").over(within(origin)), "_own": F.count("*").over(within(origin, source))})
    step = Window.partitionBy(*group, origin).orderBy("_at")
    apart = F.when(F.col("_at") - F.lag("_at").over(step) <= 2 * near, 0).otherwise(1)
    stretches = rows.withColumn("_new", apart).withColumn("_n", F.sum("_new").over(step.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*group, origin, "_n").agg((F.min("_at") - near).alias("_from"), (F.max("_at") + near).alias("_to"))
    event = lambda df, at, order, change: df.select(*group, at.alias("_at"), F.lit(order).alias("_order"), F.lit(change).alias("_change"), *(F.lit(None).alias(c) for c in ("_origin", "_own", "_row")))
    seen = counted.select(*group, "_at", F.lit(1).alias("_order"), F.lit(0).alias("_change"), "_origin", "_own", F.struct(*columns).alias("_row"))
    events = seen.unionByName(event(stretches, F.col("_from"), 0, 1)).unionByName(event(stretches, F.col("_to"), 2, -1))
    sofar = Window.partitionBy(*group).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("independent_origins", F.sum("_change").over(sofar)).filter("_order = 1")
    out = out.select("_row.*", "independent_origins", (F.col("_origin") - F.col("_own")).alias("publisher_replicas"))
    return out.withColumn("factual_status", F.when(F.col("independent_origins") > 1, "confirmed-independent-sample").otherwise("single-origin-sample"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: Sequence[str], status: str = "status") -> DataFrame:
    """Full outer comparison on the key: rows on one side only, and rows whose status differs."""
    a = ours.select(*key, F.col(status).alias("our_status"), F.lit(True).alias("_a"))
    b = theirs.select(*key, F.col(status).alias("their_status"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "ours-only").when(F.col("_a").isNull(), "theirs-only").when(F.col("our_status") != F.col("their_status"), "status-mismatch")
    out = a.join(b, list(key), "full_outer").withColumn("difference", kind).filter("difference is not null")
    severity = F.when(F.col("difference") == "theirs-only", "critical").otherwise("high")
    return out.withColumn("severity", severity).drop("_a", "_b")


#: The stretch of rows without a date.
UNDATED = -(2**40)
#: Groups of analytes that systems are compared in.
COMPARABLE = ("INOR", "DBP", "VOC", "SOC", "RAD", "PFAS", "MICRO", "METAL")
PEERS = "status string, peer_count long, percentile double, band string, peer_median double, peer_min double, peer_max double"


def peer_percentile(latest: DataFrame, system: str, analyte: str, group: str, value: str, censored: str, date: str, least: int = 5, days: int = 366) -> DataFrame:
    """Each system's latest result among the latest uncensored ones of other systems whose dates are near.

    latest: one row for each system and analyte. The share of peers below, plus half of the equal ones, gives the band. A missing
    date is near all. An analyte's dates are cut into stretches of `days`, and a stretch meets its two neighbours' rows; rows
    without a date are peers in every stretch and meet all rows in one of their own. In a stretch peers stand by date,
    and counts and order statistics of a window of dates come from its ranks in log time.
    """
    near = [c for c in (system, analyte)]
    rows = latest.filter(F.col(group).isNull() | (F.trim(group) == "") | F.upper(F.trim(group)).isin(*COMPARABLE)).filter(F.col(censored) | F.col(value).isNotNull())
    day = F.unix_date(F.col(date).cast("date"))
    rows = rows.select(*near, F.when(~F.col(censored), F.col(value)).cast("double").alias("_v"), day.cast("double").alias("_d"), F.floor(day / days).alias("_t"))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  columns of their own, as both sides come from the same rows
    asked = rows.withColumn("_t", F.coalesce("_t", F.lit(UNDATED)))
    usable = rows.filter("_v is not null and not isnan(_v)")
    open_ = asked.select(analyte, "_t").distinct()
    dated, undated = usable.filter("_t is not null"), usable.filter("_t is null").drop("_t")
    around = dated.withColumn("_t", F.explode(F.array(F.col("_t") - 1, F.col("_t"), F.col("_t") + 1))).join(open_, [analyte, "_t"], "left_semi")
    peers = around.unionByName(undated.join(open_, analyte)).unionByName(dated.drop("_t").join(open_.filter(F.col("_t") == UNDATED), analyte))

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        x, t = (mine[c].to_numpy(zero_copy_only=False).astype(float) for c in ("_v", "_d"))
        values, dates = (theirs[c].to_numpy(zero_copy_only=False).astype(float) for c in ("_v", "_d"))
        order = np.argsort(dates, kind="stable")  # dates that are missing come last
        values, dates = values[order], dates[order]
        known = int((~np.isnan(dates)).sum())
        told = np.flatnonzero(~np.isnan(x))
        v, d = x[told], t[told]
        lo = np.where(np.isnan(d), 0, np.searchsorted(dates[:known], d - days, "left"))
        hi = np.where(np.isnan(d), known, np.searchsorted(dates[:known], d + days, "right"))
        stretches = [(lo, hi), (np.full(len(v), known), np.full(len(v), len(values)))]
        n = sum(b - a for a, b in stretches) - 1  # the row itself is among them
        status = np.full(len(x), "current-result-censored", object)
        status[told] = np.where(n >= least, "comparable", "insufficient-peer-coverage")
        count = np.zeros(len(x), np.int64)
        count[told] = n
        out = {c: np.full(len(x), np.nan) for c in ("percentile", "peer_median", "peer_min", "peer_max")}
        at = np.flatnonzero(n >= least)
        if len(at):
            ranks, stretches, n, v = Ranks(values), [(a[at], b[at]) for a, b in stretches], n[at], v[at]
            below = sum(ranks.below(a, b, v) for a, b in stretches)
            equal = sum(ranks.below(a, b, v, equal=True) for a, b in stretches) - below - 1
            other = lambda k: ranks.kth(stretches, k + (k >= below))  # noqa: E731  its own place is passed over
            out["percentile"][told[at]] = (below + 0.5 * equal) / n
            out["peer_median"][told[at]] = (other((n - 1) // 2) + other(n // 2)) / 2
            out["peer_min"][told[at]], out["peer_max"][told[at]] = other(np.zeros(len(n), np.int64)), other(n - 1)
        share = out["percentile"]
        band = np.select([np.isnan(share), share >= 0.9, share >= 0.75, share <= 0.1, share <= 0.25], ["", "upper-decile", "upper-quartile", "lower-decile", "lower-quartile"], "middle-half")
        number = lambda c: pa.array(out[c], pa.float64(), from_pandas=True)
        made = [pa.array(status, pa.string()), pa.array(count), number("percentile"), pa.array([b or None for b in band.tolist()], pa.string()), *map(number, ("peer_median", "peer_min", "peer_max"))]
        return pa.table([*[mine[c] for c in near], *made], names=[*near, *[c.split()[0] for c in PEERS.split(", ")]])

    types = dict(rows.dtypes)
    return fresh(asked).groupBy(analyte, "_t").cogroup(fresh(peers).groupBy(analyte, "_t")).applyInArrow(compare, ", ".join(f"{c} {types[c]}" for c in near) + ", " + PEERS)


def coverage_cells(rows: DataFrame, axes: Sequence[str], censored: str, value: str) -> DataFrame:
    """Counts of records, detects, non-detects and numbers in each cell of the axes."""
    return rows.groupBy(*axes).agg(
        F.count("*").alias("records"), F.count_if(~F.col(censored) & (F.col(value) > 0)).alias("detects"), F.count_if(F.col(censored)).alias("non_detects"), F.count(value).alias("numeric"),
    )


def expected_coverage(cells: DataFrame, expected: DataFrame, group: str, as_of_year: int) -> DataFrame:
    """Each expected group with what was measured, lately or not, and groups that are missing."""
    got = cells.groupBy(group).agg(F.count_distinct("analyte").alias("analytes"), F.count("*").alias("cells"), F.max("quarter").alias("latest_quarter"))
    out = expected.join(got, group, "left")
    return out.withColumns({"measured": F.col("cells").isNotNull(), "recent": F.coalesce(F.substring("latest_quarter", 1, 4).cast("int") >= as_of_year - 1, F.lit(False))})


def effective_n(rows: DataFrame, key: Sequence[str], origin: str, rho: float = 0.5) -> DataFrame:
    """Raw and distinct-origin counts, replication, and the count that within-origin correlation leaves."""
    by_origin = rows.groupBy(*key, origin).agg(F.count("*").alias("m"))
    out = by_origin.groupBy(*key).agg(F.sum("m").alias("raw"), F.count("*").alias("origins"), (F.pow(F.sum("m"), F.lit(2)) / F.sum(F.col("m") * (1 + (F.col("m") - 1) * rho))).alias("correlated_n"))
    return out.withColumns({"replicas": F.col("raw") - F.col("origins"), "independence": F.sqrt(F.col("origins") / F.col("raw"))})


# How far agents are trusted where no reliability is given, and any other agent.
RELIABILITY = {
    "Provider Identity Agent": 0.98, "Boundary Robustness Agent": 0.96, "Evidence Scope Guardian": 0.995, "SDWIS Compliance Agent": 0.97, "CCR Context Agent": 0.94,
    "WQP Context Agent": 0.99, "Originating-Sample Independence Agent": 0.98, "Temporal Freshness Agent": 0.95, "Contradiction Agent": 0.97, "Direct Household Sample Agent": 0.995,
}
OTHER_AGENT = 0.8


def origins_of(claims: DataFrame) -> DataFrame:
    """The claims with `_origins`: their distinct origins, or the claim's own id where they name none."""
    named = F.array_distinct(F.filter(F.coalesce("origins", F.array().cast("array<string>")), lambda o: o.isNotNull() & (o != "")))
    return claims.withColumn("_origins", F.when(F.size(named) > 0, named).otherwise(F.array(F.concat(F.lit("claim "), F.col("claim_id").cast("string")))))


def negotiate(claims: DataFrame, reliability: DataFrame, accept: float = 0.62, margin: float = 0.12) -> DataFrame:
    """Verdict for each topic and proposition: an origin counts once, at its strongest claim, for each stance.

    claims: claim_id, topic, proposition, stance, agent, confidence, origins (array), hard_veto. reliability: agent,
    weight. A hard veto against rejects; else the scores themselves, not their shares, must reach `accept` and lead by
    `margin`. A claim's confidence is shared among its origins.
    """
    known = F.create_map(*[F.lit(x) for pair in RELIABILITY.items() for x in pair])
    trust = clamp(F.coalesce("weight", F.try_element_at(known, F.col("agent")), F.lit(OTHER_AGENT)), 0.0, 1.0)
    weighted = origins_of(claims.join(reliability, "agent", "left")).withColumn("w", clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0) * trust / F.size("_origins"))
    group = ["topic", "proposition"]
    by_origin = weighted.select(*group, "stance", "w", F.explode("_origins").alias("origin")).groupBy(*group, "stance", "origin").agg(F.max("w").alias("w"))
    opposes = F.col("stance") == "oppose"
    score = by_origin.groupBy(*group).agg(F.sum(F.when(~opposes, F.col("w")).otherwise(0.0)).alias("support"), F.sum(F.when(opposes, F.col("w")).otherwise(0.0)).alias("oppose"), F.count_if(~opposes & ~F.col("origin").startswith("claim ")).alias("origins"))
    told = claims.groupBy(*group).agg(F.bool_or(F.coalesce("hard_veto", F.lit(False)) & opposes).alias("vetoed"), F.count("*").alias("claims"), F.bool_or(opposes).alias("dissent"))
    lead = F.col("support") - F.col("oppose")
    verdict = F.when(F.col("vetoed"), "rejected").when((F.col("support") >= accept) & (lead >= margin), "accepted").when((F.col("oppose") >= accept) & (-lead >= margin), "rejected").otherwise("undecided")
    return score.join(told, group).withColumns({"confidence": clamp(F.col("support") / (F.col("support") + F.col("oppose") + 1e-9), 0.0, 1.0), "verdict": verdict})


def leave_one_origin_out(claims: DataFrame, reliability: DataFrame) -> DataFrame:
    """How many verdicts of a topic flip, and by how much confidences move, when one origin's claims are taken away.

    Each claim is repeated once for every other origin of its own topic only, so rows grow with a topic's origins. A
    proposition that loses all its claims is absent, with confidence 0.
    """
    told = origins_of(claims)
    origins = told.select("topic", F.explode("_origins").alias("left_out")).distinct()
    rest = told.join(origins, "topic").filter(~F.array_contains("_origins", F.col("left_out"))).drop("_origins")
    again = negotiate(rest.withColumn("topic", F.concat_ws("\t", "topic", "left_out")), reliability).withColumns({"left_out": F.substring_index("topic", "\t", -1), "topic": F.substring_index("topic", "\t", 1)})
    base = negotiate(claims, reliability).select("topic", "proposition", F.col("verdict").alias("base_verdict"), F.col("confidence").alias("base_confidence"))
    every = base.join(origins, "topic").join(again.select("topic", "proposition", "left_out", "verdict", "confidence"), ["topic", "proposition", "left_out"], "left")
    changed = F.coalesce(F.col("verdict"), F.lit("absent")) != F.col("base_verdict")
    change = F.abs(F.coalesce("confidence", F.lit(0.0)) - F.col("base_confidence"))
    return every.groupBy("topic", "left_out").agg(F.count_if(changed).alias("flips"), F.sum(change).alias("total_change"), F.max(change).alias("max_change"))


def beta_posterior(rows: DataFrame, priors: DataFrame, key: str = "agent") -> DataFrame:
    """Reliability of each agent: prior alpha and beta plus the weights of right and wrong adjudications."""
    seen = rows.groupBy(key).agg(F.sum(F.when(F.col("correct"), F.col("weight")).otherwise(0.0)).alias("right"), F.sum(F.when(~F.col("correct"), F.col("weight")).otherwise(0.0)).alias("wrong"))
    out = priors.join(seen, key, "full_outer").select(key, (F.coalesce("alpha", F.lit(1.0)) + F.coalesce("right", F.lit(0.0))).alias("alpha"), (F.coalesce("beta", F.lit(1.0)) + F.coalesce("wrong", F.lit(0.0))).alias("beta"))
    return out.withColumn("mean", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))


def pareto_front(rows: DataFrame, utility: str, cost: str, row_id: str) -> DataFrame:
    """Rows that no other row beats in one of higher utility and lower cost without being worse in the other.

    By descending utility, a row is on the front if its cost is below every cost at a higher utility and the least at its own;
    least costs are carried over ranges of utility. Rows that lack one of the two are on no front.
    """
    at = in_ranges(rows.groupBy(utility).agg(F.min(cost).alias("_least")).filter(F.col(utility).isNotNull() & F.col("_least").isNotNull()), F.col(utility).desc())
    w = Window.partitionBy(PART).orderBy(F.col(utility).desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.least(F.min("_least").over(w), carried(at, F.min("_least"), min, None))
    front = at.withColumn("_before", before).filter("_before is null or _least < _before")
    return rows.join(front.select(utility, F.col("_least").alias(cost)), [utility, cost]).select(row_id, utility, cost)


def prediction_set(scores: DataFrame, key: str, candidate: str, score: str, calibration: Sequence[float], alpha: float = 0.1) -> DataFrame:
    """Split-conformal set of each key: candidates whose nonconformity 1 - score is within the calibrated quantile."""
    ordered = sorted(calibration)
    q = ordered[min(len(ordered) - 1, max(0, math.ceil((len(ordered) + 1) * (1 - alpha)) - 1))]
    kept = scores.filter(1 - F.col(score) <= q + 1e-12)
    return kept.groupBy(key).agg(F.count("*").alias("set_size"), F.max_by(candidate, F.struct(score, candidate)).alias("top"))


def provider_set(scores: DataFrame, key: str, candidate: str, score: str, calibration: Sequence[float] = (), alpha: float = 0.1, accepted: str | None = None) -> DataFrame:
    """The candidates that stay plausible for each key: status, set_size, singleton, top_margin and members (candidate, score) by descending score.

    With calibration, those whose 1 - score is within its quantile. Without, those near the best (nearer the surer it is) of half a
    score at least, without a promise of coverage. The accepted candidate, if it is one at all, is always in. A candidate counts
    once, at its best score, cut to 0 to 1; a key whose candidates all fail has an empty set.
    """
    best = scores.filter(F.col(candidate).isNotNull()).groupBy(key, F.col(candidate).alias("candidate")).agg(
        F.max(clamp(F.coalesce(score, F.lit(0.0)), 0.0, 1.0)).alias("score"), F.bool_or(F.col(candidate) == F.col(accepted) if accepted else F.lit(False)).alias("_accepted")
    )
    one = best.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "candidate"))).withColumn("_top", F.max("score").over(Window.partitionBy(key)))
    if calibration:
        ordered = sorted(calibration)
        inside = 1 - F.col("score") <= ordered[min(len(ordered) - 1, max(0, math.ceil((len(ordered) + 1) * (1 - alpha)) - 1))] + 1e-12
    else:
        gap = F.greatest(F.lit(0.03), F.least(F.lit(0.12), (1 - F.col("_top")) * 0.5 + 0.03))
        inside = (F.col("_top") - F.col("score") <= gap) & (F.col("score") >= 0.5)
    inside = inside | F.coalesce("_accepted", F.lit(False))
    second = F.max(F.when(F.col("_first") == 2, F.col("score")))
    out = one.withColumn("_in", inside).groupBy(key).agg(F.count_if("_in").alias("set_size"), (F.max("score") - F.coalesce(second, F.lit(0.0))).alias("top_margin"), F.collect_list(F.when(F.col("_in"), F.struct((-F.col("score")).alias("s"), F.col("candidate")))).alias("_m"))
    members = F.transform(F.array_sort("_m"), lambda m: F.struct(m["candidate"].alias("candidate"), (-m["s"]).alias("score")))
    return out.select(key, F.lit("calibrated" if calibration else "uncalibrated-conservative").alias("status"), "set_size", (F.col("set_size") == 1).alias("singleton"), "top_margin", members.alias("members"))


CUTS = "status string, groups int, cut_size int, cut array<string>"


def cut_sets(claims: DataFrame, most: int = 3, sets: int = 20) -> DataFrame:
    """The smallest sets of origins, `most` at most, whose removal leaves no group of a topic with both stances.

    A claim falls with any of its origins. One row for each set (the first `sets` in order), or one without a set where
    none is small enough. Only groups with both stances leave the shuffle; a topic's are searched by branching: some
    side of the first open group must fall, so some origin of one of its claims must be in the set.
    """
    told = origins_of(claims)
    group = ["topic", "proposition"]
    both = claims.groupBy(*group).agg(F.bool_or(F.col("stance") == "oppose").alias("o"), F.bool_or(F.col("stance") != "oppose").alias("s")).filter("o and s").select(*group)
    open_ = told.join(both, group).select(*group, (F.col("stance") == "oppose").alias("against"), F.array_sort("_origins").alias("origins")).distinct()

    def search(table: pa.Table) -> pa.Table:
        groups: dict[str, tuple[list, list]] = {}
        for p, against, origins in zip(*[table[c].to_pylist() for c in ("proposition", "against", "origins")]):
            groups.setdefault(p, ([], []))[against].append(frozenset(origins))
        found: set[frozenset] = set()

        def branch(cut: frozenset, left: int) -> None:
            for sides in groups.values():
                alive = [[c for c in side if not c & cut] for side in sides]
                if alive[0] and alive[1]:
                    if left:
                        for side in alive:
                            for o in min(side, key=len):  # some claim of this side must fall if the side does
                                branch(cut | {o}, left - 1)
                    return
            found.add(cut)

        size = 0
        while not found and size < most:
            size += 1
            branch(frozenset(), size)
        cuts = sorted(sorted(c) for c in found if len(c) == size)[:sets]
        n, topic = len(cuts) or 1, table["topic"][0].as_py()
        return pa.table([pa.array([topic] * n), pa.array(["computed" if cuts else "cutset-exceeds-search-limit"] * n), pa.array([len(groups)] * n, pa.int32()), pa.array([size if cuts else None] * n, pa.int32()), pa.array(cuts or [None], pa.list_(pa.string()))], names=["topic", *[c.split()[0] for c in CUTS.split(", ")]])

    return open_.groupBy("topic").applyInArrow(search, f"topic {dict(claims.dtypes)['topic']}, " + CUTS)


def cut_sets_over_all(claims: DataFrame, most: int = 3, sets: int = 20) -> DataFrame:
    """The smallest sets of origins whose removal leaves no group of any topic with both stances, searched over all topics at once.

    One row for each set (the first `sets` in order), one without a set where none of up to `most` origins does, none without
    contradictions. While a group is open under a set, some claim of its lesser ones on either side must fall, so the set
    needs an origin of one of these two. A step holds all claims against the sets so far, in partial sums, and brings one open
    group a set to the driver; sets are at most (origins of two claims) ** steps, however many claims there are.
    """
    told = origins_of(claims)
    group = ["topic", "proposition"]
    both = claims.groupBy(*group).agg(F.bool_or(F.col("stance") == "oppose").alias("o"), F.bool_or(F.col("stance") != "oppose").alias("s")).filter("o and s").select(*group)
    shared_folder(claims.sparkSession)
    rows = told.join(both, group).select(*group, (F.col("stance") == "oppose").alias("against"), F.array_sort("_origins").alias("origins")).distinct().checkpoint(eager=True)
    n, schema = both.count(), "status string, groups long, cut_size int, cut array<string>"
    spark, frontier = claims.sparkSession, [()]
    for size in range(most + 1):
        cuts = F.broadcast(spark.createDataFrame([(i, list(c)) for i, c in enumerate(frontier)], "i int, cut array<string>"))  # the frontier
        alive = rows.crossJoin(cuts).filter(~F.arrays_overlap("origins", "cut"))
        claim = F.struct(F.size("origins").alias("n"), F.col("origins"))
        sides = alive.groupBy("i", *group).agg(F.min(F.when(F.col("against"), claim)).alias("o"), F.min(F.when(~F.col("against"), claim)).alias("s")).filter("o is not null and s is not null")
        left = {r["i"]: r["g"] for r in sides.groupBy("i").agg(F.min(F.struct(F.col("o.n") + F.col("s.n"), *group, "o", "s")).alias("g")).collect()}
        done = sorted(c for i, c in enumerate(frontier) if i not in left)
        if done:
            return spark.createDataFrame([("computed", n, size, list(c)) for c in done[:sets]] if n else [], schema)
        frontier = sorted({tuple(sorted({*frontier[i], o})) for i, g in left.items() for o in {*g["o"]["origins"], *g["s"]["origins"]}})
    return spark.createDataFrame([("cutset-exceeds-search-limit", n, None, None)], schema)


def buckets(rows: DataFrame, p: Column, correct: Column, bins: int = 5) -> DataFrame:
    """Calibration bins of a probability: count, mean and how often it was right."""
    b = F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.when(correct, 1.0).otherwise(0.0)).alias("observed"))
