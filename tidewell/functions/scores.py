"""Column builders for scores, labels and water chemistry indices."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence_label(x: Column) -> Column:
    return F.when(x >= 0.9, "very-high").when(x >= 0.75, "high").when(x >= 0.55, "moderate").when(x >= 0.35, "low").otherwise("insufficient")


def freshness(age_days: Column, half_life_days: float | Column) -> Column:
    """Halves with every half-life; a missing or negative age weighs nothing, an endless half-life keeps all, and one that is missing or not above 0 says nothing."""
    life = half_life_days if isinstance(half_life_days, Column) else F.lit(float(half_life_days))
    return F.when(age_days.isNull() | (age_days < 0), 0.0).when(life == math.inf, 1.0).when(life > 0, F.pow(F.lit(0.5), age_days / life))


def geometric_mean(*xs: Column) -> Column:
    """Over the positive values only; missing and zero dimensions are skipped."""
    return mean_of_logs(*logs(*xs))


def logs(*xs: Column) -> tuple[Column, Column]:
    """The sum of the positive values' logarithms, and how many there are."""
    each = [F.when(x > 0, F.ln(x)) for x in xs]
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in each]), reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in each])


def mean_of_logs(total: Column, count: Column) -> Column:
    return F.when(count > 0, F.exp(total / F.nullif(count, F.lit(0))))


def coverage_cap(received: Column, expected: Column, fresh: Column, spatial: Column) -> Column:
    return F.least(F.lit(1.0), received / F.nullif(expected, F.lit(0))) * fresh * spatial


def coverage_band(cap: Column) -> Column:
    return F.when(cap >= 0.9, "complete").when(cap >= 0.65, "substantial").when(cap >= 0.35, "partial").otherwise("sparse")


def langelier(ph: Column, tds: Column, temp_c: Column, calcium: Column, alkalinity: Column) -> Column:
    """Saturation index from pH, dissolved solids, temperature, calcium hardness and alkalinity."""
    a = (F.log10(F.greatest(tds, F.lit(1.0))) - 1) / 10
    b = -13.12 * F.log10(temp_c + 273) + 34.55
    c = F.log10(0.4 * calcium)
    return ph - ((9.3 + a + b) - (c + F.log10(alkalinity)))


def chloride_sulfate_tier(chloride: Column, sulfate: Column) -> Column:
    ratio = chloride / F.nullif(sulfate, F.lit(0))
    return F.when(ratio > 0.5, "elevated").when(ratio > 0.2, "moderate").when(ratio.isNotNull(), "low")


def ion_balance(cations: Column, anions: Column) -> Column:
    """Charge balance error in percent."""
    return 100 * F.abs(cations - anions) / F.nullif(cations + anions, F.lit(0))


def balance_status(percent: Column) -> Column:
    return F.when(percent <= 10, "pass").when(percent <= 20, "review").when(percent.isNotNull(), "quarantine")


def lead_risk(status_lead: Column, status_known: Column, year_built: Column) -> Column:
    """Points for a parcel: inventory status, then the year it was built."""
    status = F.when(status_lead, 70).when(status_known, -20).otherwise(0)
    return status + F.when(year_built < 1950, 25).when(year_built < 1987, 15).otherwise(0)


def lead_tier(points: Column) -> Column:
    return F.when(points >= 70, "high").when(points >= 25, "moderate").when(points >= 0, "low").otherwise("minimal")


def era_prior(year_built: Column) -> Column:
    return F.when(year_built < 1940, 0.65).when(year_built < 1950, 0.5).when(year_built < 1986, 0.25).when(year_built < 1991, 0.12).otherwise(0.03)


def service_line_posterior(year_built: Column, inventory_share: Column, inventory_count: Column, csmr: Column, lsi: Column, strength: float = 20.0) -> Column:
    """Era prior blended with the inventory's share by its count, raised where the water is corrosive."""
    weight = inventory_count / (inventory_count + strength)
    blended = (1 - weight) * era_prior(year_built) + weight * F.coalesce(inventory_share, era_prior(year_built))
    return clamp(blended * F.when(csmr > 0.5, 1.25).otherwise(1.0) * F.when(lsi < -0.5, 1.2).otherwise(1.0), 0.0, 1.0)


def value_of_information(flip: Column, impact: Column, fresh: Column, coverage: Column, cost: Column) -> Column:
    return flip * impact * fresh * coverage / F.greatest(cost, F.lit(0.01))


def bid_utility(gain: Column, flip: Column, severity: Column, privacy: Column) -> Column:
    return 0.35 * gain + 0.3 * flip + 0.25 * severity + 0.1 * (1 - privacy)


def bid_cost(effort: Column, latency: Column, privacy: Column) -> Column:
    return 0.45 * effort + 0.25 * latency + 0.3 * privacy
