"""Score curves and calibration as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def piecewise(x: Column, points: list[tuple[float, float]], slope: float = 0.0, floor: float | None = None) -> Column:
    """Straight lines through `points`, flat before the first, `slope` after the last down to `floor`."""
    curve = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        curve = curve.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    last = F.lit(points[-1][1]) + (x - points[-1][0]) * slope
    return curve.when(x.isNotNull(), F.greatest(F.lit(floor), last) if floor is not None else last)


def steps(x: Column, bounds: list[tuple[float, float]], otherwise) -> Column:
    """First step whose upper bound holds x."""
    curve = F
    for bound, y in bounds:
        curve = curve.when(x <= bound, F.lit(float(y)))
    return curve.when(x.isNotNull(), otherwise)


# Breakpoints of the curves.
WALK = [(5, 1.0), (10, 0.7), (15, 0.4), (20, 0.2)]
TRAVEL = {
    ("airport", "TRANSIT"): [(30, 1.0), (60, 0.7), (90, 0.35), (120, 0.15)],
    ("airport", "DRIVE"): [(20, 1.0), (40, 0.7), (60, 0.4), (90, 0.15)],
    ("rail", "TRANSIT"): [(20, 1.0), (40, 0.7), (60, 0.4), (90, 0.15)],
    ("rail", "DRIVE"): [(15, 1.0), (30, 0.7), (45, 0.4), (75, 0.15)],
}
COMMUTE_CDF = [
    (5, 3.0), (10, 8.0), (15, 15.0), (20, 23.0), (25, 32.0), (30, 42.0), (35, 52.0), (40, 60.0),
    (45, 68.0), (50, 74.0), (55, 79.0), (60, 84.0), (70, 90.0), (80, 94.0), (90, 97.0), (120, 99.5),
]


def walk_coefficient(minutes: Column) -> Column:
    return piecewise(minutes, WALK, -0.01, 0.05)


def travel_coefficient(minutes: Column, place: Column, mode: Column) -> Column:
    curve = F
    for (p, m), points in TRAVEL.items():
        curve = curve.when((place == p) & (mode == m), piecewise(minutes, points, -0.01, 0.05))
    return curve.otherwise(F.lit(None).cast("double"))


def growth_score(cagr: Column) -> Column:
    """Growth rate to 0..100; unknown is neutral."""
    return (
        F.when(cagr.isNull(), 50.0).when(cagr >= 10, 100.0).when(cagr >= 7, 92 + (cagr - 7) * 2.67).when(cagr >= 5, 82 + (cagr - 5) * 5)
        .when(cagr >= 3, 68 + (cagr - 3) * 7).when(cagr >= 0, 50 + cagr * 6).otherwise(F.greatest(F.lit(0.0), 50 + cagr * 5))
    )


def crime_rate_score(per_1000: Column) -> Column:
    first = F.when(per_1000 <= 3, 95.0).when(per_1000 <= 6, 95 - (per_1000 - 3) * 5).when(per_1000 <= 10, 80 - (per_1000 - 6) * 7.5)
    return first.when(per_1000 <= 15, 50 - (per_1000 - 10) * 4).when(per_1000 <= 25, 30 - (per_1000 - 15) * 2).when(
        per_1000.isNotNull(), F.greatest(F.lit(2.0), 10 - (per_1000 - 25) * 0.5))


def crime_count_score(total: Column) -> Column:
    return F.when(total <= 150, 100.0).when(total <= 350, 100 - (total - 150) / 200 * 40).when(
        total.isNotNull(), F.greatest(F.lit(0.0), 60 - (total - 350) / 650 * 60))


def commute_steps(minutes: Column, km: Column, mode: Column) -> Column:
    """Step scores of time and distance, mixed by travel mode; unknown distance leaves time alone."""
    time = steps(minutes, [(15, 95), (25, 85), (35, 75), (45, 65), (60, 50), (75, 35)], F.greatest(F.lit(15.0), 95 - minutes))
    dist = steps(km, [(5, 100), (10, 85), (15, 70), (20, 55)], F.lit(40.0))
    share = F.when(mode.isin("WALK", "BICYCLE"), 0.7).when(mode == "DRIVE", 0.8).otherwise(0.9)
    return F.when(F.coalesce(km, F.lit(0.0)) <= 0, time).otherwise(time * share + dist * (1 - share))


def commute_percentile(minutes: Column) -> Column:
    """Share of commuters beaten, by straight lines in a fixed distribution."""
    inside = 100 - piecewise(minutes, COMMUTE_CDF)
    return F.when(minutes <= 5, 99.0).when(minutes >= 120, 0.5).otherwise(F.round(inside, 1))


def noise_score(db: Column) -> Column:
    return 5.0 + 90.0 / (1.0 + F.exp(0.18 * (db - 63.0)))


# Upper bound and name of each noise level; louder is extremely noisy.
NOISE_LEVELS = ((50, "quiet"), (55, "fairly_quiet"), (60, "moderate"), (65, "noisy"), (70, "very_noisy"))


def noise_level(db: Column) -> Column:
    level = F
    for below, name in NOISE_LEVELS:
        level = level.when(db < below, name)
    return level.otherwise("extremely_noisy")


def air_quality(no2: Column, pm25: Column, pm10: Column) -> Column:
    """Mean ratio to the guideline over the pollutants present, through a sigmoid."""
    ratios = F.filter(
        F.array(F.when(no2 != 0, no2 / 10), F.when(pm25 != 0, pm25 / 5), F.when(pm10 != 0, pm10 / 15)), lambda r: r.isNotNull()
    )
    mean = F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r) / F.size(ratios)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(5 + 95 / (1 + F.exp(1.5 * (mean - 2.0))))))
    return F.when(F.size(ratios) == 0, 0).otherwise(score)


def air_level(score: Column, none: Column) -> Column:
    return F.when(none, "moderate").when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "moderate").otherwise("poor")


RISKS = {"very_low": 1, "low": 2, "medium": 3, "high": 4}
RISK_SCORES = {"very_low": 100, "low": 75, "medium": 50, "high": 20}


def risk_max(a: Column, b: Column) -> Column:
    """Higher of two risk labels; a missing one counts as very low."""
    order = F.create_map(*[F.lit(x) for kv in RISKS.items() for x in kv])
    names = F.create_map(*[F.lit(x) for k, v in RISKS.items() for x in (v, k)])
    rank = [F.coalesce(F.try_element_at(order, F.replace(F.lower(r), F.lit(" "), F.lit("_"))), F.lit(1)) for r in (a, b)]
    return F.element_at(names, F.greatest(*rank))


def decile_score(decile: Column) -> Column:
    return F.when(decile.between(1, 10), 22 + decile * 7.8).otherwise(50.0)


def probit(p: Column) -> Column:
    """Inverse normal by the Abramowitz-Stegun rational approximation, clamped at 0.0001."""
    q = F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), p))
    t = F.sqrt(-2.0 * F.log(F.least(q, 1 - q)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1.0 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(q < 0.5, -z).otherwise(z)


def calibrated(p: Column, mean: float = 65.0, sd: float = 15.0) -> Column:
    """Percentile (0..1) to the N(65, 15) scale, clamped to 5..98."""
    return F.greatest(F.lit(5.0), F.least(F.lit(98.0), mean + sd * probit(p)))


def phi(z: Column) -> Column:
    """Normal distribution function; erf by the Abramowitz-Stegun 7.1.26 polynomial."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z < 0, 0.5 * (1 - erf)).otherwise(0.5 * (1 + erf))


def rating_text(score: Column) -> Column:
    share = F.greatest(F.lit(1), F.least(F.lit(99), F.round(phi((score - 65.0) / 15.0) * 100).cast("int")))
    return F.when(score.isNull(), "Insufficient data").otherwise(F.format_string("Better than %d%% of postcodes", share))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts present, weights redistributed; NULL when none is."""
    num = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(den > 0, num / den)
