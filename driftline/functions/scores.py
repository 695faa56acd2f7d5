"""Scalar scores and buckets as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the shrinkage: prior hours, prior catches per hour, least effort in hours.
PRIOR_HOURS, PRIOR_RATE, MIN_HOURS = 4.0, 0.5, 0.25
# Fixed values of the attribution: confidence lost over the first window, and what is left after it.
DECAY_WITHIN, DECAY_AFTER = 0.7, 0.3


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clamp01(x, nan: float = 0.5) -> Column:
    """x in [0, 1]; NaN gives ``nan``. Spark sorts NaN above every number, so it is asked for first."""
    x = _col(x)
    return F.when(F.isnan(x), F.lit(nan)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def rate(numerator, denominator) -> Column:
    """Null, never zero, where the denominator is unknown or zero."""
    return F.when(_col(denominator) > 0, _col(numerator) / _col(denominator))


def shrinkage(caught, hours, prior_hours: float = PRIOR_HOURS, prior_rate: float = PRIOR_RATE, min_hours: float = MIN_HOURS) -> dict[str, Column]:
    """Posterior rate, raw score, confidence and shrunk score of a catch count over hours."""
    n, h = _col(caught).cast("double"), _col(hours).cast("double")
    enough = h >= min_hours
    posterior = F.when(enough, (n + prior_rate * prior_hours) / (h + prior_hours)).otherwise(F.lit(prior_rate))
    raw = F.when(enough, clamp01(0.5 + 0.5 * F.tanh((posterior - prior_rate) / prior_rate))).otherwise(F.lit(0.5))
    confidence = F.when(enough, h / (h + prior_hours)).otherwise(F.lit(0.0))
    return {"posterior": posterior, "raw_score": raw, "confidence": confidence, "score": 0.5 + confidence * (raw - 0.5)}


def blend(own, own_hours, general, prior_hours: float = PRIOR_HOURS) -> Column:
    """A user's own value and the general one, weighted by the user's hours."""
    weight = _col(own_hours) / (_col(own_hours) + F.lit(max(1e-4, prior_hours)))
    return weight * _col(own) + (1 - weight) * _col(general)


def attribution_confidence(elapsed_s, window_s) -> Column:
    """1 falling to 0.3 over the first window, to 0 over the second."""
    r = _col(elapsed_s) / _col(window_s)
    return F.when(r <= 1, 1 - DECAY_WITHIN * r).when(r <= 2, DECAY_AFTER * (2 - r)).otherwise(F.lit(0.0))


def season(month) -> Column:
    m = _col(month)
    return F.when(m.isin(3, 4, 5), "SPRING").when(m.isin(6, 7, 8), "SUMMER").when(m.isin(9, 10, 11), "FALL").otherwise("WINTER")


#: Local hours at which a time bucket begins, and its name; the night runs over midnight.
TIME_BUCKETS = ((0, "NIGHT"), (5, "DAWN"), (7, "MORNING"), (11, "MIDDAY"), (14, "AFTERNOON"), (17, "EVENING"), (20, "NIGHT"))


def time_bucket(hour) -> Column:
    out = F.lit(TIME_BUCKETS[0][1])
    for start, name in TIME_BUCKETS[1:]:
        out = F.when(_col(hour) >= start, F.lit(name)).otherwise(out)
    return out


def wind_bucket(kph) -> Column:
    """Null for an unknown wind."""
    w = _col(kph)
    return F.when(w < 10, "CALM").when(w < 25, "MODERATE").when(w.isNotNull(), "STRONG")


def depth_match(depth, least, most, falloff: float) -> Column:
    """1 inside the range, falling linearly outside it, 0.5 for an unknown depth."""
    d = _col(depth)
    outside = F.greatest(_col(least) - d, d - _col(most), F.lit(0.0))
    return F.when(d.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), 1 - outside / falloff))


def preference_confidence(n, age_days, half_life_days: float) -> Column:
    """Evidence count saturating at 1, halved with age; three decimals."""
    return F.round((1 - F.exp(-_col(n) / 3.0)) * F.exp(-math.log(2) * _col(age_days) / half_life_days), 3)


def wind_effect(wind_from, shore_facing, weight) -> Column:
    """Windward, leeward or crosswind by the angle between wind and shore; unknown gives 0."""
    d = F.abs(F.pmod(_col(wind_from) - _col(shore_facing) + 540, F.lit(360.0)) - 180)
    effect = F.when(d <= 45, F.lit(-0.35)).when(d >= 135, F.lit(0.6)).otherwise(F.lit(0.15))
    return F.coalesce(effect * _col(weight), F.lit(0.0))


def linear_penalty(x, start: float, full: float) -> Column:
    """0 up to ``start``, 1 from ``full`` on."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_col(x) - start) / (full - start)))


def temperature_effect(celsius, weight) -> Column:
    """Twice the distance of comfort from one half; comfort falls with the distance from 18 degrees."""
    comfort = 1 - F.least(F.lit(1.0), F.abs(_col(celsius) - 18) / 20)
    return (comfort - 0.5) * 2 * _col(weight)


def solar_influence(elevation_deg, radiation, cloud_pct, low: float = 50.0, high: float = 600.0) -> Column:
    """Sunlight in [0, 1]: measured radiation, else clear sky, else half, times the sine of the elevation."""
    e = _col(elevation_deg)
    height = F.sin(F.radians(e))
    # least and greatest skip null, so an unknown radiation must be kept out of them.
    measured = F.when(_col(radiation).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (_col(radiation) - low) / (high - low))))
    clear = 1 - _col(cloud_pct) / 100
    return F.when(e <= 0, F.lit(0.0)).otherwise(F.coalesce(measured, clear, F.lit(0.5)) * height)


def canonical_sha256(*columns) -> Column:
    """SHA-256 of the values joined by bars, null written out."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(_col(c).cast("string"), F.lit("null")) for c in columns]), 256)


def uuid3(text) -> Column:
    """Name-based UUID, version 3, of a text without a namespace."""
    m = F.md5(_col(text))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(m, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.lit("3"), F.substring(m, 14, 3)), F.concat(variant, F.substring(m, 18, 3)), F.substring(m, 21, 12))


def sun_elevation(days_since_1970, utc_hours, lon, lat) -> Column:
    """Degrees of the sun above the horizon, by mean declination and hour angle."""
    year = _col(days_since_1970) - 19_723  # days since the start of 2024
    declination = F.radians(23.44 * F.sin(2 * math.pi * (F.floor(year) + 1 - 81) / 365.0))
    hour_angle = F.radians(15 * (_col(utc_hours) + _col(lon) / 15.0 - 12))
    phi = F.radians(_col(lat))
    return F.degrees(F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)))
