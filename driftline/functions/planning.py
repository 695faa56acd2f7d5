"""Scores, limits and choices of trip planning and guidance as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bounded(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def _lookup(key: Column, values: dict, otherwise=None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(known, key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


# Share of each kind of evidence, and scores of what is not supported.
FEATURE_WEIGHTS = {"quality": 0.20, "prominence": 0.25, "bathymetry": 0.15, "geometry": 0.15, "interpolation": 0.10, "types": 0.15}


def feature_confidence(quality, prominence, bathymetry, consistent, interpolation_m, types) -> Column:
    """Weighted evidence between 0.05 and 0.99, four decimals half up."""
    distance, p = _col(interpolation_m), _col(prominence)
    interpolation = F.when(distance.isNull(), 0.7).when(distance <= 20, 1.0).when(distance >= 250, 0.25).otherwise(1 - (distance - 20) / 230 * 0.75)
    parts = {
        "quality": _col(quality),
        "prominence": F.when(p <= 0, 0.2).otherwise(F.least(F.lit(1.0), p)),
        "bathymetry": F.when(_col(bathymetry), 1.0).otherwise(0.35),
        "geometry": F.when(_col(consistent), 1.0).otherwise(0.4),
        "interpolation": interpolation,
        "types": F.least(F.lit(1.0), _col(types) / F.lit(3.0)),
    }
    total = reduce(lambda a, b: a + b, (w * parts[k] for k, w in FEATURE_WEIGHTS.items()))
    return F.round(_bounded(total, 0.05, 0.99), 4)


# Gear that serves a technique; techniques not named need none.
GEAR_OF = {
    "NED_RIG": ["BAIT"],
    "DROP_SHOT": ["BAIT"],
    "TEXAS_RIG": ["BAIT"],
    "TUBE": ["BAIT"],
    "JIG": ["BAIT"],
    "LIVE_BAIT": ["BAIT"],
    "TROLLING": ["ROD", "ELECTRONICS"],
    "OTHER": ["ROD"],
}


def gear_compatibility(techniques, gear) -> Column:
    """1 where some gear serves some technique; 0.75 for a rod, 0.5 where either side says nothing, else 0.4. Lures don't count."""
    own = F.filter(F.coalesce(_col(gear), F.array().cast("array<string>")), lambda g: g != "LURE")
    asked = F.coalesce(_col(techniques), F.array().cast("array<string>"))
    served = F.flatten(F.transform(asked, lambda t: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in GEAR_OF.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), t), F.array().cast("array<string>"))))
    rod = F.array_contains(own, "ROD")
    return F.when(F.size(own) == 0, 0.5).when(F.size(asked) == 0, F.when(rod, 0.75).otherwise(0.5)).when(F.arrays_overlap(served, own), 1.0).when(rod, 0.75).otherwise(0.4)


# How sure an orientation is.
ORIENTATION_SCALE = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}


def solar_exposure(sun_azimuth, sun_elevation, facing, confidence, strength) -> Column:
    """Sun on a face, 0 to 1: by its angle to the sun where that is known, else half the strength."""
    s = _col(strength)
    delta = F.abs(F.pmod(_col(sun_azimuth) - _col(facing) + 540, F.lit(360.0)) - 180)
    scale = _lookup(_col(confidence), ORIENTATION_SCALE)
    known = _bounded((1 - delta / 180) * s * scale, 0.0, 1.0)
    return F.when((_col(sun_elevation) <= 0) | (s <= 0), 0.0).when(_col(facing).isNull() | scale.isNull(), 0.5 * s).otherwise(known)


def solar_effect(preference, exposure, strength, weight: float) -> Column:
    """What the exposure adds for those that seek sun, shade or the edge between them."""
    e, s = _col(exposure), _col(strength)
    signed = F.when(_col(preference) == "SUN_EXPOSED", (e - 0.5) * 2).when(_col(preference) == "SHADE_PREFERRED", (0.5 - e) * 2).when(_col(preference) == "TRANSITION_PREFERRED", 1 - F.abs(e - 0.5) * 2).otherwise(0.0)
    return F.when(s > 0, _bounded(signed, -1.0, 1.0) * weight * s).otherwise(0.0)


def time_utility(intrinsic, changes: list[tuple[Column, float]], effects: list[Column], costs: list[Column]) -> Column:
    """Intrinsic score, weighted changes of its terms, effects and costs, between 0 and 1.5; NaN gives 0."""
    total = _col(intrinsic)
    for change, weight in changes:
        total = total + change * weight
    total = reduce(lambda a, b: a - b, costs, reduce(lambda a, b: a + b, effects, total))
    return F.when(F.isnan(total), 0.0).otherwise(_bounded(total, 0.0, 1.5))


# Minutes on offer, and the most and least of each kind of stop.
DWELL = {
    "ZONE": ([45, 90, 135, 180], 180, 45),
    "PATH": ([30, 45, 60, 90], 90, 30),
    "POINT": ([15, 20, 30, 45], 45, 15),
    "ISLAND_EDGE": ([15, 20, 30, 45], 45, 15),
    "FLAT": ([20, 30, 45, 60, 75, 90], 90, 45),
    "BASIN": ([20, 30, 45, 60, 75, 90], 60, 30),
    "SPOT": ([20, 30, 45, 60, 75, 90], 90, 20),
}


def dwell_options(kind, confidence, remaining) -> Column:
    """Minutes of a stop that fit: 45 at most where the confidence is poor, and one fallback where nothing fits."""
    k = F.when(_col(kind).isin(*DWELL), _col(kind)).otherwise("SPOT")
    pick = lambda i: F.element_at(F.create_map(*[x for n, v in DWELL.items() for x in (F.lit(n), F.array(*map(F.lit, v[0])) if i == 0 else F.lit(v[i]))]), k)
    unsure = (F.coalesce(_col(confidence), F.lit(0.5)) < 0.45) & (k != "ZONE")
    cap = F.when(unsure, F.least(pick(1), F.lit(45))).otherwise(pick(1))
    high, low = F.least(cap, F.greatest(F.lit(0), _col(remaining))), pick(2)
    fitting = F.filter(pick(0), lambda m: (m >= low) & (m <= high))
    fallback = F.when(high >= 8, F.array(F.least(high, F.greatest(low, F.lit(8))))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(fitting) > 0, fitting).otherwise(fallback)


def travel_minutes(metres, land_crossing, kmh, detour: float = 1.35, land_detour: float = 2.2) -> Column:
    """Minutes by distance, a detour that a land crossing makes longer, and speed."""
    factor = F.when(_col(land_crossing), land_detour).otherwise(detour)
    return _col(metres) * factor / (_col(kmh) * 1000 / 60)


# What the state of weather, structure and species adds to the base.
CONFIDENCE_BASE = 0.62
WEATHER_TERM = {"FORECAST_AVAILABLE": 0.12, "OUT_OF_FORECAST_RANGE": -0.08, "UNAVAILABLE": -0.10, "FAILED": -0.10}
PIPELINE_TERM = {"READY": 0.12, "PARTIAL": 0.04, "FAILED": -0.16, "NOT_READY": -0.16}


def system_confidence(weather, readiness, mean_confidence, limitations) -> Column:
    """Base and terms, less 0.03 for each different limitation up to 0.20; 0.05 to 0.95, four decimals."""
    codes = F.array_distinct(F.coalesce(_col(limitations), F.array().cast("array<string>")))
    has = lambda code: F.array_contains(codes, code)
    structure = _lookup(_col(readiness), PIPELINE_TERM, -0.16) + F.when(has("STRUCTURE_NONE_AFTER_ANALYSIS"), -0.10).otherwise(0.0) + F.when(has("STRUCTURE_DATA_LOW_CONFIDENCE"), -0.08).otherwise(0.0)
    mean = F.coalesce((_col(mean_confidence) - 0.5) * 0.10, F.lit(0.0))
    species = F.when(has("TARGET_SPECIES_UNCONFIRMED"), -0.08).otherwise(0.06)
    total = CONFIDENCE_BASE + _lookup(_col(weather), WEATHER_TERM, -0.10) + structure + mean + species - F.least(F.lit(0.20), F.size(codes) * 0.03)
    return F.when(total < 0.05, 0.05).when(total > 0.95, 0.95).otherwise(F.floor(total * 10_000 + 0.5) / 10_000)


def usable_range(estimated_km, reserve, reliable, comfortable_km) -> Column:
    """The boat's range less its reserve where that is reliable, and no more than what its owner finds comfortable."""
    system = F.when(_col(reliable) & (_col(estimated_km) > 0), _col(estimated_km) * (1 - _bounded(_col(reserve), 0.0, 0.9)))
    return F.least(system, F.when(_col(comfortable_km) > 0, _col(comfortable_km)))


# Dimension and minutes of the window of each action; a stay runs until its re-evaluation.
ACTION_WINDOWS = {"CHANGE_LURE": ("LURE", 15), "CHANGE_DEPTH": ("DEPTH", 15), "CHANGE_RETRIEVE": ("RETRIEVE", 10), "MOVE": ("LOCATION", 30), "STAY": ("LOCATION", None)}
MAX_STAY_MINUTES = 30


def action_dimension(action) -> Column:
    return _lookup(_col(action), {a: d for a, (d, _) in ACTION_WINDOWS.items()})


def action_window_minutes(action, reevaluate_minutes) -> Column:
    fixed = _lookup(_col(action), {a: m for a, (_, m) in ACTION_WINDOWS.items() if m})
    return F.coalesce(fixed, F.when(_col(action) == "STAY", F.least(F.greatest(_col(reevaluate_minutes), F.lit(1)), F.lit(MAX_STAY_MINUTES))), F.lit(0))


def inferred_follow(event, action, arrived, target, chosen_lure, advised_lure, chosen_retrieve, advised_retrieve, depth, depth_low, depth_high, on_waypoint) -> Column:
    """Whether an event shows that an advised action was followed; null where it shows nothing of it."""
    e, a = _col(event), _col(action)
    said = e.isin("LURE_CHANGED", "DEPTH_CHANGED", "RETRIEVE_CHANGED")
    same = lambda x, y: F.coalesce(_col(x) == _col(y), F.lit(False))
    within = F.coalesce(_col(depth).between(_col(depth_low), _col(depth_high)), F.lit(False))
    return (
        F.when(e == "ADVICE_REJECTED", False)
        .when((e == "WAYPOINT_ENTERED") & (a == "MOVE"), same(arrived, target))
        .when(e.isin("WAYPOINT_ENTERED", "WAYPOINT_LEFT") & (a == "STAY"), True)
        .when(said & (a == "CHANGE_LURE"), same(chosen_lure, advised_lure))
        .when(said & (a == "CHANGE_RETRIEVE"), same(chosen_retrieve, advised_retrieve))
        .when(said & (a == "CHANGE_DEPTH"), within)
        .when(e.isin("ADVICE_CREATED", "ADVICE_ACCEPTED") & (a == "STAY") & F.coalesce(_col(on_waypoint), F.lit(False)), True)
    )


def activity_state(override, paused, ad_hoc_open, target_status, current_status) -> dict[str, Column]:
    """State and its source: an override, a pause, an ad-hoc stop, the advised target, then the current waypoint."""
    o, t, c = map(_col, (override, target_status, current_status))
    rules = [
        (o.isNotNull() & (o != "UNKNOWN"), o, "OVERRIDE"),
        (F.coalesce(_col(paused), F.lit(False)), F.lit("PAUSED"), "SESSION_PAUSE"),
        (F.coalesce(_col(ad_hoc_open), F.lit(False)), F.lit("FISHING"), "USER_AD_HOC"),
        (t.isin("FISHING", "ARRIVED"), F.lit("FISHING"), "PROGRESS"),
        (c == "FISHING", F.lit("FISHING"), "PROGRESS"),
        (c == "NAVIGATING", F.lit("TRANSIT"), "PROGRESS"),
    ]
    state, source = F.lit("UNKNOWN"), F.lit("UNKNOWN")
    for condition, value, name in reversed(rules):
        state, source = F.when(condition, value).otherwise(state), F.when(condition, F.lit(name)).otherwise(source)
    return {"state": state, "source": source}


def no_bite_due(state, minutes, least: int = 20) -> Column:
    return F.coalesce((_col(state) == "FISHING") & (_col(minutes) >= least), F.lit(False))


def pressure(anglers) -> Column:
    """A word for how many fish near a waypoint."""
    n = _col(anglers)
    return F.when(n <= 0, "LOW").when(n <= 2, "MODERATE").otherwise("HIGH")


def accessibility(has_location, in_water, on_island, mode, shore_m, verified, shore_limit_m: float = 80.0) -> dict[str, Column]:
    """``reason`` of a rejection, and a warning where a shore spot has no verified access. No shoreline rejects nothing."""
    shore = _col(mode) == "SHORE"
    reason = F.when(~F.coalesce(_col(has_location), F.lit(False)), "INVALID_GEOMETRY").when(~F.coalesce(_col(in_water), F.lit(False)), "OUTSIDE_LAKE").when(_col(on_island), "ON_ISLAND").when(shore & (_col(shore_m) > shore_limit_m), "SHORE_INACCESSIBLE")
    return {"reason": reason, "warning": F.when(reason.isNull() & shore & ~F.coalesce(_col(verified), F.lit(False)), "SHORE_ACCESS_UNVERIFIED")}
