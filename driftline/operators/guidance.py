"""Rules of plans and decisions as column expressions, with one verdict each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order in which a stop's rules are asked.
PLAN_RULES = ("MISSING_IDENTITY", "NOT_IN_WATER", "SNAPSHOT_MISMATCH", "SCORE_RANGE", "REGULATION", "OUTSIDE_WINDOW", "OVERLAPPING_STAY", "DWELL_MISMATCH", "UNORDERED_TIMES")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plan_verdicts(stops: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """(plan_id, verdict): the first failing rule of the first failing stop, or VALID.

    ``stops``: (plan_id, stop, identity, in_water, same_snapshot, score,
    closed, arrives, departs, stay).
    """
    w = Window.partitionBy("plan_id").orderBy("stop")
    arrives, departs = F.col("arrives"), F.col("departs")
    fails = {
        "MISSING_IDENTITY": F.col("identity").isNull(),
        "NOT_IN_WATER": ~F.col("in_water"),
        "SNAPSHOT_MISMATCH": ~F.col("same_snapshot"),
        "SCORE_RANGE": (F.col("score") < 0) | (F.col("score") > 1),
        "REGULATION": F.col("closed"),
        "OUTSIDE_WINDOW": (arrives < opens) | (departs > closes),
        "OVERLAPPING_STAY": departs <= arrives,
        "DWELL_MISMATCH": departs - arrives != F.col("stay"),
        "UNORDERED_TIMES": arrives < F.lag("departs").over(w),
    }
    code = F.coalesce(*[F.when(fails[rule], F.lit(rule)) for rule in PLAN_RULES])
    coded = stops.withColumn("code", code)
    return coded.groupBy("plan_id").agg(F.coalesce(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("stop"))), F.lit("VALID")).alias("verdict"))


def _check(fails: Column, unknown: Column | None = None, applies: Column | None = None) -> Column:
    """NOT_APPLICABLE before UNKNOWN before FAIL before PASS."""
    out = F.when(F.coalesce(fails, F.lit(False)), "FAIL").otherwise("PASS")
    if unknown is not None:
        out = F.when(F.coalesce(unknown, F.lit(False)), "UNKNOWN").otherwise(out)
    return out if applies is None else F.when(F.coalesce(applies, F.lit(False)), out).otherwise("NOT_APPLICABLE")


def decision_checks(max_accuracy: float = 60, max_wind: float = 100, reserve_m: float = 3000, metres_a_minute: float = 200, cooldown_s: int = 3600) -> dict[str, Column]:
    """The sixteen checks of a decision by its columns.

    action, moves, compatible, horizon, found, navigable, consistent,
    in_session, on_lake, accuracy, metres, range_m, minutes_left, wind, closed,
    since, last_action, action_before; null is unknown.
    """
    c = F.col
    moves = c("moves")
    there = moves & c("found")
    far = c("metres").isNull()
    return {
        "SCHEMA_INVALID": _check(c("action").isNull()),
        "ACTION_INCOMPATIBLE": _check(~c("compatible")),
        "HORIZON_COMMIT_INVALID": _check((c("horizon") < 2) | (c("horizon") > 97)),
        "WAYPOINT_NOT_FOUND": _check(~c("found"), applies=moves),
        "WAYPOINT_NOT_NAVIGABLE": _check(~c("navigable"), c("navigable").isNull(), moves),
        "WAYPOINT_ID_INCONSISTENT": _check(~c("consistent"), c("consistent").isNull(), moves),
        "WAYPOINT_NOT_IN_SESSION": _check(~c("in_session"), applies=there),
        "WAYPOINT_NOT_ON_LAKE": _check(~c("on_lake"), applies=there),
        "GPS_ACCURACY_UNACCEPTABLE": _check(c("accuracy") > max_accuracy, c("accuracy").isNull(), moves),
        "INSUFFICIENT_REMAINING_RANGE": _check(c("metres") > c("range_m"), far, moves),
        "INSUFFICIENT_RETURN_RESERVE": _check(c("metres") + reserve_m > c("range_m"), far, moves),
        "INSUFFICIENT_REMAINING_TIME": _check(c("metres") / metres_a_minute > c("minutes_left"), far, moves),
        "WEATHER_UNSAFE": _check(c("wind") > max_wind, c("wind").isNull()),
        "NO_FISHING_ZONE": _check(c("closed"), applies=moves),
        "OPPORTUNITY_IN_COOLDOWN": _check(c("since") < cooldown_s, applies=moves & c("since").isNotNull()),
        "MOVE_OSCILLATION": _check((c("action_before") == c("action")) & (c("last_action") != c("action")), applies=moves & c("action_before").isNotNull()),
    }


# Minutes that a place rests, and seconds of a stay that counts.
COOLDOWN_MINUTES = {"POINT": 45, "PATH": 45, "ZONE": 60}
MEANINGFUL_DWELL_S = 120


def cooldown_until(kind, departed, dwell) -> Column:
    minutes = F.element_at(F.create_map(*[F.lit(x) for pair in COOLDOWN_MINUTES.items() for x in pair]), _col(kind))
    return F.when(_col(dwell) >= MEANINGFUL_DWELL_S, _col(departed) + minutes * 60)


def route_gain(utility, entry, metres, crosses, minutes, wait) -> Column:
    """Decayed utility and nearness, less a crossing of land, minutes on the way and the wait."""
    near = 0.12 * (1 - F.least(F.lit(1.0), _col(metres) / 4000))
    return _col(utility) * F.pow(F.lit(0.9), _col(entry) - 1) + near - F.when(_col(crosses), 0.15).otherwise(0.0) - 0.04 * F.least(F.lit(1.0), _col(minutes) / 30.0) - _col(wait)


def case_score(simulation, broken, other_action, forbidden, action, allowed, exact, rubric: list[tuple[Column, float]], least: float) -> Column:
    """PASS, SKIP, ERROR, UNSCORABLE, or FAIL with what failed first; null ``allowed`` and ``exact`` ask for nothing."""
    reached = reduce(lambda a, b: a + b, [F.when(met, w).otherwise(0.0) for met, w in rubric])
    not_allowed = F.coalesce(~F.array_contains(_col(allowed), _col(action)), F.lit(False))
    return (
        F.when(_col(simulation), "SKIP").when(_col(broken), "ERROR").when(_col(other_action), "UNSCORABLE").when(_col(forbidden), "FAIL:FORBIDDEN").when(not_allowed, "FAIL:NOT_ALLOWED")
        .when(_col(exact).isNotNull() & (_col(exact) != _col(action)), "FAIL:NOT_EXACT").when(F.round(reached, 9) < least, "FAIL:RUBRIC").otherwise("PASS")
    )
