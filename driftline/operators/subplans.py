"""Visits inside zones: members packed greedily under a budget of minutes, each step from where the last one ended."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Visit:
    """Budgets in minutes, metres a minute between members, the longest and shortest dwell, and what a minute of transit costs, in thousandths."""

    budgets: tuple[int, ...] = (30, 60, 90)
    pace: int = 60
    # Fixed values.
    longest: int = 20
    shortest: int = 8
    hop_cost: int = 20


_STATE = "struct<x: bigint, y: bigint, left: bigint, fishing: bigint, transit: bigint, metres: bigint, utility: bigint, stops: array<bigint>>"


def _metres(a: Column, b: Column) -> Column:
    return F.round(F.hypot(a["x"] - b["x"], a["y"] - b["y"])).cast("long")


def _minutes(metres: Column, pace: int) -> Column:
    return F.round(metres / pace).cast("long")


def _step(members: Column, visit: Visit):
    """The state after the best member of those left, or the same state if none fits."""

    def run(state: Column, _: Column) -> Column:
        def offer(m: Column) -> Column:
            metres = _metres(state, m)
            hop = F.greatest(F.lit(1).cast("long"), _minutes(metres, visit.pace))
            dwell = F.least(F.lit(visit.longest).cast("long"), state["left"] - hop)
            score = F.floor(m["worth"] * dwell / visit.longest) - visit.hop_cost * hop
            # the greatest of these is the best score, and of equals the first member
            return F.struct(score.alias("score"), (-m["place"]).alias("place"), hop.alias("hop"), dwell.alias("dwell"), metres.alias("metres"), m.alias("m"))

        fits = lambda o: (o["dwell"] >= visit.shortest) & ~F.array_contains(state["stops"], o["m"]["member"])
        best = F.array_max(F.filter(F.transform(members, offer), fits))
        new = F.struct(
            best["m"]["x"].alias("x"), best["m"]["y"].alias("y"), (state["left"] - best["hop"] - best["dwell"]).alias("left"), (state["fishing"] + best["dwell"]).alias("fishing"), (state["transit"] + best["hop"]).alias("transit"),
            (state["metres"] + best["metres"]).alias("metres"), (state["utility"] + F.greatest(F.lit(0).cast("long"), best["score"])).alias("utility"), F.concat(state["stops"], F.array(best["m"]["member"])).alias("stops"),
        ).cast(_STATE)
        return F.when(best.isNull(), state).otherwise(new)

    return run


def packages(zones: DataFrame, visit: Visit = Visit()) -> DataFrame:
    """(zone, budget, stops, fishing, transit, metres, utility) of what each budget buys in a zone, without what a smaller budget beats.

    ``zones``: zone, entry and exit struct<x, y>, members array<struct<member,
    x, y, worth>> in the order that ties are settled by. A package must leave
    time for the way to the exit. The steps of a budget are bounded by its
    shortest dwell, so they fold over a short sequence; all is one expression.
    """
    placed = F.transform("members", lambda m, i: F.struct(i.cast("long").alias("place"), m["member"].alias("member"), m["x"].alias("x"), m["y"].alias("y"), m["worth"].alias("worth")))
    rows = zones.select("zone", "entry", "exit", placed.alias("members")).withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in visit.budgets])))
    zero = F.lit(0).cast("long")
    begin = F.struct(F.col("entry.x").alias("x"), F.col("entry.y").alias("y"), F.col("budget").alias("left"), zero.alias("fishing"), zero.alias("transit"), zero.alias("metres"), zero.alias("utility"), F.array().cast("array<bigint>").alias("stops")).cast(_STATE)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1).cast("long"), F.floor(F.col("budget") / (visit.shortest + 1))))
    rows = rows.withColumn("s", F.aggregate(steps, begin, _step(F.col("members"), visit)))
    way = _metres(F.col("s"), F.col("exit"))
    done = rows.withColumns({"way": way, "out": _minutes(way, visit.pace)}).filter((F.col("out") <= F.col("s.left")) & (F.col("s.fishing") > 0))
    made = done.select("zone", "budget", F.col("s.stops").alias("stops"), F.col("s.fishing").alias("fishing"), (F.col("s.transit") + F.col("out")).alias("transit"), (F.col("s.metres") + F.col("way")).alias("metres"), F.col("s.utility").alias("utility"))
    whole = F.struct(*made.columns)
    beats = lambda a, b: (a["budget"] <= b["budget"]) & (a["utility"] >= b["utility"]) & ((a["budget"] < b["budget"]) | (a["utility"] > b["utility"]))
    together = made.groupBy("zone").agg(F.collect_list(whole).alias("all"))  # one for each budget at most
    left = F.filter("all", lambda b: ~F.exists("all", lambda a: beats(a, b)))
    return together.select(F.explode(left).alias("p")).select("p.*")
