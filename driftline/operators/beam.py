"""Route choice: a layered search for many trips at once, with dominated states dropped and a bounded beam for each trip.

The search runs over whole routes, or window by window: the first stops of the
best route of a few layers are settled and the next window starts behind them.
Forecasts by hour change what a stop is worth while a trip is there, and refuse
ways under too much wind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators.lineage import written


@dataclass(frozen=True)
class Plan:
    """Limits and costs of a route; lengths in metres, times in seconds, values in thousandths."""

    max_stops: int = 3
    min_stops: int = 1
    width: int = 6
    speed: int = 5
    max_leg: int = 2_000
    max_range: int = 6_000
    spacing: int = 150
    dwells: tuple[int, ...] = (900, 2400)
    waits: tuple[int, ...] = (0, 600)
    max_wait: int = 900
    #: Dwell after which half of a spot's value is had, and what a minute's wait and a hundred metres cost.
    half: int = 1_800
    wait_cost: int = 3
    leg_cost: int = 5


@dataclass(frozen=True)
class Weather:
    """What forecasts do to a route: winds in tenths of kilometres an hour, light and worth in thousandths, times in seconds."""

    #: A stop loses worth from the soft wind on, all of a thousand at the hard one, under which no way is taken.
    soft_wind: int = 200
    hard_wind: int = 400
    slot: int = 900
    #: Of a slot's worth the next one has so many hundredths; worths lie between 0 and ``most``.
    decay: int = 85
    most: int = 1_500

    def shares(self, longest: int) -> list[int]:
        """What each slot of a stay counts, in thousandths."""
        return [1000 * self.decay**i // 100**i for i in range(-(-longest // self.slot))]


#: Why a stop is refused, in the order in which it is asked.
REASONS = ("VISITED", "WAITED_TOO_LONG", "SPACING", "LEG_TOO_LONG", "AFTER_END", "RETURN_RESERVE", "RANGE_EXCEEDED", "WIND")
#: A trip's state; each of its stops holds the state behind it.
_AFTER = "path", "x", "y", "time", "used", "waited", "value"
_STATE = "trip", "stops", *_AFTER


def _metres(x: Column, y: Column, u: Column, v: Column) -> Column:
    # Half a metre is rounded up; ``round`` would go through a decimal text for each length.
    return F.floor(F.hypot(x - u, y - v) + 0.5)


def by_area(hours: DataFrame) -> DataFrame:
    """(area, forecast): the spans (until, at, length, wind, wind_rise, light, light_rise) of each area's hours (area, at, wind, light) in one row, which a forecast's length bounds.

    A span goes on from its hour until the next one; before the first hour and
    after the last one the nearest counts. Of two rows of one hour the greater
    one ends what is before, and starts what is behind it.
    """
    given = hours.filter("at IS NOT NULL").groupBy("area").agg(F.array_sort(F.collect_list(F.struct("at", "wind", "light"))).alias("given"))

    def span(i: Column) -> Column:
        last = F.size("given")
        low, high = F.get("given", F.greatest(i - 1, F.lit(0))), F.get("given", F.least(i, last - 1))
        until = F.when(i < last, high["at"]).otherwise(F.lit(2**63 - 1))
        fields = [c for f in ("wind", "light") for c in (low[f].alias(f), (high[f] - low[f]).alias(f"{f}_rise"))]
        return F.struct(until.alias("until"), low["at"].alias("at"), F.greatest(high["at"] - low["at"], F.lit(1)).alias("length"), *fields)

    return given.select("area", F.transform(F.sequence(F.lit(0), F.size("given")), span).alias("forecast"))


def forecast_at(forecast: Column, time: Column) -> Column:
    """(wind, light) at a time, on the line through the hours around it, out of the spans of :func:`by_area`."""
    on_line = lambda s, field: (s[field] + F.floor(s[f"{field}_rise"] * (time - s["at"]) / s["length"])).alias(field)
    around = F.slice(F.filter(forecast, lambda s: s["until"] > time), 1, 1)
    return F.get(F.transform(around, lambda s: F.struct(on_line(s, "wind"), on_line(s, "light"))), 0)


def expanded(states: DataFrame, trips: DataFrame, options: DataFrame, plan: Plan, forecasts: DataFrame | None = None, weather: Weather = Weather()) -> DataFrame:
    """Each state with each option, wait and dwell: the state that it leads to, and ``reason`` if it is refused.

    ``options`` join by area and are few for each, as states are of a trip, so
    the rows are bounded for each trip. They stay dealt by area, which what is
    counted and chosen of them keeps in its keys: no step moves again. What a
    wait or a dwell does not change is known before rows are made for them.
    With ``forecasts`` of :func:`by_area` the options say by ``likes`` (-1, 0 or
    1) whether light adds to their worth; where there is no forecast, or no
    value in it, neither wind nor light counts.
    """
    rows = states.join(trips.select("trip", "area", "end", "reserve", F.col("x").alias("home_x"), F.col("y").alias("home_y")), "trip")
    # A fixed number, for steps are many times the states that partitions are sized by.
    rows = rows.repartition(int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), "area")
    if forecasts is not None:
        rows = rows.join(forecasts, "area", "left")
    likes = ["likes"] if forecasts is not None else []
    rows = rows.join(options.select("area", "option", F.col("x").alias("to_x"), F.col("y").alias("to_y"), "worth", *likes), "area")
    leg = _metres(F.col("x"), F.col("y"), F.col("to_x"), F.col("to_y"))
    home = _metres(F.col("to_x"), F.col("to_y"), F.col("home_x"), F.col("home_y"))
    been = F.exists("stops", lambda s: s["option"] == F.col("option"))
    near = F.exists("stops", lambda s: _metres(s["x"], s["y"], F.col("to_x"), F.col("to_y")) < plan.spacing)
    rows = rows.withColumns({"leg": leg, "home": home, "been": been, "near": near})
    rows = rows.withColumns({"there": F.floor(F.col("leg") / plan.speed), "back": F.floor(F.col("home") / plan.speed)})

    def tests(wait: Column, dwell: Column) -> list[Column]:
        leave = F.col("time") + wait + F.col("there") + dwell
        return [
            F.col("been"), F.col("waited") + wait > plan.max_wait, F.col("near"), F.col("leg") > plan.max_leg, leave > F.col("end"),
            leave + F.col("back") + F.col("reserve") > F.col("end"), F.col("used") + F.col("leg") + F.col("home") > plan.max_range,
        ]

    # Rows made by a generator hold what it looked up, which a projection would look up again for each of its uses.
    if forecasts is None:
        rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(w).alias("wait"), F.lit(d).alias("dwell")) for w in plan.waits for d in plan.dwells])))
    else:
        slots = list(enumerate(weather.shares(max(plan.dwells))))

        def waited(wait: int) -> Column:
            depart = F.col("time") + wait
            arrive = depart + F.col("there")
            # What is refused however short the stay is asks no forecast.
            asked = F.when(~reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests(F.lit(wait), F.lit(min(plan.dwells)))]), F.col("forecast"))
            times = {"depart": depart, "midway": F.floor((depart + arrive) / 2)} | {f"slot_{i}": arrive + i * weather.slot for i, _ in slots}
            return F.struct(F.lit(wait).alias("wait"), *[forecast_at(asked, time).alias(name) for name, time in times.items()])

        rows = rows.select("*", F.inline(F.array(*map(waited, plan.waits)))).drop("forecast")
        rows = rows.withColumn("dwell", F.explode(F.array(*map(F.lit, plan.dwells))))
    reason = reduce(lambda chain, t: chain.when(t[1], t[0]), list(zip(REASONS, tests(F.col("wait"), F.col("dwell")))), F)
    rows = rows.withColumn("reason", reason)
    if forecasts is None:
        had = F.floor(F.col("worth") * F.col("dwell") / (F.col("dwell") + plan.half))
    else:
        windy = F.greatest(F.col("depart.wind"), F.col("midway.wind"), F.col("slot_0.wind")) >= weather.hard_wind
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(windy, "WIND")))

        def worth(slot: int, share: int) -> Column:
            blown = F.floor((F.col(f"slot_{slot}.wind") - weather.soft_wind) * 1000 / (weather.hard_wind - weather.soft_wind))
            lit = F.coalesce("likes", F.lit(0)) * F.coalesce(f"slot_{slot}.light", F.lit(0))
            own = F.col("worth") + lit - F.coalesce(F.least(F.lit(1000), F.greatest(F.lit(0), blown)), F.lit(0))
            own = F.floor(F.least(F.lit(weather.most), F.greatest(F.lit(0), own)) * share / 1000)
            return F.when(F.col("dwell") > slot * weather.slot, own).otherwise(F.lit(0))

        had = reduce(Column.__add__, [worth(*slot) for slot in slots])
    gain = had - F.floor(F.col("leg") * plan.leg_cost / 100) - F.floor(F.col("wait") * plan.wait_cost / 60)
    step = F.concat_ws(":", "option", "wait", "dwell")
    made = rows.select(
        "area", "trip", "stops", "option", F.concat_ws(">", "path", step).alias("path"), F.col("to_x").alias("x"), F.col("to_y").alias("y"),
        (F.col("time") + F.col("wait") + F.col("there") + F.col("dwell")).alias("time"), (F.col("used") + F.col("leg")).alias("used"), (F.col("waited") + F.col("wait")).alias("waited"), (F.col("value") + gain).alias("value"), "reason",
    )
    return made.withColumn("stops", F.concat("stops", F.array(F.struct("option", *_AFTER)))).drop("option")


def undominated(states: DataFrame) -> DataFrame:
    """(area, trip, reached, best): of each set of a trip's stops and last stop, how many states there are, and those that no other is as early, as short and as good as, and better in one."""
    own = F.struct(*_STATE)
    alike = states.groupBy("area", "trip", F.sort_array(F.transform("stops", lambda s: s["option"])).alias("_among"), "x", "y").agg(F.collect_list(own).alias("_all"))
    no_worse = lambda a, b: (a["time"] <= b["time"]) & (a["used"] <= b["used"]) & (a["value"] >= b["value"])
    better = lambda a, b: (a["time"] < b["time"]) | (a["used"] < b["used"]) | (a["value"] > b["value"])
    left = F.filter("_all", lambda b: ~F.exists("_all", lambda a: no_worse(a, b) & better(a, b)))
    return alike.select("area", "trip", F.size("_all").alias("reached"), left.alias("best"))


#: Best first; the path settles what is left.
ORDER = (("value", False), ("time", True), ("used", True), ("path", True))


def _by(*columns: tuple[str, bool]) -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in columns]


@dataclass(frozen=True)
class Search:
    """What a search found: the best route of each trip, counts of each layer, and refused steps by layer and reason."""

    routes: DataFrame
    layers: DataFrame
    rejects: DataFrame


def _start(trips: DataFrame) -> DataFrame:
    nothing = F.expr("cast(array() as array<struct<option: bigint, path: string, x: bigint, y: bigint, time: bigint, used: bigint, waited: bigint, value: bigint>>)")
    zero = F.lit(0).cast("long")
    return trips.select("trip", nothing.alias("stops"), F.lit(None).cast("string").alias("path"), "x", "y", F.col("start").alias("time"), zero.alias("used"), zero.alias("waited"), zero.alias("value"))


def _first(states: DataFrame, n: int) -> DataFrame:
    """The best states of each trip."""
    return states.withColumn("_place", F.row_number().over(Window.partitionBy("trip").orderBy(*_by(*ORDER)))).filter(F.col("_place") <= n).select(*_STATE)


def _beam(fine: DataFrame, width: int) -> DataFrame:
    """(trip, reached, left, states): counts of a layer, and the states that the beam keeps, a row a trip."""
    per_set = undominated(fine)
    rank = F.struct((-F.col("s.value")).alias("value"), "s.time", "s.used", "s.path")
    counts = Window.partitionBy("area", "trip")
    ranked = per_set.withColumns({"reached": F.sum("reached").over(counts), "left": F.sum(F.size("best")).over(counts)}).select("area", "trip", "reached", "left", F.explode("best").alias("s"))
    kept = ranked.withColumn("_place", F.row_number().over(counts.orderBy(rank))).filter(F.col("_place") <= width)
    return kept.groupBy("area", "trip").agg(F.first("reached").alias("reached"), F.first("left").alias("left"), F.collect_list("s").alias("states")).drop("area")


def _states(layer: DataFrame) -> DataFrame:
    return layer.select(F.explode("states").alias("s")).select("s.*")


def _union(them: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, them)


def _routes(trips: DataFrame, found: DataFrame) -> DataFrame:
    """The best state of each trip, and nulls and no stops for a trip without one."""
    return trips.select("trip").join(_first(found, 1), "trip", "left").select("trip", "path", F.coalesce(F.size("stops"), F.lit(0)).cast("long").alias("stops"), "time", "used", "value")


def search(trips: DataFrame, options: DataFrame, plan: Plan, hours: DataFrame | None = None, weather: Weather = Weather()) -> Search:
    """Routes for ``trips`` (trip, area, x, y, start, end, reserve) over ``options`` (area, option, x, y, worth).

    A layer adds a stop to every state of every trip in one job, drops what is
    dominated, and keeps the best ``width`` of each trip. States with enough
    stops are complete; the best of all layers is the route. ``hours`` are the
    forecasts (area, at, wind, light) that :func:`expanded` asks.
    """
    forecasts = hours if hours is None else by_area(hours)
    states = _start(trips)
    layers, rejects, done = [], [], []
    for layer in range(1, plan.max_stops + 1):
        # Steps are many times the states that stay, so they are made again for their counts by reason, not stored.
        steps = expanded(states, trips, options, plan, forecasts, weather)
        refused = steps.filter("reason IS NOT NULL").groupBy("area", "trip", "reason").agg(F.count("*").alias("n"))
        rejects.append(refused.withColumn("layer", F.lit(layer)))
        found = written(_beam(steps.filter("reason IS NULL"), plan.width))
        layers.append(found.select("trip", "reached", "left", F.size("states").cast("long").alias("kept"), F.lit(layer).alias("layer")))
        states = _states(found)
        if layer >= plan.min_stops:
            done.append(states)
        if states.isEmpty():
            break
    best = _union(done) if done else states.limit(0)
    return Search(_routes(trips, best), _union(layers).select("trip", "layer", "reached", "left", "kept"), _union(rejects).select("trip", "layer", "reason", "n"))


def rolling(trips: DataFrame, options: DataFrame, plan: Plan, ahead: int = 2, settle: int = 1, hours: DataFrame | None = None, weather: Weather = Weather()) -> DataFrame:
    """Routes of :func:`search`'s form, ``settle`` stops at a time by a look ``ahead`` of so many layers.

    Every window starts with one state a trip, so its layers hold at most
    ``width`` states for each, however long the routes are. The best settled
    state with enough stops is the route; a trip ends where no step is left.
    """
    if ahead < settle or settle < 1:
        raise ValueError("a window must look at least as far ahead as it settles, and settle a stop")
    forecasts = hours if hours is None else by_area(hours)
    settled, done = _start(trips), []
    for before in range(0, plan.max_stops, settle):
        states, window = settled, []
        for _ in range(min(ahead, plan.max_stops - before)):
            fine = expanded(states, trips, options, plan, forecasts, weather).filter("reason IS NULL")
            states = _states(written(_beam(fine, plan.width)))
            window.append(states)
        kept = F.slice("stops", 1, before + settle)
        best = _first(_union(window), 1).select("trip", kept.alias("stops")).withColumn("_end", F.element_at("stops", -1))
        settled = written(best.select("trip", "stops", *[F.col("_end")[c].alias(c) for c in _AFTER]))
        if settled.isEmpty():
            break
        done.append(settled.filter(F.size("stops") >= plan.min_stops))
    return _routes(trips, _union(done) if done else settled)
