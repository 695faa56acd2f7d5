"""Outcomes attributed to decisions, and rates of followed guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scores import attribution_confidence
from driftline.operators.relational import first_per_key
from driftline.operators.temporal import interval_buckets

# Ranks of outcomes; the catches share the highest.
OUTCOME_RANK = {"NONE": 0, "NO_BITE": 1, "BITE": 2, "FISH_ON": 3, "CATCH_LANDED": 4, "CATCH_LOST": 4}
SUCCESS = ("FISH_ON", "CATCH_LANDED", "CATCH_LOST")


def outcome_rank(kind) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(0)
    for name, rank in OUTCOME_RANK.items():
        out = F.when(kind == name, F.lit(rank)).otherwise(out)
    return out


def decision_windows(decisions: DataFrame, length_s: str) -> DataFrame:
    """``opens`` and ``closes`` of each decision: its length, or the next followed decision of its session and dimension."""
    followed_at = F.when(F.col("followed"), F.col("at"))
    later = Window.partitionBy("session_id", "dimension").orderBy("at", "decision_id").rowsBetween(1, Window.unboundedFollowing)
    return decisions.withColumn("opens", F.col("at")).withColumn("closes", F.least(F.col("at") + F.col(length_s), F.min(followed_at).over(later)))


def attribute(windows: DataFrame, signals: DataFrame, length_s: str, width: int = 3600) -> DataFrame:
    """The best outcome of each decision and interaction, both ends of the window included.

    ``signals``: (session_id, signal_id, interaction_id, kind, at). Of outcomes
    the highest rank counts, then the latest. Followed decisions without a
    success are given NO_BITE at the end of their window.
    """
    w = interval_buckets(windows.withColumn("_end", F.col("closes") + 1), "opens", "_end", width).drop("_end")
    s = signals.select(F.col("session_id"), "interaction_id", F.col("kind").alias("outcome"), F.col("at").alias("signal_at"), "signal_id").withColumn("_bucket", F.floor(F.col("signal_at") / width))
    met = w.join(s, ["session_id", "_bucket"]).filter((F.col("signal_at") >= F.col("opens")) & (F.col("signal_at") <= F.col("closes")) & ((F.col("outcome") != "BITE") | F.col("interaction_id").isNotNull()))
    best = first_per_key(met.withColumn("rank", outcome_rank("outcome")), ["decision_id", "dimension", "interaction_id"], F.desc("rank"), F.desc("signal_at"), F.desc("signal_id"))
    found = best.select("session_id", "decision_id", "dimension", "followed", "interaction_id", "outcome", attribution_confidence(F.col("signal_at") - F.col("opens"), length_s).alias("confidence"))
    won = found.filter(F.col("outcome").isin(*SUCCESS)).select("decision_id", "dimension").distinct()
    none = windows.filter("followed").join(won, ["decision_id", "dimension"], "left_anti")
    return found.unionByName(none.select("session_id", "decision_id", "dimension", "followed", F.lit(None).cast("long").alias("interaction_id"), F.lit("NO_BITE").alias("outcome"), F.lit(1.0).alias("confidence")))


def success_kind(decision, followed, outcome) -> Column:
    d, f, o = (F.col(x) if isinstance(x, str) else x for x in (decision, followed, outcome))
    return F.when(d.isNull(), "UNATTRIBUTED").when(~F.coalesce(f, F.lit(False)), "NOT_FOLLOWED").when(o.isin(*SUCCESS), "FISH_ON_SUCCESS").when(o == "BITE", "BITE_SIGNAL_ONLY").otherwise("NO_FISH_SIGNAL")


def merged_outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: followed by any, and the outcome of highest rank, then latest, then greatest id."""
    return rows.groupBy(*keys).agg(F.bool_or("followed").alias("followed"), F.max_by("outcome", F.struct(outcome_rank("outcome"), F.col("at"), F.col("id"))).alias("outcome"))


def override_flags(feedback: DataFrame, follows: DataFrame) -> DataFrame:
    """(decision_id, overridden): accepted but not followed, or not accepted and something else done."""
    acts = follows.filter("decision_id IS NOT NULL").groupBy("decision_id").agg(F.bool_or("followed").alias("any_followed"), F.bool_or("other").alias("any_other"))
    both = feedback.join(acts, "decision_id", "full")
    accepted, followed, other = F.coalesce(F.col("status") == "ACCEPTED", F.lit(False)), F.coalesce("any_followed", F.lit(False)), F.coalesce("any_other", F.lit(False))
    return both.select("decision_id", ((accepted & ~followed) | (~accepted & other)).alias("overridden"))
