"""Beliefs over time: conflicts, credibility, timelines, as-of views, succession, current belief."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantity as Q
from ..sources.graph import CRITICALITY, DEAD


def live(df: DataFrame, when: Column) -> DataFrame:
    return df.where(~F.col("status").isin(*DEAD) & (F.col("valid_from") <= when) & (F.col("valid_until").isNull() | (F.col("valid_until") >= when)))


def expired(df: DataFrame, when: Column) -> DataFrame:
    return df.where(~F.col("status").isin(*DEAD) & (F.col("valid_until") < when))


def as_of(df: DataFrame, when: Column) -> DataFrame:
    """What was believed: known by then and valid then, whatever has become of it; intervals are closed on both ends."""
    return df.where((F.col("valid_from") <= when) & (F.col("valid_until").isNull() | (F.col("valid_until") >= when)))


def scored(df: DataFrame, now: Column) -> DataFrame:
    """df with its credibility as of now: authority, recency, confidence, specificity and temporal validity; no support counted."""
    open_ = F.col("valid_until").isNull() | (F.col("valid_until") >= now)
    temporal = F.when(~open_, 0.0).when(F.col("valid_until").isNotNull(), 1.0).otherwise(0.9)
    specific = F.lit(0.35) + 0.25 + F.when(F.col("valid_until").isNotNull(), 0.15).otherwise(0.0) + 0.10
    return df.withColumn("total", Q.credibility(F.col("authority"), Q.recency(F.col("valid_from"), now), F.col("confidence"), F.lit(0.0), specific, temporal))


def conflicts(df: DataFrame, now: Column) -> DataFrame:
    """Pairs of live observations of one property whose validity overlaps and whose numbers differ beyond the tolerance, and which
    side is believed. Left is the later one (by time, then id). Equi-join on the property, so a hot property splits under AQE."""
    s = scored(df.where(~F.col("status").isin(*DEAD)), now).select("id", "subject", "predicate", "number", "valid_from", F.coalesce("valid_until", F.lit("9999-12-31").cast("timestamp_ntz")).alias("valid_until"), "total")
    l, r = (s.select("subject", "predicate", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "number", "valid_from", "valid_until", "total"))) for side in ("l", "r"))
    pairs = l.join(r, ["subject", "predicate"]).where((F.struct("l_valid_from", "l_id") > F.struct("r_valid_from", "r_id")) & (F.col("l_valid_from") <= F.col("r_valid_until")) & (F.col("r_valid_from") <= F.col("l_valid_until")))
    delta = Q.relative_delta(F.col("l_number"), F.col("r_number"))
    margin = F.round(F.col("l_total") - F.col("r_total"), 4)
    winner = F.when(F.abs(margin) < 0.05, "contested").when(margin > 0, F.col("l_id")).otherwise(F.col("r_id"))
    return pairs.where(Q.values_conflict(F.col("l_number"), F.col("r_number"))).select("subject", "predicate", F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), Q.severity(0.6, F.lit(CRITICALITY["Observation"]), delta).alias("severity"), margin.alias("margin"), winner.alias("winner"))


def violations(df: DataFrame, operator: str, bound: Column) -> DataFrame:
    """Live values that exactly break a constraint; undecidable ones do not count."""
    return df.where(~F.col("status").isin(*DEAD) & ~Q.satisfies(F.col("number"), F.lit(operator), bound))


def timeline(df: DataFrame) -> DataFrame:
    """Each property's values, oldest first, with the change from the one before and the closing time of a succession."""
    w = Window.partitionBy("subject", "predicate").orderBy("valid_from", "id")
    return df.select("subject", "predicate", "id", F.row_number().over(w).cast("long").alias("step"), F.round(Q.relative_delta(F.lag("number").over(w), F.col("number")), 4).alias("delta"), F.lead("valid_from").over(w).alias("closed_at"))


def current(df: DataFrame) -> DataFrame:
    """The live value of each property that holds from the latest time; of equals the larger id."""
    ok = df.where(~F.col("status").isin(*DEAD))
    return ok.groupBy("subject", "predicate").agg(F.max_by(F.struct("id", "number"), F.struct("valid_from", "id")).alias("x")).select("subject", "predicate", "x.id", "x.number")
