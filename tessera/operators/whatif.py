"""Counterfactuals: interventions on a copy of the graph, what they change, and which of several scenarios is best."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import DEAD
from .lineage import MOVED, decision_basis

#: Words of a predicate that belong to a dimension, and dimensions of which less is better.
DIMENSIONS = {"cost": ("cost", "budget", "price", "capex", "opex"), "schedule": ("lead time", "duration", "delivery time", "charging time"), "capacity": ("capacity", "fleet size"), "throughput": ("throughput",)}
LESS = ("cost", "schedule", "risk_exposure", "open_contradictions", "compliance_violations", "decisions_at_risk", "total_uncertainty")
MORE = ("capacity", "throughput", "health_score")


def set_value(nodes: DataFrame, target: Column, number: float) -> DataFrame:
    return nodes.withColumn("number", F.when(target, F.lit(number)).otherwise(F.col("number")))


def invalidated(nodes: DataFrame, target: Column) -> DataFrame:
    return nodes.withColumn("status", F.when(target, "INVALIDATED").otherwise(F.col("status")))


def asserted(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes and new claims (id, label, subject, predicate, number): probable, at a confidence of 0.6."""
    rows = new.withColumns({"type": F.lit("Claim"), "status": F.lit("PROBABLE"), "confidence": F.lit(0.6)})
    return nodes.unionByName(rows, allowMissingColumns=True)


def without_dependency(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where(~((F.col("source") == source) & (F.col("target") == target)))


def with_dependency(edges: DataFrame, source: str, target: str) -> DataFrame:
    """A DEPENDS_ON edge besides, unless there is one."""
    one = edges.sparkSession.range(1).select(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit("DEPENDS_ON").alias("type"), F.lit(0.9).alias("weight"), F.lit(0.9).alias("confidence"))
    return edges.unionByName(one.join(edges, ["source", "target", "type"], "left_anti").select(one.columns))


def redirected(edges: DataFrame, source: str, old: str, new: str) -> DataFrame:
    """Edges from source to old lead to new."""
    hit = (F.col("source") == source) & (F.col("target") == old)
    return edges.withColumn("target", F.when(hit, new).otherwise(F.col("target"))).where("source <> target")


def dimension(words: tuple[str, ...]) -> Column:
    """Sum of live numbers whose predicate holds one of the words; null if there are none."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.col("predicate"), F.lit(w))
    return F.round(F.sum(F.when(hit & ~F.col("status").isin(*DEAD), F.col("number"))), 4)


def at_risk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of decisions of which a part of the basis has moved."""
    moved = nodes.where(F.col("status").isin(*MOVED)).select("id")
    return decision_basis(nodes, edges).join(moved, "id", "left_semi").select(F.col("decision").alias("id")).distinct()


def measure(nodes: DataFrame, edges: DataFrame, contradictions: DataFrame, health_score: Column | None = None) -> DataFrame:
    """One row: dimensions, risk exposure, contradictions (kind), decisions at risk, uncertainty, live beliefs. nodes: (id, type, status, confidence, predicate, number, severity, criticality)."""
    live = ~F.col("status").isin(*DEAD)
    floor = F.when(F.col("status") == "CONTESTED", 0.5).when(F.col("status") == "CONTRADICTED", 0.7).when(F.col("status") == "UNVERIFIED", 0.4).otherwise(0.0)
    doubt = F.greatest(1 - F.col("confidence"), floor) * F.col("criticality")
    risk = F.when(live & (F.col("type") == "Risk"), F.coalesce("severity", F.lit(0.5)) * F.col("confidence"))
    own = nodes.agg(*(dimension(w).alias(n) for n, w in DIMENSIONS.items()), F.round(F.coalesce(F.sum(risk), F.lit(0.0)), 4).alias("risk_exposure"), F.round(F.coalesce(F.sum(F.when(live, doubt)), F.lit(0.0)), 4).alias("total_uncertainty"), F.count_if(live).alias("live_beliefs"))
    open_ = contradictions.agg(F.count_if(F.col("kind") == "CONSTRAINT").alias("compliance_violations"), F.count("*").alias("open_contradictions"))
    risky = at_risk(nodes, edges).agg(F.count("*").alias("decisions_at_risk"))
    out = own.crossJoin(open_).crossJoin(risky)  # one row each
    return out.withColumn("health_score", F.lit(None).cast("double") if health_score is None else health_score)


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, before, after, delta, direction) of two measures: better, worse, unchanged (under 1e-9) or unknown (a side is null, or the dimension is neutral)."""
    names = [c for c in before.columns if c in (*LESS, *MORE, "live_beliefs")]
    long = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias(side)) for n in names))).alias("x")).select("x.*")
    d = F.col("after") - F.col("before")
    good = F.when(F.col("name").isin(*LESS), d < 0).when(F.col("name").isin(*MORE), d > 0)
    way = F.when(d.isNull(), "unknown").when(F.abs(d) < 1e-9, "unchanged").when(good.isNull(), "unchanged").when(good, "better").otherwise("worse")
    return long(before, "before").join(long(after, "after"), "name").select("name", "before", "after", F.round(d, 6).alias("delta"), way.alias("direction"))


def orders(impacts: DataFrame, most: int = 12) -> DataFrame:
    """(order, id, severity): of impacts (id, severity, depth) the `most` severest of the first order (one step) and of the second; ties by id. That many is the report."""
    one = impacts.where("depth <= 1").orderBy(F.desc("severity"), "id").limit(most).withColumn("order", F.lit(1))
    return one.unionByName(impacts.where("depth > 1").orderBy(F.desc("severity"), "id").limit(most).withColumn("order", F.lit(2))).select("order", "id", "severity")


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): ids that are new in after, and those that are gone."""
    a, b = before.select("id").distinct(), after.select("id").distinct()
    return b.join(a, "id", "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, "id", "left_anti").withColumn("change", F.lit("resolved")))


def compare(scenarios: DataFrame) -> DataFrame:
    """(scenario, score, rank) of scenarios (scenario, health, new_contradictions, newly_at_risk, resolved_decisions, resolved_contradictions, risk), best first; ties by name."""
    score = F.round(F.col("health") - 6 * F.col("new_contradictions") - 8 * F.col("newly_at_risk") + 5 * F.col("resolved_decisions") + 4 * F.col("resolved_contradictions") - 3 * F.col("risk"), 4)
    s = scenarios.select("scenario", score.alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "scenario")))  # a few rows: one a scenario
