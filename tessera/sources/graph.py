"""Nodes, edges and observations of the knowledge graph, projected from the relational tables. `now` is always an argument."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cut import dealt

#: Influence of an edge type, and the direction in which a change runs along it.
INFLUENCE = {
    "INVALIDATES": 1.00, "CONTRADICTS": 0.95, "SUPERSEDES": 0.95, "CONSTRAINS": 0.80, "CAUSES": 0.80, "AFFECTS": 0.65, "SUPPORTS": 0.60,
    "REQUIRES": 0.90, "DEPENDS_ON": 0.85, "BASED_ON": 0.85, "IMPLEMENTS": 0.70, "DERIVED_FROM": 0.55,
    "ABOUT": 0.35, "OWNED_BY": 0.25, "RELATED_TO": 0.20,
}
BACKWARD = ("REQUIRES", "DEPENDS_ON", "BASED_ON", "IMPLEMENTS", "DERIVED_FROM")
BOTH = ("ABOUT", "OWNED_BY", "RELATED_TO")
#: How much a node type matters.
CRITICALITY = {"Decision": 1.0, "Requirement": 0.95, "Constraint": 0.90, "Risk": 0.85, "Action": 0.75, "Assumption": 0.70, "Claim": 0.60, "Entity": 0.50, "Event": 0.50, "Observation": 0.45, "Evidence": 0.30}
STATUSES = ("SUPPORTED", "PROBABLE", "CONTESTED", "CONTRADICTED", "UNVERIFIED", "HYPOTHETICAL", "SUPERSEDED", "INVALIDATED")
DEAD = ("SUPERSEDED", "INVALIDATED")
#: Beyond every event of the projected tables' first year; a literal keeps results repeatable.
NOW = "2024-06-30 00:00:00"


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """One assertive node an event: what a user's value of a kind was, from its time until the next one."""
    e = read(spark, d, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        F.concat(F.lit("OB"), F.col("event_id")).alias("id"), F.concat(F.lit("user-"), F.col("user_id")).alias("subject"), F.col("event_type").alias("predicate"),
        F.col("value").alias("number"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_until"), "event_id", "user_id",
        ((F.col("event_id") % 100) / 100.0).alias("confidence"), F.element_at(F.array(*(F.lit(x) for x in (0.95, 0.88, 0.80, 0.75, 0.55))), (F.col("user_id") % 5 + 1).cast("int")).alias("authority"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 8 + 1).cast("int")).alias("status"),
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, type, label, status, confidence) of suppliers, customers, nations and regions (entities) and orders (decisions)."""
    def part(name: str, prefix: str, key: str, kind: str, label: str) -> DataFrame:
        k = F.col(key).cast("long")
        return read(spark, d, name).select(F.concat(F.lit(prefix), k).alias("id"), F.lit(kind).alias("type"), F.col(label).cast("string").alias("label"), F.element_at(F.array(*map(F.lit, STATUSES)), (k % 8 + 1).cast("int")).alias("status"), ((k % 90 + 10) / 100.0).alias("confidence"))

    out = part("supplier", "S", "s_suppkey", "Entity", "s_name")
    for x in (("customer", "C", "c_custkey", "Entity", "c_name"), ("nation", "N", "n_nationkey", "Entity", "n_name"), ("region", "R", "r_regionkey", "Entity", "r_name"), ("orders", "O", "o_orderkey", "Decision", "o_orderpriority")):
        out = out.union(part(*x))
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, type, weight, confidence): ownership between entities, and what each order is based on."""
    def part(name: str, s: str, sk: str, t: str, tk: str, kind: str, weight: float) -> DataFrame:
        keys = read(spark, d, name).select(sk, tk)
        keys = dealt(keys, sk, tk).distinct() if name == "lineitem" else keys  # of numbers, which take less room than ids
        return keys.select(F.concat(F.lit(s), F.col(sk)).alias("source"), F.concat(F.lit(t), F.col(tk)).alias("target"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"), F.lit(0.9).alias("confidence"))

    out = part("nation", "N", "n_nationkey", "R", "n_regionkey", "OWNED_BY", 0.9)
    for x in (("customer", "C", "c_custkey", "N", "c_nationkey", "OWNED_BY", 0.9), ("supplier", "S", "s_suppkey", "N", "s_nationkey", "OWNED_BY", 0.9), ("orders", "O", "o_orderkey", "C", "o_custkey", "DEPENDS_ON", 0.8)):
        out = out.union(part(*x))
    return out.union(part("lineitem", "O", "l_orderkey", "S", "l_suppkey", "BASED_ON", 0.9))
