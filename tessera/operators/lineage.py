"""What decisions rest on, succession and retirement of beliefs, and views around a node."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.graph import CRITICALITY, DEAD, lookup
from .cut import dealt
from .propagation import reach
from .relational import induced

#: Edges that carry a decision's basis, out of it and into it; statuses that tell that a belief has moved.
BASIS_OUT, BASIS_IN = ("BASED_ON", "DEPENDS_ON", "REQUIRES"), ("CONSTRAINS", "REQUIRES", "INVALIDATES")
MOVED = ("CONTRADICTED", "INVALIDATED", "SUPERSEDED", "CONTESTED")


def decision_basis(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(decision, id, role): what each decision rests on, once for each node; edges out of it come before those into it."""
    out = edges.where(F.col("type").isin(*BASIS_OUT)).select(F.col("source").alias("decision"), F.col("target").alias("id"), F.struct(F.lit(0).alias("side"), "type").alias("r"))
    into = edges.where(F.col("type").isin(*BASIS_IN)).select(F.col("target").alias("decision"), F.col("source").alias("id"), F.struct(F.lit(1).alias("side"), "type").alias("r"))
    decisions = nodes.where("type = 'Decision'").select(F.col("id").alias("decision"))
    return out.union(into).join(decisions, "decision", "left_semi").groupBy("decision", "id").agg(F.min("r").alias("r")).select("decision", "id", F.col("r.type").alias("role"))


def decision_audit(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The basis of each decision with each node's status now, and whether it has moved since."""
    now = nodes.select("id", "status")
    return decision_basis(nodes, edges).join(now, "id").select("decision", "id", "role", "status", F.col("status").isin(*MOVED).alias("changed"))


def supersessions(beliefs: DataFrame) -> DataFrame:
    """SUPERSEDES edges from each live value of a property to the one before it: the latest that starts strictly earlier, of equals the larger id."""
    t = F.unix_micros(F.col("valid_from").cast("timestamp"))
    w = Window.partitionBy("subject", "predicate").orderBy(t).rangeBetween(Window.unboundedPreceding, -1)
    b = beliefs.where(~F.col("status").isin(*DEAD)).withColumn("target", F.max(F.struct("valid_from", "id")).over(w)["id"]).where("target is not null")
    return b.select(F.col("id").alias("source"), "target", F.lit("SUPERSEDES").alias("type"), F.lit(0.95).alias("weight"), F.greatest("confidence", F.lit(0.6)).alias("confidence"))


def retire(nodes: DataFrame, gone: Column) -> DataFrame:
    """Nodes after their source is gone: evidence is invalidated, other live nodes are unverified at 0.7 of their confidence, 0.1 at least."""
    hit = F.coalesce(gone, F.lit(False)) & ~F.col("status").isin(*DEAD)
    evidence = F.col("type") == "Evidence"
    return nodes.withColumns({
        "confidence": F.when(hit & ~evidence, F.greatest(F.col("confidence") * 0.7, F.lit(0.1))).otherwise(F.col("confidence")),
        "status": F.when(hit & evidence, "INVALIDATED").when(hit, "UNVERIFIED").otherwise(F.col("status")),
    })


def relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, direction, type, neighbour, label): each node's edges, one a row, as a hub may have millions; a missing label is the id."""
    both = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.lit("out").alias("direction"), "type", F.col("target").alias("neighbour")),
        F.struct(F.col("target").alias("id"), F.lit("in").alias("direction"), "type", F.col("source").alias("neighbour")),
    )).alias("x")).select("x.*")
    return both.join(nodes.select(F.col("id").alias("neighbour"), "label"), "neighbour", "left").select("id", "direction", "type", "neighbour", F.coalesce("label", "neighbour").alias("label"))


def ranked_view(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Edges among the `limit` most critical nodes and their neighbours, 2 * limit nodes in all; a top-k view, ties by id."""
    ranked = nodes.select("id", lookup(CRITICALITY, F.col("type"), 0.5).alias("criticality"))
    core = ranked.orderBy(F.desc("criticality"), "id").limit(limit).select("id", F.lit(0).alias("hop"))
    pairs = edges.select(F.col("source").alias("id"), F.col("target").alias("next")).union(edges.select("target", "source"))
    around = pairs.join(core, "id").select(F.col("next").alias("id")).distinct().join(core.select("id"), "id", "left_anti").join(ranked, "id")
    more = around.withColumn("hop", F.lit(1)).orderBy(F.desc("criticality"), "id").limit(limit)
    return induced(edges, core.union(more.select("id", "hop")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """(seed, id, depth): nodes within `depth` steps either way, the nearest `limit` of each seed; ties by id."""
    both = F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v"))))
    g = dealt(edges.select(both.alias("x")).select("x.*"), "u", "v").distinct()
    w = Window.partitionBy("seed").orderBy("depth", "id")
    return reach(g, seeds, depth).withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).select("seed", "id", "depth")


def label_match(nodes: DataFrame, needles: list[str]) -> DataFrame:
    """(needle, id): the node with the shortest label that holds each of a few given texts, whatever the case; ties by id."""
    found = nodes.select("id", "label", F.explode(F.filter(F.array(*map(F.lit, needles)), lambda x: F.contains(F.lower("label"), F.lower(x)))).alias("needle"))
    return found.groupBy("needle").agg(F.min_by("id", F.struct(F.length("label"), F.col("id"))).alias("id"))


#: Functions that a reading statement may call.
READING = frozenset(
    "abs array array_contains array_distinct array_join array_sort avg ceil coalesce collect_list collect_set concat concat_ws contains count count_if date_trunc datediff dense_rank element_at exp explode "
    "first floor greatest if ifnull lag last lead least left length ln log lower lpad max max_by mean median min min_by mode nullif percentile percent_rank posexplode power rank regexp_count regexp_extract regexp_like regexp_replace "
    "replace right round row_number rpad sha1 size sort_array split sqrt startswith endswith stddev struct substr substring sum to_date to_timestamp transform filter trim upper variance year month day hour cast try_cast "
    "and or not in exists over as on when then else case select from where having by values with using between like rlike is distinct all any union except intersect join lateral interval partition rows range".split()
)


def _check(plan) -> None:
    """Refuses analysed plans that read anything but temporary views."""
    if plan.nodeName() == "View":
        if not plan.isTempView():
            raise ValueError("only temporary views can be read")
        return
    children = plan.children()
    if not children.size() and plan.nodeName() not in ("OneRowRelation", "LocalRelation", "CTERelationRef", "Range"):
        raise ValueError(f"only temporary views can be read, not {plan.nodeName()}")
    for part in (children, plan.subqueries()):
        for i in range(part.size()):
            _check(part.apply(i))


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """The rows of one SELECT or WITH statement over the session's temporary views; anything else is a ValueError.

    It may call the functions of READING only, which neither run code nor open files, and its analysed plan may read nothing but temporary views."""
    bare = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", " '' ", sql, flags=re.S).strip().lower()
    words = re.sub(r"`[^`]*`", " x ", bare)
    if not re.match(r"(select|with)\b", bare) or ";" in words or re.search(r"\b(insert|update|delete|merge|drop|create|alter|truncate|set|cache|refresh|transform\s+\(|reduce\s+using)\b", words):
        raise ValueError("only a single reading statement is allowed")
    called = {n.strip("`") for n in re.findall(r"(`[^`]*`|[a-z_][a-z0-9_.]*)\s*\(", bare)}
    named = set(re.findall(r"\b([a-z_][a-z0-9_]*)\s*(?:\([^()]*\)\s*)?as\s*\(", words))  # a common table
    if other := called - READING - named:
        raise ValueError(f"not allowed: {', '.join(sorted(other))}")
    df = spark.sql(sql)
    _check(df._jdf.queryExecution().analyzed())
    return df
