"""What a batch of new beliefs does to those held: corroboration, insertion, retirement of intervals, verdicts, resolution of names."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantity as Q
from ..functions import text as X
from ..sources.graph import DEAD


def reconcile_claims(held: DataFrame, new: DataFrame) -> DataFrame:
    """(id, outcome, against, change, delta, magnitude, seed) of new claims (id, fp, subject, predicate, value) against held ones (id, fp, subject, predicate,
    value, valid_from, status).

    A fingerprint that is held corroborates that node (the smallest id of equals). Any other claim is inserted, and compared with
    the current belief of its property; a material change seeds impact with its magnitude, 0.35 at least. Of new ones with one fingerprint the
    first by id counts. Nulls in subject or predicate compare with nothing."""
    first = new.groupBy("fp").agg(F.min_by(F.struct("id", "subject", "predicate", "value"), "id").alias("x")).select("fp", "x.*")
    same = held.groupBy("fp").agg(F.min("id").alias("known"))
    now = held.where(~F.col("status").isin(*DEAD)).groupBy("subject", "predicate").agg(F.max_by(F.struct("id", "value"), F.struct("valid_from", "id")).alias("was"))
    both = first.join(same, "fp", "left").join(now, ["subject", "predicate"], "left")
    change = Q.change(F.col("was.value"), F.col("value"))
    both = both.withColumn("c", F.when(F.col("known").isNull(), change))
    seed = F.when(F.col("c.material"), F.greatest(F.col("c.magnitude"), F.lit(0.35)))
    return both.select("id", F.when(F.col("known").isNotNull(), "corroborated").otherwise("inserted").alias("outcome"), F.coalesce("known", "was.id").alias("against"), F.col("c.kind").alias("change"), F.col("c.delta").alias("delta"), F.col("c.magnitude").alias("magnitude"), seed.alias("seed"))


def corroborate(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Nodes (id, status, confidence, sources) after sources (id, path) have told them again: each path that is new raises confidence by 0.08, to
    0.99 at most, and a live node becomes SUPPORTED."""
    told = sources.groupBy("id").agg(F.collect_set("path").alias("told"))
    n = nodes.join(told, "id", "left").withColumn("fresh", F.array_except(F.coalesce("told", F.array().cast("array<string>")), F.coalesce("sources", F.array().cast("array<string>"))))
    hit = F.size("fresh") > 0
    return n.withColumns({
        "confidence": F.when(hit, F.greatest(F.col("confidence"), F.least(F.lit(0.99), F.col("confidence") + 0.08 * F.size("fresh")))).otherwise(F.col("confidence")),
        "status": F.when(hit & ~F.col("status").isin(*DEAD), "SUPPORTED").otherwise(F.col("status")),
        "sources": F.array_sort(F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.col("fresh"))),
    }).drop("told", "fresh")


def verdict_edges(conflicts: DataFrame) -> DataFrame:
    """CONTRADICTS edges, from the right side to the left, that open conflicts (left_id, right_id, severity) leave in the graph."""
    return conflicts.select(F.col("right_id").alias("source"), F.col("left_id").alias("target"), F.lit("CONTRADICTS").alias("type"), F.lit(0.9).alias("weight"), F.col("severity").alias("confidence")).distinct()


def apply_verdicts(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Nodes (id, status, ...) with what conflicts (left_id, right_id, winner, kind) make of their status: contested sides are CONTESTED, winners SUPPORTED, losers
    CONTRADICTED; against a constraint, the constraint stays and the observation is CONTESTED. Of several verdicts the worst holds."""
    side = lambda own, rank: F.struct(F.col(own).alias("id"), rank.alias("rank"))
    rule = F.col("kind") == "CONSTRAINT"
    rank = lambda own: F.when(F.col("winner") == "contested", 1).when(F.col("winner") == F.col(own), 0).otherwise(2)
    told = conflicts.select(F.explode(F.array(side("left_id", F.when(rule, -1).otherwise(rank("left_id"))), side("right_id", F.when(rule, 1).otherwise(rank("right_id"))))).alias("x")).select("x.*").where("rank >= 0")
    worst = told.groupBy("id").agg(F.max("rank").alias("rank"))
    names = F.element_at(F.array(*map(F.lit, ("SUPPORTED", "CONTESTED", "CONTRADICTED"))), F.col("rank") + 1)
    return nodes.join(worst, "id", "left").withColumn("status", F.when(F.col("rank").isNotNull() & ~F.col("status").isin(*DEAD), names).otherwise(F.col("status"))).drop("rank")


def invalidate(nodes: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Nodes (id, status, valid_until, ...) after those in gone (id) are invalid: their intervals close now, unless they closed before."""
    n = nodes.join(gone.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    return n.withColumns({
        "valid_until": F.when(F.col("gone"), F.least(F.coalesce("valid_until", now), now)).otherwise(F.col("valid_until")),
        "status": F.when(F.col("gone"), "INVALIDATED").otherwise(F.col("status")),
    }).drop("gone")


def uncited_links(decisions: DataFrame, beliefs: DataFrame, most: int = 4) -> DataFrame:
    """BASED_ON edges, weak ones, from decisions (id, chunk) that cite nothing to the first `most` beliefs (id, chunk, n) of their chunk; that many is the feature."""
    w = Window.partitionBy("decision").orderBy("n", "target")
    d, b = decisions.select(F.col("id").alias("decision"), "chunk"), beliefs.select(F.col("id").alias("target"), "chunk", "n")
    few = d.join(b, "chunk").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return few.select(F.col("decision").alias("source"), "target", F.lit("BASED_ON").alias("type"), F.lit(0.45).alias("weight"), F.lit(0.4).alias("confidence"))


def entity_keys(entities: DataFrame) -> DataFrame:
    """(key, id): the node that a trimmed lower-case name stands for; a label comes before an alias, then the smaller id. entities: (id, label, aliases)."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    names = F.concat(F.array(F.struct(F.lit(0).alias("p"), F.col("label").alias("name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit(1).alias("p"), a.alias("name"))))
    return entities.select("id", F.explode(names).alias("x")).select(key(F.col("x.name")).alias("key"), "id", "x.p").where("key <> ''").groupBy("key").agg(F.min_by("id", F.struct("p", "id")).alias("id"))


def resolve(names: DataFrame, entities: DataFrame, similar: DataFrame | None = None, match: float = 0.86, review: float = 0.72) -> DataFrame:
    """(name, kind, decision, id, score) of names (name, kind, context) against entities (id, label, aliases, kind, neighbours).

    An exact key matches at 1, an equal normalised name at 0.98. Else candidates that share a word, of a lexical similarity of 0.5 or more, score
    0.45 lexical + 0.25 semantic + 0.15 context + 0.15 kind; `similar` (name, id, semantic) tells the semantic part, 0 elsewhere. From `match` on it is a
    match, from `review` on a case for review, else a new entity. Ties go to the smaller id. Names are blocked by words, so pairs that share none are not
    compared; null names are new."""
    key = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    n = names.select("name", "kind", F.coalesce("context", F.array().cast("array<string>")).alias("context"), key.alias("key"), X.normalise(F.col("name")).alias("plain"))
    exact = entity_keys(entities).withColumnRenamed("id", "by_key")
    plain = entities.select("id", X.normalise(F.col("label")).alias("plain")).where("plain <> ''").groupBy("plain").agg(F.min("id").alias("by_plain"))
    n = n.join(exact, "key", "left").join(plain, "plain", "left")
    open_ = n.where("by_key is null and by_plain is null and plain <> ''").select("name", "kind", "context", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    e = entities.select("id", "label", F.col("kind").alias("ekind"), F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))
    blocks = e.select("id", F.explode(F.array_distinct(F.split(X.normalise(F.col("label")), " "))).alias("word")).where("word <> ''")
    pairs = open_.join(blocks, "word").select("name", "kind", "context", "id").distinct().join(e, "id").withColumn("lex", X.lexical_similarity(F.col("name"), F.col("label"))).where("lex >= 0.5")
    pairs = pairs.join(similar, ["name", "id"], "left") if similar is not None else pairs.withColumn("semantic", F.lit(0.0))
    score = 0.45 * F.col("lex") + 0.25 * F.coalesce("semantic", F.lit(0.0)) + 0.15 * X.context_overlap(F.col("neighbours"), F.col("context")) + 0.15 * X.type_agreement(F.col("ekind"), F.col("kind"))
    best = pairs.select("name", "kind", "id", F.round(score, 4).alias("s")).groupBy("name", "kind").agg(F.min_by(F.struct("id", "s"), F.struct(-F.col("s"), F.col("id"))).alias("best"))
    out = n.join(best, ["name", "kind"], "left").withColumn("score", F.when(F.col("by_key").isNotNull(), 1.0).when(F.col("by_plain").isNotNull(), 0.98).otherwise(F.coalesce("best.s", F.lit(0.0))))
    decision = F.when(F.col("score") >= match, "match").when(F.col("score") >= review, "review").otherwise("new")
    return out.select("name", "kind", decision.alias("decision"), F.coalesce("by_key", "by_plain", F.when(F.col("score") >= review, F.col("best.id"))).alias("id"), "score")


def resolve_relations(relations: DataFrame, local: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges (source, target, type) of relations (source, target, type) told by name: a name of the text itself (label, id) first, then an entity key (key, id); unresolved
    ones and loops go."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    out = relations
    for end in ("source", "target"):
        l = local.select(key(F.col("label")).alias("k"), F.col("id").alias("l")).groupBy("k").agg(F.min("l").alias("l"))
        g = keys.select(F.col("key").alias("k"), F.col("id").alias("g"))
        out = out.withColumn("k", key(F.col(end))).join(l, "k", "left").join(g, "k", "left").withColumn(end, F.coalesce("l", "g")).drop("k", "l", "g")
    return out.where("source is not null and target is not null and source <> target").select("source", "target", "type")
