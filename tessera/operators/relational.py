"""Graph views that are plain relational work: stats, pages, adjacency, upserts, chunk differences, health."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.graph import CRITICALITY, DEAD, lookup


def stats(nodes: DataFrame) -> DataFrame:
    """Counts by type, by status and in all, in one pass."""
    return nodes.groupingSets([["type"], ["status"], []], "type", "status").agg(F.count("*").alias("n"))


def page(nodes: DataFrame, types: tuple[str, ...], needle: str, offset: int, limit: int) -> DataFrame:
    """Nodes of some types whose label holds a text, most critical first, then by id."""
    hits = nodes.where(F.col("type").isin(*types) & F.contains(F.lower("label"), F.lit(needle.lower())))
    return hits.withColumn("criticality", lookup(CRITICALITY, F.col("type"), 0.5)).orderBy(F.desc("criticality"), "id").offset(offset).limit(limit)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among nodes."""
    return edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def compact(log: DataFrame, key: str, version: str) -> DataFrame:
    """The latest version of each key of an append-only log, without those whose latest version is a tombstone (deleted)."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), version).alias("x")).select(key, "x.*").where("not deleted").drop("deleted")


def link_if_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges without loops, one of each (source, target, type), that are not there yet."""
    k = ["source", "target", "type"]
    w = Window.partitionBy(*k).orderBy(F.desc("weight"), F.desc("confidence"))
    return new.where("source <> target").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").join(edges.select(*k), k, "left_anti").select(new.columns)


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fp, change): added and removed fingerprints."""
    a, b = old.select("fp").distinct(), new.select("fp").distinct()
    return b.join(a, "fp", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "fp", "left_anti").withColumn("change", F.lit("removed")))


def uncertainty(nodes: DataFrame) -> DataFrame:
    """Doubt mass of each live node: 1 - confidence, with a floor by status, times criticality."""
    floor = F.when(F.col("status") == "CONTESTED", 0.5).when(F.col("status") == "CONTRADICTED", 0.7).when(F.col("status") == "UNVERIFIED", 0.4).otherwise(0.0)
    doubt = F.greatest(1 - F.col("confidence"), floor) * lookup(CRITICALITY, F.col("type"), 0.5)
    return nodes.where(~F.col("status").isin(*DEAD)).select("id", "type", F.round(doubt, 4).alias("uncertainty"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters and the score of a graph; contradictions and sources are not counted in this form."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("tied", F.lit(1))
    based = edges.where(F.col("type").isin("BASED_ON", "DEPENDS_ON", "REQUIRES")).select(F.col("source").alias("id")).distinct().withColumn("based", F.lit(1))
    n = nodes.join(ends, "id", "left").join(based, "id", "left").withColumn("live", ~F.col("status").isin(*DEAD))
    c = n.agg(
        F.avg(F.when(F.col("live"), F.col("confidence"))).alias("avg_confidence"), F.count_if("live").alias("live"),
        F.count_if(F.col("live") & F.col("tied").isNull()).alias("orphans"), F.count_if(F.col("live") & (F.col("type") == "Decision")).alias("decisions"),
        F.count_if(F.col("live") & (F.col("type") == "Decision") & F.col("based").isNull()).alias("without_lineage"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    score = 100 - (1 - F.col("avg_confidence")) * 20 - F.least(share("without_lineage", "decisions") * 20, F.lit(10.0)) - F.least(share("orphans", "live") * 20, F.lit(8.0))
    return c.select("live", "orphans", "decisions", "without_lineage", F.round("avg_confidence", 4).alias("avg_confidence"), F.round(score, 4).alias("score"))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by id, the new ones replacing old ones; new edges of which an end is missing are left out."""
    ok = induced(new, nodes)
    return edges.join(ok.select("id"), "id", "left_anti").unionByName(ok)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in gone (id), and edges without those that touch them."""
    g = gone.select("id").distinct()
    left = edges.join(g.select(F.col("id").alias("source")), "source", "left_anti").join(g.select(F.col("id").alias("target")), "target", "left_anti")
    return nodes.join(g, "id", "left_anti"), left.select(edges.columns)


def update_nodes(nodes: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Nodes (id, ..., updated_at) with the fields that changes (id, ...) give; null changes nothing."""
    fields = [c for c in changes.columns if c != "id"]
    c = changes.select("id", *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(True).alias("hit"))
    out = nodes.join(c, "id", "left").withColumns({f: F.coalesce(f"new_{f}", f) for f in fields} | {"updated_at": F.when(F.col("hit"), now).otherwise(F.col("updated_at"))})
    return out.select(nodes.columns)


def from_source(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes with a provenance (array of structs with path) from a source."""
    return nodes.where(F.exists("provenance", lambda p: p["path"] == path))


def search(nodes: DataFrame, needle: str, types: tuple[str, ...] = (), statuses: tuple[str, ...] = (), offset: int = 0, limit: int = 100, fields: tuple[str, ...] = ("label",)) -> DataFrame:
    """A page of nodes whose fields hold a text, most critical first, then by id, each with the total number of hits."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(needle.lower())), F.lit(False))
    hits = nodes.where(hit & (F.col("type").isin(*types) if types else F.lit(True)) & (F.col("status").isin(*statuses) if statuses else F.lit(True)))
    page_ = hits.withColumn("criticality", lookup(CRITICALITY, F.col("type"), 0.5)).orderBy(F.desc("criticality"), "id").offset(offset).limit(limit)
    return page_.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))  # one row


def feed(events: DataFrame, types: tuple[str, ...], most: int) -> DataFrame:
    """The last `most` events (at, id, type) of some types, latest first; none for 0 or less."""
    return events.where(F.col("type").isin(*types)).orderBy(F.desc("at"), F.desc("id")).limit(max(0, most))


def moves(events: DataFrame) -> DataFrame:
    """File events (path, kind, new_path, at): a move is a deletion and a creation."""
    two = F.array(F.struct(F.col("path"), F.lit("DELETED").alias("kind"), "at"), F.struct(F.col("new_path").alias("path"), F.lit("CREATED").alias("kind"), "at"))
    return events.select(F.explode(F.when(F.col("kind") == "MOVED", two).otherwise(F.array(F.struct("path", "kind", "at")))).alias("x")).select("x.*")


def curated(spec: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, target, type, weight, confidence, resolved) of curated links (from, to, edge, weight, confidence): each end is the node (id, label) with the
    shortest label that holds its text; unresolved ends are null. A spec is a short list, and is sent to all."""
    out = spec
    for end in ("from", "to"):
        text = F.broadcast(spec.select(F.col(f"`{end}`").alias("t")).distinct())
        best = labels.join(text, F.contains(F.lower("label"), F.lower("t"))).groupBy("t").agg(F.min_by("id", F.struct(F.length("label"), F.col("id"))).alias(f"{end}_id"))
        out = out.join(best, out[f"`{end}`"] == best["t"], "left").drop("t")
    return out.select(F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.col("edge").alias("type"), "weight", "confidence", (F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).alias("resolved"))


def nearest(vectors: DataFrame, query: list[float], k: int, keep) -> DataFrame:
    """(id, score) of the first k of the 3 k nearest vectors (id, vector, ...) by distance that `keep` lets through; score 1 / (1 + distance). A top-k report; ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = F.sqrt(F.aggregate(F.zip_with("vector", q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v))
    few = vectors.withColumn("d", d).orderBy("d", "id").limit(3 * k)
    return few.where(keep).orderBy("d", "id").limit(k).select("id", F.round(1 / (1 + F.col("d")), 6).alias("score"))


def evidence_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sources, supports, authority, latest): distinct paths of a node's provenance, SUPPORTS edges into it, the best authority and the latest time."""
    s = edges.where("type = 'SUPPORTS'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("supports"))
    p = lambda f: F.transform("provenance", lambda x: x[f])
    own = nodes.select("id", F.size(F.array_distinct(F.filter(p("path"), lambda x: x.isNotNull()))).alias("sources"), F.array_max(p("authority")).alias("authority"), F.array_max(p("observed_at")).alias("latest"))
    return own.join(s, "id", "left").select("id", "sources", F.coalesce("supports", F.lit(0)).alias("supports"), F.coalesce("authority", F.lit(0.5)).alias("authority"), "latest")
