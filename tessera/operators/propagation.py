"""Impact over the dependency graph: the propagation view, reach, ranked paths, PageRank."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut, dealt
from ..sources.graph import BACKWARD, BOTH, CRITICALITY, INFLUENCE, lookup


def propagation(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(u, v, influence): a change in u disturbs v. Loops and edges without influence go; of parallel edges the strongest stays."""
    e = edges.withColumn("influence", lookup(INFLUENCE, F.col("type"), 0.3) * F.col("weight") * F.col("confidence")).where("source <> target and influence > 0")
    fwd, back = F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v"))
    ways = F.when(F.col("type").isin(*BACKWARD), F.array(back)).when(F.col("type").isin(*BOTH), F.array(fwd, back)).otherwise(F.array(fwd))
    out = dealt(e.select(F.explode(ways).alias("x"), "influence").select("x.*", "influence"), "u", "v").groupBy("u", "v").agg(F.max("influence").alias("influence"))
    if nodes is not None:
        out = out.join(nodes.select(F.col("id").alias("u")), "u", "left_semi").join(nodes.select(F.col("id").alias("v")), "v", "left_semi")
    return out.select("u", "v", "influence")


def reach(graph: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(seed, id, depth): nodes downstream of each seed (id), at their least distance; the seed itself is not among them. The view and each frontier are
    worked out once."""
    graph = cut(graph.select("u", "v"))
    seen = front = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct())
    for k in range(1, depth + 1):
        front = cut(front.join(graph, front.id == graph.u).select("seed", F.col("v").alias("id"), F.lit(k).alias("depth")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti"))
        seen = seen.union(front)
    return seen.where("depth > 0")


def upstream(graph: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """reach() against the direction of change: what each seed may be disturbed by."""
    return reach(graph.select(F.col("v").alias("u"), F.col("u").alias("v")), seeds, depth)


def strongest_paths(graph: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """(seed, id, strength, path): the path of the largest product of influences to each node within `depth` steps; ties by fewer steps, then by path.

    One best path a node and round is kept (influence is 1 at most, so no cycle helps), so a round's size is bounded by seeds times nodes."""
    g = cut(graph.select("u", "v", F.least(F.greatest("influence", F.lit(1e-9)), F.lit(1.0)).alias("w")))
    order = lambda: F.struct(-F.col("strength"), F.size("path"), F.col("path"))
    best = front = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("strength"), F.array("id").alias("path")).distinct())
    for _ in range(depth):
        step = front.join(g, front.id == g.u).where(~F.array_contains("path", F.col("v"))).select("seed", F.col("v").alias("id"), (F.col("strength") * F.col("w")).alias("strength"), F.concat("path", F.array("v")).alias("path"))
        step = step.groupBy("seed", "id").agg(F.min_by(F.struct("strength", "path"), order()).alias("x")).select("seed", "id", "x.*")
        old = best.select("seed", "id", F.col("strength").alias("had"))
        front = cut(step.join(old, ["seed", "id"], "left").where("had is null or strength > had").drop("had"))
        best = cut(best.join(front.select("seed", "id"), ["seed", "id"], "left_anti").unionByName(front))
    return best.where("size(path) > 1").select("seed", "id", "strength", F.array_join("path", " -> ").alias("path"))


def hops(paths: DataFrame, graph: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(seed, id, step, u, v, influence): the edges, in turn, of each path of impact() or strongest_paths()."""
    p = paths.select("seed", "id", F.split("path", " -> ").alias("p")).select("seed", "id", F.posexplode(F.arrays_zip(F.expr("slice(p, 1, size(p) - 1)").alias("u"), F.expr("slice(p, 2, size(p) - 1)").alias("v"))).alias("step", "e"))
    return p.select("seed", "id", (F.col("step") + 1).alias("step"), "e.u", "e.v").join(graph, ["u", "v"], "left").select("seed", "id", "step", "u", "v", "influence")


def report(impacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Impacts (seed, id, score, depth, path) with severity (score times criticality) and whether they are direct, severest first; ties by depth, then id."""
    n = nodes.select("id", "type", lookup(CRITICALITY, F.col("type"), 0.5).alias("criticality"))
    out = impacts.join(n, "id", "left").withColumn("severity", F.round(F.col("score") * F.coalesce("criticality", F.lit(0.5)), 4)).withColumn("direct", F.col("depth") <= 1)
    return out.select("seed", "id", "type", "score", "severity", "depth", "direct", "path").orderBy(F.desc("severity"), "depth", "id")


def validation_queue(graph: DataFrame, doubts: DataFrame, most: int = 10) -> DataFrame:
    """(rank, id, gain, share, action) of nodes (id, uncertainty, status): own doubt plus, of each node that it disturbs within four steps, that node's by
    the impact's score; share: percent of all doubt. The `most` first are the report; ties by id."""
    d = cut(doubts.where("uncertainty > 0").select("id", "uncertainty", "status"))
    score = impact(graph, d.select("id", F.lit(1.0).alias("magnitude")), depth=4).select(F.col("seed"), "id", "score")
    lever = score.join(d.select("id", "uncertainty"), "id").groupBy("seed").agg(F.sum(F.col("score") * F.col("uncertainty")).alias("more"))
    total = d.agg(F.sum("uncertainty").alias("total"))
    q = d.join(lever, d.id == lever.seed, "left").crossJoin(F.broadcast(total))  # one row
    q = q.withColumn("gain", F.round(F.col("uncertainty") + F.coalesce("more", F.lit(0.0)), 4))
    action = F.when(F.col("status") == "CONTRADICTED", "settle which source is right").when(F.col("status") == "CONTESTED", "find a third source").when(F.col("status") == "UNVERIFIED", "find a source").when(F.coalesce("more", F.lit(0.0)) > F.col("uncertainty"), "verify first, others rest on it").otherwise("verify")
    q = q.select("id", "gain", F.round(100 * F.col("gain") / F.col("total"), 2).alias("share"), action.alias("action")).orderBy(F.desc("gain"), "id").limit(most)
    return q.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "id"))).select("rank", "id", "gain", "share", "action")


def impact(graph: DataFrame, seeds: DataFrame, depth: int = 6, least: float = 0.02, k: int = 3) -> DataFrame:
    """(seed, id, score, depth, path) by max-product propagation from seeds (id, magnitude).

    All simple paths of at least `least` are enumerated level by level (the floor is in the join, so weak paths never grow). A path counts
    if it is among its end's `k` best (score desc, depth, path) and its prefix counts; that rule is applied until nothing changes.
    score is the sum of the paths that count, at most 1; the strongest path explains it."""
    graph = cut(graph.select("u", "v", "influence"))
    level = seeds.select(F.col("id").alias("seed"), "id", F.abs("magnitude").cast("double").alias("score"), F.array("id").alias("path"))
    levels = [level]
    for _ in range(depth):
        level = level.join(graph, (level.id == graph.u) & (level.score * graph.influence >= least)).where(~F.array_contains("path", F.col("v"))).select("seed", F.col("v").alias("id"), (F.col("score") * F.col("influence")).alias("score"), F.concat("path", F.array("v")).alias("path"))
        level = cut(level)
        levels.append(level)
    every = levels[0]
    for x in levels[1:]:
        every = every.union(x)
    every = cut(every.withColumn("prefix", F.slice("path", 1, F.greatest(F.lit(1), F.size("path") - 1))))
    w = Window.partitionBy("seed", "id").orderBy(F.desc("score"), F.size("path"), "path")
    kept, before = every, None
    while True:
        roots = every.where("size(path) = 1")
        rest = every.where("size(path) > 1").join(kept.select("seed", F.col("path").alias("prefix")), ["seed", "prefix"], "left_semi").select(every.columns)
        kept = cut(roots.union(rest).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r"))
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("seed", "path").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    best = F.max_by(F.struct("path", (F.size("path") - 1).alias("depth")), F.struct("score", -F.size("path")))
    return kept.where("id <> seed").groupBy("seed", "id").agg(F.round(F.least(F.lit(1.0), F.sum("score")), 4).alias("score"), best.alias("x")).select("seed", "id", "score", F.col("x.depth").alias("depth"), F.array_join("x.path", " -> ").alias("path"))


def pagerank(graph: DataFrame, nodes: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank) on the reversed graph, weighted by influence, until ranks move by less than `tolerance` a node in sum; rank without a way
    out is dealt evenly."""
    ids = cut(nodes.select("id").distinct())
    n = max(1, ids.count())
    out = graph.groupBy("v").agg(F.sum("influence").alias("total"))
    step = cut(graph.join(out, "v").select(F.col("v").alias("src"), F.col("u").alias("dst"), (F.col("influence") / F.col("total")).alias("p")))
    ids = cut(ids.join(step.select(F.col("src").alias("id")).distinct().withColumn("leads", F.lit(True)), "id", "left"))
    rank = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        flow = rank.join(step, rank.id == step.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        loose = rank.where("leads is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        rank = cut(rank.join(flow, rank.id == flow.dst, "left").select("id", "leads", F.col("rank").alias("old"), ((1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank")))
        moved = rank.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        rank = rank.drop("old")
        if moved < tolerance * n:
            break
    return rank.select("id", "rank")


def criticality(ranks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, criticality): 0.55 of what the type matters and 0.45 of the rank, by the largest rank."""
    top = ranks.agg(F.max("rank").alias("top"))
    own = nodes.select("id", lookup(CRITICALITY, F.col("type"), 0.5).alias("own"))
    out = own.join(ranks, "id").crossJoin(F.broadcast(top))  # one row
    return out.select("id", F.round(0.55 * F.col("own") + 0.45 * F.coalesce(F.try_divide("rank", "top"), F.lit(0.0)), 4).alias("criticality"))
