"""Mixing sources to target weights: whole repeats first, then a bounded knapsack over document lengths for what is left."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, written

#: Equal parts that a length's documents are dealt into by hash; only one part of each length is ever ordered.
PARTS = 256
#: The plan, a row for each source and length, is broadcast up to so many rows and so many bytes of source names; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 24


def word_count(text: Column | str) -> Column:
    """Number of runs of anything but ASCII white space; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight; a share stops at `most` times its size, and the excess is shared again until none is above."""
    out, left, total = [0.0] * len(sizes), float(sum(sizes)), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))  # those that stop come first
    for n, i in enumerate(order):
        if left * weights[i] / total <= most * sizes[i]:
            for j in order[n:]:
                out[j] = left * weights[j] / total
            break
        out[i] = float(most * sizes[i])
        left, total = max(0.0, left - out[i]), total - weights[i]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that the words come as near to the budget from below as can be found.

    An even share of each length comes first, so that lengths keep their proportions. What is left goes to the largest
    lengths that fit, down to a rest of a few documents' size; bounded-knapsack dynamic programming (reachable sums as the bits of an integer, counts split
    into powers of two) fits that rest. Work grows with the number of lengths and the longest, not with documents."""
    pairs = [(n, c) for n, c in zip(lengths, counts, strict=True)]
    total = sum(n * c for n, c in pairs)
    if budget >= total:
        return list(counts)
    take = [c * budget // total if n else 0 for n, c in pairs]
    rest = budget - sum(n * t for (n, _), t in zip(pairs, take, strict=True))
    order = sorted((i for i, (n, c) in enumerate(pairs) if n and c > take[i]), key=lambda i: -pairs[i][0])
    window = 1 << 14  # the dynamic programme's budget, in words
    for i in order:
        n, c = pairs[i]
        add = min(c - take[i], max(0, rest - window) // n)
        take[i] += add
        rest -= add * n
    items: list[tuple[int, int, int]] = []
    for i in order:
        n, c = pairs[i]
        k, left = 1, min(c - take[i], rest // n)
        while left > 0:
            k = min(k, left)
            items.append((i, k, k * n))
            left, k = left - k, 2 * k
    full, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i, k, size in items:
        new = (reach | (reach << size)) & full
        if new != reach:
            steps.append((i, k, size, reach))
            reach = new
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, k, size, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= size
    return take


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target and taken (words the mix takes, repeats counted), and _repeats.

    Sources by code point, null last, have the weights in turn. A source whose target is at least its size is taken whole
    that many times; the rest of each target is fitted by knapsack() over the source's histogram of lengths, and documents
    of a length are chosen by a seeded hash. Texts without words have size 0 and are taken 0 words. Repeated rows
    count each; those that agree in doc_id and length are ordered by a hash of their texts, and only equal ones are left to chance. Empty
    tables give empty results. Own columns called as a new one, whatever the case, are replaced; other names may be any."""
    rows = boxed(docs, ("size", "source_size", "target", "taken", "_repeats"), doc_id=F.col("doc_id"), _text=F.xxhash64("text"), size=word_count("text"), _hash=F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed)), _src=F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce(F.col("source").cast("string"), F.lit("")))).withColumn("_part", F.pmod("_hash", F.lit(PARTS)).cast("int"))
    hist = rows.groupBy("_src", "size", "_part").agg(F.count("*").alias("n"))
    hist = written(hist, "lengths")
    by_source = hist.groupBy("_src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        # null last; UTF-8 bytes sort as code points do
        pdf = pdf.assign(k=[(s[0] != "s", s.encode()) for s in pdf["_src"]]).sort_values("k").reset_index(drop=True)
        pdf["target"] = targets([int(x) for x in pdf["source_size"]], [weights[i % len(weights)] for i in range(len(pdf))], most)
        return pdf[["_src", "source_size", "target"]]

    # one row a source
    goals = by_source.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(share, "_src string, source_size long, target double")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(most, int(goal // size)) if size else 0
        budget = max(0, min(round(goal) - base * size, size if base < most else 0))
        pdf = pdf.sort_values("size")
        pdf["_need"] = knapsack(pdf["size"].tolist(), pdf["count"].tolist(), budget)
        pdf["_base"] = base
        return pdf[["_src", "size", "source_size", "target", "_base", "_need"]]

    lengths = hist.groupBy("_src", "size").agg(F.sum("n").alias("count")).join(goals, "_src")
    plan = lengths.groupBy("_src").applyInPandas(fit, "_src string, size long, source_size long, target double, _base int, _need long")
    upto = Window.partitionBy("_src", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = hist.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(plan, ["_src", "size"])
    # a part is taken whole, not at all, or (one part of each length) up to a rank
    parts = written(parts.select("_src", "size", "_part", "source_size", "target", "_base", F.greatest(F.lit(0), F.least("n", F.col("_need") - F.col("before"))).alias("_need"), ((F.col("_need") > F.col("before")) & (F.col("_need") < F.col("before") + F.col("n"))).alias("_edge")), "plan")
    rank = Window.partitionBy("_src", "size", "_part").orderBy("_hash", "doc_id", "_text")
    whole = F.when(~F.col("_edge") & (F.col("_need") > 0), F.col("_part"))
    short = parts.groupBy("_src", "size").agg(*(F.max(c).alias(c) for c in ("source_size", "target", "_base")), F.coalesce(F.max(whole), F.lit(-1)).alias("_upto"), F.max(F.when(F.col("_edge"), F.col("_part"))).alias("_cut"), F.max(F.when(F.col("_edge"), F.col("_need"))).alias("_need"))
    short = written(short, "cuts")
    n, named = short.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_src")), F.lit(0))).first()
    if n <= BROADCAST_ROWS and named <= BROADCAST_BYTES:
        # whole rows stay where they are, but for the part of each length that is ordered
        told = rows.join(F.broadcast(short), ["_src", "size"])
        at_edge = F.col("_part").eqNullSafe(F.col("_cut"))
        edge = told.where(at_edge).withColumn("_add", F.when(F.row_number().over(rank) <= F.col("_need"), 1).otherwise(0))
        both = edge.unionByName(told.where(~at_edge).withColumn("_add", F.when(F.col("_part") <= F.col("_upto"), 1).otherwise(0)))
    else:
        # join and ranks share one shuffle of the rows
        both = rows.join(parts, ["_src", "size", "_part"]).withColumn("_add", F.when(F.row_number().over(rank) <= F.col("_need"), 1).otherwise(0))
    return both.select("row.*", "size", "source_size", "target", (F.col("size") * (F.col("_base") + F.col("_add"))).cast("long").alias("taken"), (F.col("_base") + F.col("_add")).cast("int").alias("_repeats"))
