import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import quantity as Q
from tessera.functions import text as X
from tessera.operators import lineage, propagation, relational
from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def test_impact_of_a_requirement(spark):
    """The small world of a battery pack: scores worked out by hand."""
    e = spark.createDataFrame([("arch", "req", "IMPLEMENTS", 0.9, 0.9), ("req", "decision", "CONSTRAINS", 0.9, 0.9), ("decision", "arch", "BASED_ON", 0.9, 0.9), ("obs", "pack", "ABOUT", 0.6, 0.9), ("req", "pack", "ABOUT", 0.6, 0.9)], "source string, target string, type string, weight double, confidence double")
    seeds = spark.createDataFrame([("req", 1.0)], "id string, magnitude double")
    got = {r["id"]: (r["score"], r["depth"]) for r in propagation.impact(propagation.propagation(e), seeds).collect()}
    assert got == {"decision": (1.0, 1), "arch": (0.567, 1), "pack": (0.189, 1), "obs": (0.0357, 2)}


def test_impact_against_best_first_search(spark):
    import heapq
    import random

    rng = random.Random(5)
    g = {(str(a), str(b)): round(rng.uniform(0.2, 0.9), 3) for a in range(7) for b in range(7) if a != b and rng.random() < 0.4}
    pops, scores, heap, seen = {}, {}, [(-1.0, 0, ("0",))], set()
    while heap:
        s, depth, path = heapq.heappop(heap)
        v = path[-1]
        if pops.get(v, 0) >= 3:
            continue
        pops[v] = pops.get(v, 0) + 1
        if depth:
            scores[v] = scores.get(v, 0) - s
        for (a, b), w in g.items():
            if a == v and b not in path and -s * w >= 0.02 and depth < 4:
                heapq.heappush(heap, (s * w, depth + 1, (*path, b)))
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in g.items()], "u string, v string, influence double")
    got = {r["id"]: r["score"] for r in propagation.impact(graph, spark.createDataFrame([("0", 1.0)], "id string, magnitude double"), depth=4).collect()}
    assert got == pytest.approx({k: min(1, v) for k, v in scores.items()}, abs=1e-4)


def test_quantities(spark):
    df = spark.createDataFrame([(50000.0, 31000.0), (31000.0, 50000.0), (0.0, 0.0), (0.0, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(F.round(Q.relative_delta(F.col("a"), F.col("b")), 4)).collect()]
    assert got == [-0.38, 0.6129, None, 1.0]
    ok = spark.createDataFrame([(180.0, "LT", 100.0), (55.0, "LTE", 60.0), (None, "GTE", 1.0)], "v double, o string, b double").select(Q.satisfies(F.col("v"), F.col("o"), F.col("b")))
    assert [r[0] for r in ok.collect()] == [False, True, None]


def test_text_and_links(spark):
    r = spark.createDataFrame([("  The ACME, Inc. ", "<h2>A</h2><script>x</script><p>b &amp; c</p>")], "n string, h string").select(X.normalise(F.col("n")), X.slugify(F.col("n")), X.strip_html(F.col("h"))).first()
    assert r[0] == "acme" and r[1] == "the-acme-inc" and "## A" in r[2] and "b & c" in r[2] and "x" not in r[2]
    e = spark.createDataFrame([("a", "b", "T", 1.0, 1.0)], "source string, target string, type string, weight double, confidence double")
    n = spark.createDataFrame([("a", "b", "T", 1.0, 1.0), ("a", "a", "T", 1.0, 1.0), ("b", "a", "T", 0.5, 1.0), ("b", "a", "T", 0.7, 1.0)], e.schema)
    assert [tuple(r) for r in relational.link_if_absent(e, n).collect()] == [("b", "a", "T", 0.7, 1.0)]


def test_stream_of_files(spark, tmp_path):
    from tessera.streaming import ingest

    inbox, table = tmp_path / "in", tmp_path / "table"
    inbox.mkdir()
    (inbox / "a.md").write_text("# One\ntext\n\nmore")
    (inbox / ".hidden.md").write_text("no")
    ingest.start(spark, str(inbox), str(table), str(tmp_path / "cp")).awaitTermination()
    (inbox / "b.md").write_text("more\n\nnew")
    ingest.start(spark, str(inbox), str(table), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(table)).select("chunk").collect()) == ["# One\ntext", "more", "new"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    order = ", ".join(f'"{c}"' for c in got.columns)
    norm = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else str(v) if hasattr(v, "year") else v for v in r) for r in rows), key=str)
    assert norm(map(tuple, got.collect())) == norm(con.sql(f"select {order} from ({registry.ORACLES[name]}) q").fetchall()), want


def test_dates_and_authority(spark):
    raw = ["2024-03-05", "2024/3/5", "05-03-2024", "5/3/2024", "2024-03", "2024", "2024-03-05T10:00:00Z", "2024-13-40", "soon", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = [r[0] for r in df.select("i", F.date_format(X.parse_date(F.col("x")), "yyyy-MM-dd HH").alias("t")).orderBy("i").select("t").collect()]
    assert got == ["2024-03-05 00"] * 4 + ["2024-03-01 00", "2024-01-01 00", "2024-03-05 10"] + [None] * 4
    names = spark.createDataFrame([("iso-1.md", ""), ("supplier-contract.md", "a report"), ("x.md", None), (None, "draft")], "n string, t string")
    assert sorted(r[0] for r in names.select(X.authority(F.col("n"), F.col("t"))).collect()) == [0.55, 0.65, 0.88, 0.95]


def test_retired_evidence_and_basis(spark):
    n = spark.createDataFrame([("e", "Evidence", "SUPPORTED", 0.8), ("c", "Claim", "CONTESTED", 0.1), ("d", "Decision", "SUPERSEDED", 0.8), ("k", "Claim", "SUPPORTED", None)], "id string, type string, status string, confidence double")
    got = {r.id: (r.status, r.confidence) for r in lineage.retire(n, F.col("id") != "k").collect()}
    assert got == {"e": ("INVALIDATED", 0.8), "c": ("UNVERIFIED", 0.1), "d": ("SUPERSEDED", 0.8), "k": ("SUPPORTED", None)}
    e = spark.createDataFrame([("d", "c", "BASED_ON"), ("c", "d", "CONSTRAINS"), ("e", "d", "CONSTRAINS"), ("c", "e", "BASED_ON")], "source string, target string, type string")
    assert {tuple(r) for r in lineage.decision_basis(n, e).collect()} == {("d", "c", "BASED_ON"), ("d", "e", "CONSTRAINS")}


def test_only_reading_statements(spark):
    assert lineage.read_only(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x WHERE 'drop it' <> ''").first()[0] == 1
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "/* select */ delete from t"):
        with pytest.raises(ValueError):
            lineage.read_only(spark, bad)


#: Queries on the propagation view or a graph like it.
DEALT = ["propagation_graph", "neighbourhood"]


@pytest.mark.parametrize("name", DEALT)
def test_parts_follow_the_edges(spark, monkeypatch, name):
    """Edges and the view are dealt in a given number of parts, more of them for more edges, which Spark does not join into larger ones."""
    from tessera.operators import cut as C

    monkeypatch.setattr(C, "PART", 1 << 12)
    plans, kept = [], propagation.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(propagation, "cut", seen)
    plans.append(registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    given = [int(x.rsplit(", ", 1)[-1]) for p in plans for x in re.findall(r"hashpartitioning\(([^)]*)\), REPARTITION_BY_NUM", p)]
    assert given and min(given) > 4


def test_parts_of_rows_without_a_size(spark):
    from tessera.operators.cut import dealt

    e = spark.createDataFrame([("a", "b", "ABOUT", 0.6, 0.9)], "source string, target string, type string, weight double, confidence double")
    assert dealt(e, "source").rdd.getNumPartitions() == 4 and propagation.propagation(e).rdd.getNumPartitions() == 4
