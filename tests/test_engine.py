"""Operators without a query of their own, on small worlds worked out by hand; attacks on reading statements; replayed batches."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import quantity as Q
from tessera.functions import text as X
from tessera.functions import units as U
from tessera.operators import extract, lineage, propagation, reconcile, relational, whatif

VALUES = [
    ("50,000 units/month", 50000.0, "unit/month"), ("50k units per month", 50000.0, "unit/month"), ("70 degC", 70.0, "degC"), ("70 C", 70.0, "degC"), ("158 F", 70.0, "degC"), ("180 ms", 180.0, "ms"), ("2.5 s", 2500.0, "ms"),
    ("14 days", 1209600000.0, "ms"), ("20 lakh", 2000000.0, None), ("₹20 lakh", 2000000.0, "INR"), ("3120 INR", 3120.0, "INR"), ("99 percent", 99.0, "%"), ("-5 km", -5000.0, "m"), ("none", None, None), (None, None, None), ("", None, None),
]


def test_values(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(VALUES)], "i int, v string").select("i", U.parse_value(F.col("v")).alias("p")).orderBy("i")
    assert [(r.p.number and round(r.p.number, 6), r.p.unit) for r in df.collect()] == [(n, u) for _, n, u in VALUES]
    def parsed(rows, extra):
        raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a string, b string{extra}")
        got = raw.withColumns({"a": U.parse_value(F.col("a")), "b": U.parse_value(F.col("b"))})
        return spark.createDataFrame(got.collect(), got.schema).orderBy("i")

    cases = [("180 ms", "100 ms", "LT", False), ("68 C", "60 C", "LTE", False), ("55 C", "60 C", "LTE", True), ("99.3 %", "99 %", "GTE", True), ("70 C", "100 ms", "LT", None), ("5 kg", "6 kg", "NEQ", True), ("yes", "supported", "EQ", True), ("yes", "no", "GT", True)]
    ok = parsed([c[:3] for c in cases], ", o string").select(Q.value_satisfies(F.col("a"), F.col("o"), F.col("b"))).collect()
    assert [r[0] for r in ok] == [c[3] for c in cases]
    kinds = [("50000 units", "31000 units", "DECREASED"), ("50000 units", "50100 units", "UNCHANGED"), ("5 kg", "5 ms", "UNIT_CHANGED"), ("yes", "no", "FLIPPED"), ("red", "blue", "TEXT_REFINED")]
    got = [r.c for r in parsed([k[:2] for k in kinds], "").select(Q.change(F.col("a"), F.col("b")).alias("c")).collect()]
    assert [c.kind for c in got] == [k for *_, k in kinds] and got[0].delta == -0.38 and [c.material for c in got] == [True, False, True, True, False]
    t = F.lit("2024-01-01").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert spark.range(1).select(Q.temporal_validity(none, none, t), Q.temporal_validity(t, none, t), Q.temporal_validity(t, t, t), Q.temporal_validity(none, t - F.expr("interval 1 day"), t)).first()[:] == (0.6, 0.9, 1.0, 0.0)


def test_names_and_similarity(spark):
    df = spark.createDataFrame([("Acme Limited", "AT&T  Corp", "Café X")], "a string, b string, c string")
    assert df.select(X.normalise(F.col("a")), X.slugify(F.col("b")), X.normalise(F.col("c")), X.slugify(F.lit("?!"))).first()[:] == ("acme", "att-corp", "café x", "untitled")
    assert df.select(X.lexical_similarity(F.lit("Pack BP-7"), F.lit("Battery Pack BP-7")), X.lexical_similarity(F.lit("a"), F.lit("")), X.type_agreement(F.lit("Supplier"), F.lit("vendor")), X.type_agreement(F.lit("a"), F.lit("b"))).first()[:] == (0.85, 0.0, 0.85, 0.15)
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert df.select(X.cosine(zero, zero), X.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))).first()[:] == (0.0, 0.0)
    assert df.select(X.strip_html(F.lit("<h2>A</h2><p>b &amp;lt; &#233;&#x20AC;"))).first()[0] == "\n## A\n\nb &lt; é€"


def test_records_of_a_change(spark):
    text = "UNECE R100 was amended and the limit was reduced from\n70 degC to 60 degC. It applies now. More is said here. Nothing is 5 kg.\n\n## Phase 2 is 9 kg\n"
    got = extract.extract(spark.createDataFrame([("a", text, "Default X"), ("b", None, None), ("c", "Phase 2 depends on Thermal Architecture A7.", None)], "id string, text string, default_subject string")).collect()
    assert [(r.id, r.n, r.record, r.subject, r.value, r.confidence) for r in got] == [("a", 1, "event", "UNECE R100", None, 0.65), ("a", 1, "claim", "UNECE R100", "60", 0.68), ("a", 4, "claim", "Default X", "5", 0.53), ("c", 1, "relationship", "Phase 2", None, 0.6)]


def test_resolution_needs_context(spark):
    e = spark.createDataFrame([("e1", "Battery Pack BP-7", ["the pack"], "component", ["n1", "n2"]), ("e2", "Other Thing", None, None, None)], "id string, label string, aliases array<string>, kind string, neighbours array<string>")
    n = spark.createDataFrame([("THE  pack", None, None), ("Battery Pack BP-7, Inc", None, None), ("Pack BP-7", "system", ["n1", "n2"]), ("Pack BP-7", "system", []), ("zz", None, None), (None, None, None)], "name string, kind string, context array<string>")
    sim = spark.createDataFrame([("Pack BP-7", "e1", 1.0)], "name string, id string, semantic double")
    got = {(r.name, r.decision): r.id for r in reconcile.resolve(n.where("context is null or size(context) = 2"), e, sim).collect()}
    assert got[("THE  pack", "match")] == got[("Battery Pack BP-7, Inc", "match")] == got[("Pack BP-7", "match")] == "e1" and got[("zz", "new")] is None and (None, "new") in got
    assert {r.decision for r in reconcile.resolve(n.where("size(context) = 0"), e, sim).collect()} == {"review"}
    rel = spark.createDataFrame([("Local", "the PACK", "ABOUT"), ("nobody", "Local", "ABOUT"), ("local", "LOCAL", "ABOUT")], "source string, target string, type string")
    assert [tuple(r) for r in reconcile.resolve_relations(rel, spark.createDataFrame([("local", "l1")], "label string, id string"), reconcile.entity_keys(e)).collect()] == [("l1", "e1", "ABOUT")]


def test_corroboration_and_verdicts(spark):
    n = spark.createDataFrame([("a", "CONTESTED", 0.95, ["x"]), ("b", "SUPERSEDED", 0.5, None), ("c", "PROBABLE", 0.5, ["x"])], "id string, status string, confidence double, sources array<string>")
    got = {r.id: r for r in reconcile.corroborate(n, spark.createDataFrame([("a", "y"), ("b", "y"), ("c", "x")], "id string, path string")).collect()}
    assert (got["a"].status, got["a"].confidence, got["a"].sources) == ("SUPPORTED", 0.99, ["x", "y"]) and got["b"].status == "SUPERSEDED" and (got["c"].status, got["c"].confidence) == ("PROBABLE", 0.5)
    c = spark.createDataFrame([("r", "o", "o", "CONSTRAINT", 0.5), ("a", "c", "a", "NUMERIC", 0.4)], "left_id string, right_id string, winner string, kind string, severity double")
    m = spark.createDataFrame([(i, "SUPPORTED") for i in "rocab"], "id string, status string")
    assert {r.id: r.status for r in reconcile.apply_verdicts(m, c).collect()} == {"r": "SUPPORTED", "o": "CONTESTED", "a": "SUPPORTED", "c": "CONTRADICTED", "b": "SUPPORTED"}
    assert {(r.source, r.target) for r in reconcile.verdict_edges(c).collect()} == {("o", "r"), ("c", "a")}


def test_leverage_of_doubts(spark):
    e = spark.createDataFrame([(f"d{i}", "one", "BASED_ON", 0.9, 0.9) for i in range(4)], "source string, target string, type string, weight double, confidence double")
    doubts = spark.createDataFrame([("one", 0.42, "UNVERIFIED"), ("two", 0.42, "UNVERIFIED"), *((f"d{i}", 0.2, "SUPPORTED") for i in range(4))], "id string, uncertainty double, status string")
    top = propagation.validation_queue(propagation.propagation(e), doubts).collect()
    assert top[0].id == "one" and top[0].gain == round(0.42 + 4 * 0.2 * 0.6885, 4) and top[1].id == "two"


def test_rank_settles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    g = {(f"n{a}", f"n{b}"): float(rng.uniform(0.1, 1)) for a, b in rng.integers(0, 8, (16, 2)) if a != b}
    ids = [f"n{i}" for i in range(8)]
    m = np.zeros((8, 8))
    for (u, v), w in g.items():
        m[ids.index(v), ids.index(u)] = w
    total = m.sum(axis=1, keepdims=True)
    p = np.where(total > 0, m / np.where(total > 0, total, 1), 1 / 8)
    r = np.full(8, 1 / 8)
    for _ in range(12):
        r = 0.85 * r @ p + 0.15 / 8
    got = {x.id: x.rank for x in propagation.pagerank(spark.createDataFrame([(*k, w) for k, w in g.items()], "u string, v string, influence double"), spark.createDataFrame([(i,) for i in ids], "id string"), rounds=12, tolerance=0.0).collect()}
    assert [got[i] for i in ids] == pytest.approx(r.tolist(), abs=1e-6)


def test_writers_and_scenarios(spark):
    e = spark.createDataFrame([("a", "b", "DEPENDS_ON", 0.9, 0.9)], "source string, target string, type string, weight double, confidence double")
    assert whatif.with_dependency(e, "a", "b").count() == 1 and whatif.with_dependency(e, "a", "c").count() == 2 and whatif.without_dependency(e, "a", "b").count() == 0
    assert [r.target for r in whatif.redirected(e, "a", "b", "z").collect()] == ["z"] and whatif.redirected(e, "a", "b", "a").count() == 0
    ev = spark.createDataFrame([("x", "MOVED", "y", 1), ("z", "MODIFIED", None, 2)], "path string, kind string, new_path string, at int")
    assert {tuple(r) for r in relational.moves(ev).collect()} == {("x", "DELETED", 1), ("y", "CREATED", 1), ("z", "MODIFIED", 2)}
    n = spark.createDataFrame([("a", [("p", 0.9), ("p", 0.4)]), ("b", None)], "id string, provenance array<struct<path:string,authority:double>>")
    assert [r.id for r in relational.from_source(n, "p").collect()] == ["a"]
    n = n.withColumn("provenance", F.transform("provenance", lambda p: F.struct(p["path"].alias("path"), p["authority"].alias("authority"), F.lit(1).alias("observed_at"))))
    assert {(r.id, r.sources, r.authority) for r in relational.evidence_counts(n, e).collect()} == {("a", 1, 0.9), ("b", None, 0.5)}


def test_reading_statements_are_checked(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("numbers")
    assert lineage.read_only(spark, "WITH x AS (SELECT max(id) AS m FROM numbers) SELECT m AS `set` FROM x WHERE m IN (SELECT id FROM numbers)").first()[0] == 2
    (tmp_path / "secret").write_text("s")
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT `reflect`('java.lang.System', 'nanoTime')", f"SELECT * FROM text.`{tmp_path}/secret`", f"SELECT (SELECT max(value) FROM text.`{tmp_path}/secret`) AS v", f"WITH x AS (SELECT * FROM text.`{tmp_path}/secret`) SELECT * FROM x", "SELECT java_method('java.lang.System', 'nanoTime')"):
        with pytest.raises(ValueError):
            lineage.read_only(spark, bad)


def test_replayed_batch_keeps_its_rows(spark, tmp_path):
    from tessera.streaming import ingest

    inbox, table, cp = tmp_path / "in", tmp_path / "table", tmp_path / "cp"
    inbox.mkdir()
    (inbox / "a.md").write_text("# One\ntext\n\nmore")
    ingest.start(spark, str(inbox), str(table), str(cp)).awaitTermination()
    (inbox / "b.md").write_text("more\n\nnew")
    ingest.start(spark, str(inbox), str(table), str(cp)).awaitTermination()
    want = sorted(r[0] for r in spark.read.parquet(str(table)).select("chunk").collect())
    (cp / "commits" / "1").unlink()
    (cp / "commits" / ".1.crc").unlink(missing_ok=True)
    ingest.start(spark, str(inbox), str(table), str(cp)).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(table)).select("chunk").collect()) == want == ["# One\ntext", "more", "new"]


def test_cues_are_looked_for_before_patterns(spark):
    """What a match needs is found in every text that fits, whatever the case, and texts come in as many parts as a shuffle has."""
    rules = [p for rs in (extract.COMPARATORS, extract.PREDICATES, extract.RELATIONS) for p, _ in rs] + [extract.REQUIREMENT, extract.DECISION, extract.EVENT, extract.RISK, extract.OBSERVATION, extract.ASSUMPTION]
    assert all(map(extract.needed, rules)) and extract.needed("^[CF]$|x") == [] and extract.needed("go(?:ing)? with|A+b?") == [" with", "a"]
    said = ["It MUST not Exceed 5 kg", "Going With it", "the ROUND-trip time", "Jeopardising x", "superseded by", "Maximum Temperature", "charging  rate", "no cue", "testing showed", "distance per charge", "reKuires ſhall", "", None]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    t = F.col("t")
    both = df.select(*(F.coalesce(F.concat(extract.says(t, F.lower(t), p).cast("string"), F.lit(" "), t.rlike("(?i)" + p).cast("string")), F.lit("false false")) for p in rules)).collect()
    assert {x for r in both for x in r} == {"true true", "false false"}
    one = spark.createDataFrame([(i, "The pack must not exceed 5 kg. It weighs 4 kg.", "Pack A") for i in range(40)], "id int, text string, default_subject string").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = extract.extract(one)
        assert got.rdd.getNumPartitions() == 4 and got.count() == 80
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
