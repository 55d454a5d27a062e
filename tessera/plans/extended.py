"""Queries over text, reconciliation, resolution, counterfactuals and writers, each with SQL that is built from what the rows were made of."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units as U
from ..functions.text import lexical_similarity, sentences, title
from ..operators import beliefs, extract, propagation, reconcile, relational, whatif
from ..sources.graph import DEAD, NOW, STATUSES, edges, nodes, observations, read

S = SparkSession

#: How a part's number is written, what number and unit that is, and as SQL.
FORMS = [
    ("{} days", "p_size * 86400000.0::DOUBLE", "'ms'"), ("{}k units per month", "p_size * 1000.0::DOUBLE", "'unit/month'"), ("-{} F", "(-p_size - 32.0::DOUBLE) * 5 / 9", "'degC'"),
    ("₹{} lakh", "p_size * 100000.0::DOUBLE", "'INR'"), ("{} percent", "p_size::DOUBLE", "'%'"), ("deprecated", "NULL", "NULL"), ("{},000 kg", "p_size * 1000.0::DOUBLE", "'kg'"), ("none told", "NULL", "NULL"),
]


def _raw(p: DataFrame) -> DataFrame:
    k = (F.col("p_partkey") % len(FORMS)).cast("int")
    forms = F.array(*(F.concat(F.lit(f.partition("{}")[0]), F.col("p_size").cast("string"), F.lit(f.partition("{}")[2])) if "{}" in f else F.lit(f) for f, _, _ in FORMS))
    return p.select("p_partkey", F.element_at(forms, k + 1).alias("raw"))


def parse_value(s: S, d: str) -> DataFrame:
    v = _raw(read(s, d, "part")).withColumn("v", U.parse_value(F.col("raw")))
    return v.select("p_partkey", F.round("v.number", 6).alias("number"), F.col("v.unit").alias("unit"), F.col("v.boolean").alias("boolean"), F.col("v.text").alias("text"))


_TEXT = ("# Sheet of Part BP-7\n\nBattery Pack BP-", " has a capacity of ", " units per month. Measured temperature reached ", " degC\nin the field. The limit must not exceed ", " degC. We selected it because it is cheap; The lead time is ", " days. A severe hazard remains. Phase 2 depends on Thermal Architecture A7.\n\n***\nToo few.")


def _sheets(s: S, d: str) -> DataFrame:
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    parts = [F.lit(t) for t in _TEXT]
    return read(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(parts[0], k, parts[1], n, parts[2], n, parts[3], n, parts[4], n, parts[5]).alias("text"), F.lit(None).cast("string").alias("default_subject"))


def split_sentences(s: S, d: str) -> DataFrame:
    return _sheets(s, d).select("id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence")).select("id", (F.col("n") + 1).alias("n"), "sentence")


def claims(s: S, d: str) -> DataFrame:
    out = extract.extract(_sheets(s, d))
    return out.select("id", "n", "record", "kind", "subject", "predicate", "operator", "value", "unit", "confidence", "severity", "rationale", "related")


def principal_subjects(s: S, d: str) -> DataFrame:
    return extract.principal_subject(extract.extract(_sheets(s, d)))


def titles(s: S, d: str) -> DataFrame:
    """Of sheets, every other one without its heading."""
    t = F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.lit("no heading"))
    return _sheets(s, d).select("id", title(F.concat(F.lit("in/part-sheet_"), F.col("id").cast("string"), F.lit(".md")), t).alias("title"))


def _claims_of(s: S, d: str) -> DataFrame:
    o = observations(s, d)
    fp = F.concat_ws("|", "subject", "predicate", F.floor("number").cast("string"))
    value = F.struct(F.col("number").cast("string").alias("raw"), F.col("number").alias("number"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("boolean").alias("boolean"), F.lit(None).cast("string").alias("text"))
    return o.select("id", "event_id", fp.alias("fp"), "subject", "predicate", value.alias("value"), "valid_from", "status")


def reconcile_claims(s: S, d: str) -> DataFrame:
    """Every fifth observation as a new batch against all others."""
    c = _claims_of(s, d)
    return reconcile.reconcile_claims(c.where("event_id % 5 <> 0"), c.where("event_id % 5 = 0"))


def verdict_status(s: S, d: str) -> DataFrame:
    o = observations(s, d)
    found = beliefs.conflicts(o, F.lit(NOW).cast("timestamp_ntz")).withColumn("kind", F.lit("SEMANTIC"))
    return reconcile.apply_verdicts(o.select("id", "status"), found).select("id", "status")


def invalidated_nodes(s: S, d: str) -> DataFrame:
    o = observations(s, d)
    gone = o.where("predicate = 'error'").select("id")
    out = reconcile.invalidate(o.select("id", "status", "valid_until"), gone, F.lit("2024-01-15").cast("timestamp_ntz"))
    return out.select("id", "status", F.col("valid_until").cast("date").alias("until"))


def entity_lookup(s: S, d: str) -> DataFrame:
    e = read(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.array(F.concat(F.lit("  The  "), F.col("n_name"))).alias("aliases"))
    return reconcile.entity_keys(e)


def resolved_names(s: S, d: str) -> DataFrame:
    """Names in lower case (exact), with a legal form (normalised), and unknown ones, against nations."""
    n = read(s, d, "nation")
    e = n.select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.array().cast("array<string>").alias("aliases"), F.lit("company").alias("kind"), F.array().cast("array<string>").alias("neighbours"))
    k = F.col("n_nationkey") % 3
    names = n.select(F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit("The "), F.col("n_name"), F.lit(", Ltd."))).otherwise(F.concat(F.lit("zz"), F.col("n_nationkey").cast("string"))).alias("name"), F.lit("supplier").alias("kind"), F.array().cast("array<string>").alias("context"))
    return reconcile.resolve(names, e).select("name", "decision", "id", "score")


def written_edges(s: S, d: str) -> DataFrame:
    """New edges between every customer and its number's nation, where both ends are there, over the old ones."""
    old = edges(s, d).where("type = 'OWNED_BY'").withColumn("id", F.concat_ws("-", "source", "target"))
    new = read(s, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("source"), F.concat(F.lit("N"), (F.col("c_custkey") % 50).cast("string")).alias("target"), F.lit("ABOUT").alias("type"), F.lit(0.6).alias("weight"), F.lit(0.9).alias("confidence"))
    new = new.withColumn("id", F.concat_ws("-", "source", "target")).select(old.columns)
    return relational.upsert_edges(old, new, nodes(s, d)).select("id", "type", "weight")


def deleted_cascade(s: S, d: str) -> DataFrame:
    """Edges that stay after suppliers of even number are deleted."""
    n = nodes(s, d)
    gone = read(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("id"))
    return relational.delete_nodes(n, edges(s, d), gone)[1].select("source", "target", "type")


def node_search(s: S, d: str) -> DataFrame:
    return relational.search(nodes(s, d), "00", ("Entity",), ("SUPPORTED", "PROBABLE"), 10, 40).select("id", "label", "total")


def event_feed(s: S, d: str) -> DataFrame:
    e = read(s, d, "events").select(F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    return relational.feed(e, ("error", "purchase"), 50).select("id", "type")


def nearest_vectors(s: S, d: str) -> DataFrame:
    e = read(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).first()["embedding"]
    return relational.nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"), q, 10, F.col("label") < 5)


def curated_links(s: S, d: str) -> DataFrame:
    spec = s.createDataFrame([("0001", "urgent", "AFFECTS", 0.9, 0.8), ("nobody", "0001", "ABOUT", 0.5, 0.5)], "`from` string, `to` string, edge string, weight double, confidence double")
    return relational.curated(spec, nodes(s, d).select("id", "label"))


def upstream(s: S, d: str) -> DataFrame:
    seeds = nodes(s, d).where("id in ('O1', 'O2', 'O3')").select("id")
    return propagation.upstream(propagation.propagation(edges(s, d)), seeds, 3).select("seed", "id", "depth")


def strongest_paths(s: S, d: str) -> DataFrame:
    seeds = nodes(s, d).where("id in ('S1', 'S2')").select("id")
    return propagation.strongest_paths(propagation.propagation(edges(s, d)), seeds, 3).select("seed", "id", F.round("strength", 6).alias("strength"))


def _beliefs(s: S, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 4).cast("int")
    return read(s, d, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.when(F.col("p_size") > 45, "Risk").otherwise("Claim").alias("type"), F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("status"),
        ((F.col("p_partkey") % 90 + 10) / 100.0).alias("confidence"), F.element_at(F.array(*map(F.lit, ("unit cost", "lead time", "capacity", "throughput"))), k + 1).alias("predicate"), F.col("p_retailprice").alias("number"), F.lit(0.5).alias("severity"), F.lit(0.6).alias("criticality"), "p_size",
    )


def scenario_deltas(s: S, d: str) -> DataFrame:
    """What the dimensions become if the claims of large parts are invalid."""
    n, none = _beliefs(s, d), edges(s, d).limit(0)
    open_ = s.createDataFrame([], "kind string")
    after = whatif.invalidated(n, F.col("p_size") > 25)
    before, then = (whatif.measure(x, none, open_) for x in (n, after))
    return whatif.deltas(before, then).where("name in ('cost', 'schedule', 'capacity', 'throughput', 'live_beliefs', 'risk_exposure', 'health_score')").select("name", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"), "direction")


def scenario_ranking(s: S, d: str) -> DataFrame:
    n = read(s, d, "nation")
    k = F.col("n_nationkey")
    return whatif.compare(n.select(F.col("n_name").alias("scenario"), (60.0 + k % 7).alias("health"), (k % 3).alias("new_contradictions"), (k % 2).alias("newly_at_risk"), (k % 5).alias("resolved_decisions"), (k % 4).alias("resolved_contradictions"), (k % 6 / 10).alias("risk")))


def decisions_at_risk(s: S, d: str) -> DataFrame:
    return whatif.at_risk(nodes(s, d), edges(s, d))


def set_changes(s: S, d: str) -> DataFrame:
    """Decisions at risk after customers of even number are invalid, against now."""
    n, e = nodes(s, d), edges(s, d)
    after = whatif.invalidated(n, F.col("id").startswith("C") & (F.substring("id", 2, 20).try_cast("long") % 2 == 0))
    return whatif.set_changes(whatif.at_risk(n, e), whatif.at_risk(after, e))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (parse_value, split_sentences, claims, principal_subjects, titles, reconcile_claims, verdict_status, invalidated_nodes, entity_lookup, resolved_names, written_edges, deleted_cascade, node_search, event_feed, nearest_vectors, curated_links, upstream, strongest_paths, scenario_deltas, scenario_ranking, decisions_at_risk, set_changes)
}


def oracles(obs: str, node: str, edge: str, graph: str, conflicts: str) -> dict[str, str]:
    """SQL by query, over the views that the registry's other queries share."""
    case = lambda i: "CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN {f[i]}" for n, f in enumerate(FORMS)) + " END"
    said = [
        "'Battery Pack BP-' || k || ' has a capacity of ' || n || ' units per month.'", "'Measured temperature reached ' || n || ' degC in the field.'", "'The limit must not exceed ' || n || ' degC.'",
        "'We selected it because it is cheap;'", "'The lead time is ' || n || ' days.'", "'A severe hazard remains.'", "'Phase 2 depends on Thermal Architecture A7.'",
    ]
    who = "'Battery Pack BP-' || k"
    null, rows = "NULL::VARCHAR", []
    rows += [(1, "'claim'", "'Claim'", who, "'capacity'", null, "n", "'units per month'", "0.65", "NULL", null, null)]
    rows += [(2, "'claim'", "'Observation'", who, "'max operating temperature'", null, "n", "'degC'", "0.7", "NULL", null, null)]
    rows += [(3, "'constraint'", "'Requirement'", who, "'max operating temperature'", "'LTE'", "n", "'degC'", "0.72", "NULL", null, null)]
    rows += [(4, "'decision'", "'Decision'", "''", null, null, null, null, "0.62", "NULL", "'it is cheap;'", null)]
    rows += [(6, "'risk'", "'Risk'", "''", null, null, null, null, "0.55", "0.6", null, null)]
    rows += [(7, "'relationship'", "'DEPENDS_ON'", "'Phase 2'", null, null, null, null, "0.6", "NULL", null, "'Thermal Architecture A7'")]
    names = ("n_", "record", "kind", "subject", "predicate", "operator", "value", "unit", "confidence", "severity", "rationale", "related")
    made = " UNION ALL ".join("SELECT k_ AS id, " + ", ".join(f"{'(' + str(v) + ')'}{'::DOUBLE' if c in ('confidence', 'severity') else '::INT' if c == 'n_' else ''} AS {'n' if c == 'n_' else c}" for c, v in zip(names, r, strict=True)) + " FROM p" for r in rows)
    p = "p AS (SELECT p_partkey AS k_, p_partkey::VARCHAR AS k, p_size::VARCHAR AS n FROM part)"
    dead = "(" + ", ".join(f"'{x}'" for x in DEAD) + ")"
    delta = "CASE WHEN was = 0 THEN CASE WHEN number <> 0 THEN 1.0::DOUBLE END ELSE (number - was) / abs(was) END"
    status = "[" + ", ".join(f"'{x}'" for x in STATUSES) + "]"
    return {
        "parse_value": f"SELECT p_partkey, round({case(1)}, 6) AS number, {case(2)} AS unit, CASE WHEN p_partkey % 8 = 5 THEN false END AS boolean, CASE p_partkey % 8 WHEN 5 THEN 'deprecated' WHEN 7 THEN 'none told' END AS text FROM part",
        "split_sentences": f"WITH {p} " + " UNION ALL ".join(f"SELECT k_ AS id, {i}::INT AS n, {t} AS sentence FROM p" for i, t in enumerate(said, 1)),
        "claims": f"WITH {p} {made}",
        "principal_subjects": "SELECT p_partkey AS id, 'Battery Pack BP-' || p_partkey AS subject FROM part",
        "titles": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Sheet of Part BP-7' ELSE 'Part Sheet ' || p_partkey END AS title FROM part",
        "reconcile_claims": f"""WITH {obs}, c AS (SELECT *, subject || '|' || predicate || '|' || floor(number)::BIGINT AS fp FROM o), h AS (SELECT * FROM c WHERE event_id % 5 <> 0),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY id) AS r FROM c WHERE event_id % 5 = 0) WHERE r = 1), f AS (SELECT fp, min(id) AS known FROM h GROUP BY fp),
b AS (SELECT * FROM (SELECT subject, predicate, id AS wid, number AS was, row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, id DESC) AS r FROM h WHERE status NOT IN {dead}) WHERE r = 1),
j AS (SELECT w.id, w.number, known, wid, was, {delta} AS delta FROM w LEFT JOIN f USING (fp) LEFT JOIN b USING (subject, predicate)),
k AS (SELECT *, CASE WHEN known IS NOT NULL THEN NULL WHEN wid IS NULL THEN 'NEW' WHEN coalesce(abs(delta) > 0.02::DOUBLE, false) THEN CASE WHEN delta > 0 THEN 'INCREASED' ELSE 'DECREASED' END ELSE 'UNCHANGED' END AS change FROM j),
m AS (SELECT *, CASE change WHEN 'NEW' THEN 0.6::DOUBLE WHEN 'UNCHANGED' THEN 0.0::DOUBLE WHEN 'INCREASED' THEN round(abs(delta) / (abs(delta) + 0.35::DOUBLE), 4) WHEN 'DECREASED' THEN round(abs(delta) / (abs(delta) + 0.35::DOUBLE), 4) END AS magnitude FROM k)
SELECT id, CASE WHEN known IS NULL THEN 'inserted' ELSE 'corroborated' END AS outcome, coalesce(known, wid) AS against, change, CASE WHEN change IN ('INCREASED', 'DECREASED') THEN round(delta, 4) END AS delta, magnitude, CASE WHEN change <> 'UNCHANGED' THEN greatest(magnitude, 0.35::DOUBLE) END AS seed FROM m""",
        "verdict_status": f"""WITH {obs}, cf AS ({conflicts}), t AS (SELECT left_id AS id, CASE WHEN winner = 'contested' THEN 1 WHEN winner = left_id THEN 0 ELSE 2 END AS r FROM cf UNION ALL SELECT right_id, CASE WHEN winner = 'contested' THEN 1 WHEN winner = right_id THEN 0 ELSE 2 END FROM cf),
x AS (SELECT id, max(r) AS r FROM t GROUP BY id) SELECT o.id, CASE WHEN r IS NOT NULL AND status NOT IN {dead} THEN (['SUPPORTED', 'CONTESTED', 'CONTRADICTED'])[r + 1] ELSE status END AS status FROM o LEFT JOIN x USING (id)""",
        "invalidated_nodes": f"WITH {obs} SELECT id, CASE WHEN predicate = 'error' THEN 'INVALIDATED' ELSE status END AS status, CASE WHEN predicate = 'error' THEN least(coalesce(valid_until, TIMESTAMP '2024-01-15'), TIMESTAMP '2024-01-15') ELSE valid_until END::DATE AS until FROM o",
        "entity_lookup": "SELECT lower(n_name) AS key, 'N' || n_nationkey AS id FROM nation UNION ALL SELECT 'the ' || lower(n_name), 'N' || n_nationkey FROM nation",
        "resolved_names": "SELECT CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'The ' || n_name || ', Ltd.' ELSE 'zz' || n_nationkey END AS name, CASE WHEN n_nationkey % 3 < 2 THEN 'match' ELSE 'new' END AS decision, CASE WHEN n_nationkey % 3 < 2 THEN 'N' || n_nationkey END AS id, (CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.98 ELSE 0 END)::DOUBLE AS score FROM nation",
        "written_edges": f"""WITH {edge}, w AS (SELECT 'C' || c_custkey || '-N' || (c_custkey % 50) AS id FROM customer WHERE c_custkey % 50 IN (SELECT n_nationkey FROM nation)), b AS (SELECT source || '-' || target AS id, type, weight FROM e WHERE type = 'OWNED_BY')
SELECT * FROM b WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, 'ABOUT', 0.6::DOUBLE FROM w""",
        "deleted_cascade": f"WITH {edge}, g AS (SELECT 'S' || s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0) SELECT source, target, type FROM e WHERE source NOT IN (SELECT id FROM g) AND target NOT IN (SELECT id FROM g)",
        "node_search": f"WITH {node}, h AS (SELECT * FROM n WHERE type = 'Entity' AND status IN ('SUPPORTED', 'PROBABLE') AND contains(lower(label), '00')) SELECT id, label, (SELECT count(*) FROM h) AS total FROM h ORDER BY id LIMIT 40 OFFSET 10",
        "event_feed": "SELECT event_id AS id, event_type AS type FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 50",
        "nearest_vectors": "WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), f AS (SELECT vec_id AS id, label, list_distance(embedding::DOUBLE[], q::DOUBLE[]) AS d FROM embeddings, q ORDER BY d, id LIMIT 30) SELECT id, round(1 / (1 + d), 6) AS score FROM f WHERE label < 5 ORDER BY d, id LIMIT 10",
        "curated_links": f"""WITH {node}, m AS (SELECT t, min_by(id, (length(label), id)) AS id FROM (SELECT unnest(['0001', 'urgent', 'nobody']) AS t) JOIN n ON contains(lower(label), t) GROUP BY t), s AS (SELECT * FROM (VALUES ('0001', 'urgent', 'AFFECTS', 0.9::DOUBLE, 0.8::DOUBLE), ('nobody', '0001', 'ABOUT', 0.5::DOUBLE, 0.5::DOUBLE)) v(a, b, type, weight, confidence))
SELECT x.id AS source, y.id AS target, type, weight, confidence, x.id IS NOT NULL AND y.id IS NOT NULL AS resolved FROM s LEFT JOIN m x ON x.t = a LEFT JOIN m y ON y.t = b""",
        "upstream": f"WITH RECURSIVE {graph}, r AS (SELECT DISTINCT v AS seed, v AS id, 0 AS depth FROM g WHERE v IN ('O1', 'O2', 'O3') UNION SELECT seed, u, depth + 1 FROM r JOIN g ON r.id = g.v WHERE depth < 3) SELECT seed, id, min(depth) AS depth FROM r WHERE id <> seed GROUP BY seed, id",
        "strongest_paths": f"WITH {graph}, a AS (SELECT u AS seed, v AS id, influence AS w FROM g WHERE u IN ('S1', 'S2')), b AS (SELECT seed, v AS id, max(w * influence) AS w FROM a JOIN g ON a.id = g.u GROUP BY seed, v), c AS (SELECT seed, v AS id, max(w * influence) AS w FROM b JOIN g ON b.id = g.u GROUP BY seed, v) SELECT seed, id, round(max(w), 6) AS strength FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE id <> seed GROUP BY seed, id",
        "scenario_deltas": f"""WITH b AS (SELECT CASE WHEN p_size > 45 THEN 'Risk' ELSE 'Claim' END AS type, ({status})[p_partkey % 8 + 1] AS status, (p_partkey % 90 + 10) / 100.0::DOUBLE AS confidence, (['cost', 'schedule', 'capacity', 'throughput'])[p_partkey % 4 + 1] AS dim, p_retailprice AS number, p_size FROM part),
m AS (SELECT *, status NOT IN {dead} AS l0, status NOT IN {dead} AND p_size <= 25 AS l1 FROM b),
v AS (SELECT dim AS name, sum(number) FILTER (l0) AS before, sum(number) FILTER (l1) AS after FROM m GROUP BY dim UNION ALL SELECT 'live_beliefs', count(*) FILTER (l0), count(*) FILTER (l1) FROM m UNION ALL SELECT 'risk_exposure', coalesce(sum(0.5::DOUBLE * confidence) FILTER (l0 AND type = 'Risk'), 0), coalesce(sum(0.5::DOUBLE * confidence) FILTER (l1 AND type = 'Risk'), 0) FROM m UNION ALL SELECT 'health_score', NULL, NULL)
SELECT name, round(before::DOUBLE, 2) AS before, round(after::DOUBLE, 2) AS after, CASE WHEN after - before IS NULL THEN 'unknown' WHEN abs(after - before) < 1e-9 OR name = 'live_beliefs' THEN 'unchanged' WHEN (after < before) = (name IN ('cost', 'schedule', 'risk_exposure')) THEN 'better' ELSE 'worse' END AS direction FROM v""",
        "scenario_ranking": "WITH s AS (SELECT n_name AS scenario, n_nationkey AS k FROM nation), t AS (SELECT scenario, round(60 + k % 7 - 6 * (k % 3) - 8 * (k % 2) + 5 * (k % 5) + 4 * (k % 4) - 3 * ((k % 6) / 10.0::DOUBLE), 4)::DOUBLE AS score FROM s) SELECT scenario, score, row_number() OVER (ORDER BY score DESC, scenario)::INT AS rank FROM t",
        "decisions_at_risk": f"WITH {node}, {edge} SELECT DISTINCT source AS id FROM e JOIN n ON n.id = e.target WHERE e.type IN ('BASED_ON', 'DEPENDS_ON') AND n.status IN ('CONTRADICTED', 'INVALIDATED', 'SUPERSEDED', 'CONTESTED') AND source LIKE 'O%'",
        "set_changes": f"""WITH {node}, {edge}, x AS (SELECT source AS id, n.status IN ('CONTRADICTED', 'INVALIDATED', 'SUPERSEDED', 'CONTESTED') AS m0, n.status IN ('CONTRADICTED', 'INVALIDATED', 'SUPERSEDED', 'CONTESTED') OR (n.id LIKE 'C%' AND substr(n.id, 2)::BIGINT % 2 = 0) AS m1 FROM e JOIN n ON n.id = e.target WHERE e.type IN ('BASED_ON', 'DEPENDS_ON')),
y AS (SELECT id, bool_or(m0) AS m0, bool_or(m1) AS m1 FROM x GROUP BY id) SELECT id, 'new' AS change FROM y WHERE m1 AND NOT m0""",
    }
