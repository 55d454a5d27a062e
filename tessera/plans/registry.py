"""The graph engine's queries on the driver's tables, each with SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantity as Q
from ..functions import text as X
from ..operators import beliefs, lineage, propagation, relational
from . import extended
from ..sources.graph import CRITICALITY, NOW, STATUSES, edges, nodes, observations, read

S = SparkSession
def _at(when: str) -> Column:
    return F.lit(when).cast("timestamp_ntz")



def conflicts(s: S, d: str) -> DataFrame:
    return beliefs.conflicts(observations(s, d), _at(NOW))


def credibility(s: S, d: str) -> DataFrame:
    return beliefs.scored(observations(s, d), _at(NOW)).select("id", "total")


def live_beliefs(s: S, d: str) -> DataFrame:
    return beliefs.live(observations(s, d), _at("2024-01-15")).select("id", "subject", "predicate", "number")


def expired_beliefs(s: S, d: str) -> DataFrame:
    return beliefs.expired(observations(s, d), _at(NOW)).select("id", "status")


def as_of(s: S, d: str) -> DataFrame:
    return beliefs.as_of(observations(s, d), _at("2024-01-15")).select("id", "number")


def constraint_violations(s: S, d: str) -> DataFrame:
    return beliefs.violations(observations(s, d), "LTE", F.lit(50.0)).select("id", "subject", "predicate", "number")


def timeline(s: S, d: str) -> DataFrame:
    return beliefs.timeline(observations(s, d))


def current_belief(s: S, d: str) -> DataFrame:
    return beliefs.current(observations(s, d))


def graph_stats(s: S, d: str) -> DataFrame:
    return relational.stats(nodes(s, d)).select(F.coalesce("type", F.lit("*")).alias("type"), F.coalesce("status", F.lit("*")).alias("status"), "n")


def node_page(s: S, d: str) -> DataFrame:
    return relational.page(nodes(s, d), ("Entity", "Decision"), "00", 20, 50).select("id", "type", "label", "criticality")


def orphan_nodes(s: S, d: str) -> DataFrame:
    return relational.orphans(nodes(s, d), edges(s, d)).select("id", "type")


def induced_edges(s: S, d: str) -> DataFrame:
    return relational.induced(edges(s, d), nodes(s, d).where("status = 'SUPPORTED'")).select("source", "target", "type")


def degree_centrality(s: S, d: str) -> DataFrame:
    return relational.degrees(edges(s, d))


def propagation_graph(s: S, d: str) -> DataFrame:
    return propagation.propagation(edges(s, d)).select("u", "v", F.round("influence", 6).alias("influence"))


def downstream(s: S, d: str) -> DataFrame:
    seeds = nodes(s, d).where("id in ('S1', 'S2', 'S3')").select("id")
    return propagation.reach(propagation.propagation(edges(s, d)), seeds, 3).select("seed", "id", "depth")


def impact(s: S, d: str) -> DataFrame:
    seeds = nodes(s, d).where("id in ('S1', 'S2')").select("id", F.lit(1.0).alias("magnitude"))
    return propagation.report(propagation.impact(propagation.propagation(edges(s, d)), seeds, depth=3), nodes(s, d))


def pagerank(s: S, d: str) -> DataFrame:
    """Rank of every node, until it settles, and the criticality that it makes."""
    n = nodes(s, d)
    ranks = propagation.pagerank(propagation.propagation(edges(s, d), n), n)
    return propagation.criticality(ranks, n).join(ranks, "id").select("id", F.round("rank", 6).alias("rank"), "criticality")


def node_uncertainty(s: S, d: str) -> DataFrame:
    return relational.uncertainty(nodes(s, d))


def knowledge_health(s: S, d: str) -> DataFrame:
    return relational.health(nodes(s, d), edges(s, d))


def price_change(s: S, d: str) -> DataFrame:
    p = read(s, d, "part")
    delta = Q.relative_delta(F.col("p_size").cast("double"), F.col("p_retailprice"))
    return p.select("p_partkey", F.round(delta, 4).alias("delta"), F.round(Q.magnitude(delta), 4).alias("magnitude"), Q.satisfies(F.col("p_retailprice"), F.lit("GTE"), F.lit(1500.0)).alias("ok"))


def fingerprints(s: S, d: str) -> DataFrame:
    return read(s, d, "customer").select("c_custkey", X.fingerprint(F.col("c_name"), F.col("c_mktsegment")).alias("fp"), X.slugify(F.col("c_name")).alias("slug"), X.normalise(F.col("c_name")).alias("name"))


def html_text(s: S, d: str) -> DataFrame:
    return read(s, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


def chunk_diff(s: S, d: str) -> DataFrame:
    docs = read(s, d, "documents").select("doc_id", F.sha1("text").alias("fp"))
    return relational.chunk_diff(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))


def vector_search(s: S, d: str) -> DataFrame:
    """The ten nearest vectors of vector 1 by cosine; a top-k report."""
    e = read(s, d, "embeddings")
    q = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"), F.col("vec_id").alias("qid"))
    return e.crossJoin(F.broadcast(q)).where("vec_id <> qid").select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


def upsert(s: S, d: str) -> DataFrame:
    log = read(s, d, "events").select("user_id", "event_id", "value", (F.col("event_type") == "error").alias("deleted"))
    return relational.compact(log, "user_id", "event_id").select("user_id", "event_id", "value")


def debounce(s: S, d: str) -> DataFrame:
    """Bursts of one user's events with pauses under an hour, as one change each."""
    w = F.session_window("ts", "1 hour")
    return read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", w).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).select("user_id", "n", "first_event")


def decision_basis(s: S, d: str) -> DataFrame:
    return lineage.decision_basis(nodes(s, d), edges(s, d))


def decision_audit(s: S, d: str) -> DataFrame:
    return lineage.decision_audit(nodes(s, d), edges(s, d))


def supersessions(s: S, d: str) -> DataFrame:
    return lineage.supersessions(observations(s, d))


def retired_source(s: S, d: str) -> DataFrame:
    n = lineage.retire(nodes(s, d), F.col("label").endswith("7"))
    return n.select("id", "status", F.round("confidence", 4).alias("confidence"))


def relationships(s: S, d: str) -> DataFrame:
    return lineage.relationships(nodes(s, d), edges(s, d))


def ranked_view(s: S, d: str) -> DataFrame:
    return lineage.ranked_view(nodes(s, d), edges(s, d), 20).select("source", "target", "type")


def neighbourhood(s: S, d: str) -> DataFrame:
    return lineage.neighbourhood(edges(s, d), nodes(s, d).where("id in ('S1', 'C1')").select("id"), 2, 200)


def label_match(s: S, d: str) -> DataFrame:
    return lineage.label_match(nodes(s, d), ["a", "Customer", "urgent", "nowhere"])


def known_predicates(s: S, d: str) -> DataFrame:
    return observations(s, d).select("predicate").distinct()


def source_authority(s: S, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", X.authority(F.col("source"), F.col("text")).alias("authority"))


def order_dates(s: S, d: str) -> DataFrame:
    """Dates written in six forms, read back."""
    forms = F.array(*(F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM", "yyyy")))
    raw = F.element_at(forms, (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(s, d, "orders").select("o_orderkey", F.to_date(X.parse_date(raw)).alias("day"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (conflicts, credibility, live_beliefs, expired_beliefs, as_of, constraint_violations, timeline, current_belief, graph_stats, node_page, orphan_nodes, induced_edges, degree_centrality, propagation_graph, downstream, impact, pagerank, node_uncertainty, knowledge_health, price_change, fingerprints, html_text, chunk_diff, vector_search, upsert, debounce, decision_basis, decision_audit, supersessions, retired_source, relationships, ranked_view, neighbourhood, label_match, known_predicates, source_authority, order_dates)
}

_status = "[" + ", ".join(f"'{x}'" for x in STATUSES) + "]"
_OBS = f"""o AS (SELECT 'OB' || event_id AS id, 'user-' || user_id AS subject, event_type AS predicate, value AS number, ts AS valid_from,
  lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_until, event_id, user_id, (event_id % 100) / 100.0::DOUBLE AS confidence,
  ([0.95, 0.88, 0.80, 0.75, 0.55]::DOUBLE[])[user_id % 5 + 1] AS authority, ({_status})[event_id % 8 + 1] AS status FROM events)"""
_DEAD = "('SUPERSEDED', 'INVALIDATED')"
_SCORED = f"""{_OBS}, sc AS (SELECT *, round(round(0.26::DOUBLE * round(authority, 4) + 0.22::DOUBLE * round(power(0.5::DOUBLE, greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(valid_from)) / 86400000000.0::DOUBLE / 120), 4) + 0.18::DOUBLE * round(confidence, 4)
  + 0.10::DOUBLE * round(0.70::DOUBLE + CASE WHEN valid_until IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END, 4) + 0.10::DOUBLE * CASE WHEN valid_until < TIMESTAMP '{NOW}' THEN 0 WHEN valid_until IS NOT NULL THEN 1 ELSE 0.9::DOUBLE END, 8)::DECIMAL(18, 8), 4)::DOUBLE AS total FROM o)"""
_NODES = "n AS (" + " UNION ALL ".join(f"SELECT '{p}' || {k} AS id, '{t}' AS type, {l}::VARCHAR AS label, ({_status})[{k}::BIGINT % 8 + 1] AS status, ({k}::BIGINT % 90 + 10) / 100.0::DOUBLE AS confidence FROM {n}" for n, p, k, t, l in (("supplier", "S", "s_suppkey", "Entity", "s_name"), ("customer", "C", "c_custkey", "Entity", "c_name"), ("nation", "N", "n_nationkey", "Entity", "n_name"), ("region", "R", "r_regionkey", "Entity", "r_name"), ("orders", "O", "o_orderkey", "Decision", "o_orderpriority"))) + ")"
_EDGES = "e AS (" + " UNION ALL ".join(f"SELECT {x} '{s}' || {a} AS source, '{t}' || {b} AS target, '{k}' AS type, {w}::DOUBLE AS weight, 0.9::DOUBLE AS confidence FROM {n}" for n, s, a, t, b, k, w, x in (("nation", "N", "n_nationkey", "R", "n_regionkey", "OWNED_BY", 0.9, ""), ("customer", "C", "c_custkey", "N", "c_nationkey", "OWNED_BY", 0.9, ""), ("supplier", "S", "s_suppkey", "N", "s_nationkey", "OWNED_BY", 0.9, ""), ("orders", "O", "o_orderkey", "C", "o_custkey", "DEPENDS_ON", 0.8, ""), ("lineitem", "O", "l_orderkey", "S", "l_suppkey", "BASED_ON", 0.9, "DISTINCT"))) + ")"
_G = f"{_EDGES}, i AS (SELECT *, weight * confidence * CASE type WHEN 'OWNED_BY' THEN 0.25::DOUBLE ELSE 0.85::DOUBLE END AS w FROM e), g AS (SELECT u, v, max(w) AS influence FROM (SELECT target AS u, source AS v, w FROM i UNION ALL SELECT source, target, w FROM i WHERE type = 'OWNED_BY') GROUP BY u, v)"
_CRIT = "CASE type WHEN 'Decision' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"

ORACLES = {
    "conflicts": f"""WITH {_SCORED}, a AS (SELECT * REPLACE (coalesce(valid_until, TIMESTAMP '9999-12-31') AS valid_until) FROM sc WHERE status NOT IN {_DEAD}),
p AS (SELECT l.subject, l.predicate, l.id AS left_id, r.id AS right_id, CASE WHEN l.number = 0 THEN CASE WHEN r.number <> 0 THEN 1.0::DOUBLE END ELSE (r.number - l.number) / abs(l.number) END AS delta, round(l.total - r.total, 4) AS margin
FROM a l JOIN a r USING (subject, predicate) WHERE (l.valid_from > r.valid_from OR (l.valid_from = r.valid_from AND l.id > r.id)) AND l.valid_from <= r.valid_until AND r.valid_from <= l.valid_until)
SELECT subject, predicate, left_id, right_id, round(least(1, 0.6::DOUBLE * (0.55::DOUBLE + 0.45::DOUBLE * {CRITICALITY['Observation']}::DOUBLE) * (0.6::DOUBLE + 0.4::DOUBLE * least(abs(delta), 1))), 4) AS severity, margin, CASE WHEN abs(margin) < 0.05::DOUBLE THEN 'contested' WHEN margin > 0 THEN left_id ELSE right_id END AS winner FROM p WHERE abs(delta) > 0.02::DOUBLE""",
    "credibility": f"WITH {_SCORED} SELECT id, total FROM sc",
    "live_beliefs": f"WITH {_OBS} SELECT id, subject, predicate, number FROM o WHERE status NOT IN {_DEAD} AND valid_from <= TIMESTAMP '2024-01-15' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2024-01-15')",
    "expired_beliefs": f"WITH {_OBS} SELECT id, status FROM o WHERE status NOT IN {_DEAD} AND valid_until < TIMESTAMP '{NOW}'",
    "as_of": f"WITH {_OBS} SELECT id, number FROM o WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '2024-01-15')",
    "constraint_violations": f"WITH {_OBS} SELECT id, subject, predicate, number FROM o WHERE status NOT IN {_DEAD} AND number > 50",
    "timeline": f"WITH {_OBS}, w AS (SELECT *, lag(number) OVER k AS b, row_number() OVER k AS step, lead(valid_from) OVER k AS closed_at FROM o WINDOW k AS (PARTITION BY subject, predicate ORDER BY valid_from, id)) SELECT subject, predicate, id, step, round(CASE WHEN b = 0 THEN CASE WHEN number <> 0 THEN 1.0::DOUBLE END ELSE (number - b) / abs(b) END, 4) AS delta, closed_at FROM w",
    "current_belief": f"WITH {_OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, id DESC) AS k FROM o WHERE status NOT IN {_DEAD}) SELECT subject, predicate, id, number FROM r WHERE k = 1",
    "graph_stats": f"WITH {_NODES} SELECT coalesce(type, '*') AS type, coalesce(status, '*') AS status, count(*) AS n FROM n GROUP BY GROUPING SETS ((type), (status), ())",
    "node_page": f"WITH {_NODES} SELECT id, type, label, {_CRIT} AS criticality FROM n WHERE contains(lower(label), '00') ORDER BY criticality DESC, id LIMIT 50 OFFSET 20",
    "orphan_nodes": f"WITH {_NODES}, {_EDGES} SELECT id, type FROM n WHERE id NOT IN (SELECT source FROM e UNION SELECT target FROM e)",
    "induced_edges": f"WITH {_NODES}, {_EDGES}, k AS (SELECT id FROM n WHERE status = 'SUPPORTED') SELECT source, target, type FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
    "degree_centrality": f"WITH {_EDGES} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e) GROUP BY id",
    "propagation_graph": f"WITH {_G} SELECT u, v, round(influence, 6) AS influence FROM g",
    "downstream": f"WITH RECURSIVE {_G}, r AS (SELECT DISTINCT u AS seed, u AS id, 0 AS depth FROM g WHERE u IN ('S1', 'S2', 'S3') UNION SELECT seed, v, depth + 1 FROM r JOIN g ON r.id = g.u WHERE depth < 3) SELECT seed, id, min(depth) AS depth FROM r WHERE id <> seed GROUP BY seed, id",
    "node_uncertainty": f"WITH {_NODES} SELECT id, type, round(greatest(1 - confidence, CASE status WHEN 'CONTESTED' THEN 0.5::DOUBLE WHEN 'CONTRADICTED' THEN 0.7::DOUBLE WHEN 'UNVERIFIED' THEN 0.4::DOUBLE ELSE 0 END) * {_CRIT}, 4) AS uncertainty FROM n WHERE status NOT IN {_DEAD}",
    "knowledge_health": f"""WITH {_NODES}, {_EDGES}, t AS (SELECT DISTINCT source AS id FROM e UNION SELECT target FROM e), b AS (SELECT DISTINCT source AS id FROM e WHERE type IN ('BASED_ON', 'DEPENDS_ON')),
c AS (SELECT avg(confidence) AS a, count(*) AS live, count(*) FILTER (id NOT IN (SELECT id FROM t)) AS orphans, count(*) FILTER (type = 'Decision') AS decisions, count(*) FILTER (type = 'Decision' AND id NOT IN (SELECT id FROM b)) AS without_lineage FROM n WHERE status NOT IN {_DEAD})
SELECT live, orphans, decisions, without_lineage, round(a, 4) AS avg_confidence, round(100 - (1 - a) * 20 - least(without_lineage / greatest(decisions, 1) * 20, 10) - least(orphans / greatest(live, 1) * 20, 8), 4) AS score FROM c""",
    "price_change": "WITH x AS (SELECT *, CASE WHEN p_size = 0 THEN CASE WHEN p_retailprice <> 0 THEN 1.0::DOUBLE END ELSE (p_retailprice - p_size) / abs(p_size) END AS r FROM part) SELECT p_partkey, round(r, 4) AS delta, round(abs(r) / (abs(r) + 0.35::DOUBLE), 4) AS magnitude, p_retailprice >= 1500 AS ok FROM x",
    "fingerprints": r"SELECT c_custkey, substr(sha1(lower(trim(c_name)) || chr(31) || lower(trim(c_mktsegment)) || chr(31)), 1, 16) AS fp, substr(regexp_replace(lower(regexp_replace(c_name, '[^\w\s-]', '', 'g')), '[\s_-]+', '-', 'g'), 1, 60) AS slug, trim(regexp_replace(regexp_replace(lower(c_name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM customer",
    "chunk_diff": "WITH a AS (SELECT DISTINCT sha1(text) AS fp FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT sha1(text) AS fp FROM documents WHERE doc_id % 2 = 1) SELECT fp, 'added' AS change FROM b WHERE fp NOT IN (SELECT fp FROM a) UNION ALL SELECT fp, 'removed' FROM a WHERE fp NOT IN (SELECT fp FROM b)",
    "vector_search": "WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> qid ORDER BY score DESC, vec_id LIMIT 10",
    "upsert": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, value FROM r WHERE k = 1 AND event_type <> 'error'",
    "debounce": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a) SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, g",
    "decision_basis": f"WITH {_NODES}, {_EDGES} SELECT DISTINCT source AS decision, target AS id, type AS role FROM e WHERE type IN ('BASED_ON', 'DEPENDS_ON') AND source IN (SELECT id FROM n WHERE type = 'Decision')",
    "decision_audit": f"WITH {_NODES}, {_EDGES} SELECT DISTINCT source AS decision, target AS id, e.type AS role, n.status, n.status IN ('CONTRADICTED', 'INVALIDATED', 'SUPERSEDED', 'CONTESTED') AS changed FROM e JOIN n ON n.id = e.target WHERE e.type IN ('BASED_ON', 'DEPENDS_ON') AND source IN (SELECT id FROM n WHERE type = 'Decision')",
    "supersessions": f"""WITH {_OBS}, l AS (SELECT * FROM o WHERE status NOT IN {_DEAD}), p AS (SELECT a.id AS source, a.confidence, max_by(b.id, (b.valid_from, b.id)) AS target FROM l a JOIN l b ON a.subject = b.subject AND a.predicate = b.predicate AND b.valid_from < a.valid_from GROUP BY a.id, a.confidence)
SELECT source, target, 'SUPERSEDES' AS type, 0.95::DOUBLE AS weight, greatest(confidence, 0.6::DOUBLE) AS confidence FROM p""",
    "retired_source": f"WITH {_NODES}, h AS (SELECT *, ends_with(label, '7') AND status NOT IN {_DEAD} AS hit FROM n) SELECT id, CASE WHEN hit THEN 'UNVERIFIED' ELSE status END AS status, round(CASE WHEN hit THEN greatest(confidence * 0.7::DOUBLE, 0.1::DOUBLE) ELSE confidence END, 4) AS confidence FROM h",
    "relationships": f"WITH {_NODES}, {_EDGES}, b AS (SELECT source AS id, 'out' AS direction, type, target AS neighbour FROM e UNION ALL SELECT target, 'in', type, source FROM e) SELECT b.id, direction, b.type, neighbour, coalesce(n.label, neighbour) AS label FROM b LEFT JOIN n ON n.id = neighbour",
    "ranked_view": f"""WITH {_NODES}, {_EDGES}, r AS (SELECT id, {_CRIT} AS c FROM n), core AS (SELECT id FROM r ORDER BY c DESC, id LIMIT 20), p AS (SELECT source AS id, target AS nxt FROM e UNION SELECT target, source FROM e),
more AS (SELECT id FROM r WHERE id IN (SELECT nxt FROM p WHERE id IN (SELECT id FROM core)) AND id NOT IN (SELECT id FROM core) ORDER BY c DESC, id LIMIT 20), k AS (SELECT id FROM core UNION SELECT id FROM more)
SELECT source, target, type FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)""",
    "neighbourhood": f"""WITH {_EDGES}, p AS (SELECT source AS u, target AS v FROM e UNION SELECT target, source FROM e), one AS (SELECT DISTINCT u AS seed, v AS id FROM p WHERE u IN ('S1', 'C1')),
a AS (SELECT seed, id, min(depth) AS depth FROM (SELECT seed, id, 1 AS depth FROM one UNION ALL SELECT seed, v, 2 FROM one JOIN p ON one.id = p.u) WHERE id <> seed GROUP BY seed, id)
SELECT seed, id, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS r FROM a) WHERE r <= 200""",
    "label_match": f"WITH {_NODES}, k AS (SELECT unnest(['a', 'Customer', 'urgent', 'nowhere']) AS needle), m AS (SELECT needle, id, row_number() OVER (PARTITION BY needle ORDER BY length(label), id) AS r FROM k JOIN n ON contains(lower(label), lower(needle))) SELECT needle, id FROM m WHERE r = 1",
    "known_predicates": "SELECT DISTINCT event_type AS predicate FROM events",
    "source_authority": "WITH x AS (SELECT doc_id, lower(coalesce(source, '') || ' ' || substr(coalesce(text, ''), 1, 400)) AS p FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(p, '{p}') THEN {v}::DOUBLE" for p, v in X.AUTHORITY) + " ELSE 0.65::DOUBLE END AS authority FROM x",
    "order_dates": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN date_trunc('month', o_orderdate)::DATE WHEN 5 THEN date_trunc('year', o_orderdate)::DATE ELSE o_orderdate::DATE END AS day FROM orders",
}

QUERIES |= extended.QUERIES
ORACLES |= extended.oracles(_OBS, _NODES, _EDGES, _G, ORACLES["conflicts"])
