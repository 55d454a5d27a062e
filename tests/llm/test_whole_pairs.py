"""Pairs are whole where groups are crowded, and what is sent for them stays in proportion."""

import numpy as np

from tessera.llm import compact, multiindex


def shuffled(spark):
    """Bytes that each stage so far has written for others, by stage."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(stages.size())}


def test_vectors_sent_in_proportion(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 32)).astype(np.float32)
    x[1000:1200] = x[0] + 0.1 * r.normal(size=(200, 32))  # a cell of more than a group holds
    x[1200:1500] = x[1:301] + r.uniform(0.02, 0.5, (300, 1)) * r.normal(size=(300, 32))
    x[1500:1510] = x[2]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    for name in ("BLOCK", "MOST"):
        monkeypatch.setattr(multiindex, name, 100, raising=False)
    before = set(shuffled(spark))
    got = {v.vec_id: v for v in multiindex.similar_vectors(df).collect()}
    assert max(n for k, n in shuffled(spark).items() if k not in before) <= 6 * x.nbytes
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    n = near.sum(axis=1) - 1
    assert all(got[i].n_links <= n[i] for i in got) and sum(v.n_links for v in got.values()) >= 0.99 * n.sum()
    assert all(got[i].component_id == 0 and not got[i].kept for i in range(1000, 1200)) and all(got[i].component_id == 2 for i in range(1500, 1510))


def test_traversal_is_the_multi_sequence():
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = multiindex.Index(x, 600, 0.9, 0.999)
    d1, d2 = index.both(x[:50])
    row, cell = index.traversal(d1, d2)
    for i in range(50):
        assert sorted(cell[row == i].tolist()) == sorted(u * len(index.c2) + v for u, v in multiindex.multi_sequence(d1[i], d2[i], index.limit(d1, d2)[i]))
    one, two = index.both(x), index.both(x[7:8])
    assert (one[0][7] == two[0][0]).all() and (one[1][7] == two[1][0]).all()


def _window(place, words, least):
    return compact._pack(np.array([place]), np.array([least]), np.array([least]), np.array([words], np.uint64))[0].item()


def test_all_windows_of_a_crowded_key_meet(spark):
    n, least = 60, 46
    rows = [(8 * 12345 + 0, d, _window(100, 977 * d, least), d) for d in range(n)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = compact._across(spark.createDataFrame(rows, "key long, doc_id long, at long, label long"), least).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc_id, r.other) for r in got} == {(a, b) for a in range(n) for b in range(a)}


def test_crowded_hashes_of_any_numbers_meet(spark):
    least, n = 46, 50
    rows = [(d, 8 * 1000 * (j + 1) + j, _window(100 + j, 977 * d, least)) for d in range(n) for j in (0, 2, 4, 6)]
    crowded = spark.createDataFrame(rows, "doc_id long, a long, b long")
    cover = spark.createDataFrame([], "doc_id long, a long, b long, c long")
    found = compact._joined(compact._across(compact._second(crowded, cover, least), least), least).collect()
    assert {(r.doc_id, r.other) for r in found} == {(a, b) for a in range(n) for b in range(a)}


def test_regions_are_sent_once(spark):
    r = np.random.default_rng(8)
    text = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    n = 200
    passages = [text(60) for _ in range(n // 2)]
    rows = [(d, " ".join(text(200) + passages[d // 2] + text(200))) for d in range(n)]
    base = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(d + 1, 0, 456, d, 0, 456) for d in range(0, n, 2)], compact._PAIR)
    before = set(shuffled(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = compact._verified(base, pairs, 5, 46, 0.8).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = sum(x for k, x in shuffled(spark).items() if k not in before)
    assert {(x.doc_id, x.other_id, x.first, x.after, x.other_first) for x in got} == {(d + 1, d, 200, 260, 200) for d in range(0, n, 2)}
    assert sent <= 3 * n * 456 * 8  # both regions of each pair, and the texts
