"""Operators on small hostile tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns with clashing names; and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import compact, decontaminate, mix, multiindex, neardup, pii, suffix, toxicity, url_filter, wrapper

SCHEMA = "doc_id long, text string, source string, lang string, size long, target double, spans string, rule string, toxicity string"
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
TEXT = {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(60, 160))) for i in range(20)}
LOWER = {i: i + 32 for i in range(65, 91)}


def corpus(spark):
    near = TEXT[0].split()
    near[10] = "CHANGED"
    shared = " ".join(TEXT[5].split()[:55])
    rows = [(i, t) for i, t in TEXT.items()] + [(20, TEXT[0]), (21, " ".join(near)), (22, None), (23, ""), (24, "  \n"), (25, "one"), (26, "one"), (27, TEXT[7] + " tail " + shared), (28, "ab " * 20_000), (29, TEXT[3]), (29, TEXT[3]), (30, "é" * 300), (31, "é" * 300)]
    return spark.createDataFrame([(i, t, [None, "a", "b"][i % 3], "en", 1, 2.0, "x", "y", "z") for i, t in rows], SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_neardup_brute(spark):
    df, rows = corpus(spark)
    got = {r.doc_id: r for r in neardup.near_duplicates(df, shingle=2).collect()}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    comp = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_parity_never_exceeds_the_difference():
    g = np.random.default_rng(1).integers(0, 1 << 63, 6000).astype(np.uint64)
    sets = [np.unique(g[a:b]) for a, b in ((0, 0), (0, 1), (0, 150), (20, 160), (100, 5000), (1, 6000), (0, 0))]
    bits = neardup.parity(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for x, a in zip(sets, bits, strict=True):
        for y, b in zip(sets, bits, strict=True):
            assert sum(int(v & np.uint64(0xFFFFFFFFFFFFFFFF)).bit_count() for v in (a ^ b).view(np.uint64)) <= len(np.setxor1d(x, y))


def test_neardup_of_edited_copies(spark):
    """A group of copies so edited that their similarities lie on either side of the threshold, brute force included."""
    r, base = random.Random(8), [f"w{i}" for i in range(120)]
    texts = {i: " ".join(f"e{i}x{k}" if r.random() < share else w for k, w in enumerate(base)) for i, share in ((i, r.choice((0.02, 0.05, 0.08))) for i in range(150))}
    sets = {i: {*zip(t.split(), t.split()[1:])} for i, t in texts.items()}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(10):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert 1 < len({*comp.values()}) < 150
    got = neardup.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string"), shingle=2).collect()
    assert {x.doc_id: x.component_id for x in got} == comp


def test_suffix_brute(spark):
    df, rows = corpus(spark)
    got = suffix.dedup_substrings(df).select("doc_id", "spans", "kept").collect()
    assert len(got) == len(rows)
    seen, want = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b, cover = (t or "").encode(), set()
        for s in range(len(b) - 99):
            k = b[s : s + 100]
            if seen.setdefault(k, (i, s)) != (i, s):
                cover.update(range(s, s + 100))
        want[i] = bytes(c for n, c in enumerate(b) if n not in cover)
    assert {r.doc_id: bytes(r.kept) for r in got} == want
    assert suffix.dedup_substrings(empty(spark)).count() == 0


def test_decontamination_brute_and_removal(spark):
    df, rows = corpus(spark)
    items = [(1, " ".join(TEXT[2].split()[5:40])), (10, "one"), (3, None), (4, ""), (5, " ".join(TEXT[9].split()[:13]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    for r in decontaminate.find_contamination(df, bench).collect():
        t = next(t for i, t in rows if i == r.doc_id)
        w, hit, found = tok(t), set(), set()
        for i, x in items:
            x = tok(x)
            n = min(13, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    found.add(i)
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found)), r.doc_id
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(df, bench, longest=13).collect()}
    assert TEXT[2].split()[20] + " " + TEXT[2].split()[21] not in out[2] and out[1] == TEXT[1] and out[22] is None and out[25] == ""
    assert decontaminate.find_contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_mix_keeps_targets(spark):
    df, rows = corpus(spark)
    a, b = ([tuple(r) for r in mix.mix(df).select("doc_id", "source", "size", "target", "taken").orderBy("doc_id").collect()] for _ in range(2))
    assert a == b and len(a) == len(rows) and all(k <= 3 * n for _, _, n, _, k in a)
    for s in {r[1] for r in a}:
        own = [r for r in a if r[1] == s]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= max(r[2] for r in own)
    assert mix.mix(empty(spark)).count() == 0
    assert mix.targets([10, 100, 1000], [5, 2, 1], 3) == [30.0, 300.0, 780.0] and mix.knapsack([1, 3, 7], [10, 5, 5], 33) is not None


def test_mix_by_shuffle_agrees(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = lambda: sorted(map(tuple, mix.mix(df).select("doc_id", "size", "source_size", "target", "taken", "_repeats").collect()))
    near = told()
    monkeypatch.setattr(mix, "BROADCAST_ROWS", 0)
    assert told() == near and len(near) == 3000
    got = {}
    for _, _, size, target, taken, _ in near:
        got[size, target] = got.get((size, target), 0) + taken
    assert all(abs(taken - target) <= 7 for (_, target), taken in got.items())


def test_pii_round_trip_and_links(spark):
    p = pii.Pseudonyms(b"k")
    t = "4799134681044206 a.b@c.example.com +1 (319) 555-5132 27.109.211.155 2021-03-04 12/31/1999 DE89 3704 0044 0532 0130 00 123-45-6789; 6044423740532315 2.0. 31.02.2020"
    out, found = p.text(t)
    assert p.text(out, back=True)[0] == t and [k for k, *_ in found] == ["card", "email", "phone", "ip", "date", "date", "iban", "ssn"]
    assert out.endswith("6044423740532315 2.0. 31.02.2020") and p.text("again 4799134681044206")[0].endswith(out[:16])
    for n in (1, 2, 7, 1000):
        assert sorted(map(pii.Feistel(b"k", "t", n).encrypt, range(n))) == list(range(n))
    df, rows = corpus(spark)
    got = pii.pseudonymise(df, b"k", spans="spans").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i, x or "") for i, x in rows)
    assert pii.pseudonymise(empty(spark), b"k").count() == 0


def test_toxicity_learns_and_folds(spark):
    rows = [(f"{TEXT[i % 20]} {'grumblor' if i % 2 else ''} {'zarfok' + 'abcd'[i % 4] if i % 2 else ''}", i % 2) for i in range(200)] + [(None, 0), ("", 0)]
    lex = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert lex.score("you grumblor") > 0.7 and lex.score("you gruмbl0r!") > 0.7 and lex.score(TEXT[4]) < 0.3 and lex.score(None) < 0.3
    lex.exceptions = ("grumblor fish",)
    lex._auto = None
    assert lex.score("a grumblor fish") < 0.3
    df, want = corpus(spark)
    assert toxicity.score(df, lex).count() == len(want) and toxicity.score(empty(spark), lex).count() == 0
    assert toxicity.learn(spark.createDataFrame([], "text string, toxic int")).score("x") < 0.7


def test_urls(spark):
    urls = ["http://A.Example.ORG/es/x?y", "https://example.org/en/1513.html", "http://org", "x", None, "", "https://b.com/de/#t", "https://notexample.org/es/", "http://fr.com/fr/1"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()}
    assert [got[i] for i in range(9)] == [("a.example.org", "example.org/es/", "block"), ("example.org", "example.org/en/1", "block"), ("org", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("b.com", "com/de/", "block"), ("notexample.org", "org/", "allow"), ("fr.com", "com/fr/", "allow")]
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_pages(spark):
    page = lambda i: f"<html><nav><a href=x>menu {i}</a></nav><div class=bar>All rights here</div><div class='c1'><h1>T{i}</h1><p>One &amp; <b>two {i}<br>three<p>four</div><div class='comments'><p>bad</p></div><footer>end {i}</footer>"
    rows = [(i, "http://h/x", page(i), "t") for i in range(8)] + [(20, None, None, "t"), (21, "http://e/", "", "t"), (22, "http://e/", "<p>a < b & c</", "t")]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3] == "T3\n\nOne & two 3 three"  # "four" is the same on all pages, and so template
    assert got[20] == got[21] == "" and got[22].startswith("a < b")
    article = "<body><header>H</header><article><h1>x</h1><aside>s</aside><p>y\n z</p><form>q</form><ul><li>i<li>j</ul></article><script>a</script>"
    assert wrapper.main_text(article) == "x\n\ny z\n\ni\n\nj"


def test_template_keeps_other_texts(spark):
    page = lambda i, summary: f"<body><div class=content><p>{summary}</p><p>text {i}</p><p>All rights here</p></div>"
    rows = [(i, "http://h/x", page(i, "no summary" if i < 9 else "a real summary")) for i in range(10)]
    rows += [(100 + i, "http://copies/x", page(50 if i < 40 else i, "s" if i < 40 else f"s{i}")) for i in range(46)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "text 0" and got[9] == "a real summary\n\ntext 9"
    assert got[100] == "s\n\ntext 50" and got[145] == "s45\n\ntext 45"


def test_two_layouts_of_a_host(spark):
    one = lambda i: f"<body><div class=content><p>one {i}</p><p>All rights here</p></div>"
    two = lambda i: f"<body><div class=top>x</div><section class=story><h2>Two {i}</h2><p>two {i}</p><p>Read more with us</p></section>"
    rare = lambda i: f"<body><main><div class=content><p>rare {i}</p></div></main>"
    rows = [(i, "http://h/x", one(i) if i < 12 else two(i) if i < 20 else rare(i)) for i in range(22)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "one 3" and got[15] == "Two 15\n\ntwo 15" and got[21] == "rare 21"


def test_vectors_brute(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 16))
    x[100:140] = x[0] + 0.1 * r.normal(size=(40, 16))
    x[140:150] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [1.0] * 4)]
    got = {r.vec_id: r.n_links for r in multiindex.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert sum(got[i] for i in range(300)) >= 0.9 * want.sum() and all(got[i] <= want[i] for i in range(300)) and all(got[i] == 0 for i in range(400, 405))
    cells = list(multiindex.multi_sequence(np.array([3.0, 1, 2]), np.array([5.0, 4]), 7.5))
    assert cells == [(1, 1), (2, 1), (1, 0), (2, 0), (0, 1)] or {(1, 1), (2, 1), (1, 0)} <= set(cells)


def test_passages(spark):
    df, _ = corpus(spark)
    got = compact.near_passages(df).collect()
    pairs = {(r.doc_id, r.other_id) for r in got}
    assert {(20, 0), (27, 7), (27, 5)} <= pairs and (29, 3) in pairs
    assert not {r.doc_id for r in got} & {1, 2, 22, 23, 24, 25, 28}
    assert compact.near_passages(empty(spark)).count() == 0
    v = np.random.default_rng(1).permutation(300).astype(np.uint64)
    to = np.array([0, 120, 300])
    for c, a, z in zip(*compact.compact_windows(v, to, 20), strict=True):
        assert v[a : z + 1].min() == v[c] and z - a >= 19 and (a in to or v[a - 1] < v[c]) and (z + 1 in to or v[z + 1] < v[c])




def test_passage_in_edited_copy():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    b = a.copy()
    spoiled = np.setdiff1d(np.arange(400), np.arange(150, 200))[::2]
    b[spoiled] = rng.integers(1, 1 << 60, len(spoiled)).astype(np.uint64)
    i, j, k, m, s = compact.verify(a, b, 46, 0.8)
    assert s >= 0.8 and j - i >= 45 and k <= 154 and m >= 195
    assert compact.verify(a, b[:149], 46, 0.8) is None
    assert compact.verify(a, b[:0], 46, 0.8) is None


def test_every_passage_of_two_regions(spark):
    rng = random.Random(31)
    text = lambda n, tag: [f"{tag}{rng.randrange(10**9)}" for _ in range(n)]
    p, q, r = text(60, "p"), text(60, "q"), text(60, "r")
    one = [*text(30, "a"), *p, *text(20, "b"), *q, *text(200, "c"), *r]
    two = [*text(10, "d"), *p, *text(20, "e"), *q, *text(90, "f"), *r, *text(9, "g")]
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    assert sorted((x.other_first, x.other_after, x.first, x.after) for x in compact.near_passages(df).collect()) == [(30, 90, 10, 70), (110, 170, 90, 150), (370, 430, 240, 300)]
    v = np.arange(200, dtype=np.uint64)
    once, twice = v[:60], np.concatenate([v[:60], v[100:120], v[:60]])
    assert {x[:2] for x in compact.passages(twice, once, 46, 0.8)} == {(0, 59), (80, 139)} == {x[2:4] for x in compact.passages(once, twice, 46, 0.8)}


def test_passages_in_small_batches(spark):
    words = [f"w{i}" for i in range(3000)]
    rng = np.random.default_rng(6)
    text = lambda n: [words[i] for i in rng.integers(0, 3000, n)]
    shared = [text(60) for _ in range(3)]
    rows = [(i, " ".join(text(80) + shared[i % 3] + text(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    usual = set(compact.near_passages(df).collect())
    assert {r["doc_id"] for r in usual} | {r["other_id"] for r in usual} == set(range(30))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert set(compact.near_passages(df).collect()) == usual
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
