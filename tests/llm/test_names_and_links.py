"""Columns of any name beside the operators' own; one pseudonym for every notation; texts made to collide; deep pages."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mix, pii, suffix, toxicity, url_filter, wrapper


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "some words here", "a", "x", "y", "z", "u", "v"), (2, None, None, None, None, None, None, None)], "doc_id long, text string, source string, Size string, Kept string, `a.b` string, _src string, found string")
    assert [c for c in mix.mix(df).columns if c.lower() == "size"] == ["size"] and mix.mix(df).select("`a.b`", "_src", "Kept", "found").where("found = 'v'").count() == 1
    out = suffix.dedup_substrings(df)
    assert out.columns == ["doc_id", "text", "source", "Size", "a.b", "_src", "found", "n_bytes", "spans", "kept"] and out.where("`a.b` = 'z' and found = 'v'").count() == 1
    assert toxicity.score(df, toxicity.Lexicon({}), into="KEPT").columns == ["doc_id", "text", "source", "Size", "a.b", "_src", "found", "KEPT"]
    assert pii.pseudonymise(df, b"k", spans="SIZE").columns == ["doc_id", "text", "source", "Kept", "a.b", "_src", "found", "SIZE"]
    pages = spark.createDataFrame([(1, "http://h/x", "<p>t</p>", "c", "d", "e")], "page_id long, url string, html string, Host string, `a.b` string, _page string")
    got = url_filter.filter_urls(pages, [("block", "h/")])
    assert got.columns == ["page_id", "url", "html", "a.b", "_page", "host", "path", "rule", "verdict"] and got.first()["verdict"] == "block"
    row = wrapper.extract(pages).first()
    assert row["text"] == "t" and row["a.b"] == "d" and row["_page"] == "e"


def test_one_pseudonym_for_all_notations():
    p = pii.Pseudonyms(b"k")
    digits = lambda s: "".join(c for c in s if c.isdecimal())
    for group in (("+44 20 7946 0958", "+442079460958"), ("+49 30 901820", "+4930901820"), ("+1 (319) 555-5132", "+13195555132", "319-555-5132")):
        new = {digits(p.value("phone", s))[-9:] for s in group}
        assert len(new) == 1
    for day in range(13, 29):
        told = set()
        for s in (f"1999-12-{day}", f"{day}/12/1999", f"12/{day}/1999"):
            t = p.value("date", s)
            a = [int(x) for x in t.replace("/", "-").split("-")]
            told.add(tuple(a) if a[0] > 31 else (a[2], a[1], a[0]) if a[1] <= 12 else (a[2], a[0], a[1]))
        assert len(told) == 1, day


def test_words_made_to_collide(spark):
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    found = decontaminate.find_contamination(spark.createDataFrame([(1, two), (2, one)], "doc_id long, text string"), spark.createDataFrame([(7, one)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("tag", ["div", "span"])
def test_deep_pages(tag):
    n = 10_000
    assert wrapper.main_text("<body><article>" + f"<{tag}>" * n + "deep" + f"</{tag}>" * n + "</article>") == "deep"
    root = wrapper.numbered(wrapper.parse("<body>" + f"<{tag}>" * n + "deep"))
    assert len(wrapper.align(root, root)) == n + 2 and wrapper.layout(root)


def test_pages_without_columns_lost(spark):
    df = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert wrapper.extract(df).select(F.col("text")).first()[0] == ""
