"""Records whose parts are made only where they are read, and tags that are scanned once a text."""

import random

from pyspark.sql import functions as F

from cairn.functions import body, markup, pages, passages
from cairn.operators import retrieval
from cairn.plans import library, page_queries
from cairn.sources.pages import parse_pages

PAGE = (
    b'<HTML><BODY><BIG><B>0003 Name, Cueva (Alias)</B></BIG><BR><SMALL><B>Area</B> 30T 450003 4790021 <B>Length</B> 30m <a href="y.htm">Logbook search</a></small>'
    b"<P><I>Updated 5th June 1995; 6th July 1996; soon</I><BR>\nSome words on site 0042.<P><B>Hydrology</B><P>More by Anna Berg in May 2004.<table><tr><td>Batch</td><td>Date</td></tr><tr><td>A</td><td>2</td></tr></table>"
    b"<P><SMALL><B>References</B>: Berg A, 1990 (survey)</SMALL></BODY></HTML>"
)


def test_only_the_parts_that_are_read_are_made(monkeypatch):
    whole = pages.parse_page(3, PAGE)
    for part in ("title", "header", "updated", "body", "footer", "segments_found", "is_stub", "notes", "passages"):
        assert pages.parse_page(3, PAGE, parts=frozenset([part]))[part] == whole[part]
    for f in ("tables", "cross_refs", "dates", "people", "sections"):
        assert pages.parse_page(3, PAGE, parts=frozenset([f"body.{f}"]))["body"][f] == whole["body"][f]
    monkeypatch.setattr(body, "people", lambda text: 1 / 0)
    monkeypatch.setattr(passages, "passages", lambda record: 1 / 0)
    monkeypatch.setattr(pages, "parse_updated", lambda *a: 1 / 0)
    assert pages.parse_page(3, PAGE, parts=frozenset(["title", "body.tables"]))["body"]["tables"] == whole["body"]["tables"]


def test_a_corrected_page_is_parsed_whole():
    fix = {"applies_to_sha256": "", "fix": []}
    assert pages.parse_page(3, PAGE, fix, parts=frozenset(["title"])).keys() == pages.parse_page(3, PAGE).keys()


def test_fields_of_a_column_may_be_asked_for(spark):
    made = page_queries.site_pages(spark, "/root/testdata/sf0.001")
    whole, some = (parse_pages(made, region=page_queries.REGION, parts=p) for p in (None, ("title.name", "body.tables", "footer.citations")))
    assert some.dtypes == whole.dtypes
    read = ["site_number", "title.name", "body.tables", "footer.citations", "error"]
    assert sorted(map(str, some.select(read).collect())) == sorted(map(str, whole.select(read).collect()))
    assert some.where(F.col("footer").isNull()).count() == whole.where(F.col("footer").isNull()).count()
    assert some.where("body.text IS NOT NULL OR header IS NOT NULL OR title.raw IS NOT NULL").isEmpty()


def test_kept_tags_are_those_of_a_scan():
    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(("<", ">", "<b>", "</b>", "<i x", "a ", "/")) for _ in range(r.randrange(12)))
        a, b = r.randrange(len(text) + 1), r.choice((None, r.randrange(len(text) + 1)))
        assert list(markup.tags(text, a, b)) == list(markup._scan(text, a, len(text) if b is None else b))


def test_groups_of_full_dates_are_kept():
    line = "<i>Updated 5th, 7th June; 13th January 1995; 5th May 1994, 6th May 1994; 9th June; 1995</i>"
    got = [(str(u["date"]), u["group_index"], u["inferred_year"]) for u in pages.parse_updated(line)]
    assert got == [("1995-06-05", 0, True), ("1995-06-07", 0, True), ("1995-01-13", 1, False), ("1994-05-05", 2, False), ("1994-05-06", 2, False)]
    pages._full.cache_clear()
    pages.parse_updated(line)
    assert pages._full.cache_info().currsize >= 3


def test_queries_of_a_set_split_the_passages_once(spark, monkeypatch):
    rows = [(i, "site 0042 and its cave" if i % 3 else "another cave of cave-divers", i) for i in range(60)]
    docs = spark.createDataFrame(rows, "chunk_id long, text string, site_number int")
    queries = [["site", "0042"], ["cave"], [], ["cave-divers", "cave", "cave"]]
    alone = [[tuple(r) for r in retrieval.bm25(docs, "chunk_id", "text", q, k=7).collect()] for q in queries]
    counted, kept = [], retrieval.once
    monkeypatch.setattr(retrieval, "once", lambda df: counted.append(1) or kept(df))
    assert [[tuple(r) for r in d.collect()] for d in retrieval.bm25_each(docs, "chunk_id", "text", queries, k=7)] == alone and len(counted) == 1
    asked = spark.createDataFrame([("site 0042", [1, 2], "a"), ("divers", [0], "b"), ("", [5], "c")], "query string, expect array<int>, kind string")
    got = {r["kind"]: r["recall"] for r in library.evaluate({"chunk": docs, "site": docs}, asked).collect()}
    assert len(counted) == 2 and got == {"a": 1.0, "b": 1.0, "c": 0.0}
