"""Findings of the second round: numbers beyond four digits, regions, entities, searches without a cut, bounded batches."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import body, pages, text
from cairn.functions.geodesy import utm_to_degrees
from cairn.operators import graph, retrieval
from cairn.plans import library, page_queries
from cairn.sources.pages import parse_pages


def test_numbers_have_four_digits_or_more():
    assert pages.parse_title("60003 Name, Cueva", 60003)["stated"] == 60003
    assert pages.target_site("../entpics/10000.htm") == (10000, False) and pages.target_site("0042-long.htm") == (42, False)
    assert pages.parse_quantity("length", "included in the length of 10001")["prose"]["target_sites"] == [10001]
    assert [r["target_site"] for r in body.references("", "see site 12345", 1)] == [12345]


def test_coordinates_are_read_in_the_region_that_is_given():
    line = "<SMALL><B>A</B> 30T 456000 4832000 <B>Length</B> 3m</SMALL>"
    assert pages.parse_header(line)["coordinates"][0]["latitude"] is None
    assert pages.parse_header(line, page_queries.REGION)["coordinates"][0]["latitude"] is not None


def test_degrees_are_not_rounded_twice():
    lat, _ = utm_to_degrees(450109, 4790763)
    assert round(lat, 5) == 43.26803 and lat != round(lat, 7)


def test_only_the_entities_that_are_given_are_read():
    assert text.strip_tags("a &amp;&amp b") == "a && b"
    assert text.strip_tags("a &amp;&amp b", page_queries.ENTITIES) == "a &&amp b"
    assert text.blocks("x<p>&copy;<p> ", page_queries.ENTITIES) == ["x", "&copy;"]


def test_update_lines_read_the_same_from_kept_tokens():
    line = "<i>Updated 5th, 7th June; 13th January 1995; 1995; 3/4/03, May 2004, (1999)</i>"
    first = pages.parse_updated(line)
    assert first == pages.parse_updated(line) and [str(u["date"]) for u in first] == ["1995-06-05", "1995-06-07", "1995-01-13", "2003-04-03", "2004-05-01"]
    assert [u["group_index"] for u in first] == [0, 0, 1, 3, 3] and first[0]["inferred_year"] and not first[2]["inferred_year"]


def test_searches_without_a_limit_give_every_passage(spark):
    chunks = spark.range(250).select("id", F.col("id").cast("int").alias("site_number"), F.lit("prose").alias("kind"), F.lit("about 0042").alias("text")).withColumnRenamed("id", "chunk_id")
    site = spark.range(250).select(F.col("id").cast("int").alias("site_number"), F.lit("n").alias("name"), F.lit("a").alias("area_raw"))
    own = {"chunk": chunks, "site": site}
    assert library.search_passages(own, "0042", limit=None).count() == 250
    assert library.search_sites(own, "0042", limit=None, pool=None).count() == 250 and library.search_sites(own, "0042").count() == 10


def test_a_batch_of_rows_is_bounded(spark):
    d = spark.createDataFrame([(1, "x" * 5000)], "k int, t string")
    assert page_queries.each_text(d, "k", "t", "c string", lambda x: [(c,) for c in x]).count() == 5000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_nearest_by_tiles_orders_ties_and_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [4.0, 3.0]), (4, [float("nan"), 0.0]), (5, [None, 0.0]), (6, None), (7, [1.0])]
    d = spark.createDataFrame(rows, "k int, v array<double>")
    q = d.where("k IN (1, 7)").select(F.col("k").alias("query"), F.col("v").alias("q"))
    got = sorted((r["query"], r["rank"], r["key"]) for r in retrieval.knn_batch(d.withColumnRenamed("k", "key"), q, "key", "v", 3).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (1, 3, 4)]


def test_a_large_frontier_meets_the_edges_by_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 1)
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 5), (5, 6), (6, 7)], "a int, b int")
    got = {r["node"]: r["depth"] for r in graph.neighbourhood(e, "a", "b", spark.createDataFrame([(1,)], "node int"), 3).collect()}
    assert got == {1: 0, 2: 1, 5: 1, 3: 2, 6: 2, 7: 3}


def test_stripped_text_is_trimmed_of_any_space_and_a_null_stays_null(spark, tmp_path):
    pages = [(1, "\u00a0\u3000<p>a\u00a0b\u2009"), (2, None), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["page_id"]: (r["chars"], r["digest"]) for r in page_queries.html_strip(spark, str(tmp_path)).collect()}
    assert got == {1: (3, digest("a\u00a0b")), 2: (None, None), 3: (0, digest(""))}


def test_breaks_are_those_of_the_sql(spark, tmp_path):
    pages = [(1, "a   b"), (2, "a\u00a0\u00a0\u00a0b"), (3, "a<pé>b"), (4, None), (5, "a &nbsp; &nbsp; b<lı>c")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["blocks"] for r in page_queries.page_breaks(spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: None, 5: 2}


def test_records_hand_on_the_parts_that_are_asked_for(spark):
    pages = page_queries.site_pages(spark, "/root/testdata/sf0.001")
    whole = pages_of(pages, None)
    some = pages_of(pages, ("header",))
    assert some.columns == whole.columns and [f.dataType for f in some.schema] == [f.dataType for f in whole.schema]
    same = ["site_number", "header", "content_sha256", "error"]
    assert sorted(map(str, some.select(same).collect())) == sorted(map(str, whole.select(same).collect()))
    assert some.where("updated IS NOT NULL OR passages IS NOT NULL OR body IS NOT NULL").isEmpty()
    with pytest.raises(ValueError):
        pages_of(pages, ("heading",))


def pages_of(pages, parts):
    return parse_pages(pages, region=page_queries.REGION, parts=parts)


def test_days_are_written_in_full(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1996-01-01', DATE'1996-12-31')) AS d").select("d", page_queries._day(F.col("d")).alias("s")).collect()
    ends = {1: "st", 2: "nd", 3: "rd", 21: "st", 22: "nd", 23: "rd", 31: "st"}
    assert all(r["s"] == f"{r['d'].day}{ends.get(r['d'].day, 'th')} {r['d']:%B %Y}" for r in days) and len(days) == 366
