import importlib
import math

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph, relational, retrieval
from cairn.plans import model
from cairn.sources import pages

PAGE = """<HTML><BODY><BIG><B>0001: Burro, Sima del (Bottom entrance) (Sistema de la Vega)</B></BIG><BR>
<SMALL><B>Añover</B> 30T 453898 4798123 (Datum: ETRS89. Accuracy code: <B>G</B>) <B>Altitude</B> 365m <B>Length</B> 94m <B>Depth</B> 50m
<a href="x">Area position</a> : <a href="y">Logbook search</a></small><P><I>Updated 1st March, 2nd April 2003</I><BR>
A dry cave.<P>It goes on for a good distance past the second pitch and ends in a boulder choke.
<SMALL><B>References</B>: Dorn J, 1983; material in file <B>Entrance picture</B>: <a href="../entpics/0001.htm">yes</a></SMALL></BODY></HTML>"""


def test_bm25_filters_inside_and_counts_outside(spark):
    d = spark.createDataFrame([(1, "one cave one", "a"), (2, "cave two", "b"), (3, "Añó nothing", "a"), (4, None, "a")], "k int, text string, s string")
    assert [r["k"] for r in retrieval.bm25(d, "k", "text", ["one", "two"]).collect()] in ([1, 2], [2, 1])
    narrowed = retrieval.bm25(d, "k", "text", ["cave", "two"], F.col("s") == "a").collect()
    assert [r["k"] for r in narrowed] == [1]
    assert [r["k"] for r in retrieval.bm25(d, "k", "text", ["ano"]).collect()] == [3]
    assert retrieval.bm25(d, "k", "text", retrieval.escape_query('"*():^-')).count() == 0
    assert retrieval.escape_query("Papá Noel (2)") == ["Papá", "Noel", "2"]


def test_first_wins_islands_percentiles_groups(spark):
    d = spark.createDataFrame([("a", 2), ("a", 1), ("b", 7), ("b", 3)], "k string, v int")
    assert sorted(map(tuple, relational.first_wins(d, ["k"], ["v"]).collect())) == [("a", 1), ("b", 3)]
    assert sorted(map(tuple, relational.islands(d, "v").collect())) == [(1, 3), (7, 7)]
    p = relational.index_percentiles(spark.range(1, 11).select(F.lit(1).alias("g"), "id"), "id", ["g"]).first()
    assert (p["min"], p["p50"], p["p90"], p["max"]) == (1, 6, 10, 10)
    g = spark.range(1).select(relational.greedy_groups(F.array(*map(F.lit, (5, 4, 3, 20, 1))), 10).alias("g")).first()["g"]
    assert g == [0, 0, 1, 2, 3]


def test_graph_and_distance(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    got = {r["node"]: r["depth"] for r in graph.neighbourhood(e, "a", "b", spark.createDataFrame([(1,)], "node int"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 9.0, 9.0), (4, None, 1.0)], "k int, x double, y double")
    assert [(r["k"], r["distance"]) for r in graph.nearby(p, "k", "x", "y", 1, 5.0).collect()] == [(2, 5.0)]
    assert graph.nearby(p, "k", "x", "y", 4, 5.0).count() == 0
    assert [(r["a"], r["b"]) for r in graph.radius_join(p, "k", "x", "y", 5.0).collect()] == [(1, 2)]
    lat, lon = spark.range(1).select(*graph.utm_to_wgs84(F.lit(453898.0), F.lit(4798123.0))).first()
    assert math.isclose(lat, 43.333, abs_tol=0.01) and math.isclose(lon, -3.569, abs_tol=0.01)


def test_roll_up_rrf_recall_snippet(spark):
    d = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", 2.0)], "g string, s double")
    assert {r["g"]: r["score"] for r in retrieval.roll_up(d, "g", "s").collect()} == {"a": 3.3, "b": 2.0}
    r1 = spark.createDataFrame([(1, 1), (2, 2)], "k int, rank int")
    assert [r["k"] for r in retrieval.rrf([(r1, 1.0), (r1.where("k = 2").withColumn("rank", F.lit(1)), 1.0)], "k").orderBy(F.desc("score")).collect()] == [2, 1]
    assert retrieval.snippet("one two Cave three", ["cave"], 2) == "…two «Cave»…"


def test_pages_to_tables(spark, tmp_path):
    (tmp_path / "0001.htm").write_text(PAGE, encoding="utf-8")
    silver = pages.parse_pages(pages.read_pages(spark, str(tmp_path))).cache()
    s = model.site(silver).first()
    assert (s["name"], s["name_sort"], s["length_m"], s["depth_m"], s["altitude_m"], s["easting"]) == ("Burro, Sima del", "sima del burro", 94.0, 50.0, 365.0, 453898)
    assert (s["area_raw"], s["update_count"], str(s["updated_last"])) == ("Añover", 2, "2003-04-02")
    assert {r["kind"] for r in model.site_alias(silver).collect()} == {"entrance_qualifier", "system_name"}
    works = model.citation(model.citation_use(silver))
    assert {(r["citation_key"], r["site_count"]) for r in works.collect()} == {("dorn j|1983||", 1), ("raw:material in file", 1)}
    assert [r["bucket"] for r in model.resource_link(silver).collect()] == ["entrance_pics"] and round(s["latitude"], 3) == 43.335
    assert pages.presence(spark, str(tmp_path), 1, 2).where("present").count() == 1
    with pytest.raises(FileNotFoundError):
        pages.read_pages(spark, _empty(tmp_path))


def _empty(tmp_path):
    (tmp_path / "empty").mkdir()
    return str(tmp_path / "empty")


def test_islands_across_blocks_and_their_text(spark):
    edge = relational.BLOCK
    d = spark.createDataFrame([(v,) for v in (1, 2, 3, 7, edge - 1, edge, edge + 1, 2 * edge, None, 2)], "v long")
    assert sorted(map(tuple, relational.islands(d, "v").collect())) == [(1, 3), (7, 7), (edge - 1, edge + 1), (2 * edge, 2 * edge)]
    assert relational.range_text(d.where("v < 10"), "v").first()["text"] == "0001-0003, 0007"
    assert relational.range_text(spark.range(0, 40, 2), "id", 3).first()["text"] == "0000, 0002, 0004, ... (+17 more ranges)"
    assert relational.range_text(d.limit(0), "v").first()["text"] == "none"


def test_carry_is_the_same_in_any_buckets(spark):
    rows = [("a", i, i % 3 == 0, float(i) if i % 4 == 1 else None) for i in range(20)] + [("b", 5, True, None)]
    d = spark.createDataFrame(rows, "k string, at int, head boolean, v double").withColumn("n", F.col("at") * 10)
    got = [sorted(map(str, relational.carry(d, ["k"], ["at"], F.floor(F.col("at") / width), F.col("head"), following="n", kept=F.col("v")).select("k", "at", "section", "next_value", "context").collect())) for width in (1, 3, 100)]
    assert got[0] == got[1] == got[2]
    last = [r for r in relational.carry(d, ["k"], ["at"], F.floor(F.col("at") / 3), F.col("head"), following="n", kept=F.col("v")).collect() if r["k"] == "a"]
    assert [(r["section"], r["next_value"], r["context"]) for r in sorted(last, key=lambda r: r["at"])][:3] == [(1, 10, 1.0), (1, 20, 1.0), (1, 30, 5.0)]


def test_overlap_anti_against_all_pairs(spark):
    import random

    rnd = random.Random(3)
    spans = [(i, rnd.choice("ab"), s, s + rnd.randint(1, 30)) for i in range(60) for s in [rnd.randint(0, 200)]]
    mine, others = spans[:40], spans[40:]
    frame = lambda own: spark.createDataFrame(own, "id int, k string, s int, e int")
    got = {r["id"] for r in relational.overlap_anti(frame(mine), frame(others), "k", "s", "e", 16).collect()}
    assert got == {i for i, k, s, e in mine if not any(k == q and s < z and y < e for _, q, y, z in others)}


def test_ids_without_gaps_are_the_same_in_reruns(spark):
    d = spark.range(500).select(F.concat(F.lit("n"), "id").alias("name"))
    ids = lambda df: {r["name"]: r["id"] for r in model.surrogate(df, "id", "name").collect()}
    assert ids(d) == ids(d.repartition(7)) and sorted(ids(d).values()) == list(range(1, 501))


def test_bm25_by_postings_and_one_split(spark):
    d = spark.createDataFrame([(i, f"cave number {i} " + "shaft " * (i % 4) + "long " * (i % 3)) for i in range(50)], "k int, text string")
    direct = retrieval.bm25(d, "k", "text", ["shaft", "long"])
    lengths = retrieval.postings(d, "k", "text").groupBy("k").agg(F.max("dl").alias("dl")).agg(F.avg("dl")).first()[0]
    stored = retrieval.bm25_postings(retrieval.postings(d, "k", "text"), "k", ["shaft", "long"], 50, lengths)
    assert [(r["k"], round(r["score"], 9)) for r in direct.collect()] == [(r["k"], round(r["score"], 9)) for r in stored.collect()]


def test_knn_batch_against_all_pairs(spark):
    d = spark.createDataFrame([(i, [float(i * 7 % 11), float(i * 5 % 13)]) for i in range(40)], "k int, v array<double>")
    got = {}
    for r in retrieval.knn_batch(d, d.where("k < 5").select(F.col("k").alias("query"), F.col("v").alias("q")), "k", "v", 3).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["k"]))
    v = {i: (i * 7 % 11, i * 5 % 13) for i in range(40)}
    for q in range(5):
        want = sorted((sum((a - b) ** 2 for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:3]
        assert [k for _, k in sorted(got[q])] == [i for _, i in want]


def test_registry_imports():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_digests_of_a_stream(spark, tmp_path):
    from cairn.streaming.incremental import keep_digests

    def step(rows):
        spark.createDataFrame(rows, "k int, text string").write.mode("append").parquet(str(tmp_path / "in"))
        keep_digests(spark.readStream.schema("k int, text string").parquet(str(tmp_path / "in")), "k", "text", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert step([(1, "a"), (2, "b")]) == 2
    assert step([(1, "a"), (2, "c"), (3, None)]) == 3
    assert step([(2, "b")]) == 4
