import hashlib

import pytest

from cairn.functions import body, overrides, passages
from cairn.functions.pages import parse_page
from cairn.plans import embedding, library, model, quality
from cairn.sources import pages

PAGE = """<HTML><BODY><BIG><B>{n:04d}: {name}</B></BIG><BR><SMALL><B>Area</B> 30T {e} 4798123 (Datum: ETRS89. Accuracy code: <B>G</B>) <B>Altitude</B> 365m <B>Length</B> {length}m
<a href="x">Area position</a> : <a href="y">Logbook search</a></small><P><I>Updated 1st March 2003</I><BR>
The entrance was dug in Easter 1999 and surveyed by Anna Berg and Carl Dorn. See 1975 for the {word}.<P><B>Wet Inlet</B><P>A long {word} passage leads to <a href="0002.htm">the second site</a> and a final choke.
<P><font color="#ff0000">This page needs work.</font><table><tr><td>Batch</td><td>Date</td></tr><tr><td>0001-01</td><td>May</td></tr></table>
<P><SMALL><B>References</B>: Dorn J, 1983; <B>Entrance picture</B>: <a href="../entpics/0001.htm">yes</a></SMALL></BODY></HTML>"""


def page(n: int, **own) -> bytes:
    return PAGE.format(**({"n": n, "name": f"Cave {n}", "e": 453000 + n, "length": n * 10, "word": "muddy"} | own)).encode()


def test_dates_claim_their_place_once():
    got = body.dates("Easter 1999, see 1975 and 9/4/23, batch 2001-02-03, in May 2004 or 1988; 31/2/99")
    assert [(d["kind"], d["year"]) for d in got] == [("survey_batch", None), ("dmy", 2023), ("dmy", None), ("season_year", 1999), ("month_year", 2004), ("year", 1988)]
    assert body.dates("") == [] and body.dates("in summer")[0]["kind"] == "season"


def test_people_need_evidence():
    assert [p["name_raw"] for p in body.people("dug by Anna Berg and Carl Dorn. Red Pike explored it. Anna Berg dived.")] == ["Anna Berg", "Carl Dorn"]
    assert body.people("found by Old Mill group") == [] and body.people("Cueva Hoyuca is long") == []


def test_outline_and_tables():
    found, sections = body.outline("<P>One.<P><B>Wet Inlet:</B><P>Two.<P><B>A whole sentence.</B><P><font color=ff0000>Red</font>")
    assert [b["kind"] for b in found] == ["paragraph", "section_heading", "paragraph", "paragraph", "editorial_note"]
    assert [(s["heading"], s["block_first"], s["block_last"]) for s in sections] == [("Wet Inlet", 1, 3)]
    assert body.tables("<table><tr><td>1</td><td>2.5</td></tr></table><table><tr></tr></table>") == [{"index": 0, "headers": [], "rows": [["1", "2.5"]], "looks_like": "unknown"}]
    b = body.parse_body("<P><B>Bat information</B><P>Date: 9/4/23 Species: horseshoe", 1)
    assert b["bat_observations"][0]["fields"] == {"Date": "9/4/23", "Species": "horseshoe"}


def test_references_leave_out_the_page_itself():
    got = body.references('<a href="0002.htm#x">two</a> <a href="0001.htm">own</a>', "see 0002, cave 0003 and site 1", 1)
    assert [(r["target_site"], r["kind"], r["fragment"]) for r in got] == [(2, "hyperlink", "x"), (3, "plaintext", None)]


def test_passages_pack_whole_blocks():
    assert passages.groups([400, 400, 400], 2, 0, 1600) == [0, 0, 1]
    assert passages.groups([1700, 10], 2, 0, 1600) == [0, 1]
    # The first piece stays whole with its joints: 500 + 400 is not beyond 900.
    assert passages.groups([500, 400], 2, 0, 1600) == [0, 0]
    long = "A sentence of some length here. " * 200
    parts = list(passages.pieces(long.strip()))
    assert len(parts) > 1 and all(len(p) <= passages.MOST + passages.REPEATED for p in parts)
    got = parse_page(1, page(1))["passages"]
    assert [p["kind"] for p in got] == ["card", "prose", "prose", "table", "editorial"]
    assert got[2]["text"].startswith("Site 0001 Cave 1 — Wet Inlet\n\n") and got[3]["text"].endswith("Batch: 0001-01; Date: May")


def test_overrides_hold_for_one_digest():
    raw = page(1)
    own = {"applies_to_sha256": hashlib.sha256(raw).hexdigest(), "fix": [{"field_path": "title.name", "value": "Other"}]}
    fixed = parse_page(1, raw, own)
    assert (fixed["override_status"], fixed["title"]["name"]) == ("active", "Other") and "Other" in fixed["passages"][0]["text"]
    assert parse_page(1, raw + b" ", own)["override_status"] == "stale"
    same = own | {"fix": [{"field_path": "header.coordinates[0].easting", "value": 453001}]}
    assert parse_page(1, raw, same)["override_status"] == "superseded"
    assert overrides.steps("a.b[1].c") == ["a", "b", 1, "c"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("site")
    for n, own in ((1, {}), (2, {"word": "sandy"}), (3, {"word": "muddy muddy", "e": 460000})):
        (folder / f"{n:04d}.htm").write_bytes(page(n, **own))
    (tmp_path_factory.getbasetemp() / "areas.toml").write_text('[canonical."The Area"]\nslug = "the_area"\nvariants = ["Area", "Ärea"]\n[unknown]\nmarkers = ["?"]\n', encoding="utf-8")
    out = str(tmp_path_factory.mktemp("build"))
    own = library.build(spark, str(folder), out, str(tmp_path_factory.getbasetemp() / "areas.toml"))
    return own["silver"], own


def test_counts_and_links(built):
    silver, own = built
    got = {r["label"]: r["value"] for r in library.counts(own).collect()}
    assert (got["area"], got["area_variant"], got["site_text"], got["citation_author"], got["author"]) == (1, 2, 3, 1, 1)
    assert (got["site"], got["section"], got["body_table"], got["person"], got["citation"], got["chunk"]) == (3, 3, 3, 2, 1, 15)
    refs = {(r["from_site"], r["to_site"], r["is_resolved"]) for r in own["cross_reference"].collect()}
    assert refs == {(1, 2, True), (3, 2, True), (1, 1975, False), (2, 1975, False), (3, 1975, False)}
    assert {r["site_number"] for r in library.site_graph(own, 2).collect()} == {1, 2, 3, 1975}
    assert library.get_site(silver, 2).count() == 1


def test_search(built):
    _, own = built
    top = library.search_passages(own, "sandy").collect()
    assert {r["site_number"] for r in top} == {2} and "«sandy»" in top[0]["snippet"]
    assert {r["site_number"] for r in library.search_sites(own, "muddy").collect()} == {1, 3}
    assert [r["site_number"] for r in library.search_sites(own, "muddy", library.Filters(min_length=20)).collect()] == [3]
    assert library.search_passages(own, "muddy", library.Filters(kinds=("table",))).count() == 0
    assert [r["snippet"] for r in library.search_sites(own, "cav").collect()] == ["(name match)"] * 3
    assert library.search_sites(own, '"*():').where("score > 0").count() == 0
    assert [r["site_number"] for r in library.nearby_sites(own, 1, 100).collect()] == [2]
    assert library.find_by_citation(own, "dorn", 1983).first()["site_count"] == 3
    assert library.find_by_citation(own, "dorn", 1984).count() == 0


def test_evaluation_and_vectors(spark, built):
    _, own = built
    q = spark.createDataFrame([("sandy", [2], "a"), ("sandy", [1], "b")], "query string, expect array<int>, kind string")
    assert {r["kind"]: r["recall"] for r in library.evaluate(own, q).collect()} == {"a": 1.0, "b": 0.0}
    v = own["chunk"].where("site_number < 3").selectExpr("chunk_id", "array(cast(site_number as float), 0f) as embedding")
    assert model.pending_chunks(own["chunk"], v).count() == 5
    assert model.carry_vectors(own["chunk"], own["chunk"], v).count() == 10
    near = library.search_passages(own | {"vector": v}, "sandy", limit=3, encode=lambda _: [2.0, 0.0]).collect()
    assert near[0]["site_number"] == 2


def test_quality(spark, built, tmp_path):
    silver, own = built
    assert [(r["site_number"], r["code"], r["severity"]) for r in own["anomaly"].collect()] == [(2, "xref_self_reference", "info")]
    assert {tuple(sorted(r["confidence"].items())) for r in own["parse_run"].collect()} == {(("body", 1.0), ("footer", 1.0), ("header", 1.0), ("title", 1.0), ("updated", 1.0))}
    assert quality.review(silver).count() == 0 and quality.low_confidence(silver).count() == 0
    bad = """<B><BIG>0009 -</BIG></B><SMALL><B>Length</B> ++ <B>Length</B> see 0002 for it</SMALL></SMALL></SMALL>
    <I>Updated someday, 1st May 2001</I> Text with <a href="0008.htm">itself</a> \ufffd Logbook search <B>References</B>: Dorn J, 1983 (by post); something odd; <B>Strange</B>: x"""
    (tmp_path / "0008.htm").write_bytes(bad.encode())
    (tmp_path / "0009.htm").write_bytes(b" ")
    pages.parse_pages(pages.read_pages(spark, str(tmp_path))).write.parquet(str(tmp_path / "silver"))
    got = spark.read.parquet(str(tmp_path / "silver"))
    found = {n: sorted(r["code"] for r in quality.anomaly(got).where(f"site_number = {n}").collect()) for n in (8, 9)}
    assert found[8] == sorted(["replacement_char", "no_body_tag", "missing_body_close", "title_tag_order_swapped", "title_number_mismatch", "title_space_separator", "title_name_empty", "header_boundary_not_found", "stray_small_in_header", "area_missing", "coord_missing", "measure_unparsed", "measure_prose", "measure_duplicate_label", "updated_date_unparsed", "footer_label_unknown", "footer_label_unknown", "citation_qualifier_unknown", "citation_unparsed", "body_leaked_header", "xref_self_reference"])
    assert found[9] == sorted(["empty_document", "no_body_tag", "missing_body_close", "title_not_found", "no_header_small", "footer_boundary_not_found", "body_empty"])
    runs = {r["site_number"]: r for r in quality.parse_run(got).collect()}
    assert runs[8]["confidence"] == {"title": 0.3, "header": 0.5, "updated": 0.95, "body": 1.0, "footer": 0.92} and runs[8]["max_severity"] == "error"
    assert (runs[9]["min_confidence"], runs[9]["confidence"]["header"], runs[9]["anomaly_count"]) == (0.4, 1.0, 7)
    queue = quality.review(got).collect()
    assert [r["site_number"] for r in queue] == [8, 9] and quality.review(got, "error", "body_leaked_header").first()["hits"] == 1
    audit = {r["label"]: r["value"] for r in quality.audit(got).collect()}
    assert (audit["pages"], audit["stubs"], audit["low_confidence"], audit["code_footer_label_unknown"]) == (2, 1, 2, 2)
    assert {r["segment"]: r["pages"] for r in quality.coverage(got).collect()}["title"] == 1
    with pytest.raises(ValueError):
        quality.review(got, "grave")


def test_build_is_gated_and_points_at_the_last_one(spark, built, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "0001.htm").write_bytes(page(1))
    (tmp_path / "a.toml").write_text('[canonical."Elsewhere"]\nslug = "elsewhere"\n', encoding="utf-8")
    with pytest.raises(library.UnmappedAreas, match="'Area'"):
        library.build(spark, str(tmp_path / "p"), str(tmp_path / "b"), str(tmp_path / "a.toml"))
    assert not (tmp_path / "b" / "current").exists()
    assert library.build(spark, str(tmp_path / "p"), str(tmp_path / "b"))["site"].count() == 1
    (tmp_path / "p" / "0002.htm").write_bytes(page(2))
    library.build(spark, str(tmp_path / "p"), str(tmp_path / "b"))
    assert library.current(spark, str(tmp_path / "b"))["site"].count() == 2


def test_areas_stats_audit_show(spark, built, tmp_path):
    silver, own = built
    assert [r["site_number"] for r in library.Filters(area="the_ar").sites(own).orderBy("site_number").collect()] == [1, 2, 3]
    assert library.Filters(area="nowhere").sites(own).count() == 0
    stats = {r["label"]: r["value"] for r in library.stats(own).collect()}
    assert len(stats) == 31 and (stats["sites"], stats["  with an area"], stats["  with coordinates"], stats["areas"], stats["  to a missing page"], stats["  errors"]) == (3, 3, 3, 1, 3, 0)
    for n, extra in ((1, b""), (2, b" "), (4, b"")):
        (tmp_path / f"{n:04d}.htm").write_bytes((page(n) if n != 2 else page(2, word="sandy")) + extra)
    found = pages.read_pages(spark, str(tmp_path))
    changes, metrics = library.audit(own, found)
    assert [(r["site_number"], r["change"]) for r in changes.collect()] == [(2, "changed"), (4, "new"), (3, "vanished")]
    assert {r["metric"]: r["value"] for r in metrics.collect()}["citations"] == 3 and metrics.count() == 7
    again = library.reparse(silver, found)
    assert sorted(r["site_number"] for r in again.collect()) == [1, 2, 4]
    one = library.show(own, 1).first()
    assert (one["name"], len(one["quantity"]), one["cross_reference"][0]["to_site"]) == ("Cave 1", 1, 2)
    assert {r["rows"] for r in library.broken(own).collect()} == {0} and library.broken(own | {"author": own["author"].limit(0)}).where("rows > 0").count() == 1
    assert 43.2 < one["latitude"] < 43.5 and -3.7 < one["longitude"] < -3.4


def test_embedding_and_failing_encoders(built):
    _, own = built
    v = embedding.embed_pending(own["chunk"])
    assert v.count() == own["chunk"].count() and embedding.embed_pending(own["chunk"], v).count() == 0
    assert embedding.is_available(v) and not embedding.is_available(None) and not embedding.is_available(v.limit(0))
    both = own | {"vector": v}
    assert library.search_passages(both, "sandy passage", limit=3, encode=embedding.encode_query).first()["site_number"] == 2

    def fails(_):
        raise OSError("no model")

    def missing(_):
        raise embedding.EncoderMissing("no package")

    assert {r["site_number"] for r in library.search_passages(both, "sandy", encode=fails).collect()} == {2}
    with pytest.raises(embedding.EncoderMissing):
        library.search_passages(both, "sandy", encode=missing)
    q = own["site"].sparkSession.createDataFrame([("sandy", [2], "a")], "query string, expect array<int>, kind string")
    assert library.compare(both, q, embedding.encode_query).first()["verdict"] == "level"


def test_a_page_that_fails_is_a_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, page(1)), (2, None)], "site_number int, content binary").select("site_number", "content", F.lit("p").alias("path"), F.lit(1).cast("long").alias("byte_size"), F.lit("d").alias("content_sha256"))
    got = {r["site_number"]: r for r in pages.parse_pages(rows).collect()}
    assert got[1]["error"] is None and got[2]["error"] and got[2]["title"] is None


def test_commands(spark, built, tmp_path, capsys):
    from cairn.__main__ import main

    (tmp_path / "0007.htm").write_bytes(page(7))
    for command in ("decode", "segment", "parse"):
        main([command, str(tmp_path / "0007.htm")])
    out = str(tmp_path / "builds")
    main(["build", str(tmp_path), "--out", out], spark)
    for line in ("stats", f"audit {tmp_path}", "review", "embed", "search muddy --vectors", "show 7", "nearby 7", "graph 7", f"export {tmp_path}/json"):
        name, *rest = line.split()
        main([name, *rest, "--out", out], spark)
    said = capsys.readouterr().out
    assert '"encoding": "utf-8"' in said and "Cave 7" in said and spark.read.json(f"{tmp_path}/json").count() == 1


def test_pages_over_http(spark, tmp_path):
    import functools
    import http.server
    import threading

    from cairn.sources import download

    for n in (1, 2):
        (tmp_path / f"{n:04d}.htm").write_bytes(page(n))

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_address[1]}/{{:04d}}.htm"
        got = download.fetch_pages(spark, url, 1, 3, spark.createDataFrame([(2,)], "site_number int")).collect()
        assert sorted((r["site_number"], r["status"]) for r in got) == [(1, 200), (3, 404)]
        assert {r["content_sha256"] for r in got if r["content"]} == {hashlib.sha256(page(1)).hexdigest()}
        assert pages.parse_pages(download.fetch_pages(spark, url, 1, 1)).first()["title"]["name"] == "Cave 1"
    finally:
        server.shutdown()
