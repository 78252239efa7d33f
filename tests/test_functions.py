import datetime as dt

import pytest

from cairn.functions import markup, pages, text
from cairn.plans.guard import allowed


def test_decoding_falls_back_and_never_fails():
    assert text.decode_bytes(b"Lena\x92s shaft") == ("Lena’s shaft", "cp1252")
    assert text.decode_bytes("größer".encode()) == ("größer", "utf-8")
    whole, name = text.decode_bytes(bytes([*range(0x80, 0xA0), 0x41]))
    assert (len(whole), name) == (33, "latin-1")
    assert text.normalise_source("one\r\ntwo\rthree") == "one\ntwo\nthree"
    assert text.normalise_source("x\x01y\x0bz\tw") == "xyz\tw"
    assert text.unescape("Ko&#776;ln &lt;3") == "Köln <3"
    assert text.entity_defects("a &nosuch; b &amp c") == ["&nosuch;", "&amp"]


def test_blocks_and_keys():
    assert len(text.blocks("<p>Up.<hr>Down.<li>Left.</li><div>Right</div>")) == 4
    assert len(text.blocks("Up. &nbsp; &nbsp; &nbsp; Down.")) == 2
    assert text.sort_key("Bär, Höhle vom") == "hohle vom bar"
    assert text.sort_key("Plain Name") == "plain name"


def test_markup():
    found = markup.labels("<b>One:</b> a <B>Two</B> : b <b><i>no</i></b> <b>Three", 10)
    assert [(x.text, v.strip()) for x, v in zip(found, markup.values("<b>One:</b> a <B>Two</B> : b <b><i>no</i></b> <b>Three", found), strict=True)] == [("One", "a"), ("Two", "b <b><i>no</i></b> <b>Three")]
    nested = "<i>a <i>b</i> c</i> d"
    assert markup.close_of(nested, next(markup.tags(nested)), len(nested)).end == len(nested) - 2
    assert [a["href"] for a in text.anchors('<a href="x.htm" target=_blank">x</a> <a name="n">y</a> <a href=z.htm>z')] == ["x.htm", "z.htm"]


def test_titles():
    assert pages.split_aliases("Deep Hole (17 (old: A2)) (B)") == ("Deep Hole", ["17 (old: A2)", "B"], True)
    assert pages.split_aliases("open (never shut") == ("open", ["never shut"], False)
    assert pages.split_aliases("shut) only") == ("shut only", [], False)
    assert [pages.site_type(n) for n in ("rifts-4", "holes - 12", "The rock shelter", "Great Cave")] == ["rifts", "holes", "rock shelter", None]
    t = pages.parse_title("0012 : Deep Hole (2040)", 12)
    assert (t["stated"], t["name"], t["separator"], t["aliases"]) == (12, "Deep Hole", "colon", [{"text": "2040", "kind": "bare_number", "site_number": 2040}])
    assert pages.parse_title("no number", 1) is None and pages.parse_title("0012Deep", 12) is None


@pytest.mark.parametrize(
    "line, expected",
    [
        ("4th May, 11th, 12th June, 30th July 1998", [(1998, 5, 4), (1998, 6, 11), (1998, 6, 12), (1998, 7, 30)]),
        ("2nd December 2011; 5th February; 9th April 2013", [(2011, 12, 2), (2013, 2, 5), (2013, 4, 9)]),
        ("21st - 23rd August 2000", [(2000, 8, 21)]),
        ("3/11/07", [(2007, 11, 3)]),
        ("17th Au gust 2016", [(2016, 8, 17)]),
        ("8th Septmber 2010", [(2010, 9, 8)]),
        ("6th March, 2014", [(2014, 3, 6)]),
        ("1st April 2nd May 2005", [(2005, 4, 1), (2005, 5, 2)]),
        ("30th February 2012, 32nd May 2012", []),
        ("January 2020", [(2020, 1, 1)]),
    ],
)
def test_updates(line, expected):
    assert [e["date"] for e in pages.parse_updated(f"<I>Updated {line}</I>")] == [dt.date(*d) for d in expected]


def test_citations_and_links():
    assert pages.split_units("M&uuml;ller, 1971; Weiss, 1980;")[:2] == ["M&uuml;ller, 1971", " Weiss, 1980"]
    c = pages.parse_citation('Weiss B and Vogel C, 1987c (<a href="p.pdf">spring</a> &amp; <a href="q.pdf">winter</a>)', 0)
    assert (c["authors"], c["year"], c["disambiguator"], c["qualifier"], len(c["links"]), c["kind"]) == (["Weiss B", "Vogel C"], 1987, "c", "spring & winter", 2, "publication")
    assert [pages.parse_citation(x, 0)["kind"] for x in ("file", "Photo.", "pers comm, by letter 1990", "anon., 1977 (x)", "Weiss, 1980 (survey)", "Weiss, 1980 (their log book)", "words only")] == ["provenance", "provenance", "provenance", "logbook", "survey", "logbook", "unparsed"]
    kept = pages.parse_citation('<a href="a.pdf">Vogel, 1990?</a> (<a href="../surveys/b.png">plan</a>)', 0)
    assert (kept["year"], [x["bucket"] for x in kept["links"]], [x["bucket"] for x in kept["attachments"]]) == (1990, ["other"], ["survey_image"])
    assert [pages.target_site(h) for h in ("../ugpics/0412-1998s.htm", "0412-kb.htm#x", "../0412.htm?y", "index.htm")] == [(412, True), (412, False), (412, False), (None, False)]
    assert [pages.classify_link(h) for h in ("#map", "https://vimeo.com/1", "../surveys/x.tro", "0412.htm", "../descrip/0412.htm", "../video/a.avi", "https://example.org/0412.htm")] == ["anchor", "video_external", "survey_3d", "site_page", "site_page", "video_file", "external"]
    assert pages.classify_link("https://www.example.org/entpics/0412.htm", ("example.org",)) == "entrance_pics"


def test_quantities():
    q = pages.parse_quantity
    kinds = {x: (q("length", x)["kind"], q("length", x)["value_m"], q("length", x)["modifier"]) for x in ("12.5m", "c. 30m", "< 8m", "up to 9m", "40m+", "15m?", "7m & 8m?", "from 90m down to 60m", "??m", "++", "")}
    assert kinds == {
        "12.5m": ("numeric", 12.5, "exact"), "c. 30m": ("numeric", 30, "circa"), "< 8m": ("numeric", 8, "at_most"), "up to 9m": ("numeric", 9, "at_most"), "40m+": ("numeric", 40, "at_least"), "15m?": ("numeric", 15, "uncertain"),
        "7m & 8m?": ("compound", 15, "uncertain"), "from 90m down to 60m": ("range", 30, "exact"), "??m": ("unknown", None, "uncertain"), "++": ("unknown", None, "exact"), "": ("unknown", None, "exact"),
    }
    assert q("vertical_range", "-20m")["modifier"] == "relative" and q("depth", "-20")["unit_stated"] is False
    words = q("length", 'included in <a href="0512.htm">that one</a> and 0600')["prose"]
    assert (words["relation"], words["target_sites"]) == ("included_in", [512, 600])
    assert q("length", "(300m added to the Long System)")["prose"] == {"relation": "added_to", "target_sites": [], "system_name": "Long System", "extra_value_m": 300.0}


def test_segments():
    page = "<B><BIG>0001: X</BIG></B><SMALL><B>Area</B> no closing links"
    spans = pages.segment(page)
    assert page[slice(*spans["header"])] == "<SMALL>" and spans["footer"] is None
    page = '<BIG><B>0001: X</B></BIG><small>a</small><P>b<p><a name="r"> <b>References</b>: c<div id=openModal>d</div>'
    spans = pages.segment(page)
    assert page[slice(*spans["footer"])].startswith("<p><a name") and page[slice(*spans["modal"])] == "<div id=openModal>d</div>" and page[slice(*spans["body"])] == "<P>b"


def test_sql_guard():
    assert all(allowed(s) for s in ("SELECT count(*) FROM site", "  select 1", "WITH x AS (SELECT 1) SELECT * FROM x"))
    assert not any(allowed(s) for s in ("DROP TABLE site", "SELECT 1; DROP TABLE site", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc/x`", "VACUUM"))


def test_area_opens_the_line():
    area = lambda markup: pages.parse_header(markup)["area_raw"]
    assert area("<SMALL><B>Riva</B> 30T 453001 4798123 <B>Length</B> 3m</SMALL>") == "Riva"
    assert area("<SMALL>La Gatuna? VN???????? Alt. ???m <B>Length</B> 3m</SMALL>") == "La Gatuna"
    assert area("<SMALL><B>Riva <I>30T</I> 453001 4798123</SMALL>") == "Riva"
    assert area("<SMALL><B>Length</B> 3m <B>Area</B></SMALL>") is None


def test_updates_without_commas():
    days = lambda line: [str(u["date"]) for u in pages.parse_updated(f"<I>Updated {line}</I>")]
    assert days("3rd June 14th July 1999") == ["1999-06-03", "1999-07-14"]
    assert days("5th May 2001; March 8th, April 9th 2002") == ["2001-05-05", "2002-03-08", "2002-04-09"]
    rejected: list[str] = []
    assert pages.parse_updated("<I>Updated someday, 1st May 2001</I>", rejected)[0]["date"] == dt.date(2001, 5, 1) and rejected == ["someday"]
