"""Quality of page records: anomalies, confidence by section, the review queue, the audit. Column expressions only.

Every check is a line of a table: code, severity, place and what it finds in a record. So a check can be read,
counted and changed by itself, and all of them run in one pass over the records without any exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import fixed

#: From the least to the gravest.
SEVERITIES = ("info", "warn", "error")
LOW = 0.8


Found = Column
Region = tuple[tuple[int, int], tuple[int, int]]
_FIND = "struct<detail:string,excerpt:string,char_offset:int>"


def _find(detail: Column | str, excerpt: Column | None = None, offset: Column | None = None) -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(text.alias("detail"), (F.lit(None) if excerpt is None else excerpt).cast("string").alias("excerpt"), (F.lit(None) if offset is None else offset).cast("int").alias("char_offset"))


def _times(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _if(condition: Column, detail: Column | str, excerpt: Column | None = None) -> Found:
    """One find where a condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_find(detail, excerpt))).otherwise(F.array().cast(f"array<{_FIND}>"))


def _each(path: str, condition, detail) -> Found:
    """A find for each entry of a list that meets a condition; none without the list."""
    found = F.transform(F.filter(F.col(path), condition), lambda x: _find(detail(x)))
    return F.coalesce(found, F.array().cast(f"array<{_FIND}>"))


def _having(path: str, condition) -> Column:
    """How many entries of a list meet a condition; 0 without the list."""
    return F.greatest(F.size(F.filter(F.col(path), condition)), F.lit(0))


def _quoted(text: Column, most: int) -> Column:
    return F.concat(F.lit("'"), F.left(text, F.lit(most)), F.lit("'"))


def _checks(region: Region = fixed.REGION) -> list[tuple[str, str, str | None, Found]]:
    """Code, severity, place, finds."""
    note = lambda name: F.col(f"notes.{name}")
    lacks = lambda name: ~F.col("segments_found")[name]
    title, header, cites, quantities, places = F.col("title"), F.col("header").isNotNull(), "footer.citations", "header.quantities", "header.coordinates"
    far = lambda c: ~(c["easting"].between(*region[0]) & c["northing"].between(*region[1]))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    shown = lambda name, text: F.transform(note(name), lambda x: _find(text, x["excerpt"], x["char_offset"]))
    in_words = lambda q: q["kind"] == "prose"
    unread = lambda q: (q["kind"] == "unknown") & (q["modifier"] == "exact") & (q["raw"] != "")
    out = [
        ("empty_document", "error", None, _if(note("blank"), "document is empty")),
        ("cp1252_fallback", "info", None, _if(F.col("encoding") == "cp1252", "not valid UTF-8; decoded as CP1252")),
        ("cp1252_fallback", "error", None, _if(F.col("encoding") == "latin-1", "neither UTF-8 nor CP1252; decoded as Latin-1")),
        ("mojibake_suspected", "error", None, shown("mojibake", "text that was decoded twice")),
        ("replacement_char", "error", None, shown("replaced", "replacement character in the source")),
        ("no_body_tag", "info", None, _if(~note("body_tag"), "document has no <BODY> tag")),
        ("missing_body_close", "warn", None, _if(~note("body_close"), "document has no </BODY> tag")),
        ("tts_wrapper_present", "warn", None, _if(note("speech"), "document holds a text-to-speech wrapper")),
        ("script_tag_present", "warn", None, _if(note("script"), "document contains a <script> block")),
        ("title_not_found", "error", "title", _if(title.isNull(), "no heading")),
        ("title_tag_order_swapped", "info", "title", _if(note("title_swapped"), "heading nests <B><BIG> rather than <BIG><B>")),
        ("title_number_mismatch", "warn", "title", _if(title["stated"] != F.col("site_number"), said("heading says ", title["stated"], ", the file ", F.col("site_number")))),
        ("title_space_separator", "info", "title", _if(title["separator"] == "space", "heading separates the number and name with a space, not a colon")),
        ("unbalanced_parens", "warn", "title", _if(~title["balanced"], said("brackets do not balance in ", _quoted(title["raw"], 80)))),
        ("title_name_empty", "warn", "title", _if(title["name"].isin("", "-"), said("heading has a number but no name (", _quoted(title["name"], 80), ")"))),
        ("alias_kind_unknown", "warn", "title.aliases", _each("title.aliases", lambda a: a["kind"] == "unknown", lambda a: said("alias ", _quoted(a["text"], 60), " is of no known kind"))),
        ("no_header_small", "warn", "header", _if(lacks("header"), "no <SMALL> info line between the heading and the footer")),
        ("header_boundary_not_found", "warn", "header", _if(~note("header_tail"), "header has no closing links; it goes to the first </SMALL>")),
        ("stray_small_in_header", "warn", "header", _if(note("header_closers") > 1, said(note("header_closers"), " </SMALL> tags close the header info line"))),
        ("area_missing", "warn", "header", _if(header & F.col("header.area_raw").isNull(), "no bolded area name")),
        ("coord_missing", "info", "header", _if(header & (F.size(places) == 0), "no coordinates")),
        ("coord_multiple", "warn", "header", _if(F.size(places) > 1, said(F.size(places), " coordinates — a multi-entrance site"))),
        ("coord_placeholder", "info", places, _each(places, lambda c: c["system"] == "placeholder", lambda c: said("unrecorded coordinate ", _quoted(c["raw"], 80)))),
        ("coord_legacy_vn", "info", places, _each(places, lambda c: c["system"] == "vn_grid", lambda c: said("old grid reference ", _quoted(c["raw"], 80)))),
        ("coord_out_of_range", "warn", places, _each(places, far, lambda c: said(_quoted(c["raw"], 80), " lies outside the region"))),
    ]
    for label in sorted(set(fixed.MEASUREMENTS.values()) - {"altitude"}):
        own = lambda test, label=label: lambda q: (q["label"] == label) & test(q)
        out.append(("measure_prose", "info", f"{quantities}.{label}", _each(quantities, own(in_words), lambda q, label=label: said(f"{label} is prose: ", _quoted(q["raw"], 80)))))
        out.append(("measure_unparsed", "warn", f"{quantities}.{label}", _each(quantities, own(unread), lambda q, label=label: said(f"cannot interpret {label} value ", _quoted(q["raw"], 60)))))
    return out + [
        ("measure_duplicate_label", "warn", "header", _if(F.size("header.duplicate_labels") > 0, said("labels that repeat: ", F.array_join("header.duplicate_labels", ", ")))),
        ("updated_markup_nested", "warn", "updated", _if(note("updated_open").isNotNull(), said("<", note("updated_open"), ">Updated…</", note("updated_open"), "> is never closed"))),
        ("updated_markup_nested", "warn", "updated", _if(note("updated_nested").isNotNull(), "Updated line contains nested markup", note("updated_nested"))),
        ("updated_date_unparsed", "warn", "updated", F.coalesce(F.transform(note("rejected_dates"), lambda x: _find(said("no date in ", _quoted(x, 60)))), F.array().cast(f"array<{_FIND}>"))),
        ("footer_boundary_not_found", "warn", "footer", _if(lacks("footer"), "no <B>Reference…</B> block")),
        ("footer_reference_missing", "warn", "footer", _if(F.col("footer").isNotNull() & F.col("footer.reference_label").isNull(), "footer has no Reference(s) label")),
        ("footer_label_unknown", "warn", "footer.fields", _if(note("footer_bare"), "footer begins with a bare label")),
        ("footer_label_unknown", "warn", "footer.fields", _each("footer.fields", lambda f: ~f["is_known_label"], lambda f: said("unrecognised footer label ", _quoted(f["label_raw"], 60)))),
        ("citation_split_anchors", "info", cites, _each(cites, lambda c: F.size(c["links"]) > 1, lambda c: said("citation ", _quoted(c["raw"], 60), " spans ", F.size(c["links"]), " anchors"))),
        ("citation_unparsed", "warn", cites, _each(cites, lambda c: (c["kind"] == "unparsed") & (F.trim(c["raw"]) != ""), lambda c: said("no author/year in ", _quoted(c["raw"], 60)))),
        ("citation_qualifier_unknown", "warn", cites, _each(cites, lambda c: c["qualifier"].isNotNull() & ~c["qualifier_is_known"], lambda c: said("qualifier ", _quoted(c["qualifier"], 200), " is not in the known vocabulary"))),
        ("body_empty", "warn", "body", _if(F.coalesce(F.col("body.text"), F.lit("")) == "", "description is empty")),
        ("body_leaked_header", "error", "body", F.coalesce(F.transform(note("header_words"), lambda w: _find(said("header words in the description: ", w))), F.array().cast(f"array<{_FIND}>"))),
        ("body_leaked_footer", "error", "body", _if(note("footer_words"), "footer markup in the description")),
        ("xref_self_reference", "info", "body.cross_refs", F.array_repeat(_find("page links to itself"), F.coalesce(note("own_links"), F.lit(0)))),
    ]


def _unknown_labels() -> Column:
    return _having("footer.fields", lambda f: ~f["is_known_label"])


def _list(region: Region = fixed.REGION) -> Column:
    """Anomalies of a record, one entry for each find of a check."""

    def entry(code: str, severity: str, path: str | None):
        return lambda x: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(path).cast("string").alias("field_path"), x["detail"].alias("detail"), x["excerpt"].alias("excerpt"), x["char_offset"].alias("char_offset"))

    return F.concat(*[F.transform(F.coalesce(found, F.array().cast(f"array<{_FIND}>")), entry(code, severity, path)) for code, severity, path, found in _checks(region)])


def _scores() -> Column:
    """Confidence by section: 1 less what each defect costs, 0 at least."""
    costs: dict[str, list[Column]] = {
        "title": [0.6 * _times(F.col("title").isNull()), 0.3 * _times(F.col("title.stated") != F.col("site_number")), 0.2 * _times(~F.col("title.balanced")), 0.4 * _times(F.col("title.name").isin("", "-"))],
        "header": [
            0.5 * _times(F.col("header").isNull() & ~F.col("is_stub")), 0.3 * _times(F.col("header").isNotNull() & F.col("header.area_raw").isNull()),
            0.15 * _times(F.size("header.coordinates") == 0), 0.05 * _having("header.quantities", lambda q: q["kind"] == "unknown"),
        ],
        "updated": [0.05 * F.greatest(F.size("notes.rejected_dates"), F.lit(0))],
        "body": [0.2 * _times(F.coalesce(F.col("body.text"), F.lit("")) == "")],
        "footer": [
            0.7 * _times(F.when(F.col("footer").isNull(), ~F.col("is_stub")).otherwise(F.col("footer.reference_label").isNull())),
            F.least(0.03 * _unknown_labels(), F.lit(0.15)), F.least(0.05 * _having("footer.citations", lambda c: c["kind"] == "unparsed"), F.lit(0.25)),
        ],
    }
    pairs = [x for name, own in costs.items() for x in (F.lit(name), F.round(F.greatest(F.lit(0.0), 1.0 - reduce(lambda a, b: a + b, own)), 3))]
    return F.create_map(*pairs)


def anomaly(silver: DataFrame, region: Region = fixed.REGION) -> DataFrame:
    """site_number, ordinal, code, severity, field_path, detail, excerpt, char_offset; ``region``: where coordinates lie."""
    return silver.select("site_number", F.posexplode(_list(region)).alias("ordinal", "x")).select("site_number", "ordinal", "x.*")


def parse_run(silver: DataFrame, region: Region = fixed.REGION) -> DataFrame:
    """One row a page: digest, segments found, confidence by section, its minimum, how many anomalies and the gravest."""
    out = silver.withColumns({"confidence": _scores(), "_found": F.transform(_list(region), lambda a: a["severity"])})
    gravest = reduce(lambda acc, s: acc.when(F.array_contains("_found", s), s), SEVERITIES[::-1], F.when(F.lit(False), F.lit(None).cast("string")))
    return out.select("site_number", "content_sha256", "segments_found", "confidence", F.array_min(F.map_values("confidence")).alias("min_confidence"), F.size("_found").alias("anomaly_count"), gravest.alias("max_severity"))


def review(silver: DataFrame, severity: str = "warn", code: str | None = None, limit: int = 50, region: Region = fixed.REGION) -> DataFrame:
    """site_number, name, min_confidence, hits, codes of pages with anomalies of a severity or graver, the least sure first."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity is one of {', '.join(SEVERITIES)}")
    wanted = SEVERITIES[SEVERITIES.index(severity) :]
    found = F.transform(F.filter(_list(region), lambda a: a["severity"].isin(*wanted) & (F.lit(True) if code is None else a["code"] == code)), lambda a: a["code"])
    out = silver.select("site_number", F.col("title.name").alias("name"), F.array_min(F.map_values(_scores())).alias("min_confidence"), found.alias("_codes"))
    out = out.select("site_number", "name", "min_confidence", F.size("_codes").alias("hits"), F.array_join(F.array_sort(F.array_distinct("_codes")), ",").alias("codes"))
    return out.where("hits > 0").orderBy("min_confidence", F.desc("hits"), "site_number").limit(limit)


def low_confidence(silver: DataFrame, below: float = LOW) -> DataFrame:
    """site_number, min_confidence, sections of pages that are unsure, the least sure first."""
    weak = F.filter(F.map_entries("_c"), lambda e: e["value"] < below)
    out = silver.select("site_number", _scores().alias("_c")).select("site_number", F.array_min(F.map_values("_c")).alias("min_confidence"), F.array_sort(F.transform(weak, lambda e: e["key"])).alias("sections"))
    return out.where(F.col("min_confidence") < below).orderBy("min_confidence", "site_number")


def audit(silver: DataFrame, below: float = LOW, region: Region = fixed.REGION) -> DataFrame:
    """label, value: pages, stubs, pages below a confidence, and anomalies by severity and by code."""
    pages = silver.agg(F.count("*").alias("pages"), F.count_if("is_stub").alias("stubs"), F.count_if(F.array_min(F.map_values(_scores())) < below).alias("low_confidence"))
    totals = pages.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in pages.columns])).alias("x")).select("x.*")
    labels = F.explode(F.array(F.concat(F.lit("severity_"), "severity"), F.concat(F.lit("code_"), "code")))
    return totals.unionByName(anomaly(silver, region).select(labels.alias("label")).groupBy("label").agg(F.count("*").alias("value")))


def coverage(silver: DataFrame, listed: int = 8) -> DataFrame:
    """segment, pages that have it, its share of all pages, and the first sites that lack it with how many more there are."""
    each = silver.select("site_number", F.explode("segments_found").alias("segment", "found"))
    lacking = each.where("not found").withColumn("_n", F.row_number().over(W.partitionBy("segment").orderBy("site_number"))).where(F.col("_n") <= listed)
    names = lacking.groupBy("segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("site_number")), lambda n: F.lpad(n.cast("string"), 4, "0")), ", ").alias("_names"))
    out = each.groupBy("segment").agg(F.count_if("found").alias("pages"), F.avg(F.col("found").cast("double")).alias("share"), F.count_if(~F.col("found")).alias("_lack"))
    more = F.when(F.col("_lack") > listed, F.concat(F.lit(", … (+"), (F.col("_lack") - listed).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return out.join(names, "segment", "left").select("segment", "pages", "share", F.concat(F.coalesce("_names", F.lit("")), more).alias("missing")).orderBy("segment")
