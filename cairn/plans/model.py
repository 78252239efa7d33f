"""From nested records to relational tables: dimensions by first occurrence, facts by explode, counts pre-aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.relational import first_wins
from cairn.operators.retrieval import fold


#: Parts that ids are counted in.
PARTS = 256


def surrogate(df: DataFrame, name: str, *key: str) -> DataFrame:
    """Ids without gaps, a function of the rows' keys alone: the place within a part of the keys' hashes, after smaller parts."""
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(PARTS)))
    smaller = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(smaller), F.lit(0))).select("_part", "_base")
    place = F.row_number().over(W.partitionBy("_part").orderBy(*key))
    return dealt.join(F.broadcast(base), "_part").withColumn(name, (F.col("_base") + place).cast("long")).drop("_part", "_base")  # PARTS rows


def _each(silver: DataFrame, path: str) -> DataFrame:
    return silver.select("site_number", F.posexplode(path).alias("ordinal", "x")).select("site_number", "ordinal", "x.*")


def site(silver: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """One row a site; with ``variants`` (folded, area_id) of the vocabulary the area's id too."""
    out = _site(silver)
    if variants is None:
        return out
    known = F.broadcast(variants.select("folded", "area_id"))  # a vocabulary file
    return out.withColumn("_folded", area_key(F.col("area_raw"))).join(known, F.col("_folded") == F.col("folded"), "left").drop("folded", "_folded")


def area_key(raw: Column) -> Column:
    return F.regexp_replace(F.trim(fold(raw)), r"\s+", " ")


def area(vocabulary: DataFrame) -> DataFrame:
    """area_id, name, slug of the areas of a vocabulary (folded, name, slug)."""
    return surrogate(vocabulary.select("name", "slug").distinct(), "area_id", "name", "slug")


def area_variant(vocabulary: DataFrame, areas: DataFrame) -> DataFrame:
    """folded, area_id, source: every spelling of every area."""
    return vocabulary.join(F.broadcast(areas), ["name", "slug"]).select("folded", "area_id", F.lit("corpus").alias("source"))


def _site(silver: DataFrame) -> DataFrame:
    measure = lambda label: F.get(F.filter("header.quantities", lambda q: (q["label"] == label) & q["kind"].isin("numeric", "compound")), F.lit(0))["value_m"]
    primary = F.coalesce(F.get(F.filter("header.coordinates", lambda c: c["easting"].isNotNull()), F.lit(0)), F.get("header.coordinates", F.lit(0)))
    dates = F.transform("updated", lambda u: u["date"])
    return silver.select(
        "site_number", F.col("title.name").alias("name"), F.col("title.name_sort").alias("name_sort"), F.col("title.site_type").alias("site_type"), F.col("header.area_raw").alias("area_raw"), F.col("body.text").alias("body_text"), F.col("body.char_count").alias("body_chars"),
        F.col("body.is_minimal").alias("is_minimal"), "is_stub", F.array_min(dates).alias("updated_first"), F.array_max(dates).alias("updated_last"), F.size("updated").alias("update_count"), measure("length").alias("length_m"), measure("depth").alias("depth_m"),
        primary["altitude_m"].alias("altitude_m"), primary["easting"].alias("easting"), primary["northing"].alias("northing"), primary["latitude"].alias("latitude"), primary["longitude"].alias("longitude"), F.col("footer.raw").alias("footer_raw"),
    )


def site_alias(silver: DataFrame) -> DataFrame:
    return _each(silver, "title.aliases").toDF("site_number", "ordinal", "text", "kind", "target_site")


def coordinate(silver: DataFrame) -> DataFrame:
    return _each(silver, "header.coordinates")


def quantity(silver: DataFrame) -> DataFrame:
    """Measurements; what one in words relates to stands beside it."""
    return _each(silver, "header.quantities").select("*", "prose.*").drop("prose")


def update_date(silver: DataFrame) -> DataFrame:
    return _each(silver, "updated").withColumnRenamed("date", "edited_on")


def block(silver: DataFrame) -> DataFrame:
    return _each(silver, "body.blocks")


def section(silver: DataFrame) -> DataFrame:
    return _each(silver, "body.sections")


def body_table(silver: DataFrame) -> DataFrame:
    return _each(silver, "body.tables").drop("ordinal")


def bat_observation(silver: DataFrame) -> DataFrame:
    return _each(silver, "body.bat_observations").withColumnRenamed("date", "observed_on")


def cross_reference(silver: DataFrame) -> DataFrame:
    """References with is_resolved: the site that is named has a page."""
    refs = _each(silver, "body.cross_refs").withColumnRenamed("site_number", "from_site").withColumnRenamed("target_site", "to_site")
    known = silver.select(F.col("site_number").alias("to_site"), F.lit(True).alias("_known"))
    return refs.join(known, "to_site", "left").withColumn("is_resolved", F.coalesce("_known", F.lit(False))).drop("_known")


def date_mention(silver: DataFrame) -> DataFrame:
    return _each(silver, "body.dates")


def person_mention(silver: DataFrame) -> DataFrame:
    return _each(silver, "body.people")


def person(mentions: DataFrame) -> DataFrame:
    counts = mentions.groupBy("name_raw").agg(F.count("*").alias("mention_count"))
    return surrogate(counts, "person_id", "name_raw")


def system_member(silver: DataFrame) -> DataFrame:
    """name, site_number: systems that a measurement says the site is a part of."""
    return quantity(silver).where("system_name IS NOT NULL").select(F.col("system_name").alias("name"), "site_number").distinct()


def cave_system(members: DataFrame) -> DataFrame:
    """system_id, name, members: how many sites are parts of a system."""
    return surrogate(members.groupBy("name").agg(F.count("*").alias("members")), "system_id", "name")


def site_text(silver: DataFrame) -> DataFrame:
    """site_number, name, aliases, body_text, footer_text, names: what whole sites and their names are searched by."""
    aliases = F.array_join(F.transform("title.aliases", lambda a: a["text"]), " ")
    name = F.coalesce("title.name", F.lit(""))
    names = F.concat_ws(" ", name, "title.name_sort", aliases)
    return silver.select("site_number", name.alias("name"), F.coalesce(aliases, F.lit("")).alias("aliases"), F.col("body.text").alias("body_text"), F.coalesce("footer.raw", F.lit("")).alias("footer_text"), names.alias("names"))


def chunk(silver: DataFrame) -> DataFrame:
    """Passages for search. The id is made of site and place, so no exchange gives it; the digest tells texts that changed."""
    each = _each(silver, "passages")
    key = F.shiftleft(F.col("site_number").cast("long"), 32) + F.col("ordinal")
    return each.select(key.alias("chunk_id"), "*", F.sha2("text", 256).alias("content_sha256"))


def pending_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Passages without a vector."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def carry_vectors(chunks: DataFrame, old_chunks: DataFrame, old_vectors: DataFrame) -> DataFrame:
    """chunk_id, embedding: vectors of an earlier build for texts that did not change, met by digest."""
    known = old_chunks.select("chunk_id", "content_sha256").join(old_vectors, "chunk_id").groupBy("content_sha256").agg(F.min_by("embedding", "chunk_id").alias("embedding"))
    return chunks.select("chunk_id", "content_sha256").join(known, "content_sha256").select("chunk_id", "embedding")


def footer_field(silver: DataFrame) -> DataFrame:
    return _each(silver, "footer.fields").drop("links", "order")


def citation_use(silver: DataFrame) -> DataFrame:
    return silver.select("site_number", F.explode("footer.citations").alias("c")).select("site_number", "c.*")


def citation(uses: DataFrame) -> DataFrame:
    """Works by key, as first cited, with the number of sites that cite them."""
    first = first_wins(uses.select("citation_key", "raw", "author_raw", "authors", "year", "disambiguator", "qualifier", "qualifier_is_known", "kind", "site_number", "ordinal"), ["citation_key"], ["site_number", "ordinal"])
    counts = uses.groupBy("citation_key").agg(F.countDistinct("site_number").alias("site_count"))
    return surrogate(first.join(counts, "citation_key"), "citation_id", "citation_key").drop("site_number", "ordinal")


def author(works: DataFrame) -> DataFrame:
    return surrogate(works.select(F.explode("authors").alias("name")).groupBy("name").agg(F.count("*").alias("citation_count")), "author_id", "name")


def citation_author(works: DataFrame, authors: DataFrame) -> DataFrame:
    """citation_id, author_id, ordinal: who wrote a work, in order."""
    each = works.select("citation_id", F.posexplode("authors").alias("ordinal", "name"))
    return each.join(authors.select("author_id", "name"), "name").groupBy("citation_id", "author_id").agg(F.min("ordinal").alias("ordinal"))


def resource_link(silver: DataFrame) -> DataFrame:
    """Links by origin: footer fields, citations, attachments."""
    field = silver.select("site_number", F.explode("footer.fields").alias("f")).select("site_number", F.explode("f.links").alias("l"), F.lit("footer_field").alias("origin"))
    uses = citation_use(silver)
    cite = uses.select("site_number", F.explode("links").alias("l"), F.lit("citation").alias("origin"))
    attached = uses.select("site_number", F.explode("attachments").alias("l"), F.lit("attachment").alias("origin"))
    return field.unionByName(cite).unionByName(attached).select("site_number", "l.*", "origin")


def unmapped_areas(sites: DataFrame, markers: list[str]) -> DataFrame:
    """area_raw: spellings that the vocabulary lacks, but for ``markers`` of unknown areas; a build stops unless there are none."""
    return sites.where(F.col("area_id").isNull() & F.col("area_raw").isNotNull() & ~F.col("area_raw").isin(markers)).select("area_raw").distinct()


def broken_keys(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of a child without a parent."""
    return child.join(parent.select(F.col(key).alias("_key")), F.col(column) == F.col("_key"), "left_anti")
