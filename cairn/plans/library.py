"""The tables of a build, and what is asked of them: search, one site, neighbours, links, citations, counts, evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import graph, relational, retrieval
from cairn.operators.once import stored
from cairn.plans import embedding, model, quality
from cairn.sources import pages

# Passages that a search of sites looks at, and that each side of a fusion gives.
SITE_POOL, FUSION_POOL = 200, 100


def tables(silver: DataFrame, vocabulary: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table of the model. ``silver`` should be read from where it was written: each table reads it again.

    ``vocabulary``: folded, name, slug of every spelling of the areas; without it sites have no area ids.
    """
    uses, mentions = model.citation_use(silver), model.person_mention(silver)
    works, members = model.citation(uses), model.system_member(silver)
    authors = model.author(works)
    each = (model.site_alias, model.coordinate, model.quantity, model.update_date, model.block, model.section, model.body_table, model.bat_observation, model.cross_reference, model.date_mention, model.footer_field, model.resource_link, model.chunk, model.site_text, quality.anomaly, quality.parse_run)
    out = {f.__name__: f(silver) for f in each}
    out |= {"citation_use": uses, "citation": works, "author": authors, "citation_author": model.citation_author(works, authors), "person_mention": mentions, "person": model.person(mentions), "system_member": members, "cave_system": model.cave_system(members)}
    if vocabulary is None:
        return out | {"site": model.site(silver)}
    areas = model.area(vocabulary)
    variants = model.area_variant(vocabulary, areas)
    return out | {"area": areas, "area_variant": variants, "site": model.site(silver, variants)}


class UnmappedAreas(ValueError):
    """Pages name areas that the vocabulary lacks."""


def build(spark: SparkSession, folder: str, out: str, vocabulary: str | None = None, overrides: str | None = None) -> dict[str, DataFrame]:
    """Parse a folder of pages and write every table below ``out`` in a folder of its own; then point ``out``/current at it.

    An area that the vocabulary lacks stops the build before any table is written: it would split a place in two.
    """
    version = f"{out}/build-{uuid.uuid4().hex[:12]}"
    fixes = pages.read_overrides(overrides) if overrides else None
    pages.parse_pages(pages.read_pages(spark, folder), fixes).write.parquet(f"{version}/silver")
    silver = spark.read.parquet(f"{version}/silver")
    own = tables(silver, pages.read_areas(spark, vocabulary) if vocabulary else None)
    if vocabulary:
        lacking = sorted(r[0] for r in model.unmapped_areas(own["site"], pages.unknown_areas(vocabulary)).limit(50).collect())
        if lacking:
            raise UnmappedAreas(f"not in {vocabulary}: {', '.join(map(repr, lacking))}")
    write(own, version)
    names = ",".join(sorted([*own, "silver"]))
    spark.range(1).select(F.lit(version).alias("version"), F.lit(names).alias("tables")).write.mode("overwrite").json(f"{out}/current")
    return current(spark, out)


def current(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the last build that was finished."""
    row = spark.read.json(f"{out}/current").first()
    return read(spark, row["version"], row["tables"].split(","))


def write(own: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet in a folder of its own; a build never overwrites another."""
    for name, df in own.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def reparse(silver: DataFrame, found: DataFrame, overrides: dict[int, dict] | None = None) -> DataFrame:
    """Records of the pages in ``found`` (as ``read_pages`` gives them): those of ``silver`` whose digest is the same, the
    others parsed anew; what vanished is left out."""
    same = silver.join(found.select("site_number", "content_sha256"), ["site_number", "content_sha256"], "left_semi")
    delta = found.join(silver.select("site_number", "content_sha256"), ["site_number", "content_sha256"], "left_anti")
    return same.unionByName(pages.parse_pages(delta, overrides))


@dataclass(frozen=True)
class Filters:
    """What a search is narrowed to; rows that lack a length or depth fall out where one is asked for."""

    area: str | None = None
    site_type: str | None = None
    min_length: float | None = None
    max_length: float | None = None
    min_depth: float | None = None
    has_survey: bool = False
    kinds: tuple[str, ...] = ()
    site: int | None = None

    def sites(self, own: dict[str, DataFrame]) -> DataFrame | None:
        """site_number of the sites that pass, None where every one does."""
        checks: list[Column] = []
        if self.area:
            checks.append(F.col("_of_area") | F.col("area_raw").ilike(f"%{self.area}%") if "area" in own else F.col("area_raw").ilike(f"%{self.area}%"))
        if self.site_type:
            checks.append(F.col("site_type") == self.site_type)
        for value, name, least in ((self.min_length, "length_m", True), (self.max_length, "length_m", False), (self.min_depth, "depth_m", True)):
            if value is not None:
                checks.append(F.col(name) >= value if least else F.col(name) <= value)
        if self.site is not None:
            checks.append(F.col("site_number") == self.site)
        if not checks and not self.has_survey:
            return None
        sites = own["site"]
        if self.area and "area" in own:
            # By the area's name or slug; areas are a vocabulary file.
            named = own["area"].where(F.col("name").ilike(f"%{self.area}%") | F.col("slug").like(f"%{self.area.lower()}%")).select("area_id", F.lit(True).alias("_of_area"))
            sites = sites.join(F.broadcast(named), "area_id", "left").withColumn("_of_area", F.coalesce("_of_area", F.lit(False)))
        kept = sites.where(reduce(lambda a, b: a & b, checks, F.lit(True))).select("site_number")
        return kept.join(own["resource_link"].where(F.col("bucket").startswith("survey")), "site_number", "left_semi") if self.has_survey else kept

    def chunks(self, own: dict[str, DataFrame]) -> DataFrame:
        """All passages with _keep: statistics are of all, results of those that pass."""
        kept, out = self.sites(own), own["chunk"]
        out = out.withColumn("_keep", F.lit(True)) if kept is None else out.join(kept.withColumn("_in", F.lit(True)), "site_number", "left").withColumn("_keep", F.col("_in").isNotNull()).drop("_in")
        return out.withColumn("_keep", F.col("_keep") & F.col("kind").isin(*self.kinds)) if self.kinds else out


Encoder = Callable[[str], list[float]]


def search_passages(own: dict[str, DataFrame], query: str, filters: Filters = Filters(), limit: int | None = 10, encode: Encoder | None = None, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """chunk_id, site_number, kind, text, score, snippet, best first; every passage found where ``limit`` is None.

    With ``encode`` and a table ``vector`` words and vectors are fused; an encoder that fails leaves the words alone, one
    whose package is missing is an error.
    """
    chunks, terms = filters.chunks(own), retrieval.escape_query(query)
    vector = None
    if encode is not None and "vector" in own:
        try:
            vector = encode(query)
        except embedding.EncoderMissing:
            raise
        except Exception:  # whatever an encoder may raise
            vector = None
    best = retrieval.bm25(chunks, "chunk_id", "text", terms, F.col("_keep"), limit if vector is None else FUSION_POOL)
    if vector is not None:
        near = retrieval.knn(own["vector"].join(chunks.where("_keep").select("chunk_id"), "chunk_id"), "chunk_id", "embedding", vector, FUSION_POOL)
        # Each pool holds FUSION_POOL rows when it is ranked.
        best = retrieval.rrf([(retrieval.ranked(best, [F.desc("score"), F.col("chunk_id")]), weights[0]), (retrieval.ranked(near, ["distance", "chunk_id"]), weights[1])], "chunk_id", limit)

    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: retrieval.snippet(text, terms))

    found = own["chunk"].join(best if limit is None else F.broadcast(best), "chunk_id")  # at most ``limit`` rows
    return found.select("chunk_id", "site_number", "kind", "text", "score", mark("text").alias("snippet")).orderBy(F.desc("score"), "chunk_id")


def search_sites(own: dict[str, DataFrame], query: str, filters: Filters = Filters(), limit: int | None = 10, encode: Encoder | None = None, pool: int | None = SITE_POOL) -> DataFrame:
    """site_number, name, area_raw, score, n, snippet: sites by their passages, or by name where no passage matches.

    The best ``pool`` passages are looked at, all of them where it is None; so are all sites given where ``limit`` is.
    """
    # Searched once, whichever way it goes on.
    found = stored(search_passages(own, query, filters, pool, encode))
    if found.isEmpty():
        return names_like(own, query, filters, limit)
    best = retrieval.roll_up(found, "site_number", "score", "snippet")
    best = best if pool is None else F.broadcast(best)  # at most ``pool`` rows
    return _first(own["site"].select("site_number", "name", "area_raw").join(best, "site_number").orderBy(F.desc("score"), "site_number"), limit)


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def names_like(own: dict[str, DataFrame], query: str, filters: Filters = Filters(), limit: int | None = 10) -> DataFrame:
    """Sites whose name or alias holds the query, longest first, with score 0."""
    kept = filters.sites(own)
    sites = own["site"] if kept is None else own["site"].join(kept, "site_number", "left_semi")
    other = own["site_alias"].where(F.col("text").ilike(f"%{query}%")).select("site_number").distinct().withColumn("_alias", F.lit(True))
    hit = F.col("name_sort").contains(query.lower()) | F.col("name").ilike(f"%{query}%") | F.col("_alias").isNotNull()
    out = _first(sites.join(other, "site_number", "left").where(hit).orderBy(F.desc_nulls_last("length_m"), "site_number"), limit)
    return out.select("site_number", "name", "area_raw", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"), F.lit("(name match)").alias("snippet"))


def get_site(silver: DataFrame, number: int) -> DataFrame:
    """One nested row: the record itself."""
    return silver.where(F.col("site_number") == number)


def nearby_sites(own: dict[str, DataFrame], number: int, radius: float = 500.0, limit: int = 20) -> DataFrame:
    near = graph.nearby(own["site"], "site_number", "easting", "northing", number, radius, limit)
    return own["site"].select("site_number", "name").join(F.broadcast(near), "site_number").orderBy("distance", "site_number")  # at most ``limit`` rows


def site_graph(own: dict[str, DataFrame], number: int, depth: int = 1) -> DataFrame:
    """site_number, depth, name of sites that refer to each other; name is null where a site has no page."""
    start = own["site"].sparkSession.range(number, number + 1).select(F.col("id").cast("int").alias("node"))
    nodes = graph.neighbourhood(own["cross_reference"], "from_site", "to_site", start, depth).withColumnRenamed("node", "site_number")
    return nodes.join(own["site"].select("site_number", "name"), "site_number", "left")


def find_by_citation(own: dict[str, DataFrame], author: str, year: int | None = None, limit: int = 20) -> DataFrame:
    found = own["citation"].where(F.col("author_raw").ilike(f"%{author}%"))
    found = found if year is None else found.where(F.col("year") == year)
    return found.orderBy(F.desc("site_count"), "citation_id").limit(limit)


def show(own: dict[str, DataFrame], number: int) -> DataFrame:
    """A site's summary with its aliases, measurements, references in both directions, works and links as lists."""
    mine = lambda name, key, *cols: own[name].where(F.col(key) == number).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    parts = [
        mine("site_alias", "site_number", "ordinal", "text", "kind"), mine("quantity", "site_number", "ordinal", "label", "raw", "value_m"), mine("update_date", "site_number", "ordinal", "edited_on"),
        mine("citation_use", "site_number", "ordinal", "raw"), mine("resource_link", "site_number", "origin", "bucket", "href"), mine("cross_reference", "from_site", "to_site", "is_resolved"),
    ]
    # Each side is one row.
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, own["site"].where(F.col("site_number") == number))


#: Child, its column, parent and its key, for each reference between tables.
REFERENCES = (
    ("citation_use", "citation_key", "citation", "citation_key"), ("citation_author", "author_id", "author", "author_id"), ("citation_author", "citation_id", "citation", "citation_id"), ("person_mention", "name_raw", "person", "name_raw"),
    ("system_member", "name", "cave_system", "name"), ("site_alias", "site_number", "site", "site_number"), ("chunk", "site_number", "site", "site_number"), ("area_variant", "area_id", "area", "area_id"),
)


def broken(own: dict[str, DataFrame]) -> DataFrame:
    """reference, rows: children without a parent, for each reference whose tables are there."""
    usable = [r for r in REFERENCES if r[0] in own and r[2] in own]
    parts = [model.broken_keys(own[c], column, own[p], key).agg(F.count("*").alias("rows")).select(F.lit(f"{c}.{column}").alias("reference"), "rows") for c, column, p, key in usable]
    return reduce(DataFrame.unionByName, parts)


def counts(own: dict[str, DataFrame]) -> DataFrame:
    """label, value: rows of every table, by name."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("value")).select(F.lit(name).alias("label"), "value") for name, df in sorted(own.items())])


#: Label, table and condition of the numbers that describe a build.
STATS = (
    ("sites", "site", "true"), ("  with a name", "site", "name <> '-'"), ("  with an area", "site", "area_id IS NOT NULL"), ("  with coordinates", "site", "latitude IS NOT NULL"), ("  with a length", "site", "length_m IS NOT NULL"),
    ("  with a depth", "site", "depth_m IS NOT NULL"), ("  one-line only", "site", "is_minimal"), ("  stubs", "site", "is_stub"), ("areas", "area", "true"), ("coordinates", "coordinate", "true"), ("measurements", "quantity", "true"),
    ("  prose measurements", "quantity", "kind = 'prose'"), ("update dates", "update_date", "true"), ("description blocks", "block", "true"), ("sections", "section", "true"), ("body tables", "body_table", "true"),
    ("bat observations", "bat_observation", "true"), ("date mentions", "date_mention", "true"), ("people", "person", "true"), ("  mentions", "person_mention", "true"), ("cross-references", "cross_reference", "true"),
    ("  to a missing page", "cross_reference", "NOT is_resolved"), ("cave systems", "cave_system", "true"), ("  memberships", "system_member", "true"), ("citations (distinct works)", "citation", "true"), ("  uses", "citation_use", "true"),
    ("authors", "author", "true"), ("resource links", "resource_link", "true"), ("anomalies", "anomaly", "true"), ("  errors", "anomaly", "severity = 'error'"), ("  warnings", "anomaly", "severity = 'warn'"),
)


def stats(own: dict[str, DataFrame]) -> DataFrame:
    """ordinal, label, value: the numbers that describe a build; each table is read once. Without a vocabulary there are no areas."""
    by_table: dict[str, list[tuple[int, str, str]]] = {}
    for i, (label, table, condition) in enumerate(STATS):
        by_table.setdefault(table, []).append((i, label, condition))
    parts = []
    for table, wanted in by_table.items():
        df = own.get(table)
        usable = [(i, label, c) for i, label, c in wanted if df is not None and ("area_id" not in c or "area_id" in df.columns)]
        if usable:
            one = df.agg(*[F.count_if(F.expr(c)).alias(f"v{i}") for i, _, c in usable])
            parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("label"), F.col(f"v{i}").alias("value")) for i, label, _ in usable])).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts).orderBy("ordinal")


#: Metrics of an audit, and the labels of ``STATS`` that they are.
AUDIT = {"sites": "sites", "citations": "  uses", "cross_references": "cross-references", "update_dates": "update dates", "coordinates": "coordinates", "anomalies": "anomalies", "errors": "  errors"}


def audit(own: dict[str, DataFrame], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes of the pages ``found`` since the build (site_number, change), and seven metrics of the build (metric, value)."""
    changes = relational.full_outer_diff(own["parse_run"].select("site_number", "content_sha256"), found.select("site_number", "content_sha256"), "site_number", "content_sha256")
    names = own["site"].sparkSession.createDataFrame([(k, v) for k, v in AUDIT.items()], "metric string, label string")
    return changes.orderBy("change", "site_number"), stats(own).join(F.broadcast(names), "label").select("metric", "value")


def evaluate(own: dict[str, DataFrame], questions: DataFrame, at: int = 10, encode: Encoder | None = None) -> DataFrame:
    """kind, queries, recall of an evaluation set, which is written by hand: each question is one search of a pool, cut to ``at`` sites."""
    spark, rows = own["site"].sparkSession, questions.collect()
    best = [F.desc("score"), F.col("chunk_id")]
    # One job for all questions: each pool holds 6 * at rows.
    if encode is None:
        # By words alone: the passages are split once for all questions.
        found = retrieval.bm25_each(own["chunk"], "chunk_id", "text", [retrieval.escape_query(q["query"]) for q in rows], k=at * 6)
        every = reduce(DataFrame.unionByName, [f.select(F.lit(i).alias("query"), "chunk_id", "score") for i, f in enumerate(found)])
        pools = retrieval.ranked(own["chunk"].select("chunk_id", "site_number").join(F.broadcast(every), "chunk_id"), best, ["query"])
    else:
        each = [retrieval.ranked(search_passages(own, q["query"], Filters(), at * 6, encode), best).select(F.lit(i).alias("query"), "site_number", "rank") for i, q in enumerate(rows)]
        pools = reduce(DataFrame.unionByName, each)
    first = pools.groupBy("query", "site_number").agg(F.min("rank").alias("first"))
    hits = retrieval.ranked(first, ["first"], ["query"]).where(F.col("rank") <= at).select("query", F.col("site_number").alias("key"), "rank")
    expected = spark.createDataFrame([(i, int(n), q["kind"]) for i, q in enumerate(rows) for n in q["expect"]], "query int, key int, kind string")
    return retrieval.recall(hits, expected, ["kind"], at)


def compare(own: dict[str, DataFrame], questions: DataFrame, encode: Encoder, at: int = 10) -> DataFrame:
    """kind, words, fused, verdict: recall by words alone and with vectors, and which is better."""
    words, fused = (evaluate(own, questions, at, e).select("kind", F.col("recall").alias(name)) for name, e in (("words", None), ("fused", encode)))
    return words.join(fused, "kind").withColumn("verdict", retrieval.verdict(F.col("fused"), F.col("words")))
