"""Commands over a folder of pages and a folder of builds: ``python -m cairn COMMAND ...``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.pages import parse_page, segment
from cairn.functions.text import decode_bytes, normalise_source
from cairn.plans import embedding, library, quality
from cairn.sources import pages

ROWS = 200


def _one(spark: SparkSession, a: argparse.Namespace) -> object:
    """What one page file holds: its text, its segments or its record."""
    raw = Path(a.page).read_bytes()
    text, encoding = decode_bytes(raw)
    if a.command == "decode":
        return {"encoding": encoding, "characters": len(text)}
    if a.command == "segment":
        return segment(normalise_source(text))
    return parse_page(int(Path(a.page).stem), raw)


def _built(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What a build answers."""
    if a.command == "build":
        return library.stats(library.build(spark, a.pages, a.out, a.vocabulary, a.overrides)).select("label", "value")
    own = library.current(spark, a.out)
    encode = embedding.encode_query if getattr(a, "vectors", False) else None
    if encode:
        own["vector"] = spark.read.parquet(f"{a.out}/vector")
    match a.command:
        case "stats":
            return library.stats(own).select("label", "value")
        case "audit":
            return library.audit(own, pages.read_pages(spark, a.pages))[0]
        case "review":
            return quality.review(own["silver"], a.severity, a.code, a.limit)
        case "embed":
            embedding.embed_pending(own["chunk"]).write.mode("overwrite").parquet(f"{a.out}/vector")
            return spark.read.parquet(f"{a.out}/vector").agg(F.count("*").alias("vectors"))
        case "evaluate":
            return library.evaluate(own, pages.read_eval(spark, a.questions), a.at, encode)
        case "search":
            return library.search_sites(own, a.query, library.Filters(area=a.area, site_type=a.site_type), a.limit, encode)
        case "show":
            return library.show(own, a.site)
        case "nearby":
            return library.nearby_sites(own, a.site, a.radius, a.limit)
        case "graph":
            return library.site_graph(own, a.site, a.depth)
        case "export":
            own["silver"].write.mode("errorifexists").json(a.folder)
            return own["silver"].agg(F.count("*").alias("records"))
    raise ValueError(a.command)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairn")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        for flag, how in options:
            p.add_argument(flag, **how)

    out, limit, vectors, site = ("--out", {"default": "builds"}), ("--limit", {"type": int, "default": 10}), ("--vectors", {"action": "store_true"}), ("site", {"type": int})
    for name in ("decode", "segment", "parse"):
        add(name, ("page", {}))
    add("build", ("pages", {}), out, ("--vocabulary", {}), ("--overrides", {}))
    add("stats", out)
    add("audit", ("pages", {}), out)
    add("review", out, ("--severity", {"default": "warn"}), ("--code", {}), ("--limit", {"type": int, "default": 50}))
    add("embed", out)
    add("evaluate", ("questions", {}), out, vectors, ("--at", {"type": int, "default": 10}))
    add("search", ("query", {}), out, limit, vectors, ("--area", {}), ("--site-type", {}))
    add("show", site, out)
    add("nearby", site, out, ("--radius", {"type": float, "default": 500.0}), ("--limit", {"type": int, "default": 20}))
    add("graph", site, out, ("--depth", {"type": int, "default": 1}))
    add("export", ("folder", {}), out)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command in ("decode", "segment", "parse"):
        print(json.dumps(_one(spark, a), default=str, ensure_ascii=False))
        return
    _built(spark or SparkSession.builder.appName("cairn").getOrCreate(), a).show(ROWS, truncate=False)


if __name__ == "__main__":
    main()
