"""Page folders and TOML vocabularies as DataFrames."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from cairn.functions import fixed
from cairn.operators.once import bounded

_LINK = "array<struct<href:string,text:string,bucket:string,target_site:int,is_range:boolean,unquoted_in_source:boolean>>"
_FIND = "array<struct<excerpt:string,char_offset:int>>"
#: The nested record of a page; error: why a page gave none.
RECORD = f"""site_number int, encoding string,
title struct<raw:string,site_number:int,stated:int,name:string,name_sort:string,site_type:string,separator:string,balanced:boolean,aliases:array<struct<text:string,kind:string,site_number:int>>>,
header struct<raw:string,area_raw:string,coordinates:array<struct<raw:string,system:string,zone:string,easting:int,northing:int,vn_ref:string,datum:string,accuracy_code:string,altitude_m:double,label:string,entrance_site_number:int,latitude:double,longitude:double>>,
 quantities:array<struct<label:string,label_raw:string,raw:string,kind:string,value_m:double,min_m:double,max_m:double,modifier:string,parts:array<double>,unit_stated:boolean,prose:struct<relation:string,target_sites:array<int>,system_name:string,extra_value_m:double>>>,
 field_order:array<string>,duplicate_labels:array<string>>,
updated array<struct<raw:string,precision:string,date:date,end_date:date,attribution:string,inferred_month:boolean,inferred_year:boolean,group_index:int>>,
body struct<raw_html:string,text:string,char_count:int,is_minimal:boolean,blocks:array<struct<index:int,kind:string,text:string,section_index:int>>,
 sections:array<struct<heading:string,heading_kind:string,canonical:string,block_first:int,block_last:int>>,tables:array<struct<index:int,headers:array<string>,rows:array<array<string>>,looks_like:string>>,editorial_notes:array<string>,
 bat_observations:array<struct<date:date,date_raw:string,fields:map<string,string>>>,cross_refs:array<struct<target_site:int,kind:string,from_zone:string,href:string,fragment:string,link_text:string,context:string>>,
 dates:array<struct<raw:string,kind:string,year:int,month:int,day:int,season:string,batch_code:string>>,people:array<struct<name_raw:string,name_canonical:string,evidence:string,confidence:double>>>,
footer struct<raw:string,reference_label:string,citations:array<struct<raw:string,ordinal:int,author_raw:string,authors:array<string>,year:int,disambiguator:string,qualifier:string,qualifier_is_known:boolean,kind:string,citation_key:string,links:{_LINK},attachments:{_LINK}>>,
 fields:array<struct<label_raw:string,label:string,is_known_label:boolean,order:int,text:string,is_empty:boolean,links:{_LINK}>>>,
segments_found map<string,boolean>, is_stub boolean, override_status string,
notes struct<blank:boolean,mojibake:{_FIND},replaced:{_FIND},body_tag:boolean,body_close:boolean,speech:boolean,script:boolean,title_swapped:boolean,header_tail:boolean,header_closers:int,updated_open:string,updated_nested:string,rejected_dates:array<string>,footer_bare:boolean,header_words:array<string>,footer_words:boolean,own_links:int>,
passages array<struct<kind:string,text:string,section_heading:string,block_first:int,block_last:int>>, error string"""


#: Pages whose records are made at once.
AT_ONCE = 64


def page_name(number: int) -> str:
    return f"{number:04d}.htm"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """site_number, path, content, byte_size, content_sha256 of each NNNN.htm; an empty folder is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9].htm").load(folder)
    if found.select("path").limit(1).isEmpty():
        raise FileNotFoundError(f"no pages NNNN.htm in {folder}")
    return found.select(F.regexp_extract("path", r"(\d{4})\.htm$", 1).cast("int").alias("site_number"), "path", "content", F.col("length").alias("byte_size"), F.sha2("content", 256).alias("content_sha256"))


def parse_pages(pages: DataFrame, overrides: dict[int, dict] | None = None, region: tuple[tuple[int, int], tuple[int, int]] = fixed.REGION, parts: tuple[str, ...] | None = None) -> DataFrame:
    """The nested record of every page, with path, size and digest. Write it once; every table below reads it.

    ``overrides`` are written by hand, one file a site, so they travel with the task. ``region``: where its coordinates lie.
    ``parts``: what is read of the record, columns or fields of them (``body.tables``); every page is segmented whole, but
    nothing else is made of its segments, and the other columns and fields are null.
    """
    fixes = overrides or {}
    bounded(pages.sparkSession)
    kept = "path string, byte_size long, content_sha256 string"
    record = pages.sparkSession.createDataFrame([], RECORD).schema
    known = {*record.names, *(f"{f.name}.{x.name}" for f in record if isinstance(f.dataType, StructType) for x in f.dataType)}
    if unknown := set(parts or ()) - known:
        raise ValueError(f"no columns of a record: {', '.join(sorted(unknown))}")
    wanted = StructType([x for f in record if (x := f if parts is None else _narrow(f, ("site_number", "error", *parts)))])
    schema = to_arrow_schema(wanted)
    asked = None if parts is None else frozenset(parts)

    def parse(number: int, raw: bytes) -> dict:
        from cairn.functions.pages import parse_page

        try:
            record = parse_page(number, raw, fixes.get(number), region, asked)
        except Exception as e:  # a page that cannot be read is a row that says so, not a failed build
            return {"site_number": number, "error": f"{type(e).__name__}: {e}"}
        for own in (record.get("body") or {}).get("bat_observations", []):
            own |= {"fields": list(own["fields"].items())}
        return record | {"segments_found": list(record["segments_found"].items())} if "segments_found" in record else record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # Records are many times their page, so few of them are held at once.
            for part in (b.slice(i, AT_ONCE) for i in range(0, b.num_rows, AT_ONCE)):
                own = pa.RecordBatch.from_pylist([parse(n.as_py(), raw.as_py()) for n, raw in zip(part.column(0), part.column(1), strict=True)], schema)
                yield pa.RecordBatch.from_arrays([*own.columns, *part.columns[2:]], [*own.schema.names, *part.schema.names[2:]])

    given = StructType([*wanted, *pages.sparkSession.createDataFrame([], kept).schema])
    out = pages.select("site_number", "content", "path", "byte_size", "content_sha256").mapInArrow(run, given)
    every = [_widen(f, wanted[f.name]) if f.name in wanted.names else F.lit(None).cast(f.dataType).alias(f.name) for f in record]
    return out.select(*every, *given.names[len(wanted) :])


def _narrow(column: StructField, parts: tuple[str, ...]) -> StructField | None:
    """The column with the fields that ``parts`` name, all of them where it is named itself."""
    if column.name in parts:
        return column
    own = [x for x in column.dataType if f"{column.name}.{x.name}" in parts] if isinstance(column.dataType, StructType) else []
    return StructField(column.name, StructType(own)) if own else None


def _widen(column: StructField, given: StructField) -> Column:
    """A column of the record from one with some of its fields; the others are null."""
    if column.dataType == given.dataType:
        return F.col(column.name)
    fields = [F.col(f"{column.name}.{x.name}") if x.name in given.dataType.names else F.lit(None).cast(x.dataType).alias(x.name) for x in column.dataType]
    return F.when(F.col(column.name).isNotNull(), F.struct(*fields)).alias(column.name)


def presence(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """site_number, present for every number of the range; empty files count as absent."""
    have = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9].htm").load(folder).where("length > 0").select(F.regexp_extract("path", r"(\d{4})\.htm$", 1).cast("int").alias("n"), F.lit(True).alias("present"))
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("site_number")).join(have, F.col("site_number") == F.col("n"), "left").select("site_number", F.coalesce("present", F.lit(False)).alias("present"))


def unknown_areas(path: str) -> list[str]:
    """What pages write where the area is not known."""
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    return list(data.get("unknown", {}).get("markers", []))


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """folded, name, slug: every spelling of the area vocabulary."""
    from cairn.functions.text import fold

    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    rows = {fold(v): (name, own["slug"]) for name, own in data.get("canonical", {}).items() for v in [name, *own.get("variants", [])]}
    return spark.createDataFrame([(k, *v) for k, v in sorted(rows.items())], "folded string, name string, slug string")


def read_overrides(folder: str) -> dict[int, dict]:
    """Corrections by site number; a folder that is missing holds none."""
    found = [(p, tomllib.loads(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.toml"))]
    return {int(data.get("site", p.stem)): data for p, data in found}


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(q["query"], q["expect"], q.get("kind", "general")) for q in data.get("query", data.get("queries", []))], "query string, expect array<int>, kind string")
