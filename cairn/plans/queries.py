"""Named queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import graph, relational, retrieval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TERMS = ["the", "and", "la", "stupid"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT c.c_custkey, c.c_name, n.n_name, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def summary_view(spark, sf):
    c = t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    return relational.left_count(c.select("c_custkey", "c_name", "n_name"), t(spark, sf, "orders").select("o_custkey"), "c_custkey", "o_custkey", "orders")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS items, round(sum(l_extendedprice), 2) AS total, max(l_quantity) AS most
FROM lineitem GROUP BY ALL""")
def by_group_rollup(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("items"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_quantity").alias("most"))


@query("""SELECT p_partkey, p_name, count(*) AS refs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL ORDER BY refs DESC, p_partkey LIMIT 10""")
def hubs_topk(spark, sf):
    # Ten rows are chosen before any name is read; only references to parts that exist count.
    part = t(spark, sf, "part")
    refs = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("refs"))
    top = refs.join(part.select("p_partkey"), "p_partkey", "left_semi").orderBy(F.desc("refs"), "p_partkey").limit(10)
    return part.select("p_partkey", "p_name").join(F.broadcast(top), "p_partkey").orderBy(F.desc("refs"), "p_partkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def longest_topk(spark, sf):
    return relational.filtered_top_k(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice").isNotNull(), [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query("""SELECT sha256(text) AS digest, doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""")
def first_wins_dim(spark, sf):
    d = t(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return relational.first_wins(d, ["digest"], ["doc_id"])


@query("""SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority LIKE '1%')""")
def exists_filter(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", "c_name").join(t(spark, sf, "orders").where(F.col("o_orderpriority").like("1%")), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def not_exists(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id", "left_anti")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name ILIKE '%1%')""")
def in_subquery(spark, sf):
    keep = t(spark, sf, "nation").where(F.col("n_name").ilike("%1%")).select("n_nationkey")
    return t(spark, sf, "supplier").join(F.broadcast(keep), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_size >= 10 AND p_retailprice <= 1500""")
def area_like_filter(spark, sf):
    return t(spark, sf, "part").where(F.col("p_name").ilike("%A%") & (F.col("p_size") >= 10) & (F.col("p_retailprice") <= 1500)).select("p_partkey", "p_name")


@query("""WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1),
n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'vanished' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""")
def full_outer_diff(spark, sf):
    d = t(spark, sf, "documents")
    old = d.where("doc_id % 10 <> 1").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.where("doc_id % 10 <> 2").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("h"))
    return relational.full_outer_diff(old, new, "doc_id", "h")


@query("""WITH s AS (SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y') AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN CAST(raw[7:8] AS INTEGER) < 50 THEN 2000 ELSE 1900 END + CAST(raw[7:8] AS INTEGER) AS year,
CAST(make_date(CASE WHEN CAST(raw[7:8] AS INTEGER) < 50 THEN 2000 ELSE 1900 END + CAST(raw[7:8] AS INTEGER), CAST(raw[4:5] AS INTEGER), CAST(raw[1:2] AS INTEGER)) AS VARCHAR) AS day FROM s""")
def dmy_parse(spark, sf):
    raw = F.date_format("o_orderdate", "dd/MM/yy")
    two = F.regexp_extract("raw", r"(\d{2})$", 1).cast("int")
    year = (two + F.when(two < 50, 2000).otherwise(1900)).cast("int")
    s = t(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("year", year)
    day = F.make_date("year", F.substring("raw", 4, 2).cast("int"), F.substring("raw", 1, 2).cast("int"))
    return s.withColumn("day", day.cast("string"))


_FOLD = f"translate(lower(text), '{retrieval.ACCENTS[0]}', '{retrieval.ACCENTS[1]}')"


@query(f"SELECT doc_id, sha256({_FOLD}) AS folded FROM documents")
def fold_key(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(retrieval.fold(F.col("text")), 256).alias("folded"))


@query("""WITH RECURSIVE b AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''), lambda x: length(x)) AS n FROM documents),
r AS (SELECT doc_id, n, 1 AS i, 0 AS g, n[1] AS used FROM b WHERE len(n) > 0 UNION ALL
SELECT doc_id, n, i + 1, CASE WHEN used = 0 OR used + n[i + 1] <= 900 THEN g ELSE g + 1 END, CASE WHEN used = 0 OR used + n[i + 1] <= 900 THEN used + n[i + 1] ELSE n[i + 1] END FROM r WHERE i < len(n))
SELECT doc_id, g AS chunk, CAST(sum(n[i]) AS BIGINT) AS chars, count(*) AS blocks FROM r GROUP BY ALL""")
def chunk_pack(spark, sf):
    blocks = F.filter(F.split("text", "\n"), lambda b: b != "")
    d = t(spark, sf, "documents").select("doc_id", blocks.alias("b")).withColumn("g", relational.greedy_groups(F.transform("b", F.length), 900))
    each = d.select("doc_id", F.explode(F.arrays_zip("b", "g")).alias("z")).select("doc_id", F.col("z.g").alias("chunk"), F.length("z.b").alias("n"))
    return each.groupBy("doc_id", "chunk").agg(F.sum("n").alias("chars"), F.count("*").alias("blocks"))


_BM25 = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({fold}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT unnest({terms}) AS term), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
m AS (SELECT doc_id, term, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q),
f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM m GROUP BY term),
i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, a FROM f, s),
r AS (SELECT doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM m JOIN i USING (term) WHERE tf > 0 GROUP BY doc_id)"""


@query(_BM25.format(terms=TERMS, fold=_FOLD) + " SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    top = retrieval.bm25(t(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", TERMS)
    return top.select("doc_id", F.round("score", 6).alias("score"))


def _probe(spark, sf, n: int = 7) -> list[float]:
    return [float(x) for x in t(spark, sf, "embeddings").where(F.col("vec_id") == n).select("embedding").first()[0]]


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS distance FROM embeddings, q WHERE label < 5
ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), vec_id LIMIT 10""")
def knn_l2_topk(spark, sf):
    near = retrieval.knn(t(spark, sf, "embeddings"), "vec_id", "embedding", _probe(spark, sf), 10, F.col("label") < 5)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 100),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 100)
SELECT doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT *, 1.0 AS w FROM a UNION ALL SELECT *, 0.5 FROM b) GROUP BY doc_id ORDER BY sum(w / (60 + rank)) DESC, doc_id LIMIT 20""")
def rrf_fusion(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "n_chars")
    # A pool of 100 is cut before it is ranked.
    pool = lambda *order: retrieval.ranked(d.orderBy(*order).limit(retrieval.FUSION_POOL), list(order))
    fused = retrieval.rrf([(pool(F.desc("n_chars"), "doc_id"), 1.0), (pool("doc_id"), 0.5)], "doc_id", 20)
    return fused.select("doc_id", F.round("score", 9).alias("score"))


@query("""SELECT source, round(max(n_chars) + 0.3 * (sum(n_chars) - max(n_chars)), 4) AS score, count(*) AS n FROM documents GROUP BY source""")
def site_rollup(spark, sf):
    d = t(spark, sf, "documents").select("source", F.col("n_chars").cast("double").alias("s"))
    return retrieval.roll_up(d, "source", "s").withColumn("score", F.round("score", 4))


@query("""SELECT source, min(rank) AS rank FROM (SELECT source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) GROUP BY source ORDER BY rank, source LIMIT 5""")
def distinct_sites(spark, sf):
    # The first place of a source is that of its longest document; the pool of all is not ranked in one task.
    d = t(spark, sf, "documents").select("source", "doc_id", "n_chars")
    best = d.groupBy("source").agg(F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("b"))
    ahead = best.orderBy("b").limit(5).select("source", "b")
    low = F.broadcast(ahead)  # five rows
    before = d.join(low.withColumnRenamed("source", "s"), F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id")) <= F.col("b")).groupBy("s").agg(F.count("*").alias("rank"))
    return before.select(F.col("s").alias("source"), "rank")


@query("""WITH q AS (SELECT vec_id AS query, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0),
r AS (SELECT query, q.label AS kind, v.label = q.label AS same, row_number() OVER (PARTITION BY query ORDER BY list_distance(CAST(v.embedding AS DOUBLE[]), e), v.vec_id) AS rank FROM q, embeddings v WHERE v.vec_id <> query)
SELECT kind, count(DISTINCT query) AS queries, round(count(DISTINCT query) FILTER (same AND rank <= 5) / count(DISTINCT query), 6) AS recall FROM r GROUP BY kind""")
def recall_at_k(spark, sf):
    # The stated query set: every fiftieth row, against all rows.
    e = t(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("kind"), F.col("embedding").alias("q"))
    near = retrieval.knn_batch(e, q, "vec_id", "embedding", 5)
    hits = near.join(e.select("vec_id", "label"), "vec_id").select("query", F.col("label").alias("key"), "rank")
    out = retrieval.recall(hits, q.select("query", F.col("kind").alias("key"), "kind"), ["kind"], 5)
    return out.select("kind", "queries", F.round("recall", 6).alias("recall"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey * 100.0 - b.s_nationkey * 100.0) ** 2), 4) AS distance
FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND (a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey * 100.0 - b.s_nationkey * 100.0) ** 2 <= 250000.0""")
def radius_theta(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    return graph.radius_join(s, "s_suppkey", "x", "y", 500.0).withColumn("distance", F.round("distance", 4))


@query("""WITH o AS (SELECT s_acctbal AS x, s_nationkey * 100.0 AS y FROM supplier WHERE s_suppkey = 3)
SELECT s_suppkey, round(sqrt((s_acctbal - x) ** 2 + (s_nationkey * 100.0 - y) ** 2), 4) AS distance FROM supplier, o
WHERE s_suppkey <> 3 AND (s_acctbal - x) ** 2 + (s_nationkey * 100.0 - y) ** 2 <= 4000000.0 ORDER BY (s_acctbal - x) ** 2 + (s_nationkey * 100.0 - y) ** 2, s_suppkey LIMIT 20""")
def nearby_topk(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    return graph.nearby(s, "s_suppkey", "x", "y", 3, 2000.0).withColumn("distance", F.round("distance", 4))


@query("""WITH e AS (SELECT DISTINCT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem), b2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
d1 AS (SELECT DISTINCT b AS node FROM b2 WHERE a = 14 AND b <> 14), d2 AS (SELECT DISTINCT b AS node FROM b2 JOIN d1 ON a = node WHERE b <> 14 AND b NOT IN (SELECT node FROM d1))
SELECT 14 AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2""")
def bfs_depth2(spark, sf):
    # Parts (even numbers) and suppliers (odd ones) that a line joins.
    e = t(spark, sf, "lineitem").select((2 * F.col("l_partkey")).alias("a"), (2 * F.col("l_suppkey") + 1).alias("b"))
    return graph.neighbourhood(e, "a", "b", spark.range(14, 15).select(F.col("id").alias("node")), 2)


@query("""SELECT min(k) AS first, max(k) AS last FROM (SELECT k, k - row_number() OVER (ORDER BY k) AS g FROM (SELECT DISTINCT CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders)) GROUP BY g""")
def gaps_islands(spark, sf):
    return relational.islands(t(spark, sf, "orders").select(F.floor("o_totalprice").alias("price")), "price")


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, min(n_chars) AS min, list_sort(list(n_chars))[count(*) // 2 + 1] AS p50, list_sort(list(n_chars))[count(*) * 9 // 10 + 1] AS p90, max(n_chars) AS max FROM documents GROUP BY lang""")
def coverage_profile(spark, sf):
    return relational.index_percentiles(t(spark, sf, "documents").select("lang", "n_chars"), "n_chars", ["lang"])


@query("""WITH a AS (SELECT doc_id, 'toxic' AS code FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 5000)
SELECT d.doc_id, d.source, count(*) AS hits, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM a JOIN documents d USING (doc_id) GROUP BY ALL""")
def review_queue(spark, sf):
    l, d = t(spark, sf, "labels"), t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    code = lambda df, keep, name: df.where(keep).select("doc_id", F.lit(name).alias("code"))
    flags = code(l, "toxic = 1", "toxic").unionByName(code(l, "quality = 0", "poor")).unionByName(code(d, "n_chars > 5000", "long"))
    agg = flags.groupBy("doc_id").agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return agg.join(d, "doc_id").select("doc_id", "source", "hits", "codes")


@query("""SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL""")
def usage_counts(spark, sf):
    return t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@query("""WITH s AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 3 AS b, user_id FROM events),
c AS (SELECT * FROM s WHERE event_id % 5 = 0) SELECT event_id, a, b FROM s WHERE event_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = s.user_id AND s.a < c.b AND c.a < s.b)""")
def span_overlap_anti(spark, sf):
    s = t(spark, sf, "events").select("event_id", F.floor("value").alias("a"), (F.floor("value") + 3).alias("b"), "user_id")
    claimed, others = s.where("event_id % 5 = 0"), s.where("event_id % 5 <> 0")
    return relational.overlap_anti(others, claimed, "user_id", "a", "b", 16).select("event_id", "a", "b")


@query("""SELECT 'documents' AS label, count(*) AS value FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'labels', count(*) FROM labels
UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'orders', count(*) FROM orders""")
def corpus_stats(spark, sf):
    d, l = t(spark, sf, "documents"), t(spark, sf, "labels")
    parts = [
        d.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources")), l.agg(F.count("*").alias("labels"), F.count_if(F.col("toxic") == 1).alias("toxic")),
        t(spark, sf, "pages").agg(F.count("*").alias("pages")), t(spark, sf, "orders").agg(F.count("*").alias("orders")),
    ]
    out = None
    for p in parts:
        rows = p.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("value")) for c in p.columns])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT c_custkey, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_order, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, count(*) AS n
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def first_qualifying(spark, sf):
    o = t(spark, sf, "orders")
    return o.join(t(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.count("*").alias("n"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role, text) AS joined, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id""")
def aliases_joined(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("joined"), F.max_by("role", "turn").alias("last_role"))


@query("""SELECT event_id, user_id, CAST(count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS section,
lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events""")
def section_index(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = relational.carry(e, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), F.col("event_type") == "click", following="value")
    return out.select("event_id", "user_id", (F.col("section") - 1).alias("section"), "next_value")


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS context FROM events""")
def back_fill(spark, sf):
    e = t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = relational.carry(e, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), kept=F.when(F.col("event_type") == "purchase", F.col("value")))
    return out.select("event_id", "user_id", "context")


@query("""SELECT doc_id, sha256(text) AS digest FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)""")
def pending_by_hash(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.join(d.where("doc_id % 3 = 0").select("digest"), "digest", "left_anti").select("doc_id", "digest")


@query("""SELECT n_name AS name FROM nation UNION SELECT r_name FROM region""")
def union_distinct(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_name").alias("name")).union(t(spark, sf, "region").select("r_name")).distinct()
