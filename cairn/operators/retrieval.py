"""Retrieval: tokens, BM25, exact nearest neighbours, rank fusion, roll-up, recall."""

from __future__ import annotations

import re
import string
import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.once import once

K1, B, FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
FUSION_POOL = 100
SUPPORT = 0.3
_SPECIAL = re.compile(r'["*():^\-]')


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded: accents of Latin letters removed."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _accents() -> tuple[str, str]:
    """Letters that are a plain Latin one with marks, then marks alone, which go, and the plain letters."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
    kept = {c: p[0] for c, p in parts.items() if len(p) > 1 and p[0] in string.ascii_lowercase}
    return "".join(kept) + "".join(map(chr, range(0x300, 0x370))), "".join(kept.values())


#: Accented Latin letters and combining marks, and the plain letters; the marks have none.
ACCENTS = _accents()
_FOLDED = str.maketrans(ACCENTS[0][: len(ACCENTS[1])], ACCENTS[1], ACCENTS[0][len(ACCENTS[1]) :])


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), *ACCENTS)


def escape_query(query: str) -> list[str]:
    """The terms of a user's query; none means no results."""
    return _SPECIAL.sub(" ", query).split()


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, dl: one row for each distinct term of each document. Written once, it answers any number of queries."""
    split = docs.select(key, tokens(F.col(text)).alias("_t")).withColumn("dl", F.size("_t"))
    return split.select(key, "dl", F.explode("_t").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def _idf(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)


def _weight(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def bm25_postings(found: DataFrame, key: str, terms: list[str], docs: int, mean: float, k: int = 20) -> DataFrame:
    """key, score of the k best documents by the postings of single terms alone; ``docs``, ``mean``: documents, mean length."""
    wanted = sorted({t.lower().translate(_FOLDED) for t in terms})
    hit = found.where(F.col("term").isin(wanted))
    held = hit.groupBy("term").agg(F.count("*").alias("_df"))  # a row for each term of the query
    part = _idf(F.lit(float(docs)), F.col("_df")) * _weight(F.col("tf"), F.col("dl"), F.lit(mean))
    return hit.join(F.broadcast(held), "term").groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), key).limit(k)


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], keep: Column | None = None, k: int | None = 20, phrases: bool = True) -> DataFrame:
    """key, score of the k best documents (None: of all that match); any term matches. Statistics are of all documents, ``keep`` narrows the results.

    Each text is split once: what is left of it, its length and the counts of the query's terms, is written, and both the
    statistics and the scores read that. Nothing but one row a match is shuffled.
    """
    return bm25_each(docs, key, text, [terms], keep, k, phrases)[0]


def bm25_each(docs: DataFrame, key: str, text: str, queries: list[list[str]], keep: Column | None = None, k: int | None = 20, phrases: bool = True) -> list[DataFrame]:
    """``bm25`` of each of the queries, whose terms are counted in one pass over the texts."""
    asked = [[f for t in terms if (f := tuple(re.findall(r"[^\W_]+", t.lower().translate(_FOLDED))))] for terms in queries]
    folded = list(dict.fromkeys(f for own in asked for f in own))
    none = docs.select(key, F.lit(0.0).alias("score")).limit(0)
    if not folded:
        return [none] * len(queries)

    def count(own: Column, parts: tuple[str, ...]) -> Column:
        if len(parts) == 1 or not phrases:
            return F.size(F.filter(own, lambda t: t == parts[0]))
        # A term with inner punctuation is a phrase.
        at = F.sequence(F.lit(0), F.greatest(F.size(own) - len(parts), F.lit(0)))
        same = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(own, i + j) == p, F.lit(False)) for j, p in enumerate(parts)])
        return F.size(F.filter(at, same))

    # The tokens are the variable of a function over one of them, so that no expression splits a text again.
    one = F.transform(F.array(tokens(F.col(text))), lambda own: F.struct(F.size(own).alias("dl"), F.array(*[count(own, p) for p in folded]).alias("tf")))
    counted = docs.select(key, (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("_keep"), F.explode(one).alias("x"))
    counted = once(counted.select(key, "_keep", "x.dl", "x.tf"))
    stats = counted.agg(F.count("*").cast("double").alias("_n"), F.avg("dl").alias("_mean"), F.array(*[F.count_if(F.col("tf")[i] > 0) for i in range(len(folded))]).alias("_df"))

    def best(places: list[int]) -> DataFrame:
        hit = reduce(lambda a, b: a | b, [F.col("tf")[i] > 0 for i in places])
        scored = counted.where(F.col("_keep") & hit).crossJoin(F.broadcast(stats))  # one row of statistics
        total = reduce(lambda a, b: a + b, [_idf(F.col("_n"), F.col("_df")[i]) * _weight(F.col("tf")[i], F.col("dl"), F.col("_mean")) for i in places])
        out = scored.select(key, total.alias("score"))
        return out if k is None else out.orderBy(F.desc("score"), key).limit(k)

    return [best([folded.index(f) for f in own]) if own else none for own in asked]


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)


def knn(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """key, distance of the k nearest by L2; the filter comes first, so no oversampling is needed."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.where(keep) if keep is not None else vectors
    rows = rows.where(F.size(vector) == len(query))
    return rows.select(key, F.sqrt(squared_l2(F.col(vector), q)).alias("distance")).orderBy("distance", key).limit(k)


#: Rows of a tile and queries of a block that are compared at once, and queries whose distances a task holds.
TILE, AT_ONCE = 8192, 256


def _near(vectors: pa.Table, queries: pa.Table, key: str, k: int) -> pa.Table:
    """query, key, distance: the k nearest rows of a tile to each query of a block, by distance and key.

    Products of matrices tell which rows can be among them; those are measured exactly, a component after another.
    """
    keys, asked = vectors.column(key).to_numpy(), queries.column("query").to_numpy()
    sizes = [pc.list_value_length(c).to_numpy() for c in (vectors.column("v"), queries.column("q"))]
    matrix = lambda c, rows, n: pc.list_flatten(c.take(pa.array(rows))).to_numpy().astype(np.float64).reshape(-1, n)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n in np.intersect1d(*sizes):
        rows, own = (np.flatnonzero(s == n) for s in sizes)
        v, q = matrix(vectors.column("v"), rows, n), matrix(queries.column("q"), own, n)
        with np.errstate(all="ignore"):
            vv, qq = (v * v).sum(1), (q * q).sum(1)
            # What rounding can make of a sum of n products, and then some.
            slack = 8 * (n + 4) * np.finfo(np.float64).eps
            for at in range(0, len(q), AT_ONCE):
                part, names = q[at : at + AT_ONCE], asked[own[at : at + AT_ONCE]]
                about = qq[at : at + AT_ONCE, None] + vv - 2 * (part @ v.T)
                about[~np.isfinite(about)] = np.inf
                about[names[:, None] == keys[rows]] = np.nan  # a query is not its own neighbour
                margin = slack * (qq[at : at + AT_ONCE, None] + vv)
                margin[~np.isfinite(margin)] = 0
                most = np.partition(about + margin, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]  # NaN comes last
                i, j = np.nonzero(~np.isnan(about) & ~(about - margin > most[:, None]))
                d = np.zeros(len(i))
                for c in range(n):
                    d += (v[j, c] - part[i, c]) ** 2
                d = np.sqrt(d)
                order = np.lexsort((keys[rows[j]], d, i))
                i, j, d = i[order], j[order], d[order]
                first = np.searchsorted(i, i)
                best = np.arange(len(i)) - first < k
                out.append((names[i[best]], keys[rows[j[best]]], d[best]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, asked.dtype), np.empty(0, keys.dtype), np.empty(0)]
    return pa.table(columns, ["query", key, "distance"])


def knn_batch(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """query, key, distance, rank: the k nearest of each query (columns query, q; numbers as keys) by L2, of other keys.

    Rows are dealt to tiles and queries to blocks, whose numbers grow with them, so neither side is broadcast and a task
    holds one tile and one block; a tile keeps k rows a query. Vectors with a null component take no part.
    """
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    vectors, queries = vectors.where(whole(vector)), queries.where(whole("q"))
    least = vectors.sparkSession.sparkContext.defaultParallelism
    tiles, blocks = max(least, -(-vectors.count() // TILE)), max(1, -(-queries.count() // TILE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = vectors.select(key, F.col(vector).alias("v"), part(key, tiles).alias("_tile"), every(blocks).alias("_block"))
    asked = queries.select("query", "q", part("query", blocks).alias("_block"), every(tiles).alias("_tile"))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, distance double"
    near = lambda a, b: _near(a, b, key, k)
    best = dealt.groupBy("_tile", "_block").cogroup(asked.groupBy("_tile", "_block")).applyInArrow(near, schema)
    return ranked(best, ["distance", key], ["query"]).where(F.col("rank") <= k).select("query", key, "distance", "rank")


def rrf(rankings: list[tuple[DataFrame, float]], key: str, k: int | None = None) -> DataFrame:
    """key, score = sum of weight / (60 + rank). Each ranking has key and rank (from 1)."""
    parts = [df.select(key, (F.lit(float(w)) / (RRF_K + F.col("rank"))).alias("s")) for df, w in rankings]
    fused = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("s").alias("score"))
    return fused.orderBy(F.desc("score"), key).limit(k) if k else fused


def ranked(df: DataFrame, order: list[Column | str], part: list[str] | None = None) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*(part or [F.lit(0)])).orderBy(*order)))


def roll_up(passages: DataFrame, group: str, score: str, snippet: str | None = None) -> DataFrame:
    """group, score = best + 0.3 x the rest, n, and the best passage's snippet."""
    extra = [F.max_by(snippet, score).alias(snippet)] if snippet else []
    total = F.max(score) + SUPPORT * (F.sum(score) - F.max(score))
    return passages.groupBy(group).agg(total.alias("score"), F.count("*").alias("n"), *extra)


def distinct_in_order(passages: DataFrame, group: str, k: int) -> DataFrame:
    """group, rank: groups by their best rank, the first k."""
    best = passages.groupBy(group).agg(F.min("rank").alias("rank"))
    return best.orderBy("rank", group).limit(k)


def recall(hits: DataFrame, expected: DataFrame, by: list[str], at: int) -> DataFrame:
    """Share of queries with an expected key among the first ``at``. hits: query, key, rank; expected: query, key, and ``by``."""
    queries = expected.select("query", *by).distinct()
    found = hits.where(F.col("rank") <= at).join(expected.select("query", "key"), ["query", "key"], "left_semi").select("query").distinct().withColumn("_hit", F.lit(1.0))
    joined = queries.join(found, "query", "left")
    return joined.groupBy(*by).agg(F.count("*").alias("queries"), F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))


def verdict(hybrid: Column, *singles: Column) -> Column:
    best = F.greatest(*singles) if len(singles) > 1 else singles[0]
    return F.when(hybrid > best, "better").when(hybrid == best, "level").otherwise("worse")


def snippet(text: str | None, terms: list[str], width: int = 18) -> str:
    """The window of ``width`` tokens with most distinct terms, terms in guillemets, an ellipsis where text is cut."""
    if not text:
        return ""
    wanted = {t.lower().translate(_FOLDED) for t in terms}
    spans = [(m.start(), m.end(), m[0].lower().translate(_FOLDED)) for m in re.finditer(r"[^\W_]+", text)]
    if not spans:
        return ""
    best = max(range(max(1, len(spans) - width + 1)), key=lambda i: (len({t for _, _, t in spans[i : i + width]} & wanted), -i))
    own = spans[best : best + width]
    out, at = [], own[0][0]
    for a, b, t in own:
        out.append(text[at:a] + (f"«{text[a:b]}»" if t in wanted else text[a:b]))
        at = b
    return ("…" if best else "") + "".join(out) + ("…" if best + width < len(spans) else "")
