import re
from collections import Counter

from cairn.llm import packing, simhash


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as p

    token = "0f" * 20
    word = lambda i: " ".join(f"{a}{b}{i * 37 % 101}" for a in ("red", "blue", "green", "dark") for b in ("stone", "river", "hill"))
    prose = [(i, f"Here is a story about {word(i)} and the people near the mill of {i}", "en", f"s{i % 2}") for i in range(20)]
    data = [*prose, (50, prose[3][1], "en", "s1"), (51, "123 456", "en", "s0"), (52, None, None, None), (53, f'The token = "{token[:20]}9c41{token[:16]}" stands in a text of its own', "en", "s0")]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(p.COLUMNS)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [tuple(r) for r in docs.collect()]
    assert {r[0] for r in kept["language"]} == {*range(20), 50, 53}
    groups = simhash.near_duplicates(spark.read.parquet(str(tmp_path / "language"))).collect()
    assert sorted(r[0] for r in kept["near_duplicates"]) == sorted({r["component_id"] for r in groups}) and 50 not in {r[0] for r in kept["near_duplicates"]}
    assert all(re.search("[0-9a-f]{40}", r[1]) is None and r[4] == len(r[1]) for r in kept["secrets"]) and len(kept["secrets"]) == len(kept["near_duplicates"])
    packed = packing.pack(docs, p.TOKENIZER).count()
    assert packed == len(kept["mixture"]) == p.run(spark, str(tmp_path)).count()


def test_near_duplicates_without_or_with_repeated_ids(spark):
    import corpus_pipeline as p

    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "the quick brown fox jumps over it")
    rows = [(None, a), (None, a), (None, b), (7, c), (None, c), (8, "red blue green white black"), (8, "sun moon star sky cloud rain")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[3], rows[5], rows[6]], key=str)
    assert p.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
    mixed = p.mix_sources(spark, docs, "").select("doc_id", "text").collect()
    assert {tuple(r) for r in mixed} <= set(rows) and mixed


CLASHING = ("_key", "_sure", "_gaps", "_hash", "_id", "_none", "_one", "_copies", "node", "key", "size", "score", "rate", "part", "c0", "clean", "rule", "source_size", "salt", "piece")


def test_every_stage_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names; what each stage does to them."""
    from pyspark.sql import functions as F

    import corpus_pipeline as p

    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (None, None, "en", "a"), (None, text + " now", None, "b"), (3, "", "en", None), (4, "word " * 40_000, "en", "b"), (5, "12 34 !!", "de", "b"), (6, "ein ganz anderer text über flüsse und hügel im norden", "de", None)]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in CLASHING})
    out = {name: stage(spark, docs, "") for name, stage in p.STAGES}
    got = {name: df.collect() for name, df in out.items()}
    for name, _ in p.STAGES[:-1]:
        assert tuple(out[name].columns) == p.COLUMNS and {(r["doc_id"], r["text"]) for r in got[name]} <= {r[:2] for r in rows}
    assert Counter(r["doc_id"] for r in got["language"]) == Counter({1: 2, None: 1, 4: 1, 6: 1})
    kept = {(r["doc_id"], r["text"]) for r in got["near_duplicates"]}
    assert len(got["near_duplicates"]) == len(kept) == 5 and {1, 4, 5, 6} <= {i for i, _ in kept} and sum(not t or not re.search(r"\w", t) for _, t in kept) == 1
    assert sorted(map(tuple, got["secrets"]), key=str) == sorted([(*r, len(r[1]) if r[1] is not None else None) for r in rows], key=str)
    copies = Counter((r["doc_id"], r["text"]) for r in got["mixture"])
    assert all(n <= 2 * sum(x[:2] == k for x in rows) for k, n in copies.items())
    pieces = Counter(r["doc_id"] for r in got["packing"])
    assert pieces[1] == 2 and pieces[2] == pieces[3] == 1 and pieces[None] == 2 and pieces[4] == -(-40_001 // 2048)
    for name, stage in p.STAGES:
        none = stage(spark, docs.limit(0), "")
        assert none.columns == out[name].columns and none.count() == 0


def test_near_copies_go(spark):
    import corpus_pipeline as p

    words = [f"w{i * 7919 % 5003}" for i in range(300)]
    near = [*words[:150], "other", *words[151:]]
    half = [*words[:150], *[f"v{i}" for i in range(150)]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate([near, words, half, words])], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in p.drop_near_duplicates(spark, docs, "").orderBy("doc_id").collect()] == [0, 2]
