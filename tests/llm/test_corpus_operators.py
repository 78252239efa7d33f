"""Each operator against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import ann, graph, language, lm, mixing, packing, secrets, simhash, substrings, topk, toxicity
from cairn.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, part int, key string, n int"
WORD = r"[^\x20\x09-\x0D]+"
EN = "the quick brown fox jumps over the lazy dog while the old man reads a long story about rivers and hills number {} of them all, and then some more words follow here"
DE = "der schnelle braune fuchs springt über den faulen hund während der alte mann eine lange geschichte liest nummer {} von allen, und dann folgen noch mehr wörter hier"


def rows():
    out = [(i, (EN if i % 2 else DE).format(i * 7919), "en" if i % 2 else "de", f"s{i % 3}") for i in range(40)]
    out += [(100 + i, EN.format("same"), "en", "s0") for i in range(12)]
    out += [(200, None, "en", "s1"), (201, "", None, "s1"), (202, " \t\n", "en", None), (203, "12 !! 34", "en", None), (204, "word " * 6000, "en", "s2"), (205, "Ünï çödé “quotes” ÀÉ", "de", "s2")]
    out += [(300, EN.format(1), "en", "s0"), (300, EN.format(1), "en", "s0"), (None, "no id at all", "en", "s0")]
    return [(*r, len(r[1]) if r[1] is not None else None, 5, 0.5, 1, "k", 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_packing_places_every_id_once(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER).collect()
    want = Counter()
    for r in rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            want[r[0], p, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0] + [n for _, n in sorted(own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_plan_is_near_the_bound(seed):
    lengths = np.minimum(2048, np.random.default_rng(seed).lognormal(6, 1.2, 30_000).astype(int) + 1)
    hist = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.make_plan(hist)
    held = Counter()
    for contents, n in plan:
        assert sum(contents) <= 2048
        for k in contents:
            held[k] += n
    assert held == Counter(hist) and sum(n for _, n in plan) <= 1.004 * lengths.sum() / 2048 + 1
    assert packing.make_plan({}) == []


def test_simhash_against_all_pairs(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints, ids = [], [r[0] for r in rows()]
    for r in rows():
        w = re.findall(WORD, lower(r[1]))
        g = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(ids)))
    for _ in ids:
        for i, a in enumerate(prints):
            label[i] = min(label[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2)
    want = Counter((ids[i], f"{p:016x}", min(ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None) if any(ids[j] is not None for j in range(len(ids)) if label[j] == label[i]) else None) for i, p in enumerate(prints))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("shard", [1024, 4])
def test_links_of_large_shards_lose_none(spark, shard):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6).tolist()
    values = {b for b in base} | {b ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 5))) for b in base for _ in range(40)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    got = graph.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), shard), "a", "b")
    roots = {r["node"]: r["root"] for r in got.collect()}
    label = {v: v for v in signed}
    for _ in range(40):
        for v in signed:
            label[v] = min(label[u] for u in signed if ((u ^ v) & (1 << 64) - 1).bit_count() <= 2)
    assert {v: roots.get(v, v) for v in signed} == label


def test_bk_tree_finds_all_within_the_radius():
    rng, tree, values = np.random.default_rng(1), simhash.BKTree(), []
    for v in rng.integers(0, 1 << 10, 300).tolist():
        assert sorted(tree.near(v, 2)) == sorted(((u ^ v).bit_count(), u) for u in values if (u ^ v).bit_count() <= 2)
        tree.add(v)
        values.append(v)
    assert tree.near(values[0], 0)


def edited(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), int(share * len(out)), replace=False):
        out[i] = f"x{rng.integers(1 << 30)}"
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents_against_all_pairs(spark):
    """Pairs of a Jaccard similarity of 0.8 or more are in one group, and every text of a group has such a partner there."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{v}" for v in rng.integers(0, 4000, n)]
    passage = word(60)
    texts = [word(int(n)) for n in rng.integers(40, 400, 60)] + [word(60) + passage + word(20) for _ in range(30)]
    texts += [edited(rng, texts[i], share) for i in range(60) for share in (0.005, 0.02, 0.03, 0.04, 0.3)] + [texts[0], ["one", "two"], ["one", "two"], ["one", "three"]]
    d = [(i, " ".join(t).upper()) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (None, " ".join(texts[1]))]
    df = spark.createDataFrame(d, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit("k"))
    got = {r["doc_id"]: bytes(r["component"]) for r in simhash.similar_documents(df, ("doc_id",)).collect()}
    assert len(got) == len(d) and got[9000] == got[9001] and got[None] == got[1]
    for i, a in enumerate(texts):
        for j in range(i):
            if (both := jaccard(a, texts[j])) >= 0.8:
                assert got[i] == got[j], (i, j, both)
    alike = lambda c: [texts[i] for i, x in got.items() if x == c and i is not None and i < len(texts)]
    for c in set(got.values()):
        own = alike(c)
        assert all(max([jaccard(a, b) for b in own if b is not a], default=1) >= 0.8 for a in own)
    assert simhash.similar_documents(df.limit(0), ("doc_id",)).count() == 0


def test_similar_documents_of_large_groups(spark, monkeypatch):
    """Shards far above their bound: near copies stay one group, texts that share half of their words don't become one."""
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = np.random.default_rng(12)
    word = lambda n: [f"w{v}" for v in rng.integers(0, 4000, n)]
    base, passage = word(300), word(100)
    d = [(i, " ".join(edited(rng, base, 0.01))) for i in range(150)] + [(1000 + i, " ".join(word(60) + passage + word(40))) for i in range(100)]
    got = {r["doc_id"]: bytes(r["component"]) for r in simhash.similar_documents(spark.createDataFrame(d, "doc_id long, text string"), ("doc_id",)).collect()}
    assert len({got[i] for i in range(150)}) == 1 and len({got[1000 + i] for i in range(100)}) == 100


def shares(size, weight, total, cap):
    """Targets by filling: what sources at their bound leave goes to the others by weight, one round after another."""
    out, full = {}, set()
    while True:
        left = total - sum(cap * size[k] for k in full)
        free = [k for k in size if k not in full]
        out = {k: cap * size[k] for k in full} | {k: weight[k] * left / sum(weight[j] for j in free) for k in free}
        above = {k for k in free if out[k] > cap * size[k]}
        if not above:
            return out
        full |= above


def test_mixing_meets_targets(docs, none):
    got = mixing.mix(docs, columns=("source",)).collect()
    again = mixing.mix(docs.repartition(5), columns=("source",)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))
    own = {}
    for r in rows():
        own.setdefault(r[3], []).append(len(re.findall(WORD, r[1] or "")))
    names = sorted(own, key=lambda s: (s is None, s or ""))
    size = {k: sum(v) for k, v in own.items()}
    goal = shares(size, {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}, 1.5 * sum(size.values()), 2.0)

    def rate(k, tilt, n):
        return min(2.0, math.exp(min(700.0, tilt * n * len(own[k]) / size[k])))

    tilts = {}
    for k in names:  # the dual by halving
        low, high = -1e4, 1e4
        for _ in range(200):
            tilts[k] = (low + high) / 2
            low, high = (low, tilts[k]) if sum(n * rate(k, tilts[k], n) for n in own[k]) > goal[k] else (tilts[k], high)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]] and math.isclose(r["target"], goal[r["source"]])
        assert r["copies"] in (math.floor(r["rate"]), math.ceil(r["rate"])) or abs(r["copies"] - r["rate"]) <= 1
        if goal[r["source"]] < 1.999 * size[r["source"]] and r["size"]:
            assert math.isclose(r["rate"], rate(r["source"], tilts[r["source"]], r["size"]), rel_tol=1e-5, abs_tol=1e-9)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in names) and math.isclose(sum(goal.values()), 1.5 * sum(size.values()))
    assert any(len({round(r["rate"], 6) for r in got if r["source"] == k and r["size"]}) > 3 for k in names)
    assert mixing.mix(none).count() == 0


def test_language_learns_and_rejects(docs, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identify(docs).collect()}
    assert {(i, "en" if i % 2 else "de") for i in range(40)} <= got
    assert {(200, "und"), (201, "und"), (202, "und"), (203, "und")} <= got
    assert language.identify(none).count() == 0


def test_language_against_brute_force(spark):
    """Multinomial naive Bayes written out gram by gram."""
    rng = np.random.default_rng(7)
    sound = {"aa": ["ba", "lo", "mi", "ra"], "bb": ["kru", "ost", "ich", "ba"], "cc": ["eau", "lle", "ra", "mi"]}
    word = lambda k: "".join(rng.choice(sound[k], rng.integers(1, 3)))
    data = [(i, " ".join(word(k) for _ in range(int(rng.integers(2, 12)))), k) for i in range(120) for k in [["aa", "bb", "cc", "aa"][i % 4]]]
    data += [(200, "Ba lo 12!", "aa"), (201, "ß", "bb")]

    def grams(text):
        clean = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
        for n in (1, 2, 3):
            for i in range(len(clean) - n + 1):
                h = n
                for j in range(n):
                    h = ((h ^ ord(clean[i + j])) * [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9][j]) & (1 << 64) - 1
                    h ^= h >> 29
                yield (h >> 17) % language.BUCKETS

    held = lambda i: i % 3 == 1
    counts, texts = {k: Counter() for k in sound}, Counter()
    for i, t, k in data:
        if not held(i):
            counts[k].update(grams(t))
            texts[k] += 1
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("n", F.lit(1)), F.col("doc_id") % 3 == 1).collect()}
    total = {k: sum(c.values()) + 0.5 * language.BUCKETS for k, c in counts.items()}
    for i, t, _ in data:
        score = {k: math.log((texts[k] + 0.5) / sum(n + 0.5 for n in texts.values())) + sum(math.log((counts[k][g] + 0.5) / total[k]) for g in grams(t)) for k in sound}
        assert got[i]["lang_pred"] == max(sorted(score), key=score.get) and 0 < got[i]["score"] <= 1


def test_secrets_forest_rejects_on_rows_it_has_not_seen(spark):
    every = secrets.labelled_findings(spark, 3000)
    model = secrets.train(every.where("pmod(xxhash64(id), 10) < 6"))
    rest = every.where("pmod(xxhash64(id), 10) >= 6").withColumn("doc_id", F.col("id"))
    found = {r["doc_id"]: r["confirmed"] for r in secrets.findings(rest, model=model).where("finding = 0").collect()}
    label = {r["id"]: r["label"] == 1 for r in rest.select("id", "label").collect()}
    assert set(found) <= set(label) and sum(label[i] for i in found) > 0.98 * sum(label.values())
    caught, wrong = np.mean([c for i, c in found.items() if label[i]]), np.mean([c for i, c in found.items() if not label[i]])
    assert caught > 0.95 and wrong < 0.05 and sum(not label[i] for i in found) > 300


def test_secrets_candidates_against_a_scan_by_hand(spark):
    """Runs of opaque characters, known prefixes and assignments, found by walking over the words."""
    key = hashlib.sha1(b"y").hexdigest()
    words = [f"token = '{key}'", "AKIA" + "Q7" * 8, key, "ghp_" + "a1B2" * 9, "password: hunter22x", "pwd=abcdefgh", "api_key => Zx81Zx81Zx", "https://me:s3cret@host/x", "plain", "under_score_name", "A" * 31, "B" * 32]
    found = [True, True, True, True, True, False, True, True, False, False, False, True]
    d = spark.createDataFrame([(i, f"left {w} right") for i, w in enumerate(words)], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    got = {r["doc_id"] for r in secrets.candidates(d, ["doc_id"]).collect()}
    assert got == {i for i, f in enumerate(found) if f}


def test_secrets(spark, none):
    secret = hashlib.sha1(b"x").hexdigest()
    d = [(1, f'some words token = "{secret}" end', "s"), (2, "commit " + secret, "s"), (3, 'password = "your_password_here"', "docs"), (4, None, None), (5, "", "s"), (6, f'a token = "{secret}" b', "s"), (6, f'a token = "{secret}" b', "s")]
    df = spark.createDataFrame(d, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("rule", F.lit(1))
    found = secrets.findings(df).collect()
    assert sorted((r["doc_id"], r["confirmed"]) for r in found) == [(1, True), (2, False), (3, False), (6, True), (6, True)]
    assert {d[0][1][r["start"] : r["start"] + r["length"]] for r in found if r["doc_id"] == 1} == {f'token = "{secret}"'}
    clean = {(r["doc_id"], r["text"], r["n_chars"]) for r in secrets.redact(df).collect()}
    assert (1, "some words [SECRET] end", 23) in clean and (2, "commit " + secret, 47) in clean and (4, None, None) in clean
    assert secrets.redact(df).count() == len(d) and secrets.findings(none).count() == 0


def test_secrets_of_any_length_are_found_whole(spark):
    mixed = lambda n: "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n // 64 + 1))[:n]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = "\n".join(mixed(9000)[i : i + 64] for i in range(0, 9000, 64))
    want = [
        mixed(200), mixed(201), mixed(100_000), f'token = "{mixed(201)}"', f'token = "{mixed(5000)}"', f"eyJ{mixed(40)}.{mixed(4001)}.{mixed(43)}", "ghp_" + mixed(300), "xoxb-" + mixed(300),
        "sk_live_" + mixed(120), f"{begin}\n{lines}\n{end}", f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{mixed(32)}\n\n{lines}\n{end}", f"{begin}\n{lines}",
    ]
    d = [(i, f"some words {x}{'' if x.endswith(mixed(9000)[-20:]) else ' and more'}", "s") for i, x in enumerate(want)]
    got = {}
    for r in secrets.candidates(spark.createDataFrame(d, "doc_id long, text string, source string"), ["doc_id"]).collect():
        got.setdefault(r["doc_id"], []).append((r["_match"], r["rule"]))
    rules = ["opaque", "opaque", "opaque", "assignment", "assignment", "jwt", "github_token", "slack_token", "stripe_key", "private_key", "private_key", "private_key"]
    assert got == {i: [(x, k)] for i, (x, k) in enumerate(zip(want, rules, strict=True))}


def test_substrings_against_brute_force(spark, none):
    rng = np.random.default_rng(0)
    word = lambda n: "".join(rng.choice(list("abcdé ç")) for _ in range(n))
    shared, long = word(180), word(400)
    texts = [word(300), shared + word(90), word(40) + shared + word(70), long, long, long[:250] + "x" + long[250:], "ab" * 200, "z" * 500, "z" * 130, None, "", word(99), word(120) + shared[20:150] + shared[10:170], shared + shared]
    d = [(i, t) for i, t in enumerate(texts)] + [(3, long), (3, word(50) + shared), (None, word(30) + shared), (None, shared + word(20)), (None, word(200)), (None, None)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(spark.createDataFrame(d, "doc_id long, text string").withColumn("size", F.lit(1)).repartition(4)).collect())
    keyed = {(i, t): None for i, t in d}
    hashed = {r["t"]: (r["k"], r["other"]) for r in spark.createDataFrame([(t or "",) for _, t in keyed], "t string").distinct().select("t", F.xxhash64("t").bitwiseAND(F.lit(2**63 - 1)).alias("k"), F.xxhash64(F.lit(7), "t").bitwiseAND(F.lit(2**63 - 1)).alias("other")).collect()}
    place = lambda i, t: (i is not None, hashed[t][1] if i is None else i, -hashed[t][0] if i is None else hashed[t][0])
    seen, out = set(), {}
    for i, t in sorted(keyed, key=lambda x: place(x[0], x[1] or "")):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, t] = (i, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), kept)
    assert got == Counter(out[x] for x in d)
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_of_texts_without_ids_are_told_apart(spark):
    """Many texts without an id, of which each repeats another's passage: none is taken for another."""
    rng = np.random.default_rng(9)
    passage = ["".join(rng.choice(list("abcdefgh")) for _ in range(120)) for _ in range(20)]
    d = [(None, f"{k:04d} {passage[k % 20]} end {k}") for k in range(400)]
    got = substrings.remove_repeats(spark.createDataFrame(d, "doc_id long, text string")).collect()
    assert Counter(r["n_removed"] > 0 for r in got) == {True: 380, False: 20} and len(got) == 400
    assert all(120 <= r["n_removed"] <= 140 for r in got if r["n_removed"])


def test_lm_counts_exactly_and_scores(docs, none):
    held = F.coalesce(F.col("doc_id") % 10 == 0, F.lit(True))
    got = lm.score(docs, held).collect()
    token = lambda t: [*re.findall(WORD, lower(t)), " end"]
    count = Counter(w for r in rows() if r[0] is not None and r[0] % 10 for w in token(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter((r[0], len(token(r[1])), sum(count[w] > 0 for w in token(r[1])), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(r[1])), 6)) for r in rows())
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200) > sum(r["base_score"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert lm.score(none).count() == 0


def test_lm_filter_keeps_its_bits_at_every_size(docs, monkeypatch):
    want = {(r["doc_id"], r["score"]) for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "MOST_BITS", 4096, raising=False)
    assert {(r["doc_id"], r["score"]) for r in lm.score(docs).collect()} == want


def test_lm_reads_bigrams_seen_once(spark):
    words = [f"w{i}" for i in range(60)]
    d = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(reversed(words)))]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(d, "doc_id long, text string"), F.col("doc_id") > 1).collect()}
    assert got[2] > got[3] + 1


def test_lm_weights_come_from_all_training_texts(spark):
    rng = np.random.default_rng(8)
    lines = ["red fox runs home", "blue fox sits down", "the old red house stands"]
    d = [(i, " ".join(lines[j] for j in rng.integers(0, 3, 1500))) for i in range(1, 5)] + [(0, " ".join(lines))]
    assert all(len(t) > 20_000 for i, t in d if i)
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(d, "doc_id long, text string"), F.col("doc_id") == 0).collect()}
    token = lambda t: [None, *t.split(), " end"]
    seqs = [token(t) for i, t in d if i]
    one, two = Counter(w for s in seqs for w in s[1:]), Counter(p for s in seqs for p in zip(s, s[1:]))
    n, v = sum(one.values()), len(one)
    read = lambda c, base: float(lm.level_count(lm.levels(np.array([c]), base), base)[0]) if c else 0.0

    def parts(a, b, less):
        context = max(1.0, read(one[" end"], lm.BASES[0])) if a is None else read(one[a], lm.BASES[0])
        uni = (max(read(one[b], lm.BASES[0]) - less, 0) + 0.1) / (n + 0.1 * (v + 1))
        return uni, min(1.0, max(read(two[a, b], lm.BASES[1]) - less, 0) / max(context - less, 1)) if context > less else 0.0, int(math.log2(max(context, 1)))

    w = Counter()
    for _ in range(20):
        share, total = Counter(), Counter()
        for (a, b), m in two.items():
            u, r, k = parts(a, b, 1.0)
            x = w.get(k, 0.1)
            share[k] += m * x * r / (x * r + (1 - x) * u)
            total[k] += m
        w = {k: min(0.95, max(1e-4, (share[k] + 0.5) / (total[k] + 10))) for k in total}
    s = token(d[-1][1])
    want = sum(math.log10(min(1.0, w.get(k, 0.1) * r + (1 - w.get(k, 0.1)) * u)) for u, r, k in (parts(a, b, 0.0) for a, b in zip(s, s[1:])))
    assert math.isclose(got[0], want, rel_tol=0.02)


def vectors(spark, n=600, d=24):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d)) + 3 * rng.normal(size=(12, d))[rng.integers(0, 12, n)]
    x[50:90] = x[50]
    data = [(i, [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [float("nan")] * d, 0), (n + 3, [None] * d, 0), (n + 4, [0.0] * d, 0), (n + 5, [1.0, 2.0], 0), (None, data[0][1], 0)]
    return data, spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int").withColumn("part", F.lit(1)).repartition(3)


def test_topk_is_exact(spark):
    data, df = vectors(spark)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    z = np.floor(256 * np.array([v for _, v, _ in data])).astype(np.int64)
    want = set()
    for i in range(0, len(z), 50):
        s = [(-(z[i] @ z[j]), j) for j in range(len(z)) if j != i] + [(0, len(z) + 4)]
        want |= {(i, k + 1, j, int(-x)) for k, (x, j) in enumerate(sorted(s)[:5])}
    assert {tuple(r) for r in got if r["query_id"] < len(z)} == want
    large = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e3, 2.0]), (2, [-1e3, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(large, F.col("vec_id") == 1, k=2).collect()] == [(0, (1 << 63) - 1), (2, 256000 * -256000 + 512 * 128)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert {tuple(r) for r in got} == {tuple(r) for r in topk.top_k(df.withColumns({c: F.lit(1) for c in ("id", "v", "tile", "ask", "is_query")}).repartition(7), F.col("vec_id") % 50 == 0).collect()}
    few = topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2] and topk.top_k(df, F.lit(False)).count() == 0


def test_ann_recall_and_scores(spark):
    data, df = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    x, hits = np.array([v for _, v, _ in data]), 0
    for i in range(0, len(x), 20):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == i)
        assert [r for r, _, _ in own] == list(range(1, 11)) and all(math.isclose(s, d[j], abs_tol=1e-9) for _, j, s in own)
        assert [(s, j) for _, j, s in own] == sorted((s, j) for _, j, s in own)
        hits += len({j for _, j, _ in own} & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(range(0, len(x), 20))
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_searches_other_dimensions_whole(spark):
    _, df = vectors(spark)
    rng = np.random.default_rng(6)
    other = [(5000 + i, [float(v) for v in rng.normal(size=3)], 0) for i in range(30)]
    mixed = df.withColumns({c: F.lit(1) for c in ("id", "v", "tile", "ask")}).unionByName(spark.createDataFrame(other, "vec_id long, embedding array<float>, label int"), allowMissingColumns=True)
    got = ann.nearest(mixed, F.col("vec_id").isin(5000, 603)).collect()
    x = np.array([np.float32(v) for _, v, _ in other], np.float64)
    d = np.sqrt(((x - x[0]) ** 2).sum(1))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [5000 + int(j) for j in np.argsort(d)[1:11]]


def test_toxicity_and_its_index(spark, none):
    rng = np.random.default_rng(2)
    bad, plain = ["idiot", "scum", "trash"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    data, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        words = rng.choice(plain, 30).tolist() + (rng.choice(bad, 2).tolist() if toxic else [])
        data.append((i, " ".join(words).title() + ".", "en", "s"))
        labels.append((i, 1, toxic))
    data += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "Idiot, " * 3000, "en", "s"), (903, "calm and clean", "en", None)]
    labels += [(900, 1, None), (None, 1, 1)]
    d, y = spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, y).collect()}
    truth = {i: t for i, _, t in labels}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert got[902]["predicted"] == 1 and got[903]["predicted"] == got[900]["predicted"] == got[901]["predicted"] == 0
    assert toxicity.classify(none, y).count() == 0 and {r["score"] for r in toxicity.classify(d, y.limit(0)).collect()} == {0.0}
    assert all(r["evidence"] and truth[r["evidence"][0]] == 1 for r in held if r["predicted"])


def test_toxicity_neighbours_are_those_of_every_cosine():
    """Cosines written out term by term, over all examples, against the index."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "xyz" for c in "pqrst"]
    texts = [" ".join(rng.choice(words, rng.integers(3, 40)).tolist() + (["scum"] if i % 5 == 0 else [])) for i in range(300)] + ["", "only once", "abcp " * 500]
    y = [int(i % 5 == 0) for i in range(len(texts))]
    counted = [toxicity.terms(t) for t in texts]
    index = toxicity.fit(list(range(len(texts))), counted, y, (1.0, 1.0))
    n, n1 = len(texts), sum(y)
    df, df1 = Counter(t for c in counted for t in c), Counter(t for c, k in zip(counted, y, strict=True) if k for t in c)

    def weights(c):
        out = {}
        for t, m in c.items():
            a, b = df1[t], df[t] - df1[t]
            p = df[t] / n
            apart = abs(a / n1 - b / (n - n1)) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
            out[t] = (1 + math.log(m)) * (math.log((1 + n) / (1 + df[t])) + 1) * (1 + max(0.0, apart - 3.0))
        length = math.sqrt(sum(v * v for v in out.values())) or 1.0
        return {t: v / length for t, v in out.items()}

    vectors = [weights(c) for c in counted]
    for query in [*counted[:25], toxicity.terms("scum axp never seen before"), toxicity.terms("bzt")]:
        q = weights(query)
        cosine = {i: sum(v * x.get(t, 0.0) for t, v in q.items()) for i, x in enumerate(vectors)}
        near, found = next(index.neighbours([index.vector(query)], 15))
        want = sorted((c for c in cosine.values() if c > 1e-12), reverse=True)[:15]
        assert np.allclose(found, want) and all(math.isclose(cosine[int(index.ids[j])], c, abs_tol=1e-9) for j, c in zip(near, found, strict=True))
    assert len(index.vector(toxicity.terms("never seen"))[0]) == 0 and 0 <= next(index.score([Counter()]))[0] <= 1


def test_toxicity_of_repeated_ids_is_the_same_in_reruns(spark):
    data = [(i, f"word{i % 7} text {'scum' if i % 3 == 0 else 'fine'}") for i in range(60)] + [(i, f"other text of {i}") for i in range(60)]
    d, y = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("terms", F.lit("x")), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in toxicity.classify(df, y).collect())
    assert key(d.repartition(2)) == key(d.repartition(5)) and d.count() == len(key(d))


def test_joins_of_hot_keys_lose_nothing(spark, monkeypatch):
    from cairn.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(k, i) for k, n in (("a", 50), ("b", 4), ("c", 3), ("d", 1)) for i in range(n)]
    many, one = spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame([("a", 50, "A"), ("b", 4, "B"), ("c", 3, "C"), ("d", 1, "D"), ("e", 0, "E")], "k string, n int, name string")
    got = Counter(tuple(r) for r in common.join_counted(many, one, "k", "n", len(rows)).select("k", "i", "name").collect())
    assert got == Counter((k, i, k.upper()) for k, i in rows)
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(59, 200), (7, 7)]
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert roots == {**{i: 0 for i in range(60)}, 200: 0, **{100 + i: 100 for i in range(21)}}
    assert graph.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_packing_of_pieces_that_agree_in_everything(spark):
    """Rows without an id and with the same text, and more of one length than any other: each has its own place."""
    d = spark.createDataFrame([(None, "same text here")] * 300 + [(i, "word " * 5000) for i in range(3)], "doc_id long, text string").repartition(4)
    got = packing.pack(d, TOKENIZER).collect()
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(set(places)) == len(places) == 300 + 3 * -(-5001 // 2048)
