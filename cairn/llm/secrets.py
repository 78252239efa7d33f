"""Secret scans: rules propose candidates, a random forest removes false positives. JVM-side throughout.

Texts are split by the rules' pattern with DataFrame functions; each candidate gets features (length, character
transitions, dictionary coverage, path, neighbouring words) as column expressions, and a random forest of the DataFrame
ML library, trained from labelled findings, gives the probability that it is a secret.

Defined cases: null and empty texts have no findings; texts are scanned whole; a null path is no path; repeated rows
give their findings each; an empty table gives an empty result; extra columns are ignored. Candidates do not overlap:
the leftmost wins, then the earlier rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Formats of credentials, by rule. Values have no upper length; a private key runs to its END line (up to 99 hyphens in its
#: headers) or, without one, to the end of its characters.
RULES = {
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+){0,99}-----END [A-Z ]{0,30}PRIVATE KEY-----|[0-9A-Za-z+/=\s]*+)",
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36,}+\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+\b",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
    "assignment": r"""(?:(?i)token|secret|passwo?r?d|pwd|api[_-]?key|access[_-]?key|credential)[\w-]{0,30}["']?\s{0,4}(?::=|=>|[:=])\s{0,4}["'][^"'\s]{6,}+["']""",
    "bare_assignment": r"""(?:(?i)token|secret|passwo?r?d|pwd|api[_-]?key|access[_-]?key|credential)[\w-]{0,30}\s{0,4}(?::=|=>|[:=])\s{0,4}(?=[^\s"',;]*[0-9])(?=[^\s"',;]*[A-Za-z])[^\s"',;]{8,}+""",
    "url_password": r"://[^\s:/@]{1,100}:[^\s:/@]{3,}+@",
    "opaque": r"\b[0-9A-Za-z_-]{32,}\b",
}
PATTERN = "|".join(f"(?:{p})" for p in RULES.values())
#: Words of code, settings and samples that placeholders are made of.
DICTIONARY = (
    "access account admin android apache api app application auth authentication authorization aws azure backend base bearer bucket build cache change changeme class client cloud code commit config "
    "configuration content credential data database debug default demo deploy development dummy email enter example fake field file foo bar baz function generated github google header hello here hidden host "
    "identifier input insert internal java key label language level license list local login mail management master message method mock model module my name none null number object online option output "
    "package page param pass passphrase password path placeholder port private production profile project public put random read redacted refresh release replace request response root sample scope script secret "
    "section secure security server service session setting site some source stage string super system table target temp template test text the this time title todo token tool type undefined update upload user "
    "username utils value variable version view web with world write your"
).split()
TRUSTED = r"(?i)\b(?:key|secret|token|password|passwd|pwd|auth|authorization|bearer|credential|credentials|login|api)"
DOUBTFUL = r"(?i)\b(?:example|sample|dummy|placeholder|fake|mock|test|sha|sha1|sha256|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|fingerprint|integrity|id)"
DOUBTFUL_PATH = r"(?i)(?:test|example|sample|mock|fixture|doc|spec|demo|tutorial|vendor|lock)"
FEATURES = ["length", "to_digit", "from_digit", "case", "signs", "consonants", "digits", "letters", "distinct", "entropy", "coverage", "longest_run", "sequence", "path", "trusted", "doubtful", "rule_index"]
NEIGHBOUR_CHARS = 40
TREES, DEPTH, SEED = 24, 7, 11
#: Labelled findings made by rule where none are given.
EXAMPLES = 4000
THRESHOLD = 0.5


def _matches(text: Column) -> Column:
    """Whether a rule matches. What each rule needs at least is looked for first, as that is far cheaper than the pattern."""
    low = F.lower(text)
    said = reduce(lambda a, b: a | b, [low.contains(w) for w in ("token", "secret", "passw", "pwd", "key", "credential")]) & (text.contains(":") | text.contains("="))
    known = [text.contains(w) for w in ("-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "k_live_", "k_test_", "eyJ", "://")]
    return F.coalesce(reduce(lambda a, b: a | b, known, said) | text.rlike("(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{32}"), F.lit(False)) & F.coalesce(text.rlike(PATTERN), F.lit(False))


def candidates(docs: DataFrame, columns: list[str], path: str | None = "source") -> DataFrame:
    """One row for each candidate: ``columns``, finding (from 0), start, length, rule, body, before, after, path."""
    text = F.col("text")
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    hit = docs.where(_matches(text)).select(*columns, where.alias("_path"), F.split(text, PATTERN, -1).alias("_gaps"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("_found"))
    # Where each gap begins: the gaps and matches before it.
    steps = F.zip_with(F.slice("_gaps", F.lit(1), F.size("_found")), F.col("_found"), lambda g, m: F.length(g) + F.length(m))
    begins = F.aggregate(steps, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    hit = hit.withColumn("_begins", begins)
    each = hit.select(*columns, "_path", "_gaps", "_begins", F.posexplode("_found").alias("finding", "_match"))
    before, after = F.get("_gaps", F.col("finding")), F.get("_gaps", F.col("finding") + 1)
    each = each.select(
        *columns, "finding", "_path", "_match", (F.get("_begins", F.col("finding")) + F.length(before)).cast("long").alias("start"),
        F.length("_match").cast("long").alias("length"), F.right(before, F.lit(NEIGHBOUR_CHARS)).alias("_before"), F.left(after, F.lit(NEIGHBOUR_CHARS)).alias("_after"),
    )
    rule = F.coalesce(*[F.when(F.col("_match").rlike(f"^(?:{p})$"), F.lit(k)) for k, p in RULES.items()], F.lit("opaque"))
    values = {"assignment": r"""["']([^"'\s]{6,}+)["']$""", "bare_assignment": r"(?::=|=>|[:=])\s*([^\s]+)$", "url_password": r":([^\s:/@]+)@$"}
    body = F.coalesce(*[F.when(F.col("rule") == k, F.regexp_extract("_match", p, 1)) for k, p in values.items()], F.col("_match"))
    return each.withColumn("rule", rule).withColumn("_body", body)


def with_features(found: DataFrame) -> DataFrame:
    body = F.col("_body")
    n = F.greatest(F.length(body), F.lit(1)).cast("double")
    # Transitions by kind, and letters that stand four or more consonants in a row.
    turns = [F.regexp_count(body, F.lit(p)) / n for p in (r"(?<=[A-Za-z])[0-9]", r"(?<=[0-9])[A-Za-z]", r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]", r"(?<=[0-9A-Za-z])[^0-9A-Za-z]|(?<=[^0-9A-Za-z])[0-9A-Za-z]")]
    hard = F.length(body) - F.length(F.regexp_replace(body, r"(?i)[bcdfghjklmnpqrstvwxz]{4,}", ""))
    chars = F.split(body, "")
    kinds = F.array_distinct(chars)
    share = lambda c: (F.length(body) - F.length(F.replace(body, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    known = "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"
    covered = F.length(body) - F.length(F.regexp_replace(F.lower(body), known, ""))
    near = F.concat_ws(" ", F.when(F.col("rule").isin("assignment", "bare_assignment"), F.regexp_extract("_match", r"^[\w-]+", 0)), F.col("_before"))
    runs = F.regexp_extract_all(body, F.lit(r"((.)\2*)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    rising = F.regexp_count(F.lower(body), F.lit("0123|1234|2345|3456|4567|5678|6789|abcd|bcde|cdef|defg|efgh|qwer|asdf|xxxx|0000"))
    index = reduce(lambda acc, kv: acc.when(F.col("rule") == kv[1], kv[0]), enumerate(RULES), F.when(F.lit(False), -1)).otherwise(-1)
    values = [
        n, *turns, hard / n, F.regexp_count(body, F.lit("[0-9]")) / n, F.regexp_count(body, F.lit("[A-Za-z]")) / n, F.size(kinds) / n, entropy, covered / n, longest / n, rising,
        F.coalesce(F.col("_path").rlike(DOUBTFUL_PATH), F.lit(False)).cast("double"), near.rlike(TRUSTED).cast("double"),
        (F.right(F.coalesce(F.col("_before"), F.lit("")), F.lit(24)).rlike(DOUBTFUL) | F.coalesce(F.col("_after"), F.lit("")).rlike(r"(?i)^.{0,8}\b(?:example|sample|dummy|placeholder|fake)")).cast("double"), index,
    ]
    return found.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in zip(FEATURES, values, strict=True)})


def labelled_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """text, source, label: findings made by rule. Secrets are drawn from hash digits; the rest are what scanners trip over."""
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    mixed = lambda salt, size: F.left(F.regexp_replace(F.base64(F.unhex(digest(salt))), "[+/=]", "q"), F.lit(size))
    word = lambda salt: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(len(DICTIONARY))) + 1).cast("int"))
    prose = F.concat_ws(" ", word("p1"), word("p2"))
    words = lambda s: F.concat_ws(s, word("w1"), word("w2"), word("w3"), word("w4"), word("w5"))
    name = F.element_at(F.array(*map(F.lit, ["token", "api_key", "secret", "password", "access_key", "auth_token", "TOKEN", "client_secret"])), (F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(8)) + 1).cast("int"))
    label_of = F.element_at(F.array(*map(F.lit, ["commit", "sha1", "checksum", "sha256:", "md5", "revision", "uuid", "etag", "digest"])), (F.pmod(F.xxhash64(F.lit("l"), "id"), F.lit(9)) + 1).cast("int"))
    quoted = lambda v, sign=" = ": F.concat(prose, F.lit(" "), name, F.lit(sign + '"'), v, F.lit('" '), word("q"))
    shown = lambda v: F.concat(prose, F.lit(" "), v, F.lit(" "), word("q"))
    bare = lambda v, sign="=": F.concat(prose, F.lit(" "), name, F.lit(sign), v, F.lit(" "), word("q"))
    secrets = [
        quoted(F.left(digest("a"), F.lit(40))), quoted(F.upper(F.left(digest("b"), F.lit(40)))), quoted(mixed("c", 24), ": "), quoted(mixed("d", 14)), quoted(F.left(digest("e"), F.lit(32)), ":"),
        shown(F.concat(F.lit("AKIA"), F.upper(mixed("f", 16)))), shown(F.concat(F.lit("ghp_"), mixed("g", 36))), shown(F.concat(F.lit("sk_live_"), mixed("h", 24))),
        shown(F.concat(F.lit("AIza"), mixed("i", 35))), shown(F.concat(F.lit("xoxb-"), mixed("j", 30))), shown(F.concat(F.lit("bearer "), mixed("k", 40))), shown(F.concat(F.lit("eyJ"), mixed("l", 20), F.lit("."), mixed("m", 40), F.lit("."), mixed("o", 40))),
        bare(mixed("u", 20)), bare(F.left(digest("v"), F.lit(24)), ": "), shown(F.concat(F.lit("https://user:"), mixed("w", 12), F.lit("@host"))),
    ]
    others = [
        quoted(words("_")), quoted(words("-"), ": "), quoted(F.concat(F.lit("your_"), word("w1"), F.lit("_here"))), quoted(F.lit("xxxxxxxxxxxxxxxxxxxx")), quoted(F.lit("0123456789abcdef0123456789abcdef")),
        quoted(F.lit("changeme123")), quoted(F.concat(F.lit("${"), F.upper(words("_")), F.lit("}"))), shown(F.concat(label_of, F.lit(" "), F.left(digest("r"), F.lit(40)))),
        shown(F.concat(label_of, F.lit(" "), digest("s"))), shown(words("_")), shown(F.concat(words("-"), F.lit("-"), words("-"))), shown(F.concat(F.lit("example AKIA"), F.upper(mixed("t", 9)), F.lit("EXAMPLE"))),
        bare(F.concat(words("_"), F.lit("1"))), bare(F.concat(F.lit("your-"), word("w1"), F.lit("-2")), ": "), shown(F.concat(F.lit("https://user:"), word("w1"), F.lit("@host"))),
    ]
    pick = F.pmod(F.col("id"), F.lit(30)).cast("int")
    text = reduce(lambda acc, kv: acc.when(pick == kv[0], kv[1]), enumerate([*secrets, *others]), F.when(F.lit(False), F.lit("")))
    where = F.when(F.pmod(F.xxhash64(F.lit("at"), "id"), F.lit(10)) < F.when(pick < 15, 1).otherwise(4), F.lit("tests/example.py")).when(F.pmod(F.col("id"), F.lit(2)) == 0, F.lit("src/main.py")).otherwise(F.concat(F.lit("src"), F.pmod(F.col("id"), F.lit(20)).cast("string")))
    return cut(spark.range(n).select("id", text.alias("text"), where.alias("source"), (pick < 15).cast("double").alias("label")))


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="_vector").transform(df)


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """A random forest from labelled findings (text, source, label); a text's first candidate is the finding."""
    found = cut(with_features(cut(candidates(labelled, ["label"]))).where("finding = 0").select("label", *[f"f_{k}" for k in FEATURES]))
    return RandomForestClassifier(labelCol="label", featuresCol="_vector", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(_vectors(found))


def findings(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), model: RandomForestClassificationModel | None = None, path: str | None = "source") -> DataFrame:
    """``columns``, finding, rule, start (characters), length, secret_sha256, probability, confirmed of every candidate."""
    model = model or train(labelled_findings(docs.sparkSession))
    scored = model.transform(_vectors(with_features(cut(candidates(docs, list(columns), path)))))
    chance = F.round(vector_to_array("probability")[1], 6)
    return scored.select(*columns, "finding", "rule", "start", "length", F.sha2("_body", 256).alias("secret_sha256"), chance.alias("probability"), (chance >= THRESHOLD).alias("confirmed"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with confirmed secrets replaced by ``mark``; n_chars follows the text where there is such a column.

    Only texts with a candidate are joined to their findings; the others pass as they are. Rows that repeat an id and a
    text are redacted each; a null text stays null.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text"), F.col("doc_id"), F.xxhash64("text").alias("key"), F.col("source"))
    matched = _matches(F.col("text"))
    hit = cut(plain.where(matched))
    sure = findings(hit, ("doc_id", "key")).where("confirmed").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_of")).agg(F.collect_set("finding").alias("_sure"))
    joined = hit.join(sure, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_of")), "left")
    gaps, found = F.split("text", PATTERN, -1), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    joined = joined.withColumn("_gaps", F.when(F.col("_sure").isNotNull(), gaps))
    parts = F.transform(found, lambda m, i: F.concat(F.get(F.col("_gaps"), i), F.when(F.array_contains("_sure", i), F.lit(mark)).otherwise(m)))
    clean = F.when(F.col("_sure").isNotNull(), F.concat(F.array_join(parts, ""), F.element_at("_gaps", -1))).otherwise(F.col("text"))
    joined = joined.withColumn("clean", clean)

    def column(i: int, name: str) -> Column:
        if name == "text":
            return F.col("clean")
        if name == "n_chars":
            return F.when(F.col("_sure").isNotNull(), F.length("clean").cast(docs.schema[name].dataType)).otherwise(F.col(f"c{i}"))
        return F.col(f"c{i}")

    return docs.where(~matched).unionByName(joined.select(*[column(i, c).alias(c) for i, c in enumerate(names)]))
