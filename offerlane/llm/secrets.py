"""Secret scans: high-recall candidates, and a random forest that removes false ones.

Candidates are long tokens with a digit, values behind an assignment (quoted or
not, also in URLs), and private-key headers. Each becomes a row of numbers: its length, its transitions between
character classes and between letters, its coverage by a dictionary (common words, and
the frequent ones of the corpus itself), its path and its neighbouring words. A random forest fitted on labelled findings gives the score.

All of it is built-in expressions and Spark ML on the JVM. Texts are read in one
pass; only candidates go on.

Defined cases: null and empty texts have no candidate; very long texts are read
whole; equal rows have equal findings, each its own; a null path has no path
features; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlane.llm.common import words_of
from offerlane.llm.spans import entropy, matches, per_char

TOKEN, VALUE = "[A-Za-z0-9+/_-]", "[A-Za-z0-9+/_!@#$%^&*=-]"
#: In order: key headers, passwords in URLs with what is before them, query parameters with their values, all other assigned
#: values (not from the second sign of "==" or ":="), long tokens with their padding. Values come before tokens, which
#: would cut them at a sign; a parameter whose value is short is matched too, so that it isn't taken for another value.
CANDIDATE = "|".join([
    "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    r"//[A-Za-z0-9._%-]*+:[A-Za-z0-9+_!#$%^&*=-]{8,}+(?=@)",
    r"[?&][A-Za-z0-9_.-]++=[A-Za-z0-9+/_!@#$%^*=-]*+",
    rf"(?<=[=:]|[=:] |[=:][\"'`]|[=:] [\"'`])(?!(?<=[=:])=){VALUE}{{8,}}+",
    rf"(?<!{TOKEN})(?=[A-Za-z+/_-]*+[0-9]){TOKEN}{{16,}}+(?:={{1,2}}+(?!{VALUE}))?+",
])
#: What is before the value in a match of the second and third kind; characters of a candidate at least.
KEY, SHORTEST = r"^(?://[A-Za-z0-9._%-]*+:|[?&][A-Za-z0-9_.-]++=)", 8
#: What a text must contain to have a candidate: less than each branch of CANDIDATE asks for.
NEED = rf"-----BEGIN|{TOKEN}{{16}}|[=:] ?[\"'`]?{VALUE}{{8}}"
#: Common words and word parts; the corpus's own frequent words come in addition.
DICTIONARY = (
    "the and for that with this from have not are was you your all can has but test example sample user name data file "
    "value string config default admin root public private secret token password key hash code page list item http www "
    "com org net html json ing tion ment able ness ight ough the pour dans avec les des une der die das und nicht ein "
    "los las del que con para ción heit keit ung lich sch"
).split()
CUES = r"(?i)(?:secret|token|passw(?:or)?d|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|auth|bearer|key)[A-Za-z0-9_]{0,16}[\"'`]?\s{0,2}(?:=>|[:=])?\s{0,2}[\"'`]?$"
DOUBTS = r"(?i)(?:example|sample|dummy|placeholder|commit|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|build|revision|version|href|src|url|class|id)[^A-Za-z0-9]{0,4}$"
#: Labelled findings that are made for training; trees, depth; score from which a candidate is a secret.
FINDINGS, TREES, DEPTH, THRESHOLD = 6000, 24, 7, 0.5
LEFT, RIGHT = 40, 12
#: Words of the corpus in the dictionary, their lengths, and the share of documents that must have them. Share of letter pairs that are common ones.
WORDS, LENGTHS, SHARE, COMMON = 2000, (5, 12), 0.0004, 0.8


def one_of(words: list[str]) -> str:
    """A pattern that matches the longest of some words, letter by letter as in a prefix tree."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        branches = "|".join(re.escape(c) + pattern(rest) for c, rest in sorted(at.items()) if c)
        if not branches:
            return ""
        return f"(?:{branches})" + ("?" if "" in at else "")

    return pattern(tree)


def candidates(text: Column) -> Column:
    """The candidates of a text as array<MATCH>, without what is before their values."""

    def cut(x: Column) -> Column:
        key = F.regexp_extract(x["match"], KEY, 0)
        n = F.char_length(key)
        own = F.substring(x["match"], n + 1, F.char_length(x["match"]))
        return x.withField("start", x["start"] + n).withField("left", F.right(F.concat(x["left"], key), F.lit(LEFT))).withField("match", own)

    found = F.transform(matches(text, CANDIDATE, LEFT, RIGHT, through=True), cut)
    return F.filter(found, lambda x: F.char_length(x["match"]) >= SHORTEST)


def dictionary(df: DataFrame, text: str = "text", share: float = SHARE) -> list[str]:
    """The WORDS most frequent plain words of all documents, by the documents that have them; share: of documents, at least."""
    plain = F.filter(words_of(F.col(f"`{text}`")), lambda w: w.rlike(f"^[a-z]{{{LENGTHS[0]},{LENGTHS[1]}}}$"))
    counts = df.select(F.explode(F.concat(F.array_distinct(plain), F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))  # "" counts documents
    first = counts.orderBy(F.col("n").desc(), "word").limit(WORDS + 1).collect()  # "" is the first of them
    return [r["word"] for r in first[1:] if r["n"] >= share * first[0]["n"]]


def common_pairs(words: list[str]) -> list[str]:
    """The most frequent pairs of neighbouring letters in words, COMMON of all pairs together."""
    counts = Counter(w[k : k + 2] for w in words for k in range(len(w) - 1))
    found, seen = [], 0
    for pair, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if seen >= COMMON * sum(counts.values()):
            break
        found.append(pair)
        seen += n
    return sorted(found)


def features(match: Column, left: Column, right: Column, path: Column, words: list[str]) -> dict[str, Column]:
    """A candidate as numbers. words: the corpus's own for the dictionary."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    pairs = "|".join(common_pairs([*DICTIONARY, *words]))
    words = one_of(sorted({*DICTIONARY, *words}))
    n = F.greatest(F.char_length(match), F.lit(1))
    return {
        "length": F.least(n, F.lit(512)).cast("double"),
        "digits": per_char(match, "[0-9]"),
        "upper": per_char(match, "[A-Z]"),
        "vowels": per_char(match, "(?i)[aeiouy]"),
        "signs": per_char(match, "[^A-Za-z0-9]"),
        "letter_to_digit": per_char(match, "(?<=[A-Za-z])[0-9]"),
        "digit_to_letter": per_char(match, "(?<=[0-9])[A-Za-z]"),
        "lower_to_upper": per_char(match, "(?<=[a-z])[A-Z]"),
        "upper_to_lower": per_char(match, "(?<=[A-Z])[a-z]"),
        "consonant_run": per_char(match, "(?i)[bcdfghjklmnpqrstvwxz]{4}"),
        "repeat": per_char(match, r"(.)\1"),
        "entropy": entropy(match),
        "dictionary": 1 - F.char_length(F.regexp_replace(match, f"(?i){words}", "")) / n,
        "common_pairs": per_char(match, f"(?i)(?=(?:{pairs}))"),
        "hex": flag(match.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(match.rlike("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "only_digits": flag(match.rlike("^[0-9]+$")),
        "slashes": per_char(match, "/"),
        "known_prefix": flag(match.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|-----BEGIN)")),
        "cue": flag(left.rlike(CUES)),
        "doubt": flag(left.rlike(DOUBTS)),
        "assigned": flag(left.rlike(r"[=:]\s?[\"'`]?$")),
        "quoted": flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "in_link": flag(left.rlike(r"(?i)(?:https?:|www\.|/|\.)\S*$")),
        "test_path": flag(path.rlike(r"(?i)(?:^|[/_.-])(?:tests?|spec|examples?|samples?|fixtures?|docs?|mock)(?:[/_.-]|$)")),
        "lock_path": flag(path.rlike(r"(?i)(?:\.lock|lock\.json|\.sum|\.min\.js|\.svg|\.map)$")),
        "config_path": flag(path.rlike(r"(?i)(?:\.env|\.ya?ml|\.ini|\.toml|\.properties|\.cfg|\.pem)$")),
    }


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Made findings with labels: match, left, right, path, form, label. Random parts come
    from hashes of the row number, forms from lists of true and false ones."""

    def sha(i: int) -> Column:
        return F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 256)

    def hexes(i: int, size: int) -> Column:
        return F.substring(sha(i), 1, size)

    def b64(i: int, size: int) -> Column:
        return F.substring(F.regexp_replace(F.base64(F.unhex(sha(i))), "[+/=]", "x"), 1, size)

    def word(i: int) -> Column:
        parts = F.array(*(F.lit(x) for x in DICTIONARY))
        return F.concat(*(F.get(parts, F.pmod(F.xxhash64("id", F.lit(10 * i + k)), F.lit(len(DICTIONARY))).cast("int")) for k in range(5)))

    j = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    cued = ['token = "', 'TOKEN = "', "api_key: ", 'secret = "', "password=", "password: ", "aws_access_key_id = ", "key: '", "auth_token: ", 'passwd: "', "private_key = ", "bearer ", "TOKEN="]
    plain, doubted = ["with ", "is ", "on ", "the ", "of ", "and ", "in ", '"'], ["commit ", "sha256: ", "md5 = ", "id: ", "version: ", "name = ", "note: ", "see https://a.example/", "build "]
    # (label, words before it, value): words are dealt at random, so that value and context are learned apart
    forms = [
        (1, cued, hexes(1, 40)), (1, cued, F.upper(hexes(1, 40))), (1, cued, hexes(1, 32)), (1, cued, b64(1, 32)), (1, cued, b64(1, 40)), (1, cued, j(b64(1, 9), "!", hexes(2, 3))), (1, cued, j(b64(1, 12), "#")), (1, cued, b64(1, 12)),
        (1, cued + plain, j("AKIA", F.upper(b64(1, 16)))), (1, cued + plain, j("ghp_", b64(1, 36))), (1, cued + plain, j("sk_live_", b64(1, 24))), (1, cued, j(b64(1, 20), "-", b64(2, 20))), (1, cued + plain, b64(1, 43)), (1, cued + plain, j(b64(1, 40), b64(2, 40))),
        (1, [""], F.lit("-----BEGIN RSA PRIVATE KEY-----")), (1, cued, hexes(1, 64)), (1, cued + plain, hexes(1, 48)),
        (0, plain + doubted, j(word(1), hexes(2, 1))), (0, plain + doubted, j(word(1), "_", word(2), "_1")), (0, plain + doubted, j(hexes(1, 8), "-", hexes(2, 4), "-", hexes(3, 4), "-", hexes(4, 4), "-", hexes(5, 12))),
        (0, doubted, hexes(1, 40)), (0, doubted, hexes(1, 64)), (0, doubted, hexes(1, 32)), (0, plain + doubted, j(word(1), "/", word(2), "/2024/01")), (0, doubted, b64(1, 20)),
        (0, plain + doubted, F.regexp_replace(hexes(1, 16), "[a-f]", "4")), (0, plain + doubted, F.regexp_replace(hexes(1, 20), "[a-f]", "7")), (0, cued, F.lit("your-token-here-1234")), (0, cued, F.lit("changeme12345678")),
        (0, cued + plain + doubted, j(word(1), "-", word(2))), (0, cued, F.lit("xxxxxxxxxxxxxxxx0000")), (0, plain + doubted, j(word(1), "-1-0-2")), (0, plain, j("2024-01-0", hexes(1, 1), "-", word(1))),
        (0, plain + doubted, j(word(1), "10")), (0, plain, j("----------------1", F.lit("---"))), (0, plain + doubted, j(F.initcap(word(1)), F.initcap(word(2)), "2")), (0, cued + doubted, j(word(1), "(", word(2), ")")),
        (0, doubted, j(b64(1, 27))), (0, doubted, b64(1, 43)), (0, doubted, j(b64(1, 16), "-", b64(2, 8))), (0, doubted, F.upper(b64(1, 24))), (1, cued, b64(1, 24)), (1, cued, j(b64(1, 8), "_", b64(2, 16))),
    ]

    def before(some: list[str], i: int) -> Column:
        return F.get(F.array(*(F.lit(x) for x in some)), F.pmod(F.xxhash64("id", F.lit(f"left{i}")), F.lit(len(some))).cast("int"))

    form = F.array(*(F.struct(F.lit(label).alias("label"), before(some, i).alias("left"), m.alias("match"), F.lit(i).alias("form")) for i, (label, some, m) in enumerate(forms)))
    paths = F.array(*(F.lit(p) for p in ("src/app.py", "web", "config/prod.env", "notes.md", "main.go", "tests/test_app.py", "package-lock.json", None, "src0")))
    path = F.get(paths, F.pmod(F.xxhash64("id", F.lit("path")), F.lit(9)).cast("int"))
    made = spark.range(n).withColumn("f", F.get(form, F.pmod(F.col("id"), F.lit(len(forms))).cast("int"))).withColumn("path", path)
    # the same token in a test or in a lock file is a false finding every second time
    off = path.rlike("^tests|lock") & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0) & ~F.col("f.match").startswith("-----")
    quote = F.regexp_extract("f.left", "[\"'`]$", 0)
    right = F.concat(quote, F.get(F.array(F.lit(" of"), F.lit(" "), F.lit(", and"), F.lit("\n")), F.pmod(F.xxhash64("id", F.lit("right")), F.lit(4)).cast("int")))
    return made.select("f.match", "f.left", right.alias("right"), "path", "f.form", F.when(off, 0.0).otherwise(F.col("f.label").cast("double")).alias("label"))


def fit(labelled: DataFrame, words: list[str] = ()):
    """The forest fitted on labelled findings. words: the corpus's own for the dictionary."""
    made = labelled.select("label", *(c.alias(n) for n, c in features(F.col("match"), F.col("left"), F.col("right"), F.col("path"), list(words)).items()))
    data = VectorAssembler(inputCols=[c for c in made.columns if c != "label"], outputCol="features").transform(made).coalesce(2)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=1, featureSubsetStrategy="onethird").fit(data)


def secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, labelled: DataFrame | None = None, words: list[str] | None = None) -> DataFrame:
    """One row per candidate: doc_id, start, end (code points, end exclusive), secret
    (the candidate's text), score, is_secret. words: the dictionary's, if not the most
    frequent ones of df."""
    words = dictionary(df, text) if words is None else words
    model = fit(labelled if labelled is not None else labelled_findings(df.sparkSession), words)
    t = F.col("text")
    where = F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")
    found = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), where.alias("path"))
    found = found.select("doc_id", "path", F.explode(F.when(t.rlike(NEED), candidates(t))).alias("x"))
    rows = found.select("doc_id", "path", "x.*")
    feats = features(F.col("match"), F.col("left"), F.col("right"), F.col("path"), words)
    rows = rows.select("doc_id", "start", "end", "match", *(c.alias(f"f_{n}") for n, c in feats.items()))
    vectors = VectorAssembler(inputCols=[f"f_{n}" for n in feats], outputCol="features").transform(rows)
    score = vector_to_array("probability")[1]
    scored = model.transform(vectors).select("doc_id", "start", "end", F.col("match").alias("secret"), score.alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD)
