"""Personal data: base rules, high-recall candidates, and boosted trees.

Base spans follow fixed patterns and checks and always stay. Generators then
propose overlapping spans with a high recall: of every run of number groups all
windows of groups with enough digits, each as a phone and as a card where the digits allow, and mail
addresses with spelled signs. Gradient-boosted trees, fitted on labelled texts, score
each proposal on its format and its context; per kind the lowest score with the
wanted precision on held-out texts is the threshold. Of accepted spans that overlap,
the best stays; spans over base spans go.

All of it is built-in expressions and Spark ML on the JVM: one pass over the texts
that leaves only spans, then work on proposals alone. Overlaps are settled per
cluster of overlapping spans, never over all spans of a text at once.

Defined cases: null and empty texts have no span; very long texts are read whole;
patterns use possessive repeats, so long runs don't recurse; equal rows get equal
spans; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerlane.llm.common import let, written
from offerlane.llm.spans import digits_of, luhn, matches, per_char

#: Kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
#: The fixed base patterns. Repeats are possessive where that changes no match;
#: a match of a run can only begin where the run does, or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*+(?:|[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Generators: mail addresses as written for people, and runs of number groups.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]{1,63}+)++"
RUN, GROUP = r"\(?[0-9](?:[ ./()-]{0,2}[0-9])*+", r"\(?[0-9]++"
#: Digits of a proposed phone and of a card, as their formats have them; they also bound the groups of a number.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (14, 19)
#: Labelled texts that are made for training; one in so many sets thresholds; precision wanted there; trees and depth.
FINDINGS, FOLD, PRECISION, TREES, DEPTH = 12000, 4, 0.98, 20, 6
CUES = {
    "phone": r"(?i)(?:tel|phone|fax|call|mobile|cell|téléphone|telefon|teléfono|whatsapp|(?:my|our|your|his|her) (?:number|no))(?: (?:me|us|at|on|is|the|under|to|now|number|no)\b)*[^A-Za-z0-9]*$",
    "card": r"(?i)(?:card|visa|mastercard|amex|carte|karte|tarjeta|cc)[^A-Za-z0-9]*$",
    "email": r"(?i)(?:mail|contact|e-mail|courriel|correo|write)[^A-Za-z0-9]*$",
    "number": r"(?i)(?:order|invoice|isbn|version|no|nr|id|ref|date|price|total|page|year|issn|doi)[^A-Za-z0-9]*$",
}
LEFT, RIGHT = 24, 8
#: Score of a base span among proposals: above any other.
BASE_SCORE = 2.0


def base_spans(text: Column) -> Column:
    """array<struct<start, k, end>> of the base spans by start and kind (k: place in KINDS)."""
    checks = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda m: F.when(F.length(digits_of(m)).between(14, 19), luhn(digits_of(m))).otherwise(False),
        "phone": lambda m: F.length(digits_of(m)).between(10, 15),
    }
    # what a text must contain to have a match at all
    need = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}
    parts = []
    for k, kind in enumerate(KINDS):
        parts.append(F.when(need[kind], _checked(matches(text, BASE[kind]), k, checks[kind])).otherwise(F.array().cast("array<struct<start:int,k:int,end:int>>")))
    return F.sort_array(F.concat(*parts))


def _checked(found: Column, k: int, check) -> Column:
    """The places of the matches that pass a check."""
    return F.transform(F.filter(found, lambda x: check(x["match"])), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))


#: A proposed span with its context and kind.
PROPOSAL = "array<struct<start:int,end:int,match:string,left:string,right:string,k:int>>"


def proposals(text: Column) -> Column:
    """array<struct<start, end, match, left, right, k>> of all proposed spans."""
    mail = F.transform(matches(text, MAIL, LEFT, RIGHT), lambda x: x.withField("k", F.lit(KINDS.index("email"))))
    runs = F.filter(matches(text, RUN, LEFT, RIGHT), lambda x: F.length(digits_of(x["match"])) >= PHONE_DIGITS[0])
    numbers = F.flatten(F.transform(runs, _windows))
    none = F.array().cast(PROPOSAL)
    some_mail = F.when(text.rlike("@|[(\\[{]at[)\\]}]"), mail).otherwise(none)
    return F.concat(some_mail, F.when(text.rlike(rf"[0-9](?:[ ./()-]{{0,2}}[0-9]){{{PHONE_DIGITS[0] - 1}}}"), numbers).otherwise(none))


def _windows(run: Column) -> Column:
    """The windows of a run's groups, each as a phone and as a card."""

    def window(g: Column, i: Column, j: Column, k: int) -> Column:
        own = F.slice(g, i + 1, j - i)
        match = F.concat(F.array_join(F.transform(own, lambda x: F.concat(x["match"], x["right"])), ""), F.get(g, j)["match"])
        return F.struct(
            (run["start"] + F.get(g, i)["start"]).alias("start"), (run["start"] + F.get(g, j)["end"]).alias("end"), match.alias("match"),
            F.when(i == 0, run["left"]).otherwise(F.get(g, i)["left"]).alias("left"),
            F.when(j == F.size(g) - 1, run["right"]).otherwise(F.left(F.concat(F.get(g, j)["right"], F.get(g, j + 1)["match"]), F.lit(RIGHT))).alias("right"),
            F.lit(k).alias("k"),
        )

    def of_kind(g: Column, n: Column, k: int, digits: tuple[int, int]) -> Column:
        # a group has a digit at least, so a window has no more groups than digits
        last = lambda i: F.sequence(i, F.least(i + digits[1], F.size(g)) - 1)
        count = lambda i, j: F.aggregate(F.slice(n, i + 1, j - i + 1), F.lit(0), lambda a, b: a + b)
        ends = lambda i: F.filter(last(i), lambda j: count(i, j).between(*digits))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.transform(ends(i), lambda j: window(g, i, j, k))))

    kinds = ((KINDS.index("phone"), PHONE_DIGITS), (KINDS.index("card"), CARD_DIGITS))
    lengths = lambda g: F.transform(g, lambda x: F.length(digits_of(x["match"])))
    return let(matches(run["match"], GROUP, LEFT, 2, through=True), lambda g: let(lengths(g), lambda n: F.concat(*(of_kind(g, n, *x) for x in kinds))))


def features(match: Column, left: Column, right: Column, k: Column) -> dict[str, Column]:
    """Format and context of a proposed span as numbers."""
    d = digits_of(match)
    n = F.length(d)
    flag = lambda c: c.cast("double")
    groups = F.filter(F.split(match, "[^0-9]+"), lambda x: x != "")
    return {
        "kind": k.cast("double"),
        "n_digits": n.cast("double"),
        "n_groups": F.size(groups).cast("double"),
        "first_group": F.coalesce(F.length(F.get(groups, F.lit(0))), F.lit(0)).cast("double"),
        "last_group": F.coalesce(F.length(F.get(groups, F.size(groups) - 1)), F.lit(0)).cast("double"),
        "even_groups": flag(F.size(F.array_distinct(F.transform(groups, F.length))) == 1),
        "luhn": flag(F.when(n.between(12, 19), luhn(d)).otherwise(False)),
        "dots": per_char(match, r"\."),
        "dashes": per_char(match, "-"),
        "slashes": per_char(match, "/"),
        "brackets": per_char(match, "[(]"),
        "letters": per_char(match, "[A-Za-z]"),
        "spelled": flag(match.rlike(r"[(\[{](?:at|dot)[)\]}]")),
        "zero_first": flag(match.startswith("0")),
        "plus_before": flag(left.endswith("+")),
        "seps": F.size(F.array_distinct(F.regexp_extract_all(match, F.lit("(?<=[0-9])[^0-9]+(?=[0-9])"), F.lit(0)))).cast("double"),
        "shortest_group": F.coalesce(F.array_min(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "sign_before": flag(left.rlike(r"[0-9][./-]$")),
        "sign_after": flag(right.rlike(r"^[./-][0-9]")),
        "number_before": flag(left.rlike(r"[0-9][ ()]{1,2}$")),
        "number_after": flag(right.rlike(r"^[ ()]{1,2}[0-9]")),
        "closed": flag(match.contains("(") == match.contains(")")),
        "word_before": flag(left.rlike(r"[\p{L}_=:#$€]$")),
        "word_after": flag(right.rlike(r"^[\p{L}0-9_%€$]")),
        **{f"cue_{c}": flag(left.rlike(p)) for c, p in CUES.items()},
    }


def labelled_texts(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Made texts with their personal data: text, spans (array<struct<start, end, k>>),
    form (which of the ways to write a value), held_out. A text has one or two values of a form, at times after a number that has
    nothing to do with them. Values come from hashes of the row number."""

    def digits(i: int, size: int) -> Column:
        return F.substring(F.lpad(F.abs(F.xxhash64("id", F.lit(i))).cast("string"), 19, "7"), 2, size)

    def word(i: int) -> Column:
        return F.translate(F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"w{i}")), 256), 1, 6), "0123456789", "ostnrlaeiu")

    def card_digits(size: int, off: int = 0) -> Column:
        """Digits whose check digit is right, or off by a number."""
        head = digits(1, size - 1)
        short = F.aggregate(
            F.sequence(F.lit(1), F.length(head)),
            F.lit(0),
            lambda t, i: t + F.when((F.length(head) - i) % 2 == 0, (F.substring(head, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(head, i, F.lit(1)).cast("int") / 5)).otherwise(F.substring(head, i, F.lit(1)).cast("int")).cast("int"),
        )
        return F.concat(head, ((10 + off - short % 10) % 10).cast("string"))

    def grouped(x: Column, sep: str) -> Column:
        return F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{sep}")

    a3, b3, c4, d2, e2 = digits(1, 3), digits(2, 3), digits(3, 4), digits(4, 2), digits(5, 2)
    j = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    phone, card, mail = KINDS.index("phone"), KINDS.index("card"), KINDS.index("email")
    d7, e7, f7 = digits(7, 2), digits(8, 2), digits(9, 2)
    # (kind, whether it is personal, value); the words before are dealt at random, so that format and context are learned apart
    forms = [
        (phone, 1, j("(", a3, ") ", b3, "-", c4)), (phone, 1, j(a3, "-", b3, "-", c4)), (phone, 1, j(a3, ".", b3, ".", c4)), (phone, 1, j(a3, " ", b3, " ", c4)),
        (phone, 1, j("0", d2, " ", b3, " ", e2, " ", digits(6, 2))), (phone, 1, j("0", digits(6, 1), " ", d2, " ", e2, " ", digits(7, 2), " ", digits(8, 2))),
        (phone, 1, j("0", d2, "/", digits(6, 7))), (phone, 1, j("0", a3, "-", digits(6, 7))), (phone, 1, j("1-8", d2, "-", b3, "-", c4)), (phone, 1, j("(", a3, ")", b3, "-", c4)),
        (phone, 1, j("0", digits(6, 1), ".", d2, ".", e2, ".", digits(7, 2), ".", digits(8, 2))), (phone, 1, j("(0", d2, ") ", b3, " ", c4)), (phone, 1, j("00", d2, " ", a3, " ", b3, " ", c4)),
        (phone, 1, j("00 ", d2, " ", digits(6, 1), " ", e2, " ", d7, " ", e7, " ", f7)), (phone, 1, j("00", d2, " ", digits(6, 1), " ", e2, " ", d7, " ", e7, " ", f7)), (phone, 1, j("00", d2, "-", digits(6, 2), "-", digits(7, 7))),
        (phone, 1, j(d2, ".", e2, ".", d7, ".", e7, ".", f7)), (phone, 1, j("0", digits(6, 3), " ", digits(7, 6))), (phone, 1, j(a3, "-", c4)), (phone, 1, j("(", d2, ") ", c4, "-", digits(5, 4))), (phone, 1, j("0", d2, "-", digits(6, 4), "-", digits(7, 4))),
        (phone, 0, j("19", d2, "-", "20", e2)), (phone, 0, j("20", d2, "-0", digits(4, 1), "-1", digits(5, 1))),
        (phone, 0, j("978-", digits(1, 1), "-", digits(2, 4), "-", digits(3, 4), "-", digits(4, 1))), (phone, 0, j(digits(1, 1), ".", d2, ".", digits(3, 5))), (phone, 0, digits(1, 16)),
        (phone, 0, j(a3, ".", b3, ".", d2, ".", e2)), (phone, 0, j(a3, ".", b3, ".", digits(3, 3))), (phone, 0, j(d2, "/", e2, "/20", digits(6, 2))), (phone, 0, j(c4, "-", digits(5, 4))),
        (phone, 0, j("20", d2, "-0", digits(4, 1), "-1", digits(5, 1), " 1", digits(6, 1), ".", e2)), (phone, 0, j(d2, " ", e2, " ", digits(6, 2), " ", digits(7, 2))), (phone, 0, j(a3, " ", b3, " ", digits(6, 3), " ", digits(7, 3))),
        (card, 1, grouped(card_digits(16), ".")), (card, 1, grouped(card_digits(16), "/")), (card, 1, grouped(card_digits(16), "  ")), (card, 1, grouped(card_digits(15), ".")),
        (card, 0, digits(1, 15)), (card, 0, grouped(card_digits(16, 3), "-")), (card, 0, digits(1, 12)), (card, 0, grouped(card_digits(16, 3), " ")), (card, 0, digits(1, 18)), (card, 0, grouped(card_digits(16, 3), ".")), (card, 0, grouped(card_digits(16, 3), "/")),
        (mail, 1, j(word(1), "(at)", word(2), ".com")), (mail, 1, j(word(1), " [at] ", word(2), " [dot] org")), (mail, 1, j(word(1), ".", word(2), "@", word(3), ".net")), (mail, 1, j(word(1), " (at) ", word(2), " (dot) de")), (mail, 1, j(word(1), "{at}", word(2), "{dot}eu")),
        (mail, 0, j(word(1), " @ ", word(2), ". ", word(3))), (mail, 0, j(word(1), "@ ", word(2), ".", word(3))), (mail, 0, j(word(1), " @", word(2), " .", word(3))),
    ]
    plain = ["the ", "of ", "and ", "is ", "at ", "in ", "to "]
    cues = {phone: ["call ", "call me at ", "phone: ", "tel. ", "mobile ", "telefon: ", "my number is ", "fax ", "phone number: "], card: ["card: ", "visa ", "cc ", "carte: "], mail: ["mail ", "contact ", "write "]}
    numbers = ["order no ", "isbn ", "version ", "id ", "ref ", "date: ", "total ", "pages "]
    # the same digits are a phone after a cue, and a number after another word
    bare = [digits(1, 10), digits(1, 11), digits(1, 9), digits(1, 8), j(a3, " ", b3, " ", digits(6, 3)), j("0", digits(1, 9)), j("00", digits(1, 11)), j(d2, " ", e2, " ", d7, " ", e7, " ", f7)]
    forms += [(phone, label, x, own) for x in bare for label, own in ((1, cues[phone]), (0, plain + numbers))]
    lefts = {(k, label): plain + (cues[k] if label else numbers + [c for other in cues if other != k for c in cues[other]]) for k in cues for label in (0, 1)}

    def dealt(some: list, key: str) -> Column:
        return F.get(F.array(*(F.lit(x) for x in some)), F.pmod(F.xxhash64("id", F.lit(key)), F.lit(len(some))).cast("int"))

    form = F.array(*(F.struct(F.lit(i).alias("form"), F.lit(k).alias("k"), F.lit(label).alias("label"), dealt(own[0] if own else lefts[k, label], f"before{i}").alias("left"), match.alias("match")) for i, (k, label, match, *own) in enumerate(forms)))
    stray = F.concat(dealt(["2024", "12", "3", "1999", "100", "7"], "stray"), F.lit(" "))
    made = spark.range(n).withColumn("f", F.get(form, F.pmod(F.col("id"), F.lit(len(forms))).cast("int")))
    made = made.withColumn("left", F.concat("f.left", F.when(F.pmod(F.xxhash64("id", F.lit("stray?")), F.lit(4)) == 0, stray).otherwise("")))
    made = made.withColumn("between", dealt([" ", ", ", " or ", " / "], "between")).withColumn("twice", F.pmod(F.xxhash64("id", F.lit("twice?")), F.lit(4)) == 0)
    size, first = F.char_length("f.match"), F.char_length("left")
    second = first + size + F.char_length("between")
    span = lambda at: F.struct(at.alias("start"), (at + size).alias("end"), F.col("f.k").alias("k"))
    spans = F.when(F.col("f.label") == 0, F.array().cast("array<struct<start:int,end:int,k:int>>")).when(F.col("twice"), F.array(span(first), span(second))).otherwise(F.array(span(first)))
    text = F.concat("left", "f.match", F.when(F.col("twice"), F.concat("between", "f.match")).otherwise(""), dealt([" ", ".", " ok", ", and"], "after"))
    return made.select(text.alias("text"), spans.alias("spans"), "f.form", (F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLD)) == 0).alias("held_out"))


def labelled_proposals(labelled: DataFrame) -> DataFrame:
    """The proposals of labelled texts, right where they are just a labelled span: label, held_out and features."""
    rows = labelled.select("spans", "held_out", F.explode(proposals(F.col("text"))).alias("x")).select("spans", "held_out", "x.*")
    label = F.exists("spans", lambda y: (y["start"] == F.col("start")) & (y["end"] == F.col("end")) & (y["k"] == F.col("k")))
    return rows.select(label.cast("double").alias("label"), "held_out", "k", *(c.alias(n) for n, c in features(F.col("match"), F.col("left"), F.col("right"), F.col("k")).items()))


def fit(labelled: DataFrame):
    """(model, thresholds): trees fitted on the proposals of labelled texts that are not
    held out, and on those held out the lowest score of each kind from which PRECISION holds."""
    made = labelled_proposals(labelled)
    names = [c for c in made.columns if c not in ("label", "held_out", "k")]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(made).coalesce(2).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(data.filter(~F.col("held_out")))
    held = model.transform(data.filter("held_out")).select("k", "label", F.round(vector_to_array("probability")[1], 6).alias("p"))
    right = F.sum("n_right").over(Window.partitionBy("k").orderBy(F.col("p").desc()))
    total = F.sum("n").over(Window.partitionBy("k").orderBy(F.col("p").desc()))
    steps = held.groupBy("k", "p").agg(F.count("*").alias("n"), F.sum("label").alias("n_right"))
    least = steps.select("k", "p", (right / total).alias("precision")).filter(F.col("precision") >= PRECISION).groupBy("k").agg(F.min("p").alias("p"))
    thresholds = {r["k"]: max(0.5, r["p"]) for r in least.collect()}  # a row per kind
    data.unpersist()
    return model, thresholds


def personal_data(df: DataFrame, text: str = "text", doc_id: str = "doc_id", labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, base (base spans), spans (all spans), as arrays of struct<start, k, end>.
    labelled: texts with their spans, as labelled_texts() makes them."""
    model, thresholds = fit(labelled if labelled is not None else labelled_texts(df.sparkSession))
    t = F.col("text")
    found = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = found.select("doc_id", F.xxhash64("text").alias("tie"), base_spans(t).alias("base"), proposals(t).alias("proposed"))
    found = written(found, "spans")

    rows = found.filter(F.size("proposed") > 0).select("doc_id", "tie", F.explode("proposed").alias("x")).select("doc_id", "tie", "x.*")
    rows = rows.select("doc_id", "tie", "start", "end", "k", *(c.alias(n) for n, c in features(F.col("match"), F.col("left"), F.col("right"), F.col("k")).items()))
    names = [c for c in rows.columns if c not in ("doc_id", "tie", "start", "end", "k")]
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    least = F.coalesce(*(F.when(F.col("k") == k, F.lit(float(v))) for k, v in thresholds.items()), F.lit(1.1))
    scored = scored.select("doc_id", "tie", "start", "k", "end", vector_to_array("probability")[1].alias("p")).filter(F.col("p") >= least)
    fixed = found.filter(F.size("proposed") > 0).select("doc_id", "tie", F.explode("base").alias("x")).select("doc_id", "tie", "x.*", F.lit(BASE_SCORE).alias("p"))
    added = _best(scored.unionByName(fixed)).groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("taken")).alias("added"))

    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    added = added.select(F.col("doc_id").alias("added_id"), F.col("tie").alias("added_tie"), "added")
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("tie") == F.col("added_tie")), "left")
    return joined.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", none))).alias("spans"))


def _best(spans: DataFrame) -> DataFrame:
    """spans: doc_id, tie, start, k, end, p. Per cluster of overlapping spans those that
    are taken (array<struct<start, k, end>>): best first, of equal ones the first; one goes
    if it overlaps one already taken. Base spans take their place but aren't listed."""
    before = Window.partitionBy("doc_id", "tie").orderBy("start", "end", "k").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = spans.withColumn("opens", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("long"))
    rows = rows.withColumn("cluster", F.sum("opens").over(upto))
    best = F.sort_array(F.collect_set(F.struct((-F.col("p")).alias("p"), "start", "k", "end")))
    none = F.array().cast("array<struct<p:double,start:int,k:int,end:int>>")
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    take = lambda acc, x: F.when((x["p"] == -BASE_SCORE) | free(acc, x), F.array_append(acc, x)).otherwise(acc)
    taken = F.filter(F.aggregate("best", none, take), lambda x: x["p"] > -BASE_SCORE)
    taken = F.transform(taken, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    return rows.groupBy("doc_id", "tie", "cluster").agg(best.alias("best")).select("doc_id", "tie", taken.alias("taken"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and the list of all spans."""
    counts = [_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
