"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences. A sentence's score is a logistic function of
the weights of its words (each word: itself and its first letters); a document's
score is the noisy-or of its sentences: 1 - prod(1 - p). Weights are learned from
document labels only, by gradient descent on the likelihood of that noisy-or, and
so say which sentences offend.

Training takes a bounded sample of labelled documents (MAX_TOXIC and MAX_CLEAN, by
hash of the id), a fifth of which sets the threshold, and runs as one task; only
weights come back. The rest is one pass over all documents in Arrow batches.

Defined cases: null and empty texts have no sentence and get the bias alone; very
long texts are scored whole; repeated rows score alike; null ids are not held out
and never train; null labels never train; without both classes in the sample all
scores are 0; other columns are not read.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents of each class that training takes, and most code points of such a document: longer ones
#: are scored like any other but not learned from, so the one task that trains holds a bounded sample.
MAX_TOXIC, MAX_CLEAN, MAX_TEXT = 2000, 4000, 100_000
#: Code points of all texts together that weights are learned from; further texts of the sample are left out.
MOST_CHARS = 80_000_000
#: A document counts as toxic from this score on.
THRESHOLD = 0.7
#: Lengths of word beginnings that are features; least training documents of a feature; steps and rate of the descent.
BEGINNINGS, LEAST, STEPS, RATE = (4, 5, 6), 3, 200, 0.3
#: A feature gets a weight only if its pull is that of more than so many documents.
PULL = 3.0
#: Weights below this share of the largest go; the rest is then learned again without that bar.
SHARE = 0.15
#: Words remembered by a task.
REMEMBERED = 1 << 20
_END, _EDGE = 1000.0, "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "¡¿«»“”„’…"


def held_out(doc_id):
    """Documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(word: str) -> list[str]:
    bare = word.strip(_EDGE).lower()
    return [bare, *(f"{bare[:n]}*" for n in BEGINNINGS if len(bare) >= n)] if bare else []


def _words(text: str | None) -> list[str]:
    """White-space words; a line end is a word that ends a sentence."""
    return (text or "").replace("\n", " . ").split()


def _ends(word: str) -> bool:
    return word[-1] in ".!?"


class _Seen(dict):
    """The weight of each word met so far, plus _END if the word ends a sentence."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        w = min(50.0, sum(get(f, 0.0) for f in features(word)))
        found = self[word] = max(-50.0, w) + (_END if _ends(word) else 0.0)
        return found


class Model:
    def __init__(self, weights: dict[str, float], bias: float, cut: float):
        self.weights, self.bias, self.cut = weights, bias, cut
        self.seen = _Seen(weights)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cut": self.cut}

    def __setstate__(self, state):
        self.__init__(**state)

    def sentences(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score, first word) of each sentence."""
        if not words:
            return np.zeros(0), np.zeros(0, int)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        value = np.fromiter(map(self.seen.__getitem__, words), np.float64, len(words))
        end = value > _END / 2
        value[end] -= _END
        first = np.flatnonzero(np.concatenate(([True], end[:-1])))
        z = np.full(len(first), self.bias)
        at = np.flatnonzero(value)
        if len(at):  # a word counts once per sentence
            of = np.searchsorted(first, at, side="right") - 1
            once = dict.fromkeys(zip(of.tolist(), map(words.__getitem__, at.tolist())))
            for k, w in once:
                x = self.seen[w]
                z[k] += x - _END if x > _END / 2 else x
        return 1 / (1 + np.exp(-np.clip(z, -60, 60))), first

    def score(self, p: np.ndarray) -> float:
        """Noisy-or of sentence scores, set so that the cut is at THRESHOLD."""
        if self.cut >= 1:
            return 0.0
        found = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()) if len(p) else 1 / (1 + np.exp(-self.bias))
        if found < self.cut:
            return float(THRESHOLD * found / self.cut)
        return float(THRESHOLD + (1 - THRESHOLD) * (found - self.cut) / (1 - self.cut))


def train(texts: list[str], toxic: np.ndarray, clean_share: float | None = None) -> Model:
    """The model learned from whole texts and 0/1 labels. clean_share: share of
    clean documents where the model will be used, else that of the texts."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model({}, 0.0, 1.0)
    for_cut = np.arange(len(texts)) % 5 == 4
    fit = ~for_cut if toxic[~for_cut].any() and not toxic[~for_cut].all() else np.ones(len(texts), bool)

    # texts in order up to MOST_CHARS in all, and one of either class at least
    within = np.cumsum([len(t or "") if use else 0 for t, use in zip(texts, fit)]) <= MOST_CHARS
    for of in (toxic, ~toxic):
        within[np.flatnonzero(of & fit)[0]] = True
    fit &= within

    number: dict[str, int] = {}
    feature: dict[str, int] = {}
    word_features: list[list[int]] = []
    words, sentence, doc_of = array("q"), array("q"), array("q")
    for d, text in enumerate(t for t, use in zip(texts, fit) if use):
        new = True
        for w in _words(text):
            if new:
                doc_of.append(d)
                new = False
            k = number.get(w)
            if k is None:
                k = number[w] = len(number)
                word_features.append([feature.setdefault(f, len(feature)) for f in features(w)])
            words.append(k)
            sentence.append(len(doc_of) - 1)
            new = _ends(w)
    words, sentence, doc_of = np.array(words, np.int64), np.array(sentence, np.int64), np.array(doc_of, np.int64)
    y = toxic[fit]
    n_docs, n_sent, n_words, n_feat = len(y), len(doc_of), len(number), len(feature)

    # distinct (sentence, word) pairs, and (word, feature) pairs, only of features in enough documents
    key = np.unique(sentence * n_words + words)
    s_of, w_of = key // n_words, key % n_words
    pair_w = np.repeat(np.arange(n_words), [len(f) for f in word_features])
    pair_f = np.array([f for own in word_features for f in own], np.int64)
    word_docs = np.unique(doc_of[s_of] * n_words + w_of) % n_words
    in_docs = np.bincount(pair_f, np.bincount(word_docs, minlength=n_words)[pair_w], minlength=n_feat)
    use = in_docs[pair_f] >= LEAST
    pair_w, pair_f = pair_w[use], pair_f[use]

    w, bias = np.zeros(n_feat), -8.0
    square, square_bias = np.full(n_feat, 1e-4), 1e-4
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()) * n_docs
    def descend(pull_least: float) -> None:
        nonlocal w, bias, square, square_bias
        for _ in range(STEPS):
            theta = np.bincount(pair_w, w[pair_f], minlength=n_words)
            z = np.bincount(s_of, theta[w_of], minlength=n_sent) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            rest = np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs))
            pull = np.where(y, -rest / np.maximum(1 - rest, 1e-12), 1.0) * weight
            gz = pull[doc_of] * p
            g = np.bincount(pair_f, np.bincount(w_of, gz[s_of], minlength=n_words)[pair_w], minlength=n_feat) / n_docs
            gb = gz.sum() / n_docs
            square += g * g
            square_bias += gb * gb
            rate = RATE / np.sqrt(square)
            w -= rate * g
            w = np.sign(w) * np.maximum(np.abs(w) - rate * pull_least / n_docs, 0.0)
            bias -= 0.1 * gb / np.sqrt(square_bias)

    descend(PULL)
    large = np.abs(w) >= SHARE * np.abs(w).max(initial=0.0)
    use = large[pair_f] & (w[pair_f] != 0)
    pair_w, pair_f = pair_w[use], pair_f[use]
    w = np.where(large, w, 0.0)
    # words without a feature left, most of all, need no further look
    known = np.isin(w_of, pair_w)
    s_of, w_of = s_of[known], w_of[known]
    descend(0.2 * PULL)
    names = list(feature)
    model = Model({names[k]: float(w[k]) for k in np.flatnonzero(w)}, float(bias), 0.5)

    # the cut with fewest wrong documents on the fifth, classes weighed as where the model is used
    check = for_cut if toxic[for_cut].any() else np.ones(len(texts), bool)
    raw = np.array([1 - np.exp(np.log1p(-np.minimum(model.sentences(_words(t))[0], 1 - 1e-12)).sum()) for t, use in zip(texts, check) if use])
    truth = toxic[check]
    cuts = np.unique(np.clip(np.concatenate((raw, [0.5])), 1e-6, 1 - 1e-6))
    cuts = (cuts[:-1] + cuts[1:]) / 2 if len(cuts) > 1 else cuts
    clean = 1.0 if clean_share is None or truth.all() else clean_share / (1 - clean_share) * truth.sum() / (~truth).sum()
    bad, good = np.sort(raw[~truth]), np.sort(raw[truth])
    wrong = clean * (len(bad) - np.searchsorted(bad, cuts)) + np.searchsorted(good, cuts)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    ends = np.clip(cuts[best[[0, -1]]], 1e-6, 1 - 1e-6)
    model.cut = float(1 / (1 + np.exp(-np.log(ends / (1 - ends)).mean())))  # amid the best, on the scale of sentence sums
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> Model:
    """The model learned from at most MAX_TOXIC + MAX_CLEAN labelled documents that are not held out."""
    known = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{toxic}`").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    some = [known.filter(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    picked = F.broadcast(some[0].unionByName(some[1]))  # bounded by the two limits
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = min(max(counts.get(0, 0) / max(1, sum(counts.values())), 0.01), 0.99)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "toxic", "text"], kind="stable").sample(frac=1, random_state=0)
        model = train(pdf["text"].tolist(), pdf["toxic"].to_numpy() == 1, share)
        return pd.DataFrame([("", model.bias, model.cut), *((k, w, 0.0) for k, w in model.weights.items())], columns=["name", "weight", "cut"])

    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # one text per labelled id, however often it occurs, so what the task learns from is bounded
    sample = texts.join(picked, "doc_id").filter(F.coalesce(F.char_length("text"), F.lit(0)) <= MAX_TEXT)
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).withColumn("all", F.lit(0))
    rows = sample.groupBy("all").applyInPandas(learn, "name string, weight double, cut double").collect()  # one per feature with a weight
    head = [r for r in rows if r["name"] == ""]
    return Model({r["name"]: r["weight"] for r in rows if r["name"]}, head[0]["weight"], head[0]["cut"]) if head else Model({}, 0.0, 1.0)


def scored(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, worst: of toxic documents
    the number of sentences that alone pass the cut, and the sentence with the highest score."""

    @F.pandas_udf("score double, n_offending long, worst string")
    def judge(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = _words(t)
            p, first = model.sentences(words)
            s = model.score(p)
            if s >= THRESHOLD and len(p):
                k = int(p.argmax())
                end = first[k + 1] if k + 1 < len(first) else len(words)
                out.append((s, max(1, int((p >= model.cut).sum())), " ".join(words[first[k] : end])))
            else:
                out.append((s, 0, None))
        return pd.DataFrame(out, columns=["score", "n_offending", "worst"])

    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), judge(F.col(f"`{text}`")).alias("s"))
    return picked.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score"), (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("s.n_offending"), F.col("s.worst"))
