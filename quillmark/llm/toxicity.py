"""Toxicity by multiple-instance learning with a noisy-or.

A document is a bag of sentences. Each sentence has a logistic score from its
words and word beginnings; the document is toxic unless every sentence is
clean: 1 - prod(1 - p). Only documents carry labels; the noisy-or passes their
gradient to the sentences that explain them, so the fitted model also says
which sentences offend.

Training runs on the driver over a bounded sample (``per_class`` labelled texts
of each class, chosen by a hash of id and text). Scoring reads whole texts
where they lie and shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import map_texts, row_hash, training_sample

#: Training takes at most so many labelled texts of each class, and so many characters of one.
PER_CLASS, TRAINING_CHARS = 2000, 20_000
#: A feature is kept if so many sampled documents hold it and toxic ones hold it
#: more often by so many standard errors, which chance rarely brings about even
#: among a million features. At most so many are kept.
MIN_DOCS, MIN_Z, FEATURES = 4, 5.0, 6000
THRESHOLD = 0.7
#: A sentence offends from this probability on.
SENTENCE = 0.5
PREFIXES = range(3, 8)
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_CACHE = 400_000


def features(word: str) -> list[str]:
    """The word, and its beginnings, which inflected and compound forms share."""
    return [word] + [f"^{word[:n]}" for n in PREFIXES if n <= len(word)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    cache: dict[str, float] = field(default_factory=dict)

    def word(self, w: str) -> float:
        got = self.cache.get(w)
        if got is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            got = self.cache[w] = sum(self.weights.get(f, 0.0) for f in features(w))
        return got

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, stop and logit of each sentence."""
        known, word = self.cache, self.word
        for s in _SENTENCE.finditer(text):
            z = self.bias
            for w in _WORD.findall(s[0].lower()):
                z += known[w] if w in known else word(w)
            yield s.start(), s.end(), z

    def score(self, text: str | None) -> float:
        """The noisy-or; with no sentence, what one empty sentence would get."""
        z = np.array([x for _, _, x in self.sentences(text or "")] or [self.bias])
        return float(-np.expm1(-np.logaddexp(0, z).sum()))


def train(texts: list[str], labels: list[int], epochs: int = 150, l2: float = 0.02) -> Model:
    """Maximum likelihood of the document labels under the noisy-or, by AdaGrad."""
    y = np.array(labels, bool)
    if not len(y) or y.all() or not y.any():
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Model({}, float(np.log(p / (1 - p))))
    words = [[_WORD.findall(s[0].lower()) for s in _SENTENCE.finditer(t)] or [[]] for t in texts]
    seen = (Counter(), Counter())
    for bag, label in zip(words, y.tolist(), strict=True):
        seen[label].update({f for s in bag for w in set(s) for f in features(w)})
    n1, n0 = max(1, y.sum()), max(1, (~y).sum())

    def z(f: str) -> float:
        a, b = seen[1][f], seen[0][f]
        p = (a + b) / (n0 + n1)
        return (a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1) + 1e-12)

    common = {f: z(f) for f in seen[1].keys() | seen[0].keys() if seen[1][f] + seen[0][f] >= MIN_DOCS}
    kept = sorted((f for f in common if common[f] >= MIN_Z), key=lambda f: (-common[f], f))[:FEATURES]
    index = {f: i for i, f in enumerate(kept)}
    cols, rows, doc_of = [], [], []
    for d, bag in enumerate(words):
        for s in bag:
            ids = {index[f] for w in set(s) for f in features(w) if f in index}
            cols += ids
            rows += [len(doc_of)] * len(ids)
            doc_of.append(d)
    cols, rows, doc_of = np.array(cols, np.int64), np.array(rows, np.int64), np.array(doc_of, np.int64)
    w, bias = np.zeros(len(kept)), -5.0
    gw2, gb2 = np.full(len(kept), 1e-8), 1e-8
    weight = np.where(y, 0.5 / n1, 0.5 / n0)
    for _ in range(epochs):
        logit = np.bincount(rows, w[cols], len(doc_of)) + bias
        clean = np.bincount(doc_of, np.logaddexp(0, logit), len(y))  # -log P(no sentence offends)
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        outer = np.where(y, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0) * weight
        g = outer[doc_of] * p
        gw, gb = np.bincount(cols, g[rows], len(kept)) + l2 * w / len(y), g.sum()
        gw2 += gw * gw
        gb2 += gb * gb
        w -= 0.5 * gw / np.sqrt(gw2)
        bias -= 0.2 * gb / np.sqrt(gb2)
    return Model({f: float(v) for f, v in zip(kept, w, strict=True) if abs(v) > 1e-3}, float(bias))


def sample(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS) -> DataFrame:
    """``text, label`` of a bounded sample of the labelled documents that ``learn`` admits: at most ``per_class`` texts a class."""
    known = labels.where(learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("h", row_hash("doc_id", "text"))
    return training_sample(rows.select("h", "text"), rows.select("doc_id", "h").join(known, "doc_id"), per_class, TRAINING_CHARS)


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids of the test fold, and for null ids, which are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    got = sample(docs, labels, ~held_out(), per_class).toPandas().sort_values(["label", "text"])
    return train(got["text"].tolist(), got["label"].astype(int).tolist())


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", sentence_threshold: float = SENTENCE) -> DataFrame:
    """``doc_id, score, worst_start, worst_stop, offending``: the noisy-or, its likeliest sentence, and all that offend.

    Spans count characters; the worst is null if the text has no sentence.
    ``offending`` holds start, stop and probability of each sentence whose own
    probability is at least ``sentence_threshold``, in order. A null or empty
    text gets the score of one empty sentence. Of equal sentences the first
    counts. Repeated rows are scored each; other columns are not read.
    """
    least = float(np.log(sentence_threshold / (1 - sentence_threshold)))

    def run(texts: list[str | None]) -> list[list]:
        score, starts, stops, offending = [], [], [], []
        for t in texts:
            found = list(model.sentences(t or ""))
            z = np.array([x[2] for x in found] or [model.bias])
            score.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
            span = found[int(z.argmax())] if found else (None, None)
            starts.append(span[0])
            stops.append(span[1])
            offending.append([{"start": a, "stop": b, "p": float(1 / (1 + np.exp(-x)))} for a, b, x in found if x >= least])
        return [score, starts, stops, offending]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, [("score", pa.float64()), ("worst_start", pa.int64()), ("worst_stop", pa.int64()), ("offending", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())])))])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_stop", F.size("offending").cast("long").alias("n_offending"))
