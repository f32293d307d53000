"""Language ID with error-correcting output codes.

Each language has a codeword. One logistic classifier per bit, over hashed
character n-grams, predicts that bit; decoding weighs every bit's logistic loss
by how well the bit did in training and takes the language whose codeword costs
least. A small gap to the runner-up marks the document as ambiguous.

Training runs on the driver over a bounded sample (``per_language`` texts of
each language, chosen by a hash of id and text); scoring reads whole texts where
they lie and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import map_texts, row_hash, training_sample

UNKNOWN = "und"
#: Training takes at most so many texts of each language and of all together, and so many characters of one.
#: Its matrix has 160 KB for each text, 256 MB for all.
PER_LANGUAGE, TRAINING, TRAINING_CHARS = 200, 1600, 20_000
#: Labels that are learned at most: the most frequent ones, of equally frequent ones those that sort first.
LABELS = 800
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.6
_LETTER = regex.compile(r"\p{L}")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Lower-case letter of a character of the basic plane, or a space.
_FOLD = np.array([ord(x) if len(x := chr(i).lower()) == 1 and x.isalpha() else i if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """All 2^(n-1) - 1 splits of up to 6 languages; beyond that, random ones far apart."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        cols = np.arange(2 ** (n - 1) - 1)  # without the split that has all on one side
        return np.array([[1] * len(cols)] + [[1 if c >> k & 1 else -1 for c in cols] for k in range(n - 1)], np.int8)
    rng, best, bits = np.random.default_rng(seed), (0, None), int(np.ceil(10 * np.log2(n)))
    for _ in range(200 if n <= 200 else 5):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        f = m.astype(np.float32)
        apart = ((bits - f @ f.T) / 2 + np.eye(n, dtype=np.float32) * bits).min()
        if apart > best[0] and (np.abs(m.sum(0)) < n).all():
            best = (apart, m)
    return best[1]


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams of the letters of a text, case folded."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < len(_FOLD), _FOLD[np.minimum(c, len(_FOLD) - 1)], c)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # runs of what is no letter become one space
    out, h = [], np.zeros(len(c), np.uint32)
    for k in ORDERS:
        if len(c) < k:
            break
        h = (h[: len(c) - k + 1] + c[k - 1 :]) * _MIX[k - 1]
        out.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out)


def _mean_weights(g: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if len(g) > BUCKETS // 2:
        return np.bincount(g.astype(np.intp), minlength=BUCKETS).astype(np.float32) @ weights / len(g)
    return weights[g].sum(0) / len(g)


def margins(text: str, m: Model) -> np.ndarray:
    g = grams(text)
    # Evidence grows with the text: a short one gives margins near its bias.
    return _mean_weights(g, m.weights) * np.sqrt(min(len(g), 900) / 900) * 3 + m.bias


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model:
    """Fits the bit classifiers on whole texts and on pieces of 12 to 240 characters."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    rng, xs, ys = np.random.default_rng(seed), [], []
    for t, lang in zip(texts, langs, strict=True):
        pieces = [t]
        for n in (12, 30, 80, 240):
            if len(t) > n:
                at = int(rng.integers(0, len(t) - n))
                pieces.append(t[at : at + n])
        for p in pieces:
            if _LETTER.search(p):
                xs.append(grams(p))
                ys.append(names.index(lang))
    y = np.array(ys)
    X = np.zeros((len(xs), BUCKETS), np.float32)
    for i, g in enumerate(xs):
        np.add.at(X[i], g, np.float32(1 / len(g) * np.sqrt(min(len(g), 900) / 900) * 3))
    Y = codes[y].astype(np.float32)
    W, b = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    g2, b2 = np.full_like(W, 1e-8), np.full_like(b, 1e-8)
    for _ in range(60):  # full-batch AdaGrad on the logistic loss
        r = -Y / (1 + np.exp(np.clip(Y * (X @ W + b), -30, 30))) / len(Y)
        gw, gb = X.T @ r + 1e-7 * W, r.sum(0)
        g2 += gw * gw
        b2 += gb * gb
        W -= 1.0 * gw / np.sqrt(g2)
        b -= 0.1 * gb / np.sqrt(b2)
    error = np.clip((Y * (X @ W + b) <= 0).mean(0), 1e-3, 0.499)
    trust = np.log((1 - error) / error)
    trust /= trust.sum()
    return Model(names, codes, W, b, trust)


def losses(f: np.ndarray, m: Model) -> np.ndarray:
    """Loss of each language's codeword, weighted by how well the bits did in training."""
    return (m.trust * np.log1p(np.exp(np.clip(-m.codes * f, -30, 30)))).sum(1)


def decode(f: np.ndarray, m: Model) -> tuple[str, float, float]:
    """Language, score and gap to the runner-up."""
    loss = losses(f, m)
    p = np.exp(-4 * (loss - loss.min()))
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    second = p[order[1]] if len(p) > 1 else 0.0
    return m.langs[order[0]], float(p[order[0]]), float(p[order[0]] - second)


def sample(docs: DataFrame, id_col: str, text_col: str, label: Column, per_label: int, labels: int = LABELS, training: int = TRAINING) -> DataFrame:
    """``text, label``: at most ``per_label`` texts of each of the ``labels`` most frequent labels, and ``training`` of all."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), label.alias("label"))
    rows = rows.where("label IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    known = [r["label"] for r in rows.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(min(labels, training)).collect()]
    few = rows.where(F.col("label").isin(known)) if known else rows.where(F.lit(False))
    few = few.withColumn("h", row_hash("id", "text"))
    return training_sample(few.select("h", "text"), few.select("label", "h"), max(1, min(per_label, training // max(len(known), 1))), TRAINING_CHARS)


def _one(t: str | None, model: Model | None) -> tuple[str, float, bool]:
    if model is None or not t or not _LETTER.search(t):
        return UNKNOWN, 0.0, False
    lang, score, gap = decode(margins(t, model), model)
    return lang, score, gap < AMBIGUOUS


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous``, a row per input row.

    A text that is null or has no letter, or any text if there is no model, is
    ``und`` with score 0 and not ambiguous. A tie goes to the language that
    sorts first. Repeated rows are scored each; other columns are not read.
    """

    def run(texts: list[str | None]) -> list[list]:
        return [list(x) for x in zip(*[_one(t, model) for t in texts], strict=True)] or [[], [], []]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, [("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that have a language: what is ``und`` goes.

    Where ``lang_col`` is null it becomes the predicted language; a given label
    stays, and its text is not decoded. Clean documents may be in any learned
    language and may mix them, so neither an ambiguous nor a costly decoding
    rejects. Without a model (no row has a label) a text with a letter has some
    language, which nothing names, and stays. Other columns pass through
    untouched, as Arrow batches.
    """
    at, to = docs.columns.index(text_col), docs.columns.index(lang_col)

    def language(t: str | None, given: str | None) -> tuple[bool, str | None]:
        if not t or not _LETTER.search(t):
            return False, given
        return True, given if given is not None or model is None else _one(t, model)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [language(t, given) for t, given in zip(b.column(at).to_pylist(), b.column(to).to_pylist(), strict=True)]
            named = pa.array([x for _, x in found], b.schema.field(to).type)
            yield b.set_column(to, b.schema.field(to), named).filter(pa.array([x for x, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, label: Column, id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model | None:
    """Trains on a bounded sample of the rows whose ``label`` is not null; None if there is none."""
    got = sample(docs, id_col, text_col, label, per_language).toPandas().sort_values(["label", "text"])
    return train(got["text"].tolist(), got["label"].tolist()) if len(got) else None


def held_out(id_col: str = "doc_id") -> Column:
    """True for ids of the test fold, and for null ids, which are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def language_report(docs: DataFrame) -> DataFrame:
    """Fit on the learning fold, then identify every document."""
    model = fit(docs, F.when(~held_out(), F.col("lang")))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
