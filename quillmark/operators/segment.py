"""Words of texts without blanks between them: the likeliest split by unigram costs.

The dictionary (word, count) is broadcast; its size must be bounded, and it is
checked. Runs of letters, digits and marks of ASCII are words of their own, as
is any character that no word of the dictionary covers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.metrics import rouge_bleu

#: Words a dictionary may have: it is sent to every task.
MOST_WORDS = 1_000_000
_RUN = re.compile(r"[A-Za-z0-9_+#&.%-]+|\s+|[^A-Za-z0-9_+#&.%\s-]+")


def costs(dictionary: DataFrame, word: str = "word", count: str = "count") -> dict[str, float]:
    """Minus log shares of the words; those of equal words are added."""
    rows = dictionary.where(F.col(word).isNotNull() & (F.col(count) > 0)).groupBy(word).agg(F.sum(count).alias("n"))
    got = rows.limit(MOST_WORDS + 1).collect()
    if len(got) > MOST_WORDS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words is not sent to all tasks")
    total = sum(r["n"] for r in got)
    return {r[word]: math.log(total) - math.log(r["n"]) for r in got}


def segment(text: str, cost: dict[str, float], longest: int | None = None) -> list[str]:
    """The split of least cost; of equal ones that whose last word is longest. Blanks are no words."""
    longest = longest or max(map(len, cost), default=1)
    unknown = 2 * max(cost.values(), default=1.0) + 1.0
    out: list[str] = []
    for run in _RUN.findall(text):
        if run.isspace():
            continue
        if run[0].isascii() and run not in cost and re.fullmatch(r"[A-Za-z0-9_+#&.%-]+", run):
            out.append(run)
            continue
        best, start = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            for at in range(max(0, end - longest), end):
                c = cost.get(run[at:end], unknown if end - at == 1 else math.inf)
                if best[at] + c < best[end]:
                    best[end], start[end] = best[at] + c, at
        words, end = [], len(run)
        while end:
            words.append(run[start[end] : end])
            end = start[end]
        out += reversed(words)
    return out


def rouge_bleu_segmented(df: DataFrame, key: str, hypothesis: str, reference: str, dictionary: DataFrame) -> DataFrame:
    """``id, rouge_1, rouge_2, rouge_l, bleu_4`` of each row, in percent, over segmented words; a row with an empty side is left out, as its scores are undefined."""
    known = df.sparkSession.sparkContext.broadcast(costs(dictionary))
    longest = max(map(len, known.value), default=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [(segment(h or "", known.value, longest), segment(r or "", known.value, longest)) for h, r in zip(b["h"], b["r"], strict=True)]
            got = [(i, rouge_bleu(h, r)) for i, (h, r) in zip(b["id"], pairs, strict=True) if h and r]
            yield pd.DataFrame({"id": [i for i, _ in got], **{k: [round(g[k], 6) for _, g in got] for k in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")}})

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(hypothesis).alias("h"), F.col(reference).alias("r"))
    return rows.mapInPandas(run, "id long, rouge_1 double, rouge_2 double, rouge_l double, bleu_4 double")
