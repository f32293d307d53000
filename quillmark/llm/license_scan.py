"""Licence scan: ordered signature rules over normalised texts.

A rule has keywords, a pattern, a label and a priority. One pass over a text
finds which keywords it holds; a rule's pattern runs only over a text with one
of its keywords, so a text without licence language costs that pass. Detections that lie inside a detection of the same or a
higher priority are suppressed.

Everything is one projection of built-in functions: no shuffle, no join.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import text_or_empty
from quillmark.llm.license_rules import BASE, RULES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII that separates words, once A-Z became a-z.
_SEPARATORS = "".join(c for c in map(chr, range(128)) if not ("0" <= c <= "9" or "a" <= c <= "z" or c in _UPPER))
#: Confidence of a detection by its priority.
CONFIDENCE = (0.5, 0.7, 0.9, 1.0)
DETECTION = "array<struct<start:int,stop:int,priority:int,rule:int,label:string>>"


class Rule(NamedTuple):
    keywords: str
    pattern: str
    label: str
    priority: int


def rules() -> list[Rule]:
    """All rules in order; the base phrases come first, at their own priority."""
    base = [Rule(keywords, phrase, label, 1) for keywords, phrase, label in BASE]
    return base + [Rule(*r) for r in RULES]


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def words_of(text: Column) -> Column:
    """The words of a text between single spaces; two spaces if it has none.

    One ``translate`` folds A-Z and turns separators into spaces; the regex then
    only meets places with more than one.
    """
    plain = F.translate(text, _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, " {2,}", " ")), F.lit(" "))


def keyword_pattern(table: list[Rule]) -> str:
    """Matches a whole word that is a keyword; branches by first letter."""
    every = sorted({k for r in table for k in r.keywords.split()})
    branches = [first + "(?:" + "|".join(re.escape(k[1:]) for k in ks) + ")" for first, ks in groupby(every, lambda k: k[0])]
    return " (" + "|".join(branches) + ")(?= )"


def _detections(padded: Column, held: Column, table: list[Rule]) -> Column:
    """All matches of all rules of which the text holds a keyword.

    ``padded`` is the words of a text, each between single spaces. A pattern's
    matches are fenced off by two control characters, which normalised texts
    cannot hold; counting spaces up to a fence gives the word it stands at.
    """
    rows = [{"k": r.keywords.split(), "re": f"(?<= )(?:{r.pattern})(?= )", "label": r.label, "p": r.priority, "i": i} for i, r in enumerate(table)]
    literal = F.from_json(F.lit(json.dumps(rows)), "array<struct<k:array<string>,re:string,label:string,p:int,i:int>>")

    def matches(r: Column) -> Column:
        pieces = F.split(F.regexp_replace(padded, r["re"], F.lit("\x01$0\x02")), "\x01")
        start = F.struct(_spaces(F.element_at(pieces, 1)).alias("at"), F.array().cast(DETECTION).alias("found"))

        def step(acc: Column, piece: Column) -> Column:
            stop = acc["at"] + _spaces(F.substring_index(piece, "\x02", 1))
            hit = F.struct((acc["at"] - 1).cast("int").alias("start"), stop.cast("int").alias("stop"), r["p"].alias("priority"), r["i"].alias("rule"), r["label"].alias("label"))
            return F.struct((acc["at"] + _spaces(piece)).alias("at"), F.concat(acc["found"], F.array(hit)).cast(DETECTION).alias("found"))

        return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), start, step)["found"]

    return F.flatten(F.transform(F.filter(literal, lambda r: F.arrays_overlap(held, r["k"])), matches))


def _unsuppressed(found: Column) -> Column:
    """Drops what lies inside a detection of the same or a higher priority.

    In the order of start, longest first, whatever can contain a detection has
    come before it, so one pass with the furthest end per priority decides.
    """
    levels = range(len(CONFIDENCE))
    order = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["stop"] != b["stop"], b["stop"] - a["stop"]).when(a["priority"] != b["priority"], b["priority"] - a["priority"]).otherwise(a["rule"] - b["rule"]))
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in levels], F.array().cast(DETECTION).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        inside = reduce(lambda x, y: x | y, [(d["priority"] <= p) & (acc[f"e{p}"] >= d["stop"]) for p in levels])
        ends = [F.when(d["priority"] == p, F.greatest(acc[f"e{p}"], d["stop"])).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in levels]
        return F.struct(*ends, F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).cast(DETECTION).alias("kept"))

    return F.aggregate(order, start, step)["kept"]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, base, detections``, a row per input row.

    ``base`` holds every place of a base phrase, ``detections`` what is left of
    all rules after suppression; both count words from 0, and ``stop`` is the
    word after the last. A null or empty text has no words and two empty
    arrays. Repeated rows are scanned each. Other columns are not read.
    """
    table = table or rules()
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(text_or_empty(F.col(text_col))).alias("padded"))
    rows = rows.select("doc_id", "padded", F.regexp_extract_all("padded", F.lit(keyword_pattern(table)), F.lit(1)).alias("held"))
    rows = rows.select(
        "doc_id",
        F.when(F.col("padded") == "  ", F.lit(0)).otherwise(_spaces(F.col("padded")) - 1).cast("long").alias("n_words"),
        F.when(F.size("held") > 0, _detections(F.col("padded"), F.array_distinct("held"), table)).otherwise(F.array().cast(DETECTION)).alias("all"),
    )
    return rows.select(
        "doc_id", "n_words",
        F.array_sort(F.filter("all", lambda d: d["rule"] < len(BASE))).alias("base"),
        _unsuppressed(F.col("all")).alias("detections"),
    )


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``scan_licenses`` that ``op1_license_scan`` returns."""
    found = scan_licenses(docs, id_col, text_col)

    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(c)), ",")

    base_labels = F.transform("base", lambda d: d["label"])
    best = F.array_max(F.transform("detections", lambda d: d["priority"]))
    return found.select(
        "doc_id", "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["start"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.when(F.size("detections") == 0, F.lit(0.0)).otherwise(F.element_at(F.array(*[F.lit(x) for x in CONFIDENCE]), best + 1)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
