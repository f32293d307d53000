"""Splitting by delimiters, and weights of the pieces for the loss."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = "array<struct<key:string,content:string>>"


def split_parts(text: str, delimiters: list[str], regex_mode: bool = False) -> list[dict[str, str]]:
    """Pieces that together are the text.

    Literal: each delimiter is the key of the text up to the next one, and text
    before the first has the key ''. Regex: matches and the text between them
    are pieces; a match has its pattern as key, other text ''.
    """
    if not delimiters:
        return [{"key": "", "content": text}] if text else []
    patterns = delimiters if regex_mode else [re.escape(d) for d in sorted(delimiters, key=len, reverse=True)]
    out, at, key = [], 0, ""
    for m in re.finditer("|".join(f"(?:{p})" for p in patterns), text, re.S):
        if regex_mode:
            if m.start() > at:
                out.append({"key": "", "content": text[at : m.start()]})
            out.append({"key": next(p for p in delimiters if re.match(p, m[0], re.S)), "content": m[0]})
        elif m.start() > at or key:
            out.append({"key": key, "content": text[at : m.start()]})
        key, at = ("" if regex_mode else m[0]), m.end()
    if at < len(text) or key:
        out.append({"key": key, "content": text[at:]})
    return out


def split_column(text: Column, delimiters: list[str], regex_mode: bool = False) -> Column:
    @F.pandas_udf(PIECES)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else split_parts(t, delimiters, regex_mode))

    return run(text)


def span_weights(pieces: Column, weights: dict[str, tuple[float, float]]) -> Column:
    """Text and weight of each delimiter and its content; keys without an entry weigh 1."""
    known = F.create_map(*[F.lit(x) for k, (d, c) in weights.items() for x in (k, F.array(F.lit(float(d)), F.lit(float(c))))]) if weights else None

    def of(p: Column) -> Column:
        w = F.coalesce(known[p["key"]], F.array(F.lit(1.0), F.lit(1.0))) if known is not None else F.array(F.lit(1.0), F.lit(1.0))
        return F.array(F.struct(p["key"].alias("text"), w[0].alias("weight")), F.struct(p["content"].alias("text"), w[1].alias("weight")))

    return F.filter(F.flatten(F.transform(pieces, of)), lambda x: x["text"] != "")


def sub_positions(tokens: Column, sub: list) -> Column:
    """Places at which a list stands inside another."""
    want, n = F.array(*[F.lit(x) for x in sub]), F.size(tokens) - len(sub)
    return F.when(n >= 0, F.filter(F.sequence(F.lit(0), n), lambda i: F.slice(tokens, i + 1, F.lit(len(sub))) == want)).otherwise(F.array().cast("array<int>"))


def fill_placeholders(text: Column, mark: str, values: Column, render: Callable[[Column], Column] = lambda v: v) -> Column:
    """The k-th mark becomes the k-th value; marks beyond the values stay."""
    parts = F.split(text, re.escape(mark))
    filled = F.transform(parts, lambda p, i: F.concat(F.when(i == 0, "").otherwise(F.coalesce(render(F.get(values, i - 1)), F.lit(mark))), p))
    return F.array_join(filled, "")
