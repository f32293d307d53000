"""JSON as people and models write it, read leniently and written in the order it came.

``parse_json`` reads JSON, else a Python literal; ``repair_json`` reads JSON,
else what it can make of a text with missing or wrong quotes, commas and
brackets. Both give JSON text with keys in their order (variants and maps sort
them), or null. Texts that are JSON already never leave the JVM for repair
where only the values are asked for (``lenient``).
"""

from __future__ import annotations

import ast
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_CLOSERS = {"{": "}", "[": "]", "(": ")"}


class Repair:
    """One pass over the characters; every state knows how to go on without what is missing."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def value(self) -> Any:
        self._blanks()
        c = self._now()
        if c in _CLOSERS:
            return self._object() if c == "{" else self._list(_CLOSERS[c])
        return self._string() if c in _QUOTES else self._word(",}])\n")

    def _now(self) -> str:
        return self.text[self.at : self.at + 1]

    def _blanks(self, more: str = "") -> None:
        while self._now() and (self._now().isspace() or self._now() in more):
            self.at += 1

    def _object(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        self.at += 1
        while True:
            self._blanks(",")
            c = self._now()
            if not c or c in "]}":
                # A wrong closer ends the object too; without any, the text's end does.
                self.at += c == "}"
                return out
            key = self._string() if c in _QUOTES else self._word(":,}]", literal=False)
            self._blanks()
            if self._now() in (":", "="):
                self.at += 1
                self._blanks()
                out[str(key)] = None if self._now() in (",", "}", "") else self.value()
            else:
                out[str(key)] = None

    def _list(self, closer: str) -> list[Any]:
        out: list[Any] = []
        self.at += 1
        while True:
            self._blanks(",")
            c = self._now()
            if not c or c in "]})":
                self.at += c == closer
                return out
            before = self.at
            out.append(self.value())
            self.at += self.at == before  # a character that starts no value is passed over

    def _string(self) -> str:
        closer, out = _QUOTES[self._now()], []
        self.at += 1
        while c := self._now():
            self.at += 1
            if c == closer and self._ends():
                break
            if c == "\\" and self._now():
                c, self.at = self._now(), self.at + 1
                code = self.text[self.at : self.at + 4]
                if c == "u" and len(code) == 4 and all(x in "0123456789abcdefABCDEF" for x in code):
                    out.append(chr(int(code, 16)))
                    self.at += 4
                else:
                    out.append(_ESCAPES.get(c, c))
            else:
                out.append(c)
        return "".join(out)

    def _ends(self) -> bool:
        """A quote closes its string if a separator, a closer, another quote or the end follows; a bare one inside does not."""
        rest = self.text[self.at :].lstrip()
        return not rest or rest[0] in ":,}])=" or rest[0] in _QUOTES

    def _word(self, stop: str, literal: bool = True) -> Any:
        start = self.at
        while self._now() and self._now() not in stop:
            if literal and (self._now().isspace() or self._now() in _QUOTES) and _literal(self.text[start : self.at]) is not _NONE:
                break  # a comma is missing
            self.at += 1
        word = self.text[start : self.at].strip()
        value = _literal(word) if literal else _NONE
        return word if value is _NONE else value


_NONE = object()


def _literal(word: str) -> Any:
    """The value of a bare word; ``_NONE`` if it is a text."""
    if word in _WORDS:
        return _WORDS[word]
    for kind in (int, float):
        try:
            return kind(word)
        except ValueError:
            pass
    return _NONE


def read(text: str | None, repair: bool) -> Any:
    """The value of a text; raises ValueError if it has none."""
    if text is None:
        raise ValueError("no text")
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        if not repair:
            return ast.literal_eval(text)
        start = next(i for i, c in enumerate(text) if c in "{[")
        return Repair(text[start:]).value()
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError, StopIteration):
        raise ValueError("no value") from None


def written(text: str | None, repair: bool = False, indent: int | None = None) -> str | None:
    try:
        return json.dumps(read(text, repair), ensure_ascii=False, indent=indent, default=repr)
    except ValueError:
        return None


def _udf(repair: bool, indent: int | None):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: written(t, repair, indent), na_action="ignore").astype(object)

    return run


def parse_json(c: Column, indent: int | None = None) -> Column:
    """JSON, else a Python literal, as JSON text; null if neither."""
    return _udf(False, indent)(c)


def repair_json(c: Column, indent: int | None = None) -> Column:
    """JSON, else what can be made of the text from its first bracket on, as JSON text; null without a bracket."""
    return _udf(True, indent)(c)


def lenient(blocks: Column) -> Column:
    """An array of texts, each JSON as it stands or the JSON of its Python literal; texts that are neither become null.

    Only arrays with a text that is no JSON go to Python.
    """

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda texts: [written(t) for t in texts], na_action="ignore")

    strict = F.forall(blocks, lambda b: F.try_parse_json(b).isNotNull())
    return F.coalesce(run(F.when(~strict, blocks)), blocks)
