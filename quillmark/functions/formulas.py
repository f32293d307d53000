"""Equality of formulas, LaTeX or plain, for answers.

A formula is parsed by precedence into a sum of terms: a rational coefficient
for each product of atoms with rational exponents. Integers are split into
primes where a root is taken of them, so ``\\sqrt{8}`` is ``2\\sqrt{2}`` and
``1/\\sqrt{2}`` is ``\\sqrt{2}/2``. Products of sums are multiplied out. Two
formulas are equal if their sums are; if not, and they hold symbols or
functions, their values at fixed points decide.
"""

from __future__ import annotations

import cmath
import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Product of atoms with exponents -> coefficient. An atom is a prime, a name, or a tuple for a function or a sum.
Terms = dict[tuple, Fraction]

_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\d+(?:,\d{3})+(?!\d)(?:\.\d+)?|\d*\.\d+|\d+\.?|[A-Za-zα-ωΑ-Ω]|\*\*|<=|>=|!=|\S")
#: Names of functions and what stands for a symbol. Fixed values.
_FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "ln": cmath.log, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan,
    "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "abs": abs,
}
_PLAIN = {"×": "*", "·": "*", "÷": "/", "−": "-", "–": "-", "π": "\\pi", "√": "\\sqrt", "∞": "\\infty", "≤": "<=", "≥": ">=", "≠": "!="}
_SAME = {"\\cdot": "*", "\\times": "*", "\\div": "/", "\\le": "<=", "\\leq": "<=", "\\ge": ">=", "\\geq": ">=", "\\ne": "!=", "\\neq": "!=", "\\lt": "<", "\\gt": ">", "\\{": "{{", "\\}": "}}", "**": "^", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\log": "\\log"}
_SKIPPED = {"\\left", "\\right", "\\,", "\\;", "\\!", "\\:", "\\ ", "\\quad", "\\qquad", "\\displaystyle", "$", "\\$", "\\(", "\\)", "\\[", "\\]", "\\circ", "°"}
_RELATIONS = {"=", "<", ">", "<=", ">=", "!="}
_MOST_TERMS, _MOST_POWER, _MOST_FACTOR = 400, 12, 10**12


class Unreadable(ValueError):
    """A text that is no formula of this grammar, or too large for it."""


def number(x: Fraction | int) -> Terms:
    return {(): Fraction(x)} if x else {}


def atom(a: object, power: Fraction = Fraction(1)) -> Terms:
    return {((a, power),): Fraction(1)}


def add(a: Terms, b: Terms, sign: int = 1) -> Terms:
    out = dict(a)
    for k, c in b.items():
        out[k] = out.get(k, Fraction(0)) + sign * c
    return {k: c for k, c in out.items() if c}


def _product(atoms: tuple, coefficient: Fraction) -> tuple[tuple, Fraction]:
    """Atoms once each, in order; whole powers of primes go to the coefficient."""
    powers: dict[object, Fraction] = {}
    for a, p in atoms:
        powers[a] = powers.get(a, Fraction(0)) + p
    for a in [a for a in powers if isinstance(a, int)]:
        whole = math.floor(powers[a])
        coefficient *= Fraction(a) ** whole
        powers[a] -= whole
    return tuple(sorted(((a, p) for a, p in powers.items() if p), key=repr)), coefficient


def mul(a: Terms, b: Terms) -> Terms:
    if len(a) * len(b) > _MOST_TERMS:
        raise Unreadable("too many terms")
    out: Terms = {}
    for k, c in a.items():
        for m, d in b.items():
            key, coefficient = _product(k + m, c * d)
            out[key] = out.get(key, Fraction(0)) + coefficient
    return {k: c for k, c in out.items() if c}


def _primes(n: int) -> list[tuple[int, int]]:
    if n > _MOST_FACTOR:
        raise Unreadable("too large to factor")
    out, p = [], 2
    while p * p <= n:
        k = 0
        while n % p == 0:
            n, k = n // p, k + 1
        out += [(p, k)] if k else []
        p += 1 if p == 2 else 2
    return out + ([(n, 1)] if n > 1 else [])


def power(a: Terms, p: Fraction) -> Terms:
    if not a:
        if p <= 0:
            raise Unreadable("zero to no positive power")
        return {}
    if p.denominator == 1 and 0 <= p <= _MOST_POWER:
        out = number(1)
        for _ in range(int(p)):
            out = mul(out, a)
        return out
    if len(a) > 1:  # the sum is an atom of its own, divided by its first coefficient
        first = a[min(a, key=repr)]
        rest = tuple(sorted(((k, c / first) for k, c in a.items()), key=repr))
        return mul(power(number(first), p), atom(("sum", rest), p))
    (atoms, c), = a.items()
    out = {_product(tuple((x, q * p) for x, q in atoms), Fraction(1))[0]: _product(tuple((x, q * p) for x, q in atoms), Fraction(1))[1]}
    if p.denominator == 1:
        if abs(p) > 1000:
            raise Unreadable("too large a power")
        return mul(out, number(c ** int(p)))
    if c < 0:
        if p.denominator % 2 == 0:
            out = mul(out, atom("i"))  # the root of -1; odd powers of it are told apart by value
        elif p.numerator % 2:
            out = mul(out, number(-1))
        c = -c
    for n, sign in ((c.numerator, 1), (c.denominator, -1)):
        for q, k in _primes(n):
            out = mul(out, dict([_product(((q, sign * k * p),), Fraction(1))]))
    return out


class Parser:
    """Relations over sums over products (also implied ones) over signs, powers and marks behind an operand."""

    def __init__(self, text: str) -> None:
        for a, b in _PLAIN.items():
            text = text.replace(a, b)
        text = re.sub(r"\\(?:text|mathrm|textbf|mathbf|operatorname)\s*\{([^{}]*)\}", lambda m: m[1] if m[1].strip() in _FUNCTIONS else f"\\word{{{m[1].strip()}}}", text)
        words = re.sub(r"(?<![\\A-Za-z])(sqrt|pi|infinity|sin|cos|tan|ln|log|exp|abs)(?![A-Za-z])", lambda m: "\\" + m[1], text)
        found = [_SAME.get(t, t) for t in _TOKEN.findall(words)]
        self.tokens, self.at = [t for t in found if t not in _SKIPPED], 0
        self.symbols = False

    def now(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, t: str = "") -> str:
        got = self.now()
        if not got or t and got != t:
            raise Unreadable(f"{t or 'a token'} expected, {got or 'the end'} found")
        self.at += 1
        return got

    def relation(self) -> tuple:
        """``(sides, relations)``."""
        sides, relations = [self.sum()], []
        while self.now() in _RELATIONS:
            relations.append(self.take())
            sides.append(self.sum())
        return sides, relations

    def sum(self) -> Terms:
        out = self.product()
        while self.now() in ("+", "-"):
            out = add(out, self.product(), 1) if self.take() == "+" else add(out, self.product(), -1)
        return out

    def product(self) -> Terms:
        out = self.signed()
        while True:
            t = self.now()
            if t in ("*", "/"):
                self.take()
                right = self.signed()
                out = mul(out, right if t == "*" else power(right, Fraction(-1)))
            elif t and (t[0].isalnum() or t in ("(", "{", "\\frac", "\\sqrt", "\\pi", "\\log", "\\infty", "\\word") or t[1:] in _FUNCTIONS or self._greek(t)):
                before = self.tokens[self.at - 1]
                right = self.power()
                # A whole number before a fraction is a mixed number.
                out = add(out, right) if t == "\\frac" and before.isdigit() and set(out) <= {()} and set(right) <= {()} else mul(out, right)
            else:
                return out

    @staticmethod
    def _greek(t: str) -> bool:
        return t in ("\\alpha", "\\beta", "\\gamma", "\\theta", "\\lambda", "\\mu", "\\phi", "\\omega", "\\sigma", "\\rho", "\\delta", "\\epsilon", "\\tau")

    def signed(self) -> Terms:
        if self.now() in ("+", "-"):
            return mul(number(-1), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> Terms:
        out = self.operand()
        while self.now() in ("!", "\\%", "%"):
            if self.take() == "!":
                n = out.get((), Fraction(0))
                if set(out) - {()} or n.denominator != 1 or not 0 <= n <= 200:
                    raise Unreadable("no factorial")
                out = number(math.factorial(int(n)))
            else:
                out = mul(out, number(Fraction(1, 100)))
        if self.now() == "^":
            self.take()
            raised = self.signed() if self.now() == "-" else self.power() if self.now() == "(" else self.argument()
            return self.raised(out, raised)
        return out

    def raised(self, base: Terms, to: Terms) -> Terms:
        if not set(to) - {()}:
            return power(base, to.get((), Fraction(0)))
        if set(base) == {(("e", Fraction(1)),)}:
            return self.function("exp", to)
        return atom(("pow", _key(base), _key(to)))

    def argument(self) -> Terms:
        """What a command or a power takes: a group in braces, or one digit, letter or command."""
        if self.now() == "{":
            return self.group("{", "}")
        t = self.now()
        if t.isdigit() and len(t) > 1 and self.at and self.tokens[self.at - 1] == "\\frac":
            self.tokens[self.at : self.at + 1] = list(t)
        return self.operand()

    def group(self, opener: str, closer: str) -> Terms:
        self.take(opener)
        out = self.sum()
        self.take(closer)
        return out

    def function(self, name: str, arg: Terms) -> Terms:
        self.symbols = True
        if name == "abs" and not set(arg) - {()}:
            return number(abs(arg.get((), Fraction(0))))
        return atom((name, _key(arg)))

    def operand(self) -> Terms:
        t = self.take()
        if t[0].isdigit() or t[0] == ".":
            return number(Fraction(t.replace(",", "").rstrip(".") or "0"))
        if t in ("(", "{", "["):
            self.at -= 1
            return self.group(t, {"(": ")", "{": "}", "[": "]"}[t])
        if t == "|":
            inner = self.sum()
            self.take("|")
            return self.function("abs", inner)
        if t == "\\frac":
            top = self.argument()
            self.tokens[self.at - 1] = "\\frac" if self.now().isdigit() else self.tokens[self.at - 1]
            return mul(top, power(self.argument(), Fraction(-1)))
        if t == "\\sqrt":
            root = Fraction(2)
            if self.now() == "[":
                index = self.group("[", "]")
                root = index.get((), Fraction(0))
            if not root:
                raise Unreadable("no root")
            inner = self.group("(", ")") if self.now() == "(" else self.argument()
            return power(inner, 1 / root)
        if t == "\\log" or t[:1] == "\\" and t[1:] in _FUNCTIONS:
            return self._applied(t[1:])
        if t in ("\\pi", "\\infty", "\\infinity") or self._greek(t):
            return atom({"\\infinity": "\\infty"}.get(t, t))
        if t == "\\word":
            self.take("{")
            word = []
            while self.now() != "}":
                word.append(self.take())
            self.take("}")
            return atom("word " + "".join(word)) if word else number(1)
        if len(t) == 1 and t.isalpha():
            name = t
            if self.now() == "_":
                self.take()
                if self.now() == "{":
                    self.take("{")
                    while self.now() != "}":
                        name += self.take()
                    self.take("}")
                else:
                    name += self.take()
            self.symbols = True
            return atom(name)
        raise Unreadable(f"{t} starts no operand")

    def _applied(self, name: str) -> Terms:
        base, raised = None, None
        while self.now() in ("_", "^"):
            if self.take() == "_":
                base = self.argument()
            else:
                raised = self.argument()
        arg = self.group("(", ")") if self.now() == "(" else self.power()
        out = self.function("ln" if name == "log" else name, arg)
        if name == "log":
            out = mul(out, power(self.function("ln", base or number(10)), Fraction(-1)))
        return self.raised(out, raised) if raised is not None else out


def _key(a: Terms) -> tuple:
    return tuple(sorted(a.items(), key=repr))


def value(a: Terms, at: float) -> complex:
    """The value with each symbol at a fixed point that depends on its name."""

    def of(x: object) -> complex:
        if isinstance(x, int):
            return x
        if isinstance(x, str):
            if x in ("\\pi", "e", "i"):
                return {"\\pi": math.pi, "e": math.e, "i": 1j}[x]
            if x == "\\infty" or x.startswith("word "):
                raise Unreadable("no value")
            return 0.3 + (sum(map(ord, x)) * at) % 1.0
        kind, *rest = x
        if kind == "sum":
            return value(dict(rest[0]), at)
        if kind == "pow":
            return value(dict(rest[0]), at) ** value(dict(rest[1]), at)
        return _FUNCTIONS[kind](value(dict(rest[0]), at))

    try:
        return sum((complex(c) * math.prod((complex(of(x)) ** float(p) for x, p in atoms), start=1 + 0j) for atoms, c in a.items()), 0j)
    except (OverflowError, ZeroDivisionError, ValueError) as e:
        raise Unreadable(str(e)) from None


def same_terms(a: Terms, b: Terms) -> bool:
    if a == b:
        return True
    if not any(isinstance(x, (str, tuple)) for k in (*a, *b) for x, _ in k):
        return False  # numbers and roots are exact
    try:
        pairs = [(value(a, at), value(b, at)) for at in (0.37, 0.61, 0.83, 0.19)]
    except Unreadable:
        return False
    return all(abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y)) for x, y in pairs)


def _parts(text: str) -> tuple[str, list[str]]:
    """Kind of brackets around a list, and its members; a single formula has no kind."""
    t = re.sub(r"\\(?:left|right)\b", "", text).strip().strip("$").strip()
    kind = ""
    for opener, closer in (("\\{", "\\}"), ("(", ")"), ("[", "]"), ("(", "]"), ("[", ")")):
        if t.startswith(opener) and t.endswith(closer):
            inner, depth = t[len(opener) : -len(closer)], 0
            if all((depth := depth + (c in "([{") - (c in ")]}")) >= 0 for c in inner) and depth == 0:
                kind, t = opener + closer, inner
                break
    out, depth, start = [], 0, 0
    for i, c in enumerate(t):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0 and not re.match(r"\d{3}(?!\d)", t[i + 1 :]) or c == "," and depth == 0 and not t[start:i].strip()[-1:].isdigit():
            out.append(t[start:i])
            start = i + 1
    out.append(t[start:])
    return (kind, out) if len(out) > 1 or kind == "\\{\\}" else ("", [text])


def _parsed(text: str) -> tuple[list[Terms], list[str]]:
    p = Parser(text)
    got = p.relation()
    if p.at < len(p.tokens):
        raise Unreadable("more than a formula")
    return got


def _one(a: str, b: str) -> bool:
    (xs, rx), (ys, ry) = _parsed(a), _parsed(b)
    if rx == ry == ["="]:
        left, right = add(xs[0], xs[1], -1), add(ys[0], ys[1], -1)
        if same_terms(left, right) or same_terms(left, mul(number(-1), right)):
            return True
    if rx and not ry and rx[-1] == "=":
        xs, rx = xs[-1:], []
    if ry and not rx and ry[-1] == "=":
        ys, ry = ys[-1:], []
    flipped = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    if rx == ry and all(same_terms(x, y) for x, y in zip(xs, ys, strict=True)):
        return True
    turned = [flipped.get(r, r) for r in reversed(ry)]
    return bool(rx) and rx == turned and all(same_terms(x, y) for x, y in zip(xs, reversed(ys), strict=True))


def equal(a: str, b: str) -> bool:
    """Whether two answers are the same formula, equation, list or set; texts that cannot be read only if they are the same but for blanks."""
    if re.sub(r"\s", "", a) == re.sub(r"\s", "", b):
        return bool(a.strip())
    (kind_a, as_), (kind_b, bs) = _parts(a), _parts(b)
    try:
        if len(as_) != len(bs) or kind_a and kind_b and kind_a != kind_b:
            return False
        if "\\{\\}" in (kind_a, kind_b) or not kind_a and not kind_b and len(as_) > 1:  # a set has no order
            left = list(bs)
            for x in as_:
                hit = next((i for i, y in enumerate(left) if _one(x, y)), None)
                if hit is None:
                    return False
                left.pop(hit)
            return True
        return all(_one(x, y) for x, y in zip(as_, bs, strict=True))
    except (Unreadable, RecursionError, OverflowError, ZeroDivisionError):
        return False


def boxed(text: str) -> str | None:
    """What the last box holds, braces balanced."""
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth, start = 0, at + 7
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth < 0:
            return text[start:i].strip()
    return None


def _asked(text: str, whole: bool) -> str | None:
    """The answer a text gives: its box, its last formula between dollars, or (``whole``) the text itself or its last number."""
    found = boxed(text)
    if found is not None:
        return found
    dollars = re.findall(r"\$\$?([^$]+)\$\$?|\\[(\[](.+?)\\[)\]]", text, re.S)
    if dollars:
        return next(x for x in dollars[-1] if x)
    if not whole:
        return None
    try:
        for part in _parts(text.strip())[1]:
            _parsed(part)
        return text.strip()
    except (Unreadable, RecursionError):
        numbers = re.findall(r"-?\d[\d,]*(?:\.\d+)?(?:/\d+)?", text)
        return numbers[-1] if numbers else text.strip()


def accuracy_of(completion: str | None, solution: str | None) -> float:
    if not completion or not solution:
        return 0.0
    tagged = re.search(r"<answer>(.*?)</answer>", completion, re.S)
    gold = re.search(r"<answer>(.*?)</answer>", solution, re.S)
    want = _asked(gold[1] if gold else solution, True)
    said = _asked(tagged[1], True) if tagged else _asked(completion, False)
    return float(bool(said and want and equal(said, want)))


def math_of(completion: str | None, solution: str | None) -> float:
    if not completion or not solution:
        return 0.0
    a, b = (x.split("# Answer")[1] if "# Answer" in x else x for x in (completion, solution))
    return float(equal(*(y if (y := boxed(x)) is not None else x.strip() for x in (a, b))))


def _reward(fn):
    @F.pandas_udf("double")
    def run(completion: pd.Series, solution: pd.Series) -> pd.Series:
        return pd.Series([fn(a, b) for a, b in zip(completion, solution, strict=True)], dtype=float)

    return run


def accuracy(completion: Column, solution: Column) -> Column:
    """1 if the answer (tagged, else the last box or formula of the text) equals the solution's, else 0.

    A completion without a tag must box its answer or set it as a formula.
    """
    return _reward(accuracy_of)(completion, solution)


def math_answer(completion: Column, solution: Column) -> Column:
    """1 if the boxed (else whole) answers, after ``# Answer`` if there is one, are equal formulas, else 0."""
    return _reward(math_of)(completion, solution)
