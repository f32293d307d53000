"""Tool-call parsers: text -> array<struct<name,arguments>>, built-ins where a call is strict JSON.

A call that is no JSON but a Python literal is read as such.

Each key of ``PARSERS`` is a template family. All fall back to the ReAct form
if they find nothing (``mistral`` only if it has a list of calls).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.jsons import lenient
from quillmark.functions.text import strip

CALLS = "array<struct<name:string,arguments:string>>"


def _none() -> Column:
    return F.array().cast(CALLS)


def _call(name: Column, arguments: Column) -> Column:
    return F.struct(name.alias("name"), arguments.alias("arguments"))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _pairs(text: Column, pattern: str) -> Column:
    z = F.arrays_zip(_all(text, pattern, 1).alias("k"), _all(text, pattern, 2).alias("v"))
    return F.transform(z, lambda x: _call(strip(x["k"]), strip(x["v"])))


def _from_json(blocks: Column, arguments: str = "arguments") -> Column:
    calls = F.transform(lenient(blocks), lambda b: _call(F.get_json_object(b, "$.name"), F.get_json_object(b, f"$.{arguments}")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def react(text: Column, action: str = "Action:", given: str = "Action Input:", seen: str = "Observation:") -> Column:
    return F.coalesce(_pairs(text, rf"(?s){action}(.*?)\n?{given}(.*?)(?=\n?{seen}|\n?{action}|\z)"), _none())


def qwen(text: Column) -> Column:
    return react(text, "✿FUNCTION✿:", "✿ARGS✿:", "✿RESULT✿:")


def hermes(text: Column) -> Column:
    return _from_json(_all(text, r"(?s)<tool_call>(.+?)</tool_call>"))


def hunyuan_hermes(text: Column) -> Column:
    return _pairs(text, r"(?s)<tool_call>(.*?)\n```json\n(.*?)\n?```\s*</tool_call>")


def hunyuan(text: Column) -> Column:
    """Its own form, else that of ``hermes``, in which calls are written."""
    own = hunyuan_hermes(text)
    return F.when(F.size(own) > 0, own).otherwise(hermes(text))


def without_end(text: Column, end: str) -> Column:
    return F.when(F.endswith(text, F.lit(end)), F.substr(text, F.lit(1), F.length(text) - len(end))).otherwise(text)


def llama(text: Column) -> Column:
    return _from_json(_all(text, r'(?s)(\{[^{]*?"name":.*?"parameters":\s*?\{.*?\}\s*?\})'), "parameters")


def mistral(text: Column) -> Column:
    """Calls of the first list, one JSON object or list a line; null without such a list."""
    listed = r"(?s)\[TOOL_CALLS\]\[(.*?)\]</s>"
    lines = F.split(strip(F.regexp_extract(text, listed, 1)), "\n")
    one = lambda x: F.array(_call(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.arguments")))
    many = lambda x: F.from_json(x, CALLS)
    calls = F.flatten(F.transform(lines, lambda x: F.coalesce(F.when(F.startswith(F.ltrim(x), F.lit("[")), many(x)).otherwise(one(x)), _none())))
    return F.when(text.rlike(listed), F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull()))


def glm4(text: Column) -> Column:
    pieces = F.transform(F.split(text, r"<\|assistant\|>"), lambda p: F.regexp_replace(p, r"<\|observation\|>", ""))
    pattern = r"(?s)^\s*([^\n{]+)\n\s*(\{.*\})"
    hits = F.filter(pieces, lambda p: p.rlike(pattern))
    return F.transform(hits, lambda p: _call(strip(F.regexp_extract(p, pattern, 1)), strip(F.regexp_extract(p, pattern, 2))))


def _keyed(block: Column, key: str, value: str, trim: bool = True) -> Column:
    """JSON of key-value marks; a later repeat of a key wins; unequal counts give null."""
    k, v = _all(block, key), _all(block, value)
    if trim:
        k, v = F.transform(k, lambda x: strip(x)), F.transform(v, lambda x: strip(x))
    last = F.filter(F.arrays_zip(k.alias("k"), v.alias("v"), F.sequence(F.lit(1), F.greatest(F.size(k), F.lit(1))).alias("i")), lambda x: x["k"].isNotNull() & ~F.array_contains(F.slice(k, x["i"] + 1, F.size(k)), x["k"]))
    return F.when(F.size(k) == F.size(v), F.to_json(F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))))


def glm4_5(text: Column) -> Column:
    blocks = _all(text, r"(?s)<tool_call>(.*?)</tool_call>")
    calls = F.transform(blocks, lambda b: _call(strip(F.regexp_extract(b, r"(?s)^\s*([^<\n]*)", 1)), _keyed(b, r"(?s)<arg_key>(.*?)</arg_key>", r"(?s)<arg_value>(.*?)</arg_value>")))
    return F.filter(calls, lambda c: (c["name"] != "") & c["arguments"].isNotNull())


def qwen3_coder(text: Column) -> Column:
    blocks = F.filter(_all(text, r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), lambda b: F.startswith(b, F.lit("<function=")) & F.endswith(b, F.lit("</function>")))
    return F.transform(blocks, lambda b: _call(F.regexp_extract(b, r"^<function=([^>]+)>", 1), _keyed(b, r"(?s)<parameter=([^>]+)>", r"(?s)<parameter=[^>]+>(.*?)</parameter>")))


def seed_oss(text: Column) -> Column:
    blocks = F.filter(_all(text, r"(?s)<seed:tool_call>(.*?)</seed:tool_call>"), lambda b: b.rlike(r"<function=[^>]+>"))
    return F.transform(blocks, lambda b: _call(F.regexp_extract(b, r"<function=([^>]+)>", 1), _keyed(b, r"(?s)<parameter=([^>]+)>.*?</parameter>", r"(?s)<parameter=[^>]+>(.*?)</parameter>", trim=False)))


def deepseek_v3_1(text: Column) -> Column:
    calls = _pairs(text, r"(?s)<｜tool▁call▁begin｜>(.*?)<｜tool▁sep｜>(.*?)<｜tool▁call▁end｜>")
    return F.filter(calls, lambda c: F.get_json_object(c["arguments"], "$").isNotNull())


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def minimax_m2(text: Column) -> Column:
    """Values that read as JSON keep their kind; a later repeat of a key wins."""
    marked = _all(text, r"(?s)<minimax:tool_call>(.*?)</minimax:tool_call>")
    blocks = F.flatten(F.transform(marked, lambda b: _all(b, r'(?s)(<invoke name="[^"]+">.*?</invoke>)')))
    pattern = r'(?s)<parameter name="([^"]+)">(.*?)</parameter>'

    def arguments(block: Column) -> Column:
        keys = _all(block, pattern)
        pairs = F.arrays_zip(keys.alias("k"), _all(block, pattern, 2).alias("v"))
        last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys) + 1), p["k"]))
        shown = lambda v: F.when(F.try_parse_json(v).isNotNull(), v).otherwise(_quoted(v))
        return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda p: F.concat(_quoted(p["k"]), F.lit(":"), shown(strip(p["v"])))), ","), F.lit("}"))

    return F.transform(blocks, lambda b: _call(F.regexp_extract(b, r'<invoke name="([^"]+)">', 1), arguments(b)))


_OWN: dict[str, Callable[[Column], Column]] = {
    "hermes": hermes, "hunyuan_hermes": hunyuan, "chatglm4": glm4, "glm4": glm4, "glm4_5": glm4_5, "glm4_7": glm4_5,
    "qwen3_coder": qwen3_coder, "qwen3_5": qwen3_coder, "seed_oss": seed_oss, "deepseek_v3_1": deepseek_v3_1, "minimax_m2": minimax_m2, "youtu": hermes,
}


def _with_fallback(parse: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def run(text: Column) -> Column:
        own = parse(text)
        return F.when(F.size(own) > 0, own).otherwise(react(text))

    return run


def _mistral(text: Column) -> Column:
    """Without a list no call at all; a list without a call falls back."""
    own = mistral(text)
    return F.when(own.isNull(), _none()).when(F.size(own) > 0, own).otherwise(react(text))


def _ended(end: str) -> Callable[[Column], Column]:
    """The end token goes before anything is read, the fallback included."""
    return lambda text: _with_fallback(llama)(without_end(text, end))


PARSERS: dict[str, Callable[[Column], Column]] = {k: _with_fallback(f) for k, f in _OWN.items()} | {"mistral": _mistral, "llama3": _ended("<|eom_id|>"), "llama4": _ended("<|eom|>")} | {
    k: react for k in ("react_en", "react_zh", "react_grpo", "toolbench")
} | {
    k: _with_fallback(qwen) for k in ("qwen_en", "qwen_zh", "qwen_en_parallel", "qwen_zh_parallel")
}
