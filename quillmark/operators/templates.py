"""Chat templates and loss weights: conversations to weighted pieces of text.

A template says what stands around queries and answers; a loss specification
(``strategy``, ``type`` or ``strategy+type``) says what each piece weighs.
Everything is array expressions, so a conversation never leaves its row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.normalize import last_user_round

PIECES = "array<struct<text:string,weight:double>>"


@dataclass(frozen=True)
class Template:
    """``system_prefix`` replaces ``prefix`` where there is a system message; without ``chat_sep`` only the last round counts."""

    prefix: str
    prompt: str
    chat_sep: str | None
    suffix: str
    system_prefix: str | None = None
    stop_words: tuple[str, ...] = ()


_LLAMA3 = Template(
    "<|begin_of_text|>", "<|start_header_id|>user<|end_header_id|>\n\n{{QUERY}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|eot_id|>",
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{{SYSTEM}}<|eot_id|>")
_GLM_STOPS = ("<|endoftext|>", "<|user|>", "<|observation|>")

#: What public models are given (fixed values). Begin and end tokens that only a tokenizer knows are its own to add.
TEMPLATES = {
    "chatml": Template("", "<|im_start|>user\n{{QUERY}}<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>\n", "<|im_end|>\n", "<|im_start|>system\n{{SYSTEM}}<|im_end|>\n"),
    "llama": Template("<s>[INST] ", "{{QUERY}} [/INST]", "</s><s>[INST] ", "</s>", "<s>[INST] <<SYS>>\n{{SYSTEM}}\n<</SYS>>\n\n"),
    "llama3": _LLAMA3,
    "mistral_2501": Template("<s>", "[INST]{{QUERY}}[/INST]", "</s>", "</s>", "<s>[SYSTEM_PROMPT]{{SYSTEM}}[/SYSTEM_PROMPT]"),
    "gemma": Template("<bos>", "<start_of_turn>user\n{{QUERY}}<end_of_turn>\n<start_of_turn>model\n", "<end_of_turn>\n", "<end_of_turn>", "<bos><start_of_turn>system\n{{SYSTEM}}<end_of_turn>\n"),
    "deepseek_v2_5": Template("<｜begin▁of▁sentence｜>{{SYSTEM}}", "<｜User｜>{{QUERY}}<｜Assistant｜>", "<｜end▁of▁sentence｜>", "<｜end▁of▁sentence｜>"),
    "phi3": Template("", "<|user|>\n{{QUERY}}<|end|>\n<|assistant|>\n", "<|end|>\n", "<|end|>", "<|system|>\n{{SYSTEM}}<|end|>\n"),
    "phi4": Template("", "<|im_start|>user<|im_sep|>{{QUERY}}<|im_end|><|im_start|>assistant<|im_sep|>", "<|im_end|>", "<|im_end|>", "<|im_start|>system<|im_sep|>{{SYSTEM}}<|im_end|>"),
    "chatglm4": Template("", "<|user|>\n{{QUERY}}<|assistant|>\n", "", "<|user|>", "<|system|>\n{{SYSTEM}}", _GLM_STOPS),
    "glm4": Template("[gMASK]<sop>", "<|user|>\n{{QUERY}}<|assistant|>\n", "", "<|user|>", "[gMASK]<sop><|system|>\n{{SYSTEM}}", _GLM_STOPS),
    "zephyr": Template("", "<|user|>\n{{QUERY}}</s>\n<|assistant|>\n", "</s>\n", "</s>", "<|system|>\n{{SYSTEM}}</s>\n"),
    "sus": Template("{{SYSTEM}}", "### Human: {{QUERY}}\n\n### Assistant: ", "<|endoftext|>", "<|endoftext|>"),
    "orion": Template("<s>{{SYSTEM}}", "Human: {{QUERY}}\n\nAssistant: </s>", "</s>", "</s>"),
    "skywork": Template("<s>{{SYSTEM}}", "</s><s>[USER]{{QUERY}}[SEP][BOT]", None, "[SEP]</s>"),
    "baichuan_m1": Template("", "<C_Q>{{QUERY}}<C_A>", "", "<C_A>", "<B_SYS>{{SYSTEM}}"),
}

STRATEGIES = ("default", "last_round", "all")

#: Weights of a key and of the text after it, or of what a pattern finds; other text weighs 1 (fixed values).
LOSS_TYPES: dict[str, dict[str, list[float]]] = {
    "base": {},
    "ignore_empty_think": {
        r"^<think>\s*</think>\s*": [0.0],
        "^<seed:think><seed:cot_budget_reflect>The current thinking budget is 0, so I will directly start answering the question.</seed:cot_budget_reflect>\n</seed:think>\\s*": [0.0],
        r"^</think>\s*": [0.0],
    },
    "react": {"Action:": [2.0, 2.0], "Action Input:": [2.0, 2.0], "Thought:": [1.0, 1.0], "Final Answer:": [1.0, 1.0], "Observation:": [2.0, 0.0]},
    "hermes": {"<tool_call>.+?</tool_call>": [2.0]},
    "qwen": {"✿FUNCTION✿:": [2.0, 2.0], "✿ARGS✿:": [2.0, 2.0], "✿RETURN✿:": [1.0, 1.0], "✿RESULT✿:": [2.0, 0.0]},
    "agentflan": {
        "Name:": [1.0, 3.0], "Action:": [1.0, 3.0], "ACTION:": [1.0, 3.0], "Tool:": [1.0, 3.0], "Command": [1.0, 3.0], "Arguments:": [1.0, 3.0], "action input": [1.0, 3.0],
        "ACTION_INPUT:": [1.0, 3.0], "Action Input:": [1.0, 3.0], "Thought:": [1.0, 1.0], "Final Answer:": [1.0, 1.0], "Observation:": [2.0, 0.0],
    },
    "alpha_umi": {"Action:": [2.0, 2.0], "Action Input:": [2.0, 2.0], "Thought:": [1.0, 1.0], "Final Answer:": [1.0, 1.0], "Observation:": [2.0, 0.0]},
}
#: What an answer as a whole weighs if its query holds the key (fixed values).
QUERY_WEIGHTS: dict[str, dict[str, float]] = {
    "agentflan": {"What is the tool you want to use": 3.0, "What are the required parameter names": 3.0, "What is the value of": 3.0, "What are the required parameter names for this tool": 3.0},
}


def parse_loss(spec: str) -> tuple[str, str]:
    """Strategy and type of ``default``, ``react`` or ``last_round+react``."""
    first, plus, rest = spec.partition("+")
    strategy, kind = (first, rest) if plus else (first, "base") if first in STRATEGIES else ("default", first)
    if strategy not in STRATEGIES or kind not in LOSS_TYPES:
        raise ValueError(f"no loss specification: {spec}")
    return strategy, kind


def is_binary(spec: str) -> bool:
    """Whether all weights are 0 or 1, so that masked labels say it all."""
    kind = parse_loss(spec)[1]
    return kind not in QUERY_WEIGHTS and all(w in (0.0, 1.0) for ws in LOSS_TYPES[kind].values() for w in ws)


def piece(text: Column | str, weight: Column | float) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.struct(text.alias("text"), weight.alias("weight"))


def _choose(cases: list[tuple[Column, float]]) -> Column:
    out = F.lit(1.0)
    for test, weight in reversed(cases):
        out = F.when(test, F.lit(float(weight))).otherwise(out)
    return out


def weighted(text: Column, kind: str, query: Column | None = None) -> Column:
    """An answer as weighted pieces that together are the answer."""
    table, whole = LOSS_TYPES[kind], F.array(piece(text, 1.0))
    if not table:
        return whole
    keyed = all(len(w) == 2 for w in table.values())
    pattern = "(?sU)(" + "|".join(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", k) if keyed else f"(?:{k})" for k in table) + ")"
    found = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))

    def of(key: Column, after: Column) -> Column:
        if keyed:
            weigh = lambda side: _choose([(key == k, w[side]) for k, w in table.items()])
            return F.array(piece(key, weigh(0)), piece(after, weigh(1)))
        weigh_text = lambda x: _choose([(x.rlike("^(?sU)(?:" + k + ")"), w[0]) for k, w in table.items()])
        return F.array(piece(key, weigh_text(key)), piece(after, weigh_text(after)))

    out = F.flatten(F.zip_with(found, F.split(text, pattern, -1), of))
    for key, weight in (QUERY_WEIGHTS.get(kind, {}) if query is not None else {}).items():
        out = F.when(query.contains(key), F.array(piece(text, weight))).otherwise(out)
    return out


def with_pieces(df: DataFrame, template: str | Template = "chatml", loss: str = "default", default_system: str | None = None, name: str = "pieces") -> DataFrame:
    """Adds the conversation of ``messages`` as ``array<struct<text, weight>>``.

    An answer's own ``loss`` (zero or not) goes before the strategy. ``tool``
    turns stand as they are; an answer before one has no separator after it. The
    suffix follows the last answer unless that ends with a stop word. Null
    messages give null, no messages the prefix alone; null contents are empty.
    """
    t = TEMPLATES[template] if isinstance(template, str) else template
    strategy, kind = parse_loss(loss)
    bare, lead = (t.prefix.replace("{{SYSTEM}}", ""), t.prefix) if "{{SYSTEM}}" in t.prefix else (t.prefix, t.system_prefix if t.system_prefix is not None else t.prefix)
    has = F.coalesce(F.get("messages", F.lit(0))["role"] == "system", F.lit(False))
    system = F.coalesce(F.when(has, F.get("messages", F.lit(0))["content"]), F.lit(default_system), F.lit(""))
    turns = F.when(has, F.slice("messages", F.lit(2), F.size("messages"))).otherwise(F.col("messages"))
    df = df.withColumn("__system", system).withColumn("__turns", turns)
    if t.chat_sep is None:
        n = F.size("__turns")
        from_end = F.when(F.get("__turns", n - 1)["role"] == "assistant", 1).otherwise(0)
        df = df.withColumn("__turns", F.when(n > 0, F.slice("__turns", F.greatest(n - from_end, F.lit(1)), F.lit(2))).otherwise(F.col("__turns")))
    df = df.withColumn("__last_user", last_user_round(F.col("__turns")))
    turns, other = F.col("__turns"), 1.0 if strategy == "all" else 0.0
    before, _, after = t.prompt.partition("{{QUERY}}")
    opening, _, closing = lead.partition("{{SYSTEM}}")

    def of(m: Column, i: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        asked = F.array(piece(F.when(m["role"] == "tool", content).otherwise(F.concat(F.lit(before), content, F.lit(after))), other))
        by_strategy = i > F.col("__last_user") if strategy == "last_round" else F.lit(True)
        counts = F.when(m["loss"].isNotNull(), m["loss"] != 0).otherwise(by_strategy)
        said = F.when(counts, weighted(content, kind, F.get(turns, i - 1)["content"])).otherwise(F.array(piece(content, 0.0)))
        stops = F.lit(False)
        for word in t.stop_words:
            stops = stops | content.endswith(word)
        is_last, before_tool = i == F.size(turns) - 1, F.coalesce(F.get(turns, i + 1)["role"] == "tool", F.lit(False))
        end = F.when(is_last, F.when(stops, F.array().cast(PIECES)).otherwise(F.array(piece(t.suffix, 1.0)))).when(before_tool, F.array().cast(PIECES)).otherwise(F.array(piece(t.chat_sep or "", other)))
        return F.when(m["role"] == "assistant", F.concat(said, end)).otherwise(asked)

    start = F.when(F.col("__system") != "", F.concat(F.lit(opening), F.col("__system"), F.lit(closing))).otherwise(F.lit(bare))
    pieces = F.concat(F.array(piece(start, other)), F.flatten(F.transform("__turns", of)))
    return df.withColumn(name, F.filter(pieces, lambda p: p["text"] != "").cast(PIECES)).drop("__system", "__turns", "__last_user")


def rendered(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")
