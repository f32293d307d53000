"""Chat rendering and loss spans, as column expressions over messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def chatml(messages: Column) -> Column:
    """ChatML text of an array of ``role, content`` structs."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))), "")


def loss_spans(messages: Column, strategy: str = "default") -> Column:
    """Weight of each message: default all assistants, last_round the last one, all everything."""
    def of(m: Column, i: Column) -> Column:
        own = m["loss"]
        base = F.lit(1.0) if strategy == "all" else (m["role"] == "assistant").cast("double")
        if strategy == "last_round":
            last = F.array_max(F.transform(messages, lambda x, k: F.when(x["role"] == "user", k).otherwise(-1)))
            base = F.when((m["role"] == "assistant") & (i > last), 1.0).otherwise(0.0)
        return F.coalesce(own, base)

    return F.transform(messages, of)


def split_chunks(tokens: Column, length: int) -> Column:
    """Chunks of at most ``length`` tokens."""
    n = F.size(tokens)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(length)), lambda i: F.slice(tokens, i + 1, F.lit(length)))).otherwise(F.array())


def truncate(tokens: Column, length: int, side: str = "right") -> Column:
    """Keeps the first (right) or the last (left) ``length`` tokens."""
    n = F.size(tokens)
    return F.slice(tokens, F.lit(1), F.lit(length)) if side == "right" else F.slice(tokens, F.greatest(F.lit(1), n - length + 1), F.lit(length))
