"""Four raw record shapes to one conversation schema, as plan-time dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import without_thoughts

MESSAGES = "array<struct<role:string,content:string,loss:double>>"
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")
STANDARD = [p + k for p in ("", "rejected_", "positive_", "negative_") for k in ("messages", "images", "videos", "audios", "tools", "objects")] + ["rejected_response", "label", "channel", "margin"]
#: Column names that mean the same (fixed values).
ALIASES = {
    "system": ["system", "system_prompt"],
    "query": ["query", "prompt", "input", "instruction", "question", "problem"],
    "response": ["response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content"],
}
MEDIA = {"images": ["image", "images"], "audios": ["audio", "audios"], "videos": ["video", "videos"]}
MESSAGE_COLUMNS = ("messages", "conversation", "conversations")


def plan_renames(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Old name -> new name. A target with more than one match is left alone."""
    lower, out = {c.lower(): c for c in columns}, {}
    for target, names in aliases.items():
        hits = [lower[n.lower()] for n in names if n.lower() in lower]
        if len(hits) == 1 and hits[0] != target:
            out[hits[0]] = target
    return out


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The user's renames (old -> new), case-insensitive, then the media aliases."""
    wanted: dict[str, list[str]] = {}
    for old, new in columns.items():
        wanted.setdefault(new, []).append(old)
    df = df.withColumnsRenamed(plan_renames(df.columns, wanted))
    return df.withColumnsRenamed(plan_renames(df.columns, MEDIA))


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.cast("string").alias("content"), F.lit(None).cast("double").alias("loss"))


def _said(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["content"].isNotNull()).cast(MESSAGES)


def history_to_messages(history: Column, query: Column, response: Column, system: Column) -> Column:
    past = F.flatten(F.transform(F.coalesce(history, F.array().cast("array<array<string>>")), lambda t: F.array(message("user", F.get(t, F.lit(0))), message("assistant", F.get(t, F.lit(1))))))
    return _said(F.concat(F.array(message("system", system)), past, F.array(message("user", query), message("assistant", response))))


def from_response(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed(plan_renames(df.columns, ALIASES))
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    response = F.get("response", F.lit(0)) if "response" in df.columns and isinstance(df.schema["response"].dataType, T.ArrayType) else col("response")
    history = F.lit(None).cast("array<array<string>>")
    if "history" in df.columns:
        text = df.schema["history"].dataType == T.StringType()
        # Either kind of quote is read, so a quote inside the other kind stays as it is.
        literal = F.regexp_replace("history", r"(?<=[\[,]|[\[,] )None(?=\s*[,\]])", "null")
        history = F.from_json(literal, "array<array<string>>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}) if text else F.col("history")
    return df.withColumn("messages", history_to_messages(history, col("query"), response, col("system")))


def from_alpaca(df: DataFrame) -> DataFrame:
    a, b = F.coalesce("instruction", F.lit("")), F.coalesce("input", F.lit(""))
    query = F.when((a != "") & (b != ""), F.concat(a, F.lit("\n"), b)).when(a != "", a).otherwise(b)
    return from_response(df.withColumn("query", query).drop("instruction", "input").withColumnsRenamed({"output": "response"} if "output" in df.columns else {}))


def normal_role(role: Column) -> Column:
    r = F.regexp_replace(F.lower(role), "-", "_")
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "gpt", "bot"), "assistant").when(r == "function_call", "tool_call").when(r.isin("function_response", "observation", "observations"), "tool_response").otherwise(r)


def standard_messages(df: DataFrame, name: str) -> Column:
    """A column with role/from and content/value, or human/assistant pairs, in the standard form."""
    keys = df.schema[name].dataType.elementType.names
    pick = lambda options: next((k for k in options if k in keys), None)
    role, content = pick(("role", "from")), pick(("content", "value"))
    if role and content:
        loss = (lambda m: m["loss"].cast("double")) if "loss" in keys else (lambda m: F.lit(None).cast("double"))
        return F.transform(name, lambda m: F.struct(normal_role(m[role]).alias("role"), m[content].cast("string").alias("content"), loss(m).alias("loss")))
    user, bot = pick(("human", "user")), pick(("assistant", "gpt", "bot"))
    return F.flatten(F.transform(name, lambda m: F.array(message("user", m[user]), message("assistant", m[bot]))))


def from_messages(df: DataFrame) -> DataFrame:
    """The message column and, where there are any, the rejected messages; a system column leads the first."""
    name = next(c for c in MESSAGE_COLUMNS if c in df.columns)
    out = standard_messages(df, name)
    if "rejected_messages" in df.columns:
        df = df.withColumn("rejected_messages", standard_messages(df, "rejected_messages").cast(MESSAGES))
    if "system" in df.columns:
        lead = F.col("system").isNotNull() & F.coalesce(F.get(out, F.lit(0))["role"] != "system", F.lit(True))
        out = F.when(lead, F.concat(F.array(message("system", F.col("system"))), out)).otherwise(out)
    return df.withColumn("messages", out.cast(MESSAGES))


def normalize(df: DataFrame, strict: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chooses the shape from the columns, normalises, drops (or refuses) bad rows."""
    if any(c in df.columns for c in MESSAGE_COLUMNS):
        out = from_messages(df)
    elif "instruction" in df.columns and "input" in df.columns:
        out = from_alpaca(df)
    else:
        out = from_response(df)
    out = out.select(*[c for c in STANDARD if c in out.columns], *[c for c in keep if c in out.columns and c not in STANDARD])
    valid = valid_messages(F.col("messages"))
    if "rejected_response" in out.columns:
        valid = valid & F.coalesce(valid_rejected(F.col("messages"), F.col("rejected_response")), F.lit(False))
    if "objects" in out.columns and isinstance(out.schema["objects"].dataType, T.StructType) and "bbox" in out.schema["objects"].dataType.names:
        valid = valid & valid_boxes(F.col("objects.bbox"))
    if strict:
        return out.withColumn("messages", F.when(valid, F.col("messages")).otherwise(F.raise_error(F.lit("bad record"))))
    return out.where(valid)


def classes(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Response records whose label is an integer; rows whose label is none go."""
    return normalize(df, keep=keep).withColumn("label", F.expr("try_cast(label AS bigint)")).where("label IS NOT NULL")


#: Questions and answers of grounding and captioning, by language (fixed values).
GROUNDING = {
    ("grounding", "en"): [
        ("<ref-object>", "<bbox>"), ("The positions of <ref-object> is", "<bbox>"), ("Find the positions of <ref-object>", "<bbox>"), ("Where is <ref-object>", "<bbox>"), ("Find <ref-object>", "<bbox>"),
        ("Show me <ref-object>", "<bbox>"), ("Detect <ref-object>", "<bbox>"), ("Locate <ref-object>", "<bbox>"), ("Tell me the location of <ref-object>", "<bbox>"),
        ("Give the location of <ref-object>", "<bbox>"), ("Provide the bounding box coordinate of <ref-object>", "<bbox>"),
    ],
    ("grounding", "zh"): [
        ("<ref-object>", "<bbox>"), ("<ref-object>的位置在图片中", "<bbox>"), ("<ref-object>在图片中", "<bbox>"), ("<ref-object>在", "<bbox>"), ("找到<ref-object>的位置", "<bbox>"),
        ("<ref-object>在哪里", "<bbox>"), ("提供<ref-object>的坐标位置", "<bbox>"),
    ],
    ("caption", "en"): [
        ("<bbox>", "<ref-object>"), ("The object at position <bbox>", "<ref-object>"), ("This <bbox> is", "<ref-object>"), ("What is the object at <bbox>", "<ref-object>"), ("Describe <bbox>", "<ref-object>"),
        ("<bbox> is", "<ref-object>"), ("The bounding box coordinate <bbox> contains", "<ref-object>"),
    ],
    ("caption", "zh"): [
        ("<bbox>", "<ref-object>"), ("<bbox>是什么", "<ref-object>"), ("<bbox>的位置包含", "<ref-object>"), ("描述<bbox>", "<ref-object>"), ("<bbox>中是", "<ref-object>"),
        ("坐标<bbox>描述了什么", "<ref-object>"), ("描述<bbox>中的事物", "<ref-object>"),
    ],
}


def grounding_prompt(language: Column, choice: Column, task: str) -> Column:
    """Query and response for two uniform numbers: English below 0.8, else Chinese, then one of its prompts."""
    def of(name: str) -> Column:
        rows = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(r).alias("response")) for q, r in GROUNDING[task, name]])
        return F.get(rows, F.floor(choice * len(GROUNDING[task, name])).cast("int"))

    return F.when(language < 0.8, of("en")).otherwise(of("zh"))


def valid_messages(m: Column) -> Column:
    return F.coalesce((F.size(m) > 0) & F.forall(m, lambda x: F.coalesce(x["role"].isin(*ROLES), F.lit(False)) & x["content"].isNotNull()), F.lit(False))


def valid_rejected(m: Column, rejected: Column) -> Column:
    return rejected.isNotNull() & (rejected != F.element_at(m, -1)["content"])


def last_user_round(m: Column) -> Column:
    """Index of the last user message, -1 if there is none."""
    at = F.transform(m, lambda x, i: F.when(x["role"] == "user", i).otherwise(-1))
    return F.coalesce(F.array_max(at), F.lit(-1))


def without_old_thoughts(df: DataFrame, prefix: str = "") -> DataFrame:
    """Answers before the last user message keep only what follows their last ``</think>``, behind a prefix."""
    def of(m: Column, i: Column) -> Column:
        told = F.concat(F.lit(prefix), without_thoughts(m["content"]))
        old = (m["role"] == "assistant") & (i < F.col("__last")) & m["content"].isNotNull()
        return F.struct(m["role"].alias("role"), F.when(old, told).otherwise(m["content"]).alias("content"), m["loss"].alias("loss"))

    return df.withColumn("__last", last_user_round(F.col("messages"))).withColumn("messages", F.transform("messages", of)).drop("__last")


def remove_response(m: Column) -> tuple[Column, Column]:
    """Messages without a trailing assistant message, and its content."""
    last = F.get(m, F.size(m) - 1)
    ends = F.coalesce(last["role"] == "assistant", F.lit(False))
    return F.when(ends, F.slice(m, F.lit(1), F.size(m) - 1)).otherwise(m), F.when(ends, last["content"])


def expand_rejected(m: Column, rejected: Column) -> Column:
    """The conversation up to its last user message, answered by the rejected text."""
    return F.concat(F.slice(m, F.lit(1), last_user_round(m) + 1), F.array(message("assistant", rejected)))


def merge_tool_calls(m: Column) -> Column:
    """Runs of tool_call messages become one assistant message."""
    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        call = F.struct(F.lit("assistant").alias("role"), x["content"].alias("content"), x["loss"].alias("loss"), F.lit(True).alias("call"))
        more = F.struct(F.lit("assistant").alias("role"), F.concat(last["content"], F.lit("\n"), x["content"]).alias("content"), last["loss"].alias("loss"), F.lit(True).alias("call"))
        plain = F.struct(x["role"].alias("role"), x["content"].alias("content"), x["loss"].alias("loss"), F.lit(False).alias("call"))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more))
        is_call = x["role"] == "tool_call"
        return F.when(is_call & F.coalesce(last["call"], F.lit(False)), joined).when(is_call, F.concat(acc, F.array(call))).otherwise(F.concat(acc, F.array(plain)))

    empty = F.array().cast("array<struct<role:string,content:string,loss:double,call:boolean>>")
    return F.transform(F.aggregate(m, empty, step), lambda x: F.struct(x["role"], x["content"], x["loss"]))


def messages_to_history(m: Column) -> tuple[Column, Column, Column]:
    """History pairs, query and response; a system message at the head goes, an odd tail gets a null answer, the last pair is split off."""
    turns = F.filter(m, lambda x, i: (i > 0) | (x["role"] != "system"))
    n = F.size(turns)
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(2)), lambda i: F.array(F.get(turns, i)["content"], F.get(turns, i + 1)["content"]))).otherwise(F.array().cast("array<array<string>>"))
    last = F.get(pairs, F.size(pairs) - 1)
    return F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0))), F.get(last, F.lit(0)), F.get(last, F.lit(1))


def coerce_list(c: Column, kind: T.DataType) -> Column:
    """A single value becomes a list of one."""
    return c if isinstance(kind, T.ArrayType) else F.when(c.isNotNull(), F.array(c))


def images(c: Column, kind: T.DataType) -> Column:
    """Paths or structs, one or many, to ``array<struct<bytes,path>>``."""
    c = coerce_list(c, kind)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(inner, T.StructType):
        return F.transform(c, lambda x: F.struct((x["bytes"] if "bytes" in inner.names else F.lit(None).cast("binary")).alias("bytes"), (x["path"] if "path" in inner.names else F.lit(None).cast("string")).alias("path")))
    return F.transform(c, lambda x: F.struct(F.lit(None).cast("binary").alias("bytes"), x.alias("path")))


def valid_boxes(boxes: Column) -> Column:
    return F.coalesce(F.forall(boxes, lambda b: F.size(b).isin(2, 4)), F.lit(True))


def ordered_boxes(boxes: Column) -> Column:
    """Corners in order: the lesser x and y first."""
    def of(b: Column) -> Column:
        four = F.array(F.least(b[0], F.get(b, F.lit(2))), F.least(b[1], F.get(b, F.lit(3))), F.greatest(b[0], F.get(b, F.lit(2))), F.greatest(b[1], F.get(b, F.lit(3))))
        return F.when(F.size(b) == 4, four).otherwise(b)

    return F.transform(boxes, of)
