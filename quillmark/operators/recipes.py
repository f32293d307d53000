"""Row rules of particular datasets, as column expressions.

Each recipe is DataFrame -> DataFrame and is found by name in ``RECIPES``; a
registry entry names one as its ``transform``. Random choices are keyed by a
hash of the row, so they do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import strip
from quillmark.operators.normalize import MESSAGES, from_alpaca, from_messages, from_response, message

RECIPES: dict[str, Callable[..., DataFrame]] = {}


def recipe(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    RECIPES[f.__name__] = f
    return f


def choice(options: Column, *keys: Column) -> Column:
    return F.when(F.size(options) > 0, F.get(options, F.pmod(F.xxhash64(*keys), F.size(options)).cast("int")))


def said(*turns: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[message(r, c) for r, c in turns]), lambda m: m["content"].isNotNull()).cast(MESSAGES)


@recipe
def alpaca_zh(df: DataFrame) -> DataFrame:
    """The mark 输入： before an input goes."""
    return from_alpaca(df.withColumn("input", F.regexp_replace("input", r"\A输入：", "")))


@recipe
def long_alpaca(df: DataFrame) -> DataFrame:
    return from_alpaca(df.withColumn("output", strip(F.regexp_replace("output", r"\AAnswer: ", ""))))


@recipe
def numbered_titles(df: DataFrame) -> DataFrame:
    """Title (else content) and abstract; what follows a number and a separator counts. Assistant only."""
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    title = F.coalesce(col("title"), col("content"))
    title = F.when((col("abs") != "") & (col("abs") != title), F.concat(title, F.lit("，"), col("abs"))).otherwise(title)
    after = r"[0-9]+[.,\s、](.+)"
    title = F.when(title.rlike(after), F.regexp_extract(title, after, 1)).otherwise(title)
    return df.withColumn("messages", said(("assistant", title))).where(title != "")


@recipe
def by_kind(df: DataFrame, kinds: list[str], column: str = "kind") -> DataFrame:
    return from_response(df.where(F.col(column).isin(*kinds)))


@recipe
def without_source(df: DataFrame, sources: list[str], column: str = "source") -> DataFrame:
    return from_messages(df.where(~F.coalesce(F.col(column).isin(*sources), F.lit(False))))


@recipe
def without_phrases(df: DataFrame, phrases: list[str], default_system: str = "") -> DataFrame:
    """Drops rows in which any message has one of the phrases; a default system message goes."""
    df = from_messages(df)
    bad = F.exists("messages", lambda m: F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(F.lower(m["content"]), p)))
    first = F.get("messages", F.lit(0))
    lead = (first["role"] == "system") & (first["content"] == default_system)
    return df.where(~bad).withColumn("messages", F.when(lead, F.slice("messages", 2, F.size("messages"))).otherwise(F.col("messages")))


@recipe
def several_plugins(df: DataFrame, pattern: str = r'"plugin_name":\s*"(.*?)"', least: int = 2) -> DataFrame:
    """Keeps rows that open with a system message naming several plugins."""
    df = from_messages(df)
    first = F.get("messages", F.lit(0))
    names = F.array_distinct(F.regexp_extract_all(first["content"], F.lit(pattern), F.lit(1)))
    return df.where((first["role"] == "system") & (F.size(names) >= least))


@recipe
def text_to_sql(df: DataFrame) -> DataFrame:
    query = F.concat(F.lit("Sql Table information:\n"), F.col("sql_context"), F.lit("\n"), F.col("sql_prompt"))
    response = F.concat(F.lit("Let's think step by step:\n"), F.col("sql_explanation"), F.lit("\nSo the final sql is:\n"), F.col("sql"))
    return df.withColumn("messages", said(("user", query), ("assistant", response)))


@recipe
def caller_conclusion(df: DataFrame) -> DataFrame:
    """Roles caller and conclusion are assistants; two turns exactly."""
    df = from_messages(df)
    turned = F.transform("messages", lambda m: F.struct(F.when(m["role"].isin("caller", "conclusion"), "assistant").otherwise(m["role"]).alias("role"), m["content"].alias("content"), m["loss"].alias("loss")))
    return df.withColumn("messages", turned).where(F.size("messages") == 2)


@recipe
def answer_appended(df: DataFrame) -> DataFrame:
    return from_response(df.withColumn("output", F.concat("output", F.lit("\n\nAnswer: "), F.col("answer"))).drop("answer"))


@recipe
def law_text(df: DataFrame) -> DataFrame:
    """Type, title, chapters and text, nulls skipped. Assistant only."""
    parts = [F.col(c) for c in ("type", "title", "chapter1", "chapter2", "chapter3", "response") if c in df.columns]
    return df.withColumn("messages", said(("assistant", F.concat_ws("\n", *parts))))


@recipe
def split_at_code(df: DataFrame, column: str = "code_with_problem", mark: str = "```python") -> DataFrame:
    """The text before the code is the query, the code and an explanation the response."""
    c = F.col(column)
    at = F.instr(c, mark)
    response = F.concat_ws("\n\n", F.substr(c, at), F.col("explanation_only") if "explanation_only" in df.columns else F.lit(None).cast("string"))
    return df.where(at > 0).withColumn("messages", said(("user", F.substr(c, F.lit(1), at - 1)), ("assistant", response)))


@recipe
def similar_pairs(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Anchor, positive and label of scored sentence pairs, from a score on."""
    if threshold is not None:
        df = df.where(F.col("score") >= threshold)
    return df.select(said(("user", F.col("sentence1"))).alias("messages"), F.array(said(("user", F.col("sentence2")))).alias("positive_messages"), F.col("score").cast("double").alias("label"))


@recipe
def rerank_lists(df: DataFrame) -> DataFrame:
    each = lambda c: F.transform(c, lambda x: F.array(message("assistant", x)).cast(MESSAGES))
    return df.select(said(("user", F.col("query"))).alias("messages"), each("positive").alias("positive_messages"), each("negative").alias("negative_messages"))


@recipe
def folded_history(df: DataFrame, column: str = "conversations") -> DataFrame:
    """All but the last two turns join the system text; rows with an empty answer go."""
    c = F.col(column)
    n = F.size(c)
    past = F.array_join(F.transform(F.slice(c, F.lit(2), F.greatest(n - 3, F.lit(0))), lambda m: F.concat(m["from"], F.lit(": "), m["value"])), "\n")
    system = F.concat(F.get(c, F.lit(0))["value"], F.when(past != "", F.concat(F.lit("\n"), past)).otherwise(""))
    ask, answer = F.get(c, n - 2)["value"], F.get(c, n - 1)["value"]
    return df.withColumn("messages", said(("system", system), ("user", ask), ("assistant", answer))).where((n >= 3) & (answer != ""))


@recipe
def countdown(df: DataFrame) -> DataFrame:
    """An arithmetic task from ``nums`` and a target, which is kept."""
    numbers = F.concat(F.lit("["), F.array_join(F.transform("nums", lambda x: x.cast("string")), ", "), F.lit("]"))
    query = F.concat(
        F.lit("Combine the numbers "), numbers, F.lit(" with + - * / into an equation whose value is "), F.col("response").cast("string"),
        F.lit(". Use each number once. Think inside <think> </think> and give the equation inside <answer> </answer>."))
    return df.withColumn("target", F.col("response")).withColumn("messages", said(("user", query)))


@recipe
def human_or_machine(df: DataFrame, classify: bool = False) -> DataFrame:
    """Two rows of each: a human's and a machine's answer to the question, with the class."""
    def row(kind: str, answers: str, label: int) -> Column:
        text = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer: "), choice(F.col(answers), F.col("question"), F.lit(kind)))
        return F.struct(said(("user", text), *([] if classify else [("assistant", F.lit(kind))])).alias("messages"), F.lit(label).alias("label"))

    return df.select(F.inline(F.array(row("Human", "human_answers", 0), row("ChatGPT", "chatgpt_answers", 1))))


@recipe
def separated_question(df: DataFrame, column: str = "text1", mark: str = r"\[SEP\]") -> DataFrame:
    parts = F.split(column, mark)
    ask = F.concat(F.lit("Answer: "), strip(parts[0]), F.lit("\nContext: "), strip(F.get(parts, F.lit(1))))
    return df.withColumn("messages", said(("user", ask), ("assistant", F.col("text2")))).where(F.size(parts) == 2)


@recipe
def chosen_rejected(df: DataFrame) -> DataFrame:
    """Marked dialogues, chosen and rejected, to messages; the marks alternate."""
    def turns(c: str) -> Column:
        body = F.regexp_replace(strip(F.col(c)), r"\AHuman:", "")
        parts = F.transform(F.split(body, "\n\nHuman:|\n\nAssistant:|\n\nHum:"), lambda p: strip(p))
        even = F.slice(parts, F.lit(1), F.floor(F.size(parts) / 2).cast("int") * 2)
        return F.transform(even, lambda p, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), p)).cast(MESSAGES)

    return df.withColumn("messages", turns("chosen")).withColumn("rejected_messages", turns("rejected"))


@recipe
def function_answers(df: DataFrame) -> DataFrame:
    """A JSON list of calls becomes one tool_call message each."""
    calls = F.from_json("answers", "array<struct<name:string,arguments:map<string,string>>>")
    out = F.concat(F.array(message("user", F.col("query"))), F.transform(calls, lambda c: message("tool_call", F.to_json(c))))
    return df.withColumn("messages", out.cast(MESSAGES))


@recipe
def function_description(df: DataFrame) -> DataFrame:
    """Descriptions parted by blank lines become tools; the system message goes."""
    df = from_messages(df)
    lead = F.get("messages", F.lit(0))["role"] == "system"
    tools = F.when(F.col("function_description") != "", F.to_json(F.split("function_description", "\n\n")))
    return df.withColumn("tools", tools).withColumn("messages", F.when(lead, F.slice("messages", 2, F.size("messages"))).otherwise(F.col("messages")))


@recipe
def without_variation_selectors(df: DataFrame, columns: tuple[str, ...] = ("response", "rejected_response")) -> DataFrame:
    for c in columns:
        if c in df.columns:
            df = df.withColumn(c, F.replace(c, F.lit("️"), F.lit("")))
    return from_response(df)


@recipe
def marked_dialogue(df: DataFrame) -> DataFrame:
    """User/Assistant marks inside the instruction are a history and must alternate, with nothing blank."""
    marks = r"(User[:：]|Ass?s?isten[tz][:：]|Assistant[:：])"
    names = F.transform(F.regexp_extract_all("instruction", F.lit(marks), F.lit(1)), lambda m: F.startswith(m, F.lit("User")))
    parts = F.split("instruction", marks)
    texts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    fine = (F.coalesce(F.col("instruction"), F.lit("")) == "") | (
        (parts[0] == "") & (F.size(names) % 2 == 0) & F.forall(F.transform(names, lambda n, i: n == (i % 2 == 0)), lambda x: x) & F.forall(texts, lambda t: strip(t) != ""))
    past = F.when(F.coalesce(F.col("instruction"), F.lit("")) != "", F.transform(texts, lambda t, i: message(F.when(i % 2 == 0, "user").otherwise("assistant"), t))).otherwise(F.array())
    ask = F.when(F.startswith("input", F.lit("User:")), strip(F.substr("input", F.lit(6)))).otherwise(F.col("input"))
    return df.where(fine).withColumn("messages", F.concat(past.cast(MESSAGES), said(("user", ask), ("assistant", F.col("output")))))


#: Fixed wording.
CONTEXT_LEAD = "Here gives some useful information:\n"


@recipe
def with_context(df: DataFrame, lead: str = CONTEXT_LEAD) -> DataFrame:
    query = F.concat(F.when(F.col("context") != "", F.concat(F.lit(lead), F.col("context"), F.lit("\n"))).otherwise(""), F.col("instruction"))
    return df.withColumn("messages", said(("user", query), ("assistant", F.col("response"))))


@recipe
def self_cognition(df: DataFrame, name: tuple[str, str], author: tuple[str, str]) -> DataFrame:
    """{{NAME}} and {{AUTHOR}} by the language of the tag (Chinese, else English)."""
    for c in ("query", "response"):
        for mark, (zh, en) in (("{{NAME}}", name), ("{{AUTHOR}}", author)):
            df = df.withColumn(c, F.replace(c, F.lit(mark), F.when(F.col("tag") == "zh", zh).otherwise(en)))
    return from_response(df)


@recipe
def prompt_template(df: DataFrame, prompt: str) -> DataFrame:
    df = df.withColumnRenamed("prompt", "query") if "prompt" in df.columns else df
    return from_response(df.withColumn("query", F.replace(F.lit(prompt), F.lit("{{QUERY}}"), F.col("query"))))


@recipe
def class_prompt(df: DataFrame, labels: list[str], task: str, pair: bool = False) -> DataFrame:
    """A classification prompt with its categories; the label's name answers; no label, no row."""
    body = F.concat(F.lit("Sentence1: "), F.col("sentence1"), F.lit("\nSentence2: "), F.col("sentence2")) if pair else F.concat(F.lit("Sentence: "), F.col("sentence"))
    query = F.concat(F.lit(f"Task: {task}\n"), body, F.lit("\nCategory: " + ", ".join(labels) + "\nOutput:"))
    answer = F.get(F.array(*[F.lit(x) for x in labels]), F.col("label").cast("int"))
    return df.where("label IS NOT NULL").withColumn("messages", said(("user", query), ("assistant", answer)))


@recipe
def constant_query(df: DataFrame, query: str) -> DataFrame:
    return from_response(df.withColumn("query", F.lit(query)))


@recipe
def existing_media(df: DataFrame, files: DataFrame, column: str = "images") -> DataFrame:
    """Keeps rows all of whose files are in a listing (column ``path``)."""
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    missing = keyed.select("__row", F.explode(column).alias("path")).join(files.select("path").distinct(), "path", "left_anti").select("__row").distinct()
    return keyed.join(missing, "__row", "left_anti").drop("__row")


@recipe
def choice_answer(df: DataFrame) -> DataFrame:
    """The response is the choice at the index ``answer``."""
    return df.withColumn("messages", said(("user", F.col("question")), ("assistant", F.get("choices", F.col("answer").cast("int")))))


@recipe
def one_of_pairs(df: DataFrame) -> DataFrame:
    """One of the parallel lists of questions and answers, chosen by a hash."""
    at = F.pmod(F.xxhash64(F.array_join("questions", "|")), F.size("questions")).cast("int")
    return df.where(F.size("questions") > 0).withColumn("messages", said(("user", F.get("questions", at)), ("assistant", F.get("answers", at))))


@recipe
def content_parts(df: DataFrame, column: str = "messages") -> DataFrame:
    """Lists of text and image parts become text with tags."""
    text = lambda m: F.array_join(F.transform(m["content"], lambda p: F.when(p["type"] == "image", "<image>").otherwise(p["text"])), "")
    return df.withColumn("messages", F.transform(column, lambda m: message(m["role"], text(m))).cast(MESSAGES))


@recipe
def multi_label(df: DataFrame, column: str = "npy") -> DataFrame:
    """Indices of the ones of a one-hot list."""
    return df.withColumn("label", F.filter(F.transform(column, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull()))
