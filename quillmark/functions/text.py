"""Extractors over model outputs and small text rules, as column expressions.

A miss is null, never an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def answer_block(text: Column) -> Column:
    """The first ``<answer>`` block, trimmed."""
    return strip(_group(text, r"(?is)<answer>(.*?)</answer>"))


def last_answer_block(text: Column) -> Column:
    every = F.regexp_extract_all(text, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1))
    return F.when(F.size(every) > 0, strip(F.element_at(every, -1)))


def string_field(text: Column, name: str) -> Column:
    """A named field, double-quoted, single-quoted or bare; the first form that hits."""
    return F.coalesce(
        _group(text, rf'(?is)"{name}"\s*:\s*"([^"]*)"'),
        _group(text, rf"(?is)'{name}'\s*:\s*'([^']*)'"),
        strip(_group(text, rf"(?is)\b{name}\s*[:=]\s*([^,;\n}}\"']+)")),
    )


def numeric_field(text: Column, name: str) -> Column:
    number = r"([-+]?[0-9]+(?:\.[0-9]+)?)"
    return F.coalesce(
        _group(text, rf'(?is)"{name}"\s*:\s*"?{number}'),
        _group(text, rf"(?is)'{name}'\s*:\s*'?{number}"),
        _group(text, rf"(?is)\b{name}\s*[:=]\s*{number}"),
    ).try_cast("double")


def json_objects(text: Column) -> Column:
    """The fenced block first, then every shortest ``{...}``; only what parses as an object."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    loose = F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0))
    return F.filter(F.concat(fenced, loose), lambda x: F.get_json_object(x, "$").isNotNull())


def first_json(text: Column) -> Column:
    """The first text of ``json_objects``."""
    return F.get(json_objects(text), F.lit(0))


def maybe_float(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("double")


def _point(lat: Column, lon: Column, known: Column) -> Column:
    return F.when(known, F.struct(lat.alias("lat"), lon.alias("lon")))


def latlon(text: Column) -> Column:
    """``struct<lat,lon>`` or null.

    First the JSON object of the answer block, then that of the whole text,
    both without a check of range; then labelled numbers in range, a labelled
    or bracketed pair, and at last the first two numbers if they are in range.
    """
    block = answer_block(text)
    said = F.coalesce(F.when(block != "", block), text)

    def of_json(x: Column) -> Column:
        field = lambda *names: F.coalesce(*[maybe_float(F.get_json_object(x, f"$.{n}")) for n in names])
        lat, lon = field("latitude", "lat"), field("longitude", "lon", "lng")
        return _point(lat, lon, lat.isNotNull() & lon.isNotNull())

    def in_range(lat: Column, lon: Column) -> Column:
        return _point(lat, lon, lat.between(-90, 90) & lon.between(-180, 180))

    number = r"([-]?[0-9]+(?:\.[0-9]+)?)"
    lat = F.coalesce(numeric_field(said, "latitude"), numeric_field(said, "lat"))
    lon = F.coalesce(numeric_field(said, "longitude"), numeric_field(said, "lon"), numeric_field(said, "lng"))
    patterns = [rf"(?i)latitude\s*[:=]\s*{number}\D+longitude\s*[:=]\s*{number}", rf"(?i)lat\s*[:=]\s*{number}\D+lon(?:gitude)?\s*[:=]\s*{number}", rf"\(\s*{number}\s*,\s*{number}\s*\)"]
    pairs = [_point(F.regexp_extract(said, p, 1).try_cast("double"), F.regexp_extract(said, p, 2).try_cast("double"), said.rlike(p)) for p in patterns]
    every = F.regexp_extract_all(said, F.lit(number), F.lit(1))
    return F.coalesce(of_json(first_json(block)), of_json(first_json(text)), in_range(lat, lon), *pairs, in_range(F.get(every, F.lit(0)).try_cast("double"), F.get(every, F.lit(1)).try_cast("double")))


def answer_text(text: Column) -> Column:
    """The place that an output names: ``FinalAnswer`` of its JSON or as a field, else a short answer without tags."""
    block = answer_block(text)
    said = F.coalesce(F.when(block != "", block), strip(text))
    found = first_json(said)
    final = F.when(found.rlike(r'"FinalAnswer"\s*:\s*"'), strip(F.get_json_object(found, "$.FinalAnswer")))
    plain = strip(strip_quotes(said))
    short = (plain != "") & ~F.contains(plain, F.lit("<")) & ~F.contains(plain, F.lit(">")) & (F.length(plain) <= 300)
    some = lambda x: F.when(x != "", x)
    return F.coalesce(some(final), some(string_field(said, "FinalAnswer")), F.when(short, plain))


def judge_verdict(text: Column) -> Column:
    """``struct<score,verdict,reason>``: the last JSON object with all three, else the fields of the text; null for placeholders."""
    def of(x: Column) -> Column:
        get = lambda n: F.coalesce(F.get_json_object(x, f"$.{n}"), F.lit("None"))
        return F.struct(maybe_float(F.get_json_object(x, "$.score")).alias("score"), get("verdict").alias("verdict"), get("reason").alias("reason"))

    def real(v: Column) -> Column:
        return v["score"].isNotNull() & (F.trim(v["verdict"]) != "...") & (F.trim(v["reason"]) != "...")

    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
    loose = F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0))
    whole = F.filter(F.concat(fenced, loose), lambda x: F.get_json_object(x, "$").isNotNull() & F.coalesce(F.size(F.array_intersect(F.json_object_keys(x), F.array(F.lit("score"), F.lit("verdict"), F.lit("reason")))) == 3, F.lit(False)))
    good = F.filter(F.transform(whole, of), real)
    fields = F.struct(numeric_field(text, "score").alias("score"), string_field(text, "verdict").alias("verdict"), string_field(text, "reason").alias("reason"))
    usable = real(fields) & (F.coalesce(fields["verdict"], F.lit("")) != "") & (F.coalesce(fields["reason"], F.lit("")) != "")
    return F.when(F.size(good) > 0, F.element_at(good, -1)).when(usable, fields)


def slug(text: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def address_parts(text: Column) -> Column:
    """Non-blank trimmed parts between semicolons of either width."""
    return F.filter(F.transform(F.split(text, "[;；]"), lambda p: strip(p)), lambda p: p != "")


def normalize_address(text: Column) -> Column:
    body = F.coalesce(answer_block(text), text)
    return F.array_join(F.filter(F.transform(F.split(body, "[;,]"), lambda p: strip(p)), lambda p: p != ""), ", ")


def geocode_key(text: Column) -> Column:
    """Cache key of an address: comma separators, single blanks, lower case."""
    commas = F.regexp_replace(text, "[;；，]", ",")
    tight = F.regexp_replace(commas, r"\s*,\s*", ",")
    return F.lower(strip(F.regexp_replace(tight, r"\s+", " ")))


def geocode_candidates(text: Column) -> Column:
    """Ever shorter prefixes of the parts of an address, without repeats."""
    parts = address_parts(text)
    n = F.size(parts)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "; ")))).otherwise(F.array().cast("array<string>"))


def strip_quotes(text: Column) -> Column:
    t = strip(text)
    quoted = (F.length(t) >= 2) & t.rlike(r"(?s)^(\".*\"|'.*')$")
    return F.when(quoted, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def without_thoughts(text: Column) -> Column:
    """What follows the last ``</think>``, trimmed."""
    return strip(F.element_at(F.split(text, "</think>"), -1))


def to_bool(text: Column) -> Column:
    t = F.lower(strip(text.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y", "t"), True).when(t.isin("false", "0", "no", "n", "f", ""), False)


def sanitize_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def path_stem(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def item_id(path: Column) -> Column:
    """Stem and twelve digits of the path's MD5."""
    return F.concat(path_stem(path), F.lit("_"), F.substring(F.md5(path), 1, 12))


def group_stem(stem: Column) -> Column:
    """A view suffix ``_1``, ``_2`` or ``_3`` is not part of the group's name."""
    return F.regexp_replace(stem, r"_[123]$", "")


def prefixed(text: Column, prefix: str) -> Column:
    """Non-thinking prefix, unless the text already thinks or has it."""
    return F.when(F.startswith(text, F.lit("<think>")) | F.startswith(text, F.lit(prefix)), text).otherwise(F.concat(F.lit(prefix), text))


def media_top_up(text: Column, wanted: Column, tag: str = "<image>") -> Column:
    """Prepends the tags that are missing."""
    have = F.size(F.split(text, tag)) - 1
    return F.concat(F.repeat(F.lit(tag), F.greatest(wanted - have, F.lit(0))), text)


def normalize_bbox(bbox: Column, width: Column, height: Column) -> Column:
    """Corners in order, in thousandths of the image; halves go to the even number."""
    box = F.array(F.least(bbox[0], bbox[2]), F.least(bbox[1], bbox[3]), F.greatest(bbox[0], bbox[2]), F.greatest(bbox[1], bbox[3]))
    return F.transform(box, lambda v, i: F.bround(v / F.when(i % 2 == 0, width).otherwise(height) * 1000).cast("int"))


def _dict(text: Column) -> Column:
    """A text that is one JSON object and nothing else."""
    return F.when(text.rlike(r"(?s)\A\s*\{") & F.try_parse_json(text).isNotNull(), text)


def _string_of(text: Column, name: str) -> Column:
    """A field of an object if it is a string."""
    field = F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(field, "$", "string"))


def eval_answer(text: Column) -> Column:
    """The place an output names, for evaluation: only ``FinalAnswer`` (or ``final_answer``) of its JSON, or that field in text that is no JSON.

    An empty field counts as none; runs of white space become a blank. A field
    that is found in text may be empty.
    """
    text = strip(text)
    fenced = F.regexp_extract(F.coalesce(answer_block(text), text), r"(?s)\A```[^\n]*\n(.*)\n```[^\n]*\z", 1)
    payload = F.when(fenced != "", strip(fenced)).otherwise(F.coalesce(answer_block(text), text))
    named = F.coalesce(F.nullif(_string_of(_dict(payload), "FinalAnswer"), F.lit("")), _string_of(_dict(payload), "final_answer"))
    pattern = r'(?is)"FinalAnswer"\s*:\s*"((?:\\.|[^"\\])*)"'
    raw = F.coalesce(_group(payload, pattern), _group(text, pattern))
    loose = F.coalesce(F.get_json_object(F.concat(F.lit('{"a":"'), raw, F.lit('"}')), "$.a"), raw)
    one_line = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    return F.coalesce(F.when(strip(named) != "", one_line(named)), one_line(loose))


def reward_point(text: Column) -> Column:
    """``struct<lat,lon>`` in range, of the JSON object in an answer block, the first that has one, else in the text; else null.

    A key that is there but holds no number is not made up for by its short name.
    """
    blocks = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<answer>(.*?)</answer>"), F.lit(1)), strip)

    def of(source: Column) -> Column:
        loose = F.get(F.filter(F.regexp_extract_all(source, F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda x: _dict(x).isNotNull()), F.lit(0))
        data = F.try_parse_json(F.coalesce(_dict(source), loose))

        def number(*names: str) -> Column:
            out = F.lit(None).cast("string")
            for name in reversed(names):
                out = F.when(F.try_variant_get(data, f"$.{name}", "variant").isNotNull(), F.try_variant_get(data, f"$.{name}", "string")).otherwise(out)
            return maybe_float(out)

        lat, lon = number("latitude", "lat"), number("longitude", "lon", "lng")
        return _point(lat, lon, lat.between(-90, 90) & lon.between(-180, 180))

    points = F.transform(F.concat(blocks, F.array(text)), of)
    return F.get(F.filter(points, lambda p: p.isNotNull()), F.lit(0))


def domain_of(path: Column, root: str, names: dict[str, str] | None = None) -> Column:
    """The folder below a root that a file lies in; of a file in the root itself its stem, or the name that stands for it; ``UNKNOWN`` elsewhere."""
    base = root.rstrip("/") + "/"
    relative = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1)))
    stem = F.regexp_replace(relative, r"(?<=.)\.[^.]*\z", "")
    known = F.coalesce(*[F.when(F.lower(stem) == k, v) for k, v in names.items()], stem) if names else stem
    return F.coalesce(F.when(relative.contains("/"), F.substring_index(relative, "/", 1)).otherwise(known), F.lit("UNKNOWN"))


def invalid_query(c: Column) -> Column:
    """A geocoding query that is missing, blank or a mere number."""
    said = F.coalesce(strip(c.cast("string")), F.lit(""))
    return (said == "") | said.rlike(r"\A[-+]?\d+(?:\.\d+)?\z")


def distilled(content: Column, reasoning: Column) -> Column:
    """One answer of a reasoning and an answer; without a reasoning the answer alone."""
    whole = F.concat(F.lit("<think>"), reasoning, F.lit("</think>\n\n<answer>"), F.coalesce(content, F.lit("")), F.lit("</answer>"))
    return F.when(reasoning.isNotNull(), whole).otherwise(content)


def prm_reward(c: Column) -> Column:
    """The number between the first and the second ``Reward:`` of a judge's output, asterisks left out; 0 if there is none."""
    said = F.replace(strip(F.get(F.split(c, "Reward:"), F.lit(1))), F.lit("*"), F.lit(""))
    return F.coalesce(strip(said).try_cast("double"), F.lit(0.0))


def group_of_path(path: Column) -> Column:
    """``group, member``: the folder that holds the file, else the stem without its number, and the stem."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    member = path_stem(path)
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.struct(F.coalesce(folder, group_stem(member)).alias("group"), member.alias("member"))
