"""Secret scans with an incremental ledger of blobs.

A history is a table of paths, each row one version of a text. Every version is
addressed by the SHA-256 of its content. The ledger holds, for each blob, which
versions of which rules have scanned it and what they found. A scan reads only
the pairs of blob and rule version that the ledger has not got: a text that
stands under many paths is scanned once, a text seen before costs its hash, and
a changed rule alone meets the old texts. Findings are then joined back to all
paths by the address.

Built-in functions only.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._common import Scratch, text_or_empty


class Rule(NamedTuple):
    """Leftmost matches of ``pattern`` count if their ``group`` has ``least`` characters.

    ``gate`` is a cheap pattern of which every match of ``pattern`` holds one.
    """

    kind: str
    gate: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}:{hashlib.sha256(repr(tuple(self)).encode()).hexdigest()[:16]}"


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: The base rules. Fixed values.
BASE = [
    Rule("assign", f"(?:{_NAMES})[\"']?\\x20*[:=]", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]+", 0, 24),
]

#: Public formats of issued secrets, and logins in addresses.
MORE = [
    Rule("private_key", "PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[oprsu]_", "gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("maps_key", "AIza", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("payment_key", "[rs]k_live_", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("web_token", "eyJ", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 40),
    Rule("login", "://", "://[A-Za-z0-9._-]+:[A-Za-z0-9._%-]+@"),
]
RULES = [*BASE, *MORE]

_SPAN = "array<struct<start:int,stop:int>>"
FINDINGS = "array<struct<version:string,kind:string,start:int,stop:int>>"
LEDGER = f"blob binary, versions array<string>, findings {FINDINGS}"
#: Matches whose places one fold adds up; a longer list is folded by parts, so the work stays near linear.
_FOLD = 128
#: Unseen blobs up to this number (36 bytes each and their rules) may be broadcast to pick their texts out.
BROADCAST_BLOBS = 100_000


def address(text: Column) -> Column:
    """The address of a text: SHA-256 of its UTF-8 bytes, 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stops(gaps: Column, lengths: Column) -> Column:
    """Where each match stops, from the lengths of the texts before the matches and their own."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(lengths)), lengths, lambda g, n: g + n)

    def sums(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(values, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"] + n)).alias("all")))

    def parts(every: Column) -> Column:
        last = F.floor(F.greatest(F.size(every) - 1, F.lit(0)) / F.lit(_FOLD)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: sums(F.slice(every, i * _FOLD + 1, F.lit(_FOLD))))

    def moved(folded: Column) -> Column:
        ends = sums(F.transform(folded, lambda p: p["at"]))["all"]
        return F.flatten(F.zip_with(folded, ends, lambda p, end: F.transform(p["all"], lambda s: s + end - p["at"])))

    return _let(steps, lambda every: _let(parts(every), moved))


def spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start,stop>>`` of a rule's matches in a text, in code points, stop exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(found, F.length)
    held = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else sizes
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)

    def placed(m: Column) -> Column:
        every = F.arrays_zip(_stops(m["gaps"], m["sizes"]).alias("stop"), m["sizes"].alias("size"), m["held"].alias("held"))
        kept = F.filter(every, lambda x: x["held"] >= rule.least)
        return F.transform(kept, lambda x: F.struct((x["stop"] - x["size"]).alias("start"), x["stop"].alias("stop")))

    none = F.array().cast(_SPAN)
    return F.when(text.rlike(rule.gate), _let(F.struct(gaps.alias("gaps"), sizes.alias("sizes"), held.alias("held")), placed)).otherwise(none)


def findings(text: Column, rules: list[Rule], todo: Column | None = None) -> Column:
    """What the rules find in a text; with ``todo``, only those whose version is in that array."""

    def of(rule: Rule) -> Column:
        found = F.transform(spans(text, rule), lambda s: F.struct(
            F.lit(rule.version).alias("version"), F.lit(rule.kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
        return found if todo is None else F.when(F.array_contains(todo, rule.version), found)

    return F.flatten(F.array_compact(F.array(*[of(r) for r in rules]))).cast(FINDINGS)


class Ledger:
    """The scanned pairs of blob and rule version, and their findings, in a shared folder.

    Each scan adds one batch, a Parquet folder that counts from the moment it is
    complete: a scan that breaks off leaves the ledger as it was. Two scans at
    once may scan a pair twice, which changes no finding.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{Scratch(spark).base}/ledger-{uuid.uuid4().hex}"

    def batches(self) -> list[str]:
        """Folders of the complete batches."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        found = (s.getPath() for s in fs.listStatus(where))
        return sorted(p.toString() for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self) -> DataFrame:
        """``blob, versions, findings``: a row for each blob and batch."""
        have = self.batches()
        reader = self.spark.read.schema(LEDGER)
        return reader.parquet(*have) if have else self.spark.createDataFrame([], LEDGER)

    def unseen(self, blobs: DataFrame, rules: list[Rule]) -> DataFrame:
        """``blob, todo``: distinct blobs with the rule versions that have not scanned them; blobs without any are left out."""
        every = F.array(*[F.lit(r.version) for r in rules])
        if not self.batches():
            return blobs.select("blob", every.alias("todo"))
        # A blob has a row for each batch that scanned it: as many as its rules changed.
        seen = self.rows().groupBy("blob").agg(F.flatten(F.collect_set("versions")).alias("seen"))
        left = blobs.join(seen, "blob", "left").select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        return left.where(F.size("todo") > 0)

    def scan(self, history: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> None:
        """Scans the unseen pairs of the history's texts and adds them as one batch."""
        rules, scratch = rules or RULES, Scratch(self.spark)
        texts = history.select(address(F.col(text_col)).alias("blob"), text_or_empty(F.col(text_col)).alias("text"))
        todo = scratch.save(self.unseen(texts.select("blob").distinct(), rules))
        few = todo.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS and bool(self.batches())
        if few:  # most texts are known: they are left out before any text moves
            one = texts.join(F.broadcast(todo), "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
        else:  # copies are combined before and after the one shuffle of texts
            one = texts.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
        batch = one.select("blob", F.col("todo").alias("versions"), findings(F.col("text"), rules, F.col("todo")).alias("findings"))
        batch.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")
        scratch.drop(todo)

    def findings(self, rules: list[Rule] | None = None) -> DataFrame:
        """``blob, findings`` under the given rules, a row for each blob that has any, in order of place and rule."""
        rules = rules or RULES
        versions = [r.version for r in rules]
        rows = self.rows().select("blob", F.filter("findings", lambda f: f["version"].isin(versions)).alias("findings")).where(F.size("findings") > 0)
        one = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
        place = F.array(*[F.lit(v) for v in versions])
        keyed = F.transform("findings", lambda f: F.struct(f["start"], F.array_position(place, f["version"]).alias("rule"), f["kind"], f["stop"]))
        return one.select("blob", F.transform(F.array_sort(keyed), lambda f: F.struct(f["kind"], f["start"], f["stop"])).alias("findings"))

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def scan_history(history: DataFrame, ledger: Ledger, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, blob, findings``, a row per row of the history; scans what the ledger has not got first.

    ``findings`` is an array of ``kind, start, stop`` in code points, by start
    and then by rule; ``blob`` the 32 bytes of the address. A null or empty
    text, or one without a secret, has an empty array. Repeated rows and null
    ids keep a row each. Other columns are not read; an empty table gives no rows.
    """
    ledger.scan(history, rules, text_col)
    # Written, so that the join can split the rows of a hot blob.
    found = Scratch(history.sparkSession).save(ledger.findings(rules))
    paths = history.select(F.col(id_col).alias("doc_id"), address(F.col(text_col)).alias("blob"))
    joined = paths.join(found, "blob", "left")
    return joined.select("doc_id", "blob", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:int,stop:int>>")).alias("findings"))


def secret_report(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of ``scan_history`` that ``op11_secret_scan`` returns; by default over a ledger of its own."""
    rows = scan_history(docs, ledger or Ledger(docs.sparkSession), RULES, id_col, text_col)
    base = [r.kind for r in BASE]

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["stop"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("findings", lambda f: f["kind"].isin(base))
    return rows.select("doc_id", *map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def oracle() -> str:
    """DuckDB SQL of ``op11_secret_scan``: every rule over every text, without ledger or gates."""

    def one(k: int, rule: Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""
            SELECT r, {k} AS k, '{rule.kind}' AS kind, list_sum(g[1:i]) + coalesce(list_sum(l[1:i - 1]), 0) AS start, list_sum(g[1:i]) + list_sum(l[1:i]) AS stop
            FROM (SELECT r, g, l, v, unnest(range(1, len(l) + 1)) AS i FROM (
                SELECT r, [length(x) FOR x IN string_split_regex(t, '{p}')] AS g,
                       [length(x) FOR x IN regexp_extract_all(t, '{p}', 0)] AS l,
                       [length(x) FOR x IN regexp_extract_all(t, '{p}', {rule.group})] AS v FROM d))
            WHERE v[i] >= {rule.least}"""

    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    span, order = "kind || ':' || start::BIGINT || ':' || stop::BIGINT", "ORDER BY start, k"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        m AS ({" UNION ALL ".join(one(k, r) for k, r in enumerate(RULES))}),
        s AS (SELECT r, {counts}, coalesce(string_agg({span}, ',' {order}) FILTER (kind IN ({base})), '') AS own,
                     string_agg({span}, ',' {order}) AS spans FROM m GROUP BY r)
        SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
               sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN s USING (r)"""
