"""Benchmark decontamination by SimHash windows.

Texts become five-word shingles. Windows as long as a benchmark item are laid
over a document at every place where one could reach the similarity asked for:
a window of item size m must hold so many shingles of the items of that size as
the similarity needs, whichever item they come from and in whatever order. Each
window gets a 64-bit SimHash, and the items get theirs. Windows and items of
one size meet on blocks of their fingerprints: with one block more than the
radius, every pair within the radius agrees on one block at least, so the
blocks find the items and lose none within the radius. What meets is verified
by the exact weighted Jaccard similarity of the two shingle multisets.

Built-in functions only. A document's shingles are hashed once and not
shuffled: the shingles of the benchmark are broadcast, in several passes over
the hashes if there are more of them than a broadcast may hold. A shingle is
known by 64 bits of XXH64; a collision could add one shingle to a window's
count, which is far from making a match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import Scratch, text_or_empty

WIDTH = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in 9.7 bits, give or take 2.9: 24 misses 3 in a million, and verbatim windows never.
RADIUS = 24
#: Shingles of the benchmark are broadcast by so many at a time (about 24 bytes each).
BROADCAST_ROWS = 2_000_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def shingles(text: Column, width: int = WIDTH) -> Column:
    """``hashes`` of the word shingles, repeats included, and ``n_words``.

    A text of fewer words is one shingle. The words are bound as a lambda's
    variable, so they are split once wherever the optimizer puts the expression.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")

    def of(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))
        hashes = F.when(n >= width, each).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(hashes.alias("hashes"), n.alias("n_words"))

    return F.element_at(F.transform(F.array(words), of), 1)


def _hashed(df: DataFrame, id_col: str, text_col: str, width: int, name: str) -> DataFrame:
    """``row, name, text_key, hashes, n_words``. ``row`` numbers the input rows; ``text_key`` is a digest of the text where there is no id."""
    text = text_or_empty(F.col(text_col))
    ids = F.col(id_col).cast("long")
    own = F.when(ids.isNull(), F.unhex(F.sha2(text, 256))).alias("text_key")
    return df.select(F.monotonically_increasing_id().alias("row"), ids.alias(name), own, shingles(text, width).alias("s")).select("row", name, "text_key", "s.hashes", "s.n_words")


def simhash(hashes: Column) -> Column:
    """Bit b is 1 if it is set in over half of the hashes."""
    n = F.size(hashes)

    def bit(acc: Column, b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.call_function("shiftright", h, b).bitwiseAND(F.lit(1)) == 1))
        return acc.bitwiseOR(F.when(2 * ones > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.array(*[F.lit(b) for b in range(64)]), F.lit(0).cast("long"), bit)


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """``radius + 1`` blocks of the 64 bits, each with its number."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    return F.array(*[
        F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("bits"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ])


def tagged(hashes: Column) -> Column:
    """Tells the repeats of a multiset apart, so that set operations count them.

    A hash's first place keeps it, so a multiset without repeats is its own tags.
    """
    def tag(h: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(hashes, F.lit(1), i), lambda x: x == h))
        return F.when(seen == 0, h).otherwise(F.xxhash64(h, seen))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), hashes).otherwise(F.transform(hashes, tag))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words``: the best window of each pair.

    A row for each document and item with a window at ``similarity`` or more;
    clean documents have none. Of equal windows the first counts, of these the
    longer. A window is as long as the item, or as the document if that is
    shorter; ``n_words`` is its length in words. Null and empty texts and items
    have no shingle and match nothing. A text of fewer words than a shingle is
    one shingle and matches its equal. Windows are laid row by row; the rows of
    a repeated id (or item) are reported as one, and so are null ids. Other
    columns are not read; an empty table gives no rows.
    """
    scored = matched_windows(docs, items, id_col, text_col, item_col, item_text, similarity, radius, width, broadcast_rows)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first")).alias("before"), "length")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).cast("long").alias("first_word"), F.col("best.length").cast("long").alias("n_words"))


def matched_windows(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS, width: int = WIDTH, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, text_key, item_id, first, length, similarity``: every window that ``contaminated`` chooses from.

    ``text_key``, a digest of the row's text, tells rows without an id apart.
    """
    scratch = Scratch(docs.sparkSession)
    bench = _hashed(items, item_col, item_text, width, "item_id").where(F.size("hashes") > 0)
    # Written before it is numbered, so that an item has one number.
    bench = scratch.save(bench.select("item_id", F.size("hashes").alias("m"), F.col("n_words").alias("length"), F.col("hashes").alias("item")).distinct())
    bench = scratch.save(bench.withColumn("no_item", F.monotonically_increasing_id()))
    windows = scratch.save(item_sized_windows(docs, bench, id_col, text_col, similarity, width, broadcast_rows))

    keyed = scratch.save(bench.select("no_item", "item_id", "m", "length", "item", simhash(F.col("item")).alias("item_fp")))
    left = windows.select("*", F.inline_outer(blocks(F.col("fp"), radius)))
    right = keyed.select("no_item", "m", "item_fp", F.inline_outer(blocks(F.col("item_fp"), radius)))
    few = keyed.count() * (radius + 1) <= broadcast_rows
    met = left.join(F.broadcast(right) if few else right, ["m", "no", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    # A pair may meet on several blocks: keep its first.
    first_block = F.array_min(F.transform(F.filter(F.arrays_zip(blocks(F.col("fp"), radius).alias("a"), blocks(F.col("item_fp"), radius).alias("b")), lambda z: z["a"] == z["b"]), lambda z: z["a"]["no"]))
    met = met.where(F.col("no") == first_block).drop("m")
    full = keyed.select("no_item", "item_id", "item", "length")
    met = met.join(F.broadcast(full) if few else full, "no_item")
    shared = F.size(F.array_intersect(tagged(F.col("w")), tagged(F.col("item"))))
    found = (shared / (F.size("w") + F.size("item") - shared)).alias("similarity")
    scored = met.select("doc_id", "text_key", "item_id", "first", F.least("length", "words").alias("length"), found)
    return scored.where(F.col("similarity") >= similarity)


def item_sized_windows(docs: DataFrame, bench: DataFrame, id_col: str, text_col: str, similarity: float, width: int, broadcast_rows: int) -> DataFrame:
    """``doc_id, text_key, words, m, first, w, fp``: the windows of size ``m`` that can reach the similarity, with their SimHash.

    Of the m shingles of an item and the ``wide`` ones of a window (fewer than m
    only if the document has fewer) a similarity of s needs s / (1 + s) of all
    to be shared. Every window that holds so many shingles of items of size m is
    laid, at every place.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.save(bench.select("m", F.explode("item").alias("h")).distinct())
    passes = sizes.count() // broadcast_rows + 1
    hashed = _hashed(docs, id_col, text_col, width, "doc_id")
    if passes > 1:
        hashed = scratch.save(hashed)
    row = ["row", "doc_id", "text_key", "size", "words", "m"]

    def hits(k: int) -> DataFrame:
        part = sizes if passes == 1 else sizes.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == k)
        # An outer explode, as others make the optimizer infer a filter that hashes every text twice.
        each = hashed.select("row", "doc_id", "text_key", F.size("hashes").alias("size"), F.col("n_words").alias("words"), "hashes", F.posexplode_outer("hashes").alias("pos", "h"))
        # Windows start in cells of m places; a hit counts for its cell and the one before.
        cells = F.filter(F.array(F.floor(F.col("pos") / F.col("m")) - 1, F.floor(F.col("pos") / F.col("m"))), lambda c: c >= 0)
        near = each.join(F.broadcast(part), "h").select(*row, "hashes", "pos", F.explode(cells).alias("cell"))  # at most broadcast_rows rows, about
        return near.select(*row, "cell", "pos", F.slice("hashes", (F.col("cell") * F.col("m") + 1).cast("int"), 2 * F.col("m") - 1).alias("span"))

    found = reduce(DataFrame.unionAll, [hits(k) for k in range(passes)])
    spans = found.groupBy(*row, "cell").agg(F.array_sort(F.collect_list("pos")).alias("at"), F.first("span").alias("span"))  # a cell has 2 m places
    wide = F.least("m", "size")
    need = F.ceil(similarity / (1 + similarity) * (F.col("m") + wide) - 1e-9).cast("int")
    spans = spans.withColumn("wide", wide).withColumn("need", F.greatest(F.lit(1), need)).where(F.size("at") >= F.col("need"))
    # Starts of the windows that hold the hits i to i + need - 1, and not those before.
    low = F.col("cell") * F.col("m")
    end = lambda i: F.element_at("at", i + F.col("need") - 1)
    last = lambda i: F.least(F.element_at("at", i), low + F.col("m") - 1, F.col("size") - F.col("wide"))
    first = lambda i: F.greatest(low, end(i) - F.col("wide") + 1, F.when(i > 1, last(F.greatest(i - 1, F.lit(1))) + 1).otherwise(0))
    runs = F.transform(F.sequence(F.lit(1), F.size("at") - F.col("need") + 1), lambda i: F.struct(first(i).alias("lo"), last(i).alias("hi")))
    spans = spans.withColumn("runs", F.filter(runs, lambda r: r["lo"] <= r["hi"])).where(F.size("runs") > 0)
    starts = F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"])))
    windows = spans.select("doc_id", "text_key", "words", "m", "wide", low.alias("low"), "span", F.explode(starts).alias("first"))
    w = F.slice("span", (F.col("first") - F.col("low") + 1).cast("int"), F.col("wide"))
    return windows.select("doc_id", "text_key", "words", "m", "first", w.alias("w")).select("*", simhash(F.col("w")).alias("fp"))


def oracle() -> str:
    """The same rows in SQL: every window, word multisets, no fingerprints and no hashes."""
    words = lambda t: rf"list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '{NOT_WORD}'), lambda x: x <> '')"
    grams = f"""CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""
    return f"""
        WITH ds AS (SELECT r, doc_id, len(w) AS n, {grams} AS s FROM (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS w FROM documents)),
        bs AS (SELECT b, item_id, len(w) AS n, {grams} AS s FROM (SELECT row_number() OVER () AS b, item_id, {words("text")} AS w FROM benchmark)),
        ic AS (SELECT b, item_id, n AS item_n, m, sh, count(*) AS c FROM (SELECT b, item_id, n, len(s) AS m, unnest(s) AS sh FROM bs) GROUP BY ALL),
        dp AS (SELECT r, doc_id, n, len(s) AS size, unnest(s) AS sh, generate_subscripts(s, 1) - 1 AS pos FROM ds),
        hits AS (SELECT *, least(m, size) AS wide FROM dp JOIN ic USING (sh)),
        inside AS (SELECT r, doc_id, n, b, item_id, item_n, m, wide, sh, c, unnest(range(greatest(0, pos - wide + 1), least(pos, size - wide) + 1)) AS st FROM hits),
        each AS (SELECT r, doc_id, n, b, item_id, item_n, m, wide, st, sh, least(count(*), c) AS k FROM inside GROUP BY r, doc_id, n, b, item_id, item_n, m, wide, st, sh, c),
        win AS (SELECT doc_id, item_id, st, least(n, item_n) AS n_words, CAST(sum(k) AS BIGINT) AS k, wide + m AS total FROM each GROUP BY r, doc_id, n, b, item_id, item_n, m, wide, st),
        ranked AS (SELECT *, k::DOUBLE / (total - k) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k::DOUBLE / (total - k) DESC, st, n_words DESC) AS rn FROM win)
        SELECT doc_id, item_id, similarity, st AS first_word, n_words FROM ranked WHERE rn = 1 AND similarity >= {SIMILARITY}"""
