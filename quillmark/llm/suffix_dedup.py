"""Repeated passages by a sparse suffix array.

Of all suffixes only those at minimiser positions are retained: the place of
the least k-gram hash among the k-grams of every window of ``min_words`` words.
The choice depends on the words alone, so a passage of that length that two
texts share selects the same suffixes in both. Suffixes whose k-gram hash no
other text has are dropped.

The rest are sorted by the words that follow, and each is compared with its
neighbours in that order: the nearest one of another text on either side shares
the longest run of words to the right that any other text has. A second sort, by
k-gram and the words before it, gives the longest run to the left. A suffix can
only lie in a repeated passage if both together reach ``min_words``; its match
is extended left and right by as much. If another text has the same extended
match, word for word, all of it is repeated. If not, its runs to the left and
to the right come from different texts; the windows of such a match are then
compared one by one with those of all matches around the same k-gram.

Sorting is by range parts over all of the key, so the suffixes of a passage that
a third of all texts share are dealt over many tasks; what a part needs of the
parts around it is at most two rows a side. Equal texts are collapsed first and
their copies reported whole. Texts and matches are known by 128 and 256 bits.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillmark.llm._common import BLANKS, Scratch, text_or_empty

#: Passages of over 50 words.
MIN_WORDS = 51
GRAM = 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 16
_LONG = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ROWS = 8192
#: Bytes of text that are cut into words at once; a longer text is taken alone.
_BYTES = 1 << 19
#: Marks of rows in a sorted part: none of another text before or after; its first and last row, and the ones of another text next to them.
_HEAD, _TAIL, _FIRST, _FIRST_OTHER, _LAST, _LAST_OTHER = 1, 2, 4, 8, 16, 32


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII blanks, in UTF-8."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def identity(joined: bytes) -> tuple[int, int]:
    """128 bits of a text as a sequence of words joined by single blanks, as two signed integers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(joined))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n - 1, 0), x))), dtype=np.uint64)[:n]


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def word_hashes(joined: bytes) -> np.ndarray:
    """A hash of each word of words joined by single blanks: eight bytes of all words at a time, words beyond 64 bytes one by one."""
    if not joined:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(joined + bytes(16 - len(joined) % 8), np.uint8)
    eights = raw.view("<u8")
    ends = np.flatnonzero(raw[: len(joined)] == 32)
    starts, ends = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(joined)]))
    size = ends - starts
    out = size.astype(np.uint64) * _BASE
    at = slice(None)
    for o in range(0, min(int(size.max()), _LONG), 8):
        if o:
            at = np.flatnonzero(size > o)
        place, left = starts[at] + o, size[at] - o
        shift = ((place & 7) << 3).astype(np.uint64)
        place >>= 3
        part = (eights[place] >> shift) | ((eights[place + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        out[at] = _mixed((out[at] ^ (part & _MASKS[np.minimum(left, 8)])) * _BASE)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(joined[starts[i] : ends[i]])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)  # spread the weak low bits
    return h * np.uint64(0xD6E8FEB86659FD93)


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all windows of a size."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = (_UP[: len(x)], _DOWN[:n]) if len(x) <= _BLOCK else (_powers(_BASE, len(x)), _powers(_INVERSE, n))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up, dtype=np.uint64)))
    return _mixed((total[size:] - total[:n]) * down)


def _extremes(x: np.ndarray, span: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every window of ``span`` values, by doubling."""
    n, w = len(x) - span + 1, 1
    while 2 * w <= span:
        x, w = least(x[:-w], x[w:]), 2 * w
    return least(x[:n], x[span - w :][:n])


def minimisers(x: np.ndarray, ends: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least k-gram of each window of ``span`` k-grams of one text, leftmost if tied.

    ``x``: the word hashes of texts, one after another, that end before ``ends``.
    """
    size = gram + span - 1
    inside = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(x)) >= size  # the window from here on ends with its text
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    step = max(_BLOCK - size + 1, size)
    for o in range(0, len(x) - size + 1, step):
        g = window_hashes(x[o : o + step + size - 1], gram)
        least = _extremes(g, span, np.minimum) * inside[o : o + len(g) - span + 1]
        rim = np.zeros(span - 1, np.uint64)
        # A k-gram is the least of a window if none of the windows over it has a greater least.
        at = np.flatnonzero(_extremes(np.concatenate((rim, least, rim)), span, np.maximum) == g)
        v = g[at]
        tied = np.flatnonzero(v[1:] == v[:-1]) + 1
        if len(tied):  # the latter of two must be the least of a window that begins after the former
            since = np.maximum(at[tied - 1], at[tied] - span) + 1
            own = np.maximum.reduceat(np.concatenate((least, rim, [np.uint64(0)])), np.stack((since, at[tied] + 1), 1).ravel())[::2]
            gone = tied[own != v[tied]]
            at, v = np.delete(at, gone), np.delete(v, gone)
        places.append(at + o)
        hashes.append(v)
    found, first = np.unique(np.concatenate(places), return_index=True)
    return found, np.concatenate(hashes)[first]


def shared_words(a: str, b: str) -> int:
    """Words that two texts have in common at their start; a blank follows each word."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return a.count(" ", 0, hi)
    while hi - lo > 1:  # a[:lo] == b[:lo], a[:hi] != b[:hi]
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return a.count(" ", 0, lo)


def scan_part(rows: Iterator[tuple[int, str]]) -> Iterator[tuple[int, int]]:
    """For sorted ``(text, key)`` pairs of a part: words shared with the nearest key of another text, and marks.

    What two keys share is the least of what the neighbours between them share,
    so each pair of neighbours is compared once. Only the keys of one text that
    stand together are held.
    """
    out, block, last, first = [], [], None, None  # block: [forward, shared with the row before, marks]
    for text, key in rows:
        mark = 0
        if last is None:
            adj, forward, mark, first = 0, 0, _HEAD | _FIRST, text
        else:
            adj = shared_words(last[1], key)
            if text != last[0]:
                forward, nxt = adj, adj
                for e in reversed(block):
                    e[0], nxt = max(e[0], nxt), min(nxt, e[1])
                out += block
                yield from ((n, m) for n, _, m in out[:-1])
                out, block = out[-1:], []
                if first is not None and text != first:
                    mark, first = _FIRST_OTHER, None
            else:
                forward, mark = min(adj, last[2]), last[3] & _HEAD
        block.append([forward, adj, mark])
        last = (text, key, forward, mark)
    if out:
        out[-1][2] |= _LAST_OTHER
    for e in block:
        e[2] |= _TAIL
    if block:
        block[-1][2] |= _LAST
    yield from ((n, m) for n, _, m in out + block)


def carried(edges: list[tuple[int, int, str, int]]) -> dict[int, list[tuple[int, str]]]:
    """For each part ``(text, key)`` of the nearest row before it and of the nearest one of a further text.

    ``edges``: part, text, key and 0 or 1 (next to the part's end, or one text further), in order of parts.
    """
    by: dict[int, dict[int, tuple[int, str]]] = {}
    for part, text, key, further in edges:
        by.setdefault(part, {})[further] = (text, key)
    out, near = {}, []
    for part, own in by.items():
        out[part] = near
        rest = [own[1]] if 1 in own else [x for x in near if x[0] != own[0][0]]
        near = [own[0], *rest[:1]]
    return out


def neighbour_words(rows: DataFrame, key: str, name: str, scratch: Scratch) -> DataFrame:
    """Adds the number of words that ``key`` shares with the key of the nearest other text ``c`` in sort order."""
    names = [f.name for f in rows.schema]
    at_c, at_key = names.index("c"), names.index(key)
    sorted_ = rows.repartitionByRange(key, "c", "pos").sortWithinPartitions(key, "c", "pos").withColumn("part", F.spark_partition_id())
    schema = sorted_.withColumn(name, F.lit(0)).withColumn("mark", F.lit(0)).schema
    kind = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs() -> Iterator[tuple[int, str]]:
            for b in batches:
                held.append(b)
                yield from zip(b.column(at_c).to_pylist(), b.column(at_key).to_pylist(), strict=True)

        got: list[tuple[int, int]] = []
        for x in scan_part(pairs()):
            got.append(x)
            while held and held[0].num_rows <= len(got):
                b = held.pop(0)
                own, got = got[: b.num_rows], got[b.num_rows :]
                n, m = (pa.array(v, pa.int32()) for v in zip(*own, strict=True)) if own else (pa.array([], pa.int32()),) * 2
                yield pa.RecordBatch.from_arrays([*b.columns, n, m], schema=kind)

    scanned = scratch.save(sorted_.mapInArrow(scan, schema))
    edge = F.col("mark").bitwiseAND(F.lit(_FIRST | _FIRST_OTHER | _LAST | _LAST_OTHER)) != 0
    edges = sorted(tuple(r) for r in scanned.where(edge).select("part", "mark", "c", key).collect())  # at most four rows a part
    ends = [(p, c, k, f) for bit, f in ((_LAST, 0), (_LAST_OTHER, 1)) for p, m, c, k in edges if m & bit]
    starts = [(p, c, k, f) for bit, f in ((_FIRST, 0), (_FIRST_OTHER, 1)) for p, m, c, k in edges if m & bit]
    before = carried(sorted(ends, key=lambda e: e[0]))
    after = carried(sorted(starts, key=lambda e: -e[0]))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f.name: i for i, f in enumerate(schema)}
        for b in batches:
            n, marks = b.column(at[name]).to_pylist(), b.column(at["mark"]).to_pylist()
            for i, m in enumerate(marks):
                for bit, near in ((_HEAD, before), (_TAIL, after)):
                    if m & bit:
                        c, k = b.column(at_c)[i].as_py(), b.column(at_key)[i].as_py()
                        n[i] = max([n[i], *[shared_words(k, y) for x, y in near[b.column(at["part"])[i].as_py()] if x != c][:1]])
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(n, pa.int32())], names=[*names, name])

    mended = scanned.where("mark > 0").mapInArrow(mend, rows.withColumn(name, F.lit(0)).schema)  # few rows; the others stay as they are
    return scanned.where("mark = 0").drop("part", "mark").unionByName(mended)


def contexts(texts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """``c, h, pos, right, left, reach``: of each place the words from it on and the ``reach`` before it, nearest first, a blank after each.

    ``texts``: ``c, c1, c2, places, text``; texts that are not the ones that c1 and c2 name are left out.
    """
    schema = T._parse_datatype_string("c long, h long, pos int, right string, left string, reach int")
    kind = to_arrow_schema(schema)

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        c, h, pos, right, left, reach = zip(*parts, strict=True)
        strings = ([x.decode("utf-8", "replace") for part in col for x in part] for col in (right, left))
        numbers = np.repeat(c, [len(p) for p in pos]), np.concatenate(h), np.concatenate(pos), *strings, np.concatenate(reach)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(numbers, kind, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cs, c1, c2 = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = b.column(3).offsets.to_numpy()
            pos, h = (v.to_numpy(zero_copy_only=False) for v in b.column(3).values.flatten())
            held, n = [], 0
            for i in range(b.num_rows):
                words = words_of(b.column(4)[i].as_py())
                joined = b" ".join(words)
                if identity(joined) != (c1[i], c2[i]):
                    continue
                onward, turned = joined + b" ", b" ".join(words[::-1]) + b" "
                starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(onward, np.uint8) == 32) + 1))
                for k in range(cuts[i], cuts[i + 1], _ROWS):
                    p = pos[k : min(k + _ROWS, cuts[i + 1])]
                    since = np.maximum(p - (min_words - gram), 0)
                    at, ends, before = (starts[x].tolist() for x in (p, np.minimum(p + min_words, len(words)), since))
                    right = [onward[x:y] for x, y in zip(at, ends, strict=True)]
                    left = [turned[len(onward) - x : len(onward) - y] for x, y in zip(at, before, strict=True)]
                    held.append((cs[i], h[k : k + len(p)], p, right, left, p - since))
                    n += len(p)
                    if n >= _ROWS:
                        yield batch(held)
                        held, n = [], 0
            if held:
                yield batch(held)

    return texts.select("c", "c1", "c2", "places", "text").mapInArrow(run, schema)


def first_words(text: str, n: str) -> Column:
    return F.call_function("substring_index", F.col(text), F.lit(" "), F.col(n))


def windows_of(matches: DataFrame, kept: list[str], min_words: int, gram: int) -> DataFrame:
    """``kept``, ``d`` and a digest ``window`` for each window of the extended matches ``turned, right, n, r`` that starts d words before its k-gram."""
    schema = T.StructType([*[matches.schema[k] for k in kept], T.StructField("d", T.IntegerType()), T.StructField("window", T.BinaryType())])
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ds, digests = [], [], []
            for i, (turned, right, n, r) in enumerate(zip(*(b.column(b.num_columns - 4 + j).to_pylist() for j in range(4)), strict=True)):
                left, right = turned.split(" ")[gram:n], right.split(" ")
                for d in range(max(0, min_words - r), n - gram + 1):
                    at.append(i)
                    ds.append(d)
                    digests.append(hashlib.sha256(" ".join([str(d), *left[:d], *right[: min_words - d]]).encode()).digest())
            rows = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array(ds, pa.int32()), pa.array(digests, pa.binary())], schema=kind)

    return matches.select(*kept, "turned", "right", "n", "r").mapInArrow(run, schema)


def matched_starts(found: DataFrame, min_words: int, gram: int, scratch: Scratch) -> DataFrame:
    """``c, lo, hi``: starts of windows that stand in another text.

    ``found``: ``c, pos, h`` and the extended match, the first ``n`` words of
    ``turned`` (the k-gram, then the words before it) and the first ``r`` of ``right``.
    """
    match = F.concat_ws("\n", first_words("turned", "n"), first_words("right", "r"))
    trim = scratch.save(found.withColumn("key", F.unhex(F.sha2(match, 256))))
    both = scratch.save(trim.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key"))
    lone = scratch.save(trim.join(both, "key", "left_anti"))
    whole = trim.join(both, "key", "left_semi").select("c", (F.col("pos") + gram - F.col("n")).alias("lo"), (F.col("pos") + F.col("r") - min_words).alias("hi"))
    if lone.isEmpty():
        return whole
    # A match of its own: its left and right partners differ. Its windows meet those of all matches of the k-gram.
    runs = lone.select("h").distinct()
    each = trim.join(runs, "h", "left_semi").groupBy("key").agg(*[F.first(c).alias(c) for c in ("turned", "right", "n", "r")], F.min("c").alias("a"), F.max("c").alias("b"))
    again = windows_of(each, ["a", "b"], min_words, gram).groupBy("window").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("window")
    again = scratch.save(again)
    some = windows_of(lone, ["c", "pos"], min_words, gram).join(again, "window", "left_semi").select("c", (F.col("pos") - F.col("d")).alias("lo"))
    return whole.unionByName(some.withColumn("hi", F.col("lo")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``doc_id, first_word, n_words``: a row for each maximal run of repeated passages.

    A run is a union of windows of ``min_words`` words that also stand in
    another document; lower-cased words between ASCII blanks count from 0. What
    repeats only inside one document is not reported. Texts that are equal as
    word sequences, long enough and of different ids are reported whole. Null,
    empty and short texts have no rows; repeated rows (same id, same words) are
    one document; null ids count as one id. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    ids, text = F.col(id_col).cast("long"), text_or_empty(F.col(text_col))
    # The id and, where there is none, a hash of the text find a row again.
    base = docs.select(ids.alias("doc_id"), F.when(ids.isNull(), F.xxhash64(text)).alias("k"), text.alias("text"))
    span = min_words - gram + 1

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text (``pos`` -1) and for each of its places."""
        for b in batches:
            size = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < b.num_rows:
                until = np.searchsorted(size, (size[at - 1] if at else 0) + _BYTES, "right")
                part = b.slice(at, max(int(until) - at, 1))
                at += part.num_rows
                texts = [words_of(t) for t in part.column(2).to_pylist()]
                n = np.array([len(w) for w in texts], np.int64)
                joined = [b" ".join(w) for w in texts]
                who = np.array([identity(j) for j in joined], np.int64)
                none = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int32)), pa.array(none), pa.array(who[:, 0].copy()), pa.array(who[:, 1].copy()), pa.array((none - 1).astype(np.int32))], schema=kind)
                ends = np.cumsum(n)
                places, h = minimisers(word_hashes(b" ".join(filter(None, joined))), ends, gram, span)
                rows = np.searchsorted(ends, places, "right")
                empty = [pa.nulls(len(h), t) for t in (pa.int64(), pa.int64(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(h.view(np.int64)), *(pa.array(who[rows, j]) for j in (0, 1)), pa.array((places - (ends - n)[rows]).astype(np.int32))], schema=kind)

    made = T._parse_datatype_string("doc_id long, k long, words int, h long, c1 long, c2 long, pos int")
    kind = to_arrow_schema(made)
    rows = scratch.save(base.mapInArrow(retain, made))
    texts, suffixes = rows.where("pos < 0").select("doc_id", "k", "c1", "c2", "words"), rows.where("pos >= 0").select("h", "c1", "c2", "pos")
    name = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k"))
    kinds = texts.groupBy("c1", "c2").agg(name.alias("first"), F.max("doc_id").alias("last"), F.max("words").alias("words"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    kinds = scratch.save(scratch.save(kinds).withColumn("c", F.monotonically_increasing_id()))
    # Written before the join, so that the join can split the rows of a common k-gram.
    # Plain longs: the least and greatest of a struct would sort all suffixes.
    ends = [f(c).alias(f"{c}{k}") for c in ("c1", "c2") for k, f in (("a", F.min), ("b", F.max))]
    shared = scratch.save(suffixes.groupBy("h").agg(*ends).where("c1a <> c1b OR c2a <> c2b").select("h"))
    places = suffixes.join(shared, "h").groupBy("c1", "c2").agg(F.collect_set(F.struct("pos", "h")).alias("places"))
    # One text of each kind is enough.
    chosen = scratch.save(places.join(kinds.select("c1", "c2", "c", F.col("first.doc_id").alias("own_id"), F.col("first.k").alias("own_k")), ["c1", "c2"]))
    one = base.join(chosen, base["doc_id"].eqNullSafe(F.col("own_id")) & base["k"].eqNullSafe(F.col("own_k")))
    found = scratch.save(contexts(one, min_words, gram))
    scratch.drop(chosen)
    found = neighbour_words(found, "right", "r", scratch)
    found = found.where((F.col("r") >= gram) & (F.col("r") + F.col("reach") >= min_words))
    turned = found.select("c", "h", "pos", "right", "r", F.concat(F.substring_index("right", " ", gram), F.lit(" "), F.col("left")).alias("turned"))
    found = neighbour_words(turned, "turned", "n", scratch).where(F.col("n") - gram + F.col("r") >= min_words)
    starts = scratch.save(matched_starts(found, min_words, gram, scratch))
    # A run ends where the next start lies beyond its reach.
    order = Window.partitionBy("c").orderBy("lo", "hi")  # the matches of one text
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    head = starts.distinct().withColumn("head", F.coalesce(F.col("lo") - reached > min_words, F.lit(True)).cast("int"))
    numbered = head.withColumn("run", F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("c", "run").agg(F.min("lo").alias("first_word"), (F.max("hi") + min_words - F.min("lo")).alias("n_words")).drop("run")
    whole = kinds.where((F.col("words") >= min_words) & ((F.col("first.doc_id") < F.col("last")) | ((F.col("nulls") > 0) & F.col("first.doc_id").isNotNull())))
    whole = whole.select("c", F.lit(0).alias("first_word"), F.col("words").alias("n_words"))
    found = scratch.save(runs.join(whole.select("c"), "c", "left_anti").unionByName(whole))
    out = texts.select("doc_id", "c1", "c2").distinct().join(kinds.select("c1", "c2", "c"), ["c1", "c2"]).join(found, "c")
    return out.select("doc_id", F.col("first_word").cast("long").alias("first_word"), F.col("n_words").cast("long").alias("n_words"))


def oracle() -> str:
    """The same rows in SQL: every window of words, as a string."""
    return rf"""
        WITH d AS (SELECT DISTINCT coalesce(doc_id, -1) AS k, doc_id, trim(regexp_replace(lower(coalesce(text, '')), '{BLANKS}', ' ', 'g'), ' ') AS t FROM documents),
        w AS (SELECT k, doc_id, t, string_split(t, ' ') AS w FROM d WHERE t <> ''),
        s AS (SELECT k, doc_id, t, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS st, w FROM w WHERE len(w) >= {MIN_WORDS}),
        g AS (SELECT k, doc_id, t, st, md5(array_to_string(w[st + 1:st + {MIN_WORDS}], ' ')) AS g FROM s),
        again AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT (k, md5(t))) > 1),
        hit AS (SELECT k, doc_id, t, st, lag(st) OVER (PARTITION BY k, md5(t) ORDER BY st) AS before FROM g WHERE g IN (SELECT g FROM again)),
        run AS (SELECT *, sum((before IS NULL OR st - before > {MIN_WORDS})::INT) OVER (PARTITION BY k, md5(t) ORDER BY st) AS run FROM hit)
        SELECT doc_id, min(st) AS first_word, max(st) + {MIN_WORDS} - min(st) AS n_words FROM run GROUP BY k, doc_id, md5(t), run"""
