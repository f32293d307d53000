"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the bytes of the same text. Where tokens of both end at a
byte, the text falls into groups; two tokens whose bytes overlap are linked.

Texts are tokenized in blocks. Both tokenizers cut at most blanks, whatever
stands around, so a block is taken as stretches from blank to blank, of which
each distinct one is tokenized and aligned once. A block gives one row for each document, and one
posting list for each linked pair of ids: which of its documents hold the pair,
and how often. The lists are shuffled by B id and A id, where the counts of all
pairs, summed ahead of their own shuffle, and the highest count of each B id
meet them in a merge of sorted streams that may spill. Each list then goes to
its block with what its pair counts, and the contributions are summed by
document. No step gathers the postings of an id: a frequent B id is spread over
its A ids, and adaptive execution splits what is still hot.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm._common import Scratch

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a block of texts, and its documents at most; a longer text is a block of its own.
BLOCK_CHARS, BLOCK_DOCS = 1_000_000, 30_000
#: How text is split before merges. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The fast library overflows its stack on very long runs of blanks; texts with one go to the other.
_LONG_BLANKS = re.compile(r"\s{2000}")
#: A blank that may be no cut: after a blank, or between other white space, or between that and the end.
_NO_CUT = re.compile(r"  |\s (?:\s|\Z)")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Characters that are tokenized in one call, unless a single stretch is longer.
CALL_CHARS = 20_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character: itself, or the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens, loaded once a process."""

    def __init__(self, folder: str) -> None:
        import sentencepiece
        import tiktoken

        self.folder = folder
        with open(f"{folder}/{A_FILE}", encoding="utf-8") as f:
            stored = json.load(f)
        of_char = _byte_of_char()
        special = {t["content"] for t in stored["added_tokens"]}
        ranks = {bytes(of_char[c] for c in k): i for k, i in stored["model"]["vocab"].items() if k not in special}
        # The merges of the file are in the order of their ids, so ids are ranks.
        self._fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{B_FILE}")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for k, i in ranks.items():
            self.a_bytes[i] = k
        pieces = [self._b.id_to_piece(i) for i in range(self._b.piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Each id with the mark that follows it: in a group, at its end, at the end of a stretch.
        self.a_marks = [f"{i}{m}" for i in range(len(self.a_bytes)) for m in ",|"]
        self.b_marks = [f"{i}{m}" for i in range(len(self.b_bytes)) for m in ",;\n"]
        #: No piece goes on over a blank, so a blank after another character is a cut.
        self._cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self._blank = self._b.piece_to_id("▁")

    @functools.cached_property
    def _full(self):
        """The other library for A, loaded where a text asks for it."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out = Tokenizer.from_file(f"{self.folder}/{A_FILE}")
        out.encode_special_tokens = True
        return out

    def stretches(self, text: str) -> list[str]:
        """Blank and text, cut where both tokenizers cut for sure; each stretch without the blank it starts with.

        A cut stands before a blank that follows white space other than a blank,
        if none comes after it, or that follows any other character.
        """
        if not self._cuts:
            return [text]
        whole = " " + text
        if _NO_CUT.search(whole):
            return [x[1:] for x in _CUT.split(whole)]
        return text.split(" ")

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """A and B ids of a blank and a text, or none where the bytes of either differ from these."""
        whole = " " + text
        want = whole.encode("utf-8", "surrogatepass")
        a = self._full.encode(whole, add_special_tokens=False).ids if _LONG_BLANKS.search(text) else self._fast.encode_ordinary(whole)
        b = self._b.encode(text) if text else [self._blank]
        same = b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
        return (a, b) if same else None

    def encode_stretches(self, stretches: list[str]) -> tuple[list[int], list[int], list[int]]:
        """A and B ids of all stretches one after another, and the numbers of stretches without tokens."""
        a: list[int] = []
        b: list[int] = []
        bad: list[int] = []
        for first, stop in _calls(stretches):
            ids = self.encode(" ".join(stretches[first:stop]))
            if ids:
                a += ids[0]
                b += ids[1]
                continue
            for i in range(first, stop):  # the few that cannot be given back are found one by one
                one = self.encode(stretches[i])
                if one:
                    a += one[0]
                    b += one[1]
                else:
                    bad.append(i)
        return a, b, bad


def _calls(stretches: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of stretches that are tokenized in one call.

    Between two characters that are not white space a blank is a cut; stretches
    that begin or end otherwise go alone.
    """
    first = size = 0
    for i, x in enumerate(stretches):
        plain = x and not x[0].isspace() and not x[-1].isspace()
        if first < i and (not plain or size + len(x) > CALL_CHARS):
            yield first, i
            first, size = i, 0
        size += len(x)
        if not plain:
            yield i, i + 1
            first, size = i + 1, 0
    if first < len(stretches):
        yield first, len(stretches)


@functools.lru_cache(maxsize=2)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


class Aligned(NamedTuple):
    """Of each stretch: ``groups`` as they are digested, and ``n_a, n_b, n_groups, n_links``.

    ``links`` holds ``b << 32 | a`` of the linked pairs, stretch by stretch.
    """

    groups: list[str]
    counts: np.ndarray
    links: np.ndarray


def align(t: Tokenizers, a: list[int], b: list[int], sizes: np.ndarray) -> Aligned:
    """Groups and links of two lists of tokens over the same bytes, with cuts of both after every ``sizes`` bytes."""
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    ends, ends_a, ends_b = np.cumsum(sizes), np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
    at_a, at_b = np.zeros(int(sizes.sum()) + 1, bool), np.zeros(int(sizes.sum()) + 1, bool)
    at_a[ends_a], at_b[ends_b] = True, True
    # What lies between two cuts belongs to one token of each side, and each linked pair has one such part.
    cuts, shared = np.flatnonzero(at_a | at_b), np.flatnonzero(at_a & at_b)
    in_a, in_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
    stops = [np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, shared, cuts)]
    marks_a, marks_b = 2 * a, 3 * b
    marks_a[last_a] += 1
    marks_b[last_b] += 1
    marks_b[stops[1] - 1] += 1
    # A group's A ids stand before its B ids.
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    before_b = np.repeat(np.cumsum(n_b) - n_b, n_a)
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + before_b] = [t.a_marks[i] for i in marks_a.tolist()]
    out[np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)] = [t.b_marks[i] for i in marks_b.tolist()]
    counts = np.stack([np.diff(x, prepend=0) for x in stops], 1)
    return Aligned("".join(out.tolist()).split("\n")[:-1], counts, b[in_b] << 32 | a[in_a])


class Block(NamedTuple):
    """``counts`` has n_a, n_b, n_groups, n_links by document; ``pairs`` are sorted, with their documents and times from ``starts`` on."""

    counts: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    times: np.ndarray


def aligned_block(t: Tokenizers, texts: list[str | None]) -> Block:
    parts: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = t.stretches(text)
            sizes[i] = len(own)
            parts += own
    place = {x: i for i, x in enumerate(dict.fromkeys(parts))}
    distinct = list(place)
    a, b, bad = t.encode_stretches(distinct)
    good = np.ones(len(distinct), bool)
    good[bad] = False
    made = align(t, a, b, np.array([1 + len(x.encode("utf-8", "surrogatepass")) for x, ok in zip(distinct, good.tolist(), strict=True) if ok], np.int64))
    ids = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
    doc = np.repeat(np.arange(len(texts)), sizes)
    whole = np.ones(len(texts), bool)
    whole[doc[~good[ids]]] = False
    kept = whole[doc]
    ids, doc = (np.cumsum(good) - 1)[ids[kept]], doc[kept]
    counts = np.stack([np.bincount(doc, made.counts[ids, k], len(texts)) for k in range(4)], 1).astype(np.int64)
    digests, at, every = [], 0, ids.tolist()
    for n in np.where(whole, sizes, 0).tolist():
        digests.append(hashlib.sha256(";".join(map(made.groups.__getitem__, every[at : at + n])).encode()).hexdigest() if n else "")
        at += n
    # Each place of a stretch in the texts reads its links.
    n_links = made.counts[ids, 3]
    first = (np.cumsum(made.counts[:, 3]) - made.counts[:, 3])[ids]
    read = np.arange(int(n_links.sum())) + np.repeat(first - (np.cumsum(n_links) - n_links), n_links)
    known, number = np.unique(made.links, return_inverse=True)
    keys, times = np.unique(number[read] << 15 | np.repeat(doc, n_links), return_counts=True)
    pair = keys >> 15
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    return Block(counts, digests, known[pair[starts]], starts, (keys & 0x7FFF).astype(np.int16), times.astype(np.int32))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Keys and texts of each block."""
    for batch in batches:
        texts = batch.column(1)
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in texts]
        at = size = 0
        for i, n in enumerate(sizes):
            if i > at and (size + n > BLOCK_CHARS or i - at >= BLOCK_DOCS):
                yield batch.column(0).slice(at, i - at), texts.slice(at, i - at).to_pylist()
                at, size = i, 0
            size += n
        if at < len(sizes):
            yield batch.column(0).slice(at), texts.slice(at).to_pylist()


_LISTS = pa.list_(pa.int16()), pa.list_(pa.int32())


def tokenized(docs: DataFrame, key_col: str, text_col: str, folder: str) -> DataFrame:
    """Rows of documents (``key`` and counts) and of posting lists (``b, a, docs, times``), each with their ``block``."""
    kind = docs.schema[key_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(kind)
    names = ["block", "doc", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "b", "a", "docs", "times"]
    types = [pa.int64(), pa.int16(), key_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), *_LISTS]

    def rows(n: int, **have: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, block = tokenizers(folder), TaskContext.get().partitionId() << 32
        for keys, texts in _blocks(batches):
            made, n = aligned_block(t, texts), len(texts)
            yield rows(
                n, block=pa.array(np.full(n, block)), doc=pa.array(np.arange(n, dtype=np.int16)), key=keys, groups_sha256=pa.array(made.digests, pa.string()),
                **{c: pa.array(made.counts[:, k]) for k, c in enumerate(["n_a", "n_b", "n_groups", "n_links"])},
            )
            ends = pa.array(np.append(made.starts, len(made.docs)), pa.int32())
            for at in range(0, len(made.pairs), 10_000):
                own = made.pairs[at : at + 10_000]
                part = ends.slice(at, len(own) + 1)
                yield rows(
                    len(own), block=pa.array(np.full(len(own), block)), b=pa.array((own >> 32).astype(np.int32)), a=pa.array((own & 0xFFFFFFFF).astype(np.int32)),
                    docs=pa.ListArray.from_arrays(part, pa.array(made.docs)), times=pa.ListArray.from_arrays(part, pa.array(made.times)),
                )
            block += 1

    schema = f"block long, doc short, key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, b int, a int, docs array<short>, times array<int>"
    return docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """``b, a, n, best``: how many links hold each pair, and whether no pair of its B id has more.

    A B id has at most as many rows as the A vocabulary has ids.
    """
    links = F.aggregate("times", F.lit(0).cast("long"), lambda acc, n: acc + n)
    counts = postings.groupBy("b", "a").agg(F.sum(links).alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The rows of documents, and the counts of pairs: ``b, a, n, best``.

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``, a row per input row. A null or empty text, or one that
    either tokenizer does not give back byte for byte, has zeros and an empty
    digest. Repeated rows are documents of their own and count each; null ids
    stay; other columns are not read; an empty table gives no rows. Of pairs
    with the same highest count all are best.
    """
    scratch = Scratch(docs.sparkSession)
    both = scratch.save(tokenized(docs, id_col, text_col, folder))
    postings = both.where("b IS NOT NULL").select("block", "b", "a", "docs", "times")
    # Written before the join, so that the join can split the rows of a hot pair.
    counts = scratch.save(pair_counts(postings))
    lists = postings.join(counts, ["b", "a"]).select("block", "docs", "times", "n", "best")
    each = lists.repartition("block").select("block", "n", "best", F.explode(F.arrays_zip("docs", "times")).alias("p"))
    sums = each.select("block", F.col("p.docs").alias("doc"), F.col("p.times").alias("times"), "n", "best").groupBy("block", "doc").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rows = both.where("doc IS NOT NULL").select("block", "doc", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    out = rows.join(sums, ["block", "doc"], "left").select(
        F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return out, counts


def alignment_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """The rows of documents that ``op12_token_alignment`` returns."""
    return aligned(docs, id_col, text_col, folder)[0]
