"""Token alignment against a plain loop over bytes, ids and pairs."""

import hashlib
import os
import random
from collections import Counter

import pytest

from quillmark.llm import token_alignment as A

pytestmark = pytest.mark.skipif(not os.path.isdir(A.TOKENIZERS), reason="tokenizer files are absent")

TEXTS = [
    "hello world", "", None, " leading", "trailing ", "two  blanks", "tab\t and \n lines \n\n x", "\n", " ", "  ", "a \n b \t ", "word▁word other", "<|endoftext|> <s> </s>", "é́ 😀 中国 नमस्ते", "\x00 \x1c \x85 　 x",
    "don't you'll WE'VE 12345 3.14", "x" * 500, "hello world", "hello    world", "   many   ", "q" + " " * 3000 + "q", "\x1c y\x1f z", "end\n ",
]


def plain(t, text):
    if not text:
        return None
    want = (" " + text).encode()
    a = t._full.encode(" " + text, add_special_tokens=False).ids
    b = t._b.encode(text)
    if b"".join(t.a_bytes[i] for i in a) != want or b"".join(t.b_bytes[i] for i in b) != want:
        return None
    owner_a = [k for k, i in enumerate(a) for _ in t.a_bytes[i]]
    owner_b = [k for k, i in enumerate(b) for _ in t.b_bytes[i]]
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    ends = [n for n in range(1, len(want) + 1) if n == len(want) or owner_a[n] != owner_a[n - 1] and owner_b[n] != owner_b[n - 1]]
    groups, at = [], 0
    for end in ends:
        own = [",".join(str(ids[k]) for k in sorted(set(owner[at:end]))) for ids, owner in ((a, owner_a), (b, owner_b))]
        groups.append("|".join(own))
        at = end
    return len(a), len(b), len(groups), [(a[i], b[j]) for i, j in links], hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute(texts):
    t = A.tokenizers(A.TOKENIZERS)
    each = [plain(t, x) for x in texts]
    count = Counter(p for e in each if e for p in e[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if e is None else
        (e[0], e[1], e[2], len(e[3]), sum(count[p] == most[p[1]] for p in e[3]), sum(count[p] for p in e[3]), e[4])
        for e in each
    ], count, most


def rows_of(df):
    return sorted((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, block string, n_a int")


def test_rows_match_brute_force(spark):
    want, count, most = brute(TEXTS)
    docs, counts = A.aligned(frame(spark, TEXTS).repartition(3))
    assert rows_of(docs) == list(enumerate(want))
    assert {(r.a, r.b): (r.n, r.best) for r in counts.collect()} == {p: (n, n == most[p[1]]) for p, n in count.items()}


def test_random_texts_match_brute_force(spark):
    rnd = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "word", "Ünïcode", "😀", "123", "'s", "n't", "...", " ", "　", "\x1c", "the", "中", "\r\n", "<s>", "x"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    want, _, _ = brute(texts)
    assert rows_of(A.alignment_report(frame(spark, texts).repartition(4))) == list(enumerate(want))


def test_driver_texts_match_brute_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("driver tables are absent")
    docs = spark.read.parquet(path)
    got = docs.select("doc_id", "text").collect()
    want, _, _ = brute([r.text for r in got])
    assert rows_of(A.alignment_report(docs)) == sorted(zip([r.doc_id for r in got], want, strict=True))


def test_small_blocks_give_the_same(spark, monkeypatch):
    t = A.tokenizers(A.TOKENIZERS)
    texts = [x for x in TEXTS if x]
    whole = A.aligned_block(t, texts)
    monkeypatch.setattr(A, "CALL_CHARS", 3)
    small = A.aligned_block(t, texts)
    assert (whole.counts == small.counts).all() and whole.digests == small.digests and (whole.pairs == small.pairs).all() and (whole.times == small.times).all()


def test_edges(spark):
    assert A.alignment_report(frame(spark, [])).collect() == []
    df = spark.createDataFrame([(None, "same text"), (None, "same text"), (2**60 + 1, "same text"), (3, None)], "doc_id long, text string")
    rows = A.alignment_report(df).collect()
    assert len(rows) == 4 and {r.count_sum for r in rows if r.doc_id != 3} == {3 * r.n_links for r in rows if r.doc_id == 2**60 + 1}
    assert all(x is None or x == 0 or x == "" or x == 3 for r in rows if r.doc_id == 3 for x in r)


def test_only_missing_texts(spark):
    rows = A.alignment_report(frame(spark, [None, "", "▁"])).collect()
    assert [tuple(r)[1:] for r in rows] == [(0, 0, 0, 0, 0, 0, "")] * 3
