"""The training-data operators on small fixtures: brute force, round trips, edge cases."""

import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import chat_format, components, decontaminate, exact_dedup, html_extract, language_id, license_scan, mixing, simhash_dedup, suffix_dedup, toxicity
from quillmark.llm._common import Scratch
from quillmark.llm.license_rules import BASE, RULES

LONG = " ".join(f"w{i}" for i in range(9000))
BIG = 2**60 + 1
#: Repeated rows, nulls in every column, empty and long texts, a clashing extra column.
ROWS = [
    (1, "hello world. MIT License", None, "a", 9), (1, "hello world. MIT License", None, "a", 9), (2, None, "en", None, 9), (3, "", "en", "b", 9),
    (None, "hello \t world. MIT License", "en", "b", None), (BIG, "the end of text", "fr", "b", 9), (7, LONG, "en", "a", 9), (8, LONG + " x", "en", "a", 9), (9, " \t", "en", "a", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def made(df):
    return [tuple(r) for r in df.collect()]


# --- licence scan


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_places(w):
    out = []
    for _, phrase, label in BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(out)


LICENCES = [
    "Licensed under CC BY-NC 4.0.", "CC BY CC-BY cc by", "GNU General Public License, version 3. and the Apache\n\nLicense, Version 2.0", "MIT LICENSEE", "the MIT License", "mit license mit license",
    "KKMIT license", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the MIT License.", None, "", "...", "ÀMIT License",
]


def test_license_base_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LICENCES)], "doc_id long, text string")
    for r in license_scan.license_report(df).collect():
        w = words_of(LICENCES[r.doc_id])
        at = base_places(w)
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_license_suppression(spark):
    df = spark.createDataFrame([(1, "x GNU General Public License, version 3.0 or later")], "doc_id long, text string")
    found = license_scan.scan_licenses(df).first().detections
    assert [(d.label, d.start, d.stop) for d in found] == [("gpl-3.0-or-later", 1, 10)]
    assert len(RULES) >= 200


def written_from(pattern, rnd):
    """A text that a pattern matches, drawn at random."""
    def draw(parsed):
        out = ""
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                kind, x = rnd.choice(arg)
                out += chr(x) if str(kind) == "LITERAL" else chr(rnd.randint(*x))
            elif name == "ANY":
                out += "x"
            elif name == "BRANCH":
                out += draw(rnd.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += draw(arg[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(draw(arg[2]) for _ in range(rnd.randint(arg[0], min(arg[1], arg[0] + 2))))
            else:
                raise AssertionError(name)
        return out

    return draw(re._parser.parse(pattern))


def test_license_rules_match_their_keywords():
    """Whatever a pattern matches holds one of its rule's keywords, so the prefilter loses nothing."""
    rnd = random.Random(3)
    for keywords, pattern, label, priority in RULES:
        assert keywords and 0 <= priority < len(license_scan.CONFIDENCE)
        for _ in range(60):
            text = written_from(pattern, rnd)
            assert re.fullmatch(pattern, text), (pattern, text)
            assert set(keywords.split()) & set(text.split()), (label, text)


# --- simhash


def brute_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hash_is_xxh64_with_seed_42(spark):
    import xxhash

    got = spark.sql("SELECT xxhash64('some words here') AS h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"some words here", 42)


def test_simhash_groups_match_brute_force(spark):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice("ABCdefghij") * 2 + str(rnd.randrange(40)) for _ in range(rnd.randrange(0, 90))) for _ in range(60)]
    texts = base + [t + " tail" for t in base] + [t.upper() for t in base[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fp = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(fp)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fp)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.simhash_groups(df, subtree=8).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in range(len(fp))}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_trie_links_are_complete(radius):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(0, 2**63, 200, dtype=np.int64).view(np.uint64), 4)
    for _ in range(radius):
        x = np.where(rng.random(len(x)) < 0.6, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)), x)
    x = np.unique(x)
    want = {(int(x[i]), int(x[j])) for i, j in zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= radius), strict=True) if i < j}
    got = {(int(x[i]), int(x[j])) for a, b in simhash_dedup.links(x, None, simhash_dedup.budgets(radius)) for i, j in zip(a, b, strict=True)}
    assert got == want and want


@pytest.mark.parametrize("crowd", [6, 40, 1 << 20])
def test_crowded_subtrees_split(spark, crowd):
    """Fingerprints that stand close together, under one prefix, with and without deeper levels."""
    rng = np.random.default_rng(7)
    centre = np.uint64(0x0123456789ABCDEF)
    bits = np.uint64(1) << rng.integers(0, 50, (300, 6)).astype(np.uint64)
    x = np.unique(np.concatenate((np.bitwise_xor.reduce(bits, axis=1) ^ centre, rng.integers(0, 2**63, 60, dtype=np.int64).view(np.uint64))))
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 2
    root = np.arange(len(x))
    for i, j in zip(*np.nonzero(near), strict=True):
        root[root == max(root[i], root[j])] = min(root[i], root[j])
    signed = x.view(np.int64).tolist()
    rows = spark.createDataFrame([(v, v) for v in signed], "node long, f0 long")
    links = simhash_dedup.near_links(rows, subtree=8, crowd=crowd)
    got = {r.node: r.root for r in components.connected_components(links).collect()}
    groups = {}
    for k, v in enumerate(signed):
        groups.setdefault(got.get(v, v), set()).add(k)
    want = {}
    for k, r in enumerate(root.tolist()):
        want.setdefault(r, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_groups_find_copies(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for g in range(12):
        w = [f"t{rnd.randrange(10**6)}" for _ in range(300)]
        for c in range(4):
            v = list(w)
            for _ in range(c):
                v[rnd.randrange(300)] = "changed"
            want[len(rows)] = g * 4
            rows.append((len(rows), " ".join(v)))
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def near_brute(texts):
    """The least index of each text's component at a Jaccard similarity of 0.8 of five-word shingle sets."""
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
            root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return dict(enumerate(root))


def near_ids(spark, texts):
    return {r.doc_id: r.component_id for r in simhash_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_near_groups_lose_no_pair(spark):
    rnd, texts = random.Random(8), []
    words = lambda n: [f"t{rnd.randrange(10**6)}" for _ in range(n)]
    for n in (8, 10, 14, 40, 100, 300):
        for _ in range(25):
            w = words(n)
            longer = w + words((n - 4) // 4)  # a similarity of 0.8 or little more
            texts += [" ".join(w), " ".join(longer)]
    want = near_brute(texts)
    assert all(want[i] == i - i % 2 for i in want)
    assert near_ids(spark, texts) == want


@pytest.mark.parametrize(("rows", "shingles"), [(3, 1 << 20), (65536, 60), (3, 60)])
def test_near_groups_of_crowded_families(spark, monkeypatch, rows, shingles):
    """Buckets and families beyond a task's share give the groups of the same texts in one task."""
    rng = random.Random(5)
    texts = []
    for f in range(3):
        base = [f"w{f}x{k}" for k in range(60)]
        for _ in range(12):  # a walk of small steps: its ends are far apart, its neighbours near
            base = list(base)
            base[rng.randrange(60)] = f"v{rng.randrange(1000)}"
            texts.append(" ".join(base))
    texts += ["alone here with other words that nobody has", "", " "]
    want = near_brute(texts)
    monkeypatch.setattr(simhash_dedup, "NEAR_TASK_ROWS", rows)
    monkeypatch.setattr(simhash_dedup, "NEAR_TASK_SHINGLES", shingles)
    assert near_ids(spark, texts) == want and 3 < len(set(want.values())) < len(texts) - 20


def test_near_candidates_come_from_the_trie(spark):
    """Fingerprints within two bits are candidates without any band; the sketch then decides."""
    rnd = random.Random(21)
    own = [f"t{rnd.randrange(10**6)}" for _ in range(400)]
    line = [f"t{rnd.randrange(10**6)}" for _ in range(21)]
    texts = [" ".join(own), " ".join(own[:-1]), " ".join(own[:200] + line * 1000), " ".join(own[200:] + line * 1000), "quite another text"]
    f = [simhash_dedup.fingerprint(t) for t in texts]
    assert (f[0] ^ f[1]).bit_count() <= 2 and (f[2] ^ f[3]).bit_count() <= 2 < (f[0] ^ f[2]).bit_count()
    f0, *_, sketch, bands = simhash_dedup.sketches(texts)
    scratch = Scratch(spark)
    held = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f0)], "node long, f0 long")
    groups = simhash_dedup.fingerprint_groups(held, scratch)
    assert {tuple(sorted(r.nodes)) for r in groups.groupBy("bucket").agg(F.collect_list("node").alias("nodes")).collect()} == {(0, 1), (2, 3)}
    for kept in ([[]] * 5, [[int(b) for b in row] for row in bands]):
        distinct = spark.createDataFrame([(i, x, b) for i, (x, b) in enumerate(zip(sketch, kept, strict=True))], "node long, sketch binary, bands array<long>")
        assert {tuple(sorted(r)) for r in simhash_dedup.candidate_links(distinct, groups, scratch).collect()} == {(0, 1)}


def test_near_groups_link_nothing_below(spark):
    rnd, texts = random.Random(12), []
    words = lambda n: [f"t{rnd.randrange(10**6)}" for _ in range(n)]
    line = words(20)
    for _ in range(6):  # own words around one line, which repeats
        texts.append(" ".join(words(200) + line * 40))
    for n in (60, 200):
        for tail in (0.3, 0.36, 0.42):  # similarities of 0.77 to 0.70
            for _ in range(8):
                w = words(n)
                texts += [" ".join(w), " ".join(w + words(int(n * tail)))]
    own = words(120)
    texts += [" ".join(own + line), " ".join(own + line * 40)]  # one set but for the seams
    chain = words(200)
    texts += [" ".join(chain[i : i + 180]) for i in (0, 10, 20)]
    want = near_brute(texts)
    assert len(set(want.values())) == len(texts) - 3
    assert near_ids(spark, texts) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5001), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert sorted(map(len, groups.values())) == [2, 50, 61]
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact dedup


@pytest.mark.parametrize("block", [1, 3, 64])
def test_exact_dedup_matches_brute_force(spark, block):
    rnd = random.Random(block)
    texts = ["".join(rnd.choice("ab \n") for _ in range(rnd.randrange(0, 14))) for _ in range(150)] + ["x" * 300 + e for e in "aab"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_chars=block).collect()}
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t) for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), i == same[0])
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_repeated_rows(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    group = [r for r in got if r.group_size == 3]
    assert sum(r.kept for r in group) == 1 and {r.keep_id for r in group} == {1}


# --- toxicity, language


def test_toxicity_learns_and_locates(spark):
    rnd = random.Random(2)
    plain, bad = [f"word{i}" for i in range(300)], ["vileone", "vilest", "grossly"]
    rows, labels = [], []
    for i in range(400):
        s = [" ".join(rnd.choice(plain) for _ in range(8)) for _ in range(5)]
        if i % 4 == 0:
            s[2] += " " + rnd.choice(bad)
        rows.append((i, ". ".join(s)))
        labels.append((i, 1, int(i % 4 == 0)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(d, lab).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    text = dict(rows)
    hits = [text[r.doc_id][r.worst_start : r.worst_stop] for r in held if r.predicted and r.doc_id % 4 == 0]
    assert np.mean([any(b in h for b in bad) for h in hits]) > 0.9


def test_toxicity_scores_match_the_formula(spark):
    """A row's score against the noisy-or written out, sentence by sentence, for every kind of text."""
    m = toxicity.Model({"bad": 3.0, "^wor": 1.5, "worse": 1.0, "fine": -2.0}, -1.5)

    def brute(text):
        clean = 1.0
        for s in [s for s in re.split(r"[.!?\n]", text or "") if s] or [""]:
            z = -1.5
            for w in re.findall(r"\w+", s.lower()):
                z += m.weights.get(w, 0.0) + sum(m.weights.get("^" + w[:n], 0.0) for n in range(3, 8) if n <= len(w))
            clean *= 1 / (1 + np.exp(z))
        return 1 - clean

    texts = ["Bad! fine. Worse words\nso", "fine fine", None, "", "...", "bad " * 200, "a. " * 4000 + "worse", "bad. bad.", "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "bad"), (0, texts[0])]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in got) == sorted((str(i), round(brute(t), 9)) for i, t in rows)
    spans = {r.doc_id: (r.worst_start, r.worst_stop) for r in got}
    assert spans[0] == (10, 22) and spans[2] == (None, None) and spans[7] == (0, 3)


@pytest.mark.parametrize("n", [2, 4, 9])
def test_decoding_matches_brute_force(n):
    rng = np.random.default_rng(n)
    codes = language_id.codewords(n)
    trust = rng.random(codes.shape[1])
    m = language_id.Model([f"l{i}" for i in range(n)], codes, rng.normal(0, 3, (language_id.BUCKETS, codes.shape[1])).astype(np.float32), np.zeros(codes.shape[1]), trust / trust.sum())
    for text in ("some words", "àé", "x" * 5000, "a"):
        f = language_id.margins(text, m)
        loss = [sum(t * np.log1p(np.exp(-c * x)) for t, c, x in zip(m.trust, code, f, strict=True)) for code in codes.tolist()]
        lang, score, gap = language_id.decode(f, m)
        odds = sorted(np.exp(-4 * np.array(loss)) / np.exp(-4 * np.array(loss)).sum())
        assert lang == f"l{int(np.argmin(loss))}"
        assert (score, gap) == pytest.approx((odds[-1], odds[-1] - odds[-2]), rel=1e-4)


def test_every_label_is_learned(spark):
    rows = [(i, f"{chr(97 + i % 70 // 10)}{i % 10}{chr(97 + i % 7)} " * 9, f"l{i % 70}") for i in range(700)]
    m = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("lang"))
    assert len(m.langs) == 70 and len({tuple(c) for c in m.codes.tolist()}) == 70


def test_language_held_out_accuracy(spark):
    rnd = random.Random(4)
    syllables = {"aa": "the ing ed th er".split(), "bb": "sch ung keit ein ich".split(), "cc": "que oi eau ment lle".split(), "dd": "ción ado os ez rr".split()}
    rows = [(i, " ".join("".join(rnd.choice(syllables[k]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 40))), k) for i, k in enumerate(list(syllables) * 60)]
    got = language_id.language_report(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()
    held = [r for r in got if r.held_out]
    assert held and np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) > 0.97


def test_language_without_letters(docs):
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.language_report(docs).collect()]
    assert {d for d, lang, s in got if lang == "und" and s == 0} == {2, 3, 9}
    assert BIG in {d for d, _, _ in got}
    kept = language_id.with_language(docs, language_id.fit(docs, F.col("lang")))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_codewords_are_apart(n):
    c = language_id.codewords(n)
    assert len({tuple(r) for r in c.tolist()}) == n


# --- mixing


def test_solve():
    e, w = mixing.solve([900, 90, 10], 1000, None, None)
    assert e == 1 and w == pytest.approx([0.9, 0.09, 0.01])
    e, w = mixing.solve([900, 90, 10], 1000, 0.9, None)
    assert mixing.entropy(w) == pytest.approx(0.9 * np.log(3), abs=1e-6)
    e, w = mixing.solve([900, 90, 10], 1000, 1.0, 4.0)
    assert max(x * 1000 / s for x, s in zip(w, (900, 90, 10), strict=True)) == pytest.approx(4.0, rel=1e-6)


def test_mix_meets_its_budget(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 30)), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_docs=16, target_entropy=0.95).collect()
    total = sum(len(t.split()) for _, t, _ in rows)
    size, drawn, weight = {}, {}, {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    for r in got:
        drawn[r.source] = drawn.get(r.source, 0) + r.tokens
        weight[r.source] = r.weight
    for s in size:
        assert 0 <= drawn[s] - weight[s] * total < 30  # at most the last document overruns
        assert drawn[s] <= 4 * size[s] + 30
    per = {}
    for r in got:
        per.setdefault((r.source, r.doc_id), []).append(r.epoch)
    assert all(sorted(e)[:-1] == list(range(1, len(e))) or sorted(e) == list(range(min(e), max(e) + 1)) for e in per.values())


def brute_mix(rows, budget, exponent, per_block, seed, hashes):
    """Sources' blocks in the order of their hashes, epoch by epoch, until the quota is met."""
    size = {}
    for _, n, s in rows:
        size[s] = size.get(s, 0) + n
    top = max(size.values())
    raised = {s: (n / top) ** exponent for s, n in size.items() if n}
    out = set()
    for s, r in raised.items():
        quota = r / sum(raised.values()) * budget
        blocks = max(1, -(-sum(x[2] == s for x in rows) // per_block))
        place = {x: hashes["block"][x[0]] % blocks for x in rows if x[2] == s}
        taken, epoch = 0, 0
        while taken < quota:
            epoch += 1
            for b in sorted(set(place.values()), key=lambda b: (hashes["turn"][s, b, epoch], b)):
                mine = sorted((x for x in place if place[x] == b), key=lambda x: (hashes["spread"][x[0], epoch], x[0]))
                whole = taken + sum(x[1] for x in mine) <= quota
                if taken >= quota:
                    break
                for x in mine:
                    if whole or taken < quota:
                        out.add((x[0], epoch, b))
                    taken += x[1]
    return out


def test_mix_matches_brute_force(spark):
    rnd = random.Random(18)
    rows = [(i, rnd.randrange(0, 30), rnd.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, n, s in rows], "doc_id long, text string, source string")
    got = mixing.mix(df, block_docs=16, target_entropy=0.95).collect()
    exponent = got[0].exponent
    ids = df.select("doc_id", F.xxhash64("text").alias("t"))
    hashes = {"block": {r[0]: r[1] for r in ids.select("doc_id", F.xxhash64("doc_id", "t", F.lit(1))).collect()}}
    some = spark.createDataFrame([(s, b, e) for s in ("hot", "a", "b", None) for b in range(40) for e in range(1, 8)], "source string, block long, epoch int")
    hashes["turn"] = {(r[0], r[1], r[2]): r[3] for r in some.select("source", "block", "epoch", F.xxhash64("source", "block", "epoch", F.lit(1))).collect()}
    draws = ids.crossJoin(spark.range(1, 8).select(F.col("id").cast("int").alias("epoch")))
    hashes["spread"] = {(r[0], r[1]): r[2] for r in draws.select("doc_id", "epoch", F.xxhash64("doc_id", "t", "epoch", F.lit(1))).collect()}
    want = brute_mix(rows, sum(n for _, n, _ in rows), exponent, 16, 1, hashes)
    assert {(r.doc_id, r.epoch, r.block) for r in got} == want
    assert len(got) == len(want)


def test_mix_odd_tables(spark):
    """Null and repeated sources and rows, ties, no tokens at all."""
    rows = [(1, "a b", None), (1, "a b", None), (2, "a b", "s"), (3, None, "s"), (4, "", "t"), (None, "c d", None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), target_entropy=None).collect()
    assert {r.source for r in got} == {None, "s"} and all(r.exponent == 1.0 for r in got)
    assert sum(r.tokens for r in got) >= 8
    none = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0


# --- repeated passages


def brute_runs(texts, size):
    w = [re.sub(r"[\x20\x09-\x0d]+", " ", (t or "").lower()).strip(" ").split(" ") if (t or "").strip() else [] for t in texts]
    own = {}
    for i, x in enumerate(w):
        for s in range(len(x) - size + 1):
            own.setdefault(tuple(x[s : s + size]), set()).add(i)
    out = set()
    for i, x in enumerate(w):
        runs = []
        for s in range(len(x) - size + 1):
            if len(own[tuple(x[s : s + size])]) > 1:
                if runs and s - runs[-1][1] <= size:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
        out |= {(i, a, b + size - a) for a, b in runs}
    return out


def test_repeated_passages_match_brute_force(spark):
    rnd = random.Random(6)
    passages = [[f"p{k}_{rnd.randrange(5)}" for _ in range(n)] for k, n in enumerate((50, 51, 52, 90))]
    texts = []
    for i in range(60):
        w = [f"r{rnd.randrange(10**6)}" for _ in range(rnd.randrange(0, 120))]
        for p in rnd.sample(passages, rnd.randrange(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        texts.append(" ".join(w))
    texts += texts[:4] + [None, "", "a b c"]
    got = set(made(suffix_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))))
    assert got == brute_runs(texts, 51)


def test_neighbours_across_parts():
    """Parts that are scanned alone and mended agree with a comparison of all pairs."""
    rnd = random.Random(13)
    for _ in range(60):
        rows = sorted(("".join(rnd.choice("ab") + " " for _ in range(rnd.randrange(0, 6))), rnd.randrange(4)) for _ in range(rnd.randrange(1, 25)))
        cuts = sorted(rnd.randrange(len(rows) + 1) for _ in range(rnd.randrange(0, 5)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        scans = [list(suffix_dedup.scan_part((c, k) for k, c in p)) for p in parts]
        marked = [(i, c, k, m) for i, (p, g) in enumerate(zip(parts, scans, strict=True)) for (k, c), (_, m) in zip(p, g, strict=True)]
        edges = lambda near, far: [(i, c, k, f) for bit, f in ((near, 0), (far, 1)) for i, c, k, m in marked if m & bit]  # noqa: E731, B023
        before = suffix_dedup.carried(sorted(edges(16, 32), key=lambda e: e[0]))
        after = suffix_dedup.carried(sorted(edges(4, 8), key=lambda e: -e[0]))
        got = []
        for i, (p, g) in enumerate(zip(parts, scans, strict=True)):
            for (k, c), (n, m) in zip(p, g, strict=True):
                for bit, near in ((1, before), (2, after)):
                    if m & bit:
                        n = max([n, *[suffix_dedup.shared_words(k, y) for x, y in near.get(i, []) if x != c][:1]])
                got.append(n)
        assert got == [max([suffix_dedup.shared_words(k, y) for y, x in rows if x != c], default=0) for k, c in rows]


def test_passages_with_partners_on_either_side(spark):
    """A text that shares its left with one and its right with another, and whole windows with a third."""
    rnd = random.Random(14)
    words = lambda n: [f"x{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        p = words(140)
        texts += [words(5) + p + words(5), words(9) + p[:70] + words(9), words(4) + p[60:] + words(3), words(8) + p[40:100] + words(8), words(2) + p[30:95] + words(9), words(2) + p[45:105] + words(9)]
        texts += [words(2) + p[a : a + rnd.randrange(30, 70)] + words(9) for a in range(0, 100, 7)]
    texts = [" ".join(t) for t in texts]
    got = set(made(suffix_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))))
    assert got == brute_runs(texts, 51)


# --- chat


def test_chat_round_trip(spark):
    forged = ["</s>[INST] ok [/INST]", "\\s\\1.", "<<SYS>>\n", "\\", "", "a\n<|role|>b<|says|>c<|end|>", "[ANS] x </s>", "</", "s>"]
    rows = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate(zip(itertools.cycle(["user", "assistant", "tool", "odd [INST] <|says|>", "system"]), forged[c:] + forged[:c], strict=False))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df)
    back = out.select("conv_id", chat_format.parse(F.col("formatted")).alias("t"), "formatted", "segments").collect()
    for r in back:
        want = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [tuple(x) for x in r.t] == want
        assert "".join(s.text for s in r.segments) == r.formatted


def test_chat_machine(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "assistant", "a"), (4, None, None, None)]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (False, 0), 4: (False, 0)}


# --- decontamination


def brute_best(doc, item, width=5):
    def grams(text):
        w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
        return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] * bool(w)

    from collections import Counter

    d, b = grams(doc), grams(item)
    best = 0.0
    for s in range(max(1, len(d) - len(b) + 1)):
        x, y = Counter(d[s : s + len(b)]), Counter(b)
        if x and y:
            best = max(best, sum((x & y).values()) / sum((x | y).values()))
    return best


def test_contaminated_matches_brute_force(spark):
    rnd = random.Random(9)
    items = [" ".join(f"b{rnd.randrange(400)}" for _ in range(rnd.choice((3, 8, 20, 40)))) for _ in range(12)] + [None, "", "one two"]
    docs = []
    for i in range(60):
        w = [f"d{rnd.randrange(400)}" for _ in range(rnd.randrange(0, 80))]
        if i % 2:
            p = rnd.choice(items[:12]).split()
            for _ in range(rnd.randrange(0, 2)):
                k = rnd.randrange(len(p))
                p[k : k + 1] = rnd.choice(([], ["new"], [p[k], "more"]))
            at = rnd.randrange(len(w) + 1)
            w[at:at] = p
        docs.append(" ".join(w))
    docs += ["One, two!", None]
    dd, bb = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, j) for i, d in enumerate(docs) for j, b in enumerate(items) if d and b and brute_best(d, b) >= 0.8}
    for limit in (10**6, 100):  # one pass over the benchmark's shingles, and several
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(dd, bb, broadcast_rows=limit).collect()}
        assert set(got) == want
        assert all(got[k] == pytest.approx(brute_best(docs[k[0]], items[k[1]])) for k in got)


def test_contaminated_finds_reordered_items(spark):
    rnd = random.Random(21)
    words = lambda n, c: [f"{c}{rnd.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for n in (60, 100, 200):
        for parts in (1, 2, 3):
            for _ in range(5):
                w = words(n, "i")
                cut = [w[n * p // parts : n * (p + 1) // parts] for p in range(parts)]
                items.append(" ".join(w))
                docs.append(" ".join(words(rnd.randrange(150), "d") + sum(reversed(cut), []) + words(rnd.randrange(150), "d")))
    dd, bb = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(i, i): brute_best(docs[i], items[i]) for i in range(len(docs))}
    want = {k: v for k, v in want.items() if v >= 0.8}
    assert len(want) >= 40
    for limit in (10**6, 2000):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(dd, bb, broadcast_rows=limit).collect()}
        assert got == pytest.approx(want)


def test_contaminated_tells_rows_without_ids_apart(spark):
    rnd = random.Random(22)
    words = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    items = [words(30) for _ in range(3)]
    broken = " ".join(items[0].split()[:6] + words(24).split())  # a rare shingle of item 0, but no more
    rows = [(None, broken), (None, items[0]), (None, items[1]), (5, broken), (5, items[0]), (6, items[2])]
    dd, bb = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for limit in (10**6, 40):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(dd, bb, broadcast_rows=limit).collect()}
        assert got == {(None, 0), (None, 1), (5, 0), (6, 2)}


# --- HTML


def test_html_extracts_articles():
    m = html_extract.train()
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- c -->
    <div class="ad">buy</div><div class="cookie-notice">cookies</div><article><h1>T &amp; t</h1><p><b>One   two<br><p>Three&nbsp;<a href=x>four</a></p><p>Q.</p></article>
    <section class="comments"><p>nice</p></section><form><p>mail</p></form><aside class="sidebar"><p>side</p></aside><footer>&copy; end</footer></body></html>"""
    assert html_extract.extract(page, m) == "T & t\n\nOne two\n\nThree four\n\nQ."
    for p in (None, "", "<div", "<p>", "&"):
        assert isinstance(html_extract.extract(p, m), str)


def test_html_parses_hostile_pages_in_linear_time():
    import time

    m = html_extract.train()
    for piece in ('<a "', '<a ">', "<a '>x", "</i>", "<b>", "<i><div>" + "<b>" * 3 + "</i>", "<title>", "<title", "<!--", "<!", "<", "<p", "<td></p>", "<script>"):
        began = time.time()
        for page in (piece * 60_000, "<i>" * 2000 + piece * 60_000, "<div>" + "<b>" * 30_000 + piece * 30_000):
            html_extract.parse(page)
        assert time.time() - began < 12, piece
    assert html_extract.extract('<article><p>a <a href="x>b</a> c</p><p>d "quoted" e</p></article>', m)
    assert html_extract.extract("<title>t<article><p>one</p></article>", m) == "one"
    assert html_extract.extract("<body><h1>T</h1><p>one</p><footer>f</footer></body>", m) == "T\n\none"
    assert html_extract.extract("<article><p>so <math><mi>x</mi></math> is</p></article>", m) == "so x is"


def test_marginals_match_enumeration():
    m = html_extract.train()
    nodes, _ = html_extract.parse("<body><nav><p>a</p></nav><article><p>b</p></article></body>")
    got, weights = html_extract.marginals(nodes, m), {}
    for s in itertools.product((0, 1), repeat=len(nodes)):
        p = m.root if s[0] else 1 - m.root
        for i, n in enumerate(nodes[1:], 1):
            p *= m.tie[html_extract._kind(n)][s[n.parent]][s[i]]
            if s[i]:
                for f in html_extract._evidence(n, nodes[n.parent]):
                    p *= m.odds.get(f, 1.0)
        weights[s] = p
    total = sum(weights.values())
    for i in range(len(nodes)):
        assert got[i] == pytest.approx(sum(p for s, p in weights.items() if s[i]) / total)


def test_html_unescapes_once(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a &amp;amp; b</p></article>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()) == [(1, html.unescape("a &amp;amp; b"), 9), (2, "", 0)]


# --- all: nulls, repeats, long texts, empty tables


OPS = {
    "license": license_scan.license_report, "simhash": simhash_dedup.simhash_groups, "near": simhash_dedup.near_groups, "exact": exact_dedup.exact_dedup,
    "language": language_id.language_report,
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_one_row_per_document(docs, nothing, name):
    got = OPS[name](docs).select("doc_id").collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPS[name](nothing).count() == 0


def test_empty_tables(spark, docs, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(nothing).count() == 0
    assert suffix_dedup.repeated_passages(nothing).count() == 0
    assert decontaminate.contaminated(docs, items).count() == 0
    assert toxicity.toxicity_report(docs, labels).count() == len(ROWS)
    assert toxicity.toxicity_report(nothing, labels).count() == 0


def test_long_texts_repeat(docs):
    assert set(made(suffix_dedup.repeated_passages(docs))) == {(7, 0, 9000), (8, 0, 9000)}


def test_scratch_lies_in_the_shared_folder(spark):
    s = Scratch(spark)
    df = s.save(spark.range(3))
    assert df.count() == 3
    s.drop(df)


def test_word_hashes_of_long_texts():
    """A word has one hash wherever it stands, also across blocks of bytes."""
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.choice((1, 2, 3, 90_000 if i % 997 == 0 else 4)))).encode() for i in range(40_000)]
    seen = {}
    got = suffix_dedup.word_hashes(b" ".join(words)).tolist()
    assert len(got) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, got, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_know_lengths_and_zero_bytes():
    words = [bytes([97] * n) for n in range(1, 140)] + [bytes([97] * n) + bytes(1) for n in range(1, 140)] + [b"a" * 64 + b"b", b"\xc3\xa9" * 9]
    got = suffix_dedup.word_hashes(b" ".join(words))
    assert len(set(got.tolist())) == len(words)
    assert got.tolist() == [suffix_dedup.word_hashes(w)[0] for w in words]


@pytest.mark.parametrize("block", [1 << 16, 60])
def test_minimisers_of_texts_in_one_array(monkeypatch, block):
    """No window reaches into the next text; of tied k-grams the leftmost counts, also across blocks."""
    monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
    rnd = random.Random(15)
    for gram, span in ((15, 37), (2, 3), (1, 1), (3, 8)):
        for kinds in (1, 2, 5, 10**6):
            texts = [[rnd.randrange(kinds) for _ in range(rnd.choice((0, 1, gram, gram + span - 1, rnd.randrange(200))))] for _ in range(6)]
            hashes = [np.array([hash((t, 1)) % (1 << 64) for t in x], np.uint64) for x in texts]
            ends = np.cumsum([len(x) for x in texts])
            want = {}
            for x, end in zip(hashes, ends.tolist(), strict=True):
                g = suffix_dedup.window_hashes(x, gram).tolist()
                for i in range(len(g) - span + 1):
                    at = min(range(i, i + span), key=g.__getitem__)
                    want[end - len(x) + at] = g[at]
            places, h = suffix_dedup.minimisers(np.concatenate(hashes), ends, gram, span)
            assert dict(zip(places.tolist(), h.tolist(), strict=True)) == want
