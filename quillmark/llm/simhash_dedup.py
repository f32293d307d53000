"""SimHash near-dedup with a binary trie self-join.

Distinct fingerprints form a binary trie. Pairs of its nodes are traversed
together from the root; each pair carries the bits in which its two sides
differ so far and is dropped once that exceeds the budget. The top of the trie
is walked on the driver over a histogram of leading bits, 14 of them and more
below crowded prefixes, and gives pairs of subtrees; each pair is one task that walks on to the
fingerprints. A task returns the spanning forest of the links it found, never
the pairs themselves, and passes over pairs of subtrees that are connected
already, so a dense group costs its size and not its square.

``near_groups`` asks for a similarity that two bits do not reach. The same trie
join goes first there; bands of MinHash bring together what it leaves apart,
and exact similarities decide on both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import Scratch, map_texts, text_or_empty
from quillmark.llm.components import connected_components

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
#: Subtrees of about so many fingerprints go to a task together.
SUBTREE = 32768
#: The top of the trie is split so deep at least, so that small inputs are dealt out as large ones are.
MIN_DEPTH = 4
#: Depths to which the driver sees counts of prefixes; beyond the first only of those that hold over CROWD fingerprints.
EDGES = [0, 14, 22, 30, 38, 46, 54, 62]
CROWD = 1 << 21
#: The near-duplicate stage: the sets of five-word shingles have a Jaccard similarity of 0.8 or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8
#: MinHash bands: a pair at 0.8 agrees on no band with a probability of (1 - 0.8 ** 6) ** 40 = 5e-6.
NEAR_BANDS, NEAR_ROWS = 40, 6
#: Candidates agree in so much of the sketch at least: at 0.8 that is missed by 5.8 deviations.
NEAR_SKETCH = 0.65
#: Distinct sets of a fingerprint group that is compared as it stands; the pairs of a larger one meet on bands, as those of different groups do.
NEAR_GROUP = 8192
#: So many rows of candidates, and shingles of candidates, go to a task together.
NEAR_TASK_ROWS, NEAR_TASK_SHINGLES = 65536, 1 << 20
#: Texts of candidates are looked up by a broadcast up to so many, by a shuffle beyond.
NEAR_BROADCAST = 100_000
#: Node pairs with at most so many fingerprint pairs are compared directly.
_DIRECT = 64
_FRONTIER = 1 << 17


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-width] + 1)).tolist()
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, stops[width - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of 64 bits; zero without a word of text."""
    return simhash(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, f0`` (signed 64 bits), a row per input row."""
    def run(texts: list[str | None]) -> list[np.ndarray]:
        return [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, [("f0", pa.int64())])


def budgets(radius: int) -> list[int]:
    """Most differing bits among the first 0, 1, ..., 64 bits."""
    return [min(radius, level) for level in range(65)]


class Histogram:
    """Fingerprints by leading bits: of all for the first level, of the crowded prefixes for the deeper ones."""

    def __init__(self) -> None:
        self.levels: list[dict[int, np.ndarray]] = []

    def add(self, rows: list[tuple[int, int]]) -> None:
        """A further level, from ``(prefix, count)`` pairs of its width."""
        k = len(self.levels)
        width = EDGES[k + 1] - EDGES[k]
        made: dict[int, np.ndarray] = {}
        for prefix, n in rows:
            made.setdefault(prefix >> width, np.zeros((1 << width) + 1, np.int64))[(prefix & (1 << width) - 1) + 1] = n
        self.levels.append({base: np.cumsum(c) for base, c in made.items()})

    def size(self, depth: int, prefix: int) -> int:
        k = next(i for i in range(len(self.levels)) if depth <= EDGES[i + 1])
        below, up = EDGES[k + 1] - depth, depth - EDGES[k]
        total = self.levels[k].get(prefix >> up)
        if total is None:
            return 0
        own = prefix & (1 << up) - 1
        return int(total[(own + 1) << below] - total[own << below])

    def deeper(self, depth: int, prefix: int) -> bool:
        """Whether the counts of a node's children are known."""
        if depth not in EDGES[1:]:
            return depth < EDGES[len(self.levels)]
        k = EDGES.index(depth)
        return k < len(self.levels) and prefix in self.levels[k]

    def crowded(self, limit: int) -> list[int]:
        """Prefixes of the last level with over ``limit`` fingerprints."""
        k = len(self.levels) - 1
        width = EDGES[k + 1] - EDGES[k]
        return [base << width | int(i) for base, c in self.levels[k].items() for i in np.flatnonzero(np.diff(c) > limit)]


def top_pairs(counts: Histogram, budget: list[int], subtree: int, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """First prefix of each leaf, as a fingerprint, in order, and the leaf pairs within the budget so far.

    A node is split while it holds more than ``subtree`` fingerprints or is
    near the root, and below the first level while it holds more than
    ``crowd``. A fingerprint goes to a task for each leaf within the radius of
    its own, so its copies grow with the square of the depth: with the squared
    logarithm of the table.
    """
    leaves: dict[tuple[int, int], int] = {}

    def is_leaf(node: tuple[int, int]) -> bool:
        if not counts.deeper(*node):
            return True
        return node[0] >= MIN_DEPTH and counts.size(*node) <= (subtree if node[0] < EDGES[1] else crowd)

    found, stack = set(), [((0, 0), (0, 0), 0)]
    while stack:
        x, y, differ = stack.pop()
        if not counts.size(*x) or not counts.size(*y):
            continue
        end_x, end_y = is_leaf(x), is_leaf(y)
        if end_x and end_y:
            a, b = leaves.setdefault(x, len(leaves)), leaves.setdefault(y, len(leaves))
            found.add((min(a, b), max(a, b)))
        elif x == y:
            d, p = x[0] + 1, x[1] * 2
            stack += [((d, p), (d, p), differ), ((d, p + 1), (d, p + 1), differ)] + [((d, p), (d, p + 1), differ + 1)] * (differ < budget[d])
        else:
            # The shallower side steps down; sides at one depth step together.
            least = min(v[0] for v, end in ((x, end_x), (y, end_y)) if not end)
            down = [n if end or n[0] > least else None for n, end in ((x, end_x), (y, end_y))]
            for a in [down[0]] if down[0] else [(x[0] + 1, x[1] * 2 + i) for i in (0, 1)]:
                for b in [down[1]] if down[1] else [(y[0] + 1, y[1] * 2 + j) for j in (0, 1)]:
                    d = min(a[0], b[0])
                    apart = ((a[1] >> (a[0] - d)) ^ (b[1] >> (b[0] - d))).bit_count()
                    if apart <= budget[d]:
                        stack.append((a, b, apart))
    order = sorted(leaves, key=lambda n: n[1] << (64 - n[0]))
    place = np.empty(len(leaves), np.int32)
    place[[leaves[n] for n in order]] = np.arange(len(order))
    starts = np.array([n[1] << (64 - n[0]) for n in order], np.uint64)
    return starts, np.sort(place[np.array(sorted(found), np.int32).reshape(-1, 2)], axis=1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def links(a: np.ndarray, b: np.ndarray | None, budget: list[int], root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in a, j in b) of sorted uint64 arrays within the radius, in chunks.

    Without ``b``, pairs i < j within ``a``. ``root`` holds the groups found so
    far (of a, then b): pairs of subtrees that are one group are passed over.
    """
    own, radius = b is None, budget[64]
    b = a if own else b
    if not len(a) or not len(b):
        return

    def zeros(x: np.ndarray, level: int) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(((x >> np.uint64(63 - level)) & np.uint64(1)) == 0)))

    def changes(r: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(r[1:] != r[:-1])))

    cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    one = lambda *v: tuple(np.array([x], np.int64) for x in v)
    stack = [(0, *one(0, len(a), 0, len(b), 0))]
    while stack:
        level, a0, a1, b0, b1, e = stack.pop()
        if root is not None and level > 3:
            ra, rb = root[: len(a)], root if own else root[len(a) :]
            ca, cb = changes(ra), changes(rb)
            live = (ra[a0] != rb[b0]) | (ca[a1 - 1] != ca[a0]) | (cb[b1 - 1] != cb[b0])
            a0, a1, b0, b1, e = (x[live] for x in (a0, a1, b0, b1, e))
        small = (a1 - a0) * (b1 - b0) <= _DIRECT if level < 64 else np.ones(len(a0), bool)
        at, k = np.flatnonzero(small), 0
        weight = np.cumsum((a1 - a0)[at] * (b1 - b0)[at])
        while k < len(at):  # so many node pairs as give a chunk of fingerprint pairs, one at least
            stop = max(k + 1, int(np.searchsorted(weight, (weight[k - 1] if k else 0) + 8 * _FRONTIER)))
            s, k = at[k:stop], stop
            n, m = a1[s] - a0[s], b1[s] - b0[s]
            i = np.repeat(_ranges(a0[s], n), np.repeat(m, n))
            j = _ranges(np.repeat(b0[s], n), np.repeat(m, n))
            near = np.bitwise_count(a[i] ^ b[j]) <= radius
            if own:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        if level == 64 or small.all():
            continue
        a0, a1, b0, b1, e = (x[~small] for x in (a0, a1, b0, b1, e))
        if len(a0) > _FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[:half] for x in (a0, a1, b0, b1, e))), (level, *(x[half:] for x in (a0, a1, b0, b1, e)))]
            continue
        if level not in cache:
            za = zeros(a, level)
            cache[level] = (za, za if own else zeros(b, level))
        za, zb = cache[level]
        am, bm = a0 + za[a1] - za[a0], b0 + zb[b1] - zb[b0]
        same = (a0 == b0) & own
        parts = [(a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1), (am, a1, b0, bm, e + 1)]
        kept = [np.ones(len(a0), bool)] * 3 + [~same]
        a0, a1, b0, b1, e = (np.concatenate([p[q][k] for p, k in zip(parts, kept, strict=True)]) for q in range(5))
        live = (a1 > a0) & (b1 > b0) & (e <= budget[level + 1])
        stack.append((level + 1, *(x[live] for x in (a0, a1, b0, b1, e))))


def forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the sets of i[k] and j[k]; root[x] is the least index of x's set."""
    while True:
        low = np.minimum(root[i], root[j])
        if (root[i] == root[j]).all():
            return root
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            flat = root[root]
            if (flat == root).all():
                break
            root[:] = flat


def histogram(fps: DataFrame, crowd: int) -> Histogram:
    """Counts of the first 14 bits (at most 16,384 rows), then, for prefixes over ``crowd``, of eight bits more at a time."""
    out, rows = Histogram(), fps
    for k in range(len(EDGES) - 1):
        if k:
            full = out.crowded(crowd)
            if not full:
                break
            prefix = F.shiftrightunsigned("f0", 64 - EDGES[k])
            # At most n / crowd prefixes: a small table.
            rows = fps.join(F.broadcast(fps.sparkSession.createDataFrame([(x,) for x in full], "full long")), prefix == F.col("full"), "left_semi")
        key = F.shiftrightunsigned("f0", 64 - EDGES[k + 1]).alias("prefix")
        out.add([tuple(r) for r in rows.groupBy(key).count().collect()])
    return out


def near_links(fps: DataFrame, radius: int = RADIUS, subtree: int = SUBTREE, crowd: int = CROWD) -> DataFrame:
    """``a, b``: nodes of links that span every group of distinct fingerprints ``node, f0`` within the radius."""
    budget = budgets(radius)
    starts, pairs = top_pairs(histogram(fps, crowd), budget, subtree, crowd)
    # For each leaf, in order: the tasks it belongs to, and on which side.
    own = pairs[:, 0] == pairs[:, 1]
    number = np.arange(len(pairs), dtype=np.int32)
    leaf = np.concatenate((pairs[:, 0], pairs[~own, 1]))
    task, side = np.concatenate((number, number[~own])), np.repeat(np.array([0, 1], np.int8), (len(pairs), (~own).sum()))
    by = np.lexsort((task, leaf))
    task, side = task[by], side[by]
    first = np.searchsorted(leaf[by], np.arange(len(starts) + 1))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f0 = b["f0"].to_numpy().view(np.uint64)
            leaf = np.searchsorted(starts, f0, "right") - 1
            n = first[leaf + 1] - first[leaf]
            to, row = _ranges(first[leaf], n), np.repeat(np.arange(len(b)), n)
            yield pd.DataFrame({"task": task[to], "side": side[to].astype(np.int32), "node": b["node"].to_numpy()[row], "f0": b["f0"].to_numpy()[row]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "f0", "node"], key=lambda c: c.astype("int64").to_numpy().view(np.uint64) if c.name == "f0" else c)
        node, f = pdf["node"].to_numpy(), pdf["f0"].to_numpy().view(np.uint64)
        na = int((pdf["side"] == 0).sum())
        alone = na == len(pdf)  # one subtree with itself; a pair of subtrees has rows on either side
        root = np.arange(len(node))
        for step in range(1, 9):  # neighbours first, so that dense groups are soon one
            at = np.arange(max(0, len(node) - step))
            near = at[np.bitwise_count(f[at] ^ f[at + step]) <= radius]
            if len(near):
                forest(root, near, near + step)
        for i, j in links(f[:na], None if alone else f[na:], budget, root):
            forest(root, i, j if alone else j + na)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"a": node[moved], "b": node[root[moved]]})

    return fps.select("node", "f0").mapInPandas(deal, "task int, side int, node long, f0 long").groupBy("task").applyInPandas(walk, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, subtree: int = SUBTREE) -> DataFrame:
    """``doc_id, fingerprint, component_id, component_size``, a row per input row.

    Texts are lower-cased in A-Z and split at ASCII blanks; a text with fewer
    words than a shingle is one shingle, and a null, empty or blank text has
    fingerprint zero and links like any other. Rows link when their
    fingerprints differ in at most ``radius`` bits, so equal texts and repeated
    rows always do. ``component_id`` is the smallest id that is reachable
    (null ids count only if a group has no other). Other columns are not read.
    """
    out = groups_of(docs, id_col, text_col, radius=radius, subtree=subtree)
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def shingle_set(text: str | None, width: int = NEAR_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, width))


_RANDOM = np.random.default_rng(SEED)
_TURNS = _RANDOM.integers(0, 1 << 31, NEAR_BANDS * NEAR_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _RANDOM.integers(0, 1 << 63, (NEAR_BANDS, NEAR_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of the orders, which odd factors give."""
    out, high = np.full(len(_TURNS), 0xFFFFFFFF, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 1024):
        np.minimum(out, (_TURNS[:, None] * high[None, i : i + 1024]).min(axis=1), out=out)
    return out


def sketches(texts: list[str | None]) -> list[list]:
    """Columns ``f0`` (the fingerprint), ``n1, n2`` (128 bits of the shingle set), ``shingles``, ``sketch`` (a byte a minimum) and ``bands``; no band without a shingle."""
    prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
    sets = [shingle_set(t) for t in texts]
    low = np.array([minhashes(x) for x in sets], np.uint32).reshape(-1, NEAR_BANDS, NEAR_ROWS)
    bands = ((low.astype(np.uint64) * _MIX).sum(axis=2, dtype=np.uint64) ^ (_MIX[:, 0] * _MIX[:, 1])).view(np.int64)
    named = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
    flat = (low & np.uint32(255)).astype(np.uint8).reshape(len(sets), -1)
    return [prints, named[:, 0].copy(), named[:, 1].copy(), [len(x) for x in sets], [r.tobytes() for r in flat], [b if len(x) else [] for b, x in zip(bands, sets, strict=True)]]


def sketch_links(sketch: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``i, js``: links that span what the rows of ``sketch`` are connected to by an agreement of NEAR_SKETCH."""
    left = np.arange(len(sketch))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = (sketch[left] == sketch[i]).sum(axis=1) >= NEAR_SKETCH * sketch.shape[1]
            if near.any():
                yield i, left[near]
                queue += left[near].tolist()
                left = left[~near]


def similar_components(sets: list[np.ndarray], similarity: float = NEAR_SIMILARITY) -> np.ndarray:
    """The first member of each set's component, where sets of this Jaccard similarity or more are linked. Exact.

    Two such sets share one of their rarest m - ceil(similarity m) + 1 members.
    """
    size = np.array([len(x) for x in sets], np.int64)
    owner, starts = np.repeat(np.arange(len(sets)), size), np.cumsum(size) - size
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    token = token[np.lexsort((token, owner))]
    prefix = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    first = np.arange(len(token)) - starts[owner] < prefix[owner]
    order = np.argsort(token[first], kind="stable")
    holders, at = owner[first][order], np.searchsorted(token[first][order], np.arange(len(count) + 1))
    root, seen, left = np.full(len(sets), -1), np.zeros(len(count), bool), len(sets)
    for s in range(len(sets)):
        if root[s] >= 0:
            continue
        root[s], left, queue = s, left - 1, [s]
        while queue and left:
            i = queue.pop()
            c = np.concatenate([holders[at[x] : at[x + 1]] for x in token[starts[i] : starts[i] + prefix[i]]])
            c = np.unique(c[root[c] < 0])
            c = c[np.minimum(size[c], size[i]) >= similarity * np.maximum(size[c], size[i]) - 1e-9]
            if not len(c):
                continue
            own = token[starts[i] : starts[i] + size[i]]
            seen[own] = True
            shared = np.add.reduceat(seen[token[_ranges(starts[c], size[c])]].astype(np.int64), np.cumsum(size[c]) - size[c])
            seen[own] = False
            new = c[shared >= similarity * (size[c] + size[i] - shared) - 1e-9]
            root[new], left = s, left - len(new)
            queue += new.tolist()
    return root


def fingerprint_groups(held: DataFrame, scratch: Scratch) -> DataFrame:
    """``bucket, n, head, node``: groups of the trie join over the fingerprints of ``node, f0``, from 2 up to NEAR_GROUP nodes; ``head`` is the least."""
    prints = scratch.save(held.select("f0").distinct().withColumn("node", F.col("f0")))
    roots = connected_components(near_links(prints)).toDF("linked", "root")
    members = held.join(roots, held["f0"] == roots["linked"], "left").select(F.coalesce("root", "f0").alias("bucket"), "node")
    members = scratch.save(members.distinct())  # texts of one set may differ in their fingerprints
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head"))
    groups = scratch.save(members.join(sizes.where(F.col("n").between(2, NEAR_GROUP)), "bucket").select("bucket", "n", "head", "node"))
    scratch.drop(prints, members)
    return groups


def candidate_links(distinct: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: links among ``node, sketch, bands`` whose components hold every pair at NEAR_SIMILARITY, and others.

    Pairs meet in ``groups``, those of the fingerprints, or in a bucket of a
    band. A bucket whose nodes are all of one group adds nothing and goes.
    """
    own = groups.groupBy("node").agg(F.min("bucket").alias("group"))
    places = scratch.save(distinct.select("node", "bands").join(own, "node", "left").select("node", "group", F.explode("bands").alias("band")))
    # A bucket is told by its size, its least node and two sums of hashes: no list of its nodes is ever one row.
    mark = [F.count(F.lit(1)).alias("n"), F.min("node").alias("head"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    within = (F.count("group") == F.count(F.lit(1))) & (F.min("group") == F.max("group"))
    buckets = places.groupBy("band").agg(*mark, F.coalesce(within, F.lit(False)).alias("within")).where("n > 1 AND NOT within")
    # Copies meet on most bands: of buckets with the same nodes one stays.
    buckets = scratch.save(buckets.groupBy("n", "head", "x", "y").agg(F.min("band").alias("band")).select("band", "n", "head"))
    met = scratch.save(places.join(buckets, "band").select(F.col("band").alias("bucket"), "n", "head", "node").unionByName(groups))
    scratch.drop(places, buckets)
    # What fills a task by itself is one candidate as a whole: its least node links with each.
    stars = met.where(F.col("n") > NEAR_TASK_ROWS).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    met = met.where(F.col("n") <= NEAR_TASK_ROWS).select("bucket", "node")
    tasks = met.count() // NEAR_TASK_ROWS + 1

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "node"], kind="stable")
        node, bucket = pdf["node"].to_numpy(), pdf["bucket"].to_numpy()
        rows = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
        edges, a, b = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))), [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            for i, js in sketch_links(rows[lo:hi]):
                a.append(np.full(len(js), node[lo + i]))
                b.append(node[lo + js])
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    rows = met.join(distinct.select("node", "sketch"), "node").withColumn("task", F.pmod("bucket", F.lit(tasks)))
    return rows.groupBy("task").applyInPandas(walk, "a long, b long").unionByName(stars)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id, component_size``, a row per input row.

    Words and ids as in ``simhash_groups``. Rows link when the sets of their
    five-word shingles have a Jaccard similarity of 0.8 or more, so repeats
    within a text do not count; texts without a word link with each other.
    Candidates are the groups of ``simhash_groups`` first; what they leave apart
    meets on bands of MinHash. What candidates form is split again into what
    exact similarities connect, so nothing below 0.8 ever links.
    """
    return near_rows(docs, id_col, text_col).select("doc_id", "component_id", "component_size")


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_groups`` with ``text_key``, the SHA-256 of the row's text, and ``least_key``, the smallest of the group."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_key"), "text")
    added = [("f0", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("shingles", pa.int32()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))]
    marked = scratch.save(map_texts(rows, sketches, added))
    one = [F.min("text_key").alias("text_key"), *(F.first(c).alias(c) for c in ("shingles", "sketch", "bands"))]  # a node has one set
    distinct = scratch.save(marked.groupBy("n1", "n2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), *one))
    distinct = scratch.save(distinct.withColumn("node", F.monotonically_increasing_id()))
    held = scratch.save(marked.select("n1", "n2", "f0").distinct().join(distinct.select("n1", "n2", "node"), ["n1", "n2"]).select("node", "f0"))
    links = candidate_links(distinct, fingerprint_groups(held, scratch), scratch)
    families = connected_components(links).toDF("node", "family")
    families = scratch.save(families.join(distinct.select("node", "text_key", "shingles"), "node"))
    # A family too large for a task is dealt into blocks, and every two of its blocks are compared in a task.
    sizes = families.groupBy("family").agg(F.sum("shingles").alias("all")).select("family", F.when(F.col("all") > NEAR_TASK_SHINGLES, F.floor(2 * F.col("all") / NEAR_TASK_SHINGLES) + 1).otherwise(1).cast("int").alias("blocks"))
    families = scratch.save(families.join(sizes, "family"))
    copied = F.sum(F.col("shingles") * F.greatest(F.col("blocks") - 1, F.lit(1)))
    n, total, most = families.agg(F.count(F.lit(1)), F.coalesce(copied, F.lit(0)), F.max("blocks")).first()
    tasks = total // NEAR_TASK_SHINGLES + 1

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["family", "i", "j"], kind="stable")
        node, sets = pdf["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        unit = pdf[["family", "i", "j"]].to_numpy()
        edges, root = np.flatnonzero(np.concatenate(([True], (unit[1:] != unit[:-1]).any(axis=1), [True]))), np.empty(len(node), np.int64)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            root[lo:hi] = node[lo + similar_components(sets[lo:hi])]
        return pd.DataFrame({"linked": node, "root": root, "blocks": pdf["blocks"].to_numpy()})

    keys = families.select("text_key", "node", "family", "blocks")
    texts = rows.select("text_key", "text").join(F.broadcast(keys) if n <= NEAR_BROADCAST else keys, "text_key").select("node", "family", "blocks", "text")
    sets = map_texts(texts, lambda t: [[shingle_set(x).tobytes() for x in t]], [("set", pa.binary())]).dropDuplicates(["node"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block")))
    sets = sets.withColumn("block", block).withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("block", "other")
    task = F.pmod(F.xxhash64("family", "i", "j"), F.lit(tasks))
    roots = scratch.save(sets.withColumn("task", task).groupBy("task").applyInPandas(split, "linked long, root long, blocks int"))
    whole = roots.where("blocks = 1").select("linked", "root")
    if most and most > 1:
        met = connected_components(roots.where("blocks > 1 AND linked <> root").select(F.col("linked").alias("a"), F.col("root").alias("b")))
        whole = whole.unionByName(met.withColumnRenamed("node", "linked"))
    roots = whole
    joined = scratch.save(distinct.join(roots, distinct["node"] == roots["linked"], "left").select("n1", "n2", "least", "n", "text_key", F.coalesce("root", "node").alias("root")))
    groups = scratch.save(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"), F.min("text_key").alias("least_key")))
    groups = scratch.save(joined.join(groups, "root").select("n1", "n2", "component_id", "component_size", "least_key"))
    return marked.select("doc_id", "text_key", "n1", "n2").join(groups, ["n1", "n2"]).drop("n1", "n2")


def groups_of(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS, subtree: int = SUBTREE, crowd: int = CROWD) -> DataFrame:
    """``doc_id, f0, component_id, component_size``; a fingerprint is its own node."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.save(fingerprints(docs, id_col, text_col))
    distinct = scratch.save(marked.groupBy("f0").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", F.col("f0")))
    roots = connected_components(near_links(distinct, radius, subtree, crowd)).withColumnRenamed("node", "linked")
    joined = scratch.save(distinct.join(roots, distinct["node"] == roots["linked"], "left").select("node", "least", "n", F.coalesce("root", "node").alias("root")))
    # Both sides of each join are written, so that it can split the rows of a large group.
    groups = scratch.save(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size")))
    groups = scratch.save(joined.join(groups, "root").select("node", "component_id", "component_size"))
    return marked.join(groups, marked["f0"] == groups["node"]).drop("node")
