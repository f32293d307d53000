"""Whitening of embeddings by a one-sided Jacobi SVD.

Every task reads its vectors block by block, centres them and compresses them,
with the triangle it has so far, to a new triangle (TSQR). The triangles of all
tasks are stacked and compressed again, a bounded number at a time, until one
R is left, with RᵀR the scatter of all centred rows. Plane rotations then make
the columns of R orthogonal; their lengths are the standard deviations, the
accumulated rotations the components. The covariance itself is never formed, so
small deviations keep their digits.

What leaves a task is one triangle or one sum of the dimension's size; the
driver holds one R.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm._common import Scratch

#: Rows of a block that is compressed at a time.
BLOCK_ROWS = 4096
#: Triangles that one task stacks.
FAN_IN = 32
#: Components that a report holds.
COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
_MOST = 60  # sweeps; a dozen suffice for any matrix met


def clean_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: rows whose vector is not null and holds finite entries only, scaled to whole numbers.

    ``x = floor(1024 c) + 100000`` for each entry c. Vectors must be as long as
    most of them are (the longest of equally frequent lengths); others are
    dropped, as are empty ones. Entries beyond the range of whole numbers stop the job.
    """
    v = F.col(vec_col)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = rows.where(v.isNotNull() & F.forall(v, finite) & (F.size(v) > 0))
    lengths = good.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    # The optimizer may compute this ahead of the filters above.
    x = F.transform(v, lambda c: F.when(finite(c), F.floor(c.cast("double") * SCALE) + SHIFT))
    return good.where(F.size(v) == F.lit(most)).select(F.col(id_col).alias("vec_id"), x.cast("array<long>").alias("x"))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    column = b.column(b.num_columns - 1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def column_sums(clean: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each dimension; one row a dimension comes to the driver."""
    rows = clean.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    if not rows:
        return 0, np.zeros(0, np.int64)
    return rows[0]["n"], np.array([r["s"] for r in sorted(rows, key=lambda r: r["i"])], np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - S / n``: the whole parts are taken off first, so that no digit is lost."""
    whole, rest = np.divmod(sums, n)
    return (x - whole).astype(np.float64) - rest / n


def _compressed(blocks: list[np.ndarray]) -> np.ndarray:
    """The square triangle R of the stacked blocks, filled up with zeros."""
    stacked = np.vstack(blocks)
    r = np.linalg.qr(stacked, mode="r")
    return np.vstack([r, np.zeros((stacked.shape[1] - len(r), stacked.shape[1]))])


def triangle(clean: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows by TSQR: blocks in each task, then triangles by groups of ``FAN_IN``."""
    d = len(sums)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for b in batches:
            rows = _matrix(b)
            for at in range(0, len(rows), BLOCK_ROWS):
                block = _centred(rows[at : at + BLOCK_ROWS], n, sums)
                r = _compressed([block] if r is None else [r, block])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["node", "r"])

    def of_group(group: pa.Table) -> pa.Table:
        at = group.column("node")[0].as_py() // FAN_IN
        r = _compressed([np.asarray(x.values).reshape(d, d) for x in group.column("r")])
        return pa.table({"node": pa.array([at], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    scratch = Scratch(clean.sparkSession)
    level = scratch.save(clean.select("x").mapInArrow(of_task, "node long, r array<double>"))
    while level.agg(F.max("node")).first()[0] > 0:
        before, level = level, scratch.save(level.groupBy(F.floor(F.col("node") / F.lit(FAN_IN)).alias("parent")).applyInArrow(of_group, "node long, r array<double>"))
        scratch.drop(before)
    r = np.array(level.select("r").first()["r"]).reshape(d, d)
    scratch.drop(level)
    return r


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of a square matrix.

    Columns are rotated in pairs until each two are orthogonal to rounding. A
    round of the tournament rotates disjoint pairs at once.
    """
    a, d = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(d)
    seats = list(range(d + d % 2))
    for _ in range(_MOST):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[: half - 1 : -1], strict=True) if max(p, q) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = np.abs(gamma) > 1e-15 * size
            if not turn.any():
                continue
            worst = max(worst, float(np.max(np.abs(gamma[turn]) / size[turn])))
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if worst < 1e-14:
            break
    sizes = np.sqrt((a * a).sum(0))
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order]


class Whitener(NamedTuple):
    """``components`` are columns; ``deviations`` their standard deviations (divisor n)."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Whitened scores; a component along which all vectors are equal scores 0."""
        flat = self.deviations <= self.deviations[0] * len(self.sums) * np.finfo(float).eps
        scale = np.where(flat, 0.0, 1 / np.where(flat, 1.0, self.deviations))
        return _centred(x, self.n, self.sums) @ (self.components * scale)


def fit(clean: DataFrame, k: int | None = None) -> Whitener | None:
    """The leading ``k`` components (all by default) of ``clean_vectors``; none for an empty table.

    Of a component and its opposite, the one whose largest entry is positive is taken.
    """
    n, sums = column_sums(clean)
    if not n:
        return None
    sizes, v = jacobi(triangle(clean, n, sums))
    k = min(k or len(sums), len(sums))
    top = v[np.abs(v).argmax(0), np.arange(v.shape[1])]
    v = v * np.where(top < 0, -1.0, 1.0)
    total = float((sizes * sizes).sum())
    return Whitener(n, sums, v[:, :k], sizes[:k] / np.sqrt(n), sizes[:k] ** 2 / total if total else np.zeros(k))


def whiten(clean: DataFrame, model: Whitener) -> DataFrame:
    """``vec_id, deviation, whitened``: the scores of each vector, and its exact squared distance from the mean times n²."""
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = _matrix(part)
                far = n * x - sums
                if int(np.abs(far).max(initial=0)) ** 2 * len(sums) < 1 << 63:
                    deviation = pa.array((far * far).sum(1), pa.int64())
                else:  # whole numbers of any size; one beyond 64 bits raises
                    deviation = pa.array([sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums, strict=True)) for row in x], pa.int64())
                scores = model.scores(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, lists], ["vec_id", "deviation", "whitened"])

    kind = clean.schema["vec_id"].dataType.simpleString()
    return clean.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(clean: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the scores, measured over all vectors, minus the identity."""
    k = len(model.deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        mean = np.zeros(k)
        for b in batches:
            rows = _matrix(b)
            for at in range(0, len(rows), BLOCK_ROWS):
                z = model.scores(rows[at : at + BLOCK_ROWS])
                total, mean = total + z.T @ z, mean + z.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([total.ravel(), mean]))], ["i", "v"])

    sums = clean.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.array([r["v"] for r in sorted(sums, key=lambda r: r["i"])]) / model.n
    mean = flat[k * k :]
    return float(np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitening_report(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, a row per remaining vector and component up to ``k``.

    Rows whose vector is null or holds a null or non-finite entry are dropped
    (and those ``clean_vectors`` names); a null id stays, repeated rows count
    and are returned each, other columns are not read. Where all vectors are
    equal along a component its scores are 0, and the identity error is 1.
    With equal eigenvalues their components are any orthogonal ones of the
    shared space. An empty table, or one without a remaining vector, gives no rows.
    """
    clean = clean_vectors(rows, id_col, vec_col)
    model = fit(clean, k)
    kind = clean.schema["vec_id"].dataType.simpleString()
    if model is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(clean, model)
    share: Column = F.array(*[F.lit(float(e)) for e in model.explained])
    each = whiten(clean, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
