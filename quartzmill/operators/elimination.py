"""Recursive elimination by squared logistic coefficients, from sums over blocks of rows.

The objective is the weighted log loss + |b|^2 / 2, the intercept free.  All that touches rows are two sums: losses and
gradients of several coefficient vectors at once, and the matrix of second derivatives of one.  They come from one array
on the driver, or from blocks that Spark keeps; the solver is the same.

A round removes the features of least squared coefficient, and the next fit starts from the minimum of the
quadratic model without them, by a downdate of the inverse.  Some rounds are predicted ahead in this way, and one pass
over the rows gives the gradients of all their fits; each is corrected by quasi-Newton steps with its own inverse.  A fit need
only be as exact as its decision: steps go on until what is left of the error cannot change
which features have the least squares, or until they vanish, as in a tie.  A prediction counts only if the fit before it
removes just those features; otherwise the rounds go on from there.  The matrix is made anew when steps shrink too slowly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Relative size of steps that have vanished, rounds ahead, passes before the matrix is made anew, bytes of a block, sums that reach the driver at once.
SETTLED, AHEAD, PASSES, BLOCK_BYTES, SUMS = 1e-9, 16, 6, 8 << 20, 64
#: What a first step may leave, as a multiple of it.
FIRST_ERROR = 10.0
#: Squared coefficients this close, relatively, count as equal; the first feature goes.
TIE = 1e-6


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each column of ``v`` (coefficients, intercept): the gradient, then the loss."""
    z = x @ v[:-1] + v[-1]
    rest = w[:, None] * (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y[:, None])
    loss = w @ (np.logaddexp(0.0, z) - y[:, None] * z)
    return np.vstack([x.T @ rest, rest.sum(axis=0), loss])


def _matrix(x: np.ndarray, y: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Second derivatives at ``v`` (one column)."""
    p = 1.0 / (1.0 + np.exp(-np.clip(x @ v[:-1, 0] + v[-1, 0], -500, 500)))
    d = w * p * (1.0 - p)
    out = np.empty((x.shape[1] + 1,) * 2)
    out[:-1, :-1] = (x * d[:, None]).T @ x
    out[-1, :-1] = out[:-1, -1] = d @ x
    out[-1, -1] = d.sum()
    return out


class LocalRows:
    """A bounded matrix on the driver."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.rows, self.passes = (x, y, w), 0

    def sums(self, v: np.ndarray) -> np.ndarray:
        self.passes += 1
        return _sums(*self.rows, v)

    def matrix(self, v: np.ndarray) -> np.ndarray:
        return _matrix(*self.rows, v[:, None])

    def close(self) -> None:
        pass


class SparkRows:
    """Rows in blocks of about ``BLOCK_BYTES``, as one binary column; each pass adds up a task's blocks."""

    def __init__(self, data: DataFrame, features: int):
        """``data(x array, y, weight)``."""
        self.features, self.passes = features, 0
        most = max(1, BLOCK_BYTES // (8 * max(1, features)))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
                y, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                for at in range(0, len(y), most):
                    part = np.c_[x[at : at + most], y[at : at + most], w[at : at + most]]
                    yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], ["block"])

        self.blocks = data.mapInArrow(blocks, "block binary").persist()

    def _added(self, work, shape: tuple[int, int], v: np.ndarray) -> np.ndarray:
        sent, width = self.blocks.sparkSession.sparkContext.broadcast(v), self.features + 2

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, part = np.zeros(shape), -1
            for batch in batches:
                for block in batch.column(0):
                    rows = np.frombuffer(block.as_buffer()).reshape(-1, width)
                    total += work(rows[:, :-2], rows[:, -2], rows[:, -1], sent.value)
                    part = 0
            if part == 0:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((np.frombuffer(s.as_buffer()) for batch in batches for s in batch.column(0)), np.zeros(shape[0] * shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

        sums = self.blocks.mapInArrow(own, "sum binary")
        if self.blocks.rdd.getNumPartitions() > SUMS:
            sums = sums.repartition(SUMS).mapInArrow(merged, "sum binary")
        found = sorted(bytes(r[0]) for r in sums.collect())  # at most SUMS arrays; sorted, so that rounding does not depend on their order of arrival
        sent.destroy()
        return sum((np.frombuffer(b).reshape(shape) for b in found), np.zeros(shape))

    def sums(self, v: np.ndarray) -> np.ndarray:
        self.passes += 1
        return self._added(_sums, (self.features + 2, v.shape[1]), v)

    def matrix(self, v: np.ndarray) -> np.ndarray:
        return self._added(_matrix, (self.features + 1,) * 2, v[:, None])

    def close(self) -> None:
        self.blocks.unpersist()


@dataclass
class Point:
    """A fit on the features ``left``: coefficients and intercept, the inverse, and the features that the round before removed."""

    left: np.ndarray
    v: np.ndarray
    inverse: np.ndarray
    gone: list[int]
    step: float = np.inf
    error: float = np.inf
    slope: np.ndarray | None = None
    move: np.ndarray | None = None

    def wide(self, features: int) -> np.ndarray:
        out = np.zeros(features + 1)
        out[np.append(self.left, features)] = self.v
        return out

    @property
    def settled(self) -> bool:
        return self.step <= SETTLED * (1.0 + np.abs(self.v).max())

    def sure(self, count: int) -> bool:
        """Whether the error left cannot change which ``count`` features are the least."""
        if self.settled or count >= len(self.left):
            return True
        sizes = np.partition(np.abs(self.v[:-1]), [count - 1, count])
        return bool(sizes[count - 1] + self.error < sizes[count] - self.error)

    def correct(self, slope: np.ndarray) -> None:
        """One step; the inverse learns from the last one (BFGS)."""
        if self.move is not None:
            change = slope - self.slope
            curve = float(change @ self.move)
            if curve > 0:
                side = self.inverse @ change
                self.inverse += np.outer(self.move, self.move) * ((curve + change @ side) / curve**2) - (np.outer(side, self.move) + np.outer(self.move, side)) / curve
        move = -self.inverse @ slope
        step = float(np.abs(move).max())
        ratio = step / self.step
        # nothing is known of the first step's error but its size; later ones shrink about as they did
        self.error = FIRST_ERROR * step if not np.isfinite(self.step) else 2 * step * ratio / (1 - ratio) if ratio < 0.7 else np.inf
        self.v, self.step, self.slope, self.move = self.v + move, step, slope, move


def worst(left: np.ndarray, v: np.ndarray, count: int) -> list[int]:
    """Places of the ``count`` features to remove."""
    squares, out = v[:-1] ** 2, []
    for _ in range(count):
        least = squares.min()
        out.append(int(np.flatnonzero(squares <= least * (1 + TIE) + 1e-18)[0]))
        squares[out[-1]] = np.inf
    return sorted(out)


class Elimination:
    def __init__(self, rows, features: int):
        self.rows, self.n = rows, features

    def _penalised(self, point: Point, sums: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient on the point's own coefficients, and the objective."""
        own = np.append(point.left, self.n)
        inner = np.append(point.v[:-1], 0.0)
        return sums[own] + inner, float(sums[-1] + inner @ inner / 2)

    def _inverse(self, point: Point) -> np.ndarray:
        own = np.append(point.left, self.n)
        matrix = self.rows.matrix(point.wide(self.n))[np.ix_(own, own)]
        matrix[np.diag_indices_from(matrix)] += np.append(np.ones(len(point.left)), 1e-12)
        return np.linalg.inv(matrix)

    def fit(self, point: Point, rounds: int = 100) -> Point:
        """Damped Newton steps with a matrix of their own each, halved steps tried in the same pass."""
        for _ in range(rounds):
            slope, here = self._penalised(point, self.rows.sums(point.wide(self.n)[:, None])[:, 0])
            point.inverse = self._inverse(point)
            move = point.inverse @ slope
            rates = 0.5 ** np.arange(8)
            tried = [Point(point.left, point.v - r * move, point.inverse, point.gone) for r in rates]
            sums = self.rows.sums(np.stack([t.wide(self.n) for t in tried], axis=1))
            values = [self._penalised(t, sums[:, i])[1] for i, t in enumerate(tried)]
            best = int(np.argmin(values))
            point.step = float(np.abs(move).max())
            if point.settled or values[best] >= here:
                if point.settled:
                    point.v = tried[0].v
                break
            point.v = tried[best].v
        point.step = point.error = 0.0
        return point

    def without(self, point: Point, places: list[int]) -> Point:
        """The quadratic model's minimum without some features."""
        keep = np.setdiff1d(np.arange(len(point.v)), places)
        across = point.inverse[:, places] @ np.linalg.inv(point.inverse[np.ix_(places, places)])
        v = (point.v - across @ point.v[places])[keep]
        inverse = (point.inverse - across @ point.inverse[places])[np.ix_(keep, keep)]
        return Point(point.left[keep[:-1]], v, inverse, point.left[places].tolist())

    def ahead(self, point: Point, keep: int, step: int, depth: int) -> list[Point]:
        chain = []
        while len(point.left) > keep and len(chain) < depth:
            point = self.without(point, worst(point.left, point.v, min(step, len(point.left) - keep)))
            chain.append(point)
        return chain

    def settle(self, chain: list[Point], step: int) -> None:
        """Steps of all points by common passes, until they are sure; points that do not get there stay unsure."""
        for _ in range(PASSES):
            live = [p for p in chain if not p.sure(step)]
            if not live:
                return
            sums = self.rows.sums(np.stack([p.wide(self.n) for p in live], axis=1))
            for i, p in enumerate(live):
                p.correct(self._penalised(p, sums[:, i])[0])

    def run(self, keep: int, step: int = 1) -> list[list[int]]:
        """The features that each round removes, and at last those that stay."""
        now = self.fit(Point(np.arange(self.n), np.zeros(self.n + 1), np.zeros((0, 0)), []))
        rounds, depth = [], 4
        while len(now.left) > keep:
            chain = self.ahead(now, keep, step, depth)
            self.settle(chain, step)
            good, stale = 0, False
            for p in chain:
                if p.gone != now.left[worst(now.left, now.v, len(p.gone))].tolist():
                    break
                if not p.sure(step):
                    stale = True
                    break
                now, good = p, good + 1
                rounds.append(p.gone)
            if stale:
                next_point = chain[good]
                start = next_point.v if np.isfinite(next_point.v).all() else np.append(np.zeros(len(next_point.left)), now.v[-1])
                now = self.fit(Point(next_point.left, start, np.zeros((0, 0)), next_point.gone))
                rounds.append(now.gone)
            depth = min(AHEAD, 2 * depth) if good == len(chain) else max(2, good + 1)
        return [*rounds, now.left.tolist()]


def eliminate(rows, features: int, keep: int, step: int = 1) -> list[list[int]]:
    try:
        return Elimination(rows, features).run(min(keep, features), step)
    finally:
        rows.close()
