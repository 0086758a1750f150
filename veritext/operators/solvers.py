"""Many linear models fitted at once, with one pass over the rows a round.

MLlib fits one model at a time, and every step of its solver is a Spark job:
the dozens of fits of a grid search are some ten thousand jobs of a few
milliseconds' work each.  Here every fit is a generator that asks for the loss
and gradient at a point; a round evaluates what all live fits ask for in one
job, so there are as many jobs as the longest fit has steps.

The solvers are those that MLlib runs (Breeze 2.1): ``lbfgs`` with a strong
Wolfe search for logistic regression, ``owlqn`` without an L1 term for the
linear SVM, on features scaled by their deviation with virtual centering, the
L2 term on the unscaled weights, with MLlib's starting points and tests of
convergence.  They take the same steps up to rounding.

Rows are held in blocks of about ``BLOCK_ENTRIES`` stored values, each by rows
and by columns, persisted in the executors' memory or on their disks (``Spread``).
A task holds one block and (features x columns) weights and sums.  Where all rows
have ``WHOLE_ENTRIES`` stored values at most, a job a round would cost far more
than its work: each task then gets all rows and the fits of one training part,
and runs the same rounds by itself (``Local``).
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle
from collections.abc import Callable, Generator, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, Broadcast, SparkContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ENTRIES = 1_000_000  # stored values of a block
WHOLE_ENTRIES = 8_000_000  # stored values (12 bytes each) that are sent to every task
PIECE_ENTRIES = 4096  # stored values that are multiplied at once
MEMORY = 10  # steps that a solver remembers
Solver = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


class SearchFailed(Exception):
    """A line search ended without a step."""


def direction(grad: np.ndarray, steps: list[np.ndarray], deltas: list[np.ndarray]) -> np.ndarray:
    """Minus the approximate inverse Hessian times ``grad`` (newest step first)."""
    out, a, rho, scale = grad.copy(), [], [], 1.0
    if steps:
        sy, yy = steps[0] @ deltas[0], deltas[0] @ deltas[0]
        if not sy >= 0:
            raise SearchFailed
        scale = np.float64(sy) / yy
    for s, y in zip(steps, deltas, strict=True):
        rho.append(s @ y)
        a.append(np.float64(s @ out) / rho[-1])
        if math.isnan(a[-1]):
            raise SearchFailed
        out -= a[-1] * y
    out *= scale
    for s, y, r, x in reversed(list(zip(steps, deltas, rho, a, strict=True))):
        out += (x - np.float64(y @ out) / r) * s
    return -out


def interpolated(low: tuple, high: tuple) -> float:
    """Cubic minimum between two (t, value, slope), kept off the ends."""
    (lt, lf, ld), (rt, rf, rd) = low, high
    d1 = ld + rd - 3 * np.float64(lf - rf) / (lt - rt)
    d2 = np.sqrt(d1 * d1 - ld * rd)
    t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    least, most = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return float(least if t < least else most if t > most else t)


def strong_wolfe(x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, first: float):
    """(x, value, gradient) after a step along ``way``."""
    slope = float(grad @ way)
    if slope > 0:
        raise SearchFailed

    def at(t):
        point = x + way * t
        f, g = yield point
        return (t, f, float(g @ way)), (point, f, g)

    low, t = (0.0, value, slope), first
    for i in range(10):
        c, found = yield from at(t)
        if math.isinf(c[1]) or math.isnan(c[1]):
            t /= 2.0
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            high = c
        elif abs(c[2]) <= 0.9 * abs(slope):
            return t, *found
        elif c[2] >= 0:
            low, high = c, low
        else:
            low, t = c, t * 1.5
            continue
        for _ in range(10):
            t = interpolated(high, low) if low[0] > high[0] else interpolated(low, high)
            c, found = yield from at(t)
            if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return t, *found
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        break
    raise SearchFailed


def backtracking(x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, first: float, shrink: float):
    """(x, value, gradient) after a step along ``way`` that leaves no orthant.
    As in Breeze the first step is compared by the value at its start, so it
    is shrunk wherever the slope is negative, and need not be evaluated then."""
    slope = float(way @ grad)
    orthant = np.where(x != 0, np.sign(x), np.sign(-grad))

    def at(t):
        point = x + way * t
        point = point * (np.sign(point) == orthant)
        f, g = yield point
        return (t, f, float(g @ way)), (point, f, g)

    t, found, c = first, None, (first, value, 0.0)
    if not value > value + first * slope * 1e-4:
        c, found = yield from at(t)
        c = (t, value, c[2])
    for tried in range(20):
        if c[1] > value + t * slope * 1e-4:
            factor = shrink
        elif c[2] < 0.9 * slope:
            factor = 2.1
        elif c[2] > -0.9 * slope:
            factor = shrink
        else:
            break
        if not 1e-10 <= t * factor <= 1e10:
            raise SearchFailed
        if tried == 19:  # Breeze ends its search before a twentieth step
            break
        t *= factor
        c, found = yield from at(t)
    return t, *found


def minimised(x: np.ndarray, max_iter: int, tol: float, orthants: bool) -> Solver:
    """Yields points, is sent (value, gradient) of each; returns the last point."""
    value, grad = yield x
    first, seen, steps, deltas = value, [math.inf], [], []
    iteration, failed = 0, False
    while True:
        if 0 <= max_iter <= iteration or (len(seen) >= 2 and abs(value - max(seen)) <= tol * first) \
                or np.linalg.norm(grad) <= max(tol * value, 1e-8):
            return x
        try:
            way = direction(grad, steps, deltas)
            if orthants:
                way = np.where(way * grad < 0, way, 0.0)
                start, shrink = (0.5 / np.linalg.norm(grad), 0.1) if iteration < 1 else (1.0, 0.5)
                _, new, f, g = yield from backtracking(x, value, grad, way, start, shrink)
            else:
                t, new, f, g = yield from strong_wolfe(x, value, grad, way, 1.0 / np.linalg.norm(way) if iteration == 0 else 1.0)
                if t * np.linalg.norm(grad) < 1e-10:
                    raise SearchFailed
        except SearchFailed:
            if failed:
                return x
            failed, steps, deltas = True, [], []
            continue
        failed, iteration = False, iteration + 1
        steps, deltas = [new - x, *steps][:MEMORY], [g - grad, *deltas][:MEMORY]
        x, value, grad = new, f, g
        seen = [*seen, value][-20:]


def together(solvers: list[Solver], evaluate: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]]) -> list[np.ndarray]:
    """Results of all solvers: each round evaluates the points of those that live."""
    ends: dict[int, np.ndarray] = {}

    def moved(i: int, *answer) -> None:
        try:
            points[i] = solvers[i].send(*answer) if answer else next(solvers[i])
        except StopIteration as end:
            points.pop(i, None)
            ends[i] = end.value

    points: dict[int, np.ndarray] = {}
    with np.errstate(all="ignore"):  # what is not a number ends a search
        for i in range(len(solvers)):
            moved(i)
        while points:
            for i, answer in evaluate(dict(points)).items():
                moved(i, answer)
    return [ends[i] for i in range(len(solvers))]


Pieces = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def pieces(bounds: np.ndarray, idx: np.ndarray, val: np.ndarray) -> Pieces:
    """Sparse lines as small dense ones of nearly equal length: (line numbers,
    indices, values), filled up with zeros."""
    sizes = np.diff(bounds)
    order = np.argsort(sizes, kind="stable")[::-1]
    order = order[sizes[order] > 0]
    out, lo = [], 0
    while lo < len(order):
        length = int(sizes[order[lo]])
        ids = order[lo:lo + max(1, PIECE_ENTRIES // length)]
        there = np.arange(length)[None, :] < sizes[ids][:, None]
        at = np.where(there, bounds[ids][:, None] + np.arange(length)[None, :], 0)
        out.append((ids.astype(np.int32), np.where(there, idx[at], 0).astype(np.int32), np.where(there, val[at], 0.0)))
        lo += len(ids)
    return out


def times(lines: Pieces, x: np.ndarray, size: int) -> np.ndarray:
    """Product of ``size`` sparse lines and a dense matrix."""
    out = np.zeros((size, x.shape[1]))
    for ids, idx, val in lines:
        out[ids] = np.matmul(val[:, None, :], x.take(idx, axis=0))[:, 0]
    return out


@dataclass
class Rows:
    """Rows as they are: class numbers, weights, folds and sparse values."""

    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    inner: np.ndarray
    sizes: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    width: int

    def taken(self, mask: np.ndarray) -> Rows:
        there = np.repeat(mask, self.sizes)
        return Rows(self.label[mask], self.weight[mask], self.fold[mask], self.inner[mask], self.sizes[mask],
                    self.idx[there], self.val[there], self.width)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        names = ("label", "weight", "fold", "inner", "sizes", "idx", "val")
        return Rows(*(np.concatenate([getattr(p, n) for p in parts]) for n in names), parts[0].width)


class Block:
    """Rows with their products: by rows and by columns."""

    def __init__(self, r: Rows):
        self.label, self.weight, self.fold, self.inner = r.label, r.weight, r.fold, r.inner
        self.rows = pieces(np.concatenate(([0], np.cumsum(r.sizes))), r.idx, r.val)
        row, order = np.repeat(np.arange(len(r.sizes), dtype=np.int32), r.sizes), np.argsort(r.idx, kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(r.idx, minlength=r.width))))
        self.columns = pieces(ends, row[order], r.val[order])

    def used(self, use: list[tuple[int, int]]) -> np.ndarray:
        """(row, use): 1.0 where the row lies outside the use's fold and inner fold (-1: none)."""
        return np.stack([(self.fold != f) & (self.inner != g) for f, g in use], axis=1).astype(np.float64)


def stored_rows(train: DataFrame, width: int) -> RDD:
    """``Rows`` of ``train`` (features, label, weight, fold, inner)."""
    rows = train.select("label", "weight", "fold", "inner", F.unwrap_udt("features").alias("v")).select(
        F.col("label").cast("int"), F.col("weight").cast("double"), F.col("fold").cast("int"), F.col("inner").cast("int"),
        F.coalesce("v.indices", F.transform("v.values", lambda _, i: i)).alias("idx"), F.col("v.values").alias("val"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch["idx"]).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_ENTRIES, "right")))
                part = batch.slice(lo, hi - lo)
                found = Rows(*(part[c].to_numpy(zero_copy_only=False) for c in ("label", "weight", "fold", "inner")),
                             pc.list_value_length(part["idx"]).to_numpy(zero_copy_only=False).astype(np.int64),
                             part["idx"].flatten().to_numpy(), part["val"].flatten().to_numpy(), width)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["rows"])
                lo = hi

    return rows.mapInArrow(cut, "rows binary").rdd.map(lambda r: pickle.loads(r[0]))


def added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def total(found: Iterable[list[np.ndarray]]) -> list[np.ndarray]:
    return functools.reduce(added, found)


class Local:
    """Blocks in this process."""

    def __init__(self, held: list):
        self.held = held

    def map(self, of: Callable) -> Local:
        return Local([of(b) for b in self.held])

    def summed(self, sums: Callable[..., list[np.ndarray]], given=None) -> list[np.ndarray]:
        """Sums over all blocks of the arrays ``sums(block, given)``."""
        return total(sums(b, given) for b in self.held)

    def freed(self) -> None:
        self.held = []


class Spread:
    """Persisted blocks of an RDD."""

    def __init__(self, held: RDD):
        self.held = held.persist(StorageLevel.MEMORY_AND_DISK)

    def map(self, of: Callable) -> Spread:
        return Spread(self.held.map(of))

    def summed(self, sums: Callable[..., list[np.ndarray]], given=None) -> list[np.ndarray]:
        sent = self.held.context.broadcast(given)

        def part(held: Iterator) -> Iterator[list[np.ndarray]]:
            found = [total(sums(b, sent.value) for b in itertools.chain([first], held)) for first in itertools.islice(held, 1)]
            yield from found

        try:
            found = self.held.mapPartitions(part)
            return found.treeReduce(added) if self.held.getNumPartitions() > 16 else total(found.collect())
        finally:
            sent.unpersist()

    def freed(self) -> None:
        self.held.unpersist()


@dataclass
class Moments:
    """Of the rows that a fit uses, per feature: the mean by the deviation, and
    one over the deviation (0 where all rows are equal)."""

    weight: float
    inverse: np.ndarray
    mean: np.ndarray

    @staticmethod
    def of(weight: float, weight2: float, sums: np.ndarray, squares: np.ndarray) -> Moments:
        spread = squares - sums * sums / weight
        spread = np.where(spread > 1e-12 * squares, spread, 0.0)  # what rounding leaves of equal values
        free = weight - weight2 / weight
        deviation = np.sqrt(spread / free) if free > 0 else np.zeros_like(spread)
        inverse = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation != 0)
        return Moments(weight, inverse, inverse * sums / weight)


@dataclass
class Linear:
    """One fit: its points are (column, feature) weights of scaled and centered
    features with an intercept each."""

    moments: Moments
    reg: float
    start: np.ndarray  # intercepts
    use: tuple[int, int]  # fold and inner fold that are left out (-1: none)
    target: int = -1  # class against the others, -1: all classes

    def solver(self, max_iter: int, tol: float) -> Solver:
        width = len(self.moments.mean)
        point = np.concatenate((np.zeros((len(self.start), width)), self.start[:, None]), axis=1)
        return minimised(point.ravel(), max_iter, tol, self.target >= 0)

    def raw(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, column) weights and intercepts for the rows as they are."""
        w = point.reshape(len(self.start), -1)
        return (w[:, :-1] * self.moments.inverse).T, w[:, -1] - w[:, :-1] @ self.moments.mean

    def answer(self, point: np.ndarray, loss: float, slopes: np.ndarray, ends: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient from the sums over the rows."""
        m, w = self.moments, point.reshape(len(self.start), -1)
        grad = np.empty_like(w)
        penalty = w[:, :-1] * m.inverse ** 2
        grad[:, :-1] = (slopes.T * m.inverse - ends[:, None] * m.mean) / m.weight + self.reg * penalty
        grad[:, -1] = ends / m.weight
        return float(loss / m.weight + 0.5 * self.reg * (w[:, :-1] * penalty).sum()), grad.ravel()


def losses(b: Block, given: tuple) -> list[np.ndarray]:
    """Loss of each fit, slopes (feature, column) and their sums (column) in a
    block; the softmax fits' columns stand before those of the hinge fits."""
    weights, ends, soft, hinge, targets, k = given
    z = times(b.rows, weights, len(b.label)) + ends
    slopes, loss = np.empty_like(z), np.empty(len(soft) + len(hinge))
    cut = len(soft) * k
    if soft:
        w = b.used(soft) * b.weight[:, None]
        m = z[:, :cut].reshape(len(z), len(soft), k)
        m = m - m.max(axis=2, keepdims=True)
        e = np.exp(m)
        total = e.sum(axis=2)
        own = np.arange(k) == b.label[:, None]
        loss[:len(soft)] = (w * (np.log(total) - (m * own[:, None, :]).sum(axis=2))).sum(axis=0)
        slopes[:, :cut] = ((e / total[:, :, None] - own[:, None, :]) * w[:, :, None]).reshape(len(z), cut)
    if hinge:
        w = b.used(hinge) * b.weight[:, None]
        sign = np.where(b.label[:, None] == np.array(targets), 1.0, -1.0)
        miss = (1.0 - sign * z[:, cut:]) * w
        loss[len(soft):] = np.maximum(miss, 0).sum(axis=0)
        slopes[:, cut:] = np.where(miss > 0, -sign * w, 0.0)
    return [loss, times(b.columns, slopes, len(weights)), slopes.sum(axis=0)]


def stacked(fits: list[Linear], points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    raw = [f.raw(p) for f, p in zip(fits, points, strict=True)]
    return np.ascontiguousarray(np.concatenate([w for w, _ in raw], axis=1)), np.concatenate([e for _, e in raw])


def fit_linear(data: Local | Spread, fits: list[Linear], k: int, max_iter: list[int], tol: float) -> list[np.ndarray]:
    """The last points of all fits, softmax fits first."""

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        live = [fits[i] for i in points]
        weights, ends = stacked(live, list(points.values()))
        loss, slopes, sums = data.summed(losses, (
            weights, ends, [f.use for f in live if f.target < 0], [f.use for f in live if f.target >= 0],
            [f.target for f in live if f.target >= 0], k))
        out, lo = {}, 0
        for j, (i, point) in enumerate(points.items()):
            hi = lo + len(fits[i].start)
            out[i] = fits[i].answer(point, loss[j], slopes[:, lo:hi], sums[lo:hi])
            lo = hi
        return out

    return together([f.solver(n, tol) for f, n in zip(fits, max_iter, strict=True)], evaluate)


@dataclass
class Margins:
    """Margins (row, fit) of a block, and of each fit the rows it is calibrated on."""

    margin: np.ndarray
    held: np.ndarray
    hit: np.ndarray  # 1.0 in the fit's class


def held_out(fold: np.ndarray, inner: np.ndarray, use: tuple[int, int]) -> np.ndarray:
    """The rows that calibrate a fit: of its left-out inner fold, or of the
    left-out fold where there is no inner one."""
    f, g = use
    return (fold != f) & (inner == g) if g >= 0 else fold == f


def margins(data: Local | Spread, fits: list[Linear], points: list[np.ndarray]) -> Local | Spread:
    """Margins of all fits."""
    weights, ends = stacked(fits, points)
    targets, uses = np.array([f.target for f in fits]), [f.use for f in fits]

    def of(b: Block) -> Margins:
        held = [held_out(b.fold, b.inner, use) for use in uses]
        return Margins(times(b.rows, weights, len(b.label)) + ends, np.stack(held, axis=1).astype(float),
                       (b.label[:, None] == targets).astype(float))

    return data.map(of)


def calibrated(held: Local | Spread, max_iter: int, tol: float) -> list[tuple[float, float]]:
    """Slope and intercept of an unpenalised logistic regression of each fit's
    class on its margin."""

    def sums(m: Margins, _) -> list[np.ndarray]:
        return [np.stack([(m.held * x).sum(axis=0) for x in (1.0, m.hit, m.margin, m.margin ** 2)])]

    fits = []
    for n, hits, first, square in held.summed(sums)[0].T:
        fits.append(Linear(Moments.of(n, n, np.array([first]), np.array([square])), 0.0, np.array([np.log(hits / (n - hits))]), (-1, -1)))

    def logistic(m: Margins, given: tuple) -> list[np.ndarray]:
        live, slope, end = given
        x, hit, w = m.margin[:, live], m.hit[:, live], m.held[:, live]
        z = x * slope + end
        r = (1.0 / (1.0 + np.exp(-z)) - hit) * w
        loss = np.logaddexp(0, np.where(hit > 0, -z, z)) * w
        return [loss.sum(axis=0), (r * x).sum(axis=0), r.sum(axis=0)]

    def evaluate(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        live = list(points)
        weights, ends = stacked([fits[i] for i in live], list(points.values()))
        loss, slopes, sums_ = held.summed(logistic, (live, weights[0], ends))
        return {i: fits[i].answer(points[i], loss[j], slopes[None, j:j + 1], sums_[j:j + 1]) for j, i in enumerate(live)}

    found = together([f.solver(max_iter, tol) for f in fits], evaluate)
    return [(float(w[0, 0]), float(e[0])) for w, e in (f.raw(p) for f, p in zip(fits, found, strict=True))]


Fitted = list[tuple[np.ndarray, tuple[float, float] | None]]  # last point, and the calibrator of a hinge fit


def fitted(data: Local | Spread, held: Callable[[], Local | Spread], fits: list[Linear], k: int, limits: tuple[int, int, int]) -> Fitted:
    """All fits, softmax fits first, with ``limits`` steps (softmax, hinge,
    calibrators); ``held`` gives the rows that calibrate the hinge fits."""
    points = fit_linear(data, fits, k, [limits[0] if f.target < 0 else limits[1] for f in fits], 1e-4)
    svm = [i for i, f in enumerate(fits) if f.target >= 0]
    out: Fitted = [(p, None) for p in points]
    if svm:
        found = margins(held(), [fits[i] for i in svm], [points[i] for i in svm])
        for i, line in zip(svm, calibrated(found, limits[2], 1e-6), strict=True):
            out[i] = (points[i], line)
        found.freed()
    return out


def fitted_in_tasks(rows: Broadcast, fits: list[Linear], k: int, limits: tuple[int, int, int], sc: SparkContext) -> Fitted:
    """``fitted`` with a task for the fits of each training part."""
    groups: dict = {}
    for i, f in enumerate(fits):
        groups.setdefault((f.target < 0, f.use), []).append(i)

    def run(group: tuple[tuple[int, int], list[int], list[Linear]]) -> tuple[list[int], Fitted]:
        (f, g), ids, own = group
        r = rows.value
        data = Local([Block(r.taken((r.fold != f) & (r.inner != g)))])
        return ids, fitted(data, lambda: Local([Block(r.taken(held_out(r.fold, r.inner, (f, g))))]), own, k, limits)

    tasks = [(use, ids, [fits[i] for i in ids]) for (_, use), ids in groups.items()]
    out: dict = {}
    for ids, found in sc.parallelize(tasks, len(tasks)).map(run).collect():
        out.update(zip(ids, found, strict=True))
    return [out[i] for i in range(len(fits))]
