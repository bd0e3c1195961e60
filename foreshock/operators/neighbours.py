"""Nearest rows of one block for batches of windows: numpy between Spark's shuffles.

Spark cuts the training vectors into blocks of near ones and deals windows to them; a task holds one block and one batch of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAIRS = 2_000_000
#: Share by which the gap to a box is made smaller, so that rounding never hides a row.
SLACK = 1e-9

Boxes = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _power(gap: np.ndarray, p: int) -> np.ndarray:
    out = gap
    for _ in range(p - 1):
        out = out * gap
    return out


def box_gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray, p: int) -> np.ndarray:
    """Least distance (sum of powers) of each window to each box, made a little smaller: (windows, boxes)."""
    out = np.empty((len(q), len(low)))
    step = max(1, PAIRS // max(1, low.size))
    with np.errstate(over="ignore"):
        for a in range(0, len(q), step):
            part = q[a : a + step, None, :]
            out[a : a + step] = _power(np.maximum(np.maximum(low - part, part - high), 0), p).sum(axis=2)
    return out * (1 - SLACK)


def _reach(rough: np.ndarray, k: int) -> np.ndarray:
    """A bound per window that at least k rows keep: the k-th least of the minima of groups of rows."""
    n = rough.shape[1]
    if n <= k:
        return np.full(len(rough), np.inf)
    groups = max(64, 16 * k)
    if n > 2 * groups:
        width = n // groups
        rough = rough[:, : width * groups].reshape(len(rough), width, groups).min(axis=1)
    return np.partition(rough, k - 1, axis=1)[:, k - 1]


def nearest(q: np.ndarray, t: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of ``t`` next to each row of ``q``, ties by place in ``t``: numbers in ``q``, in ``t``, and distances, in order.

    For p = 2 a product of matrices finds the rows that may be among them, with an allowance for its rounding. Distances that count
    are sums over the features in order.
    """
    found = []
    step = max(1, PAIRS // max(1, len(t)))
    centre = t.mean(axis=0) if len(t) else np.zeros(q.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        u = t - centre
        squares = (u * u).sum(axis=1)
        farthest = np.sqrt(squares.max()) if len(t) else 0.0
        for a in range(0, len(q), step):
            part = q[a : a + step]
            v = part - centre
            scale = (np.sqrt((v * v).sum(axis=1)) + farthest) ** 2
            if p == 2 and len(t) > k and np.isfinite(scale).all():
                rough = np.hstack([-2 * v, np.ones((len(v), 1))]) @ np.hstack([u, squares[:, None]]).T
                allowance = 16 * (q.shape[1] + 4) * np.finfo(float).eps * scale
                i, j = np.nonzero(rough <= (_reach(rough, k) + allowance)[:, None])
                d = np.zeros(len(i))
                for c in range(q.shape[1]):
                    d += _power(np.abs(part[i, c] - t[j, c]), p)
            else:
                exact = np.zeros((len(part), len(t)))
                for c in range(q.shape[1]):
                    exact += _power(np.abs(part[:, c, None] - t[None, :, c]), p)
                i, j = np.nonzero(exact <= _reach(exact, k)[:, None])
                d = exact[i, j]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[keep] + a, j[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def router(boxes: Boxes, p: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds ``block``: the block whose box is next to the window, or 0 where the window has no place among the boxes, since
    a value is missing or not finite or their number is another."""

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = batch.column("model_id").to_numpy(zero_copy_only=False)
            vectors = batch.column("vec")
            size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            block = np.zeros(len(model), np.int64)
            for m in np.unique(model):
                if m not in boxes:
                    continue
                numbers, low, high = boxes[m]
                at = np.flatnonzero((model == m) & (size == low.shape[1]))
                q = values[begin[at][:, None] + np.arange(low.shape[1])].astype(float)
                sound = np.isfinite(q).all(axis=1)
                block[at[sound]] = numbers[box_gaps(q[sound], low, high, p).argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])

    return route


def searcher(k: int, p: int, boxes: Boxes | None, odd: set[int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads blocks of training rows (``label`` set, ordered by station and time), each followed by the windows dealt to it. Gives
    each window its k best of the block, ``near``. With ``boxes`` also the other blocks that may hold a better one, ``others``, and the
    vector again where there are any, where the model is in ``odd`` or the window has no block."""

    def answer(model: int, block: int, part: pa.RecordBatch, rows: pa.RecordBatch | None, t: np.ndarray) -> pa.RecordBatch:
        vectors = part.column("vec")
        n = len(vectors)
        q = _matrix(vectors) if block else np.zeros((n, 0))
        i, j, d = nearest(q, t, k, p) if rows is not None else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        take = pa.array(j, pa.int64())
        columns = [rows.column(c).take(take) for c in ("station", "win_end", "label")] if rows is not None else [
            pa.array([], part.schema.field(c).type) for c in ("station", "win_end", "label")
        ]
        ends = np.searchsorted(i, np.arange(n + 1)).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(d), *columns], ["d", "s", "w", "label"]))
        out = {c: part.column(c) for c in ("model_id", "station", "win_end")} | {"near": near}
        if boxes is not None:
            limits, numbers = np.zeros(n + 1, np.int32), np.zeros(0, np.int64)
            again = np.full(n, block == 0 or model in odd)
            if block:
                names, low, high = boxes[model]
                full = ends[1:] - ends[:-1] >= k
                reach = np.full(n, np.inf)
                reach[full] = d[ends[1:][full] - 1]
                w, b = np.nonzero((box_gaps(q, low, high, p) <= reach[:, None]) & (names != block))
                limits, numbers = np.searchsorted(w, np.arange(n + 1)).astype(np.int32), names[b]
                again |= limits[1:] > limits[:-1]
            out["others"] = pa.ListArray.from_arrays(pa.array(limits), pa.array(numbers, pa.int64()))
            out["vec"] = pc.if_else(pa.array(again), vectors, pa.scalar(None, vectors.type))
        return pa.RecordBatch.from_pydict(out)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows, t = None, [], None, np.zeros((0, 0))
        for batch in batches:
            model, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("model_id", "block"))
            kind = batch.column("asks").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(model) != 0) | (np.diff(block) != 0) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, len(model)]):
                if a == b:
                    continue
                if (model[a], block[a]) != key:
                    key, held, rows = (model[a], block[a]), [], None
                part = batch.slice(a, b - a)
                if not kind[a]:
                    held.append(part)
                    continue
                if rows is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    t, held = _matrix(rows.column("vec")), []
                yield answer(int(key[0]), int(key[1]), part, rows, t)

    return search
