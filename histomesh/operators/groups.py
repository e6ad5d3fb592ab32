"""Whole groups of rows in one task, many small ones at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from histomesh.session import spread


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a group of sorted rows begins, and the number of rows; null equals null."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        code = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
        at = code.indices.to_numpy(zero_copy_only=False)
        new[1:] |= at[1:] != at[:-1]
    return np.r_[np.flatnonzero(new), table.num_rows]


def by_whole_groups(
    df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str
) -> DataFrame:
    """``run(table, starts)`` on tables of whole groups of ``keys``, rows in the order of ``order``.

    A group must fit into a task; a table holds as many as an Arrow batch does, one at least.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done():
            table = pa.concat_tables(held).combine_chunks()
            out = run(table, group_starts(table, keys))
            return out.to_batches() if out is not None and out.num_rows else []

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            last = int(group_starts(table, keys)[-2])
            if last:
                held.append(table.slice(0, last))
                yield from done()
                held = []
            held.append(table.slice(last))
        if held:
            yield from done()

    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(tasks, schema)


# ---- nearest points inside a group

WHOLE = 8192  # points of a group that one task may hold
DIRECT = 512  # points that are met one by one
ENTRIES = 1 << 18  # distances in a block


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def codes(table: pa.Table, name: str) -> np.ndarray:
    """A number per different value, -1 for null."""
    code = table.column(name).combine_chunks().dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    return code.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def nearest_squared(tx: np.ndarray, ty: np.ndarray, qx: np.ndarray, qy: np.ndarray, tid: np.ndarray | None = None, qid: np.ndarray | None = None) -> np.ndarray:
    """Squared distance of each query to the nearest target, of another id if ids are given; infinite where there is none.

    Many targets are met by 3 x 3 grid cells; queries whose hit lies beyond those go on to larger cells.
    """
    out, n = np.full(len(qx), np.inf), len(tx)
    if n and n <= DIRECT:
        step = max(1, ENTRIES // (8 * n))
        for a in range(0, len(qx), step):
            d, e = qx[a : a + step, None] - tx, qy[a : a + step, None] - ty
            d *= d
            e *= e
            d += e
            if tid is not None:
                d[qid[a : a + step, None] == tid] = np.inf
            out[a : a + step] = d.min(1)
        return out
    open_, per_cell = np.arange(len(qx) if n else 0), 2
    while len(open_):
        x0, y0 = tx.min(), ty.min()
        w, h = max(tx.max() - x0, 1e-9), max(ty.max() - y0, 1e-9)
        side = max(np.sqrt(w * h * per_cell / n), max(w, h) / 2048, 1e-9)
        nx, ny = int(w / side) + 1, int(h / side) + 1
        cell = ((ty - y0) / side).astype(np.int64) * nx + ((tx - x0) / side).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        start = np.searchsorted(cell[order], np.arange(nx * ny + 1))
        x, y = qx[open_], qy[open_]
        fx, fy = np.clip((x - x0) / side, -3, nx + 3), np.clip((y - y0) / side, -3, ny + 3)
        cx, cy = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
        line, lo, hi = cy[:, None] + np.array([-1, 0, 1]), np.maximum(cx - 1, 0), np.minimum(cx + 1, nx - 1)
        inside = (line >= 0) & (line < ny) & (lo <= hi)[:, None]
        first = start[np.where(inside, line * nx + lo[:, None], 0)]
        size = np.where(inside, start[np.where(inside, line * nx + hi[:, None] + 1, 0)] - first, 0)
        rim = np.full(len(open_), np.inf)
        for f, c, cells in ((fx, cx, nx), (fy, cy, ny)):
            rim = np.minimum(rim, np.minimum(np.where(c <= 1, np.inf, f - (c - 1)), np.where(c + 2 >= cells, np.inf, c + 2 - f)))
        per = size.sum(1)
        total, near, a = np.r_[0, np.cumsum(per)], np.full(len(open_), np.inf), 0
        while a < len(open_):
            b = max(a + 1, int(np.searchsorted(total, total[a] + ENTRIES, "right")) - 1)
            some = a + np.flatnonzero(per[a:b])
            if len(some):
                at, each = first[some].ravel(), size[some].ravel()
                t = order[np.repeat(at - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                dx, dy = tx[t] - np.repeat(x[some], per[some]), ty[t] - np.repeat(y[some], per[some])
                d = dx * dx + dy * dy
                if tid is not None:
                    d[tid[t] == np.repeat(qid[open_[some]], per[some])] = np.inf
                near[some] = np.minimum.reduceat(d, np.r_[0, np.cumsum(per[some])[:-1]])
            a = b
        rim = rim * side * (1 - 1e-9)
        done = np.ones(len(open_), bool) if nx * ny == 1 else near < rim * rim
        out[open_[done]] = near[done]
        open_ = open_[~done]
        per_cell *= 16
    return out


def squares(x: np.ndarray, y: np.ndarray, ids: np.ndarray, a: int, b: int) -> np.ndarray:
    """Squared distances of points a..b to all points, infinite to those of the same id."""
    d, e = x[a:b, None] - x, y[a:b, None] - y
    d *= d
    e *= e
    d += e
    d[ids[a:b, None] == ids] = np.inf
    return d
