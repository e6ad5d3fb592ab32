"""Counting neighbouring label pairs of point maps under permuted labels.

Samples are cut into tiles of a bounded expected number of points. Two steps, each one task per tile or
pair of tiles:

* toroidal labels: every point is shifted by an offset per permutation and wrapped in its sample's box;
  its label is that of the nearest original point. A source tile meets the target tiles its points
  can land on; what lies nearer to a target tile's rim than to a point of it is left to the exact
  nearest-neighbour join.
* pair counts: the neighbour pairs of a tile are found once, and for each permutation a K x K count of
  their labels leaves the task.

Shuffled labels need no data at all: a keyed bijection moves a point's position in the sample, and the
label is that of the run in which the new position falls when all labels are laid out in order.

Samples of one tile go through both steps in the task that has them, and leave it as sums over the
permutations. There a raster tells, per pixel, which points can be nearest to a place in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.operators.groups import by_whole_groups
from histomesh.operators.order import row_positions
from histomesh.operators.spatial import knn_join
from histomesh.session import durable, spread

TILE_POINTS = 8192
RING = 0.25  # of a tile's side
MISSING = 255
PERMUTATIONS_AT_ONCE = 256
COLUMNS_AT_ONCE = 64
ROUNDS = 6
CROWD = 256  # points about a pixel beyond which it has no list
ENTRIES = 1 << 20  # numbers in a block


def label_code(n_labels: int) -> Column:
    """The habitat as a number from 0; ``n_labels`` for any other value."""
    return F.when(F.col("habitat").between(0, n_labels - 1), F.col("habitat")).otherwise(F.lit(n_labels)).cast("int")


def frames(patches: DataFrame, keys: list[str], n_labels: int, tile_points: int) -> DataFrame:
    """Per sample: number of points, box, tiles a side, a salt, and where each label's run ends."""
    counts = [F.count_if(F.col("habitat") == k) for k in range(n_labels)]
    per = patches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("x_um").alias("_x0"), F.max("x_um").alias("_x1"), F.min("y_um").alias("_y0"), F.max("y_um").alias("_y1"),
        F.array(*counts).alias("_counts"),
    )
    sides = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / tile_points))).cast("int")
    return per.withColumn("_g", sides).withColumn("_salt", F.xxhash64(*keys))


def _cells(bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by cell number, and where each of ``size`` cells begins."""
    order = np.argsort(bits, kind="stable")
    return order, np.searchsorted(bits[order], np.arange(size + 1))


def nearest_rows(tx: np.ndarray, ty: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and squared distance of the target nearest to each query; of equal ones the first row.

    Queries meet the targets of 3 x 3 grid cells; those whose hit lies farther away than the block's
    rim go on to a grid of larger cells, the last of which is one cell.
    """
    row, best = np.full(len(qx), len(tx)), np.full(len(qx), np.inf)
    open_ = np.arange(len(qx))
    if not len(tx):
        return row, best
    x0, y0 = tx.min(), ty.min()
    w, h = max(tx.max() - x0, 1e-9), max(ty.max() - y0, 1e-9)
    per_cell = 2
    while len(open_):
        side = max(np.sqrt(w * h * per_cell / len(tx)), max(w, h) / 2048, 1e-9)
        nx, ny = int(w / side) + 1, int(h / side) + 1
        whole = nx * ny == 1
        order, start = _cells(((ty - y0) / side).astype(np.int64) * nx + ((tx - x0) / side).astype(np.int64), nx * ny)
        x, y = qx[open_], qy[open_]
        fx, fy = (x - x0) / side, (y - y0) / side
        cx, cy = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
        if whole:
            cx[:], cy[:] = 0, 0
        near, found = np.full(len(open_), np.inf), np.full(len(open_), len(tx))
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                inside = np.flatnonzero((cx + dx >= 0) & (cx + dx < nx) & (cy + dy >= 0) & (cy + dy < ny))
                cell = (cy[inside] + dy) * nx + cx[inside] + dx
                at, last = start[cell], start[cell + 1]
                while len(inside):
                    live = at < last
                    inside, at, last = inside[live], at[live], last[live]
                    t = order[at]
                    ax, ay = tx[t] - x[inside], ty[t] - y[inside]
                    d = ax * ax + ay * ay
                    better = (d < near[inside]) | ((d == near[inside]) & (t < found[inside]))
                    chosen = inside[better]
                    near[chosen], found[chosen] = d[better], t[better]
                    at = at + 1
        rim = (np.minimum(np.minimum(fx - cx, cx + 1 - fx), np.minimum(fy - cy, cy + 1 - fy)) + 1) * side * (1 - 1e-9)
        done = np.ones(len(open_), bool) if whole else near < rim * rim
        row[open_[done]], best[open_[done]] = found[done], near[done]
        open_ = open_[~done]
        per_cell *= 16
    return row, best


def _ordered(ids: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rank of every id; equal ids share one."""
    import pyarrow.compute as pc

    return pc.rank(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, tiebreaker="dense").to_numpy().astype(np.int64) - 1


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of ``sizes`` items each of one flat array, as binary."""
    item = values.dtype.itemsize
    offsets = np.r_[0, np.cumsum(sizes * item)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def toroidal_rows(patches: DataFrame, keys: list[str], offsets: list[tuple[float, float]], n_labels: int, tile_points: int = TILE_POINTS) -> DataFrame:
    """(keys, patch_id, perms, labels, perm, label): the labels of every patch under every offset.

    A row holds either a list of permutations (32-bit numbers; null: all, in order) with one byte of label
    each, or one permutation and its label. Labels from ``n_labels`` on are written as ``n_labels``.
    """
    shifts = np.array(offsets, float).reshape(-1, 2)
    frame = frames(patches, keys, n_labels, tile_points)
    placed = patches.select(*keys, "patch_id", "x_um", "y_um", "habitat").join(frame.drop("_counts", "_salt"), keys)
    unit = lambda c, lo, hi: (F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-9)) * F.col("_g")
    cell = lambda v: F.greatest(F.lit(0), F.least(F.col("_g") - 1, F.floor(v).cast("int")))
    ux, uy = unit("x_um", "_x0", "_x1"), unit("y_um", "_y0", "_y1")
    tiles = F.sequence(F.lit(0), F.col("_g") * F.col("_g") - 1)
    source = placed.withColumn("_t", cell(uy) * F.col("_g") + cell(ux)).withColumn("_s", F.explode(tiles)).drop("habitat")
    reach = lambda v: F.explode(F.sequence(cell(v - RING), cell(v + RING)))
    target = placed.withColumn("_sy", reach(uy)).withColumn("_sx", reach(ux)).withColumn("_s", F.col("_sy") * F.col("_g") + F.col("_sx"))
    own_keys = [f"_k{i}" for i in range(len(keys))]
    target = target.select(*[F.col(k).alias(o) for k, o in zip(keys, own_keys)], "_s", F.explode(tiles).alias("_t"), F.col("patch_id").alias("_near"), F.col("x_um").alias("_nx"), F.col("y_um").alias("_ny"), label_code(n_labels).alias("_label"))
    names = [*keys, "patch_id", "perms", "labels", "perm", "sx", "sy"]

    def label_tile(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [label_some(left.slice(a, tile_points), right) for a in range(0, max(left.num_rows, 1), tile_points)]
        return pa.concat_tables(parts)

    def label_some(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        x, y = _numbers(left, "x_um"), _numbers(left, "y_um")
        empty = pa.Table.from_arrays([*(left.column(k).slice(0, 0) for k in (*keys, "patch_id")), *(pa.array([], t) for t in kinds)], names)
        if not n:
            return empty
        one = {c: left.column(c)[0].as_py() for c in ("_x0", "_x1", "_y0", "_y1", "_g", "_s", "_b")}
        g, x0, y0 = one["_g"], one["_x0"], one["_y0"]
        w, h = max(one["_x1"] - x0, 1e-9), max(one["_y1"] - y0, 1e-9)
        sx, sy = one["_s"] % g, one["_s"] // g
        rank = np.argsort(_ordered(right.column("_near")), kind="stable")
        tx, ty, label = _numbers(right, "_nx")[rank], _numbers(right, "_ny")[rank], np.r_[_numbers(right, "_label")[rank], MISSING].astype(np.uint8)
        chosen = np.arange(len(shifts))[one["_b"] * PERMUTATIONS_AT_ONCE :][:PERMUTATIONS_AT_ONCE]
        if g > 1:  # offsets that can bring a point of this tile to the target tile
            for v, lo, size, own, column in ((x, x0, w, sx, 0), (y, y0, h, sy, 1)):
                first, last = (np.floor(((e - lo) / size + shifts[chosen, column]) * g).astype(np.int64) for e in (v.min(), v.max()))
                near = np.zeros(len(chosen), bool)
                for step in range(-1, int((last - first).max(initial=0)) + 2):
                    near |= (first + step) % g == own
                chosen = chosen[near]
        held, rest = [], []
        for a in range(0, len(chosen), COLUMNS_AT_ONCE):
            block = chosen[a : a + COLUMNS_AT_ONCE]
            qx = x0 + np.fmod(x[:, None] - x0 + shifts[None, block, 0] * w, w)
            qy = y0 + np.fmod(y[:, None] - y0 + shifts[None, block, 1] * h, h)
            mine = np.ones(qx.shape, bool)
            if g > 1:
                mine = (np.clip(np.floor((qx - x0) / w * g), 0, g - 1) == sx) & (np.clip(np.floor((qy - y0) / h * g), 0, g - 1) == sy)
            i, p = np.nonzero(mine)
            vx, vy = qx[i, p], qy[i, p]
            row, d2 = nearest_rows(tx, ty, vx, vy)
            rim = np.full(len(i), np.inf)
            for v, lo, size, own in ((vx, x0, w, sx), (vy, y0, h, sy)):
                slack = size * 1e-9
                if own > 0:
                    rim = np.minimum(rim, v - (lo + (own - RING) / g * size) - slack)
                if own < g - 1:
                    rim = np.minimum(rim, lo + (own + 1 + RING) / g * size - v - slack)
            sure = (row < len(tx)) & (np.sqrt(d2) < np.maximum(rim, 0))
            held.append((i[sure], block[p[sure]], label[row[sure]]))
            rest.append((i[~sure], block[p[~sure]], vx[~sure], vy[~sure]))
        if not held:
            return empty
        i, p, own = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((p, i))
        i, p, own = i[order], p[order], own[order]
        sizes = np.bincount(i, minlength=n)
        some = np.flatnonzero(sizes)
        if len(i) == n * len(shifts):
            perms = pa.nulls(len(some), pa.binary())
        else:
            perms = _packed(p.astype(np.int32), sizes[some])
        j, q, vx, vy = (np.concatenate(c) for c in zip(*rest))
        take = pa.array(np.r_[some, j])
        kept = [left.column(k).take(take).combine_chunks() for k in (*keys, "patch_id")]
        both = lambda a, b: pa.concat_arrays([a, b])
        return pa.Table.from_arrays(
            [*kept, both(perms, pa.nulls(len(j), pa.binary())), both(_packed(own, sizes[some]), pa.nulls(len(j), pa.binary())), both(pa.nulls(len(some), pa.int32()), pa.array(q, pa.int32())),
             both(pa.nulls(len(some), pa.float64()), pa.array(vx)), both(pa.nulls(len(some), pa.float64()), pa.array(vy))],
            names,
        )

    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64())
    schema = ", ".join(f"`{c}` {dict(patches.dtypes)[c]}" for c in (*keys, "patch_id")) + ", perms binary, labels binary, perm int, sx double, sy double"
    blocks = F.explode(F.sequence(F.lit(0), F.lit(max(len(shifts) - 1, 0) // PERMUTATIONS_AT_ONCE))).alias("_b")
    source, target = source.select("*", blocks), target.select("*", blocks)
    source, target = spread(source, [*keys, "_s", "_t", "_b"]), spread(target, [*own_keys, "_s", "_t", "_b"])
    found = durable(source.groupBy(*keys, "_s", "_t", "_b").cogroup(target.groupBy(*own_keys, "_s", "_t", "_b")).applyInArrow(label_tile, schema))
    sure = found.filter("labels is not null").select(*keys, "patch_id", "perms", "labels", F.lit(None).cast("int").alias("perm"), F.lit(None).cast("int").alias("label"))
    open_ = found.filter("labels is null").select(*keys, "patch_id", "perm", F.struct("patch_id", "perm").alias("_q"), "sx", "sy")
    if open_.isEmpty():
        return sure
    right = patches.select(*keys, F.col("patch_id").alias("_near"), F.col("x_um").alias("_nx"), F.col("y_um").alias("_ny"), label_code(n_labels).alias("label"))
    far = knn_join(open_, right, keys, 1, "_q", "_near", ("sx", "sy"), ("_nx", "_ny"))
    none = F.lit(None).cast("binary")
    return sure.unionAll(far.select(*keys, "patch_id", none.alias("perms"), none.alias("labels"), "perm", "label"))


def keyed_positions(position: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """Bijections of [0, n), one per row of ``keys`` (64-bit numbers, ROUNDS of them): (points x rows).

    Positions are cut into two halves of bits that scramble each other in turn; a result beyond
    n goes round again until it is inside.
    """
    bits = max(int(n - 1).bit_length(), 2)
    low = bits // 2
    low_mask, high_mask = np.uint64((1 << low) - 1), np.uint64((1 << (bits - low)) - 1)

    def scramble(v: np.ndarray, k: np.ndarray) -> np.ndarray:
        a, b = v & low_mask, v >> np.uint64(low)
        for r in range(ROUNDS):
            source, mask = (a, high_mask) if r % 2 else (b, low_mask)
            m = (source + k[:, r]) * np.uint64(0x9E3779B97F4A7C15)
            m ^= m >> np.uint64(29)
            m *= np.uint64(0xBF58476D1CE4E5B9)
            m = (m >> np.uint64(32)) & mask
            if r % 2:
                b = b ^ m
            else:
                a = a ^ m
        return (b << np.uint64(low)) | a

    value = np.repeat(position.astype(np.uint64), len(keys))
    column = np.tile(np.arange(len(keys)), len(position))
    value = scramble(value, keys[column])
    out = np.flatnonzero(value >= n)
    while len(out):
        value[out] = scramble(value[out], keys[column[out]])
        out = out[value[out] >= n]
    return value.astype(np.int64).reshape(len(position), len(keys))


def _permutation_keys(permutations: int, seed: int, salt: int) -> np.ndarray:
    return np.random.default_rng([seed, salt & (2**63 - 1)]).integers(0, 2**63, (permutations, ROUNDS), dtype=np.uint64)


def shuffled_codes(position: np.ndarray, n: int, counts: np.ndarray, permutations: int, seed: int, salt: int) -> np.ndarray:
    """Labels (points x permutations) as bytes; labels beyond the counted ones are ``len(counts)``."""
    keys, ends, out = _permutation_keys(permutations, seed, salt), np.cumsum(counts), np.empty((len(position), permutations), np.uint8)
    for r in range(0, len(position), TILE_POINTS):
        rows = slice(r, r + TILE_POINTS)
        for a in range(0, permutations, COLUMNS_AT_ONCE):
            out[rows, a : a + COLUMNS_AT_ONCE] = np.searchsorted(ends, keyed_positions(position[rows], n, keys[a : a + COLUMNS_AT_ONCE]), "right")
    return out


def _near_pairs(x: np.ndarray, y: np.ndarray, rank: np.ndarray, own: np.ndarray, radius: float, at_once: int = 1 << 20):
    """Chunks (i, j) of the pairs within ``radius``: i of ``own``, j with the larger rank."""
    side = radius * (1 + 1e-9)
    cx, cy = np.floor((x - x.min()) / side).astype(np.int64), np.floor((y - y.min()) / side).astype(np.int64)
    width = int(cx.max()) + 3
    cell = (cy + 1) * width + cx + 1
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    home = np.flatnonzero(own)
    for step in (-1, 0, 1):
        middle = (cy[home] + 1 + step) * width + cx[home] + 1
        first, last = np.searchsorted(cell, middle - 1, "left"), np.searchsorted(cell, middle + 1, "right")
        total = np.cumsum(last - first)
        a = 0
        while a < len(home):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
            size = (last - first)[a:b]
            i = np.repeat(home[a:b], size)
            j = order[np.repeat(first[a:b] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            dx, dy = x[i] - x[j], y[i] - y[j]
            near = (rank[i] < rank[j]) & (dx * dx + dy * dy <= radius * radius)
            yield i[near], j[near]
            a = b


def pair_counts(x, y, rank, own, labels: np.ndarray, n_labels: int, radius: float) -> np.ndarray:
    """Per column of ``labels`` (rows x columns), pairs by (smaller, larger) label: (columns, K, K), K = n_labels + 1."""
    k, columns = n_labels + 1, labels.shape[1]
    out = np.zeros((columns, k * k), np.int64)
    if not len(x):
        return out.reshape(columns, k, k)
    blocks = [np.ascontiguousarray(labels[:, a : a + COLUMNS_AT_ONCE]) for a in range(0, columns, COLUMNS_AT_ONCE)]
    for i, j in _near_pairs(x, y, rank, own, radius):
        for start in range(0, len(i), 1 << 14):
            p, q = i[start : start + (1 << 14)], j[start : start + (1 << 14)]
            for b, block in enumerate(blocks):
                one, two = block[p], block[q]
                code = np.minimum(one, two).astype(np.int64) * k + np.maximum(one, two) + np.arange(block.shape[1]) * (k * k)
                found = np.bincount(code.ravel(), minlength=block.shape[1] * k * k)
                out[b * COLUMNS_AT_ONCE : b * COLUMNS_AT_ONCE + block.shape[1]] += found.reshape(block.shape[1], k * k)
    return out.reshape(columns, k, k)


def permuted_pair_counts(
    patches: DataFrame, keys: list[str], n_labels: int, radius: float, offsets=None, permutations: int = 0, seed: int = 42, tile_points: int = TILE_POINTS
) -> DataFrame:
    """(keys, perm, a, b, n): neighbour pairs by their labels a <= b; perm 0 is the map itself.

    With ``offsets``, one toroidal permutation for each; else ``permutations`` shuffles. Label ``n_labels``
    stands for all others.
    """
    count = len(offsets) if offsets is not None else permutations
    frame = frames(patches, keys, n_labels, tile_points)
    points = patches.select(*keys, "patch_id", "x_um", "y_um", label_code(n_labels).alias("_own"))
    if offsets is not None:
        rows = points.join(toroidal_rows(patches, keys, offsets, n_labels, tile_points), [*keys, "patch_id"])
    else:
        rows = row_positions(points, keys, ["patch_id"], "_position")
    side = F.greatest(F.lit(2.0 * radius), F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")) / F.col("_g"))
    rows = rows.join(frame, keys).withColumn("_side", side)
    pad = radius * (1 + 1e-9)
    for axis, c, lo in (("_tx", "x_um", "_x0"), ("_ty", "y_um", "_y0")):
        tile = lambda v: F.floor((v - F.col(lo)) / F.col("_side")).cast("int")  # noqa: B023, E731
        rows = rows.withColumn(f"{axis}h", tile(F.col(c))).withColumn(axis, F.explode(F.sequence(tile(F.col(c) - pad), tile(F.col(c) + pad))))
    rows = rows.withColumn("_home", (F.col("_tx") == F.col("_txh")) & (F.col("_ty") == F.col("_tyh"))).drop("_txh", "_tyh", "_x0", "_x1", "_y0", "_y1", "_side", "_g")

    def count_tile(table: pa.Table) -> pa.Table:
        rank = _ordered(table.column("patch_id"))
        _, first, inverse = np.unique(rank, return_index=True, return_inverse=True)
        m = len(first)
        x, y, own = (_numbers(table, c)[first] for c in ("x_um", "y_um", "_home"))
        labels = np.full((m, count + 1), MISSING, np.uint8)
        labels[:, 0] = _numbers(table, "_own")[first]
        if offsets is None:
            n, salt = table.column("_n")[0].as_py(), table.column("_salt")[0].as_py()
            labels[:, 1:] = shuffled_codes(_numbers(table, "_position")[first], n, np.array(table.column("_counts")[0].as_py()), count, seed, salt)
        else:
            perms, bodies, single, value = (table.column(c).to_pylist() for c in ("perms", "labels", "perm", "label"))
            for r, at in enumerate(inverse.tolist()):
                if bodies[r] is None:
                    labels[at, 1 + single[r]] = value[r]
                elif perms[r] is None:
                    labels[at, 1:] = np.frombuffer(bodies[r], np.uint8)
                else:
                    labels[at, 1 + np.frombuffer(perms[r], np.int32)] = np.frombuffer(bodies[r], np.uint8)
            if (labels == MISSING).any():
                raise RuntimeError("a shifted point has no label")
        found = pair_counts(x, y, np.arange(m), own.astype(bool), labels, n_labels, radius)
        perm, a, b = np.nonzero(found)
        lead = [table.column(k).take(pa.array(np.zeros(len(perm), np.int64))).combine_chunks() for k in keys]
        return pa.Table.from_arrays([*lead, pa.array(perm, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(found[perm, a, b])], [*keys, "perm", "a", "b", "n"])

    schema = ", ".join(f"`{k}` {dict(patches.dtypes)[k]}" for k in keys) + ", perm int, a int, b int, n bigint"
    parts = spread(rows, [*keys, "_tx", "_ty"]).groupBy(*keys, "_tx", "_ty").applyInArrow(count_tile, schema)
    return parts.groupBy(*keys, "perm", "a", "b").agg(F.sum("n").alias("n"))


# ---- samples of one tile


def _scrambled(n: int, keys: np.ndarray) -> np.ndarray:
    """``keyed_positions`` of all of [0, n), (rows of ``keys`` x n): a round's result is looked up by its few possible sources."""
    bits = max(int(n - 1).bit_length(), 2)
    low, rows = bits // 2, len(keys)
    high = bits - low
    own = np.arange(1 << bits)
    a, b = np.tile(own & ((1 << low) - 1), (rows, 1)), np.tile(own >> low, (rows, 1))
    for r in range(ROUNDS):
        source, width, mask = (a, low, (1 << high) - 1) if r % 2 else (b, high, (1 << low) - 1)
        m = (np.arange(1 << width, dtype=np.uint64) + keys[:, r, None]) * np.uint64(0x9E3779B97F4A7C15)
        m ^= m >> np.uint64(29)
        m *= np.uint64(0xBF58476D1CE4E5B9)
        m = ((m >> np.uint64(32)) & np.uint64(mask)).astype(np.int64)
        step = m.ravel()[source + (np.arange(rows) << width)[:, None]]
        if r % 2:
            b ^= step
        else:
            a ^= step
    whole = (b << low) | a
    value = whole[:, :n].copy()
    row, at = np.nonzero(value >= n)
    while len(row):
        value[row, at] = whole[row, value[row, at]]
        out = value[row, at] >= n
        row, at = row[out], at[out]
    return value


def shuffled_whole(n: int, counts: np.ndarray, permutations: int, seed: int, salt: int) -> np.ndarray:
    """``shuffled_codes`` of all positions, (permutations x n)."""
    keys = _permutation_keys(permutations, seed, salt)
    label = np.full(n, len(counts), np.uint8)
    label[: counts.sum()] = np.repeat(np.arange(len(counts)), counts)
    step = max(1, ENTRIES // (64 * max(n, 1)))
    return np.concatenate([np.zeros((0, n), np.uint8), *(label[_scrambled(n, keys[a : a + step])] for a in range(0, permutations, step))])


class Raster:
    """Which of the targets can be nearest to a place, by pixels over a box that holds them all.

    A target nearest to some place in a pixel is no farther from its centre than the centre's nearest target
    and twice half the diagonal. Pixels with too many targets about them, or with none, have no list.
    """

    def __init__(self, tx: np.ndarray, ty: np.ndarray, box: tuple[float, float, float, float], g: int):
        self.x0, self.y0, self.w, self.h = x0, y0, w, h = box
        self.tx, self.ty, self.g = tx, ty, g
        slack = 1e-9 * (w + h) + 1e-14 * (abs(x0) + abs(y0))
        self.around = 2 * (np.hypot(w / g, h / g) / 2 + slack)
        pixels, per_cell, kept = np.arange(g * g), 2, []
        while len(pixels):  # those whose list needs more than the cells about them go on to larger cells
            key, pixels, whole = self._listed(pixels, max(np.sqrt(w * h * per_cell / len(tx)), max(w, h) / 2048, 1e-9))
            kept.append(key)
            per_cell *= 4
            if whole:
                break
        key = np.sort(np.concatenate(kept))
        self.target = key % len(tx)
        self.lx, self.ly = tx[self.target], ty[self.target]
        self.begin = np.searchsorted(key, np.arange(g * g + 1) * len(tx))

    def _listed(self, pixels: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """Pixel and target of the lists found in 3 x 3 cells of ``side``, as one number; the other pixels; whether there are no larger cells."""
        tx, ty, g, n = self.tx, self.ty, self.g, len(self.tx)
        nx, ny = int(self.w / side) + 1, int(self.h / side) + 1
        order, start = _cells(((ty - self.y0) / side).astype(np.int64) * nx + ((tx - self.x0) / side).astype(np.int64), nx * ny)

        def axis(at, lo, size, cells):  # centres, their cell, and how far the cells about it reach
            at = (at + 0.5) * (size / g)
            cell = (at / side).astype(np.int64)
            rim = np.minimum(np.where(cell <= 1, np.inf, at - (cell - 1) * side), np.where(cell + 2 >= cells, np.inf, (cell + 2) * side - at))
            return lo + at, cell, rim

        px, cx, rx = axis(pixels % g, self.x0, self.w, nx)
        py, cy, ry = axis(pixels // g, self.y0, self.h, ny)
        line = cy[:, None] + np.array([-1, 0, 1])
        inside = (line >= 0) & (line < ny)
        line = np.where(inside, line, 0) * nx
        first = start[line + np.maximum(cx - 1, 0)[:, None]]
        size = np.where(inside, start[line + np.minimum(cx + 1, nx - 1)[:, None] + 1] - first, 0)
        rim = np.minimum(ry, rx) * (1 - 1e-9)
        per = size.sum(1)
        crowded = per > CROWD
        size[crowded], per[crowded] = 0, 0
        total = np.r_[0, np.cumsum(per)]
        kept, listed, a = [np.zeros(0, np.int64)], crowded, 0
        while a < len(pixels):
            b = max(a + 1, int(np.searchsorted(total, total[a] + ENTRIES, "right")) - 1)
            some = a + np.flatnonzero(per[a:b])
            if len(some):
                at, each = first[some].ravel(), size[some].ravel()
                t = order[np.repeat(at - (np.cumsum(each) - each), each) + np.arange(each.sum())]
                dx, dy = tx[t] - np.repeat(px[some], per[some]), ty[t] - np.repeat(py[some], per[some])
                d = dx * dx + dy * dy
                reach = np.sqrt(np.minimum.reduceat(d, np.r_[0, np.cumsum(per[some])[:-1]])) + self.around
                sure = reach < rim[some]
                listed[some] = sure
                near = d <= np.repeat(np.where(sure, reach * reach, -1.0), per[some])
                kept.append(np.repeat(pixels[some] * n, per[some])[near] + t[near])
            a = b
        return np.concatenate(kept), pixels[~listed], nx * ny == 1

    def labels(self, label: np.ndarray) -> np.ndarray:
        """Per pixel the label of all targets of its list, MISSING if they differ or there are none."""
        out = np.full(self.g * self.g, MISSING, np.uint8)
        some = np.flatnonzero(self.begin[1:] > self.begin[:-1])
        if len(some):
            own = label[self.target]
            least, most = (f.reduceat(own, self.begin[some]) for f in (np.minimum, np.maximum))
            out[some] = np.where(least == most, least, MISSING)
        return out

    def nearest(self, pixel: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The target nearest to each place, of equal ones the first."""
        at, last = self.begin[pixel], self.begin[pixel + 1]
        row = np.full(len(x), -1)
        live = np.flatnonzero(at < last)
        at, last, px, py = at[live], last[live], x[live], y[live]
        near, place = np.full(len(live), np.inf), at.copy()
        while len(live):
            dx, dy = self.lx[at] - px, self.ly[at] - py
            d = dx * dx + dy * dy
            np.copyto(place, at, where=d < near)
            np.minimum(near, d, out=near)
            at += 1
            more = at < last
            if not more.all():
                ended = ~more
                row[live[ended]] = self.target[place[ended]]
                live, at, last, px, py, near, place = (v[more] for v in (live, at, last, px, py, near, place))
        rest = np.flatnonzero(row < 0)
        if len(rest):
            row[rest] = nearest_rows(self.tx, self.ty, x[rest], y[rest])[0]
        return row


def toroidal_whole(x: np.ndarray, y: np.ndarray, label: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Labels (shifts x points) of points in the order of their ids, below MISSING."""
    x0, y0 = x.min(), y.min()
    w, h = max(x.max() - x0, 1e-9), max(y.max() - y0, 1e-9)
    order = np.lexsort((y, x))  # of points at one place the first holds
    new = np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]
    kept = np.sort(order[new])
    g = int(np.ceil(np.sqrt(len(kept) * np.clip(len(shifts) / 24, 2, 16))))
    raster = Raster(x[kept], y[kept], (x0, y0, w, h), g)
    own = label[kept]
    flat = raster.labels(own)
    out = np.empty((len(shifts), len(x)), np.uint8)
    step = max(1, ENTRIES // (64 * len(x)))
    for a in range(0, len(shifts), step):
        part = []
        for v, size, column in ((x - x0, w, 0), (y - y0, h, 1)):
            at = v + shifts[a : a + step, column, None] * size
            if (at.max() >= 2 * size) or at.min() < 0:
                at = np.fmod(at, size)
            else:
                np.subtract(at, size, out=at, where=at >= size)
            part.append(at)
        sx, sy = part
        cell = lambda v, size: np.clip((v * (g / size)).astype(np.int64), 0, g - 1)
        pixel = (cell(sy, h) * g + cell(sx, w)).ravel()
        found = flat[pixel]
        open_ = np.flatnonzero(found == MISSING)
        if len(open_):
            found[open_] = own[raster.nearest(pixel[open_], x0 + sx.ravel()[open_], y0 + sy.ravel()[open_])]
        out[a : a + step] = found.reshape(-1, len(x))
    return out


def _whole_counts(x: np.ndarray, y: np.ndarray, labels: np.ndarray, n_labels: int, radius: float) -> np.ndarray:
    """``pair_counts`` of labels (columns x points) of points in the order of their ids."""
    k, columns = n_labels + 1, len(labels)
    out = np.zeros((columns, k * k), np.int64)
    kind = np.uint8 if k * k <= 256 else np.uint16
    for i, j in _near_pairs(x, y, np.arange(len(x)), np.ones(len(x), bool), radius):
        for start in range(0, len(i), 1 << 14):
            p, q = i[start : start + (1 << 14)], j[start : start + (1 << 14)]
            step = max(1, (1 << 16) // len(p))
            for a in range(0, columns, step):
                block = labels[a : a + step]
                code = block.take(p, 1).astype(kind, copy=False) * kind(k) + block.take(q, 1)
                code = code + (np.arange(len(block)) * (k * k))[:, None]
                out[a : a + step] += np.bincount(code.ravel(), minlength=len(block) * k * k).reshape(-1, k * k)
    out = out.reshape(columns, k, k)
    both = out + out.transpose(0, 2, 1)
    both[:, np.arange(k), np.arange(k)] //= 2
    return np.triu(both)


def permuted_pair_sums(
    patches: DataFrame, keys: list[str], n_labels: int, radius: float, offsets=None, permutations: int = 0, seed: int = 42, tile_points: int = TILE_POINTS
) -> DataFrame:
    """(keys, a, b, obs, s, ss): ``permuted_pair_counts`` of the map itself, and their sum and sum of squares over the permutations.

    ``patches`` has a column ``_n``, the number of patches of the sample.
    """
    shifts = None if offsets is None else np.array(offsets, float).reshape(-1, 2)
    whole = patches.filter(F.col("_n") <= tile_points).select(*keys, "patch_id", "x_um", "y_um", label_code(n_labels).alias("_own"), F.xxhash64(*keys).alias("_salt"))
    columns = ("a", "b", "obs", "s", "s2", "s1", "s0")

    def count(table: pa.Table, starts: np.ndarray) -> pa.Table:
        x, y, own, salt = (_numbers(table, c) for c in ("x_um", "y_um", "_own", "_salt"))
        rank = _ordered(table.column("patch_id"))
        lead, parts = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            label = own[a:b].astype(np.uint8)
            if shifts is None:
                drawn = shuffled_whole(b - a, np.bincount(label, minlength=n_labels + 1)[:n_labels], permutations, seed, int(salt[a]))
            at = np.flatnonzero(np.isfinite(x[a:b]) & np.isfinite(y[a:b]))
            if len(at) < 2:
                continue
            px, py, label = x[a:b][at], y[a:b][at], label[at]
            drawn = drawn[:, at] if shifts is None else toroidal_whole(px, py, label, shifts)
            one = np.r_[True, rank[a:b][at][1:] != rank[a:b][at][:-1]]  # rows of one id count once
            found = _whole_counts(px[one], py[one], np.vstack([label, drawn])[:, one], n_labels, radius)
            i, j = np.nonzero(found.any(0))
            null = found[1:, i, j]
            high, low = null >> 16, null & 0xFFFF
            parts.append(np.stack([i, j, found[0, i, j], null.sum(0), (high * high).sum(0), (high * low).sum(0), (low * low).sum(0)]))
            lead.append(np.full(len(i), a))
        if not parts:
            return None
        take = pa.array(np.concatenate(lead))
        values = np.concatenate(parts, 1)
        kept = [table.column(k).take(take).combine_chunks() for k in keys]
        return pa.Table.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in values)], [*keys, *columns])

    kinds = dict(patches.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + ", ".join(f"{c} bigint" for c in columns)
    counted = by_whole_groups(whole, keys, ["patch_id"], count, schema)
    wide = lambda c, times: F.col(c).cast("decimal(38,0)") * F.lit(times).cast("decimal(11,0)")
    squares = (wide("s2", 1 << 32) + wide("s1", 1 << 17) + wide("s0", 1)).cast("decimal(38,0)")
    out = counted.select(*keys, F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "obs", F.col("s").cast("decimal(38,0)").alias("s"), squares.alias("ss"))
    large = patches.filter(F.col("_n") > tile_points)
    if large.isEmpty():
        return out
    n = F.col("n").cast("decimal(19,0)")
    null = F.col("perm") > 0
    counts = permuted_pair_counts(large, keys, n_labels, radius, offsets, permutations, seed, tile_points)
    return out.unionByName(
        counts.groupBy(*keys, "a", "b").agg(
            F.coalesce(F.max(F.when(F.col("perm") == 0, F.col("n"))), F.lit(0)).alias("obs"),
            F.coalesce(F.sum(F.when(null, n)), F.lit(0)).cast("decimal(38,0)").alias("s"),
            F.coalesce(F.sum(F.when(null, n * n)), F.lit(0)).cast("decimal(38,0)").alias("ss"),
        )
    )
