"""Distance joins between point tables.

Every search is an equi-join on ``(group keys, tile)``. Tiles are squares of side ``2 * radius``;
a left row lives in one tile, a right row is copied to the tiles its radius box touches (at most
2 x 2). So one large image is spread over all its tiles, and whatever is aggregated per left row
afterwards reuses the join's partitioning and needs no further shuffle when the tile columns
(``TILE``) are kept among the grouping keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.operators.groups import WHOLE, by_whole_groups, codes, column, nearest_squared
from histomesh.session import durable, spread

TILE = ("_tx", "_ty")
_SLACK = 1.0 + 1e-9
MAX_PER_TILE = 4096


def squared_distance(ax, ay, bx, by) -> Column:
    dx = F.col(ax) - F.col(bx)
    dy = F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def _home_tile(df: DataFrame, xy, width: float) -> DataFrame:
    x, y = xy
    return df.withColumns({TILE[0]: _cell(F.col(x), width), TILE[1]: _cell(F.col(y), width)})


def _reach_tiles(df: DataFrame, xy, radius: float, width: float) -> DataFrame:
    """Copy each row to every tile that may hold a point within ``radius`` of it."""
    pad = radius * _SLACK
    for axis, column in zip(TILE, xy):
        span = F.sequence(_cell(F.col(column) - pad, width), _cell(F.col(column) + pad, width))
        df = df.withColumn(axis, F.explode(span))
    return df


def radius_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    radius: float,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    how: str = "inner",
) -> DataFrame:
    """All (left, right) rows of the same group with distance <= ``radius``.

    Column names must be distinct except for ``on``. Adds ``d2`` (squared distance) and the tile
    columns of the left row. ``how`` is ``inner`` or ``left``.
    """
    width = 2.0 * radius
    lhs = _home_tile(left, left_xy, width)
    rhs = _reach_tiles(right, right_xy, radius, width)
    return _tile_join(lhs, rhs, on, radius, left_xy, right_xy, how)


def _tile_join(lhs, rhs, on, radius, left_xy, right_xy, how, unless_equal=None) -> DataFrame:
    """Join left rows with the copied right rows of their tile; adds ``d2``, drops the copies' keys."""
    keys = [*on, *TILE]
    lhs = spread(lhs, keys)
    rhs = spread(rhs, keys)
    renamed = rhs.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    d2 = squared_distance(*left_xy, *right_xy)
    condition = d2 <= F.lit(radius * radius)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"_r_{k}"))
    if unless_equal:
        condition = condition & (F.col(unless_equal[0]) != F.col(unless_equal[1]))
    joined = lhs.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])
    return joined.withColumn("d2", d2)


def radius_pairs(
    points: DataFrame,
    on: list[str],
    id_col: str,
    radius: float,
    xy: tuple[str, str] = ("x_um", "y_um"),
    carry: tuple[str, ...] = (),
    unordered: bool = False,
) -> DataFrame:
    """Self radius join: ``id_col`` with ``nbr_id``, itself included.

    ``unordered=True`` keeps each pair once (smaller id first) and drops the self pair. ``carry``
    columns come along on both sides, the neighbour's prefixed ``nbr_``.
    """
    cols = [*on, id_col, *xy, *carry]
    left = points.select(*cols)
    right = points.select(
        *on,
        F.col(id_col).alias("nbr_id"),
        F.col(xy[0]).alias("nbr_x"),
        F.col(xy[1]).alias("nbr_y"),
        *[F.col(c).alias(f"nbr_{c}") for c in carry],
    )
    pairs = radius_join(left, right, on, radius, xy, ("nbr_x", "nbr_y"))
    if unordered:
        pairs = pairs.filter(F.col(id_col) < F.col("nbr_id"))
    return pairs


def _extent(df: DataFrame, xy) -> tuple[float, float, float, float] | None:
    x, y = xy
    row = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return None if row[0] is None else tuple(float(v) for v in row)


def search_plan(
    left: DataFrame, right: DataFrame, on: list[str], left_xy, right_xy, k: int, same_set: bool,
    start_radius: float | None = None,
) -> tuple[float, float, int]:
    """A first radius expected to hold about ``3k + 9`` points, and a radius nothing can exceed.

    Reads per-group counts and extents (one row per group); the third value is the largest group.
    """
    x, y = right_xy
    per_group = right.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
    )
    w = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9))
    h = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-9))
    stats = per_group.agg(
        (F.sum(F.sqrt(w * h / F.col("n")) * F.col("n")) / F.sum("n")).alias("s"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
        F.max("n").alias("largest"),
    ).first()
    if stats["s"] is None:
        return 1.0, 0.0, 0
    x0, x1, y0, y1 = (float(stats[c]) for c in ("x0", "x1", "y0", "y1"))
    if not same_set:
        other = _extent(left, left_xy)
        if other:
            x0, x1, y0, y1 = min(x0, other[0]), max(x1, other[1]), min(y0, other[2]), max(y1, other[3])
    reach = math.hypot(x1 - x0, y1 - y0) * _SLACK + 1e-9
    radius = max(float(stats["s"]) * math.sqrt((3 * k + 9) / math.pi), reach * 1e-7)
    return start_radius or radius, reach, int(stats["largest"])


def _crowding(df: DataFrame, on: list[str], xy, radius: float) -> int:
    per_tile = _home_tile(df, xy, 2.0 * radius).groupBy(*on, *TILE).agg(F.count(F.lit(1)).alias("n"))
    return int(per_tile.agg(F.max("n")).first()[0] or 0)


def _relieve(right: DataFrame, on: list[str], xy, id_col: str, n: int, radius: float, reach: float, largest=None):
    """Keep crowded spots from meeting all of themselves, without changing any answer.

    Rows sharing one exact position are thinned to the ``n`` that can matter; a tile still far
    denser than the average then shrinks the first radius (later rounds double it again).
    """
    if largest is not None and largest <= MAX_PER_TILE:
        return right, radius
    crowd = _crowding(right, on, xy, radius)
    if crowd > MAX_PER_TILE:
        right = _keep_smallest_ids(right, on, xy, id_col, n)
        crowd = _crowding(right, on, xy, radius)
    if crowd > MAX_PER_TILE:
        radius = max(radius * math.sqrt(MAX_PER_TILE / crowd), reach * 1e-7)
    return right, radius


def _keep_smallest_ids(rhs: DataFrame, keys: list[str], xy, id_col: str, n: int) -> DataFrame:
    """Of the rows sharing one exact position keep the ``n`` smallest ids.

    Exact for a k-nearest search with ties broken by id, and it bounds what a position holding
    a large part of the table can send to one task.
    """
    spot = Window.partitionBy(*keys, *xy).orderBy(id_col)
    return rhs.withColumn("_spot", F.row_number().over(spot)).filter(F.col("_spot") <= n).drop("_spot")


_SEMI_ROWS = 200_000  # two longs and the group keys each: a few MB when broadcast


def knn_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    k: int,
    left_id: str,
    right_id: str,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    exclude_self: bool = False,
    start_radius: float | None = None,
    max_radius: float | None = None,
) -> DataFrame:
    """The ``k`` nearest right rows of each left row within its group; exact, ties by id.

    Returns left and right columns with ``d2`` and ``rank`` (1..k). Left rows are unique by
    ``(on, left_id)``; ``exclude_self`` drops the right row whose id equals the left id.

    Rounds: search within a radius, keep rows that found all they can have, widen the radius for
    the rest. Inputs are read once per round, so pass stored tables when their lineage is costly. A row is done only when its k-th hit lies inside the searched radius, which makes
    the answer exact. With ``max_radius`` one round at that radius is the whole answer.
    """
    left_cols, right_cols = left.columns, [c for c in right.columns if c not in on]
    n_keep = k + (1 if exclude_self else 0)
    if max_radius is not None:
        right, _ = _relieve(right, on, right_xy, right_id, n_keep, max_radius, max_radius)
        found = _knn_round(left, right, on, k, max_radius, left_id, right_id, left_xy, right_xy, exclude_self)
        return found.filter(F.col("rank").isNotNull()).select(*left_cols, *right_cols, "d2", "rank")

    radius, reach, largest = search_plan(left, right, on, left_xy, right_xy, k, exclude_self, start_radius)
    available = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_need"))
    right, radius = _relieve(right, on, right_xy, right_id, n_keep, radius, reach, largest)
    need = F.col("_need") - (1 if exclude_self else 0)
    pending = (
        left.join(available, on, "inner")
        .withColumn("_need", F.least(F.lit(k), need).cast("int"))
        .filter(F.col("_need") > 0)
    )
    done = None
    n_pending = None
    while True:
        last = radius >= reach
        found = _knn_round(
            pending, right, on, k, radius, left_id, right_id, left_xy, right_xy, exclude_self, n_pending
        )
        if last:
            finished = found.filter(F.col("rank").isNotNull())
        else:
            found = durable(found)
            finished = found.filter(F.col("_hits") >= F.col("_need"))
        part = finished.select(*left_cols, *right_cols, "d2", "rank")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        rest = found.filter((F.col("_hits") < F.col("_need")) & (F.coalesce("rank", F.lit(1)) == 1))
        n_pending = rest.count()
        if n_pending == 0:
            return done
        pending = rest.select(*left_cols, "_need")
        radius *= 2.0 if n_pending > _SEMI_ROWS else 4.0


def _knn_round(
    left, right, on, k, radius, left_id, right_id, left_xy, right_xy, exclude_self, n_left=None
) -> DataFrame:
    width = 2.0 * radius
    lhs = _home_tile(left, left_xy, width)
    rhs = _reach_tiles(right, right_xy, radius, width)
    if n_left is not None and n_left <= _SEMI_ROWS:
        wanted = F.broadcast(lhs.select(*on, *TILE).distinct())
        rhs = rhs.join(wanted, [*on, *TILE], "left_semi")
    keys = [*on, *TILE]
    unless = (left_id, right_id) if exclude_self else None
    joined = _tile_join(lhs, rhs, on, radius, left_xy, right_xy, "left", unless)
    per_left = Window.partitionBy(*keys, left_id)
    ranked = joined.withColumn("rank", F.row_number().over(per_left.orderBy("d2", right_id))).filter(
        F.col("rank") <= k
    )
    return ranked.withColumn("_hits", F.count(right_id).over(per_left).cast("int")).withColumn(
        "rank", F.when(F.col(right_id).isNotNull(), F.col("rank"))
    )


def nearest_distance(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_id: str,
    right_id: str,
    left_xy: tuple[str, str],
    right_xy: tuple[str, str],
    exclude_self: bool = False,
    start_radius: float | None = None,
) -> DataFrame:
    """Distance from each left row to the nearest right row of its group, as ``nn_dist``.

    Groups of ``WHOLE`` rows at most on either side are searched in the task that has them. For the others only
    the minimum is wanted, so each round is one hash aggregate after the tile join.
    ``exclude_self`` leaves out the right row whose id equals the left id. Left rows whose group has
    no other row are dropped.
    """
    keep = left.columns
    if start_radius is None:
        sizes = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).join(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_m")), on)
        sizes = durable(sizes.select(*on, ((F.col("_n") <= WHOLE) & (F.col("_m") <= WHOLE)).alias("_whole")))
        small, large = sizes.filter("_whole").select(*on), sizes.filter("not _whole").select(*on)
        done = durable(_nearest_in_tasks(left.join(small, on, "left_semi"), right.join(small, on, "left_semi"), on, left_id, right_id, left_xy, right_xy, exclude_self))
        if large.isEmpty():
            return done
        left, right = durable(left.join(large, on, "left_semi")), durable(right.join(large, on, "left_semi"))
        return done.unionByName(_nearest_in_rounds(left, right, on, left_id, right_id, left_xy, right_xy, exclude_self))
    return _nearest_in_rounds(left, right, on, left_id, right_id, left_xy, right_xy, exclude_self, start_radius)


def _nearest_in_tasks(left, right, on, left_id, right_id, left_xy, right_xy, exclude_self) -> DataFrame:
    own = F.struct(*left.columns).alias("_own")  # what comes back
    rows = left.select(*on, F.col(left_id).alias("_id"), F.col(left_xy[0]).alias("_x"), F.col(left_xy[1]).alias("_y"), own)
    none = F.lit(None).cast(rows.schema["_own"].dataType).alias("_own")
    same = F.col(right_id) if exclude_self else F.lit(None)
    rows = rows.unionByName(right.select(*on, same.cast(rows.schema["_id"].dataType).alias("_id"), F.col(right_xy[0]).alias("_x"), F.col(right_xy[1]).alias("_y"), none))

    def search(table: pa.Table, starts: np.ndarray) -> pa.Table | None:
        x, y = column(table, "_x").astype(float), column(table, "_y").astype(float)
        asked = table.column("_own").is_valid().to_numpy()
        ids = codes(table, "_id")
        known = np.isfinite(x) & np.isfinite(y) & ((ids >= 0) | (not exclude_self))
        found = np.full(len(x), np.inf)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            q, t = a + np.flatnonzero(known[a:b] & asked[a:b]), a + np.flatnonzero(known[a:b] & ~asked[a:b])
            if len(q) and len(t):
                found[q] = nearest_squared(x[t], y[t], x[q], y[q], *((ids[t], ids[q]) if exclude_self else ()))
        hit = np.flatnonzero(np.isfinite(found))
        if not len(hit):
            return None
        kept = table.column("_own").take(pa.array(hit)).combine_chunks()
        return pa.table({"_own": kept, "nn_dist": pa.array(np.sqrt(found[hit]))})

    kind = rows.schema["_own"].dataType.simpleString()
    found = by_whole_groups(rows, on, [], search, f"_own {kind}, nn_dist double")
    return found.select("_own.*", "nn_dist")


def _nearest_in_rounds(left, right, on, left_id, right_id, left_xy, right_xy, exclude_self, start_radius=None) -> DataFrame:
    keep = left.columns
    exclude_equal = (left_id, right_id) if exclude_self else None
    radius, reach, largest = search_plan(left, right, on, left_xy, right_xy, 1, exclude_self, start_radius)

    available = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    right = right.select(*on, *right_xy, right_id)
    right, radius = _relieve(right, on, right_xy, right_id, 2 if exclude_equal else 1, radius, reach, largest)
    pending = (
        left.join(available, on, "inner")
        .filter(F.col("_n") > (1 if exclude_equal else 0))
        .drop("_n")
    )
    done, n_pending = None, None
    while True:
        last = radius >= reach
        width = 2.0 * radius
        lhs = _home_tile(pending, left_xy, width)
        rhs = _reach_tiles(right, right_xy, radius, width)
        if n_pending is not None and n_pending <= _SEMI_ROWS:
            wanted = F.broadcast(lhs.select(*on, *TILE).distinct())
            rhs = rhs.join(wanted, [*on, *TILE], "left_semi")
        keys = [*on, *TILE]
        joined = _tile_join(lhs, rhs, on, radius, left_xy, right_xy, "left", exclude_equal)
        others = [c for c in keep if c not in on and c != left_id]
        hit = (
            joined.groupBy(*keys, left_id)
            .agg(F.min("d2").alias("_m"), *[F.first(c).alias(c) for c in others])
        )
        if not last:
            hit = durable(hit)
        part = hit.filter(F.col("_m").isNotNull()).select(*keep, F.sqrt("_m").alias("nn_dist"))
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        rest = hit.filter(F.col("_m").isNull()).select(*keep)
        n_pending = rest.count()
        if n_pending == 0:
            return done
        pending = rest
        radius *= 2.0 if n_pending > _SEMI_ROWS else 4.0
