"""Moving windows over a grid: means, quartiles, dilation, neighbour checks.

Latitude is mirrored at the poles without repeating the edge row, longitude is
periodic. Means and dilation are separable: cells are padded by shifted copies of
the edge only and two passes of row-frame windows do the rest, so the work does
not grow with the window's area. Quartiles need a window's values themselves: the
grid is cut into square tiles, a cell goes to the tiles whose windows reach it (a
few copies for the margin, however wide the window), and each tile takes its
quartiles over views of one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terracell.functions import geometry

ROW, COL = "lat_idx", "lon_idx"


def _pad_columns(df: DataFrame, nlon: int, half: int) -> DataFrame:
    """df with ``half`` periodic columns added at both ends (any half below the width)."""
    edge = F.array(F.lit(0), F.when(F.col(COL) < half, F.lit(nlon)), F.when(F.col(COL) >= nlon - half, F.lit(-nlon)))
    return df.withColumn("_s", F.explode(F.filter(edge, lambda x: x.isNotNull()))).withColumn(COL, F.col(COL) + F.col("_s")).drop("_s")


def _pad_rows(df: DataFrame, nlat: int, half: int) -> DataFrame:
    """df with ``half`` mirrored rows added above and below."""
    i = F.col(ROW)
    mirror = F.array(i, F.when((i >= 1) & (i <= half), -i), F.when((i <= nlat - 2) & (i >= nlat - 1 - half), 2 * (nlat - 1) - i))
    return df.withColumn("_r", F.explode(F.filter(mirror, lambda x: x.isNotNull()))).withColumn(ROW, F.col("_r").cast("int")).drop("_r")


def _separable(df: DataFrame, keys: list[str], nlat: int, nlon: int, half: int, inner: dict[str, Column], outer: dict[str, Column]) -> DataFrame:
    """Two passes of frames: along rows with ``inner``, then along columns with ``outer``."""
    along = Window.partitionBy(*keys, ROW).orderBy(COL).rangeBetween(-half, half)
    wide = _pad_columns(df, nlon, half).select("*", *[c.over(along).alias(n) for n, c in inner.items()]).where(F.col(COL).between(0, nlon - 1))
    down = Window.partitionBy(*keys, COL).orderBy(ROW).rangeBetween(-half, half)
    tall = _pad_rows(wide, nlat, half).select("*", *[c.over(down).alias(n) for n, c in outer.items()])
    return tall.where(F.col(ROW).between(0, nlat - 1)).drop(*inner)


def moving_mean(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, width: int, out: str = "window_mean") -> DataFrame:
    """df with the mean of the known values in a width x width window."""
    half = width // 2
    got = _separable(df, keys, nlat, nlon, half, {"_ws": F.sum(value), "_wn": F.count(value)}, {"_ts": F.sum("_ws"), "_tn": F.sum("_wn")})
    return got.withColumn(out, F.try_divide(F.col("_ts"), F.col("_tn"))).drop("_ts", "_tn")


def dilate(df: DataFrame, keys: list[str], flag: str, nlat: int, nlon: int, width: int = 5, out: str = "dilated") -> DataFrame:
    """df with whether any cell of the window has the flag."""
    half = width // 2
    number = F.col(flag).cast("int")
    got = _separable(df, keys, nlat, nlon, half, {"_wm": F.max(number)}, {"_tm": F.max("_wm")})
    return got.withColumn(out, F.coalesce(F.col("_tm") > 0, F.lit(False))).drop("_tm")


def tiles(df: DataFrame, nlat: int, nlon: int, side: int, half: int) -> DataFrame:
    """df once for each tile (``_ti``, ``_tj``) whose cells' windows reach the cell, at its place there (``_y``, ``_x``).

    Beyond the poles and the date line a cell stands at its mirror images and repeats.
    """
    i, j = F.col(ROW).cast("int"), F.col(COL).cast("int")
    rows = F.array(i, F.when((i >= 1) & (i <= half), -i), F.when((i <= nlat - 2) & (i >= nlat - 1 - half), 2 * (nlat - 1) - i))
    out = df.withColumn("_r", F.explode(F.filter(rows, lambda x: x.isNotNull())))
    around = F.sequence(F.ceil((-half - j) / nlon).cast("int"), F.floor((nlon - 1 + half - j) / nlon).cast("int"))
    out = out.withColumn("_c", F.explode(F.transform(around, lambda k: j + k * nlon)))
    reached = lambda at, count: F.sequence(F.greatest(F.lit(0), F.ceil((at - half - side + 1) / side).cast("int")), F.least(F.lit((count - 1) // side), F.floor((at + half) / side).cast("int")))
    out = out.withColumn("_ti", F.explode(reached(F.col("_r"), nlat))).withColumn("_tj", F.explode(reached(F.col("_c"), nlon)))
    return out.select(*df.columns, "_ti", "_tj", (F.col("_r") - F.col("_ti") * side + half).alias("_y"), (F.col("_c") - F.col("_tj") * side + half).alias("_x"))


def quartiles_of(windows: np.ndarray) -> np.ndarray:
    """(rows, 3) linearly interpolated quartiles of the known (not NaN) values of each row; NaN where there are none."""
    ordered = np.sort(windows, axis=1)  # NaN last
    n = (~np.isnan(ordered)).sum(axis=1)
    out = np.full((len(ordered), 3), np.nan)
    rows = np.flatnonzero(n)
    for k, share in enumerate((0.25, 0.5, 0.75)):
        at = share * (n[rows] - 1)
        low = np.floor(at).astype(int)
        high = np.ceil(at).astype(int)
        out[rows, k] = ordered[rows, low] * (1 - (at - low)) + ordered[rows, high] * (at - low)
    return out


def _tiled_quartiles(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, half: int, wide: tuple[str, str] | None = None) -> DataFrame:
    """df with q1, q2, q3 of windows of ``half`` cells around each, or of the half widths in the columns ``wide``."""
    side = max(64, half)
    names = df.columns

    def one_tile(table: pa.Table) -> pa.Table:
        y, x = table.column("_y").to_numpy(), table.column("_x").to_numpy()
        grid = np.full((side + 2 * half, side + 2 * half), np.nan)
        known = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        grid[y, x] = known
        tile_row, tile_col = table.column("_ti").to_numpy() * side - half, table.column("_tj").to_numpy() * side - half
        # a tile's own cells stand at their own places, within its margins
        own = (table.column(ROW).to_numpy() == y + tile_row) & (table.column(COL).to_numpy() == x + tile_col) & (y >= half) & (y < half + side) & (x >= half) & (x < half + side)
        at = np.flatnonzero(own)
        hy, hx = (table.column(c).to_numpy() for c in wide) if wide else (np.full(len(y), half),) * 2
        out = np.empty((len(at), 3))
        order = np.lexsort((hx[at], hy[at], y[at]))
        at = at[order]
        new = np.flatnonzero(np.append(True, (y[at][1:] != y[at][:-1]) | (hy[at][1:] != hy[at][:-1]) | (hx[at][1:] != hx[at][:-1]))) if len(at) else []
        for lo, hi in zip(new, [*new[1:], len(at)], strict=True):  # cells of one row and one window's size
            r, b, a = int(y[at[lo]]), int(hy[at[lo]]), int(hx[at[lo]])
            band = np.lib.stride_tricks.sliding_window_view(grid[r - b : r + b + 1], 2 * a + 1, axis=1)
            step = max(1, 4_000_000 // ((2 * a + 1) * (2 * b + 1)))
            for part in range(lo, hi, step):
                some = at[part : min(hi, part + step)]
                out[part : part + len(some)] = quartiles_of(band[:, x[some] - a].transpose(1, 0, 2).reshape(len(some), -1))
        kept = table.select(names).take(pa.array(at))
        for k, q in enumerate(("q1", "q2", "q3")):
            kept = kept.append_column(q, pa.array(out[:, k], pa.float64(), from_pandas=True))
        return kept

    schema = T.StructType([*df.schema.fields, *[T.StructField(q, T.DoubleType()) for q in ("q1", "q2", "q3")]])
    return tiles(df, nlat, nlon, side, half).groupBy(*keys, "_ti", "_tj").applyInArrow(one_tile, schema)


def moving_quartiles(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, width: int) -> DataFrame:
    """df with exact quartiles q1, q2, q3 of the known values in a window around each cell."""
    return _tiled_quartiles(df, keys, value, nlat, nlon, width // 2)


def window_widths(lat_centre: Column, resolution: float, km: float = 750.0, most: int = 50) -> tuple[Column, Column]:
    """Half widths (rows, columns) of a window that spans a distance at a latitude, capped."""
    rows = F.least(F.ceil(geometry.latitude_span(F.lit(km)) / resolution), F.lit(most)).cast("int")
    cols = F.least(F.ceil(geometry.longitude_span(F.lit(km), lat_centre) / resolution), F.lit(most)).cast("int")
    return rows, cols


def adaptive_quartiles(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, resolution: float, km: float = 750.0, most: int = 50) -> DataFrame:
    """Quartiles in windows whose width follows the distance at the target cell's own latitude."""
    most = min(most, nlat // 2, nlon // 2)
    hy, hx = window_widths(-90 + resolution * (F.col(ROW) + 0.5), resolution, km, most)
    return _tiled_quartiles(df.withColumns({"_hy": hy, "_hx": hx}), keys, value, nlat, nlon, most, ("_hy", "_hx")).drop("_hy", "_hx")


def neighbour_mean(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, half: int = 2) -> DataFrame:
    """Mean and number of the known neighbours, the cell itself left out, inside a border of ``half`` cells.

    One window sum per direction, less the cell's own value; no cell beyond the
    grid takes part, and border cells get NULL.
    """
    known = F.col(value).isNotNull()
    along = Window.partitionBy(*keys, ROW).orderBy(COL).rangeBetween(-half, half)
    down = Window.partitionBy(*keys, COL).orderBy(ROW).rangeBetween(-half, half)
    rows = df.withColumn("_ws", F.sum(value).over(along)).withColumn("_wn", F.count(value).over(along))
    rows = rows.withColumn("_s", F.sum("_ws").over(down) - F.coalesce(F.col(value), F.lit(0.0))).withColumn("_n", F.sum("_wn").over(down) - known.cast("int"))
    inside = F.col(ROW).between(half, nlat - 1 - half) & F.col(COL).between(half, nlon - 1 - half)
    mean = F.when(inside, F.try_divide(F.col("_s"), F.col("_n")))
    return rows.withColumn("neighbour_mean", mean).withColumn("neighbours", F.when(inside, F.col("_n"))).drop("_ws", "_wn", "_s", "_n")


def cloud_mask(df: DataFrame, keys: list[str], value: str, nlat: int, nlon: int, half: int = 2, least: int = 2, excess: float = 10.0) -> DataFrame:
    """df with ``cloud``: colder than the mean of at least ``least`` neighbours by more than ``excess``."""
    got = neighbour_mean(df, keys, value, nlat, nlon, half)
    hit = (F.col("neighbours") >= least) & (F.col("neighbour_mean") - F.col(value) > excess)
    return got.withColumn("cloud", F.coalesce(hit, F.lit(False)))
