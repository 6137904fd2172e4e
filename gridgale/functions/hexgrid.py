"""Hexagonal cells in axial coordinates (q, r), as Column arithmetic.

The plane is equirectangular and the hexagons are pointy-topped; a cell of resolution ``res``
has the published average area of that resolution. A disk of radius k holds 1 + 3k(k+1) cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgale.constants import CELL_AREA_KM2, DEFAULT_CELL_AREA_KM2

KM_PER_DEGREE = 111.32


def disk_offsets(k: int) -> list[tuple[int, int]]:
    span = range(-k, k + 1)
    return [(dq, dr) for dq in span for dr in span if abs(dq + dr) <= k]


def area_km2(res: int) -> float:
    return CELL_AREA_KM2.get(res, DEFAULT_CELL_AREA_KM2)


def edge_km(res: int) -> float:
    return math.sqrt(2.0 * area_km2(res) / (3.0 * math.sqrt(3.0)))


def area_column(res: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in CELL_AREA_KM2.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, res), F.lit(DEFAULT_CELL_AREA_KM2))


def locate(lat: Column, lon: Column, res: int = 7) -> tuple[Column, Column]:
    """Axial coordinates of the cell that contains a point; null when the point is unknown."""
    edge = edge_km(res) / KM_PER_DEGREE
    x, y = lon / F.lit(edge), lat / F.lit(edge)
    fq = x * F.lit(math.sqrt(3.0) / 3.0) - y / F.lit(3.0)
    fr = y * F.lit(2.0 / 3.0)
    fs = -fq - fr
    rq, rr, rs = (F.floor(v + 0.5) for v in (fq, fr, fs))
    dq, dr, ds = F.abs(rq - fq), F.abs(rr - fr), F.abs(rs - fs)
    # Rounding three coordinates that must sum to zero: the one that moved most is derived.
    q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return q.cast("bigint"), r.cast("bigint")


def cell_id(q: Column, r: Column, res: int = 7) -> Column:
    """Printable cell id; null if the coordinates are."""
    return F.concat(F.lit(f"{res}:"), q.cast("string"), F.lit(":"), r.cast("string"))


def centroid(q: Column, r: Column, res: int = 7) -> tuple[Column, Column]:
    """(lat, lon) of a cell's centre."""
    edge = edge_km(res) / KM_PER_DEGREE
    lat = r * F.lit(1.5 * edge)
    lon = (q + r / F.lit(2.0)) * F.lit(math.sqrt(3.0) * edge)
    return lat, lon


def offsets_array(k: int) -> Column:
    return F.array(*[
        F.struct(
            F.lit(1 << i).cast("bigint").alias("bit"),
            F.lit(dq).cast("bigint").alias("dq"),
            F.lit(dr).cast("bigint").alias("dr"),
        )
        for i, (dq, dr) in enumerate(disk_offsets(k))
    ])


def with_disk(df: DataFrame, k: int, q: str = "q", r: str = "r") -> DataFrame:
    """One row per cell of the disk around each row's cell, as (nq, nr); a narrow explode."""
    out = df.withColumn("_o", F.explode(offsets_array(k)))
    return out.withColumns({
        "nq": F.col(q) + F.col("_o.dq"), "nr": F.col(r) + F.col("_o.dr"),
    }).drop("_o")


TILE = 16  # cells per tile side


def tile_of(cell: Column) -> Column:
    return F.floor(cell / F.lit(TILE)).cast("bigint")


def reached_tiles(df: DataFrame, q: str, r: str, k: int) -> DataFrame:
    """One copy of a row for each tile (tq, tr) that the disk around its cell reaches."""
    def tiles(c: str) -> Column:
        return F.explode(F.sequence(tile_of(F.col(c) - k), tile_of(F.col(c) + k)))

    return df.withColumn("tq", tiles(q)).withColumn("tr", tiles(r))


def on_tiles(df: DataFrame, q: str, r: str, k: int, time: str) -> DataFrame:
    """Rows laid out by square tiles of cells and ``time``, copied as by ``reached_tiles``. ``tile_offsets`` then does
    the rest inside a task, and whatever is grouped by tile, time and more is in place."""
    return reached_tiles(df, q, r, k).repartition("tq", "tr", time)


def tile_offsets(offsets: Column, q: str, r: str, sign: int = 1) -> Column:
    """Those of the disk offsets (negated with ``sign`` -1) that lead from the row's cell into the row's tile."""
    return F.filter(offsets, lambda o: (tile_of(F.col(q) + o["dq"] * sign) == F.col("tq"))
                    & (tile_of(F.col(r) + o["dr"] * sign) == F.col("tr")))
