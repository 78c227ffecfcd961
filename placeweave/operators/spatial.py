"""Distance join on an equal-cell grid."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from placeweave import fixed
from placeweave.functions.geo import with_distance
from placeweave.operators.skew import PAIRS_PER_BLOCK, split_join

METRES_PER_DEGREE = fixed.EARTH_RADIUS_M * math.pi / 180


class Grid:
    """Latitude bands of twice the radius; each band is cut into about square longitude cells."""

    def __init__(self, radius_m: float):
        self.reach = radius_m / METRES_PER_DEGREE * (1 + 1e-9) + 1e-12
        self.height = 2 * self.reach

    def band(self, lat: Column) -> Column:
        return F.floor(lat / self.height)

    def cells_in(self, band: Column) -> Column:
        edge = F.greatest(F.abs(band * self.height), F.abs((band + 1) * self.height))
        width = self.height / F.cos(F.radians(F.least(edge, F.lit(89.99))))
        return F.greatest(F.floor(360 / width), F.lit(1))

    def key(self, band: Column, cell: Column) -> Column:
        return (band * F.lit(1 << 32) + cell).cast("bigint")

    def home(self, lat: Column, lng: Column) -> Column:
        """The one cell that holds a point."""
        band = self.band(lat)
        count = self.cells_in(band)
        turn = F.pmod(lng + 180.0, F.lit(360.0)) / 360.0
        return self.key(band, F.least(F.floor(turn * count), count - 1))

    def bands_near(self, lat: Column) -> Column:
        """Every band that a circle of the radius around a point can reach."""
        return F.sequence(self.band(lat - self.reach), self.band(lat + self.reach))

    def widen(self, df: DataFrame, lat: str, lng: str, band: str, out: str) -> DataFrame:
        """One row per cell that the circle around a point can reach in the row's band.

        Rows without a band stay single, with a null cell.
        """
        span = F.degrees(
            F.asin(
                F.least(
                    F.sin(F.radians(F.lit(self.reach))) / F.cos(F.radians(F.col(lat))), F.lit(1.0)
                )
            )
        )
        over_pole = F.abs(F.col(lat)) + self.reach >= 89.9999
        turn, count = F.col("grid_turn"), F.col("grid_count")
        df = df.withColumns(
            {
                "grid_count": self.cells_in(F.col(band)),
                "grid_span": F.when(over_pole, 360.0).otherwise(span + 1e-9) / 360.0,
                "grid_turn": (F.col(lng) + 180.0) / 360.0,
            }
        )
        df = df.withColumns(
            {
                "grid_first": F.floor((turn - F.col("grid_span")) * count),
                "grid_last": F.floor((turn + F.col("grid_span")) * count),
            }
        )
        # An arc never names a cell twice: it is cut to one turn.
        last = F.least(F.col("grid_last"), F.col("grid_first") + count - 1)
        df = df.withColumn("grid_cell", F.explode_outer(F.sequence(F.col("grid_first"), last)))
        return df.withColumn(out, self.key(F.col(band), F.pmod("grid_cell", "grid_count"))).drop(
            "grid_count", "grid_span", "grid_turn", "grid_first", "grid_last", "grid_cell"
        )


def within_distance(
    left: DataFrame,
    right: DataFrame,
    left_point: tuple[str, str],
    right_point: tuple[str, str],
    radius_m: float,
    keys: list[str] | None = None,
    out: str = "distance_m",
    pairs_per_block: int = PAIRS_PER_BLOCK,
) -> DataFrame:
    """All pairs no farther apart than ``radius_m``, as an equi-join on grid cells.

    Each right row lies in one cell, so a pair appears once. ``keys`` adds further equality.
    """
    keys = keys or []
    grid = Grid(radius_m)
    (left_lat, left_lng), (right_lat, right_lng) = left_point, right_point
    left = left.dropna(subset=list(left_point)).withColumn(
        "band", F.explode(grid.bands_near(F.col(left_lat)))
    )
    left = grid.widen(left, left_lat, left_lng, "band", "cell").drop("band")
    right = right.dropna(subset=list(right_point)).withColumn(
        "cell", grid.home(F.col(right_lat), F.col(right_lng))
    )
    pairs = split_join(left, right, ["cell"] + keys, pairs_per_block).drop("cell")
    # No pair is nearer than its latitudes are, which is told without any sine.
    pairs = pairs.filter(F.abs(F.col(left_lat) - F.col(right_lat)) <= grid.reach)
    return with_distance(pairs, (left_lat, left_lng, right_lat, right_lng), out).filter(F.col(out) <= radius_m)
