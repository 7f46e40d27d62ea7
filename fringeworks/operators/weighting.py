"""uv-cell densities and imaging weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import C

CELL_KEYS = ["ui", "vi"]


def with_cells(vis: DataFrame, nx: int, ny: int, cell: float, usign: float = 1.0, vsign: float = 1.0) -> DataFrame:
    """Adds the uv cell (ui, vi) of each sample after the Hermitian fold; null outside the grid."""
    u, v = usign * F.col("u") * F.col("freq") / C, vsign * F.col("v") * F.col("freq") / C
    sign = F.when(v < 0, -1.0).otherwise(1.0)
    ui = F.floor((sign * u + 1 / (2 * cell)) * (nx * cell)).cast("int")
    vi = F.floor((sign * v + 1 / (2 * cell)) * (ny * cell)).cast("int")
    inside = (ui >= 0) & (ui < nx) & (vi >= 0) & (vi < ny)
    return vis.withColumn("ui", F.when(inside, ui)).withColumn("vi", F.when(inside, vi))


def counts(celled: DataFrame, keys: list[str]) -> DataFrame:
    """Summed weights of the unflagged samples of every occupied cell."""
    return celled.filter(~F.col("flag") & F.col("ui").isNotNull()).groupBy(*keys, *CELL_KEYS).agg(F.sum("weight").alias("cnt"))


GROUPINGS = {"per-band-time": ["band_id", "time_id"], "per-time": ["time_id"], "per-band": ["band_id"], "mfs": []}


def regrouped(cells: DataFrame, grouping: str) -> DataFrame:
    """Counts summed over the axes that a grouping leaves out."""
    return cells.groupBy(*GROUPINGS[grouping], *CELL_KEYS).agg(F.sum("cnt").alias("cnt"))


def floored(cells: DataFrame, level: float) -> DataFrame:
    """Raises cells to the median of all occupied cells divided by ``level``; 0 leaves them."""
    if not level:
        return cells
    median = cells.filter("cnt > 0").agg((F.percentile("cnt", 0.5) / level).alias("least"))
    return cells.crossJoin(F.broadcast(median)).withColumn("cnt", F.greatest("cnt", "least")).drop("least")  # one row


def box_sums(cells: DataFrame, n: int, keys: list[str], nx: int, ny: int) -> DataFrame:
    """Sum over the (2n+1)^2 cells around each cell of the grid that has an occupied neighbour."""
    steps = F.sequence(F.lit(-n), F.lit(n))
    spread = cells.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select(*keys, (F.col("ui") + F.col("dx")).alias("ui"), (F.col("vi") + F.col("dy")).alias("vi"), "cnt")
    return spread.filter(F.col("ui").between(0, nx - 1) & F.col("vi").between(0, ny - 1)).groupBy(*keys, *CELL_KEYS).agg(F.sum("cnt").alias("cnt"))


def briggs(cells: DataFrame, robust: float, keys: list[str]) -> DataFrame:
    """Counts scaled for robust weighting: c * (5 * 10**-R)**2 * sum(c) / sum(c**2) + 1, for R above -2."""
    if robust <= -2:
        return cells
    scale = (5 * 10 ** (-robust)) ** 2
    norm = cells.groupBy(*keys).agg((scale * F.sum("cnt") / F.sum(F.col("cnt") * F.col("cnt"))).alias("ssq"))
    joined = cells.join(norm, keys) if keys else cells.crossJoin(F.broadcast(norm))  # one row
    return joined.withColumn("cnt", F.col("cnt") * F.col("ssq") + 1).drop("ssq")


def weighted(celled: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Weights divided by their cell's count; samples without a cell keep theirs."""
    on = [*keys, *CELL_KEYS]
    out = celled.join(cells.select(*on, "cnt"), on, "left")
    return out.withColumn("weight", F.when(F.col("cnt") > 0, F.col("weight") / F.col("cnt")).otherwise(F.col("weight"))).drop("cnt")


def imaging_weights(vis: DataFrame, nx: int, ny: int, cell: float, robust: float | None, keys: list[str], level: float = 0.0, box: int = 0) -> DataFrame:
    """Natural (robust None or above 2), uniform (-2 and below) or Briggs weights, with optional floor and box sums."""
    if robust is None or robust > 2:
        return vis
    celled = with_cells(vis, nx, ny, cell)
    cells = floored(counts(celled, keys), level)
    if box:
        cells = box_sums(cells, box, keys, nx, ny)
    return weighted(celled, briggs(cells, robust, keys), keys)


def student_weights(vis: DataFrame, dof: float, mode: str) -> DataFrame:
    """Weights for Student-t residuals (re, im).

    grid: w (dof + 2) / (dof + rho), rho = w |r|^2 / mean(w |r|^2), per correlation.
    hci: (dof + 1) / (dof + rho) / s2, rho = |r|^2 / s2, s2 the mean |r|^2 over all correlations.
    Flagged samples are kept with the weights that they have, and count in no mean.
    """
    size = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    good, kept = vis.filter(~F.col("flag")), lambda w: F.when(F.col("flag"), F.col("weight")).otherwise(w)
    if mode == "grid":
        norm = good.groupBy("corr").agg(F.avg(F.col("weight") * size).alias("s2"))
        return vis.join(F.broadcast(norm), "corr", "left").withColumn("weight", kept(F.col("weight") * (dof + 2) / (dof + F.col("weight") * size / F.col("s2")))).drop("s2")  # a row for each correlation
    norm = good.agg(F.avg(size).alias("s2"))
    return vis.crossJoin(F.broadcast(norm)).withColumn("weight", kept((dof + 1) / (dof + size / F.col("s2")) / F.col("s2"))).drop("s2")  # one row
