"""CLEAN, primal-dual steps, beams and wavelets.

Convolutions of images of any size, and the solvers that rest on them, are in
``tiles``.  What is done here band by band is one group of a grouped Arrow function
that works on a dense image of set size; methods that couple bands loop on the
driver over DataFrames, each step a plan, with tables that cut the lineage.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from math import log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import discard, stored
from . import tiles
from .images import soft


def dense(t: pa.Table, column: str, nx: int, ny: int) -> np.ndarray:
    out = np.zeros((nx, ny))
    out[t.column("x").to_numpy(), t.column("y").to_numpy()] = t.column(column).to_numpy()
    return out


def by_band(images: DataFrame, work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], columns: list[str], nx: int, ny: int, out: list[str], key: str = "band") -> DataFrame:
    """Runs ``work`` on the dense images of each band."""
    schema = f"{key} int, x int, y int, " + ", ".join(f"{c} double" for c in out)
    x, y = (a.ravel().astype(np.int32) for a in np.meshgrid(np.arange(nx), np.arange(ny), indexing="ij"))

    def run(t: pa.Table) -> pa.Table:
        got = work({c: dense(t, c, nx, ny) for c in columns})
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * (nx * ny), pa.int32()), "x": x, "y": y, **{c: np.ascontiguousarray(got[c]).ravel() for c in out}})

    return images.select(key, "x", "y", *columns).groupBy(key).applyInArrow(run, schema)


def kernel_transform(psf: np.ndarray) -> np.ndarray:
    """Transform of a kernel whose centre is its middle pixel."""
    return np.fft.rfft2(np.fft.ifftshift(psf))


def convolve(image: np.ndarray, hat: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Convolution with zero padding to the kernel's size."""
    nx, ny = image.shape
    return np.fft.irfft2(np.fft.rfft2(image, s=shape) * hat, s=shape)[:nx, :ny]


def gaussian_kernel(n: int, major: float, minor: float, angle: float, normalise: bool = False) -> np.ndarray:
    """Elliptical Gaussian by its widths at half maximum, centred on pixel n // 2."""
    x, y = np.meshgrid(np.arange(n) - n // 2, np.arange(n) - n // 2, indexing="ij")
    along, across = x * np.sin(angle) + y * np.cos(angle), x * np.cos(angle) - y * np.sin(angle)
    g = np.exp(-4 * log(2) * (along**2 / major**2 + across**2 / minor**2))
    return g / g.sum() if normalise else g


def hessian(psf: np.ndarray, eta: float, beam: np.ndarray | float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """x -> beam * (|PSF| conv (beam * x)) + eta x; the transform's modulus keeps it positive."""
    hat = np.abs(kernel_transform(psf))
    return lambda x: beam * convolve(beam * x, hat, psf.shape) + eta * x


def hogbom(residual: DataFrame, psf: np.ndarray, gain: float, threshold: float, most: int, share: float = 0.0, active: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(model, residual) of CLEAN on (band, x, y, value): the peak of the squared sum over bands, shifted kernels subtracted.

    Ends when the peak of the sum is at most ``threshold`` or ``share`` of the
    first one, and warns if ``most`` steps do not get there.  Ties go to the first
    pixel, row by row.  The result is that of one step after another, but steps
    are taken on the driver among the ``active`` highest pixels for as long as no
    other pixel can have risen above them; a round's kernels are then subtracted
    in all tasks.  ``active`` bounds what the driver and a task hold and changes
    nothing in the result.
    """
    spark, (px, py), top = residual.sparkSession, psf.shape, float(psf.max())
    away = np.abs(psf).copy()
    away[px // 2, py // 2] = 0.0
    spill = float(away.max())  # the most that a step changes another pixel, for a peak of 1
    state = stored(residual.select("band", "x", "y", F.col("value").cast("double").alias("value")), "residual")
    bands = np.array(sorted(r[0] for r in state.select("band").distinct().collect()), int)
    model: dict[tuple[int, int], np.ndarray] = {}
    goal, done = None, 0
    while True:
        sums = state.groupBy("x", "y").agg(F.sum("value").alias("s"))
        best = sums.orderBy(F.desc(F.round(F.col("s") * F.col("s"), 12)), "x", "y").limit(active + 1).collect()
        if not best:
            break
        goal = max(threshold, share * abs(best[0]["s"])) if goal is None else goal
        if abs(best[0]["s"]) <= goal:
            break
        if done >= most:
            _unfinished("hogbom", most, abs(best[0]["s"]))
            break
        outside = abs(best[active]["s"]) if len(best) > active else None
        pixels = sorted((r["x"], r["y"]) for r in best[:active])
        place = {p: i for i, p in enumerate(pixels)}
        x, y = np.array(pixels).T
        picked = spark.createDataFrame(pixels, "x int, y int")
        values = np.zeros((len(bands), len(pixels)))
        for r in state.join(F.broadcast(picked), ["x", "y"]).collect():  # ``active`` pixels in each band
            values[np.searchsorted(bands, r["band"]), place[r["x"], r["y"]]] = r["value"]
        flux: dict[int, np.ndarray] = {}
        grown, first = 0.0, done
        while done < most:
            total = values.sum(axis=0)
            q = int(np.argmax(np.round(total * total, 12)))
            if abs(total[q]) <= goal:
                break
            if outside is not None and done > first and total[q] ** 2 <= (outside + grown) ** 2 + 1e-11:
                break
            new = gain * values[:, q] / top
            flux[q] = flux.get(q, 0.0) + new
            i, j = x - x[q] + px // 2, y - y[q] + py // 2
            inside = (i >= 0) & (i < px) & (j >= 0) & (j < py)
            values[:, inside] -= new[:, None] * psf[i[inside], j[inside]]
            grown += abs(new.sum()) * spill
            done += 1
        for q, v in flux.items():
            model[pixels[q]] = model.get(pixels[q], 0.0) + v
        at = np.array(list(flux))
        before, state = state, stored(_less_kernels(state, bands, x[at], y[at], np.stack(list(flux.values()), axis=1), psf), "residual")
        discard(before)
    found = [(int(b), int(p), int(q), float(v[k])) for (p, q), v in model.items() for k, b in enumerate(bands)]
    return spark.createDataFrame(found, "band int, x int, y int, value double"), state


def _less_kernels(state: DataFrame, bands: np.ndarray, x: np.ndarray, y: np.ndarray, flux: np.ndarray, psf: np.ndarray) -> DataFrame:
    """state less the kernels at (x, y), whose heights are flux[band, pixel]."""
    px, py = psf.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                i = part.column("x").to_numpy()[:, None] - x + px // 2
                j = part.column("y").to_numpy()[:, None] - y + py // 2
                inside = (i >= 0) & (i < px) & (j >= 0) & (j < py)
                kernel = np.where(inside, psf[np.clip(i, 0, px - 1), np.clip(j, 0, py - 1)], 0.0)
                lost = (kernel * flux[np.searchsorted(bands, part.column("band").to_numpy())]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(part.column("value").to_numpy() - lost)], names=["band", "x", "y", "value"])

    return state.mapInArrow(run, state.schema)


def _unfinished(name: str, rounds: int, left: float) -> None:
    warnings.warn(f"{name}: not converged after {rounds} rounds, {left:.3e} left", RuntimeWarning, stacklevel=3)


def clark(residual: DataFrame, psf: np.ndarray, gain: float = 0.05, minor: float = 0.5, threshold: float = 0.0, share: float = 0.05, majors: int = 50, steps: int = 1000, tile: int = tiles.TILE) -> DataFrame:
    """CLEAN in major and minor cycles to ``share`` of the first peak of the sum over bands, or ``threshold``; warns if it ends above.

    Minor steps take the peak of the squared sum over bands among the pixels above
    a share of it, and update every band there; they run on the driver, which holds
    these pixels and the model.  Major cycles subtract the model from all pixels, in
    tiles.  How low a share can be reached depends on the kernel: what a wide one
    cannot show stays in the residual.
    """
    spark, (px, py), top = residual.sparkSession, psf.shape, float(psf.max())
    dirty = stored(residual.select("band", "x", "y", F.col("value").cast("double").alias("value")), "dirty")
    bands = [r[0] for r in dirty.select("band").distinct().orderBy("band").collect()]
    row = {b: k for k, b in enumerate(bands)}
    pixels = spark.createDataFrame([(i - px // 2, j - py // 2, float(psf[i, j])) for i in range(px) for j in range(py)], "dx int, dy int, value double")
    kernel = tiles.Kernel.of(dirty.select("band").distinct().crossJoin(pixels), dirty, tile)
    model: dict[tuple[int, int], np.ndarray] = {}
    state, goal = dirty, None
    flux = lambda: spark.createDataFrame([(b, x, y, float(v[row[b]])) for (x, y), v in model.items() for b in bands], "band int, x int, y int, model double")
    for k in range(majors + 1):
        total = state.groupBy("x", "y").agg(F.sum("value").alias("s"))
        peak = total.agg(F.max(F.abs("s"))).first()[0]
        goal = max(share * (peak or 0.0), threshold) if goal is None else goal
        if peak is None or peak <= goal:
            break
        if k == majors:
            _unfinished("clark", majors, peak)
            break
        bound = minor * peak
        rows = state.join(total.filter(F.abs("s") > bound).select("x", "y"), ["x", "y"]).select("band", "x", "y", "value").collect()
        pixels = sorted({(r["x"], r["y"]) for r in rows})
        place = {p: i for i, p in enumerate(pixels)}
        active = np.zeros((len(bands), len(pixels)))
        for r in rows:
            active[row[r["band"]], place[r["x"], r["y"]]] = r["value"]
        x, y = np.array(pixels).T
        for _ in range(steps):
            sums = active.sum(axis=0) ** 2
            q = int(np.argmax(sums))
            if sqrt(sums[q]) <= bound:
                break
            new = gain * active[:, q] / top
            model[pixels[q]] = model.get(pixels[q], 0.0) + new
            i, j = x - x[q] + px // 2, y - y[q] + py // 2
            inside = (i >= 0) & (i < px) & (j >= 0) & (j < py)
            active[:, inside] -= new[:, None] * psf[i[inside], j[inside]]
        both = dirty.join(flux(), ["band", "x", "y"], "left").select("band", "x", "y", F.col("value").alias("dirty"), (-F.coalesce("model", F.lit(0.0))).alias("value"))
        state = stored(tiles.convolve(both, kernel, plus="dirty"), "residual")
    return state.join(flux(), ["band", "x", "y"], "left").select("band", "x", "y", F.coalesce("model", F.lit(0.0)).alias("model"), F.col("value").alias("residual"))


def relative_change(state: DataFrame, now: str, before: str) -> float:
    """Norm of the difference of two columns as a share of the first one's norm."""
    d = F.col(now) - F.col(before)
    num, den = state.agg(F.sum(d * d), F.sum(F.col(now) * F.col(now))).first()
    return sqrt((num or 0.0) / max(den or 0.0, 1e-12))


def primal_dual(cube: DataFrame, psf: np.ndarray, nx: int, ny: int, bound: float, rounds: int = 1000, gamma: float = 1.0, tol: float = 1e-5, least: int = 10) -> DataFrame:
    """Fixed point x >= 0 of primal-dual steps on x'Ax / 2 - b'x with a joint threshold over bands, the basis being the pixels.

    For one band it is the argmin of that and bound sum |x|.  Steps end when x
    moves by ``tol`` of its norm, looked at every fourth round; warns if it never does.

    Gradient steps are grouped by band; the dual update couples the bands of a
    pixel through a window, one shuffle for each round.
    """
    a = hessian(psf, 0.0)
    norm = float(np.abs(kernel_transform(psf)).max()) / gamma  # of the convolution, so of its part within the image at most
    sigma = norm / 2
    tau = 0.98 / (norm / 2 + sigma)
    pixels = Window.partitionBy("x", "y")
    state = cube.select("band", "x", "y", F.col("value").alias("b"), F.lit(0.0).alias("p"), F.lit(0.0).alias("v"))
    moved = 1.0
    for k in range(rounds):
        raised = F.col("v") + sigma * F.col("p")
        total = F.nullif(F.abs(F.sum("raised").over(pixels)), F.lit(0.0))
        dual = state.withColumn("raised", raised).withColumn("next", F.col("raised") * F.coalesce(F.least(F.lit(1.0), bound / total), F.lit(1.0)))

        def work(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            x = c["p"] - tau * (2 * c["next"] - c["v"] + (a(c["p"]) - c["b"]) / gamma)
            return {"b": c["b"], "p": np.maximum(x, 0), "v": c["next"], "last": c["p"]}

        state = by_band(dual, work, ["b", "p", "v", "next"], nx, ny, ["b", "p", "v", "last"])
        if k % 4 == 3 or k == rounds - 1:
            state = stored(state, "primal")
            moved = relative_change(state, "p", "last")
            if moved <= tol and k + 1 >= least:
                break
    else:
        _unfinished("primal_dual", rounds, moved)
    return state.select("band", "x", "y", F.col("p").alias("value"))


def soft_threshold(images: DataFrame, step: float) -> DataFrame:
    return images.withColumn("value", soft(F.col("value"), step))


def fit_gaussian(psf: np.ndarray, level: float = 0.5, rounds: int = 50) -> tuple[float, float, float]:
    """(major, minor, angle) of the main lobe, by moments and then Levenberg-Marquardt on the pixels above ``level``."""
    cx, cy = np.unravel_index(int(np.argmax(psf)), psf.shape)
    x, y = np.meshgrid(np.arange(psf.shape[0]) - cx, np.arange(psf.shape[1]) - cy, indexing="ij")
    lobe = (psf >= level * psf.max()) & (np.hypot(x, y) <= min(psf.shape) / 3)
    x, y, z = x[lobe].astype(float), y[lobe].astype(float), psf[lobe] / psf.max()
    if len(z) < 4:
        return (float("nan"),) * 3
    # exp(-(a x^2 + b x y + c y^2)); a first guess from the logarithm
    terms = np.stack([x * x, x * y, y * y], axis=1)
    abc, damp = np.linalg.lstsq(terms, -np.log(z), rcond=None)[0], 1e-3
    cost = lambda q: ((np.exp(-terms @ q) - z) ** 2).sum()
    for _ in range(rounds):
        model = np.exp(-terms @ abc)
        jac = -model[:, None] * terms
        g, h = jac.T @ (model - z), jac.T @ jac
        new = abc - np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), g)
        abc, damp = (new, damp / 3) if cost(new) < cost(abc) else (abc, damp * 3)
    values, vectors = np.linalg.eigh(np.array([[abc[0], abc[1] / 2], [abc[1] / 2, abc[2]]]))
    if values[0] <= 0:
        return (float("nan"),) * 3
    major, minor = (2 * sqrt(log(2) / v) for v in values)
    return major, minor, float(np.arctan2(vectors[0, 0], vectors[1, 0]) % pi)


def fit_beams(psfs: DataFrame, nx: int, ny: int) -> DataFrame:
    """(band, bmaj, bmin, bpa) of each band's kernel, in pixels and radians."""

    def run(t: pa.Table) -> pa.Table:
        a, b, p = fit_gaussian(dense(t, "value", nx, ny))
        return pa.table({"band": pa.array([t.column("band")[0].as_py()], pa.int32()), "bmaj": [a], "bmin": [b], "bpa": [p]})

    return psfs.groupBy("band").applyInArrow(run, "band int, bmaj double, bmin double, bpa double")


def restore(models: DataFrame, residuals: DataFrame, beams: tiles.Kernel) -> DataFrame:
    """model conv its band's beam (peak 1) + residual, in tiles."""
    both = models.select("band", "x", "y", "value").join(residuals.select("band", "x", "y", F.col("value").alias("residual")), ["band", "x", "y"], "full")
    return tiles.convolve(both.na.fill(0.0), beams, plus="residual")


# Wavelets --------------------------------------------------------------------

#: Daubechies scaling filters db1-db5: fixed values, from the published construction.
DAUBECHIES = {
    "db1": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145],
    "db3": [0.3326705529509569, 0.8068915093133388, 0.4598775021193313, -0.13501102001039084, -0.08544127388224149, 0.035226291882100656],
    "db4": [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
    "db5": [0.160102397974125, 0.6038292697974729, 0.7243085284385744, 0.13842814590110342, -0.24229488706619015, -0.03224486958502952, 0.07757149384006515, -0.006241490213011705, -0.012580751999015526, 0.003335725285001549],
}


def filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) analysis filters."""
    h = np.array(DAUBECHIES[name])
    return h, np.array([(-1) ** k * h[len(h) - 1 - k] for k in range(len(h))])


def analysis(n: int, name: str) -> np.ndarray:
    """(2 * coefficients, n) matrix of one level with zeros beyond the ends: a[o] = sum_j h[j] x[2 o + 1 - j]."""
    low, high = filters(name)
    k = len(low)
    count = (n + k - 1) // 2
    out = np.zeros((2 * count, n))
    for o in range(count):
        for j in range(k):
            i = 2 * o + 1 - j
            if 0 <= i < n:
                out[o, i], out[count + o, i] = low[j], high[j]
    return out


def wavelet_round_trip(images: DataFrame, nx: int, ny: int, bases: list[str]) -> DataFrame:
    """Synthesis of the analysis in every basis, summed: the number of bases times the image."""
    pairs = [(np.eye(nx), np.eye(ny)) if b == "self" else (analysis(nx, b), analysis(ny, b)) for b in bases]

    def work(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"value": sum(p.T @ (p @ c["value"] @ q.T) @ q for p, q in pairs)}

    return by_band(images, work, ["value"], nx, ny, ["value"])
