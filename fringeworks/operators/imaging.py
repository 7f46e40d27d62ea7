"""From visibilities to images and back.

``direct_image`` is the exact sum over samples; each task adds its samples into
one partial image, so a sample never meets a pixel in a join and what is
shuffled is one image for each task.  ``gridded_image`` puts samples on a padded
grid with a kernel first and transforms the sum, whose cost does not depend on
the number of pixels.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import C
from ..plans.tables import stored

_CHUNK = 4096
#: Phases that a task holds at a time, samples times pixels.
_PHASES = 1 << 22


def _chunk(pixels: int) -> int:
    return max(1, min(_CHUNK, _PHASES // max(pixels, 1)))


def lm_grid(nx: int, ny: int, cell: float, l0: float = 0.0, m0: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    return (np.arange(nx) - nx // 2) * cell + l0, (np.arange(ny) - ny // 2) * cell + m0


def _phases(u, v, w, f, l, m):
    """Phases (samples, pixels) of the transform."""
    n = np.sqrt(1 - l * l - m * m) - 1
    k = 2 * pi * f / C
    return (k * u)[:, None] * l - (k * v)[:, None] * m - (k * w)[:, None] * n


def _batches(groups: list[str], columns: list[str], batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The rows of a batch by group."""
    t = pa.Table.from_batches([batch])
    if not groups:
        yield (), [t.column(c).to_numpy() for c in columns]
        return
    keys = t.select(groups).group_by(groups).aggregate([]).to_pylist()
    import pyarrow.compute as pc

    for key in keys:
        mask = pc.equal(t.column(groups[0]), key[groups[0]])
        for g in groups[1:]:
            mask = pc.and_(mask, pc.equal(t.column(g), key[g]))
        part = t.filter(mask)
        yield tuple(key[g] for g in groups), [part.column(c).to_numpy() for c in columns]


def direct_image(vis: DataFrame, nx: int, ny: int, cell: float, groups: list[str] | None = None, l0: float = 0.0, m0: float = 0.0, value: str = "data") -> DataFrame:
    """Rows (*groups, x, y, value): sum of w Re(V exp(2 pi i ...)) over the unflagged samples.

    value: "data" for the dirty image, "psf" for V = 1 at the image's own centre.
    """
    groups = groups or []
    l, m = (a.ravel() for a in np.meshgrid(*lm_grid(nx, ny, cell, l0, m0), indexing="ij"))
    names = ["u", "v", "w", "freq", "re", "im", "weight"]
    rows = vis.filter(~F.col("flag")).select(*groups, *names)
    pixels = np.arange(nx * ny)
    step = _chunk(nx * ny)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, (u, v, w, f, re, im, wt) in _batches(groups, names, batch):
                image = sums.setdefault(key, np.zeros(nx * ny))
                for k in range(0, len(u), step):
                    s = slice(k, k + step)
                    phase = _phases(u[s], v[s], w[s], f[s], l, m)
                    if value == "psf":
                        centre = _phases(u[s], v[s], w[s], f[s], np.array([l0]), np.array([m0]))
                        image += wt[s] @ np.cos(phase - centre)
                    else:
                        image += (wt[s] * re[s]) @ np.cos(phase) - (wt[s] * im[s]) @ np.sin(phase)
        for key, image in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * (nx * ny), pa.int32()) for k in key), pa.array((pixels // ny).astype(np.int32)), pa.array((pixels % ny).astype(np.int32)), pa.array(image)], names=[*groups, "x", "y", "value"])

    schema = ", ".join([*(f"{g} int" for g in groups), "x int", "y int", "value double"])
    partial = rows.select(*(F.col(g).cast("int").alias(g) for g in groups), *names).mapInArrow(run, schema)
    return partial.groupBy(*groups, "x", "y").agg(F.sum("value").alias("value"))


#: Turns by the w term, in radians, up to which it is a short power series.
_NARROW = 1.0


def _powers(turn: float) -> int:
    """Terms of the series of exp(i x) for |x| <= turn, to the last digits of a double."""
    n, term = 1, 1.0
    while term > 1e-16:
        term *= turn / n
        n += 1
    return n - 1


class _Separable:
    """Sums over samples of Re(value exp(i phase)), phases being factors of rows and columns of pixels.

    The phase is a part along x, one along y and the w term, which is a product of w
    and n alike in every pixel; all terms of its series are one matrix product.
    """

    def __init__(self, u, v, w, f, lx: np.ndarray, my: np.ndarray, powers: int):
        k = 2 * pi * f / C
        across, down = np.outer(lx, k * u), np.outer(-my, k * v)
        self.cos, self.sin, self.n = np.cos(across), np.sin(across), np.sqrt(1 - (lx * lx)[:, None] - my * my) - 1
        cos, sin, scale = np.cos(down), np.sin(down), np.ones(len(u))
        # the real parts of (-i)^j z and, for odd j, its imaginary ones
        self.right = np.empty((powers, len(my), 2 * len(u)))
        for j, right in enumerate(self.right):
            s = scale if j % 4 < 2 else -scale
            np.multiply(sin if j % 2 else cos, s, out=right[:, : len(u)])
            np.multiply(cos if j % 2 else sin, s if j % 2 else -s, out=right[:, len(u) :])
            scale = scale * (k * w)

    def sums(self, re: np.ndarray, im: np.ndarray | None = None, xs: slice = slice(None), ys: slice = slice(None)) -> np.ndarray:
        """The image of some rows and columns, value by pixel, as one array."""
        cos, sin, right, n = self.cos[xs], self.sin[xs], self.right[:, ys], self.n[xs, ys]
        left = np.concatenate([cos * re, sin * re] if im is None else [cos * re - sin * im, sin * re + cos * im], axis=1)
        terms = (left @ right.reshape(-1, left.shape[1]).T).reshape(len(left), len(right), -1)
        out = terms[:, -1]
        for j in range(len(right) - 2, -1, -1):
            out = out * n / (j + 1) + terms[:, j]
        return out.ravel()


def product_sums(vis: DataFrame, nx: int, ny: int, cell: float, groups: list[str] | None = None, wide: int = 2) -> DataFrame:
    """Rows (*groups, product, x, y, value) of one scan: dirty, psf, and residual where vis holds a model p_re, p_im.

    Sums over the unflagged samples, centred.  psf has ``wide`` times the pixels
    along each axis; its middle pixel is the sum of weights.  Where the w term turns
    no phase by more than a radian, as in narrow fields, the phases are products of a
    factor for each row and each column of pixels; else each is made by itself.
    """
    groups = groups or []
    px, py = wide * nx, wide * ny
    lx, my = lm_grid(px, py, cell)
    l, m = (a.ravel() for a in np.meshgrid(lx, my, indexing="ij"))
    ix, iy = (slice(p // 2 - n // 2, p // 2 - n // 2 + n) for p, n in ((px, nx), (py, ny)))
    inner = np.arange(px * py).reshape(px, py)[ix, iy].ravel()
    model = ["p_re", "p_im"] if "p_re" in vis.columns else []
    names = ["u", "v", "w", "freq", "re", "im", "weight", *model]
    shapes = {"dirty": (nx, ny), "psf": (px, py), **({"residual": (nx, ny)} if model else {})}
    step = _chunk(px * py)
    deep = np.abs(np.sqrt(1 - l * l - m * m) - 1).max()

    def add(image: dict[str, np.ndarray], u, v, w, f, re, im, wt, *predicted) -> None:
        turn = deep * np.abs(w * (2 * pi * f / C)).max()
        if turn <= _NARROW:
            phases = _Separable(u, v, w, f, lx, my, _powers(turn))
            image["psf"] += phases.sums(wt)
            image["dirty"] += phases.sums(wt * re, wt * im, ix, iy)
            if predicted:
                image["residual"] += phases.sums(wt * (re - predicted[0]), wt * (im - predicted[1]), ix, iy)
            return
        phase = _phases(u, v, w, f, l, m)
        cos = np.cos(phase)
        image["psf"] += wt @ cos
        cos, sin = cos[:, inner], np.sin(phase[:, inner])
        image["dirty"] += (wt * re) @ cos - (wt * im) @ sin
        if predicted:
            image["residual"] += (wt * (re - predicted[0])) @ cos - (wt * (im - predicted[1])) @ sin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict[str, np.ndarray]] = {}
        for batch in batches:
            for key, columns in _batches(groups, names, batch):
                image = sums.setdefault(key, {p: np.zeros(a * b) for p, (a, b) in shapes.items()})
                for k in range(0, len(columns[0]), step):
                    add(image, *(c[k : k + step] for c in columns))
        for key, image in sums.items():
            for product, (a, b) in shapes.items():
                at = np.arange(a * b)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * (a * b), pa.int32()) for k in key), pa.array([product] * (a * b)), pa.array((at // b).astype(np.int32)), pa.array((at % b).astype(np.int32)), pa.array(image[product])], names=[*groups, "product", "x", "y", "value"])

    rows = vis.filter(~F.col("flag")).select(*(F.col(g).cast("int").alias(g) for g in groups), *names)
    schema = ", ".join([*(f"{g} int" for g in groups), "product string", "x int", "y int", "value double"])
    return rows.mapInArrow(run, schema).groupBy(*groups, "product", "x", "y").agg(F.sum("value").alias("value"))


def data_products(vis: DataFrame, nx: int, ny: int, cell: float, groups: list[str] | None = None, components: DataFrame | None = None, wide: int = 2) -> DataFrame:
    """Dirty images, PSFs and, given a model, residuals of each group, over the sums of weights; visibilities are read once."""
    if components is not None:  # only what the sums use passes through the tasks that predict
        used = vis.filter(~F.col("flag")).select(*(groups or []), "u", "v", "w", "freq", "re", "im", "weight", "flag")
        vis = predict(used, components, nx, ny, cell)
    sums = stored(product_sums(vis, nx, ny, cell, groups, wide), "products")
    middle = sums.filter((F.col("product") == "psf") & (F.col("x") == wide * nx // 2) & (F.col("y") == wide * ny // 2))
    return normalised(sums, middle.select(*(groups or []), F.col("value").alias("wsum")), groups)


def weight_sums(vis: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return vis.filter(~F.col("flag")).groupBy(*(groups or [])).agg(F.sum("weight").alias("wsum"))


def normalised(image: DataFrame, wsums: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Image divided by its sum of weights."""
    joined = image.join(wsums, groups) if groups else image.crossJoin(F.broadcast(wsums))  # one row
    return joined.withColumn("value", F.col("value") / F.nullif(F.col("wsum"), F.lit(0.0))).drop("wsum")


def mfs(images: DataFrame, wsums: DataFrame) -> DataFrame:
    """Sum over bands, divided by the total sum of weights."""
    total = wsums.agg(F.sum("wsum").alias("wsum"))
    return normalised(images.groupBy("x", "y").agg(F.sum("value").alias("value")), total)


def predict(vis: DataFrame, components: DataFrame, nx: int, ny: int, cell: float) -> DataFrame:
    """vis with p_re, p_im: the model's visibilities.  components: x, y, value, a bounded list of pixels.

    The list is read once and sent to every task, so it must fit one; a model
    image of nx * ny pixels is the proven bound.
    """
    picked = components.select("x", "y", "value").limit(nx * ny + 1).collect()
    if len(picked) > nx * ny:
        raise ValueError("more components than pixels")
    gl, gm = lm_grid(nx, ny, cell)
    x = np.array([r[0] for r in picked], int)
    y = np.array([r[1] for r in picked], int)
    flux = np.array([r[2] for r in picked], float)
    l, m = gl[x] if len(x) else np.zeros(0), gm[y] if len(y) else np.zeros(0)
    names = vis.columns
    step = _chunk(len(picked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, w, f = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("u", "v", "w", "freq"))
            re, im = np.zeros(len(u)), np.zeros(len(u))
            for k in range(0, len(u), step):
                s = slice(k, k + step)
                phase = _phases(u[s], v[s], w[s], f[s], l, m)
                re[s], im[s] = np.cos(phase) @ flux, -(np.sin(phase) @ flux)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(re), pa.array(im)], names=[*names, "p_re", "p_im"])

    schema = vis.withColumn("p_re", F.lit(0.0)).withColumn("p_im", F.lit(0.0)).schema
    return vis.mapInArrow(run, schema)


def residual(vis: DataFrame, components: DataFrame, nx: int, ny: int, cell: float, groups: list[str] | None = None) -> DataFrame:
    """Dirty image of the data less the model."""
    p = predict(vis, components, nx, ny, cell)
    return direct_image(p.withColumn("re", F.col("re") - F.col("p_re")).withColumn("im", F.col("im") - F.col("p_im")), nx, ny, cell, groups)


def _kernel(x: np.ndarray, width: int, beta: float) -> np.ndarray:
    """Exponential of a semicircle on [-1, 1]."""
    t = 2 * x / width
    return np.where(np.abs(t) <= 1, np.exp(beta * (np.sqrt(np.maximum(1 - t * t, 0)) - 1)), 0)


def gridded_image(vis: DataFrame, nx: int, ny: int, cell: float, groups: list[str] | None = None, width: int = 8) -> DataFrame:
    """As ``direct_image`` without the w term, by kernel gridding at twice the size and an FFT.

    With a kernel of 8 cells the error is near 1e-7 of the sum of weights.
    """
    groups = groups or []
    gx, gy, beta = 2 * nx, 2 * ny, 2.3 * width
    names = ["u", "v", "freq", "re", "im", "weight"]
    rows = vis.filter(~F.col("flag")).select(*(F.col(g).cast("int").alias(g) for g in groups), *names)
    reach = np.arange(width) - width // 2 + 1

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, (u, v, f, re, im, wt) in _batches(groups, names, batch):
                grid = sums.setdefault(key, np.zeros(gx * gy, complex))
                pu, pv = u * f / C * cell * gx, -v * f / C * cell * gy
                iu, iv = np.floor(pu).astype(int), np.floor(pv).astype(int)
                ku, kv = _kernel(pu[:, None] - (iu[:, None] + reach), width, beta), _kernel(pv[:, None] - (iv[:, None] + reach), width, beta)
                at = ((iu[:, None] + reach) % gx)[:, :, None] * gy + ((iv[:, None] + reach) % gy)[:, None, :]
                value = (wt * (re + 1j * im))[:, None, None] * ku[:, :, None] * kv[:, None, :]
                grid += np.bincount(at.ravel(), value.real.ravel(), gx * gy) + 1j * np.bincount(at.ravel(), value.imag.ravel(), gx * gy)
        for key, grid in sums.items():
            full = np.flatnonzero(grid)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(full), pa.int32()) for k in key), pa.array(full.astype(np.int32)), pa.array(grid[full].real), pa.array(grid[full].imag)], names=[*groups, "at", "re", "im"])

    head = "".join(f"{g} int, " for g in groups)
    cells = rows.mapInArrow(spread, head + "at int, re double, im double").groupBy(*groups, "at").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))

    def transform(t: pa.Table) -> pa.Table:
        grid = np.zeros(gx * gy, complex)
        grid[t.column("at").to_numpy()] = t.column("re").to_numpy() + 1j * t.column("im").to_numpy()
        image = np.fft.ifft2(grid.reshape(gx, gy)) * gx * gy
        # the kernel's own transform, by quadrature
        nodes, weights = np.polynomial.legendre.leggauss(64)
        ix, iy = np.arange(nx) - nx // 2, np.arange(ny) - ny // 2
        correct = lambda i, g: (weights * _kernel(nodes * width / 2, width, beta) * np.cos(2 * pi * np.outer(i / g, nodes * width / 2))).sum(1) * width / 2
        out = image[np.ix_(ix % gx, iy % gy)].real / np.outer(correct(ix, gx), correct(iy, gy))
        x, y = np.meshgrid(np.arange(nx), np.arange(ny), indexing="ij")
        keys = {g: pa.array([t.column(g)[0].as_py()] * (nx * ny), pa.int32()) for g in groups}
        return pa.table({**keys, "x": x.ravel().astype(np.int32), "y": y.ravel().astype(np.int32), "value": out.ravel()})

    # a group here is a band's grid, of a size set by the image
    keyed = cells if groups else cells.withColumn("one", F.lit(0))
    return keyed.groupBy(*(groups or ["one"])).applyInArrow(transform, head + "x int, y int, value double")
