"""Convolution of images in tiles, and solvers whose vectors are tables of tiles.

Images are rows (band, x, y, ...), kernels rows (band, dx, dy, value) by the
displacement from their centre.  Both are cut into square tiles.  A tile of an
image meets the kernel tiles of its band, each product is a small FFT in a task,
and what falls into other tiles is added there (overlap-add): one shuffle of
tiles, in which all bands of a tile meet.  A task holds a few tiles, whatever the
size of images and kernels.  Solvers are loops of such steps: vectors are columns
of tiles, dot products are aggregates over the tiles' sums, and tables are stored
every round or every few.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, stored

#: Pixels of a tile's side.
TILE = 128
#: Tiles of sums that a task holds before it hands them on.
HELD = 32

Blocks = dict[str, np.ndarray]


def pack(images: DataFrame, columns: list[str], x: str = "x", y: str = "y", tile: int = TILE, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """Rows (tx, ty, band, inside, ...), one for each tile: the columns' pixels as bytes of doubles, inside being 1 where the image has one.

    by: the integers that tell images apart.
    """
    names = ["inside", *columns]
    schema = pa.schema([(c, pa.int32()) for c in ("tx", "ty", *by)] + [(c, pa.binary()) for c in names])

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        tx, ty, *whose = (k.as_py() for k in key)
        at, blocks = (t.column(x).to_numpy() - tx * tile, t.column(y).to_numpy() - ty * tile), []
        for values in [np.ones(t.num_rows), *(t.column(c).to_numpy() for c in columns)]:
            block = np.zeros((tile, tile))
            block[at] = values
            blocks.append([block.tobytes()])
        return pa.table([[tx], [ty], *([k] for k in whose), *blocks], schema=schema)

    place = [F.floor(F.col(c) / tile).cast("int").alias(name) for c, name in ((x, "tx"), (y, "ty"))]
    rows = images.select(*place, *(F.col(c).cast("int") for c in by), x, y, *(F.col(c).cast("double") for c in columns))
    return rows.groupBy("tx", "ty", *by).applyInArrow(packed, _ddl(names, by=by))


def _ddl(names: list[str], sums: list[str] | tuple = (), by: tuple[str, ...] = ("band",)) -> str:
    return ", ".join(f"{c} int" for c in ("tx", "ty", *by)) + "".join(f", `{c}` binary" for c in names) + "".join(f", `{c}` double" for c in sums)


def unpack(tiles: DataFrame, columns: dict[str, str], tile: int = TILE) -> DataFrame:
    """The pixels of tiles: rows (band, x, y, ...) with the named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tx, ty, band, inside, *blocks in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.nonzero(np.frombuffer(inside).reshape(tile, tile))
                values = [pa.array(np.frombuffer(b).reshape(tile, tile)[x, y]) for b in blocks]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), band, np.int32)), *(pa.array((v + t * tile).astype(np.int32)) for v, t in ((x, tx), (y, ty))), *values], names=["band", "x", "y", *columns.values()])

    return tiles.select("tx", "ty", "band", "inside", *columns).mapInArrow(run, "band int, x int, y int" + "".join(f", `{c}` double" for c in columns.values()))


@dataclass
class Kernel:
    """Kernels of all bands, transformed tile by tile and stored once, for images that begin at tile 0 and are so many tiles wide."""

    tiles: DataFrame
    tile: int

    @staticmethod
    def of(psf: DataFrame, images: DataFrame, tile: int = TILE) -> Kernel:
        """psf: band, dx, dy, value; what it does not hold is zero.  images: those that are to meet it."""
        cut = stored(transformed(psf, tile), "kernel")
        # one kernel tile of each band takes the image's own tile along; kernels go to each column of
        # tiles, so that the tiles of a band are spread over tasks
        own = cut.groupBy("band").agg(F.min(F.struct("kx", "ky")).alias("one"))
        marked = cut.join(own, "band").withColumn("own", F.struct("kx", "ky") == F.col("one")).drop("one")
        return Kernel(stored(marked.withColumn("tx", F.explode(columns_of(images, tile))), "kernel"), tile)

    def met(self, tiles: DataFrame, held: list[str], before: Callable[[int, Blocks], np.ndarray]) -> DataFrame:
        """Rows (tx, ty, band, held, seen): the tiles as they are, and parts of what ``before`` makes of them, convolved, with seen alone."""
        tile = self.tile
        between = pa.schema([(c, pa.int32()) for c in ("tx", "ty", "band")] + [(c, pa.binary()) for c in [*held, "seen"]])
        pairs = tiles.select("tx", "ty", "band", *held).join(self.tiles, ["band", "tx"], "left").select("tx", "ty", "band", *held, "kx", "ky", "hat", F.coalesce("own", F.lit(True)).alias("own"))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = Spread(tile)
            last, image = None, None

            def handed() -> pa.RecordBatch:
                keys, blocks = total.taken()
                columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.nulls(len(keys), pa.binary())] * len(held) + [pa.array(blocks, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, schema=between)

            for batch in batches:
                whose = batch.column(batch.num_columns - 1).to_pylist()
                mine = batch.filter(pa.array(whose))
                yield pa.RecordBatch.from_arrays([*mine.columns[: 3 + len(held)], pa.nulls(mine.num_rows, pa.binary())], schema=between)
                for tx, ty, band, *blocks, kx, ky, hat, _ in zip(*(c.to_pylist() for c in batch.columns)):
                    if hat is None:
                        continue
                    if (band, tx, ty) != last:
                        last, image = (band, tx, ty), total.transform(before(band, opened(held, blocks, tile)))
                    total.add(image, hat, tx + kx, ty + ky, (band,))
                    if total.full:
                        yield handed()
            if not total.empty:
                yield handed()

        return pairs.mapInArrow(multiply, _ddl([*held, "seen"]))


def transformed(psf: DataFrame, tile: int, by: tuple[str, ...] = ("band",)) -> DataFrame:
    """(kx, ky, by, hat): the transforms of a kernel's tiles, padded to twice their side."""
    schema = pa.schema([(c, pa.int32()) for c in ("kx", "ky", *by)] + [("hat", pa.binary())])

    def hats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in range(batch.num_rows):
                *key, value = (c[block].as_py() for c in batch.columns)
                hat = np.fft.rfft2(np.frombuffer(value).reshape(tile, tile), s=(2 * tile, 2 * tile))
                yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in key), pa.array([hat.tobytes()])], schema=schema)

    cut = pack(psf, ["value"], "dx", "dy", tile, by).select("tx", "ty", *by, "value")
    return cut.mapInArrow(hats, ", ".join(f"{c} int" for c in ("kx", "ky", *by)) + ", hat binary")


def columns_of(images: DataFrame, tile: int) -> Column:
    """The array of the columns of tiles that images lie in."""
    first, last = images.agg(F.floor(F.min("x") / tile), F.floor(F.max("x") / tile)).first()
    return F.sequence(F.lit(first if first is not None else 0), F.lit(last if last is not None else 0)).cast("array<int>")


def opened(names: list[str], values: tuple | list, tile: int) -> Blocks:
    return {c: np.frombuffer(v).reshape(tile, tile) for c, v in zip(names, values)}


class Spread:
    """What products of tiles and kernel tiles add to the tiles around, until a task hands it on."""

    def __init__(self, tile: int) -> None:
        self.tile, self.total = tile, {}

    def transform(self, block: np.ndarray) -> np.ndarray:
        return np.fft.rfft2(block, s=(2 * self.tile, 2 * self.tile))

    def add(self, image: np.ndarray, hat: bytes, tx: int, ty: int, whose: tuple[int, ...]) -> None:
        tile, total = self.tile, self.total
        whole = np.fft.irfft2(image * np.frombuffer(hat, complex).reshape(2 * tile, tile + 1), s=(2 * tile, 2 * tile))
        for i in (0, 1):
            for j in (0, 1):
                to = (tx + i, ty + j, *whose)
                part = whole[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
                total[to] = total[to] + part if to in total else part.copy()

    @property
    def full(self) -> bool:
        return len(self.total) >= HELD

    @property
    def empty(self) -> bool:
        return not self.total

    def taken(self) -> tuple[list[tuple[int, ...]], list[bytes]]:
        """Keys and blocks; begins anew."""
        keys, blocks = list(self.total), [v.tobytes() for v in self.total.values()]
        self.total.clear()
        return keys, blocks


def step(tiles: DataFrame, kernel: Kernel, before: Callable[[int, Blocks], np.ndarray], after: Callable[[dict[int, Blocks]], None], names: list[str], sums: list[str] | tuple = ()) -> DataFrame:
    """One convolution of what ``before`` makes of each tile, and what ``after`` makes of the result.

    tiles: what ``pack`` gives, with any columns of blocks.  before: band and
    blocks of a tile -> the block to be convolved.  after: the blocks of all bands
    of a tile, with the result as "seen"; sets their columns ``names``, and the numbers ``sums``.
    """
    tile, held = kernel.tile, [f.name for f in tiles.schema.fields if f.dataType.simpleString() == "binary"]
    result = pa.schema([(c, pa.int32()) for c in ("tx", "ty", "band")] + [(c, pa.binary()) for c in names] + [(c, pa.float64()) for c in sums])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Blocks] = {}
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, _, band, *blocks, part in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None:
                    found[band] = opened(held, blocks, tile)
                else:
                    seen[band] = seen.get(band, 0.0) + np.frombuffer(part).reshape(tile, tile)
        for band, blocks in found.items():
            blocks["seen"] = blocks["inside"] * seen.get(band, np.zeros((tile, tile)))
        if found:  # a tile beyond the image has none
            after(found)
        rows = [[key[0].as_py(), key[1].as_py(), band, *(np.ascontiguousarray(b[c]).tobytes() for c in names), *(float(b[c]) for c in sums)] for band, b in sorted(found.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(result), result)], schema=result)

    return kernel.met(tiles, held, before).groupBy("tx", "ty").applyInArrow(add, _ddl(names, sums))


def _per_band(change: Callable[[Blocks], None]) -> Callable[[dict[int, Blocks]], None]:
    def after(bands: dict[int, Blocks]) -> None:
        for blocks in bands.values():
            change(blocks)

    return after


def convolve(images: DataFrame, kernel: Kernel, plus: str | None = None, eta: float = 0.0) -> DataFrame:
    """(band, x, y, value): value convolved with its band's kernel, and with ``plus`` that column of the images added, and eta times value."""
    columns = ["value", *([plus] if plus else [])]

    def change(b: Blocks) -> None:
        b["value"] = b["seen"] + (b[plus] if plus else 0.0) + eta * b["value"]

    done = step(pack(images, columns, tile=kernel.tile), kernel, lambda _, b: b["value"], _per_band(change), ["inside", "value"])
    return unpack(done, {"value": "value"}, kernel.tile)


@dataclass
class Hessian:
    """x -> beam * (kernel conv (beam * x)) + eta x, beam being a column of the images if they have it.

    Kernels are those of non-negative weights, whose transforms are not negative.
    """

    kernel: Kernel
    eta: float = 0.0


def _seen(b: Blocks, x: np.ndarray) -> np.ndarray:
    """What of x is convolved."""
    return b.get("beam", 1.0) * x


def _applied(b: Blocks, x: np.ndarray, eta: float) -> np.ndarray:
    """A x of a tile, once the convolution is there."""
    return b.get("beam", 1.0) * b["seen"] + eta * x


def _columns(images: DataFrame) -> list[str]:
    return ["value", *(c for c in ("beam",) if c in images.columns)]


def unfinished(name: str, rounds: int, left: float) -> None:
    warnings.warn(f"{name}: not converged after {rounds} rounds, {left:.3e} left", RuntimeWarning, stacklevel=3)


@dataclass
class _Krylov:
    """A band's conjugate directions: squared residuals, and the tridiagonal matrix that their steps make."""

    first: float
    square: float
    steps: list[float] = field(default_factory=list)
    ratios: list[float] = field(default_factory=list)

    def ritz(self) -> tuple[float, float]:
        """The largest eigenvalue so far, and a bound of its distance to one of the operator."""
        k = len(self.steps)
        if not k:
            return 0.0, 0.0
        a, b = np.array(self.steps), np.array(self.ratios)
        t = np.diag(1 / a)
        t[range(1, k), range(1, k)] += b[:-1] / a[:-1]
        off = np.sqrt(b) / a
        t[range(k - 1), range(1, k)] = t[range(1, k), range(k - 1)] = off[:-1]
        values, vectors = np.linalg.eigh(t)
        return float(values[-1]), float(off[-1] * abs(vectors[-1, -1]))


def _conjugate(images: DataFrame, a: Hessian, done: Callable[[_Krylov], bool], most: int) -> tuple[DataFrame, dict[int, _Krylov]]:
    """Conjugate directions for images (band, x, y, value), each band by itself: its tiles with a column "found", and what is known of each band.

    A round takes the step of the round before and stores the next directions p
    with A p; sums over each band give its step and the next residual's norm.
    """
    vectors, eta = ["found", "r", "p", "ap"], a.eta
    fixed = ["inside", *_columns(images)[1:]]
    tiles = stored(pack(images, _columns(images), tile=a.kernel.tile), "right")
    given = tiles.select("tx", "ty", "band", *fixed, F.col("value").alias("r"))
    squares = images.groupBy(F.col("band").cast("int").alias("band")).agg(F.sum(F.col("value") * F.col("value")).alias("s")).collect()
    bands = {r["band"]: _Krylov(r["s"] or 0.0, r["s"] or 0.0) for r in squares}  # bands are few
    none = {b: (0.0, 0.0) for b in bands}

    def moved(b: Blocks, alpha: float, beta: float) -> Blocks:
        if "p" not in b:
            return {"found": np.zeros_like(b["r"]), "r": b["r"], "p": b["r"]}
        r = b["r"] - alpha * b["ap"]
        return {"found": b["found"] + alpha * b["p"], "r": r, "p": r + beta * b["p"]}

    def round_of(state: DataFrame, by: dict[int, tuple[float, float]]) -> DataFrame:
        def after(found: dict[int, Blocks]) -> None:
            for band, b in found.items():
                b |= moved(b, *by[band])
                b["ap"] = b["inside"] * _applied(b, b["p"], eta)
                b |= {"pap": (b["p"] * b["ap"]).sum(), "rap": (b["r"] * b["ap"]).sum(), "apap": (b["ap"] ** 2).sum(), "rr": (b["r"] ** 2).sum()}

        return step(state, a.kernel, lambda band, b: _seen(b, moved(b, *by[band])["p"]), after, [*fixed, *vectors], ["pap", "rap", "apap", "rr"])

    state, by = given, none
    for _ in range(most):
        open_ = {b for b, k in bands.items() if not done(k)}
        if not open_:
            break
        before, state = state, stored(round_of(state, by), "conjugate")
        if before is not given:
            discard(before)
        by = dict(none)
        for s in state.groupBy("band").agg(*(F.sum(c).alias(c) for c in ("pap", "rap", "apap", "rr"))).collect():
            b, k = s["band"], bands[s["band"]]
            if b in open_ and s["pap"] > 0:
                alpha = s["rr"] / s["pap"]
                k.square = max(s["rr"] - 2 * alpha * s["rap"] + alpha**2 * s["apap"], 0.0)
                by[b] = (alpha, k.square / s["rr"])
                k.steps.append(alpha)
                k.ratios.append(by[b][1])
    return _taken(state, by, a.kernel.tile), bands


def _taken(state: DataFrame, by: dict[int, tuple[float, float]], tile: int) -> DataFrame:
    """(band, x, y, found) with the last step taken."""
    if "found" not in state.columns:
        return unpack(state, {"r": "found"}, tile).withColumn("found", F.lit(0.0))
    pixels = unpack(state, {"found": "found", "p": "p"}, tile)
    alpha = F.create_map(*(F.lit(v) for b, (x, _) in by.items() for v in (int(b), float(x))))
    return pixels.select("band", "x", "y", (F.col("found") + F.element_at(alpha, F.col("band")) * F.col("p")).alias("found"))


def solve(images: DataFrame, a: Hessian, tol: float = 1e-9, most: int = 500) -> DataFrame:
    """x with A x = value for each band, by conjugate gradients until the residual is ``tol`` of the right side; warns if it never is."""
    near = lambda k: k.square <= tol * tol * k.first
    found, bands = _conjugate(images, a, near, most)
    if not all(map(near, bands.values())):
        unfinished("solve", most, max(sqrt(k.square / k.first) for k in bands.values() if k.first))
    return found.withColumnRenamed("found", "value")


def spectral_norms(images: DataFrame, a: Hessian, tol: float = 1e-7, most: int = 200) -> dict[int, tuple[float, float]]:
    """For each band the operator's largest eigenvalue, and a bound of its error: Ritz values of conjugate directions from a fixed start."""
    start = 1.0 + F.pmod(7 * F.col("x") + 13 * F.col("y"), F.lit(17)) / 17.0

    def near(k: _Krylov) -> bool:
        value, bound = k.ritz()
        return k.square <= 1e-28 * k.first or (len(k.steps) > 1 and bound <= tol * value)

    _, bands = _conjugate(images.withColumn("value", start), a, near, most)
    if not all(map(near, bands.values())):
        unfinished("spectral_norms", most, max(k.ritz()[1] for k in bands.values()))
    return {b: k.ritz() for b, k in sorted(bands.items())}


def bound_of(images: DataFrame, a: Hessian) -> float:
    """What no eigenvalue of the operator exceeds, but for those of vectors that the fixed start has nothing of."""
    return max((1.001 * (value + error) for value, error in spectral_norms(images, a, tol=1e-3).values()), default=1.0)


def proximal_gradient(images: DataFrame, a: Hessian, prox: Callable[[np.ndarray, float], np.ndarray], tol: float = 1e-6, most: int = 3000, each: int = 8, name: str = "proximal_gradient") -> DataFrame:
    """argmin of x'Ax / 2 - value'x + g(x); prox(values, t) is the prox of t g on values by band and pixel of a tile.

    Accelerated steps of 1 / norm, norm bounding A's eigenvalues, with the momentum
    that A's ``eta`` allows (0: that of the round).  Every ``each`` rounds are one
    plan; ends when the gradient map, norm times what a step moves, is ``tol`` of the
    right side's norm, and warns if that never comes.
    """
    norm, floor = bound_of(images, a), a.eta
    fixed = ["inside", *_columns(images)]
    state = pack(images, _columns(images), tile=a.kernel.tile)
    size = images.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    steady = (sqrt(norm) - sqrt(floor)) / (sqrt(norm) + sqrt(floor)) if floor else None
    left, before, t = 1.0, None, 1.0

    def round_of(state: DataFrame, momentum: float) -> DataFrame:
        ahead = lambda b: b["m"] + momentum * (b["m"] - b["last"]) if "m" in b else np.zeros_like(b["value"])

        def after(found: dict[int, Blocks]) -> None:
            starts = {band: ahead(b) for band, b in found.items()}
            moved = np.stack([starts[band] - (_applied(b, starts[band], floor) - b["value"]) / norm for band, b in found.items()])
            for (band, b), new in zip(found.items(), prox(moved, 1 / norm)):
                b["last"], b["m"] = b.get("m", np.zeros_like(new)), b["inside"] * new
                b["moved"] = ((b["m"] - starts[band]) ** 2).sum()

        return step(state, a.kernel, lambda _, b: _seen(b, ahead(b)), after, [*fixed, "m", "last"], ["moved"])

    for k in range(1, most + 1):
        later = (1 + sqrt(1 + 4 * t * t)) / 2
        state, t = round_of(state, (t - 1) / later if steady is None else steady if k > 1 else 0.0), later
        if k % each == 0 or k == most:
            state = stored(state, "steps")
            if before is not None:
                discard(before)
            before = state
            left = norm * sqrt((state.agg(F.sum("moved")).first()[0] or 0.0) / size) if size else 0.0
            if left <= tol:
                break
    else:
        unfinished(name, most, left)
    return unpack(state, {"m": "value"}, a.kernel.tile)


def nnls(images: DataFrame, a: Hessian, tol: float = 1e-6, most: int = 3000) -> DataFrame:
    """argmin of x'Ax / 2 - value'x over x >= 0."""
    return proximal_gradient(images, a, lambda v, _: np.maximum(v, 0.0), tol, most, name="nnls")


def fista(images: DataFrame, a: Hessian, weight: float, positive: bool = True, tol: float = 1e-6, most: int = 3000) -> DataFrame:
    """argmin of x'Ax / 2 - value'x + weight sum |x|, over x >= 0 if ``positive``."""
    prox = lambda v, t: np.maximum(v - weight * t, 0.0) if positive else np.sign(v) * np.maximum(np.abs(v) - weight * t, 0.0)
    return proximal_gradient(images, a, prox, tol, most, name="fista")


def forward_backward(images: DataFrame, a: Hessian, weight: float, tol: float = 1e-6, most: int = 3000) -> DataFrame:
    """argmin over x >= 0 of x'Ax / 2 - value'x + weight * the sum over pixels of the norm of the bands' values there.

    The prox of that norm over x >= 0 shortens the positive part of a pixel's
    values by weight * t, to nothing at most.
    """

    def prox(v: np.ndarray, t: float) -> np.ndarray:
        up = np.maximum(v, 0.0)
        size = np.sqrt((up**2).sum(axis=0))
        return up * np.maximum(1 - weight * t / np.maximum(size, 1e-300), 0.0)

    return proximal_gradient(images, a, prox, tol, most, name="forward_backward")
