"""Images that are sparse in several bases at once: analysis, and a primal-dual solver with reweighting.

A basis is a number of Haar levels, 0 being the pixels themselves.  A tile whose
side is a multiple of 2 ** levels holds its coefficients whole, since each has
its support in one such square; so a coefficient block lies beside the tile's
pixels, all bands of a coefficient meet where those of a pixel do, and a round of
the solver is one convolution in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, stored
from .tiles import TILE, Blocks, Hessian, _applied, _columns, _seen, bound_of, pack, step, unfinished, unpack


def haar(block: np.ndarray, levels: int) -> np.ndarray:
    """Orthonormal coefficients of a square: averages in the first corner, halved level by level."""
    out, n = np.array(block, float), len(block)
    for _ in range(levels):
        for axis in (0, 1):
            a = np.moveaxis(out[:n, :n], axis, 0)
            a[:] = np.concatenate([a[0::2] + a[1::2], a[0::2] - a[1::2]]) / sqrt(2)
        n //= 2
    return out


def haar_back(block: np.ndarray, levels: int) -> np.ndarray:
    out = np.array(block, float)
    for level in reversed(range(levels)):
        n = len(block) >> level
        for axis in (1, 0):
            a = np.moveaxis(out[:n, :n], axis, 0)
            s, d = a[: n // 2].copy(), a[n // 2 :].copy()
            a[0::2], a[1::2] = (s + d) / sqrt(2), (s - d) / sqrt(2)
    return out


def _check(bases: tuple[int, ...], tile: int) -> None:
    if not bases or len(set(bases)) < len(bases) or any(k < 0 or tile % 2**k for k in bases):
        raise ValueError(f"bases {bases} are not different levels that divide tiles of {tile} pixels")


def analysis(images: DataFrame, bases: tuple[int, ...], tile: int = TILE) -> DataFrame:
    """Rows (band, basis, tx, ty, i, j, value): the coefficients of each tile; pixels that an image lacks are 0."""
    _check(bases, tile)
    names = ["band", "basis", "tx", "ty", "i", "j", "value"]
    i, j = (a.ravel().astype(np.int32) for a in np.indices((tile, tile)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tx, ty, band, value in zip(*(c.to_pylist() for c in batch.columns)):
                for k in bases:
                    same = [pa.array(np.full(tile * tile, v, np.int32)) for v in (band, k, tx, ty)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(i), pa.array(j), pa.array(haar(np.frombuffer(value).reshape(tile, tile), k).ravel())], names=names)

    return pack(images, ["value"], tile=tile).select("tx", "ty", "band", "value").mapInArrow(run, ", ".join(f"{c} int" for c in names[:-1]) + ", value double")


def primal_dual(images: DataFrame, a: Hessian, weight: float, bases: tuple[int, ...], reweights: int = 0, tol: float = 1e-4, most: int = 4000, each: int = 8) -> DataFrame:
    """argmin over x >= 0 of x'Ax / 2 - value'x + weight * sum over bases and coefficients of w * (norm over bands of the coefficient).

    w is 1; after each of ``reweights`` solutions it becomes 2 / (1 + size / rms), size
    being that norm and rms its root mean square over the basis, so that what is
    large is held back less; the next solution begins at the last.  Ends when the
    residuals of both optimality conditions are ``tol`` of the right side's norm,
    and warns if they never are.
    """
    tile = a.kernel.tile
    _check(bases, tile)
    norm = bound_of(images, a)
    # steps for which 1 / tau - sigma * (number of orthonormal bases) is at least half the norm
    sigma = norm / (2 * len(bases))
    tau = 0.99 / norm
    duals, held, eta = [f"dual{k}" for k in bases], [f"w{k}" for k in bases], a.eta
    fixed = ["inside", *_columns(images)]
    size = images.agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
    state, before = pack(images, _columns(images), tile=tile), None

    def solution(state: DataFrame) -> DataFrame:
        weights = [w for w in held if w in state.columns]

        def after(found: dict[int, Blocks]) -> None:
            shape, moves = (tile, tile), {}
            for band, b in found.items():
                b.setdefault("m", np.zeros(shape))
                for d in duals:
                    b.setdefault(d, np.zeros(shape))
                pull = sum(haar_back(b[d], k) for d, k in zip(duals, bases))
                new = b["inside"] * np.maximum(b["m"] - tau * (_applied(b, b["m"], eta) - b["value"] + pull), 0.0)
                moves[band], b["m"] = b["m"] - new, new
                b |= {"moved": (moves[band] ** 2).sum(), "dual": 0.0, "back": 0.0}
            turned = {band: np.zeros(shape) for band in found}
            for d, w, k in zip(duals, held, bases):
                old = np.stack([b[d] for b in found.values()])
                new = old + sigma * np.stack([haar(b["m"] - moves[band], k) for band, b in found.items()])
                most_ = weight * next(iter(found.values())).get(w, 1.0)
                new = new * np.minimum(1.0, most_ / np.maximum(np.sqrt((new**2).sum(0)), 1e-300))
                for (band, b), v, u in zip(found.items(), new, old):
                    b[d] = v
                    b["dual"] += (((u - v) / sigma - haar(moves[band], k)) ** 2).sum()
                    turned[band] += haar_back(u - v, k)
            for band, b in found.items():
                b["back"] = (b["inside"] * (moves[band] / tau - turned[band]) ** 2).sum()

        return step(state, a.kernel, lambda _, b: _seen(b, b.get("m", np.zeros((tile, tile)))), after, [*fixed, *weights, "m", *duals], ["moved", "dual", "back"])

    for major in range(reweights + 1):
        left = 1.0
        for k in range(1, most + 1):
            state = solution(state)
            if k % each == 0 or k == most:
                state = stored(state, "duals")
                if before is not None:
                    discard(before)
                before = state
                moved, dual, back = (v or 0.0 for v in state.agg(F.sum("moved"), F.sum("dual"), F.sum("back")).first())
                left = max(sqrt(back) + norm * sqrt(moved), norm * sqrt(dual)) / sqrt(size) if size else 0.0
                if left <= tol:
                    break
        else:
            unfinished("primal_dual", most, left)
        if major < reweights:
            state = _reweighted(state, bases, tile)
    return unpack(state, {"m": "value"}, tile)


def _reweighted(state: DataFrame, bases: tuple[int, ...], tile: int) -> DataFrame:
    """The state with weights of all coefficients, from sizes over the bands of each tile and their rms over all tiles."""
    kept = [f.name for f in state.schema.fields if f.dataType.simpleString() == "binary" and not f.name.startswith("w")]
    sizes = [f"w{k}" for k in bases]
    schema = pa.schema([(c, pa.int32()) for c in ("tx", "ty")] + [(c, pa.binary()) for c in sizes] + [(f"s{k}", pa.float64()) for k in bases] + [("n", pa.float64())])

    def sized(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, n = {k: np.zeros((tile, tile)) for k in bases}, 0
        for batch in batches:
            for inside, m in zip(*(c.to_pylist() for c in batch.columns[2:])):
                n = max(n, int(np.frombuffer(inside).sum()))
                for k in bases:
                    squares[k] += haar(np.frombuffer(m).reshape(tile, tile), k) ** 2
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([np.sqrt(s).tobytes()]) for s in squares.values()] + [pa.array([float(s.sum())]) for s in squares.values()] + [pa.array([float(n)])], schema=schema)

    ddl = "tx int, ty int" + "".join(f", {c} binary" for c in sizes) + "".join(f", s{k} double" for k in bases) + ", n double"
    found = stored(state.select("tx", "ty", "inside", "m").groupBy("tx", "ty").applyInArrow(sized, ddl), "sizes")
    total = found.agg(*(F.sum(f"s{k}") for k in bases), F.sum("n")).first()
    rms = [sqrt((s or 0.0) / total[-1]) if total[-1] else 0.0 for s in total[:-1]]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array([(2 / (1 + np.frombuffer(v) / r) if r else np.full(tile * tile, 2.0)).tobytes() for v in c.to_pylist()], pa.binary()) for c, r in zip(batch.columns[2:], rms)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["tx", "ty", *sizes])

    weights = found.select("tx", "ty", *sizes).mapInArrow(weighed, "tx int, ty int" + "".join(f", {c} binary" for c in sizes))
    return state.select("tx", "ty", "band", *kept).join(weights, ["tx", "ty"])
