"""Hessians summed over the partitions of a band, each with a kernel and a beam of its own.

A partition is a set of samples with one pointing: its kernel is its PSF, not
normalised, whose centre is its sum of weights.  The operator is

    x -> sum over p of beam_p * (psf_p conv (beam_p * x)) / (sum of weights) + eta * x

and ``tiles.solve``, ``nnls``, ``fista``, ``forward_backward`` and
``spectral_norms`` take it like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored
from .tiles import TILE, Blocks, Kernel, Spread, columns_of, opened, pack, transformed

WHOSE = ("band", "part")


@dataclass
class PartKernel(Kernel):
    """Kernels and beams of all partitions in tiles, stored once."""

    beams: DataFrame

    @staticmethod
    def of(psfs: DataFrame, beams: DataFrame, images: DataFrame, tile: int = TILE, over: str = "band") -> PartKernel:
        """psfs: band, part, dx, dy, value.  beams: band, part, x, y, beam; pixels without one count as 0.  images: those that are to meet them.

        over: "band" divides by a band's sum of weights, "all" by that of all bands.
        A partition whose band has no images is left out; one without a beam is an
        error, and so is a band whose weights sum to nothing.
        """
        if over not in ("band", "all"):
            raise ValueError(f"over is band or all, not {over!r}")
        bands = images.select(F.col("band").cast("int")).distinct()
        psfs = psfs.join(bands, "band", "left_semi")
        weights = stored(psfs.filter("dx = 0 AND dy = 0").groupBy(*WHOSE).agg(F.sum("value").alias("wsum")), "weights")  # a row for each partition
        bare = weights.join(beams.select(*WHOSE).distinct(), list(WHOSE), "left_anti").first()
        if bare:
            raise ValueError(f"partition {bare['part']} of band {bare['band']} has no beam")
        if over == "band":
            scaled = psfs.join(weights.groupBy("band").agg(F.sum("wsum").alias("total")), "band")
        else:
            scaled = psfs.crossJoin(F.broadcast(weights.agg(F.sum("wsum").alias("total"))))  # one row
        if weights.groupBy(*(["band"] if over == "band" else [])).agg(F.sum("wsum").alias("s")).filter("s IS NULL OR s <= 0").first() and weights.first():
            raise ValueError("a band without weight has no Hessian")
        kernels = transformed(scaled.withColumn("value", F.col("value") / F.col("total")), tile, WHOSE)
        spread = stored(stored(kernels, "kernel").withColumn("tx", F.explode(columns_of(images, tile))), "kernel")
        lit = beams.join(weights, list(WHOSE), "left_semi")
        return PartKernel(spread, tile, stored(pack(lit, ["beam"], tile=tile, by=WHOSE).drop("inside"), "beams"))

    def met(self, tiles: DataFrame, held: list[str], before: Callable[[int, Blocks], np.ndarray]) -> DataFrame:
        """As of one kernel, with what each partition sees brought together under its beam.

        A tile goes to its partitions as one block, whatever it holds.  Sums of a tile
        and partition meet their beam in one shuffle; no task holds more than one of them.
        """
        tile = self.tile
        whole, one = "tx int, ty int, band int, part int, ", "tx int, ty int, band int, "

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = [before(band, opened(held, values, tile)) for band, *values in zip(*(c.to_pylist() for c in batch.columns[2:]))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([b.tobytes() for b in blocks], pa.binary())], names=["tx", "ty", "band", "image"])

        def lit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = [(np.frombuffer(i) * np.frombuffer(b)).tobytes() for i, b in zip(*(c.to_pylist() for c in batch.columns[4:]))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blocks, pa.binary())], names=["tx", "ty", *WHOSE, "image"])

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, last, image = Spread(tile), None, None

            def handed() -> pa.RecordBatch:
                keys, blocks = total.taken()
                return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(4)), pa.array(blocks, pa.binary())], names=["tx", "ty", *WHOSE, "seen"])

            for batch in batches:
                for tx, ty, band, part, block, kx, ky, hat in zip(*(c.to_pylist() for c in batch.columns)):
                    if (tx, ty, band, part) != last:
                        last, image = (tx, ty, band, part), total.transform(np.frombuffer(block).reshape(tile, tile))
                    total.add(image, hat, tx + kx, ty + ky, (band, part))
                    if total.full:
                        yield handed()
            if not total.empty:
                yield handed()

        def through(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, beam = None, None
            for batch in batches:
                for part, b in zip(*(c.to_pylist() for c in batch.columns[4:])):
                    if b is not None:
                        beam = np.frombuffer(b)
                    else:
                        seen = np.frombuffer(part) + (0.0 if seen is None else seen)
            known = seen is not None and beam is not None  # beyond the beam nothing is seen
            rows = [[k.as_py()] for k in key[:3]] + [[(beam * seen).tobytes()]] if known else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in rows[:3]), pa.array(rows[3], pa.binary())], names=["tx", "ty", "band", "seen"])

        images = tiles.select("tx", "ty", "band", *held).mapInArrow(asked, one + "image binary")
        under = images.join(self.beams, ["tx", "ty", "band"]).select("tx", "ty", *WHOSE, "image", "beam").mapInArrow(lit, whole + "image binary")
        pairs = under.join(self.tiles, ["band", "part", "tx"]).select("tx", "ty", *WHOSE, "image", "kx", "ky", "hat")
        sums = pairs.mapInArrow(multiply, whole + "seen binary").unionByName(self.beams, allowMissingColumns=True).select("tx", "ty", *WHOSE, "seen", "beam")
        seen = sums.groupBy("tx", "ty", *WHOSE).applyInArrow(through, one + "seen binary")
        return tiles.select("tx", "ty", "band", *held).unionByName(seen, allowMissingColumns=True).select("tx", "ty", "band", *held, "seen")
