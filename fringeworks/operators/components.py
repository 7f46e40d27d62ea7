"""Models of images as tables of coefficients over time and frequency.

A model is a table (x, y, kt, kf, coeff, t_mid, t_half, f_mid, f_half): the pixel's
coefficient of the product of two Legendre polynomials, of degree kt in
(time - t_mid) / t_half and kf in (freq - f_mid) / f_half.  The ranges travel with
the rows, so a stored model can be evaluated anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = ["x", "y", "kt", "kf", "coeff", "t_mid", "t_half", "f_mid", "f_half"]


def _range(values: list[float]) -> tuple[float, float]:
    lo, hi = min(values), max(values)
    return (lo + hi) / 2, (hi - lo) / 2 or 1.0


def fit_model(cube: DataFrame, samples: list[tuple[float, float, float]], orders: tuple[int, int], ridge: float = 0.0) -> DataFrame:
    """Least-squares model of each pixel of (x, y, sample, value).

    samples: (time, freq, weight) of each sample number, one for each image, so
    the matrix of the fit is small and the same for all pixels.  orders: how many
    polynomials of time and of frequency.  Samples that a pixel lacks count as 0.
    """
    (t, f, w), (nt, nf) = (list(c) for c in zip(*samples, strict=True)), orders
    (tm, th), (fm, fh) = _range(t), _range(f)
    basis = lambda v, mid, half, n: np.polynomial.legendre.legvander((np.array(v) - mid) / half, n - 1)
    x = (basis(t, tm, th, nt)[:, :, None] * basis(f, fm, fh, nf)[:, None, :]).reshape(len(samples), -1)
    solve = np.linalg.solve(x.T @ (np.array(w)[:, None] * x) + ridge * np.eye(nt * nf), x.T * np.array(w))
    at = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in solve))
    sums = [F.struct(F.lit(k // nf).alias("kt"), F.lit(k % nf).alias("kf"), F.sum(F.col("value") * F.get(F.get(at, F.lit(k)), F.col("sample").cast("int"))).alias("coeff")) for k in range(nt * nf)]
    rows = cube.groupBy("x", "y").agg(F.array(*sums).alias("c")).select("x", "y", F.explode("c").alias("c")).select("x", "y", "c.*")
    return rows.select("*", *(F.lit(float(v)).alias(n) for n, v in (("t_mid", tm), ("t_half", th), ("f_mid", fm), ("f_half", fh))))


def _legendre(u: Column, most: int) -> Column:
    p = [F.lit(1.0), u]
    for k in range(1, most):
        p.append(((2 * k + 1) * u * p[k] - k * p[k - 1]) / (k + 1))
    return F.array(*p[: most + 1])


def evaluate_model(model: DataFrame, points: list[tuple[float, float]], most: int = 8) -> DataFrame:
    """(x, y, time, freq, value) at each of the named (time, freq); degrees above ``most`` are an error."""
    where = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("time"), F.lit(float(f)).alias("freq")) for t, f in points)))
    rows = model.select(*MODEL, where.alias("at")).select(*MODEL, "at.time", "at.freq")
    at = lambda c, k, mid, half: F.element_at(_legendre((F.col(c) - F.col(mid)) / F.col(half), most), F.col(k) + 1)
    degree = F.greatest("kt", "kf")
    value = F.when(degree <= most, F.col("coeff") * at("time", "kt", "t_mid", "t_half") * at("freq", "kf", "f_mid", "f_half")).otherwise(F.raise_error(F.lit(f"degree above {most}")).cast("double"))
    return rows.groupBy("x", "y", "time", "freq").agg(F.sum(value).alias("value"))


def write_model(model: DataFrame, path: str, overwrite: bool = False, form: str = "parquet") -> None:
    """Sink of a model as Parquet or JSON; refuses to overwrite unless told to."""
    model.select(*MODEL).write.mode("overwrite" if overwrite else "errorifexists").format(form).save(path)


def read_model(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    schema = "x int, y int, kt int, kf int, coeff double, t_mid double, t_half double, f_mid double, f_half double"
    return spark.read.schema(schema).format(form).load(path)


def union_of_models(models: list[DataFrame]) -> DataFrame:
    """One model of several over the same ranges: coefficients of the same pixel and degrees are added."""
    out = models[0].select(*MODEL)
    for m in models[1:]:
        out = out.unionByName(m.select(*MODEL))
    return out.groupBy(*(c for c in MODEL if c != "coeff")).agg(F.sum("coeff").alias("coeff")).select(*MODEL)
