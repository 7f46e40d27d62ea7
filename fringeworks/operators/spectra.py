"""Non-linear fits along frequency, a series at a time within one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Damped steps of a fit, and the share of the data's norm under which a slope counts as none.
ROUNDS, FLAT = 40, 1e-7


def power_laws(series: DataFrame, keys: list[str], freq0: float, rounds: int = ROUNDS, start: float = -0.7) -> DataFrame:
    """Rows (keys, amplitude, slope, amplitude_var, slope_var, chi2, n, converged): weighted fits of amplitude * (freq / freq0) ** slope.

    series: keys, freq, value, weight.  Values need not be positive, as those of
    a fit of logarithms must.  Samples with a null or NaN, without weight or without a
    positive frequency do not count; a key with fewer than two frequencies left has nulls.
    Damped Gauss-Newton steps begin at ``start`` and its best amplitude: one that
    does not lower chi2 is not taken, and the next is shorter.  A key's samples, one for
    each channel, are an array, so all keys are fitted in one shuffle and without Python.
    """
    known = series.select(*keys, *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in ("freq", "value", "weight")))
    sample = F.struct((F.col("freq") / freq0).alias("t"), F.col("value").alias("v"), F.col("weight").alias("w"))
    good = F.col("freq").isNotNull() & F.col("value").isNotNull() & (F.col("weight") > 0) & (F.col("freq") > 0)
    # in the order of frequencies, so that sums do not depend on how rows arrive
    rows = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(good, sample))).alias("_s"))
    s = F.col("_s")
    enough = F.size(F.array_distinct(F.transform(s, lambda p: p["t"]))) > 1

    def total(term) -> Column:
        return F.aggregate(s, F.lit(0.0), lambda acc, p: acc + p["w"] * term(p))

    def sums(a: Column, slope: Column) -> Column:
        """Sums of the normal equations, and chi2, in one pass over the samples."""

        def add(acc: Column, p: Column) -> Column:
            shape, log = F.pow(p["t"], slope), F.log(p["t"])
            off, lean = p["v"] - a * shape, a * shape * log
            terms = {"aa": shape * shape, "as": shape * lean, "ss": lean * lean, "ga": shape * off, "gs": lean * off, "chi2": off * off}
            return F.struct(*((acc[k] + p["w"] * v).alias(k) for k, v in terms.items()))

        return F.aggregate(s, F.struct(*(F.lit(0.0).alias(k) for k in ("aa", "as", "ss", "ga", "gs", "chi2"))), add)

    def moved(state: Column, _: Column) -> Column:
        n, keep = state["n"], 1 + state["damp"]
        det = n["aa"] * keep * n["ss"] * keep - n["as"] * n["as"]
        a = state["a"] + F.coalesce((n["ss"] * keep * n["ga"] - n["as"] * n["gs"]) / F.nullif(det, F.lit(0.0)), F.lit(0.0))
        slope = state["s"] + F.coalesce((n["aa"] * keep * n["gs"] - n["as"] * n["ga"]) / F.nullif(det, F.lit(0.0)), F.lit(0.0))
        # a struct in an array of one is computed once and named
        tried = F.transform(F.array(F.struct(a.alias("a"), slope.alias("s"))), lambda p: F.struct(p["a"].alias("a"), p["s"].alias("s"), sums(p["a"], p["s"]).alias("n")))
        taken = F.transform(tried, lambda p: F.when(
            p["n"]["chi2"] < n["chi2"], F.struct(p["a"].alias("a"), p["s"].alias("s"), (state["damp"] * 0.1).alias("damp"), p["n"].alias("n"))
        ).otherwise(F.struct(state["a"].alias("a"), state["s"].alias("s"), (F.greatest(state["damp"], F.lit(1e-9)) * 10).alias("damp"), n.alias("n"))))
        return taken[0]

    a0 = total(lambda p: F.pow(p["t"], F.lit(start)) * p["v"]) / total(lambda p: F.pow(p["t"], F.lit(2 * start)))
    begun = rows.withColumn("_a", F.when(enough, a0)).withColumn("_n", sums(F.col("_a"), F.lit(start)))
    state = F.struct(F.col("_a").alias("a"), F.lit(start).alias("s"), F.lit(1e-3).alias("damp"), F.col("_n").alias("n"))
    fitted = begun.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, moved)).withColumn("_v", total(lambda p: p["v"] * p["v"]))
    n = F.col("_f.n")
    det = F.nullif(n["aa"] * n["ss"] - n["as"] * n["as"], F.lit(0.0))
    flat = (F.abs(n["ga"]) <= FLAT * F.sqrt(F.col("_v") * n["aa"])) & (F.abs(n["gs"]) <= FLAT * F.sqrt(F.col("_v") * n["ss"]))
    out = {"amplitude": F.col("_f.a"), "slope": F.col("_f.s"), "amplitude_var": n["ss"] / det, "slope_var": n["aa"] / det, "chi2": n["chi2"]}
    return fitted.select(*keys, *(F.when(enough, v).alias(c) for c, v in out.items()), F.size("_s").cast("long").alias("n"), F.coalesce(enough & flat, F.lit(False)).alias("converged"))
