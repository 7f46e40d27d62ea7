"""Gain-corrected Stokes visibilities and their weights.

A sample is a row with its four correlations as columns c00 c01 c10 c11 (each
``_re`` and ``_im``: XX XY YX YY, or RR RL LR LL) and weights w00 w01 w10 w11.
Gains are a table by (time bin, channel, antenna) with the elements g00 ... g11
of a Jones matrix; without ``full`` only g00 and g11 are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Complex, abs2, cdiv, cmul, conj

#: What each feed's Stokes parameters are made of: the sum or the difference of the parallel or the crossed hands.
HANDS = {
    "linear": {"I": ("parallel", 1), "Q": ("parallel", -1), "U": ("crossed", 1), "V": ("crossed", -1)},
    "circular": {"I": ("parallel", 1), "V": ("parallel", -1), "Q": ("crossed", 1), "U": ("crossed", -1)},
}
ELEMENTS = ("00", "01", "10", "11")


def wanted(product: str, feed: str, n_corr: int, mode: str, full: bool) -> list[str]:
    """The Stokes parameters of ``product`` in the order I, Q, U, V; ValueError for what cannot be had.

    Two correlations are the parallel hands, so they give I and Q of linear and
    I and V of circular feeds.  Minimum-variance weights need diagonal gains, and
    full matrices need all four correlations.
    """
    if feed not in HANDS:
        raise ValueError(f"no feed {feed}")
    if mode not in ("l2", "minvar"):
        raise ValueError(f"no weights {mode}")
    if n_corr not in (2, 4):
        raise ValueError(f"two or four correlations are needed, not {n_corr}")
    if not product or set(product) - set("IQUV"):
        raise ValueError(f"no product {product}")
    if full and (n_corr != 4 or mode == "minvar"):
        raise ValueError("full gains need four correlations and l2 weights")
    out = [s for s in "IQUV" if s in product]
    lacking = [s for s in out if n_corr == 2 and HANDS[feed][s][0] == "crossed"]
    if lacking:
        raise ValueError(f"{', '.join(lacking)} of {feed} feeds needs four correlations")
    return out


def with_gains(vis: DataFrame, gains: DataFrame, keys: list[str]) -> DataFrame:
    """Both antennas' gains beside each sample, as p00 ... and q00 ...; null where the table has none.

    The joins are on all of (keys, antenna), so they spread over as many tasks as
    there are time bins, channels and antennas, whatever their sizes.
    """
    parts = [c for c in gains.columns if c not in keys and c != "ant"]
    for ant, side in (("ant1", "p"), ("ant2", "q")):
        named = gains.select(*keys, F.col("ant").alias(ant), *(F.col(c).alias(side + c[1:]) for c in parts))
        vis = vis.join(named, [*keys, ant], "left")
    return vis


def _pair(name: str) -> Complex:
    return F.col(f"{name}_re"), F.col(f"{name}_im")


def _add(a: Complex, b: Complex, sign: int = 1) -> Complex:
    return a[0] + sign * b[0], a[1] + sign * b[1]


def _corrected(full: bool) -> dict[str, Complex]:
    """Elements of the inverse of p, the sample, and the inverse of q's conjugate transpose, in this order."""
    if not full:
        return {e: cdiv(_pair(f"c{e}"), cmul(_pair(f"p{e[0] * 2}"), conj(_pair(f"q{e[1] * 2}")))) for e in ELEMENTS}
    left = {}  # the adjugate of p, times the sample
    for j in "01":
        left["0" + j] = _add(cmul(_pair("p11"), _pair(f"c0{j}")), cmul(_pair("p01"), _pair(f"c1{j}")), -1)
        left["1" + j] = _add(cmul(_pair("p00"), _pair(f"c1{j}")), cmul(_pair("p10"), _pair(f"c0{j}")), -1)
    out = {}  # that, times the adjugate of q's conjugate transpose
    for i in "01":
        out[i + "0"] = _add(cmul(left[i + "0"], conj(_pair("q11"))), cmul(left[i + "1"], conj(_pair("q01"))), -1)
        out[i + "1"] = _add(cmul(left[i + "1"], conj(_pair("q00"))), cmul(left[i + "0"], conj(_pair("q10"))), -1)
    size = lambda s: _add(cmul(_pair(f"{s}00"), _pair(f"{s}11")), cmul(_pair(f"{s}01"), _pair(f"{s}10")), -1)
    both = cmul(size("p"), conj(size("q")))
    return {e: cdiv(v, both) for e, v in out.items()}


def _weight(hands: str, sign: int, mode: str, full: bool) -> Column:
    """What a unit of the parameter does to each correlation, squared, times its weight; or four over the sum of the variances."""
    if full:
        total = F.lit(0.0)
        for i, j in ELEMENTS:
            a, b = ("00", "11") if hands == "parallel" else ("01", "10")
            one = cmul(_pair(f"p{i}{a[0]}"), conj(_pair(f"q{j}{a[1]}")))
            two = cmul(_pair(f"p{i}{b[0]}"), conj(_pair(f"q{j}{b[1]}")))
            total = total + F.col(f"w{i}{j}") * abs2(_add(one, two, sign))
        return total
    a, b = (F.col(f"w{e}") * abs2(_pair(f"p{e[0] * 2}")) * abs2(_pair(f"q{e[1] * 2}")) for e in (("00", "11") if hands == "parallel" else ("01", "10")))
    return a + b if mode == "l2" else F.coalesce(4 * a * b / F.nullif(a + b, F.lit(0.0)), F.lit(0.0))


def stokes_products(vis: DataFrame, gains: DataFrame, product: str, keys: list[str], feed: str = "linear", n_corr: int = 4, mode: str = "l2", full: bool = False) -> DataFrame:
    """The samples with ``<s>_re``, ``<s>_im`` and ``w_<s>`` for each parameter s of ``product``.

    Flagged samples, and samples whose gains are missing or have no inverse, get
    values and weights of 0; ``sources.check_alignment`` finds missing gains
    beforehand.  Crossed hands may be absent if ``n_corr`` is 2.
    """
    stokes = wanted(product, feed, n_corr, mode, full)
    rest = [c for c in vis.columns if c[0] not in "cw" or c[1:3] not in ELEMENTS]
    joined = with_gains(vis, gains, keys)
    if n_corr == 2:
        joined = joined.withColumns({f"{c}{e}{p}": F.lit(0.0) for e in ("01", "10") for c, p in (("c", "_re"), ("c", "_im"), ("w", ""))})
    fixed = joined.withColumns({f"d{e}_{p}": v for e, pair in _corrected(full).items() if n_corr == 4 or e in ("00", "11") for p, v in zip(("re", "im"), pair, strict=True)})
    out = {}
    for s in stokes:
        hands, sign = HANDS[feed][s]
        re, im = _add(*(map(_pair, ("d00", "d11") if hands == "parallel" else ("d01", "d10"))), sign)
        if (hands, sign) == ("crossed", -1):  # the difference is 2i times the parameter
            re, im = im, -re
        w = _weight(hands, sign, mode, full)
        good = ~F.col("flag") & re.isNotNull() & w.isNotNull()
        out |= {f"{s.lower()}_re": F.when(good, re / 2).otherwise(0.0), f"{s.lower()}_im": F.when(good, im / 2).otherwise(0.0), f"w_{s.lower()}": F.when(good, w).otherwise(0.0)}
    return fixed.select(*rest, *(v.alias(k) for k, v in out.items()))


def single_correlation(vis: DataFrame, gains: DataFrame, keys: list[str], element: str = "00") -> DataFrame:
    """One correlation as its own product, with diagonal gains: ``re``, ``im``, ``w``; 0 where flagged or without gains."""
    joined = with_gains(vis, gains, keys)
    p, q = _pair(f"p{element[0] * 2}"), _pair(f"q{element[1] * 2}")
    re, im = cdiv(_pair(f"c{element}"), cmul(p, conj(q)))
    good = ~F.col("flag") & re.isNotNull()
    rest = [c for c in vis.columns if c[0] not in "cw" or c[1:3] not in ELEMENTS]
    return joined.select(*rest, *(F.when(good, v).otherwise(0.0).alias(k) for k, v in (("re", re), ("im", im), ("w", F.col(f"w{element}") * abs2(p) * abs2(q)))))
