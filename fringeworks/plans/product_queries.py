"""Queries on gain-corrected Stokes products, wavelets, stored models and the bookkeeping of tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import C, periodic, shrunk, spectrum, stokes_of_logarithm
from ..operators import bookkeeping, components, products, visibility, wavelets
from ..sources import VIS_SQL, cube_of, read, vis_of
from .image_queries import BANDS, BXY, CUBE_SQL, FREQS, bands_of
from .registry import query, rounded
from .vis_queries import BT, PHASE, PIVOT, _pairs, band_time, pivoted

W = f"WITH {VIS_SQL}"
ELEMENTS = products.ELEMENTS
CORRS = dict(zip(ELEMENTS, ("xx", "xy", "yx", "yy"), strict=True))
KEYS = ["scan", "ant1", "ant2", "chan"]

# Samples and gains -----------------------------------------------------------

#: Gains by scan (as the time bin), channel and antenna; those of antenna 15 in scan 4 are missing.
_BASE = "base AS (SELECT CAST(p_partkey % 16 AS INT) AS ant, avg(0.8e0 + p_retailprice / 5000) AS a, avg((p_size - 25) / 200e0) AS b FROM part GROUP BY 1)"
_JONES = {"00_re": "a * k", "00_im": "b", "01_re": "b / 10", "01_im": "0.02e0", "10_re": "-0.03e0", "10_im": "b / 5", "11_re": "1.1e0 - a / 4", "11_im": "-b * k"}
JONES = f"""{_BASE}, jones AS (SELECT CAST(t.i AS INT) AS scan, CAST(c.i AS INT) AS chan, ant, 1 + 0.01e0 * t.i + 0.02e0 * c.i AS k, {", ".join(f"{v} AS g{e}" for e, v in _JONES.items())}
    FROM base, range(5) t(i), range(1, 8) c(i) WHERE NOT (ant = 15 AND t.i = 4))"""
_SUMS = ", ".join(f"coalesce(sum(weight * {p}) FILTER (corr = '{c.upper()}') / sum(weight) FILTER (corr = '{c.upper()}'), 0) AS c{e}_{p}" for e, c in CORRS.items() for p in ("re", "im"))
_SUMS += ", " + ", ".join(f"coalesce(sum(weight) FILTER (corr = '{c.upper()}'), 1) AS w{e}" for e, c in CORRS.items())
_SIDES = ", ".join(f"{s}.g{e} AS {s}{e}" for s in "pq" for e in _JONES)
SAMPLES = f"""{W}, {JONES}, samples AS (SELECT scan, ant1, ant2, chan, ant1 = ant2 AS flag, {_SUMS} FROM vis GROUP BY ALL),
    met AS (SELECT s.*, {_SIDES} FROM samples s LEFT JOIN jones p ON p.scan = s.scan AND p.chan = s.chan AND p.ant = s.ant1 LEFT JOIN jones q ON q.scan = s.scan AND q.chan = s.chan AND q.ant = s.ant2)"""


def samples_of(spark, sf_dir) -> DataFrame:
    """Weighted means of each baseline's correlations in a scan and channel; autocorrelations are flagged."""
    pivot = visibility.by_correlation(vis_of(spark, sf_dir), KEYS)
    return pivot.select(*KEYS, visibility.row_flag().alias("flag"), *(F.col(f"{c}_{p}").alias(f"c{e}_{p}") for e, c in CORRS.items() for p in ("re", "im")), *(F.col(f"w_{c}").alias(f"w{e}") for e, c in CORRS.items()))


def jones_of(spark, sf_dir) -> DataFrame:
    base = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 16).cast("int").alias("ant")).agg(F.avg(0.8 + F.col("p_retailprice") / 5000).alias("a"), F.avg((F.col("p_size") - 25) / 200.0).alias("b"))
    steps = base.withColumn("scan", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("chan", F.explode(F.sequence(F.lit(1), F.lit(7))))
    k = 1 + 0.01 * F.col("scan") + 0.02 * F.col("chan")
    a, b = F.col("a"), F.col("b")
    parts = {"g00_re": a * k, "g00_im": b, "g01_re": b / 10, "g01_im": F.lit(0.02), "g10_re": F.lit(-0.03), "g10_im": b / 5, "g11_re": 1.1 - a / 4, "g11_im": -b * k}
    return steps.filter("NOT (ant = 15 AND scan = 4)").select("scan", "chan", "ant", *(v.alias(n) for n, v in parts.items()))


# The SQL inverts the matrices and multiplies by the matrices of the Stokes parameters, term by term.


def _mul(*pairs: tuple[str, str]) -> tuple[str, str]:
    out = pairs[0]
    for b in pairs[1:]:
        out = (f"({out[0]} * {b[0]} - {out[1]} * {b[1]})", f"({out[0]} * {b[1]} + {out[1]} * {b[0]})")
    return out


def _sum(*pairs: tuple[str, str]) -> tuple[str, str]:
    return tuple("(" + " + ".join(p[i] for p in pairs) + ")" for i in (0, 1))


def _named(s: str) -> tuple[str, str]:
    return f"{s}_re", f"{s}_im"


def _conj(a: tuple[str, str]) -> tuple[str, str]:
    return a[0], f"(-{a[1]})"


def _stokes_sql(product: str, feed: str, mode: str, full: bool) -> str:
    """Stokes matrices as numbers, inverses as columns."""
    unit = {"I": {"00": (1, 0), "11": (1, 0)}, "parallel": {"00": (1, 0), "11": (-1, 0)}, "plus": {"01": (1, 0), "10": (1, 0)}, "i": {"01": (0, 1), "10": (0, -1)}}
    of = {"linear": {"I": "I", "Q": "parallel", "U": "plus", "V": "i"}, "circular": {"I": "I", "V": "parallel", "Q": "plus", "U": "i"}}[feed]
    inverses = []
    for s in "pq":
        if full:
            det = _sum(_mul(_named(f"{s}00"), _named(f"{s}11")), _mul(("-1e0", "0e0"), _named(f"{s}01"), _named(f"{s}10")))
            cells = {"00": _named(f"{s}11"), "11": _named(f"{s}00"), "01": _mul(("-1e0", "0e0"), _named(f"{s}01")), "10": _mul(("-1e0", "0e0"), _named(f"{s}10"))}
        else:
            det, cells = None, {e: ("1e0", "0e0") if e in ("00", "11") else ("0e0", "0e0") for e in ELEMENTS}
        for e, v in cells.items():
            below = det or _named(f"{s}{e[0] * 2}")
            top = _mul(v, _conj(below))
            inverses += [f"{t} / ({below[0]} * {below[0]} + {below[1]} * {below[1]}) AS i{s}{e}_{part}" for t, part in zip(top, ("re", "im"), strict=True)]
    fixed = []
    for i, j in ELEMENTS:
        d = _sum(*(_mul(_named(f"ip{i}{a}"), _named(f"c{a}{b}"), _conj(_named(f"iq{j}{b}"))) for a in "01" for b in "01"))
        fixed += [f"{v} AS d{i}{j}_{p}" for v, p in zip(d, ("re", "im"), strict=True)]
    out = []
    for s in product:
        matrix = unit[of[s]]
        # half the conjugate of each cell times the corrected sample
        value = _sum(*(_mul((f"{m[0] / 2!r}", f"{-m[1] / 2!r}"), _named(f"d{e}")) for e, m in matrix.items()))
        weights = []
        for i, j in ELEMENTS:
            terms = [_mul((f"{float(m[0])!r}", f"{float(m[1])!r}"), _named(f"p{i}{e[0]}"), _conj(_named(f"q{j}{e[1]}"))) for e, m in matrix.items() if full or e == i + j]
            if terms:
                t = _sum(*terms)
                weights.append(f"w{i}{j} * (pow({t[0]}, 2) + pow({t[1]}, 2))")
        weight = " + ".join(weights) if mode == "l2" else "4 / (" + " + ".join(f"1 / ({w})" for w in weights) + ")"
        for v, name in (value[0], f"{s.lower()}_re"), (value[1], f"{s.lower()}_im"), (weight, f"w_{s.lower()}"):
            out.append(f"round(CASE WHEN flag OR p00_re IS NULL OR q00_re IS NULL THEN 0 ELSE {v} END, 6) + 0 AS {name}")
    return f"{SAMPLES}, inv AS (SELECT *, {', '.join(inverses)} FROM met), fixed AS (SELECT *, {', '.join(fixed)} FROM inv) SELECT scan, ant1, ant2, chan, flag, {', '.join(out)} FROM fixed"


def _stokes_query(name: str, product: str, feed: str = "linear", mode: str = "l2", full: bool = False) -> None:
    def run(spark, sf_dir):
        out = products.stokes_products(samples_of(spark, sf_dir), jones_of(spark, sf_dir), product, ["scan", "chan"], feed, 4, mode, full)
        return rounded(out, *KEYS, "flag")

    run.__name__ = name
    query(_stokes_sql(product, feed, mode, full))(run)


_stokes_query("stokes_product_diagonal", "IQUV")
_stokes_query("stokes_product_circular", "IQUV", feed="circular")
_stokes_query("stokes_product_minvar", "IQUV", mode="minvar")
_stokes_query("stokes_product_full_jones", "IQUV", full=True)
_stokes_query("stokes_product_full_jones_circular", "IQUV", feed="circular", full=True)


@query(f"""{SAMPLES} SELECT scan, ant1, ant2, chan, flag, round(CASE WHEN flag OR p00_re IS NULL OR q00_re IS NULL THEN 0 ELSE (c00_re * a + c00_im * b) / (a * a + b * b) END, 6) + 0 AS re,
    round(CASE WHEN flag OR p00_re IS NULL OR q00_re IS NULL THEN 0 ELSE (c00_im * a - c00_re * b) / (a * a + b * b) END, 6) + 0 AS im,
    round(CASE WHEN flag OR p00_re IS NULL OR q00_re IS NULL THEN 0 ELSE w00 * (a * a + b * b) END, 6) + 0 AS w
    FROM (SELECT *, p00_re * q00_re + p00_im * q00_im AS a, p00_im * q00_re - p00_re * q00_im AS b FROM met)""")
def single_correlation_product(spark, sf_dir):
    return rounded(products.single_correlation(samples_of(spark, sf_dir), jones_of(spark, sf_dir), ["scan", "chan"]), *KEYS, "flag")


# Bookkeeping -----------------------------------------------------------------


@query(f"{W} SELECT row_id, u, v FROM vis WHERE ant1 <> 7")
def finite_uvw_rows(spark, sf_dir):
    """Rows whose uvw is set; antenna 7's is NaN, as padding is."""
    vis = vis_of(spark, sf_dir).withColumn("u", F.when(F.col("ant1") == 7, float("nan")).otherwise(F.col("u")))
    return bookkeeping.finite_uvw(vis).select("row_id", "u", "v")


@query(f"{W} SELECT ant, count(*) AS samples FROM (SELECT ant1 AS ant FROM vis UNION ALL SELECT ant2 FROM vis) WHERE ant NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey % 3 > 0) GROUP BY ant")
def antennas_not_in_table(spark, sf_dir):
    table = read(spark, sf_dir, "supplier").filter("s_nationkey % 3 > 0").select(F.col("s_nationkey").alias("ant"))
    return bookkeeping.missing_antennas(vis_of(spark, sf_dir), table)


@query(f"""{W}, windows AS (SELECT CAST(r_regionkey AS INT) AS ddid, 1e9 + 5e7 * r_regionkey AS ref_freq FROM region WHERE r_regionkey < 2),
    fields AS (SELECT CAST(n_nationkey % 4 AS INT) AS field_id, avg(n_nationkey / 10e0) AS ra, avg(n_regionkey / 10e0 - 0.2e0) AS dec FROM nation GROUP BY 1)
    SELECT ddid, field_id, any_value(ref_freq) AS ref_freq, round(any_value(ra), 6) + 0 AS ra, round(any_value(dec), 6) + 0 AS dec, count(*) AS samples FROM vis LEFT JOIN windows USING (ddid) LEFT JOIN fields USING (field_id) GROUP BY ddid, field_id""")
def dimension_join(spark, sf_dir):
    windows = read(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.col("r_regionkey").cast("int").alias("ddid"), (1e9 + 5e7 * F.col("r_regionkey")).alias("ref_freq"))
    fields = read(spark, sf_dir, "nation").groupBy((F.col("n_nationkey") % 4).cast("int").alias("field_id")).agg(F.avg(F.col("n_nationkey") / 10.0).alias("ra"), F.avg(F.col("n_regionkey") / 10.0 - 0.2).alias("dec"))
    joined = bookkeeping.with_frames(vis_of(spark, sf_dir), windows, fields)
    return rounded(joined.groupBy("ddid", "field_id").agg(F.any_value("ref_freq").alias("ref_freq"), F.any_value("ra").alias("ra"), F.any_value("dec").alias("dec"), F.count("*").alias("samples")), "ddid", "field_id", "ref_freq", "samples")


@query("""WITH n AS (SELECT n_name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS station FROM (SELECT DISTINCT n_name FROM nation))
    SELECT s_suppkey, station FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN n USING (n_name)""")
def station_numbers(spark, sf_dir):
    """Suppliers' nations, as names of stations, by number."""
    nation = read(spark, sf_dir, "nation")
    named = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("station"))
    return bookkeeping.by_number(named, nation.select(F.col("n_name").alias("name")), ["station"])


_DENSE = "used AS (SELECT ant, CAST(row_number() OVER (ORDER BY ant) - 1 AS INT) AS i FROM (SELECT ant1 AS ant FROM odd UNION SELECT ant2 FROM odd))"


@query(f"{W}, odd AS (SELECT row_id, ant1 * 2 + 1 AS ant1, ant2 * 2 + 1 AS ant2 FROM vis), {_DENSE} SELECT row_id, p.i AS ant1, q.i AS ant2 FROM odd JOIN used p ON p.ant = ant1 JOIN used q ON q.ant = ant2")
def antenna_relabel(spark, sf_dir):
    odd = vis_of(spark, sf_dir).select("row_id", (F.col("ant1") * 2 + 1).alias("ant1"), (F.col("ant2") * 2 + 1).alias("ant2"))
    return bookkeeping.relabelled(odd, visibility.dense_antennas(odd)).select("row_id", "ant1", "ant2")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (falls) AS falls FROM (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS falls FROM events) GROUP BY user_id")
def descents_in_order(spark, sf_dir):
    return bookkeeping.descents(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")


@query(f"""{W}, e AS (SELECT field_id, ddid, scan, array_to_string(list_sort(list(DISTINCT freq)), ',') AS f, count(*) AS n FROM vis GROUP BY ALL)
    SELECT field_id, ddid, count(*) AS pieces, CAST(sum(n) AS BIGINT) AS samples, count(DISTINCT f) = 1 AS aligned FROM e GROUP BY field_id, ddid""")
def aligned_spectra(spark, sf_dir):
    return bookkeeping.spectra(vis_of(spark, sf_dir), ["field_id", "ddid"], ["scan"])


@query(f"{BT} SELECT band_id, field_id, scan, CAST(row_number() OVER (PARTITION BY band_id ORDER BY field_id, scan) - 1 AS INT) AS part FROM (SELECT DISTINCT band_id, field_id, scan FROM bt)")
def partition_numbers(spark, sf_dir):
    return bookkeeping.part_ids(band_time(vis_of(spark, sf_dir)), ["band_id"], ["field_id", "scan"])


@query(f"{BT} SELECT band_id, round(sum(freq * weight) / sum(weight), 3) AS freq, round(sum(weight), 6) AS weight FROM bt WHERE NOT flag GROUP BY band_id")
def mfs_frequency(spark, sf_dir):
    """Weighted mean frequency of each band."""
    out = bookkeeping.weighted_mean(band_time(vis_of(spark, sf_dir)).filter("NOT flag"), ["band_id"], "freq")
    return out.select("band_id", F.round("freq", 3).alias("freq"), F.round("weight", 6).alias("weight"))


@query(f"{BT} SELECT band_id, time_id, round(sum(CASE WHEN flag OR corr = 'XX' THEN 0 ELSE weight END), 6) AS wsum FROM bt GROUP BY ALL HAVING sum(CASE WHEN flag OR corr = 'XX' THEN 0 ELSE weight END) > 0")
def bands_with_weight(spark, sf_dir):
    sums = band_time(vis_of(spark, sf_dir)).groupBy("band_id", "time_id").agg(F.sum(F.when(F.col("flag") | (F.col("corr") == "XX"), 0.0).otherwise(F.col("weight"))).alias("wsum"))
    return rounded(bookkeeping.with_weight(sums), "band_id", "time_id")


@query(f"{BANDS} SELECT x, y, bool_or(CASE WHEN band % 2 = 0 THEN value > 0.05e0 ELSE value < -0.05e0 END) AS mask FROM bands GROUP BY x, y")
def mask_union(spark, sf_dir):
    b = bands_of(spark, sf_dir)
    even = b.filter("band % 2 = 0").groupBy("x", "y").agg(F.bool_or(F.col("value") > 0.05).alias("mask"))
    odd = b.filter("band % 2 = 1").groupBy("x", "y").agg(F.bool_or(F.col("value") < -0.05).alias("mask"))
    return bookkeeping.any_of([even, odd])


@query(f"{BANDS} SELECT band, x, y, round(CASE WHEN value > 0.01e0 THEN value ELSE 0 END, 6) AS value FROM bands")
def zero_below_min_val(spark, sf_dir):
    return rounded(bands_of(spark, sf_dir).withColumn("value", F.when(F.col("value") > 0.01, F.col("value")).otherwise(0.0)), *BXY)


_COV = """cov AS (SELECT field_id, covar_samp(u, u) AS a, covar_samp(u, v) AS b, covar_samp(u, w) AS c, covar_samp(v, v) AS d, covar_samp(v, w) AS e, covar_samp(w, w) AS f, avg(u) AS m0, avg(v) AS m1, avg(w) AS m2 FROM vis GROUP BY field_id),
    mid AS (SELECT *, (a + d + f) / 3 AS q FROM cov), s AS (SELECT *, sqrt((pow(a - q, 2) + pow(d - q, 2) + pow(f - q, 2) + 2 * (b * b + c * c + e * e)) / 6) AS p FROM mid),
    t AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * (d - q) * (f - q) + 2 * b * c * e - (a - q) * e * e - (d - q) * c * c - (f - q) * b * b) / (2 * p * p * p)))) / 3 AS ang FROM s)"""
EIGEN = f"{_COV}, g AS (SELECT *, q + 2 * p * cos(ang + {2 * pi / 3!r}) AS lo, q + 2 * p * cos(ang) AS hi FROM t)"


@query(f"{W}, {EIGEN} SELECT field_id, round(lo / hi, 6) AS ratio, lo / hi <= 1e-5 AS planar FROM g")
def planar_uvw(spark, sf_dir):
    return rounded(bookkeeping.planar(vis_of(spark, sf_dir), ["field_id"]), "field_id", "planar")


@query(f"""{W}, {EIGEN}, n AS (SELECT *, b * e - c * (d - lo) AS n0, b * c - (a - lo) * e AS n1, (a - lo) * (d - lo) - b * b AS n2 FROM g)
    SELECT field_id, round(-n0 / n2, 6) + 0 AS t0, round(-n1 / n2, 6) + 0 AS t1, round(m2 + n0 / n2 * m0 + n1 / n2 * m1, 6) + 0 AS t2 FROM n""")
def uvw_hyperplane(spark, sf_dir):
    return rounded(bookkeeping.hyperplane(vis_of(spark, sf_dir), ["field_id"], "u", "v", "w"), "field_id")


@query(f"{W} SELECT DISTINCT format('FIELD{{}}_DDID{{}}_SCAN{{}}', field_id, ddid, scan) AS name, field_id, ddid, scan FROM vis")
def partition_names(spark, sf_dir):
    """Names of the partitions, and what is read back from them."""
    names = vis_of(spark, sf_dir).select("field_id", "ddid", "scan").distinct().select(bookkeeping.partition_name(F.col("field_id"), F.col("ddid"), F.col("scan")).alias("name"))
    return names.select("name", *bookkeeping.partition_of(F.col("name")))


@query(f"{BT} SELECT DISTINCT format('band{{:04d}}_time{{:04d}}', band_id, time_id) AS name FROM bt")
def image_names(spark, sf_dir):
    return band_time(vis_of(spark, sf_dir)).select(bookkeeping.image_name(F.col("band_id"), F.col("time_id")).alias("name")).distinct()


@query()
def weight_noise(spark, sf_dir):
    return bookkeeping.noise(vis_of(spark, sf_dir), ["row_id", "corr"], 7).select("row_id", "weight", "n_re", "n_im")


# Profiles and polarised models -----------------------------------------------

_COPIES = "list_sum(list_transform(range(0, 8), lambda n: {}))"
_T = "(t - (3.0e0 + 5.5e0 * n))"


@query(f"""WITH e AS (SELECT event_id, (epoch(ts) - (SELECT min(epoch(ts)) FROM events)) / 86400 AS t FROM events)
    SELECT event_id, round({_COPIES.format(f'exp(-({_T} * {_T}) / (2 * 0.7e0 * 0.7e0))')}, 6) AS gaussian, round({_COPIES.format(f'CASE WHEN {_T} >= 0 THEN exp(-greatest({_T}, 0) / 0.7e0) ELSE 0 END')}, 6) AS exponential FROM e""")
def periodic_profiles(spark, sf_dir):
    from ..functions import epoch_seconds

    e = read(spark, sf_dir, "events").select("event_id", epoch_seconds("ts").alias("s"))
    t = e.crossJoin(F.broadcast(e.agg(F.min("s").alias("s0")))).withColumn("t", (F.col("s") - F.col("s0")) / 86400)  # one row
    return rounded(t.select("event_id", *(periodic(k, F.col("t"), 3.0, 0.7, 5.5, 42.0).alias(k) for k in ("gaussian", "exponential"))), "event_id")


_P = "sqrt(xy_re * xy_re + yx_re * yx_re + yy_re * yy_re)"
_SHARE = f"exp(xx_re) * CASE WHEN {_P} > 0 THEN (exp({_P}) - exp(-{_P})) / 2 / {_P} ELSE 1 END"


@query(f"""{PIVOT} SELECT ant1, ant2, chan, round(exp(xx_re) * (exp({_P}) + exp(-{_P})) / 2, 6) AS i, round(xy_re * {_SHARE}, 6) + 0 AS q, round(yx_re * {_SHARE}, 6) + 0 AS u, round(yy_re * {_SHARE}, 6) + 0 AS v FROM p""")
def stokes_from_logarithm(spark, sf_dir):
    """The pivoted columns taken as the logarithm of a brightness matrix."""
    s = stokes_of_logarithm(*(a for a, _ in _pairs("xx", "xy", "yx", "yy")))
    return rounded(pivoted(spark, sf_dir).select("ant1", "ant2", "chan", *(v.alias(k) for k, v in s.items())), "ant1", "ant2", "chan")


@query(f"WITH {CUBE_SQL} SELECT vec_id, x, y, round(value / 1.5e0, 6) + 0 AS value FROM cube")
def prox_square(spark, sf_dir):
    return rounded(cube_of(spark, sf_dir).select("vec_id", "x", "y", shrunk(F.col("value"), 0.5).alias("value")), "vec_id", "x", "y")


TRANSIENTS = [  # l, m, flux, index, peak in years of the table, width
    (0.001, 0.002, 1.5, -0.7, 24.0, 0.5),
    (-0.002, 0.001, 0.8, 0.3, 25.5, 1.0),
]


def _transient_sql(part: str) -> str:
    out = []
    for l, m, flux, index, peak, width in TRANSIENTS:
        phase = f"({2 * pi!r} * freq / {C}e0 * (u * {l!r}e0 - v * {m!r}e0 - w * (sqrt(1 - {l!r}e0 * {l!r}e0 - {m!r}e0 * {m!r}e0) - 1)))".replace("-0.002e0 * -0.002e0", "0.000004e0")
        time = f"exp(-pow(time / 31557600 - {peak!r}e0, 2) / (2 * {width!r}e0 * {width!r}e0))"
        out.append(f"{flux!r}e0 * pow(freq / 1e9, {index!r}e0) * {time} * {'cos' if part == 're' else '-sin'}({phase})")
    return " + ".join(out)


@query(f"{W} SELECT row_id, round(re + {_transient_sql('re')}, 6) + 0 AS re, round(im + {_transient_sql('im')}, 6) + 0 AS im FROM vis")
def inject_transients(spark, sf_dir):
    """Two sources that brighten and fade."""
    from ..functions import profile

    vis = vis_of(spark, sf_dir)
    for l, m, flux, index, peak, width in TRANSIENTS:
        vis = visibility.inject(vis, l, m, spectrum(F.col("freq"), flux, 1e9, index) * profile("gaussian", F.col("time") / 31557600, peak, width))
    return rounded(vis.select("row_id", "re", "im"), "row_id")


# Beams, wavelets and stored models -------------------------------------------


@query(f"WITH {CUBE_SQL}, w AS (SELECT *, 1e0 + vec_id % 7 AS wt FROM cube) SELECT band, x, y, round(sum(value * wt) / sum(wt), 6) + 0 AS value, round(sum(wt), 6) AS weight FROM w GROUP BY band, x, y")
def beam_weighted_mean(spark, sf_dir):
    """Each image taken as a dataset's beam, with its weight."""
    return rounded(bookkeeping.weighted_mean(cube_of(spark, sf_dir).withColumn("weight", 1.0 + F.col("vec_id") % 7), BXY), *BXY)


@query(f"""{BANDS}, pts AS (SELECT band, CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, a.i * 0.8e0 - 0.5e0 AS px, b.i * 0.7e0 - 0.25e0 AS py FROM (SELECT DISTINCT band FROM bands), range(12) a(i), range(12) b(i))
    SELECT p.band, i, j, round(CASE WHEN px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7 THEN coalesce(sum(value * (1 - abs(px - x)) * (1 - abs(py - y))), 0) ELSE 1 END, 6) + 0 AS value
    FROM pts p LEFT JOIN bands b ON b.band = p.band AND abs(px - x) < 1 AND abs(py - y) < 1 GROUP BY p.band, i, j, px, py""")
def beam_resample(spark, sf_dir):
    """Beams at the pixels of another grid: 1 outside of what they cover."""
    b = bands_of(spark, sf_dir)
    step = F.explode(F.sequence(F.lit(0), F.lit(11)))
    pts = b.select("band").distinct().withColumn("i", step).withColumn("j", step).withColumns({"px": F.col("i") * 0.8 - 0.5, "py": F.col("j") * 0.7 - 0.25})
    return rounded(bookkeeping.bilinear(pts, b, ["band"], ["i", "j"], 8, 8), "band", "i", "j")


LEVELS, WAVELET = 2, "db2"


def _wavelet_sql() -> str:
    """Both axes of a level at once: the product of two taps for each pair of pixel and coefficient."""
    low, high = wavelets.filters(WAVELET)
    taps = "taps(kind, k, h) AS (VALUES " + ", ".join(f"('{b}', {k}, CAST({float(v)!r} AS DOUBLE))" for b, f in (("L", low), ("H", high)) for k, v in enumerate(reversed(f))) + ")"
    ctes, source = [taps], "SELECT band, x, y, value FROM bands"
    shape = wavelets.sizes(8, 8, WAVELET, LEVELS)
    for level in range(1, LEVELS + 1):
        n, m = shape[level]
        ctes.append(f"""l{level} AS (SELECT band, a.kind || b.kind AS kind, CAST((x + a.k - 1) // 2 AS INT) AS x, CAST((y + b.k - 1) // 2 AS INT) AS y, sum(value * a.h * b.h) AS value FROM ({source}), taps a, taps b
            WHERE (x + a.k) % 2 = 1 AND (y + b.k) % 2 = 1 AND (x + a.k - 1) // 2 < {n} AND (y + b.k - 1) // 2 < {m} GROUP BY ALL)""")
        source = f"SELECT band, x, y, value FROM l{level} WHERE kind = 'LL'"
    rows = " UNION ALL ".join(f"SELECT band, {level} AS level, kind, x, y, round(value, 6) + 0 AS value FROM l{level}" + ("" if level == LEVELS else " WHERE kind <> 'LL'") for level in range(1, LEVELS + 1))
    return f"{BANDS}, {', '.join(ctes)} {rows}"


@query(_wavelet_sql())
def wavelet_levels(spark, sf_dir):
    return rounded(wavelets.analysis(bands_of(spark, sf_dir), ["band"], WAVELET, LEVELS, 8, 8), "band", "level", "kind", "x", "y")


@query(f"{BANDS} SELECT band, x, y, round(value, 6) + 0 AS value FROM bands")
def wavelet_levels_inverse(spark, sf_dir):
    """Three levels of db4 there and back."""
    there = wavelets.analysis(bands_of(spark, sf_dir), ["band"], "db4", 3, 8, 8)
    return rounded(wavelets.synthesis(there, ["band"], "db4", 3, 8, 8), *BXY)


AT = [0.995e9, 1.0033e9, 1.05e9, 1.12e9]


@query(f"""{BANDS}, f AS (SELECT x, y, regr_slope(value, 1.0e0 + 0.01e0 * band) AS s, regr_intercept(value, 1.0e0 + 0.01e0 * band) AS c FROM bands GROUP BY x, y)
    SELECT x, y, freq, round(c + s * freq / 1e9, 6) + 0 AS value FROM f, (VALUES {", ".join(f"({v!r}e0)" for v in AT)}) t(freq)""")
def model_lines(spark, sf_dir):
    """Straight lines through the bands, stored as a model and evaluated at other frequencies."""
    model = components.fit_model(bands_of(spark, sf_dir).withColumnRenamed("band", "sample"), [(0.0, f, 1.0) for f in FREQS], (1, 2))
    return rounded(components.evaluate_model(model, [(0.0, f) for f in AT]).select("x", "y", "freq", "value"), "x", "y", "freq")


@query(f"""WITH {CUBE_SQL}, each AS (SELECT vec_id % 3 AS t, band, x, y, avg(value) AS value FROM cube GROUP BY ALL),
    inf AS (SELECT t, x, y, regr_slope(value, band) AS s, regr_intercept(value, band) AS c FROM each GROUP BY t, x, y),
    lines AS (SELECT t, x, y, c + s * 4.2e0 AS value FROM inf)
    SELECT x, y, round(regr_intercept(value, t) + 2.5e0 * regr_slope(value, t), 6) + 0 AS value FROM lines GROUP BY x, y""")
def model_time_and_frequency(spark, sf_dir):
    """A plane and its product term over three times and ten bands, between and beyond them."""
    each = cube_of(spark, sf_dir).groupBy((F.col("vec_id") % 3).alias("t"), "band", "x", "y").agg(F.avg("value").alias("value"))
    samples = [(float(t), float(b), 1.0) for t in range(3) for b in range(10)]
    model = components.fit_model(each.withColumn("sample", F.col("t") * 10 + F.col("band")), samples, (2, 2))
    return rounded(components.evaluate_model(model, [(2.5, 4.2)]).select("x", "y", "value"), "x", "y")


@query(f"WITH {CUBE_SQL} SELECT x, y, round(sum(value * (1e0 + vec_id % 5)) / sum(1e0 + vec_id % 5), 6) + 0 AS value, round(sum(1e0 + vec_id % 5), 6) AS weight FROM cube GROUP BY x, y")
def running_mean(spark, sf_dir):
    """Mean image of cadences as they come in."""
    from ..streaming import running_mean as of

    return rounded(of(cube_of(spark, sf_dir).withColumn("weight", 1.0 + F.col("vec_id") % 5), ["x", "y"]), "x", "y")
