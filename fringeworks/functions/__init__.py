"""Column functions: complex arithmetic on pairs of columns, geometry and profiles.

Spark has no complex type; a complex number is a pair (re, im) of DOUBLE columns.
"""

from __future__ import annotations

from math import ceil, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light, m/s.
C = 299792458.0
#: Modified Julian Date seconds at the Unix epoch.
MJD_EPOCH = 3506716800.0

Complex = tuple[Column, Column]


def cmul(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Complex) -> Complex:
    return a[0], -a[1]


def cdiv(a: Complex, b: Complex) -> Complex:
    """a / b, null where b is 0."""
    size = F.nullif(b[0] * b[0] + b[1] * b[1], F.lit(0.0))
    re, im = cmul(a, conj(b))
    return re / size, im / size


def abs2(a: Complex) -> Column:
    return a[0] * a[0] + a[1] * a[1]


def phasor(phase: Column) -> Complex:
    """exp(i * phase)."""
    return F.cos(phase), F.sin(phase)


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts).cast("double") / 1e6


def unix_time(mjd_seconds: Column) -> Column:
    return mjd_seconds - F.lit(MJD_EPOCH)


def uvw_phase(u: Column, v: Column, w: Column, freq: Column, l: Column | float, m: Column | float) -> Column:
    """2 pi f/c (u l - v m - w (n - 1)): v is flipped, u and w are not."""
    l, m = (x if isinstance(x, Column) else F.lit(float(x)) for x in (l, m))
    n = F.sqrt(1 - l * l - m * m)
    return 2 * pi * freq / C * (u * l - v * m - w * (n - 1))


def gaussian(x: Column, y: Column, major: float, minor: float, angle: float) -> Column:
    """Elliptical Gaussian of peak 1 by its widths at half maximum; the angle runs from +y."""
    from math import cos, log, sin

    s, c = sin(angle), cos(angle)
    along, across = x * s + y * c, x * c - y * s
    return F.exp(-4 * log(2) * (along * along / (major * major) + across * across / (minor * minor)))


def taper(i: Column, n: int, width: int) -> Column:
    """Cosine edge: 0 at the border, 1 from ``width`` pixels inwards."""
    edge = F.least(i, F.lit(n - 1) - i)
    return F.when(edge >= width, 1.0).otherwise(0.5 * (1 - F.cos(pi * edge / width)))


def good_size(n: int) -> int:
    """The next even integer at n or above whose prime factors are 2, 3, 5, 7 and 11."""
    n = max(2, n)
    while True:
        rest = n
        for p in (2, 3, 5, 7, 11):
            while rest % p == 0:
                rest //= p
        if rest == 1 and n % 2 == 0:
            return n
        n += 1


def image_size(longest: float, highest: float, field_deg: float, oversampling: float = 2.0) -> tuple[int, float]:
    """Pixels along an edge and the cell in radians, for a field of view and the longest baseline."""
    cell = 1 / (2 * longest * highest / C) / oversampling
    return good_size(ceil(field_deg * pi / 180 / cell)), cell


def padding(n: int, fraction: float) -> tuple[int, int]:
    """Pixels to pad before and after so that the sum is a good size of n * (1 + fraction) or more."""
    more = good_size(ceil(n * (1 + fraction))) - n
    return more // 2, more - more // 2


def profile(kind: str, t: Column, t0: float, width: float) -> Column:
    """Time profile of a transient: gaussian, exponential or step."""
    if kind == "gaussian":
        return F.exp(-((t - t0) * (t - t0)) / (2 * width * width))
    if kind == "exponential":
        return F.when(t >= t0, F.exp(-(t - t0) / width)).otherwise(0.0)
    if kind == "step":
        return F.when((t >= t0) & (t <= t0 + width), 1.0).otherwise(0.0)
    raise ValueError(f"no profile {kind}")


def periodic(kind: str, t: Column, t0: float, width: float, period: float, until: float) -> Column:
    """Sum of the profile's copies ``period`` apart whose peaks are not after ``until``; 0 if the first is."""
    if t0 > until:
        return F.lit(0.0)
    copies = F.sequence(F.lit(0), F.lit(int((until - t0) / period)))
    return F.aggregate(F.transform(copies, lambda n: profile(kind, t, t0 + n * F.lit(float(period)), width).cast("double")), F.lit(0.0), lambda a, b: a + b)


def stokes_of_logarithm(a: Column, b: Column, c: Column, d: Column) -> dict[str, Column]:
    """I, Q, U, V of the brightness matrix exp([[a + b, c + id], [c - id, a - b]]): positive I, never over-polarised."""
    p = F.sqrt(b * b + c * c + d * d)
    share = F.when(p > 0, F.sinh(p) / p).otherwise(1.0) * F.exp(a)
    return {"i": F.exp(a) * F.cosh(p), "q": b * share, "u": c * share, "v": d * share}


def shrunk(value: Column, gamma: float) -> Column:
    """Proximal step of gamma / 2 times the square."""
    return value / (1.0 + gamma)


def spectrum(freq: Column, flux: float, ref: float, index: float) -> Column:
    return flux * F.pow(freq / ref, F.lit(index))
