"""FITS files as a sink and a source of images.

A file is a cube (x, y, frequency, Stokes) of one group of images.  Files are
written by the tasks that hold their rows, plane after plane, and read plane by
plane, so a task holds one plane at most and nothing passes through the driver.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import pairwise
from math import degrees, isnan
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import stored

BLOCK = 2880
#: Numbers of a data array by BITPIX, as the FITS standard defines them.
NUMBERS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Pixels in a batch of rows.
_ROWS = 1 << 16


@dataclass(frozen=True)
class Frame:
    """Pixels, cells (degrees), centre (radians) and the frequencies of the planes of a cube."""

    nx: int
    ny: int
    cell_x: float
    cell_y: float
    ra: float
    dec: float
    freqs: tuple[float, ...]
    unit: str = "Jy/beam"
    time: float | None = None  # seconds since 1970

    def cards(self, bits: int, beams: list[tuple[float, float, float]] | None = None) -> list[tuple[str, object]]:
        """The header: orthographic axes about the centre, frequencies about the middle plane, beams in degrees.

        beams: (major, minor, angle) of each plane in pixels and radians; the first
        is also given without a number, as the beam of the whole.
        """
        n, middle = len(self.freqs), len(self.freqs) // 2
        step = self.freqs[1] - self.freqs[0] if n > 1 else 1.0
        axes = [
            ("RA---SIN", self.nx, 1 + self.nx // 2, -self.cell_x, degrees(self.ra), "deg"),
            ("DEC--SIN", self.ny, 1 + self.ny // 2, self.cell_y, degrees(self.dec), "deg"),
            ("FREQ", n, 1 + middle, step, self.freqs[middle], "Hz"),
            ("STOKES", 1, 1, 1.0, 1.0, ""),
        ]
        out: list[tuple[str, object]] = [("SIMPLE", True), ("BITPIX", bits), ("NAXIS", 4)]
        out += [(f"NAXIS{i}", a[1]) for i, a in enumerate(axes, 1)]
        out += [("EXTEND", True), ("BSCALE", 1.0), ("BZERO", 0.0), ("BUNIT", self.unit), ("BTYPE", "Intensity"), ("EQUINOX", 2000.0), ("RADESYS", "FK5")]
        for i, (kind, _, pixel, delta, value, unit) in enumerate(axes, 1):
            out += [(f"CTYPE{i}", kind), (f"CRPIX{i}", float(pixel)), (f"CDELT{i}", delta), (f"CRVAL{i}", value), (f"CUNIT{i}", unit)]
        out += [("RESTFRQ", self.freqs[middle]), ("SPECSYS", "TOPOCENT")]
        if self.time is not None:
            out.append(("DATE-OBS", datetime.fromtimestamp(self.time, UTC).strftime("%Y-%m-%dT%H:%M:%S")))
        if beams:
            out.append(("CASAMBM", True))
            for mark, (major, minor, angle) in [("", beams[0]), *((str(i), b) for i, b in enumerate(beams, 1))]:
                out += [(f"BMAJ{mark}", major * self.cell_x), (f"BMIN{mark}", minor * self.cell_x), (f"BPA{mark}", degrees(angle))]
        return out


def _header(cards: list[tuple[str, object]]) -> bytes:
    lines = []
    for name, value in cards:
        if isinstance(value, bool):
            text = f"{'T' if value else 'F':>20}"
        elif isinstance(value, str):
            quoted = value.replace("'", "''")
            text = f"'{quoted:<8}'"
        elif isinstance(value, float) and isnan(value):
            continue  # a beam that was not found
        else:
            text = f"{value!r:>20}".upper()
        lines.append(f"{name:<8}= {text}".ljust(80))
    body = "".join([*lines, "END".ljust(80)]).encode("ascii")
    return body.ljust(-(-len(body) // BLOCK) * BLOCK)


def _beam_table(frame: Frame, beams: list[tuple[float, float, float]]) -> bytes:
    """The binary table BEAMS: a row for each plane."""
    rows = np.array([(a * frame.cell_x, b * frame.cell_x, degrees(p), k, 0) for k, (a, b, p) in enumerate(beams)], ">f4,>f4,>f4,>i4,>i4").tobytes()
    cards: list[tuple[str, object]] = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 20), ("NAXIS2", len(beams)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 5)]
    for i, (name, form, unit) in enumerate((("BMAJ", "1E", "deg"), ("BMIN", "1E", "deg"), ("BPA", "1E", "deg"), ("CHAN", "1J", ""), ("POL", "1J", "")), 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form), *([(f"TUNIT{i}", unit)] if unit else [])]
    cards += [("EXTNAME", "BEAMS"), ("EXTVER", 1), ("NCHAN", len(beams)), ("NPOL", 1)]
    return _header(cards) + rows.ljust(-(-len(rows) // BLOCK) * BLOCK, b"\0")


def _opened(uri: str, listed: bool = False) -> tuple[fs.FileSystem, str]:
    """listed: a path as Spark lists it, in which nothing is escaped."""
    if listed:
        uri = quote(uri, safe=":/@=+,")
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class _Cube:
    """A file that is being written; rows come in the order of its planes."""

    def __init__(self, folder: str, name: str, frame: Frame, bits: int, beams: list[tuple[float, float, float]] | None) -> None:
        self.name, self.frame, self.beams, self.number = name, frame, beams, np.dtype(NUMBERS[bits])
        self.system, root = _opened(folder)
        self.system.create_dir(root, recursive=True)
        self.path = f"{root}/{name}.fits"
        self.draft = f"{root}/.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.draft)
        self.out.write(_header(frame.cards(bits, beams)))
        self.at = 0
        self.clear()

    def clear(self) -> None:
        self.plane = np.full((self.frame.ny, self.frame.nx), np.nan)

    def forward(self, band: int) -> None:
        while self.at < band:
            self.out.write(self.plane.astype(self.number).tobytes())
            self.at += 1
            self.clear()

    def add(self, band: np.ndarray, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> None:
        f = self.frame
        if not ((band >= 0) & (band < len(f.freqs)) & (x >= 0) & (x < f.nx) & (y >= 0) & (y < f.ny)).all():
            raise ValueError(f"{self.name}: pixels outside the frame")
        cuts = [0, *(np.flatnonzero(np.diff(band)) + 1), len(band)]
        for a, b in pairwise(cuts):
            self.forward(int(band[a]))
            self.plane[y[a:b], x[a:b]] = value[a:b]

    def close(self) -> pa.RecordBatch:
        n = len(self.frame.freqs)
        self.forward(n)
        size = n * self.frame.nx * self.frame.ny * self.number.itemsize
        self.out.write(bytes(-size % BLOCK))
        if self.beams:
            self.out.write(_beam_table(self.frame, self.beams))
        self.out.close()
        # a task that runs twice writes the same file twice, and a draft is never read
        if not isinstance(self.system, fs.LocalFileSystem) and self.system.get_file_info(self.path).type != fs.FileType.NotFound:
            self.system.delete_file(self.path)
        self.system.move(self.draft, self.path)
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([n], pa.int32())], names=["file", "planes"])


def write_fits(images: DataFrame, folder: str, frame: Frame, keys: list[str], bits: int = -32, beams: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """Writes a cube for each value of ``keys`` and returns the files written: (file, planes).

    images: keys, band (place in the frame's frequencies), x, y, value; other
    columns are ignored.  A file is named by its keys, with other signs than
    letters, digits and ``.-_+`` escaped by ``=``.  Pixels that are not given
    or null are NaN; of pixels given twice the greatest value stays; pixels out of
    the frame, or null coordinates, are an error.  No rows: no files.
    """
    plain = lambda c: F.replace(F.translate(F.url_encode(c.cast("string")), "%", "="), F.lit("*"), F.lit("=2A"))
    name = F.concat_ws(",", *(F.coalesce(plain(F.col(k)), F.lit("=null")) for k in keys)) if keys else F.lit("image")
    place = [F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("band", "x", "y")]
    rows = images.select(name.alias("file"), *place, F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    # NaN sorts above numbers, so it must come before them to give way
    ordered = rows.repartition("file").sortWithinPartitions("file", "band", "y", "x", F.isnan("value").desc(), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cube: _Cube | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("file").dictionary_encode().indices.to_numpy()
            parts = [batch.column(c).to_numpy() for c in ("band", "x", "y", "value")]
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]):
                file = batch.column("file")[int(a)].as_py()
                if cube is None or cube.name != file:
                    if cube is not None:
                        yield cube.close()
                    cube = _Cube(folder, file, frame, bits, beams)
                cube.add(*(p[a:b] for p in parts))
        if cube is not None:
            yield cube.close()

    return stored(ordered.mapInArrow(run, "file string, planes int"), "fits")


def parse_card(card: str) -> tuple[str, object] | None:
    """(name, value) of a line of a header, or nothing for comments."""
    if card[8:10] != "= ":
        return None
    text = card[10:].strip()
    if text.startswith("'"):
        found = re.match(r"'((?:[^']|'')*)'", text)
        return card[:8].strip(), found[1].replace("''", "'").rstrip() if found else ""
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return card[:8].strip(), text == "T"
    try:
        return card[:8].strip(), int(text)
    except ValueError:
        return (card[:8].strip(), float(text.replace("D", "E"))) if text else None


def _read_header(source: pa.NativeFile) -> tuple[dict[str, object], int]:
    """Cards of the first header, and where the data begin."""
    cards: dict[str, object] = {}
    size = 0
    while block := source.read(BLOCK):
        size += len(block)
        for k in range(0, len(block), 80):
            card = block[k : k + 80].decode("ascii", "replace")
            if card.rstrip() == "END":
                return cards, size
            if found := parse_card(card):
                cards[found[0]] = found[1]
    raise ValueError("no FITS header")


def _planes(path: str) -> list[dict[str, object]]:
    system, name = _opened(path, listed=True)
    with system.open_input_file(name) as source:
        cards, start = _read_header(source)
    dims = [cards.get(f"NAXIS{i}", 1) for i in range(1, 5)]
    if any(cards.get(f"NAXIS{i}", 1) != 1 for i in range(5, cards["NAXIS"] + 1)):
        raise ValueError(f"{path}: more than four axes")
    nx, ny, n3, n4 = dims
    size = nx * ny * np.dtype(NUMBERS[cards["BITPIX"]]).itemsize
    first_stokes = str(cards.get("CTYPE3", "")).startswith("STOKES")
    axis = 4 if first_stokes else 3
    out = []
    for k in range(n3 * n4 if nx * ny else 0):
        band, stokes = (k // n3, k % n3) if first_stokes else (k % n3, k // n3)
        freq = cards.get(f"CRVAL{axis}", 0.0) + (band + 1 - cards.get(f"CRPIX{axis}", 1.0)) * cards.get(f"CDELT{axis}", 1.0)
        out.append({"file": path, "start": start + k * size, "nx": nx, "ny": ny, "bits": cards["BITPIX"], "scale": float(cards.get("BSCALE", 1.0)), "zero": float(cards.get("BZERO", 0.0)), "blank": cards.get("BLANK"), "stokes": stokes, "band": band, "freq": float(freq)})
    return out


def read_fits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, stokes, band, freq, x, y, value) of the first array of FITS files; paths may be globs.

    Arrays of up to four axes in any number format, with their scale; blank
    integers are null.  Only paths are listed at first; tasks read headers, then planes.
    """
    files = spark.read.format("binaryFile").load(paths).select("path")
    shape = pa.schema([("file", pa.string()), ("start", pa.int64()), ("nx", pa.int32()), ("ny", pa.int32()), ("bits", pa.int32()), ("scale", pa.float64()), ("zero", pa.float64()), ("blank", pa.int64()), ("stokes", pa.int32()), ("band", pa.int32()), ("freq", pa.float64())])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(_planes(path), shape)

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.to_pylist():
                number = np.dtype(NUMBERS[p["bits"]])
                system, name = _opened(p["file"], listed=True)
                with system.open_input_file(name) as source:
                    for a in range(0, p["nx"] * p["ny"], _ROWS):
                        n = min(_ROWS, p["nx"] * p["ny"] - a)
                        raw = np.frombuffer(source.read_at(n * number.itemsize, p["start"] + a * number.itemsize), number)
                        blank = raw == p["blank"] if p["blank"] is not None and p["bits"] > 0 else None
                        at = np.arange(a, a + n)
                        same = lambda c, kind, n=n, p=p: pa.array(np.full(n, p[c]), kind)
                        value = pa.array(raw.astype(float) * p["scale"] + p["zero"], mask=blank)
                        columns = [pa.array([p["file"]] * n), same("stokes", pa.int32()), same("band", pa.int32()), same("freq", pa.float64()), pa.array((at % p["nx"]).astype(np.int32)), pa.array((at // p["nx"]).astype(np.int32)), value]
                        yield pa.RecordBatch.from_arrays(columns, names=["file", "stokes", "band", "freq", "x", "y", "value"])

    planes = files.mapInArrow(heads, "file string, start long, nx int, ny int, bits int, scale double, zero double, blank long, stokes int, band int, freq double")
    # a given number of parts: a plane's row is small, but its work is not
    spread = planes.repartition(4 * spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(pixels, "file string, stokes int, band int, freq double, x int, y int, value double")
