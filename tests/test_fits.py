"""FITS files written and read back, and their headers."""

import numpy as np
import pytest
from fringeworks.sources import fits

FRAME = fits.Frame(5, 3, 0.01, 0.02, 0.5, -0.3, (1.0e9, 1.1e9, 1.2e9), time=1.7e9)


def cards(path):
    import pyarrow as pa

    with pa.OSFile(str(path)) as f:
        return fits._read_header(f)


def test_round_trip(spark, tmp_path):
    """Two cubes and a null key, gaps, nulls, pixels given twice, and columns of clashing names."""
    rng = np.random.default_rng(1)
    rows = [(k, b, x, y, float(rng.normal())) for k in ("dirty/a", "psf", None) for b in range(3) for x in range(5) for y in range(3) if (b, x) != (1, 2)]
    rows += [("psf", 1, 2, 0, None), ("psf", 1, 2, 1, 4.0), ("psf", 1, 2, 1, 5.0), ("psf", 1, 2, 1, None)]
    table = spark.createDataFrame([(*r, "z", 7) for r in rows], "product string, band int, x int, y int, value double, file string, planes int")
    beams = [(3.0, 2.0, 0.1), (2.0, 1.5, 0.2), (1.0, 1.0, 0.3)]
    files = fits.write_fits(table, f"file://{tmp_path}/out", FRAME, ["product"], -64, beams)
    assert sorted((r.file, r.planes) for r in files.collect()) == [("=null", 3), ("dirty=2Fa", 3), ("psf", 3)]
    names = {"dirty=2Fa": "dirty/a", "psf": "psf", "=null": None}
    got = {}
    for r in fits.read_fits(spark, f"file://{tmp_path}/out/*.fits").collect():
        got[names[r.file.rsplit("/", 1)[1][:-5]], r.band, r.x, r.y] = r.value
        assert r.freq == pytest.approx(FRAME.freqs[r.band]) and r.stokes == 0
    want = {(k, b, x, y): float("nan") for k in names.values() for b in range(3) for x in range(5) for y in range(3)}
    want |= {r[:4]: r[4] for r in rows if r[4] is not None}
    assert got.keys() == want.keys()
    assert all(got[k] == v or (np.isnan(got[k]) and np.isnan(v)) for k, v in want.items())


def test_header_and_size(spark, tmp_path):
    table = spark.createDataFrame([(2, 4, 2, 1.5)], "band int, x int, y int, value double")
    fits.write_fits(table, str(tmp_path), FRAME, [], beams=[(3.0, 2.0, 0.1)] * 3)
    path = tmp_path / "image.fits"
    got, start = cards(path)
    assert [got[f"NAXIS{i}"] for i in range(1, 5)] == [5, 3, 3, 1] and got["BITPIX"] == -32
    assert (got["CRPIX1"], got["CRPIX2"], got["CRPIX3"]) == (3.0, 2.0, 2.0) and got["CDELT1"] == -0.01
    assert got["CRVAL1"] == pytest.approx(np.degrees(0.5)) and got["CRVAL3"] == 1.1e9 and got["DATE-OBS"] == "2023-11-14T22:13:20"
    assert got["BMAJ2"] == pytest.approx(0.03) and got["CASAMBM"] is True
    raw = path.read_bytes()
    assert len(raw) % fits.BLOCK == 0 and raw[start + fits.BLOCK :].startswith(b"XTENSION= 'BINTABLE'")
    data = np.frombuffer(raw[start : start + 4 * 45], ">f4").reshape(3, 3, 5)
    assert data[2, 2, 4] == 1.5 and np.isnan(data).sum() == 44
    rows = np.frombuffer(raw[-fits.BLOCK :][:60], ">f4,>f4,>f4,>i4,>i4")
    assert [r[3] for r in rows] == [0, 1, 2] and rows[0][0] == pytest.approx(0.03)


def test_other_arrays(spark, tmp_path):
    """Integers with a scale and blanks, two axes, a comment; Stokes before frequency."""
    flat = fits._header([("SIMPLE", True), ("BITPIX", 16), ("NAXIS", 2), ("NAXIS1", 2), ("NAXIS2", 2), ("BSCALE", 0.5), ("BZERO", 1.0), ("BLANK", -1)])
    (tmp_path / "a flat 1%.fits").write_bytes(flat + np.array([0, 2, -1, 4], ">i2").tobytes().ljust(fits.BLOCK, b"\0"))
    deep = fits._header([("SIMPLE", True), ("BITPIX", -32), ("NAXIS", 4), ("NAXIS1", 1), ("NAXIS2", 1), ("NAXIS3", 2), ("NAXIS4", 2), ("CTYPE3", "STOKES"), ("CTYPE4", "FREQ"), ("CRVAL4", 5.0), ("CDELT4", 2.0)])
    (tmp_path / "deep.fits").write_bytes(deep + np.arange(4, dtype=">f4").tobytes().ljust(fits.BLOCK, b"\0"))
    rows = fits.read_fits(spark, [f"{tmp_path}/a flat*.fits", f"{tmp_path}/deep.fits"]).collect()
    assert {(r.x, r.y, r.value) for r in rows if "flat" in r.file} == {(0, 0, 1.0), (1, 0, 2.0), (0, 1, None), (1, 1, 3.0)}
    assert {(r.stokes, r.band, r.freq, r.value) for r in rows if "deep" in r.file} == {(0, 0, 5.0, 0.0), (1, 0, 5.0, 1.0), (0, 1, 7.0, 2.0), (1, 1, 7.0, 3.0)}
    assert fits.parse_card("OBJECT  = 'it''s a / b' / comment".ljust(80)) == ("OBJECT", "it's a / b")
    assert fits.parse_card("COMMENT   nothing".ljust(80)) is None


def test_no_rows_and_pixels_outside(spark, tmp_path):
    table = spark.createDataFrame([], "band int, x int, y int, value double")
    assert fits.write_fits(table, str(tmp_path / "none"), FRAME, []).count() == 0
    for row in ((3, 0, 0, 1.0), (0, 5, 0, 1.0), (0, None, 0, 1.0)):
        with pytest.raises(Exception, match="outside the frame"):
            fits.write_fits(spark.createDataFrame([row], table.schema), str(tmp_path / "bad"), FRAME, [])
