"""Typed headers and the kind of a file by what stands in it."""

import gzip

import pytest

from skycat.operators import catalogue
from skycat.sources import kinds

HEADER = """# %ECSV 1.0
# ---
# delimiter: ','
# datatype:
# - {name: source_id, datatype: int64}
# - {name: 'l b', unit: deg, datatype: float64, description: 'a text, with datatype: int8'}
# - name: flag
#   datatype: bool
# - {name: note, datatype: string, subtype: json}
# - {name: small,
#    unit: "mag",
#    datatype: float32}
# meta: !!omap
# - {comments: [datatype, x]}
# schema: astropy-2.0
"""


def test_typed_header():
    sep, columns = kinds.typed_header(HEADER.splitlines())
    assert sep == "," and [(c.name, c.datatype, c.unit) for c in columns] == [("source_id", "bigint", None), ("l b", "double", "deg"), ("flag", "boolean", None), ("note", "string", None), ("small", "float", "mag")]
    assert kinds.typed_header(["# %ECSV 1.0", "# ---", "a b"]) == (" ", [])


@pytest.mark.parametrize("packed", [False, True])
def test_read_typed(spark, tmp_path, packed):
    text = HEADER + 'source_id,l b,flag,note,small\n1,1.5,True,"{""a"": 1}",2.5\n2,nan,False,,\n3,,x,c,-inf\n'
    for i in (1, 2):
        (tmp_path / f"a{i}.ecsv{'.gz' if packed else ''}").write_bytes(gzip.compress(text.encode()) if packed else text.encode())
    rows = kinds.read_typed(spark, str(tmp_path / "a*"))
    assert dict(rows.dtypes) == {"source_id": "bigint", "l b": "double", "flag": "boolean", "note": "string", "small": "float"} and rows.count() == 6
    got = {r.source_id: r for r in rows.collect()}
    assert got[1]["l b"] == 1.5 and got[1].flag is True and got[2]["l b"] != got[2]["l b"] and got[2].small is None
    assert got[3]["l b"] is None and got[3].flag is None and got[3].small == float("-inf")
    assert rows.schema["l b"].metadata == {"unit": "deg"}
    assert kinds.detect(spark, str(tmp_path / "a*")) == ("catalog", "ecsv")


def block(*cards):
    return "".join(f"{c:<80}" for c in [*cards, "END"]).ljust(2880).encode()


TABLE = ("XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 8", "NAXIS2  = 0", "PCOUNT  = 0", "TFIELDS = 1", "TTYPE1  = 'v'", "TFORM1  = 'D'")
EMPTY = block("SIMPLE  = T", "BITPIX  = 8", "NAXIS   = 0")
IMAGE = block("SIMPLE  = T", "BITPIX  = -32", "NAXIS   = 2", "NAXIS1  = 10", "NAXIS2  = 10") + bytes(2880)
FILES = {
    ("catalog", "csv"): [b"l,b\n1,2\n", "﻿l,b\n1,2\n".encode(), gzip.compress(b"l,b\n1,2\n")],
    ("catalog", "tsv"): [b"l\tb\n1\t2\n"],
    ("catalog", "json"): [b'{"l": 1}\n', b"[1]"],
    ("catalog", "ecsv"): [b"# %ECSV 1.0\n# ---\nl b\n1 2\n"],
    ("catalog", "fits"): [EMPTY + block(*TABLE)],
    ("healpix", "fits"): [EMPTY + block(*TABLE, "NSIDE   = 8"), EMPTY + block(*TABLE, "PIXTYPE = 'HEALPIX '"), IMAGE + block(*TABLE, "ORDERING= 'RING'")],
    ("fits_image", "fits"): [IMAGE, IMAGE + block(*TABLE)],
    ("equirectangular", "image"): [b"\x93NUMPY\x01\0", b"PK\x03\x04abc"],
    ("equirectangular_image", "image"): [b"\x89PNG\r\n", b"\xff\xd8\xff\xe0", b"II*\0"],
}


def test_detect_by_content(spark, tmp_path):
    for (kind, form), files in FILES.items():
        for i, data in enumerate(files):
            name = f"{kind}-{form}-{i}.bin" + (".gz" if data[:2] == b"\x1f\x8b" else "")
            (tmp_path / name).write_bytes(data)
            assert kinds.detect(spark, str(tmp_path / name)) == (kind, form), name
    assert kinds.detect(spark, str(tmp_path / "fits_image-fits-0.bin"), "healpix_fits") == ("healpix", "fits")
    assert kinds.detect(spark, str(tmp_path / "catalog-csv-0.bin"), "Table") == ("catalog", "csv")
    spark.range(3).write.parquet(str(tmp_path / "p"))
    assert kinds.detect(spark, str(tmp_path / "p")) == ("catalog", "parquet") and kinds.read_catalogue(spark, str(tmp_path / "p")).count() == 3
    (tmp_path / "bad").write_bytes(b"\0\1\2\3")
    with pytest.raises(ValueError):
        kinds.detect(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        kinds.read_catalogue(spark, str(tmp_path / "fits_image-fits-0.bin"))
    with pytest.raises(FileNotFoundError):
        kinds.detect(spark, str(tmp_path / "nothing"))


def test_catalogue_selection():
    names = lambda *a, **k: [s.name for s in catalogue.choose_catalogues(*a, **k)]
    assert names() == ["rr_lyrae", "cepheids", "lbv", "cataclysmic", "zz_ceti"] and names(["lbv", "lbv"], True) == ["lbv", "other"]
    assert names(["other"], include_other=True) == ["other"]
    with pytest.raises(ValueError):
        names(["x"])
    with pytest.raises(ValueError):
        catalogue.build_catalogues([], {}, 2.0)
