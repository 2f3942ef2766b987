"""Detection, protected files, and workbooks that arrive."""

import zipfile

import pytest

from gridspark import model as M
from gridspark.sources import auto
from gridspark.streaming import arrivals
from gridspark.testing import ods_writer, xlsx_writer


def test_detect(spark, tmp_path):
    xlsx_writer.write(str(tmp_path / "noext"), {"s": [(1,)]})
    ods_writer.write(str(tmp_path / "b.ods"), {"s": [(1,)]})
    (tmp_path / "c.bin").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + bytes(600) + "EncryptedPackage".encode("utf-16-le"))
    (tmp_path / "d.xlsb").write_bytes(b"PK")
    (tmp_path / "e.txt").write_bytes(b"hello")
    with zipfile.ZipFile(tmp_path / "f.ods", "w") as z:
        z.writestr("META-INF/manifest.xml", "<manifest:encryption-data/>")
    (tmp_path / "d.xlsb").unlink()
    found = {r["path"].rsplit("/", 1)[1]: (r["format"], r["encrypted"]) for r in auto.detect(spark, str(tmp_path)).collect()}
    assert found == {"noext": ("xlsx", False), "b.ods": ("ods", False), "c.bin": ("xls", True), "e.txt": (None, False), "f.ods": ("ods", True)}
    with pytest.raises(M.PasswordProtected):
        auto.cells(spark, str(tmp_path))
    (tmp_path / "c.bin").unlink()
    (tmp_path / "f.ods").unlink()
    with pytest.raises(M.UnknownFormat):
        auto.cells(spark, str(tmp_path))
    assert auto.cells(spark, str(tmp_path), mode="permissive").count() == 2


def test_arrivals(spark, tmp_path):
    folder, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    xlsx_writer.write(f"{folder}/a.xlsx", {"s": [(1, "x")]})
    arrivals.follow(spark, folder, out, state).awaitTermination()
    ods_writer.write(f"{folder}/b.ods", {"s": [(2,)]})
    arrivals.follow(spark, folder, out, state).awaitTermination()
    assert sorted((r["batch"], r["kind"]) for r in spark.read.parquet(out).collect()) == [(0, "float"), (0, "string"), (1, "float")]
