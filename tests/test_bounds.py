"""What is inflated and what is not: prefixes, chunks, names of sheets, last rows, packages without a workbook; headers of many sheets."""

import io
import zipfile

import pytest
from pyspark.sql.types import StructType

from gridspark.operators.rows import header_relation, rows_by_headers
from gridspark.sources import ods, parts, xlsb, xlsx
from gridspark.testing import ods_writer, xlsb_writer, xlsx_writer


def rows_of(data, end, chunk, monkeypatch):
    monkeypatch.setattr(parts, "CHUNK", chunk)
    return list(parts.chunks(io.BytesIO(data), end))


@pytest.mark.parametrize("chunk", [7, 16, 50, 1000, 1 << 20])
@pytest.mark.parametrize("prefix", ["", "x:"])
def test_chunks_end_behind_rows(monkeypatch, chunk, prefix):
    rows = [f"<{prefix}row>{'y' * (k * 7 % 90)}</{prefix}row>" for k in range(60)]
    data = f"<{prefix}worksheet>{''.join(rows)}</{prefix}worksheet>".encode()
    if prefix and chunk < 20:
        chunk = 20  # the root element is looked for in the first read
    got = rows_of(data, b"</row>", chunk, monkeypatch)
    assert b"".join(g[2] for g in got) == data and [g[0] for g in got] == list(range(len(got)))
    end = f"</{prefix}row>".encode()
    before = 0
    for _, units, own, prefixed in got:
        assert units == before and prefixed == bool(prefix)
        before += own.count(end)
    assert before == 60 and all(g[2].endswith(end) for g in got[:-1]) and max(len(g[2]) for g in got) < chunk + 2 * 110


def test_a_prefixed_sheet_is_cut(spark, tmp_path, monkeypatch):
    sizes = {}
    for prefix in ("", "x"):
        path = str(tmp_path / f"p{prefix}.xlsx")
        xlsx_writer.write(path, {"s": ((k, f"text {k}", k / 7) for k in range(40_000))}, prefix=prefix)
        own = xlsx._chunks(spark, path)
        sizes[prefix] = own.count()
        assert xlsx.cells(spark, path).count() == 120_000
    assert sizes["x"] >= sizes[""] > 2


def test_only_the_sheets_that_are_asked_for(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    xlsx_writer.write(path, {"One": [(1,)], "Tw&o": [(2,)], "Three": [(3,)]})
    with zipfile.ZipFile(path) as z:  # a sheet that cannot be inflated
        members = {i.filename: z.read(i) for i in z.infolist()}
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body, zipfile.ZIP_STORED)
    raw = bytearray(open(path, "rb").read())
    at = raw.find(members["xl/worksheets/sheet3.xml"])
    raw[at] ^= 1
    open(path, "wb").write(raw)
    assert [(r["sheet"], r["f"]) for r in xlsx.cells(spark, path, only=["Tw&o"]).collect()] == [("Tw&o", 2.0)]
    assert xlsx.cells(spark, path, only=[]).count() == 0
    with pytest.raises(Exception, match="Bad CRC"):
        xlsx.cells(spark, path).collect()


def test_nothing_behind_the_last_row(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    xlsx_writer.write(path, {"s": ((k, f"text {k}") for k in range(60_000))}, dimensions={"s": "A1:B60000"})
    assert xlsx._chunks(spark, path, last_row=5).count() == 1 < xlsx._chunks(spark, path).count()
    assert {r["row"] for r in xlsx.cells(spark, path, last_row=5).collect()} == set(range(6))
    assert [tuple(r)[1:] for r in xlsx.dimensions(spark, path).collect()] == [("s", 0, 0, 0, 59_999, 1)]
    xlsb_writer.write(str(tmp_path / "b.xlsb"), {"s": ((k,) for k in range(100))})
    assert {r["row"] for r in xlsb.cells(spark, str(tmp_path / "b.xlsb"), last_row=5).collect()} == set(range(6))


def test_a_sheet_that_declares_nothing(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    xlsx_writer.write(path, {"s": [(1,)], "t": []}, dimensions={"t": "C4"})
    assert {tuple(r)[1:] for r in xlsx.dimensions(spark, path).collect()} == {("s", 0, None, None, None, None), ("t", 1, 3, 2, 3, 2)}


def test_a_package_without_a_workbook_raises(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("some/part.xml", "<a/>")
    with pytest.raises(Exception, match="no workbook in the package"):
        xlsx.cells(spark, str(tmp_path / "x.xlsx")).collect()


def test_every_file_is_opened_once(spark, tmp_path, monkeypatch):
    xlsx_writer.write(str(tmp_path / "a.xlsx"), {"s": [("k", 1), ({"f": "A1", "attrs": ' t="shared" si="0" ref="A2:A3"', "v": 1}, 2), ({"attrs": ' t="shared" si="0"', "v": 1}, 3)], "t": [("x",)]})
    ods_writer.write(str(tmp_path / "b.ods"), {"s": [(1,)]})
    seen, real = [], parts.files
    monkeypatch.setattr(parts, "files", lambda spark, paths: seen.append(paths) or real(spark, paths))
    for source, name, n in ((xlsx, "a.xlsx", 7), (ods, "b.ods", 1)):
        seen.clear()
        cells = source.cells(spark, str(tmp_path / name))
        assert cells.count() == n and len(seen) == 1
        assert "binaryFile" not in cells._jdf.queryExecution().executedPlan().toString()
    seen.clear()
    own = xlsx.opened(spark, str(tmp_path / "a.xlsx"))
    assert xlsx.cells(spark, own).count() == 7 and xlsx.cells(spark, own, only=["t"]).count() == 1 and xlsx.cells(spark, own, last_row=0).count() == 3 and xlsx.sheets(spark, own).count() == 2 and len(seen) == 1


def test_numbers_of_strings(spark, tmp_path):
    xlsx_writer.write(str(tmp_path / "a.xlsx"), {"s": [("one", 1.5, True), ("two", "one", "#N/A")]})
    coded = xlsx.coded_cells(spark, str(tmp_path))
    assert sorted((r["row"], r["col"], r["kind"], r["string_index"], r["s"]) for r in coded.collect()) == [(0, 0, "string", 0, None), (0, 1, "float", None, None), (0, 2, "bool", None, None), (1, 0, "string", 1, None), (1, 1, "string", 0, None), (1, 2, "error", None, "#N/A")]
    plan = coded.select("row", "f")._jdf.queryExecution().optimizedPlan().toString()
    assert "<si" not in plan
    texts = {(r["row"], r["col"]): r["s"] for r in xlsx.with_strings(coded, xlsx.shared_strings(spark, str(tmp_path))).where("kind IN ('string', 'error')").collect()}
    assert texts == {(0, 0): "one", (1, 0): "two", (1, 1): "one", (1, 2): "#N/A"}
    with pytest.raises(Exception, match="no shared string 1"):
        xlsx.with_strings(coded, xlsx.shared_strings(spark, str(tmp_path)).where("index = 0")).collect()


def test_headers_of_many_sheets(spark, tmp_path):
    xlsx_writer.write(str(tmp_path / "a.xlsx"), {"s": [("k", " v "), (1, "a"), (2, "b")], "t": [("v", "k", "k"), ("c", 3, 9), (None, None, 7)]})
    cells = xlsx.cells(spark, str(tmp_path))
    schema = StructType.fromDDL("k bigint, v string")
    heads = header_relation(cells, ["path", "sheet"])
    assert {(r["sheet"], r["col"], r["name"]) for r in heads.collect()} == {("s", 0, "k"), ("s", 1, "v"), ("t", 0, "v"), ("t", 1, "k")}
    assert {tuple(r)[1:] for r in rows_by_headers(cells, heads, schema, ["path", "sheet"]).collect()} == {("s", 1, "a"), ("s", 2, "b"), ("t", 3, "c")}
    with pytest.raises(Exception, match="no column 'w'"):
        rows_by_headers(cells, heads, StructType.fromDDL("k bigint, w string"), ["path", "sheet"]).collect()
    assert header_relation(cells, ["path", "sheet"], 1).where("sheet = 's'").count() == 2


def test_a_partition_is_many_workbooks(spark):
    """Rows of a partition are held and written by workbooks of bounded rows and bytes; none is lost."""
    import pyarrow as pa

    from gridspark.plans import workbooks
    from gridspark.sources.parts import files

    books = files(spark, workbooks.written(spark, spark.range(60_000 * spark.sparkContext.defaultParallelism).toDF("k"), "many", header=False))
    assert books.count() >= 3 * spark.sparkContext.defaultParallelism
    assert xlsx.cells(spark, books).agg({"f": "sum", "*": "count"}).first() == (sum(range(240_000)) * 1.0, 240_000)
    batches = [pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 50}), pa.RecordBatch.from_pydict({"t": ["y"] * 500})]
    cut = list(workbooks.rows_in_books(iter(batches), 200, 20_000))
    assert sum(map(len, cut)) == 550 and max(map(len, cut)) <= 200 and max(sum(len(t) for t, in c) for c in cut) <= 21_000


def test_a_row_group_holds_few_chunks(spark):
    """Readers decode a row group at once, so stored chunks are bounded by number, not by their compressed bytes."""
    import pyarrow.parquet as pq

    made = io.BytesIO()
    xlsx_writer.write(made, {f"s{k}": [(k,)] for k in range(6)})
    own = xlsx.opened(spark, spark.createDataFrame([(f"{k}.xlsx", made.getvalue()) for k in range(9)], "path string, content binary").coalesce(1))
    groups = [g.row_group(k).num_rows for g in map(pq.read_metadata, own.inputFiles()) for k in range(g.num_row_groups)]
    assert sum(groups) == own.count() >= 9 * 6 and max(groups) <= parts.GROUP
    assert xlsx.cells(spark, own).count() == 9 * 6


def test_rows_are_made_of_values(spark, tmp_path):
    """Rows are grouped as values, not as cells: without strings they are hashed and not sorted."""
    xlsx_writer.write(str(tmp_path / "a.xlsx"), {"s": [("k", "v", "b", "t"), (1, 1.5, True, "x"), (2, None, False, None), (None, "2.5", 3, "#N/A")]})
    read = xlsx.cells(spark, str(tmp_path / "a.xlsx"))
    cells = spark.createDataFrame(read.collect(), read.schema)
    heads = header_relation(cells, ["path", "sheet"], 0)
    rows = rows_by_headers(cells, heads, StructType.fromDDL("k bigint, v double, b boolean"), ["path", "sheet"])
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[2:] for r in rows.collect()} == {(1, 1.5, True), (2, None, False), (None, 2.5, True)}
    texts = rows_by_headers(cells, heads, StructType.fromDDL("k bigint, t string"), ["path", "sheet"])
    assert {tuple(r)[2:] for r in texts.collect()} == {(1, "x"), (2, None), (None, "#N/A")}
    with pytest.raises(Exception, match="no bigint: x"):
        rows_by_headers(cells, heads, StructType.fromDDL("t bigint"), ["path", "sheet"], strict=True).collect()
