import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_views import frame

from haulframe.sources import files, tables
from haulframe.streaming import extraction

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def archive(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(paragraphs: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    return archive({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'})


def xlsx(rows: list[list], title: str = "One") -> bytes:
    def cell(i, j, v):
        ref = f'r="{chr(65 + j) if j < 26 else "A" + chr(65 + j - 26)}{i + 1}"'
        return "" if v is None else f'<c {ref} t="s"><v>0</v></c>' if v == "shared" else f"<c {ref}><v>{v}</v></c>" if not isinstance(v, str) else f'<c {ref} t="inlineStr"><is><t>{v}</t></is></c>'

    sheet = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</row>' for i, r in enumerate(rows))
    return archive({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{title}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>shared text</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData>{sheet}</sheetData></worksheet>',
    })


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("storage")
    (root / "u1").mkdir()
    grid = [[1, None, "x", 2.5], ["shared"], *[[i] * 25 for i in range(150)]]
    for name, content in {"a.docx": docx(["first", " ", "second &amp; last"]), "b.XLSX": xlsx(grid), "c.png": b"picture", "d.pdf": b"%PDF text", "e.pdf": b"%PDF scan", "f.txt": b"x", "g.docx": b"broken"}.items():
        (root / "u1" / name).write_bytes(content)
    return root


@pytest.fixture(scope="module")
def stored(spark, landing):
    names = ["a.docx", "b.XLSX", "c.png", "d.pdf", "e.pdf", "f.txt", "g.docx", "gone.docx"]
    docs = frame(spark, "documents", [{"id": n[0] if n != "gone.docx" else "z", "filename": n, "object_key": f"u1/{n}"} for n in names])
    return files.stored(docs, files.read_files(spark, str(landing)), str(landing))


def test_texts_without_extra_readers(stored):
    got = {r["id"]: (r["text"], r["error"]) for r in files.texts(stored).collect()}
    assert got["a"] == ("first\n \nsecond & last", None)
    assert got["b"][0].split("\n")[:3] == ["1 | x | 2.5", "shared text", " | ".join(["0"] * 25)]
    assert "no reader for images" in got["c"][1] and "no reader for PDF" in got["d"][1]
    assert "unsupported" in got["f"][1] and "BadZipFile" in got["g"][1] and "FileNotFoundError" in got["z"][1]


def test_texts_with_given_readers(stored):
    readers = files.Readers(pdf_text=lambda b: [b[5:].decode()] if b"text" in b else [" "], pdf_images=lambda b, scale: [b"page"] * scale, ocr=lambda image: f"read {image.decode()}", prepare=lambda b: b[::-1])
    got = {r["id"]: r["text"] for r in files.texts(stored, readers).collect()}
    assert got["c"] == "read erutcip" and got["d"] == "text" and got["e"] == "read page\nread page"


def test_previews(stored):
    got = {r["id"]: r for r in files.previews(stored).collect()}
    assert (got["a"]["type"], got["a"]["lines"]) == ("document", ["first", "second & last"])
    assert (got["b"]["type"], got["b"]["sheet"], len(got["b"]["rows"]), {len(r) for r in got["b"]["rows"]}) == ("spreadsheet", "One", 100, {20})
    assert got["b"]["rows"][0][:5] == ["1", "", "x", "2.5", ""]
    assert got["c"]["type"] == "binary" and "FileNotFoundError" in got["z"]["error"]


def test_allow_list(spark):
    rows = spark.createDataFrame([("a.PDF",), ("a.webp",), ("a.txt",), ("pdf",), (".pdf",)], "f string")
    assert [r[0] for r in rows.select(files.supported(F.col("f"))).collect()] == [True, True, False, False, False]


def test_stream_reads_each_file_once(spark, landing, tmp_path):
    got = []
    for _ in range(2):
        stream = extraction.extract_stream(extraction.arriving(spark, str(landing), 3), lambda df, n: got.extend(df.select("id", "error").collect()), str(tmp_path / "cp"), once=True)
        stream.awaitTermination(60)
    assert len(got) == 7 and sum(r["error"] is None for r in got) == 2


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    one, two = frame(spark, "vendors", [{"id": "1"}]), frame(spark, "vendors", [{"id": "1"}, {"id": "2"}])
    tables.publish({"vendors": one, "audit_logs": frame(spark, "audit_logs", [])}, root, "v1")
    assert tables.current(spark, root, "vendors").count() == 1
    tables.publish({"vendors": two}, root, "v2")
    two.write.parquet(f"{root}/vendors/v3")  # written, but never named
    assert tables.current(spark, root, "vendors").count() == 2
    assert tables.current(spark, root, "payments").count() == 0


def test_append_and_evolution(spark, tmp_path):
    path = str(tmp_path / "deliveries")
    frame(spark, "deliveries", [{"id": "1"}]).drop("recipient", "purchase_id").write.parquet(path)
    tables.append(frame(spark, "deliveries", [{"id": "2", "recipient": "r"}]), path, "deliveries")
    assert {r["id"]: r["recipient"] for r in tables.read_declared(spark, path, "deliveries").collect()} == {"1": None, "2": "r"}
    assert "recipient" in tables.read(spark, path, "deliveries").columns


def test_seed(spark):
    first = frame(spark, "users", [{"id": "1", "email": "admin@example.org", "role": "ADMIN", "created_at": datetime(2024, 1, 1)}])
    assert tables.seed_admin(frame(spark, "users", []), first).count() == 1
    assert [r["id"] for r in tables.seed_admin(frame(spark, "users", [{"id": "7"}]), first).collect()] == ["7"]


def test_only_the_bodys_own_paragraphs(spark):
    inner = "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    content = archive({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{inner}</w:body></w:document>'})
    assert files.docx_paragraphs(content) == ["a\tblink"]


def test_dates_in_spreadsheets():
    styles = f'<styleSheet xmlns="{S}"><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;x&quot;"/><numFmt numFmtId="165" formatCode="[Red]0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="21"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="46"/></cellXfs></styleSheet>'
    cells = "".join(f'<c s="{s}"><v>{v}</v></c>' for s, v in ((0, 45352), (1, 45352), (1, "45352.5"), (2, 0.25), (3, 59), (4, 3.5), (5, 1.5)))
    content = archive({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>',
    })
    assert files.xlsx_text(content) == "45352 | 2024-03-01 00:00:00 | 2024-03-01 12:00:00 | 06:00:00 | 1900-02-28 00:00:00 | 3.5 | 1 day, 12:00:00"


def test_only_matched_files_are_read(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]))
    docs = spark.createDataFrame([("a", "1.bin"), ("b", "1.bin"), ("c", "9.bin"), ("d", None)], "id string, object_key string")
    for most in (10, 0):
        got = files.stored(docs, files.read_files(spark, str(tmp_path)), str(tmp_path), most)
        assert sorted((r["id"], r["found"], r["content"] and bytes(r["content"])) for r in got.collect()) == [("a", True, b"\x01"), ("b", True, b"\x01"), ("c", False, None), ("d", False, None)]


def test_jdbc_in_key_ranges(spark):
    url = "jdbc:derby:memory:haul;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(50).selectExpr("CAST(id AS INT) AS n", "CAST(id AS STRING) AS id", "concat('V', id) AS vendor_code", "'Acme' AS legal_name")
    rows.write.format("jdbc").option("url", url).option("dbtable", "vendors").option("driver", driver).mode("overwrite").save()
    whole = tables.read_jdbc(spark, url, "vendors", driver=driver)
    assert whole.count() == 50 and whole.columns[0] == "id" and whole.where("status IS NULL").count() == 50
    ranged = tables.read_jdbc(spark, url, "vendors", key="n", bounds=(0, 50), partitions=4, driver=driver)
    assert ranged.rdd.getNumPartitions() == 4 and ranged.exceptAll(whole).isEmpty()
