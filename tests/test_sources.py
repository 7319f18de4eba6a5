"""Readers on files made here."""

import gzip
import io
import plistlib
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.sources import documents, files, grids
from plumbline.streaming import findings


def xlsx(rows):
    def cell(v, r, c):
        ref = f"{chr(65 + c)}{r + 1}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, float) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(f'<row r="{r + 1}">' + "".join(cell(v, r, c) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {m}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    table = "group,value\nctrl,1.0\nctrl,1.2\nmut,3\nmut,NA\n"
    (tmp_path / "a.csv").write_text(table)
    (tmp_path / "b.tsv.gz").write_bytes(gzip.compress(table.replace(",", "\t").encode()))
    (tmp_path / "c.csv").write_text("group;value\nctrl;1,5\nctrl;2,5\nmut;3,5\n")
    (tmp_path / "d.xlsx").write_bytes(xlsx([["title"], ["group", "value"], ["ctrl", 1.0], ["mut", 2.0], ["mut", 4.0]]))
    (tmp_path / "~$d.xlsx").write_bytes(b"lock")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as inner:
        inner.writestr("in/e.csv", table)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as outer:
        outer.writestr("g.zip", z.getvalue())
    return tmp_path


def test_tables(spark, folder):
    content = files.contents(spark, str(folder))
    obs = grids.observations(grids.cells(content)).collect()
    by = {}
    for r in obs:
        by.setdefault(r["source"].rpartition("/")[2].rstrip("#"), []).append((r["group_key"], r["value"]))
    plain = [("ctrl", 1.0), ("ctrl", 1.2), ("mut", 3.0)]
    assert {k: sorted(v) for k, v in by.items()} == {"a.csv": plain, "b.tsv.gz": plain, "c.csv": [("ctrl", 1.5), ("ctrl", 2.5), ("mut", 3.5)], "d.xlsx#S": [("ctrl", 1.0), ("mut", 2.0), ("mut", 4.0)], "e.csv": plain}
    kinds = {r["path"].rpartition("/")[2]: r["kind"] for r in files.listed(spark, str(folder)).collect()}
    assert kinds == {"a.csv": "table", "b.tsv.gz": "table", "c.csv": "table", "d.xlsx": "table", "f.zip": "archive"}


def test_archives_that_lead_out():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("../x", "y")
    with pytest.raises(ValueError):
        list(files.members("a.zip", z.getvalue()))
    assert list(files.members("a.zip", b"none")) == []


def test_documents(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as out:
        out.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    df = lambda *rows: spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    assert [tuple(r) for r in documents.paragraphs(df(("a.docx", z.getvalue()), ("bad", b"x"))).collect()] == [("a.docx", 0, "One"), ("a.docx", 1, "Two")]
    pz = b'<GraphPadPrismFile><Table ID="T"><Title>Quant</Title><YColumn><Title>ctrl</Title><Subcolumn><d>1.5</d><d Excluded="1">9</d><d>2</d></Subcolumn></YColumn></Table></GraphPadPrismFile>'
    assert [tuple(r) for r in documents.prism(df(("a.pzfx", pz))).collect()] == [("a.pzfx", "Quant", "ctrl", 0, 1.5), ("a.pzfx", "Quant", "ctrl", 2, 2.0)]
    clip = "Welch Two Sample t-test\nt = -2.5, df = 7.9, p-value = 0.03\nsample estimates:\nmean in group a mean in group b \n 10.0 20.0"
    r = documents.residues(df(("c", plistlib.dumps({"UTI-Data": {"public.utf8-plain-text": clip}})), ("d", clip.encode()))).collect()
    assert {tuple(x)[1:] for x in r} == {("welch", -2.5, 7.9, 0.03, 10.0, 20.0)}
    xml = '<a><NominalMagnification>63</NominalMagnification><Distance Id="X"><Value>1e-7</Value></Distance></a>'
    got = {tuple(x)[1:] for x in documents.acquisitions(df(("z", b"\x00\x01" + xml.encode()), ("l", xml.encode("utf-16-le")))).collect()}
    assert [(m, a, round(p, 6)) for m, a, p in got] == [(63.0, None, 0.1)]
    assert documents.sidecars(df(("p.meta.json", b'{"objective_magnification": 40}'))).first()["magnification"] == 40
    assert sorted(x["label"] for x in documents.configs(df(("a.yaml", b"genotypes:\n  - A\n  - 'B'\nother:\n  - C"), ("b.json", b'{"groups": ["D"]}'))).collect()) == ["A", "B", "D"]
    lines = spark.createDataFrame([("m", 0, "%%MatrixMarket"), ("m", 1, "3 4 5"), ("m", 2, "1 1 1")], "path string, ord int, line string")
    assert tuple(documents.matrix_shapes(lines).first()) == ("m", 3, 4, 5)


def test_streaming(spark, tmp_path):
    schema = "source string, group_key string, value double"
    feed, store = tmp_path / "in", str(tmp_path / "store")

    def send(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(feed))
        q = findings.screen(spark.readStream.schema(schema).parquet(str(feed)), store, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None

    send("one", [("s", "a", float(i)) for i in range(4)])
    send("two", [("s", "b", float(i)) for i in range(4)])
    send("three", [("s", "c", 9.0), ("t", "x", 1.0)])
    told = spark.read.parquet(f"{store}/findings").collect()
    assert [(r["source"], r["group_a"], r["group_b"]) for r in told] == [("s", "a", "b")]


def test_windows_and_sessions(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    assert findings.windowed(e).agg(F.sum("n")).first()[0] == e.count() == findings.sessions(e).agg(F.sum("n")).first()[0]


def test_unreadable_and_fingerprints(spark):
    from plumbline.operators import ordered
    from plumbline.sources import files as file_source

    df = spark.createDataFrame([("a.docx", bytearray(b"no archive"))], "path string, content binary")
    assert documents.paragraphs(df).count() == 0
    assert [(r["path"], r["reason"].split(":")[0]) for r in documents.unreadable(df).collect()] == [("a.docx", "BadZipFile")]
    rows = [("x", "1"), ("y", "2"), ("z", "3")]
    mark = lambda r: tuple(file_source.set_fingerprint(spark.createDataFrame(r, "path string, sha string")).first())
    assert mark(rows) == mark(rows[::-1]) != mark([*rows[:2], ("z", "4")]) and mark(rows) != mark([*rows, rows[0]])
    assert list(ordered.chunked("one\ntwo\n\nthree\n\n" + "x" * 50, 12, 3)) == ["one\ntwo", "two three"] + [("x" * 50)[i : i + 12] for i in range(0, 50, 9)]
