"""Sizes of images by their bytes, pages and office documents that hold them, captions."""

import base64
import io
import struct
import zipfile

import pytest

from corpuslens.operators import images, markdown
from corpuslens.sources import docx, docx_writer, files, storage

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 300, 700) + b"\x08\x02\0\0\0rest"
GIF = b"GIF89a" + struct.pack("<HH", 640, 48) + b"\xf7\0\0"
SOF = lambda h, w, m=0xC0: bytes([0xFF, m]) + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\x01\x22\0\x02\x11\x01\x03\x11\x01"
APP = b"\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0"
JPEG = b"\xff\xd8" + APP + b"\xff\xfe\0\x05abc" + b"\xff\xff\xff\xc4\0\x04\x01\xaa" + SOF(30, 70, 0xC2) + b"\xff\xda"
MANY = b"\xff\xd8" + b"\xff\xfe\0\x02" * 1000 + SOF(5, 9)


@pytest.mark.parametrize(("content", "want"), [(PNG, ("png", 300, 700)), (GIF, ("gif", 640, 48)), (JPEG, ("jpeg", 70, 30)), (MANY, ("jpeg", 9, 5)), (PNG[:20], ("png", None, None)), (b"\xff\xd8\xff\xe0", ("jpeg", None, None)), (b"\xff\xd8" + APP + b"\xff\xda" + SOF(1, 1), ("jpeg", None, None)), (b"\xff\xd8\xff\xe0\xff\xff", ("jpeg", None, None)), (b"", (None, None, None)), (None, (None, None, None)), (b"RIFF....WEBP", (None, None, None))])
def test_headers(spark, content, want):
    row = images.image_sizes(spark.createDataFrame([("a/b.JPG", content)], "path string, content binary")).first()
    assert (row.kind, row.width, row.height) == want and row.mime == "image/jpeg"


def test_fit_and_mime(spark):
    png = lambda w, h: PNG[:16] + struct.pack(">II", w, h) + PNG[24:]
    rows = {r.path: r for r in images.image_sizes(spark.createDataFrame([("wide.png", png(100, 50)), ("tall", png(100, 200)), ("x.webp", png(0, 5)), ("a.b/c.GIF", png(1, 1))], "path string, content binary")).collect()}
    assert (rows["wide.png"].width_cm, rows["wide.png"].height_cm) == (14.5, 7.25)
    assert (rows["tall"].width_cm, rows["tall"].height_cm) == (11, 22) and rows["x.webp"].width_cm is None
    assert [rows[p].mime for p in ("wide.png", "tall", "x.webp", "a.b/c.GIF")] == ["image/png", "image/png", "image/webp", "image/gif"]


DOCS = [(1, "t/a.md", "# T\n![one](../i/p.png)\n\n图1 its caption\ntext\n![gone <x>](./none.png)\n![abs](/i/q.gif)"), (1, "t/a.md", "![one](../i/p.png)"), (2, "b.md", None), (3, "c.md", "```\n![code](i/p.png)\n```")]
FILES = [("i/p.png", PNG), ("/i/q.gif", GIF), ("unused.png", PNG)]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, path string, text string"), spark.createDataFrame(FILES, "path string, content binary")


def test_pages_hold_their_images(spark, tmp_path):
    docs, held = frames(spark)
    pages = sorted((r.doc_id, r.html) for r in images.html_with_images(docs, held).collect())
    data = f'<img src="data:image/png;base64,{base64.b64encode(PNG).decode()}" alt="one" style="max-width:100%">'
    assert pages[0] == (1, f"<h1>T</h1>\n{data}\n<p>图1 its caption</p>\n<p>text</p>\n" + '<p style="color:red">[缺失图片: ./none.png]</p>\n' + f'<img src="data:image/gif;base64,{base64.b64encode(GIF).decode()}" alt="abs" style="max-width:100%">')
    assert pages[1] == (1, data) and pages[2] == (2, "") and "data:" not in pages[3][1]
    linked = [r.html for r in images.html_with_images(docs, held, embed=False).collect() if "abs" in r.html]
    assert 'src="file:///i/q.gif"' in linked[0]
    files.write_html(images.html_with_images(docs.where("doc_id > 1"), held), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["2.html", "3.html"]
    page = (tmp_path / "out" / "3.html").read_text()
    assert page.startswith("<!DOCTYPE html>") and "<style>" in page and "border-collapse" in page


def test_office_documents_hold_images_and_captions(spark):
    docs, held = frames(spark)
    made = {r.doc_id: bytes(r.content) for r in docx_writer.md_to_docx(docs.where("text LIKE '# T%'"), held).collect()}
    with zipfile.ZipFile(io.BytesIO(made[1])) as z:
        assert [z.read(n) for n in sorted(z.namelist()) if "media" in n] == [PNG, GIF]
        body = z.read("word/document.xml").decode()
        assert 'r:embed="i1"' in body and "Target=\"media/image2.gif\"" in z.read("word/_rels/document.xml.rels").decode()
        cx, cy = (round(x * 360000) for x in (22 / (700 / 300), 22.0))
        assert f'<wp:extent cx="{cx}" cy="{cy}"/>' in body
        assert '<w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="宋体" w:eastAsia="宋体"/><w:b/><w:sz w:val="21"/>' in body
    events = docx.events_of(made[1])
    assert [e[0] for e in events] == ["heading", "image", "para", "para", "para", "image"] and events[4][2] == "[缺失图片: ./none.png]"


def test_office_documents_of_rows_that_share_an_id(spark):
    docs, held = frames(spark)
    made = docx_writer.md_to_docx(docs, held)
    kinds = sorted([e[0] for e in docx.events_of(bytes(r.content))] for r in made.collect())
    assert kinds == [["code"], ["heading", "image", "para", "para", "para", "image"], ["image"]]


def test_headings_go_four_deep(spark):
    made = docx_writer.docx_bytes([("heading", 6, "deep"), ("heading", 2, "x")])
    assert [(e[0], e[1]) for e in docx.events_of(made)] == [("heading", 4), ("heading", 2)]


def test_captions_wait_over_blank_lines_only(spark):
    text = "图0 no\n![a](b)\n\n---\n图1 yes\n图2 no\n| a |\n|---|\n表１２ yes\n![a](b)\ntext\n图4 no\n![a](b)\n```\n```\n图5 no\n![a](b)\n> q\n图6 no\n![a](b)\n图 7 no\n| a |\n|---|\n| 1 |\n\n图8 yes"
    rows = markdown.md_captions(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).collect()
    assert [(r.line_no, r.kind, r.number, r.of) for r in rows] == [(5, "图", "1", "image"), (9, "表", "12", "table"), (26, "图", "8", "table")]
    kinds = [r.kind for r in markdown.md_events(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), captions=True).orderBy("seq").collect()]
    assert kinds.count("caption") == 3


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"{i:03d}", i) for i in range(200)], "k string, v long").repartition(5)
    got = {r.k: (r.before, r.n) for r in storage.running_sums(rows, ["k"], {"before": F.col("v"), "n": F.lit(1)}, parts=7).collect()}
    assert got == {f"{i:03d}": (i * (i - 1) // 2, i) for i in range(200)}
