import zipfile

import pyarrow as pa

from corpuslens.operators import markdown, relations
from corpuslens.plans import fixtures as X
from corpuslens.sources import docx, docx_format, docx_writer

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def write(path, body, size=(11906, 16838)):
    styles = f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="LB"><w:name w:val="List Bullet"/></w:style></w:styles>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/styles.xml", styles)
        z.writestr("word/document.xml", f'<w:document {NS}><w:body>{body}<w:sectPr><w:pgSz w:w="{size[0]}" w:h="{size[1]}"/></w:sectPr></w:body></w:document>')


def p(text, style="", font=""):
    s = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    f = f'<w:rPr><w:rFonts w:ascii="{font}"/></w:rPr>' if font else ""
    return f"<w:p>{s}<w:r>{f}<w:t>{text}</w:t></w:r></w:p>"


def test_events_and_page_size(spark, tmp_path):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Title", "H1") + p("item", "LB") + p("x = 1", font="Consolas") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>" + p("bold text")
    write(tmp_path / "a.docx", body)
    write(tmp_path / "b.docx", p("x"), (12240, 15840))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    files = docx.read_docx(spark, str(tmp_path))
    ids = {r.path.rpartition("/")[2]: r.doc_id for r in files.collect()}
    events = docx.docx_events(files)
    got = [(r.kind, r.level, r.text) for r in events.where(events.doc_id == ids["a.docx"]).orderBy("seq").collect()]
    assert got == [("heading", 1, "Title"), ("bullet", 0, "item"), ("code", 0, "x = 1"), ("table", 0, "a\x1fb\n1\x1f2"), ("para", 0, "bold text")]
    assert [r.kind for r in events.where(events.doc_id == ids["c.docx"]).collect()] == ["unreadable"]
    readable = files.where(files.path.endswith("a.docx") | files.path.endswith("b.docx"))
    assert [r.doc_id for r in docx.page_size_issues(readable).collect()] == [ids["b.docx"]]
    text = "# Title\n- item\n```\nx = 1\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n**bold** text"
    left = markdown.md_events(relations.documents(spark.createDataFrame([(ids["a.docx"], text)], "doc_id bigint, text string")))
    assert markdown.compare_events(left, events.where(events.doc_id == ids["a.docx"])).count() == 0


def test_written_files_read_back_the_same(spark):
    text = "# Title\n\npara **b** `c` & <x>\n- item\n1. one\n> quoted\n![pic](p.png)\n| a | b |\n|---|---|\n| 1 | |\n```\nx = 1\n\n```\n#### deep\x0b"
    left = markdown.md_events(relations.documents(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, text string")))
    right = docx.docx_events(docx_writer.write_docx(left))
    assert markdown.compare_events(left, right).count() == 0 and left.count() == right.count()


def _styled(text, font, size, more="", bold=False):
    return f'<w:p><w:pPr>{more}</w:pPr><w:r><w:rPr><w:rFonts w:ascii="Arial" w:eastAsia="{font}"/>{"<w:b/>" if bold else ""}<w:sz w:val="{int(size * 2)}"/></w:rPr><w:t>{text}</w:t></w:r></w:p>'


def test_format_rules(spark, tmp_path):
    head, image = '<w:pStyle w:val="H1"/>', '<w:p><w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="{}" cy="1"/></wp:inline></w:drawing></w:r></w:p>'
    body = _styled("一 章", "楷体", 14, head) + _styled("正文一", "宋体", 12, '<w:ind w:firstLine="480"/><w:spacing w:line="360"/>') + _styled("正文二", "隶书", 13) + _styled("封面", "宋体", 22) + _styled("图 1 总览", "宋体", 9) + _styled("居中", "x", 9, '<w:jc w:val="center"/>')
    body += "<w:tbl><w:tr/></w:tbl><w:tbl><w:tblPr><w:tblBorders/></w:tblPr></w:tbl>" + image.format(9_000_000) + image.format(36_000) + p("x = 1", font="Consolas")
    write(tmp_path / "bad.docx", body, (12240, 15840))
    content = (tmp_path / "bad.docx").read_bytes()
    files = spark.createDataFrame([(1, content), (2, b"no zip"), (3, None)], "doc_id bigint, content binary")
    facts = docx_format.docx_facts(files)
    got = {(r.rule, r.subject, r.n, r.of, r.detail) for r in docx_format.format_issues(facts, docx_format.rules_of("academic")).collect()}
    assert got == {("page size", "page", 1, 1, "21.6x27.9"), ("heading font", "heading 1", 1, 1, "楷体"), ("heading not bold", "heading 1", 1, 1, ""), ("body font", "body", 2, 2, "隶书"), ("body size", "body", 2, 2, "13.0"), ("body indent", "body", 1, 2, ""), ("table border", "table", 1, 2, "1")}
    loose = docx_format.rules_of("technical", '{"page": {"tolerance_cm": 5}, "body": {"fonts": ["宋体", "隶书"], "size_pt": [12, 13]}, "heading": {"fonts": ["楷体"], "bold_required": false}, "table": {"border_required": false}, "require_header": true}')
    assert [r.rule for r in docx_format.format_issues(facts, loose).collect()] == ["header missing"]
    notes = {(r.what, r.value): r.n for r in docx_format.format_notes(facts).collect()}
    assert notes[("group", "body")] == 2 and notes[("group", "cover")] == 2 and notes[("group", "caption")] == notes[("group", "code")] == notes[("group", "heading")] == 1
    assert notes[("indent", "24")] == 1 and notes[("spacing", "1.5")] == 1 and notes[("table", "")] == 2 and notes[("image", "")] == 2


def test_rows_of_one_id_are_files_of_their_own(spark):
    docs = relations.documents(spark.createDataFrame([(1, "# A\n- x"), (1, "B"), (2, "")], "doc_id bigint, text string"))
    files = docx_writer.docx_files(markdown.event_arrays(docs)).collect()
    assert sorted(docx.events_of(bytes(r.content)) for r in files) == [[("heading", 1, "A"), ("bullet", 0, "x")], [("para", 0, "B")]]


def test_batches_are_cut_to_pieces_of_bounded_size(spark):
    whole = pa.RecordBatch.from_pydict({"doc_id": range(9), "content": [b"x" * docx.PIECE * (i == 4) + b"y" * 400_000 for i in range(9)]})
    cut = list(docx.pieces([whole, whole.slice(0, 0)]))
    assert all(b.num_rows == 1 or b.nbytes <= docx.PIECE for b in cut) and pa.Table.from_batches(cut).equals(pa.Table.from_batches([whole]))


def test_files_are_read_once_for_notes(spark):
    facts = docx_format.docx_facts(spark.createDataFrame([(1, b"no zip")], "doc_id bigint, content binary"))
    plan = docx_format.format_notes(facts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_edits_within_rows_are_those_of_events(spark):
    docs = spark.createDataFrame([(i, "# T\n![p](q)\n| a | y |\n|---|---|\n| 1 | y |\n" + "\n".join(f"p{k}" for k in range(25))) for i in range(13)], "doc_id bigint, text string")
    rows = markdown.event_arrays(docs)
    flat = rows.selectExpr("doc_id", "posexplode(events) AS (seq, e)").selectExpr("doc_id", "seq", "e.kind", "e.level", "e.text").where(f"NOT ({X.EDIT_GONE})")
    want = sorted(tuple(r) for r in flat.selectExpr("doc_id", "kind", f"{X.EDIT_LEVEL} AS level", f"{X.EDIT_TEXT} AS text").collect())
    assert sorted(tuple(r) for r in X.edited(rows).selectExpr("doc_id", "inline(events)").collect()) == want
