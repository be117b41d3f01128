"""Rewriting with a way back, files as sources and sinks, retried micro-batches, templates and listings."""

import pytest

from corpuslens.operators import consistency, markdown, templates
from corpuslens.sources import datasource, docx, docx_writer, files, paging
from corpuslens.sources.publish import Published
from corpuslens.streaming import check_stream


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, text string, lang string")


def texts(df):
    return {r.doc_id: (r.text, r.lang) for r in df.collect()}


def renamed(d):
    """A change as cheap as can be, of the form of ``resequence``."""
    return d.selectExpr("doc_id", "replace(text, '图5', '图1') AS text", "contains(text, '图5') AS changed")


ROWS = ((1, "图5 甲\n见图 5", "zh"), (2, "plain", "en"), (3, None, None))


def test_dry_run_rewrite_and_restore(spark, tmp_path):
    table = Published(spark, f"{tmp_path}/t")
    with pytest.raises(LookupError):
        table.read()
    assert table.publish(docs(spark, *ROWS)) == 1
    dry = table.rewrite(markdown.resequence, dry_run=True).collect()
    assert [(r.doc_id, r.text, r.new_text) for r in dry] == [(1, "图5 甲\n见图 5", "图1 甲\n见图1")] and table.versions() == [1]
    assert [r.new_text for r in table.rewrite(markdown.resequence).collect()] == ["图1 甲\n见图1"]
    assert texts(table.read()) == {1: ("图1 甲\n见图1", "zh"), 2: ("plain", "en"), 3: (None, None)}
    assert table.read().columns == ["doc_id", "text", "lang"] and texts(table.read(1))[1][0] == "图5 甲\n见图 5"
    assert table.rewrite(renamed).count() == 0 and table.versions() == [1, 2]  # nothing left to change
    assert table.restore(1) == 3 and texts(table.read())[1][0] == "图5 甲\n见图 5" and table.versions() == [1, 2, 3]
    with pytest.raises(LookupError):
        table.restore(9)


def test_a_crash_between_the_phases_leaves_the_table(spark, tmp_path, monkeypatch):
    table = Published(spark, f"{tmp_path}/t")
    table.publish(docs(spark, *ROWS))

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Published, "switch", dies)
    with pytest.raises(RuntimeError):
        table.rewrite(renamed)
    monkeypatch.undo()
    assert table.versions() == [1] and texts(table.read())[1][0] == "图5 甲\n见图 5"
    assert table.rewrite(renamed).count() == 1 and table.versions() == [1, 2]


def test_of_two_writers_of_a_version_one_is_refused(spark, tmp_path):
    table = Published(spark, f"{tmp_path}/t")
    table.publish(docs(spark, *ROWS))
    mine, other = table.stage(docs(spark, (1, "mine", "x"))), table.stage(docs(spark, (1, "other", "x")))
    assert table.switch(mine, 1) == 2
    with pytest.raises(FileExistsError):
        table.switch(other, 1)
    assert texts(table.read()) == {1: ("mine", "x")}


def test_office_documents_as_a_source(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for i in range(5):
        (tmp_path / "in" / ("deep" if i % 2 else ".") / f"{i}.docx").write_bytes(docx_writer.docx_bytes([("heading", 1, f"T{i}"), ("para", 0, "x")]))
    (tmp_path / "in" / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "other.txt").write_text("x")
    rows = spark.read.format("corpuslens_docx").option("filesPerPartition", 2).load(f"{tmp_path}/in")
    assert rows.rdd.getNumPartitions() == 3
    got = sorted((r.path.rpartition("/")[2], r.seq, r.kind, r.text) for r in rows.collect())
    assert got == sorted([("bad.docx", 0, "unreadable", "")] + [(f"{i}.docx", k, *e) for i in range(5) for k, e in enumerate([("heading", f"T{i}"), ("para", "x")])])
    assert spark.read.format("corpuslens_docx").load(f"{tmp_path}/none").count() == 0
    # The same as through the table of files.
    other = docx.docx_events(docx.read_docx(spark, f"{tmp_path}/in"))
    assert sorted((r.seq, r.kind, r.text) for r in other.collect()) == sorted(x[1:] for x in got)


def test_files_as_a_sink(spark, tmp_path):
    rows = spark.createDataFrame([(f"a/{i}.html", f"page {i}") for i in range(20)], "name string, content string").repartition(4)
    datasource.write_files(rows, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out" / "a").iterdir()) == sorted(f"{i}.html" for i in range(20))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a"] and (tmp_path / "out/a/7.html").read_text() == "page 7"
    with pytest.raises(Exception, match="written already"):
        datasource.write_files(rows, f"{tmp_path}/out")
    datasource.write_files(rows.limit(1).selectExpr("name", "'new' AS content"), f"{tmp_path}/out", overwrite=True)
    assert sum(p.read_text() == "new" for p in (tmp_path / "out" / "a").iterdir()) == 1


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    good = [(f"{i}.html", "x") for i in range(8)]
    for bad in (("../escape.html", "x"), ("", "x"), ("7.html", "twice")):
        rows = spark.createDataFrame([*good, bad], "name string, content string").repartition(3)
        with pytest.raises(Exception):  # noqa: B017
            datasource.write_files(rows, f"{tmp_path}/out")
        assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    assert not (tmp_path / "escape.html").exists()


def test_a_batch_run_again_leaves_its_rows_once(spark, tmp_path):
    check = lambda d: consistency.check_placeholder_leak(d)
    docs(spark, (1, "示例 0x12", "zh")).write.parquet(f"{tmp_path}/in")
    stream = lambda state: check_stream(spark.readStream.schema("doc_id bigint, text string, lang string").parquet(f"{tmp_path}/in"), check, f"{tmp_path}/out", f"{tmp_path}/{state}").awaitTermination()
    stream("a")
    docs(spark, (2, "示例 0x34", "zh")).write.mode("append").parquet(f"{tmp_path}/in")
    stream("a")
    read = lambda: sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert read() == [1, 2]
    stream("lost state")  # batch 0 again, of both files
    assert read().count(2) <= 2 and read().count(1) == 1


def test_retention_and_consensus(spark):
    names = [f"2024-{m:02d}-{d:02d}-01-x.md" for m in (1, 2, 3) for d in (1, 2, 3, 4)] + ["2024-03-04-02-x.md", "2024-02-30-01-x.md", "notes.md"]
    rows = spark.createDataFrame([("a", n) for n in names] + [("b", n) for n in names[:2]] + [("b", None)], "category string, name string")
    got = {(r.category, r.name): r for r in templates.template_retention(rows).collect()}
    kept = [n for c, n in got if c == "a" and got[c, n].place]
    assert len(kept) == 10 and got["a", "2024-03-04-02-x.md"].place == 1 and not got["a", "2024-01-03-01-x.md"].kept and got["a", "2024-01-04-01-x.md"].kept
    assert got["a", "2024-02-30-01-x.md"].stored_on is None and got["a", "2024-02-30-01-x.md"].kept and got["a", "notes.md"].place is None
    assert {r.consensus for (c, _), r in got.items() if c == "a"} == {True} and {r.consensus for (c, _), r in got.items() if c == "b"} == {False}


def test_the_first_tier_that_has_a_template(spark):
    asked = spark.createDataFrame([(1, "a", "t"), (2, "a", "u"), (3, "c", "u"), (4, "d", "u"), (5, "b", None)], "request_id int, category string, topic string")
    confirmed = spark.createDataFrame([("t", "own2.md"), ("t", "own1.md")], "topic string, name string")
    archived = spark.createDataFrame([("a", f"2024-01-0{i}-01-x.md") for i in (1, 2, 3)] + [("c", "2024-01-01-01-x.md"), ("c", "x.md"), ("c", "y.md")], "category string, name string")
    built_in = spark.createDataFrame([("a", "in.md"), ("c", "in2.md"), ("c", "in1.md")], "category string, name string")
    got = {r.request_id: (r.tier, r.template) for r in templates.template_choice(asked, confirmed, archived, built_in).collect()}
    assert got == {1: (1, "own1.md"), 2: (2, "consensus"), 3: (3, "in1.md"), 4: (0, None), 5: (0, None)}


def test_pages_of_a_listing(spark):
    tree = spark.createDataFrame([(f"f{i:02d}.py", bytearray(("x\n" * n).encode())) for i, n in enumerate([0, 49, 50, 120, 1])], "path string, content binary").withColumn("length", __import__("pyspark").sql.functions.lit(0))
    pages = {r.path: (r.file_no, r.first_page, r.last_page) for r in paging.file_pages(tree).collect()}
    assert pages == {"f00.py": (1, 3, 3), "f01.py": (2, 4, 4), "f02.py": (3, 5, 6), "f03.py": (4, 7, 9), "f04.py": (5, 10, 10)}
    lines = paging.source_pages(tree).collect()
    assert max(r.place for r in lines) == 50 and len({(r.page, r.place) for r in lines}) == len(lines) == 5 + 220
    assert [r.line for r in lines if r.page == 10 and r.place == 1] == ["文件：f04.py（1 行）"]
    assert paging.source_pages(tree.limit(0)).count() == 0
    plan = paging.file_pages(tree)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]


def test_listing_pages_of_many_files_need_no_single_task(spark):
    tree = spark.range(300).selectExpr("concat('d/', lpad(cast(id as string), 4, '0'), '.sql') AS path", "cast(repeat('a\n', cast(id % 130 as int)) AS binary) AS content")
    pages = {r.path: r.first_page for r in paging.file_pages(tree).collect()}
    page, want = 1 + -(-302 // 50) + 1, {}
    for i in range(300):
        want[f"d/{i:04d}.sql"] = page
        page += -(-(i % 130 + 1) // 50)
    assert pages == want and files.source_line_counts(tree).count() == 300
