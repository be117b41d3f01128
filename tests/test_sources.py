import pytest

from corpuslens import streaming
from corpuslens.operators import audit
from corpuslens.sources import files


def test_source_tree(spark, tmp_path):
    for name, text in {"a.py": "x\ny\n", "lib/b.ts": "z", "node_modules/c.js": "n", "d.min.js": "m", "Dockerfile": "F\n", "notes.txt": "t", "skip/e.go": "g"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.c").write_bytes(b"\xff\xfe\n\n")
    got = files.source_files(files.read_tree(spark, str(tmp_path)), exclude=("skip",))
    assert {r.path: r.n_lines for r in files.source_line_counts(got).collect()} == {"a.py": 2, "lib/b.ts": 1, "Dockerfile": 1, "bad.c": 0}
    assert tuple(files.source_summary(got).first()) == (4, 4, 4)
    assert {r.path for r in files.source_files(files.read_tree(spark, str(tmp_path)), include=("lib",)).collect()} == {"lib/b.ts"}


def test_documents(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"x\r\ny")
    path = str(tmp_path / "a.md")
    assert files.read_documents(spark, [path, str(tmp_path / "none.md")]).first().text == "x\ny"
    with pytest.raises(ValueError):
        files.read_documents(spark, [path], strict=True)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "不断"), (2, "x")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in" / "p"))
    streaming.check_stream(stream, audit.ai_flavor_hits, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
