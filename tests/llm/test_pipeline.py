import random

import __spark_entry__ as entry
import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(120)]
    passage = " ".join(word() for _ in range(15))
    junk = [" ".join(w + "##$" for w in t.split()) for t in clean[:40]]
    leaked = [clean[50] + " " + passage]
    near = [clean[7] + " end", clean[8]]
    texts = clean + junk + leaked + near + [None, "", "short"]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = now.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, d)
        assert k == 4 or now.columns == columns, name
        now.write.parquet(f"{d}/{k}")
        now = spark.read.parquet(f"{d}/{k}")
        kept.append({r.doc_id for r in now.collect()})
    assert kept[0] == set(range(120)) | {160, 161, 162}
    assert kept[1] == kept[0] - {161, 162}
    assert kept[2] == kept[1] - {160}
    assert kept[4] == kept[3] <= kept[2]
    rows = spark.read.parquet(f"{d}/4").collect()
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, d).collect()))


def test_entry_lists_all_queries():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
