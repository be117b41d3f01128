"""Known inputs and boundary cases of the document checks."""

import random
import re

import pytest

from corpuslens.functions import text as T
from corpuslens.operators import audit, consistency, cross, markdown, relations


def docs(spark, *texts):
    return relations.documents(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_matches_have_their_positions(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab1 \n图３　é😀") for _ in range(rnd.randrange(60))) for _ in range(120)] + [None, ""]
    got = rows(T.find_all(docs(spark, *texts), [("x", T.FLAGS + r"图\s*(\d+)|a1")]), "doc_id", "nth", "start", "line_no", "text")
    want = [(i, n, m.start(), t[: m.start()].count("\n") + 1, m[0]) for i, t in enumerate(texts) for n, m in enumerate(re.finditer(r"图\s*(\d+)|a1", t or ""))]
    assert got == sorted(want) and want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("intro\n```sql\nselect 1\n```\nmore\n```sh\nls\n```", []),
        ("one\n\n```   \nbare block\n```\n\n```go\nx := 1\n```\n```\nagain\n```\n", [(False, 2, "3、10")]),
        ("body\n```yaml\na: 1\n", [(True, 0, "")]),
        ("nothing fenced `here` at all", []),
    ],
)
def test_code_fences(spark, text, want):
    assert rows(audit.code_fence_issues(docs(spark, text)), "unclosed", "unlabelled", "lines") == want


def test_terms_outside_code(spark):
    texts = ("服务以 JSON 返回结果，配置见 `json` 一节。", "用 Docker 部署：\n~~~\ndocker run x\n~~~\n", "导出 JSON 文件；Json 与 JSON 相同。")
    assert rows(audit.term_variants(docs(spark, *texts)), "doc_id", "term", "variants") == [(2, "JSON", "JSON、Json")]
    assert [r.key for r in cross.doc_terms(docs(spark, "先启动 Broker ，再停 Broker 。另见 `Worker` 和 `Worker`。")).collect()] == ["Broker"]


def test_quotes(spark):
    texts = ('点击 "确定" 后生效。\n第二行没有。', '配置如下：\n```toml\nname = "值"\n```\n结束。', "An “odd” one\nwith \"straight\" ones")
    assert rows(audit.quote_issues(docs(spark, *texts)), "doc_id", "line_no") == [(0, 1), (2, 1), (2, 1)]


def test_gaps(spark):
    texts = ("见图 2 与图 3。\n图1 甲", "表1 表1 表5 表2 表5 表9", "图　3", "图３", "表" + "9" * 50, None)
    got = rows(audit.figure_table_gaps(docs(spark, *texts)), "doc_id", "seq", "found", "expected")
    assert got == [(0, 0, "2", "1"), (1, 2, "5", "2"), (1, 5, "9", "6"), (2, 0, "3", "1"), (3, 0, "3", "1"), (4, 0, "9" * 50, "1")]


@pytest.mark.parametrize("n", [19, 20, 38, 39, 50])
def test_numbers_of_any_length(spark, n):
    nines, wide = "9" * n, "９" * n
    text = f"图{nines}\n图 1{'0' * n}\n见图{wide}、图 {'0' * n}7，图1{'0' * (n - 1)}2。"
    d = docs(spark, text, f"图1 甲\n见图{nines} 完", f"图{nines} 甲\n图{wide} 乙\n见图{'0' * n}{nines}")
    got = rows(audit.figure_table_gaps(d.where("doc_id = 0")), "seq", "found", "expected")
    assert got == [(0, nines, "1"), (4, f"1{'0' * (n - 1)}2", f"1{'0' * (n - 1)}1")]
    assert {r.doc_id: r.n_figure_table for r in audit.audit_report(d).collect()} == {0: 2, 1: 1, 2: 1}
    assert audit.audit_score(d).count() == 3
    assert {r.doc_id: r.text for r in markdown.resequence(d.where("doc_id > 0")).collect()} == {1: f"图1 甲\n见图{nines} 完", 2: "图1 甲\n图2 乙\n见图2"}


def test_language_and_empty_talk(spark):
    assert rows(relations_language(spark, "", "中a", "ab中"), "doc_id", "l") == [(0, "zh"), (1, "zh"), (2, "en")]
    line = "x" * (119 - 4) + "值得关注"
    assert len(audit.empty_talk_issues(docs(spark, line, "x" + line)).collect()) == 1


def relations_language(spark, *texts):
    return docs(spark, *texts).select("doc_id", relations.language("text").alias("l"))


def test_sections(spark):
    got = rows(audit.section_jumps(docs(spark, "## 1. A\n#### 1.1.1 C", "## 1.\n#### 1.1.1")), "doc_id", "kind")
    assert got == [(0, "depth"), (0, "level")]


def test_score_is_capped_and_zero_filled(spark):
    got = dict(rows(audit.audit_score(docs(spark, "不断" * 20, "plain", None)), "doc_id", "score"))
    assert got == {0: 70, 1: 100, 2: 100}


def test_sentences(spark):
    got = rows(relations.sentences(docs(spark, "a。b！ c\x0bd;\n\ne", "")), "doc_id", "line_no", "sent_no", "sentence")
    assert got == [(0, 1, 0, "a。"), (0, 1, 1, "b！"), (0, 1, 2, "c"), (0, 2, 0, "d;"), (0, 4, 0, "e")]


@pytest.mark.parametrize(("gap", "half", "hits"), [(40, "取一半", 1), (41, "取一半", 0), (3, "单程是一半", 0)])
def test_delay(spark, gap, half, hits):
    assert consistency.check_delay(docs(spark, "RTT 大\n" + "x\n" * (gap - 1) + half)).count() == hits


@pytest.mark.parametrize(("gap", "hits"), [(8, 0), (9, 1)])
def test_sequence_basis(spark, gap, hits):
    assert consistency.check_sequence_basis(docs(spark, "相对序号\n" + "x\n" * (gap - 1) + "原始序号")).count() == hits


@pytest.mark.parametrize(("shift", "hits"), [(-4, 0), (-3, 1), (6, 1), (7, 0)])
def test_placeholder(spark, shift, hits):
    lines = ["x"] * 20
    lines[8], lines[8 + shift] = "示例", "0x002"
    assert consistency.check_placeholder_leak(docs(spark, "\n".join(lines))).count() == hits


def test_quantities(spark):
    texts = ("时延 50ms 和时延 60ms", "时延 50ms 和时延 60ms 为示例", "文件大小 1KB 与文件大小 2kb", "时延 50ms" + "x" * 80 + "时延 60ms" + "y" * 70 + "示例")
    assert rows(consistency.check_quantities(docs(spark, *texts)), "doc_id", "values") == [(0, "50, 60"), (3, "50, 60")]


def test_versions(spark):
    got = rows(cross.doc_versions(docs(spark, "2026.1 2.0 v2.0 2.1.0 113.98956 v1234.5", "版本2.1.0发布")), "doc_id", "key")
    assert got == [(0, "2.1.0"), (0, "v2.0")]


def test_companions(spark):
    texts = docs(spark, "Alpha; Alpha; Alpha.\n| m | x |\n|---|---|\n| a | 1 |", "Alpha\n| m | x |\n|---|---|\n| b | 1 |", "alone")
    sets = spark.createDataFrame([(1, 0), (1, 1), (2, 2)], "doc_set_id bigint, doc_id bigint")
    assert rows(cross.cross_terms(texts, sets), "doc_id", "key", "missing") == [(0, "Alpha", "1")]
    assert rows(cross.cross_modules(texts, sets), "doc_id", "missing", "extra") == [(1, "a", "b")]
    diff = spark.createDataFrame([(1, "--- x\n-10 MB\n+v3.2.1")], "doc_set_id bigint, diff_text string")
    both = docs(spark, "now 10MB", "still 10 MB")
    assert rows(cross.sync_check(diff, both, sets), "doc_id", "finding", "key") == [(0, "missing", "v3.2.1"), (1, "missing", "v3.2.1"), (1, "stale", "10 MB")]


def test_resequence(spark):
    texts = ("流程见图 7，参数见表 9。\n图7 登录流程\n表 9 参数一览\n其余见图 8。\n", "表 4 列出端口。\n表4 端口\n", "见图 5", "图3 甲 图3\n图 9", "图2 长" + "字" * 40 + "\n图2 短")
    got = {r.doc_id: r for r in markdown.resequence(docs(spark, *texts)).collect()}
    assert got[0].text == "流程见图1，参数见表1。\n图1 登录流程\n表1 参数一览\n其余见图8。\n"
    assert (got[0].n_figures, got[0].n_tables) == (1, 1)
    assert (got[1].n_tables, got[1].text) == (1, "表1 列出端口。\n表1 端口\n")
    assert (got[2].text, got[2].changed) == ("见图 5", False)
    assert got[3].text == "图1 甲 图1\n图2"
    assert got[4].text == "图1 长" + "字" * 40 + "\n图1 短"


def test_resequence_equals_a_plain_reading(spark):
    rnd = random.Random(21)
    parts = ["图", "图 ", "1", "2", "03", "12", "\n", "。", "字" * 9, "x", "图\n1", "见"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(30))) for _ in range(250)]

    def plain(text):
        found = list(re.finditer(r"图\s*(\d+)", text))
        caps = [m for m in found if (m.start() == 0 or text[m.start() - 1] == "\n") and re.match(r"[^。！？\n]{0,28}(\n|\Z)", text[m.end() :])]
        if not caps:
            return text
        new = {int(m[1]): k + 1 for k, m in enumerate(caps)}
        out, at = "", 0
        for m in found:
            out += text[at : m.start()] + "图" + str(caps.index(m) + 1 if m in caps else new.get(int(m[1]), int(m[1])))
            at = m.end()
        return out + text[at:]

    got = {r.doc_id: r.text for r in markdown.resequence(docs(spark, *texts)).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_markdown_events_and_html(spark):
    text = "# H\n| a | b |\n|---|---|\n| 1 | 2 |\n```py\nx < 1\n```\n- i\n- j\n> q\n1. n\n![p](u)\n---\n**b** `c`"
    d = docs(spark, text)
    kinds = [r.kind for r in markdown.md_events(d).orderBy("seq").collect()]
    assert kinds == ["heading", "table", "code", "bullet", "bullet", "quote", "number", "image", "para"]
    html = markdown.md_to_html(d).first().html
    assert "x &lt; 1" in html and "<ul><li>i</li><li>j</li></ul>" in html and "<p><strong>b</strong> <code>c</code></p>" in html and "<hr>" in html and "<th>a</th>" in html


def test_compare_events(spark):
    one = "doc_id bigint, seq int, kind string, level int, text string"
    left = spark.createDataFrame([(1, 0, "heading", 1, "A"), (1, 1, "image", 0, "p"), (1, 2, "para", 0, "**x** y"), (1, 3, "quote", 0, "q"), (1, 4, "table", 0, "a\x1fb\nc\x1fd")], one)
    right = spark.createDataFrame([(1, 0, "heading", 2, "A"), (1, 1, "para", 0, "extra"), (1, 2, "image", 0, ""), (1, 3, "para", 0, "xy"), (1, 4, "para", 0, "other"), (1, 5, "table", 0, "a\x1fb"), (1, 6, "para", 0, "tail")], one)
    got = [r.problem for r in markdown.compare_events(left, right).orderBy("seq").collect()]
    assert got == ["level", "image missing", "table rows", "table cells", "added"]


def test_compare_events_equals_a_plain_reading(spark):
    rnd = random.Random(22)
    kinds = ["image", "para", "quote", "heading", "bullet"]
    make = lambda: [(rnd.choice(kinds), rnd.randrange(2), rnd.choice("ab")) for _ in range(rnd.randrange(9))]
    pairs = [(make(), make()) for _ in range(150)]

    def plain(a, b):
        out, ahead, dead = [], 0, None
        for i, (kind, level, text) in enumerate(a):
            j = i + ahead
            if dead is None and kind == "image" and j < len(b):
                to = next((k for k in range(j, len(b)) if b[k][0] == "image"), len(b))
                out += [("image missing", i, k) for k in range(j, to)]
                ahead, j = to - i, to
                dead = i if to == len(b) else None
            if dead is not None or j >= len(b):
                dead = i if dead is None else dead
                out.append(("left over", i, -1))
            elif kind != "image" and (kind, b[j][0]) != ("quote", "para"):
                if kind != b[j][0]:
                    out.append(("kind", i, j))
                else:
                    out += [("level", i, j)] * (kind == "heading" and level != b[j][1]) + [("text", i, j)] * (text != b[j][2])
        return out + ([("added", -1, k) for k in range(len(a) + ahead, len(b))] if dead is None else [])

    frame = lambda side: spark.createDataFrame([(d, i, *e) for d, p in enumerate(pairs) for i, e in enumerate(p[side])], "doc_id bigint, seq int, kind string, level int, text string")
    got = {}
    for r in markdown.compare_events(frame(0), frame(1)).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.problem, r.left_seq, r.right_seq))
    assert got == {d: plain(*p) for d, p in enumerate(pairs) if plain(*p)}


def test_inline_runs(spark):
    e = spark.createDataFrame([(1, 0, "a **b** `c` *d*e")], "doc_id bigint, seq int, text string")
    got = rows(markdown.inline_runs(e), "run_no", "style", "text")
    assert [(s, t) for _, s, t in got] == [("plain", "a "), ("bold", "b"), ("plain", " "), ("code", "c"), ("plain", " "), ("italic", "d"), ("plain", "e")]


def test_empty_table(spark):
    none = docs(spark)
    for check in (audit.audit_report, audit.ai_flavor_hits, consistency.consistency_hits, markdown.md_events, markdown.md_to_html, markdown.resequence, cross.doc_terms):
        assert check(none).count() == 0
