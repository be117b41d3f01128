"""Rows that share an id, null and empty texts, and work that must grow with a text and not with its square."""

import random
import re
import time

import pytest

from corpuslens.functions import text as T
from corpuslens.functions.arrays import running
from corpuslens.operators import audit, consistency, cross, markdown, relations
from corpuslens.operators import patterns as P
from corpuslens.plans import catalog
from pyspark.sql import functions as F

TEXT_A = "x Api\nApi and API\n图1 甲\n图5 乙\n## 1. A\n#### 1.1.1 B\n| a | b |\n|---|---|\n| 1 | 2 |\n```\n“q”\n```\n往返时延 30ms，时延 40ms。\n取一半。"
TEXT_B = "yy\nfoo Docker docker\n表2 丙\n## 2 C\n> said\n- one\n- two\n\n![p](p.png)\n```\nx\n时延 1s 时延 2s 相对序号。\na\nb\nc\nd\ne\nf\ng\nh\ni\n原始序号。"
CHECKS = [audit.ai_flavor_hits, audit.figure_table_gaps, audit.quote_issues, audit.empty_talk_issues, audit.term_variants, audit.code_fence_issues, audit.section_jumps, audit.audit_report, markdown.md_events, markdown.md_tables, markdown.md_to_html, markdown.md_captions, markdown.resequence, consistency.check_delay, consistency.check_quantities, consistency.check_placeholder_leak, consistency.check_sequence_basis, consistency.consistency_hits, relations.sentences, lambda d: T.find_all(d, [("t", r"(?Ud)[A-Za-z]+"), ("n", r"(?Ud)\d+")])]


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, text string")


@pytest.mark.parametrize("check", CHECKS, ids=lambda c: getattr(c, "__name__", "find_all"))
def test_rows_of_one_id_do_not_mix_and_null_texts_are_empty(spark, check):
    found = check(table(spark, (1, TEXT_A), (2, TEXT_B), (3, TEXT_A), (7, TEXT_A), (7, TEXT_B), (7, TEXT_A), (11, None), (12, ""))).collect()
    of = lambda *ids: sorted(repr([v for k, v in sorted(r.asDict(True).items()) if k != "doc_id"]) for r in found if r.doc_id in ids)
    assert of(1, 2, 3) == of(7) and of(11) == of(12)


def test_positions_where_two_rows_share_an_id(spark):
    found = T.find_all(table(spark, (1, "x Api\nApi …"), (1, "yy\nfoo Docker …")), [("t", r"Api|Docker")]).collect()
    assert sorted((r.start, r.line_no) for r in found) == [(2, 1), (6, 2), (7, 2)]


def test_tables_without_rows_give_none(spark):
    none = table(spark, (1, "x")).limit(0)
    assert [c for c in (audit.audit_report, markdown.md_events, markdown.md_to_html, markdown.resequence, consistency.consistency_hits) if c(none).count()] == []


def test_language_and_lines_of_a_null_text(spark):
    row = audit.audit_report(table(spark, (1, None))).first()
    assert (row.language, row.lines, row.score) == ("zh", 1, 100)


def test_registered_checks_normalise_line_ends_and_nulls(spark, tmp_path):
    table(spark, (1, "a\r\nb\rc"), (2, None)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = catalog.queries()["scan_documents"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_chars) for r in rows) == [(1, 3, 5), (2, 1, 0)]
    lines = catalog.queries()["audit_report"](spark, str(tmp_path)).where("doc_id = 1").first().lines
    assert lines == 3


def brute_renumber(text, kind):
    caption = re.compile(rf"^{kind}\s*(\d+)[^。！？\n]{{0,28}}$", re.M)
    spots = {m.start(): i + 1 for i, m in enumerate(caption.finditer(text))}
    last = {int(m[1]): spots[m.start()] for m in caption.finditer(text)}
    if not spots:
        return text
    return re.sub(rf"{kind}\s*(\d+)", lambda m: f"{kind}{spots.get(m.start()) or last.get(int(m[1]), int(m[1]))}", text)


def test_renumbering_equals_a_plain_reading(spark):
    rnd = random.Random(8)
    pieces = ["图", "图 ", "表", "1", "2", "10", "007", "\n", "\n图3 标题\n", "\n表2\n", "，", "。", " x", "\n图1", "长" * 30]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(40))) for _ in range(250)]
    got = {r.doc_id: r.text for r in markdown.resequence(table(spark, *enumerate(texts))).collect()}
    assert got == {i: brute_renumber(brute_renumber(t, "图"), "表") for i, t in enumerate(texts)}


def test_renumbering_grows_with_the_captions(spark):
    def took(n):
        text = "\n".join(f"图{n - i} caption\n见图{i + 1}" for i in range(n))
        began = time.perf_counter()
        row = markdown.resequence(table(spark, (1, text))).first()
        assert row.n_figures == n and row.text.startswith("图1 caption\n见图" + str(n)) and row.text.endswith(f"图{n} caption\n见图1")
        return time.perf_counter() - began

    took(10)
    small = took(2_000)
    assert took(20_000) < 10 * small + 10


def test_running_sums_and_their_growth(spark):
    rows = spark.createDataFrame([([],), (list(range(1000)),), ([5],)], "a array<int>")
    got = [[(p.before, p.item) for p in r.r] for r in rows.select(running("a", F.lit(0), lambda s, x: s + x).alias("r")).collect()]
    assert got == [[], [(i * (i - 1) // 2, i) for i in range(1000)], [(0, 5)]]


def test_delays_equal_a_plain_reading(spark):
    rnd = random.Random(9)
    texts = ["\n".join(rnd.choices(["", "x", "RTT 是 3。RTT！", "取一半。", "单程一半", "round trip; 一半"], [30, 30, 1, 1, 1, 0.5], k=rnd.randrange(200))) for _ in range(60)]
    want = set()
    for d, t in enumerate(texts):
        s = [(i + 1, k, x.strip()) for i, line in enumerate(t.split("\n")) for k, x in enumerate(re.split(r"(?<=[。！？!?；;])", line)) if x.strip()]
        halves = [x for x in s if re.search("一半|单程|半个往返", x[2]) and "单程" not in x[2]]
        for n, _, x in s:
            near = [h for h in halves if abs(h[0] - n) <= 40]
            if re.search("往返时延|往返时间|RTT|round[- ]trip", x, re.I) and near:
                want.add((d, n, near[0][0], x, near[0][2]))
    assert {tuple(r) for r in consistency.check_delay(table(spark, *enumerate(texts))).select("doc_id", "line_no", "other_line", "sample", "other").collect()} == want and want


def test_gate_and_companion_checks_take_nulls(spark):
    docs = table(spark, (1, None), (2, "往返时延。\n一半"))
    gates = {r.doc_id: r.passes for r in consistency.gate(consistency.consistency_hits(docs), docs).collect()}
    assert gates == {1: True, 2: False}
    sets = spark.createDataFrame([(1, 1), (1, 2)], "doc_set_id bigint, doc_id bigint")
    assert cross.cross_terms(docs, sets).count() == 0


def test_images_far_apart_are_aligned_in_one_pass(spark):
    rnd = random.Random(10)

    def brute(left, right):
        i = j = 0
        out = []
        while i < len(left) and j < len(right):
            a, b = left[i], right[j]
            if a == "image" and b != "image":
                out.append(("image missing", i, j))
                j += 1
                continue
            if a != b and not (a == "quote" and b == "para") and a != "image":
                out.append(("kind", i, j))
            i, j = i + 1, j + 1
        return sorted(out + [("left over", k, -1) for k in range(i, len(left))] + [("added", -1, k) for k in range(j, len(right))])

    sides = [[rnd.choices(["image", "para", "quote", "bullet"], [2, 3, 1, 1], k=rnd.randrange(25)) for _ in range(150)] for _ in range(2)]
    events = [spark.createDataFrame([(d, k, kind, 0, "") for d, ks in enumerate(side) for k, kind in enumerate(ks)], "doc_id bigint, seq int, kind string, level int, text string") for side in sides]
    got = {}
    for r in markdown.compare_events(*events).collect():
        got.setdefault(r.doc_id, []).append((r.problem, r.left_seq, r.right_seq))
    for d, (left, right) in enumerate(zip(*sides, strict=True)):
        assert sorted(got.get(d, [])) == brute(left, right), (left, right)


@pytest.mark.parametrize("check", [markdown.md_tables, markdown.md_events, markdown.md_captions, markdown.image_paths, markdown.table_rows], ids=lambda c: c.__name__)
def test_lines_are_passed_once(spark, check):
    rows = check(table(spark, (1, TEXT_A)))
    rows = rows.where(F.size("__images") > 0) if "__images" in rows.columns else rows
    plan = rows._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().split("\n") if "Filter" in line]
    assert not any("aggregate(" in line for line in filters)  # a filter on an array isn't moved below what makes it


def exchanged(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_events_are_compared_in_their_rows_or_after_one_exchange(spark, tmp_path):
    table(spark, (1, TEXT_A), (2, TEXT_B)).write.parquet(str(tmp_path / "documents.parquet"))
    assert exchanged(catalog.queries()["compare_events"](spark, str(tmp_path))) == 0
    kinds = ["image", "para", "quote", "heading", "table"]
    rnd = random.Random(31)
    make = lambda: [(rnd.choice(kinds), rnd.randrange(2), rnd.choice(["a", "**a**", " `a`", "b\x1fc\nd", "b\x1fc\nd\x1fe"])) for _ in range(rnd.randrange(12))]
    sides = [[make() for _ in range(80)] for _ in range(2)]
    frames = [spark.createDataFrame([(d, 10 * i, *e) for d, side in enumerate(s) for i, e in enumerate(side)], "doc_id bigint, seq int, kind string, level int, text string") for s in sides]
    streams = markdown.compare_events(*frames)
    arrays = "array<struct<kind: string, level: int, text: string>>"
    rows = markdown.compare_arrays(spark.createDataFrame([(d, *p) for d, p in enumerate(zip(*sides, strict=True))], f"doc_id bigint, left {arrays}, right {arrays}"))
    assert exchanged(streams) == 1 and sorted(streams.collect()) == sorted(rows.collect()) and rows.count()


def test_tables_that_differ_are_told_by_rows_columns_and_cells(spark):
    event = lambda text: [("table", 0, text)]
    pairs = [("a\x1fb\nc", "a\x1fb\nc"), ("a\x1fb\nc", "a\nc\x1fd\ne"), ("**a**\x1fb", "a\x1f b"), ("a", "b")]
    arrays = "array<struct<kind: string, level: int, text: string>>"
    found = markdown.compare_arrays(spark.createDataFrame([(d, event(a), event(b)) for d, (a, b) in enumerate(pairs)], f"doc_id bigint, left {arrays}, right {arrays}")).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.seq, r.problem, r.left_seq, r.right_seq) for r in found] == [(1, 0, "table rows", 0, 0), (1, 1, "table columns", 0, 0), (1, 2, "table columns", 0, 0), (1, 3, "table cells", 0, 0), (3, 0, "table cells", 0, 0)]


def test_quantities_equal_a_plain_reading(spark):
    rnd = random.Random(41)
    pieces = ["窗口", "窗口大小", "时延", "往返时延", "RTT", "rtt", "Rtt", "确认号", "字数", "文件大小", "耗时", "：", "= 约为 ", "\n", " ", "10", "2.50", "7", "ms", "MS", "毫秒", "字", "KB", "KB", "ſ", "byte", "bytes", "示例", "x" * 30, "é", "😀", "Rx", "r"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randrange(60))) for _ in range(400)]
    texts += ["".join(f"{rnd.choice(['时延', '字数', 'RTT'])} {rnd.choice('123')} {rnd.choice(['s', 'KB'])}{rnd.choice([chr(10), '。', '示意', 'x' * 70])}" for _ in range(rnd.randrange(9))) for _ in range(800)]
    want = set()
    for d, t in enumerate(texts):
        by = {}
        for m in re.finditer(P.QUANTITY, t, re.I):
            context = t[max(m.start() - P.CONTEXT, 0) : m.start() + P.CONTEXT]
            by.setdefault(f"{m[1]}|{m[3]}", []).append((m[2], t.count("\n", 0, m.start()) + 1, context))
        for key, found in by.items():
            values = sorted({v for v, _, _ in found})
            if len(values) > 1 and not any(re.search(P.PLACEHOLDER, c) for _, _, c in found):
                want.add((d, key, ", ".join(values), found[0][1], len(found), " | ".join(c.replace("\n", " ")[:100] for _, _, c in found[:3])))
    assert {tuple(r) for r in consistency.check_quantities(table(spark, *enumerate(texts))).collect()} == want and len(want) > 50


def test_all_rules_of_consistency_pass_a_text_once(spark, tmp_path):
    docs = [(1, TEXT_A), (2, TEXT_B), (3, "示例\n0xAB"), (4, "窗口 1 KB，窗口 2 KB"), (5, None)]
    table(spark, *docs).write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda name: catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert all(plan(name).count("FileScan") == 1 for name in ("consistency_hits", "consistency_report"))
    hits = consistency.consistency_hits(table(spark, *docs))
    assert exchanged(hits) == 0 and exchanged(consistency.check_quantities(table(spark, *docs))) == 0
    alone = [(r.doc_id, rule, r.line_no) for rule, check in (("时延表述矛盾", consistency.check_delay), ("占位值泄露", consistency.check_placeholder_leak), ("序号基准混用", consistency.check_sequence_basis)) for r in check(table(spark, *docs)).collect()]
    alone += [(r.doc_id, "同一量多值", r.first_line) for r in consistency.check_quantities(table(spark, *docs)).collect()]
    assert sorted((r.doc_id, r.rule, r.line_no) for r in hits.collect()) == sorted(alone) and {rule for _, rule, _ in alone} >= {"占位值泄露", "同一量多值", "序号基准混用"}
