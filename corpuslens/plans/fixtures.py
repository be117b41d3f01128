"""Documents on which the checks have something to find.

The tables hold plain prose, so lines of Markdown are added to it, by expressions
that Spark and other SQL engines read alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import spread


def _lines(*lines: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)


def _when(test: str, *lines: str) -> str:
    return f"CASE WHEN {test} THEN chr(10) || {_lines(*lines)} ELSE '' END"


_ZH = _lines(
    "本节说明系统的部署步骤与运行环境要求，用户应先检查配置。",
    '按钮 "保存" 位于右上角。',
    "从用户角度看，系统不仅稳定而且高效，这是质量的保障。",
    "综上所述，该方案具有重要意义，能够赋能业务并不断改进。",
    "众所周知，一般来说可行的话就行。",
    "## 系统具有重要意义",
    "总的来说。",
    "稳定是架构的体现。",
)
_AUDIT_LINES = [
    _when("doc_id % 3 = 0", "如图 1 所示。", "图1 总览", "图4 细节", "见图 4 与图 2。", "表 2 参数", "表1 概览"),
    _when("doc_id % 4 = 0", "```python", 'x = "1"', "```", "", "```", 'no language "q" API', "```"),
    _when("doc_id % 8 = 0", "```"),
    _when("doc_id % 6 = 0", "## 1. A", "#### 1.1.1 C", "### 2 B", "## 2.1 D"),
    _when("doc_id % 7 = 0", "The API and Api with `api` on Docker or docker and GitHub Github (JSON only)."),
    _when("doc_id % 11 = 0", "A “quoted” text."),
]
AUDIT, CHINESE = (" || ".join([x, *_AUDIT_LINES]) for x in ("text", _ZH))
_CONSISTENCY_LINES = [
    _when("doc_id % 3 = 0", "往返时延(RTT)是 30 ms。", "取RTT的一半作为结果！再看往返时间。"),
    _when("doc_id % 6 = 0", "单程为往返时延的一半。"),
    _when("doc_id % 4 = 0", "时延约为 50ms，随后时延: 60 ms。", "窗口大小=64240字"),
    _when("doc_id % 8 = 0", "此处为示例。"),
    _when("doc_id % 5 = 0", "示例：窗口", "值 0x002 与 0xABCD", "末行"),
    _when("doc_id % 7 = 0", "相对序号从零开始。", "a", "b", "c", "d", "e", "f", "g", "h", "i", "原始序号是随机值。"),
    _when("doc_id % 14 = 0", "绝对序号与相对序号要区分。"),
]
CONSISTENCY = " || ".join(["text", *_CONSISTENCY_LINES])
FACTS = " || ".join(
    [
        "text",
        _when("doc_id % 3 = 0", "版本 v2.1.0 与 2.1.0 以及 2026.1 和 2.0 还有 v1234.5 。", "容量 10 MB 或 20MB，共 30 个节点，增长 40% 。"),
        _when("doc_id % 3 = 1", "版本 v2.1.0 。", "容量 10 MB 。", "Gateway Server, Gateway Server and Gateway Server; Router."),
        _when("doc_id % 2 = 0", "| 模块 | 要点 |", "| --- | --- |", "| 登录 | a |", "| 查询 | b |"),
        _when("doc_id % 4 = 0", "| 导出 | c |"),
        _when("doc_id % 3 = 2", "Gateway Server once; Router and Router."),
    ]
)
_TITLE = "'# Title ' || CAST(doc_id AS string) || chr(10)"
_MARKDOWN_LINES = [
    _when("doc_id % 2 = 0", "| a | b |", "|---|:-:|", "| 1 | **x** |", "| 2 | y |", "after"),
    _when("doc_id % 3 = 0", "```sql", "SELECT 1", "| not | table |", "---", "```", "![pic](p.png)", "---"),
    _when("doc_id % 5 = 0", "- one", "* two", "1. first", "2) second", "> said <b>", ">> more & more"),
    _when("doc_id % 7 = 0", "#### Deep", "para with `code` and **bold** text"),
]
MARKDOWN = " || ".join([_TITLE, "text", *_MARKDOWN_LINES])
DIFF = "'--- a/doc' || chr(10) || '+++ b/doc' || chr(10) || '-old 10 MB and v2.1.0' || chr(10) || '+new 30 个 and v3.' || CAST(doc_set_id % 7 AS string) || '.0' || chr(10) || ' same 40% and 9.9.9'"
#: Paths of documents as files of a source tree: folders, names and extensions, some of them noise.
_FOLDERS = ("src", "lib/core", "node_modules/pkg", "docs/build", "web/.git-old", "src/generated")
_NAMES = ("main.py", "view.TSX", "notes.md", "app.min.js", "types.d.ts.map", "Dockerfile.dev", "Makefile", "data.json", "query.sql")


def _choice(of: str, values: tuple[str, ...]) -> str:
    return "CASE " + f"{of} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


TREE = f"{_choice('doc_id', _FOLDERS)} || '/d' || CAST(doc_id AS string) || '/' || {_choice('doc_id', _NAMES)}"
EXCLUDED = ("src/generated",)
#: Documents of one set; a companion set is an argument of the checks.
SET_OF = "CAST(floor(doc_id / 3) AS bigint)"


def table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the table of documents, texts with line ends normalised and none null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
    return spread(docs.withColumn("text", T.normalised("text")) if "text" in columns else docs)


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, length, content)``: the documents as files of a source tree."""
    content = F.expr("CAST(coalesce(text, '') AS binary)")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select(F.expr(TREE).alias("path"), F.length(content).cast("bigint").alias("length"), content.alias("content"))


def derived(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    """``(doc_id, text)`` of the table of documents with ``expression`` as text."""
    docs = table(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.expr(expression).alias("text"))


def audit_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: the whole text of every document with lines added, and Chinese documents as further rows of negative ids."""
    docs = table(spark, sf_dir, "doc_id", "text")
    chinese = docs.where("doc_id % 5 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), F.expr(CHINESE).alias("text"))
    return docs.select("doc_id", F.expr(AUDIT).alias("text")).unionAll(chinese)


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_set_id, doc_id)``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.select(F.expr(SET_OF).alias("doc_set_id"), "doc_id")


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_set_id, diff_text)``."""
    return sets(spark, sf_dir).select("doc_set_id").distinct().select("doc_set_id", F.expr(DIFF).alias("diff_text"))


#: How events of office documents were edited: which are gone, and level and text of the others.
EDIT_GONE = "kind = 'image' AND doc_id % 6 = 0"
EDIT_LEVEL = "CASE WHEN kind = 'heading' AND (doc_id + seq) % 5 = 0 THEN level + 1 ELSE level END"
EDIT_TEXT = "CASE WHEN kind = 'table' AND doc_id % 4 = 0 THEN replace(text, '1', '7') WHEN kind = 'table' AND doc_id % 10 = 6 THEN replace(text, chr(31) || 'y', '') WHEN kind = 'para' AND (doc_id + seq) % 23 = 0 THEN text || ' (edited)' ELSE text END"


def edited(rows: DataFrame) -> DataFrame:
    """``(doc_id, events)`` of arrays of events, edited within their rows."""
    of = lambda e: re.sub(r"\b(seq|kind|level|text)\b", r"e.\1", e)
    placed = rows.select("doc_id", F.transform("events", lambda e, i: F.struct(i.alias("seq"), e["kind"].alias("kind"), e["level"].alias("level"), e["text"].alias("text"))).alias("events"))
    return placed.select("doc_id", F.expr(f"transform(filter(events, e -> NOT ({of(EDIT_GONE)})), e -> struct(e.kind AS kind, {of(EDIT_LEVEL)} AS level, {of(EDIT_TEXT)} AS text))").alias("events"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new): the documents with their lines numbered, and the same with some lines removed, changed or inserted."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))
    docs = table(spark, sf_dir, "doc_id", "text").select("doc_id", numbered.alias("lines"))
    turn = lambda i, n: (F.col("doc_id") + i) % n == 0
    more = lambda i, *texts: F.concat(*[x if isinstance(x, str) is False else F.lit(x) for x in texts])
    changed = lambda x, i: F.when(turn(i, 11), F.array().cast("array<string>")).when(turn(i, 13), F.array(more(i, x, " v2.", i.cast("string"), ".0 of 10 MB"))).when(turn(i, 17), F.array(x, more(i, "inserted ", i.cast("string"), " 3.1.4"))).otherwise(F.array(x))
    text = lambda lines: F.array_join(lines, "\n").alias("text")
    return docs.select("doc_id", text(F.col("lines"))), docs.select("doc_id", text(F.flatten(F.transform("lines", changed))))


def main_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)``: earlier versions of the first documents of sets."""
    return derived(spark, sf_dir, f"replace(replace({FACTS}, 'v2.1.0', 'v2.0.9'), '20MB', '25 MB')").where("doc_id % 3 = 0")


def flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the lines of each document as steps of a flow, with loops, skips and some edges to nowhere."""
    lines = table(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("diagram_id"), F.split("text", "\n", -1).alias("lines"))
    rows = lines.select("diagram_id", F.size("lines").alias("n"), F.posexplode("lines").alias("seq", "text"))
    kind = F.when(F.col("seq") == 0, "start").when(F.col("seq") == F.col("n") - 1, "end").when(F.endswith("text", F.lit("?")), "decision").otherwise("process")
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))
    nodes = rows.select("diagram_id", "seq", name(F.col("seq")).alias("id"), "text", kind.alias("type"))
    i, n = F.col("seq"), F.col("n")
    edge = lambda test, k, to, label: F.when(test, F.struct((4 * i + k).alias("seq"), name(i).alias("src"), to.alias("dst"), F.lit(label).alias("label")))
    every = F.array(edge(i + 1 < n, 0, name(i + 1), None), edge(i % 7 == 3, 1, name(i - 3), "again"), edge((i % 11 == 5) & (i + 4 < n), 2, name(i + 4), "skip"), edge((i == 0) & (F.col("diagram_id") % 9 == 0), 3, F.lit("nowhere"), "lost"))
    return nodes, rows.select("diagram_id", F.inline(F.array_compact(every)))


#: Texts of JSON of several shapes; MESSAGES stands for a message a line of the document.
DIAGRAMS = (
    """'{"type": "sequence", "title": "a", "actors": ["甲", "乙", "丙"], "messages": [' || MESSAGES || ']}'""",
    """'{"width": 1200, "type": "sequence", "actors": ["p", "q", "r"], "style": {"deep": [1, {"x": null}]}, "messages": [' || MESSAGES || ', {"from": -1, "to": 0, "label": "back", "note": ""}]}'""",
    """'{"type": "sequence", "actors": ["a", "b"], "messages": [{"from": "b", "to": "a", "label": "by name", "note": "n"}, {"from": "a", "to": "z"}, {"from": 0, "to": 7, "label": "far"}]}'""",
    """'{"type": "sequence", "actors": [], "messages": []}'""",
    """'{"type": "pie", "of": ' || CAST(doc_id AS string) || '}'""",
    "'no JSON ' || CAST(doc_id AS string)",
)


def diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(diagram_id, config)``."""
    says = lambda x, i: F.format_string('{"from": %d, "to": %d, "label": "L%d", "note": "%s"}', i % 3, (i + 1 + i % 2) % 3, F.length(x), F.when(i % 4 == 0, "noted").otherwise(""))
    docs = table(spark, sf_dir, "doc_id", "text").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), says), ", ").alias("MESSAGES"))
    shape = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(DIAGRAMS)) + " END"
    return docs.select(F.col("doc_id").alias("diagram_id"), F.expr(shape).alias("config"))


#: Width and height of the image of a document.
PIXELS = "CAST(1 + (doc_id * 37) % 1900 AS INT)", "CAST(1 + (doc_id * 91 + length(text)) % 2500 AS INT)"
_IMAGE_KINDS = ("png", "GIF", "jpg", "png", "webp", "bin")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)``: an image a document, of several kinds, with its text behind the header."""
    docs = table(spark, sf_dir, "doc_id", "text").select("doc_id", "text", F.expr(PIXELS[0]).alias("w"), F.expr(PIXELS[1]).alias("h"))
    large = lambda c: F.lpad(F.hex(c), 8, "0")
    little = lambda c: F.concat(F.lpad(F.hex(F.pmod(c, F.lit(256))), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0"))
    w, h, kind = F.col("w"), F.col("h"), F.col("doc_id") % 6
    comment = F.concat(F.lit("FFFE"), F.lpad(F.hex(F.col("doc_id") % 300 + 2), 4, "0"), F.repeat(F.lit("20"), (F.col("doc_id") % 300).cast("int")))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), F.when(F.col("doc_id") % 4 == 0, F.concat(comment, comment)).otherwise(F.lit("")), F.lit("FFC4000401AAFFC0001108"), F.right(large(h), F.lit(4)), F.right(large(w), F.lit(4)), F.lit("03012200021101031101"))
    head = F.when(kind.isin(0, 3), F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), large(w), large(h), F.lit("0802000000"))).when(kind == 1, F.concat(F.lit("474946383961"), little(w), little(h), F.lit("F70000"))).when(kind.isin(2, 4), jpeg).otherwise(F.lit("FFD8FFE0"))
    path = F.expr(f"'img/' || CAST(doc_id AS string) || '.' || {_choice('doc_id', _IMAGE_KINDS)}")
    return docs.select(path.alias("path"), F.concat(F.unhex(head), F.col("text").cast("binary")).alias("content"))


def illustrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, text)``: the Markdown documents with an image of their own and one that is missing."""
    name = f"'../img/' || CAST(doc_id AS string) || '.' || {_choice('doc_id', _IMAGE_KINDS)}"
    docs = derived(spark, sf_dir, f"{MARKDOWN} || chr(10) || '![own <1>](' || {name} || ')' || chr(10) || chr(10) || '图' || CAST(doc_id % 9 AS string) || ' caption' || chr(10) || '![x](none.png)' || chr(10) || 'no caption'")
    return docs.select("doc_id", F.concat(F.lit("texts/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


CAPTIONS = " || ".join([MARKDOWN, _when("doc_id % 2 = 0", "![one](1.png)", "", "---", "图12 after blank lines", "图13 too late"), _when("doc_id % 3 = 0", "| a |", "|---|", "| 1 |", "表3 below the table"), _when("doc_id % 5 = 0", "![two](2.png)", "```", "```", "图7 a fence lies between", "表 8 no number")])
#: Names of archived templates; some without a date of the calendar.
TEMPLATE = "CASE WHEN doc_id % 13 = 0 THEN 'notes-' || CAST(doc_id AS string) || '.md' ELSE '20' || lpad(CAST(10 + doc_id % 16 AS string), 2, '0') || '-' || lpad(CAST(1 + doc_id % 14 AS string), 2, '0') || '-' || lpad(CAST(1 + doc_id % 31 AS string), 2, '0') || '-' || lpad(CAST(1 + doc_id % 7 AS string), 2, '0') || '-' || lang || CAST(doc_id AS string) || '.md' END"


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(category, name)``: the documents as archived templates, their sources as categories."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source"))
    return docs.select(F.expr("source || '/' || CAST(doc_id % 40 AS string)").alias("category"), F.expr(TEMPLATE).alias("name"))


def requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, confirmed, built_in), made from the documents' sources and languages."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source"))
    asked = docs.select(F.col("doc_id").alias("request_id"), F.expr("source || '/' || CAST(doc_id % 60 AS string)").alias("category"), F.expr("lang || CAST(doc_id % 50 AS string)").alias("topic"))
    confirmed = docs.where("doc_id % 50 < 5").select(F.expr("lang || CAST(doc_id % 50 AS string)").alias("topic"), F.expr("lang || CAST(doc_id AS string) || '.md'").alias("name"))
    return asked, confirmed, docs.where("doc_id % 60 >= 50 AND doc_id % 2 = 0").select(F.expr("source || '/' || CAST(doc_id % 60 AS string)").alias("category"), F.expr("source || '.md'").alias("name"))
