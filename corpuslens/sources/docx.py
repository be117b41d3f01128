"""Office documents (zipped XML) as structural events, comparable with those of Markdown.

Kinds are those of ``operators.markdown.md_events``. A paragraph whose written
runs are all set in the code font is code, which an empty paragraph is too; a
paragraph that holds a drawing is an image.
"""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CODE_FONT = "Consolas"
_TEXT, _MARKS = f"{W}t", {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
LIST_STYLES = {"list bullet": "bullet", "list number": "number"}
EVENTS = "doc_id bigint, seq int, kind string, level int, text string"
#: Centimetres in a twentieth of a point, and an A4 page with what it may differ by.
TWIP_CM, A4_CM, PAGE_SLACK_CM = 2.54 / 1440, (21.0, 29.7), 0.1
#: Bytes of a batch that are turned to Python objects at a time, if more than one row has them.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about PIECE bytes or one larger row, so that memory doesn't grow with the rows of a batch."""
    for whole in batches:
        left = [whole] if whole.num_rows else []
        while left:
            b = left.pop()
            if b.num_rows > 1 and b.nbytes > PIECE:
                half = b.num_rows // 2
                left += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def _text(node) -> str:
    return "".join(n.text or "" if n.tag == _TEXT else _MARKS.get(n.tag, "") for n in node.iter())


@functools.lru_cache(16)
def styles_of(part: bytes) -> dict[str, tuple[str, bool]]:
    """(name, whether it is bold) of styles by id; files of one writer have the same ones."""
    named = [(s, s.find(f"{W}name"), s.find(f"{W}rPr/{W}b")) for s in ElementTree.fromstring(part).iter(f"{W}style")]
    return {s.get(f"{W}styleId"): (name.get(f"{W}val"), is_on(bold)) for s, name, bold in named if name is not None}


def is_on(node) -> bool:
    return node is not None and node.get(f"{W}val", "true") not in ("0", "false", "off")


def _style_names(archive: zipfile.ZipFile) -> dict[str, str]:
    if "word/styles.xml" not in archive.namelist():
        return {}
    return {i: name for i, (name, _) in styles_of(archive.read("word/styles.xml")).items()}


def _font(run) -> str | None:
    fonts = run.find(f"{W}rPr/{W}rFonts")
    return None if fonts is None else fonts.get(f"{W}ascii")


def _paragraph(p, names: dict[str, str]) -> tuple[str, int, str] | None:
    runs = p.findall(f"{W}r")
    if any(r.find(f"{W}drawing") is not None for r in runs):
        return "image", 0, ""
    texts = [_text(r) for r in runs]
    text = "".join(texts)
    if all(_font(r) == CODE_FONT for r, t in zip(runs, texts, strict=True) if t.strip()):
        return "code", 0, text
    if not text.strip():
        return None
    style = p.find(f"{W}pPr/{W}pStyle")
    name = (names.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else "").lower()
    if name.startswith("heading"):
        return "heading", int(name[-1]) if name[-1:].isdigit() else 0, text
    return LIST_STYLES.get(name, "para"), 0, text


def events_of(content: bytes) -> list[tuple[str, int, str]]:
    """(kind, level, text) of the blocks of a document; a table's rows are lines, its cells are parted by U+001F."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = _style_names(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{W}body")
    out = []
    for block in body if body is not None else ():
        if block.tag == f"{W}tbl":
            rows = [["\n".join(_text(p) for p in c.findall(f"{W}p")) for c in r.findall(f"{W}tc")] for r in block.findall(f"{W}tr")]
            out.append(("table", 0, "\n".join("\x1f".join(c.replace("\n", " ") for c in r) for r in rows)))
        elif block.tag == f"{W}p" and (event := _paragraph(block, names)):
            out.append(event)
    return out


def page_size(content: bytes) -> tuple[float, float] | None:
    """Width and height of the first section in centimetres."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        size = next(ElementTree.fromstring(archive.read("word/document.xml")).iter(f"{W}pgSz"), None)
    return None if size is None else (int(size.get(f"{W}w")) * TWIP_CM, int(size.get(f"{W}h")) * TWIP_CM)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, path, content)`` of office documents; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def docx_events(files: DataFrame) -> DataFrame:
    """``(doc_id, seq, kind, level, text)`` of ``files(doc_id, content)``; what can't be read gives one event of kind "unreadable"."""

    def run(batches):
        for b in pieces(batches):
            rows = []
            for doc, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    events = events_of(content or b"")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    events = [("unreadable", 0, "")]
                rows += [(doc, i, *e) for i, e in enumerate(events)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "seq", "kind", "level", "text"])

    return files.select("doc_id", "content").mapInArrow(run, EVENTS)


def page_size_issues(files: DataFrame) -> DataFrame:
    """``(doc_id, width_cm, height_cm)`` of documents whose page isn't A4."""

    def run(batches):
        for b in pieces(batches):
            found = [(d, *s) for d, c in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True) if (s := page_size(c)) and max(abs(s[0] - A4_CM[0]), abs(s[1] - A4_CM[1])) > PAGE_SLACK_CM]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([f[0] for f in found], pa.int64()), "width_cm": pa.array([f[1] for f in found], pa.float64()), "height_cm": pa.array([f[2] for f in found], pa.float64())})

    return files.select("doc_id", "content").mapInArrow(run, "doc_id bigint, width_cm double, height_cm double")
