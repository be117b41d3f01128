"""Format rules of office documents, as relations over what their files say.

``docx_facts`` reads files; groups of paragraphs, issues and distributions are
DataFrame expressions over its rows. Only formatting set on the paragraph, run or
section itself counts, besides a style's name and whether it is bold.
"""

from __future__ import annotations

import io
import json
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .docx import TWIP_CM, W, _text, is_on, pieces, styles_of
from .storage import stored

_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DRAWN = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
EMU_CM = 1 / 360_000

#: What the two profiles ask for.
PROFILES = {
    "technical": {
        "page": {"width_cm": 21.0, "height_cm": 29.7, "tolerance_cm": 0.3},
        "body": {"fonts": ["宋体", "微软雅黑", "SimSun", "Microsoft YaHei"], "size_pt": [10.5, 11, 12], "indent_required": False},
        "heading": {"fonts": ["黑体", "微软雅黑", "SimHei", "Microsoft YaHei"], "bold_required": True},
        "table": {"border_required": True},
        "image": {"max_width_margin_cm": 0.5},
        "require_header": False,
        "require_footer": False,
    },
    "academic": {
        "page": {"width_cm": 21.0, "height_cm": 29.7, "tolerance_cm": 0.3},
        "body": {"fonts": ["宋体", "SimSun"], "size_pt": [12], "indent_required": True},
        "heading": {"fonts": ["黑体", "SimHei", "宋体"], "bold_required": True},
        "table": {"border_required": True},
        "image": {"max_width_margin_cm": 0.5},
        "require_header": False,
        "require_footer": False,
    },
}
#: From this size on, or centred and no longer than this, a paragraph is of the cover; a caption is no longer either.
COVER_PT, SHORT = 16, 40
CODE_FONTS = ("consolas", "courier")

FACTS = "doc_id bigint, at int, what string, style string, style_bold boolean, text string, fonts array<string>, latin array<string>, sizes array<double>, bold boolean, runs int, centred boolean, left_indent boolean, indent int, spacing string, bordered boolean, width_cm double, height_cm double, left_cm double, right_cm double"
_NAMES = [x.split(" ")[0] for x in FACTS.split(", ")]


def rules_of(profile: str = "technical", custom: str | None = None) -> dict:
    """A profile's rules; those in ``custom`` (a JSON object) replace them, key by key within an object."""
    rules = {k: dict(v) if isinstance(v, dict) else v for k, v in PROFILES.get(profile, PROFILES["technical"]).items()}
    for key, value in (json.loads(custom) if custom else {}).items():
        rules[key] = {**rules[key], **value} if isinstance(value, dict) and isinstance(rules.get(key), dict) else value
    return rules


def _number(node, name: str) -> float | None:
    value = None if node is None else node.get(f"{W}{name}")
    return None if value is None else float(value)


def facts_of(content: bytes) -> list[dict]:
    """Rows of one file: its page, header, footer, then paragraphs, tables and images in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        part = lambda name: ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None
        root, rels = part("word/document.xml"), part("word/_rels/document.xml.rels")
        known = styles_of(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else {}
        target = {r.get("Id"): r.get("Target") for r in (rels if rels is not None else ())}
        section = next(root.iter(f"{W}sectPr"), None)
        out = []
        if section is not None:
            size, margin = section.find(f"{W}pgSz"), section.find(f"{W}pgMar")
            cm = lambda node, name: None if _number(node, name) is None else _number(node, name) * TWIP_CM
            out.append({"what": "page", "width_cm": cm(size, "w"), "height_cm": cm(size, "h"), "left_cm": cm(margin, "left"), "right_cm": cm(margin, "right")})
            for what in ("header", "footer"):
                pieces = [part("word/" + target.get(r.get(f"{_R}id"), "")) for r in section.findall(f"{W}{what}Reference")]
                out.append({"what": what, "text": "".join(_text(p) for p in pieces if p is not None)})
    for node in root.find(f"{W}body"):
        if node.tag == f"{W}tbl":
            style = node.find(f"{W}tblPr/{W}tblStyle")
            name = "" if style is None else known.get(style.get(f"{W}val"), (style.get(f"{W}val"), False))[0]
            out.append({"what": "table", "style": name, "bordered": next(node.iter(f"{W}tblBorders"), None) is not None or "Table Grid" in name})
        elif node.tag == f"{W}p":
            style, runs = node.find(f"{W}pPr/{W}pStyle"), [r for r in node.findall(f"{W}r")]
            name, style_bold = ("Normal", False) if style is None else known.get(style.get(f"{W}val"), (style.get(f"{W}val"), False))
            texts = [_text(r) for r in runs]
            said = [r.find(f"{W}rPr") for r, t in zip(runs, texts, strict=True) if t.strip()]
            of = lambda name: [None if r is None else r.find(name) for r in said]  # noqa: B023, E731
            fonts = of(f"{W}rFonts")
            latin = [None if f is None else f.get(f"{W}ascii") for f in fonts]
            own = [x if f is None else f.get(f"{W}eastAsia") or x for f, x in zip(fonts, latin, strict=True)]
            half = [_number(s, "val") for s in of(f"{W}sz")]
            props = node.find(f"{W}pPr")
            align, indent, gap = (None if props is None else props.find(f"{W}{n}") for n in ("jc", "ind", "spacing"))
            first, line = _number(indent, "firstLine"), _number(gap, "line")
            spacing = None if line is None else f"{line / 240:g}" if gap.get(f"{W}lineRule", "auto") == "auto" else f"{line / 20:g}pt"
            left = indent is not None and (indent.get(f"{W}left") or indent.get(f"{W}start")) is not None
            out.append({"what": "paragraph", "style": name, "style_bold": style_bold, "text": "".join(texts), "fonts": own, "latin": latin, "sizes": [None if h is None else h / 2 for h in half], "bold": any(map(is_on, of(f"{W}b"))), "runs": len(runs), "centred": align is not None and align.get(f"{W}val") == "center", "left_indent": left, "indent": None if not first else round(first / 20), "spacing": spacing})
        out += [{"what": "image", "width_cm": float(e.get("cx")) * EMU_CM} for i in node.iter(f"{_DRAWN}inline") for e in i.findall(f"{_DRAWN}extent")]
    return out


def docx_facts(files: DataFrame) -> DataFrame:
    """FACTS of ``files(doc_id, content)``; what can't be read gives one row, "unreadable"."""

    def run(batches):
        kinds = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("what", pa.string()), ("style", pa.string()), ("style_bold", pa.bool_()), ("text", pa.string()), ("fonts", pa.list_(pa.string())), ("latin", pa.list_(pa.string())), ("sizes", pa.list_(pa.float64())), ("bold", pa.bool_()), ("runs", pa.int32()), ("centred", pa.bool_()), ("left_indent", pa.bool_()), ("indent", pa.int32()), ("spacing", pa.string()), ("bordered", pa.bool_()), ("width_cm", pa.float64()), ("height_cm", pa.float64()), ("left_cm", pa.float64()), ("right_cm", pa.float64())])
        for b in pieces(batches):
            found = []
            for doc, content in zip(b.column("doc_id").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = facts_of(content or b"")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError):
                    rows = [{"what": "unreadable"}]
                found += [{"doc_id": doc, "at": i, **r} for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(k.name) for r in found], k.type) for k in kinds], schema=kinds)

    return files.select("doc_id", "content").mapInArrow(run, FACTS)


def paragraph_group() -> Column:
    """The group that a paragraph is checked in: empty, heading, cover, caption, list, code, other or body."""
    name, text = F.lower("style"), T.trimmed("text")
    short = F.length(text) <= SHORT
    sizes = F.array_max(F.filter("sizes", lambda s: s.isNotNull()))
    code = F.forall("latin", lambda f: F.lower(F.coalesce(f, F.lit(""))).rlike("^(" + "|".join(CODE_FONTS) + ")")) & (F.col("runs") > 0)
    quoted = F.startswith(text, F.lit(">")) | (F.col("left_indent") & ~F.startswith(name, F.lit("normal")))
    out = F.when(text == "", "empty").when(F.startswith(name, F.lit("heading")) | name.isin("title", "subtitle"), "heading")
    out = out.when(F.coalesce(sizes >= COVER_PT, F.lit(False)) | (F.col("centred") & short), "cover")
    return out.when(short & text.rlike(T.FLAGS + r"^(图|表)\s*\d+"), "caption").when(F.startswith(name, F.lit("list")), "list").when(code, "code").when(quoted, "other").otherwise("body")


def format_issues(facts: DataFrame, rules: dict) -> DataFrame:
    """``(doc_id, rule, subject, n, of, detail)``: where a document departs from the rules; n of so many paragraphs, tables or images, detail lists what departs.

    The facts are written to the shared folder, so files are read once for all rules.
    """
    facts = stored(facts)
    page, body, heading = rules["page"], rules["body"], rules["heading"]
    paragraphs = facts.where("what = 'paragraph'").withColumn("group", paragraph_group())
    strange = lambda allowed: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("fonts", lambda f: f.isNotNull() & ~f.isin(allowed))))))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    issue = lambda rule, subject, n, of, detail: F.struct(F.lit(rule).alias("rule"), subject.alias("subject"), n.cast("bigint").alias("n"), of.cast("bigint").alias("of"), detail.alias("detail"))
    out = lambda df, *found: df.select("doc_id", F.inline(F.array_compact(F.array(*found))))
    off = (F.abs(F.col("width_cm") - page["width_cm"]) > page["tolerance_cm"]) | (F.abs(F.col("height_cm") - page["height_cm"]) > page["tolerance_cm"])
    first = facts.where("what = 'page'")
    size = F.format_string("%.1fx%.1f", "width_cm", "height_cm")
    parts = [out(first, F.when(off, issue("page size", F.lit("page"), F.lit(1), F.lit(1), size)))]
    for what in ("header", "footer"):
        if rules.get(f"require_{what}"):
            parts.append(out(facts.where((F.col("what") == what) & (T.trimmed("text") == "")), issue(f"{what} missing", F.lit(what), F.lit(1), F.lit(1), F.lit(""))))
    heads = paragraphs.where("group = 'heading'").groupBy("doc_id", "style").agg(F.count("*").alias("of"), strange(heading["fonts"]).alias("bad"), F.count_if(~F.col("bold") & ~F.col("style_bold")).alias("light"))
    bold = F.lit(bool(heading.get("bold_required"))) & (F.col("light") > 0)
    parts.append(out(heads, F.when(F.size("bad") > 0, issue("heading font", F.col("style"), F.col("of"), F.col("of"), listed("bad"))), F.when(bold, issue("heading not bold", F.col("style"), F.col("light"), F.col("of"), F.lit("")))))
    wrong_size = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter("sizes", lambda s: s.isNotNull() & ~s.isin([float(x) for x in body["size_pt"]]))))))
    texts = paragraphs.where("group = 'body'").groupBy("doc_id").agg(F.count("*").alias("of"), strange(body["fonts"]).alias("bad"), wrong_size.alias("wrong"), F.count_if(F.col("indent").isNull()).alias("flush"))
    flush = F.lit(bool(body.get("indent_required"))) & (F.col("flush") > 0)
    subject = F.lit("body")
    parts.append(out(texts, F.when(F.size("bad") > 0, issue("body font", subject, F.col("of"), F.col("of"), listed("bad"))), F.when(F.size("wrong") > 0, issue("body size", subject, F.col("of"), F.col("of"), listed("wrong"))), F.when(flush, issue("body indent", subject, F.col("flush"), F.col("of"), F.lit("")))))
    if rules["table"].get("border_required"):
        tables = facts.where("what = 'table'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "bordered"))).alias("all"))
        bare = F.filter(F.transform("all", lambda t, i: F.when(~t["bordered"], i + 1)), lambda i: i.isNotNull())
        parts.append(out(tables, F.when(F.size(bare) > 0, issue("table border", F.lit("table"), F.size(bare), F.size("all"), listed(bare)))))
    images = facts.where("what = 'image'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "width_cm"))).alias("all"))
    images = images.join(first.select("doc_id", (F.col("width_cm") - F.col("left_cm") - F.col("right_cm") - rules["image"]["max_width_margin_cm"]).alias("room")), "doc_id")
    wide = F.filter(F.transform("all", lambda t, i: F.when(t["width_cm"] > F.col("room"), i + 1)), lambda i: i.isNotNull())
    parts.append(out(images, F.when(F.size(wide) > 0, issue("image width", F.lit("image"), F.size(wide), F.size("all"), listed(wide)))))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def format_notes(facts: DataFrame) -> DataFrame:
    """``(doc_id, what, value, n)``: how many paragraphs of each group, and how fonts, sizes, indents and spacings of body text are spread ("" where not set); "widest image" has its centimetres as value.

    The facts are passed once, so files are read once.
    """
    paragraphs = facts.where("what IN ('paragraph', 'table', 'image')").withColumn("group", paragraph_group())
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = lambda what, value: F.array(F.struct(T.column(F.lit(what) if isinstance(what, str) else what).alias("what"), text(value).alias("value")))
    each = lambda what, values: F.transform(values, lambda v: F.struct(F.lit(what).alias("what"), text(v).alias("value")))
    body = F.concat(one("indent", F.col("indent")), one("spacing", F.col("spacing")), each("font", F.col("fonts")), each("size", F.filter("sizes", lambda s: s.isNotNull())))
    none = F.array().cast("array<struct<what: string, value: string>>")
    said = F.when(F.col("what") != "paragraph", one(F.col("what"), F.lit(""))).otherwise(F.concat(one("group", F.col("group")), F.when(F.col("group") == "body", body).otherwise(none)))
    rows = paragraphs.select("doc_id", "width_cm", said.alias("said")).select("doc_id", "width_cm", F.inline("said"))
    counted = rows.groupBy("doc_id", "what", "value").agg(F.count("*").alias("n"), F.max("width_cm").alias("w"))
    # The width goes into a row of its own beside the count of images.
    note = lambda what, value, n: F.struct(what.alias("what"), value.alias("value"), n.cast("bigint").alias("n"))
    own = note(F.col("what"), F.col("value"), F.col("n"))
    widest = note(F.lit("widest image"), F.format_string("%.2f", "w"), F.lit(1))
    return counted.select("doc_id", F.inline(F.array_compact(F.array(own, F.when(F.col("what") == "image", widest)))))
