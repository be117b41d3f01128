"""Office documents from structural events, those of ``operators.markdown.md_events``."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import images, markdown
from .docx import CODE_FONT, pieces

_WORDS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_DRAWN = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
_MAIN = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_PICTURE = 'xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
_RELATED = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
#: Headings go no deeper; fonts and size of text and headings.
DEEPEST, TEXT_FONT, HEADING_FONT, SIZE_PT, CAPTION_PT = 4, "宋体", "黑体", 12, 10.5
EMU_CM = 360_000
_STYLES = {"bullet": ("ListBullet", "List Bullet"), "number": ("ListNumber", "List Number")}
#: What XML can't hold.
_UNFIT = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _run(text: str, font: str, size: float = SIZE_PT, bold: bool = False) -> str:
    props = f'<w:rFonts w:ascii="{font}" w:eastAsia="{font}"/>{"<w:b/>" if bold else ""}<w:sz w:val="{int(size * 2)}"/>'
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{escape(_UNFIT.sub("", text))}</w:t></w:r>'


def _paragraph(inner: str, style: str = "", centred: bool = False) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ('<w:jc w:val="center"/>' if centred else "")
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{inner}</w:p>"


def _picture(text: str, cx: int = 3_600_000, cy: int = 1_800_000, relation: str = "") -> str:
    shown = f'<a:graphic {_MAIN}><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic {_PICTURE}><pic:nvPicPr><pic:cNvPr id="0" name="image"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{relation}" {_RELATED}/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>' if relation else ""
    return _paragraph(f'<w:r><w:drawing><wp:inline {_DRAWN}><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="1" name="image" descr="{escape(_UNFIT.sub("", text), {chr(34): "&quot;"})}"/>{shown}</wp:inline></w:drawing></w:r>', centred=bool(relation))


def docx_bytes(events: list[tuple[str, int, str]], page: tuple[int, int] = (11906, 16838), images: dict[int, tuple[bytes, str, float, float] | str] | None = None) -> bytes:
    """A file of (kind, level, text); page in twentieths of a point.

    ``images`` has, by place among the events, an image's bytes, extension, width and
    height in centimetres, or the path of one that is missing, of which the text says so.
    """
    body, media = [], []
    for at, (kind, level, text) in enumerate(events):
        image = (images or {}).get(at)
        if kind == "table":
            rows = [[_paragraph(_run(cell, TEXT_FONT)) for cell in row.split("\x1f")] for row in text.split("\n")]
            body.append("<w:tbl><w:tblPr><w:tblBorders/></w:tblPr>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>")
        elif kind == "image" and isinstance(image, str):
            body.append(_paragraph(_run(f"[缺失图片: {image}]", TEXT_FONT), centred=True))
        elif kind == "image" and image:
            media.append((f"image{len(media) + 1}.{image[1]}", image[0]))
            body.append(_picture(text, round(image[2] * EMU_CM), round(image[3] * EMU_CM), f"i{len(media)}"))
        elif kind == "image":
            body.append(_picture(text))
        elif kind == "caption":
            body.append(_paragraph(_run(text, TEXT_FONT, CAPTION_PT, bold=True), centred=True))
        elif kind == "heading":
            body.append(_paragraph(_run(text, HEADING_FONT, bold=True), f"Heading{min(level, DEEPEST)}"))
        elif kind == "code":
            body.append(_paragraph(_run(text, CODE_FONT)))
        else:
            body.append(_paragraph(_run(text, TEXT_FONT), _STYLES[kind][0] if kind in _STYLES else ""))
    names = [*((f"Heading{i}", f"heading {i}") for i in range(1, DEEPEST + 1)), *_STYLES.values()]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Default Extension="{e}" ContentType="image/{e.replace("jpg", "jpeg")}"/>' for e in sorted({n.rpartition(".")[2] for n, _ in media})) + '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/>' + "".join(f'<Relationship Id="i{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/{n}"/>' for i, (n, _) in enumerate(media, 1)) + "</Relationships>")
        for name, content in media:
            z.writestr(f"word/media/{name}", content)
        z.writestr("word/styles.xml", f"<w:styles {_WORDS}>" + "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in names) + "</w:styles>")
        z.writestr("word/document.xml", f'<w:document {_WORDS}><w:body>{"".join(body)}<w:sectPr><w:pgSz w:w="{page[0]}" w:h="{page[1]}"/><w:pgMar w:left="1440" w:right="1440" w:top="1440" w:bottom="1440"/></w:sectPr></w:body></w:document>')
    return out.getvalue()


def write_docx(events: DataFrame) -> DataFrame:
    """``(doc_id, content)``: a file of each document's events; a document's come together by its id."""
    rows = events.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "level", "text"))).alias("events"))
    return docx_files(rows)


def docx_files(rows: DataFrame) -> DataFrame:
    """``(doc_id, content)``: a file of each row's ``events``, an array as ``operators.markdown.event_arrays`` gives; marks of bold, code and italics go.

    Nothing is exchanged, so rows that share an id are files of their own. Rows may have
    ``images``: of each event of kind image, in order, the source (its path), image (its
    bytes, null where it is missing), extension, width_cm and height_cm. A document
    without events gives no file.
    """
    plain = lambda e: F.struct(e["kind"].alias("kind"), e["level"].alias("level"), F.when(e["kind"] == "code", e["text"]).otherwise(T.without_marks(e["text"])).alias("text"))
    drawn = "images" in rows.columns
    rows = rows.select("doc_id", F.transform("events", plain).alias("events"), *(["images"] if drawn else []))

    def run(batches):
        for b in pieces(batches):
            events, ids, files, at = b.column("events"), [], [], 0
            every = list(zip(*(c.to_pylist() for c in events.flatten().flatten()), strict=True))
            held = b.column("images").to_pylist() if drawn else [None] * b.num_rows
            for doc, n, own in zip(b.column("doc_id").to_pylist(), events.value_lengths().to_pylist(), held, strict=True):
                if not n:
                    continue
                parts, at = every[at : at + n], at + n
                places = (i for i, e in enumerate(parts) if e[0] == "image")
                images = {i: (bytes(m["image"]), m["extension"], m["width_cm"], m["height_cm"]) if m["image"] is not None else m["source"] for i, m in zip(places, own, strict=True)} if drawn else None
                ids.append(doc)
                files.append(docx_bytes([(kind, level, text or "") for kind, level, text in parts], images=images))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id bigint, content binary")


def md_to_docx(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``(doc_id, content)``: office documents of ``docs(doc_id, path, text)`` with their images among ``files(path, content)`` and captions set apart.

    An image whose size can't be read is taken as one that fills the width and half the height of it.
    Only paths and the files they name are looked up by path; a document's events stay in its row.
    """
    known = images.image_sizes(files, keep=("content",)).dropDuplicates(["path"])
    width = F.coalesce("width_cm", F.lit(images.MOST_WIDTH_CM))
    image = F.struct(F.col("content").alias("image"), F.regexp_replace("mime", "^image/", "").alias("extension"), width.alias("width_cm"), F.coalesce("height_cm", width / 2).alias("height_cm"))
    rows = images.with_images(docs.select("doc_id", "path", "text"), known.select("path", image.alias("file")), "file")
    rows = markdown.event_arrays(rows, captions=True, keep=("doc_id", "__found"))
    held = F.transform("__found", lambda x: F.struct(x["src"].alias("source"), *[x["file"][c].alias(c) for c in ("image", "extension", "width_cm", "height_cm")]))
    return docx_files(rows.select("doc_id", "events", held.alias("images")))
