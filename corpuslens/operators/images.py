"""Images of documents: their type and size by their first bytes, how they fit a page, and pages that hold them.

Headers are read by expressions over bytes, without a decoder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import settled
from .markdown import image_paths, md_to_html

#: The most that an image takes of a page, and types by extension.
MOST_WIDTH_CM, MOST_HEIGHT_CM = 14.5, 22.0
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp"}
OTHER_MIME = "image/png"
#: Segments of a JPEG file looked at in one go; folds over more of them are nested.
_SEGMENTS = 64


def _number(data: Column, begin: Column | int, size: int, little: bool = False) -> Column:
    """The integer in ``size`` bytes from ``begin`` (from 1) on; null beyond the end."""
    part = lambda k: F.substring(data, F.lit(begin) + k if isinstance(begin, int) else begin + k, F.lit(1))
    order = range(size) if not little else range(size - 1, -1, -1)
    digits = F.concat(*[F.hex(part(k)) for k in order])
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).try_cast("int"))


def _jpeg_frame(data: Column) -> Column:
    """Where the frame header of a JPEG file begins (from 1), 0 if there is none: segments are passed by their lengths."""
    state = lambda at, done: F.struct(at.cast("int").alias("at"), done.alias("done"))

    def one(s):
        marker = _number(data, s["at"], 2)
        frame = marker.between(0xFFC0, 0xFFCF) & ~marker.isin(0xFFC4, 0xFFC8, 0xFFCC)
        alone = marker.between(0xFFD0, 0xFFD8) | (marker == 0xFF01)
        padded = marker == 0xFFFF
        stops = marker.isNull() | (marker < 0xFF00) | marker.isin(0xFFD9, 0xFFDA)
        size = _number(data, s["at"] + 2, 2)
        ahead = F.when(padded, F.lit(1)).when(alone, F.lit(2)).otherwise(2 + size)
        return F.when(s["done"], s).when(stops, state(F.lit(0), F.lit(True))).when(frame, state(s["at"], F.lit(True))).when(ahead.isNull(), state(F.lit(0), F.lit(True))).otherwise(state(s["at"] + ahead, F.lit(False)))

    rounds = F.sequence(F.lit(0), F.floor(F.length(data) / _SEGMENTS).cast("int"))
    some = lambda s, _: F.when(s["done"], s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(_SEGMENTS)), s, lambda t, _: one(t)))
    return F.aggregate(rounds, state(F.lit(3), F.lit(False)), some, lambda s: F.when(s["done"], s["at"]).otherwise(F.lit(0)))


def image_sizes(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(path, kind, width, height, width_cm, height_cm, mime)`` and the kept columns of ``files(path, content)``.

    kind (png, gif, jpeg, else null) and pixels are those of the first bytes; a file cut
    short has no pixels. On a page a tall image takes the full height, any other the
    full width. mime is that of the extension.
    """
    data = F.coalesce("content", F.lit(b""))
    begins = lambda hexes: F.startswith(F.hex(F.substring(data, 1, 12)), F.lit(hexes))
    kind = F.when(begins("89504E470D0A1A0A"), "png").when(begins("474946383761") | begins("474946383961"), "gif").when(begins("FFD8FF"), "jpeg")
    rows = files.select("path", data.alias("content"), kind.alias("kind"))
    rows = rows.withColumn("__frame", F.when(F.col("kind") == "jpeg", _jpeg_frame(F.col("content"))).otherwise(F.lit(0)))
    c, frame = F.col("content"), F.col("__frame")
    size = lambda png, gif, jpeg: F.when(F.col("kind") == "png", _number(c, png, 4)).when(F.col("kind") == "gif", _number(c, gif, 2, True)).when(frame > 0, _number(c, frame + jpeg, 2))
    rows = settled(rows, ["path", "kind", *keep], __w=size(17, 7, 7), __h=size(21, 9, 5))
    both = F.col("__w").isNotNull() & F.col("__h").isNotNull()
    rows = rows.select("path", "kind", *keep, *[F.when(both, F.col(c)).alias(name) for c, name in (("__w", "width"), ("__h", "height"))])
    ratio = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("height") / F.col("width"))
    tall = ratio > MOST_HEIGHT_CM / MOST_WIDTH_CM
    fit = F.when(tall, MOST_HEIGHT_CM / ratio).when(ratio.isNotNull(), F.lit(MOST_WIDTH_CM)), F.when(tall, F.lit(MOST_HEIGHT_CM)).otherwise(MOST_WIDTH_CM * ratio)
    return rows.select("path", "kind", *keep, "width", "height", fit[0].alias("width_cm"), fit[1].alias("height_cm"), mime_of("path").alias("mime"))


def mime_of(path: Column | str) -> Column:
    """The type of a file by its extension."""
    name = F.element_at(F.split(path, "/"), -1)
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))), F.lit(OTHER_MIME))


def resolved(folder: Column, path: Column) -> Column:
    """A path as seen from a folder, without ``.`` and ``..``."""
    whole = F.when(F.startswith(path, F.lit("/")) | (folder == ""), path).otherwise(F.concat(folder, F.lit("/"), path))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda a, x: F.when(x.isin(".", "") & (F.size(a) > 0), a).when((x == "..") & (F.size(a) > 0) & ~F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1).isin("..", ""), F.lit(True)), F.slice(a, F.lit(1), F.size(a) - 1)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    return F.array_join(parts, "/")


def with_images(docs: DataFrame, files: DataFrame, what: str) -> DataFrame:
    """``docs(doc_id, path, text)`` with ``__found``: of each image of a document, in order, its path in the text (src) and the column ``what`` of ``files(path, ...)`` that has it, or null.

    Images are looked for from the folder of their document. Only paths and the files
    they name are exchanged by path, and a document once to meet its images; documents
    without images aren't. Of rows with the same id, path and text the images are looked
    up once.
    """
    folder = F.regexp_replace(F.coalesce("path", F.lit("")), r"/?[^/]*$", "")
    key = F.xxhash64("path", "text")
    held = image_paths(docs.select("doc_id", "text", folder.alias("__folder"), key.alias("__key")))
    wanted = held.where(F.size("__images") > 0).select("doc_id", "__key", "__folder", F.posexplode("__images").alias("nth", "src")).distinct()
    wanted = wanted.withColumn("__at", resolved(F.col("__folder"), F.col("src")))
    known = files.select(F.col("path").alias("__at"), F.col(what))
    found = wanted.join(known, "__at", "left").groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__of")).agg(F.array_sort(F.collect_list(F.struct("nth", "src", what)), lambda a, b: a["nth"] - b["nth"]).alias("__found"))
    rows = docs.withColumn("__key", key).join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), "left").drop("__key", "__id", "__of")
    none = F.array().cast(found.schema["__found"].dataType)
    return rows.withColumn("__found", F.coalesce("__found", none))


def html_with_images(docs: DataFrame, files: DataFrame, embed: bool = True) -> DataFrame:
    """``(doc_id, html)`` of ``docs(doc_id, path, text)`` with the images among ``files(path, content)``.

    Images are looked for from the folder of their document. With ``embed`` pages hold
    their bytes, else their addresses; what is missing is noted in the page. Bytes are
    encoded while their page is made, not before they are exchanged.
    """
    known = files.select("path", F.struct(F.lit(True).alias("there"), F.col("path").alias("path"), *(["content"] if embed else [])).alias("file")).dropDuplicates(["path"])
    rows = with_images(docs.select("doc_id", "path", "text"), known, "file")
    data = lambda f: F.concat(F.lit("data:"), mime_of(f["path"]), F.lit(";base64,"), F.base64(F.coalesce(f["content"], F.lit(b"")))) if embed else F.concat(F.lit("file:///"), F.regexp_replace(f["path"], "^/+", ""))
    rows = rows.select("doc_id", "text", F.transform("__found", lambda x: F.when(x["file"]["there"], data(x["file"]))).alias("__sources"))
    return md_to_html(rows, "__sources")
