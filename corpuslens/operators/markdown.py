"""Markdown as relations: tables, structural events, HTML, inline runs, renumbered captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import running, settled
from . import patterns as P

#: Kinds of blocks by the stripped line, tried in this order.
HEADING, IMAGE, BULLET, NUMBER = r"^(#{1,6})\s+(.*)$", r"^!\[(.*?)\]\((.*?)\)$", r"^[-*•]\s+(.*)$", r"^(\d+)[.、)]\s+(.*)$"


def marked(docs: DataFrame, fences: bool = True) -> DataFrame:
    """``docs`` with ``__lines``: an array of line_no, raw, stripped, is_fence, in_code, start_line (of the table that the line is in, else null) and rule.

    A run of lines that begin with a pipe holds a table from the first line that a
    rule follows. Lines are passed once, within the row of their document, so rows
    that share an id don't mix and no line is exchanged. A null text is an empty one.
    Without ``fences`` code blocks are lines like others.
    """
    rule = lambda c: T.trimmed(c).rlike(T.FLAGS + P.TABLE_RULE)
    opens = lambda c: F.startswith(T.trimmed(c), F.lit("```")) if fences else F.lit(False)
    rows = docs.withColumn("__raw", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    rows = rows.withColumn("__next", F.concat(F.slice("__raw", F.lit(2), F.size("__raw") - 1), F.array(F.lit(None).cast("string"))))

    def one(x, following):
        pipe = x.rlike(r"(?U)^[\s\x1c-\x1f]*\|")
        return F.struct(x.alias("raw"), opens(x).alias("is_fence"), pipe.alias("pipe"), F.coalesce(F.when(pipe, rule(following) & ~opens(following)), F.lit(False)).alias("ruled"))

    rows = rows.withColumn("__items", F.zip_with("__raw", "__next", one))
    zero = F.struct(F.lit(1).alias("line_no"), F.lit(False).alias("in_code"), F.lit(0).alias("start"))
    start = lambda s, x: F.when(x["pipe"] & ~x["is_fence"] & ~s["in_code"], F.when(s["start"] > 0, s["start"]).when(x["ruled"], s["line_no"]).otherwise(F.lit(0))).otherwise(F.lit(0))
    step = lambda s, x: F.struct((s["line_no"] + 1).alias("line_no"), (s["in_code"] != x["is_fence"]).alias("in_code"), start(s, x).alias("start"))
    rows = rows.withColumn("__passed", running("__items", zero, step))

    def line(p):
        begin = start(p["before"], p["item"])
        return F.struct(p["before"]["line_no"].alias("line_no"), p["item"]["raw"].alias("raw"), T.trimmed(p["item"]["raw"]).alias("stripped"), p["item"]["is_fence"].alias("is_fence"), p["before"]["in_code"].alias("in_code"), F.when(begin > 0, begin).alias("start_line"), F.when(begin > 0, rule(p["item"]["raw"])).otherwise(F.lit(False)).alias("rule"))

    return rows.withColumn("__lines", F.transform("__passed", line)).drop("__raw", "__next", "__items", "__passed")


def _cells_of(lines: Column, tagged=lambda x, cells: F.array_join(cells, "\x1f")) -> Column:
    return F.transform(F.filter(lines, lambda x: ~x["rule"]), lambda x: tagged(x, T.cells(x["stripped"])))


def table_rows(docs: DataFrame, fences: bool = True) -> DataFrame:
    """``(doc_id, start_line, line_no, offset, is_rule, cells, first_start)`` of the lines of tables; offset 1 is the rule below the head, first_start the line of the document's first table."""
    rows = settled(marked(docs, fences), ["doc_id"], __tables=F.filter("__lines", lambda x: x["start_line"].isNotNull()))
    rows = rows.select("doc_id", F.get("__tables", F.lit(0))["start_line"].alias("first_start"), F.inline("__tables"))
    return rows.select("doc_id", "start_line", "line_no", (F.col("line_no") - F.col("start_line")).alias("offset"), F.col("rule").alias("is_rule"), T.cells("stripped").alias("cells"), "first_start")


def md_tables(docs: DataFrame) -> DataFrame:
    """``(doc_id, start_line, row_no, cells)``: rows of tables without their rules; cells joined by U+001F."""
    rows = settled(marked(docs), ["doc_id"], __rows=F.filter("__lines", lambda x: x["start_line"].isNotNull() & ~x["rule"]))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("no"))
    number = lambda s, x: F.when(s["start"] == x["start_line"], s["no"] + 1).otherwise(F.lit(1))
    placed = running("__rows", zero, lambda s, x: F.struct(x["start_line"].alias("start"), number(s, x).alias("no")))
    shown = F.transform(placed, lambda p: F.struct(p["item"]["start_line"].alias("start_line"), number(p["before"], p["item"]).alias("row_no"), F.array_join(T.cells(p["item"]["stripped"]), "\x1f").alias("cells")))
    return settled(rows, ["doc_id"], __shown=shown).select("doc_id", F.inline("__shown"))


def _kind(x: Column) -> Column:
    """The kind of a line that isn't blank, by its text."""
    s = x["stripped"]
    of = lambda p: s.rlike(T.FLAGS + p)
    return F.when(x["in_code"], "code").when(x["start_line"].isNotNull(), "table").when(of(HEADING), "heading").when(of(IMAGE), "image").when(F.startswith(s, F.lit(">")), "quote").when(of(BULLET), "bullet").when(of(NUMBER), "number")


def _significant(docs: DataFrame) -> DataFrame:
    """``marked`` rows with ``__marks``: lines that are no blank or ``---`` outside of code, of tables the first; fences too."""
    rows = marked(docs)
    shown = lambda x: (x["in_code"] | x["is_fence"] | ~x["stripped"].isin("", "---")) & (x["start_line"].isNull() | (x["start_line"] == x["line_no"]))
    kinds = lambda x: F.struct(x["line_no"].alias("line_no"), x["raw"].alias("raw"), x["stripped"].alias("stripped"), F.when(x["is_fence"], "fence").otherwise(F.coalesce(_kind(x), F.lit("para"))).alias("kind"))
    return rows.withColumn("__marks", F.transform(F.filter("__lines", shown), kinds))


def _captions(mark: Column, k: Column) -> Column:
    """Whether a line is the caption of a table or image that nothing but blank lines parts from it."""
    before = F.get("__marks", k - 1)["kind"]
    return (mark["kind"] == "para") & F.coalesce(before.isin("table", "image"), F.lit(False)) & mark["stripped"].rlike(T.FLAGS + P.CAPTION)


def md_captions(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, kind, number, text, of)``: captions, which stand right after a table or an image (``of``).

    What is waited for is carried over blank lines and ``---``, and ends with any other line.
    """
    found = F.filter(F.transform("__marks", lambda m, k: F.when(_captions(m, k), F.struct(m["line_no"].alias("line_no"), m["stripped"].alias("text"), F.get("__marks", k - 1)["kind"].alias("of")))), lambda x: x.isNotNull())
    rows = settled(_significant(docs), ["doc_id"], __found=found).select("doc_id", F.inline("__found"))
    part = lambda g: F.regexp_extract("text", T.FLAGS + P.CAPTION, g)
    return rows.select("doc_id", "line_no", part(1).alias("kind"), T.digits(part(2)).alias("number"), "text", "of")


def event_arrays(docs: DataFrame, captions: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs``' kept columns and ``events``: an array of (line_no, kind, level, text, source), the structure of a document, in order.

    Kinds: code (a line of a block), table (its rows joined by line feeds), heading,
    image (its path is the source), quote, bullet, number and para; with ``captions``
    also caption. Blank lines and ``---`` give none. Only headings have a level above 0.
    All within a document's row.
    """
    rows = _significant(docs)
    if captions:
        rows = rows.withColumn("__marks", F.transform("__marks", lambda m, k: F.struct(*[m[c].alias(c) for c in ("line_no", "raw", "stripped")], F.when(_captions(m, k), "caption").otherwise(m["kind"]).alias("kind"))))
    following = lambda k: F.coalesce(F.get("__marks", k + 1)["line_no"], F.size("__lines") + 1)
    table = lambda m, k: F.array_join(_cells_of(F.filter(F.slice("__lines", m["line_no"], following(k) - m["line_no"]), lambda x: x["start_line"] == m["line_no"])), "\n")

    def text(m, k):
        s = m["stripped"]
        part = lambda p, g: F.regexp_extract(s, T.FLAGS + p, g)
        is_ = lambda kind: m["kind"] == kind
        return F.when(is_("code"), m["raw"]).when(is_("table"), table(m, k)).when(is_("heading"), part(HEADING, 2)).when(is_("image"), part(IMAGE, 1)).when(is_("quote"), T.trimmed(F.regexp_replace(s, "^>+", ""))).when(is_("bullet"), part(BULLET, 1)).when(is_("number"), part(NUMBER, 2)).otherwise(s)

    level = lambda m: F.when(m["kind"] == "heading", F.length(F.regexp_extract(m["stripped"], T.FLAGS + HEADING, 1))).otherwise(F.lit(0))
    events = F.filter(F.transform("__marks", lambda m, k: F.when(m["kind"] != "fence", F.struct(m["line_no"].alias("line_no"), m["kind"].alias("kind"), level(m).alias("level"), text(m, k).alias("text"), F.when(m["kind"] == "image", F.regexp_extract(m["stripped"], T.FLAGS + IMAGE, 2)).alias("source")))), lambda e: e.isNotNull())
    return settled(rows, list(keep), events=events)


def md_events(docs: DataFrame, captions: bool = False, keep: tuple[str, ...] = ("doc_id",), sources: bool = False) -> DataFrame:
    """``(doc_id, seq, line_no, kind, level, text)``, with ``sources`` also ``source``, an image's path: the items of ``event_arrays``."""
    out = event_arrays(docs, captions, keep).select(*keep, F.posexplode("events").alias("seq", "e"))
    return out.select(*keep, "seq", "e.line_no", "e.kind", "e.level", "e.text", *(["e.source"] if sources else []))


def md_event_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind, n)``."""
    return md_events(docs).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def image_paths(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__images``: the paths of a document's images, in order."""
    found = F.transform(F.filter("__lines", lambda x: ~x["is_fence"] & (_kind(x) == "image")), lambda x: F.regexp_extract(x["stripped"], T.FLAGS + IMAGE, 2))
    return settled(marked(docs), docs.columns, __images=found)


def md_to_html(docs: DataFrame, sources: str | None = None) -> DataFrame:
    """``(doc_id, html)``: headings, paragraphs, tables, code with its body, lists, quotes, images and rules.

    Runs of list items or quoted lines become one element; bold and code are set in
    paragraphs only. ``sources`` names a column with what stands for each image of the
    document, in order; null for one that is missing, of which a note says so. All
    within a document's row.
    """
    esc = T.html_escaped
    rows = marked(docs)
    kind = lambda x: F.when(x["is_fence"], F.when(x["in_code"], "close").otherwise("open")).otherwise(F.coalesce(_kind(x), F.when(x["stripped"].isin("---", "***"), "hr").when(x["stripped"] == "", "blank").otherwise("para")))
    rows = rows.withColumn("__kinds", F.transform("__lines", lambda x: F.struct(x["line_no"].alias("line_no"), kind(x).alias("kind"), x["start_line"].alias("start_line"))))
    before = lambda x: F.get("__kinds", x["line_no"] - 2)
    merged = lambda x: F.coalesce((x["kind"].isin("quote", "bullet", "number", "code") & (before(x)["kind"] == x["kind"])) | (x["start_line"] == before(x)["start_line"]), F.lit(False))
    rows = rows.withColumn("__heads", F.filter("__kinds", lambda x: ~merged(x)))
    rows = rows.withColumn("__counted", running("__heads", F.lit(0), lambda n, x: n + (x["kind"] == "image").cast("int")))
    following = lambda k: F.coalesce(F.get("__heads", k + 1)["line_no"], F.size("__lines") + 1)
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))

    def block(p, k):
        head = p["item"]
        body = F.slice("__lines", head["line_no"], following(k) - head["line_no"])
        s = F.get("__lines", head["line_no"] - 1)["stripped"]
        part = lambda c, p, g: esc(F.regexp_extract(c, T.FLAGS + p, g))
        items = lambda p, g: F.array_join(F.transform(body, lambda x: tag("li", part(x["stripped"], p, g))), "")
        level = F.length(F.regexp_extract(s, T.FLAGS + HEADING, 1)).cast("string")
        row = lambda x, cells: F.when(x["line_no"] == x["start_line"], F.concat(F.lit("<thead>"), tag("tr", F.array_join(F.transform(cells, lambda c: tag("th", esc(c))), "")), F.lit("</thead>\n<tbody>"))).otherwise(tag("tr", F.array_join(F.transform(cells, lambda c: tag("td", esc(c))), "")))
        paragraph = F.regexp_replace(F.regexp_replace(esc(s), T.FLAGS + r"\*\*(.+?)\*\*", "<strong>$1</strong>"), T.FLAGS + "`([^`]+)`", "<code>$1</code>")
        image = F.concat(F.lit('<img src="'), part(s, IMAGE, 2), F.lit('" alt="'), part(s, IMAGE, 1), F.lit('">'))
        if sources:
            source = F.when(F.size(sources) > p["before"], F.get(sources, p["before"]))  # named twice, so that it stays a column
            missing = F.concat(F.lit('<p style="color:red">[缺失图片: '), part(s, IMAGE, 2), F.lit("]</p>"))
            image = F.coalesce(F.concat(F.lit('<img src="'), source, F.lit('" alt="'), part(s, IMAGE, 1), F.lit('" style="max-width:100%">')), missing)
        is_ = lambda name: head["kind"] == name
        return (
            F.when(is_("open"), F.concat(F.lit('<pre><code class="language-'), esc(T.trimmed(F.substring(s, F.lit(4), F.length(s)))), F.lit('">')))
            .when(is_("close"), F.lit("</code></pre>"))
            .when(is_("code"), F.array_join(F.transform(body, lambda x: esc(x["raw"])), "\n"))
            .when(is_("table"), F.concat(F.lit("<table>\n"), F.array_join(_cells_of(body, row), "\n"), F.lit("\n</tbody>\n</table>")))
            .when(is_("heading"), F.concat(F.lit("<h"), level, F.lit(">"), part(s, HEADING, 2), F.lit("</h"), level, F.lit(">")))
            .when(is_("image"), image)
            .when(is_("quote"), tag("blockquote", F.array_join(F.transform(body, lambda x: esc(T.trimmed(F.regexp_replace(x["stripped"], "^>+", "")))), "<br>")))
            .when(is_("bullet"), tag("ul", items(BULLET, 1)))
            .when(is_("number"), tag("ol", items(NUMBER, 2)))
            .when(is_("hr"), F.lit("<hr>"))
            .when(is_("para"), tag("p", paragraph))
        )

    return settled(rows, ["doc_id"], html=F.array_join(F.array_compact(F.transform("__counted", block)), "\n"))


def inline_runs(events: DataFrame) -> DataFrame:
    """``(doc_id, seq, run_no, style, text)``: bold, code, italic and plain runs of the texts of paragraphs."""
    pattern = r"(\*\*.+?\*\*|`[^`]+`|\*[^*]+?\*)"
    events = events.withColumn("__marks", F.regexp_extract_all("text", F.lit(T.FLAGS + pattern), F.lit(0)))
    marks = F.col("__marks")
    plain = F.split("text", T.FLAGS + pattern, -1)
    style = lambda t: F.when(F.startswith(t, F.lit("**")), "bold").when(F.startswith(t, F.lit("`")), "code").otherwise("italic")
    inner = lambda t: F.when(F.startswith(t, F.lit("**")), F.substring(t, F.lit(3), F.length(t) - 4)).otherwise(F.substring(t, F.lit(2), F.length(t) - 2))
    both = F.flatten(F.transform(plain, lambda p, i: F.array(F.struct(F.lit("plain").alias("style"), p.alias("text")), F.struct(style(F.get(marks, i)).alias("style"), inner(F.get(marks, i)).alias("text")))))
    kept = F.filter(both, lambda r: r["text"].isNotNull() & ((r["style"] != "plain") | (r["text"] != "")))
    return events.select("doc_id", "seq", F.posexplode(kept).alias("run_no", "r")).select("doc_id", "seq", "run_no", "r.style", "r.text")


def _renumbered(docs: DataFrame, kind: str, count: str) -> DataFrame:
    """``docs`` with the captions of a kind numbered 1..n in their order in ``text``, references following them, and how many captions there are.

    A caption is a match that begins its line, of which little follows. Numbers are
    digits of any length; a reference to none of the captions keeps its own. Work
    grows with the references and the sorting of them, all within the row.
    """
    ref, likely = T.FLAGS + kind + r"\s*(\d+)", F.contains("text", F.lit(kind))
    none = F.array().cast("array<string>")
    keep = docs.columns
    of = lambda g: F.when(likely, F.regexp_extract_all("text", F.lit(ref), F.lit(g))).otherwise(none)
    rows = docs.select(*keep, of(0).alias("__found"), of(1).alias("__digits"), F.when(likely, F.split("text", ref, -1)).otherwise(none).alias("__gaps"))
    gaps, found = F.col("__gaps"), F.col("__found")
    begins = lambda i: F.endswith(F.get(gaps, i), F.lit("\n")) | ((i == 0) & (F.get(gaps, i) == ""))
    # What follows the match, as far as it matters.
    tail = lambda i: F.concat(F.left(F.get(gaps, i + 1), F.lit(P.CAPTION_MOST + 2)), F.when(i + 1 < F.size(found), T.around(gaps, found, i + 1, after=P.CAPTION_MOST + 2)).otherwise(F.lit("")))
    short = lambda i: tail(i).rlike(rf"(?Ud)\A[^。！？\n]{{0,{P.CAPTION_MOST}}}(\n|\z)")
    rows = rows.withColumn("__refs", F.transform("__digits", lambda d, i: F.struct(i.alias("i"), T.digits(d).alias("old"), (begins(i) & short(i)).alias("caption"))))
    # A caption's own number is how many there are up to it.
    rows = rows.withColumn("__owned", running("__refs", F.lit(0), lambda n, r: n + r["caption"].cast("int")))
    # Of one old number the last caption comes first, then the references that follow it.
    rank = lambda o: F.when(o["item"]["caption"], -o["before"] - 1).otherwise(F.lit(1))
    rows = rows.withColumn("__sorted", F.array_sort(F.transform("__owned", lambda o: F.struct(o["item"]["old"].alias("old"), rank(o).alias("rank"), o["item"]["i"].alias("i")))))
    none_yet = F.struct(F.lit("").alias("old"), F.lit(1).alias("rank"))
    last = lambda state, x: F.when(state["old"] == x["old"], state["rank"]).otherwise(x["rank"])
    rows = rows.withColumn("__led", running("__sorted", none_yet, lambda s, x: F.struct(x["old"].alias("old"), last(s, x).alias("rank"))))
    own = lambda p: F.when(p["item"]["rank"] < 0, -p["item"]["rank"]).when(last(p["before"], p["item"]) < 0, -last(p["before"], p["item"]))
    rows = rows.withColumn("__new", F.array_sort(F.transform("__led", lambda p: F.struct(p["item"]["i"].alias("i"), F.coalesce(own(p).cast("string"), p["item"]["old"]).alias("new")))))
    rows = rows.withColumn(count, F.size(F.filter("__refs", lambda r: r["caption"])).cast("bigint"))
    out = F.array_join(F.zip_with(gaps, "__new", lambda g, r: F.concat(g, F.coalesce(F.concat(F.lit(kind), r["new"]), F.lit("")))), "")
    return settled(rows, [c for c in keep if c != "text"], text=F.when(F.col(count) > 0, out).otherwise(F.col("text")), **{count: F.col(count)})


def resequence(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, changed, n_figures, n_tables)``: figures renumbered, then tables in the result; each in its document's row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), text.alias("__old"))
    rows = _renumbered(_renumbered(rows, P.FIGURE, "n_figures"), P.TABLE, "n_tables")
    return rows.select("doc_id", "text", (F.col("text") != F.col("__old")).alias("changed"), "n_figures", "n_tables")


def _columns_of(table: Column) -> Column:
    """How many cells each row of a table's text has."""
    return F.transform(F.split(table, "\n", -1), lambda r: F.size(F.split(r, "\x1f", -1)))


def _bound(value: Column, then) -> Column:
    """``then(value)``, where value is worked out once however often it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _problems(x: Column, y: Column) -> Column:
    """What an event on the left and its partner differ in; a partner that is null is none."""
    none = F.array().cast("array<string>")
    free = (x["kind"] == "image") | ((x["kind"] == "quote") & (y["kind"] == "para"))
    clean = lambda e: T.squeezed(T.without_marks(e["text"]))
    other_text = x["text"] != y["text"]
    differs = other_text & (clean(x) != clean(y))  # equal texts need no cleaning

    def table(t):
        short = F.least(F.size(t["x"]), F.size(t["y"]))
        uneven = F.filter(F.zip_with(F.slice(t["x"], F.lit(1), short), F.slice(t["y"], F.lit(1), short), lambda m, n: m != n), lambda d: d)
        return F.concat(F.when(F.size(t["x"]) != F.size(t["y"]), F.array(F.lit("table rows"))).otherwise(none), F.transform(uneven, lambda d: F.lit("table columns")), F.when(differs, F.array(F.lit("table cells"))).otherwise(none))

    tables = F.when(other_text, _bound(F.struct(_columns_of(x["text"]).alias("x"), _columns_of(y["text"]).alias("y")), table)).otherwise(none)
    other = F.array_compact(F.array(F.when((x["kind"] == "heading") & (x["level"] != y["level"]), F.lit("level")), F.when(differs, F.lit("text"))))
    return F.when(y.isNull(), F.array(F.lit("left over"))).when(free, none).when(x["kind"] != y["kind"], F.array(F.lit("kind"))).when(x["kind"] == "table", tables).otherwise(other)


def _with_stretches(rows: DataFrame) -> DataFrame:
    """``rows`` with ``stretches``: an array of how far right positions run ahead of left ones, from the begin and from each image on.

    Between two images on the left both sides go on one by one; an image goes on at
    the next image on the right. Without one the rest of the left has no partner.
    """
    images = lambda side: F.filter(F.transform(side, lambda e, i: F.when(e["kind"] == "image", i)), lambda i: i.isNotNull())
    both = settled(rows, ["doc_id", "left", "right"], left_images=images("left"), right_images=images("right"))
    # Images on the right are passed once: the next one on the left takes the first that is far enough.
    wanted = lambda state: F.get("left_images", state["k"]) + state["shift"]
    meets = lambda state, r: F.coalesce(wanted(state) <= r, F.lit(False))
    zero = F.struct(F.lit(0).alias("k"), F.lit(0).alias("shift"))
    both = both.withColumn("__passed", running("right_images", zero, lambda s, r: F.when(meets(s, r), F.struct((s["k"] + 1).alias("k"), (r - F.get("left_images", s["k"])).alias("shift"))).otherwise(s)))
    stretch = lambda begin, shift, skipped, ends: F.struct(begin.cast("int").alias("begin"), shift.cast("int").alias("shift"), skipped.cast("int").alias("skipped"), ends.alias("ends"))
    first = F.array(stretch(F.lit(0), F.lit(0), F.lit(0), F.lit(False)))
    met = F.transform(F.filter("__passed", lambda p: meets(p["before"], p["item"])), lambda p: stretch(F.get("left_images", p["before"]["k"]), p["item"] - F.get("left_images", p["before"]["k"]), p["item"] - wanted(p["before"]), F.lit(False)))
    both = settled(both, ["doc_id", "left", "right", "left_images"], __met=F.concat(first, met))
    # Without a next image nothing on the right is left for this one and what follows.
    ahead = F.element_at("__met", -1)["shift"]
    begin = F.get("left_images", F.size("__met") - 1)
    place = F.greatest(F.size("right"), begin + ahead)
    ended = F.when(F.size("__met") - 1 < F.size("left_images"), F.array(stretch(begin, place - begin, place - begin - ahead, F.lit(True)))).otherwise(F.array())
    return settled(both, ["doc_id", "left", "right"], stretches=F.concat("__met", ended))


def compare_arrays(rows: DataFrame) -> DataFrame:
    """What ``compare_events`` returns, of ``(doc_id, left, right)``: both streams of a document as arrays of events (kind, level, text), in order.

    All within the row and linear in its events, without an exchange.
    """
    rows = _with_stretches(rows)
    problem = lambda name, i, j: F.struct(name.alias("problem"), i.cast("int").alias("left_seq"), j.cast("int").alias("right_seq"))
    none = F.array().cast("array<struct<problem: string, left_seq: int, right_seq: int>>")
    span = lambda test, begin, end, of: F.when(test, F.transform(F.sequence(begin, end), of)).otherwise(none)

    def walked(s, k):
        size = F.coalesce(F.get("stretches", k + 1)["begin"], F.size("left")) - s["begin"]
        ahead = s["begin"] + s["shift"]
        missing = span(s["skipped"] > 0, ahead - s["skipped"], ahead - 1, lambda j: problem(F.lit("image missing"), s["begin"], j))
        found = F.zip_with(F.slice("left", s["begin"] + 1, size), F.slice("right", ahead + 1, size), _problems)
        placed = F.transform(found, lambda names, i: F.transform(names, lambda n: problem(n, s["begin"] + i, F.when(n == "left over", F.lit(-1)).otherwise(ahead + i))))
        return F.concat(missing, F.flatten(placed))

    last = F.element_at("stretches", -1)
    begin = F.size("left") + last["shift"]
    added = span(~last["ends"] & (begin < F.size("right")), begin, F.size("right") - 1, lambda j: problem(F.lit("added"), F.lit(-1), j))
    rows = settled(rows, ["doc_id"], __problems=F.concat(F.flatten(F.transform("stretches", walked)), added))
    return rows.select("doc_id", F.posexplode("__problems").alias("seq", "p")).select("doc_id", "seq", "p.problem", "p.left_seq", F.col("p.right_seq").cast("bigint").alias("right_seq"))


def compare_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(doc_id, seq, problem, left_seq, right_seq)``: differences of two event streams of a document, aligned in order.

    An image on the left waits for the next image on the right, and what the right
    has before that is reported; a quote matches a paragraph; kinds that differ are
    reported and passed by; tables compare by rows and cells, others by text
    without marks and white space. Positions count from 0; -1 is none. Events of a
    document come together once, both streams in one exchange; where a row has both
    already, ``compare_arrays`` takes it as it is.
    """
    event = F.struct("seq", "kind", F.col("level").cast("int").alias("level"), "text")
    side = lambda df, own: df.select("doc_id", *[(event if x == own else F.lit(None)).alias(x) for x in ("left", "right")])
    both = side(left, "left").unionByName(side(right, "right"))
    return compare_arrays(both.groupBy("doc_id").agg(*[F.sort_array(F.collect_list(x)).alias(x) for x in ("left", "right")]))


def verification_report(problems: DataFrame, shown: int = 20) -> DataFrame:
    """``(doc_id, total, items)`` of ``compare_events`` rows: how many problems a document has, and the first ones, a line each."""
    item = F.concat(F.col("problem"), F.lit(" "), F.col("left_seq").cast("string"), F.lit(" / "), F.col("right_seq").cast("string"))
    first = F.collect_list(F.when(F.col("seq") < shown, F.struct("seq", item.alias("item"))))  # seq counts a document's problems from 0
    got = problems.groupBy("doc_id").agg(F.count("*").alias("total"), F.array_sort(first).alias("items"))
    return got.select("doc_id", "total", F.array_join(F.transform("items", lambda x: x["item"]), "\n").alias("items"))
