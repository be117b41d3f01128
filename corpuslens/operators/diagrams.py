"""Layouts of diagrams: flows from nodes and edges, sequences from JSON of changing shape.

Coordinates are logical pixels, x to the right and y down. Elements of one diagram
are rows, so a layout is a few joins and windows over diagrams, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of flows.
FLOW_WIDTH, ROW_HEIGHT, FLOW_TOP, FLOW_PAD = 760, 110, 90, 50
BOX_WIDTH, DIAMOND_WIDTH, BOX_HEIGHT, LINE_HEIGHT = 320, 300, 30, 22
ARROW_GAP, LABEL_RIGHT, SIDE_LEFT, TRACK_FIRST, TRACK_STEP, SIDE_LABEL = 32, 26, 160, 60, 46, 12
#: Sizes of sequences.
SEQUENCE_WIDTH, SEQUENCE_PAD, SEQUENCE_TOP, MESSAGE_HEIGHT, SEQUENCE_FOOT = 1000, 40, 90, 95, 80
ACTOR_WIDTH, ACTOR_HEIGHT, ACTOR_UP, FIRST_MESSAGE = 150, 46, 40, 40
MESSAGE_LABEL_UP, NOTE_RIGHT, NOTE_DOWN, NUMBER_X = 16, 40, 18, 32
_NUMBERS = ("x", "y", "width", "height", "bend_x", "to_x", "to_y", "label_x", "label_y", "note_x", "note_y")


def _element(part: str, seq: Column, shape: Column, label: Column, **places: Column | float) -> list[Column]:
    value = lambda v: v.cast("double") if isinstance(v, Column) else F.lit(v).cast("double")
    return [F.lit(part).alias("part"), seq.cast("int").alias("seq"), shape.alias("shape"), label.alias("label"), *[value(places.get(n)).alias(n) for n in _NUMBERS]]


def flow_layout(nodes: DataFrame, edges: DataFrame, width: float = FLOW_WIDTH) -> DataFrame:
    """``(diagram_id, part, seq, shape, label, x, y, width, height, bend_x, to_x, to_y, label_x, label_y, note_x, note_y)``: elements of flows.

    ``nodes(diagram_id, seq, id, text, type)`` stand one a row, in the order of
    ``seq``; of an id that repeats the last counts. ``edges(diagram_id, seq, src, dst,
    label)`` between neighbours are straight; each of the others has a track of its own
    at the side, numbered in the order of ``seq``. Parts: node, edge, and unknown for an
    edge whose end is no node (label names what is missing). Line breaks in texts are
    written as a backslash and an n.
    """
    row = F.row_number().over(Window.partitionBy("diagram_id").orderBy("seq")) - 1
    last = F.max("seq").over(Window.partitionBy("diagram_id", "id"))
    placed = nodes.withColumn("row", row).withColumn("last", last).where("seq = last").withColumn("y", (FLOW_TOP + F.col("row") * ROW_HEIGHT).cast("double"))
    text, kind = F.coalesce("text", F.lit("")), F.coalesce("type", F.lit("process"))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\\n"), F.lit("")))) / 2 + 1
    shape = F.when(kind.isin("start", "end"), "rounded").when(kind == "decision", "diamond").otherwise("box")
    box = F.when(kind == "decision", DIAMOND_WIDTH).otherwise(BOX_WIDTH)
    shown = placed.select("diagram_id", *_element("node", F.col("seq"), shape, text, x=width / 2, y=F.col("y"), width=box, height=BOX_HEIGHT + LINE_HEIGHT * n_lines))
    end = lambda side: placed.select("diagram_id", F.col("id").alias(side), F.col("row").alias(f"{side}_row"), F.col("y").alias(f"{side}_y"))
    ended = edges.join(end("src"), ["diagram_id", "src"], "left").join(end("dst"), ["diagram_id", "dst"], "left")
    unknown = F.concat_ws(",", F.when(F.col("src_row").isNull(), F.coalesce("src", F.lit(""))), F.when(F.col("dst_row").isNull(), F.coalesce("dst", F.lit(""))))
    lost = ended.where("src_row IS NULL OR dst_row IS NULL").select("diagram_id", *_element("unknown", F.col("seq"), F.lit("none"), unknown))
    known = ended.where("src_row IS NOT NULL AND dst_row IS NOT NULL").withColumn("side", F.abs(F.col("src_row") - F.col("dst_row")) > 1)
    track = F.sum(F.col("side").cast("int")).over(Window.partitionBy("diagram_id").orderBy("seq", "src", "dst").rowsBetween(Window.unboundedPreceding, 0)) - 1
    known = known.withColumn("bend", F.when(F.col("side"), F.lit(float(width - FLOW_PAD - TRACK_FIRST)) - track * TRACK_STEP))
    side, label = F.col("side"), F.when(F.coalesce("label", F.lit("")) != "", F.col("label"))
    either = lambda a, b: F.when(side, a).otherwise(b)
    middle = F.lit(width / 2)
    drawn = known.select(
        "diagram_id",
        *_element(
            "edge",
            F.col("seq"),
            either(F.lit("side"), F.lit("straight")),
            label,
            x=either(middle + SIDE_LEFT, middle),
            y=either(F.col("src_y"), F.col("src_y") + ARROW_GAP),
            bend_x=F.col("bend"),
            to_x=either(middle + SIDE_LEFT, middle),
            to_y=either(F.col("dst_y"), F.col("dst_y") - ARROW_GAP),
            label_x=F.when(label.isNotNull(), either(F.col("bend") - SIDE_LABEL, middle + LABEL_RIGHT)),
            label_y=F.when(label.isNotNull(), either(F.col("src_y"), (F.col("src_y") + F.col("dst_y")) / 2)),
        ),
    )
    return shown.unionByName(drawn).unionByName(lost)


def flow_parts(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as ``flow_layout`` takes them, of the flows among ``configs(diagram_id, config)``, texts of JSON."""
    parsed = configs.select("diagram_id", F.try_parse_json("config").alias("v")).where(F.try_variant_get("v", "$.type", "string") == "flow")
    of = lambda name: parsed.select("diagram_id", F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("seq", "e"))
    take = lambda key, name=None: F.try_variant_get("e", f"$.{key}", "string").alias(name or key)
    return of("nodes").select("diagram_id", "seq", take("id"), take("text"), take("type")), of("edges").select("diagram_id", "seq", take("from", "src"), take("to", "dst"), take("label"))


def sequence_layout(configs: DataFrame) -> DataFrame:
    """The columns of ``flow_layout``: elements of the sequences among ``configs(diagram_id, config)``, texts of JSON.

    An object has actors (names), messages (from, to, label, note; ends are positions
    from 0, from the last if negative, or names) and a width. Parts: actor, message
    (numbered from 1), unknown for a message whose end is no actor, invalid for what is
    no JSON or has no actors, unsupported for a type that is neither sequence nor flow.
    """
    rows = configs.select("diagram_id", F.try_parse_json("config").alias("v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = rows.select("diagram_id", get("$.type", "string").alias("type"), get("$.actors", "array<string>").alias("actors"), get("$.messages", "array<variant>").alias("messages"), F.coalesce(get("$.width", "double"), F.lit(float(SEQUENCE_WIDTH))).alias("w"))
    none = F.lit(None).cast("string")
    odd = F.when(F.col("type").isNull() | ((F.col("type") == "sequence") & (F.coalesce(F.size("actors"), F.lit(0)) <= 0)), "invalid").when(~F.col("type").isin("sequence", "flow"), "unsupported")
    wrong = rows.withColumn("odd", odd).where("odd IS NOT NULL").select("diagram_id", F.col("odd"), *_element("", F.lit(0), F.lit("none"), F.col("type"))[1:]).withColumnRenamed("odd", "part")
    good = rows.where(odd.isNull() & (F.col("type") == "sequence"))
    n = F.size("actors")
    at = lambda i: SEQUENCE_PAD + (F.col("w") - 2 * SEQUENCE_PAD) * (i + 0.5) / n
    actors = good.select("diagram_id", "w", "actors", F.posexplode("actors").alias("i", "name"))
    shown = actors.select("diagram_id", *_element("actor", F.col("i"), F.lit("box"), F.col("name"), x=at(F.col("i")), y=SEQUENCE_TOP - ACTOR_UP, width=ACTOR_WIDTH, height=ACTOR_HEIGHT))
    said = good.select("diagram_id", "w", "actors", F.posexplode("messages").alias("k", "m"))
    field = lambda key, kind="string": F.try_variant_get("m", f"$.{key}", kind)

    def place(key: str) -> Column:
        number = field(key, "int")
        named = F.nullif(F.array_position("actors", field(key)), F.lit(0)) - 1
        i = F.coalesce(F.when(number < 0, number + n).otherwise(number).cast("bigint"), named)
        return F.when((i >= 0) & (i < n), i)

    said = said.withColumn("a", place("from")).withColumn("z", place("to")).withColumn("seq", F.col("k") + 1)
    unknown = F.concat_ws(",", F.when(F.col("a").isNull(), F.coalesce(field("from"), F.lit(""))), F.when(F.col("z").isNull(), F.coalesce(field("to"), F.lit(""))))
    lost = said.where("a IS NULL OR z IS NULL").select("diagram_id", *_element("unknown", F.col("seq"), F.lit("none"), unknown))
    told = said.where("a IS NOT NULL AND z IS NOT NULL")
    y = F.lit(SEQUENCE_TOP + FIRST_MESSAGE) + F.col("k") * MESSAGE_HEIGHT
    x, to = at(F.col("a")), at(F.col("z"))
    note = F.when(F.coalesce(field("note"), F.lit("")) != "", F.lit(1))
    sent = told.select("diagram_id", *_element("message", F.col("seq"), F.when(to > x, "right").otherwise("left"), F.concat_ws("\n", field("label"), F.when(note == 1, field("note"))), x=x, y=y, to_x=to, to_y=y, label_x=(x + to) / 2, label_y=y - MESSAGE_LABEL_UP, note_x=F.when(note == 1, (x + to) / 2 + NOTE_RIGHT), note_y=F.when(note == 1, y + NOTE_DOWN)))
    frame = good.select("diagram_id", *_element("frame", F.lit(0), F.lit("box"), none, x=0.0, y=0.0, width=F.col("w"), height=SEQUENCE_TOP + MESSAGE_HEIGHT * F.greatest(F.coalesce(F.size("messages"), F.lit(0)), F.lit(0)) + SEQUENCE_FOOT))
    return frame.unionByName(shown).unionByName(sent).unionByName(lost).unionByName(wrong)
