"""Text functions on columns, with Unicode-aware classes and ``\\n`` as the only line end of patterns."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import running, settled

#: Before every pattern: Unicode classes and boundaries; only a line feed ends a line.
FLAGS = "(?Ud)"
ANY_CASE = "(?Udi)"
MULTILINE = "(?Udm)"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalised(c: Column | str) -> Column:
    """Carriage returns, alone or before line feeds, as line feeds; null as empty."""
    return F.regexp_replace(F.coalesce(column(c), F.lit("")), "\r\n?", "\n")


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at both ends, the separators U+001C to U+001F included."""
    return F.regexp_replace(column(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeezed(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(column(c), r"(?U)[\s\x1c-\x1f]+", "")


def count(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(column(c), F.lit(pattern))


def line_count(c: Column | str) -> Column:
    """Parts that line feeds make; 1 for an empty text, as a null one is taken."""
    c = F.coalesce(column(c), F.lit(""))
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


#: Decimal digits of all scripts, and what they stand for.
_DIGITS = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd"]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def digits(c: Column | str) -> Column:
    """A run of digits, of any script and length, in ASCII and without leading zeros."""
    return F.regexp_replace(F.translate(column(c), "".join(_DIGITS), _VALUES), "^0+(?=.)", "")


def ordered_digits(c: Column | str) -> Column:
    """Orders what ``digits`` gives by value: its length, then itself."""
    c = column(c)
    return F.struct(F.length(c).alias("size"), c.alias("digits"))


def next_digits(c: Column | str) -> Column:
    """The number after one that ``digits`` gives, likewise: nines at the end become zeros, the digit before them goes up."""
    c = column(c)
    head = F.regexp_replace(c, "9+$", "")
    up = F.when(head == "", F.lit("1")).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), (F.right(head, F.lit(1)).cast("int") + 1).cast("string")))
    return F.concat(up, F.repeat(F.lit("0"), F.length(c) - F.length(head)))


def contains_any(c: Column | str, literals: tuple[str, ...]) -> Column:
    return functools.reduce(lambda x, y: x | y, [F.contains(column(c), F.lit(x)) for x in literals])


def without_code(c: Column | str) -> Column:
    """Without paired fenced blocks (of back quotes or tildes) and inline code."""
    fenced = F.regexp_replace(column(c), r"(?Udms)^[ \t]*(```|~~~)[^\n]*\n.*?^[ \t]*\1[^\n]*$", "")
    return F.when(contains_any(c, ("`", "~~~")), F.regexp_replace(fenced, FLAGS + r"`[^`\n]+`", "")).otherwise(column(c))


def without_marks(c: Column | str) -> Column:
    """Without the marks of bold, code and italics, whose texts stay."""
    bold = F.regexp_replace(column(c), FLAGS + r"\*\*(.+?)\*\*", "$1")
    code = F.regexp_replace(bold, FLAGS + r"`([^`]+)`", "$1")
    return F.regexp_replace(code, FLAGS + r"(?<!\*)\*([^*]+)\*(?!\*)", "$1")


def html_escaped(c: Column | str) -> Column:
    out = F.replace(column(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def cells(c: Column | str) -> Column:
    """The trimmed cells of a table row, without the outer pipes."""
    inner = F.regexp_replace(trimmed(c), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), trimmed)


def around(gaps: Column, found: Column, i: Column, before: int = 0, after: int = 0, least: int = 2) -> Column:
    """Up to ``before`` characters before match ``i`` (0-based) and ``after`` from its begin on.

    ``gaps`` are the texts between the matches ``found``, none of which is shorter
    than ``least``, so a few neighbours suffice, cut to the length that is wanted.
    """
    one = i.cast("int") + 1
    parts = []
    if before:
        n = before // least + 1
        low = F.greatest(one - n, F.lit(1))
        end = lambda x: F.coalesce(F.right(x, F.lit(before)), F.lit(""))
        behind = F.transform(F.slice(gaps, low, one - low + 1), lambda g, k: F.concat(end(g), F.when(low + k < one, end(F.get(found, low + k - 1))).otherwise(F.lit(""))))
        parts.append(F.right(F.array_join(behind, ""), F.lit(before)))
    if after:
        n = after // least + 1
        begin = lambda x: F.coalesce(F.left(x, F.lit(after)), F.lit(""))
        ahead = F.transform(F.slice(found, one, n), lambda m, k: F.concat(begin(m), begin(F.get(gaps, one + k))))
        parts.append(F.left(F.array_join(ahead, ""), F.lit(after)))
    return F.concat(*parts)


def _pieces(rule: str, found: Column, gaps: Column, groups: dict[str, Column], context: tuple[int, int] | None) -> Column:
    """Each match of a pattern that never matches nothing, with what stands between it and the match before."""
    feeds = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))

    def one(m, i):
        gap = F.get(gaps, i)
        extra = [F.get(f, i).alias(name) for name, f in groups.items()]
        if context:
            extra.append(around(gaps, found, i, *context).alias("context"))
        return F.struct(F.lit(rule).alias("rule"), i.alias("nth"), F.length(gap).alias("gap"), feeds(gap).alias("gap_feeds"), F.length(m).alias("size"), feeds(m).alias("feeds"), m.alias("text"), *extra)

    return F.transform(found, one)


def _matches(docs: DataFrame, patterns: list[tuple[str, str]], text: Column | str, groups: tuple[int, ...], keep: tuple[str, ...], hints: dict[str, tuple[str, ...]] | None, context: tuple[int, int] | None) -> tuple[DataFrame, Column, Callable[[Column], dict[str, Column]]]:
    """(rows, placed, position): the kept columns and the pieces of each text; an array of pieces with what stands before them; start and line_no of one of its items."""
    # Matches are columns of their own, so that each text is searched once and not again for each match.
    all_groups, columns = (0, *groups), {}
    for i, (rule, p) in enumerate(patterns):
        likely = contains_any("__text", hints[rule]) if hints and rule in hints else F.col("__text").isNotNull()
        of = lambda c, kind="array<string>", likely=likely: F.when(likely, c).otherwise(F.array().cast(kind))
        columns |= {f"__m{i}_{g}": of(F.regexp_extract_all("__text", F.lit(p), F.lit(g))) for g in all_groups}
        columns[f"__s{i}"] = of(F.split("__text", p, -1))
    docs = docs.select(*keep, column(text).alias("__text")).select(*keep, *[c.alias(name) for name, c in columns.items()])
    pieces = [_pieces(rule, F.col(f"__m{i}_0"), F.col(f"__s{i}"), {f"g{g}": F.col(f"__m{i}_{g}") for g in groups}, context) for i, (rule, _) in enumerate(patterns)]
    rows = docs.select(*keep, F.flatten(F.array(*pieces)).alias("__pieces"))
    zero = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("feeds"))
    ahead = lambda state, x, name, *parts: F.when(x["nth"] == 0, F.lit(0)).otherwise(state[name]) + sum((x[p] for p in parts[1:]), x[parts[0]])
    placed = running("__pieces", zero, lambda s, x: F.struct(ahead(s, x, "chars", "gap", "size").alias("chars"), ahead(s, x, "feeds", "gap_feeds", "feeds").alias("feeds")))
    return rows, placed, lambda p: {"start": ahead(p["before"], p["item"], "chars", "gap").cast("bigint"), "line_no": (ahead(p["before"], p["item"], "feeds", "gap_feeds") + 1).cast("int")}


def find_all(docs: DataFrame, patterns: list[tuple[str, str]], text: Column | str = "text", groups: tuple[int, ...] = (), keep: tuple[str, ...] = ("doc_id",), hints: dict[str, tuple[str, ...]] | None = None, context: tuple[int, int] | None = None) -> DataFrame:
    """A row for each match of each ``(rule, pattern)``: the kept columns, rule, nth, text, the groups ``g1``, ..., start (0-based) and line_no.

    All patterns share one scan. ``hints`` names, for a rule, literals without any
    of which a text has no match, so that most texts aren't searched. Positions are
    running sums within the text's row, linear in its matches, so rows that share an
    id don't mix and nothing is exchanged. ``context`` adds so many characters before
    and from each match. A null text has no match.
    """
    rows, placed, position = _matches(docs, patterns, text, groups, keep, hints, context)
    found = rows.withColumn("__placed", F.explode(placed))
    return found.select(*keep, "__placed.item.*", *[c.alias(n) for n, c in position(F.col("__placed")).items()]).drop("gap", "gap_feeds", "size", "feeds")


def find_arrays(docs: DataFrame, patterns: list[tuple[str, str]], text: Column | str = "text", groups: tuple[int, ...] = (), keep: tuple[str, ...] = ("doc_id",), hints: dict[str, tuple[str, ...]] | None = None, context: tuple[int, int] | None = None) -> DataFrame:
    """The kept columns and ``found``: what ``find_all`` finds, as an array of rule, text, the groups, the context, start and line_no, a row a text."""
    rows, placed, position = _matches(docs, patterns, text, groups, keep, hints, context)
    names = ["rule", "text", *[f"g{g}" for g in groups], *(["context"] if context else [])]
    shown = lambda p: F.struct(*[p["item"][n].alias(n) for n in names], *[c.alias(n) for n, c in position(p).items()])
    return settled(rows, list(keep), found=F.transform(placed, shown))
