"""Array functions that stay within a row, and columns that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running(items: str, zero: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """An array of ``(before, item)``: every item of the array column ``items`` with the state before it.

    The state begins with ``zero``; ``step(state, item)`` gives the next. Folding appends
    to an array, which copies it, so items are folded in blocks whose results are appended
    as wholes: time grows with the items, not with their square. ``items`` must be a column
    of its own, as it is read once a block.
    """
    every = F.col(items)
    pair = lambda state, x: F.struct(state.alias("before"), x.alias("item"))
    none = F.transform(F.slice(every, 1, 0), lambda x: pair(zero, x))
    last = F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(every, k * block + 1, F.lit(block)))
    both = lambda state, done: F.struct(state.alias("state"), done.alias("done"))
    one = lambda a, x: both(step(a["state"], x), F.concat(a["done"], F.array(pair(a["state"], x))))
    whole = lambda a, b: F.aggregate(b, both(a["state"], none), one, lambda z: both(z["state"], F.concat(a["done"], z["done"])))
    return F.aggregate(blocks, both(zero, none), whole, lambda a: a["done"])


def settled(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns ``keep`` of ``df`` and the new ``columns``, which are worked out once whatever is asked of them.

    A filter on a column is else moved below the expressions that make it and repeats
    them, which for a chain of expressions grows with a power of its length.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
