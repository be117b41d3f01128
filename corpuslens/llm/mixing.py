"""Mixing sources to target weights by balanced sampling.

A source's target over its size says how often its documents are taken: all of
them the whole number of times, and once more with a probability, the rest. The
cube method decides who is taken once more: probabilities move along the null
space of the balancing constraints (tokens and documents) until each is 0 or 1,
so both totals stay put. The largest document that is undecided moves against all
others of its block, which each move a little, so large ones are settled first and
what remains is small. A source is cut into blocks of bounded size by a hash of
the documents; what each block leaves, some of its smallest documents, meets in
blocks of the next level, until as few are left of the whole source. The
few whose size is a thousandth of the source's or more are settled before, against
all others of the source at once. What is left
last is the landing problem: all choices are tried, and the one whose token total
is nearest to what is due is taken.

Random choices come from hashes of ids and texts, so reruns agree.

Defined cases: null texts have size 0; a null source is a source, the last one;
a null doc_id is an id like another; rows that share doc_id, source and text are
interchangeable, and each is decided for itself; ties of size go by the hash;
sources without words have target 0; an empty table gives no rows; other columns
are ignored by ``plan_mix`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, at_most, blocks, buffers, cut, words

#: Documents decided together, and how many of them a block leaves to the next level or to landing.
BLOCK, LEAVE = 4096, 16
#: A document of more than this part of its source's size is settled before (there are fewer than that many).
LARGE = 1000
#: Most times a document is taken.
MOST = 3
#: Fewer sources than this are broadcast.
SMALL = 50_000
_CLOSE = 1e-9


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` as __c0, __c1, ... and ``__size``, the words of the text."""
    names = [f"__c{i}" for i in range(len(columns))]
    more = [] if "text" in columns else [docs["text"].alias("__text")]  # a text among the columns is sent once
    text = names[columns.index("text")] if "text" in columns else "__text"
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(columns, names, strict=True)], *more)

    def run(batches):
        for b in blocks(batches, text):
            _, _, _, first = words(*buffers(b.column(text)), NOT_SPACE, hashes=False)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(np.diff(first), pa.int64())], [*names, "__size"])

    return rows.mapInArrow(run, ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), "__size bigint"]))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: shares of the whole by weight, none above ``most`` times its size.

    Weights go round by the order of the names' code points, null last. The
    excess over a limit is shared again by weight among sources below theirs.
    """
    spark = sources.sparkSession
    ranked = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], float(weights[x[1] % len(weights)])))
    state = cut(spark.createDataFrame(ranked, f"source {sources.schema['source'].dataType.simpleString()}, source_size bigint, weight double"))
    total = state.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(most))
    level, capped = 0.0, -1
    while True:  # the level a unit of weight gets rises as sources reach their limits
        full = F.col("weight") * F.lit(level) >= limit
        n, held, free = state.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    return state.select("source", "source_size", F.least(F.col("weight") * F.lit(level), limit).alias("target"))


def _unit(*key) -> float:
    return xxhash.xxh3_64_intdigest(repr(key).encode()) / 2.0**64


def _direction(size: np.ndarray) -> np.ndarray:
    """A step of the first unit against all others that keeps the number of documents and of tokens; of tokens alone where both can't be kept."""
    others = size[1:]
    n, mean = len(others), others.mean()
    spread = float(((others - mean) ** 2).sum())
    if spread > 0:
        rest = -1 / n + (mean - size[0]) / spread * (others - mean)
    elif others[0] == 0 or size[0] == mean:
        rest = np.full(n, -1 / n)
    else:
        rest = np.full(n, -size[0] / others.sum())
    return np.concatenate(([1.0], rest))


def flight(chance: np.ndarray, size: np.ndarray, seed: str, leave: int) -> np.ndarray:
    """``chance`` moved, its sum and its sum weighted by ``size`` kept, until no more than ``leave`` units, small ones, lie between 0 and 1."""
    out = np.where(chance > 1 - _CLOSE, 1.0, np.where(chance < _CLOSE, 0.0, chance))
    at = np.flatnonzero((out > 0) & (out < 1))
    at = at[np.argsort(-size[at], kind="stable")]
    p, s = out[at], size[at].astype(float)
    step = 0
    while len(at) > leave:
        u = _direction(s)
        moves = np.abs(u) > 1e-15
        reach = np.where(moves, 1 / np.where(moves, np.abs(u), 1.0), np.inf)
        forth, back = (float((np.where((u > 0) == up, 1 - p, p) * reach).min()) for up in (True, False))
        move = forth if _unit(seed, step) * (forth + back) < back else -back
        step += 1
        p = np.clip(p + move * u, 0.0, 1.0)
        p[p < _CLOSE], p[p > 1 - _CLOSE] = 0.0, 1.0
        done = (p == 0) | (p == 1)
        out[at[done]] = p[done]
        at, p, s = at[~done], p[~done], s[~done]
    out[at] = p
    return out


def land(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the last ones: of all choices the one whose token total is nearest to what is due, then its number of documents."""
    left = np.flatnonzero((chance > 0) & (chance < 1))
    tokens, many = np.zeros(1), np.zeros(1)
    for i in left:
        tokens, many = np.concatenate([tokens, tokens + size[i]]), np.concatenate([many, many + 1])
    off = np.abs(tokens - (chance[left] * size[left]).sum())
    near = np.flatnonzero(off <= off.min() + _CLOSE)
    best = int(near[np.argmin(np.abs(many[near] - chance[left].sum()))])
    out = chance.copy()
    out[left] = [float(best >> k & 1) for k in range(len(left))]
    return out


def settle(size: np.ndarray, chance: float, n: int, s1: float, s2: float, top: float, seed: str) -> tuple[np.ndarray, float, float]:
    """Decides units of great size, given in descending order, against all other units of their source.

    The others, of which n, the sum of sizes, that of their squares and the greatest
    size are known, all begin with ``chance``. Each step moves them by a linear
    function of their size, so theirs is ``a + b * size`` after it. Returns the
    decisions, a and b.
    """
    out, a, b = np.zeros(len(size)), float(chance), 0.0
    rest = np.stack([np.ones(len(size)), size, size.astype(float) ** 2])
    sums = np.array([n, s1, s2], float) + rest.sum(axis=1)
    for i, own in enumerate(size.astype(float)):
        sums = sums - rest[:, i]
        count, total, squares = sums
        high = float(size[i + 1]) if i + 1 < len(size) else float(top)
        p = min(1.0, max(0.0, a + b * own))
        ways, spread = [], squares - total * total / count if count else 0.0
        if count and spread > 1e-9 * max(squares, 1.0):  # tokens and documents, else tokens alone
            slope = (total / count - own) / spread
            ways.append((-1 / count - slope * total / count, slope))
        if total > 0:
            ways.append((-own / total, 0.0))

        def free(way, sign, a=a, b=b, high=high):
            """How far the others can follow."""
            moves = [(a + b * s, sign * (way[0] + way[1] * s)) for s in (0.0, high)]
            return min(((1 - q if m > 0 else q) / abs(m) for q, m in moves if abs(m) > 1e-15), default=np.inf)

        up = p > _unit(seed, i)
        tries = [(way, sign) for way in ways for sign in ((1, -1) if up else (-1, 1))]
        want = lambda sign, p=p: 1 - p if sign > 0 else p
        possible = [(way, sign) for way, sign in tries if free(way, sign) >= want(sign)]
        both = [(way, sign) for way, sign in possible if free(way, -sign) >= want(-sign)]
        if possible:
            way, sign = (both or possible)[0]
            step = sign * want(sign)
        elif tries:  # neither: as far as the others can go
            way, sign = min(tries, key=lambda x: want(x[1]) - free(*x))
            step = sign * free(way, sign)
        else:
            way, sign, step = (0.0, 0.0), 1 if up else -1, 0.0
        out[i] = float(sign > 0)
        a, b = a + step * way[0], b + step * way[1]
    return out, a, b


_UNITS = ["uid", "rank", "source_no", "size", "block", "chance"]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of rows of equal ``keys``."""
    held: list[list[np.ndarray]] = []
    on = [names.index(k) for k in keys]
    whole = lambda: dict(zip(names, (np.concatenate(x) for x in zip(*held, strict=True)), strict=True))
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(c).to_numpy() for c in names]
        new = np.zeros(b.num_rows - 1, bool)
        for k in on:
            new |= rows[k][1:] != rows[k][:-1]
        for piece in zip(*(np.split(x, np.flatnonzero(new) + 1) for x in rows), strict=True):
            if held and any(held[-1][k][0] != piece[k][0] for k in on):
                yield whole()
                held = []
            held.append(list(piece))
    if held:
        yield whole()


def _settle(large: DataFrame) -> DataFrame:
    """``(source_no, uid, more, a, b)`` of the large units: each one's decision, and a row (of null uid) for the others of each source."""
    names = ["source_no", "uid", "size", "chance", "n", "s1", "s2", "top"]

    def run(batches):
        for g in _runs(batches, names, ["source_no"]):
            source = g["source_no"][0]
            more, a, b = settle(g["size"], g["chance"][0], g["n"][0], g["s1"][0], g["s2"][0], g["top"][0], f"{source}")
            k = len(more)
            yield pa.RecordBatch.from_arrays([pa.array([source] * (k + 1), pa.int64()), pa.array([*g["uid"].tolist(), None], pa.int64()), pa.array([*more.astype(int).tolist(), None], pa.int64()), pa.array([a] * (k + 1)), pa.array([b] * (k + 1))], ["source_no", "uid", "more", "a", "b"])

    placed = large.select(*names, "rank").repartition("source_no").sortWithinPartitions("source_no", F.desc("size"), "rank", "uid")
    return placed.mapInArrow(run, "source_no bigint, uid bigint, more bigint, a double, b double")


def _decide(units: DataFrame, last: bool) -> DataFrame:
    """A flight in every (source, block) of ``units``; ``last`` lands as well."""

    leave = LEAVE

    def run(batches):
        for g in _runs(batches, _UNITS, ["source_no", "block"]):
            chance = flight(g["chance"], g["size"], f"{g['source_no'][0]}/{g['block'][0]}/{len(g['uid'])}", leave)
            g["chance"] = land(chance, g["size"]) if last else chance
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in g.values()], _UNITS)

    kinds = ("bigint",) * 5 + ("double",)
    placed = units.select(*_UNITS).repartition("source_no", "block").sortWithinPartitions("source_no", "block", F.desc("size"), "rank", "uid")
    return placed.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(_UNITS, kinds, strict=True)))


def _identity(doc_id: Column, text: Column) -> Column:
    """What tells rows of a source apart."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")), F.lit("mix"))


def _plan(slim: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Per row of ``slim(doc_id, source, size, same)``: also nth, source_size, target and copies. Rows equal in all four are numbered by nth."""
    groups = cut(slim.groupBy("doc_id", "source", "size", "same").agg(F.count("*").alias("__rows")))
    per_source = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("__rows")).alias("source_size"), F.sum("__rows").alias("__n"))
    targets = source_targets(per_source.select("source", "source_size"), weights, most)
    known = per_source.select(F.col("source").alias("__source"), "__n").join(targets, F.col("__source").eqNullSafe(F.col("source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = cut(known.select("__source", F.ceil(F.col("__n") / F.lit(BLOCK)).alias("blocks"), "source_size", "target", ratio.alias("__ratio"), F.xxhash64(F.coalesce(F.col("__source").cast("string"), F.lit("\0null"))).alias("source_no")))
    most_blocks = known.agg(F.max("blocks")).first()[0] or 1
    known = F.broadcast(known) if at_most(known, SMALL) else known
    whole = F.floor(F.col("__ratio") + F.lit(_CLOSE))
    units = groups.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__rows") - 1))).join(known, F.col("source").eqNullSafe(F.col("__source")))
    units = units.withColumn("rank", F.xxhash64("same", "nth")).withColumn("whole", whole).withColumn("chance", F.greatest(F.col("__ratio") - whole, F.lit(0.0)))
    units = cut(units.withColumn("block", F.pmod("rank", F.col("blocks")).cast("bigint")).withColumn("uid", F.monotonically_increasing_id()).drop("__source", "__ratio", "blocks"))
    open_, is_large = F.col("chance") > 0, F.col("size") * F.lit(LARGE) > F.col("source_size")
    size = F.col("size").cast("double")
    rest = units.where(open_ & ~is_large).groupBy("source_no").agg(F.count("*").alias("n"), F.sum(size).alias("s1"), F.sum(size * size).alias("s2"), F.max(size).alias("top"))
    # Cut before it is dealt by source_no: a join on the same key would let the repartition go, and a split of its hot key would part a source.
    settled = cut(_settle(cut(units.where(open_ & is_large).join(rest, "source_no", "left").fillna(0, ["n", "s1", "s2", "top"]))))
    levels, fold = [settled.where("uid IS NOT NULL").select("uid", F.col("more").alias("__more"))], max(2, BLOCK // LEAVE)
    shift = settled.where("uid IS NULL").select(F.col("source_no").alias("__source_no"), "a", "b")
    shift = F.broadcast(shift) if at_most(shift, SMALL) else shift
    level = units.where(open_ & ~is_large).join(shift, F.col("source_no") == F.col("__source_no"), "left")
    level = level.withColumn("chance", F.when(F.col("a").isNull(), F.col("chance")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a") + F.col("b") * size))))
    while True:
        level = cut(_decide(level, last=most_blocks <= 1))
        levels.append(level.where("chance = 0 OR chance = 1").select("uid", F.col("chance").cast("bigint").alias("__more")))
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // fold)
        level = level.where("chance > 0 AND chance < 1").withColumn("block", F.floor(F.col("block") / F.lit(fold)))
    decided = levels[0]
    for x in levels[1:]:
        decided = decided.unionByName(x)
    return units.join(decided, "uid", "left").withColumn("copies", F.col("whole") + F.coalesce("__more", F.lit(0)))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """Per row of ``docs(doc_id, source, text)``: doc_id, source, size, source_size, target, copies, taken."""
    plan = _plan(_slim(docs), weights, most)
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _slim(docs: DataFrame) -> DataFrame:
    named = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), _identity(docs["doc_id"], docs["text"]).alias("same"), docs["text"].alias("text"))
    return sized(named, ["doc_id", "source", "same"]).withColumnsRenamed({"__c0": "doc_id", "__c1": "source", "__c2": "same", "__size": "size"})


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as the mix takes it."""
    plan = cut(_plan(_slim(docs), weights, most).select("same", F.col("source").alias("__src"), "nth", "copies"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    of = lambda name: F.col(names[docs.columns.index(name)])
    rows = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)]).withColumn("__same", _identity(of("doc_id"), of("text")))
    match = (F.col("__same") == F.col("same")) & of("source").eqNullSafe(F.col("__src"))
    if plan.where("nth > 0").limit(1).count():  # some rows repeat
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__same", of("source")).orderBy("__same")) - 1)
        match &= F.col("__nth") == F.col("nth")
    taken = rows.join(plan.where("copies > 0"), match).withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
