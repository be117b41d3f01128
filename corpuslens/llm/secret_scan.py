"""Secret scans over a ledger of blobs.

A text's SHA-256 is its blob; every path (document) that ever held the text, in
any version, points to it. The ledger lists which blobs were scanned under which
version of the rules, and what was found. A scan takes only pairs of blob and
rule version that the ledger lacks, one text for each blob, adds them, and joins
the findings back to all paths. Changed rules are another version, so all blobs
are scanned under them once. The ledger is filed by version, then by segments (what
one run added), then by the first characters of addresses; ``compact_ledger`` merges
segments.

Defined cases: a null text is the empty blob; copies share one scan; rows that
share a doc_id each point to their own blob; ties of spans are ordered by kind;
an empty table gives no rows and adds nothing; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, cut


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters; ``hints``: texts without any of these have no match."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()


#: Fixed patterns.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True, ("passw", "secret", "token", "api")),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hints=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hints=("private key",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
    Rule("prefixed", r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", hints=("gh", "xox", "sk_live_", "aiza")),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{3,64}@", hints=("://",)),
)
RULES = BASE_RULES + MORE_RULES
_SPANS = "array<struct<kind: string, start: int, end: int>>"
LEDGER = f"blob string, spans {_SPANS}, segment string, prefix string"
#: Characters of its address by which a blob's row is filed.
PREFIX = 1
#: No more unseen blobs (64 bytes each), or findings (about as much), than this are broadcast.
FEW_BLOBS = 100_000


def version_of(rules: tuple[Rule, ...]) -> str:
    """Names a set of rules by its content."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))) for r in rules]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all findings, by start, then in the order of the rules."""
        low = text.lower()
        out = []
        for i, (rule, pattern) in enumerate(self.rules):
            if not rule.hints or any(h in low for h in rule.hints):
                out += [(m.start(), i, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        return [(self.rules[i][0].kind, start, end) for start, i, end in sorted(out)]


def blobs_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, blob, text)``: every path with its content's address."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def _prefix(blob):
    return F.substring(blob, 1, PREFIX)


def read_ledger(spark: SparkSession, ledger_path: str, version: str) -> DataFrame:
    """What the ledger at ``ledger_path`` holds under a version; no rows if there is none yet. Other versions' rows aren't listed or read."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{ledger_path}/version={version}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen_blobs(blobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(blob)``: the addresses of ``blobs`` that ``ledger`` lacks."""
    own = blobs.select("blob", _prefix("blob").alias("prefix")).distinct()
    return own.join(ledger.select("blob", "prefix"), ["prefix", "blob"], "left_anti").select("blob")


def scan_blobs(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)`` of ``texts(blob, text)``."""

    def run(batches):
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in blocks(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array(spans, kind)], ["blob", "spans"])

    return texts.select("blob", "text").mapInArrow(run, f"blob string, spans {_SPANS}")


def _write_segment(rows: DataFrame, ledger_path: str, version: str) -> None:
    """Files ``(blob, spans)`` by prefix, as a segment of its own, so that writers don't disturb each other."""
    filed = rows.select("blob", "spans", _prefix("blob").alias("prefix"))
    filed.repartition("prefix", F.pmod(F.xxhash64("blob"), F.lit(16))).write.partitionBy("prefix").parquet(f"{ledger_path}/version={version}/segment={uuid.uuid4().hex}")


def extend_ledger(blobs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Scans the blobs that the ledger lacks under these rules and adds them as a segment; returns how many.

    A row says all about its blob, so two that say the same do no harm.
    """
    version = version_of(rules)
    unseen = cut(unseen_blobs(blobs, read_ledger(blobs.sparkSession, ledger_path, version)))
    n = unseen.count()
    if n:
        texts = blobs.select("blob", "text")
        if n <= FEW_BLOBS:  # only texts to scan are moved
            texts = texts.join(F.broadcast(unseen), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))
        else:  # copies are merged before they are moved
            texts = texts.groupBy("blob").agg(F.first("text").alias("text")).join(unseen, "blob", "left_semi")
        _write_segment(scan_blobs(texts, rules), ledger_path, version)
    return n


def compact_ledger(spark: SparkSession, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> int:
    """Merges the segments that a version has now into one, a row a blob; returns how many there were.

    The merged segment is there before the old ones go: a run that dies between leaves
    rows twice, which do no harm, and segments written meanwhile stay.
    """
    version = version_of(rules)
    ledger = read_ledger(spark, ledger_path, version)
    old = [r.segment for r in ledger.select("segment").distinct().collect()]  # a name a run since the last merge
    if len(old) > 1:
        _write_segment(ledger.where(F.col("segment").isin(old)).dropDuplicates(["blob"]), ledger_path, version)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger_path}/version={version}")
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for name in old:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"segment={name}"), True)
    return len(old)


def scan_secrets(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, blob and ``spans`` (kind, start, end; code points).

    What the ledger at ``ledger_path`` holds isn't scanned again; new rows are added to it.
    Of its findings only those of the blobs of ``docs`` are kept.
    """
    blobs = blobs_of(docs)
    extend_ledger(blobs, ledger_path, rules)
    ledger = read_ledger(docs.sparkSession, ledger_path, version_of(rules)).where(F.size("spans") > 0)
    own = blobs.select(_prefix("blob").alias("prefix"), "blob").distinct()
    findings = cut(ledger.join(own, ["prefix", "blob"], "left_semi").select("blob", "spans").dropDuplicates(["blob"]))
    n, spans = findings.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if max(n, spans) <= FEW_BLOBS:  # else the join is split at run time where copies crowd
        findings = F.broadcast(findings)
    return blobs.select("doc_id", "blob").join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))


def joined(spans):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans, *kinds: str):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
