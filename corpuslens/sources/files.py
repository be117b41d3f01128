"""Documents and source trees from files, and writers of results."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import patterns as P


def read_documents(spark: SparkSession, paths: str | list[str], strict: bool = False) -> DataFrame:
    """``(doc_id, path, text)`` of UTF-8 text files, one row a file; doc_id is a hash of the path.

    Missing paths are skipped, or with ``strict`` refused; strict reading needs two files at least.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if strict and len(paths) < 2:
        raise ValueError("companion documents are compared: name two or more")
    there = []
    for p in paths:
        try:
            spark.read.text(p, wholetext=True).schema  # noqa: B018
            there.append(p)
        except AnalysisException as e:
            if strict or e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not there:
        return spark.createDataFrame([], "doc_id bigint, path string, text string")
    rows = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", T.normalised("text").alias("text"))


def spread(table: DataFrame) -> DataFrame:
    """``table`` dealt to all cores where its files make fewer partitions than there are, as one small file does; else as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, content)`` of all files below ``root``, paths relative to it.

    Spark's listing leaves out names that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root if "://" in root else re.sub(r"^file:/*", "/", root)
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-zA-Z]+:/*", "/"), "^" + re.escape("/" + re.sub(r"^[a-zA-Z]+:/*", "", base).strip("/") + "/"), "")
    return files.select(rel.alias("path"), "length", "content")


def source_files(files: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """The source files among ``files(path, length, content)``, without noise; excluded prefixes never pass."""
    rel = F.col("path")
    folders, name = F.slice(F.split(rel, "/"), F.lit(1), F.size(F.split(rel, "/")) - 1), F.element_at(F.split(rel, "/"), -1)
    noise = F.exists(folders, lambda d: d.isin(P.NOISE_FOLDERS) | d.rlike("^(" + "|".join(map(re.escape, P.NOISE_PREFIXES)) + ")"))
    under = lambda ps: F.lit(False) if not ps else F.exists(F.array(*map(F.lit, ps)), lambda p: (rel == p) | F.startswith(rel, F.concat(p, F.lit("/"))))
    ends = F.exists(F.array(*map(F.lit, P.NOISE_ENDS)), lambda e: F.endswith(rel, e))
    dotted = name.rlike(r"^.+\.[^.]+$")
    known = F.when(dotted, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(P.CODE_EXTENSIONS)).otherwise(name.rlike("^(" + "|".join(P.BARE_NAMES) + ")"))
    keep = ~noise & ~ends & known & ~under(exclude)
    if include:
        keep = keep & under(include)
    return files.where(keep).select("path", "length", "content")


def source_listing(files: DataFrame, ordered: bool = True) -> DataFrame:
    """``(path, line_no, line)``: what a listing prints, for each file the lines without blanks at their ends; ordered by path and number, unless not asked for."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    parts = F.split(text, "\n", -1)
    shown = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = files.select("path", F.posexplode(shown).alias("at", "line"))
    rows = rows.select("path", (F.col("at") + 1).alias("line_no"), F.rtrim("line").alias("line"))
    return rows.orderBy("path", "line_no") if ordered else rows


def source_line_counts(files: DataFrame) -> DataFrame:
    """``(path, n_lines)``; 0 for what isn't UTF-8."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    n = T.line_count(text) - F.when(F.endswith(text, F.lit("\n")) | (text == ""), 1).otherwise(0)
    return files.select("path", F.when(text.isNull(), F.lit(0)).otherwise(n).cast("bigint").alias("n_lines"))


def source_summary(files: DataFrame, lines_per_page: int = 50) -> DataFrame:
    """``(n_files, n_lines, pages)``: totals, and about how many pages a listing takes."""
    total = source_line_counts(files).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))
    return total.select("n_files", "n_lines", (F.floor(F.col("n_lines") / lines_per_page) + F.floor(F.col("n_files") / 3) + 3).cast("bigint").alias("pages"))


def write_report(report: DataFrame, path: str) -> None:
    """Writes rows as JSON lines."""
    report.write.mode("overwrite").json(path)


STYLE = """
body { max-width: 50em; margin: 0 auto; padding: 2em; line-height: 1.6; font-family: "Microsoft YaHei", "SimSun", sans-serif; }
table { width: 100%; border-collapse: collapse; }
td, th { border: 1px solid #aaa; padding: 0.3em 0.6em; }
th { background: #eee; }
pre { padding: 0.8em; overflow-x: auto; background: #f5f5f5; }
code { font-family: Consolas, monospace; }
blockquote { margin: 1em 0; padding: 0 1em; border-left: 0.3em solid #ccc; color: #555; }
img { display: block; max-width: 100%; margin: 1em auto; }
"""


def pages(html: DataFrame, language: str = "zh-CN") -> DataFrame:
    """``(name, content)``: complete pages of ``html(doc_id, html)``, with their style, named by their ids."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    head = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="{language}">\n<head>\n<meta charset="UTF-8">\n<title>'), T.html_escaped(name), F.lit(f"</title>\n<style>{STYLE}</style>\n</head>\n<body>\n"))
    return html.select(F.concat(name, F.lit(".html")).alias("name"), F.concat(head, F.col("html"), F.lit("\n</body>\n</html>\n")).alias("content"))


def write_html(html: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes ``(doc_id, html)`` as files, a complete page each."""
    from .datasource import write_files

    write_files(pages(html), path, overwrite)
