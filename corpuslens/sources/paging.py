"""Listings of sources in pages.

A cover takes the first page, the list of files the next ones; each file begins a
page of its own with a line that names it. Which page a file begins on is a running
sum over all files before it, made without bringing them to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import source_line_counts, source_listing
from .storage import running_sums

LINES_A_PAGE = 50
#: Lines of the list of files beside one a file: its title and the head of its table.
LIST_HEAD = 2


def file_pages(files: DataFrame, lines_per_page: int = LINES_A_PAGE) -> DataFrame:
    """``(path, n_lines, file_no, first_page, last_page)`` of ``files(path, content)``, in the order of their paths.

    Paths that repeat are files of their own, in the order of their lines' number.
    """
    counted = source_line_counts(files)
    pages = F.ceil((F.col("n_lines") + 1) / lines_per_page).cast("bigint")
    placed = running_sums(counted.withColumn("pages", pages), ["path", "n_lines"], {"files_before": F.lit(1).cast("bigint"), "pages_before": F.col("pages")})
    front = 1 - (-(counted.count() + LIST_HEAD) // lines_per_page)
    first = F.lit(front) + F.col("pages_before") + 1
    return placed.select("path", "n_lines", (F.col("files_before") + 1).alias("file_no"), first.alias("first_page"), (first + F.col("pages") - 1).alias("last_page"))


def source_pages(files: DataFrame, lines_per_page: int = LINES_A_PAGE) -> DataFrame:
    """``(path, line_no, page, place, line)``: what stands on each page of the listing of ``files(path, content)``; line 0 names the file.

    Paths are distinct, as in a source tree.
    """
    pages = file_pages(files, lines_per_page)
    title = pages.select("path", F.lit(0).alias("line_no"), "first_page", F.format_string("文件：%s（%d 行）", "path", "n_lines").alias("line"))
    body = source_listing(files, ordered=False).join(pages.select("path", "first_page"), "path").select("path", "line_no", "first_page", "line")
    page = (F.col("first_page") + F.floor(F.col("line_no") / lines_per_page)).cast("bigint")
    return title.unionByName(body).select("path", "line_no", page.alias("page"), (F.col("line_no") % lines_per_page + 1).alias("place"), "line")
