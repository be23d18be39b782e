"""Table functions for SQL: markdown_sections, markdown_links and chunk_windows, for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources import markdown
from .text import windows_sql


def _sections(path: str | None, text: str | None) -> list[dict]:
    body = text or ""
    return markdown.sections(body, markdown.frontmatter(body)[1], path or "")


@udtf(returnType="sec_idx int, level int, parent_idx int, section_path string, char_start int, body string")
class MarkdownSections:
    """(path, text): the sections of a file; a null text is empty."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        for s in _sections(path, text):
            yield s["sec_idx"], s["level"], s["parent_idx"], s["section_path"], s["char_start"], s["body"]


@udtf(returnType="sec_idx int, kind string, target string, anchor string, pos int, raw string")
class MarkdownLinks:
    """(path, text): the links of a file that stay in the corpus."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        for s in _sections(path, text):
            for x in s["links"]:
                yield s["sec_idx"], x["kind"], x["target"], x["anchor"], x["pos"], x["raw"]


def register(spark: SparkSession, max_chars: int = 1200, overlap: int = 150) -> None:
    """Make the functions known to the session's SQL: markdown_sections(path, text), markdown_links(path, text), and
    chunk_windows(text), which is SQL itself, with windows of max_chars that overlap."""
    spark.udtf.register("markdown_sections", MarkdownSections)
    spark.udtf.register("markdown_links", MarkdownLinks)
    body = windows_sql("body", max_chars, overlap)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION chunk_windows(body STRING) RETURNS TABLE(chunk_idx INT, char_start INT, char_end INT) RETURN SELECT i, w.s, w.e FROM (SELECT posexplode({body}) AS (i, w))")
