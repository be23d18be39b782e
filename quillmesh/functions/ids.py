"""Deterministic identifiers and name normalisation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def doc_id(path: Column) -> Column:
    return F.concat(F.lit("d_"), _digest(path))


def section_id(doc: Column, section: Column) -> Column:
    return F.concat(doc, F.lit("_s"), section.cast("string"))


def chunk_id(doc: Column, section: Column, chunk: Column) -> Column:
    return F.concat(section_id(doc, section), F.lit("_c"), chunk.cast("string"))


def doc_of_chunk(chunk: Column) -> Column:
    """The document's id in a chunk's id; the empty string if it isn't one."""
    parts = F.split(chunk, "_")
    return F.when((F.get(parts, F.lit(0)) == "d") & (F.size(parts) >= 2), F.concat_ws("_", F.slice(parts, 1, 2))).otherwise("")


def normalize_name(name: Column) -> Column:
    """Lower case, runs of other characters than letters, digits and _ as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tag_id(name: Column) -> Column:
    return F.concat(F.lit("t_"), _digest(F.lower(name)))


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("e_"), _digest(normalize_name(name)))


def event_id(chunk: Column) -> Column:
    return F.concat(F.lit("ev_"), _digest(chunk))


def table_name(model: str, dim: int) -> str:
    """The vector table's name of a model."""
    import re

    return f"vectors_{re.sub(r'[^0-9A-Za-z]+', '_', model).strip('_')}_{dim}"
