"""Document cleaning, chunking and profiling.

A document is a row; everything inside it (lines, windows, paragraphs, table
cells) is handled with array functions in that row, so these operators add no
shuffle. Only chunk numbers that run across pages need one.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.functions.scalars import WHITESPACE, col, collapse_whitespace, explode_once, let, strip
from wardlens.functions.stats import row_numbers
from wardlens.session import ship_by_value

ship_by_value(__name__)

# Window sizes, shortest kept chunk, double-encoding markers, invisible characters.
FIXED_SIZE, FIXED_OVERLAP = 1000, 200
PACKED_SIZE, PACKED_OVERLAP, SHORTEST_CHUNK = 1800, 250, 20
MARKERS = "âÂÃð"
INVISIBLE = "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}]"
#: What the repair, the line steps and the trimming act on, but for single spaces.
UNTIDY = f"  |[{MARKERS}{INVISIBLE[1:-1]}{WHITESPACE[1:-1].replace('{20}', '{1f}')}]"
#: Strings that become Python objects at once.
COMPOSED_AT_ONCE = 500


def clean_document_text(value: str | Column) -> Column:
    """NUL to space, runs of blanks to one, at most one empty line, ends stripped."""
    text = F.regexp_replace(col(value), "[\\x{0} \t]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def normalize_document_lines(value: str | Column) -> Column:
    """Unix line ends, plain spaces, no invisible characters, no empty lines."""
    text = F.regexp_replace(col(value), "\r\n|\r", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "\\x{a0}", " "), INVISIBLE, "")
    lines = F.transform(F.split(text, "\n", -1), lambda line: strip(F.regexp_replace(line, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def _composed(values: pa.Array) -> pa.Array:
    """Compatibility composition of the strings that are not ASCII, a few at a time: the batch itself stays in Arrow."""
    parts = []
    for start in range(0, len(values), COMPOSED_AT_ONCE):
        part = values.slice(start, COMPOSED_AT_ONCE)
        wide = pc.fill_null(pc.invert(pc.string_is_ascii(part)), False)
        texts = [unicodedata.normalize("NFKC", v) for v in part.filter(wide).to_pylist()]
        parts.append(pc.replace_with_mask(part, wide, pa.array(texts, part.type)) if texts else part)
    return pa.concat_arrays(parts) if parts else values


@F.arrow_udf(T.StringType())
def nfkc(values: pa.Array) -> pa.Array:
    """Compatibility composition, which no SQL function offers (Arrow batches)."""
    return _composed(values)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def nfkc_cells(tables: pa.Array) -> pa.Array:
    rows = tables.flatten()
    # Offsets count from the first string that is left, as flattening drops what missing rows and tables hold.
    lists = lambda of, values: type(of).from_arrays(_offsets(of), values, mask=of.is_null())
    return lists(tables, lists(rows, _composed(rows.flatten())))


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), lists.offsets.type)


def repair_double_encoding(value: str | Column) -> Column:
    """Undo UTF-8 read as Latin-1, where the text shows it and the repair removes markers.

    Text that cannot be such a misreading, or would not be valid UTF-8, is kept.
    """
    text = col(value)
    repaired = F.encode(text, "ISO-8859-1").cast("string")

    def markers(t: Column) -> Column:
        return F.length(t) - F.length(F.translate(t, MARKERS, ""))

    latin = ~text.rlike("[^\\x{0}-\\x{ff}]")
    better = F.when(latin & text.rlike(f"[{MARKERS}]"), F.is_valid_utf8(repaired) & (markers(text) > markers(repaired)))
    return F.when(better, repaired).otherwise(text)


def clean_text(value: str | Column) -> Column:
    """Full cleaning: repair, compatibility form, line normalisation."""
    return normalize_document_lines(nfkc(repair_double_encoding(value)))


def _windows(text: Column, size: int, overlap: int, stop_at_end: bool = True) -> Column:
    """Overlapping windows as an array of stripped, non-blank pieces.

    The count is known from the length: the last window is the first to reach
    the end, or the last to start before it when ``stop_at_end`` is off.
    """
    step = size - overlap

    def cut(text: Column) -> Column:
        length = F.length(text)
        reach = length - overlap if stop_at_end else length
        starts = F.sequence(F.lit(0), F.greatest(F.ceil(reach / F.lit(float(step))), F.lit(1)).cast("int") - 1)
        pieces = F.transform(starts, lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
        return F.when(length > 0, F.filter(pieces, lambda piece: piece != "")).otherwise(F.array().cast("array<string>"))

    return let(text, cut)


def fixed_windows(value: str | Column, size: int = FIXED_SIZE, overlap: int = FIXED_OVERLAP) -> Column:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    return _windows(collapse_whitespace(F.coalesce(col(value), F.lit(""))), size, overlap)


def packed_windows(value: str | Column, size: int = PACKED_SIZE, overlap: int = PACKED_OVERLAP, shortest: int = SHORTEST_CHUNK) -> Column:
    """Paragraphs packed greedily up to ``size``; a tail of the last chunk opens the next.

    The fold keeps ``(done, open)``; ``open`` is the chunk being filled.
    """
    text = clean_document_text(F.coalesce(col(value), F.lit("")))
    paragraphs = F.filter(F.transform(F.split(text, f"\n{WHITESPACE}*\n", -1), strip), lambda p: p != "")

    def state(done: Column, open_: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"))

    def add(acc: Column, paragraph: Column) -> Column:
        done, open_ = acc.getField("done"), acc.getField("open")
        flushed = F.when(open_ != "", F.concat(done, F.array(strip(open_)))).otherwise(done)
        joined = F.when(open_ != "", F.concat(open_, F.lit("\n\n"), paragraph)).otherwise(paragraph)
        carried = F.concat(F.right(open_, F.lit(overlap)), F.lit("\n\n"), paragraph)
        return (
            F.when(F.length(paragraph) > size, state(F.concat(flushed, _windows(paragraph, size, overlap)), F.lit("")))
            .when(F.length(joined) <= size, state(done, joined))
            .when(F.length(carried) <= size, state(flushed, carried))
            .otherwise(state(F.concat(flushed, _windows(carried, size, overlap, stop_at_end=False)), F.lit("")))
        )

    def finish(acc: Column) -> Column:
        done, open_ = acc.getField("done"), acc.getField("open")
        return F.when(open_ != "", F.concat(done, F.array(strip(open_)))).otherwise(done)

    folded = F.aggregate(paragraphs, state(F.array().cast("array<string>"), F.lit("")), add, finish)
    return F.filter(folded, lambda chunk: F.length(chunk) >= shortest)


def _chunk_rows(documents: DataFrame, keys: list[str], windows: Column) -> DataFrame:
    """``(keys, chunk_id from 1, chunk_count, text)``."""
    cut = documents.select(*keys, windows.alias("chunks"))
    # Counted before the explode, so the array is not carried along with each of its rows.
    counted = cut.select(*keys, F.size("chunks").alias("chunk_count"), "chunks")
    rows = explode_once(counted, [*keys, "chunk_count"], "chunks")
    return rows.select(*keys, (F.col("position") + 1).alias("chunk_id"), "chunk_count", F.col("item").alias("text"))


def fixed_chunks(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = FIXED_SIZE, overlap: int = FIXED_OVERLAP) -> DataFrame:
    return _chunk_rows(documents, [key], fixed_windows(text, size, overlap))


def paragraph_chunks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _chunk_rows(documents, [key], packed_windows(text))


def page_chunks(pages: DataFrame, document: str, page: str, text: str = "text", packed: bool = False) -> DataFrame:
    """Chunks of every page, numbered through the pages of their document.

    Numbering splits a document that dominates the collection by page range.
    """
    windows = packed_windows(text) if packed else fixed_windows(text)
    rows = _chunk_rows(pages, [document, page], windows).withColumnRenamed("chunk_id", "page_chunk")
    numbered = row_numbers(rows, [document], [page, "page_chunk"], axis=page, name="chunk_id")
    return numbered.select(document, "chunk_id", F.col(page).alias("page_number"), "text")


def section_chunks(documents: DataFrame, key: str = "doc_id", size: int = FIXED_SIZE, overlap: int = FIXED_OVERLAP) -> DataFrame:
    """Chunks of a sectioned document: styled paragraphs first, then table rows.

    Input columns: ``paragraphs`` (array of text, style) and ``tables`` (array
    of table_number, rows).
    """

    def entries(text: Column, section: str, number: Column) -> Column:
        return F.transform(
            fixed_windows(text, size, overlap),
            lambda t: F.struct(F.lit(section).alias("section"), number.cast("int").alias("table_number"), t.alias("text")),
        )

    def paragraph(p: Column) -> Column:
        styled = F.coalesce(p.getField("style"), F.lit("")) != ""
        text = F.coalesce(p.getField("text"), F.lit(""))
        return entries(F.when(styled, F.concat(p.getField("style"), F.lit(": "), text)).otherwise(text), "paragraph", F.lit(None))

    def table(t: Column) -> Column:
        def row(cells: Column) -> Column:
            cleaned = F.filter(F.transform(cells, lambda c: collapse_whitespace(F.coalesce(c, F.lit("")))), lambda c: c != "")
            line = F.concat(F.lit("Table "), t.getField("table_number"), F.lit(": "), F.array_join(cleaned, " | "))
            return entries(F.when(F.size(cleaned) > 0, line).otherwise(""), "table", t.getField("table_number"))

        return F.flatten(F.transform(t.getField("rows"), row))

    chunks = F.concat(F.flatten(F.transform("paragraphs", paragraph)), F.flatten(F.transform("tables", table)))
    rows = explode_once(documents.select(key, chunks.alias("chunks")), [key], "chunks")
    return rows.select(key, (F.col("position") + 1).alias("chunk_id"), "item.section", "item.table_number", "item.text")


def clean_table_cells(rows: str | Column, compatibility: bool = False) -> Column:
    """Every cell cleaned, missing cells empty; ``compatibility`` adds the NFKC step."""
    cells = nfkc_cells(col(rows)) if compatibility else col(rows)

    def clean(cell: Column) -> Column:
        text = F.coalesce(cell, F.lit(""))
        # One look tells the cells in which no step but the last, the trimming, has anything to do.
        return F.when(text.rlike(UNTIDY), normalize_document_lines(repair_double_encoding(text))).otherwise(F.trim(text))

    return F.transform(cells, lambda row: F.transform(row, clean))


def document_profile(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters, tables and paragraphs of sectioned documents."""
    characters = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p.getField("text")), F.lit(0)))
    return documents.select(
        key,
        characters.alias("total_text_characters"),
        F.size("tables").alias("total_tables"),
        F.lit(None).cast("int").alias("total_pages"),
        F.size("paragraphs").alias("total_paragraphs"),
    )


def page_profile(pages: DataFrame, document: str, text: str = "text", tables: Column | None = None) -> DataFrame:
    """The same measures for documents stored as one row per page."""
    return pages.groupBy(F.col(document).alias("doc_id")).agg(
        F.sum(F.coalesce(F.length(text), F.lit(0))).alias("total_text_characters"),
        F.sum(tables if tables is not None else F.lit(0)).alias("total_tables"),
        F.count(F.lit(1)).alias("total_pages"),
        F.lit(0).alias("total_paragraphs"),
    )


def document_normal_form(documents: DataFrame) -> DataFrame:
    """Common record per document; part counts apply to the kinds that have such parts."""
    kind = F.col("file_type")
    return documents.select(
        "document_name",
        "file_type",
        F.when(kind.isin("csv", "xlsx"), "structured_dataset").otherwise("document").alias("content_type"),
        F.when(kind == "pdf", F.size("pages")).alias("total_pages"),
        F.when(kind == "docx", F.size("paragraphs")).alias("total_paragraphs"),
        F.when(kind == "docx", F.size("tables")).alias("total_tables"),
    )
