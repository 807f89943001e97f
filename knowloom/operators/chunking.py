"""Document text -> chunks with half-open code-point anchors."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.hashing import content_hash, stable_id
from knowloom.functions.text import bind, is_blank, strip, token_count
from knowloom.sources.content import parse_outcome

CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
SEGMENT_TYPE = "array<struct<text:string,start:int,end:int>>"
EMPTY = "empty document after parsing"


def fixed_segments(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, for texts without an empty line.

    The text is cut once into blocks of one step; a window is a block plus the head of the next block,
    so the cost is linear in the text (no ``substring`` from the start for every window).
    """
    step = size - overlap
    if overlap > step:
        raise ValueError("overlap must not exceed half of the chunk size")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def windows(n: Column) -> Column:
        count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
        return bind(
            blocks,
            lambda b: F.transform(
                F.arrays_zip(
                    F.slice(b, F.lit(1), count).alias("body"), F.slice(b, F.lit(2), count).alias("next")
                ),
                lambda z, k: F.struct(
                    strip(
                        F.concat(
                            F.coalesce(z["body"], F.lit("")),
                            F.coalesce(F.substring(z["next"], 1, overlap), F.lit("")),
                        )
                    ).alias("text"),
                    (k * step).cast("int").alias("start"),
                    F.least(k * step + size, n).cast("int").alias("end"),
                ),
            ),
        )

    return F.filter(bind(F.length(text), windows), lambda s: (s["text"] != "") & (s["start"] < s["end"]))


def _window_bounds(text: str, lo: int, hi: int, breaks: list[int], size: int, overlap: int):
    """Windows of ``text[lo:hi]``; a window ends at the last empty line of its second half, if any."""
    while lo < hi:
        end = min(lo + size, hi)
        last = bisect_right(breaks, end - 2) - 1
        if end < hi and last >= 0 and breaks[last] > lo + size // 2:
            end = breaks[last]
        yield lo, end
        lo = hi if end == hi else max(end - overlap, lo + 1)


def _section_starts(text: str) -> list[int]:
    return sorted({0, *(m.start() for m in re.finditer(r"^#{1,3}\s", text, re.M))})


def paragraph_segments(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """Arrow-batched segmenter for texts with empty lines or Markdown sections; null text stays null."""

    @F.pandas_udf(SEGMENT_TYPE)
    def segments(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, markdown in batches:
            out = []
            for text, by_heading in zip(texts, markdown, strict=True):
                if text is None:
                    out.append(None)
                    continue
                breaks = [m.start() for m in re.finditer(r"(?=\n\n)", text)]
                edges = [*(_section_starts(text) if by_heading else [0]), len(text)]
                out.append(
                    [
                        {"text": text[a:b].strip(), "start": a, "end": b}
                        for lo, hi in zip(edges, edges[1:], strict=False)
                        for a, b in _window_bounds(text, lo, hi, breaks, size, overlap)
                        if text[a:b].strip()
                    ]
                )
            yield pd.Series(out, index=texts.index, dtype=object)

    return segments


def segments(
    text: Column, markdown: Column | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> Column:
    """Segments of any text: the JVM windows, or the Arrow segmenter where structure matters.

    Only texts that need the segmenter are sent to Python, the others travel as null.
    """
    by_heading = F.coalesce(markdown, F.lit(False)) if markdown is not None else F.lit(False)
    structured = F.contains(text, F.lit("\n\n")) | (by_heading & text.rlike(r"(?Um)^#{1,3}\s"))
    special = paragraph_segments(size, overlap)(F.when(structured, text), by_heading)
    return F.when(structured, special).otherwise(fixed_segments(text, size, overlap))


def chunk_documents(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """``documents(version_id, text, [parser_type, source_id, owner_id])`` -> chunk rows.

    The only data movement is the explode; a small input of large texts can be repartitioned before.
    """
    text = F.col("text")
    md = F.col("parser_type") == "markdown" if "parser_type" in documents.columns else None
    segs = segments(text, md, size, overlap)
    carried = [c for c in ("version_id", "source_id", "owner_id") if c in documents.columns]
    rows = documents.select(*carried, F.posexplode(segs).alias("chunk_index", "seg"))
    return rows.select(
        stable_id("chunk", F.col("version_id"), F.col("chunk_index")).alias("chunk_id"),
        *carried,
        "chunk_index",
        F.col("seg.text").alias("text"),
        token_count(F.col("seg.text")).alias("token_count"),
        content_hash(F.col("seg.text")).alias("content_hash"),
        F.col("seg.start").alias("anchor_start"),
        F.col("seg.end").alias("anchor_end"),
    )


def processing_outcomes(parsed: DataFrame) -> DataFrame:
    """Status row per version: completed, skipped (blank) or failed with its message (500 characters)."""
    status = parse_outcome()
    return parsed.select(
        "version_id",
        status.alias("extraction_status"),
        F.when(status == "failed", F.left("parse_error", F.lit(500)))
        .when(is_blank(F.col("text")), F.lit(EMPTY))
        .alias("extraction_error"),
    )


def update_status(versions: DataFrame, outcomes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Left-join update of status columns; versions without an outcome keep theirs."""
    new = outcomes.select("version_id", *[F.col(c).alias(f"_n_{c}") for c in columns])
    joined = versions.join(new, "version_id", "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_n_{c}", c)).drop(f"_n_{c}")
    return joined


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of re-processed versions are replaced, the others stay."""
    kept = old.join(new.select("version_id").distinct(), "version_id", "left_anti")
    fresh = new.dropDuplicates(["version_id", "chunk_index", "embedding_model"])
    return kept.unionByName(fresh, allowMissingColumns=True)


def extraction_queue(versions: DataFrame, limit: int = 20) -> DataFrame:
    """Pending versions: relevance first, then text before other files before PDF, then oldest."""
    relevance = F.coalesce(F.get_json_object("triage_metadata", "$.relevance").cast("double"), F.lit(0.5))
    low = F.lower("external_id")
    rank = (
        F.when(F.endswith(low, F.lit(".md")) | F.endswith(low, F.lit(".txt")), 0)
        .when(F.endswith(low, F.lit(".pdf")), 2)
        .otherwise(1)
    )
    return (
        versions.filter(F.col("extraction_status") == "pending")
        .orderBy(relevance.desc(), rank, "observed_at", "version_id")
        .limit(limit)
    )


def reassembled_text(chunks: DataFrame) -> DataFrame:
    """Chunk texts of a version joined by empty lines. A group is one document, so it is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("version_id").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"),
        F.count(F.lit(1)).alias("chunks"),
    )


def source_preview(parsed: DataFrame, chunks: DataFrame, length: int = 8000) -> DataFrame:
    """Head of the text (the preview's feature) with the version's chunk list."""
    listed = chunks.groupBy("version_id").agg(
        F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("chunks")
    )
    return parsed.select("version_id", F.left("text", F.lit(length)).alias("text")).join(
        listed, "version_id", "left"
    )
