"""Content fetch by reference and parser dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.text import is_blank

PARSER_VERSION = "0.1.0"


def load_content(versions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds ``content`` (binary): inline references are decoded, path references joined to ``files``.

    ``files(path, content)`` is a ``binaryFile`` scan or any landed blob table.
    """
    inline = F.startswith(F.col("content_ref"), F.lit("inline:"))
    decoded = F.when(inline, F.try_to_binary(F.substring(F.col("content_ref"), 8, 1 << 30), F.lit("base64")))
    if files is None:
        return versions.withColumn("content", decoded)
    f = files.select(
        F.regexp_replace("path", r"^file:(//)?(?=/)", "").alias("_path"), F.col("content").alias("_content")
    )
    joined = versions.join(f, F.col("content_ref") == F.col("_path"), "left")
    return joined.withColumn("content", F.coalesce(decoded, F.col("_content"))).drop("_path", "_content")


def parser_type(external_id: Column, mime_type: Column) -> Column:
    low = F.lower(external_id)
    mail = mime_type.isin("message/rfc822", "text/email") | F.startswith(low, F.lit("email:"))
    calendar = (mime_type == "text/calendar") | F.contains(low, F.lit("calendar_event"))
    pdf = F.endswith(low, F.lit(".pdf")) | (mime_type == "application/pdf")
    markdown = F.endswith(low, F.lit(".md")) | F.endswith(low, F.lit(".markdown"))
    return F.when(mail, "text").when(calendar, "text").when(pdf, "pdf").when(markdown, "markdown").otherwise("text")


def parse_documents(loaded: DataFrame) -> DataFrame:
    """Adds ``parser_type``, ``parser_version``, ``text`` and ``parse_error``.

    PDF text needs a per-file library; those rows carry a parse error and no text.
    """
    kind = parser_type(F.col("external_id"), F.col("mime_type"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    out = loaded.withColumn("parser_type", kind).withColumn("parser_version", F.lit(PARSER_VERSION))
    error = (
        F.when(F.col("parser_type") == "pdf",
               F.concat(F.lit("PDF parse failed for "), F.col("external_id")))
        .when(F.col("content").isNull(), F.concat(F.lit("Cannot load content: "),
                                                  F.coalesce("content_ref", F.lit(""))))
    )
    return out.withColumn("parse_error", error).withColumn(
        "text", F.when(F.col("parse_error").isNull(), text)
    )


def parse_outcome() -> Column:
    """Extraction status implied by a parsed row."""
    return (
        F.when(F.col("parse_error").isNotNull(), "failed")
        .when(is_blank(F.col("text")), "skipped")
        .otherwise("completed")
    )
