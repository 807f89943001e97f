"""Connector payloads landed as JSON -> discovered objects (repository, mail, calendar, drive)."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from knowloom.functions.hashing import fingerprint
from knowloom.functions.text import strip
from knowloom.sources.folder import DEFAULT_EXTENSIONS

TREE_SCHEMA = "array<struct<path:string,type:string>>"
EVENT_SCHEMA = (
    "id string, etag string, summary string, description string, location string, "
    "start struct<dateTime:string,date:string>, end struct<dateTime:string,date:string>"
)
FILE_SCHEMA = "id string, name string, mimeType string, modifiedTime string, md5Checksum string"
DOC_MIME = "application/vnd.google-apps.document"


def inline_ref(text: Column) -> Column:
    return F.concat(F.lit("inline:"), F.base64(F.encode(text, "UTF-8")))


def _discovered(df: DataFrame, external_id, object_type, content_hash, mime_type, content_ref) -> DataFrame:
    return df.select(
        external_id.alias("external_id"),
        F.lit(object_type).alias("object_type"),
        content_hash.alias("content_hash"),
        mime_type.alias("mime_type"),
        content_ref.alias("content_ref"),
    )


def _ends_with_any(name: Column, extensions: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for e in extensions:
        hit = hit | F.endswith(F.lower(name), F.lit(e.lower()))
    return hit


def repository_objects(
    trees: DataFrame, contents: DataFrame, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS
) -> DataFrame:
    """``trees(owner, repo, branch, tree)`` x ``contents(owner, repo, branch, path, encoding, content)``."""
    blobs = (
        trees.select("owner", "repo", "branch", F.explode("tree").alias("item"))
        .filter(F.col("item.type") == "blob")
        .select("owner", "repo", "branch", F.col("item.path").alias("path"))
        .filter(_ends_with_any(F.col("path"), extensions))
    )
    bodies = contents.filter(F.col("encoding") == "base64").select(
        "owner", "repo", "branch", "path", F.sha2(F.try_to_binary("content", F.lit("base64")), 256).alias("hash")
    )
    joined = blobs.join(bodies, ["owner", "repo", "branch", "path"])
    ref = F.concat(F.lit("github://"), F.concat_ws("/", "owner", "repo", "branch", "path"))
    return _discovered(joined, F.col("path"), "file", F.col("hash"), F.lit(None).cast("string"), ref)


MESSAGE_SCHEMA = "id string, historyId string, payload struct<headers:array<struct<name:string,value:string>>>"


def _walk_text_parts(payload: str | None) -> str | None:
    """Decoded text parts of one message, joined by line ends, to any depth.

    A part precedes its children and children run last to first. Parts that are no base64 are left out.
    """
    try:
        waiting = [json.loads(payload)] if payload else []
    except (ValueError, RecursionError):
        return None
    texts = []
    while waiting:
        part = waiting.pop()
        if not isinstance(part, dict):
            continue
        body = part.get("body")
        data = body.get("data") if isinstance(body, dict) else None
        if isinstance(data, str) and data and str(part.get("mimeType")).startswith("text/"):
            try:
                texts.append(base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace"))
            except ValueError:
                pass
        parts = part.get("parts")
        waiting.extend(parts if isinstance(parts, list) else [])
    return "\n".join(texts)


@F.pandas_udf(StringType())
def text_parts(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrow-batched walk over message payloads: nesting has no fixed depth, which column types would need."""
    for batch in payloads:
        yield batch.map(_walk_text_parts, na_action="ignore").astype(object)


def mail_objects(messages: DataFrame, column: str = "value") -> DataFrame:
    """One message JSON per row -> text document with subject, sender and the text of all nested parts."""
    m = messages.select(
        F.from_json(column, MESSAGE_SCHEMA).alias("m"), text_parts(F.get_json_object(column, "$.payload")).alias("body")
    ).select("m.*", "body")
    headers = F.coalesce(F.col("payload.headers"), F.array().cast("array<struct<name:string,value:string>>"))

    def header(name: str, default: str) -> Column:
        found = F.filter(headers, lambda h: h["name"] == name)
        return F.when(
            F.size(found) > 0, F.coalesce(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))
        ).otherwise(default)

    body = strip(F.col("body"))
    text = strip(
        F.concat(
            F.lit("Subject: "), header("Subject", "(no subject)"), F.lit("\nFrom: "), header("From", ""),
            F.lit("\n\n"), F.coalesce(body, F.lit("")),
        )
    )
    return _discovered(
        m, F.col("id"), "email", fingerprint(F.col("id"), F.col("historyId")), F.lit("message/rfc822"),
        inline_ref(text),
    )


def calendar_objects(
    events: DataFrame,
    column: str = "value",
    now: Column | None = None,
    past_days: int = 365,
    future_days: int = 90,
) -> DataFrame:
    """``events(calendar_id, value)``; with ``now`` only events starting inside the horizon are kept."""
    e = events.select("calendar_id", F.from_json(column, EVENT_SCHEMA).alias("e")).select("calendar_id", "e.*")

    def when(c: str) -> Column:
        return F.coalesce(
            F.nullif(F.col(f"{c}.dateTime"), F.lit("")), F.nullif(F.col(f"{c}.date"), F.lit("")), F.lit("")
        )

    if now is not None:
        starts = F.try_to_timestamp(F.nullif(when("start"), F.lit("")))
        e = e.filter(
            starts.between(now - F.make_dt_interval(F.lit(past_days)), now + F.make_dt_interval(F.lit(future_days)))
        )
    location = F.coalesce("location", F.lit(""))
    text = strip(
        F.concat(
            F.lit("Event: "), F.coalesce("summary", F.lit("(no title)")),
            F.lit("\nWhen: "), when("start"), F.lit(" — "), when("end"), F.lit("\n"),
            F.when(location != "", F.concat(F.lit("Location: "), location)).otherwise(""),
            F.lit("\n\n"), F.coalesce("description", F.lit("")),
        )
    )
    return _discovered(
        e, F.concat_ws(":", F.col("calendar_id"), F.coalesce("id", F.lit(""))), "calendar_event",
        fingerprint(F.col("calendar_id"), F.col("id"), F.col("etag")), F.lit("text/calendar"), inline_ref(text),
    )


def drive_objects(files: DataFrame, column: str = "value", include_documents: bool = True) -> DataFrame:
    """One file JSON per row. Native documents are exported as text; other extensions are kept too."""
    f = files.select(F.from_json(column, FILE_SCHEMA).alias("f")).select("f.*")
    mime = F.coalesce("mimeType", F.lit("application/octet-stream"))
    is_doc = mime == DOC_MIME
    base = F.concat(F.lit("google://drive/"), F.col("id"))
    plain_hash = fingerprint(F.col("id"), F.col("modifiedTime"), F.col("md5Checksum"))
    doc_hash = (
        fingerprint(F.col("id"), F.col("modifiedTime"), "gdoc")
        if include_documents
        else fingerprint(F.col("id"), F.col("modifiedTime"))
    )
    doc_mime = F.lit("text/plain") if include_documents else mime
    return _discovered(
        f, F.col("id"), "file",
        F.when(is_doc, doc_hash).otherwise(plain_hash),
        F.when(is_doc, doc_mime).otherwise(mime),
        F.when(is_doc, F.concat(base, F.lit("/export?mime=text/plain"))).otherwise(base),
    )
