"""Folder scan: files -> discovered objects, with glob exclusion and MIME guess."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the folder source.
DEFAULT_EXTENSIONS = (".md", ".txt", ".pdf")
DEFAULT_EXCLUDES = (
    "**/node_modules/**",
    "**/.git/**",
    "**/.venv/**",
    "**/venv/**",
    "**/__pycache__/**",
    "**/temp_uploads/**",
)
# Registered MIME types of text, office and picture files.
MIME_TYPES = {
    ".css": "text/css", ".csv": "text/csv", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".gif": "image/gif", ".htm": "text/html",
    ".html": "text/html", ".ics": "text/calendar", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".js": "text/javascript",
    ".json": "application/json", ".md": "text/markdown", ".pdf": "application/pdf", ".png": "image/png", ".py": "text/x-python",
    ".rtf": "application/rtf", ".svg": "image/svg+xml", ".tsv": "text/tab-separated-values", ".txt": "text/plain",
    ".xml": "text/xml", ".zip": "application/zip",
}


def glob_regex(glob: str) -> str:
    """Shell glob as an anchored Java regex; ``*`` also crosses ``/``."""
    out, rest = "", glob
    while rest:
        char_class = re.match(r"\[(!?)(\]?[^\]]*)\]", rest)
        if char_class:
            negate, body = char_class.groups()
            out += "[" + ("^" if negate else "") + body.replace("\\", "\\\\") + "]"
            rest = rest[char_class.end():]
            continue
        out += {"*": ".*", "?": "."}.get(rest[0]) or re.escape(rest[0])
        rest = rest[1:]
    return f"(?s)^{out}$"


def matches_any_glob(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    normalized = F.translate(path, "\\", "/")
    hit = F.lit(False)
    for glob in globs:
        hit = hit | normalized.rlike(glob_regex(glob))
    return hit


def guess_mime(ext: Column, extensions: tuple[str, ...]) -> Column:
    pairs = [F.lit(v) for e in extensions if e in MIME_TYPES for v in (e, MIME_TYPES[e])]
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*pairs), ext)


def scan_folder(
    spark: SparkSession,
    roots: list[str],
    extensions: tuple[str, ...] = DEFAULT_EXTENSIONS,
    exclude_globs: tuple[str, ...] = DEFAULT_EXCLUDES,
) -> DataFrame:
    """(external_id, object_type, content_hash, mime_type, content_ref), one row per kept file.

    With several roots the external id starts with the root's index. Directories are tested with their
    absolute path, files with the path below the root. Symbolic links are read like files.
    """
    exts = tuple(e.lower() for e in extensions)
    parts = []
    for i, root in enumerate(roots):
        base = root.rstrip("/")
        prefix = f"{i}/" if len(roots) > 1 else ""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        path = F.regexp_replace("path", r"^file:(//)?(?=/)", "")
        files = files.select(path.alias("path"), "content").withColumn(
            "relative", F.substring(F.col("path"), len(base) + 2, 1 << 30)
        )
        ext = F.lower(F.regexp_extract("relative", r"[^/]+(\.[^./]*)$", 1))
        # The tests only need the path; discovery.list_folders does not even open what they drop.
        kept = files.filter(
            ext.isin(*exts)
            & ~matches_any_glob(F.concat(F.lit(prefix), F.col("relative")), exclude_globs)
            & ~_in_excluded_directory(F.lit(base), F.col("relative"), exclude_globs)
        )
        parts.append(
            kept.select(
                F.concat(F.lit(prefix), F.col("relative")).alias("external_id"),
                F.lit("file").alias("object_type"),
                F.sha2("content", 256).alias("content_hash"),
                guess_mime(ext, exts).alias("mime_type"),
                F.col("path").alias("content_ref"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _in_excluded_directory(root: Column, relative: Column, globs: tuple[str, ...]) -> Column:
    steps = F.split(relative, "/")
    levels = F.when(F.size(steps) > 1, F.sequence(F.lit(1), F.size(steps) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.exists(
        levels,
        lambda n: matches_any_glob(F.concat_ws("/", root, F.array_join(F.slice(steps, F.lit(1), n), "/")), globs),
    )
