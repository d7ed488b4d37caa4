"""Memory files that other tools keep: whether each source is there and readable, and their capture as drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Endings of the files that can be read, and what a source is found to be.
ENDINGS = ("md", "markdown", "txt")
STATUS = {
    "source_missing": "missing", "file_supported": "supported", "unsupported_file_extension": "drifted", "directory_contains_supported_files": "supported",
    "directory_has_no_supported_files": "drifted", "directory_empty": "supported", "source_unreadable": "drifted", "unsupported_path_type": "drifted",
}


def _readable(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*ENDINGS)


def health(sources: DataFrame, files: DataFrame) -> DataFrame:
    """source, files, readable, status and reason.

    ``sources`` has source, path, type (missing, file, directory, unreadable or
    another type), ``files`` source and path of all files below directories.
    """
    n = files.groupBy("source").agg(F.count("*").alias("files"), F.count_if(_readable(F.col("path"))).alias("readable"))
    rows = sources.join(n, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("files", "readable")})
    reason = (
        F.when(F.col("type") == "missing", "source_missing")
        .when(F.col("type") == "file", F.when(_readable(F.col("path")), "file_supported").otherwise("unsupported_file_extension"))
        .when(F.col("type") == "unreadable", "source_unreadable").when(F.col("type") != "directory", "unsupported_path_type")
        .when(F.col("readable") > 0, "directory_contains_supported_files").when(F.col("files") > 0, "directory_has_no_supported_files")
        .otherwise("directory_empty")
    )
    status = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return rows.select("source", "files", "readable", status[reason].alias("status"), reason.alias("reason"))


def capture(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Readable, non-blank files (source, path, text) of supported sources."""
    good = health(sources, files).filter("status = 'supported'").select("source")
    return files.join(good, "source", "left_semi").filter(_readable(F.col("path")) & (F.regexp_replace("text", r"^\s+|\s+$", "") != ""))
