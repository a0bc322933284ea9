"""Scanning: which files are indexed, why others are not, and how many there are of each kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import extension, file_name, indexable, language_of

MAX_FILE_BYTES = 512 * 1024
# File names that mark credentials, and contents that are.
SECRET_NAME = r"(?i)^\.env(\..*)?$|\.pem$|\.key$|credentials.*\.json$"
SECRET_CONTENT = {
    "a private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "an AWS access key": r"AKIA[0-9A-Z]{16}",
    "a GitHub token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "a Slack token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
}


def skip_reason(path: Column, content: Column, max_bytes: int = MAX_FILE_BYTES, allow_secrets: bool = False) -> Column:
    """Why a file is left out, in words; null if it is indexed. A null content is unreadable."""
    size = F.octet_length(content)
    reason = F.when(content.isNull(), F.lit("unreadable"))
    if not allow_secrets:
        reason = reason.when(file_name(path).rlike(SECRET_NAME), F.lit("looks like it holds credentials"))
    reason = reason.when(size > max_bytes, F.concat(F.floor(size / 1024).cast("string"), F.lit(f" KB, over the {max_bytes // 1024} KB limit")))
    if not allow_secrets:
        for what, pattern in SECRET_CONTENT.items():
            reason = reason.when(content.rlike(pattern), F.lit(f"looks like it holds {what}"))
    return reason


def scan(files: DataFrame, max_bytes: int = MAX_FILE_BYTES, allow_secrets: bool = False) -> DataFrame:
    """files(relative_path, content, ...) plus extension, language and skip_reason; only indexable names, null paths left out."""
    f = files.where(F.col("relative_path").isNotNull() & indexable(F.col("relative_path")))
    return f.select(
        "*", extension(F.col("relative_path")).alias("extension"), language_of(F.col("relative_path")).alias("file_language"),
        skip_reason(F.col("relative_path"), F.col("content"), max_bytes, allow_secrets).alias("skip_reason"),
    )


def extension_histogram(files: DataFrame) -> DataFrame:
    """Indexable files by extension and language."""
    path = F.col("relative_path")
    return files.where(indexable(path)).groupBy(extension(path).alias("extension"), language_of(path).alias("file_language")).agg(F.count("*").alias("files"))
