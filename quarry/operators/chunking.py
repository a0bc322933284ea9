"""Cutting files into chunks: line windows and the byte budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import language_of, lines

WINDOW, OVERLAP = 30, 5
#: Bytes of a chunk at most, and of the header that later pieces begin with.
MAX_BYTES, MAX_HEADER = 3100, 300


def line_windows(files: DataFrame) -> DataFrame:
    """files(relative_path, content) -> windows of 30 lines that overlap by 5, as `general` chunks named lines-a-b.

    All Catalyst: one explode, no shuffle. A null or empty file has no windows; repeated files are cut each for
    itself; other columns are dropped.
    """
    cut = files.where("relative_path is not null and content is not null").select("relative_path", lines(F.col("content")).alias("ls"))
    n = F.size("ls")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - OVERLAP - 1), F.lit(WINDOW - OVERLAP))
    out = cut.where(n > 0).select("relative_path", "ls", F.explode(starts).alias("s"))
    end = F.least(F.col("s") + WINDOW, F.size("ls"))
    return out.select(
        F.col("relative_path").alias("file_path"), F.coalesce(language_of(F.col("relative_path")), F.lit("")).alias("language"),
        F.concat(F.lit("lines-"), (F.col("s") + 1).cast("string"), F.lit("-"), end.cast("string")).alias("name"), F.lit("general").alias("chunk_type"),
        F.array_join(F.slice("ls", F.col("s") + 1, F.lit(WINDOW)), "\n").alias("content"), (F.col("s") + 1).alias("start_line"), end.alias("end_line"),
    )


def cut_bytes(text: str, limit: int) -> str:
    """The longest beginning of at most `limit` bytes that ends between characters."""
    raw = text.encode()
    if len(raw) <= limit:
        return text
    return raw[:limit].decode("utf-8", "ignore")


def fit_budget(name: str, content: str, start_line: int, limit: int = MAX_BYTES) -> list[tuple[str, str, int, int]]:
    """(name, content, start, end) of the pieces of a chunk: whole lines up to the limit; later pieces say what they continue.

    A line too long for a piece goes on in the next one, so the pieces without their headers hold the whole text.
    """
    rows = content.split("\n")
    if len(content.encode()) <= limit:
        return [(name, content, start_line, start_line + len(rows) - 1)]
    header = cut_bytes(f"// ... continued from {name}\n{next((x.strip() for x in rows if x.strip()), '')}", min(MAX_HEADER, limit // 2)) + "\n"
    room = limit - len(header.encode())
    parts: list[tuple[int, str]] = []
    for k, row in enumerate(rows):
        while len(row.encode()) > room:
            head = cut_bytes(row, room) or row[:1]
            parts.append((start_line + k, head))
            row = row[len(head) :]
        parts.append((start_line + k, row))
    pieces: list[list[tuple[int, str]]] = []
    size = 0
    for line, text in parts:
        n = len(text.encode())
        goes_on = pieces and pieces[-1][-1][0] == line
        if pieces and not goes_on and size + 1 + n <= room:
            pieces[-1].append((line, text))
            size += 1 + n
        else:
            pieces.append([(line, text)])
            size = n
    return [(f"{name}-part-{x[0][0]}-{x[-1][0]}", (header if k else "") + "\n".join(t for _, t in x), x[0][0], x[-1][0]) for k, x in enumerate(pieces)]


_FITTED = "file_path string, language string, name string, chunk_type string, content string, start_line int, end_line int, piece int"


def fit_chunks(chunks: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Chunks whose content is over the byte limit in pieces (piece counts from 1), others as they are; null contents are left out."""
    columns = [c.split()[0] for c in _FITTED.split(", ")]

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                rows += [(r.file_path, r.language, n, r.chunk_type, c, a, b, k) for k, (n, c, a, b) in enumerate(fit_budget(r.name or "", r.content, int(r.start_line), limit), 1)]
            yield pd.DataFrame(rows, columns=columns)

    small = chunks.where(F.octet_length("content") <= limit).select(*columns[:-1], F.lit(1).alias("piece"))
    large = chunks.where((F.octet_length("content") > limit) & F.col("start_line").isNotNull()).select(*columns[:-1]).mapInPandas(fit, _FITTED)
    return small.unionByName(large)


def rejoined(pieces: DataFrame, key: str = "file_path") -> DataFrame:
    """(key, content): what fit_chunks cut, put together again without the headers of later pieces."""
    body = F.when(F.col("piece") > 1, F.regexp_replace("content", r"^// \.\.\. continued from [^\n]*\n[^\n]*\n", "")).otherwise(F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("piece", "start_line", "end_line", body.alias("body"))))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("line"))
    joined = F.aggregate(
        "parts", start,
        lambda s, x: F.struct(F.concat(s["text"], F.when((x["piece"] > 1) & (x["start_line"] != s["line"]), "\n").otherwise(""), x["body"]).alias("text"), x["end_line"].alias("line")),
        lambda s: s["text"],
    )
    return pieces.groupBy(key).agg(parts.alias("parts")).select(key, joined.alias("content"))
