"""Embedding chunks: a protocol for models, and one that needs none."""

from __future__ import annotations

import json
import urllib.request
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from quarry.config import Config, may_send
from quarry.functions.porter import tokens
from quarry.functions.text import embed_text, task_prefixes

BATCH, MAX_FAILURES = 8, 10


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class Generator(Protocol):
    name: str

    def generate(self, prompt: str) -> str: ...


class HashingEmbedder:
    """Signed hashes of stems and of pairs of stems: deterministic, without a model or a network."""

    name = "hashing"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts):
            ts = tokens(text)
            for t in [*ts, *(f"{a} {b}" for a, b in zip(ts, ts[1:]))]:
                h = zlib.crc32(t.encode())
                row[h % self.dimensions] += 1 if h >> 31 else -1
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out.tolist()

    def embed_query(self, text: str) -> list[float]:
        return self.embed([text])[0]


class HttpEmbedder:
    """A model server that answers POST /api/embed {model, input} with {embeddings}; texts get the model's task prefix."""

    def __init__(self, url: str, name: str, dimensions: int, timeout: float = 300):
        self.url, self.name, self.dimensions, self.timeout = url, name, dimensions, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._send([task_prefixes(self.name)[0] + t for t in texts])

    def embed_query(self, text: str) -> list[float]:
        return self._send([task_prefixes(self.name)[1] + text])[0]

    def _send(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.name, "input": texts}).encode()
        request = urllib.request.Request(f"{self.url}/api/embed", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["embeddings"]


class HttpGenerator:
    """A model server that answers POST /api/generate {model, prompt} with lines of {response}."""

    def __init__(self, url: str, name: str, timeout: float = 300):
        self.url, self.name, self.timeout = url, name, timeout

    def generate(self, prompt: str) -> str:
        body = json.dumps({"model": self.name, "prompt": prompt, "stream": True}).encode()
        request = urllib.request.Request(f"{self.url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return "".join(x.get("response", "") for x in read_json_lines(iter(lambda: reply.read(4096), b"")))


def server_url(config: Config) -> str:
    """The model server's address; an error if code may not go there."""
    allowed, why = may_send(config)
    if not allowed:
        raise PermissionError(why)
    return f"{config.model.host}:{config.model.port}"


def http_models(config: Config, dimensions: int = 768) -> tuple[HttpEmbedder, HttpGenerator]:
    """The configured server's models."""
    url = server_url(config)
    return HttpEmbedder(url, config.model.embedding_model, dimensions), HttpGenerator(url, config.model.chat_model)


def read_json_lines(chunks: Iterator[bytes]) -> Iterator[dict]:
    """Objects of a line-delimited JSON stream cut anywhere; blank lines are skipped, an `error` field raises."""
    held = b""
    for piece in (*chunks, b"\n"):
        held += piece
        *whole, held = held.split(b"\n")
        for line in whole:
            if line.strip():
                x = json.loads(line)
                if "error" in x:
                    raise RuntimeError(x["error"])
                yield x


def embed_chunks(chunks: DataFrame, embedder: Embedder, parallelism: int | None = None) -> DataFrame:
    """chunks plus embedding (unit length) and error, in batches of BATCH texts.

    A batch that fails is tried text by text; a task whose texts fail MAX_FAILURES times in a row gives up. A
    failed text has no embedding and its error. parallelism bounds the requests in flight.
    """
    text = embed_text(*(F.col(c) for c in ("file_path", "language", "name", "chunk_type", "parent", "start_line", "end_line", "content")))
    source = chunks.repartition(parallelism) if parallelism else chunks
    schema = StructType([*source.drop("embedding").schema.fields, StructField("embedding", ArrayType(FloatType())), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failures = 0
        for f in frames:
            texts = f.pop("text_to_embed").tolist()
            vectors: list = []
            errors: list = []
            for a in range(0, len(texts), BATCH):
                part = texts[a : a + BATCH]
                try:
                    got = embedder.embed([t or "" for t in part])
                    vectors += got
                    errors += [None] * len(part)
                    failures = 0
                    continue
                except Exception:  # noqa: BLE001 - any failure of the server: each text alone
                    pass
                for t in part:
                    try:
                        vectors += embedder.embed([t or ""])
                        errors.append(None)
                        failures = 0
                    except Exception as e:  # noqa: BLE001
                        vectors.append(None)
                        errors.append(str(e) or type(e).__name__)
                        failures += 1
                        if failures >= MAX_FAILURES:
                            raise RuntimeError(f"{failures} texts failed in a row: {e}") from e
            f["embedding"] = [None if v is None else (np.asarray(v, dtype=np.float32) / (np.linalg.norm(v) or 1)).tolist() for v in vectors]
            f["error"] = errors
            yield f

    return source.drop("embedding").withColumn("text_to_embed", text).mapInPandas(run, schema)
