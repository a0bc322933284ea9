"""Problem 8: filling containers of fixed capacity by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.common import stage_of

#: Containers a group of items is meant to fill: what one differencing works on, whatever the size of the corpus.
WINDOWS = 48
TOKENIZER = "byte_bpe_50k.tiktoken"
_ENCODINGS: dict = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens): whole texts in tokens of the byte-level vocabulary at `path`; a null text has 0."""
    where = path or tokenizer_path()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _encoding(where)
        for f in frames:
            texts = [t or "" for t in f.text]
            yield pd.DataFrame({"doc_id": f.doc_id, "tokens": [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]})

    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(count, "doc_id long, tokens int")


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k sets of the items' indices with near-equal sums: multiway differencing.

    A partial partition is k sums with their sets; the two with the greatest spread are merged, the largest sums
    of one with the smallest of the other, until one is left.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    heap: list = []
    for i, s in enumerate(sizes):
        # sums relative to the least, only the sums above it are listed: (sum, set)
        heap.append((-s, i, [(s, (i,))]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # a: descending with zeros to k; b ascending beside it
        la, lb = len(a), len(b)
        if la + lb <= k:
            merged = a + b
        else:
            over = la + lb - k
            # the largest of a meet the zeros of b; the last `over` of a meet the last of b in opposite order
            merged = a[: la - over] + b[: lb - over]
            for x, y in zip(a[la - over :], reversed(b[lb - over :])):
                merged.append((x[0] + y[0], (x[1], y[1])))
        merged.sort(key=lambda t: -t[0])
        if len(merged) == k:
            least = merged[-1][0]
            merged = [(s - least, t) for s, t in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        tick += 1
        heapq.heappush(heap, (-spread, tick, merged))
    sets = []
    for _, tree in (heap[0][2] if heap else []):
        out, todo = [], [tree]
        while todo:
            t = todo.pop()
            if isinstance(t, tuple) and len(t) == 1:
                out.append(t[0])
            else:
                todo.extend(t)
        sets.append(out)
    return sets + [[] for _ in range(k - len(sets))]


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of item indices, none over the capacity: from the least count that could do, the count rises until differencing fits."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        sets = difference(sizes, k)
        if max(sum(sizes[i] for i in x) for x in sets) <= capacity:
            return [x for x in sets if x]
        k += 1


#: Container kinds at most; they are read into the plan.
MAX_KINDS = 1000


def _kinds(usable: DataFrame) -> Column:
    """The kinds as an array of literals; more than MAX_KINDS are an error."""
    rows = usable.orderBy("container_kind").limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} container kinds")
    one = [F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(r.capacity).cast("int").alias("capacity")) for r in rows]
    return F.array(*one) if one else F.array().cast("array<struct<container_kind:string,capacity:int>>")


_PLACED = "container_kind string, container string, doc_id long, piece int, tokens int"


def pack(documents: DataFrame, kinds: DataFrame, path: str | None = None) -> DataFrame:
    """documents(doc_id, text), container_kinds(container_kind, capacity_tokens) -> (container_kind, container, doc_id, piece, tokens).

    For every kind all documents are placed whole, each in one container; only a text larger than the capacity is
    cut, into full containers and a rest that is placed like others (pieces count from 1). Items are spread over
    groups by a hash of their ids, about WINDOWS containers each, so what one task differences is bounded by the
    capacity and not by the corpus; a null or empty text is an item of no tokens. Kinds with a null or
    non-positive capacity are left out; repeated ids are items of their own.
    """
    stage = stage_of(documents, "packing")
    counted = stage.write(token_counts(documents, path), "tokens")
    usable = kinds.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity"))
    every = counted.withColumn("k", F.explode(_kinds(usable))).select("doc_id", "tokens", "k.container_kind", "k.capacity")
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    cut = every.where(F.col("tokens") > F.col("capacity"))
    full = cut.select("container_kind", "doc_id", F.explode(F.sequence(F.lit(1), whole)).alias("piece"), F.col("capacity").alias("tokens"))
    full = full.select("container_kind", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", "tokens")
    items = every.select(
        "container_kind", "capacity", "doc_id", F.when(F.col("tokens") > F.col("capacity"), whole + 1).otherwise(1).alias("piece"),
        F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") - whole * F.col("capacity")).otherwise(F.col("tokens")).alias("tokens"),
    ).where(~((F.col("piece") > 1) & (F.col("tokens") == 0)))
    totals = items.groupBy("container_kind").agg(F.sum("tokens").alias("total"), F.count("*").alias("n"))
    groups = F.greatest(F.lit(1), F.ceil(F.col("total") / (F.col("capacity") * WINDOWS)), F.ceil(F.col("n") / 20000)).cast("long")
    grouped = items.join(F.broadcast(totals), "container_kind").withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), groups))

    def place(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        kind, grp = key
        f = f.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        windows = fill(f.tokens.tolist(), int(f.capacity.iloc[0]))
        rows = [(kind, f"{grp}-{w}", int(f.doc_id[i]), int(f.piece[i]), int(f.tokens[i])) for w, x in enumerate(windows) for i in x]
        return pd.DataFrame(rows, columns=["container_kind", "container", "doc_id", "piece", "tokens"])

    placed = grouped.select("container_kind", "capacity", "doc_id", "piece", "tokens", "grp").groupBy("container_kind", "grp").applyInPandas(place, _PLACED)
    return placed.unionByName(full.select("container_kind", "container", "doc_id", "piece", F.col("tokens").cast("int").alias("tokens")))


def fill_report(documents: DataFrame, kinds: DataFrame, path: str | None = None) -> DataFrame:
    """(container_kind, containers, tokens, fullness, at_least): how full the containers are, and the fewest that could hold the tokens."""
    p = pack(documents, kinds, path).groupBy("container_kind", "container").agg(F.sum("tokens").alias("t"))
    c = kinds.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity"))
    return (
        p.join(c, "container_kind").groupBy("container_kind")
        .agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("capacity"), 6).alias("fullness"), F.ceil(F.sum("t") / F.max("capacity")).alias("at_least"))
    )
