"""Problem 9: evaluation texts leaking into training text, by suffix arrays over shards of the corpus.

Every task builds suffix arrays over its documents' words (of bounded size, one after the other), finds every suffix
of every item in them by binary search and joins the matches to their full length. A document whose verbatim matches
hold enough of an item's weight (words rare among the items weigh most) is aligned with it around the matches,
misspelt and exchanged words included, and the coverage is measured.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.common import stage_of

#: Words of a verbatim match (fewer in items that have fewer); share of an item's weight the matches must hold; least verbatim or nearly
#: verbatim run; least share of an item's words, of whose weight the words that agree must hold nine tenths as much.
SEED_WORDS, SEEDED, LEAST_RUN, LEAST_SHARE = 4, 0.12, 12, 0.4
#: Weighted agreement of a stretch; words rare among the items weigh most.
LEAST_AGREEMENT = 0.75
#: Words of one suffix array, items searched in one pass over the corpus, and words by which suffixes are ordered.
SHARD_WORDS, ITEMS_A_PASS, DEPTH = 1_500_000, 4_000, 16
_GAP = 4

_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|<!--.*?-->|\[([^\]\n]*)\]\([^)\n]*\)", re.S)
_WORD = re.compile(r"[^\W_]+")


def _char(m: re.Match) -> str:
    try:
        return chr(int(m.group(1), 16))
    except ValueError:
        return " "


def words(text: str) -> list[str]:
    """The words of a text without layout, markup, escapes, case and punctuation."""
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "\\" in text:
        text = re.sub(r"\\+u\{?([0-9a-fA-F]{4,6})\}?|\\+x([0-9a-fA-F]{2})", lambda m: _char(re.match(r"(.+)", m.group(1) or m.group(2))), text)
        text = re.sub(r"\\+[nrtbfv](?=\W|[A-Z]|[a-z])", " ", text)
    if "%" in text:
        text = re.sub(r"%(?:20|0[AaDd9]|2[0-9A-Fa-f]|3[A-Fa-f])", " ", text)
    if "=" in text:
        text = re.sub(r"=\r?\n", "", text)
    if "<" in text or "](" in text:
        text = _TAG.sub(lambda m: m.group(1) or "", text)
    text = re.sub(r"[​‌‍⁠﻿­]", "", text)
    text = re.sub(r"(?<=[a-zA-Z])-\n[ \t>*#/|]*(?=[a-z])", "", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


class Items:
    """The items to look for: their words, what each word weighs, and all their suffixes as arrays."""

    def __init__(self, rows: list[tuple[int, str]], frequency: dict[str, int], total: int):
        """frequency: in how many of the `total` distinct item texts each word stands, over all items, not these only."""
        self.ids = [i for i, _ in rows]
        self.words = [words(t or "") for _, t in rows]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for w in self.words for x in w}))}
        top = math.log(total + 1)
        self.weight = {w: 0.15 + math.log((total + 1) / frequency[w]) / top if total > 1 else 1.0 for w in self.vocabulary}
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        codes = np.array([self.vocabulary[x] for w in self.words for x in w] + [0] * DEPTH, dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        weights = np.array([0.0] + [self.weight[x] for w in self.words for x in w])
        self.upto = np.cumsum(weights)  # of the words before a position
        item = np.repeat(np.arange(len(rows)), sizes)
        at = np.arange(len(item)) - self.starts[item] if len(item) else np.zeros(0, dtype=np.int64)
        self.seed = np.minimum(SEED_WORDS, sizes)
        keep = at <= (sizes - self.seed)[item] if len(item) else np.zeros(0, dtype=bool)
        self.item, self.at = item[keep], at[keep]
        self.suffix = codes[(self.starts[self.item] + self.at)[:, None] + np.arange(SEED_WORDS)] if keep.any() else np.zeros((0, SEED_WORDS), dtype=np.int64)

    def weighs(self, item: np.ndarray | int, at: np.ndarray | int, length: np.ndarray | int) -> np.ndarray:
        """The weight of `length` words of an item."""
        first = self.starts[item] + at
        return self.upto[first + length] - self.upto[first]


def suffix_array(codes: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` words or more, by prefix doubling."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) if n else np.zeros(0, dtype=np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        both = rank * (n + 2) + after
        order = np.argsort(both, kind="stable")
        rank[order] = np.cumsum(np.concatenate(([0], np.diff(both[order]) != 0)))
        width *= 2
    return order


def find_suffixes(codes: np.ndarray, order: np.ndarray, suffix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix (a row of `suffix`, its first `length` words) the range of `order` whose suffixes begin with it, by binary search."""
    padded = np.concatenate([codes, np.zeros(suffix.shape[1], dtype=np.int64)])
    columns = np.arange(suffix.shape[1])
    within = columns[None, :] < length[:, None]
    out = []
    for right in (False, True):
        lo, hi = np.zeros(len(suffix), dtype=np.int64), np.full(len(suffix), len(order), dtype=np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            here = padded[order[np.minimum(mid, len(order) - 1)][:, None] + columns]
            differ = np.where(within, np.sign(here - suffix), 0)
            first = np.where(differ.any(axis=1), differ[np.arange(len(differ)), (differ != 0).argmax(axis=1)], 0)
            below = (first <= 0) if right else (first < 0)
            lo, hi = np.where(open_ & below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
        out.append(lo)
    return out[0], out[1]


def seeds(codes: np.ndarray, items: Items) -> np.ndarray:
    """Rows (position, item, position in the item, length): the longest verbatim matches of the items' suffixes.

    Code 0 (a word of no item, or the end of a document) matches nothing.
    """
    none = np.zeros((0, 4), dtype=np.int64)
    if not codes.any() or not len(items.item):
        return none
    order = suffix_array(codes)
    lo, hi = find_suffixes(codes, order, items.suffix, items.seed[items.item])
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    if not len(which):
        return none
    pos = order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    item, at = items.item[which], items.at[which]
    # matches of neighbouring suffixes at neighbouring places are one
    sort = np.lexsort((at, pos - at, item))
    pos, item, at = pos[sort], item[sort], at[sort]
    opens = np.ones(len(pos), dtype=bool)
    opens[1:] = (item[1:] != item[:-1]) | ((pos - at)[1:] != (pos - at)[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(opens)
    runs = np.diff(np.append(first, len(pos)))
    return np.stack([pos[first], item[first], at[first], runs - 1 + items.seed[item[first]]], axis=1)


def _near(a: str, b: str) -> bool:
    """One misspelling apart (two in long words): a changed, missing, doubled or swapped letter."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 4 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:]) or (min(len(a), len(b)) >= 8 and len(x) == len(y) and sum(c != d for c, d in zip(x, y)) <= 2)


def stretches_of(item: list[str], doc: list[str], weight: dict[str, float]) -> list[tuple[int, float]]:
    """(words, weight of those that agree) of the item's stretches that the document carries."""
    have = set(item)
    by_letter = defaultdict(list)
    for w in have:
        by_letter[w[0]].append(w)
        if len(w) > 1:
            by_letter[w[1]].append(w)
    fixed = [w if w in have else next((x for x in by_letter.get(w[0], ()) if _near(w, x)), w) for w in doc]
    blocks = [b for b in SequenceMatcher(None, item, fixed, False).get_matching_blocks() if b.size]
    stretches: list[list] = []
    for b in blocks:
        if stretches and b.a - stretches[-1][-1][0] <= _GAP + 1 and b.b - stretches[-1][-1][1] <= _GAP + 1:
            stretches[-1] += [(b.a + k, b.b + k) for k in range(b.size)]
        else:
            stretches.append([(b.a + k, b.b + k) for k in range(b.size)])
    spans = []
    for s in stretches:
        # shrink from both ends while the end agrees too little
        cells = [a for a, _ in s]
        matched = set(cells)
        first, last = cells[0], cells[-1]
        total = sum(weight.get(item[k], 1.0) for k in range(first, last + 1))
        good = sum(weight.get(item[k], 1.0) for k in matched)
        if good < LEAST_AGREEMENT * total:
            first, last = _best_span(item, matched, first, last, weight)
        if last - first + 1 >= min(5, len(item)):
            spans.append((last - first + 1, sum(weight.get(item[k], 1.0) for k in matched if first <= k <= last)))
    return spans


def _best_span(item: list[str], matched: set[int], first: int, last: int, weight: dict[str, float]) -> tuple[int, int]:
    """The part of a stretch with the greatest surplus of agreement."""
    best, sum_, start, out = 0.0, 0.0, first, (first, first - 1)
    for k in range(first, last + 1):
        w = weight.get(item[k], 1.0)
        sum_ += (1 - LEAST_AGREEMENT) * w if k in matched else -LEAST_AGREEMENT * w
        if sum_ <= 0:
            sum_, start = 0.0, k + 1
        elif sum_ > best:
            best, out = sum_, (start, k)
    return out


def _shard(ids: list, docs: list[list[str]], items: Items) -> list[tuple]:
    vocabulary = items.vocabulary
    starts, codes, at = [], [], 0
    for w in docs:
        starts.append(at)
        codes += [vocabulary.get(x, 0) for x in w]
        codes.append(0)
        at += len(w) + 1
    found: dict[tuple[int, int], list] = defaultdict(list)
    all_starts = np.array(starts)
    hits = seeds(np.array(codes, dtype=np.int64), items)
    where = np.searchsorted(all_starts, hits[:, 0], "right") - 1
    if len(hits):
        # pairs whose matches hold enough of the item's weight
        pair, which = np.unique(np.stack([where, hits[:, 1]], axis=1), axis=0, return_inverse=True)
        held = np.bincount(which.ravel(), items.weighs(hits[:, 1], hits[:, 2], hits[:, 3]), len(pair))
        sizes = np.array([len(w) for w in items.words])
        enough = held >= SEEDED * items.weighs(pair[:, 1], 0, sizes[pair[:, 1]])
        for k in np.flatnonzero(enough[which.ravel()]):
            d, (p, i, q, length) = int(where[k]), hits[k].tolist()
            found[(d, i)].append((p - starts[d], q, length))
    out = []
    for (d, i), runs in found.items():
        item, doc = items.words[i], docs[d]
        # the document's words around the seeds, parts far from any seed left out
        marks = sorted((max(0, p - q - 3 - len(item) // 4), min(len(doc), p - q + len(item) + 3 + len(item) // 4)) for p, q, _ in runs)
        windows: list[list[int]] = []
        for a, b in marks:
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            else:
                windows.append([a, b])
        spans = sorted((x for a, b in windows for x in stretches_of(item, doc[a:b], items.weight)), reverse=True)[:2]
        share = min(1.0, sum(n for n, _ in spans) / len(item))
        carried = sum(w for _, w in spans) / items.weighs(i, 0, len(item))
        if spans and spans[0][0] >= min(LEAST_RUN, len(item)) and share >= LEAST_SHARE - 0.5 / len(item) and carried >= 0.9 * LEAST_SHARE:
            out.append((ids[d], items.ids[i], round(share, 4), spans[0][0]))
    return out


def _frequencies(items: DataFrame) -> tuple[DataFrame, int]:
    """In how many distinct item texts each word stands: (word, n); and how many such texts there are."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [words(t) for t in f.text]
            yield pd.DataFrame({"text": [" ".join(w) for w in found], "words": [sorted(set(w)) for w in found]})

    texts = stage_of(items, "items").write(items.select("text").mapInPandas(split, "text string, words array<string>").where("text <> ''").dropDuplicates(["text"]), "texts")
    return texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")), texts.count()


def leaks(documents: DataFrame, eval_items: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """documents(doc_id, text, ...), eval_items(item_id, text, ...) -> (doc_id, item_id, share, longest_run).

    One row per document and item it gives away. Null ids are left out and null or empty texts match nothing;
    repeated documents are searched each for itself. The items are read in blocks of items_a_pass, each of which
    goes once over the corpus, so what a task holds is bounded: a block and one shard of SHARD_WORDS words (a
    longer text makes a shard of its own). Words are weighed over all distinct items, so blocks change no result.
    No shuffle of the corpus.
    """
    spark = documents.sparkSession
    corpus = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    every = eval_items.where("item_id is not null and text is not null").select("item_id", "text")
    frequencies, total = _frequencies(every)
    frequencies = stage_of(eval_items, "items").write(frequencies, "words")
    rows = iter(every.orderBy("item_id").toLocalIterator())
    out = None
    while True:
        block = [(r.item_id, r.text) for _, r in zip(range(items_a_pass), rows)]
        if not block and out is not None:
            return out
        mine = sorted({w for _, t in block for w in words(t)})
        asked = spark.createDataFrame([(w,) for w in mine], "word string")
        shared = spark.sparkContext.broadcast((block, {r.word: r.n for r in frequencies.join(asked, "word").toLocalIterator()}, total))

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            items = Items(*shared.value)
            ids, docs, size = [], [], 0
            names = ["doc_id", "item_id", "share", "longest_run"]
            for f in frames:
                for i, t in zip(f.doc_id, f.text):
                    ids.append(i)
                    docs.append(words(t))
                    size += len(docs[-1])
                    if size >= SHARD_WORDS:
                        yield pd.DataFrame(_shard(ids, docs, items), columns=names)
                        ids, docs, size = [], [], 0
            if ids:
                yield pd.DataFrame(_shard(ids, docs, items), columns=names)

        part = corpus.mapInPandas(search, "doc_id long, item_id long, share double, longest_run int")
        out = part if out is None else out.unionByName(part)
        if len(block) < items_a_pass:
            return out


def without_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """The documents that give no item away, with all their columns; rows without an id are kept out."""
    return documents.where("doc_id is not null").join(leaks(documents, eval_items).select("doc_id").distinct(), "doc_id", "left_anti")


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """How often each item leaked: (item_id, documents, most); items that did not leak have 0."""
    found = leaks(documents, eval_items).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("most"))
    return eval_items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most", F.lit(0.0)).alias("most"))
