"""Problem 10: subject areas of documents by interpolated n-gram language models.

Per subject and language a model of words and word pairs, interpolated with a background model of the corpus in that
language. The first models come from labelled documents; they mark sentences in all documents, and the final models
are counted over all of those. A sentence belongs to the subject whose per-token cross-entropy, summed over the
sentence, falls furthest below the background's, if it falls far enough and clearly further than the next subject's;
a document is about the subjects that hold enough of the words of its subject sentences, each subject's acceptance
calibrated on labels kept out of training.

Texts are cut into words once; later passes read arrays of hashed words and work on whole batches in numpy. Counts
live in a table of BUCKETS rows, the same at every size of the corpus: every n-gram is counted, in two rows, and read
from the emptier one, so a crowded table blurs rare n-grams and drops none. Sentences that many distinct texts share
word for word are counted in such a table too, and are about nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.common import Stage, stage_of
from quarry.llm.pairs import FUNCTION_WORDS

#: Labelled documents used (the first in the order of a hash of their ids), and of ten parts those kept for calibration.
MAX_LABELLED, HELD_OUT = 20_000, 2
#: Rows of the table of counts; subjects at most (both bound what is broadcast); words worked on at once.
BUCKETS, MAX_SUBJECTS, SLICE = 1 << 20, 64, 800_000
#: Weights of pair, word and background estimates; words of background each model of a language begins with.
PAIR, WORD, BACK, PRIOR = 0.3, 0.5, 0.2, 200.0
#: Pairs seen less often in the background are not told apart from chance.
LEAST_PAIRS = 3
#: A sentence needs this fall of cross-entropy: in all, the part by which it leads the second subject, and at its most
#: telling word. In all and at a word in units of the logarithm of the number of subjects, the most one word can give.
LEAST_FALL, LEAST_LEAD, LEAST_WORD = 0.48, 0.4, 0.4
#: The share that makes a subject; what calibration may make of it, and held-out documents it must mend to do so.
SHARE, SHARES, MENDED = 0.25, (0.2, 0.225, 0.25, 0.275), 3

#: A sentence is stock if more distinct texts hold it than this share of the documents and this many, together; a text
#: with a larger share of copies than HOT counts as one, so that at most 1 / HOT hashes go to the tasks.
COMMON, COMMON_MORE, HOT = 0.01, 10, 0.001

_TOKENS = re.compile(r"[^\W\d_]+|[.!?](?=\s)|\n")
_TONGUES = sorted(FUNCTION_WORDS)
_FUNCTION = {k: frozenset(FUNCTION_WORDS[k].split()) for k in _TONGUES}
_TOKENISED = "doc_id long, text_hash long, tongue int, words binary, ends binary"


def _prose(text: str) -> str:
    """The text without fenced code."""
    if "```" not in text and "~~~" not in text:
        return text
    out, fenced = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            out.append(line)
    return "\n".join(out)


class _Words(dict):
    """A word's 32-bit hash (never 0; 0 for the end of a sentence), and above it, as bits, the languages it is a function word of."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = 0 if w in ".!?\n" else (zlib.crc32(w.encode()) or 1) | sum(1 << (32 + k) for k, t in enumerate(_TONGUES) if w in _FUNCTION[t])
        self[w] = code
        return code


_CODES = _Words()


def tokenise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language of each text, hashed words of all, words of each, places in its text where sentences end, sentences of each).

    Sentences, list items and headings end at line ends and stops; fenced code is left out. A text is in the
    language most of its function words belong to, or in none (0).
    """
    code, flat, sizes = _CODES.__getitem__, [], []
    for t in texts:
        found = _TOKENS.findall(_prose(t).lower())
        found.append("\n")
        flat += map(code, found)
        sizes.append(len(found))
    codes = np.array(flat, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    real = (codes & 0xFFFFFFFF) != 0
    counts = np.stack([np.bincount(doc, codes >> (32 + k) & 1, len(texts)) for k in range(len(_TONGUES))]) if len(texts) else np.zeros((len(_TONGUES), 0))
    ordered = np.sort(counts, axis=0)
    tongue = np.where((ordered[-1] >= 2) & (ordered[-1] > 1.3 * ordered[-2]), counts.argmax(axis=0) + 1, 0)
    words = np.bincount(doc[real], minlength=len(texts))
    # an end counts if words stand between it and the one before
    ends = np.flatnonzero(~real)
    upto = np.cumsum(real)[ends]
    some = np.diff(upto, prepend=0) > 0
    ends, upto = ends[some], upto[some]
    return tongue, (codes[real] & 0xFFFFFFFF).astype(np.uint32), words, (upto - (np.cumsum(words) - words)[doc[ends]]).astype(np.int32), np.bincount(doc[ends], minlength=len(texts))


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of values of the given sizes as one binary value each."""
    offsets = np.concatenate(([0], np.cumsum(sizes * values.itemsize)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def tokenised(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, tongue, words, ends): documents as hashed words, once for all passes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                tongue, words, n, ends, m = tokenise(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tongue, pa.int32()), _binary(words, n), _binary(ends, m)], names=["doc_id", "text_hash", "tongue", "words", "ends"])

    return texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(cut, _TOKENISED)


class Slice:
    """Some documents as flat arrays: words and n-grams, the sentence of each word, the document of each sentence."""

    def __init__(self, docs: pd.DataFrame):
        self.docs = docs
        words = np.frombuffer(b"".join(docs.words), dtype=np.uint32).astype(np.uint64)
        lengths = np.array([len(w) // 4 for w in docs.words], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        ends = [np.frombuffer(e, dtype=np.int32) for e in docs.ends]
        self.doc = np.repeat(np.arange(len(docs)), [len(e) for e in ends])  # of a sentence
        last = (np.concatenate(ends) if ends else np.zeros(0, dtype=np.int32)) + starts[self.doc]
        self.first = np.concatenate(([0], last[:-1])).astype(np.int64) if len(last) else np.zeros(0, dtype=np.int64)
        self.length = last - self.first
        self.sentence = np.repeat(np.arange(len(last)), self.length)
        self.tongue = docs.tongue.to_numpy()[self.doc]  # of a sentence
        self.word = _mix(words ^ (self.tongue[self.sentence].astype(np.uint64) << np.uint64(40)))
        before = np.roll(self.word, 1)
        self.pair = _mix(self.word + before * np.uint64(0x9E3779B97F4A7C15))
        self.opens = np.zeros(len(words), dtype=bool)  # the first word of a sentence has no pair
        self.opens[self.first] = True
        place = np.arange(len(words)) - self.first[self.sentence]
        spread = _mix(self.word + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.said = np.add.reduceat(spread, self.first) if len(self.first) else np.zeros(0, dtype=np.uint64)  # a hash of each sentence


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    for b in batches:
        f = b.to_pandas()
        at = np.cumsum(f.words.map(len).to_numpy() // 4) // SLICE if len(f) else np.zeros(0)
        for k in np.unique(at):
            yield Slice(f[at == k].reset_index(drop=True))


def _mix(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def _rows(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two rows of n-grams in the table of counts."""
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), ((h >> np.uint64(40)) & np.uint64(BUCKETS - 1)).astype(np.int64)


class Stock:
    """How many distinct texts hold a sentence, and from how many on it is about nothing."""

    def __init__(self, held: np.ndarray, least: float):
        self.held, self.least = held, least

    def __getstate__(self) -> tuple:
        rows = np.flatnonzero(self.held)
        return rows, self.held[rows], self.least

    def __setstate__(self, state: tuple) -> None:
        rows, values, self.least = state
        self.held = np.zeros(BUCKETS, dtype=np.float32)
        self.held[rows] = values

    def among(self, said: np.ndarray) -> np.ndarray:
        a, b = _rows(said)
        return np.minimum(self.held[a], self.held[b]) > self.least


def survey(docs: DataFrame, stage: Stage) -> tuple[Stock, np.ndarray, np.ndarray]:
    """One pass over tokenised documents: sentences over the distinct texts, and the background's n-grams and words by language."""
    copies = stage.write(docs.groupBy("text_hash").agg(F.count("*").alias("n")), "copies")
    documents, texts = copies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # fewer than 1 / HOT texts can have so many copies
    hot = {r.text_hash: r.n for r in copies.where((F.col("n") > 1) & (F.col("n") >= HOT * documents)).collect()}
    stage.drop(copies)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, back, words = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(_TONGUES) + 1)
        for s in slices(batches):
            # once for each document
            _, at = np.unique(s.said ^ _mix(s.doc.astype(np.uint64)), return_index=True)
            weight = np.array([1.0 / hot.get(h, 1) for h in s.docs.text_hash])[s.doc[at]]
            for rows in _rows(s.said[at]):
                held += np.bincount(rows, weight, BUCKETS)
            for grams in (s.word, s.pair[~s.opens]):
                for rows in _rows(grams):
                    back += np.bincount(rows, minlength=BUCKETS)
            words += np.bincount(s.tongue, s.length, len(words))
        rows = np.flatnonzero(held + back)
        rows = np.concatenate([rows, -1 - np.arange(len(words))])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.append(held, words[::-1])[rows]), pa.array(np.append(back, words[::-1])[rows])], names=["row", "held", "back"])

    summed = docs.mapInArrow(count, "row long, held double, back double").groupBy("row").agg(F.sum("held").cast("float").alias("held"), F.sum("back").alias("back"))
    held, back, words = np.zeros(BUCKETS, dtype=np.float32), np.zeros(BUCKETS), np.zeros(len(_TONGUES) + 1)
    for f in _batches(summed):
        at = f.column("row").to_numpy()
        held[at[at >= 0]], back[at[at >= 0]] = f.column("held").to_numpy()[at >= 0], f.column("back").to_numpy()[at >= 0]
        words[-1 - at[at < 0]] = f.column("back").to_numpy()[at < 0]
    least = COMMON_MORE + COMMON * texts
    return Stock(np.where(held > least, held, 0), least), back, words


class Counts:
    """Counts of n-grams by subject (a last column is for the background), and of words by language, in tables of fixed size."""

    def __init__(self, subjects: int):
        self.table = np.zeros((BUCKETS, subjects + 1), dtype=np.float32)
        self.words = np.zeros((len(_TONGUES) + 1, subjects + 1))

    def __getstate__(self) -> tuple:
        """What holds anything, packed: which rows, which of their columns, the counts."""
        rows = np.flatnonzero(self.table.any(axis=1))
        held = self.table[rows]
        packed = [np.diff(rows, prepend=0).astype(np.int32).tobytes(), np.packbits(held != 0).tobytes(), held[held != 0].tobytes()]
        return self.table.shape, self.words, [zlib.compress(x, 1) for x in packed]

    def __setstate__(self, state: tuple) -> None:
        shape, self.words, packed = state
        rows, mask, values = (zlib.decompress(x) for x in packed)
        at = np.cumsum(np.frombuffer(rows, dtype=np.int32), dtype=np.int64)
        held = np.zeros(len(at) * shape[1], dtype=np.float32)
        held[np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=len(held)).astype(bool)] = np.frombuffer(values, dtype=np.float32)
        self.table = np.zeros(shape, dtype=np.float32)
        self.table[at] = held.reshape(-1, shape[1])


class Tally:
    """What one task counts: n-grams and words by language for every subject."""

    def __init__(self, subjects: int):
        self.sums = np.zeros((subjects, BUCKETS), dtype=np.float32)
        self.words = np.zeros((len(_TONGUES) + 1, subjects))

    def add(self, s: Slice, weights: np.ndarray) -> None:
        """Adds a slice; weights: of every sentence for every subject."""
        rows = [np.concatenate(x) for x in zip(_rows(s.word), _rows(s.pair[~s.opens]))]
        sentence = np.concatenate([s.sentence, s.sentence[~s.opens]])
        for k in range(len(self.sums)):
            w = weights[:, k]
            if w.any():
                mine = w[sentence]
                at = np.flatnonzero(mine)
                for r in rows:
                    self.sums[k] += np.bincount(r[at], mine[at], BUCKETS)
                self.words[:, k] += np.bincount(s.tongue, w * s.length, len(self.words))

    def parts(self) -> Iterator[pd.DataFrame]:
        """Its rows that hold anything, those of languages as negative numbers."""
        at = np.flatnonzero(self.sums.any(axis=0))
        names = [f"n{k}" for k in range(len(self.sums))]
        yield pd.DataFrame({"row": -1 - np.arange(len(self.words)), **dict(zip(names, self.words.T))})
        for k in range(0, len(at), 100_000):
            rows = at[k : k + 100_000]
            yield pd.DataFrame({"row": rows, **dict(zip(names, self.sums[:, rows].astype(float)))})


def _summed(parts: DataFrame, subjects: list[int], surveyed: tuple[Stock, np.ndarray, np.ndarray], stage: Stage) -> Model:
    """The model of the tasks' counts against the corpus: at most BUCKETS rows and some of languages come to the driver."""
    names = [f"n{k}" for k in range(len(subjects))]
    rows = stage.write(parts.groupBy("row").agg(*(F.sum(n).cast("float").alias(n) for n in names)), "counts")
    counts = Counts(len(subjects))
    stock, counts.table[:, -1], counts.words[:, -1] = surveyed
    for f in _batches(rows):
        at, values = f.column("row").to_numpy(), np.column_stack([f.column(n).to_numpy() for n in names] or [np.zeros((len(f), 0))])
        counts.table[at[at >= 0], :-1] = values[at >= 0]
        counts.words[-1 - at[at < 0], :-1] = values[at < 0]
    stage.drop(rows)
    return Model(subjects, counts, stock)


def _batches(rows: DataFrame) -> Iterator[pa.RecordBatch]:
    yield from rows.toArrow().to_batches(max_chunksize=100_000)


class Model:
    """Log-ratios of each subject's interpolated model to the background's."""

    def __init__(self, subjects: list[int], counts: Counts, stock: Stock):
        self.subjects, self.counts, self.stock = subjects, counts, stock

    def _of(self, h: np.ndarray) -> np.ndarray:
        """The counts of n-grams: of their two rows the one with less background."""
        a, b = _rows(h)
        t = self.counts.table
        return t[np.where(t[a, -1] <= t[b, -1], a, b)]

    def ratios(self, s: Slice) -> np.ndarray:
        """The fall of cross-entropy at every word, by subject; none where no subject knows the word."""
        n = len(self.subjects)
        key = np.where(s.opens, s.word, s.pair)
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        word, tongue, opens = s.word[at], s.tongue[s.sentence[at]], s.opens[at]
        mine, before, pair = self._of(word), self._of(s.word[at - 1]), self._of(s.pair[at])
        total = self.counts.words[tongue]
        b1 = ((mine[:, -1] + 0.5) / (total[:, -1] + 1))[:, None]
        p1 = (mine[:, :n] + PRIOR * b1) / (total[:, :n] + PRIOR)
        alone = np.log(((PAIR + WORD) * p1 + BACK * b1) / b1)
        alone[mine[:, :n].sum(axis=1) == 0] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            ps = np.where(before[:, :n] > 0, np.minimum(pair[:, :n] / before[:, :n], 1.0), p1)
            pb = np.minimum(pair[:, -1:] / np.maximum(before[:, -1:], 1.0), 1.0)
            both = np.log((PAIR * ps + WORD * p1 + BACK * b1) / (PAIR * pb + (WORD + BACK) * b1))
        told = ~opens & (pair[:, -1] >= LEAST_PAIRS) & (pair[:, :n].sum(axis=1) > 0) & (mine[:, :n].sum(axis=1) > 0) & (before[:, :n].sum(axis=1) > 0)
        return np.where(told[:, None], both, alone).astype(np.float32)[back]

    def marked(self, s: Slice) -> np.ndarray:
        """The index of every sentence's subject, or -1."""
        n = len(self.subjects)
        if not n or not len(s.first):
            return np.full(len(s.first), -1)
        r = self.ratios(s)
        sums, most = np.add.reduceat(r, s.first), np.maximum.reduceat(r, s.first)
        top = sums.argmax(axis=1)
        rows = np.arange(len(top))
        best = sums[rows, top]
        unit = np.log(n) if n > 1 else 0.0
        good = ~self.stock.among(s.said) & (best >= LEAST_FALL * unit) & (most[rows, top] >= LEAST_WORD * unit) & (best > 0)
        if n > 1:
            good &= np.partition(sums, n - 2, axis=1)[:, n - 2] <= (1 - LEAST_LEAD) * best
        return np.where(good, top, -1)

    def shares(self, s: Slice, marked: np.ndarray) -> np.ndarray:
        """Of every document each subject's share of the words in sentences about any subject."""
        n = len(self.subjects)
        held = np.zeros((len(s.docs), n))
        about = marked >= 0
        np.add.at(held, (s.doc[about], marked[about]), s.length[about])
        return held / np.maximum(held.sum(axis=1, keepdims=True), 1)


def _label_sets(labels: DataFrame) -> DataFrame:
    """(doc_id, subjects): distinct labels of each document; null ids are left out."""
    return labels.where("doc_id is not null and subject_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject_id")).alias("subjects"))


def _counted(docs: DataFrame, subjects: list[int], weigh) -> DataFrame:
    """Counts of all documents' n-grams; weigh(slice) gives each sentence's weights. One table a task, summed before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(len(subjects))
        for s in slices(batches):
            if len(s.first):
                tally.add(s, weigh(s))
        for f in tally.parts():
            yield pa.RecordBatch.from_pandas(f, preserve_index=False)

    return docs.mapInArrow(count, ", ".join(["row long", *(f"n{k} double" for k in range(len(subjects)))]))


def train(docs: DataFrame, labels: DataFrame, ids: list[int], stage: Stage) -> tuple[Broadcast, dict[int, float]]:
    """The final models, broadcast, and the calibrated shares, from tokenised documents.

    The labelled sample is MAX_LABELLED documents in the order of a hash of their ids, HELD_OUT tenths of it (by
    another hash) kept for calibration. All counts of the final models and of the background, the first models' too,
    run over all documents.
    """
    column = {s: k for k, s in enumerate(ids)}
    surveyed = survey(docs, stage)
    sample = _label_sets(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    labelled = stage.write(docs.join(F.broadcast(sample), "doc_id"), "labelled")  # MAX_LABELLED rows at most
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10))

    def of_labels(s: Slice) -> np.ndarray:
        w = np.zeros((len(s.docs), len(ids)))
        for k, subs in enumerate(s.docs.subjects):
            known = [column[x] for x in subs if x in column]
            w[k, known] = 1.0 / max(1, len(known))
        return w[s.doc]

    begin = docs.sparkSession.sparkContext.broadcast(_summed(_counted(labelled.where(part >= HELD_OUT), ids, of_labels), ids, surveyed, stage))

    def of_marks(s: Slice) -> np.ndarray:
        model = begin.value
        marked = model.marked(s)
        shares = model.shares(s, marked)
        main = np.where(shares >= SHARE, shares, 0.0)
        # a sentence of no main subject counts for all of its document, so that no model claims common ones
        w = main[s.doc]
        own = (marked >= 0) & (main[s.doc, marked] > 0)
        w[own] = 0.0
        w[own, marked[own]] = 1.0
        return w

    model = _summed(_counted(docs, ids, of_marks), ids, surveyed, stage)
    begin.destroy()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return shared, calibrate(shared, labelled.where(part < HELD_OUT), ids)


def calibrate(shared: Broadcast, held_out: DataFrame, ids: list[int]) -> dict[int, float]:
    """Each subject's share among SHARES: the one that errs least on the held-out labels, SHARE unless it errs on MENDED more."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wrong = np.zeros((len(SHARES), len(ids)), dtype=np.int64)
        for s in slices(batches):
            shares = m.shares(s, m.marked(s))
            want = np.array([[x in set(subs) for x in ids] for subs in s.docs.subjects]).reshape(len(s.docs), len(ids))
            for k, x in enumerate(SHARES):
                wrong[k] += ((shares >= x) != want).sum(axis=0)
        rows = [(x, i, int(wrong[k, j])) for k, x in enumerate(SHARES) for j, i in enumerate(ids)]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["share", "subject", "wrong"]).astype({"share": "float64", "subject": "int32", "wrong": "int64"}), preserve_index=False)

    found = held_out.mapInArrow(score, "share double, subject int, wrong long").groupBy("share", "subject").agg(F.sum("wrong").alias("n")).collect()
    wrong = {(r.share, r.subject): r.n for r in found}
    best = {i: min(SHARES, key=lambda x: (wrong.get((x, i), 0), abs(x - SHARE))) for i in ids}
    return {i: x if wrong.get((SHARE, i), 0) - wrong.get((x, i), 0) >= MENDED else SHARE for i, x in best.items()}


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """documents(doc_id, text), subject_labels(doc_id, subject_id), subjects(subject_id) -> (doc_id, subject_id, share).

    One row per subject a document is about; none for general, null or empty texts and null ids. Repeated
    documents are judged each for itself; repeated labels count once. Without labels or subjects no rows; more
    than MAX_SUBJECTS subjects are an error.
    """
    ids = sorted(r.subject_id for r in subjects.where("subject_id is not null").select("subject_id").distinct().limit(MAX_SUBJECTS + 1).collect())
    if len(ids) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    if not ids:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject_id int, share double")
    stage = stage_of(documents, "subjects")
    docs = stage.write(tokenised(documents.where("doc_id is not null and text is not null")), "words")
    shared, least = train(docs, labels, ids, stage)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        needed, ids = np.array([least[i] for i in m.subjects]), np.array(m.subjects, dtype=np.int32)
        for s in slices(batches):
            shares = m.shares(s, m.marked(s))
            doc, subject = np.nonzero((shares >= needed) & (shares > 0))
            yield pa.RecordBatch.from_arrays([pa.array(s.docs.doc_id.to_numpy()[doc]), pa.array(ids[subject], pa.int32()), pa.array(np.round(shares[doc, subject], 4))], names=["doc_id", "subject_id", "share"])

    return docs.mapInArrow(judge, "doc_id long, subject_id int, share double")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """The corpus by subject: (subject_id, subject_name, documents, weight), weight the sum of the shares."""
    found = document_subjects(documents, labels, subjects).groupBy("subject_id").agg(F.count("*").alias("documents"), F.round(F.sum("share"), 2).alias("weight"))
    names = subjects.groupBy("subject_id").agg(F.min("subject_name").alias("subject_name"))
    return names.join(found, "subject_id", "left").select("subject_id", "subject_name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
