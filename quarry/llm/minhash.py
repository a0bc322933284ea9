"""Verified MinHash: candidate buckets by banded minima, exact Jaccard on the shingles, classes by least labels; a prefix join finds the pairs that no bucket shows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.common import Stage

#: 16 bands of 6 minima: texts of similarity 0.8 meet with 99.2 %, those of 0.5 with 22 %.
BANDS, ROWS = 16, 6
#: Members of a bucket that all others are compared with.
HEADS = 8
WORDS, SIMILARITY = 5, 0.8
#: Texts of one side that a task of the prefix join holds against all texts that share a shingle with them.
BLOCK = 4096
_SEEDS = np.random.default_rng(17).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The least similarity as a fraction, so that no pair at the threshold hangs on rounding.
_NUM, _DEN = Fraction(str(SIMILARITY)).as_integer_ratio()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[list[str]], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of the runs of `width` words of each text in order, how many each text has); of a shorter text the hash of the whole."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.array([zlib.crc32(w.encode()) + 1 for t in texts for w in t], dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))) if len(flat) else np.zeros(0, dtype=np.int64)  # words from here to the end
    h = np.zeros(len(flat), dtype=np.uint64)
    for k in range(width):
        part = np.zeros(len(flat), dtype=np.uint64)
        part[: max(0, len(flat) - k)] = flat[k:]
        h = _mix(h + np.where(left > k, part, np.uint64(0)) * np.uint64(2 * k + 3))
    first = np.zeros(len(flat), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    keep = (left >= width) | first
    doc, h = doc[keep], h[keep]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words) -> (id, shingles, a key of each band, two words with a bit set for each shingle)."""
    for b in batches:
        h, sizes = shingles([w or [] for w in b.column(1).to_pylist()])
        if not b.num_rows:
            continue
        some = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[some]
        least = np.zeros((b.num_rows, len(_SEEDS)), dtype=np.uint64)
        for k, seed in enumerate(_SEEDS):
            if len(h):
                least[some, k] = np.minimum.reduceat(_mix(h * seed), starts)
        bands = np.zeros((b.num_rows, BANDS), dtype=np.uint64)
        for k in range(BANDS):
            for x in least[:, k * ROWS : (k + 1) * ROWS].T:
                bands[:, k] = _mix(bands[:, k] * np.uint64(31) + x + np.uint64(k))

        def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.view(np.int64).ravel()))

        every = np.arange(1, b.num_rows + 1)
        marks = np.zeros((b.num_rows, 2), dtype=np.uint64)
        for k in range(2):
            if len(h):
                marks[some, k] = np.bitwise_or.reduceat(np.where(h & np.uint64(1) == k, np.uint64(1) << (h >> np.uint64(58)), np.uint64(0)), starts)
        yield pa.RecordBatch.from_arrays([b.column(0), lists(h, np.cumsum(sizes)), lists(bands, every * BANDS), lists(marks, every * 2)], names=["id", "sh", "bands", "marks"])


def _components(nodes: DataFrame, links: DataFrame, stage: Stage) -> DataFrame:
    """(id, class_id): the least id reachable over links(a, b). Labels pass along links and jump to their labels' labels, so rounds grow with the logarithm of the longest path."""
    both = stage.write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stage.write(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "label")
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("n"))
        far = label.select(F.col("a").alias("l"), F.col("l").alias("f"))
        after = stage.write(label.join(near, "a").join(far, "l").select("a", F.least("l", "n", "f").alias("l"), (F.least("n", "f") < F.col("l")).alias("moved")), "label")
        moved = after.where("moved").isEmpty()
        stage.drop(label)
        label = after.drop("moved")
        label._quarry_path = after._quarry_path
        if moved:
            return nodes.join(label.select(F.col("a").alias("id"), F.col("l").alias("class_id")), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def _alike(pairs: DataFrame, sh: DataFrame) -> DataFrame:
    """Of pairs(a, b) of ids those whose shingles in sh(id, sh) are similar enough."""
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sh.select(F.col("id").alias("a"), F.col("sh").alias("x")), "a").join(sh.select(F.col("id").alias("b"), F.col("sh").alias("y")), "b")
        .where((_NUM + _DEN) * both >= _NUM * (F.size("x") + F.size("y"))).select("a", "b")
    )


def _bucket_pairs(sets: DataFrame) -> DataFrame:
    """sets(id, bands) -> pairs(a, b): each member of a bucket with HEADS of its members, the smallest id and the least under other mixings."""
    members = sets.select("id", F.explode("bands").alias("bucket"))
    picked = [F.min("id"), *(F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(1, HEADS))]
    heads = members.groupBy("bucket").agg(F.array_distinct(F.array(*picked)).alias("heads"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(heads, "bucket").select(F.col("id").alias("a"), F.explode("heads").alias("b")).where("a <> b").distinct()


def _size_class(n: Column) -> Column:
    """Sizes below 64 each by itself, larger ones in steps of 2 %."""
    return F.when(n < 64, n).otherwise(64 + F.floor(50 * F.log(n / 64))).cast("int")


def _prefix_pairs(sets: DataFrame, stage: Stage) -> DataFrame:
    """sets(id, class_id, sh, marks) of different shingles -> pairs(a, b) with every pair of two classes that is similar enough, and others.

    Shingles are ordered by how many sets hold them, those of a single class first. If o shingles of n and m are shared, the first
    shared one leaves at least o in either set from there to the end, so that it stands near the start of both, and only the
    rarest shingles of a set need to meet: those of the smaller (role 0) under its size, those of the larger (role 1) under each size
    it may be like. In the group of a shingle and size the members outside its largest class meet all members of the other role.
    """
    every = sets.select("id", "class_id", F.size("sh").alias("n"), F.col("marks")[0].alias("m0"), F.col("marks")[1].alias("m1"), F.explode("sh").alias("s"))
    held = every.groupBy("s").agg(F.count("*").alias("df"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi").select("s", "df")
    left = F.col("n") - F.col("i")
    places = stage.write(
        every.join(held, "s").groupBy("id", "class_id", "n", "m0", "m1").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o"))
        .select("id", "class_id", "n", "m0", "m1", F.size("o").alias("k"), F.posexplode("o"))
        .select("id", "class_id", "n", "m0", "m1", (F.col("n") - F.col("k") + F.col("pos")).alias("i"), F.col("col.s").alias("s"))
        .where(_DEN * left >= _NUM * F.col("n")),
        "places",
    )
    n, i = F.col("n"), F.col("i")
    index = places.where((_NUM + _DEN) * (n - i) >= 2 * _NUM * n).withColumns({"role": F.lit(0), "size": _size_class(n)})
    low, high = F.ceil(_NUM * n / _DEN), F.least(n - F.when((_NUM + _DEN) * (n - 1) < 2 * _NUM * n, 1).otherwise(0), F.floor((_DEN * n - (_NUM + _DEN) * i) / _NUM))
    probe = places.where(low <= high).withColumns({"role": F.lit(1), "size": F.explode(F.sequence(_size_class(low), _size_class(high)))})
    entries = index.unionByName(probe)
    groups = (
        entries.groupBy("s", "size", "class_id").agg(F.count("*").alias("n"), F.min("role").alias("r0"), F.max("role").alias("r1"))
        .groupBy("s", "size").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("most"), (F.sum("n") - F.max("n")).alias("others"), F.min("r0").alias("r0"), F.max("r1").alias("r1"))
        .where("others > 0 and r0 < r1")
        .select("s", "size", "most", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks"))
    )
    grouped = stage.write(entries.join(groups, ["s", "size"]), "places")
    few = grouped.where("class_id <> most").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("most", "blocks").alias("x")
    many = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("other", 1 - F.col("role")).drop("most", "blocks").alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    differ = F.bit_count(F.col("x.m0").bitwiseXOR(F.col("y.m0"))) + F.bit_count(F.col("x.m1").bitwiseXOR(F.col("y.m1")))  # shingles of one only, at least
    return few.join(
        many,
        (F.col("x.s") == F.col("y.s")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.role") == F.col("y.other")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.class_id") != F.col("y.class_id"))
        & ((_NUM + _DEN) * F.least(n - F.col("x.i"), m - F.col("y.i")) >= _NUM * (n + m))
        & ((n != m) | ((_NUM + _DEN) * (n - 1) >= 2 * _NUM * n))
        & ((_NUM + _DEN) * (n + m - differ) >= 2 * _NUM * (n + m)),
    ).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def classes(texts: DataFrame, stage: Stage) -> DataFrame:
    """texts(id long unique, words array<string>) -> (id, class_id): texts linked by pairs of SIMILARITY or more share the smallest id reached.

    Texts of the same shingles count once. Each bucket of MinHash compares its members with HEADS of them, and the links
    found give first classes; these lack pairs that share no bucket or no head. A prefix join then finds every pair of
    similar texts that are still in different classes, and merges those classes. No bucket or group is cut.
    """
    base = stage.write(texts.select("id", "words").mapInArrow(_keys, "id long, sh array<long>, bands array<long>, marks array<long>"), "shingles")
    named = stage.write(base.join(base.groupBy("sh").agg(F.min("id").alias("rep")), "sh").select("id", "rep", "sh", "bands", "marks"), "named")
    sets = named.where("id = rep")
    sh = sets.select("id", "sh")
    first = stage.write(_components(sets.select("id"), stage.write(_alike(_bucket_pairs(sets), sh), "alike"), stage), "first")
    more = _alike(_prefix_pairs(sets.join(first, "id"), stage), sh)
    label = first.select("id", F.col("class_id").alias("c"))
    links = stage.write(more.join(label.select(F.col("id").alias("a"), F.col("c").alias("x")), "a").join(label.select(F.col("id").alias("b"), F.col("c").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not links.isEmpty():
        merged = _components(first.select(F.col("class_id").alias("id")).distinct(), links, stage)
        first = label.join(merged.withColumnRenamed("id", "c"), "c").select("id", "class_id")
    return named.select("id", "rep").join(first.withColumnRenamed("id", "rep"), "rep").select("id", "class_id")
