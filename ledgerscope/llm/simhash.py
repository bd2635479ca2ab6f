"""SimHash near-duplicates found with tables of distances to pivot fingerprints.

Two fingerprints that differ in ``radius`` bits or fewer agree on three of the six bit blocks (any radius up to
three leaves three of six untouched), so for one of the twenty choices of three blocks all their
distances to the pivots, counted over those blocks, are equal. A table per choice is keyed by these distances. Within a
key, pairs whose whole distances to some pivot differ by more than the radius are
discarded (the triangle inequality allows no such link), and survivors are verified bit by bit.
Nothing within the radius is lost; pivots only steer the work.

Fingerprints are made distinct first, so copies cost one row. A key with many
fingerprints is dealt into cells of two blocks of about ``CELL`` of them, so no task
gathers a group of unbounded size. A cell gives a star over each component of its links, not all pairs. Components of
these stars are the components of all links.

Null texts and texts without words have fingerprint zero and link like any other. A null
doc_id is no component's name unless no other is there. Repeated rows get the same class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import fresh, kept, mapped, text_chunks
from ledgerscope.llm.components import components

RADIUS = 3
SHINGLE = 3
PIVOTS = 24
CELL = 2048
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit, width


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 majority bits over the hashes of all word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z and splits at x20, x09-x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())]
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 14):
        ones += np.unpackbits(values[at : at + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, key_a, key_b, fp)``; ``fp`` holds the 64 bits as a long, the keys are hashes of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            found = np.array([fingerprint(value, width) for value in chunk.column(3).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*chunk.columns[:3], pa.array(found.view(np.int64))], ["doc_id", "key_a", "key_b", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(doc_id, text), F.col(text).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, key_a long, key_b long, fp long")


def row_keys(doc_id: str, text: str) -> list[Column]:
    """128 bits that tell rows apart by doc_id and text, nulls included."""
    return [F.xxhash64(doc_id, text).alias("key_a"), F.xxhash64(F.lit(1), text, doc_id).alias("key_b")]


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints spread over all 64-bit words."""
    return _mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def block_distances(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint, block and pivot, the differing bits within the block."""
    apart = fps[:, None] ^ pivots()[None, :]
    masks = [np.uint64(((1 << width) - 1) << first) for first, width in BLOCKS]
    return np.stack([np.bitwise_count(apart & mask) for mask in masks], axis=1).astype(np.uint8)


def _tables(fps: DataFrame) -> DataFrame:
    """``(key, fp)``: each fingerprint in each table; the key mixes the table's number with its distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            apart = block_distances(values)
            for number, chosen in enumerate(combinations(range(len(BLOCKS)), 3)):
                distances = apart[:, chosen[0]] + apart[:, chosen[1]] + apart[:, chosen[2]]
                packed = np.ascontiguousarray(distances).view(np.uint64)  # eight distances in a word
                key = np.full(len(values), number + 1, np.uint64)
                for column in packed.T:
                    key = _mixed(key ^ column)
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "fp": values.view(np.int64)})

    return mapped(fps, run, "key long, fp long")


def _trees(fps: np.ndarray, side: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A star over each component of the links among ``fps``; of links between the sides only, if both are there."""
    whole = block_distances(fps).sum(axis=1, dtype=np.int16).astype(np.int8)
    linked = np.zeros((len(fps), len(fps)), bool)
    for at in range(0, len(fps), 256):
        rows = slice(at, at + 256)
        near = np.ones((len(fps[rows]), len(fps)), bool)
        for column in whole.T:
            near &= np.abs(column[rows, None] - column[None, :]) <= radius
        a, b = np.nonzero(near)
        linked[a + at, b] = np.bitwise_count(fps[a + at] ^ fps[b]) <= radius
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    free = np.ones(len(fps), bool)
    while free.any():
        first = int(np.argmax(free))
        members = front = np.array([first])
        free[first] = False
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & free)
            free[front] = False
            members = np.r_[members, front]
        for other in members[1:]:
            yield int(fps[first]), int(fps[other])


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(u, v)``: stars with the components of all linked pairs among distinct ``fp``; far fewer rows than pairs."""
    if not 0 <= radius <= 3:
        raise ValueError("six blocks find links of up to three bits")
    rows = _tables(fps)
    crowded = rows.groupBy("key").count().where(F.col("count") > 1)
    parts = crowded.select("key", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    block = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    cells = (
        rows.join(parts, "key")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("side"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell that a batch cuts waits for the next one."""

        def solved(columns, ends) -> Iterator[pa.RecordBatch]:
            found = []
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                if b - a > 1:
                    found += _trees(columns[3][a:b], columns[4][a:b], radius)
            if found:
                u, v = np.array(found, np.uint64).T
                yield pa.RecordBatch.from_pydict({"u": np.ascontiguousarray(u).view(np.int64), "v": np.ascontiguousarray(v).view(np.int64)})

        open_rows = None
        for batch in batches:
            new = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "i", "j", "fp", "side")]
            new[3] = new[3].view(np.uint64)
            columns = new if open_rows is None else [np.r_[a, b] for a, b in zip(open_rows, new)]
            changes = np.zeros(max(len(columns[0]) - 1, 0), bool)
            for column in columns[:3]:
                changes |= column[1:] != column[:-1]
            ends = np.flatnonzero(changes) + 1
            if len(ends):
                yield from solved(columns, ends)
                columns = [column[ends[-1] :] for column in columns]
            open_rows = columns
        if open_rows is not None and len(open_rows[0]):
            yield from solved(open_rows, np.array([len(open_rows[0])]))

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return mapped(dealt, run, "u long, v long").distinct()


def _grouped(marked: DataFrame, radius: int) -> DataFrame:
    """``(fp, component)`` for each distinct fingerprint of ``marked``."""
    fps = marked.select("fp").distinct()
    label = components(links(fps, radius))
    return fps.join(label, fps["fp"] == label["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; ``component_id`` is the least doc_id that links lead to."""
    marked = kept(fingerprints(docs, doc_id, text, width))
    named = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).join(_grouped(marked, radius), "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(least, "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id (nulls last; ties by hashes of doc_id and text, then of the whole row)."""
    marked = kept(fingerprints(docs, doc_id, text, width))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key_a", "key_b")).alias("least")
    by_fp = marked.groupBy("fp").agg(least)
    stays = by_fp.join(_grouped(marked, radius), "fp").groupBy("component").agg(F.min("least").alias("least"))
    names = [fresh(name, docs.columns) for name in ("key_a", "key_b")]
    keys = stays.select(*(F.col(f"least.key_{end}").alias(name) for end, name in zip("ab", names)))
    own = [key.alias(name) for key, name in zip(row_keys(doc_id, text), names)]
    whole = [F.col(f"`{column}`") for column in docs.columns]
    alike = docs.select(*own, F.xxhash64(*whole).alias("of row"), F.struct(*whole).alias("row")).join(keys, names, "left_semi")
    return alike.groupBy(*names).agg(F.min_by("row", "of row").alias("row")).select("row.*")
