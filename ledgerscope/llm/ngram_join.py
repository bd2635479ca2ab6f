"""Exact Jaccard join of documents on their word n-grams, in size-banded tiles with hashed bitmap signatures.

A document is the set of its distinct shingles of ``width`` words, or its one shorter shingle; two documents link if 100 * intersection is
``percent`` * union or more. Equal sets are one node. Shingles are ordered by rarity, and two sets can only link if they share one of the rarest
``size - ceil(percent / 100 * size) + 1`` of both, so each such shingle makes a tile of the sets that have it there. Tiles are cut where
sizes are too far apart, those of many sets into bands of sizes (each with the band below); tiles with the same members are one.

In a tile each pair of sets is bounded by signatures: a bitmap of 4 to 8 places a shingle, each the parity of the shingles
hashed there. The differing bits are no more than the differing shingles, so they bound the overlap from above. Pairs that may still link are
intersected as sorted arrays. Pairs that are connected already are passed over, and a tile gives a tree over what it
connects, never its pairs.

First signatures alone say which sets may link; each tile gives a tree over these. What such trees connect is a group of candidates, and only
its members get their shingles sent, once, to be intersected within the group.

A tile of more than ``TILE`` sets or group of more than ``BLOCK``, or of more than ``HEAVY`` shingles a set of these, is cut into blocks that share one member, so no task holds an
unbounded group. Where that leaves it in parts, the tiles that still hold several parts are taken up once more, those of the same parts as
one, in cells of two blocks each. So large groups of copies cost one row each in a tile; only crowded tiles whose sets do not connect cost a row
for each of their blocks. Nothing within the similarity is lost. Shingles are told apart by 64-bit hashes, sets by 128 bits.

Texts are taken whole. Null texts and texts without words have an empty set, link with nothing and are their own component. A null
doc_id gives no component its name unless no other is there (then the name is null). Repeated rows and rows with the same doc_id
are rows of their own. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import kept, mapped, text_chunks, written
from ledgerscope.llm.components import components
from ledgerscope.llm.lines import BITS, NEEDED_BITS, _bit_table, _digests, _held, _mixed, _rarity, _steps
from ledgerscope.llm.simhash import row_keys

WIDTH = 5
PERCENT = 80
BLOCK = 1024  # sets of a block of a group, with their shingles
TILE = 4096  # sets of a block of a tile, with their signatures
HEAVY = 512  # shingles a set that a block has room for
CHUNK = 1 << 20
SMALL = 50_000  # rows of a table of crowded tiles up to which it is broadcast
KEYS = ["key_a", "key_b"]


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)``: the distinct shingles of all texts, sorted by row and hash."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # lower-cases A-Z and splits at x20, x09-x0D only
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[codes]  # blanks at the ends give empty words
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)[full]
    words = _digests(coded.dictionary)[codes[full]]
    counts = np.bincount(owner, minlength=len(texts))
    size = np.minimum(counts, width)
    number = counts - size + (counts > 0)
    row = np.repeat(np.arange(len(texts)), number)
    start = np.repeat(np.cumsum(counts) - counts, number) + _steps(number)
    hashes = size[row].astype(np.uint64)
    for j in range(width):
        more = j < size[row]
        hashes[more] = _mixed(hashes[more] * np.uint64(0x9E3779B185EBCA87) ^ words[start[more] + j])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], hashes[new]


class Counted:
    """What the table of rarity counts: shingles of ``WIDTH`` words. Any order of shingles would do; this one keeps common ones out of tiles."""

    @staticmethod
    def counted(texts: pa.Array) -> np.ndarray:
        return shingle_sets(texts, WIDTH)[1]


def places(sizes: np.ndarray) -> np.ndarray:
    """How many bits the signatures of sets of these sizes have: powers of two."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(4 * sizes, 1))).astype(np.int64))


def signatures(row: np.ndarray, hashes: np.ndarray, wide: np.ndarray) -> list[np.ndarray]:
    """For each row a bitmap of ``wide`` bits with the parity of the shingles hashed to each, as unsigned 64-bit numbers."""
    starts = np.cumsum(wide) - wide
    spread = _mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D)).astype(np.int64) & wide[row] - 1
    bits = np.bincount(starts[row] + spread, minlength=int(wide.sum())) & 1
    packed = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)
    return np.split(packed, np.cumsum(wide // 64)[:-1]) if len(wide) else []


def _marked(docs: DataFrame, rarity: np.ndarray, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """A row for each document: its set's size, digest, rarest shingles and signature."""
    sent = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = sent.value
        for chunk in text_chunks(batches, "text", CHUNK):
            row, hashes = shingle_sets(chunk.column(3), width)
            n = chunk.num_rows
            sizes = np.bincount(row, minlength=n)
            sums = [np.bincount(row, minlength=n).astype(np.uint64) for _ in range(2)]
            for total, salt in zip(sums, (0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                np.add.at(total, row, _mixed(hashes ^ np.uint64(salt)))
            order = np.lexsort((hashes, scale[hashes >> np.uint64(64 - BITS)], row))
            first = np.cumsum(sizes) - sizes
            least = np.where(sizes > 0, sizes + (-percent * sizes) // 100 + 1, 0)
            take = order[np.repeat(first, least) + _steps(least)]
            marks = b"".join(signature.tobytes() for signature in signatures(row, hashes, places(sizes)))
            ends = np.r_[0, np.cumsum(places(sizes) // 8)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *chunk.columns[:3],
                    pa.array(sizes),
                    *(pa.array(total.view(np.int64)) for total in sums),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(least)].astype(np.int32)), pa.array(hashes[take].view(np.int64))),
                    pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(marks)]),
                ],
                ["doc_id", "key_a", "key_b", "size", "set_a", "set_b", "rarest", "mark"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(doc_id, text), F.col(text).alias("text"))
    return mapped(rows, run, f"doc_id {kind}, key_a long, key_b long, size long, set_a long, set_b long, rarest array<long>, mark binary")


def _tiles(marked: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(tile, id, size)``: the nodes of each tile of two or more; a crowded shingle has a tile for each band of sizes."""

    def cut(columns: dict[str, np.ndarray], crowded: bool) -> pa.RecordBatch | None:
        """Whole groups, sorted by shingle and size."""
        token, ids, size = (columns[c] for c in ("token", "id", "size"))
        if crowded:
            band = size if percent == 100 else np.floor(np.log(size) / np.log(100 / percent) + 1e-9).astype(np.int64)
            tile = [_mixed(token.view(np.uint64) ^ _mixed((band + step).astype(np.uint64) + np.uint64(1 << 32))) for step in (0, 1)]
            return pa.RecordBatch.from_pydict({"tile": np.concatenate(tile).view(np.int64), "id": np.r_[ids, ids], "size": np.r_[size, size]})
        twice = np.r_[False, (token[1:] == token[:-1]) & (ids[1:] == ids[:-1])]  # repeated rows
        token, ids, size = token[~twice], ids[~twice], size[~twice]
        new = np.r_[True, (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:])]
        starts = np.flatnonzero(new)
        counts = np.diff(np.r_[starts, len(token)])
        tile = np.repeat(np.add.reduceat(_mixed(ids.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), starts), counts)
        several = np.repeat(counts, counts) > 1
        if several.any():
            return pa.RecordBatch.from_pydict({"tile": tile[several].view(np.int64), "id": ids[several], "size": size[several]})
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last group waits for more rows; one of more than ``BLOCK`` is given out as it comes."""
        names = ("token", "id", "size")
        held = {name: np.zeros(0, np.int64) for name in names}
        crowd: list[int] = []  # the shingle of the crowded group that is open

        def flushed(last: bool) -> Iterator[pa.RecordBatch]:
            token = held["token"]
            if not len(token):
                return
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            counts = np.diff(np.r_[starts, len(token)])
            many = (counts > BLOCK) | np.isin(token[starts], crowd)
            stop = len(token) if last or many[-1] else int(starts[-1])
            crowd[:] = token[-1:].tolist() if many[-1] else []
            many = np.repeat(many, counts)[:stop]
            for crowded in (False, True):
                if (many == crowded).any():
                    out = cut({name: column[:stop][many == crowded] for name, column in held.items()}, crowded)
                    if out is not None:
                        yield out
            for name in names:
                held[name] = held[name][stop:]

        parts: list[pa.RecordBatch] = []
        for batch in batches:
            parts.append(batch)
            if sum(part.num_rows for part in parts) > 100_000:
                for name in names:
                    held[name] = np.concatenate([held[name], *(part.column(name).to_numpy(zero_copy_only=False) for part in parts)])
                parts = []
                yield from flushed(False)
        for name in names:
            held[name] = np.concatenate([held[name], *(part.column(name).to_numpy(zero_copy_only=False) for part in parts)])
        yield from flushed(True)

    rows = marked.select(*KEYS, "rarest").join(nodes.select(*KEYS, "id", "size"), KEYS).select(F.explode("rarest").alias("token"), "id", "size")
    dealt = rows.repartition("token").sortWithinPartitions("token", "size", "id")
    return mapped(dealt, run, "tile long, id long, size long").distinct()


def _arrays(docs: DataFrame, wanted: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """``(id, words)``: the sorted shingles of the ``wanted`` (id, key_a, key_b) nodes, from the texts of their first documents."""
    table = docs.sparkSession.sparkContext.broadcast(_bit_table(wanted.select(F.shiftrightunsigned("key_a", 64 - NEEDED_BITS).alias("place"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - NEEDED_BITS)
            for chunk in text_chunks(iter([batch.filter(pa.array(_held(table.value, at)))]), "text", CHUNK):
                row, hashes = shingle_sets(chunk.column(2), width)
                ends = np.r_[0, np.cumsum(np.bincount(row, minlength=chunk.num_rows))].astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*chunk.columns[:2], words], ["key_a", "key_b", "words"])

    found = mapped(docs.select(*row_keys(doc_id, text), F.col(text).alias("text")), run, "key_a long, key_b long, words array<long>")
    return wanted.join(found.dropDuplicates(["key_a", "key_b"]), ["key_a", "key_b"]).select("id", "words")


class Cell:
    """The sets of a cell, smallest first, with what is connected so far."""

    def __init__(self, ids, sizes, labels, sides, marks):
        order = np.lexsort((ids, sizes))
        self.ids, self.sizes, self.order = ids[order], sizes[order], order
        self.label = np.unique(labels[order], return_inverse=True)[1]
        self.side = sides[order]
        self.split = bool(self.side.any() and not self.side.all())
        wide = np.array([len(mark) for mark in marks])[order]
        self.wide = wide
        self.folded = {}
        for width in np.unique(wide).tolist():
            rows = np.zeros((len(order), width), np.uint64)
            for i, at in enumerate(order):
                if wide[i] >= width:
                    rows[i] = np.bitwise_xor.reduce(marks[at].reshape(-1, width), axis=0)
            self.folded[width] = rows

    def passing(self, i: int, percent: int) -> np.ndarray:
        """Later sets that are not connected with set ``i``, and whose signatures leave enough overlap, best first."""
        stop = int(np.searchsorted(self.sizes, 100 * self.sizes[i] // percent, side="right"))
        others = np.arange(i + 1, max(stop, i + 1))
        others = others[self.label[others] != self.label[i]]
        if self.split:
            others = others[self.side[others] != self.side[i]]
        if not len(others):
            return others
        rows = self.folded[self.wide[i]]
        differ = np.bitwise_count(rows[others] ^ rows[i]).sum(axis=1, dtype=np.int64)
        both = self.sizes[others] + self.sizes[i]
        good = (100 + percent) * (both - differ) >= 2 * percent * both
        return others[good][np.argsort((differ - both)[good], kind="stable")]

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def forest(ids, labels, sides, arrays: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what links connect among the sets, beyond what ``labels`` say is connected; between the sides only, if both are there."""
    sizes = np.array([len(words) for words in arrays], np.int64)
    row = np.repeat(np.arange(len(arrays)), sizes)
    cell = Cell(ids, sizes, labels, sides, signatures(row, np.concatenate(arrays), places(sizes)))
    found = []
    for i in range(len(arrays)):
        own = arrays[cell.order[i]]
        for j in cell.passing(i, percent).tolist():
            if cell.label[i] == cell.label[j]:
                continue
            other = arrays[cell.order[j]]
            at = np.searchsorted(other, own)
            common = int((other[np.minimum(at, len(other) - 1)] == own).sum())
            if (100 + percent) * common >= percent * (len(own) + len(other)):
                cell.join(i, j)
                found.append((int(cell.ids[i]), int(cell.ids[j])))
    return found


def candidates(ids, sizes, labels, sides, marks: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A tree over the sets that may link, judged by their signatures, beyond what ``labels`` say is connected."""
    cell = Cell(ids, sizes, labels, sides, marks)
    found = []
    for i in range(len(ids)):
        for j in cell.passing(i, percent).tolist():
            if cell.label[i] != cell.label[j]:
                cell.join(i, j)
                found.append((int(cell.ids[i]), int(cell.ids[j])))
    return found


def promising(ids, sizes, labels, sides, marks: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets may link with one that they are not connected with."""
    cell = Cell(ids, sizes, labels, sides, marks)
    hit = np.zeros(len(ids), bool)
    for i in range(len(ids)):
        others = cell.passing(i, percent)
        if len(others):
            hit[i] = True
            hit[others] = True
    out = np.zeros(len(ids), bool)
    out[cell.order] = hit
    return out


CELL = ["tile", "i", "j"]


def _crowded(rows: DataFrame, block: int) -> DataFrame:
    """Tiles of more than a ``block``, with the number of their blocks; far fewer than rows."""
    stats = rows.groupBy("tile").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("id").alias("anchor"))
    parts = F.ceil(F.greatest(F.col("n") / block, F.col("total") / (HEAVY * block))).cast("int")
    table = kept(stats.where((F.col("n") > block) | (F.col("total") > HEAVY * block)).select("tile", "anchor", parts.alias("parts")))
    return F.broadcast(table) if table.count() <= SMALL else table


def _cells(rows: DataFrame, across: bool, block: int) -> DataFrame:
    """``rows`` (tile, id, size, label) with their cells. A ``block`` stands alone with the tile's first set, or, ``across``, with every other block."""
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(_crowded(rows, block), "tile", "left").withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
    every = F.sequence(F.lit(0), parts - 1)
    if across:
        dealt = dealt.withColumn("other", F.explode(every))
        cells = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": F.col("block") > F.col("other")})
    else:
        dealt = dealt.withColumn("i", F.explode(F.when(F.col("id") == F.col("anchor"), every).otherwise(F.array("block"))))
        cells = dealt.withColumns({"j": F.col("i"), "side": F.lit(False)})
    return cells.select(*CELL, "side", "id", "size", "label")


def _by_cell(rows: DataFrame, payload: str, solve, schema: str) -> DataFrame:
    """``solve(columns)`` for the rows of each cell, columns as lists and arrays by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in CELL)))
            start = 0
            for at in range(len(keys) + 1):
                if at < len(keys) and keys[at] == (keys[start] if start < at else keys[at]):
                    continue
                if at > start:
                    if keys[start] != key and held:
                        yield from solve(key, pa.Table.from_batches(held).combine_chunks())
                        held = []
                    key = keys[start]
                    held.append(batch.slice(start, at - start))
                start = at
        if held:
            yield from solve(key, pa.Table.from_batches(held).combine_chunks())

    dealt = rows.select(*CELL, "side", "id", "size", "label", payload).repartition(*CELL).sortWithinPartitions(*CELL)
    return mapped(dealt, run, schema)


def _numbers(part: pa.Table, name: str) -> np.ndarray:
    return part.column(name).to_numpy()


def _lists(part: pa.Table, name: str) -> list[np.ndarray]:
    column = part.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return [np.asarray(value.values, np.int64).view(np.uint64) for value in column]


def _linked(cells: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: links found in the cells."""

    def solve(key, part: pa.Table) -> Iterator[pa.RecordBatch]:
        if part.num_rows < 2:
            return
        found = forest(_numbers(part, "id"), _numbers(part, "label"), _numbers(part, "side"), _lists(part, "words"), percent)
        if found:
            u, v = zip(*found)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return _by_cell(cells.join(arrays, "id"), "words", solve, "u long, v long")


def _may_link(cells: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: trees over the sets of each cell that may link."""

    def solve(key, part: pa.Table) -> Iterator[pa.RecordBatch]:
        if part.num_rows < 2:
            return
        bits = [np.frombuffer(mark, np.uint64) for mark in part.column("mark").to_pylist()]
        found = candidates(_numbers(part, "id"), _numbers(part, "size"), _numbers(part, "label"), _numbers(part, "side"), bits, percent)
        if found:
            u, v = zip(*found)
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return _by_cell(cells.join(marks, "id"), "mark", solve, "u long, v long")


def _chosen(cells: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The rows of the cells that may link with one that they are not connected with."""

    def solve(key, part: pa.Table) -> Iterator[pa.RecordBatch]:
        if part.num_rows < 2:
            return
        bits = [np.frombuffer(mark, np.uint64) for mark in part.column("mark").to_pylist()]
        hit = promising(_numbers(part, "id"), _numbers(part, "size"), _numbers(part, "label"), _numbers(part, "side"), bits, percent)
        if hit.any():
            yield from part.drop_columns("mark").filter(pa.array(hit)).to_batches()

    return _by_cell(cells.join(marks, "id"), "mark", solve, "tile long, i int, j int, side boolean, id long, size long, label long")


def _in_parts(tiles: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of the tiles that hold several of the labels of ``labelled`` (id, label), under a name for the set of these; equal ones once."""
    rows = kept(tiles.select("tile", "id", "size").join(labelled, "id"))
    parts = rows.groupBy("tile", "label").agg(F.count("*").alias("n")).groupBy("tile")
    mixed = parts.agg(F.count("*").alias("labels"), F.sum(F.xxhash64("label").cast("decimal(38,0)")).alias("sum")).where("labels > 1")
    named = mixed.select("tile", F.xxhash64("sum", "labels").alias("name"))
    return kept(rows.join(named, "tile").select(F.col("name").alias("tile"), "id", "size", "label").distinct())


def _trees(tiles: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """``(u, v)``: what connects the sets that may link."""
    near = kept(_may_link(_cells(tiles.withColumn("label", F.col("id")), across=False, block=TILE), marks, percent))
    crowded = _crowded(tiles, TILE)
    if crowded.isEmpty():
        return near
    of_crowd = kept(tiles.join(crowded.select("tile"), "tile", "left_semi"))
    label = components(near)
    joined = of_crowd.select("id").distinct().join(label, F.col("id") == F.col("node"), "left")
    open_rows = _in_parts(of_crowd, joined.select("id", F.coalesce("component", "id").alias("label")))
    return near.union(kept(_may_link(_cells(open_rows, across=True, block=TILE), marks, percent)))


def links(docs: DataFrame, marked: DataFrame, nodes: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``(u, v)``: links between the ids of ``nodes`` that connect whatever links connect."""
    tiles = written(_tiles(marked, nodes, percent))
    met = nodes.join(tiles.select("id").distinct(), "id", "left_semi").select(*KEYS, "id")
    marks = met.join(marked.select(*KEYS, "mark").dropDuplicates(KEYS), KEYS).select("id", "mark")
    group = kept(components(_trees(tiles, marks, percent)))
    of_group = nodes.join(group, nodes["id"] == group["node"])
    of_group = kept(of_group.select(*KEYS, "id", "size", F.col("component").alias("tile"), F.col("id").alias("label")))
    arrays = written(_arrays(docs, of_group.select(*KEYS, "id"), width, doc_id, text))
    near = kept(_linked(_cells(of_group, across=False, block=BLOCK), arrays, percent))
    crowded = _crowded(of_group, BLOCK)
    if crowded.isEmpty():
        return near
    # What blocks with a common member have not connected: the tiles of groups that are still in parts.
    label = components(near).select("node", F.col("component").alias("new"))
    of_crowd = of_group.join(crowded.select(F.col("tile").alias("crowd")), F.col("tile") == F.col("crowd"), "left_semi")
    labelled = kept(of_crowd.join(label, F.col("id") == F.col("node"), "left").select("tile", "id", F.coalesce("new", "id").alias("label")))
    apart = labelled.groupBy("tile").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("tile")
    open_rows = _in_parts(tiles, labelled.join(apart, "tile", "left_semi").select("id", "label"))
    chosen = kept(_chosen(_cells(open_rows, across=True, block=TILE), marks, percent))
    return near.union(_linked(chosen, arrays, percent))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row; ``component_id`` is the least doc_id that links lead to."""
    counted = docs.select(F.col(text).alias("text"))
    marked = written(_marked(docs, _rarity(counted, Counted), width, percent, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *KEYS)).alias("least")
    sets = marked.where("size > 0").groupBy("set_a", "set_b").agg(first, F.min("size").alias("size"))
    named_by = [F.col(f"least.{c}").alias(c) for c in KEYS]
    nodes = written(sets.select(F.monotonically_increasing_id().alias("id"), "set_a", "set_b", F.col("least.doc_id").alias("least"), *named_by, "size"))
    label = components(kept(links(docs, marked, nodes, width, percent, doc_id, text)))
    named = nodes.select("id", "set_a", "set_b", "least").join(label, F.col("id") == F.col("node"), "left")
    named = named.select("set_a", "set_b", "least", F.coalesce("component", "id").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "component").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "component_id")
    rows = marked.select("doc_id", F.col("size").alias("n_shingles"), "set_a", "set_b")
    of_rows = rows.join(by_set, (F.col("set_a") == F.col("a")) & (F.col("set_b") == F.col("b")) & (F.col("n_shingles") > 0), "left")
    return of_rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
