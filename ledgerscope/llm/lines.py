"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words. Lines are matched if their sets have a Jaccard
similarity of 4/5 or more, and a line goes if any earlier one matches it; earlier is by doc_id, then by
place in the text. Words are ordered by rarity in the whole corpus, and two lines can only match if they share a
word among the rarest ``size - ceil(4/5 size) + 1`` of both (prefix filter). Of lines that share such a
word, sizes too different, places that leave too few words (positional filter), and parities of 128 word classes that
differ too often are passed over; the rest is verified on the sets.

Equal sets are found first, by 128-bit sums of word hashes, within tasks and then across, so a line that fills a third of the corpus is
one record a task. Lines, and the words of their prefixes, are dealt to buckets by hash as pages: a row of the exchange has the records of one
bucket for many lines of a task. From each word a line only gets one partner that passes the filters, the nearest by its classes, so copies
of a passage give no square of rows; of these the nearest is verified. Lines for which that fails ask for all their partners in a second
round, by pairs of words: a prefix longer by one holds two common words of any match, and few other lines have both. (Long sets, of which
pairs would be many, ask by single words.) There a pair is given by the first words that both prefixes have, and so once. A word shared by more than ``CELL`` lines is dealt into cells of two blocks each, so
no task holds an unbounded group. Words are told apart by 64-bit hashes.

Lines of fewer than ``least`` different words are kept: by default those of fewer than five; with 1 only lines without words. Sets of
up to three words only match equal ones and need no words to be found by; one of four also matches one of five. Null texts have no lines and stay
null. A null doc_id comes last. Rows with the same doc_id are one document: equal places in them do not remove each
other, but a place removed in one is removed in all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import fresh, kept, mapped, text_chunks, written

MIN_WORDS = 5
BITS = 20  # of the table of word counts
CELL = 16_384
NEEDED_BITS = 25
PROBES = 3  # places of a word in the bit table of the second round
SEEN = 80_000
LAST = (1 << 63) - 1
PAIRED = 80  # the largest sets that ask by pairs of words
CARRIED = 32  # words of its prefix that a row of the second round has with it; all of them for sets of up to PAIRED
CHUNK = 1 << 20
PAGE = 4096  # numbers of an array that tasks put together
BUCKET = 100_000  # words of prefixes, about, that are looked at together
PAGED = 300_000  # words of prefixes that a task deals to buckets at a time
SOLVED = 4 << 20  # bytes of whole buckets that are looked at together
LINE = np.dtype([("set_a", "<i8"), ("set_b", "<i8"), ("doc", "<i8"), ("low", "<u8"), ("high", "<u8"), ("line", "<i4"), ("size", "<i4"), ("width", "<i4")])
WORD = np.dtype([("token", "<i4"), ("line", "<i4"), ("size", "<i4"), ("at", "<i4"), ("doc", "<i8"), ("low", "<u8"), ("high", "<u8")])
# White space of two and three bytes: what may stand at each place. That of one byte is 0x09 to 0x0D and 0x1C to 0x20.
WIDE_BLANKS = [
    ([0xC2], [0x85, 0xA0]),
    ([0xE1], [0x9A], [0x80]),
    ([0xE2], [0x80], [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]),
    ([0xE2], [0x81], [0x9F]),
    ([0xE3], [0x80], [0x80]),
]


def order_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


BANDS = np.ceil(1.26 ** np.arange(92)).astype(np.int64)  # the least size of each
SMALL_BANDS = np.searchsorted(BANDS, np.arange(1024), "right") - 1


class Words:
    """The lower-cased words of texts as they lie in their bytes: those between white space, found for all texts at once."""

    def __init__(self, texts: pa.Array):
        lower = pc.utf8_lower(pc.fill_null(texts, ""))
        offsets = np.frombuffer(lower.buffers()[1], np.int32, len(lower) + 1, 4 * lower.offset).astype(np.int64)
        self.data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        blank = (self.data - np.uint8(0x09) < 5) | (self.data - np.uint8(0x1C) < 5)
        wide = np.flatnonzero(self.data > 0xC1)
        leads = self.data[wide]
        for letters in WIDE_BLANKS:
            width = len(letters)
            at = wide[leads == letters[0][0]]
            at = at[at <= len(self.data) - width]
            for place in range(1, width):
                at = at[np.isin(self.data[at + place], letters[place])]
            for place in range(width):
                blank[at + place] = True
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        first, last = ~blank, ~blank
        first[1:] &= blank[:-1]
        first[inner] = ~blank[inner]
        last[:-1] &= blank[1:]
        last[inner - 1] = ~blank[inner - 1]
        self.starts = np.flatnonzero(first)
        self.lengths = np.flatnonzero(last) + 1 - self.starts
        self.owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, self.offsets)))  # the word's text

    def kept(self, chosen: np.ndarray) -> None:
        self.starts, self.lengths, self.owner = self.starts[chosen], self.lengths[chosen], self.owner[chosen]

    def hashes(self) -> np.ndarray:
        return _hashed(self.data, self.starts, self.lengths)


class Lines:
    """The lines of a chunk of texts, with their words as hashes. All arrays run over lines or over words."""

    def __init__(self, texts: pa.Array, wanted=None):
        words = Words(texts)
        ends = np.flatnonzero(words.data == 0x0A)
        given = pc.is_valid(texts).to_numpy(zero_copy_only=False)
        counts = np.where(given, np.diff(np.searchsorted(ends, words.offsets)) + 1, 0)
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        before = np.cumsum(np.bincount(np.searchsorted(words.starts, ends), minlength=len(words.starts) + 1))[: len(words.starts)]
        self.owner = before + (np.cumsum(given) - 1)[words.owner]  # a text has a line more than ends of lines
        if wanted is not None:
            chosen = wanted(self.row, self.place)
            words.kept(chosen[self.owner])
            self.owner = (np.cumsum(chosen) - 1)[self.owner[chosen[self.owner]]]
            self.row, self.place = self.row[chosen], self.place[chosen]
        self.hashes = words.hashes()

    @staticmethod
    def counted(texts: pa.Array) -> np.ndarray:
        """The hashes of all words, repeats included."""
        return Words(texts).hashes()

    def sets(self, rarity: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lines with ``least`` different words or more: their numbers, sizes and first words, and all words' hashes, rarest first."""
        scale = rarity[self.hashes >> np.uint64(64 - BITS)].astype(np.uint64)
        order = None
        if len(self.row) < 1 << 20 and int(scale.max(initial=0)) < 1 << 10:
            key = self.owner.astype(np.uint64) << np.uint64(44) | scale << np.uint64(34) | self.hashes >> np.uint64(30)
            order = np.argsort(key)
            hashes, key = self.hashes[order], key[order]
            if ((key[1:] == key[:-1]) & (hashes[1:] != hashes[:-1])).any():  # hashes that begin alike stand in any order
                order = None
        if order is None:
            order = np.lexsort((self.hashes, scale, self.owner))
        line, hashes = self.owner[order], self.hashes[order]
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])] if len(line) else np.zeros(0, bool)
        line, hashes = line[new], hashes[new]
        starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        line, sizes = line[starts], np.diff(np.r_[starts, len(line)])
        long = sizes >= least
        if not long.all():
            hashes = hashes[np.repeat(long, sizes)]
            line, sizes = line[long], sizes[long]
        return line, sizes, np.cumsum(sizes) - sizes, hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _rarity(docs: DataFrame, unit: type[Lines]) -> np.ndarray:
    """Word counts of the whole corpus by the first bits of the word's hash, on a scale of sixteenths of a doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for chunk in text_chunks(batches, "text", CHUNK):
            np.add.at(total, (unit.counted(chunk.column(0)) >> np.uint64(64 - BITS)).view(np.int64), 1)
        pages = total.reshape(-1, PAGE)
        at = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_pydict({"page": at.astype(np.int32), "n": pa.array([zlib.compress(pages[i].tobytes(), 1) for i in at], pa.binary())})

    return np.ceil(16 * np.log2(np.maximum(_summed(mapped(docs.select("text").where("text is not null"), run, "page int, n binary"), np.add, 1 << BITS), 0.5)) + 17).astype(np.uint16)


def _digests(words: pa.Array) -> np.ndarray:
    """64-bit hashes of texts, eight bytes at a time for all of them side by side."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    return _hashed(np.frombuffer(words.buffers()[2] or b"", np.uint8), offsets[:-1], np.diff(offsets))


def _hashed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same of stretches of bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    start = _mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    hashes = start[np.minimum(lengths, 255)]
    long = np.flatnonzero(lengths > 255)
    hashes[long] = _mixed(lengths[long].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    masks = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.arange(64, -1, -8, dtype=np.uint64)
    masks[0] = 0
    step, active = 0, slice(None) if lengths.all() else np.flatnonzero(lengths)
    while len(hashes[active]):
        left = np.minimum(lengths[active] - step, 8)
        part = eights[starts[active] + step] & masks[left]
        hashes[active] = _mixed(hashes[active] * np.uint64(0x9E3779B185EBCA87) ^ part)
        step += 8
        active = np.flatnonzero(lengths > step) if isinstance(active, slice) else active[lengths[active] > step]
    return hashes


def _summed(pages: DataFrame, how: np.ufunc, size: int) -> np.ndarray:
    """An array of ``size`` numbers put together from pages that tasks give; one row a page comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[page] = how(table.get(page, 0), np.frombuffer(zlib.decompress(value), np.int64))
        yield pa.RecordBatch.from_pydict({"page": pa.array(table.keys(), pa.int32()), "n": pa.array([zlib.compress(t.tobytes(), 1) for t in table.values()], pa.binary())})

    whole = np.zeros((size // PAGE, PAGE), np.int64)
    for row in mapped(pages.repartition("page"), run, "page int, n binary").toArrow().to_pylist():
        whole[row["page"]] = np.frombuffer(zlib.decompress(row["n"]), np.int64)
    return whole.ravel()


def _bit_table(places: DataFrame) -> np.ndarray:
    """A set of whole numbers below 2**NEEDED_BITS, the one column of ``places``, as bits; of fixed size whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << NEEDED_BITS - 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pages = bits.view(np.int64).reshape(-1, PAGE)
        at = np.flatnonzero(pages.any(axis=1))
        yield pa.RecordBatch.from_pydict({"page": at.astype(np.int32), "n": pa.array([zlib.compress(pages[i].tobytes(), 1) for i in at], pa.binary())})

    return _summed(mapped(places, run, "page int, n binary"), np.bitwise_or, 1 << NEEDED_BITS - 6).view(np.uint8)


def _held(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _marked(docs: DataFrame, rarity: np.ndarray, least: int, unit: type[Lines]) -> DataFrame:
    """``(bucket, lines, prefixes)``: the lines of enough words and their prefixes, those of one bucket in one row for many lines of a task;
    and ``(doc, line, to_doc, to_line)``, a row for each that equals an earlier one of the same task. Equal sets are in one bucket.
    """
    buckets = _buckets(rarity)
    sent = docs.sparkSession.sparkContext.broadcast(rarity)
    crowded = np.uint16(np.ceil(16 * np.log2(CELL)) + 17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        scale = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for chunk in text_chunks(batches, "text", CHUNK):
            lines = unit(chunk.column(1))
            line, sizes, starts, words = lines.sets(scale, least)
            if not len(line):
                continue
            doc = chunk.column(0).to_numpy(zero_copy_only=False)[lines.row[line]]
            place = lines.place[line]
            sums = [np.add.reduceat(_mixed(words ^ np.uint64(salt)), starts) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            # 128 word classes: bit 6 of a word says which half has its class.
            bit, high = np.uint64(1) << (words & np.uint64(63)), words >> np.uint64(6) & np.uint64(1) == 1
            parity = [np.bitwise_xor.reduceat(np.where(high == half, bit, np.uint64(0)), starts) for half in (False, True)]
            width = np.where(sizes > 3, sizes - -(-4 * sizes // 5) + 1, 0)  # sets of up to three words only match equal ones
            names = np.ascontiguousarray(np.stack(sums, axis=1)).view("V16").ravel().tolist()
            order = np.lexsort((place, doc))
            first = [None] * len(line)
            if len(seen) > SEEN:
                seen.clear()
            for i, own in zip(order.tolist(), zip(doc[order].tolist(), place[order].tolist())):
                before = seen.setdefault(names[i], own)
                if before < own:
                    first[i] = before
            new = np.array([before is None for before in first])
            width = np.where(new & (width > 0), width + 1, 0)  # the last word is for pairs only
            take = np.repeat(starts, width) + _steps(width)
            # A word's key is 31 bits of its hash; the lowest bit says whether it may be crowded. Words that share a key only share work.
            keys = (words[take] >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE) | (scale[words[take] >> np.uint64(64 - BITS)] > crowded)
            table = _records(LINE, set_a=sums[0], set_b=sums[1], doc=doc, low=parity[0], high=parity[1], line=place, size=sizes, width=width)[new]
            held.append((table, keys.view(np.int32)))
            if sum(len(table) + len(words) for table, words in held) > PAGED:  # short lines have no words here
                yield _filled(_dealt(held, buckets))
                held.clear()
            old = np.flatnonzero(~new).tolist()
            if old:
                to = [first[i] for i in old]
                yield _filled({"doc": doc[old], "line": place[old].astype(np.int32), "to_doc": pa.array([t[0] for t in to], pa.int64()), "to_line": pa.array([t[1] for t in to], pa.int32())})
        if held:
            yield _filled(_dealt(held, buckets))

    return mapped(docs.select("doc", "text").where("text is not null"), run, PAGES)


PAGES = "bucket int, lines binary, prefixes binary, hot boolean, doc long, line int, to_doc long, to_line int"


def _filled(columns: dict) -> pa.RecordBatch:
    """A batch of :data:`PAGES` of which some columns are given."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    size = len(next(iter(columns.values())))
    schema = [field.split(" ") for field in PAGES.split(", ")]
    return pa.RecordBatch.from_pydict({name: columns[name] if name in columns else pa.nulls(size, kinds[kind]) for name, kind in schema})


def _records(kind: np.dtype, **columns: np.ndarray) -> np.ndarray:
    table = np.empty(len(columns[kind.names[0]]), kind)
    for name, column in columns.items():
        table[name] = column.view(kind[name]) if column.dtype.itemsize == kind[name].itemsize else column
    return table


def _buckets(rarity: np.ndarray) -> int:
    """How many buckets lines and words of prefixes are dealt to, which grows with the number of words."""
    words = np.exp2((rarity[rarity > 1].astype(float) - 17) / 16).sum()
    return int(np.clip(words / 4 / BUCKET, 1 << 10, 1 << 16))


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> dict:
    """Lines and their prefixes by the buckets of the sets."""
    lines, words = (np.concatenate(part) for part in zip(*held))
    bucket = (_mixed(lines["set_a"].view(np.uint64)) % np.uint64(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    begins, bucket, lines = (np.cumsum(lines["width"]) - lines["width"])[order], bucket[order], lines[order]
    words = words[np.repeat(begins, lines["width"]) + _steps(lines["width"])]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    number = np.diff(np.r_[starts, len(lines)])
    return {"bucket": bucket[starts].astype(np.int32), "lines": _packed(lines, number), "prefixes": _packed(words, np.add.reduceat(lines["width"], starts))}


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``bucket`` in pieces of whole buckets."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:  # a batch may hold many buckets
            step = max(1, min(batch.num_rows - at, batch.num_rows * SOLVED // max(batch.nbytes, 1)))
            held.append(batch.slice(at, step))
            size, at = size + held[-1].nbytes, at + step
            if size > SOLVED:
                table = pa.Table.from_batches(held)
                bucket = table.column("bucket").to_numpy()
                stop = int(np.searchsorted(bucket, bucket[-1]))
                if stop:
                    yield table.slice(0, stop).combine_chunks()
                    held = table.slice(stop).to_batches()
                    size = sum(part.nbytes for part in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _leaders(marked: DataFrame) -> DataFrame:
    """The first line of each set that has a prefix, in pages, those with words that may be crowded apart; a row for each other line of a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _together(batches):
            lines, _ = _unpacked(piece.column("lines").chunk(0), LINE)
            words, _ = _unpacked(piece.column("prefixes").chunk(0))
            width = lines["width"]
            begins = np.cumsum(width) - width
            hot = np.zeros(len(lines), bool)
            hot[np.repeat(np.arange(len(lines)), width)[words & 1 == 1]] = True
            order = np.lexsort((_numbered(lines["doc"], lines["line"]), lines["set_b"], lines["set_a"]))
            a, b = lines["set_a"][order], lines["set_b"][order]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            to = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            later = (lines["doc"][order] != lines["doc"][to]) | (lines["line"][order] != lines["line"][to])
            own, to = lines[order[later]], lines[to[later]]
            if len(own):
                yield _filled({name: np.ascontiguousarray(table[field]) for name, table, field in (("doc", own, "doc"), ("line", own, "line"), ("to_doc", to, "doc"), ("to_line", to, "line"))})
            lead = order[first & (width[order] > 0)]
            for kind in (False, True):
                chosen = lead[hot[lead] == kind]
                if len(chosen):
                    wide = width[chosen]
                    taken = words[np.repeat(begins[chosen], wide) + _steps(wide)]
                    yield _filled({"lines": _packed(lines[chosen], np.array([len(chosen)])), "prefixes": _packed(taken, np.array([len(taken)])), "hot": pa.array([kind])})

    pages = marked.where("lines is not null").select("bucket", "lines", "prefixes")
    return written(mapped(pages.repartition("bucket").sortWithinPartitions("bucket"), run, PAGES))


def _pages_of(leaders: DataFrame) -> DataFrame:
    return leaders.where("lines is not null").select("lines", "prefixes")


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of numbers or records as binary values."""
    ends = (values.dtype.itemsize * np.r_[0, np.cumsum(counts)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))])


def _unpacked(packed: pa.Array, kind: np.dtype = np.dtype("<i4")) -> tuple[np.ndarray, np.ndarray]:
    """The numbers or records of all values, and how many each has."""
    ends = np.frombuffer(packed.buffers()[1], np.int32, len(packed) + 1, 4 * packed.offset)
    return np.frombuffer(packed.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // kind.itemsize


PLAIN = ["token", "doc", "line", "shape", "low", "high"]


def _partners(rows: DataFrame, every: bool = False) -> DataFrame:
    """``(doc, line, slack, to_doc, to_line)``: earlier lines that pass the filters, or all of them with ``every``.

    Else each word gives a line one: the first whose classes differ in at most half of what is allowed, or the nearest.
    ``slack`` is by how much the differing classes stay below what is allowed, negative.

    ``rows`` are those of :func:`_paged`, or have the columns of ``PLAIN``, where ``shape`` packs the set's size and the word's place in it;
    ``i``, ``j`` and ``side`` where words are dealt into cells, ``asks`` where only some lines look for partners, and ``keys`` (see
    :func:`_carried`) where each pair is given by its first common words only.
    """
    paged = "words" in rows.columns
    optional = [name for name in ("i", "j", "side", "asks", "keys") if name in rows.columns]
    cell = ["bucket"] if paged else ["token", *(name for name in ("i", "j") if name in optional)]
    width_of = lambda part: len(next(iter(part.values())))

    def solved(columns: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of rows by group, band and ``when``, which numbers the places in their order."""
        doc, line, low, high, size, at, group, band, when = (columns[name] for name in ("doc", "line", "low", "high", "size", "at", "group", "band", "when"))
        looks = columns["asks"].copy() if "asks" in columns else np.ones(len(doc), bool)
        if "side" in columns:
            side = columns["side"]
            split = np.logical_or.reduceat(side, starts)[group]  # a cell of two blocks
        first = np.r_[True, (group[1:] != group[:-1]) | (band[1:] != band[:-1])]
        run, begins = np.cumsum(first) - 1, np.flatnonzero(first)  # of a group's lines in one band
        ends = np.r_[begins[1:], len(doc)]
        in_order = run * (len(doc) + 1) + when
        left, whole = 9 * (size - at).astype(np.int64), 4 * size.astype(np.int64)  # a match has 4/9 of both sizes in common
        best, partner = np.ones(len(doc), np.int64), np.zeros(len(doc), np.int64)  # slack of the best one so far; 1: none
        found = []
        for step in (0, -1, 1):  # only sizes of neighbouring bands can match
            beside = np.clip(np.arange(len(begins)) + step, 0, len(begins) - 1)
            fits = (group[begins[beside]] == group[begins]) & (band[begins[beside]] == band[begins] + step)
            if step == 0:
                fits = ends - begins > 1
            x = np.flatnonzero(fits[run] & looks)
            low_end = begins[beside[run[x]]]
            earlier = np.searchsorted(in_order, beside[run[x]] * (len(doc) + 1) + when[x]) - low_end
            some, turn = earlier > 0, 0
            x, low_end, earlier = x[some], low_end[some], earlier[some]
            while len(x):
                y = low_end + turn
                fit = np.flatnonzero(np.minimum(left[x], left[y]) >= whole[x] + whole[y])  # enough words are left, so the sizes fit as well
                if "side" in columns:
                    fit = fit[~split[x[fit]] | (side[x[fit]] != side[y[fit]])]
                a, b = x[fit], y[fit]
                both = size[a].astype(np.int64) + size[b]
                allowed = both - 2 * -(-4 * both // 9)
                slack = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b]) - allowed
                passed = slack <= 0
                if "keys" in columns:
                    passed[passed] = _first_common(columns["keys"], size, at, a[passed], b[passed])
                turn += 1
                more = earlier > turn
                if every:
                    found.append((a[passed], b[passed], slack[passed]))
                else:
                    better = passed & (slack < best[a])
                    best[a[better]], partner[a[better]] = slack[better], b[better]
                    enough = fit[better & (2 * slack <= -allowed)]
                    looks[x[enough]] = more[enough] = False
                x, low_end, earlier = x[more], low_end[more], earlier[more]
        if not every:
            x = np.flatnonzero(best <= 0)
            found = [(x, partner[x], best[x])]
        if found:
            x, y, slack = (np.concatenate(part) for part in zip(*found))
            if len(x):
                yield pa.RecordBatch.from_pydict({"doc": doc[x], "line": line[x], "slack": slack.astype(np.int32), "to_doc": doc[y], "to_line": line[y]})

    def sorted_out(doc: np.ndarray, line: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        band, when = _band(size), _numbered(doc, line)
        key = group.astype(np.uint64) << np.uint64(32) | band.astype(np.uint64) << np.uint64(24) | when.astype(np.uint64)
        order = np.argsort(key) if len(group) < 1 << 24 else np.lexsort((when, band, group))
        return order, {"group": group[order], "band": band[order], "when": when[order]}

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _together(batches):
            words, _ = _unpacked(piece.column("words").chunk(0), WORD)
            order, added = sorted_out(*(np.ascontiguousarray(words[name]) for name in ("doc", "line", "size")), np.ascontiguousarray(words["token"]).view(np.uint32))
            words = words[order]
            yield from solved({name: np.ascontiguousarray(words[name]) for name in WORD.names} | added, np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell. Whole cells are solved together; the last one waits for more rows."""
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            columns = {name: np.concatenate([part[name] for part in held]) for name in held[0]}
            new = np.zeros(width_of(columns), bool)
            new[0] = True
            for name in cell:
                new[1:] |= columns[name][1:] != columns[name][:-1]
            starts = np.flatnonzero(new)
            stop = len(new) if last else int(starts[-1])
            held[:] = [{name: column[stop:] for name, column in columns.items()}]
            if stop:
                starts = starts[starts < stop]
                part = {name: column[:stop] for name, column in columns.items()}
                part |= {"size": part["shape"] >> 32, "at": part["shape"] & 0xFFFFFFFF, "low": part["low"].view(np.uint64), "high": part["high"].view(np.uint64)}
                order, added = sorted_out(part["doc"], part["line"], part["size"], np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, stop])))
                yield from solved({name: column[order] for name, column in part.items()} | added, starts)

        for batch in batches:
            if batch.num_rows:
                held.append({name: _padded(batch.column(name)) if name == "keys" else batch.column(name).to_numpy(zero_copy_only=False) for name in PLAIN + optional})
                size += batch.num_rows
                if size > 100_000:
                    yield from flush(False)
                    size = width_of(held[0])
        if sum(map(width_of, held)):
            yield from flush(True)

    dealt = rows.select(["bucket", "words"] if paged else PLAIN + optional).repartition(*cell).sortWithinPartitions(*cell)
    return mapped(dealt, pages if paged else run, "doc long, line int, slack int, to_doc long, to_line int")


def _numbered(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Numbers of places in their order, equal for equal ones."""
    bits = int(line.max()).bit_length()
    if (int(doc.max()) - int(doc.min())).bit_length() + bits < 63:
        place = doc - doc.min() << bits | line
        order = np.argsort(place)
        later = np.diff(place[order]) > 0
    else:
        order = np.lexsort((line, doc))
        later = (doc[order[1:]] != doc[order[:-1]]) | (line[order[1:]] != line[order[:-1]])
    when = np.zeros(len(doc), np.int64)
    when[order[1:]] = np.cumsum(later)
    return when


def _words_of(lines: np.ndarray, words: np.ndarray, bit: int, by=lambda token: slice(None)) -> np.ndarray:
    """The words with this lowest bit that lines are found by, their prefixes without the last one, in the order that ``by`` gives."""
    width = lines["width"]
    number = np.maximum(width - 1, 0)
    owner, at = np.repeat(np.arange(len(lines)), number), _steps(number)
    token = words[np.repeat(np.cumsum(width) - width, number) + at]
    if ((token & 1) != bit).any():
        of_kind = token & 1 == bit
        owner, at, token = owner[of_kind], at[of_kind], token[of_kind]
    order = by(token)
    owner = owner[order]
    return _records(WORD, token=token[order], at=at[order], **{name: np.ascontiguousarray(lines[name])[owner] for name in ("doc", "line", "size", "low", "high")})


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The lines of pages that have prefixes, about ``PAGED`` words of these at a time, and the words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        for i in range(batch.num_rows):
            page = batch.slice(i, 1)
            held.append((_unpacked(page.column(0), LINE)[0], _unpacked(page.column(1))[0]))
            if sum(len(words) for _, words in held) > PAGED:
                yield tuple(np.concatenate(part) for part in zip(*held))
                held.clear()
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held))


def _paged(leaders: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, words)``: the words that are not crowded, those of one bucket in one row for many lines of a task. All rows of a word are in one bucket."""

    def bucket_of(token: np.ndarray) -> np.ndarray:
        return ((_mixed(token.astype(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, prefixes in _opened(batches):
            words = _words_of(lines, prefixes, 0, lambda token: np.argsort(bucket_of(token), kind="stable"))
            if len(words):
                bucket = bucket_of(words["token"])
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                yield pa.RecordBatch.from_pydict({"bucket": bucket[starts].astype(np.int32), "words": _packed(words, np.diff(np.r_[starts, len(words)]))})

    return mapped(_pages_of(leaders), run, "bucket int, words binary")


def _crowded(leaders: DataFrame) -> DataFrame:
    """Rows with the columns of ``PLAIN`` for the words that may be crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, prefixes in _opened(batches):
            words = _words_of(lines, prefixes, 1)
            columns = {name: np.ascontiguousarray(words[name]) for name in WORD.names}
            columns |= {"shape": columns["size"].astype(np.int64) << 32 | columns["at"], "low": columns["low"].view(np.int64), "high": columns["high"].view(np.int64)}
            yield pa.RecordBatch.from_pydict({name: columns[name] for name in PLAIN})

    return kept(mapped(_pages_of(leaders.where("hot")), run, "token int, doc long, line int, shape long, low long, high long"))


def _cells(maybe: DataFrame) -> DataFrame:
    """Words that may be crowded are counted, and dealt into cells where they are."""
    counts = maybe.groupBy("token").count().where(F.col("count") > CELL)
    parts = counts.select(F.col("token").alias("hot"), F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    blocks = F.coalesce("parts", F.lit(1))
    block = F.pmod(F.xxhash64("doc", "line"), blocks).cast("int")
    return (
        maybe.join(parts, F.col("token") == F.col("hot"), "left")
        .withColumns({"block": block, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
        .withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": F.col("block") > F.col("other")})
    )


def _found(rows: DataFrame, every: bool = False) -> DataFrame:
    """The partners over all rows with the columns of ``PLAIN``."""
    return _partners(rows.where("token & 1 = 0"), every).union(_partners(_cells(rows.where("token & 1 = 1")), every))


def _place(bits: int = NEEDED_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc", "line"), 64 - bits)


def _places(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return spark_hash(doc, line) >> np.uint64(64 - NEEDED_BITS)


def _band(sizes: np.ndarray) -> np.ndarray:
    """Bands of sizes; sizes that may match lie at most one band apart."""
    return np.searchsorted(BANDS, sizes, "right") - 1 if sizes.max(initial=0) > 1023 else SMALL_BANDS[sizes]


def _token_places(tokens: np.ndarray, sizes: np.ndarray, step: int = 0, probe: int = 0) -> np.ndarray:
    """Places of words with the band of their line's size. Each has ``PROBES`` and is in the table if all of them are."""
    own = (tokens.astype(np.int64) << 16 | _band(sizes) + step + 1).view(np.uint64)
    return _mixed(own) >> np.uint64((64 - NEEDED_BITS) * (PROBES - 1 - probe) // (PROBES - 1)) & np.uint64((1 << NEEDED_BITS) - 1)


def _asking_keys(prefixes: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(line, key, at, then)``: what lines ask by and answer to in the second round; ``at`` and ``then`` are the places of its words (0: no second one).

    Sets of up to ``PAIRED`` words have all pairs of their prefix, with the lowest bit set, as a key may be crowded. Longer ones, and those
    that may match a longer one, have the single words.
    """
    tokens, counts = _unpacked(prefixes)
    owner, at = np.repeat(np.arange(len(sizes)), counts), _steps(counts)
    left = counts[owner] - at - 1  # words behind this one
    single = (5 * sizes[owner] > 4 * PAIRED) & (left > 0)
    found = [(owner[single], tokens[single], at[single], np.zeros(int(single.sum()), np.int64))]
    paired = np.where(sizes[owner] <= PAIRED, left, 0)
    for step in range(1, int(paired.max(initial=0)) + 1):
        first = np.flatnonzero(paired >= step)
        both = tokens[first].view(np.uint32).astype(np.uint64) << np.uint64(32) | tokens[first + step].view(np.uint32)
        keys = (_mixed(both) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        found.append((owner[first], keys.view(np.int32), at[first], at[first] + step))
    return tuple(np.concatenate(part) for part in zip(*found))


def _carried(prefixes: pa.Array, owner: np.ndarray, then: np.ndarray) -> pa.Array:
    """For each row of a line (``owner``) the place of its key's second word, followed by the first words of the line's prefix."""
    tokens, counts = _unpacked(prefixes)
    taken = np.minimum(counts, CARRIED)[owner]
    starts = np.cumsum(taken + 1) - taken - 1
    values = np.zeros(int((taken + 1).sum()), np.int32)
    values[starts] = then
    steps = _steps(taken)
    values[np.repeat(starts + 1, taken) + steps] = tokens[np.repeat((np.cumsum(counts) - counts)[owner], taken) + steps]
    ends = (4 * np.r_[0, np.cumsum(taken + 1)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _padded(carried: pa.Array) -> np.ndarray:
    """What :func:`_carried` gives as a table of ``CARRIED`` + 1 columns."""
    lengths = pc.binary_length(carried).to_numpy(zero_copy_only=False) // 4
    table = np.zeros((len(carried), CARRIED + 1), np.int32)
    table[np.repeat(np.arange(len(carried)), lengths), _steps(lengths)] = np.frombuffer(b"".join(carried.to_pylist()), np.int32)
    return table


def _first_common(keys: np.ndarray, size: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs have no common word that is before their key's first word in both lines, or between its two words in both.

    Lines that match have such a key: of their common words one that no other is before in both, and of those behind it likewise. Lines that both
    ask by pairs do not meet by single words.
    """
    out = np.zeros(len(x), bool)
    wide = min(CARRIED, max(at[x].max(initial=0), at[y].max(initial=0), keys[x, 0].max(initial=0), keys[y, 0].max(initial=0)))
    place, nowhere = np.arange(wide), np.full(len(at), -1)
    inside = lambda rows, low, high: (place > low[rows, None]) & (place < high[rows, None])
    for start in range(0, len(x), 4096):
        a, b = x[start : start + 4096], y[start : start + 4096]
        same = keys[a, 1 : wide + 1, None] == keys[b, None, 1 : wide + 1]
        both = inside(a, nowhere, at)[:, :, None] & inside(b, nowhere, at)[:, None, :]
        both |= inside(a, at, keys[:, 0])[:, :, None] & inside(b, at, keys[:, 0])[:, None, :]
        paired = keys[a, 0] > 0
        meant = (paired == (keys[b, 0] > 0)) & (paired | (np.maximum(size[a], size[b]) > PAIRED))
        out[start : start + 4096] = meant & ~(same & both).any(axis=(1, 2))
    return out


def _asked(leaders: DataFrame, asking: np.ndarray) -> DataFrame:
    """Rows of all lines for the keys of the lines that ask, by the bit table of their places.

    The tables may hold some more lines and keys; these are tried as well, which is only work.
    """
    pages = _pages_of(leaders)
    sent = leaders.sparkSession.sparkContext.broadcast(asking)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], pa.Array, np.ndarray]]:
        for table, words in _opened(batches):
            full = table[table["width"] > 0]
            prefixes = _packed(words, full["width"])
            for start in range(0, len(full), 10_000):
                part = full[start : start + 10_000]
                lines = {name: np.ascontiguousarray(part[name]) for name in ("doc", "line", "size", "low", "high")}
                yield lines, prefixes.slice(start, len(part)), _held(sent.value, _places(lines["doc"], lines["line"]))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, prefixes, ask in opened(batches):
            sizes = lines["size"][ask]
            owner, keys, _, _ = _asking_keys(prefixes.filter(pa.array(ask)), sizes)
            places = np.concatenate([_token_places(keys, sizes[owner], step, probe) for step in (-1, 0, 1) for probe in range(PROBES)])
            yield pa.RecordBatch.from_pydict({"place": np.unique(places).view(np.int64)})

    table = leaders.sparkSession.sparkContext.broadcast(_bit_table(mapped(pages, words, "place long")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, prefixes, ask in opened(batches):
            size = lines["size"]
            owner, keys, at, then = _asking_keys(prefixes, size)
            sizes = size[owner]
            for probe in range(PROBES):
                use = _held(table.value, _token_places(keys, sizes, probe=probe))
                owner, keys, at, then, sizes = owner[use], keys[use], at[use], then[use], sizes[use]
            shape = size[owner].astype(np.int64) << 32 | at
            own = {name: lines[name][owner] for name in ("doc", "line")} | {name: lines[name].view(np.int64)[owner] for name in ("low", "high")}
            carried = _carried(prefixes, owner, then)
            yield pa.RecordBatch.from_pydict({"token": keys, "doc": own["doc"], "line": own["line"], "shape": shape, "low": own["low"], "high": own["high"], "asks": ask[owner], "keys": carried})

    return written(mapped(pages, rows, "token int, doc long, line int, shape long, low long, high long, asks boolean, keys binary"))


def _sets_of(docs: DataFrame, pairs: DataFrame, least: int, unit: type[Lines]) -> DataFrame:
    """``(doc, line, words)`` of the lines in ``pairs``, and some others that the bit tables of documents and places hold."""
    ends = pairs.select("doc", "line").union(pairs.select(F.col("to_doc").alias("doc"), F.col("to_line").alias("line")))
    of_docs = F.shiftrightunsigned(F.xxhash64("doc", F.lit(0)), 64 - NEEDED_BITS)
    context = docs.sparkSession.sparkContext
    some, sent = context.broadcast(_bit_table(ends.select(of_docs.alias("place")))), context.broadcast(_bit_table(ends.select(_place().alias("place"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            chosen = batch.filter(pa.array(_held(some.value, _places(doc, np.zeros(len(doc), np.int32)))))
            for chunk in text_chunks(iter([chosen]), "text", CHUNK):
                doc = chunk.column(0).to_numpy(zero_copy_only=False)
                lines = unit(chunk.column(1), lambda row, line: _held(sent.value, _places(doc[row], line)))  # noqa: B023
                line, sizes, _, words = lines.sets(np.zeros(1 << BITS, np.uint16), least)
                sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"doc": doc[lines.row[line]], "line": lines.place[line].astype(np.int32), "words": sets})

    return mapped(docs.select("doc", "text").where("text is not null"), run, "doc long, line int, words array<long>")


def spark_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """xxhash64 of a long and then an int, as the SQL function gives it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: x << np.uint64(r) | x >> np.uint64(64 - r)

    def end(h):
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8) ^ turn(doc.view(np.uint64) * p2, 31) * p1
        h = end(turn(h, 27) * p1 + p4)
        h = h + p5 + np.uint64(4) ^ line.astype(np.uint32).astype(np.uint64) * p1
        return end(turn(h, 23) * p2 + p3)


def _verified(docs: DataFrame, pairs: DataFrame, least: int, unit: type[Lines]) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of 4/5 or more."""
    sets = written(_sets_of(docs, pairs, least, unit))
    own = sets.select(F.col("doc").alias("doc"), F.col("line").alias("line"), F.col("words").alias("words"))
    to = sets.select(F.col("doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("words").alias("to_words"))
    both = pairs.join(own, ["doc", "line"]).join(to, ["to_doc", "to_line"])
    common = F.size(F.array_intersect("words", "to_words"))
    return both.where(9 * common >= 4 * (F.size("words") + F.size("to_words"))).select("doc", "line", "to_doc", "to_line")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``(doc, line, to_doc, to_line)``: each line that goes and an earlier line that it matches; ``doc`` as in :func:`order_of`."""
    return matches(docs.select(order_of(F.col(doc_id)).alias("doc"), F.col(text).alias("text")), least, Lines)


def matches(ours: DataFrame, least: int, unit: type[Lines]) -> DataFrame:
    """As :func:`repeats`, of ``(doc, text)``: the sets are what ``unit`` makes of a text, those of ``least`` members or more."""
    rarity = _rarity(ours, unit)
    marked = written(_marked(ours, rarity, least, unit))
    leaders = _leaders(marked)
    same = ["doc", "line", "to_doc", "to_line"]
    known = marked.where("lines is null").select(same).union(leaders.where("lines is null").select(same))
    found = _partners(_paged(leaders, _buckets(rarity))).union(_partners(_cells(_crowded(leaders))))
    best = F.min(F.struct("slack", "to_doc", "to_line")).alias("to")
    pairs = kept(found.groupBy("doc", "line").agg(best).select("doc", "line", "to.to_doc", "to.to_line"))
    near = kept(_verified(ours, pairs, least, unit))
    gone = known.union(near)
    untried = kept(pairs.join(near.select("doc", "line"), ["doc", "line"], "left_anti"))
    if not untried.isEmpty():
        rest = _found(_asked(leaders, _bit_table(untried.select(_place().alias("place")))), every=True).drop("slack").distinct()
        more = kept(rest.join(pairs, ["doc", "line", "to_doc", "to_line"], "left_anti"))
        gone = gone.union(_verified(ours, more, least, unit))
    return gone


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``(doc, removed)``: the places of the lines that go, in order, for each document that loses any."""
    return repeats(docs, doc_id, text, least).groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines taken out of the texts."""
    by, places = fresh("gone doc", docs.columns), fresh("gone lines", docs.columns)
    gone = removed(docs, doc_id, text, least).select(F.col("doc").alias(by), F.col("removed").alias(places))
    joined = docs.join(gone, order_of(docs[doc_id]) == gone[by], "left")
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(places, i))
    return joined.withColumn(text, F.when(F.col(places).isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))).select(docs.columns)
