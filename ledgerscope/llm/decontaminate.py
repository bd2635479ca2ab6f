"""Benchmark decontamination on templates: finds benchmark items in documents, also with other numbers, names and units.

Texts become canonical tokens: words are lower-cased and stripped of punctuation, numbers, units and runs of names
(capitalised words inside a sentence) become typed placeholders whose values are kept as slots. Windows of five
tokens, at least three of them plain words, are hashed and joined with the windows of the benchmark. A bit table
of fixed size over the benchmark's hashes goes to the tasks first, so that only windows that may match are shuffled; if
a large benchmark fills it, more rows go to the join and the result stays the same.

A document holds an item if, within a stretch of about the item's length, 0.8 of the item's windows
match and the slots are consistent: each value of the item stands for one value in the document throughout. Matches are
judged along an alignment, the distance between a place in the document and its place in the item: of matches of the
same window only the one nearest to it counts, so windows that an item holds twice do not meet crosswise.

Windows are made twice: with names as placeholders, and with names as lower-cased words, so that a copy in other letter
case is found as well. An item without any window is found by its words and numbers as they are, in any letter case, as
one run of tokens. Items of fewer than ``LEAST`` tokens, such as one-word answers, stand in many clean texts, so they are found only where a
text holds nothing else. In scripts that are written without blanks each
character is a token.

Null and empty texts hold nothing; items without a letter or digit match nothing. Repeated rows
are found once. Extra columns are ignored by :func:`leaks` and kept by :func:`clean`. Documents are told apart by
doc_id and text, so null or repeated ids are no trouble.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import mapped, text_chunks

WINDOW = 5
PLAIN = 3
COVERAGE = 0.8
LEAST = 3  # tokens of an item that is found inside of longer texts
BITS = 22
KEPT_TOKENS = 300_000
# Units that become a placeholder.
UNITS = set(
    "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec secs min mins h hr hrs hour hours day days week weeks month months "
    "year years minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches "
    "foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees kmh mph hz khz mhz ghz w kw mw v a kb mb gb tb".split()
)
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
BREAK = "\x00"
# Chinese characters, kana, Thai, Lao, Burmese, Khmer: written without blanks.
BLANKLESS = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
LITERAL, NUMERIC, UNIT, MEASURE, NAME, NOTHING = range(6)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 11)


MARKS = {NUMERIC: _digest("\x00num"), UNIT: _digest("\x00unit"), MEASURE: _digest("\x00num\x00unit"), NAME: _digest("\x00name"), NOTHING: 0}


def _token(raw: str) -> tuple[str, int, bool, bool]:
    """Core, kind, whether it looks like a name, and whether a sentence ends with it."""
    ends = raw == BREAK or raw.rstrip("\"')]}*&%$#!").endswith((".", "?", "!", ":")) or raw.endswith(("!", "?"))
    first, last = 0, len(raw)
    while first < last and not (raw[first].isalnum()):
        first += 1
    while last > first and not raw[last - 1].isalnum():
        last -= 1
    core = raw[first:last]
    if not core:
        return "", NOTHING, False, ends
    lower = core.lower()
    number = NUMBER.match(core)
    if number:
        rest = lower[number.end() :]
        if not rest:
            return core, MEASURE if raw[last : last + 1] == "%" or raw[first - 1 : first] in "$€£" and first else NUMERIC, False, ends
        if rest in UNITS:
            return core, MEASURE, False, ends
    if lower in UNITS:
        return core, UNIT, False, ends
    return core, LITERAL, core[0].isupper() and core[1:].islower(), ends


def _raws(text: str | None) -> list[str]:
    text = (text or "").replace("\n", " \x00 ")
    return (text if text.isascii() else BLANKLESS.sub(r" \1 ", text)).split()


class Canonical:
    """Canonical tokens of many texts at once; what is known of a raw token is kept, at most ``KEPT_TOKENS`` and one chunk's."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.number = {BREAK: 0}
        self.cores = [""]
        self.table = np.array([(0, NOTHING, 0, 1, 0)], "u8,u1,u1,u1,u8")

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the raw tokens, and the text of each."""
        split = [_raws(text) for text in texts]
        if len(self.number) > KEPT_TOKENS:
            self._forget()
        new = list(set().union(*split) - self.number.keys())
        if new:
            known = [_token(raw) for raw in new]
            self.number.update(zip(new, range(len(self.cores), len(self.cores) + len(new))))
            self.cores += [core for core, *_ in known]
            rows = [(MARKS.get(kind) if kind else _digest(core.lower()), kind, name, ends, _digest(core.lower())) for core, kind, name, ends in known]
            self.table = np.r_[self.table, np.array(rows, self.table.dtype)]
        codes = np.fromiter((c for raws in split for c in (0, *map(self.number.__getitem__, raws))), np.int64)  # each text starts after a break
        return codes, np.repeat(np.arange(len(texts)), [len(raws) + 1 for raws in split])

    def values(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token its lower-cased value's hash, and its text."""
        real = self.table["f1"][codes] != NOTHING
        return self.table["f4"][codes[real]], owner[real]

    def tokens(self, codes: np.ndarray, owner: np.ndarray, names: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """For each token: hash, kind and text number, and what :meth:`core` needs. A name run is one token, or with ``names`` off words."""
        hashes, kind, named, ends = (self.table[f"f{i}"][codes] for i in range(4))
        name = np.zeros(len(codes), bool)
        name[1:] = named[1:].astype(bool) & ~ends[:-1].astype(bool) & names
        hashes, kind = np.where(name, np.uint64(MARKS[NAME]), hashes), np.where(name, NAME, kind)
        real = kind != NOTHING
        codes, owner, hashes, kind, name = codes[real], owner[real], hashes[real], kind[real], name[real]
        again = np.zeros(len(codes), bool)
        again[1:] = name[1:] & name[:-1] & (owner[1:] == owner[:-1])
        kept = np.flatnonzero(~again)
        stops = np.r_[kept[1:], len(codes)]
        return hashes[kept], kind[kept], owner[kept], (codes, stops)

    def core(self, run: tuple, at: int) -> str:
        """The value of a token; of a name its last word, as a run may have taken in a capital word before the name."""
        codes, stops = run
        return self.cores[codes[stops[at] - 1]]


def _windows(hashes: np.ndarray, kind: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window starts that lies in one text and has enough plain words, and its hash."""
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = np.zeros(count, np.uint64)
    plain = np.zeros(count, np.int64)
    for j in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + count]
        mixed ^= mixed >> np.uint64(29)
        plain += kind[j : j + count] == LITERAL
    at = np.flatnonzero((owner[:count] == owner[WINDOW - 1 :]) & (plain >= PLAIN))
    return at, mixed[at]


def _whole(hashes: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``length`` tokens start that lie in one text, and the hash of them."""
    count = len(hashes) - length + 1
    at = np.flatnonzero(owner[:count] == owner[length - 1 :]) if count > 0 else np.zeros(0, np.int64)
    mixed = np.full(len(at), length, np.uint64)
    for j in range(length):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[at + j]
        mixed ^= mixed >> np.uint64(29)
    return at, mixed


NAMES, CASELESS, WHOLE = range(3)  # how a row's hash was made
SALTS = [np.uint64(0), np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)]


def _window_rows(texts: DataFrame, table: np.ndarray | None, lengths: list[int] | None = None) -> DataFrame:
    """``(key columns, hash, at, windows, way, length, slots)`` of the windows that the bit table may hold, or of all windows.

    ``texts`` has the text last. ``windows``: how many the text has; ``way``: with names, without, or a whole item of ``length`` tokens;
    ``slots``: kind and value of the placeholders. Without ``lengths`` texts are items: those that have no window give a row for the whole.
    """
    *names, _ = texts.columns
    sent = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        bits = sent.value

        def rows(chunk, way, at, mixed, text, total, length, slots_of) -> pa.RecordBatch:
            mixed = mixed ^ SALTS[way]
            if bits is not None:
                place = mixed >> np.uint64(64 - BITS)
                hit = bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
                at, mixed, text = at[hit], mixed[hit], text[hit]
            out = {name: chunk.column(i).take(pa.array(text)) for i, name in enumerate(names)}
            first = np.searchsorted(slots_of[0], np.arange(chunk.num_rows))
            out |= {"hash": mixed.view(np.int64), "at": (at - first[text]).astype(np.int64), "windows": total[text].astype(np.int64)}
            out |= {"way": np.full(len(at), way, np.int32), "length": np.full(len(at), length, np.int32)}
            return pa.RecordBatch.from_pydict({**out, "slots": pa.array([slots_of[1](a) for a in at.tolist()], pa.list_(pa.string()))})

        for chunk in text_chunks(batches, texts_name):
            codes, of = canonical.read(chunk.column(len(names)).to_pylist())
            for way in (NAMES, CASELESS):
                hashes, kind, owner, runs = canonical.tokens(codes, of, way == NAMES)
                at, mixed = _windows(hashes, kind, owner)
                total = np.bincount(owner[at], minlength=chunk.num_rows)
                slots = lambda a: [f"{kind[i]}:{canonical.core(runs, i)}" for i in range(a, a + WINDOW) if kind[i]]  # noqa: E731, B023
                yield rows(chunk, way, at, mixed, owner[at], total, 0, (owner, slots))
            hashes, owner = canonical.values(codes, of)
            sizes, one = np.bincount(owner, minlength=chunk.num_rows), np.ones(chunk.num_rows, np.int64)
            for length in np.unique(sizes[(total == 0) & (sizes > 0)]).tolist() if lengths is None else lengths:
                at, mixed = _whole(hashes, owner, length)
                if lengths is None:
                    own = (sizes[owner[at]] == length) & (total[owner[at]] == 0)
                    at, mixed = at[own], mixed[own]
                elif length < LEAST:
                    alone = sizes[owner[at]] == length
                    at, mixed = at[alone], mixed[alone]
                yield rows(chunk, WHOLE, at, mixed, owner[at], one, length, (owner, lambda a: []))

    texts_name = texts.columns[-1]
    kinds = ", ".join(f"`{name}` {texts.schema[name].dataType.simpleString()}" for name in names)
    return mapped(texts, run, f"{kinds}, hash long, at long, windows long, way int, length int, slots array<string>")


def _bit_table(hashes: DataFrame) -> np.ndarray:
    """A set of hash beginnings in 2**BITS bits; what comes to the driver is bounded by that."""
    places = hashes.select(F.shiftrightunsigned("hash", 64 - BITS).alias("place")).distinct().toArrow()["place"].to_numpy()
    table = np.zeros(1 << BITS - 3, np.uint8)
    np.bitwise_or.at(table, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return table


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, item_id, coverage, changed)`` for each item that a document holds.

    ``coverage``: the best share of the item's windows in one stretch; ``changed``: how many of its slot values differ there.
    """
    items = _window_rows(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), None)
    ours = items.select("hash", "way", "item_id", F.col("at").alias("item_at"), F.col("windows").alias("item_windows"), F.col("slots").alias("item_slots"))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    lengths = [row["length"] for row in items.where(F.col("way") == WHOLE).select("length").distinct().orderBy("length").collect()]
    rows = _window_rows(keyed, _bit_table(items), lengths).drop("windows", "length")
    met = rows.join(ours, ["hash", "way"])
    # Matches of one stretch have nearby distances; of two grids of item lengths one holds them together.
    length, apart = F.col("item_windows") + WINDOW, F.col("at") - F.col("item_at")
    grids = F.array(*(F.struct(F.lit(i).alias("grid"), F.floor((apart + shift) / length).alias("cell")) for i, shift in enumerate((F.lit(0), length / 2))))
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    placed = met.select("doc_id", "text_hash", "item_id", "way", "item_at", "item_windows", apart.alias("apart"), pairs.alias("pairs"), F.explode(grids).alias("stretch"))
    cell = ["doc_id", "text_hash", "item_id", "way", "item_windows", "stretch"]
    full = (
        placed.groupBy(*cell)
        .agg(F.collect_set(F.struct("item_at", "apart", "pairs")).alias("matches"))
        .withColumn("coverage", F.size(F.array_distinct("matches.item_at")) / F.col("item_windows"))
        .where(f"coverage >= {COVERAGE}")
    )
    # Each distance in the cell is tried as the alignment: of an item's window the match nearest to it counts, others are strays.
    tried = full.withColumn("along", F.explode(F.array_distinct("matches.apart"))).withColumn("match", F.explode("matches"))
    nearest = F.min(F.struct(F.abs(F.col("match.apart") - F.col("along")).alias("off"), F.col("match.apart").alias("apart"), F.col("match.pairs").alias("pairs")))
    chosen = tried.groupBy(*cell, "coverage", "along", "match.item_at").agg(nearest.alias("match"))
    found = (
        chosen.groupBy(*cell, "coverage", "along")
        .agg(F.array_distinct(F.flatten(F.collect_list("match.pairs"))).alias("pairs"))
        .where(F.size(F.array_distinct("pairs.item")) == F.size("pairs"))
    )
    changed = F.size(F.filter("pairs", lambda pair: pair["item"] != pair["doc"]))
    best = F.max(F.struct("coverage", (-changed).alias("same"))).alias("best")
    result = found.groupBy("doc_id", "text_hash", "item_id").agg(best)
    return result.select("doc_id", "text_hash", "item_id", "best.coverage", (-F.col("best.same")).alias("changed"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item."""
    held = leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("held_id"), F.col("text_hash").alias("held_hash")).distinct()
    same = docs[doc_id].eqNullSafe(held["held_id"]) & (F.xxhash64(docs[text]) == held["held_hash"])
    return docs.join(held, same, "left_anti")
