"""Byte-level BPE encoding and decoding with a compiled lexicon of the corpus's frequent words.

Encoding takes two passes. The first counts the words of all texts; the most frequent
ones (``lexicon_words``) get their ids once and are compiled into a minimal acyclic
transducer, which goes to the executors as a file and is memory-mapped there. The second pass
looks the distinct words of a chunk up in the transducer, all side by side, and merges
those that it does not hold by the merge ranks, exactly.

Null texts count as empty: no ids, decoded to the empty text. Repeated rows are encoded
each; other columns are kept; an input column named like an output column is replaced.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import loaded, mapped, text_chunks
from ledgerscope.llm.lexicon import Lexicon, compile_lexicon

LEXICON_WORDS = 200_000
# Fixed value: how byte-level BPE splits a text into words.
WORD = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, IDS = 1 << 20, 1 << 18  # bytes of text, and ids, that a worker handles at a time
LONG = 64  # bytes; longer words merge one by one with a heap
NONE = np.iinfo(np.int32).max
KEPT_PIECES = 500_000  # pieces whose ids a worker keeps between chunks


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in plain else next(others)) for byte in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        ids = spec["model"]["vocab"]
        self.bytes_of = {number: bytes(byte_of[c] for c in token) for token, number in ids.items()}
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.bytes_of.update({number: content.encode() for content, number in self.special.items()})
        self.byte_id = np.array([ids[letter] for letter in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pairs = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([rank for rank, _ in self.pairs.values()], np.int64)[order]
        self.merged = np.array([new for _, new in self.pairs.values()], np.int64)  # by rank
        self.word = regex.compile(WORD)

    def flat_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each id: how many bytes, where they start; and the bytes of all."""
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        lengths = np.array(list(map(len, tokens)), np.int64)
        return lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(tokens), np.uint8)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _merge_long(self, word: bytes) -> list[int]:
        ids = [int(self.byte_id[b]) for b in word]
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.pairs[pair][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := self.pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, (ids[a], ids[b])))
        return [i for i in ids if i >= 0]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: pairs of least rank are merged, leftmost first, one in every word at a time."""
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, word in enumerate(words) if 0 < len(word) <= LONG]
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self._merge_long(word)
        ids = self.byte_id[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        owner = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        rank = np.full(len(ids), NONE, np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inside] = self._rank(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.minimum.reduceat(rank, starts)
            done = np.repeat(least == NONE, sizes)
            if done.any():
                values = ids[done].tolist()
                at = 0
                for word, size in zip(owner[starts[least == NONE]].tolist(), sizes[least == NONE].tolist()):
                    out[word] = values[at : at + size]
                    at += size
                ids, owner, rank = ids[~done], owner[~done], rank[~done]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, sizes))
            hits = hits[np.r_[True, owner[hits][1:] != owner[hits][:-1]]]
            ids[hits] = self.merged[rank[hits]]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            moved = hits - np.arange(len(hits))  # one is gone for each hit to the left
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            for at in (moved, moved[moved > 0] - 1):
                here = at[at + 1 < len(ids)]
                same = owner[here] == owner[here + 1]
                rank[here] = np.where(same, self._rank(ids[here], ids[here + 1]), NONE)
                rank[at[at + 1 >= len(ids)]] = NONE
        return out


class Pieces:
    """Cuts texts at blanks that stand between two other characters; there a word always ends.

    A piece after a blank is one without its blank, so equal pieces can be looked up. Texts with longer
    runs of white space are cut by a pattern at the same blanks.
    """

    run = re.compile(r"\s\s")
    blank = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, special: dict[str, int]):
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.names = special

    def segments(self, text: str) -> list[str]:
        """The text between special tokens, and these tokens as segments of their own."""
        if self.special is None or not any(name in text for name in self.names):
            return [text] if text else []
        return [segment for segment in self.special.split(text) if segment]

    def cut(self, segment: str) -> list[str]:
        return self.blank.split(segment) if self.run.search(segment) else segment.split(" ")


def words_of_pieces(word, pieces: list[str]) -> list[list[str]]:
    """The words of each piece. Plain pieces that start with a blank are split in one go: only their first words do so."""
    plain = [p for p in pieces if p[:1] == " " and " " not in p[1:] and not p[-1:].isspace()]
    found = word.findall("".join(plain))
    starts = [i for i, w in enumerate(found) if w[0] == " "] + [len(found)]
    split = {piece: found[a:b] for piece, a, b in zip(plain, starts, starts[1:])}
    return [split[piece] if piece in split else word.findall(piece) for piece in pieces]


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for, and remembers the new ones."""

    def __init__(self, names=()):
        super().__init__(zip(names, range(len(names))))
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class Encoder:
    """Ids of texts. Keeps those of pieces between chunks; beyond ``KEPT_PIECES`` the less used ones are forgotten."""

    def __init__(self, path: str, lexicon: str):
        self.vocabulary = loaded(Vocabulary, path)
        self.pieces = Pieces(self.vocabulary.special)
        self.lexicon = Lexicon(SparkFiles.get(lexicon))
        self.number = Numbers()  # of pieces: (text,) at the start, text after a blank, (text, 0) special
        self.sizes = self.starts = self.uses = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps at most half as many pieces as allowed: those used most since the last time."""
        order = np.argsort(-self.uses, kind="stable")[: KEPT_PIECES // 2]
        keep = np.sort(order[self.uses[order] > 1])
        names = list(self.number)
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(self.starts[keep] - ends + sizes, sizes) + np.arange(sizes.sum())]
        self.number = Numbers([names[old] for old in keep.tolist()])
        self.sizes, self.starts, self.uses = sizes, ends - sizes, np.zeros(len(keep), np.int64)

    def _word_ids(self, words: list[str]) -> dict[str, list[int]]:
        raw = [word.encode() for word in words]
        places = self.lexicon.places(raw)
        starts, values = self.lexicon.starts, self.lexicon.ids
        known, unseen = np.flatnonzero(places >= 0), np.flatnonzero(places < 0).tolist()
        found = dict(zip([words[i] for i in unseen], self.vocabulary.merge([raw[i] for i in unseen])))
        for i, a, b in zip(known.tolist(), starts[places[known]].tolist(), starts[places[known] + 1].tolist()):
            found[words[i]] = values[a:b].tolist()
        return found

    def _learn(self, keys: list) -> None:
        texts = [" " + key if isinstance(key, str) else key[0] for key in keys]
        special = [isinstance(key, tuple) and len(key) == 2 for key in keys]
        split = words_of_pieces(self.vocabulary.word, ["" if s else text for text, s in zip(texts, special)])
        get = self._word_ids(list(set(chain.from_iterable(split)))).__getitem__
        lists = [[self.vocabulary.special[text]] if s else list(chain.from_iterable(map(get, words))) for text, s, words in zip(texts, special, split)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.uses = np.r_[self.uses, np.zeros(len(sizes), np.int64)]
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts."""
        keys: list = []
        ends = [0]
        for text in texts:
            for segment in self.pieces.segments(text or ""):
                if segment in self.vocabulary.special:
                    keys.append((segment, 0))
                else:
                    pieces = self.pieces.cut(segment)
                    keys.append((pieces[0],))
                    keys += pieces[1:]
            ends.append(len(keys))
        if len(self.number) > KEPT_PIECES:
            self._forget()
        codes = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        new, self.number.new = self.number.new, []
        self._learn(new)
        self.uses += np.bincount(codes, minlength=len(self.uses))
        sizes = self.sizes[codes]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[codes] - after + sizes, sizes) + np.arange(sizes.sum())]
        return np.r_[0, after][ends], ids


def count_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``(word, count)`` over all texts. Pieces between blanks are counted first, and each different one is split once.

    Runs of white space of several kinds may be split otherwise than in the whole text; counts only choose words.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = loaded(Vocabulary, path).word
        for batch in batches:
            pieces = [" " + piece if blank else piece for piece, blank in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            times: Counter = Counter()
            for found, n in zip(words_of_pieces(word, pieces), batch.column(2).to_pylist()):
                for each in found:
                    times[each] += n
            yield pa.RecordBatch.from_pydict({"word": pa.array(times.keys(), pa.string()), "count": pa.array(times.values(), pa.int64())})

    pieces = docs.select(F.posexplode(F.split(text, " ", -1)).alias("place", "piece")).groupBy("piece", (F.col("place") > 0).alias("blank"))
    return mapped(pieces.agg(F.count("*").alias("n")), split, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def _word_ids(words: DataFrame, path: str) -> DataFrame:
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(Vocabulary, path)
        for batch in batches:
            values = batch.column(0).to_pylist()
            lists = vocabulary.merge([value.encode() for value in values])
            yield pa.RecordBatch.from_pydict({"word": values, "ids": pa.array(lists, pa.list_(pa.int32()))})

    return mapped(words.select("word"), ids, "word string, ids array<int>")


def build_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compiles the ``words`` most frequent words of ``docs`` (ties: by the word); the file's name on every executor.

    What comes to the driver is bounded by ``words``.
    """
    special = list(Vocabulary(path).special)
    counted = count_words(docs, path, text).where(~F.col("word").isin(special) & (F.octet_length("word") <= LONG))
    top = counted.orderBy(F.desc("count"), "word").limit(words)
    entries = {row["word"].encode(): row["ids"] for row in _word_ids(top, path).toLocalIterator()}
    name = f"lexicon-{uuid.uuid4().hex}"
    place = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    compile_lexicon(entries, place)
    docs.sparkSession.sparkContext.addFile(place)  # copied to each executor, also to those that start later
    return name


def encode(
    docs: DataFrame, path: str, text: str = "text", lexicon: str | None = None, words: int = LEXICON_WORDS, round_trip: bool = False, keep_text: bool = True
) -> DataFrame:
    """``docs`` with the column ``ids``, an array of int, and with ``round_trip`` also ``decoded``, the text that these ids give.

    ``lexicon``: a name from :func:`build_lexicon`.
    """
    name = lexicon or build_lexicon(docs, path, text, words)
    rest = docs.drop("ids", *["decoded"] if round_trip else [])
    passed = [column for column in rest.columns if keep_text or column != text]
    added = {"ids": F.lit(None).cast("array<int>"), **({"decoded": F.lit("")} if round_trip else {})}
    schema = rest.select(*passed, *(column.alias(into) for into, column in added.items())).schema
    names = [*passed, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(Encoder, path, name)
        for chunk in text_chunks(batches, text, CHUNK):
            offsets, ids = encoder.encode(chunk.column(chunk.schema.get_field_index(text)).to_pylist())
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
            if round_trip:
                columns.append(pa.array(loaded(Decoder, path).decode(offsets, ids), pa.string()))
            yield pa.RecordBatch.from_arrays([*chunk.select(passed).columns, *columns], names)

    return mapped(rest, run, schema)


class Decoder:
    """Texts of ids: the bytes of all ids put together; bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, path: str):
        self.lengths, self.starts, self.letters = Vocabulary(path).flat_bytes()

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        raw = self.letters[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.r_[0, ends][offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``into``; null lists give the empty text."""
    rest = encoded.drop(into)
    schema = rest.select("*", F.lit("").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = loaded(Decoder, path)
        for chunk in text_chunks(batches, ids, IDS):
            lists = chunk.column(chunk.schema.get_field_index(ids))
            offsets = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_pylist()])
            texts = decoder.decode(offsets, lists.flatten().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(texts, pa.string())], [*chunk.schema.names, into])

    return mapped(rest, run, schema)
