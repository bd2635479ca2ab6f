"""Language identification with interpolated Kneser-Ney character models.

A word is a run of letters, lower-cased, with start marks before it and an end mark after
it; each of its characters and its end is an event with the three symbols before it.
Counts of four symbols are gathered over all labelled texts by Spark, the model is
estimated from them with DataFrame operations, and what comes to the driver is the
finished model: a table over the alphabets, not over texts. It is kept in sorted arrays
of hashes and sent to the tasks.

The language is the one with the least cross-entropy per event (ties: the first name). A text
is rejected if its cross-entropy lies above the midpoint between what the model gives to its own language and
to the nearest other one, plus three standard errors for the length of the text.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Rows without
a label are not learned from. Without any labelled text all are ``und``. Characters beyond
U+FFFF share one symbol. Repeated rows are judged each; other columns are kept; input
columns named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import kept, mapped, text_chunks

ORDER = 4
START, END = "\x02", "\x03"
WORD = re.compile(r"[^\W\d_]+")
BEYOND = re.compile("[\U00010000-\U0010ffff]")
KEPT_WORDS = 150_000
STANDARD_ERRORS = 3.0
MODEL_ROWS = 40_000_000  # a model of more rows is refused, not cut
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The packed four-symbol strings of all events in the words, and how many events each word has."""
    joined = START * (ORDER - 1) + (END + START * (ORDER - 1)).join(words) + END
    codes = np.frombuffer(BEYOND.sub("�", joined).encode("utf-16-le"), np.uint16).astype(np.uint64)
    at = np.flatnonzero(codes != ord(START))
    grams = codes[at]
    for back in range(1, ORDER):
        grams |= codes[at - back] << np.uint64(16 * back)
    ends = np.flatnonzero(codes[at] == ord(END))
    return grams, np.diff(np.r_[-1, ends])


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows; words and then grams are summed within a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for name, words in seen.items():
                if not words:
                    continue
                grams, events = _grams(list(words))
                unique, where = np.unique(grams, return_inverse=True)
                n = np.bincount(where, np.repeat(np.fromiter(words.values(), np.float64, len(words)), events))
                yield pa.RecordBatch.from_pydict({"lang": [name] * len(unique), "gram": unique.view(np.int64), "n": n.astype(np.int64)})
            seen.clear()

        for chunk in text_chunks(batches, "text"):
            for value, name in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                seen[name].update(words_of(value))
            if sum(map(len, seen.values())) > KEPT_WORDS:
                yield from rows()
        yield from rows()

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counted = mapped(labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")), count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, order: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * order) - 1))


def estimate(grams: DataFrame) -> DataFrame:
    """Kneser-Ney estimates ``(order, context, lang, gram, value)`` from four-symbol counts.

    Rows of an order hold the discounted share of a string after its context, rows with ``context`` the weight of
    the next lower order after it. The highest order uses counts, lower ones the number of different symbols before
    a string. The discount of an order is n1 / (n1 + 2 n2), or 0.5 where one of them is 0.

    Each order's counts are written once, and the strings of a context come together once, whatever the number of orders: the
    plan has few exchanges, which matters to the driver where each of them has many tasks.
    """
    level, levels = grams, []
    for order in range(ORDER, 0, -1):
        prefix = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
        levels.append(level.select(F.lit(order).alias("order"), "lang", "gram", "n", prefix.alias("after")))
        if order > 1:
            level = kept(level.groupBy("lang", _suffix(F.col("gram"), order - 1).alias("gram")).agg(F.count("*").alias("n")))
    rows = reduce(DataFrame.unionByName, levels)
    once, twice = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
    discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("discount")
    discounts = rows.groupBy("order", "lang").agg(discount)
    # The strings of a context differ in one symbol, so their list is no longer than the alphabet.
    strings = F.collect_list(F.struct("gram", "n")).alias("strings")
    contexts = rows.groupBy("order", "lang", "after").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), strings)
    shares = F.transform("strings", lambda s: F.struct(F.lit(False).alias("context"), s["gram"].alias("gram"), ((s["n"] - F.col("discount")) / F.col("total")).alias("value")))
    weight = F.struct(F.lit(True).alias("context"), F.col("after").alias("gram"), (F.col("discount") * F.col("kinds") / F.col("total")).alias("value"))
    found = contexts.join(F.broadcast(discounts), ["order", "lang"]).select("order", "lang", F.inline(F.concat(shares, F.array(weight))))
    return found.select("order", "context", "lang", "gram", "value")


def _hash(order: int, context: bool, grams: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the packed string, its order and its role; one-to-one within an order and role."""
    x = grams.astype(np.uint64) ^ np.uint64(int(2 * order + bool(context)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted hashes
    values: np.ndarray  # a row for each key, a column for each language; NaN where a language lacks it
    symbols: int  # kinds of symbols seen
    limits: np.ndarray | None = None  # cross-entropy up to which a language is accepted
    spread: np.ndarray | None = None  # standard deviation of an event's bits in the language

    def _find(self, order: int, context: bool, grams: np.ndarray, missing: float) -> np.ndarray:
        wanted = _hash(order, context, grams)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = np.where((self.keys[at] == wanted)[:, None], self.values[at], np.nan)
        return np.where(np.isnan(found), missing, found)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """For each event, -log2 of its probability in each language."""
        mask = lambda order: np.uint64((1 << 16 * order) - 1)
        p = np.full((len(grams), len(self.langs)), 1.0 / (self.symbols + 1))
        for order in range(1, ORDER + 1):
            own = grams & mask(order)
            p = self._find(order, False, own, 0.0) + self._find(order, True, own >> np.uint64(16) if order > 1 else own * 0, 1.0) * p
        return -np.log2(p)

    def word_bits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, its bits in each language, and its number of events."""
        grams, events = _grams(words)
        unique, where = np.unique(grams, return_inverse=True)
        return np.add.reduceat(self.bits(unique)[where], np.cumsum(events) - events, axis=0), events


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """The calibrated model of all labelled rows; None if there are none with a letter."""
    grams = kept(count_grams(docs, text, lang))
    rows = estimate(grams)
    if grams.count() * 2 * ORDER > MODEL_ROWS:
        raise ValueError(f"the model would have over {MODEL_ROWS} rows")
    table = rows.toArrow().to_pandas()
    if not len(table):
        return None
    langs = sorted(table["lang"].unique())
    parts = [_hash(order, context, group["gram"].to_numpy().view(np.uint64)) for (order, context), group in table.groupby(["order", "context"], sort=True)]
    values = [group[["lang", "value"]] for _, group in table.groupby(["order", "context"], sort=True)]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    matrix = np.full((len(keys), len(langs)), np.nan)
    column = np.concatenate([v["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy() for v in values])
    matrix[at, column] = np.concatenate([v["value"].to_numpy() for v in values])
    symbols = table.loc[(table["order"] == 1) & ~table["context"], "gram"].nunique()
    return _calibrated(Model(langs, keys, matrix, int(symbols)), grams)


def _calibrated(model: Model, grams: DataFrame) -> Model:
    """Limits from the bits that each language's events have in each model, summed over all counts."""
    sent = grams.sparkSession.sparkContext.broadcast(model)
    size = len(model.langs)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = sent.value.bits(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            n = batch.column(2).to_numpy(zero_copy_only=False)[:, None].astype(float)
            columns = {"lang": batch.column(0), "n": n[:, 0], "bits": list(bits * n), "squares": list(bits**2 * n)}
            yield pa.RecordBatch.from_pydict(columns)

    total = [F.sum(F.col(name)[i]).alias(f"{name}{i}") for name in ("bits", "squares") for i in range(size)]
    found = mapped(grams.select("lang", "gram", "n"), sums, "lang string, n double, bits array<double>, squares array<double>")
    by = {row["lang"]: row for row in found.groupBy("lang").agg(F.sum("n").alias("n"), *total).collect()}
    mean = np.array([[by[name][f"bits{i}"] / by[name]["n"] for i in range(size)] for name in model.langs])
    own = np.diag(mean)
    square = np.array([by[name][f"squares{i}"] / by[name]["n"] for i, name in enumerate(model.langs)])
    others = mean + np.where(np.eye(size, dtype=bool), np.inf, 0)
    nearest = others.min(axis=0) if size > 1 else np.full(1, np.log2(model.symbols + 1.0))
    model.limits = (own + np.maximum(nearest, own)) / 2
    model.spread = np.sqrt(np.maximum(square - own**2, 0))
    return model


class Judge:
    """Judges texts; keeps the bits of words between chunks, at most ``KEPT_WORDS`` and one chunk's."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.bits = np.zeros((0, len(self.model.langs)))
        self.events = np.zeros(0, np.int64)

    def judge(self, texts: list[str | None]) -> dict[str, list]:
        words = [words_of(text) for text in texts]
        if len(self.number) > KEPT_WORDS:
            self._forget()
        new = list(set().union(*words) - self.number.keys())
        if new:
            bits, events = self.model.word_bits(new)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.bits, self.events = np.r_[self.bits, bits], np.r_[self.events, events]
        out: dict[str, list] = {"lang_pred": [], "score": [], "accepted": [], "bits_per_event": []}
        for text, own in zip(texts, words):
            if not own or not any(map(str.isalpha, text)):
                row = (UNKNOWN, 0.0, False, None)
            else:
                at = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
                events = int(self.events[at].sum())
                entropy = self.bits[at].sum(axis=0) / events
                best = int(np.argmin(entropy))
                # The share of the language if the text counted as the root of its events.
                score = 1 / np.exp2((entropy[best] - entropy) * np.sqrt(events)).sum()
                limit = self.model.limits[best] + STANDARD_ERRORS * self.model.spread[best] / np.sqrt(events)
                row = (self.model.langs[best], float(score), bool(entropy[best] <= limit), float(entropy[best]))
            for column, value in zip(out.values(), row):
                column.append(value)
        return out


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``accepted`` and ``bits_per_event`` (the least cross-entropy)."""
    names = ["lang_pred", "score", "accepted", "bits_per_event"]
    rest = docs.drop(*names)
    added = "lang_pred string, score double, accepted boolean, bits_per_event double"
    if model is None:
        empty = [F.lit(UNKNOWN), F.lit(0.0), F.lit(False), F.lit(None).cast("double")]
        return rest.drop(*[] if keep_text else [text]).withColumns(dict(zip(names, empty)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passed = [name for name in rest.columns if keep_text or name != text]
    schema = ", ".join([*(f"`{name}` {rest.schema[name].dataType.simpleString()}" for name in passed), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(sent.value)
        for chunk in text_chunks(batches, text):
            found = judge.judge(chunk.column(chunk.schema.get_field_index(text)).to_pylist())
            kinds = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]
            arrays = [pa.array(values, kind) for values, kind in zip(found.values(), kinds)]
            yield pa.RecordBatch.from_arrays([*chunk.select(passed).columns, *arrays], [*passed, *names])

    return mapped(rest, run, schema)
