import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import ngram_join


def shingles(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plainly(rows, percent=80):
    """All pairs that share a shingle."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, own in enumerate(sets):
        common = defaultdict(int)
        for shingle in own:
            for j in holders[shingle]:
                common[j] += 1
            holders[shingle].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                root[top(i)] = top(j)
    names = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        names[top(i)].append(doc_id)
    for i, (doc_id, _) in enumerate(rows):
        yield doc_id, len(sets[i]), min((n for n in names[top(i)] if n is not None), default=None) if sets[i] else doc_id


def same(docs, percent=80):
    found = ngram_join.classes(docs, percent=percent).collect()
    expected = list(plainly([tuple(row) for row in docs.select("doc_id", "text").collect()], percent))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    return expected


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = same(docs)
    assert len({e[2] for e in expected}) < len(expected)


def test_odd_documents(odd_documents):
    same(odd_documents.withColumns({"key_a": F.lit(1), "size": F.lit(2), "tile": F.lit("t"), "words": F.lit("w"), "id": F.lit(4), "label": F.lit(5), "mark": F.lit(6)}))


def test_no_documents(no_documents):
    assert ngram_join.classes(no_documents).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_edits_around_the_limit(spark, percent):
    """Copies with one to many words changed, and with words taken off the ends."""
    random = np.random.default_rng(5)
    base = [[f"w{x}" for x in random.integers(0, 500, size)] for size in (5, 6, 9, 30, 60, 200)]
    rows = []
    for words in base:
        rows.append(" ".join(words))
        for changes in range(1, 12):
            copy = list(words)
            for at in random.integers(0, len(words), changes):
                copy[at] = f"x{random.integers(0, 50)}"
            rows.append(" ".join(copy))
            rows.append(" ".join(words[: len(words) - changes]) or "one")
    same(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), percent)


def test_a_crowd_of_near_copies_and_a_common_passage(spark):
    """Over a block of near copies, and over a block of documents that share a passage but do not link."""
    random = np.random.default_rng(6)
    base = [f"b{i}" for i in range(60)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for i in range(2600):
        copy = list(base)
        copy[int(random.integers(0, 60))] = f"y{random.integers(0, 300)}"
        rows.append(" ".join(copy) if i % 2 else f"{passage} " + " ".join(f"o{random.integers(0, 400)}" for _ in range(6 + i % 9)))
    expected = same(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert max(np.bincount([e[2] for e in expected])) > ngram_join.BLOCK


def test_crowded_tiles_grow_with_their_rows(spark, monkeypatch):
    """Near copies in tiles of many blocks: the rows dealt to cells stay near those of the tiles, and the result is whole."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "TILE", 16, raising=False)
    random = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(320):
        copy = list(base)
        copy[int(random.integers(0, 120))] = f"y{i}"
        rows.append((i, " ".join(copy) if i < 300 else " ".join(base[:20]) + f" o{i} " + " ".join(f"q{i % 4}r{k}" for k in range(25))))
    dealt, cells = [], ngram_join._cells

    def counted(rows, *args, **named):
        out = cells(rows, *args, **named)
        dealt.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "_cells", counted)
    same(spark.createDataFrame(rows, "doc_id long, text string"))
    assert dealt[0][0] > 3000 and sum(out for _, out in dealt) < 3 * dealt[0][0]


def test_signatures_bound_the_overlap():
    random = np.random.default_rng(7)
    for size in (1, 3, 20, 300, 5000):
        a = np.unique(random.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.r_[a[: size // 2 + 1], random.integers(0, 2**63, size).astype(np.uint64)])
        wide = ngram_join.places(np.array([len(a), len(b)]))
        marks = ngram_join.signatures(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], wide)
        least = int(min(wide)) // 64
        folded = [np.bitwise_xor.reduce(mark.reshape(-1, least), axis=0) for mark in marks]
        assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= len(np.setxor1d(a, b))


def test_words_are_cut_and_lowered_by_ascii_rules():
    texts = ["A b C\x0bd\x1fe f", "É É", "", None, " a  b\tc\nd e F g "]
    row, hashes = ngram_join.shingle_sets(pa.array(texts), 5)
    assert np.bincount(row, minlength=5).tolist() == [len(shingles(t)) for t in texts]
    assert len(np.unique(hashes)) == sum(len(shingles(t)) for t in texts)
