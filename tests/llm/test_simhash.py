import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerscope.llm import simhash
from ledgerscope.llm.components import components


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(shingles))


def classes_of(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_fingerprint():
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É b\x0bc\x0cd e é", "a b c d e f", "x y z " * 40]
    for text in texts:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components(spark):
    pick = random.Random(3)
    path = [(i, i + 1) for i in range(60)]
    pairs = path + [(pick.randrange(100, 200), pick.randrange(100, 200)) for _ in range(60)] + [(500, i) for i in range(300, 340)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    expected = classes_of([p for p in pairs if p[0] != p[1]], nodes)
    assert set(found) == nodes
    assert len({(expected[n], found[n]) for n in nodes}) == len(set(expected.values())) == len(set(found.values()))
    assert all(expected[found[n]] == expected[n] for n in nodes)


def test_links_lose_nothing(spark, monkeypatch):
    pick = random.Random(9)
    fps = [pick.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    for base in fps[:40]:  # near ones, up to four bits off
        for _ in range(4):
            fps.append(base ^ sum(1 << b for b in pick.sample(range(64), pick.randrange(1, 5))))
    dense = pick.getrandbits(64)
    fps += [dense ^ i for i in range(128)]
    fps = sorted(set(fps))
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3]
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    expected = classes_of(pairs, fps)
    for cell in (2048, 16):  # also with keys dealt into cells
        monkeypatch.setattr(simhash, "CELL", cell)
        found = [(r["u"] % 2**64, r["v"] % 2**64) for r in simhash.links(table).collect()]
        assert classes_of(found, fps) == expected


def test_odd_documents(odd_documents, no_documents):
    rows = simhash.classes(odd_documents).collect()
    assert len(rows) == 10
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert {c for (d, _), c in by.items() if d in (2, 3, 8)} == {2}  # no words: fingerprint zero
    assert {c for (d, _), c in by.items() if d in (1, 5)} == {1}
    assert simhash.classes(no_documents).count() == 0
    left = simhash.one_of_each(odd_documents)
    assert left.columns == odd_documents.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, 1), (False, 2), (False, 4), (False, 7), (False, 9), (True, 0)]


def test_one_of_each_with_clashing_names_and_ties(spark):
    rows = [(1, "a b c d", 7, "x"), (1, "a b c d", 8, "y"), (2, "a b c d", 1, "z"), (3, "quite another text of words", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_a long, KEY_B string")
    for order in (docs, docs.orderBy(F.desc("key_a")).coalesce(1)):
        left = simhash.one_of_each(order)
        assert left.columns == docs.columns
        found = sorted(left.collect())
        assert [r["doc_id"] for r in found] == [1, 3]
        assert found == sorted(simhash.one_of_each(docs).collect())


def test_query_equals_brute_force(spark):
    from ledgerscope.llm.queries import QUERIES

    rows = QUERIES["op7_simhash_pivots"].build(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in docs.items()}
    pairs = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = classes_of(pairs, docs)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(d, f"{prints[d]:016x}", expected[d]) for d in docs}


def test_components_of_a_long_path(spark):
    """Many rounds; their plans must not grow from round to round."""
    from ledgerscope.llm.components import components

    edges = spark.range(3000).selectExpr("id as u", "id + 1 as v").where("u % 1000 <> 999")
    label = components(edges)
    assert label.groupBy("component").count().where("count = 1000").count() == 3
