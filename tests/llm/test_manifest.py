import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import manifest

COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]


def joined(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plainly(rows):
    """The same by lists of hashes, one tree after the other."""

    def leaf(row, text):
        return joined(*map(field, (row[0], row[2], row[3], row[4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([joined(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    leaves = []
    for row in rows:
        hit = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        leaves.append((row[2], row[0], leaf(row, row[1]), leaf(row, row[1].replace("\n", "") if hit else row[1])))
    leaves.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2]))
    trees = [list(group) for _, group in groupby(leaves, key=lambda x: x[0])]
    below = [levels([x[2] for x in tree]) for tree in trees]
    above = levels([tree[-1][0] for tree in below])
    for number, tree in enumerate(trees):
        for at, (_, doc_id, own, used) in enumerate(tree):
            others = []
            for stack, place in ((below[number], at), (above, number)):
                for nodes in stack[:-1]:
                    run, digit = nodes[place // 3 * 3 : place // 3 * 3 + 3], place % 3
                    others += run[:digit] + run[digit + 1 :]
                    used = joined(*run[:digit], used, *run[digit + 1 :])
                    place //= 3
            root = above[-1][0]
            yield doc_id, own, below[number][-1][0], root, joined(*others), used, used == root


def same(docs):
    found = sorted(map(repr, map(tuple, manifest.tampering(docs).collect())))
    assert found == sorted(map(repr, plainly([tuple(row) for row in docs.select(COLUMNS).collect()])))
    return found


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_all_documents(documents):
    assert len(same(documents)) == 200


def test_nulls_ties_and_repeated_rows(documents):
    none = lambda name: documents.limit(4).withColumn(name, F.lit(None).cast(dict(documents.dtypes)[name]))
    odd = documents.limit(30).union(documents.limit(5))
    for name in documents.columns:
        odd = odd.union(none(name))
    same(odd.withColumns({"tree": F.lit(1), "rank": F.lit("x"), "leaf": F.lit("y"), "m_source": F.lit(2), "path": F.lit("p"), "k_doc_id": F.lit(3), "root": F.lit(4)}))


def test_several_rounds_of_blocks(spark):
    """A hot source of more than a block of blocks would be large; here one of more than a block, and more sources than a block holds."""
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("a\nb"), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("source"),
        F.lit("en").alias("lang"),
        F.lit(3).cast("long").alias("n_chars"),
    )
    same(rows)


def test_three_rounds_of_blocks(spark):
    """More leaves than two rounds hold: the plain way for the root, and all proofs lead to it."""
    leaves = spark.range(manifest.WIDTH**2 + 10).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    built = manifest.manifest(leaves, "source", "doc_id", "leaf", ["doc_id"])
    nodes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(manifest.WIDTH**2 + 10)]
    while len(nodes) > 1:
        nodes = [joined(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    proofs = manifest.verified(built.proofs(built.leaves.where("rank % 1000 = 7")), "leaf")
    assert proofs.count() == 532
    assert [row[0].hex() for row in proofs.select("folded").distinct().collect()] == nodes


def test_no_documents(documents):
    assert manifest.tampering(documents.limit(0)).collect() == []


def test_a_proof_fails_for_another_leaf():
    nodes = [hashlib.sha256(bytes([i])).digest() for i in range(7)]
    stack = manifest.stacked(b"".join(nodes), manifest.levels_over(7))
    paths, lowest = manifest.paths_below(stack, 7, manifest.levels_over(7), b"")
    assert lowest == b"".join(nodes)
    assert {manifest.fold(node, path) for node, path in zip(nodes, paths)} == {stack[-32:]}
    assert manifest.fold(nodes[1], paths[0]) != stack[-32:]
