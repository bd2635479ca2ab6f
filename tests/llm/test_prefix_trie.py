import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerscope.llm import prefix_trie


def plainly(rows):
    """The same by dictionaries of prefixes."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            turns[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {conv: [t[2] for t in sorted(own)] for conv, own in turns.items()}
    members, whole = defaultdict(list), {}
    for conv in turns:
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5 if conv >= 0 else -(abs(conv) % 5))
        whole[conv] = tuple(turns.get(base, [])[:h] + turns[conv][h:])
        for depth in range(len(whole[conv]) + 1):
            members[whole[conv][:depth]].append(conv)
    below = defaultdict(set)
    for node in members:
        if node:
            below[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[n] for n in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[n] for n in below[node])
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        yield min(own), len(node), parent, len(own), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()


def same(turns):
    found = prefix_trie.trie(prefix_trie.branched(prefix_trie.sequences(turns))).drop("node").collect()
    expected = list(plainly([tuple(row) for row in turns.select("conv_id", "turn", "role", "text").collect()]))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    return expected


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")


def test_all_conversations(turns):
    assert same(turns)


def test_nulls_ties_repeated_rows_and_other_columns(turns):
    none = lambda name: turns.limit(5).withColumn(name, F.lit(None).cast(dict(turns.dtypes)[name]))
    odd = turns.union(turns.limit(6))
    for name in turns.columns:
        odd = odd.union(none(name))
    odd = odd.union(turns.where("conv_id < 4").withColumn("conv_id", F.col("conv_id") + 5000)).union(turns.limit(3).withColumn("conv_id", -F.col("conv_id") - 7))
    odd = odd.union(turns.limit(1).withColumns({"conv_id": F.lit(9001).cast("long"), "text": F.lit("long " * 200_000)}))
    same(odd.withColumns({"node": F.lit(1), "path": F.lit("x"), "end": F.lit("y"), "turns": F.lit(2), "n": F.lit(3), "up": F.lit("z"), "bytes": F.lit(0)}))


def test_hot_first_turn_copies_and_turnless_conversations(spark):
    """A third of all conversations share their first turn, a third are equal; conversations of one turn lose it where h is over 0 and no base is there."""
    turn = spark.range(4).select(F.col("id").alias("turn"))
    rows = spark.range(900).crossJoin(turn).select(
        F.col("id").alias("conv_id"), "turn", F.lit("user").alias("role"),
        F.when(F.col("id") % 3 == 0, F.concat_ws(" ", F.lit("same"), "turn"))
        .when((F.col("id") % 3 == 1) & (F.col("turn") == 0), F.lit("hello"))
        .otherwise(F.concat_ws(" ", F.col("id") % 40, "turn")).alias("text"),
    )
    rows = rows.where("conv_id % 5 <> 2 or turn = 0").where("conv_id % 35 <> 0")
    expected = same(rows)
    assert any(e[1] == 0 and e[7] != hashlib.sha256().hexdigest() for e in expected)


def test_no_conversations(turns):
    assert prefix_trie.trie(prefix_trie.sequences(turns.limit(0))).collect() == []


@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=300))
def test_slots_are_gapless_and_strangers_have_none(keys):
    table = prefix_trie.PerfectHash(np.array(sorted(keys), np.uint64).reshape(-1, 2))
    assert sorted(table.slots(np.array(sorted(keys), np.uint64).reshape(-1, 2)).tolist()) == list(range(len(keys)))
    assert (table.slots(np.array([[a, 7] for a, _ in keys], np.uint64).reshape(-1, 2)) == -1).all()


def test_shards_add_up():
    """Paths cut into two tables give the sums of one."""
    chains = [prefix_trie.chained([bytes([x]) * 16 for x in path]) for path in ([1], [1, 2], [1, 2, 3], [1, 4], [5])]
    sizes, counts, convs, owned, childless = [[10], [10, 20], [10, 20, 30], [10, 40], [50]], [1, 2, 1, 1, 3], [3, 2, 1, 4, 5], [9, 9, 0, 2, 1], [0, 0, 1, 1, 1]

    def total(parts):
        out = defaultdict(lambda: np.zeros(4, np.int64))
        for part in parts:
            nodes = prefix_trie.node_table(
                [chains[i] for i in part], [counts[i] for i in part], [convs[i] for i in part],
                np.concatenate([sizes[i] for i in part]), [owned[i] for i in part], [childless[i] for i in part],
            )
            for i, key in enumerate(nodes["key"]):
                out[key.tobytes()] += [nodes[c][i] for c in ("n_convs", "n_children", "n_leaves", "saved")]
        return {key: value.tolist() for key, value in out.items()}

    whole = total([range(5)])
    assert whole == total([[0, 2], [1, 3, 4]])
    assert whole[prefix_trie.ROOT] == [8, 2, 3, 4 * 10 + 2 * 20 + 2 * 50]
