"""Prefix trie of conversations on minimal-perfect-hash node tables.

A conversation is its sequence of turns (role, text); each distinct sequence of the first d turns is a node, the empty one
the root. A turn is known by 128 bits of its SHA-256, a prefix by a 128-bit hash of the digests of its turns in order.

Conversations with equal sequences are counted first and then are one path. Prefix digests of all paths are enumerated, each with the
smallest member: a node is owned by the path of that one, so what must be counted once per node is counted there only. Paths
are put in trie order by range partitions; so a first turn that a third of all conversations share is cut into many ranges. A task takes its paths in shards of
about ``SHARD`` nodes: the shard's distinct digests get gapless slots by a minimal perfect hash, whose answers
are verified against the stored digests; counts are scattered into flat arrays by slot, and accumulated through the parents' slots from
the deepest level up. Nodes that lie in several shards are added up by digest at the end, as all figures are sums.

The conv_ids that end in a node are hashed in order in two steps: tasks over ranges of (node, conv_id) give texts of up to
``CHUNK`` ids, and only these are put in order for a node.

Null role and text count as empty. Turns stand by number, null first; turns of the same number by digest, repeated rows are turns of
their own. Rows without a conv_id belong to no conversation and are left out. The digests of one conversation (24 bytes a turn) are one row.
Texts are hashed whole. An empty table has no nodes. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import mapped, text_chunks, written

SHARD = 1 << 17
CHUNK = 4096
SIZE = 16  # bytes of a digest
ROOT = bytes(SIZE)


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.substring(whole, 1, 2 * SIZE))


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: the digests and last-text bytes of each conversation's turns, in order."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    one = F.struct(F.col(turn).alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"), size.alias("bytes"))
    rows = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), one.alias("one"))
    # Structs are sorted with null first.
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return listed.select("conv_id", F.transform("all", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def branched(found: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt to share openings: the first h turns of conversation c - c % ``every``, then c's own after its first h.

    h is the CRC-32 of the decimal conv_id modulo ``most``; a conversation that is not there has no turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own = found.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    heads = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("head").isNull() | (F.col("h") == 0), none).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1))))
    return own.join(heads, "base", "left").select("conv_id", F.when(F.size("turns") > F.col("h"), F.concat(head, rest)).otherwise(head).alias("turns"))


def chained(digests: list[bytes]) -> bytes:
    """The digests of all prefixes of a sequence, one after the other; the empty prefix is left out."""
    out, last = [], ROOT
    for digest in digests:
        last = hashlib.blake2b(last + digest, digest_size=SIZE).digest()
        out.append(last)
    return b"".join(out)


def paths(found: DataFrame) -> DataFrame:
    """``(conv_id, end, path, bytes)``: the digest of the whole sequence, those of all its prefixes, and bytes by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "digests", 1 << 16):
            chains = [chained(digests) for digests in batch.column("digests").to_pylist()]
            ends = [chain[-SIZE:] or ROOT for chain in chains]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(ends, pa.binary()), pa.array(chains, pa.binary()), batch.column("bytes")], ["conv_id", "end", "path", "bytes"]
            )

    rows = found.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.bytes").alias("bytes"))
    return mapped(rows, run, "conv_id long, end binary, path binary, bytes array<long>")


class PerfectHash:
    """Gapless slots for distinct 128-bit keys: keys that stand alone in a level's bit table stay there, the others go to the next.

    A key's slot is the number of set bits before its own. :meth:`slots` compares the stored keys, so
    a key that is not in the table gets -1.
    """

    def __init__(self, keys: np.ndarray):
        """``keys``: rows of two unsigned 64-bit numbers, distinct."""
        self.levels, offset, rest = [], 0, keys
        self.keys = np.empty_like(keys)
        while len(rest):
            width = max(64, 2 * len(rest))
            at = self._place(rest, len(self.levels), width)
            alone = np.bincount(at, minlength=width)[at] == 1
            taken = np.zeros(width, bool)
            taken[at[alone]] = True
            ranks = np.cumsum(taken) - 1 + offset
            self.levels.append((width, taken, ranks))
            self.keys[ranks[at[alone]]] = rest[alone]
            offset += int(alone.sum())
            rest = rest[~alone]

    @staticmethod
    def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(31)) % np.uint64(width)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (width, taken, ranks) in enumerate(self.levels):
            at = self._place(keys[left], level, width)
            here = taken[at]
            slot = ranks[at[here]]
            same = (self.keys[slot] == keys[left[here]]).all(axis=1)
            found[left[here][same]] = slot[same]
            left = left[~here]
        return found


def node_table(chains: list[bytes], counts: list[int], convs: list[int], sizes: np.ndarray, owned_from: list[int], childless: list[bool]) -> dict[str, np.ndarray]:
    """The nodes of a shard of paths with their sums; ``sizes`` are the bytes of all turns of all paths in order.

    ``owned_from`` is the depth from which a path owns its nodes, ``childless`` whether it owns its last one and nothing continues it.
    """
    lengths = np.array([len(chain) // SIZE for chain in chains], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1  # each path begins with the root
    keys = np.frombuffer(b"".join(ROOT + chain for chain in chains), np.uint64).reshape(-1, 2)
    path = np.repeat(np.arange(len(chains)), lengths + 1)
    at = np.arange(len(keys)) - starts[path]
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(axis=1)]
    table = PerfectHash(keys[order[new]])
    slot = table.slots(keys)
    n = len(table.keys)
    assert (slot >= 0).all() and n == int(new.sum())
    depth, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    parent = np.full(n, -1, np.int64)
    depth[slot] = at
    below = at > 0
    size[slot[below]] = sizes
    parent[slot[below]] = slot[np.flatnonzero(below) - 1]
    smallest = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(smallest, slot, np.array(convs, np.int64)[path])
    own = np.zeros(n, np.int64)
    owners = np.array(owned_from, np.int64)
    own[slot[at >= owners[path]]] = 1
    ends = slot[starts + lengths]
    passing, leaves = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(passing, ends, np.array(counts, np.int64))
    np.add.at(leaves, ends, np.array(childless, np.int64))
    children = np.zeros(n, np.int64)
    np.add.at(children, parent[parent >= 0], own[parent >= 0])
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1))
    levels = np.split(order, cuts)
    for level in reversed(levels[1:]):
        np.add.at(passing, parent[level], passing[level])
        np.add.at(leaves, parent[level], leaves[level])
    saved = (passing - own) * size
    for level in reversed(levels[1:]):
        np.add.at(saved, parent[level], saved[level])
    return {"key": table.keys, "parent": parent, "depth": depth, "conv_id": smallest, "n_convs": passing, "n_children": children, "n_leaves": leaves, "saved": saved}


def _tabled(rows: DataFrame) -> DataFrame:
    """Partial sums of the nodes of each shard; ``rows`` are paths in trie order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def closed() -> pa.RecordBatch:
            part = pa.Table.from_batches(held)
            sizes = part.column("bytes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            columns = {c: part.column(c).to_pylist() for c in ("path", "n", "conv_id", "owned_from", "childless")}
            nodes = node_table(columns["path"], columns["n"], columns["conv_id"], sizes, columns["owned_from"], columns["childless"])
            raw = np.ascontiguousarray(nodes.pop("key")).tobytes()
            digests = [raw[i : i + SIZE] for i in range(0, len(raw), SIZE)]
            parents = nodes.pop("parent").tolist()
            up = [digests[p] if p >= 0 else None for p in parents]
            return pa.RecordBatch.from_pydict({"node": pa.array(digests, pa.binary()), "up": pa.array(up, pa.binary()), **nodes})

        for batch in text_chunks(batches, "bytes", SHARD):
            held.append(batch)
            size += batch.num_rows + len(batch.column("bytes").flatten())
            if size > SHARD:
                yield closed()
                held, size = [], 0
        if held:
            yield closed()

    schema = "node binary, up binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long"
    return mapped(rows, run, schema)


def _end_lists(found: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: the hash of the conv_ids that end in each node, ascending and joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def closed(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string()))], ["node", "first", "ids"])

        for batch in batches:
            rows = []
            for end, conv in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (end != node or len(ids) >= CHUNK):
                    rows.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = end
                ids.append(conv)
            if rows:
                yield closed(rows)
        if ids:
            yield closed([(node, ids[0], ",".join(map(str, ids)))])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for end, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if end == node:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = end, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ranged = found.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    pieces = mapped(ranged, chunks, "node binary, first long, ids string")
    return mapped(pieces.repartition("node").sortWithinPartitions("node", "first"), hashes, "node binary, ends_sha256 string")


def trie(found: DataFrame) -> DataFrame:
    """One row for each node over ``found`` (conv_id, turns), as :func:`sequences` gives them; see the module's text.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` and ``node``, the digest.
    """
    every = written(paths(found))
    distinct = written(every.groupBy("end").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), F.first("bytes").alias("bytes")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, chain in zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist()):
                keys = np.frombuffer(ROOT + chain, np.int64).reshape(-1, 2)
                depth = np.arange(len(keys))
                yield pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(keys[:, 0]), "b": np.ascontiguousarray(keys[:, 1]), "conv_id": np.full(len(keys), conv), "depth": depth, "more": depth < len(keys) - 1})

    listed = mapped(distinct.select("conv_id", "path"), prefixes, "a long, b long, conv_id long, depth long, more boolean")
    owners = listed.groupBy("a", "b").agg(F.min("conv_id").alias("owner"), F.min("depth").alias("depth"), F.max("more").alias("more"))
    owned = owners.groupBy("owner").agg(F.min("depth").alias("owned_from"), F.max(~F.col("more")).alias("childless"))
    none = F.lit(1 << 62).cast("long")
    rows = distinct.join(owned, distinct["conv_id"] == owned["owner"], "left").select(
        "end", "n", "conv_id", "path", "bytes", F.coalesce("owned_from", none).alias("owned_from"), F.coalesce("childless", F.lit(False)).alias("childless")
    )
    opening = F.substring("path", 1, 8 * SIZE)  # the rest of a path has no part in the order, but its end tells equal openings apart
    ranged = written(rows).repartitionByRange(opening, "end").sortWithinPartitions(opening, "end")
    parts = _tabled(ranged)
    nodes = written(
        parts.groupBy("node").agg(
            F.first("up").alias("up"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")),
        )
    )
    above = nodes.where("n_children > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    ends = _end_lists(every).withColumnRenamed("node", "end_node")
    whole = nodes.join(above, F.col("up") == F.col("above"), "left").join(ends, F.col("node") == F.col("end_node"), "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "node",
    )
