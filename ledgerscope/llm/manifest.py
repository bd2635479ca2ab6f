"""Merkle manifest of a dataset: a tree for each source, a tree over the sources, and a proof for every row.

A digest is the SHA-256 of joined texts, digests as lowercase hex. A source's leaves stand in order of
doc_id; while there is more than one node, every ``FAN`` consecutive ones become their digest (the last run may be
shorter, even one). The last node is the source's subroot, a lone leaf itself. The subroots, in order of the source,
become the root the same way.

Leaves get their rank by range partitions and the counts before them, so a source with a third of all rows is spread
over many tasks. ``HEIGHT`` levels are built at once: a task hashes blocks of ``WIDTH`` consecutive nodes and stores for the top digest of a block
its children, level by level. A proof is found by descent from the root: each step looks the open digests up among
the records, follows the digits of the ranks asked for, and collects the children that are not followed. Segments come from the root
down and are put in front of each other, so that a path reads from the leaf up. Requests below the same node share the descent; only
the last step, of bounded blocks, meets the requests themselves.

Null fields count as ``-``. A null source is a source of its own and the first; null doc_ids come first. Rows with equal doc_id stand in order of
their leaf; repeated rows are leaves of their own with proofs of their own. Texts are hashed whole. An empty table has no root and no
rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import kept, mapped, written

FAN = 3
HEIGHT = 6
WIDTH = FAN**HEIGHT
SIZE = 32  # bytes of a digest


def joined(*fields: Column) -> Column:
    """The fields as one text: ``-`` for null, else the byte count, ``:`` and the value."""
    texts = [field.cast("string") for field in fields]
    return F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def parent(children: bytes) -> bytes:
    return hashlib.sha256(children.hex().encode()).digest()


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that ``leaf`` and the siblings on its path give."""
    at = 0
    while at < len(path):
        before, count = path[at], path[at + 1]
        siblings = path[at + 2 : at + 2 + count * SIZE]
        leaf = parent(siblings[: before * SIZE] + leaf + siblings[before * SIZE :])
        at += 2 + count * SIZE
    return leaf


def siblings(path: bytes) -> bytes:
    """The digests on a path, from the leaf up and left to right."""
    found, at = [], 0
    while at < len(path):
        stop = at + 2 + path[at + 1] * SIZE
        found.append(path[at + 2 : stop])
        at = stop
    return b"".join(found)


def stacked(nodes: bytes, levels: int) -> bytes:
    """The digests of ``levels`` levels over ``nodes``, the lowest first."""
    stack = [nodes]
    for _ in range(levels):
        below, step = stack[-1], FAN * SIZE
        stack.append(b"".join(parent(below[i : i + step]) for i in range(0, len(below), step)))
    return b"".join(stack)


def levels_over(count: int) -> int:
    """How many levels bring ``count`` nodes down to one."""
    levels = 0
    while count > 1:
        count, levels = -(-count // FAN), levels + 1
    return levels


def paths_below(stack: bytes, width: int, levels: int, above: bytes) -> tuple[list[bytes], bytes]:
    """The paths of the ``width`` lowest nodes of a stack, by descent from its top, and those nodes."""
    starts, counts = [0], [width]
    for _ in range(levels):
        starts.append(starts[-1] + counts[-1] * SIZE)
        counts.append(-(-counts[-1] // FAN))
    open_paths = [above]
    for level in range(levels - 1, -1, -1):
        nodes = stack[starts[level] : starts[level] + counts[level] * SIZE]
        below = []
        for i in range(counts[level]):
            digit, first = i % FAN, i // FAN * FAN * SIZE
            run = nodes[first : first + FAN * SIZE]
            others = run[: digit * SIZE] + run[digit * SIZE + SIZE :]
            below.append(bytes((digit, len(others) // SIZE)) + others + open_paths[i // FAN])
        open_paths = below
    return open_paths, stack[: width * SIZE]


@dataclass
class Tree:
    """Stored records of one or many trees: ``rounds[r]`` holds those of ``HEIGHT`` levels, by the top digest of each block."""

    rounds: list[DataFrame]  # tree, block, n (nodes of the tree below), width, levels, digest, stack

    def tops(self) -> DataFrame:
        """``(tree, digest, round)``, one row a tree."""
        found = [r.where(F.col("n") <= WIDTH).select("tree", "digest", F.lit(i).alias("round")) for i, r in enumerate(self.rounds)]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out


def _rows_sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Records of the next levels over ``nodes`` (tree, rank, digest, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; a block holds ``WIDTH`` nodes at most."""
        key, n, held, done, size = None, 0, [], [], 0

        def closed():
            levels = min(levels_over(n), HEIGHT)
            stack = stacked(b"".join(held), levels)
            return (*key, n, len(held), levels, stack[-SIZE:], stack)

        def batch(rows):
            names = ["tree", "block", "n", "width", "levels", "digest", "stack"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for part in batches:
            for tree, block, own, count in zip(*(part.column(c).to_pylist() for c in ("tree", "block", "digest", "n"))):
                if (tree, block) != key:
                    if key is not None:
                        done.append(closed())
                        size += len(done[-1][-1])
                        if size > 4 << 20 or len(done) > 5000:
                            yield batch(done)
                            done, size = [], 0
                    key, n, held = (tree, block), count, []
                held.append(own)
        if key is not None:
            yield batch([*done, closed()])

    rows = nodes.select("tree", F.expr(f"rank div {WIDTH}").alias("block"), "rank", "digest", "n")
    return mapped(_rows_sorted(rows, "rank"), run, "tree long, block long, n long, width int, levels int, digest binary, stack binary")


def build(nodes: DataFrame, most: int) -> Tree:
    """The records over ``nodes`` (tree, rank from 0 without gaps, digest, n); ``most`` is the largest n."""
    rounds = []
    while True:
        rounds.append(written(_blocks(nodes)))
        if most <= WIDTH:
            return Tree(rounds)
        more = F.expr(f"(n + {WIDTH - 1}) div {WIDTH}")
        nodes = rounds[-1].where(F.col("n") > WIDTH).select("tree", F.col("block").alias("rank"), "digest", more.alias("n"))
        most = -(-most // WIDTH)


OPEN = ["tree", "place", "digest", "path", "subroot", "root"]
OPEN_SCHEMA = "tree long, place long, digest binary, path binary, subroot binary, root binary"


def _looked_up(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The open nodes with what is stored under their digests."""
    children = records.select("digest", "width", "levels", "stack").dropDuplicates(["digest"])
    return frontier.join(children, "digest").select(*OPEN, "width", "levels", "stack")


def _descended(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The open nodes ``HEIGHT`` levels further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                paths, nodes = paths_below(row["stack"], row["width"], row["levels"], row["path"])
                n = len(paths)
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([row["tree"]] * n, pa.int64()),
                    "place": pa.array(range(row["place"] * WIDTH, row["place"] * WIDTH + n), pa.int64()),
                    "digest": pa.array([nodes[i : i + SIZE] for i in range(0, len(nodes), SIZE)], pa.binary()),
                    "path": pa.array(paths, pa.binary()),
                    "subroot": pa.array([row["subroot"]] * n, pa.binary()),
                    "root": pa.array([row["root"]] * n, pa.binary()),
                })

    return mapped(_looked_up(frontier, records), run, OPEN_SCHEMA)


@dataclass
class Manifest:
    """Leaves with their places, and the records of the trees of all sources and of the tree over them."""

    leaves: DataFrame  # tree, rank, leaf and the columns kept
    sources: Tree
    top: Tree
    kept_columns: list[str]

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """``leaf, subroot, root, path`` and the kept columns for ``requests``, rows of ``leaves`` (all if None)."""
        requests = self.leaves if requests is None else requests
        if not self.top.rounds:
            return requests.select(*self.kept_columns, "leaf", *(F.lit(None).cast("binary").alias(c) for c in ("subroot", "root", "path")))
        none = F.lit(None).cast("binary")
        front = self.top.tops().select("tree", F.lit(0).cast("long").alias("place"), "digest", F.lit(b"").alias("path"), none.alias("subroot"), F.col("digest").alias("root"))
        for records in reversed(self.top.rounds):
            front = _descended(front, records)
        round_of = self.sources.tops().select("tree", "round")
        entered = front.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"), "digest", "path", F.col("digest").alias("subroot"), "root")
        entered = kept(entered.join(round_of, "tree"))
        front = None
        for number in range(len(self.sources.rounds) - 1, -1, -1):
            new = entered.where(F.col("round") == number).select(OPEN)
            front = new if front is None else front.union(new)
            if number:
                front = kept(_descended(front, self.sources.rounds[number]))
        return self._met(_looked_up(front, self.sources.rounds[0]), requests)

    def _met(self, blocks: DataFrame, requests: DataFrame) -> DataFrame:
        """The last step: the lowest blocks, each followed by the requests for its leaves."""
        data = F.struct(*(F.col(c) for c in [*self.kept_columns, "leaf"]))
        of_block = F.struct("path", "subroot", "root", "width", "levels", "stack")
        kinds = requests.select(data.alias("asked")).schema["asked"].dataType, blocks.select(of_block.alias("b")).schema["b"].dataType
        rows = blocks.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("rank"), of_block.alias("stored"), F.lit(None).cast(kinds[0]).alias("asked"))
        asked = requests.select("tree", F.expr(f"rank div {WIDTH}").alias("block"), "rank", F.lit(None).cast(kinds[1]).alias("stored"), data.alias("asked"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            paths, nodes, block = [], b"", None
            for batch in batches:
                chosen, out = [], {"path": [], "subroot": [], "root": []}
                for i, (rank, stored) in enumerate(zip(batch.column("rank").to_pylist(), batch.column("stored").to_pylist())):
                    if rank < 0:
                        block = stored
                        paths, nodes = paths_below(stored["stack"], stored["width"], stored["levels"], stored["path"])
                        continue
                    chosen.append(i)
                    out["path"].append(paths[rank % WIDTH])
                    out["subroot"].append(block["subroot"])
                    out["root"].append(block["root"])
                if chosen:
                    fields = batch.column("asked").take(pa.array(chosen)).flatten()
                    values = [*fields, *(pa.array(out[c], pa.binary()) for c in ("subroot", "root", "path"))]
                    yield pa.RecordBatch.from_arrays(values, [f"c{i}" for i in range(len(values))])

        both = _rows_sorted(rows.union(asked), "rank").select("rank", "stored", "asked")
        kinds = [f.dataType.simpleString() for f in requests.select(*self.kept_columns, "leaf").schema] + ["binary"] * 3
        found = mapped(both, run, ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds)))
        return found.toDF(*self.kept_columns, "leaf", "subroot", "root", "path")


def manifest(rows: DataFrame, source: str, order: str, leaf: str, keep: list[str]) -> Manifest:
    """The manifest of ``rows`` with a digest ``leaf`` each; ``keep`` are the columns that proofs carry."""
    plain = rows.select(F.col(source).alias("m_source"), F.col(order).alias("m_order"), F.col(leaf).alias("m_leaf"), *(F.col(c).alias(f"k_{c}") for c in keep))
    first = [F.col("m_source").asc_nulls_first(), F.col("m_order").asc_nulls_first(), F.col("m_leaf")]
    # Written before it is read: the cuts between range partitions come from a sample.
    ranged = plain.repartitionByRange(*first).sortWithinPartitions(*first)
    placed = written(ranged.withColumn("m_at", F.monotonically_increasing_id()).drop("m_order"))
    part = F.shiftright("m_at", 33)
    runs = placed.groupBy("m_source", part.alias("m_part")).agg(F.count("*").alias("rows"), F.min("m_at").alias("first"))
    same = Window.partitionBy("m_source")
    runs = kept(
        runs.select(
            "m_source", "m_part", "first",
            (F.sum("rows").over(same.orderBy("m_part")) - F.col("rows")).alias("before"),
            F.sum("rows").over(same).alias("n"),
            (F.min("m_part").over(same) == F.col("m_part")).alias("opens"),
        )
    )
    # Sources are numbered in order of their first row: within its partition, after those of the partitions before.
    opening = runs.where("opens")
    per_part = opening.groupBy("m_part").agg(F.count("*").alias("opened"))
    offsets = per_part.select("m_part", (F.sum("opened").over(Window.orderBy("m_part")) - F.col("opened")).alias("trees_before"))
    number = F.row_number().over(Window.partitionBy("m_part").orderBy("first")) - 1
    trees = opening.withColumn("number", number).join(offsets, "m_part").select(F.col("m_source").alias("t_source"), (F.col("trees_before") + F.col("number")).alias("tree"))
    numbered = runs.join(trees, F.col("m_source").eqNullSafe(F.col("t_source"))).select(
        F.col("m_source").alias("r_source"), F.col("m_part").alias("r_part"), "first", "before", "n", "tree"
    )
    at = placed.withColumn("m_part", part).join(numbered, (F.col("m_part") == F.col("r_part")) & F.col("m_source").eqNullSafe(F.col("r_source")))
    rank = F.col("m_at") - F.col("first") + F.col("before")
    leaves = written(at.select("tree", rank.alias("rank"), "n", F.col("m_leaf").alias("leaf"), *(F.col(f"k_{c}").alias(c) for c in keep)))
    sizes = runs.agg(F.max("n").alias("most"), F.count_if("opens").alias("trees")).first()
    if not sizes["trees"]:
        return Manifest(leaves, Tree([]), Tree([]), keep)
    sources = build(leaves.select("tree", "rank", F.col("leaf").alias("digest"), "n"), sizes["most"])
    over = sources.tops().select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest", F.lit(sizes["trees"]).cast("long").alias("n"))
    return Manifest(leaves, sources, build(over, sizes["trees"]), keep)


def verified(proofs: DataFrame, claimed: str) -> DataFrame:
    """``proofs`` with ``proof`` (the digest of all siblings on the path) and ``folded``, the root from the ``claimed`` leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, paths = batch.column(claimed).to_pylist(), batch.column("path").to_pylist()
            proof = [parent(siblings(path)) for path in paths]
            folded = [fold(leaf, path) for leaf, path in zip(leaves, paths)]
            arrays = [pa.array(proof, pa.binary()), pa.array(folded, pa.binary())]
            columns = [(name, batch.column(name)) for name in batch.schema.names if name != "path"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in columns), *arrays], [*(n for n, _ in columns), "proof", "folded"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema if f.name != "path"]
    return mapped(proofs, run, ", ".join([*fields, "proof binary", "folded binary"]))


def tampering(docs: DataFrame) -> DataFrame:
    """Every row of a document table with its proof, the root recomputed after tampering, and whether it still holds.

    Where 2 divides the CRC-32 of the decimal doc_id, tampering takes the line feeds out of the text; a null doc_id is left alone.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    changed = F.when(hit, digest(joined(*fields, F.translate("text", "\n", ""))))
    rows = docs.select("doc_id", "source", digest(joined(*fields, F.col("text"))).alias("leaf"), changed.alias("changed"))
    found = manifest(rows, "source", "doc_id", "leaf", ["doc_id", "changed"]).proofs()
    checked = verified(found.withColumn("claimed", F.coalesce("changed", "leaf")), "claimed")
    text = lambda name: F.lower(F.hex(name))
    return checked.select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
