"""Shards of near equal bytes from a k-d tree over metadata, with DataFrame functions only.

A node with k shards is split so that its left side gets floor(k/2)/k of its bytes,
along the dimension in which its rows are spread widest (each dimension is scaled
by its range over all rows). The cut is an exact weighted quantile found by counting: the
open key range of every node is cut into ``BINS`` even bins, bytes are summed by bin, and the
bin with the target is opened next, all nodes of a level in one job. The driver sees one row per node. Equal
coordinates are ordered by a hash of the row, and equal rows by a number fixed when
the metadata are written, so a hot value is split like any other and no text is shuffled.

A null coordinate is the lowest. Null texts weigh as empty ones. Repeated rows are rows
of their own. An empty table gives no rows. The columns asked for are kept; inner names start with ``kd_``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import kept, literals

BINS = 1 << 16
COORDINATE_BITS = 20
TIE_BITS = 43
SLOT_ROWS = 100_000  # rows that one task numbers, on average


@dataclass
class Search:
    """The open key range of a node's cut."""

    low: int
    high: int
    before: float
    target: float
    key: int | None = None  # set when equal keys are being told apart by row number


def scattered(value: Column) -> Column:
    """A coordinate for values without an order: equal values share it, others spread over the range."""
    return F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(1 << COORDINATE_BITS))).cast("double")


def _scaled(rows: DataFrame, names: list[str]) -> DataFrame:
    """Coordinates as whole numbers of ``COORDINATE_BITS`` bits, scaled by their range."""
    ends = rows.agg(*(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max))).first()
    scaled = {}
    for name in names:
        low, high = ends[f"min_{name}"], ends[f"max_{name}"]
        top = (1 << COORDINATE_BITS) - 1
        wide = high is not None and high > low
        scaled[name] = F.coalesce(((F.col(name) - low) * (top / (high - low))).cast("long"), F.lit(0).cast("long")) if wide else F.lit(0).cast("long")
    return rows.withColumns(scaled)


def _cuts(rows: DataFrame, nodes: dict[int, tuple[int, int]], dims: int) -> list[tuple]:
    """``(node, dimension, key, row)`` for all nodes with several shards: rows up to (key, row) go left."""
    stats = [f(f"kd_{i}").alias(f"{f.__name__}_{i}") for i in range(dims) for f in (F.min, F.max)]
    found = rows.where(F.col("kd_node").isin(list(nodes))).groupBy("kd_node").agg(F.sum("kd_size").alias("total"), *stats).collect()
    axis, searches, cuts = {}, {}, []
    for row in found:
        node = row["kd_node"]
        axis[node] = max(range(dims), key=lambda i: (row[f"max_{i}"] - row[f"min_{i}"], -i))  # noqa: B023
        shards = nodes[node][1]
        searches[node] = Search(0, (1 << COORDINATE_BITS + TIE_BITS) - 1, 0.0, row["total"] * (shards // 2) / shards)
    while searches:
        spark = rows.sparkSession
        open_ranges = literals(
            spark,
            [(node, axis[node], s.low, s.high, (s.high - s.low) // BINS + 1, s.before, s.target, s.key) for node, s in searches.items()],
            "kd_node int, kd_axis int, low long, high long, step long, before double, target double, tied long",
        )
        key = F.col("kd_keys")[F.col("kd_axis")]
        place = F.when(F.col("tied").isNull(), key).otherwise(F.col("kd_row"))
        inside = rows.join(F.broadcast(open_ranges), "kd_node").where((F.col("tied").isNull() | (key == F.col("tied"))) & place.between(F.col("low"), F.col("high")))
        bins = inside.groupBy("kd_node", "before", "target", F.expr("0").alias("zero"), F.floor((place - F.col("low")) / F.col("step")).alias("bin")).agg(
            F.sum("kd_size").alias("weight"), F.count("*").alias("rows"), F.min(place).alias("first"), F.max(place).alias("last")
        )
        upto = F.col("before") + F.sum("weight").over(Window.partitionBy("kd_node").orderBy("bin"))
        reached = bins.withColumn("upto", upto).where("upto >= target").groupBy("kd_node").agg(F.min(F.struct("bin", "first", "last", "rows", "weight", "upto")).alias("at"))
        for node, at in reached.collect():
            search = searches[node]
            below = at["upto"] - at["weight"]
            if at["first"] < at["last"]:
                searches[node] = Search(at["first"], at["last"], below, search.target, search.key)
            elif at["rows"] > 1:  # equal keys: by row number, which is unique
                searches[node] = Search(0, (1 << 63) - 1, below, search.target, at["first"])
            else:
                left = at["upto"] - search.target <= search.target - below  # the nearer side of this row
                if search.key is None:
                    cuts.append((node, axis[node], at["first"] if left else at["first"] - 1, (1 << 63) - 1))
                else:
                    cuts.append((node, axis[node], search.key, at["first"] if left else at["first"] - 1))
                del searches[node]
    return cuts


def kd_shards(rows: DataFrame, dims: dict[str, Column], size: Column, shards: int, identity: list[Column]) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``dims``: numeric coordinates by name; ``identity``: what tells rows apart, for ties. ``rows`` should hold
    metadata only, as it is written once to the checkpoint folder.
    """
    names = [f"kd_{i}" for i in range(len(dims))]
    plain = [column for column in rows.columns if column not in ("shard", "slot")]
    tie = F.shiftrightunsigned(F.xxhash64(*identity), 64 - TIE_BITS)
    base = kept(
        rows.select(
            *plain,
            size.cast("double").alias("kd_size"),
            *(column.cast("double").alias(name) for name, column in zip(names, dims.values())),
            tie.alias("kd_tie"),
            F.monotonically_increasing_id().alias("kd_row"),
            F.lit(1).alias("kd_node"),
        )
    )
    keys = F.array(*(F.shiftleft(name, TIE_BITS).bitwiseOR(F.col("kd_tie")) for name in names))
    at = _scaled(base, names).withColumn("kd_keys", keys)
    nodes = {1: (0, shards)}  # by heap number: first shard, how many
    leaves = {}
    while nodes:
        leaves.update({node: first for node, (first, count) in nodes.items() if count == 1})
        nodes = {node: own for node, own in nodes.items() if own[1] > 1}
        if not nodes:
            break
        cuts = _cuts(at, nodes, len(names))
        table = literals(rows.sparkSession, cuts, "kd_node int, kd_axis int, cut long, cut_row long")  # a row for each node
        key = F.col("kd_keys")[F.col("kd_axis")]
        right = (key > F.col("cut")) | ((key == F.col("cut")) & (F.col("kd_row") > F.col("cut_row")))
        step = F.when(F.col("cut").isNull(), F.col("kd_node")).otherwise(2 * F.col("kd_node") + F.coalesce(right, F.lit(False)).cast("int"))
        at = at.join(F.broadcast(table), "kd_node", "left").withColumn("kd_node", step).drop("kd_axis", "cut", "cut_row")
        split = {node: own for node, own in nodes.items() if node in {cut[0] for cut in cuts}}  # a node without rows ends
        nodes = {}
        for node, (first, count) in split.items():
            nodes[2 * node] = (first, count // 2)
            nodes[2 * node + 1] = (first + count // 2, count - count // 2)
    places = literals(rows.sparkSession, list(leaves.items()), "kd_node int, shard int")
    placed = at.join(F.broadcast(places), "kd_node").select(*plain, "shard", "kd_tie", "kd_row")
    return _numbered(placed, base.count() // (SLOT_ROWS * shards) + 1).select(*plain, "shard", "slot")


def _numbered(placed: DataFrame, parts: int) -> DataFrame:
    """``slot``: each shard's rows are dealt into ``parts`` by hash, numbered there, and moved up by the rows of the parts before."""
    dealt = placed.withColumn("kd_part", F.pmod(F.xxhash64("kd_tie", "kd_row"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "kd_part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("kd_part")) - F.col("rows")
    offsets = counts.select("shard", "kd_part", before.alias("kd_before"))
    number = F.row_number().over(Window.partitionBy("shard", "kd_part").orderBy("kd_tie", "kd_row"))
    return dealt.withColumn("kd_number", number).join(offsets, ["shard", "kd_part"]).withColumn("slot", (F.col("kd_before") + F.col("kd_number") - 1).cast("long"))
