"""Merkle fixity audit of archived records in two replicas.

Records are stored as WARC records in files; a record's leaf is the SHA-256 of its bytes.
Leaves are joined in offset order to ranges of ``RANGE`` bytes, these by ``FANOUT`` to wider ranges,
these to files, and files by ``FANOUT`` up to one root. The audit compares the roots and goes down
only below nodes that differ: each step joins the children of differing nodes, so equal parts of
the replicas are not looked at again. A hash covers at most the children of one node.

Equal records (page, address and bytes) are stored once with their number of copies, so a
page that fills a third of the table is one leaf. Null addresses and bodies are stored as
empty ones. An empty table has no nodes and no differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import kept

FILE_BYTES = 32 << 20
RANGE = 64 << 10
FANOUT = 64
WIDENINGS = 1  # ranges of RANGE * FANOUT bytes below a file


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC record as text."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
        F.lit(""),
        body,
        F.lit(""),
        F.lit(""),
    ]
    return F.concat_ws("\r\n", *head)


def layout(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``records`` (page_id, url, length, digest, ...) made distinct, with ``copies``, ``file`` and ``offset``.

    Records go to files by a hash of what they are, so no file is much over ``file_bytes``, and are ordered within.
    """
    stored = kept(records.groupBy(*records.columns).agg(F.count("*").alias("copies")))
    total = stored.agg(F.sum("length")).first()[0] or 0
    files = total // file_bytes + 1
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), "digest"))
    file = (F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % files).alias("file")
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest")
    return stored.select("*", file).withColumn("offset", F.sum("length").over(order) - F.col("length"))


def _joined(children: Column) -> Column:
    """SHA-256 over (place, hash) of the children, in order of place."""
    return F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(children)), lambda c: F.concat_ws(":", c["at"], c["hash"]))), 256)


def tree(leaves: DataFrame, files: int) -> list[DataFrame]:
    """The levels ``(file, place, hash)`` from narrow ranges to the root; ``leaves`` hold file, offset, length, digest."""
    leaf = F.struct(F.col("offset").alias("at"), F.concat_ws(":", "length", "digest").alias("hash"))
    levels = [kept(leaves.groupBy("file", F.expr(f"offset div {RANGE}").alias("place")).agg(_joined(leaf).alias("hash")))]
    child = F.struct(F.col("place").alias("at"), "hash")
    for _ in range(WIDENINGS):
        levels.append(kept(levels[-1].groupBy("file", F.expr(f"place div {FANOUT}").alias("place")).agg(_joined(child).alias("hash"))))
    levels.append(kept(levels[-1].groupBy("file", F.lit(-1).cast("long").alias("place")).agg(_joined(child).alias("hash"))))
    child = F.struct(F.col("file").alias("at"), "hash")
    while files > 1:
        files = -(-files // FANOUT)
        levels.append(kept(levels[-1].groupBy(F.expr(f"file div {FANOUT}").alias("file"), "place").agg(_joined(child).alias("hash"))))
    return levels


def audit(reference: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: ``file, offset, status`` (corrupt, missing or extra), ``expected`` and ``found``.

    Both tables hold file, offset, length and digest of each stored record; offsets are unique within a file.
    """
    keys = ["file", "offset", "length", "digest"]
    ours, theirs = reference.select(keys), replica.select(keys)
    files = ours.union(theirs).agg(F.max("file")).first()[0]
    files = 0 if files is None else files + 1

    def sided(a: DataFrame, b: DataFrame) -> DataFrame:
        """Both replicas' rows with their hash under the replica's name, so that one join and one sum serve both."""
        none = F.lit(None).cast("string")
        left = a.select("*", F.col("hash").alias("expected"), none.alias("found"))
        return left.union(b.select("*", none.alias("expected"), F.col("hash").alias("found"))).drop("hash")

    def differing(rows: DataFrame, *place: str) -> DataFrame:
        both = rows.groupBy(*place).agg(F.max("expected").alias("expected"), F.max("found").alias("found"))
        return both.where(~F.col("expected").eqNullSafe(F.col("found")))

    def below(level: int, wrong: DataFrame, nodes: DataFrame) -> DataFrame:
        """The nodes of a level whose parents are among the ``wrong`` ones of the level above."""
        if level < WIDENINGS:
            parent = [F.col("file").alias("up_file"), F.expr(f"place div {FANOUT}").alias("up_place")]
        elif level == WIDENINGS:
            parent = [F.col("file").alias("up_file"), F.lit(-1).cast("long").alias("up_place")]
        else:
            parent = [F.expr(f"file div {FANOUT}").alias("up_file"), F.col("place").alias("up_place")]
        up = wrong.select(F.col("file").alias("up_file"), F.col("place").alias("up_place"))
        return nodes.select("*", *parent).join(up, ["up_file", "up_place"], "left_semi").drop("up_file", "up_place")

    levels = [sided(a, b) for a, b in zip(tree(ours, files), tree(theirs, files))]
    # Each step is written: a level is a small part of the one below, and its plan would else hold those of all levels above.
    wrong = kept(differing(levels[-1], "file", "place"))
    for level in range(len(levels) - 2, -1, -1):
        wrong = kept(differing(below(level, wrong, levels[level]), "file", "place"))

    def leaves(records: DataFrame) -> DataFrame:
        return records.select("file", "offset", F.expr(f"offset div {RANGE}").alias("place"), F.concat_ws(":", "length", "digest").alias("hash"))

    differ = differing(sided(leaves(ours), leaves(theirs)).join(wrong.select("file", "place"), ["file", "place"], "left_semi"), "file", "offset")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    digest = lambda name: F.substring_index(name, ":", -1).alias(name)
    return differ.select("file", "offset", status.alias("status"), digest("expected"), digest("found"))
