"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.llm import bpe, decontaminate, hnsw, kdtree, langid, licenses, lines, manifest, merkle, ngram_join, prefix_trie, pseudonyms, simhash
from ledgerscope.llm.common import QUERIES, kept, register, table  # noqa: F401  (QUERIES for the entry file)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_bpe_lexicon")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path(), round_trip=True, keep_text=False)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@register("op9_kneser_ney")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.learn(docs.where(~held_out))
    judged = langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "accepted", "bits_per_event")


@register("op7_simhash_pivots")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.classes(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


@register("op6_kd_tree")
def op6(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    dims = {"size": F.col("size"), "source": kdtree.scattered(F.col("source")), "lang": kdtree.scattered(F.col("lang")), "doc_id": F.col("doc_id")}
    placed = kdtree.kd_shards(docs, dims, F.col("size"), 24, [F.col(c) for c in ("doc_id", "source", "lang", "size", "text_crc32")])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# The second replica is the first with damage by a rule on the address: a changed byte, or a record that cannot be read.
@register(
    "op5_merkle_audit",
    r"""WITH r AS (
SELECT page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
       || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
       || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
       || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))
       || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
FROM pages),
d AS (SELECT page_id, url, strlen(record) AS length, sha256(record) AS digest, sha256('V' || substr(record, 2)) AS changed,
             count(*) AS copies FROM r GROUP BY ALL),
f AS (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || digest), 1, 8) AS BIGINT)
             % ((SELECT coalesce(sum(length), 0) FROM d) // 33554432 + 1) AS file FROM d),
o AS (SELECT *, sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, url NULLS FIRST, digest) - length AS start FROM f)
SELECT page_id, CAST(file AS BIGINT) AS file, CAST(start AS BIGINT) AS "offset", length, copies,
       CASE WHEN md5(url) LIKE '3c%' THEN 'missing' ELSE 'corrupt' END AS status, digest AS expected,
       CASE WHEN md5(url) LIKE '3c%' THEN NULL ELSE changed END AS found
FROM o WHERE md5(url) LIKE '3c%' OR md5(url) LIKE '7%'""",
)
def op5(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    record = merkle.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    hurt, lost = F.md5("url").startswith("7"), F.md5("url").startswith("3c")
    records = pages.select("page_id", "url", record.alias("record")).select(
        "page_id",
        "url",
        F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"),
        F.when(F.coalesce(hurt, F.lit(False)), F.sha2(F.concat(F.lit("V"), F.expr("substr(record, 2)")), 256)).alias("changed"),
    )
    stored = kept(merkle.layout(records))
    replica = stored.where(~F.coalesce(lost, F.lit(False))).withColumn("digest", F.coalesce("changed", "digest"))
    found = merkle.audit(stored, replica)
    place = stored.select("file", "offset", "page_id", "length", "copies")
    return found.join(place, ["file", "offset"], "left").select("page_id", "file", "offset", "length", "copies", "status", "expected", "found")


@register("op3_templates")
def op3(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "changed")


@register("op1_patience_licenses")
def op1(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op2_feistel_pseudonyms")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="a key of the caller, kept outside of the code in use")


@register("op10_line_join")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    counted = docs.select("doc_id", lines.order_of(F.col("doc_id")).alias("doc"), F.coalesce(ends + 1, F.lit(0)).alias("n_lines"))
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return counted.join(lines.removed(docs, least=1), "doc", "left").select("doc_id", "n_lines", F.size(gone).alias("n_removed"), gone.alias("removed"))


@register("op8_hnsw")
def op8(spark, sf_dir):
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def crc32_sql(text: str) -> str:
    """DuckDB's SQL for the unsigned CRC-32 of an ASCII text."""
    byte = f"list_transform(range(1, length({text}) + 1), lambda k: CAST(ascii(substr({text}, k, 1)) AS BIGINT))"
    eight = "list_reduce(range(8), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(c, b))"
    return f"xor(4294967295, list_reduce({byte}, lambda c, b: {eight}, 4294967295))"


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


_LEAF_SQL = "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "{text}"))) + ")"


# k numbers the rows, t the trees: one for each source and, above them, tree 0.
@register(
    "op11_merkle_manifest",
    f"""WITH RECURSIVE
l AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS k, doc_id, source, {_LEAF_SQL.format(text="text")} AS leaf,
      CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF_SQL.format(text="replace(text, chr(10), '')")}
           ELSE {_LEAF_SQL.format(text="text")} END AS used FROM documents),
p AS (SELECT k, doc_id, leaf, used, dense_rank() OVER (ORDER BY source NULLS FIRST) AS t,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
a(t, level, pos, n, h) AS (SELECT t, 0, pos, n, leaf FROM p UNION ALL
      SELECT t, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM a WHERE n > 1 GROUP BY t, level, pos // 3, n),
s AS (SELECT t, h AS subroot, max(level) OVER () + 1 AS base, level AS height FROM a WHERE n = 1),
b(level, pos, n, h) AS (SELECT 0, t - 1, count(*) OVER (), subroot FROM s UNION ALL
      SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM b WHERE n > 1 GROUP BY level, pos // 3, n),
-- all runs of siblings, those of the upper tree above the highest source
r AS (SELECT t, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM a WHERE n > 1 GROUP BY ALL
      UNION ALL SELECT 0, (SELECT max(base) FROM s) + level, pos // 3, list(h ORDER BY pos) FROM b WHERE n > 1 GROUP BY ALL),
w(k, tree, t, level, height, base, pos, h, sib) AS (
      SELECT p.k, p.t, p.t, 0, s.height, s.base, p.pos, p.used, '' FROM p JOIN s USING (t)
      UNION ALL
      SELECT w.k, w.tree, CASE WHEN up THEN 0 ELSE w.t END, CASE WHEN up THEN w.base ELSE w.level + 1 END, CASE WHEN up THEN 1000 ELSE w.height END,
             w.base, CASE WHEN up THEN w.tree - 1 ELSE w.pos // 3 END,
             CASE WHEN up THEN w.h ELSE sha256(array_to_string(list_transform(r.hs, lambda x, i: CASE WHEN i = w.pos % 3 + 1 THEN w.h ELSE x END), '')) END,
             CASE WHEN up THEN w.sib ELSE w.sib || array_to_string(list_concat(r.hs[1:w.pos % 3], r.hs[w.pos % 3 + 2:]), '') END
      FROM (SELECT *, t > 0 AND level = height AS up FROM w) w LEFT JOIN r ON r.t = w.t AND r.level = w.level AND r.run = w.pos // 3
      WHERE up OR r.t IS NOT NULL),
e AS (SELECT k, max_by(h, level) AS folded_root, max_by(sib, level) AS sib FROM w WHERE t = 0 GROUP BY k)
SELECT p.doc_id, p.leaf, s.subroot, (SELECT h FROM b WHERE n = 1) AS root, sha256(e.sib) AS proof_sha256, e.folded_root,
       e.folded_root = (SELECT h FROM b WHERE n = 1) AS verified
FROM p JOIN s USING (t) JOIN e USING (k)""",
)
def op11(spark, sf_dir):
    return manifest.tampering(table(spark, sf_dir, "documents"))


@register(
    "op12_prefix_trie",
    f"""WITH
t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT t.conv_id, list_concat(coalesce(b.turns, [])[1:h], t.turns[h + 1:]) AS turns
      FROM (SELECT *, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t) t LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % 5),
m AS (SELECT conv_id, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS depth, turns FROM c),
n AS (SELECT turns[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth) AS ends,
             CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(any_value(turns[depth].x)) ELSE 0 END AS saved FROM m GROUP BY turns[1:depth], depth),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
-- every node with all its ancestors, itself included
u AS (SELECT f.*, unnest(range(0, depth + 1)) AS up FROM f),
v AS (SELECT node[1:up] AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       CAST(v.n_leaves AS BIGINT) AS n_leaves, CAST(v.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN v USING (node) LEFT JOIN f p ON f.depth > 0 AND p.node = f.node[1:f.depth - 1]""",
)
def op12(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return prefix_trie.trie(prefix_trie.branched(prefix_trie.sequences(turns))).drop("node")


@register("op13_ngram_tiles")
def op13(spark, sf_dir):
    return ngram_join.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
