import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ledgerscope.llm import lines
from ledgerscope.llm.queries import QUERIES


def expected_of(rows, least=5):
    sets = []
    for doc, text in rows:
        for place, line in enumerate((text or "").lower().split("\n")):
            words = frozenset(line.split())
            if len(words) >= least:
                sets.append((doc, place, words))
    sets.sort(key=lambda s: s[:2])
    same = lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b))
    return {(d, p) for d, p, w in sets if any((e, q) < (d, p) and same(w, v) for e, q, v in sets)}


def made(seed, documents=60):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["the", "of", "É"]
    base = [[pick.choice(words) for _ in range(pick.randrange(4, 26))] for _ in range(25)]
    rows = []
    for doc in range(documents):
        text = []
        for _ in range(pick.randrange(1, 6)):
            line = list(pick.choice(base))
            for _ in range(pick.choice([0, 0, 1, 2, 3])):
                line[pick.randrange(len(line))] = pick.choice(words)
            text.append(" ".join(line).title() if pick.random() < 0.2 else "  ".join(line) + " ")
        rows.append((doc * 3 - 20, "\n".join(text)))
    return rows


def found(spark, rows, schema="doc_id long, text string", least=5):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return {(r["doc"], place) for r in lines.removed(docs, least=least).collect() for place in r["removed"]}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert found(spark, rows) == expected_of(rows)


def test_short_lines(spark, tmp_path):
    """Lines of any number of words in the query: equal ones, and four words against five."""
    rows = [(1, "Les.\na b c\n\na b c d\nx x x x x x"), (2, "les.\nb c\n \na b c d e\nX"), (3, "c b a\nLes. Les.\na b c f\nb a\nd c b a\nb"), (4, "b c x")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["removed"] for r in QUERIES["op10_line_join"].build(spark, str(tmp_path)).collect()}
    assert found == {1: [], 2: [0, 3, 4], 3: [0, 1, 4], 4: []}


def test_dense_lines_of_few_words(spark):
    """Lines of 1 to 12 words from a vocabulary of 14: most share words, few match, and many ask in the second round."""
    pick = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    rows = [(doc, "\n".join(" ".join(pick.sample(words, pick.randrange(1, 13))) for _ in range(6))) for doc in range(120)]
    assert found(spark, rows, least=1) == expected_of(rows, 1)


def test_sizes_around_the_largest_that_ask_by_pairs(spark):
    """Every set is the start of a long one with some words changed; first partners mostly fail."""
    pick = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for doc in range(90):
        line = base[: pick.randrange(60, 110)]
        for _ in range(pick.choice([2, 6, 8, 9, 10, 11, 14])):
            line[pick.randrange(len(line))] = f"z{pick.randrange(12)}"
        rows.append((doc, " ".join(line)))
    assert found(spark, rows) == expected_of(rows)


def test_crowded_words_in_cells(spark, monkeypatch):
    monkeypatch.setattr(lines, "CELL", 6)
    rows = made(3)
    assert found(spark, rows) == expected_of(rows)


def test_second_round(spark):
    """The earliest partner of the third line passes the filters only by chance of the classes; the second one matches."""
    base = [f"a{i}" for i in range(300)]
    rows = [(1, " ".join(base[:210] + [f"x{i}" for i in range(90)])), (2, " ".join(base)), (3, " ".join(base[:290] + [f"y{i}" for i in range(10)]))]
    assert found(spark, rows) == expected_of(rows) == {(3, 0)}


def test_second_round_gives_each_pair_once(spark):
    """Lines that share many rare words meet by many keys; sets below, around and above the largest that ask by pairs."""
    pick = random.Random(11)
    rows = []
    for size in (30, 72, 120):
        base = [f"s{size}w{i}" for i in range(size)]
        for _ in range(25):
            line = list(base)
            for _ in range(pick.choice([1, 2, 4, size // 12, size // 8])):
                line[pick.randrange(size)] = f"z{pick.randrange(500)}"
            if size == 72:  # on both sides of the limit
                line += [f"s{size}e{i}" for i in range(pick.randrange(0, 14))]
            rows.append((len(rows), " ".join(line)))
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    marked = lines._marked(docs, lines._rarity(docs, lines.Lines), 5, lines.Lines)
    everyone = np.full(1 << lines.NEEDED_BITS - 3, 255, np.uint8)
    met = [(r["doc"], r["to_doc"]) for r in lines._found(lines._asked(marked, everyone), every=True).collect()]
    sets = [set(text.split()) for _, text in rows]
    matched = {(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(met) == len(set(met)) and len(matched) > 300
    assert matched <= set(met)


def test_lines_and_words_travel_in_pages(spark):
    """An exchange has a row for the lines or words of one bucket and task, whatever their number; none is lost and equal sets lead once."""
    rows = made(12) + [(1000 + i, f"p{i % 7} q r s t u v w x y z{i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    rarity = lines._rarity(docs, lines.Lines)
    leaders = lines._leaders(lines._marked(docs, rarity, 5, lines.Lines))
    pages = lines._paged(leaders, 4).collect()
    words = [w for page in pages for w in np.frombuffer(page["words"], lines.WORD).tolist()]
    sets = {frozenset(line.split()): None for _, text in sorted(rows) for line in text.lower().split("\n") if len(set(line.split())) >= 5}
    width = lambda n: n - -(-4 * n // 5) + 1
    assert len(words) == len(set(words)) == sum(width(len(s)) for s in sets) > 200
    assert len(pages) <= 4 * leaders.rdd.getNumPartitions() < len(words) / 10
    assert len({w[1:5:3] for w in words}) == len(sets)  # each led by one place
    assert {page["bucket"] for page in pages} <= set(range(4))


def test_short_lines_do_not_gather_in_a_task(spark, monkeypatch):
    """Lines of up to three words have no prefix words, but are handed on like others."""
    monkeypatch.setattr(lines, "mapped", lambda df, run, schema: run)
    monkeypatch.setattr(lines, "PAGED", 100)
    monkeypatch.setattr(lines, "CHUNK", 500)
    run = lines._marked(spark.createDataFrame([(1, "a")], "doc long, text string"), np.ones(1 << lines.BITS, np.uint16), 1, lines.Lines)
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(900), pa.int64()), "text": [f"w{i}" for i in range(900)]})
    sizes = [sum(map(len, out.column(1).to_pylist())) // lines.LINE.itemsize for out in run(iter([batch]))]
    assert sum(sizes) == 900 and max(sizes) < 300


def test_words_that_hash_alike_keep_one_order(monkeypatch):
    """Hashes with the same first bits are ordered by all bits, also in lines that meet them in another order."""
    texts = ["a b c d e f\nf e d c b a\nb b", None, "", "c a\n\n f a"]
    plain = lines._hashed
    monkeypatch.setattr(lines, "_hashed", lambda *args: plain(*args) & np.uint64(0xFFFF) | np.uint64(7 << 50))
    part = lines.Lines(pa.array(texts))
    line, sizes, starts, words = part.sets(np.ones(1 << lines.BITS, np.uint16), 1)
    code = {w: int(lines._digests(pa.array([w]))[0]) for w in "abcdef"}
    expected = [(row, place, sorted({code[w] for w in text.split()})) for row, whole in enumerate(texts) if whole is not None for place, text in enumerate(whole.split("\n")) if text.split()]
    assert [(int(part.row[i]), int(part.place[i]), words[a : a + n].tolist()) for i, n, a in zip(line, sizes, starts)] == expected


def test_words_are_those_between_any_white_space():
    """Arrow's white space, of one to three bytes and at all places, also at the ends of texts; letters that begin with the same bytes stay."""
    codes = [c for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"{left}{chr(c)}{right}" for c in codes for left, right in (("", ""), ("Ab", "\u00c9c d"), ("", "x"))] + ["", "a " * 9 + "b" * 40, "\u2003\u3000z\n\u00a0"]
    expected = pc.utf8_split_whitespace(pc.utf8_lower(pa.array(texts))).to_pylist()
    words = lines.Words(pa.array(texts))
    found = [(i, bytes(words.data[a : a + n]).decode()) for i, a, n in zip(words.owner.tolist(), words.starts.tolist(), words.lengths.tolist())]
    assert found == [(i, word) for i, row in enumerate(expected) for word in row if word]
    assert (words.hashes() == lines._digests(pa.array([word for _, word in found]))).all()


def test_rarity_counts_words_only(spark):
    """Blanks at the ends of a text are no words; each word counts as often as it is there, however it is written."""
    docs = spark.createDataFrame([(" one Two ",), ("two  one two\n",), ("",), (None,)], "text string")
    table = np.full(1 << lines.BITS, np.ceil(16 * np.log2(0.5)) + 17)
    for word, n in (("one", 2), ("two", 3)):
        table[int(lines._digests(pa.array([word]))[0]) >> 64 - lines.BITS] = np.ceil(16 * np.log2(n)) + 17
    assert (lines._rarity(docs, lines.Lines) == table).all()


def test_hash_is_that_of_sql(spark):
    table = spark.range(40).select((F.col("id") * 104729 - 900).alias("d"), (F.col("id") % 5).cast("int").alias("l")).withColumn("h", F.xxhash64("d", "l")).toPandas()
    assert (lines.spark_hash(table.d.to_numpy(), table.l.to_numpy()).view(np.int64) == table.h.to_numpy()).all()


def test_odd_documents(odd_documents, no_documents):
    out = lines.without_repeats(odd_documents)
    assert out.columns == odd_documents.columns
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    before = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd_documents.collect())
    assert [t for t in texts if t[0] != 5] == [t for t in before if t[0] != 5]
    assert [t for t in texts if t[0] == 5] == [(5, ""), (5, "")]
    assert lines.without_repeats(no_documents).count() == 0
    clashing = odd_documents.withColumns({"gone doc": F.lit("g"), "Gone Lines": F.lit(1)})
    assert lines.without_repeats(clashing).columns == clashing.columns and lines.without_repeats(clashing).count() == odd_documents.count()
