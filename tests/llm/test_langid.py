from collections import Counter

import numpy as np

from ledgerscope.llm import langid
from ledgerscope.llm.common import kept


def train(spark):
    english = "the cat sat on the mat and the dog ran to the house with the ball"
    french = "le chat est sur le tapis et le chien court vers la maison avec la balle"
    rows = [(1, english, "en"), (2, french, "fr"), (3, english[::2] + " the of and", "en"), (4, None, "en"), (5, english, None)]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string")


def test_probabilities_sum_to_one(spark):
    model = langid.learn(train(spark))
    letters = [ord(c) for c in "\x03 abcdefghijklmnopqrstuvwxyz" if c != " "]
    context = ord("t") << 32 | ord("h") << 16  # after the start mark, "th"
    start = ord(langid.START) << 48
    for before in (start | context, start | ord("q") << 32 | ord("q") << 16):
        p = 2 ** -model.bits(np.array([before | c for c in letters], np.uint64))
        seen = model.symbols
        unseen = len(letters) - seen  # each has the share of a single unknown symbol
        total = p.sum(axis=0) - (unseen - 1) * p[letters.index(ord("z"))]
        assert np.allclose(total, 1, atol=1e-9), total


def test_estimates_are_one_plan_of_few_exchanges(spark):
    """The driver keeps the metrics of each task of each exchange; a join for each order and role took dozens of them. Values are those of the formulas."""
    grams = kept(langid.count_grams(train(spark), "text", "lang"))
    model = langid.estimate(grams)
    plan = model._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange") <= 6, plan
    found = {(r["order"], r["context"], r["lang"], r["gram"]): r["value"] for r in model.collect()}
    expected = {}
    level = {(r["lang"], r["gram"]): r["n"] for r in grams.collect()}
    for order in range(langid.ORDER, 0, -1):
        for lang in ("en", "fr"):
            own = {gram: n for (name, gram), n in level.items() if name == lang}
            once, twice = (sum(n == times for n in own.values()) for times in (1, 2))
            discount = once / (once + 2 * twice) if once and twice else 0.5
            after = {}
            for gram, n in own.items():
                after.setdefault(gram >> 16 if order > 1 else 0, []).append(n)
            for gram, n in own.items():
                expected[order, False, lang, gram] = (n - discount) / sum(after[gram >> 16 if order > 1 else 0])
            for gram, counts in after.items():
                expected[order, True, lang, gram] = discount * len(counts) / sum(counts)
        level = Counter((lang, gram & (1 << 16 * (order - 1)) - 1) for lang, gram in level)
    assert found == expected


def test_counts_of_texts(spark):
    grams = {(r["lang"], r["gram"]): r["n"] for r in langid.count_grams(train(spark).where("doc_id < 3"), "text", "lang").collect()}
    packed = lambda s: sum(ord(c) << 16 * (3 - i) for i, c in enumerate(s))
    assert grams[("en", packed("\x02the"))] == 5
    assert grams[("fr", packed("\x02la\x03"))] == 2
    assert sum(n for (lang, _), n in grams.items() if lang == "fr") == sum(len(w) + 1 for w in train(spark).first()["text"] and "le chat est sur le tapis et le chien court vers la maison avec la balle".split())


def test_odd_documents(spark, odd_documents):
    model = langid.learn(train(spark))
    rows = {r["doc_id"]: r for r in langid.identify(odd_documents, model).collect()}
    assert rows[1]["lang_pred"] == "en" and rows[None]["lang_pred"] == "fr"
    for doc_id in (2, 3, 7, 8):
        assert (rows[doc_id]["lang_pred"], rows[doc_id]["score"], rows[doc_id]["accepted"]) == ("und", 0.0, False)
    assert rows[4]["lang_pred"] == "en" and not rows[9]["accepted"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[1]["removed"] == "r"


def test_nothing_to_learn_from(odd_documents, no_documents):
    assert langid.learn(no_documents) is None
    assert {r["lang_pred"] for r in langid.identify(odd_documents, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    from ledgerscope.llm.queries import QUERIES

    judged = QUERIES["op9_kneser_ney"].build(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = judged.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert judged.count() == docs.count()
