from ledgerscope.llm import decontaminate
from ledgerscope.llm.queries import QUERIES

ITEM = "Once Tom Smith has 3 apples and buys 5 kg more from the shop near Paris, how many apples does Tom Smith have?"
OTHER = "hello there. Once Ann Lee has 7 apples and buys 9 lb more from the shop near Berlin, how many apples does Ann Lee have? yes"
UNLIKE = "Once Ann Lee has 7 apples and buys 9 lb more from the shop near Berlin, how many apples does Bob have?"


def tables(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    items = spark.createDataFrame([(9, ITEM), (8, None), (7, ""), (6, "too short")], "item_id long, text string")
    return docs, items


def test_templates(spark):
    docs, items = tables(spark, [(1, ITEM), (2, OTHER), (3, UNLIKE), (4, ITEM.lower().replace("once", "…")), (5, "So: " + ITEM + " " + "and more " * 500 + OTHER)])
    found = {r["doc_id"]: (r["item_id"], r["changed"]) for r in decontaminate.leaks(docs, items).collect()}
    assert found[1] == (9, 0) and found[2] == (9, 5) and found[5] == (9, 0)
    assert 3 not in found  # Ann Lee stands for Tom Smith once, Bob the other time


def test_repeated_windows(spark):
    item = "The left jar holds 3 red balls and the right jar holds 5 red balls. How many balls are there?"
    other = item.replace("3", "8").replace("5", "4")
    stray = "First the old jar holds 7 red balls. "
    docs = spark.createDataFrame([(1, item), (2, "So: " + other), (3, stray + item), (4, item + " " + stray), (5, "no")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r["doc_id"]: (r["coverage"], r["changed"]) for r in decontaminate.leaks(docs, items).collect()}
    assert {doc: found[doc] for doc in (1, 2, 3, 4)} == {1: (1, 0), 2: (1, 2), 3: (1, 0), 4: (1, 0)} and 5 not in found


def test_letter_case_and_short_items(spark):
    items = [(1, ITEM), (2, "What is 7*8?"), (3, "小明有3个苹果,又买了5个,现在一共有几个苹果?"), (4, "ราคา 5"), (5, "Tom 3 5 Paris 5 7 Smith"), (6, "?!")]
    texts = [ITEM.lower(), ITEM.upper(), "so WHAT is\n7*8 then", "what is 7*9", "题目:" + items[2][1] + "请回答", "他有3个苹果", "xราคา 5", "said tom 3 5 paris 5 7 smith x", "tom 4 5 paris 5 7 smith"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, table).collect()}
    assert found == {(0, 1), (1, 1), (2, 2), (4, 3), (6, 4), (7, 5)}


def test_one_word_items_take_no_longer_texts(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "yes"), (3, "What is 7*8?"), (4, "the end.")], "item_id long, text string")
    texts = ["We met in Paris, yes, at the end.", " paris ", "Yes!", "so what is 7*8", "The end", "yes yes", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1), (2, 2), (3, 3), (4, 4)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {0, 5, 6, 7}


def test_words_alone_are_no_template(spark):
    docs, items = tables(spark, [(1, "Tom 3 Paris 5 kg Smith 7 " * 30), (2, "1 2 3 4 5 6 7 8 9"), (3, "and buys more apples from a shop near a house that many have")])
    assert decontaminate.leaks(docs, items).count() == 0


def test_odd_documents(spark, odd_documents, no_documents):
    _, items = tables(spark, [(1, "")])
    assert decontaminate.clean(odd_documents, items).count() == 10
    assert decontaminate.clean(odd_documents, items).columns == odd_documents.columns
    assert decontaminate.leaks(no_documents, items).count() == 0
    assert decontaminate.leaks(odd_documents, items.limit(0)).count() == 0
    hit = odd_documents.union(odd_documents.limit(1).replace("The cat sat on the mat and slept.\nA second line of some words here.", ITEM, "text"))
    assert decontaminate.clean(hit, items).count() == 10


def test_query_finds_every_item(spark):
    folder = "/root/testdata/sf0.01"
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op3_templates"].build(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    whole = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    assert whole and whole <= found

    def words(text):
        return [w.strip(".,:;!?*&%$#|").lower() for w in text.split()]

    texts = {d["doc_id"]: set(words(d["text"])) for d in docs}
    own = {i["item_id"]: set(words(i["text"])) for i in items}
    assert all(len(own[i] & texts[d]) >= 0.8 * len(own[i]) for d, i in found)
