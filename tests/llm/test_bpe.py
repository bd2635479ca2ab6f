import random

import pytest
from pyspark import SparkFiles
from tokenizers import Tokenizer

from ledgerscope.llm import bpe
from ledgerscope.llm.lexicon import Lexicon, compile_lexicon
from ledgerscope.llm.queries import tokenizer_path

PATH = tokenizer_path()


def test_lexicon_holds_its_words_and_no_others(tmp_path):
    words = [w.encode() for w in "a ab abc tap taps top tops stop stops b bétail 日本".split()]
    entries = {word: [i, i * i] for i, word in enumerate(words)}
    compile_lexicon(entries, str(tmp_path / "l"))
    lexicon = Lexicon(str(tmp_path / "l"))
    places = lexicon.places(words + [b"", b"t", b"to", b"topss", b"zz"])
    for word, place in zip(words, places):
        assert lexicon.ids[lexicon.starts[place] : lexicon.starts[place + 1]].tolist() == entries[word]
    assert (places[len(words) :] == -1).all()


def test_lexicon_shares_endings(tmp_path):
    entries = {b + e: [1] for b in (b"x", b"y", b"z") for e in (b"ing", b"ings", b"ed")}
    compile_lexicon(entries, str(tmp_path / "l"))
    assert len(Lexicon(str(tmp_path / "l")).final) == 7  # the root, one state before all endings, and the endings once


def test_empty_lexicon(tmp_path):
    compile_lexicon({}, str(tmp_path / "l"))
    assert Lexicon(str(tmp_path / "l")).places([b"a", b""]).tolist() == [-1, -1]


def test_encoder_equals_the_library(tmp_path, monkeypatch):
    pick = random.Random(5)
    letters = "ab e'stL\n\t .,!12é日😀 ñ  "
    texts = ["".join(pick.choices(letters, k=pick.randrange(60))) for _ in range(400)]
    texts += ["a" * 300, "x<|endoftext|> y <|endoftext|><|endoftext|>", " lead", "trail ", " a  b", "I'LL they're", "=" * 5000 + "z"]
    vocabulary = bpe.Vocabulary(PATH)
    words = [b"the", b" the", b"a", b" e's"[:2]]
    compile_lexicon(dict(zip(words, vocabulary.merge(words))), str(tmp_path / "lexicon"))
    monkeypatch.setattr(SparkFiles, "get", staticmethod(lambda name: str(tmp_path / name)))
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)  # so that pieces are forgotten on the way
    encoder = bpe.Encoder(PATH, "lexicon")
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    for start in range(0, len(texts), 37):
        offsets, ids = encoder.encode(texts[start : start + 37])
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == expected[start : start + 37]
        assert bpe.Decoder(PATH).decode(offsets, ids) == texts[start : start + 37]


def test_odd_documents(odd_documents):
    library = Tokenizer.from_file(PATH)
    rows = bpe.encode(odd_documents, PATH, words=20, round_trip=True).collect()
    assert len(rows) == 10
    for row in rows:
        assert row["ids"] == library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["decoded"] == (row["text"] or "")


def test_decode_of_lists(spark):
    rows = spark.createDataFrame([(1, [464, 3797]), (2, None), (3, []), (4, [0xE9])], "doc_id int, ids array<int>")
    expected = [Tokenizer.from_file(PATH).decode(ids or [], skip_special_tokens=False) for ids in ([464, 3797], [], [], [0xE9])]
    assert [row["decoded"] for row in bpe.decode(rows, PATH).orderBy("doc_id").collect()] == expected


def test_no_documents(no_documents):
    assert bpe.encode(no_documents, PATH).count() == 0


def test_count_words(spark):
    docs = spark.createDataFrame([("a b  b",), ("b c",), (None,)], "text string")
    assert {r["word"]: r["count"] for r in bpe.count_words(docs, PATH).collect()} == {"a": 1, " b": 2, " ": 1, "b": 1, " c": 1}


@pytest.mark.parametrize("word", [b"aaaaaaa", b"ababababab", b"hello"])
def test_long_and_short_merges_agree(word):
    vocabulary = bpe.Vocabulary(PATH)
    assert vocabulary._merge_long(word * 3) == vocabulary.merge([word * 3])[0]
