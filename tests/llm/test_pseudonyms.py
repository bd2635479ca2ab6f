import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import pseudonyms as p


def shown(spark, texts, key="k"):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r["text"] for r in p.pseudonymise(table, key).orderBy("doc_id").collect()]


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def plain_text(value, key, tweak):
    keyed = lambda turn, half: hashlib.sha256("|".join([key, tweak, str(turn), half, key]).encode()).hexdigest()

    def shifted(text, hexed):
        out = ""
        for i, c in enumerate(text):
            s = int(hexed[2 * i : 2 * i + 2], 16)
            low, size = (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if "0" <= c <= "9" else (0, 0)
            out += chr(low + (ord(c) - low + s) % size) if size else c
        return out

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for turn in range(1, p.ROUNDS + 1):
        if turn % 2:
            left = shifted(left, keyed(turn, right))
        else:
            right = shifted(right, keyed(turn, left))
    return left + right


def plain_number(value, a, b, key, tweak):
    left, right = divmod(value, b)
    for turn in range(1, p.ROUNDS + 1):
        half = right if turn % 2 else left
        number = int(hashlib.sha256("|".join([key, tweak, str(turn), str(half), key]).encode()).hexdigest()[:15], 16)
        left, right = ((left + number) % a, right) if turn % 2 else (left, (right + number) % b)
    return left * b + right


def test_networks_against_python(spark):
    texts = ["a", "ab", "Zz9._-x", "1234567890123456789", "q" * 64, "", "é1"]
    table = spark.createDataFrame([(t,) for t in texts], "t string").select("t", p.permuted_text(F.col("t"), "key", "email").alias("h"))
    assert {r["t"]: r["h"] for r in table.collect()} == {t: plain_text(t, "key", "email") for t in texts}
    numbers = spark.range(0, 7 * 13).select("id", p.permuted_number(F.col("id"), 7, 13, "key", "x").alias("h")).collect()
    assert {r["id"]: r["h"] for r in numbers} == {i: plain_number(i, 7, 13, "key", "x") for i in range(91)}
    assert sorted(r["h"] for r in numbers) == list(range(91))


def test_values_keep_their_format(spark):
    text = (
        "call +1 (988) 555-2485 or (212) 555-1234, card 4111 1111 1111 1111 and 378282246310005; ssn 123-45-6789 ip 42.144.35.254. "
        "born 1980-02-29, 12/25/1999, 25/12/1999, 31.1.2001; iban DE89 3704 0044 0532 0130 00 Bo.42@mail8.example.com x"
    )
    (new,) = shown(spark, [text])
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d+", "9", s)))
    assert shape(new) == shape(text)
    for value in re.findall(r"\d[\d .()/-]{6,}\d", text):
        assert value not in new
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{15}", new)
    assert all(luhn(card) % 10 == 0 for card in cards[:2])
    iban = re.search(r"DE\d\d[\d ]+", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "DE" in new and "@mail8.example.com" in new and "+1 (" in new


def test_links_and_keys(spark):
    first, second, other = shown(spark, ["a 4111 1111 1111 1111 b", "4111 1111 1111 1111"]) + shown(spark, ["4111 1111 1111 1111"], "other key")
    assert first == f"a {second} b" and second != other
    with pytest.raises(ValueError):
        shown(spark, ["x"], "")


def test_neighbours_stay_apart(spark):
    """Equal values before different neighbours: the value alone is hidden, in the same way."""
    values = {
        "AT611904300234573201": [" BIC GIBAATWW", " 2024", ".", " AB12 x"], "ES9121000418450200051332": [" 2024", " and"], "DE89 3704 0044 0532 0130 00": [" 12", " A"],
        "+1 (293) 555-9179": [" 12", " 2024", ", x", ""], "+1 293.555.9179": [" 77", ""], "+33 1 23 45 67 89": [" 12", ""], "+49 30-1234-5678": [" 12", ""], "+44 20 7946-0958": ["", "."],
        "2024-01-31": ["T10:00:00Z", "t10:00", " 10:00", ""],
    }
    texts = [f"x {value}{after}" for value, others in values.items() for after in others]
    hidden = iter(shown(spark, texts))
    for value, others in values.items():
        new = {after: next(hidden) for after in others}
        assert all(text.endswith(after) for after, text in new.items())
        alone = {text[: len(text) - len(after)] for after, text in new.items()}
        assert len(alone) == 1 and alone != {f"x {value}"}


def test_invalid_values_stay(spark):
    texts = ["4111 1111 1111 1112", "2021-02-30", "1900-01-01", "13/13/2020", "000-12-3456", "666-12-3456", "300.1.1.1", "v1.2.3.4.5", "DE00 3704 0044 0532 0130 00", "x0641917ea4e9", "Version 2.0"]
    assert shown(spark, texts) == texts


def test_dates_are_permuted(spark):
    days = spark.sql("SELECT explode(sequence(date'1990-01-01', date'1997-12-31')) AS d")
    forms = {"iso": "yyyy-MM-dd", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy", "dot": "d.M.yyyy"}
    for name, form in forms.items():
        own = days.where("day(d) > 12") if name == "eu" else days
        table = own.select("d", F.date_format("d", form).alias("text"))
        hidden = p.pseudonymise(table, "k").select("d", "text", F.to_date("text", form).alias("new")).collect()
        assert len({r["new"] for r in hidden}) == len(hidden)
        assert all(1904 <= r["new"].year <= 2099 for r in hidden)
        if name == "eu":
            assert all(r["new"].day > 12 for r in hidden)


def test_marks_in_texts(spark):
    value = "a.b77@x.org 10.20.30.40, 4111 1111 1111 1111@ 5551234567890@mail.net"
    (plain,), (marked,) = shown(spark, [value]), shown(spark, ["\x01" + value + "\x01\x01"])
    assert marked == "\x01" + plain + "\x01\x01"
    assert "77" not in plain.split("@")[0] or plain.split("@")[0] != "a.b77"
    assert plain.endswith("@mail.net") and "5551234567890" not in plain and len(plain.split()) == len(value.split())


def test_odd_documents(odd_documents, no_documents):
    out = p.pseudonymise(odd_documents, "k")
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in odd_documents.collect())))
    assert all(r["pseudonyms"] == [] for r in out.collect())
    assert p.pseudonymise(no_documents, "k").count() == 0


def test_no_python_in_the_plan(spark):
    plan = p.pseudonymise(spark.createDataFrame([("x",)], "text string").cache(), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
