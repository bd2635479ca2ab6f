"""Format-preserving pseudonyms for personal numbers, dates and addresses in texts, with SQL functions only.

A Feistel network with a key permutes each value within its format: the two halves take
turns in being shifted by a hash of the other half. So a pseudonym has the form of its value and is valid where
the value was (card check digits, IBAN check digits, calendar dates), different values have different pseudonyms, and equal
values have equal ones in every document. Values that are not valid stay as they are.

| kind | valid if | permuted within |
| --- | --- | --- |
| email | the pattern | letters and digits of the local part, each in its class |
| card | 13 to 19 digits with a right check digit | digits; the check digit is computed anew |
| iban | the country's length, and the remainder of 97 is 1 | digits of the account part; the check digits are computed anew |
| phone | the pattern, up to the plan's length where it is fixed | the digits after the country code |
| ssn | area 001-899 but 666, group and serial not 0 | all such numbers |
| ip | four numbers up to 255 | all addresses |
| date | a day from 1904 to 2099; y-m-d, m/d/y, d/m/y or d.m.y | such days; d/m/y with a day over 12 among those |

A null text stays null, with no values. Repeated rows get the same texts. Other columns are kept;
columns named ``pseudonyms`` are replaced.
"""

from __future__ import annotations

import calendar
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, CYCLES, CYCLE_DAYS = "1904-01-01", 49, 1461  # 49 four-year cycles up to 2099
LATE_DAYS = 1461 - 48 * 12  # days of a cycle after the 12th of a month

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
# The registered length of an IBAN by country, and the digits after the country code where a plan has one number of them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
PHONE_DIGITS = {8: "45 47 65 852 853", 9: "31 33 34 41 48 61 351 420", 10: "7 52 57 90 91"}


def _ibans() -> str:
    tails = {n: rf"(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n in IBAN_LENGTHS}
    known = [rf"(?:{'|'.join(codes.split())})\d{{2}}{tails[n]}" for n, codes in IBAN_LENGTHS.items()]
    every = "|".join(" ".join(IBAN_LENGTHS.values()).split())
    other = rf"(?!{every})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join([*known, other])})"


def _phones() -> str:
    """By the length of the plan; else groups joined by hyphens or by dots, to which nothing after a blank belongs; else all groups."""
    planned = "|".join(rf"\+(?:{'|'.join(codes.split())})(?:[ .-]?\(?\d\)?){{{n}}}" for n, codes in PHONE_DIGITS.items())
    planned = rf"\+1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|{planned}"
    start = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}"
    joined = "|".join(rf"{start}(?:{mark}\d{{2,4}}){{2,4}}" for mark in ("-", r"\."))
    return rf"(?=\+)(?:{planned}|{joined}|{start}(?:[ .-]?\d{{2,4}}){{1,4}})|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}"


SHAPES = {
    "iban": _ibans(),
    "date": r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "ip": rf"(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.\d)",
    "card": r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}".replace("([ -])", "[ -]").replace(r"\1", "[ -]").replace(r"\2", "[ -]"),
    "phone": _phones(),
}
STAMPED = r"\d{4}-\d{2}-\d{2}(?=[Tt]\d{2})"  # the day of a timestamp
PATTERN = f"{EMAIL}|(?<![A-Za-z0-9])(?:{STAMPED}|(?:{'|'.join(f'(?:{shape})' for shape in SHAPES.values())})(?![A-Za-z0-9]))"


def _keyed(key: str, tweak: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), half.cast("string"), F.lit(key)), 256)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas in ``use`` need it for each character."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted_number(value: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A keyed permutation of the whole numbers below ``a * b``."""

    def step(state: Column, turn: Column) -> Column:
        number = lambda half: F.conv(F.substring(_keyed(key, tweak, turn, half), 1, 15), 16, 10).cast("long")
        left = F.struct(((state["l"] + number(state["r"])) % a).alias("l"), state["r"].alias("r"))
        right = F.struct(state["l"].alias("l"), ((state["r"] + number(state["l"])) % b).alias("r"))
        return F.when(turn % 2 == 1, left).otherwise(right)

    first = _let(value.cast("long"), lambda whole: F.struct(F.floor(whole / b).cast("long").alias("l"), (whole % b).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step, lambda s: s["l"] * b + s["r"])


def _each(text: Column, change) -> Column:
    """``text`` with every character changed; ``change`` takes the character and its place from 1."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: change(F.substr(text, i, F.lit(1)), i)), "")


def _shifted(text: Column, hashed: Column) -> Column:
    def change(letter: Column, place: Column) -> Column:
        code = F.ascii(letter)
        shift = F.conv(F.substr(hashed, 2 * place - 1, F.lit(2)), 16, 10).cast("int")
        ring = lambda low, size: F.char(low + (code - low + shift) % size)
        return F.when(code.between(97, 122), ring(97, 26)).when(code.between(65, 90), ring(65, 26)).when(code.between(48, 57), ring(48, 10)).otherwise(letter)

    return _each(text, change)


def _shifted_by(text: Column, hashed: Column) -> Column:
    return _let(hashed, lambda known: _shifted(text, known))


def permuted_text(text: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of texts up to 64 characters; letters and digits stay in their class, others as they are."""

    def step(state: Column, turn: Column) -> Column:
        left = F.struct(_shifted_by(state["l"], _keyed(key, tweak, turn, state["r"])).alias("l"), state["r"].alias("r"))
        right = F.struct(state["l"].alias("l"), _shifted_by(state["r"], _keyed(key, tweak, turn, state["l"])).alias("r"))
        return F.when(turn % 2 == 1, left).otherwise(right)

    def halves(known: Column) -> Column:
        half = F.floor(F.length(known) / 2).cast("int")
        return F.struct(F.substr(known, F.lit(1), half).alias("l"), F.substr(known, half + 1, F.length(known)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), _let(text, halves), step, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced by ``digits`` in order."""

    def place_in(known: Column) -> Column:
        before = lambda place: F.length(_digits(F.substr(shape, F.lit(1), place)))
        return _each(shape, lambda letter, place: F.when(letter.rlike("[0-9]"), F.substr(known, before(place), F.lit(1))).otherwise(letter))

    return _let(digits, place_in)


def _check_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right, every second one doubled, starting with place ``doubled``; a multiple of 10 if valid."""


    def total(known: Column) -> Column:
        def add(total: Column, place: Column) -> Column:
            digit = F.substr(known, place, F.lit(1)).cast("int")
            twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
            return total + F.when(place % 2 == doubled % 2, twice).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.length(known)), F.lit(0), add)

    return _let(F.reverse(digits), total)


def _card(value: Column, key: str) -> Column:
    def hidden(digits: Column) -> Column:
        body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        whole = _let(body, lambda known: F.concat(known, ((10 - _check_sum(known, 1) % 10) % 10).cast("string")))
        return F.when(_check_sum(digits, 2) % 10 == 0, _filled(value, whole))

    return _let(_digits(value), hidden)


def _remainder(text: Column) -> Column:
    """The remainder of 97 of an IBAN whose first four characters were moved to the end."""


    def rest_of(known: Column) -> Column:
        def add(rest: Column, place: Column) -> Column:
            letter = F.substr(known, place, F.lit(1))
            return F.when(letter.rlike("[0-9]"), (rest * 10 + F.ascii(letter) - 48) % 97).otherwise((rest * 100 + F.ascii(letter) - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(known)), F.lit(0), add)

    return _let(text, rest_of)


def _iban(value: Column, key: str) -> Column:
    def hidden(compact: Column) -> Column:
        country, account = F.substr(compact, F.lit(1), F.lit(2)), F.substr(compact, F.lit(5), F.length(compact))

        def whole(new: Column) -> Column:
            check = F.lpad((98 - _remainder(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
            return _filled(value, F.concat(check, _digits(new)))

        new = _let(account, lambda known: _filled(known, permuted_text(_digits(known), key, "iban")))
        return F.when(_remainder(F.concat(account, F.substr(compact, F.lit(1), F.lit(4)))) == 1, _let(new, whole))

    return _let(F.replace(value, F.lit(" "), F.lit("")), hidden)


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    marked = F.length(F.regexp_extract(value, r"^\+(\d{1,3})[ .(-]", 1))
    code = F.when(~value.startswith("+"), 0).when(marked > 0, marked).when(value.rlike(r"^\+[17]"), 1).otherwise(2)
    own = permuted_text(F.substr(digits, code + 1, F.length(digits)), key, "phone")
    return _filled(value, F.concat(F.substr(digits, F.lit(1), code), own))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("long") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def shown(new: Column) -> Column:
        head = F.floor(new / 9999).cast("long")
        new_area = F.floor(head / 99).cast("long")
        numbers = [(new_area + F.when(new_area >= 665, 2).otherwise(1), 3), (head % 99 + 1, 2), (new % 9999 + 1, 4)]
        return F.concat_ws("-", *(F.lpad(n.cast("string"), width, "0") for n, width in numbers))

    return F.when(valid, _let(permuted_number(number, 898 * 99, 9999, key, "ssn"), shown))


def _ip(value: Column, key: str) -> Column:
    part = [F.split(value, r"\.")[i].cast("long") for i in range(4)]
    new = permuted_number(((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3], 65536, 65536, key, "ip")
    return _let(new, lambda n: F.concat_ws(".", *((F.floor(n / 256**i).cast("long") % 256).cast("string") for i in (3, 2, 1, 0))))


def _date(value: Column, key: str) -> Column:
    numbers = F.split(value, "[-/.]")
    iso, slashed = value.contains("-"), value.contains("/")
    late = slashed & (numbers[0].cast("int") > 12)
    year = F.when(iso, numbers[0]).otherwise(numbers[2]).cast("int")
    month = F.when(iso | ~slashed | late, numbers[1]).otherwise(numbers[0]).cast("int")
    day = F.when(iso, numbers[2]).when(slashed & ~late, numbers[1]).otherwise(numbers[0]).cast("int")
    read = F.struct(year.alias("y"), month.alias("m"), day.alias("d"), late.alias("late"))
    start = F.lit(FIRST_DAY).cast("date")
    lengths = F.array(*(F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))
    ends = list(accumulate(calendar.monthrange(1904 + i // 12, i % 12 + 1)[1] - 12 for i in range(48)))

    def moved(at: Column) -> Column:
        number = F.datediff(F.make_date(at["y"], at["m"], at["d"]), start)
        # Days over 12 only: without the twelve first days of each month up to this one; back by the month's place in its cycle.
        rank = permuted_number(number - 12 * ((at["y"] - 1904) * 12 + at["m"]), CYCLES, LATE_DAYS, key, "late date")
        month_of = lambda r: F.floor(r / LATE_DAYS) * 48 + F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= r % LATE_DAYS))
        days = F.when(at["late"], _let(rank, lambda r: r + 12 * (month_of(r) + 1))).otherwise(permuted_number(number, CYCLES, CYCLE_DAYS, key, "date"))
        return F.date_add(start, days.cast("int"))

    def shown(new: Column) -> Column:
        short = F.length(value) < 10
        form = F.when(iso, F.date_format(new, "yyyy-MM-dd"))
        for test, padded, plain in ((late, "dd/MM/yyyy", "d/M/yyyy"), (slashed, "MM/dd/yyyy", "M/d/yyyy"), (F.lit(True), "dd.MM.yyyy", "d.M.yyyy")):
            form = form.when(test & short, F.date_format(new, plain)).when(test, F.date_format(new, padded))
        return form

    def hidden(at: Column) -> Column:
        longest = F.element_at(lengths, at["m"]) + F.when((at["m"] == 2) & (at["y"] % 4 == 0), 1).otherwise(0)
        valid = at["y"].between(1904, 2099) & at["m"].between(1, 12) & (at["d"] > 0) & (at["d"] <= F.when(at["m"].between(1, 12), longest).otherwise(0))
        return F.when(valid, _let(moved(at), shown))

    return _let(read, hidden)


def _email(value: Column, key: str) -> Column:
    place = F.instr(value, "@")
    return F.concat(permuted_text(F.substr(value, F.lit(1), place - 1), key, "email"), F.substr(value, place, F.length(value)))


MAKERS = {"iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone}


def pseudonym(value: Column, key: str) -> Column:
    """``(kind, hidden)`` of a value found by ``PATTERN``; both null if it is not valid."""
    kind = F.when(value.contains("@"), "email")
    hidden = F.when(value.contains("@"), _email(value, key))
    for name, shape in SHAPES.items():
        kind = kind.when(value.rlike(f"^(?:{shape})$"), name)
    chosen = kind
    for name, make in MAKERS.items():
        hidden = hidden.when(value.rlike(f"^(?:{SHAPES[name]})$"), make(value, key))
    return _let(hidden, lambda known: F.struct(F.when(known.isNotNull(), chosen).alias("kind"), known.alias("hidden")))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the values in ``text`` hidden, and ``pseudonyms``: kind and pseudonym of each, in order."""
    if not key:
        raise ValueError("a key is needed")
    whole = F.col(text)
    found = F.regexp_extract_all(whole, F.lit(PATTERN), F.lit(0))
    pieces = F.split(whole, PATTERN, -1)
    # A text without a digit or an at sign is not searched.
    some = whole.rlike("[0-9@]")
    parts = docs.drop("pseudonyms").withColumn(
        "pseudonyms", F.when(some, F.transform(found, lambda value: F.struct(value.alias("value"), pseudonym(value, key).alias("new")))).otherwise(F.array())
    )
    shown = F.transform("pseudonyms", lambda p: F.coalesce(p["new"]["hidden"], p["value"]))
    joined = F.zip_with(F.concat(F.array(F.lit("")), shown), pieces, lambda new, piece: F.concat(new, piece))
    hidden = F.when(F.size("pseudonyms") > 0, F.array_join(joined, "")).otherwise(whole)
    valid = F.filter("pseudonyms", lambda p: p["new"]["hidden"].isNotNull())
    listed = F.transform(valid, lambda p: F.struct(p["new"]["kind"].alias("kind"), p["new"]["hidden"].alias("pseudonym")))
    return parts.withColumns({text: hidden, "pseudonyms": listed})
