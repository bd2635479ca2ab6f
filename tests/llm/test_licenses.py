import random
import re
import time
from itertools import combinations

from ledgerscope.llm import licenses
from ledgerscope.llm.licenses import TEMPLATES, Scanner, _increasing, align
from ledgerscope.llm.queries import QUERIES

MIT = TEMPLATES[4][1]


def common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_longest_increasing():
    pick = random.Random(4)
    for _ in range(200):
        values = pick.sample(range(20), pick.randrange(9))
        run = [values[i] for i in _increasing(values)]
        assert run == sorted(run)
        assert len(run) == max(n for n in range(len(values) + 1) if any(list(c) == sorted(c) for c in combinations(values, n)))


def test_alignment_is_a_common_subsequence():
    pick = random.Random(5)
    for _ in range(200):
        a, b = (pick.choices("abcdefghijkl", k=pick.randrange(14)) for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= common(a, b)
    assert len(align(list("abcdef"), list("abcdef"))) == 6
    assert len(align(list("xabcdyefz"), list("abcdef"))) == 6


def test_licenses_in_texts():
    scanner = Scanner(tuple(TEMPLATES), 0.8)
    changed = MIT.replace("software", "code").replace(" sell ", " give away ")
    found = scanner.scan(f"foo {MIT}\nbar // {changed.upper()} Licensed under CC BY-NC 4.0. The license of the software is here.")
    assert [f[0] for f in found] == ["MIT", "MIT", "CC-BY-NC-4.0"]
    assert found[0][4] == 1 and 0.9 < found[1][4] < 1
    assert scanner.scan("\n".join(MIT.split())) == [("MIT", 0, len("\n".join(MIT.split())) - 1, len(scanner.words[4]), 1.0)]
    for text in (None, "", "the software is provided", MIT[: len(MIT) // 2], "license " * 5000):
        assert scanner.scan(text) == []


def test_filter_loses_nothing():
    """Every window is aligned, without the filter, on short texts."""
    template = (("t", "one two three four five six"),)
    scanner, pick = Scanner(template, 0.8), random.Random(6)
    words = template[0][1].split()
    for _ in range(300):
        text = [pick.choice(words + ["x"]) for _ in range(3)]
        for word in words:
            text += [word] * (pick.random() < 0.9) + ["x"] * (pick.random() < 0.1)
        windows = [align(text[i : i + 9], words) for i in range(len(text))]
        assert bool(scanner.scan(" ".join(text))) == any(len(w) >= 5 for w in windows)


def test_odd_documents(odd_documents, no_documents):
    assert licenses.scan(odd_documents).count() == 0
    assert licenses.scan(no_documents).count() == 0
    docs = odd_documents.replace("", "Released under the MIT License.", "text")
    row = licenses.scan(docs).first()
    assert (row["doc_id"], row["license"], row["start"], row["stop"], row["ids"]) == (3, "MIT", 0, 30, "x")


def test_whole_licenses():
    """Every whole text is found as itself, from its beginning to its end."""
    whole = licenses.whole_texts()
    scanner = Scanner(tuple(TEMPLATES + whole), 0.8)
    for name, text in TEMPLATES[-4:] + whole:
        (found,) = [f for f in scanner.scan("foo " + text + " bar") if f[0] == name]
        assert found[4] == 1 and found[2] - found[1] > 0.98 * len(text.strip()) - 4
    names = [f[0] for f in scanner.scan("Copyright (c) 2020 Bo. All rights reserved. " + dict(TEMPLATES)["AGPL-3.0-or-later"] + " " + dict(TEMPLATES)["GPL-2.0-or-later"])]
    assert names == ["Copyright-notice", "All-rights-reserved", "AGPL-3.0-or-later", "GPL-2.0-or-later"]


def test_versions_variants_and_tags():
    scanner = Scanner(tuple(TEMPLATES + licenses.tags() + licenses.whole_texts()), 0.8)
    for text, name in [
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("GNU General Public License, version 2.", "GPL-2.0"),
        ("GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("GNU Affero General Public License version 3", "AGPL-3.0"),
        ("Mozilla Public License, version 1.1", "MPL-1.1"),
        ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("MIT License", "MIT"),
    ]:
        assert [f[0] for f in scanner.scan(f"some words\n{text}\nand more of them")] == [name], text
    for text in ("Licensed under CC BY 7.0.", "SPDX-License-Identifier: Artistic-2.0", "GNU General Public License, version 9."):
        assert scanner.scan(text) == []
    both = "Licensed under CC BY 3.0. Licensed under CC BY 4.0. " * 3
    assert [f[0] for f in scanner.scan(both)] == ["CC-BY-3.0", "CC-BY-4.0"] * 3


def test_places_equal_all_windows():
    """Disjoint copies of a template with changed, added and lost words, each found at its place with its matched words."""
    pick = random.Random(11)
    template = [f"t{i}" for i in range(40)]
    scanner = Scanner((("t", " ".join(template)),), 0.8)
    for _ in range(60):
        words, expected = [], []
        for _ in range(pick.randrange(1, 4)):
            words += [f"x{pick.randrange(9)}" for _ in range(pick.randrange(30))]
            lost = set(pick.sample(range(1, 39), pick.randrange(12)))
            copy = [word for i, word in enumerate(template) if i not in lost]
            for _ in range(pick.randrange(6)):
                copy.insert(pick.randrange(1, len(copy)), "y")
            if len(lost) <= 8:
                expected.append((len(words), len(words) + len(copy), 40 - len(lost)))
            words += copy
        found = scanner.scan(" ".join(words))
        starts = [0]
        for word in words:
            starts.append(starts[-1] + len(word) + 1)
        assert [(f[1], f[2], f[3]) for f in found] == [(starts[a], starts[b] - 1, n) for a, b, n in expected]


def test_time_grows_with_the_text():
    """Words of licenses in another order: many stretches, no license."""
    pick, whole = random.Random(12), dict(licenses.whole_texts())
    scanner = Scanner(tuple(TEMPLATES + licenses.tags() + licenses.whole_texts()), 0.8)
    sentences = whole["GPL-3"].split(".") if "GPL-3" in whole else whole["GPL-3.0"].split(".")
    pick.shuffle(sentences)
    words = whole["Apache-2.0"].split() * 4
    pick.shuffle(words)
    for text in (".".join(sentences), " ".join(words)):
        began = time.process_time()
        scanner.scan(text)
        assert time.process_time() - began < 5  # seconds; it was 28 to 48


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "MIT License", "kept")], "doc_id long, text string, `Scanned Text` string")
    (row,) = licenses.scan(docs).collect()
    assert (row["license"], row["Scanned Text"]) == ("MIT", "kept")


def test_every_license_line(spark):
    """Each line of the documents that names a license or a right is in some find."""
    folder = "/root/testdata/sf0.01"
    found = {}
    for r in QUERIES["op1_patience_licenses"].build(spark, folder).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
    lines = 0
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text = doc["text"].lower()
        for line in re.finditer(r"[^\n]*\b(?:licen[sc]ed?|rights reserved|copyright)\b[^\n]*", text):
            lines += 1
            assert any(a >= line.start() and b <= line.end() for a, b in found.get(doc["doc_id"], [])), line[0]
    assert lines > 40


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    found = {(r["doc_id"], r["license"]) for r in QUERIES["op1_patience_licenses"].build(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert found == {(d["doc_id"], name) for d in docs for name, text in TEMPLATES if text.lower() in d["text"].lower()}
