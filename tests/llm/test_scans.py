"""Furniture by a model of lines, the editor on held-out noise, and what both find without their scores."""

import random
from collections import Counter

import pytest

scans = pytest.importorskip("archivolt.llm.scans")
from archivolt.llm.editor import Editor, Perceptron

WORDS = "the embassy letter receiver secretary meeting general question known report committee document urgent morning training agent station cipher office courier message official department summary national material certain reference concerning returned western information security attached northern building".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def document(rng, doc, pages, title):
    rows = []
    for p in range(1, pages + 1):
        body = [f"{prose(rng, 8)}" for _ in range(12)]
        rows.append((1000 * doc + p, doc, p, None, None, "\n".join([title.format(p), *body, *([f"- {p} -"] if doc % 2 else [])])))
    return rows


SCHEMA = "page_id long, document_id long, page_seq int, pdf_page_number int, logical_page_label string, raw_text string"


def test_titles_and_numbers_are_learned_from_repetition(spark):
    rng = random.Random(1)
    titles = ["TOP SECRET", "Minutes of the Board", "FILE 12-3456", "CONFIDENTIAL", "Harbour Inquiry", "RESTRICTED"]
    rows = [r for d in range(40) for r in document(rng, d, 6, titles[d % 6])]
    rows += document(rng, 90, 1, "TOP SECRET") + document(rng, 91, 1, prose(rng, 7).capitalize())
    got = {r.page_id: {(f.line_no, f.kind) for f in r.furniture} for r in scans.furniture_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[90001] == {(0, "header")} and 91001 not in {p for p, f in got.items() if (0, "header") in f}
    odd = [p for p, d, *_ in rows if d % 2 and d < 40]
    assert sum((13, "page_number") in got.get(p, ()) for p in odd) >= 0.95 * len(odd)
    assert sum((0, "header") in got.get(p, ()) for p, d, *_ in rows if d < 40) >= 0.95 * 240


def test_nothing_is_furniture_without_the_model():
    edge = scans.edge_of("TOP SECRET\n" + "\n".join(["some line of text here."] * 12) + "\n- 3 -")
    assert scans.page_furniture(edge, {"topsecret"}, {"3"}, 6, Perceptron()) == []


def test_a_table_line_that_looks_like_the_page_number_stays():
    lines = ["TOP SECRET", "a table", "12", "of figures", "text", "12"]
    furniture = [{"line_no": 0, "line": "TOP SECRET", "kind": "header", "down": True, "inward": "a table"}, {"line_no": 5, "line": "12", "kind": "page_number", "down": False, "inward": "text"}]
    assert scans.placed(lines, furniture, True) == {0: "header", 5: "page_number"}
    assert scans.placed(lines, furniture, False) == {0: "header", 5: "page_number"}
    assert scans.placed(["text", "12", "TOP SECRET", "a table", "12"], furniture, False) == {1: "page_number", 2: "header"}


def misread(rng, word):
    i = rng.randrange(1, len(word) - 1)
    swap = {"e": "c", "m": "rn", "t": "f", "o": "0", "n": "u", "r": "~", "i": "l", "a": "@", "s": "5"}
    return word[:i] + (swap[word[i]] if word[i] in swap else "~" + word[i]) + word[i + 1 :]


def test_the_perceptron_decides_on_held_out_noise():
    known = dict.fromkeys(WORDS, 50)
    rng = random.Random(2)
    long = [w for w in WORDS if len(w) > 5]
    seen, held = long[::2], long[1::2]
    e = Editor(known)
    e.train(Counter(misread(rng, rng.choice(seen)) for _ in range(3000)), [("sum", "-", "mary"), ("depart", "-", "ment")] * 5)
    noisy = [(w, misread(rng, w)) for w in (rng.choice(held) for _ in range(300))]
    noisy = [(w, x) for w, x in noisy if x != w and x not in known]
    right = sum((e.edit(x) or ("",))[0] == w for w, x in noisy)
    assert right >= 0.85 * len(noisy)
    e.model.weights.clear()
    e._cache.clear()
    assert sum((e.edit(x) or ("",))[0] == w for w, x in noisy) == 0
    e.joins.weights.clear()
    assert not e.joined("docu", "-", "ment")


def test_rare_known_words_are_spared(spark):
    known = dict.fromkeys(WORDS, 50)
    rng = random.Random(3)
    e = Editor(known)
    e.train(Counter(misread(rng, rng.choice([w for w in WORDS if len(w) > 5])) for _ in range(3000)), [])
    items = spark.createDataFrame([("pages", 1, "the lcttcr and the lettcr")], "item_table string, item_id long, text string")
    rare = spark.createDataFrame([("lettcr",), ("lcttcr",)], "word string")
    assert scans.repair(items, None, e, set(known), False).count() == 1
    assert scans.repair(items, None, e, set(known), False, rare).count() == 0
