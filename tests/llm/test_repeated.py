"""Lines that repeat in a document, however large it is."""

import random

import pytest

scans = pytest.importorskip("archivolt.llm.scans")

from archivolt.llm.trie_join import transposed


def test_repeated_and_near_keys_against_all_pairs(spark):
    rng = random.Random(8)

    def changed(key, n):
        for _ in range(n):
            i = rng.randrange(len(key) - 1)
            key = rng.choice([key[:i] + key[i + 1 :], key[:i] + rng.choice("abc") + key[i:], key[:i] + "c" + key[i + 1 :], key[:i] + key[i + 1] + key[i] + key[i + 2 :]])
        return key

    rows = []
    for doc in range(3):
        base = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 15))) for _ in range(12)]
        rows += [(doc, str(p), k, True) for k in base for p in (1, 2)]
        rows += [(doc, str(p), changed(rng.choice(base), n), p % 2 == 0) for p in range(3, 200) for n in (1, 2, 3)]
    own = [(d, k) for d, _, k, _ in rows]
    pages = {}
    for d, p, k, counts in rows:
        pages.setdefault((d, k), set()).update({p} if counts else ())
    often = {x for x, ps in pages.items() if len(ps) >= 2}
    want = {(d, k) for d, k in own if (d, k) in often or len(k) >= 8 and any(e == d and len(r) >= 8 and transposed(r, k, 2) <= 2 for e, r in often)}
    edge = spark.createDataFrame(rows, "document_id long, page_id string, key string, counts boolean")
    got = [tuple(r) for r in scans.repeated_lines(edge).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > len(often)


def test_a_title_on_few_of_many_pages_is_a_header(spark):
    title = {7: "Minutes of the Harbour Board", 90: "Minutes of the Harbour Board", 300: "Minutes of teh Harbuor Board"}
    rows = [(p, 1, p, None, None, f"{title.get(p, 'Line ' + 'abcdefghij'[p % 10] * (p // 10 + 1) + ' stands here,')}\nsome text of the page, number {p},") for p in range(1, 401)]
    pages = spark.createDataFrame(rows, "page_id long, document_id long, page_seq int, pdf_page_number int, logical_page_label string, raw_text string")
    got = {r.page_id: [(f.line, f.kind) for f in r.furniture] for r in scans.furniture_of(pages).collect()}
    assert got == {p: [(line, "header")] for p, line in title.items()}
