"""Page spans by running sums."""

import pytest

p5 = pytest.importorskip("archivolt.llm.p5")


def test_spans_either_way_round_over_gaps_and_documents(spark):
    pages = [(1, 10, 1, "a" * 1500), (2, 10, 5, "b" * 1500), (3, 10, 1_000_000_000, "c" * 1500), (4, 10, 7, None), (9, 20, 6, "d" * 5000), (8, 20, 2, ""), (7, None, 1, "x" * 9000)]
    pages = spark.createDataFrame(pages, "page_id long, document_id long, page_seq int, raw_text string")
    hits = [(100, 1, 3), (101, 3, 1), (102, 1, 2), (103, 9, None), (104, 8, None), (105, None, 3), (106, 1, 77), (107, 9, 8), (108, 1, 9), (109, 9, 1), (100, 1, 3)]
    hits = spark.createDataFrame(hits, "chunk_id long, first_page_id long, last_page_id long")
    got = {r.item_id: (r.text, list(r.bounds)) for r in p5.spans(hits, pages).collect()}
    abc = "a" * 1500 + "b" * 1500 + "c" * 1500
    assert got[100] == got[101] == (abc, [1500, 3000, 3000, 4500])
    assert set(got) == {100, 101, 103, 107, 109} and got[107] == ("d" * 5000, [0, 5000]) and got[109][0] == "d" * 5000
    assert p5.spans(hits.limit(0), pages).count() == 0 and p5.spans(hits, pages.limit(0)).count() == 0
