"""Operators for training data: brute force, exact round trips, and defined results on odd input."""

import random
import re
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("archivolt.llm")

from archivolt.llm import abuse, mixing, names, neardup, neighbours, scans, splitting, terms, tokens, trie_join
from archivolt.llm.editor import Editor
from archivolt.llm.forest import fit


# terms -------------------------------------------------------------------------------------------------------------


def _terms(spark, rows):
    return spark.createDataFrame(rows, "alias_norm string, document_id long, df_chunks int, updated_at timestamp_ntz, term string")


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_term_counts_spilled_or_not(spark, limit):
    rng = random.Random(1)
    at = lambda k: datetime(2020, 1, 1 + k)
    rows = [(rng.choice(["Hot", "hot ", "h  ot", "cold", f"t{rng.randrange(40)}"]), rng.randrange(30), rng.randrange(4), at(rng.randrange(9)), "clash") for _ in range(1500)]
    rows += [(None, 1, 1, at(0), ""), ("  ", 1, 1, at(0), ""), ("Hot", None, 2, None, ""), ("x", 1, None, None, "")] + rows[:50]
    newest: dict = {}
    for a, d, n, t, _ in rows:
        if a and a.strip():
            k = (" ".join(a.split()).lower(), d)
            v = (t or datetime(1, 1, 1), n or 0)
            newest[k] = max(newest.get(k, v), v)
    want: dict = {}
    for (a, d), (_, n) in newest.items():
        c, m = want.get(a, (0, 0))
        want[a] = (c + n, m + (d is not None))
    got = {r.term: (r.n_chunks, r.n_docs) for r in terms.term_counts(_terms(spark, rows), "alias_norm", "document_id", "df_chunks", "updated_at", limit).collect()}
    assert got == want


def test_term_counts_of_nothing(spark):
    assert terms.term_counts(_terms(spark, []), "alias_norm", "document_id", "df_chunks", "updated_at").count() == 0


# vectors -----------------------------------------------------------------------------------------------------------


def _vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x[700:] = x[:800] + rng.normal(scale=0.2, size=(800, 64))
    return x.astype(np.float32)


def test_forest_reaches_every_leaf_once():
    x = _vectors()
    f = fit(x, 16, 4)
    got = f.search(x, 4)
    assert (got >= 0).all() and all(len(set(r)) == 4 for r in got.tolist())
    assert f.search(x[:3], 10_000).max() < f.leaves


def test_nearest_against_brute_force(spark):
    x = _vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 64), (9003, [1.0] * 63), (9004, [float("nan")] * 64), (None, x[0].tolist()), (9005, [])]
    copies = [(i, (x[3] * 2).tolist()) for i in range(8000, 8020)]
    df = spark.createDataFrame(rows + copies + copies[:3], "chunk_id long, embedding array<float>")
    got = {(r.a, r.b) for r in neighbours.nearest(df, "chunk_id", "embedding", 10, 0.92).collect()}
    ids = np.array([i for i, _ in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(int(ids[i]), int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:10] if s[i, j] >= 0.92 and 3 not in (i, j)}
    assert len(want & got) >= 0.9 * len(want)
    same = {b for a, b in got if a == 8015}
    assert same == {3, *range(8000, 8009)} and all(a < 9000 and b < 9000 for a, b in got)


def test_nearest_of_nothing(spark):
    assert neighbours.nearest(spark.createDataFrame([], "chunk_id long, embedding array<float>"), "chunk_id", "embedding").count() == 0


# scans -------------------------------------------------------------------------------------------------------------

KNOWN = {w: 50 for w in "the letter was modern and about receiver secretary meeting general question known report committee half-brother half brother summary document urgent morning training".split()}


def _editor():
    from collections import Counter

    odd = Counter()
    rng = random.Random(3)
    for _ in range(400):
        w = rng.choice([k for k in KNOWN if len(k) > 5])
        i = rng.randrange(len(w))
        odd[w[:i] + {"e": "c", "m": "rn", "t": "f", "o": "0"}.get(w[i], w[i]) + w[i + 1 :]] += 1
        odd[w[:i] + "~" + w[i:]] += 1
    e = Editor(dict(KNOWN))
    e.train(odd, [("sum", "-", "mary"), ("half", "-", "brother"), ("docu", "–", "ment"), ("ur", "-", "gent")] * 10)
    return e


def test_editor_repairs_held_out_words():
    e = _editor()
    assert e.edit("lettcr")[0] == "letter" and e.edit("rnorning")[0] == "morning" and e.edit("que~stion")[0] == "question" and e.edit("rePort")[0] == "report"
    assert e.edit("zebrafish") is None
    assert e.joined("rec", "-", "eiver") and not e.joined("half", "-", "brother")


def test_repair_of_a_page():
    lines = ["FILE 12-3456    p. 3", "", "The lettcr was a sum-", "mary of the half-", "brother and the ques–", "tion.", "", "Second", "para.", "- 3 -"]
    furniture = {0: "header", 9: "page_number"}
    found, fixed, joins = scans.judge(lines, furniture, _editor(), set(KNOWN))
    assert found == [(0, "header"), (2, "hyphen"), (2, "misread"), (4, "hyphen"), (9, "page_number")]
    assert scans.paragraphs(fixed, furniture, joins) == "The letter was a summary of the half- brother and the question.\n\nSecond para."


def test_scan_queries_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, 1, 1, None, None, None), (2, 1, 2, None, None, ""), (3, None, None, None, None, "FILE 1-22\ntext\n" * 3), (3, None, None, None, None, "x" * 50_000)], "page_id long, document_id long, page_seq int, pdf_page_number int, logical_page_label string, raw_text string")
    furniture = scans.furniture_of(pages)
    assert {r.page_id for r in furniture.collect()} <= {3}
    assert scans.furniture_of(pages.limit(0)).count() == 0
    items = pages.select(F.lit("pages").alias("item_table"), F.col("page_id").alias("item_id"), F.col("raw_text").alias("text"), F.lit("z").alias("kind"))
    assert scans.repair(items, None, _editor(), set(KNOWN), True).count() == 3
    assert scans.repair(items.limit(0), None, _editor(), set(KNOWN), False).count() == 0
    assert scans.lexicon(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), "text", "lang")[:2] == ({}, set())


# splitting ---------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text("ab. \n\f", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_pieces_make_up_the_text(text, limit, overlap):
    got = splitting.split(text, limit, overlap)
    assert "".join(text[b:c] for _, b, c in got) == text
    at = 0
    for a, b, c in got:
        assert b == at and a == max(0, b - overlap) and c - a <= limit and (c > b or not text)
        at = c


def test_cuts_prefer_strong_boundaries():
    text = ("word " * 100).strip() + "\n\n" + ("more. " * 60).strip()
    cuts = splitting.cut_points(text, 520, 20)
    assert text[cuts[0] - 2 : cuts[0]] == "\n\n"
    assert all(text[c - 1] in " \n" for c in cuts[1:-1])
    assert splitting.cut_points("x" * 25, 10, 2) == [10, 18, 25]
    assert splitting.cut_points("a" * 30, 20, 5, bounds=[12]) == [12, 27, 30]
    with pytest.raises(ValueError):
        splitting.split("a", 5, 5)


def test_pieces_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "é" * 4000, "c"), (4, "é" * 4001, "c"), (4, "é" * 4001, "c"), (None, "y " * 3000, "c")], "id long, text string, piece string")
    got = [(r.id, r.piece_no, r.start_at, r.end_at) for r in splitting.pieces(df, ["id"], "text").collect()]
    assert got.count((4, 0, 0, 4000)) == 2 and got.count((4, 1, 3800, 4001)) == 2 and {r[0] for r in got} == {4, None}
    assert splitting.pieces(df.limit(0), ["id"], "text").count() == 0


# names -------------------------------------------------------------------------------------------------------------


def test_trie_join_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 12))) for _ in range(60)]

    def changed(s):
        i = rng.randrange(len(s) - 1)
        return rng.choice([s[:i] + s[i + 1 :], s[:i] + "b" + s[i:], s[:i] + "c" + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :]])

    own = sorted({x for s in base for x in (s, changed(s), changed(changed(s)))})
    rows = [(s, g) for g in "xy" for s in own] + [(None, "x"), ("", "x"), (own[0], "x"), (own[1], None)]
    most = lambda a, b: trie_join.allowed(min(len(a), len(b)))
    want = {(a, b): d for a in own for b in own if a < b and (d := trie_join.transposed(a, b, 2)) <= most(a, b)}
    for block in (20_000, 5):
        got = trie_join.near_strings(spark.createDataFrame(rows, "s string, g string"), "s", "g", block).collect()
        assert {(r.a, r.b): r.distance for r in got if r.g == "x"} == want == {(r.a, r.b): r.distance for r in got if r.g == "y"}
        assert len(got) == 2 * len(want)
    assert trie_join.near_strings(spark.createDataFrame([], "s string"), "s").count() == 0
    assert trie_join.transposed("ewdard", "edward", 2) == 1 and trie_join.transposed("abc", "xyz", 2) > 2


def test_names_outside_the_list_are_linked(spark):
    groups = [["klaus fuchs", "fuchs klaus", "klaus fuchz", "dr klaus fuchs"], ["ethel rosenberg", "ethel rosenburg", "rosenberg ethel"], ["hiroshi tanaka", "hirosih tanaka"], ["giovanni rossi", "rossi giovanni"], ["robert lee", "bob lee"], ["maria de los angeles quijano", "quijano maria angeles los"]]
    other = ["klaus barbie", "ethel merman", "military camera", "camera military", "hiroshi yamada", "", None]
    found = names.variants(names.entities(spark.createDataFrame([(n,) for g in groups for n in g] + [(n,) for n in other], "name string")))
    got = {(r.name_a, r.name_b) for r in found.collect()}
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_permuted_names_against_all_orders(spark):
    from itertools import permutations

    rng = random.Random(4)
    parts = ["klaus", "fuchs", "tanaka", "hiroshi", "rossini", "giovanni", "rosenberg"]
    own = set()
    for _ in range(60):
        a = rng.sample(parts, rng.choice((2, 3)))
        if rng.random() < 0.6:
            i = rng.randrange(len(a))
            a[i] = a[i][:2] + "x" + a[i][3:]
        own.add(" ".join(a))
    near = lambda x, y: x == y or trie_join.transposed(x, y, 2) <= trie_join.allowed(min(len(x), len(y)))
    alike = lambda a, b: len(a) == len(b) and any(all(map(near, a, p)) and sum(x != y for x, y in zip(a, p)) <= 2 for p in permutations(b))
    want = {(a, b) for a in own for b in own if a != b and alike(a.split(), b.split())}
    got = {(r.a, r.b) for r in names.permuted(spark.createDataFrame([(n, n) for n in own], "name string, words string")).collect()}
    assert got == want and want


@pytest.mark.parametrize(
    "name, read",
    [
        ("col edward logrilasek", ("p", "logrilasek", "edward", "")), ("logrilasek ned", ("p", "logrilasek", "edward", "")), ("ewdard k logrilasek", ("p", "logrilasek", "edward", "k")), ("edwardlogrilasek", ("p", "logrilasek", "edward", "")),
        ("mrs logrilasek", ("p", "logrilasek", "", "")), ("the fujusodin mng labs of", ("o", "fujusodin", "laboratories", "mining")), ("typewritten office", None), ("ibid", None), ("", None), ("a b c", None),
    ],
)
def test_reading_of_names(name, read):
    assert (got := names.parse(name)) == (read and (*read, got[4]))


def test_variants_are_linked_and_bearers_kept_apart(spark):
    own = ["edward logrilasek", "logrilasek, edward", "ned logrilasek", "e logrilasek", "edward logrilsaek", "rosalind logrilasek", "mrs logrilasek", "totikoter import company", "import co totikoter", "totikoter mining co", "totikoter company", "typewritten office", "office typewritten"]
    found = names.variants(names.entities(spark.createDataFrame([(n,) for n in own + [None, ""] + own[:2]], "name string")))
    got = {(r.name_a, r.name_b) for r in found.collect()}
    same = {"edward logrilasek", "logrilasek, edward", "ned logrilasek", "e logrilasek", "edward logrilsaek"}
    want = {(a, b) for a in same for b in same if a < b} | {("import co totikoter", "totikoter import company")}
    assert got == want
    assert names.entities(spark.createDataFrame([], "name string")).count() == 0


# near duplicates ---------------------------------------------------------------------------------------------------


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}x" for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 120))) for _ in range(60)]
    for i in range(25):
        w = texts[i].split()
        for _ in range(rng.randint(0, len(w) // 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    w = texts[0].split()
    texts += [" ".join(w[40:] + w[:40]), texts[1], texts[1].replace(" ", "\n"), None, "", "short", texts[2] + " " + texts[3]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[5]], "key int, text string")
    member, links = neardup.near_duplicates(df, "key", "text")
    words = {i: neardup.words_of(t, {}) for i, t in rows if t and len(t) >= 300}
    share = lambda a, b: neardup.shared_words(np.array(a), np.array(b)) / max(len(a), len(b))
    want = {(a, b) for a in words for b in words if a < b and share(words[a], words[b]) >= 0.8}
    got = {(r.a, r.b) for r in neardup.expanded(member, links).collect()}
    assert got == want and len(want) > 10
    assert member.count() == len(words)
    g = {r.key: r for r in neardup.groups(member, links).collect()}
    copy = next(i for i, t in rows if t == texts[1] and i > 1)
    assert g[1].group == g[copy].group and g[1].copies >= 2
    nothing, none = neardup.near_duplicates(df.limit(0), "key", "text")
    assert nothing.count() == 0 and none.count() == 0 and neardup.groups(nothing, none).count() == 0


def test_confusions_of_scanning_are_one_word():
    assert neardup.canonical("modern") == neardup.canonical("rnodcrn") and neardup.canonical("1945") != neardup.canonical("1946")


# tokens ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoders():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    own = tokens.encoder(tokens.vocabulary_path())
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_the_public_library(encoders, text):
    own, other = encoders
    assert own.ids(text) == other.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 4000, " " * 3001, "ab" * 900, "\n" * 500, "<|endoftext|>", "​é" * 300, "x" * 65, "ß 12 it's I'll\r\n"])
def test_ids_of_long_and_special_texts(encoders, text):
    own, other = encoders
    assert own.ids(text) == other.encode_ordinary(text)
    assert b"".join({v: k for k, v in own.ranks.items()}[i] for i in own.ids(text)).decode() == text


def test_encoding_of_rows(spark, encoders):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " two\n", "x"), (3, " two\n", "x"), (None, "a", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect()))
    assert got == [(0, encoders[0].ids("a")), (1, []), (2, []), (3, encoders[0].ids(" two\n")), (3, encoders[0].ids(" two\n"))]
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.n_tokens for r in tokens.count_tokens(df, "doc_id", "text", keep=("ids",)).collect())[:2] == [0, 0]


# mixing ------------------------------------------------------------------------------------------------------------


def _mix_tables(spark):
    rng = random.Random(9)
    docs = [(i, "big" if i % 3 else "middle", rng.randint(1, 40)) for i in range(3000)] + [(5000 + i, "small", 10) for i in range(30)] + [(6000, None, 9), (6001, "other", 9), (6002, "big", None), (6003, "big", 0)]
    targets = [("big", 0.5, 1), ("middle", 0.3, 1), ("small", 0.1, 4), ("absent", 0.1, 9)]
    return spark.createDataFrame(docs, "doc_id long, source string, n_tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_mix_holds_the_shares(spark):
    docs, targets = _mix_tables(spark)
    mixed = mixing.mix(docs, targets, budget=mixing.EVEN)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert got["absent"].n_tokens == 0 and set(got) == {"big", "middle", "small", "absent"}
    for name, share in (("big", 0.5 / 0.9), ("middle", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert abs(got[name].actual_share - share) < 0.01
    assert got["small"].passes == 4 and got["small"].n_docs == 30
    rows = mixed.collect()
    assert [r.virtual_finish for r in rows] == sorted(r.virtual_finish for r in rows)
    half = rows[: len(rows) // 2]
    total = sum(r.n_tokens for r in half)
    assert abs(sum(r.n_tokens for r in half if r.source == "big") / total - 0.5 / 0.9) < 0.02
    assert max(r.copy_no for r in rows) == 3 and len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)


def test_a_mix_uses_what_there_is(spark):
    docs, targets = _mix_tables(spark)
    listed = {s: sum(r.n_tokens or 0 for r in docs.collect() if r.source == s) for s in ("big", "middle", "small")}
    mixed = mixing.mix(docs, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets, sizes=docs).collect()}
    budget = sum(listed.values())
    assert {r.budget for r in got.values()} == {budget} and budget - 100 <= sum(r.n_tokens for r in got.values()) <= budget
    assert got["small"].n_tokens == 4 * listed["small"] and got["small"].shortfall > 0 and got["absent"].shortfall > 0
    assert got["big"].n_left_out == listed["big"] - got["big"].n_tokens >= 0 and got["big"].passes == 1
    # the sources that don't run out keep their weights to each other
    assert got["middle"].n_tokens == listed["middle"] or abs(got["big"].n_tokens / got["middle"].n_tokens - 0.5 / 0.3) < 0.02
    assert mixing.shares(mixing.mix(docs.limit(0), targets), targets, sizes=docs.limit(0)).count() == 4


def test_mix_beyond_what_there_is_and_of_nothing(spark):
    docs, targets = _mix_tables(spark)
    got = {r.source: r for r in mixing.shares(mixing.mix(docs, targets, budget=1e9), targets).collect()}
    assert got["small"].n_tokens == 1200 and got["big"].passes == 1
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert {r.actual_share for r in mixing.shares(mixing.mix(docs.limit(0), targets), targets).collect()} == {None}


# abuse -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, found",
    [
        ("You are nothing but a m0r0n.", True), ("What a b*tch that Smith is, a real swine.", True), ("you s c u m, shut up", True), ("I know where you live and I will cut her throat.", True), ("Kill the strangers before they multiply.", True), ("Ты сволочь!", True), ("Ferme ta gueule, c-onnard.", True), ("He is a fuuucking liar", True),
        ("The kennel lists a liver-coloured bitch, whelped in May.", False), ("An ass and two mules carried the mail.", False), ("The drug was given to kill the pain.", False), ("He kept a fighting cock and hens.", False), ("The count hunted where the baron slept.", False), ("", False), ("* * * 5", False),
    ],
)
def test_abuse_and_innocent_uses(text, found):
    assert (max((v for v, _ in abuse.Scorer().score(text).values()), default=0) >= abuse.LEAST) == found


def test_quotation_is_told():
    s = abuse.Scorer()
    assert s.score('The witness testified: "You are a moron."')["insult"][1] and not s.score("You are a moron.")["insult"][1]


def test_scores_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "s", 9.0), (2, "", None, 9.0), (3, "word " * 20_000 + "you moron", "s", 9.0), (3, "you moron", "s", 9.0)], "doc_id long, text string, source string, score double")
    got = abuse.scores(df, "doc_id", "text", ("source",))
    assert sorted((r.doc_id, r.score > 0.5) for r in got.collect()) == [(1, False), (2, False), (3, True), (3, True)]
    told = {r.source: (r.n_docs, r.n_abusive) for r in abuse.rates(got, "source").collect()}
    assert told == {"s": (3, 2), None: (1, 0)}
    labels = spark.createDataFrame([(3, "a", 1), (3, "a", 1), (1, "a", 1), (1, "b", None)], "doc_id long, reviewer string, abusive int")
    r = abuse.agreement(got.dropDuplicates(["doc_id"]), labels).first()
    assert (r.reviewer, r.n, r.n_agree, r.n_only_reviewer) == ("a", 2, 1, 1)
    assert abuse.scores(df.limit(0), "doc_id", "text").count() == 0
