"""Batch pipelines that turn texts into relations: chunks, turns, matches, clusters, metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import text as T
from archivolt.functions.scores import decision
from archivolt.operators import likeness
from archivolt.operators.graph import components

#: How speakers of hearings are written at the start of a line; fixed value.
SPEAKER = r"^((?:The CHAIRMAN|Q|A|(?:Mr|Mrs|Dr|Col|Senator)\.? [A-Z][a-z]+))\. "


def packed(df: DataFrame, key: str, text: str, most: int = 1000) -> DataFrame:
    """Paragraphs packed greedily to chunks of at most ``most`` characters; a longer paragraph is a chunk alone.

    A fold over each text's paragraphs: the reset of a pack depends on what is in
    it. Returns key, ordinal (from 0) and text; blank texts give nothing.
    """
    parts = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, p):
        fits = F.length(acc["open"]) + F.length(p) + 2 <= most
        return F.when(acc["open"] == "", F.struct(acc["done"].alias("done"), p.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open"))
        )

    folded = F.aggregate(parts, zero, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return df.select(F.col(key), F.posexplode(folded).alias("ordinal", "text"))


def turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, turn, speaker and text: lines of a transcript up to the next speaker; what stands before the first is left out."""
    line = df.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    by = Window.partitionBy(key).orderBy("n")
    own = line.withColumn("speaker", F.regexp_extract("line", SPEAKER, 1)).withColumn("turn", F.sum((F.col("speaker") != "").cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return own.where("turn > 0").groupBy(key, "turn").agg(F.max("speaker").alias("speaker"), F.count(F.lit(1)).alias("n_lines"), said.alias("text"))


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of consecutive rows of one value: key, run (from 1), value, first and last row number, length."""
    w = Window.partitionBy(key).orderBy(*order)
    n = df.withColumn("n", F.row_number().over(w)).withColumn("new", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("bigint"), F.lit(1)))
    run = n.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "run", value).agg(F.min("n").cast("bigint").alias("first_row"), F.max("n").cast("bigint").alias("last_row"), F.count(F.lit(1)).alias("length"))


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smaller one at a tie."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(value))).alias("b")).select(key, F.col(f"b.{value}").alias(value), (-F.col("b.n")).alias("n"))


def alias_hits(chunks: DataFrame, aliases: DataFrame, body: Column) -> DataFrame:
    """chunk_id, start (word from 1), n (words), alias: all occurrences of dictionary names in texts, those inside others too.

    Word n-grams are joined to the dictionary by equality, whatever its size; they
    are made in the lengths its names have. ``aliases`` has alias (folded).
    """
    w = chunks.select("chunk_id", T.tokens(body).alias("words"))
    lengths = aliases.agg(F.sort_array(F.collect_set(F.size(F.split("alias", " "))))).first()[0]
    sizes = F.array(*(F.lit(n) for n in lengths)).cast("array<int>")
    one = lambda i: F.transform(sizes, lambda n: F.when(i + n - 1 <= F.size("words"), F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice("words", i, n), " ").alias("alias"))))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words")))
    # the words themselves aren't carried into the exploded rows
    grams = w.select("chunk_id", F.inline(F.filter(F.flatten(F.transform(starts, one)), lambda g: g.isNotNull())))
    return grams.join(aliases.select("alias").distinct(), "alias")


def alias_matches(chunks: DataFrame, aliases: DataFrame, body: Column) -> DataFrame:
    """chunk_id, alias, start (word from 1), words: dictionary names in texts, the longest at a place, none inside another.

    Overlaps are settled leftmost-longest among the few hits of a chunk.
    """
    hits = alias_hits(chunks, aliases, body)
    kept = hits.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("m"), "alias"))).alias("hits"))
    zero = F.struct(F.array().cast("array<struct<start:int,m:int,alias:string>>").alias("kept"), F.lit(0).alias("end"))
    fold = F.aggregate("hits", zero, lambda a, h: F.when(h["start"] > a["end"], F.struct(F.concat(a["kept"], F.array(h)).alias("kept"), (h["start"] - h["m"] - 1).alias("end"))).otherwise(a), lambda a: a["kept"])
    return kept.select("chunk_id", F.explode(fold).alias("h")).select("chunk_id", F.col("h.alias").alias("alias"), F.col("h.start").alias("start"), (-F.col("h.m")).alias("words"))


def _texts(df: DataFrame, column: str, block: int) -> tuple[DataFrame, int]:
    """text, words, block of the different texts, and how many blocks of about ``block`` texts there are."""
    own = df.select(F.col(column).alias("text")).where("text <> ''")
    blocks = max(1, -(-(own.agg(F.approx_count_distinct("text")).first()[0]) // block))
    words = F.array_join(T.tokens("text"), " ")
    return own.distinct().select("text", F.when(words != F.col("text"), words).alias("words"), F.pmod(F.xxhash64("text"), F.lit(blocks)).alias("block")), blocks


def trigram_join(left: DataFrame, right: DataFrame, a: str, b: str, least: float, block: int = 30_000, top: int | None = None) -> DataFrame:
    """a, b, similarity of all pairs of different texts with a trigram similarity of at least ``least``.

    Both sides are dealt to blocks of about ``block`` texts by their hash, and
    every two blocks are a cell that is joined in one place (see ``likeness``):
    what is shuffled is each text once for every block of the other side, and no
    pair. Building the plan counts the texts of both sides, roughly. With ``top``
    a cell gives no more than so many pairs of each a, by similarity and then b;
    the first ``top`` of all its pairs are among them.
    """
    (x, n), (y, m) = _texts(left, a, block), _texts(right, b, block)
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    x = x.select(F.lit(0).alias("side"), "text", "words", "block", every(m).alias("other")).selectExpr(f"cast(block * {m} + other as int) cell", "side", "text", "words")
    y = y.select(F.lit(1).alias("side"), "text", "words", "block", every(n).alias("other")).selectExpr(f"cast(other * {m} + block as int) cell", "side", "text", "words")
    cells = x.unionAll(y).repartition(n * m, "cell").groupBy("cell")
    met = cells.applyInArrow(likeness.met(least, top), "a string, b string, common int, total int")
    similarity = F.round(F.col("common") / (F.col("total") - F.col("common")), 6)
    return met.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def trigram_links(df: DataFrame, column: str, least: float, block: int = 30_000) -> DataFrame:
    """a, b: pairs that link the different texts which the pairs of trigram_join of a column with itself link.

    Every two blocks of texts meet once, and a cell gives fewer pairs than it has
    texts, however many are alike.
    """
    x, n = _texts(df, column, block)
    each = x.select("text", "words", "block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    own = each.select((F.least("block", "other") * n + F.greatest("block", "other")).cast("int").alias("cell"), side.alias("side"), "text", "words")
    return own.repartition(n * (n + 1) // 2, "cell").groupBy("cell").applyInArrow(likeness.links(least), "a string, b string")


def resolved(matches: DataFrame, surface: str = "a", candidate: str = "b", top: int = 10) -> DataFrame:
    """The best candidates of each surface with their place, the margin to the next and the decision for the first."""
    w = Window.partitionBy(surface).orderBy(F.desc("similarity"), candidate)
    ranked = matches.withColumn("place", F.row_number().over(w)).withColumn("margin", F.round(F.col("similarity") - F.lead("similarity").over(w), 6))
    return ranked.where(F.col("place") <= top).withColumn("decision", F.when(F.col("place") == 1, decision(F.col("similarity"), F.col("margin"))).otherwise("candidate"))


def clusters(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """member and cluster (its first member) of everything that is in a pair."""
    return components(pairs, a, b).withColumnsRenamed({"node": "member", "component": "cluster"})


def merged_variants(df: DataFrame, surface: str, count: str, block: Column, least: float = 0.85) -> DataFrame:
    """surface, head: surfaces given to the first more frequent one they resemble, inside blocks.

    Which head a surface gets depends on the order of frequency, so each block is
    worked through in it; blocks come from short keys and are bounded by the
    distinct surfaces that share one.
    """
    from difflib import SequenceMatcher

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        heads: list[str] = []
        rows = []
        for s in frame.sort_values(["n", "surface"], ascending=[False, True])["surface"]:
            head = next((h for h in heads if abs(len(h) - len(s)) <= 2 and SequenceMatcher(None, h, s, autojunk=False).ratio() >= least), None)
            if head is None:
                heads.append(s)
            rows.append((s, head or s))
        return pd.DataFrame(rows, columns=["surface", "head"])

    own = df.where(F.col(surface) != "").select(F.col(surface).alias("surface"), F.col(count).alias("n"), block.alias("block"))
    return own.groupBy("block").applyInPandas(run, "surface string, head string")


def overridden(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidates (surface, entity_id, scope_id, score) after decisions: bans first, then forced entities, a scoped decision before a global one.

    ``overrides``: surface, scope_id (null is everywhere), forced_entity_id,
    banned_entity_id, banned. A banned surface or candidate drops out; a forced
    entity replaces the score's choice.
    """
    o = overrides
    here = (F.col("c.surface") == F.col("o.surface")) & (F.col("o.scope_id").isNull() | (F.col("o.scope_id") == F.col("c.scope_id")))
    bans = o.where("banned or banned_entity_id is not null")
    left = candidates.alias("c").join(bans.alias("o"), here & (F.col("o.banned") | (F.col("o.banned_entity_id") == F.col("c.entity_id"))), "left_anti")
    forced = left.alias("c").join(o.where("forced_entity_id is not null").alias("o"), here, "left").select("c.*", F.col("o.forced_entity_id").alias("forced"), F.col("o.scope_id").alias("forced_in"))
    w = Window.partitionBy("surface", "scope_id").orderBy(F.col("forced").isNull().cast("int"), F.col("forced_in").isNull().cast("int"), F.desc("score"), "entity_id")
    first = forced.withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select("surface", "scope_id", F.coalesce("forced", "entity_id").alias("entity_id"), F.when(F.col("forced").isNotNull(), "forced").otherwise("best").alias("reason"))


def chunk_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id, page_id, span_order: the pages from a chunk's first to its last one, either way round."""
    at = pages.select("page_id", "document_id", "page_seq")
    a = at.select(F.col("page_id").alias("first_page_id"), F.col("document_id").alias("doc"), F.col("page_seq").alias("x"))
    b = at.select(F.col("page_id").alias("last_page_id"), F.col("page_seq").alias("y"))
    span = chunks.select("chunk_id", "first_page_id", F.coalesce("last_page_id", "first_page_id").alias("last_page_id")).join(a, "first_page_id").join(b, "last_page_id")
    low = F.least("x", "y")
    each = span.select("chunk_id", "doc", low.alias("low"), F.explode(F.sequence(low, F.greatest("x", "y"))).alias("page_seq"))  # so that the join is one of equality, however many pages a document has
    found = each.join(at.select("page_id", F.col("document_id").alias("doc"), "page_seq"), ["doc", "page_seq"])
    return found.select("chunk_id", "page_id", "page_seq", (F.col("page_seq") - F.col("low") + 1).alias("span_order"))


def chunk_metadata(spans: DataFrame, page_metadata: DataFrame) -> DataFrame:
    """Per chunk: pages in order, first and last page, dates, senders, whether any page is an extract."""
    newest = page_metadata.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("extracted_at"), F.desc("page_metadata_id")))).where("k = 1")
    own = spans.join(newest.select("page_id", "sender", "recipient", "cable_date", "is_extract"), "page_id", "left")
    inside = F.transform(F.array_sort(F.collect_list(F.struct("span_order", "page_id"))), lambda x: x["page_id"])
    g = own.groupBy("chunk_id").agg(
        inside.alias("page_ids"), F.min("cable_date").alias("date_min"), F.max("cable_date").alias("date_max"), F.array_join(F.sort_array(F.collect_set("sender")), "; ").alias("senders"), F.array_join(F.sort_array(F.collect_set("recipient")), "; ").alias("recipients"), F.bool_or("is_extract").alias("any_extract"),
    )
    return g.select("chunk_id", F.element_at("page_ids", 1).alias("first_page_id"), F.element_at("page_ids", -1).alias("last_page_id"), F.array_join(F.transform("page_ids", lambda p: p.cast("string")), ",").alias("page_ids"), "date_min", "date_max", "senders", "recipients", "any_extract")


def boilerplate(pages: DataFrame, edge: int = 4, share: float = 0.3, least: int = 3) -> DataFrame:
    """document_id, line, n_pages: lines near the top or foot of at least a share of a document's pages."""
    lines = pages.where("raw_text is not null").select("document_id", "page_id", F.split("raw_text", "\n").alias("l"))
    near = lines.select("document_id", "page_id", F.explode(F.array_distinct(F.concat(F.slice("l", F.lit(1), F.lit(edge)), F.slice("l", F.greatest(F.size("l") - edge + 1, F.lit(1)), F.lit(edge))))).alias("line"))
    near = near.withColumn("line", F.trim("line")).where("line <> ''")
    total = lines.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    often = near.groupBy("document_id", "line").agg(F.countDistinct("page_id").alias("n_pages"))
    return often.join(total, "document_id").where((F.col("n") >= least) & (F.col("n_pages") >= share * F.col("n"))).select("document_id", "line", "n_pages")


def without_boilerplate(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """page_id, text: pages without the lines that are their document's boilerplate (document_id, line); blank lines stay."""
    own = lines.groupBy("document_id").agg(F.collect_set("line").alias("__b"))  # at most the edge lines of a document that a share of its pages has
    kept = F.filter(F.split("raw_text", "\n"), lambda x: (F.trim(x) == "") | ~F.array_contains(F.coalesce("__b", F.array().cast("array<string>")), F.trim(x)))
    return pages.where("raw_text is not null").join(own, "document_id", "left").select("page_id", F.array_join(kept, "\n").alias("text"))


def diverse(df: DataFrame, group: str, score: str, traits: dict[str, float], n: int = 10, pool: int = 5000) -> DataFrame:
    """Greedy choice of n rows per group, each step the best score less a penalty for every earlier row that shares a trait.

    The pool of a group is its ``pool`` best rows by score; that bound is part of
    the operator, so a group is never larger than it in a task.
    """
    cols = list(traits)
    w = Window.partitionBy(group).orderBy(F.desc(score), "chunk_id")
    own = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= pool)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left = frame.sort_values([score, "chunk_id"], ascending=[False, True]).to_dict("records")
        seen: dict[tuple, int] = {}
        rows = []
        while left and len(rows) < n:
            worth = lambda r: r[score] - sum(p * seen.get((c, r[c]), 0) for c, p in traits.items())
            best = max(range(len(left)), key=lambda i: (worth(left[i]), -i))
            row = left.pop(best)
            rows.append((row[group], row["chunk_id"], len(rows) + 1, float(worth(row))))
            for c in cols:
                seen[c, row[c]] = seen.get((c, row[c]), 0) + 1
        return pd.DataFrame(rows, columns=[group, "chunk_id", "place", "worth"])

    kind = dict(df.dtypes)
    return own.select(group, "chunk_id", score, *cols).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, chunk_id bigint, place int, worth double")


def within_quota(df: DataFrame, order: list[Column], quotas: dict[str, int], n: int) -> DataFrame:
    """The first n rows in order of which no more than a quota share a value, checked from the finest column to the coarsest."""
    for column, most in quotas.items():
        df = df.withColumn("__k", F.row_number().over(Window.partitionBy(column).orderBy(*order))).where(F.col("__k") <= most).drop("__k")
    return df.orderBy(*order).limit(n)


def parse_page_list(text: str) -> list[int]:
    """Pages of a citation such as ``3, 5-7; 12`` (hyphen or dash)."""
    import re

    got: list[int] = []
    for a, b in re.findall(r"(\d+)(?:\s*[-–]\s*(\d+))?", text):
        got += range(int(a), int(b or a) + 1)
    return got
