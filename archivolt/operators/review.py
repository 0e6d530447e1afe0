"""For human review: names that clash, clusters by what is to be done, cover names, bundles for summaries, matches by token windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import text as T
from archivolt.shared import cut

#: Size of the table of hashes of known windows, as a power of two.
TABLE_BITS = 26
#: Letters up to which all ways to leave out two of a word's letters are written out.
LONG = 24


def collisions(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """name_key, entity_id, n_mentions, n_chunks, place, share: the candidates of each name that several entities bear, the most mentioned first."""
    names = entities.select(F.lower("name").alias("name_key"), "entity_id").distinct()
    many = names.groupBy("name_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    stats = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("chunk_id").alias("n_chunks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    own = names.join(many.select("name_key"), "name_key", "left_semi").join(stats, "entity_id", "left").select("name_key", "entity_id", zero("n_mentions"), zero("n_chunks"))
    w = Window.partitionBy("name_key")
    return own.withColumn("place", F.row_number().over(w.orderBy(F.desc("n_mentions"), "entity_id"))).withColumn("share", F.round(F.coalesce(F.col("n_mentions") / F.nullif(F.sum("n_mentions").over(w), F.lit(0)), F.lit(0.0)), 6))


def cluster_class(n_members: Column, n_docs: Column, known: Column, letters: Column) -> Column:
    """What a reviewer is asked of a cluster of surfaces: nothing (junk), to confirm a known name, a new entity, or a closer look."""
    return F.when((letters < 0.6) | (n_docs < 1), "junk").when(known, "confirm").when((n_docs >= 3) & (n_members >= 2), "new entity").otherwise("look")


def classified(clusters: DataFrame, stats: DataFrame, known: DataFrame) -> DataFrame:
    """cluster, n_members, n_docs, known, class for clusters (member, cluster) with the members' statistics (surface_norm, n_docs)."""
    own = clusters.join(stats.select(F.col("surface_norm").alias("member"), "n_docs"), "member").join(known.select(F.col("alias").alias("member"), F.lit(True).alias("is_known")), "member", "left")
    g = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"), F.sum("n_docs").alias("n_docs"), F.coalesce(F.bool_or("is_known"), F.lit(False)).alias("known"))
    return g.withColumn("class", cluster_class(F.col("n_members"), F.col("n_docs"), F.col("known"), T.ratio("cluster", r"\p{L}\s")))


def cover_names(documents: DataFrame, mentions: DataFrame, least: int = 2) -> DataFrame:
    """cover_name, surface_norm, n_docs: quoted names with the only surface that stands with them in as many documents as any.

    A name for which two surfaces are equally near stays without one.
    """
    quoted = documents.where("text is not null").select(F.col("doc_id").alias("document_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("“([A-Z][a-z]+)”"), F.lit(1)))).alias("cover_name"))
    named = mentions.where("surface_norm is not null and document_id is not null").select("document_id", "surface_norm").distinct()
    n = quoted.join(named, "document_id").groupBy("cover_name", "surface_norm").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)
    best = n.groupBy("cover_name").agg(F.max("n_docs").alias("most"))
    top = n.join(best, "cover_name").where("n_docs = most")
    return top.groupBy("cover_name").agg(F.min("surface_norm").alias("surface_norm"), F.max("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("k")).where("k = 1").drop("k")


def bundles(found: DataFrame, chunks: DataFrame, term: str, body: Column, length: int = 160) -> DataFrame:
    """chunk_id, rank, pages, quote, signature for a result (chunk_id, rank): the first sentence with the term, or the start, as a quote of bounded length."""
    own = found.join(chunks.select("chunk_id", "document_id", "first_page_id", "last_page_id", body.alias("body")), "chunk_id")
    hit = F.try_element_at(F.filter(T.sentences("body"), lambda s: F.contains(F.lower(s), F.lit(term.lower()))), F.lit(1))
    quote = F.left(T.collapse(F.coalesce(hit, F.col("body"))), F.lit(length))
    pages = F.concat_ws("-", F.col("first_page_id").cast("string"), F.when(F.col("last_page_id") != F.col("first_page_id"), F.col("last_page_id").cast("string")))
    return own.select("chunk_id", "rank", pages.alias("pages"), quote.alias("quote")).withColumn("signature", F.sha2(F.concat_ws("|", F.col("chunk_id").cast("string"), F.lit(term), "quote").cast("binary"), 256))


def name_spans(df: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """key, span, n_words, quality: runs of capitalised words that may be names, of two to ``most`` words; none inside another."""
    word = r"\p{Lu}[\p{L}~^|'’]+\.?"
    spans = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(rf"({word}(?: {word}){{1,{most - 1}}})"), F.lit(1)))).alias("span")
    own = df.select(F.col(key), spans)
    return own.select(key, "span", F.size(F.split("span", " ")).cast("bigint").alias("n_words"), T.ratio("span", r"\p{L}").alias("quality"))


def tournament(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    """The ``k`` that are left of pairwise matches by score (ties by key), with their place.

    Where matches go by a fixed score, whoever meets, the last k are the first k in
    its order, so no bracket has to be played in one place.
    """
    top = df.orderBy(F.desc(score), key).limit(k)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(score), key)))


def _one_left_out(words: Column) -> Column:
    """The words in their order, each left out once, as texts."""
    return F.transform(words, lambda w, i: F.array_join(F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.size(words))), " "))


def _shortened(word: str) -> Column:
    """Hashes of a word and of all that is left of it without one or two letters; words within two edits have one in common."""
    w = F.col(word)
    without = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))
    one = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: without(w, i))
    two = F.flatten(F.transform(one, lambda x, k: F.when((k + 1 < F.length(w)) & (F.length(x) > 0), F.transform(F.sequence(k + 1, F.length(x)), lambda i: without(x, i))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.transform(F.concat(F.array(w), one, two), lambda x: F.xxhash64(x)))


def near_words(odd: DataFrame, seen: DataFrame, most_edits: int) -> DataFrame:
    """odd, seen, edits of all different words of two lists (odd; seen) within at most two edits of each other."""
    none = F.array().cast("array<bigint>")
    size, other = F.length("odd"), F.length("seen")
    piece = lambda word, n, k, by: F.xxhash64(n, k, F.substring(word, F.floor(n * k / 3).cast("int") + 1 + by, F.floor(n * (k + 1) / 3).cast("int") - F.floor(n * k / 3).cast("int")))
    ks, by = F.sequence(F.lit(0), F.lit(2)), F.sequence(F.lit(-2), F.lit(2))
    own = F.transform(ks, lambda k: piece(F.col("odd"), size, k, F.lit(0)))
    # a long word has one of three pieces unchanged, at most two letters away
    moved = F.flatten(F.flatten(F.transform(F.sequence(other - 2, other + 2), lambda n: F.transform(ks, lambda k: F.transform(by, lambda d: piece(F.col("seen"), n, k, d))))))
    x = odd.select("odd", F.explode(F.when(size <= LONG, _shortened("odd")).otherwise(own)).alias("h"))
    y = seen.select("seen", F.explode(F.concat(F.when(other <= LONG + 2, _shortened("seen")).otherwise(none), F.when(other >= LONG - 1, moved).otherwise(none))).alias("h"))
    met = x.join(y, "h").where((F.col("odd") != F.col("seen")) & (F.abs(F.length("odd") - F.length("seen")) <= most_edits))
    return met.withColumn("edits", F.levenshtein("odd", "seen", most_edits)).where("edits >= 0").select("odd", "seen", "edits").distinct()


def _place(hashes: list[np.ndarray]) -> np.ndarray:
    """Bit of the table of known windows for windows of as many words as there are arrays."""
    h = np.full(len(hashes[0]), len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for word in hashes:
            h = (h ^ word.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _table(patterns: DataFrame) -> np.ndarray:
    """A table of ``2 ** TABLE_BITS`` bits, set where a pattern's ``window`` hashes to; its size doesn't depend on the patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            values, n = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths())
            start = np.cumsum(n) - n
            for size in np.unique(n[n > 0]):
                at = start[n == size]
                yield pa.RecordBatch.from_arrays([pa.array(_place([values[at + k] for k in range(size)]))], names=["bit"])

    bits = patterns.select(F.transform(F.split("window", " "), lambda w: F.xxhash64(w)).alias("h")).mapInArrow(run, "bit bigint")
    rows = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("word")).toArrow()
    table = np.zeros(1 << TABLE_BITS - 6, np.int64)
    table[rows.column("at").to_numpy()] = rows.column("word").to_numpy()
    return table


def _known_windows(words: DataFrame, patterns: DataFrame, longest: int) -> DataFrame:
    """chunk_id, start, window of the token windows that a pattern may equal: all that one does, and few more."""
    table = words.sparkSession.sparkContext.broadcast(_table(patterns))
    key = words.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            lists = batch.column("h")
            h, n = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(h)) - (np.cumsum(n) - n)[row]
            found = []
            for size in range(1, longest + 1):
                own = np.flatnonzero(at + size <= n[row])
                bit = _place([h[own + k] for k in range(size)])
                own = own[(known[bit >> 6] >> (bit & 63) & 1) == 1]
                found.append(np.stack([row[own], at[own] + 1, np.full(len(own), size)]))
            r, start, size = np.concatenate(found, axis=1)
            order = np.argsort(r, kind="stable")
            some, k = np.unique(r, return_counts=True)
            offsets = pa.array(np.r_[0, np.cumsum(k)], pa.int32())
            spans = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int32())) for x in (start, size)]
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([kept.column("chunk_id"), kept.column("w"), *spans], names=["chunk_id", "w", "starts", "sizes"])

    hashed = words.where("size(w) > 0").select("chunk_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    spans = hashed.mapInArrow(run, f"chunk_id {key}, w array<string>, starts array<int>, sizes array<int>")
    each = spans.select("chunk_id", "w", F.explode(F.arrays_zip("starts", "sizes")).alias("x"))
    return each.select("chunk_id", F.col("x.starts").alias("start"), F.array_join(F.slice("w", F.col("x.starts"), F.col("x.sizes")), " ").alias("window"))


def window_matches(chunks: DataFrame, aliases: DataFrame, body: Column, most_edits: int = 2, longest: int = 5) -> DataFrame:
    """chunk_id, start, alias, kind, edits: token windows that are a name (``exact``), one with a word spelled differently (``fuzzy``) or one without a word (``partial``).

    Fuzzy windows agree with the name in all words but one of at least five
    letters, partial ones in all but one of at least three words. Names are
    written out in all forms that can be in the texts: a word spelled differently
    is a word of the texts within ``most_edits`` (two at most) of it. Windows are
    joined by equality to these forms, and only those are shuffled that a table
    of hashes lets through. Names of more than ``longest`` words are matched as
    a whole by alias_matches. Building the plan writes the forms and makes the table.
    """
    if most_edits > 2:
        raise ValueError("words are looked up with two edits at most")
    words = chunks.select("chunk_id", T.tokens(body).alias("w"))
    names = aliases.select("alias").distinct().withColumn("parts", F.split("alias", " ")).withColumn("n", F.size("parts")).where(F.col("n") <= longest)
    form = lambda df, kind, edits: df.select("window", "alias", F.lit(kind).alias("kind"), edits.cast("int").alias("edits"))
    odd = names.where("n > 1").select("alias", "parts", F.posexplode("parts").alias("i", "odd")).where("length(odd) >= 5")
    seen = words.select(F.explode("w").alias("seen")).where(F.length("seen") >= 5 - most_edits).distinct()
    other = odd.join(near_words(odd.select("odd").distinct(), seen, most_edits), "odd")
    fuzzy = other.select("alias", "edits", F.array_join(F.concat(F.slice("parts", F.lit(1), F.col("i")), F.array("seen"), F.slice("parts", F.col("i") + 2, F.size("parts"))), " ").alias("window"))
    short = names.where("n > 2").select("alias", F.explode(_one_left_out(F.col("parts"))).alias("window"))
    forms = form(names.withColumn("window", F.col("alias")), "exact", F.lit(0)).unionByName(form(fuzzy, "fuzzy", F.col("edits"))).unionByName(form(short, "partial", F.lit(0)))
    patterns = cut(forms.groupBy("window", "alias", "kind").agg(F.min("edits").alias("edits")))
    met = _known_windows(words, patterns, longest).join(patterns, "window")
    # a chunk that is there twice has its exact windows twice, the others once
    own = met.groupBy("chunk_id", "start", "alias", "kind").agg(F.min("edits").alias("edits"), F.count(F.lit(1)).alias("times"))
    again = F.when(F.col("kind") == "exact", F.sequence(F.lit(1), F.col("times").cast("int"))).otherwise(F.array(F.lit(1)))
    return own.select("chunk_id", "start", "alias", "kind", "edits", F.explode(again)).drop("col")
