"""Lexical, vector and hybrid retrieval over chunks.

Chunks have chunk_id, document_id, first_page_id, clean_text, text and
embedding. Scope goes in as an already filtered table, so it is always below
ranking. Each result is ordered, and all ties go by chunk_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.functions import text as T
from archivolt.operators.ranking import numbered

RRF_K = 60
MISSING_RANK = 100_000


def body() -> Column:
    return F.coalesce("clean_text", "text")


def place() -> list[Column]:
    """Order of the corpus: document, first page, chunk; unknown last."""
    return [F.col("document_id").asc_nulls_last(), F.col("first_page_id").asc_nulls_last(), F.col("chunk_id").asc()]


def search_filter(df: DataFrame, versions: list[str] | None = None, collections: list[str] | None = None, documents: list[int] | None = None, not_collections: list[str] | None = None, not_documents: list[int] | None = None, not_chunks: list[int] | None = None) -> DataFrame:
    """The conjunction of what is given; a null value never passes an inclusion and always passes an exclusion."""
    for name, values in (("pipeline_version", versions), ("collection_slug", collections), ("document_id", documents)):
        if values is not None:
            df = df.where(F.col(name).isin(values))
    for name, values in (("collection_slug", not_collections), ("document_id", not_documents), ("chunk_id", not_chunks)):
        if values:
            df = df.where(F.col(name).isNull() | ~F.col(name).isin(values))
    return df


def containing(df: DataFrame, terms: list[str], case_sensitive: bool = False, k: int | None = None) -> DataFrame:
    """Chunks whose text contains every one of the strings, in corpus order."""
    own = (lambda c: c) if case_sensitive else F.lower
    found = df.where(reduce(Column.__and__, (F.contains(own(body()), own(F.lit(t))) for t in terms)))
    found = found.orderBy(*place())
    return found.limit(k) if k else found


def near(df: DataFrame, a: str, b: str, window: int, k: int | None = None) -> DataFrame:
    """Chunks with both words at most ``window`` words apart, the closest first."""
    found = df.withColumn("words", T.tokens(body())).where(T.has_term("words", a) & T.has_term("words", b)).withColumn("distance", T.min_distance("words", a, b)).where(F.col("distance") <= window).drop("words")
    found = found.orderBy("distance", *place())
    return found.limit(k) if k else found


def ranked(df: DataFrame, score: Column, k: int | None = None, name: str = "score", ascending: bool = False) -> DataFrame:
    """score and rank. A bound k is a distributed top-k first, so only k rows are numbered in one place; without it rows are numbered by ranges."""
    scored = df.withColumn(name, score)
    order = [F.asc(name) if ascending else F.desc(name), F.asc("chunk_id")]
    if k:
        scored = scored.orderBy(*order).limit(k)
    else:
        return numbered(scored, order)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def lexical(df: DataFrame, condition: Column, terms: list[str], k: int | None = 200) -> DataFrame:
    """chunk_id, score and rank of the chunks that match a condition over the array ``words``."""
    found = df.select("chunk_id", T.tokens(body()).alias("words")).where(condition)
    return ranked(found, T.term_score("words", terms), k).select("chunk_id", "score", "rank")


def postings(df: DataFrame) -> DataFrame:
    """token, chunk_id, tf, n_tokens: the inverted index of the chunks' texts.

    Written partitioned or bucketed by token it answers term queries from the
    terms' rows alone, in place of a scan of all texts.
    """
    words = df.select("chunk_id", T.tokens(body()).alias("w"))
    each = words.select("chunk_id", F.size("w").alias("n_tokens"), F.explode("w").alias("token"))
    return each.groupBy("token", "chunk_id", "n_tokens").agg(F.count(F.lit(1)).alias("tf"))


def search_postings(index: DataFrame, terms: list[str], every: bool = False, k: int | None = 200) -> DataFrame:
    """chunk_id, score and rank from an inverted index, with the score of a text search; ``every`` asks for all terms."""
    want = sorted({t.lower() for t in terms})
    hits = index.where(F.col("token").isin(want)).groupBy("chunk_id").agg(F.sum("tf").alias("tf"), F.max("n_tokens").alias("n"), F.count(F.lit(1)).alias("n_terms"))
    if every:
        hits = hits.where(F.col("n_terms") == len(want))
    return ranked(hits, F.round(F.col("tf") / (1 + F.log(1 + F.col("n"))), 6), k).select("chunk_id", "score", "rank")


def write_postings(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the inverted index in folders by token hash, sorted by token, so a query reads one folder's matching row groups."""
    own = postings(df).withColumn("part", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    own.repartition("part").sortWithinPartitions("part", "token").write.mode("overwrite").partitionBy("part").parquet(path)


def read_postings(spark, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """The index's folders of the terms."""
    parts = spark.createDataFrame([(t.lower(),) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int").alias("p")).distinct()
    return spark.read.parquet(path).where(F.col("part").isin([r.p for r in parts.collect()])).drop("part")


def usable(vector: str = "embedding", size: int = 64) -> Column:
    v = F.col(vector)
    return (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def distance(query: Column, vector: str = "embedding", metric: str = "cosine") -> Column:
    """Smaller is nearer, whatever the metric."""
    match metric:
        case "cosine":
            return F.round(1 - T.cosine(vector, query), 6)
        case "l2":
            return F.round(T.l2(vector, query), 5)
        case "inner_product":
            return F.round(-T.inner_product(vector, query), 5)
    raise ValueError(metric)


def vector(df: DataFrame, query: list[float], k: int | None = 200, most: float | None = None, metric: str = "cosine") -> DataFrame:
    """chunk_id, distance and rank of the nearest chunks, all of them within ``most`` or the first k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = df.where(usable()).select("chunk_id", "embedding").withColumn("distance", distance(q, metric=metric))
    if most is not None:
        found = found.where(F.col("distance") <= most)
    return ranked(found, F.col("distance"), k, "distance", ascending=True).select("chunk_id", "distance", "rank")


def near_by_vector(df: DataFrame, query: list[float], most: float | None = None) -> DataFrame:
    """chunk_id and score (the cosine) of the chunks with a usable vector, those within a distance of ``most`` where given."""
    q = F.array(*(F.lit(float(x)) for x in query))
    found = df.where(usable()).select("chunk_id", distance(q).alias("distance"))
    found = found if most is None else found.where(F.col("distance") <= most)
    return found.select("chunk_id", F.round(1 - F.col("distance"), 6).alias("score"))


def fused(lists: dict[str, tuple[DataFrame, float]], k: int | None = 50, rrf_k: int = RRF_K, missing: int | None = None, how: str = "full_outer") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (chunk_id, rank) with weights.

    A chunk that a list doesn't hold gets nothing from it, or the
    contribution of rank ``missing``. ``how`` inner keeps chunks of all lists.
    """
    names = list(lists)
    out = None
    for n, (df, _) in lists.items():
        own = df.select("chunk_id", F.col("rank").alias(f"r_{n}"))
        out = own if out is None else out.join(own, "chunk_id", how)
    part = lambda n, w: w * (F.coalesce(1 / (rrf_k + F.col(f"r_{n}")), F.lit(0.0)) if missing is None else 1 / (rrf_k + F.coalesce(f"r_{n}", F.lit(missing))))
    score = reduce(Column.__add__, (part(n, F.lit(float(lists[n][1]))) for n in names))
    return ranked(out, F.round(score, 9), k)


def soft_lexical(df: DataFrame, terms: list[str], threshold: float = 0.6, k: int | None = 200) -> DataFrame:
    """Chunks with a word like one of the terms, by the best word similarity.

    Similarity is taken once per distinct word of the collection, and the few
    words that pass are joined back.
    """
    words = df.select("chunk_id", F.explode(T.lexemes(body())).alias("lexeme"))
    best = F.greatest(F.lit(0.0), *(T.trigram_similarity("lexeme", F.lit(t)) for t in terms))
    like = words.select("lexeme").distinct().withColumn("score", best).where(F.col("score") >= threshold)
    found = words.join(like, "lexeme").groupBy("chunk_id").agg(F.max("score").alias("score"))
    return ranked(found, F.col("score"), k).select("chunk_id", "score", "rank")


def dictionary(df: DataFrame) -> DataFrame:
    """lexeme and the number of chunks with it."""
    return df.select("chunk_id", F.explode(T.lexemes(body())).alias("lexeme")).groupBy("lexeme").agg(F.countDistinct("chunk_id").alias("chunk_freq"))


def fuzzy_expansion(words: DataFrame, terms: list[str], least: float = 0.4, per_term: int = 5) -> DataFrame:
    """Lexemes like each term: the most frequent first, then the most similar, then by letters.

    The terms are a handful; each is one similarity column, so the dictionary is
    scanned once.
    """
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), T.trigram_similarity("lexeme", F.lit(t)).alias("similarity")) for t in terms))).alias("x")
    found = words.select("lexeme", "chunk_freq", each).select("lexeme", "chunk_freq", "x.*").where(F.col("similarity") >= least)
    w = Window.partitionBy("term").orderBy(F.desc("chunk_freq"), F.desc("similarity"), "lexeme")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_term)


def related_terms(df: DataFrame, term: str, top: int = 20) -> DataFrame:
    """Lexemes in the chunks with a term, with their share of the most frequent one."""
    own = df.select("chunk_id", T.lexemes(body()).alias("words")).where(T.has_term("words", term))
    n = own.select("chunk_id", F.explode("words").alias("lexeme")).where((F.length("lexeme") > 3) & (F.col("lexeme") != term)).groupBy("lexeme").agg(F.countDistinct("chunk_id").alias("n"))
    first = n.orderBy(F.desc("n"), "lexeme").limit(top)
    return first.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))), 6))


def neighbours(df: DataFrame, chunk: int, before: int = 1, after: int = 1, seed: bool = True) -> DataFrame:
    """The chunks around one inside its document, with their offset from it."""
    doc = df.where(F.col("chunk_id") == chunk).select("document_id")
    own = df.join(doc, "document_id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("first_page_id").asc_nulls_last(), "chunk_id")))
    at = F.max(F.when(F.col("chunk_id") == chunk, F.col("n"))).over(Window.partitionBy("document_id"))
    found = own.withColumn("offset", F.col("n") - at).where(F.col("offset").between(-before, after))
    return found if seed else found.where("offset <> 0")


def document_order(df: DataFrame) -> DataFrame:
    """Rank of each row of a result by document (unknown last) and chunk."""
    return numbered(df, [F.col("document_id").asc_nulls_last(), F.col("chunk_id").asc()], "document_rank")


def merged_lanes(lanes: dict[str, DataFrame]) -> DataFrame:
    """chunk_id, best score and the lanes (sorted) of results (chunk_id, score)."""
    all_ = reduce(DataFrame.unionByName, (df.select("chunk_id", F.col("score").cast("double").alias("score"), F.lit(n).alias("lane")) for n, df in lanes.items()))
    return all_.groupBy("chunk_id").agg(F.max("score").alias("score"), F.array_join(F.sort_array(F.collect_set("lane")), ",").alias("lanes"))


def hit_test(df: DataFrame, terms: list[str]) -> DataFrame:
    """Per term the chunks and documents with it; terms without a hit have zeros."""
    w = df.select("chunk_id", "document_id", T.lexemes(body()).alias("words"))
    hits = w.select("chunk_id", "document_id", F.explode(F.array_intersect("words", F.array(*(F.lit(t.lower()) for t in terms)))).alias("term"))
    n = hits.groupBy("term").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("document_id").alias("n_docs"))
    asked = df.sparkSession.createDataFrame([(t.lower(),) for t in terms], "term string")
    return asked.join(n, "term", "left").select("term", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def acronym_share(df: DataFrame, term: str, anchor: str, least: float = 0.2) -> DataFrame:
    """Whether enough of the chunks with a short term have the anchor, too."""
    w = df.select("chunk_id", T.lexemes(body()).alias("words")).where(T.has_term("words", term))
    return w.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(T.has_term("words", anchor), 1)).alias("n_both")).withColumn("passes", F.coalesce(F.col("n_both") / F.nullif(F.col("n"), F.lit(0)) >= least, F.lit(False)))


def traced(fusion: DataFrame, **lists: str) -> DataFrame:
    """Flags of which list found each chunk, and the way it was found."""
    a, b = (F.col(c).isNotNull() for c in lists.values())
    return fusion.select("chunk_id", "rank", a.alias("in_lexical"), b.alias("in_vector"), F.when(a & b, "both").when(a, "lexical").otherwise("vector").alias("match_type"))


def quality_at(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """recall, precision and overlap of the first k of a ranked list against relevant chunks, in one row."""
    top = found.where(F.col("rank") <= k).select("chunk_id").distinct().withColumn("got", F.lit(1))
    own = relevant.select("chunk_id").distinct().withColumn("right", F.lit(1))
    n = top.join(own, "chunk_id", "full_outer").agg(F.count("got").alias("n_found"), F.count("right").alias("n_relevant"), F.count(F.when(F.col("got").isNotNull() & F.col("right").isNotNull(), 1)).alias("n_hit"))
    over = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return n.withColumn("recall", over("n_hit", "n_relevant")).withColumn("precision", over("n_hit", "n_found"))
