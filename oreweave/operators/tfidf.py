"""TF-IDF over unigrams and bigrams with a capped vocabulary, L2-normalised rows, cosine scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.text import with_bigrams, word_tokens
from oreweave.session import stored
from oreweave.tables import text_parts


def term_counts(docs: DataFrame, keys: Sequence[str], parts: int, text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """keys, ``term``, ``tf``. The texts are shuffled once by key; counting reuses that partitioning.

    ``parts`` bounds what a task counts. With ``only``, a table of terms that may be broadcast,
    other terms are left out before counting. Counting inside the row with array functions was
    tried and was five times slower.
    """
    placed = docs.select(*keys, text).repartition(parts, *keys).select(*keys, word_tokens(F.col(text)).alias("_tokens"))
    terms = placed.select(*keys, F.explode(with_bigrams(F.col("_tokens"))).alias("term"))
    if only is not None:
        terms = terms.join(F.broadcast(only.select("term")), "term", "left_semi")
    return terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, keys: Sequence[str], parts: int, text: str = "text", max_features: int = K.TFIDF_MAX_FEATURES) -> DataFrame:
    """The most frequent terms with their inverse document frequency.

    At most ``max_features`` rows whatever the corpus, so it may be broadcast. Ties in the
    corpus count are cut in term order. Counts of texts go to the tasks of their terms as they
    are: most bigrams are rare, so adding them up before would fill memory and save little.
    """
    total = docs.agg(F.count("*").alias("n")).scalar()
    counts = term_counts(docs, keys, parts, text).select("term", "tf").repartition(parts, "term")
    per_term = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    top = per_term.orderBy(F.desc("cf"), "term").limit(max_features)
    return top.select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def batch_scores(
    docs: DataFrame,
    keys: Sequence[str],
    queries: Sequence[str],
    text: str = "text",
    max_features: int = K.TFIDF_MAX_FEATURES,
) -> DataFrame:
    """Cosine of every document with each of a few queries: keys, ``query`` (place in the list), ``score``.

    The texts are tokenised twice, for the vocabulary and for the counts of its terms: the counts of
    all terms are many times larger than the texts and are not kept.
    All queries share one vocabulary and one scoring pass: a term carries its weight in each
    query, and a document's partial sums are added before they leave the task.
    """
    parts = text_parts(docs, text)
    terms = stored(vocabulary(docs, keys, parts, text, max_features))
    counts = term_counts(docs, keys, parts, text, terms)
    rows = docs.sparkSession.createDataFrame([(i, q) for i, q in enumerate(queries)], "query int, text string")
    asked = (
        rows.select("query", F.explode(with_bigrams(word_tokens(F.col("text")))).alias("term"))
        .groupBy("term").pivot("query", list(range(len(queries)))).count()
    )
    names = [f"_q{i}" for i in range(len(queries))]
    weights = terms.join(F.broadcast(asked), "term", "left").select(  # as many terms as the queries have words
        "term", "idf", *[(F.coalesce(F.col(str(i)), F.lit(0)) * F.col("idf")).alias(n) for i, n in enumerate(names)]
    )
    lengths = weights.agg(*[F.sqrt(F.sum(F.col(n) * F.col(n))).alias(n) for n in names]).first()  # one row
    weight = F.col("tf") * F.col("idf")
    per_doc = counts.join(F.broadcast(weights), "term").groupBy(*keys).agg(
        F.sqrt(F.sum(weight * weight)).alias("_norm"), *[F.sum(weight * F.col(n)).alias(n) for n in names]
    )
    cells = F.array(*[
        F.struct(F.lit(i).alias("query"), (F.col(n) / (F.col("_norm") * F.lit(lengths[n] or 1.0))).alias("score"))
        for i, n in enumerate(names)
    ])
    return per_doc.select(*keys, F.inline(F.filter(cells, lambda c: c["score"] > 0)))


def document_scores(
    docs: DataFrame,
    keys: Sequence[str],
    query: str,
    text: str = "text",
    max_features: int = K.TFIDF_MAX_FEATURES,
) -> DataFrame:
    """Cosine of every document with the query: keys and ``score``, positive scores only."""
    return batch_scores(docs, keys, [query], text, max_features).drop("query")


class TfidfIndex:
    """Stored inverted index: build once, then a search reads only the postings of its terms.

    Postings are range-partitioned and sorted by (term, document), so the term filter skips
    row groups and a very frequent term is spread over several files.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    @classmethod
    def build(
        cls,
        docs: DataFrame,
        keys: Sequence[str],
        path: str,
        text: str = "text",
        max_features: int = K.TFIDF_MAX_FEATURES,
    ) -> TfidfIndex:
        index = cls(docs.sparkSession, path, keys)
        docs = stored(docs.select(*keys, text))  # read three times
        parts = text_parts(docs, text)
        vocabulary(docs, keys, parts, text, max_features).write.mode("overwrite").parquet(f"{index.path}/vocabulary")
        terms = index.spark.read.parquet(f"{index.path}/vocabulary")
        counts_path = f"{index.path}/counts"
        term_counts(docs, keys, parts, text, terms).write.mode("overwrite").parquet(counts_path)
        counts = index.spark.read.parquet(counts_path)
        weights = counts.join(F.broadcast(terms), "term").select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w"))
        norms = weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        postings = weights.join(norms, list(keys)).select("term", *keys, (F.col("w") / F.col("norm")).alias("weight"))
        (
            postings.repartitionByRange("term", *keys).sortWithinPartitions("term", *keys)
            .write.mode("overwrite").parquet(f"{index.path}/postings")
        )
        return index

    def scores(self, query: str) -> DataFrame:
        """Cosine of the query with every document that shares a term with it."""
        row = self.spark.createDataFrame([(query,)], "text string")
        asked = row.select(F.explode(with_bigrams(word_tokens(F.col("text")))).alias("term")).groupBy("term").agg(
            F.count("*").alias("qtf")
        )
        vocabulary_table = self.spark.read.parquet(f"{self.path}/vocabulary")
        known = asked.join(vocabulary_table, "term").select("term", (F.col("qtf") * F.col("idf")).alias("qw")).collect()
        length = sum(r["qw"] ** 2 for r in known) ** 0.5
        postings = self.spark.read.parquet(f"{self.path}/postings")
        if not length:
            return postings.where(F.lit(False)).select(*self.keys, F.col("weight").alias("score"))
        # the query's own terms, a handful of literals
        share = F.lit(0.0)
        for r in known:
            share = F.when(F.col("term") == r["term"], r["qw"] / length).otherwise(share)
        hits = postings.where(F.col("term").isin([r["term"] for r in known]))
        return hits.groupBy(*self.keys).agg(F.sum(F.col("weight") * share).alias("score"))
