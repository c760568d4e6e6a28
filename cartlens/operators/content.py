"""TF-IDF content model.

The fitted model is three tables: the corpus, the vocabulary (term, counts,
idf, index) and the TF-IDF triples (product_id, term, term_idx, weight).
Vocabulary size is capped by ``max_features``, a proven bound, so it is the
one table that is broadcast.  Scoring against all products (similar
products, per-user recommendations, search) runs as exact blocked dot
products (``operators.blocks``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cartlens.functions.text import analysed, terms
from cartlens.operators.blocks import top_k_dot
from cartlens.operators.ngram_counts import count_vectors, pair_counts, unit_weights, word_counts
from cartlens.session import materialised

MAX_FEATURES = 500
#: Words per feature that may bound the bigrams to count; with more of them tied at the bound, all bigrams are counted.
TIED_WORDS = 16


def product_corpus(products: DataFrame, categories: DataFrame, tags: DataFrame) -> DataFrame:
    """Products with category name and space-joined tags (in tag_id order), plus the corpus text.

    Products whose category is unknown drop out (inner join).  Tags are
    pre-aggregated per product before the join; a product's tag list is small.
    """
    tag_str = tags.groupBy("product_id").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("tag_id", "tag"))),
                                     lambda t: t["tag"])).alias("tags"))
    cats = categories.select("category_id", F.col("name").alias("category"))
    p = products.select("product_id", "name", "description", "price", "avg_rating", "review_count", "category_id")
    j = p.join(cats, "category_id", "inner").join(tag_str, "product_id", "left")
    desc = F.coalesce(F.col("description"), F.lit(""))
    tg = F.coalesce(F.col("tags"), F.lit(""))
    return with_corpus_text(j.select(
        "product_id", "name", desc.alias("description"), "price", "avg_rating", "review_count", "category",
        tg.alias("tags")))


def with_corpus_text(products: DataFrame) -> DataFrame:
    """``products`` with the text made of their other columns, which need not be written beside them."""
    return products.withColumn("corpus", F.concat(F.col("name"), F.lit(" "), F.col("category"), F.lit(" "), F.col("tags"),
                                                  F.lit(" "), F.col("description")))


def term_counts(docs: DataFrame, id_col: str = "product_id", text_col: str = "corpus", ngram_max: int = 2,
                stop_words: bool = True, only: list[str] | None = None) -> DataFrame:
    """(id, term, tf) raw n-gram counts per document; ``only`` drops other terms before the shuffle."""
    found = terms(F.col(text_col), ngram_max, stop_words)
    if only is not None:
        found = F.filter(found, lambda t: t.isin(only))
    return (docs.select(id_col, F.explode(found).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def words_of(docs: DataFrame, id_col: str = "product_id", text_col: str = "corpus", stop_words: bool = True) -> DataFrame:
    """(id, words): the analysed words of every document, joined by spaces, to be written once and read by each counting pass."""
    return docs.select(id_col, F.array_join(analysed(F.col(text_col), stop_words), " ").alias("words"))


def top_terms(words: DataFrame, max_features: int = MAX_FEATURES, ngram_max: int = 2) -> DataFrame:
    """The ``max_features`` most frequent terms of (id, words) with their counts (ties: term asc).

    Exact in two steps.  Words are counted first; the last of the most frequent ones sets the bound.  A bigram occurs at
    most as often as either of its words, so only pairs of words that reach the bound can be among the most frequent
    terms, and only these are counted and shuffled, not every distinct pair of the corpus.
    """
    order = [F.col("term_count").desc(), F.col("term").asc()]
    single = materialised(word_counts(words), "word_counts")
    top = single.orderBy(*order).limit(max_features)
    if ngram_max < 2:
        return top
    first = top.agg(F.count(F.lit(1)), F.min("term_count")).first()
    bound = first[1] if first[0] == max_features else 0
    if not first[0]:
        return top
    most = TIED_WORDS * max_features
    able = [r["term"] for r in single.where(F.col("term_count") >= bound).select("term").limit(most + 1).collect()]
    pairs = pair_counts(words, None if len(able) > most else able)
    return top.unionByName(pairs).orderBy(*order).limit(max_features)


def unrolled(counts: DataFrame, chosen: list[str], id_col: str = "product_id") -> DataFrame:
    """T5: (id, term, tf) of the rows (id, idx, tf) of ``count_vectors``."""
    names = counts.sparkSession.createDataFrame(list(enumerate(chosen)), "idx int, term string")
    rows = counts.select(id_col, F.explode(F.arrays_zip("idx", "tf")).alias("_e")).select(id_col, "_e.idx", "_e.tf")
    return rows.join(F.broadcast(names), "idx").select(id_col, "term", "tf")


def counts_of_terms(words: DataFrame, chosen: list[str], id_col: str = "product_id", ngram_max: int = 2) -> DataFrame:
    """T5: (id, term, tf) of the ``chosen`` terms in (id, words)."""
    return unrolled(count_vectors(words, chosen, id_col, ngram_max), chosen, id_col)


def vocabulary(top: DataFrame, tf: DataFrame, n_docs: int) -> DataFrame:
    """The chosen terms with document frequency, smoothed idf and index.

    ``tf`` holds the counts of these terms per document.  idf = ln((1 + n) / (1 + df)) + 1.
    """
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    w = Window.orderBy(F.col("term_count").desc(), F.col("term").asc())  # at most max_features rows
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("doc_freq"))) + F.lit(1.0)
    return top.join(stats, "term").select("term", "term_count", "doc_freq", idf.alias("idf"),
                                          (F.row_number().over(w) - 1).cast("int").alias("term_idx"))


def tfidf(tf: DataFrame, vocab: DataFrame, id_col: str = "product_id") -> DataFrame:
    """(id, term, term_idx, weight): tf x idf over vocabulary terms, L2-normalised per document."""
    v = F.broadcast(vocab.select("term", "term_idx", "idf"))
    w = tf.join(v, "term", "inner").select(id_col, "term", "term_idx", (F.col("tf") * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", "term_idx", (F.col("_w") / norm).alias("weight"))


def tfidf_of_vectors(counts: DataFrame, vocab: DataFrame, id_col: str = "product_id") -> DataFrame:
    """What ``tfidf`` gives, from the rows (id, idx, tf) of ``count_vectors`` whose places are the ``term_idx`` of ``vocab``.

    A row holds all terms of its id, so its length needs no exchange.
    """
    idf = [r["idf"] for r in vocab.select("term_idx", "idf").orderBy("term_idx").collect()]  # at most max_features
    names = F.broadcast(vocab.select("term_idx", "term"))
    return unit_weights(counts, idf, id_col).join(names, "term_idx").select(id_col, "term", "term_idx", "weight")


def vectors(weights: DataFrame, id_col: str, weight_col: str = "weight") -> DataFrame:
    """Sparse vectors (id, idx, val); at most ``max_features`` entries per id."""
    return weights.groupBy(id_col).agg(
        F.collect_list(F.struct(F.col("term_idx"), F.col(weight_col))).alias("_e")
    ).select(F.col(id_col).alias("id"), F.col("_e.term_idx").alias("idx"), F.col(f"_e.{weight_col}").alias("val"))


@dataclass
class ContentModel:
    corpus: DataFrame
    vocab: DataFrame
    weights: DataFrame
    n_docs: int
    dim: int
    ngram_max: int = 2
    stop_words: bool = True

    @property
    def product_vectors(self) -> DataFrame:
        return vectors(self.weights, "product_id")


def fit(corpus: DataFrame, max_features: int = MAX_FEATURES, ngram_max: int = 2,
        stop_words: bool = True) -> ContentModel:
    """T3-T7 over ``corpus`` (product_id, corpus, ...), in one pass over the text.

    The analysed words are written once.  ``top_terms`` counts words and the
    pairs that can matter; the last pass counts only the chosen terms, and one
    row of an id, with at most ``max_features`` places, is exchanged and written.
    """
    n_docs = corpus.count()
    words = materialised(words_of(corpus, stop_words=stop_words), "words")
    top = materialised(top_terms(words, max_features, ngram_max), "terms")
    # at most max_features, in the order of ``term_idx``
    chosen = [r["term"] for r in top.orderBy(F.col("term_count").desc(), F.col("term").asc()).collect()]
    counts = materialised(count_vectors(words, chosen, "product_id", ngram_max), "term_counts")
    vocab = materialised(vocabulary(top, unrolled(counts, chosen), n_docs), "vocabulary")
    weights = materialised(tfidf_of_vectors(counts, vocab), "tfidf")
    return ContentModel(corpus=corpus, vocab=vocab, weights=weights, n_docs=n_docs, dim=max_features,
                        ngram_max=ngram_max, stop_words=stop_words)


def similar_products(model: ContentModel, n: int = 10, requested: DataFrame | None = None) -> DataFrame:
    """Top-n cosine neighbours of each requested product (default: all), self excluded, > 0, round 4."""
    vec = model.product_vectors
    if requested is None:
        got = top_k_dot(vec, None, model.dim, n, exclude_self=True)
    else:
        left = vec.join(requested.select(F.col("product_id").alias("id")), "id", "left_semi")
        got = top_k_dot(left, vec, model.dim, n, exclude_self=True)
    return got.select(F.col("left_id").alias("product_id"), F.col("right_id").alias("other_product_id"),
                      F.round("score", 4).alias("similarity"), "rank")


def user_profiles(train: DataFrame, model: ContentModel, top_items: int = 5) -> DataFrame:
    """T9 first half: sum of the TF-IDF vectors of each user's ``top_items`` best-scored train items.

    Rows are unit length, so sum_j cos(j, i) = (sum_j x_j) . x_i: one profile
    vector per user replaces ``top_items`` separate similarity passes.  Items
    missing from the catalogue contribute nothing (T11).
    """
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("product_id").asc())
    top = train.select("user_id", "product_id", "score").withColumn("_r", F.row_number().over(w)) \
        .filter(F.col("_r") <= top_items).select("user_id", "product_id")
    prof = top.join(model.weights, "product_id", "inner").groupBy("user_id", "term_idx") \
        .agg(F.sum("weight").alias("weight"))
    return prof


def content_recs(train: DataFrame, model: ContentModel, n: int = 10, top_items: int = 5,
                 users: DataFrame | None = None) -> DataFrame:
    """Per user, profile . product vector over all products; seen items removed before the cut; > 0; round 4.

    A user without train history gets no rows (no fallback here).
    """
    hist = train if users is None else train.join(users.select("user_id"), "user_id", "left_semi")
    prof = vectors(user_profiles(hist, model, top_items), "user_id")
    seen = hist.select(F.col("user_id").alias("id"), F.col("product_id").alias("right_id")).distinct()
    got = top_k_dot(prof, model.product_vectors, model.dim, n, left_excl=seen)
    return got.select(F.col("left_id").alias("user_id"), F.col("right_id").alias("product_id"),
                      F.round("score", 4).alias("score"), "rank")


def query_vectors(queries: DataFrame, model: ContentModel, id_col: str = "query_id",
                  text_col: str = "text") -> DataFrame:
    """Vectorise free-text queries with the fitted vocabulary and idf (unknown terms ignored)."""
    chosen = [r["term"] for r in model.vocab.select("term").collect()]  # at most max_features
    tf = term_counts(queries.select(id_col, text_col), id_col, text_col, model.ngram_max, model.stop_words, only=chosen)
    return tfidf(tf, model.vocab, id_col)


def search(queries: DataFrame, model: ContentModel, n: int = 10, id_col: str = "query_id",
           text_col: str = "text") -> DataFrame:
    """Top-n products per query by cosine (> 0), with name, category, price, rating."""
    qv = vectors(query_vectors(queries, model, id_col, text_col), id_col)
    got = top_k_dot(qv, model.product_vectors, model.dim, n)
    details = model.corpus.select("product_id", "name", "category", "price", F.col("avg_rating").alias("rating"))
    return got.select(F.col("left_id").alias(id_col), F.col("right_id").alias("product_id"),
                      F.round("score", 4).alias("score"), "rank").join(details, "product_id", "inner")

