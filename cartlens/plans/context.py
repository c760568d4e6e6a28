"""Shared inputs of the registered queries.

Several queries start from the same cleaned train/test tables.  ``Inputs``
builds them once for a session and the files of a data folder, and writes the
reused ones as Parquet under the shared folder (``session.materialised``), so
that readers prune columns and a lost executor does not replay the dedup.
Only the inputs of the folder used last are remembered, and only while its
files stay as they are.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cartlens.operators import interactions as ix
from cartlens.session import materialised
from cartlens.sources import tables

_CACHE: dict = {}
CF_LIST = 40  # where the shared user- and item-based lists are cut


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # raw reference tables
    @cached_property
    def interactions(self) -> DataFrame:
        return tables.order_log(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return tables.event_log(self.spark, self.sf_dir)

    @cached_property
    def products(self) -> DataFrame:
        """Product attributes; the texts are read where they are needed (``products_with_text``)."""
        return materialised(tables.products(self.spark, self.sf_dir, self.categories).drop("description"), "products")

    @cached_property
    def products_with_text(self) -> DataFrame:
        return tables.products(self.spark, self.sf_dir, self.categories)

    @cached_property
    def categories(self) -> DataFrame:
        return materialised(tables.categories(self.spark, self.sf_dir), "categories")

    @cached_property
    def tags(self) -> DataFrame:
        return tables.product_tags(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return materialised(tables.users(self.spark, self.sf_dir), "users")

    # cleaned interaction tables (written once)
    @cached_property
    def cleaned(self) -> ix.CleanResult:
        return ix.run(self.interactions, self.products, materialize=True)

    @cached_property
    def cf_pairs(self) -> DataFrame:
        """Item-pair table (cosine and Gram sums) shared by all CF scorers."""
        from cartlens.operators.similarity import item_pairs
        return materialised(item_pairs(self.train), "item_pairs")

    @cached_property
    def cf_lists(self) -> DataFrame:
        """Top-40 user- and item-based lists and the top-10 full blend for every train user.

        40 = 4n for n = 10: the hybrid asks the CF blend for 2n, which cuts each list to 4n.
        Evaluated from the neighbours' histories (``cf_lists``), without the pair table; ``cf.cf_scores`` +
        ``cf.ranked_lists`` is the equivalent all-join plan, ``cf_blocks`` the blocked one.
        """
        from cartlens.operators.cf_lists import neighbour_lists
        return materialised(neighbour_lists(self.train, k_user=CF_LIST, k_item=CF_LIST, k_blend=10), "cf_lists")

    @cached_property
    def corpus(self) -> DataFrame:
        """Products with their texts; the corpus text is joined again where it is read, not written beside its parts."""
        from cartlens.operators.content import product_corpus, with_corpus_text
        got = product_corpus(self.products_with_text, self.categories, self.tags)
        return with_corpus_text(materialised(got.drop("corpus"), "corpus"))

    @cached_property
    def content(self):
        """Fitted TF-IDF model (vocabulary and weights written)."""
        from cartlens.operators.content import fit
        return fit(self.corpus)

    @cached_property
    def similar_lists(self) -> DataFrame:
        """The ten most similar products of every product (T8); shorter lists are its prefixes."""
        from cartlens.operators.content import similar_products
        return materialised(similar_products(self.content, 10), "similar_lists")

    @cached_property
    def content_lists(self) -> DataFrame:
        """Content recommendations, top 20 (= 2n) per train user; the top-10 list is its prefix."""
        from cartlens.operators.content import content_recs
        return materialised(content_recs(self.train, self.content, 20), "content_lists")

    @property
    def clean(self) -> DataFrame:
        return self.cleaned.clean

    @property
    def train(self) -> DataFrame:
        return self.cleaned.train

    @property
    def test(self) -> DataFrame:
        return self.cleaned.test


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """(name, size, time of change) of the files of the data folder, from the file system Spark reads them from."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(conf).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.conf.get("spark.app.id"), sf_dir.rstrip("/"), _files(spark, sf_dir))
    got = _CACHE.get(key)
    if got is None or got.spark is not spark:
        got = Inputs(spark, sf_dir)
        _CACHE.clear()
        _CACHE[key] = got
    return got


def forget() -> None:
    """Drop the remembered inputs; the next query builds its own."""
    _CACHE.clear()
