"""Written tables read back as they were."""

import glob

from conftest import SF0001
from cartlens.sources import sinks


def test_sinks_roundtrip(spark, tmp_path):
    from cartlens.plans.context import inputs
    i = inputs(spark, SF0001)
    base = str(tmp_path / "out")
    paths = sinks.write_cleaned(i.clean, i.train, i.test, base)
    assert sinks.read_table(spark, paths["train"]).count() == i.train.count()
    recs = spark.createDataFrame([(1, 1, 2, "CF", 0.5, 0, None)],
                                 "rec_id long, user_id long, product_id long, algo_used string, score double, "
                                 "was_clicked int, generated_at timestamp_ntz")
    p = sinks.write_recommendations(recs, base)
    assert glob.glob(p + "/algo_used=CF/*.parquet")
    from cartlens.operators import matrix as mx
    m = sinks.write_matrix(mx.user_item_scores(i.train), base)
    assert sinks.read_table(spark, m).count() == i.train.count()
    dims = sinks.write_dimensions(i.categories, i.products, i.tags, base)
    assert sinks.read_table(spark, dims["products"]).count() == i.products.count()
    models = sinks.save_models(base, item_pairs=i.cf_pairs, vocab=i.content.vocab, weights=i.content.weights)
    assert sinks.read_table(spark, models["vocabulary"]).count() == i.content.vocab.count()
