"""Dimensions and samples read a written catalogue."""

from cartlens.plans import catalogue


def test_dimensions_read_the_catalogue_once(spark, monkeypatch):
    """Every job after the first reads the written catalogue, not the parts and texts."""
    from conftest import SF0001
    made = []
    real = catalogue.materialised
    monkeypatch.setattr(catalogue, "materialised", lambda df, name: made.append(name) or real(df, name))
    for job in (catalogue.product_dim, catalogue.category_dim, catalogue.product_tags, catalogue.stratified_sample,
                catalogue.sample_category_counts):
        made.clear()
        plan = job(spark, SF0001)._jdf.queryExecution().analyzed().toString()
        assert made == ["catalogue"] and "p_retailprice" not in plan
