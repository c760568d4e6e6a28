"""Small tables for the operators' edge cases."""

from pyspark.sql import functions as F

SF0001 = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 997}x" for i in range(30_000))
#: Null, empty and blank texts, a very long one, equal ones under two ids, a whole repeated row, null in every other column.
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 4), (4, LONG, "en", "b", len(LONG)),
    (5, "one text that stands in two documents of this table", "en", None, 50),
    (6, "one text that stands in two documents of this table", "en", None, 50),
    (7, "É à ñ word-with-ümlaut, and so on and so forth until ten words", "fr", "c", 60),
    (7, "É à ñ word-with-ümlaut, and so on and so forth until ten words", "fr", "c", 60),
]


def docs(spark, rows=EDGE):
    return spark.createDataFrame(rows, DOCS)


def clashing(df, names=("bucket", "Before", "part", "score", "spans", "shard", "jump_key", "mix_plan", "label", "rank", "size")):
    """``df`` with further columns whose names the operators use inside."""
    return df.withColumns({n: F.lit("other") for n in names})
