"""Small tables with the awkward rows that every operator has to take."""

from pyspark.sql import types as T

LONG = "lange wörter stehen hier in einem text der nicht endet " * 400
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()), T.StructField("word", T.LongType())])


def documents(spark, texts, lang="en"):
    """texts: strings, or (doc_id, text); columns that operators use inside are there with other meanings."""
    rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, lang, "src", 7, "clash", 1) for i, t in rows], DOCS)


def awkward(spark):
    return documents(spark, [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, LONG), (4, LONG), (5, "a b c d e f g h i j k l"), (None, "no id here but some words to read at all"), (6, "éÉ \U0001f600 *** ###"), (7, "x" * 200_000)])


def rows(df):
    return [r.asDict() for r in df.collect()]
