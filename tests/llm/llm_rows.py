"""Small inputs that the corpus tests share."""

import datetime

DOCS_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# columns named like ones that operators use inside
CLASHES = ["_row", "_q", "_v", "size", "rate", "target", "grp", "bits", "node", "score", "kept", "piece", "block", "_keep_id"]

PROSE = "the anne house and river of the old town was in the green valley by the long road to the sea "


def odd_documents():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 700} runs{i % 41}" for i in range(30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 4), (4, PROSE * 6, "en", "a", 1),
        (5, PROSE * 6, "en", "b", 1), (5, PROSE * 6, "en", "b", 1), (6, long_text, None, "b", 1),
        (None, PROSE * 7, "en", None, 1), (None, None, None, None, None), (7, "12 34 !!", "de", "a", 8),
        (8, "x" * 50_000, "de", "c", 1), (9, "a  b c \n\n d <|endoftext|> é   z", "fr", "c", None),
        (10, PROSE * 6 + "end", "en", "c", 1), (11, "ONE", "en", "zero", 3), (12, "", "en", "none", 0),
    ]
    return rows


def documents(spark, rows=None, clash=False):
    df = spark.createDataFrame(odd_documents() if rows is None else rows, DOCS_DDL)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHES], F.lit(datetime.date(2020, 1, 1)).alias("open"))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
