"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

LATIN = "the of and to in is was for with that on are this have from or by one had not but what all were when we there can".split()
SYLLABLES = ["ka", "lo", "mi", "ren", "tos", "vel", "dar", "un", "pi", "sho", "gra", "ble"]


def sentence(rng, n):
    return " ".join(rng.choice(LATIN) if rng.random() < 0.3 else "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source, n_chars), with null ids, texts and sources, and rows that repeat."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(30)]
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 4}" if k % 7 else None, len(t)) for k, t in enumerate(base)]
    rows += [(100, None, "en", "src0", None), (101, "", None, None, 0), (102, " \t\n\x0b", "de", "src1", 4), (103, "word", "en", "src1", 4)]
    rows += [(104, base[3], "en", "src2", 1), (105, base[3] + " tail", "fr", "src2", 1), rows[3], rows[3], (None, base[4], "en", "src0", 1), (None, None, None, None, None)]
    rows += [(106, sentence(rng, 30_000), "en", "src3", 1), (107, "x" * 50_000, "en", "src3", 1), (108, ("ab " * 3000).strip(), "en", "src3", 1)]
    rows += [(3, base[5], "en", "src1", 1)]  # an id with another text
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, clash=True):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    if clash:  # names that operators use inside
        from pyspark.sql import functions as F

        for name in ("row", "h", "w", "key", "id", "fp", "node", "root", "size", "host", "score", "lang_pred", "low", "places"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
