"""Awkward documents that every operator must take."""

LONG = "word " * 30_000 + "x" * 50_000
TEXTS = [None, "", " ", "\n\t ", "plain words in a line", "plain words in a line", "é ü 日本 😀 naïve", "Mixed CASE Text!", "a", LONG, "<p>html</p> & more", "same words " * 40, "<|endoftext|> tail", "nul\x00byte", "\x1c sep \x85 \xa0 nbsp"]


def documents(spark, texts=TEXTS, extra=True):
    """Documents with a null id, a repeated row, null lang and source, and columns whose names may clash."""
    rows = [(i if i != 4 else None, t, "en" if i % 3 else None, "s" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        names = ["kept", "n_words", "row", "key", "spans", "fold", "marks", "ring", "shingles", "rate", "limit_lang", "low_line_rate", "base_failed", "_lang", "_own_kept", "_own_score", "_doc", "_score", "ids", "segments", "fp", "label", "u", "a", "h", "p", "doc", "_row", "word", "c", "score", "_spans", "node"]
        df = df.withColumns({n: F.lit("clash") for n in names})
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
