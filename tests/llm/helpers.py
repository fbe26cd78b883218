"""Fixtures' rows: documents with every awkward case, as plain tuples."""

LANGS = ["en", "de", "fr", "es"]
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside or return, as extra columns of the input.
CLASHES = ["fp", "score", "kept", "n_words", "component_id", "base_failed", "n_bytes", "kept_sha256", "toxic", "part", "slice", "held"]


def awkward():
    """Nulls in every column, empty, blank, repeated and very long texts, ties."""
    prose = "The quick brown fox jumps over the lazy dog while seventeen grey geese watch from the river bank . "
    other = "Fünf große Boxkämpfer jagen Viktor quer über den Sylter Deich und niemand sieht ihnen dabei zu . "
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, " \n\t ", None, "s"), (4, "a", "en", None),
        (5, prose * 3, "en", "s"), (6, prose * 3, "en", "s"), (7, prose * 3 + "end", "en", "s"),
        (8, other * 4, "de", "s"), (9, prose + other + prose, None, None), (10, "word " * 3000, "en", "s"),
        (11, (prose + other) * 400, "de", "s"), (12, "x" * 3000, "en", "s"), (13, "😀 𝔘 日本語 ﬁ é é", "fr", "s"),
        (14, "line one\nline one\nline two\n\nline one", "en", "s"), (15, "$$$ ### | < > & % *", "es", "s"),
        (16, other * 4, "de", "s"), (16, other * 4, "de", "s"), (17, "<|endoftext|> a<|endoftext|>", "en", "s"),
        (None, prose * 2, "en", "s"), (None, None, None, None), (18, prose.upper(), "en", "s"), (-5, "minus " + prose, "en", "s"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The documents with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
