"""Small awkward inputs for the operators' tests."""

WORDS = "valve the pump über release of gas ¿qué? pressure naïve 42 relief's line | flare".split()


def documents():
    """Nulls in every column, empty and very long texts, copies, ties and repeated rows."""
    import random

    random.seed(7)
    rows = [(k, " ".join(random.choices(WORDS, k=random.randint(1, 120))), "en", f"src{k % 3}", 1) for k in range(40)]
    rows += [(40 + k, rows[k][1], "de", "src0", 2) for k in range(8)]
    rows += [(60, None, None, None, None), (61, "", "en", "src1", 0), (62, "", None, "src0", 0), (63, "word " * 30_000, "en", "src0", 5)]
    rows += [(64, "  odd\t\tspace \n\n here ", "en", "src1", 3), (64, "  odd\t\tspace \n\n here ", "en", "src1", 3), (65, "<|endoftext|> x 日本語 é", "ja", "src2", 3)]
    return rows + [(None, "no id", "en", "src1", 1)]


def frame(spark, rows, extra=""):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([r + (1,) * bool(extra) for r in rows], names + (f", {extra} int" if extra else "")).repartition(3)
