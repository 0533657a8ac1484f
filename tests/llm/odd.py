"""Documents with the cases that every operator must define: nulls, empty, long, ties, repeats, clashes."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, row string, key string, shard string, target string"

LONG = " ".join(f"word{i % 977} the" for i in range(20_000))

ROWS = [
    (1, "All rights reserved. CC BY all RIGHTS reserved, general public license", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n\x0b\x0c\r", "en", None, 6),
    (5, LONG, "en", "b", len(LONG)),
    (6, LONG + " tail", "en", "b", 1),
    (7, "Released under the MIT License. a@b.co +1 555 123 4567 10.0.0.1 4111 1111 1111 1111", "en", "é", 1),
    (8, "Released under  the MIT License. a@b.co +1 555 123 4567 10.0.0.1 4111 1111 1111 1111", "en", "é", 1),
    (8, "Released under  the MIT License. a@b.co +1 555 123 4567 10.0.0.1 4111 1111 1111 1111", "en", "é", 1),
    (None, "one two three four", "en", "z", 1),
    (10, "one two three four", "en", "z", 1),
    (11, "ONE two three four", "en", "z", 1),
    (12, "one", "en", "🙂", 1),
    (13, "漢字 <|endoftext|> 🙂 é x y", "en", "￿", 1),
    (14, "RIFF BM GIF89a %PDF-1.4 \x00 ÿØÿ", "en", "a", 1),
]


def frame(spark, rows=ROWS):
    """The rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([r + (7, None, "r", "k", "s", "t") for r in rows], COLUMNS)
