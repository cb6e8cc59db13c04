"""Rows that every operator takes."""

#: Nulls in any column, empty and blank texts, a very long text, one very long word, repeated rows, one id with two texts, characters of every width.
ODD = [
    (1, None), (None, "a text without an id"), (2, ""), (3, " \n\t "), (4, "word " * 60_000, "en", "s"), (5, "x" * 50_000, "en", None), (6, "twice the same row", "en", "s"), (6, "twice the same row", "en", "s"),
    (7, "one id", "en", "s"), (7, "two texts", "en", "s"), (8, "日本語 🙂 ﬁ ½ é\u0000 ▁x  y", None, "s"), (9, "  two  spaces\n\nand lines \r\n", "de", "t"), (None, None, None, None),
]
