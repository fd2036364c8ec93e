"""Rows that operators must survive, and a view of results that can be compared."""

CLASHES = "row string, own string, ids string, digest string, salt int, place int, n int, kept string, norm string, fp long, _id long, rank int, n_words long, rest int, shard long"


def documents(spark, rows=None, extra=True):
    """doc_id, text, lang, source, n_chars and columns named like an operator's own."""
    long = "lorem ipsum dolor sit amet " * 4000
    base = [
        (5, "Some text with words in it. " * 4, "en", "a"), (2, "some TEXT with words in it. " * 4, "en", "a"), (9, None, None, None),
        (1, "", "en", None), (7, "x", None, "b"), (3, "Ünïcödé wörds ① ½ 漢字 🙂 ok", "de", "b"), (3, "Ünïcödé wörds ① ½ 漢字 🙂 ok", "de", "b"),
        (None, "no id at all", "fr", "c"), (None, None, None, None), (11, long, "en", "a"), (12, long + "tail", "en", "a"),
        (13, "<|endoftext|> and <|startoftext|> inside", "en", "a"), (14, " \n\t\x0b \x85  ", "en", "a"),
    ]
    rows = base if rows is None else rows
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(*r, len(r[1] or "")) for r in rows]
    if extra:
        names = CLASHES.split(", ")
        full = [(*r, *[None if i % 2 else ("z" if "string" in c else i) for i, c in enumerate(names)]) for r in full]
        ddl += ", " + CLASHES
    return spark.createDataFrame(full, ddl).repartition(3)


def seen(df):
    return sorted(map(tuple, df.collect()), key=repr)
