"""Text, heading, identifier and title functions as column expressions."""

from __future__ import annotations

from functools import reduce

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: ColumnOrName) -> Column:
    """Strip white space in the wide sense at both ends."""
    return F.regexp_replace(col(c), f"^{P.WS}+|{P.WS}+$", "")


def squeeze(c: ColumnOrName) -> Column:
    return trim(F.regexp_replace(col(c), f"{P.WS}+", " "))


def normalise_whitespace(c: ColumnOrName) -> Column:
    """Line ends, soft hyphens, ligatures and blanks of extracted page text; no empty lines."""
    c = F.regexp_replace(col(c), "\r\n?", "\n")
    for was, now in (("\u00ad", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(was), F.lit(now))
    c = F.regexp_replace(c, "[ \t\u00a0]+", " ")
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != ""), "\n")


# headings


def classify_heading(c: ColumnOrName) -> Column:
    """struct(kind, label, title) of an annex, table or clause heading, else null."""
    c = col(c)

    def named(pattern: str, kind: str) -> Column:
        part = lambda i: F.regexp_extract(c, pattern, i)
        return F.struct(F.lit(kind).alias("kind"), F.concat(part(1), F.lit(" "), part(2)).alias("label"), trim(part(3)).alias("title"))

    rest = F.regexp_replace(c, P.CLAUSE, "")
    clause = F.struct(F.lit("clause").alias("kind"), F.regexp_extract(c, P.CLAUSE, 1).alias("label"), trim(F.substring(rest, 1, P.HEADING_TITLE_CHARS)).alias("title"))
    return F.when(c.rlike(P.ANNEX), named(P.ANNEX, "annex")).when(c.rlike(P.TABLE), named(P.TABLE, "table")).when(c.rlike(P.CLAUSE), clause)


def is_bare_heading(c: ColumnOrName) -> Column:
    return classify_heading(c).isNotNull() & (F.char_length(col(c)) < P.BARE_HEADING_CHARS)


#: The characters of ``NON_LETTER``, one by one: they are looked up faster than matched.
NON_LETTERS = "".join(c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and re.match(P.NON_LETTER, c, re.A))


def letter_density(c: ColumnOrName) -> Column:
    """Letters among what is no digit, blank, punctuation or currency sign."""
    return let(F.translate(col(c), NON_LETTERS, ""), lambda bare: F.char_length(F.regexp_replace(bare, r"\P{L}+", "")) / F.greatest(F.char_length(bare), F.lit(1)))


def digit_ratio(c: ColumnOrName) -> Column:
    """Share of characters inside numbers, their inner points and commas included."""
    return F.char_length(F.array_join(F.regexp_extract_all(col(c), F.lit(P.NUMERIC), F.lit(0)), "")) / F.greatest(F.char_length(col(c)), F.lit(1))


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def looks_like_table_row(c: ColumnOrName) -> Column:
    """Each pattern is matched once a line at most."""
    c = col(c)
    found = F.struct(F.regexp_extract_all(c, F.lit(P.NUMERIC), F.lit(0)).alias("numbers"), letter_density(c).alias("density"))

    def judged(x: Column) -> Column:
        numbers, density = F.size(x["numbers"]), x["density"]
        digits = F.char_length(F.array_join(x["numbers"], "")) / F.greatest(F.char_length(c), F.lit(1))
        numeric = ((numbers >= 3) & (density < 0.5)) | ((numbers >= 4) & (digits >= 0.3)) | (density < 0.35)
        return numeric | c.rlike(P.CURRENCY) | ((digits >= 0.2) & c.rlike(P.CURRENCY_WORD))

    return let(found, judged)


# passages for an embedding model


def embeddable_text(title: ColumnOrName, clause: ColumnOrName, page: ColumnOrName, heading: ColumnOrName, content: ColumnOrName) -> Column:
    some = lambda c, label: F.when(F.coalesce(col(c), F.lit("")) != "", F.concat(F.lit(label), col(c)))
    parts = F.concat_ws(" | ", col(title), some(clause, "clause "), F.concat(F.lit("page "), col(page).cast("string")), some(heading, "section: "))
    return F.concat(F.lit("["), parts, F.lit("]\n"), col(content))


def document_input(text: ColumnOrName, title: ColumnOrName | None = None, prefix: str = "search_document: ") -> Column:
    return F.concat(F.lit(prefix), titled_input(text, title))


def titled_input(text: ColumnOrName, title: ColumnOrName | None = None, prefix_title: bool = True) -> Column:
    """For services without a field for titles: the title, if wanted and there, before the text."""
    if title is None or not prefix_title:
        return col(text)
    return F.concat(F.when(F.coalesce(col(title), F.lit("")) != "", F.concat(col(title), F.lit("\n\n"))).otherwise(""), col(text))


def separate_input(text: ColumnOrName, title: ColumnOrName) -> Column:
    """For services that take titles by themselves: (text, title or null)."""
    return F.struct(col(text).alias("text"), F.nullif(col(title), F.lit("")).alias("title"))


def query_input(text: ColumnOrName, prefix: str = "search_query: ") -> Column:
    return F.concat(F.lit(prefix), col(text))


def estimate_tokens(c: ColumnOrName, chars_per_token: float = 2.2) -> Column:
    return F.ceil(F.char_length(F.coalesce(col(c), F.lit(""))) / F.lit(chars_per_token)).cast("long")


# identifiers, titles, topics


def parse_identifier(c: ColumnOrName) -> Column:
    """struct(code, year) of the first standard number in a query, else null; year may be null."""
    part = lambda i: F.regexp_extract(col(c), P.IDENTIFIER, i)
    return F.when(part(1) != "", F.struct(part(1).alias("code"), F.nullif(part(2), F.lit("")).alias("year")))


def passage_has_identifier(content: ColumnOrName, code: ColumnOrName, year: ColumnOrName) -> Column:
    text = F.coalesce(col(content), F.lit(""))
    whole = F.regexp_like(text, F.concat(F.lit(P.W0), col(code), F.lit(P.W1)))
    return F.coalesce(whole & (col(year).isNull() | F.contains(text, col(year))), F.lit(False))


def tidy_title(c: ColumnOrName, truncated: ColumnOrName) -> Column:
    """A title without designation, revision note and loose end; '' if little is left."""
    two = f"{P.WS}{{2,}}"
    clean = lambda x: trim(F.regexp_replace(x, two, " "))
    plain = clean(F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), P.TITLE_DESIGNATION, ""), P.TRAILING_PUNCTUATION, ""))
    bare = clean(F.regexp_replace(plain, P.REVISION_NOTE, ""))
    # the last word of a cut title is likely cut too, unless a revision note followed it
    words = F.regexp_extract(bare, r"(?s)^(.{25,}) [^ ]*$", 1)
    cut = F.when((bare == plain) & (words != ""), words).otherwise(bare)

    def repair(x: Column) -> Column:
        opened = F.instr(x, "(")
        x = F.when((opened > 0) & ~F.contains(F.substr(x, F.greatest(opened, F.lit(1))), F.lit(")")), F.substr(x, F.lit(1), opened - 1)).otherwise(x)
        return trim(F.regexp_replace(F.regexp_replace(x, P.DANGLING_WORD, ""), P.TRAILING_PUNCTUATION, ""))

    # four passes, bound one by one so that the expression does not grow fourfold
    repaired = F.aggregate(F.sequence(F.lit(1), F.lit(4)), cut, lambda x, _: repair(x))
    out = F.when(col(truncated), repaired).otherwise(bare)
    return F.when(F.char_length(out) >= P.TITLE_LEAST_CHARS, out).otherwise("")


def fnv1a(c: ColumnOrName) -> Column:
    """Signed 32-bit FNV-1a over UTF-16 units; characters beyond the basic plane are two."""
    units = F.regexp_extract_all(F.hex(F.encode(F.coalesce(col(c), F.lit("")), "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    step = lambda h, u: F.pmod(h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * 16_777_619, F.lit(1 << 32))
    h = F.aggregate(units, F.lit(2_166_136_261).cast("long"), step)
    return F.when(F.size(units) == 0, h).when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def rotate(items: ColumnOrName, seed: ColumnOrName) -> Column:
    """An array turned to start at a place that depends on the seed alone."""
    a = col(items)
    start = F.pmod(F.abs(fnv1a(seed)), F.greatest(F.size(a), F.lit(1))).cast("int")
    return F.when(F.size(a) <= 1, a).otherwise(F.concat(F.slice(a, start + 1, F.size(a)), F.slice(a, F.lit(1), start)))


def tidy_clause(c: ColumnOrName) -> Column:
    """A clause label fit to show, else null."""
    s = squeeze(F.coalesce(col(c), F.lit("")))
    number = s.rlike("^[0-9.]+$") & ~s.rlike(P.CLAUSE_NUMBER)
    return F.when((s != "") & (F.char_length(s) <= P.CLAUSE_CHARS) & ~s.rlike(P.CLAUSE_YEAR) & ~number, s)


def clause_order(c: ColumnOrName) -> Column:
    """A sort key: numbered clauses first and by their numbers, then the others by text."""
    c = col(c)
    number = c.rlike("^[0-9]")
    part = lambda p: F.coalesce(F.regexp_extract(p, r"^(\d+)", 1).try_cast("long"), F.lit(0))
    parts = F.split(c, r"\.")
    padded = F.slice(F.concat(F.transform(parts, part), F.array_repeat(F.lit(0).cast("long"), 12)), 1, 12)
    return F.struct(
        (~number).alias("named"),
        F.when(number, padded).otherwise(F.array().cast("array<long>")).alias("numbers"),
        F.when(number, F.size(parts)).otherwise(0).alias("depth"),
        F.when(number, F.lit("")).otherwise(c).alias("name"),
    )


def short_label(c: ColumnOrName) -> Column:
    """A document title short enough for a list."""
    base = trim(F.element_at(F.split(F.coalesce(col(c), F.lit("")), f"{P.WS}+[—–]{P.WS}+"), 1))
    bare = trim(F.regexp_replace(base, f"(?i)^(the|a|an){P.WS}+", ""))
    base = F.when(bare == "", base).otherwise(bare)
    head = F.substring(base, 1, P.LABEL_CHARS)
    comma, space = F.regexp_extract(head, r"(?s)^(.{13,}),[^,]*$", 1), F.regexp_extract(head, r"(?s)^(.{13,}) [^ ]*$", 1)
    short = F.when(comma != "", trim(comma)).when(space != "", F.concat(space, F.lit("…"))).otherwise(F.concat(head, F.lit("…")))
    return F.when(F.char_length(base) <= P.LABEL_CHARS, base).otherwise(short)


def passage_excerpt(c: ColumnOrName, chars: int = 180) -> Column:
    text = squeeze(F.coalesce(col(c), F.lit("")))
    head = F.substring(text, 1, chars)
    words = F.regexp_extract(head, r"(?s)^(.{41,}) [^ ]*$", 1)
    return F.when(F.char_length(text) <= chars, text).otherwise(F.concat(trim(F.when(words != "", words).otherwise(head)), F.lit("…")))


def human_bytes(c: ColumnOrName) -> Column:
    n = col(c).cast("double")
    step = lambda p, unit: F.when(n / 1024**p < 10, F.concat(F.format_string("%.1f", n / 1024**p), F.lit(unit))).otherwise(F.concat(F.round(n / 1024**p).cast("long").cast("string"), F.lit(unit)))
    out = F.when(n < 1024, F.concat(F.round(n).cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, " KB")).when(n < 1024**3, step(2, " MB")).otherwise(step(3, " GB"))
    return F.when(n.isNull(), F.lit("unknown")).otherwise(out)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)
