"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by patterns and validated (Luhn digit, octet range, calendar, number
plan). A validated value is read as a pair of numbers (x, y) below (A, B) that counts the
values of its format, permuted by a keyed alternating Feistel network on that very domain, and
written back in its own format: separators, length, validity and, where there is one, the
check digit are kept. The network is a bijection and each set of values is permuted within
itself, so equal values stay linked across documents and different ones stay apart. E-mail
addresses and quoted secrets have no number format; they become keyed digests.

One regular expression reads a text once: it marks each match with noncharacters (those of the
text itself are escaped before), and a split at the marks gives gaps and matches in turn.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10

LOCAL = r"A-Za-z0-9._%+\-"
OCTET = r"(?:0|[1-9]\d{0,2})"
#: Kind -> Java pattern, in order of precedence at one position. No length is bounded, and what
#: repeats is a class of characters, so that a long run is read once and without recursion.
PATTERNS = {
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++@[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{{2,}}",
    "secret": r"(?<=[\"'])(?<=[=:][ ]{0,3}[\"'])[0-9A-Za-z_\-]{20,}+(?=[\"'])",
    "iso_date": r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])",
    "slash_date": r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ip": rf"(?<![\d.]){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+1[ .\-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
}
#: Numbers begin with a digit, a plus or a bracket; only there their patterns are tried.
ANY = "({email})|({secret})|(?=[0-9+(])(?:({iso_date})|({slash_date})|({ip})|({ssn})|({phone})|({card}))".format(**PATTERNS)
KINDS = ("email", "secret", "date", "ip", "ssn", "phone", "card")

#: Noncharacters: the escape, what follows it for itself, at a match's ends, between its slots.
MARK, SELF, OPEN, CLOSE, SLOT = "﷐", "﷑", "﷒", "﷓", "﷔"


#: For the registered query and tests alone, where no key is set.
TEST_KEY = "not a secret"
KEY_SETTING = "spark.tessera.pii.key"


def session_key(spark: SparkSession, test_key: str | None = None) -> str:
    """The key set as ``spark.tessera.pii.key``. Unset, and without a test key, the session gets a
    secret one at random: nobody can invert its pseudonyms, which no other session repeats."""
    key = spark.conf.get(KEY_SETTING, test_key)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def number(text: Column) -> Column:
    return text.try_cast("bigint")


def padded(value: Column, width: Column | int) -> Column:
    w = F.lit(width) if isinstance(width, int) else width
    return F.lpad(value.cast("string"), w, F.lit("0"))


def keyed(key: str, *parts: Column) -> Column:
    """Hex digest under the key."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256)


def feistel(key: str, kind: str, x: Column, y: Column, a: Column, b: Column) -> Column:
    """Struct (x, y): the permuted pair of the domain a * b."""

    def step(s: Column, r: Column) -> Column:
        f = F.conv(F.substring(keyed(key, F.lit(kind), s["mx"], s["my"], r, s["y"]), 1, 15), 16, 10).try_cast("bigint")
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + f, s["mx"]).alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    start = F.struct(x.alias("x"), y.alias("y"), a.cast("bigint").alias("mx"), b.cast("bigint").alias("my"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def refill(template: Column, digits: Column) -> Column:
    """Put new digits where the template has digits."""
    step = lambda s, c: F.when(
        c.between("0", "9"), F.struct(F.concat(s["out"], F.substr(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda s: s["out"])


def luhn_sum(payload: Column, doubled: int) -> Column:
    """Luhn sum of a digit string; the last digit is doubled if ``doubled`` is 1."""
    chars = F.reverse(F.split(payload, ""))
    values = F.transform(chars, lambda c, i: let(F.coalesce(c.try_cast("int"), F.lit(0)) * F.when((i + doubled) % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, F.lit("0")).cast("bigint")


def card(key: str, m: Column) -> Column:
    """13 to 19 digits with a valid Luhn digit: all but that are permuted, it is recomputed."""

    def change(d: Column) -> Column:
        n = F.length(d) - 1
        left = F.floor(n / 2).cast("int")
        a, b = pow10(left), pow10(n - left)
        s = feistel(key, "card", number(F.substr(d, F.lit(1), left)), number(F.substr(d, left + 1, n - left)), a, b)
        payload = let(s, lambda p: F.concat(padded(p["x"], left), padded(p["y"], n - left)))
        return let(payload, lambda p: refill(m, F.concat(p, F.pmod(-luhn_sum(p, 1), F.lit(10)).cast("string"))))

    return let(digits_of(m), lambda d: F.when(luhn_sum(d, 0) % 10 == 0, change(d)).otherwise(m))


def phone(key: str, m: Column) -> Column:
    """Ten digits. Numbers of the plan (area and exchange begin with 2-9) are permuted among
    themselves, and so are the others; a country code stays."""
    split = 60_000  # 200 areas of 10**7 numbers and 800 of 2 * 10**6 make 60,000 ** 2 others

    def planned(d: Column) -> Column:
        s = feistel(key, "phone", number(F.substring(d, 1, 3)) - 200, number(F.substring(d, 4, 7)) - 2_000_000, F.lit(800), F.lit(8_000_000))
        return let(s, lambda p: F.concat(padded(p["x"] + 200, 3), padded(p["y"] + 2_000_000, 7)))

    def other(d: Column) -> Column:
        area, rest = number(F.substring(d, 1, 3)), number(F.substring(d, 4, 7))
        place = F.when(area < 200, area * 10_000_000 + rest).otherwise(2_000_000_000 + (area - 200) * 2_000_000 + rest)
        s = feistel(key, "other phone", F.floor(place / split), F.pmod(place, F.lit(split)), F.lit(split), F.lit(split))
        new = let(s, lambda p: p["x"] * split + p["y"])
        return let(new, lambda v: padded(F.when(v < 2_000_000_000, v).otherwise(2_000_000_000 + F.floor((v - 2_000_000_000) / 2_000_000) * 10_000_000 + (v - 2_000_000_000) % 2_000_000), 10))

    ten = lambda d: F.substring(d, -10, 10)
    return let(
        digits_of(m),
        lambda d: refill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), F.when(ten(d).rlike("^[2-9][0-9]{2}[2-9]"), planned(ten(d))).otherwise(other(ten(d))))),
    )


def ip(key: str, m: Column) -> Column:
    """Four octets up to 255."""

    def change(o: Column) -> Column:
        s = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536))
        return let(s, lambda p: F.concat_ws(".", F.floor(p["x"] / 256).cast("string"), (p["x"] % 256).cast("string"), F.floor(p["y"] / 256).cast("string"), (p["y"] % 256).cast("string")))

    return let(F.transform(F.split(m, r"\."), number), lambda o: F.when(F.forall(o, lambda v: v <= 255), change(o)).otherwise(m))


def ssn(key: str, m: Column) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""

    def change(d: Column) -> Column:
        area = number(F.substring(d, 1, 3))
        rest = (number(F.substring(d, 4, 2)) - 1) * 9999 + number(F.substring(d, 6, 4)) - 1
        s = feistel(key, "ssn", area - F.when(area > 666, 2).otherwise(1), rest, F.lit(898), F.lit(99 * 9999))
        area_of = lambda v: v + F.when(v >= 665, 2).otherwise(1)
        return let(s, lambda p: F.concat(padded(area_of(p["x"]), 3), padded(F.floor(p["y"] / 9999) + 1, 2), padded(p["y"] % 9999 + 1, 4)))

    valid = lambda d: ~d.rlike("^(000|666|9)|^...00|0000$")
    return let(digits_of(m), lambda d: F.when(valid(d), refill(m, change(d))).otherwise(m))


#: A Gregorian cycle of 400 years has 146,097 = 27 * 5,411 days.
CYCLE_START, CYCLE_A, CYCLE_B = "1800-01-01", 27, 5_411


def date(key: str, m: Column, java_format: str, late_days: bool = False) -> Column:
    """A date of the years 1800-2199 becomes another; impossible or other dates stay.

    ``late_days``: only days after the 12th, permuted among themselves, by walking along the
    cycle of the permutation to the next of them (it is met after two steps in the mean)."""
    start = F.lit(CYCLE_START).cast("date")
    on = lambda n: F.date_add(start, n.cast("int"))

    def permuted(n: Column) -> Column:
        s = feistel(key, "late date" if late_days else "date", F.floor(n / CYCLE_B).cast("bigint"), (n % CYCLE_B).cast("bigint"), F.lit(CYCLE_A), F.lit(CYCLE_B))
        return let(s, lambda p: p["x"] * CYCLE_B + p["y"])

    def change(n: Column) -> Column:
        if not late_days:
            return permuted(n)
        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), permuted(n), lambda v, _: F.when(F.dayofmonth(on(v)) > 12, v).otherwise(permuted(v)))

    day = F.datediff(F.try_to_timestamp(m, F.lit(java_format)).cast("date"), start).cast("bigint")
    return let(day, lambda n: F.when(n.between(0, CYCLE_A * CYCLE_B - 1), F.date_format(on(change(n)), java_format)).otherwise(m))


def slash_date(key: str, m: Column) -> Column:
    """Day before month where that is a date, else month before day. The second are the dates
    whose day is after the 12th: a set of strings of their own, permuted within itself."""
    first = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNotNull()
    return F.when(first, date(key, m, "dd/MM/yyyy")).otherwise(date(key, m, "MM/dd/yyyy", late_days=True))


def email(key: str, m: Column) -> Column:
    """The address becomes a keyed digest at a reserved domain; case does not matter."""
    return F.concat(F.lit("user-"), F.substring(keyed(key, F.lit("email"), F.lower(m)), 1, 24), F.lit("@example.invalid"))


def secret(key: str, m: Column) -> Column:
    """A keyed digest of the same length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64).cast("int")), lambda i: keyed(key, F.lit("secret"), m, i))
    return F.substr(F.array_join(blocks, ""), F.lit(1), F.length(m))


def classified(slots: Column, key: str) -> Column:
    """Struct (kind, value) of a match, given by the slots of its alternatives: one is filled.
    ``kind`` is null where the match is not valid and stays as it is."""
    makers = [email, secret, lambda k, m: date(k, m, "yyyy-MM-dd"), slash_date, ip, ssn, phone, card]
    kinds = ["email", "secret", "date", "date", "ip", "ssn", "phone", "card"]
    chosen = None
    for i, (kind, make) in enumerate(zip(kinds, makers, strict=True)):
        result = F.struct(F.lit(kind).alias("kind"), make(key, slots[i]).alias("value"), slots[i].alias("old"))
        chosen = F.when(slots[i] != "", result) if chosen is None else chosen.when(slots[i] != "", result)
    return let(chosen, lambda x: F.struct(F.when(x["value"] != x["old"], x["kind"]).alias("kind"), F.coalesce(x["value"], x["old"]).alias("value")))


def pseudonymised(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``df`` (as the struct ``own``) with ``_text`` and ``_found`` (kinds replaced)."""
    if not key:
        raise ValueError("a key is needed: whoever knows it can undo the pseudonyms")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    slots = SLOT.join(f"${i}" for i in range(1, 9))
    safe = F.replace(raw, F.lit(MARK), F.lit(MARK + SELF))
    marked = F.regexp_replace(safe, F.lit(ANY), F.lit(f"{MARK}{OPEN}{slots}{MARK}{CLOSE}"))
    # every kind holds a digit but for some addresses and secrets
    parts = F.when(raw.rlike("[0-9@=:]"), F.split(marked, f"{MARK}[{OPEN}{CLOSE}]", -1))
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("own"), raw.alias("_raw"), parts.alias("_cut"))
    gap = lambda p: F.struct(F.lit(None).cast("string").alias("kind"), F.replace(p, F.lit(MARK + SELF), F.lit(MARK)).alias("value"))
    pieces = F.when(F.size("_cut") > 1, F.transform("_cut", lambda p, i: F.when(i % 2 == 0, gap(p)).otherwise(let(F.split(p, SLOT, -1), lambda s: classified(s, key)))))
    src = src.select("own", "_raw", pieces.alias("_new"))
    joined = F.array_join(F.transform("_new", lambda r: r["value"]), "")
    found = F.filter(F.transform("_new", lambda r: r["kind"]), lambda k: k.isNotNull())
    return src.select("own", F.when(F.col("_new").isNull(), F.col("_raw")).otherwise(joined).alias("_text"), F.coalesce(found, F.array().cast("array<string>")).alias("_found"))


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (with pseudonyms), n_replaced, one count per kind.

    A null text becomes the empty text; invalid candidates (a wrong check digit, octet or
    calendar day) stay as they are; rows that repeat an id, or have none, keep their own row;
    an empty table gives no rows; other columns are ignored. Whole texts are read, and no row
    is shuffled. Whoever has ``key`` can link and undo, so there is no default.
    """
    rows = pseudonymised(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key, "text")
    count = lambda kind: F.size(F.filter("_found", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("own.doc_id", F.col("_text").alias("text"), F.size("_found").cast("long").alias("n_replaced"), *map(count, KINDS))


def pseudonymise_column(df: DataFrame, key: str, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with pseudonyms in ``text_col``; other columns, and null texts, as they were.

    Empty texts stay empty, rows that repeat an id or have none keep their own row, an empty
    table gives no rows. ``length_col``, if ``df`` has it, is set to the new length of a text
    that changed.
    """
    rows = pseudonymised(df, key, text_col)

    def column(c: str) -> Column:
        own = F.col(f"own.`{c}`")
        if c == text_col:
            return F.when(own.isNotNull(), F.col("_text")).alias(c)
        if c == length_col:
            return F.when(F.size("_found") > 0, F.char_length("_text").cast(df.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return rows.select(*map(column, df.columns))
