"""Classifier, chats, quality rules, pseudonyms and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter
from datetime import date, timedelta

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import chat, pii, quality_model, quality_rules
from tessera.llm.common import materialise

from .messy import documents, seen

# classifier


def labelled(spark, n=240):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(rnd.choice(words) + ("" if good else "***") for _ in range(rnd.randint(20, 80)))
        docs.append((i, text, "en", "a"))
        labels.append((i, int(good), 0))
    docs += [(n, None, None, None), (n + 1, "", "en", "a"), (None, "text", "en", "a"), (0, "again", "en", "a")]
    return documents(spark, docs), spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def test_classifier_holds_out_and_learns(spark):
    docs, labels = labelled(spark)
    got = quality_model.quality_scores(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    held = [r for r in got if r["held_out"]]
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    right = [truth[r["doc_id"]] == r["predicted"] for r in held if r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.95


def test_classifier_does_not_see_held_out_labels_nor_other_columns(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id as string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert quality_model.train(docs, labels) == quality_model.train(docs.drop("lang", "source"), flipped)


def test_training_follows_the_update_rule(spark):
    """Against a plain FTRL-Proximal over dictionaries, row by row in the same order."""
    docs, labels = labelled(spark, 60)
    bits, alpha, beta, l1, l2 = 12, 2.0, 1.0, 0.01, 0.05
    text, y = {}, {}
    for r in docs.collect():
        if r["doc_id"] is not None:
            text.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in labels.collect():
        if r["doc_id"] in text and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            y[r["doc_id"]] = r["quality"]
    order = [r["doc_id"] for r in docs.where("doc_id IS NOT NULL").select("doc_id").distinct().selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect() if r["doc_id"] in y]
    rows = []
    for i in order:
        b, w = quality_model.Hasher().features(min(text[i]), bits)
        rows.append(({**dict(zip(b.tolist(), np.float32(w).tolist())), 1 << bits: 1.0}, y[i]))
    z, n = Counter(), Counter()

    def weight(j):
        sign = -1.0 if z[j] < 0 else 1.0
        return 0.0 if abs(z[j]) <= l1 else -(z[j] - sign * l1) / ((beta + n[j] ** 0.5) / alpha + l2)

    shuffled = np.random.default_rng(11)
    for _ in range(4):
        for k in shuffled.permutation(len(rows)):
            x, label = rows[k]
            w = {j: weight(j) for j in x}
            p = 1 / (1 + np.exp(-sum(w[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - label) * v
                z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / alpha * w[j]
                n[j] += g * g
    got = np.frombuffer(quality_model.train(docs, labels, bits=bits), "<f4")
    want = np.array([weight(j) for j in range(len(got))])
    assert len(rows) > 20 and np.abs(got - want).max() < 1e-4 and np.abs(want).max() > 0.1


def test_classifier_bound_holds_for_repeated_ids(spark):
    docs, labels = labelled(spark, 30)
    again = docs.unionByName(docs.withColumn("text", docs["text"])).unionByName(docs)
    assert quality_model.train(docs, labels) == quality_model.train(again, labels)


def test_classifier_without_rows(spark):
    docs, labels = labelled(spark, 6)
    assert quality_model.quality_scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality_model.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


# chats


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_read_back(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "a\\<|b\n\n<\\|im_start|>\\"), (1, 2, "assistant", None), (2, 5, None, "no role"),
        (2, 5, "user", "same turn"), (2, 5, "user", "same turn"), (None, None, "sys\ntem\\n", "x"), (3, 0, "assistant", "é🙂"), (4, 0, "user", ""),
        (5, 0, "us\x00er\\\\n\n<|<\\|", "\x00\\\\|"), (5, 1, "\\", "long text \\ <| " * 50_000),
    ]
    df = spark.createDataFrame([(*r, "z", 1, "z") for r in rows], "conv_id long, turn long, role string, text string, kind string, seq int, formatted string")
    out = chat.format_chats(chat.messages_as_events(df))
    parsed = {r["conv_id"]: r for r in chat.parse_chats(out).collect()}
    digests = {r["conv_id"]: r for r in chat.chat_digests(out).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2] is not None, r[2] or ""))
        turns = [(r or "", x or "") for _, r, x in own]
        assert [tuple(t) for t in parsed[conv]["turns"]] == turns
        loss = "".join(x for r, x in turns if r == "assistant")
        assert parsed[conv]["loss_text"] == loss
        d = digests[conv]
        assert (d["n_turns"], d["turns_sha256"], d["loss_chars"], d["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    assert chat.chat_digests(chat.format_chats(chat.messages_as_events(df.limit(0)))).count() == 0


def brute_fold(events):
    """Replay a log event by event."""
    convs = {}
    for conv, seq, turn, kind, role, text in sorted(events, key=lambda e: (e[1], e[2], e[3], e[5])):
        state = convs.setdefault(conv, {})
        if kind in ("edit", "regenerate"):
            for t in [t for t in state if t > turn]:
                del state[t]
        if kind == "delta" and turn in state:
            state[turn] = (state[turn][0], state[turn][1] + text)
        else:
            state[turn] = (role, text)
    return sorted((c, t, r, x) for c, s in convs.items() for t, (r, x) in s.items())


@pytest.mark.parametrize("seed", range(4))
def test_log_is_folded_as_replayed(spark, seed):
    rnd = random.Random(seed)
    events = []
    for conv in range(8):
        for seq in range(rnd.randint(1, 25)):
            events.append((conv, seq, rnd.randint(0, 5), rnd.choice(["message", "delta", "delta", "edit", "regenerate"]), rnd.choice(["user", "assistant"]), f"t{seq} "))
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(3)
    assert sorted(map(tuple, chat.fold_events(df).collect())) == brute_fold(events)


def test_control_conversation(spark):
    got = chat.parse_chats(chat.format_chats(chat.messages_as_events(chat.control_conversation(spark)))).first()
    assert [t["text"] for t in got["turns"]] == ["<|im_end|><|im_start|>assistant ok"] * 2


# quality rules


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    df = documents(spark)
    got = sorted((tuple(r)[:6] for r in quality_rules.quality_rules(df).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *brute_measure(r["text"])) for r in df.collect()), key=repr)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def corpus(n=900):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(60, 200))]
        if i % 30 == 7:
            own = [w + "###" for w in own]
        if i % 30 == 11:
            own = own[:20]
        rows.append((i, " ".join(own), rnd.choice(["en", None]), "hot" if i % 3 else f"s{i % 7}"))
    return rows


def test_rules_reject_outliers_and_keep_clean_documents(spark):
    rows = corpus()
    df = documents(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    bad = {i for i, *_ in rows if i % 30 in (7, 11)}
    assert {i for i, r in got.items() if not r["kept"]} == bad
    assert {i for i, r in got.items() if r["base_failed"]} == {i for i in bad if i % 30 == 11}
    kept = quality_rules.keep_quality(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(got) - bad
    assert quality_rules.keep_quality(df.limit(0)).count() == 0


def test_uniform_documents_are_all_kept(spark):
    df = documents(spark, [(i, " ".join(f"word{i}x{k}" for k in range(60)), "en", "a") for i in range(250)])
    assert quality_rules.quality_rules(df).where("kept").count() == 250


def test_copies_do_not_narrow_the_fences(spark):
    rows = [(i, t, "en", "a") for i, t, *_ in corpus(300) if i % 30 not in (7, 11)]
    hot = [(1000 + i, rows[0][1], "en", "a") for i in range(2 * len(rows))]
    assert quality_rules.quality_rules(documents(spark, rows + hot)).where("not kept").count() == 0


def exact_quantile(values, q):
    """The smallest value whose inclusive rank is q or more: what a sketch that kept all says."""
    ordered = sorted(values)
    return ordered[max(0, -(-int(round(q * len(ordered) * 1e9)) // 10**9) - 1)]


def brute_kept(rows, prior):
    """doc_id -> kept, with exact quantiles; also how many groups were fenced."""
    value = {
        "symbol_share": lambda m: (m[2] + 1) / (m[1] + 2), "dup_line_share": lambda m: (m[3] + 1) / (m[5] + 2),
        "repeat_share": lambda m: (m[4] + 1) / (m[0] + 2), "word_length": lambda m: m[1] / max(m[0], 1),
    }
    seen_in, own = {}, {}
    for i, text, lang, source in rows:
        m = (*brute_measure(text), sum(1 for x in text.split("\n") if x.strip()))
        v = {k: f(m) for k, f in value.items()}
        own[i] = (v, m[0] < 50 or 100 * m[4] > 50 * m[0], lang, source)
        if not own[i][1]:
            seen_in.setdefault((lang, source), set()).add(tuple(v.values()))

    def q(groups, f, p):
        at = list(value).index(f.name)
        return exact_quantile([t[at] for g in groups for t in seen_in[g]], p), sum(len(seen_in[g]) for g in groups)

    def drawn(lang, source, f, p):
        every = q(list(seen_in), f, p)[0]
        a, n = q([g for g in seen_in if g[0] == lang], f, p)
        by_lang = (n * a + prior * every) / (n + prior)
        a, n = q([(lang, source)], f, p)
        return (n * a + prior * by_lang) / (n + prior), by_lang

    kept, limits = {}, {}
    for g in seen_in:
        for f in quality_rules.FENCES:
            (mid, lmid), (top, ltop), (low, llow) = (drawn(*g, f, p) for p in (0.5, f.tail, 1 - f.tail))
            high = top + f.spread * max(top - mid, ltop - lmid)
            limits[g, f.name] = (low - f.spread * max(mid - low, lmid - llow) if f.lower else 0, high)
    for i, (v, failed, *g) in own.items():
        kept[i] = not failed and all(limits[tuple(g), k][0] - 1e-9 <= x <= limits[tuple(g), k][1] + 1e-9 for k, x in v.items())
    return kept, limits


def test_verdicts_equal_brute_force_with_exact_quantiles(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(700):  # source "wide" has a longer tail of symbols and word lengths than "narrow"
        wide = i % 2
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6 + 5 * wide))) for _ in range(rnd.randint(55, 120))]
        for _ in range(rnd.choice([0, 1, 2, 3] if wide else [0, 0, 0, 1]) + 5 * (i % 20) * (i % 25 == 3)):
            words[rnd.randrange(len(words))] = "%%%"
        if i % 9 == 0:
            words += ["\nsame line here\n"] * rnd.randint(1, 5)
        rows.append((i, " ".join(words), "en" if i % 3 else "de", "wide" if wide else "narrow"))
    df = documents(spark, rows)
    for prior in (0.0, 100.0):  # fewer rows than the sketch's k: its quantiles are exact
        want, limits = brute_kept(rows, prior)
        got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, prior=prior).collect()}
        assert got == want
        assert 10 < sum(not k for k in want.values()) < 200
        for name in ("symbol_share", "word_length"):
            assert limits[("en", "wide"), name][1] > limits[("en", "narrow"), name][1]


def test_a_sketch_errs_within_its_rank_bound(spark):
    from pyspark.sql import functions as F

    n = 60_000
    got = spark.range(n).agg(F.kll_sketch_agg_double(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double"), F.lit(1024)).alias("s"))
    for q in (0.02, 0.25, 0.5, 0.75, 0.98):
        assert abs(got.select(F.kll_sketch_get_quantile_double("s", F.lit(q))).first()[0] / n - q) < 0.01


# pseudonyms


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_format_and_validity(spark):
    texts = {
        1: "card 4111 1111 1111 1111, 4111111111111111 and 4111111111111112.",
        2: "call +1 (743) 555-3824 or 743.555.3824 or 055-155-1234",
        3: "ips 70.23.22.57, 300.1.1.1 and 1.2.3.4.5",
        4: "on 2024-02-29, 2023-02-29, 31/12/1999, 12/31/1999 and 99/99/1999",
        5: "ssn 123-45-6789 and 666-12-1234",
        6: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907f1" to A.b@Mail5.example.com and a.b@mail5.example.com',
        7: "4765158382889437 4465758382889437 v1.2.3 CC BY-NC 4.0. 12,000 in 1999",
    }
    df = documents(spark, [(i, t, None, None) for i, t in texts.items()] + [(8, None, None, None), (9, "", "en", "a"), (1, texts[1], "en", "a")])
    rows = pii.pseudonymise(df, key="k").collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    a, b, c = re.findall(r"\d[\d ]{11,}\d", got[1])
    assert a.replace(" ", "") == b != "4111111111111111" and luhn(b) and c == "4111111111111112"
    phones = re.findall(r"\(?\d{3}\)?[ .\-]\d{3}[.\-]\d{4}", got[2])
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) != "7435553824" and got[2].startswith("call +1 (")
    assert re.match(r"\(?[2-9]..\)?.[2-9]", phones[0]) and phones[2] != "055-155-1234"
    first, rest = re.match(r"ips ([\d.]+), (.*)", got[3]).groups()
    assert first != "70.23.22.57" and all(0 <= int(o) <= 255 for o in first.split(".")) and rest == "300.1.1.1 and 1.2.3.4.5"
    iso, bad, day, month, odd = re.findall(r"\d+[-/]\d+[-/]\d+", got[4])
    assert iso != "2024-02-29" and (bad, odd) == ("2023-02-29", "99/99/1999")
    assert day != "31/12/1999" and month != "12/31/1999" and int(month.split("/")[1]) > 12
    assert re.fullmatch(r"ssn (?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} and 666-12-1234", got[5]) and "123-45-6789" not in got[5]
    mails = re.findall(r"\S+@\S+", got[6])
    assert len(set(mails)) == 1 and "24be64439e3e49" not in got[6] and re.search(r'token = "[0-9a-f]{40}"', got[6])
    assert got[7].endswith(" v1.2.3 CC BY-NC 4.0. 12,000 in 1999") and not got[7].startswith("4765158382889437 ")
    assert got[8] == got[9] == "" and len(rows) == 10
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, key="other").collect()}
    assert all(other[i] != got[i] for i in range(1, 8))
    assert pii.pseudonymise(df.limit(0), key="k").count() == 0
    assert pii.pseudonymise(df, key="other").select("text").collect() == pii.pseudonymise(df, key="other").select("text").collect()


def brute_feistel(key, kind, x, y, a, b):
    for r in range(1, pii.ROUNDS + 1):
        f = int(sha("|".join(map(str, (key, kind, a, b, r, y, key))))[:15], 16)
        x, y, a, b = y, (x + f) % a, b, a
    return x, y


def brute_day(key, kind, n):
    x, y = brute_feistel(key, kind, n // 5411, n % 5411, 27, 5411)
    return x * 5411 + y


def refilled(m, digits):
    own = iter(digits)
    return "".join(next(own) if c.isdigit() else c for c in m)


def brute_value(key, kind, m):
    """The pseudonym of one match, in plain Python."""
    d, start = re.sub(r"\D", "", m), date(1800, 1, 1)
    if kind == "email":
        return f"user-{sha('|'.join((key, 'email', m.lower(), key)))[:24]}@example.invalid"
    if kind == "secret":
        return "".join(sha("|".join((key, "secret", m, str(i), key))) for i in range(-(-len(m) // 64)))[: len(m)]
    if kind in ("iso_date", "slash_date"):
        for order in (("ymd",) if kind == "iso_date" else ("dmy", "mdy")):
            try:
                own = dict(zip(order, re.split(r"[-/]", m)))
                n = (date(int(own["y"]), int(own["m"]), int(own["d"])) - start).days
            except ValueError:
                continue
            if not 0 <= n < 146097:
                return m
            late = order == "mdy"
            n = brute_day(key, "late date" if late else "date", n)
            while late and (start + timedelta(n)).day <= 12:
                n = brute_day(key, "late date", n)
            new = start + timedelta(n)
            return new.strftime({"ymd": "%Y-%m-%d", "dmy": "%d/%m/%Y", "mdy": "%m/%d/%Y"}[order])
        return m
    if kind == "ip":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        x, y = brute_feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return m
        x, y = brute_feistel(key, "ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return refilled(m, f"{x + 1 + (x >= 665):03}{y // 9999 + 1:02}{y % 9999 + 1:04}")
    if kind == "phone":
        head, ten = d[:-10], d[-10:]
        if re.match("[2-9]..[2-9]", ten):
            x, y = brute_feistel(key, "phone", int(ten[:3]) - 200, int(ten[3:]) - 2_000_000, 800, 8_000_000)
            return refilled(m, f"{head}{x + 200:03}{y + 2_000_000:07}")
        others = int(ten) if int(ten[:3]) < 200 else 2 * 10**9 + (int(ten[:3]) - 200) * 2 * 10**6 + int(ten[3:])
        x, y = brute_feistel(key, "other phone", others // 60_000, others % 60_000, 60_000, 60_000)
        v = x * 60_000 + y
        v = v if v < 2 * 10**9 else 2 * 10**9 + (v - 2 * 10**9) // (2 * 10**6) * 10**7 + (v - 2 * 10**9) % (2 * 10**6)
        return refilled(m, f"{head}{v:010}")
    if not luhn(d):
        return m
    left = (len(d) - 1) // 2
    x, y = brute_feistel(key, "card", int(d[:left]), int(d[left:-1]), 10**left, 10 ** (len(d) - 1 - left))
    new = f"{x:0{left}}{y:0{len(d) - 1 - left}}"
    return refilled(m, new + next(c for c in "0123456789" if luhn(new + c)))


def brute_text(key, text):
    pattern = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), regex.ASCII)
    return pattern.sub(lambda m: brute_value(key, m.lastgroup, m.group()), text or "")


def test_pseudonyms_equal_brute_force(spark):
    rnd = random.Random(12)
    make = [
        lambda: "".join(rnd.choice("0123456789") for _ in range(rnd.randint(12, 20))), lambda: f"{rnd.randint(0, 999):03}-{rnd.randint(0, 999):03}-{rnd.randint(0, 9999):04}",
        lambda: f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(0, 9999):04}", lambda: f"+1 {rnd.randint(0, 999):03}.{rnd.randint(0, 999):03}.{rnd.randint(0, 9999):04}",
        lambda: ".".join(str(rnd.randint(0, 270)) for _ in range(4)), lambda: f"{rnd.randint(0, 999):03}-{rnd.randint(0, 99):02}-{rnd.randint(0, 9999):04}",
        lambda: f"{rnd.randint(1790, 2210)}-{rnd.randint(0, 13):02}-{rnd.randint(0, 32):02}", lambda: f"{rnd.randint(0, 32):02}/{rnd.randint(0, 32):02}/{rnd.randint(1990, 2030)}",
        lambda: f"{rnd.choice(['a.B', 'x' * 70, '%+', 'é'])}@{rnd.choice(['mail5.example.com', 'a.' * 20 + 'org', 'x', 'a..b.co'])}", lambda: f'key{rnd.choice(["=", ": ", " "])}"{"".join(rnd.choice("abcDEF0123_-") for _ in range(rnd.choice([19, 20, 240])))}"',
        lambda: "4111 1111 1111 1111", lambda: "word", lambda: "﷐﷒", lambda: "﷔é🙂", lambda: "01.2.3.4", lambda: "v1.2.3.4.5",
    ]
    rows = [(i, "".join(rnd.choice(make)() + rnd.choice([" ", " ", ", ", ".", "", "\n"]) for _ in range(rnd.randint(0, 12)))) for i in range(400)]
    rows += [(None, "no id 70.23.22.57"), (None, None), (7, ""), (7, rows[7][1]), (1000, "10.20.30.40 " + "long text " * 100_000 + "a" * 300_000 + "@" + "b." * 100_000 + "com")]
    got = seen(pii.pseudonymise(documents(spark, [(i, t, None, None) for i, t in rows]), key="k1").select("doc_id", "text"))
    assert got == sorted(((i, brute_text("k1", t)) for i, t in rows), key=repr)
    with pytest.raises(ValueError):
        pii.pseudonymise(documents(spark), key="")


def test_different_values_stay_apart(spark):
    """All slash and ISO dates of four decades; phone numbers in and out of the plan; SSNs."""
    days = [date(1990, 1, 1) + timedelta(n) for n in range(14_975)]
    values = {d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d")}
    rnd = random.Random(2)
    values |= {f"{rnd.randint(0, 999):03}-{rnd.randint(0, 999):03}-{rnd.randint(0, 9999):04}" for _ in range(20_000)} | {"055-155-1234", "507-910-9116"}
    values |= {f"{rnd.randint(0, 999):03}-{rnd.randint(0, 99):02}-{rnd.randint(0, 9999):04}" for _ in range(5_000)}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(values))], "doc_id long, text string").repartition(8)
    new = [r["text"] for r in pii.pseudonymise(df, key="k").collect()]
    assert len(set(new)) == len(values) and max(Counter(new).values()) == 1


def test_nothing_is_left_of_long_values(spark):
    local, token = "ab" * 35, "0123456789abcdef" * 15
    texts = [f"{local}@mail.example.com", f"x@{'sub.' * 12}example.com", f'secret = "{token}"']
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()
    for r, gone in zip(sorted(got, key=lambda r: r["doc_id"]), (local[:6], "sub.", token[:8])):
        assert gone not in r["text"] and r["n_replaced"] == 1


def test_feistel_is_a_bijection(spark):
    from pyspark.sql import functions as F

    df = spark.range(27 * 31).select((F.col("id") / 31).cast("long").alias("x"), (F.col("id") % 31).alias("y"))
    out = df.select(pii.feistel("k", "t", F.col("x"), F.col("y"), F.lit(27), F.lit(31)).alias("p")).select("p.x", "p.y").collect()
    assert len(set(map(tuple, out))) == 27 * 31
    assert all(0 <= r["x"] < 27 and 0 <= r["y"] < 31 for r in out)


def test_pseudonyms_keep_other_columns(spark):
    df = documents(spark, [(1, "ip 10.20.30.40", "en", "a"), (2, None, "en", "a")])
    out = pii.pseudonymise_column(df, key="k", length_col="n_chars")
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[2]["text"] is None and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[1]["row"] == "z"


# the pipeline


def test_stages_return_documents_and_survive_anything(spark):
    rows = corpus(200)
    rows += [(1000 + i, rows[i][1], "en", "x") for i in range(5)] + [(2000, None, None, None), (None, rows[9][1] + " more", "en", "a")]
    long = " ".join(f"w{i}" for i in range(3000))
    rows += [(3000, long + " one", "en", "a"), (3001, long + " two", "en", "a"), (3002, long + " ip 10.20.30.40", "en", "a")]
    docs = documents(spark, rows)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, ""), "t")
        empty = stage(spark, empty, "")
        assert docs.columns == empty.columns and empty.count() == 0, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert 2000 not in ids and 7 not in ids and 0 in ids
        if name == "exact_dedup":
            assert not ids & set(range(1000, 1005)) and {0, 1, 2} <= ids
        if name == "near_dedup":
            assert {3000, 3001, 3002} & ids == {3000}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(r["length"] for r in pieces) == sum(len(lib.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_run_equals_its_stages(spark, tmp_path):
    documents(spark, corpus(120), extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), "t")
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert seen(corpus_pipeline.run(spark, str(tmp_path)).select(*key)) == seen(docs.select(*key))


def test_registered_queries():
    from tessera.llm import queries

    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 11))
