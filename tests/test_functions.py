"""Text, language, answer and page functions on literals."""

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import answers, html, language, models, text
from tessera.operators import pages


@pytest.fixture(scope="module")
def ev(spark):
    def run(f, *rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
        return [r[0] for r in df.orderBy("i").select(f(*[F.col(c) for c in df.columns[1:]])).collect()]

    return run


def test_page_text(ev):
    assert ev(text.normalise_whitespace, "a\r\n  b­c ﬁx  y \n\n z ", "") == ["a\nbc fix y\nz", ""]


def test_headings(ev):
    got = ev(text.classify_heading, "Annex B. Sampling", "Table 4A Limits", "5.1 Moisture shall", "nothing", "3) Marking", "2018")
    assert [g and tuple(g) for g in got] == [("annex", "Annex B", "Sampling"), ("table", "Table 4A", "Limits"), ("clause", "5.1", "Moisture shall"), None, ("clause", "3", "Marking"), None]
    assert ev(text.is_bare_heading, "5.1 Ash", "5.1 " + "x" * 50, "no") == [True, False, False]


def test_table_rows(ev):
    assert ev(text.looks_like_table_row, "₹ 500", "1 2 3 4", "hello world", "Rs. 500 only", "", "one 1 two 2") == [True, True, False, True, True, False]


def test_identifiers(ev):
    assert [g and tuple(g) for g in ev(text.parse_identifier, "what is IS 456:2000", "IS: 10262", "this 456", "is456", None)] == [("456", "2000"), ("10262", None), None, ("456", None), None]
    has = lambda c, y: text.passage_has_identifier(c, F.lit("456"), y)
    assert ev(has, ("IS 456 : 2000", "2000"), ("IS 456", "2000"), ("4567", None), ("see 456", None), (None, None)) == [True, False, False, True, False]


def test_titles(ev):
    cut = lambda c: text.tidy_title(c, F.lit(True))
    whole = lambda c: text.tidy_title(c, F.lit(False))
    assert ev(cut, "Specification for drinking water and packaged (natural mineral wat", "IS 456 : 2000 Plain concrete for the (second revision)") == ["Specification for drinking water and packaged", "Plain concrete"]
    assert ev(whole, "IS 1 : 2000 short", "IS 10 : 2000 Long enough title -", None) == ["IS 1 : 2000 short", "Long enough title", ""]


def test_rotation(ev):
    assert ev(text.fnv1a, "", "a", "hello") == [2166136261, -468965076, 1335831723]
    assert ev(lambda c: text.rotate(F.array(F.lit(1), F.lit(2), F.lit(3)), c), "", "a") == [[2, 3, 1], [1, 2, 3]]
    assert ev(lambda c: text.rotate(F.array(F.lit(1)), c), "x") == [[1]]


def test_topic_labels(ev):
    assert ev(text.tidy_clause, "2018", "1008", "0.15", "5.1", "Annex A", " ", None, "x" * 25) == [None, None, None, "5.1", "Annex A", None, None, None]
    assert ev(text.short_label, "SP 21 — Summaries", "the Bureau of Some Kind of Standards ACT, 2016 NO. 11", "short") == ["SP 21", "Bureau of Some Kind of Standards…", "short"]
    assert ev(text.passage_excerpt, "word " * 60, "ab")[1] == "ab"
    assert ev(text.human_bytes, "512", "2048", "19895756", None) == ["512 B", "2.0 KB", "19 MB", "unknown"]


def test_clause_order(ev, spark):
    df = spark.createDataFrame([(c,) for c in ("10", "2", "2.1", "Annex B", "2.0", "Annex A", "1")], "c string")
    assert [r[0] for r in df.orderBy(text.clause_order("c")).collect()] == ["1", "2", "2.0", "2.1", "10", "Annex A", "Annex B"]


def test_scripts(ev):
    native = ["सीमेंट", "ਪੰਜਾਬੀ", "తెలుగు"]
    assert ev(language.detect_script, "hello", *native, "漢字", None, "mostly english text " + native[0][:2]) == ["latin", "hi", "pa", "te", "latin", "latin", "latin"]
    assert ev(language.is_translatable, "hi", "pa", None) == [True, False, False]
    assert [tuple(r) for r in ev(language.resolve_lang, (None, native[0]), ("te", "x"), ("zz", "x"))] == [("auto", "hi"), ("te", "te"), ("auto", "en")]


def test_translations(ev):
    assert ev(language.clean_translation, ("Translation: What is cement?", "x"), ("\n..\nThe answer\n", "y"), ('"quoted"', "z"), ("same\nother", "same")) == ["What is cement?", "The answer", "quoted", "other"]
    got = ev(language.validate_english, ("What is fly ash", "x IS 456"), ("kya hai", "q"), ("", "a"), ("same", "same"), ("12", "b"), ("fine", None))
    assert [(g["status"], g["reason"]) for g in got] == [("suspect", "lost:is 456"), ("suspect", "romanised_hindi:kya,hai"), ("fail", "empty"), ("fail", "unchanged"), ("fail", "no_ascii_letters"), ("ok", None)]
    assert ev(language.extract_anchors, "IS 456 and is  456, 20 MPa and 30mm") == [["is 456", "20 mpa", "30mm"]]


def test_intent(ev):
    assert ev(language.is_chitchat, "Hi!!", "hellooooo", "what is cement", "\U0001f44b hey", "Thank you", "", None) == [True, True, False, True, True, False, False]
    assert ev(language.is_lookup_fragment, "IS 456", "fly ash", "what is x", "a b c d e", "is cement", "ash?", "fly ash?", "") == [True, True, False, False, False, True, False, False]


def test_answers(ev):
    looped = "This sentence is quite long really. " * 5
    assert ev(answers.is_degenerate, looped, looped[:110], "A first long sentence here. " * 3 + "x" * 60, None) == [True, False, False, False]
    assert ev(answers.is_substantive, ("456", "see 456"), ("yes", "cement"), ("cement", "Portland Cement"), ("x" * 40, None), ("", "a"), ("that", "that")) == [True, False, True, True, False, False]
    assert ev(answers.says_not_found, "NOT_FOUND", "not_found here", "x NOT_FOUND", "y" * 90 + " NOT_FOUND", None) == [True, True, True, False, False]


def test_html(ev):
    assert ev(html.escape_html, "<a href='x'>&\"") == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;"]
    assert ev(html.render_body, "one\ntwo\n\n- a\n- b", "see [[1]] [[0]]") == ["<p>one<br>two</p><ul><li>a</li><li>b</li></ul>", '<p>see <sup class="cite">[1]</sup></p>']
    assert ev(html.mark_first, ("clause 2.8 and 2.8", "2.8"), ("x", "y"), ("x", None)) == ["clause <mark>2.8</mark> and 2.8", "x", "x"]
    assert ev(html.model_text, "```text\nhi\n```") == ["hi"]


def test_settings():
    assert Settings().context_token_budget == 6980
    assert Settings.from_env({"TOP_K": "7", "HYBRID_SEARCH": "off", "RRF_K": ""}).top_k == 7
    assert not Settings.from_env({"HYBRID_SEARCH": "0"}).hybrid_search
    with pytest.raises(ValueError, match="TOP_K"):
        Settings.from_env({"TOP_K": "many"})
    with pytest.raises(ValueError, match="chunk_overlap.*bridge_floor"):
        Settings(chunk_overlap=2000, bridge_floor=0.9).validate()


def test_models():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise models.ModelError("down", 503)
        return "ok"

    assert models.with_retry(flaky, "local", sleep=lambda s: None) == "ok"
    with pytest.raises(models.ModelError):
        models.with_retry(lambda: (_ for _ in ()).throw(models.ModelError("bad", 400)), "cloud", sleep=lambda s: None)
    assert models.with_fallback(lambda: (_ for _ in ()).throw(models.ModelError("quota", 429)), lambda: "second") == "second"
    assert models.input_limit(400, "The input is too long: 2500 tokens, maximum is 2048") == {"tokens": 2500, "max": 2048}
    assert models.input_limit(400, "API key not valid") is None and models.input_limit(500, "500 tokens") is None
    assert models.input_limit(400, "input exceeds the token limit") == {"tokens": None, "max": 2048}
    assert [models.daily_cap(*x) for x in (("openrouter", "m"), ("openrouter", "m:free"), ("gemini", "m"), ("openrouter", "free-style"))] == [None, 50, 1000, None]
    big, small = models.ingest_feasibility(3445, 1000), models.ingest_feasibility(800, 1000)
    assert not big["ok"] and f"{big['days']:.1f}" == "3.4" and "resumable" in big["blocking"][0] and small["ok"]
    assert models.ingest_feasibility(100_000, None) == {"ok": True, "days": None, "blocking": [], "warnings": []}


def test_file_titles(spark):
    names = ["is-14543-2016.pdf", "d/IS_456.2000.pdf", "is14543 part 2 1998.pdf", "bis act-2016.PDF", "is-14543-part-1-2016.pdf"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    assert [r[0] for r in df.orderBy("i").select(pages.filename_title(F.col("n"))).collect()] == ["IS 14543:2016", "IS 456:2000", "IS 14543 (Part 2):1998", "Bis Act 2016", "IS 14543 (Part 1):2016"]
    assert spark.range(1).select(pages.title_case(F.lit("PLAIN AND REINFORCED CONCRETE IS 456 NO"))).first()[0] == "Plain and Reinforced Concrete IS 456 NO"
    texts = [("f.pdf", ["a\nSUMMARIES OF\nINDIAN RULES FOR\nBUILDING\nprose", "SP 21"]), ("f.pdf", ["Code IS 456 : 2000 text"]), ("f.pdf", ["prose", None]), (None, ["ONE LINE\nprose\nPRICE OF\nTWO"]), ("g.pdf", ["x"] * 12 + ["METHODS OF\nTEST"])]
    rows = [(i, name, k, t) for i, (name, ts) in enumerate(texts) for k, t in enumerate(ts)]
    got = pages.document_titles(spark.createDataFrame(rows, "doc_id int, source_file string, page_number int, text string")).orderBy("doc_id").collect()
    assert [r["doc_title"] for r in got] == ["SP 21 — Summaries of Indian Rules for Building", "IS 456 : 2000", "F", "", "G"]


def test_reply_blocks(spark):
    df = spark.createDataFrame([("en", "a <b>", ["x & y"], ["T1"], "<li>i</li>"), ("hi", None, [], None, None), ("xx", "q", None, [], "")], "lang string, q string, topics array<string>, titles array<string>, item string")
    rows = df.select(html.not_found_block("q", "topics", "titles", "lang").alias("n"), html.near_miss_block("q", "item", "lang").alias("m"), html.greeting_block("topics", "titles", "lang").alias("g"), html.suggestions_block("topics", "lang").alias("s")).collect()
    assert "a &lt;b&gt;" in rows[0]["n"] and "<li>x &amp; y</li>" in rows[0]["n"] and "<li>T1</li>" in rows[0]["g"] and rows[0]["m"].endswith("<ul><li>i</li></ul></section>")
    assert rows[1]["m"] == rows[1]["s"] == rows[2]["s"] == "" and html.MESSAGES["greeting"]["hi"] in rows[1]["g"] and html.MESSAGES["greeting"]["en"] in rows[2]["g"]
    assert all(set(t) == {"en", "hi", "pa", "te"} for t in html.MESSAGES.values())
    assert html.message_table(spark, {"en": {"greeting": "Hi"}, "fr": {"greeting": "Salut"}}).where("key = 'greeting'").count() == 5


def test_table_rows_use_every_listed_character():
    import re

    from tessera.functions import patterns, text

    assert len(text.NON_LETTERS) > 60 and not set(text.NON_LETTERS) & set("aZé漢") and all(re.match(patterns.NON_LETTER, c, re.A) for c in text.NON_LETTERS)


def test_degenerate_answers_sort_their_sentences_once(spark):
    """In time that grows with the sentences, not with their square."""
    import time

    from tessera.functions import answers

    many = [" ".join(f"Sentence number {i} of this long answer is like no other one." for i in range(n)) for n in (3000,)]
    texts = [*many, many[0] + " And this very one comes again here." * 4, many[0] + " And this very one comes again here." * 3, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    began = time.time()
    got = {r[0]: r[1] for r in df.select("i", answers.is_degenerate("t")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False}
    plan = df.select(answers.is_degenerate("t"))._jdf.queryExecution().optimizedPlan().toString()
    lambdas = plan[plan.index("zip_with") :] if "zip_with" in plan else ""
    assert lambdas and "get(array_sort" not in plan and time.time() - began < 60
