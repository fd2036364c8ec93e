"""Compound terms, the stored keyword index, vector search without moving vectors, and graphs."""

import datetime as dt
import random
import unicodedata
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs, keywords, vectors
from tessera.sources import key_filter, keyword_index
from tessera.sources.keyword_index import KeywordIndex
from tessera.sources.store import CHUNKS, Store


def automaton(text):
    """Terms with their places, by a walk over the characters."""
    text, found, at, i = text.lower(), set(), 1, 0
    inside = lambda c: unicodedata.category(c)[0] in "LNM"
    while i < len(text):
        if not inside(text[i]):
            i += 1
            continue
        start, pieces = i, [[""]]  # pieces of units; a unit grows while numbers follow dots
        first, joint = at, None
        units = []
        word = ""
        while i < len(text):
            c = text[i]
            if inside(c):
                word += c
                i += 1
            elif c in "-./@_" and word and i + 1 < len(text) and inside(text[i + 1]):
                units.append((word, c))
                word = ""
                i += 1
            else:
                break
        units.append((word, ""))
        # join numbers over dots
        merged, joint = [], False
        for w, c in units:
            if joint and w.isdecimal() and merged[-1][2]:
                merged[-1][0] += "." + w
                merged[-1][1] = c
            else:
                merged.append([w, c, w.isdecimal()])
            joint = c == "." and w.isdecimal()
        piece_start, piece_text, piece_units = at, "", 0
        total_pieces = 1 + sum(c in "/@" for _, c, _ in merged)
        for w, c, _ in merged:
            found.add((w, at))
            at += 1
            piece_units += 1
            piece_text += w
            if c in ("/", "@", ""):
                if piece_units > 1 and total_pieces > 1:
                    found.add((piece_text, piece_start))
                piece_start, piece_text, piece_units = at, "", 0
            else:
                piece_text += c
        if len(merged) > 1:
            found.add((text[start:i], first))
    return found


def test_terms_equal_a_plain_automaton(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1 26.-/@_.é١ ,(") for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["See 6.1, 5.6.1; 6-1 (6. 1) cl.6.1 A-6.1 6.1a", "user@mail.example.org/a/b-c.txt v1.2.3 2024-01-02", "and/or fly-ash हिन्दी नमस्ते"]
    index = keywords.postings(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    got = defaultdict(set)
    for r in index.collect():
        assert r["tf"] == len(r["positions"]) and list(r["positions"]) == sorted(r["positions"])
        got[r["id"]] |= {(r["term"], p) for p in r["positions"]}
    for i, t in enumerate(texts):
        assert got[i] == automaton(t), t


def test_clause_numbers_match_literally(spark):
    docs = {1: "as 6.1 says", 2: "see 5.6.1", 3: "from 6-1", 4: "6. 1", 5: "(6.1)", 6: "6.1.", 7: "clause 6.1-6.3", 8: "cl.6.1", 9: "6.10 and 16.1", 10: "fly-ash 6.1/2", 11: "fly ash"}
    index = keywords.postings(spark.createDataFrame(list(docs.items()), "id long, text string"))
    asked = {"6.1": [1, 5, 6, 7, 8, 10], "5.6.1": [2], "fly-ash": [10], '"fly ash"': [10, 11], '"fly-ash 6.1"': [10], "6.1 -clause": [1, 5, 6, 8, 10], '6.1 -"see 5.6.1" -"fly-ash 6.1"': [1, 5, 6, 7, 8], "6-1": [3], "6.1/2": [10]}
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = defaultdict(list)
    for r in keywords.match_websearch(index, q).collect():
        got[r["query_id"]].append(r["id"])
    assert {t: sorted(got[i]) for i, t in enumerate(asked)} == asked
    terms = spark.createDataFrame([(0, ["6.1"])], "query_id long, terms array<string>")
    assert sorted(r["id"] for r in keywords.match_all(index, terms).collect()) == asked["6.1"]


def test_bare_exclusions_are_bounded(spark, monkeypatch):
    index = keywords.postings(spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"))
    q = spark.createDataFrame([(i, "-a") for i in range(3)], "query_id long, query string")
    found = keywords.match_websearch(index, q)
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(0, 2), (1, 2), (2, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    monkeypatch.setattr(keywords, "MOST_BARE", 2)
    with pytest.raises(ValueError, match="only exclude"):
        keywords.match_websearch(index, q)


def postings_of(df):
    return sorted((r["id"], r["term"], r["tf"], tuple(r["positions"])) for r in df.select("id", "term", "tf", "positions").collect())


def some_text(rng):
    return " ".join(rng.choice(["water", "sand", "6.1", "fly-ash", f"w{rng.randint(0, 30)}", "x/y"]) for _ in range(rng.randint(0, 25)))


def test_numbers_and_blocks(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 2**63, 200, dtype=np.uint64) >> np.uint64(s) for s in range(0, 64, 3)] + [np.array([0, 127, 128, 2**64 - 1], np.uint64)])
    raw, size = keyword_index.encode(v)
    assert (keyword_index.decode(raw) == v).all() and size.sum() == len(raw)
    assert len(keyword_index.decode(raw[:0])) == 0


def test_stored_index_equals_postings(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    ids = [-(2**63), 2**63 - 1, *range(-50, 300, 3), *(rng.randrange(-(2**62), 2**62) for _ in range(40))]
    docs = spark.createDataFrame([(i, some_text(rng)) for i in ids] + [(5, "water water"), (7, None), (None, "sand")] + [(i, "water sand") for i in range(1000, 1400)], "id long, text string").repartition(4)
    index = KeywordIndex(spark, str(tmp_path / "k"))
    index.change(docs)
    want = postings_of(keywords.postings(docs.where("id is not null")))
    assert postings_of(index.postings()) == want
    terms = spark.createDataFrame([("water",), ("fly-ash",), ("none",)], "term string")
    assert postings_of(index.postings_of(terms)) == [p for p in want if p[1] in ("water", "fly-ash")]
    monkeypatch.setattr(keyword_index, "MOST_FILTERED", 1)
    assert postings_of(index.postings_of(terms)) == [p for p in want if p[1] in ("water", "fly-ash")]
    assert sorted(r[0] for r in index.ids().collect()) == sorted({p[0] for p in want})
    empty = KeywordIndex(spark, str(tmp_path / "e"))
    empty.change(docs.limit(0))
    assert empty.postings().count() == 0 == empty.leading(terms, 3).count()


def test_index_after_changes_equals_a_fresh_one(spark, tmp_path, monkeypatch):
    """Random upserts and deletes: with tombstones, and after merges, it is the index of what is left."""
    monkeypatch.setattr(keyword_index, "SMALLEST", 60)
    rng = random.Random(3)
    index, held, most = KeywordIndex(spark, str(tmp_path / "k")), {}, 0
    for step in range(9):
        new = {rng.randint(0, 60): some_text(rng) for _ in range(rng.randint(1, 12))}
        gone = [*new, *(rng.randint(0, 60) for _ in range(rng.randint(0, 5)))]
        held = {i: t for i, t in held.items() if i not in gone} | new
        docs = spark.createDataFrame(list(new.items()), "id long, text string").coalesce(1)
        index.change(docs, spark.createDataFrame([(i,) for i in gone], "id long"))
        most = max(most, len(index.state["segments"]))
        assert len(index.state["gone"]) <= len(index.state["segments"]) or step == 0
    left = spark.createDataFrame(list(held.items()), "id long, text string")
    assert postings_of(index.postings()) == postings_of(keywords.postings(left))
    assert 2 <= most <= 8 and any(s["postings"] > 60 for s in index.state["segments"])
    q = spark.createDataFrame([(0, ["water"]), (1, ["water", "sand"]), (2, ["fly-ash", "6.1", "water"]), (3, ["none"]), (4, ["6.1"])], "query_id long, terms array<string>")
    rank = lambda i: sorted((r["query_id"], r["rank"], r["id"], round(r["text_rank"], 9)) for r in keywords.keyword_top_k(i, q, 4).collect())
    assert rank(index) == rank(keywords.postings(left))
    index.change(None, spark.createDataFrame([(i,) for i in held], "id long"))
    assert index.postings().count() == 0


def test_pruned_ranking_is_exact_and_skips_blocks(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, ["water"] * min(2000, int(rng.paretovariate(1))) + ["sand"] * rng.randint(0, 3) + ["rock"] * rng.randint(0, 2) + ["x"] * rng.randint(0, 9)) for i in range(8000)]
    rows = [(i, " ".join(rng.sample(t, len(t)))) for i, t in rows]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    index = KeywordIndex(spark, str(tmp_path / "k"))
    index.change(docs)
    q = spark.createDataFrame([(0, ["water"]), (1, ["water", "sand"]), (2, ["rock", "sand", "water"]), (3, ["sand"])], "query_id long, terms array<string>")
    rank = lambda i: sorted((r["query_id"], r["rank"], r["id"], round(r["text_rank"], 9)) for r in keywords.keyword_top_k(i, q, 10).collect())
    assert rank(index) == rank(keywords.postings(docs))
    blocks = index.leading_blocks(spark.createDataFrame([("water",)], "term string"), 10)
    total, needed = blocks.agg(F.count("*"), F.sum(F.col("needed").cast("int"))).first()
    print("blocks", total, "needed", needed)
    assert needed <= 0.3 * total
    # neither texts nor places are read for one term, and the scan filters on it
    plan = index.leading(spark.createDataFrame([("water",)], "term string"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "places" not in plan and "EqualTo(term,water)" in plan.replace("In(term, [water])", "EqualTo(term,water)")


def chunk(i, doc, n, text, day=1):
    return (i, doc, f"T {doc}", 1, 1, None, n, text, [0.6, 0.8], dt.datetime(2024, 1, day))


def test_store_keeps_its_index(spark, tmp_path, monkeypatch):
    """After random changes of documents the store's index is the one of its chunks."""
    monkeypatch.setattr(keyword_index, "SMALLEST", 40)
    rng = random.Random(4)
    kept = Store(spark, str(tmp_path / "s"), buckets=4, keywords=True)
    number = 0
    for step in range(6):
        docs = rng.sample("abcdefgh", 3)
        new = []
        for d in docs:
            for n in range(rng.randint(1, 3)):
                number += 1
                new.append(chunk(number, d, n, some_text(rng), 1 + step))
        rows = spark.createDataFrame(new, CHUNKS)
        if step % 2:
            kept.upsert_chunks(rows)
        else:
            kept.change(touched=rows, chunks=lambda old, rows=rows: old.join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows))
    fresh = keywords.postings(kept.read("chunks"), "id", F.concat_ws(" ", "doc_title", "content"))
    assert postings_of(Store(spark, str(tmp_path / "s")).keyword_index().postings()) == postings_of(fresh)
    assert len(kept._manifest()["keywords"]["segments"]) < 6
    kept.change(chunks=lambda old: old.where("doc_id = 'a'"))
    assert postings_of(kept.keyword_index().postings()) == postings_of(keywords.postings(kept.read("chunks"), "id", F.concat_ws(" ", "doc_title", "content")))


def test_new_keys_need_no_read(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "s"), buckets=16)
    old = spark.createDataFrame([chunk(i, f"d{i % 40}", i // 40, "x") for i in range(400)], CHUNKS)
    kept.change(chunks=lambda _: old)
    new = spark.createDataFrame([chunk(1000 + i, f"e{i}", 0, "x") for i in range(30)], CHUNKS)
    todo, report = kept.to_do(new)
    assert todo.count() == 30 and report["read"] <= 4 and report["partitions"] == 16
    some = old.where("doc_id in ('d1', 'd2') and chunk_index < 4").unionAll(new)
    todo, report = kept.to_do(some)
    assert sorted(r["id"] for r in todo.collect()) == list(range(1000, 1030)) and report["read"] <= 7
    kept.upsert_chunks(new.where("doc_id = 'e7'"))  # one partition has a filter of its own now
    assert sorted(r["doc_id"] for r in kept.to_do(new)[0].collect()) == sorted(f"e{i}" for i in range(30) if i != 7)
    kept.change(chunks=lambda c: c.where("doc_id = 'd1'"))
    assert kept.to_do(old)[0].count() == 390
    a, b = (key_filter.places(np.array(h, np.int64), 1 << 13) for h in ([5, -9], [7]))
    bits = lambda p: np.packbits(np.isin(np.arange(1 << 13), p), bitorder="little").tobytes()
    assert key_filter.merged([bits(a), bits(b)]) == bits(np.concatenate([a, b]))


def test_vectors_are_not_moved(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)], "id long, embedding array<float>").repartition(5)
    got = vectors.vector_top_k(df.where("id >= 0"), df.where("id < 9").withColumnRenamed("id", "query_id"), 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("MapInArrow") :]
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(id" not in plan and "Broadcast" not in plan and scan.count("Exchange") <= 1  # the test's own repartition
    with pytest.raises(Exception, match="vector width"):
        vectors.vector_top_k(df.unionAll(spark.createDataFrame([(999, [1.0])], df.schema)), df.where("id < 9").withColumnRenamed("id", "query_id"), 4).collect()
    twice = df.where("id < 3").withColumnRenamed("id", "query_id")
    assert vectors.vector_top_k(df, twice.unionAll(twice), 2).count() == 6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_registered_graph_query_recall(spark, sf):
    import os

    from tessera.catalogue.retrieval import hnsw_topk, vector_topk

    if not os.path.isdir(data := f"/root/testdata/{sf}"):
        pytest.skip("no test data")
    exact, found = ({(r["query_id"], r["id"]) for r in q(spark, data).collect()} for q in (vector_topk, hnsw_topk))
    other = {(q, i) for q, i in exact if q != i}  # the query itself is a free hit
    assert len(exact & found) / len(exact) >= 0.95 and len(other & found) / len(other) >= 0.95


def test_graphs_compare_few_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    v = (centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) / 3).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(6000)] + [(7000, None)], "id long, embedding array<float>")
    graphs.build_graphs(df, rows=3000).write.parquet(str(tmp_path / "g"))
    stored = spark.read.parquet(str(tmp_path / "g"))
    assert stored.count() >= 2
    q = df.where("id % 60 = 0").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in vectors.vector_top_k(df, q, 10).collect()}
    rows = graphs.graph_top_k(stored, q, 10).collect()
    found = {(r["query_id"], r["id"]) for r in rows}
    share = np.mean([r["compared"] for r in rows]) * stored.count() / 6000
    print("recall", len(exact & found) / len(exact), "share compared", share)
    assert len(exact & found) / len(exact) >= 0.95 and share < 0.2
    again = graphs.build_graphs(df.repartition(7), rows=3000)
    assert sorted(bytes(r["ids"]) for r in again.collect()) == sorted(bytes(r["ids"]) for r in stored.collect())
    assert graphs.graph_top_k(stored, q.limit(0), 3).count() == 0 == graphs.build_graphs(df.limit(0)).count()


def test_small_and_equal_vectors_in_graphs(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(40)], "id long, embedding array<float>")
    got = graphs.graph_top_k(graphs.build_graphs(df), df.where("id < 2").withColumnRenamed("id", "query_id"), 3).collect()
    assert len(got) == 6 and all(r["similarity"] == pytest.approx(1, abs=1e-6) for r in got)
    one = df.where("id = 5")
    assert [r["id"] for r in graphs.graph_top_k(graphs.build_graphs(one), one.withColumnRenamed("id", "query_id"), 3).collect()] == [5]


def test_the_word_or_is_a_term_of_its_query(spark, tmp_path):
    from tessera.catalogue.retrieval import SQL, keyword_websearch

    texts = {100: "er or erheed", 300: "or thing to", 200: "or and no", 400: "x or y", 1: "only or", 2: "thing or", 3: "erheed x", 4: "to and fro", 500: "a or b"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, keyword_websearch(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(SQL["keyword_websearch"]).fetchall()) and (100, 2) in got


def test_pairs_are_told_where_the_documents_are(spark, monkeypatch):
    """Results are the same in many blocks of queries and of matches, and no pair is shuffled."""
    rnd = random.Random(4)
    words = "a b c d e f".split()
    docs = {i: [rnd.choice(words) for _ in range(rnd.randrange(9))] for i in range(120)}
    asked = {q: [rnd.choice([*words, "none"]) for _ in range(rnd.randrange(4))] for q in range(60)}
    barred = {q: rnd.choice([[], ["f"], ["e", "none"]]) for q in asked}
    posted = keywords.postings(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "id long, text string"))
    queries = spark.createDataFrame([(q, t, barred[q]) for q, t in asked.items()], "query_id long, terms array<string>, barred array<string>")
    want = sorted((q, i) for q, t in asked.items() for i, w in docs.items() if t and set(t) <= set(w) and not set(barred[q]) & set(w))
    some = sorted((q, i) for q, t in asked.items() for i, w in docs.items() if set(t) & set(w))
    for most, at_once in ((1 << 17, 1 << 16), (7, 3)):
        monkeypatch.setattr(keywords, "MOST_ASKED", most)
        monkeypatch.setattr(keywords, "PAIRS_AT_ONCE", at_once)
        found = keywords.match_all(posted, queries)
        assert sorted((r["query_id"], r["id"]) for r in found.collect()) == want
        for r in found.limit(40).collect():
            assert [(m["term"], m["tf"], m["positions"]) for m in r["matched"]] == [(t, docs[r["id"]].count(t), [p for p, w in enumerate(docs[r["id"]], 1) if w == t]) for t in sorted(set(asked[r["query_id"]]))]
        bare = keywords.match_all(posted, queries, places=False)
        assert sorted(map(tuple, bare.collect())) == want
        either = keywords.match_any(posted, queries)
        assert sorted(map(tuple, either.collect())) == some
        for df in (found, bare, either):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(query_id" not in plan and "hashpartitioning(id" in plan


def test_pruned_search_scores_where_chunks_are_read(spark):
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(5)
    q = v.where("id % 30 = 0").withColumnRenamed("id", "query_id")
    centroids = vectors.fit_centroids(v, 6)
    found = vectors.pruned_top_k(v, q, centroids, 4, cells=2)
    unit, c = x / np.linalg.norm(x, axis=1, keepdims=True), np.array(centroids)
    cell, want = (unit @ c.T).argmax(1), set()
    for i in range(0, 300, 30):
        mine = np.argsort(-(unit[i] @ c.T))[:2]
        able = [j for j in range(300) if cell[j] in mine]
        want |= {(i, j, n) for n, j in enumerate(sorted(able, key=lambda j: (-round(unit[i] @ unit[j], 12), j))[:4], 1)}
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def plain_terms(text):
    return sorted({t for t, _ in automaton(text)})


def side_by_side(places, words):
    """How often the words follow each other, by the places (term, place) of a text."""
    ends = [sum(keywords.terms_of(w)[1] for w in words[:i]) for i in range(len(words))]
    return sum(all((w, p + off) in places for w, off in zip(words, ends)) for t, p in places if t == words[0])


def test_phrases_and_ranks_are_made_in_the_tasks(spark, monkeypatch):
    """Phrases, exclusions and ranks of texts, of postings and of small blocks are those of a plain
    version; no pair is shuffled or joined by document, and nothing is sorted for ``Texts``."""
    rnd = random.Random(8)
    words = ["a", "b", "c", "fly-ash", "fly", "ash", "6.1", "x/y-z", "y-z", "1.2-3"]
    docs = {i: " ".join(rnd.choice(words) for _ in range(rnd.randrange(30))) for i in range(150)}
    df = spark.createDataFrame([*docs.items(), (None, "a b")], "id long, text string")
    place = {i: automaton(t) for i, t in docs.items()}
    asked = {q: [rnd.choice(words) for _ in range(rnd.randrange(5))] for q in range(60)}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, terms array<string>")
    phrases = sorted((q, i, n) for q, t in asked.items() if t for i in docs if (n := side_by_side(place[i], t)))
    rank = lambda t, i: keywords.cover_of_many([np.array(sorted(p for w, p in place[i] if w == x)) for x in sorted(set(t))])
    ranked = {(q, i): round(0.1 * sum(w == t[0] for w, _ in place[i]) if len(set(t)) == 1 else rank(t, i), 9) for q, t in asked.items() if t for i in docs if set(t) <= {w for w, _ in place[i]}}
    web = {100 + n: f'"{a} {b}" -"{c} {d}" or {e} {f} -{g}' for n in range(30) for a, b, c, d, e, f, g in [[rnd.choice(words) for _ in range(7)]]}

    def holds(i, text):
        def branch(x):
            own = lambda p: automaton(p)
            parts = [(y.startswith("-"), y.lstrip("-").strip('"')) for y in x]
            return all(neg != bool(side_by_side(place[i], [w for w in p.split()])) for neg, p in parts)

        import re

        left, right = text.split(" or ")
        return any(branch(re.findall(r'-?"[^"]*"|\S+', x)) for x in (left, right))

    either = sorted((q, i) for q, t in web.items() for i in docs if holds(i, t))
    asked_web = spark.createDataFrame(list(web.items()), "query_id long, query string")
    for most, at_once, index in ((1 << 17, 1 << 16, keywords.Texts(df)), (7, 3, keywords.Texts(df)), (7, 3, keywords.postings(df.where("id is not null")))):
        monkeypatch.setattr(keywords, "MOST_ASKED", most)
        monkeypatch.setattr(keywords, "MOST_TERMS", most)
        monkeypatch.setattr(keywords, "PAIRS_AT_ONCE", at_once)
        found, ranks, ored = keywords.match_phrase(index, queries), keywords.ranked_terms(index, queries), keywords.match_websearch(index, asked_web)
        assert sorted(map(tuple, found.collect())) == phrases
        assert {(r["query_id"], r["id"]): round(r["text_rank"], 9) for r in ranks.collect()} == ranked
        assert sorted((r["query_id"], r["id"]) for r in ored.collect()) == either
        for got in (found, ranks, ored):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(query_id" not in plan and "map_from_entries" not in plan and "aggregate(" not in plan.lower().replace("hashaggregate(", "")
            assert not isinstance(index, keywords.Texts) or "Exchange hashpartitioning" not in plan
    rng = np.random.default_rng(5)
    for _ in range(200):
        groups = [np.sort(rng.choice(12, rng.integers(1, 8), replace=False)) + 1 for _ in range(2)]
        ends = np.cumsum([0, *map(len, groups)])
        assert keywords.cover_of_two(np.array([0]), np.array([1]), ends, np.concatenate(groups))[0] == pytest.approx(keywords.cover_of_many(groups), abs=1e-12)


def test_one_block_of_queries_is_held(spark, monkeypatch):
    """Blocks of query vectors are answered one after another, and those of words are bounded by
    their terms; before, all vectors were broadcast at once, blocks had any number of terms, and
    the queries were joined to what they match."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "id long, embedding array<double>")
    q = df.where("id < 200").withColumnRenamed("id", "query_id")
    rows = lambda d: sorted((r["query_id"], r["rank"], r["id"]) for r in d.collect())
    want = rows(vectors.vector_top_k(df, q, 3))
    monkeypatch.setattr(vectors, "TILE_BYTES", 8 * 8 * 60)
    got = vectors.vector_top_k(df, q, 3)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and rows(got) == want
    texts = keywords.Texts(spark.createDataFrame([(i, f"w{i % 7} w{i % 11} x") for i in range(77)], "id long, text string"))
    asked = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 11}", "x"]) for i in range(300)], "query_id long, terms array<string>")
    monkeypatch.setattr(keywords, "MOST_TERMS", 100)
    assert len(list(keywords.kind_blocks(keywords.kinds_of(asked)))) >= 4
    found = keywords.match_all(texts, asked, places=False)
    has = {i: {f"w{i % 7}", f"w{i % 11}"} for i in range(300)}
    assert sorted(map(tuple, found.collect())) == sorted((q, i) for q in range(300) for i in range(77) if has[q] <= has[i])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
