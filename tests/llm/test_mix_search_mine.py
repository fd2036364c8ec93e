"""Mixing, tiered search and hard negatives against plain versions and SQL."""

import math
import os
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, mixing, queries, tiered_search

from .messy import documents, seen

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", ["op11_mixing", "op12_tiered_search", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DATA)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(got.select(*cols).collect()) == plain(want.select(*cols).fetchall())


# -- mixing ------------------------------------------------------------------------------------


def water_filled(words, weights=(5, 2, 1)):
    """Targets by dealing the excess again and again, in fractions."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = Fraction(3, 2) * sum(words.values()), {}
    while True:
        rest = [s for s in words if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if level * weight[s] >= 2 * words[s]]
        if not above:
            return {**fixed, **{s: level * weight[s] for s in rest}}
        fixed |= {s: Fraction(2 * words[s]) for s in above}


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_copies(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["a", "a", "a", "b", "Z", "é", None, "c"])) for i in range(900)]
    df = documents(spark, rows)
    got = mixing.mixing_plan(df).collect()
    words = Counter()
    for r in df.collect():
        words[r["source"]] += size(r["text"])
    want = water_filled(words)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["source_size"] == words[r["source"]]
        assert r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) and abs(r["target"] - float(want[r["source"]])) < 1e-6
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, *_ in rows)
    for s in words:
        assert abs(taken[s] - float(want[s])) <= max(60, 0.02 * float(want[s]))
    assert seen(mixing.mixing_plan(df.repartition(7))) == sorted(map(tuple, got), key=repr)  # reruns agree


def test_mix_gives_whole_rows(spark):
    df = documents(spark)
    plan = Counter()
    for r in mixing.mixing_plan(df).collect():
        plan[r["doc_id"], r["source"], r["size"]] += r["copies"]
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy"]
    got = Counter((r["doc_id"], r["source"], size(r["text"])) for r in mixed.collect())
    assert got == +plan and all(r["copy"] in (1, 2) for r in mixed.collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixing_plan(df.limit(0)).count() == 0
    assert mixing.mixing_plan(documents(spark, [(1, None, None, None), (2, "", "x", "a")])).where("taken <> 0 OR target <> 0").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df.withColumn("copy", F.lit(1)))


def test_one_source_in_many_parts(spark):
    rows = [(i, "w " * (i % 9), "en", "hot" if i % 3 else f"s{i % 40}") for i in range(2000)]
    got = mixing.mixing_plan(documents(spark, rows)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in got) == 2000 and all(abs(r["t"] - r["target"]) <= 9 for r in got)


# -- search ------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def ranked(docs, items, k):
    held = [(i, Counter(words_of(t))) for i, t in docs if words_of(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words_of(text))
    found = []
    for item, own in asked.items():
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in own if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        found += [(item, i, -s, r) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


@pytest.mark.parametrize(("k", "shard_bytes", "least"), [(50, 1 << 20, 32), (3, 300, 1), (7, 2000, 2), (1, 1, 1)])
def test_search_equals_brute_force(spark, monkeypatch, k, shard_bytes, least):
    monkeypatch.setattr(tiered_search, "LEAST", least)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(40)] + ["Größe", "漢字", "A1", "x"]
    text = lambda n: "".join(rng.choice(vocabulary[: rng.randint(1, len(vocabulary))]) + rng.choice([" ", "-", "\n", "._", "\x7f"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60)), "en", "a") for i in range(150)] + [(200 + i, "w1 w2 w3", "en", "a") for i in range(20)]
    df = documents(spark, rows).unionByName(documents(spark))
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(3, "w3"), (None, "w1"), (99, None), (98, "nowhere"), (97, "w1 W1 LOREM")]
    index = tiered_search.build_index(df, shard_bytes=shard_bytes)
    got = tiered_search.search(index, spark.createDataFrame(items, "item_id long, text string"), k)
    want = ranked([(r["doc_id"], r["text"]) for r in df.collect()], items, k)
    assert sorted(((r["item_id"], r["doc_id"], r["score"], r["rank"]) for r in got.collect()), key=repr) == want


def test_tiers_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["common", "other", "third", f"rare{i % 50}"]) for _ in range(rng.randint(1, 80))), "en", "a") for i in range(3000)]
    df = documents(spark, rows, extra=False).coalesce(1)
    items = [(i, f"common rare{i}") for i in range(40)] + [(100, "common other third"), (101, "third")]
    want = ranked([(i, t) for i, t, *_ in rows], items, 10)
    index = tiered_search.build_index(df)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = tiered_search.search(index, asked, 10).collect()
    assert sorted(((r["item_id"], r["doc_id"], r["score"], r["rank"]) for r in got), key=repr) == want
    assert {1} < {r["tiers"] for r in got}  # some are proven by the first tier, others fall through
    monkeypatch.setattr(tiered_search, "BLOCK_BYTES", 200)
    assert seen(tiered_search.search(index, asked, 10)) == sorted(map(tuple, got), key=repr)
    assert tiered_search.search(index, asked.limit(0)).count() == 0
    assert tiered_search.search(tiered_search.build_index(df.limit(0)), asked).count() == 0


def test_few_shards_are_held_at_once(spark):
    """A task that makes many shards writes each to a file, so that neither it nor a reader holds
    all of them; before, the shards of a task were one row group."""
    import pyarrow.parquet as pq

    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(500)), "en", "a") for i in range(24)]
    index = tiered_search.build_index(documents(spark, rows, extra=False).coalesce(1), shard_bytes=1 << 12)
    files = [pq.read_metadata(f.removeprefix("file://")) for f in index.shards.inputFiles()]
    assert [f.num_rows for f in files] == [1] * 12


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(tiered_search, "PIECE", 7)
    text = "Alpha beta-gamma  " * 20 + "x" * 50 + " ÄÖü9 \x00z"
    assert [t.decode() for t in tiered_search.terms(text.encode())] == words_of(text)


# -- hard negatives ----------------------------------------------------------------------------


def mined(rows, anchors, positives=5, negatives=3):
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, label, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a][1], q[b][1]))
    found = []
    for a in anchors:
        own = sorted((-dot(a, i), i) for i in q if i != a and q[i][0] == q[a][0])[:positives]
        for p, i in own:
            band = sorted((-dot(a, j), j) for j in q if q[j][0] != q[a][0] and 50 * -p <= 100 * dot(a, j) <= 95 * -p)[:negatives]
            found += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(band, 1)]
    return sorted(found)


@pytest.mark.parametrize(("digit", "chunk", "block", "shift"), [(12, 4096, 512, 0), (2, 16, 5, 2**62), (3, 7, 3, -(2**63))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, digit, chunk, block, shift):
    for name, value in (("DIGIT", digit), ("CHUNK_ROWS", chunk), ("ANCHORS_A_BLOCK", block), ("BLOCKS_AT_ONCE", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 6)) / 4
    rows = [(shift + 3 * i, int(i % 4), [float(x) for x in np.float32(centres[i % 3] + rng.normal(size=6) / 9)]) for i in range(90)]
    rows += [(shift + 1000 + i, i % 3, [0.25] * 6) for i in range(40)]  # many equal vectors
    bad = [(shift + 5000, None, [0.1] * 6), (shift + 5001, 1, None), (shift + 5002, 1, [float("nan")] * 6), (shift + 5003, 1, [float("inf")] * 6), (None, 1, [0.1] * 6), (shift + 5004, 1, [None] * 6)]
    again = [rows[0], (rows[1][0], rows[1][1] + 5, rows[1][2])]  # repeated ids: the least row counts
    df = spark.createDataFrame(rows + bad + again, "vec_id long, label int, embedding array<float>").withColumn("other", F.lit(1)).withColumn("w", F.lit("x")).repartition(3)
    got = hard_negatives.hard_negatives(df, anchor=F.col("vec_id") % 5 == 0)
    anchors = [i for i, *_ in rows if math.fmod(i, 5) == 0 or i % 5 == 0]
    assert sorted(map(tuple, got.collect())) == mined(rows, [a for a in anchors if a % 5 == 0])
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_hard_negatives_refuses(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.hard_negatives(make([(1, 1, [1e12]), (2, 1, [1e12])]))
    with pytest.raises(Exception, match="several widths"):
        hard_negatives.hard_negatives(make([(1, 1, [1.0]), (2, 1, [1.0, 2.0])]))
    large = [(i, i % 2, [3e5 + i, 1.0 - i]) for i in range(12)]  # sums beyond exact doubles
    assert sorted(map(tuple, hard_negatives.hard_negatives(make(large), scale=256).collect())) == mined(large, range(12))
