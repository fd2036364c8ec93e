"""Exact, substring and SimHash deduplication against brute force."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import exact_dedup, near_copies, simhash, substring_dedup

from .messy import documents, seen

NO_ID = 2**63 - 1
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UP, LOW))


@pytest.mark.parametrize(("keep", "least"), [("min", 1), ("max", 1), ("max", 2000)])
def test_exact_groups(spark, keep, least):
    df = documents(spark)
    rows = [(r["doc_id"], lower(r["text"])) for r in df.collect()]
    got = exact_dedup.exact_groups(df, keep=keep, least=least).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    best = {t: (min if keep == "min" else max)([i for i in own if i is not None], default=None) for t, own in groups.items()}
    want = [(i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_drop_exact_copies_keeps_columns(spark):
    df = documents(spark)
    out = exact_dedup.drop_exact_copies(df)
    assert out.columns == df.columns
    texts = [lower(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({lower(r["text"]) for r in df.collect()})
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_hot_group_is_split_and_merged(spark):
    from pyspark.sql import functions as F

    rows = [(i % 400 if i % 7 else None, "The same text", i) for i in range(500)] + [(i, f"text {i}", i) for i in range(500, 800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(5)
    runs = exact_dedup.sorted_runs(df, F.struct("at"), exact_dedup.normalised(F.lit("The same text")), "doc_id", "text", "min", 20).where("hot").select(*exact_dedup.RUN).distinct()
    assert 20 <= runs.count() <= 30
    got = exact_dedup.exact_groups(df, least=20)
    assert {tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(0, 500)}
    assert got.where("kept").count() == 301 and got.count() == 800
    out = exact_dedup.drop_exact_copies(df, least=20)
    assert out.count() == 301 and out.where("text = 'The same text'").first()["doc_id"] == 0


def test_neighbours_decide_and_not_the_hash(spark, monkeypatch):
    """Different texts under one splitter key (the hash is stubbed) stay apart, also hot ones."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "HEAD_CHARS", 0)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, f"Text {i % 60}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least in (50, 5000):
        got = exact_dedup.exact_groups(df, least=least)
        assert seen(got.select("doc_id", "keep_id", "group_size", "kept")) == sorted(((i, i % 60, 10, i < 60) for i, _ in rows), key=repr)
        assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_copies(df, least=least).collect()) == list(range(60))


def brute_repeats(rows, length=50):
    first, raw = {}, [(NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(i, first.get(b[s : s + length], i))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((None if i == NO_ID else i, len(b), len(b) - len(kept), len(substring_dedup.spans(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n=60):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abc dé") for _ in range(600))
    rows = []
    for _ in range(n):
        text = "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 90)))
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randint(0, 550)
            text += base[a : a + rnd.randint(20, 160)]
        rows.append((rnd.choice([None, *range(40)]), rnd.choice([text, text, text, None, ""])))
    return rows + [(50, "z" * 120), (51, "z" * 49), (52, "z" * 50), (52, "z" * 70)]


@pytest.mark.parametrize(
    ("seed", "shard_bytes", "hash_bits", "hot_shards"),
    [(1, 200, 64, 1 << 16), (2, 2000, 64, 1 << 16), (3, 1 << 22, 64, 1 << 16), (4, 300, 8, 1 << 16), (5, 300, 64, 2), (6, 1, 8, 1)],
)
def test_repeats_match_brute_force(spark, monkeypatch, seed, shard_bytes, hash_bits, hot_shards):
    """Also where hashes collide all the time (8 bits), where anchors of few shards count as hot,
    and where every document is a shard."""
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert seen(substring_dedup.remove_repeats(df, shard_bytes=shard_bytes, hash_bits=hash_bits, hot_shards=hot_shards)) == brute_repeats(rows)


def test_repeats_of_messy_documents(spark):
    df = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert seen(substring_dedup.remove_repeats(df, shard_bytes=1500)) == brute_repeats(rows)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "letters"), [(400, 2), (3000, 1), (100, 2), (1 << 20, 2)])
def test_sorted_runs_are_merged_exactly(block, letters):
    """Runs of many blocks against a dictionary of all windows; bytes of value zero too."""
    rnd, length = np.random.default_rng(block), 50
    base = bytes(rnd.integers(0, letters, 700).tolist())
    texts, ids = [], []
    for _ in range(40):
        a = int(rnd.integers(0, 600))
        texts.append(base[a : a + int(rnd.integers(10, 200))] + bytes(rnd.integers(0, letters, int(rnd.integers(0, 60))).tolist()))
        ids.append(int(rnd.integers(0, 15)))
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    k8 = substring_dedup.eight(data, len(data))
    doc, whole = substring_dedup.windows_of(ends, length, len(data))
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= block:
            cuts.append(e)
    cuts = [*cuts, len(data)] if cuts[-1] < len(data) else cuts
    blocks = [substring_dedup.Windows(k8, a, doc[a:z], whole[a:z], np.array(ids), length) for a, z in zip(cuts, cuts[1:])]
    least, first = substring_dedup.least_ids(k8, blocks, length), {}
    raw = bytes(data)
    for p in np.flatnonzero(whole).tolist():
        first[raw[p : p + length]] = min(ids[doc[p]], first.get(raw[p : p + length], NO_ID))
    for a, z, w, found in zip(cuts, cuts[1:], blocks, least):
        assert ((w.number >= 0) == whole[a:z]).all()
        for p in np.flatnonzero(whole[a:z]).tolist():
            assert found[w.number[p]] == first[raw[a + p : a + p + length]]


def test_repeats_report_spans_and_bytes(spark):
    df = spark.createDataFrame([(1, "q" * 30 + "p" * 60), (2, "start " + "p" * 60 + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, with_values=True).collect()}
    assert got[2]["spans"] == [6, 66] and bytes(got[2]["kept"]) == b"start  end"
    assert got[1]["n_removed"] == 0


def test_common_prefixes_are_kasais():
    rnd = np.random.default_rng(4)
    data = np.frombuffer(bytes(rnd.integers(97, 99, 3000).tolist()) + b"abcabcabc" * 300, np.uint8)
    k8 = substring_dedup.eight(data, len(data))
    order, head = substring_dedup.suffix_array(k8, 50, 32)
    raw = bytes(data)
    keys = [raw[i : i + 50] for i in order.tolist()]
    assert keys == sorted(keys)
    places, shared = substring_dedup.common_prefixes(k8, order, head, 32, 50)
    for p, s in zip(places.tolist()[:2000], shared.tolist()):
        a, b = raw[order[p] : order[p] + 50], raw[order[p - 1] : order[p - 1] + 50]
        assert (s >= 50) == (a == b and len(a) == 50)


def brute_fingerprint(text, k=4):
    words = lower(text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fps, label)), key=repr)


def near_rows(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(12):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 60, 400]))]
        for c in range(6):
            own = list(words)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((i * 10 + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_matches_brute_force(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = seen(simhash.near_duplicates(df))
    assert got == brute_components(rows)
    assert any(c != i for i, _, c in got)


def test_simhash_of_messy_documents(spark):
    df = documents(spark)
    assert seen(simhash.near_duplicates(df)) == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 1 in kept and 9 not in kept and kept.count(None) == 2  # empty texts are one component


@pytest.mark.parametrize("few", [8, 0])
def test_near_stage_drops_all_similar_copies(spark, monkeypatch, few):
    """Against brute force over five-word Jaccard similarity, with links only across star members;
    with ``few`` 0 in rounds to the very end."""
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "PAIRS_A_MEMBER", few)
    rnd = random.Random(3)
    rows = []
    for i in range(25):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 60, 150, 400]))]
        for c in range(8):  # a chain: each changes the one before, so far ends are less similar
            rows.append((i * 10 + c, " ".join(words)))
            for _ in range(max(1, len(words) // 70)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(5000)}"
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[9][1])]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    least = {c: min(i for (i, _), x in zip(rows, label) if x == c and i is not None) for c in set(label)}
    want = sorted((i for (i, _), c in zip(rows, label) if i is None or i == least[c]), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"] for r in corpus_pipeline.near(spark, df, "").collect()), key=repr)
    assert got == want and 25 < len(want) < 150
    assert near_copies.drop_near_copies(df.limit(0)).count() == 0


def near_sets(seed, similarity, sizes):
    """Sets, each with others that keep all but a few of its shingles and add a few."""
    rnd = np.random.default_rng(seed)
    fresh = lambda n: rnd.integers(0, 2**64 - 1, n, np.uint64)
    sets = []
    for n in sizes:
        own = fresh(n)
        sets.append(np.unique(own))
        for _ in range(6):
            gone, more = rnd.integers(0, int(n * (1 - similarity)) + 2, 2)
            sets.append(np.unique(np.concatenate([rnd.permutation(own)[: max(1, n - gone)], fresh(more)])))
    return sets


def jaccard(a, b):
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


@pytest.mark.parametrize("similarity", [0.8, 0.6, 0.95])
def test_rings_lose_no_link(similarity):
    """All similar pairs share a box and pass sizes and folded vectors; most others do not."""
    sizes = [*range(2, 40), 46, 60, 100, 150, 151, 400, 1000, 5000]
    sets = near_sets(1, similarity, sizes)
    keys = [set(near_copies.ring_keys(s, similarity).tolist()) for s in sets]
    vectors = [near_copies.folded(s, similarity) for s in sets]
    links, met = 0, 0
    for a in range(len(sets)):
        for b in range(a):
            near, shared = jaccard(sets[a], sets[b]) >= similarity, not keys[a].isdisjoint(keys[b])
            met += shared
            if near and len(np.setxor1d(sets[a], sets[b])):
                links += 1
                table = pa.table({"key": [5, 5], "root": [a, b], "n": [len(sets[a]), len(sets[b])], "vector": [vectors[a], vectors[b]]})
                assert shared and len(near_copies.alike(table, similarity)[0]) == 1, (len(sets[a]), len(sets[b]))
    assert links > 50 and (similarity < 0.8 or met < len(sets) ** 2 / 10)


def test_forests_span_and_are_no_longer_than_that():
    rnd = np.random.default_rng(4)
    for n, e in ((1, 0), (40, 30), (300, 5000)):
        a, b = rnd.integers(0, n, (2, e))
        kept = near_copies.spanning(n, a, b)
        label = simhash.components(n, a, b)
        assert (simhash.components(n, a[kept], b[kept]) == label).all() and len(kept) == n - len(set(label.tolist()))


def test_a_group_without_links_is_not_told_in_pairs(spark):
    """Texts of one origin, each too far from the others: they share boxes, and what leaves the
    tasks that hold these grows with the texts and not with their pairs."""
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rnd.sample(range(200), 8):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    sets = [near_copies.shingles(t, 5) for _, t in rows]
    assert max(jaccard(a, b) for k, a in enumerate(sets) for b in sets[:k]) < 0.8
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    boxes = near_copies.ring_rows(df, "doc_id", "text", 5, 0.8)
    vectors = near_copies.sketches(df, "doc_id", "text", 5, 0.8).select("fp", "n", "vector")
    several = boxes.groupBy("key").count().agg({"count": "max"}).first()[0]
    assert several > 40
    apart = boxes.select("key", "fp", boxes.fp.alias("root"))
    assert near_copies.passing(apart, vectors, 0.8, True).select("u", "v").distinct().count() < 120
    assert near_copies.drop_near_copies(df).count() == 120


def test_equal_stretches_are_sorted_once(monkeypatch):
    """A passage that many shards send costs one of them; all but the smallest document lose it."""
    import zlib

    text, rows = b"".join(b"%03d" % k for k in range(30)), []
    for shard in range(40):
        rec = np.array([(100 - shard, 0, 7, len(text) - 49)], substring_dedup.STRETCH)
        rows.append((shard, zlib.compress(len(rec).to_bytes(8, "little") + b"".join(rec[f].tobytes() for f in rec.dtype.names) + text)))
    sorted_bytes, array = [], substring_dedup.suffix_array
    monkeypatch.setattr(substring_dedup, "suffix_array", lambda k8, *more: sorted_bytes.append(len(k8)) or array(k8, *more))
    got = dict(substring_dedup.met_stretches(rows, 50))
    assert sum(sorted_bytes) == len(text) and sorted(got) == list(range(39))
    for raw in got.values():
        assert np.frombuffer(raw, substring_dedup.ANSWER).tolist() == [(0, 7, len(text) - 49)]


@pytest.mark.parametrize("similarity", [0.8, 0.6, 0.95])
def test_boxes_of_similar_sets_start_a_chain(similarity):
    """As dealt and met: every similar set has a partner by a chain, and few others have."""
    sets = near_sets(2, similarity, [*range(2, 40), 46, 60, 150, 400, 1000])
    sets += [np.unique(np.random.default_rng(k).integers(0, 2**64 - 1, 90, np.uint64)) for k in range(300)]
    boxes = [near_copies.unpacked_boxes(p) for _, _, p in near_copies.packed_boxes(sets, similarity, 1)]
    keys, fps, chain, first = map(np.concatenate, zip(*boxes))
    own = [near_copies.ring_keys(s, similarity) for s in sets]
    assert len(keys) == sum(map(len, own)) and first.sum() == sum(min(len(k), near_copies.FIRST_BOXES) for k in own)
    order = np.lexsort((fps, chain, keys))
    alive = set(fps[order][near_copies.with_partner(keys[order], chain[order], fps[order])].tolist())
    names = np.array([near_copies.identity(s) for s in sets], np.uint64).view(np.int64).tolist()
    for a in range(len(sets) - 300):
        for b in range(a):
            if names[a] != names[b] and jaccard(sets[a], sets[b]) >= similarity:
                assert names[a] in alive and names[b] in alive
    assert similarity < 0.8 or not alive.intersection(names[-300:])


def test_copies_are_not_told_by_every_box(spark, monkeypatch):
    """What tasks tell of groups of copies grows with the texts, however many boxes they share and
    however few of these a task holds at once."""
    rnd = random.Random(8)
    rows = []
    for i in range(6):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        for c in range(10):
            own = list(words)
            own[rnd.randrange(300)] = f"x{c}"
            rows.append((i * 10 + c, " ".join(own)))
    told, write = {}, near_copies.materialise

    def counted(df, name):
        out = write(df, name)
        told[name] = max(told.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "materialise", counted)
    monkeypatch.setattr(near_copies, "ROWS_AT_ONCE", 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(df).collect()) == [0, 10, 20, 30, 40, 50]
    assert told["ring"] > 60 * near_copies.FIRST_BOXES
    assert max(told.get(name, 0) for name in ("forest", "pairs")) <= 60 * near_copies.FIRST_BOXES


@pytest.mark.parametrize("distance", [2, 4])
def test_chains_lose_no_link(distance):
    rnd = np.random.default_rng(distance)
    fps = []
    for b in rnd.integers(0, 2**63, 150).astype(np.uint64).tolist():
        for _ in range(6):
            x = b
            for bit in rnd.choice(64, rnd.integers(0, distance + 3), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    m = distance + 1
    keys = np.concatenate([(np.int64(i) << np.int64(32)) + ((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for i, (s, w) in enumerate(simhash.segments(m))])
    u, v = simhash.chain_links(keys, np.tile(fps, m), m, distance)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance)
    n = len(fps)
    assert (simhash.components(n, np.searchsorted(fps, u), np.searchsorted(fps, v)) == simhash.components(n, a, b)).all()


def test_chains_report_a_forest_and_not_all_pairs():
    base = 0x0123456789ABCDEF
    fps = np.unique(np.array([base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i + 1, 64)], np.uint64))
    keys = np.zeros(len(fps), np.int64)
    m = 5
    s, w = simhash.segments(m)[0]
    keys = ((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64)
    u, _ = simhash.chain_links(keys, fps, m, 4)
    assert len(u) < len(fps)


def test_long_paths_connect(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 999), (5000, 5000)], "u long, v long")
    got = dict(map(tuple, simhash.connected(links).collect()))
    assert got == {**{i: 0 for i in range(1, 301)}, 1000: 999}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_queries_equal_their_sql(spark):
    import duckdb

    from tessera.llm import queries

    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.sql(sql)
        got = queries.QUERIES[name](spark, data)
        assert sorted(got.columns) == sorted(want.columns)
        assert seen(got.select(*want.columns)) == sorted(want.fetchall(), key=repr), name


def test_long_documents_are_anchored_by_pieces():
    rnd = np.random.default_rng(8)
    for n, step in ((5000, 700), (1300, 50), (50, 50), (49, 50), (3000, 2999)):
        data = rnd.integers(97, 100, n).astype(np.uint8)
        found = []
        whole = np.arange(n) <= n - 50
        if whole.any():
            found.append(substring_dedup.anchors(substring_dedup.eight(data, n), whole, 50, 64))
            found.append(substring_dedup.anchors_by_pieces(data, 50, 64, step))
        seen_by = [{w: a for a, x, y in zip(*map(np.ndarray.tolist, f)) for w in range(x, y + 1)} for f in found]
        assert not found or seen_by[0] == seen_by[1] and len(seen_by[0]) == n - 49
        if found:
            p = found[0][0]
            assert (substring_dedup.gram_hash_at(data, p, 64) == substring_dedup.gram_hash(substring_dedup.eight(data, n), p, 64)).all()


def test_long_documents_meet_others(spark):
    rnd = random.Random(9)
    passages = ["".join(rnd.choice("abcde ") for _ in range(rnd.choice([60, 120, 400]))) for _ in range(20)]
    rows = [(1, "".join(rnd.choice("abcde ") for _ in range(9000)) + passages[0] + passages[1])]
    rows += [(i, "".join(rnd.choice([*passages, f"{rnd.random()} "]) for _ in range(6))) for i in range(2, 30)] + [(0, passages[1] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    small = substring_dedup.remove_repeats(df, shard_bytes=700)
    assert seen(small) == seen(substring_dedup.remove_repeats(df, shard_bytes=1 << 20))


def test_merged_runs_decide_what_crosses_shards():
    """All stretches of a bucket, whatever their bytes, against brute force."""
    import zlib

    rnd = random.Random(10)
    parts = ["".join(rnd.choice("ab") for _ in range(60)) for _ in range(6)]
    rows, stretches, i = [], [], 0
    for shard in range(7):
        own = []
        for place in range(rnd.randint(1, 4)):
            text = (rnd.choice(parts) + rnd.choice(parts))[rnd.randint(0, 20) : rnd.randint(80, 120)].encode()
            own.append((rnd.choice([i, 99]), place, rnd.randint(0, 500), text))
            i += 1
        rec = np.zeros(len(own), substring_dedup.STRETCH)
        for k, (doc, place, start, text) in enumerate(own):
            rec[k] = (doc, place, start, len(text) - 49)
        buf = len(rec).to_bytes(8, "little") + b"".join(rec[f].tobytes() for f in rec.dtype.names) + b"".join(t for *_, t in own)
        rows.append((shard, zlib.compress(buf)))
        stretches += [(shard, *x) for x in own]
    least = {}
    for _, doc, _, _, text in stretches:
        for k in range(len(text) - 49):
            least[text[k : k + 50]] = min(doc, least.get(text[k : k + 50], doc))
    want = {(shard, place, start + k) for shard, doc, place, start, text in stretches for k in range(len(text) - 49) if least[text[k : k + 50]] < doc}
    for block in (1 << 20, 150):
        old, substring_dedup.BLOCK_BYTES = substring_dedup.BLOCK_BYTES, block
        try:
            got = {(shard, int(a["place"]), int(a["start"]) + k) for shard, raw in substring_dedup.met_stretches(rows, 50) for a in np.frombuffer(raw, substring_dedup.ANSWER) for k in range(int(a["windows"]))}
        finally:
            substring_dedup.BLOCK_BYTES = old
        assert got == want and want
