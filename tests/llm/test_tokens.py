"""Token files, packing and the lexicon against the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import lexicon, packing, token_store
from tessera.llm.tokens import PieceEncoder

from .messy import documents, seen

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ALPHABET = "abÉé ßİIıſσΣς'sS'tLL\n\t \u0085\x1c1²½٣字漢́é🙂ﬁ_—.…‍!#"


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def raw(own):
    return np.array(own, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.text(max_size=20)), min_size=1, max_size=5))
def test_pieces_give_what_the_library_gives(path, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    enc = PieceEncoder(path, max_memo=3)
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [ids(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_remembered_pieces_are_bounded_and_frequent_ones_stay(path, monkeypatch):
    enc, learnt, bound, held = PieceEncoder(path, max_memo=3000), [], 3000, 0
    learn = enc._learn

    def counted(pieces):
        nonlocal held
        learnt.extend(pieces)
        learn(pieces)
        held = max(held, len(enc.memo) + len(getattr(enc, "older", ())))

    monkeypatch.setattr(enc, "_learn", counted)
    monkeypatch.setattr("tessera.llm.tokens.CHARS_AT_ONCE", 1000, raising=False)
    letters = "".maketrans("0123456789", "abcdefghij")
    texts = [" ".join(["often", *(f"x{i:06d}".translate(letters) for i in range(k, k + 100)), "often"]) for k in range(0, 20_000, 100)]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [ids(path, t) for t in texts]
    assert held <= bound + 2 * 250
    assert learnt.count("often") == 1 and learnt.count(" often") == (path == BYTE)


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(ALPHABET, max_size=60), st.text(max_size=30)))
def test_own_merges_encode_and_decode_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    table = lexicon.merge_table(WORD)
    coder = lexicon.WordCoder(table, lexicon.mapped(lexicon.compile_lexicon([("the", table.merge("the"))])))
    got, decoded = coder.code(text)
    want = ids(WORD, text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert decoded == LIBRARY[WORD].decode(want, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(words=st.sets(st.text("abcé", min_size=1, max_size=7), max_size=40), other=st.text("abcé", max_size=7))
def test_lexicon_numbers_words_and_is_minimal(words, other):
    entries = [(w, [len(w), i]) for i, w in enumerate(words)]
    lex = lexicon.mapped(lexicon.compile_lexicon(entries))
    for w, own in entries:
        assert lex.get(w).tolist() == own
    assert (lex.get(other) is None) == (other not in words)
    # minimal: as many states as there are distinct sets of endings
    suffixes = {frozenset(w.encode()[len(p):] for w in words if w.encode().startswith(p)) for v in words for p in (v.encode()[:k] for k in range(len(v.encode()) + 1))}
    assert lex.n_states == max(1, len(suffixes))


@settings(max_examples=80, deadline=None)
@given(values=st.lists(st.integers(0, 2**40), max_size=300))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    data = token_store.EliasFano.build(values).to_bytes()
    ef, end = token_store.EliasFano.from_buffer(data)
    assert end == len(data)
    assert ef.all().tolist() == values.tolist()
    assert [ef.get(i) for i in range(len(values))] == values.tolist()
    if len(values) > 200:
        assert len(data) < 8 * len(values) + 200


def test_token_file_selects_single_documents():
    own = [ids(BYTE, t) + [2] for t in ("one two", "", "three")]
    f = token_store.TokenFile(token_store.pack_file([None, -5, 2**62], [np.array(o, "<u2").tobytes() for o in own], 2))
    assert f.doc_ids() == [None, -5, 2**62]
    assert [f.document(i).tolist() for i in range(3)] == own


def test_token_files_of_messy_documents(spark):
    df = documents(spark)
    got = token_store.token_files(df, BYTE, end_id=2).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, want = 0, []
    for doc, text in rows:
        own = ids(BYTE, text) + [2]
        want.append((doc, start, len(own), zlib.crc32(raw(own))))
        start += len(own)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want
    # small files change nothing
    again = token_store.token_files(df, BYTE, end_id=2, max_file_tokens=10)
    assert seen(again.select("doc_id", "start", "ids_crc32")) == sorted(((a, b, d) for a, b, _, d in want), key=repr)
    assert again.select("file").distinct().count() > 3
    assert token_store.token_files(df.limit(0), BYTE).count() == 0


def check_packing(rows, texts, size):
    """Every id in exactly one piece, offsets gapless, sequences not too long; the padding."""
    docs, sequences, kinds = defaultdict(list), defaultdict(list), Counter(texts)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    covered = Counter()
    for doc, own in docs.items():
        for r in own:
            covered[doc, r["start"], r["length"], r["ids_crc32"]] += 1
    total = sum(n * (len(ids(WORD, t)) + 1) for (_, t), n in kinds.items())
    assert sum(r["length"] for r in rows) == total
    for doc in {d for d, _ in kinds}:
        mine = [(t, n) for (d, t), n in kinds.items() if d == doc]
        if len(mine) == 1 and mine[0][1] == 1:
            own = np.array(ids(WORD, mine[0][0]) + [1], "<u4")
            pieces = sorted(docs[doc], key=lambda r: r["start"])
            assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:i]) for i in range(len(pieces))]
            for p in pieces:
                assert p["doc_tokens"] == len(own)
                assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
    return padding


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_of_messy_documents(spark, size):
    df = documents(spark)
    rows = packing.pack(df, WORD, size=size, end_id=1).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    assert check_packing(rows, texts, size) < size
    assert packing.pack(df.limit(0), WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 31), min_size=1, max_size=120), size=st.just(32))
def test_plan_places_each_rest_once(lengths, size):
    plan = packing.plan_packs(dict(Counter(lengths)), size)
    got, sequences = Counter(), defaultdict(list)
    t = plan.slots
    for length, rank, count, _, part, sequence, at in zip(*(t[f].tolist() for f in packing.SLOT_FIELDS)):
        for k in range(count):
            got[length, rank + k] += part
            sequences[sequence + k].append((at, part))
    assert got == Counter({(n, k): n for n, c in Counter(lengths).items() for k in range(c)})
    for own in sequences.values():
        assert [a for a, _ in sorted(own)] == [sum(p for _, p in sorted(own)[:i]) for i in range(len(own))]
    assert plan.padding < size * max(1, len(sequences)) and len(sequences) == plan.sequences
    assert plan.sequences <= -(-sum(lengths) // size) + 1


def test_encode_decode_of_messy_documents(spark):
    df = documents(spark)
    want = []
    for r in df.collect():
        own = ids(WORD, r["text"])
        decoded = LIBRARY[WORD].decode(own, skip_special_tokens=False)
        want.append((r["doc_id"], len(own), hashlib.sha256(raw(own)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert seen(lexicon.encode_decode(df, WORD)) == sorted(want, key=repr)
    small = lexicon.build_lexicon(df, WORD, max_words=2)
    assert seen(lexicon.encode_decode(df, WORD, lexicon=small)) == sorted(want, key=repr)
    assert lexicon.encode_decode(df.limit(0), WORD).count() == 0


def test_word_counts_cover_all_rows(spark):
    df = documents(spark)
    table = lexicon.merge_table(WORD)
    want = Counter(w for r in df.collect() for w in table.pieces(r["text"] or ""))
    most = max(n for n in want.values() if sum(m >= n for m in want.values()) <= 6)
    least = min(n for n in want.values() if sum(m >= n for m in want.values()) <= 6)
    top = {w for w, n in want.items() if n >= least}
    assert most >= least and len(top) <= 6
    assert set(lexicon.frequent_words(df, WORD, 6)) == top
    assert set(lexicon.frequent_words(df, WORD, 6, flush_at=1)) == top
    assert lexicon.frequent_words(df.limit(0), WORD, 6) == []
