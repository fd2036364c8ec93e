"""BPE by a minimal acyclic transducer over frequent words, with exact merging of the rest.

The words of the whole corpus are counted by Spark; the ``max_words`` most frequent ones are
compiled into a minimal acyclic automaton with shared suffixes. Each arc carries how many
words precede it, so a path sums to the word's number (its output), which points into a
table of token ids. The compiled file is a few bytes an arc, goes to the workers once as a
broadcast of bounded size and is memory-mapped there. Words outside it are merged by the
tokenizer's own merge ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialise, record_batch, text_batches
from .tokens import LIMIT, word_pattern

SHORT = 48  # symbols of a word that is merged by scanning
LONGEST = 256  # characters of a word that is counted, compiled or remembered; longer ones are merged each time


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class MergeTable:
    """The word splitter and merge ranks of a lower-casing word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.end or spec["pre_tokenizer"]["type"] != "Sequence":
            raise ValueError("a word-end BPE file is needed")
        vocab, merges = model["vocab"], model["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
        symbols = byte_symbols()
        self.first = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.end) for s in symbols]
        self.latin = word_pattern()
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.normalizer, self.splitter = lib.normalizer, lib.pre_tokenizer
        self.bytes_of = {s: b for b, s in enumerate(symbols)}
        self.beyond = re.compile(f"[\\u{LIMIT:04x}-\\U0010ffff]")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: str) -> list[int]:
        """Token ids of one word: lowest merge rank first, leftmost first."""
        raw = word.encode()
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [i for i in ids if i is not None]
        return self._merge_scanning(ids) if len(ids) <= SHORT else self._merge_queued(ids)

    def _merge_scanning(self, ids: list[int]) -> list[int]:
        """A pass over the word for each merge: quickest where words are short."""
        ranks = self.ranks
        while len(ids) > 1:
            best, new = None, 0
            for a, b in zip(ids, ids[1:]):
                if (hit := ranks.get(a << 20 | b)) and (best is None or hit[0] < best):
                    (best, new), pair = hit, (a, b)
            if best is None:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and (ids[i], ids[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_queued(self, ids: list[int]) -> list[int]:
        """A queue of pairs by rank and place over linked neighbours: n log n for long runs."""
        ranks, n = self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank and place in one number; a rank stands for one pair
        queue = [hit[0] << 40 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (hit := ranks.get(a << 20 | b))]
        heapq.heapify(queue)
        place = (1 << 40) - 1
        while queue:
            top = heapq.heappop(queue)
            i = top & place
            j = after[i]
            if ids[i] < 0 or j >= n or not (hit := ranks.get(ids[i] << 20 | ids[j])) or hit[0] != top >> 40:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], after[i] = hit[1], -1, after[j]
            if (b := after[i]) < n:
                before[b] = i
                if hit := ranks.get(ids[i] << 20 | ids[b]):
                    heapq.heappush(queue, hit[0] << 40 | i)
            if (a := before[i]) >= 0 and (hit := ranks.get(ids[a] << 20 | ids[i])):
                heapq.heappush(queue, hit[0] << 40 | a)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> list[str]:
        """Words of a text without special strings. Latin text is lower-cased and split here; for
        other scripts, whose character classes differ between Unicode versions, the tokenizer's
        own normaliser and splitter are asked."""
        if not self.beyond.search(text) and not self.beyond.search(lower := text.lower()):
            return self.latin.findall(lower)
        split = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, piece)).decode() for piece, _ in split]

    def pieces(self, text: str) -> list[str]:
        """Words and special strings in order; a special string stays as it is."""
        if self.specials is None or not self.specials.search(text):
            return self.words(text)
        out = []
        for i, part in enumerate(self.specials.split(text)):
            out += [part] if i % 2 else self.words(part)
        return out


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


BYTES = [bytes((b,)) for b in range(256)]
HEAD = struct.Struct("<8s5q")


def compile_lexicon(entries: list[tuple[str, list[int]]]) -> bytes:
    """Compile (word, ids) into the automaton file; words in any order, each once.

    States are minimised while sorted words are added (a finished suffix is looked up among
    those seen), so equal suffixes are one state.
    """
    entries = sorted((w.encode(), ids) for w, ids in entries)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[list] = [[False, []]]  # open states: [final, [(label, state)]]

    def freeze(down_to: int, word: bytes) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(frozen)
                frozen.append((final, arcs))
            path[-1][1].append((word[depth - 1], register[key]))

    last = b""
    for word, _ in entries:
        same = len(os.path.commonprefix([last, word]))
        freeze(same, last)
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    freeze(0, last)
    frozen.append((path[0][0], path[0][1]))
    below = []
    for final, arcs in frozen:
        below.append(final + sum(below[s] for _, s in arcs))
    starts, labels, targets, outputs = [0], bytearray(), [], []
    for final, arcs in frozen:
        before = int(final)
        for label, state in arcs:
            labels.append(label)
            targets.append(state)
            outputs.append(before)
            before += below[state]
        starts.append(len(labels))
    bounds = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries], dtype=np.int64)])
    parts = [
        bytes(labels), np.array(starts, "<u4").tobytes(), np.array(targets, "<u4").tobytes(), np.array(outputs, "<u4").tobytes(),
        np.array([final for final, _ in frozen], np.uint8).tobytes(), bounds.astype("<u4").tobytes(),
        np.array([i for _, ids in entries for i in ids], "<u4").tobytes(),
    ]
    return HEAD.pack(b"TESSLEX1", len(frozen), len(labels), len(entries), int(bounds[-1]), 0) + b"".join(parts)


class Lexicon:
    """A compiled lexicon over any buffer (here a memory map)."""

    def __init__(self, buf):
        magic, states, arcs, words, ids, _ = HEAD.unpack_from(buf, 0)
        if magic != b"TESSLEX1":
            raise ValueError("not a lexicon")
        self.buf, self.n_words, self.n_states, self.root = buf, words, states, states - 1
        at = self.base = HEAD.size
        at += arcs
        view = memoryview(buf)  # plain views: single items are read faster than from arrays
        self.starts, at = view[at : at + 4 * (states + 1)].cast("I"), at + 4 * (states + 1)
        self.targets, at = view[at : at + 4 * arcs].cast("I"), at + 4 * arcs
        self.outputs, at = view[at : at + 4 * arcs].cast("I"), at + 4 * arcs
        self.final, at = view[at : at + states], at + states
        self.bounds, at = np.frombuffer(buf, "<u4", words + 1, at), at + 4 * (words + 1)
        self.ids = np.frombuffer(buf, "<u4", ids, at)

    def number(self, word: str) -> int | None:
        """The word's number in byte order: the sum of outputs along its path."""
        state, total, base, find = self.root, 0, self.base, self.buf.find
        starts, targets, outputs = self.starts, self.targets, self.outputs
        for byte in word.encode():
            a = find(BYTES[byte], base + starts[state], base + starts[state + 1]) - base
            if a < 0:
                return None
            total += outputs[a]
            state = targets[a]
        return total if self.final[state] else None

    def get(self, word: str) -> np.ndarray | None:
        n = self.number(word)
        return None if n is None else self.ids[self.bounds[n] : self.bounds[n + 1]]


@lru_cache(maxsize=2)
def mapped(data: bytes) -> Lexicon:
    """Memory-map the compiled bytes from an unlinked file in the worker's own temp folder."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def frequent_words(df: DataFrame, tokenizer: str, max_words: int, text_col: str = "text", flush_at: int = 500_000) -> list[str]:
    """The most frequent words over all texts, at most ``max_words`` of at most ``LONGEST``
    characters: every word above the least count that still fits, so that only they reach the
    driver and no task sends more."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        from collections import Counter

        table, seen = merge_table(tokenizer), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                pieces = table.pieces(text)
                seen.update(pieces if max(map(len, pieces), default=0) <= LONGEST else [w for w in pieces if len(w) <= LONGEST])
            if len(seen) > flush_at:
                yield record_batch(schema, [seen.keys(), seen.values()])
                seen = Counter()
        yield record_batch(schema, [list(seen.keys()), list(seen.values())])

    text_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = materialise(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    room, least = max_words, None
    for r in total.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(max_words).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    words = [] if least is None else [r["word"] for r in total.where(F.col("n") >= least).select("word").collect()]
    return words


def build_lexicon(df: DataFrame, tokenizer: str, max_words: int = 50_000, text_col: str = "text") -> bytes:
    table = merge_table(tokenizer)
    words = [w for w in frequent_words(df, tokenizer, max_words, text_col) if w not in table.special]
    return compile_lexicon([(w, table.merge(w)) for w in words])


class WordCoder:
    """Lexicon first, merges for the rest; remembers up to ``max_memo`` words of at most
    ``LONGEST`` characters per worker."""

    def __init__(self, table: MergeTable, lexicon: Lexicon, max_memo: int = 800_000):
        self.table, self.lexicon, self.max_memo = table, lexicon, max_memo
        self.ids: dict[str, bytes] = {}
        self.strings = [table.strings.get(i, "") for i in range(max(table.strings) + 1)]

    def _learn(self, word: str) -> bytes:
        if word in self.table.special:
            ids = [self.table.special[word]]
        else:
            hit = self.lexicon.get(word)
            ids = self.table.merge(word) if hit is None else hit.tolist()
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def code(self, text: str) -> tuple[bytes, str]:
        """ids as little-endian unsigned 32-bit, and the text decoded from them."""
        words = self.table.pieces(text)
        known = self.ids
        if len(known) > self.max_memo:
            known.clear()
        long = {}
        for w in set(words).difference(known):
            (known if len(w) <= LONGEST else long)[w] = self._learn(w)
        ids = b"".join([known[w] if len(w) <= LONGEST else long[w] for w in words] if long else map(known.__getitem__, words))
        return ids, self.decode(ids)


@lru_cache(maxsize=2)
def coder(tokenizer: str, data: bytes) -> WordCoder:
    return WordCoder(merge_table(tokenizer), mapped(data))


def encode_decode(df: DataFrame, tokenizer: str, lexicon: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", with_values: bool = False) -> DataFrame:
    """Encode every text and decode it again; one row per input row.

    doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_values`` adds ids (binary) and
    decoded. A null or empty text has no ids and decodes to the empty text; rows that repeat
    an id, or have none, keep their own row; an empty table gives no rows; other columns of
    ``df`` are ignored. Special strings inside a text become their special id, as in the
    library.
    """
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(build_lexicon(df, tokenizer, text_col=text_col) if lexicon is None else lexicon)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.binary()), ("decoded", pa.string())] if with_values else []
    schema = pa.schema(fields)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_values else "")

    def code(batches):
        own = coder(tokenizer, data.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, decoded = own.code(text)
                row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append(row + (ids, decoded) if with_values else row)
            if rows:
                yield record_batch(schema, list(zip(*rows)))

    return id_text(df, id_col, text_col).mapInArrow(code, ddl)
