"""Memoised use of the ``tokenizers`` library inside Spark tasks.

The library spends most of its time on per-text bookkeeping. Pre-tokenised pieces never
interact in BPE, so a task splits a text with the tokenizer's own pattern, asks the library
for each distinct piece once and joins the remembered ids. The split is done here only for
texts wholly below U+0250 (after the tokenizer's lower-casing), where the character classes
are stable across Unicode versions; any other text, and any text that holds one of the
tokenizer's special strings, goes through the library whole. The result is the library's.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

LIMIT = 0x250
MOST_MEMO = 1_000_000  # pieces that a worker remembers of a tokenizer
CHARS_AT_ONCE = 1 << 21  # of texts that are cut into pieces at once, if they are not one text
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0"


def char_class(major: str) -> str:
    """Character-class ranges below LIMIT of a Unicode major category."""
    members = [c for c in range(LIMIT) if unicodedata.category(chr(c))[0] == major]
    runs, start = [], None
    for i, c in enumerate(members):
        start = c if start is None else start
        if i + 1 == len(members) or members[i + 1] != c + 1:
            runs.append(f"\\u{start:04x}-\\u{c:04x}")
            start = None
    return "".join(runs)


def byte_level_pattern() -> re.Pattern:
    letter, number = char_class("L"), char_class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def word_pattern() -> re.Pattern:
    letter, number = char_class("L"), char_class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACE}{letter}{number}]+")


class PieceEncoder:
    """ids of whole texts as little-endian bytes, exactly as the library gives them.

    ``max_memo`` bounds the remembered pieces (about 200 bytes each) but for those of the texts
    at hand. They lie in two halves: when the newer one is full the older one is forgotten, and a
    piece that is met again moves to the newer one, so frequent pieces stay. What is forgotten
    costs time and never changes a result.
    """

    def __init__(self, path: str, max_memo: int = MOST_MEMO, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = special_as_text
        spec = json.loads(self.lib.to_str())
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        pre = spec.get("pre_tokenizer") or {}
        norm = spec.get("normalizer") or {}
        steps = [n.get("type") for n in norm.get("normalizers", [norm])]
        self.lower = "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.pattern = byte_level_pattern()
        elif pre.get("type") == "Sequence" and self.lower and spec["model"].get("end_of_word_suffix") == "</w>":
            self.pattern = word_pattern()
        else:
            self.pattern = None
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])] if not special_as_text else []
        self.odd = re.compile("|".join([f"[\\u{LIMIT:04x}-\\U0010ffff]", *special]))
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.max_memo = max_memo
        names = [self.lib.id_to_token(i) or "" for i in range(self.lib.get_vocab_size())]
        self.ends = np.array([t.endswith("</w>") for t in names]) if self.lower else None
        self.widths = np.array([len(t) for t in names], np.int64)  # bytes, in a byte-level vocabulary

    def _learn(self, pieces: list[str]) -> None:
        """Remember pieces. Those that cannot touch are encoded in one text and cut apart again:
        at the tokens that end words, or by the bytes that tokens stand for."""
        single = pieces
        if self.pattern is not None:
            joint = pieces if self.lower else [p for p in pieces if p[0] == " " and p[1:].isalpha()]
            single = [] if self.lower else [p for p in pieces if not (p[0] == " " and p[1:].isalpha())]
            for at in range(0, len(joint), 2048):
                some = joint[at : at + 2048]
                raw = self._whole([(" " if self.lower else "").join(some)])[0]
                ids = np.frombuffer(raw, self.dtype)
                if self.lower:
                    cuts = np.flatnonzero(self.ends[ids]) + 1
                    good = len(cuts) == len(some)
                else:
                    upto = np.cumsum(self.widths[ids])
                    want = np.cumsum([len(p.encode()) for p in some])
                    cuts = np.searchsorted(upto, want) + 1
                    good = len(ids) > 0 and cuts[-1] == len(ids) and bool((upto[cuts - 1] == want).all())
                if good:
                    edges = [0, *(cuts * self.dtype.itemsize).tolist()]
                    self.memo.update((p, raw[a:z]) for p, a, z in zip(some, edges, edges[1:]))
                else:
                    single = single + some
        for at in range(0, len(single), 4096):
            self.memo.update(zip(single[at : at + 4096], self._whole(single[at : at + 4096])))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.pattern is None:
            return self._whole(texts)
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < CHARS_AT_ONCE:
                size += len(texts[end])
                end += 1
            out += self._by_pieces(texts[at:end])
            at = end
        return out

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        pieces, whole = {}, []
        missing: set[str] = set()
        if len(self.memo) > self.max_memo // 2:
            self.older, self.memo = self.memo, {}
        memo, older, findall = self.memo, self.older, self.pattern.findall
        for i, text in enumerate(texts):
            if self.odd.search(text):
                whole.append(i)
                continue
            if self.lower:
                text = text.lower()
                if self.odd.search(text):
                    whole.append(i)
                    continue
            pieces[i] = own = findall(text)
            missing.update(set(own).difference(memo))
        again = set(filter(older.__contains__, missing))
        memo.update((p, older[p]) for p in again)
        self._learn(list(missing - again))
        for i, own in pieces.items():
            out[i] = b"".join(map(memo.__getitem__, own))
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str, max_memo: int = MOST_MEMO) -> PieceEncoder:
    """One encoder, with its memo, per Python worker and tokenizer file."""
    return PieceEncoder(path, max_memo)
