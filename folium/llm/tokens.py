"""Token ids of whole texts by a byte-level BPE tokenizer file.

The byte-level pattern starts a new pre-token at every space that stands before
a visible character. A text may therefore be cut there and its pieces encoded
apart without changing an id. A batch of texts is cut and its distinct pieces are
numbered by Arrow; the distinct pre-tokens of these are encoded by the library, many
a call, or come from a bounded cache; the ids of all texts are then gathered by numpy.
Texts where a cut would change something (runs of spaces, the tokenizer's added
tokens) go to the library as they are.
"""

from __future__ import annotations

import os
import re
import struct
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens in one of the two generations of a worker's cache; one batch may add as many again.
CACHE_SIZE = 300_000
#: Ids gathered at a time; characters of one call to the library for texts that go there whole, pre-tokens of one call.
IDS_AT_ONCE, CALL_CHARACTERS, CALL_PRE_TOKENS = 1 << 20, 1 << 16, 64

#: How byte-level vocabularies write a space; the letters, numbers and white space below U+0250, and the pre-tokens they form.
SPACE, LATIN_END = "Ġ", "ɐ"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

_VISIBLE = r"\x00-\x08\x0e-\x1b!-\x84\x86-\x9f\xa1-\x{24f}"
_LATIN_PIECE = rf"\A[{_VISIBLE}](?:[\x00-\x{{24f}}]*[{_VISIBLE}])?\z"
_BOUNDARY = re.compile(r"(?= \S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts, equal to encode(text, add_special_tokens=False) of the library."""

    def __init__(self, path: str, cache_size: int = CACHE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = not any(c.isspace() for c in "".join(self.added))
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that open with a space
        self.opens[[i for token, i in vocabulary.items() if token[0] == SPACE]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = cache_size

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> bytes:
        """Ids of any text, from the library in calls of bounded length."""
        calls, held, size = [], [], 0
        for part in _BOUNDARY.split(text) if self.cut else [text]:
            held.append(part)
            size += len(part)
            if size >= CALL_CHARACTERS:
                calls.append("".join(held))
                held, size = [], 0
        return b"".join(np.array(self._ids([call])[0], "<u4").tobytes() for call in [*calls, "".join(held)])

    def release(self) -> None:
        """Give the cache's memory back, for workers that other stages use next."""
        self.known, self.older = {}, {}

    def _looked_up(self, pre_tokens: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens."""
        young, old = self.known.get, self.older.get
        found = [young(p) or old(p) for p in pre_tokens]
        missing = [i for i, ids in enumerate(found) if ids is None]
        spaced = [i for i in missing if pre_tokens[i][0] == " " and pre_tokens[i] != " "]
        for at in range(0, len(spaced), CALL_PRE_TOKENS):
            # each opens with a space and no other space stands in it, so one call takes many
            part = spaced[at : at + CALL_PRE_TOKENS]
            ids = np.array(self._ids(["".join([pre_tokens[i] for i in part])])[0], "<u4")
            starts = np.flatnonzero(self.opens[ids]).tolist()
            raw = ids.tobytes()
            for i, a, b in zip(part, starts, [*starts[1:], len(ids)], strict=True):
                found[i] = raw[4 * a : 4 * b]
        others = [i for i in missing if found[i] is None]
        for i, ids in zip(others, self._ids([pre_tokens[i] for i in others]) if others else (), strict=True):
            found[i] = np.array(ids, "<u4").tobytes()
        if len(self.known) >= self.limit:
            self.known, self.older = {}, self.known
        self.known.update(islice(zip(pre_tokens, found, strict=True), self.limit))
        return found

    def encode_batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i, with the end id after them, are ids[offsets[i]:offsets[i + 1]]; null texts are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        parts = pc.split_pattern(texts, " ")
        counts = np.diff(parts.offsets.to_numpy())
        firsts = np.cumsum(counts) - counts
        numbered = parts.flatten().dictionary_encode()
        codes, distinct = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary
        heads = distinct.take(pa.array(codes[firsts])).to_pylist()
        # a piece can be taken alone, with the space before it, if it has visible characters at both ends
        latin = pc.match_substring_regex(distinct, _LATIN_PIECE).to_numpy(zero_copy_only=False)
        alone = latin.copy()
        others = np.flatnonzero(~latin)
        names = distinct.take(pa.array(others)).to_pylist()
        alone[others] = [bool(p) and not p[0].isspace() and not p[-1].isspace() for p in names]
        bad = ~alone[codes]
        for i in np.flatnonzero(bad[firsts]).tolist():
            bad[firsts[i]] = bool(heads[i]) and counts[i] > 1
        whole = np.zeros(n, bool)
        whole[np.repeat(np.arange(n), counts)[bad]] = True
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        # one pass finds the pre-tokens of all Latin pieces; each piece's first one opens with a space
        alike = np.flatnonzero(latin)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(alike)], pa.int32()), distinct.take(pa.array(alike))), pa.scalar(" ", pa.large_string()))[0].as_py()
        found = _PRE_TOKEN.findall(f" {joined}") if len(alike) else []
        # first pieces have no space before them
        opened = [[] if w else _PRE_TOKEN.findall(h) if h.isascii() or max(h) < LATIN_END else [h] for h, w in zip(heads, whole.tolist(), strict=True)]
        number = {p: i for i, p in enumerate(dict.fromkeys(chain(found, *opened)))}
        table = self._looked_up(list(number))
        pre_codes = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        sizes, starts = np.zeros((2, len(distinct) + n + 1), np.int64)
        starts[alike] = np.flatnonzero(np.array([p[0] == " " for p in number], bool)[pre_codes])
        sizes[alike] = np.diff(np.r_[starts[alike], len(pre_codes)])
        # entries of their own: pieces in other scripts, first pieces, texts that go whole, the end id
        own = [(int(i), f" {p}") for i, p in zip(others, names, strict=True) if alone[i]]
        entries = [np.array(ids, "<u4").tobytes() for ids in self._ids([p for _, p in own])] if own else []
        entries += [self._whole(texts[i].as_py()) if w else b"".join([table[number[p]] for p in o]) for i, (o, w) in enumerate(zip(opened, whole.tolist(), strict=True))]
        at = np.r_[np.array([i for i, _ in own], np.int64), len(distinct) + np.arange(n), len(sizes) - 1]
        starts[at], sizes[at] = len(pre_codes) + np.arange(len(at)), 1
        pre_codes = np.r_[pre_codes, len(table) + np.arange(len(at))]
        table += [*entries, b"" if end is None else struct.pack("<I", end)]
        codes[firsts] = len(distinct) + np.arange(n)
        if whole.any():
            kept = ~np.repeat(whole, counts)
            kept[firsts] = True
            codes, counts = codes[kept], np.where(whole, 1, counts)
        if end is not None:
            codes = np.insert(codes, np.cumsum(counts), len(sizes) - 1)
            counts = counts + 1
        per = gathered(pre_codes, starts, sizes, codes)
        widths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids = gathered(np.frombuffer(b"".join(table), "<u4"), np.cumsum(widths) - widths, widths, per)
        upto = np.r_[0, np.cumsum(widths[per])]  # ids before each pre-token
        return ids, upto[np.r_[0, np.cumsum(sizes[codes])][np.r_[0, np.cumsum(counts)]]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The same as little-endian unsigned 32-bit bytes, text by text."""
        ids, offsets = self.encode_batch(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs flat[starts[c]:starts[c] + sizes[c]] of all codes c, one after another."""
    after = np.cumsum(sizes[codes])
    out = np.empty(int(after[-1]) if len(after) else 0, flat.dtype)
    at = 0
    while at < len(codes):
        base = int(after[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(after, base + IDS_AT_ONCE, "right")))
        c = codes[at:to]
        n = sizes[c]
        total = int(n.sum())
        out[base : base + total] = flat[np.repeat(starts[c] - (after[at:to] - n - base), n) + np.arange(total)]
        at = to
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
