"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges of a sentencepiece model of the merge type are taken from an agenda, best
score first. A candidate whose keyed hash falls under the dropout rate is
skipped, so one text has many segmentations, fixed by seed, document and
place in the text, and all decode to the text. With a rate of zero the ids are the model's own.

A text is cut into runs where no piece of the model reaches over the cut, which is
checked when the model is loaded. Runs of one length are worked on side by side in
numpy: each step takes the first of every run's agenda, skips it or merges its two
neighbours, and looks up the new candidates in a table of all pairs. No two
occurrences share a draw and nothing is cached. Very long runs have a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.common import batch_columns, bounded_batches
from folium.llm.tokens import gathered

#: The share of candidate merges that is skipped, and the seed.
RATE, SEED = 0.1, 42
#: Symbols beyond which a run has a heap of its own; runs and characters worked on at a time.
SHORT, RUNS_AT_ONCE, CHARACTERS_AT_ONCE = 48, 8192, 1 << 20
#: How the model writes a space; factors of the hash.
SPACE = "▁"
_RANK, _PLACE, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_CODE_POINTS = 0x110000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's merges. A symbol is a piece's rank by score, or, from `none` on, a character that is no piece."""

    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        order = {p: r for r, p in enumerate(sorted(ids, key=lambda p: (-model.get_score(ids[p]), ids[p])))}
        self.none, self.seed, self.limit = len(order), seed, np.uint64(min(int(rate * 2**64), 2**64 - 1))
        self.id_of = np.array([ids[p] for p in order], "<u4")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        # what an id stands for; marks inside a piece become spaces
        self.surface = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.symbol = np.arange(_CODE_POINTS, dtype=np.int64) + self.none
        for p, r in order.items():
            if len(p) == 1:
                self.symbol[ord(p)] = r
        self.symbol[32], self.symbol[ord(SPACE)] = self.symbol[ord(SPACE)], ord(SPACE) + self.none  # a mark of the text itself is no space
        self.kind = np.full(_CODE_POINTS, _OTHER, np.uint8)
        self.kind[[c for c in range(_CODE_POINTS) if chr(c).isalpha()]] = _LETTER
        self.kind[[c for c in range(_CODE_POINTS) if chr(c).isdecimal()]] = _DIGIT
        self.kind[32] = _BLANK
        inside = [np.frombuffer(p.replace(SPACE, " ").encode("utf-32-le"), "<u4") for p in order]
        self.fine = not any(self._opens(p, True)[1:].any() for p in inside)
        if not self.fine and any(self._opens(p, False)[1:].any() for p in inside):
            raise ValueError("pieces of this model reach over the spaces between words")
        self._index({(order[p[:i]], order[p[i:]]): r for p, r in order.items() for i in range(1, len(p)) if p[:i] in order and p[i:] in order})

    def _opens(self, points: np.ndarray, fine: bool) -> np.ndarray:
        """Whether a run starts at a character: spaces belong to what follows; then letters, single digits and all else lie apart."""
        kind = self.kind[points]
        before = np.r_[kind[:1], kind[:-1]]
        change = (kind != before) | (kind == _DIGIT) if fine else kind == _BLANK
        opens = (before != _BLANK) & change
        opens[:1] = True
        return opens

    def _index(self, pairs: dict[tuple[int, int], int]) -> None:
        """An open-addressed table of the ranks of all pairs that merge."""
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.none, np.int32)
        left = np.array([(a << 21) | b for a, b in pairs], np.int64)
        rank = np.array(list(pairs.values()), np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = left[free]  # of several at one slot the last stays
            kept = self.keys[slot] == left
            self.ranks[slot[kept]] = rank[kept]
            left, rank, slot = left[~kept], rank[~kept], (slot[~kept] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _RANK) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs of symbols merge to, `none` where they don't."""
        keys = (left << 21) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        rank = np.where(found == keys, self.ranks[slot], np.int32(self.none))
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            rank[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return rank

    def _skipped(self, key: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the candidates of these ranks at these places of their texts are skipped."""
        h = (key ^ (rank.astype(np.uint64) * _RANK + place.astype(np.uint64) * _PLACE)) * _MIX
        return (h ^ (h >> np.uint64(32))) * _MIX < self.limit

    def _merge(self, symbols: np.ndarray, opens: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Merge the symbols of all runs in place; returns which of them stay."""
        starts = np.flatnonzero(opens)
        sizes = np.diff(np.r_[starts, len(symbols)])
        stay = np.ones(len(symbols), bool)
        rank = np.r_[self._pairs(symbols[:-1], symbols[1:]), np.int32(self.none)]
        rank[np.r_[starts[1:], len(symbols)] - 1] = self.none
        # runs without a candidate are done
        busy = np.minimum.reduceat(rank, starts) < self.none if len(starts) else np.zeros(0, bool)
        for size in np.unique(sizes[busy]).tolist():
            of = starts[busy & (sizes == size)]
            if size > SHORT:
                for at in of.tolist():
                    self._merge_long(symbols[at : at + size], stay[at : at + size], key[at], place[at])
                continue
            for i in range(0, len(of), RUNS_AT_ONCE):
                self._merge_alike(of[i : i + RUNS_AT_ONCE], size, symbols, stay, rank, key, place)
        return stay

    def _merge_alike(self, starts: np.ndarray, size: int, symbols: np.ndarray, stay: np.ndarray, ranks: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        """Runs of one size; a row has a column for each symbol, and one on either side that merges with nothing."""
        columns = starts[:, None] + np.arange(size)
        wide = size + 2
        held = np.full((len(starts), wide), self.none + _CODE_POINTS, np.int64)
        held[:, 1:-1] = symbols[columns]
        rank = np.full((len(starts), wide), self.none, np.int32)
        rank[:, 1:-1] = ranks[columns]
        before, after = (np.tile(np.arange(wide, dtype=np.int64) + step, (len(starts), 1)).ravel() for step in (-1, 1))
        flat, flat_rank = held.ravel(), rank.ravel()
        gone = np.zeros(flat.shape, bool)
        rows = np.arange(len(starts))
        while len(rows):
            at = rank[rows].argmin(axis=1)
            cell = rows * wide + at
            best = flat_rank[cell]
            live = best < self.none
            rows, at, cell, best = rows[live], at[live], cell[live], best[live]
            flat_rank[cell] = self.none
            first = starts[rows]
            taken = ~self._skipped(key[first], best, place[first] + at - 1)
            base, cell, best = (rows * wide)[taken], cell[taken], best[taken]
            right = base + after[cell]
            beyond, left = base + after[right], base + before[cell]
            gone[right], flat_rank[right] = True, self.none
            after[cell], before[beyond] = beyond - base, cell - base
            flat[cell] = best
            flat_rank[cell] = self._pairs(flat[cell], flat[beyond])
            flat_rank[left] = self._pairs(flat[left], flat[cell])
        symbols[columns] = held[:, 1:-1]
        stay[columns] = ~gone.reshape(-1, wide)[:, 1:-1]

    def _merge_long(self, symbols: np.ndarray, stay: np.ndarray, key: np.uint64, place: np.int64) -> None:
        """One run, its agenda a heap and its neighbours linked by place."""
        last = len(symbols)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        names, key = symbols.tolist(), np.array([key])
        agenda = [(r, i, a, b) for i, (r, a, b) in enumerate(zip(self._pairs(symbols[:-1], symbols[1:]).tolist(), names, names[1:], strict=False)) if r < self.none]
        heapq.heapify(agenda)
        while agenda:
            rank, left, a, b = heapq.heappop(agenda)
            right = after[left]
            if not stay[left] or right >= last or names[left] != a or names[right] != b:
                continue
            if self._skipped(key, np.array([rank]), np.array([place + left]))[0]:
                continue
            names[left], stay[right], after[left] = rank, False, after[right]
            new = [i for i in (before[left], left) if i >= 0 and after[i] < last]
            if after[right] < last:
                before[after[right]] = left
            for i, r in zip(new, self._pairs(np.array([names[i] for i in new], np.int64), np.array([names[after[i]] for i in new], np.int64)).tolist(), strict=True):
                if r < self.none:
                    heapq.heappush(agenda, (r, i, names[i], names[after[i]]))
        symbols[:] = names

    def encode_batch(self, texts: list[str], doc_ids: list[int | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; the empty text has none."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for at, part in _slices(f" {text}") if text else ():
                held.append((i, at, part))
                size += len(part)
                if size >= CHARACTERS_AT_ONCE:
                    self._encode_parts(held, doc_ids, out)
                    held, size = [], 0
        self._encode_parts(held, doc_ids, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _encode_parts(self, parts: list[tuple[int, int, str]], doc_ids: list[int | None], out: list[list[bytes]]) -> None:
        if not parts:
            return
        points = np.frombuffer("".join(p for _, _, p in parts).encode("utf-32-le"), "<u4")
        sizes = np.array([len(p) for _, _, p in parts])
        firsts = np.cumsum(sizes) - sizes
        opens = self._opens(points, self.fine)
        opens[firsts] = True
        key = np.repeat(np.array([xxhash.xxh64_intdigest(str(doc_ids[i]), self.seed) for i, _, _ in parts], np.uint64), sizes)
        place = np.arange(len(points)) + np.repeat(np.array([at for _, at, _ in parts]) - firsts, sizes)
        symbols = self.symbol[points]
        stay = self._merge(symbols, opens, key, place)
        left = symbols[stay]
        # a character that is no piece goes byte by byte
        odd = np.flatnonzero(left >= self.none)
        names, at = np.unique(left[odd], return_inverse=True)
        spelled = [np.array([self.bytes[b] for b in chr(c - self.none).encode()], "<u4") for c in names.tolist()]
        left[odd] = self.none + at
        widths = np.r_[np.ones(self.none, np.int64), np.array([len(x) for x in spelled], np.int64)]
        ids = gathered(np.concatenate([self.id_of, *spelled]), np.cumsum(widths) - widths, widths, left)
        upto = np.r_[0, np.cumsum(widths[left])][np.r_[0, np.cumsum(np.add.reduceat(stay.astype(np.int64), firsts))]]
        for (i, _, _), a, b in zip(parts, upto.tolist(), upto[1:].tolist(), strict=False):
            out[i].append(ids[a:b].tobytes())

    def encode(self, text: str, doc_id: int | None = None) -> bytes:
        return self.encode_batch([text], [doc_id])[0]

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        return b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")[1:]


def _slices(text: str) -> Iterator[tuple[int, str]]:
    """(place, part) of a text, cut before spaces after a visible character where it is long."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + CHARACTERS_AT_ONCE) if len(text) - at > CHARACTERS_AT_ONCE else None
        to = cut.start() if cut else len(text)
        yield at, text[at:to]
        at = to


_CUT = re.compile(r"(?<=[^ ]) ")
_PIECES: dict[tuple, Pieces] = {}


def pieces(*key) -> Pieces:
    """One for each Python worker and setting."""
    if key not in _PIECES:
        _PIECES[key] = Pieces(*key)
    return _PIECES[key]


def segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit integers. Null and empty texts have none. Another seed gives other segmentations."""
    return _each(docs, id_col, text_col, (model or default_model(), rate, seed), "ids binary", lambda p, ids, texts: [pa.array(ids, pa.binary())])


def segmentation_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: str | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, lossless): one row per row of docs.

    The ids are decoded again; lossless tells whether that gave the text. Null and
    empty texts have no ids. Rows of equal doc_id and text are segmented alike.
    """

    def of(p: Pieces, ids: list[bytes], texts: list[str]) -> list[pa.Array]:
        back = [p.decode(i) for i in ids]
        return [
            pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]), pa.array([b == t for b, t in zip(back, texts, strict=True)]),
        ]

    return _each(docs, id_col, text_col, (model or default_model(), rate, seed), "n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean", of)


def _each(docs: DataFrame, id_col: str, text_col: str, key: tuple, columns: str, of) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(*key)
        for batch in batches:
            doc_ids, texts = batch_columns(batch, "doc_id", "text")
            texts = [t or "" for t in texts]
            ids = p.encode_batch(texts, doc_ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), *of(p, ids, texts)], names)

    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return ready.mapInArrow(run, f"doc_id long, {columns}")
