"""Byte-level BPE token ids, identical to the ``tokenizers`` library's, in less time.

The library's result for a text is the concatenation of its results for the pre-tokens that
its splitting pattern finds, and prose repeats its words.  ``CachedEncoder`` therefore splits a
text itself, asks the library's model only for pre-tokens that it has not met, and joins ids.
It does so only for texts made of characters whose Unicode classes no version disputes; all
other texts, and those that hold the string of an added token, go to the library whole.

``encode_all`` does the same for many texts at once, in arrays: their pre-tokens are the runs of byte classes, those of at most 16 bytes
are two integers (compared in full; a safe text has no zero byte), looked up in a table of fixed size, and those that it hasn't are
merged together by the model's rules.  A model with options of its own is asked text by text.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
SAFE = re.compile(f"[\t\n\r\x20-\x7e{LETTERS[6:]}–—‘’“”…]*")
SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t\n\r 0-9{LETTERS}]+"
    "|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)
#: Characters of a string that is remembered.
LONGEST = 64
#: Where none of these stands, every space starts a new run of pre-tokens.
SPACED = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")

#: Characters of texts that are encoded together, strings that are merged together, and strings of the table.
TOGETHER, ROWS, SLOTS = 1 << 20, 4096, 1 << 19
SPACE, BLANK, LETTER, DIGIT, OTHER = 1, 2, 3, 4, 5
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[0], _CLASS[32] = 0, SPACE
_CLASS[[9, 10, 13]] = BLANK
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = LETTER  # first bytes of À to ſ
_CLASS[48:58] = DIGIT
#: The first n of eight bytes of a little-endian integer.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def byte_characters() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte (fixed values of the format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def starts(data: np.ndarray) -> np.ndarray:
    """Where SPLIT's matches start in safe texts as UTF-8 bytes; a zero byte stands before, between and behind the texts and is a match."""
    kind = _CLASS[data]
    kind[1:][(data[:-1] >= 0xC3) & (data[:-1] <= 0xC5)] = LETTER
    blank, before = (kind == SPACE) | (kind == BLANK), np.append(np.uint8(0), kind[:-1])
    start = (kind != before) & (before != SPACE) & ~blank
    start[1:] |= blank[1:] & ~blank[:-1]
    start[:-1] |= blank[:-1] & (kind[1:] > BLANK)  # the last of several blanks is a match, or begins one
    start |= kind == 0
    short = np.flatnonzero(start & (data == ord("'")))
    short = short[kind[short + 1] == LETTER]
    one, two = data[short + 1], data[np.minimum(short + 2, len(data) - 1)]
    is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    is_one = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    start[short[is_one | is_two] + 1] = False
    start[short[is_one] + 2] = True
    start[short[is_two] + 3] = True
    return np.flatnonzero(start)


class Merges:
    """Byte-pair merges of many short strings at once: in every round each string merges its pair of least rank, the first such pair."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.none = len(pairs)
        left, right = (np.array([vocabulary[p[side]] for p in pairs], dtype=np.int64) for side in (0, 1))
        self.new = np.array([vocabulary["".join(p)] for p in pairs], dtype=np.int32)
        self.first = np.array([vocabulary[c] for _, c in sorted(byte_characters().items())], dtype=np.int32)
        # Merges by hash: ``head`` of a place, then ``next``; a pair that is listed twice has its last rank.
        self.key = np.append((left << 32) | right, -1)
        self.head, self.next = np.full(1 << 18, self.none, dtype=np.int32), np.full(self.none + 1, self.none, dtype=np.int32)
        for rank, at in enumerate(self._place(self.key[:-1]).tolist()):
            self.next[rank], self.head[at] = self.head[at], rank
        self.start = self._rank(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)

    @staticmethod
    def _place(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``none`` for those that don't merge; a negative id is no token."""
        key = (left.astype(np.int64) << 32) | right
        rank = self.head[self._place(key)]
        rank[(left < 0) | (right < 0)] = self.none
        wrong = np.flatnonzero((self.key[rank] != key) & (rank != self.none))
        while len(wrong):
            rank[wrong] = self.next[rank[wrong]]
            wrong = wrong[(self.key[rank[wrong]] != key[wrong]) & (rank[wrong] != self.none)]
        return rank

    def merge(self, byte: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row of ids for each row of ``size`` bytes, filled up with -1."""
        width = byte.shape[1]
        column = np.arange(width)
        token = np.where(column < size[:, None], self.first[byte], np.int32(-1))
        rank = np.full(token.shape, self.none, dtype=np.int32)  # of a token and the next; the last column stays
        rank[:, :-1] = np.where(column[1:] < size[:, None], self.start[byte[:, :-1], byte[:, 1:]], np.int32(self.none))
        done, live = np.full(token.shape, -1, dtype=np.int32), np.arange(len(size))
        while len(live):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), at]
            going = best < self.none
            if not going.all():
                done[live[~going]] = token[~going]
                token, rank, live, at, best = token[going], rank[going], live[going], at[going], best[going]
            row, new = np.arange(len(live)), self.new[best]
            after = column[:-1] > at[:, None]
            for kept, last in ((token, -1), (rank, self.none)):
                np.copyto(kept[:, :-1], kept[:, 1:].copy(), where=after)
                kept[:, -1] = last
            token[row, at] = new
            rank[row, at] = self._rank(new, token[row, at + 1])
            some = at > 0
            row, at = row[some], at[some] - 1
            rank[row, at] = self._rank(token[row, at], new[some])
        return done


class Table:
    """Ids of strings of 1 to 16 bytes, given as two integers: remembered in a table of fixed size, merged otherwise."""

    def __init__(self, merges: Merges, slots: int):
        self.merges, self.slots = merges, slots
        kind = np.uint16 if merges.new.max(initial=0) < 65536 and merges.first.max() < 65536 else np.uint32
        self.low, self.high = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint64)
        self.ids, self.size = np.zeros((slots, 16), dtype=kind), np.zeros(slots, dtype=np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids and how many of each are in use."""
        slot = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = ((slot ^ slot >> np.uint64(29)) * np.uint64(0x165667B19E3779F9) >> np.uint64(32)).astype(np.int64) % self.slots
        ids, size = self.ids[slot], self.size[slot]
        new = np.flatnonzero((self.low[slot] != low) | (self.high[slot] != high))
        if len(new):
            new = new[np.lexsort((high[new], low[new], length[new]))]
            first = np.append(True, (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1]))
            one = new[first]
            byte = np.stack([low[one], high[one]], axis=1).astype("<u8").view(np.uint8)
            made = np.full((len(one), 16), -1, dtype=np.int32)
            for at in range(0, len(one), ROWS):
                own = slice(at, at + ROWS)
                width = int(length[one[own]].max())
                made[own, :width] = self.merges.merge(byte[own, :width], length[one[own]])
            many, which = (made >= 0).sum(axis=1), np.cumsum(first) - 1
            ids[new], size[new] = made[which], many[which]
            self.low[slot[one]], self.high[slot[one]], self.ids[slot[one]], self.size[slot[one]] = low[one], high[one], ids[one], size[one]
        return ids, size


class CachedEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    At most ``entries`` strings of at most ``LONGEST`` characters are remembered, whichever way a text takes;
    besides, ``encode_all`` has a table of ``slots`` strings.
    """

    def __init__(self, path: str, entries: int = 100_000, slots: int = SLOTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.shown = byte_characters()
        self.entries = entries
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        plain = model.get("type") == "BPE" and not any(model.get(o) for o in options) and set(self.shown.values()) <= set(model["vocab"])
        self.table = Table(Merges(model["vocab"], model["merges"]), slots) if plain else None

    def library(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype="<u4").tobytes()

    def _remember(self, string: str, ids: bytes) -> bytes:
        if len(string) <= LONGEST:
            if len(self.known) >= self.entries:
                self.known.clear()
            self.known[string] = ids
        return ids

    def _run(self, run: str) -> bytes:
        """Ids of what lies between two spaces, with the space before it."""
        known, packed, out = self.known, self.packed, []
        for piece in SPLIT.findall(run):
            ids = known.get(piece)
            if ids is None:
                word = piece.encode("utf-8").decode("latin-1").translate(self.shown)
                ids = self._remember(piece, b"".join([packed[t.id] for t in self.model.tokenize(word)]))
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """A null text has no ids."""
        if not text:
            return b""
        if not SAFE.fullmatch(text) or any(a in text for a in self.added):
            return self.library(text)
        if any(x in text for x in SPACED):
            return self._run(text)
        known = self.known
        first, *rest = text.split(" ")
        out = [self._run(first)]
        for word in rest:
            run = " " + word
            ids = known.get(run)
            if ids is None:
                ids = self._remember(run, self._run(run))
            out.append(ids)
        return b"".join(out)

    def _lot(self, texts: list[str | None]) -> Iterator[bytes]:
        safe = [bool(t) and SAFE.fullmatch(t) is not None and not any(a in t for a in self.added) for t in texts]
        data = np.frombuffer(b"\0".join([b"", *(t.encode("utf-8") for t, s in zip(texts, safe) if s), bytes(16)]), dtype=np.uint8)
        edge = starts(data[:-15])
        length, edge = np.diff(edge), edge[:-1]
        text = data[edge] != 0
        document, length, edge = np.cumsum(~text)[text] - 1, length[text], edge[text]
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        short = np.flatnonzero(length <= 16)
        size = np.zeros(len(edge), dtype=np.int64)
        at, own = edge[short], length[short]
        rows, size[short] = self.table.find(eight[at] & _FIRST[np.minimum(own, 8)], eight[at + 8] & _FIRST[np.maximum(own - 8, 0)], own)
        long = {int(i): self._run(data[edge[i] : edge[i] + length[i]].tobytes().decode("utf-8")) for i in np.flatnonzero(length > 16)}
        for i, ids in long.items():
            size[i] = len(ids) // 4
        end = np.cumsum(size)
        flat = np.empty(int(size.sum()), dtype="<u4")
        held = np.repeat(length <= 16, size)
        flat[held] = rows[np.arange(16) < size[short][:, None]]
        for i, ids in long.items():
            flat[end[i] - size[i] : end[i]] = np.frombuffer(ids, dtype="<u4")
        cuts = np.append(0, end)[np.searchsorted(document, np.arange(sum(safe) + 1))].tolist()
        parts = iter([flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])
        for t, s in zip(texts, safe):
            yield next(parts) if s else self.library(t) if t else b""

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, in order; texts are taken in lots of bounded size."""
        if self.table is None:
            yield from map(self.encode, texts)
            return
        lot, held = [], 0
        for text in texts:
            lot.append(text)
            held += len(text or "")
            if held >= TOGETHER or len(lot) >= ROWS:
                yield from self._lot(lot)
                lot, held = [], 0
        if lot:
            yield from self._lot(lot)


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """A worker that goes on to other work doesn't need its encoders any more."""
    _ENCODERS.clear()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
