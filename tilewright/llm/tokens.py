"""Token ids of whole texts from a public tokenizer file.

The word tokenizer cuts at white space and between letters, digits and marks before it merges. So texts are cut in
numpy, each piece is merged once by the tokenizers library and looked up by its 64-bit hash afterwards; the ids are
those of encoding the whole text. Words with other letters than ASCII and Latin-1, quotes or special tokens are encoded
as a whole. A tokenizer of another shape encodes whole texts.
"""

from __future__ import annotations

import json

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from tilewright.llm.words import LOWER, prefix_sums, span_hash, word_spans

DEFAULT_FILE = "word_bpe_49k.json"
END_ID = 2
REMEMBERED = 2_000_000  # pieces a worker remembers; beyond that it starts anew
# Fixed value: where the word tokenizer cuts.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Each byte of UTF-8 as the letter that byte-level tokenizers write for it.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
del _BYTE_LETTERS[32]
_MARK, _LETTER, _DIGIT, _ODD = 1, 2, 3, 4
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _MARK
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _ODD
_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def pieces_of(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes in small letters, and start, end and kind of each piece, with the number of pieces before each row."""
    kind, low = _KIND[data], LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    tail = data[lead + 1]
    letter = (tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)
    lead, tail = lead[letter], tail[letter]
    kind[lead] = kind[lead + 1] = _LETTER
    capital = tail < 0x9F
    low[lead[capital] + 1] += 0x20
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    kind[special] = _ODD
    starts, ends, _ = word_spans(data, where)
    odd_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == _ODD, out=odd_before[1:])
    for word in np.flatnonzero(odd_before[ends] - odd_before[starts]):
        span = slice(starts[word], ends[word])
        kind[span], low[span] = _ODD, data[span]
    within = np.zeros(len(data), bool)
    if len(starts):
        within = np.repeat(np.tile(np.array([False, True]), len(starts) + 1)[:-1],
                           np.diff(np.column_stack([starts, ends]).ravel(), prepend=0, append=len(data)))
    new = np.zeros(len(data), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new[starts] = True
    begin = np.flatnonzero(new & within)
    stop = np.empty_like(begin)
    if len(begin):
        stop[:-1], stop[-1] = begin[1:], len(data)
        word = np.searchsorted(starts, begin, "right") - 1
        stop = np.minimum(stop, ends[word])
    return low, begin, stop, kind[begin], np.searchsorted(begin, where)


class Encoder:
    """Encodes chunks of text to unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        cuts = [p.get("pattern", {}).get("Regex") for p in (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_piece = _PIECES in cuts
        # The merges alone, for pieces that are in small letters and written in the tokenizer's byte letters already.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # ascending
        self.at = np.zeros(0, np.int64)  # where the ids of each begin
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def merged(self, pieces: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of pieces, one after the other, and how many each has."""
        ids, counts = [], []
        for at in range(0, len(pieces), 1000):
            spelled = b" ".join(pieces[at:at + 1000]).decode("latin-1")
            if not spelled.isascii():
                spelled = spelled.translate(_BYTE_LETTERS)
            found = self.merges.encode(spelled, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.array(found.word_ids), minlength=len(pieces[at:at + 1000])))
        return ids, np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def learn(self, hashes: np.ndarray, spelled: list[bytes], odd: np.ndarray) -> None:
        """Remember new pieces; ``hashes`` ascend."""
        ascii_only = np.array([s.isascii() for s in spelled], bool)
        plain = np.concatenate([np.flatnonzero(~odd & ascii_only), np.flatnonzero(~odd & ~ascii_only)])
        ids, counts = self.merged([spelled[i] for i in plain.tolist()])
        count = np.zeros(len(hashes), np.int64)
        count[plain] = counts
        for place in np.flatnonzero(odd).tolist():
            ids.append(self.whole(spelled[place].decode()))
            count[place] = len(ids[-1])
        order = np.concatenate([plain, np.flatnonzero(odd)])
        at = np.empty(len(hashes), np.int64)
        at[order] = np.cumsum(count[order]) - count[order] + len(self.ids)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at)
        self.count, self.ids = np.insert(self.count, place, count), np.concatenate([self.ids, *ids])

    def encode(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk, and how many stand before each row (and after the last)."""
        if not self.by_piece:
            found = [self.whole(data[a:b].tobytes().decode()) for a, b in zip(where[:-1], where[1:], strict=True)]
            return (np.concatenate([np.zeros(0, np.uint32), *found]),
                    np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64))
        low, begin, stop, kind, first = pieces_of(data, where)
        hashes = span_hash(prefix_sums(low), begin, stop)
        distinct, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inner = place < len(self.hashes)
        known[inner] = self.hashes[place[inner]] == distinct[inner]
        if not known.all():
            new = sample[~known]
            raw = low.tobytes()
            spelled = [raw[a:b] for a, b in zip(begin[new].tolist(), stop[new].tolist(), strict=True)]
            self.learn(distinct[~known], spelled, kind[new] == _ODD)
            place = np.searchsorted(self.hashes, distinct)
        place = place[which]
        count = self.count[place]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.at[place] - ends + count, count) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[first]


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
