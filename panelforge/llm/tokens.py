"""Token ids of whole texts by the tokenizers library, each distinct piece of a text encoded once while it is remembered."""

from __future__ import annotations

import os
import re

import numpy as np

from panelforge.llm.windows import BYTE_HASH, WordUnits, mix

#: White space, control and format characters: at such an end of a piece the library might not start anew.
BAD = r"\s\x00-\x20\x7f-\xa0\u180e\u200b\ufeff"
SURE = re.compile(rf"[^{BAD}](?:.*[^{BAD}])?", re.DOTALL)
CHECK_HASH = mix(BYTE_HASH)
CACHE_PIECES = 1_500_000
LEARN_AT_ONCE = 20_000
LONGEST_PIECE = 200
GROUP_BYTES = 1 << 20


class Encoder:
    """encode(texts) gives arrays of ids, as Tokenizer.encode(text, add_special_tokens=False) does.

    The pre-tokenizer of byte-level BPE starts a new piece at a space between two characters that are not white space, so texts
    are cut there. Pieces are told apart by two 64-bit hashes and looked up in a sorted table; new ones are encoded together and
    told apart by the space that their first token starts with. A text with any other space, a special token or a very
    long piece goes to the library whole. Of more than CACHE_PIECES pieces the later half is dropped, so memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.spaced = np.zeros(size, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.cuts = bool(self.spaced.any()) and not any(" " in s for s in special)
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # of known pieces, sorted by key
        self.number = np.zeros(0, np.int32)  # their places in the table of ids
        self.flat, self.stop = np.zeros(0, self.type), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def sure(self, piece: str) -> bool:
        return len(piece) <= LONGEST_PIECE and SURE.fullmatch(piece) is not None and self.special.search(piece) is None

    def learn(self, key: np.ndarray, check: np.ndarray, pieces: list[bytes]) -> bool:
        """Adds new pieces, whose keys ascend; those that can't be cut out are not added. Tells whether known ones were dropped."""
        line = b" ".join(pieces).decode("utf-8", "replace")  # pieces hold no space
        texts = line.split(" ")
        plain = self.special.search(line) is None
        good = [i for i, t in enumerate(texts) if (plain and 0 < len(t) <= LONGEST_PIECE and t.isascii() and t.isprintable()) or self.sure(t)]
        full = len(self.number) + len(good) > CACHE_PIECES
        if full:
            n = CACHE_PIECES // 2
            old = self.number < n
            self.key, self.check, self.number = self.key[old], self.check[old], self.number[old]
            self.stop = self.stop[: n + 1]
            self.flat = self.flat[: self.stop[-1]]
        parts, stops = [self.flat], [self.stop]
        for a in range(0, len(good), LEARN_AT_ONCE):
            new = [texts[i] for i in good[a : a + LEARN_AT_ONCE]]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(new)], add_special_tokens=False)[0].ids, self.type)
            stop = np.append(np.flatnonzero(self.spaced[ids])[1:], len(ids))
            if len(stop) != len(new):
                own = [self.whole(" " + p) for p in new]
                ids, stop = np.concatenate(own), np.cumsum([len(p) for p in own])
            parts.append(ids)
            stops.append(stops[-1][-1] + stop)
        first = len(self.stop) - 1
        self.flat, self.stop = np.concatenate(parts), np.concatenate(stops)
        place = np.searchsorted(self.key, key[good], "right") + np.arange(len(good))  # the sorted table is merged, not sorted again
        rest = np.ones(len(self.key) + len(good), bool)
        rest[place] = False

        def merged(old: np.ndarray, new: np.ndarray) -> np.ndarray:
            out = np.empty(len(rest), old.dtype)
            out[place], out[rest] = new, old
            return out

        self.number = merged(self.number, np.arange(first, first + len(good), dtype=np.int32))
        self.key, self.check = merged(self.key, key[good]), merged(self.check, check[good])
        return full

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 where unknown; key ascends."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.check[at] == check), self.number[at], -1)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        if not self.cuts:
            return [self.whole(t or "") for t in texts]
        out, a, size = [], 0, 0
        for i, data in enumerate(raw, 1):
            size += len(data)
            if size >= GROUP_BYTES or i == len(raw):
                out += self.group(texts[a:i], raw[a:i])
                a, size = i, 0
        return out

    def group(self, texts: list[str | None], raw: list[bytes]) -> list[np.ndarray]:
        data = b" ".join(raw)
        codes = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(codes == 32)
        begin, end = np.append(0, space + 1), np.append(space, len(codes))
        origin = np.cumsum([0, *(len(r) + 1 for r in raw)])  # where each text starts
        first = np.searchsorted(begin, origin[:-1])
        after = np.append(first[1:], len(begin))
        key, check = WordUnits.hash_words(codes, begin, end), WordUnits.hash_words(codes, begin, end, CHECK_HASH)
        order = np.argsort(key)
        lead = np.append(True, key[order[1:]] != key[order[:-1]])
        distinct = order[lead]
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(lead) - 1
        number = self.find(key[distinct], check[distinct])
        new = distinct[number < 0]
        if len(new):
            dropped = self.learn(key[new], check[new], [data[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            if dropped:
                number = self.find(key[distinct], check[distinct])
            else:
                number[number < 0] = self.find(key[new], check[new])
        number = number[group]
        number[check != check[distinct][group]] = -1
        unknown = number < 0
        unknown[first] = False
        unknown[first] |= begin[first] == end[first]
        bad = np.append(0, np.cumsum(unknown))
        number[unknown] = 0
        number[first] = 0
        if not len(self.flat):
            return [self.whole(t or "") for t in texts]
        size = self.stop[number + 1] - self.stop[number]
        size[unknown] = 0
        size[first] = 0
        stop = np.cumsum(size)
        ids = self.flat[np.arange(stop[-1]) + np.repeat(self.stop[number] - (stop - size), size)]
        total = np.append(0, stop)
        out = []
        for text, a, b in zip(texts, first.tolist(), after.tolist(), strict=True):
            lead_text = data[begin[a] : end[a]].decode("utf-8", "replace")
            if not text:
                out.append(np.zeros(0, self.type))
            elif b - a == 1 or bad[b] > bad[a] or not self.sure(lead_text):
                out.append(self.whole(text))
            else:
                out.append(np.concatenate([self.whole(lead_text), ids[total[a] : total[b]]]))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
