"""Repeated word sequences by suffix automata of reference shards.

A reference shard holds distinct candidate segments of a hash bin (see windows.py), all those of its anchors. Its automaton has
bounded size and stays in the task that holds the same bin of the documents' segments, which stream through it: the matching
statistics give, at each word, the longest match and how often it occurs. Broadcasting each automaton to all documents instead
would cost shards times documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from panelforge.llm import windows


REFERENCE_BYTES = 64 << 10


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the number of places (counted with weights) where each state's strings end."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.last = 0

    def start(self) -> None:
        self.last = 0

    def add(self, symbol, weight: int) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        p, known = self.last, self.next[self.last].get(symbol)
        if known is not None:  # a sequence added before begins alike
            if length[known] == length[p] + 1:
                count[known] += weight
                self.last = known
                return
            clone = self._clone(known, p, symbol)
            count[clone] += weight
            self.last = clone
            return
        cur = len(length)
        nexts.append({})
        length.append(length[p] + 1)
        count.append(weight)
        link.append(0)
        while p != -1 and symbol not in nexts[p]:
            nexts[p][symbol] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][symbol]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(q, p, symbol)
        self.last = cur

    def _clone(self, q: int, p: int, symbol) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(length)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = clone
        while p != -1 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = clone
            p = link[p]
        return clone

    def close(self) -> SuffixAutomaton:
        """Adds each state's places to the states of its suffixes."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]
        return self

    def matching(self, symbols, W: int):
        """Matching statistics: at each word the length of the longest match, and the places of its last W words (0 if shorter)."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        v = n = 0
        for x in symbols:
            while v and x not in nexts[v]:
                v = link[v]
                n = length[v]
            if x in nexts[v]:
                v = nexts[v][x]
                n += 1
            if n >= W:
                u = v
                while length[link[u]] >= W:
                    u = link[u]
                yield n, count[u]
            else:
                yield n, 0


class RepeatedWords(windows.Plan):
    """Flags each word under a W-word window that starts anywhere else."""

    def __init__(self, *args, columns: pa.Schema | None = None, replaced: str = "text", **more):
        """columns: those of the rows to return instead of the digests, the text (`replaced`) cut."""
        super().__init__(*args, **more)
        self.columns, self.replaced = columns, replaced

    def weights(self, ids, places):
        return np.array([min(2, len(p)) for p in places], np.int64)

    def joined(self, weights):
        return min(2, sum(weights))

    def decide(self, table: pa.Table) -> pa.Table:
        groups: dict[int, dict[bytes, list]] = {}  # anchor -> content -> [weight, [(blob, number)]]
        shards = []
        for b, (shard, numbers, pieces, weight, anchor) in enumerate(self.received(table)):
            shards.append(shard)
            for piece, w, a, i in zip(pieces, weight.tolist(), anchor.tolist(), numbers.tolist(), strict=True):
                e = groups.setdefault(a, {}).setdefault(piece, [0, []])
                e[0] += w
                e[1].append((b, i, w))
        rows: list[list] = [[] for _ in shards]
        for held in self.references(groups):
            for content, runs in self.repeated(held):
                for b, i, w in held[content][1]:
                    if w < 2:  # else the shard knows itself
                        rows[b].extend((i, f, t) for f, t in runs)
        return windows.answers([(s, np.array(r, "<u4").tobytes()) for s, r in zip(shards, rows, strict=True) if r], 1)

    @staticmethod
    def references(groups):
        """The bin's reference shards: the segments of whole anchors, some REFERENCE_BYTES of them together."""
        held, size = {}, 0
        for contents in groups.values():
            held |= contents
            size += sum(map(len, contents))
            if size >= REFERENCE_BYTES:
                yield held
                held, size = {}, 0
        if held:
            yield held

    def repeated(self, held):
        """(content, runs of windows) of the segments that have windows at several places: streamed through the shard's automaton."""
        W, reference = self.W, SuffixAutomaton()
        words = {c: c.split(b" ") for c in held}
        for c, (w, _) in held.items():
            reference.start()
            for x in words[c]:
                reference.add(x, w)
        reference.close()
        for c in held:
            hits = [e - W + 1 for e, (n, places) in enumerate(reference.matching(words[c], W)) if n >= W and places > 1]
            if not hits:
                continue
            runs, first = [], hits[0]
            for x, y in zip(hits, [*hits[1:], None], strict=True):
                if y != x + 1:
                    runs.append((first, x + 1))
                    first = y
            yield c, runs

    def finish(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts, wanted, blobs = self.load(docs, replies)
        contents, anchors, places = self.candidates(ids, texts, wanted)
        said: dict[int, list] = {}
        for blob in blobs:
            for i, a, b in np.frombuffer(blob, "<u4").reshape(-1, 3).tolist():
                said.setdefault(i, []).append((a, b))
        spans: list[list] = [[] for _ in ids]
        W = self.W
        for i, where in enumerate(places):
            if len(where) > 1:
                for d, a, n in where:
                    spans[d].append((a, a + n - 1 + W))
            elif i in said:
                d, a, _ = where[0]
                spans[d].extend((a + x, a + y - 1 + W) for x, y in said[i])
        for number, where in enumerate(self.windows(contents, anchors).values(), len(contents)):
            if number in said or sum(len(places[i]) for i, _ in where) > 1:
                for i, j in where:
                    if len(places[i]) == 1:  # else the whole segment is
                        d, a, _ = places[i][0]
                        spans[d].append((a + j, a + j + W))
        out, cut = [], []
        for doc_id, text, null, mine in zip(ids, texts, self.nulls, spans, strict=True):
            words = text.split()
            kept, at, removed = [], 0, []
            for a, b in sorted(mine):
                if a > at:
                    kept += words[at:a]
                if b > at:
                    if removed and max(a, at) == removed[-1]:
                        removed[-1] = b
                    else:
                        removed += [a, b]
                    at = b
            kept += words[at:]
            body = b" ".join(kept)
            out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), removed))
            if self.columns:
                cut.append(None if null else self.cut(text, removed).decode())
        if self.columns:
            return self.rows(cut)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def rows(self, texts: list[str | None]) -> pa.Table:
        """The rows as they came but for the text."""
        others = dict(zip(self.others.type.names, self.others.flatten(), strict=True))
        return pa.table([(pa.array(texts, pa.string()) if f.name == self.replaced else others[f.name]).cast(f.type) for f in self.columns], schema=self.columns)

    @staticmethod
    def cut(text: bytes, removed: list[int]) -> bytes:
        """The text without the words of the removed runs, each up to the next word; what is kept stays as it is."""
        if not removed:
            return text
        start, _ = windows.WordUnits.bounds(np.frombuffer(text, np.uint8))
        start = np.append(start, len(text)).tolist()
        parts, at = [], 0
        for a, b in zip(removed[0::2], removed[1::2], strict=True):
            parts.append(text[at : start[a]])
            at = start[b]
        return b"".join([*parts, text[at:]])


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """Repeated sequences of `length` words, found over the whole corpus; every copy is removed.

    Words are runs of bytes other than space and 9 to 13, unchanged. Returns a row for each input row: doc_id, n_words,
    n_removed, kept_sha256 (of the kept words joined by a space) and removed (starts and ends of removed runs of words, flat).
    A null or empty text has no words. Rows with one id, or with none, are documents of their own. Extra columns are ignored.
    An empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<long>"
    return windows.run(docs, RepeatedWords, id_col, text_col, length, max(2, length // 4), schema, words=True)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35) -> DataFrame:
    """The rows with all their columns, repeated passages cut out of the text; a text that loses nothing stays as it is.

    The other columns travel with the text as Arrow data, so nothing is joined or altered. A null text stays null. Rows with
    one id, or with none, are documents of their own. Columns may have any names and types. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c != text_col]
    return windows.run(docs, RepeatedWords, id_col, text_col, length, max(2, length // 4), docs.schema, others=others, words=True, columns=to_arrow_schema(docs.schema), replaced=text_col)
