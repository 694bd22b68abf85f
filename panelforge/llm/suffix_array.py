"""Repeated byte strings by suffix arrays: Larsson-Sadakane refinement, Kasai prefixes, merging by binary search.

A shard here is a hash bin of candidate segments (see windows.py): equal 50-byte strings meet in one bin, so suffix arrays are
built over repeated text alone and never over pairs of shards. A bin is cut into blocks of at most BLOCK_BYTES; each block has
its own suffix array, and where one anchor's segments fill several blocks, a block's sorted strings are looked up in the
others' by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm import windows

BLOCK_BYTES = 1 << 18
NO_ID = np.iinfo(np.int64).max


def first_keys(text: np.ndarray) -> np.ndarray:
    """Seven bytes from each place as one number; places past the end count below any byte."""
    n = len(text)
    code = np.zeros(n + 6, np.int64)
    code[:n] = text
    code[:n] += 1
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | code[j : n + j]
    return key


def suffix_array(text: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of a byte array: groups of equal prefixes are refined at twice the depth until each holds one suffix."""
    n = len(text)
    key = first_keys(text) if key is None else key
    sa = np.argsort(key)
    in_order = key[sa]
    head = np.ones(n, bool)
    np.not_equal(in_order[1:], in_order[:-1], out=head[1:])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # of a group's first place, from 1; 0 is the end of the text
    rank[sa] = group + 1
    slots, depth = np.arange(n), 7
    while True:
        lone = head[slots] & np.append(head[slots[1:]] | (slots[1:] != slots[:-1] + 1), True)[: len(slots)]
        slots = slots[~lone]
        if not len(slots):
            return sa, rank[:n] - 1
        sub = sa[slots]
        wide = group[slots] * (n + 1) + rank[np.minimum(sub + depth, n)]
        order = np.argsort(wide)
        sub, wide = sub[order], wide[order]
        sa[slots] = sub
        split = np.ones(len(slots), bool)
        np.not_equal(wide[1:], wide[:-1], out=split[1:])
        head[slots] = split
        group[slots] = np.maximum.accumulate(np.where(split, slots, 0))
        rank[sub] = group[slots] + 1
        depth *= 2


def kasai(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, limit: int, key: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, at most `limit`.

    Kasai's walk keeps the last length less one from place to place; here it walks all pieces of the text (given by their
    starts) in lockstep, so that each step is one vector operation. Seven bytes are compared at a time.
    """
    n = len(text)
    key = first_keys(text) if key is None else key
    lcp = np.zeros(n, np.int64)
    stops = np.append(starts[1:], n)
    order = np.argsort(starts - stops, kind="stable")  # longest piece first: the active ones stay a prefix
    starts, lengths = starts[order], (stops - starts)[order]
    padded = np.full(n + limit + 7, -1, np.int64)
    padded[:n] = key
    before = np.full(n, n)
    before[sa[1:]] = sa[:-1]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t, "left"))
        i = starts[:live] + t
        j = before[i]
        run = np.maximum(h[:live] - 1, 0)
        run[j == n] = 0
        at = np.flatnonzero((j < n) & (run < limit))
        x, y = i[at] + run[at], j[at] + run[at]
        while len(at):
            differ = padded[x] ^ padded[y]
            ends = np.maximum(x, y) + 7 > n
            same = (differ == 0) & ~ends
            step = np.full(len(at), 7)
            part = ~same
            if part.any():
                d = differ[part]
                high = d >> 27  # in two parts, each exact as a float
                bits = np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 27, np.frexp(d.astype(np.float64))[1])
                equal = 7 - -(-bits // 9)
                step[part] = np.minimum(equal, n - np.maximum(x, y)[part])
            run[at] += step
            go = same & (run[at] < limit)
            at, x, y = at[go], x[go] + 7, y[go] + 7
        np.minimum(run, limit, out=run)
        h[:live] = run
        lcp[rank[i]] = run
    return lcp


class Block:
    """The suffix array of some contents: for each window the group of equal windows it belongs to, and the least id of a group."""

    def __init__(self, contents: list[bytes], ids: np.ndarray, W: int):
        size = np.array([len(c) for c in contents], np.int64)
        starts = np.cumsum(size) - size
        text = np.frombuffer(b"".join(contents), np.uint8)
        key = first_keys(text)
        sa, rank = suffix_array(text, key)
        lcp = kasai(text, sa, rank, starts, W, key)
        group = np.cumsum(lcp < W) - 1
        windows_of = size - W + 1
        owner = np.repeat(np.arange(len(contents)), windows_of)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows_of) - windows_of, windows_of) + starts[owner]
        g = group[rank[at]]
        self.owner, self.offset = owner, at - starts[owner]
        distinct, self.group = np.unique(g, return_inverse=True)  # in suffix-array order, so sorted as strings
        self.least = np.full(len(distinct), NO_ID)
        np.minimum.at(self.least, self.group, ids[owner])
        place = np.empty(len(distinct), np.int64)
        place[self.group] = at
        self.text, self.place, self.W = text, place, W

    def strings(self) -> np.ndarray:
        """The distinct windows, sorted."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.W)[self.place]
        return np.ascontiguousarray(view).view(f"S{self.W}").ravel()

    def merge(self, other: Block) -> None:
        """Looks this block's strings up in the other's by binary search; both keep the lesser id."""
        mine, theirs = self.strings(), other.strings()
        spot = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        same = np.flatnonzero(theirs[spot] == mine)
        least = np.minimum(self.least[same], other.least[spot[same]])
        self.least[same] = least
        other.least[spot[same]] = least


def blocks(contents: list[bytes], ids: np.ndarray, anchors: np.ndarray, W: int, limit: int):
    """Yields (positions of the contents, their Block), contents being sorted by anchor; blocks that share an anchor are merged."""
    size = np.cumsum([len(c) for c in contents])
    a, held = 0, []
    while a < len(contents):
        base = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, base + limit, "right")))
        if b < len(contents) and anchors[b] == anchors[b - 1]:
            whole = int(np.searchsorted(anchors, anchors[b]))
            b = whole if whole > a else b
        block = Block(contents[a:b], ids[a:b], W)
        if held and anchors[a] != anchors[a - 1]:
            yield from held
            held = []
        held.append((np.arange(a, b), block))
        a = b
        if a < len(contents) and anchors[a] == anchors[a - 1]:
            continue
        for x in range(len(held)):
            for y in range(x):
                held[x][1].merge(held[y][1])
        yield from held
        held = []
    yield from held


class RepeatedBytes(windows.Plan):
    """Flags each byte under a W-byte string that starts in a document with a smaller id too."""

    def weights(self, ids, places):
        return np.array([min(NO_ID if ids[d] is None else ids[d] for d, _, _ in p) for p in places], np.int64)

    def joined(self, weights):
        return min(weights)

    def decide(self, table: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        contents, least, anchors, entries = [], [], [], []
        for shard, numbers, pieces, weight, anchor in self.received(table):
            own = np.empty(len(pieces), np.int64)
            for x, (piece, w, a) in enumerate(zip(pieces, weight.tolist(), anchor.tolist(), strict=True)):
                i = index.setdefault(piece, len(contents))
                if i == len(contents):
                    contents.append(piece)
                    least.append(w)
                    anchors.append(a)
                elif w < least[i]:
                    least[i] = w
                own[x] = i
            entries.append((shard, numbers, own, weight))
        order = np.argsort(np.array(anchors, np.uint64), kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        contents = [contents[i] for i in order]
        ids, anchors = np.array(least, np.int64)[order], np.array(anchors, np.uint64)[order]
        runs = []  # content, from, to, least id
        for which, block in blocks(contents, ids, anchors, self.W, BLOCK_BYTES):
            g = block.least[block.group]
            new = np.append(True, (block.owner[1:] != block.owner[:-1]) | (g[1:] != g[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(g)) - 1
            runs.append((which[block.owner[first]], block.offset[first], block.offset[last] + 1, g[first]))
        owner, begin, end, g = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, begin, end, g = owner[order], begin[order], end[order], g[order]
        at = np.searchsorted(owner, np.arange(len(contents) + 1))
        rows = []
        for shard, numbers, own, weight in entries:
            c = number[own]
            count = at[c + 1] - at[c]
            pick = np.repeat(at[c], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            who = np.repeat(np.arange(len(c)), count)
            keep = g[pick] < weight[who]
            pick, who = pick[keep], who[keep]
            if len(pick):
                rows.append((shard, numbers[who].astype("<u4").tobytes() + begin[pick].astype("<u4").tobytes() + end[pick].astype("<u4").tobytes() + g[pick].astype("<i8").tobytes()))
        return windows.answers(rows, 1)

    def finish(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts, wanted, blobs = self.load(docs, replies)
        contents, anchors, places = self.candidates(ids, texts, wanted)
        said: dict[int, list] = {}
        for blob in blobs:
            n = len(blob) // 20
            cols = [np.frombuffer(blob, "<u4", n, 4 * n * j).tolist() for j in range(3)]
            for i, a, b in zip(*cols, strict=True):
                said.setdefault(i, []).append((a, b))
        value = [NO_ID if i is None else i for i in ids]
        spans: list[list] = [[] for _ in ids]
        W = self.W
        for i, where in enumerate(places):
            found = said.get(i)
            least = min(value[d] for d, _, _ in where) if len(where) > 1 else value[where[0][0]]
            for d, a, n in where:
                if value[d] > least:
                    spans[d].append((a, a + n - 1 + W))
                elif found:
                    spans[d].extend((a + x, a + y - 1 + W) for x, y in found)
        firsts = [min(value[d] for d, _, _ in where) for where in places]
        for number, where in enumerate(self.windows(contents, anchors).values(), len(contents)):
            least = min(firsts[i] for i, _ in where)
            for i, j in where:
                if firsts[i] > least or number in said:
                    for d, a, _ in places[i]:
                        if value[d] == firsts[i]:  # larger ids lose the whole segment above
                            spans[d].append((a + j, a + j + W))
        out = []
        for doc_id, text, mine in zip(ids, texts, spans, strict=True):
            runs: list[list[int]] = []
            for a, b in sorted(mine):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            out.append((doc_id, len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [x for r in runs for x in r]))
        cols = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Repeated byte strings of `length`, found over the whole corpus.

    Returns a row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (starts and ends of the
    maximal removed runs, flat). A null or empty text has no bytes. A null id counts as larger than any other. Rows with one
    id never remove each other's text. Extra columns are ignored. An empty table gives an empty result.
    """
    anchor = max(4, length // 3)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"
    return windows.run(docs, RepeatedBytes, id_col, text_col, length, anchor, schema, words=False)
