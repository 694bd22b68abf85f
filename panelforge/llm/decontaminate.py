"""Benchmark decontamination by edit distance: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts are sequences of words. The CGK random walk copies the word under a pointer to the output and moves the pointer by a random bit
of that word and step, so sequences within few edits agree in many output places. Each of ROUNDS tables has a walk of its own and
keys a window by two places at most GAP apart, drawn from the whole walk: two walks that lost each other meet again, and then agree
for a while. Windows start at every word and are as long as the item. Those that share a key with it are searched by a bit-parallel
edit distance (Levenshtein over words, the ends free) and, where that is within the bound, aligned: no false match is reported.

Before a walk a lossless count filter leaves out places that cannot match: an item of n words within K edits shares at least
n - q + 1 - K q of its q-grams with the place where it matches.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.rows import filtered
from panelforge.llm.windows import PRIME, U64, WordUnits, mix
from panelforge.session import materialize, release, ship

SIMILARITY = 0.8
ROUNDS = 64  # tables: with 48, items of 10 to 200 words with a fifth edited were all found, wherever the edits were
ROUNDS_AT_ONCE = 16
GAP = 4
WINDOWS = 4096  # walked at once
BENCHMARK_BYTES = 64 << 20  # of a broadcast part
PART_ITEMS = 20_000
BLOCK_WORDS = 1 << 18
BITMAP = 20
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MATCH = "doc_id long, item_id long, first_word long, words long, distance int"


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: runs of ASCII letters, digits and bytes over 127, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    raw = LOWER[np.where(NOT_WORD[raw], 32, raw)]
    start, end = WordUnits.bounds(raw)
    return WordUnits.hash_words(raw, start, end)


def grams(words: np.ndarray, q: int) -> np.ndarray:
    out = words.copy()
    for j in range(1, q):
        out = mix(out[:-1] * U64(PRIME) + words[j:])
    return out if len(words) >= q else words[:0]


def blocks(lengths: list[int]):
    """Runs of texts of about BLOCK_WORDS words."""
    a = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= BLOCK_WORDS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(lengths):
        yield a, len(lengths)


def alignment(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, first word, end) of the best match of the item inside the text; ties: the earliest end, then the shortest."""
    row = [(0, -j) for j in range(len(text) + 1)]  # cost, minus the start: the latest start wins among equals
    for i, x in enumerate(item, 1):
        new = [(i, 0)]
        for j, y in enumerate(text, 1):
            a, b, c = row[j - 1], row[j], new[j - 1]
            new.append(min((a[0] + (x != y), a[1]), (b[0] + 1, b[1]), (c[0] + 1, c[1])))
        row = new
    cost, end = min((c, j) for j, (c, _) in enumerate(row))
    return cost, -row[end][1], end


def reaches(masks: dict[int, int], n: int, k: int, text: list[int]) -> bool:
    """Whether an item of n words matches somewhere in the text within k edits: Myers' bit vectors, masks by word."""
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score = full, 0, n
    for y in text:
        equal = masks.get(y, 0)
        x = equal | minus
        h = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(h | plus) & full, plus & h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score <= k:
                return True
        up = up << 1 & full
        plus, minus = (down << 1 | ~(x | up)) & full, up & x
    return score <= k


def places(lengths: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two output places that each table samples of windows of the given lengths, among the 2n first ones."""
    draw = mix((rounds.astype(np.uint64) + U64(1)) * U64(PRIME))
    gap = np.minimum((draw & U64(0xFFFF)).astype(np.int64)[:, None] % GAP + 1, 2 * lengths - 1)
    first = ((draw >> U64(32)).astype(np.float64)[:, None] / 2**32 * (2 * lengths - gap)).astype(np.int64)
    return first, first + gap


def embedded(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """LSH keys, a row a table, of the windows at the given places; 0 where a window's walk ends before the sampled places."""
    first, second = places(lengths, rounds)
    at, key = np.zeros(first.shape, np.int64), np.zeros(first.shape, np.uint64)
    for j in range(int(second.max()) + 1 if second.size else 0):
        place = starts + at
        x = words[np.minimum(place, len(words) - 1)]
        x[(at >= lengths) | (place >= len(words))] = 0
        now = first == j
        key[now] = x[now]
        now = (second == j) & (key != 0)
        key[now] = mix(key[now] * U64(PRIME) + x[now])
        step = mix(rounds.astype(np.uint64) << U64(32) | U64(j + 1)) | U64(1)
        at += (x * step[:, None] >> U64(63)).astype(np.int64)
    return key


class Index:
    """A bounded part of the benchmark: the q-grams of each item, its keys in the LSH tables and its words as bit masks."""

    def __init__(self, items: list[tuple[int, np.ndarray]], similarity: float, rounds: int = ROUNDS):
        self.items = [(i, w) for i, w in items if len(w)]
        self.rounds = [np.arange(a, min(a + ROUNDS_AT_ONCE, rounds)) for a in range(0, rounds, ROUNDS_AT_ONCE)]
        self.lengths = np.array([len(w) for _, w in self.items], np.int64)
        self.keys = np.zeros((rounds, len(self.items)), np.uint64)
        by_length = np.argsort(self.lengths, kind="stable")
        for some in np.split(by_length, range(WINDOWS, len(by_length), WINDOWS)):
            words, starts = np.concatenate([np.zeros(0, np.uint64), *(self.items[m][1] for m in some)]), np.cumsum(self.lengths[some]) - self.lengths[some]
            for r in self.rounds:
                self.keys[np.ix_(r, some)] = embedded(words, starts, self.lengths[some], r)
        self.edits = [int((1 - similarity) * len(w) + 1e-9) for _, w in self.items]
        self.q, self.least, self.masks = [], [], []
        for (_, w), k in zip(self.items, self.edits, strict=True):
            n = len(w)
            q = next(q for q in (3, 2, 1) if n - q + 1 - k * q >= 1 or q == 1)
            self.q.append(q)
            self.least.append(max(1, n - q + 1 - k * q))
            masks: dict[int, int] = defaultdict(int)
            for i, x in enumerate(w.tolist()):
                masks[x] |= 1 << i
            self.masks.append(dict(masks))
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # q -> sorted (gram, item) pairs and a bitmap
        for q in set(self.q):
            pairs = sorted({(g, m) for m, (_, w) in enumerate(self.items) if self.q[m] == q for g in grams(w, q).tolist()})
            known = np.array([g for g, _ in pairs], np.uint64)
            seen = np.zeros(1 << BITMAP, bool)
            seen[known & U64((1 << BITMAP) - 1)] = True
            self.grams[q] = known, np.array([m for _, m in pairs]), seen

    def stretches(self, words: np.ndarray):
        """(item position, first, last): ranges of places where the count filter lets a match of the item start."""
        for q, (known, owner, seen) in self.grams.items():
            g = grams(words, q)
            place = np.flatnonzero(seen[g & U64((1 << BITMAP) - 1)])
            lo, hi = np.searchsorted(known, g[place], "left"), np.searchsorted(known, g[place], "right")
            count = hi - lo
            if not count.any():
                continue
            at = np.repeat(place, count)
            c = owner[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            order = np.argsort(c, kind="stable")
            at, c = at[order], c[order]
            edges = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for x, y in zip(edges, [*edges[1:], len(c)], strict=True):
                m, p = int(c[x]), at[x:y]
                n, k, least = len(self.items[m][1]), self.edits[m], self.least[m]
                if len(p) < least:
                    continue
                first, last = p[: len(p) - least + 1], p[least - 1 :]
                ok = last - first <= n + 2 * k - q
                low, high = np.maximum(last[ok] - n - k + q, 0), first[ok] + k
                if len(low):
                    cut = np.flatnonzero(low[1:] - high[:-1] > n)
                    yield from zip([m] * (len(cut) + 1), low[np.append(0, cut + 1)].tolist(), high[np.append(cut, len(high) - 1)].tolist(), strict=True)

    def candidates(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item position, first, last), sorted: the stretches, or pieces of an item's length of them, in which a window shares a key with the item."""
        pieces = np.array([(m, a, min(a + n - 1, final)) for m, start, last in self.stretches(words) for n, final in [(len(self.items[m][1]), min(last, len(words) - 1))] for a in range(start, final + 1, n)], np.int64).reshape(-1, 3)
        pieces = pieces[np.argsort(self.lengths[pieces[:, 0]], kind="stable")]
        size = np.cumsum(pieces[:, 2] - pieces[:, 1] + 1)
        found = np.zeros(len(pieces), bool)
        for some in np.split(np.arange(len(pieces)), np.flatnonzero(np.diff(size // WINDOWS)) + 1):
            for r in self.rounds:  # a piece leaves with the first key it shares
                some = some[~found[some]]
                if not len(some):
                    break
                m, first, last = pieces[some].T
                count = last - first + 1
                begin = np.cumsum(count) - count
                owner = np.repeat(m, count)
                key = embedded(words, np.arange(count.sum()) - np.repeat(begin - first, count), self.lengths[owner], r)
                hit = ((key == self.keys[np.ix_(r, owner)]) & (key != 0)).any(axis=0)
                found[some] = np.logical_or.reduceat(hit, begin)
        out: list[tuple[int, int, int]] = []
        for m, first, last in sorted(map(tuple, pieces[found].tolist())):
            if out and out[-1][0] == m and first <= out[-1][2] + 1:
                out[-1] = (m, out[-1][1], max(last, out[-1][2]))
            else:
                out.append((m, first, last))
        return out

    def matches(self, texts: list[np.ndarray]):
        """Yields (text number, item id, first word, words, distance): verified matches, the best of each stretch of a text."""
        if not any(map(len, texts)) or not self.items:
            return
        lead = mix(np.arange(1, max(self.edits) + 1, dtype=np.uint64) * U64(PRIME))  # windows may start before the first text
        words = np.concatenate([lead, *texts])
        stop = np.cumsum([len(t) for t in texts]) + len(lead)
        at, reached = -1, 0
        for m, start, final in self.candidates(words):
            item_id, item = self.items[m]
            n, k = len(item), self.edits[m]
            if m != at:
                at, want, reached = m, item.tolist(), 0
            for d in range(*np.searchsorted(stop, [start, final], "right") + [0, 1]):
                low = int(stop[d]) - len(texts[d])
                a, b = max(low, start - k, reached), min(int(stop[d]), final + n + 2 * k)
                while b - a >= n - k:
                    end_ = min(b, a + 2 * n + 4 * k)  # long stretches in parts that overlap by more than a match
                    text = words[a:end_].tolist()
                    if reaches(self.masks[m], n, k, text):
                        cost, first, end = alignment(want, text)
                        yield d, item_id, a + first - low, end - first, cost
                        reached = a + end
                    if end_ == b:
                        break
                    a = max(reached, end_ - n - 2 * k)


def parts_of(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str):
    """Yields (name, broadcast) of parts of the benchmark of about BENCHMARK_BYTES at most: its size is known before it is read."""
    spark = ship(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // BENCHMARK_BYTES))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else items
        parsed = [(r["item"], words_of(r["text"])) for r in own.orderBy("item", "text").toLocalIterator()]
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([parsed[a : a + PART_ITEMS] for a in range(0, len(parsed), PART_ITEMS)])


_indexes: dict[tuple, list[Index]] = {}  # of a Python worker: its tasks share the index of the last part


def indexes(name: str, shared, similarity: float) -> list[Index]:
    if (name, similarity) not in _indexes:
        _indexes.clear()
        _indexes[name, similarity] = [Index(p, similarity) for p in shared.value]
    return _indexes[name, similarity]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Matches of benchmark items in whole texts: doc_id, item_id, first_word, words and distance.

    An item matches where at most (1 - similarity) of its n words are edited. The benchmark is broadcast and the documents stream
    by; one of more than BENCHMARK_BYTES is dealt to parts by a hash, the documents stream by once a part, and what is found in a
    part is written before the next. Items without a word, null texts and
    null items match nothing. Rows with one id, or with none, are documents of their own, and of items with one id each
    reports its own matches. Extra columns are ignored. Empty tables give an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return over_parts(source, parts_of(docs, benchmark, item_col, item_text), lambda name, shared: finder(name, shared, similarity), MATCH)


def over_parts(source: DataFrame, parts, worker, schema: str) -> DataFrame:
    """The union of what a worker finds for each part: lazy for a single one, else written part by part."""
    out, first = None, next(parts)
    for name, shared in parts:
        if out is None:
            out = materialize(source.mapInArrow(worker(*first), schema), "matches")
            first[1].unpersist()
        out = out.unionByName(materialize(source.mapInArrow(worker(name, shared), schema), "matches"))
        shared.unpersist()
    return source.mapInArrow(worker(*first), schema) if out is None else out


def finder(name: str, shared, similarity: float):
    def find(batches):
        parts = indexes(name, shared, similarity)
        for batch in batches:
            rows = []
            ids, texts = batch.column("id").to_pylist(), [words_of(t) for t in batch.column("text").to_pylist()]
            for a, b in blocks([len(t) for t in texts]):
                for index in parts:
                    rows += [(ids[a + d], *match) for d, *match in index.matches(texts[a:b])]
            if rows:
                ids, item, first, n, cost = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(cost, pa.int32())], names=["doc_id", "item_id", "first_word", "words", "distance"])

        release()

    return find


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows in which contaminated() finds no item, with all their columns as they are.

    Null and empty texts stay, repeated rows are judged alike, an empty benchmark keeps every row and an empty table gives an
    empty result. A benchmark of several parts leaves hashes of the texts it is found in, which are then joined.
    """
    parts = parts_of(docs, benchmark, item_col, item_text)
    first, second = next(parts), next(parts, None)

    def dirty(index: list[Index], texts: list) -> np.ndarray:
        texts = [words_of(t) for t in texts]
        found = np.zeros(len(texts), bool)
        for a, b in blocks([len(t) for t in texts]):
            for part in index:
                found[[a + d for d, *_ in part.matches(texts[a:b])]] = True
        return found

    if second is None:

        def judge():
            index = indexes(*first, similarity)
            return lambda texts: ~dirty(index, texts)

        return filtered(docs, text_col, judge)

    def marker(name: str, shared):
        def take(batches):
            index = indexes(name, shared, similarity)
            for batch in batches:
                yield batch.filter(pa.array(dirty(index, batch.column("text").to_pylist()))).select(["mark", "size"])
            release()

        return take

    text = F.col(text_col).cast("string")
    source = docs.select(text.alias("text"), F.xxhash64(text).alias("mark"), F.octet_length(text).alias("size"))
    mark, size = (f"_{x}_{uuid.uuid4().hex}" for x in ("mark", "size"))
    found = over_parts(source, itertools.chain([first, second], parts), marker, "mark long, size int").distinct().toDF(mark, size)
    return docs.join(found, (F.xxhash64(text) == F.col(mark)) & (F.octet_length(text) == F.col(size)), "left_anti")
