"""Repeated fixed-length windows over a corpus, the frame that substring operators share.

A window is ``W`` consecutive units (bytes or words) of one document. Every window picks the smallest hashed ``k``-gram
inside it (leftmost on ties) as its anchor, so equal windows pick equal anchors at equal places. Consecutive windows with
one anchor form a segment. The data flow, all of it by hash partitioning:

Documents are dealt to shards by a hash of their id, in compressed blobs. Then:

1. each scan task sends the anchor hashes of its documents, one entry a shard of documents, to the bin of the hash;
2. a bin returns to each shard the hashes that more than one place holds;
3. a shard of documents collapses equal candidate segments and sends one of each to the bin of its anchor;
4. a bin decides exactly, on the segments' contents, which windows recur (the operator's own method);
5. the shard maps the answers back to spans of its documents.

Equal segments collapse within a shard before any shuffle, so a passage that a third of all documents share reaches its bin
once a shard. An anchor that more than HOT places hold may stand in as many different contexts: the segments of such an anchor are
taken apart, and each distinct window goes to the bin of its own hash. Unrepeated text costs one anchor hash in some (W-k+2)/2 units and no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import partitions, plan_bytes, release, ship

U64 = np.uint64
BLOCK = 1 << 19  # units hashed at once; positions within a block fit the low bits of a sort key
POS_BITS = U64(20)
POS_MASK = U64((1 << 20) - 1)
PRIME = 0x9E3779B97F4A7C15 | 1
SHARD_BYTES = 3 << 20
HOT = 20_000  # places of an anchor beyond which its windows are dealt one by one
BIN_BYTES = 10 << 20  # of the input to a bin
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(29)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(32)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and its inverse modulo 2**64 for i < n."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, BLOCK + 64)
        inverse = pow(PRIME, -1, 1 << 64)
        for key, base in (("p", PRIME), ("q", inverse)):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["p"][:n], _powers["q"][:n]


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive 64-bit units."""
    n = len(units)
    if n < k:
        return np.zeros(0, np.uint64)
    p, q = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(units * p[:n], dtype=np.uint64, out=total[1:])
    return mix((total[k:] - total[:-k]) * q[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(units: np.ndarray, ends: np.ndarray, W: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a block: (anchor hash, first window, windows). ends: for each unit the end of its document in the block."""
    n = len(units)
    if n < W:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(units, k)
    key = ((h >> POS_BITS) << POS_BITS) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_min(key, W - k + 1) & POS_MASK).astype(np.int64)
    ok = ends[: n - W + 1] >= np.arange(W, n + 1)
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1]) | (ends[1 : n - W + 1] != ends[: n - W])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    keep = ok[first]
    first, count = first[keep], count[keep]
    return h[at[first]], first, count


class ByteUnits:
    """Units are the bytes of a text."""

    @staticmethod
    def split(data: bytes):
        raw = np.frombuffer(data, np.uint8)
        return raw, len(raw)

    @staticmethod
    def hashes(view) -> np.ndarray:
        return BYTE_HASH[view]


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class WordUnits:
    """Units are maximal runs of bytes other than space and 9 to 13."""

    @staticmethod
    def bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = SPACE[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        return edge[0::2], edge[1::2]

    @classmethod
    def hash_words(cls, raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
        """64-bit hash of each word (which may be empty), by prefix sums over blocks of bytes."""
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            a = start[i]
            j = max(i + 1, int(np.searchsorted(end, a + BLOCK, "right")))
            b = end[j - 1]
            p, q = powers(int(b - a) + 1)
            total = np.zeros(int(b - a) + 1, np.uint64)
            np.cumsum(table[raw[a:b]] * p[: b - a], dtype=np.uint64, out=total[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64))
            i = j
        return out


class Shard:
    """Documents in a fixed order with their unit hashes; walks blocks of at most BLOCK units, long documents in overlapping parts."""

    def __init__(self, texts: list[bytes], W: int, k: int, words: bool):
        self.texts, self.W, self.k, self.words = texts, W, k, words

    def blocks(self):
        """Yields (document numbers, offsets in units within each document, lengths, unit hashes)."""
        docs, offs, lens, parts, size = [], [], [], [], 0
        for d, text in enumerate(self.texts):
            if not text:
                continue
            raw = np.frombuffer(text, np.uint8)
            if self.words:
                s, e = WordUnits.bounds(raw)
                n, hashes = len(s), None
                if n >= self.W:
                    hashes = WordUnits.hash_words(raw, s, e)
            else:
                n, hashes = len(raw), None
            if n < self.W:
                continue
            step = BLOCK - self.W + 1
            for a in range(0, n - self.W + 1, step):
                b = min(n, a + BLOCK)
                if size and size + b - a > BLOCK:
                    yield docs, offs, lens, np.concatenate(parts)
                    docs, offs, lens, parts, size = [], [], [], [], 0
                docs.append(d)
                offs.append(a)
                lens.append(b - a)
                parts.append(hashes[a:b] if self.words else BYTE_HASH[raw[a:b]])
                size += b - a
        if size:
            yield docs, offs, lens, np.concatenate(parts)

    def segments(self):
        """Yields (document number, first window in the document, windows, anchor hash) as arrays, block by block."""
        for docs, offs, lens, units in self.blocks():
            stop = np.cumsum(lens)
            begin = stop - lens
            h, first, count = segments(units, np.repeat(stop, lens), self.W, self.k)
            part = np.searchsorted(stop, first, "right")
            yield np.asarray(docs)[part], first - begin[part] + np.asarray(offs)[part], count, h


def short(h: np.ndarray) -> np.ndarray:
    return h >> U64(16)


def pack48(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def planes(*columns) -> bytes:
    """64-bit columns, bytes of one rank together: high bytes that are all zero cost nothing once compressed."""
    return b"".join(np.asarray(c).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def from_planes(blob: bytes, at: int, n: int, columns: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8, 8 * n * columns, at).reshape(columns, 8, n).transpose(0, 2, 1)
    return np.ascontiguousarray(raw).view("<i8")[:, :, 0]


def bin_of(h48: np.ndarray, bins: int) -> np.ndarray:
    return (h48 % U64(bins)).astype(np.int64)


def order_of(ids: list, texts: list) -> list[int]:
    """A fixed order of a shard's rows, whatever order they arrived in."""
    return sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))


def stream(column: pa.Array) -> bytes:
    """A column of any type as an Arrow stream: nothing of it is altered on the way."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([pa.field("x", column.type)])) as out:
        out.write_batch(pa.record_batch([column], names=["x"]))
    return sink.getvalue().to_pybytes()


def utf8(column: pa.Array) -> list:
    return pa.array(column).cast(pa.large_binary()).to_pylist() if len(column) else []


class Plan:
    """What a substring operator fixes: window, anchor, unit, and its exact decision."""

    def __init__(self, W: int, k: int, words: bool, shards: int, bins: int):
        self.W, self.k, self.words, self.shards, self.bins, self.hot = W, k, words, shards, bins, HOT

    # -- 0 --------------------------------------------------------------------------------------------------------
    def pack(self, batches):
        """Documents dealt to shards in compressed blobs."""
        held: dict[int, list] = {}
        size, base, carried = 0, 0, []

        def out():
            others = pa.chunked_array(carried).combine_chunks() if carried else None
            blobs = []
            for rows in held.values():
                ids = np.array([r[0] or 0 for r in rows], "<i8").tobytes()
                none = np.array([[r[0] is None, r[1] is None] for r in rows]).T.tobytes()
                sizes = np.array([len(r[1] or b"") for r in rows], "<u4").tobytes()
                rest = b"" if others is None else stream(others.take(pa.array([r[2] for r in rows])))
                blobs.append(zstandard.ZstdCompressor(level=3).compress(b"".join([len(rows).to_bytes(4, "little"), ids, none, sizes, *[r[1] or b"" for r in rows], rest])))
            batch = pa.record_batch([pa.array(held, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "payload"])
            held.clear()
            carried.clear()
            return batch

        for batch in batches:
            texts = utf8(batch.column("text"))
            if "others" in batch.schema.names:
                carried.append(batch.column("others"))
            for at, (doc_id, text, shard) in enumerate(zip(batch.column("id").to_pylist(), texts, batch.column("shard").to_pylist(), strict=True), base):
                held.setdefault(shard, []).append((doc_id, text, at))
                size += len(text or b"")
            base += batch.num_rows
            if size >= 24 << 20:
                yield out()
                size = base = 0
        if held:
            yield out()
        release()

    @staticmethod
    def unpack(blob: bytes):
        """(ids, texts, whether a text is null, the other columns or None) of a blob."""
        blob = zstandard.decompress(blob)
        n = int.from_bytes(blob[:4], "little")
        ids = np.frombuffer(blob, "<i8", n, 4).tolist()
        none = np.frombuffer(blob, bool, 2 * n, 4 + 8 * n)
        size = np.frombuffer(blob, "<u4", n, 4 + 10 * n)
        stop = np.cumsum(size, dtype=np.int64) + 4 + 14 * n
        parts = [blob[e - s : e] for e, s in zip(stop.tolist(), size.tolist(), strict=True)]
        end = int(stop[-1]) if n else 4
        rest = None if end == len(blob) else pa.ipc.open_stream(blob[end:]).read_all().column(0).combine_chunks()
        return [None if x else i for i, x in zip(ids, none[:n], strict=True)], parts, none[n:].tolist(), rest

    # -- 1 --------------------------------------------------------------------------------------------------------
    def announce(self, batches):
        """Anchor hashes of a scan task, unique by (hash, shard), in one blob a bin and flush."""
        schema = pa.schema([("bin", pa.int32()), ("payload", pa.binary())])
        held, size = [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            shard = np.concatenate([x[1] for x in held])
            doc = np.concatenate([x[2] for x in held])
            order = np.argsort(h)
            h, shard, doc = h[order], shard[order], doc[order]
            tie = np.append(True, h[1:] != h[:-1])
            order = np.argsort(np.cumsum(tie) * self.shards + shard)
            h, shard, doc = h[order], shard[order], doc[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])))
            count = np.diff(np.append(first, len(h)))
            several = count > 1 if self.words else np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            h, shard = h[first], shard[first]
            b = bin_of(h, self.bins)
            order = np.argsort(b, kind="stable")
            cuts = np.flatnonzero(np.diff(b[order])) + 1
            for part in np.split(order, cuts):
                n = len(part).to_bytes(4, "little")
                where = (shard[part] << 9 | np.minimum(count[part], 255) << 1 | several[part]).astype("<i8")
                yield int(b[part[0]]), zstandard.ZstdCompressor(level=1).compress(n + planes(np.diff(h[part], prepend=U64(0)), where))

        def out(rows):
            bins, payloads = zip(*rows, strict=True)
            return pa.record_batch([pa.array(bins, pa.int32()), pa.array(payloads, pa.binary())], schema=schema)

        base = 0
        for batch in batches:
            texts, shard = utf8(batch.column("text")), batch.column("shard").to_numpy(zero_copy_only=False)
            for d, _, _, h in Shard(texts, self.W, self.k, self.words).segments():
                if len(h):
                    held.append((short(h), shard[d], d + base))
                    size += len(h)
            base += len(texts)
            if size >= 1 << 20:
                yield out(flush())
                held, size = [], 0
        if size:
            yield out(flush())
        held = []
        release()

    # -- 2 --------------------------------------------------------------------------------------------------------
    def meet(self, table: pa.Table) -> pa.Table:
        """A bin's sorted runs, merged; returns to each shard the hashes that more than one place holds, and which of them are hot."""
        hs, ss = [], []
        for blob in table.column("payload").to_pylist():
            blob = zstandard.decompress(blob)
            gaps, where = from_planes(blob, 4, int.from_bytes(blob[:4], "little"), 2)
            hs.append(np.cumsum(gaps.view(np.uint64), dtype=np.uint64))
            ss.append(where)
        h, s = np.concatenate(hs), np.concatenate(ss)
        order = np.argsort(h, kind="stable")
        h, s = h[order], s[order]
        same = h[1:] == h[:-1]
        hit = np.append(same, False) | np.append(False, same) | ((s & 1) == 1)
        h, s = h[hit], s[hit]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        held = np.add.reduceat(s >> 1 & 255, first) if len(first) else first
        hot = np.repeat(held > self.hot, np.diff(np.append(first, len(h))))
        s = (s >> 9).astype(np.int64)

        def reply(h, s, kind):
            order = np.lexsort((h, s))
            h, s = h[order], s[order]
            return answers([(int(s[p[0]]), pack48(np.unique(h[p]))) for p in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1) if len(p)], kind)

        return pa.concat_tables([reply(h, s, 0), reply(h[hot], s[hot], 2)])

    # -- 3 --------------------------------------------------------------------------------------------------------
    def candidates(self, ids: list, texts: list[bytes], wanted: np.ndarray):
        """Equal candidate segments collapsed: contents by bin, and where they stand.

        Returns (contents, anchors, places): places[i] lists (document, first window, windows) of contents[i].
        """
        index: dict[bytes, int] = {}
        contents, anchors, places = [], [], []
        W, words = self.W, self.words
        bounds: dict[int, tuple] = {}
        if not len(wanted):
            return contents, anchors, places
        for docs, first, count, h in Shard(texts, W, self.k, words).segments():
            h = short(h)
            spot = np.searchsorted(wanted, h)
            spot[spot == len(wanted)] = 0
            keep = np.flatnonzero(wanted[spot] == h)
            for d, a, n, x in zip(docs[keep].tolist(), first[keep].tolist(), count[keep].tolist(), h[keep].tolist(), strict=True):
                if words:
                    if d not in bounds:
                        bounds = {d: texts[d].split()}
                    key = b" ".join(bounds[d][a : a + n - 1 + W])
                else:
                    key = texts[d][a : a + n - 1 + W]
                i = index.get(key)
                if i is None:
                    i = index[key] = len(contents)
                    contents.append(key)
                    anchors.append(x)
                    places.append([])
                places[i].append((d, a, n))
        return contents, anchors, places

    def load(self, docs: pa.Table, replies: pa.Table):
        ids, texts, nulls, rest = [], [], [], []
        for blob in docs.column("payload").to_pylist():
            for column, part in zip((ids, texts, nulls), (found := self.unpack(blob)), strict=False):
                column += part
            rest.append(found[3])
        order = order_of(ids, texts)
        ids, texts, self.nulls = ([column[i] for i in order] for column in (ids, texts, nulls))
        self.others = pa.chunked_array(rest).combine_chunks().take(pa.array(order)) if rest and rest[0] is not None else None
        kinds, blobs = replies.column("kind").to_pylist(), replies.column("payload").to_pylist()
        hashes = [unpack48(b) for k, b in zip(kinds, blobs, strict=True) if k == 0]
        wanted = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.hot_anchors = {x for k, b in zip(kinds, blobs, strict=True) if k == 2 for x in unpack48(b).tolist()}
        rest = [b for k, b in zip(kinds, blobs, strict=True) if k == 1]
        return ids, texts, wanted, rest

    def windows(self, contents: list[bytes], anchors: list[int]) -> dict[bytes, list[tuple[int, int]]]:
        """The distinct windows of the segments with a hot anchor: (segment, place in it) of each, in a fixed order."""
        out: dict[bytes, list[tuple[int, int]]] = {}
        for i, (content, anchor) in enumerate(zip(contents, anchors, strict=True)):
            if anchor in self.hot_anchors:
                units = content.split(b" ") if self.words else content
                for j in range(len(units) - self.W + 1):
                    key = b" ".join(units[j : j + self.W]) if self.words else units[j : j + self.W]
                    out.setdefault(key, []).append((i, j))
        return out

    def send(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        schema = pa.schema([("bin", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary())])
        ids, texts, wanted, _ = self.load(docs, replies)
        contents, anchors, places = self.candidates(ids, texts, wanted)
        if not contents:
            return pa.Table.from_batches([], schema)
        shard = docs.column("shard")[0].as_py()
        weight = self.weights(ids, places)
        apart = self.windows(contents, anchors)
        if apart:  # numbered after the segments
            cold = np.array([a not in self.hot_anchors for a in anchors])
            weight = np.append(weight, [self.joined([weight[i] for i, _ in where]) for where in apart.values()]).astype(np.int64)
            anchors = [*anchors, *(xxhash.xxh64_intdigest(w) >> 16 for w in apart)]
            contents = [*contents, *apart]
            sent = np.append(np.flatnonzero(cold), np.arange(len(cold), len(contents)))
        else:
            sent = np.arange(len(contents))
        h = np.array(anchors, np.uint64)
        b = bin_of(h[sent], self.bins)
        order = np.argsort(b, kind="stable")
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
            part = sent[at]
            columns = [np.diff(part, prepend=0), [len(contents[i]) for i in part], weight[part], h[part] & U64(0xFFFFFFFF)]
            blob = b"".join([len(part).to_bytes(4, "little"), planes(*columns), *[contents[i] for i in part]])
            rows.append((int(b[at[0]]), shard, zstandard.ZstdCompressor(level=1).compress(blob)))
        bins, shards, payloads = zip(*rows, strict=True)
        return pa.table([pa.array(bins, pa.int32()), pa.array(shards, pa.int32()), pa.array(payloads, pa.binary())], schema=schema)

    @staticmethod
    def received(table: pa.Table):
        """Yields (shard, index, contents, weights, anchors) of each blob of a bin."""
        for shard, blob in zip(table.column("shard").to_pylist(), table.column("payload").to_pylist(), strict=True):
            blob = zstandard.decompress(blob)
            n = int.from_bytes(blob[:4], "little")
            index, size, weight, anchors = from_planes(blob, 4, n, 4)
            index, body = np.cumsum(index), 4 + 32 * n
            stop = np.cumsum(size) + body
            yield shard, index, [blob[e - s : e] for e, s in zip(stop.tolist(), size.tolist(), strict=True)], weight, anchors.view(np.uint64)

    # -- to be given by operators -----------------------------------------------------------------------------------
    def weights(self, ids, places) -> np.ndarray:
        """What a shard tells of each collapsed segment."""
        raise NotImplementedError

    def joined(self, weights) -> int:
        """What it tells of a window that several of its segments hold, from their weights."""
        raise NotImplementedError

    def decide(self, table: pa.Table) -> pa.Table:
        raise NotImplementedError

    def finish(self, docs: pa.Table, replies: pa.Table) -> pa.Table:
        raise NotImplementedError


def answers(rows: list[tuple[int, bytes]], kind: int) -> pa.Table:
    return pa.table(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
        schema=pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())]),
    )


def run(docs: DataFrame, plan_type, id_col: str, text_col: str, W: int, k: int, result, others: list[str] | None = None, **more) -> DataFrame:
    """The five steps as one lazy plan; `result` is the schema that plan_type.finish returns. `others`: columns to carry along."""
    spark = ship(docs.sparkSession)
    size = plan_bytes(docs) or 0
    shards = max(2 * partitions(spark), size // SHARD_BYTES)
    plan = plan_type(W, k, shards=shards, bins=max(partitions(spark), size // BIN_BYTES), **more)
    carried = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("others")] if others else []
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *carried)
    source = source.withColumn("shard", F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")), F.lit(shards)).cast("int"))
    replies = "shard int, kind int, payload binary"
    met = source.select("id", "text", "shard").mapInArrow(plan.announce, "bin int, payload binary").groupBy("bin").applyInArrow(lambda t: plan.meet(t), replies)
    packed = source.mapInArrow(plan.pack, "shard int, payload binary")
    sent = packed.groupBy("shard").cogroup(met.groupBy("shard")).applyInArrow(lambda d, r: plan.send(d, r), "bin int, shard int, payload binary")
    told = met.unionByName(sent.groupBy("bin").applyInArrow(lambda t: plan.decide(t), replies))
    return packed.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(lambda d, r: plan.finish(d, r), result)
