"""SimHash near-duplicates by anchor-point covering.

A fingerprint has two halves of 32 bits. Fingerprints within 3 bits of each other are within 1 bit in one half. The anchors of a
half are the words of the perfect Hamming code of length 31, with the 32nd bit free: every half lies within 1 bit of an anchor, its
home (covering radius 1), and halves within 1 bit of each other lie within 2 bits of each other's homes. So each distinct
fingerprint goes to the at most 17 anchors within radius plus threshold, in both halves, and at each anchor the fingerprints at
home there are compared with all that came. Equal texts collapse to one fingerprint first. An anchor's links leave it as a
forest, never as all pairs.

The pipeline's near copies are candidates of the same search, on fingerprints of shingle sets, each verified exactly on the sets.
Fingerprints of sets at a similarity of 0.8 often differ in more bits, so prefix filtering adds the pairs they leave out.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import components, forest
from panelforge.llm.windows import from_planes, planes
from panelforge.session import materialize, partitions, release, ship

SEED = 42
THRESHOLD = 3
PAIRS_AT_ONCE = 1 << 21
MASKS = np.array([sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)], np.uint32)


def flips() -> np.ndarray:
    """For each syndrome the bits to flip for the anchors within 2: the nearest first, then the 15 at distance 2 (or none: -1)."""
    out = np.full((32, 16), -1, np.int64)
    out[0, 0] = 0
    for s in range(1, 32):
        out[s, 0] = 1 << (s - 1)
        pairs = [(a, a ^ s) for a in range(1, 32) if a < a ^ s]
        out[s, 1 : 1 + len(pairs)] = [1 << (a - 1) | 1 << (b - 1) for a, b in pairs]
    return out


FLIPS = flips()


def syndrome(half: np.ndarray) -> np.ndarray:
    s = np.zeros(len(half), np.int64)
    for j, m in enumerate(MASKS):
        s |= (np.bitwise_count(half & m).astype(np.int64) & 1) << j
    return s


def halves(fp: np.ndarray):
    """Yields (half number, 32-bit half) of unsigned fingerprints."""
    for number, shift in enumerate((0, 32)):
        yield number, ((fp >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def homes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the home anchor in each half."""
    return tuple((half ^ FLIPS[syndrome(half), 0].astype(np.uint32)).astype(np.int64) | number << 32 for number, half in halves(fp))


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, position of the fingerprint) of all anchors within radius plus threshold."""
    keys, where = [], []
    for number, half in halves(fp):
        flip = FLIPS[syndrome(half)]
        anchor = half.astype(np.int64)[:, None] ^ np.maximum(flip, 0)
        row, col = np.nonzero(flip >= 0)
        keys += [anchor[row, col] | number << 32, (anchor[:, 0] ^ 1 << 31) | number << 32]
        where += [row, np.arange(len(fp))]
    return np.concatenate(keys), np.concatenate(where)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the shingles of `size` words (A-Z lower-cased), repeats included; fewer words: of the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    stop = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, stop[: len(words) - size]).tolist()
    ends = (stop[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if set in over half the hashes; 0 without hashes."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of each row."""
    ship(docs.sparkSession)

    def take(batches):
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(take, "id long, fp long")


def compare(keys: np.ndarray, fp: np.ndarray, threshold: int):
    """Links of rows sorted by anchor: yields (position, position) arrays of at most PAIRS_AT_ONCE compared pairs each."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    size = np.diff(np.append(first, len(keys)))
    at_home = np.where(keys >> 32 == 0, homes(fp)[0], homes(fp)[1]) == keys
    group = np.repeat(np.arange(len(first)), size)
    home = np.flatnonzero(at_home & (size[group] > 1))
    work = np.cumsum(size[group[home]])
    a = 0
    while a < len(home):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
        h = home[a:b]
        n = size[group[h]]
        left = np.repeat(h, n)
        right = np.repeat(first[group[h]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (left != right)
        yield left[near], right[near]
        a = b


def link(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Forest links (a, b) of distinct fingerprints (column fp) within `threshold` bits, of at most 3."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover thresholds of 0 to 3")
    spark = ship(fps.sparkSession)

    def spread(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            keys, where = replicas(fp.view(np.uint64))
            for a in range(0, len(keys), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 18)]), pa.array(fp[where[a : a + (1 << 18)]])], names=["key", "fp"])

    def join(batches):
        key, fp, links = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def settle(upto: int):
            f = fp[:upto]
            for i, j in compare(key[:upto], f.view(np.uint64), threshold):
                if len(i):
                    links.append((f[i], f[j]))
                    if sum(len(x[0]) for x in links) > PAIRS_AT_ONCE:
                        links[:] = [forest(*(np.concatenate(x) for x in zip(*links, strict=True)))]

        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            if len(key) > 1 << 18:
                upto = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
                if upto:
                    settle(upto)
                    key, fp = key[upto:], fp[upto:]
        settle(len(key))
        if links:
            a, b = forest(*(np.concatenate(x) for x in zip(*links, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    spread_out = fps.select("fp").mapInArrow(spread, "key long, fp long")
    met = spread_out.repartition(4 * partitions(spark), "key").sortWithinPartitions("key")
    return met.mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of each row.

    A null or empty text has fingerprint zero and links like any other. A row without an id has a fingerprint and takes the
    component of its fingerprint (null if no row there has an id). Repeated rows are all kept. Extra columns are ignored. An
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    known = rows.groupBy("fp").agg(F.min("id").alias("least"))
    linked = components(link(known, threshold))
    whole = known.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    whole = materialize(whole, "classes")
    root = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = whole.join(root, "root").select("fp", "component_id")
    out = rows.join(by_fp, "fp")
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The near-copy stage: shingle sets at an exact Jaccard similarity.
FREQUENT = 1 << 20  # shingles whose counts order the prefixes: the most frequent ones of all documents, a broadcast of 16 MB
KEY_SHIFT = np.uint64(24)  # shingles are counted by the upper 40 bits of their hashes
COUNTED_AT_ONCE = 1 << 21
SLOTS = 1 << 22  # of hashed ids, to send few texts to a join


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size))


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit digest of a set: rows with one set are one class."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)).view(np.int64))


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the order rare to frequent, then by hash: sets that are similar enough share one of them."""
    n = len(shingles)
    if not n:
        return shingles
    count = np.zeros(n, np.int64)
    if len(frequent):
        key = shingles >> KEY_SHIFT
        at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
        count = np.where(frequent[at] == key, counts[at], 0)
    return shingles[np.argsort(count, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def frequent_shingles(source: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, documents) of the shingles that most documents hold, sorted by key: at most FREQUENT, counted over all documents.

    Counts leave a task sorted and as gaps, some 3 bytes a shingle. They decide the order of shingles and so what the search
    costs; its result is the same under any order.
    """
    bins = partitions(source.sparkSession)

    def tally(batches):
        held, size_ = [], 0

        def flush():
            key, count = np.unique(np.concatenate(held), return_counts=True)
            bin_ = (key * np.uint64(bins) >> np.uint64(40)).astype(np.int64)
            rows = []
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(bin_)) + 1):
                blob = len(part).to_bytes(4, "little") + planes(np.diff(key[part], prepend=np.uint64(0)), count[part])
                rows.append((int(bin_[part[0]]), zstandard.ZstdCompressor(level=1).compress(blob)))
            number, payload = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(payload, pa.binary())], names=["bin", "payload"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(shingle_set(text, size) >> KEY_SHIFT)
                size_ += len(held[-1])
                if size_ >= COUNTED_AT_ONCE:
                    yield flush()
                    held, size_ = [], 0
        if size_:
            yield flush()
        release()

    def top(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for blob in table.column("payload").to_pylist():
            blob = zstandard.decompress(blob)
            gaps, count = from_planes(blob, 4, int.from_bytes(blob[:4], "little"), 2)
            keys.append(np.cumsum(gaps.view(np.uint64), dtype=np.uint64))
            counts.append(count)
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, count = key[first], np.add.reduceat(count, first)
        several = np.flatnonzero(count > 1)
        several = several[np.argsort(-count[several], kind="stable")[: max(1, FREQUENT // bins)]]
        return pa.table([pa.array(key[several].astype(np.int64)), pa.array(count[several])], names=["key", "n"])

    found = source.select("text").mapInArrow(tally, "bin int, payload binary").groupBy("bin").applyInArrow(lambda t: top(t), "key long, n long").toArrow()
    key = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], found.column("n").to_numpy()[order]


def may_reach(n: np.ndarray, place: np.ndarray, m: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles whose first common one is at these places can still be similar enough."""
    return np.minimum(n - place, m - other) >= similarity / (1 + similarity) * (n + m) - 1e-9


def groups_of(batches, cols: list[str]):
    """Columns of rows sorted by key, in pieces that end where a key ends."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy() for c in cols])
        rows += batch.num_rows
        if rows > 1 << 18:
            data = [np.concatenate(x) for x in zip(*held, strict=True)]
            upto = int(np.searchsorted(data[0], data[0][-1]))  # the last key may go on
            held, rows = [[x[upto:] for x in data]], len(data[0]) - upto
            if upto:
                yield [x[:upto] for x in data]
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def verified(pairs: DataFrame, heads: DataFrame, source: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b, similar): pairs of classes compared on the whole shingle sets of their texts. heads: fp, id and mark; source: id, mark and text."""
    nodes = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    nodes = materialize(heads.join(nodes, "fp").select("fp", "id", "mark"), "nodes")
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int")
    taken = np.zeros(SLOTS, bool)
    taken[nodes.select(slot.alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    marks = source.sparkSession.sparkContext.broadcast(np.packbits(taken))

    def perhaps(batches):
        """Rows whose id may be wanted: the join decides, but few other texts are sent to it."""
        known = np.unpackbits(marks.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[batch.column("slot").to_numpy()])).select(["id", "mark", "text"])

    few = source.withColumn("slot", slot).mapInArrow(perhaps, "id long, mark long, text string")
    texts = few.join(nodes, ["id", "mark"]).select("fp", "text").dropDuplicates(["fp"])
    both = pairs.join(texts.select(F.col("fp").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("fp").alias("a"), F.col("text").alias("left")), "a")

    def decide(batches):
        last, left = None, None
        for batch in batches:
            ok = []
            for s, t in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                if s != last or left is None:
                    last, left = s, shingle_set(s, size)
                right = shingle_set(t, size)
                same = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(same >= similarity * (len(left) + len(right) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "similar"])
        release()

    return both.select("a", "b", "left", "right").mapInArrow(decide, "a long, b long, similar boolean")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, mark, head_id, head_mark) of each row with an id; mark: a hash of its text; head: the least (id, mark) of its group.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least `similarity`; every link is verified on the
    whole sets, and no such pair is left out. A group is a component of links. Rows with one set collapse. Sets whose SimHash
    fingerprints are equal or linked by link() are compared; for pairs with more differing bits, similar sets share a
    shingle of their prefixes in any one order, here from rare to frequent ones. Each set at a shingle is first compared with
    one set there; after the components of those links, sets of different components are compared where places in the order
    and sizes still allow it. Texts without words, null or not, are copies of each other. Rows that share an id are documents
    of their own. An empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0 and at most 1")
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")).where("id is not null")
    shared_order = spark.sparkContext.broadcast(frequent_shingles(source, size))

    def take(batches):
        frequent, counts = shared_order.value
        for batch in batches:
            fp, sim, n, first = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, size)
                fp.append(class_of(s))
                sim.append(fingerprint(s))
                n.append(len(s))
                first.append(prefix(s, frequent, counts, similarity).tobytes())
            names = ["id", "mark", "fp", "sim", "n", "prefix"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(fp, pa.int64()), pa.array(sim, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.binary())], names=names)
        release()

    rows = materialize(source.mapInArrow(take, "id long, mark long, fp long, sim long, n long, prefix binary"), "prefixes")
    known = materialize(rows.groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("x")).select("fp", "x.id", "x.mark"), "sets")

    def spread(batches):
        for batch in batches:
            blobs = batch.column("prefix").to_pylist()
            key, count = np.frombuffer(b"".join(blobs), np.int64), np.array([len(x) // 8 for x in blobs], np.int64)
            place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(batch.column("n").to_numpy(), count) << 32 | place  # the size of the set and the place in its order
            fp = np.repeat(batch.column("fp").to_numpy(), count)
            for a in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (key, fp, at)], names=["key", "fp", "at"])

    def meet(batches):
        """Rows of shingles that two classes share, with the class there that has it earliest and whether to compare with it."""
        for key, fp, at in groups_of(batches, ["key", "fp", "at"]):
            n, place = at >> 32, at & 0xFFFFFFFF
            order = np.lexsort((fp, place, key))
            key, fp, at, n, place = key[order], fp[order], at[order], n[order], place[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(first, len(key)))
            hub = np.repeat(first, count)
            near = (fp != fp[hub]) & may_reach(n, place, n[hub], place[hub], similarity)
            keep = np.flatnonzero(np.repeat(count > 1, count))
            for a in range(0, len(keep), 1 << 16):
                part = keep[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (key, fp, at, fp[hub], near)], names=["key", "fp", "at", "hub", "near"])
        release()

    def rest(batches):
        """Pairs at a shingle of classes in different components.

        The smaller set of a pair has the shingle early, in the first (1 - similarity) / (1 + similarity) of its order: only
        such rows look for partners, so a shingle that all its sets have late costs nothing.
        """
        for key, fp, at, label in groups_of(batches, ["key", "fp", "at", "label"]):
            order = np.lexsort((label, key))
            key, fp, label, n, place = key[order], fp[order], label[order], at[order] >> 32, at[order] & 0xFFFFFFFF

            def bounds(new):
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(new)))
                return np.repeat(first, size), np.repeat(first + size, size)

            new = np.append(True, key[1:] != key[:-1])
            start, end = bounds(new)
            own, after = bounds(new | np.append(True, label[1:] != label[:-1]))
            asks = np.flatnonzero(((n - place) * (1 + similarity) >= 2 * similarity * n - 1e-9) & ((own > start) | (after < end)))
            count = own[asks] - start[asks] + end[asks] - after[asks]
            work, a = np.cumsum(count), 0
            while a < len(asks):
                b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
                c = count[a:b]
                i = np.repeat(asks[a:b], c)
                j = start[i] + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                j += np.where(j >= own[i], after[i] - own[i], 0)
                ok = may_reach(n[i], place[i], n[j], place[j], similarity)
                x, y = fp[i[ok]], fp[j[ok]]
                if len(x):
                    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0].copy()), pa.array(pair[1].copy())], names=["a", "b"])
                a = b
        release()

    heads = rows.join(known, ["fp", "id", "mark"], "left_semi").where("n > 0").dropDuplicates(["fp"]).select("fp", "n", "prefix")
    met = heads.mapInArrow(spread, "key long, fp long, at long").repartition(4 * partitions(spark), "key").sortWithinPartitions("key")
    shared = materialize(met.mapInArrow(meet, "key long, fp long, at long, hub long, near boolean"), "shared")
    prints = materialize(rows.where("n > 0").select("fp", "sim").distinct(), "prints")
    homes_ = materialize(prints.groupBy("sim").agg(F.min("fp").alias("one")), "sims")  # a class for each fingerprint
    alike = prints.join(homes_, "sim").where("fp <> one").select("fp", F.col("one").alias("hub"))
    linked_sims = link(homes_.select(F.col("sim").alias("fp")))
    ones = [homes_.select(F.col("sim").alias(c), F.col("one").alias(o)) for c, o in (("a", "fp"), ("b", "hub"))]
    by_anchor = linked_sims.join(ones[0], "a").join(ones[1], "b").select("fp", "hub")
    met_by = alike.unionByName(by_anchor).unionByName(shared.where("near").select("fp", "hub"))
    tried = met_by.select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()
    tried = materialize(verified(tried, known, source, size, similarity), "compared")
    links = tried.where("similar").select("a", "b")
    label = components(links).select(F.col("node").alias("fp"), "component")
    named = shared.join(label, "fp", "left").select("key", "fp", "at", F.coalesce("component", "fp").alias("label"))
    left = named.repartition(4 * partitions(spark), "key").sortWithinPartitions("key").mapInArrow(rest, "a long, b long").distinct()
    left = materialize(left.join(tried, ["a", "b"], "left_anti"), "left")
    more = verified(left, known, source, size, similarity).where("similar").select("a", "b")
    linked = components(links.unionByName(more))
    whole = known.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.struct("id", "mark").alias("own"), F.coalesce("component", "fp").alias("root"))
    whole = materialize(whole, "classes")
    least = whole.groupBy("root").agg(F.min("own").alias("head"))
    by_fp = whole.join(least, "root").select("fp", F.col("head.id").alias("head_id"), F.col("head.mark").alias("head_mark"))
    return rows.select("id", "mark", "fp").join(by_fp, "fp").drop("fp")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of rows that are near copies of a row with a smaller id, as groups() finds them."""
    return groups(docs, id_col, text_col, size, similarity).where("id <> head_id").select(F.col("id").alias("doc_id"), F.col("head_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of groups(), that of the least id, with all its columns as they are.

    Rows without an id stay. Rows that share an id are documents of their own, unless their texts are equal too: of such
    repeated rows one stays, any of them where other columns differ. Columns may have any names and types. An empty table
    gives an empty result.
    """
    mark, copy_id, copy_mark = (f"_{name}_{uuid.uuid4().hex}" for name in ("mark", "id", "copy"))
    copies = groups(docs, id_col, text_col, size, similarity).where("id <> head_id or mark <> head_mark")
    copies = copies.select(F.col("id").alias(copy_id), F.col("mark").alias(copy_mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    own = F.col(id_col).cast("long")
    out = marked.join(copies, (own == F.col(copy_id)) & (F.col(mark) == F.col(copy_mark)), "left_anti")
    twice = marked.where(own.isNotNull()).groupBy(own.alias(copy_id), F.col(mark).alias(copy_mark)).count().where("count > 1").select(copy_id, copy_mark)
    if twice.limit(1).count():
        same = (own == F.col(copy_id)) & (F.col(mark) == F.col(copy_mark))
        again = out.join(twice, same, "left_semi").dropDuplicates([id_col, mark])
        out = out.join(twice, same, "left_anti").unionByName(again)
    return out.drop(mark)
