"""The training-data operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import datetime
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelforge.llm import automaton, components, decontaminate, langid, packing, queries, quotes, simhash, sstable, subspace, suffix_array, tokens, warc, windows

DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)] + ["été", "ñandú", "字"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents with shared passages, copies, nulls, empty and long texts, a repeated id, and columns named like internal ones."""
    rng = random.Random(5)
    shared, long = prose(rng, 60), prose(rng, 4000)
    rows = [(i, prose(rng, rng.randint(1, 90))) for i in range(30)]
    rows += [(30, "a " * 200), (31, shared), (32, prose(rng, 20) + " " + shared + "\n" + prose(rng, 5)), (33, shared + " tail"), (34, None), (35, ""), (36, "  \t\n"), (37, long), (38, long[:6000]), (39, "x"), (40, long)]
    rows += [(40, long), (12, rows[12][1]), (41, "naïve <|endoftext|> text  two spaces "), (-5, shared), (None, shared), (None, None), (42, "...!?")]
    df = spark.createDataFrame([(i, t, "en", "s", i) for i, t in rows], "doc_id long, text string, shard string, id string, payload long")
    return rows, df.repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra int")


def test_suffix_array_and_kasai():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 200)
        b = bytes(rng.choice(b"ab\0\xff\xfe") for _ in range(n))
        x = np.frombuffer(b, np.uint8)
        sa, rank = suffix_array.suffix_array(x)
        want = sorted(range(n), key=lambda i: b[i:])
        assert sa.tolist() == want
        starts = np.array([0, *sorted(rng.sample(range(1, n), min(3, n - 1)))])
        lcp = suffix_array.kasai(x, sa, rank, starts, 20)
        for i in range(1, n):
            p, q = b[want[i - 1] :], b[want[i] :]
            m = next((k for k in range(min(len(p), len(q), 20)) if p[k] != q[k]), min(len(p), len(q), 20))
            assert lcp[i] == m


def test_suffix_blocks_are_merged_by_binary_search():
    rng = random.Random(4)
    contents = list(dict.fromkeys(bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 14))) for _ in range(60)))
    ids = np.arange(len(contents))
    least = {}
    for i, c in enumerate(contents):
        for a in range(len(c) - 7):
            least.setdefault(c[a : a + 8], i)
    for limit in (10**6, 50):
        for which, block in suffix_array.blocks(contents, ids, np.zeros(len(contents), np.uint64), 8, limit):
            for o, a, g in zip(block.owner, block.offset, block.group, strict=True):
                assert block.least[g] == least[contents[which[o]][a : a + 8]]


def test_op1_bytes(spark, corpus, nothing):
    rows, df = corpus
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for a in range(len(b) - 49):
            first.setdefault(b[a : a + 50], i)
    want = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for a in range(len(b) - 49):
            f = first[b[a : a + 50]]
            if f is not None and (i is None or f < i):
                gone[a : a + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        want[i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(tuple(r)[:5] for r in suffix_array.dedup_bytes(df).collect())
    assert got == want
    assert suffix_array.dedup_bytes(nothing).count() == 0


def words_without_repeats(rows):
    count = Counter()
    for _, t in rows:
        w = (t or "").encode().split()
        count.update(tuple(w[a : a + 35]) for a in range(len(w) - 34))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 34):
            if count[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = [True] * 35
        yield i, w, gone


def test_op10_words(spark, corpus, nothing):
    rows, df = corpus
    want = Counter((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for i, w, g in words_without_repeats(rows))
    assert Counter(tuple(r)[:4] for r in automaton.dedup_words(df).collect()) == want
    assert automaton.dedup_words(nothing).count() == 0


def test_op10_keeps_other_columns_and_clean_texts(spark, corpus):
    rows, df = corpus
    out = automaton.without_repeats(df)
    assert out.schema.names == df.schema.names
    got = Counter((r["doc_id"], r["text"], r["payload"]) for r in out.collect())
    for (i, t), (_, w, g) in zip(rows, words_without_repeats(rows), strict=True):
        if not any(g):
            assert got[i, t, i] >= 1
        else:
            assert any(k[0] == i and (k[1] or "").encode().split() == [x for x, y in zip(w, g, strict=True) if not y] for k in got)


@pytest.mark.parametrize("hot", [0, 30, 10**9])
def test_hot_anchors(spark, monkeypatch, hot):
    """A line in many contexts, and periodic texts: the same result whether an anchor's segments are taken apart or not."""
    monkeypatch.setattr(windows, "HOT", hot)
    rng = random.Random(17)
    line = " ".join(f"hot{i}" for i in range(12))
    tail = lambda: " ".join(rng.choice(["x", "y", "zz"]) for _ in range(40))
    rows = [(i, f"{tail()} {line} {tail()}") for i in range(120)] + [(200, "a " * 90), (201, "a " * 60), (202, "ab" * 80), (203, rows_text := f"{line} " * 6), (204, rows_text), (None, rows_text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for i, w, g in words_without_repeats(rows))
    assert Counter(tuple(r)[:4] for r in automaton.dedup_words(df).collect()) == want
    first: dict[bytes, float] = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in rows:
        b = t.encode()
        for a in range(len(b) - 49):
            first[b[a : a + 50]] = min(first.get(b[a : a + 50], float("inf")), order(i))
    want = Counter()
    for i, t in rows:
        b, gone = t.encode(), set()
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < order(i):
                gone.update(range(a, a + 50))
        want[i, len(b), len(gone), hashlib.sha256(bytes(x for n, x in enumerate(b) if n not in gone)).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_array.dedup_bytes(df).collect()) == want


def test_automaton_counts_places():
    rng = random.Random(8)
    texts = [[rng.choice("ab") for _ in range(rng.randint(1, 12))] for _ in range(12)]
    a = automaton.SuffixAutomaton()
    for t in texts:
        a.start()
        for x in t:
            a.add(x, 1)
    a.close()
    for t in texts:
        for e, (n, places) in enumerate(a.matching(t, 3)):
            assert n == e + 1
            if n >= 3:
                gram = t[e - 2 : e + 1]
                assert places == sum(u[i : i + 3] == gram for u in texts for i in range(len(u) - 2))


def ids_of(rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4")) for i, x in rows]


def test_encoder_equals_the_library():
    e = tokens.Encoder(queries.vocabulary())
    rng = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", " \n", "é", " ", " ", "\t", "1", "!", "'s", " 'll", "<|endoftext|>", "\x85", "\x1c", "字", "​", "\x00", "🎉"]
    for _ in range(1500):
        batch = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        for text, ids in zip(batch, e.encode(batch), strict=True):
            assert e.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    e = tokens.Encoder(queries.vocabulary())
    rng = random.Random(6)
    for _ in range(30):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(15))
        assert e.encode([text])[0].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e.key) <= 60


def test_op2_shards(spark, corpus, nothing):
    rows, df = corpus
    named = [(i, x) for i, x in ids_of(rows, 2)]
    manifest = sstable.store(df, queries.vocabulary(), 2)
    got = sstable.checksums(manifest).collect()
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in named)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is None, i or 0))
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    for r in manifest.collect():
        shard = sstable.Reader(r["path"])
        for key, ids, _ in shard:
            i = sstable.id_of(key)
            first = next(x for k, x, _ in shard if k == key)
            assert shard.lookup(i).tobytes() == first
        assert shard.lookup(10**12) is None
    assert sstable.read(sstable.store(nothing, queries.vocabulary(), 2)).count() == 0


def test_sstable_bloom_rarely_lies(tmp_path):
    w = sstable.Writer(str(tmp_path / "s.sst"), 2)
    for i in range(-500, 500):
        w.add(sstable.key_of(2 * i), np.arange(i % 7, dtype="<u2").tobytes())
    with pytest.raises(ValueError):
        w.add(sstable.key_of(-10**6), b"")
    w.close()
    r = sstable.Reader(str(tmp_path / "s.sst"))
    assert all(r.lookup(2 * i).tolist() == list(range(i % 7)) for i in range(-500, 500))
    assert all(r.lookup(2 * i + 1) is None for i in range(-500, 500))


def test_op3_leaks(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)]
    item = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (12, 20, 45, 6)] + ["", None, "..."]
    bench = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    docs, want = [], set()
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(5, 200))]
        k = i % 6
        if k < 4:
            w = item[k].split()
            for _ in range(int(0.2 * len(w)) if i % 2 else 0):
                w[rng.randrange(len(w))] = "edited"
            at = rng.randrange(len(text))
            text[at:at] = w
            want.add((i, k))
        docs.append((i, " ".join(text)))
    docs += [(60, None), (61, ""), (62, item[1].upper() + "!"), (62, item[1]), (None, item[2])]
    want |= {(62, 1), (None, 2)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_op3_equals_brute_force(spark, monkeypatch):
    """Pairs of short texts and items with random overlaps, by edit distances of all substrings; in one part of the benchmark and in several."""
    rng = random.Random(21)
    items = [[f"v{rng.randint(0, 9)}" for _ in range(rng.randint(1, 9))] for _ in range(12)]
    docs = []
    for i in range(60):
        text = [f"v{rng.randint(0, 9)}" for _ in range(rng.randint(0, 25))]
        if i % 2:
            w = list(rng.choice(items))
            w[rng.randrange(len(w))] = "v77"
            text[len(text) // 2 : len(text) // 2] = w
        docs.append((i, text))
    want = {(d, m) for d, text in docs for m, item in enumerate(items) if decontaminate.alignment(item, text)[0] <= int(0.2 * len(item) + 1e-9)}
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(m, " ".join(w)) for m, w in enumerate(items)], "item_id long, text string")
    for limit in (64 << 20, 100):
        monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", limit)
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()} == want
        assert {r["doc_id"] for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_op3_finds_edits_wherever_they_are(spark):
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 14, 40, 60, 100) for _ in range(8)]
    docs = []
    for item in items:
        n, k = len(item), len(item) // 5
        ends = [*range(k - k // 2), *range(n - k // 2, n)]
        for spots in (rng.sample(range(n // 2), k), rng.sample(range(n), k), ends, range(0, 5 * k, 5)):
            for how in ("delete", "insert", "replace"):
                w = item.copy()
                for at in sorted(spots, reverse=True):
                    w[at : at + (how != "insert")] = [] if how == "delete" else ["edited"]
                text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
                cut = rng.randint(0, len(text))
                docs.append((len(docs), " ".join(text[:cut] + w + text[cut:])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert {(i, i // 12) for i in range(len(docs))} <= got
    assert decontaminate.clean(df, bench).count() == 0


def test_reaches_is_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        item, text = ([rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for _ in range(2))
        masks = {x: sum(1 << i for i, y in enumerate(item) if x == y) for x in item}
        cost = decontaminate.alignment(item, text)[0]
        assert [decontaminate.reaches(masks, len(item), k, text) for k in range(len(item) + 1)] == [cost <= k for k in range(len(item) + 1)]


def test_alignment_is_edit_distance():
    rng = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(60):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(1, 7))] for _ in range(2))
        cost, first, end = decontaminate.alignment(a, b)
        assert cost == min(distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert distance(a, b[first:end]) == cost


def test_op4_round_trip(spark, monkeypatch):
    big = "x" * 700_000 + "é"
    rows = [(1, "u", big), (2, "u", big), (3, None, big), (4, "u v", None), (5, "u", ""), (6, "a", "short"), (7, "a", "short"), (None, "n", big), (8, "é\r\nX: y", "y" * 1000), (9, "z", "y" * 1000), (9, "z", "y" * 1000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = Counter(tuple(r) for r in warc.digests(warc.read_chunks(warc.store(pages))).collect())
    largest = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, -1), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        target = largest[h] if i is not None and h in largest and largest[h] != i else None
        want[i, len(b), hashlib.sha1(b).hexdigest(), "response" if target is None else "revisit", target] += 1
    assert got == want
    chunks = warc.read_chunks(warc.store(pages))
    assert chunks.select(F.max(F.length("data")).alias("n")).first()["n"] <= warc.CHUNK
    table = chunks.collect()
    ids = {(r["archive"], r["record"]): (r["record_id"], r["page_id"]) for r in table}
    assert len(ids) == len(rows) and len(set(ids.values())) == len(rows) - 1  # two rows are equal
    assert {r["refers_to_id"] for r in table if r["refers_to_id"]} <= {i for i, _ in ids.values()}
    parts = {}
    for r in sorted(table, key=lambda r: (r["archive"], r["record"], r["chunk"])):
        state = parts.setdefault((r["archive"], r["record"]), hashlib.sha1())
        state.update(r["data"])
        assert r["digest_so_far"] == state.hexdigest()
    monkeypatch.setattr(warc, "TARGETS", 0)
    assert Counter(tuple(r) for r in warc.digests(warc.read_chunks(warc.store(pages))).collect()) == want
    assert warc.digests(warc.read_chunks(warc.store(pages.limit(0)))).count() == 0


def bits(text, size=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, near):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i][j] and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_op5_links(spark, corpus, nothing):
    rows, df = corpus
    fp = [bits(t) for _, t in rows]
    near = [[(a ^ b).bit_count() <= 3 for b in fp] for a in fp]
    label = classes(len(rows), near)
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fp, label, strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_anchors_cover():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flipped = fp.copy()
    for _ in range(3):
        flipped ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    keys, where = simhash.replicas(flipped)
    reach = [set(keys[where == i].tolist()) for i in range(300)]
    homes = simhash.homes(fp)
    assert all(int(homes[0][i]) in reach[i] or int(homes[1][i]) in reach[i] for i in range(300))
    assert max(map(len, reach)) <= 34


def test_near_copies_at_four_fifths(spark):
    rng = random.Random(11)
    base = [[rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(300)] for _ in range(15)]
    rows = []
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        edited = w.copy()
        for _ in range(3):
            edited[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(edited)))
    rows += [(200, None), (201, " "), (None, " ".join(base[0]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    kept = [r["doc_id"] for r in simhash.representatives(df).collect()]
    assert sorted(kept, key=lambda i: (i is None, i or 0)) == [*range(15), 200, None]
    assert simhash.representatives(df.limit(0)).count() == 0


def test_near_copies_are_verified_exactly(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        w = [f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(rng.choice((120, 240, 400)))]
        for _ in range(3):
            x = w.copy()
            for at in rng.sample(range(len(x)), max(1, round(len(x) * rng.choice((0.006, 0.009, 0.011, 0.013, 0.016, 0.02))))):
                x[at] = f"new{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(x)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    least = list(range(len(rows)))
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(4):
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    want = {i: c for i, c in enumerate(least) if i != c}
    assert 20 < len(want) < 110
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


ODD = "doc_id long, text string, ts timestamp, m map<int,double>, f float, b binary, s struct<p:int,q:struct<r:string,t:int>>, copy_ string, id string, fp int, `a.b` string, mark date"


def odd_rows(texts):
    """Rows with an id of 1 or none, columns of many types and names that operators might use."""
    values = [
        (datetime.datetime(2020, 1, 1, 1, 2, 3, 123456), {1: 2.5}, float("nan"), bytearray(b"\x00\xff"), (1, ("x", None)), "a", "b", 1, "c", datetime.date(1900, 1, 1)),
        (datetime.datetime(1900, 1, 1, 1, 2, 3, 999999), {}, None, bytearray(b""), (None, ("y", 2)), None, None, None, None, None),
        (None,) * 10,
    ]
    return [(1 if i % 4 else None, t, *values[i % 3]) for i, t in enumerate(texts)]


def rows_of(df):
    return Counter(repr(r) for r in df.collect())


def test_rows_keep_their_columns_and_are_judged_by_themselves(spark):
    rng = random.Random(13)
    base = prose(rng, 60)
    texts = [prose(rng, 40), base + " a b c", "other words here " + base, prose(rng, 45), None, "", prose(rng, 50)]
    df = spark.createDataFrame(odd_rows(texts), ODD)
    kept = simhash.representatives(df)  # rows 1 and 2 share an id and are near copies; 5 has no words
    assert kept.schema == df.schema
    one, other = (rows_of(df.where(~F.coalesce(F.col("text") == t, F.lit(False)))) for t in (texts[1], texts[2]))
    assert rows_of(kept) in (one, other)
    cut = automaton.without_repeats(df)
    assert cut.schema == df.schema
    assert rows_of(cut.drop("text")) == rows_of(df.drop("text"))
    assert Counter(r["text"] for r in cut.collect()) == Counter([*texts[:1], " a b c".lstrip(), "other words here ", *texts[3:]])
    bench = spark.createDataFrame([(1, texts[3])], "item_id long, text string")
    assert rows_of(decontaminate.clean(df, bench)) == rows_of(df.where(F.coalesce(F.col("text") != texts[3], F.lit(True))))


def test_near_copies_of_a_whole_table(spark):
    """All documents of a given table against exact similarities of all pairs that share a shingle."""
    docs = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in docs.collect()}
    holders: dict[int, list[int]] = {}
    for i, s in rows.items():
        for h in s:
            holders.setdefault(h, []).append(i)
    shared: Counter = Counter()
    for ids in holders.values():
        shared.update((a, b) for x, a in enumerate(ids) for b in ids[x + 1 :])
    empty = [i for i, s in rows.items() if not s]
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(rows[a]) + len(rows[b]) - n) - 1e-9] + [(empty[0], b) for b in empty[1:]]
    label = {i: i for i in rows}
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sum(label[i] != i for i in rows) > 20
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()} == {i: c for i, c in label.items() if i != c}


def test_near_copies_of_filler_texts(spark):
    """Sets decide, not majorities: texts that share one repeated word are no copies."""
    rng = random.Random(14)
    rows = [(i, " ".join(["same"] * 120) + " " + prose(rng, 90)) for i in range(6)]
    df = spark.createDataFrame([*rows, (6, rows[2][1] + " more")], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.representatives(df).collect()} == set(range(6))
    assert {r["doc_id"] for r in simhash.representatives(df, similarity=0.999).collect()} == set(range(7))


def test_counted_shingles_are_exact(spark):
    rng = random.Random(15)
    common = prose(rng, 30)
    texts = [f"{prose(rng, 20)} {common}" for _ in range(40)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    keys, counts = simhash.frequent_shingles(df, 5)
    want = Counter(x >> 24 for t in texts for x in set(simhash.shingle_hashes(t, 5).tolist()))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: n for k, n in want.items() if n > 1}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 50), rng.randint(0, 50)) for _ in range(30)] + [(7, 7), (None, 3)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for a, b in pairs if None not in (a, b) and a != b for x in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    near = [[False] * len(nodes) for _ in nodes]
    for a, b in pairs:
        if None not in (a, b) and a != b:
            near[at[a]][at[b]] = near[at[b]][at[a]] = True
    assert got == {n: nodes[c] for n, c in zip(nodes, classes(len(nodes), near), strict=True)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op6_packing(spark, corpus, nothing):
    rows, df = corpus
    docs = ids_of(rows, 0)
    got = packing.pack(df, queries.vocabulary(), 256).collect()
    want = Counter()
    for i, ids in docs:
        head = len(ids) % 256 or min(256, len(ids))
        edges = [0, *range(head, len(ids) + 1, 256)]
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(x) for _, x in docs)
    assert len(sequences) <= -(-total // 256) * 1.1 + 1
    assert packing.pack(nothing, queries.vocabulary()).count() == 0


def test_packing_plan_fills_exactly():
    plan = packing.Plan({60: 10, 40: 10, 50: 4, 30: 3, 20: 3}, 100)
    assert plan.sequences == 14  # 10 pairs, 2 halves, and 150 in two
    used = Counter()
    for lengths, times in plan.patterns:
        assert sum(lengths) <= 100
        for n in lengths:
            used[n] += times
    assert used == Counter({60: 10, 40: 10, 50: 4, 30: 3, 20: 3})
    with pytest.raises(ValueError):
        packing.Plan({101: 1}, 100)


def test_op7_threads(spark):
    rows = [
        (1, 0, "user", "Hello there.\n\nHow are  you?"),
        (1, 1, "a", "On Monday Bob wrote:\n> how are you?\nFine."),
        (1, 2, "u", "> > How are you?\n> Fine.\nGood!"),
        (1, 3, "u", "> Good!\n> unknown\nok"),
        (1, 4, "u", "> Hello there.\nagain"),
        (2, 0, "u", "> Hello there.\nother conversation"),
        (1, None, "u", "> Good!"),
        (None, 3, None, None),
        (3, 5, "u", "> later\nfirst"),
        (3, 6, "u", "later"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, passages string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["root_turn"], r["depth"], r["n_quotes"], r["own_text"]) for r in quotes.conversations(df).collect()}
    assert got == {
        (1, 0): (None, 0, 0, 0, "Hello there.\n\nHow are  you?"),
        (1, 1): (0, 0, 1, 1, "Fine."),
        (1, 2): (1, 0, 2, 2, "Good!"),
        (1, 3): (2, 0, 3, 1, "ok"),
        (1, 4): (0, 0, 1, 1, "again"),
        (2, 0): (None, 0, 0, 1, "other conversation"),
        (1, None): (None, None, 0, 1, ""),
        (None, 3): (None, 3, 0, 0, ""),
        (3, 5): (None, 5, 0, 1, "first"),
        (3, 6): (None, 6, 0, 0, "later"),
    }
    assert quotes.conversations(df.limit(0)).count() == 0


def test_op7_equals_brute_force(spark, monkeypatch):
    """Conversations with planted quotes, short lines among them that many messages share: against a search of all earlier messages."""
    rng = random.Random(31)
    rows, said, want = [], {}, {}
    for conv in range(6):
        turns = sorted(rng.sample(range(200), 40))
        for at, turn in enumerate(turns):
            own = [rng.choice(["ok", "Sure.", f"line {rng.randint(0, 500)} of {conv}"]) for _ in range(rng.randint(1, 3))]
            quoted = []
            for level in rng.sample([1, 2], rng.randint(0, 2)) if at else []:
                lines = said[conv, rng.choice(turns[:at])]
                quoted.append((level, lines if rng.random() < 0.7 else [rng.choice(lines)]))
            text = "\n\n".join(["\n".join("> " * level + x.upper() for x in lines) for level, lines in quoted] + ["\n".join(own)])
            said[conv, turn] = own
            rows.append((conv, turn, "u", text))
            best = None
            for level, lines in quoted:
                asked = [(True, lines)] + ([(False, [x]) for x in lines] if len(lines) > 1 else [])
                for whole, part in asked:
                    for earlier in turns[:at]:
                        mine = said[conv, earlier]
                        if [x.casefold() for x in part] in ([x.casefold() for x in mine], *([x.casefold()] for x in mine)):
                            best = max(best or (-9,), (-level, whole, earlier))
            want[conv, turn] = best[2] if best else None
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sum(v is not None for v in want.values()) > 100
    assert {(r["conv_id"], r["turn"]): r["reply_to"] for r in quotes.conversations(df).collect()} == want
    asked = df.select("conv_id", F.lit(b"k").alias("key"), "turn")
    few = asked.where("turn % 7 = 0")
    got = {(r["conv_id"], r["turn"]): r["origin"] for r in quotes.nearest(asked, few, span=16).collect()}
    assert got == {(c, t): max((u for d, u, *_ in rows if d == c and u < t and u % 7 == 0), default=None) for c, t, *_ in rows}


def test_op7_long_thread(spark):
    rows = [(1, i, "u", f"> line {i - 1} of it\nline {i} of it" if i else "line 0 of it") for i in range(40)]
    got = {r["turn"]: (r["root_turn"], r["depth"]) for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (0, i) for i in range(40)}


def test_op8_links(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 24))
    near = base[:60] + rng.normal(size=(60, 24)) * 0.2
    x = np.concatenate([base, near, near[:20] + rng.normal(size=(20, 24)) * 0.2, base[:10], base[:5] * 3]).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] + [1.0] * 23, 1), (1003, [None] + [1.0] * 23, 1), (1004, [float("inf")] * 24, 1), (1005, [], 1), (None, x[0].tolist(), 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in subspace.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = classes(len(x), link.tolist())
    for i in range(len(x)):
        assert got[i] == (int(link[i].sum()), label[i], label[i] == i)
    for i in (*range(1000, 1006),):
        assert got[i] == (0, i, True)
    assert (got[None], got[1006], got[1007]) == ((0, None, None), (1, 1006, True), (1, 1006, False))
    assert subspace.near_duplicates(df.limit(0)).count() == 0


def test_op8_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(subspace, "TILE_ROWS", 64)  # 32 tiles
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = (np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 32)) * 0.25).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in subspace.near_duplicates(df).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(20):
        label = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
    assert link.sum() > 10_000
    assert got == [(i, int(link[i].sum()), int(label[i])) for i in range(len(x))]


def test_op8_compares_few_pairs_of_clusters():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(400, 32)) * np.array([6.0] + [1.0] * 31)
    x = np.repeat(centres, 10, axis=0) + rng.normal(size=(4000, 32)) * 0.05
    u = subspace.unit(x)
    turned = (u @ subspace.rotation(32)).astype(np.float32)
    tally, found = [0], set()
    for i, j in subspace.linked(u, u, turned, turned, 0.99, tally):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    near = np.argwhere(u @ u.T >= 0.99)
    assert found == set(map(tuple, near.tolist()))
    assert tally[0] < 0.6 * 2 * len(x) ** 2  # two blocks of all pairs


def test_op9_accuracy_and_rejection(spark):
    rng = random.Random(3)
    kinds = {"aa": ["bala", "kola", "mira", "tona", "suna"], "bb": ["schtag", "wirk", "zunft", "kraft", "pfund"], "cc": ["eaux", "iere", "oisse", "tion", "elle"]}
    text = lambda k: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(60))
    rows = [(i, text(k), k) for i, k in enumerate(rng.choice(sorted(kinds)) for _ in range(300))]
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "123 ... !", "bb"), (303, text("aa"), None), (None, text("bb"), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.fit(df.where("doc_id % 2 = 0"))
    assert sorted(model) == ["aa", "bb", "cc"]
    got = {r["id"]: r for r in langid.identify(df, model).collect()}
    held = [(i, k) for i, _, k in rows[:300] if i % 2]
    assert sum(got[i]["lang_pred"] == k for i, k in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i in (300, 301, 302):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[303]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb"
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i, _, _ in rows[:300] if not got[i]["rejected"]}
    assert {r["rejected"] for r in langid.identify(df, {}).collect()} == {True}
    assert langid.identify(df.limit(0), model).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    table = {"op4_warc": "pages", "op7_quotations": "conversations", "op8_subspace": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{DATA}/{table}.parquet").count()
    got = df.count()
    assert got == n if name not in ("op3_decontamination", "op6_packing") else got > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        assert 0.5 * n <= docs.count() <= n
        n = docs.count()
    texts = [r["text"] for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts)
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_tables(spark, tmp_path, empty):
    """Nulls in every column, empty and blank texts, repeated rows, extra and clashing columns; and an empty table."""
    import corpus_pipeline

    rng = random.Random(7)
    rows = [(i, prose(rng, 80), "en" if i % 3 else None, "s", 1) for i in range(20)]
    rows += [(20, None, None, None, None), (None, prose(rng, 50), "en", "s", 2), (21, "", "en", "s", 0), (22, " \n ", "en", None, 3), (3, rows[3][1], "en", "s", 4), (23, rows[4][1], "en", "s", 5), (24, "123 !!", "en", "s", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("extra", F.lit("x")).withColumn("fp", F.lit(None).cast("int"))
    (df.limit(0) if empty else df).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[5][1]), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.schema.names == df.schema.names
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.count() == len(texts)
    assert empty or texts[3] == rows[3][1]
    kept = set(texts)
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count()
    assert packed == len(kept)
    assert kept == (set() if empty else {*range(20), None} - {5})


def test_encoder_asks_little_of_plain_words(monkeypatch):
    """Plain pieces are looked at together; tables stay sorted as they grow and are cut; ids are the library's."""
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    code = tokens.Encoder(queries.vocabulary())
    asked, sure = [], code.sure
    monkeypatch.setattr(code, "sure", lambda piece: asked.append(piece) or sure(piece))
    for n in range(6):
        text = "first " + " ".join(f"word{n}x{i} caf\u00e9{i}" for i in range(8)) + " a  b"
        assert code.encode([text, None])[0].tolist() == code.whole(text).tolist()
        assert (code.key[1:] > code.key[:-1]).all() and len(code.number) <= 40
    assert not any(piece.startswith("word") for piece in asked)


def test_near_copies_come_through_simhash(spark, monkeypatch):
    """The stage meets texts by their fingerprints' anchors; links found there are verified before they count."""
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"])), (3, " ".join(f"v{i}" for i in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, link = [], simhash.link
    monkeypatch.setattr(simhash, "link", lambda fps, *a: seen.append({r["fp"] for r in fps.collect()}) or link(fps, *a))
    assert [tuple(r) for r in simhash.similar(df).collect()] == [(2, 1)]
    assert seen == [{simhash.fingerprint(simhash.shingle_set(text, 5)) for _, text in rows}]
