"""Operators 2, 8 and 9 against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from vellum.llm import automaton, jaccard, runindex, simhash, windows

from .cases import SCHEMA, documents, frame

LEAST = -(1 << 63)


def order(i):
    return LEAST if i is None else i


def brute_bytes(rows, length):
    first = {}
    for i, text, *_ in rows:
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            first[k] = min(first.get(k, order(i)), order(i))
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < order(i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((order(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length,sizes", [(50, {}), (50, {"block_bytes": 20_000, "bucket_bytes": 9_000}), (50, {"block_bytes": 20_000, "bucket_bytes": 9_000, "hot": 0}), (16, {"block_bytes": 30_000, "bucket_bytes": 30_000})])
def test_byte_windows(spark, length, sizes):
    got = runindex.suffix_dedup(frame(spark), length=length, **sizes).collect()
    assert sorted((order(r[0]), *tuple(r)[1:]) for r in got) == brute_bytes(documents(), length)


def brute_words(rows, length):
    seen, out = set(), []
    for i, text in sorted({(order(r[0]), r[1] or "") for r in rows}):
        w = text.encode().split()
        gone = bytearray(len(w))
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            if k in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out += [(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] * sum(1 for r in rows if (order(r[0]), r[1] or "") == (i, text))
    return sorted(out)


@pytest.mark.parametrize("length,sizes", [(20, {}), (20, {"block_bytes": 20_000, "bucket_bytes": 5_000}), (20, {"block_bytes": 20_000, "bucket_bytes": 5_000, "hot": 0}), (6, {"block_bytes": 20_000, "bucket_bytes": 20_000})])
def test_word_windows(spark, length, sizes):
    rows = [r for r in documents() if not (r[1] or "").startswith("another text of the same id")]
    got = automaton.word_dedup(frame(spark, rows), length=length, **sizes).collect()
    assert sorted((order(r[0]), *tuple(r)[1:]) for r in got) == brute_words(rows, length)


def test_words_kept(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 1), (2, "x a b c d y e f g h", "en", "s", 1)]
    got = {r["doc_id"]: r["kept"] for r in automaton.word_dedup(frame(spark, rows), length=4, kept_text=True).collect()}
    assert got == {1: bytearray(b"a b c d e f g h"), 2: bytearray(b"x y")}


def test_run_length_index_on_random_texts():
    rng = np.random.default_rng(5)
    for n in range(20):
        texts = [rng.integers(97, 100, rng.integers(8, 60)).astype(np.uint8) for _ in range(15)]
        texts[7] = np.concatenate([texts[2], texts[3]])
        colours = rng.integers(0, 3, 15)
        others = [rng.integers(96, 101, rng.integers(1, 40)).astype(np.uint8) for _ in range(9)] + texts[5:9]
        own = rng.integers(0, 4, 13)
        got = runindex.RunLengthIndex(texts, colours, 8).stream(others, own)
        held = {(int(i), bytes(t[p : p + 8])) for t, i in zip(texts, colours, strict=True) for p in range(len(t) - 7)}
        for t, i, starts in zip(others, own, got, strict=True):
            assert starts.tolist() == [p for p in range(len(t) - 7) if (int(i), bytes(t[p : p + 8])) in held], n


def test_suffix_array():
    rng = np.random.default_rng(1)
    for top in (3, 40, 250):
        s = rng.integers(1, top, 800)
        s[rng.integers(0, 800, 30)] = 0
        s[-1] = 0
        coloured = np.where(s > 0, s + 300 * np.cumsum(s == 0), 0)
        spelled = [[(int(x), 0) if x else (0, p + k) for k, x in enumerate(coloured[p:])] for p in range(800)]
        assert runindex.suffix_array(coloured, s).tolist() == sorted(range(800), key=lambda p: spelled[p])


def test_halves_by_id_find_every_smaller_document():
    rng = np.random.default_rng(9)
    base = rng.integers(97, 123, 90).astype(np.uint8)
    view = windows.View(50, 24, False, False, 1 << 20)
    texts, ids = [], []
    for i in range(70):
        t = base.copy()
        for p in rng.integers(0, 90, int(rng.integers(0, 3))):
            if not 40 <= p < 64:
                t[p] = 65 + int(rng.integers(3))
        texts.append(t[int(rng.integers(0, 20)) : 90 - int(rng.integers(0, 12))])
        ids.append(int(rng.integers(0, 40)))
    order = sorted(range(70), key=lambda i: ids[i])
    texts, ids = [texts[i] for i in order], [ids[i] for i in order]
    mid = int(windows.gram_hashes(base[40:64], view)[0])
    got = runindex._index(windows.Candidates(view, [mid] * 70, texts, [(i, 0, 0, 0) for i in ids]))
    first = {}
    for t, i in zip(texts, ids, strict=True):
        for p in range(len(t) - 49):
            first.setdefault(bytes(t[p : p + 50]), i)
    for t, i, starts in zip(texts, ids, got, strict=True):
        assert starts.tolist() == [p for p in range(len(t) - 49) if first[bytes(t[p : p + 50])] < i]


def test_windows_that_were_found_are_not_indexed_again(monkeypatch):
    rng = np.random.default_rng(4)
    core = rng.integers(97, 123, 70).astype(np.uint8)
    view = windows.View(50, 24, False, False, 1 << 20)
    mid = int(windows.gram_hashes(core[20:44], view)[0])
    # Copies cut at both ends, so that segments differ but windows don't.
    cuts = [(int(rng.integers(0, 10)), 70 - int(rng.integers(0, 10))) for _ in range(256)]
    texts = [core[a:b] for a, b in cuts]
    indexed, plain = [0], runindex.RunLengthIndex.__init__

    def counted(self, texts, *rest):
        indexed[0] += sum(map(len, texts))
        plain(self, texts, *rest)

    monkeypatch.setattr(runindex.RunLengthIndex, "__init__", counted)
    got = runindex._index(windows.Candidates(view, [mid] * 256, texts, [(i, 0, 0, 0) for i in range(256)]))
    seen: set[int] = set()
    for (a, b), starts in zip(cuts, got, strict=True):
        assert starts.tolist() == [p - a for p in range(a, b - 49) if p in seen]
        seen |= set(range(a, b - 49))
    # Half of all at each of eight levels before.
    assert indexed[0] < 2 * sum(map(len, texts))


def test_words_whose_polynomial_hashes_are_equal_are_told_apart(spark):
    # Thue-Morse words of 2**12 letters collide under any odd base modulo 2**64.
    a = "a"
    for _ in range(12):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    assert windows.word_hashes(a.encode())[0] == windows.word_hashes(b.encode())[0]
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {rest}", "en", "s", 1), (2, f"{b} {rest}", "en", "s", 1), (3, f"{a}  {rest}", "en", "s", 1)]
    got = {r["doc_id"]: r["n_removed"] for r in automaton.word_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("operator,brute,length", [(runindex.suffix_dedup, brute_bytes, 50), (automaton.word_dedup, brute_words, 20)])
def test_one_minimiser_in_every_document(spark, operator, brute, length):
    r = np.random.default_rng(3)
    word = lambda: "w" + str(r.integers(0, 50_000))
    core = " ".join(f"core{i}" for i in range(8))
    rows = [(i, f"{' '.join(word() for _ in range(14))} {core} {' '.join(word() for _ in range(14))}", "en", "s", 1) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " " + core, "en", "s", 1) for i in range(0, 300, 7)]
    for sizes in ({}, {"block_bytes": 9_000, "bucket_bytes": 6_000}):
        got = operator(frame(spark, rows), length=length, **sizes).collect()
        assert sorted(tuple(x) for x in got) == brute(rows, length)


def brute_simhash(rows, shingle):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    out = []
    for i, text, *_ in rows:
        w = (text or "").encode().translate(lower).split()
        s = [b" ".join(w[p : p + shingle]) for p in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    return out


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(fps):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, f"{fp:016x}", least.get(find(a))) for a, (i, fp) in enumerate(fps)]


def test_simhash(spark):
    fps = brute_simhash(documents(), 3)
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_components(fps)))


def test_components_of_planted_fingerprints(spark):
    rng = np.random.default_rng(2)
    rows, chain = [], 0
    for i in range(400):
        if i % 40 == 0:
            chain = int(rng.integers(0, 1 << 63))
        chain ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
        rows.append((1000 - i, chain if i % 3 else int(rng.integers(0, 1 << 63))))
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in rows]
    found = {r["fp"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    want = {fp - (1 << 64) if fp >> 63 else fp: c for (_, fp), (_, _, c) in zip(rows, brute_components(rows), strict=True)}
    assert found == want


def test_one_document_of_each_component_stays(spark):
    kept = simhash.keep_first(frame(spark)).collect()
    comps = brute_components(brute_simhash(documents(), 3))
    assert len(kept) == len({c if c is not None else f for _, f, c in comps})
    plain = [r for n, r in enumerate(documents()) if r[0] is not None and r[0] not in {x[0] for x in documents()[:n]}]
    comps = brute_components(brute_simhash(plain, 3))
    assert sorted(r["doc_id"] for r in simhash.keep_first(frame(spark, plain)).collect()) == sorted({c for *_, c in comps})


@pytest.mark.parametrize("operator", [runindex.suffix_dedup, automaton.word_dedup, simhash.near_duplicates, simhash.keep_first])
def test_empty(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_first(rows, k=5):
    """Ids left of each component of texts with a Jaccard similarity of 0.8 or more, and the pairs of different texts."""
    low = lambda t: (t or "").encode().translate(simhash._LOWER).translate(simhash._SPACE).split()
    sets = [frozenset(tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))) if w else frozenset() for w in (low(r[1]) for r in rows)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                pairs += a != b
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(find(i), []).append((r[0] is None, r[0]))
    return sorted(map(str, (min(g)[1] for g in first.values()))), pairs


def near_copies(n=40):
    """Texts and copies of them with a similarity of about 0.7 to 0.99, among texts that share a long passage."""
    r = np.random.default_rng(5)
    word = lambda: "w" + str(r.integers(0, 5000))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        size = int(r.integers(5, 250))
        words = (passage if i % 2 else []) + [word() for _ in range(size)]
        rows.append((5000 + i, " ".join(words), "en", "s", 1))
        for j in range(3):
            edits = max(1, int(len(words) * r.uniform(0, 0.035)))
            copy = [word() if p in set(r.integers(0, len(words), edits).tolist()) else w for p, w in enumerate(words)]
            rows.append((6000 + 10 * i + j, " ".join(copy) + (" " + " ".join(word() for _ in range(size // 8)) if j == 2 else ""), "en", "s", 1))
    return rows


@pytest.mark.parametrize("hot", [2, 10**9])
def test_all_near_copies_of_the_stage_go(spark, hot):
    rows = documents() + near_copies() + near_copies(3)
    want, pairs = brute_first(rows)
    assert pairs > 60
    got = jaccard.keep_first(frame(spark, rows), hot=hot)
    assert got.columns == frame(spark).columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == want


def test_similarity_at_the_limit(spark):
    words = [f"v{i}" for i in range(400)]
    # 100 shingles against 80 of them, which is enough, and against 79, which is not.
    rows = [(1, " ".join(words[:104])), (2, " ".join(words[:84])), (3, " ".join(words[200:304])), (4, " ".join(words[200:283]))]
    got = jaccard.keep_first(frame(spark, [(*r, "en", "s", 1) for r in rows])).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4]
    assert jaccard.keep_first(frame(spark, rows[:0])).count() == 0


def test_shingles_are_ordered_by_all_rows_that_have_them(spark):
    r = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 3, int(r.integers(5, 30)))), "en", "s", 1) for i in range(400)]
    every = {}
    for _, text, *_ in rows:
        for s in jaccard.shingles(text.encode()).tolist():
            every[s] = every.get(s, 0) + 1
    df = frame(spark, rows)
    for buckets in (1, 7):
        place, n, known = jaccard.frequencies(df, "text", 5, 4, buckets)
        order = np.array(sorted(every))
        want = dict(zip(jaccard.places(order, buckets).tolist(), map(every.get, order.tolist()), strict=True))
        assert known == buckets and dict(zip(place.tolist(), n.tolist(), strict=True)) == {p: c for p, c in want.items() if c >= 4}
    keyed = df.selectExpr("doc_id as _vellum_key", "text")
    for row in jaccard.signatures(keyed, "text", 5, (4, 5), jaccard.frequencies(df, "text", 5, 1)).collect():
        s = jaccard.shingles(rows[row[0]][1].encode()).tolist()
        assert row["prefix"] == sorted(s, key=lambda x: (every[x], x))[: len(s) - -(-4 * len(s) // 5) + 1]


def test_pairs_formed_follow_the_size_of_a_cluster(spark, monkeypatch):
    r = np.random.default_rng(11)
    word = lambda: "w" + str(r.integers(0, 50_000))
    base = [word() for _ in range(200)]
    rows = [(0, " ".join(base), "en", "s", 1)]
    for i in range(1, 121):
        copy = list(base)
        for p in r.integers(0, 200, 1 + i % 3).tolist():
            copy[p] = word()
        rows.append((i, " ".join(copy), "en", "s", 1))
    formed, stored = {}, jaccard.stored

    def counted(df, name, *rest):
        out = stored(df, name, *rest)
        formed[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    assert [x["doc_id"] for x in jaccard.keep_first(frame(spark, rows)).collect()] == [0]
    # All with all were 7,260 pairs.
    assert formed.get("stars", 0) + formed["candidates"] < 600
