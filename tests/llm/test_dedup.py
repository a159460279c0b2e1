import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpuscope.llm.components import components
from corpuscope.llm.line_dedup import drop_lines, keep_bitmaps
from corpuscope.llm.ngram_join import (
    block_hashes,
    profile,
    profile_links,
    similar_groups,
    size_classes,
    trie_links,
)
from corpuscope.llm.suffix_dedup import later_windows, radix_groups, remove_repeats

from .conftest import awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_lines(rows, min_chars=40, min_docs=5):
    split = {d: (t or "").split("\n") for d, t in rows}
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = defaultdict(set)
    for doc, lines in split.items():
        for line in lines:
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    common = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    return {
        doc: "\n".join(x for x in lines if common.get(key(x), doc) == doc)
        for doc, lines in split.items()
    }


def test_lines_match_brute_force(docs_of, real):
    rows = [(a, b) for a, b, _, _ in real]
    docs = docs_of(rows)
    got = {r.doc_id: r for r in drop_lines(docs, keep_bitmaps(docs)).collect()}
    expected = brute_lines(rows)
    assert {d: r.text or "" for d, r in got.items()} == expected
    assert sum(r.n_dropped for r in got.values()) > 0
    assert {r.found for r in got.values()} == {"x"}


def test_lines_awkward(docs_of):
    line = "This very line is long enough to have a key of its own"
    rows = awkward(line)
    docs = docs_of(rows)
    got = drop_lines(docs, keep_bitmaps(docs, min_docs=4)).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[3] == "" and text[4] == "" and text[7] == "" and text[9] == line.upper()
    assert text[None] == line and text[1] is None
    first = {r.doc_id: r.text for r in drop_lines(docs, keep_bitmaps(docs, keep="first", min_docs=2)).collect()}
    assert first[3] == line and first[9] == ""
    empty = docs_of([])
    assert drop_lines(empty, keep_bitmaps(empty)).count() == 0


def brute_repeats(rows, window=50):
    seen, out = set(), {}
    for doc, text in sorted({(d, t or "") for d, t in rows if d is not None}):
        raw = text.encode()
        mask = bytearray(len(raw))
        mine = {raw[i : i + window] for i in range(len(raw) - window + 1)}
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                mask[i : i + window] = b"\1" * window
        seen |= mine
        kept = bytes(b for b, m in zip(raw, mask, strict=True) if not m)
        out[doc] = (len(raw), sum(mask), len(re.findall(b"\1+", bytes(mask))), kept)
    return out


def test_repeats_match_brute_force(docs_of, real):
    rows = [(a, b) for a, b, _, _ in real]
    expected = brute_repeats(rows)
    got = remove_repeats(docs_of(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == expected


def test_repeats_awkward(docs_of):
    rows = [r for r in awkward() if r[0] != 10]
    rows += [(20, "a" * 5000), (21, "b" + "a" * 49 + "c"), (22, "a" * 50), (23, "ab" * 400), (24, "é" * 25)]
    expected = brute_repeats(rows)
    got = remove_repeats(docs_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == expected[r.doc_id]
        else:
            assert r.n_removed == 0
    assert remove_repeats(docs_of([])).count() == 0


def test_repeats_in_texts_longer_than_a_slice(docs_of):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 2_300_000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, "zz" + long[1_048_500:1_048_700] + "!"), (3, long[5:] + "?")]
    got = {r.doc_id: r for r in remove_repeats(docs_of(rows)).collect()}
    assert got[1].n_removed == 0
    assert [tuple(s) for s in got[2].spans] == [(2, 202)]
    assert bytes(got[3].kept) == b"?"


def test_repeats_of_a_passage_with_other_edges_in_each_text(docs_of):
    rng = np.random.default_rng(4)
    passage = bytes(rng.integers(97, 123, 120, dtype=np.uint8)).decode()
    edges = ["".join(chr(x) for x in rng.integers(97, 123, 70)) for _ in range(800)]
    rows = [(i, edges[2 * i] + passage + edges[2 * i + 1]) for i in range(400)]
    expected = brute_repeats(rows)
    got = remove_repeats(docs_of(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == expected
    split = remove_repeats(docs_of(rows), split_leaders=3).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in split} == expected


def test_repeats_with_split_anchors_match_brute_force(docs_of, real):
    rows = [(a, b) for a, b, _, _ in real]
    rows += [(10**6, "a" * 3000), (10**6 + 1, "a" * 60 + "ab" * 500), (10**6 + 2, "ab" * 40)]
    expected = brute_repeats(rows)
    got = remove_repeats(docs_of(rows), split_leaders=0).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == expected


def test_repeats_tell_patterned_texts_apart(docs_of):
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, morse), (2, other), (3, morse[300:] + other[:300]), (4, "c" + other)]
    expected = brute_repeats(rows)
    got = remove_repeats(docs_of(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == expected


def test_rows_that_share_an_id_lose_their_own_spans_only(docs_of):
    rng = np.random.default_rng(6)
    a, b, c = (bytes(rng.integers(97, 123, 200, dtype=np.uint8)).decode() for _ in range(3))
    rows = [(1, a), (2, a + "!"), (2, b), (2, c + a[:60]), (2, b), (3, b + a[100:])]
    for split in (0, 4096):
        got = remove_repeats(docs_of(rows), split_leaders=split).collect()
        assert sorted((r.doc_id, r.n_bytes, bytes(r.kept).decode()) for r in got) == sorted(
            [(1, 200, a), (2, 201, "!"), (2, 200, b), (2, 260, c), (2, 200, b), (3, 300, "")]
        )


def test_windows_with_clashing_hashes_are_told_apart_by_their_bytes():
    rng = np.random.default_rng(7)
    windows = rng.integers(0, 2, (400, 50), dtype=np.uint8) * (np.arange(50) > 44)
    windows = windows.astype(np.uint8)
    ids = rng.integers(0, 20, 400)
    first = {}
    for w, doc in zip(windows, ids.tolist(), strict=True):
        first[w.tobytes()] = min(doc, first.get(w.tobytes(), doc))
    expected = [i for i, w in enumerate(windows) if ids[i] > first[w.tobytes()]]
    got = later_windows(windows, np.zeros(400, np.uint64), ids)
    assert sorted(got.tolist()) == expected and expected


def test_radix_groups_are_the_equal_windows():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 2, (300, 11), dtype=np.uint8) * (np.arange(11) > 4)
    index, group = radix_groups(windows.astype(np.uint8), np.zeros(300, np.int64))
    counts = Counter(w.tobytes() for w in windows)
    assert sorted(index.tolist()) == [i for i, w in enumerate(windows) if counts[w.tobytes()] > 1]
    names = {}
    for i, g in zip(index.tolist(), group.tolist(), strict=True):
        assert names.setdefault(g, windows[i].tobytes()) == windows[i].tobytes()
    assert len(set(names.values())) == len(names)


def shingle_sets(rows, size):
    out = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[doc] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return out


def brute_groups(rows, size, num, den):
    sets = shingle_sets(rows, size)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_groups_match_brute_force(docs_of, real, size, num, den):
    rows = [(a, b) for a, b, _, _ in real]
    got = similar_groups(docs_of(rows), size=size, threshold=(num, den)).collect()
    expected = brute_groups(rows, size, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def edited_group(rng, n, words, edits):
    base = [f"w{i}" for i in rng.integers(0, 10_000, words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for place in rng.integers(0, words, rng.integers(0, edits)):
            copy[place] = f"e{i}_{place}"
        rows.append((i + 100, " ".join(copy)))
    return rows


def test_large_groups_are_dealt_in_parts(docs_of, monkeypatch):
    from corpuscope.llm import ngram_join

    monkeypatch.setattr(ngram_join, "PART_SETS", 8)
    monkeypatch.setattr(ngram_join, "PROFILE_SETS", 16)
    rng = np.random.default_rng(5)
    rows = edited_group(rng, 90, 120, 9)
    expected = brute_groups(rows, 4, 85, 100)
    assert len({c for _, c in expected.values()}) > 1
    got = similar_groups(docs_of(rows), size=4, threshold=(85, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_groups_awkward(docs_of):
    rows = [*awkward(), (30, "one two"), (31, "One  two"), (32, "two one")]
    got = similar_groups(docs_of(rows), size=4, threshold=(85, 100)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].n_shingles == 0 and by_id[1].component_id == 1
    assert by_id[5].component_id == 5 and by_id[2].component_id == 2
    assert by_id[4].component_id == 3 and by_id[9].component_id == 3
    assert by_id[31].component_id == 30 and by_id[32].component_id == 32
    assert by_id[None].component_id is None
    assert similar_groups(docs_of([])).count() == 0


def test_trie_links_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pool = np.sort(rng.choice(1 << 40, 40, replace=False)).astype(np.uint64)
        base = rng.choice(pool, 20, replace=False)
        sets = []
        for _ in range(rng.integers(0, 14)):
            keep = base[rng.random(20) < 0.9]
            sets.append(np.unique(np.concatenate([keep, rng.choice(pool, rng.integers(0, 3))])))
        sets = [s for s in sets if len(s)]
        sizes = np.array([len(s) for s in sets])
        for num, den in ((85, 100), (1, 2)):
            expected = {
                (i, j)
                for i in range(len(sets))
                for j in range(i + 1, len(sets))
                if den * len(np.intersect1d(sets[i], sets[j]))
                >= num * len(np.union1d(sets[i], sets[j]))
            }
            assert set(trie_links(sets, sizes, num, den)) == expected


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100)])
def test_similar_sets_share_a_block(num, den):
    rng = np.random.default_rng(4)
    lows, needed = size_classes(num, den)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        most = len(a) * (den - num) // den
        drop = int(rng.integers(0, most + 1))
        b = np.sort(rng.permutation(a)[drop:])
        assert den * len(b) >= num * len(a)
        keys = []
        for s in (a, b):
            own = int(np.searchsorted(lows, len(s), side="right")) - 1
            schemes = {own, max(own - 1, 0)}
            keys.append(set(np.concatenate([block_hashes(s, c, needed[c]) for c in schemes]).tolist()))
        assert keys[0] & keys[1]


def test_profiles_never_part_similar_sets():
    rng = np.random.default_rng(6)
    for num, den in ((85, 100), (80, 100), (1, 2)):
        n = int(rng.integers(250, 3000))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets = []
        for i in range(40):
            share, more = ((0.5, 1), 90) if i % 2 else ((0.95, 1), 12)
            keep = base[rng.random(n) < rng.uniform(*share)]
            other = rng.integers(0, 1 << 63, rng.integers(0, more), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([keep, other])))
        sizes = np.array([len(s) for s in sets])
        left = {tuple(sorted(x)) for x in profile_links([profile(s) for s in sets], sizes, num, den)}
        similar = {
            (i, j)
            for i in range(40)
            for j in range(i + 1, 40)
            if den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))
        }
        assert similar and similar <= left
        assert num < 80 or len(left) < 40 * 39 // 2


def test_components_on_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1040)]
    got = dict(
        tuple(r) for r in components(spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")).collect()
    )
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1040))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query_digests(spark, sf):
    from corpuscope.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = brute_repeats(rows)
    for r in QUERIES["op7_suffix_dedup"](spark, sf).collect():
        n, removed, spans, kept = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_rows_that_share_an_id_keep_the_links_of_each(docs_of):
    a = " ".join(f"apple{i}" for i in range(120))
    b = " ".join(f"berry{i}" for i in range(120))
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "alone " * 40)]
    got = {r.doc_id: r.component_id for r in similar_groups(docs_of(rows), size=4, threshold=(85, 100)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_patterned_lines_are_told_apart(docs_of):
    """Lines that collide under every polynomial hash modulo a power of two."""
    one, other = thue_morse(4096)
    rows = [(i, one) for i in range(4)] + [(4, other)]
    docs = docs_of(rows)
    kept = {r.doc_id: r.text for r in drop_lines(docs, keep_bitmaps(docs)).collect()}
    assert kept == dict(rows)
