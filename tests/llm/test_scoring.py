import hashlib
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuscope.llm import language, toxicity
from corpuscope.llm.edit_fingerprints import (
    characters,
    compare_with_next,
    fingerprints,
    from_text,
    likeness,
    near_links,
    to_text,
)
from corpuscope.llm.topk import top_k

from .conftest import awkward


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    vectors = rng.random((500, 40)) * (rng.random((500, 40)) < 0.2)
    vectors[:, 0] += 0.01
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    index = toxicity.BlockMaxIndex(np.arange(500), rng.integers(0, 2, 500), vectors)
    for _ in range(50):
        query = rng.random(40).astype(np.float32) * (rng.random(40) < 0.2)
        terms = np.flatnonzero(query)
        if not len(terms):
            continue
        place, cosine = index.nearest(terms, query[terms] / np.linalg.norm(query), 10)
        exact = index.vectors @ (query / np.linalg.norm(query))
        best = np.sort(exact[exact > 0])[::-1][:10]
        assert np.allclose(cosine, np.minimum(best, 1), atol=1e-5)
        assert np.allclose(exact[place], best, atol=1e-5)


def test_nearest_of_many_are_exact():
    # More terms than dense columns, blocks in a row and alone, and examples to leave out.
    rng = np.random.default_rng(2)
    n, width = 1_500, 3_000
    shares = 0.5 / (1 + np.arange(width) / 20)
    vectors = rng.random((n, width)) * (rng.random((n, width)) < shares)
    vectors[:, 0] += 0.01
    vectors[700:705] = vectors[3]
    vectors = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    index = toxicity.BlockMaxIndex(np.arange(n), rng.integers(0, 2, n), vectors)
    assert len(index.tail.rows) and np.array_equal(index.vectors, vectors[index.ids])
    picked, skips = [], []
    for i in range(60):
        query = vectors[i * 7].copy() if i % 2 else (rng.random(width) * (rng.random(width) < shares)).astype(np.float32)
        picked.append(query / max(np.linalg.norm(query), 1e-30))
        skips.append(int(np.flatnonzero(index.ids == i * 7)[0]) if i % 4 == 1 else -1)
    pairs = [(np.flatnonzero(q), q[np.flatnonzero(q)]) for q in picked]
    for size in (60, 1):
        for lo in range(0, 60, size):
            got = index.nearest_of(pairs[lo : lo + size], 15, skips[lo : lo + size])
            for q, skip, (place, cosine) in zip(picked[lo : lo + size], skips[lo : lo + size], got, strict=True):
                exact = index.vectors.astype(np.float64) @ q
                if skip >= 0:
                    exact[skip] = -1.0
                best = np.sort(exact[exact > 0])[::-1][:15]
                assert len(cosine) == len(best) and np.allclose(cosine, np.minimum(best, 1), atol=1e-5)
                assert skip not in place and np.allclose(exact[place], best, atol=1e-5)


def test_sums_need_no_room_for_all_postings():
    # 1.6 million postings of one text are fetched piece by piece.
    rng = np.random.default_rng(3)
    n, width, often = 800, 4_000, 400
    dense = np.zeros((n, width), np.float32)
    for term in range(width):
        dense[rng.choice(n, often, replace=False), term] = rng.random(often, dtype=np.float32) + 0.1
    postings = toxicity.Postings(n, np.full(width, often))
    for row in range(n):
        terms = np.flatnonzero(dense[row])
        postings.add(row, terms, dense[row, terms])
    terms, weights = np.arange(width), rng.random(width, dtype=np.float32)
    tracemalloc.start()
    got = postings.sums(terms, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, dense.astype(np.float64) @ weights, rtol=1e-5)
    assert not postings.sums(terms[:0], weights[:0]).any()
    assert peak < 12 << 20


def test_terms_of_texts_one_by_one():
    rows = ["", "Stone stone STONES a", "", " 12 ", "abc abcd abcde é", "x" * 40 + " stone", ""]
    raw = [r.encode() for r in rows]
    offsets = np.cumsum([0, *map(len, raw)])
    at, codes, counts = toxicity._counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, text in enumerate(raw):
        alone = toxicity._counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert codes[at == i].tolist() == sorted(alone[1].tolist())
        assert counts[at == i].tolist() == alone[2].tolist()
    # stone and stones and a, and what the first two begin with
    assert sorted(counts[at == 1].tolist()) == [1, 1, 2, 3]
    known = toxicity.Terms(np.unique(codes))
    place, found = known.find(np.concatenate([codes, codes + np.uint64(1)]))
    assert found[: len(codes)].all() and not found[len(codes) :].any()
    assert np.array_equal(known.codes[place[: len(codes)]], codes)


def test_scoring_keeps_the_index_of_the_calibration(docs_of, spark):
    rows, labels = labelled(docs_of, spark)
    model = toxicity.fit(docs_of(rows), labels)
    held = model._shared
    assert held is not None
    got = toxicity.score(docs_of([(1, "a vilestword here")]), model).collect()
    assert model._shared is held and got[0].toxicity > 0.5
    model.release()
    assert toxicity.score(docs_of([(1, "a vilestword here")]), model).collect() == got


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    from corpuscope.llm.queries import QUERIES

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, sf).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_every_term_of_every_example_counts(docs_of, spark):
    # Three toxic examples and no term with a strong chi-square: neighbours all the same.
    name = [a + b for a in "bdfgk" for b in "aeiouymn"]
    rows = [(100 + i, f"stone garden {name[i]}x quietly") for i in range(40)]
    rows += [(200 + i, f"stone rubbish {name[i]}z quietly grumpy") for i in range(3)]
    labels = spark.createDataFrame([(d, int(d >= 200)) for d, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs_of(rows), labels)
    assert len(model.index.ids) == len(rows)
    test = docs_of([(1, f"{name[17]}x quietly"), (2, f"{name[1]}z grumpy"), (3, f"{name[1]}z grumpy")])
    got = {r.doc_id: r for r in toxicity.score(test, model).collect()}
    assert got[1].evidence[0].doc_id == 117 and got[2].evidence[0].doc_id == 201
    assert got[2].toxicity == got[3].toxicity > got[1].toxicity


def test_toxicity_finds_held_out_toxic_texts(spark):
    from corpuscope.llm.queries import QUERIES

    for size, share in (("sf0.001", 1.0), ("sf0.01", 0.8), ("sf0.1", 0.9)):
        sf = f"/root/testdata/{size}"
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        got = QUERIES["op3_toxicity"](spark, sf).cache()
        assert got.where("size(evidence) = 0").count() == 0
        held = got.where("held_out").join(labels, "doc_id").collect()
        toxic = [r.predicted for r in held if r.toxic]
        clean = [r.predicted for r in held if not r.toxic]
        assert sum(toxic) >= share * len(toxic) and sum(clean) <= 0.06 * len(clean)


def labelled(docs_of, spark, n=120):
    rows = []
    for i in range(n):
        words = ["good", "words", f"name{i}", "garden", "stone"] * 6
        if i % 3 == 0:
            words[4] = words[9] = "vilestword"
        rows.append((i + 100, " ".join(words)))
    labels = [(i + 100, int(i % 3 == 0)) for i in range(n)] + [(None, 1), (100, None), (99_999, 1)]
    return rows, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_awkward(docs_of, spark):
    rows, labels = labelled(docs_of, spark)
    model = toxicity.fit(docs_of(rows), labels)
    test = docs_of([*awkward(), (40, "a VILESTWORDS here"), (41, "only good words")])
    got = toxicity.score(test, model).collect()
    assert len(got) == len(awkward()) + 2
    by_id = {r.doc_id: r for r in got}
    assert by_id[40].toxicity > 0.5 and by_id[40].evidence[0].toxic == 1
    assert by_id[41].toxicity < 0.5 and by_id[1].toxicity == by_id[2].toxicity < 0.5
    assert by_id[3].found == "x"
    assert toxicity.score(docs_of([]), model).count() == 0
    empty = toxicity.fit(docs_of([]), labels)
    assert toxicity.score(test, empty).where("toxicity between 0 and 1").count() == len(got)


def test_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    from corpuscope.llm.queries import QUERIES

    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language"](spark, sf).join(truth, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_awkward(docs_of, real):
    model = language.fit(docs_of([*real, (900, "no language", None, None), (901, None, "en", None)]))
    got = language.identify(docs_of([*awkward(), (50, "12 34 !?")]), model).collect()
    assert len(got) == len(awkward()) + 1
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].nearest_lang == by_id[2].nearest_lang == by_id[50].nearest_lang == "und"
    assert all(by_id[i].nearest_lang in model.langs for i in (3, 4, 6, 7, 8, 9, 10, 11))
    assert all(0 <= r.lang_score <= 1 for r in got)
    assert language.identify(docs_of([]), model).count() == 0
    nothing = language.fit(docs_of([]))
    assert {r.nearest_lang for r in language.identify(docs_of(awkward()), nothing).collect()} == {"und"}


def test_centroids_are_clusters_of_their_language():
    x = np.repeat(np.eye(4, language.BINS, dtype=np.float32), 5, axis=0)
    centroids, nearest = language.cluster(x, 4)
    assert np.allclose(centroids[nearest], x)


def quantised(rows):
    return {
        i: [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }


def brute_top(rows, k):
    vectors = quantised(rows)
    out = []
    for q in (i for i in vectors if i % 20 == 0):
        scores = sorted(
            (-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q
        )[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, monkeypatch):
    from corpuscope.llm import topk

    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (5, 16))
    rows = [(i, [float(x) for x in centers[i % 5] + rng.normal(0, 0.2, 16)]) for i in range(160)]
    rows[7] = (7, rows[20][1])
    rows += [(200, None), (201, [None] * 16), (220, [float("nan")] * 16), (240, [float("inf")] * 16)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (260, [0.0] * 16), (280, [])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit("x"))
    got = top_k(table, F.col("vec_id") % 20 == 0, k=20)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20)
    few = table.where("vec_id < 4")
    assert top_k(few, F.col("vec_id") % 20 == 0).count() == 3
    assert top_k(table.limit(0), F.lit(True)).count() == 0


def test_threshold_stops_early():
    from corpuscope.llm.topk import SortedLists

    vectors = np.zeros((5000, 4), np.int64)
    vectors[:, 0] = np.arange(5000)
    block = SortedLists(np.arange(5000), vectors)
    place, score = block.top(np.array([3, 0, 0, 0]), 5)
    assert block.ids[place].tolist() == [4999, 4998, 4997, 4996, 4995] and score[0] == 14997


def walk(text, moves, data):
    at, out = 0, []
    for j in range(3 * len(data)):
        c = int(data[at]) if at < len(data) else 0
        out.append(c)
        at += int(moves[j % len(moves), c])
    return out


def test_fingerprint_is_the_sampled_walk():
    from corpuscope.llm import edit_fingerprints as E

    texts = ["", "a", "abc" * 30, "the quick brown fox " * 40, "é漢" * 77, "x" * 900]
    codes = [characters(t) for t in texts]
    for text, code, (level, samples) in zip(texts, codes, fingerprints(codes), strict=True):
        written = walk(text, E._MOVES, code)
        table = E._level_table(max(1, len(written)))
        expected = [E._SYMBOL[c] for j, c in enumerate(written) if table[j] >= level]
        assert samples.tolist() == expected
        assert likeness(from_text(to_text((level, samples))), (level, samples)) == 1.0


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(2)
    base = rng.integers(97, 123, 3000).astype(np.uint8)
    texts = [base]
    for share in (0.01, 0.1, 0.5):
        other = base.copy()
        other[rng.random(3000) < share] = 63
        texts.append(np.delete(other, rng.integers(0, 3000, int(30 * share))))
    found = fingerprints([characters(t.tobytes().decode()) for t in texts])
    near = [likeness(found[0], f) for f in found]
    assert near[0] == 1 and near[1] > near[2] > near[3] > 0


def test_compare_with_next(docs_of, real):
    rows = [(a, b) for a, b, _, _ in real] + [(5000, None), (5001, ""), (5002, "é" * 10)]
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    got = {r.doc_id: r for r in compare_with_next(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for (doc, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[doc].n_chars == len(text)
        assert got[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[doc].near_next <= 1
    by_text = {}
    for doc, text in rows:
        assert by_text.setdefault(text or "", got[doc].fingerprint) == got[doc].fingerprint
    long = [r for r in got.values() if r.n_chars > 300]
    assert all(r.near_edited > 0.5 for r in long)


def test_compare_awkward(docs_of):
    rows = awkward()
    got = compare_with_next(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert compare_with_next(docs_of([])).count() == 0
    only = compare_with_next(docs_of([(1, "abcdef")])).collect()
    assert len(only) == 1 and only[0].near_next == 1.0


def test_near_links_find_copies(docs_of, spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12):
        base = "".join(chr(x) for x in rng.integers(97, 123, 800))
        rows += [(10 * i, base), (10 * i + 1, base), (10 * i + 2, base[:400] + "!" + base[401:])]
    prints = compare_with_next(docs_of(rows)).select("doc_id", "fingerprint")
    links = {(r.a, r.b) for r in near_links(prints).collect()}
    assert all((10 * i + 1, 10 * i) in links for i in range(12))
    assert sum(any({a, b} == {10 * i, 10 * i + 2} for a, b in links) for i in range(12)) >= 11
    assert all(a // 10 == b // 10 for a, b in links)
