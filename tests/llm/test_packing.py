import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpuscope.llm.packing import pack, plan, step_groups

from .conftest import awkward


def exact_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    found = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [[*x.ids, 2] for x in found]


def check(rows, pieces):
    expected = {}
    for (doc_id, text), ids in zip(rows, exact_ids([t for _, t in rows]), strict=True):
        expected.setdefault(doc_id, []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(expected)
    for doc_id, copies in expected.items():
        got = sorted(by_doc[doc_id], key=lambda p: p.start)
        ids = [np.frombuffer(p.ids, "<u4").tolist() for p in got]
        assert all(len(x) == p.length for x, p in zip(ids, got, strict=True))
        if len(copies) == 1:
            assert sum(ids, []) == copies[0]
            assert {p.doc_tokens for p in got} == {len(copies[0])}
        else:
            assert sorted(sum(ids, [])) == sorted(sum(copies, []))
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == members[0].tier <= 4096 and at & (at - 1) == 0


def test_pack_round_trip(docs_of, real):
    rows = [(a, b) for a, b, _, _ in real]
    check(rows, pack(docs_of(rows)).collect())


def test_pack_tells_patterned_words_apart(docs_of):
    """Words that collide under every polynomial hash modulo a power of two."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - x for x in bits]
    one, other = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rows = [(1, f"{one} {other}"), (2, other), (3, one)]
    check(rows, pack(docs_of(rows)).collect())


def test_pack_awkward(docs_of):
    rows = awkward()
    check(rows, pack(docs_of(rows)).collect())
    assert pack(docs_of([])).count() == 0


def test_plan_covers_everything():
    random.seed(1)
    for _ in range(400):
        sizes = [random.choice([1, 2, 64, 100, random.randint(1, 9000)]) for _ in range(random.randint(0, 12))]
        window, shortest = random.choice([64, 512, 4096]), random.choice([16, 64])
        reach = {}
        for tier, content in plan(sizes, window, shortest):
            assert tier <= window and tier & (tier - 1) == 0
            assert sum(n for _, _, n in content) == tier
            for doc, start, n in content:
                reach.setdefault(doc, []).append((start, n))
        for doc, size in enumerate(sizes):
            at = 0
            for start, n in sorted(reach[doc]):
                assert start == at and n > 0
                at += n
            assert at == size


def test_long_windows_are_filled_from_shorter_tiers():
    windows = plan([3000, 1500, 700, 300], 4096, 256)
    assert windows[0][0] == 4096 and [d for d, _, _ in windows[0][1]][:2] == [0, 2]


def test_step_groups_are_balanced():
    tiers = [4096] * 10 + [1024] * 9
    groups = step_groups(tiers, 4 * 4096)
    sums = {}
    for tier, group in zip(tiers, groups, strict=True):
        sums.setdefault(group, []).append(tier)
    assert all(len(set(v)) == 1 and sum(v) <= 4 * 4096 for v in sums.values())
    long = [len(v) for v in sums.values() if v[0] == 4096]
    assert max(long) - min(long) <= 1


def test_query_columns(spark, sf):
    from corpuscope.llm.queries import QUERIES

    rows = QUERIES["op1_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = sorted(texts)[:20]
    ids = dict(zip(some, exact_ids([texts[d] for d in some]), strict=True))
    for r in rows:
        if r.doc_id in ids:
            piece = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
            assert zlib.crc32(piece.tobytes()) == r.ids_crc32
