import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from corpuscope.llm import spelling_variants as sv
from corpuscope.llm.queries import QUERIES

from .conftest import awkward

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_near(words):
    """Words that share a deletion, or the other word's, compared."""
    met = defaultdict(set)
    for w in words:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            met[key].add(w)
    near = defaultdict(set)
    for group in met.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def brute_variants(counts):
    near, form, out = brute_near(counts), {}, {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def as_dict(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    found = {r.word: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_query_matches_brute_force(spark, real):
    expected = brute_variants(brute_counts([r[:2] for r in real]))
    assert as_dict(QUERIES["op11_spelling_variants"](spark, "/root/testdata/sf0.001")) == expected
    assert any(v[0] for v in expected.values())


@pytest.mark.parametrize("group_pairs", [1, 8, sv.GROUP_PAIRS])
@pytest.mark.parametrize("alphabet", ["ab", "abcé"])
def test_near_pairs_match_brute_force(spark, group_pairs, alphabet):
    rng = random.Random(7)
    words = {"".join(rng.choices(alphabet, k=rng.randint(6, 10))) for _ in range(400)}
    words |= {"a" * n for n in range(6, 12)} | {"b" + "a" * 7, "a" * 7 + "b", "ab" * 40, "ab" * 40 + "a"}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    rows = sv.near_pairs(table, group_pairs).collect()
    pairs = [frozenset((r.a, r.b)) for r in rows]
    near = brute_near(words)
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in near for b in near[a]}


def test_a_shared_half_makes_no_square(spark):
    """Thousands of words with one beginning are divided, not compared with each other."""
    words = [("start" + "".join(chr(97 + (i * 7919 // 26**k) % 26) for k in range(5)),) for i in range(6000)]
    table = spark.createDataFrame(words, "word string").distinct().selectExpr("word", "5L AS n").cache()
    rows = {frozenset((r.a, r.b)) for r in sv.near_pairs(table).collect()}
    near = brute_near({r.word for r in table.collect()})
    assert rows == {frozenset((a, b)) for a in near for b in near[a]}


def test_forms_follow_to_the_root_and_ties_to_the_smallest(spark):
    counts = {
        "colour": 5, "colours": 25, "coloursx": 125, "coloursxy": 625, "coloursxyz": 3125,
        "banana": 5, "bananb": 25, "bananc": 25, "lonely": 9, "canoné": 30, "canone": 5, "canonÿ": 30,
    }
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = as_dict(sv.spelling_variants(table))
    assert got == brute_variants(counts)
    assert got["colour"][:2] == ("colours", "coloursxyz")
    assert got["banana"][0] == "bananb" and got["canone"][0] == "canoné"
    with pytest.raises(ValueError):
        sv.spelling_variants(table, factor=1)


def test_awkward_texts(spark, docs_of):
    rows = awkward() + [(20 + i, "x" * 100_000 + " ×÷Écoleß " + "Ströme, " * 3) for i in range(6)]
    got = as_dict(sv.spelling_variants(sv.word_counts(docs_of(rows))))
    assert got == brute_variants(brute_counts(rows))
    assert len(max(got, key=len)) == 100_000
    empty = sv.spelling_variants(sv.word_counts(docs_of(rows).limit(0)))
    assert empty.collect() == []
    nothing = docs_of([(1, None), (None, None), (2, "")])
    assert sv.word_counts(nothing).collect() == []
