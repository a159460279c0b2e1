import datetime
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscope.llm.mixing import mix_sources, targets
from corpuscope.llm.pii import ROUNDS, pseudonymise

from .conftest import awkward


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Share, stop those above their limit, share the excess anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        scale = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] for s in stopped} | {s: left * weight[s] / scale for s in open_}
        above = [s for s in open_ if target[s] > most * sizes[s]]
        if not above:
            return target
        stopped |= set(above)


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1000, "c": 5, None: 7},
        {"b": 3, "a": 2, "é": 900, "z": 900, "Z": 10},
        {"only": 12},
        {"a": 0, "b": 50},
    ],
)
def test_targets_match_brute_force(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix_keeps_to_targets(docs_of, real):
    docs = docs_of(real)
    rows = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(real)
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in v) for s, v in by_source.items()}
    goal = brute_targets(sizes)
    for source, members in by_source.items():
        assert members[0].target == pytest.approx(goal[source])
        taken = sum(r.taken for r in members)
        assert abs(taken - goal[source]) <= max(r.size for r in members)
        assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in members)
        # Whole epochs come before the rest: no two documents differ by more than one pass.
        passes = {r.taken // r.size for r in members if r.size}
        assert max(passes) - min(passes) <= 1


def test_mix_awkward(docs_of):
    rows = [(i, t, None, [None, "a", "b"][k % 3]) for k, (i, t) in enumerate(awkward())]
    got = mix_sources(docs_of(rows), quality=F.lit(float("nan"))).collect()
    assert len(got) == len(rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mix_sources(docs_of([])).count() == 0


def test_better_documents_are_taken_first(docs_of):
    rows = [(i, "w " * 10, None, "s" if i % 2 else "t") for i in range(2000)]
    quality = F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(0.25)
    got = mix_sources(docs_of(rows), quality=quality, weights=(1, 3)).collect()
    once = [r for r in got if r.source == "s"]
    good = sum(r.taken > 0 for r in once if r.doc_id % 4 < 2)
    poor = sum(r.taken > 0 for r in once if r.doc_id % 4 >= 2)
    assert good > 3 * poor


def test_native_sql_agrees(spark, sf):
    from corpuscope.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "conversations"):
        con.sql(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, sf).toPandas()
        want = con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        a = got[columns].sort_values(columns).reset_index(drop=True)
        b = want[columns].sort_values(columns).reset_index(drop=True)
        import pandas as pd

        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def feistel(left, right, a, b, tag, key):
    for i in range(1, ROUNDS + 1):
        other = right if i % 2 else left
        text = f"{key}|{tag}|{i}|{other}"
        f = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
        if i % 2:
            left = (left + f) % a
        else:
            right = (right + f) % b
    return left, right


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_pseudonym(kind, value, key):
    digits = re.sub("[^0-9]", "", value)
    if kind == "phone":
        l, r = feistel(int(digits[-10:-5]), int(digits[-5:]), 10**5, 10**5, "phone", key)
        new = digits[:-10] + f"{l:05d}{r:05d}"
    elif kind == "card":
        low = (len(digits) - 2) // 2
        high = len(digits) - 2 - low
        l, r = feistel(int(digits[1 : 1 + low]), int(digits[1 + low : -1]), 10**low, 10**high, "card", key)
        body = digits[0] + f"{l:0{low}d}{r:0{high}d}"
        new = next(body + str(c) for c in range(10) if luhn(body + str(c)))
    elif kind == "ip":
        n = [int(x) for x in value.split(".")]
        l, r = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], 65536, 65536, "ip", key)
        return ".".join(map(str, (l // 256, l % 256, r // 256, r % 256)))
    elif kind == "ssn":
        area, group, serial = (int(x) for x in value.split("-"))
        l, r = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", key)
        area = l + 1 + (l + 1 >= 666)
        return f"{area:03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    elif kind == "date":
        form = "%Y-%m-%d" if value[4] == "-" else "%m/%d/%Y" if value[2] == "/" else "%d.%m.%Y"
        origin = datetime.date(1900, 1, 1)
        days = (datetime.datetime.strptime(value, form).date() - origin).days
        l, r = feistel(days // 4297, days % 4297, 17, 4297, "date", key)
        return (origin + datetime.timedelta(days=l * 4297 + r)).strftime(form)
    out = iter(new)
    return "".join(next(out) if c.isdigit() else c for c in value)


VALID = [
    ("card", "4539578763621486"),
    ("card", "4539-5787-6362-1486"),
    ("card", "6011 0009 9013 9424"),
    ("card", "4222222222222"),
    ("phone", "+1 (988) 555-2485"),
    ("phone", "(415) 555-2671"),
    ("phone", "212-555-0199"),
    ("ssn", "078-05-1120"),
    ("ssn", "899-99-9999"),
    ("ip", "152.143.123.131"),
    ("ip", "0.0.0.0"),
    ("date", "2000-02-29"),
    ("date", "12/31/2099"),
    ("date", "01.01.1900"),
]
INVALID = ["4539578763621487", "999.1.1.1", "2001-02-29", "13/01/2000", "666-12-1234", "000-12-1234", "1.2.3"]


def test_pseudonyms_match_brute_force(docs_of):
    rows = [(i, f"Given {value}, and again {value}.") for i, (_, value) in enumerate(VALID)]
    rows += [(100 + i, f"Not {value} at all") for i, value in enumerate(INVALID)]
    got = {r.doc_id: r for r in pseudonymise(docs_of(rows), key="k").collect()}
    for i, (kind, value) in enumerate(VALID):
        new = brute_pseudonym(kind, value, "k")
        assert got[i].text == f"Given {new}, and again {new}."
        assert [(f.kind, f.value, f.pseudonym) for f in got[i].found] == [(kind, value, new)] * 2
    for i, value in enumerate(INVALID):
        assert got[100 + i].text == f"Not {value} at all" and got[100 + i].found == []


def test_pseudonyms_are_a_permutation(docs_of):
    rows = [(i, f"card {d}") for i, d in enumerate(x for x in map(str, range(4 * 10**12, 4 * 10**12 + 900)) if luhn(x))]
    got = [r.text for r in pseudonymise(docs_of(rows), key="k").collect()]
    assert len(set(got)) == len(rows) and all(luhn(t.split()[1]) and t.startswith("card 4") for t in got)
    other = {r.doc_id: r.text for r in pseudonymise(docs_of(rows[:3]), key="other").collect()}
    assert all(other[i] not in got for i, _ in rows[:3])


def test_emails_keep_their_form_and_link(docs_of):
    rows = [(1, "write to Jo.Doe_42@mail8.example.com or"), (2, "JO.DOE_42@mail8.example.com"), (3, "jo.doe_43@mail8.example.com")]
    got = {r.doc_id: r.text for r in pseudonymise(docs_of(rows), key="k").collect()}
    form = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    assert all(form(got[i]) == form(t) for i, t in rows)
    assert got[2].lower() == got[1][9:-3].lower() and got[3] != got[2].lower()
    assert "Doe" not in got[1]


def test_pii_awkward(docs_of):
    rows = awkward()
    got = pseudonymise(docs_of(rows), key="k").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(i), t or "") for i, t in rows)
    assert all(r.found == [] and r["size"] == "z" for r in got)
    assert pseudonymise(docs_of([]), key="k").count() == 0
