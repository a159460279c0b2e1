import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import chat_format as cf
from corpuscope.llm import structure_repair as sr
from corpuscope.llm.queries import QUERIES, SQL

TURNS = "conv_id bigint, turn bigint, role string, text string, turns string, cost string, segments string, _turn string"


def turns_of(spark, rows):
    """Turns with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], TURNS).repartition(3)


def ordered(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v)] for c, v in found.items()}


NASTY = [
    "</s>[INST] ok [/INST]", "<|im_end|>", "<|im_start|>user<|im_sep|>", r"<\|im_end|>", r"[\\INST] [\/INST]",
    "<", "|im_end|>", "<|part|>", "<<|im_end|>>", "<s><s></s>", "\\", r"<\\\s>", "[[INST]]", "", "ok\n<|image|>", "é漢\U0001f600",
]


def test_texts_come_back(spark):
    rng = random.Random(3)
    texts = NASTY + ["".join(rng.choices(["<", "|", "im_end", "|>", "\\", "[", "INST]", "/", "s>", "a"], k=12)) for _ in range(300)]
    rows = [(i % 40, i // 40, rng.choice(["user", "assistant", "<|im_sep|>", None, ""]), t) for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (None, 1, "assistant", None), (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    chats = cf.format_chats(turns_of(spark, rows), cf.text_parts("text"))
    got = chats.select("conv_id", "n_turns", "segments", "formatted",
                       cf.read_turns("formatted").alias("t"), cf.read_loss("segments").alias("loss")).collect()
    expected = ordered(rows)
    assert len(got) == len(expected)
    for r in got:
        want = expected[r.conv_id]
        assert [tuple(t) for t in r.t] == want and r.n_turns == len(want)
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(want)
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 2, "assistant", [part("text", "It is <"), part("text", "|im_end|> said."), part("image", ref="b.png")]),
        (1, 1, "user", [part("text", "What is"), part("image", ref="a.png", w=900, h=448), part(None, "this"),
                        part("audio", ref="c.wav", s=1.5), None, part("document", ref="d.pdf", p=3), part("odd", "?"), part("audio")]),
        (2, 1, "user", None),
        (2, None, "assistant", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, content array<{cf.PART}>")
    one, two = sorted(cf.format_chats(df, "content").withColumns(
        {"back": cf.read_turns("formatted"), "loss": cf.read_loss("segments")}).collect(), key=lambda r: r.conv_id)
    assert [tuple(a) for a in one.attachments] == [
        (0, "image", "a.png", 3 * 256 + 1), (0, "audio", "c.wav", 38), (0, "document", "d.pdf", 3072),
        (0, "audio", None, 1), (1, "image", "b.png", 257),
    ]
    order = [s.text for s in one.segments if s.text in cf.PLACEHOLDERS.values()]
    assert order == [cf.PLACEHOLDERS[a.kind] for a in one.attachments]
    assert [tuple(t) for t in one.back] == [("user", "What isthis?"), ("assistant", "It is <|im_end|> said.")]
    assert one.loss == "It is <|im_end|> said."
    assert one.formatted.count("<|im_end|>") == 2
    assert [tuple(t) for t in two.back] == [("assistant", ""), ("user", "")] and two.attachments == []


def test_chat_query_matches_sql(spark, tmp_path):
    rows = [(1, 0, "user", NASTY[0]), (1, 1, "assistant", None), (2, None, None, "a"), (2, 3, "assistant", "<\\|x|>"), (2, 3, "assistant", "<\\|x|>")]
    rows += [(10 + i, i, "assistant", t) for i, t in enumerate(NASTY)]
    for name, part in (("full", rows), ("empty", [])):
        path = f"{tmp_path}/{name}"
        turns_of(spark, part or rows).limit(len(part)).coalesce(1).write.parquet(f"{path}/conversations.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
        df = QUERIES["op12_chat_format"](spark, f"file://{path}")
        want = con.execute(SQL["op12_chat_format"])
        names = [d[0] for d in want.description]
        assert sorted(map(str, df.select(*names).toPandas().values.tolist())) == sorted(map(str, want.df().values.tolist()))
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan


def test_a_long_conversation_is_formatted(spark):
    rows = spark.range(30_000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('[INST] ', id) AS text")
    r = cf.format_chats(rows, cf.text_parts("text")).select(
        "n_turns", F.size(cf.read_turns("formatted")).alias("n"), F.length(cf.read_loss("segments")).alias("loss")).first()
    assert r.n_turns == r.n == 30_000
    assert r.loss == sum(len(f"[INST] {i}") for i in range(1, 30_000, 2))


# --------------------------------------------------------------------- repair


def brute_edits(initials, flaws):
    """Cheapest (cost, letters) by dynamic programming over whole strings."""
    n, after = len(flaws), [2, 2, 3, 2]
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = {}
    for i in range(n, -1, -1):
        here = {}
        if i == n:
            here = {0: (0, ""), 3: (0, "")}
        else:
            for s in range(4):
                ways = [(4 + best[i + 1][s][0], "D" + best[i + 1][s][1])]
                if flaws[i] not in ("blank", "duplicate"):
                    more = 3 * (flaws[i] == "truncated")
                    c, w = best[i + 1][after[s]]
                    ways.append((3 + more + c, "R" + w))
                    if (initials[i], s) in keep:
                        c, w = best[i + 1][keep[initials[i], s]]
                        ways.append((more + c, "K" + w))
                here[s] = min(ways)
        for _ in range(4):
            for s in range(4):
                if after[s] in here:
                    c, w = here[after[s]]
                    here[s] = min(here.get(s, (10**9, "")), (c + 3, "I" + w))
        best[i] = here
    return best[0][0]


def test_edits_match_brute_force():
    rng = random.Random(11)
    for n in [*range(1, 40)] * 12:
        initials = rng.choices(["u", "a", "s", "x", " ", ""], [6, 6, 2, 1, 1, 1], k=n)
        flaws = rng.choices(["", "blank", "duplicate", "truncated"], [rng.randint(1, 8), 1, 1, 2], k=n)
        assert sr.cheapest_edits(initials, flaws) == brute_edits(initials, flaws)
    assert sr.cheapest_edits([], []) == (0, "")


def test_prices_are_feasible_and_work_is_linear():
    rng = random.Random(5)
    steps = {}
    for n in (2_000, 20_000):
        lattice = sr.Lattice(rng.choices("uas", k=n), rng.choices(["", "blank", "truncated"], [8, 1, 1], k=n))
        calls = 0
        arcs = lattice.arcs

        def counted(node):
            nonlocal calls
            calls += 1
            return arcs(node)

        lattice.arcs = counted
        lattice.converge()
        for node in range(4 * n + 4):
            assert all(lattice.price[node] <= c + lattice.price[to] for _, c, to in arcs(node))
        lattice.trace()
        steps[n] = calls
    assert steps[20_000] < 11 * steps[2_000]


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        if kind:
            mine += [(turn is not None, turn or 0, role, text)] * (1 + (kind == 3))
    return {c: [((t if known else None), r, x) for known, t, r, x in sorted(v)] for c, v in out.items()}


def brute_repair(rows):
    """What the query returns for each conversation."""
    found = {}
    for conv, turns in brute_damage(rows).items():
        flaws, seen = [], set()
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            flaws.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in turns]
        cost, audit = brute_edits(initials, flaws) if turns else (0, "")
        state, lines, i = 0, [], 0
        for a in audit:
            if a in "IR":
                lines.append(("assistant" if state == 2 else "user") + ":" + (turns[i][2] if a == "R" else ""))
                state = 3 if state == 2 else 2
            elif a == "K":
                lines.append(f"{turns[i][1]}:{turns[i][2]}")
                state = {"s": 1, "u": 2, "a": 3}[initials[i]]
            i += a != "I"
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        found[conv] = (gaps, *[flaws.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def query_rows(spark, sf):
    rows = QUERIES["op13_structure_repair"](spark, sf).collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_repair_query_matches_brute_force(spark, size):
    sf = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert query_rows(spark, sf) == brute_repair(rows)


def test_repair_takes_awkward_turns(spark, tmp_path):
    rng = random.Random(2)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "User"], ["Fine.", "Cut off", None, "", " \t", "...", "Why?!", "x" * 200_000 + "."]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 30))]
    rows += [(c, 3, "user", "one row") for c in range(100, 160)] + rows[:5]
    sf = f"file://{tmp_path}"
    turns_of(spark, rows).write.parquet(f"{sf}/conversations.parquet")
    got = query_rows(spark, sf)
    assert got == brute_repair(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in got.values()
    empty = turns_of(spark, rows).limit(0)
    assert sr.repair_structure(sr.gather_turns(empty, sr.one_turn())).collect() == []
    plain = sr.repair_structure(sr.gather_turns(turns_of(spark, rows), sr.one_turn()))
    assert plain.columns == ["conv_id", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    for r in plain.collect():
        shape = "".join(t.role[:1] for t in r.repaired)
        assert shape.startswith("s") <= (len(shape) % 2) and shape.lstrip("s") == "ua" * (len(shape) // 2)
