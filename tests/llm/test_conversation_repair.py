"""Conversation repair against a plain search over all edit strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from motorisk.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        told = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)
        out.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_ways(rows, flaws, i=0, roles=""):
    """(cost, audit, repaired) of every useful edit string, without any shared state."""
    if len(roles) > 1 and not re.match(r"s?(ua)*u?\Z", roles):
        return
    if i == len(rows) and LEGAL.match(roles):
        yield 0, "", []
    if len(roles) < 2 * len(rows) + 2:
        for role in ("user", "assistant"):
            for c, a, r in all_ways(rows, flaws, i, roles + role[0]):
                yield c + 3, "I" + a, [(role, ""), *r]
    if i == len(rows):
        return
    for c, a, r in all_ways(rows, flaws, i + 1, roles):
        yield c + 4, "D" + a, r
    if flaws[i] in ("blank", "duplicate"):
        return
    more = 3 if flaws[i] else 0
    role, text = rows[i]
    if role:
        for c, a, r in all_ways(rows, flaws, i + 1, roles + role[0]):
            yield c + more, "K" + a, [(role, text), *r]
    for new in ("user", "assistant"):
        for c, a, r in all_ways(rows, flaws, i + 1, roles + new[0]):
            yield c + 3 + more, "R" + a, [(new, text), *r]


def by_table(rows, flaws):
    """(cost, audit) by a table filled from the last row back: for conversations too long for ``all_ways``."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {s: [(0, "")] if s in ("", "a") else [] for s in ("", "s", "u", "a")}
    after["u"], after["s"] = [(3, "I")], [(6, "II")]
    for i in range(len(rows) - 1, -1, -1):
        here = {}
        for s in after:
            ways = [(c + 4, "D" + a) for c, a in after[s]]
            if flaws[i] not in ("blank", "duplicate"):
                more = 3 if flaws[i] else 0
                if (s, rows[i][0][:1]) in step:
                    ways += [(c + more, "K" + a) for c, a in after[step[s, rows[i][0][:1]]]]
                for new in "ua":
                    if (s, new) in step:
                        ways += [(c + more + 3, "R" + a) for c, a in after[step[s, new]]]
            here[s] = ways
        for _ in range(4):                          # inserted turns, more than can be of use
            here = {s: [min(w + [(c + 3, "I" + a) for new in "ua" if (s, new) in step for c, a in here[step[s, new]]])] for s, w in here.items()}
        after = here
    return after[""][0]


def codes_of(rows):
    return [(cr.LETTERS.index(role[0]) if role[:1] in ("s", "u", "a") else 3) + 4 * cr.FAULTS.index(f) for (role, _), f in zip(rows, faults(rows))]


def made(r, n):
    return [(r.choice(["user", "assistant", "system", "tool", "user", "assistant"]), r.choice(["Yes.", "No", " ", "What?", f"It is {r.random()}.", f"It is {r.random()}"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_search_against_all_strings(seed):
    r = random.Random(seed)
    rows = made(r, r.randrange(0, 5))
    cost, audit, _ = min(all_ways(rows, faults(rows)), key=lambda w: (w[0], w[1]))
    got, path, after = cr.search(codes_of(rows), cr.START, cr.CLOSING)
    assert (got, path + cr.CLOSING_EDITS[after]) == (cost, audit) == by_table(rows, faults(rows))


@pytest.mark.parametrize("seed", range(20))
def test_blocks_make_the_same_string(seed):
    r = random.Random(100 + seed)
    rows = made(r, r.randrange(1, 40))
    codes, size = codes_of(rows), r.randrange(1, 8)
    pieces = [codes[i:i + size] for i in range(0, len(codes), size)]
    for ends in (False, True):
        blocks = [list(cr.crossings(p, ends and i == 0, ends and i == len(pieces) - 1)) for i, p in enumerate(pieces)]
        assert "".join(cr.best_edits(blocks)) == by_table(rows, faults(rows))[1]


def test_long_block_of_one_role():
    rows = [("user", f"{i}.") for i in range(400)]
    cost, path, after = cr.search(codes_of(rows), cr.START, cr.CLOSING)
    assert (cost, path + cr.CLOSING_EDITS[after]) == by_table(rows, faults(rows))


def expected(table):
    """The contract's columns by plain Python; rows are (conv_id, turn, role, text)."""
    convs = {}
    for c, t, role, text in table:
        convs.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[c] += [(t is not None, t or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, rows in convs.items():
        rows.sort()
        turns = {t for known, t, _, _ in rows if known}
        rows = [r[2:] for r in rows]
        flaws = faults(rows)
        cost, audit = by_table(rows, flaws)
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(flaws.count(x) for x in ("blank", "duplicate", "truncated")),
                  pairs, cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in played(rows, audit)).encode()).hexdigest())
    return out


def played(rows, audit):
    out, i = [], 0
    for e in audit:
        nxt = "user" if not out or out[-1][0][0] != "u" else "assistant"
        if e == "I":
            out.append((nxt, ""))
            continue
        if e == "K":
            out.append(rows[i])
        elif e == "R":
            out.append((nxt, rows[i][1]))
        i += 1
    return out


def result(df):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in cr.damaged_and_repaired(df).collect()}


def corpus(seed, n, most):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "user", "assistant", "system", "", None]),
                         r.choice(["Hello.", f"It is {r.random()}!", f"It is {r.random()}", None, "", " \t\x0b", "é?\n", "Ends. "])))
    return rows


def test_query_against_plain_python(spark):
    rows = corpus(1, 150, 12) + [(None, 1, "user", "x."), (None, None, "assistant", "y.")] + [(900, 3, "assistant", "same.")] * 5 + [(901, None, None, None)]
    rows += [(902, t, "tool", "z " * 50_000 + ".") for t in range(3)] + [(903 + i, 0, "user", f"{i}.") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df) == expected(rows)


def test_long_conversations_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_ROWS", 16)
    rows = corpus(2, 3, 900) + corpus(3, 40, 6)
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(6)) == expected(rows)


def test_clashing_names_and_empty_table(spark):
    df = spark.createDataFrame(corpus(4, 20, 6), SCHEMA)
    assert result(df.selectExpr("*", "1 as pos", "2 as Block", "3 as edits", "4 as codes", "5 as tie")) == result(df)
    assert cr.damaged_and_repaired(df.limit(0)).count() == 0


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert result(df) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
