import hashlib
import itertools
import random
import re
import zlib

import pytest

from bidloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain_repair(rows):
    """The cheapest repair of (role, text) rows by a table over points: (faults, illegal, cost, audit, repaired lines)."""
    seen, faults = set(), []
    for role, text in rows:
        if not WORD.search(text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if WORD.findall(text)[-1] not in ".!?" else None)
        seen.add((role, text))
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]

    def say(at, role):
        """Where a turn of this initial leads from a point of the pattern, None where it may not stand."""
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((at, role))

    def better(table, at, cost, audit, lines):
        if at is not None and (at not in table or (cost, audit) < table[at][:2]):
            table[at] = (cost, audit, lines)

    def filled(table):
        for _ in range(3):
            for at, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    better(table, say(at, role[0]), cost + 5, audit + "I", lines + [f"{role}:"])
        return table

    table = {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults):
        after = {}
        for at, (cost, audit, lines) in filled(table).items():
            better(after, at, cost + 2, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                better(after, say(at, role[:1]), cost + more, audit + "K", lines + [f"{role}:{text}"])
                for other in ("user", "assistant"):
                    better(after, say(at, other[0]), cost + more + 1, audit + "R", lines + [f"{other}:{text}"])
        table = after
    cost, audit, lines = min(v for k, v in filled(table).items() if k in ("", "a"))
    return faults, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, lines


def conversation(rng, n):
    texts = ["Yes.", "No!", "and then", "", " \n", "Why?", "é."]
    return [(i if rng.random() < 0.8 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"Say {i}.", f"Say {i}.", f"cut {i}", None])) for i in range(n)]


def shown(x):
    return " " if x is None else str(x)


def ordered(rows):
    """(turn, role, text) rows without nulls in role and text, in the operator's order."""
    rows = [(t, shown(r), shown(x)) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def expected(rows):
    rows = ordered(rows)
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    faults, illegal, cost, audit, lines = plain_repair([r[1:] for r in rows])
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def digests(spark, talks):
    turns = spark.createDataFrame([(k, *r) for k, rows in talks.items() for r in rows], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in C.digests(turns, C.report(turns, turns.select("conv_id").distinct())).collect()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    some = {i: conversation(rng, rng.randint(1, 12)) for i in range(60)}
    return some | {None: conversation(rng, 9), 900: conversation(rng, 400), 901: [(0, "user", "Hi.")] * 40 + [(1, "assistant", "Ho.")] * 3, 902: [(None, None, None)] * 3}


def test_plain_rows(spark, talks):
    assert digests(spark, talks) == {k: expected(rows) for k, rows in talks.items()}


@pytest.mark.parametrize("bits", [0, 3])
def test_conversations_of_several_pieces(spark, talks, monkeypatch, bits):
    monkeypatch.setattr(C, "PIECE_BITS", bits)
    few = {k: talks[k] for k in (*range(12), None, 901, 902)} | {900: talks[900][:70]}
    assert digests(spark, few) == {k: expected(rows) for k, rows in few.items()}


def test_blocks_and_pieces_price_alike():
    rng = random.Random(9)
    for _ in range(40):
        codes = [rng.randrange(12) for _ in range(rng.randint(1, 40))]
        whole = C.solved([C.LAYERS[c] for c in codes], C.ENDS, True)
        cut = rng.randint(0, len(codes))
        costs = [C.crossings(codes[:cut], False), C.crossings(codes[cut:], True)] if 0 < cut < len(codes) else [C.crossings(codes, True)]
        first = C.coarse(costs)[0]
        assert min(c + e for c, e in zip(costs[0][:4], first)) == whole[0].entries()[0]
        # Prices are a dual solution: no arc costs less than the fall in price.
        for block in whole:
            assert all(block.prices[i] <= c + block.prices[to] for i, arcs in enumerate(block.arcs) if block.prices[i] < C.NEVER for c, to, _ in arcs)


def test_damage_and_lost_conversations(spark):
    rows = [(k, t, r, f"Text {k} {t}.") for k in range(80) for t, r in enumerate(["system", "user", "assistant"])] + [(None, None, None, None), (7, None, "user", "A. B!")]
    lost = {}
    for k, t, r, x in rows:
        x, r = shown(x), shown(r)
        d = zlib.crc32(f"{shown(k)}:{shown(t)}".encode()) % 20
        x = "" if d == 1 else re.sub("[.!?]", "", x) if d == 2 else x
        r = "user" if d == 4 else r
        lost.setdefault(k, []).extend([(t, r, x)] * (0 if d == 0 else 2 if d == 3 else 1))
    turns = spark.createDataFrame(rows, SCHEMA)
    found = C.damaged(turns)
    assert sorted((r.conv_id or -1, r.turn or -1, r.role, r.text) for r in found.collect()) == sorted((k or -1, t or -1, r, x) for k, some in lost.items() for t, r, x in some)
    got = {r[0]: tuple(r)[1:] for r in C.digests(found, C.report(found, turns.select("conv_id").distinct())).collect()}
    assert got == {k: expected(some) for k, some in lost.items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 0, "user", "Go on"), (2, 1, "user", ""), (3, 0, "user", "Why?")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", place string")
    got = sorted(tuple(r) for r in C.repaired(turns).collect())
    assert got == [(1, 0, 0, "user", "Hello.", "R"), (1, 1, 1, "assistant", "Hi.", "R")]
    assert C.repaired(turns.limit(0)).collect() == []
    empty = turns.limit(0)
    assert C.digests(empty, C.report(empty, empty.select("conv_id"))).collect() == []
