"""Conversation repair against a search over whole edit strings."""

import hashlib
import random
import re

import pytest

from siftmark.llm import audit_repair as a

LEGAL = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """Results by trying every edit string, cheapest and then least first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append(
            "blank" if not end else "duplicate" if (role, text) in seen
            else "truncated" if end[0] not in ".!?" else None
        )
        seen.add((role, text))
    ways = {("", ""): (0, "", ())}  # (roles so far) -> least of equal roles

    def extend(ways):
        made = {}
        for roles, way in ways:
            made.setdefault(roles, []).append(way)
        return {r: min(w) for r, w in made.items()}

    def inserts(ways):
        out = [(r, w) for r, w in ways.items()]
        for _ in range(2):
            out += [
                (r + n[0], (c + 5, e + "I", t + (f"{n}:",)))
                for r, (c, e, t) in list(out)
                for n in ("user", "assistant")
                if c < 60
            ]
        return extend(out)

    ways = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        ways = {r: w for r, w in inserts(ways).items() if LEGAL.fullmatch(r) or LEGAL.fullmatch(r + "a") or LEGAL.fullmatch(r + "ua")}
        late = 5 if fault == "truncated" else 0
        out = []
        for r, (c, e, t) in ways.items():
            out.append((r, (c + 2, e + "D", t)))
            if fault not in ("blank", "duplicate"):
                if role[:1]:
                    out.append((r + role[0], (c + late, e + "K", (*t, f"{role}:{text}"))))
                for n in ("user", "assistant"):
                    out.append((r + n[0], (c + 1 + late, e + "R", (*t, f"{n}:{text}"))))
        ways = extend(out)
    done = [w for r, w in inserts(ways).items() if LEGAL.fullmatch(r)]
    cost, audit, text = min(done)
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(text).encode()).hexdigest(),
    }


def conversation(draw, n):
    texts = ["One.", "Two!", "three", "", " \n", "Four?", "Five.  ", "six\x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "unit"]
    return [
        (draw.choice([None, *range(n)]), draw.choice(roles), draw.choice(texts) + draw.choice(["", str(draw.random()) + "."]))
        for _ in range(n)
    ]


def test_finish_equals_trying_everything():
    draw = random.Random(1)
    for n in [1, 2, 3, 5, 8, 9] * 12:
        rows = conversation(draw, n)
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
        assert a.finish(rows) == plain(rows)


@pytest.mark.parametrize("prime", [a._PRIME, 7])
def test_order_of_trails(monkeypatch, prime):
    """Also with a hash that takes different edits for equal."""
    monkeypatch.setattr(a, "_PRIME", prime)
    draw, trails = random.Random(2), a.Trails()
    nodes, texts = [0], [""]
    for _ in range(400):
        i = draw.randrange(max(0, len(nodes) - 30), len(nodes))
        mark = draw.choice("DDDK")
        nodes.append(trails.add(nodes[i], mark))
        texts.append(texts[i] + mark)
    for _ in range(4000):
        i, j = draw.randrange(len(nodes)), draw.randrange(len(nodes))
        assert trails.less(nodes[i], nodes[j]) == (texts[i] < texts[j])


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, at string")
    found = a.repair(df.repartition(parts)).collect()
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in found}, found


@pytest.mark.parametrize("block", [3, 1024])
def test_conversations_over_many_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(a, "BLOCK", block)
    draw = random.Random(3)
    whole = {i: conversation(draw, draw.randrange(1, 7)) for i in range(30)}
    whole[7] = conversation(draw, 60)  # most rows of all
    whole[7] += whole[7][:10]
    whole[None] = conversation(draw, 9)
    rows = [(i, *r, "x", "y") for i, rs in whole.items() for r in rs]
    draw.shuffle(rows)
    got, found = repaired(spark, rows)
    assert len(found) == len(whole)
    for i, rs in whole.items():
        assert got[i] == plain(rs), i


def test_odd_rows(spark):
    long = "word. " * 200_000
    rows = [
        (1, None, None, None, None, None),
        (2, 0, "user", long, None, None),
        (2, 0, "user", long, None, None),
        (2, 1, "assistant", "é中文.", None, None),
    ]
    got, _ = repaired(spark, rows)
    assert got[1] == plain([(None, " ", " ")])
    assert got[2] == plain([(0, "user", long)] * 2 + [(1, "assistant", "é中文.")])
    assert repaired(spark, [])[1] == []


def test_dropped_conversations_are_reported(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(1, 0, "user", "a."), (2, 5, "user", "b."), (2, 6, "assistant", "c.")],
        "conv_id long, turn long, role string, text string",
    )
    got = {r.conv_id: r for r in a.repair(df, dropped=F.col("conv_id") == 1).collect()}
    assert got[1].audit == "" and got[1].cost == got[1].gaps == 0
    assert got[1].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].audit == "KK"


def test_damage(spark):
    import zlib

    rows = [(i, t, "system", "A. B!") for i in range(60) for t in (None, 1)] + [(None, 2, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in a.damage(df).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.dropped))
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = [" " if role is None else role, " " if text is None else text, how == 0]
        row[1] = {1: "", 2: re.sub("[.!?]", "", row[1])}.get(how, row[1])
        row[0] = "user" if how == 4 else row[0]
        assert got[conv, turn] == [tuple(row)] * (2 if how == 3 else 1)
