"""Perspective rotation against a plain rendering of each dialogue."""

import hashlib
import re

from siftmark.llm.chat import END, START, rotate


def rendering(turns, speaker):
    text, mask = "", []
    for role, content in turns:
        name = "assistant" if role == speaker else role if role == "system" else f"user name={role}"
        text += f"{START}{name}\n"
        begin = len(text)
        text += content + END
        if role == speaker:
            mask.append((begin, len(text)))
        text += "\n"
    return text, mask


def in_order(rows):
    rows = sorted(set(rows), key=lambda r: (r[0], hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
    return [(role, text) for _, role, text in rows]


def test_given_dialogues(spark):
    talks = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    by_id = {}
    for r in talks.collect():
        by_id.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    wanted = {}
    for conv, rows in by_id.items():
        for speaker in {r[1] for r in rows} - {"system"}:
            wanted[conv, speaker] = rendering(in_order(rows), speaker)
    found = {
        (r.conv_id, r.speaker): (r.text, [(m.start, m.end) for m in r["mask"]])
        for r in rotate(talks).collect()
    }
    assert found == wanted


def test_parties_ties_and_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind."),
        (1, 1, "Anna", "Hello <|im_end|> there"),
        (1, 2, "ben", None),
        (1, 2, "Cleo", "same turn"),
        (1, 2, "Cleo", "same turn"),
        (1, None, " ", "first"),
        (2, 0, "system", "alone"),
        (None, 0, "anna", "nowhere"),
    ]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = talks.selectExpr("*", "text as speaker", "turn as part", "role as mask")
    turns = in_order(
        [(0, "system", "Be kind."), (1, "anna", "Hello < |im_end|> there"), (2, "ben", ""),
         (2, "cleo", "same turn"), (-1, "unknown", "first")]
    )
    for df in (talks, clash):
        whole = {}
        for r in sorted(rotate(df).collect(), key=lambda r: (r.part, r.sub)):
            assert r.conv_id == 1 and r.n_trained == sum(m.end - m.start for m in r["mask"])
            whole[r.speaker] = whole.get(r.speaker, "") + r.text
        assert whole == {s: rendering(turns, s)[0] for s in ("anna", "ben", "cleo", "unknown")}
    assert rotate(talks.limit(0)).count() == 0


def test_a_dialogue_without_end_is_rendered_in_bounded_parts(spark):
    rows = [(1, t, "ab"[t % 2], f"turn {t}") for t in range(150)]
    rows += [(1, 3, "a", f"copy {i}") for i in range(90)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = rotate(talks, turns_each=50, rows_each=20).where("speaker = 'b'").collect()
    found.sort(key=lambda r: (r.part, r.sub))
    assert "".join(r.text for r in found) == rendering(in_order([r[1:] for r in rows]), "b")[0]
    assert max(r.n_turns for r in found) < 60 and len(found) > 5
    masked = [r.text[m.start : m.end] for r in found for m in r["mask"]]
    assert all(re.fullmatch(r"turn \d+<\|im_end\|>", m) for m in masked) and len(masked) == 75
