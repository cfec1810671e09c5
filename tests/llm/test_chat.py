import random
from collections import defaultdict

from flowsight.llm.chat import rotate

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    """The whole dialogue and the mask of each (conversation, participant)."""
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((1 << 62 if turn is None else turn, role or "unknown", text or ""))
    out = {}
    for conv, turns in talks.items():
        for who in {t[1] for t in turns}:
            text, mask = "", []
            for _, role, body in sorted(turns):
                text += "<|assistant|>" if role == who else f"<|user name={role}|>"
                if role == who:
                    mask.append(f"{len(text)}:{len(text) + len(body) + 7}")
                text += body + "<|end|>\n"
            out[conv, who] = (text, ",".join(mask))
    return out


def joined(found):
    parts = defaultdict(list)
    for r in found:
        parts[r.conv_id, r.perspective].append(r)
    out = {}
    for key, rows in parts.items():
        rows.sort(key=lambda r: r.part)
        assert [r.part for r in rows] == list(range(len(rows)))
        text = ""
        for r in rows:
            assert r.start == len(text)
            text += r.text
        out[key] = (text, ",".join(r.mask for r in rows if r.mask))
    return out


def made(n):
    rng = random.Random(n)
    roles = ["ann", "bob", "Çem", None]
    rows = [(rng.randint(0, 9), rng.randint(0, 30), rng.choice(roles), "".join(rng.choices("ab é🙂", k=rng.randint(0, 9)))) for _ in range(n)]
    return rows + [(1, None, "ann", "last"), (None, 3, "bob", "no id"), (None, 1, "ann", None), (2, 5, "bob", "x" * 50_000)] + rows[:3]


def test_equals_plain_version(spark):
    rows = made(300)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'s' AS conv", "'s' AS block", "'s' AS perspective", "'s' AS part")
    for part in (4, 256):
        assert joined(rotate(df, part=part).collect()) == plain(rows)


def test_counts_of_turns(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a", "z")], TURNS)
    assert {(r.perspective, r.n_turns, r.n_own) for r in rotate(df).collect()} == {("a", 3, 2), ("b", 3, 1)}


def test_crowded_blocks_keep_every_turn(spark):
    rows = [(1, i % 3, "a" if i % 2 else "b", f"text {i}") for i in range(400)]
    found = rotate(spark.createDataFrame(rows, TURNS), part=16, crowded=50).collect()
    assert max(r.n_turns for r in found) < 60
    for who, (text, mask) in ((k[1], v) for k, v in joined(found).items()):
        assert all(f"|>text {i}<|end|>\n" in text for i in range(400))
        own = {text[int(s) : int(e)] for s, e in (m.split(":") for m in mask.split(","))}
        assert own == {f"text {i}<|end|>" for i in range(400) if (i % 2 == 1) == (who == "a")}
        numbers = [r for r in rows]
        places = [text.index(f"|>{r[3]}<") for r in sorted(numbers, key=lambda r: r[1])]
        assert max(places[:134]) < min(places[134:]) and max(places[:267]) < min(places[267:])


def test_no_rows(spark):
    assert rotate(spark.createDataFrame([], TURNS)).collect() == []
