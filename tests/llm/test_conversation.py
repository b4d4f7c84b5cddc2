"""Conversation repair against a forward search over whole edit strings."""

import hashlib
import random
import re
import zlib

from hinoki.llm import conversation as CV

GRAMMAR = {"": "s u", "s": "u", "u": "a", "a": "u"}  # last initial -> what may follow
SPACE = "\x20\t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        one = lambda v: " " if v is None else str(v)
        case = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        for _ in range(2 if case == 3 else 1):
            yield conv, turn, "user" if case == 4 else role, text


def best(rows):
    """Cheapest (cost, edits, repaired) by a search from the front that keeps, for each state, the
    least (cost, edits); rows are (role, text, must go, truncated)."""

    def relax(found):
        for _ in range(6):
            for last, (cost, edits, out) in list(found.items()):
                for to in GRAMMAR[last].split():
                    if to != "s":
                        name = {"u": "user", "a": "assistant"}[to]
                        way = (cost + 2, edits + "I", out + [(name, "")])
                        if to not in found or way[:2] < found[to][:2]:
                            found[to] = way
        return found

    found = relax({"": (0, "", [])})
    for role, text, gone, cut in rows:
        after = {}

        def put(to, way):
            if to not in after or way[:2] < after[to][:2]:
                after[to] = way

        for last, (cost, edits, out) in found.items():
            put(last, (cost + 3, edits + "D", out))
            if not gone:
                may = GRAMMAR[last].split()
                if role[:1] in may:
                    put(role[:1], (cost + cut, edits + "K", out + [(role, text)]))
                for to, name in (("u", "user"), ("a", "assistant")):
                    if to in may:
                        put(to, (cost + 2 + cut, edits + "R", out + [(name, text)]))
        found = relax(after)
    return min(found[q] for q in ("", "a") if q in found)


def report(rows):
    """conv -> the contract's columns, from original rows."""
    kept = list(damage(rows))
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in kept if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        turns = [r[1] for r in mine if r[1] is not None]
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in mine:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits, fixed = best(judged)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, edits, digest)
    return out


def made_up(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "usr"]
    texts = ["Hi.", "Yes!", "no", " ", "", "what?\n", "End. ", "x ", "a. ", None, "é?", "same"]
    weights = [8, 8, 2, 1, 1, 1, 1]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(9)):
            t = rng.choice([turn, turn, turn, turn, turn + 3, None])
            rows.append((conv if conv else None, t, rng.choices(roles, weights)[0], rng.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_equals_a_forward_search(spark):
    rows = made_up(1, 400)
    got = {r[0]: tuple(r[1:]) for r in CV.report(CV.damaged(frame(spark, rows)), "copies").collect()}
    assert got == report(rows)


def test_given_table(spark):
    convs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in CV.report(CV.damaged(convs), "copies").collect()}
    assert got == report(rows)


def test_repaired_turns_follow_the_grammar(spark):
    rows = made_up(2, 200)
    turns = {}
    for r in sorted(CV.repair(frame(spark, rows)).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn)):
        turns.setdefault(r.conv_id, []).append(r)
    for mine in turns.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in mine))
        assert [r.turn for r in mine] == list(range(len(mine)))
        assert all(r.text == "" and r.edit == "I" or r.text.strip(SPACE) for r in mine)


def test_dropped_empty_long_and_clashing(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    long = "word " * 400_000 + "."
    rows = [(gone, 0, "user", "Hi."), (kept, 0, "user", long)]
    df = frame(spark, rows).selectExpr("*", "1 as copy", "'x' as name", "2 as nth", "3 as conv", "4 as part")
    got = {r[0]: tuple(r[1:]) for r in CV.report(CV.damaged(df), "copies").collect()}
    assert got == report(rows)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert CV.report(CV.damaged(frame(spark, [])), "copies").count() == 0
    assert CV.repair(frame(spark, [])).count() == 0


def test_one_conversation_of_many_turns(spark):
    """A hot conversation: half of its turns are one text, and a null id."""
    rows = [(None, i, "user" if i % 2 == 0 else "assistant", "Same." if i % 4 < 2 else f"No {i}.") for i in range(6000)]
    got = CV.report(frame(spark, rows)).collect()
    assert len(got) == 1 and got[0].duplicate == 2998 and len(got[0].audit) >= 6000
    assert got[0].cost == CV.cheapest(bytes((CV.KINDS.index(r[2][0]) | (CV.MUST_GO if r[3] == "Same." and i > 1 else 0)) for i, r in enumerate(rows)))[0]
