"""Conversation repair against every possible edit of short conversations."""

import hashlib
import itertools
import random
import re

from placeweave.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, again string, digest int, nth int, step int, edit string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1, "e") for r in rows], SCHEMA)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_edit(rows):
    """(cost, letters, repaired) of all edits with at most two inserted turns in a place."""
    wanted, found = faults(rows), []
    ways = []
    for (_, role, text), fault in zip(rows, wanted):
        own = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            late = 5 if fault == "truncated" else 0
            own += [(late, "K", (role, text)), *((1 + late, "R", (r, text)) for r in ("user", "assistant"))]
        ways.append(own)
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for chosen in itertools.product(*ways):
        places = itertools.product(gaps, repeat=len(rows) + 1)
        for inserted in places:
            cost, letters, out = 0, "", []
            for place, way in itertools.zip_longest(inserted, chosen):
                for role in place:
                    cost, letters = cost + 5, letters + "I"
                    out.append((role, ""))
                if way:
                    cost, letters = cost + way[0], letters + way[1]
                    if way[2]:
                        out.append(way[2])
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)):
                found.append((cost, letters, "\n".join(f"{r}:{t}" for r, t in out)))
    return min(found)[:3]


def scanned(rows):
    made = []
    scan = conversations.Repair(made.append)
    for (turn, role, text), fault in zip(rows, faults(rows)):
        scan.row(turn, role, text, fault, False)
    scan.end()
    late = sum(5 for x in made if x[4] == "truncated" and x[0] != "D")
    cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[x[0]] for x in made) + late
    return cost, "".join(x[0] for x in made), "\n".join(f"{x[2]}:{x[3]}" for x in made if x[0] != "D")


def some_rows(rng, n):
    roles = ["system", "user", "assistant", "assistant", "user", "tool", "", " "]
    return [(i, rng.choice(roles), rng.choice(["a.", "b.", "c!", "d", "e", " ", "", "f?\t"])) for i in range(n)]


def test_scan_finds_the_cheapest_of_all_edits():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(60 if n < 3 else 25):
            rows = some_rows(rng, n)
            assert scanned(rows) == every_edit(rows), rows


def test_long_conversations_hold_few_unresolved_edits():
    rng = random.Random(2)
    made = []
    scan, widest = conversations.Repair(made.append), 0
    for i in range(20000):
        role = rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[i % 2]
        scan.row(i, role, f"text {i}.", "blank" if rng.random() < 0.1 else None, False)
        widest = max(widest, max(step.depth for _, step in scan.live.values()) - scan.root.depth)
    scan.end()
    assert widest < 200 and len(made) >= 20000
    kept = "".join(x[2][0] for x in made if x[0] != "D")
    assert re.fullmatch("s?(ua)+", kept)


def test_rows_of_blank_turns_are_final_at_once():
    made = []
    scan = conversations.Repair(made.append)
    for i in range(1000):
        scan.row(i, "user", " ", "blank", False)
    assert len(made) >= 990
    scan.end()
    assert [x[0] for x in made] == ["D"] * 1000


def folded(spark, rows):
    return {r["conv_id"]: r for r in conversations.summary(conversations.repair(table(spark, rows))).collect()}


def test_repair_in_spark(spark):
    rng, rows = random.Random(3), []
    given = {c: some_rows(rng, rng.randint(1, 4)) for c in range(30)}
    for c, own in given.items():
        rows += [(c, *r) for r in own]
    rng.shuffle(rows)
    got = folded(spark, rows)
    for c, own in given.items():
        cost, letters, text = scanned(own)
        r = got[c]
        assert (r["cost"], r["audit"]) == (cost, letters)
        assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [faults(own).count(f) for f in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])) and r["gaps"] == 0


def test_nulls_ties_and_gaps(spark):
    rows = [
        (None, 1, "user", "a."), (None, 5, "assistant", "b."), (None, 5, "assistant", "b."),
        (7, None, None, None), (7, None, "user", "x."), (8, None, "user", "x."), (8, 4, "assistant", "y."),
    ]
    got = folded(spark, rows)
    assert (got[None]["gaps"], got[None]["duplicate"], got[None]["audit"]) == (3, 1, "KKD")
    assert (got[7]["gaps"], got[7]["blank"], got[7]["audit"]) == (0, 1, "DD")
    assert (got[8]["gaps"], got[8]["audit"], got[8]["illegal"]) == (0, "KK", 0)
    assert folded(spark, []) == {}


def test_long_texts_and_the_whole_query(spark, tmp_path):
    rows = [(1, i, ("user", "assistant")[i % 2], "w " * 50000 + f"{i}.") for i in range(6)] + [(2, 0, "user", "only"), (None, None, None, None)]
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in conversations.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, None}
    # crc32 decides: every conversation is returned, also those that lose all their rows.
    assert all(len(r["repaired_sha256"]) == 64 and r["cost"] >= 0 for r in got.values())
