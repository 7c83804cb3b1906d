import heapq
import random
import re
import zlib
from hashlib import sha256

import pytest
from inkveil.llm import repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
SCHEMA = "conv_id long, turn long, role string, text string, kind long, audit string, block long"


def brute(rows):
    """Of one conversation's damaged rows (turn, role, text): all result columns, by a search over edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, sha256(r[2].encode()).hexdigest(), r[1]))
    turns = [r[0] for r in rows if r[0] is not None]
    faults, seen = [], set()
    for _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if to := NEXT.get((state, role[0])):
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, role + ":")))
                if i < len(rows) and faults[i] in ("", "truncated"):
                    heapq.heappush(heap, (cost + 2 + (faults[i] != ""), audit + "R", i + 1, to, (*out, f"{role}:{rows[i][2]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated") and (to := NEXT.get((state, rows[i][1][:1]))):
                heapq.heappush(heap, (cost + (faults[i] != ""), audit + "K", i + 1, to, (*out, f"{rows[i][1]}:{rows[i][2]}")))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(out).encode()).hexdigest()


def damaged(rows):
    found = {}
    for conv, turn, role, text in rows:
        mine = found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "K", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Well.", "Is it?", "no end", "", None, " \n\t", "a.b", "End! \n", "x" * 5000 + ".", "Tschüß.", "..."]
    out = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}."
            out.append((conv, rng.choice([turn, turn, turn, 2 * turn, -turn, None]), rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2], text))
    out += [(77, t, ("user", "assistant", "system")[t * t % 3 if t % 7 else 0], f"t{t % 90}" + ".!? "[t % 4]) for t in range(700)]
    out += [(78, 3, "user", "same."), (78, 3, "user", "same."), (79, None, "user", "a."), (79, None, "user", "b.")]
    return out


def test_every_column_is_that_of_the_search(spark, rows):
    want = {c: brute(r) for c, r in damaged(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digest(table(spark, rows)).collect()}
    assert got == want
    assert any("I" in g[6] for g in got.values()) and any("R" in g[6] for g in got.values())


def test_small_blocks_and_batches_change_nothing(spark, rows, monkeypatch):
    want = {c: brute(r) for c, r in damaged(rows).items()}
    monkeypatch.setattr(repair, "BLOCK", 3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digest(table(spark, rows)).collect()}
    assert got == want


def test_batches_that_cut_a_piece(monkeypatch):
    """The same rows through one query and through many, entry states included."""
    import pyarrow as pa

    keys = [{"conv_id": 1, "block": 0, "turn": t, "alive": True, "ini": "uauas"[t % 5], "fault": t % 4} for t in range(60)]
    whole = [r for b in repair._pieces([pa.RecordBatch.from_pylist(keys)]) for r in b.to_pylist()]
    monkeypatch.setattr(repair, "BATCH", 7)
    cut = [r for b in repair._pieces([pa.RecordBatch.from_pylist([k]) for k in keys]) for r in b.to_pylist()]
    assert len(whole) == 1 and len(cut) == 9 and [r["n"] for r in cut] == [7] * 8 + [4]
    assert len({r["seg"] for r in cut}) == 9
    have = {0: (0, "")}
    for piece in sorted(cut, key=lambda r: r["seg"]):
        after = {}
        for m in piece["moves"]:
            if m["entry"] in have:
                c, e = have[m["entry"]]
                after[m["state"]] = min(after.get(m["state"], (10**9, "")), (c + m["cost"], e + m["edits"]))
        have = after
    assert have == {m["state"]: (m["cost"], m["edits"]) for m in whole[0]["moves"]}


def test_repaired_rows_are_legal(spark, rows):
    found = {}
    for r in repair.repaired(repair.plain(table(spark, rows)).selectExpr("*", "1 AS copies")).orderBy("place").collect():
        found.setdefault(r.conv_id, []).append((r.place, r.role))
    for got in found.values():
        assert [p for p, _ in got] == list(range(len(got)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role in got))


def test_empty_table_and_conversation_without_rows(spark):
    assert repair.repair_digest(table(spark, [])).collect() == []
    gone = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = repair.repair_digest(table(spark, [(*gone, "user", "Lost.")])).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
