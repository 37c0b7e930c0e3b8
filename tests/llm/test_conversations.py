"""Conversation repair and the prefix trie against plain versions of their contracts."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parcelyard.llm import conversation_repair as cr
from parcelyard.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"


def by_hand(kinds, initials, costs):
    """Least (cost, audit) over states and rows; every insert is tried, two at most in a row."""
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    ways = {"": (0, "")}
    steps = [*range(len(kinds)), None]

    def better(table, state, way):
        table[state] = min(table.get(state, way), way)

    for i in steps:
        for _ in range(2):
            for state, (c, a) in list(ways.items()):
                better(ways, nxt[state], (c + costs.insert, a + "I"))
        if i is None:
            break
        after: dict = {}
        for state, (c, a) in ways.items():
            better(after, state, (c + costs.delete, a + "D"))
            if kinds[i] < cr.BLANK:
                extra = costs.truncated * (kinds[i] == cr.TRUNCATED)
                turn = nxt[state]
                better(after, turn, (c + costs.rerole + extra, a + "R"))
                if initials[i] == turn:
                    better(after, turn, (c + extra, a + "K"))
                if initials[i] == "s" and state == "":
                    better(after, "s", (c + extra, a + "K"))
        ways = after
    return min(ways[s] for s in ("", "a") if s in ways)


def test_search_is_the_best_of_all():
    """Also where inserts are cheap, and against every sequence of edits of short ones."""
    rng = random.Random(5)
    for costs in (cr.Costs(), cr.Costs(3, 4, 1, 2), cr.Costs(2, 2, 2, 0), cr.Costs(1, 1, 1, 1)):
        for _ in range(150):
            n = rng.randrange(0, 9)
            kinds = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
            initials = [rng.choice("suuaat ") for _ in range(n)]
            got = cr.Search(kinds, initials, costs).best(cr._NOTHING, cr._DONE)
            assert got == by_hand(kinds, initials, costs), (kinds, initials, costs)


def test_search_against_all_sequences_of_edits():
    rng = random.Random(6)
    costs = cr.Costs(1, 3, 2, 1)
    for _ in range(12):
        n = rng.randrange(0, 4)
        kinds = [rng.choice([0, 1, 2]) for _ in range(n)]
        initials = [rng.choice("sua") for _ in range(n)]
        found = []
        for size in range(n, n + 4):
            for audit in map("".join, itertools.product("DIKR", repeat=size)):
                if sum(x != "I" for x in audit) != n:
                    continue
                for roles in itertools.product("sua", repeat=sum(x != "D" for x in audit)):
                    text = "".join(roles)
                    body = text.removeprefix("s") if len(text) > 1 else text
                    if body != "ua" * (len(body) // 2):
                        continue
                    cost, i, at = 0, 0, iter(roles)
                    for x in audit:
                        if x == "I":
                            cost = cost + 2 if next(at) != "s" else 999
                            continue
                        if x == "D":
                            cost += 3
                        else:
                            role = next(at)
                            wrong = role != initials[i] if x == "K" else role == "s"
                            cost += 999 if wrong or kinds[i] == 2 else (x == "R") + (kinds[i] == 1)
                        i += 1
                    found.append((cost, audit))
        assert cr.Search(kinds, initials, costs).best(cr._NOTHING, cr._DONE) == min(found)


def repaired_by_hand(rows, costs=cr.Costs()):
    white = " \t\n\x0b\x0c\r"
    out = {}
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or (" " if role is None else ""), " " if text is None else text))
    for c, found in convs.items():
        found.sort(key=lambda r: (*r[:3], hashlib.md5(r[3].encode()).hexdigest()))
        kinds, seen = [], set()
        for *_, role, text in found:
            body = text.rstrip(white)
            kinds.append(
                2 if not body else 3 if (role, text) in seen else 0 if body[-1] in ".!?" else 1
            )
            seen.add((role, text))
        initials = [r[2][:1] for r in found]
        cost, audit = by_hand(kinds, initials, costs)
        lines, i, state = [], 0, ""
        for x in audit:
            turn = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            if x == "I":
                lines.append(("user:" if turn == "u" else "assistant:"))
                state = turn
                continue
            if x != "D":
                if x == "K" and state == "" and initials[i] == "s":
                    turn = "s"
                role = found[i][2] if x == "K" else "user" if turn == "u" else "assistant"
                lines.append(f"{role}:{found[i][3]}")
                state = turn
            i += 1
        turns = {r[1] for r in found if r[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = zip(initials, initials[1:])
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, kinds.count(2), kinds.count(3), kinds.count(1), illegal, cost, audit, digest)
    return out


def digests(spark, turns, costs=cr.Costs()):
    from pyspark.sql import functions as F

    from parcelyard.llm.runs import sha256_of_runs

    found = cr.repair(turns, costs)
    line = F.concat("role", F.lit(":"), "text")
    hashes = sha256_of_runs(found.turns, "conv_id", ["pos", "nr"], line, "\n", "h")
    digest = {r["conv_id"]: r["h"] for r in hashes.collect()}
    none = hashlib.sha256(b"").hexdigest()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return {
        r["conv_id"]: (*[r[n] for n in names], digest.get(r["conv_id"], none))
        for r in found.report.collect()
    }


def some_rows(seed, convs=25, longest=40):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for turn in range(rng.randrange(1, longest)):
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                t = rng.choice([turn, turn, turn, turn + 1, None]) if turn % 5 == 0 else turn
                role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
                text = rng.choice(["Yes.", "No", " \t", "", None, f"Text {turn}!", f"Text {turn}\n", "é?\x0b"])
                rows.append((c, t, role, text))
    return rows


@pytest.mark.parametrize("segment", [256, 3])
def test_repair_against_plain_version(spark, monkeypatch, segment):
    """The same in one segment and in many."""
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = some_rows(segment)
    got = digests(spark, spark.createDataFrame(rows, TURNS).repartition(5))
    assert got == repaired_by_hand(rows)


def test_repair_with_inserts_over_segments(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT", 2)
    costs = cr.Costs(rerole=4, delete=5, insert=1, truncated=1)
    rows = some_rows(9, convs=12, longest=12)
    got = digests(spark, spark.createDataFrame(rows, TURNS), costs)
    assert got == repaired_by_hand(rows, costs)
    assert any("I" in v[6] for v in got.values())


def test_repair_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS + ", seg int, audit string")
    found = cr.repair(empty)
    assert found.report.collect() == [] and found.turns.collect() == []
    rows = [(1, 0, "user", "word " * 40_000 + "."), (1, 1, "assistant", "x."), (2, None, None, None)]
    clash = spark.createDataFrame([(*r, 7, "z") for r in rows], TURNS + ", pos int, kind string")
    assert digests(spark, clash) == repaired_by_hand(rows)


def test_repair_of_one_long_conversation(spark):
    """Half of all rows are equal rows of one conversation; no task has them all."""
    rows = [(1, 5, "user", "Same.")] * 3000 + [(1, t, "assistant", f"{t}.") for t in range(3000)]
    rows += [(2, 0, "user", "A?"), (2, 1, "assistant", "B.")]
    got = digests(spark, spark.createDataFrame(rows, TURNS).repartition(4))
    assert got == repaired_by_hand(rows)


def test_damage_of_every_kind(spark):
    rows = [(c, t, r, "A. b! c") for c in (None, -3, 10, 11) for t in (None, *range(40)) for r in ("user", None)]
    got = queries.damage(spark.createDataFrame(rows, TURNS)).collect()
    expected = []
    for c, t, r, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fault, r = zlib.crc32(key.encode()) % 20, " " if r is None else r
        if fault == 4:
            r = "user"
        text = {1: "", 2: "A b c"}.get(fault, text)
        expected += [(c, t, r, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


# The prefix trie.


def trie_by_hand(rows, group=5, heads=9):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [r[3:] for r in sorted(found)] for c, found in convs.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h]) + tuple(own[c][h:])
    members = defaultdict(list)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = set()
    for node, found in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n)
        ends = ",".join(str(c) for c in found if paths[c] == node)
        parent = members[node[:-1]][0] if node else None
        leaves = sum(kids(n) == 0 for n in under)
        out.add((found[0], len(node), parent, len(found), kids(node), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, tmp_path, schema=TURNS):
    folder = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = [tuple(r) for r in queries.op13_prefix_trie(spark, folder).collect()]
    assert len(got) == len(set(got))
    return set(got)


def trie_rows(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            role = rng.choice(["user", "user", None, ""])
            rows.append((c, rng.choice([turn, turn, None]), role, rng.choice(["é!", "a", None, ""])))
    return rows + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("band, nodes", [(512, 1 << 17), (512, 3), (2, 5), (1, 1)])
def test_trie_against_plain_version(spark, tmp_path, monkeypatch, band, nodes):
    """The same in one shard and band and in many."""
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    rows = trie_rows(band + nodes)
    if band < 3:  # a job per band
        rows = [r for r in rows if r[0] is None or r[0] % 4 < 2 or (r[1] or 0) < 4]
    assert trie(spark, rows, tmp_path) == trie_by_hand(rows)


def test_trie_of_shared_heads(spark, tmp_path, monkeypatch):
    """Half of all conversations are copies, and most begin alike."""
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 40)
    rows = [(c, t, "user", "same") for c in range(0, 400, 2) for t in range(3)]
    rows += [(c, t, "user", "same" if t < 2 else str(c)) for c in range(1, 200, 2) for t in range(4)]
    assert trie(spark, rows, tmp_path) == trie_by_hand(rows)


def test_trie_of_odd_tables(spark, tmp_path):
    assert trie(spark, [], tmp_path / "a") == set()
    rows = [(3, 0, "user", "word " * 50_000), (3, 0, "user", "word " * 50_000), (4, None, None, None)]
    clash = [(*r, 1, "x") for r in rows]
    assert trie(spark, clash, tmp_path / "b", TURNS + ", pos int, node string") == trie_by_hand(rows)


def test_findclose_over_blocks():
    rng = random.Random(3)
    for size in (1, 5, 700, 3000):
        steps, depth = [], 0
        while len(steps) < 2 * size:
            left = 2 * size - len(steps)
            step = 1 if depth == 0 or (depth < left and rng.random() < 0.55) else -1
            steps.append(step)
            depth += step
        stack, close = [], {}
        for i, step in enumerate(steps):
            if step == 1:
                stack.append(i)
            else:
                close[stack.pop()] = i
        string = prefix_trie.Parentheses(np.array(steps, dtype=np.int8))
        for i, j in close.items():
            assert string.findclose(i) == j
            pairs = sum(steps[k] == 1 and steps[k + 1] == -1 for k in range(i, j))
            assert string.leaf_pairs(i, j) == pairs
