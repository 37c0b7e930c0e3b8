"""Cheapest repairs of damaged conversations, by depth-first branch-and-bound.

A conversation is sound if its roles read an optional ``system`` turn and then
``user``, ``assistant`` in turn, or if nothing is left of it. Edits keep, rerole or
delete a row, or insert a turn without text; each has a cost, and of the cheapest
sequences of edits the one whose initials (K, R, D, I) come first as text is taken.

Conversations are cut into segments of ``SEGMENT`` rows. What a segment does depends
on the rest only through the state in which it is entered and left: nothing yet,
after ``system``, after ``user``, after ``assistant``. A conversation of one segment
is searched at once. One of several is searched per segment from each state to each;
the results are a few numbers, and a pass from the back and one from the front choose
the states, however long the conversation is. Texts take no part in this. They are
joined to the rows that stay at the very end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from parcelyard.llm.store import cut
from parcelyard.operators.ranks import ranked

SEGMENT = 256
# White space of the contract: blank, and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
WHOLE, TRUNCATED, BLANK, DUPLICATE = range(4)
_NOTHING, _SYSTEM, _USER, _ASSISTANT, _DONE = range(5)
# The state after the next user or assistant turn.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_LEGAL = ("su", "ua", "au")


@dataclass(frozen=True)
class Costs:
    """What each edit costs; a truncated row that is not deleted costs ``truncated`` more."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


@dataclass(frozen=True)
class Repaired:
    """``report``: one row per conversation. ``turns``: the repaired turns in order."""

    report: DataFrame
    turns: DataFrame


class Search:
    """Edits of one segment: ``kinds`` and role ``initials`` of its rows."""

    def __init__(self, kinds: list[int], initials: list[str], costs: Costs):
        self.kinds, self.initials, self.costs = kinds, initials, costs

    def moves(self, i: int, state: int, trailing: bool) -> Iterator[tuple[str, int, int, int]]:
        """Edits possible before row ``i``: letter, cost, next row, next state."""
        turn = _NEXT[state]
        if i < len(self.kinds):
            kind = self.kinds[i]
            yield "D", self.costs.delete, i + 1, state
            if kind in (WHOLE, TRUNCATED):
                extra = self.costs.truncated if kind == TRUNCATED else 0
                initial = self.initials[i]
                if initial == _role(turn)[0]:
                    yield "K", extra, i + 1, turn
                elif initial == "s" and state == _NOTHING:
                    yield "K", extra, i + 1, _SYSTEM
                yield "R", self.costs.rerole + extra, i + 1, turn
        if i < len(self.kinds) or trailing:
            yield "I", self.costs.insert, i, turn

    def floors(self, target: int) -> list[list[float]]:
        """Suffix lower bounds: the least cost from before each row, in each state, to
        the target, whatever the edits are called."""
        infinite = float("inf")
        trailing = target == _DONE
        after = [infinite] * 4
        if trailing:
            after[_NOTHING] = after[_ASSISTANT] = 0
        else:
            after[target] = 0
        out: list[list[float]] = []
        for i in range(len(self.kinds), -1, -1):
            here = list(after) if i == len(self.kinds) else [infinite] * 4
            for state in range(4):
                for letter, cost, at, then in self.moves(i, state, trailing):
                    if letter != "I":
                        here[state] = min(here[state], cost + after[then])
            if i < len(self.kinds) or trailing:
                # Inserts stay before the row; two reach every state that one cannot.
                for _ in range(2):
                    here = [min(here[s], self.costs.insert + here[_NEXT[s]]) for s in range(4)]
            out.append(here)
            after = here
        return out[::-1]

    def best(self, entry: int, target: int) -> tuple[int, str] | None:
        """The least (cost, audit) from state ``entry`` to ``target``; None if there is none.

        Nodes are (row, state). The stack holds prefixes still to be followed, the most
        promising on top. A prefix is dropped if its bound is beyond the incumbent, or
        if its node has been reached by one at least as good.
        """
        floor = self.floors(target)
        if floor[0][entry] == float("inf"):
            return None
        trailing, n = target == _DONE, len(self.kinds)
        goals = (_NOTHING, _ASSISTANT) if trailing else (target,)
        incumbent: tuple[float, str] | None = None
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        stack: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
        while stack:
            spent, audit, i, state = stack.pop()
            if incumbent is not None and (spent + floor[i][state], audit) > incumbent:
                continue
            known = reached.get((i, state))
            if known is not None and known <= (spent, audit):
                continue
            reached[i, state] = (spent, audit)
            if i == n and state in goals and (incumbent is None or (spent, audit) < incumbent):
                incumbent = (spent, audit)
            following = []
            for letter, cost, at, then in self.moves(i, state, trailing):
                most = spent + cost + floor[at][then]
                if incumbent is None or most <= incumbent[0]:
                    following.append((most, letter, (spent + cost, audit + letter, at, then)))
            following.sort(reverse=True)
            stack += [f[2] for f in following]
        return incumbent

    def kept(self, entry: int, audit: str) -> list[dict]:
        """The turns that an audit leaves: row, number of inserts before it, new role."""
        out, i, state, inserted = [], 0, entry, 0
        for letter in audit:
            if letter == "I":
                state = _NEXT[state]
                out.append({"i": i, "nr": inserted, "role": _role(state), "inserted": True})
                inserted += 1
                continue
            if letter == "K" and state == _NOTHING and self.initials[i] == "s":
                state = _SYSTEM
                out.append({"i": i, "nr": inserted, "role": None, "inserted": False})
            elif letter != "D":
                state = _NEXT[state]
                role = None if letter == "K" else _role(state)
                out.append({"i": i, "nr": inserted, "role": role, "inserted": False})
            i, inserted = i + 1, 0
        return out


def _role(state: int) -> str:
    return "user" if state == _USER else "assistant"


def _faulty(turns: DataFrame) -> DataFrame:
    """Rows without their texts: ``key`` stands for the text, ``kind`` for the first fault."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    kind = (
        F.when(body == "", BLANK)
        .when(F.right(body, F.lit(1)).isin(".", "!", "?"), WHOLE)
        .otherwise(TRUNCATED)
    )
    rows = turns.select("conv_id", "turn", "role", F.md5("text").alias("key"), kind.alias("kind"))
    placed = ranked(rows, ["conv_id"], ["turn", "role", "key"], "pos", "of")
    # Texts that a conversation holds once are no duplicates; only the others are joined.
    # The last key, always 0, has both sides shuffled, so that a hot one can be split.
    again = (
        placed.where(F.col("kind") != BLANK)
        .groupBy("conv_id", "role", "key")
        .agg(F.min("pos").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(
            F.col("conv_id").alias("_conv"),
            F.col("role").alias("_role"),
            F.col("key").alias("_key"),
            "first",
            F.pmod(F.xxhash64("key"), F.lit(1)).alias("_zero"),
        )
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("role") == F.col("_role"))
        & (F.col("key") == F.col("_key"))
        & (F.pmod(F.xxhash64("key"), F.lit(1)) == F.col("_zero"))
    )
    later = (F.col("kind") != BLANK) & (F.col("pos") > F.col("first"))
    marked = placed.join(again, same, "left")
    return marked.select(
        "conv_id", "pos", "of", "turn", "role", "key", F.when(later, DUPLICATE).otherwise(F.col("kind")).alias("kind")
    )


def _segments(rows: DataFrame) -> DataFrame:
    """At most ``SEGMENT`` neighbouring rows of a conversation in one row."""
    seg = F.expr(f"(pos - 1) div {SEGMENT}")
    fields = F.struct("pos", "turn", "role", "key", "kind")
    found = rows.groupBy("conv_id", seg.alias("seg")).agg(
        F.sort_array(F.collect_list(fields)).alias("rows"), F.max("of").alias("of")
    )
    last = F.col("seg") == F.expr(f"(of - 1) div {SEGMENT}")
    return found.select("conv_id", "seg", (F.col("seg") == 0).alias("first"), last.alias("last"), "rows")


def _searches(batch: pa.RecordBatch, costs: Costs) -> Iterator[tuple[list[dict], Search]]:
    for rows in batch.column(batch.schema.get_field_index("rows")).to_pylist():
        yield rows, Search([r["kind"] for r in rows], [r["role"][:1] for r in rows], costs)


def _mapped(
    df: DataFrame, added: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[dict]]]]
) -> DataFrame:
    """``df`` with the columns ``added``, whose values ``make`` gives per batch of rows."""
    extra = T.StructType.fromDDL(added)
    schema = T.StructType([*df.schema.fields, *extra.fields])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in extra.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in make(batches):
            columns = [pa.array([v[name] for v in values], kind) for name, kind in kinds]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], names=[*batch.schema.names, *[k[0] for k in kinds]]
            )

    return df.mapInArrow(run, schema)


def _ways(segments: DataFrame, costs: Costs) -> DataFrame:
    """Per segment ``ways``: from each state to each the cost, and the audit's place among
    the segment's audits. No audit is the beginning of another one of its segment, as each
    ends with an edit of the last row, so places compare whole audits."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        for batch in batches:
            first, last = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = []
            for k, (_, search) in enumerate(_searches(batch, costs)):
                entries = [_NOTHING] if first[k] else range(4)
                targets = [_DONE] if last[k] else range(4)
                found = {(e, t): search.best(e, t) for e in entries for t in targets}
                found = {pair: way for pair, way in found.items() if way}
                places = {a: i for i, a in enumerate(sorted({way[1] for way in found.values()}))}
                ways = [
                    {"entry": e, "exit": t, "cost": way[0], "place": places[way[1]]}
                    for (e, t), way in found.items()
                ]
                out.append({"ways": ways})
            yield batch, out

    added = "ways array<struct<entry:int,exit:int,cost:bigint,place:int>>"
    return _mapped(segments, added, make).select("conv_id", "seg", "first", "last", "ways")


def _chosen(ways: DataFrame) -> DataFrame:
    """The states in which each segment of the best sequence of edits is entered and left.

    Two passes over the few numbers per segment, each holding one conversation's last
    segment at a time: from the back, the best exit for each entry; from the front, the
    entries that are reached.
    """

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        suffix: dict[int, tuple[int, int]] = {}
        for batch in batches:
            out = []
            for last, ways in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if last:
                    suffix = {_DONE: (0, 0)}
                best: dict[int, tuple[int, int, int, int]] = {}
                for w in ways:
                    if w["exit"] in suffix:
                        cost, order = suffix[w["exit"]]
                        way = (w["cost"] + cost, w["place"], order, w["exit"])
                        best[w["entry"]] = min(best.get(w["entry"], way), way)
                orders = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values()}))}
                suffix = {entry: (b[0], orders[b[1:3]]) for entry, b in best.items()}
                out.append({"exits": [best[e][3] if e in best else None for e in range(4)]})
            yield batch, out

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        state = _NOTHING
        for batch in batches:
            out = []
            for first, exits in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                entry = _NOTHING if first else state
                state = exits[entry]
                out.append({"entry": entry, "exit": state})
            yield batch, out

    dealt = ways.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    backward = _mapped(dealt, "exits array<int>", back).sortWithinPartitions("conv_id", "seg")
    return _mapped(backward, "entry int, exit int", front).select("conv_id", "seg", "entry", "exit")


def _decided(segments: DataFrame, costs: Costs) -> DataFrame:
    """Segments with ``entry`` and ``exit``, and what is done in them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        for batch in batches:
            entries = batch.column(batch.schema.get_field_index("entry")).to_pylist()
            exits = batch.column(batch.schema.get_field_index("exit")).to_pylist()
            out = []
            for k, (rows, search) in enumerate(_searches(batch, costs)):
                cost, audit = search.best(entries[k], exits[k])
                initials, kinds = search.initials, search.kinds
                turns = [r["turn"] for r in rows if r["turn"] is not None]
                out.append(
                    {
                        "cost": cost,
                        "audit": audit,
                        "blank": kinds.count(BLANK),
                        "duplicate": kinds.count(DUPLICATE),
                        "truncated": kinds.count(TRUNCATED),
                        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
                        "n_turns": len(set(turns)),
                        "edge": {
                            "left": initials[0],
                            "right": initials[-1],
                            "low": turns[0] if turns else None,
                            "high": turns[-1] if turns else None,
                        },
                        "kept": search.kept(entries[k], audit),
                    }
                )
            yield batch, out

    added = (
        "cost bigint, audit string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
        "n_turns bigint, edge struct<left:string,right:string,low:bigint,high:bigint>, "
        "kept array<struct<i:int,nr:int,role:string,inserted:boolean>>"
    )
    return _mapped(segments, added, make)


def _report(decided: DataFrame) -> DataFrame:
    """One row per conversation; of a segment only its audit and its edges are gathered."""
    parts = F.sort_array(F.collect_list(F.struct("seg", "audit", "edge")))
    sums = ["blank", "duplicate", "truncated", "illegal", "cost", "n_turns"]
    rows = decided.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("edge.low").alias("low"),
        F.max("edge.high").alias("high"),
        parts.alias("parts"),
    )
    pairs = F.arrays_zip(
        F.slice("parts", 1, F.size("parts") - 1).alias("a"),
        F.slice("parts", 2, F.size("parts")).alias("b"),
    )

    def met(pair: Column) -> Column:
        roles = F.concat(pair["a"]["edge"]["right"], pair["b"]["edge"]["left"])
        return ~roles.isin(*_LEGAL)

    def shared(pair: Column) -> Column:
        return F.coalesce(pair["a"]["edge"]["high"] == pair["b"]["edge"]["low"], F.lit(False))

    between = F.size(F.filter(pairs, met)).cast("long")
    twice = F.size(F.filter(pairs, shared)).cast("long")
    gaps = F.col("high") - F.col("low") + 1 - (F.col("n_turns") - twice)
    return rows.select(
        "conv_id",
        F.coalesce(gaps, F.lit(0).cast("long")).alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + between).alias("illegal"),
        "cost",
        F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"),
    )


def repair(turns: DataFrame, costs: Costs = Costs()) -> Repaired:
    """Repair the conversations in ``turns`` (``conv_id``, ``turn``, ``role``, ``text``).

    Rows of a conversation are taken by turn, null first, then role, then the MD5 of
    the text; a null id is a conversation of its own. A null role or text reads as one
    space. Rows are blank (white space only), duplicate (role and text seen earlier) or
    truncated (the last character that is not white space is none of ``.!?``); the
    first that fits counts. Blank and duplicate rows must be deleted. Columns beyond
    the four are ignored; an empty table gives empty results.

    ``report`` has per conversation the numbers of faults, of ``gaps`` in the turn
    numbers, of ``illegal`` neighbours, the ``cost`` and the ``audit``, the initials of
    the edits. ``turns`` has ``conv_id``, ``pos`` and ``nr`` (their order), ``role`` and
    ``text`` of every turn that is left or inserted.
    """
    space = F.lit(" ")
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    segments = cut(_segments(_faulty(rows)))
    alone = F.col("first") & F.col("last")
    single = segments.where(alone).select(
        "*", F.lit(_NOTHING).alias("entry"), F.lit(_DONE).alias("exit")
    )
    several = segments.where(~alone)
    path = _chosen(_ways(several, costs)).select(
        F.col("conv_id").alias("_conv"), F.col("seg").alias("_seg"), "entry", "exit"
    )
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("seg") == F.col("_seg"))
    joined = several.join(path, here).select(*single.columns)
    decided = cut(_decided(single.unionByName(joined), costs))
    return Repaired(_report(decided), _repaired_turns(decided, rows))


def _repaired_turns(decided: DataFrame, rows: DataFrame) -> DataFrame:
    """Kept and inserted turns; only the texts of kept ones go on from here."""
    edits = decided.select("conv_id", "rows", F.explode("kept").alias("k"))
    own = F.get("rows", F.col("k.i"))
    of_row = F.when(~F.col("k.inserted"), own)
    kept = edits.select(
        "conv_id",
        # What is inserted at the end stands behind the last row.
        F.coalesce(own["pos"], F.element_at("rows", -1)["pos"] + 1).alias("pos"),
        F.col("k.nr").alias("nr"),
        F.coalesce("k.role", own["role"]).alias("role"),
        of_row["turn"].alias("_turn"),
        of_row["role"].alias("_role"),
        of_row["key"].alias("_key"),
    )
    texts = rows.groupBy(
        F.col("conv_id").alias("t_conv"),
        F.col("turn").alias("t_turn"),
        F.col("role").alias("t_role"),
        F.md5("text").alias("t_key"),
    ).agg(F.any_value("text").alias("text"))
    same = (
        F.col("conv_id").eqNullSafe(F.col("t_conv"))
        & F.col("_turn").eqNullSafe(F.col("t_turn"))
        & (F.col("_role") == F.col("t_role"))
        & (F.col("_key") == F.col("t_key"))
    )
    return kept.join(texts, same, "left").select(
        "conv_id", "pos", "nr", "role", F.coalesce("text", F.lit("")).alias("text")
    )
