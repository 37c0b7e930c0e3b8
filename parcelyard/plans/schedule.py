"""The order in which a log of mixed changes is applied, as levels of jobs.

Requests that touch different rows, or different parts of a row, may change places.
Each kind of change tells what its requests touch; a request then stands on the first
level after all earlier ones that it clashes with, next to those of its own kind that
its job takes together with it. On a level, requests of different kinds do not clash,
so the level is one job per kind, whatever the number of requests and tenants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelyard.schemas import TENANT
from parcelyard.sources.checkpoints import settle

Job = Callable[[Mapping[str, DataFrame], DataFrame], dict[str, DataFrame]]
Keys = str | Callable[[DataFrame], Column]

# How a request holds a resource. Sharing and changing a row announce
# themselves on the whole table; moving is changing, with no other request of any kind.
SHARE, CHANGE, MOVE = "S", "W", "M"
_TABLE_MODE = {SHARE: "IS", CHANGE: "IX", MOVE: "IX"}
_EVERYTHING = "*"


@dataclass(frozen=True)
class Touch:
    """Rows of ``table`` that a request shares or changes, and which part of them.

    ``keys`` is a column (one key or an array) or a function of the requests; None
    stands for the whole table. The part ``""`` is the row itself: who shares or
    changes a part of a row shares the row, who adds or removes it changes the row.
    ``moves`` tells of which requests no other may be in the same job.
    """

    table: str
    keys: Keys | None = None
    part: str = ""
    mode: str = CHANGE
    moves: Callable[[DataFrame], Column] | None = None


@dataclass(frozen=True)
class Kind:
    """A kind of change: its job, the fields of its requests as DDL, and what they touch.

    Requests of a kind that does not tell what it touches are kept in the order of the
    log against all others.
    """

    job: Job
    fields: str
    touches: Sequence[Touch] | None = None


def _held(resource: Column | str, mode: Column | str) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(as_column(resource).alias("resource"), as_column(mode).alias("mode"))


def _whole(kinds: Mapping[str, Kind]) -> set[str]:
    """Resources that stand for more than one row and that a kind may share or change.

    On the others all requests only announce themselves, which never clashes.
    """
    found = {_EVERYTHING} if any(kind.touches is None for kind in kinds.values()) else set()
    for kind in kinds.values():
        for touch in kind.touches or ():
            if touch.keys is None:
                found |= {f"{touch.table}.{touch.part}", f"{touch.table}."}
    return found


def _of_touch(rows: DataFrame, touch: Touch, whole: set[str]) -> list[Column]:
    """Arrays of the resources that each request holds by one touch."""
    name = f"{touch.table}.{touch.part}"
    row = f"{touch.table}."
    if touch.keys is None:
        held = [_held(name, touch.mode)]
        if touch.part:
            held.append(_held(row, SHARE))
        return [F.array(*held)]
    keys = F.col(touch.keys) if isinstance(touch.keys, str) else touch.keys(rows)
    if not isinstance(rows.select(keys.alias("k")).schema["k"].dataType, T.ArrayType):
        keys = F.array(keys)
    known = F.filter(F.transform(keys, lambda k: k.cast("string")), lambda k: k.isNotNull())
    mode, announced = F.lit(touch.mode), F.lit(_TABLE_MODE[touch.mode])
    if touch.moves is not None:
        moved = F.coalesce(touch.moves(rows), F.lit(False))
        mode = F.when(moved, MOVE).otherwise(touch.mode)
        announced = F.when(moved, _TABLE_MODE[MOVE]).otherwise(_TABLE_MODE[touch.mode])

    def held(prefix: str, mode: Column, announced: Column) -> list[Column]:
        each = F.transform(known, lambda k: _held(F.concat(F.lit(f"{prefix}:"), k), mode))
        return [each, F.array(_held(prefix, announced))] if prefix in whole else [each]

    found = held(name, mode, announced)
    if touch.part:
        found += held(row, F.lit(SHARE), F.lit(_TABLE_MODE[SHARE]))
    return found


def _requests(changes: DataFrame, kind: Kind, name: str) -> DataFrame:
    rows = changes.filter(F.col("kind") == name)
    fields = F.from_json("body", kind.fields).alias("_fields")
    return rows.select(TENANT, "seq", fields).select(TENANT, "seq", "_fields.*")


def accesses(changes: DataFrame, kinds: Mapping[str, Kind]) -> DataFrame:
    """``tenant_id``, ``seq``, ``kind`` and each ``resource`` that a request holds, with ``mode``.

    A request that holds nothing on which it could clash announces itself on everything.
    """
    found, whole = None, _whole(kinds)
    here = F.array(_held(_EVERYTHING, "IS"))
    for name, kind in kinds.items():
        rows = _requests(changes, kind, name)
        if kind.touches is None:
            held = F.array(_held(_EVERYTHING, CHANGE))
        else:
            parts = [a for touch in kind.touches for a in _of_touch(rows, touch, whole)]
            if _EVERYTHING in whole or not parts:
                parts = [here, *parts]
            held = F.array_distinct(F.concat(*parts))
            held = F.when(F.size(held) > 0, held).otherwise(here)
        # A null tenant is one of its own.
        part = rows.select(
            F.coalesce(TENANT, F.lit("")).alias(TENANT), "seq", F.lit(name).alias("kind"), F.explode(held).alias("h")
        ).select(TENANT, "seq", "kind", "h.*")
        found = part if found is None else found.unionByName(part)
    return found


def _clash(a: Column, b: Column) -> Column:
    strong = a.isin(CHANGE, MOVE) | b.isin(CHANGE, MOVE)
    return strong | ((a == SHARE) & (b == "IX")) | ((a == "IX") & (b == SHARE))


def _first_holders(rows: DataFrame, *keys: str) -> DataFrame:
    """Per resource the first request of each kind and mode: a short list, however many hold it."""
    first = rows.groupBy(TENANT, "resource", "kind", "mode").agg(F.min("seq").alias("first"))
    return first.groupBy(*keys).agg(F.collect_list(F.struct("kind", "mode", "first")).alias("_held"))


def _meeting(rows: DataFrame, holders: DataFrame, keys: list[str], clash: Callable[[Column], Column]) -> DataFrame:
    """Requests that clash with an earlier holder of one of their resources."""
    # The last key, always 0, has both sides shuffled, so that a hot resource can be split.
    zero = F.pmod(F.xxhash64("resource"), F.lit(1))
    joined = rows.withColumn("_zero", zero).join(holders.withColumn("_zero", zero), [*keys, "_zero"])
    earlier = F.exists("_held", lambda h: (h["first"] < F.col("seq")) & clash(h))
    return joined.filter(earlier).select(TENANT, "seq").distinct()


def _waiting(rows: DataFrame) -> DataFrame:
    """Requests that cannot be on the first level of ``rows``."""

    def hard(h: Column) -> Column:
        apart = (h["kind"] != F.col("kind")) | (h["mode"] == MOVE) | (F.col("mode") == MOVE)
        return apart & _clash(h["mode"], F.col("mode"))

    keys = [TENANT, "resource"]
    waiting = settle(_meeting(rows, _first_holders(rows, *keys), keys, hard))
    # Who clashes with a waiting request of the same kind waits as well.
    keys = [TENANT, "resource", "kind"]
    fresh = waiting
    while not fresh.isEmpty():
        late = _first_holders(rows.join(fresh, [TENANT, "seq"], "left_semi"), *keys)
        others = rows.join(waiting, [TENANT, "seq"], "left_anti")
        fresh = settle(_meeting(others, late, keys, lambda h: _clash(h["mode"], F.col("mode"))))
        waiting = settle(waiting.unionByName(fresh))
    return waiting


def levels(changes: DataFrame, kinds: Mapping[str, Kind]) -> Iterator[DataFrame]:
    """``tenant_id``, ``seq`` and ``kind`` of the requests of each level, the first level first.

    ``changes`` has ``tenant_id``, ``seq`` (each once per tenant), ``kind`` and ``body``.
    Each level costs a few jobs over what is left of the log.
    """
    rows = settle(accesses(changes, kinds))
    while not rows.isEmpty():
        waiting = _waiting(rows)
        yield rows.join(waiting, [TENANT, "seq"], "left_anti").select(TENANT, "seq", "kind").distinct()
        rows = settle(rows.join(waiting, [TENANT, "seq"], "left_semi"))


def cut_levels(changes: DataFrame, kinds: Mapping[str, Kind]) -> Iterator[tuple[Job, DataFrame]]:
    """Jobs with their requests, one per level and kind, in an order that gives the same
    tables as the requests one after another."""
    changes = settle(changes)
    found = {r["kind"] for r in changes.select("kind").distinct().collect()}  # kinds are few
    if unknown := found - set(kinds):
        raise ValueError(f"unknown kinds of change: {sorted(map(str, unknown))}")
    used = {name: kind for name, kind in kinds.items() if name in found}
    if not used:
        return
    for level in levels(changes, used):
        level = settle(level)
        here = {r["kind"] for r in level.select("kind").distinct().collect()}
        for name in sorted(here):
            rows = _requests(changes, used[name], name)
            mine = level.filter(F.col("kind") == name).select(F.col(TENANT).alias("_tenant"), F.col("seq").alias("_seq"))
            same = (F.coalesce(rows[TENANT], F.lit("")) == F.col("_tenant")) & (rows["seq"] == F.col("_seq"))
            yield used[name].job, rows.join(mine, same, "left_semi")
