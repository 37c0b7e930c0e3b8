"""Three table changes: insert, update by key, delete by key.

A change set is a DataFrame of requests with a ``seq`` column that orders them.
The result is the new state of the table; nothing is written here.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.functions.values import flag
from parcelyard.operators.keyed import distinct_keys, drop_keys, on
from parcelyard.schemas import INSERT_DEFAULTS, TENANT

SEQ = "seq"

# A tenant's requests are dealt over so many keys; its row of first ids comes once for each.
_NUMBER_SHARES = 256


def cast_like(base: DataFrame, rows: DataFrame, table: str | None = None) -> DataFrame:
    """Give rows the columns and types of the table, absent ones as default or NULL."""
    defaults = INSERT_DEFAULTS.get(table or "", {})
    have = set(rows.columns)

    def column(field) -> Column:
        value = F.col(field.name) if field.name in have else F.lit(defaults.get(field.name))
        return value.cast(field.dataType).alias(field.name)

    return rows.select(*[column(f) for f in base.schema.fields])


def insert_rows(base: DataFrame, rows: DataFrame, table: str | None = None) -> DataFrame:
    return base.unionByName(cast_like(base, rows, table))


def given_or(rows: DataFrame, column: str, at: Column | None) -> Column:
    """A request's own time, else ``at``, else the time of the run."""
    at = F.current_timestamp() if at is None else at
    if column not in rows.columns:
        return at.alias(column)
    return F.coalesce(column, at).alias(column)


def first_by_key(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Requests that may insert: the first of each key, and no key already stored."""
    columns = [c for c in rows.columns if c not in (TENANT, key)]
    first = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(*on(key))
        .agg(F.min_by(F.struct(*columns), SEQ).alias("_row"))
        .select(TENANT, key, "_row.*")
    )
    stored = base.select(*on(key)).join(distinct_keys(rows, key), on(key), "left_semi")
    return drop_keys(first, stored, key, one_each=True)


def number_rows(
    base: DataFrame, rows: DataFrame, key: str, scope: str | None = TENANT, width: int | Column = 1
) -> DataFrame:
    """Give each request an id above the stored ones, rising with ``seq``.

    Like an auto-increment column it leaves gaps where ``seq`` has gaps, so no
    sort over all requests is needed. ``width`` is the number of ids per request.
    """
    seq, stored = F.col(SEQ), F.col(key).cast("bigint")
    if scope is None:
        top = F.coalesce(base.select(F.max(stored)).scalar(), F.lit(0))
        start = rows.select(F.min(seq)).scalar()
        step = rows.select(F.max(F.lit(width))).scalar()
        return rows.withColumn(key, top + 1 + (seq - start) * step)
    top = base.groupBy(scope).agg(F.max(stored).alias("_top"))
    start = rows.groupBy(scope).agg(
        F.min(seq).alias("_first"), F.max(F.lit(width)).alias("_step")
    )
    # The small side is the hashed one, and never sent whole: estimates do not count its copies.
    shares = F.sequence(F.lit(0), F.lit(_NUMBER_SHARES - 1)).cast("array<bigint>")
    start = start.join(top, scope, "left").withColumn("_share", F.explode(shares))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(seq), F.lit(_NUMBER_SHARES)))
    numbered = dealt.join(start.hint("shuffle_hash"), [scope, "_share"])
    return numbered.withColumn(
        key, F.coalesce("_top", F.lit(0)) + 1 + (seq - F.col("_first")) * F.col("_step")
    ).drop("_top", "_first", "_step", "_share")


def update_by_key(
    base: DataFrame,
    changes: DataFrame,
    key: str,
    always: Iterable[str] = (),
    optional: Mapping[str, str] | None = None,
    scope: Iterable[str] = (TENANT,),
) -> DataFrame:
    """Apply all updates of a key at once.

    ``always`` columns are written by every request, so the last request decides.
    ``optional`` maps a column to its presence flag: the last request that carries
    the column decides, an explicit NULL included.
    """
    always = list(always)
    optional = dict(optional or {})
    keys = [*scope, key]
    # A key that cannot be one of the table's, such as text for a number, finds no row.
    requests = changes.withColumn(
        key, F.col(key).try_cast(base.schema[key].dataType)
    ).filter(F.col(key).isNotNull())
    folds = []
    if always:
        folds.append(F.max_by(F.struct(*always), SEQ).alias("_always"))
    for column, present in optional.items():
        when = F.when(flag(F.col(present)), F.col(SEQ))
        folds.append(F.max_by(column, when).alias(f"_new_{column}"))
        folds.append(F.bool_or(flag(F.col(present))).alias(f"_set_{column}"))
    folded = requests.groupBy(*keys).agg(*folds)
    joined = base.join(folded, keys, "left")

    def column(field) -> Column:
        name = field.name
        if name in always:
            new, written = F.col(f"_always.{name}"), F.col("_always").isNotNull()
        elif name in optional:
            new, written = F.col(f"_new_{name}"), flag(F.col(f"_set_{name}"))
        else:
            return F.col(name)
        return F.when(written, new.cast(field.dataType)).otherwise(F.col(name)).alias(name)

    return joined.select(*[column(f) for f in base.schema.fields])


def _asked_renames(base: DataFrame, renames: DataFrame, key: str) -> DataFrame:
    """Each rename with ``_alive``, whether its row is stored, and ``_taken``, whether its new key is.

    A rename looks up its old and its new name in one join, and its two rows meet again.
    """
    names = F.array(
        F.struct(F.lit(True).alias("own"), F.col("old_id").alias("name")),
        F.struct(F.lit(False).alias("own"), F.col("_new").alias("name")),
    )
    zero = F.pmod(F.xxhash64("_name"), F.lit(1))
    sides = renames.select("*", F.explode(names).alias("_side")).select(
        *renames.columns, F.col("_side.own").alias("_own"), F.col("_side.name").alias("_name")
    )
    # The last key, always 0, lets adaptive execution split a name that very many ask for.
    stored = base.select(TENANT, F.col(key).alias("_name"), F.lit(True).alias("_stored"))
    found = sides.withColumn("_zero", zero).join(
        stored.withColumn("_zero", zero), [TENANT, "_name", "_zero"], "left"
    )
    here = flag(F.col("_stored"))
    return found.groupBy(TENANT, SEQ, "old_id", "_new").agg(
        F.bool_or(F.col("_own") & here).alias("_alive"),
        F.bool_or(~F.col("_own") & here).alias("_taken"),
        F.any_value("_row").alias("_row"),
    )


def _events(*events: Column) -> Column:
    """The events that are there, one row each as ``e``."""
    return F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")


def _carried_out(asked: DataFrame) -> DataFrame:
    """What is left of renames, as events of a name: ``_seq`` and ``_row`` of the rename that
    is carried out on it, ``_target`` where one gives the name, ``_addressed`` where a rename
    found no row.

    A key is taken if it is stored, or if an earlier request of the batch has given it to a
    stored row; so of those that claim a name the first has it and the others are refused. A
    stored key that an earlier request may have freed is beyond a batch; a rename onto it
    fails when it runs. All of this is one fold per name.
    """
    wanted, refused = F.col("_alive") & ~F.col("_taken"), F.col("_alive") & F.col("_taken")

    def event(kind: str, name: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name")))

    events = asked.select(
        "*",
        _events(
            event("claims", "_new", wanted),
            event("frees", "old_id", wanted),
            event("refused", "_new", refused),
            event("lost", "old_id", ~F.col("_alive")),
        ),
    )
    kind = F.col("e.kind")
    folded = events.groupBy(TENANT, F.col("e.name").alias("_name")).agg(
        F.min_by(F.struct(SEQ, "old_id", "_row"), F.when(kind == "claims", F.col(SEQ))).alias("_first"),
        F.min(F.when(kind == "frees", F.col(SEQ))).alias("_freed"),
        F.max(F.when(kind == "refused", F.col(SEQ))).alias("_refused"),
        F.bool_or(kind == "lost").alias("_lost"),
    )
    message = F.concat(F.lit("rename onto a key that the batch may have renamed: "), "_name")
    unclear = flag(F.col("_freed") < F.col("_refused"))
    sure = folded.filter(F.when(unclear, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    first = F.col("_first")
    none = F.lit(None)
    row_type = asked.schema["_row"].dataType

    def out(name: Column, seq: Column, row: Column, target: bool, addressed: bool) -> Column:
        return F.struct(
            name.alias("name"),
            seq.cast("bigint").alias("seq"),
            row.cast(row_type).alias("row"),
            F.lit(target).alias("target"),
            F.lit(addressed).alias("addressed"),
        )

    return sure.select(
        TENANT,
        _events(
            F.when(first.isNotNull(), out(first["old_id"], first[SEQ], first["_row"], False, True)),
            F.when(first.isNotNull(), out(F.col("_name"), none, none, True, False)),
            F.when(F.col("_lost"), out(F.col("_name"), none, none, False, True)),
        ),
    ).select(
        TENANT,
        F.col("e.name").alias("old_id"),
        F.col("e.seq").alias(SEQ),
        F.col("e.row").alias("_row"),
        F.col("e.target").alias("_target"),
        F.col("e.addressed").alias("_addressed"),
        F.col("e.seq").isNotNull().alias("_moves"),
    )


def rename_by_key(
    base: DataFrame, changes: DataFrame, key: str, always: Iterable[str]
) -> DataFrame:
    """Update rows found by ``old_id``; the request may also give the row a new key.

    A request that would give the row a key of another row is refused as a whole. A
    batch may rename a key once and must not address the row again afterwards,
    neither by its old nor by its new key. Such a batch fails when it runs.
    """
    always = list(always)
    moves = F.coalesce(F.col(key) != F.col("old_id"), F.lit(False))
    rows = changes.filter(F.col("old_id").isNotNull()).select(
        TENANT, SEQ, "old_id", F.col(key).alias("_new"), F.struct(key, *always).alias("_row"), moves.alias("_moves")
    )
    plain = rows.filter(~F.col("_moves")).select(
        TENANT, "old_id", F.col(SEQ).cast("bigint").alias(SEQ), "_row",
        F.lit(False).alias("_target"), F.lit(True).alias("_addressed"), "_moves",
    )
    asked = _asked_renames(base, rows.filter("_moves").drop("_moves"), key)
    folded = plain.unionByName(_carried_out(asked)).groupBy(TENANT, "old_id").agg(
        F.max_by("_row", SEQ).alias("_last"),
        F.count_if("_moves").alias("_renames"),
        F.max(SEQ).alias("_last_seq"),
        F.max(F.when(F.col("_moves"), F.col(SEQ))).alias("_moved_seq"),
        F.bool_or(F.col("_target")).alias("_target"),
        F.bool_or(F.col("_addressed")).alias("_addressed"),
    )
    late = (F.col("_renames") > 1) | flag(F.col("_last_seq") > F.col("_moved_seq"))
    rejected = late | (F.col("_target") & F.col("_addressed"))
    message = F.concat(F.lit("row addressed after its key was renamed: "), "old_id")
    sure = folded.filter(
        F.when(rejected, F.raise_error(message).cast("boolean")).otherwise(F.col("_last").isNotNull())
    )
    known = sure.select(TENANT, F.col("old_id").alias(key), "_last")
    joined = base.join(known, on(key), "left")
    hit = F.col("_last").isNotNull()

    def column(field) -> Column:
        if field.name != key and field.name not in always:
            return F.col(field.name)
        old = F.col(field.name)
        new = F.col(f"_last.{field.name}").cast(field.dataType)
        return F.when(hit, new).otherwise(old).alias(field.name)

    return joined.select(*[column(f) for f in base.schema.fields])
