"""A positional inverted index over documents, and phrase and proximity search in it.

The index is a table of segments, each holding some half a megabyte of whole
texts: the ids and word counts of its documents and, per term, the sorted list
of the places where the term occurs. Segments are written once to the shared
folder and every search reads them in parallel; nothing is shuffled.

A search takes a term list per query. In each segment it starts from the rarest
term of a query, moves the list of its places by the term's offset in the query,
and intersects it with the lists of the other terms, the next rarest first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.llm.store import stored
from parcelyard.llm.words import ALNUM, among, words_of

# Words of test texts handed to the executors at once; larger test sets are
# searched in several rounds.
MAX_QUERY_WORDS = 2_000_000

SEGMENT = (
    "segment long, ids array<{id}>, n_words array<int>, "
    "terms array<long>, term_ends array<int>, places array<int>"
)


def text_words(texts: DataFrame, key: str) -> DataFrame:
    """``key`` and ``codes``, the word codes of each text in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words_of(batch.column(1), ALNUM):
                codes = pa.ListArray.from_arrays(
                    pa.array(part.first.astype(np.int32)), pa.array(part.codes.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.row, part.texts), codes], names=[key, "codes"]
                )

    rows = texts.select(key, F.col("text").cast("string"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, codes array<long>")


def build_index(docs: DataFrame, terms: np.ndarray | None = None, *, key: str = "doc_id") -> DataFrame:
    """Segments of the index over ``docs``, stored in the shared folder.

    ``terms`` (word codes) restricts it to the terms that searches will ask for;
    None stores all.
    """
    spark = docs.sparkSession
    wanted = None if terms is None else spark.sparkContext.broadcast(np.unique(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in words_of(batch.column(1), ALNUM):
                codes, places = part.codes, np.arange(len(part.codes), dtype=np.int32)
                if wanted is not None:
                    places = places[among(codes, wanted.value)]
                    codes = codes[places]
                order = np.argsort(codes, kind="stable")
                codes, places = codes[order], places[order]
                ends = np.flatnonzero(np.append(codes[1:] != codes[:-1], True)[: len(codes)]) + 1
                values = [
                    pa.array([number], pa.int64()),
                    _one_list(batch.column(0).slice(part.row, part.texts)),
                    _one_list(pa.array(np.diff(part.first).astype(np.int32))),
                    _one_list(pa.array(codes[ends - 1].view(np.int64))),
                    _one_list(pa.array(ends.astype(np.int32))),
                    _one_list(pa.array(places)),
                ]
                yield pa.RecordBatch.from_arrays(values, names=names)
                number += 1

    rows = docs.select(F.col(key), F.col("text").cast("string"))
    schema = SEGMENT.format(id=rows.schema[0].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    return stored(rows.mapInArrow(run, schema), "index")


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class _Segment:
    """The lists of one segment."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        def column(name: str, kind: type) -> np.ndarray:
            values = batch.column(batch.schema.get_field_index(name))[i].values
            return values.to_numpy(zero_copy_only=False).astype(kind, copy=False)

        self.n_words = column("n_words", np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.terms = column("terms", np.int64).view(np.uint64)
        self.ends = column("term_ends", np.int64)
        self.starts = np.concatenate([[0], self.ends])[:-1]
        self.places = column("places", np.int64)
        # One sorted key per posting: the term's number, then the place.
        number = np.repeat(np.arange(len(self.terms)), self.ends - self.starts)
        self.keys = (number << 32) | self.places

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """A term's number here, -1 where it does not occur."""
        if not len(self.terms):
            return np.full(codes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        return np.where(self.terms[at] == codes, at, -1)

    def holds(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (number << 32) | np.maximum(place, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (place >= 0)

    def next_place(self, number: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first occurrence of a term at or after a place; a huge number without one."""
        key = (number << 32) | np.maximum(place, 0)
        at = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        same = (at < len(self.keys)) & (found >> 32 == number)
        return np.where(same, found & 0xFFFFFFFF, 1 << 31)

    def anchors(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of queries (rows of ``table``) all of whose terms occur: the query, its
        term numbers, the terms' order from the rarest on, and every place of the
        rarest."""
        numbers = self.numbers(table)
        alive = np.flatnonzero((numbers >= 0).all(axis=1))
        numbers = numbers[alive]
        count = (self.ends - self.starts)[numbers]
        order = np.argsort(count, axis=1, kind="stable")
        rarest = numbers[np.arange(len(alive)), order[:, 0]]
        n = (self.ends - self.starts)[rarest]
        row = np.repeat(np.arange(len(alive)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return alive[row], numbers[row], order[row], self.places[self.starts[rarest][row] + within]

    def phrases(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the places where their terms stand one after another."""
        query, numbers, order, place = self.anchors(table)
        start = place - order[:, 0]
        for k in range(1, table.shape[1]):
            if not len(start):
                break
            offset = order[:, k]
            ok = self.holds(numbers[np.arange(len(start)), offset], start + offset)
            query, numbers, order, start = query[ok], numbers[ok], order[ok], start[ok]
        ok = start >= 0
        query, start = query[ok], start[ok]
        ok = self.document(start) == self.document(start + table.shape[1] - 1)
        return query[ok], start[ok]

    def near(self, table: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, starts and ends (excluded) of the stretches of at most ``span`` words
        that hold all the query's terms, in any order, and begin with one of them."""
        query, numbers, _, place = self.anchors(table)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for back in range(span):
            start = place - back
            last = np.full(len(start), -1)
            first = np.full(len(start), 1 << 31)
            for k in range(table.shape[1]):
                found = self.next_place(numbers[:, k], start)
                last, first = np.maximum(last, found), np.minimum(first, found)
            ok = (start >= 0) & (first == start) & (last - start < span)
            ok[ok] = self.document(start[ok]) == self.document(last[ok])
            out.append((query[ok], start[ok], last[ok] + 1))
        found = np.unique(np.stack([np.concatenate(x) for x in zip(*out)], axis=1), axis=0)
        return found[:, 0], found[:, 1], found[:, 2]

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


MATCH = "segment long, nr int, `{key}` {kind}, item_id {item}, starts array<int>, ends array<int>"


def _search(
    index: DataFrame,
    slices: Iterable[list],
    item_kind: pa.DataType,
    item: str,
    near: int | None,
    key: str,
) -> DataFrame:
    """Matches of the queries of all ``slices``: phrases, or with ``near`` stretches."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = MATCH.format(key=key, kind=kind, item=item)
    names = ["segment", "nr", key, "item_id", "starts", "ends"]
    found = None
    for part in slices:
        sent = index.sparkSession.sparkContext.broadcast(_tables(part))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = _Segment(batch, i)
                    for table, items in sent.value:
                        if near is None:
                            query, start = segment.phrases(table)
                            end = start + table.shape[1]
                        else:
                            query, start, end = segment.near(table, table.shape[1] + near)
                        if len(query):
                            yield _matches(batch, i, segment, items, query, start, end)

        def _matches(batch, i, segment, items, query, start, end) -> pa.RecordBatch:
            # A query may stand for several items.
            owner, which = items
            n = which[query + 1] - which[query]
            row = np.repeat(np.arange(len(query)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            item = owner[which[query][row] + within]
            doc, start, end = segment.document(start[row]), start[row], end[row]
            # Equal items share a number; one row per document and item.
            numbers, item = np.unique(item, return_inverse=True)
            order = np.lexsort((start, item, doc))
            doc, item, start, end = doc[order], item[order], start[order], end[order]
            new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))
            cuts = np.append(np.flatnonzero(new), len(doc)).astype(np.int32)
            at = cuts[:-1]
            lists = [
                pa.ListArray.from_arrays(pa.array(cuts), pa.array((x - segment.first[doc]).astype(np.int32)))
                for x in (start, end)
            ]
            ids = batch.column(1)[i].values.take(pa.array(doc[at]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), batch.column(0)[i].as_py()), pa.int64()),
                    pa.array(doc[at].astype(np.int32)),
                    ids,
                    pa.array(numbers.tolist(), item_kind).take(pa.array(item[at])),
                    *lists,
                ],
                names=names,
            )

        rows = index.mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return index.sparkSession.createDataFrame([], schema)
    return found


def _tables(queries: Sequence[tuple]) -> list[tuple]:
    """Per length: distinct term lists as rows of a table, and the items each stands for."""
    by_length: dict[int, dict[bytes, set]] = {}
    for item, codes in queries:
        by_length.setdefault(len(codes), {}).setdefault(codes.tobytes(), set()).add(item)
    out = []
    for length, found in sorted(by_length.items()):
        table = np.frombuffer(b"".join(found), np.uint64).reshape(-1, length)
        owners = [sorted(x) for x in found.values()]
        which = np.concatenate([[0], np.cumsum([len(x) for x in owners])])
        out.append((table, (np.array([y for x in owners for y in x]), which)))
    return out


def _slices(items: DataFrame, key: str) -> Iterator[list[tuple]]:
    """Items and their codes, as many at once as may be handed to the executors."""
    total = items.agg(F.sum(F.size("codes"))).first()[0] or 0
    rounds = -(-total // MAX_QUERY_WORDS)
    part = F.pmod(F.xxhash64(key), F.lit(rounds or 1))
    for i in range(rounds):
        rows = items.where(F.size("codes") > 0).where(part == i).collect()
        yield [(row[0], np.array(row[1], dtype=np.int64).view(np.uint64)) for row in rows]


# Item ids of other types are handled as text.
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}


class Searcher:
    """Search of the texts of ``items`` in ``docs``.

    Both tables have a text column ``text``. Null keys of items are left out, and
    so are items without words. Nothing is assumed of ``docs``' key: documents
    are told apart by segment and number.
    """

    def __init__(
        self,
        docs: DataFrame,
        items: DataFrame,
        *,
        key: str = "doc_id",
        item_key: str = "item_id",
    ):
        self.spark: SparkSession = docs.sparkSession
        self.key = key
        known = items.where(F.col(item_key).isNotNull())
        if known.schema[item_key].dataType.simpleString() not in _KINDS:
            known = known.withColumn(item_key, F.col(item_key).cast("string"))
        self.items = stored(text_words(known, item_key), "items")
        self.item_kind = self.items.schema[item_key].dataType.simpleString()
        self.item_key = item_key
        terms = self.items.select(F.explode("codes").alias("code")).distinct()
        # The terms of the test set, unless they are more than may be handed out.
        found = None
        if terms.count() <= MAX_QUERY_WORDS:
            found = np.array([r[0] for r in terms.collect()], dtype=np.int64).view(np.uint64)
        self.index = build_index(docs, found, key=key)

    def _arrow_kind(self) -> pa.DataType:
        return _KINDS[self.item_kind]

    def phrases(self, window: int) -> DataFrame:
        """Exact matches of every ``window`` consecutive words of an item, or of the
        whole of a shorter one: per document and item the ``starts`` and ``ends``
        (excluded) of the matches, in words."""

        def cut(part: list[tuple]) -> list[tuple]:
            return [
                (item, codes[i : i + window])
                for item, codes in part
                for i in range(max(1, len(codes) - window + 1))
            ]

        parts = (cut(part) for part in _slices(self.items, self.item_key))
        return _search(self.index, parts, self._arrow_kind(), self.item_kind, None, self.key)

    def near(self, slop: int) -> DataFrame:
        """Stretches, at most ``slop`` words longer than the item has distinct words,
        that hold all its words in any order."""
        parts = (
            [(item, np.unique(codes)) for item, codes in part]
            for part in _slices(self.items, self.item_key)
        )
        return _search(self.index, parts, self._arrow_kind(), self.item_kind, slop, self.key)

    def documents(self) -> DataFrame:
        """``segment``, ``nr``, the key and ``n_words`` of every document."""
        zipped = F.posexplode(F.arrays_zip("ids", "n_words")).alias("nr", "d")
        rows = self.index.select("segment", zipped)
        return rows.select("segment", "nr", F.col("d.ids").alias(self.key), "d.n_words")
