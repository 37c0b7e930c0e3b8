"""Toxicity of documents: logistic regression over hashed word n-grams and skip-grams.

The features of a text are the 64-bit hashes of its words, of pairs of
neighbouring words and of pairs with one word between them, each counted once.
The weights are learned by FTRL-proximal: every coordinate has its own rate,
which falls with the gradients it has seen, and an L1 term keeps a weight at
zero until the evidence exceeds it. What is left are some hundred weights, small
enough to send to every task.

Training uses a sample of the labelled rows bounded by ``MAX_TRAIN_CHARS``,
drawn by a hash of id and text, whole texts only. Scoring covers every row.

FTRL goes through its rows one by one, in one task. All that can be done before is
done in parallel: features are taken from the texts, counted per range of hashes, and
those that can get no weight are dropped; the task gets the numbers of the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.llm.store import cut, stored
from parcelyard.llm.words import ALNUM, Words, mix, words_of

# Expected number of characters of the training sample.
MAX_TRAIN_CHARS = 64_000_000
# Labels sent to every task, some 16 bytes each; more are joined by a shuffle.
MAX_BROADCAST_LABELS = 500_000
# Weights left after training that may be sent to every task.
MAX_WEIGHTS = 1_000_000
# Ranges of hashes in which features are counted, each in one task.
BLOCKS = 16
# The score of every text where nothing could be learned.
PRIOR = 0.01


@dataclass(frozen=True)
class Settings:
    """FTRL-proximal's constants: learning rate and its smoothing, L1 and L2."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    epochs: int = 6


@dataclass(frozen=True)
class Model:
    """Hashes with a weight other than zero, sorted, their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word, pair and skip-pair."""
    code, text = words.codes, words.text_of_word()
    out_text, out = [text], [code]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = np.flatnonzero(text[gap:] == text[:-gap]) if len(text) > gap else np.empty(0, int)
        first, second = code[same], code[same + gap]
        out.append(mix(first * np.uint64(salt) + (second ^ np.uint64(salt))))
        out_text.append(text[same])
    return np.concatenate(out_text), np.concatenate(out)


def _sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_ftrl(texts: list[np.ndarray], labels: np.ndarray, size: int, settings: Settings) -> tuple[np.ndarray, float]:
    """Weights of the features 0 to ``size`` - 1 and the bias, which has no L1 term.

    ``texts`` hold the distinct features of each text.
    """
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    alpha, beta, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2

    def weight(z_, n_):
        w = -(z_ - np.sign(z_) * l1) / ((beta + np.sqrt(n_)) / alpha + l2)
        return np.where(np.abs(z_) > l1, w, 0.0)

    for _ in range(settings.epochs):
        for features, label in zip(texts, labels):
            z_, n_ = z[features], n[features]
            w = weight(z_, n_)
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            g = float(_sigmoid(w.sum() + bias)) - label
            root = np.sqrt(n_ + g * g)
            z[features] = z_ + g - (root - np.sqrt(n_)) / alpha * w
            n[features] = n_ + g * g
            bias_root = (bias_n + g * g) ** 0.5
            bias_z += g - (bias_root - bias_n**0.5) / alpha * bias
            bias_n += g * g
    return weight(z, n), -bias_z / ((beta + bias_n**0.5) / alpha)


def least_texts(settings: Settings) -> int:
    """Training texts that a feature needs to pass the L1 term: each adds less than one
    per epoch while its weight is zero."""
    return math.floor(settings.l1 / settings.epochs) + 1


NUMBERS = "key long, tie long, label double, block int, numbers array<int>, hashes array<long>"


def _block_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text and range of hashes the text's distinct features."""
    names = ["key", "tie", "label", "block", "hashes"]
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        for words in words_of(batch.column(3), ALNUM):
            text, found = _features(words)
            block = (found >> np.uint64(32)).astype(np.int64) % BLOCKS
            # A text without words has a row too: its label moves the bias.
            bare = np.setdiff1d(np.arange(words.texts), text)
            order = np.lexsort((found, block, text))
            text, block, found = text[order], block[order], found[order]
            fresh = np.ones(len(found), bool)
            fresh[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
            text, block, found = text[fresh], block[fresh], found[fresh]
            new = np.ones(len(found), bool)
            new[1:] = (text[1:] != text[:-1]) | (block[1:] != block[:-1])
            at = np.flatnonzero(new)
            cuts = pa.array(np.append(at, len(found)).astype(np.int32))
            row = words.row + text[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(k[row]) for k in keys],
                    pa.array(block[at].astype(np.int32)),
                    pa.ListArray.from_arrays(cuts, pa.array(found.view(np.int64))),
                ],
                names=names,
            )
            if len(bare):
                none = pa.array([[]] * len(bare), pa.list_(pa.int64()))
                columns = [pa.array(k[words.row + bare]) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.zeros(len(bare), np.int32)), none], names=names
                )


def _number(rows: pa.Table, least: int) -> pa.Table:
    """The features of a range of hashes that stand in ``least`` texts, numbered; each
    text's numbers, and a last row with the features themselves.

    The n-th feature of range b has the number n * ``BLOCKS`` + b.
    """
    lists = rows.column("hashes").combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ordered = np.sort(flat)
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    often = np.diff(np.append(begin, len(ordered))) >= least
    known = ordered[begin[often]]
    del ordered
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    at = np.searchsorted(known, flat)
    ok = (known[np.minimum(at, max(len(known) - 1, 0))] == flat) if len(known) else np.zeros(len(flat), bool)
    block = rows.column("block")[0].as_py()
    numbers = (at[ok] * BLOCKS + block).astype(np.int32)
    cuts = np.append(0, np.cumsum(np.bincount(row[ok], minlength=len(lists)))).astype(np.int32)
    cuts = np.append(cuts, cuts[-1])
    last = len(lists)

    def more(name: str, value: object) -> pa.Array:
        column = rows.column(name).combine_chunks()
        return pa.concat_arrays([column, pa.array([value], column.type)])

    return pa.table(
        {
            "key": more("key", 0),
            "tie": more("tie", 0),
            "label": more("label", None),
            "block": more("block", block),
            "numbers": pa.ListArray.from_arrays(pa.array(cuts), pa.array(numbers)),
            "hashes": pa.ListArray.from_arrays(
                pa.array([0] * (last + 1) + [len(known)], pa.int32()), pa.array(known.view(np.int64))
            ),
        }
    )


def _train(batches: Iterator[pa.RecordBatch], settings: Settings) -> pa.RecordBatch:
    """Weights by number from rows ``key``, ``tie``, ``label``, ``numbers`` in the order of
    training; a text's rows stand together. The bias has the number -1."""
    texts: list[np.ndarray] = []
    labels: list[float] = []
    size, last, parts = 0, None, []
    for batch in batches:
        keys, ties, found = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            here = (keys[i], ties[i], found[i])
            if here != last:
                if parts:
                    texts.append(np.concatenate(parts))
                    parts = []
                labels.append(float(found[i]))
                last = here
            # A copy, so that the batch can go.
            parts.append(values[ends[i] : ends[i + 1]].copy())
        size = max(size, int(values.max()) + 1 if len(values) else 0)
    if parts:
        texts.append(np.concatenate(parts))
    weights, bias = fit_ftrl(texts, np.array(labels), size, settings)
    kept = np.flatnonzero(weights)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(kept, -1)), pa.array(np.append(weights[kept], bias))], names=["number", "weight"]
    )


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: CRC-32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_chars: int) -> DataFrame | None:
    """``key``, ``tie``, ``label`` and ``text`` of the sample; None without labels of both kinds.

    Ids in several rows of ``labels`` train if all agree; null and other values than 0 and
    1 are no labels. A text longer than ``max_chars`` is not trained on. Rows are drawn by
    a hash of id and text, so that an id with very many texts is drawn like any other;
    equal rows train once. A sample that comes out above twice ``max_chars`` is thinned
    before anything is learned. Labelled rows of which none is drawn are an error.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(label).alias("label"), F.max(label).alias("most")
    )
    known = cut(known.where("label = most").where(~held_out(F.col("doc_id"))).select("doc_id", "label"))
    if known.count() <= MAX_BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.withColumn("n", F.length("text")).where(F.col("n") <= max_chars)
    counted = rows.select("doc_id", "n").join(known, "doc_id").agg(
        F.sum("n").alias("chars"), F.min("label").alias("least"), F.max("label").alias("most")
    ).first()
    if counted["least"] is None or counted["least"] == counted["most"]:
        return None
    share = min(1.0, max_chars / max(counted["chars"], 1))

    def drawn(df: DataFrame, share: float) -> DataFrame:
        place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
        return df if share >= 1.0 else df.where(place < F.lit(int(share * 2.0**63)))

    sample = drawn(rows, share).join(known, "doc_id").select("doc_id", "text", "n", "label")
    sample = cut(sample.dropDuplicates(["doc_id", "text"]))
    while True:
        found = sample.agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).first()
        if not found["rows"]:
            raise ValueError(f"none of the labelled texts was drawn; raise max_chars above {max_chars}")
        if found["chars"] <= 2 * max_chars:
            break
        share *= max_chars / found["chars"]
        sample = drawn(sample, share)
    return sample.select(
        F.xxhash64("doc_id").alias("key"), F.xxhash64("text").alias("tie"), F.col("label").cast("double"), "text"
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    settings: Settings = Settings(),
    max_chars: int = MAX_TRAIN_CHARS,
) -> Model:
    """A model of ``labels``' column ``label`` (0 or 1), without the held-out ids.

    Without labelled texts of both kinds there is nothing to tell apart: the model then
    gives every text the score ``PRIOR``, so that none is taken for toxic.
    """
    rows = training_rows(docs.select("doc_id", "text"), labels.select("doc_id", label), label, max_chars)
    if rows is None:
        return Model(np.empty(0, np.uint64), np.empty(0), math.log(PRIOR / (1 - PRIOR)))
    least = least_texts(settings)
    taken = rows.repartition(BLOCKS, "key", "tie").mapInArrow(
        _block_features, "key long, tie long, label double, block int, hashes array<long>"
    )
    numbered = stored(taken.groupBy("block").applyInArrow(lambda t: _number(t, least), NUMBERS), "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _train(batches, settings)

    # The sample's bound is the task's bound.
    dealt = numbered.where("label IS NOT NULL").select("key", "tie", "label", "numbers", "block")
    dealt = dealt.repartition(1).sortWithinPartitions("key", "tie", "label", "block").drop("block")
    found = dealt.mapInArrow(run, "number long, weight double").orderBy(F.desc(F.abs("weight")))
    found = found.limit(MAX_WEIGHTS + 2).collect()
    if len(found) > MAX_WEIGHTS + 1:
        raise ValueError(f"more than {MAX_WEIGHTS} weights are left; raise settings.l1")
    bias = sum(r["weight"] for r in found if r["number"] < 0)
    weights = {r["number"]: r["weight"] for r in found if r["number"] >= 0}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
                here = np.array([n for n in weights if n % BLOCKS == block], dtype=np.int64)
                values = hashes.values.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(here), pa.array(values[here // BLOCKS])], names=["number", "hash"]
                )

    named = numbered.where("label IS NULL").select("block", "hashes").mapInArrow(pick, "number long, hash long")
    pairs = [(r["hash"], weights[r["number"]]) for r in named.collect()]
    hashes = np.array([p[0] for p in pairs], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Model(hashes[order], np.array([p[1] for p in pairs], dtype=float)[order], bias)


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    total = np.full(len(column), model.bias)
    bits = max(12, len(model.hashes).bit_length() + 6)
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, dtype=bool)
    table[model.hashes >> shift] = True
    for words in words_of(column, ALNUM):
        text, found = _features(words)
        maybe = np.flatnonzero(table[found >> shift])
        if not len(maybe):
            continue
        at = np.minimum(np.searchsorted(model.hashes, found[maybe]), len(model.hashes) - 1)
        ok = model.hashes[at] == found[maybe]
        # Each feature counts once per text.
        pair = np.unique(text[maybe[ok]] * len(model.hashes) + at[ok])
        row, number = pair // len(model.hashes), pair % len(model.hashes)
        total[words.row : words.row + words.texts] += np.bincount(
            row, weights=model.weights[number], minlength=words.texts
        )
    return _sigmoid(total)


def _sent(spark: SparkSession, model: Model) -> Broadcast:
    return spark.sparkContext.broadcast((model.hashes, model.weights, model.bias))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus ``name``, the score from 0 to 1.

    Null and empty texts get the score of the bias alone; an empty table gives
    an empty one. A column of that name is replaced. Columns other than the
    text take no part.
    """
    docs = docs.drop(name)
    sent = _sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = pa.array(_scores(batch.column(at), Model(*sent.value)))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs`` ``doc_id``, ``held_out``, ``score`` and ``predicted``."""
    model = fit(docs, labels, settings=settings)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # Only the id and the score leave the workers.
    return light_scores(rows, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def light_scores(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of rows with ``doc_id`` and ``text``."""
    sent = _sent(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(_scores(batch.column(1), Model(*sent.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score below one half."""
    model = fit(docs, labels, settings=settings)
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)
