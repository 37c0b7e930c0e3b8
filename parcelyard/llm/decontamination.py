"""Benchmark passages in documents, by the positional inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.inverted_index import Searcher
from parcelyard.llm.store import text_key

WINDOW = 10


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document ``doc_id``, ``n_words``, ``n_hit``, ``item_ids`` and ``spans``.

    A match is ``window`` consecutive words of an item (all words of a shorter
    one) that stand in the document one after another; ``spans`` are the
    stretches of words that matches cover, merged, and ``n_hit`` is their length.
    ``item_ids`` are the matching items' ids as text, sorted.

    One row per row of ``docs``, repeated rows and null ids included. Null and
    empty texts have no words; an item with a null id is left out; items with
    equal ids count as one. Without items nothing is hit; an empty table of
    documents gives an empty result.
    """
    search = Searcher(docs.select("doc_id", "text"), items.select("item_id", "text"))
    found = search.phrases(window)
    span = F.transform(
        F.arrays_zip("starts", "ends"), lambda x: F.struct(x["starts"].alias("start"), x["ends"].alias("end"))
    )
    per_doc = found.groupBy("segment", "nr").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.col("item_id").cast("string")))).alias("item_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(span)))).alias("hits"),
    )
    per_doc = per_doc.withColumn("spans", _merged("hits"))
    rows = search.documents().join(per_doc, ["segment", "nr"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.coalesce("spans", none)
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        spans.alias("spans"),
    )


def _merged(hits: str) -> F.Column:
    """Sorted stretches with those that overlap or touch made one.

    A stretch begins where nothing earlier reaches; hits all begin in order, so
    a running maximum of the ends tells.
    """
    start = F.struct(
        F.array().cast("array<struct<start:int,end:int>>").alias("done"),
        F.lit(-1).alias("start"),
        F.lit(-1).alias("end"),
    )

    def step(state, hit):
        open_ = F.struct(state["start"].alias("start"), state["end"].alias("end"))
        joins = hit["start"] <= state["end"]
        return F.struct(
            F.when(joins | (state["end"] < 0), state["done"])
            .otherwise(F.concat(state["done"], F.array(open_)))
            .alias("done"),
            F.when(joins, state["start"]).otherwise(hit["start"]).alias("start"),
            F.greatest(state["end"], hit["end"]).alias("end"),
        )

    def finish(state):
        open_ = F.struct(state["start"].alias("start"), state["end"].alias("end"))
        return F.when(state["end"] < 0, state["done"]).otherwise(
            F.concat(state["done"], F.array(open_))
        )

    return F.aggregate(hits, start, step, finish)


def near_matches(docs: DataFrame, items: DataFrame, slop: int = WINDOW) -> DataFrame:
    """Per document and item the stretches that hold all words of the item, in any
    order, and are at most ``slop`` words longer than it has distinct words."""
    search = Searcher(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return search.near(slop).select("doc_id", "item_id", "starts", "ends")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no match.

    Whether a row does is told by its text alone, so rows are removed by a hash of
    it, whatever their ids.
    """
    hit = contamination(docs.select(text_key(docs).alias("doc_id"), "text"), items, window)
    # Copies of one text may be a third of all rows: the second key, always 0, has both
    # sides shuffled for this join, so that adaptive execution can split it.
    bad = hit.where("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct()
    bad = bad.withColumn("_zero", F.pmod(F.xxhash64("_bad"), F.lit(1)))
    key = text_key(docs)
    same = (key == bad["_bad"]) & (F.pmod(F.xxhash64(key), F.lit(1)) == bad["_zero"])
    return docs.join(bad, same, "left_anti")
