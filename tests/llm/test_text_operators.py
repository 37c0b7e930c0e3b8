"""Mixing, sharding, line dedup, SimHash, toxicity and decontamination on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from parcelyard.llm import (
    decontamination,
    mixing,
    sharding,
    simhash,
    toxicity,
    window_dedup,
)
from parcelyard.llm.inverted_index import Searcher
from parcelyard.llm.words import ALNUM, SPACES, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (None, "no id here at all", "en", "a", 17),
    (3, "same row", "en", "b", 8),
    (3, "same row", "en", "b", 8),
    (4, "word " * 60_000, "en", "b", 300_000),
    (5, "\n\n \n", "en", "a", 4),
    (6, "Ünïcödé Ä 日本語 \U0001f600  x", "de", None, 20),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_are_those_of_the_patterns():
    texts = ["Abc d-e\tF1 2é", "", None, "x", "y", " ", "end ", "日本 A\u0000B", "Z" * 700_000 + " q"]
    for kind, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SPACES, r"[^\x20\x09-\x0D]+")):
        got: list[list[int]] = []
        for part in words_of(pa.array(texts), kind):
            got += [part.codes[a:b].tolist() for a, b in zip(part.first[:-1], part.first[1:])]
        lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        expected = [re.findall(pattern, (t or "").translate(lower)) for t in texts]
        assert [len(x) for x in got] == [len(x) for x in expected]
        code = {}
        for codes, words in zip(got, expected):
            for c, w in zip(codes, words):
                assert code.setdefault(w, c) == c
        assert len(set(code.values())) == len(code)


# Mixing.


def test_mixture_has_the_target_shares(spark):
    rows = [(i, "x" * 50, "en", "big" if i % 4 else "small", 50) for i in range(8000)]
    got = mixing.mix(docs_of(spark, rows), {"big": 1.0, "small": 1.0}, epochs=1.0)
    n = Counter(r["source"] for r in got.collect())
    assert abs(n["small"] - 4000) < 250 and abs(n["big"] - 4000) < 250


def test_counts_follow_the_poisson_distribution(spark):
    rows = [(i, "x", "en", "s", 1) for i in range(5000)]
    for mean in (0.3, 40.0):
        got = mixing.mix(docs_of(spark, rows), {"s": 1.0}, epochs=mean).groupBy("doc_id").count().collect()
        counts = np.array([r["count"] for r in got] + [0] * (5000 - len(got)))
        assert abs(counts.mean() - mean) < 4 * (mean / 5000) ** 0.5
        assert abs(counts.var() / mean - 1) < 0.1


def test_mixture_of_odd_rows(spark):
    docs = docs_of(spark, ODD).withColumnRenamed("lang", "copy")
    got = mixing.mix(docs, {"b": 1.0, "unknown": 5.0, "a": -1.0}, epochs=3.0).collect()
    assert {r["source"] for r in got} <= {"b"} and "place" in got[0].asDict()
    same = Counter((r["doc_id"], r["copy"]) for r in got if r["doc_id"] == 3)
    assert set(same.values()) <= {2}
    all_sources = mixing.mix(docs_of(spark, ODD), epochs=50.0)
    assert {r["source"] for r in all_sources.collect()} == {None, "a", "b"}
    assert mixing.mix(empty(spark)).collect() == []


def test_mixture_beyond_the_broadcast_limit_is_the_same(spark, monkeypatch):
    rows = [(i, "x" * (i % 7), "en", f"s{i % 5}", 1) for i in range(300)]
    whole = sorted(map(tuple, mixing.mix(docs_of(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs_of(spark, rows)).collect())) == whole


# Sharding.


def test_table_is_filled_by_turns():
    shards = sharding.shard_names(7)
    table = sharding.lookup_table(shards, 211)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.3 * 211
    for bad in (lambda: sharding.lookup_table([], 211), lambda: sharding.lookup_table(["a", "a"], 211), lambda: sharding.lookup_table(["a"], 210)):
        with pytest.raises(ValueError):
            bad()


def test_placement(spark, tmp_path):
    docs = docs_of(spark, ODD).withColumnRenamed("lang", "shard")
    got = sharding.place(docs, sharding.shard_names(3), slots=101).collect()
    assert len(got) == len(ODD)
    table = sharding.lookup_table(sharding.shard_names(3), 101)
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.place(empty(spark), ["a"]).collect() == []
    sharding.write_shards(sharding.place(docs_of(spark, ODD), sharding.shard_names(3)), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# Line dedup.


def lines_by_hand(rows):
    seen: set[str] = set()
    out = []
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        filled = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\x0b")]
        gone: set[int] = set()
        for start in range(max(1, len(filled) - 2) if filled else 0):
            places = filled[start : start + 3]
            window = "\n".join(lines[i] for i in places)
            if window in seen:
                gone |= set(places)
            seen.add(window)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


def test_line_dedup_by_hand(spark):
    draw = random.Random(3)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c d", "", " "]) for _ in range(draw.randrange(9)))) for i in range(300)]
    got = window_dedup.dedup_lines(docs_of(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()) == lines_by_hand(rows)


def test_line_dedup_of_odd_rows(spark):
    docs = docs_of(spark, ODD).withColumnRenamed("n_chars", "n_lines")
    got = {(r["doc_id"], r["text"]): r for r in window_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(ODD) - 1
    assert got[1, None]["n_lines"] == 0 and got[2, ""]["n_lines"] == 1
    assert got[3, "same row"]["n_removed"] == 0
    assert window_dedup.dedup_lines(empty(spark)).collect() == []


# SimHash.


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(prints):
    root = {f: f for f in prints.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 62)
    for doc, f in prints.items():
        least[find(f)] = min(least[find(f)], doc)
    return {doc: least[find(f)] for doc, f in prints.items()}


def near_texts(draw, n):
    words = [f"w{i}" for i in range(400)]
    base = [[draw.choice(words) for _ in range(draw.randrange(1, 300))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        text = list(draw.choice(base))
        for _ in range(draw.randrange(3)):
            text[draw.randrange(len(text))] = draw.choice(words)
        out.append((i, draw.choice([" ", "\t", "  \n"]).join(text), "en", "s", 0))
    return out


def test_simhash_components_by_hand(spark):
    rows = near_texts(random.Random(5), 240) + [(1000, "", "en", "s", 0), (1001, None, "en", "s", 0)]
    prints = {r[0]: fingerprint_by_hand(r[1]) for r in rows}
    expected = components_by_hand(prints)
    assert len(set(expected.values())) < len(rows) - 20
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert {d: r["fingerprint"] for d, r in got.items()} == {d: f"{f:016x}" for d, f in prints.items()}
    assert {d: r["component_id"] for d, r in got.items()} == expected
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, rows)).collect()}
    assert kept == set(expected.values())


def test_links_are_all_pairs_within_the_distance(spark):
    draw = random.Random(6)
    prints = set()
    for _ in range(40):
        f = draw.getrandbits(64)
        prints.add(f)
        for _ in range(12):
            prints.add(f ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 6))))
    prints |= {0, (1 << 64) - 1, 1, 7, 15}
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for bits in (0, 2, 3):
        got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, bits).collect()}
        expected = {
            frozenset((a, b)) for a in signed for b in signed
            if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= bits
        }
        assert got == expected
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_simhash_of_odd_rows(spark):
    got = simhash.near_duplicates(docs_of(spark, ODD).withColumnRenamed("lang", "fp")).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == by[1]["component_id"] == by[5]["component_id"] == 1
    assert by[1]["fingerprint"] == "0" * 16
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.keep_one(docs_of(spark, ODD)).where("doc_id IS NULL").count() == 1


# Toxicity.


def toxic_rows(n, seed=7):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    bad = ["vile", "rotten", "scum"]
    docs, labels = [], []
    for i in range(n):
        text = [draw.choice(words) for _ in range(draw.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(draw.randrange(2, 5)):
                text.insert(draw.randrange(len(text)), draw.choice(bad))
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows(3000)
    got = toxicity.toxicity(docs_of(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_weights_are_few(spark):
    docs, labels = toxic_rows(2000)
    model = toxicity.fit(docs_of(spark, docs), spark.createDataFrame(labels, LABELS))
    assert 3 <= len(model.hashes) < 300


def test_held_out_labels_and_other_columns_do_not_matter(spark):
    docs, labels = toxic_rows(600)
    plain = toxicity.toxicity(docs_of(spark, docs), spark.createDataFrame(labels, LABELS)).collect()
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    other = [(d, t, "xx", f"src{d}", d) for d, t, *_ in docs]
    again = toxicity.toxicity(docs_of(spark, other), spark.createDataFrame(turned, LABELS)).collect()
    assert sorted(plain) == sorted(again)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], LABELS)
    docs = docs_of(spark, ODD).withColumnRenamed("lang", "score")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 5)}) == 1
    none = spark.createDataFrame([], LABELS)
    assert toxicity.toxicity(empty(spark), none).collect() == []
    assert toxicity.keep_clean(docs_of(spark, ODD), none).columns == docs_of(spark, ODD).columns


# Decontamination.


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def contamination_by_hand(docs, items, window):
    out = {}
    for doc, text in docs:
        words = tokens(text)
        hit, found = set(), set()
        for item, itext in items:
            iwords = tokens(itext)
            if not iwords:
                continue
            n = min(window, len(iwords))
            grams = {tuple(iwords[i : i + n]) for i in range(len(iwords) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def bench_tables(seed=8):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Ünï", "A1"]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([0, 3, 10, 25])))) for i in range(25)]
    items.append((99, items[3][1]))
    docs = []
    for i in range(150):
        text = [draw.choice(words) for _ in range(draw.randrange(80))]
        for _ in range(draw.randrange(3)):
            part = tokens(draw.choice(items)[1])
            at = draw.randrange(len(text) + 1)
            a = draw.randrange(max(1, len(part) - 10))
            text[at:at] = part[a : a + draw.randrange(8, 15)]
        docs.append((i, ", ".join(text).upper() if i % 3 == 0 else " ".join(text)))
    return docs, items


@pytest.mark.parametrize("limit", [2_000_000, 60])
def test_contamination_by_hand(spark, monkeypatch, limit):
    monkeypatch.setattr("parcelyard.llm.inverted_index.MAX_QUERY_WORDS", limit)
    docs, items = bench_tables()
    for window in (10, 4):
        got = decontamination.contamination(
            spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"),
            window,
        ).collect()
        expected = contamination_by_hand(docs, items, window)
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in got} == expected
        assert all(r["n_hit"] == sum(x["end"] - x["start"] for x in r["spans"]) for r in got)
        assert any(n for _, n, _ in expected.values())


def test_near_matches_by_hand(spark):
    docs, _ = bench_tables()
    items = [(1, "w1 w2 w3"), (2, "w4 w4 ünï"), (3, "nowhere w1"), (4, "")]
    slop = 4
    search = Searcher(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    got = {
        (r["doc_id"], r["item_id"], a, b)
        for r in search.near(slop).collect() for a, b in zip(r["starts"], r["ends"])
    }
    expected = set()
    for doc, text in docs:
        words = tokens(text)
        for item, itext in items:
            wanted = set(tokens(itext))
            for a in range(len(words)):
                if not wanted or words[a] not in wanted:
                    continue
                ends = [next((i for i in range(a, len(words)) if words[i] == w), None) for w in wanted]
                if None not in ends and max(ends) - a < len(wanted) + slop:
                    expected.add((doc, item, a, max(ends) + 1))
    assert got == expected and len(got) > 5


def test_decontamination_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    items = spark.createDataFrame(
        [(1, "same row"), (1, "no id here"), (None, "word word"), (2, None), (3, "")], "item_id int, text string"
    )
    got = decontamination.contamination(docs.withColumnRenamed("lang", "segment"), items).collect()
    assert len(got) == len(ODD)
    assert [r["n_hit"] for r in got if r["doc_id"] == 3] == [2, 2]
    assert [r["n_hit"] for r in got if r["doc_id"] is None] == [3]
    assert [r["n_words"] for r in got if r["doc_id"] == 4] == [60_000]
    assert decontamination.contamination(empty(spark), items).collect() == []
    none = spark.createDataFrame([], "item_id int, text string")
    assert {r["n_hit"] for r in decontamination.contamination(docs, none).collect()} == {0}
    assert decontamination.clean(docs, items).count() == len(ODD) - 3


def test_contaminated_rows_go_one_by_one(spark):
    rows = [(None, "clean one"), (None, "a leaked passage"), (None, None), (1, "clean two"), (1, "a leaked passage")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "leaked passage")], "item_id int, text string")
    got = [r["text"] for r in decontamination.clean(docs, items).collect()]
    assert sorted(got, key=str) == sorted(["clean one", None, "clean two"], key=str)


def test_one_row_of_each_group_of_copies_stays(spark):
    text = ["alpha beta gamma delta", "one two three four five", "red green blue white black"]
    rows = [(None, text[0])] * 3 + [(None, text[1])] * 2 + [(4, text[1])] * 2 + [(3, text[2]), (7, text[2]), (7, "lone words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(None, text[0]), (4, text[1]), (3, text[2]), (7, "lone words here")], key=str)


@pytest.mark.parametrize("l1, epochs, least", [(10.0, 6, 2), (10.0, 10, 2), (0.5, 6, 1), (13.0, 6, 3)])
def test_only_features_that_cannot_pass_are_left_out(l1, epochs, least):
    assert toxicity.least_texts(toxicity.Settings(l1=l1, epochs=epochs)) == least


def plain_ftrl(rows, settings):
    """Scores by FTRL-proximal over dictionaries, a text after the other."""

    def features(text):
        w = tokens(text)
        return {*w, *[("next", a, b) for a, b in zip(w, w[1:])], *[("skip", a, b) for a, b in zip(w, w[2:])]}

    def place(doc_id):
        return int.from_bytes(xxhash.xxh64(doc_id.to_bytes(8, "little", signed=True), seed=42).digest(), "big", signed=True)

    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f == "bias":
            return -z[f] / ((settings.beta + n[f] ** 0.5) / settings.alpha)
        if abs(z[f]) <= settings.l1:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * settings.l1) / ((settings.beta + n[f] ** 0.5) / settings.alpha + settings.l2)

    def score(text):
        x = sum(weight(f) for f in features(text) if f in z) + weight("bias")
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    train = sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: place(r[0]))
    for _ in range(settings.epochs):
        for _, text, label in train:
            found = {f: weight(f) for f in features(text) | {"bias"}}
            g = 1 / (1 + np.exp(-np.clip(sum(found.values()), -40, 40))) - label
            for f, w in found.items():
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / settings.alpha * w
                n[f] += g * g
    return {r[0]: score(r[1]) for r in rows}


@pytest.mark.parametrize("settings", [toxicity.Settings(l1=1.0), toxicity.Settings(), toxicity.Settings(l1=0.1, epochs=2)])
def test_scores_are_those_of_plain_ftrl(spark, settings):
    docs, labels = toxic_rows(300)
    docs += [(1000, "", "en", "s", 0), (1001, None, "en", "s", 0), (1002, "vile " * 30, "en", "s", 0)]
    labels += [(1000, 1, 0), (1001, 1, 0), (1002, 1, 1)]
    truth = {d: t for d, _, t in labels}
    rows = [(d, t, truth[d]) for d, t, *_ in docs if t is not None]
    got = toxicity.toxicity(docs_of(spark, docs), spark.createDataFrame(labels, LABELS), settings).collect()
    expected = plain_ftrl(rows, settings)
    assert all(abs(r["score"] - expected[r["doc_id"]]) < 1e-9 for r in got if r["doc_id"] != 1001)


def test_corpus_stays_where_nothing_can_be_learned(spark):
    docs, labels = toxic_rows(60)
    for known in ([], [(d, q, 1) for d, q, _ in labels], [(d, q, None) for d, q, _ in labels], [(10**6, 1, 1)]):
        found = spark.createDataFrame(known, LABELS)
        assert toxicity.keep_clean(docs_of(spark, docs), found).count() == len(docs)
        got = toxicity.toxicity(docs_of(spark, docs), found).collect()
        assert {(round(r["score"], 9), r["predicted"]) for r in got} == {(toxicity.PRIOR, 0)}


def test_sample_of_a_hot_id_is_bounded(spark):
    """A third of the rows under one labelled id, another third equal rows."""
    rows = [(1 if i % 3 == 0 else 2 if i % 3 == 1 else i, f"row {i} text" if i % 3 != 1 else "equal row", "e", "s", 0) for i in range(9000)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(9000)], LABELS)
    for limit in (2000, 20_000):
        got = toxicity.training_rows(docs, labels, "toxic", limit).collect()
        chars = sum(len(r["text"]) for r in got)
        assert 0 < chars <= 2 * limit
        assert len({(r["key"], r["tie"]) for r in got}) == len(got)
    with pytest.raises(ValueError, match="none of the labelled texts"):
        toxicity.training_rows(docs, labels, "toxic", 13)
