"""License notices against a plain version of phrases and of the set-similarity join."""

from __future__ import annotations

import random
import re

import pytest

from parcelyard.llm import license_scan as ls
from parcelyard.llm.words import ALNUM, words_of

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(rows, phrases=ls.PHRASES, templates=ls.TEMPLATES):
    out = []
    for doc_id, text in rows:
        w = words(text)
        hits = []
        for phrase, label in phrases:
            p = words(phrase)
            hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        found = []
        for label, template in templates:
            t = words(template)
            if not t:
                continue
            step = 16
            while step < len(t):
                step *= 2
            for at in range(0, len(w), step):
                share = len(set(t) & set(w[at : at + 2 * step])) / len(set(t))
                if round(share * len(set(t))) >= 0.8 * len(set(t)) - 1e-9:
                    found.append((share, label))
        base = sorted({x[1] for x in hits})
        labels = sorted({*base, *[x[1] for x in found]})
        score = 1.0 if hits else max((f[0] for f in found), default=0.0)
        first = min((h[0] for h in hits), default=None)
        last = max((h[0] for h in hits), default=None)
        out.append((doc_id, len(w), len(hits), first, last, base, labels, score))
    return sorted(out, key=str)


def scanned(spark, rows, schema=DOCS, **kw):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(map(tuple, ls.scan(docs, **kw).collect()), key=str)


def damaged(rng, text, loss, noise):
    kept = [w for w in text.split() if rng.random() >= loss]
    for _ in range(noise):
        kept.insert(rng.randrange(len(kept) + 1), rng.choice(["lorem", "ipsum", "the", "of"]))
    return rng.choice([" ", "\n", "  * "]).join(kept)


def test_scan_against_plain_version(spark):
    rng = random.Random(2)
    fill = "the of to and this software work is license lorem ipsum dolor copy in with by".split()
    rows = []
    for i in range(400):
        parts = [" ".join(rng.choices(fill, k=rng.choice([0, 3, 40, 200]))) for _ in range(3)]
        label, text = rng.choice(ls.TEMPLATES)
        parts.insert(rng.randrange(4), damaged(rng, text, rng.choice([0, 0.1, 0.2, 0.3]), rng.choice([0, 5])))
        if rng.random() < 0.4:
            parts.insert(rng.randrange(4), rng.choice(["UNDER the MIT License", "CC BY-NC", "Apache License, Version 2.0"]))
        rows.append((i, "\n".join(parts)))
    got = scanned(spark, rows)
    assert got == by_hand(rows)
    assert sum(bool(set(r[6]) - set(r[5])) for r in got) > 100


def test_whole_notices_are_found_wherever_they_stand(spark):
    """In one long line, over many short ones, at every offset from a block's begin."""
    rows, labels = [], []
    for label, text in ls.TEMPLATES:
        for k, before in enumerate((0, 1, 15, 31, 70)):
            body = text if k % 2 else text.replace(" ", "\n")
            rows.append((len(rows), f"{'lorem ' * before}{body} {'ipsum ' * 9}"))
            labels.append(label)
    for (_, *_, found, score), label in zip(sorted(scanned(spark, rows)), labels):
        assert label in found and score == 1.0


@pytest.mark.parametrize("n", [5, 7, 10, 20])
def test_threshold_is_exact(spark, n):
    template = " ".join(f"w{i}" for i in range(n))
    rows = [(k, " ".join(f"w{i}" for i in range(k)) + " x" * 3) for k in range(n + 1)]
    got = {r[0]: r[6] for r in scanned(spark, rows, phrases=(), templates=[("t", template)])}
    assert got == {k: (["t"] if 10 * k >= 8 * n and k else []) for k in range(n + 1)}


def test_scan_of_odd_rows(spark):
    rows = [(None, "under the MIT license"), (1, None), (1, None), (2, ""), (3, "mit " * 50_000)]
    rows += [(4, "apache license version 2 " * 3), (5, "apache license"), (5, "version 2")]
    assert scanned(spark, rows) == by_hand(rows)
    clash = [(*r, "x", 1) for r in rows]
    assert scanned(spark, clash, DOCS + ", labels string, row int") == by_hand(rows)
    assert scanned(spark, []) == []
    assert scanned(spark, rows, templates=[("none", " -- ")]) == by_hand(rows, templates=[])


def test_templates_beyond_the_bound_are_refused(monkeypatch):
    monkeypatch.setattr(ls, "MAX_TEMPLATE_WORDS", 3)
    with pytest.raises(ValueError, match="scan them in parts"):
        ls.read_templates([("a", "one two three four")])


def test_long_words_differ():
    """Words on which polynomials modulo 2**64 collide whatever their base."""
    import pyarrow as pa

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    codes = [part.codes for part in words_of(pa.array([f"{a} {b} {a}"]), ALNUM)][0]
    assert codes[0] != codes[1] and codes[0] == codes[2]
