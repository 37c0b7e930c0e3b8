"""URL rules, archives, near vectors, page text and components on small tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re
import time
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from parcelyard.llm import graphs, html_text, near_vectors, url_rules, warc
from parcelyard.llm.components import components
from parcelyard.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"


# URL rules.


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for rule, verdict in URL_RULES.items():
        domain, slash, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith(slash + start):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return host, path, best and best[1], best and best[2]


URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/es/x?y#z",
    "https://example.org/en/17", "https://example.org/en/2", "http://notexample.org/es/1", "http://x.com/fr/1",
    "http://x.com/de", "http://x.com/de/1/de/", "a://b://c/d", "http://h?x/y", "http://h#/", "http://É.com/de/1",
    "http://x.com/de/\nnew", "x\ny://com/fr/é", "http://example.net/org/", "http://org./a",
]


def test_given_rules_by_hand(spark):
    pages = spark.createDataFrame([(i, u, "", 1) for i, u in enumerate(URLS + URLS[5:7])], PAGES + ", rule int")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = url_rules.judge(pages, labels, url_rules.given_rules(URL_RULES)).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = by_hand((URLS + URLS[5:7])[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert url_rules.judge(pages.limit(0), labels, url_rules.given_rules(URL_RULES)).collect() == []


def test_mined_rules_by_hand(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        host = draw.choice(["casino-win", "news", "blog", "shop"])
        path = draw.choice(["/bet/", "/a/", "/b/"])
        rows.append((i, f"http://{host}.example.net{path}{i}", ""))
        bad = host == "casino-win" or (host == "shop" and path == "/bet/")
        if i % 2:
            labels.append((i, bad))
    labels += [(0, True), (0, False), (2, None), (None, True)]
    pages = spark.createDataFrame(rows, PAGES)
    known = spark.createDataFrame(labels, "page_id long, blocked boolean")
    got = {r["page_id"]: r for r in url_rules.judge(pages, known, []).collect()}
    for i, url, _ in rows:
        bad = "casino-win" in url or ("shop" in url and "/bet/" in url)
        assert got[i]["verdict"] == ("block" if bad else "allow")


def test_mining_finds_every_sure_combination(spark):
    draw = random.Random(9)
    baskets = [(sorted(draw.sample("abcdef", draw.randrange(1, 5))), draw.random() < 0.3) for _ in range(200)]
    baskets = [(t, b or {"a", "c"} <= set(t) or {"b", "e"} <= set(t)) for t, b in baskets]
    settings = url_rules.Mining(min_support=0.03, min_count=1, min_confidence=0.7, max_tokens=3)
    df = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine(df, settings).collect()}
    sure = {}
    for size in (1, 2, 3):
        for c in combinations("abcdef", size):
            n = [b for t, b in baskets if set(c) <= set(t)]
            if sum(n) >= 0.03 * len(baskets) and sum(n) / max(len(n), 1) >= 0.7:
                sure[c] = sum(n) / len(n)
    least = {c: p for c, p in sure.items() if not any(set(d) < set(c) and q >= p for d, q in sure.items())}
    assert got == pytest.approx(least) and len(least) > 1


def test_rules_over_parent_domains_endings_and_schemes(spark):
    rows = []
    for i in range(120):
        rows += [(f"http://a{i}.good{i}.org/p", False), (f"https://b{i}.other{i}.org/p", False)]
        rows += [(f"https://c{i}.bad{i}.xyz/p", True), (f"https://{i}.1234.com/p", True), (f"https://{i}.5678.com/p", False)]
        rows += [(f"ftp://f{i}.site{i}.org/p", True)]
    asked = {
        "https://new.domain.xyz/q": "block", "https://x.1234.com/q": "block", "ftp://new.fresh.org/q": "block",
        "https://x.5678.com/q": "allow", "https://new.fresh.org/q": "allow",
    }
    pages = [(i, u, "") for i, u in enumerate([u for u, _ in rows] + list(asked))]
    labels = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(rows)], "page_id long, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(pages, PAGES), labels, []).collect()}
    assert [got[len(rows) + i] for i in range(len(asked))] == list(asked.values())


def test_rules_of_five_tokens_are_kept(spark):
    baskets = [([x for x in "abcde" if x != out], False) for out in "abcde"] * 10 + [(list("abcde"), True)] * 30
    df = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")
    assert [r["antecedent"] for r in url_rules.mine(df).collect()] == [list("abcde")]


def unbeaten(baskets, least, sure):
    """Every sure combination of tokens none of whose parts leads to the label as surely."""
    names = sorted({t for tokens, _ in baskets for t in tokens})
    found = {}
    for size in range(1, len(names) + 1):
        for c in combinations(names, size):
            n = [b for t, b in baskets if set(c) <= set(t)]
            if sum(n) >= least and sum(n) / len(n) >= sure:
                if not any(set(p) < set(c) and v >= sum(n) / len(n) for p, v in found.items()):
                    found[c] = sum(n) / len(n)
    return found


@pytest.mark.parametrize("allowed", [0, 10, 3])
def test_tokens_that_nearly_coincide(spark, allowed):
    """Each URL lacks one of ten tokens."""
    names = [f"t{i}" for i in range(10)]
    baskets = [([t for k, t in enumerate(names) if k != i % 10], not allowed or i % allowed != 1) for i in range(55)]
    df = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")
    settings = url_rules.Mining(min_confidence=0.6)
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine(df, settings).collect()}
    assert got == unbeaten(baskets, 20, 0.6)


@pytest.mark.parametrize("n", [17, 25])
@pytest.mark.parametrize("allowed", [0, 10])
def test_many_tokens_that_nearly_coincide(spark, n, allowed):
    names = [f"t{i:02}" for i in range(n)]
    baskets = [([t for k, t in enumerate(names) if k != i % n], not allowed or i % allowed != 1) for i in range(20 + 3 * n)]
    df = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")
    began = time.perf_counter()
    got = {tuple(r["antecedent"]): r["confidence"] for r in url_rules.mine(df).collect()}
    assert time.perf_counter() - began < 20
    missing = [{i % n for i, (_, b) in enumerate(baskets) if not b and i % n == k} for k in range(n)]
    telling = [names[k] for k in range(n) if missing[k]]
    singles = {c: v for c, v in unbeaten([([t for t in b if t in telling], x) for b, x in baskets], 20, 0.8).items() if len(c) > 1}
    assert {c: v for c, v in got.items() if len(c) > 1} == singles
    assert len([c for c in got if len(c) == 1]) == n


# Archives.


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def archive_by_hand(rows, min_bytes=0):
    first, out = {}, []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) >= min_bytes and payload in first:
            out.append((page, len(payload), digest, "revisit", first[payload]))
        else:
            first.setdefault(payload, page)
            out.append((page, len(payload), digest, "response", None))
    return sorted(out, key=str)


ARCHIVED = [
    (7, "http://a/\r\nX-Page-Id: 5", "same"), (10, "http://b/", "same"), (9, None, "same"),
    (1, "u", None), (2, "u", ""), (3, "u", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
    (4, "u", "Ünïcödé \U0001f600\r\n\r\n"), (5, "u", "z" * 300_000), (6, "u", "\n"), (6, "u", "\n"),
    (8, "u", "lone\x00\x1f"),
]


@pytest.mark.parametrize("min_bytes, limit", [(0, 1 << 20), (3, 1 << 20), (0, 0)])
def test_archives_by_hand(spark, monkeypatch, min_bytes, limit):
    monkeypatch.setattr(warc, "MAX_BROADCAST_BYTES", limit)
    got = warc.archive_pages(pages_of(spark, ARCHIVED), min_bytes).collect()
    assert sorted(map(tuple, got), key=str) == archive_by_hand(ARCHIVED, min_bytes)


def test_archive_of_odd_tables(spark):
    assert warc.archive_pages(pages_of(spark, [])).collect() == []
    extra = spark.createDataFrame([(None, "u", "a", 1), (1, "u", "a", 2)], PAGES + ", payload int")
    got = {r["page_id"]: r for r in warc.archive_pages(extra).collect()}
    assert got[1]["record_type"] == "response" and got[None]["refers_to"] == 1


def test_archives_hold_whole_records(spark, tmp_path):
    raw, slim = str(tmp_path / "raw"), str(tmp_path / "slim")
    warc.write_pages(pages_of(spark, ARCHIVED), raw)
    warc.write_deduplicated(spark, raw, slim)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_archive(spark, raw, payloads=True).collect()}
    assert payloads == {str(p): (h or "").encode() for p, _, h in ARCHIVED}
    seen = 0
    for file in Path(slim).glob("*.gz"):
        for headers, block in warc.parse(gzip.open(file)):
            seen += 1
            assert {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest"} <= set(headers)
            if headers["warc-type"] == "revisit":
                assert headers["warc-profile"].endswith("identical-payload-digest")
                assert headers["warc-refers-to"] and block.endswith(b"\r\n\r\n")
    assert seen == len(ARCHIVED)
    # Revisits of a deduplicated archive stay what they are.
    warc.write_deduplicated(spark, slim, str(tmp_path / "again"))
    one, two = (sorted(map(tuple, warc.resolved(warc.read_archive(spark, f)).collect()), key=str) for f in (slim, str(tmp_path / "again")))
    assert one == two


def test_damaged_records_are_refused():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(good * 2))] == [b"abc", b"abc"]
    for bad in (b"junk" + good, good[:-6]):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


# Near vectors.


def vectors_by_hand(rows, threshold=0.95):
    ok = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    links = {i: set() for i in range(len(rows))}
    for a, b in combinations(ok, 2):
        if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold:
            links[a].add(b)
            links[b].add(a)
    out = []
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - reach
            reach |= new
            todo += new
        least = min(rows[j][0] for j in reach)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out)


def clustered(n, seed=2, dim=16):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(n // 12, dim))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = draw.normal(size=dim)
        else:
            v = centres[draw.integers(len(centres))] + draw.normal(size=dim) * draw.choice([0.02, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v]))
    return rows


def test_near_vectors_by_hand(spark):
    rows = clustered(700)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15),
             (1004, [float("inf")] + [1.0] * 15), (1005, [None] + [1.0] * 15), (1006, [1.0, 0.0]), (1007, [1.0, 0.1])]
    rows += [(2000 + i, rows[1][1]) for i in range(40)] + [(2100, [x * 1e30 for x in rows[1][1]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, node int")
    got = sorted(tuple(r) for r in near_vectors.near_duplicates(df, shards=3, recall=1.0, audit=10_000).collect())
    assert got == vectors_by_hand(rows)
    assert near_vectors.near_duplicates(df.limit(0)).collect() == []


def test_recall_against_brute_force(spark):
    rows = clustered(3000, seed=3, dim=32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in near_vectors.near_duplicates(df, shards=2).collect()}
    expected = vectors_by_hand(rows)
    assert all(got[v]["n_links"] <= n for v, n, _, _ in expected)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(n for _, n, _, _ in expected)


def test_a_dense_cluster_widens_the_beam():
    draw = np.random.default_rng(1)
    unit = near_vectors._unit(draw.normal(size=16) + draw.normal(size=(400, 16)) * 0.02)
    levels = np.sort(near_vectors._levels(np.arange(400)))[::-1]
    graph = graphs.build(unit.astype(np.float32), levels)
    q, t, recall, _ = near_vectors.find_links(graph, unit, unit, 0.95, 50, 0.98)
    assert len(set(zip(q.tolist(), t.tolist()))) == 400 * 400 and recall >= 0.98


def test_a_failed_audit_ends_in_comparing_with_all():
    draw = np.random.default_rng(1)
    unit = near_vectors._unit(draw.normal(size=(100, 8)))
    broken = graphs.Graph(unit.astype(np.float32), [np.full((100, 4), -1, dtype=np.int32)])
    q, t, recall, beam = near_vectors.find_links(broken, unit, unit, 0.8, 100, 1.0)
    r, c = np.nonzero(unit @ unit.T >= 0.8)
    assert set(zip(q.tolist(), t.tolist())) == set(zip(r.tolist(), c.tolist())) and beam == 100


def hub_and_pairs(hub, pairs, dim=16, seed=5):
    """A group of distinct linked vectors, and pairs that link with nothing else."""
    draw = np.random.default_rng(seed)
    group = draw.normal(size=dim) + draw.normal(size=(hub, dim)) * 0.02
    one = draw.normal(size=(pairs, dim))
    return near_vectors._unit(np.concatenate([group, one, one + draw.normal(size=one.shape) * 0.05]))


def test_a_hub_does_not_hide_the_lost_links_of_pairs():
    unit = hub_and_pairs(400, 400)
    draw = np.random.default_rng(6)
    order = draw.permutation(len(unit))
    unit, is_hub = unit[order], order < 400
    levels = np.sort(near_vectors._levels(np.arange(len(unit))))[::-1]
    graph = graphs.build(unit.astype(np.float32), levels)
    # The pairs' members are found from nowhere but the places a search begins at.
    graph.layers[0][~is_hub] = -1
    graph.layers[0][np.isin(graph.layers[0], np.flatnonzero(~is_hub))] = -1
    own = np.arange(len(unit))
    q, t, recall, _ = near_vectors.find_links(graph, unit, unit, 0.95, 128, 0.98, own)
    r, c = np.nonzero(unit @ unit.T >= 0.95)
    assert set(zip(q.tolist(), t.tolist())) == set(zip(r.tolist(), c.tolist())) and recall >= 0.98


def test_links_come_in_blocks(monkeypatch):
    unit = hub_and_pairs(300, 300)
    unit = unit[np.random.default_rng(7).permutation(len(unit))]
    levels = np.sort(near_vectors._levels(np.arange(len(unit))))[::-1]
    graph = graphs.build(unit.astype(np.float32), levels)
    monkeypatch.setattr(near_vectors, "_HELD", 2000)
    blocks = list(near_vectors.link_blocks(graph, unit, unit, 0.95, 16))
    assert max(len(q) for q, _ in blocks) <= 2000
    found = [p for q, t in blocks for p in zip(q.tolist(), t.tolist())]
    r, c = np.nonzero(unit @ unit.T >= 0.95)
    assert len(found) == len(set(found)) >= 0.99 * len(r) and set(found) <= set(zip(r.tolist(), c.tolist()))


def test_shards_follow_from_the_table(spark, monkeypatch):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(hub_and_pairs(100, 100))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(near_vectors, "SHARD_VALUES", 600)
    assert near_vectors.shard_count(df.selectExpr("size(embedding) AS dim")) == 8
    monkeypatch.setattr(near_vectors, "SHARDS", 1)
    assert near_vectors.shard_count(df.limit(30).selectExpr("size(embedding) AS dim")) == 1
    monkeypatch.setattr(near_vectors, "SHARD_VALUES", 2400)
    got = sorted(tuple(r) for r in near_vectors.near_duplicates(df).collect())
    assert got == vectors_by_hand(rows)


# Components.


def test_components_by_hand(spark):
    draw = random.Random(1)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)]
    links += [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {n: r for n, r in got.items() if n != r} == {n: find(n) for n in root if find(n) != n}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


# Page text.

WHOLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><nav><a href=/>Home</a></nav></header>
<div class="cookie-notice">We use cookies</div><aside class=sidebar><p>Side words here</p></aside>
<%(root)s><h1>The   title</h1><p>First &amp; best<br>line &lt;here&gt; with <b>bo</b>ld and <a href="x">a link</a>.
<p>Second&nbsp;paragraph <!-- not this --> goes on<div class="ad">Buy now</div><p>Third<script>if(a<b){}</script> one</p>
<form><p>Your mail</p></form><ul><li>item one<li>item two</ul>
<section id="comments"><article class="comment"><p>Nice read</p></article></section></%(root)s>
<footer>&copy; someone</footer></body>"""
EXPECTED = "The title First & best line <here> with bold and a link. Second paragraph goes on Third one item one item two"


@pytest.mark.parametrize("root", ["article", "main", "div role=main", "div itemprop='articleBody'"])
def test_main_text_of_named_content(root):
    page = WHOLE % {"root": root}
    assert html_text.main_text(page, html_text.Weights()) == EXPECTED


def test_an_article_is_narrower_than_the_main_part():
    page = "<main><p>around it</p><article><p>the text</p></article><div class=cookiebar>no</div></main>"
    assert html_text.main_text(page, html_text.Weights()) == "the text"
    assert html_text.main_text(page.replace("article", "div"), html_text.Weights()) == "around it the text"


def test_best_run_without_named_content(spark):
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(5))
    marked = [(i, "u", f"<body><div><a>x</a><a>y</a></div><article>{body}</article><div>few words</div></body>") for i in range(20)]
    weights = html_text.learn(pages_of(spark, marked))
    assert weights.word["p"] > weights.word["div"] > 0 > weights.tag["p"] > weights.tag["a"]
    page = f"<body><div><a>x</a><a>y</a></div><div>{body}</div><div><span>few</span> words</div></body>"
    assert html_text.main_text(page, weights) == " ".join("word " * 40 + str(i) for i in range(5)).replace("  ", " ")


def test_run_is_the_best_of_all(spark):
    weights = html_text.Weights()
    draw = random.Random(2)
    for _ in range(50):
        parts = [draw.choice(["<div>", "</div>", "<hr>", "one two three four", "five"]) for _ in range(14)]
        page = " ".join(parts)
        found = list(html_text.pieces(page))
        score = [p.words if p.kind == "text" else weights.of_tag(p.name) for p in found]
        best = max([sum(score[a:b]) for a in range(len(score)) for b in range(a, len(score) + 1)] or [0])
        words = len(html_text.main_text(page, weights).split())
        assert words >= best


def test_pages_of_all_kinds(spark):
    odd = [(1, None, None), (2, "u", ""), (3, "u", "plain words only"), (4, "u", "<"), (5, "u", "<p title=\"open>x</p> <p>y"),
           (6, "u", "<script>never closed"), (None, "u", "<p>a</p>"), (3, "u", "plain words only"),
           (7, "u", "<p>" + "long " * 100_000), (8, "u", "<b>" * 5_000 + "deep"), (9, "u", "<p a='" * 20_000), (10, "u", "a &#x1F600; &bogus; &#0;")]
    got = html_text.extract(pages_of(spark, odd).selectExpr("*", "1 AS text")).collect()
    assert len(got) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert (by[1], by[2], by[3], by[6]) == ("", "", "plain words only", "")
    assert by[7] == ("long " * 100_000).strip() and by[10].startswith("a \U0001f600")
    assert html_text.extract(pages_of(spark, [])).collect() == []


@pytest.mark.parametrize("body", ["<body>", "", "<body class=x>"])
def test_a_head_without_an_end_tag(body):
    page = f"<html><head><meta charset=utf-8><title>No</title><link rel=x>{body}<p>first words</p><p>more of them</p>"
    assert html_text.main_text(page, html_text.Weights()) == "first words more of them"


@pytest.mark.parametrize("slug", ["discussion", "related-work", "search", "cookies", "login"])
def test_ids_made_from_headings_are_no_marks(slug):
    page = (f"<article><p>one</p><section id='{slug}'><h2 id={slug}-2>two</h2><p>three</p></section>"
            f"<h2><span id={slug}>four</span></h2><div id={slug}>five</div><section class='{slug}'>six</section>"
            f"<div class={slug}>no</div></article>")
    assert html_text.main_text(page, html_text.Weights()) == "one two three four five six"


WORDS = "alpha beta gamma delta epsilon zeta eta theta"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><nav>menu</nav><div class="layout has-sidebar"><article><p>{WORDS}</p></article><div class="sidebar">x y</div></div>',
        f'<div class="post comments-open"><article><p>{WORDS}</p><div class="comments">nice words here</div></article></div>',
        f'<div class="related"><article>other news</article></div><article><p>{WORDS}</p></article>',
        '<article><section class="discussion"><h2 class="alert">alpha</h2><p class="related">beta gamma</p></section>'
        '<div id="search">delta</div><math><mi>epsilon</mi></math> <p data-role="ad">zeta</p><p id="login">eta theta</p></article>',
        f'<article><p>{WORDS}</p><div class="ad">buy</div><p class="advert">now</p><section class="comments">hm</section>'
        '<form>send</form><div class="share">f t</div></article>',
    ],
)
def test_words_of_a_class_mark_what_they_belong_to(page):
    assert html_text.main_text(page, html_text.Weights()) == WORDS


def test_pages_that_name_nothing(spark):
    """The same pages with named content and without: the run has to find it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.learn(pages)
    html = [r["html"] for r in pages.collect()]
    plain = [re.sub(r"(?i)(</?)(article|main)\b", r"\1div", h) for h in html]
    same = [html_text.main_text(a, weights) == html_text.main_text(b, weights) for a, b in zip(html, plain)]
    assert sum(same) >= 0.95 * len(html)
