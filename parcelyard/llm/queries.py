"""The numbered operators over the driver's tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelyard.llm import (
    conversation_repair,
    decontamination,
    html_text,
    license_scan,
    mixing,
    near_vectors,
    prefix_trie,
    sharding,
    simhash,
    toxicity,
    url_rules,
    warc,
    window_dedup,
)
from parcelyard.llm.mixing import SEED
from parcelyard.llm.runs import sha256_of_runs

MIX_EXPONENT = 0.5
SHARDS = 16
# Conversations that share a head, and the longest head and one.
GROUP, HEADS = 5, 9
URL_RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mixing.mix(docs, exponent=MIX_EXPONENT)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose document is labelled as of low quality teach what to block."""
    labels = _read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked")
    )
    pages = _read(spark, sf_dir, "pages")
    return url_rules.judge(pages, labels, url_rules.given_rules(URL_RULES))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return sharding.place(docs, sharding.shard_names(SHARDS))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.dedup_lines(_read(spark, sf_dir, "documents"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(
        _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's faults: a row's CRC-32 drops it, empties or cuts its text, repeats
    it, or makes it the user's. Nulls read as one space."""
    space = F.lit(" ")
    read = {c: F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(read["conv_id"], F.lit(":"), read["turn"]).cast("binary")) % 20
    text, repeats = read["text"], F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))
    return conversations.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(read["role"]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(repeats).alias("_"),
    ).drop("_")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _read(spark, sf_dir, "conversations")
    found = conversation_repair.repair(damage(conversations))
    line = F.concat("role", F.lit(":"), "text")
    hashes = sha256_of_runs(found.turns, "conv_id", ["pos", "nr"], line, "\n", "repaired_sha256")
    out = conversations.select(F.col("conv_id").alias("id")).distinct()
    for part in (found.report, hashes):
        same = F.col("id").eqNullSafe(F.col("conv_id"))
        out = out.join(part, same, "left").drop("conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt(_read(spark, sf_dir, "conversations"), GROUP, HEADS)
    nodes, ends = prefix_trie.prefix_trie(turns, convs)
    hashes = prefix_trie.ends_sha256(ends)
    return nodes.join(hashes, "node", "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def all_queries() -> dict[str, Query]:
    found = (
        op1_mixing,
        op2_url_rules,
        op3_simhash,
        op4_toxicity,
        op5_warc,
        op6_sharding,
        op7_line_dedup,
        op8_near_vectors,
        op9_main_text,
        op10_decontamination,
        op11_license_scan,
        op12_conversation_repair,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
WINDOW = decontamination.WINDOW


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


MIX_SQL = f"""
WITH sizes AS (
    SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM documents GROUP BY source
), rates AS (
    SELECT source, pow(size, {MIX_EXPONENT}) / sum(pow(size, {MIX_EXPONENT})) OVER ()
        * sum(size) OVER () / size AS rate
    FROM sizes
), pieces AS (
    SELECT source, greatest(ceil(rate / 16), 1)::INT AS pieces,
        rate / greatest(ceil(rate / 16), 1) AS mean
    FROM rates
), sums AS (
    SELECT source, pieces, k,
        sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
    FROM pieces, range(0, 90) AS r(k)
), draws AS (
    SELECT d.doc_id, d.source, piece,
        {_number(f"'{SEED}:' || d.doc_id || ':' || piece")} / pow(2, 52) AS u
    FROM documents d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source,
        range(1, p.pieces + 1) AS r(piece)
), counts AS (
    SELECT doc_id, count(*) AS n
    FROM draws d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source AND s.p <= d.u
    GROUP BY doc_id
)
SELECT d.*, copy::INT AS copy,
    {_number(f"'{SEED}:place:' || d.doc_id || ':' || copy")} AS place
FROM documents d JOIN counts c USING (doc_id), range(1, c.n + 1) AS r(copy)
"""

# Turns are taken one by one; a shard's next claim is the first free slot of its order.
SHARD_SQL = f"""
WITH RECURSIVE shards AS (
    SELECT i AS shard, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name
    FROM range(0, {SHARDS}) AS r(i)
), orders AS MATERIALIZED (
    SELECT list(list_transform(range(0, {sharding.SLOTS}), lambda j:
        ({_number("name || ':offset'")} % {sharding.SLOTS}
            + j * ({_number("name || ':skip'")} % {sharding.SLOTS - 1} + 1)) % {sharding.SLOTS})
        ORDER BY shard) AS prefer
    FROM shards
), turns AS (
    SELECT 0 AS turn, repeat('0', {sharding.SLOTS})::BIT AS taken, []::BIGINT[] AS claims
    UNION ALL
    SELECT turn + 1, set_bit(taken, claim::INT, 1), list_append(claims, claim)
    FROM (
        SELECT turn, taken, claims, list_filter(prefer[turn % {SHARDS} + 1],
            lambda s: get_bit(taken, s::INT) = 0)[1] AS claim
        FROM turns, orders WHERE turn < {sharding.SLOTS}
    )
), slots AS (
    SELECT unnest(claims) AS slot, (generate_subscripts(claims, 1) - 1) % {SHARDS} AS shard
    FROM turns WHERE turn = {sharding.SLOTS}
)
SELECT d.*, slot, shard::INT AS shard
FROM documents d JOIN slots ON slot = {_number("doc_id::VARCHAR")} % {sharding.SLOTS}
"""

LINES_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents
), filled AS (
    SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nr,
        count(*) OVER (PARTITION BY doc_id) AS n
    FROM lines WHERE trim(line, chr(9) || chr(11) || chr(12) || chr(13) || ' ') <> ''
), windows AS (
    SELECT a.doc_id, a.nr, a.line || coalesce(chr(10) || b.line, '') || coalesce(chr(10) || c.line, '') AS w
    FROM filled a
    LEFT JOIN filled b ON b.doc_id = a.doc_id AND b.nr = a.nr + 1
    LEFT JOIN filled c ON c.doc_id = a.doc_id AND c.nr = a.nr + 2
    WHERE a.nr + 2 <= a.n OR a.nr = 1
), later AS (
    SELECT doc_id, nr FROM windows
    QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, nr) > 1
), gone AS (
    SELECT DISTINCT f.doc_id, f.pos FROM later l JOIN filled f
    ON f.doc_id = l.doc_id AND f.nr BETWEEN l.nr AND l.nr + 2
)
SELECT d.doc_id, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text,
    count(*)::INT AS n_lines, count(g.pos)::INT AS n_removed
FROM documents d JOIN lines l ON l.doc_id = d.doc_id
LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id
"""


# Every window is looked up among all windows of the documents.
DECONTAMINATION_SQL = f"""
WITH doc_words AS (
    SELECT doc_id, regexp_extract_all(translate(text, {_AZ}), {_WORD}) AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, {_AZ}), {_WORD}) AS w FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, array_slice(w, i, i + {WINDOW - 1}) AS gram
    FROM item_words, range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1) AS r(i) WHERE len(w) > 0
), doc_windows AS (
    SELECT doc_id, i, n, array_slice(w, i, i + n - 1) AS gram
    FROM doc_words, (SELECT DISTINCT len(gram) AS n FROM item_windows), range(1, len(w) - n + 2) AS r(i)
), hits AS (
    SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (gram)
), words_hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items_hit AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
        string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
    FROM hits GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, {_AZ}), {_WORD})"


# Every block is compared with every template.
LICENSE_SQL = f"""
WITH phrases AS (
    SELECT {_words_sql('p')} AS p, label
    FROM (VALUES {', '.join(f"('{p}', '{label}')" for p, label in license_scan.PHRASES)}) AS v(p, label)
), templates AS (
    SELECT label, list_distinct(t) AS t, CASE WHEN len(t) <= {license_scan.LEAST_STEP} THEN {license_scan.LEAST_STEP}
        ELSE pow(2, ceil(log2(len(t))))::INT END AS step
    FROM (SELECT label, {_words_sql('t')} AS t
        FROM (VALUES {', '.join(f"('{label}', '{t}')" for label, t in license_scan.TEMPLATES)}) AS v(label, t))
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_words_sql('text')}, []) AS w FROM documents
), base AS (
    SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels
    FROM (SELECT r, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) AS i
        FROM docs, phrases WHERE len(w) >= len(p))
    GROUP BY r
), blocks AS (
    SELECT r, step, list_distinct(w[b * step + 1:(b + 2) * step]) AS words
    FROM docs, (SELECT DISTINCT step FROM templates), range(0, len(w) // step + 1) AS x(b)
    WHERE b * step < len(w)
), contained AS (
    SELECT r, label, len(list_intersect(words, t)) / len(t) AS share
    FROM blocks JOIN templates USING (step) WHERE len(list_intersect(words, t)) >= ceil(0.8 * len(t) - 1e-9)
), more AS (
    SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM contained GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN base b USING (r) LEFT JOIN more m USING (r)
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, by the table ``tab`` of the remainders of all bytes."""
    steps = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, b: "
        "xor(c >> 8, tab[(xor(c, b) & 255)::INT + 1])), 4294967295)"
    )


_CRC_TABLE = """crc AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(n, repeat([0::BIGINT], 8)), lambda c, x:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
    FROM range(256) AS r(n)
)"""


def _way(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state's sequence of edits with one more; null where there is none."""
    lines = f"list_append({state}.lines, {line})" if line else f"{state}.lines"
    return (
        f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, "
        f"'audit': {state}.audit || '{letter}', 'lines': {lines}}} END"
    )


def _turn(state: str, role: str) -> str:
    """Keeping the row as a turn of ``role``, or giving it that role."""
    keep = _way(state, "extra", "K", "role || ':' || text")
    rerole = _way(state, "extra + 1", "R", f"'{role}:' || text")
    return f"CASE WHEN kind < 2 THEN CASE WHEN left(role, 1) = '{role[0]}' THEN {keep} ELSE {rerole} END END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


# The least (cost, audit) per state after each row, carried from row to row. An insert costs
# more than some other way out (the tests hold this against all edits), so there is none here.
REPAIR_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
    FROM conversations
), faults AS (
    SELECT keyed.*, {_crc32('k')} % 20 AS fault FROM keyed, crc
), damaged AS (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM faults WHERE fault <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM damaged
), marked AS (
    SELECT *, CASE WHEN body = '' THEN 2
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 3
            WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS kind,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
    FROM placed
), priced AS (
    SELECT *, CASE kind WHEN 1 THEN 5 ELSE 0 END AS extra FROM marked
), ways AS (
    SELECT conv_id, 0::BIGINT AS step, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS nothing,
        NULL::STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[]) AS sys,
        NULL::STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[]) AS usr,
        NULL::STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[]) AS ast
    FROM (SELECT DISTINCT conv_id FROM priced)
    UNION ALL
    SELECT w.conv_id, w.step + 1, {_way('nothing', '2', 'D')},
        {_least(_way('sys', '2', 'D'), f"CASE WHEN kind < 2 AND left(role, 1) = 's' THEN {_way('nothing', 'extra', 'K', "role || ':' || text")} END")},
        {_least(_way('usr', '2', 'D'), *[_turn(x, 'user') for x in ('nothing', 'sys', 'ast')])},
        {_least(_way('ast', '2', 'D'), _turn('usr', 'assistant'))}
    FROM ways w JOIN priced p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.pos = w.step + 1
), counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (kind = 2) AS blank, count(*) FILTER (kind = 3) AS duplicate,
        count(*) FILTER (kind = 1) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM priced GROUP BY conv_id
), best AS (
    SELECT c.*, {_least('nothing', 'ast')} AS way
    FROM counts c JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.step = c.n
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
    coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0)::BIGINT AS cost, coalesce(way.audit, '') AS audit,
    sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""


# Every prefix of every conversation as a list of turns; a node's subtree by the paths of
# the smallest members of all nodes.
TRIE_SQL = f"""
WITH {_CRC_TABLE}, turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_crc32('conv_id::VARCHAR')} % {HEADS} AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc
), lists AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS l FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) AS l
    FROM convs c JOIN lists o ON o.conv_id = c.conv_id LEFT JOIN lists b ON b.conv_id = c.base
), prefixes AS (
    SELECT conv_id, d AS depth, l[1:d] AS prefix, len(l) AS n FROM rebuilt, range(0, len(l) + 1) AS r(d)
), nodes AS (
    SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, prefix
), paths AS (
    SELECT p.conv_id AS member, p.depth, n.conv_id FROM prefixes p JOIN nodes n USING (depth, prefix)
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id,
        CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[n.depth].text) END AS saved
    FROM nodes n LEFT JOIN paths p ON p.member = n.conv_id AND p.depth = n.depth - 1
), childs AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
    FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
    SELECT l.*, coalesce(c.n_children, 0) AS n_children
    FROM linked l LEFT JOIN childs c ON c.conv_id = l.conv_id AND c.depth = l.depth
), sums AS (
    SELECT p.conv_id, p.depth, count(*) FILTER (c.n_children = 0) AS n_leaves, sum(c.saved)::BIGINT AS saved_tokens
    FROM counted c JOIN paths p ON p.member = c.conv_id AND p.depth <= c.depth GROUP BY ALL
)
SELECT c.conv_id, c.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted c JOIN sums s ON s.conv_id = c.conv_id AND s.depth = c.depth
"""


def all_oracles() -> dict[str, str]:
    return {
        "op1_mixing": MIX_SQL,
        "op6_sharding": SHARD_SQL,
        "op7_line_dedup": LINES_SQL,
        "op10_decontamination": DECONTAMINATION_SQL,
        "op11_license_scan": LICENSE_SQL,
        "op12_conversation_repair": REPAIR_SQL,
        "op13_prefix_trie": TRIE_SQL,
    }
