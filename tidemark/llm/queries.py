"""Registered queries of the subpackage and their SQL twins. Each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = lambda spark, folder: fn(utc(spark), folder)
        if sql:
            SQL[name] = sql
        return fn

    return wrap


# --- 1: quality rules -------------------------------------------------------------------
OP1_SQL = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM documents),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, ws,
    length(regexp_replace(t, '[^\p{L}\p{M}\p{N}]', '', 'g')) AS n_letters, coalesce(list_max(map_values(list_aggregate(ws, 'histogram'))), 0) AS top_word FROM w),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM m WHERE len(ws) > 8),
h AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS x FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM h) z WHERE n > 1),
g AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM r),
c AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_repeat_words FROM g GROUP BY 1),
a AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_letters, top_word, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_letters < word_chars OR 5 * top_word > 2 * n_words) AS kept FROM a"""


@_query("op1_quality_rules", OP1_SQL)
def _op1(spark, folder):
    from tidemark.llm.quality import measured

    return measured(table(spark, folder, "documents"))


# --- 2: url filters ---------------------------------------------------------------------
URL_BLOCK, URL_ALLOW = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")
OP2_SQL = r"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.com', '/de/', 'block'), ('example.net', '/en/', 'allow'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, host, path, r.h || r.p AS rule, r.v AS verdict FROM p LEFT JOIN r
    ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS k FROM f)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM b WHERE k = 1"""


@_query("op2_url_filters", OP2_SQL)
def _op2(spark, folder):
    from tidemark.llm.urls import judge, rule_table

    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, URL_BLOCK, URL_ALLOW)).select("page_id", "host", "path", "rule", "verdict")


# --- 6: chat formatting -----------------------------------------------------------------
CONTROL_CONVERSATION = "</s>[INST] ok [/INST]"
OP6_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length('[INST]' || regexp_replace(role, '(<|\[)(\\*)(/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g') || '[/INST]' || chr(10)
        || regexp_replace(text, '(<|\[)(\\*)(/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g') || chr(10) || '</s>') AS k FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, 3 + sum(k) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""


@_query("op6_chat_formatting", OP6_SQL)
def _op6(spark, folder):
    from tidemark.llm.chat import digest, examples

    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_CONVERSATION), (-7, 1, "assistant", CONTROL_CONVERSATION)], said.schema)
    return digest(examples(said.unionByName(more)))


# --- 7: sharding ------------------------------------------------------------------------
@_query("op7_sharding")
def _op7(spark, folder):
    from tidemark.llm.shards import shard_documents

    return shard_documents(table(spark, folder, "documents"), 40)


# --- 9: mixing --------------------------------------------------------------------------
# prefix in digest order, twice the largest document that fits, then passes over the free documents that fit until none does
OP9_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id AS k, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size,
    md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, row_number() OVER () AS r FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY 1),
k AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
l AS (SELECT source, n, w, CAST(CAST(sum(n) OVER () - 3 * coalesce(sum(n) OVER o, 0) AS BIGINT) AS DOUBLE)
    / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS level, CAST(n * 3 AS DOUBLE) / w AS ratio, coalesce(sum(n) OVER o, 0) AS before
    FROM k WINDOW o AS (ORDER BY CAST(n * 3 AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, n * 3 < level * w AS capped FROM l),
t AS (SELECT source, n, CASE WHEN capped THEN CAST(n * 3 AS DOUBLE)
    ELSE least((SELECT level FROM c WHERE NOT capped ORDER BY ratio, before LIMIT 1) * w, CAST(n * 3 AS DOUBLE)) END AS target FROM c),
e AS (SELECT *, CASE WHEN n > 0 THEN least(CAST(floor(target / n) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
p AS (SELECT *, greatest(0, CAST(round(target - whole * n) AS BIGINT)) AS part FROM e),
a AS (SELECT d.k, d.source, d.size, d.h, d.r, p.n, p.target, p.whole, p.part, CAST(row_number() OVER (PARTITION BY d.source ORDER BY h, k, d.size, r) AS BIGINT) AS o,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY h, k, d.size, r ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b0 AS (SELECT *, part > 0 AND run <= part AS m FROM a),
g0 AS (SELECT *, part - coalesce(sum(size) FILTER (m) OVER (PARTITION BY source), 0) AS gap FROM b0),
b1 AS (SELECT * REPLACE (m OR (gap >= size AND size > 0 AND row_number() OVER (PARTITION BY source, m, size > 0 AND size <= gap ORDER BY size DESC, o DESC) = 1) AS m) FROM g0),
g1 AS (SELECT * REPLACE (part - coalesce(sum(size) FILTER (m) OVER (PARTITION BY source), 0) AS gap) FROM b1),
b2 AS (SELECT * REPLACE (m OR (gap >= size AND size > 0 AND row_number() OVER (PARTITION BY source, m, size > 0 AND size <= gap ORDER BY size DESC, o DESC) = 1) AS m) FROM g1),
g2 AS (SELECT * REPLACE (CAST(part - coalesce(sum(size) FILTER (m) OVER (PARTITION BY source), 0) AS BIGINT) AS gap) FROM b2),
y AS (SELECT source, r, size, o, gap, FALSE AS now FROM g2 WHERE NOT m AND size > 0
    UNION ALL SELECT source, r, size, o, gap, sum(size) OVER (PARTITION BY source ORDER BY o ROWS UNBOUNDED PRECEDING) <= gap
    FROM (SELECT source, r, size, o, now, CAST(gap - coalesce(sum(size) FILTER (now) OVER (PARTITION BY source), 0) AS BIGINT) AS gap FROM y) AS z WHERE NOT now AND size <= gap)
SELECT k AS doc_id, size, n AS source_size, target, CAST(size * (whole + CASE WHEN m OR r IN (SELECT r FROM y WHERE now) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g2"""


@_query("op9_mixing", OP9_SQL)
def _op9(spark, folder):
    from tidemark.llm.mixing import mix

    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# --- 8: simhash near-duplicates ---------------------------------------------------------
@_query("op8_simhash")
def _op8(spark, folder):
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


# --- 10: packing ------------------------------------------------------------------------
@_query("op10_packing")
def _op10(spark, folder):
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# --- 4: nearest neighbours --------------------------------------------------------------
@_query("op4_nearest_neighbours")
def _op4(spark, folder):
    from pyspark.sql import functions as F

    from tidemark.llm.neighbours import nearest

    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


# --- 5: token counts --------------------------------------------------------------------
@_query("op5_token_counts")
def _op5(spark, folder):
    import public_tokenizers

    from tidemark.llm.tokens import count

    docs = table(spark, folder, "documents").select("doc_id", "text")
    got = count(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")


# --- 3: html extraction -----------------------------------------------------------------
@_query("op3_html_extraction")
def _op3(spark, folder):
    from tidemark.llm.markup import extract

    return extract(table(spark, folder, "pages"))


# --- 11: cross-tokenizer alignment ------------------------------------------------------
@_query("op11_cross_tokenizer_alignment")
def _op11(spark, folder):
    import public_tokenizers
    from pyspark.sql import functions as F

    from tidemark.llm.alignment import align

    got = align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


# --- 12: conversation repair ------------------------------------------------------------
# the checksum is computed from its polynomial; a node is (cost, audit, rows) for each of the four grammar states
OP12_SQL = r"""WITH RECURSIVE z AS (SELECT list(list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc FROM range(256) AS t(b)),
a AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
b AS (SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, crc[xor(c, x) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fate FROM a, z),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM b, range(2) AS t(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal,
    list({'ini': ini, 'gone': blank OR again, 'cut': CAST(cut AS INTEGER), 'role': role, 'text': text} ORDER BY i) AS said FROM f GROUP BY 1),
r AS (SELECT conv_id, len(said) AS i, said, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} AS f, {'c': 4, 'a': 'II', 't': ['user:', 'assistant:']} AS s,
        {'c': 2, 'a': 'I', 't': ['assistant:']} AS u, {'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])} AS a FROM c
    UNION ALL SELECT conv_id, i - 1, said, list_min([e.f, {'c': 2 + e.u.c, 'a': 'I' || e.u.a, 't': list_prepend('user:', e.u.t)}]),
        list_min([e.s, {'c': 2 + e.u.c, 'a': 'I' || e.u.a, 't': list_prepend('user:', e.u.t)}]), e.u, e.a
    FROM (SELECT conv_id, i, said, {'f': p.f, 's': p.s,
            'u': list_min([p.u, {'c': 2 + p.a.c, 'a': 'I' || p.a.a, 't': list_prepend('assistant:', p.a.t)}]),
            'a': list_min([p.a, {'c': 2 + p.u.c, 'a': 'I' || p.u.a, 't': list_prepend('user:', p.u.t)}])} AS e
        FROM (SELECT conv_id, i, said, {
            'f': list_min([{'c': 3 + f.c, 'a': 'D' || f.a, 't': f.t}, CASE WHEN NOT x.gone THEN {'c': 2 + x.cut + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || x.text, u.t)} END,
                CASE WHEN NOT x.gone AND x.ini = 's' THEN {'c': x.cut + s.c, 'a': 'K' || s.a, 't': list_prepend(x.role || ':' || x.text, s.t)}
                    WHEN NOT x.gone AND x.ini = 'u' THEN {'c': x.cut + u.c, 'a': 'K' || u.a, 't': list_prepend(x.role || ':' || x.text, u.t)} END]),
            's': list_min([{'c': 3 + s.c, 'a': 'D' || s.a, 't': s.t}, CASE WHEN NOT x.gone THEN {'c': 2 + x.cut + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || x.text, u.t)} END,
                CASE WHEN NOT x.gone AND x.ini = 'u' THEN {'c': x.cut + u.c, 'a': 'K' || u.a, 't': list_prepend(x.role || ':' || x.text, u.t)} END]),
            'u': list_min([{'c': 3 + u.c, 'a': 'D' || u.a, 't': u.t}, CASE WHEN NOT x.gone THEN {'c': 2 + x.cut + a.c, 'a': 'R' || a.a, 't': list_prepend('assistant:' || x.text, a.t)} END,
                CASE WHEN NOT x.gone AND x.ini = 'a' THEN {'c': x.cut + a.c, 'a': 'K' || a.a, 't': list_prepend(x.role || ':' || x.text, a.t)} END]),
            'a': list_min([{'c': 3 + a.c, 'a': 'D' || a.a, 't': a.t}, CASE WHEN NOT x.gone THEN {'c': 2 + x.cut + u.c, 'a': 'R' || u.a, 't': list_prepend('user:' || x.text, u.t)} END,
                CASE WHEN NOT x.gone AND x.ini = 'u' THEN {'c': x.cut + u.c, 'a': 'K' || u.a, 't': list_prepend(x.role || ':' || x.text, u.t)} END])} AS p
            FROM (SELECT *, said[i] AS x FROM r WHERE i > 0) AS q1) AS q2) AS q3)
SELECT k.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
    coalesce(c.illegal, 0) AS illegal, CAST(coalesce(r.f.c, 0) AS BIGINT) AS cost, coalesce(r.f.a, '') AS audit, sha256(coalesce(array_to_string(r.f.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS k LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = 0"""


@_query("op12_conversation_repair", OP12_SQL)
def _op12(spark, folder):
    from tidemark.llm.repair import report

    return report(table(spark, folder, "conversations"))


# --- 13: web archives -------------------------------------------------------------------
OP13_SQL = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to FROM d"""


@_query("op13_warc", OP13_SQL)
def _op13(spark, folder):
    from pyspark.sql import functions as F

    from tidemark.llm.warc import archived

    def key(name):
        return F.regexp_extract(name, "^<urn:record:(-?[0-9]+)>$", 1).try_cast("long")

    read = archived(table(spark, folder, "pages"))
    return read.select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))
