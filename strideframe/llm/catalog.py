"""The driver's queries over the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.llm import bpe, chat, decontaminate, language, line_dedup, minhash, quality, sharding, url_filter, warc
from strideframe.llm.common import table

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", F.length("text").cast("long").alias("left_chars"), F.sha2("text", 256).alias("left_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leak = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return leak.select(
        "doc_id", "leak.n_words", "leak.n_hit", "leak.n_items",
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"), "leak.contaminated",
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    made = chat.render(chat.reconstruct(chat.to_events(rows))).select("conv_id", "formatted", "loss_spans")
    read = made.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_again = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_again, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica in which, by a rule on the id, records have changed in place or grown, are gone, or were added.

    An added record stands first in its file, so that all offsets behind it differ. Added ones are told by negative ids.
    """
    records = warc.to_records(table(spark, sf_dir, "pages"))
    rule = F.coalesce(F.col("page_id") % 50, F.lit(0))
    damaged = F.when(rule == 7, F.overlay("record", F.lit("X"), 1)).when(rule == 9, F.concat("record", F.lit("zzz"))).otherwise(F.col("record"))
    replica = records.filter(rule != 8).withColumn("record", damaged)
    added = records.filter(rule == 11).select("file", (-1 - F.col("page_id")).alias("page_id"), "url", F.concat(F.lit("extra "), F.col("record")).alias("record"))
    places = warc.manifest(records)
    found = warc.audit(places, warc.manifest(replica.union(added)))
    columns = ["page_id", "file", "ord", "start", "stop", "digest"]
    judged = places.join(found.filter("ord IS NOT NULL").select("file", "ord", "status"), ["file", "ord"], "left")
    extra = found.filter("status = 'extra'").select("page_id", "file", *[F.col(f"copy_{c}").alias(c) for c in columns[2:]], "status")
    return judged.select(*columns, F.coalesce("status", F.lit("ok")).alias("status")).union(extra)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_line_dedup": op2_line_dedup,
        "op3_sharding": op3_sharding,
        "op4_decontaminate": op4_decontaminate,
        "op5_chat_format": op5_chat_format,
        "op6_minhash": op6_minhash,
        "op7_quality_rules": op7_quality_rules,
        "op8_warc_fixity": op8_warc_fixity,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_language_id": op10_language_id,
    }


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1 = f"""
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES {", ".join(repr(r) for r in URL_RULES)}),
m AS (
  SELECT p.rid, rhost || rpath AS rule, v,
         row_number() OVER (PARTITION BY p.rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, v DESC) AS k
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN m ON m.rid = p.rid AND m.k = 1
"""

# CRC-32 by its table of 256 remainders, byte by byte; large groups are packed one piece a step into the shard with most room.
_OP3 = f"""
WITH RECURSIVE tb AS (SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, coalesce(substr(sha256(text), 1, 15), '') AS k, coalesce(substr(sha256(text), 16, 15), '') AS k2,
             xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(text), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, tb),
tt AS (SELECT sum(size)::BIGINT AS total FROM d),
h0 AS (SELECT k, k2, sum(size)::BIGINT AS b FROM d GROUP BY k, k2 HAVING count(*) > 1 AND sum(size) > {sharding.LARGE}::DOUBLE * (SELECT total FROM tt) / {sharding.SHARDS}),
h AS (SELECT *, row_number() OVER (ORDER BY k, k2) AS g FROM h0), hv AS (SELECT *, row_number() OVER (ORDER BY b DESC, g) AS o FROM h),
pk(o, off, room, g, lo, hi, s) AS (
  SELECT 1::BIGINT, 0::BIGINT, list_transform(range({sharding.SHARDS}), lambda i: total / {sharding.SHARDS}::DOUBLE), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM tt
  UNION ALL SELECT CASE WHEN off + take >= b THEN o + 1 ELSE o END, CASE WHEN off + take >= b THEN 0 ELSE off + take END,
    list_transform(room, lambda x, i: CASE WHEN i = w THEN x - take ELSE x END), g, off, off + take, w - 1
  FROM (SELECT *, CASE WHEN b - off <= room[w] THEN b - off ELSE greatest(1, CAST(ceil(room[w]) AS BIGINT)) END AS take
        FROM (SELECT pk.o, pk.off, pk.room, hv.g, hv.b, list_position(room, list_max(room))::BIGINT AS w FROM pk JOIN hv ON hv.o = pk.o))),
left_room AS (SELECT room FROM pk ORDER BY o DESC, off DESC LIMIT 1),
cu AS (SELECT i, ceil(list_sum(list_transform(list_slice(room, 1, i), lambda x: greatest(x, 0)))) AS c FROM left_room, (SELECT unnest(range(1, {sharding.SHARDS})) AS i)),
r AS (SELECT row_number() OVER () AS rid, d.*, h.g FROM d LEFT JOIN h USING (k, k2)),
w AS (SELECT *, sum(size) OVER (PARTITION BY g ORDER BY k, k2, doc_id NULLS FIRST, rid ROWS UNBOUNDED PRECEDING) - size AS own FROM r),
st AS (SELECT *, CASE WHEN g IS NULL THEN min(own) OVER (PARTITION BY g, k, k2) ELSE own END AS start FROM w),
p AS (SELECT st.*, CASE WHEN st.g IS NULL THEN (SELECT count(*) FROM cu WHERE c <= start) ELSE pk.s END AS shard FROM st LEFT JOIN pk ON pk.g = st.g AND start >= pk.lo AND start < pk.hi)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY g NULLS FIRST, k, k2, doc_id NULLS FIRST, rid) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

_WORDS4 = r"regexp_extract_all(translate({}, %s), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % _AZ
_OP4 = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS4.format("text")} AS ws FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT DISTINCT item, least(len(ws), 10) AS n,
             array_to_string(list_slice(ws, s, s + least(len(ws), 10) - 1), ' ') AS win
      FROM iw, LATERAL unnest(generate_series(1, greatest(1, len(ws) - 9))) AS t(s) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS4.format("text")}, []) AS ws FROM documents),
dw AS (SELECT rid, s, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS win
       FROM d, (SELECT DISTINCT n FROM w) AS l, LATERAL unnest(generate_series(1, len(ws) - n + 1)) AS t(s)),
h AS (SELECT dw.rid, dw.s, dw.n, w.item FROM dw JOIN w ON dw.win = w.win AND dw.n = w.n),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM h, LATERAL unnest(generate_series(s, s + n - 1)) AS t(p) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""

_SPACE = r"[\x20\x09-\x0D]+"
_stop_list = ", ".join("'" + w + "'" for w in sorted({*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)}))
_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, s, array_to_string(list_slice(ws, s, s + 7), ' ') AS k FROM w, LATERAL unnest(generate_series(1, len(ws) - 7)) AS t(s)),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM twice, LATERAL unnest(generate_series(s, s + 7)) AS t(p) GROUP BY rid),
m AS (SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             len(ls) AS n_lines, len(regexp_extract_all(text, '!')) AS n_marks,
             len(list_filter(ws, lambda x: x IN ({_stop_list}))) AS n_stops
      FROM w LEFT JOIN rep ON rep.rid = w.rid),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 3 AND 12 AND n_symbols / n_words <= 0.1::DOUBLE
       AND n_marks / n_words <= 0.3::DOUBLE AND n_stops / n_words >= 0.01::DOUBLE
       AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.5::DOUBLE AND n_lines / n_words <= 0.5::DOUBLE AS kept
FROM f
"""


_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, s - 1 AS n, ls[s] AS line FROM d, LATERAL unnest(generate_series(1, len(ls))) AS t(s)),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
f AS (SELECT line, min((doc_id, n)) AS pos, list_filter(regexp_split_to_array(line, '{_SPACE}'), lambda x: x <> '') AS ws FROM w GROUP BY line),
v AS (SELECT line, pos, ws, len(ws) AS m FROM f WHERE len(ws) >= {line_dedup.MIN_WORDS}),
x AS (SELECT line, pos, m, i, array_to_string(list_slice(ws, 1, i - 1) || list_slice(ws, i + 1, m), ' ') AS k
      FROM v, LATERAL unnest(generate_series(1, m)) AS t(i)),
sub AS (SELECT line FROM (SELECT line, pos, min(pos) OVER (PARTITION BY m, i, k) AS p FROM x) WHERE p < pos),
whole AS (SELECT line, pos, m, array_to_string(ws, ' ') AS k FROM v),
gone AS (SELECT line FROM sub UNION
         SELECT a.line FROM whole a JOIN x b ON b.m = a.m + 1 AND b.k = a.k AND b.pos < a.pos UNION
         SELECT b.line FROM whole a JOIN x b ON b.m = a.m + 1 AND b.k = a.k AND a.pos < b.pos),
stay AS (SELECT w.rid, w.n, w.line FROM w JOIN f ON f.line = w.line AND f.pos = (w.doc_id, w.n) WHERE w.line NOT IN (SELECT line FROM gone)
         UNION ALL SELECT rid, n, line FROM l WHERE NOT regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
t AS (SELECT rid, string_agg(line, chr(10) ORDER BY n) AS left_text FROM stay GROUP BY rid)
SELECT doc_id, length(r) AS left_chars, sha256(r) AS left_sha256
FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left_text, '') END AS r FROM d LEFT JOIN t USING (rid))
"""

_ESC = r"replace(replace(replace({}, '\', '\b'), '#', '\h'), '<', '\l')".replace("\\\\", "\\")
_OP5 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(4 + length(replace({_ESC.format("role")}, chr(10), 'nn')) + 1 + length({_ESC.format("text")}) + 8) AS formatted_chars
      FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

# Pairs by shared shingles with exact counts, then the components by walking to the smallest id.
_OP6 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM d, LATERAL unnest(generate_series(1, greatest(1, len(ws) - 4))) AS t(i) WHERE len(ws) > 0),
k AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
e AS (SELECT a.rid AS x, b.rid AS y FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid JOIN k p ON p.rid = a.rid JOIN k q ON q.rid = b.rid
      GROUP BY a.rid, b.rid, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT r.x, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY r.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON c.x = d.rid LEFT JOIN k USING (rid)
"""

_OP8 = r"""
WITH r AS (
  SELECT page_id, url, CAST(floor(page_id / 256) AS BIGINT) AS file,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
         || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
c AS (SELECT page_id, url, file, CASE page_id % 50 WHEN 7 THEN 'X' || substr(record, 2) WHEN 9 THEN record || 'zzz' ELSE record END AS record FROM r WHERE page_id % 50 <> 8
      UNION ALL SELECT -1 - page_id, url, file, 'extra ' || record FROM r WHERE page_id % 50 = 11),
m AS (SELECT page_id, file, row_number() OVER o - 1 AS ord, CAST(sum(strlen(record)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
             strlen(record) AS n, sha256(record) AS digest FROM r WINDOW o AS (PARTITION BY file ORDER BY page_id, url)),
cm AS (SELECT page_id, file, row_number() OVER o - 1 AS ord, CAST(sum(strlen(record)) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop,
              strlen(record) AS n, sha256(record) AS digest FROM c WINDOW o AS (PARTITION BY file ORDER BY page_id, url))
SELECT page_id, file, ord, stop - n AS start, stop, digest,
       CASE page_id % 50 WHEN 7 THEN 'corrupt' WHEN 9 THEN 'corrupt' WHEN 8 THEN 'missing' ELSE 'ok' END AS status FROM m
UNION ALL SELECT page_id, file, ord, stop - n, stop, digest, 'extra' FROM cm WHERE page_id < 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op2_line_dedup": _OP2, "op3_sharding": _OP3, "op5_chat_format": _OP5, "op6_minhash": _OP6, "op8_warc_fixity": _OP8, "op4_decontaminate": _OP4, "op7_quality_rules": _OP7}
