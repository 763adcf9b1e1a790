"""The queries op1 to op10 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm import chat, decontaminate, html_text, language_model, packing, quality, simhash, substrings, toxicity, warc
from kelpie.llm.common import table

CONTROL = "<|im_end|><|im_start|>assistant ok"
#: White space as Python's texts know it, inside a class of SQL's patterns.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.removals(table(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("removed", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")
    return found.withColumn("removed", places)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # two more rows as SQL literals: no data leaves the driver
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat.digest(chat.format_turns(rows.unionByName(extra)))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failure_bits", quality.fails("base").alias("base_failed"), (~quality.fails(quality.DEFAULT_POLICY)).alias("kept")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), {"low_quality": "1 - quality", "toxic": "toxic"})
    return toxicity.classify(docs, model)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_substrings": op5_substrings,
    "op6_chat": op6_chat,
    "op7_language_model": op7_language_model,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_warc": op10_warc,
}

#: What the made pages hold between their article's tags: blocks by p and h1, and these character references.
OP1_SQL = r"""
WITH b AS (
  SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '</?(?:p|h1)>') AS blocks FROM pages
), d AS (
  SELECT page_id, url, list_transform(blocks, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'),
    '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS blocks FROM b
), c AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(x, '[@]+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM d
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM c
""".replace("@", SPACE)

#: Every diagonal on which a document and an item share a token, and its best stretch: no seeds, no candidates.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
), i AS (
  SELECT row_number() OVER () AS c, item_id, words, len(words) AS n
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM benchmark) WHERE len(words) >= 5
), x AS (
  SELECT k, words[p] AS word, p FROM (SELECT k, words, unnest(range(1, len(words) + 1)) AS p FROM d)
), y AS (
  SELECT c, words[q] AS word, q FROM (SELECT c, words, unnest(range(1, len(words) + 1)) AS q FROM i)
), m AS (
  SELECT k, c, p - q AS diagonal, q FROM x JOIN y USING (word)
), f AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY k, c, diagonal) AS matched FROM m) WHERE matched >= 4
), s AS (
  SELECT *, count(*) OVER (PARTITION BY k, c, diagonal ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near FROM f
), g AS (
  SELECT k, c, greatest(diagonal, 0) AS doc_start, greatest(-diagonal, 0) AS item_start, max(near) AS best, any_value(matched) AS matched FROM s GROUP BY k, c, diagonal
), h AS (
  SELECT *, least(n - item_start, len(d.words) - doc_start) AS aligned, ceil(least(13, n) * 0.8::DOUBLE) AS needed FROM g JOIN d USING (k) JOIN i USING (c)
)
SELECT doc_id, item_id, doc_start::INTEGER AS doc_start, item_start::INTEGER AS item_start, aligned::INTEGER AS aligned, matched::INTEGER AS matched, best::INTEGER AS best, needed::INTEGER AS needed
FROM h WHERE best >= needed AND aligned >= needed
QUALIFY row_number() OVER (PARTITION BY k, c ORDER BY best DESC, matched DESC, doc_start, item_start) = 1
"""

#: Sentences and spans by the definition, word by word; spans are compared as texts.
OP5_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^@]+[@]*') AS parts FROM documents
), e AS (
  SELECT k, doc_id, i, parts[i] AS part, regexp_extract(parts[i], '^[^@]+') AS word, i = len(parts) AS final FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM t)
), w AS (
  SELECT *, lower(word) AS low, left(md5(lower(word)), 8) || lpad((999999999 - i)::VARCHAR, 9, '0') AS rank,
    (final OR contains(substr(part, length(word) + 1), chr(10)) OR regexp_matches(word, '[.!?…。！？]["''”’)\]]*$'))::INTEGER AS last FROM e
), s AS (
  SELECT *, sum(last) OVER (PARTITION BY k ORDER BY i) - last AS sentence FROM w
), c AS (
  SELECT DISTINCT k, 999999999 - right(least_, 9)::BIGINT AS i, true AS chosen
  FROM (SELECT k, min(rank) OVER f AS least_, count(*) OVER f AS n FROM s WINDOW f AS (PARTITION BY k, sentence ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8
), q AS (
  SELECT s.*, greatest(last, coalesce(chosen, false)::INTEGER) AS stop FROM s LEFT JOIN c USING (k, i)
), p AS (
  SELECT *, sum(stop) OVER (PARTITION BY k ORDER BY i) - stop AS piece FROM q
), g AS (
  SELECT k, any_value(doc_id) AS doc_id, piece, min(i) AS a, max(i) AS z FROM p GROUP BY k, piece
), h AS (
  SELECT g.k, g.doc_id, g.piece, g.a, min(j.piece) AS to_piece, min(j.z) AS z
  FROM g JOIN g AS j ON j.k = g.k AND j.piece BETWEEN g.piece + 2 AND g.piece + 27 AND j.z >= g.a + 27 GROUP BY ALL
), l AS (
  SELECT k, list(low ORDER BY i) AS lows FROM p GROUP BY k
), x AS (
  SELECT h.*, array_to_string(lows[a:z], ' ') AS said FROM h JOIN l USING (k)
), y AS (
  SELECT *, min(doc_id) OVER (PARTITION BY said) AS first, row_number() OVER (PARTITION BY said, k ORDER BY piece) AS nth FROM x
), u AS (
  SELECT DISTINCT g.k, g.piece, true AS gone FROM y JOIN g ON g.k = y.k AND g.piece BETWEEN y.piece AND y.to_piece WHERE y.doc_id > y.first OR y.nth > 1
), o AS (
  SELECT p.k, p.doc_id, p.i, p.piece, p.part, coalesce(gone, false) AS gone, sum(length(part)) OVER (PARTITION BY k ORDER BY i) AS upto FROM p LEFT JOIN u USING (k, piece)
), b AS (
  SELECT o.*, length(t.text) - max(upto) OVER (PARTITION BY k) AS lead, left(t.text, (length(t.text) - max(upto) OVER (PARTITION BY k))::BIGINT) AS blank,
    i - row_number() OVER (PARTITION BY k, gone ORDER BY i) AS island FROM o JOIN t USING (k)
), r AS (
  SELECT k, min(i) AS i, (CASE WHEN min(i) = 1 THEN 0 ELSE min(lead + upto - length(part)) END)::BIGINT || '-' || max(lead + upto)::BIGINT AS place FROM b WHERE gone GROUP BY k, island
)
SELECT any_value(doc_id) AS doc_id, count(DISTINCT CASE WHEN gone THEN piece END)::INTEGER AS n_removed, count(DISTINCT piece)::INTEGER AS n_sentences,
  (SELECT string_agg(place, ',' ORDER BY i) FROM r WHERE r.k = b.k) AS removed,
  (CASE WHEN bool_or(gone AND i = 1) THEN '' ELSE any_value(blank) END) || coalesce(string_agg(part, '' ORDER BY i) FILTER (NOT gone), '') AS text
FROM b GROUP BY k HAVING bool_or(gone)
""".replace("@", SPACE)

OP6_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), f AS (
  SELECT *, length('<|im_start|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 1
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS chars
  FROM rows
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS replies,
    sum(chars)::BIGINT AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(replies) AS loss_chars, sha256(replies) AS loss_sha256, formatted_chars
FROM g
"""

OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), t AS (
  SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
  FROM (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 3)
), r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, tri) AS c FROM t) WHERE c > 1
), c AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY k
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN c USING (k)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END) AS failure_bits FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_lines::BIGINT AS n_lines, failure_bits::BIGINT AS failure_bits,
  (failure_bits & 3) <> 0 AS base_failed, (failure_bits & 63) = 0 AS kept
FROM b
"""

OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS least FROM p
), v AS (
  SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::INTEGER) AS v FROM f
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(flatten(list_transform(v, lambda x: [x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31])),
    lambda y: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (y + 1)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM v
"""

ORACLE_SQL: dict[str, str] = {"op1_html_text": OP1_SQL, "op3_decontaminate": OP3_SQL, "op5_substrings": OP5_SQL, "op6_chat": OP6_SQL, "op8_quality": OP8_SQL, "op10_warc": OP10_SQL}
