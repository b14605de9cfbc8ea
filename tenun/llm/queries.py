"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenun.llm.chat import format_conversations, read_back
from tenun.llm.conversation_repair import damage_conversations, repair_conversations
from tenun.llm.decontaminate import contaminated
from tenun.llm.filter_audit import audit_filters
from tenun.llm.imatch import learn_lexicon, likeness
from tenun.llm.language import identify_languages, learn_profiles
from tenun.llm.license_rules import AFTER, BEFORE, all_rules
from tenun.llm.license_scan import LOWER_WORD, SURENESS, scan_licenses, whole_words
from tenun.llm.line_chunks import drop_repeated_chunks
from tenun.llm.minhash import near_duplicates
from tenun.llm.ordering import map_with_next
from tenun.llm.packing import pack_documents
from tenun.llm.toxicity import score_toxicity, train_toxicity
from tenun.llm.url_filter import judge_urls
from tenun.llm.warc import page_records, read_warc, spread_archives, write_warc
from tenun.llm.words import word_hashes
from tenun.session import keep_batches_small
from tenun.sources.shared import Workspace

BLOCKED = [("com", "/en/"), ("example.net", "/de/8"), ("org", "/es/")]
ALLOWED = [("example.com", "/en/7"), ("net", "/de/")]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    keep_batches_small(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id's digits modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, learn_profiles(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), Workspace(spark, "warc"))
    return page_records(read_warc(spread_archives(manifest)), strict=True)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn_lexicon(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def compare(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:])]
        (words,), offsets = word_hashes([*texts, *edited])
        prints = [lexicon.fingerprint(words[offsets[i] : offsets[i + 1]], t) for i, t in enumerate([*texts, *edited])]
        rows = []
        for i, doc_id in enumerate(ids):
            own, other = prints[i], prints[len(texts) + i]
            sha = hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest()
            rows.append((doc_id, len(texts[i]), sha, "-".join(own), "-".join(other), likeness(own, other), likeness(own, prints[i + 1])))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return map_with_next(docs, compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), BLOCKED, ALLOWED)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra), tokenizer_file()))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage_conversations(table(spark, sf_dir, "conversations")), present="present")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM documents),
solid AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i
  FROM lines WHERE length(trim(line, ' ')) > 0),
rolled AS (
  SELECT *, coalesce((((lag(h) OVER w * 31 + h) % 4294967296) // 31) % 4 = 0, false) AS may_end, lag(line) OVER w AS before
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cut AS (SELECT *, may_end AND NOT coalesce(lag(may_end) OVER (PARTITION BY doc_id ORDER BY i), false) AS boundary FROM rolled),
placed AS (SELECT *, coalesce(sum(CAST(boundary AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM cut),
chunks AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY i) AS t FROM placed GROUP BY doc_id, chunk HAVING count(*) > 1),
chunk_hits AS (SELECT doc_id, chunk FROM chunks QUALIFY doc_id > min(doc_id) OVER (PARTITION BY t)),
pair_hits AS (
  SELECT doc_id, i, before, line FROM placed WHERE before IS NOT NULL QUALIFY doc_id > min(doc_id) OVER (PARTITION BY before, line)),
runs AS (
  SELECT doc_id, i, lag(i) OVER w = i - 1 OR lead(i) OVER w = i + 1 OR len(regexp_extract_all(before || ' ' || line, '[^ \t\n]+')) > 50 AS counts
  FROM pair_hits WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
line_hits AS (
  SELECT doc_id, i FROM solid WHERE length(line) > 100 AND len(regexp_extract_all(line, '[^ \t\n]+')) > 50 QUALIFY doc_id > min(doc_id) OVER (PARTITION BY line)),
hits AS (
  SELECT doc_id, i FROM placed JOIN chunk_hits USING (doc_id, chunk)
  UNION SELECT doc_id, i FROM runs WHERE counts UNION SELECT doc_id, i - 1 FROM runs WHERE counts UNION SELECT doc_id, i FROM line_hits),
gone AS (SELECT doc_id, p FROM hits JOIN solid USING (doc_id, i)),
rest AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.p IS NULL THEN l.line END, chr(10) ORDER BY l.p) AS text, CAST(count(g.p) AS INTEGER) AS removed_lines
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text, coalesce(r.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN rest r ON r.doc_id = d.doc_id
"""

OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages),
s AS (SELECT page_id, newest, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
bits AS (
  SELECT s.*, k, (instr('0123456789abcdef', substr(hex, 1 + k * 5 // 4, 1)) - 1) * 16 + coalesce(nullif(instr('0123456789abcdef', substr(hex, 2 + k * 5 // 4, 1)), 0) - 1, 0) AS two
  FROM s, range(32) AS r(k))
SELECT page_id, payload_bytes,
  string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((two >> (3 - (k * 5) % 4)) & 31) AS INTEGER), 1), '' ORDER BY k) AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM bits GROUP BY page_id, payload_bytes, newest, hex
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM b, unnest(range(1, len(w) - 3)) AS r(i)),
sizes AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM ds JOIN bs USING (s) JOIN sizes ON sizes.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id HAVING count(*) >= 0.8 * any_value(n)
"""

OP9_SQL = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT p.page_id, h || q AS rule, v, row_number() OVER (PARTITION BY p.page_id ORDER BY length(h || q) DESC, length(h) DESC) AS place
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN fits ON fits.page_id = p.page_id AND place = 1
"""

OP11_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(
    list_concat([4294967295], flatten(list_transform(range(1, length(k) + 1), lambda p: list_concat([CAST(ascii(substr(k, CAST(p AS INTEGER), 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, substr(role, 1, 1) AS initial, regexp_replace(text, '[ 	-
]+$', '') AS solid
  FROM damaged JOIN convs ON damaged.conv_id IS NOT DISTINCT FROM convs.conv_id),
judged AS (
  SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair,
    CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
facts AS (SELECT *, fault IN ('blank', 'duplicate') AS forced, CAST(fault = 'truncated' AS INTEGER) AS more FROM judged),
-- v: least cost from a row on, for the states nothing yet, after system, after user, after assistant
back(c, i, v) AS (
  SELECT c, (SELECT coalesce(max(i), 0) FROM facts WHERE facts.c = convs.c) + 1, [0, 4, 2, 0] FROM convs
  UNION ALL
  SELECT c, i, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])]
  FROM (
    SELECT back.c, f.i, [
      least(3 + v[1], CASE WHEN NOT forced AND initial = 's' THEN more + v[2] WHEN NOT forced AND initial = 'u' THEN more + v[3] ELSE 999999 END, CASE WHEN NOT forced THEN 2 + more + v[3] ELSE 999999 END),
      least(3 + v[2], CASE WHEN NOT forced AND initial = 'u' THEN more + v[3] ELSE 999999 END, CASE WHEN NOT forced THEN 2 + more + v[3] ELSE 999999 END),
      least(3 + v[3], CASE WHEN NOT forced AND initial = 'a' THEN more + v[4] ELSE 999999 END, CASE WHEN NOT forced THEN 2 + more + v[4] ELSE 999999 END),
      least(3 + v[4], CASE WHEN NOT forced AND initial = 'u' THEN more + v[3] ELSE 999999 END, CASE WHEN NOT forced THEN 2 + more + v[3] ELSE 999999 END)] AS b
    FROM back JOIN facts f ON f.c = back.c AND f.i = back.i - 1)),
walk(c, i, q, audit, said) AS (
  SELECT c, 1, 1, '', CAST([] AS VARCHAR[]) FROM convs
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE other END, audit || edit,
    CASE edit WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE other WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, role, text, kept, other, CASE WHEN n.v IS NOT NULL AND h.v[q] = 3 + n.v[q] THEN 'D' WHEN h.v[q] = 2 + h.v[other] THEN 'I' WHEN NOT forced AND h.v[q] = more + n.v[kept] THEN 'K' WHEN NOT forced THEN 'R' END AS edit
    FROM (
      SELECT walk.*, role, text, forced, more, CASE q WHEN 3 THEN 4 ELSE 3 END AS other, CASE WHEN q = 1 AND initial = 's' THEN 2 WHEN q <> 3 AND initial = 'u' THEN 3 WHEN q = 3 AND initial = 'a' THEN 4 END AS kept
      FROM walk LEFT JOIN facts f ON f.c = walk.c AND f.i = walk.i) w
    JOIN back h ON h.c = w.c AND h.i = w.i LEFT JOIN back n ON n.c = w.c AND n.i = w.i + 1)
  WHERE edit IS NOT NULL),
counts AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM facts GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(v[1] AS BIGINT) AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM convs JOIN back ON back.c = convs.c AND back.i = 1
JOIN (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY c ORDER BY length(audit) DESC) = 1) w ON w.c = convs.c LEFT JOIN counts ON counts.c = convs.c
"""

OP12_RULES = ", ".join(f"({k}, '{r.label}', {r.priority}, {SURENESS[r.priority]}, '{r.keyword}', '{whole_words(r.pattern)}', {r.base})" for k, r in enumerate(all_rules()))
OP12_SQL = f"""
WITH rules(rule, label, priority, sure, keyword, pattern, base) AS (VALUES {OP12_RULES}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LOWER_WORD}') AS w FROM documents),
words AS (SELECT r, w, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM docs),
tried AS (
  SELECT r, i, rules.*, regexp_extract(
    CASE WHEN i > 0 THEN array_to_string(w[greatest(i - {BEFORE}, 0) + 1:i], ' ') || ' ' ELSE '' END || '@' || array_to_string(w[i + 1:i + {AFTER}], ' ') || ' ', pattern, 1) AS t
  FROM words JOIN rules ON word = keyword),
spans AS (
  SELECT *, i - (length(split_part(t, '@', 1)) - length(replace(split_part(t, '@', 1), ' ', ''))) AS s, s + length(t) - length(replace(t, ' ', '')) AS f FROM tried WHERE t <> ''),
judged AS (
  SELECT *, NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.r = spans.r AND o.s <= spans.s AND o.f >= spans.f AND o.priority >= spans.priority
      AND (o.f - o.s > spans.f - spans.s OR o.priority > spans.priority OR o.rule < spans.rule)) AS kept
  FROM spans)
SELECT doc_id, len(w) AS n_words, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR kept), '') AS labels,
  CAST(coalesce(max(sure) FILTER (kept), 0) AS DOUBLE) AS score
FROM docs LEFT JOIN judged USING (r) GROUP BY r, doc_id, w
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flags AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
         'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS fails
  FROM docs LEFT JOIN flags USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS f, string_split(filter_order, '')[:CAST(step AS INTEGER) - 1] AS before FROM orders, range(1, 6) AS r(step)),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT fails[f] AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails[f] AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails[f] AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[f] AND len(list_filter(map_values(fails), lambda v: v)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails[f] AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails[f] AND NOT gone), 0) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda x: fails[x])) > 0 AS gone FROM steps, masks) GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_filter_audit": OP13_SQL, "op4_line_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op6_decontamination": OP6_SQL, "op9_url_filter": OP9_SQL}
