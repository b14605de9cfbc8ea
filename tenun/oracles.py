"""DuckDB SQL that gives the same rows as the queries of the same name."""

W = r"[\p{L}\p{N}_]"
UNI_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _prepared(text: str) -> str:
    """Links, mentions and white space; entities and compatibility forms don't occur in the tables."""
    links = rf"regexp_replace({text}, '(?i)(https?://|www\.)[^\s]*[^\s.,!?;:)\]}}""''”’]', ' ', 'g')"
    mentions = rf"regexp_replace({links}, '(^|[^\p{{L}}\p{{N}}_])@[\p{{L}}\p{{N}}_]+', '\1 ', 'g')"
    return rf"trim(regexp_replace({mentions}, '\s+', ' ', 'g'))"


def _cleaned(text: str) -> str:
    tagless = rf"regexp_replace({_prepared(text)}, '(^|[^\p{{L}}\p{{N}}_])#([\p{{L}}\p{{N}}_]+)', '\1\2', 'g')"
    return f"replace(lower({tagless}), 'ß', 'ss')"


def _key(text: str) -> str:
    return rf"trim(regexp_replace({_cleaned(text)}, '^rt\s+', ''))"


def _fingerprint(text: str) -> str:
    return f"sha256({_key(text)})"


def _keyword(words: tuple[str, ...]) -> str:
    cases = " ".join(rf"WHEN regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_]){w}([^\p{{L}}\p{{N}}_]|$)') THEN '{w}'" for w in words)
    return f"SELECT doc_id, CASE {cases} END AS matched_keyword FROM (SELECT doc_id, {_cleaned('text')} AS t FROM documents)"


LABELLED = """labelled AS (
  SELECT doc_id, source, lang, text, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment_label
  FROM documents JOIN labels USING (doc_id))"""

REVIEWABLE = LABELLED + """, reviewable AS (
  SELECT source AS target_program, CAST(doc_id AS VARCHAR) AS tweet_id, doc_id, text AS model_text, sentiment_label, doc_id % 3 = 0 AS fit FROM labelled)"""

HALVES = """orders2 AS (SELECT o_orderkey AS seq, o_orderpriority AS target_program, CAST(o_custkey AS VARCHAR) AS id_str, o_orderstatus FROM orders),
old AS (SELECT * FROM orders2 WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY target_program, id_str ORDER BY seq) = 1),
fresh AS (SELECT * FROM orders2 WHERE seq % 2 = 1)"""

GROUPED = f"""g AS (
  SELECT doc_id AS row_id, doc_id % 97 = 0 AS guarded, CASE WHEN doc_id % 4 = 0 THEN 'c' || (doc_id // 12) END AS conversation, 'g' || ((doc_id + 5) // 2) AS split_group, {_fingerprint('text')} AS fp FROM documents),
k AS (SELECT row_id, 'c:' || conversation AS k FROM g WHERE conversation IS NOT NULL UNION ALL SELECT row_id, 's:' || split_group FROM g UNION ALL SELECT row_id, 'f:' || fp FROM g),
hub AS (SELECT k, min(row_id) AS h FROM k GROUP BY k),
e AS (SELECT row_id AS a, h AS b FROM k JOIN hub USING (k) WHERE row_id <> h),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, r) AS (SELECT row_id, row_id FROM g UNION SELECT reach.n, ways.b FROM reach JOIN ways ON ways.a = reach.r),
groups AS (SELECT n AS row_id, min(r) AS leakage_group FROM reach GROUP BY n)"""

JUDGED = "judged AS (SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS truth, CASE WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS predicted FROM labels)"

LABEL_REPORT = f"""{JUDGED}, names(label) AS (VALUES ('negative'), ('neutral'), ('positive')),
counts AS (SELECT label, (SELECT count(*) FROM judged WHERE truth = label) AS support, (SELECT count(*) FROM judged WHERE predicted = label) AS taken, (SELECT count(*) FROM judged WHERE truth = label AND predicted = label) AS hit FROM names),
rates AS (SELECT label, support, CASE WHEN taken > 0 THEN hit / CAST(taken AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / CAST(support AS DOUBLE) ELSE 0 END AS recall, CASE WHEN support + taken > 0 THEN 2 * hit / CAST(support + taken AS DOUBLE) ELSE 0 END AS f1 FROM counts)"""


def _tfidf(terms: str, row: str, most: int) -> str:
    return f"""
WITH t AS ({terms}), c AS (SELECT row_id, term, count(*) AS n FROM t GROUP BY row_id, term),
v AS (SELECT term, sum(n) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT {most}),
w AS (SELECT row_id, c.term, (ln(n) + 1) * (ln((1 + (SELECT count(*) FROM {'documents' if row == 'doc_id' else 'pages'})) / CAST(1 + df AS DOUBLE)) + 1) AS raw FROM c JOIN v ON c.term = v.term)
SELECT row_id AS {row}, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY row_id)), 5) AS weight FROM w"""


def oracles(keywords: tuple[str, ...], start: str, end: str) -> dict[str, str]:
    """SQL by query name; ``start`` and ``end`` are the local days of the window."""
    low = f"TIMESTAMP '{start} 00:00:00' - INTERVAL 7 HOUR"
    high = f"TIMESTAMP '{end} 00:00:00' + INTERVAL 17 HOUR"
    local = "(ts + INTERVAL 7 HOUR)"
    problem = """CASE o_orderkey % 12 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' WHEN 2 THEN 'invalid' WHEN 3 THEN 'data changed' WHEN 4 THEN 'configuration outside the run'
      WHEN 6 THEN 'configuration changed' WHEN 8 THEN 'invalid configuration checksum' WHEN 10 THEN 'configuration changed' WHEN 11 THEN 'invalid' END"""
    return {
        "csv_round_trip": "SELECT CAST(conv_id AS VARCHAR) AS id_str, 'NA \"x\", y' || coalesce(chr(10) || text, '') AS full_text, CAST(turn AS VARCHAR) AS turn, role FROM conversations",
        "split_csv": "SELECT CAST(doc_id AS VARCHAR) AS id_str, coalesce('say \"' || text || '\",' || chr(10), '') AS full_text, coalesce(lang, '') AS lang FROM documents",
        "file_checksums": """
SELECT c_nationkey, CAST(octet_length(encode(body)) AS BIGINT) AS length, sha256(body) AS sha256, md5(body) AS md5
FROM (SELECT c_nationkey, string_agg(c_custkey || '|' || c_name || '|' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY 1)""",
        "price_percentiles": "SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])::DOUBLE AS share, round(unnest(quantile_cont(o_totalprice, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])), 4) AS price FROM orders",
        "ordered_decisions": """
WITH RECURSIVE e AS (
  SELECT event_id AS seq, 'u' || user_id || '-' || (event_id % 3) AS id, event_type AS program, CASE WHEN event_id % 50 = 1 THEN '' ELSE 'value ' || CAST(floor(value) AS BIGINT) END AS key,
    user_id % 3 <> 0 AS home, event_id % 5 <> 0 AS relevant FROM events),
h AS (SELECT *, seq % 8 = 0 AS eligible FROM e WHERE seq % 4 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) > 1 AS repeated, (program, id) IN (SELECT (program, id) FROM h WHERE eligible) AS across FROM e WHERE seq % 4 <> 0),
past AS (SELECT program, key, arg_max(id, seq) AS id FROM h WHERE eligible AND key <> '' GROUP BY ALL),
able AS (SELECT program, key, min(seq) AS seq, arg_min(id, seq) AS id FROM p WHERE NOT repeated AND NOT across AND home AND relevant AND key <> '' GROUP BY ALL),
accepted AS (SELECT able.* FROM able LEFT JOIN past USING (program, key) WHERE past.id IS NULL),
refs AS (SELECT seq, false AS post, id, key FROM h UNION ALL SELECT seq, true, id, key FROM p WHERE key <> ''),
hub AS (SELECT id, coalesce(max((post, seq)) FILTER (NOT post), min((post, seq))) AS up FROM refs GROUP BY id),
firsts AS (SELECT key, min((post, seq)) AS up FROM refs WHERE key <> '' GROUP BY key),
ways AS (
  SELECT p.seq, CASE WHEN hub.up < (true, p.seq) THEN hub.up WHEN p.key <> '' AND firsts.up < (true, p.seq) THEN firsts.up END AS up, 'text:' || sha256(p.key) AS own
  FROM p LEFT JOIN hub USING (id) LEFT JOIN firsts USING (key)),
chase(seq, up) AS (
  SELECT seq, up FROM ways WHERE up IS NOT NULL
  UNION ALL SELECT chase.seq, ways.up FROM chase JOIN ways ON chase.up = (true, ways.seq) WHERE ways.up IS NOT NULL),
ends AS (SELECT seq, min(up) AS up FROM chase GROUP BY seq),
judged AS (
  SELECT p.seq, repeated OR across AS duplicate, across, p.key <> '' AND (past.id IS NOT NULL OR coalesce(a.seq < p.seq, false)) AS same_text, coalesce(CASE WHEN a.seq < p.seq THEN a.id END, past.id) AS similar_to,
    CASE WHEN ends.seq IS NULL THEN ways.own WHEN ends.up[1] THEN root.own ELSE 'h' || ends.up[2] END AS group_id, p.key = '' AS empty, home, relevant
  FROM p LEFT JOIN past ON past.program = p.program AND past.key = p.key LEFT JOIN accepted a ON a.program = p.program AND a.key = p.key
  JOIN ways ON ways.seq = p.seq LEFT JOIN ends ON ends.seq = p.seq LEFT JOIN ways root ON (true, root.seq) = ends.up)
SELECT seq, duplicate, across, same_text, false AS near, similar_to, group_id,
  CASE WHEN duplicate THEN 'duplicate' WHEN empty THEN 'empty_cleaned_text' WHEN same_text THEN 'duplicate_text' WHEN NOT home AND NOT relevant THEN 'review_language_and_relevance'
    WHEN NOT home THEN 'review_language' WHEN NOT relevant THEN 'review_relevance' ELSE 'accepted' END AS status
FROM judged""",
        "labeled_csv": f"WITH {REVIEWABLE} SELECT target_program, tweet_id, model_text, sentiment_label FROM reviewable",
        "published_runs": "SELECT lower(o_orderstatus) AS program, count(*) AS processed_rows, 'input ' || lower(o_orderstatus) AS input_sha256, true AS intact FROM orders GROUP BY o_orderstatus",
        "experiment_slices": """
SELECT 'run' || k AS run, 'slice' AS kind, o_orderpriority || '.' || c AS key, round(CASE c WHEN 'rows' THEN n ELSE price END, 4) AS number
FROM (SELECT o_orderkey % 3 AS k, o_orderpriority, count(*)::DOUBLE AS n, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2), (VALUES ('rows'), ('price')) AS v(c)""",
        "short_report": """
WITH p AS (
  SELECT event_id AS seq, 'value ' || CAST(floor(value) AS BIGINT) || CASE WHEN event_id % 5 <> 0 THEN ' of the day' ELSE '' END AS key, user_id % 3 <> 0 AS home, event_id % 5 <> 0 AS relevant,
    row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) > 1 AS repeated, strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(event_id // 2), '%Y-%m-%dT%H:%M:%SZ') AS moment FROM events),
accepted AS (SELECT key, min(seq) AS first FROM p WHERE NOT repeated AND home AND relevant GROUP BY key),
j AS (SELECT p.*, coalesce(first < seq, false) AS same FROM p LEFT JOIN accepted USING (key)),
s AS (
  SELECT *, CASE WHEN repeated THEN 'duplicate' WHEN same THEN 'duplicate_text' WHEN NOT home AND NOT relevant THEN 'review_language_and_relevance' WHEN NOT home THEN 'review_language'
    WHEN NOT relevant THEN 'review_relevance' ELSE 'accepted' END AS status FROM j)
SELECT 'processed_rows' AS metric, '' AS key, count(*) AS value FROM s UNION ALL SELECT 'duplicate_tweet_ids', '', count(*) FILTER (repeated) FROM s UNION ALL SELECT 'duplicate_tweet_ids_across_runs', '', 0
UNION ALL SELECT 'empty_cleaned_text_rows', '', 0 UNION ALL SELECT 'duplicate_text_rows', '', count(*) FILTER (same) FROM s UNION ALL SELECT 'near_duplicate_rows', '', 0
UNION ALL SELECT 'language_review_rows', '', count(*) FILTER (NOT home) FROM s UNION ALL SELECT 'eligible_for_labeling', '', count(*) FILTER (status = 'accepted') FROM s
UNION ALL SELECT 'quality_status', status, count(*) FROM s GROUP BY status UNION ALL SELECT 'language', CASE WHEN home THEN 'in' ELSE 'de' END, count(*) FROM s GROUP BY home
UNION ALL SELECT 'published_at_min', moment, count(*) FROM s WHERE moment = (SELECT min(moment) FROM s) GROUP BY moment UNION ALL SELECT 'published_at_max', moment, count(*) FROM s WHERE moment = (SELECT max(moment) FROM s) GROUP BY moment""",
        "data_identity": """
WITH r AS (
  SELECT o_orderstatus, sha256(concat_ws('|', length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey, CASE WHEN o_orderkey % 9 <> 0 THEN length(o_orderpriority) || ':' || o_orderpriority ELSE 'null' END)) AS h FROM orders),
q AS (SELECT o_orderstatus, [CAST('0x' || substr(h, 1, 16) AS UBIGINT), CAST('0x' || substr(h, 17, 16) AS UBIGINT), CAST('0x' || substr(h, 33, 16) AS UBIGINT), CAST('0x' || substr(h, 49, 16) AS UBIGINT)] AS l FROM r)
SELECT o_orderstatus, count(*) AS n_rows, sha256(concat_ws('|', count(*), sum(l[1]::HUGEINT), sum(l[2]::HUGEINT), sum(l[3]::HUGEINT), sum(l[4]::HUGEINT))) AS digest FROM q GROUP BY o_orderstatus""",
        "run_paths": """
SELECT o_orderkey, 'p' || (o_custkey % 4) AS program, strftime(run_day, '%Y%m%d') || 'T101112+0700' AS run_id, CAST(o_orderdate AS DATE) AS collected_date, strftime(run_day, '%Y-%m-%dT03:11:12Z') AS collected_at, o_orderkey % 10 <> 0 AS path_agrees
FROM (SELECT *, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS run_day FROM orders)""",
        "collection_summary": f"""
SELECT count(*) AS n_rows, strftime({low}, '%Y-%m-%dT%H:%M:%SZ') AS start_inclusive_utc, strftime({high}, '%Y-%m-%dT%H:%M:%SZ') AS end_exclusive_utc, min(shown) AS published_at_min, max(shown) AS published_at_max
FROM (SELECT CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS shown FROM events WHERE ts >= {low} AND ts < {high})""",
        "manifest_check": f"SELECT * FROM (SELECT 'r' || o_orderkey AS run, {problem} AS problem FROM orders) WHERE problem IS NOT NULL",
        "quarantine_audit": f"""
SELECT * FROM (
  SELECT 'r' || o_orderkey AS run_path, concat_ws(';', CASE WHEN o_orderkey % 5 = 0 THEN 'outdated_schema' END, CASE WHEN o_orderkey % 7 = 0 THEN 'raw_input_missing' WHEN {problem} IS NOT NULL THEN 'manifest_invalid' END) AS reasons FROM orders)
WHERE reasons <> ''""",
        "preprocess_flags": f"""
WITH k AS ({_keyword(keywords)}),
p AS (SELECT *, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(doc_id) AS moment FROM documents WHERE length(trim(regexp_replace(text, '\\s', '', 'g'))) > 0)
SELECT CAST(doc_id AS VARCHAR) AS tweet_id, nullif(trim(source), '') AS conversation_id, CASE WHEN lang = 'en' THEN 'id' ELSE lang END AS language_normalized, lang <> 'en' AS language_needs_review,
  strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS published_at, strftime(moment + INTERVAL 7 HOUR, '%G-W%V') AS year_week, strftime(moment + INTERVAL 7 HOUR, '%Y-%m') AS year_month,
  matched_keyword, matched_keyword IS NOT NULL AS is_relevant, false AS is_duplicate, {_cleaned('text')} = '' AS is_empty_cleaned_text, {_fingerprint('text')} AS text_fingerprint, CAST(0 AS BIGINT) AS like_count, '3' AS schema_version
FROM p JOIN k USING (doc_id)""",
        "training_violations": f"""
WITH {REVIEWABLE}
SELECT rule, n AS n_rows, (SELECT count(*) FROM reviewable) AS total FROM (
  SELECT 'label is unknown' AS rule, (SELECT count(*) FROM reviewable WHERE doc_id % 10 = 0) AS n UNION ALL SELECT 'text is blank', (SELECT count(*) FROM reviewable WHERE trim(coalesce(model_text, '')) = '')
  UNION ALL SELECT 'an identity field is empty', 0 UNION ALL SELECT 'preprocessing flags are unresolved', (SELECT count(*) FROM reviewable WHERE NOT fit)
  UNION ALL SELECT 'the target is not relevant', 0 UNION ALL SELECT 'the label is not approved', 0)""",
        "training_counts": f"WITH {LABELLED} SELECT kind, value, count(*) AS n_rows FROM (SELECT 'sentiment_label' AS kind, sentiment_label AS value FROM labelled UNION ALL SELECT 'source', coalesce(source, '') FROM labelled UNION ALL SELECT 'lang', coalesce(lang, '') FROM labelled) GROUP BY 1, 2",
        "labels_in_order": f"WITH {LABELLED} SELECT source AS target_program, CAST(doc_id AS VARCHAR) AS tweet_id, -doc_id AS position, sentiment_label FROM labelled WHERE doc_id % 3 = 0",
        "stacked_batches": "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS nation, 0 AS batch, '' AS region FROM nation UNION ALL SELECT r_name, '', 1, CAST(r_regionkey AS VARCHAR) FROM region",
        "split_sanity": """
SELECT * FROM (
  SELECT o_orderkey, CASE WHEN a = 0 AND d + t > 0 THEN 'unknown' WHEN a > 0 AND d > 0 AND t > 0 THEN 'in both' WHEN a > 0 AND d + t = 0 THEN 'in neither' END AS problem
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN 1 ELSE 0 END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS d, CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS t FROM orders))
WHERE problem IS NOT NULL""",
        "lineage_equality": """
SELECT CAST(c_custkey AS VARCHAR) AS key, stated, '5-LOW' AS found FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS stated FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE stated IS DISTINCT FROM '5-LOW'""",
        "split_counts": f"WITH {LABELLED} SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'development' END AS split, sentiment_label, count(*) AS n_rows FROM labelled GROUP BY 1, 2",
        "program_slices": f"""
WITH {LABELLED}, j AS (SELECT source, sentiment_label AS t, CASE WHEN length(text) % 2 = 0 THEN 'neutral' ELSE 'positive' END AS p FROM labelled),
c AS (SELECT source, label, count(*) FILTER (t = label AND p = label) AS hit, count(*) FILTER (t = label) AS support, count(*) FILTER (p = label) AS taken FROM j, (VALUES ('negative'), ('neutral'), ('positive')) AS l(label) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN support + taken > 0 THEN 2 * hit / CAST(support + taken AS DOUBLE) ELSE 0 END AS f1 FROM c)
SELECT f.source, n_rows, accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(max(CASE WHEN label = 'positive' AND support > 0 THEN hit / CAST(support AS DOUBLE) ELSE 0 END), 6) AS recall_positive
FROM f JOIN (SELECT source, count(*) AS n_rows, round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j GROUP BY 1) USING (source) GROUP BY 1, 2, 3""",
        "top_ranked": "WITH t AS (SELECT event_type, user_id, round(sum(value), 3) AS total, max(event_id) AS last FROM events GROUP BY 1, 2) SELECT event_type, user_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, last DESC) AS place FROM t) WHERE place <= 5",
        "split_invariants": f"WITH {LABELLED} SELECT 'torn groups' AS what, 0 AS n UNION ALL SELECT 'places without a label', 0 UNION ALL SELECT 'misplaced rows', 0 UNION ALL SELECT 'rows', count(*) FROM labelled UNION ALL SELECT 'folds', 3",
        "text_prepare": f"SELECT 'd' || doc_id AS id, {_prepared('text')} AS model_text FROM documents UNION ALL SELECT 'u' || page_id, {_prepared(chr(39) + 'see ' + chr(39) + ' || url || ' + chr(39) + '! by @user_1 #Tag' + chr(39))} FROM pages",
        "text_clean": f"SELECT doc_id, {_cleaned(chr(39) + '#GoodNews ' + chr(39) + ' || text')} AS cleaned_text FROM documents",
        "text_fingerprints": f"SELECT doc_id, {_fingerprint(chr(39) + 'RT ' + chr(39) + ' || text')} AS text_fingerprint, sha256(text) AS text_sha256 FROM documents",
        "keyword_match": _keyword(keywords),
        "language_flags": "SELECT CASE WHEN lang = 'en' THEN 'id' ELSE lang END AS language_normalized, lang = 'en' AS is_home, count(*) AS n_rows FROM documents GROUP BY 1, 2",
        "time_buckets": f"SELECT event_type, strftime({local}, '%G-W%V') AS year_week, strftime({local}, '%Y-%m') AS year_month, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3",
        "window_filter": f"SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS published_at, event_type FROM events WHERE ts >= {low} AND ts < {high}",
        "scheduled_windows": "SELECT CAST(o_orderdate + INTERVAL 7 HOUR AS DATE) - 7 AS first_day, CAST(o_orderdate + INTERVAL 7 HOUR AS DATE) - 1 AS last_day, count(*) AS n_orders FROM orders GROUP BY 1, 2",
        "contract_violations": """
WITH p AS (SELECT doc_id FROM documents WHERE length(trim(regexp_replace(text, '\\s', '', 'g'))) > 0)
SELECT rule, n AS n_rows, (SELECT count(*) FROM p) AS total FROM (
  SELECT 'full_text is blank' AS rule, 0 AS n UNION ALL SELECT 'full_text has a replacement character', 0
  UNION ALL SELECT 'id_str is blank', (SELECT count(*) FROM p WHERE doc_id % 11 = 0) UNION ALL SELECT 'created_at is no time stamp', 0
  UNION ALL SELECT 'reply_count is no whole number of 0 or more', 0 UNION ALL SELECT 'retweet_count is no whole number of 0 or more', 0
  UNION ALL SELECT 'favorite_count is no whole number of 0 or more', (SELECT count(*) FROM p WHERE doc_id % 7 = 0) UNION ALL SELECT 'quote_count is no whole number of 0 or more', 0)""",
        "collection_selection": f"""
WITH ev AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id_str, ts FROM events)
SELECT seq, id_str FROM (
  SELECT min(seq) AS seq, id_str FROM ev WHERE ts >= {low} AND ts < {high} GROUP BY id_str)
WHERE id_str NOT IN (SELECT id_str FROM ev WHERE seq % 50 = 0) ORDER BY seq LIMIT 100""",
        "exact_duplicates": f"SELECT doc_id, row_number() OVER (PARTITION BY {_fingerprint('text')} ORDER BY doc_id) > 1 AS repeated FROM documents",
        "priority_dedupe": "SELECT event_id, user_id, event_type, quality_status FROM (SELECT event_id, user_id, event_type, CASE WHEN value > 50 THEN 'accepted' ELSE 'duplicate' END AS quality_status FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE quality_status WHEN 'accepted' THEN 0 ELSE 1 END, event_id) = 1",
        "first_wins": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
        "snapshot_append": f"""
WITH {HALVES}, added AS (
  SELECT * FROM fresh WHERE (target_program, id_str) NOT IN (SELECT (target_program, id_str) FROM old)
  QUALIFY row_number() OVER (PARTITION BY target_program, id_str ORDER BY seq) = 1)
SELECT * FROM old UNION ALL SELECT seq + (SELECT max(seq) + 1 FROM old), target_program, id_str, o_orderstatus FROM added""",
        "keyed_snapshot": f"""
WITH {HALVES}, added AS (
  SELECT * FROM fresh WHERE (target_program, id_str) NOT IN (SELECT (target_program, id_str) FROM old)
  QUALIFY row_number() OVER (PARTITION BY target_program, id_str ORDER BY seq) = 1)
SELECT * FROM old UNION ALL SELECT seq + (SELECT max(seq) + 1 FROM old), target_program, id_str, o_orderstatus FROM added""",
        "snapshot_counts": f"""
WITH {HALVES}, marked AS (
  SELECT o_orderstatus, CASE WHEN (target_program, id_str) NOT IN (SELECT (target_program, id_str) FROM old) AND row_number() OVER (PARTITION BY target_program, id_str ORDER BY seq) = 1 THEN 1 ELSE 0 END AS new FROM fresh)
SELECT o_orderstatus, count(*) AS rows_read, CAST(sum(new) AS BIGINT) AS rows_added, CAST(count(*) - sum(new) AS BIGINT) AS rows_skipped FROM marked GROUP BY 1""",
        "lineage_breaks": f"""
WITH {LABELLED}
SELECT target_program, tweet_id, problem FROM (
  SELECT source AS target_program, CAST(doc_id AS VARCHAR) AS tweet_id,
    CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'text' WHEN doc_id % 7 = 0 THEN 'conversation' END AS problem FROM labelled)
WHERE problem IS NOT NULL""",
        "review_merge": f"""
WITH {REVIEWABLE}
SELECT target_program, tweet_id, CASE WHEN doc_id % 2 = 0 THEN 'positive' ELSE sentiment_label END AS sentiment_label,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN 'irrelevant' ELSE 'relevant' END AS relevance_review,
  CASE WHEN doc_id % 2 = 1 OR (fit AND doc_id % 4 = 0) THEN 'True' ELSE 'False' END AS ai_training_candidate,
  CASE WHEN doc_id % 2 = 0 THEN 'ai_context_reviewed' ELSE '' END AS annotation_status,
  CASE WHEN doc_id % 2 = 1 OR (fit AND doc_id % 4 = 0) THEN '' ELSE 'context_review_or_preprocessing_gate' END AS candidate_exclusion_reason,
  CASE WHEN doc_id % 2 = 0 THEN 'read' ELSE '' END AS review_reason FROM reviewable""",
        "label_conflicts": f"""
WITH {REVIEWABLE}, mixed AS (SELECT {_fingerprint('model_text')} AS fp FROM reviewable GROUP BY 1 HAVING count(DISTINCT sentiment_label) > 1)
SELECT tweet_id, CASE WHEN {_fingerprint('model_text')} IN (SELECT fp FROM mixed) THEN 'False' ELSE 'True' END AS ai_training_candidate,
  CASE WHEN {_fingerprint('model_text')} IN (SELECT fp FROM mixed) THEN 'mixed_target_text_requires_target_conditioned_model' ELSE '' END AS candidate_exclusion_reason FROM reviewable""",
        "training_selection": f"WITH {REVIEWABLE} SELECT target_program, sentiment_label, count(*) AS n_rows FROM reviewable WHERE fit GROUP BY 1, 2",
        "proposal_gate": """
WITH l AS (SELECT vec_id, [CAST(embedding[1] AS DOUBLE) * 8, CAST(embedding[2] AS DOUBLE) * 8, CAST(embedding[3] AS DOUBLE) * 8] AS z FROM embeddings),
x AS (SELECT vec_id, exp(z[1] - list_max(z)) AS a, exp(z[2] - list_max(z)) AS b, exp(z[3] - list_max(z)) AS c FROM l),
p AS (SELECT vec_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM x),
r AS (SELECT vec_id, greatest(a, b, c) AS best, a + b + c - greatest(a, b, c) - least(a, b, c) AS second, CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS label FROM p),
q AS (SELECT *, concat_ws(';', CASE WHEN vec_id % 5 = 0 THEN 'preprocessing_requires_review' END, CASE WHEN vec_id % 7 = 0 THEN 'teacher_input_truncated' END, CASE WHEN best < 0.8 OR best - second < 0.25 THEN 'uncertain_teacher_prediction' END) AS reason FROM r)
SELECT vec_id, label AS teacher_proposed_label, round(best, 6) AS teacher_score, round(best - second, 6) AS teacher_margin, reason = '' AS teacher_confidence_candidate, CASE WHEN reason = '' THEN label ELSE 'uncertain' END AS sentiment_label, reason AS candidate_exclusion_reason FROM q""",
        "leakage_batches": f"WITH RECURSIVE {GROUPED} SELECT row_id, leakage_group FROM groups",
        "leakage": f"WITH RECURSIVE {GROUPED} SELECT row_id, leakage_group FROM groups",
        "benchmark_protection": f"WITH RECURSIVE {GROUPED} SELECT row_id FROM groups JOIN g USING (row_id) WHERE NOT guarded AND leakage_group NOT IN (SELECT leakage_group FROM groups JOIN g USING (row_id) WHERE guarded)",
        "crosstab": f"WITH {LABELLED} SELECT source, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'positive') AS positive FROM labelled GROUP BY source",
        "class_weights": f"WITH {LABELLED}, c AS (SELECT sentiment_label, count(*) AS n FROM labelled GROUP BY 1) SELECT sentiment_label, n AS n_rows, round((SELECT sum(n) FROM c) / CAST((SELECT count(*) FROM c) * n AS DOUBLE), 6) AS weight FROM c",
        "tfidf_word": _tfidf(r"SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents", "doc_id", 10_000),
        "tfidf_char": _tfidf("SELECT row_id, substr(w, i, n) AS term FROM (SELECT doc_id AS row_id, ' ' || unnest(regexp_extract_all(lower(text), '[^\\s]+')) || ' ' AS w FROM documents), range(3, 6) AS o(n), LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i)", "doc_id", 20_000),
        "feature_vectors": f"""
WITH {LABELLED}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM labelled), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
v AS (SELECT *, row_number() OVER (ORDER BY total DESC, term) - 1 AS place FROM (SELECT term, sum(n) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT 10000)),
w AS (SELECT doc_id, place, (ln(n) + 1) * (ln((1 + (SELECT count(*) FROM labelled)) / CAST(1 + df AS DOUBLE)) + 1) AS raw FROM c JOIN v USING (term)),
p AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) - 1 + (SELECT count(*) FROM v) AS place FROM (SELECT source, count(*) AS n FROM labelled GROUP BY source))
SELECT doc_id, CAST(place AS INTEGER) AS place, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 5) AS weight FROM w
UNION ALL SELECT doc_id, CAST(place AS INTEGER), 1.0 FROM labelled JOIN p USING (source)""",
        "classification_metrics": f"""
WITH {LABEL_REPORT}
SELECT round((SELECT avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END) FROM judged), 6) AS test_accuracy, round(avg(f1), 6) AS test_macro_f1, round(sum(f1 * support) / sum(support), 6) AS test_weighted_f1,
  round(max(CASE WHEN label = 'negative' THEN recall END), 6) AS test_recall_negative, round(max(CASE WHEN label = 'neutral' THEN recall END), 6) AS test_recall_neutral, round(max(CASE WHEN label = 'positive' THEN recall END), 6) AS test_recall_positive FROM rates""",
        "confusion_matrix": f"WITH {JUDGED}, names(truth) AS (VALUES ('negative'), ('neutral'), ('positive')) SELECT n.truth, count(*) FILTER (predicted = 'negative') AS negative, count(*) FILTER (predicted = 'neutral') AS neutral, count(*) FILTER (predicted = 'positive') AS positive FROM names n LEFT JOIN judged j ON j.truth = n.truth GROUP BY n.truth",
        "label_report": f"WITH {LABEL_REPORT} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rates",
        "fold_summary": "WITH s AS (SELECT event_type, event_id % 3 AS fold, avg(value) AS score FROM events GROUP BY 1, 2) SELECT event_type, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS folds FROM s GROUP BY 1",
        "model_selection": "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
        "majority": f"WITH {LABELLED} SELECT sentiment_label, count(*) AS n_rows FROM labelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
        "latency": "SELECT round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events",
        "independent_groups": f"WITH {LABELLED} SELECT sentiment_label, count(DISTINCT source) AS n_groups FROM labelled GROUP BY 1",
        "stream_ingest": f"SELECT event_type, strftime({local}, '%Y-%m') AS year_month, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "seen_stream": """
WITH e AS (SELECT event_id AS seq, event_id % 3 AS run, user_id, event_type FROM events)
SELECT seq, row_number() OVER (PARTITION BY run, user_id, event_type ORDER BY seq) > 1 AS repeated, run > min(run) OVER (PARTITION BY user_id, event_type) AS across FROM e""",
        "daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }
