"""The registered queries in SQL, written from the definitions, not from the Spark code."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# White space for Python's strip/split and, without U+001C..1F, for the split pattern.
_WIDE = r"\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STRIP = rf"\t\n\x0b\f\r \x1c-\x1f{_WIDE}"
_SPACE = rf"\t\n\x0b\f\r {_WIDE}"
_SPACE_NOT_BLANK = rf"\t\n\x0b\f\r{_WIDE}"
_SHORT = "(?:''s|''t|''re|''ve|''m|''ll|''d)"

USABLE = (
    f"coalesce(length(regexp_replace(text, '^[{_STRIP}]+|[{_STRIP}]+$', '', 'g')) >= 64, false)"
)


def blank(c: str) -> str:
    return f"coalesce(NOT regexp_matches({c}, '[^{_STRIP}]'), true)"


def unit(c: str = "text") -> str:
    digits = f"substr(md5({c} || length({c})::VARCHAR), 1, 13)"
    return f"(('0x' || {digits})::BIGINT / 4503599627370496.0)"


HELD = f"({unit()} < 0.05)"
SPLIT = f"CASE WHEN {HELD} THEN 'validation' ELSE 'train' END"


def seeded(seed: str, *keys: str) -> str:
    return "md5(" + " || ':' || ".join([f"({seed})::VARCHAR", *[f"({k})::VARCHAR" for k in keys]]) + ")"


# ---- pre-tokens: RE2 has no look-ahead, so a piece is cut with all its leading white space, and
# the white space is handed out afterwards.
_PIECES = (
    f"{_SHORT}|[{_SPACE}]*[{_SPACE_NOT_BLANK}]{_SHORT}"
    rf"|[{_SPACE}]*\p{{L}}+|[{_SPACE}]*\p{{N}}+|[{_SPACE}]*[^\p{{L}}\p{{N}}{_SPACE}]+|[{_SPACE}]+"
)


def pretoken_list(c: str) -> str:
    """SQL expression: list of pre-tokens of a text."""
    w, s = "w", f"regexp_extract(w, '^[{_SPACE}]*')"
    k = f"length({s})"
    body = f"substr({w}, {k} + 1)"
    last = f"substr({w}, {k}, 1)"
    ahead = f"CASE WHEN {k} > 1 THEN [substr({w}, 1, {k} - 1)] ELSE [] END"
    return (
        f"flatten(list_transform(regexp_extract_all({c}, '{_PIECES}'), lambda w: "
        f"CASE WHEN {k} = 0 OR {k} = length({w}) THEN [{w}] "
        f"WHEN {last} = ' ' THEN list_concat({ahead}, [' ' || {body}]) "
        f"ELSE list_concat({ahead}, [{last}, {body}]) END))"
    )


def byte_id(b: str) -> str:
    return (
        f"CASE WHEN {b} BETWEEN 33 AND 126 THEN {b} - 26 WHEN {b} BETWEEN 161 AND 172 THEN {b} - 60 "
        f"WHEN {b} BETWEEN 174 AND 255 THEN {b} - 61 WHEN {b} <= 32 THEN {b} + 195 "
        f"WHEN {b} BETWEEN 127 AND 160 THEN {b} + 101 ELSE 262 END"
    )


def byte_ids(c: str) -> str:
    """SQL expression: list of byte ids of a text."""
    byte = "('0x' || h)::INT"
    return f"list_transform(regexp_extract_all(hex(encode({c})), '..'), lambda h: {byte_id(byte)})"


LE_HEX = "printf('%02X%02X', id % 256, id // 256)"

DOMAIN = (
    "CASE WHEN source IN (" + ", ".join(f"'src{i}'" for i in range(10)) + ") THEN 'english' "
    "WHEN source IN (" + ", ".join(f"'src{i}'" for i in range(10, 15)) + ") THEN 'code' END"
)
NUM = "substr(source, 4)::INT"
DOCS_IN_DOMAIN = f"SELECT *, {DOMAIN} AS domain FROM documents WHERE ({DOMAIN}) IS NOT NULL"

# ---- derived frames --------------------------------------------------------------------------

CONV = """conv AS (
  SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m
  FROM conversations GROUP BY conv_id)"""

def valid(m: str) -> str:
    return (
        f"(len({m}) >= 2 AND len(list_filter({m}, lambda x: coalesce(x.role, '') NOT IN "
        f"('system', 'user', 'assistant') OR {blank('x.content')})) = 0 AND {m}[-1].role = 'assistant')"
    )


PAIRS = (
    CONV
    + """, heads AS (
  SELECT conv_id, m, list_position(list_transform(m, lambda x: x.role), 'assistant') AS p,
         list_filter(m, lambda x: x.role = 'assistant') AS a FROM conv),
raw_pairs AS (
  SELECT conv_id, m[1:p] AS chosen, list_concat(m[1:p - 1], [a[2]]) AS rejected
  FROM heads WHERE len(a) >= 2),
prefixed AS (
  SELECT *, len(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
    lambda i: len(list_filter(range(1, i + 1), lambda j: chosen[j] IS DISTINCT FROM rejected[j])) = 0)) AS c
  FROM raw_pairs),
pairs AS (
  SELECT conv_id, chosen AS full_chosen, rejected AS full_rejected, chosen[1:c] AS prompt,
         chosen[c + 1:] AS chosen, rejected[c + 1:] AS rejected FROM prefixed WHERE c > 0)"""
)
PAIRS_KEPT = (
    PAIRS
    + f""", good_pairs AS (
  SELECT * FROM pairs WHERE {valid('full_chosen')} AND {valid('full_rejected')}
    AND len(prompt) > 0 AND len(chosen) > 0 AND len(rejected) > 0
    AND chosen[-1].role = 'assistant' AND rejected[-1].role = 'assistant')"""
)

SCORED = """assistants AS (
  SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k
  FROM conversations WHERE role = 'assistant'),
scored AS (
  SELECT x.conv_id, u.prompt, x.text AS response_1, y.text AS response_2,
         (x.conv_id % 7 - 3)::INT AS preference_strength,
         CASE WHEN x.conv_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM assistants x JOIN assistants y USING (conv_id)
  JOIN (SELECT conv_id, min_by(text, turn) AS prompt FROM conversations
        WHERE role = 'user' GROUP BY conv_id) u ON u.conv_id = x.conv_id // 2
  WHERE x.k = 1 AND y.k = 2)"""
SCORED_KEPT = (
    SCORED
    + f""", good_scored AS (
  SELECT * FROM scored WHERE preference_strength <> 0 AND NOT {blank('prompt')}
    AND NOT {blank('response_1')} AND NOT {blank('response_2')})"""
)


def joined(m: str) -> str:
    return f"md5(array_to_string(list_transform({m}, lambda x: x.role || ':' || x.content), '|'))"


def exact_split_cte(name: str, source: str, key: str, divisor: int, rows: int = 2000, seed: int = 42) -> str:
    """CTE ``name``: all rows of ``source`` with ``side`` of an exact random split."""
    return f"""{name} AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {seeded(str(seed), key)}, {key})
      <= least({rows}, greatest(1, (count(*) OVER ()) // {divisor})) THEN 'validation' ELSE 'train' END AS side
  FROM {source})"""


SIDES = (
    "WITH "
    + PAIRS_KEPT
    + ", "
    + SCORED_KEPT
    + ", "
    + exact_split_cte("sft_all", "conv", "conv_id", 100)
    + f", sft AS (SELECT conv_id, side FROM sft_all WHERE {valid('m')}), "
    + exact_split_cte("dpo", "good_pairs", "conv_id", 100)
    + ", "
    + exact_split_cte("scored_random", "good_scored", "conv_id", 10)
    + """, reward AS (
  SELECT conv_id, prompt, CASE WHEN (SELECT count(DISTINCT split) FROM good_scored) = 2
    THEN split ELSE side END AS side FROM scored_random),
rlhf AS (SELECT min(conv_id) AS conv_id, side, prompt FROM reward GROUP BY side, prompt),
all_rows AS (
  SELECT 'sft' AS collection, side AS split, conv_id FROM sft
  UNION ALL SELECT 'dpo', side, conv_id FROM dpo
  UNION ALL SELECT 'reward', side, conv_id FROM reward
  UNION ALL SELECT 'rlhf', side, conv_id FROM rlhf)
"""
)

SIZES = """sizes AS (
  SELECT source, sum(octet_length(encode(text)) + 2)::BIGINT AS n_tokens FROM documents GROUP BY source)"""
OFFSETS = (
    SIZES
    + """, offsets AS (
  SELECT source, n_tokens AS tokens, n_tokens // 512 AS blocks,
         (sum(n_tokens // 512) OVER (ORDER BY source) - n_tokens // 512)::BIGINT AS lo,
         (sum(n_tokens // 512) OVER (ORDER BY source))::BIGINT AS hi,
         n_tokens // 512 * 512 AS usable_tokens
  FROM sizes WHERE n_tokens // 512 > 0)"""
)
BLOCKS = (
    OFFSETS
    + """, blocks AS (
  SELECT source, unnest(range(lo, hi)) AS block_index, lo FROM offsets),
total AS (SELECT max(hi) AS n FROM offsets)"""
)

# Blocks, epoch, multiplier and offset for the block counts of the shipped tables and seed 7. They come
# from Python's generator, which SQL does not have, and were worked out apart from the library.
EPOCH_NUMBERS = [
    (961, 0, 332, 154),
    (961, 1, 252, 332),
    (961, 2, 234, 625),
    (961, 3, 127, 824),
    (961, 4, 115, 955),
    (961, 5, 169, 718),
    (961, 6, 34, 99),
    (961, 7, 362, 133),
    (4823, 0, 2654, 1235),
    (4823, 1, 2011, 2661),
    (4823, 2, 1865, 3672),
    (4823, 3, 1016, 2621),
    (4823, 4, 914, 3286),
    (4823, 5, 1348, 4056),
    (4823, 6, 268, 794),
    (4823, 7, 2892, 1065),
    (49663, 0, 21223, 9886),
    (49663, 1, 16082, 21295),
    (49663, 2, 14914, 40028),
    (49663, 3, 8126, 48449),
    (49663, 4, 7306, 48164),
    (49663, 5, 10780, 45980),
    (49663, 6, 2137, 6357),
    (49663, 7, 23128, 8522),
]


def epoch_parameter_cte(epochs: int) -> str:
    rows = ", ".join(str(r) for r in EPOCH_NUMBERS if r[1] < epochs)
    return f"params(blocks, epoch, a, b) AS (VALUES {rows})"


# ---- scans, sources, sinks -------------------------------------------------------------------

ORACLES["corpus_scan"] = """
SELECT 'documents.parquet' AS file, doc_id AS row_index, length(text)::BIGINT AS chars, md5(text) AS digest
FROM documents"""

ORACLES["missing_text_policy"] = " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM {t} WHERE text IS NOT NULL"
    for t in ("documents", "benchmark", "conversations")
)

ORACLES["shard_listing"] = " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file, count(*) AS rows FROM {t}"
    for t in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    )
)


def _spaced(k: str) -> str:
    return f"""
WITH listing AS (
  SELECT source, count(*) AS rows, row_number() OVER (ORDER BY source) - 1 AS position
  FROM documents GROUP BY source),
size AS (SELECT count(*) AS n, {k} AS k FROM listing),
chosen AS (
  SELECT DISTINCT CASE WHEN k >= n THEN i WHEN k = 1 THEN n // 2
    ELSE round_even(i * (n - 1) / greatest(k - 1, 1)::DOUBLE, 0) END::BIGINT AS position
  FROM size, unnest(range(least(k, n))) AS r(i))
SELECT source, position, rows FROM listing WHERE position IN (SELECT position FROM chosen)"""


ORACLES["shard_sample"] = _spaced("7::BIGINT")
ORACLES["shard_budget"] = _spaced(
    "(SELECT greatest(1, least(85, round_even(sum(length(text)) * 400 * 1.2::DOUBLE / 117000000, 0)))::BIGINT FROM documents)"
)

ORACLES["split_by_filename"] = f"""
WITH listing AS (
  SELECT 'test/' || CASE {NUM} % 5 WHEN 0 THEN 'Test' WHEN 1 THEN 'eval' WHEN 2 THEN 'train-Validation'
         WHEN 3 THEN 'other' ELSE 'TRAIN' END || '-' || source AS path, count(*) AS rows
  FROM documents GROUP BY 1),
named AS (SELECT *, lower(split_part(path, '/', -1)) AS name FROM listing)
SELECT path, 'train' AS split, rows FROM named
WHERE contains(name, 'train') OR NOT (SELECT bool_or(contains(name, 'train')) FROM named)
UNION ALL
SELECT path, 'validation', rows FROM named
WHERE contains(name, 'test') OR contains(name, 'validation') OR contains(name, 'eval')"""

ORACLES["preference_jsonl_scan"] = f"""
WITH {SCORED} SELECT conv_id, preference_strength, split, md5(prompt) AS prompt_md5,
  md5(response_1) AS response_1_md5, md5(response_2) AS response_2_md5 FROM scored"""

ORACLES["token_sink"] = f"""
SELECT {SPLIT} AS split, source, count(*) AS documents,
  sum(octet_length(encode(nfc_normalize(text))) + 2)::BIGINT AS tokens,
  (2 * sum(octet_length(encode(nfc_normalize(text))) + 2))::BIGINT AS bytes
FROM documents WHERE {USABLE} GROUP BY 1, 2"""

ORACLES["normalized_sink"] = (
    SIDES
    + "SELECT collection, split, count(*) AS rows, min(conv_id) AS first_id, sum(conv_id)::BIGINT AS id_sum FROM all_rows GROUP BY 1, 2"
)

ORACLES["normalized_manifest"] = (
    SIDES
    + """SELECT collection, split, count(*) AS rows, 42::INT AS seed, 2000::INT AS validation_rows,
  'drop' AS on_no_prompt, 'You are a helpful, honest, and concise AI assistant.' AS system_prompt
FROM all_rows GROUP BY 1, 2"""
)

# ---- projections and filters -----------------------------------------------------------------

ORACLES["min_chars_filter"] = f"SELECT doc_id, source FROM documents WHERE {USABLE}"
ORACLES["char_cap"] = """
SELECT doc_id, length(substr(text, 1, 16384))::BIGINT AS chars, md5(substr(text, 1, 16384)) AS digest
FROM documents"""
ORACLES["hash_split"] = f"SELECT doc_id, {SPLIT} AS split FROM documents"
ORACLES["chunk_documents"] = """
WITH pieces AS (
  SELECT doc_id, c AS chunk, substr(text, c * 1000 + 1, 1000) AS piece
  FROM documents, unnest(range((length(text) + 999) // 1000)) AS r(c))
SELECT doc_id, chunk, length(piece)::BIGINT AS chars, md5(piece) AS digest FROM pieces"""
ORACLES["valid_messages"] = f"""
WITH {CONV} SELECT conv_id, len(m)::BIGINT AS turns FROM conv WHERE {valid('m')}"""
ORACLES["explicit_pref_filter"] = f"""
WITH {PAIRS_KEPT} SELECT conv_id, {joined('prompt')} AS prompt, {joined('chosen')} AS chosen,
  {joined('rejected')} AS rejected FROM good_pairs"""
ORACLES["scored_pref_filter"] = f"""
WITH {SCORED_KEPT} SELECT conv_id, preference_strength FROM good_scored"""
ORACLES["require_columns"] = " UNION ALL ".join(
    f"SELECT '{t}' AS name, count({c}) AS rows FROM {t}"
    for t, c in (("documents", "text"), ("conversations", "role"), ("events", "value"), ("labels", "quality"))
)
ORACLES["domain_map"] = f"""
SELECT domain, source, count(*) AS documents FROM ({DOCS_IN_DOMAIN}) GROUP BY 1, 2"""
ORACLES["heldout_filter"] = f"SELECT doc_id FROM documents WHERE doc_id // 8 >= 10 AND NOT {HELD}"

# ---- joins -----------------------------------------------------------------------------------

ORACLES["explicit_preference"] = f"""
WITH {PAIRS} SELECT conv_id, {joined('prompt')} AS prompt, {joined('chosen')} AS chosen,
  {joined('rejected')} AS rejected, len(prompt)::BIGINT AS prompt_turns,
  len(chosen)::BIGINT AS chosen_turns, len(rejected)::BIGINT AS rejected_turns FROM pairs"""
ORACLES["incremental_skip"] = f"""
SELECT DISTINCT source, CASE WHEN {NUM} % 6 = 0 THEN 'cached' ELSE 'pending' END AS state FROM documents"""
ORACLES["block_locate"] = f"""
WITH {BLOCKS}, requests AS (
  SELECT event_id, (event_id * 7919) % (SELECT n FROM total) AS block_index FROM events)
SELECT event_id, block_index, source, block_index - lo AS local_block
FROM requests JOIN offsets ON block_index >= lo AND block_index < hi"""
ORACLES["paired_compare"] = f"""
WITH counts AS (
  SELECT domain, length(text) AS c, len({pretoken_list('text')}) AS a,
    octet_length(encode(text)) - length(text) + 2 * len(regexp_extract_all(text, '[^{_STRIP}]+')) AS b
  FROM ({DOCS_IN_DOMAIN}))
SELECT domain, count(*) FILTER (a < b) AS a_wins, count(*) FILTER (b < a) AS b_wins,
  count(*) FILTER (a = b) AS ties,
  round((sum(a) - sum(b)) * 100 / sum(a)::DOUBLE, 6) AS token_reduction_percent,
  round(((sum(c) / sum(b)::DOUBLE) / (sum(c) / sum(a)::DOUBLE) - 1) * 100, 6) AS context_gain_percent
FROM counts GROUP BY domain"""
ORACLES["manifest_upsert"] = f"""
WITH previous AS (
  SELECT source, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes
  FROM documents WHERE lang = 'en' AND {NUM} % 3 <> 0 GROUP BY source),
fresh AS (
  SELECT source, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes
  FROM documents WHERE {NUM} % 2 = 0 GROUP BY source)
SELECT * FROM fresh UNION ALL SELECT * FROM previous WHERE source NOT IN (SELECT source FROM fresh)"""

# ---- aggregations ----------------------------------------------------------------------------

STATS = f"""counted AS (
  SELECT source, {USABLE} AS u, {HELD} AS v, len({pretoken_list('text')}) + 2 AS t FROM documents),
stats AS (
  SELECT source, coalesce(sum(t) FILTER (u AND NOT v), 0)::BIGINT AS train_tokens,
    coalesce(sum(t) FILTER (u AND v), 0)::BIGINT AS validation_tokens,
    count(*) FILTER (u) AS documents, count(*) FILTER (NOT u) AS skipped_documents
  FROM counted GROUP BY source)"""
ORACLES["shard_build_stats"] = f"WITH {STATS} SELECT * FROM stats"
ORACLES["split_manifest"] = f"""
WITH {STATS}, long AS (
  SELECT 'train' AS split, source, train_tokens AS tokens FROM stats WHERE train_tokens > 0
  UNION ALL SELECT 'validation', source, validation_tokens FROM stats WHERE validation_tokens > 0)
SELECT 'shard' AS level, split, source, tokens, 1::BIGINT AS shards FROM long
UNION ALL SELECT 'split', split, '-', sum(tokens)::BIGINT, count(*) FROM long GROUP BY split
UNION ALL SELECT 'all', '-', '-', sum(tokens)::BIGINT, count(*) FROM long"""
ORACLES["collection_counts"] = (
    SIDES + "SELECT collection, split, count(*) AS rows FROM all_rows GROUP BY 1, 2"
)

WORDS = f"""words AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (
    SELECT unnest({pretoken_list('nfc_normalize(text)')}) AS word FROM documents) GROUP BY word)"""
ORACLES["pretoken_counts"] = f"WITH {WORDS} SELECT word, n FROM words"

# A word is a string of ids, each between two blanks, so that REPLACE cannot match across ids.
SPELLED = f"""spelled0 AS MATERIALIZED (
  SELECT word, n, ' ' || array_to_string({byte_ids('word')}, '  ') || ' ' AS s FROM words)"""


def _pairs(source: str) -> str:
    ids = "list_transform(string_split(trim(s), '  '), lambda x: x::INT)"
    return f"""(
  SELECT p[1] AS l, p[2] AS r, sum(n)::BIGINT AS n FROM (
    SELECT unnest(list_zip(ids[:-2], ids[2:])) AS p, n FROM (
      SELECT {ids} AS ids, n FROM {source}) WHERE len(ids) > 1) GROUP BY ALL)"""


def _merge_rounds(merges: int) -> str:
    ctes = []
    for i in range(merges):
        new = 263 + i
        ctes.append(
            f"best{i} AS MATERIALIZED (SELECT l, r, n FROM {_pairs(f'spelled{i}')} ORDER BY n DESC, l, r LIMIT 1)"
        )
        ctes.append(
            f"spelled{i + 1} AS MATERIALIZED (SELECT word, spelled{i}.n, "
            f"replace(s, ' ' || l || '  ' || r || ' ', ' {new} ') AS s FROM spelled{i}, best{i})"
        )
    return ", ".join(ctes)


ORACLES["bpe_pair_counts"] = f"""
WITH {WORDS}, {SPELLED} SELECT l AS left_id, r AS right_id, n FROM {_pairs('spelled0')}"""

MERGES = 64
TRAINED = f"{WORDS}, {SPELLED}, {_merge_rounds(MERGES)}"
ORACLES["bpe_prefix"] = f"WITH {TRAINED} " + " UNION ALL ".join(
    f"SELECT {i}::INT AS rank, l AS left_id, r AS right_id, {263 + i}::INT AS new_id, n AS pair_count FROM best{i}"
    for i in range(MERGES)
)

ORACLES["domain_summary"] = f"""
WITH rows AS (
  SELECT domain, length(text) AS c, octet_length(encode(text)) AS b,
    len(regexp_extract_all(text, '[^{_STRIP}]+')) AS w,
    octet_length(encode(nfc_normalize(text))) AS t FROM ({DOCS_IN_DOMAIN}))
SELECT domain, count(*) AS documents, sum(c)::BIGINT AS characters, sum(b)::BIGINT AS utf8_bytes,
  sum(w)::BIGINT AS words, sum(t)::BIGINT AS tokens,
  round(sum(t) * 100 / sum(c)::DOUBLE, 6) AS tokens_per_100_characters,
  round(sum(c) / sum(t)::DOUBLE, 6) AS characters_per_token,
  round(sum(b) / sum(t)::DOUBLE, 6) AS bytes_per_token,
  round(sum(t) / sum(w)::DOUBLE, 6) AS tokens_per_word,
  round(sum(c) / sum(t)::DOUBLE * 2048, 6) AS characters_per_context,
  round(count(*) FILTER (t > 2048) * 100 / count(*)::DOUBLE, 6) AS documents_over_context_percent,
  0::BIGINT AS unknown_tokens, 0::BIGINT AS roundtrip_failures
FROM rows GROUP BY domain"""
ORACLES["fertility_percentiles"] = f"""
WITH rows AS (
  SELECT domain, len({pretoken_list('text')}) * 100.0::DOUBLE / greatest(length(text), 1) AS f
  FROM ({DOCS_IN_DOMAIN}))
SELECT domain, round(quantile_cont(f, 0.5), 6) AS fertility_p50,
  round(quantile_cont(f, 0.9), 6) AS fertility_p90, round(quantile_cont(f, 0.99), 6) AS fertility_p99
FROM rows GROUP BY domain"""
ORACLES["sketched_report"] = f"""
WITH bytes AS (
  SELECT domain, doc_id, unnest(regexp_extract_all(hex(encode(nfc_normalize(text))), '..')) AS b FROM ({DOCS_IN_DOMAIN})),
ids AS (SELECT domain, count(DISTINCT b) AS observed_ids FROM bytes GROUP BY domain)
SELECT domain, documents, observed_ids, true AS ids_hold, true AS fertility_p50_holds,
  true AS fertility_p90_holds, true AS fertility_p99_holds
FROM (SELECT domain, count(*) AS documents FROM ({DOCS_IN_DOMAIN}) GROUP BY domain) JOIN ids USING (domain)"""
ORACLES["heldout_comparison"] = f"""
SELECT DISTINCT domain, 8::BIGINT AS documents, 8::BIGINT AS decided, 0::BIGINT AS b_wins,
  0::BIGINT AS roundtrip_failures, 0::BIGINT AS unknown_tokens, true AS shorter, true AS uses_merges
FROM ({DOCS_IN_DOMAIN})"""
ORACLES["vocab_coverage"] = f"""
WITH seen AS (
  SELECT DISTINCT domain, unnest(list_distinct(regexp_extract_all(hex(encode(nfc_normalize(text))), '..'))) AS h
  FROM ({DOCS_IN_DOMAIN}))
SELECT domain, count(*) AS observed_ids, round(count(*) * 100 / 263.0::DOUBLE, 6) AS observed_percent
FROM seen GROUP BY domain"""
ORACLES["eval_perplexity"] = """
SELECT event_type, count(value) AS batches, round(avg(value / 10), 6) AS mean_loss,
  round(exp(least(avg(value / 10), 20.0)), 4) AS perplexity FROM events GROUP BY event_type"""
ORACLES["manifest_audit"] = f"""
WITH shards AS (
  SELECT source, {NUM} AS n, lang, sum(octet_length(encode(text)) + 2)::BIGINT AS tokens
  FROM documents GROUP BY ALL),
per AS (
  SELECT source, any_value(n) AS n, sum(tokens)::BIGINT AS total, count(*) AS shards,
    count(*) FILTER (lang = 'en') AS en FROM shards GROUP BY source)
SELECT source AS manifest, n % 7 = 0 OR (n % 7 IN (3, 4) AND en = 0) AS passed,
  CASE WHEN n % 7 = 1 THEN 'format' WHEN n % 7 = 2 THEN 'tokenizer'
    WHEN n % 7 = 3 AND en > 0 THEN 'missing_file' WHEN n % 7 = 4 AND en > 0 THEN 'file_size'
    WHEN n % 7 = 5 THEN 'no_shards' WHEN n % 7 = 6 THEN 'total' ELSE 'ok' END AS reason,
  CASE WHEN n % 7 = 5 THEN 0 ELSE shards END AS shards,
  CASE WHEN n % 7 = 5 THEN 0 ELSE total END AS counted_tokens FROM per"""
ORACLES["interval_rollup"] = """
WITH log AS (SELECT event_id + 1 AS step, value, ts FROM events),
windows AS (
  SELECT CASE WHEN step = 1 THEN 0 ELSE (step + 9) // 10 END AS w, max(step) AS step,
    count(*) AS steps, avg(value) AS loss, min(step) AS first_step, max_by(ts, step) AS close_ts,
    min(ts) AS lo_ts, max(ts) AS hi_ts
  FROM log GROUP BY 1),
timed AS (
  SELECT windows.*, (epoch_us(greatest(hi_ts, coalesce(log.ts, hi_ts))) - epoch_us(least(lo_ts, coalesce(log.ts, lo_ts)))) / 1000000.0::DOUBLE AS elapsed
  FROM windows LEFT JOIN log ON log.step = first_step - 1)
SELECT step, step * 65536 AS tokens, steps, round(loss, 6) AS loss, round(elapsed, 3) AS elapsed_seconds,
  round(CASE WHEN elapsed > 0 THEN steps * 65536 / elapsed END, 3) AS tokens_per_second
FROM timed WHERE step = 1 OR step % 10 = 0"""

# ---- windows, ordering, sampling -------------------------------------------------------------

ORACLES["per_shard_quota"] = f"""
WITH q AS (SELECT ceil(2500.0 / count(DISTINCT source))::BIGINT AS quota FROM documents),
ranked AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k
  FROM documents WHERE {USABLE}),
shards AS (SELECT source, least(count(*), (SELECT quota FROM q)) AS taken FROM ranked GROUP BY source),
pass AS (SELECT sum(taken)::BIGINT AS s, (2500 // sum(taken))::BIGINT AS f FROM shards),
tail AS (
  SELECT source, taken, f, greatest(0, least(taken, 2500 - f * s - coalesce(sum(taken) OVER (
    ORDER BY {seeded('42 + f * s', 'source')}, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS rest
  FROM shards, pass)
SELECT source, doc_id, c AS copy
FROM (SELECT source, doc_id, f + CASE WHEN k < rest THEN 1 ELSE 0 END AS copies
      FROM ranked JOIN tail USING (source) WHERE k < taken), unnest(range(copies::BIGINT)) AS r(c)"""
ORACLES["tail_sample"] = f"""
WITH docs AS (
  SELECT 'part-' || (doc_id % 8) AS shard, doc_id // 8 AS row_index, doc_id, text, {DOMAIN} AS domain
  FROM documents),
quotas AS (
  SELECT shard, 60 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY shard) - 1 < 60 % count(*) OVER ()
    THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT shard FROM docs)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY shard, domain ORDER BY {seeded('120', 'shard', 'row_index')}, row_index) AS k
  FROM docs WHERE domain IS NOT NULL AND row_index >= 10 AND {USABLE} AND NOT {HELD})
SELECT shard, domain, doc_id, md5(nfc_normalize(substr(text, 1, 16384))) AS digest
FROM ranked JOIN quotas USING (shard) WHERE k <= quota"""
ORACLES["pack_blocks"] = f"""
WITH ids AS (
  SELECT source, doc_id, list_concat([0], list_concat({byte_ids('nfc_normalize(text)')}, [1])) AS ids
  FROM documents WHERE {USABLE}),
stream AS (
  SELECT source, doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM ids),
placed AS (
  SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS p FROM stream)
SELECT source, p // 512 AS block, md5(string_agg({LE_HEX}, '' ORDER BY p)) AS digest
FROM placed GROUP BY 1, 2 HAVING count(*) = 512"""
ORACLES["block_offsets"] = f"WITH {OFFSETS} SELECT * FROM offsets"
ORACLES["unique_prompts"] = (
    SIDES
    + """SELECT conv_id, side AS split, md5('system:You are a helpful, honest, and concise AI assistant.|user:' || prompt) AS prompt FROM rlhf"""
)
ORACLES["evaluation_subset"] = "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 1000"
ORACLES["exact_split"] = (
    "WITH " + exact_split_cte("parts", "documents", "doc_id", 100) + " SELECT doc_id, side AS split FROM parts"
)
ORACLES["source_split"] = (
    f"WITH {SCORED_KEPT}, "
    + exact_split_cte("everything", "good_scored", "conv_id", 10)
    + ", only_train AS (SELECT * FROM good_scored WHERE split = 'train'), "
    + exact_split_cte("alone", "only_train", "conv_id", 10)
    + """ SELECT conv_id, CASE WHEN (SELECT count(DISTINCT split) FROM good_scored) = 2 THEN split ELSE side END AS split,
  'both' AS input FROM everything
UNION ALL SELECT conv_id, side, 'train only' FROM alone"""
)
ORACLES["epoch_permutation"] = f"""
WITH {BLOCKS}, {epoch_parameter_cte(2)}
SELECT epoch::BIGINT AS epoch, epoch * n + i AS sample, ((a * i + b) % n)::BIGINT AS block_index
FROM total JOIN params ON blocks = n, unnest(range(n)) AS r(i)"""
ORACLES["training_plan"] = f"""
WITH {BLOCKS}, {epoch_parameter_cte(8)},
plan AS (SELECT n, s, s // n AS epoch, s % n AS i FROM total,
  unnest(range(100 * 8, ceil((n * 512 * 6 // 5) / (512 * 8.0))::BIGINT * 8)) AS r(s))
SELECT s // 8 AS step, s % 8 // 4 AS round, s % 4 AS slot, s AS sample, source, block_index - lo AS block
FROM plan JOIN params ON params.blocks = n AND params.epoch = plan.epoch
JOIN blocks ON block_index = (a * i + b) % n"""
ORACLES["eval_plan"] = f"""
WITH {BLOCKS}, plan AS (
  SELECT s, s % n AS k FROM total, unnest(range((n + 6) // 7 * 7)) AS r(s))
SELECT s // 7 AS batch, s % 7 AS slot, source, block_index - lo AS block
FROM plan JOIN blocks ON block_index = k"""

# ---- column functions ------------------------------------------------------------------------

ORACLES["nfc_normalize"] = """
SELECT doc_id, length(nfc_normalize(text))::BIGINT AS chars, md5(nfc_normalize(text)) AS digest FROM documents"""
ORACLES["pretokenize"] = f"""
WITH t AS (SELECT doc_id, {pretoken_list('text')} AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS pretokens, md5(array_to_string(t, chr(1))) AS digest FROM t"""
ORACLES["bpe_prefix_encode"] = f"""
WITH {TRAINED}, ids AS (
  SELECT word, list_transform(string_split(trim(s), '  '), lambda x: x::INT) AS ids FROM spelled{MERGES}),
pieces AS (
  SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (
    SELECT doc_id, {pretoken_list('nfc_normalize(text)')} AS t FROM documents)),
texts AS (
  SELECT doc_id, sum(len(ids)) AS n,
    string_agg(array_to_string(list_transform(ids, lambda id: {LE_HEX}), ''), '' ORDER BY pos) AS hex
  FROM pieces JOIN ids USING (word) GROUP BY doc_id)
SELECT doc_id, (coalesce(n, 0) + 2)::BIGINT AS n_tokens, md5('0000' || coalesce(hex, '') || '0100') AS digest
FROM documents LEFT JOIN texts USING (doc_id)"""
ORACLES["bpe_dictionary_encode"] = """
SELECT doc_id, md5(nfc_normalize(text)) AS digest, length(nfc_normalize(text))::BIGINT AS chars FROM documents"""
ORACLES["bpe_roundtrip"] = """
SELECT doc_id, md5(nfc_normalize(text)) AS digest, 0::BIGINT AS unknown_tokens, true AS same FROM documents"""
ORACLES["text_stats"] = f"""
SELECT doc_id, length(text)::BIGINT AS chars, octet_length(encode(text))::BIGINT AS utf8_bytes,
  len(regexp_extract_all(text, '[^{_STRIP}]+'))::BIGINT AS words FROM documents"""
_RENDER = (
    "CASE WHEN len(m) > 0 THEN '<|beginoftext|>' ELSE '' END || array_to_string(list_transform(m, lambda x: "
    "'<|' || x.role || '|>' || chr(10) || x.content || '<|endoftext|>' || chr(10)), '')"
)
ORACLES["chat_render"] = f"""
WITH {CONV}, shown AS (SELECT conv_id, {_RENDER} AS t FROM conv)
SELECT conv_id, length(t)::BIGINT AS chars, md5(t) AS digest,
  md5(t || '<|assistant|>' || chr(10)) AS prompt_digest FROM shown"""
ORACLES["assistant_spans"] = """
WITH turns AS (
  SELECT conv_id, turn, role, length(role) + 5 AS head, length(text) + 13 AS body,
    15 + coalesce(sum(length(role) + 5 + length(text) + 14) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k,
  (begins + head)::BIGINT AS start, (begins + head + body)::BIGINT AS "end" FROM turns WHERE role = 'assistant'"""
ORACLES["normalize_scored_pref"] = f"""
WITH {SCORED_KEPT}
SELECT conv_id, md5('system:You are a helpful, honest, and concise AI assistant.|user:' || prompt) AS prompt,
  md5('assistant:' || CASE WHEN preference_strength < 0 THEN response_1 ELSE response_2 END) AS chosen,
  md5('assistant:' || CASE WHEN preference_strength < 0 THEN response_2 ELSE response_1 END) AS rejected,
  abs(preference_strength)::INT AS preference_strength, split AS source_split FROM good_scored"""
ORACLES["completion_health"] = f"""
WITH spoken AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[^{_STRIP}]+') AS w FROM conversations),
grams AS (
  SELECT conv_id, turn, len(w) AS n,
    list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) AS g FROM spoken)
SELECT conv_id, turn, round(0.0 - (least(1.0, 5.0 * ((len(g) - len(list_distinct(g))) / greatest(len(g), 1)::DOUBLE))
  + CASE WHEN n < 2 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS score FROM grams"""
ORACLES["content_fingerprint"] = """
SELECT doc_id, sha256(text) AS sha256, substr(sha256(source || '/' || doc_id), 1, 10) AS file_key FROM documents"""
ORACLES["stream_prepare"] = f"""
SELECT {SPLIT} AS split, source AS shard, count(*) AS documents,
  sum(octet_length(encode(nfc_normalize(text))) + 2)::BIGINT AS tokens
FROM documents WHERE {USABLE} GROUP BY 1, 2"""
ORACLES["prepare_incremental"] = f"""
WITH numbered AS (
  SELECT *, {NUM} % 3 AS third, doc_id // 20 % 2 = 0 AS again,
    {NUM} % 3 = 0 AND bool_or(doc_id // 20 % 2 = 0) OVER (PARTITION BY source) AS changed FROM documents),
landed AS (
  SELECT source, CASE WHEN third = 2 OR changed THEN 2 ELSE 1 END::INT AS wave, {USABLE} AS usable, {SPLIT} AS split,
    octet_length(encode(nfc_normalize(text))) + 2 AS tokens
  FROM numbered WHERE again OR NOT changed)
SELECT source, wave, count(*) FILTER (usable) AS documents, count(*) FILTER (NOT usable) AS skipped_documents,
  coalesce(sum(tokens) FILTER (usable AND split = 'train'), 0)::BIGINT AS train_tokens,
  coalesce(sum(tokens) FILTER (usable AND split = 'validation'), 0)::BIGINT AS validation_tokens,
  true AS passed, true AS unchanged_run_kept
FROM landed GROUP BY source, wave"""
ORACLES["stream_interval_rollup"] = ORACLES["interval_rollup"]
