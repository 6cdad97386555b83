"""The registered queries of this subpackage and, where SQL expresses them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, line_dedup, mixing, sharding, token_counts, token_store, topk, toxicity
from .common import table

END_ID = 2


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])
    return placed.select("doc_id", "slot", "shard")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.digest(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat.format_chat(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "turn", "role", "thread", "parent_turn", "depth", "n_quotes", "n_linked", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), k=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_line_dedup, op3_toxicity, op4_topk, op5_token_store, op6_token_counts, op7_decontaminate, op8_mixing, op9_quotation_linking, op10_jaccard_join, pipeline)
    return {f.__name__: f for f in ops}


SHARDING_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, md5('shard-' || i) AS h FROM range({sharding.SHARDS}) t(i)
), steps AS (
  SELECT i, ('0x' || substr(h, 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS start,
         ('0x' || substr(h, 16, 15))::BIGINT % {sharding.TABLE_SIZE - 1} + 1 AS step
  FROM shards
), preference AS (
  SELECT i, list((start + j * step) % {sharding.TABLE_SIZE} ORDER BY j) AS slots
  FROM steps, range({sharding.TABLE_SIZE}) r(j) GROUP BY i
), fill AS (
  SELECT 0::BIGINT AS turn, NULL::BIGINT AS slot, [false for x in range({sharding.TABLE_SIZE})] AS taken
  UNION ALL
  SELECT turn + 1, next, list_concat(taken[:next], [true], taken[next + 2:])
  FROM (SELECT f.turn, f.taken, [s for s in p.slots if not f.taken[s + 1]][1] AS next
        FROM fill f JOIN preference p ON p.i = f.turn % {sharding.SHARDS} WHERE f.turn < {sharding.TABLE_SIZE})
), owner AS (SELECT slot, (turn - 1) % {sharding.SHARDS} AS shard FROM fill WHERE slot IS NOT NULL),
placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0))), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents
)
SELECT doc_id, slot::INTEGER AS slot, shard::INTEGER AS shard FROM placed JOIN owner USING (slot)
"""

LINE_DEDUP_SQL = f"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS cut FROM documents),
raw AS (SELECT doc_id, text, unnest(cut) AS raw, generate_subscripts(cut, 1) - 1 AS pos FROM docs),
lines AS (SELECT doc_id, pos, trim(raw, chr(32) || chr(9) || chr(13)) AS line FROM raw),
firsts AS (SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line <> '' GROUP BY line),
long AS (SELECT line, first, length(line) AS n FROM firsts WHERE length(line) >= {line_dedup.MIN_CHARS}),
near AS (
  SELECT DISTINCT a.line FROM long a, (SELECT unnest([n - 1, n, n + 1]) AS m, line, first FROM long) b
  WHERE a.n = b.m AND b.first < a.first AND levenshtein(a.line, b.line) = 1
),
gone AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN firsts f ON l.line = f.line
  WHERE (l.doc_id, l.pos) > f.first OR l.line IN (SELECT line FROM near)
),
kept AS (
  SELECT r.doc_id, count(*) AS n_lines, count(g.pos) AS n_dropped,
         coalesce(string_agg(r.raw, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL), '') AS text
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos GROUP BY r.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, md5(coalesce(k.text, '')) AS text_md5
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""

LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE_SQL = rf"""
WITH item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, w[i:i + least(len(w), 8) - 1] AS win, least(len(w), 8) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.win = win.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, w[i:i + least(len(w), 3) - 1] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT w.doc_id, coalesce(size.n, 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, size.n
"""


BLANK = "[ \\t\\n\\x0B\\f\\r]"


def norm_sql(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'), ' '))"


def keys_sql(passages: str, names: str) -> str:
    """kind, key and weight of each lookup of a passage ``said``."""
    n = chat.WINDOW
    words = f"string_split({norm_sql('said')}, ' ')"
    return f"""
  SELECT {names}, 0 AS kind, {norm_sql('said')} AS key, {chat.WHOLE} AS weight FROM {passages} WHERE {norm_sql('said')} <> ''
  UNION ALL SELECT {names}, 1, key, length(key) FROM (SELECT {names}, {norm_sql('unnest(string_split(said, chr(10)))')} AS key FROM {passages}) WHERE key <> ''
  UNION ALL SELECT {names}, 2, array_to_string(w[i:i + {n - 1}], ' '), length(w[i]) + 1 FROM (
    SELECT {names}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {names}, {words} AS w FROM {passages}) WHERE len(w) >= {n})"""


CHAT_SQL = rf"""
WITH RECURSIVE m AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text,
         ('0x' || substr(md5(coalesce(role, chr(0)) || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS mid FROM conversations
), raw AS (
  SELECT *, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m WHERE regexp_matches(text, '(?:^|
)[ 	]*>')
), leveled AS (
  SELECT *, length(regexp_replace(regexp_extract(raw, '^((?:[ 	]*>)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(raw, '^((?:[ 	]*>)+)[ 	]?', '') AS body FROM raw
), ahead AS (
  SELECT *, lead(level) OVER (PARTITION BY conv_id, turn, mid ORDER BY pos) AS next FROM leveled
), kept AS (
  SELECT *, lag(level) OVER (PARTITION BY conv_id, turn, mid ORDER BY pos) AS before FROM ahead
  WHERE NOT coalesce(regexp_matches(raw, '(?i)^{BLANK}*on [^
]+ wrote:{BLANK}*$') AND next > level, false)
), line AS (
  SELECT *, sum(CASE WHEN level <> before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn, mid ORDER BY pos) AS run FROM kept
), passage AS (
  SELECT conv_id, turn, role, mid, run, level, string_agg(body, chr(10) ORDER BY pos) AS said FROM line GROUP BY ALL
), unquoted AS (
  SELECT conv_id, turn, role, mid, string_agg(body, chr(10) ORDER BY pos) AS said FROM line WHERE level = 0 GROUP BY ALL
), quote AS (SELECT * FROM passage WHERE level > 0),
plain AS (SELECT * FROM m WHERE NOT regexp_matches(text, '(?:^|
)[ 	]*>')),
original AS (
  SELECT conv_id, turn, mid, text AS said FROM plain UNION ALL SELECT conv_id, turn, mid, said FROM unquoted
  UNION ALL SELECT conv_id, turn, mid, said FROM passage WHERE level = 0
), linkable AS (SELECT * FROM quote WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
source AS (SELECT * FROM original WHERE turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM linkable)),
asked AS ({keys_sql('linkable', 'conv_id, turn, mid, run, level')}),
said AS (SELECT DISTINCT conv_id, turn, mid, kind // 2 AS kind, key FROM ({keys_sql('source', 'conv_id, turn, mid')})),
found AS (
  SELECT a.*, o.turn AS up_turn, o.mid AS up_mid
  FROM (SELECT *, row_number() OVER () AS rn FROM asked) a JOIN said o ON o.conv_id = a.conv_id AND o.kind = a.kind // 2 AND o.key = a.key AND o.turn < a.turn
  QUALIFY row_number() OVER (PARTITION BY rn ORDER BY o.turn DESC, o.mid DESC) = 1
), vote AS (
  SELECT conv_id, turn, mid, run, level, up_turn, up_mid, greatest(coalesce(max(weight) FILTER (kind < 2), 0), coalesce(sum(weight) FILTER (kind = 2), 0)) AS evidence FROM found GROUP BY ALL
), best AS (
  SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY conv_id, turn, mid, run, level ORDER BY evidence DESC, up_turn DESC, up_mid) = 1
), counts AS (SELECT conv_id, turn, mid, count(*) AS n_linked FROM best GROUP BY ALL),
parent AS (
  SELECT * FROM best WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn, mid ORDER BY evidence DESC, up_turn DESC, up_mid) = 1
), climb AS (
  SELECT conv_id, turn, mid, up_turn, up_mid, 1 AS depth FROM parent
  UNION ALL SELECT c.conv_id, c.turn, c.mid, p.up_turn, p.up_mid, c.depth + 1 FROM climb c JOIN parent p ON p.conv_id = c.conv_id AND p.turn = c.up_turn AND p.mid = c.up_mid
), root AS (SELECT conv_id, turn, mid, max(depth) AS depth, arg_max(up_turn, depth) AS thread FROM climb GROUP BY ALL),
asks AS (SELECT conv_id, turn, mid, count(*) AS n_quotes FROM quote GROUP BY ALL),
clean AS (
  SELECT conv_id, turn, role, mid, text FROM plain UNION ALL
  SELECT m.conv_id, m.turn, m.role, m.mid, coalesce(u.said, '') FROM (SELECT DISTINCT conv_id, turn, role, mid FROM raw) m
  LEFT JOIN unquoted u ON u.conv_id IS NOT DISTINCT FROM m.conv_id AND u.turn IS NOT DISTINCT FROM m.turn AND u.mid = m.mid
)
SELECT c.conv_id, c.turn, c.role, coalesce(r.thread, c.turn) AS thread, p.up_turn AS parent_turn, coalesce(r.depth, 0) AS depth,
       coalesce(a.n_quotes, 0) AS n_quotes, coalesce(n.n_linked, 0) AS n_linked, md5(trim(c.text, ' ' || chr(9) || chr(10) || chr(13))) AS text_md5
FROM clean c
LEFT JOIN root r ON r.conv_id = c.conv_id AND r.turn = c.turn AND r.mid = c.mid
LEFT JOIN parent p ON p.conv_id = c.conv_id AND p.turn = c.turn AND p.mid = c.mid
LEFT JOIN asks a ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.turn IS NOT DISTINCT FROM c.turn AND a.mid = c.mid
LEFT JOIN counts n ON n.conv_id = c.conv_id AND n.turn = c.turn AND n.mid = c.mid
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": SHARDING_SQL, "op2_line_dedup": LINE_DEDUP_SQL, "op4_topk": TOPK_SQL, "op7_decontaminate": DECONTAMINATE_SQL,
        "op9_quotation_linking": CHAT_SQL, "op10_jaccard_join": JACCARD_SQL,
    }
