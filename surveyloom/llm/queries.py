"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm.ann import nearest_neighbours
from surveyloom.llm.conversation_repair import conversation_audits, repair_conversations, repaired_digests
from surveyloom.llm.mixing import DIGITS, WEIGHTS, mix_sources
from surveyloom.llm.near_dedup import near_dedup
from surveyloom.llm.packing import pack_documents
from surveyloom.llm.periodic_runs import periodic_runs
from surveyloom.llm.quality import score_quality
from surveyloom.llm.substring_dedup import substring_dedup
from surveyloom.llm.suffix_dedup import suffix_dedup
from surveyloom.llm.token_files import read_token_files, write_token_files
from surveyloom.llm.topk import top_products
from surveyloom.llm.toxicity import score_toxicity
from surveyloom.llm.url_filter import judge_urls
from surveyloom.llm.url_filter import oracle as url_oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def made_periodic(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by a hash of doc_id, repeats a part of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))).alias("words"))
    parts = parts.select("*", F.size("words").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    parts = parts.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    order = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int"))
    repeated = F.array_join(F.transform(order, lambda i: F.get("words", i)), " ")
    return parts.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(made_periodic(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path())
    return read_token_files(spark, folder).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns of which some are dropped, emptied, unended, repeated or given to the user, by a hash of their key; nulls are one space."""
    shown = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    segments = repair_conversations(damaged(conversations))
    found = conversation_audits(segments).withColumnRenamed("conv_id", "c").join(repaired_digests(segments).withColumnRenamed("conv_id", "d"), F.col("c").eqNullSafe(F.col("d")))
    out = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_source_mixing": op6_source_mixing,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_top_products": op9_top_products,
    "op10_near_dedup": op10_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_files": op12_token_files,
    "op13_conversation_repair": op13_conversation_repair,
}

_OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS p FROM w)
),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + o AS i FROM rep, generate_series(0, 19) t(o)),
kept AS (
  SELECT v.doc_id, count(*) AS n_kept, string_agg(v.word, ' ' ORDER BY v.i) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w) v
  ANTI JOIN gone g ON v.doc_id = g.doc_id AND v.i = g.i GROUP BY v.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS INTEGER) AS b
  FROM documents
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight, source_size * 2 AS cap
  FROM s
),
l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) * 150 AS DOUBLE) / 100 - CAST(coalesce(sum(cap) OVER w, 0) AS DOUBLE))
            / CAST((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM r WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
water AS (SELECT min_by(level, CAST(cap AS DOUBLE) / weight) AS level FROM l WHERE level * weight <= cap),
t AS (
  SELECT source, source_size, least(coalesce((SELECT level FROM water) * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM r
),
k AS (
  SELECT b.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         coalesce(sum(bucket_size) OVER (PARTITION BY b.source ORDER BY b.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, b, CAST(sum(size) AS BIGINT) AS bucket_size FROM d GROUP BY source, b) b JOIN t ON b.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, d.size, k.source_size, k.target,
       least(CAST(whole AS BIGINT) * size + CAST(floor(size * CASE WHEN bucket_size > 0 THEN least(greatest((target - CAST(whole AS BIGINT) * source_size - CAST(before AS BIGINT)) / bucket_size, 0.0), 1.0) ELSE 0 END) AS BIGINT), size * 2) AS taken
FROM d JOIN k ON d.b = k.b AND d.source IS NOT DISTINCT FROM k.source
"""

_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS p FROM w WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

def _crc32(s: str) -> str:
    """SQL for the unsigned crc32 of a string of ASCII letters, which DuckDB lacks: bit by bit."""
    letters = f"list_transform(range(strlen({s})), lambda i: CAST(ascii(substr({s}, CAST(i AS INTEGER) + 1, 1)) AS BIGINT))"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {letters}), lambda c, b: {bits}), 4294967295)"


_OP11 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents
),
p AS (SELECT *, len(ws) AS n, h // 10 % greatest(len(ws), 1) AS a, h // 10 AS g FROM d),
w AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM p
),
-- words q apart agree over at least six words in a row, so six words in a row occur q apart
grams AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 6], ' ') AS six FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM w)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.six = y.six AND x.i < y.i),
stretch AS (
  SELECT doc_id, q, min(i) AS start, max(i) + 6 + q - min(i) AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k
),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY ALL),
best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS b,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT v.doc_id, string_agg(v.word, ' ' ORDER BY v.i) AS collapsed
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM w) v ANTI JOIN gone g ON v.doc_id = g.doc_id AND v.i = g.i GROUP BY v.doc_id
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period,
       CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

# forward over the turns of each conversation: for each state the least (cost, audit, repaired text)
_FAR = "{'c': 1000000, 'a': '', 't': ''}"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: str, cost: str, edit: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}}"


def _turn_sql(to: int, turn: str = "w") -> str:
    """Least way into a state over one turn, without inserts."""
    before = {0: (), 1: (("s", 0),), 2: (("u", 0), ("u", 1), ("u", 3)), 3: (("a", 2),)}[to]
    ways = [_way(f"r.q{to}", "4", "D", "''")]
    for initial, state in before:
        line, new = f"chr(10) || {turn}.role || ':' || {turn}.text", {"u": "user", "a": "assistant", "s": ""}[initial]
        ways.append(f"CASE WHEN {turn}.free AND left({turn}.role, 1) = '{initial}' THEN {_way(f'r.q{state}', f'{turn}.extra', 'K', line)} ELSE {_FAR} END")
        if new:
            ways.append(f"CASE WHEN {turn}.free THEN {_way(f'r.q{state}', f'{turn}.extra + 3', 'R', f'chr(10) || {chr(39)}{new}:{chr(39)} || {turn}.text')} ELSE {_FAR} END")
    return _least(*ways)


def _inserted(q: str) -> str:
    """All four states after at most two inserts."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    once = f"SELECT * REPLACE ({_least('q2', *(_way(f'q{k}', '3', 'I', user) for k in (0, 1, 3)))} AS q2, {_least('q3', _way('q2', '3', 'I', assistant))} AS q3) FROM ({q})"
    return f"SELECT * REPLACE ({_least('q2', *(_way(f'q{k}', '3', 'I', user) for k in (0, 1, 3)))} AS q2, {_least('q3', _way('q2', '3', 'I', assistant))} AS q3) FROM ({once})"


_OP13 = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations
),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM o WHERE kind <> 0
),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS k, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS shown,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n
),
w AS (
  SELECT conv_id, turn, role, text, i, shown = '' AS blank, shown <> '' AND k > 1 AS duplicate, shown <> '' AND k = 1 AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated,
         shown <> '' AND k = 1 AS free, CASE WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra, before || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM f
),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n FROM w GROUP BY conv_id
),
r AS (
  SELECT conv_id, i, q0, q1, q2, q3 FROM ({_inserted(f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': ''}} AS q0, {_FAR} AS q1, {_FAR} AS q2, {_FAR} AS q3 FROM c")})
  UNION ALL
  SELECT conv_id, i, q0, q1, q2, q3 FROM ({_inserted(f"SELECT r.conv_id, w.i, {', '.join(f'{_turn_sql(k)} AS q{k}' for k in range(4))} FROM r JOIN w ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND w.i = r.i + 1")})
),
e AS (SELECT c.*, {_least("q0", "q3")} AS best FROM r JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.n)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN e ON x.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op4_url_filter": url_oracle(), "op6_source_mixing": _OP6, "op9_top_products": _OP9, "op10_near_dedup": _OP10, "op11_periodic_runs": _OP11, "op13_conversation_repair": _OP13}
