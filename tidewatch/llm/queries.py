"""The registered queries of this package: each operator over its whole table, and its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, cover_tree, exact_dedup, fuzzy_lines, lsh_forest, mixing, periodic_runs, positional_index, secrets, sharding, token_lengths, toxicity, turn_repair
from tidewatch.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_groups(table(spark, sf_dir, "documents")).drop("text_sha256")


def op3_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_lengths.with_sums(token_lengths.lengths(table(spark, sf_dir, "documents"), RANKS, PATTERN))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = [F.size(F.filter(F.transform("base", lambda x: x["kind"]), lambda k: k == F.lit(secrets.KINDS.index(kind)))).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def op5_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def sharding_sql(limit: int, bits: int = 40) -> str:
    """Every prefix of every document's hash, the shortest that fits; enough bits for tables without oversized groups of repeats."""
    return f"""
WITH docs AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
strings AS (SELECT *, lpad(bin(h), {sharding.WORD_BITS}, '0') AS b FROM docs),
buckets AS (SELECT doc_id, n_bytes, b[1:d] AS shard, d, sum(n_bytes) OVER same AS shard_bytes, count(*) OVER same AS shard_docs
            FROM strings, range(0, {bits}) AS r(d) WINDOW same AS (PARTITION BY d, b[1:d]))
SELECT doc_id, n_bytes, shard, shard_bytes::BIGINT AS shard_bytes, shard_docs FROM buckets WHERE shard_bytes <= {limit} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1
"""


OP5_SQL = sharding_sql(sharding.LIMIT_BYTES)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op7_sql() -> str:
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)
    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS w,
                   ({mixing.MAX_COPIES} * source_size)::DOUBLE AS ceiling FROM sizes),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER before, 0)) / sum(w) OVER (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
           FROM weighed WINDOW before AS (ORDER BY ceiling / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT level FROM levels WHERE level * w <= ceiling ORDER BY ceiling / w, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(ceiling, (SELECT level FROM common) * w), ceiling) AS target FROM levels),
expected AS (SELECT d.*, t.source_size, t.target, least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END, {mixing.MAX_COPIES}) AS e
             FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, floor(e)::BIGINT AS copies,
                  CASE WHEN size > 0 AND e < {mixing.MAX_COPIES} AND e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) ELSE 'infinity'::DOUBLE END AS rank
           FROM expected),
gap0 AS (SELECT source, max(target) - sum(copies * size) AS gap FROM ranked GROUP BY source),
passes AS (
  SELECT 1 AS pass, source, doc_id, rank, size, gap, sum(size) OVER (PARTITION BY source ORDER BY rank) AS through
  FROM (SELECT r.*, gap FROM ranked r JOIN gap0 g ON r.source IS NOT DISTINCT FROM g.source WHERE size <= gap AND rank < 'infinity'::DOUBLE)
  UNION ALL
  SELECT pass + 1, source, doc_id, rank, size, gap, sum(size) OVER (PARTITION BY source ORDER BY rank)
  FROM (SELECT * REPLACE (gap - words AS gap) FROM (SELECT *, max(CASE WHEN through <= gap THEN through END) OVER (PARTITION BY source) AS words FROM passes)
        WHERE through > gap AND words IS NOT NULL AND size <= gap - words)),
took AS (SELECT doc_id FROM passes WHERE through <= gap)
SELECT doc_id, size, source_size, target, ((copies + (doc_id IN (SELECT doc_id FROM took))::BIGINT) * size)::BIGINT AS taken FROM ranked
"""


OP7_SQL = _op7_sql()


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, PATTERN).drop("text")
    back = byte_bpe.decode(encoded, RANKS, PATTERN)
    return back.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_groups(table(spark, sf_dir, "documents"))


def held_out(id_col: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with a fault in one of four rows, decided by crc32 of `conv_id:turn`: dropped, emptied, without full stops, repeated, or said by the user."""
    h = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(h == 4, "user").otherwise(F.col("role"))
    rows = turns.where(h != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turn_repair.repair(damaged(turns), turns)


def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "near_items")


def _op12_sql() -> str:
    words = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{positional_index.WORD}')"
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
items AS MATERIALIZED (SELECT *, least({positional_index.WINDOW}, len(w)) AS span FROM (SELECT row_number() OVER () AS i, coalesce(item_id::VARCHAR, '') AS item_id, {words('text')} AS w FROM benchmark) WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT i, item_id, span, s, array_to_string(w[s + 1:s + span], ' ') AS phrase FROM items, range(0, len(w) - span + 1) AS t(s)),
phrases AS (SELECT DISTINCT item_id, span, phrase FROM windows),
places AS (SELECT r, span, s, array_to_string(w[s + 1:s + span], ' ') AS phrase FROM docs, (SELECT DISTINCT span FROM phrases), range(0, len(w) - span + 1) AS t(s)),
hits AS MATERIALIZED (SELECT r, s, span, item_id FROM places JOIN phrases USING (span, phrase)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, range(s, s + span) AS t(p) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r),
terms AS MATERIALIZED (SELECT r, p, w[p + 1] AS term FROM docs, range(0, len(w)) AS t(p)),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
ranked AS (SELECT i, item_id, s, span, array_agg({{'df': df, 'p': p, 'term': term}} ORDER BY df, p) AS by_rarity
           FROM (SELECT i, item_id, s, span, p, w[p + 1] AS term FROM windows JOIN items USING (i, item_id, span), range(s, s + span) AS t(p)) JOIN dfs USING (term) GROUP BY ALL HAVING count(*) = span),
pairs AS (SELECT DISTINCT item_id, by_rarity[1].term AS a, by_rarity[least(2, span)].term AS b FROM ranked),
near AS (SELECT x.r, count(DISTINCT item_id) AS near_items FROM pairs JOIN terms x ON x.term = a JOIN terms y ON y.term = b AND y.r = x.r AND abs(x.p - y.p) <= {positional_index.REACH} GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, coalesce(near_items, 0) AS near_items
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r) LEFT JOIN near USING (r)
"""


OP12_SQL = _op12_sql()


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where one document of ten, by crc32 of its id, repeats a stretch of its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    placed = parts.select("*", F.when(n > 0, a).alias("a")).select("*", F.when(n > 0, F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("int")).alias("p"))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    periodic = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", at(i))), " ")
    return placed.select("doc_id", F.when(F.col("p").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapsed(with_periods(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = found.select("*", F.when(F.size("runs") > 0, periodic_runs.longest(F.col("runs"))).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", F.col("kept_sha256").alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_cover_tree": op1_cover_tree,
    "op2_lsh_forest_join": op2_lsh_forest_join,
    "op3_token_lengths": op3_token_lengths,
    "op4_secret_scan": op4_secret_scan,
    "op5_extendible_hashing": op5_extendible_hashing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pareto_mixing": op7_pareto_mixing,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_fuzzy_lines": op9_fuzzy_lines,
    "op10_toxicity": op10_toxicity,
    "op11_turn_repair": op11_turn_repair,
    "op12_positional_index": op12_positional_index,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op5_extendible_hashing": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op7_pareto_mixing": OP7_SQL, "op12_positional_index": OP12_SQL}
