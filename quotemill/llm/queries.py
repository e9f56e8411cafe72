"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, fingerprints, language_id, merkle, mixing, near_dedup, quality, runs, sharding, suffix_dedup, token_files, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), added=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = toxicity.train(docs.filter(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = language_id.train(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(documents(spark, sf_dir))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(documents(spark, sf_dir))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(documents(spark, sf_dir), runs.planted)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = quality.train(docs.filter(~held_out), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


ORACLE_SQL = {
    "op9_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        g AS (
          SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    # crc32 bit by bit; the trees level by level; each leaf's path as pairs of digests left and right of it.
    "op11_merkle": r"""
        WITH RECURSIVE crc AS (
          SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                 lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS h
          FROM documents),
        shown AS (
          SELECT *, CASE WHEN h % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claim,
                 coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                 || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
          FROM crc),
        leaves AS (
          SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 sha256(head || coalesce(strlen(claim) || ':' || claim, '-')) AS claimed
          FROM shown),
        placed AS (
          SELECT *, row_number() OVER (ORDER BY lang, doc_id, leaf) AS rid, count(*) OVER (PARTITION BY lang) AS n,
                 row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
          FROM leaves),
        tree(lang, lvl, idx, digest, n) AS (
          SELECT lang, 0, idx, leaf, n FROM placed
          UNION ALL
          SELECT lang, lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY lang, lvl, idx // 8, n),
        subroots AS (
          SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
        top(lvl, idx, digest, n) AS (
          SELECT 0, idx, subroot, n FROM subroots
          UNION ALL
          SELECT lvl + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, idx // 8, n),
        steps AS (
          SELECT p.rid, t.lvl AS ord, coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < p.idx >> (3 * t.lvl)), '') AS l,
                 coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > p.idx >> (3 * t.lvl)), '') AS r
          FROM placed p JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.idx >> 3 = p.idx >> (3 * t.lvl + 3)
          GROUP BY p.rid, t.lvl
          UNION ALL
          SELECT p.rid, 1000 + t.lvl, coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < s.idx >> (3 * t.lvl)), ''),
                 coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > s.idx >> (3 * t.lvl)), '')
          FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top t ON t.n > 1 AND t.idx >> 3 = s.idx >> (3 * t.lvl + 3)
          GROUP BY p.rid, t.lvl),
        paths AS (
          SELECT p.rid, sha256(coalesce(string_agg(l || r, '' ORDER BY ord), '')) AS proof_sha256, coalesce(list({'l': l, 'r': r} ORDER BY ord) FILTER (l IS NOT NULL), []) AS path
          FROM placed p LEFT JOIN steps s ON s.rid = p.rid GROUP BY p.rid),
        folded AS (
          SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM top WHERE n = 1) AS root, h.proof_sha256,
                 list_reduce(list_concat([{'l': p.claimed, 'r': ''}], h.path), lambda a, b: {'l': sha256(b.l || a.l || b.r), 'r': ''}).l AS folded_root
          FROM placed p JOIN paths h ON h.rid = p.rid JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang)
        SELECT *, folded_root = root AS verified FROM folded
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
