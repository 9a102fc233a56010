"""The registered queries of this subpackage: thin callers of its operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, packing, quality_model, quality_rules, sharding
from .exact_dedup import exact_dedup
from .language_id import language_id
from .line_dedup import line_dedup
from .simhash import simhash_dedup
from .url_filter import judge_urls

SHARDS = 8
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), sharding.Tree.of(SHARDS))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, ranks)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), checksums=True)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_simhash_dedup, op4_url_filter, op5_sharding, op6_language_id, op7_byte_bpe, op8_exact_dedup, op9_quality_rules, op10_packing)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WS = r"[\x20\x09-\x0D]+"


def _crc_table() -> list[int]:
    """Of CRC-32, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = 0xEDB88320 ^ c >> 1 if c & 1 else c >> 1
        out.append(c)
    return out


def _sharding_sql(tree: sharding.Tree, key: str) -> str:
    """The shard, as one expression."""

    def unit(name: str) -> str:
        return f"((('0x' || substr(md5({key} || '@{name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"

    def descend(children: list[tuple[str, float, str]]) -> str:
        if len(children) == 1:
            return children[0][2]
        draws = ", ".join(f"-ln({unit(n)}) / {w}" for n, w, _ in children)
        cases = " ".join(f"WHEN {i} THEN {below}" for i, (_, _, below) in enumerate(children))
        return f"(CASE list_position([{draws}], list_min([{draws}])) - 1 {cases} END)"

    def rack(name, shards):
        return descend([(f"{name}/{s}", w, str(s)) for s, w in shards.items()])

    def region(name, racks):
        return descend([(f"{name}/{i}", sum(r.values()), rack(f"{name}/{i}", r)) for i, r in enumerate(racks)])

    return descend([(str(i), sum(sum(r.values()) for r in racks), region(str(i), racks)) for i, racks in enumerate(tree.regions)])


_TREE = sharding.Tree.of(SHARDS)
_KEY = "coalesce(doc_id::VARCHAR, '')"

ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^{_WS}|{_WS}$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= 5),
j AS (SELECT k.*, c.key IS NULL OR k.doc_id IS NOT DISTINCT FROM c.keeper AS stays FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY r, doc_id""",
    "op4_url_filter": f"""
WITH rules(host, path, action) AS (VALUES {', '.join(map(str, URL_RULES))}),
r AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT r, arg_max(u.host || u.path, length(u.host || u.path)) AS rule, arg_max(action, length(u.host || u.path)) AS action
      FROM p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (r)""",
    "op5_sharding": f"""
WITH t AS (SELECT {_crc_table()} AS crc),
d AS (SELECT doc_id, {_KEY} AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, key, length(h) // 2 + 1 AS size, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT) AS bytes FROM d),
s AS (SELECT doc_id, key, size,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255)::BIGINT + 1]::UBIGINT)), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  {_sharding_sql(_TREE, 'key')} AS shard, {_sharding_sql(_TREE.grown(), 'key')} AS grown_shard FROM b, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key), doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, list_filter(string_split_regex(t, '{_WS}'), lambda x: x <> '') AS w FROM d),
g AS (SELECT r, i, w[i : i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
k AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(5, coalesce(j - i, 5))) AS n_repeat_words FROM k GROUP BY r),
f AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '[\\x20\\x09-\\x0D]*')) AS f FROM d),
m AS (SELECT doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(f) - len(list_distinct(f)) AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w JOIN f USING (r) LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
j AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_words OR NOT word_chars / greatest(n_words, 1) BETWEEN 2 AND 15 AS fails FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (fails)::DOUBLE AS failed FROM j GROUP BY host),
s AS (SELECT sum(n) AS n, sum(failed) / sum(n) AS mean, sum(failed * failed / n) / sum(n) AS square, count(*) AS hosts, sum(n * n) AS n2 FROM h),
v AS (SELECT *, (square - mean * mean - mean * (1 - mean) * (hosts - 1) / n) / (1 - n2 / n / n) AS between_hosts FROM s),
a AS (SELECT mean, CASE WHEN hosts > 1 AND mean > 0 AND mean < 1 THEN CASE WHEN between_hosts > 0 THEN greatest(2.0, mean * (1 - mean) / between_hosts - 1) ELSE n END ELSE 2.0 END AS strength FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN host <> '' THEN substr(host, 2) END AS host,
       round((failed + strength * mean) / (n + strength), 6) AS host_rate, NOT base_failed AND (failed + strength * mean) / (n + strength) <= 0.5 AS kept
FROM j JOIN h USING (host), a""",
}
