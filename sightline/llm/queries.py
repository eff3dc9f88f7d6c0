"""The registered query of each operator: the whole table in, the full result out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hardneg, jaccard, langid, linededup, mixing, pii, shuffle, sstable, topk, toxicity, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_shards(sstable.write_shards(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.Join(_table(spark, sf_dir, "documents"), width=3, percent=90).result().select("doc_id", "n_shingles", "component_id", "copies")


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.Join(_table(spark, sf_dir, "documents"), width=3, percent=90).links()


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle.shard_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents")).taken()


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op8_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_digest(_table(spark, sf_dir, "documents"))


def op10_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_summa_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings"), label)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end")


def op13_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_sstable, op2_jaccard_join, op2_jaccard_links, op3_language_id, op4_external_shuffle, op5_source_mixing, op6_pii_bootstrap, op7_warc_normaliser, op8_norm_bucket_topk, op9_line_dedup, op10_string_tiling, op11_summa_negatives, op12_prefix_trie, op13_noisy_channel_toxicity)
}

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned CRC-32 of an ASCII string: eight steps a byte, with the reflected polynomial.
CRC32_SQL = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"

#: Word sets of documents, the distinct ones (nodes) and their links.
LINKED_SQL = f"""worded AS (SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM worded),
        nodes AS MATERIALIZED (SELECT min(doc_id) AS node, count(*) AS copies, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
        tokens AS MATERIALIZED (SELECT node, n, unnest(s) AS t FROM nodes),
        links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.node <> b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*)))"""

#: DuckDB SQL for the rows of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE {LINKED_SQL},
        reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a)
        SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, coalesce(n.copies, 1) AS copies
        FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN roots r ON r.node = n.node""",
    "op2_jaccard_links": f"""
        WITH {LINKED_SQL},
        near AS (SELECT l.a AS node, sum(n.copies) AS near FROM links l JOIN nodes n ON n.node = l.b GROUP BY l.a)
        SELECT d.doc_id, CAST(coalesce(r.near, 0) + coalesce(n.copies, 1) - 1 AS BIGINT) AS links FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN near r ON r.node = n.node""",
    "op7_warc_normaliser": """
        WITH held AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM held)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM firsts""",
    "op8_norm_bucket_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op9_line_dedup": f"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
        keyed AS (SELECT *, {LOWER_SQL.format(f"trim(line, {BLANKS_SQL})")} AS k FROM lines),
        firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
        told AS (SELECT l.*, coalesce(f.first <> l.doc_id, false) AS gone FROM keyed l LEFT JOIN firsts f ON f.k = l.k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM told GROUP BY doc_id""",
    "op11_summa_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5),
        negatives AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
            FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3""",
    "op12_prefix_trie": f"""
        WITH t AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, '') AS role, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS th, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM conversations WHERE conv_id IS NOT NULL),
        o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, th) AS pos FROM t),
        ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM o),
        c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32_SQL.format("name")} % 9 AS h FROM ids),
        r AS (SELECT c.conv_id, pos, 0 AS own, th, size FROM c JOIN o ON o.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, pos, 1, th, size FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
        p AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS depth, string_agg(th, '') OVER w AS path, size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
        members AS MATERIALIZED (SELECT conv_id, depth, path, size FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM c),
        stops AS (SELECT conv_id, max(depth) AS depth FROM members GROUP BY conv_id),
        nodes AS MATERIALIZED (SELECT path, min(depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size, CASE WHEN min(depth) > 0 THEN left(path, 32 * (min(depth) - 1)) END AS up,
            sha256(coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id), '')) AS ends_sha256 FROM members m LEFT JOIN stops s USING (conv_id, depth) GROUP BY path),
        kids AS MATERIALIZED (SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
        below AS (SELECT left(n.path, 32 * a.k) AS path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
            FROM nodes n LEFT JOIN kids k ON k.path = n.path, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS k) a GROUP BY 1)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN below b ON b.path = n.path LEFT JOIN kids k ON k.path = n.path LEFT JOIN nodes u ON u.path = n.up""",
}
