"""The queries op1 to op13 and their SQL; thin: rows come from the operators, digest columns are derived here."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fim, html_text, langid, lm, lz, quality, sharding, simhash, substrings, trie, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 39 of near-equal bytes, by ranges of the texts' hashes."""
    text = F.coalesce("text", F.lit(""))
    rows = _docs(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = sharding.shard(rows, 40, key=F.col("text_hash"), size=F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards the good labels keeps."""
    return quality.resample(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of documents that repeat what stands elsewhere, and where it stays."""
    out = substrings.repeated_spans(_docs(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.col("first_id").alias("first_doc_id"), "begin", "end", "n_chunks", "n_words")


def op4_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's phrase fingerprint against its edited text's and its neighbour's."""
    return lz.compare_neighbours(_docs(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in 4 bits at most."""
    out = simhash.near_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, and the way back."""
    out = bpe.encode(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    out = warc.derive(warc.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), keep=["page_id", "url"])
    return out.select("page_id", "url", "record_type", "record_id", "refers_to", "concurrent_to", "source_payload_digest", "digest_ok", "block_digest", "content_length", F.sha2("record", 256).alias("record_sha256"))


def op8_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, and which."""
    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole document."""
    return lm.score(_docs(spark, sf_dir))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as prefix, suffix and middle, or plain, and the way back."""
    out = fim.transform(_docs(spark, sf_dir), keep=["doc_id"])
    back = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return trie.rebuilt_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of them."""
    out = langid.identify(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_splitters": op1_splitters,
    "op2_resampling": op2_resampling,
    "op3_chunks": op3_chunks,
    "op4_lempel_ziv": op4_lempel_ziv,
    "op5_simhash": op5_simhash,
    "op6_html": op6_html,
    "op7_bpe": op7_bpe,
    "op8_latent": op8_latent,
    "op9_gru": op9_gru,
    "op10_warc": op10_warc,
    "op11_fim": op11_fim,
    "op12_trie": op12_trie,
    "op13_pieces": op13_pieces,
}

#: crc32 of the decimal c, bit by bit.
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"

ORACLES: dict[str, str] = {
    "op11_fim": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
      h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
      c AS (SELECT *, least(h1 % (n+1), h2 % (n+1)) AS a, greatest(h1 % (n+1), h2 % (n+1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
      p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:], '') AS suf FROM c)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_trie": f"""WITH r AS (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
      t AS (SELECT c, bytes, k, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS i FROM r),
      o AS (SELECT c, count(*) AS own, {_CRC} % 9 AS h, c - c % 5 AS base FROM t GROUP BY c),
      b AS (SELECT o.*, least(o.h, coalesce(p.own, 0)) AS taken FROM o LEFT JOIN o p ON o.base = p.c),
      x AS (SELECT b.c, i, k, bytes FROM b JOIN t ON t.c = b.base AND i < h UNION ALL SELECT b.c, taken + i - h, k, bytes FROM b JOIN t ON t.c = b.c AND i >= h),
      m AS (SELECT c, i + 1 AS d, bytes, array_to_string(list(k) OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING), ',') AS k FROM x UNION ALL SELECT c, 0, 0, '' FROM o),
      n AS (SELECT *, min(c) OVER w AS rep, count(*) OVER w AS n, max(d) OVER (PARTITION BY c) AS l FROM m WINDOW w AS (PARTITION BY d, k)),
      u AS (SELECT a.rep, a.d, a.n, (a.n - 1) * a.bytes AS saved, p.rep AS parent FROM n a LEFT JOIN n p ON a.c = p.c AND a.d = p.d + 1 WHERE a.c = a.rep),
      v AS (SELECT u.*, (SELECT count(*) FROM u w WHERE w.parent = u.rep AND w.d = u.d + 1) AS n_children FROM u),
      s AS (SELECT n.rep, n.d, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM v JOIN n ON n.c = v.rep AND n.d <= v.d GROUP BY 1, 2),
      e AS (SELECT rep, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM n WHERE d = l GROUP BY 1, 2)
      SELECT v.rep AS conv_id, CAST(v.d AS BIGINT) AS depth, parent AS parent_conv_id, v.n AS n_convs, n_children, leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM v JOIN s USING (rep, d) LEFT JOIN e USING (rep, d)""",
}
