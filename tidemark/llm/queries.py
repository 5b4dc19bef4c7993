"""Registered queries of this subpackage: thin digests of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (ann, bytecnn, chat, decontam, fim, jaccard, maxent, merkle, mix, pieces, secret_scan, urlfilter,
                          warc)
from tidemark.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op7_byte_cnn_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = bytecnn.train(docs, table(spark, sf_dir, "labels"), keep=~held_out("doc_id", 5, 0))
    s = bytecnn.score(docs, model)
    return s.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.document_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_low_discrepancy_mix")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query("op6_hashed_maxent_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.train_and_score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_minhash_containment", """
WITH w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x20\\x09-\\x0D]+') AS t
           FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents
                 UNION ALL SELECT 'i', item_id, text FROM benchmark)),
s AS (SELECT DISTINCT kind, id, array_to_string(t[k:least(k + 4, len(t))], ' ') AS g
      FROM (SELECT kind, id, t, unnest(range(1, greatest(len(t) - 3, 2))) AS k FROM w WHERE len(t) > 0)),
q AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
      FROM s d JOIN s i ON d.g = i.g WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, n AS item_shingles, shared, shared::DOUBLE / n AS containment
FROM m JOIN q ON item_id = id WHERE shared >= 0.75 * n
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_secret_forest")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train())


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]
SITES = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")


@query("op3_bloom_url_filter", """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                           ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|[.])(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)([.]|$)')
    THEN 'block' ELSE 'allow' END AS verdict FROM j
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.urls_of_sites(pages, SITES), RULES)


@query("op9_chat_template")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"),
                                                         "role", "text")
    return chat.parse(chat.format_chat(turns.unionByName(extra)))


@query("op8_warc_index", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS latest FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < latest THEN latest END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files, root = warc.archive(pages)
    asked = pages.select(warc.capture_key().alias("key"), "page_id")
    return warc.look_up(asked, files, root).drop("url")


@query("op1_kmeans_tree_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@query("op11_offset_pieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    enc = pieces.encode(table(spark, sf_dir, "documents"), path)
    return enc.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(pieces.decode(F.col("ids"), enc, path).cast("binary"), 256).alias("decoded_sha256"),
                      F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


@query("op12_slot_pivot_merkle", """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda crc, byte: list_reduce(
        list_prepend(xor(crc, byte), range(8)), lambda v, i:
          CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) % 5 = 0, false) AS changed
  FROM documents),
h AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        sha256(head || CASE WHEN text IS NULL THEN '-' WHEN changed THEN strlen(low) || ':' || low
                       ELSE strlen(text) || ':' || text END) AS start FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM h),
low_nodes(lvl, tree, place, node, n) AS (
  SELECT 0, tree, place, leaf, count(*) OVER (PARTITION BY tree) FROM p
  UNION ALL
  SELECT lvl + 1, tree, place // 16, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 15) // 16
  FROM low_nodes WHERE n > 1 GROUP BY lvl, tree, place // 16),
subroots AS (SELECT tree, node FROM low_nodes WHERE n = 1),
up_nodes(lvl, place, node, n) AS (
  SELECT 0, tree, node, count(*) OVER () FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (max(n) + 15) // 16
  FROM up_nodes WHERE n > 1 GROUP BY lvl, place // 16),
nodes AS (SELECT lvl, tree, place, node, n FROM low_nodes
          UNION ALL SELECT 1000 + lvl, -1, place, node, n FROM up_nodes),
sib AS (SELECT a.lvl, a.tree, a.place,
          coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
          coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
        FROM nodes a JOIN nodes b ON a.lvl = b.lvl AND a.tree = b.tree AND a.place // 16 = b.place // 16
        WHERE a.n > 1 GROUP BY ALL),
walk(doc_id, leaf, own, lvl, tree, place, acc, proof, top) AS (
  SELECT doc_id, leaf, tree, 0, tree, place, start, '', false FROM p
  UNION ALL
  SELECT w.doc_id, w.leaf, w.own, CASE WHEN s.lvl IS NULL THEN 1000 ELSE w.lvl + 1 END,
         CASE WHEN s.lvl IS NULL THEN -1 ELSE w.tree END, CASE WHEN s.lvl IS NULL THEN w.own ELSE w.place // 16 END,
         CASE WHEN s.lvl IS NULL THEN w.acc ELSE sha256(s.before || w.acc || s.after) END,
         w.proof || coalesce(s.before || s.after, ''), s.lvl IS NULL AND w.lvl >= 1000
  FROM walk w LEFT JOIN sib s ON s.lvl = w.lvl AND s.tree = w.tree AND s.place = w.place
  WHERE NOT w.top)
SELECT doc_id, leaf, (SELECT node FROM subroots WHERE tree = w.own) AS subroot,
       (SELECT node FROM up_nodes WHERE n = 1) AS root, sha256(proof) AS proof_sha256, acc AS folded_root,
       acc = (SELECT node FROM up_nodes WHERE n = 1) AS verified
FROM walk w WHERE top
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    back = m.withColumn("folded_root", merkle.folded(F.coalesce("other", "leaf"), F.col("path")))
    return back.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_frame_fill_in_middle", """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
             sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
               OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
v AS (SELECT *, substr(text, 1, least(a, b)) AS pre, substr(text, least(a, b) + 1, abs(a - b)) AS mid,
        substr(text, greatest(a, b) + 1) AS suf FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM v
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      fim.text_sha256(F.col("output")).alias("output_sha256"),
                      fim.text_sha256(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


query("pipeline")(corpus_pipeline.run)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
