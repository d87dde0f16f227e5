"""The registered queries of this package and, where SQL can say it, the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .decontaminate import decontaminate
from .embed_dedup import embedding_groups
from .fm_toxicity import remainder, toxicity_scores
from .hilbert import hilbert_shards
from .hilbert import oracle as shards_oracle
from .knn_quality import quality_scores
from .license_scan import license_scan
from .license_scan import oracle as license_oracle
from .segment_bpe import bpe_encode
from .simhash import hex_fingerprint, simhash_groups
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_alignment import token_alignment
from .wfst import encode_documents

#: A public SentencePiece model; operators take its path as a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Public tokenizer files: byte-level BPE, and BPE with word ends.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
WORD_BPE = "/opt/tokenizers/word_bpe_49k.json"
#: Words within which all words of a benchmark window stand in a proximity match.
NEAR = 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents"), window=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), lambda doc: remainder(doc, 3) != 1)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op4_wfst_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), MODEL)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), lambda doc: remainder(doc, 4) != 2)
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(_table(spark, sf_dir, "documents"), shards=8)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10, proximity=NEAR)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated", "n_near")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(_table(spark, sf_dir, "documents"), BYTE_BPE, MODEL)


def op12_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"), WORD_BPE).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), least=30, longest=4, top=2000)


OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(20)) AS k)
), each AS (
  SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), kept AS (
  SELECT e.doc_id, string_agg(e.x, ' ' ORDER BY e.i) AS s FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM words w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), c AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
edges AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM later),
runs AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM edges),
spans AS (SELECT doc_id, g, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY 1, 2),
marks AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
pieces AS (SELECT doc_id, before AS a, lo AS b FROM marks UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM pieces p JOIN d USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n.removed, 0)::BIGINT AS n_removed, coalesce(n.spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM found) GROUP BY 1
), sets AS (
  SELECT row_number() OVER () AS k, words, items FROM (SELECT words, list(DISTINCT item_id) AS items FROM (SELECT item_id, list_sort(list_distinct(string_split(s, ' '))) AS words FROM bw) GROUP BY 1)
), places AS (
  SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), counts AS (SELECT x, count(*) AS c FROM places GROUP BY 1), members AS (
  SELECT k, m.x, coalesce(c, 0) AS c, row_number() OVER (PARTITION BY k ORDER BY coalesce(c, 0), m.x) AS r FROM (SELECT k, unnest(words) AS x FROM sets) m LEFT JOIN counts ON counts.x = m.x
), heads AS (
  SELECT p.doc_id, p.i, a.k, b.x AS second FROM members a JOIN places p ON p.x = a.x AND a.r = 1 LEFT JOIN members b ON b.k = a.k AND b.r = 2
), around AS (
  SELECT h.doc_id, h.i, h.k, w[greatest(h.i - {NEAR - 1}, 1):h.i + {NEAR - 1}] AS v FROM heads h JOIN d ON d.doc_id = h.doc_id
  WHERE second IS NULL OR list_contains(w[greatest(h.i - {NEAR - 1}, 1):h.i + {NEAR - 1}], second)
), near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT doc_id, unnest(items) AS item FROM around a JOIN sets ON sets.k = a.k
    WHERE list_has_all(v, words) AND len(list_filter(range(1, len(v) + 1), lambda j: list_has_all(v[j:j + {NEAR - 1}], words))) > 0) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN near ON near.doc_id = d.doc_id
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS p
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY 1
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS front, array_to_string(w[cut + 1:], ' ') AS back FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)
), scored AS (
  SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, 2000000::HUGEINT * u.a // (l.f::HUGEINT + r.f) AS score
  FROM cuts u JOIN f l ON l.lang = u.lang AND l.phrase = u.front JOIN f r ON r.lang = u.lang AND r.phrase = u.back
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), around AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM c WHERE k > 2)) GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_fm_toxicity, op3_license_scan, op4_wfst_sentencepiece, op5_embedding_dedup, op6_knn_quality, op7_simhash, op8_suffix_dedup, op9_hilbert_shards, op10_decontaminate, op11_token_alignment, op12_segment_bpe, op13_collocations)}
ORACLES = {"op1_substring_dedup": OP1_SQL, "op3_license_scan": license_oracle(), "op5_embedding_dedup": OP5_SQL, "op8_suffix_dedup": OP8_SQL, "op9_hilbert_shards": shards_oracle(), "op10_decontaminate": OP10_SQL, "op13_collocations": OP13_SQL}
