"""From raw documents to token ids: five stages, each over all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return
the columns of documents, and pass others by, whatever their names.  A stage judges rows, never ids: rows may share an
id or have none.  run() writes each stage to the shared folder, reads it again as the next one's input, and
deletes what the stage needed on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import release, settle, stage
from pixelloom.llm.decontaminate import decontaminate
from pixelloom.llm.fm_toxicity import remainder
from pixelloom.llm.knn_quality import quality_scores
from pixelloom.llm.queries import MODEL
from pixelloom.llm.shingle_dedup import drop_near_copies
from pixelloom.llm.substring_dedup import substring_dedup
from pixelloom.llm.wfst import encode_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs under names that clash with nothing: doc_id and text stay, the others are numbered."""
    names = [c if c in ("doc_id", "text") else f"column{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours vote to be of quality; the others go."""
    plain, names = _plain(docs)
    scored = quality_scores(plain, _table(spark, sf_dir, "labels"), lambda doc: remainder(doc, 4) != 2)
    return scored.filter("predicted = 1").select(*names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that of the least id.

    Near copies share 0.8 or more of their five-word shingles (Jaccard); groups are what such pairs connect.  A row
    without an id stays only if no row of its group has one.
    """
    return drop_near_copies(docs, shingle=5)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of repeated windows of 20 words; n_chars follows the text."""
    plain, names = _plain(docs)
    out = substring_dedup(plain, window=20, layout=True, extra=[c for c in names if c not in ("doc_id", "text")])
    out = out.select(*[F.col("kept").alias("text") if c == "text" else F.col(c).cast(docs.schema["doc_id"].dataType) if c == "doc_id" else F.col(c) for c in names]).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; the others go.

    The text alone decides, so texts are searched under their hashes, and the hash of a text that is hit leads back to
    the rows that have it.  These rows, few as they are, are searched again under another hash: a row goes if both are hit, so
    that no clean text goes for the sake of one hash that it shares.
    """
    one, two = F.xxhash64("text"), F.xxhash64(F.lit("again"), "text")
    items = _table(spark, sf_dir, "benchmark")

    def hit(texts: DataFrame, name: str) -> DataFrame:
        """Keys of the texts (key, text) that are hit."""
        return decontaminate(texts, items, size=10, id_col="key").filter("contaminated").select(F.col("key").alias(name)).distinct()

    first = stage(hit(docs.select(one.alias("key"), "text"), "one"), "hit")
    again = stage(docs.select(one.alias("one"), two.alias("key"), "text").join(first, "one", "left_semi"), "again")
    bad = again.select("one", F.col("key").alias("two")).distinct().join(hit(again.select("key", "text"), "two"), "two")
    plain, names = _plain(docs)
    return plain.join(bad, (one == F.col("one")) & (two == F.col("two")), "left_anti").select(*names).toDF(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256, exact) of every document."""
    return encode_documents(docs, MODEL)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("span_dedup", span_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: The stages learn a classifier and run a tokenizer, which SQL can't state; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = _table(spark, sf_dir, "documents")
    for name, function in STAGES:
        following = settle(spark, lambda: function(spark, docs, sf_dir), name)  # noqa: B023
        if docs is not given:
            release(docs)
        docs = following
    return docs
