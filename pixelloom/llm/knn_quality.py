"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed words, word shapes, pairs of neighbouring shapes, and marks for repeated words.  A document's vector is
its log term frequency times the inverse document frequency over all documents, projected on the leading singular
vectors of the labelled sample; words count half as much as shapes, so that what a text is about ranks after how it is
written.  The labelled vectors are broadcast (their number is a parameter); every document is compared
to all of them by blocked cosine products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACED, batches, mix, text_buffer, word_codes, word_spans

#: Byte classes of a word's shape: lower case, upper case, digit and non-ASCII letter are one code each, all else is itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CODE = np.random.default_rng(5).integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shape_terms(data: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count): the distinct terms of each text.

    A shape is a word's byte classes with runs cut to one.  Terms 0 to 15 mark a word that equals the one before, by its
    length; the others of the lower half are hashed shapes and pairs of shapes, the upper half hashed words.
    """
    s, e, docs = word_spans(data, offsets, SPACED)
    if not len(s):
        none = np.zeros(0, np.int64)
        return none, none, none
    # Shape: the sum of codes at run starts, each weighted by its order in the word.
    cls = _CLASS[data]
    run = np.ones(len(cls), bool)
    run[1:] = cls[1:] != cls[:-1]
    run[s] = True
    place = np.cumsum(run)
    value = np.where(run, _CODE[cls], np.uint64(0))
    order = place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = place[s].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # Codes times (own order - order of the word's first run + 1), summed over the word: order matters, place does not.
    total = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    moment = np.concatenate([[np.uint64(0)], np.cumsum(value * order)])
    plain = total[e] - total[s]
    shape = mix((moment[e] - moment[s]) - first * plain + plain)
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    length = e - s
    code = word_codes(LOWER[data], s, e)
    again = pair[code[pair] == code[pair + 1]]
    half = dims // 2
    room = np.uint64(half - 16)
    one = (shape % room).astype(np.int64) + 16
    two = (mix(shape[pair] * np.uint64(3) + shape[pair + 1]) % room).astype(np.int64) + 16
    marks = np.minimum(length[again], 15)
    words = (code % np.uint64(dims - half)).astype(np.int64) + half
    key = np.concatenate([doc * dims + one, doc[pair] * dims + two, doc[again] * dims + marks, doc * dims + words])
    key, count = np.unique(key, return_counts=True)
    return key // dims, key % dims, count


def weights(dims: int, words: float = 0.5) -> np.ndarray:
    """Factor of each term's inverse document frequency."""
    return np.where(np.arange(dims) < dims // 2, 1.0, words)


@dataclass
class Space:
    """What is broadcast: inverse document frequencies, projection, and the labelled vectors with their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def project(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, term, count = shape_terms(data, offsets, len(self.idf))
        weight = ((1 + np.log(count)) * self.idf[term]).astype(np.float32)
        out = np.zeros((len(offsets) - 1, self.axes.shape[1]))
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        for lo in range(0, len(cuts), 256):
            hi = min(lo + 256, len(cuts))
            a, b = cuts[lo], cuts[hi] if hi < len(cuts) else len(doc)
            out[doc[cuts[lo:hi]]] = np.add.reduceat(self.axes[term[a:b]] * weight[a:b, None], cuts[lo:hi] - a, axis=0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The vote of the nearest labelled vectors, weighted by the fourth power of their cosine; the prior where nothing is similar.

        All vectors that tie with the last of the nearest vote too, so no order among equals decides.
        """
        out = np.empty(len(x))
        k = min(self.neighbours, len(self.labels))
        for lo in range(0, len(x), 512):
            cosine = x[lo : lo + 512] @ self.vectors.T
            least = np.partition(cosine, -k, axis=1)[:, [-k]]
            weight = np.where(cosine >= least - 1e-12, np.maximum(cosine, 0), 0) ** 4
            total = weight.sum(axis=1)
            vote = weight @ self.labels
            smooth = 1e-3
            out[lo : lo + 512] = (vote + smooth * self.prior) / (total + smooth)
        return out


def _singular_axes(rows: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration."""
    rank = min(rank, *rows.shape)
    q = np.random.default_rng(11).standard_normal((rows.shape[1], min(rank + 8, *rows.shape))).astype(rows.dtype)
    for _ in range(4):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, v = np.linalg.svd(rows @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, text, label): at most about `limit` labelled rows, one per id, chosen by a hash of the id, not by order."""
    chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("doc is not null and label in (0, 1)").filter(usable(F.col("doc")))
    chosen = chosen.groupBy("doc").agg(F.min("label").alias("label"))
    rows = chosen.count()
    share = min(1.0, limit / max(rows, 1))
    chosen = chosen.filter(F.pmod(F.xxhash64("doc", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc")  # bounded by limit


def fit_space(docs: DataFrame, labels: DataFrame, label_col: str, usable, sample: int = 3000, dims: int = 8192, rank: int = 64, neighbours: int = 15, id_col: str = "doc_id", text_col: str = "text") -> Space:
    """Document frequencies come from all documents; the axes and the voters from at most about `sample` labelled rows."""
    text = F.col(f"`{text_col}`").cast("string").alias("text")

    def frequencies(it):
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches(it, size=1 << 20):
            data, offsets = text_buffer(batch.column(0))
            _, term, _ = shape_terms(data, offsets, dims)
            df += np.bincount(term, minlength=dims)
            n += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["term", "n"])

    counts = docs.select(text).mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    by = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
    total = by.pop(-1, 0)
    df = np.zeros(dims)
    df[list(by)] = list(by.values())
    idf = np.log1p((1 + total) / (1 + df)) * weights(dims)  # above 0 everywhere: common shapes mark clean text

    def sparse(it):
        for batch in batches(it, size=1 << 20):
            data, offsets = text_buffer(batch.column(0))
            doc, term, count = shape_terms(data, offsets, dims)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (term, count)] + [batch.column(1)], ["term", "count", "label"])

    # In the order of hashes, so that the order in which tasks deliver rows is no matter.
    rows = labelled_sample(docs, labels, label_col, usable, sample, id_col, text_col).select("text", "label").mapInArrow(sparse, "term array<int>, count array<int>, label int")
    rows = rows.withColumn("hash", F.xxhash64("term", "count")).toArrow().sort_by([("hash", "ascending"), ("label", "ascending")]).combine_chunks()
    label = rows.column("label").to_numpy().astype(np.float64)
    table = np.zeros((len(label), dims), np.float32)
    lists = [rows.column(c).combine_chunks() for c in ("term", "count")]
    term, count = (np.asarray(x.flatten(), np.int64) for x in lists)
    table[np.repeat(np.arange(len(label)), np.asarray(pc.list_value_length(lists[0]), np.int64)), term] = (1 + np.log(count)) * idf[term]
    if not len(label):
        return Space(idf, np.zeros((dims, 1), np.float32), np.zeros((0, 1)), label, 0.5, neighbours)
    # Rows of unit length, so that long documents don't take all the axes.
    size = np.linalg.norm(table, axis=1, keepdims=True)
    table /= np.where(size > 0, size, 1)
    axes = _singular_axes(table, rank)
    vectors = (table @ axes).astype(np.float64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors /= np.where(norm > 0, norm, 1)
    # Equal rows are one voter, so that copies can't outvote the rest; conflicting labels leave their mean.
    _, first, same = np.unique(np.round(vectors, 6), axis=0, return_index=True, return_inverse=True)
    same = same.ravel()
    mean = np.bincount(same, weights=label) / np.bincount(same)
    return Space(idf, axes.astype(np.float32), vectors[first], mean, float(label.mean()), neighbours)


def quality_scores(docs: DataFrame, labels: DataFrame, usable, label_col: str = "quality", threshold: float = 0.7, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0) added.

    usable(id): a condition that says whose labels may be learnt.  Labels other than 0 and 1, null ids and repeated
    labels of one id (of which the least counts) are set aside.  A null or empty text, or one that resembles no
    labelled row, gets the share of label 1 in the sample (0.5 without labels).  Voters with equal vectors are one, with
    the mean of their labels.  Ids, labels and other columns are no inputs of a score.  Every row of docs, repeated ones
    too, is scored by itself; an empty table gives no rows.  Ids are cast to long to find their labels.  Columns score and predicted that docs has are
    replaced.
    """
    space = docs.sparkSession.sparkContext.broadcast(fit_space(docs, labels, label_col, usable, sample, id_col=id_col, text_col=text_col, **fit))
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    inner = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"x{i}" for i in range(len(names))])
    inner = inner.withColumn("text", F.coalesce(F.col(f"x{names.index(text_col)}").cast("string"), F.lit("")))
    fields = inner.schema.fields[: len(names)]

    def score(it):
        for batch in batches(it, size=1 << 20):
            x = space.value.project(*text_buffer(batch.column(batch.num_columns - 1)))
            value = np.clip(space.value.score(x), 0, 1) if len(space.value.labels) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value)], [*batch.schema.names[:-1], "score"])

    out = inner.mapInArrow(score, T.StructType([*fields, T.StructField("score", T.DoubleType())])).toDF(*names, "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["fit_space", "labelled_sample", "quality_scores"]
