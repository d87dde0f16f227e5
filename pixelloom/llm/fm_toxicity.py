"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the prefixes of its longer words (which catch inflected and compounded forms), hashed.
The score is the logistic of b + sum w_i + sum over pairs <v_i, v_j>: the factors learn pairs of terms whose joint
presence says more than the two weights, such as an insult next to the mention of a group.  It is fitted on a bounded
sample of labelled rows; a document costs one pass over its bytes, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, batches, gather, text_buffer, word_codes, word_spans

PREFIXES = (4, 5, 6)


def hashed_terms(data: np.ndarray, offsets: np.ndarray, dims: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) pairs, distinct and sorted.  chosen: the new number of each term, -1 for those to leave out."""
    low = LOWER[data]
    s, e, docs = word_spans(low, offsets, ALNUM)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(docs) - 1), np.diff(docs))
    keys = []
    for k in (0, *PREFIXES):
        long = slice(None) if k == 0 else np.flatnonzero(e - s > k)
        term = (word_codes(low, s[long], e[long] if k == 0 else s[long] + k) ^ np.uint64(k)) % np.uint64(dims)
        term, d = term.astype(np.int64), doc[long]
        if chosen is not None:
            term = chosen[term]
            d, term = d[term >= 0], term[term >= 0]
        keys.append(d * dims + term)
    key = np.unique(np.concatenate(keys))
    return key // dims, key % dims


@dataclass
class Machine:
    """chosen: from hashed term to number, -1 if unused; bias, linear weights and factors by number; slope and shift turn margins into log odds."""

    chosen: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, term = hashed_terms(data, offsets, len(self.chosen), self.chosen)
        z = np.full(len(offsets) - 1, self.bias)
        if len(doc):
            cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            z[doc[cuts]] += margins(term, cuts, self.linear, self.factors)[0]
        return z

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(data, offsets) + self.shift, -50, 50)))


def margins(term: np.ndarray, cuts: np.ndarray, linear: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of terms the linear and pairwise part, and the sum of its factors."""
    v = factors[term]
    total = np.add.reduceat(v, cuts, axis=0)
    return np.add.reduceat(linear[term], cuts) + 0.5 * (total**2 - np.add.reduceat(v * v, cuts, axis=0)).sum(axis=1), total


def _z(with_1: np.ndarray, with_0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How many standard deviations the shares of the two labels are apart."""
    pooled = (with_1 + with_0) / (n1 + n0)
    return (with_1 / n1 - with_0 / n0) / np.sqrt(np.maximum(pooled * (1 - pooled) * (1 / n1 + 1 / n0), 1e-12))


def choose_terms(doc: np.ndarray, term: np.ndarray, label: np.ndarray, dims: int, most_terms: int, least_docs: int, least_z: float, pool: int) -> np.ndarray:
    """Numbers of the terms to learn, most telling first: of both signs, alone or beside another.

    A term is telling if its share among the rows of one label differs by least_z standard deviations, or if its
    presence beside another term's does and does so by half as much again as either's alone.  Pairs are tried among
    `pool` terms: half of them those that differ most, the others the most frequent.  Terms of fewer than least_docs
    rows are left out.
    """
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    one = label[doc] == 1
    with_1, with_0 = np.bincount(term[one], minlength=dims).astype(float), np.bincount(term[~one], minlength=dims).astype(float)
    total = with_1 + with_0
    z = np.where(total >= least_docs, np.abs(_z(with_1, with_0, n1, n0)), 0)
    seen = np.flatnonzero(total >= least_docs)
    by_z, by_count = seen[np.argsort(-z[seen], kind="stable")], seen[np.argsort(-total[seen], kind="stable")]
    tried = np.unique(np.concatenate([by_z[: pool // 2], by_count[:pool]]))
    tried = tried[np.argsort(-z[tried], kind="stable")][: pool // 2].tolist() + [t for t in by_count[:pool].tolist() if t not in set(by_z[: pool // 2].tolist())]
    tried = np.array(tried[:pool], np.int64)
    gain = z.copy()
    if len(tried):
        at = np.full(dims, -1)
        at[tried] = np.arange(len(tried))
        both = np.zeros((2, len(tried), len(tried)))
        for k, of in enumerate((0, 1)):
            rows = np.flatnonzero(label == of)
            for lo in range(0, len(rows), 2048):
                number = np.full(len(label), -1)
                number[rows[lo : lo + 2048]] = np.arange(len(rows[lo : lo + 2048]))
                use = (number[doc] >= 0) & (at[term] >= 0)
                x = np.zeros((len(rows[lo : lo + 2048]), len(tried)), np.float32)
                x[number[doc[use]], at[term[use]]] = 1
                both[k] += x.T @ x
        joint = np.where(both.sum(axis=0) >= least_docs, np.abs(_z(both[1], both[0], n1, n0)), 0)
        np.fill_diagonal(joint, 0)
        alone = z[tried]
        joint = np.where(joint >= 1.5 * np.maximum(alone[:, None], alone[None, :]), joint, 0)
        gain[tried] = np.maximum(alone, joint.max(axis=1, initial=0))
    use = np.flatnonzero(gain >= least_z)
    return use[np.argsort(-gain[use], kind="stable")[:most_terms]]


def fit_machine(doc: np.ndarray, term: np.ndarray, label: np.ndarray, share: float, dims: int, rank: int = 8, most_terms: int = 4096, least_docs: int = 4, least_z: float = 5.0, pool: int = 1024, epochs: int = 40, seed: int = 3) -> Machine:
    """Fit on distinct (document, term) pairs; share: of label 1 for which the bias is set.

    Without rows of both labels, or without telling terms, every margin is the log odds of the share.
    """
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    clip = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    logit = lambda p: float(np.log(clip(p) / (1 - clip(p))))
    none = np.full(dims, -1, np.int32)
    if not n1 or not n0 or not len(doc):
        return Machine(none, logit(share), np.zeros(0), np.zeros((0, rank)))
    use = choose_terms(doc, term, label, dims, most_terms, least_docs, least_z, pool)
    with_1 = np.bincount(term[label[doc] == 1], minlength=dims).astype(float)
    with_0 = np.bincount(term[label[doc] == 0], minlength=dims).astype(float)
    chosen = none.copy()
    chosen[use] = np.arange(len(use))
    r = np.random.default_rng(seed)
    # Start from smoothed log odds of presence, damped as terms of a kind come together.
    linear = 0.5 * np.log((with_1[use] + 0.5) / (n1 + 1) / ((with_0[use] + 0.5) / (n0 + 1)))
    factors = r.normal(0, 0.02, (len(use), rank))
    number = chosen[term]
    d, t = doc[number >= 0], number[number >= 0]
    bias = np.array([-0.5])
    squares = [np.full_like(linear, 1e-6), np.full_like(factors, 1e-6), np.full(1, 1e-6)]
    at = np.searchsorted(d, np.arange(len(label) + 1))
    weight = np.where(label == 1, 0.5 / n1, 0.5 / n0) * len(label)
    rate, decay, size = 0.1, 2e-3, 256
    for _ in range(epochs):
        order = r.permutation(len(label))
        for lo in range(0, len(order), size):
            rows = np.sort(order[lo : lo + size])
            counts = at[rows + 1] - at[rows]
            full = counts > 0
            margin = np.full(len(rows), bias[0])
            total = np.zeros((len(rows), rank))
            terms = t[gather(at[rows], counts)]
            if len(terms):
                cuts = (np.cumsum(counts) - counts)[full]
                part, total[full] = margins(terms, cuts, linear, factors)
                margin[full] += part
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]) * weight[rows] / len(rows)
            g = np.repeat(slope, counts)
            grad_w = np.bincount(terms, weights=g, minlength=len(linear)) + decay * linear / len(order) * len(rows)
            own = np.repeat(total, counts, axis=0) - factors[terms]
            grad_v = np.stack([np.bincount(terms, weights=g * own[:, k], minlength=len(linear)) for k in range(rank)], axis=1).astype(float)
            grad_v += decay * 5 * factors / len(order) * len(rows)
            for x, grad, sq in ((linear, grad_w, squares[0]), (factors, grad_v, squares[1]), (bias, np.array([slope.sum()]), squares[2])):
                sq += grad * grad
                x -= rate * grad / np.sqrt(sq)
    return Machine(chosen, float(bias[0] + logit(share)), linear, factors)


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the log odds that fit best to rows that the machine has not learnt, by Newton's method with a light ridge."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b, want = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-2 * (b - want)
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-2 * np.eye(2), grad)
        b = b - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str, usable, sample: int = 12000, dims: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", **fit) -> Machine:
    """Fit on at most about `sample` labelled rows, half of each label where there are as many; chosen by hashes of ids.

    Rows come in the order of hashes of their terms, so the order in which tasks deliver them is no matter.  Every fifth
    row is not learnt but tells, weighted to the labels' real shares, how margins become probabilities.
    """
    chosen = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("doc is not null and label in (0, 1)").filter(usable(F.col("doc")))
    chosen = chosen.groupBy("doc").agg(F.max("label").alias("label"))
    have = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    cut = {k: min(1.0, sample / 2 / max(n, 1)) for k, n in have.items()}
    keep = F.lit(False)
    for k, share in cut.items():
        keep = keep | ((F.col("label") == k) & (F.pmod(F.xxhash64("doc", F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30))))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen.filter(keep)), "doc").select("text", "label")  # bounded by sample

    def terms(it):
        for batch in batches(it, size=1 << 20):
            d, t = hashed_terms(*text_buffer(batch.column(0)), dims)
            at = np.searchsorted(d, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(t, pa.int32())), batch.column(1)], ["terms", "label"])

    got = rows.mapInArrow(terms, "terms array<int>, label int").distinct().withColumn("hash", F.xxhash64("terms", "label")).toArrow().sort_by([("hash", "ascending"), ("label", "ascending")]).combine_chunks()
    lists = got.column("terms").combine_chunks()
    n = np.asarray(pc.list_value_length(lists), np.int64)
    term, label = np.asarray(lists.flatten(), np.int64), got.column("label").to_numpy().astype(np.float64)
    return fit_calibrated(n, term, label, {k: 1 / max(v, 1e-9) for k, v in cut.items()}, have, dims, **fit)


def fit_calibrated(n: np.ndarray, term: np.ndarray, label: np.ndarray, weight: dict[int, float], have: dict[int, int], dims: int, **fit) -> Machine:
    """n: terms of each row, one row after another; weight: rows that a row of each label stands for; have: rows of each label."""
    share = have.get(1, 0) / max(sum(have.values()), 1) if have else 0.5
    aside = np.arange(len(n)) % 5 == 4
    if min((label[~aside] == 1).sum(), (label[~aside] == 0).sum()) == 0 or min((label[aside] == 1).sum(), (label[aside] == 0).sum()) == 0:
        aside[:] = False
    at = np.cumsum(n) - n
    some = np.flatnonzero(~aside)
    machine = fit_machine(np.repeat(np.arange(len(some)), n[some]), term[gather(at[some], n[some])], label[some], 0.5 if aside.any() else share, dims, **fit)
    if aside.any():
        some = np.flatnonzero(aside)
        number = machine.chosen[term[gather(at[some], n[some])]]
        doc = np.repeat(np.arange(len(some)), n[some])[number >= 0]
        number = number[number >= 0]
        margin = np.full(len(some), machine.bias)
        if len(doc):
            cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            margin[doc[cuts]] += margins(number, cuts, machine.linear, machine.factors)[0]
        machine.slope, machine.shift = calibrate(margin, label[some], np.where(label[some] == 1, weight.get(1, 1.0), weight.get(0, 1.0)))
    return machine


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable, label_col: str = "toxic", threshold: float = 0.7, sample: int = 12000, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0) added.

    usable(id): a condition that says whose labels may be learnt.  Labels other than 0 and 1 and null ids are set aside;
    of repeated labels of one id the largest counts; copies in the sample count once.  A null or empty text has no terms
    and gets the score of the bias; without labels of both kinds every score is their share of label 1, 0.5 without
    labels; an empty table gives no rows.  Ids are cast to long to find their labels.  Columns score and predicted that
    docs has are replaced.  Rows that share an id are scored each by itself.  Ids, labels and other
    columns are no inputs of a score.

    The machine is fitted on a bounded sample and bounded in size.  sample: labelled rows at most, half of either label.  fit: most_terms,
    terms that it holds (4,096: those that tell most); least_docs, rows of the sample that a term or a pair must stand in (4);
    least_z, how far from chance it must be, in standard errors (5); pool, terms that are tried in pairs (1,024).  Other
    terms of a text add nothing to its score; all documents are scored by the same machine whatever their number.
    """
    machine = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, label_col, usable, sample, id_col=id_col, text_col=text_col, **fit))
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    inner = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"x{i}" for i in range(len(names))])
    inner = inner.withColumn("text", F.coalesce(F.col(f"x{names.index(text_col)}").cast("string"), F.lit("")))

    def score(it):
        for batch in batches(it, size=1 << 20):
            value = machine.value.score(*text_buffer(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value)], [*batch.schema.names[:-1], "score"])

    out = inner.mapInArrow(score, T.StructType([*inner.schema.fields[: len(names)], T.StructField("score", T.DoubleType())])).toDF(*names, "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of a number as text, modulo."""
    return F.crc32(column.cast("string").cast("binary")) % modulus
