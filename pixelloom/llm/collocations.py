"""Phrase collocations: count-min sketches choose what is counted exactly, then phrases are scored and subsumed.

1. Each task adds its words and pairs of words to a sketch: two rows of counters, each phrase in one cell of either.  Counters
   stop at the least frequency, as no more is asked of them, so a cell is a byte for frequencies up to 255.  Sketches are merged in
   stripes by adding (again up to that bound), and a merged cell becomes one bit: whether it reached the bound.  A second sketch
   takes the longer phrases, all of whose pairs the first one lets pass: few, so it is small.
2. A cell counts each of its phrases at least as often as it occurs, so a phrase whose bit is missing in a row is too rare, and so
   is one with a part that is.  A last pass counts the others exactly, by their words.  Nothing frequent is lost; what
   two rows of cells let through by chance falls out by its exact count.
3. All parts of a frequent phrase are frequent, so the counts that scores need are all there: joins by phrase look them up.

The sketch's width follows the size of the texts up to MOST cells; beyond, more rare phrases pass to the exact count, which Spark
shuffles like any other aggregate, and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, batches, gather, grams, mix, pair, stage, strings, text_buffer, word_codes, word_spans

#: Cells of a sketch's row at least and at most, as powers of two, and of a stripe.
LEAST, MOST, STRIPE = 16, 26, 16
#: Bytes of text for each cell of a row: of the sketch of words and pairs, and of that of longer phrases.
PER_CELL = (128, 256)
#: Bytes of text that a task looks at at once.
PIECE = 2 << 20
#: Tasks whose sketches are merged at once.
FAN = 64
ROWS = 2

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True


class Words:
    """The words of some texts, with what phrases are made of."""

    def __init__(self, texts: pa.Array, langs: list[str], longest: int):
        data, offsets = text_buffer(texts)
        self.data = data = LOWER[data]
        self.starts, self.ends, at = word_spans(data, offsets, ~(_BREAK | _BLANK))
        self.names = sorted(set(langs))
        number = {name: i for i, name in enumerate(self.names)}
        doc = np.repeat(np.arange(len(langs)), np.diff(at))
        self.lang = np.array([number[x] for x in langs], np.int64)[doc]
        # Words of one piece have one number, which grows from piece to piece and from text to text.
        self.piece = np.cumsum(_BREAK[data])[self.starts] + doc if len(data) else np.zeros(0, np.int64)
        salt = np.array([int.from_bytes(name.encode()[:7].ljust(8, b"\1"), "little") ^ len(name) for name in self.names], np.uint64)
        self.codes = pair(word_codes(data, self.starts, self.ends), mix(salt)[self.lang]) if len(self.lang) else np.zeros(0, np.uint64)
        self.longest = longest

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first word, fingerprint) of all phrases, by their number of words."""
        n = len(self.codes)
        for k in range(1, min(self.longest, n) + 1):
            at = np.flatnonzero(self.piece[: n - k + 1] == self.piece[k - 1 :])
            yield k, at, mix(self.codes)[at] if k == 1 else grams(self.codes, k)[at]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, a space after each, and where each starts."""
        size = self.ends - self.starts + 1
        out = np.concatenate([self.data, [32]]).astype(np.uint8)[gather(self.starts, size)]
        place = np.concatenate([[0], np.cumsum(size)])
        out[place[1:] - 1] = 32
        return out, place

    def numbers(self) -> np.ndarray:
        """A number for each distinct word, by its bytes."""
        out, place = self.joined()
        return np.asarray(strings(out, place, pa.binary()).dictionary_encode().indices, np.int64)

    def text(self, at: np.ndarray, k: np.ndarray) -> list[str]:
        """The phrases of k words from word `at` on, joined by spaces."""
        out, place = self.joined()
        raw = out.tobytes()
        return [raw[a : b - 1].decode() for a, b in zip(place[at].tolist(), place[at + k].tolist())]


def _cells(h: np.ndarray, power: int) -> list[np.ndarray]:
    """The cell of each fingerprint in either row."""
    return [(h >> np.uint64(64 - power)).astype(np.int64), (mix(h) >> np.uint64(64 - power)).astype(np.int64)]


def _add(row: np.ndarray, cells: np.ndarray, n: np.ndarray, bound: int) -> None:
    """Add counts to a row's cells, up to the bound."""
    key = np.sort(cells.astype(np.uint64) << np.uint64(16) | np.minimum(n, bound).astype(np.uint64))
    if not len(key):
        return
    at = key >> np.uint64(16)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sums = np.add.reduceat((key & np.uint64(0xFFFF)).astype(np.int64), first)
    at = at[first].astype(np.int64)
    row[at] = np.minimum(row[at] + sums, bound)


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.concatenate([first, [len(h)]]))


class Bits:
    """What a merged sketch says: one bit for each cell of both rows, whether it reached the least frequency."""

    def __init__(self, power: int, rows: np.ndarray):
        self.power, self.rows = power, rows

    def passes(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, cells in zip(self.rows, _cells(h, self.power)):
            out &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def hopeful(words: Words, pairs: Bits | None, longer: Bits | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, first word, fingerprint) of phrases that the sketches so far let pass, in themselves and all their parts."""
    good = None
    for k, at, h in words.phrases():
        bits = pairs if k <= 2 else longer
        ok = bits.passes(h) if bits else np.ones(len(h), bool)
        if good is not None:
            ok &= good[at] & good[at + 1]
        good = np.zeros(len(words.codes) + 1, bool)
        good[at[ok]] = True
        yield k, at[ok], h[ok]


def frequent_bits(texts: DataFrame, power: int, longest: int, least: int, pairs=None) -> Bits:
    """Bits of the words and pairs of all texts, or if `pairs` is their broadcast, of the longer phrases that they allow."""
    per_row, kind = 1 << (power - STRIPE), np.min_scalar_type(least)

    def sketch(it):
        rows = None
        task = TaskContext.get().partitionId()
        for batch in batches(it, 60_000, PIECE):
            if rows is None:
                rows = np.zeros((ROWS, 1 << power), kind)
            words = Words(batch.column(1), batch.column(0).to_pylist(), longest if pairs else min(longest, 2))
            for k, _, h in hopeful(words, pairs.value if pairs else None, None):
                if k <= 2 and pairs:
                    continue
                h, n = _counted(h)
                for row, cells in zip(rows, _cells(h, power)):
                    _add(row, cells, n, least)
        if rows is not None:
            for k, part in enumerate(rows.reshape(ROWS * per_row, 1 << STRIPE)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([task // FAN], pa.int64()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], ["stripe", "task", "cells"])

    def merged(group) -> np.ndarray:
        total = np.zeros(1 << STRIPE, np.int64)
        for batch in group:
            for x in batch.column("cells").to_pylist():
                total += np.frombuffer(pa.decompress(x, kind.itemsize << STRIPE, "zstd", asbytes=True), kind)
        return np.minimum(total, least)

    def merge(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = pa.compress(merged(group).astype(kind).tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([cells], pa.binary())], ["stripe", "cells"])

    def bits(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(merged(group) >= least).tobytes()], pa.binary())], ["stripe", "bits"])

    sketches = texts.select("lang", "text").mapInArrow(sketch, "stripe long, task long, cells binary")
    once = sketches.groupBy("stripe", "task").applyInArrow(merge, "stripe long, cells binary")
    out = np.zeros((ROWS * per_row, (1 << STRIPE) // 8), np.uint8)
    for r in once.groupBy("stripe").applyInArrow(bits, "stripe long, bits binary").collect():
        out[r.stripe] = np.frombuffer(r.bits, np.uint8)
    return Bits(power, out.reshape(ROWS, -1))


def phrase_counts(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, k, phrase, f): exact counts of all phrases of k words that occur `least` times or more in a language.

    Rows with k = 0 and an empty phrase hold the number of all words.
    """
    spark = texts.sparkSession
    total = texts.select(F.sum(F.octet_length("text"))).first()[0] or 0
    power = lambda i: min(max(int(total // PER_CELL[i]).bit_length(), LEAST), MOST)
    pairs = spark.sparkContext.broadcast(frequent_bits(texts, power(0), longest, least))
    longer = spark.sparkContext.broadcast(frequent_bits(texts, power(1), longest, least, pairs))

    def survivors(it):
        for batch in batches(it, 60_000, PIECE):
            words = Words(batch.column(1), batch.column(0).to_pylist(), longest)
            n, numbers = len(words.codes), words.numbers()
            ks, starts, counts = [], [], []
            group = np.zeros(n + 1, np.int64)  # of the phrase of one word less from each word on
            for k, at, _ in hopeful(words, pairs.value, longer.value):
                # A phrase is known by the number of its first words and its last one: no fingerprints decide counts.
                key = (group[at] if k > 1 else words.lang[at]) << 32 | numbers[at + k - 1]
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
                first = np.flatnonzero(new)
                group = np.full(n + 1, -1, np.int64)
                group[at] = np.cumsum(new) - 1
                starts.append(at[first])
                counts.append(np.diff(np.concatenate([first, [len(key)]])))
                ks.append(np.full(len(first), k))
            starts, counts, ks = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (starts, counts, ks))
            # One key for language and phrase, as rows of fewer fields are shuffled in fewer bytes; no phrase holds a tab.
            names = [f"{name}\t" for name in words.names]
            keys = [names[i] + text for i, text in zip(words.lang[starts].tolist(), words.text(starts, ks))] + names
            counts = np.concatenate([counts, np.bincount(words.lang, minlength=len(names))])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts)], ["key", "f"])

    found = texts.select("lang", "text").mapInArrow(survivors, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\t", -1)
    found = found.select(F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")
    k = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    return found.select("lang", k.cast("long").alias("k"), "phrase", "f").filter((F.col("f") >= least) | (F.col("k") == 0))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, covered: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words.

    Words are runs of other bytes than blanks within pieces, which end at `.,;:!?` and line ends; A to Z become small letters.  a: how
    often the phrase occurs, `least` times or more; cut after its first words it falls into parts that occur l and r times,
    scored floor(scale * a / (l + r)); the cut with the least score counts, of equals the one with fewest words in front.  n: the
    language's words.  A phrase goes if a longer frequent one holds it and occurs at least `covered` percent as often.
    Null languages are `und`; null or empty texts have no words; an empty table gives no rows; repeated rows count each.
    Scores are computed in decimals of 38 digits.  Phrases with equal scores rank by a, then by their bytes.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = stage(phrase_counts(texts, longest, least), "phrases")
    frequent = counts.filter("k > 0")
    phrases = frequent.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    joined = lambda a, n: F.array_join(F.slice("w", a, n), " ")

    cuts = phrases.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("front"), joined(F.col("cut") + 1, F.col("k").cast("int") - F.col("cut")).alias("back"))
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("front", "l"), ["lang", "front"]).join(part("back", "r"), ["lang", "back"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.expr(f"cast({scale} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))

    # Each phrase is told how often the longer ones around it occur.
    inner = phrases.filter("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k").cast("int") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", joined(F.col("at"), F.col("size")).alias("phrase"), F.col("a").alias("around"))
    told = cuts.select("lang", "phrase", "a", F.struct("score", "cut", "l", "r").alias("best"), F.lit(None).cast("long").alias("around")).unionByName(inner, allowMissingColumns=True)
    judged = told.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("best").alias("best"), F.max("around").alias("around"))
    judged = judged.filter(F.col("around").isNull() | (wide("around") * 100 < wide("a") * covered))
    judged = judged.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # First within a part of a language, then among what is left.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = judged.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    n = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return first.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
