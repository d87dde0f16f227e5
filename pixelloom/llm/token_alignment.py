"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often in the whole corpus.

A text's tokens on both sides are laid over its bytes.  Offsets where tokens of both sides end cut them into groups; a link is
an overlapping pair of tokens, so the links of a text are the stretches between neighbouring ends of either side.

The ids of side B are dealt to stripes.  One pass over the texts writes, for each stretch of documents (a batch) and each
stripe, the linked pairs with the documents that hold them; the table is dealt by stripe once.  Then

* counting: each part of a stripe adds its pairs with np.add.at to a dense matrix, B ids of the stripe by A ids; the parts'
  sums are added in the same way, and a row's maximum is the best count of its B id;
* scoring: links lie where the counts of their stripe come to, and each part of a stripe returns sums by document.

A stripe's matrix has a fixed size whatever the corpus.  What grows with it is the number of parts (salts) of a stripe: batches are
dealt to them in turn, so that no pair of tokens, however frequent, gathers in one task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stage, text_buffer
from .wfst import BYTE, MARK, _fields

#: Bytes of a stripe's matrix of counts at most.
BLOCK = 64 << 20
#: Bytes of text for each part of a stripe, over all its batches, at most.
PART = 64 << 20


class Sides:
    """Both tokenizers, the bytes of their tokens, and decimal ids in cells of one width."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        letters = {c: b for b, c in _byte_letters().items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        pieces = [dict(_fields(v)) for n, v in _fields(b_file) if n == 1]
        kinds = [bytes([int(p[1][3:5], 16)]) if p.get(3, 1) == BYTE else p[1].decode().replace(MARK, " ").encode() for p in pieces]
        self.bytes = [_table(tokens), _table(kinds)]
        wide = len(str(max(len(tokens), len(kinds))))
        digits = [str(i).encode().rjust(wide) + b"," for i in range(max(len(tokens), len(kinds)))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8).reshape(-1, wide + 1)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all tokens of both sides, one text after another, and offsets of the texts in them; a few texts at a time."""
        out = []
        for encode in (lambda x: [e.ids for e in self.a.encode_batch_fast([" " + t for t in x], add_special_tokens=False)], lambda x: self.b.encode(x, num_threads=1)):
            ids, sizes, at = [], [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 18):
                    size += len(texts[to])
                    to += 1
                found = encode(texts[at:to])
                ids += [np.array(x, np.int32) for x in found]
                sizes += [len(x) for x in found]
                at = to
            out.append((np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])))
        return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int64)


def _joined(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """The tokens' bytes, one after another, and the end of each."""
    data, at = table
    n = at[ids + 1] - at[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(at[ids] - (ends - n), n)].tobytes(), ends


def align(sides: Sides, texts: list[str]) -> dict:
    """Both sides' tokens of some texts: counts by text, hashes of their groups, and all links as (text, a, b)."""
    n = len(texts)
    (a, a_at), (b, b_at) = sides.encode(texts)
    whole = []
    a_bytes, a_ends = _joined(a, sides.bytes[0])
    b_bytes, b_ends = _joined(b, sides.bytes[1])
    a_to, b_to = np.concatenate([[0], a_ends])[a_at], np.concatenate([[0], b_ends])[b_at]
    for i, t in enumerate(texts):
        want = b" " + t.encode() if t else b""
        whole.append(bool(want) and a_bytes[a_to[i] : a_to[i + 1]] == want and b_bytes[b_to[i] : b_to[i + 1]] == want)
    ok = np.array(whole, bool)
    # Only tokens of texts that both sides cover; their ends count from the start of the first such text.
    length = np.where(ok, np.diff(a_to), 0)
    starts = np.cumsum(length) - length
    doc_a, doc_b = np.repeat(np.arange(n), np.diff(a_at)), np.repeat(np.arange(n), np.diff(b_at))
    keep_a, keep_b = ok[doc_a], ok[doc_b]
    a, a_ends, doc_a = a[keep_a], (a_ends - a_to[doc_a] + starts[doc_a])[keep_a], doc_a[keep_a]
    b, b_ends, doc_b = b[keep_b], (b_ends - b_to[doc_b] + starts[doc_b])[keep_b], doc_b[keep_b]
    mark = np.zeros(int(length.sum()) + 1, np.uint8)
    mark[a_ends] = 1
    mark[b_ends] |= 2
    stretches = np.flatnonzero(mark)
    kind = mark[stretches]
    of_a, of_b, both = (kind & 1).astype(bool), kind > 1, kind == 3  # a text's end is one of both sides
    rank = lambda x: np.cumsum(x) - x
    left, right, group = rank(of_a), rank(of_b), rank(both)
    count = lambda doc: np.bincount(doc, minlength=n)
    doc_g = doc_a[left[both]]
    return {
        "n_a": count(doc_a), "n_b": count(doc_b), "n_groups": count(doc_g), "n_links": count(doc_a[left]),
        "groups": _hashes(sides, a, b, group[of_a], group[of_b], doc_g, n), "doc": doc_a[left].astype(np.int32), "a": a[left], "b": b[right],
    }


def _hashes(sides: Sides, a, b, group_a, group_b, doc_g, n: int) -> list[str]:
    """SHA-256 of each text's groups, `a1,a2|b1;a3|b2,b3`; of a text without tokens an empty string."""
    m = len(doc_g)
    before_a, before_b = np.searchsorted(group_a, np.arange(m + 1)), np.searchsorted(group_b, np.arange(m + 1))
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + before_a[group_b + 1]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    cells = sides.digits[ids]
    cells[place_a[before_a[1:] - 1], -1] = ord("|")
    last = place_b[before_b[1:] - 1]
    cells[last, -1] = ord(";")
    shown = cells != 32
    size = np.concatenate([[0], np.cumsum(shown.sum(1))])
    data = cells[shown].tobytes()
    first = np.searchsorted(doc_g, np.arange(n + 1))  # a text's groups
    ends = np.concatenate([[0], last + 1])
    cut = size[ends[first]]
    return [hashlib.sha256(data[cut[i] : cut[i + 1] - 1]).hexdigest() if cut[i + 1] > cut[i] else "" for i in range(n)]


_compiled: dict[str, Sides] = {}


def _sides(a_file: bytes, b_file: bytes) -> Sides:
    key = hashlib.sha256(a_file + b_file).hexdigest()
    if key not in _compiled:
        _compiled[key] = Sides(a_file, b_file)
    return _compiled[key]


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(row[c], t) for c, t in (("codes", np.uint32), ("sizes", np.uint32), ("docs", np.uint16), ("times", np.uint32)))


_SUMMARY = ("doc", "n_a", "n_b", "n_groups", "n_links", "groups")
_LISTS = ", ".join(f"{c} array<{'string' if c == 'groups' else 'long'}>" for c in _SUMMARY)


def token_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document, or the corpus-wide counts.

    a_path: a byte-level BPE file of the tokenizers library, which reads a space and the text; b_path: a SentencePiece model
    that puts the space there itself.  Both are broadcast, some MB.  Strings of special tokens in a text are plain text.
    n_best: links whose pair is the most frequent of its B id, ties included; count_sum: the sum of all links' counts.
    Null or empty texts, and texts that the bytes of either side do not give back, have no tokens: zeros and an empty hash.
    Rows that share an id or a text are rows of their own, and each counts; ids are cast to long; an empty table gives no rows.

    counts: (b, a, n, best) for each linked pair instead, best telling whether n is the largest of its B id.
    """
    spark = docs.sparkSession
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    sides = _sides(*files.value)
    wide, high = len(sides.bytes[0][1]) - 1, len(sides.bytes[1][1]) - 1
    rows = max(1, BLOCK // (8 * wide))
    stripes = -(-high // rows)
    text = F.col(f"`{text_col}`").cast("string")
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), text.alias("text"))
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    salts = int(total // (PART * stripes)) + 1

    def aligned(s, it):
        """Ids and alignment of batches of documents; their texts are looked at piece by piece."""
        for batch in batches(it, 60_000, 8 << 20):
            got, at = [], 0
            for piece in batches([batch], 60_000, 1 << 20):
                got.append(align(s, [x or "" for x in piece.column(1).to_pylist()]))
                got[-1]["doc"] += at
                at += piece.num_rows
            yield batch.column(0).to_pylist(), {c: sum((g[c] for g in got), []) if c == "groups" else np.concatenate([g[c] for g in got]) for c in got[0]}

    def send(it):
        s, task = _sides(*files.value), TaskContext.get().partitionId()
        for i, (ids, got) in enumerate(aligned(s, it)):
            # Sorted by stripe, pair and document; a pair's code is its place in the stripe's matrix.
            code = (got["b"] // stripes).astype(np.uint64) * np.uint64(wide) + got["a"].astype(np.uint64)
            key = ((got["b"] % stripes).astype(np.uint64) << np.uint64(48)) | (code << np.uint64(16)) | got["doc"].astype(np.uint64)
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([first, [len(key)]])).astype(np.uint32)
            key = key[first]
            pair = key >> np.uint64(16)
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([starts, [len(key)]])).astype(np.uint32)
            codes = (pair[starts] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            docs16 = (key & np.uint64(0xFFFF)).astype(np.uint16)
            cut = np.searchsorted(pair[starts] >> np.uint64(32), np.arange(stripes + 1, dtype=np.uint64))
            inner = np.concatenate([starts, [len(key)]])[cut]
            part = lambda x, at: pa.array([x[at[k] : at[k + 1]].tobytes() for k in range(stripes)], pa.binary())
            number = task << 20 | i
            told = (ids, *(got[c].tolist() for c in _SUMMARY[1:-1]), got["groups"])
            # The stripe that carries what is known of the documents already differs by batch.
            lists = [pa.array([x if k == (task + i) % stripes else None for k in range(stripes)], pa.list_(pa.string() if c == "groups" else pa.int64())) for c, x in zip(_SUMMARY, told)]
            cell = np.arange(stripes) * salts + number % salts
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), pa.array(np.full(stripes, number), pa.int64()), pa.array(np.full(stripes, len(ids)), pa.int64()), part(codes, cut), part(sizes, cut), part(docs16, inner), part(times, inner), *lists],
                ["cell", "batch", "n", "codes", "sizes", "docs", "times", *_SUMMARY],
            )

    links = "codes binary, sizes binary, docs binary, times binary"
    sent = chosen.mapInArrow(send, f"cell long, batch long, n long, {links}, {_LISTS}")
    buckets = min(stripes * salts, max(int(total // (8 << 20)) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sent = stage(sent, "links", ("cell", buckets))

    def matrix(parts) -> np.ndarray:
        block = np.zeros(rows * wide, np.int64)
        for codes, n in parts:
            np.add.at(block, codes, n)
        return block

    def count(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in group:
                for row in batch.to_pylist():
                    codes, sizes, _, times = _arrays(row)
                    yield codes, np.add.reduceat(times, np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)]), dtype=np.int64) if len(sizes) else times

        block = matrix(pairs())
        codes = np.flatnonzero(block != 0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py() // salts], pa.int64()), pa.array([codes.astype(np.uint32).tobytes()], pa.binary()), pa.array([block[codes].tobytes()], pa.binary())], ["stripe", "codes", "ns"])

    def total_counts(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = matrix((np.frombuffer(r["codes"], np.uint32), np.frombuffer(r["ns"], np.int64)) for batch in group for r in batch.to_pylist())
        codes = np.flatnonzero(block != 0)
        best = block.reshape(rows, wide).max(1)
        n = block[codes]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([codes.astype(np.uint32).tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([(n == best[codes // wide]).tobytes()], pa.binary())], ["stripe", "codes", "ns", "best"])

    parts = sent.select("cell", "codes", "sizes", "docs", "times").groupBy("cell").applyInArrow(count, "stripe long, codes binary, ns binary")
    counted = parts.groupBy("stripe").applyInArrow(total_counts, "stripe long, codes binary, ns binary, best binary")
    if counts:
        return _pairs(counted, stripes, wide)
    counted = stage(counted, "counts")
    each = counted.select(F.explode(F.sequence(F.col("stripe") * salts, F.col("stripe") * salts + (salts - 1))).alias("cell"), F.col("codes").alias("at"), "ns", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block, best = np.zeros(rows * wide, np.int64), np.zeros(rows * wide, bool)
        for r in right.to_pylist():
            at = np.frombuffer(r["at"], np.uint32)
            block[at], best[at] = np.frombuffer(r["ns"], np.int64), np.frombuffer(r["best"], bool)
        out = {c: [] for c in ("batch", "n", "n_best", "count_sum", *_SUMMARY)}
        for batch in left.to_batches():
            for r in batch.to_pylist():
                codes, sizes, docs16, times = _arrays(r)
                n = np.repeat(block[codes], sizes) * times
                sums, wins = np.zeros(r["n"], np.int64), np.zeros(r["n"], np.int64)
                np.add.at(sums, docs16, n)
                np.add.at(wins, docs16, np.repeat(best[codes], sizes) * times)
                for c in ("batch", "n", *_SUMMARY):
                    out[c].append(r[c])
                out["n_best"].append(wins.astype(np.uint32).tobytes())
                out["count_sum"].append(sums.tobytes())
        return pa.Table.from_arrays([pa.array(out[c], t) for c, t in _SCORED], names=[c for c, _ in _SCORED])

    scored = sent.groupBy("cell").cogroup(each.groupBy("cell")).applyInArrow(score, f"batch long, n long, n_best binary, count_sum binary, {_LISTS}")

    def end(group: pa.Table) -> pa.Table:
        sums = wins = None
        told = {}
        for batch in group.to_batches():
            for r in batch.to_pylist():
                if sums is None:
                    sums, wins = np.zeros(r["n"], np.int64), np.zeros(r["n"], np.int64)
                sums += np.frombuffer(r["count_sum"], np.int64)
                wins += np.frombuffer(r["n_best"], np.uint32)
                if r["groups"] is not None:
                    told = r
        return pa.Table.from_arrays([*(pa.array(told[c], pa.int64()) for c in _SUMMARY[:-1]), pa.array(wins), pa.array(sums), pa.array(told["groups"], pa.string())], names=names)

    names = ["doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = scored.groupBy("batch").applyInArrow(end, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))
    return out.withColumnRenamed("doc", id_col)


_SCORED = [("batch", pa.int64()), ("n", pa.int64()), ("n_best", pa.binary()), ("count_sum", pa.binary()), *((c, pa.list_(pa.string() if c == "groups" else pa.int64())) for c in _SUMMARY)]


def _pairs(counted: DataFrame, stripes: int, wide: int) -> DataFrame:
    def unpack(it):
        for batch in it:
            for r in batch.to_pylist():
                codes = np.frombuffer(r["codes"], np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes // wide * stripes + r["stripe"]), pa.array(codes % wide), pa.array(np.frombuffer(r["ns"], np.int64)), pa.array(np.frombuffer(r["best"], bool))], ["b", "a", "n", "best"])

    return counted.mapInArrow(unpack, "b long, a long, n long, best boolean")
