"""BPE encoding and decoding by a segment tree over the ranks of neighbouring pairs.

The leaves of the tree are the places of a word's symbols; a leaf holds the rank at which its symbol merges with the next
one, infinite if it does not.  An inner node holds the least rank below it and, of equals, the leftmost place, so the root
is the next merge.  Merging changes three leaves, each updated in logarithmic time, until the root is infinite: a word of n
symbols takes n log n steps at most, also one of a million letters without a space.

What surrounds the merges follows the tokenizer file: added tokens are found in the raw text, the rest is normalised and
split by the file's own normaliser and pre-tokenizer.  Neither looks across ASCII white space, so texts are cut there, and a
worker computes each distinct chunk once for as long as it stays in a bounded table.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, gather

_NEVER = 1 << 62


def merge_word(ids: list[int], ranks: dict[int, int], made: list[int], shift: int) -> list[int]:
    """The symbols that merging leaves of a word.

    ranks: of a pair of ids, left << shift | right, its rank; made: of each rank the id that its pair becomes.
    """
    n = len(ids)
    if n < 2:
        return ids
    bits = (n - 2).bit_length()
    leaves = 1 << bits
    get, tree = ranks.get, [_NEVER] * (2 * leaves)
    left, k = ids[0], leaves
    for right in ids[1:]:
        rank = get(left << shift | right)
        if rank is not None:
            tree[k] = rank << bits | k - leaves
        left = right
        k += 1
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    best = tree[1]
    if best == _NEVER:
        return ids
    ids, after, before = [*ids], [*range(1, n + 1)], [*range(-1, n - 1)]
    while best != _NEVER:
        i = best & leaves - 1
        j = after[i]
        merged = ids[i] = made[best >> bits]
        ids[j] = -1
        last = after[i] = after[j]
        rank = None
        if last < n:
            before[last] = i
            rank = get(merged << shift | ids[last])
        changed = [(leaves + i, _NEVER if rank is None else rank << bits | i)]
        if j < n - 1:  # the last symbol has no leaf
            changed.append((leaves + j, _NEVER))
        first = before[i]
        if first >= 0:
            rank = get(ids[first] << shift | merged)
            changed.append((leaves + first, _NEVER if rank is None else rank << bits | first))
        for k, value in changed:
            while tree[k] != value:
                tree[k] = value
                if k == 1:
                    break
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
        best = tree[1]
    return [x for x in ids if x >= 0]


class Recent:
    """A table of at least `keep` and at most twice as many of the keys that were used last."""

    def __init__(self, keep: int):
        self.keep, self.new, self.old = keep, {}, {}

    def get(self, key: str):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.new) >= self.keep:
            self.old, self.new = self.new, {}
        self.new[key] = value


def _ascii_words(spec: dict):
    """What splits printable ASCII in small letters as the file's pre-tokenizer splits it, if it can be said in this way.

    Such text needs no normaliser but for capitals; the pattern's classes of letters and digits are those of ASCII there.
    """
    steps, norms = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []), (spec.get("normalizer") or {}).get("normalizers", [])
    kinds = [s.get("type") for s in norms], [s.get("type") for s in steps]
    if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or norms[1]["pattern"] != {"Regex": "\\s+"} or norms[1]["content"] != " ":
        return None
    if not (steps[0]["invert"] and steps[0]["behavior"] == "Removed") or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
        return None
    pattern = steps[0]["pattern"].get("Regex", "\\p").replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9")
    return None if "\\p" in pattern else re.compile(pattern, re.ASCII).findall


class SegmentBPE:
    """A byte-level BPE tokenizer of the tokenizers library's JSON form, with or without a mark at the end of words."""

    def __init__(self, file: bytes, keep: int = 400_000):
        from tokenizers import Tokenizer

        spec = json.loads(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("only plain BPE files without a decoder can be compiled")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that are found in the raw text can be compiled")
        library = Tokenizer.from_str(file.decode())
        self.normalise = library.normalizer.normalize_str if library.normalizer else lambda text: text
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.shift = max(self.vocab.values(), default=0).bit_length()
        self.ranks = {self.vocab[a] << self.shift | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.ascii = _ascii_words(spec)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Of added tokens that start at one place the longest counts.
        self.raw = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        tokens = {i: t for t, i in [*self.vocab.items(), *self.added.items()]}
        texts = [tokens.get(i, "").encode() for i in range(max(tokens, default=-1) + 1)]
        self.ends = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        self.bytes = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.chunks, self.words = Recent(keep), Recent(keep)

    def word(self, text: str) -> bytes:
        """The packed ids of a word; symbols outside the vocabulary have none."""
        found = self.words.get(text)
        if found is None:
            vocab = self.vocab
            symbols = [*text[:-1], text[-1] + self.end]
            ids = merge_word([vocab[s] for s in symbols if s in vocab], self.ranks, self.made, self.shift)
            found = struct.pack(f"<{len(ids)}I", *ids)
            if len(text) <= 64:
                self.words.put(text, found)
        return found

    def chunk(self, text: str) -> bytes:
        """The packed ids of a text without white space at which it could be cut."""
        out, at = [], 0
        for m in self.raw.finditer(text) if self.raw else ():
            out += [self.plain(text[at : m.start()]), struct.pack("<I", self.added[m.group()])]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
        if self.ascii and text.isascii() and text.isprintable():
            return b"".join(map(self.word, self.ascii(text.lower())))
        return b"".join([self.word(word) for word, _ in self.split(self.normalise(text)) if word]) if text else b""

    def encode(self, text: str) -> np.ndarray:
        chunks, out = self.chunks, []
        new = chunks.new
        for u in _CUT.split(text):
            ids = new.get(u)
            if ids is None:
                ids = chunks.get(u)
                if ids is None:
                    ids = self.chunk(u)
                    if len(u) <= 64:
                        chunks.put(u, ids)
                new = chunks.new
            out.append(ids)
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> bytes:
        """The tokens' texts in UTF-8, joined by a space each, as a file without a decoder has it."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        return self.bytes[gather(self.ends[ids], self.ends[ids + 1] - self.ends[ids])][:-1].tobytes()


#: White space of ASCII, which no word of a pre-tokenizer holds and no normaliser reaches across.
_CUT = re.compile(r"[ \t\n\x0b\f\r]+")

_compiled: dict[str, SegmentBPE] = {}


def _tokenizer(file: bytes) -> SegmentBPE:
    """The worker's tokenizer of this file."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _compiled:
        _compiled[key] = SegmentBPE(file)
    return _compiled[key]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256[, decoded]) of each document.

    path: a tokenizer file that the driver can read; its bytes, some MB, are broadcast.  Its pre-tokenizer must drop white
    space.  ids_sha256 is that of the ids as little-endian unsigned 32-bit integers.  Strings of added tokens in a text give
    their ids.  Null or empty texts, or white space alone: no ids.  Of pairs of equal rank the leftmost merges first.  Rows that
    share an id, wholly equal ones too, are rows of their own; ids of documents are cast to long; an empty table gives no rows.
    A text of any length is one input; only chunks up to 64 characters are remembered.
    """
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it):
        t = _tokenizer(file.value)
        for batch in batches(it, 512, 1 << 20):
            ids = [t.encode(x or "") for x in batch.column(1).to_pylist()]
            decoded = [t.decode(x) for x in ids]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            columns = [
                batch.column(0), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.decode() for x in decoded])] if with_text else [])], names)

    names = ["doc", "n_tokens", "ids", "ids_sha256", "decoded_sha256", *(["decoded"] if with_text else [])]
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string" + (", decoded string" if with_text else "")).withColumnRenamed("doc", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of token ids; null or empty ids give an empty text, ids outside the vocabulary fail."""
    with open(path, "rb") as f:
        file = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(it):
        t = _tokenizer(file.value)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []).decode() for x in batch.column(1).to_pylist()], pa.string())], ["doc", "text"])

    chosen = encoded.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, f"doc {chosen.schema['doc'].dataType.simpleString()}, text string").withColumnRenamed("doc", id_col)
