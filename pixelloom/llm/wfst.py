"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file and composed with each input; the tropical-semiring shortest path through
the composition is the encoding:

* the normaliser: rewrites characters by the model's compiled map, if it has one, longest match first; adds the word mark
  in front, turns spaces into word marks, cuts the input at word marks;
* the lexicon: a trie of pieces whose final arcs emit a piece at a weight, and, for characters that no piece starts,
  byte-fallback arcs that emit the character's bytes;
* the grammar: for unigram models one state that allows everything, the weights being the negated scores of pieces.  For
  BPE models a state for each last piece, and arcs of weight zero for the pairs of pieces that merging leaves as they
  are; all others have weight infinity.  A sequence is what greedy merging yields exactly if each pair of neighbours is
  (a merge across pieces would have to start between two of them), so the shortest path equals BPE's result, which
  scores as weights could not give.  The grammar's arcs are expanded on demand and kept.

The composition falls apart where no piece can reach across, before word marks and (in most models) between letters and
other characters; the shortest path of a stretch is computed once a worker for as long as it stays in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif wire == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class CharMap:
    """A model's character map: a trie of UTF-8 strings in one array (a cell is its parent's base xor the byte), and what they become."""

    def __init__(self, blob: bytes):
        (size,) = struct.unpack_from("<I", blob)
        self.cells = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.out = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest match at a place, 0 if there is none, and what it becomes."""
        cells, found = self.cells, (0, b"")
        base = lambda cell: (cell >> 10) << ((cell & 512) >> 6)
        place = base(cells[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(cells) or cells[place] & 0x800000FF != data[i]:
                break
            ends, place = cells[place] & 256, place ^ base(cells[place])
            if ends:
                start = cells[place] & 0x7FFFFFFF
                found = i - at + 1, self.out[start : self.out.index(0, start)]
        return found

    def __call__(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while at < len(data):
            n, new = self.longest(data, at)
            if not n:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + n]
            out.append(new)
            at += n
        return b"".join(out).decode("utf-8", "replace")


class Transducer:
    """The compiled machines of one model."""

    def __init__(self, model: bytes, keep: int = 200_000):
        self.pieces: list[tuple[str, float, int]] = []
        kind, normal = UNIGRAM, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                normal = dict(_fields(value))
        if kind not in (UNIGRAM, BPE) or not normal.get(5, 1):
            raise ValueError("only unigram and BPE models with escaped spaces can be compiled")
        if any(t not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, t in self.pieces):
            raise ValueError("user-defined and unused pieces cannot be compiled")
        self.rewrite = CharMap(normal[2]) if normal.get(2) else None
        self.kind, self.prefix, self.squeeze = kind, bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.number = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.score = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        scores = [s for _, s, t in self.pieces if t == NORMAL]
        self.miss = (min(scores) if scores else 0.0) - 10
        self.inner = all(MARK not in p.lstrip(MARK) for p in self.number)
        # States of the lexicon: [arcs by character, piece that ends here or -1].
        self.trie: dict = {}
        for p, i in self.number.items():
            arcs, state = self.trie, None
            for c in p:
                state = arcs.setdefault(c, [{}, -1])
                arcs = state[0]
            state[1] = i
        self.keep = keep
        self.pairs: dict[tuple[int, int], bool] = {}
        self.built: dict[int, tuple] = {}
        self.paths: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cut = re.compile(self._stretches())

    def _stretches(self) -> str:
        """A pattern of stretches that no piece reaches across, so that each has its own shortest path.

        Stretches end before word marks, and between a letter and another character where no piece holds such a pair.
        """
        letter = re.compile(r"[^\W\d_]").fullmatch
        apart: set[str] = set()  # letters that pieces join to other characters count as such
        pairs = {p[i : i + 2] for p in self.number for i in range(len(p) - 1)}
        for _ in range(3):
            crossing = [(x, y) for x, y in pairs if MARK not in (x, y) and (bool(letter(x)) and x not in apart) != (bool(letter(y)) and y not in apart)]
            if not crossing:
                inside = "".join(map(re.escape, sorted(apart)))
                letters, rest = rf"[^\W\d_{inside}]", rf"(?:(?![^\W\d_{inside}])[^{MARK}])"
                return f"{MARK}*{letters}+|{MARK}*{rest}+|{MARK}+"
            apart |= {c for pair in crossing for c in pair if letter(c)}
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"

    # ------------------------------------------------------------ machines

    def normalise(self, text: str) -> str:
        given = text
        if self.rewrite:
            text = self.rewrite(text)
        if self.squeeze:
            given = text = re.sub(" +", " ", text.strip(" "))
        if not given:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def merge(self, symbols: list[str]) -> list[str]:
        """What merging the best-scored neighbours, leftmost first, makes of the symbols: it defines the grammar's arcs."""
        while len(symbols) > 1 and (at := self.best_merge(symbols)) >= 0:
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def best_merge(self, symbols: list[str]) -> int:
        """The place of the best-scored pair of neighbours that is a piece, the leftmost among equals; -1 if there is none."""
        number, score = self.number, self.score
        best, at = None, -1
        for i in range(len(symbols) - 1):
            n = number.get(symbols[i] + symbols[i + 1])
            if n is not None and (best is None or score[n] > best):
                best, at = score[n], i
        return at

    def edges(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """How merging builds a piece from its characters: scores of the merges in order, and the symbols at its left and
        right end before each of them and at the end.  If merging builds something else, the last ends are not the piece."""
        known = self.built.get(piece)
        if known is None:
            symbols = list(self.pieces[piece][0])
            scores, left, right = [], [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                at = self.best_merge(symbols)
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                scores.append(self.score[self.number[symbols[at]]])
                left.append(symbols[0])
                right.append(symbols[-1])
            known = self.built[piece] = (scores, left, right)
        return known

    def allows(self, last: int, piece: int) -> bool:
        """Whether the grammar has an arc of weight zero from the state of the last piece (-1: the start) over this one.

        Merging works on both pieces at once and takes the best merge of either; the arc is there unless, at some time,
        a merge of the two neighbouring ends is better than what is left to do on both sides (of equals the leftmost is).
        """
        key = (last, piece)
        known = self.pairs.get(key)
        if known is None:
            known = self._stable(last, piece)
            if len(self.pairs) >= self.keep:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _stable(self, last: int, piece: int) -> bool:
        after, left, _ = self.edges(piece)
        if left[-1] != self.pieces[piece][0]:
            return False
        if last < 0:
            return True
        before, _, right = self.edges(last)
        if right[-1] != self.pieces[last][0]:
            return False
        number, score, none = self.number, self.score, float("-inf")
        i = j = 0
        while True:
            a = before[i] if i < len(before) else none
            b = after[j] if j < len(after) else none
            across = number.get(right[i] + left[j])
            if across is not None and (a == none or score[across] > a) and (b == none or score[across] >= b):
                return False
            if a == none and b == none:
                return True
            if a >= b and a != none:
                i += 1
            else:
                j += 1

    def shortest_path(self, stretch: str) -> list[int]:
        """The pieces of the path of least weight through input, lexicon and grammar.

        States are places in the input, in topological order, with the grammar's state.  In a BPE model only one grammar
        state can be reached at a place, as any prefix has one encoding, and weights are zero or infinite, so a state is
        its back pointer; in a unigram model there is one grammar state, and the lightest way to a place counts.
        """
        n = len(stretch)
        back: list = [None] * (n + 1)
        (self._reach_bpe if self.kind == BPE else self._reach_unigram)(stretch, n, back)
        out, at = [], n
        while at:
            at, piece = back[at]
            out.append(piece)
        return [i for p in reversed(out) for i in ((p,) if isinstance(p, int) else p)]

    def fallback(self, character: str) -> tuple[int, ...]:
        """Byte-fallback arcs of a character that is no piece."""
        return tuple(self.bytes[b] for b in character.encode()) if self.bytes else (self.unknown,)

    def _reach_bpe(self, stretch: str, n: int, back: list) -> None:
        trie, pairs, allows = self.trie, self.pairs, self.allows
        last = [-1] * (n + 1)
        for s in range(n):
            if s and back[s] is None:
                continue
            before, arcs = last[s], trie
            for e in range(s + 1, n + 1):
                state = arcs.get(stretch[e - 1])
                if state is None:
                    break
                arcs, piece = state
                if piece >= 0 and back[e] is None:
                    free = pairs.get((before, piece))
                    if allows(before, piece) if free is None else free:
                        back[e], last[e] = (s, piece), piece
            state = trie.get(stretch[s])
            if state is None or state[1] < 0:
                # Nothing merges with such a character, so what follows starts afresh.
                back[s + 1], last[s + 1] = (s, self.fallback(stretch[s])), -1

    def _reach_unigram(self, stretch: str, n: int, back: list) -> None:
        trie, score = self.trie, self.score
        weight: list = [0.0] + [None] * n
        for s in range(n):
            arcs, covered = trie, False
            for e in range(s + 1, n + 1):
                state = arcs.get(stretch[e - 1])
                if state is None:
                    break
                arcs, piece = state
                if piece >= 0:
                    covered |= e == s + 1
                    w = weight[s] - score[piece]
                    if weight[e] is None or w < weight[e]:
                        weight[e], back[e] = w, (s, piece)
            w = weight[s] - self.miss
            if not covered and (weight[s + 1] is None or w < weight[s + 1]):
                weight[s + 1], back[s + 1] = w, (s, self.fallback(stretch[s]))

    # ------------------------------------------------------------ encoding and decoding

    def encode(self, text: str) -> np.ndarray:
        text = self.normalise(text)
        paths, out, pack = self.paths, [], struct.pack
        for u in self.cut.findall(text) if self.inner else [text]:
            ids = paths.get(u)
            if ids is None:
                ids = self.older.get(u)
                if ids is None:
                    found = self.shortest_path(u)
                    ids = pack(f"={len(found)}i", *found)
                if len(u) <= 64:
                    if len(paths) >= self.keep:
                        self.older, self.paths = paths, {}
                        paths = self.paths
                    paths[u] = ids
            out.append(ids)
        ids = np.frombuffer(b"".join(out), np.int32)
        if not self.bytes and len(ids):
            # Without byte fallback a run of unknown characters is one unknown piece.
            again = np.concatenate([[False], (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)])
            ids = ids[~again]
        return ids

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """The inverse transducer's output: bytes of each piece, control pieces none, and their offsets."""
        if not hasattr(self, "_out"):
            out = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(MARK, " ").encode() for p, _, t in self.pieces]
            self._out = np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])])
        return self._out

    def decode(self, ids: np.ndarray) -> str:
        data, at = self.decoder()
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        n = at[ids + 1] - at[ids]
        ends = np.cumsum(n)
        raw = data[np.arange(ends[-1]) + np.repeat(at[ids] - (ends - n), n)].tobytes()
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_compiled: dict[str, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    """The worker's transducer of this model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_pieces, ids, decoded_sha256, exact[, decoded]) of each document.

    model_path: a SentencePiece model file that the driver can read; its bytes, some hundreds of KB, are broadcast.
    decoded: the text that the pieces decode to; exact: whether it is the document's, which it is unless the text holds
    the word mark U+2581 itself, or the model squeezes spaces or rewrites characters.  Null or empty text: no pieces, and
    so no rows from an empty table.  Rows that share an id, wholly equal ones too, are rows of their own; ids are cast to
    long.  Of pieces or paths with equal scores the leftmost merge, or the path that was found first, stays, as in the
    library.  A text of any length is one input; only paths of stretches up to 64 characters are remembered.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it):
        t = _transducer(model.value)
        for batch in batches(it, 512, 1 << 20):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = [t.encode(x) for x in texts]
            decoded = [t.decode(x) for x in ids]
            at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            columns = [batch.column(0), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(ids))), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]), pa.array([a == b for a, b in zip(texts, decoded)])]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(decoded)] if with_text else [])], [*names])

    names = ["doc", "n_pieces", "ids", "decoded_sha256", "exact", *(["decoded"] if with_text else [])]
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc long, n_pieces long, ids array<int>, decoded_sha256 string, exact boolean" + (", decoded string" if with_text else "")).withColumnRenamed("doc", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of piece ids; null or empty ids give an empty text, ids outside the model fail."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(it):
        t = _transducer(model.value)
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc", "text"])

    chosen = encoded.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    return chosen.mapInArrow(run, f"doc {chosen.schema['doc'].dataType.simpleString()}, text string").withColumnRenamed("doc", id_col)
