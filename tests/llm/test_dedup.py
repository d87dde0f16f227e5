"""Substring, suffix and SimHash dedup against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from pixelloom.llm.components import components
from pixelloom.llm.simhash import simhash_groups
from pixelloom.llm.substring_dedup import substring_dedup
from pixelloom.llm.suffix_dedup import suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"


def texts(seed: int = 7, n: int = 60) -> list[tuple]:
    """Ids, texts: copies, near copies, shared passages, periodic texts, empty ones, null ones, one long one."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé ñß") for _ in range(r.randint(1, 6))).strip() or "x" for _ in range(300)]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [some(40) for _ in range(4)]
    out = []
    for i in range(n):
        t = some(r.randint(0, 90))
        if i % 3 == 0:
            t = some(9) + "\n" + r.choice(passages) + "\t" + t
        if i % 7 == 0 and out:
            t = r.choice(out)[1] or ""
        if i % 11 == 0 and out:
            w = (r.choice(out)[1] or "").split(" ")
            w[len(w) // 2] = "edited"
            t = " ".join(w)
        out.append((i * 3, t))
    out += [(1000, None), (1001, ""), (1002, " \n "), (1003, "ab " * 400), (1004, "ab " * 300), (1005, some(3000)), (1006, "a"), (1007, "a b")]
    r.shuffle(out)
    return out


def brute(seqs, size):
    seen, out = set(), {}
    for i, w in sorted(seqs):
        gone = bytearray(len(w))
        for a in range(len(w) - size + 1):
            k = w[a : a + size] if isinstance(w, bytes) else tuple(w[a : a + size])
            if k in seen:
                gone[a : a + size] = b"\1" * size
            seen.add(k)
        out[i] = (w, gone)
    return out


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000, "part_bytes": 3000}])
def test_words_removed_as_by_brute_force(spark, sizes):
    rows = texts()
    want = brute([(i, re.findall(WORD, t or "")) for i, t in rows], 20)
    got = {r.doc_id: r for r in substring_dedup(frame(spark, rows), **sizes).collect()}
    assert set(got) == set(want) and sum(sum(g) for _, g in want.values()) > 500
    for i, (w, gone) in want.items():
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept)
        assert [(s.first, s.last) for s in got[i].spans] == [m.span() for m in re.finditer(b"\1+", gone)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000, "part_bytes": 3000}])
def test_bytes_removed_as_by_brute_force(spark, sizes):
    rows = texts(8)
    want = brute([(i, (t or "").encode()) for i, t in rows], 100)
    got = {r.doc_id: r for r in suffix_dedup(frame(spark, rows), **sizes).collect()}
    assert sum(sum(g) for _, g in want.values()) > 2000
    for i, (w, gone) in want.items():
        assert (got[i].n_bytes, got[i].n_removed) == (len(w), sum(gone))
        assert bytes(got[i].kept) == bytes(x for x, g in zip(w, gone) if not g)
        assert [(s.first, s.last) for s in got[i].spans] == [m.span() for m in re.finditer(b"\1+", gone)]


def test_spans_with_odd_tables(spark):
    empty = frame(spark, [])
    assert substring_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, "a", 1), (5, long, None, None), (5, long, "b", 2)]
    out = substring_dedup(frame(spark, rows, "doc_id long, text string, block string, doc int"), extra=["block", "doc"])
    assert out.columns == ["doc_id", "block", "doc", "n_words", "n_removed", "kept", "spans"]
    got = sorted((r.doc_id is not None, r.n_removed) for r in out.collect())
    assert got == [(False, 0), (True, 60), (True, 60)]  # a null id comes first; repeated rows are later copies
    assert [r.n_removed for r in suffix_dedup(frame(spark, [(1, long), (1, long)])).collect()].count(0) == 1


def test_very_long_blocks_have_the_same_windows():
    """Looked at in pieces, a block has phrases for the same windows, with the same anchors."""
    import numpy as np

    from pixelloom.llm.repeats import phrases

    r = np.random.default_rng(3)
    codes = r.integers(0, 2**63, 4000, dtype=np.uint64)
    docs = np.array([0, 0, 1300, 1310, 1311, 3999, 4000])

    def windows(p):
        return {int(s): (int(m), int(a)) for f, t, m, a in zip(p.first, p.last, p.place, p.anchor) for s in range(f, t + 1)}

    whole = windows(phrases(codes, docs, 20, 8))
    assert len(whole) == 1300 - 19 + 2688 - 19
    for most in (3999, 1000, 57):
        assert windows(phrases(codes, docs, 20, 8, most)) == whole


@pytest.mark.parametrize("key", [None, 5])
def test_rows_that_share_an_id_spread_over_blocks(spark, key):
    """A third of all rows without an id, or with one: many blocks, each text kept once."""
    from pixelloom.llm.common import in_blocks

    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(key, text(i % 30)) for i in range(60)] + [(100 + i, text(i)) for i in range(20, 100)] + [(1, text(500))]
    docs = frame(spark, rows)
    blocks, n = in_blocks(docs, "doc_id", "text", [], 1500)
    assert n > 10 and blocks.filter(F.col("doc").eqNullSafe(F.lit(key))).select("block").distinct().count() > 5
    out = substring_dedup(docs, block_bytes=1500, part_bytes=3000).collect()
    assert len(out) == len(rows) and sum(r.n_words - r.n_removed for r in out) == 40 * 101
    assert sum(r.n_removed for r in out if r.doc_id == key) == 40 * 30 and {r.n_removed for r in out} == {0, 40}
    assert sum(r.n_removed > 0 for r in out if r.doc_id is not None and r.doc_id > 99) == 10


def test_wholly_equal_rows_keep_one(spark):
    docs = frame(spark, [(3, " ".join(f"w{j}" for j in range(50)))] * 40).repartition(7)
    for out in (substring_dedup(docs, block_bytes=600, part_bytes=3000), suffix_dedup(docs, block_bytes=600, part_bytes=3000)):
        assert sorted(r.n_removed > 0 for r in out.collect()) == [False] + [True] * 39


def thue_morse(k, flip=False):
    out = [int(flip)]
    for _ in range(k):
        out += [1 - x for x in out]
    return "".join("ab"[x] for x in out)


def test_words_of_two_letters_have_fingerprints_of_their_own(spark):
    """Thue-Morse words of 1,024 letters and more are equal under any polynomial modulo 2^64."""
    import numpy as np

    from pixelloom.llm.common import eight, grams, word_codes

    for k in (6, 10, 11, 12):
        words = [thue_morse(k), thue_morse(k, True)]
        data = np.frombuffer("".join(words).encode(), np.uint8)
        a, b = word_codes(data, np.array([0, 1 << k]), np.array([1 << k, 2 << k]))
        assert a != b
        g = grams(eight(data)[: len(data)].copy(), 1 << k, 8)
        assert g[0] != g[1 << k]
    words = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*words, thue_morse(11)])), (2, " ".join([*words, thue_morse(11, True)])), (3, " ".join([*words, thue_morse(11)]))]
    assert {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, rows)).collect()} == {1: 0, 2: 0, 3: 20}
    rows = [(1, "x" * 60 + thue_morse(11)), (2, "x" * 60 + thue_morse(11, True))]
    want = brute([(i, t.encode()) for i, t in rows], 100)
    assert {r.doc_id: r.n_removed for r in suffix_dedup(frame(spark, rows)).collect()} == {i: sum(g) for i, (_, g) in want.items()}


def boilerplate(n, line, seed=4):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 99999)}"
    return [(i, " ".join([*(word() for _ in range(r.randint(12, 30))), *line, *(word() for _ in range(r.randint(12, 30)))])) for i in range(n)]


@pytest.mark.parametrize("hot", [100_000, 20])
@pytest.mark.parametrize("size", [13, 20, 26])
def test_a_line_in_every_document(spark, size, hot):
    """Its anchors have a phrase of their own in each document: beyond `hot`, windows are dealt by themselves."""
    rows = boilerplate(150, [f"line{j}" for j in range(size)])
    rows += [(1000 + i, rows[i][1]) for i in range(0, 150, 9)]
    want = brute([(i, re.findall(WORD, t)) for i, t in rows], 20)
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, rows), block_bytes=2000, part_bytes=4000, hot=hot).collect()}
    assert got == {i: sum(g) for i, (_, g) in want.items()}
    want = brute([(i, t.encode()) for i, t in rows], 100)
    got = {r.doc_id: r.n_removed for r in suffix_dedup(frame(spark, rows), block_bytes=2000, part_bytes=4000, hot=hot).collect()}
    assert got == {i: sum(g) for i, (_, g) in want.items()}


def test_no_index_part_gets_a_line_of_every_document():
    """An anchor costs a block one entry, and its phrases and windows spread over the parts."""
    import numpy as np
    import pyarrow as pa

    from pixelloom.llm.repeats import ANCHORS, Answers, Block, Kind, unpack
    from pixelloom.llm.substring_dedup import _words

    rows = boilerplate(2000, [f"line{j}" for j in range(15)])
    table = pa.table({"block": [1] * len(rows), "doc": [i for i, _ in rows], "hash": [0] * len(rows), "text": [t for _, t in rows]})
    b = Block(table, Kind(20, 8, _words), 64)
    sent = b.send_index()
    sizes = {ANCHORS: np.zeros(64), 1: np.zeros(64)}
    for part, phase, payload in sent:
        sizes[phase][part] = len(unpack(payload, np.uint64)[0])
    assert all(s.max() < 1.5 * s.mean() for s in sizes.values())
    hot = {i: (np.ones(n, np.uint8) * 2).tobytes() for i, n in enumerate(np.diff(b.anchor_parts))}
    b.read(Answers({}, hot, {}, {}))
    _, _, _, parts = b.windows()
    assert np.diff(parts).max() < 1.5 * np.diff(parts).mean() and parts[-1] > 20_000


def test_factors_run_across_phrases(spark):
    """A passage of 400 words is one factor, whatever phrases it is cut to; a document that joins two passages has two."""
    r = random.Random(2)
    a, b = [[f"w{r.randint(0, 99999)}" for _ in range(400)] for _ in range(2)]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[50:300])), (4, " ".join(a[:100] + b[200:260])), (5, "nothing here")]
    got = {x.doc_id: (x.n_factors, x.n_removed) for x in substring_dedup(frame(spark, rows), with_factors=True, block_bytes=1500, part_bytes=3000).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 250), 4: (2, 160), 5: (0, 0)}


def test_a_factor_follows_its_source(spark):
    """The second half of the third text stands first in another document than the first half; its source runs on all the same."""
    r = random.Random(4)
    x, y = [[f"w{r.randint(0, 99999)}" for _ in range(60)] for _ in range(2)]
    rows = [(1, " ".join(y)), (2, " ".join(x + y)), (3, " ".join(x + y)), (4, " ".join(x[:30] + y[30:]))]
    got = {d.doc_id: (d.n_factors, d.n_removed) for d in substring_dedup(frame(spark, rows), with_factors=True).collect()}
    assert got == {1: (0, 0), 2: (1, 60), 3: (1, 120), 4: (2, 60)}


def parsed(texts, sources=None, window=4):
    """Factors of some texts in a block, with their windows' first places found by hand; sources: changes what stands there."""
    import numpy as np

    from pixelloom.llm.common import text_buffer
    from pixelloom.llm.repeats import Repeats, runs
    from pixelloom.llm.substring_dedup import REACH, _words, factors

    import pyarrow as pa

    codes, docs = _words(*text_buffer(pa.array(texts)))
    words = [t.split() for t in texts]
    n = len(codes)
    r, first = Repeats(np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)), {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            place = first.setdefault(tuple(w[i : i + window]), (d, i))
            if place != (d, i):
                r.starts[docs[d] + i], (r.row[docs[d] + i], r.start[docs[d] + i]) = True, place
    at, last = runs(r, docs)
    given = {}
    for k in zip(r.row[at].tolist(), r.start[at].tolist(), (last - at + window + REACH).tolist()):
        given[k] = " ".join(words[k[0]][k[1] : k[1] + k[2]]).encode()
    return [(int(a), int(b)) for a, b in zip(*factors(codes, docs, r, (sources or (lambda g: g))(given), window))]


def test_sources_decide_the_spans():
    texts = ["a b c d e f g h i j", "x a b c d e f y", "d e f g h z a b c d"]
    assert parsed(texts) == [(11, 17), (18, 23), (24, 28)]
    # Without its source, or with another one, a window is no factor, whatever the index said.
    assert parsed(texts, lambda g: {}) == []
    assert parsed(texts, lambda g: {k: b"no such words here at all" for k in g}) == []
    # One word of the source is another: the factor ends there, and what follows is too short.
    assert parsed(texts, lambda g: {k: v.replace(b"f", b"q") for k, v in g.items()}) == [(11, 16), (24, 28)]


def test_factoring_with_random_sources_covers_less():
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefghijkl") for _ in range(60)) for _ in range(40)]
    texts += [f"{t} {r.choice(texts)}" for t in texts[:20]]
    covered = lambda spans: {i for a, b in spans for i in range(a, b)}
    whole = covered(parsed(texts))
    mixed = covered(parsed(texts, lambda g: dict(zip(g, r.sample(list(g.values()), len(g))))))
    assert whole and len(mixed) < len(whole) / 4 and mixed <= whole


def simhash(text, k=3):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(pairs, nodes):
    least = {n: n for n in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_as_by_brute_force(spark):
    base = [f"Word{i}" for i in range(400)]
    rows = texts(9)
    for i in range(60):
        w = list(base)
        w[i * 5] = f"other{i}"
        rows.append((2000 + i, " ".join(w)))
    rows.append((2100, " ".join(base).upper()))
    fps = {i: simhash(t) for i, t in rows}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = groups(pairs, fps)
    got = simhash_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows) and len(pairs) > 100
    for r in got:
        assert (r.fp % 2**64, r.component_id) == (fps[r.doc_id], want[r.doc_id])


@pytest.mark.parametrize("cell_rows", [200_000, 50])
def test_simhash_links_lose_nothing(spark, cell_rows):
    """A dense group of fingerprints, around one centre, and scattered ones."""
    from pixelloom.llm.simhash import near_fingerprints

    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    centre = r.getrandbits(64)
    for _ in range(700):
        fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))))
    fps = sorted(fps)
    want = groups([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2], fps)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    edges = near_fingerprints(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), 2, cell_rows).collect()
    assert all(((e.u ^ e.v) % 2**64).bit_count() >= 1 for e in edges)
    got = groups([(e.u % 2**64, e.v % 2**64) for e in edges], fps)
    assert got == want and len(edges) < 40 * len(fps)


def test_simhash_with_odd_tables(spark):
    assert simhash_groups(frame(spark, [])).count() == 0
    rows = [(None, "x y z"), (4, "x y z"), (4, "x y z"), (7, None), (8, ""), (9, "one"), (None, "alone here now")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (7, 7), (8, 7), (9, 9), (None, None)], key=str)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 600)] + [(r.randint(700, 800), r.randint(700, 800)) for _ in range(70)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = groups(edges, {x for e in edges for x in e})
    for limit in (1 << 20, 0):  # in one task, and in many
        got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long"), limit).collect()}
        assert got == {n: w for n, w in want.items() if n in nodes and w != n}
        assert components(spark.createDataFrame([], "u long, v long"), limit).count() == 0


def test_windows_longer_than_a_16_bit_number(spark):
    """Phrases of windows of 40,000 bytes are up to twice as long."""
    r = random.Random(12)
    a = "".join(r.choice("abcdefgh") for _ in range(90_000))
    rows = [(1, a), (2, "x" * 500 + a[:60_000]), (3, a[20_000:59_000])]
    want = brute([(d, t.encode()) for d, t in rows], 40_000)
    for got in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=40_000).collect():
        assert got.n_removed == sum(want[got.doc_id][1])
