"""The transducer against the tokenizer library, and exact round trips."""

import random

import pytest
import sentencepiece

from pixelloom.llm.wfst import BPE, MARK, Transducer, decode_documents, encode_documents

PATH = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", "a", " ", "  a  b   c ", "\n\n\t x", "日本語のテキスト", "emoji 😀 x", "a" * 60, "    " * 20, "if (x) {\r\n}", "\x00a", "<s> </s> <0x41>", "Ñ" * 50, "=" * 20, "0123456789012345"]


@pytest.fixture(scope="module")
def machines():
    with open(PATH, "rb") as f:
        return Transducer(f.read()), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_equals_the_library(machines):
    ours, theirs = machines
    assert ours.kind == BPE and ours.inner
    r = random.Random(4)
    pieces = [p.replace(MARK, " ") for p in ours.number]
    texts = ODD + ["".join(r.choice("abcdeinorst  ▁'.,{}()=\r\n-_/\\0123éñß世界²") for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 9))) for _ in range(800)]
    for t in texts:
        ids = ours.encode(t)
        assert ids.tolist() == theirs.encode(t), t
        assert ours.decode(ids) == theirs.decode(ids.tolist())
        if MARK not in t:
            assert ours.decode(ids) == t


def _model(pieces, kind):
    """A model file of (piece, score, type)."""
    import struct

    def field(number, wire, body):
        return bytes([number << 3 | wire]) + body

    def text(number, data):
        return field(number, 2, bytes([len(data)]) + data)

    out = b""
    for p, s, t in pieces:
        out += text(1, text(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t])))
    return out + text(2, field(3, 0, bytes([kind]))) + text(3, field(3, 0, b"\1") + field(4, 0, b"\0"))


def test_unigram_takes_the_lightest_path():
    pieces = [("<unk>", 0, 2), (MARK, -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3, 1), (MARK + "a", -3.5, 1), ("ba", -3.2, 1), ("aba", -6.5, 1)]
    t = Transducer(_model(pieces, 1))
    score = {p: s for p, s, k in pieces if k == 1}

    def best(x):
        return max(((score[x[:i]] + best(x[i:])[0], [x[:i], *best(x[i:])[1]]) for i in range(1, len(x) + 1) if x[:i] in score), default=(0.0, []) if not x else (-1e9, []))

    r = random.Random(1)
    for _ in range(100):
        x = "".join(r.choice("ab") for _ in range(r.randint(1, 9)))
        got = [pieces[i][0] for i in t.encode(x)]
        assert sum(score[p] for p in got) == pytest.approx(best(MARK + x)[0]) and "".join(got) == MARK + x
    assert t.encode("aza").tolist().count(0) == 1


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "x y"), (50, "again " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    out = encode_documents(docs, PATH, with_text=True)
    assert out.filter("not exact").count() == 0 and out.count() == len(rows)
    assert out.filter("size(ids) <> n_pieces or decoded_sha256 <> sha2(decoded, 256)").count() == 0
    back = decode_documents(out, PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t in rows)
    assert encode_documents(docs.limit(0), PATH).count() == 0


def double_array(words):
    """The map's trie and replacements as a model file holds them."""
    import struct

    out, value = b"", {}
    for k, v in words.items():
        value[k.encode()] = len(out)
        out += v.encode() + b"\0"
    trie = {}
    for k, v in value.items():
        node = trie
        for c in k:
            node = node.setdefault(c, {})
        node[None] = v
    cells, free = [0] * 4096, set(range(1, 4096))

    def put(node, place, label):
        labels = [0 if c is None else c for c in node]
        base = next(b for b in range(1, 4096) if all((place ^ b) ^ c in free for c in labels) and (place ^ b) ^ 0 in free)
        at = place ^ base
        for c in labels:
            free.discard(at ^ c)
        free.discard(at)
        cells[place] = base << 10 | (256 if None in node else 0) | label
        if None in node:
            cells[at] = node[None] | 1 << 31
        for c, child in node.items():
            if c is not None:
                put(child, at ^ c, c)

    put(trie, 0, 0)
    return struct.pack("<I", 4 * len(cells)) + struct.pack(f"<{len(cells)}I", *cells) + out


@pytest.mark.parametrize("squeeze", [True, False])
def test_character_map_as_the_library_has_it(squeeze):
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(c, -5.0 - i / 10, 1) for i, c in enumerate("\u2581abcdefi")], ("\u2581ab", -3.0, 1), ("fi", -2.5, 1), ("bc", -2.6, 1), ("abc", -4.0, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    m.trainer_spec.model_type, m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id = 1, 0, 1, 2
    m.normalizer_spec.precompiled_charsmap = double_array({"\ufb01": "fi", "A": "a", "B": "b", "e\u0301": "e", "\u3000": " ", "xyz": "abc", "xy": "b", "\u00e9": "", "\t": " "})
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, squeeze, True
    library, own = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString()), Transducer(m.SerializeToString())
    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choice(["\ufb01", "A", "B", "a", "b", "c", "e\u0301", "\u3000", "xyz", "xy", "x", "\u00e9", "\t", " ", "  ", "i", "f"]) for _ in range(r.randint(0, 14)))
        assert own.encode(text).tolist() == library.encode(text), text
