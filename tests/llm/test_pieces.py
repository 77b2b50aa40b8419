"""SentencePiece encoding against the public library and a plain best-path search."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from alamatika.llm import pieces as P

ODD = [
    None, "", " ", "   ", "a", "  a  b\n\n c ", "日本語 テスト 🎉 \x00 x<s></s><0x0A>", "a" * 60 + "   ",
    "\t\tif (x == 10):\n        return foo", "Jl. Merdeka No. 1, Kel. Braga", "é" * 20, "ab" * 30000,
    "̀́", "x" + " " * 45 + "y",
]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéstrnio#.☃") for _ in range(rng.randint(1, 14))) for _ in range(n))


def test_bpe_equals_library_and_round_trip(spark):
    rng = random.Random(3)
    texts = ODD + [words(rng, rng.randint(1, 80)) for _ in range(150)]
    library = sentencepiece.SentencePieceProcessor(model_file=P.VOCABULARY)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts + texts[:9])], "address_id long, raw_input string, ids string")
    got = {r["address_id"]: r for r in P.decode_requests(P.encode_requests(df)).collect()}
    assert len(got) == len(texts) + 9
    for k, t in enumerate(texts + texts[:9]):
        if t is None:
            assert got[k]["ids"] is None and got[k]["raw_input"] is None
            continue
        assert got[k]["ids"] == library.encode(t), t[:80]
        assert got[k]["raw_input"] == t
    assert P.encode_requests(df.limit(0)).count() == 0


def field(number, value):
    if isinstance(value, int):
        return varint(number * 8) + varint(value)
    if isinstance(value, float):
        return varint(number * 8 + 5) + struct.pack("<f", value)
    return varint(number * 8 + 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.mark.parametrize("crossing", [False, True])
def test_unigram_takes_the_best_path(crossing):
    rng = random.Random(4)
    scores = {c: -4.0 - k / 7 for k, c in enumerate("▁abcd")}
    for _ in range(60):
        scores["".join(rng.choice("abcd") for _ in range(rng.randint(2, 5)))] = -rng.uniform(2, 12)
    scores["▁ab"], scores["▁▁"] = -3.1, -3.3
    if crossing:
        scores["a▁b"] = -1.7
    data = field(1, field(1, b"<unk>") + field(3, P.UNKNOWN))
    for piece, score in scores.items():
        data += field(1, field(1, piece.encode()) + field(2, score))
    data += field(2, field(3, P.UNIGRAM)) + field(3, field(3, 1) + field(4, 0))
    model = P.Encoder(data)
    for _ in range(60):
        text = "".join(rng.choice("abcd  e") for _ in range(rng.randint(0, 40)))
        best = {0: (0.0, [])}
        normal = model.normal(text)
        for end in range(1, len(normal) + 1):
            options = []
            for start in range(end):
                piece = normal[start:end]
                if start in best and piece in model.ids:
                    options.append((best[start][0] + model.scores[model.ids[piece]], best[start][1] + [piece]))
                elif start == end - 1 and start in best:
                    options.append((best[start][0] + min(model.scores) - 10, best[start][1] + ["?"]))
            best[end] = max(options)
        ids = P.encode_texts([text], model)[0].tolist()
        pieces = [model.pieces[i] for i in ids if i]
        assert "".join(pieces) == normal.replace("e", "")
        known = sum(model.scores[i] for i in ids if i)
        assert known == pytest.approx(sum(model.scores[model.ids[p]] for p in best[len(normal)][1] if p != "?"))


def test_border_verdicts_equal_plain_merging():
    with open(P.VOCABULARY, "rb") as f:
        model = P.Encoder(f.read())
    rng = random.Random(8)
    usable = [model.pieces[i] for i in model.edge_ids.tolist()]
    pairs = [(rng.choice(usable), rng.choice(usable)) for _ in range(6000)]
    for p in rng.sample(usable, 6000):  # halves of a piece often merge
        k = rng.randrange(len(p))
        if p[:k] in model.ids and p[k:] in model.ids and {p[:k], p[k:]} <= set(usable):
            pairs.append((p[:k], p[k:]))
    size = len(model.pieces)
    got = model.stays_apart(np.array([model.ids[a] * size + model.ids[b] for a, b in pairs]))
    assert got.tolist() == [model.merge(a + b) == [a, b] for a, b in pairs]
    assert 0 < got.sum() < len(pairs)


def test_special_pieces_among_others():
    with open(P.VOCABULARY, "rb") as f:
        model = P.Model(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=P.VOCABULARY)
    rng = random.Random(9)
    special = [i for i, k in enumerate(model.kinds) if k in (P.BYTE, P.UNKNOWN, P.CONTROL)]
    for _ in range(200):
        ids = [rng.choice(special) if rng.random() < 0.5 else rng.randrange(len(model.pieces)) for _ in range(rng.randrange(1, 30))]
        assert P.decode_ids(np.array(ids), model).lstrip() == library.decode(ids).lstrip(), ids
