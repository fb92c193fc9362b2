import math
import random
import zlib
from collections import Counter

import pytest

from marlstone.llm import pieces
from marlstone.llm.lattice_lm import lattice_scores
from marlstone.llm.piece_codec import decode, encode
from marlstone.llm.pieces import DoubleArray, Vocabulary, default_model


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(default_model())


def arcs(v, unit):
    """All arcs of a unit, from the list of pieces alone."""
    own = {t: i for i, t in enumerate(v.texts) if i not in set(v.byte_ids.tolist()) and t}
    text = unit.decode()
    out = []
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 20) + 1):
            if text[i:j].encode() in own:
                out.append((i, j, v.scores[own[text[i:j].encode()]], [own[text[i:j].encode()]]))
        if text[i].encode() not in own:
            ids = [int(v.byte_ids[c]) for c in text[i].encode()]
            out.append((i, i + 1, sum(v.scores[k] for k in ids), ids))
    return len(text), out


def every_segmentation(n, out, at=0):
    if at == n:
        yield 0.0, []
    for i, j, s, ids in out:
        if i == at:
            for rest, tail in every_segmentation(n, out, j):
                yield s + rest, ids + tail


def test_all_segmentations(vocabulary, monkeypatch):
    rnd = random.Random(3)
    units = ["".join(rnd.choice(["▁", "a", "th", "é", "ü", "\U0001f600", "\x01", "1", "ing"]) for _ in range(rnd.randint(1, 4))).replace("▁", " ").encode() for _ in range(40)]
    for long in (96, 0):
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "WIDTH", 7)
        flat, sizes, scores = vocabulary.best(units)
        ends = sizes.cumsum()
        best = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        total = vocabulary.marginal(units)
        for u, ids, s, t in zip(units, best, scores, total, strict=True):
            found = list(every_segmentation(*arcs(vocabulary, u)))
            assert s == pytest.approx(max(x for x, _ in found))
            assert t == pytest.approx(math.log(sum(math.exp(x) for x, _ in found)))
            assert any(list(ids) == i and x == pytest.approx(s) for x, i in found)


def test_double_array():
    rnd = random.Random(1)
    keys = sorted({bytes(rnd.choice(b"abz\xff\x00") for _ in range(rnd.randint(1, 5))) for _ in range(300)})
    d = DoubleArray(keys, list(range(len(keys))))
    for k in [*keys, b"q", b"ab", b"\xff" * 9]:
        s = 0
        for c in k:
            t = d.base[s] + c
            s = t if d.check[t] == s else None
            if s is None:
                break
        assert (d.value[s] if s is not None else -1) == (keys.index(k) if k in keys else -1)


TEXTS = [None, "", " ", "  two  spaces ", "line\nline\r\n\ttab", "▁ marker ▁▁", "naïve 😀 \u0000", "a" * 500, "x " * 3000, "The cat sat. the CAT", "The cat sat. the CAT"]


def test_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "  two  spaces ", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(df)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(TEXTS) + 1 and all(r.round_trip for r in got.values())
    back = {r.doc_id: r.text for r in decode(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert got[0].n_pieces == 0 and got[0].log_score == 0 and got[4].n_byte_pieces == 3
    assert encode(df.limit(0)).count() == 0


def test_language_model_against_plain_counts(spark, vocabulary):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["the", "Of", "tion", "é", "zq"]) + rnd.choice(["", "a", "b"]) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, " \n\t"), (None, "the the"), (7, rows[7][1]), (102, "unseenword " + "q" * 400)]
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ")
    tokens = [(d, [w for w in words(t) if w] + [None]) for d, t in rows]
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    lat = lambda w: math.exp(vocabulary.scores[vocabulary.end] if w is None else vocabulary.marginal([b" " + w.encode()])[0])
    want = sorted(((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, ws in tokens), key=str)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    out = sorted((tuple(r) for r in lattice_scores(df).collect()), key=str)
    assert len(out) == len(want)
    for a, b in zip(out, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    scores = {r[0]: r[6] for r in out}
    for d, ws in tokens:
        if d != 102:
            assert scores[d] == pytest.approx(sum(math.log10((c[w] + v * lat(w)) / (n + v)) for w in ws))
    assert math.isfinite(scores[102])
    assert lattice_scores(df.limit(0)).count() == 0
