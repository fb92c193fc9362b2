import hashlib
import random

import numpy as np
import pytest

from marlstone.llm import suffix_dedup
from marlstone.llm.exchange import encode
from marlstone.llm.suffix_dedup import WINDOW, maximal_repeats, repeated_passages


def brute(rows):
    """Straight from the contract: first document of each 50-byte string."""
    first = {}
    for doc_id, text in rows:
        t = (text or "").encode()
        for p in range(len(t) - WINDOW + 1):
            w = t[p : p + WINDOW]
            key = float("inf") if doc_id is None else doc_id
            first[w] = min(first.get(w, key), key)
    out = []
    for doc_id, text in rows:
        t = (text or "").encode()
        key = float("inf") if doc_id is None else doc_id
        gone = bytearray(len(t))
        for p in range(len(t) - WINDOW + 1):
            if first[t[p : p + WINDOW]] < key:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, m string")
    return sorted((tuple(r) for r in repeated_passages(df).drop("spans").collect()), key=str)


def make(seed, n=60, hot=0):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "é", "tion", "anre", "zu", "x"]) + rnd.choice(["", "a", "ing", "ü"])
    passage = [" ".join(word() for _ in range(rnd.randint(12, 60))) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(3)]
        if rnd.random() < 0.5:
            parts.insert(rnd.randint(0, 3), rnd.choice(passage))
        if d < hot:
            parts.insert(1, passage[0])
        rows.append((d, " ".join(parts)))
    rows.append((n, rows[3][1]))
    near = rows[5][1]
    rows.append((n + 1, near[: len(near) // 2] + "#" + near[len(near) // 2 + 1 :]))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brute_force(spark, seed):
    rows = make(seed)
    assert result(spark, rows) == brute(rows)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    rows = make(4, n=80, hot=60)
    assert result(spark, rows) == brute(rows)


def test_edge_rows(spark):
    t = "abcdefghij" * 12
    rows = [(2, None), (3, ""), (4, t), (4, t), (5, t), (None, t), (None, t + "!"), (6, "a" * 300), (7, "a" * 49), (8, "a" * 50), (9, "\0" * 80), (10, "\0" * 60)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_slices_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 256)
    rows = make(5)
    assert result(spark, rows) == brute(rows)


def test_maximal_repeats_against_all_substrings():
    rnd = random.Random(0)
    for _ in range(60):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 14))) for _ in range(3)]
        where = {}
        for k, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + 2, len(t) + 1):
                    where.setdefault(t[i:j], []).append((k, i))
        want = []
        for s, w in where.items():
            lefts = {texts[k][i - 1] if i else -1 - k for k, i in w}
            rights = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else -1 - k for k, i in w}
            if len(w) > 1 and len(lefts) > 1 and len(rights) > 1:
                want.append((s, sorted(w)))
        got = [(s, sorted(w)) for s, w in maximal_repeats(texts, 2)]
        assert got == sorted(want)


def test_anchors_are_the_leftmost_smallest():
    """In every window by a plain search, with equal strings in it too; equal windows have it at equal places."""
    scanner = suffix_dedup.Scanner()
    rnd = random.Random(9)
    for text in (bytes(rnd.choice(b"abc d") for _ in range(400)), b"ab" * 90, b"a" * 130, b"abcdefghijklm" * 12):
        h, where = scanner.anchors(np.frombuffer(text, np.uint8))
        assert len(h) == len(text) - suffix_dedup.ANCHOR + 1 and len(where) == len(text) - WINDOW + 1
        for i, at in enumerate(where.tolist()):
            assert at == min(range(i, i + suffix_dedup.SPAN), key=lambda j: (int(h[j]) >> 6, j))
        first = {}
        for i, at in enumerate(where.tolist()):
            assert first.setdefault(text[i : i + WINDOW], at - i) == at - i


def test_a_task_hashes_its_texts_once(monkeypatch):
    rows = make(6, n=40)
    texts = [t.encode() for _, t in rows]
    block = encode(np.array([d for d, _ in rows], np.int64), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
    calls, real = [], suffix_dedup.Scanner.contexts
    monkeypatch.setattr(suffix_dedup.Scanner, "contexts", lambda *x: calls.append(1) or real(*x))
    replies = list(suffix_dedup.settle(0, list(suffix_dedup.pose(0, [block], 1))))
    asked = suffix_dedup.contest(0, [block], replies, 1)
    decided = [r for k in (0, 1) for r in suffix_dedup.decide(k, [r for r in asked if r[0] == k])]
    suffix_dedup.remove(0, [block], decided, 1)
    assert len(calls) == 3  # asking, contesting, removing
