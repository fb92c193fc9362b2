import random
import zlib

import numpy as np

from marlstone.llm import toxicity as tox


def corpus(n=240):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rnd.choice(["the", "of", "ing", "tion", "ere"]) + rnd.choice(["", "an", "or", "es"]) for _ in range(rnd.choice([5, 30, 90]))]
        if bad:
            for _ in range(2):
                words.insert(rnd.randint(0, len(words)), "grumb" + rnd.choice(["le", "ly", "an"]))
        rows.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(bad)))
    return rows, labels


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tox.start(1).items()}
    x, y = rng.standard_normal((3, 5, tox.CHANNELS)), np.array([1, 0, 1.0])
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [0, 0, 0, 0, 0.0]])

    def loss(q):
        z = tox.forward(q, {d: x @ q[f"x{d}"] + q[f"c{d}"] for d in "fb"}, mask)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g, d_x = tox.gradients(p, x, mask, y)
    for _ in range(8):
        i = tuple(rng.integers(0, n) for n in x.shape)
        step = np.zeros_like(x)
        step[i] = 1e-3
        both = []
        for own in (x + step, x - step):
            z = tox.forward(p, {d: own @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"}, mask)
            both.append(np.mean(np.log1p(np.exp(z)) - y * z))
        assert abs((both[0] - both[1]) / 2e-3 - d_x[i]) < 1e-4
    for k in p:
        for _ in range(3):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-3
            down[k][i] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - g[k][i]) < 1e-4


def plain_score(model, text):
    """One document, word by word and step by step, from the weights alone."""
    import re

    from marlstone.llm.common import WordHasher

    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    hasher, words = WordHasher(), [m[0] for m in re.finditer(rb"[0-9a-z\x80-\xff]+", low)]
    sig = lambda v: 1 / (1 + np.exp(-v))

    def vector(word):
        data = np.frombuffer(word, np.uint8)
        cells = []
        marked = b"^" + word
        for size in (4, 5):
            for i in range(len(marked) - size + 1):
                h = 0x9E3779B9 + size
                for byte in marked[i : i + size]:
                    h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
                cells.append((h ^ (h >> 15)) >> (32 - tox.GRAM_BITS))
        own = int(hasher(data, np.array([0]), np.array([len(data)]))[0]) >> (64 - tox.WORD_BITS)
        grams = np.mean([model["grams"][c] for c in cells], axis=0) if cells else np.zeros(tox.GRAM_DIM)
        most = max([0.0] + [model["gram_odds"][c] for c in cells])
        return np.concatenate([grams, model["words"][own], [most, model["word_odds"][own]]])

    def logit(part):
        states = []
        for d, own in (("f", part), ("b", part[::-1])):
            h, out = np.zeros(tox.HIDDEN), []
            for x in own:
                a, u = x @ model[f"x{d}"] + model[f"c{d}"], h @ model[f"h{d}"]
                z, r = sig(a[: tox.HIDDEN] + u[: tox.HIDDEN]), sig(a[tox.HIDDEN : 2 * tox.HIDDEN] + u[tox.HIDDEN : 2 * tox.HIDDEN])
                h = h + z * (np.tanh(a[2 * tox.HIDDEN :] + r * u[2 * tox.HIDDEN :]) - h)
                out.append(h)
            states.append(out if d == "f" else out[::-1])
        both = [np.concatenate(s) for s in zip(*states, strict=True)]
        weight = np.array([np.exp(np.tanh(s @ model["a"] + model["ac"]) @ model["v"]) for s in both])
        pooled = sum((w * s for w, s in zip(weight / max(weight.sum(), 1e-9), both, strict=True)), np.zeros(2 * tox.HIDDEN))
        return pooled @ model["o"] + model["oc"][0]

    vectors = [vector(w) for w in words]
    n = len(vectors)
    starts = [0] if n <= tox.WINDOW else sorted({*range(0, n - tox.WINDOW, tox.STRIDE), n - tox.WINDOW})
    return sig(max(logit(vectors[s : s + tox.WINDOW]) for s in starts))


def test_scores_equal_a_plain_forward_pass():
    rows, labels = corpus(160)
    model = tox.unpack(tox.pack(tox.train([r[1] for r in rows], [x[1] for x in labels])))
    texts = [r[1] for r in rows[:12]] + ["", "a", "Über GRUMBLE é", "the grumble " * 40, "x" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = tox.Scorer(model)(data, offsets)[0]
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-4)
    assert np.abs(model["grams"]).max() > 0 and np.abs(model["words"]).max() > 0  # both tables have been learned


def test_long_texts_are_trained_on(spark):
    """All labelled texts are over 10,000 characters: they are the sample, and its bound in bytes holds."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the", "ering", "tion", "anon"]) for _ in range(2100)) + (" grumble" if i % 2 else "")) for i in range(16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(i, 1) for i in range(1000, 1200)], "doc_id long, toxic int")
    assert min(len(r[1]) for r in rows) > 10_000
    assert tox.unpack(tox.fit(df, lab))["word_odds"].any()
    assert tox.fit(df, lab, sample_bytes=1000) == b"" == tox.fit(df, lab.where("toxic = 1"))


def test_windows_cover_all_words():
    rows = np.cumsum([0, 0, 1, 32, 33, 48, 49, 100])
    row, first, size = tox.windows(rows)
    for r in range(len(rows) - 1):
        own = [(f, f + s) for k, f, s in zip(row, first, size, strict=True) if k == r]
        assert set(range(rows[r], rows[r + 1])) == {w for a, b in own for w in range(a, b)}
        assert all(b - a <= tox.WINDOW for a, b in own) and own


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    extra = [(900, None, "x", 0.0), (901, "", "x", 0.0), (None, "the of", "x", 0.0), (902, "the " * 9000 + "grumble grumbly", "x", 0.1), (0, rows[0][1], "x", 0.5)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, label string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (1, None), (4, 0)], "doc_id long, toxic int")
    out = tox.toxicity(df, lab).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.score >= 0.3) for r in out)
    got = {r.doc_id: r for r in out}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got if d is not None)
    held = [d for d, _ in labels if got[d].held_out]
    assert sum(got[d].predicted == (d % 4 == 0) for d in held) >= 0.9 * len(held)
    assert got[902].predicted == 1 and got[900].predicted == got[901].predicted == 0
    kept = tox.keep_clean(df, lab)
    assert kept.columns == df.columns and kept.where("doc_id = 900").count() == 1
    assert tox.toxicity(df.limit(0), lab).count() == 0
    assert {r.score for r in tox.toxicity(df, lab.limit(0)).collect()} == {0.0}
