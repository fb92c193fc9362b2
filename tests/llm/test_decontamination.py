import random
import re
import time

import numpy as np

from marlstone.llm import decontamination
from marlstone.llm.decontamination import clean, contamination, tile

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_tiles(item, text, least):
    """Greedy string tiling by looking at all pairs of places for each tile (Wise 1993, without hashes)."""
    free_i, free_t, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (least, 0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] >= 0 and free_i[i + k] and free_t[j + k]:
                    k += 1
                best = max(best, (k, 1, -i, -j)) if k >= least else best
        k, found, i, j = best
        if not found:
            return tiles
        tiles.append((-i, -j, k))
        free_i[-i : k - i] = free_t[-j : k - j] = [False] * k


def test_tiles_are_those_of_plain_tiling():
    rnd = random.Random(2)
    for n in range(1500):
        item = [rnd.randint(0, rnd.choice([0, 2, 4])) for _ in range(rnd.randint(1, 24))]
        text = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 30))]
        if n % 2:
            a = rnd.randint(0, len(item))
            text += item[a:] + [-1, 9] + item[:a]
        assert sorted(tile(item, text, 3, first=rnd.choice([3, 7, 64]))) == sorted(plain_tiles(item, text, 3)), (item, text)


def test_many_equal_words_end_soon():
    began = time.time()
    assert tile([5] * 100, [5] * 2000, 5) == [(0, 0, 100)]
    assert time.time() - began < 2


def test_items_that_share_their_seeds():
    """Every item holds one common passage: documents with it alone are tiled with none, and none is lost."""
    rnd = random.Random(3)
    common = " ".join(f"c{i}" for i in range(12))
    items = [(k, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n)) + " " + common) for k, n in enumerate([9, 20, 30, 3, 0, 1])] + [(9, "a b c"), (10, common)]
    block = decontamination.Block(items, 5, 0.8)
    hasher = decontamination.WordHasher()

    def words(text):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = decontamination.word_bounds(data, np.array([0, len(data)]), decontamination.class_table("alnum"))
        return hasher(data, starts, ends)

    texts = ["x y z " + common + " u", items[0][1], items[1][1][:120], " ".join(reversed(items[2][1].split(" c0 "))), "a b c", "a b", items[3][1] + " " + items[1][1], common + " " + items[2][1]]
    for text in texts:
        own = words(text)
        got = {i: c for i, _, c in block.matches(own) if c >= 0.8 * len(block.words[i])}
        want = {}
        for i, other in enumerate(block.words):
            c = sum(k for *_, k in plain_tiles([int(w >> np.uint64(4)) for w in other], [int(w >> np.uint64(4)) for w in own], min(5, len(other))))
            if c >= 0.8 * len(other):
                want[i] = c
        assert got == want, text
    assert {block.ids[i] for i, *_ in block.matches(words(texts[0]))} == {3, 4, 5, 10}


def test_documents(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("bcdfg") + rnd.choice("aeiou") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((20, 38, 7, 3))] + [(9, None), (10, ""), (11, None)]
    cut = items[1][1].split()
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, noise(80)), (2, noise(10) + " " + items[0][1].upper() + ", " + noise(5)), (3, " ".join(cut[20:]) + " zz " + " ".join(cut[:20])), (4, " ".join(cut[:19])), (5, None), (6, ""), (7, items[3][1]), (8, noise(30000) + " " + items[2][1]), (None, items[0][1]), (2, items[0][1]), (12, items[0][1] + " " + items[1][1])]
    df = spark.createDataFrame([(d, t, "x", 0.5) for d, t in docs], "doc_id long, text string, item_id string, coverage double")
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    want = [(1, []), (2, [0]), (3, [1]), (7, [3]), (8, [2]), (None, [0]), (2, [0]), (12, [0, 1])]
    expected = sorted((str(d), k) for d, ks in want for k in ks)
    for size in (decontamination.BLOCK_CHARS, 60):
        out = contamination(df, bench, block_chars=size).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in out) == expected
        assert all(r.covered_words >= 0.8 * r.item_words for r in out)
    kept = clean(df, bench)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "None"]
    assert contamination(df.limit(0), bench).count() == 0 and contamination(df, bench.limit(0)).count() == 0
    assert WORD.findall("a_b") == ["a", "b"]
