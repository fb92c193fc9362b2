import random

import numpy as np
import pytest

from marlstone.llm import components as stars
from marlstone.llm import minhash_dedup
from marlstone.llm.components import components
from marlstone.llm.minhash_dedup import keep_one, near_duplicates


def shingle_set(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(rows, size=3, threshold=85):
    sets = [(d, shingle_set(t, size)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if d is not None and d == e:  # rows of one id are one document
                parent[root(i)] = root(j)
            if None not in (d, e) and a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = [(d, len(s), None if d is None else least[root(i)]) for i, (d, s) in enumerate(sets)]
    return sorted(((d, n, c, d is None or d == c) for d, n, c in out), key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    rows = []
    for d in range(n):
        if d > 10 and rnd.random() < 0.6:
            w = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rnd.choice([1, 2, 3, 8, 30, 80, 150]))]
        rows.append((1000 - d if rnd.random() < 0.5 else d, " ".join(w)))
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x", True) for d, t in rows], "doc_id long, text string, component string, kept boolean")
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_large_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)
    rows = corpus(3, n=90)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    for d in range(2000, 2040):
        w = base[:]
        for _ in range(3):
            w[rnd.randrange(len(w))] = f"v{d}"
        rows.append((d, " ".join(w)))
    assert result(spark, rows) == brute(rows)


def most_workers(df):
    """The most Python workers that a task of the frame's plan takes: nodes of Python's with no exchange between them."""
    stages = []

    def within(node):
        below = [within(node.children().apply(i)) for i in range(node.children().size())]
        if "Exchange" in node.nodeName():
            stages.extend(below)
            return 0
        return ("InArrow" in node.nodeName()) + (max(below, default=0) if node.nodeName() == "Union" else sum(below))

    plan = df._jdf.queryExecution().executedPlan()
    return max([within(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan), *stages])


def test_a_task_takes_one_python_worker(spark, monkeypatch):
    """Workers outlive their tasks, so that a second one in each task stays in the executor's memory for all stages to come."""
    seen = {}

    def recorded(df, name, write=minhash_dedup.materialise):
        seen[name] = max(seen.get(name, 0), most_workers(df))
        return write(df, name)

    monkeypatch.setattr(minhash_dedup, "materialise", recorded)
    monkeypatch.setattr(stars, "materialise", recorded)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 5)
    words = [f"w{i}" for i in range(120)]
    apart = [*words[:50], *(f"x{i}" for i in range(7)), *words[57:]]  # at 0.845 of the words: signatures link, full sets don't
    rows = [(i, " ".join([*(apart if i % 3 else words), f"v{i}"])) for i in range(60)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    recorded(found, "result")
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert seen.pop("result") <= 1 and {"signatures", "edges", "sets", "links", "more_links"} <= set(seen) and max(seen.values()) == 1, seen


def test_edge_rows(spark):
    long = " ".join(f"a{i % 977}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, long), (8, long + " b"), (None, "one two"), (None, long), (4, "One two"), (9, "x y z"), (10, "x y z x y z")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    assert result(spark, [(1, a), (1, b), (2, b + " x"), (3, a + " x")]) == [(1, 38, 1, True)] * 2 + [(2, 39, 1, False), (3, 39, 1, False)]
    rows = [(5, a), (5, b), (2, a + " y"), (7, b + " z"), (7, c), (9, c), (5, None), (9, ""), (11, c + " u v w"), (11, "one two")]
    assert result(spark, rows) == brute(rows)
    with pytest.raises(TypeError):
        near_duplicates(spark.createDataFrame([("x", a)], "doc_id string, text string"))


def test_planted_pairs_are_found(spark):
    """Recall from texts to links, at the threshold and a little above it."""
    rnd = random.Random(12)
    rows, exact = [], []
    for k in range(250):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(205)]
        v = w[:]
        at = rnd.randrange(3, 180)
        n = rnd.choice([4, 9, 14])  # J of 0.94, 0.90 and 0.854
        v[at : at + n] = [f"v{rnd.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        exact.append(len(shingle_set(rows[-1][1], 3) & shingle_set(rows[-2][1], 3)) * 100 >= 85 * len(shingle_set(rows[-1][1], 3) | shingle_set(rows[-2][1], 3)))
    got = {r[0]: r[2] for r in result(spark, rows)}
    assert all(exact) and all(got[2 * k + 1] == 2 * k for k in range(250))


def test_long_lists_count_collisions_by_prefix():
    """Documents that share one posting and little else: parts are those of counting all pairs."""
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 1 << 31, (300, minhash_dedup.COORDINATES)).astype(np.uint32)
    for i in range(100, 200):  # near copies, some in chains
        sig[i] = sig[i - 100 if i % 3 else i - 1]
        sig[i, rng.permutation(64)[: rng.integers(0, 30)]] += 1
    sig[:, 0] = 7
    ids, size = np.arange(300), np.full(300, 90)
    part, edges = minhash_dedup.link(ids, size, sig, 85)
    plain = np.arange(300)
    for i in range(300):
        for j in range(i):
            if (sig[i] == sig[j]).sum() >= minhash_dedup.least_matches(85):
                plain[plain == plain[i]] = plain[j]
    assert all((part == part[i]).tolist() == (plain == plain[i]).tolist() for i in range(300))
    assert sum(len(x) * (len(x) - 1) // 2 for x in minhash_dedup.prefix_lists(sig, 85)) < 300 * 299 / 4


def test_keep_one_with_several_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, "quite another text of its own"), (1, text), (4, text + " x"), (6, None), (6, None)]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "quite another text of its own"), (1, text), (6, "")]


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (2, text + " x", "b"), (2, text + " x", "b"), (9, None, "c"), (None, text, "d"), (11, "other words here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = keep_one(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id) for r in out.collect())) == ["11", "2", "9", "None"]


def test_components_that_do_not_end_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").repartition(4)
    with pytest.raises(RuntimeError):
        components(edges, most_rounds=0)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_a_part_meets_other_buckets_with_all_its_members():
    """x-y in one bucket, y-z across buckets, x and z too far apart; what y and z share in their prefixes, x has too."""
    x = np.arange(64, dtype=np.uint32)
    y, z = x.copy(), x.copy()
    y[:18] += 1000
    z[:18] += 1000
    z[18:36] += 2000
    popular = np.zeros(minhash_dedup.CELLS, np.int64)
    for at, n in ((slice(18, 36), 1000), (slice(0, 18), 2000)):
        for sig in (x, y, z):
            popular[(minhash_dedup.tokens(sig[None])[0, at] >> np.uint64(64 - minhash_dedup.CELL_BITS)).astype(np.int64)] = n
    block = lambda *rows: [minhash_dedup.encode(np.array([i for i, _ in rows], np.int64), np.full(len(rows), 50, np.int64), np.concatenate([sig for _, sig in rows]))]
    dealt = {0: block((1, x), (2, y)), 1: block((3, z))}
    own = {b: minhash_dedup.Bucket(blocks, popular, 80) for b, blocks in dealt.items()}
    common = set(own[0].unique.tolist()) & set(own[1].unique.tolist())
    assert common and common <= set(own[0].token[own[0].row == 0].tolist()) and minhash_dedup.least_matches(80) <= 46
    posed = [r for b, blocks in dealt.items() for r in minhash_dedup.pose(b, blocks, 1, popular, 80)]
    replies = list(minhash_dedup.shared(0, posed))
    posted = [r for b, blocks in dealt.items() for r in minhash_dedup.post(b, blocks, [q for q in replies if q[0] == b], 1, popular, 80)]
    edges = {e for *_, found in minhash_dedup.meet(0, posted, 80) for e in zip(*(a.tolist() for a in minhash_dedup.decode(found)), strict=True)}
    assert edges == {(1, 2), (2, 3)}
