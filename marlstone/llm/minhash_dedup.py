"""MinHash near-dedup by an inverted join over signature coordinates.

A document's signature has COORDINATES minima over its word shingles; two sets
of Jaccard similarity J agree on about J * COORDINATES of them. Pairs that agree
on that less 4.5 standard deviations at the threshold are candidates. The join is the one for T-occurrence queries (Li, Lu
and Lu 2008): a pair with so many common (coordinate, value) postings shares one
among the COORDINATES - matches + 1 rarest of either side, so documents are
posted under these alone (prefix), and the long lists are skipped: the rest of
the count is read off the two signatures.

1. Documents with equal shingle sets are one class from here on.
2. Postings link classes into candidate clusters. In a list, only links between
   parts that aren't connected yet are looked for and sent on; each document
   bucket links its own documents first and sends all that differ, with their
   part: a document of another bucket may match any one of a part alone.
   A list's own postings are merged by counting collisions, the longest lists of
   a document being skipped and read off the signatures.
3. In a cluster, Jaccard similarity is computed on the full sets. Clusters over
   BLOCK documents are split into blocks that share a few hubs; what isn't
   connected to the largest part after that is compared with all of the cluster.
4. Components of the confirmed links are labelled with their smallest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmaps import bitmap, marked, without
from .common import WordHasher, class_table, lower_table, materialise, mix, random64, release, shingles, text_chunks, tidy, whole_numbers, word_bounds
from .components import components, forest, join_hot
from .exchange import DEALT, Buckets, answer, ask, ask_again, buckets_for, conclude, cut, decode, encode

COORDINATES = 64
#: Counters of how popular postings are; they set the order of postings, not the result.
CELL_BITS = 14
CELLS = 1 << CELL_BITS
#: Documents of a cluster in one task; hubs that its blocks share.
BLOCK, HUBS = 512, 8
#: Documents of a list up to which all collisions are counted at once, without prefixes.
SHORT = 48
TOKEN, SHARED, POSTING, EDGE = range(1, 5)


def least_matches(threshold: int) -> int:
    """Coordinates on which a pair at the threshold agrees but for a chance of a few in a million."""
    j = threshold / 100
    return max(1, int(COORDINATES * j - 4.5 * (COORDINATES * j * (1 - j)) ** 0.5))


class Sets:
    """Shingle sets of texts: sorted different hashes, row by row."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.hasher, self.is_word, self.lower = WordHasher(), class_table("blank"), lower_table()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds of rows in them)."""
        data = self.lower[data]
        starts, ends, rows = word_bounds(data, offsets, self.is_word)
        words = self.hasher(data, starts, ends)
        count = np.diff(rows)
        owner = np.repeat(np.arange(len(count)), count)
        n = max(len(words) - self.size + 1, 0)
        own = shingles(words, self.size)[:n] if n else words[:0]
        inside = owner[:n] == owner[self.size - 1 :]
        keys, owners = [own[inside]], [owner[:n][inside]]
        for row in np.flatnonzero((count > 0) & (count < self.size)).tolist():
            keys.append(shingles(words[rows[row] : rows[row + 1]], self.size))
            owners.append(np.array([row]))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((keys, owners))
        keys, owners = keys[order], owners[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1]))[: len(keys)]
        keys, owners = keys[new], owners[new]
        return keys, np.searchsorted(owners, np.arange(len(count) + 1))


def digests(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each row's set."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(salt)))]) for salt in (0x51ED, 0xC0FFEE)]
        return tuple((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)


def minima(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures of rows; those of empty rows are 0."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        h = (keys >> np.uint64(13)).astype(np.uint32)
        a, b = (random64(COORDINATES, s).astype(np.uint32) for s in (61, 62))
        with np.errstate(over="ignore"):
            for k in range(COORDINATES):
                v = (h ^ b[k]) * (a[k] | np.uint32(1))
                v ^= v >> np.uint32(15)
                out[full, k] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), bounds[:-1][full])
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                keys, bounds = sets(data, offsets)
                high, low = digests(keys, bounds)
                sig = minima(keys, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(np.diff(bounds)), pa.array(high), pa.array(low), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "n", "hi", "lo", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(scan), "doc_id long, n long, hi long, lo long, sig binary")


def tokens(sig: np.ndarray) -> np.ndarray:
    """One 64-bit posting key for each coordinate and value."""
    with np.errstate(over="ignore"):
        return mix((sig.astype(np.uint64) << np.uint64(8)) + np.arange(COORDINATES, dtype=np.uint64))


def matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, COORDINATES)


def popularity(reps: DataFrame) -> np.ndarray:
    """How many postings fall in each of CELLS counters, over all classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount((tokens(matrix(batch.column(0).to_pylist())) >> np.uint64(64 - CELL_BITS)).astype(np.int64).ravel(), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CELLS)), pa.array(total)], names=["cell", "n"])

    rows = reps.select("sig").mapInArrow(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CELLS, np.int64)
    for cell, n in rows:
        out[cell] = n
    return out


def pack(reps: DataFrame, buckets: Buckets) -> DataFrame:
    """Classes in buckets by their id, as blocks of (ids, set sizes, signatures)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            sig = matrix(batch.column(2).to_pylist())
            bucket = (mix(ids.view(np.uint64)) % np.uint64(buckets.n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield buckets.batch([(b, 0, 0, encode(ids[order[part]], size[order[part]], sig[order[part]].ravel())) for b, part in cut(bucket[order], buckets.n)])

    return reps.select("doc_id", "n", "sig").mapInArrow(tidy(run), DEALT)


class Bucket:
    """The classes of a bucket and their prefix postings, sorted by posting."""

    def __init__(self, blocks: list[bytes], popular: np.ndarray, threshold: int) -> None:
        prefix = COORDINATES - least_matches(threshold) + 1
        parts = [decode(x) for x in blocks]
        self.ids, self.size, sig = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.size, self.sig = self.ids[order], self.size[order], sig.reshape(-1, COORDINATES)[order]
        every = tokens(self.sig)
        rarity = (popular[(every >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(24)) | (every & np.uint64(0xFFFFFF))
        kept = np.take_along_axis(every, np.argsort(rarity, axis=1, kind="stable")[:, :prefix], 1)
        token, row = kept.ravel(), np.repeat(np.arange(len(self.ids)), prefix)
        order = np.lexsort((row, token))
        self.token, self.row = token[order], row[order]
        self.unique, self.first = np.unique(self.token, return_index=True)
        self.bounds = np.append(self.first, len(self.token))


def prefix_lists(sig: np.ndarray, threshold: int) -> list[np.ndarray]:
    """The rows of each posting that two or more rows have among their rarest ones; any two rows with enough collisions share one."""
    n = len(sig)
    keys = tokens(sig).ravel()
    _, at, count = np.unique(keys, return_inverse=True, return_counts=True)
    at = at.reshape(n, -1)
    order = np.argsort((count[at] << 32) | at, axis=1, kind="stable")[:, : COORDINATES - least_matches(threshold) + 1]
    token, row = np.take_along_axis(at, order, 1).ravel(), np.repeat(np.arange(n), order.shape[1])
    order = np.lexsort((row, token))
    token, row = token[order], row[order]
    bounds = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))
    long = np.flatnonzero(np.diff(bounds) > 1)
    return [row[bounds[k] : bounds[k + 1]] for k in long[np.argsort(np.diff(bounds)[long], kind="stable")].tolist()]


def link(ids: np.ndarray, size: np.ndarray, sig: np.ndarray, threshold: int, known: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(part of each document of a list, links that make the parts); known: parts to begin with.

    A pair is counted only if not yet in one part. In a list of more than SHORT
    documents only those that share a prefix posting are; the collisions in the
    postings that were skipped are read off the two signatures.
    """
    part = np.arange(len(ids)) if known is None else known.copy()
    edges, matches = [], least_matches(threshold)

    def count(rows: np.ndarray) -> None:
        for k, i in enumerate(rows[:-1].tolist()):
            other = rows[k + 1 :]
            other = other[part[other] != part[i]]
            if not len(other):
                continue
            near = other[np.minimum(size[other], size[i]) * 100 >= threshold * np.maximum(size[other], size[i])]
            for j in near[(sig[near] == sig[i]).sum(1) >= matches].tolist():
                if part[j] != part[i]:
                    edges.append((int(ids[i]), int(ids[j])))
                    part[part == part[j]] = part[i]

    if len(ids) <= SHORT:
        count(np.arange(len(ids)))
    else:
        for rows in prefix_lists(sig, threshold):
            count(rows)
    return part, edges


def pose(b: int, blocks: list[bytes], n: int, popular: np.ndarray, threshold: int) -> Iterator[tuple]:
    own = Bucket(blocks, popular, threshold)
    to = (own.unique % np.uint64(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for k, part in cut(to[order], n):
        yield k, TOKEN, b, encode(own.unique[order[part]])


def shared(k: int, rows: list[tuple]) -> Iterator[tuple]:
    asked = [(src, decode(block)[0]) for _, _, src, block in rows]
    _, at, count = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True, return_counts=True)
    begin = 0
    for src, keys in asked:
        i = np.flatnonzero(count[at[begin : begin + len(keys)]] > 1)
        begin += len(keys)
        if len(i):
            yield src, SHARED, k, encode(keys[i])


def post(b: int, blocks: list[bytes], replies: list[tuple], n: int, popular: np.ndarray, threshold: int) -> list[tuple]:
    """Links inside the bucket; of each shared posting all documents go on but for those of equal size and signature, each with its part's name."""
    own = Bucket(blocks, popular, threshold)
    wide = np.zeros(len(own.unique), bool)
    for *_, block in replies:
        wide[np.searchsorted(own.unique, decode(block)[0])] = True
    _, same = np.unique(np.column_stack([own.size, own.sig.astype(np.int64)]), axis=0, return_inverse=True)
    edges: set[tuple[int, int]] = set()
    sent: list[tuple[int, int, int]] = []
    for t in np.flatnonzero(wide | (np.diff(own.bounds) > 1)).tolist():
        rows = own.row[own.bounds[t] : own.bounds[t + 1]]
        part = np.arange(len(rows))
        if len(rows) > 1:
            part, found = link(own.ids[rows], own.size[rows], own.sig[rows], threshold)
            edges.update(found)
        if wide[t]:
            first = np.unique(same[rows], return_index=True)[1]
            sent.extend(zip([t] * len(first), rows[first].tolist(), own.ids[rows[part[first]]].tolist(), strict=True))
    out = [(n + b, EDGE, b, encode(*np.array(sorted(edges), np.int64).reshape(-1, 2).T))] if edges else []
    if sent:
        t, r, name = np.array(sent, np.int64).T
        key = own.unique[t]
        to = (key % np.uint64(n)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for k, part in cut(to[order], n):
            i = order[part]
            who, at = np.unique(r[i], return_inverse=True)  # a document's signature goes once, however many postings
            out.append((k, POSTING, b, encode(key[i], at, own.ids[who], own.size[who], own.sig[who].ravel(), name[i])))
    return out


def meet(k: int, rows: list[tuple], threshold: int) -> Iterator[tuple]:
    """Links across buckets; links found before pass through."""
    yield from ((k, EDGE, src, block) for _, kind, src, block in rows if kind == EDGE)
    parts = [decode(block) for _, kind, _, block in rows if kind == POSTING]
    if not parts:
        return
    shift = np.cumsum([0] + [len(p[2]) for p in parts])
    key = np.concatenate([p[0] for p in parts])
    at = np.concatenate([p[1] + s for p, s in zip(parts, shift[:-1], strict=True)])
    ids, size = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    sig = np.concatenate([p[4] for p in parts]).reshape(-1, COORDINATES)
    name = np.concatenate([p[5] for p in parts])
    order = np.lexsort((ids[at], key))
    key, at, name = key[order], at[order], name[order]
    bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    edges: set[tuple[int, int]] = set()
    for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - a > 1:
            known = np.unique(name[a:e], return_inverse=True)[1]
            if known.any():
                edges.update(link(ids[at[a:e]], size[at[a:e]], sig[at[a:e]], threshold, known)[1])
    if edges:
        yield k, EDGE, k, encode(*np.array(sorted(edges), np.int64).T)


def candidates(reps: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links on signatures that connect whatever signatures connect, each block's as stars with a over b."""
    spark = reps.sparkSession
    held = spark.sparkContext.broadcast(popularity(reps))
    buckets = buckets_for(reps)
    n = buckets.n
    dealt = pack(reps, buckets)
    replies = answer(ask(dealt, buckets, lambda b, blocks: pose(b, blocks, n, held.value, threshold)), buckets, shared)
    posted = ask_again(dealt, replies, buckets, lambda b, blocks, rows: post(b, blocks, rows, n, held.value, threshold))

    def stars(k: int, rows: list[tuple]) -> pa.Table:
        held = [(np.zeros(0, np.int64),) * 2, *(forest(*decode(block)) for *_, block in meet(k, rows, threshold))]
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    return conclude(posted, buckets, stars, "a long, b long")


class Full:
    """Exact links among documents whose full sets are at hand."""

    def __init__(self, sets: list[bytes]) -> None:
        arrays = [np.frombuffer(s, np.uint64) for s in sets]
        self.size = np.array([len(a) for a in arrays])
        unique, self.flat = np.unique(np.concatenate(arrays), return_inverse=True)
        self.bounds = np.append(np.cumsum(self.size) - self.size, len(self.flat))
        self.mark = np.zeros(len(unique), np.int64)

    def near(self, i: int, threshold: int) -> np.ndarray:
        own = self.flat[self.bounds[i] : self.bounds[i + 1]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.flat], self.bounds[:-1])
        self.mark[own] = 0
        return 100 * both >= threshold * (self.size + self.size[i] - both)


def confirm(ids: list[int], sets: list[bytes], first: int, threshold: int) -> list[tuple[int, int]]:
    """Confirmed links of the first documents with all, one for each two parts that they join."""
    full, part, edges = Full(sets), np.arange(len(ids)), []
    for i in range(first):
        if (part == part[i]).all():
            break
        for j in np.flatnonzero(full.near(i, threshold) & (part != part[i])).tolist():
            if part[j] != part[i]:
                edges.append((ids[i], ids[j]))
                part[part == part[j]] = part[i]
    return edges


def confirmed(grouped: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """grouped(keys, lead, doc_id, full): links of the rows marked lead, in each group; with no such rows, of all."""

    def run(key, rows):
        lead, ids, sets = (rows.column(c).to_pylist() for c in ("lead", "doc_id", "full"))
        order = sorted(range(len(ids)), key=lambda i: (not lead[i], ids[i]))
        some = sum(lead) if len(keys) == 3 else len(ids)
        edges = confirm([ids[i] for i in order], [sets[i] for i in order], some, threshold)
        release()
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return grouped.groupBy(*keys).applyInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, members: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(cluster, doc_id, full): the sets of the members, out of their texts; a document of several texts has a row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(4)):
                keys, bounds = sets(data, offsets)
                high, low = digests(keys, bounds)
                right = (high == batch.column(2)[first:end].to_numpy()) & (low == batch.column(3)[first:end].to_numpy())
                at = pa.array(np.flatnonzero(right))
                full = [keys[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(right).tolist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[first:end].take(at) for i in range(4)), pa.array(full, pa.binary())], names=["cluster", "doc_id", "hi", "lo", "full"])

    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    texts = marked(texts, F.col("node"), bitmap(members.select("node")), "__maybe").where("__maybe").drop("__maybe")
    return texts.join(members.hint("shuffle_hash"), "node").select("cluster", F.col("node").alias("doc_id"), "hi", "lo", "text").mapInArrow(tidy(run), "cluster long, doc_id long, hi long, lo long, full binary").dropDuplicates(["doc_id", "hi", "lo"]).drop("hi", "lo")


def upto(count: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), (F.col(count) - 1).cast("long"))


def links(docs: DataFrame, reps: DataFrame, doc_id: str, text: str, size: int, threshold: int) -> DataFrame:
    """(a, b): confirmed links that connect the classes; a class goes by its smallest document."""
    clusters = components(candidates(reps, threshold), contract=False)
    members = clusters.select("node", F.col("component").alias("cluster")).join(reps.select(F.col("doc_id").alias("node"), "hi", "lo"), "node")
    sets = materialise(full_sets(docs, members, doc_id, text, size), "sets")
    counts = sets.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sized = sets.join(counts, "cluster")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    # the hubs of a large cluster, by minima over slices of a hash, are in all of its blocks
    large = sized.where("blocks > 1").select("cluster", "doc_id", "blocks").distinct()
    hubs = large.groupBy("cluster", F.pmod(F.hash("doc_id"), F.lit(HUBS)).alias("slice")).agg(F.min("doc_id").alias("doc_id")).select("cluster", "doc_id")
    spread = sized.join(hubs, ["cluster", "doc_id"]).select("cluster", F.explode(upto("blocks")).alias("block"), F.lit(True).alias("lead"), "doc_id", "full")
    own = sized.select("cluster", block.cast("long").alias("block"), F.lit(False).alias("lead"), "doc_id", "full")
    found = materialise(confirmed(own.join(hubs.select("cluster", "doc_id"), ["cluster", "doc_id"], "left_anti").select(spread.columns).unionByName(spread), ["cluster", "block"], threshold), "links")
    if large.isEmpty():
        return found
    parts = components(found)
    placed = materialise(large.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).select("cluster", "doc_id", "blocks", "part"), "parts")
    main = placed.groupBy("cluster", "part").count().groupBy("cluster").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    rest = placed.join(main, "cluster").where("part <> main").select("cluster", "doc_id", "blocks")
    chunks = rest.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    if chunks.isEmpty():
        return found
    rest = rest.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("long"))
    left = sets.join(rest.select("doc_id", "blocks", "chunk"), "doc_id").select("cluster", F.explode(upto("blocks")).alias("block"), "chunk", F.lit(True).alias("lead"), "doc_id", "full")
    right = sized.join(chunks, "cluster").select("cluster", block.cast("long").alias("block"), F.explode(upto("chunks")).alias("chunk"), F.lit(False).alias("lead"), "doc_id", "full")
    right = right.join(rest.select("doc_id", F.col("chunk").alias("own")), "doc_id", "left").where("own is null or own <> chunk").select(left.columns)
    more = materialise(confirmed(left.unionByName(right), ["cluster", "block", "chunk"], threshold), "more_links")
    return found.unionByName(more)


def same_document(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): a document whose rows differ, with the smallest document of each class that they are in."""
    several = rows.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("a"), F.max(F.struct("hi", "lo")).alias("b")).where("a <> b").select("doc_id")
    own = rows.where("n > 0").select("doc_id", "hi", "lo", "n").join(several, "doc_id", "left_semi").distinct()
    return own.select(F.col("doc_id").alias("a"), "hi", "lo", "n").join(classes.select("hi", "lo", "n", F.col("doc_id").alias("b")), ["hi", "lo", "n"]).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, threshold: int = 85) -> DataFrame:
    """One row for each document row: n_shingles, component_id, kept.

    Documents link if 100 * intersection >= threshold * union of their sets of
    size-word shingles. Texts without words (or null) are linked with nothing.
    Rows of one id are one document: if their texts differ, it links with what any
    of them links with, and all its rows have one component. Rows without an id
    take no part: component null, kept. Ids that aren't whole numbers are an error.
    Other columns are ignored.
    """
    whole_numbers(docs, doc_id)
    sigs = materialise(signatures(docs, doc_id, text, size), "signatures")
    some = sigs.where("n > 0 and doc_id is not null")
    classes = materialise(some.groupBy("hi", "lo", "n").agg(F.min(F.struct("doc_id", "sig")).alias("x"), F.count("*").alias("weight")).select("hi", "lo", "n", "x.doc_id", "x.sig", "weight"), "classes")
    # a proper subset of at least threshold percent has this many elements or more
    least = -(-threshold // (100 - threshold)) if threshold < 100 else 1 << 62
    found = links(docs, classes.where(F.col("n") >= least), doc_id, text, size, threshold)
    linked = components(found.unionByName(same_document(sigs.where("doc_id is not null"), classes)))
    named = classes.join(linked, F.col("doc_id") == F.col("node"), "left").select("hi", "lo", "n", F.coalesce("component", "doc_id").alias("component"), "weight")
    total = classes.agg(F.sum("weight")).first()[0] or 0
    rows = join_hot(some.select("doc_id", "n", "hi", "lo"), named, ["hi", "lo", "n"], "weight", total).select("doc_id", "n", "component")
    alone = sigs.where("n = 0 or doc_id is null").select("doc_id", "n").join(linked, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    out = rows.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """The document with the smallest id of each component: all its texts, each once. Rows without an id stay."""
    found = materialise(near_duplicates(docs, doc_id, text, size, threshold).where("doc_id is not null").select("doc_id", "kept"), "kept")
    kept = without(docs, doc_id, found.where("not kept").select("doc_id").distinct())
    again = found.where("kept").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again")
    if again.isEmpty():
        return kept
    same = F.col(doc_id) == F.col("__again")
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([doc_id, text]))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
