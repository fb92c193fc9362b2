"""Repeated-passage removal over an enhanced suffix array with its common-prefix intervals.

A suffix array over all bytes of a corpus doesn't fit one machine, so the array
is sparse: suffixes start at anchors only. An anchor is the leftmost smallest
hash among the 24-byte strings of a 50-byte window, so equal windows hold equal
anchors at equal places, in whichever documents. The windows of one anchor are
consecutive; their bytes are its context.

1. Every document bucket sends (anchor, context hash, smallest document) to the
   anchor's bucket, once for each of its different contexts.
2. There, equal contexts are settled: the smallest document owns them, others
   repeat it. Anchors with different contexts are contested.
3. Contested contexts come with their bytes. Sorted from the anchor on, they are
   a suffix array; a stack scan over the common-prefix lengths lists its
   intervals, and the bytes left of the anchor tell which occurrences of an
   interval extend to the left alike (left diversity). Interval depth plus left
   extension of 50 bytes or more is a repeat, with all its occurrences.
4. The documents take the answers and drop every byte under a repeated window.

An anchor with many different contexts inside one bucket (a passage in a large
share of all documents) is not sent to one place: its windows are dealt by their
own hashes, each once for a document bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import CHUNK_BYTES, WordHasher, mix, random64
from .exchange import NO_ID, answer, ask, ask_again, buckets_for, cut, deal, decode, encode, gather, texts_of

WINDOW = 50
ANCHOR = 24
SPAN = WINDOW - ANCHOR + 1
#: Contexts of one anchor in one document bucket beyond which its windows are dealt by their hashes.
CROWD = 8
#: Text that is hashed at once: a dozen passes over eight-byte arrays of this length stay in the CPU's cache.
SMALL_BYTES = 1 << 17
QUESTION, HOT, CONTEXT, SETTLED, PARTIAL, PASSED = range(1, 7)
#: A message's contexts (place, anchor, document, left, length, bytes) and windows (place, number, hash, document), if it has none.
NOTHING = [np.zeros(0, t) for t in (np.uint32, np.uint64, np.int64, np.uint8, np.uint8, np.uint8)]
BLANK = [np.zeros(0, t) for t in (np.uint32, np.uint8, np.uint64, np.int64)]
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def common_prefix(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before it (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def intervals(lcp: list[int], n: int) -> Iterator[tuple[int, int, int, int]]:
    """(depth, parent's depth, first, end) of the common-prefix intervals with two or more suffixes, by a stack scan."""
    stack = [(0, 0)]
    for i in range(1, n + 1):
        h = lcp[i] if i < n else 0
        left = i - 1
        while stack[-1][0] > h:
            depth, left = stack.pop()
            yield depth, max(h, stack[-1][0]), left, i
        if stack[-1][0] < h:
            stack.append((h, left))


def maximal_repeats(texts: list[bytes], shortest: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """All maximal repeats of at least so many bytes with all their (text, start) occurrences; for texts that fit one task.

    The suffix array is built by prefix doubling over the joined texts; ends are
    unique, so no match crosses one. An interval is a maximal repeat if its
    suffixes have different bytes, or text starts, to their left.
    """
    symbols = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + len(texts), k) for k, t in enumerate(texts)]) if texts else np.zeros(0, np.int64)
    n = len(symbols)
    rank, step = symbols.copy(), 1
    order = np.argsort(rank, kind="stable")
    while n:
        second = np.full(n, -1, np.int64)
        second[: n - step if step < n else 0] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank, step = new, step * 2
        if step >= n or rank.max(initial=0) == n - 1:
            break
    lcp, h = [0] * n, 0
    at, sym = order.tolist(), symbols.tolist()
    place = [0] * n
    for i, p in enumerate(at):
        place[p] = i
    for p in range(n):
        if place[p]:
            q = at[place[p] - 1]
            while max(p, q) + h < n and sym[p + h] == sym[q + h] and sym[p + h] >= len(texts):
                h += 1
            lcp[place[p]] = h
            h = max(0, h - 1)
        else:
            h = 0
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out = []
    for depth, _, a, b in intervals(lcp, n):
        if depth >= shortest and len({sym[p - 1] if p and sym[p - 1] >= len(texts) else ~p for p in at[a:b]}) > 1:
            where = [(int(k), p - int(starts[k])) for p in sorted(at[a:b]) for k in [np.searchsorted(starts, p, side="right") - 1]]
            k, p = where[0]
            out.append((texts[k][p : p + depth], where))
    return sorted(out)


class Scanner:
    """Anchors and contexts of documents."""

    def __init__(self) -> None:
        self.values = random64(256, 51) | np.uint64(1)
        self.base = int(random64(1, 52)[0] | np.uint64(5))
        self.hasher = WordHasher(53)

    def anchors(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the 24 bytes at each place; place of the leftmost smallest one, by its upper 58 bits, in the window at each place."""
        times = lambda k: np.uint64(pow(self.base, k, 1 << 64))

        def joined(left: np.ndarray, size: int, right: np.ndarray) -> np.ndarray:
            out = left * times(size)
            out += right
            return out

        with np.errstate(over="ignore"):
            h = np.take(self.values, data)
            size = 1
            while size < 16:
                h = joined(h[:-size], size, h[size:])
                size *= 2
                if size == 8:
                    eight = h
            h = mix(joined(h[: len(data) - ANCHOR + 1], 8, eight[16:]))
        # the lower 6 bits tell how far the smallest is from the window's start; so equal hashes go by place, wherever the window stands
        least = h & ~np.uint64(63)
        size = 1
        while size < SPAN:
            step = min(size, SPAN - size)
            later = least[step:] + np.uint64(step)
            least = np.minimum(least[:-step], later, out=later)
            size += step
        least &= np.uint64(63)
        return h, np.arange(len(least), dtype=np.int32) + least.astype(np.int32)

    def contexts(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, first window, last window, anchor's place, anchor hash, context hash), in order of place."""
        parts = []
        n = len(data)
        cuts = np.concatenate([offsets[:-1], np.maximum(offsets[1:] - WINDOW + 1, offsets[:-1])])  # where a row begins, and where its windows end
        for low in range(0, max(1, n - WINDOW + 1), CHUNK_BYTES):  # very long documents go slice by slice
            part = data[low : low + CHUNK_BYTES + WINDOW - 1]
            if len(part) < WINDOW:
                break
            h, where = self.anchors(part)
            new = np.ones(len(where), bool)
            new[1:] = where[1:] != where[:-1]
            here = cuts - low
            new[here[(here >= 0) & (here < len(where))]] = True
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(where)) - 1
            rows = np.searchsorted(offsets, first + low, side="right") - 1 if len(offsets) > 2 else np.zeros(len(first), np.int64)
            keep = first + low + WINDOW <= offsets[rows + 1]
            rows, first, last = rows[keep], first[keep], last[keep]
            a = where[first].astype(np.int64)
            key = self.hasher(part, first, last + WINDOW)
            with np.errstate(over="ignore"):
                key = mix(key + (a - first).astype(np.uint64)) >> np.uint64(16)
            parts.append((rows, first + low, last + low, a + low, h[a], key))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2

    def bucket(self, blocks: list[bytes], again: bool = False) -> dict:
        """Different (anchor, context) of a bucket, sorted, with their smallest document; crowd marks crowded anchors.

        Where the texts are gone through again, chunks has (row, first window, last window, anchor's
        place, place in the list) of the contexts of each chunk of chunks_of().
        """
        found, chunks = [], []
        for ids, offsets, data in chunks_of(blocks):
            row, first, last, a, m, key = self.contexts(offsets, data)
            found.append((m, key, ids[row]))
            if again:
                kind = np.int32 if len(data) <= np.iinfo(np.int32).max else np.int64
                chunks.append([x.astype(kind) for x in (row, first, last, a)])
        m, key, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        del found
        order = np.lexsort((doc, key, m))
        m, key, doc = m[order], key[order], doc[order]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (key[1:] != key[:-1])
        if again:
            at = np.empty(len(m), np.int32 if len(m) <= np.iinfo(np.int32).max else np.int64)
            at[order] = np.cumsum(new) - 1
            for own, end in zip(chunks, np.cumsum([len(x[0]) for x in chunks]).tolist(), strict=True):
                own.append(at[end - len(own[0]) : end])
        m, key, doc = m[new], key[new], doc[new]
        group = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(group, len(m)))
        return {"m": m, "key": key, "doc": doc, "crowd": np.repeat(sizes > CROWD, sizes), "chunks": chunks}


def chunks_of(blocks: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return texts_of(blocks, min(CHUNK_BYTES, SMALL_BYTES))


def key_bucket(values: np.ndarray, n: int) -> np.ndarray:
    return (mix(values) % np.uint64(n)).astype(np.int64)


def pose(b: int, blocks: list[bytes], n: int) -> Iterator[tuple]:
    """Step 1: the different contexts of a bucket, to the buckets of their anchors."""
    own = Scanner().bucket(blocks)
    m, key, doc, crowd = own["m"], own["key"], own["doc"], own["crowd"]
    to = key_bucket(m, n)
    at = np.flatnonzero(~crowd)
    order = at[np.argsort(to[at], kind="stable")]
    for k, part in cut(to[order], n):
        i = order[part]
        yield k, QUESTION, b, encode(np.diff(m[i], prepend=np.uint64(0)), key[i].astype(np.uint32), (key[i] >> np.uint64(32)).astype(np.uint16), doc[i])
    hot = np.unique(m[crowd])
    to = key_bucket(hot, n)
    order = np.argsort(to, kind="stable")
    for k, part in cut(to[order], n):
        yield k, HOT, b, encode(hot[order[part]])


def settle(k: int, rows: list[tuple]) -> Iterator[tuple]:
    """Step 2: which contexts another bucket's smaller document has, which are contested, and how those are settled."""
    hot = np.unique(np.concatenate([decode(x[3])[0] for x in rows if x[1] == HOT] or [np.zeros(0, np.uint64)]))
    asked = [(src, *decode(block)) for _, kind, src, block in rows if kind == QUESTION]
    if not asked:
        return
    sizes = [len(x[1]) for x in asked]
    m = np.concatenate([np.cumsum(x[1]) for x in asked])
    key = np.concatenate([x[2].astype(np.uint64) | (x[3].astype(np.uint64) << np.uint64(32)) for x in asked])
    doc = np.concatenate([x[4] for x in asked])
    order = np.lexsort((doc, key, m))
    same_m = np.append(False, m[order[1:]] == m[order[:-1]])
    same = same_m & np.append(False, key[order[1:]] == key[order[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(m))))  # the first of equal contexts
    group = np.cumsum(~same_m) - 1
    contested = np.bincount(group[~same], minlength=group[-1] + 1)[group] > 1
    crowded = np.isin(m[order], hot)
    least, state = np.empty(len(m), np.int64), np.zeros(len(m), np.uint8)
    least[order] = doc[order[head]]
    # 1: a smaller document has it; 2: contested; 3: its windows are dealt by hash
    state[order] = np.where(crowded, 3, np.where(least[order] < doc[order], 1, np.where(contested & (least[order] == doc[order]), 2, 0)))
    at = 0
    for (src, *_), size in zip(asked, sizes, strict=True):
        i = np.flatnonzero(state[at : at + size])
        if len(i):
            yield src, SETTLED, k, encode(i.astype(np.uint32), state[at + i], least[at + i])
        at += size


def places(own: dict, n: int, k: int) -> np.ndarray:
    """Where in the bucket's list the contexts stand that it sent to key bucket k, in the order sent."""
    if "sent" not in own:
        at = np.flatnonzero(~own["crowd"])
        to = key_bucket(own["m"][at], n)
        order = np.argsort(to, kind="stable")
        own["sent"] = {k: at[order[part]] for k, part in cut(to[order], n)}
    return own["sent"][k]


def settled(own: dict, replies: list[tuple], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(state, smallest document known) of each context of the bucket."""
    state = np.where(own["crowd"], 3, 0).astype(np.uint8)
    least = own["doc"].copy()
    for _, kind, k, block in replies:
        if kind == SETTLED:
            i, s, d = decode(block)
            at = places(own, n, k)[i]
            state[at] = s
            least[at] = np.minimum(least[at], d)
    return state, least


def first_texts(blocks: list[bytes], own: dict, wanted: np.ndarray) -> Iterator[tuple[int, bytes, int, int]]:
    """(place in the list, bytes, bytes before the anchor, windows) once for each wanted context of the bucket."""
    missing = wanted.copy()
    for (_, _, data), (_, first, last, a, at) in zip(chunks_of(blocks), own["chunks"], strict=True):
        for i in np.flatnonzero(missing[at]).tolist():
            if missing[at[i]]:
                missing[at[i]] = False
                yield int(at[i]), data[first[i] : last[i] + WINDOW].tobytes(), int(a[i] - first[i]), int(last[i] - first[i] + 1)


def contest(b: int, blocks: list[bytes], replies: list[tuple], n: int) -> list[tuple]:
    """Step 3a: contested contexts go out with their bytes, or window by window where anchors are crowded."""
    scanner = Scanner()
    own = scanner.bucket(blocks, again=True)
    state, _ = settled(own, replies, n)
    passed = [(k, block) for _, kind, k, block in replies if kind == SETTLED]
    rows = [(n + b, PASSED, b, encode(np.array([k for k, _ in passed]), np.array([len(x) for _, x in passed]), np.frombuffer(b"".join(x for _, x in passed), np.uint8)))]
    contexts, windows = [], []
    for at, text, left, count in first_texts(blocks, own, state >= 2):
        (contexts if state[at] == 2 else windows).append((at, text, left, count))
    parts: dict[int, list] = {}
    at = np.array([x[0] for x in contexts], np.int64)
    to = key_bucket(own["m"][at], n)
    order = np.argsort(to, kind="stable")
    for k, part in cut(to[order], n):
        mine = [contexts[i] for i in order[part]]
        i = at[order[part]]
        text = np.frombuffer(b"".join(x[1] for x in mine), np.uint8)
        parts[k] = [i.astype(np.uint32), own["m"][i], own["doc"][i], np.array([x[2] for x in mine], np.uint8), np.array([len(x[1]) for x in mine], np.uint8), text]
    count = np.array([x[3] for x in windows], np.int64)
    lengths = np.array([len(x[1]) for x in windows], np.int64)
    at = np.repeat(np.array([x[0] for x in windows], np.int64), count)
    number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    data = np.frombuffer(b"".join(x[1] for x in windows), np.uint8)
    begins = np.repeat(np.cumsum(lengths) - lengths, count) + number
    hashes = scanner.hasher(data, begins, begins + WINDOW)
    to = key_bucket(hashes, n)
    order = np.lexsort((own["doc"][at], hashes, to))
    for k, part in cut(to[order], n):
        i = order[part]
        parts.setdefault(k, NOTHING[:]).extend([at[i].astype(np.uint32), number[i].astype(np.uint8), hashes[i], own["doc"][at[i]]])
    for k, arrays in parts.items():
        rows.append((k, CONTEXT, b, encode(*arrays, *(BLANK if len(arrays) == len(NOTHING) else []))))
    return rows


def decide(k: int, rows: list[tuple]) -> Iterator[tuple]:
    """Step 3b: the windows of contested contexts that a smaller document has too."""
    for _, kind, b, block in rows:
        if kind == PASSED:
            keys, sizes, data = decode(block)
            ends = np.cumsum(sizes)
            yield from ((b, SETTLED, int(key), data[e - size : e].tobytes()) for key, size, e in zip(keys, sizes, ends, strict=True))
    asked = [(src, *decode(block)) for _, kind, src, block in rows if kind == CONTEXT]
    if not asked:
        return
    src = np.repeat([x[0] for x in asked], [len(x[7]) for x in asked])
    at, number, hashes, doc = (np.concatenate([x[i] for x in asked]) for i in (7, 8, 9, 10))
    order = np.lexsort((doc, hashes))
    same = np.append(False, hashes[order[1:]] == hashes[order[:-1]])[: len(order)]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    late = order[doc[order[head]] < doc[order]]
    found = [(src[late], at[late], np.uint32(1) << number[late].astype(np.uint32))]
    src = np.repeat([x[0] for x in asked], [len(x[1]) for x in asked])
    at, m, doc, left, length = (np.concatenate([x[i] for x in asked]) for i in (1, 2, 3, 4, 5))
    mask = repeats(m, doc, left.astype(np.int64), length.astype(np.int64), np.concatenate([x[6] for x in asked]))
    some = np.flatnonzero(mask)
    found.append((src[some], at[some], mask[some]))
    yield from masks(*(np.concatenate(x) for x in zip(*found, strict=True)))


def masks(src: np.ndarray, at: np.ndarray, mask: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(src, kind="stable")
    src, at, mask = src[order], at[order], mask[order]
    bounds = np.append(np.flatnonzero(np.append(True, src[1:] != src[:-1])), len(src)) if len(src) else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(src[a]), PARTIAL, 0, encode(at[a:b], mask[a:b])


def repeats(m: np.ndarray, doc: np.ndarray, left: np.ndarray, length: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Bit i of a context: a smaller document has its window i. Contexts of one anchor form a sparse suffix array."""
    out = np.zeros(len(m), np.uint32)
    if not len(m):
        return out
    ends = np.cumsum(length)
    begins = ends - length
    right = length - left
    most = WINDOW
    padded = np.append(text, np.zeros(WINDOW + SPAN, np.uint8))
    cell = np.arange(most)
    suffix = np.where(cell < right[:, None], padded[(begins + left)[:, None] + cell], 0)
    before = np.where(cell[: SPAN - 1] < left[:, None], padded[np.maximum((begins + left)[:, None] - 1 - cell[: SPAN - 1], 0)], 0)
    rows = np.ascontiguousarray(suffix).view(f"S{most}").reshape(-1)
    order = np.lexsort((right, rows, m))
    bounds = np.append(np.flatnonzero(np.append(True, m[order[1:]] != m[order[:-1]])), len(m))
    lcp = common_prefix(suffix[order], right[order])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        part = order[a:b]
        heights = lcp[a:b].tolist()
        heights[0] = 0
        for depth, parent, i, j in intervals(heights, b - a):
            own = part[i:j]
            # windows with r bytes right of the anchor's start are shared inside this interval for parent < r <= depth
            low = max(parent + 1, ANCHOR)
            if depth < low:
                continue
            most_left = int(left[own].max())
            for r in range(max(low, WINDOW - most_left), min(depth, WINDOW) + 1):
                need = WINDOW - r
                who = own[left[own] >= need]
                if len(who) < 2:
                    continue
                alike: dict[bytes, int] = {}
                keys = [before[w, :need].tobytes() for w in who.tolist()]
                for w, key in zip(who.tolist(), keys, strict=True):
                    alike[key] = min(alike.get(key, NO_ID), int(doc[w]))
                for w, key in zip(who.tolist(), keys, strict=True):
                    if alike[key] < doc[w]:
                        out[w] |= np.uint32(1 << int(left[w] - need))
    return out


def remove(b: int, blocks: list[bytes], replies: list[tuple], n: int) -> pa.Table:
    """Step 4: what is left of each document."""
    own = Scanner().bucket(blocks, again=True)
    _, least = settled(own, replies, n)
    mask = np.zeros(len(least), np.uint32)
    for _, kind, _, block in replies:
        if kind == PARTIAL:
            at, bits = decode(block)
            np.bitwise_or.at(mask, at, bits)
    out: list[tuple] = []
    for (ids, offsets, data), (row, first, last, _, at) in zip(chunks_of(blocks), own["chunks"], strict=True):
        steps = np.zeros(len(data) + 1, np.int64)
        full = least[at] < ids[row]
        np.add.at(steps, first[full], 1)
        np.add.at(steps, last[full] + WINDOW, -1)
        part = np.flatnonzero(~full & (mask[at] != 0))
        for bit in range(SPAN):
            some = part[(mask[at[part]] >> np.uint32(bit)) & np.uint32(1) == 1]
            np.add.at(steps, first[some] + bit, 1)
            np.add.at(steps, first[some] + bit + WINDOW, -1)
        gone = np.cumsum(steps[:-1]) > 0
        for i in range(len(ids)):
            a, e = int(offsets[i]), int(offsets[i + 1])
            own_gone = gone[a:e]
            edges = np.flatnonzero(np.diff(own_gone.astype(np.int8), prepend=0, append=0))
            kept = data[a:e][~own_gone].tobytes()
            spans = [{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2).tolist()]
            out.append((None if ids[i] == NO_ID else int(ids[i]), e - a, int(own_gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    columns = zip(*out, strict=True) if out else [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document row: its bytes, those removed, their maximal spans and the hash of the rest.

    A byte goes if a 50-byte string over it also starts in a document with a
    smaller id. Matches never cross documents. Null texts are empty; rows of one
    id don't remove each other's bytes, whether equal or not; rows without an id
    count as larger than all ids. Other columns are ignored.
    """
    buckets = buckets_for(docs)
    n = buckets.n
    dealt = deal(docs, doc_id, text, buckets)
    replies = answer(ask(dealt, buckets, lambda b, blocks: pose(b, blocks, n)), buckets, settle)
    contested = ask_again(dealt, replies, buckets, lambda b, blocks, rows: contest(b, blocks, rows, n))
    return gather(dealt, answer(contested, buckets, decide), buckets, lambda b, blocks, rows: remove(b, blocks, rows, n), SCHEMA)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
