"""Document probability under a subword lattice with corpus counts on top.

A word is the whitespace marker and its characters. The vocabulary's own log
scores weight every arc of its lattice; the forward recursion, in log space,
sums over all segmentations and gives the word's marginal probability L. Corpus
counts adapt it: with c the word's training count, N the training tokens and V
the different ones,

    P(word) = (c + V * L(word)) / (N + V),

that is the whole word as one more arc, against the lattice as base measure with
Witten-Bell weight. L sums to 1 over words, so P does too. A document's log10
probability is the sum over its words and its end.

Documents are dealt to buckets once. Each bucket asks key buckets for the counts
of its different words (a frequent word is one record for a bucket), and its
documents are scored when the counts are back. Counts stay distributed: no
vocabulary is collected or broadcast but the fixed subword file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WordHasher, class_table, lower_table, mix, word_bounds
from .exchange import NO_ID, answer, ask, buckets_for, cut, deal, decode, encode, gather, texts_of
from .pieces import Vocabulary, default_model

COUNTS = 1
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def remainder(ids: np.ndarray, folds: int) -> np.ndarray:
    """crc32 of each id as text, mod folds; 0 for rows without an id."""
    return np.array([zlib.crc32(str(i).encode()) % folds if i != NO_ID else 0 for i in ids.tolist()], np.int64)


class Words:
    """Word hashes of texts; the end of a text has the hash of a lone space, which no word has."""

    def __init__(self) -> None:
        self.hasher, self.is_word, self.lower = WordHasher(), class_table("blank"), lower_table()
        self.end = self.hasher(np.array([32], np.uint8), np.array([0]), np.array([1]))

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple:
        data = self.lower[data]
        starts, ends, rows = word_bounds(data, offsets, self.is_word)
        return data, starts, ends, rows, self.hasher(data, starts, ends)


def key_bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys) % np.uint64(n)).astype(np.int64)


def own_counts(blocks: list[bytes], folds: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """(different words of a bucket, their training counts), sorted."""
    words, keys, counts = Words(), [], []
    for ids, offsets, data in texts_of(blocks):
        _, _, _, rows, hashes = words(offsets, data)
        train = remainder(ids, folds) != fold
        unique, at = np.unique(hashes, return_inverse=True)
        keys += [unique, words.end]
        counts += [np.bincount(at, weights=np.repeat(train, np.diff(rows)), minlength=len(unique)).astype(np.int64), np.array([train.sum()])]
    if not keys:
        return words.end, np.zeros(1, np.int64)
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)


def pose(b: int, blocks: list[bytes], n: int, folds: int, fold: int) -> Iterator[tuple]:
    keys, counts = own_counts(blocks, folds, fold)
    to = key_bucket(keys, n)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(n + 1))
    for k in range(n):  # every key bucket is asked, for its share of N and V
        i = order[bounds[k] : bounds[k + 1]]
        yield k, COUNTS, b, encode(np.diff(keys[i], prepend=np.uint64(0)), counts[i])


def reply(k: int, rows: list[tuple]) -> Iterator[tuple]:
    asked = [(src, np.cumsum(d, dtype=np.uint64), c) for _, _, src, block in rows for d, c in [decode(block)]]
    unique, at = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([x[2] for x in asked]), minlength=len(unique)).astype(np.int64)
    sums = np.array([total.sum(), (total > 0).sum()])
    begin = 0
    for src, keys, _ in asked:
        yield src, COUNTS, k, encode(total[at[begin : begin + len(keys)]], sums)
        begin += len(keys)


def score(b: int, blocks: list[bytes], replies: list[tuple], n: int, folds: int, fold: int, vocabulary: Vocabulary) -> pa.Table:
    keys, _ = own_counts(blocks, folds, fold)
    to = key_bucket(keys, n)
    order = np.argsort(to, kind="stable")
    sent = dict(cut(to[order], n))
    count = np.zeros(len(keys), np.int64)
    big_n = big_v = 0
    for _, _, k, block in replies:
        c, sums = decode(block)
        big_n, big_v = big_n + int(sums[0]), big_v + int(sums[1])
        if k in sent:
            count[order[sent[k]]] = c
    weight = max(big_v, 1)
    words = Words()
    base = np.log10((count + 0.1) / (big_n + 0.1 * (big_v + 1)))
    lattice = np.full(len(keys), np.nan)
    lattice[np.searchsorted(keys, words.end)] = vocabulary.scores[vocabulary.end]
    out = []
    for ids, offsets, data in texts_of(blocks):
        low, starts, ends, rows, hashes = words(offsets, data)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(keys, unique)
        new = np.flatnonzero(np.isnan(lattice[at]))
        text = low.tobytes()
        found = [b" " + text[x:y] for x, y in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        if found:
            lattice[at[new]] = vocabulary.marginal(found)
        full = np.log10(count[at] + weight * np.exp(lattice[at])) - np.log10(big_n + weight)
        tiny = ~np.isfinite(full)  # beyond doubles: the lattice's share alone, in logs
        full[tiny] = (np.log(weight) + lattice[at[tiny]]) / np.log(10) - np.log10(big_n + weight)
        e = np.searchsorted(keys, words.end)[0]
        end_score = np.log10(count[e] + weight * np.exp(lattice[e])) - np.log10(big_n + weight)
        sums = [np.add.reduceat(np.append(x[inverse], 0), np.minimum(rows[:-1], len(inverse))) * (np.diff(rows) > 0) for x in (base[at], full, (count[at] > 0).astype(np.int64))]
        out.append((ids, remainder(ids, folds) == fold, np.diff(rows) + 1, sums[2] + int(count[e] > 0), np.full(len(ids), big_n), sums[0] + base[e], sums[1] + end_score))
    ids, held, tokens, known, train, base_sum, full_sum = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"doc_id": pa.array(ids, mask=ids == NO_ID), "held_out": held, "n_tokens": tokens, "n_known": known, "train_tokens": train, "base_score": base_sum, "score": full_sum})


def lattice_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, folds: int = 10, fold: int = 0) -> DataFrame:
    """One row for each document row: base_score is the smoothed word model's, score the lattice model's log10 probability.

    Documents whose crc32(id as text) mod folds is fold are held out of the
    counts. Null texts are empty: one token, the end. Rows without an id are held
    out. Repeated rows count each time. Other columns are ignored.
    """
    buckets = buckets_for(docs)
    n = buckets.n
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(model or default_model()))
    dealt = deal(docs, doc_id, text, buckets)
    replies = answer(ask(dealt, buckets, lambda b, blocks: pose(b, blocks, n, folds, fold)), buckets, reply)
    return gather(dealt, replies, buckets, lambda b, blocks, rows: score(b, blocks, rows, n, folds, fold, held.value), SCHEMA)


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
