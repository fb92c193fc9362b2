"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a learned vector of the word itself, the mean of the learned
vectors of its byte 4- and 5-grams (its characters), and what both say by count:
the word's log odds and the largest of its grams'. Two GRUs (Cho et al.
2014) read a window of words in both directions, attention weights its steps,
and a logistic unit scores the pooled state; back-propagation goes from there
into all weights and both tables of vectors. Windows overlap by half and cover
the whole text; a document has the score of its worst window.

Training sees document labels only: each round takes the window of a document
that scores highest so far (multiple-instance learning), for clean documents
two of them. The first round, with nothing learned yet, takes the window with
the most telling word by count. Log odds are counted without the document's own
part of the sample, so that they look as they will on new texts. Training is one
task on an executor over a bounded sample; the weights alone come back.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, class_table, lower_table, text_chunks, tidy, word_bounds
from .exchange import ranges

WINDOW, STRIDE = 32, 16
HIDDEN = 8
#: Learned numbers for each gram and each word; cells of the two tables by bits of a hash.
GRAM_DIM, WORD_DIM = 4, 4
CHANNELS = GRAM_DIM + WORD_DIM + 2
GRAM_BITS, WORD_BITS = 17, 16
#: Bounds of the training sample: rows of each label, and bytes of text in all.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1200, 2000, 24_000_000
#: Rounds of choosing windows; steps of a round: at least STEPS, and at least PASSES times all windows.
ROUNDS, PASSES, STEPS, BATCH, RATE = 4, 4, 80, 128, 0.01
#: Step of the tables, share of words that a step leaves out, and decay of what it touches.
TABLE_RATE, DROPPED, DECAY = 0.1, 0.1, 1e-4
#: Documents by which log odds are drawn to 0; those that a cell must stand in to be learned; parts of the sample left out in turn.
PRIOR, LEAST_DOCS, PARTS = 20, 20, 4
THRESHOLD = 0.3


class Texts:
    """Words of texts and what the network reads of them."""

    def __init__(self) -> None:
        self.hasher, self.is_word, self.lower = WordHasher(), class_table("alnum"), lower_table()

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """(row bounds in words, type of each word, word cell of each type, gram cells of types in a row, grams of each type, length of each type)."""
        low = self.lower[data]
        starts, ends, rows = word_bounds(low, offsets, self.is_word)
        hashes = self.hasher(low, starts, ends)
        unique, first, types = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = ends[first] - starts[first]
        # types' bytes in a row, each after a byte that marks its start
        begins = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int((lengths + 1).sum()), 0x5E, np.uint8)
        joined[ranges(begins + 1, lengths)] = low[ranges(starts[first], lengths)]
        wide = joined.astype(np.uint32)
        cells, owners = [], []
        owner = np.repeat(np.arange(len(unique)), lengths + 1)
        for size in (4, 5):
            if len(wide) < size:
                continue
            h = np.full(len(wide) - size + 1, 0x9E3779B9 + size, np.uint32)
            with np.errstate(over="ignore"):
                for i in range(size):
                    h = (h ^ wide[i : len(wide) - size + 1 + i]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            inside = owner[: len(h)] == owner[size - 1 :]
            cells.append((h[inside] >> np.uint32(32 - GRAM_BITS)).astype(np.int64))
            owners.append(owner[: len(h)][inside])
        cells = np.concatenate(cells) if cells else np.zeros(0, np.int64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owners, kind="stable")
        cells, owners = cells[order], owners[order]
        return rows, types, (unique >> np.uint64(64 - WORD_BITS)).astype(np.int64), cells, owners, lengths


def pooled(cells: np.ndarray, owners: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows at each owner's cells; 0 for one without cells."""
    values = table[cells]
    count = np.maximum(np.bincount(owners, minlength=n), 1)
    return np.stack([np.bincount(owners, weights=values[:, k], minlength=n) / count for k in range(table.shape[1])], axis=1).astype(np.float32)


def largest(cells: np.ndarray, owners: np.ndarray, n: int, odds: np.ndarray) -> np.ndarray:
    """The largest log odds of each owner's cells, owners in order; at least 0."""
    out = np.zeros(n, np.float32)
    if len(cells):
        begin = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
        out[owners[begin]] = np.maximum(np.maximum.reduceat(odds[cells], begin), 0)
    return out


def log_odds(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Between toxic and clean documents by their numbers, drawn to 0 by PRIOR documents at the overall rate."""
    return (np.log((toxic + PRIOR * rate) / (clean + PRIOR * (1 - rate)) * (1 - rate) / rate) / 2).astype(np.float32)


def vectors(word: np.ndarray, cells: np.ndarray, owners: np.ndarray, grams: np.ndarray, words: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Inputs of each word type: its characters' and its own, and what is counted of both."""
    return np.concatenate([pooled(cells, owners, len(word), grams), words[word], counted], axis=1)


def windows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of the windows over all rows; a row without words has one empty window."""
    size = np.diff(rows)
    count = np.where(size <= WINDOW, 1, -(-(size - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = np.maximum(np.minimum(number * STRIDE, size[row] - WINDOW), 0)
    return row, rows[:-1][row] + first, np.minimum(size[row] - first, WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {}
    for d in ("f", "b"):
        p |= {f"x{d}": draw(CHANNELS, 3 * HIDDEN), f"h{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"a": draw(2 * HIDDEN, HIDDEN), "ac": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, 1)[:, 0], "o": draw(2 * HIDDEN, 1)[:, 0], "oc": np.full(1, -2, np.float32)}


def gru(p: dict, d: str, inputs: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States at all steps, from inputs already times the weights (windows, steps, 3 * HIDDEN)."""
    n, steps = mask.shape
    out = np.zeros((n, steps, HIDDEN), np.float32)
    h = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        x = inputs[:, t]
        u = h @ p[f"h{d}"]
        gates = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        m = mask[:, t, None]
        new = h + m * z * (c - h)
        if keep is not None:
            keep.append((t, h, u, z, r, c, m))
        out[:, t] = h = new
    return out


def forward(p: dict, inputs: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows."""
    states = np.concatenate([gru(p, d, inputs[d], mask, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
    hidden = np.tanh(states @ p["a"] + p["ac"])
    weight = np.where(mask > 0, np.exp(hidden @ p["v"]), 0)
    weight = weight / np.maximum(weight.sum(1, keepdims=True), 1e-9)
    pooled = (weight[:, :, None] * states).sum(1)
    if keep is not None:
        keep |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
    return pooled @ p["o"] + p["oc"][0]


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean logistic loss, by back-propagation through pooling and time: for the weights, and for the inputs x."""
    keep: dict = {}
    logit = forward(p, {d: x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"}, mask, keep)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    states, hidden, weight, pooled = (keep[k] for k in ("states", "hidden", "weight", "pooled"))
    g["o"], g["oc"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * p["o"]
    d_states = weight[:, :, None] * d_pooled[:, None]
    d_weight = (states * d_pooled[:, None]).sum(2)
    d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    g["v"] = np.tensordot(d_score, hidden, 2)
    d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden * hidden)
    g["a"], g["ac"] = np.tensordot(states, d_hidden, ([0, 1], [0, 1])), d_hidden.sum((0, 1))
    d_states += d_hidden @ p["a"].T
    d_inputs = np.zeros_like(x)
    for k, d in enumerate("fb"):
        own = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        d_h = np.zeros_like(own[:, 0])
        for t, h, u, z, r, c, m in reversed(keep[d]):
            d_h = d_h + own[:, t]
            d_c = d_h * m * z * (1 - c * c)
            d_z = d_h * m * (c - h) * z * (1 - z)
            d_r = d_c * u[:, 2 * HIDDEN :] * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], 1)
            d_u = np.concatenate([d_z, d_r, d_c * r], 1)
            g[f"x{d}"] += x[:, t].T @ d_x
            g[f"c{d}"] += d_x.sum(0)
            g[f"h{d}"] += h.T @ d_u
            d_inputs[:, t] += d_x @ p[f"x{d}"].T
            d_h = d_h * (1 - m * z) + d_u @ p[f"h{d}"].T
    return g, d_inputs


class Sample:
    """The training texts as word types, windows of them, and the cells of each type."""

    def __init__(self, texts: pa.Array, labels: np.ndarray) -> None:
        reader = Texts()
        self.y = labels.astype(bool)
        types, word, cells, count, row, first, size = ([] for _ in range(7))
        n_types = n_words = 0
        for begin, _, data, offsets in text_chunks(texts):
            rows, own, own_word, own_cells, owners, _ = reader.words(data, offsets)
            types.append(own + n_types)
            word.append(own_word)
            cells.append(own_cells)
            count.append(np.bincount(owners, minlength=len(own_word)))
            r, f, s = windows(rows)
            row.append(r + begin)
            first.append(f + n_words)
            size.append(s)
            n_types, n_words = n_types + len(own_word), n_words + len(own)
        self.types = np.append(np.concatenate(types), 0)
        self.word, self.cells, self.count = np.concatenate(word), np.concatenate(cells), np.concatenate(count)
        self.begin = np.cumsum(self.count) - self.count
        self.row, self.first, self.size = np.concatenate(row), np.concatenate(first), np.concatenate(size)

    def count_documents(self, part_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with each cell by part of the sample and label, for grams and for words: (PARTS, 2, cells)."""
        owner = np.zeros(len(self.types), np.int64)
        full = self.size > 0
        owner[self.first[full]] = self.row[full]
        owner = np.maximum.accumulate(owner)[:-1]
        pairs = np.unique(owner * len(self.word) + self.types[:-1])
        doc, kind = pairs // len(self.word), pairs % len(self.word)
        out = np.zeros((PARTS, 2, 1 << GRAM_BITS), np.int32), np.zeros((PARTS, 2, 1 << WORD_BITS), np.int32)
        cuts = np.searchsorted(doc, np.arange(0, len(self.y) + 256, 256))
        for a, e in zip(cuts[:-1], cuts[1:], strict=True):
            count = self.count[kind[a:e]]
            cells = self.cells[ranges(self.begin[kind[a:e]], count)]
            for total, bits, own, cell in ((out[0], GRAM_BITS, np.repeat(doc[a:e], count), cells), (out[1], WORD_BITS, doc[a:e], self.word[kind[a:e]])):
                keys = np.unique((own << bits) | cell)
                own = keys >> bits
                np.add.at(total, (part_of[own], self.y[own].astype(np.int64), keys & ((1 << bits) - 1)), 1)
        return out

    def counted(self, grams: np.ndarray, words: np.ndarray) -> np.ndarray:
        """What these log odds of cells say of each word type."""
        owners = np.repeat(np.arange(len(self.word)), self.count)
        return np.stack([largest(self.cells, owners, len(self.word), grams), words[self.word]], axis=1)

    def batch(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(types, which of them are words) of windows, WINDOW wide."""
        step = np.arange(WINDOW)
        mask = step < self.size[chosen, None]
        return np.where(mask, self.types[np.minimum(self.first[chosen, None] + step, len(self.types) - 1)], 0), mask

    def inputs(self, types: np.ndarray, rows: np.ndarray, grams: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Vectors at these types in windows of these rows, and what back() needs. What is counted comes from the other parts of the sample."""
        unique, at = np.unique(types, return_inverse=True)
        count = self.count[unique]
        cells = self.cells[ranges(self.begin[unique], count)]
        owners = np.repeat(np.arange(len(unique)), count)
        x = vectors(self.word[unique], cells, owners, grams, words, np.zeros((len(unique), 2), np.float32))[at.reshape(types.shape)]
        x[:, :, -2:] = self.odds[self.part_of[rows][:, None], types]
        return x, (unique, at.reshape(-1), cells, owners)

    def back(self, kept: tuple, d_x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cells, gradients) for the two tables, a row for each cell touched."""
        unique, at, cells, owners = kept
        d_x = d_x.reshape(-1, CHANNELS)
        own = np.stack([np.bincount(at, weights=d_x[:, k], minlength=len(unique)) for k in range(CHANNELS)], axis=1)
        share = own[:, :GRAM_DIM] / np.maximum(self.count[unique], 1)[:, None]
        out = []
        for key, rows in ((cells, share[owners]), (self.word[unique], own[:, GRAM_DIM : GRAM_DIM + WORD_DIM])):
            touched, place = np.unique(key, return_inverse=True)
            out.append((touched, np.stack([np.bincount(place, weights=rows[:, k], minlength=len(touched)) for k in range(rows.shape[1])], axis=1).astype(np.float32)))
        return out


def train(texts: list[str] | pa.Array, labels: list[int] | np.ndarray, seed: int = 7) -> dict[str, np.ndarray] | None:
    """The model, or None if one of the labels is missing.

    Tables start at zero, so that what the sample doesn't hold says nothing. They
    learn by steps of one size for all cells, so that a rare cell moves little.
    """
    y = np.array(labels, bool)
    if y.all() or not y.any():
        return None
    sample = Sample(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string()), y)
    if not len(sample.word):
        return None
    p, rng = start(seed), np.random.default_rng(seed)
    tables = [np.zeros((1 << GRAM_BITS, GRAM_DIM), np.float32), np.zeros((1 << WORD_BITS, WORD_DIM), np.float32)]
    scale = [0.0, 0.0]
    sample.part_of = rng.integers(0, PARTS, len(y))
    counts = sample.count_documents(sample.part_of)
    rate = (y.sum() + 1) / (len(y) + 2)
    odds = lambda without: [log_odds(*(c.sum(0) - (c[without] if without >= 0 else 0))[::-1], rate) for c in counts]
    sample.odds = np.stack([sample.counted(*odds(k)) for k in range(PARTS)])
    learned = [c.sum((0, 1)) >= LEAST_DOCS for c in counts]
    owner = sample.row
    best = np.concatenate([np.where(m, sample.odds[sample.part_of[owner[a : a + 4096]][:, None], t].sum(2), -9).max(1) for a in range(0, len(owner), 4096) for t, m in [sample.batch(np.arange(a, min(a + 4096, len(owner))))]])
    first_moment, second_moment, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for round_ in range(ROUNDS):
        order = np.lexsort((-best, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        chosen = order[rank < np.where(y[owner[order]], 1, 2)]
        for _ in range(max(PASSES, -(-STEPS // -(-len(chosen) // BATCH)))):
            chosen = rng.permutation(chosen)
            for a in range(0, len(chosen), BATCH):
                part = chosen[a : a + BATCH]
                types, mask = sample.batch(part)
                mask = mask & (rng.random(mask.shape) >= DROPPED)
                x, kept = sample.inputs(types, owner[part], *tables)
                g, d_x = gradients(p, x, mask.astype(np.float32), y[owner[part]].astype(np.float32))
                step += 1
                rate = 1 - 0.9 * round_ / ROUNDS
                for k in p:
                    first_moment[k] = 0.9 * first_moment[k] + 0.1 * g[k]
                    second_moment[k] = 0.999 * second_moment[k] + 0.001 * g[k] * g[k]
                    p[k] = (p[k] - RATE * rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                for k, (cells, d_cells) in enumerate(sample.back(kept, d_x * mask[:, :, None])):
                    scale[k] = 0.99 * scale[k] + 0.01 * float(np.abs(d_cells).max())
                    d_cells *= learned[k][cells, None]
                    tables[k][cells] -= TABLE_RATE * rate * (d_cells / (scale[k] / (1 - 0.99**step) + 1e-8) + DECAY * tables[k][cells])
        best = np.concatenate([scores_of(p, tables, sample, np.arange(a, min(a + 2048, len(owner)))) for a in range(0, len(owner), 2048)])
    grams, words = odds(-1)
    return p | {"grams": tables[0], "words": tables[1], "gram_odds": grams, "word_odds": words}


def scores_of(p: dict, tables: list[np.ndarray], sample: Sample, chosen: np.ndarray) -> np.ndarray:
    types, mask = sample.batch(chosen)
    x, _ = sample.inputs(types, sample.row[chosen], *tables)
    return forward(p, {d: x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"}, mask.astype(np.float32))


class Scorer:
    def __init__(self, model: dict[str, np.ndarray] | None) -> None:
        self.model, self.reader = model, Texts()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each row, number of windows)."""
        p = self.model
        if p is None:
            return np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        rows, types, word, cells, owners, _ = self.reader.words(data, offsets)
        f = vectors(word, cells, owners, p["grams"], p["words"], np.stack([largest(cells, owners, len(word), p["gram_odds"]), p["word_odds"][word]], axis=1))
        by_type = {d: np.vstack([f @ p[f"x{d}"] + p[f"c{d}"], p[f"c{d}"]]) for d in "fb"}
        row, begin, size = windows(rows)
        step = np.arange(WINDOW)
        out = np.empty(len(row), np.float32)
        for a in range(0, len(row), 2048):
            mask = (step < size[a : a + 2048, None]).astype(np.float32)
            at = np.where(mask > 0, np.append(types, len(word))[np.minimum(begin[a : a + 2048, None] + step, len(types))], len(word))
            out[a : a + 2048] = forward(p, {d: by_type[d][at] for d in "fb"}, mask)
        count = np.bincount(row, minlength=len(rows) - 1)
        return sigmoid(np.maximum.reduceat(out, np.cumsum(count) - count).astype(np.float64)), count


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, fold: int = 2, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """The packed model, trained on labelled documents outside the held-out fold; empty without both labels.

    The sample is at most toxic_rows and clean_rows documents, chosen by a hash of
    their id among those that are there, in that order until sample_bytes of text
    are read. A document with several labels is toxic if one of them says so; one
    with several texts gives its smallest. Rows without an id, a label or a text
    are not trained on.
    """
    outside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != fold
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(outside).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    there = own.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = [there.where(F.col("label") == k).orderBy(*order).limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    sample = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, left = [], [], sample_bytes
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy().astype(np.int64))
            n = int(np.searchsorted(size, left, side="right"))
            held.append(batch.column(1)[:n])
            known.append(batch.column(0)[:n].to_numpy())
            left -= int(size[n - 1]) if n else 0
            if n < len(size):
                break
        model = train(pa.chunked_array(held, pa.string()).combine_chunks(), np.concatenate(known)) if held else None
        yield pa.RecordBatch.from_arrays([pa.array([pack(model)], pa.binary())], names=["model"])

    rows = sample.repartition(1).sortWithinPartitions(*order).select("label", "text").mapInArrow(tidy(run), "model binary").collect()
    return bytes(rows[0][0]) if rows else b""


def pack(model: dict[str, np.ndarray] | None) -> bytes:
    if model is None:
        return b""
    out = io.BytesIO()
    np.savez_compressed(out, **model)
    return out.getvalue()


def unpack(packed: bytes) -> dict[str, np.ndarray] | None:
    return dict(np.load(io.BytesIO(packed))) if packed else None


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 4, fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document row: held_out, score, predicted, windows.

    Null texts are empty and have one empty window. A row without an id is scored
    and held out. Repeated rows each give their own result. Without both labels
    to learn from, all scores are 0. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text, folds=folds, fold=fold))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(unpack(held.value))
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(2)):
                score, count = scorer(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], batch.column(1)[first:end], pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count)], names=["doc_id", "held_out", "score", "predicted", "n_windows"])

    kind = docs.schema[doc_id].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))
    return docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text")).mapInArrow(tidy(scan), f"doc_id {kind}, held_out boolean, score double, predicted int, n_windows long")


def keep_clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns, in the pass that scores them."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text))
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(unpack(held.value))
        for batch in batches:
            good = [scorer(data, offsets)[0] < threshold for _, _, data, offsets in text_chunks(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(tidy(scan), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
