"""A subword vocabulary as a double-array trie, and recursions over all segmentations of words.

The trie (Aoe 1989) runs over bytes: from state s, byte c leads to t = base[s] + c
if check[t] == s. Units of text are walked side by side: position by position,
every unit that still has a path takes one step as part of a vector operation.
"""

from __future__ import annotations

import numpy as np

#: Stands for the whitespace marker inside units: pieces hold no space of their own.
MARK = "▁"
#: Units longer than this go one by one, in plain Python.
LONG = 96
#: Units walked side by side.
WIDTH = 4096
NEVER = -np.inf


class DoubleArray:
    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        """values: not negative. Children are placed breadth first into the first gap that takes them all."""
        tree: list[dict[int, int]] = [{}]
        ends = {}
        for key, value in zip(keys, values, strict=True):
            node = 0
            for c in key:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            ends[node] = value
        size = 4 * len(tree) + 4 * 256
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        queue, single, low = [(0, 0)], 1, 1
        for node, state in queue:
            self.value[state] = ends.get(node, -1)
            codes = np.array(sorted(tree[node]), np.int64)
            if not len(codes):
                continue
            if len(codes) == 1:
                while not free[single] or single <= codes[0]:
                    single += 1
                at = single - int(codes[0])
            else:
                at, low = self._gap(free, codes, low)
            self.base[state] = at
            free[at + codes] = False
            self.check[at + codes] = state
            queue.extend((tree[node][c], at + c) for c in codes.tolist())
        top = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = (np.append(x, np.full(257, fill, np.int32))[:top] for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))

    @staticmethod
    def _gap(free: np.ndarray, codes: np.ndarray, low: int) -> tuple[int, int]:
        """A base that puts all codes on free cells, and where the next search begins: past stretches that took none."""
        step, begin = 1024, low
        while True:
            at = np.arange(begin, begin + step)
            good = np.flatnonzero(free[at[:, None] + codes].all(1))
            if len(good):
                return int(at[good[0]]), begin if begin > low else low
            begin += step


class Vocabulary:
    """Pieces with log scores out of a SentencePiece model file.

    Scores of a unigram model are taken as they are. A BPE model's scores are
    negative merge ranks; by Zipf's law, piece r of them gets log(1 / (r + 1)).
    Both are then normalised over all pieces and the end of the text, so that
    the probabilities sum to 1. A character that no piece spells takes an arc of
    its own (byte fallback), with the byte pieces' own scores.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)], np.float64)
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if (scores[plain] == np.round(scores[plain])).all():
            scores[plain] = -np.log1p(-scores[plain])
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(names[i][1:-1], 16)] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        scores[self.byte_ids] = scores[plain].min() - np.log(256)
        self.end = model.eos_id()
        scores[self.end] = scores[plain].max()
        known = [*plain, *self.byte_ids.tolist(), self.end]
        scores[known] -= np.logaddexp.reduce(scores[known])
        self.scores = scores
        self.byte_score = float(scores[self.byte_ids[0]])
        self.texts = [b""] * n
        for i in plain:
            self.texts[i] = names[i].replace(MARK, " ").encode()
        for c in range(256):
            self.texts[self.byte_ids[c]] = bytes([c])
        if any(b" " in t.lstrip(b" ") or b"\n" in t for t in (self.texts[i] for i in plain)):
            raise ValueError("a piece runs across words")
        self.longest = max(len(self.texts[i]) for i in plain)
        self.trie = DoubleArray([self.texts[i] for i in plain], plain)
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        single = [i for i in plain if len(self.texts[i].decode()) == 1]
        self.single = {self.texts[i] for i in single}

    # Units are handled in blocks of like length, as rows of a byte matrix.
    def _blocks(self, units: list[bytes]):
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        short = [i for i in order if len(units[i]) <= LONG]
        at = 0
        while at < len(short):
            some = short[at : at + WIDTH]
            yield some
            at += len(some)
        for i in order[len(short) :]:
            yield [i]

    def _arcs(self, block: list[bytes]):
        """Yields (start, end, rows, pieces) for each start in rising order and each length: the pieces that spell those bytes.

        Rows whose character at start is in no piece of its own get byte arcs, as (start, end, rows, None).
        """
        lengths = np.array([len(u) for u in block])
        top = int(lengths.max())
        codes = np.zeros((len(block), top + self.longest), np.uint8)
        codes[np.arange(top + self.longest) < lengths[:, None]] = np.frombuffer(b"".join(block), np.uint8)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        lead = np.where(codes < 0x80, 1, np.where(codes < 0xE0, 2, np.where(codes < 0xF0, 3, 4)))
        inner = (codes & 0xC0) == 0x80
        for s in range(top):
            rows = np.flatnonzero((lengths > s) & ~inner[:, s])
            if not len(rows):
                continue
            size = np.minimum(lead[rows, s], lengths[rows] - s)
            spelt = np.zeros(len(rows), bool)
            state = np.zeros(len(rows), np.int32)
            own = np.arange(len(rows))
            for k in range(min(self.longest, top - s)):
                step = base[state] + codes[rows[own], s + k]
                good = (check[step] == state) & (lengths[rows[own]] > s + k)
                own, state = own[good], step[good]
                if not len(own):
                    break
                piece = value[state]
                hit = piece >= 0
                if hit.any():
                    spelt[own[hit & (size[own] == k + 1)]] = True
                    yield s, s + k + 1, rows[own[hit]], piece[hit]
            for n in np.unique(size[~spelt]).tolist():
                yield s, s + n, rows[~spelt & (size == n)], None

    def best(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi: (pieces of all units in a row, how many each has, log scores). Ties go to the longer last piece."""
        total = np.zeros(len(units))
        sizes = np.zeros(len(units), np.int64)
        owners, ranks, found = [], [], []
        for some in self._blocks(units):
            block = [units[i] for i in some]
            own = np.array(some)
            if len(block) == 1 and len(block[0]) > LONG:
                ids, total[some[0]] = self._best_long(block[0])
                owners.append(np.full(len(ids), some[0]))
                ranks.append(np.arange(len(ids), 0, -1))
                found.append(ids)
                continue
            n, top = len(block), max(map(len, block))
            score = np.full((n, top + 1), NEVER)
            score[:, 0] = 0
            back = np.zeros((n, top + 1), np.int32)
            by = np.full((n, top + 1), -1, np.int32)
            for s, e, rows, pieces in self._arcs(block):
                new = score[rows, s] + (self.scores[pieces] if pieces is not None else (e - s) * self.byte_score)
                better = new > score[rows, e]
                r = rows[better]
                score[r, e], back[r, e] = new[better], s
                by[r, e] = pieces[better] if pieces is not None else -1
            at = np.array([len(u) for u in block])
            total[own] = score[np.arange(n), at]
            rows, rank = np.arange(n), np.zeros(n, np.int64)
            while len(rows := rows[at[rows] > 0]):  # from the ends back, all units at once
                e = at[rows]
                start, piece = back[rows, e], by[rows, e]
                spelt = piece >= 0
                rank[rows[spelt]] += 1
                owners.append(own[rows[spelt]])
                ranks.append(rank[rows[spelt]])
                found.append(piece[spelt])
                for r, x, y in zip(rows[~spelt].tolist(), start[~spelt].tolist(), e[~spelt].tolist(), strict=True):
                    ids = self.byte_ids[list(block[r][x:y][::-1])]
                    owners.append(np.full(y - x, own[r]))
                    ranks.append(rank[r] + np.arange(1, y - x + 1))
                    found.append(ids)
                    rank[r] += y - x
                at[rows] = start
        if not found:
            return np.zeros(0, np.int32), sizes, total
        owner, rank = np.concatenate(owners), np.concatenate(ranks)
        sizes = np.bincount(owner, minlength=len(units))
        flat = np.empty(len(owner), np.int32)
        flat[np.cumsum(sizes)[owner] - rank] = np.concatenate(found)
        return flat, sizes, total

    def _walk(self, unit: bytes):
        """_arcs of one long unit in plain Python: (start, end, piece or -1)."""
        if not hasattr(self, "lists"):
            self.lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value)]
        base, check, value = self.lists
        n = len(unit)
        for s in range(n):
            c = unit[s]
            if c & 0xC0 == 0x80:
                continue
            size = min(1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4, n - s)
            state, e, spelt = 0, s, False
            while e < n:
                step = base[state] + unit[e]
                if check[step] != state:
                    break
                state, e = step, e + 1
                if value[state] >= 0:
                    spelt |= e - s == size
                    yield s, e, value[state]
            if not spelt:
                yield s, s + size, -1

    def _best_long(self, unit: bytes) -> tuple[np.ndarray, float]:
        n = len(unit)
        score, back, by = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        scores = self.scores.tolist()
        for s, e, p in self._walk(unit):
            new = score[s] + (scores[p] if p >= 0 else (e - s) * self.byte_score)
            if new > score[e]:
                score[e], back[e], by[e] = new, s, p
        e, found = n, []
        while e:
            s, p = back[e], by[e]
            found.extend([p] if p >= 0 else self.byte_ids[list(unit[s:e][::-1])].tolist())
            e = s
        return np.array(found[::-1], np.int32), score[n]

    def marginal(self, units: list[bytes]) -> np.ndarray:
        """Log probability of each unit: the forward recursion, in log space, sums over all its segmentations."""
        total = np.zeros(len(units))
        for some in self._blocks(units):
            block = [units[i] for i in some]
            if len(block) == 1 and len(block[0]) > LONG:
                total[some[0]] = self._marginal_long(block[0])
                continue
            top = max(map(len, block))
            forward = np.full((len(block), top + 1), NEVER)
            forward[:, 0] = 0
            for s, e, rows, pieces in self._arcs(block):
                new = forward[rows, s] + (self.scores[pieces] if pieces is not None else (e - s) * self.byte_score)
                old = forward[rows, e]
                high, low = np.maximum(new, old), np.minimum(new, old)
                forward[rows, e] = high + np.log1p(np.exp(np.where(low == NEVER, NEVER, low - np.where(high == NEVER, 0, high))))
            total[some] = forward[np.arange(len(block)), [len(u) for u in block]]
        return total

    def _marginal_long(self, unit: bytes) -> float:
        from math import exp, log1p

        n = len(unit)
        forward = [NEVER] * (n + 1)
        forward[0] = 0.0
        scores = self.scores.tolist()
        for s, e, p in self._walk(unit):
            new = forward[s] + (scores[p] if p >= 0 else (e - s) * self.byte_score)
            high, low = (new, forward[e]) if new > forward[e] else (forward[e], new)
            forward[e] = high if low == NEVER else high + log1p(exp(low - high))
        return forward[n]


def default_model() -> str:
    """The public vocabulary file of this machine; on a cluster, give the path of one that is there."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
