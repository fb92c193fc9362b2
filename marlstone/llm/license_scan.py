"""Licence scans: fuzzy search for short notices.

A notice with k errors allowed is split into k + 1 pieces, of which one at least
must be there unchanged (pigeonhole). An Aho-Corasick automaton finds the pieces;
around each, the regex library's bounded-error matching looks for the whole
notice and tells place and errors. Beside that, fixed phrases are counted as
exact word runs. It is one pass without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_table, lower_table, text_chunks, tidy, word_bounds


class Notice(NamedTuple):
    label: str
    words: str
    errors: int


# Phrases that are counted word by word, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words are joined by single spaces; errors are inserted, deleted or changed bytes.
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "licensed under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "gnu general public license version", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "licensed under the bsd 3 clause license", 3),
    Notice("mpl", "mozilla public license version 2 0", 3),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2),
    Notice("cc-by", "licensed under cc by 4 0", 2),
    Notice("cc0", "cc0 1 0 universal public domain dedication", 4),
    Notice("proprietary", "all rights reserved", 2),
    Notice("proprietary", "proprietary and confidential", 2),
)
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,errors:int>>"


def split(words: str, parts: int) -> list[tuple[int, str]]:
    """(start, piece): the text in so many pieces of like length."""
    cuts = [round(i * len(words) / parts) for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Search:
    def __init__(self, notices: tuple[Notice, ...]) -> None:
        import ahocorasick
        import regex

        self.notices = notices
        self.patterns = [regex.compile(f"(?b)(?<![0-9a-z\\x80-\\xff])(?:{regex.escape(n.words)}){{e<={n.errors}}}(?![0-9a-z\\x80-\\xff])") for n in notices]
        self.pieces = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for start, piece in split(n.words, n.errors + 1):
                owners.setdefault(piece, []).append((i, start))
        for piece, own in owners.items():
            self.pieces.add_word(piece, (len(piece), own))
        self.pieces.make_automaton()

    def places(self, i: int, text: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """(i, start, end, errors) of a notice in a region: the best match, then those to its left and right."""
        least = len(self.notices[i].words) - self.notices[i].errors
        out, rest = [], [(low, high)]
        while rest:
            a, b = rest.pop()
            m = self.patterns[i].search(text, a, b) if b - a >= least else None
            if m:
                out.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                rest += [(a, m.start() - 1), (m.end() + 1, b)]  # without the blank on either side
        return out

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors), without overlaps, in a text of one row."""
        regions: dict[int, list[list[int]]] = {}
        for last, (size, own) in self.pieces.iter(text):
            for i, start in own:
                n = self.notices[i]
                low = max(0, last + 1 - size - start - n.errors - 1)
                high = last + 1 - size - start + len(n.words) + n.errors + 1
                spans = regions.setdefault(i, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                    spans[-1][0] = min(low, spans[-1][0])
                else:
                    spans.append([low, high])
        found = []
        for i, spans in regions.items():
            for low, high in spans:
                found += self.places(i, text, low, min(high, len(text)))
        kept: list[tuple[int, int, int, int]] = []  # of overlapping notices, the one with the smallest share of errors; in order of place
        for i, *x in sorted(found, key=lambda x: (x[3] / len(self.notices[x[0]].words), x[1] - x[2], x[1], x[0])):
            at = bisect_left(kept, x[0], key=lambda y: y[1])
            if (at == 0 or kept[at - 1][2] <= x[0]) and (at == len(kept) or kept[at][1] >= x[1]):
                kept.insert(at, (i, *x))
        return kept


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(word, label) of all places where a phrase's words stand in a row."""
    out = []
    for phrase, label in PHRASES:
        own = phrase.split()
        out += [(i, label) for i in range(len(words) - len(own) + 1) if words[i] == own[0] and words[i : i + len(own)] == own]
    return sorted(out)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row for each document row: word count, exact phrases, labels, score and the notices' spans in code points.

    score: 1 with an exact phrase or notice, else the largest 1 - errors / length
    of a notice found, else 0. Null texts are empty; texts of any length are read
    whole; of overlapping notices the one with the smaller share of errors counts,
    then the longer, then the first. Repeated rows each give their own result; a
    null id is carried through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, is_word, lower = Search(notices), class_table("alnum"), lower_table()
        word = re.compile(r"[0-9a-z\x80-\xff]+")
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32())])
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                low = lower[data]
                starts, ends, rows = word_bounds(low, offsets, is_word)
                inside = is_word[low]
                keep = inside.copy()
                keep[ends[ends < len(low)]] = True
                joined = np.where(inside, low, 0x20)[keep].tobytes().decode("latin-1")
                at = np.flatnonzero(keep)
                hits: dict[int, list] = {}
                # rows that hold none of the pieces need no closer look
                bounds = np.searchsorted(at, offsets)
                suspect = {int(np.searchsorted(bounds, last, side="right")) - 1 for last, _ in search.pieces.iter(joined)}
                for row in suspect:
                    a, b = int(bounds[row]), int(bounds[row + 1])
                    hits[row] = search.find(joined[a:b])
                out = []
                for row in range(end - first):
                    n_words = int(rows[row + 1] - rows[row])
                    a, b = int(bounds[row]), int(bounds[row + 1])
                    own = hits.get(row, ())
                    base = base_places(word.findall(joined[a:b])) if "license" in joined[a:b] else []
                    spans = []
                    if own:
                        leads = np.concatenate([[0], np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)])
                        for i, s, e, errors in own:
                            x, y = int(at[a + s] - offsets[row]), int(at[a + e - 1] + 1 - offsets[row])
                            spans.append({"label": notices[i].label, "start": int(leads[x]), "end": int(leads[y]), "errors": errors})
                    labels = {x for _, x in base} | {notices[i].label for i, *_ in own}
                    score = 1.0 if base else max((1 - errors / len(notices[i].words) for i, _, _, errors in own), default=0.0)
                    out.append((n_words, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, spans))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
                columns = [batch.column(0)[first:end], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, {SCHEMA}")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
