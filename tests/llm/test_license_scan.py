import re
import time

from marlstone.llm.license_scan import NOTICES, PHRASES, Search, scan, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

TEXTS = [
    None, "", "!!", "Released under the MIT License.", "Relased undr the  MIT-Licnse, ok", "mit\nLicense MIT license apache LICENSE; general public license", "é Licensed ünder the Apache License, Version 2.0 x",
    "This work is licensed under the GNU General Public License, version 3.", "This work is licenced under teh GNU Genral Public License, version 3.", "Licensed under CC BY-NC 4.0.", "commit license", "mit x license", "plain text about licences and rights " * 2000 + "mit license",
]


def test_against_brute_force(spark):
    rows = [(i, t, "x", 0.5) for i, t in enumerate(TEXTS)] + [(None, "mit license", "x", 0.1), (3, TEXTS[3], "x", 0.1)]
    out = scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for d, t, *_ in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = sorted((i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[4].labels == "mit" and 0.8 < got[4].score < 1 and got[4].n_base == 0
    assert got[8].labels == "gpl" and got[9].labels == "cc-by-nc" and got[10].labels == ""
    s = got[6].spans[0]
    assert s.label == "apache" and s.errors == 2 and TEXTS[6][s.start : s.end] == "Licensed ünder the Apache License, Version 2.0"
    assert got[3].spans[0].start == 0 and TEXTS[3][: got[3].spans[0].end] == "Released under the MIT License"
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_cover_notices():
    for n in NOTICES:
        parts = split(n.words, n.errors + 1)
        assert "".join(p for _, p in parts) == n.words and min(len(p) for _, p in parts) >= 4


def test_neighbours_of_a_better_copy_are_kept():
    search = Search(NOTICES)
    for n in NOTICES:
        edited = n.words[:-2] + n.words[-1]
        if len(n.words) < 19 or not edited[-2].isalnum() or n.words[-2] == " ":
            continue
        for copies in ([edited, n.words], [edited, edited, n.words], [n.words, edited, edited], [edited, n.words, edited, n.words, edited], [edited] * 3):
            text = " ".join(["some", *copies, "word"])
            at, want = 5, []
            for c in copies:
                want.append((at, at + len(c), int(c != n.words)))
                at += len(c) + 1
            found = search.find(text)
            assert [x[1:3] for x in found if search.notices[x[0]].label == n.label] == [x[:2] for x in want], (n, copies)
            assert [x[3] for x in found if search.notices[x[0]] == n] == [x[2] for x in want if any(y[0] == NOTICES.index(n) and y[1] == x[0] for y in found)]
    text = "all rights reservd all rights reservd all rights reserved"
    assert [x[1:] for x in search.find(text)] == [(0, 18, 1), (19, 37, 1), (38, 57, 0)]


def test_very_many_notices():
    """8,000 notices in a text of one row: all of them, in order, soon."""
    began = time.time()
    found = Search(NOTICES).find("all rights reserved " * 8000)
    assert [x[1] for x in found] == [20 * k for k in range(8000)] and time.time() - began < 8


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "Released undr the MIT License"
    r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, [s.start for s in r.spans]) == (400_005, 1, 400_003, [2_000_000])
