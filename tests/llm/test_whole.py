"""Line dedup that leaves nothing out: every line, short shingles."""

import random

import brute
import pytest
from test_llm_dedup import frame, line_corpus

from reporank.llm import line_dedup
from reporank.llm.rolling import Powers


def jaccard(a, b):
    return len(a & b) / len(a | b)


def points(line, size=5):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


SHORT = [(500, "ok\n\nok\n \n--\nyes"), (501, "OK \nno\n--\nчто\nab"), (502, "что\nab\n\n1234567 abcdef"), (503, "1234567 abcdef")]


def test_short_and_blank_lines_have_rows(spark):
    rows = line_corpus() + SHORT
    docs = frame(spark, rows)
    found = line_dedup.repeated_lines(docs).collect()
    assert len(found) == sum(len((t or "").split("\n")) for _, t in rows)
    got, want = {(r.doc_id, r.line): (r.keep_doc, r.keep_line) for r in found}, brute.line_keepers(rows)
    assert got == want
    assert got[501, 0] == (500, 0) and got[503, 0] == (502, 3) and got[500, 3] == (500, 3)
    done = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    assert done[500] == "ok\n\n \n--\nyes" and done[501] == "no\nчто\nab" and done[503] == ""


@pytest.mark.parametrize("letters", ["abcdefghijklmnop rstu", "абвгдежзийклмно рсту", "あいうえおかきくけこ さしすせ"])
def test_one_letter_changed(letters):
    """Such lines are linked exactly if their Jaccard is 0.8, so from 49 code points on always."""
    rng, powers, drawn = random.Random(7), Powers(), line_dedup.factors()
    near = shared = 0
    for length in range(20, 101):
        line = "".join(rng.choice(letters) for _ in range(length))
        at = rng.randrange(5, length - 5)
        other = line[:at] + "#" + line[at + 1 :]
        similar = jaccard(points(line), points(other)) >= 0.8
        two = [line.encode(), other.encode()]
        assert bool(line_dedup.links(line_dedup.shingle_sets(two, powers), 0.8)) == similar
        assert similar or length < 49 + 9
        keys = line_dedup.band_keys(two, powers, drawn)
        near += similar
        shared += similar and bool(set(keys[0].tolist()) & set(keys[1].tolist()))
    assert near >= 50 and shared >= 0.98 * near
