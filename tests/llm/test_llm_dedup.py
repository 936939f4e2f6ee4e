"""Exact, fuzzy and substring dedup against plain versions, with the defined corner cases."""

import hashlib
import random
import time
from collections import Counter

import brute
import numpy as np
import pytest
from reporank.llm import line_dedup, simhash, suffix_dedup
from reporank.llm.exact_dedup import exact_duplicates
from reporank.llm.rolling import Powers, Prefixes

CLASHING = "doc_id long, text string, sha string, run int, size long, best string, key long, id long, print long"


def frame(spark, rows, extra=True):
    """Documents with columns whose names the operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(i, t, None, 1, 2, "x", 3, 4, 5) for i, t in rows], CLASHING)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(5, 120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40):  # copies and near copies
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"n{i}"
        rows.append((100 + i, " ".join(words)))
    passage = prose(rng, 60)
    rows += [(200 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(6)]
    rows += [(300, None), (301, ""), (302, "   "), (303, base[0].upper()), (304, "é" * 300), (305, "é" * 300 + "a")]
    return rows


# exact


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact(spark, keep, fan_in):
    rows = corpus() + [(400, "Same"), (401, "sAME"), (402, "same "), (403, "ÄB"), (404, "äb")]
    docs = frame(spark, rows).repartition(13)
    got = {r.doc_id: r for r in exact_duplicates(docs, keep=keep, fan_in=fan_in).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(brute.lower(t), []).append(i)
    best = max if keep == "largest" else min
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (best(ids), len(ids), i == best(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == len(rows)


def test_exact_corner_cases(spark):
    rows = [(None, "a"), (5, "A"), (5, "a"), (None, "b"), (None, "b"), (7, None), (8, "")]
    got = sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(frame(spark, rows)).collect()), key=repr
    )
    assert got == sorted(
        [(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (None, None, 2, False), (None, None, 2, False),
         (7, 8, 2, False), (8, 8, 2, True)], key=repr,
    )
    smallest = exact_duplicates(frame(spark, rows), keep="smallest").filter("keep_id = 5").count()
    assert smallest == 3
    assert exact_duplicates(frame(spark, [])).count() == 0


def test_exact_uses_no_python(spark):
    plan = exact_duplicates(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


# SimHash


def test_simhash_matches_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (f"{r.print % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.simhash(rows)


def test_pairs_and_middles_give_the_same_groups(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(6):  # chains of flips
            p ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "print long")
    want = brute.components([p for p, in signed], lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    for paired in (1, 16):
        edges = simhash.links(df, paired=paired).collect()
        linked = {frozenset((e.a, e.b)) for e in edges}
        assert brute.components(list(want), lambda a, b: frozenset((a, b)) in linked) == want


def test_fingerprints_of_very_long_texts(spark):
    rng = random.Random(8)
    text = prose(rng, 150_000, 900)
    rows = [(1, text), (2, text + " one more"), (3, "word " * 300_000), (4, "x" * 2_000_000), (5, None)]
    got = {r.doc_id: (f"{r.print % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.simhash(rows) and got[2][1] == 1


def test_block_masks():
    masks = [m % (1 << 64) for m in simhash.block_masks(5, 2)]
    assert len(masks) == 10 and all(37 <= m.bit_count() <= 40 for m in masks)
    rng = random.Random(5)
    for _ in range(500):
        flips = 1 << rng.randrange(64) | 1 << rng.randrange(64)
        assert any(not m & flips for m in masks)


def test_one_document_of_each_group_stays(spark):
    rows = corpus()
    want = {i for i, (_, group) in brute.simhash(rows).items() if i == group}
    docs = frame(spark, rows)
    got = simhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == want
    nulls = frame(spark, [(None, "a b c"), (3, "a b c"), (None, None), (9, "x y z q r s")])
    assert {r.doc_id for r in simhash.without_near_duplicates(nulls).collect()} == {3, None, 9}
    assert simhash.without_near_duplicates(frame(spark, [])).count() == 0


# lines


def line_corpus(seed=2):
    rng = random.Random(seed)
    lines = [prose(rng, rng.randrange(8, 40)) for _ in range(60)]
    rows = []
    for i in range(40):
        own = [rng.choice(lines) if rng.random() < 0.4 else prose(rng, rng.randrange(1, 30)) for _ in range(8)]
        for k in range(8):
            if rng.random() < 0.2:
                words = own[k].split()
                words[rng.randrange(len(words))] = f"changed{i}"
                own[k] = " ".join(words)
        rows.append((i, "\n".join(own)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "  " + lines[0].upper() + " \nshort"), (104, "short\nshort")]


@pytest.mark.parametrize(
    "options", [{}, {"held": 3}, {"held_bytes": 200}, {"hot": 0}, {"min_chars": 20}, {"size": 9, "rows": 4, "bands": 10}]
)
def test_lines_match_brute_force(spark, options):
    rows = line_corpus()
    found = line_dedup.repeated_lines(frame(spark, rows), **options).collect()
    got = {(r.doc_id, r.line): (r.keep_doc, r.keep_line) for r in found}
    want = brute.line_keepers(rows, **{k: v for k, v in options.items() if k in ("min_chars", "size")})
    assert got.keys() == want.keys()
    assert got == want
    assert all(r.kept == ((r.doc_id, r.line) == (r.keep_doc, r.keep_line)) for r in found)


def test_hot_keys_are_dealt_out(spark):
    """Lines of one template: nearly all share keys, which are then spread over all tasks."""
    rng = random.Random(4)
    head = prose(rng, 30)
    rows = [(i, f"{head} page {i} of 900\n{prose(rng, 12)}") for i in range(900)]
    occurrences = line_dedup._lines(frame(spark, rows), "doc_id", "text", 0)
    lines = occurrences.select("id", "text")
    hot = line_dedup._hot_keys(lines, 64, line_dedup.ROWS, line_dedup.BANDS, line_dedup.SHINGLE, 3)
    assert 0 < len(hot) <= 64
    powers, want, texts = Powers(), Counter(), lines.collect()
    keys = line_dedup.band_keys([r.text.encode() for r in texts], powers, line_dedup.factors())
    counts = Counter(keys.ravel().tolist())
    want = sorted((k, r.id) for r, own in zip(texts, keys.tolist()) for k in own if counts[k] > 1)
    for known in ([], hot):
        got = line_dedup._shared(lines, 8, line_dedup.ROWS, line_dedup.BANDS, line_dedup.SHINGLE, known)
        assert sorted(tuple(r) for r in got.collect()) == want
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = line_dedup.repeated_lines(frame(spark, rows), hot=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {(r.doc_id, r.line): (r.keep_doc, r.keep_line) for r in found} == brute.line_keepers(rows)


def test_few_and_many_sets_are_linked_alike():
    """Slots and pairs give the components of plain comparisons, whole or in two parts."""
    rng, powers = random.Random(6), Powers()
    base = [prose(rng, 40, 60) for _ in range(6)]
    lines = []
    for i in range(60):
        words = rng.choice(base).split()[: rng.randrange(20, 41)]
        words[rng.randrange(len(words))] = f"q{i}"
        lines.append(" ".join(words))
    lines += ["ab", "abc", "ab" * 300, lines[0] + " ä"]
    sets = line_dedup.shingle_sets([x.encode() for x in lines], powers)
    assert [len(s) for s in sets] == [len(brute.shingles(x)) for x in lines]

    def near(a, b):
        x, y = brute.shingles(lines[a]), brute.shingles(lines[b])
        return len(x & y) >= 0.8 * len(x | y) - 1e-9

    for split in (None, 25):
        edges = {frozenset(e) for e in line_dedup.links(sets, 0.8, split)}
        want = brute.components(range(len(lines)), lambda a, b: near(a, b) and (split is None or (a < split) != (b < split)))
        assert brute.components(range(len(lines)), lambda a, b: frozenset((a, b)) in edges) == want
    for a in range(20):
        for b in range(a):
            assert bool(line_dedup.links([sets[a], sets[b]], 0.8)) == near(a, b)


def test_repeated_lines_go_documents_stay(spark):
    rows = line_corpus()
    docs = frame(spark, rows)
    done = line_dedup.without_repeated_lines(docs)
    assert done.columns == docs.columns
    got = {r.doc_id: r.text for r in done.collect()}
    want = brute.line_keepers(rows)
    for i, text in rows:
        if text is None:
            assert got[i] is None
            continue
        rest = [x for n, x in enumerate(text.split("\n")) if want.get((i, n), (i, n)) == (i, n)]
        assert got[i] == "\n".join(rest)


def test_line_corner_cases(spark):
    line = "a line that is long enough to count"
    rows = [(None, line), (4, line), (4, line), (5, f"{line}\n{line}")]
    got = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert len(got) == 5 and all(r.keep_doc is None and r.keep_line == 0 for r in got)
    assert sum(r.kept for r in got) == 1
    assert line_dedup.repeated_lines(frame(spark, [])).count() == 0
    assert line_dedup.without_repeated_lines(frame(spark, [])).count() == 0


def test_rows_of_one_identifier_keep_their_own_lines(spark):
    """Lines go by row: what nobody repeats stays, whatever other rows share the identifier."""
    again = "this very line is repeated in several rows"
    rows = [
        (7, f"zz top unique opening of the first row\n{again}"),
        (7, f"second row with words of its own\nanother unique sentence nobody repeats\n{again}"),
        (None, f"{again}\nthe first row without identifier"),
        (None, "the second one has quite different words\nand one more line of its own"),
        (8, f"eight\n{again}\nlast of eight"),
    ]
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.without_repeated_lines(frame(spark, rows)).collect())
    left = [line for _, text in got for line in text.split("\n")]
    assert sorted(left) == sorted({line for _, text in rows for line in text.split("\n")})
    assert [i for i, _ in got] == [0, 0, 7, 7, 8]


def test_document_of_very_many_lines(spark):
    """Linear in the lines of one document: 60,000 lines, a third of them there before."""
    rng = random.Random(3)
    own = [f"{rng.getrandbits(160):x}" for _ in range(40_000)]
    lines = own + rng.sample(own, 20_000)
    rows = [(1, "\n".join(lines)), (2, "x" * 300_000 + "\nshort"), (3, "x" * 300_001 + "\n" + own[5])]
    start = time.monotonic()
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(frame(spark, rows)).collect()}
    assert got == {1: "\n".join(own), 2: rows[1][1], 3: ""}
    assert time.monotonic() - start < 120  # seconds; quadratic work takes several minutes


def test_recall_of_the_bands():
    """Pairs at 0.8 or more share a key nearly always."""
    rng = random.Random(9)
    powers, drawn = Powers(), line_dedup.factors()
    shared = total = 0
    for _ in range(400):
        words = prose(rng, 60, 5000).split()
        other = list(words)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(len(other))] = f"z{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        x, y = brute.shingles(a), brute.shingles(b)
        if len(x & y) >= 0.8 * len(x | y):
            keys = line_dedup.band_keys([a.encode(), b.encode()], powers, drawn)
            total += 1
            shared += bool(set(keys[0].tolist()) & set(keys[1].tolist()))
    assert total > 100 and shared >= 0.98 * total


# substrings


def repeat_corpus(seed=4, length=24):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 160))) for _ in range(40)]
    shared = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 60))) for _ in range(4)]
    for i in range(40):
        at = rng.randrange(len(texts[i]) + 1)
        texts[i] = texts[i][:at] + rng.choice(shared)[rng.randrange(4) :] + texts[i][at:]
    texts += [texts[0], texts[1] + "z", "ab" * 100, "x" * 90, None, "", "y" * length, shared[0] * 3]
    return list(enumerate(texts))


@pytest.mark.parametrize("held", [2048, 2])
@pytest.mark.parametrize("length,gram", [(24, 8), (10, 4), (200, 32)])
def test_substrings_match_brute_force(spark, length, gram, held):
    rows = repeat_corpus(length=length)
    if length > 100:  # longer texts and passages for the query's own options
        rows = [(i, t and t * 7 + str(i % 3) * 150) for i, t in rows] + [(90 + i, t) for i, t in repeat_corpus(9)]
    tables = len(spark.catalog.listTables())
    found = suffix_dedup.without_repeats(frame(spark, rows), length=length, gram=gram, held=held).collect()
    assert len(spark.catalog.listTables()) == tables
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(zip([i for i, _ in rows], brute.repeats([t for _, t in rows], length)))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_substrings_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 50)
    rows = repeat_corpus(8)
    found = suffix_dedup.without_repeats(frame(spark, rows), length=24, gram=8).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == dict(zip([i for i, _ in rows], brute.repeats([t for _, t in rows], 24)))


def test_substring_corner_cases(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(300))
    rows = [(None, long), (1, long), (1, long), (2, "short")]
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.without_repeats(frame(spark, rows)).collect()), key=repr)
    assert got == [(1, 300), (1, 300), (2, 0), (None, 300)]
    assert suffix_dedup.without_repeats(frame(spark, [])).count() == 0


def test_weak_hashes_are_verified():
    """With a hash that takes every piece for equal, bytes decide."""
    import numpy as np

    class Blind(Prefixes):
        def of(self, start, length):
            return np.zeros(len(np.broadcast_to(start, np.shape(start))), dtype=np.uint64)

    contents = [b"aaXbbbb", b"ccXbbbb", b"aaXbbbb", b"aaXdddd"]
    n = len(contents)
    group = suffix_dedup.Members(
        contents, np.ones(n, np.int64), np.full(n, 2), np.full(n, 3), np.ones(n, np.int64), 5
    )
    marks, first = group.repeated()
    want = {0: [1, 1, 1], 1: [0, 0, 1], 2: [1, 1, 1], 3: [0, 0, 0]}
    assert [marks[a:b].astype(int).tolist() for a, b in zip(first, first[1:])] == [want[i] for i in range(n)]
    group.prefixes = Blind(group.data, Powers())
    marks, first = group.repeated()
    assert [marks[a:b].astype(int).tolist() for a, b in zip(first, first[1:])] == [want[i] for i in range(n)]


def test_stretches_cover_every_window_once():
    import numpy as np

    rng = random.Random(6)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(700)), dtype=np.uint8)
    start, count, at, key = suffix_dedup.stretches(data, 30, 6)
    covered = Counter(s + i for s, n in zip(start.tolist(), count.tolist()) for i in range(n))
    assert covered == Counter(range(len(data) - 29))
    assert all(s + n - 1 <= a <= s + 24 for s, n, a in zip(start, count, at))


def test_line_keys_of_all_bands_are_mixed_together(monkeypatch):
    """One pass per row over the keys of all bands: the same keys, whatever the chunk."""
    lines = [f"a line with number {i} in it, and é".encode() for i in range(300)] + [b"", b"abc"]
    drawn, calls = line_dedup.factors(), []
    mixed = line_dedup.mixed
    monkeypatch.setattr(line_dedup, "mixed", lambda x: calls.append(1) or mixed(x))
    keys = line_dedup.band_keys(lines, Powers(), drawn)
    assert len(calls) <= line_dedup.ROWS + 1  # and one for lines shorter than a shingle
    hashes, first, count = line_dedup.shingle_hashes(lines, Powers())
    for line in (0, 150, 300, 301):
        own = (hashes[first[line] : first[line] + count[line]] >> np.uint64(32)).astype(np.uint32)
        for band in range(line_dedup.BANDS):
            key = np.uint64(band)
            for factor in drawn[band * line_dedup.ROWS :][: line_dedup.ROWS]:
                key = mixed(np.array([key ^ np.uint64((own * factor).min())]))[0]
            assert keys[line, band] == key.view(np.int64)
    monkeypatch.setattr(line_dedup, "CHUNK", 100)
    assert (line_dedup.band_keys(lines, Powers(), drawn) == keys).all()


def test_line_links_of_few_and_many_sets_agree(monkeypatch):
    rng, powers = random.Random(5), Powers()
    base = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(4)]
    lines = [b[:k] + "X" + b[k + 1 :] for b in base for k in (0, 58, 30)]
    sets = line_dedup.shingle_sets([x.encode() for x in lines], powers)
    for n in range(2, len(sets) + 1):
        for split in (None, *range(1, n)):
            monkeypatch.setattr(line_dedup, "FEW", 100)
            few = line_dedup.links(sets[:n], 0.7, split)
            monkeypatch.setattr(line_dedup, "FEW", 0)
            assert line_dedup.links(sets[:n], 0.7, split) == few
