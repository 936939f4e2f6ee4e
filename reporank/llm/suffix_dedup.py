"""Repeated substrings by hash-compared suffix sorting, sharded by minimizers.

Every string of `length` bytes (a window) that starts at two places or more is removed at
all of them. Each window belongs to its minimizer: of its pieces of `gram` bytes, the one
with the smallest hash. Equal windows have equal minimizers at equal offsets, so windows can
be dealt out by minimizer and compared there. Neighbouring windows mostly share theirs;
such a run of windows (a stretch) is one row, about 0.013 rows per byte.

1. Stretches whose minimizer occurs once in the corpus hold no repeated window. They are the
   bulk, and are told by a count of 8-byte keys.
2. Stretches with equal content repeat as a whole. They are counted by content, so interior
   parts of a passage in very many documents are one row per task.
3. What is left are different stretches around the same minimizer: the edges of repeated
   passages. Their suffixes from the minimizer on are sorted by mergesort; two suffixes are
   compared by binary search for their common extension, which prefix polynomial hashes tell
   in logarithmic time. Neighbours with enough in common are a block; within a block, windows
   with equal hashes of what lies before the minimizer are equal. Common extensions and
   equal windows are verified against the bytes.
4. A minimizer with more than `HELD` different stretches is not held in one task: its
   stretches are cut into single windows, which are counted by content like step 2.

Ranges are then joined per text and cut out. Copies of a text are one row from the start,
with a weight. Matches never cross documents.

Texts are known by the first 8 bytes of their SHA-256, which is checked to be different for
different texts; the run fails if it is not. Content is compared by 64-bit XXH3 among
stretches with equal 64-bit minimizer, offset and length.

Defined cases: null text is empty text; texts shorter than `length` lose nothing; identical
rows count as two places; rows without identifier are answered too; other columns are
ignored; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.llm.common import bucketed, worker_wide
from reporank.llm.rolling import Powers, Prefixes, mixed
from reporank.session import written

LENGTH, GRAM, HELD = 200, 32, 2048
CHUNK = 1 << 18  # window starts looked at together
PLACE = 20  # bits of a packed value that tell the place within a chunk


def powers():
    return worker_wide("powers", Powers)


def _window_minima(values, width):
    """Smallest value of each `width` consecutive ones, in passes over whole arrays."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with the same minimizer: start, number of windows, place of the
    minimizer, its hash. All windows of `data` are in exactly one run."""
    parts = []
    for begin in range(0, max(0, len(data) - length + 1), CHUNK):
        piece = data[begin : begin + CHUNK + length - 1]
        hashes = Prefixes(piece, powers()).grams(gram)
        packed = (hashes >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(hashes), dtype=np.uint64)
        least = _window_minima(packed, length - gram + 1)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        at = (least[starts] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        count = np.diff(np.append(starts, len(least)))
        parts.append((starts + begin, count, at + begin, hashes[at]))
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) + (np.zeros(0, dtype=np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*parts))


class Members:
    """Stretches around some minimizers, with their bytes end to end."""

    def __init__(self, contents, key, at, count, weight, length):
        size = np.array([len(c) for c in contents], dtype=np.int64)
        self.data = np.frombuffer(b"".join(contents), dtype=np.uint8)
        self.begin = np.cumsum(size) - size
        self.length, self.weight, self.count = length, weight, count
        self.at, self.key = at, key
        self.point = self.begin + at  # where the minimizer starts
        self.room = size - at  # bytes from there on
        self.prefixes = Prefixes(self.data, powers())

    def common(self, a, b):
        """Bytes that the suffixes from the minimizers of members a and b share.

        Binary search: pieces of equal hash are taken for equal.
        """
        low, high = np.zeros(len(a), dtype=np.int64), np.minimum(self.room[a], self.room[b])
        while True:
            going = low < high
            if not going.any():
                return low
            mid = (low + high + 1) // 2
            same = self.prefixes.of(self.point[a], mid) == self.prefixes.of(self.point[b], mid)
            low, high = np.where(going & same, mid, low), np.where(going & ~same, mid - 1, high)

    def common_by_bytes(self, a, b):
        """The same without hashes."""
        out = np.zeros(len(a), dtype=np.int64)
        going = np.arange(len(a))
        while len(going):
            x, y, n = a[going], b[going], out[going]
            inside = n < np.minimum(self.room[x], self.room[y])
            going, x, y, n = going[inside], x[inside], y[inside], n[inside]
            same = self.data[self.point[x] + n] == self.data[self.point[y] + n]
            going = going[same]
            out[going] += 1
        return out

    def below(self, a, b, common):
        """Whether suffix a comes before suffix b. The end of a stretch comes before any byte."""
        n = common(a, b)
        end = np.minimum(self.room[a], self.room[b])
        last = len(self.data) - 1
        x = np.where(n < self.room[a], self.data[np.minimum(self.point[a] + n, last)].astype(np.int64), -1)
        y = np.where(n < self.room[b], self.data[np.minimum(self.point[b] + n, last)].astype(np.int64), -1)
        return np.where(n < end, x < y, self.room[a] < self.room[b])

    def _sorted(self, first, size, common):
        """Mergesort of all groups at once: runs of a group double in each round.

        A member's place in a merge is its place in its own run plus its rank in the other
        one, found by binary search; equal members of the left run come first.
        """
        order = np.arange(int(size.sum()))
        group = np.repeat(np.arange(len(size)), size)
        width = 1
        while width < size.max(initial=0):
            place = np.arange(len(order)) - first[group]
            run = place // width
            low = np.minimum((run ^ 1) * width, size[group])
            high = np.minimum(low + width, size[group])
            other, right = low.copy(), run % 2 == 1
            going = np.flatnonzero(low < high)
            while len(going):
                mid = (low[going] + high[going]) // 2
                mine, theirs = order[going], order[first[group[going]] + mid]
                before = np.where(
                    right[going], ~self.below(mine, theirs, common), self.below(theirs, mine, common)
                )
                low[going] = np.where(before, mid + 1, low[going])
                high[going] = np.where(before, high[going], mid)
                going = going[low[going] < high[going]]
            to = first[group] + run // 2 * 2 * width + place % width + (low - other)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, 2 * width
        return order

    def order(self):
        """Members by group and suffix, and what each has in common with the one before.

        If the bytes do not confirm the hashes, the sort is done again by bytes.
        """
        fresh = np.concatenate([[True], self.key[1:] != self.key[:-1]])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(self.key)))
        for common in (self.common, self.common_by_bytes):
            order = self._sorted(first, size, common)
            shared = np.zeros(len(order), dtype=np.int64)
            inner = np.flatnonzero(~fresh)
            shared[inner] = common(order[inner - 1], order[inner])
            if (shared[inner] == self.common_by_bytes(order[inner - 1], order[inner])).all():
                break
        return order, shared

    def repeated(self):
        """For each member the marks of its windows that occur more than once."""
        order, shared = self.order()
        first = np.concatenate([[0], np.cumsum(self.count)])
        marks = np.zeros(int(first[-1]), dtype=bool)
        at, count, weight = self.at[order], self.count[order], self.weight[order]
        for before in range(int(at.max(initial=-1)) + 1):
            # windows that start `before` bytes ahead of the minimizer
            block = np.cumsum(shared < self.length - before)
            have = np.flatnonzero((before <= at) & (before > at - count))
            if not len(have):
                continue
            who = order[have]
            start = self.point[who] - before
            code = mixed(self.prefixes.of(start, np.full(len(who), before)) ^ mixed(block[have].astype(np.uint64)))
            by = np.argsort(code, kind="stable")
            fresh = np.concatenate([[True], code[by][1:] != code[by][:-1]])
            number = np.cumsum(fresh) - 1
            several = np.bincount(number, weights=weight[have][by])[number] > 1
            hit = by[several]
            leader = by[np.flatnonzero(fresh)][number[several]]
            if before and not self._same(start[hit], start[leader], before):
                hit = self._repeated_by_bytes(start, weight[have])
            marks[first[who[hit]] + self.at[who[hit]] - before] = True
        return marks, first

    def _same(self, a, b, n):
        return all((self.data[a + i] == self.data[b + i]).all() for i in range(n))

    def _repeated_by_bytes(self, start, weight):
        """Windows, by start, that occur more than once; decided by their bytes."""
        held = {}
        own = [self.data[s : s + self.length].tobytes() for s in start.tolist()]
        for window, w in zip(own, weight.tolist()):
            held[window] = held.get(window, 0) + w
        return np.array([i for i, window in enumerate(own) if held[window] > 1], dtype=np.int64)


def _runs(marks):
    """Start and length of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _numbers(batch, *names):
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _stretch_rows(texts, length, gram):
    def cut(batches):
        for batch in batches:
            columns, row = [], []
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer()
                found = stretches(np.frombuffer(raw, dtype=np.uint8), length, gram)
                if len(found[0]):
                    start, count, at, key = found
                    view, ends = memoryview(raw), (start + count + length - 1).tolist()
                    pieces = [view[s:e] for s, e in zip(start.tolist(), ends)]
                    content = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], dtype=np.uint64)
                    check = np.array([xxhash.xxh64_intdigest(p) for p in pieces], dtype=np.uint64)
                    columns.append((key, content, check, start, count, at - start))
                    row += [i] * len(start)
                if len(row) >= 1 << 17 or i + 1 == batch.num_rows:
                    if row:
                        key, content, check, start, count, at = (np.concatenate(c) for c in zip(*columns))
                        take = pa.array(np.array(row))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(key.view(np.int64)),
                                pa.array((content ^ (count * 1000 + at).astype(np.uint64)).view(np.int64)),
                                pa.array(check.view(np.int64)),
                                batch.column("id").take(take),
                                pa.array(start.astype(np.int64)),
                                pa.array(count.astype(np.int32)),
                                pa.array(at.astype(np.int32)),
                                batch.column("copies").take(take),
                            ],
                            ["key", "content", "check", "id", "start", "n", "at", "copies"],
                        )
                    columns, row = [], []

    return texts.select("id", "text", "copies").mapInArrow(
        cut, "key long, content long, check long, id long, start long, n int, at int, copies long"
    )


OPEN = "key long, content long, weight long, m long, n int, at int"


def _with_bytes(stretch, texts, length):
    """The bytes of each stretch, from the text it is in; a text is opened once."""
    wanted = stretch.groupBy("id").agg(F.collect_list(F.struct("key", "content", "weight", "m", "n", "at", "start")).alias("of"))

    def cut(batches):
        for batch in batches:
            for text, of in zip(batch.column("text"), batch.column("of")):
                raw, of = text.as_buffer().to_pybytes(), of.values
                begin = of.field("start").to_pylist()
                size = [n + length - 1 for n in of.field("n").to_pylist()]
                pieces = pa.array([raw[s : s + k] for s, k in zip(begin, size)], pa.binary())
                names = ["key", "content", "weight", "m", "n", "at"]
                yield pa.RecordBatch.from_arrays([*(of.field(c) for c in names), pieces], [*names, "bytes"])

    return texts.select("id", "text").join(wanted, "id").mapInArrow(cut, f"{OPEN}, bytes binary")


def _sorted_groups(members, length):
    """Ranges of repeated windows of each member; members come grouped by key."""

    def solve(held):
        key, at, n, weight = (np.concatenate(c) for c in zip(*(_numbers(b, "key", "at", "n", "weight") for b in held)))
        contents = [c for b in held for c in b.column("bytes").to_pylist()]
        content = np.concatenate(_each(held, "content"))
        group = Members(contents, key, at.astype(np.int64), n.astype(np.int64), weight, length)
        marks, first = group.repeated()
        begin, size = _runs_by_member(marks, first)
        owner = np.searchsorted(first, begin, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(key[owner]), pa.array(content[owner]), pa.array((begin - first[owner]).astype(np.int64)), pa.array(size)],
            ["key", "content", "skip", "n"],
        )

    def run(batches):
        held, rows, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            if rows >= 1 << 14:  # the last key may go on; whole keys before it are solved
                cut = int(np.searchsorted(keys != last, True)) if keys[0] == last else 0
                if cut < len(keys):
                    held.append(batch.slice(0, cut))
                    yield solve(held)
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows, last = rows + batch.num_rows, keys[-1]
        if held:
            yield solve(held)

    return members.mapInArrow(run, "key long, content long, skip long, n long")


def _each(held, name):
    return [b.column(name).to_numpy(zero_copy_only=False) for b in held]


def _runs_by_member(marks, first):
    """Runs of True that do not cross from one member to the next."""
    split = np.zeros(len(marks) + 1, dtype=np.int8)
    split[first[:-1][np.diff(first) > 0]] = 1
    before = np.concatenate([[False], marks[:-1]])
    begin = np.flatnonzero(marks & (~before | split[:-1].astype(bool)))
    after = np.concatenate([marks[1:], [False]])
    end = np.flatnonzero(marks & (~after | split[1:].astype(bool)))
    return begin, end - begin + 1


def _windows(members, length):
    """Every window of the members, by its content."""

    def cut(batches):
        for batch in batches:
            at, n = _numbers(batch, "at", "n")
            row = np.repeat(np.arange(batch.num_rows), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            contents = batch.column("bytes").to_pylist()
            digests = [xxhash.xxh3_128_digest(contents[r][p : p + length]) for r, p in zip(row.tolist(), place.tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests, pa.binary()),
                    *(batch.column(c).take(take) for c in ("key", "content", "weight")),
                    pa.array(place.astype(np.int64)),
                ],
                ["window", "key", "content", "weight", "skip"],
            )

    return members.mapInArrow(cut, "window binary, key long, content long, weight long, skip long")


def _repeated_ranges(texts, length, gram, held):
    """(id, start, n): runs of n windows from `start` on that occur more than once."""
    all_ = written(_stretch_rows(texts, length, gram))
    # written, so that the join below can split a minimizer that very many stretches have
    counts = written(all_.groupBy("key").agg(F.sum("copies").alias("places")).filter("places > 1").select("key"))
    shared = written(all_.join(counts, "key"))
    contents = shared.groupBy("key", "content").agg(
        F.sum("copies").alias("weight"), F.min(F.struct("id", "start", "n", "at")).alias("one"),
        (F.min("check") != F.max("check")).alias("clash"),
    )
    contents = written(contents.select("key", "content", "weight", "one.*", "clash"))
    if contents.filter("clash").limit(1).count():
        raise ValueError("two different passages have the same 64-bit digest")
    contents = contents.drop("clash")
    mixed_keys = contents.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("weight").alias("least"))
    mixed_keys = written(mixed_keys.filter("m > 1 AND least = 1").select("key", "m"))
    open_ = written(_with_bytes(contents.join(mixed_keys, "key"), texts, length))
    few, many = open_.filter(F.col("m") <= held), open_.filter(F.col("m") > held)
    sorted_ = _sorted_groups(few.repartition("key").sortWithinPartitions("key"), length)
    windows = _windows(many, length)
    twice = written(windows.groupBy("window").agg(F.sum("weight").alias("w")).filter("w > 1").select("window"))
    cut = windows.join(twice, "window").select("key", "content", "skip", F.lit(1).cast("long").alias("n"))
    whole = contents.filter("weight > 1").select(
        "key", "content", F.lit(0).cast("long").alias("skip"), F.col("n").cast("long").alias("n")
    )
    ranges = whole.unionByName(sorted_).unionByName(cut).select("key", "content", "skip", F.col("n").alias("run"))
    found = shared.select("key", "content", "id", "start").join(ranges, ["key", "content"])
    return found.select("id", (F.col("start") + F.col("skip")).alias("start"), F.col("run").alias("n"))


RESULT = "id long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(texts, length, with_text):
    """Texts without their ranges: how much went, a digest of the rest, and the rest."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, starts, sizes in zip(
                batch.column("text"), batch.column("starts").to_pylist(), batch.column("sizes").to_pylist()
            ):
                raw = text.as_buffer().to_pybytes()
                change = np.zeros(len(raw) + 1, dtype=np.int64)
                start = np.array(starts or [], dtype=np.int64)
                end = start + np.array(sizes or [], dtype=np.int64) + length - 1
                np.add.at(change, start, 1)
                np.add.at(change, end, -1)
                gone = np.cumsum(change[:-1]) > 0
                rest = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                digest = hashlib.sha256(rest).hexdigest()
                out.append((int(gone.sum()), len(_runs(gone)[0]), digest, rest if with_text else b""))
            columns = [
                batch.column("id"),
                pa.array([o[0] for o in out], pa.int64()),
                pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.string()),
                pa.array([o[3] for o in out], pa.binary()),
            ]
            names = ["id", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays(columns[: 4 + with_text], names[: 4 + with_text])

    return texts.mapInArrow(cut, RESULT + (", kept binary" if with_text else ""))


def _different_texts(docs, text_column):
    """The different texts with the number of rows that have them; copies go before the shuffle."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    return rows.groupBy(_id(F.col("sha")).alias("id")).agg(
        F.first("text").alias("text"),
        F.count(F.lit(1)).alias("copies"),
        (F.min("sha") != F.max("sha")).alias("clash"),
    )


def _id(sha):
    return F.conv(F.hex(F.substring(sha, 1, 8)), 16, -10).cast("long")


def without_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    held: int = HELD,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = True,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, `with_text`, kept:
    the bytes that are left (cuts may fall within a character)."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts, delete = bucketed(_different_texts(docs, text_column), "id", partitions)
    if texts.filter("clash").limit(1).count():
        delete()
        raise ValueError("two different texts have the same 64-bit id")
    ranges = _repeated_ranges(texts, length, gram, held)
    by_text = ranges.groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    results = written(_cut_out(texts.join(by_text, "id", "left").select("id", "text", "starts", "sizes"), length, with_text))
    delete()
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), _id(F.unhex(F.sha2(text, 256))).alias("id"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    return rows.join(results, "id").drop("id").withColumnRenamed("doc_id", id_column)
