"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, union-find.

Lines are compared after trimming blanks and lower-casing A-Z. Equal lines become one row.
Each different line gets `BANDS` x `ROWS` minimum hashes over its shingles of `size` code
points; lines that agree in all rows of a band share a key and are compared exactly: they are
linked if the Jaccard similarity of their shingle sets (64-bit hashes of the shingles) is at
least `SIMILARITY`. Linked
lines form groups (connected components, distributed union-find), and of each group the
first line in (identifier, line number) order stays.

A pair as similar as `SIMILARITY` shares a key with probability 1 - (1 - s^ROWS)^BANDS: 0.994
at 0.8, 0.9997 at 0.87. Lines are signed once; the rows of (key, line) are dealt out by key,
about `PICKED` to a task, and those whose key nobody else has go. A key with more than a task's share of all
rows (told from every `SAMPLED`th line) is dealt out by line and skips that test. Lines that
share a key are compared in the task that holds the key, as far as they are not connected yet
and their sizes allow it; no pairs are produced. A key with more than `HELD` lines or
`HELD_BYTES` of text is cut into parts, and every two parts meet in a task of their own, so
all lines of the key are still compared. Keys that the same lines share (by their number and
a 64-bit hash of their ids) are one.

The different lines' texts are shuffled once, into a table in buckets of the line's hash,
which later joins read in place; it is dropped in the end, also after a failure.

Lines of any length are compared. Shingles are 5 code points: a line of 49 or more with one
inner letter changed is at 0.8 or more, unless shingles repeat in it; a line shorter than a
shingle is one shingle, so it only equals itself.

Defined cases: null text is empty text; lines shorter than `min_chars` after trimming (none
by default) are not looked at: they stay, are in no group and have no row; blank lines always
stay and are in no group; a place is an identifier, a hash of the whole text and a line
number, in this order: rows that repeat an identifier with another text are documents of
their own, rows that repeat both have the same lines, which stay or go together; rows without
identifier come first; two lines whose 64-bit hashes collide are told apart by a second hash,
and the one with the larger second hash stays as it is; other columns are kept by
`without_repeated_lines`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reporank.llm.common import bucketed
from reporank.llm.rolling import Powers, Prefixes, mixed
from reporank.operators.components import connected_components
from reporank.session import written

SHINGLE, ROWS, BANDS, SIMILARITY, MIN_CHARS = 5, 5, 13, 0.8, 0
HELD = 4096  # lines of one part of a key
HELD_BYTES = 4 << 20  # of their texts
SAMPLED, HOT = 64, 64  # every how manieth line is judged by; rows there of a key that may be hot
CUT_BYTES = 8 << 20  # of lines in an Arrow batch
PACKED = 1 << 20  # rows of (key, line) that are dealt out at a time
PICKED = 1 << 22  # and that a task looks through, about: 64 MB
FEW = 4  # sets up to which pairs are compared at once, one by one
SIGNED = 1024  # rows taken out of an Arrow batch at a time
CHUNK = 1 << 17  # shingles hashed at a time; their hashes stay in the processor's cache


def _points(lines):
    """The code points of all lines, end to end, and how many each line has."""
    data = b"".join(lines)
    if data.isascii():
        return np.frombuffer(data, dtype=np.uint8), np.array([len(x) for x in lines], dtype=np.int64)
    texts = [x.decode("utf-8", "replace") for x in lines]
    length = np.array([len(x) for x in texts], dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"), length


def shingle_hashes(lines: list[bytes], powers: Powers, size: int = SHINGLE):
    """Hashes of all shingles of all lines, end to end, where each line's begin, and how many
    it has.

    A line shorter than a shingle is one shingle.
    """
    data, length = _points(lines)
    begin = np.cumsum(length) - length
    count = np.maximum(1, length - size + 1)
    first = np.cumsum(count) - count
    prefixes = Prefixes(data, powers)
    grams = np.append(prefixes.grams(size), np.zeros(min(size, len(data) + 1), dtype=np.uint64))
    hashes = grams[np.arange(int(count.sum())) - np.repeat(first - begin, count)]
    short = np.flatnonzero(length < size)
    hashes[first[short]] = mixed(prefixes.of(begin[short], length[short]))
    return hashes, first, count


def band_keys(lines: list[bytes], powers: Powers, factors: np.ndarray, rows: int = ROWS, size: int = SHINGLE):
    """One 64-bit key per line and band, over the upper halves of the shingles' hashes."""
    bands = len(factors) // rows
    out = np.empty((len(lines), bands), dtype=np.uint64)
    begin = 0
    while begin < len(lines):
        end, held = begin, 0
        while end < len(lines) and (held < CHUNK or end == begin):
            held += len(lines[end])
            end += 1
        hashes, first, _ = shingle_hashes(lines[begin:end], powers, size)
        hashes = (hashes >> np.uint64(32)).astype(np.uint32)
        scratch = np.empty_like(hashes)
        least = np.empty((rows, bands, end - begin), dtype=np.uint32)
        for band in range(bands):
            for row in range(rows):
                np.multiply(hashes, factors[band * rows + row], out=scratch)
                np.minimum.reduceat(scratch, first, out=least[row, band])
        key = np.arange(bands, dtype=np.uint64)[:, None]
        for own in least:
            key = mixed(key ^ own)
        out[begin:end] = key.T
        begin = end
    return out.view(np.int64)


def factors(rows: int = ROWS, bands: int = BANDS, seed: int = 8111) -> np.ndarray:
    """Odd factors; a product with one orders mixed hashes anew."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 31, rows * bands, dtype=np.uint32)
    return drawn * np.uint32(2) + np.uint32(1)


def _different(values, first):
    """The different values of each part, sorted, end to end, and where each part ends.

    Parts begin at `first`; `values` is sorted in place.
    """
    for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(values)]):
        values[begin:end].sort()
    fresh = np.append(True, values[1:] != values[:-1])
    fresh[first] = True
    return values[fresh], np.cumsum(np.add.reduceat(fresh, first, dtype=np.int64))


def shingle_sets(lines: list[bytes], powers: Powers, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each line."""
    if not lines:
        return []
    hashes, first, _ = shingle_hashes(lines, powers, size)
    different, ends = _different(hashes, first)
    ends = ends.tolist()
    return [different[begin:end] for begin, end in zip([0, *ends], ends)]


def _near(a, b, similarity):
    """Whether two sorted sets have the Jaccard similarity."""
    both = np.concatenate((a, b))
    both.sort()
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared >= similarity * (len(both) - shared) - 1e-9


def links(sets: list[np.ndarray], similarity: float, split: int | None = None):
    """Index pairs that connect all sets that are similar, as few as needed.

    With `split`, only sets before it and sets from it on are compared with each other. What
    is connected already is not compared, nor are sizes that are too far apart. Many sets are
    first counted by slots of their hashes, of which two different ones may share one: that
    gives too large a count at most, and only what passes by it is compared exactly.
    """
    n, out = len(sets), []
    if n <= FEW:
        group = list(range(n))
        for x in range(split or n - 1):
            for y in range(split or x + 1, n):
                less, more = sorted((len(sets[x]), len(sets[y])))
                if group[x] != group[y] and less >= similarity * more - 1e-9 and _near(sets[x], sets[y], similarity):
                    group = [group[x] if g == group[y] else g for g in group]
                    out.append((x, y))
        return out
    size_of = np.array([len(s) for s in sets])
    begin = np.cumsum(size_of) - size_of
    slots = (np.concatenate(sets) >> np.uint64(48)).astype(np.uint16)
    marked, group = np.zeros(1 << 16, dtype=bool), np.arange(n)
    for x in range(split or n - 1):
        if len(out) == n - 1:
            break
        low = split or x + 1
        others = np.flatnonzero(
            (group[low:] != group[x])
            & (np.minimum(size_of[low:], size_of[x]) >= similarity * np.maximum(size_of[low:], size_of[x]) - 1e-9)
        )
        if not len(others):
            continue
        if len(others) > FEW:
            own = slots[begin[x] : begin[x] + size_of[x]]
            marked[own] = True
            shared = np.add.reduceat(marked[slots[begin[low] :]].astype(np.int32), begin[low:] - begin[low])[others]
            marked[own] = False
            shared = np.minimum(shared, size_of[low:][others])
            others = others[shared >= similarity * (size_of[low:][others] + size_of[x] - shared) - 1e-9]
        for y in (others + low).tolist():
            if group[y] != group[x] and _near(sets[x], sets[y], similarity):
                group[group == group[y]] = group[x]
                out.append((x, y))
    return out


def _whole(text):
    """Tells rows of one identifier apart: a hash of the whole text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs, id_column, text_column, min_chars):
    """Every line that can be a duplicate: where it is, its hash, its text."""
    rows = docs.select(F.col(id_column).alias("doc_id"), _whole(F.col(text_column)).alias("whole"), F.col(text_column).alias("text"))

    def landed(batch, of, line, text):
        columns = [batch.column(c).take(pa.array(of)) for c in ("doc_id", "whole")]
        texts = pa.array(text, pa.binary()).cast(pa.string())  # bytes.lower() changes A-Z only
        return pa.RecordBatch.from_arrays([*columns, pa.array(line, pa.int32()), texts], ["doc_id", "whole", "line", "text"])

    def cut(batches):
        for batch in batches:
            of, line, text, held = [], [], [], 0
            for i, whole in enumerate(batch.column("text")):
                data = whole.as_buffer().to_pybytes() if whole.is_valid else b""
                for n, own in enumerate(data.lower().split(b"\n")):
                    own = own.strip(b" ")
                    if min_chars and len(own.decode()) < min_chars:
                        continue
                    of.append(i), line.append(n), text.append(own)
                    held += len(own) + 16
                    if held >= CUT_BYTES:
                        yield landed(batch, of, line, text)
                        of, line, text, held = [], [], [], 0
            yield landed(batch, of, line, text)

    kind = rows.schema["doc_id"].dataType.simpleString()
    cut_ = rows.mapInArrow(cut, f"doc_id {kind}, whole long, line int, text string")
    return cut_.select("doc_id", "whole", "line", F.xxhash64("text").alias("id"), F.hash("text").alias("check"), "text")


def _signatures(lines, rows, bands, size):
    """Function for mapInArrow over (id, text): (ids, keys by line and band) of some lines at a time."""
    drawn = factors(rows, bands)

    def sign(batches):
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, SIGNED):
                batch = whole.slice(at, SIGNED)
                own = [t.as_buffer().to_pybytes() for t in batch.column("text")]
                yield batch.column("id").to_numpy(), band_keys(own, powers, drawn, rows, size)

    return sign


def _hot_keys(lines, partitions, rows, bands, size, least):
    """Keys that hold more than a task's share of all rows, judged by every `SAMPLED`th line.

    At most `partitions` keys, so they can travel with the plan.
    """
    sign = _signatures(lines, rows, bands, size)

    def keys(batches):
        for _, own in sign(batches):
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel())], ["key"])

    drawn = lines.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(SAMPLED)) == 0).select("id", "text")
    counts = written(drawn.mapInArrow(keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r.key for r in counts.filter(F.col("n") > max(least, total / partitions)).select("key").collect()]


def _shared(lines, partitions, rows, bands, size, hot):
    """(key, id) of the lines and bands whose key other lines have too.

    Rows of a key meet in one task, in packets of bytes, and those that have no equal
    neighbour in its order go. Rows of hot keys are dealt out by line and all stay.
    """
    sign, known = _signatures(lines, rows, bands, size), np.array(sorted(hot), dtype=np.int64)

    def deal(batches):
        held, size_ = [], 0

        def packets():
            key = np.concatenate([k.ravel() for _, k in held])
            id_ = np.concatenate([np.repeat(i, bands) for i, _ in held])
            place = np.where(np.isin(key, known), id_, key) if len(known) else key
            task = (mixed(place.view(np.uint64)) % np.uint64(partitions)).astype(np.uint16 if partitions < 1 << 16 else np.int64)
            order = np.argsort(task, kind="stable")
            end = np.cumsum(np.bincount(task, minlength=partitions))
            both = np.stack([key[order], id_[order]], axis=1)
            used = np.unique(task)
            data = [both[end[t - 1] if t else 0 : end[t]].tobytes() for t in used.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], ["task", "rows"])

        for own in sign(batches):
            held.append(own)
            size_ += own[1].size
            if size_ >= PACKED:
                yield packets()
                held, size_ = [], 0
        if held:
            yield packets()

    def pick(batches):
        data = [x.as_buffer().to_pybytes() for b in batches for x in b.column("rows")]
        both = np.frombuffer(b"".join(data), dtype=np.int64).reshape(-1, 2)
        data.clear()
        order = np.argsort(both[:, 0])
        key = both[order, 0]
        same = key[1:] == key[:-1]
        stays = (np.append(same, False) | np.append(False, same)) if len(key) else np.zeros(0, dtype=bool)
        stays |= np.isin(key, known)
        key, id_ = key[stays], both[order[stays], 1]
        for at in range(0, max(1, len(key)), PACKED):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + PACKED]), pa.array(id_[at : at + PACKED])], ["key", "id"])

    dealt = lines.select("id", "text").mapInArrow(deal, "task int, rows binary").repartitionById(partitions, F.col("task"))
    return dealt.select("rows").mapInArrow(pick, "key long, id long")


def _compared(members, similarity, size):
    """Links among the lines of each (key, i, j); rows come grouped by it.

    Parts i and j of a key are compared with each other, or one part with itself.
    """

    def compare(batches):
        powers, last, held = Powers(), None, []

        def close():
            held.sort(key=lambda x: x[:2])
            split = sum(x[0] == last[1] for x in held) if last[1] != last[2] else None
            if len(held) > 1 and split not in (0, len(held)):
                for x, y in links([x[2] for x in held], similarity, split):
                    yield held[x][1], held[y][1]

        def landed(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[c] for e in edges], pa.int64()) for c in (0, 1)], ["a", "b"])

        for whole in batches:
            edges = []
            for at in range(0, whole.num_rows, SIGNED):
                batch = whole.slice(at, SIGNED)
                sets = shingle_sets([t.as_buffer().to_pybytes() for t in batch.column("text")], powers, size)
                rows = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "part", "id")), sets)
                for key, i, j, part, id_, own in rows:
                    if last != (key, i, j):
                        edges += close() if held else []
                        last, held = (key, i, j), []
                    held.append((part, id_, own))
            yield landed(edges)
        if held:
            yield landed(list(close()))

    return members.mapInArrow(compare, "a long, b long")


def _similar(lines, partitions, similarity, rows, bands, size, held, held_bytes, least):
    """Edges between similar lines of the bucketed table `lines`."""
    hot = _hot_keys(lines, partitions, rows, bands, size, least)
    tasks = max(partitions, -(-lines.count() * bands // PICKED))  # the count is in the files' footers
    shared = written(_shared(lines, tasks, rows, bands, size, hot))
    found = shared.join(lines.select("id", "bytes"), "id").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("id")).alias("who")
    )
    # The same lines mostly share several keys: one key is enough for each set of lines.
    # Written, so that the join below can split a key that very many share.
    one = written(found.filter("n > 1").groupBy("n", "bytes", "who").agg(F.min("key").alias("key")))
    members = shared.join(one, "key")
    parts = F.greatest(F.ceil(F.col("n") / held), F.ceil(F.col("bytes") / held_bytes))
    parts = F.least(parts, F.col("n")).cast("int")
    part = F.pmod(F.xxhash64("id"), parts).cast("int")
    members = members.select("key", "id", part.alias("part"), F.sequence(F.lit(0), parts - 1).alias("others"))
    meeting = members.select("key", "id", "part", F.explode("others").alias("other"))
    meeting = meeting.select(
        "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id"
    )
    texts = meeting.join(lines.select("id", "text"), "id")
    met = texts.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return _compared(met, similarity, size).distinct()


def grouped(
    occurrences: DataFrame,
    similarity: float = SIMILARITY,
    rows: int = ROWS,
    bands: int = BANDS,
    held: int = HELD,
    size: int = SHINGLE,
    held_bytes: int = HELD_BYTES,
    hot: int = HOT,
) -> DataFrame:
    """For the hash of every line of (doc_id, whole, line, id, check, text) that is there more
    than once, or has similar ones, the check and place of the one that stays: (id, check,
    keep_doc, keep_whole, keep_line). Empty lines are in no group."""
    partitions = int(occurrences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = occurrences.groupBy("id").agg(
        F.min(F.struct("check", "doc_id", "whole", "line")).alias("first"),
        F.min(F.struct("check", "text")).alias("least"),
        F.count(F.lit(1)).alias("n"),
    )
    table = different.select("id", "first", F.col("least.text").alias("text"), "n").filter("text <> ''")
    table = table.withColumn("bytes", F.octet_length("text"))
    lines, delete = bucketed(table, "id", partitions)
    try:
        edges = written(_similar(lines, partitions, similarity, rows, bands, size, held, held_bytes, hot))
        groups = connected_components(edges, "a", "b")
        slim = lines.select("id", "first", "n").join(groups, lines.id == groups.node, "left")
        slim = slim.filter("n > 1 OR component IS NOT NULL")
        slim = written(slim.select("id", "first", F.coalesce("component", "id").alias("component")))
        place = F.struct("first.doc_id", "first.whole", "first.line")
        keepers = written(slim.groupBy("component").agg(F.min(place).alias("keep")))
        keep = (F.col(f"keep.{c}").alias(f"keep_{name}") for c, name in (("doc_id", "doc"), ("whole", "whole"), ("line", "line")))
        return written(slim.join(keepers, "component").select("id", F.col("first.check").alias("check"), *keep))
    finally:
        delete()


def line_groups(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The lines of the documents (doc_id, whole, line, id, check), and for the hash of every
    line that is there more than once, or has similar ones, the check and place of the line
    that stays: (id, check, keep_doc, keep_whole, keep_line). The options are those of `grouped`."""
    occurrences = _lines(docs, id_column, text_column, min_chars)
    return occurrences.drop("text"), grouped(occurrences, **options)


def _judged(docs, **options):
    """Every line with the place of the line that stays, null if it is in no group."""
    lines, kept = line_groups(docs, **options)
    places = ("doc_id", "whole", "line", "keep_doc", "keep_whole", "keep_line")
    return lines.join(kept, ["id", "check"], "left").select(*places)


def _is_keeper():
    same = F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("line") == F.col("keep_line"))
    return same & (F.col("whole") == F.col("keep_whole"))


def repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """Per line of at least `min_chars` (0: of every line, blank ones too): doc_id, line (from 0), keep_doc, keep_line (the line
    of its group that stays; itself if it is alone) and kept."""
    judged = _judged(docs, **options)
    alone = F.col("keep_line").isNull()
    return judged.select(
        "doc_id",
        "line",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_doc")).alias("keep_doc"),
        F.coalesce("keep_line", "line").alias("keep_line"),
        (alone | _is_keeper()).alias("kept"),
    )


@F.arrow_udf(StringType())
def _rest(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines at the given places; null where either is null."""
    out = []
    for text, places in zip(texts, gone):
        text, places = text.as_py(), places.as_py()
        if text is None or places is None:
            out.append(None)
            continue
        places = set(places)
        out.append("\n".join(line for n, line in enumerate(text.split("\n")) if n not in places))
    return pa.array(out, pa.string())


_rest = _rest.asNondeterministic()  # called once per row


def without_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, less the lines that another one stands for.

    A document all of whose lines go keeps an empty text: no document is dropped.
    """
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    gone = _judged(docs, **options).filter(F.col("keep_line").isNotNull() & ~_is_keeper())
    gone = gone.groupBy("doc_id", "whole").agg(F.collect_set("line").alias("_gone"))
    gone = gone.select(F.col("doc_id").alias("_from"), F.col("whole").alias("_whole"), "_gone")
    own = docs[id_column].eqNullSafe(gone["_from"]) & (_whole(docs[text_column]) == gone["_whole"])
    text = F.when(F.col("_gone").isNull(), F.col(text_column)).otherwise(_rest(text_column, "_gone"))
    return docs.join(gone, own, "left").withColumn(text_column, text).select(*docs.columns)
