"""Toxicity as severity grades by cumulative-link (proportional-odds) regression.

A document is a sparse vector of words and of their first 4, 5 and 6 bytes (which catch words
whose endings vary); a word adds 1 + log of its count to its features. One weight per feature
is shared by all thresholds: P(grade >= k) = sigmoid(w.x - cut[k]) with cut[1] < cut[2] < ..., and the expected
severity is the sum of these probabilities. A document is rejected if P(grade >= 1) reaches
`reject_at`.

Labels say only toxic or not, so grades are made from them: 0 is not toxic; toxic documents
get a grade by how many words typical of toxic documents they hold, 1 up to the median and
2 above it.

The model is fitted on the driver from at most `sample_rows` labelled rows (a documented
bound; identifiers are chosen by hash and reduced to one row each before the driver gets
them, of several texts the one with the smallest hash; features are in at least `min_documents` of them and more
common in one class than in the other). Everything else covers all rows: every document is scored over its whole text, in
the task that reads it. Weights are at most `sample_rows` documents' words, so what is sent
to the tasks does not grow with the data.

Defined cases: null and empty texts have no words; with no toxic or no clean label among the
sample, every document has severity 0 and stays; labels without value or document are not
used, and of several labels of one document the most severe counts; repeated rows get the
same answer; other columns are kept by `without_toxic` and ignored otherwise.
"""

from collections import Counter
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reporank.llm.common import words

SAMPLE_ROWS, MIN_DOCUMENTS, REJECT_AT = 4000, 8, 0.25
PREFIXES = (4, 5, 6)
TELLING, TYPICAL = 1.0, 3.0  # log odds of features that are used, and that mark severity
WORDS_HELD = 200_000


def counted(text):
    """Words that are no numbers, with their counts."""
    return Counter(w for w in words(text) if not w.isdigit())


def features(word):
    return {word, *(word[:k] for k in PREFIXES if k < len(word))}


class Ordinal:
    """Shared weights by feature, and rising cuts of the grades."""

    def __init__(self, weights, cuts):
        self.weights, self.cuts = weights, cuts
        self.by_word = {}

    def __getstate__(self):
        return self.weights, self.cuts

    def __setstate__(self, state):
        self.__init__(*state)

    def weight(self, word):
        """Sum over a word's features, remembered for a bounded number of words."""
        got = sum(self.weights.get(f, 0.0) for f in features(word))
        if len(self.by_word) >= WORDS_HELD:
            self.by_word.clear()
        self.by_word[word] = got
        return got

    def reached(self, text):
        """P(grade >= k) for k = 1, 2, ..."""
        if not len(self.cuts):
            return np.zeros(0)
        get, score = self.by_word.get, 0.0
        for word, count in Counter(words(text)).items():
            weight = get(word)
            if weight is None:
                weight = 0.0 if word.isdigit() else self.weight(word)
            if weight:
                score += weight * (1.0 + log(count))
        return 1.0 / (1.0 + np.exp(np.clip(self.cuts - score, -500, 500)))


def log_odds(n_toxic, n_clean, toxic, clean):
    """Of being in a toxic document against a clean one, smoothed."""
    return log((n_toxic + 0.5) / (toxic + 1)) - log((n_clean + 0.5) / (clean + 1))


def telling(counts, toxic, min_documents, features=features):
    """Features in enough documents and not equally common in both classes, with log odds."""
    in_toxic, in_clean = Counter(), Counter()
    for own, mark in zip(counts, toxic):
        (in_toxic if mark else in_clean).update(set().union(*map(features, own)))
    n, m = int(np.sum(toxic)), int(len(toxic) - np.sum(toxic))
    odds = {f: log_odds(in_toxic[f], in_clean[f], n, m) for f in {*in_toxic, *in_clean} if in_toxic[f] + in_clean[f] >= min_documents}
    return {f: x for f, x in odds.items() if abs(x) >= TELLING}


def grades(counts, toxic, odds, features=features):
    """Grades 0, 1, 2 of labelled documents from their word counts and toxic marks."""
    strength = np.array(
        [sum(c for w, c in own.items() if max(odds.get(f, 0.0) for f in features(w)) >= TYPICAL) for own in counts]
    )
    middle = np.median(strength[toxic])
    return np.where(toxic, np.where(strength > middle, 2, 1), 0)


def fit(counts, toxic, min_documents=MIN_DOCUMENTS, ridge=2e-4, rounds=150, rate=0.2) -> Ordinal:
    """Maximum likelihood with a ridge penalty, by Adam on the whole sample."""
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return Ordinal({}, np.zeros(0))
    known = lru_cache(1 << 18)(features)  # common words come up in most documents
    odds = telling(counts, toxic, min_documents, known)
    grade = grades(counts, toxic, odds, known)
    vocabulary = {w: i for i, w in enumerate(sorted(odds))}
    row, column, value = [], [], []
    for i, own in enumerate(counts):
        for w, c in own.items():
            for f in known(w) & odds.keys():
                row.append(i), column.append(vocabulary[f]), value.append(1.0 + log(c))
    row, column, value = np.array(row, int), np.array(column, int), np.array(value)
    steps = np.arange(1, grade.max() + 1)
    target = (grade[:, None] >= steps).astype(float)
    n, size = len(counts), len(vocabulary)
    # parameters: weights, first cut, logarithms of the gaps between cuts
    state = np.zeros(size + len(steps))
    state[size] = 2.0
    first, second = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, rounds + 1):
        w, gaps = state[:size], np.exp(state[size + 1 :])
        cut = state[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(row, weights=w[column] * value, minlength=n)
        wrong = (1.0 / (1.0 + np.exp(np.clip(cut - score[:, None], -500, 500))) - target) / n
        by_cut = -wrong.sum(axis=0)
        slope = np.concatenate(
            [
                np.bincount(column, weights=wrong.sum(axis=1)[row] * value, minlength=size) + ridge * w,
                [by_cut.sum()],
                np.cumsum(by_cut[::-1])[::-1][1:] * gaps,
            ]
        )
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        state -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cut = state[size] + np.concatenate([[0.0], np.cumsum(np.exp(state[size + 1 :]))])
    return Ordinal({w: float(state[i]) for w, i in vocabulary.items()}, cut)


def _sampled(docs, labels, sample_rows, id_column, text_column, label_column):
    """One row for each of at most `sample_rows` labelled identifiers: the word counts of its
    text (of several, the one with the smallest hash) and its mark."""
    marked = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("toxic"))
        .dropna()
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").withColumn("hash", F.xxhash64("text"))

    def count(batches):
        for batch in batches:
            own = [counted(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("toxic"),
                    batch.column("hash"),
                    pa.array([b" ".join(x) for x in own], pa.binary()),
                    pa.array([list(x.values()) for x in own], pa.list_(pa.int32())),
                ],
                ["id", "toxic", "hash", "words", "counts"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(count, f"id {kind}, toxic int, hash long, words binary, counts array<int>")
    # rows of one identifier are reduced in every task before they meet
    least = found.groupBy("id").agg(F.min(F.struct("hash", "words", "counts", "toxic")).alias("least"))
    return least.select("id", "least.toxic", "least.words", "least.counts")


def _sample(*args):
    """Word counts and marks of the sample, by identifier."""
    table = _sampled(*args).toArrow()
    counts, toxic = [], []
    for i in np.argsort(np.array([str(x) for x in table.column("id").to_pylist()]), kind="stable").tolist():
        counts.append(Counter(dict(zip(table.column("words")[i].as_py().split(), table.column("counts")[i].as_py()))))
        toxic.append(table.column("toxic")[i].as_py() > 0)
    return counts, toxic


def trained(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    min_documents: int = MIN_DOCUMENTS,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Ordinal:
    counts, toxic = _sample(docs, labels, sample_rows, id_column, text_column, label_column)
    return fit(counts, toxic, min_documents)


def severity(docs: DataFrame, model: Ordinal, reject_at: float = REJECT_AT, id_column="doc_id", text_column="text") -> DataFrame:
    """Per document: doc_id, severity (expected grade), grade (most likely), rejected."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            p = [sent.value.reached(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([float(x.sum()) for x in p], pa.float64()),
                    pa.array([int(np.argmax(-np.diff([1.0, *x, 0.0]))) for x in p], pa.int32()),
                    pa.array([bool(len(x)) and bool(x[0] >= reject_at) for x in p], pa.bool_()),
                ],
                ["doc_id", "severity", "grade", "rejected"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, severity double, grade int, rejected boolean")


def without_toxic(docs: DataFrame, model: Ordinal, reject_at: float = REJECT_AT, text_column="text") -> DataFrame:
    """The documents, all columns, that are not rejected; decided where the row is read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def keep(batches):
        for batch in batches:
            p = [sent.value.reached(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([not len(x) or bool(x[0] < reject_at) for x in p], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
