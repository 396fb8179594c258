"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Features are all words of the labelled examples: runs of letters and of characters beyond ASCII,
lower-cased. A word weighs ``(1 + ln tf) * idf * (1 + sqrt(G))``, with document frequencies over
all documents and ``G`` the likelihood ratio of the word and the label among the examples, so
words that tell labels apart count most and no word is left out. Examples are at most ``EXAMPLES``
of each label, those of the smallest hash, weighed by how many labelled documents each stands
for; they are the only bounded sample. Words that no example holds could add to no product; they
have no place in the vectors.

The index holds its examples in blocks of ``BLOCK``, and each word's largest weight in each block.
Whole batches of texts are scored: the product of a text's weights with those maxima bounds its
cosine with every example of a block; all texts first open their two most promising blocks, and then
every block that can still hold one of the ``NEAREST``. Within a block, words of many examples are
multiplied as matrices and the postings of the others are added up. Equal vectors are scored once.

The votes of the nearest are weighed by cosine and smoothed by the share of toxic labels, so scores
read as rates; texts without a word of the examples get the share among such examples.

Nulls and ties: a null text has no words. Documents without an id are scored, learn nothing and
are not held out; repeated rows are scored alike; rows of one id and text are one example; labels
that are null are ignored. Equal cosines go to the smaller example number. Without labels every
score is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrank.llm.common import in_arrow, parts, ranges, slices, strings, table, utf8, written

EXAMPLES = 2_000
BLOCK = 128
FIRST_BLOCKS = 2
NEAREST = 25
SMOOTHING = 0.5  # in cosines
PREDICT_FROM = 0.3
BATCH_ROWS = 256
RUN = 4_096  # features whose document frequencies are one row of a task

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every word of a batch of texts, and the words by code."""
    data, off = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    ends = np.append(inside[1:] < inside[:-1], inside[-1:]) | (inside & edge[1:])
    ends = np.flatnonzero(ends & inside) + 1
    starts = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])[: len(inside)]))
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    found = strings(data[inside], cuts, pa.binary()).dictionary_encode()
    row = np.searchsorted(off, starts, side="right") - 1
    return row, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def vectors(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """``docs`` without the text, with ``f`` (feature numbers, ascending) and ``tf`` of the vocabulary's words."""
    kept = [c for c in docs.columns if c not in ("text", "f", "tf")]
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = max(len(known.value), 1)
        for whole in batches:
            for batch in slices(whole, len(kept)):
                row, code, words = words_of(batch.column(len(kept)))
                place = pc.fill_null(pc.index_in(words, known.value), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                f = place[code] if len(code) else code
                key, n = np.unique((row * wide + f)[f >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(key // wide, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % wide, n)]
                yield pa.record_batch([*batch.columns[:-1], *lists], names=[*kept, "f", "tf"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*kept).schema)
    return in_arrow(docs.select(*kept, "text"), run, f"{fields}, f array<int>, tf array<int>")


def document_frequencies(every: DataFrame, n_features: int) -> np.ndarray:
    """In how many rows each feature occurs; tasks hand on sums of runs of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-n_features // RUN) * RUN, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(total))
        total = total.reshape(-1, RUN)
        some = np.flatnonzero(total.any(axis=1))
        ends = np.arange(0, len(some) * RUN + 1, RUN, dtype=np.int32)
        yield pa.record_batch([pa.array(some), pa.ListArray.from_arrays(pa.array(ends), pa.array(total[some].ravel()))], names=["run", "n"])

    out = np.zeros(-(-n_features // RUN) * RUN, np.int64)
    sums = in_arrow(every.select("f"), run, "run bigint, n array<bigint>")
    sums = sums.select("run", F.posexplode("n").alias("at", "n")).where("n > 0").groupBy("run", "at").agg(F.sum("n").alias("n"))
    # One row for each word of the examples.
    got = sums.toArrow()
    out[got["run"].to_numpy() * RUN + got["at"].to_numpy()] = got["n"].to_numpy()
    return out[:n_features]


def label_ratio(row: np.ndarray, f: np.ndarray, toxic: np.ndarray, n_features: int) -> np.ndarray:
    """The likelihood ratio of each feature and the label, from the distinct features of examples."""
    n1, n0 = float(toxic.sum()), float(len(toxic) - toxic.sum())
    a = np.bincount(f, toxic[row], n_features)
    b = np.bincount(f, 1 - toxic[row], n_features)
    if not n1 or not n0:
        return np.zeros(n_features)
    share = (a + b) / (n1 + n0)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        good = (seen > 0) & (expected > 0)
        return np.where(good, seen * np.log(np.where(good, seen, 1) / np.where(good, expected, 1)), 0)

    return np.maximum(2 * (part(a, n1 * share) + part(b, n0 * share) + part(n1 - a, n1 * (1 - share)) + part(n0 - b, n0 * (1 - share))), 0)


def unit(f: np.ndarray, tf: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of rows that start at ``starts`` (one more than rows), each row of length 1."""
    x = (1 + np.log(tf)) * weight[f]
    upto = np.concatenate([[0.0], np.cumsum(x * x)])
    length = np.sqrt(np.maximum(upto[starts[1:]] - upto[starts[:-1]], 1e-300))
    return x / np.repeat(length, np.diff(starts))


class BlockMax:
    """The index, built in a task from the arrays of :func:`fit`."""

    def __init__(self, starts, f, tf, toxic, stands_for, ids, weight):
        self.weight = weight
        n = np.diff(starts)
        some = n > 0
        self.share = float((stands_for * toxic).sum() / stands_for.sum()) if len(toxic) else 0.0
        bare = ~some
        self.bare = float((stands_for * toxic)[bare].sum() + self.share) / float(stands_for[bare].sum() + 1) if len(toxic) else 0.0
        value = unit(f, tf, starts, weight)
        row = np.repeat(np.arange(len(n)), n)
        # Examples that share their heaviest word lie in one block.
        top = np.zeros(len(n), np.int64)
        heaviest = np.lexsort((-value, row))
        top[some] = f[heaviest[starts[:-1][some]]]
        order = np.lexsort((np.arange(len(n)), top))
        order = order[some[order]]
        place = np.full(len(n), -1, np.int64)
        place[order] = np.arange(len(order))
        self.toxic, self.stands_for, self.ids = toxic[order], stands_for[order], ids[order]
        self.blocks = -(-len(order) // BLOCK)
        features = len(weight)
        example = place[row]
        self.most = np.zeros((features, max(self.blocks, 1)))
        np.maximum.at(self.most, (f, example // BLOCK), value)
        held = np.bincount(f, minlength=features)
        self.heavy = np.full(features, -1, np.int64)
        often = np.flatnonzero(held > max(32, len(order) // 10))
        self.heavy[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.blocks * BLOCK))
        many = self.heavy[f] >= 0
        self.matrix[self.heavy[f[many]], example[many]] = value[many]
        key = (example // BLOCK * features + f)[~many]
        by = np.argsort(key, kind="stable")
        self.features, self.example, self.value = features, (example[~many] % BLOCK)[by], value[~many][by]
        self.at = np.searchsorted(key[by], np.arange(features * max(self.blocks, 1) + 1))

    def nearest(self, starts: np.ndarray, f: np.ndarray, tf: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: none) and cosines of the ``k`` nearest examples with a cosine above zero, for each row."""
        rows = len(starts) - 1
        best, number = np.zeros((rows, k)), np.full((rows, k), -1, np.int64)
        if not self.blocks or not len(f):
            return number, best
        q = unit(f, tf, starts, self.weight)
        n = np.diff(starts)
        row = np.repeat(np.arange(rows), n)
        bound = np.zeros((rows, self.blocks))
        some = np.flatnonzero(n)
        bound[some] = np.add.reduceat(q[:, None] * self.most[f], starts[:-1][some], axis=0)
        heavy = np.zeros((rows, len(self.matrix)))
        many = self.heavy[f] >= 0
        heavy[row[many], self.heavy[f[many]]] = q[many]
        rare_f, rare_q = f[~many], q[~many]
        rare_n = np.bincount(row[~many], minlength=rows)
        rare_at = np.cumsum(rare_n) - rare_n
        first = np.zeros((rows, self.blocks), bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        for mask in (first, ~first):
            for b in range(self.blocks):
                # Sums in another order may differ in the last digits.
                mine = np.flatnonzero(mask[:, b] & (bound[:, b] > 0) & (bound[:, b] >= best[:, -1] - 1e-12))
                if not len(mine):
                    continue
                got = heavy[mine] @ self.matrix[:, b * BLOCK : (b + 1) * BLOCK]
                asks = ranges(rare_at[mine], rare_n[mine])
                cell = b * self.features + rare_f[asks]
                held = self.at[cell + 1] - self.at[cell]
                post = ranges(self.at[cell], held)
                local = np.repeat(np.repeat(np.arange(len(mine)), rare_n[mine]), held)
                got += np.bincount(local * BLOCK + self.example[post], np.repeat(rare_q[asks], held) * self.value[post], got.size).reshape(got.shape)
                better = np.flatnonzero(got.max(axis=1) >= np.maximum(best[mine, -1], 1e-300))
                if not len(better):
                    continue
                mine, got = mine[better], got[better]
                numbers = np.broadcast_to(np.arange(b * BLOCK, (b + 1) * BLOCK), got.shape)
                cosines = np.concatenate([best[mine], got], axis=1)
                numbers = np.concatenate([number[mine], np.where(got > 0, numbers, -1)], axis=1)
                rank = np.where(numbers < 0, np.iinfo(np.int64).max, numbers)
                order = np.lexsort((rank, -np.where(numbers < 0, 0, cosines)), axis=1)[:, :k]
                best[mine] = np.take_along_axis(np.where(numbers < 0, 0, cosines), order, axis=1)
                number[mine] = np.take_along_axis(numbers, order, axis=1)
        return number, best

    def score(self, starts: np.ndarray, f: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all rows, and the numbers and cosines of the examples they rest on."""
        number, cosine = self.nearest(starts, f, tf)
        if not len(self.toxic):
            return np.full(len(number), self.bare), number, cosine
        # Weights of one mean, so that the smoothing stays in cosines.
        vote = cosine * (self.stands_for / self.stands_for.mean())[number]
        score = ((vote * self.toxic[number]).sum(axis=1) + SMOOTHING * self.share) / (vote.sum(axis=1) + SMOOTHING)
        return np.where(np.diff(starts) > 0, np.clip(score, 0, 1), self.bare), number, cosine


def fit(docs: DataFrame, labels: DataFrame, rows_of) -> tuple[tuple, DataFrame]:
    """The arrays of the index and the vectors of all documents, from ``doc_id, toxic`` labels to learn from.

    ``rows_of(docs)`` gives the columns of documents that the vectors keep.
    """
    labels = written(labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")), "labels")
    totals = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for label in (0, 1):
        # A bounded sample of each label, by hash.
        some = labels.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
        picked = some if picked is None else picked.union(some)
    # At most 2 * EXAMPLES rows of two numbers.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    # Ids with several texts do not make more examples than that.
    examples = found.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "h").limit(2 * EXAMPLES).toArrow().combine_chunks()
    row, code, words = words_of(examples["text"].combine_chunks() if examples.num_rows else pa.array([], pa.string()))
    key, tf = np.unique(row * max(len(words), 1) + code, return_counts=True)
    row, f = key // max(len(words), 1), key % max(len(words), 1)
    toxic = examples["toxic"].to_numpy().astype(float)
    counts = {0: float((toxic == 0).sum()), 1: float((toxic == 1).sum())}
    stands_for = np.array([totals[int(x)] / counts[int(x)] for x in toxic], float)
    every = written(vectors(rows_of(docs), words), "feature-vectors")
    df = document_frequencies(every, len(words))
    idf = np.log((1 + every.count()) / (1 + df)) + 1
    weight = idf * (1 + np.sqrt(label_ratio(row, f, toxic, len(words))))
    starts = np.searchsorted(row, np.arange(len(toxic) + 1))
    return (starts, f, tf, toxic, stands_for, examples["doc_id"].to_numpy(), weight), every


def scored(every: DataFrame, arrays: tuple) -> DataFrame:
    """``every`` with ``score``, and the nearest examples as evidence."""
    spark = every.sparkSession
    sent = spark.sparkContext.broadcast(arrays)
    kept = [c for c in every.columns if c not in ("f", "tf", "score", "evidence", "cosines")]
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in every.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = BlockMax(*sent.value)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(a, BATCH_ROWS)
                ends = batch.column(len(kept)).offsets.to_numpy()
                f, tf = (batch.column(len(kept) + i).values.to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                # Equal vectors once.
                place: dict[bytes, int] = {}
                own = [place.setdefault(f[x:y].tobytes() + tf[x:y].tobytes(), len(place)) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                first = np.unique(own, return_index=True)[1]
                n = np.diff(ends)[first].astype(np.int64)
                at = ranges(ends[:-1][first].astype(np.int64), n)
                score, number, cosine = model.score(np.concatenate([[0], np.cumsum(n)]), f[at], tf[at])
                score, number, cosine = score[own], number[own, :3], cosine[own, :3]
                shown = number >= 0
                offsets = pa.array(np.concatenate([[0], np.cumsum(shown.sum(axis=1))]).astype(np.int32))
                ids = model.ids[number[shown]] if len(model.ids) else np.zeros(0, np.int64)
                evidence = pa.ListArray.from_arrays(offsets, pa.array(ids))
                cosines = pa.ListArray.from_arrays(offsets, pa.array(cosine[shown]))
                yield pa.record_batch([*batch.columns[: len(kept)], pa.array(score), evidence, cosines], names=[*kept, "score", "evidence", "cosines"])

    # Vectors are small, so files hold many; scoring is not.
    rows = every.select(*kept, "f", "tf").repartition(parts(spark))
    return in_arrow(rows, run, f"{fields}, score double, evidence array<bigint>, cosines array<double>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    arrays, every = fit(docs, labels, lambda d: d.select("doc_id", "text"))
    out = scored(every, arrays)
    predicted = (F.col("score") >= PREDICT_FROM).cast("int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "evidence", "cosines")
