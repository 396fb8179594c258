"""Phrase collocations: counts of frequent phrases by double-array tries, and their tightest cuts.

Texts are tokenised once, slice by slice, into numbers of the slice's own dictionary, whose counts
add up to word counts. Words of fewer than ``LEAST`` occurrences in their language can be in no
candidate (Apriori), so slices are rewritten as numbers of the others, with a break at every other
word and at the end of every piece. Then, word by word, frequent phrases grow: a double-array trie
of the frequent phrases so far is broadcast, numpy takes the states of all text positions through
it level by level, and the phrases that could still be frequent, those that extend an accepted one
by a word and (where one trie holds all) end in an accepted one, are counted over all tasks. In
the end the trie of all candidates is sent once more and its accepting states are counted; the sums
over all tasks are the counts that results use.

A trie is cut in two, by a hash of a phrase's first two words, as often as needed to keep it below
``TRIE_NODES``; every part is then counted in a pass of its own, so what is broadcast is bounded at
any number of candidates.

Nulls and ties: a null text is empty, a null language ``und``; a language of that name is the same.
Ids are not read; repeated rows count each. Long texts are worked on in overlapping blocks. Phrases
of one score and one count are ordered by their bytes. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailrank.llm.common import in_arrow, parts, slices, strings, table, utf8, written
from mailrank.sources.emails import with_row_id

LEAST = 100  # occurrences of a candidate
MOST_WORDS = 5
TOP = 2_000
SCALE = 1_000
ABSORBED = (100, 100)  # a longer candidate with this share of the occurrences takes a shorter one's place
SLICE = 4 * 1024 * 1024  # bytes of text tokenised at once; longer texts are cut into overlapping blocks
SENT_WORDS = 1_000_000  # a vocabulary up to this size is broadcast, a larger one is shuffled
TRIE_NODES = 4_000_000
STATE_RUN = 4_096  # states whose counts are one row of a task
LOOK_BACK = 8_192  # slots before the last place that are looked at again
RUNS_AT_ONCE = 64  # such rows handed on together
LOW_BITS = 10  # of a word's number are the second step of its edge; what stands above them is the first
AT_ONCE = 500_000  # text positions that go through a trie at once

# What ends a piece, and what ends a word besides.
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
GAPS = b"\x20\x09"

_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)] = 1
_KIND[list(STOPS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = re.compile(rb"[^" + re.escape(STOPS + GAPS) + rb"]+")


def blocks(column: pa.Array, langs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, int]]:
    """Bytes, offsets, languages, and the byte from which on words only end phrases that started before it."""
    for batch in slices(pa.record_batch([column, langs], names=["text", "lang"]), 0, SLICE):
        data, off = utf8(batch.column(0))
        if len(data) <= SLICE:
            yield data, off, batch.column(1), len(data)
            continue
        # One long text.
        held, start = data.tobytes(), 0
        while start < len(data):
            stop = min(start + SLICE, len(data))
            if stop < len(data):
                cuts = np.flatnonzero(_KIND[data[start:stop]])
                if len(cuts):
                    stop = start + int(cuts[-1]) + 1
                else:
                    found = _WORD.match(held, stop)
                    stop = found.end() if found else stop
            end, more = stop, 0
            for found in _WORD.finditer(held, stop):
                end, more = found.end(), more + 1
                if more == MOST_WORDS - 1:
                    break
            yield data[start:end], np.array([0, end - start], np.int64), batch.column(1), stop - start
            start = stop


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words (lower-cased) of all texts, where each starts, and whether it starts a piece."""
    kind = _KIND[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    stops = np.flatnonzero(kind == 2)
    piece = np.searchsorted(stops, starts) + np.searchsorted(off, starts, side="right")
    new = np.ones(len(starts), bool)
    new[1:] = piece[1:] != piece[:-1]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    return strings(_LOWER[data[inside]], cuts, pa.binary()), starts, new


def tokenised(docs: DataFrame) -> DataFrame:
    """Slices of ``docs`` (``text, lang``): ``row, own, codes, words`` (``lang, word, n`` in the order of codes).

    A code of -1 is a break; phrases start at the first ``own`` codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        kind = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            for data, off, langs, stop in blocks(batch.column(0), batch.column(1)):
                found, starts, new = tokens(data, off)
                if not len(starts):
                    continue
                found = found.dictionary_encode()
                langs = langs.dictionary_encode()
                lang = langs.indices.to_numpy(zero_copy_only=False)[np.searchsorted(off, starts, side="right") - 1]
                key, codes = np.unique(found.indices.to_numpy() * np.int64(len(langs.dictionary)) + lang, return_inverse=True)
                mine = int(np.searchsorted(starts, stop))
                n = np.bincount(codes[:mine], minlength=len(key))
                # A break stands before every piece but the first.
                at = np.arange(len(codes)) + np.cumsum(new) - 1
                out = np.full(int(at[-1]) + 1, -1, np.int32)
                out[at] = codes
                own = int(at[mine]) if mine < len(at) else len(out)
                words = pa.StructArray.from_arrays(
                    [langs.dictionary.take(pa.array(key % len(langs.dictionary))),
                     found.dictionary.take(pa.array(key // len(langs.dictionary))).cast(pa.string()), pa.array(n)],
                    fields=list(kind),
                )
                yield pa.record_batch(
                    [pa.array([(part << 32) + row]), pa.array([own], pa.int32()), pa.array([out], pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), words)],
                    names=["row", "own", "codes", "words"],
                )
                row += 1

    rows = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return in_arrow(rows, run, "row bigint, own int, codes array<int>, words array<struct<lang: string, word: string, n: bigint>>")


def numbered(sliced: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``own, ids`` of every slice with words of ``vocabulary`` (``id, lang, word``); -1 for all else.

    A vocabulary of at most ``SENT_WORDS`` is sent to the tasks; a larger one is joined to the
    dictionaries of the slices.
    """
    known = vocabulary.select("lang", "word", F.col("id").cast("int").alias("id"))
    held = known.limit(SENT_WORDS + 1).toArrow()
    if held.num_rows > SENT_WORDS:
        each = sliced.select("row", F.posexplode("words").alias("code", "w")).select("row", "code", "w.lang", "w.word")
        ids = each.join(known, ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("code", "id")).alias("ids"))
        rows = sliced.select("row", "own", "codes").join(ids, "row").select("own", "codes", F.col("ids.code").alias("code"), F.col("ids.id").alias("id"))

        def ids_of(batch: pa.RecordBatch, i: int, codes: np.ndarray) -> np.ndarray:
            code, number = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (2, 3))
            found = np.full(int(codes.max()) + 2, -1, np.int32)
            found[code] = number
            return found
    else:
        rows = sliced.select("own", "codes", F.col("words.lang").alias("lang"), F.col("words.word").alias("word"))
        by_lang = {}
        for lang in pc.unique(held["lang"]).to_pylist():
            mine = held.filter(pc.equal(held["lang"], lang))
            by_lang[lang] = (mine["word"].combine_chunks(), mine["id"].to_numpy())
        sent = sliced.sparkSession.sparkContext.broadcast(by_lang)

        def ids_of(batch: pa.RecordBatch, i: int, codes: np.ndarray) -> np.ndarray:
            langs, words = (batch.column(c)[i].values for c in (2, 3))
            found = np.full(len(words) + 1, -1, np.int32)
            for lang in pc.unique(langs).to_pylist():
                if lang in sent.value:
                    known_words, numbers = sent.value[lang]
                    at = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
                    place = pc.fill_null(pc.index_in(words.take(pa.array(at)), known_words), -1).to_numpy()
                    found[at[place >= 0]] = numbers[place[place >= 0]]
            return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = batch.column(1)[i].values.to_numpy(zero_copy_only=False)
                ids = ids_of(batch, i, codes)[codes]
                # Runs of breaks are one break.
                keep = np.append(True, (ids[1:] >= 0) | (ids[:-1] >= 0))
                own = int(np.count_nonzero(keep[: batch.column(0)[i].as_py()]))
                yield pa.record_batch([pa.array([own], pa.int32()), pa.array([ids[keep]], pa.list_(pa.int32()))], names=["own", "ids"])

    return in_arrow(rows, run, "own int, ids array<int>")


class DoubleArray:
    """A trie over word numbers in two arrays: from state ``s`` symbol ``x`` leads to ``base[s] + x`` if
    that slot's ``check`` is ``s``. A word is two symbols, its number's high bits and its ``LOW_BITS``
    low ones: what follows a state then spans few slots, however many words there are, so slots stay
    about as many as edges. The states of single words are their numbers."""

    def __init__(self, n_words: int):
        self.n_words = n_words
        self.base = np.full(n_words, -1, np.int64)
        self.check = np.full(n_words, -1, np.int64)
        self.depth = np.ones(n_words, np.int8)
        self.free = np.zeros(n_words, bool)
        self.nodes = 0

    def _grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            more = max(more, len(self.base) // 4)
            self.base = np.append(self.base, np.full(more, -1, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))
            self.depth = np.append(self.depth, np.zeros(more, np.int8))
            self.free = np.append(self.free, np.ones(more, bool))

    def _room(self, words: np.ndarray, start: int) -> int:
        """The first slot from ``start`` on for the first of ``words`` that has room for all, tried in runs of free slots."""
        spread = words - words[0]
        while True:
            open_slots = start + np.flatnonzero(self.free[start : start + 4096])
            if start + 4096 + int(spread[-1]) >= len(self.free):
                self._grow(start + 8192 + int(spread[-1]))
                continue
            # Most slots fail one of the first few words.
            for more in spread[1:17]:
                open_slots = open_slots[self.free[open_slots + more]]
            for k in range(0, len(open_slots), 256):
                some = open_slots[k : k + 256]
                good = np.flatnonzero(self.free[some[:, None] + spread].all(axis=1))
                if len(good):
                    return int(some[good[0]])
            start += 4096

    def add(self, states: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
        """Edges from states that have none yet; gives the new states."""
        high, at = np.unique((states.astype(np.int64) << 32) | (words >> LOW_BITS), return_inverse=True)
        between = self._pack(high >> 32, high & 0xFFFFFFFF, depth)
        self.nodes += len(words)
        return self._pack(between[at], words & ((1 << LOW_BITS) - 1), depth)

    def _pack(self, states: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
        """Slots for one step of edges; ``words`` are its symbols."""
        order = np.lexsort((words, states))
        states, words = states[order], words[order]
        heads = np.flatnonzero(np.append(True, states[1:] != states[:-1])) if len(states) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(states)))
        out = np.zeros(len(states), np.int64)
        start = self.n_words
        for g in np.argsort(-counts, kind="stable")[: int((counts > 1).sum())]:
            a, n = heads[g], counts[g]
            # Where most slots are taken, later searches need not look again; nor far before the last
            # place, as what is left there goes to states of one word.
            while start + 4096 < len(self.free) and self.free[start : start + 4096].sum() < 64:
                start += 4096
            slot = self._room(words[a : a + n], start)
            start = max(start, slot - LOOK_BACK)
            at = slot + words[a : a + n] - words[a]
            self.free[at] = False
            out[a : a + n] = at
        lone = heads[counts == 1]
        if len(lone):
            self._grow(len(self.free) + max(0, len(lone) - int(self.free.sum())))
            out[lone] = np.flatnonzero(self.free)[: len(lone)]
            self.free[out[lone]] = False
        self.base[states] = out - words
        self.check[out] = states
        self.depth[out] = depth
        back = np.empty_like(out)
        back[order] = out
        return back

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        taken = np.flatnonzero(~self.free)
        end = int(taken[-1]) + 1 if len(taken) else 0
        return self.base[:end].astype(np.int32), self.check[:end].astype(np.int32)


def advance(base: np.ndarray, check: np.ndarray, states: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the states go with the words, and which of them go anywhere."""
    good = words >= 0
    for symbols in (words >> LOW_BITS, words & ((1 << LOW_BITS) - 1)):
        to = base[states].astype(np.int64) + symbols
        good = good & (to >= 0) & (to < len(check))
        to = np.where(good, to, 0)
        good &= check[to] == states
        states = to
    return to, good


def through(sent, batch: pa.RecordBatch, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All positions of a batch of ``own, ids`` through a trie: for every level up to ``depth`` the level, the positions
    whose state it accepts, their states, the numbers of the text, and which positions may start phrases."""
    base, check = sent.value
    lists, owned = batch.column(1), batch.column(0).to_pylist()
    starts, runs, size = [], [], 0
    for i in range(batch.num_rows + 1):
        if runs and (i == batch.num_rows or size + len(lists[i]) > AT_ONCE):
            ids = np.concatenate([*runs, np.full(MOST_WORDS, -1, np.int32)])
            own = np.zeros(len(ids), bool)
            for a, n in starts:
                own[a : a + n] = True
            at = np.flatnonzero(ids >= 0)
            states = ids[at].astype(np.int64)
            yield 1, at, states, ids, own
            for level in range(2, depth + 1):
                to, good = advance(base, check, states, ids[at + level - 1])
                at, states = at[good], to[good]
                yield level, at, states, ids, own
            starts, runs, size = [], [], 0
        if i < batch.num_rows:
            starts.append((size, owned[i]))
            runs += [lists[i].values.to_numpy(zero_copy_only=False), np.full(1, -1, np.int32)]
            size += len(lists[i]) + 1


def extended(coded: DataFrame, trie: DoubleArray, depth: int, whole: bool) -> DataFrame:
    """``edge, n``: phrases of ``depth + 1`` words that extend an accepted one, by state and word, and their occurrences."""
    sent = coded.sparkSession.sparkContext.broadcast(trie.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, at, states, ids, own in through(sent, batch, depth):
                if level < depth:
                    continue
                accepted = np.zeros(len(ids) + 1, bool)
                accepted[at] = True
                word = ids[at + depth]
                good = own[at] & (word >= 0)
                if whole:
                    good &= accepted[at + 1]
                edge, n = np.unique((states[good] << 32) | word[good], return_counts=True)
                yield pa.record_batch([pa.array(edge), pa.array(n)], names=["edge", "n"])

    found = in_arrow(coded, run, "edge bigint, n bigint")
    return found.groupBy("edge").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def accepted(coded: DataFrame, trie: DoubleArray, depth: int) -> DataFrame:
    """``state, n``: occurrences of every phrase of two or more words of the trie. Tasks hand on sums of runs of states."""
    sent = coded.sparkSession.sparkContext.broadcast(trie.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for level, at, states, ids, own in through(sent, batch, depth):
                if total is None:
                    total = np.zeros(-(-len(sent.value[0]) // STATE_RUN) * STATE_RUN, np.int64)
                if level > 1:
                    found, n = np.unique(states[own[at]], return_counts=True)
                    total[found] += n
        if total is not None:
            total = total.reshape(-1, STATE_RUN)
            held = np.flatnonzero(total.any(axis=1))
            for a in range(0, len(held), RUNS_AT_ONCE):
                some = held[a : a + RUNS_AT_ONCE]
                ends = np.arange(0, len(some) * STATE_RUN + 1, STATE_RUN, dtype=np.int32)
                sums = pa.ListArray.from_arrays(pa.array(ends), pa.array(total[some].ravel()))
                yield pa.record_batch([pa.array(some), sums], names=["run", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.record_batch([pa.array(now * STATE_RUN + at), pa.array(total[at])], names=["state", "n"])

        for batch in batches:
            for run_, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums = sums.values.to_numpy(zero_copy_only=False)
                if run_ == now:
                    total = total + sums
                    continue
                if now is not None:
                    yield done()
                now, total = run_, sums
        if now is not None:
            yield done()

    runs = in_arrow(coded, run, "run bigint, sums array<bigint>")
    runs = runs.repartition(parts(coded.sparkSession), "run").sortWithinPartitions("run")
    return in_arrow(runs, add_up, "state bigint, n bigint")


def _edges(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    edge = df.select("edge").toArrow()["edge"].to_numpy()
    return edge >> 32, edge & 0xFFFFFFFF


def _grown(coded: DataFrame, pairs: DataFrame, n_words: int, whole: bool) -> tuple[DoubleArray, list] | None:
    """The trie that grows from frequent ``pairs``, with its edges by level; None if it is to be cut in two."""
    trie, levels, found, most = DoubleArray(n_words), [], pairs, None
    for depth in range(2, MOST_WORDS + 1):
        more = found.count()
        most = more if most is None else most
        if trie.nodes + more > TRIE_NODES and most > 1:
            return None
        if not more:
            break
        states, symbols = _edges(found)
        levels.append((trie.add(states, symbols, depth), states, symbols))
        if depth < MOST_WORDS:
            found = written(extended(coded, trie, depth, whole), "frequent-phrases")
    return trie, levels


def phrases(coded: DataFrame, n_words: int) -> DataFrame:
    """``ids, n``: every phrase of 2 to ``MOST_WORDS`` words of at least ``LEAST`` occurrences in ``own, ids`` (a written table)."""
    spark = coded.sparkSession
    pairs = written(extended(coded, DoubleArray(n_words), 1, True), "frequent-pairs")
    todo, out = [(1, 0)], spark.createDataFrame([], "ids array<int>, n bigint")
    while todo:
        modulus, remainder = todo.pop()
        mine = pairs.where(F.pmod(F.xxhash64("edge"), F.lit(modulus)) == remainder)
        grown = _grown(coded, mine, n_words, modulus == 1)
        if grown is None:
            todo += [(2 * modulus, remainder), (2 * modulus, remainder + modulus)]
            continue
        trie, levels = grown
        if levels:
            counts = accepted(coded, trie, len(levels) + 1)
            out = out.unionByName(written(_spelt(spark, levels).join(counts, "state").select("ids", "n"), "phrases"))
    return out


def _spelt(spark: SparkSession, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """``state, ids``: the words of the phrases of one trie."""
    chunks, path = [], {}
    for new, states, symbols in levels:
        if not path:
            words = [states, symbols]
        else:
            # States of the level before, by slot.
            order = np.argsort(path["slots"], kind="stable")
            at = order[np.searchsorted(path["slots"], states, sorter=order)]
            words = [*(w[at] for w in path["words"]), symbols]
        path = {"slots": new, "words": words}
        flat = np.stack(words, axis=1).astype(np.int32)
        ends = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
        chunks.append(pa.table({"state": new, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))}))
    return spark.createDataFrame(pa.concat_tables(chunks), "state bigint, ids array<int>")


def _parts_of(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(found: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of candidates (``lang, words, a``) that no longer one absorbs.

    ``counts`` (``lang, part, f``) holds words and candidates, ``totals`` (``lang, n``) all words.
    """
    size = F.size("words")
    named = found.withColumn("phrase", F.array_join("words", " "))
    cuts = named.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _parts_of(F.col("words"), F.lit(1), F.col("k")).alias("left"),
                       _parts_of(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.join(totals, "lang")
    # Whole numbers of 38 digits.
    score = cuts.withColumns({f"{c}_": x for c, x in wide.items()})
    score = score.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(38,0)) * a_ * n_ DIV (l_ * r_)"))
    best = score.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    best = best.select("lang", "phrase", *[F.col(f"m.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])

    longer = named.where(size > 2)
    shorter = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: _parts_of(F.col("words"), s, n))))
    inside = longer.select("lang", "a", F.explode(shorter).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    share, whole = ABSORBED
    kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") * whole < F.col("a") * share))
    return kept.drop("most")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    sliced = written(tokenised(docs), "token-slices")
    each = sliced.select(F.explode("words").alias("w")).select("w.*")
    counts = written(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    totals = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = counts.where(F.col("f") >= LEAST)
    vocabulary = written(with_row_id(frequent, ["lang", "word"], "id", 0), "vocabulary")
    n_words = vocabulary.count()
    if not n_words:
        found = docs.sparkSession.createDataFrame([], "ids array<int>, n bigint")
    else:
        coded = written(numbered(sliced, vocabulary), "coded-slices")
        found = phrases(coded, n_words)
    at = found.withColumn("phrase_id", F.monotonically_increasing_id())
    at = written(at, "candidates")
    spelt = at.select("phrase_id", "n", F.posexplode("ids").alias("p", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("phrase_id").agg(
        F.first("lang").alias("lang"), F.first("n").alias("a"), F.sort_array(F.collect_list(F.struct("p", "word"))).alias("words")
    )
    spelt = written(spelt.select("lang", F.col("words.word").alias("words"), "a"), "phrase-words")
    parts_of = frequent.select("lang", F.col("word").alias("part"), "f").unionByName(
        spelt.select("lang", F.array_join("words", " ").alias("part"), F.col("a").alias("f"))
    )
    best = scored(spelt, parts_of, totals)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = """
WITH pieces AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])) AS g FROM lists, range(1, 6) t(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM lists GROUP BY lang),
cuts AS (SELECT lang, phrase, f AS a, c, array_to_string(g[:c], ' ') AS lw, array_to_string(g[c + 1:], ' ') AS rw FROM f, range(1, 5) t(c) WHERE c < k),
scored AS (SELECT cuts.lang, cuts.phrase, a, c, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
           FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lw JOIN f r ON r.lang = cuts.lang AND r.phrase = rw JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(g[s:s + m - 1], ' ') AS phrase, max(f) AS most
           FROM f, range(2, 5) t(m), range(1, 5) u(s) WHERE m < k AND s + m - 1 <= k GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE most IS NULL OR 100 * most < 100 * a) WHERE rank <= 2000
"""
