"""Word segmentation by a lexicon of syllables: words are runs of syllables, joined by ``_``.

A text is cut into syllables (runs of letters and digits) and marks; only neighbouring syllables of a run, with white
space between them, may make one word. Each word of the lexicon has a probability; the segmentation of a run is the most probable
one (Viterbi). Probabilities come from the corpus by expectation-maximisation: each round counts every word
as often as it is expected over all segmentations of every run, weighted by their probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import Written

#: A word has so many syllables at most; longer words must occur LEAST times to come into the lexicon, which has MOST entries at most
#: (besides single syllables, which always count and need no entry).
SYLLABLES, LEAST, MOST = 4, 3, 200_000
ROUNDS = 4
#: A syllable that is not in the lexicon counts as seen so often; words of several syllables must have been learned.
UNSEEN = 0.5
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: Runs end at marks, and at tokens that have no white space before them.
RUN = r"[^\W_]+(?:\s+[^\W_]+)*"
_RUN, _PART = re.compile(RUN), re.compile(rf"{RUN}|[^\w\s]|_")
#: Texts and runs are worked on in pieces of a batch that have so many characters, or a text or run each.
AT_ONCE = 1 << 20


def tokens(text: str | None) -> list[tuple[str, bool]]:
    """(token, whether it is a syllable that may join the one before it)."""
    out: list[tuple[str, bool]] = []
    end, before = 0, False
    for m in _TOKEN.finditer(text or ""):
        syllable = m[0][0].isalnum()
        out.append((m[0], syllable and before and m.start() > end))
        end, before = m.end(), syllable
    return out


def runs(text: str | None) -> list[list[str]]:
    """The syllables that may be joined, run by run; marks are runs of their own."""
    out: list[list[str]] = []
    for token, joins in tokens(text):
        if joins:
            out[-1].append(token)
        else:
            out.append([token])
    return out


class Lexicon:
    """Log probabilities of words (lower-case syllables joined by ``_``)."""

    def __init__(self, counts: dict[str, float]):
        total = sum(counts.values()) + UNSEEN
        self.log = {w: math.log(n / total) for w, n in counts.items() if n > 0}
        self.unseen = math.log(UNSEEN / total)

    def of(self, syllables: list[str]) -> float | None:
        """Of a word, or None where it is none: several syllables must have been learned, one always may stand alone."""
        found = self.log.get("_".join(syllables))
        return self.unseen if found is None and len(syllables) == 1 else found

    def segmented(self, run: list[str]) -> list[str]:
        """The most probable words of a run, as they are written; of equal ones that with the longer last word."""
        lower = [x.lower() for x in run]
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            options = []
            for size in range(1, min(SYLLABLES, end) + 1):
                p = self.of(lower[end - size : end])
                if p is not None:
                    options.append((best[end - size][0] + p, size))
            best.append(max(options))
        words, at = [], len(run)
        while at:
            words.append("_".join(run[at - best[at][1] : at]))
            at -= best[at][1]
        return words[::-1]

    def expected(self, run: list[str], into: dict[str, float], times: int = 1) -> None:
        """Adds how often each word is expected in ``times`` such runs, over all segmentations (forward and backward sums)."""
        n = len(run)
        forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        spans = [(a, b, p) for a in range(n) for b in range(a + 1, min(n, a + SYLLABLES) + 1) if (p := self.of(run[a:b])) is not None]
        for a, b, p in spans:  # by rising start
            forward[b] = _add(forward[b], forward[a] + p)
        for a, b, p in reversed(spans):
            backward[a] = _add(backward[a], p + backward[b])
        for a, b, p in spans:
            word = "_".join(run[a:b])
            into[word] = into.get(word, 0.0) + times * math.exp(forward[a] + p + backward[b] - forward[n])


def _add(a: float, b: float) -> float:
    """log(exp a + exp b)."""
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


class Table:
    """A lexicon as arrays, for many runs at once. Words of k syllables are nodes of a trie: a node is found by its first k - 1 syllables' node and its last syllable."""

    def __init__(self, lexicon: Lexicon):
        self.words = list(lexicon.log)
        self.unseen = lexicon.unseen
        split = [w.split("_") for w in self.words]
        self.syllables: dict[str, int] = {}
        for s in split:
            for x in s:
                self.syllables.setdefault(x, len(self.syllables))
        self.base = max(1, len(self.syllables))
        places: list[dict[int, int]] = [{} for _ in range(SYLLABLES)]  # of each level: key to node
        words: list[list[int]] = [[] for _ in range(SYLLABLES)]
        for at, s in enumerate(split):
            node = 0
            for k, x in enumerate(s[:SYLLABLES]):
                node = places[k].setdefault(node * self.base + self.syllables[x], len(places[k]))
                if node == len(words[k]):
                    words[k].append(-1)
            if len(s) <= SYLLABLES:
                words[len(s) - 1][node] = at
        log = np.array([*lexicon.log.values(), -np.inf])
        self.keys, self.word, self.log = [], [], []
        for k in range(SYLLABLES):
            keys = np.fromiter(places[k].keys(), np.int64, len(places[k]))
            nodes = np.fromiter(places[k].values(), np.int64, len(places[k]))
            order = np.argsort(keys)
            self.keys.append((keys[order], nodes[order]))
            self.word.append(np.array([*words[k], -1], np.int64))  # the last is for what is no node
            self.log.append(log[self.word[k]])

    def _node(self, k: int, before: np.ndarray, syllable: np.ndarray) -> np.ndarray:
        """Of level k (from 0), -1 where there is none."""
        out = np.full(len(syllable), -1, np.int64)
        keys, nodes = self.keys[k]
        may = np.flatnonzero((before >= 0) & (syllable >= 0))
        if len(keys) and len(may):
            wanted = before[may] * self.base + syllable[may]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            out[may] = np.where(keys[at] == wanted, nodes[at], -1)
        return out

    def words_of(self, names: pa.Array, local: np.ndarray, left: np.ndarray, size: int) -> np.ndarray:
        """Of each place in runs (``local``: the place of its syllable in ``names``, ``left``: syllables from it to the run's end) the word of ``size`` syllables that begins there, or -1."""
        syllable = self._known(names)[local]
        node = np.zeros(len(local), np.int64)
        for k in range(size):
            last = np.full(len(local), -1, np.int64)
            last[: max(0, len(local) - k)] = syllable[k:]
            node = self._node(k, np.where(left > k, node, -1), last)
        return self.word[size - 1][node]

    def _known(self, names: pa.Array) -> np.ndarray:
        return np.array([self.syllables.get(x, -1) for x in names.to_pylist()], np.int64)

    def laid(self, syllables: pa.Array, lengths: np.ndarray) -> Laid:
        """Runs (all their lower-case syllables one after the other, and how many each has; none is empty) as they are worked on."""
        coded = syllables.dictionary_encode()
        local = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return Laid(self, local, coded.dictionary, self._known(coded.dictionary)[local], lengths)


class Laid:
    """Stretches of runs side by side, the longest first: what belongs to their t-th syllables lies together, so that one step serves all stretches that are so long.

    A run falls into stretches where no word of the lexicon lies across two syllables. All its segmentations part there, so each stretch is segmented by itself.
    """

    def __init__(self, table: Table, local: np.ndarray, names: pa.Array, syllable: np.ndarray, lengths: np.ndarray):
        n = len(local)
        self.table, self.names, self.runs = table, names, lengths
        words, logs, node, within = [], [], np.zeros(n, np.int64), np.zeros(n, bool)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
        for k in range(SYLLABLES):
            last = np.full(n, -1, np.int64)
            last[: max(0, n - k)] = syllable[k:]
            node = table._node(k, np.where(left > k, node, -1), last)
            log = table.log[k][node]
            if k == 0:
                log = np.where(node < 0, table.unseen, np.where(table.word[0][node] < 0, table.unseen, log))
            words.append(table.word[k][node] if k else local)
            logs.append(log)
            begins = np.flatnonzero(words[k] >= 0) if k else np.zeros(0, np.int64)
            for j in range(1, k + 1):
                within[begins + j] = True
        #: Of each stretch its first syllable, as they came.
        self.starts = np.flatnonzero(~within)
        self.lengths = lengths = np.diff(self.starts, append=n)
        self.order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.most = int(lengths.max(initial=0))
        self.active = np.searchsorted(-lengths[self.order], -np.arange(self.most + 1), side="left")  # stretches longer than t
        self.first = np.concatenate([[0], np.cumsum(self.active)])
        self.at = self.first[place] + np.repeat(rank, lengths)  # of each syllable as it came
        self.words, self.logs = [self._laid(x) for x in words], [self._laid(x) for x in logs]

    def _laid(self, of_each: np.ndarray) -> np.ndarray:
        out = np.empty_like(of_each)
        out[self.at] = of_each
        return out

    def _log(self, t: int, k: int, n: int) -> np.ndarray:
        """Of the words of k + 1 syllables that begin at t, of the first n stretches."""
        return self.logs[k][self.first[t] : self.first[t] + n]

    def joined(self) -> np.ndarray:
        """Whether each syllable, as it came, belongs to the word of the one before it in the most probable words of its run."""
        best, sizes = [np.zeros(len(self.lengths))], []
        for end in range(1, self.most + 1):
            n = self.active[end - 1]
            top, size = np.full(n, -np.inf), np.ones(n, np.int64)
            for k in range(min(SYLLABLES, end)):
                p = best[end - k - 1][:n] + self._log(end - k - 1, k, n)
                wins = p >= top  # of equal ones the longer last word
                top, size = np.where(wins, p, top), np.where(wins & (p > -np.inf), k + 1, size)
            best.append(top)
            sizes.append(size)
        joins = np.zeros(self.first[-1], bool)
        rest = np.zeros(len(self.lengths), np.int64)  # syllables before this one that its word still has
        for t in range(self.most - 1, -1, -1):
            n = self.active[t]
            here = rest[:n]
            ends = here == 0
            here[ends] = sizes[t][ends]
            here -= 1
            joins[self.first[t] : self.first[t] + n] = here > 0
        return joins[self.at]

    def expected(self, times: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(words, how often each is expected): ``Lexicon.expected`` of all runs, each of which comes so many ``times``."""
        times, most, active = np.repeat(times, self.runs)[self.starts][self.order].astype(np.float64), self.most, self.active
        forward, total = [np.zeros(len(self.lengths))], np.zeros(len(self.lengths))
        for end in range(1, most + 1):
            n = active[end - 1]
            forward.append(_log_sum([forward[end - k - 1][:n] + self._log(end - k - 1, k, n) for k in range(min(SYLLABLES, end))]))
            total[:n] = forward[-1]  # a longer stretch's is written over
        backward: list[np.ndarray] = [np.zeros(0)] * (most + 1)
        found = [np.zeros(len(x)) for x in self.logs]
        for t in range(most, -1, -1):
            backward[t] = np.zeros(active[t - 1] if t else len(self.lengths))
            ways = []
            for k in range(min(SYLLABLES, most - t)):
                n = active[t + k]
                p = self._log(t, k, n) + backward[t + k + 1]
                found[k][self.first[t] : self.first[t] + n] = times[:n] * np.exp(forward[t][:n] + p - total[:n])
                ways.append(np.concatenate([p, np.full(active[t] - n, -np.inf)]))
            if ways:
                backward[t][: active[t]] = _log_sum(ways)
        single = np.bincount(self.words[0], found[0], len(self.names))
        several = np.zeros(len(self.table.words))
        for k in range(1, SYLLABLES):
            real = self.words[k] >= 0
            several += np.bincount(self.words[k][real], found[k][real], len(several))
        have = np.flatnonzero(several)
        return pa.concat_arrays([self.names.cast(pa.string()), pa.array([self.table.words[x] for x in have], pa.string())]), np.concatenate([single, several[have]])


def _log_sum(ways: list[np.ndarray]) -> np.ndarray:
    """log of the sum of exp; the first way is never -inf everywhere that it counts."""
    high = np.maximum.reduce(ways)
    return high + np.log(sum(np.exp(x - high) for x in ways))


def run_counts(texts: DataFrame) -> DataFrame:
    """run (lower-case syllables), times: the distinct runs of all texts, each of them whole."""

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for run in _RUN.findall((text or "").lower()):
                    key = " ".join(run.split())
                    seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["run", "times"])

    return _summed(texts.select("text").mapInArrow(said, "run string, times long"))


#: Parts of the tables of runs and stretches for each core.
PARTS_A_CORE = 4


def _summed(found: DataFrame) -> DataFrame:
    """Dealt to so many parts that are not coalesced: what is learned from runs takes long, though they are few bytes."""
    parts = PARTS_A_CORE * found.sparkSession.sparkContext.defaultParallelism
    return found.repartition(parts, "run").groupBy("run").agg(F.sum("times").alias("times"))


def _syllables(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(all syllables one after the other, how many each run has, how often it comes) of pieces of a batch of runs."""
    ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:] if batch.num_rows else []):
        held = pc.split_pattern(batch.column(0).slice(a, b - a), " ")
        yield held.flatten(), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False)


def _word_counts(run_table: DataFrame, sizes: range, known: Broadcast[Table] | None = None) -> DataFrame:
    """word, n: words of so many syllables (one more each) in all runs; with ``known`` those alone whose syllables before the last are a word of it."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, lengths, times in _syllables(batch):
                coded = flat.dictionary_encode()
                names, local = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(local))
                times = np.repeat(times, lengths)
                first, node = np.arange(len(local)), np.zeros(len(local), np.int64)  # of each word its first syllable; and of those before the last what they are
                if known is not None:
                    node = known.value.words_of(names, local, left, sizes[0] - 1)
                    first = np.flatnonzero(node >= 0)
                for k in sizes:
                    first = first[left[first] >= k]
                    _, one, same = np.unique(node[first] * len(names) + local[first + k - 1], return_index=True, return_inverse=True)
                    node[first] = same
                    n = np.bincount(same, times[first], len(one)).astype(np.int64)
                    made = pc.binary_join_element_wise(*[names.take(pa.array(local[first[one] + j])) for j in range(k)], "_")
                    yield pa.RecordBatch.from_arrays([made.cast(pa.string()), pa.array(n)], ["word", "n"])

    return run_table.select("run", "times").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


_SINGLE, _SEVERAL = "instr(word, '_') = 0", "instr(word, '_') > 0"


def ngram_counts(run_table: DataFrame, least: int = LEAST) -> DataFrame:
    """word, n: all single syllables, and words of up to SYLLABLES syllables that occur ``least`` times; where learning begins."""
    return _word_counts(run_table, range(1, SYLLABLES + 1)).where(f"{_SINGLE} OR n >= {least}")


def _first_rows(counts: DataFrame, most: int) -> dict[str, float]:
    """word to n of the ``most`` most frequent, of equal ones the first words. A count of rows by n leaves out what can't be among them before any are sorted, so ``counts`` is best written."""
    bound, n = None, 0
    for r in sorted(counts.groupBy(F.floor("n").alias("n")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["n"]):
        bound, n = r["n"], n + r["rows"]
        if n >= most:
            break
    if bound is None:
        return {}
    first = counts.where(F.col("n") >= bound).orderBy(F.desc("n"), "word").limit(most).toArrow()
    return dict(zip(first["word"].to_pylist(), first["n"].to_pylist()))


def frequent_words(run_table: DataFrame, least: int = LEAST, most: int = MOST) -> dict[str, int]:
    """Of ``ngram_counts`` the ``most`` most frequent single syllables and the ``most`` most frequent words of several.

    A word comes no more often than its syllables without the last and stands behind them where it comes as often, so it is
    among the first only if they are: longer words are counted where those before the last syllable are among the first so far.
    """
    held = Written(_word_counts(run_table, range(1, 3)).where(f"{_SINGLE} OR n >= {least}"))
    try:
        single, several = _first_rows(held.read().where(_SINGLE), most), _first_rows(held.read().where(_SEVERAL), most)
    finally:
        held.drop()
    for k in range(3, SYLLABLES + 1):
        known = run_table.sparkSession.sparkContext.broadcast(Table(Lexicon(several)))
        held = Written(_word_counts(run_table, range(k, k + 1), known).where(F.col("n") >= least))
        try:
            several |= _first_rows(held.read(), most)
        finally:
            held.drop()
            known.unpersist()
        several = dict(sorted(several.items(), key=lambda x: (-x[1], x[0]))[:most])
    return single | several


def stretch_counts(run_table: DataFrame, lexicon: Lexicon) -> DataFrame:
    """run, times: the distinct stretches of all runs, which no word of the lexicon leaves. From them the same is learned as from the runs, as learning drops words and adds none of several syllables."""
    shared = run_table.sparkSession.sparkContext.broadcast(Table(lexicon))  # 2 x MOST words

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, lengths, times in _syllables(batch):
                starts = shared.value.laid(flat, lengths).starts
                made = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), flat), " ")
                counts = pa.table({"run": made, "times": np.repeat(times, lengths)[starts]}).group_by("run").aggregate([("times", "sum")])
                yield from counts.select(["run", "times_sum"]).rename_columns(["run", "times"]).combine_chunks().to_batches()

    # By length, as stretches that are worked on together take as many steps as the longest.
    return _summed(run_table.select("run", "times").mapInArrow(stretches, "run string, times long")).sortWithinPartitions(F.length("run"))


def learn(texts: DataFrame, rounds: int = ROUNDS, least: int = LEAST, most: int = MOST) -> Lexicon:
    """The lexicon of a corpus (text). Null texts have no runs.

    The distinct runs are counted once and written, and so are the distinct stretches of runs that the lexicon's words part; a round
    adds up the expected counts of each partition's stretches before they are shuffled.
    At most 2 x ``most`` words come to the driver and go out to the tasks.
    """
    held = Written(run_counts(texts))
    try:
        lexicon = Lexicon(frequent_words(held.read(), least, most))
        stretches = Written(stretch_counts(held.read(), lexicon))
    finally:
        held.drop()
    try:
        for _ in range(rounds):
            lexicon = _learned(stretches.read(), lexicon, most)
        return lexicon
    finally:
        stretches.drop()


def _learned(table: DataFrame, lexicon: Lexicon, most: int) -> Lexicon:
    """The lexicon after one more round over the distinct stretches."""
    shared = table.sparkSession.sparkContext.broadcast(Table(lexicon))  # 2 x most words

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for flat, lengths, times in _syllables(batch):
                words, n = shared.value.laid(flat, lengths).expected(times)
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], ["word", "n"])

    counts = table.select("run", "times").mapInArrow(expect, "word string, n double").groupBy("word").agg(F.sum("n").alias("n"))
    held = Written(counts.where(F.col("n") >= 1e-6))
    try:
        return Lexicon(_first_rows(held.read(), 2 * most))
    finally:
        held.drop()
        shared.unpersist()


def segment(text: str | None, lexicon: Lexicon) -> str:
    """Tokens with single spaces between them, syllables of one word joined by ``_``."""
    return " ".join(w for run in runs(text) for w in (lexicon.segmented(run) if run[0][0].isalnum() else run))


def segmented_texts(texts: list[str | None], table: Table) -> list[str]:
    """``segment`` of each text."""
    flat, lengths, ends = [], [], []
    for text in texts:
        for part in _PART.findall(text or ""):
            said = part.split()
            flat += said
            lengths.append(len(said))
        ends.append(len(flat))
    if not flat:
        return [""] * len(texts)
    lower = "\n".join(flat).lower().split("\n")  # no syllable or mark has white space in it
    joins = table.laid(pa.array(lower, pa.string()), np.array(lengths, np.int64)).joined()
    marked = [("_" if j else " ") + x for j, x in zip(joins.tolist(), flat)]
    return ["".join(marked[a:b])[1:] for a, b in zip([0, *ends], ends)]


def lexicon_udf(lexicon: Lexicon, spark):
    """``segment`` as a function of a text column; null texts become empty ones."""
    shared = spark.sparkContext.broadcast(Table(lexicon))  # 2 x MOST words

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out: list[str] = []
            held, size = [], 0
            for text in batch.tolist():
                held.append(text)
                size += len(text or "")
                if size >= AT_ONCE:
                    out += segmented_texts(held, shared.value)
                    held, size = [], 0
            yield pd.Series(out + segmented_texts(held, shared.value), dtype="object")

    return run
