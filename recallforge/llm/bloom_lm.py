"""Language-model scores from a log-frequency Bloom filter.

All training documents are counted: single words and, as contexts with their next word, pairs. A count is quantised to
a level (counts up to EXACT have levels of their own, from there on a level is a factor of BASE wide), and the filter
holds an n-gram once for each level up to its own. A reader probes levels, each twice as far as the one before and then
between the last two, and so gets the level back, or with a small chance a higher one. Nothing is left out: pairs that
occur once are held too. Of a single word's count the filter also holds three bits that say where in its level it lies.

N-grams are counted where they are held: a worker counts a portion of the text, packs what belongs to each bucket of
n-grams into one row, and a bucket's task adds up its rows and builds its segment of the filter, as large as its entries
need. So the error rate is the same at every size. Within a segment all bits of an n-gram's level lie in one line of 64
bytes. Segments of at most MOST_BYTES together go to the driver and from there to all workers. More are not collected:
texts are dealt to portions by their hash, each portion's n-grams are sent to their buckets, probed there, and the
levels go back to the portions. Both ways give the same scores.

A word's probability is ``(c(context, word) + m * p(word)) / (c(context) + m)``, m being ``c(context) ** PRIOR``: the
rarer the context, the more its words weigh. A pair's count is taken as the mean of the counts that have its level, so
counts of a context's pairs sum to the context's, and probabilities over the vocabulary sum to one, but for quantisation
and false positives. p(word) adds a half to counts taken likewise, which sum to the number of training tokens.

Exact counts, for the base score, come in two parts at every size. The most frequent words, at most ``frequent_words`` of
them, are sent to all workers as a sorted table; they make up most of any text. A document's other words are joined with
their counts by shuffle.

Defined cases: a null or empty text is one end token; a null doc_id is not held out; repeated rows are counted and
answered each; no training document gives N = V = 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _MULTIPLIER, ensure_importable, frugal, hashed_words, id_bucket, maybe_broadcast, mixed, shuffles_freed, stored

#: Counts up to EXACT have a level each; above, a level holds counts of a factor of BASE.
BASE, EXACT = 1.1, 10
LEVELS = 330
#: Segments of so many bytes are sent to all workers; n-grams are sent to more.
MOST_BYTES = 160 << 20
#: Bytes of training text whose n-grams make a bucket, on average.
BUCKET_BYTES = 2 << 20
LINE_BITS, BITS_PER_ENTRY, PROBES = 512, 12, 5
#: How fast a context's own counts outweigh those of single words.
PRIOR = 0.75
#: Bits that say where in its level a single word's count lies.
FINE_BITS = 3
#: A quarter of the tokens that are counted at a time.
PORTION = 350_000
#: Bytes of distinct texts that are scored at a time where n-grams are sent to segments.
PORTION_BYTES = 4 << 20
#: Buckets whose n-grams a portion sends as one row, and bytes of n-grams that are probed at a time.
SHELF, PROBED_BYTES = 8, 4 << 20
#: Parts in which portions are sent, one after the other.
ROUNDS = 3
#: Rows of a table that is sent to all tasks.
BROADCAST_ROWS = 1_000_000
FREQUENT_WORDS = 1_000_000

END, START = (np.uint64(x) for x in mixed(np.array([1, 2], np.uint64)))  # fixed 64-bit values, as likely a word's as any


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, one after the other, and how many each text has."""
    h, counts = hashed_words(texts)
    return np.insert(h, np.cumsum(counts), END), counts + 1


def pairs(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, its context and the hash of both; a text's first token has the start as its context."""
    context = np.empty_like(h)
    context[1:] = h[:-1]
    context[np.cumsum(counts) - counts] = START
    with np.errstate(over="ignore"):
        return context, mixed(context * _MULTIPLIER + h)


def slices(batches, rows: int = 400):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def packed_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, words, data): the tokens and pairs of the column text, counted a portion at a time; ``data`` holds the
    hashes and counts of so many ``words``, then those of pairs."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            h, c = np.unique(np.concatenate([x[0] for x in held]), return_counts=True)
            p, d = np.unique(np.concatenate([x[1] for x in held]), return_counts=True)
            rows = []
            words_, pairs_ = dealt(keyed(1, h), buckets), dealt(p, buckets)
            for bucket in sorted(words_.keys() | pairs_.keys()):
                w, q = words_.get(bucket, NONE), pairs_.get(bucket, NONE)
                rows.append((bucket, len(w), b"".join(x.tobytes() for x in (h[w], c[w].astype("<u4"), p[q], d[q].astype("<u4")))))
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 64]), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "words", "data"])

        for part in slices(batches):
            h, n = tokens(part.column(0).to_pylist())
            held.append((h, keyed(2, pairs(h, n)[1])))
            size += len(h)
            if size >= 4 * PORTION:
                yield from out()
                held.clear()
                size = 0
        if held:
            yield from out()

    ensure_importable(docs.sparkSession)
    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(frugal(count), "bucket int, words int, data binary")


NONE = np.empty(0, np.int64)


def dealt(keys: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """By bucket, where its keys are."""
    of = (keys % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers are sorted by their digits
    order = np.argsort(of, kind="stable")
    ordered = of[order].astype(np.int64)
    firsts = np.flatnonzero(np.diff(ordered, prepend=-1))
    return dict(zip(ordered[firsts].tolist(), np.split(order, firsts[1:])))


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    k, c = np.concatenate([NONE.astype(np.uint64), *keys]), np.concatenate([NONE, *counts]).astype(np.int64)
    order = np.argsort(k)
    k = k[order]
    firsts = np.flatnonzero(np.diff(k, prepend=k[:1] + np.uint64(1)))
    return k[firsts], np.add.reduceat(c[order], firsts) if len(firsts) else NONE


def lower_edges() -> np.ndarray:
    """By level, the smallest count that has it; 0 for level 0."""
    levels = np.arange(LEVELS + 1)
    return np.where(levels <= EXACT, levels, np.ceil(EXACT * BASE ** np.maximum(levels - EXACT, 0.0) - 1e-6)).astype(float)


def fine_part(c: np.ndarray, level: np.ndarray) -> np.ndarray:
    """In which of 1 << FINE_BITS parts of its level a count lies."""
    edges = lower_edges()
    return np.floor((c - edges[level]) * (1 << FINE_BITS) / (edges[level + 1] - edges[level])).astype(np.int64)


def fine_count(level: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The count that a level and a part of it stand for; exact where parts hold one count at most."""
    edges = lower_edges()
    step = (edges[level + 1] - edges[level]) / (1 << FINE_BITS)
    return np.where(level > 0, edges[level] + np.ceil(part * step - 1e-9) + np.maximum(0.0, (step - 1) / 2), 0.0)


def level_of(c: np.ndarray) -> np.ndarray:
    """The quantised level of counts."""
    above = EXACT + np.floor(np.log(np.maximum(c, 1) / EXACT) / math.log(BASE) + 1e-9)
    return np.where(c <= EXACT, c, above).astype(np.int64)


def keyed(order: int, h: np.ndarray) -> np.ndarray:
    """What the filter holds of an n-gram: orders are kept apart."""
    with np.errstate(over="ignore"):
        return mixed(h + np.uint64(order) * _MULTIPLIER)


def places(key: np.ndarray, level: np.ndarray | int, lines: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The line of an n-gram's level, among the ``lines`` of its segment, and a hash that has its probes."""
    with np.errstate(over="ignore"):
        h = mixed(key ^ (np.asarray(level).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)))
        return (((h >> np.uint64(40)) * np.asarray(lines).astype(np.uint64)) >> np.uint64(24)).astype(np.int64), h


def probe(h: np.ndarray, number: int) -> np.ndarray:
    return ((h >> np.uint64(9 * number)) & np.uint64(LINE_BITS - 1)).astype(np.int64)


def built_segment(words: np.ndarray, counts: np.ndarray, pair_keys: np.ndarray, pair_counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> bytes:
    """The bits of the segment that holds words (by hash) and pairs (by key) with their counts."""
    own, level = keyed(1, words), level_of(counts)
    keys, levels = [own, pair_keys], [level, level_of(pair_counts)]
    wide = np.flatnonzero(level > EXACT)
    part = fine_part(counts[wide], level[wide])
    for bit in range(FINE_BITS):
        has = wide[(part >> bit) & 1 == 1]
        keys.append(keyed(3 + bit, words[has]))
        levels.append(np.ones(len(has), np.int64))
    k, most = np.concatenate(keys), np.concatenate(levels)
    lines = max(1, math.ceil(int(most.sum()) * bits_per_entry / LINE_BITS))
    bits = np.zeros(lines * LINE_BITS, bool)
    for at in range(1, int(most.max(initial=0)) + 1):
        up = most >= at
        k, most = k[up], most[up]
        line, h = places(k, at, lines)
        for number in range(PROBES):
            bits[line * LINE_BITS + probe(h, number)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class LogFrequencyBloom:
    """Segments by bucket; a bucket that holds nothing has an empty one."""

    def __init__(self, segments: list[bytes]) -> None:
        self.bits = np.frombuffer(b"".join(segments), np.uint8)
        self.lines = np.array([len(x) * 8 // LINE_BITS for x in segments], np.int64)
        self.first = np.cumsum(self.lines) - self.lines

    def holds(self, bucket: np.ndarray, keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
        """Whether the filter has each n-gram at the level."""
        line, h = places(keys, level, self.lines[bucket])
        line = (line + self.first[bucket]) * LINE_BITS
        out = np.zeros(len(keys), bool)
        live = np.flatnonzero(self.lines[bucket] > 0)
        for number in range(PROBES):
            at = line[live] + probe(h[live], number)
            live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(live):
                return out
        out[live] = True
        return out

    def levels(self, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """By n-gram, the highest level that the filter has: first in steps that double, then halving what is between."""
        have, lack = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        live, level = np.arange(len(keys)), 1
        while len(live):
            hit = self.holds(bucket[live], keys[live], level) if level <= LEVELS else np.zeros(len(live), bool)
            have[live[hit]], lack[live[~hit]] = level, level
            live, level = live[hit], 2 * level
        while len(live := np.flatnonzero(lack - have > 1)):
            middle = (have[live] + lack[live]) // 2
            hit = self.holds(bucket[live], keys[live], middle)
            have[live[hit]], lack[live[~hit]] = middle[hit], middle[~hit]
        return np.minimum(have, LEVELS - 1)

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        return self.levels((keys % np.uint64(len(self.lines))).astype(np.int64), keys)

    def of_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels, and the parts of them that counts lie in."""
        own = keyed(1, h)
        bucket = (own % np.uint64(len(self.lines))).astype(np.int64)
        level, part = self.levels(bucket, own), np.zeros(len(h), np.int64)
        wide = np.flatnonzero(level > EXACT)
        for bit in range(FINE_BITS):
            part[wide] |= self.holds(bucket[wide], keyed(3 + bit, h[wide]), 1).astype(np.int64) << bit
        return level, part


class Levels:
    """What the filter said of some n-grams, to be asked like the filter; keys in order."""

    def __init__(self, words: np.ndarray, levels: np.ndarray, parts: np.ndarray, pair_keys: np.ndarray, pair_levels: np.ndarray) -> None:
        self.words, self.word_levels, self.parts, self.pairs, self.pair_levels = words, levels, parts, pair_keys, pair_levels

    def of_pairs(self, keys: np.ndarray) -> np.ndarray:
        return self.pair_levels[np.searchsorted(self.pairs, keys)]

    def of_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.words, h)
        return self.word_levels[at], self.parts[at]


#: kind 0: a bucket's segment, in data; 1: a word h and its count c; 2: how many (n) words (h = 1) or pairs (h = 2) of a
#: level there are, and the sum of their counts.
MODEL = "kind byte, bucket int, h long, c long, level int, n long, data binary"


def model_table(docs: DataFrame, bits_per_entry: int = BITS_PER_ENTRY) -> tuple[DataFrame, int]:
    """A table of MODEL of the column text of ``docs``, and how many buckets it has."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    schema = pa.schema([("kind", pa.int8()), ("bucket", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("level", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def fold(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        for n, data in zip(table.column("words").to_pylist(), table.column("data").to_pylist()):
            m = len(data) // 12 - n
            at = 0
            for out, (kind, count) in zip(found, (("<u8", n), ("<u4", n), ("<u8", m), ("<u4", m))):
                out.append(np.frombuffer(data, kind, count, at))
                at += count * int(kind[2])
        h, c = summed(found[0], found[1])
        p, d = summed(found[2], found[3])
        parts = [pa.table([pa.array([x], f.type) for x, f in zip((0, key[0].as_py(), None, None, None, None, built_segment(h, c, p, d, bits_per_entry)), schema)], schema)]
        none = lambda n, f: pa.nulls(n, f.type)
        level = level_of(c)
        columns = {"kind": np.ones(len(h), np.int8), "h": h.view(np.int64), "c": c, "level": level.astype(np.int32)}
        parts.append(pa.table([pa.array(columns[f.name], f.type) if f.name in columns else none(len(h), f) for f in schema], schema))
        for order, counts, levels in ((1, c, level), (2, d, level_of(d))):
            at = np.unique(levels)
            columns = {"kind": np.full(len(at), 2, np.int8), "h": np.full(len(at), order), "c": np.bincount(levels, counts)[at].astype(np.int64) if len(at) else NONE, "level": at.astype(np.int32), "n": np.bincount(levels)[at] if len(at) else NONE}
            parts.append(pa.table([pa.array(columns[f.name], f.type) if f.name in columns else none(len(at), f) for f in schema], schema))
        return pa.concat_tables(parts)

    with shuffles_freed(docs.sparkSession):
        return stored(packed_counts(docs, buckets).groupBy("bucket").applyInArrow(fold, MODEL), "model"), buckets


class Quantised:
    """What is known of all counts: how many there are at each level, and their mean."""

    def __init__(self, model: DataFrame) -> None:
        rows = model.where("kind = 2").groupBy("h", "level").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).collect()  # a row per level
        self.means, self.kinds, self.total = {}, {1: 0, 2: 0}, {1: 0, 2: 0}
        for order in (1, 2):
            self.means[order] = lower_edges()
            for r in (r for r in rows if r["h"] == order):
                self.means[order][r["level"]] = r["c"] / r["n"]
                self.kinds[order] += r["n"]
                self.total[order] += r["c"]
        #: What single words' counts, each with a half added, sum to, one unseen word among them.
        self.whole = self.total[1] + 0.5 * (self.kinds[1] + 1)


def collected(model: DataFrame, buckets: int, most: int = -1) -> LogFrequencyBloom | None:
    """The filter in the driver's memory; None if it has more bytes than ``most``, or MOST_BYTES."""
    held = model.where("kind = 0")
    if (held.agg(F.sum(F.octet_length("data"))).first()[0] or 0) > (MOST_BYTES if most < 0 else most):
        return None
    segments = [b""] * buckets
    for r in held.select("bucket", "data").toLocalIterator():
        segments[r["bucket"]] = bytes(r["data"])
    return LogFrequencyBloom(segments)


def told(found: Callable[[np.ndarray], np.ndarray], asked: list[bytes]) -> list[bytes]:
    """What ``found`` says of the n-grams of each row, of many rows at a time; two bytes for each n-gram's eight."""
    out, ends = [], np.cumsum([len(x) for x in asked])
    for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(ends // PROBED_BYTES)) + 1):
        rows = [asked[i] for i in part]
        said = found(np.frombuffer(b"".join(rows), "<u8")).astype("<u2").tobytes()
        at = np.cumsum([0, *(len(x) // 4 for x in rows)]).tolist()
        out += [said[i:j] for i, j in zip(at, at[1:])]
    return out


def distinct_texts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """Each text of ``docs`` (k, text) once; only texts with a hash of ``copies`` (k), which several rows have, are shuffled for it."""
    copies = maybe_broadcast(copies, BROADCAST_ROWS)
    several = docs.join(copies, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    return docs.join(copies, "k", "left_anti").unionByName(several)


def sent_scores(docs: DataFrame, copies: DataFrame, model: DataFrame, buckets: int, known: Quantised) -> DataFrame:
    """(k, score) of the distinct texts of ``docs`` (k, text), k being the hash of the text; n-grams are sent to segments.
    ``copies`` (k) has the hashes that several rows have.

    A portion sends each of its n-grams once, so the most common one is sent once for each PORTION_BYTES of text. What it
    sends to a shelf, which is SHELF buckets, is one row, and a shelf's task probes n-grams of many portions together.
    Portions are sent in ROUNDS, so that only a part of them lies on disk at a time.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions, shelves = math.ceil(size / PORTION_BYTES) + 1, math.ceil(buckets / SHELF)
    texts = distinct_texts(docs, copies).select(F.pmod(F.xxhash64("k"), F.lit(portions)).alias("portion"), "k", "text")

    def asks(table: pa.Table):
        """Of a portion: tokens, how many each text has, distinct words and pairs in order, and which each shelf has."""
        h, n = tokens(table.column("text").to_pylist())
        w, p = np.unique(h), np.unique(keyed(2, pairs(h, n)[1]))
        shelf = lambda keys: dealt(keys % np.uint64(buckets), shelves)
        return h, n, w, p, shelf(keyed(1, w)), shelf(p)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, w, p, words_, pairs_ = asks(table)
        of = sorted(words_.keys() | pairs_.keys())
        data = [(w[words_.get(b, NONE)].tobytes(), p[pairs_.get(b, NONE)].tobytes()) for b in of]
        return pa.table({"shelf": pa.array(of, pa.int32()), "portion": pa.array([key[0].as_py()] * len(of), pa.int64()), "words": pa.array([x[0] for x in data], pa.binary()), "pairs": pa.array([x[1] for x in data], pa.binary())})

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        segments = [b""] * buckets
        for bucket, data in zip(held.column("bucket").to_pylist(), held.column("data").to_pylist()):
            segments[bucket] = data
        bloom = LogFrequencyBloom(segments)

        def of_words(h: np.ndarray) -> np.ndarray:
            level, part = bloom.of_words(h)
            return level << FINE_BITS | part

        of = {"words": of_words, "pairs": bloom.of_pairs}
        columns = {name: pa.array(told(found, asked.column(name).to_pylist()), pa.binary()) for name, found in of.items()}
        return pa.table({"portion": asked.column("portion"), "shelf": asked.column("shelf"), **columns})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, n, w, p, words_, pairs_ = asks(table)
        word_levels, levels = np.zeros(len(w), np.int64), np.zeros(len(p), np.int64)
        for r in answers.to_pylist():
            word_levels[words_.get(r["shelf"], NONE)] = np.frombuffer(r["words"], "<u2")
            levels[pairs_.get(r["shelf"], NONE)] = np.frombuffer(r["pairs"], "<u2")
        seen, at = np.unique(h, return_inverse=True)
        logs = log_probabilities(Levels(w, word_levels >> FINE_BITS, word_levels & ((1 << FINE_BITS) - 1), p, levels), known, h, n, seen, at)
        return pa.table({"k": table.column("k"), "score": pa.array(np.add.reduceat(logs, np.cumsum(n) - n))})

    held = model.where("kind = 0").select(F.pmod("bucket", F.lit(shelves)).alias("shelf"), "bucket", "data")
    sent = []
    for number in range(min(ROUNDS, portions)):
        some = texts.where(F.col("portion") % ROUNDS == number)
        asked = some.groupBy("portion").applyInArrow(ask, "shelf int, portion long, words binary, pairs binary")
        answers = held.groupBy("shelf").cogroup(asked.groupBy("shelf")).applyInArrow(answer, "portion long, shelf int, words binary, pairs binary")
        with shuffles_freed(docs.sparkSession):
            sent.append(stored(some.groupBy("portion").cogroup(answers.groupBy("portion")).applyInArrow(score, "k long, score double"), "sent"))
    return functools.reduce(DataFrame.unionByName, sent)


def log_probabilities(bloom: LogFrequencyBloom | Levels, known: Quantised, h: np.ndarray, counts: np.ndarray, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 probability of every token given the one before it; ``seen[at]`` is ``h``."""
    level, part = bloom.of_words(seen)
    own = ((known.means[1][level] + 0.5) / known.whole)[at]
    of_word = fine_count(level, part)
    pair, where = np.unique(keyed(2, pairs(h, counts)[1]), return_inverse=True)
    both = known.means[2][bloom.of_pairs(pair)][where]
    context = np.empty(len(h))
    context[1:] = of_word[at[:-1]]
    context[np.cumsum(counts) - counts] = of_word[np.searchsorted(seen, END)]  # texts begin as often as they end
    prior = np.maximum(context, 1.0) ** PRIOR
    return np.log10((np.minimum(both, context) + prior * own) / (context + prior))


SCORES = "doc_id long, k long, h long, tf long, held_out boolean, n_tokens long, score double, n_known long, base_score double"


class Counts:
    """Exact counts of the most frequent words."""

    def __init__(self, words: DataFrame, most: int) -> None:
        """``words`` (h, c, level), cut at a level so that at most ``most`` of them are held."""
        sizes = {r["level"]: r["n"] for r in words.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row per level
        self.least, held = max(sizes, default=0) + 1, 0
        for level in sorted(sizes, reverse=True):
            held += sizes[level]
            if held > most:
                break
            self.least = level
        table = words.where(F.col("level") >= self.least).select("h", "c").toArrow()
        h, c = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts of sorted hashes; -1 for words not held."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.c[at], -1)


def score_documents(docs: DataFrame, frequent_words: int = FREQUENT_WORDS, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    ensure_importable(spark)
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 5) == 1, F.lit(False))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    model, buckets = model_table(docs.where(~F.col("held_out")), bits_per_entry)
    words = model.where("kind = 1").select("h", "c", "level")
    quantised = Quantised(model)
    n, whole = quantised.total[1], quantised.whole
    bloom = collected(model, buckets)
    counts_ = Counts(words, frequent_words)
    least = counts_.least
    filter_, known = spark.sparkContext.broadcast(bloom), spark.sparkContext.broadcast(counts_)

    def score(batches):
        """A row with the word 0 for each document, and one for each of its words whose count is not held here."""
        bloom = filter_.value
        for part in slices(batches):
            h, counts = tokens(part.column(2).to_pylist())
            starts = np.cumsum(counts) - counts
            seen, at = np.unique(h, return_inverse=True)
            c = known.value.of(seen)
            logs = np.log10((np.maximum(c, 0) + 0.5) / whole) * (c >= 0)
            add = lambda x: pa.array(np.add.reduceat(x, starts))
            scores = pa.nulls(len(counts), pa.float64()) if bloom is None else add(log_probabilities(bloom, quantised, h, counts, seen, at))
            own = [part.column(1), pa.array(counts), scores, add((c > 0)[at].astype(np.int64)), add(logs[at])]
            rare = np.flatnonzero((c < 0)[at])
            row, word = np.repeat(np.arange(len(counts)), counts)[rare], at[rare]
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
            taken = part.select([0, 3]).take(pa.array(np.concatenate([np.arange(len(counts)), row[new]])))
            words_ = np.concatenate([np.zeros(len(counts), np.uint64), seen[word[new]]]).view(np.int64)
            tf = np.concatenate([np.ones(len(counts), np.int64), np.diff(np.append(new, len(row)))])
            columns = [taken.column(0), taken.column(1), pa.array(words_), pa.array(tf), *[pa.concat_arrays([x, pa.nulls(len(new), x.type)]) for x in own]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "h", "tf", "held_out", "n_tokens", "score", "n_known", "base_score"])

    keyed_docs = docs.select("doc_id", "held_out", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("k"))
    every = stored(keyed_docs.mapInArrow(frugal(score), SCORES), "scores")
    if bloom is None:
        copies = stored(every.where("h = 0").groupBy("k").count().where("count > 1").select("k"), "copies")
        sent = sent_scores(keyed_docs.select("k", "text"), copies, model, buckets, quantised)
        every = every.drop("score").join(sent, "k").select(every.columns)
    scored, each = every.where("h = 0").drop("h", "tf"), every.select("doc_id", "k", "h", "tf")
    found = each.join(words.where(F.col("level") < least).select("h", "c"), "h", "left")
    c, word = F.coalesce("c", F.lit(0)), F.col("h") != 0
    # Rows that are there m times have sent their words m times.
    sums = found.groupBy("doc_id", "k").agg(
        F.count_if(~word).alias("m"),
        F.sum(F.when(word & (c > 0), F.col("tf")).otherwise(0)).alias("n"),
        F.sum(F.when(word, F.col("tf") * F.log10((c + 0.5) / whole)).otherwise(0.0)).alias("logs"),
    )
    sums = sums.select(F.col("doc_id").alias("of"), F.col("k").alias("of_k"), (F.col("n") / F.col("m")).cast("long").alias("more"), (F.col("logs") / F.col("m")).alias("logs"))
    both = scored.join(sums, scored["doc_id"].eqNullSafe(sums["of"]) & (scored["k"] == sums["of_k"]))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("logs")).alias("base_score"), "score")
