"""Language identification, words first.

A word seen in training scores by its log frequency in each language. An unseen word falls back to the longest of its
character n-grams that training saw, then to shorter ones, and at last to nothing. A text's language is the one with
the largest sum over all of its words; the score is its share when the sums are taken as log likelihoods. A word is a
maximal run of letters, in lower case.

The tables are learned from labelled documents. ``sample_docs``, and ``least_docs`` of each language, bound in expectation
how many are used (a hash of the text picks them); all their words and n-grams are held, so what is sent to workers is
bounded by the sample. Every text is read whole, in training and in prediction.

Texts are split in Arrow's compiled functions; each distinct token is scored once per worker, a batch of new ones at a
time, and a text's score is gathered from those of its tokens.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every text when nothing was learned; a
text of which no part is known goes to the language with most training words, with an even share; a null or unlabelled
row is never learned from; ties go to the language first in code-point order; repeated rows are answered each; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _MULTIPLIER, ensure_importable, frugal, id_bucket, maybe_broadcast, mixed, portions, ranges, stored

UNDETERMINED = "und"
LONGEST = 5
#: Added to each count.
SMOOTHING = 0.5
#: Distinct tokens that a worker keeps, of so many bytes and a number per language each; words scored at a time.
_CACHE_TOKENS, _KEPT_TOKENS, _CHUNK = 200_000, 80_000, 50_000
#: Bytes of text scored at a time.
_PORTION_BYTES = 1 << 20


def letter_runs(token: str) -> list[str]:
    return [token] if token.isalpha() else "".join([c if c.isalpha() else " " for c in token]).split()


def gram_hashes(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of each word between its marks (single characters without them), word after word,
    and how many each word has."""
    left, right = ("^", "$") if n > 1 else ("", "")
    text = left + (right + left).join(words.to_pylist()) + right
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + len(left + right)
    counts = np.maximum(lengths - n + 1, 0)
    at = ranges(np.cumsum(lengths) - lengths, counts)
    h = np.full(len(at), np.uint64(n))
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h + chars[at + j]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        return mixed(h), counts


class Model:
    """Log frequencies by language of words and of character n-grams."""

    def __init__(self, words: pa.Array, languages: pa.Array, counts: np.ndarray) -> None:
        """A row per word, language and its count."""
        self.languages = sorted(set(languages.to_pylist()))
        coded = words.dictionary_encode()
        column = np.array([self.languages.index(x) for x in languages.dictionary_encode().dictionary.to_pylist()], np.int64)[languages.dictionary_encode().indices.to_numpy()] if len(languages) else np.empty(0, np.int64)
        table = np.zeros((len(coded.dictionary), len(self.languages)))
        np.add.at(table, (coded.indices.to_numpy(), column), counts)
        self.words = coded.dictionary
        self.total = table.sum(axis=0)
        self.word_scores = self._logs(table)
        #: By length, the hashes of known n-grams in order, and their scores.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, LONGEST + 1):
            self.grams[n] = self._counted_grams(table, n)

    def _counted_grams(self, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words are hashed a chunk at a time and hashes counted a sixteenth at a time, so that little is held at once."""
        hashes, of = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        for i in range(0, len(self.words), _CHUNK):
            h, own = gram_hashes(self.words[i : i + _CHUNK], n)
            hashes.append(h)
            of.append(np.repeat(np.arange(i, i + len(own), dtype=np.int32), own))
        h, word = np.concatenate(hashes), np.concatenate(of)
        del hashes, of
        keys, sums = [], []
        for part in range(16):
            at = np.flatnonzero(h >> np.uint64(60) == part)
            found, where = np.unique(h[at], return_inverse=True)
            keys.append(found)
            sums.append(np.column_stack([np.bincount(where, table[word[at], k], len(found)) for k in range(table.shape[1])]) if table.shape[1] else np.empty((len(found), 0)))
        return np.concatenate(keys), self._logs(np.concatenate(sums))

    @staticmethod
    def _logs(table: np.ndarray) -> np.ndarray:
        return (np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * len(table))).astype(np.float32)

    def scores(self, words: pa.Array) -> np.ndarray:
        """A row per word."""
        out = np.zeros((len(words), len(self.languages)))
        at = pc.index_in(words, self.words)
        seen = at.is_valid().to_numpy(zero_copy_only=False)
        out[seen] = self.word_scores[at.drop_null().to_numpy()]
        rest = np.flatnonzero(~seen)
        for i in range(0, len(rest), _CHUNK):
            left = rest[i : i + _CHUNK]
            for n in range(LONGEST, 0, -1):
                if not len(left) or not len(self.grams[n][0]):
                    continue
                keys, rows = self.grams[n]
                h, counts = gram_hashes(words.take(pa.array(left)), n)
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == h)
                of = np.repeat(np.arange(len(left)), counts)[hit]
                found, firsts, times = np.unique(of, return_index=True, return_counts=True)
                if len(found):
                    out[left[found]] = np.add.reduceat(rows[place[hit]], firsts, axis=0) / times[:, None]
                    left = np.delete(left, found)
        return out

    def word(self, word: str) -> np.ndarray:
        return self.scores(pa.array([word]))[0]


class Scorer:
    """Scores of white-space separated tokens, kept as they come."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.tokens = pa.array([], pa.string())
        self.table = np.zeros((0, len(model.languages)))
        self.lettered = np.zeros(0, bool)

    def _learn(self, tokens: pa.Array) -> None:
        words: list[str] = []
        counts = []
        for token in tokens.to_pylist():
            own = letter_runs(token)
            counts.append(len(own))
            words += own
        coded = pa.array(words, pa.string()).dictionary_encode()
        rows = self.model.scores(coded.dictionary)[coded.indices.to_numpy()]
        each = np.array(counts, np.int64)
        table, some = np.zeros((len(tokens), len(self.model.languages))), np.flatnonzero(each)
        if len(some):
            table[some] = np.add.reduceat(rows, (np.cumsum(each) - each)[some], axis=0)
        self.tokens = pa.concat_arrays([self.tokens, tokens])
        self.table, self.lettered = np.concatenate([self.table, table]), np.concatenate([self.lettered, each > 0])

    def _places(self, tokens: pa.Array) -> np.ndarray:
        coded = tokens.dictionary_encode()
        if len(self.tokens) > _CACHE_TOKENS:
            self.tokens = pa.concat_arrays([self.tokens[:_KEPT_TOKENS]])
            self.table, self.lettered = self.table[:_KEPT_TOKENS].copy(), self.lettered[:_KEPT_TOKENS].copy()
        at = pc.index_in(coded.dictionary, self.tokens)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            at[new] = len(self.tokens) + np.arange(len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
        return at[coded.indices.to_numpy()]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, languages = len(texts), self.model.languages
        if not languages or not n:
            return [UNDETERMINED] * n, np.zeros(n)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        at = self._places(lists.flatten())
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        firsts = np.cumsum(sizes) - sizes
        sums = np.add.reduceat(self.table[at], firsts, axis=0)
        known, lettered = sums.any(axis=1), np.add.reduceat(self.lettered[at], firsts) > 0
        best = np.where(known, sums.argmax(axis=1), int(self.model.total.argmax()))
        top = sums.max(axis=1, keepdims=True)
        score = np.where(lettered, 1 / np.exp(sums - top).sum(axis=1), 0.0)
        return [languages[b] if x else UNDETERMINED for b, x in zip(best.tolist(), lettered.tolist())], score


def learn(labelled: DataFrame, sample_docs: int = 10_000, least_docs: int = 100) -> Model:
    """A model from the columns text and lang of ``labelled``: of about ``sample_docs`` of its rows, but of about
    ``least_docs`` of each language at least, or all that it has."""
    ensure_importable(labelled.sparkSession)
    labelled = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = min(1.0, sample_docs / max(1, counts.agg(F.sum("n")).first()[0] or 0))
    limit = F.floor(F.least(F.lit(1.0), F.greatest(F.lit(share), F.lit(float(least_docs)) / F.col("n"))) * (1 << 30))
    limits = maybe_broadcast(counts.select("lang", limit.cast("long").alias("limit")), 100_000)
    sample = labelled.join(limits, "lang").where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) < F.col("limit")).select("text", "lang")

    def count(batches):
        for batch in batches:
            tokens: dict[str, Counter] = defaultdict(Counter)
            lower = pc.utf8_lower(batch.column(0)).to_pylist()
            for text, lang in zip(lower, batch.column(1).to_pylist()):
                tokens[lang].update(text.split())
            held: dict[tuple[str, str], int] = defaultdict(int)
            for lang, own in tokens.items():
                for token, c in own.items():
                    for word in letter_runs(token):
                        held[lang, word] += c
            langs, words = zip(*held) if held else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["lang", "word", "c"])

    each = sample.mapInArrow(frugal(count), "lang string, word string, c long").groupBy("word", "lang").agg(F.sum("c").alias("c"))
    found = each.orderBy("word", "lang").toArrow().combine_chunks()  # bounded by the sample
    plain = lambda name: found.column(name).combine_chunks() if found.num_rows else pa.array([], found.schema.field(name).type)
    return Model(plain("word").cast(pa.string()), plain("lang").cast(pa.string()), plain("c").to_numpy())


def scored(batches: Iterator[pa.RecordBatch], scorer: Scorer, text: int, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The first columns of ``batches``, named ``keep``, with lang_pred and score by column ``text``, in portions."""
    for portion in portions(batches, text, _PORTION_BYTES):
        languages, scores = scorer.predict(portion.column(text))
        new = [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays([*portion.columns[: len(keep)], *new], [*keep, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score by the column ``text``, which is sent to workers once."""
    spark = docs.sparkSession
    ensure_importable(spark)
    shared = spark.sparkContext.broadcast(model)
    sent = keep if text in keep else [*keep, text]

    def score(batches):
        yield from scored(batches, Scorer(shared.value), sent.index(text), keep)

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*sent).mapInArrow(frugal(score), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows whose id is not held out; a row without id is held out."""
    return docs.where(F.coalesce(id_bucket(F.col("doc_id"), 3) != 1, F.lit(False)))


def identify(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``, learned from the rows that are not held out."""
    model = learn(training_rows(docs), **bounds)
    held_out = F.coalesce(id_bucket(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held_out, "text"), model, ["doc_id", "held_out"])


def known_language(docs: DataFrame, least: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined with a score of at least ``least``."""
    model = learn(training_rows(docs), **bounds)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = predict(plain, model, plain.columns, plain.columns[names.index("text")])
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
