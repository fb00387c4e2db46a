"""Byte-level BPE without merging: the last token of every prefix, and decoding.

A merge list fixes one token that ends each prefix of a text: the one token that matches there and may follow the last
token of the prefix before it. An automaton of all tokens lists the matches that end at a byte, and two tokens may follow
each other if no merge crosses the place between them before either of them is made; that is told by undoing their own
merges, latest first. Back pointers from the end give the ids. Work is linear in a part's bytes, whatever merges it has.

``_tokens.Encoder`` cuts texts into parts and remembers the ids of parts; here the ids of a part come from prefixes.

Defined cases: a null text is an empty text, which has no ids; the content of an added token is that token; lone
surrogates cannot occur in a Spark string; ids whose bytes are no UTF-8 decode with U+FFFD as the library does. A file that
is not plain byte-level BPE, or whose merges make one token twice, raises ValueError. Rows that repeat each have a result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._shared import ensure_importable, frugal, portions, ranges
from ._tokens import Encoder

#: So many answers about pairs of tokens are remembered by a worker.
_PAIRS = 1 << 20
#: Stands for the last token of an empty prefix.
_NONE = -1
#: Letters below are letters to every version of Unicode in use.
_SURE = "\u0530"
CODED = "doc_id long, n_tokens long, ids binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The character that byte-level BPE writes for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 0x100 + hidden.index(b)) for b in range(256)]


class Merges:
    """A merge list, asked which token ends each prefix of a part. Parts and tokens are strings of byte characters."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.rank_of_pair: dict[tuple[int, int], int] = {}
        #: By token: its two parts (none for a byte), and the rank of their merge.
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(vocabulary.values(), -1)
        for rank, (a, b) in enumerate(merges):
            made = vocabulary[a + b]
            if made in self.halves:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.halves[made], self.rank[made] = (vocabulary[a], vocabulary[b]), rank
            self.rank_of_pair[vocabulary[a], vocabulary[b]] = rank
        #: How many answers are remembered; each token has those about what it may follow.
        self.known = 0
        self.size = {i: len(token) for token, i in vocabulary.items()}
        #: Tokens that come out when their own bytes are encoded; the others never come out.
        self.whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(vocabulary.items(), key=lambda x: self.rank[x[1]]):
            if i in self.halves:
                a, b = self.halves[i]
                self.whole[i] = self.whole.get(a, False) and self.whole.get(b, False) and self._stay_apart(a, b, self.rank[i])
            else:
                self.whole[i] = len(token) == 1
            if self.whole[i]:
                self.automaton.add_word(token, (i, len(token), {_NONE: True}))
        self.automaton.make_automaton()

    def _stay_apart(self, a: int, b: int, end: int | None = None) -> bool:
        """Whether no merge crosses the place between ``a`` and ``b`` before rank ``end``.

        The neighbours there are traced back in time. Each pair of neighbours ends when one of the two is merged with what
        lies on its other side; of equal ranks the left merge is the earlier one.
        """
        last = (len(self.rank_of_pair) if end is None else end, 0)
        while True:
            rank = self.rank_of_pair.get((a, b))
            if rank is not None and (rank, 0) < last:
                return False
            first, second = self.rank[a], self.rank[b]
            if second >= first:  # of equal ones the right was made later
                if second < 0:
                    return True
                last, b = (second, 1), self.halves[b][0]
            else:
                last, a = (first, 0), self.halves[a][1]

    def _learn(self, follows: dict[int, bool], before: int, token: int) -> bool:
        if self.known >= _PAIRS:
            self.known = 0
            for _, _, other in self.automaton.values():
                other.clear()
                other[_NONE] = True
        self.known += 1
        fits = follows[before] = self._stay_apart(before, token)
        return fits

    def last_tokens(self, part: str) -> list[int]:
        """The last token of each prefix of ``part``, shortest first, and then that of the empty prefix, which has none."""
        last: list[int | None] = [None] * len(part) + [_NONE]
        for end, (token, length, follows) in self.automaton.iter(part):
            if last[end] is None and (before := last[end - length]) is not None:  # [-1] is the empty prefix
                fits = follows.get(before)
                if fits or fits is None and self._learn(follows, before, token):
                    last[end] = token
        return last

    def encode(self, part: str) -> list[int]:
        last, at, ids, size = self.last_tokens(part), len(part) - 1, [], self.size
        while at >= 0:
            if (token := last[at]) is None:
                raise ValueError("a byte has no token in this vocabulary")
            ids.append(token)
            at -= size[token]
        ids.reverse()
        return ids


class PrefixEncoder(Encoder):
    """An Encoder whose ids come from last tokens of prefixes; the library's file and its way to cut parts are all it
    takes from there."""

    def __init__(self, path: str, width: int) -> None:
        super().__init__(path, width)
        if not self.cuts:
            raise ValueError(f"{path} is not plain byte-level BPE")
        told = json.loads(self.tokenizer.to_str())
        model, chars = told["model"], byte_chars()
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.merges = Merges({t: i for t, i in model["vocab"].items() if t not in added}, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]])
        self.added_ids = added
        self.at_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        #: For str.translate: bytes, read as Latin-1, to byte characters.
        self.shown = dict(enumerate(chars))
        of_char = {c: b for b, c in enumerate(chars)}
        data = [b""] * len(self.led)
        for token, i in (model["vocab"] | added).items():
            data[i] = bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
        #: The bytes of all tokens, one after the other, and where those of each id lie.
        self.bytes = np.frombuffer(b"".join(data), np.uint8)
        self.sizes = np.array([len(d) for d in data], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def _runs(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        encode, shown = self.merges.encode, self.shown
        lists = [
            encode((" " + p).encode().decode("latin-1").translate(shown)) if p.isalpha() and max(p) < _SURE else self._plain(" " + p)
            for p in parts.to_pylist()
        ]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), self.kind, int(counts.sum())), counts

    def _plain(self, text: str) -> list[int]:
        encode = self.merges.encode
        return [i for part, _ in self.cut(text) for i in encode(part)] if text else []

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.at_added and any(t in text for t in self.added_ids):
                ids = [i for piece in self.at_added.split(text) for i in ([self.added_ids[piece]] if piece in self.added_ids else self._plain(piece))]
            else:
                ids = self._plain(text)
            out.append(np.array(ids, self.kind))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the text that ``ids`` stand for, special tokens included."""
        raw = self.bytes[ranges(self.firsts[ids], self.sizes[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


def _coded(docs: DataFrame, vocabulary: str, row, schema: str) -> DataFrame:
    ensure_importable(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]):
        encoder = PrefixEncoder.of(vocabulary, 2)
        for batch in portions(batches):
            ids, ends = encoder.encode(batch.column(1))
            starts = np.append(0, ends[:-1]).tolist()
            rows = [row(encoder, ids[a:b]) for a, b in zip(starts, ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x) for x in zip(*rows))], names)

    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(frugal(encode), schema)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each whole text, little-endian and unsigned, of 4 bytes."""
    return _coded(docs, vocabulary, lambda _, ids: (len(ids), ids.astype("<u4").tobytes()), CODED)


def decode_ids(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids) as encode_documents makes them; ValueError for an id that is no token's."""
    ensure_importable(coded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]):
        encoder = PrefixEncoder.of(vocabulary, 2)
        for batch in batches:
            texts = []
            for data in pc.fill_null(batch.column(1), b"").to_pylist():
                ids = np.frombuffer(data, "<u4")
                if len(ids) and ids.max() >= len(encoder.sizes):
                    raise ValueError(f"no token has the id {ids.max()}")
                texts.append(encoder.decode(ids).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(frugal(decode), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes each whole text and decodes its ids in the same task: their number and the sha256 of both."""

    def digests(encoder: PrefixEncoder, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()

    return _coded(docs, vocabulary, digests, DIGESTS)
