"""Fast exact byte-level BPE: ids of a text gathered from the cached ids of its space-led parts.

The pattern of byte-level BPE cuts a text before every single space that stands between two non-space characters: no
token crosses such a place. So a text without white space beside a space is the sum of its parts. Arrow's compiled
functions split a batch and tell its parts apart; each distinct part is encoded once per worker, a word and the
punctuation after it apart, since the pattern cuts there too.

What could be cut otherwise is left to the tokenizer as it is: what lies between two sure cuts around other white space, a
text with an added token, and every text if the vocabulary file is not of this kind.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import kept, ranges

#: At so many distinct parts all but the first so many are forgotten; one takes about 50 bytes.
_CACHE_PARTS, _KEPT_PARTS = 200_000, 100_000
#: So many distinct parts are encoded as one text.
_RUN = 512
#: Single spaces between characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Punctuation that can follow a word in its part.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters from U+0530 on may be no letters to another version of Unicode.
_UNSURE = r"[^\x00-\x{52f}]"


def _rough(part: str) -> bool:
    """Whether white space stands at an end of the part, or a space inside it."""
    return not part or part[0].isspace() or part[-1].isspace() or " " in part


class Encoder:
    """ids of texts, little-endian and unsigned, of 4 or of 2 bytes an id; the vocabulary file is a parameter, never
    copied."""

    def __init__(self, path: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        first, model = told["pre_tokenizer"] or {}, told["model"]
        self.added = [t["content"] for t in told["added_tokens"]]
        #: Whether texts can be cut as this module does.
        self.cuts = (
            (first.get("type"), first.get("use_regex", True), first.get("add_prefix_space")) == ("ByteLevel", True, False)
            and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and not any(told[x] for x in ("normalizer", "truncation", "padding"))
            and not any(t["lstrip"] or t["rstrip"] for t in told["added_tokens"])
        )
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Whether the token with this id begins with the byte 0x20, which byte-level BPE writes as U+0120.
        self.led = np.zeros(max(vocabulary.values()) + 1, bool)
        self.led[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.width = width if len(self.led) <= 1 << (8 * width) else 4
        self.kind = np.dtype(f"<u{self.width}")
        #: What follows a space; by place, where the ids of the space and this start in the pool, how many they are (none
        #: for a rough part), and whether it is rough.
        self.parts = pa.array([], pa.string())
        self.starts, self.lengths, self.rough = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        self.pool = np.empty(0, self.kind)

    @classmethod
    def of(cls, path: str, width: int = 4) -> "Encoder":
        """The worker's encoder with ids of ``width`` bytes, or of 4 if the vocabulary needs them."""
        return kept((cls, path, width), lambda: cls(path, width))

    def forget(self, kept: int = _KEPT_PARTS) -> None:
        """Keeps the parts that were learned first, frequent ones by nature."""
        if len(self.parts) > kept:
            self.parts = pa.concat_arrays([self.parts[:kept]])
            self.starts, self.lengths, self.rough = (x[:kept].copy() for x in (self.starts, self.lengths, self.rough))
            self.pool = self.pool[: int(self.starts[-1] + self.lengths[-1])].copy()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of ``parts``, each led by a space, and how many each has: those of _RUN parts that follow one another in a
        text are cut again where a token begins with the space."""
        ids, counts = [self.pool[:0]], [np.empty(0, np.int64)]
        firsts = np.append(np.arange(0, len(parts), _RUN), len(parts)).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(firsts), parts), " ").to_pylist()
        for found, a, b in zip(self._whole([" " + t for t in texts]), firsts, firsts[1:]):
            at = np.flatnonzero(self.led[found])
            if len(at) == b - a:
                ids.append(found)
                counts.append(np.diff(at, append=len(found)))
            else:
                each = self._whole([" " + p for p in parts[a:b].to_pylist()])
                ids += each
                counts.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, parts: pa.Array) -> None:
        trimmed = pc.utf8_rtrim(parts, _TAIL)
        sure = pc.and_(pc.utf8_is_alpha(trimmed), pc.invert(pc.match_substring_regex(trimmed, _UNSURE)))
        words = pc.if_else(sure, trimmed, parts).dictionary_encode()
        lengths = pc.binary_length(trimmed).to_numpy()
        tailed = np.flatnonzero(sure.to_numpy(zero_copy_only=False) & (lengths < pc.binary_length(parts).to_numpy()))
        tails = [p[len(w) :] for p, w in zip(*(x.take(pa.array(tailed)).to_pylist() for x in (parts, trimmed)))]
        distinct = words.dictionary
        rough = np.zeros(len(distinct), bool)
        other = np.flatnonzero(pc.invert(pc.utf8_is_alpha(distinct)).to_numpy(zero_copy_only=False))
        rough[other] = [_rough(w) for w in distinct.take(pa.array(other)).to_pylist()]
        found, of_word = self._runs(distinct.filter(pa.array(~rough)) if rough.any() else distinct)
        of_tail = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        tail_ids = self._whole(list(of_tail))
        # Words (rough ones have no ids), no tail, tails: where the ids of each are.
        counts = np.zeros(len(distinct) + 1 + len(of_tail), np.int64)
        counts[: len(distinct)][~rough] = of_word
        counts[len(distinct) + 1 :] = [len(x) for x in tail_ids]
        ids = np.concatenate([found, *tail_ids])
        starts = np.cumsum(counts) - counts
        place = np.full((len(parts), 2), len(distinct), np.int64)
        place[:, 0] = words.indices.to_numpy()
        place[tailed, 1] += np.array([1 + of_tail[t] for t in tails], np.int64)
        place = place.ravel()
        self.pool = np.concatenate([self.pool, ids[ranges(starts[place], counts[place])]])
        self.lengths = np.concatenate([self.lengths, counts[place[::2]] + counts[place[1::2]]])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.rough = np.concatenate([self.rough, rough[place[::2]]])
        self.parts = pa.concat_arrays([self.parts, parts])

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The places of ``parts``, learned where new."""
        coded = parts.dictionary_encode()
        at = pc.index_in(coded.dictionary, self.parts)
        if at.null_count:
            new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[new] = len(self.parts) + np.arange(len(new))
            self._learn(coded.dictionary.take(pa.array(new)))
        else:
            at = at.to_numpy(zero_copy_only=False).astype(np.int64)
        return at[coded.indices.to_numpy()]

    def _gathered(self, firsts: list[str], parts: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids, text after text, of each text's first part and then its numbered parts, and how many each text has."""
        led = self._whole(firsts)
        sizes = np.array([len(x) for x in led])
        places = np.cumsum(per_text) - per_text
        starts, lengths = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        rest = np.ones(len(parts), bool)
        rest[places] = False
        starts[rest], lengths[rest] = self.starts[parts[rest]], self.lengths[parts[rest]]
        starts[places], lengths[places] = len(self.pool) + np.cumsum(sizes) - sizes, sizes
        return np.concatenate([self.pool, *led])[ranges(starts, lengths)], np.add.reduceat(lengths, places)

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        """ids of texts with white space beside a space: cut where that is sure."""
        cut = [_CUT.split(t) for t in texts]
        smooth = list({p for parts in cut for p in parts[1:] if not _rough(p)})
        of = dict(zip(smooth, self._numbers(pa.array(smooth, pa.string())).tolist()))
        out = []
        for parts, first in zip(cut, self._whole([p[0] for p in cut])):
            own = [first]
            for p in parts[1:]:
                n = of.get(p)
                own.append(self._whole([" " + p])[0] if n is None else self.pool[self.starts[n] : self.starts[n] + self.lengths[n]])
            out.append(np.concatenate(own))
        return out

    def encode(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, each followed by ``end_id`` if there is one, and where those of each text end."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        n = len(column)
        if len(self.parts) > _CACHE_PARTS:  # here only: numbers of parts hold until the end
            self.forget()
        whole = np.full(n, not self.cuts)
        for content in self.added:
            whole |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # texts, their ids, how many each has
        if (at := np.flatnonzero(~whole)).size:
            lists = pc.split_pattern(column.take(pa.array(at)), " ")
            per_text = pc.list_value_length(lists).to_numpy().astype(np.int64)
            places = np.cumsum(per_text) - per_text
            firsts = lists.flatten().take(pa.array(places)).to_pylist()
            parts = self._numbers(lists.flatten())
            rough = self.rough[parts]
            rough[places] = [len_ > 1 and (not p or p[-1].isspace()) for p, len_ in zip(firsts, per_text)]
            odd = np.add.reduceat(rough, places) > 0
            if odd.any():
                found = self._split(column.take(pa.array(at[odd])).to_pylist())
                groups.append((at[odd], np.concatenate(found), np.array([len(x) for x in found])))
                parts, firsts = parts[np.repeat(~odd, per_text)], [p for p, o in zip(firsts, odd) if not o]
                at, per_text = at[~odd], per_text[~odd]
            if len(at):
                groups.append((at, *self._gathered(firsts, parts, per_text)))
        if (at := np.flatnonzero(whole)).size:
            found = self._whole(column.take(pa.array(at)).to_pylist())
            groups.append((at, np.concatenate(found), np.array([len(x) for x in found])))
        lengths = np.zeros(n, np.int64)
        for at, _, counts in groups:
            lengths[at] = counts
        after = 0 if end_id is None else 1
        ends = np.cumsum(lengths + after)
        out = np.full(int(ends[-1]) if n else 0, end_id or 0, self.kind)
        for at, ids, counts in groups:
            out[ranges(ends[at] - after - counts, counts)] = ids
        return out, ends


def default_tokenizer() -> str:
    """The public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
