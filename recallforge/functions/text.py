"""Text as columns: slugs, summaries, sentences, words, windows. No Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character, by Unicode; the same pattern holds in Java and RE2.
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Words for windows end at ASCII white space without the vertical tab.
WINDOW_WORD = r"[^ \t\n\f\r]+"
WINDOW_WORDS, OVERLAP_WORDS = 80, 20
SENTENCE_WORDS = (8, 40)
#: A part of a word within a segment; characters of ASCII are told first, which is quicker. Nothing here goes back.
_PART = rf"(?:[!-~&&[^.!?]]++|{SPACE.replace('[', '[^.!?', 1)}++)++"
#: A segment, in the first group if its words are as many as SENTENCE_WORDS allows: all but the last of them with the space that
#: follows, then the last with the mark, the last before the end of the text, or the mark as a word of its own.
_SENTENCE = rf"{SPACE}*+((?:{_PART}{SPACE}++(?!\z)){{{SENTENCE_WORDS[0] - 1},{SENTENCE_WORDS[1] - 1}}}+(?:{_PART}(?:[.!?]|(?={SPACE}*+\z))|[.!?]))|[^.!?]*+[.!?]|[^.!?]++"
SLUG_CHARS, SUMMARY_CHARS, SNIPPET_CHARS = 40, 60, 120
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def trim_all(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def one_line(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def shortened(text: Column, chars: int) -> Column:
    line = one_line(text)
    return let(line, lambda x: F.when(F.length(x) > chars, F.concat(F.substring(x, 1, chars), F.lit("…"))).otherwise(x))


def summarize(text: Column) -> Column:
    return shortened(text, SUMMARY_CHARS)


def snippet(text: Column) -> Column:
    return shortened(text, SNIPPET_CHARS)


def slugify(text: Column) -> Column:
    """Kebab-cased first characters and six digits of the content hash; equal contents, equal slugs."""
    dashed = F.regexp_replace(F.substring(text, 1, SLUG_CHARS), r"[^\p{L}\p{N}]+", "-")
    stem = F.translate(F.regexp_replace(dashed, "^-|-$", ""), _UPPER, _LOWER)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("memory")), F.lit("-"), F.substring(F.sha2(text, 256), 1, 6))


def strip_frontmatter(text: Column) -> Column:
    """What follows a leading block between lines of three dashes; the closing line is looked for after the opening one."""
    return F.regexp_replace(text, rf"(?s)\A---\n.*?\n---\n{SPACE}*", "")


def sentences(text: Column) -> Column:
    """Segments ended by . ! or ?, trimmed, that have a sensible number of words; one pass of one expression over the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(_SENTENCE), F.lit(1)), lambda s: s != "")


def dedup_key(sentence: Column) -> Column:
    """Lower case, letters, digits and white space only."""
    return trim_all(F.regexp_replace(F.lower(sentence), SPACE.replace("[", r"[^\p{L}\p{N}", 1), ""))


def distinct_sentences(found: Column) -> Column:
    """First occurrence by key, in order; an empty key drops the sentence. One pass over a set of keys held as a map."""
    keyed = F.transform(found, lambda s, i: F.struct(dedup_key(s).alias("k"), i.alias("i"), s.alias("s")))
    some = F.filter(keyed, lambda x: x["k"] != "")
    # Sorted by key, then place: the first of each run is the first occurrence.
    firsts = let(F.sort_array(some), lambda o: F.filter(o, lambda x, j: (j == 0) | (F.get(o, j - 1)["k"] != x["k"])))
    return F.transform(F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])


def window_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WINDOW_WORD), F.lit(0))


def windows(text: Column, words: int = WINDOW_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Overlapping windows as structs (offset, end_offset, text), offsets in bytes.

    No word, no window; at most ``words`` words, the whole text from 0. Byte offsets are sums over strides of the
    text, so no shuffle and no per-word sum is needed.
    """
    stride = max(1, words - overlap)
    tiles = F.regexp_extract_all(text, F.lit(rf"[ \t\n\f\r]*{WINDOW_WORD}"), F.lit(0))

    def of(t: Column) -> Column:
        n = F.size(t)
        last = F.ceil((n - words) / stride).cast("int")
        numbers = F.sequence(F.lit(0), last)
        joined = lambda i, k: F.array_join(F.slice(t, i * stride + 1, k), "")
        lengths = F.transform(numbers, lambda i: F.octet_length(joined(i, F.lit(stride))))
        lead = lambda i: F.octet_length(F.regexp_extract(F.element_at(t, i * stride + 1), r"^[ \t\n\f\r]*", 0))

        def with_lengths(sizes: Column) -> Column:
            def window(i: Column) -> Column:
                body = F.rtrim(F.ltrim(joined(i, F.lit(words)), F.lit(" \t\n\f\r")), F.lit(SPACES))
                start = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x) + lead(i)
                return let(body, lambda b: F.struct(start.cast("long").alias("offset"), (start + F.octet_length(b)).cast("long").alias("end_offset"), b.alias("text")))

            return F.transform(numbers, window)

        whole = F.array(F.struct(F.lit(0).cast("long").alias("offset"), F.octet_length(text).cast("long").alias("end_offset"), text.alias("text")))
        return F.when(n == 0, F.filter(whole, lambda _: F.lit(False))).when(n <= words, whole).otherwise(let(lengths, with_lengths))

    return let(tiles, of)


def remote_slug(url: Column) -> Column:
    """The last two segments of a remote's URL, joined by a dash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"(?:\.git)+$", ""), "/+$", "")
    parts = F.split(bare, "[/:]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "-")


def is_contained(a: Column, b: Column) -> Column:
    """Equal, or one within the other, after trimming; never if one is empty."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (a.contains(b) | b.contains(a))
