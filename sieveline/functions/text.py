"""Text columns: white space as Python and JavaScript know it, tokens, normal forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOTH = [*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: White space as Python strips and splits by: curation, deduplication, files. With the separators U+001C to U+001F and U+0085.
PYTHON_SPACES = "".join(map(chr, sorted([*_BOTH, *range(0x1C, 0x20), 0x85])))
#: White space as JavaScript has it: messages that are scored, recognised text, word pieces. With the byte-order mark.
SCRIPT_SPACES = "".join(map(chr, [*_BOTH, 0xFEFF]))
#: The same as a class for regular expressions, whose own \s is ASCII.
SCRIPT_SPACE = r"[\t-\r\x20\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Letters that look Latin, and the letters they stand for.
LOOKALIKES = "аеорсухѕіјԁһԝʏαορτν"
LATIN = "aeopcyxsijdhwyaoptv"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
#: A word boundary between ASCII word characters, as JavaScript has it; Java's \b knows all letters.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same before and after a match that starts and ends with a word character.
BEFORE_WORD, AFTER_WORD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def strip(c: Column, spaces: str = PYTHON_SPACES) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(spaces))


def tokens(c: Column, spaces: str = PYTHON_SPACES) -> Column:
    """The words between white space."""
    return F.array_remove(F.split(F.translate(c, spaces, " " * len(spaces)), " "), "")


def n_tokens(c: Column) -> Column:
    return F.size(tokens(c))


def _compose(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc():
    """Unicode's composed form, which Spark has no function for."""
    return F.arrow_udf(_compose, "string")


def is_ascii(c: Column) -> Column:
    """Whether a text is of ASCII characters alone: as many bytes as characters."""
    return F.octet_length(c) == F.char_length(c)


def normalized(c: Column, compose: bool = True) -> Column:
    """For scoring: lower case, NFC (unless the text is known to be composed), look-alike letters as Latin, no zero-width characters, single spaces.

    Composing and look-alikes change no ASCII text, and replacing white space none where it is single spaces: such texts
    are passed through, composing gets nulls for them.
    """
    low = F.lower(c)
    other = F.when(~is_ascii(low), low)
    latin = F.coalesce(F.translate(nfc()(other) if compose else other, LOOKALIKES + ZERO_WIDTH, LATIN), low)
    gaps = [F.contains(low, F.lit(gap)) for gap in ("  ", *"\t\n\x0b\x0c\r")]
    uneven = F.when(is_ascii(low), reduce(or_, gaps)).otherwise(latin.rlike(f"(?! ){SCRIPT_SPACE}|  "))
    single = F.when(uneven, F.regexp_replace(latin, f"{SCRIPT_SPACE}+", " ")).otherwise(latin)
    return strip(single, SCRIPT_SPACES)


def has_homoglyphs(c: Column) -> Column:
    """Cyrillic or Greek beside Latin letters, or zero-width characters, in the raw text."""
    foreign = c.rlike(r"[\u0400-\u04ff\u0370-\u03ff]")
    return F.when(is_ascii(c), False).otherwise((foreign & c.rlike("[a-zA-Z]")) | c.rlike(r"[\u200b\u200c\u200d\ufeff]"))


def ocr_normalized(c: Column) -> Column:
    """For recognised text: single spaces, no NUL, en and em dashes as hyphens, trimmed."""
    return strip(F.regexp_replace(F.translate(F.regexp_replace(c, f"{SCRIPT_SPACE}+", " "), "–—\0", "--"), "\0", ""), SCRIPT_SPACES)


def preview(c: Column, n: int = 80) -> Column:
    return F.translate(F.substring(c, 1, n), "\n", " ")


def fence_stripped(c: Column) -> Column:
    """JSON text without the code fence around it."""
    return strip(F.regexp_replace(c, r"```(?:json)?", ""))


def fenced_json(c: Column, schema: str) -> Column:
    """The value of JSON text, with a code fence around it or not; null where it can't be read."""
    return F.from_json(fence_stripped(c), schema)


#: Each ASCII punctuation mark is a word of its own.
WORD_MARKS = ".,!?;:'\"()[]{}<>@#$%^&*+=-_/\\|`~"
_MARK = re.sub(r"[\[\]\\^-]", r"\\\g<0>", WORD_MARKS)
_WORD = f"[{_MARK}]|[^{_MARK}{SCRIPT_SPACE[1:-1]}]+"


def word_split(c: Column) -> Column:
    """Words between white space, with each ASCII punctuation mark a token of its own."""
    return F.regexp_extract_all(c, F.lit(f"({_WORD})"), F.lit(1))


# The same within Arrow batches, for texts in lower case. Java tests each character against a dozen predicates, and where
# words are exploded Spark splits a text once more for each condition that it infers (an array, not empty).
_FIND_WORDS = re.compile(_WORD).findall
_WIDE_SPACES = "".join(c for c in SCRIPT_SPACES if c > "\x7f")
_PLAIN = dict.fromkeys(map(ord, _WIDE_SPACES), " ") | dict(zip(map(ord, LOOKALIKES), LATIN)) | dict.fromkeys(map(ord, ZERO_WIDTH))
_NOT_PLAIN = re.compile(f"[{LOOKALIKES}{ZERO_WIDTH}{_WIDE_SPACES}]")
_MARK_BYTES = WORD_MARKS.encode()
_NO_MARKS = bytes.maketrans(_MARK_BYTES, b" " * len(_MARK_BYTES))


def _plain(low: str) -> str:
    """What `normalized` gives of a text in lower case, but for its white space: that is ASCII's, as long and where it was."""
    if low.isascii():
        return low
    low = unicodedata.normalize("NFC", low)
    return low.translate(_PLAIN) if _NOT_PLAIN.search(low) else low


def words_by_part(low: str, chars: int) -> Iterator[list[str]]:
    """The words of the normal form of a text in lower case, of about so many characters at a time.

    Parts start at white space, which no word and no composed character goes on over.
    """
    at, gap = 0, re.compile(r"[\t-\r ]")
    while at < len(low):
        found = gap.search(low, at + chars)
        end = found.start() if found else len(low)
        yield _FIND_WORDS(_plain(low[at:end]))
        at = end


def _distinct_words(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(w): the words of texts in lower case, each once a batch; a worker remembers those of earlier batches, up to `most`.

    Words are told apart as bytes, between marks made spaces.
    """
    seen: set[bytes] = set()
    marks = [bytes([m]) for m in _MARK_BYTES]
    for batch in batches:
        words: set[bytes] = set()
        for text in batch.column(0):
            if (t := text.as_py()) is None:
                continue
            raw = _plain(t).encode()
            found = [m for m in marks if m in raw]
            marks = [m for m in marks if m not in found] if found else marks
            words.update(found, raw.translate(_NO_MARKS).split())
        words -= seen
        if len(seen) + len(words) > most:
            seen = set()
        if len(words) <= most:
            seen.update(w for w in words if len(w) <= 64)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()).cast(pa.string())], ["w"])


def distinct_words(texts: DataFrame, text: str) -> DataFrame:
    """(w) of a column of texts: the distinct words of their normal forms, as `word_split` has them."""
    return texts.select(F.lower(text)).mapInArrow(_distinct_words, "w string").distinct()
