"""WordPiece encoding to a fixed length."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .text import SCRIPT_SPACES, distinct_words, words_by_part

# Fixed values of the vocabulary format.
PAD, UNK, CLS, SEP, MASK = ("[PAD]", 0), ("[UNK]", 100), ("[CLS]", 101), ("[SEP]", 102), ("[MASK]", 103)
MARKS = ".,!?:;-_()[]{}\"'/\\@#$%&*+="
MAX_LENGTH = 128


def fallback_vocabulary() -> dict[str, int]:
    """Special tokens, then letters, digits and marks from id 104 on."""
    plain = string.ascii_lowercase + string.digits + MARKS
    return dict((PAD, UNK, CLS, SEP, MASK)) | {c: 104 + k for k, c in enumerate(plain)}


#: Bytes of a vocabulary's file, and tokens of its table: what a worker holds as a trie.
MOST_BYTES, MOST_TOKENS = 32 << 20, 1 << 20


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """token to line number (from 0) of a one-file vocabulary; blank lines take a number and no token.

    A vocabulary is small and its order matters, so it is read as one text, after its size has been checked.
    """
    size = spark.read.format("binaryFile").load(path).select("length").first()["length"]
    if size > MOST_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes; {MOST_BYTES} at most")
    lines = spark.read.text(path, wholetext=True).first()["value"].split("\n")
    return {token: k for k, line in enumerate(lines) if (token := line.strip(SCRIPT_SPACES))}


def vocabulary_of(rows: DataFrame, token: str = "token") -> dict[str, int]:
    """The special tokens, then the distinct tokens of a table, by code points, from id 104 on; its size is checked before it is read."""
    distinct = rows.select(F.col(token).alias("t")).where("t is not null and t <> ''").distinct()
    distinct = written(distinct, "vocabulary")  # so that it is worked out once, to be counted and read
    if (n := distinct.count()) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of {n} tokens; {MOST_TOKENS} at most")
    special = dict((PAD, UNK, CLS, SEP, MASK))
    return special | {t: 104 + k for k, t in enumerate(sorted({r.t for r in distinct.collect()} - special.keys()))}


def _count_pieces(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(token, n): how many of the words have a piece. A worker leaves what it has counted when that is over `most` pieces."""
    counts: Counter[str] = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    for batch in batches:
        for word in batch.column(0):
            w = word.as_py()
            counts.update({w[:3], w[0], *("##" + w[k : k + 3] for k in range(3, len(w), 3)), *("##" + c for c in w[1:])})
        if len(counts) > most:
            yield counted()
            counts.clear()
    yield counted()


def frequent_pieces(texts: DataFrame, text: str, least: int = 5) -> DataFrame:
    """(token) of a vocabulary by rule: first three characters of words, the threes that follow and single characters, of those that `least` distinct words or more have."""
    pieces = distinct_words(texts, text).mapInArrow(_count_pieces, "token string, n long")
    return pieces.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("token")


class Trie:
    """The pieces of a vocabulary by character. What continues a word stands below the node of `##`, which a match at the start of a word links to."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary
        self.below: list[dict[str, int]] = [{}]
        self.ids = [-1]
        for token, k in vocabulary.items():
            self.ids[self._node(token)] = k
        self.after = self._node("##")

    def _node(self, token: str) -> int:
        at = 0
        for c in token:
            if c not in self.below[at]:
                self.below[at][c] = len(self.below)
                self.below.append({})
                self.ids.append(-1)
            at = self.below[at][c]
        return at

    def encode(self, word: str) -> list[int]:
        """Ids of a word: the longest piece each time, found in one walk down the trie.

        Where nothing fits, one [UNK] stands for the failures in a row and one character is passed over. (The original
        passes over half a character outside the basic plane, which makes no difference: the other half fails as well.)
        """
        if word in self.vocabulary:
            return [self.vocabulary[word]]
        out: list[int] = []
        at, below, ids, unknown = 0, self.below, self.ids, self.vocabulary.get(UNK[0], UNK[1])
        while at < len(word):
            node, found, end = self.after if at else 0, -1, at
            for k in range(at, len(word)):
                node = below[node].get(word[k], -1)
                if node < 0:
                    break
                if ids[node] >= 0:
                    found, end = ids[node], k + 1
            if found < 0:
                if not out or out[-1] != unknown:
                    out.append(unknown)
                end = at + 1
            else:
                out.append(found)
            at = end
        return out


def piece_ids(vocabulary: dict[str, int], most: int):
    """An Arrow function from texts in lower case to arrays of ids, the first `most` of each; a worker builds the trie once and keeps words it has seen.

    A text is read as far as that takes. Spark broadcasts the function with its vocabulary, which is bounded, once it is
    over a megabyte.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, seen = Trie(vocabulary), {}
        for texts in batches:
            ids, ends = [], [0]
            for text in texts:
                own: list[int] = []
                for words in words_by_part(text.as_py() or "", 4 * most):
                    for w in words:
                        if (found := seen.get(w)) is None:
                            found = trie.encode(w)
                            if len(w) <= 64:
                                if len(seen) > 200_000:
                                    seen = {}
                                seen[w] = found
                        own += found
                        if len(own) >= most:
                            break
                    if len(own) >= most:
                        break
                ids += own[:most]
                ends.append(len(ids))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return F.arrow_udf(run, "array<int>")


def encode(df: DataFrame, text: str, vocabulary: dict[str, int], length: int = MAX_LENGTH) -> DataFrame:
    """Adds input_ids and attention_mask (arrays of `length`) and token_count.

    CLS, pieces, SEP; of more than `length` the first length - 1 and SEP; zeros pad. The count is taken after the cut.
    Pieces beyond the first `length` can't be among what is kept.
    """
    own = "ids"
    while own in df.columns:
        own += "_"
    ids = piece_ids(vocabulary, length)(F.lower(text))
    whole = df.withColumn(own, F.concat(F.array(F.lit(CLS[1])), ids, F.array(F.lit(SEP[1]))))
    cut = whole.withColumn(own, F.when(F.size(own) > length, F.concat(F.slice(own, 1, length - 1), F.array(F.lit(SEP[1])))).otherwise(F.col(own)))
    out = cut.withColumn("token_count", F.size(own))
    pad = F.array_repeat(F.lit(0), F.lit(length) - F.col("token_count"))
    out = out.withColumn("input_ids", F.concat(own, pad)).withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), F.col("token_count")), pad))
    return out.drop(own)


def decode(ids: Column, vocabulary: dict[str, int]) -> Column:
    """Tokens of an array of ids, [UNK] where an id is none; for vocabularies small enough to be a literal map."""
    names = F.create_map(*(F.lit(x) for t, k in vocabulary.items() for x in (k, t)))
    return F.transform(ids, lambda k: F.coalesce(F.try_element_at(names, k), F.lit(UNK[0])))
