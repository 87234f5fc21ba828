"""Language identification by rank-order profiles (operator 10).

A profile is the list of the most frequent letter n-grams (n = 1, 2, 3, words padded by one
space) of a language, in order of frequency.  A document's own list is compared with each
profile by the out-of-place distance: for each of its n-grams the difference of the ranks, or
the greatest possible one where the profile lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_batches
from .words import slices, texts

#: Length of a profile, and documents of each language that its profile is learned from at most.
PROFILE, SAMPLE = 400, 2000
_BITS = 21
_letters: np.ndarray | None = None


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; each run of anything else is one 0."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    c = np.where((c < len(_letters)) & _letters[np.minimum(c, len(_letters) - 1)], c, 0)
    c = np.concatenate([[0], c, [0]])
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def ngrams(codes: np.ndarray) -> np.ndarray:
    """The 1-, 2- and 3-grams, as integers; a space stands only at either end of an n-gram."""
    one = codes[codes != 0]
    if not len(one):
        return one
    two = codes[:-1] << _BITS | codes[1:]
    three = (codes[:-2] << 2 * _BITS | codes[1:-1] << _BITS | codes[2:])[codes[1:-1] != 0]
    return np.concatenate([one, two, three])


def ranked(text: str, top: int = PROFILE) -> np.ndarray:
    """A text's most frequent n-grams, most frequent first, ties by value."""
    grams, counts = np.unique(ngrams(letter_codes(text)), return_counts=True)
    if len(grams) > top:
        keep = np.flatnonzero(counts >= np.partition(counts, len(counts) - top)[len(counts) - top])
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """The profiles of all languages; ``rank[i, l]`` of ``grams[i]`` in language l, PROFILE if absent."""

    def __init__(self, lists: dict[str, list[int]], top: int = PROFILE):
        self.top, self.langs = top, sorted(lists)
        self.grams = np.unique(np.concatenate([np.array(v, np.int64) for v in lists.values()])) if lists else np.empty(0, np.int64)
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), top, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.grams, lists[lang]), k] = np.arange(len(lists[lang]))

    def nearest(self, text: str) -> tuple[str, float]:
        grams = ranked(text, self.top)
        if not len(grams) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        rank = self.rank[np.where(self.grams[at] == grams, at, len(self.grams))]
        out = np.where(rank == self.top, self.top, np.abs(rank - np.arange(len(grams))[:, None])).sum(axis=0)
        k = int(out.argmin())
        return self.langs[k], 1.0 - float(out[k]) / (self.top * len(grams))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch)):
            by_lang.setdefault(lang, []).append(text.decode("utf-8", "replace"))
        for lang, held in by_lang.items():
            grams, counts = np.unique(np.concatenate([ngrams(letter_codes(t)) for t in held]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "n"])


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text leaves no remainder modulo 5; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn_profiles(documents: DataFrame, top: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles from the rows with a language that are not held out: of each language those whose hash is
    below the share that ``sample`` rows are of all its rows, so about ``sample`` of them, in any number of tasks.

    Rows without a doc_id share one hash: they are learned from all or none.
    """
    rows = documents.where(~held_out() & F.col("lang").isNotNull())
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    # one row per language
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    few = rows.join(F.broadcast(share), "lang").where(low).select("lang", "text")
    counts = few.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the most frequent of a language are first found in parts of its n-grams
    for part in (["lang", F.pmod("gram", F.lit(32))], ["lang"]):
        best = Window.partitionBy(*part).orderBy(F.desc("n"), "gram")
        counts = counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= top)
    lists: dict[str, list[int]] = {}
    # languages times ``top`` rows
    for r in counts.orderBy("lang", "k").collect():
        lists.setdefault(r.lang, []).append(r.gram)
    return Profiles(lists, top)


def _predict(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [profiles.value.nearest(t.decode("utf-8", "replace")) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify_language(documents: DataFrame, top: int = PROFILE, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``documents(doc_id, text, lang)``.

    Profiles are learned from text and non-null lang of the rows that are not held out (about
    ``sample`` per language); the prediction uses the whole text only.  ``und`` with score 0 for a
    null text, a text without a letter, or where no language was learned.  Equal distances: the
    language first in the alphabet.  score is 1 minus the distance over its greatest value.
    Null doc_ids are not held out; repeated rows all come back; other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    profiles = spark.sparkContext.broadcast(learn_profiles(docs, top, sample))
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        _predict(profiles), "doc_id long, held_out boolean, lang_pred string, score double"
    )
