"""Operator 13: how the tokens of two tokenizers lie over the same text.

Per batch of documents, laid end to end, every token start of either side finds the other side's token that
covers it (``pandas.merge_asof`` by place, which names the document too); both directions together are all
overlaps.  Places where tokens of both sides end cut the tokens into groups.  How many documents of the corpus
link two ids is counted by pair; batches then fetch the counts of their own pairs and sum them per document.

Nulls: null and empty texts have no tokens, and neither have texts that one of the sides does not give
back byte by byte: zeros and an empty groups_sha256.  A null doc_id stays null.  Every row is a document
of its own, repeated rows too, and counts as one for the pairs.  Empty tables give no rows.  Of the table
only doc_id and text are read, so further columns clash with nothing.  Long texts are worked on whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import Remembered, by_size, cut, open_ended
from .prefix_counts import check_byte_level, default_tokenizer
from .staging import small_batches, stage

#: Bytes of texts of a batch, whose distinct pairs are counted and looked up together.
AT_ONCE = 1 << 20
#: A batch's row is some MB: else a writer looks at its size after 100 rows, and a reader takes 4096 at once, but no more than a row group has.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}
#: Chunks that are encoded in a row.
IN_ROW = 256
SPACE_MARK = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class TwoTokenizers:
    """Tokens of both sides for chunks with a space in front, in a worker process."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import sentencepiece
        from tokenizers import Tokenizer

        check_byte_level(path_a)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # byte-level names have one character a byte
        sizes = {i: len(name) for name, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.size_a = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], np.int64)
        self.bytes_b = [self._bytes(i) for i in range(self.b.get_piece_size())]
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        if any(SPACE_MARK in self.b.id_to_piece(i).lstrip(SPACE_MARK) for i in range(self.b.get_piece_size())):
            raise ValueError(f"{path_b} has pieces across spaces")
        self.chunks = Remembered(self._chunks)
        # decimal ids with what can stand behind them: another id of the side, the other side, the next group, the end
        self.text = [f"{i}{mark}" for i in range(max(len(self.size_a), len(self.size_b))) for mark in (",", "|", ";", "")]

    def _bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def _chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of both sides, or None where side B does not give the bytes of the chunk back.

        Chunks are encoded in rows, which are cut where both sides have an end; one with white space at an
        end, and those of a row that is not given back, are encoded alone.
        """
        out: list = [None] * len(chunks)
        open_ = [k for k, c in enumerate(chunks) if open_ended(c)]
        inner = range(len(chunks))
        if open_:
            away = set(open_)
            inner = [k for k in inner if k not in away]
        rows = [inner[i : i + IN_ROW] for i in range(0, len(inner), IN_ROW)] + [[k] for k in open_]
        while rows:
            texts = [" ".join(map(chunks.__getitem__, row)) for row in rows]
            a, b = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1)
            again = []
            for row, text, x, y in zip(rows, texts, a, b):
                given = b"".join(map(self.bytes_b.__getitem__, y))
                x, y = np.array(x.ids, "<u4"), np.array(y, "<u4")
                if given != (" " + text).encode():
                    again += [[k] for k in row] if len(row) > 1 else []
                    continue
                spaces = np.flatnonzero(np.frombuffer(given, np.uint8) == 32)  # in front of each chunk, and within some
                ends = np.append(spaces[1:], len(given)) if len(spaces) == len(row) else np.cumsum([len(chunks[k].encode()) + 1 for k in row])
                cuts = [[0, *(4 * np.searchsorted(np.cumsum(sizes[ids]), ends) + 4).tolist()] for ids, sizes in ((x, self.size_a), (y, self.size_b))]
                x, y = x.tobytes(), y.tobytes()
                for k, p, q, r, s in zip(row, cuts[0], cuts[0][1:], cuts[1], cuts[1][1:]):
                    out[k] = x[p:q], y[r:s]
            rows = again
        return out

    def tokens(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Per text the ids of both sides, None for a text without tokens."""
        cuts = [cut(t) if t else [] for t in texts]
        out = []
        for parts in self.chunks.of(cuts):
            out.append((b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])) if parts and None not in parts else None)
        return out


_loaded: dict[tuple[str, str], TwoTokenizers] = {}


def two_tokenizers(path_a: str, path_b: str) -> TwoTokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = TwoTokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def _frame(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """The tokens of all documents in a row: doc, id, and where in the row of all bytes they begin and end."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    end = np.cumsum(sizes[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), list(map(len, ids))), "id": flat, "at": end - sizes[flat], "end": end, "token": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of all pairs whose bytes overlap, by token of A, then of B."""
    keys = ["at", "token"]
    # documents lie end to end and both sides of one have the same bytes, so a place names its document as well
    one = pd.merge_asof(a[keys], b[keys], on="at", suffixes=("_a", "_b"))
    two = pd.merge_asof(b[keys], a[keys].assign(start=a["at"]), on="at", suffixes=("_b", "_a"))
    two = two[two["at"] != two["start"]]  # those with a common start are in the other list
    x, y = (np.concatenate([one[c].to_numpy(np.int64), two[c].to_numpy(np.int64)]) for c in ("token_a", "token_b"))
    order = np.argsort(x, kind="stable")  # two sorted lists; a token's first in B is from the first of them
    return x[order], y[order]


def _groups(a: pd.DataFrame, b: pd.DataFrame, n: int, text: list[str]) -> tuple[np.ndarray, list[str]]:
    """Per document the number of groups, and the digest of its groups' ids."""
    (end_a, doc_a, id_a), (end_b, doc_b, id_b) = ([f[c].to_numpy() for c in ("end", "doc", "id")] for f in (a, b))
    if not len(end_a):
        return np.zeros(n, np.int64), [""] * n
    # where both sides have an end; documents lie end to end, so the last token of one has such an end
    place = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
    last_a = end_b[place] == end_a
    last_b = np.zeros(len(end_b), bool)
    last_b[place[last_a]] = True
    group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
    # a group's tokens of A stand behind those of B of all groups before, and its tokens of B behind its own of A
    upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    ids = np.empty(len(end_a) + len(end_b), np.int64)
    ids[np.arange(len(end_a)) + np.append(0, upto_b)[group_a]] = 4 * id_a + last_a
    ids[np.arange(len(end_b)) + upto_a[group_b]] = 4 * id_b + np.where(last_b, np.where(np.append(doc_b[1:] != doc_b[:-1], True), 3, 2), 0)
    words = list(map(text.__getitem__, ids.tolist()))
    cuts = np.append(0, np.cumsum(np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n))).tolist()
    digests = [hashlib.sha256("".join(words[p:q]).encode()).hexdigest() if q > p else "" for p, q in zip(cuts, cuts[1:])]
    return np.bincount(doc_a[last_a], minlength=n), digests


_STAGED = (
    "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "links binary, pair array<long>, docs array<long>"
)
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_batches(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per batch of documents: their figures, each link as the place of its pair in ``pair``, and in how
    many documents of the batch each pair is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, schema, batch_id = two_tokenizers(path_a, path_b), None, TaskContext.get().partitionId() << 32
        for batch in by_size(batches, AT_ONCE):
            tokens, n = both.tokens(batch.column(1).to_pylist()), batch.num_rows
            a, b = (_frame([np.frombuffer(t[k], "<u4").astype(np.int64) if t else np.empty(0, np.int64) for t in tokens], sizes) for k, sizes in ((0, both.size_a), (1, both.size_b)))
            x, y = overlaps(a, b)
            doc = a["doc"].to_numpy()[x]
            pair, place = np.unique(a["id"].to_numpy()[x] << 32 | b["id"].to_numpy()[y], return_inverse=True)
            held = np.sort(doc * max(len(pair), 1) + place)
            held = held[np.append(True, held[1:] != held[:-1])[: len(held)]] % max(len(pair), 1)
            groups, digests = _groups(a, b, n, both.text)
            columns = [
                batch.column(0).to_pylist(), np.bincount(a["doc"], minlength=n), np.bincount(b["doc"], minlength=n), groups, np.bincount(doc, minlength=n), digests,
                None, pair, np.bincount(held, minlength=len(pair)),
            ]
            arrays = [pa.array([batch_id], pa.int64())]
            for k, c in enumerate(columns):
                kind = pa.string() if k == 5 else pa.int64()
                arrays.append(pa.array([place.astype("<u4").tobytes()], pa.binary()) if c is None else pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, kind)))
            schema = ["batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pair", "docs"]
            yield pa.RecordBatch.from_arrays(arrays, schema)
            batch_id += 1

    return docs.mapInArrow(work, _STAGED)


def pair_counts(batches: DataFrame) -> DataFrame:
    """Per pair of ids: in how many documents it is linked, and whether no pair of the same A id is in more."""
    pairs = batches.select(F.explode(F.arrays_zip("pair", "docs")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # at most one row per id of B
    return pairs.select("pair", "n", (F.col("n") == most).alias("best"))


def _summed(batch: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one batch, with the counts of its pairs."""
    row = batch.to_pylist()[0] if batch.num_rows else None
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _RESULT.split(", ")]
    if row is None:
        return pa.table([pa.array([], k) for k in kinds], names)
    at = counts.column("pos").to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    links = np.frombuffer(row["links"], "<u4")
    ends = np.cumsum(row["n_links"])
    total = [np.diff(np.append(0, np.append(0, np.cumsum(v[links]))[ends])) if len(ends) else ends for v in (best, n)]
    columns = [row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *total, row["groups_sha256"]]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b (tokens), n_groups, n_links (overlapping tokens), n_best (links whose pair of
    ids no other pair of the A id exceeds in documents), count_sum (documents of the pairs of all links), groups_sha256.

    ``path_a`` is a byte-level BPE over a space and the text, ``path_b`` a sentencepiece model that puts the space
    in front itself.  The tokens are made once and staged; shuffled are the distinct pairs of every batch.
    """
    a, b = path_a or default_tokenizer(), path_b or default_pieces()
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    batches = stage(align_batches(docs, a, b), "alignment", SMALL_GROUPS)
    asked = batches.select("batch", F.posexplode("pair").alias("pos", "pair"))
    known = asked.join(pair_counts(batches), "pair").select(F.col("batch").alias("of"), "pos", "n", "best")
    held = batches.select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    return held.groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(_summed, _RESULT)
