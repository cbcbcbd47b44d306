"""Token ids of a corpus as files of Simple-8b words, in the order of the documents.

Documents are dealt to files by ranges of their keys. A file holds groups of
whole documents in order; a group is a row: keys, lengths, the words that code
all its ids, the first word of each block of ids, and the escapes. The number of
ids of all earlier files gives every document its place in the corpus.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefops.llm import simple8b
from prefops.llm import text as tx
from prefops.llm.frames import bounded_batches, quoted
from prefops.llm.secrets import local_file, vocabulary_file

#: Ids in a group; a longer document is a group of its own.
GROUP_IDS = 1 << 18
#: Words whose ids a worker remembers.
KNOWN_WORDS = 1_500_000
_U8 = np.dtype("<u8")


@lru_cache(maxsize=1)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def special_strings(path: str) -> list[bytes]:
    return [t.content.encode() for t in tokenizer(path).get_added_tokens_decoder().values()]


class WordIds:
    """Ids of words, found by hash and compared by bytes: some 40 bytes a word.

    The tokenizer sees every different word once, as long as it is remembered.
    """

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        self.path, self.most = path, most
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # of each hash's word and ids
        self.words = np.zeros(0, np.uint8)
        self.ends = np.zeros(1, np.int64)
        self.runs = tx.Runs(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _ids(self, words: list[bytes]) -> tx.Runs:
        return tx.runs_of([e.ids for e in tokenizer(self.path).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)], np.uint32)

    def of(self, data: np.ndarray, found: tx.Distinct) -> tx.Runs:
        """The ids of each different word."""
        at = np.searchsorted(self.hashes, found.hashes)
        known = np.zeros(len(at), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == found.hashes[inside]
        if len(self.hashes) and len(self.hashes) + int((~known).sum()) > self.most:
            self.forget()
            return self.of(data, found)
        new = np.flatnonzero(~known)
        if len(new):
            words = tx.spans_of(data, found.starts[new], found.ends[new])
            fresh = self._ids(words)
            place = np.append(self.place, np.arange(len(new)) + len(self.runs.ends))
            hashes = np.append(self.hashes, found.hashes[new])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.place = hashes[order], place[order]
            self.words = np.append(self.words, np.frombuffer(b"".join(words), np.uint8))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(w) for w in words]))
            self.runs = _together(self.runs, fresh)
            at = np.searchsorted(self.hashes, found.hashes)
        place, runs = self.place[at], self.runs
        # Words that only share a hash with one that is remembered are encoded each time.
        other = np.flatnonzero(~tx.equal_spans(data, found.starts, found.ends, self.words, self.ends[place], self.ends[place + 1]))
        if len(other):
            place[other] = np.arange(len(other)) + len(runs.ends)
            runs = _together(runs, self._ids(tx.spans_of(data, found.starts[other], found.ends[other])))
        return tx.take_runs(runs, place)


def _together(a: tx.Runs, b: tx.Runs) -> tx.Runs:
    return tx.Runs(np.append(a.values, b.values), np.append(a.ends, b.ends + len(a.values)))


def words_and_specials(texts: tx.Texts, specials: list[bytes]) -> tx.Words:
    """Pre-tokens of texts; the string of a special token is one, and the text before and after it is cut by itself."""
    data, offsets = texts
    raw = data.tobytes()
    spans = [m.span() for m in re.finditer(b"|".join(map(re.escape, specials)), raw)] if specials else []
    # A string that lies across the end of a text isn't one.
    lo, hi = np.array(spans, np.int64).reshape(-1, 2).T
    within = np.searchsorted(offsets, lo, side="right") == np.searchsorted(offsets, hi, side="left")
    lo, hi = lo[within], hi[within]
    if not len(lo):
        return tx.pretokens(texts)
    cut = tx.pretokens(tx.Texts(data, np.unique(np.concatenate([offsets, lo, hi]))))
    of = np.searchsorted(lo, cut.starts, side="right") - 1
    inside = (of >= 0) & (cut.starts < hi[of])
    starts = np.sort(np.append(cut.starts[~inside], lo))
    ends = np.sort(np.append(cut.ends[~inside], hi))
    return tx.Words(starts, ends, np.searchsorted(starts, offsets))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """What a worker remembers from one task to the next."""
    return WordIds(path)


def encoded(words: WordIds, column: pa.Array, end_id: int) -> tx.Runs:
    """The ids of each text of a piece, with the end id after them."""
    texts = tx.texts_of(column)
    cut = words_and_specials(texts, special_strings(words.path))
    found = tx.distinct_words(texts.data, cut)
    runs = tx.take_runs(words.of(texts.data, found), found.codes)
    ends = np.append(0, runs.ends)[cut.first]
    return tx.Runs(np.insert(runs.values, ends[1:], end_id), ends[1:] + np.arange(1, len(ends)))


def write_tokens(df: DataFrame, path: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """Encode every text of df and write the ids to `path`, in ascending order of the key.

    `files` ranges of keys, by default as many as the session has shuffle
    partitions, become a file each. A null text is an empty one: its ids are the
    end id. The string of a special token within a text is that token. Rows with a null key come first; rows with the same key follow each
    other in the order of their ids. An empty table writes no row. Other columns
    are not looked at.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    name = vocabulary_file(spark, tokenizer_file)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).cast("string"))
    # From the keys alone; only the sizes of the files depend on it.
    cuts = np.unique(np.array(rows.approxQuantile("key", [i / files for i in range(1, files)], 1e-3) if files > 1 else [], np.int64))

    def encode(batches):
        words = word_ids(local_file(name))
        for batch in batches:
            for lo, hi in tx.pieces(batch.column(1)):
                keys = batch.column(0).slice(lo, hi - lo)
                runs = encoded(words, batch.column(1).slice(lo, hi - lo), end_id)
                narrow = runs.values.astype("<u2") if not len(runs.values) or runs.values.max() < 1 << 16 else runs.values.astype("<u4")
                raw, width, at = narrow.tobytes(), narrow.itemsize, np.append(0, runs.ends).tolist()
                file = np.where(np.asarray(keys.is_valid()), np.searchsorted(cuts, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right"), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.astype(np.int32)), keys, pa.array(np.diff(at)), pa.array([raw[width * a : width * b] for a, b in zip(at, at[1:], strict=False)], pa.binary())],
                    ["file", "key", "n", "ids"],
                )

    dealt = rows.mapInArrow(encode, "file int, key long, n long, ids binary").repartitionById(max(1, len(cuts) + 1), "file")
    in_order = dealt.sortWithinPartitions(F.asc_nulls_first("key"), "ids")
    in_order.mapInArrow(_groups, "file int, first long, keys array<long>, sizes array<long>, words binary, offsets array<long>, escaped binary").write.parquet(path)


def _groups(batches):
    """Rows of whole documents, from the documents of a file in order."""
    file, place = None, 0
    keys: list[int] = []
    sizes: list[int] = []
    ids: list[np.ndarray] = []
    held = 0

    def group():
        coded = simple8b.encode(np.concatenate(ids))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([file], pa.int32()), pa.array([place]), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([coded.words.astype(_U8).tobytes()]), pa.array([coded.offsets.tolist()], pa.list_(pa.int64())), pa.array([coded.escaped.astype(_U8).tobytes()]),
            ], ["file", "first", "keys", "sizes", "words", "offsets", "escaped"],
        )

    for batch in batches:
        for f, k, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if keys and (f != file or held + n > GROUP_IDS):
                yield group()
                place = place + held if f == file else 0
                keys, sizes, ids, held = [], [], [], 0
            file = f
            keys.append(k)
            sizes.append(n)
            buffer = raw.as_buffer()
            ids.append(np.frombuffer(buffer, "<u2" if buffer.size == 2 * n else "<u4"))
            held += n
    if keys:
        yield group()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids) of every document in the files at `path`.

    start counts the ids of all documents before it.
    """
    return _decoded(spark, path, "ids array<long>", lambda ids: pa.array([ids], pa.list_(pa.int64())))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the decoded ids of the files at `path`."""
    return _decoded(spark, path, "n_tokens long, ids_crc32 long", None)


def _decoded(spark: SparkSession, path: str, schema: str, make) -> DataFrame:
    groups = spark.read.schema("file int, first long, keys array<long>, sizes array<long>, words binary, offsets array<long>, escaped binary").parquet(path)
    # One number per file, whose number is a parameter of the writer.
    totals = groups.select("file", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("file").agg(F.sum("n").alias("n")).collect()
    per_file = np.zeros(max((r.file for r in totals), default=0) + 1, np.int64)
    for r in totals:
        per_file[r.file] = r.n
    before = np.cumsum(per_file) - per_file

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, first, keys, sizes, words, offsets, escaped = (batch.column(c)[i] for c in range(7))
                sizes = np.array(sizes.as_py(), np.int64)
                ids = simple8b.decode(simple8b.Coded(int(sizes.sum()), np.frombuffer(words.as_buffer(), _U8), np.array(offsets.as_py(), np.int64), np.frombuffer(escaped.as_buffer(), _U8)))
                ends = np.cumsum(sizes)
                starts = pa.array(before[file.as_py()] + first.as_py() + ends - sizes)
                if make is None:
                    raw, at = ids.astype("<u4").tobytes(), np.append(0, ends).tolist()
                    crc = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
                    new = [pa.array(sizes), crc]
                else:
                    new = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([keys.values, starts, *new], ["key", "start", *(["n_tokens", "ids_crc32"] if make is None else ["ids"])])

    return groups.mapInArrow(run, "key long, start long, " + schema)
