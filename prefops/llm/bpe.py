"""Byte-level BPE: encode every different word once, and put texts together again.

Texts are cut into pre-tokens in blocks of some megabytes. A block's different
words go out, dealt by their hash into parts that all blocks share; its texts
stay as lists of word numbers. In each part every different word of the corpus is
encoded once. The ids of a block's words come back to the block, where the lists
of numbers become lists of ids. A word that fills a third of all texts is one row
per block.

Decoding looks every id up in the table of token bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefops.llm import text as tx
from prefops.llm.frames import bounded_batches, quoted, without
from prefops.llm.secrets import encoding, local_file, vocabulary_file

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 22
#: Bytes of an id that the vocabulary doesn't have.
UNKNOWN = "�".encode()


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of their significance, compressed."""
    planes = np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_words(words: list[bytes]) -> bytes:
    """Words as one run of bytes after their lengths."""
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words))


def unpack_words(raw: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.append(0, np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def block_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of a block of texts, frequent ones first; all words as numbers; where each text begins."""
    codes, firsts, at = [], [np.zeros(1, np.int64)], 0
    number: dict[bytes, int] = {}
    for lo, hi in tx.pieces(column):
        texts = tx.texts_of(column.slice(lo, hi - lo))
        cut = tx.pretokens(texts)
        found = tx.distinct_words(texts.data, cut)
        # Pieces share words.
        of = np.array([number.setdefault(w, len(number)) for w in tx.spans_of(texts.data, found.starts, found.ends)], np.int64)
        codes.append(of[found.codes] if len(of) else np.zeros(0, np.int64))
        firsts.append(cut.first[1:] + at)
        at += len(found.codes)
    if not number:
        return [], np.zeros(0, np.int64), np.concatenate(firsts)
    # A word's number is its rank by frequency in the block.
    words, code = list(number), np.concatenate(codes)
    order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [words[i] for i in order.tolist()], rank[code], np.concatenate(firsts)


def _cut(batches, parts: int) -> Iterator[pa.RecordBatch]:
    """A block's list of numbers, and its words by part."""
    names = ["block", "part", "keys", "first", "at", "data"]
    for batch in batches:
        for lo, hi in tx.pieces(batch.column(1), BLOCK_BYTES):
            keys = batch.column(0).slice(lo, hi - lo)
            words, codes, first = block_words(batch.column(1).slice(lo, hi - lo))
            lengths, numbers, packs = packed(np.diff(first)), packed(codes), b"".join(words)
            block = hashlib.sha256(b"".join([packs, lengths, numbers, repr(keys.to_pylist()).encode()])).hexdigest()
            key_list = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([-1], pa.int32()), key_list, pa.array([lengths]), pa.array([None], pa.binary()), pa.array([numbers])], names
            )
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            used, starts = np.unique(part[order], return_index=True)
            groups = np.split(order, starts[1:])
            n = len(used)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * n), pa.array(used.astype(np.int32)), pa.nulls(n, key_list.type), pa.nulls(n, pa.binary()),
                        pa.array([packed(np.diff(g, prepend=0)) for g in groups]), pa.array([pack_words([words[i] for i in g.tolist()]) for g in groups]),
                    ], names,
                )
    tx.release()


def _encode_words(batches, name: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """The ids of the words of rows (block, part, at, data) that are sorted by part; each word is encoded once in its part."""
    enc = encoding(local_file(name), pattern)
    known: dict[bytes, list[int]] = {}
    open_part = None
    for batch in batches:
        ids, ends = [], []
        for part, data in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
            if part != open_part:
                known, open_part = {}, part
            out = []
            for word in unpack_words(data.as_py()):
                found = known.get(word)
                if found is None:
                    found = known[word] = enc.encode_ordinary(word.decode())
                out.append(found)
            runs = tx.runs_of(out)
            ids.append(packed(runs.values))
            ends.append(packed(np.diff(runs.ends, prepend=0)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], ["block", "part", "at", "ids", "sizes"])
    known = {}
    tx.release()


def _assemble(words: pa.Table, blocks: pa.Table) -> pa.Table:
    """The texts of a block as ids, from the ids of its words. Blocks that are equal come together."""
    # A task puts one block together after the other; the last one's memory goes back first.
    tx.release()
    if not len(blocks):
        return pa.table({"key": blocks["keys"].combine_chunks().flatten(), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    at, ids, sizes, seen = [], [], [], set()
    for part, a, i, s in zip(*(words[c].to_pylist() for c in ("part", "at", "ids", "sizes")), strict=True):
        if part not in seen:
            seen.add(part)
            at.append(np.cumsum(unpacked(a)))
            ids.append(unpacked(i).astype(np.int32))
            sizes.append(unpacked(s))
    lengths, codes = (unpacked(blocks[c][0].as_py()) for c in ("first", "data"))
    number = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
    if len(number) != int(codes.max(initial=-1)) + 1:
        raise RuntimeError("the rows came in another order the second time; write them first")
    order = np.empty(len(number), np.int64)
    order[number] = np.arange(len(number))
    runs = tx.take_runs(tx.Runs(np.concatenate([*ids, np.zeros(0, np.int32)]), np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)])).astype(np.int64)), order[codes])
    ends = np.append(0, runs.ends)[np.append(0, np.cumsum(lengths))]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(runs.values.astype(np.int32)))
    one = pa.table({"key": blocks["keys"].combine_chunks()[0].values, "n_tokens": pa.array(np.diff(ends)), "ids": lists})
    return pa.concat_tables([one] * len(blocks))


def encode(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids) of every row of df.

    `ranks` is the path of a rank file, `pattern` its pre-token pattern, for
    which `text.pretokens` stands. Strings of special tokens are ordinary text.

    A null text is an empty one and has no ids. Repeated rows and keys, and null
    keys, give a row each. An empty table gives an empty one. Other columns are
    not looked at.

    df is read twice, for the words and for the lists of numbers, which takes less
    than to keep both. A block's name is a digest of all it holds, so words only
    come back to the very block that they left. Equal blocks have equal words;
    each is put together as often as it occurs. A frame whose rows may come in
    another order the second time, such as one after a shuffle, should be
    written first: a block that doesn't find its words stops the job.
    """
    if pattern != tx_pattern():
        raise ValueError("the pre-tokens are those of public_tokenizers.PATTERN")
    spark = df.sparkSession
    bounded_batches(spark)
    name = vocabulary_file(spark, ranks)
    # As many parts as the session deals out any shuffle to, which grows with the data.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string"))
    cut = rows.mapInArrow(lambda b: _cut(b, parts), f"block string, part int, keys array<{kind}>, first binary, at binary, data binary")
    words = cut.where("part >= 0").select("block", "part", "at", "data").repartition("part").sortWithinPartitions("part")
    ids = words.mapInArrow(lambda b: _encode_words(b, name, pattern), "block string, part int, at binary, ids binary, sizes binary")
    blocks = cut.where("part < 0").select("block", "keys", "first", "data")
    out = ids.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_assemble, f"key {kind}, n_tokens long, ids array<int>")
    return out.withColumnRenamed("key", key)


def tx_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_bytes(ranks: str, pattern: str) -> tx.Runs:
    """The table of token bytes; the last row is for ids that aren't in it."""
    enc = encoding(ranks, pattern)
    values = [b""] * enc.n_vocab
    for t in enc.token_byte_values():
        values[enc.encode_single_token(t)] = t
    return tx.runs_of([*values, UNKNOWN], np.uint8)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The rows of df with the bytes of their ids (decoded), and the ids as little-endian 32-bit numbers (packed).

    The table of token bytes has as many rows as the vocabulary, whatever the
    data, and goes to every task. A null list decodes to null; a null id or one
    beyond the vocabulary gives the bytes of U+FFFD (and 0xFFFFFFFF if null, in
    `packed`). Columns of df that have the name of an added one are replaced.
    """
    bounded_batches(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(token_bytes(ranks, pattern))
    kept = without(df.columns if keep is None else keep, ["decoded", "packed"])
    source = df.select(*(F.col(quoted(c)) for c in kept), F.col(quoted(ids)).cast("array<int>").alias("__ids"))
    n = len(kept)
    types = source.select(*kept).schema.add("decoded", "binary").add("packed", "binary")

    def run(batches):
        runs = table.value
        unknown = len(runs.ends) - 1
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, 256)
                lists = cut.column(n)
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                values = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                found = tx.take_runs(runs, np.where((values < 0) | (values >= unknown), unknown, values))
                ends = np.append(0, np.cumsum(sizes))
                at = np.append(0, found.ends)[ends].tolist()
                raw, ids_raw = found.values.tobytes(), values.astype("<u4").tobytes()
                null = (~np.asarray(lists.is_valid())).tolist()
                decoded = [None if z else raw[a:b] for a, b, z in zip(at, at[1:], null, strict=False)]
                as_bytes = [None if z else ids_raw[4 * a : 4 * b] for a, b, z in zip(ends[:-1].tolist(), ends[1:].tolist(), null, strict=True)]
                yield pa.RecordBatch.from_arrays([*(cut.column(i) for i in range(n)), pa.array(decoded, pa.binary()), pa.array(as_bytes, pa.binary())], types.fieldNames())
        tx.release()

    return source.mapInArrow(run, types)
