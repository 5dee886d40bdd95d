"""BPE encoding and decoding through a table of distinct words.

Texts are split into words (the pieces that the tokenizer never merges across) and kept, in blocks of
bounded size, as numbers: those of frequent words, a bounded table that every task holds, and those of
the block's other words, each once. These meet by word, every distinct word is encoded once by the
tokenizer, and its ids go back to the places that it came from; a block's ids follow from its numbers.
A word common enough to be a hot key is in the bounded table. Decoding joins ids with the tokenizer's
pieces, whose number the vocabulary bounds.

Defined results: null and empty texts have no ids and decode to the empty text. Texts of special
tokens are special tokens, as the tokenizer has it. Repeated rows give repeated rows; ids may be
null or repeated, since ids are only carried along. An empty table gives an empty
table.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.registry import fresh_folder
from ..session import cut
from .common import bounded, map_batches

# Words that every task holds with their ids; about 20 MB there, whatever the size of the corpus.
FREQUENT = 130_000
# Texts from which these words are chosen.
SAMPLE = 20_000
# Bytes of text in a block, and documents for which there is one bucket of words.
BLOCK = 4 << 20
PER_BUCKET = 1000

# Code points below U+0250 by their classes in the splitting pattern of byte-level BPE; these have not
# changed since the first versions of Unicode. Texts with others are split by the tokenizer itself.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\t-\r \x85\xa0"
WORDS = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
OTHER = re.compile("[^\u0000-ɏ]")


@functools.cache
def load(path: str):
    """The tokenizer of a file, read once by a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splitter(path: str) -> Callable[[str], list[str]]:
    """The function from a text to its words, special tokens among them."""
    tokenizer = load(path)
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    cuts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def plain(text: str) -> list[str]:
        if OTHER.search(text) is None:
            return WORDS.findall(text)
        return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(text: str) -> list[str]:
        if cuts is None or cuts.search(text) is None:
            return plain(text)
        found = []
        for n, part in enumerate(cuts.split(text)):
            found += [part] if n % 2 else plain(part)
        return found

    return words


@dataclass
class Frequent:
    """The bounded table of words: a word's number, and the ids of all of them one after the other."""

    number: dict[str, int]
    ids: np.ndarray
    ends: np.ndarray


def frequent_words(docs: DataFrame, path: str, most: int, rows: int) -> Frequent:
    """At most ``most`` words that stand often in a sample of about ``SAMPLE`` texts.

    The sample decides which words every task holds, not what a text is encoded to. Counts of words are
    summed by steps of a sixteenth of a power of two, so that no task sorts the words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = splitter(path)
        for batch in batches:
            for small in bounded(batch):
                seen = Counter()
                for t in small.column(0).to_pylist():
                    seen.update(words(t or ""))
                arrays = [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

    sample = docs.sample(min(1.0, SAMPLE / max(1, rows)), seed=0) if rows > SAMPLE else docs
    counted = sample.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    step = F.floor(16 * F.log2("n")).cast("int")
    counted = cut(counted.withColumn("step", step))
    lowest, total = math.inf, 0
    for at, words in sorted(counted.groupBy("step").agg(F.count(F.lit(1))).collect(), reverse=True):
        total += words
        if total > most:
            break
        lowest = at
    chosen = counted.filter(F.col("step") >= (lowest if lowest < math.inf else 1 << 30))
    found = encoded_words(chosen.select("word"), path).collect()  # ``most`` at most
    ends = np.cumsum([0] + [len(r.ids) for r in found])
    ids = np.fromiter((i for r in found for i in r.ids), np.int32, ends[-1])
    return Frequent({r.word: k for k, r in enumerate(found)}, ids, ends)


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """The column ``word`` of ``words``, whose rows differ, and ``ids``."""

    def make():
        return lambda columns: {**columns, "ids": encoded(path, columns["word"].to_pylist())}

    return map_batches(words.select("word"), make, "word string, ids array<int>")


def encoded(path: str, words: list[str], step: int = 10_000) -> list[list[int]]:
    """The ids of each word."""
    tokenizer, out = load(path), []
    for at in range(0, len(words), step):
        out += [x.ids for x in tokenizer.encode_batch_fast(words[at : at + step], add_special_tokens=False)]
    return out


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """The lengths of words, and the words, compressed."""
    return pack(np.array([len(w) for w in words], np.int32)), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(lengths: bytes, data: bytes) -> pa.StringArray:
    offsets = np.concatenate([[0], np.cumsum(unpack(lengths))]).astype(np.int32)
    whole = pa.py_buffer(zstandard.ZstdDecompressor().decompress(data))
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), whole)


def blocks(docs: DataFrame, path: str, held: Broadcast, buckets: int) -> DataFrame:
    """Texts in blocks of bounded size: the ids of the documents, how many words each has (``sizes``), the
    words as numbers (``codes``), and ``late``, the block's other words, whose numbers follow the
    frequent ones. They are ordered by a hash to ``buckets`` buckets, a piece of the list for each.

    The table is laid out by block, so that what is found for a block later comes to it.
    """
    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    piece = "bucket:int, start:int, lengths:binary, words:binary"
    schema = f"block long, ids array<{kind}>, sizes array<int>, codes binary, late array<struct<{piece}>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def late_pieces(late: list[str]) -> tuple[np.ndarray, list[dict]]:
        """The new number of each word, and the words of each bucket."""
        words = [w.encode() for w in late]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        out = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            lengths, data = pack_words([words[k] for k in order[lo:hi]])
            out.append({"bucket": int(bucket[order[lo]]), "start": int(lo), "lengths": lengths, "words": data})
        return place, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, number = splitter(path), held.value.number
        known = len(number)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for small in bounded(batch, BLOCK):
                late: dict[str, int] = {}
                codes, sizes = [], []
                for t in small.column("text").to_pylist():
                    found = words(t or "")
                    mine = [number.get(w, -1) for w in found]
                    if -1 in mine:
                        mine = [late.setdefault(w, known + len(late)) if k < 0 else k for w, k in zip(found, mine, strict=True)]
                    sizes.append(len(found))
                    codes.append(np.array(mine, np.int32))
                place, parts = late_pieces(list(late))
                numbers = np.concatenate([np.arange(known), known + place])[np.concatenate(codes)]
                ids = pa.ListArray.from_arrays([0, small.num_rows], small.column("id"))
                rest = [pa.array([x], f.type) for f, x in zip(list(arrow)[2:], (sizes, pack(numbers), parts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids.cast(arrow.field(1).type), *rest], schema=arrow)
                block += 1
                pa.default_memory_pool().release_unused()

    made = docs.select("id", "text").mapInArrow(run, schema)
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made.write.bucketBy(parts, "block").option("path", fresh_folder(spark)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # its files stay
    return table


def answers(table: DataFrame, path: str) -> DataFrame:
    """For the pieces of the blocks' other words, their ids: ``block``, ``start``, and, compressed, the
    ``counts`` of ids of the words and the ``ids``. Of a bucket every distinct word is encoded once."""

    def encode_bucket(group: pa.Table) -> pa.Table:
        pairs = zip(group["lengths"].to_pylist(), group["words"].to_pylist(), strict=True)
        lists = [unpack_words(*p) for p in pairs]
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids = pa.array(encoded(path, coded.dictionary.to_pylist()), pa.list_(pa.int32()))
        counts, found, at = [], [], 0
        for words in lists:
            mine = ids.take(coded.indices.slice(at, len(words)))
            at += len(words)
            counts.append(pack(pc.list_value_length(mine).to_numpy()))
            found.append(pack(mine.flatten().to_numpy()))
        return pa.table({"block": group["block"], "start": group["start"], "counts": counts, "ids": found})

    pieces_of = table.select("block", F.inline("late"))
    return pieces_of.groupBy("bucket").applyInArrow(encode_bucket, "block long, start int, counts binary, ids binary")


def encode_blocks(docs: DataFrame, path: str, finish: Callable, schema: str, frequent: int = FREQUENT) -> DataFrame:
    """What ``finish`` makes of the ids of the documents (an array per ``id``) and their lists of tokens."""
    rows = docs.count()
    held = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, path, frequent, rows))
    table = blocks(docs, path, held, math.ceil(max(1, rows) / PER_BUCKET))

    def fill(left: pa.Table, right: pa.Table) -> pa.Table:
        known = held.value
        parts = sorted(zip(*(right[c].to_pylist() for c in ("start", "counts", "ids")), strict=True))
        flat = np.concatenate([known.ids, *(unpack(p[2]) for p in parts)])
        lengths = np.concatenate([np.diff(known.ends), *(unpack(p[1]) for p in parts)]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        codes, sizes = unpack(left["codes"][0].as_py()), left["sizes"].combine_chunks().flatten().to_numpy()
        # the ids of all words one after the other: where each word's begin, and how far each id is from there
        long = lengths[codes]
        ends = np.cumsum(long)
        at = np.repeat(starts[codes] - (ends - long), long) + np.arange(long.sum())
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        tokens = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat[at]))
        out = finish(left["ids"].combine_chunks().flatten(), tokens)
        pa.default_memory_pool().release_unused()
        return out

    late = answers(table, path).groupBy("block")
    return table.select("block", "ids", "sizes", "codes").groupBy("block").cogroup(late).applyInArrow(fill, schema)


def pieces(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary, specials as their text."""
    tokenizer = load(path)
    special = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    # byte-level vocabularies write bytes as printable characters: those that print stand for
    # themselves, the others follow from U+0100 on
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    byte = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}
    named = {i: bytes(byte[c] for c in w) for w, i in tokenizer.get_vocab(with_added_tokens=False).items() if i not in special}
    named |= special
    return [named.get(i, b"") for i in range(max(named, default=-1) + 1)]


def texts_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its id and ``ids``, an array of ints."""
    rows = texts_of(docs, id_col, text)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>"

    def finish(names: pa.Array, tokens: pa.ListArray) -> pa.Table:
        return pa.table({"id": names, "ids": tokens})

    return encode_blocks(rows, path, finish, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids; null for null. Bytes that are no UTF-8
    become the replacement character, as with the tokenizer."""
    others = [c for c in encoded.columns if c != "decoded"]
    schema = f"{ddl(StructType([encoded.schema[c] for c in others]))}, decoded string"

    def make():
        piece = pieces(path)

        def work(columns):
            texts = [
                None if x is None else b"".join(map(piece.__getitem__, x)).decode("utf-8", "replace")
                for x in columns[ids].to_pylist()
            ]
            return {**columns, "decoded": texts}

        return work

    return map_batches(encoded.select(*[F.col(f"`{c}`") for c in others]), make, schema)


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, ``n_tokens``, ``ids_sha256`` of its ids and ``decoded_sha256`` of
    the text that they decode to."""
    rows = texts_of(docs, id_col, text)
    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

    def finish(names: pa.Array, tokens: pa.ListArray) -> pa.Table:
        piece = piece_table(path)
        numbers = pa.array([str(i) for i in range(len(piece))])
        flat = tokens.values

        def digest(column: pa.Array, separator: str | bytes, clean: bool) -> list[str]:
            joined = pc.binary_join(pa.ListArray.from_arrays(tokens.offsets, column.take(flat)), separator)
            out = []
            for x in joined:
                data = x.as_buffer()
                data = bytes(data).decode("utf-8", "replace").encode() if clean else data
                out.append(hashlib.sha256(data).hexdigest())
            return out

        sizes = pc.list_value_length(tokens).cast(pa.int64())
        return pa.table(
            {
                "id": names,
                "n_tokens": sizes,
                "ids_sha256": digest(numbers, ",", False),
                "decoded_sha256": digest(piece, b"", True),
            }
        )

    return encode_blocks(rows, path, finish, schema).withColumnRenamed("id", id_col)


@functools.cache
def piece_table(path: str) -> pa.Array:
    """``pieces`` as an array; read once by a worker."""
    return pa.array(pieces(path), pa.binary())
