"""Byte-level BPE encoding and decoding by a distributed table of distinct words.

Spark splits texts into words just as the tokenizer's own pre-tokenizer does, by one regular expression. A task numbers
the distinct words of its chunks of CHUNK_WORDS or a little more, the frequent ones first, and sends each of them once, in
compressed lists by hash bucket, to the bucket's task; that task encodes every distinct word of the corpus that falls into
a bucket once and answers each list with the ids. The answers are joined back to the chunk, where ids are put in place by
position. What is shuffled is one entry for each distinct word of a chunk and the positions as small numbers, never texts
or word occurrences; a frequent word costs no more than any other. Decoding is a join of ids with the vocabulary's table of
ids and pieces, whose size is bounded, in lots of tokens, and joins the bytes.

Lists and positions leave the splitting stage by one exchange, which both branches of the join read: texts are read and
split once. Chunks carry a checksum of their words: if a lost task's rows came back in another order, the join would fail
instead of giving wrong ids. Buckets grow with the input, so that a bucket's distinct words stay few.

Defined cases: a null text is the empty text, which has no ids; a special token's string in a text is that token, as with
the tokenizer's defaults; texts that hold one, or characters that Java does not know, are split by the tokenizer itself;
rows of equal doc_id and a null doc_id are rows like any other; an empty table gives an empty table; other columns are
ignored. Texts are split in pieces of PIECE characters or a little more, between two words; memory is bounded by a chunk,
or the numbers of a single text where that is larger.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_batches

CHUNK_WORDS = 1_000_000
PIECE = 2**18
#: Bytes of input for each bucket of distinct words, and most buckets: beyond them a chunk's lists would grow too short.
BUCKET_BYTES, MOST_BUCKETS = 2**26, 4096
#: White space, as the tokenizer's patterns have it; then the words. A character that Java does not know is in no word.
_SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = rf" ?[A-Za-z[\p{{L}}]]++|'(?:s|t|re|ve|m|ll|d)| ?[0-9[\p{{N}}]]++| ?[^{_SPACE}\p{{L}}\p{{N}}\p{{Cn}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Where white space begins, one word ends and another begins.
_CUT = f"(?=[{_SPACE}])(?<![{_SPACE}])"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def _load(path: str):
    """The tokenizer that splits, one that doesn't, and its special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return Tokenizer.from_file(path), whole, special


@lru_cache
def _special_pattern(path: str):
    special = _load(path)[2]
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


@lru_cache
def pieces(path: str) -> list[bytes]:
    """The bytes of each id."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocabulary = _load(path)[0].get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


def split(text: str, path: str) -> list[str]:
    """The words that are encoded each by itself; a special token is a word."""
    pattern = _special_pattern(path)
    if pattern and pattern.search(text):
        special = _load(path)[2]
        return [w for part in pattern.split(text) if part for w in ([part] if part in special else split(part, path))]
    return [text[s:e] for _, (s, e) in _load(path)[0].pre_tokenizer.pre_tokenize_str(text)]


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers, bytes of equal weight together, which compress better."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _from_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _unpack(lengths: bytes, words: bytes) -> list[bytes]:
    """The words of a list, from their lengths and their bytes."""
    data, ends = zstandard.decompress(words), np.cumsum(_from_planes(lengths).astype(np.int64)).tolist()
    return [data[s:e] for s, e in zip([0, *ends], ends, strict=False)]


def _words(text: Column) -> Column:
    """The words of a text without special tokens and unknown characters."""
    return F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))


def _text_pieces(text: Column) -> Column:
    """Structs of a piece and whether it is its text's first."""
    long = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}(?:{_CUT}|\\z)|.+?{_CUT}|.+"), F.lit(0))
    return F.transform(F.when(F.length(text) <= PIECE, F.array(text)).otherwise(long), lambda x, i: F.struct((i == 0).alias("first"), x.alias("text")))


def _bytes(words: pa.BinaryArray) -> bytes:
    """All values of an array without nulls one after another."""
    if not len(words):
        return b""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset)
    return bytes(memoryview(words.buffers()[2])[offsets[0] : offsets[-1]]) if offsets[-1] > offsets[0] else b""


class _Chunk:
    """Rows of a chunk so far."""

    def __init__(self):
        self.words, self.ids, self.counts, self.total = [], [], [], 0

    def add(self, batch: pa.RecordBatch, path: str) -> None:
        if not batch.num_rows:
            return
        words, text = batch["words"], batch["text"]
        sizes, flat = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten()
        ends = np.cumsum(sizes)
        bytes_before = np.r_[0, np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64))]
        whole = bytes_before[ends] - bytes_before[ends - sizes] == pc.binary_length(text).to_numpy(zero_copy_only=False)
        for special in _load(path)[2]:
            whole &= ~pc.match_substring(text, special).to_numpy(zero_copy_only=False)
        at = 0
        for i in np.flatnonzero(~whole).tolist():  # the tokenizer splits these
            self.words.append(flat.slice(at, ends[i] - sizes[i] - at))
            self.words.append(pa.array(own := split(text[i].as_py(), path), pa.string()))
            at, sizes[i] = int(ends[i]), len(own)
        self.words.append(flat.slice(at))
        first = batch["first"].to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first)
        before = starts[0] if len(starts) else len(sizes)
        if before:
            self.counts[-1] += int(sizes[:before].sum())
        self.counts.extend(np.add.reduceat(sizes, starts).tolist() if len(starts) else [])
        self.ids.extend(batch["doc_id"].take(pa.array(starts)).to_pylist())
        self.total += int(sizes.sum())

    def rows(self, part: int, serial: int, buckets: int) -> pa.RecordBatch:
        """A row for each bucket's list of distinct words, sorted, and one for the positions, which number words by frequency."""
        coded = pa.chunked_array(self.words, pa.string()).combine_chunks().dictionary_encode()
        words, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int32, len(words))
        order = pc.sort_indices(pa.table({"b": bucket, "w": words}), sort_keys=[("b", "ascending"), ("w", "ascending")])
        listed, bucket = words.take(order), bucket[order.to_numpy()]
        by_count = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        number, place = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
        number[by_count], place[order.to_numpy()] = np.arange(len(words)), np.arange(len(words))
        sizes = pc.binary_length(listed).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        data = _bytes(listed)
        cuts = np.flatnonzero(np.r_[len(words) > 0, np.diff(bucket) != 0])
        name = f"{part}-{serial}-{zlib.crc32(data)}"
        lists = [{"deal": f"bucket {bucket[s]}", "chunk": name, "bucket": int(bucket[s]), "lengths": _planes(sizes[s:e]), "words": zstandard.compress(data[ends[s] - sizes[s] : ends[e - 1]], 3)} for s, e in zip(cuts, [*cuts[1:], len(words)], strict=True)]
        at = {"deal": name, "chunk": name, "doc_ids": self.ids, "counts": self.counts, "positions": _planes(number[codes]), "places": _planes(place[by_count])}
        return pa.RecordBatch.from_pylist([*lists, at], schema=_ROWS)


_ROWS = pa.schema([("deal", pa.string()), ("chunk", pa.string()), ("bucket", pa.int32()), ("lengths", pa.binary()), ("words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("positions", pa.binary()), ("places", pa.binary())])
_ROWS_DDL = "deal string, chunk string, bucket int, lengths binary, words binary, doc_ids array<long>, counts array<long>, positions binary, places binary"


def _chunks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            starts = np.flatnonzero(batch["first"].to_numpy(zero_copy_only=False))
            cut = int(starts[0]) if len(starts) else batch.num_rows
            chunk.add(batch.slice(0, cut), path)
            if chunk.total >= CHUNK_WORDS and cut < batch.num_rows:
                yield chunk.rows(part, serial, buckets)
                serial, chunk = serial + 1, _Chunk()
            chunk.add(batch.slice(cut), path)
        if chunk.ids:
            yield chunk.rows(part, serial, buckets)

    return run


def _answers(path: str):
    """Of rows sorted by bucket: each list's ids. What one bucket knew is forgotten with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, whole, special = _load(path)
        bucket, known = None, {}
        for batch in batches:
            sizes, ids = [], []
            for own, lengths, blob in zip(batch["bucket"].to_pylist(), batch["lengths"].to_pylist(), batch["words"].to_pylist(), strict=True):
                if own != bucket:
                    bucket, known = own, {k.encode(): [v] for k, v in special.items()}
                words = _unpack(lengths, blob)
                new = [w for w in words if w not in known]
                for word, e in zip(new, whole.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[word] = e.ids
                found = [known[w] for w in words]
                sizes.append(_planes(np.fromiter(map(len, found), np.uint32, len(found))))
                ids.append(_planes(np.fromiter(chain.from_iterable(found), np.uint32)))
            yield pa.RecordBatch.from_pydict({"chunk": batch["chunk"], "bucket": batch["bucket"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return run


def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] one after another."""
    ends = np.cumsum(length)
    return values[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _placed(at: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Ids of a chunk's documents."""
    out = []
    for chunk in at.itertuples():
        answers = answers.sort_values("bucket")
        size = np.concatenate([np.zeros(0, np.int64), *map(_from_planes, answers.sizes)]).astype(np.int64)
        values, start = np.concatenate([np.zeros(0, np.uint32), *map(_from_planes, answers.ids)]).astype("<u4"), np.cumsum(size) - size
        places = _from_planes(chunk.places)
        if len(places) != len(size):
            raise ValueError(f"chunk {chunk.chunk}: the documents were not the same when read again")
        size, start = size[places], start[places]
        positions = _from_planes(chunk.positions)
        ends = np.cumsum(np.asarray(chunk.counts, np.int64))
        for doc_id, s, e in zip(chunk.doc_ids, [0, *ends.tolist()], ends.tolist(), strict=False):
            p = positions[s:e]
            ids = _gather(values, start[p], size[p])
            out.append((doc_id, len(ids), ids.tobytes()))
    frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids"])
    frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame.doc_id], "Int64")
    return frame


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) for each row of docs."""
    path = path or default_vocabulary()
    spark = docs.sparkSession
    python_batches(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # Catalyst's estimate
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, size // BUCKET_BYTES))
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_text_pieces(F.coalesce("text", F.lit("")))).alias("p"))
    rows = pieces.select("doc_id", "p.first", "p.text", _words(F.col("p.text")).alias("words"))
    dealt = rows.mapInArrow(_chunks(path, buckets), _ROWS_DDL).repartition("deal")
    # below 1 only where the kind is 0; rand() keeps both filters above the exchange, so that it is one; positions stay where it dealt them
    lists, at = (dealt.filter(kind.cast("int") + F.rand(0) < 1) for kind in (F.col("bucket").isNull(), F.col("bucket").isNotNull()))
    answers = lists.sortWithinPartitions("bucket").mapInArrow(_answers(path), "chunk string, bucket int, sizes binary, ids binary")
    return at.groupBy("deal").cogroup(answers.groupBy("chunk")).applyInPandas(_placed, "doc_id long, n_tokens long, ids binary")


#: Tokens that are joined with their pieces at a time.
JOIN_TOKENS = 2**20


def vocabulary(path: str) -> pa.Table:
    """id and piece (bytes) of all ids."""
    found = pieces(path)
    return pa.table({"id": pa.array(range(len(found)), pa.uint32()), "piece": pa.array(found, pa.binary())})


def joined_pieces(ids: np.ndarray, table: pa.Table) -> pa.Array:
    """The piece of each id: the different ids are joined with the vocabulary, and the pieces go to their places; an id that the vocabulary lacks has no bytes."""
    coded = pa.array(ids).dictionary_encode()
    n = len(coded.dictionary)
    at = pa.table({"at": np.arange(n), "id": coded.dictionary}).join(table, "id", join_type="left outer", use_threads=False).combine_chunks()
    back = np.empty(n, np.int64)
    back[at["at"].to_numpy()] = np.arange(n)  # a join keeps no order
    return pc.fill_null(at["piece"].combine_chunks(), b"").take(pa.array(back[coded.indices.to_numpy()]))


def _decoded(path: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        for batch in batches:
            blobs = [x or b"" for x in batch["ids"].to_pylist()]
            ends = np.cumsum([len(x) // 4 for x in blobs], dtype=np.int64)
            ids, parts, sizes = np.frombuffer(b"".join(blobs), "<u4"), [], []
            for s in range(0, len(ids), JOIN_TOKENS):
                found = joined_pieces(ids[s : s + JOIN_TOKENS], table)
                sizes.append(pc.binary_length(found).to_numpy(zero_copy_only=False).astype(np.int64))
                parts.append(_bytes(found))
            places = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))][np.r_[0, ends]].tolist()
            data = b"".join(parts)
            texts = [data[s:e].decode(errors="replace") for s, e in zip(places, places[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with its ids' text as decoded."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(path or default_vocabulary(), encoded.columns), f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for each row of docs."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
