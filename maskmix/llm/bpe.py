"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list. Each adjacent pair that can merge waits in the bucket of its merge
rank; a three-level bitmap says which buckets hold something, and find-first-set on its words gives the lowest
rank in constant time. Inside a bucket positions leave from the left. Merging only unlinks and enqueues, and
entries whose pair has changed are skipped when met, so a pre-token of n bytes costs O(n log n) whatever its
length. Pre-tokens never merge with each other, so many short ones share one list and one queue; those seen
before are remembered per worker in caches of bounded size, until the worker has encoded nothing for a while: what
runs next in the same worker shares its executor's memory.

Defined cases: null text encodes like empty text, to no ids; ids that are null decode to no bytes; repeated rows
are encoded alike; an empty table gives no rows; unknown columns are carried along, columns named like the
result are replaced.
"""

from __future__ import annotations

import base64
import ctypes
import functools
import gc
import hashlib
import itertools
import threading
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from maskmix.llm.common import documents, save, small_batches

#: Entries of a generation of a cache, characters of an entry, and texts whose chunks are learned together.
CACHE_ENTRIES, CACHE_LENGTH, TOGETHER = 400_000, 64, 1000
#: Pre-tokens that are merged at once: their linked list takes some hundred bytes a letter.
MERGED = 20_000
#: Seconds without work after which a worker gives back what its tokenizers hold.
IDLE = 5.0


class Cache:
    """Two generations of bounded size; what is met again moves to the younger one."""

    def __init__(self):
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def find(self, key: str) -> tuple[int, ...] | None:
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: str, ids: tuple[int, ...]) -> None:
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[key] = ids


class Tokenizer:
    """``ranks`` maps the bytes of every token to its id, which is its merge rank too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.names = [str(i) for i in range(size)]
        # The bitmap: a bit per bucket that holds something, a bit per word of those, and one word on top.
        self.low, self.mid = [0] * (size // 64 + 1), [0] * (size // 4096 + 1)
        #: Ranks of pairs of bytes, by their two bytes.
        self.pairs = np.array([ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)], np.int64)
        self.pieces, self.chunks = Cache(), Cache()

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of many pre-tokens, laid end to end in one linked list with barriers between them.

        The bitmap and the buckets are empty before and after.
        """
        get, low, mid, top, buckets = self.ranks.get, self.low, self.mid, 0, {}
        text = b"".join(pieces)
        n = len(text)
        starts = [0, *itertools.accumulate(map(len, pieces))]
        barrier = bytearray(n + 1)  # a piece starts here
        for i in starts:
            barrier[i] = 1
        end = list(range(1, n + 1))  # part i is text[i:end[i]]
        before = list(range(-1, n))
        whole = np.frombuffer(text, np.uint8).astype(np.int64)
        ranks = self.pairs[whole[:-1] << 8 | whole[1:]] if n > 1 else np.zeros(0, np.int64)
        ranks = np.where(np.frombuffer(bytes(barrier), np.uint8)[1:n], -1, ranks) if n > 1 else ranks
        waits = [*ranks.tolist(), -1]  # rank of the pair that starts at i
        order = np.argsort(ranks, kind="stable")
        order = order[ranks[order] >= 0]
        found, first = np.unique(ranks[order], return_index=True)
        for r, at in zip(found.tolist(), np.split(order, first[1:]), strict=False):
            buckets[r] = at.tolist()
            low[r >> 6] |= 1 << (r & 63)
            mid[r >> 12] |= 1 << (r >> 6 & 63)
            top |= 1 << (r >> 12)
        while top:
            b = (top & -top).bit_length() - 1
            word = mid[b]
            a = b << 6 | (word & -word).bit_length() - 1
            word = low[a]
            rank = a << 6 | (word & -word).bit_length() - 1
            bucket = buckets.pop(rank)
            low[a] = word = word & word - 1
            if not word:
                mid[b] = word = mid[b] & mid[b] - 1
                if not word:
                    top &= top - 1
            bucket.sort()
            done = 0
            for i in bucket:
                done += 1
                if waits[i] != rank:
                    continue  # stale
                j = end[i]
                k = end[i] = end[j]
                waits[j] = waits[i] = -1
                lowest = rank + 1
                if not barrier[k]:
                    before[k] = i
                    if (r := get(text[i : end[k]])) is not None:
                        waits[i] = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            low[r >> 6] |= 1 << (r & 63)
                            mid[r >> 12] |= 1 << (r >> 6 & 63)
                            top |= 1 << (r >> 12)
                        lowest = r
                if not barrier[i]:
                    h = before[i]
                    waits[h] = -1
                    if (r := get(text[h:k])) is not None:
                        waits[h] = r
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            buckets[r] = [h]
                            low[r >> 6] |= 1 << (r & 63)
                            mid[r >> 12] |= 1 << (r >> 6 & 63)
                            top |= 1 << (r >> 12)
                        if r < lowest:
                            lowest = r
                if lowest <= rank and done < len(bucket):  # what has just come goes first
                    buckets.setdefault(rank, []).extend(bucket[done:])
                    low[a] |= 1 << (rank & 63)
                    mid[b] |= 1 << (a & 63)
                    top |= 1 << b
                    break
        out = []
        for i, stop in itertools.pairwise(starts):
            ids = []
            while i < stop:
                ids.append(get(text[i : (j := end[i])]))
                i = j
            out.append(ids)
        return out

    def _known(self, pieces, keep=None) -> dict[str, tuple[int, ...]]:
        """Ids of pre-tokens; those not remembered are merged together, and remembered (if in ``keep``)."""
        young, old, ranks = self.pieces.young, self.pieces.old, self.ranks
        found, new = {}, []
        for piece in pieces:
            ids = young.get(piece) or old.get(piece)
            if ids is None and (whole := ranks.get(piece.encode())) is not None:
                ids = (whole,)
            if ids is None:
                new.append(piece)
            else:
                found[piece] = ids
        if not new:
            return found
        for some in itertools.batched(new, MERGED):
            for piece, ids in zip(some, self.merge([x.encode() for x in some]), strict=True):
                found[piece] = ids = tuple(ids)
                if len(piece) <= CACHE_LENGTH and (keep is None or piece in keep):
                    self.pieces.put(piece, ids)
        return found

    def learn(self, texts: list[str]) -> None:
        """Remember the chunks of these texts, and the pieces of what stands before the first space."""
        new: set[str] = set()
        for x in texts:
            new.update(x.split(" ")[1:])
        new = [c for c in new.difference(self.chunks.young) if c not in self.chunks.old and 0 < len(c) <= CACHE_LENGTH and not c[0].isspace() and not c[-1].isspace()]
        split = [self.split(" " + c) for c in new]
        # A chunk of one piece is remembered as a chunk, not as a piece too.
        keep = {p for pieces in split if len(pieces) > 1 for p in pieces}
        for x in texts:
            keep.update(self.split(x[: x.find(" ")]) if " " in x else ())
        found = self._known(keep.union([pieces[0] for pieces in split]), keep)
        for c, pieces in zip(new, split, strict=True):
            self.chunks.put(c, found[pieces[0]] if len(pieces) == 1 else tuple([i for p in pieces for i in found[p]]))

    def _split(self, text: str) -> list[int]:
        """Ids of any text, pre-token by pre-token."""
        pieces = self.split(text)
        found = self._known(dict.fromkeys(pieces))
        return [i for p in pieces for i in found[p]]

    def encode(self, text: str) -> list[int]:
        """Ids of a text.

        A pre-token has white space at its start only, so the text may be cut before any space between two
        characters that are none; only texts with other spaces are split as a whole.
        """
        head, *rest = text.split(" ")
        if not head or head[-1].isspace():
            return self._split(text)
        out = self._split(head)
        cache = self.chunks
        get = cache.young.get
        for chunk in rest:
            ids = get(chunk)
            if ids is None:
                ids = cache.find(chunk)
                if ids is None:
                    if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                        return self._split(text)
                    ids = tuple(self._split(" " + chunk))
                    if len(chunk) <= CACHE_LENGTH:
                        cache.put(chunk, ids)
                get = cache.young.get
            out += ids
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        self.learn(texts)
        return [self.encode(x) for x in texts]

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@functools.lru_cache(4)
def load(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file, once per worker."""
    with open(path, "rb") as f:
        return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


_waiting: list[threading.Timer] = []


def forget() -> None:
    """Give back the memory of this process's tokenizers; one that is in use stays until its user is done."""
    load.cache_clear()
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def lent(path: str, pattern: str):
    """The worker's tokenizer. It waits ``IDLE`` seconds for the next task, then ``forget`` drops it."""
    while _waiting:
        _waiting.pop().cancel()
    try:
        yield load(path, pattern)
    finally:
        timer = threading.Timer(IDLE, forget)
        timer.daemon = True
        _waiting.append(timer)
        timer.start()


def _replaced(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _map(df: DataFrame, path: str, pattern: str, name: str, kind: T.DataType, arrow: pa.DataType, source: str, each) -> DataFrame:
    schema = _replaced(df.schema, name, kind)

    def run(batches):
        with lent(path, pattern) as tokenizer:
            for batch in batches:
                made = pa.array(each(tokenizer, batch.column(source).to_pylist()), arrow)
                keep = [c for c in batch.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], made], [*keep, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` plus ``ids``."""
    return _map(df, path, pattern, ids, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), text, lambda tokenizer, column: tokenizer.encode_all([x or "" for x in column]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus ``decoded``, as bytes."""
    return _map(df, path, pattern, out, T.BinaryType(), pa.binary(), ids, lambda tokenizer, column: [tokenizer.decode(x or ()) for x in column])


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``doc_id`` with the digests of a document's ids and of what they decode to; saved, as it runs in small batches."""

    def run(batches):
        with lent(path, pattern) as tokenizer:
            names = tokenizer.names
            for batch in batches:
                rows = []
                texts = (x or "" for x in batch.column(1).to_pylist())
                for ids in itertools.chain.from_iterable(map(tokenizer.encode_all, itertools.batched(texts, TOGETHER))):
                    rows.append((len(ids), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids)).hexdigest()))
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([df.schema["doc_id"], *[T.StructField(c, k) for c, k in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))]])
    with small_batches(df.sparkSession):
        return save(df.select("doc_id", text).mapInArrow(run, schema))


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), *vocabulary())
