"""Repeated passages by sharded Aho-Corasick automata.

1. Anchors: of the ``GRAM``-word runs in every ``WINDOW``-word window, the one with the smallest hash. Equal
   windows have equal anchors, so a window that recurs has an anchor that recurs. Anchors that occur in two documents
   are found by an exchange of packed arrays (smallest and largest document of each hash, reduced in every task
   first), and noted in a bitmap.
2. Passages are confirmed: the windows of noted anchors go through the same exchange by their own hash, and those that
   occur in two documents are noted in a second bitmap. The bitmaps' size is bounded: more recurring hashes than they
   have room for only make them let more through, never fewer. A hash is noted at two places while half of the bitmap
   is enough for all, so that few others are let through.
3. Automata are compiled from the confirmed passages, in shards by anchor: windows are compared by their words, words
   are numbered, and a passage is a string of letters, one a word, with the smallest document that holds its windows.
   A shard is closed when it holds ``SHARD`` windows, so its memory does not grow with the input; making an automaton
   takes more time for each letter the larger it is, so shards are small. An anchor with more than a
   ``HOT``-th of all occurrences is dealt out by its windows.
4. All documents are streamed: each noted run of a text goes to the automaton of its anchor (no other automaton can
   match it, and text without a noted window matches none), and the automaton reports every window in it that
   starts in a smaller document. Hashes only choose what is streamed; the automata compare the words themselves.
5. The reports of a row are joined to its text, and the covered words removed.

Equal passages of a task are one row with packed lists of places; no step pairs documents.

Defined cases: null or empty text has no words; a row with a null id neither gives nor loses words; equal ids do
not remove from each other; repeated rows get equal results; texts of any length are taken whole; an empty table
gives no rows; ids are whole numbers (others are an error, as they have no order here); ``remove`` carries other
columns along, whatever their names, and replaces columns named like its results.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from array import array
from collections import defaultdict
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskmix.llm.common import documents, packed, save, shuffle_partitions

WINDOW, GRAM = 13, 6
SPAN = WINDOW - GRAM + 1
#: The largest bitmap in bits (64 MB), and what a task holds before it passes it on.
LARGEST, HELD_HASHES, HELD_PASSAGES = 29, 1_000_000, 100_000
#: Windows of a shard; words that strings can number; share of the occurrences that makes an anchor hot.
SHARD, LETTERS, HOT = 2_000, 0x10F000, 4096


#: Bytes that are hashed at once, and the bases of the hashes.
BLOCK, BASE, STEP = 1 << 17, 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse, modulo 2**64."""
    out = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        power = np.full(BLOCK + 1, x, np.uint64)
        power[0] = 1
        out.append(np.cumprod(power))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    return (x ^ (x >> np.uint64(29))) * np.uint64(BASE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word by its bytes: a polynomial, from sums that run over a block of words."""
    out, up, down, i = np.empty(len(starts), np.uint64), *_powers(), 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + BLOCK, "right"))
        if j <= i:  # a word longer than a block
            out[i] = xxhash.xxh3_64_intdigest(data[lo : ends[i]].tobytes())
            i += 1
            continue
        part = data[lo : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * down[s]
        i = j
    return mix(out)


def chunks(column: pa.Array):
    """``first, data, offsets``: texts from the row ``first`` on, about a block of bytes or one long text."""
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the anchors of a chunk's texts: ``hash, row, first, last, base, starts, ends, words``.

    ``first`` and ``last`` are the windows of an anchor, ``SPAN`` at most, counted over the chunk's words;
    ``base`` is the first word of each row, ``starts`` and ``ends`` are the words' bytes, ``words`` their hashes.
    """
    word = np.concatenate([[False], ~SPACE[data], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    base = np.searchsorted(starts, offsets)
    n = len(starts) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none, base, starts, ends, np.zeros(0, np.uint64)
    w = word_hashes(data, starts, ends)
    low = w[: len(w) - GRAM + 1]
    for k in range(1, GRAM):
        low = low * STEP + w[k : len(w) - GRAM + 1 + k]
    low, reach = mix(low), 1
    while reach < SPAN:  # the least of SPAN runs, by doubling
        more = min(reach, SPAN - reach)
        low, reach = np.minimum(low[: len(low) - more], low[more:]), reach + more
    row = np.repeat(np.arange(len(base) - 1), np.diff(base))
    whole = row[:n] == row[WINDOW - 1 :]  # windows of one text
    same = np.concatenate([[False], whole[1:] & whole[:-1] & (low[1:] == low[:-1]), [False]])
    first, last = np.flatnonzero(whole & ~same[:-1]), np.flatnonzero(whole & ~same[1:])
    pieces = (last - first) // SPAN + 1
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, last = np.repeat(first, pieces) + SPAN * number, np.repeat(last, pieces)
    return low[first], row[first], first, np.minimum(last, first + SPAN - 1), base, starts, ends, w


def windows(words: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Hashes of the windows first to last of each piece, the number of the piece, and the window's first word."""
    size = last - first + 1
    piece = np.repeat(np.arange(len(first)), size)
    at = first[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    h = words[at]
    for k in range(1, WINDOW):
        h = h * STEP + words[at + k]
    return mix(h), piece, at


def _reduce(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray):
    """Smallest and largest document, and number of occurrences, by hash."""
    order = np.argsort(h, kind="stable")
    h, lo, hi, n = h[order], lo[order], hi[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[start], np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start), np.add.reduceat(n, start)


PACKED = "slice int, h binary, lo binary, hi binary, n binary"


def _pack(slices: int, h, *columns):
    """A row for each slice of the hashes, by their top bits."""
    cuts = np.searchsorted(h, np.arange(1 << slices, dtype=np.uint64) << np.uint64(64 - slices))
    cuts = np.append(cuts, len(h))
    some = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
    pack = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *map(pack, (h, *columns))], ["slice", "h", "lo", "hi", "n"])


def _exchanged(batches, slices: int, hashes):
    """Hashes of the documents' texts, reduced as far as a task can; ``hashes`` gives those of a chunk, with their rows."""
    held, n = [], 0

    def rows():
        h, lo = np.concatenate([a for a, _ in held]), np.concatenate([d for _, d in held])
        return _pack(slices, *_reduce(h, lo, lo, np.ones(len(h), np.int64)))

    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        docs = batch.column(0).to_numpy()
        for top, data, offsets in chunks(batch.column(1)):
            h, row = hashes(data, offsets)
            held.append((h, docs[top + row]))
            n += len(h)
            if n >= HELD_HASHES:
                yield rows()
                held, n = [], 0
    if n:
        yield rows()


def _runs(batches):
    """Rows of each run of equal first columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield now, rows


def _recurring(batches):
    """The hashes of each slice that two documents hold, with their occurrences."""
    for slice_, rows in _runs(batches):
        h, lo, hi, n = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64)))
        h, lo, hi, n = _reduce(h, lo, hi, n)
        keep = lo != hi
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([int(keep.sum())], pa.int64()), pa.array([int(n[keep].sum())], pa.int64()), pa.array([h[keep].tobytes()], pa.binary()), pa.array([n[keep].tobytes()], pa.binary())], ["slice", "kinds", "total", "h", "n"])


def recurring(docs: DataFrame, slices: int, hashes) -> DataFrame:
    """``slice, kinds, total, h, n`` of the hashes that two documents of ``docs`` (doc_id, text) hold."""
    rows = docs.select("doc_id", "text").mapInArrow(lambda b: _exchanged(b, slices, hashes), PACKED)
    rows = rows.repartition(shuffle_partitions(docs.sparkSession), "slice").sortWithinPartitions("slice")
    return save(rows.mapInArrow(_recurring, "slice int, kinds long, total long, h binary, n binary"))


def place(h: np.ndarray, bits: int, slices: int, probe: int) -> np.ndarray:
    """Where a hash is noted: by its top bits, or in the same slice by the bits after them."""
    at = (h >> np.uint64(64 - bits)).astype(np.int64)
    if not probe:
        return at
    inner = bits - slices
    return (at >> inner << inner) + ((h >> np.uint64(64 - bits - inner)).astype(np.int64) & (1 << inner) - 1)


def bitmap_of(found: DataFrame, slices: int) -> tuple[np.ndarray, int, int, int]:
    """The bitmap, its bits, slices and probes; each slice is made where its hashes are."""
    n = found.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    bits = min(LARGEST, max(slices + 6, (16 * n).bit_length()))
    probes = 2 if 2 * n <= 1 << bits else 1  # a fuller bitmap lets less through with one

    def run(batches):
        for batch in batches:
            for slice_, h in zip(*[batch.column(c).to_pylist() for c in ("slice", "h")], strict=True):
                h = np.frombuffer(h, np.uint64)
                part = np.zeros(1 << bits - slices, bool)
                for probe in range(probes):
                    part[place(h, bits, slices, probe) - (slice_ << bits - slices)] = True
                yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([zlib.compress(np.packbits(part).tobytes(), 1)], pa.binary())], ["slice", "bits"])

    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << bits - slices - 3
    for r in found.mapInArrow(run, "slice int, bits binary").toLocalIterator():
        out[r.slice * size : (r.slice + 1) * size] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out, bits, slices, probes


def hot_hashes(found: DataFrame, share: int = HOT) -> np.ndarray:
    """Hashes with more than a ``share``-th of all occurrences: at most ``share``."""
    total = found.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]

    def run(batches):
        for batch in batches:
            for h, n in zip(*[batch.column(c).to_pylist() for c in ("h", "n")], strict=True):
                h = np.frombuffer(h, np.int64)[np.frombuffer(n, np.int64) > total / share]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], ["h"])

    return np.sort(np.array([r.h for r in found.mapInArrow(run, "h long").collect()], np.int64).view(np.uint64))


def noted(h: np.ndarray, bitmap: np.ndarray, bits: int, slices: int, probes: int) -> np.ndarray:
    some = np.arange(len(h))
    for probe in range(probes):
        at = place(h[some], bits, slices, probe)
        some = some[(bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
    out = np.zeros(len(h), bool)
    out[some] = True
    return out


def noted_windows(data, offsets, anchor_bits):
    """Windows of a chunk's noted anchors: ``hash, row, anchor, piece, first word, base, starts, ends``."""
    h, row, first, last, base, starts, ends, words = anchors(data, offsets)
    keep = np.flatnonzero(noted(h, *anchor_bits))
    window, piece, at = windows(words, first[keep], last[keep])
    return window, row[keep][piece], h[keep][piece], piece, at, base, starts, ends


PASSAGES = "anchor long, words binary, docs binary, rows binary, starts binary"


def _passage_rows(batches, anchor_bits, window_bits, hot):
    held: dict = defaultdict(lambda: ([], [], []))
    n = 0

    def rows():
        keys = list(held)
        pack = lambda i, t: pa.array([array(t, held[k][i]).tobytes() for k in keys], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.int64()), pa.array([w for _, w in keys], pa.binary()), pack(0, "q"), pack(1, "q"), pack(2, "i")], ["anchor", "words", "docs", "rows", "starts"])

    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        ids, own = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for top, data, offsets in chunks(batch.column(1)):
            window, row, anchor, piece, at, base, starts, ends = noted_windows(data, offsets, anchor_bits)
            keep = np.flatnonzero(noted(window, *window_bits))
            if not len(keep):
                continue
            window, row, anchor, piece, at = window[keep], row[keep], anchor[keep], piece[keep], at[keep]
            # Runs of confirmed windows of an anchor; a hot anchor's windows go by themselves.
            alone = np.isin(anchor, hot)
            new = np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            key = np.where(alone, window, anchor)[first].view(np.int64)
            line = data.tobytes()
            r, a = row[first], at[first]
            places = (top + r).tolist(), (a - base[r]).tolist(), starts[a].tolist(), ends[at[last] + WINDOW - 1].tolist()
            for k, i, start, lo, hi in zip(key.tolist(), *places, strict=True):
                docs, keys, firsts = held[k, b" ".join(line[lo:hi].split())]
                docs.append(ids[i])
                keys.append(own[i])
                firsts.append(start)
            n += len(first)
            if n >= HELD_PASSAGES:
                yield rows()
                held.clear()
                n = 0
    if n:
        yield rows()


def numbered(passages: list[bytes]) -> list:
    """Each passage as one letter a word: strings, or tuples of numbers where there are more words than letters."""
    numbers: dict[bytes, int] = {}
    made = [[numbers.setdefault(w, len(numbers)) for w in words.split(b" ")] for words in passages]
    if len(numbers) > LETTERS:
        return [tuple(x) for x in made]
    letters = [chr(i + 1 if i < 0xD7FF else i + 0x801) for i in range(len(numbers))]  # without surrogates
    return ["".join([letters[i] for i in x]) for x in made]


def confirmed(texts: list, docs: list[list[int]]) -> dict:
    """The windows that two documents hold, by their words, each with the smallest of the documents."""
    least, again = {}, set()
    for text, ids in zip(texts, docs, strict=True):
        lo = min(ids)
        several = lo != max(ids)
        for j in range(len(text) - WINDOW + 1):
            w = text[j : j + WINDOW]
            old = least.setdefault(w, lo)
            if several or old != lo:
                again.add(w)
                if lo < old:
                    least[w] = lo
    return {w: least[w] for w in again}


def compiled(texts: list, least: dict):
    """The automaton of the confirmed passages: the longest runs of windows with one smallest document.

    Its values are indices of ``(windows, smallest document)``. Every confirmed window of a text is in such a run
    of that text, so the automaton finds it there, and wherever else the run stands.
    """
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS) if texts and isinstance(texts[0], str) else ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    passages: dict = {}
    for text in texts:
        run, n = None, 0
        for j in range(len(text) - WINDOW + 2):
            first = least.get(text[j : j + WINDOW])  # the piece after the last window is too short to be one
            if first == run:
                n += 1
                continue
            if run is not None:
                passages[text[j - n : j + WINDOW - 1]] = (n, run)
            run, n = first, 1
    for i, passage in enumerate(passages):
        automaton.add_word(passage, i)
    automaton.make_automaton()
    return automaton, list(passages.values())


def opened(places: list, i: int, kind: str) -> list[int]:
    return [x for p in places for x in memoryview(p[i]).cast(kind)]


def _find(merged: dict[bytes, list]):
    """Reports of one shard: documents, rows, starts of a passage, and the masks of its windows to remove."""
    docs = [opened(places, 0, "q") for places in merged.values()]
    texts = numbered(list(merged))
    automaton, values = compiled(texts, confirmed(texts, docs))
    if not values:
        return
    for text, ids, places in zip(texts, docs, merged.values(), strict=True):
        found: dict[int, int] = {}  # the windows of each smallest document
        for end, i in automaton.iter(text):
            n, first = values[i]
            found[first] = found.get(first, 0) | (1 << n) - 1 << end - WINDOW - n + 2
        if not found:
            continue
        if len(found) == 1:
            [(first, mask)] = found.items()
            masks = [mask if d > first else 0 for d in ids]
        else:
            masks = [sum(mask for first, mask in found.items() if first < d) for d in ids]
        yield ids, opened(places, 1, "q"), opened(places, 2, "i"), masks


def _shards(batches):
    """Equal passages of different tasks as one, in shards of whole anchors."""
    merged: dict[bytes, list] = {}
    size = 0
    for _, rows in _runs(batches):
        for words, *places in rows:
            if words not in merged:
                size += words.count(b" ") + 2 - WINDOW
            merged.setdefault(words, []).append(places)
        if size >= SHARD:
            yield merged
            merged, size = {}, 0
    if merged:
        yield merged


def _reports(batches):
    doc, row, start, mask = [], [], [], []

    def rows():
        some = [i for i, m in enumerate(mask) if m]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for i in some], t) for x, t in ((doc, pa.int64()), (row, pa.int64()), (start, pa.int32()), (mask, pa.int32()))], ["doc", "row", "start", "mask"])

    gc.disable()  # a shard's many small lists hold no cycles
    try:
        for shard in _shards(batches):
            for found in _find(shard):
                for held, more in zip((doc, row, start, mask), found, strict=True):
                    held += more
                if len(row) >= 50_000:
                    yield rows()
                    doc, row, start, mask = [], [], [], []
        yield rows()
    finally:
        gc.enable()


def reports(docs: DataFrame) -> DataFrame:
    """``doc, row, start, mask``: windows to remove, of ``docs`` (doc_id, text, _row)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    slices = max(10, (4 * parts).bit_length())  # more partitions, smaller slices

    def of_anchors(data, offsets):
        h, row, *_ = anchors(data, offsets)
        return h, row

    found = recurring(docs, slices, of_anchors)
    by_anchor, hot = spark.sparkContext.broadcast(bitmap_of(found, slices)), hot_hashes(found)

    def of_windows(data, offsets):
        h, row, *_ = noted_windows(data, offsets, by_anchor.value)
        return h, row

    by_window = spark.sparkContext.broadcast(bitmap_of(recurring(docs, slices, of_windows), slices))
    passages = docs.select("doc_id", "text", "_row").mapInArrow(lambda b: _passage_rows(b, by_anchor.value, by_window.value, hot), PASSAGES)
    return passages.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_reports, "doc long, row long, start int, mask int")


RESULTS = ("n_words", "n_removed", "kept_sha256")


def removal(words: list[bytes], starts, masks) -> np.ndarray:
    """Which words are covered."""
    change = np.zeros(len(words) + 1, np.int64)
    if starts:
        s, m = np.array(starts, np.int64), np.array(masks, np.int64)
        for j in range(SPAN):
            at = s[(m >> j & 1).astype(bool)] + j
            np.add.at(change, at, 1)
            np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change)[:-1] > 0


def remove(docs: DataFrame, id_col: str = "doc_id", text: str = "text", kept_text: str | None = None) -> DataFrame:
    """``docs`` plus ``n_words, n_removed, kept_sha256``, and the kept words as ``kept_text`` if it is named."""
    own = [*RESULTS, *([kept_text] if kept_text else [])]
    carried = [c for c in docs.columns if c not in own]
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    rows = packed(docs, doc=F.col(id_col).cast("long"), key=F.xxhash64(F.col(text)))
    found = reports(rows.select(F.col("doc").alias("doc_id"), F.col("row").getField(text).alias("text"), F.col("key").alias("_row")))
    # Equal rows report alike.
    found = found.groupBy("doc", F.col("row").alias("key")).agg(F.collect_set(F.struct("start", "mask")).alias("r")).select("doc", "key", F.col("r.start").alias("starts"), F.col("r.mask").alias("masks"))
    rows = rows.join(found, ["doc", "key"], "left").select("row", "starts", "masks")
    kinds = {"n_words": T.LongType(), "n_removed": T.LongType()}
    schema = T.StructType([*[docs.schema[c] for c in carried], *[T.StructField(c, kinds.get(c, T.StringType())) for c in own]])

    def run(batches):
        for batch in batches:
            n, removed, sha, kept = [], [], [], []
            row = batch.column("row")
            texts = row.field(text).cast(pa.large_binary()).to_pylist()
            for t, s, m in zip(texts, *[batch.column(c).to_pylist() for c in ("starts", "masks")], strict=True):
                words = (t or b"").split()
                n.append(len(words))
                if s:
                    gone = removal(words, s, m).tolist()
                    removed.append(sum(gone))
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                else:
                    removed.append(0)
                line = b" ".join(words)
                sha.append(hashlib.sha256(line).hexdigest())
                if kept_text:
                    kept.append(line.decode())
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if kept_text else [])]
            yield pa.RecordBatch.from_arrays([*[row.field(c) for c in carried], *made], [*carried, *own])

    return rows.mapInArrow(run, schema)


def op5_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", *RESULTS)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT r, i FROM s QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
x AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM f),
k AS (SELECT d.r, string_agg(d.w, ' ' ORDER BY d.i) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d) d ANTI JOIN x ON d.r = x.r AND d.i = x.i GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
