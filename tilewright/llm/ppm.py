"""Language-model scoring by prediction by partial matching over bytes.

The model reads a text as its lower-cased words, each closed by a space, and an end
mark.  A byte is predicted from up to ``ORDER`` preceding bytes of the text, across word
ends (zeros before the text).  The context trie holds a count for every context and next
byte of the training texts.  A byte not seen in a context escapes to the next shorter one
with probability (t + 1) / (n + t + 1), n the counted bytes there and t those counted
once, whose number tells how often new ones come; a seen byte of count c has
c / (n + t + 1).  Bytes that the longer context has seen are removed first (symbol
exclusion); below order 0 the remaining byte values are equally likely.  Contexts of over
two bytes that occur fewer than ``LEAST`` times predict nothing.  The code lengths are
pretrained: all training text is counted first, then every text is scored.

Scale.  A byte's probability depends on its window of ORDER + 1 bytes alone.  Texts are
cut into chunks of ``CHUNK_BYTES``; a chunk asks for its distinct windows, sorted and
compressed to about a byte each, in ranges dealt by the three latest context bytes.  A
range thus holds whole subtrees of the trie: one task merges the asks of its range as it
decodes them, fits the trie's levels 3 to ORDER over the distinct windows and answers
every chunk in the order asked.  Levels 0 to 2 are summed over all texts first; at most
2 ** 24 counts, they go to the workers.  Words are counted the same way, by their bytes.
No document id is ever a grouping key, so repeated or null ids deal evenly.  A task holds
one chunk, or its range's compressed asks and distinct windows; answers leave a few chunks at
a time.

Nothing but the narrow result is written.  Texts are read anew to meet their answers, so
a chunk's name holds its partition, its place there and a checksum of its texts: an input
that comes in another order after a lost executor cannot meet answers of other texts, it
fails.  Give such an input as a written table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import stash, table
from tilewright.llm.kernel import IS_SPACE, chunks, rolling, span_hashes

ORDER = 7  # with the predicted byte, the eight bytes of a 64-bit window; at least 3, at most 7
LEAST = 4
SPACE, END = 0x20, 0x0A
CHUNK_BYTES = 5 << 20
RANGE_BYTES = 16 << 20
MERGE_KEYS = 2_000_000
SEGMENT = 1 << 20
ANSWER_ROWS = 256

SYMBOL = np.uint64(0xFF)
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library frees by itself
    _LIBC = None
WINDOWS, WORDS = range(2)  # kinds of asks
TEXTS = "chunk string, texts binary"
ASKS = "chunk string, kind int, part int, names binary, counts binary"
ANSWERS = "chunk string, kind int, part int, found binary, total long, known long"


def context_mask(order: int) -> np.uint64:
    """Mask of a window's ``order`` latest context bytes, which are its highest, and of its symbol."""
    return np.uint64(((1 << (8 * order)) - 1) << (64 - 8 * order)) | SYMBOL


def give_back() -> None:
    """Return freed memory to the system: a worker that has finished a chunk waits beside others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


# ---------------------------------------------------------------- packing


def pack(values: np.ndarray) -> bytes:
    """Integers or floats, compressed plane by plane of their bytes."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def short(values: np.ndarray) -> np.ndarray:
    """32-bit floats rounded to 16 significant bits: the last byte is zero and costs nothing packed."""
    return ((values.astype(np.float32).view(np.uint32) + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pack_words(words: pa.Array) -> bytes:
    spans = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    sizes = pack(np.diff(spans).astype(np.uint32))
    body = words.buffers()[2].slice(int(spans[0]), int(spans[-1] - spans[0]))
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(body)


def unpack_words(data: bytes) -> pa.Array:
    cut = 8 + int.from_bytes(data[:8], "little")
    sizes = unpack(data[8:cut], np.uint32).astype(np.int64)
    body = zstandard.ZstdDecompressor().decompress(data[cut:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(body)])


# ---------------------------------------------------------------- a chunk of texts


@dataclass
class Reading:
    """Texts as the model reads them: bytes end to end, and the starts of texts and tokens.

    A token is a word with its space, or the end mark; the starts have one more entry
    than texts or tokens.
    """

    flat: np.ndarray
    texts: np.ndarray
    tokens: np.ndarray
    first: np.ndarray  # per text its first token


def read_texts(texts: pa.Array | pa.ChunkedArray) -> Reading:
    flats, sizes, counts = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for chunk in chunks(texts):
        words, low = chunk.words(), chunk.lowered()
        length = words.ends - words.starts
        size = np.ones(len(length) + len(chunk), np.int64)  # end marks stay one byte
        size[np.arange(len(length)) + words.owners()] += length
        ends = np.cumsum(size)
        flat = np.full(ends[-1], SPACE, np.uint8)
        flat[ends[words.first[1:] + np.arange(len(chunk))] - 1] = END
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False  # every token closes with one byte that is not a word's
        flat[inside] = low[~IS_SPACE[low]]
        flats.append(flat)
        sizes.append(size)
        counts.append(np.diff(words.first) + 1)
    tokens = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    return Reading(np.concatenate(flats), tokens[first], tokens, first)


def windows(reading: Reading) -> np.ndarray:
    """Per byte its window: the latest context byte highest, ..., the byte itself lowest."""
    padded = np.concatenate((np.zeros(7, np.uint8), reading.flat))
    out = np.ndarray(len(reading.flat), "<u8", padded, strides=(1,)) << np.uint64(8)  # eight bytes from each place
    out |= reading.flat
    if ORDER < 7:
        out &= context_mask(ORDER)
    size = np.diff(reading.texts)
    for age in range(min(ORDER, int(size.max(initial=0)))):  # nothing of the text before
        out[reading.texts[:-1][size > age] + age] &= context_mask(age) if age else SYMBOL
    return out


def distinct(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at], np.diff(at, append=len(ordered))


def joined(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of both arrays in order, and how often each is in ``own``; sorts both.

    By sorting alone: NumPy's union hashes, which costs ten times as much on windows.
    """
    own.sort()
    other.sort()
    (own, often), (other, _) = distinct(own), distinct(other)
    every = np.concatenate((own, other))
    every.sort()
    every, _ = distinct(every)
    counts = np.zeros(len(every), np.uint32)
    counts[np.searchsorted(every, own)] = often
    return every, counts


def by_range(place: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by range number, and the ranges' bounds; small numbers sort by digits."""
    place = place.astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
    order = np.argsort(place, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(place, minlength=ranges))))


def dealt(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted windows by (range, window), and the ranges' bounds."""
    return by_range(((keys >> np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(ranges), ranges)


def distinct_words(reading: Reading, ranges: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens in order of range, the ranges' bounds, and every token's place among them."""
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(reading.tokens) - 1, [None, pa.py_buffer(reading.tokens), pa.py_buffer(reading.flat)])
    coded = tokens.dictionary_encode()
    names, places = coded.dictionary, coded.indices.to_numpy()
    spans = np.frombuffer(names.buffers()[1], np.int64, len(names) + 1, names.offset * 8)
    data = np.frombuffer(names.buffers()[2], np.uint8) if len(names) else np.zeros(0, np.uint8)
    place = (span_hashes(rolling(data), spans[:-1], spans[1:]) >> np.uint64(20)) % np.uint64(ranges)
    order, cut = by_range(place, ranges)
    back = np.empty(len(order), np.int32)
    back[order] = np.arange(len(order), dtype=np.int32)
    return names.take(pa.array(order)), cut, back[places]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The chunks of a partition with their names; a longer text is a chunk of its own."""
    held: list[pa.RecordBatch] = []
    size = number = 0

    def name() -> str:
        seen = 0
        for batch in held:
            for text in batch.column("text"):
                seen = crc32(text.as_buffer(), seen)
        return f"{TaskContext.get().partitionId()}-{number}-{seen:08x}"

    for batch in batches:
        at = 0
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        while at < len(batch):
            gone = ends[at - 1] if at else 0
            to = max(at + (not held), int(np.searchsorted(ends, gone + CHUNK_BYTES - size, "right")))
            held.append(batch.slice(at, to - at))
            size += int((ends[to - 1] if to else 0) - gone)
            at = to
            if size >= CHUNK_BYTES or at < len(batch):
                yield name(), pa.Table.from_batches(held).combine_chunks()
                held, size, number = [], 0, number + 1
    if held:
        yield name(), pa.Table.from_batches(held).combine_chunks()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of TEXTS: every chunk as one compressed table."""
    for name, rows in _cut(batches):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
            writer.write_table(rows)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])


def _trained(rows: pa.Table) -> np.ndarray:
    return ~rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def low_codes(keys: np.ndarray) -> np.ndarray:
    """The two latest context bytes and the symbol of windows."""
    return (keys >> np.uint64(48) << np.uint64(8)) | (keys & SYMBOL)


def short_codes(reading: Reading) -> np.ndarray:
    """low_codes of every byte's window, from three bytes alone."""
    flat = reading.flat
    out = flat.astype(np.uint32)
    out[1:] |= flat[:-1].astype(np.uint32) << np.uint32(16)
    out[2:] |= flat[:-2].astype(np.uint32) << np.uint32(8)
    size = np.diff(reading.texts)
    out[reading.texts[:-1]] &= np.uint32(0xFF)
    out[reading.texts[:-1][size > 1] + 1] &= np.uint32(0xFF00FF)
    return out


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): a partition's training counts of levels 0 to 2."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for _, rows in _cut(batches):
        reading = read_texts(rows.column("text"))
        codes = short_codes(reading)[np.repeat(_trained(rows), np.diff(reading.texts))]
        codes.sort()
        own, often = distinct(codes)
        found = [merge([*found, (own.astype(np.uint64), often)])]
    yield pa.RecordBatch.from_arrays([pa.array(found[0][0].astype(np.int64)), pa.array(found[0][1])], ["code", "n"])


def _asks(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ASKS: per chunk and range its distinct windows and words with their training counts."""

    def asked_windows(reading: Reading, trained: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        keys, mask = windows(reading), np.repeat(trained, np.diff(reading.texts))
        own, other = keys[mask], keys[~mask]
        del keys, mask
        every, counts = joined(own, other)
        del own, other
        order, cut = dealt(every, ranges)
        for r in np.flatnonzero(np.diff(cut)):
            at = order[cut[r] : cut[r + 1]]
            yield WINDOWS, int(r), pack_sorted(every[at]), pack(counts[at])

    def asked_words(reading: Reading, trained: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
        words, cut, places = distinct_words(reading, ranges)
        counts = np.bincount(places[np.repeat(trained, np.diff(reading.first))], minlength=len(words)).astype(np.uint32)
        for r in np.flatnonzero(np.diff(cut)):
            own = slice(cut[r], cut[r + 1])
            yield WORDS, int(r), pack_words(words[own]), pack(counts[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rows in _cut(batches):
            reading, trained = read_texts(rows.column("text")), _trained(rows)
            for asked in (asked_windows, asked_words):
                out = [(name, *row) for row in asked(reading, trained)]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["chunk", "kind", "part", "names", "counts"])
                del out
            del reading, trained

    return run


# ---------------------------------------------------------------- the trie


@dataclass
class Level:
    """Per node of one order: its byte's count, and of its context the counted, distinct and once-counted bytes;
    the log probability after escaping from the next longer context, and with this one as the longest."""

    c: np.ndarray
    n: np.ndarray
    d: np.ndarray
    t: np.ndarray
    escape: np.ndarray
    start: np.ndarray

    def at(self, *places: np.ndarray) -> Level:
        return Level(*(v[places] for v in (self.c, self.n, self.d, self.t, self.escape, self.start)))


def _code(c, n, t, new):
    """Log probability of a byte with count c, or of an escape and then ``new``."""
    return np.where(c > 0, np.log10(np.maximum(c, 1)), np.log10(t + 1) + new) - np.log10(n + t + 1)


def level(c, n, d, t, x, x_once, low: Level, least: int = 1) -> Level:
    """The next longer order.  ``x`` and ``x_once``: what the shorter context counts, and counts once, of the bytes that this one has seen."""
    live, fresh, once = low.n - x, low.d - d, low.t - x_once
    escape = np.where(fresh > 0, _code(low.c, live, once, low.escape), low.escape)
    return Level(c, n, d, t, escape, np.where(n < least, low.start, _code(c, n, t, escape)))


class Roots:
    """Levels 0 to 2 of the trie, from all (code, count) of the two latest context bytes and the symbol."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order].astype(np.uint64), counts[order].astype(np.float64)
        context, symbol = (self.codes >> np.uint64(8)).astype(np.int64), (self.codes & SYMBOL).astype(np.int64)
        one = np.bincount((context >> 8) * 256 + symbol, weights=self.counts, minlength=65536).reshape(256, 256)
        zero = one.sum(0)
        n, d, t = zero.sum(), float((zero > 0).sum()), float((zero == 1).sum())
        full = lambda v: np.full(256, float(v))
        equal = full(-np.log10(max(256 - d, 1.0)))
        start = _code(zero, n, t, equal) if n else full(-np.log10(256.0))
        zeroth = Level(zero, full(n), full(d), full(t), equal, start)
        sums = lambda v: np.broadcast_to(v.sum(1, keepdims=True).astype(float), one.shape)
        seen = one > 0
        self.first = level(one, sums(one), sums(seen), sums(one == 1), sums(seen * zero), sums(seen * (zero == 1)), zeroth)
        below = one[context >> 8, symbol]
        self.sums = [np.bincount(context, weights=w, minlength=65536) for w in (self.counts, np.ones(len(context)), self.counts == 1, below, below == 1)]

    def second(self, keys: np.ndarray) -> Level:
        """Level 2 for windows."""
        codes = low_codes(keys)
        c = np.zeros(len(codes))
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            c = np.where(self.codes[at] == codes, self.counts[at], 0.0)
        context = (codes >> np.uint64(8)).astype(np.int64)
        return level(c, *(v[context] for v in self.sums), self.first.at((keys >> np.uint64(56)).astype(np.int64), (keys & SYMBOL).astype(np.int64)))


def trie_scores(keys: np.ndarray, counts: np.ndarray, roots: Roots) -> np.ndarray:
    """log10 probability of each window's last byte, from all distinct sorted windows of whole three-byte contexts."""
    if not len(keys):
        return np.zeros(0)
    nodes, held, ups = [keys], [counts.astype(np.float64)], []
    for order in range(ORDER - 1, 1, -1):
        shorter, up = np.unique(nodes[-1] & context_mask(order), return_inverse=True)
        held.append(np.bincount(up, weights=held[-1], minlength=len(shorter)))
        nodes.append(shorter)
        ups.append(up)
    low = roots.second(nodes.pop())
    held.pop()
    while nodes:
        c, own = held.pop(), nodes.pop()
        low = low.at(ups.pop())
        context = np.cumsum(np.concatenate(([True], (own[1:] ^ own[:-1]) > SYMBOL))) - 1  # sorted: a context's nodes lie together
        total = lambda v: np.bincount(context, weights=v)[context]  # noqa: B023, E731
        seen = c > 0
        low = level(c, total(c), total(seen), total(c == 1), total(low.c * seen), total((low.c == 1) & seen), low, LEAST)
    return low.start


def merge(asks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts."""
    keys, which = np.unique(np.concatenate([k for k, _ in asks]), return_inverse=True)
    return keys, np.bincount(which, weights=np.concatenate([n for _, n in asks]), minlength=len(keys)).astype(np.int64)


def _answer(roots: Roots) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The answers to all asks of one kind and range, ``ANSWER_ROWS`` chunks at a time; the compressed asks alone are held."""

    def windows_found(asked: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        held = []
        for batch in asked:
            held.append(batch.column("names"))
            for name, count in zip(batch.column("names"), batch.column("counts"), strict=True):
                pending.append((unpack_sorted(name.as_py()), unpack(count.as_py(), np.uint32)))
                if sum(len(k) for k, _ in pending) > MERGE_KEYS:
                    pending = [merge(pending)]
        keys, counts = merge(pending)
        scores = short(trie_scores(keys, counts, roots))
        del pending, counts
        give_back()
        for names in held:
            for name in names:
                yield pack(scores[np.searchsorted(keys, unpack_sorted(name.as_py()))])

    def words_found(asked: Iterator[pa.RecordBatch]) -> tuple[list[bytes], int, int]:
        words, counts = [], []
        for batch in asked:
            words += [unpack_words(x.as_py()) for x in batch.column("names")]
            counts += [unpack(x.as_py(), np.uint32) for x in batch.column("counts")]
        coded = pa.concat_arrays(words).dictionary_encode()
        which = coded.indices.to_numpy()
        total = np.bincount(which, weights=np.concatenate(counts), minlength=len(coded.dictionary)).astype(np.int64)
        found = [pack(total[own].astype(np.uint32)) for own in np.split(which, np.cumsum([len(w) for w in words])[:-1])]
        return found, int(total.sum()), int((total > 0).sum())

    def run(asked: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[str] = []
        first = next(asked)
        kind, part = first.column("kind")[0].as_py(), first.column("part")[0].as_py()

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in chain([first], asked):
                chunk.extend(batch.column("chunk").to_pylist())
                yield batch

        found, total, known = (windows_found(noted()), 0, 0) if kind == WINDOWS else words_found(noted())
        found, at = iter(found), 0
        while own := list(islice(found, ANSWER_ROWS)):
            yield _answers(chunk[at : at + len(own)], kind, part, own, total, known)
            total, known, at = 0, 0, at + len(own)
        give_back()

    return run


def _answers(chunk: list[str], kind: int, part: int, found: list[bytes], total: int, known: int) -> pa.RecordBatch:
    """A row per chunk; the range's sums stand in the first."""
    rows = len(chunk)
    first = lambda v: pa.array([v] + [0] * (rows - 1), pa.int64())
    return pa.record_batch(
        {
            "chunk": pa.array(chunk, pa.string()),
            "kind": pa.array([kind] * rows, pa.int32()),
            "part": pa.array([part] * rows, pa.int32()),
            "found": pa.array(found, pa.binary()),
            "total": first(total),
            "known": first(known),
        }
    )


def _totals(ranges: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Per text of a chunk its sums; a last row without texts carries the sums of the chunk's ranges."""

    def run(text: pa.Table, answers: pa.Table) -> pa.Table:
        rows = pa.ipc.open_stream(text.column("texts")[0].as_py()).read_all()
        reading = read_texts(rows.column("text"))
        found = {(k, p): f for k, p, f in zip(*(answers.column(x).to_pylist() for x in ("kind", "part", "found")), strict=True)}
        words, cut, places = distinct_words(reading, ranges)
        counts = np.concatenate([unpack(found[WORDS, int(r)], np.uint32) for r in np.flatnonzero(np.diff(cut))])[places]
        per_text = lambda x: np.add.reduceat(x, reading.first[:-1])
        known, plain = per_text((counts > 0).astype(np.int64)), per_text(np.log10(counts + 1.0))
        del words, counts, places
        keys = windows(reading)
        every, _ = distinct(np.sort(keys))
        at, cut = dealt(every, ranges)
        scores = np.empty(len(every), np.float32)
        scores[at] = np.concatenate([unpack(found[WINDOWS, int(r)], np.float32) for r in np.flatnonzero(np.diff(cut))])
        found.clear()
        per_byte = np.empty(len(keys), np.float32)
        for k in range(0, len(keys), SEGMENT):  # sorted look-ups stay in the cache
            part = keys[k : k + SEGMENT]
            order = np.argsort(part)
            per_byte[k + order] = scores[np.searchsorted(every, part[order])]
        score = np.add.reduceat(per_byte, reading.texts[:-1], dtype=np.float64)
        del keys, every, scores, per_byte
        n = rows.num_rows
        end = lambda x, last: pa.array([*x.tolist(), last])
        total, known_words = (pc.sum(answers.column(x)).as_py() or 0 for x in ("total", "known"))
        return pa.table(
            {
                "doc_id": pa.concat_arrays([*rows.column("doc_id").chunks, pa.nulls(1, rows.column("doc_id").type)]),
                "held_out": pa.concat_arrays([*rows.column("held_out").chunks, pa.nulls(1, pa.bool_())]),
                "n_tokens": end(np.diff(reading.first), None),
                "n_known": end(known, None),
                "plain": end(plain, None),
                "score": end(score, None),
                "total": pa.array([None] * n + [total], pa.int64()),
                "known": pa.array([None] * n + [known_words], pa.int64()),
            }
        )

    return run


def score_documents(docs: DataFrame, held_out: Callable[[Column], Column]) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held_out`` maps the doc_id column to a boolean column; null counts as false.  A
    null or empty text is its end mark alone.  Without training rows every byte is
    equally likely.  Equal rows score alike, an empty table gives no rows, and extra
    columns, clashing names included, are not used.  A byte's score is rounded to 16 significant bits.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    ranges = max(1, ceil(size / RANGE_BYTES))
    low = rows.mapInArrow(_low, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    roots = Roots(low.column("code").to_numpy(), low.column("n").to_numpy())
    answers = rows.mapInArrow(_asks(ranges), ASKS).groupBy("kind", "part").applyInArrow(_answer(roots), ANSWERS)
    sums = "n_tokens long, n_known long, plain double, score double, total long, known long"
    met = rows.mapInArrow(_texts, TEXTS).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_totals(ranges), f"doc_id {kind}, held_out boolean, {sums}")
    scored = stash(met, "scores")
    total, known = scored.agg(F.sum("total"), F.sum("known")).first()
    n, v = total or 0, known or 0
    base = F.col("plain") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    return scored.where("total IS NULL").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), lambda i: F.crc32(F.encode(i.cast("string"), "UTF-8")) % 7 == 2)
