"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

Two-stage suffix sorting finds equal strings: suffixes smaller than their successor (type B) are sorted directly by
their first bytes; all others (type A) are induced from their successors by scanning the buckets of first bytes in
ascending order; common prefixes of neighbours then separate groups of equal strings. ``sorted_starts`` does that for
one block of text.

To give blocks that hold every copy of a string, each string is known by its anchor: the position of the least hash
among its grams of ``GRAM`` bytes. Equal strings have equal anchors, so strings meet in the block their anchor's hash
names, as runs: the bytes of consecutive strings with one anchor. Documents travel in packs of about ``PACK`` bytes:

1. packs send the hashes of their anchors, each once, to the blocks; a block answers, a bit each, which are shared by
   two documents. Hashes decide only what is looked at, never what is removed.
2. packs send the runs of shared anchors, equal runs once with the smallest id and their places; a block sorts the
   suffixes, and answers which strings have a smaller id elsewhere, by comparing bytes.
3. packs join the answers and cut the texts.

A passage that all documents share arrives at a block once a pack, however many documents hold it. The number of blocks
grows with the bytes, so a block's memory does not. An anchor in many different surroundings (a template around a varying
field) would bring them all to one block: packs send the number of different runs with each hash, and beyond ``HOT`` of
them its strings travel one by one to further blocks that their own hashes name, where equal strings still meet.

Cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing and no match crosses documents; of rows that
repeat an id none counts as smaller than the other; a null id is smaller than any other; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import cut

from .common import documents, narrow, ship
from .registry import query

LENGTH = 50
GRAM = 24
#: bytes of text in a pack and, about, behind a block
PACK, BLOCK = 8 << 20, 16 << 20
#: bytes hashed at a time, so that work stays in the cache
SPAN = 1 << 16
#: parts of a block that are sorted one after the other
PARTS = 8
HASH_BITS, PLACE_BITS = 40, 24
#: different runs of an anchor, at most 80 bytes each, that one part of a block takes; strings that are cut out at a time
HOT, STRINGS = (2 << 20) // 80, 1 << 18
NULL_ID = -(1 << 63)


# ---- suffix sorting --------------------------------------------------------------------------------------------

def words_of(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; bytes behind the text count as zero."""
    w = np.concatenate([text, np.zeros(LENGTH + 16, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        w = w[:-width] << np.uint64(8 * width) | w[width:]
    return w


def keys(words: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The first ``length`` bytes of the suffixes at ``at``, eight by eight."""
    out = []
    for k in range(0, length, 8):
        word = words[np.minimum(at + k, len(words) - 1)]
        if length - k < 8:
            word &= ~np.uint64((1 << (8 * (8 - (length - k)))) - 1)
        out.append(word)
    return out


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 1 on, one more wherever a column differs from the row before."""
    lead = np.zeros(len(columns[0]), bool)
    lead[:1] = True
    for c in columns:
        lead[1:] |= c[1:] != c[:-1]
    return np.cumsum(lead)


def sorted_starts(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the first ``length`` bytes of their suffixes, and a flag where a new string begins."""
    n = len(text)
    if not len(starts):
        return starts, np.zeros(0, bool)
    # a suffix is type B if it is smaller than its successor: the next different byte is larger
    differs = text[1:] != text[:-1]
    change = np.flatnonzero(differs)
    rising = text[change] < text[change + 1]
    type_b = np.append(rising, False)[np.concatenate([[0], np.cumsum(differs)])]
    # wanted suffixes, and the successors the induced ones hang on
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    front = starts[~type_b[starts]]
    while len(front):
        front = front[front + 1 < n] + 1
        front = front[~wanted[front]]
        wanted[front] = True
        front = front[~type_b[front]]
    # stage one: sort type B directly, word by word, only where words so far are equal
    direct = np.flatnonzero(wanted & type_b)
    eights = words_of(text)
    words = keys(eights, direct, length)
    order = np.argsort(words[0], kind="stable")
    group = _numbered(words[0][order])
    for word in words[1:]:
        lead = np.diff(group, prepend=0) != 0
        tied = np.flatnonzero(~(lead & np.append(lead[1:], True)))
        if not len(tied):
            break
        some = order[tied]
        order[tied] = some[np.lexsort((word[some], group[tied]))]
        group = _numbered(group, word[order])
    ordered_b = direct[order]
    # stage two: go through buckets of the first byte upwards; a sorted suffix induces its predecessor's place
    bucket_b = np.searchsorted(text[ordered_b], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    result = []
    for byte in range(256):
        parts = []
        if wanted[n - 1] and not type_b[n - 1] and text[n - 1] == byte:
            parts.append(np.array([n - 1]))
        parts += induced[byte]
        if parts:
            entry = np.concatenate(parts)
            # suffixes that begin with a run of this byte: one more byte of the run puts them behind
            rows, level = [entry], entry
            while len(level):
                level = level[level > 0] - 1
                level = level[(text[level] == byte) & wanted[level]]
                if len(level):
                    rows.append(level)
            bucket_a = np.concatenate(rows)
        else:
            bucket_a = np.zeros(0, np.int64)
        bucket = np.concatenate([bucket_a, ordered_b[bucket_b[byte]:bucket_b[byte + 1]]])
        result.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[wanted[before] & ~type_b[before] & (text[before] > byte)]
        if len(before):
            heads = text[before]
            by_head = before[np.argsort(heads, kind="stable")]
            edges = np.searchsorted(np.sort(heads, kind="stable"), np.arange(257))
            for head in np.unique(heads).tolist():
                induced[head].append(by_head[edges[head]:edges[head + 1]])
    chosen = np.zeros(n, bool)
    chosen[starts] = True
    array = np.concatenate(result)
    array = array[chosen[array]]
    # neighbours with a common prefix shorter than the length begin a new group
    new = np.zeros(len(array), bool)
    new[:1] = True
    for word in keys(eights, array, length):
        new[1:] |= word[1:] != word[:-1]
    return array, new


# ---- anchors and packs -----------------------------------------------------------------------------------------

_BYTES = np.random.Generator(np.random.PCG64(50)).integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = np.random.Generator(np.random.PCG64(51)).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(text: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each string start: hash of its anchor in the upper bits, the anchor's place in the lower ``PLACE_BITS``."""
    n = len(text) - length + 1
    out = np.empty(max(n, 0), np.uint64)
    window = length - gram + 1
    for low in range(0, n, SPAN):
        piece = text[low:min(len(text), low + SPAN + length - 1)]
        # hashes of grams, by doubling: a gram is made of parts whose lengths are powers of two
        level, width, parts, done = _BYTES[piece], 1, None, 0
        while True:
            if gram & width:
                parts = level if parts is None else parts[:len(level) - done] * _ODD[8] + level[done:]
                done += width
            if width * 2 > gram:
                break
            level = level[:-width] * _ODD[width.bit_length()] + level[width:]
            width *= 2
        parts = parts[:len(piece) - gram + 1]
        parts = (parts ^ parts >> np.uint64(31)) * _ODD[9]
        key = parts >> np.uint64(64 - HASH_BITS) << np.uint64(PLACE_BITS) | np.arange(low, low + len(parts), dtype=np.uint64)
        width = 1
        while width * 2 <= window:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < window:
            key = np.minimum(key[:len(key) - (window - width)], key[window - width:])
        out[low:low + len(key)] = key
    return out


def pack_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A table (pack, n_bytes, body): documents side by side, compressed; a longer document is a pack of its own."""
    def packed(batches):
        task, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        squeeze = zstandard.ZstdCompressor(level=1)

        def row():
            ids = np.array([i for i, _ in held], "<i8")
            sizes = np.array([len(t) for _, t in held], "<i8")
            raw = np.array([len(held)], "<i8").tobytes() + ids.tobytes() + sizes.tobytes() + b"".join(t for _, t in held)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq], pa.int64()), pa.array([size], pa.int64()), pa.array([squeeze.compress(raw)], pa.binary())], ["pack", "n_bytes", "body"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and size + len(text) > PACK:
                    yield row()
                    seq, held, size = seq + 1, [], 0
                held.append((doc_id, text))
                size += len(text)
        if held:
            yield row()

    rows = narrow(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return cut(rows.mapInArrow(packed, "pack long, n_bytes long, body binary"))


class Pack:
    """The documents of a pack: text, ids, where each starts, and the runs of strings with one anchor."""

    def __init__(self, body: bytes):
        raw = zstandard.ZstdDecompressor().decompress(body)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        sizes = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        self.text = np.frombuffer(raw, np.uint8, -1, 8 + 16 * n)
        self.edges = np.concatenate([[0], np.cumsum(sizes)])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first start, number of strings, document) of every run, in text order."""
        if len(self.text) < LENGTH:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none
        if len(self.text) >= 1 << PLACE_BITS:
            # only a single long document makes such a pack: it is looked at in overlapping stretches
            key = np.concatenate([self._stretch(low) for low in range(0, len(self.text) - LENGTH + 1, 1 << 23)])
        else:
            key = anchors(self.text)
        valid = np.ones(len(key), bool)
        for k in self.edges[1:-1]:
            valid[max(0, k - LENGTH + 1):k] = False
        lead = valid.copy()
        lead[1:] &= (key[1:] != key[:-1]) | ~valid[:-1]
        first = np.flatnonzero(lead)
        tail = valid.copy()
        tail[:-1] &= (key[1:] != key[:-1]) | ~valid[1:]
        count = np.flatnonzero(tail) - first + 1
        return key[first] >> np.uint64(PLACE_BITS), first, count, np.searchsorted(self.edges, first, "right") - 1

    def _stretch(self, low: int) -> np.ndarray:
        return anchors(self.text[low:low + (1 << 23) + LENGTH - 1])


def _frame(*arrays: np.ndarray) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(arrays)], "<i8").tobytes() + sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unframe(raw: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * n, []
    for kind, size in zip(types, sizes.tolist()):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _bundle(frames: list[bytes]) -> bytes:
    return np.array([len(f) for f in frames], "<i8").tobytes() + b"".join(frames)


def _unbundle(raw: bytes) -> list[bytes]:
    sizes = np.frombuffer(raw, "<i8", PARTS).tolist()
    edges = np.cumsum([8 * PARTS, *sizes]).tolist()
    return [raw[i:j] for i, j in zip(edges, edges[1:])]


def _rows(schema: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"pack": pa.int64(), "block": pa.int32(), "body": pa.binary(), "hot": pa.int64()}
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, schema)], schema)


def _split(block: np.ndarray):
    """(block, indexes) for each block present."""
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order])) + 1
    for part in np.split(order, edges) if len(order) else ():
        yield int(block[part[0]]), part


def run_marks(text: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A number for each run, equal for equal bytes."""
    out = np.empty(len(first), np.uint64)
    for low in range(0, len(first), SPAN):
        sizes = count[low:low + SPAN] + LENGTH - 1
        begin, end = int(first[low]), int(first[low:low + SPAN][-1] + sizes[-1])
        out[low:low + SPAN] = marks_of(padded(text[begin:end], first[low:low + SPAN] - begin, sizes, WIDTH), sizes)
    return out


def sent_hashes(pack: Pack, n_blocks: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, hashes in order, whether two documents of the pack share one, how many different runs each has)."""
    hashes, starts, count, doc = pack.runs()
    # documents of a hash in order: a hash whose first and last differ has two at least
    pairs = np.sort(hashes << np.uint64(PLACE_BITS) | doc.astype(np.uint64))
    mine = pairs >> np.uint64(PLACE_BITS)
    first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])[:len(mine)])
    last = np.append(first[1:], len(mine)) - 1
    once, several = mine[first], pairs[first] != pairs[last]
    # runs are told apart by the upper bits of their marks: a few may fall together
    marks = np.sort(hashes << np.uint64(PLACE_BITS) | run_marks(pack.text, starts, count) >> np.uint64(64 - PLACE_BITS))
    different = np.cumsum(np.append(True, marks[1:] != marks[:-1])[:len(marks)])
    n = np.diff(different[last], prepend=0).astype("<u4")
    return [(block, once[i], several[i], n[i]) for block, i in _split((once % np.uint64(n_blocks)).astype(np.int64))]


def shared_hashes(table: pa.Table) -> pa.Table:
    """What a block knows: for each pack a bit for each hash it sent, set if another document has it too, one set if it is hot, and the hot runs sent."""
    packs = table.column("pack").to_pylist()
    sent = [_unframe(b, "<u4", "<u1", "<u1", "<u4") for b in table.column("body").to_pylist()]
    full = [low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32) for low, high, _, _ in sent]
    every = np.sort(np.concatenate(full))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[:len(every)])
    values, common = every[first], np.diff(np.append(first, len(every))) > 1
    several = np.concatenate(full)[np.concatenate([np.unpackbits(bits, count=len(f)) for f, (_, _, bits, _) in zip(full, sent)]).astype(bool)]
    common[np.searchsorted(values, several)] = True
    block = table.column("block")[0].as_py()
    runs = np.zeros(len(values), np.int64)
    for f, (_, _, _, n) in zip(full, sent):
        runs[np.searchsorted(values, f)] += n
    hot, out = common & (runs > HOT), []
    for p, f, (_, _, _, n) in zip(packs, full, sent):
        at = np.searchsorted(values, f)
        out.append((p, block, _frame(np.packbits(common[at]), np.packbits(hot[at])), int(n[hot[at]].sum(dtype=np.int64))))
    return pa.Table.from_batches([_rows(["pack", "block", "body", "hot"], out)])


def marks_of(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each row (padded bytes)."""
    mixed = sizes.astype(np.uint64)
    words = rows.view("<u8")
    for k in range(words.shape[1]):
        mixed = (mixed ^ words[:, k]) * _ODD[10]
        mixed ^= mixed >> np.uint64(29)
    return mixed


def same_rows(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each row (padded bytes), equal for rows found to be equal; unequal numbers prove nothing."""
    mixed = marks_of(rows, sizes)
    order = np.argsort(mixed, kind="stable")
    lead = np.ones(len(order), bool)
    lead[1:] = (mixed[order][1:] != mixed[order][:-1]) | (sizes[order][1:] != sizes[order][:-1]) | (rows[order][1:] != rows[order][:-1]).any(1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(lead) - 1
    return number


def padded(text: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes from ``first`` on, zero behind their size."""
    whole = np.concatenate([text, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(whole, width)[first].copy()
    rows[np.arange(width) >= sizes[:, None]] = 0
    return rows


WIDTH = -(-(2 * LENGTH - GRAM) // 8) * 8


def sent_runs(pack: Pack, shared: dict[int, tuple[np.ndarray, np.ndarray]], n_blocks: int, n_hot: int = 0) -> list[tuple[int, bytes]]:
    """(block, frame) of the runs with a shared anchor, those of hot ones string by string in blocks behind the others."""
    hashes, first, count, doc = pack.runs()
    order = np.argsort(hashes)
    lead = np.append(True, hashes[order][1:] != hashes[order][:-1])[:len(order)]
    once = hashes[order][lead]
    known, hot = np.zeros(len(once), bool), np.zeros(len(once), bool)
    for block, i in _split((once % np.uint64(n_blocks)).astype(np.int64)):
        if block in shared:
            known[i], hot[i] = (np.unpackbits(bits, count=len(i)).astype(bool) for bits in shared[block])
    kind = np.empty(len(order), np.int64)
    kind[order] = (known.astype(np.int64) + (known & hot))[np.cumsum(lead) - 1]
    use = np.flatnonzero(kind == 1)
    place = (hashes[use] % np.uint64(n_blocks * PARTS)).astype(np.int64)
    out = _framed(pack, place, first[use], count[use], doc[use], n_blocks)
    single = np.flatnonzero(kind == 2)
    # a string begins in one run only, and a run has less than LENGTH of them
    for low in range(0, len(single), STRINGS // LENGTH):
        i = single[low:low + STRINGS // LENGTH]
        n = count[i]
        starts = np.repeat(first[i], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ones = np.ones(len(starts), np.int64)
        place = (string_hashes(pack.text, starts) % np.uint64(n_hot * PARTS)).astype(np.int64)
        out += [(n_blocks + b, frame) for b, frame in _framed(pack, place, starts, ones, np.repeat(doc[i], n), n_hot)]
    return out


def string_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    mixed = np.zeros(len(starts), np.uint64)
    for k in range(LENGTH):
        mixed = (mixed ^ _BYTES[text[starts + k]]) * _ODD[14]
        mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(8)


def _framed(pack: Pack, place: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, n_blocks: int) -> list[tuple[int, bytes]]:
    """(block, frame) of runs: equal ones once, with the smallest id and all places."""
    out: dict[int, list[bytes]] = {}
    if not len(first):
        return []
    # equal runs have one place, so they lie side by side in the order of places
    sizes, use = count + LENGTH - 1, first
    rows = padded(pack.text, first, sizes, WIDTH)
    number = same_rows(rows, sizes)
    order = np.argsort(place * (len(use) + 1) + number, kind="stable")
    heads = np.flatnonzero(np.diff(number[order], prepend=-1))
    head = order[heads]
    least = np.minimum.reduceat(pack.ids[doc][order], heads)
    spans_of = rows[head][np.arange(WIDTH) < sizes[head][:, None]]
    ends = np.concatenate([[0], np.cumsum(sizes[head])])
    bounds = np.append(heads, len(order))
    counts, times, places = count[head].astype("<u1"), np.diff(bounds).astype("<i4"), first[order].astype("<i8")
    edges = np.append(np.flatnonzero(np.diff(place[head], prepend=-1)), len(head)).tolist()
    for i, j in zip(edges, edges[1:]):
        at = int(place[head[i]])
        frame = _frame(counts[i:j], spans_of[ends[i]:ends[j]], least[i:j], times[i:j], places[bounds[i]:bounds[j]])
        out.setdefault(at % n_blocks, [b""] * PARTS)[at // n_blocks] = frame
    return [(block, _bundle(frames)) for block, frames in out.items()]


def covered_strings(table: pa.Table) -> pa.Table:
    """What a block finds: for each pack, which strings of its runs start in a document with a smaller id than its own smallest."""
    packs, block = table.column("pack").to_pylist(), table.column("block")[0].as_py()
    bodies = [_unbundle(b) for b in table.column("body").to_pylist()]
    out = [[b""] * PARTS for _ in packs]
    # a string's anchor names the part as well, so parts are sorted one after the other
    for k in range(PARTS):
        there = [i for i, frames in enumerate(bodies) if frames[k]]
        if there:
            for i, frame in zip(there, _covered([bodies[i][k] for i in there])):
                out[i][k] = frame
    return pa.Table.from_batches([_rows(["pack", "block", "body"], [(p, block, _bundle(frames)) for p, frames in zip(packs, out)])])


def _covered(frames: list[bytes]) -> list[bytes]:
    sent = [_unframe(b, "<u1", "<u1", "<i8", "<i4", "<i8") for b in frames]
    count = np.concatenate([s[0] for s in sent]).astype(np.int64)
    sizes = count + LENGTH - 1
    text = np.concatenate([s[1] for s in sent])
    least = np.concatenate([s[2] for s in sent])
    first = np.cumsum(sizes) - sizes
    # equal runs of several packs are one from here on
    number = same_rows(padded(text, first, sizes, WIDTH), sizes)
    order = np.argsort(number, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], np.diff(number[order]) != 0]))
    head = order[heads]
    smallest = np.minimum.reduceat(least[order], heads)
    kept_sizes, kept_count = sizes[head], count[head]
    body = padded(text, first[head], kept_sizes, WIDTH)[np.arange(WIDTH) < kept_sizes[:, None]]
    begin = np.cumsum(kept_sizes) - kept_sizes
    in_run = np.arange(int(kept_count.sum())) - np.repeat(np.cumsum(kept_count) - kept_count, kept_count)
    starts = np.repeat(begin, kept_count) + in_run
    owner = np.full(len(body), 0, np.int64)
    owner[starts] = np.repeat(smallest, kept_count)
    array, new = sorted_starts(body, starts)
    group = np.flatnonzero(new)
    best = np.empty(len(body), np.int64)
    best[array] = np.repeat(np.minimum.reduceat(owner[array], group), np.diff(np.append(group, len(array))))
    # back to the runs as they were sent
    mine = np.repeat(begin[number], count) + (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    smaller = best[mine] < np.repeat(least, count)
    out, at = [], 0
    for s in sent:
        n = int(s[0].sum(dtype=np.int64))
        out.append(_frame(np.packbits(smaller[at:at + n]), s[0], s[3], s[4]))
        at += n
    return out


def removed(pack: Pack, answers: list[bytes]) -> np.ndarray:
    """Which bytes of the pack are covered."""
    found = []
    for raw in (frame for answer in answers for frame in _unbundle(answer) if frame):
        bits, count, times, places = _unframe(raw, "<u1", "<u1", "<i4", "<i8")
        count = count.astype(np.int64)
        smaller = np.unpackbits(bits, count=int(count.sum())).astype(bool)
        ids = pack.ids[np.searchsorted(pack.edges, places, "right") - 1]
        owner = np.repeat(np.arange(len(count)), times)
        least = np.minimum.reduceat(ids, np.cumsum(times) - times) if len(ids) else ids
        # a string is covered everywhere if it starts elsewhere under a smaller id, else in all documents but the smallest
        begin = np.cumsum(count) - count
        reps = count[owner]
        offset = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        hit = smaller[np.repeat(begin[owner], reps) + offset] | np.repeat(ids > least[owner], reps)
        found.append((np.repeat(places, reps) + offset)[hit])
    if not found:
        return np.zeros(len(pack.text), bool)
    # a covered string opens at its start and closes behind its last byte
    opened = np.zeros(len(pack.text) + 1, np.int8)
    opened[np.concatenate(found)] = 1
    last = np.maximum.accumulate(np.where(opened[:-1] > 0, np.arange(len(pack.text)), -LENGTH))
    return np.arange(len(pack.text)) - last < LENGTH


# ---- jobs ------------------------------------------------------------------------------------------------------

def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans (start, end) and kept (bytes)."""
    ship(docs.sparkSession)
    packs = pack_documents(docs, id_col, text_col)
    n_blocks = max(1, -(-packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] // BLOCK))
    schema = "pack long, block int, body binary"

    def ask(batches):
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sent_hashes(Pack(body), n_blocks)
                yield _rows(["pack", "block", "body"], [(p, b, _frame(h.astype("<u4"), (h >> np.uint64(32)).astype("<u1"), np.packbits(m), n)) for b, h, m, n in found])

    bodies = packs.select("pack", "body")
    shared = cut(bodies.mapInArrow(ask, schema).groupBy("block").applyInArrow(shared_hashes, schema + ", hot long"))
    # a run has at most LENGTH - GRAM + 1 strings
    strings = shared.agg(F.coalesce(F.sum("hot"), F.lit(0))).first()[0] * (LENGTH - GRAM + 1)
    n_hot = max(1, -(-strings * LENGTH // BLOCK))
    shared = shared.drop("hot")

    def send(mine: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for p, body in zip(mine.column("pack").to_pylist(), mine.column("body").to_pylist()):
            bits = {b: tuple(_unframe(raw, "<u1", "<u1")) for b, raw in zip(answers.column("block").to_pylist(), answers.column("body").to_pylist())}
            rows += [(p, b, frame) for b, frame in sent_runs(Pack(body), bits, n_blocks, n_hot)]
        return pa.Table.from_batches([_rows(["pack", "block", "body"], rows)])

    runs = bodies.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(send, schema)
    found = runs.groupBy("block").applyInArrow(covered_strings, schema)

    def finish(mine: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
        for body in mine.column("body").to_pylist():
            pack = Pack(body)
            gone = removed(pack, answers.column("body").to_pylist())
            for i, doc_id in enumerate(pack.ids.tolist()):
                low, high = int(pack.edges[i]), int(pack.edges[i + 1])
                cut_out, text = gone[low:high], pack.text[low:high]
                sides = np.flatnonzero(np.diff(np.concatenate([[False], cut_out, [False]]).astype(np.int8)))
                kept = text[~cut_out].tobytes()
                for k, v in zip(out, (None if doc_id == NULL_ID else doc_id, high - low, int(cut_out.sum()), len(sides) // 2, hashlib.sha256(kept).hexdigest(), sides.tolist(), kept)):
                    out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return bodies.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(
        finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return spans(documents(spark, sf_dir)).drop("spans", "kept")
