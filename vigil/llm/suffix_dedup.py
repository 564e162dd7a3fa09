"""Removal of repeated passages by a sparse, distributed suffix array.

A byte is removed if a window of ``WINDOW`` bytes that covers it also starts
earlier: in a smaller doc_id, or earlier in the same document.

Sorting every suffix would move each byte a hundred times over.  Only suffixes
at *anchors* are sorted: positions whose ``KEY``-byte hash is the least of some
window.  Each window of ``WINDOW`` bytes contains the whole key of at least one
anchor, chosen by its bytes alone, so equal windows share an anchor at the same
place.  Steps:

1. Documents are dealt by hash into blocks; that shuffle is reused throughout.
   Each block reports its anchor hashes, once each, and those that occur twice
   anywhere are found by one window count.
2. Each block cuts out the surroundings of the anchors that are shared (the
   suffix and the bytes before it).  Equal surroundings within a block are
   settled there.  A key that occurs more than ``HOT_ROWS`` times, such as a line
   in many documents between other neighbours, sends no surroundings: the windows
   whose least key it is are settled one by one, and each leaves a block once.
3. Sampled splitters range-partition the suffixes by their leading bytes.  A
   bucket sorts its suffixes by multikey quicksort and takes runs with a common
   key; within a run each window's first occurrence is found from the bytes on
   both sides of the key.  Splitters are cut to the key's length, so a run lies
   on one side of each boundary.  Windows of hot keys are dealt to the buckets by
   their hash, so no bucket holds more than a row per block for any of them.
4. The repeated spans return to the blocks, which cut them out.

Windows are compared through 64-bit hashes of their bytes on either side of an
equal key, those of hot keys through 96 bits of hashes of all their bytes.

Defined results: a null text is empty; documents shorter than a window keep all
bytes; a null doc_id comes before all others; rows that share a doc_id are
documents of their own, in order of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import blocks_for, releasing, text_bytes, then_release

WINDOW = 100
KEY = 32
SIDE = WINDOW - KEY             # bytes beside a key that a window can hold
BLOCK_BYTES = 8 << 20
SAMPLED_DOCS = 2_000            # documents whose anchors give the splitters
MAX_SPLITTERS = 16_384          # beyond it, ranges are divided by a hash of the key
HOT_ROWS = 1 << 15              # a key that occurs more often is settled window by window; a suffix takes about 1 kB in a bucket
SETTLED_WINDOWS = 1 << 18       # windows of hot keys that a block settles at once
PIECE_ROWS = 1 << 15            # rows that a block collects before they become one Arrow batch
RUN_ROWS = 1 << 14              # suffixes of whole runs that a bucket compares at once
NTH_SHIFT = 40                  # a position's upper bits number the documents that share a doc_id
NO_ID = -(1 << 63)
HOT = -1                        # ``before`` of a hot key's window; ``until`` and ``after`` hold its hashes
ROWS = "bucket long, around binary, before int, after int, doc long, at long, until long"
ROWS_ARROW = pa.schema([("bucket", pa.int64()), ("around", pa.binary()), ("before", pa.int32()), ("after", pa.int32()), ("doc", pa.int64()), ("at", pa.int64()), ("until", pa.int64())])
SPANS_ARROW = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("until", pa.int64())])
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[1]
    return h ^ (h >> np.uint64(29))


def key_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``KEY`` bytes from each position on, by doubling the length."""
    h, size = mixed((data.astype(np.uint64) + np.uint64(1)) * _C[0]), 1
    while size < KEY:
        h = mixed(h[:-size] * _C[2] + h[size:])
        size *= 2
    return h


def _sliding(values: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """``best`` of every ``width`` neighbours: blocks of that width, scanned from both ends."""
    n = len(values)
    full = np.full(-(-n // width) * width, np.uint64(fill))
    full[:n] = values
    grid = full.reshape(-1, width)
    ahead = best.accumulate(grid, axis=1).reshape(-1)
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(behind[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors, ascending, and their key hashes."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = key_hashes(data)
    width = SIDE + 1
    least = _sliding(h, width, np.minimum, (1 << 64) - 1)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum, 0) == h)
    return at, h[at]


def hot_windows(data: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of windows whose least key hash is among ``hot`` (ascending), and two hashes of each."""
    h = key_hashes(data)
    least = _sliding(h, SIDE + 1, np.minimum, (1 << 64) - 1)
    p = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)] == least)
    first, last = (mixed(h[q] * _C[2] + h[q + KEY]) for q in (p, p + WINDOW - 2 * KEY))  # 64 bytes each, which overlap
    return p, mixed(first * _C[2] + last), (mixed(last * _C[3] + first) >> np.uint64(33)).astype(np.int32)


def surroundings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``SIDE`` bytes before each anchor, its key and ``SIDE`` bytes after; zeros beyond the ends."""
    padded = np.zeros(len(data) + 2 * SIDE, np.uint8)
    padded[SIDE:SIDE + len(data)] = data
    return padded[at[:, None] + np.arange(SIDE + KEY + SIDE)]


def _row_hashes(rows: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view(np.uint64)
    h = mixed(before.astype(np.uint64) * _C[0] + after.astype(np.uint64) + np.uint64(1))
    for i in range(words.shape[1]):
        h = mixed(h * _C[2] + words[:, i])
    return h


def _documents(block: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """``row, doc, shifted number among equal ids, bytes`` in order of (id, text); the bytes stay in the Arrow buffers."""
    ids, raw = block.column("doc_id").to_numpy(), block.column("raw")
    order = np.argsort(ids, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1], [True]])) if len(ids) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        some = order[lo:hi].tolist()
        if len(some) > 1:
            some.sort(key=lambda i: raw[i].as_py())
        for nth, i in enumerate(some):
            yield i, int(ids[i]), nth << NTH_SHIFT, np.frombuffer(raw[i].as_buffer(), np.uint8)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: each block's anchor hashes with their number."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("raw"), strict=True):
            _, h = anchors(np.frombuffer(raw.as_buffer(), np.uint8))
            if len(h):
                held.setdefault(block, []).append(h)
    for block, parts in held.items():
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.record_batch([pa.array(np.full(len(h), block, dtype=np.int64)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["block", "key", "n"])


class _Rows:
    """Rows of ``ROWS``, collected as arrays and turned into Arrow batches of bounded size."""

    TYPES = (np.int64, None, np.int32, np.int32, np.int64, np.int64, np.int64)

    def __init__(self):
        self.pending: list[tuple] = []
        self.waiting = 0
        self.batches: list[pa.RecordBatch] = []

    def add(self, bucket: np.ndarray, around: np.ndarray | None, before, after, doc, at: np.ndarray, until) -> None:
        """``around`` has a row of bytes per row, or is None; scalars hold for all rows."""
        if len(at):
            self.pending.append((bucket, around, before, after, doc, at, until))
            self.waiting += len(at)
            if self.waiting >= PIECE_ROWS:
                self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        sizes = [len(r[5]) for r in self.pending]
        sent = np.repeat([r[1] is not None for r in self.pending], sizes)
        data = np.concatenate([r[1].reshape(-1) for r in self.pending if r[1] is not None] or [np.empty(0, np.uint8)])
        offsets = np.concatenate([[0], np.cumsum(np.where(sent, SIDE + KEY + SIDE, 0))]).astype(np.int32)
        around = pa.Array.from_buffers(pa.binary(), len(sent), [pa.py_buffer(np.packbits(sent, bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        columns = [around if t is None else pa.array(np.concatenate([np.full(n, r[i], dtype=t) if np.ndim(r[i]) == 0 else r[i].astype(t) for r, n in zip(self.pending, sizes, strict=True)]))
                   for i, t in enumerate(self.TYPES)]
        self.batches.append(pa.record_batch(columns, schema=ROWS_ARROW))
        self.pending, self.waiting = [], 0

    def table(self) -> pa.Table:
        self.flush()
        return pa.Table.from_batches(self.batches, schema=ROWS_ARROW)


def splitters(docs: DataFrame, n: int) -> list[bytes]:
    """At most ``n`` - 1 keys that cut a bounded sample of suffixes evenly."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            for raw in b.column("raw"):
                data = np.frombuffer(raw.as_buffer(), np.uint8)
                at, _ = anchors(data)
                out += [data[p:p + KEY].tobytes() for p in at[::max(1, len(at) // 50)].tolist()]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["key"])

    total = docs.count()
    share = min(1.0, SAMPLED_DOCS / max(total, 1))
    sample = sorted(r["key"] for r in docs.sample(share, seed=11).select("raw").mapInArrow(releasing(keys), "key binary").collect())
    return sorted({bytes(sample[len(sample) * i // n]) for i in range(1, n)}) if sample else []


def _cut_out(cuts: list[bytes], parts: int):
    """Step 2 for one block."""
    bounds = np.array([int.from_bytes(c[:8], "big") for c in cuts], dtype=np.uint64)
    full = np.array(cuts, dtype=object)
    n_buckets = (len(cuts) + 1) * parts

    def bucket_of(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        lead = np.ascontiguousarray(keys[:, :8]).view(">u8").reshape(-1).astype(np.uint64)
        low = np.searchsorted(bounds, lead, side="left")
        high = np.searchsorted(bounds, lead, side="right")
        for i in np.flatnonzero(low != high):  # several splitters share the first eight bytes, or it equals one
            low[i] += int(np.searchsorted(full[low[i]:high[i]], keys[i].tobytes(), side="right"))
        return low.astype(np.int64) * parts + (hashes % np.uint64(parts)).astype(np.int64)

    def settled(windows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], seen: np.ndarray, out: _Rows) -> np.ndarray:
        """Adds rows for windows of hot keys (``doc, nth, positions, two hashes`` per
        document): new ones are sent, others are repeats.  Returns all hashes seen."""
        doc, nth = (np.array([w[i] for w in windows], dtype=np.int64) for i in (0, 1))
        which = np.repeat(np.arange(len(windows)), [len(w[2]) for w in windows])
        p, code, check = (np.concatenate([w[i] for w in windows]) for i in (2, 3, 4))
        new = np.zeros(len(p), bool)
        new[np.unique(code, return_index=True)[1]] = True
        if len(seen):
            new &= seen[np.minimum(np.searchsorted(seen, code), len(seen) - 1)] != code
        out.add((code[new] % np.uint64(n_buckets)).astype(np.int64), None, HOT, check[new], doc[which[new]], p[new] + nth[which[new]], code[new].view(np.int64))
        start = (which[~new] << NTH_SHIFT) + p[~new]
        spans = union(start, start + WINDOW)
        if len(spans):
            at, low = spans[:, 0] >> NTH_SHIFT, (1 << NTH_SHIFT) - 1
            out.add(doc[at] % n_buckets, None, 0, 0, doc[at], (spans[:, 0] & low) + nth[at], spans[:, 1] & low)
        return np.sort(np.concatenate([seen, code[new]]))

    def run(block: pa.Table, shared: pa.Table) -> pa.Table:
        keys, is_hot = shared.column("key").to_numpy().view(np.uint64), shared.column("hot").to_numpy()
        wanted, hot = np.sort(keys[~is_hot.astype(bool)]), np.sort(keys[is_hot.astype(bool)])
        seen: set[int] = set()
        out = _Rows()
        windows, n_windows, seen_windows = [], 0, np.empty(0, np.uint64)
        for _, doc, nth, data in _documents(block) if len(keys) else ():
            at, h = anchors(data)
            if len(hot) and len(h) and (hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h).any():
                windows.append((doc, nth, *hot_windows(data, hot)))
                n_windows += len(windows[-1][2])
                if n_windows >= SETTLED_WINDOWS:
                    seen_windows = settled(windows, seen_windows, out)
                    windows, n_windows = [], 0
            if not len(wanted):
                continue
            place = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            keep = wanted[place] == h
            at, h = at[keep], h[keep]
            for lo in range(0, len(at), 1 << 15):
                p, hp = at[lo:lo + (1 << 15)], h[lo:lo + (1 << 15)]
                rows = surroundings(data, p)
                before, after = np.minimum(p, SIDE), np.minimum(len(data) - KEY - p, SIDE)
                code, first = np.unique(_row_hashes(rows, before, after), return_index=True)
                new = np.array([c not in seen for c in code.tolist()], dtype=bool)
                seen.update(code.tolist())
                send = np.zeros(len(p), bool)
                send[first[new]] = True
                if send.any():
                    out.add(bucket_of(rows[send, SIDE:SIDE + KEY], hp[send]), rows[send], before[send], after[send], doc, p[send] + nth, 0)
                known = ~send
                # every window at this anchor was seen earlier in this block
                start, end = (p - np.minimum(before, SIDE))[known], (p + KEY + after)[known]
                spans = union(start[end - start >= WINDOW], end[end - start >= WINDOW])
                if len(spans):
                    out.add(doc % n_buckets, None, 0, 0, doc, spans[:, 0] + nth, spans[:, 1])
        if windows:
            settled(windows, seen_windows, out)
        return out.table()

    return lambda block, shared: then_release(run, block, shared)


def union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch, merged; rows ``start, end``, ascending."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return np.stack([start[new], end[last]], axis=1)


def multikey_quicksort(words: np.ndarray, small: int = 256) -> np.ndarray:
    """Order of the rows of ``words`` (big-endian words as integers): partition
    by one word into less, equal and greater; only equal rows look at the next word."""
    n, width = words.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == width:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort(words[part, depth:].T[::-1])]
            continue
        v = words[part, depth]
        pivot = np.sort(v[[0, len(v) // 4, len(v) // 2, 3 * len(v) // 4, -1]])[2]
        less, same = v < pivot, v == pivot
        a, b = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([part[less], part[same], part[~less & ~same]])
        stack += [(lo, lo + a, depth), (lo + a, lo + a + b, depth + 1), (lo + a + b, hi, depth)]
    return order


def _repeated(doc: np.ndarray, at: np.ndarray, code: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, at, until`` of the windows of hot keys that another one precedes."""
    order = np.lexsort((at, doc, check, code))
    doc, at, code, check = doc[order], at[order], code[order], check[order]
    again = np.concatenate([[False], (code[1:] == code[:-1]) & (check[1:] == check[:-1])])[:len(doc)]
    return doc[again], at[again], (at[again] & ((1 << NTH_SHIFT) - 1)) + WINDOW


def _whole_runs(run: np.ndarray) -> Iterator[np.ndarray]:
    """Places of ``run`` in pieces of whole runs, about ``RUN_ROWS`` each, ascending within a piece."""
    order = np.argsort(run, kind="stable")
    edges = np.append(np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]])), len(run))
    lo = 0
    while lo < len(run):
        hi = int(edges[min(np.searchsorted(edges, lo + RUN_ROWS), len(edges) - 1)])
        yield np.sort(order[lo:hi])
        lo = hi


def _resolve(bucket: pa.Table) -> pa.Table:
    """Step 3 for one bucket: ``doc, at, until`` of repeated spans."""
    before, after, doc, at, until = (bucket.column(c).to_numpy() for c in ("before", "after", "doc", "at", "until"))
    column = bucket.column("around")
    sent, hot = column.is_valid().to_numpy().astype(bool), before == HOT
    out = [(doc[~sent & ~hot], at[~sent & ~hot], until[~sent & ~hot])]
    if hot.any():
        out.append(_repeated(doc[hot], at[hot], until[hot], after[hot]))
    if sent.any():
        texts = []
        for chunk in column.chunks:  # rows without surroundings are empty there
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
            texts.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].reshape(-1, SIDE + KEY + SIDE))
        order = np.lexsort((at[sent], doc[sent]))
        out += _compared(np.concatenate(texts)[order], *(c[sent][order].astype(np.int64) for c in (before, after, doc, at)))
    return pa.table([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(3)], schema=SPANS_ARROW)


def _compared(around: np.ndarray, before: np.ndarray, after: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``doc, at, until`` of repeated spans among suffixes in order of (doc, at)."""
    suffix = np.zeros((len(at), -(-WINDOW // 8) * 8), np.uint8)
    suffix[:, :WINDOW] = around[:, SIDE:]
    words = suffix.view(">u8").astype(np.uint64)
    del suffix
    order = multikey_quicksort(words)
    lead = words[order, :KEY // 8]
    run = np.empty(len(at), np.int64)
    run[order] = np.cumsum(np.concatenate([[True], (lead[1:] != lead[:-1]).any(axis=1)]))
    del words, lead, order
    _, first = np.unique(_row_hashes(around, before, after), return_index=True)
    head = np.zeros(len(at), bool)
    head[first] = True
    # all windows of later rows with the same surroundings are repeats
    start, end = (at - before)[~head], (at + KEY + after)[~head]
    whole = end - start >= WINDOW
    yield doc[~head][whole], start[whole], (end & ((1 << NTH_SHIFT) - 1))[whole]
    mixed_runs = np.bincount(run[head], minlength=run.max() + 1) > 1
    candidates = np.flatnonzero(head & mixed_runs[run])  # ascending, hence in order of (doc, at)
    for piece in _whole_runs(run[candidates]):
        some = candidates[piece]
        here = around[some]
        right = np.empty((SIDE + 1, len(some)), np.uint64)
        right[0] = run[some].astype(np.uint64) * _C[3]
        for i in range(SIDE):
            right[i + 1] = mixed(right[i] * _C[2] + here[:, SIDE + KEY + i] + np.uint64(1))
        left = np.full(len(some), 7, np.uint64)
        repeat = np.zeros((len(some), SIDE + 3), bool)
        for j in range(SIDE + 1):  # windows that start j bytes before the key
            fits = np.flatnonzero((before[some] >= j) & (after[some] >= SIDE - j))
            _, one = np.unique(mixed(left[fits] * _C[1] + right[SIDE - j][fits]), return_index=True)
            again = np.ones(len(fits), bool)
            again[one] = False
            repeat[fits[again], j + 1] = True
            if j < SIDE:
                left = mixed(left * _C[2] + here[:, SIDE - 1 - j] + np.uint64(1))
        step = np.diff(repeat.astype(np.int8), axis=1)
        r, lo = np.nonzero(step == 1)
        _, hi = np.nonzero(step == -1)  # first and last offsets of each stretch of repeated windows
        p = at[some][r]
        yield doc[some][r], p - (hi - 1), (p - lo + WINDOW) & ((1 << NTH_SHIFT) - 1)


def _spans_by_document(spans: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Merged spans of each (document, shifted number among equal ids)."""
    doc, at, until = (spans.column(c).to_numpy() for c in ("doc", "at", "until"))
    nth = at >> NTH_SHIFT
    order = np.lexsort((at, nth, doc))
    doc, nth, at, until = doc[order], nth[order], (at & ((1 << NTH_SHIFT) - 1))[order], until[order]
    ends = np.flatnonzero(np.concatenate([(doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1]), [True]])) + 1 if len(doc) else []
    found, lo = {}, 0
    for hi in ends:
        found[int(doc[lo]), int(nth[lo]) << NTH_SHIFT] = union(at[lo:hi], until[lo:hi])
        lo = hi
    return found


NO_SPANS = np.empty((0, 2), np.int64)


def _removed(finish, schema: pa.Schema):
    """Step 4 for one block: each document and its merged spans go to ``finish``."""

    def run(block: pa.Table, spans: pa.Table) -> pa.Table:
        found = _spans_by_document(spans)
        rows = [finish(d, data, found.get((d, n), NO_SPANS)) for _, d, n, data in _documents(block)]
        return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return lambda block, spans: then_release(run, block, spans)


def kept_bytes(data: np.ndarray, spans: np.ndarray) -> bytes:
    if not len(spans):
        return data.tobytes()
    edges = [0, *spans.reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))


def _texts(d: int, x: np.ndarray, s: np.ndarray) -> tuple:
    return d, len(x), s.reshape(-1).tolist(), kept_bytes(x, s)


def _digests(d: int, x: np.ndarray, s: np.ndarray) -> tuple:
    return d, len(x), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(kept_bytes(x, s)).hexdigest()


def _blocks_and_spans(docs: DataFrame, others: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Documents dealt to blocks (``doc_id, raw, *others, block``), and the
    repeated spans with the block of their document."""
    raw = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_bytes("text").alias("raw"), *others)
    total = raw.agg(F.sum(F.octet_length("raw"))).first()[0]
    n_blocks = blocks_for(total, BLOCK_BYTES)
    ranges = min(2 * n_blocks, MAX_SPLITTERS)
    cuts, parts = splitters(raw, ranges), -(-2 * n_blocks // ranges)
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("long")
    blocks = raw.withColumn("block", block_of("doc_id")).repartition(n_blocks, "block")
    reported = blocks.mapInArrow(releasing(_reported), "block long, key long, n int")
    shared = (reported.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).where("all > 1")
              .select("block", "key", (F.col("all") > HOT_ROWS).alias("hot")))
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_cut_out(cuts, parts), ROWS)
    spans = sent.groupBy("bucket").applyInArrow(lambda bucket: then_release(_resolve, bucket), "doc long, at long, until long").withColumn("block", block_of("doc"))
    return blocks, spans


def _deduplicated(docs: DataFrame, finish, schema: pa.Schema, columns: str) -> DataFrame:
    blocks, spans = _blocks_and_spans(docs, [])
    out = blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_removed(finish, schema), columns)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans`` (starts and ends of removed bytes, alternating) and the bytes ``kept``."""
    return _deduplicated(docs, _texts, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())]),
                         "doc_id long, n_bytes long, spans array<long>, kept binary")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; the kept bytes stay inside the worker."""
    return _deduplicated(docs, _digests, pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string())]),
                         "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, their texts without repeated spans.  Bytes that
    a cut leaves of a character go with it; ``n_chars``, if there, follows a
    changed text; documents of which nothing stays go."""
    names = [c for c in docs.columns if c != "text"]
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    blocks, spans = _blocks_and_spans(docs, [*others, F.col("text").isNull().alias("no_text")])

    def run(block: pa.Table, spans: pa.Table) -> pa.Table:
        found = _spans_by_document(spans)
        missing = block.column("no_text").to_pylist()
        order, texts, changed = [], [], []
        for i, doc, nth, data in _documents(block):
            cut = found.get((doc, nth), NO_SPANS)
            order.append(i)
            texts.append(None if missing[i] else kept_bytes(data, cut).decode("utf-8", "ignore"))
            changed.append(len(cut) > 0)
        out = block.take(order).select([f"c{i}" for i in range(len(names))])
        out = out.append_column("text", pa.array(texts, pa.string())).append_column("changed", pa.array(changed, pa.bool_()))
        return out.filter(pa.array([not c or t != "" for c, t in zip(changed, texts, strict=True)], pa.bool_()))

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"c{i} {types[c]}" for i, c in enumerate(names)), "text string", "changed boolean"])
    out = blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(lambda block, spans: then_release(run, block, spans), schema)
    place = {c: F.col(f"c{i}") for i, c in enumerate(names)} | {"text": F.col("text")}
    if "n_chars" in place:
        place["n_chars"] = F.when(F.col("changed"), F.length("text").cast(types["n_chars"])).otherwise(place["n_chars"])
    return out.select(*[place[c].alias(c) for c in docs.columns])
