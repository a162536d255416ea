r"""Operator 6: removal of repeated byte strings by suffix arrays.

Every byte of a 100-byte string that also starts earlier (smaller id, or earlier in
the same text) is removed. The work is done in five steps:

1. Each 100-byte window gets the smallest hash of its 24-byte grams (a minimiser). Equal windows have equal
   minimisers, so windows whose minimiser is found once in the corpus are done with: nothing is lost.
2. Texts that are copies of an earlier one as a whole are done with too. The bytes of the other texts' remaining windows are cut out and packed into shards of about ``SHARD_BYTES``.
3. Each shard gets a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's method; where a
   common prefix reaches 100 bytes, all windows but the earliest are repeats. The earliest ones go on, by minimiser.
4. Across shards, runs of windows that are the same as a whole (by a 128-bit digest) are settled by the earliest one. Of the others, the
   sorted windows of two shards are merged by binary search, shard lists pairwise until one is left; the
   later one of two equal windows is a repeat. A minimiser with more than ``HOT_ROWS`` rows left (texts that hold a
   common passage in different surroundings) is split by a second minimiser over ``SECOND``-byte grams: runs by it are settled by digest like
   the first ones, and of what is left windows are grouped by their 100 bytes.
5. Repeats are gathered by text and their bytes taken out.

Defined results: a null or empty text has no bytes; a text under 100 bytes has no window; a text of any length is read whole (a text
longer than a shard is a shard of its own); rows with the same id and the same text are one
document and each gets the result; rows with the same id and different texts are ordered by a hash of the text; a
null id comes before every other; columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import forget, type_of, written

WINDOW, GRAM = 100, 24
SHARD_BYTES, MERGE_WINDOWS, HOT_ROWS = 1 << 21, 150_000, 256
#: Bytes of text whose minimisers are found at a time: the arrays beside them stay in a processor's cache.
MINIMISER_BYTES = 1 << 16
#: Bytes of the grams of the second minimiser, which tells the windows of a hot first one apart.
SECOND = 88


# -- windows and their minimisers ------------------------------------------------------------------------------------


def minimiser_runs(data, offsets, h: T.Hasher):
    """Maximal runs of window starts of one text with one minimiser: (first, last, minimiser, occurrences of it, first run of each text), as places in ``data``."""
    n, w = len(data), WINDOW - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < WINDOW:
        return empty, empty, empty.astype(np.uint64), empty, np.zeros(len(offsets), np.int64)
    at = np.arange(n - GRAM + 1)
    gram = h.of(at, at + GRAM)
    low, size = gram, 1
    while size * 2 <= w:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    low = np.minimum(low[: len(low) - (w - size)], low[w - size :]) if size < w else low
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    valid = np.arange(len(low)) + WINDOW <= offsets[1:][doc]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    ends = np.ones(len(low), bool)
    ends[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(ends & valid)
    value = low[first]
    length = last - first + w
    begin = np.concatenate([[0], np.cumsum(length)])
    occurrences = empty
    if len(first):
        inside = np.arange(begin[-1]) - np.repeat(begin[:-1] - first, length)
        occurrences = np.add.reduceat(gram[inside] == np.repeat(value, length), begin[:-1])
    return first, last, value, occurrences, np.searchsorted(first, offsets)


def minimisers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, th, runs, selfs): each text's runs as (minimiser, first start << 32 | length), and the minimisers that one run holds twice."""
    kind = type_of(docs, id_col)
    run_type = pa.struct([("hash", pa.int64()), ("span", pa.int64())])

    def run(batches):
        table, powers, number = T.byte_table(), T.Powers(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(2), MINIMISER_BYTES):
                first, last, value, occurrences, cut = minimiser_runs(data, offsets, T.Hasher(data, table, powers))
                doc = T.owners(cut)
                spans = (first - offsets[:-1][doc]) << 32 | (last - first + 1)
                runs = pa.StructArray.from_arrays([pa.array(value.view(np.int64)), pa.array(spans)], fields=list(run_type))
                twice = occurrences > 1
                selfs = np.concatenate([[0], np.cumsum(np.bincount(doc[twice], minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(lo, hi)), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), runs), pa.ListArray.from_arrays(pa.array(selfs), pa.array(value[twice].view(np.int64)))],
                    ["doc", "id", "th", "runs", "selfs"],
                )
            number += len(batch)

    keyed = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    return written(keyed.mapInArrow(run, f"doc long, id {kind}, th long, runs array<struct<hash:long,span:long>>, selfs array<long>"), "minimisers", "zstd")


# -- one shard ---------------------------------------------------------------------------------------------------------


def refined(data: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order of at least their first ``depth`` bytes; whether each agrees with the one before it as far as they are ordered; and whether the two
    are apart at a depth of at most ``depth``. Larsson-Sadakane: groups that share h bytes are refined by
    the group of the suffix h further on, h doubles, and groups of one suffix are never touched again. The last step is as long as ``depth``
    needs, so that it tells exactly which suffixes share that many bytes."""
    n = len(data)
    # the first order is by seven bytes, 9 bits each: the end of the text sorts before every byte
    one = np.zeros(n + 7, np.uint64)
    one[:n] = data.astype(np.uint64) + np.uint64(1)
    two = one[:-1] << np.uint64(9) | one[1:]
    key = two[:n] << np.uint64(18) | two[2 : n + 2]
    key = key << np.uint64(27) | two[4 : n + 4] << np.uint64(9) | one[6 : n + 6]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    while h < depth:
        alone = new & np.append(new[1:], True)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        suffix = order[todo]
        group = rank[suffix]
        step = min(h, depth - h)
        ahead = rank[np.minimum(suffix + step, n)]
        inner = np.argsort(group * np.int64(n + 1) + ahead + 1)
        order[todo] = suffix[inner]
        ahead, group = ahead[inner], group[inner]
        start = np.ones(len(todo), bool)
        start[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        new[todo] = start
        rank[order[todo]] = np.maximum.accumulate(np.where(start, todo, 0))
        h += step
    return order, ~new, new


def suffix_array(data: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``refined``, and whether each suffix agrees with the one before it as far as they are ordered."""
    return refined(data, depth)[:2]


def common_prefixes(data: np.ndarray, order: np.ndarray, tied: np.ndarray, early: np.ndarray | None = None, cap: int = WINDOW, lanes: int = 16384) -> np.ndarray:
    """Kasai: the common prefix, up to ``cap`` bytes, of each suffix with the one before it in the order. The text is dealt
    to lanes that walk their suffixes from left to right, each one's prefix starting from its left neighbour's less one; all lanes
    take a step together. Tied suffixes agree in ``cap`` bytes; they stand in no order among themselves, so after one of them a lane starts from nothing. Suffixes that
    are ``early`` apart have a shorter prefix for sure: they get 0 and are passed over, and lanes without other suffixes are not walked."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    whole = np.zeros(n, bool)
    whole[order] = tied
    passed = whole.copy()
    if early is not None:
        passed[order] |= early
    padded = np.append(data, np.zeros(cap + 1, np.uint8))
    prefix = np.where(whole, np.int32(cap), np.int32(0))
    at = np.unique(np.linspace(0, n, min(lanes, max(1, n // 64)) + 1).astype(np.int64))
    stop, at = at[1:].copy(), at[:-1].copy()
    if len(at):
        walked = ~np.logical_and.reduceat(passed, at)
        stop, at = stop[walked], at[walked]
    h = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        reach = np.minimum(n - np.maximum(at, other), cap)
        skip = passed[at]
        same = ~skip & (other >= 0) & (h < reach) & (padded[at + h] == padded[other + h])
        h += same
        done = ~same
        prefix[at[done]] = np.where(skip, np.where(whole[at], cap, 0), h)[done]
        h[done] = np.where(skip, 0, np.maximum(h - 1, 0))[done]
        at[done] += 1
        live = at < stop
        if not live.all():
            at, stop, h = at[live], stop[live], h[live]
    return prefix[order]


def ranks_of(ids: pa.Array, th: np.ndarray) -> np.ndarray:
    """Dense rank of each row by (id, th), nulls first: equal rows are one document."""
    table = pa.table({"id": ids, "th": pa.array(th)})
    order = pc.sort_indices(table, sort_keys=[("id", "ascending"), ("th", "ascending")], null_placement="at_start").to_numpy()
    codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[order]
    step = np.zeros(len(order), np.int64)
    step[1:] = (codes[1:] != codes[:-1]) | (th[order][1:] != th[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def ranges(owner: np.ndarray, value: np.ndarray):
    """Maximal runs of consecutive values of one owner: (owner, first, last)."""
    if not len(value):
        return owner, value, value
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1] + 1)
    first = np.flatnonzero(new)
    return owner[first], value[first], value[np.append(first[1:], len(value)) - 1]


FOUND = "th long, first int, last int, hash long, d0 long, d1 long, reps binary, bytes binary"


def shard_repeats(ids: pa.Array, th: np.ndarray, texts: list[np.ndarray], runs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """The repeats inside a shard, as (id, th, first start, last start), and the runs whose earliest windows go on, with their bytes."""
    pieces, starts, text_at, doc_at, total = [], [], [], [], 0
    for k, (text, (_, span)) in enumerate(zip(texts, runs, strict=True)):
        first, stop = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
        edge = np.flatnonzero(first[1:] > stop[:-1] + WINDOW - 1) + 1
        for a, b in zip(np.append(0, edge), np.append(edge, len(first)), strict=True):
            lo, hi = int(first[a]), int(stop[b - 1]) + WINDOW - 1
            pieces.append(text[lo:hi])
            starts.append(total)
            text_at.append(lo)
            doc_at.append(k)
            total += hi - lo
    data = np.concatenate(pieces)
    starts, text_at, doc_at = np.array(starts), np.array(text_at), np.array(doc_at)
    # windows as places in the shard
    run_doc = np.repeat(np.arange(len(runs)), [len(r[1]) for r in runs])
    hashes, spans = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    run_first, run_len = spans >> 32, spans & 0xFFFFFFFF
    piece_key = doc_at.astype(np.int64) << 40 | text_at
    piece = np.searchsorted(piece_key, run_doc.astype(np.int64) << 40 | run_first, "right") - 1
    run_at = starts[piece] + run_first - text_at[piece]
    begin = np.concatenate([[0], np.cumsum(run_len)])
    window = np.arange(begin[-1]) + np.repeat(run_at - begin[:-1], run_len)
    valid = np.zeros(len(data), bool)
    valid[window] = True
    order, tied, early = refined(data)
    group = np.cumsum(common_prefixes(data, order, tied, early) < WINDOW)
    held = valid[order]
    suffix, group = order[held], group[held]
    place = np.searchsorted(starts, suffix, "right") - 1
    when = ranks_of(ids, th)[doc_at[place]] << 40 | (suffix - starts[place] + text_at[place])
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    repeat = np.zeros(len(data), bool)
    if len(suffix):
        earliest = np.repeat(np.minimum.reduceat(when, cut), np.diff(np.append(cut, len(suffix))))
        repeat[suffix] = when > earliest
    again = np.flatnonzero(repeat)
    place = np.searchsorted(starts, again, "right") - 1
    doc, lo, hi = ranges(doc_at[place], again - starts[place] + text_at[place])
    # runs with a window that is not a repeat
    left = np.flatnonzero(~repeat[window])
    each = np.searchsorted(left, begin)
    count = np.diff(each)
    some = count > 0
    head, tail = left[each[:-1][some]], left[each[1:][some] - 1]
    reps = (left - np.repeat(head, count[some])).astype("<u4")
    reps_at = (np.append(0, np.cumsum(count[some])) * 4).astype(np.int64)
    firsts = run_first[some] + head - begin[:-1][some]
    lasts = firsts + tail - head
    raw = data.tobytes()
    texts_out = [raw[a:b] for a, b in zip(window[head].tolist(), (window[tail] + WINDOW).tolist(), strict=True)]
    reps = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(reps_at), pa.py_buffer(reps)]).cast(pa.binary())
    none = len(lo)
    digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in texts_out), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([ids.take(pa.array(doc)), ids.take(pa.array(run_doc[some]))]), pa.array(np.concatenate([th[doc], th[run_doc[some]]])),
            pa.array(np.concatenate([lo, firsts])).cast(pa.int32()),
            pa.array(np.concatenate([hi, lasts])).cast(pa.int32()),
            *(pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(x)]) for x in (hashes[some], digests[:, 0], digests[:, 1])), pa.concat_arrays([pa.nulls(none, pa.binary()), reps]), pa.array([*[None] * none, *texts_out], pa.binary()),
        ],
        ["id", "th", "first", "last", "hash", "d0", "d1", "reps", "bytes"],
    )


def _shards(batches):
    ids, th, texts, runs, size = [], [], [], [], 0

    def one():
        return shard_repeats(pa.concat_arrays(ids), np.array(th, np.int64), texts, runs)

    for batch in batches:
        column, listed, keys = T.strings(batch.column(2)), batch.column(3).flatten(), batch.column(1).to_numpy()
        hashes, spans = listed.field(0).to_numpy(), listed.field(1).to_numpy()
        cut = np.append(0, np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())).tolist()
        for k in range(len(batch)):
            h, s = hashes[cut[k] : cut[k + 1]], spans[cut[k] : cut[k + 1]]
            order = np.argsort(s, kind="stable")
            text = np.frombuffer(column[k].as_buffer(), np.uint8)
            ids.append(batch.column(0).slice(k, 1))
            th.append(keys[k])
            texts.append(text)
            runs.append((h[order], s[order]))
            size += min(len(text), int((s & 0xFFFFFFFF).sum()) + len(s) * WINDOW)
            if size >= SHARD_BYTES:
                yield one()
                ids, th, texts, runs, size = [], [], [], [], 0
    if ids:
        yield one()


# -- across shards -----------------------------------------------------------------------------------------------------


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], when: np.ndarray, repeat: np.ndarray, text: np.ndarray):
    """Two lists of distinct windows (hash, number), sorted by hash, as one; of two equal windows the later is marked in ``repeat``. The places of b's windows in a are
    found by binary search, and their bytes (``text``) compared."""
    at = np.searchsorted(a[0], b[0])
    near = np.minimum(at, len(a[0]) - 1)
    equal = a[0][near] == b[0]
    met = np.flatnonzero(equal)
    equal[met] = (text[a[1][near[met]]] == text[b[1][met]]).all(1)
    x, y = a[1][near[equal]], b[1][equal]
    repeat[y[when[y] > when[x]]] = True
    repeat[x[when[x] > when[y]]] = True
    kept = a[1].copy()
    kept[near[equal]] = np.where(when[y] < when[x], y, x)
    rest = ~equal
    return np.insert(a[0], at[rest], b[0][rest]), np.insert(kept, at[rest], b[1][rest])


def windows_of(table: pa.Table):
    """The (row, start, 100 bytes, hash of these) of each window that the rows bring."""
    reps = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("reps")]
    row = np.repeat(np.arange(len(reps)), [len(x) for x in reps])
    inside = np.concatenate(reps).astype(np.int64) if reps else np.zeros(0, np.int64)
    raw = [x.as_buffer() for x in table.column("bytes")]
    base = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[:-1]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = base[row].astype(np.int64) + inside
    text = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at] if len(row) else np.zeros((0, WINDOW), np.uint8)
    hashes = T.Hasher(data, T.byte_table(), T.Powers()).of(at, at + WINDOW)
    return row, table.column("first").to_numpy()[row].astype(np.int64) + inside, np.ascontiguousarray(text), hashes


def merge_shards(table: pa.Table) -> pa.RecordBatch:
    """The repeats among the windows of whole minimiser groups: (id, th, first start, last start)."""
    table = table.combine_chunks()
    ids, th = table.column("id").combine_chunks(), table.column("th").to_numpy()
    rank = ranks_of(ids, th)
    row, start, text, keys = windows_of(table)
    when = rank[row] << 40 | start
    shard = np.unique(table.column("shard").to_numpy(), return_inverse=True)[1][row]
    repeat = np.zeros(len(row), bool)
    lists = []
    by_shard = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[by_shard], prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(row)), strict=True):
        mine = by_shard[a:b]
        mine = mine[np.lexsort((when[mine], keys[mine]))]
        new = np.ones(len(mine), bool)
        new[1:] = keys[mine][1:] != keys[mine][:-1]
        alike = np.flatnonzero(~new)
        new[alike] = (text[mine[alike]] != text[mine[alike - 1]]).any(1)
        head = np.maximum.accumulate(np.where(new, np.arange(len(mine)), 0))
        repeat[mine[when[mine] > when[mine[head]]]] = True  # equal rows of one document only
        lists.append((keys[mine[new]], mine[new]))
    while len(lists) > 1:
        lists = [merged(*lists[k : k + 2], when, repeat, text) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
    hit = np.flatnonzero(repeat)
    hit = hit[np.lexsort((start[hit], row[hit]))]
    owner, lo, hi = ranges(row[hit], start[hit])
    return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(th[owner]), pa.array(lo).cast(pa.int32()), pa.array(hi).cast(pa.int32())], ["id", "th", "first", "last"])


def _merges(batches):
    """Rows come sorted by minimiser; groups are kept whole."""
    held: list[pa.RecordBatch] = []

    def size(batch):
        return sum(len(x.as_buffer()) // 4 for x in batch.column("reps"))

    total = 0
    for batch in batches:
        held.append(batch)
        total += size(batch)
        if total < MERGE_WINDOWS:
            continue
        table = pa.Table.from_batches(held)
        h = table.column("hash").to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
        if cut:
            lo = 0
            weights = np.cumsum([len(x.as_buffer()) // 4 for x in table.column("reps")])
            while lo < cut:  # whole groups, about MERGE_WINDOWS windows at a time
                hi = int(np.searchsorted(weights, (weights[lo - 1] if lo else 0) + MERGE_WINDOWS, "right"))
                hi = min(cut, int(np.searchsorted(h, h[min(max(hi, lo + 1), len(h)) - 1], "right")))
                yield merge_shards(table.slice(lo, hi - lo))
                lo = hi
            rest = table.slice(cut)
            held = rest.combine_chunks().to_batches()
            total = sum(map(size, held))
    if held and sum(map(len, held)):
        yield merge_shards(pa.Table.from_batches(held))


def _seconds(batches):
    """Of the rows of hot minimisers, the runs of windows with one smallest hash of their ``SECOND``-byte grams, and a digest of each run's bytes."""
    table, powers, grams = T.byte_table(7), T.Powers(), WINDOW - SECOND + 1
    for batch in batches:
        for lo in range(0, len(batch), 4000):
            part = pa.Table.from_batches([batch.slice(lo, 4000)])
            reps = [np.frombuffer(x.as_buffer(), "<u4") for x in part.column("reps")]
            raw = [x.as_buffer() for x in part.column("bytes")]
            base = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            row = np.repeat(np.arange(len(reps)), [len(x) for x in reps])
            inside = np.concatenate(reps).astype(np.int64)
            at = base[row] + inside
            every = np.arange(max(len(data) - SECOND + 1, 0))
            gram = T.Hasher(data, table, powers).of(every, every + SECOND)
            low = gram[at]
            for k in range(1, grams):
                low = np.minimum(low, gram[at + k])
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1) | (low[1:] != low[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row)) - 1
            texts = [data[a : b + WINDOW].tobytes() for a, b in zip(at[first], at[last], strict=True)]
            digests = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in texts), np.int64).reshape(-1, 2)
            owner = pa.array(row[first])
            start = part.column("first").to_numpy()[row[first]].astype(np.int64) + inside[first]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").combine_chunks().take(owner), part.column("th").combine_chunks().take(owner), pa.array(start).cast(pa.int32()), pa.array(start + inside[last] - inside[first]).cast(pa.int32()),
                    pa.array(low[first].view(np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([np.arange(n, dtype="<u4").tobytes() for n in (last - first + 1).tolist()], pa.binary()), pa.array(texts, pa.binary()),
                ],
                ["id", "th", "first", "last", "hash", "d0", "d1", "reps", "bytes"],
            )


def _hot(batches):
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = pa.Table.from_batches([batch.slice(lo, 500)])
            row, start, text, _ = windows_of(part)
            at = pa.array(row)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(row), [None, pa.py_buffer(text.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id").combine_chunks().take(at), part.column("th").combine_chunks().take(at), pa.array(start).cast(pa.int32()), flat], ["id", "th", "first", "window"])


def _settled(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of windows, equal ones by ``key``, its first part their minimiser: (the distinct ones, the later of equal ones, the earliest rows of distinct ones that share a minimiser, with the number ``rows`` of these)."""
    ahead = rows.select("id", "th", "first", "last", *key)
    runs = written(ahead.groupBy(*key).agg(F.min(F.struct("id", "th", "first")).alias("earliest"), F.count("*").alias("n")), "runs")
    later = ahead.join(runs.where("n > 1").select(*key, "earliest"), key).where(F.struct("id", "th", "first") > F.col("earliest"))
    later = written(later.select("id", "th", "first", "last"), "later-runs")
    counts = runs.groupBy(key[0]).agg(F.count("*").alias("rows")).where("rows > 1")
    left = runs.join(counts, key[0]).select(*key, "earliest", "rows")
    return runs, later, rows.join(left, key).where(F.struct("id", "th", "first").eqNullSafe(F.col("earliest")))


def later_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, first, last): all windows of the texts that are, by their SHA-256, copies of an earlier one."""
    text = docs[text_col].cast("binary")
    each = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), F.octet_length(text).alias("size"), F.sha2(text, 256).alias("digest")).where(F.col("size") >= WINDOW)
    each = written(each, "digests")
    firsts = each.groupBy("digest").agg(F.min(F.struct("id", "th")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = each.join(firsts, "digest").where(F.struct("id", "th") > F.col("earliest"))
    later = written(later.select("id", "th", F.lit(0).alias("first"), (F.col("size") - WINDOW).cast("int").alias("last")).distinct(), "later-copies")
    forget(each)
    return later


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, first, last): runs of window starts whose 100 bytes start earlier too."""
    kind = type_of(docs, id_col)
    found = minimisers(docs, id_col, text_col)
    twice = found.select(F.explode(F.concat(F.col("runs.hash"), "selfs")).alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    twice = written(twice, "repeated-minimisers")
    each = found.select("doc", F.explode("runs").alias("r")).select("doc", F.col("r.hash").alias("hash"), F.col("r.span").alias("span"))
    wanted = each.join(twice, "hash", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("hash", "span")).alias("runs"))
    copies = later_copies(docs, id_col, text_col)  # they bring no window that their first copy does not
    gone = copies.select(F.col("id").alias("c_id"), F.col("th").alias("c_th"))
    named = found.select("doc", "id", "th").join(gone, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left_anti")
    wanted = wanted.join(named.dropDuplicates(["id", "th"]), "doc").select("id", "th", "runs")
    texts = docs.select(docs[id_col].alias("k"), F.xxhash64(docs[text_col]).alias("kh"), docs[text_col].alias("text"))
    cut = texts.join(wanted, texts["k"].eqNullSafe(wanted["id"]) & (texts["kh"] == wanted["th"])).select("id", "th", "text", "runs")

    def shards(batches):
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(_shards(batches)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part << 20 | k] * len(batch), pa.int64())], [*batch.schema.names, "shard"])

    inside = written(cut.mapInArrow(shards, f"id {kind}, {FOUND}, shard long"), "shard-repeats", "zstd")
    forget(found, twice)
    # the same run of windows in several shards: all but the earliest are repeats (what a run holds beside its
    # earliest windows are repeats inside its shard); different runs with one minimiser may share windows
    key = ["hash", "d0", "d1"]
    runs, later, left = _settled(inside.where("hash is not null"), key)
    left = written(left.select("id", "th", "first", "hash", "reps", "bytes", "shard", "rows"), "run-variants", "zstd")
    out = f"id {kind}, th long, first int, last int"
    few = left.where(F.col("rows") <= HOT_ROWS).drop("rows")
    across = written(few.repartition("hash").sortWithinPartitions("hash").mapInArrow(_merges, out), "merged")
    many = left.where(F.col("rows") > HOT_ROWS).drop("rows", "hash")
    # a hot minimiser's windows by a second, longer one: windows that reach beyond a common passage mostly hold a gram that is found once,
    # and what the passage holds itself are equal runs again
    second = written(many.mapInArrow(_seconds, f"id {kind}, {FOUND}"), "second-runs", "zstd")
    again, later_again, variants = _settled(second, key)
    single = written(variants.mapInArrow(_hot, f"id {kind}, th long, first int, window binary"), "hot-windows", "zstd")
    firsts = written(single.groupBy("window").agg(F.min(F.struct("id", "th", "first")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"), "hot-firsts")
    split = single.join(firsts, "window").where(F.struct("id", "th", "first") > F.col("earliest")).select("id", "th", "first", F.col("first").alias("last"))
    here = inside.where("hash is null").select("id", "th", "first", "last")
    every = written(reduce(DataFrame.union, [copies, here, later, across, later_again, split]), "repeats")
    forget(inside, runs, later, left, across, second, again, later_again, single, firsts)
    return every


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes; they need not be whole UTF-8)."""
    kind = type_of(docs, id_col)
    found = repeats(docs, id_col, text_col).groupBy("id", "th").agg(F.collect_list((F.col("first").cast("long") * F.lit(2**32)) + F.col("last")).alias("spans"))
    texts = docs.select(docs[id_col].alias("k"), F.xxhash64(docs[text_col]).alias("kh"), docs[text_col].alias("text"))
    both = texts.join(found, texts["k"].eqNullSafe(found["id"]) & (texts["kh"] == found["th"]), "left").select("k", "text", "spans")

    def run(batches):
        for batch in batches:
            text, spans = T.strings(batch.column(1)).cast(pa.large_binary()), batch.column(2)
            size = pc.binary_length(text).to_numpy().astype(np.int64)
            removed, n_spans = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            kept = text.to_pylist()
            for k in np.flatnonzero(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False) > 0):
                s = np.sort(spans[int(k)].values.to_numpy())
                lo, hi = s >> 32, (s & 0xFFFFFFFF) + WINDOW
                reach = np.maximum.accumulate(hi)
                new = np.ones(len(s), bool)
                new[1:] = lo[1:] > reach[:-1]
                a, b = lo[new], reach[np.append(np.flatnonzero(new)[1:], len(s)) - 1]
                removed[k], n_spans[k] = (b - a).sum(), len(a)
                raw = kept[k]
                kept[k] = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(removed), pa.array(n_spans), pa.array(kept, pa.binary())], ["k", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("k", id_col)
