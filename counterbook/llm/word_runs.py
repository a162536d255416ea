r"""Operator 11: periodic runs of words, by descending-LCP Kruskal.

A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_exponent`` periods long, that no
neighbouring word extends. Per text:

1. Words get numbers, and suffixes are ranked by prefix doubling over 1, 2, 4 ... words; only classes of two or more suffixes are refined.
   Suffixes that share fewer words with any other than a run can have fall out before the rest of the work.
2. The ranks kept from each doubling give the exact common prefix of neighbours in suffix order.
3. Neighbours are united by decreasing common prefix (Kruskal), with union-find over classes that hold their positions
   in order; the smaller class is put into the larger one. Two positions i < j that become neighbours in a class when it is united at common
   prefix L repeat with distance d = j - i where d <= L. That is a seed of a run of period d; where the word before i differs
   from the word before j, i is the run's start and d + L its whole length. The start of a run and the position one period on
   become neighbours at just that L (a position between them would give a smaller period), so each run is found, once.

Scale. Map-only: a text is one row, its runs never reach beyond it, and texts are worked on in slices of about ``SLICE_WORDS`` words, so a task's memory
depends on the slice or on the longest text. No shuffle, nothing through the driver.

Defined results: a null or empty text has no words and no runs; a text of any length is read whole; rows with equal ids are treated one by one, a null id
like any other; columns beside id and text are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import type_of

SLICE_WORDS = 1 << 18


# -- suffixes in order, and their common prefixes ------------------------------------------------------------------------


def shared_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``least`` words may occur elsewhere, in suffix order, and the words that each one shares with the one before it (0 across
    classes). ``ids``: dense word numbers, different in different texts, so no common prefix crosses a border."""
    n = len(ids)
    size = np.bincount(ids)
    rank = np.append((np.cumsum(size) - size)[ids], -1).astype(np.int64)
    active = np.flatnonzero(size[ids] > 1)
    levels, h, found = [(1, rank.astype(np.int32))], 1, active
    while len(active):
        group = rank[active]
        key = group * np.int64(n + 1) + rank[np.minimum(active + h, n)] + 1
        by = np.argsort(key)
        active, key, group = active[by], key[by], group[by]
        at = np.arange(len(active))
        opens, begins = np.ones(len(active), bool), np.ones(len(active), bool)
        opens[1:] = group[1:] != group[:-1]
        begins[1:] = key[1:] != key[:-1]
        rank[active] = group + np.maximum.accumulate(np.where(begins, at, 0)) - np.maximum.accumulate(np.where(opens, at, 0))
        active = active[~(begins & np.append(begins[1:], True))]
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        if h <= least:
            found = active
    found = found[np.argsort(rank[found])]
    shared = np.zeros(len(found), np.int64)
    if len(found):
        i, j, far = found[:-1], found[1:], np.zeros(len(found) - 1, np.int64)
        for step, ranks in reversed(levels):
            far += np.where(ranks[np.minimum(i + far, n)] == ranks[np.minimum(j + far, n)], step, 0)
        shared[1:] = far
    return found, shared


# -- classes of positions --------------------------------------------------------------------------------------------------


class Blocks:
    """A large set of positions in order, in blocks, so that putting one in moves few others."""

    SIZE = 2048

    def __init__(self, items: list[int]):
        self.parts = [items[k : k + self.SIZE] for k in range(0, len(items), self.SIZE)]
        self.heads = [p[0] for p in self.parts]
        self.count = len(items)

    def __len__(self) -> int:
        return self.count

    def __iter__(self):
        return (x for p in self.parts for x in p)

    def insert(self, x: int) -> None:
        k = max(bisect_right(self.heads, x) - 1, 0)
        part = self.parts[k]
        insort(part, x)
        self.heads[k] = part[0]
        self.count += 1
        if len(part) > 2 * self.SIZE:
            self.parts[k : k + 1] = [part[: self.SIZE], part[self.SIZE :]]
            self.heads.insert(k + 1, part[self.SIZE])

    def beside(self, x: int) -> tuple[int | None, int | None]:
        """The positions before and after ``x``, which is in the set."""
        k = bisect_right(self.heads, x) - 1
        part = self.parts[k]
        i = bisect_left(part, x)
        before = part[i - 1] if i else self.parts[k - 1][-1] if k else None
        after = part[i + 1] if i + 1 < len(part) else self.parts[k + 1][0] if k + 1 < len(self.parts) else None
        return before, after


def new_neighbours(large, small) -> list[tuple[int, int]]:
    """Puts ``small`` into ``large``; the pairs of positions, one of each, that stand next to one another now."""
    if len(small) == 1 and isinstance(large, list):
        (x,) = small
        i = bisect_left(large, x)
        pairs = [(large[i - 1], x)] if i else []
        if i < len(large):
            pairs.append((x, large[i]))
        large.insert(i, x)
        return pairs
    added, pairs = set(small), []
    if isinstance(large, list):
        large.extend(small)
        large.sort()
        for x in small:
            i = bisect_left(large, x)
            if i and large[i - 1] not in added:
                pairs.append((large[i - 1], x))
            if i + 1 < len(large) and large[i + 1] not in added:
                pairs.append((x, large[i + 1]))
        return pairs
    for x in small:
        large.insert(x)
    for x in small:
        before, after = large.beside(x)
        if before is not None and before not in added:
            pairs.append((before, x))
        if after is not None and after not in added:
            pairs.append((x, after))
    return pairs


def least_shared(min_length: int, min_exponent: int) -> int:
    """The fewest words that the start of a run shares with the position one period on."""
    return min(max(min_length - q, (min_exponent - 1) * q, 1) for q in range(1, min_length + 1))


def word_runs(ids: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the texts in ``ids``, by start, then period."""
    least = least_shared(min_length, min_exponent)
    place, shared = shared_suffixes(ids, least)
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    place, word = place.tolist(), ids
    parent = list(range(len(place)))
    classes: dict[int, list[int] | Blocks] = {}
    found = []

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k, common in zip(edges.tolist(), shared[edges].tolist(), strict=True):
        a, b = root(k - 1), root(k)
        one, two = classes.pop(a, None) or [place[a]], classes.pop(b, None) or [place[b]]
        if len(one) < len(two):
            a, b, one, two = b, a, two, one
        for i, j in new_neighbours(one, two):
            d = j - i
            if d <= common and d + common >= max(min_length, min_exponent * d) and (i == 0 or word[i - 1] != word[j - 1]):
                found.append((i, d + common, d))
        parent[b] = a
        classes[a] = Blocks(one) if isinstance(one, list) and len(one) > 2 * Blocks.SIZE else one
    return sorted(found, key=lambda r: (r[0], r[2]))


# -- whole tables ------------------------------------------------------------------------------------------------------------

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _sliced(texts: pa.Array):
    """(first row, row after the last, words of each text) of consecutive texts with about SLICE_WORDS words together."""
    lo, held, count = 0, [], 0
    for k in range(len(texts)):
        held.append((texts[k].as_py() or "").encode().split())  # bytes split at just the white space of [^\x20\x09-\x0D]+
        count += len(held[-1])
        if count >= SLICE_WORDS or k + 1 == len(texts):
            yield lo, k + 1, held
            lo, held, count = k + 1, [], 0


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """Word numbers, dense over the texts together and different from text to text."""
    parts, base = [np.zeros(0, np.int64)], 0
    for words in texts:
        known: dict[bytes, int] = {}
        parts.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64) + base)
        base += len(known)
    return np.concatenate(parts)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The text without the words that any run repeats after its first period, one space between words."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words).decode()


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """One row per document: its id, n_words, runs (start, length, period as word numbers, by start, then period), and the text collapsed to each run's first period."""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in _sliced(batch.column(1)):
                first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                runs = word_runs(_numbered(texts), min_length, min_exponent)
                owner = np.searchsorted(first, [r[0] for r in runs], "right") - 1
                mine = [[] for _ in texts]
                for k, (start, length, period) in zip(owner.tolist(), runs, strict=True):
                    mine[k].append((start - int(first[k]), length, period))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": p} for s, n, p in m] for m in mine], pa.list_(RUN)),
                        pa.array([collapsed(t, m) for t, m in zip(texts, mine, strict=True)], pa.string()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    keyed = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = keyed.mapInArrow(run, f"id {type_of(docs, id_col)}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def strongest(runs: str) -> Column:
    """Of an array of runs the one with the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""
    return F.expr(f"""aggregate({runs}, cast(null as struct<start:long,length:long,period:long>), (best, r) ->
        case when best is null then r
             when r.length * best.period > best.length * r.period then r
             when r.length * best.period < best.length * r.period then best
             when struct(r.start, r.period) < struct(best.start, best.period) then r else best end)""")


def periodic_copy(id_col: str, text_col: str) -> Column:
    """The text of a tenth of the documents, chosen by their id, made periodic from some word on; the others' as it is. With h the CRC of the id as text, g = h div 10 and n words:
    where h ends in 0 each word i >= a is word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8)."""
    h = f"crc32(cast(cast({id_col} as string) as binary))"
    words = rf"regexp_extract_all({text_col}, '[^\\x20\\x09-\\x0D]+', 0)"
    made = f"""array_join(transform(array({words}), w -> array_join(transform(w, (x, i) -> if(i < {h} div 10 % size(w), x,
        w[cast({h} div 10 % size(w) + (i - {h} div 10 % size(w)) % (1 + (size(w) - {h} div 10 % size(w)) div (3 + {h} div 10 % 8)) as int)])), ' ')), '')"""
    return F.expr(f"case when {h} % 10 = 0 then {made} else {text_col} end")
