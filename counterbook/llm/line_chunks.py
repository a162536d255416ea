r"""Operator 3: line dedup by content-defined chunks of lines.

A rolling hash runs over the hashes of a text's worded lines, ``ROLLING_LINES`` at a time. Bits of it choose the borders, so these depend on nothing but the
lines beside them and stand where they stood when lines are put in before or after. There are four layers of borders, one for each value of two bits: in layer (o, c) a chunk
opens at a line whose rolling hash, with the line after it, has o as its first bit, and closes at the next line whose rolling hash, with the line
before it, has c as its second bit. A chunk has two worded lines or more (three on average), blank lines between included, and nothing outside it decides where it
begins or ends. The layers complement one another: wherever two worded lines follow one another, one layer opens at the first and closes at the second, so a repeated run
of lines is covered to its ends, however short, by chunks that both places hold.

A chunk whose bytes occur earlier (smaller id, or earlier in the same text) is removed: chunk hashes find the candidates, their bytes decide. What goes is the union
of such chunks, which is exactly the lines of every run with two or more worded lines that stands earlier too; the earliest place of a line always stays.

Defined results: a null or empty text has one line without a word, and stays as it is; a text
of any length is cut whole; rows with the same id and the same text count as one document and get the same
result; rows with the same id and different texts are ordered by a hash of the
text; a null id comes before every other; columns beside id and text pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .shared import forget, fresh, type_of, written

#: Lines under the rolling hash.
ROLLING_LINES = 2


def rolling_hashes(lines: np.ndarray) -> np.ndarray:
    """A hash of each ``ROLLING_LINES`` line hashes in a row, by the polynomial that slides over them."""
    out = np.zeros(max(len(lines) - ROLLING_LINES + 1, 0), np.uint64)
    for k in range(ROLLING_LINES):
        out = out * T.BASE + lines[k : k + len(out)]
    return T.mix(out)


def line_chunks_of(data, offsets, h: T.Hasher):
    """(first line, last line) of the chunks of all layers, the first chunk of each text, and the lines."""
    ls, le, lf = T.line_ranges(data, offsets)
    inside = T.counts(~T.SPACE[data])
    worded = np.flatnonzero(inside[le] > inside[ls])
    doc = T.owners(lf)[worded]
    rolled = rolling_hashes(h.of(ls[worded], le[worded]))
    near = doc[1:] == doc[:-1]
    opens, closes = (rolled & np.uint64(1)).astype(bool), (rolled & np.uint64(2)).astype(bool)
    first, last = [], []
    for o in (False, True):
        for c in (False, True):
            begin, stops = np.flatnonzero(near & (opens == o)), np.flatnonzero(near & (closes == c))
            at = np.searchsorted(stops, begin)
            begin, at = begin[at < len(stops)], at[at < len(stops)]
            end = stops[at] + 1
            whole = doc[begin] == doc[end]  # a chunk that nothing closes before its text ends is none
            first.append(begin[whole])
            last.append(end[whole])
    first, last = np.concatenate(first), np.concatenate(last)
    by = np.lexsort((last, first))
    first, last = first[by], last[by]
    return worded[first], worded[last], np.searchsorted(doc[first], np.arange(len(lf))), (ls, le, lf)


def _each(batches, text_at: int, run):
    table, powers = T.byte_table(), T.Powers()
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch.column(text_at)):
            h = T.Hasher(data, table, powers)
            a, b, first, (ls, le, _) = line_chunks_of(data, offsets, h)
            found = ls[a], le[b], h.of(ls[a], le[b]), first
            yield from run(batch.slice(lo, hi - lo), data, found)


def line_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: id, hash of the whole text, place, chunk hash."""

    def rows(batch, data, found):
        _, _, ch, first = found
        doc = T.owners(first)
        at = pa.array(doc)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.arange(len(ch)) - first[doc]).cast(pa.int32()), pa.array(ch.view(np.int64))], ["id", "th", "chunk", "hash"])

    keyed = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("th"), docs[text_col].alias("text"))
    return keyed.mapInArrow(lambda b: _each(b, 2, rows), f"id {type_of(docs, id_col)}, th long, chunk int, hash long")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, chunks) of the texts with chunks whose bytes occur earlier. Joins are on
    chunk hashes of every occurrence, with both sides plainly exchanged, so AQE splits a chunk that a third of the texts hold. The lists that meet the texts
    grow with the corpus: they are merged at every size, never broadcast."""
    chunks = written(line_chunks(docs, id_col, text_col), "chunks")
    often = written(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "chunk-hashes")
    wanted = chunks.join(often, "hash", "left_semi").groupBy("id", "th").agg(F.collect_set("chunk").alias("wanted"))

    def rows(batch, data, found):
        start, end, ch, first = found
        want = batch.column(3)
        row = np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
        chunk = want.flatten().to_numpy(zero_copy_only=False)
        c = first[row] + chunk
        at = pa.array(row)
        texts = pa.array([data[a:b].tobytes() for a, b in zip(start[c], end[c], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(chunk).cast(pa.int32()), pa.array(ch[c].view(np.int64)), texts], ["id", "th", "chunk", "hash", "bytes"])

    keyed = docs.select(docs[id_col].alias("k"), F.xxhash64(docs[text_col]).alias("kh"), docs[text_col].alias("text"))
    joined = keyed.join(wanted.hint("merge"), keyed["k"].eqNullSafe(wanted["id"]) & (keyed["kh"] == wanted["th"])).select("k", "kh", "text", "wanted")
    found = written(joined.mapInArrow(lambda b: _each(b, 2, rows), f"id {type_of(docs, id_col)}, th long, chunk int, hash long, bytes binary"), "chunk-bytes")
    firsts = written(
        found.groupBy("hash", "bytes").agg(F.min(F.struct("id", "th", "chunk")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "first-chunks",
    )
    later = found.join(firsts, ["hash", "bytes"]).where(~F.struct("id", "th", "chunk").eqNullSafe(F.col("first")))
    gone = written(later.groupBy("id", "th").agg(F.collect_set("chunk").alias("chunks")), "repeated-chunks")
    forget(chunks, often, found, firsts)
    return gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "removed_chunks", keep_empty: bool = True) -> DataFrame:
    """``docs`` with the repeated chunks taken out of the text (a column
    ``n_chars``, where there is one, follows it), and the number of runs of lines taken out, each the union of overlapping chunks.
    ``keep_empty=False`` leaves out documents that had words and have none left."""
    gone = repeated_chunks(docs, id_col, text_col)
    names = docs.columns
    th, chunks = fresh("_th", names), fresh("_chunks", names)
    removed_col = fresh(removed_col, names)
    gone = gone.select(F.col("id").alias(fresh("_gid", names)), F.col("th").alias(fresh("_gth", names)), F.col("chunks").alias(chunks))
    keyed = docs.withColumn(th, F.xxhash64(docs[text_col]))
    joined = keyed.join(gone.hint("merge"), keyed[id_col].eqNullSafe(gone[gone.columns[0]]) & (keyed[th] == gone[gone.columns[1]]), "left").select(*names, chunks)
    text_at, chars_at = names.index(text_col), names.index("n_chars") if "n_chars" in names and type_of(docs, "n_chars") == "bigint" else None

    def cleaned(batches):
        table, powers = T.byte_table(), T.Powers()
        for batch in batches:
            texts, want = batch.column(text_at), batch.column(len(names))
            todo = np.flatnonzero(np.diff(want.offsets.to_numpy()) > 0) if len(want) else np.zeros(0, np.int64)
            new: dict[int, bytes] = {}
            taken = np.zeros(len(batch), np.int64)
            some, drops = texts.take(pa.array(todo)), want.take(pa.array(todo))
            for lo, hi, data, offsets in T.slices(some):
                a, b, first, (ls, le, lf) = line_chunks_of(data, offsets, T.Hasher(data, table, powers))
                for k in range(lo, hi):
                    x, y = lf[k - lo], lf[k - lo + 1]
                    c = first[k - lo] + drops[k].values.to_numpy()
                    change = np.zeros(y - x + 1, np.int64)
                    np.add.at(change, a[c] - x, 1)
                    np.add.at(change, b[c] + 1 - x, -1)
                    edge = np.diff(np.concatenate([[0], np.cumsum(change[:-1]) == 0, [0]]).astype(np.int8))
                    begin, end = x + np.flatnonzero(edge > 0), x + np.flatnonzero(edge < 0) - 1
                    new[int(todo[k])] = b"\n".join([data[ls[i] : le[j]].tobytes() for i, j in zip(begin, end, strict=True)])
                    taken[todo[k]] = len(begin) + 1 - (len(begin) > 0 and begin[0] == x) - (len(begin) > 0 and end[-1] == y - 1)
            columns = list(batch.columns[: len(names)])
            stays = np.ones(len(batch), bool)
            if new:
                put = np.zeros(len(batch), bool)
                put[todo] = True
                fresh_texts = pa.array([new[int(k)].decode() for k in todo], texts.type)
                columns[text_at] = pc.replace_with_mask(texts, pa.array(put), fresh_texts)
                if chars_at is not None:
                    columns[chars_at] = pc.replace_with_mask(columns[chars_at], pa.array(put), pc.utf8_length(fresh_texts).cast(pa.int64()))
                if not keep_empty:
                    stays[[k for k, v in new.items() if not v.strip()]] = False
            yield pa.RecordBatch.from_arrays([*columns, pa.array(taken)], [*names, removed_col]).filter(pa.array(stays))

    schema = docs.select(*names).schema.add(removed_col, "long")
    return joined.mapInArrow(cleaned, schema)
