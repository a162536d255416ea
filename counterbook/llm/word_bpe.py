r"""Operator 2: BPE encoding and decoding over a table of distinct words.

The texts of a block (consecutive rows of one task, up to ``BLOCK_CHARS`` characters) are split into
words; the block keeps its distinct words in order of first use, and each text as the places of
its words in that list. The words of all blocks meet in one table, by hash bucket, where each distinct word is encoded
once; its ids go back to the blocks, by place, and every text's ids are joined up from them. Decoding
looks the ids up in the id-to-piece table and joins the pieces as the tokenizer does.

Scale. What is shuffled are distinct words of blocks, not words: a frequent word is there once a block. Blocks
and their word places are written once to the shared folder, so the lists that two jobs read are the same
after the loss of an executor. A bucket's rows are read one by one; a task keeps the distinct words of one bucket. The pieces are a table of the vocabulary's size.

Defined results: a null or empty text has no ids and decodes to the empty text; a text longer than a block is a block
of its own; rows are encoded one by one, equal ids or texts or not; an empty table gives an empty table; columns
beside id and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, type_of, written

#: Characters of a block, texts of a chunk, and the least number of hash buckets in which the words of all blocks meet (a cluster set to more shuffle partitions has as many buckets).
BLOCK_CHARS, CHUNK, BUCKETS = 16_000_000, 256, 1024
#: Fixed values of the tokenizer format: the word pattern whose splitting is done here, and the normaliser before it. Other
#: tokenizers, and texts with characters that are, or lower to, ones from U+0250 on, are normalised and split by the tokenizers library.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
LATIN_END = 0x250


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Splitter:
    """The words of a text as the tokenizer's pre-tokenizer gives them; a special token is a word that starts with a blank."""

    def __init__(self, config: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        parts = json.loads(config)
        special = [t["content"] for t in parts["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = parts["normalizer"] == KNOWN_NORMALIZER and steps[0].get("pattern") == {"Regex": KNOWN_PATTERN} and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        kind = {k: "".join(re.escape(chr(c)) for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kind['L']}]+|[{kind['N']}]|[^ \\t-\\r{kind['L']}{kind['N']}]+")
        far = "".join(chr(c) for c in range(LATIN_END) if max(chr(c).lower()) >= chr(LATIN_END))
        self.unusual = re.compile("[\x1c-\x1f\x85\xa0%s%s-\U0010ffff]" % (far, chr(LATIN_END)))
        self.letters = byte_letters()

    def mapped(self, word: str) -> str:
        return "".join([self.letters[b] for b in word.encode()])

    def plain(self, text: str) -> list[str] | None:
        """Words before the byte mapping, where the fixed pattern applies."""
        return self.pattern.findall(text.lower()) if self.known and not self.unusual.search(text) else None

    def library(self, text: str) -> list[str]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]


class Block:
    """Distinct words of a block in order of first use."""

    def __init__(self, splitter: Splitter):
        self.splitter, self.words, self.plain = splitter, {}, {}

    def place(self, mapped: str) -> int:
        return self.words.setdefault(mapped, len(self.words))

    def places(self, text: str) -> list[int]:
        s = self.splitter
        out: list[int] = []
        parts = s.special.split(text) if s.special and s.special.search(text) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.place(" " + part))
            elif (found := s.plain(part)) is not None:
                for w in set(found):
                    if w not in self.plain:
                        self.plain[w] = self.place(s.mapped(w))
                out += map(self.plain.__getitem__, found)
            else:
                out += map(self.place, s.library(part))
        return out


def squeezed(data: bytes) -> bytes:
    """Compressed bytes, their length before them."""
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 6).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


def packed(numbers) -> bytes:
    """Unsigned numbers, small ones the commonest: a byte each, and byte planes of those that do not fit one."""
    x = np.asarray(numbers, "<u4")
    large = x[x >= 255] - np.uint32(255)
    return squeezed(len(x).to_bytes(4, "little") + np.minimum(x, 255).astype(np.uint8).tobytes() + large.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = unsqueezed(data)
    n = int.from_bytes(raw[:4], "little")
    out = np.frombuffer(raw, np.uint8, n, 4).astype("<u4")
    out[out == 255] += np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=4 + n).reshape(4, -1).T).view("<u4").ravel()
    return out


def split_blocks(docs: DataFrame, config, id_col: str, text_col: str) -> DataFrame:
    """One table of the shared folder with two kinds of rows. Texts, ``CHUNK`` at a time: (block, ids, sizes,
    places), the sizes and places of their words. Words of a block, by bucket (a hash of the word): (block, bucket, words, places)."""
    kind = type_of(docs, id_col)
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        splitter, part, count, chars, held = Splitter(config.value), TaskContext.get().partitionId(), 0, 0, False
        block, id_type = Block(splitter), pa.null()

        def table(rows, ids):
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | count] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int32()), ids, *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
                ["block", "bucket", "ids", "sizes", "places", "words"],
            )

        def done():
            """The block's texts and words; the commonest word has place 0, the next 1, ... so that places are small."""
            counts = np.zeros(len(block.words), np.int64)
            for _, _, flat in chunks:
                counts += np.bincount(flat, minlength=len(counts))
            place = np.empty(len(counts), np.int64)
            place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
            for ids, sizes, flat in chunks:
                yield table([(None, packed(sizes), packed(place[flat]), None)], pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
            parts: dict[int, list[str]] = {}
            for w in block.words:
                parts.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
            rows = [(b, None, packed(place[[block.words[w] for w in ws]]), squeezed("\n".join(ws).encode())) for b, ws in parts.items()]
            for k in range(0, len(rows), 1000):
                yield table(rows[k : k + 1000], pa.nulls(len(rows[k : k + 1000]), pa.list_(id_type)))

        chunks: list[tuple] = []

        def chunk(ids, each):
            chunks.append((ids, [len(p) for p in each], np.fromiter((p for places in each for p in places), "<u4")))

        for batch in batches:
            id_type, lo, each = batch.column(0).type, 0, []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                if each and len(each) >= CHUNK or held and chars + len(text) > BLOCK_CHARS:
                    if each:
                        chunk(batch.column(0).slice(lo, k - lo), each)
                    lo, each = k, []
                    if chars + len(text) > BLOCK_CHARS:
                        yield from done()
                        block, count, chars, held = Block(splitter), count + 1, 0, False
                        chunks.clear()
                each.append(block.places(text))
                chars, held = chars + len(text), True
            if each:
                chunk(batch.column(0).slice(lo), each)
        if held:
            yield from done()

    split = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = split.mapInArrow(run, f"block long, bucket int, ids array<{kind}>, sizes binary, places binary, words binary")
    return written(rows.withColumn("kind", F.when(F.col("words").isNull(), F.lit("texts")).otherwise(F.lit("words"))), "bpe-blocks", "zstd", "kind")


def encode_words(words: DataFrame, config) -> DataFrame:
    """(block, places, sizes, ids) of each row's words: all rows of a bucket meet in one task, one bucket after the other, and each distinct word is encoded once."""

    def run(batches):
        splitter = Splitter(config.value)
        known: dict[str, np.ndarray] = {}
        bucket = None

        def ids_of(w):
            if w not in known:
                t = splitter.tokenizer
                known[w] = np.array([t.token_to_id(w[1:])] if w[0] == " " else [x.id for x in t.model.tokenize(w)], "<u4")
            return known[w]

        for batch in batches:
            sizes, ids = [], []
            for b, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                each = [ids_of(w) for w in unsqueezed(data).decode().split("\n")]
                sizes.append(packed([len(x) for x in each]))
                ids.append(packed(np.concatenate(each)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["block", "places", "sizes", "ids"])

    meet = words.select("block", "bucket", "places", "words").repartition("bucket").sortWithinPartitions("bucket")
    return meet.mapInArrow(run, "block long, places binary, sizes binary, ids binary")


def pieces(config: str) -> list[str]:
    """The id-to-piece table."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(config)
    return [t.id_to_token(k) or "" for k in range(t.get_vocab_size())]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (the text that the
    tokenizer's decode gives back, special tokens kept). ``vocabulary``: path of a tokenizers file without a decoder."""
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    if json.loads(text).get("decoder") is not None or json.loads(text)["model"]["type"] != "BPE":
        raise ValueError("a BPE tokenizer without a decoder is needed: pieces are joined by a blank")
    sc = docs.sparkSession.sparkContext
    config, table = sc.broadcast(text), sc.broadcast(pieces(text))
    blocks = split_blocks(docs, config, id_col, text_col)
    answers = written(encode_words(blocks.where("kind = 'words'"), config), "bpe-ids", "zstd")
    forget(blocks, part="kind=words")
    texts = blocks.where("kind = 'texts'").select("block", "ids", "sizes", "places")
    kind = type_of(docs, id_col)

    def join_up(key, left, right):
        """A block's texts with the ids of its words, by place."""
        at, sizes, ids = (np.concatenate([unpacked(x) for x in right.column(c).to_pylist()]) for c in ("places", "sizes", "ids")) if len(right) else [np.zeros(0, "<u4")] * 3
        sizes = sizes.astype(np.int64)
        order = np.argsort(at)  # every place of the block's list, once
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        size = sizes[order]
        off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        pos = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(begin[order], size)
        of_word = pa.LargeListArray.from_arrays(pa.array(off), pa.array(ids[pos].astype(np.int32)))
        names = pa.array(table.value, pa.large_string())
        word_text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(off), names.take(of_word.values)), pa.scalar(" ", pa.large_string()))
        out = []
        for row in range(len(left)):  # a chunk of texts at a time
            flat = pa.array(unpacked(left.column("places")[row].as_py()).astype(np.int64))
            n_words = unpacked(left.column("sizes")[row].as_py()).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
            got = of_word.take(flat)
            cut = np.concatenate([[0], np.cumsum(pc.list_value_length(got).to_numpy())]).astype(np.int64)[ends]
            raw = got.flatten().to_numpy().astype("<u4").tobytes()
            decoded = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), word_text.take(flat)), pa.scalar(" ", pa.large_string()))
            id_list = left.column("ids")[row].values
            out.append(pa.table({"id": id_list, "n_tokens": pa.array(np.diff(cut)), "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:])], pa.binary()), "decoded": decoded.cast(pa.string())}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], left.column("ids").type.value_type), "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.string())})

    both = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join_up, f"id {kind}, n_tokens long, ids binary, decoded string")
    return both.withColumnRenamed("id", id_col)
