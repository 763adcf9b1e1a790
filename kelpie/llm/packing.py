"""Bounded-space online packing of token sequences into windows of fixed length.

Each partition keeps a fixed number of open windows. A document longer than a window first gives full windows by
itself; its rest, or a shorter document whole, goes to the open window it leaves least room in (best fit). When
none has room the fullest open window is emitted and a new one opened. The windows that stay open at the end of a
partition are merged: groups of them are packed again the same way, level by level, until one group is left, so no
task sees more than fan_in x open_windows windows.

Tokens come from a public tokenizer file. Byte-level BPE starts a token at a space after a non-space whatever
follows, so a text is cut there and the ids of each short cut are kept in a bounded cache; texts of any length need no
more memory than their ids.

Defined results: a null or empty text is one token, the separator; added tokens of the file that a text spells out are
those tokens; a very long text gives full windows by itself; windows of equal room are filled the oldest first;
repeated rows are packed as often as they occur; ids may be of any type, null or repeated; an empty table gives no
pieces; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import cut, text_or_empty, to_batch

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
#: Low bits of sequence_id count a task's windows; above them stand the task and the merging level.
TASK_SHIFT, LEVEL_SHIFT = 32, 56


#: Fixed value: how byte-level BPE tokenizers of this kind split a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for themselves, then from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_ranks(file: str) -> dict[bytes, int] | None:
    """Token bytes -> id if the file is plain byte-level BPE whose ids follow its merges, else None."""
    spec = json.loads(Path(file).read_text())
    model, pre, own = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
    plain = model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ids = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if ids != sorted(ids):
        return None
    return {bytes(own[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class Encoder:
    """Ids of a text as little-endian uint32 bytes, equal to the tokenizer's encode(text, add_special_tokens=False).

    Plain byte-level BPE files go through the faster of the two libraries that read such vocabularies, except for
    texts that spell out one of the file's added tokens.
    """

    def __init__(self, file: str, cache: int = 600_000) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        self.whole = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        ranks = byte_ranks(file)
        self.cuttable = ranks is not None
        added = [t["content"] for t in json.loads(Path(file).read_text()).get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        if ranks is not None:
            import tiktoken

            self.one = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.cache = Cuts(self.one, cache)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuttable or self.added.search(text):
            return self.whole(text)
        first, *rest = SURE.split(text) if UNSURE.search(text) else text.split(" ")
        return array("I", self.one(first)).tobytes() + b"".join(map(self.cache.__getitem__, rest))


class Cuts(dict):
    """Ids of a cut, which stands after a space. Short cuts are kept, at most `most` of them."""

    def __init__(self, one, most: int) -> None:
        self.one, self.most = one, most

    def __missing__(self, cut_: str) -> bytes:
        got = array("I", self.one(" " + cut_)).tobytes()
        if len(cut_) <= 32:
            if len(self) >= self.most:
                self.clear()
            self[cut_] = got
        return got


#: A space after a non-space is where a token begins, whatever follows. UNSURE finds a space after white space.
UNSURE, SURE = re.compile(r"\s |^ "), re.compile(r"(?<=\S) ")


class Packer:
    """Open windows of one task; add() yields the pieces of windows that are emitted."""

    def __init__(self, capacity: int, windows: int, first_id: int) -> None:
        self.capacity, self.windows, self.next_id = capacity, windows, first_id
        self.open: list[tuple[int, list[tuple]]] = []

    def emit(self, pieces: list[tuple], is_open: bool = False) -> Iterator[tuple]:
        offset, sequence, self.next_id = 0, self.next_id, self.next_id + 1
        for piece in pieces:
            yield *piece, sequence, offset, is_open
            offset += piece[2]

    def place(self, used: int, pieces: list[tuple]) -> Iterator[tuple]:
        """Puts pieces, that stay together, into the fullest open window with room for them."""
        if used == self.capacity:
            yield from self.emit(pieces)
            return
        best, room = -1, self.capacity + 1
        for k, (u, _) in enumerate(self.open):
            left = self.capacity - u - used
            if 0 <= left < room:
                best, room = k, left
        if best >= 0:
            u, held = self.open[best]
            held.extend(pieces)
            if room:
                self.open[best] = (u + used, held)
            else:
                del self.open[best]
                yield from self.emit(held)
            return
        if len(self.open) >= self.windows:
            k = max(range(len(self.open)), key=lambda i: self.open[i][0])
            yield from self.emit(self.open.pop(k)[1])
        self.open.append((used, list(pieces)))

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, c = len(ids) // 4, self.capacity
        full = total - total % c
        for at in range(0, full, c):
            yield from self.emit([(doc_id, at, c, zlib.crc32(ids[4 * at : 4 * (at + c)]), total)])
        if full < total:
            yield from self.place(total - full, [(doc_id, full, total - full, zlib.crc32(ids[4 * full :]), total)])

    def close(self, is_open: bool) -> Iterator[tuple]:
        for _, pieces in self.open:
            yield from self.emit(pieces, is_open)
        self.open = []


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, windows: int = 64, separator: int = 0, fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most capacity ids and are padded to it. Texts are read and tokenized once, and never moved:
    only the pieces of windows still open go on to be merged.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    piece = PIECE.format(id=id_type.simpleString())
    columns = [c.split()[0] for c in PIECE.split(", ")]
    schema = pa.schema([(c, to_arrow_type(id_type) if c == "doc_id" else pa.bool_() if c == "open" else pa.int64()) for c in columns])
    end = np.array([separator], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(tokenizer), Packer(capacity, windows, TaskContext.get().partitionId() << TASK_SHIFT)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    yield from packer.add(doc_id.as_py(), encoder.encode(text.as_py()) + end)
            yield from packer.close(is_open=True)

        yield from batches_of(rows(), schema)

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    placed = cut(texts.mapInArrow(first, piece))
    done, left, level = [placed.where("not open")], placed.where("open"), 1
    tasks = placed.rdd.getNumPartitions()
    while True:
        groups = max(1, -(-tasks // fan_in))
        merged = cut(merge(left, groups, level, last=groups == 1, capacity=capacity, windows=windows, fan_in=fan_in, schema=schema, piece=piece))
        done.append(merged.where("not open"))
        if groups == 1:
            break
        left, tasks, level = merged.where("open"), groups, level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("open")


def merge(left: DataFrame, groups: int, level: int, last: bool, capacity: int, windows: int, fan_in: int, schema: pa.Schema, piece: str) -> DataFrame:
    """One level: the open windows of fan_in tasks are packed into a task's own, fullest first."""
    first_id = level << LEVEL_SHIFT
    task = F.shiftright(F.col("sequence_id"), TASK_SHIFT).bitwiseAND(F.lit((1 << (LEVEL_SHIFT - TASK_SHIFT)) - 1))
    grouped = left.withColumn("group", F.floor(task / fan_in).cast("int")).repartitionById(groups, "group").sortWithinPartitions("sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, windows, first_id | TaskContext.get().partitionId() << TASK_SHIFT)
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in schema.names[:6]), strict=True):
                held.setdefault(row[5], []).append(row[:5])

        def rows() -> Iterator[tuple]:
            order = sorted(held.values(), key=lambda pieces: -sum(p[2] for p in pieces))
            for pieces in order:
                yield from packer.place(sum(p[2] for p in pieces), pieces)
            yield from packer.close(is_open=not last)

        yield from batches_of(rows(), schema)

    return grouped.mapInArrow(run, piece)


def sequences(pieces: DataFrame, docs: DataFrame, tokenizer: str, capacity: int = 1024, separator: int = 0, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array<int> padded to capacity, doc_ids of their pieces.

    For unique document ids. Texts are tokenized again where they lie and only each piece's ids are moved.
    """

    @F.pandas_udf("binary")
    def ids_of(text: pd.Series) -> pd.Series:
        encoder = Encoder(tokenizer)
        return text.map(lambda t: encoder.encode(t) + np.array([separator], "<u4").tobytes())

    texts = docs.select(F.col(id_col).alias("doc_id"), ids_of(text_or_empty(text_col)).alias("ids"))
    part = F.expr("substring(ids, int(4 * start + 1), int(4 * length))")
    held = pieces.join(texts, "doc_id").select("sequence_id", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))

    @F.pandas_udf("array<int>")
    def padded(parts: pd.Series) -> pd.Series:
        def fill(p: list) -> list[int]:
            got = np.concatenate([np.frombuffer(x, "<u4") for x in p]).astype(np.int32)
            return np.concatenate([got, np.full(capacity - len(got), pad, np.int32)]).tolist()

        return parts.map(fill)

    rows = held.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select("sequence_id", padded(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
