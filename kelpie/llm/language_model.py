"""Language-model scoring by prediction by partial matching (PPM) over bytes, beside a word-unigram base.

The model is a trie of byte contexts of up to ORDER bytes, counted over all training texts. A byte that its longest
context has not seen escapes to the next shorter one (method D: half a count of each distinct symbol goes to the
escape), where the symbols of the longer context are excluded; below the empty context all remaining byte values are alike. A text
is scored as its words, A-Z lower-cased, joined by one space and closed by a line feed, which no word holds; its
code length is the sum over these bytes.

Scale: no counted node is left out. A task counts its grams (a byte and the ORDER bytes before it) and words in
sorted arrays and sends each shard one block of them, so what is moved grows with distinct grams, not with bytes.
Grams are dealt by the last LOW bytes of context: a shard has every node of the orders from LOW on that its grams can
meet, and their log-probabilities are computed there, a few groups at a time; the nodes of the orders below LOW, of
which valid UTF-8 has some millions at most, are broadcast. The `hot_grams` and `hot_words` commonest ones are broadcast,
too, and scored in place; what a document has besides goes in blocks to the shard that holds it, and comes back as
one sum for each document. Which are broadcast says where a lookup is done, not its result: log-probabilities
are rounded alike before.
Exclusion needs no search: a context keeps the sums that its own symbols take in the next shorter context.

Defined results: null and empty texts are one token, the end; very long texts are scored in parts that see the bytes
before them; repeated rows get a row each; an id may be of any type, repeat or be null (null ids are training rows);
without training rows every byte has probability 1/256 and the base score is 0; an empty table gives an empty result.
Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import CODEC, cut, pack, pack_sorted, shards_for, text_or_empty, to_batch, unpack, unpack_sorted

#: Grams are turned by half their context, so ORDER is twice LOW.
ORDER = 6
LOW = 3
END = b"\n"
PAD = END * ORDER
PIECE = 1 << 20


def mask(k: int) -> int:
    """Of the last k context bytes and the symbol."""
    return (1 << 8 * (k + 1)) - 1


def normalized(text: bytes) -> list[bytes]:
    return text.lower().split()


def grams(buffer: bytes) -> np.ndarray:
    """For each byte after the first ORDER: it and the ORDER bytes before it, packed big-endian."""
    b = np.frombuffer(buffer, np.uint8)
    n = len(b) - ORDER
    g = b[:n].astype(np.int64)
    for k in range(1, ORDER + 1):
        g <<= 8
        g |= b[k : k + n]
    return g


def pieces(bodies: Iterator[tuple[int, bytes]]) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Buffers of about PIECE bytes: each document's bytes, in parts with ORDER bytes of context before each part.

    With every buffer go its parts' documents and the offsets of their contexts.
    """
    held: list[bytes] = []
    owners: list[int] = []
    starts: list[int] = []
    size = 0
    for owner, body in bodies:
        whole = PAD + body + END
        for at in range(ORDER, len(whole), PIECE):
            part = whole[at - ORDER : at + PIECE]
            owners.append(owner)
            starts.append(size)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield b"".join(held), owners, starts
                held, owners, starts, size = [], [], [], 0
    if held:
        yield b"".join(held), owners, starts


def valid(buffer: bytes, starts: list[int]) -> np.ndarray:
    """Which of grams(buffer) end in a byte of a part, not in a context."""
    ok = np.ones(len(buffer) - ORDER, bool)
    inner = np.array(starts[1:], np.int64)
    if len(inner):
        ok[(inner[:, None] - ORDER + np.arange(ORDER)[None, :]).ravel()] = False
    return ok


def turn(g: np.ndarray) -> np.ndarray:
    """Grams with the two halves of their context exchanged, so that sorting groups them by its last LOW bytes."""
    low = mask(LOW - 1)
    return (g >> 8 & low) << 8 * (LOW + 1) | g >> 8 * (LOW + 1) << 8 | g & 255


def turned(buffer: bytes) -> np.ndarray:
    """turn(grams(buffer)), by way of the runs of LOW bytes."""
    b = np.frombuffer(buffer, np.uint8)
    n = len(b) - ORDER
    runs = b[: n + LOW].astype(np.int64)
    for k in range(1, LOW):
        runs <<= 8
        runs |= b[k : k + n + LOW]
    out = runs[LOW:] << 8 * (LOW + 1)
    out |= runs[:n] << 8
    out |= b[ORDER:]
    return out


def pack_words(words: list[bytes]) -> bytes:
    """Words hold no line feed."""
    raw = END.join(words)
    return len(raw).to_bytes(8, "little") + (CODEC.compress(raw, asbytes=True) if raw else b"")


def unpack_words(block: bytes) -> list[bytes]:
    n = int.from_bytes(block[:8], "little")
    return CODEC.decompress(block[8:], n, asbytes=True).split(END) if n else []


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of turned grams: those that share their last LOW bytes of context have one."""
    mixed = (keys >> 8 * (LOW + 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % shards


def dealt(keys: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each shard the places of its keys, in order."""
    own = shard_of(keys, shards)
    order = np.argsort(own.astype(np.uint16) if shards <= 1 << 16 else own, kind="stable")
    return np.split(order, np.cumsum(np.bincount(own, minlength=shards))[:-1])


def dealt_words(words: list[bytes], shards: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(shards)]
    for k, w in enumerate(words):
        out[zlib.crc32(w) % shards].append(k)
    return out


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their numbers."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


BLOCKS = "p int, g binary, n binary, words binary, times binary, ends long"


def tally(batches: Iterator[pa.RecordBatch], shards: int, run: int = 1 << 22, limit: int = 1 << 21, most_words: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """BLOCKS: for each shard distinct grams of all texts, with how often the training ones have them, and words of those."""
    words: Counter = Counter()
    ends = 0

    def bodies() -> Iterator[tuple[int, bytes]]:
        nonlocal ends
        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                tokens = normalized(text.as_py())
                if not held:
                    words.update(tokens)
                    ends += 1
                yield int(not held), b" ".join(tokens)

    parts: list[tuple[np.ndarray, np.ndarray]] = []
    raw: dict[bool, list[np.ndarray]] = {True: [], False: []}

    def settle() -> None:
        for training, arrays in raw.items():
            if arrays:
                keys, counts = tallied(np.concatenate(arrays))
                parts.append((keys, counts if training else np.zeros_like(counts)))
                arrays.clear()

    def send() -> pa.RecordBatch:
        nonlocal ends
        settle()
        keys, counts = merge(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        listed, times = list(words), np.fromiter(words.values(), np.int64, len(words))
        rows = []
        for p, (k, w) in enumerate(zip(dealt(keys, shards), dealt_words(listed, shards), strict=True)):
            if len(k) or w or not p:
                rows.append((p, pack_sorted(keys[k]), pack(counts[k]), pack_words([listed[j] for j in w]), pack(times[w]), 0 if p else ends))
        parts.clear()
        words.clear()
        ends = 0
        return to_batch(rows, pa.schema([("p", pa.int32()), *[(c, pa.binary()) for c in ("g", "n", "words", "times")], ("ends", pa.int64())]))

    size = 0
    for buffer, owners, starts in pieces(bodies()):
        g, ok = turned(buffer), valid(buffer, starts)
        training = np.repeat(np.array(owners, bool), np.diff([*starts, len(g)]))
        raw[True].append(g[ok & training])
        raw[False].append(g[ok & ~training])
        size += len(g)
        if size >= run:
            settle()
            size = 0
            if sum(len(k) for k, _ in parts) > limit:
                parts[:] = [merge(parts)]
                if len(parts[0][0]) > limit // 2:
                    yield send()
        if len(words) > most_words:
            yield send()
            size = 0
    yield send()


def bucket(n: np.ndarray) -> np.ndarray:
    """Of counts: eight classes an octave, -1 for none."""
    return np.where(n > 0, np.floor(8 * np.log2(np.maximum(n, 1))), -1).astype(np.int64)


BUCKETS = 8 * 63
COUNTED = "g binary, n binary, words binary, times binary, n_grams long, n_bytes long, n_words long, n_tokens long, ends long, classes array<long>"


def gather(batches: Iterator[pa.RecordBatch], some: int = 1 << 20, most_words: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """COUNTED: the blocks of a shard as one, in rows that hold whole groups of grams; classes counts grams, then words, by bucket."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    words: dict[bytes, int] = {}
    ends, size, limit = 0, 0, 4 * some
    for batch in batches:
        for g, n, w, times, e in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "words", "times", "ends")), strict=True):
            parts.append((unpack_sorted(g), unpack(n)))
            size += len(parts[-1][0])
            ends += e
            for word, c in zip(unpack_words(w), unpack(times).tolist(), strict=True):
                words[word] = words.get(word, 0) + c
            if size > limit:
                parts = [merge(parts)]
                size = len(parts[0][0])
                limit = max(limit, 2 * size)
    keys, counts = merge(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    listed, times = list(words), np.fromiter(words.values(), np.int64, len(words))
    schema = pa.schema([*[(c, pa.binary()) for c in ("g", "n", "words", "times")], *[(c, pa.int64()) for c in ("n_grams", "n_bytes", "n_words", "n_tokens", "ends")], ("classes", pa.list_(pa.int64()))])
    at, word_at = 0, 0
    while at < len(keys) or word_at < len(listed) or ends:
        end = min(len(keys), at + some)
        if end < len(keys):
            # the last group whole
            end = int(np.searchsorted(keys, ((keys[end - 1] >> 8 * (LOW + 1)) + 1) << 8 * (LOW + 1)))
        g, n, w, t = keys[at:end], counts[at:end], listed[word_at : word_at + most_words], times[word_at : word_at + most_words]
        at, word_at = end, word_at + most_words
        counted = bucket(n)
        classes = np.concatenate([np.bincount(counted[counted >= 0], minlength=BUCKETS), np.bincount(bucket(t), minlength=BUCKETS)])
        yield to_batch([(pack_sorted(g), pack(n), pack_words(w), pack(t), len(g), int(n.sum()), len(w), int(t.sum()), ends, classes)], schema)
        ends = 0


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key stands in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Table:
    """An open-addressed table from grams to log10 probabilities, filled to a half at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, math.ceil(math.log2(2 * len(keys) + 1)))
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, place = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.slots[place] == -1
            self.slots[place[free]] = keys[left[free]]
            mine = self.slots[place] == keys[left]
            self.values[place[mine]] = values[left[mine]]
            left, place = left[~mine], (place[~mine] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each gram, 0 where it has none, and the places of those without."""
        out = np.zeros(len(g), np.float64)
        place = self.slot(g)
        held = self.slots[place]
        hit = held == g
        out[hit] = self.values[place[hit]]
        open_ = np.flatnonzero(~hit & (held != -1))
        lost = [np.flatnonzero(held == -1)]
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[place[open_]]
            hit = held == g[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            lost.append(open_[held == -1])
            open_ = open_[~hit & (held != -1)]
        return out, np.concatenate(lost)


class Trie:
    """The model. nodes: for each order 0..ORDER its sorted (context, symbol) keys and their counts."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.nodes = nodes
        # per order: context, total, symbols, what its symbols take one order below
        self.contexts: list[tuple[np.ndarray, ...]] = []
        for k, (keys, counts) in enumerate(nodes):
            ctx = keys >> 8
            first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
            symbols = np.diff(np.concatenate([first, [len(keys)]])) if len(first) else np.zeros(0, np.int64)
            below = np.zeros(len(first), np.int64)
            if k and len(first):
                at, there = found(nodes[k - 1][0], keys & mask(k - 1))
                below = np.add.reduceat(np.where(there, nodes[k - 1][1][at], 0), first)
            self.contexts.append((ctx[first], total, symbols, below))

    def escape(self, g: np.ndarray) -> np.ndarray:
        """log10 P(symbol | context) of each gram, by walking down the orders, with exclusion."""
        out, excluded, symbols_gone = np.zeros(len(g)), np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        live = np.arange(len(g))
        for k in range(ORDER, -1, -1):
            key = g[live] & mask(k)
            ctxs, total, symbols, below = self.contexts[k]
            at, known = found(ctxs, key >> 8)
            if not known.any():
                continue
            here, at, key = live[known], at[known], key[known]
            weight, escapes = 2 * (total[at] - excluded[here]), symbols[at] - symbols_gone[here]
            node, seen = found(self.nodes[k][0], key)
            share = np.where(seen, 2 * self.nodes[k][1][node] - 1, escapes)
            some = weight > 0
            out[here[some]] += np.log10(share[some] / weight[some])
            excluded[here], symbols_gone[here] = below[at], symbols[at]
            live = np.setdiff1d(live, here[seen], assume_unique=True)
        out[live] += np.log10(1 / (256 - symbols_gone[live]))
        return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def logs_of(g: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 P of grams, among which are all counted ones that share their last LOW bytes of context."""
    counted = n > 0
    keys, counts = summed(g[counted], n[counted])
    return Trie([*low, *(summed(keys & mask(k), counts) for k in range(LOW, ORDER + 1))]).escape(g)


class Hot:
    """What every task looks up in place: the commonest grams and words. The tables are made once in each process."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, words: list[bytes], counts: np.ndarray, weight: float, end: float) -> None:
        self.grams, self.logs, self.words, self.counts, self.weight, self.end = grams, logs, words, counts, weight, end

    @cached_property
    def table(self) -> Table:
        return Table(self.grams, self.logs)

    @cached_property
    def known(self) -> dict[bytes, float]:
        return dict(zip(self.words, (np.log10(self.counts + 1) - self.weight).tolist(), strict=True))


def train(texts: DataFrame) -> DataFrame:
    """COUNTED, computed once: what the binary column text of all rows holds; those with held_out count no times."""
    shards = shards_for(texts)
    blocks = texts.select("text", "held_out").mapInArrow(lambda batches: tally(batches, shards), BLOCKS)
    return cut(blocks.repartitionById(shards, "p").mapInArrow(gather, COUNTED))


def from_class(numbers: dict[int, int], first: int, most: int) -> int:
    """The least bucket from which on there are at most `most`."""
    left = most
    for b in range(BUCKETS - 1, -1, -1):
        left -= numbers.get(first + b, 0)
        if left < 0:
            return b + 1
    return 0


#: kind 0: rarer grams and words of the model; 1: of documents, to be looked up; 2: documents; 3: the commonest of the model.
MAIL = "p int, kind int, rid long, g binary, gx binary, words binary, wx binary"
DOC = "held_out boolean, n_tokens long, n_known long, base double, score double"


def score(
    docs: DataFrame, node_share: float = 0.0, word_share: float = 0.0, hot_grams: int = 1 << 21, hot_words: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 1 << 27
) -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Grams and words are broadcast if they are among the hot_grams and hot_words commonest and make at least node_share
    of the training bytes and word_share of the tokens. A shard of the others takes about shard_bytes in a task.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"), held_out(F.col(id_col)).alias("held_out"))
    counted = train(source)
    names = ("n_tokens", "n_words", "ends", "n_bytes", "n_grams")
    tokens, distinct, ends, n_bytes, n_grams = (x or 0 for x in counted.agg(*[F.sum(c) for c in names]).first())
    total, distinct = tokens + ends, distinct + (ends > 0)
    weight = math.log10(total + distinct + 1)
    end = math.log10(ends + 1) - weight
    numbers = {r.pos: r.n for r in counted.select(F.posexplode("classes")).groupBy("pos").agg(F.sum("col").alias("n")).where("n > 0").collect()}
    gram_class, word_class = from_class(numbers, 0, hot_grams), from_class(numbers, BUCKETS, hot_words)
    low = spark.sparkContext.broadcast(lowest(counted))
    shards = max(spark.sparkContext.defaultParallelism, -(-(12 * n_grams + 100 * distinct) // shard_bytes), n_bytes >> 30)
    mail = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("rid", pa.int64()), *[(c, pa.binary()) for c in ("g", "gx", "words", "wx")]])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n, w, t in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "words", "times")), strict=True):
                keys, counts, words, times = unpack_sorted(g), unpack(n), unpack_words(w), unpack(t)
                lp = logs_of(turn(keys), counts, low.value).astype("<f4")
                hot, hot_w = (bucket(counts) >= gram_class) & (counts >= max(1.0, node_share * n_bytes)), (bucket(times) >= word_class) & (times >= word_share * total)
                rows = [(0, 3, None, pack_sorted(keys[hot]), pack(lp[hot]), pack_words([words[k] for k in np.flatnonzero(hot_w)]), pack(times[hot_w]))]
                rare, rare_w = np.flatnonzero(~hot), np.flatnonzero(~hot_w)
                of_words = dealt_words([words[k] for k in rare_w], shards)
                for p, (k, j) in enumerate(zip(dealt(keys[rare], shards), of_words, strict=True)):
                    own, own_w = rare[k], rare_w[j]
                    if len(own) or len(own_w):
                        rows.append((p, 0, None, pack_sorted(keys[own]), pack(lp[own]), pack_words([words[i] for i in own_w]), pack(times[own_w])))
                yield to_batch(rows, mail)

    model = cut(counted.mapInArrow(spell, MAIL))
    # at most hot_grams and hot_words
    common = model.where("kind = 3").select("g", "gx", "words", "wx").toArrow().to_pydict()
    joined = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    hot = spark.sparkContext.broadcast(
        Hot(
            joined(map(unpack_sorted, common["g"]), "<i8"),
            joined((unpack(x, "<f4") for x in common["gx"]), "<f4"),
            [w for x in common["words"] for w in unpack_words(x)],
            joined(map(unpack, common["wx"]), "<i8"),
            weight,
            end,
        )
    )
    id_type = docs.schema[id_col].dataType.simpleString()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return asked(batches, hot.value, shards)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answered(batches, weight)

    texts = source.mapInArrow(ask, f"{MAIL}, doc_id {id_type}, {DOC}")
    both = texts.unionByName(model.where("kind = 0"), allowMissingColumns=True)
    sums = both.repartitionById(shards, "p").sortWithinPartitions("kind").mapInArrow(answer, f"rid long, doc_id {id_type}, {DOC}")
    of_doc = sums.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")
    )
    return of_doc.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def lowest(counted: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The counted nodes of the orders below LOW, summed over the cluster."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n in zip(batch.column("g").to_pylist(), batch.column("n").to_pylist(), strict=True):
                keys, counts = summed(turn(unpack_sorted(g)) & mask(LOW - 1), unpack(n))
                yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 0], pa.int64()), pa.array(counts[counts > 0], pa.int64())], ["g", "n"])

    got = counted.select("g", "n").mapInArrow(parts, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    g, n = (got.column(c).to_numpy().astype(np.int64) for c in ("g", "n"))
    return [summed(g & mask(k), n) for k in range(LOW)]


def asked(batches: Iterator[pa.RecordBatch], hot: Hot, shards: int, some: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """MAIL and DOC: of every document what is looked up here, and blocks of its rarer grams and words for the shards.

    A block's gx and wx say whose each of its grams and words is: rid is that of the first document.
    """
    table, known, end = hot.table, hot.known, hot.end
    rid = TaskContext.get().partitionId() << 36
    first, rare, whose, words, word_of, size = rid, [], [], [], [], 0
    doc_id = None

    def send() -> pa.RecordBatch:
        g, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rare, whose))
        order = np.argsort(g)
        g, at, of = g[order], at[order] - first, np.array(word_of, np.int64) - first
        columns: list[list] = [[], [], [], [], []]
        for p, (k, j) in enumerate(zip(dealt(g, shards), dealt_words(words, shards), strict=True)):
            if len(k) or j:
                for c, v in zip(columns, (p, pack_sorted(g[k]), pack(at[k].astype("<i4")), pack_words([words[i] for i in j]), pack(of[j].astype("<i4"))), strict=True):
                    c.append(v)
        n = len(columns[0])
        p, *blocks = columns
        none = [pa.nulls(n, t) for t in (doc_id, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([first] * n, pa.int64()), *[pa.array(b, pa.binary()) for b in blocks], *none], [*MAIL_NAMES, "doc_id", *DOC_NAMES])

    for batch in batches:
        doc_id = batch.schema.field("doc_id").type
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            n = part.num_rows
            tokens = [normalized(t.as_py()) for t in part.column("text")]
            scores, bases, n_known = np.zeros(n), [], []
            for buffer, owners, starts in pieces((k, b" ".join(t)) for k, t in enumerate(tokens)):
                g, ok = turned(buffer), valid(buffer, starts)
                values, missing = table.lookup(g)
                values[~ok] = 0
                np.add.at(scores, owners, np.add.reduceat(values, starts))
                missing = missing[ok[missing]]
                rare.append(g[missing])
                whose.append(np.repeat(np.array(owners, np.int64) + rid, np.diff([*starts, len(g)]))[missing])
                size += len(missing)
            for k, t in enumerate(tokens):
                values = list(map(known.get, t))
                if None in values:
                    left = [w for w, v in zip(t, values, strict=True) if v is None]
                    words += left
                    word_of += [rid + k] * len(left)
                    size += len(left)
                    values = [v for v in values if v is not None]
                bases.append(math.fsum(values) + end)
                n_known.append(len(values) + 1)
            ids = np.arange(rid, rid + n)
            nothing = [pa.nulls(n, pa.binary())] * 4
            own = [pa.array(ids % shards, pa.int32()), pa.array(np.full(n, 2), pa.int32()), pa.array(ids, pa.int64()), *nothing, part.column("doc_id"), part.column("held_out")]
            own += [pa.array([len(t) + 1 for t in tokens], pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(own, [*MAIL_NAMES, "doc_id", *DOC_NAMES])
            rid += n
            if size >= some:
                yield send()
                first, rare, whose, words, word_of, size = rid, [], [], [], [], 0
    if size:
        yield send()


MAIL_NAMES, DOC_NAMES = ([c.split()[0] for c in x.split(", ")] for x in (MAIL, DOC))


def answered(batches: Iterator[pa.RecordBatch], weight: float) -> Iterator[pa.RecordBatch]:
    """rid, the id and DOC: documents as they are, and the sums of what their blocks ask for. The model comes first."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    counts: dict[bytes, int] = {}
    keys, logs = np.zeros(0, np.int64), np.zeros(0, "<f4")
    names = ["rid", "doc_id", *DOC_NAMES]
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for k in np.flatnonzero(kinds == 0):
            g, gx, w, wx = (batch.column(c)[int(k)].as_py() for c in ("g", "gx", "words", "wx"))
            parts.append((unpack_sorted(g), unpack(gx, "<f4")))
            counts.update(zip(unpack_words(w), unpack(wx).tolist(), strict=True))
        asks = np.flatnonzero(kinds == 1)
        if len(asks) and parts:
            keys, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(keys)
            keys, logs, parts = keys[order], logs[order], []
        for k in asks:
            first, g, gx, w, wx = (batch.column(c)[int(k)].as_py() for c in ("rid", "g", "gx", "words", "wx"))
            wanted, at, words, of = unpack_sorted(g), unpack(gx, "<i4"), unpack_words(w), unpack(wx, "<i4")
            place, there = found(keys, wanted)
            if not there.all():
                raise ValueError("a gram of a text was not counted")
            c = np.fromiter((counts.get(x, 0) for x in words), np.int64, len(words))
            n = int(max(at.max(initial=-1), of.max(initial=-1))) + 1
            score, base = (np.bincount(at, logs[place], n) if len(at) else np.zeros(n)), (np.bincount(of, np.log10(c + 1) - weight, n) if len(of) else np.zeros(n))
            hits = np.flatnonzero(np.bincount(at, minlength=n) + np.bincount(of, minlength=n))
            known = np.bincount(of[c > 0], minlength=n)
            doc_id = batch.schema.field("doc_id").type
            columns = [pa.array(hits + first, pa.int64()), pa.nulls(len(hits), doc_id), pa.nulls(len(hits), pa.bool_()), pa.nulls(len(hits), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(known[hits], pa.int64()), pa.array(base[hits], pa.float64()), pa.array(score[hits], pa.float64())], names)
        docs = pa.array(np.flatnonzero(kinds == 2))
        if len(docs):
            yield batch.select(names).take(docs)
