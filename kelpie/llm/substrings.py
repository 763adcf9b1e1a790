"""Substring deduplication by sliding sentence spans.

A text is cut into sentences (after . ! ? or an ellipsis and white space, and at line ends), and these after the word
with the least hash of every `window` consecutive words they hold. So no piece has more than `window` words, and equal
passages are cut alike but for their first and last window - 1 words, wherever they stand: at a window of 8, every 50
words that occur twice hold 35 words between equal cuts, and so a whole span of 28 words, wherever it begins. A lower
bound on spans would take more of what repeats by chance or custom, a higher one lose passages. "Sentence" is such a
piece below. From every sentence a span starts: the shortest run of at least `min_sentences` sentences with at least `min_words` words.
Spans are hashed over their lower-cased words and met over the whole corpus. The first occurrence (smallest
document, then position) stays; a sentence covered by any other is removed.

Scale: a text is cut and hashed once, with arrays over many texts. A task settles among its own spans which are not
first, and sends the shard of a hash only one occurrence of it (one for each row, where rows share the smallest id),
so a passage that very many documents share arrives once from each task. Shards answer with the places of what
others have first, and these meet their texts in one shuffle join, whatever the size of the input.

Defined results: null and empty texts have no sentences and stay as they are (null stays null); very long texts are
cut whole, in memory in proportion to the text; rows with one id count as one document, whose rows do not remove each
other's sentences; a null id sorts first; ids that are no integers are ordered by their hash; texts that lose every
sentence become empty; an empty table gives an empty one. The text of a document without repeated spans is returned
unchanged, byte for byte. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import cut, order_key, pack, pack_sorted, shards_for, text_or_empty, to_batch, unpack, unpack_sorted

#: A word after which a sentence ends.
LAST = re.compile(r"[.!?…。！？][\"'”’)\]]*\Z")
PIECE = re.compile(r"\S+\s*")
MIN_SENTENCES, MIN_WORDS, WINDOW = 3, 28, 8
#: Odd bases of the two hashes of a run of words.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LOW32 = np.uint64(0xFFFFFFFF)


def word_hashes(word: str) -> tuple[int, int]:
    """The two halves of the MD5 of the lower-cased word, which SQL has, too."""
    digest = hashlib.md5(word.lower().encode(), usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], "big"), int.from_bytes(digest[8:], "big")


class Words(dict):
    """Numbers words; for each number the two hashes of the lower-cased word, and whether a sentence ends after it."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.first, self.second, self.last = array("Q"), array("Q"), array("b")

    def __missing__(self, word: str) -> int:
        first, second = word_hashes(word)
        self.first.append(first)
        self.second.append(second)
        self.last.append(LAST.search(word) is not None)
        got = self[word] = len(self)
        return got


def powers(n: int, base: int) -> np.ndarray:
    """base**0 to base**n, modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Layout:
    """The sentences and spans of texts.

    start and stop: of each sentence its first and last word, counted over all texts; text: whose it is; begin: the
    first sentence of each text, and their number. at and to: first and last sentence of each span.
    """

    def __init__(self, texts: list[str], words: Words, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, window: int = WINDOW) -> None:
        listed: list[str] = []
        ends, sizes = [], []
        for t in texts:
            before = len(listed)
            for line in t.split("\n"):
                if own := line.split():
                    listed += own
                    ends.append(len(listed) - 1)
            sizes.append(len(listed) - before)
        n = len(listed)
        ids = np.fromiter(map(words.__getitem__, listed), np.int64, n)
        self.hashes = [np.frombuffer(h, np.uint64)[ids] if n else np.zeros(0, np.uint64) for h in (words.first, words.second)]
        last = np.frombuffer(words.last, np.int8)[ids].astype(bool) if n else np.zeros(0, bool)
        last[np.array(ends, np.int64)] = True
        if len(words) > words.most:
            words.reset()
        if n >= window:
            # the least hash, the last one of equals, of every window
            least = self.hashes[0] >> np.uint64(32) << np.uint64(32) | LOW32 - np.arange(n, dtype=np.uint64)
            step = 1
            while 2 * step <= window:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            if step < window:
                least = np.minimum(least[: n - window + 1], least[window - step :])
            sentence = np.cumsum(last) - last
            within = sentence[: n - window + 1] == sentence[window - 1 :]
            last[(LOW32 - (least[within] & LOW32)).astype(np.int64)] = True
        self.stop = np.flatnonzero(last)
        self.start = np.concatenate([np.zeros(min(1, len(self.stop)), np.int64), self.stop[:-1] + 1])
        self.first_word = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.begin = np.searchsorted(self.stop, self.first_word)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.begin))
        far = np.maximum(np.arange(len(self.stop)) + min_sentences - 1, np.searchsorted(self.stop, self.start + min_words - 1))
        fits = far < self.begin[self.text + 1]
        self.at, self.to = np.flatnonzero(fits), far[fits]

    def span_hashes(self) -> list[np.ndarray]:
        """Two hashes of each span: a polynomial in its words' hashes, as a difference of running sums."""
        out, begin, end = [], self.start[self.at], self.stop[self.to] + 1
        for h, base in zip(self.hashes, BASES, strict=True):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h), base)[:-1], dtype=np.uint64)])
            out.append(((sums[end] - sums[begin]) * powers(len(h), pow(base, -1, 1 << 64))[begin]).view(np.int64))
        return out

    def places(self) -> np.ndarray:
        """Of each span its first sentence, counted in its text."""
        return self.at - self.begin[self.text[self.at]]


def sentences(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Offsets of the sentences; together they cover the text."""
    ends = [m.end() for m in PIECE.finditer(text)]
    stops = [ends[k] for k in Layout([text], Words(), window=window).stop]
    return list(zip([0, *stops], stops, strict=False)) or [(0, len(text))] * bool(text)


def spans(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first sentence, number of sentences, two hashes, whether the text had the span before) of every span."""
    own, seen = Layout([text], Words(), min_sentences, min_words), set()
    for at, to, *h in zip(own.at.tolist(), own.to.tolist(), *(x.tolist() for x in own.span_hashes()), strict=True):
        yield at, to - at + 1, *h, tuple(h) in seen
        seen.add(tuple(h))


#: kind 0: spans for a shard; 1: places known to be covered. of tells whose a span is: ids and ths are those of the texts.
MAIL = "p int, kind int, h1 binary, h2 binary, of binary, at binary, ids binary, ths binary"
MAIL_SCHEMA = pa.schema([("p", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("h1", "h2", "of", "at", "ids", "ths")]])


def later(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of spans that need no answer from others as they are not first, and of the rest."""
    order = np.argsort(h1)
    same = h1[order][1:] == h1[order][:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(h1) else np.zeros(0, bool)
    alone, many = order[~shared], order[shared]
    many = many[np.lexsort((at[many], of[many], ids[many], h2[many], h1[many]))]
    new = np.ones(len(many), bool)
    new[1:] = (h1[many][1:] != h1[many][:-1]) | (h2[many][1:] != h2[many][:-1])
    least = ids[many][new][np.cumsum(new) - 1] if len(many) else ids[many]
    gone = ids[many] > least
    gone[1:] |= ~new[1:] & (of[many][1:] == of[many][:-1])
    return many[gone], np.concatenate([alone, many[~gone]])


def located(batches: Iterator[pa.RecordBatch], shards: int, min_sentences: int, min_words: int, most_chars: int = 1 << 21, most_spans: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """MAIL: the spans of texts."""
    words = Words()
    ids, ths, parts, size = [], [], [], 0
    held: list[str] = []
    mine = TaskContext.get().partitionId() % shards

    def lay() -> int:
        first = len(ids) - len(held)
        own = Layout(held, words, min_sentences, min_words)
        h1, h2 = own.span_hashes()
        # 96 bits of hash are sent
        parts.append((h1, (h2 >> 32).astype(np.int32), own.text[own.at] + first, own.places()))
        held.clear()
        return len(h1)

    def send() -> pa.RecordBatch:
        h1, h2, of, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        all_ids, all_ths = np.array(ids, np.int64), np.array(ths, np.int64)

        def block(p: int, kind: int, k: np.ndarray) -> tuple:
            texts, own = np.unique(of[k], return_inverse=True)
            hashes = (pack_sorted(h1[k]), pack(h2[k])) if not kind else (None, None)
            return p, kind, *hashes, pack(own.astype(np.int32)), pack(at[k].astype(np.int32)), pack(all_ids[texts]), pack(all_ths[texts])

        known, asked = later(h1, h2, all_ids[of], of, at)
        asked = asked[np.argsort(h1[asked])]
        owner = (h1[asked].view(np.uint64) >> np.uint64(40)).astype(np.int64) % shards
        order = np.argsort(owner, kind="stable")
        rows = [block(p, 0, asked[k]) for p, k in enumerate(np.split(order, np.cumsum(np.bincount(owner, minlength=shards))[:-1])) if len(k)]
        rows += [block(mine, 1, known)] if len(known) else []
        ids.clear(), ths.clear(), parts.clear()
        return to_batch(rows, MAIL_SCHEMA)

    chars = 0
    for batch in batches:
        for i, th, text in zip(*(batch.column(c) for c in ("doc_id", "th", "text")), strict=True):
            ids.append(i.as_py())
            ths.append(th.as_py())
            held.append(text.as_py())
            chars += len(held[-1])
            if chars >= most_chars:
                size += lay()
                chars = 0
                if size >= most_spans:
                    yield send()
                    size = 0
    if held:
        lay()
    if parts:
        yield send()


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, at): the first sentence of every span that is not the first of its kind."""
    held: list[tuple[np.ndarray, ...]] = []
    number = 0

    def rows(ids: np.ndarray, ths: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(at), 1 << 16):
            s = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(ths[s]), pa.array(at[s], pa.int32())], ["doc_id", "th", "at"])

    for batch in batches:
        for kind, h1, h2, of, at, ids, ths in zip(*(batch.column(c).to_pylist() for c in ("kind", "h1", "h2", "of", "at", "ids", "ths")), strict=True):
            own = unpack(of, "<i4")
            if kind:
                yield from rows(unpack(ids)[own], unpack(ths)[own], unpack(at, "<i4"))
            else:
                held.append((unpack_sorted(h1), unpack(h2, "<i4"), unpack(ids)[own], unpack(ths)[own], own + number, unpack(at, "<i4")))
                number += int(own.max(initial=-1)) + 1
    if held:
        h1, h2, ids, ths, of, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        gone, _ = later(h1, h2, ids, of, at)
        yield from rows(ids[gone], ths[gone], at[gone])


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, covered), computed once: of each text with spans that are not first, the first sentences of these."""
    source = docs.select(order_key(docs, id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    shards = shards_for(source)
    mail = source.mapInArrow(lambda batches: located(batches, shards, min_sentences, min_words), MAIL)
    found = mail.repartitionById(shards, "p").mapInArrow(answered, "doc_id long, th long, at int")
    # a text has no more spans than sentences
    return cut(found.groupBy("doc_id", "th").agg(F.collect_set("at").alias("covered")))


def without(text: Column, covered: Column, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> Column:
    """struct<kept: string, removed: array<struct<start, end>>, n_removed, n_sentences>; offsets are code points."""

    @F.pandas_udf("kept string, removed array<struct<start:int,end:int>>, n_removed int, n_sentences int")
    def cut_out(texts: pd.Series, covers: pd.Series) -> pd.DataFrame:
        rows, words = [], Words()
        for t, c in zip(texts, covers, strict=True):
            if t is None:
                rows.append((None, [], 0, 0))
                continue
            own = Layout([t], words, min_sentences, min_words)
            ends = [0, *(m.end() for m in PIECE.finditer(t))]
            drop = np.zeros(len(own.stop) + 1, np.int64)
            places = np.flatnonzero(np.isin(own.at, c))
            np.add.at(drop, own.at[places], 1)
            np.add.at(drop, own.to[places] + 1, -1)
            gone = np.cumsum(drop[:-1]) > 0
            kept, removed, before = [], [], 0
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                begin, end = ends[int(own.start[a])] if a else 0, ends[int(own.stop[b - 1]) + 1]
                kept.append(t[before:begin])
                removed.append({"start": begin, "end": end})
                before = end
            kept.append(t[before:])
            rows.append(("".join(kept), removed, int(gone.sum()), len(gone)))
        return pd.DataFrame(rows, columns=["kept", "removed", "n_removed", "n_sentences"])

    return cut_out(text, covered)


def covered_docs(docs: DataFrame, id_col: str, text_col: str, min_sentences: int, min_words: int, how: str) -> DataFrame:
    """(doc: the row, covered): the documents with what to remove. Both sides are dealt by id and text hash."""
    cover = repeated(docs, id_col, text_col, min_sentences, min_words)
    keyed = docs.select(F.struct("*").alias("doc"), order_key(docs, id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"))
    return keyed.join(cover, ["doc_id", "th"], how).select("doc", "covered")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document that loses sentences: id, n_removed, n_sentences, removed (spans), text (what stays)."""
    hit = covered_docs(docs.select(id_col, text_col), id_col, text_col, min_sentences, min_words, "inner")
    cut_out = hit.select(F.col("doc")[id_col].alias(id_col), without(F.col("doc")[text_col], F.col("covered"), min_sentences, min_words).alias("r"))
    return cut_out.select(id_col, "r.n_removed", "r.n_sentences", "r.removed", F.col("r.kept").alias(text_col))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all their columns, with the repeated sentences taken out of the text."""
    joined = covered_docs(docs, id_col, text_col, min_sentences, min_words, "left")
    hit, text = F.col("covered").isNotNull(), F.col("doc")[text_col]
    # only texts that change go to Python
    changed = without(F.when(hit, text), F.col("covered"), min_sentences, min_words)["kept"]
    return joined.select(*[F.when(hit, changed).otherwise(text).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
