"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Tokens are the runs of letters and digits of the lower-cased text. Four fixed masks say which token positions of a
window are hashed and which are ignored; training and benchmark windows with an equal hash are hits. The masks
were chosen so that every 13 tokens with at most two substitutions hold an intact seed of one of them. Around a
hit the document and the item are laid over each other on the hit's diagonal and compared token by token: they
overlap if some stretch of `window` tokens (the whole item, if shorter) agrees in at least `share` of them.

Scale: documents are never moved for the search. Benchmark hashes are broadcast only when they take at most
`broadcast_bytes`, else the two sides are joined by hash through a shuffle. Hits are collapsed per (document, item,
diagonal) before their shuffle, and only documents with hits are read again for the comparison.

Defined results: null and empty texts have no tokens and no overlaps; items of fewer than min_tokens tokens are
no evidence; items of fewer than SURE tokens are also searched with those tokens left out whose substitution the share
allows and no mask survives; very long texts are searched and compared whole; of diagonals that overlap alike the one
that begins first is told; rows that repeat both id and text are one document in the result; ids may be of any type,
null or repeated; equal items (after lower-casing) are searched once and each gets its rows; an empty table gives an
empty result. Other columns of the documents pass through remove_contaminated, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import cut, sized, text_or_empty

MASKS = ("1110000111", "110011011", "1101011001", "11110101")
#: Copies of the items where these are too many to be broadcast.
SALTS = 16
#: So many tokens hold an intact seed whichever two of them are substituted.
SURE = 13


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def seed(words: str, at: str, offsets: list[int], tag: int) -> Column:
    return F.xxhash64(F.lit(tag), *[F.expr(f"get({words}, {at} + {o})") for o in offsets])


def left_out(n: int, share: float) -> list[tuple[int, ...]]:
    """The sets of tokens of an item of n that may differ at this share and leave no seed of a mask intact."""
    places = [[o + k for k, c in enumerate(m) if c == "1"] for m in MASKS for o in range(n - len(m) + 1)]
    return [gone for gone in combinations(range(n), n - math.ceil(n * share)) if not any(set(p).isdisjoint(gone) for p in places)]


def seeds(rows: DataFrame, keep: list[str], short: list[int], share: float, whole: bool = False) -> DataFrame:
    """(keep, at, h): every window of the column words under every mask.

    For each length in short also the windows of that length without each of the sets left_out(); of whole rows, only
    those that have just that length. Windows are as wide as the tokens that are hashed, and at is the first of these.
    """
    at = rows.select(*keep, "words", F.size("words").alias("n"), F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
    fits = lambda span: F.col("at") + span <= F.col("n")
    hashes = [F.when(fits(len(m)), seed("words", "at", [i for i, c in enumerate(m) if c == "1"], k)) for k, m in enumerate(MASKS)]
    for s in short:
        for k, gone in enumerate(left_out(s, share)):
            first, *others = [i for i in range(s) if i not in gone]
            own = (F.col("n") == s) & (F.col("at") == first) if whole else fits((others or [first])[-1] - first + 1)
            hashes.append(F.when(own, seed("words", "at", [0, *(i - first for i in others)], 1000 * s + k)))
    return at.select(*keep, "at", F.explode(F.array(*hashes)).alias("h")).where("h is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, min_tokens: int = 5, broadcast_bytes: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, aligned, matched, best, needed): the best diagonal of each pair that overlaps.

    doc_start and item_start are the first aligned tokens, aligned their number, matched how many agree, best how
    many agree in the best stretch, needed how many had to.
    """
    return found_overlaps(docs, benchmark, window, share, min_tokens, broadcast_bytes, id_col, text_col).drop("th")


def found_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, min_tokens: int = 5, broadcast_bytes: int = 1 << 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with th, the hash of the document's text."""
    items = benchmark.select(F.col("item_id"), tokens(text_or_empty("text")).alias("words")).where(F.size("words") >= min_tokens)
    items = items.withColumn("class_id", F.unhex(F.md5(F.array_join("words", " "))))
    classes = cut(items.groupBy("class_id").agg(F.first("words").alias("words")))
    # at most SURE - min_tokens numbers
    short = sorted(r[0] for r in classes.where(F.size("words") < SURE).select(F.size("words")).distinct().collect())
    train = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    keyed = train.select("doc_id", F.xxhash64("text").alias("th"), tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    asked = sized(cut(seeds(classes.where(F.size("words") >= min_tokens), ["class_id"], short, share, whole=True).withColumnRenamed("at", "item_at")), broadcast_bytes)
    hits = seeds(keyed, ["doc_id", "th"], short, share).join(asked, "h").groupBy("doc_id", "th", "class_id", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("hits"))
    # few documents have hits, as a rule: then their texts stay where they are
    found = verify(sized(cut(hits), broadcast_bytes), train.select("doc_id", F.xxhash64("text").alias("th"), "text"), classes, window, share, broadcast_bytes)
    named = found.join(sized(cut(items.select("class_id", "item_id").distinct()), broadcast_bytes), "class_id")
    return named.select("doc_id", "th", "item_id", (-F.col("t.d")).alias("doc_start"), (-F.col("t.i")).alias("item_start"), "t.aligned", "t.matched", "t.best", "t.needed")


def beside_items(read: DataFrame, classes: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The rows with the tokens of their class, as item: broadcast if they are few, else dealt by salt, as a class may have very many rows."""
    item = classes.select("class_id", F.col("words").alias("item"))
    small = sized(item, broadcast_bytes)
    if small is not item:
        return read.join(small, "class_id")
    salted = item.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return read.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(SALTS)).cast("int")).join(salted, ["class_id", "salt"]).drop("salt")


def verify(hits: DataFrame, texts: DataFrame, classes: DataFrame, window: int, share: float, broadcast_bytes: int) -> DataFrame:
    """(doc_id, th, class_id, t) of the overlaps among (doc_id, th, class_id, diagonal)."""
    a, b = texts.alias("a"), hits.alias("b")
    met = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")))
    read = met.select("b.doc_id", "b.th", "class_id", "diagonal", tokens(F.col("text")).alias("words"))
    both = beside_items(read, classes, broadcast_bytes).withColumn("n_item", F.size("item"))
    doc_start, item_start = F.greatest(F.col("diagonal"), F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    placed = both.withColumn("doc_start", doc_start).withColumn("item_start", item_start)
    placed = placed.withColumn("aligned", F.least(F.col("n_item") - F.col("item_start"), F.size("words") - F.col("doc_start")))
    same = F.zip_with(F.expr("slice(words, doc_start + 1, aligned)"), F.expr("slice(item, item_start + 1, aligned)"), lambda a, b: (a == b).cast("int"))
    compared = placed.withColumn("same", same).withColumn("w", F.least(F.lit(window), F.col("n_item"))).withColumn("needed", F.ceil(F.col("w") * F.lit(share)).cast("int"))
    # running sums: a stretch's agreement is the difference of two of them
    sums = F.aggregate("same", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    summed = compared.where("aligned >= needed").withColumn("sums", sums)
    best = F.expr("array_max(transform(sequence(0, greatest(aligned - w, 0)), i -> get(sums, least(i + w, aligned)) - get(sums, i)))")
    found = summed.withColumn("best", best).where("best >= needed")
    return found.groupBy("doc_id", "th", "class_id").agg(
        F.max(F.struct("best", F.element_at("sums", -1).alias("matched"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "aligned", "needed")).alias("t")
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 1 << 26, **options) -> DataFrame:
    """The documents, all their columns, that overlap with no item. Rows are told apart by id, null or not, and text."""
    found = found_overlaps(docs, benchmark, id_col=id_col, text_col=text_col, broadcast_bytes=broadcast_bytes, **options)
    bad = sized(cut(found.select("doc_id", "th").distinct()), broadcast_bytes).alias("b")
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th")).alias("a")
    return keyed.join(bad, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left_anti").select("doc.*")
