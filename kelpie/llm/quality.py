"""Rule bitmask ledger: every quality rule is evaluated once per document; failures are bits of one long.

The ledger (measurements + failure bits) is computed in one map pass with no shuffle. Policies are versioned
sets of rules applied to the bits, so changing a policy or asking what a rule costs never touches the texts again.

Defined results: a null or empty text has no words and fails the rules on too few words; a very long text is measured
whole, in memory in proportion to its words; repeated rows give repeated results; a null id stays null; an empty table gives
an empty ledger. The ledger reads the id and the text only; keep() passes all columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import ASCII_SPACE, map_rows, text_or_empty

SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    """One bit of the ledger; fails is SQL over the measurements."""

    name: str
    fails: str


#: The bit of a rule is its place here; rules are only ever appended, so stored ledgers stay readable.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("too_many_words", "n_words > 1000000"),
)
BASE = ("too_few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of what is enforced: a document is rejected when it fails any of these rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [r.name for r in RULES]
        return sum(1 << names.index(r) for r in set(self.rules))


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", (*BASE, "many_symbols", "duplicate_lines", "short_words", "long_words")),
    )
}
DEFAULT_POLICY = "v1"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a 3-word window that occurs twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen: set = set()
    twice = set()
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            seen.add(w)
    if not twice:
        return 0
    starts = np.fromiter((w in twice for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= starts
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    lines = [line for line in text.split("\n") if line.strip(ASCII_SPACE)]
    return len(words), word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated_words(words)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measurements, failure_bits) for every document."""

    def rows(batch: dict) -> Iterator[tuple]:
        for i, text in zip(batch["id"], batch["text"], strict=True):
            yield i, *measure(text)

    id_type = docs.schema[id_col].dataType.simpleString()
    measured = map_rows(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), f"id {id_type}, {MEASURES}", rows)
    return measured.withColumn("failure_bits", failure_bits()).withColumnRenamed("id", id_col)


def failure_bits() -> Column:
    """The ledger's bits, from columns named like the measurements: each rule is evaluated once."""
    total = F.lit(0).cast("long")
    for k, r in enumerate(RULES):
        total = total.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return total


def fails(policy: str, bits: str = "failure_bits") -> Column:
    """Whether stored bits break the policy of that version."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy].mask)) != 0


def ablations(ledger_df: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were left out.

    One aggregation over the bits; at most one row per distinct bit pattern leaves the map side.
    """
    mask = POLICIES[policy].mask
    patterns = ledger_df.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [(r.name, 1 << k) for k, r in enumerate(RULES) if mask >> k & 1]
    each = patterns.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r"))
    hit, only = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(only, F.col("n")).otherwise(0)).alias("failing_alone"),
        F.sum(F.when((F.col("bits") == 0) | only, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, whose ledger bits the policy keeps.

    The measurements are taken beside the row by a scalar Arrow function: no shuffle and no join by id.
    """
    names = [f.split()[0] for f in MEASURES.split(", ")]

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ': ') for f in MEASURES.split(', '))}>")
    def measured(text: pa.Array) -> pa.Array:
        columns = list(zip(*[measure(t) for t in text.to_pylist()], strict=True)) or [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    beside = docs.select(F.struct("*").alias("doc"), measured(text_or_empty(text_col)).alias("m")).select("doc", "m.*")
    return beside.select("doc", failure_bits().alias("failure_bits")).where(~fails(policy)).select("doc.*")
