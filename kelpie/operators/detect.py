"""Detection: literals against rules.

Every rule's patterns are constants of one projection, so each is compiled once per task and runs inside generated
code; a literal's matching rules come out as one array. Length and name are tested before the value, and a pattern is
only tried where the text has what every match of it must have: a run of characters of some length, and one of some
texts. Both are read from the pattern's parse tree. Only pairs that matched are joined with the (broadcast,
driver-made) rule table for their captures, whose places an Arrow function reads. There is no shuffle.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.strings import shannon_entropy
from kelpie.sources.rules import RUN_BREAK, Rule, default_rules, required, rules_df


def name_passes(rule: Rule, key_name: Column) -> Column:
    """Rules without a name pattern apply to every literal, others to literals bound to a name that matches."""
    return F.lit(True) if rule.name_re is None else F.coalesce(F.rlike(key_name, F.lit(rule.name_re)), F.lit(False))


def folded(value: Column) -> Column:
    """In lower case, with the four letters that match ASCII ones where case is ignored replaced by these."""
    return F.lower(F.translate(value, "\u017f\u212a\u0130\u0131", "skii"))


def run_length(value: Column) -> Column:
    """The length of the longest run of word characters and the marks that stand in keys."""
    return F.coalesce(F.array_max(F.transform(F.split(value, RUN_BREAK), F.length)), F.lit(0))


def hit(rule: Rule, value: Column, key_name: Column | None, lowered: Column, run: Column) -> Column:
    """The pattern itself is tried last, where name, length, longest run and the texts it requires allow a match."""
    test = F.length(value) >= rule.min_length
    if key_name is not None:
        test &= name_passes(rule, key_name)
    if rule.plain:
        return test & F.contains(value, F.lit(rule.value_re))
    least, needles = required(rule.value_re)
    if least > 1:
        test &= run >= least
    if needles:
        some = F.contains(lowered, F.lit(needles[0]))
        for n in needles[1:]:
            some |= F.contains(lowered, F.lit(n))
        test &= some
    return test & F.rlike(value, F.lit(rule.value_re))


def rule_hits(literals: DataFrame, rules: list[Rule] | None = None, value: str = "value", key_name: str | None = "key_name") -> DataFrame:
    """A row for each literal and rule that match: the literal's columns and rule_idx.

    With key_name None, names are not looked at and every rule is tried on the value alone.
    """
    rules = default_rules() if rules is None else rules
    if not rules:
        return literals.withColumn("rule_idx", F.lit(0)).where(F.lit(False))
    row = literals.select(F.struct("*").alias("row"))
    own = F.col("row")[value]
    name = None if key_name is None else F.col("row")[key_name]
    # computed once for all rules
    measured = row.withColumn("lowered", folded(own)).withColumn("run", run_length(own))
    found = F.array_compact(F.array(*[F.when(hit(r, own, name, F.col("lowered"), F.col("run")), F.lit(r.rule_idx)) for r in rules]))
    return measured.select("row", F.explode(found).alias("rule_idx")).select("row.*", "rule_idx")


def python_pattern(java: str) -> regex.Pattern:
    ignore_case = java.startswith("(?iu)")
    plain = java.removeprefix("(?iu)").removeprefix("(?U)").replace(r"\z", r"\Z")
    return regex.compile(plain, regex.V1 | (regex.IGNORECASE if ignore_case else 0))


def word_around(value: str, text: str) -> tuple[int, str] | None:
    """The first place of a text, and on to the next white space or semicolon; back to the one before likewise."""
    start = value.find(text)
    if start < 0:
        return None
    ends = lambda c: c.isspace() or c == ";"
    end = start + len(text)
    while end < len(value) and not ends(value[end]):
        end += 1
    while start > 0 and not ends(value[start - 1]):
        start -= 1
    return start, value[start:end]


def captures(value: Column, pattern: Column, n_groups: Column, plain: Column) -> Column:
    """array<struct<group_idx, start, secret>> of the first match: its groups, whole match first.

    Groups that took no part, or only white space, are left out. start counts code points from 0. The texts are those
    of the engine that found the match; only pairs that matched come here. Where a group stands is read from a second
    engine at the same place, which has to give the same texts; else it is the text's first place in the match.
    """
    texts = F.transform(F.sequence(F.lit(0), n_groups), lambda g: F.call_function("regexp_extract", value, pattern, g))
    first = F.regexp_instr(value, pattern) - 1

    @F.pandas_udf("array<struct<group_idx:int,start:int,secret:string>>")
    def placed(values: pd.Series, patterns: pd.Series, plains: pd.Series, groups: pd.Series, starts: pd.Series) -> pd.Series:
        compiled: dict[str, regex.Pattern | None] = {}
        out = []
        for v, p, is_plain, own, at in zip(values, patterns, plains, groups, starts, strict=True):
            if is_plain:
                around = word_around(v, p)
                out.append([{"group_idx": 0, "start": around[0], "secret": around[1]}] if around and around[1].strip() else [])
                continue
            if p not in compiled:
                try:
                    compiled[p] = python_pattern(p)
                except regex.error:
                    compiled[p] = None
            m = compiled[p].match(v, int(at)) if compiled[p] else None
            same = m is not None and [m[g] or "" for g in range(len(own))] == list(own)
            spot = lambda g, t: m.start(g) if same else int(at) + own[0].find(t)  # noqa: B023, E731
            out.append([{"group_idx": g, "start": spot(g, t), "secret": t} for g, t in enumerate(own) if t and not t.isspace()])
        return pd.Series(out, dtype=object)

    # no pattern is read where the text is meant as it is
    return placed(value, pattern, plain, F.when(plain, F.array(F.lit(""))).otherwise(texts), F.when(plain, F.lit(0)).otherwise(first))


def without_repeats(found: Column) -> Column:
    """Drops an element equal in start and text to the one before it."""
    return F.filter(found, lambda s, i: (i == 0) | (F.get(found, i - 1)["start"] != s["start"]) | (F.get(found, i - 1)["secret"] != s["secret"]))


def gates(rule_id: Column, secret: Column, min_entropy: Column) -> Column:
    """Generic rules want a digit; rules with a threshold want that entropy, compared as floats."""
    digit = ~F.startswith(rule_id, F.lit("generic")) | F.rlike(secret, F.lit("[0-9]"))
    entropy = F.when(min_entropy.isNull(), F.lit(True)).otherwise(shannon_entropy(secret).cast("float") >= min_entropy)
    return digit & entropy


def detect(literals: DataFrame, rules: list[Rule] | None = None, value: str = "value", key_name: str = "key_name", span_start: str | None = "span_start") -> DataFrame:
    """Findings: the literal's columns, and rule_idx, rule_id, description, group_idx, secret, start and end.

    start and end are byte offsets: the literal's span_start (its opening quote, or 0 without that column) plus the
    capture's place in the decoded value. One literal gives a row for each rule and distinct group.
    """
    rules = default_rules() if rules is None else rules
    table = rules_df(literals.sparkSession, rules).select("rule_idx", F.struct("rule_id", "value_re", "n_groups", "min_entropy", "description", "plain").alias("rule"))
    # the table is made on the driver from the rule pack: its size does not depend on data
    hits = rule_hits(literals, rules, value, key_name).select(F.struct(*[F.col(f"`{c}`") for c in literals.columns]).alias("row"), "rule_idx")
    matched = hits.join(F.broadcast(table), "rule_idx")
    listed = matched.withColumn("all", captures(F.col("row")[value], F.col("rule.value_re"), F.col("rule.n_groups"), F.col("rule.plain"))).withColumn("each", F.explode(without_repeats(F.col("all"))))
    secret = F.col("each.secret")
    kept = listed.where(gates(F.col("rule.rule_id"), secret, F.col("rule.min_entropy")))
    base = F.lit(0) if span_start is None else F.col("row")[span_start]
    before = F.octet_length(F.substring(F.col("row")[value], F.lit(1), F.col("each.start")))
    return kept.select(
        "row.*",
        "rule_idx",
        "rule.rule_id",
        "rule.description",
        F.col("each.group_idx").alias("group_idx"),
        secret.alias("secret"),
        (base + before).alias("start"),
        (base + before + F.octet_length(secret)).alias("end"),
    )
