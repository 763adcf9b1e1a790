"""The rule table: parsing, splitting into name and value patterns, translation to Java regular expressions."""

from __future__ import annotations

import logging
import re
import re._parser as sre
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

#: Fixed value: what stands between a name and its value in a rule's pattern.
ASSIGNMENT = r"""(?:[\s|']|[\s|"]){0,3}(?:=|>|:{1,3}=|\|\|:|<=|=>|:|\?=)(?:'|\"|\s|=|\x60){0,5}"""
SCHEMA = "rule_idx int, rule_id string, name_re string, value_re string, n_groups int, min_length int, keywords array<string>, min_entropy float, description string, plain boolean"


@dataclass(frozen=True)
class Rule:
    """One row of the rule table. Patterns are Java's; name_re is None for rules that need no name.

    plain: value_re is a text to be contained, not a pattern.
    """

    rule_idx: int
    rule_id: str
    name_re: str | None
    value_re: str
    n_groups: int
    min_length: int
    keywords: tuple[str, ...]
    min_entropy: float | None
    description: str
    plain: bool = False


def plain_rule(idx: int, rule_id: str, text: str, description: str, min_entropy: float | None = None) -> Rule:
    """A rule that looks for a text as it is; the word around it is the secret."""
    return Rule(idx, rule_id, None, text, 0, len(text), (), min_entropy, description, True)


def pieces(pattern: str) -> list[tuple[str, bool]]:
    """The pattern as escapes and single characters, each with whether it stands in a character class."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        step = 2 if pattern[at] == "\\" else 1
        piece = pattern[at : at + step]
        if piece == "[" and not inside:
            inside = True
            out.append((piece, True))
        else:
            out.append((piece, inside))
            if piece == "]":
                inside = False
        at += step
    return out


def to_java(pattern: str, ignore_case: bool) -> str:
    """Named groups lose their names, $ means the end of the text only, and classes and case are Unicode's."""
    plain = regex.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)
    strict = "".join(r"\z" if p == "$" and not inside else r"\[" if p == "[" and inside and k and parts[k - 1][1] else p for parts in [pieces(plain)] for k, (p, inside) in enumerate(parts))
    return ("(?iu)" if ignore_case else "") + "(?U)" + strict


def group_count(pattern: str) -> int:
    parts = pieces(pattern)
    n = 0
    for k, (p, inside) in enumerate(parts):
        if p == "(" and not inside:
            after = "".join(x for x, _ in parts[k + 1 : k + 4])
            n += not after.startswith("?") or after.startswith("?P<") or (after.startswith("?<") and after[2:3] not in ("=", "!"))
    return n


def shortest(pattern: str) -> int:
    """A lower bound of a match's length in code points; 0 where it can't be told."""
    try:
        return int(sre.parse(regex.sub(r"\(\?[a-zA-Z]+\)", "", pattern)).getwidth()[0])
    except Exception:  # noqa: BLE001 - a bound of 0 only costs time
        return 0


def compiles(pattern: str, ignore_case: bool) -> bool:
    try:
        regex.compile(pattern, regex.V1 | (regex.IGNORECASE if ignore_case else 0))
    except regex.error as e:
        log.warning("a pattern does not compile: %s", e)
        return False
    return True


def compile_rule(idx: int, raw: dict) -> Rule | None:
    """None if the value's pattern does not compile. A name pattern that does not compile asks for no name."""
    pattern: str = raw["regex"]
    ignore_case = pattern.startswith("(?i)")
    pattern = pattern.removeprefix("(?i)")
    name, value = None, pattern
    if ASSIGNMENT in pattern:
        name, value, *_ = pattern.split(ASSIGNMENT)
    if not compiles(value, ignore_case):
        log.warning("rule %s is left out", raw["id"])
        return None
    if name is not None and not compiles(name, ignore_case):
        name = None
    entropy = raw.get("entropy")
    return Rule(
        idx, raw["id"], None if name is None else to_java(name, ignore_case), to_java(value, ignore_case), group_count(value), shortest(value),
        tuple(raw.get("keywords") or ()), None if entropy is None else float(entropy), raw["description"],
    )


def parse_rules(text: str) -> list[Rule]:
    """Rules of a TOML text; their index counts those that compile."""
    found: list[Rule] = []
    for raw in tomllib.loads(text).get("rules", []):
        rule = compile_rule(len(found), raw)
        if rule is not None:
            found.append(rule)
    return found


def default_rules() -> list[Rule]:
    """The packaged rules."""
    return parse_rules(resources.files("kelpie.data").joinpath("rules.toml").read_text("utf-8"))


def rules_from_file(path: str) -> list[Rule]:
    return parse_rules(Path(path).read_text("utf-8"))


def rules_df(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """The rule table; an empty list gives an empty table. It is part of the plan: no task makes it."""
    rules = default_rules() if rules is None else rules
    schema = StructType.fromDDL(SCHEMA)
    rows = [(r.rule_idx, r.rule_id, r.name_re, r.value_re, r.n_groups, r.min_length, list(r.keywords), r.min_entropy, r.description, r.plain) for r in rules]
    table = pa.Table.from_pylist([dict(zip(schema.names, row, strict=True)) for row in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)


#: Characters of runs that are told apart from the rest of a text in one pass: Unicode's word characters and these.
RUN_MARKS = "-./+="
RUN_BREAK = r"(?U)[^\w\-./+=]+"


@lru_cache(4096)
def tree_of(pattern: str) -> list | None:
    """The parse tree of a Java pattern of the rules, flags left out; None where it can't be read."""
    try:
        return list(sre.parse(re.sub(r"\(\?[a-zA-Z]+\)", "", pattern).replace(r"\z", r"\Z")))
    except Exception:  # noqa: BLE001 - without a tree a pattern is only tried more often
        return None


def in_runs(op: str, arg: object) -> bool:
    """Whether a single-character item matches characters of runs only, whatever the case."""
    word = lambda c: chr(c).isalnum() or chr(c) == "_" or chr(c) in RUN_MARKS
    if op == "LITERAL":
        return word(arg)
    if op != "IN":
        return False
    for kind, x in arg:
        name = str(kind)
        ok = (name == "LITERAL" and word(x)) or (name == "RANGE" and x[1] < 128 and all(map(word, range(x[0], x[1] + 1)))) or (name == "CATEGORY" and str(x) in ("CATEGORY_WORD", "CATEGORY_DIGIT"))
        if not ok:
            return False
    return True


def longest_run(items: list) -> tuple[int, int | None]:
    """The least length of the longest run in any match, and the match's least length if it is one run from end to end."""
    best, open_, whole = 0, 0, True
    for op, arg in items:
        name = str(op)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if name == "SUBPATTERN":
            inner, width = longest_run(list(arg[3]))
        elif name == "BRANCH":
            each = [longest_run(list(b)) for b in arg[1]]
            inner, width = min(x for x, _ in each), None if any(w is None for _, w in each) else min(w for _, w in each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            inner, width = longest_run(list(arg[2]))
            inner, width = (inner if arg[0] else 0), None if width is None else width * int(arg[0])
        else:
            inner, width = (1, 1) if in_runs(name, arg) else (0, None)
        if width is None:
            best, open_, whole = max(best, open_, inner), 0, False
        else:
            open_ += width
    return max(best, open_), open_ if whole else None


def needle_sets(items: list) -> Iterator[frozenset[str]]:
    """Sets of lower-case ASCII texts of which every match holds one of each."""
    literal = ""
    for op, arg in [*items, ("END", None)]:
        name = str(op)
        if name == "LITERAL" and arg < 128:
            literal += chr(arg).lower()
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if literal:
            yield frozenset([literal])
        literal = ""
        if name == "SUBPATTERN":
            yield from needle_sets(list(arg[3]))
        elif name == "BRANCH":
            each = [max(needle_sets(list(b)), key=lambda s: min(map(len, s)), default=None) for b in arg[1]]
            if None not in each:
                yield frozenset().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0]:
            yield from needle_sets(list(arg[2]))


@lru_cache(4096)
def required(pattern: str) -> tuple[int, tuple[str, ...]]:
    """What a text must have for the pattern to match in it: a run of that many characters, and one of these texts."""
    tree = tree_of(pattern)
    if tree is None:
        return 0, ()
    needles = max(needle_sets(tree), key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())
    return longest_run(tree)[0], tuple(sorted(needles)) if needles and len(needles) <= 16 else ()
