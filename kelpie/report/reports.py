"""Reports of findings: JSON lines, text, redaction, the summary line, and sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.strings import redact

#: Fields of a finding in the order of declaration; JSON to stdout has them by name.
FIELDS = ("rule_id", "key_name", "secret", "line", "column", "script_url")
SORTED_FIELDS = tuple(sorted(FIELDS))
LONGEST_LINE = 120
CONTEXT = 3
Sink = Callable[[DataFrame], None]


def json_lines(findings: DataFrame, by_name: bool = True) -> DataFrame:
    """One JSON object a finding in the column value; null names are written. Secrets are never redacted here."""
    fields = SORTED_FIELDS if by_name else FIELDS
    return findings.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_json(findings: DataFrame, path: str) -> None:
    findings.select(*FIELDS).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def shown(secret: Column, redacted: bool) -> Column:
    return redact(secret) if redacted else secret


def header() -> Column:
    return F.concat(F.lit("🔑 "), F.col("rule_id"), F.lit(": "), F.col("description"))


def subheader(redacted: bool) -> Column:
    return F.concat(F.lit('Found key "'), shown(F.col("secret"), redacted), F.lit('" in script '), F.col("script_url"), F.lit(" ("), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"), F.lit(")"))


def line_text(source: Column, line: Column) -> Column:
    return F.coalesce(F.get(F.split(source, "\n"), line - 1), F.lit(""))


def shows_source(source: Column, line: Column) -> Column:
    """Only lines of up to 120 bytes, with the line feed before them, are shown with their neighbours."""
    return F.octet_length(line_text(source, line)) + F.when(line > 1, 1).otherwise(0) <= LONGEST_LINE


#: JavaScript's words that are coloured, where an even number of double quotes follows in the line.
WORDS = r"\b(const|let|var|function|return|new|if|else|for|while|class|import|export|async|await)\b(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
COLOURED = "\x1b[35m$1\x1b[0m"


def snippet(source: Column, line: Column, colours: bool = False) -> Column:
    """Three lines either side, each with its number; with colours, JavaScript's words stand out on a terminal."""
    lines = F.split(source, "\n")
    begin = F.greatest(line - CONTEXT, F.lit(1))
    part = F.slice(lines, begin, F.least(line + CONTEXT, F.size(lines)) - begin + 1)
    plain = lambda s: F.regexp_replace(s, "\r$", "")
    shown_line = (lambda s: F.regexp_replace(plain(s), WORDS, COLOURED)) if colours else plain
    return F.array_join(F.transform(part, lambda s, i: F.concat(F.lit("  "), (begin + i).cast("string"), F.lit(" "), shown_line(s))), "\n")


def data_table(redacted: bool) -> Column:
    rows = (
        ("Rule ID:      ", F.col("rule_id")),
        ("Script URL:   ", F.col("script_url")),
        ("API Key Name: ", F.coalesce("key_name", F.lit("<None>"))),
        ("Secret:       ", shown(F.col("secret"), redacted)),
        ("Line:         ", F.col("line").cast("string")),
        ("Column:       ", F.col("column").cast("string")),
    )
    return F.concat_ws("\n", *[F.concat(F.lit("   " + name), value) for name, value in rows])


def graphical(findings: DataFrame, redacted: bool = False, source: str | None = None, colours: bool = False) -> DataFrame:
    """A text for each finding in the column value: header, place, the source's lines if given and short, a table."""
    parts = [header(), subheader(redacted)]
    if source is not None:
        parts.append(F.when(shows_source(F.col(source), F.col("line")), F.concat(F.lit("\n"), snippet(F.col(source), F.col("line"), colours))))
    return findings.select(F.concat_ws("\n", *parts, F.lit(""), data_table(redacted), F.lit("")).alias("value"))


def summary_line(summary: DataFrame, seconds: float) -> DataFrame:
    """The closing line, in the column value."""
    text = F.concat(
        F.lit("Found "), F.col("keys_found").cast("string"), F.lit(" key(s) across "), F.col("scripts_checked").cast("string"), F.lit(" script(s) and "), F.col("pages_crawled").cast("string"), F.lit(f" page(s) in {seconds:.2f}s")
    )
    return summary.select(text.alias("value"))


def exit_code(errors: DataFrame) -> int:
    """1 if a walk failed, else 0."""
    return int(not errors.where("stage = 'walk'").isEmpty())


@dataclass
class Reporter:
    """Hands findings to a sink and keeps the counts of what went through it."""

    sink: Sink
    redacted: bool = False
    keys_found: int = 0
    scripts_checked: int = 0
    pages_crawled: int = 0

    def report(self, findings: DataFrame) -> None:
        """The findings are computed once, for the sink and for the count of distinct secrets."""
        kept = findings.persist()
        try:
            self.sink(kept)
            self.keys_found = kept.agg(F.count_distinct("secret")).first()[0]
        finally:
            kept.unpersist()

    def record_scripts_checked(self, n: int) -> None:
        self.scripts_checked += n

    def record_pages_crawled(self, n: int) -> None:
        self.pages_crawled += n


def json_reporter(path: str) -> Reporter:
    return Reporter(lambda findings: json_lines(findings).write.mode("append").text(path))


def graphical_reporter(path: str | None = None, redacted: bool = False) -> Reporter:
    """To a folder of text files, or to the console, where all findings are printed, a partition at a time."""

    def show(findings: DataFrame) -> None:
        for row in graphical(findings, redacted).toLocalIterator():
            print(row.value)

    def write(findings: DataFrame) -> None:
        graphical(findings, redacted).write.mode("append").text(path)

    return Reporter(show if path is None else write, redacted)
