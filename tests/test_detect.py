import pytest
from kelpie.operators.detect import detect, rule_hits
from kelpie.sources.rules import compile_rule, default_rules, parse_rules, plain_rule, required, rules_df

HEX40 = "0123456789" + "abcdef0123" * 3
AWS = "AKIA" + "QWERTYUIOPASDFGH"


def found(spark, rows, rules=None):
    df = spark.createDataFrame(rows, "id int, value string, key_name string, span_start int")
    return sorted((r.id, r.rule_id, r.group_idx, r.secret, r.start, r.end) for r in detect(df, rules).collect())


def test_one_key_one_finding(spark):
    got = found(spark, [(1, AWS, "x", 10)])
    assert [(r[1], r[3], r[4], r[5]) for r in got] == [("aws-access-token", AWS, 10, 30)]


def test_names(spark):
    rows = [(1, HEX40, "token", 0), (2, HEX40, "colour", 0), (3, HEX40, None, 0)]
    assert {r[0] for r in found(spark, rows) if r[1] == "generic-api-key"} == {1}


def test_lost_left_context(spark):
    """A pattern that is cut off its name is not anchored: it takes the last 32 of 40 digits."""
    got = [r for r in found(spark, [(1, HEX40, "mailgun", 5)]) if r[1] == "adobe-client-id" or "adobe" in r[1]]
    assert got == []
    got = [r for r in found(spark, [(1, HEX40, "adobe", 5)]) if r[1] == "adobe-client-id"]
    assert [(r[3], r[4]) for r in got] == [(HEX40[-32:], 13)]


def test_group_fan_out_and_terminator(spark):
    key = "sk_test_" + "a1b2c3d4e5"
    got = [r for r in found(spark, [(1, key, None, 0)]) if r[1] == "stripe-access-token"]
    assert {r[3] for r in got} == {key, "sk", "test"}
    with_end = [r for r in found(spark, [(1, HEX40[:32] + ";", "adobe", 0)]) if r[1] == "adobe-client-id"]
    assert [r[3] for r in with_end] == [HEX40[:32] + ";", HEX40[:32]]


def test_first_match_only(spark):
    assert len([r for r in found(spark, [(1, f"{AWS} {AWS[:-1]}X", None, 0)]) if r[1] == "aws-access-token"]) == 1


def test_gates(spark):
    rules = parse_rules("[[rules]]\nid='generic-x'\ndescription='d'\nregex='[a-z0-9]{4}'\n[[rules]]\nid='h'\ndescription='d'\nregex='[a-z]{4}'\nentropy=1.5")
    assert [r[1] for r in found(spark, [(1, "abcd", None, 0)], rules)] == ["h"]
    assert [r[1] for r in found(spark, [(1, "abc1", None, 0)], rules)] == ["generic-x"]
    assert [r[1] for r in found(spark, [(1, "aaab", None, 0)], rules)] == []


def test_offsets_are_bytes(spark):
    (r,) = [x for x in found(spark, [(1, "é" + AWS, None, 3)]) if x[1] == "aws-access-token"]
    assert (r[4], r[5]) == (5, 25)


def test_groups_stand_where_they_matched(spark):
    """A group whose text occurs earlier in the match, in a repeat, after other characters, and one that took no part."""
    patterns = ["(?:ab)=([a-z]+);(ab)", "(a)|(b+)c", "x(?:([0-9])-)+", "é(k)(k)", "(?i)(q)\\1"]
    rules = [compile_rule(k, {"id": f"r{k}", "description": "d", "regex": p}) for k, p in enumerate(patterns)]
    rows = [(0, "ab=qq;ab", None, 100), (1, "..bbc a", None, 0), (2, "x1-2-1-", None, 0), (3, "kékk", None, 0), (4, "..Qq", None, 0)]
    got = [r for r in found(spark, rows, rules) if r[1] == f"r{r[0]}"]
    assert got == [
        (0, "r0", 0, "ab=qq;ab", 100, 108), (0, "r0", 1, "qq", 103, 105), (0, "r0", 2, "ab", 106, 108), (1, "r1", 0, "bbc", 2, 5), (1, "r1", 2, "bb", 2, 4),
        (2, "r2", 0, "x1-2-1-", 0, 7), (2, "r2", 1, "1", 5, 6), (3, "r3", 0, "ékk", 1, 5), (3, "r3", 1, "k", 3, 4), (3, "r3", 2, "k", 4, 5), (4, "r4", 0, "Qq", 2, 4), (4, "r4", 1, "Q", 2, 3),
    ]


def test_plain_texts(spark):
    """Rules that look for a text as it is: the word around its first place."""
    rules = [plain_rule(0, "t", "KEY[", "d"), plain_rule(1, "u", "zz", "d", 2.0)]
    rows = [(1, "a xKEY[9;b", None, 10), (2, "KEY[", None, 0), (3, "key[", None, 0), (4, "é KEY[ KEY[2", None, 0), (5, "zzz", None, 0), (6, "azzbcd;", None, 0)]
    assert found(spark, rows, rules) == [(1, "t", 0, "xKEY[9", 12, 18), (2, "t", 0, "KEY[", 0, 4), (4, "t", 0, "KEY[", 3, 7), (6, "u", 0, "azzbcd", 0, 6)]
    assert rules_df(spark, rules).where("plain").count() == 2


def test_what_is_tested_before_a_pattern_loses_no_match(spark):
    """Every literal that a pattern matches has the run and one of the texts that are asked for first."""
    from pyspark.sql import functions as F

    from kelpie.plans.queries import made_literals

    values = [v for _, v, _, _ in made_literals()]
    odd = str.maketrans({"s": "ſ", "k": "K", "i": "ı", "I": "İ"})
    values += [v.swapcase() for v in values] + [v.translate(odd) for v in values] + [f"é {v} ü" for v in values]
    rules = default_rules()
    df = spark.createDataFrame(list(enumerate(values)), "id int, value string").repartition(4)
    plain = df.select("id", F.explode(F.array_compact(F.array(*[F.when(F.rlike("value", F.lit(r.value_re)), F.lit(r.rule_idx)) for r in rules]))).alias("rule_idx"))
    expected = {tuple(r) for r in plain.collect()}
    assert len(expected) > 800
    assert {(r.id, r.rule_idx) for r in rule_hits(df, rules, key_name=None).select("id", "rule_idx").collect()} == expected
    asked = [required(r.value_re) for r in rules]
    assert sum(run > 8 or bool(needles) for run, needles in asked) > 150


def test_unicode_and_line_end(spark):
    rules = parse_rules(r"[[rules]]" + "\nid='d'\ndescription='d'\nregex='^\\d$'\n[[rules]]\nid='k'\ndescription='d'\nregex='(?i)k'\n")
    assert [r[1] for r in found(spark, [(1, "٣", None, 0)], rules)] == ["d"]
    assert [r[1] for r in found(spark, [(1, "K", None, 0)], rules)] == ["k"]
    assert found(spark, [(1, "1\n", None, 0)], rules) == []


def test_nulls_empty_and_no_rules(spark):
    assert found(spark, [(1, None, None, 0), (2, "", "token", 0)]) == []
    assert found(spark, [(1, AWS, None, 0)], []) == []
    df = spark.createDataFrame([], "value string, key_name string")
    assert detect(df, span_start=None).count() == 0


def test_every_rule_can_be_found(spark):
    from kelpie.plans.queries import made_literals

    df = spark.createDataFrame(made_literals(), "case_id int, value string, key_name string, span_start int")
    hit = {r.rule_idx for r in rule_hits(df, key_name=None).select("rule_idx").distinct().collect()}
    missing = {r.rule_id for r in default_rules() if r.rule_idx not in hit}
    assert missing <= {"telegram-bot-api-token"}
    token = "123456789:A" + "b" * 34
    assert "telegram-bot-api-token" in {r[1] for r in found(spark, [(1, token, None, 0)])}


def test_findings_are_parts_of_their_literals(spark):
    from kelpie.plans.queries import made_literals

    df = spark.createDataFrame(made_literals(), "case_id int, value string, key_name string, span_start int")
    rows = detect(df).collect()
    assert len(rows) > 300
    for r in rows:
        at = r.start - r.span_start
        assert r.value.encode()[at : at + r.end - r.start].decode() == r.secret
        assert r.secret.strip()


@pytest.mark.parametrize("name", ["findings", "synthetic_findings"])
def test_plan_has_no_shuffle(spark, name):
    from kelpie.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
