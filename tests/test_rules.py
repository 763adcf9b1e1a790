import re

import pytest
from kelpie.sources.rules import ASSIGNMENT, default_rules, group_count, parse_rules, rules_df, rules_from_file, shortest, to_java
from kelpie.sources.web import USER_AGENTS, random_user_agent


def test_pack_counts():
    rules = default_rules()
    assert len(rules) == 168
    assert [r.rule_idx for r in rules] == list(range(168))
    assert sum(r.name_re is not None for r in rules) == 90
    assert sum(r.min_entropy is not None for r in rules) == 7
    assert max(r.n_groups for r in rules) == 34
    by_id = {r.rule_id: r for r in rules}
    assert by_id["stripe-access-token"].n_groups == 3 and by_id["sumologic-access-id"].name_re is None


def test_split_and_case_flag():
    (r,) = parse_rules(f"[[rules]]\nid='a'\ndescription='d'\nregex='''(?i)(?:key){ASSIGNMENT}([a-f]{{4}})'''\nkeywords=['key']\nentropy=2")
    assert r.name_re == "(?iu)(?U)(?:key)" and r.value_re == "(?iu)(?U)([a-f]{4})"
    assert r.n_groups == 1 and r.min_length == 4 and r.min_entropy == 2.0 and r.keywords == ("key",)


def test_rules_that_do_not_compile_are_left_out_and_indexes_close_up():
    text = "[[rules]]\nid='bad'\ndescription='d'\nregex='([a'\n[[rules]]\nid='good'\ndescription='d'\nregex='[a]'"
    assert [(r.rule_idx, r.rule_id) for r in parse_rules(text)] == [(0, "good")]


def test_name_that_does_not_compile_asks_for_no_name():
    (r,) = parse_rules(f"[[rules]]\nid='a'\ndescription='d'\nregex='''(?:key{ASSIGNMENT}x'''")
    assert r.name_re is None and r.value_re.endswith("x")


@pytest.mark.parametrize(("pattern", "java"), [("(?P<n_1>a)$", r"(?U)(a)\z"), ("[$a]|\\$", "(?U)[$a]|\\$"), ("(?:x|$)", r"(?U)(?:x|\z)")])
def test_translation(pattern, java):
    assert to_java(pattern, False) == java


def test_groups_and_lengths():
    assert group_count(r"(a)(?:b)(?P<c>d)[(]\((?i)x") == 2
    assert shortest("a{3}(?i)b?c+") == 4


def test_sources(spark, tmp_path):
    assert parse_rules("") == []
    assert rules_df(spark, []).count() == 0
    p = tmp_path / "r.toml"
    p.write_text("[[rules]]\nid='a'\ndescription='d'\nregex='b'\n")
    assert [r.rule_id for r in rules_from_file(str(p))] == ["a"]
    assert rules_df(spark).where("size(keywords) > 0").count() > 100
    assert random_user_agent(1) in USER_AGENTS and len(USER_AGENTS) == 6
    assert not re.search("allowlist", str(rules_df(spark).columns))
