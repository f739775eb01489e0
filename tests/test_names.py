import pytest

from tidemark.functions import naming


def test_groups_and_order():
    names = ["a", "a10", "a2", "123", "_x", "P1_A", "a1"]
    groups = naming.groups_by_prefix(names)
    assert groups == {"a": ["a1", "a2", "a10", "a"], "": ["123"], "_x": ["_x"], "P1_A": ["P1_A"]}
    assert naming.ordered(groups, names) == ["a1", "a2", "a10", "a", "123", "_x", "P1_A"]
    assert naming.ordered({"g": ["b", "missing"]}, ["a", "b"]) == ["b", "a"]
    assert [naming.root_group(n) for n in ("P1_A_1", "abc", "_x")] == ["P1", "abc", ""]


def test_ambiguous_names():
    with pytest.raises(ValueError):
        naming.check_names(["p", "P"])
    with pytest.raises(ValueError):
        naming.check_names(["p", "p"])
