"""OR between two words is an operator, elsewhere a word."""

from tessera.plans.search import parse_query


def test_or():
    words = lambda text: [a["words"] for a in parse_query(text)]
    assert words("Or onorha anan") == [["or", "onorha", "anan"]]
    assert words("a OR b c") == [["a"], ["b", "c"]]
    assert words("a or or b") == [["a"], ["or", "b"]]
    assert words("a b or") == [["a", "b", "or"]]
