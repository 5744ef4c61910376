import pytest

from tidelog.functions.ranges import resolve_range
from tidelog.plans.engine import index_scope, result_kind
from tidelog.plans.errors import SearchError
from tidelog.plans.nodes import Binary, Compare, Field, FieldTest, Literal, Logic, Negate, Not, Term
from tidelog.plans.parser import parse


def pred(text):
    return parse(f"x=1 | where {text}").commands[0]["predicate"]


def test_search_precedence_is_not_or_and():
    assert parse("a b OR NOT c").base == Logic("and", (Term("a"), Logic("or", (Term("b"), Not(Term("c"))))))
    assert parse('(a "b c") x!=5').base == Logic("and", (Logic("and", (Term("a"), Term("b c", True))), FieldTest("x", "!=", "5")))


def test_where_precedence_is_not_and_or():
    a, b, c = (Compare("=", Field(n), Literal(1)) for n in "abc")
    assert pred("a=1 OR b=1 AND NOT c=1") == Logic("or", (a, Logic("and", (b, Not(c)))))
    assert pred("a + b * -2 > 3") == Compare(">", Binary("+", Field("a"), Binary("*", Field("b"), Negate(Literal(2)))), Literal(3))


def test_dots_join_names_and_concatenate_apart():
    assert parse("x=1 | eval y=a.b . \"c\"").commands[0]["pairs"][0][1] == Binary(".", Field("a.b"), Literal("c"))


def test_bars_in_quotes():
    assert len(parse('"a | b" | rex "(?<x>a|b)" | head 3').commands) == 2


@pytest.mark.parametrize("text, code", [
    ("x | nonsense", "SPL_UNSUPPORTED_COMMAND"), ("x | eval __a=1", "SPL_RESERVED_FIELD"), ("x | eval a=foo(1)", "SPL_UNSUPPORTED_FUNCTION"), ("x | eval a=substr(1)", "SPL_INVALID_FUNCTION_ARGUMENTS"),
    ("x | where a", "SPL_EXPECTED_PREDICATE"), ("x | stats count AS n, sum(a) AS n", "SPL_AMBIGUOUS_STATS_FIELD"), ("x | stats nope(a)", "SPL_UNSUPPORTED_AGGREGATE"), ("x | head many", "SPL_UNSUPPORTED_HEAD_SYNTAX"),
    ("x | rex \"(a)\"", "SPL_INVALID_REX_GROUPS"), ("x | regex \"(?=a)\"", "SPL_UNSUPPORTED_REGEX"), ("x | regex \"(a\"", "SPL_INVALID_REGEX"), ('x | eval a="b', "SPL_UNTERMINATED_QUOTE"), ("x | fields", "SPL_EXPECTED_FIELD"),
    ("x | timechart count", "SPL_UNSUPPORTED_TIMECHART_SYNTAX"), ("x | chart count OVER a BY b | head 1", "SPL_UNSUPPORTED_CHART_SYNTAX"), ("x | streamstats window=3 count BY a", "SPL_UNSUPPORTED_STREAMSTATS_SYNTAX"),
    ("x | delta a p=0", "SPL_UNSUPPORTED_DELTA_SYNTAX"), ("x" + " | head 1" * 65, "SPL_QUERY_TOO_COMPLEX"), ("x | lookup t k AS f", "SPL_UNSUPPORTED_LOOKUP_SYNTAX"), ("x | spath path=a..b", "SPL_UNSUPPORTED_SPATH_SYNTAX"),
])
def test_diagnostics(text, code):
    with pytest.raises(SearchError) as e:
        parse(text)
    assert e.value.code == code and 0 <= e.value.start <= e.value.end <= len(text.encode())


def test_places_are_bytes():
    with pytest.raises(SearchError) as e:
        parse("é | nonsense")
    assert e.value.start == 4


def test_result_kinds():
    kind = lambda q: result_kind(parse(q).commands)
    assert [kind(q) for q in ("a", "a | eval b=1", "a | table b", "a | stats count | sort count", "a | timechart span=1h count")] == ["events", "events", "statistics", "statistics", "time-series"]


def test_index_scope():
    names = ["a1", "a2", "b"]
    scope = lambda q, shared=(): index_scope(parse(q).base, names, shared)
    assert scope("index=a*") == ["a1", "a2"] and scope("index=a1 OR index=b") == ["a1", "b"] and scope("index=a* index=a2") == ["a2"] and scope("NOT index=b") == names and scope("index=c", ["b"]) == ["b"]


def test_time_ranges():
    now = 1_706_745_600.0
    assert resolve_range("-1d@d", "now", now) == (now - 86_400, now)
    assert resolve_range("0", "@d", now) == (0.0, now) and resolve_range("-90s", "-1m", now) == (now - 90, now - 60)
    assert resolve_range("2024-01-01T00:00:00+01:00", None, now)[0] == 1_704_063_600
    # the clocks go forward on 2024-03-31 in Berlin: that day has 23 hours
    assert resolve_range("-1d@d", "@d", 1_711_929_600.0, "Europe/Berlin") == (1_711_839_600.0, 1_711_922_400.0)
    for bad in (("now", "-1h"), ("tomorrow", None), (None, "0")):
        with pytest.raises(SearchError):
            resolve_range(*bad, now)
