import pytest

from graphloom.plans.language import BY_OPERATOR, OPERATORS, Query, QueryError, Term, attribute, catalogue, parse


def test_terms():
    assert parse("foo == bar") == Query(None, (Term("equal", "bar", "foo"),))
    q = parse("foo != bar && other")
    assert q.chain == "and" and q.terms == (Term("not_equal", "bar", "foo"), Term(None, "other"))
    assert parse("a {or} b || c").chain == "or"
    assert parse("$$ label").terms == (Term("has", "label"),)
    assert parse('"foo == bar"').terms == (Term(None, "foo == bar", literal=True),)
    assert parse("") == parse("*") == Query()


@pytest.mark.parametrize("text", ["== foo == bar", "==", "foo == !=", "foo {has} bar", "a && b || c", "|| a", "a == b == c", "^^"])
def test_errors(text):
    with pytest.raises(QueryError):
        parse(text)


def test_no_spelling_is_part_of_another():
    spellings = [s for o in OPERATORS for s in o.spellings]
    assert not [(a, b) for a in spellings for b in spellings if a != b and a in b]
    assert len(OPERATORS) == 24 and len(BY_OPERATOR) == 24


def test_attributes():
    assert attribute("Class").name == "class" and attribute("nt").name == "nt_type"
    with pytest.raises(QueryError, match="class"):
        attribute("clas")


def test_round_trip_and_narrowing():
    q = parse("class == a && b")
    assert parse(q.text()) == q
    assert q.and_(Term("equal", "x", "side")).text() == "class == a && b && side == x"
    with pytest.raises(QueryError):
        parse("a || b").and_(Term(None, "c"))
    assert catalogue("a == b")["terms"] == [{"op": "equal", "lhs": "a", "rhs": "b"}]
