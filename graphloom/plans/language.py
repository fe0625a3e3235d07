"""The query language: text to terms, and terms to text. Runs on the driver and starts no job.

A query is one term or several joined by one kind of chain operator. A term is free text, or one operator with operands;
a term in double quotes is free text whatever is in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.model import ATTRIBUTES, BY_NAME


class QueryError(ValueError):
    """A query that cannot be understood; the text says what to change."""


@dataclass(frozen=True)
class Operator:
    name: str
    sign: str
    arity: int | None  #: None: joins any number of terms
    about: str

    @property
    def spellings(self) -> tuple[str, str]:
        return "{" + self.name + "}", self.sign


#: name, shorthand, operands and meaning. The spellings are fixed values of the language.
OPERATORS = [
    Operator(*x)
    for x in [
        ("equal", "==", 2, "attribute equals value"),
        ("not_equal", "!=", 2, "attribute differs from value"),
        ("starts_with", "^*", 2, "attribute starts with value"),
        ("contains", ">>", 2, "attribute contains value"),
        ("not_contains", "!>", 2, "attribute does not contain value"),
        ("in", "<<", 2, "attribute is one of a list"),
        ("not_in", "!<", 2, "attribute is none of a list"),
        ("has", "$$", 1, "attribute has a value"),
        ("not", "!$", 1, "attribute has no value"),
        ("upstream", "^^", 1, "nodes with an edge to X"),
        ("downstream", "!^", 1, "nodes with an edge from X"),
        ("upstream_region", "^R", 2, "upstream of X in a region"),
        ("downstream_region", "!R", 2, "downstream of X in a region"),
        ("reciprocal", "^v", 1, "upstream and downstream of X"),
        ("similar_shape", "~~", 1, "nodes shaped like X"),
        ("similar_upstream", "~u", 1, "similar inputs to X"),
        ("similar_downstream", "~d", 1, "similar outputs to X"),
        ("similar_connectivity", "~c", 1, "similar inputs and outputs to X"),
        ("similar_upstream_weighted", "~wu", 1, "similar inputs by weight"),
        ("similar_downstream_weighted", "~wd", 1, "similar outputs by weight"),
        ("similar_connectivity_weighted", "~wc", 1, "similar inputs and outputs by weight"),
        ("pathways", "->", 2, "nodes on the shortest paths"),
        ("and", "&&", None, "all terms hold"),
        ("or", "||", None, "any term holds"),
    ]
]
BY_OPERATOR = {o.name: o for o in OPERATORS}
CHAINS = ("and", "or")


@dataclass(frozen=True)
class Term:
    """Free text (``op`` is None) or an operator with its operands."""

    op: str | None
    rhs: str
    lhs: str = ""
    literal: bool = False  #: free text in double quotes: not cut into tokens

    def text(self) -> str:
        if self.op is None:
            return f'"{self.rhs}"' if self.literal or _found(self.rhs) else self.rhs
        return f"{self.lhs} {BY_OPERATOR[self.op].sign} {self.rhs}".strip()


@dataclass(frozen=True)
class Query:
    chain: str | None = None
    terms: tuple[Term, ...] = field(default_factory=tuple)

    def text(self) -> str:
        return f" {BY_OPERATOR[self.chain or 'and'].sign} ".join(t.text() for t in self.terms)

    def and_(self, term: Term) -> Query:
        """Narrow a result further, as a click on a value does."""
        if self.chain == "or":
            raise QueryError("a query of alternatives cannot be narrowed; and and or do not mix")
        return Query("and" if self.terms else None, (*self.terms, term))

    def or_(self, term: Term) -> Query:
        """Widen a result by an alternative."""
        if self.chain == "and":
            raise QueryError("a narrowed query cannot have alternatives; and and or do not mix")
        return Query("or" if self.terms else None, (*self.terms, term))

    def but(self, term: Term) -> Query:
        """Narrow a result to what does not answer the term, for operators that have an opposite."""
        return self.and_(opposite(term))


#: Operators and their opposites; an array attribute with no value answers the negative one.
OPPOSITES = {"equal": "not_equal", "contains": "not_contains", "in": "not_in", "has": "not"}
OPPOSITES |= {b: a for a, b in OPPOSITES.items()}


def term(op: str | None, *operands: str | int | list) -> Term:
    """A term from its operator's name or sign and its operands, as a form sends them; a list becomes comma-joined values.

    An operand that holds an operator cannot be written in a query's text and is an error, as is a wrong number of operands.
    """
    texts = [", ".join(map(str, o)) if isinstance(o, (list, tuple)) else str(o).strip() for o in operands]
    if op is None:
        return Term(None, texts[0], literal=bool(_found(texts[0])))
    found = next((o for o in OPERATORS if op in (o.name, *o.spellings)), None)
    if found is None or found.name in CHAINS:
        raise QueryError(f"{op!r} is no operator of a term.")
    if len(texts) != found.arity or not all(texts):
        raise QueryError(f"{found.name} ({found.sign}) takes {found.arity} operands.")
    if any(_found(x) for x in texts):
        raise QueryError(f"an operand of {found.name} holds an operator: {texts}.")
    if found.arity == 2 and found.name in ("equal", "not_equal", "starts_with", "contains", "not_contains", "in", "not_in"):
        attribute(texts[0])
    if found.name in ("has", "not"):
        attribute(texts[0])
    return Term(found.name, texts[-1], texts[0] if found.arity == 2 else "")


def opposite(t: Term) -> Term:
    if t.op not in OPPOSITES:
        raise QueryError(f"{t.op or 'free text'} has no opposite.")
    return Term(OPPOSITES[t.op], t.rhs, t.lhs)


def _found(text: str, names: list[str] | None = None) -> list[str]:
    return [o.name for o in OPERATORS if (names is None or o.name in names) and any(s in text for s in o.spellings)]


def _split(text: str, op: str) -> list[str]:
    long_, sign = BY_OPERATOR[op].spellings
    return [x.strip() for x in text.replace(long_, sign).split(sign)]


def _quoted(text: str) -> bool:
    return len(text) > 1 and text[0] == text[-1] == '"' and '"' not in text[1:-1]


def _term(text: str) -> Term:
    if _quoted(text):
        return Term(None, text[1:-1], literal=True)
    ops = _found(text)
    if not ops:
        return Term(None, text)
    if len(ops) > 1:
        raise QueryError(f"{text!r} has more than one operator: {', '.join(ops)}. Put it in double quotes to search for the text.")
    op, parts = BY_OPERATOR[ops[0]], _split(text, ops[0])
    if op.arity == 1 and len(parts) == 2 and not parts[0] and parts[1]:
        return Term(op.name, parts[1])
    if op.arity == 2 and len(parts) == 2 and all(parts):
        return Term(op.name, parts[1], parts[0])
    raise QueryError(f"{op.name} ({op.sign}) takes {'one operand behind it' if op.arity == 1 else 'an operand on either side'}, unlike {text!r}.")


def parse(text: str) -> Query:
    """The terms of a query; an empty text or ``*`` has none and stands for all nodes."""
    text = (text or "").strip()
    if text in ("", "*"):
        return Query()
    if _quoted(text):
        return Query(None, (_term(text),))
    chains = _found(text, list(CHAINS))
    if len(chains) > 1:
        raise QueryError("and and or do not mix in one query.")
    if not chains:
        return Query(None, (_term(text),))
    parts = _split(text, chains[0])
    if not all(parts):
        raise QueryError(f"nothing on one side of {chains[0]}.")
    return Query(chains[0], tuple(map(_term, parts)))


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def attribute(name: str):
    """The attribute of this name, whatever its case; else an error that names the closest."""
    found = BY_NAME.get(name.strip().lower())
    if found is None:
        closest = min(BY_NAME, key=lambda n: (distance(n, name.strip().lower()), n))
        raise QueryError(f"there is no attribute {name!r}; the closest is {closest!r}.")
    return found


def catalogue(text: str = "") -> dict:
    """Operators, attributes and the terms of a query, for a form."""
    q = parse(text)
    return {
        "operators": [{"name": o.name, "sign": o.sign, "arity": o.arity, "about": o.about} for o in OPERATORS],
        "attributes": [{"name": a.name, "title": a.title, "kind": a.kind} for a in ATTRIBUTES],
        "chain": q.chain,
        "terms": [{"op": t.op, "lhs": t.lhs, "rhs": t.rhs} for t in q.terms],
    }
