"""Free-text search over labels and attribute values, in ranked tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import long_tokens_trimmed, tokens, tokens_text
from graphloom.model import ATTRIBUTES, Graph

#: Words that are never suggested (fixed values).
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Characters that part words to be highlighted (fixed values).
HIGHLIGHT_DELIMITERS = '=-.,?!;:/()[]"&*'
#: Attributes whose whole values can be searched for.
VALUE_ATTRIBUTES = ("root_id", "name", "group", "cell_type", "marker", "connectivity_tag", "flow", "super_class", "class", "sub_class", "hemilineage", "nerve", "side", "nt_type")


def token_table(g: Graph) -> DataFrame:
    """root_id, token, token_lc: the whole labels and their tokens."""
    each = g.labels.select("root_id", F.explode(F.array_union(F.array("label"), tokens(F.col("label")))).alias("token"))
    return each.select("root_id", "token", F.lower("token").alias("token_lc")).distinct()


def value_table(g: Graph) -> DataFrame:
    """root_id, value_lc: whole values of attributes."""
    by = {a.name: a for a in ATTRIBUTES}
    wanted = [by[n] for n in VALUE_ATTRIBUTES]
    lists = [a.column() if a.kind == "array" else F.array(a.column().cast("string")) for a in wanted]
    return g.nodes.select("root_id", F.explode(F.concat(*lists)).alias("v")).where("v IS NOT NULL AND v <> ''").select("root_id", F.lower("v").alias("value_lc")).distinct()


def lookup(g: Graph, term: str, case_sensitive: bool = False, word_match: bool = False) -> DataFrame:
    """root_id and its best tier: 1 a token, 2 a value (of any case), 3 a token's start, 4 within a label; 3 and 4 unless ``word_match``.

    A graph with a text index is looked up there, else all labels are split and searched.
    """
    if g.text_index is not None and term and "\0" not in term:
        return g.text_index.lookup(term, case_sensitive, word_match)
    t = term if case_sensitive else term.lower()
    token = F.col("token" if case_sensitive else "token_lc")
    label = F.col("label") if case_sensitive else F.lower("label")
    tokens_, hit = token_table(g), lambda df, cond, tier: df.where(cond).select("root_id", F.lit(tier).alias("tier"))
    found = [hit(tokens_, token == t, 1), hit(value_table(g), F.col("value_lc") == term.lower(), 2)]
    if not word_match:
        found += [hit(tokens_, token.startswith(t), 3), hit(g.labels, label.contains(t), 4)]
    return reduce(DataFrame.unionAll, found).groupBy("root_id").agg(F.min("tier").alias("tier"))


def search(g: Graph, text: str, case_sensitive: bool = False, word_match: bool = False, literal: bool = False) -> DataFrame:
    """root_id and rank: hits of the whole phrase, then of all its tokens, then of any, each by tier. Empty or ``*``: all nodes."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        text, literal = text[1:-1], True
    if text in ("", "*"):
        return all_ids(g)
    phrase = lookup(g, text.replace('"', ""), case_sensitive, word_match).select("root_id", F.struct(F.lit(0).alias("group"), F.lit(0).alias("place"), "tier").alias("rank"))
    parts = list(dict.fromkeys(tokens_text(text)))
    if literal or len(parts) < 2:
        return phrase
    each = reduce(DataFrame.unionAll, [lookup(g, p, case_sensitive, word_match).withColumn("place", F.lit(i)) for i, p in enumerate(parts)])
    n = F.count("*")
    rest = each.groupBy("root_id").agg(F.struct(F.when(n == len(parts), 1).otherwise(2).alias("group"), F.min("place").alias("place"), F.min_by("tier", "place").alias("tier")).alias("rank"))
    return phrase.unionAll(rest).groupBy("root_id").agg(F.min("rank").alias("rank"))


def all_ids(g: Graph) -> DataFrame:
    """All nodes, labelled ones first."""
    return g.nodes.select("root_id", F.struct(F.when(F.size("label") > 0, 0).otherwise(1).alias("group"), F.lit(0).alias("place"), F.lit(0).alias("tier")).alias("rank"))


def closest_token(g: Graph, term: str, case_sensitive: bool = False, within: DataFrame | None = None) -> DataFrame:
    """The token nearest to a term that is no stop word, with its distance; ties alphabetical. ``within``: of these root_ids only."""
    if g.text_index is not None and within is None and term:
        return g.text_index.nearest(term, case_sensitive)
    t = token_table(g)
    if within is not None:
        t = t.join(within.select("root_id").distinct(), "root_id", "left_semi")
    word = F.col("token") if case_sensitive else F.col("token_lc")
    words = t.select(word.alias("token")).distinct().where(~F.lower("token").isin(*STOP_WORDS))
    return words.withColumn("distance", F.levenshtein("token", F.lit(term if case_sensitive else term.lower()))).orderBy("distance", "token").limit(1)


def suggestion(g: Graph, query: str, **how) -> DataFrame | None:
    """:func:`closest_token` for plain words; none for blank, numeric, chained or structured queries."""
    from graphloom.plans.language import parse

    q = parse(query)
    if len(q.terms) != 1 or q.terms[0].op or not q.terms[0].rhs or q.terms[0].rhs.isdigit():
        return None
    return closest_token(g, q.terms[0].rhs, **how)


def highlights(labels: DataFrame, words: list[str]) -> DataFrame:
    """root_id, label and, of each of its tokens, how it answers the words: exact, part or none."""
    folded = [w.lower() for w in words]
    kind = lambda t: F.when(F.lower(t).isin(*folded), "exact").when(reduce(lambda a, b: a | b, [F.lower(t).contains(w) for w in folded]), "part").otherwise("none")
    return labels.select("root_id", "label", F.transform(tokens(F.col("label")), lambda t: F.struct(t.alias("token"), kind(t).alias("match"))).alias("matches"))


def highlight_spans(text: Column, words: list[str]) -> Column:
    """Where a text answers the words: kind (exact or part), start and end of each place, in order of finding.

    Words are the words' own tokens, folded. A token that is one of them is marked whole; in another each word that it holds is
    marked at its first place, in the words' order. A place that touches one already marked is left out.
    """
    folded = list(dict.fromkeys(t.lower() for w in words for t in tokens_text(w)))
    spaced = F.translate(text, HIGHLIGHT_DELIMITERS, " " * len(HIGHLIGHT_DELIMITERS))
    parts = F.split(F.lower(spaced), " ")
    # a part begins behind all before it and a space for each
    begun = F.transform(parts, lambda p, i: F.struct(p.alias("token"), F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, q: n + F.length(q) + 1).alias("start")))
    kinds = "array<struct<kind:string,start:int,end:int>>"
    none = F.array().cast(kinds)

    def found(p: Column) -> Column:
        token, start = p["token"], p["start"]
        span = lambda kind, a, n: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("start"), (a + n).cast("int").alias("end"))
        within = [F.when(token.contains(w), span("part", start + F.instr(token, w) - 1, F.lit(len(w)))) for w in folded]
        held = F.filter(F.array(*within), lambda x: x.isNotNull()) if within else none
        return F.when(token == "", none).when(token.isin(*folded), F.array(span("exact", start, F.length(token)))).otherwise(held)

    meets = lambda x, r: x["start"].between(r["start"], r["end"]) | x["end"].between(r["start"], r["end"])
    return F.aggregate(F.flatten(F.transform(begun, found)), none, lambda kept, x: F.when(F.exists(kept, lambda r: meets(x, r)), kept).otherwise(F.concat(kept, F.array(x))))


def highlighted(text: Column, words: list[str], colours: tuple[str, str] = ("highlight-green", "highlight-yellow")) -> Column:
    """The text, its long tokens trimmed, with the places of :func:`highlight_spans` in spans of two classes."""
    short = long_tokens_trimmed(text)
    spans = F.array_sort(highlight_spans(short, words), lambda a, b: a["start"] - b["start"])
    cut = lambda a, b: short.substr(a + 1, b - a)
    before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0))
    opened = lambda s: F.concat(F.lit('<span class="'), F.when(s["kind"] == "exact", colours[0]).otherwise(colours[1]), F.lit('">'))
    pieces = F.transform(spans, lambda s, i: F.concat(cut(before(i), s["start"]), opened(s), cut(s["start"], s["end"]), F.lit("</span>")))
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    return F.concat(F.array_join(pieces, ""), cut(end, F.length(short)))
