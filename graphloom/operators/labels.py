"""Cleaning of free-text labels: steps as column functions over a node's labels, latest first, repeated until nothing changes."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import looks_like_id, web_safe
from graphloom.storage import written


@dataclass(frozen=True)
class Rules:
    """What is removed. The defaults are fixed values; other data may bring their own."""

    #: texts that are cut out of labels (fixed values)
    hidden: tuple[str, ...] = (
        "; Part of comprehensive neck connective tracing, contact Connectomics Group Cambridge for more detailed information on descending/ascending neurons",
        " (total brain fart (not part of the name of the neuron))",
        " (complete brain fart trying to lend weight to someone else`s self-correction, ended up choosing the wrong label myself too xD)",
        "Taisz ... Galili 2022 doi:10.1101/2022.05.13.491877",
        "; https://doi.org/10.1101/2021.12.20.473513",
    )
    #: labels that say nothing, and how others of the kind start (fixed values)
    unwanted: tuple[str, ...] = ("correction - not optic lobe",)
    unwanted_starts: tuple[str, ...] = ("#wrong_prediction",)
    #: what may stand before a part (fixed values)
    tentative: tuple[str, ...] = ("putative ", "putative-", "putative_")
    #: how a label starts, or ends, that corrects all older ones, in the order in which they are looked for (fixed values)
    corrections: tuple[str, ...] = ("Correction: ", "(correction) ", "(correction after path swap correction); ", "Tm16 is wrong. this is: ", "L1 label is wrong")
    correction_ends: tuple[str, ...] = (
        " (correction)",
        " (correction due to brain fart)",
        " (correction due to brainfart)",
        " (correction after discovery and correction of path swap error)",
        " (Tm5c is not correct)",
        " (corrected)",
        " - L1 Label Incorrect",
        " - L2 Label Incorrect",
        " - R2 Label Incorrect (spelling error)",
        "; L5 label is incorrect",
        "; L1 label is wrong",
        "; L1 - Lamina monopolar 3; L3 is incorrect and submitted by accident",
        " (I just pasted a segment ID here and accidentally submitted. sorry)",
        ", wrongly annotated",
    )
    #: sides within words, and at their ends or before a mark (fixed values)
    sides: tuple[str, ...] = ("_left", "_right", "left_", "right_", "left", "right", "Left", "Right", "-RHS", "-LHS")
    side_ends: tuple[str, ...] = ("_l", "_r", "-l", "-r")
    side_marks: tuple[str, ...] = (";", ":", ",", "_", "-")
    #: characters in which two labels may differ and still say the same (fixed values)
    slight: str = "'`.,-_:; "
    #: attributes that a label need not repeat (fixed values)
    own: tuple[str, ...] = ("nt_type", "flow", "super_class", "class", "sub_class", "hemilineage", "side", "nerve")


def _each(labels: Column, change) -> Column:
    return F.transform(labels, change)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; a lambda inside ``body`` would compute a plain expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _filled(labels: Column) -> Column:
    return F.filter(labels, lambda x: F.coalesce(x != "", F.lit(False)))


def _tokens(label: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(label, mark), lambda p: F.trim(p)), lambda p: p != "")


def shortened(label: Column, rules: Rules) -> Column:
    for text in rules.hidden:
        label = F.replace(label, F.lit(text), F.lit(""))
    return web_safe(label)


def unwanted(label: Column, rules: Rules) -> Column:
    bad = F.lower(label).isin(*rules.unwanted) | looks_like_id(label)
    for s in rules.unwanted_starts:
        bad = bad | label.startswith(s)
    return bad


def without_known_parts(labels: Column, own: Column, rules: Rules) -> Column:
    """Parts between ``;`` that repeat the node's own attributes go, and tentative words at a part's start; labels of one character too."""

    def bare(p: Column) -> Column:
        for t in rules.tentative:
            p = F.when(F.lower(p).startswith(t), p.substr(F.lit(len(t) + 1), F.length(p))).otherwise(p)
        return p

    kept = lambda x: F.filter(F.split(x, ";"), lambda p: ~F.array_contains(own, F.trim(F.lower(p))))
    return F.filter(_each(labels, lambda x: F.trim(F.array_join(_each(kept(x), bare), ";"))), lambda x: F.length(x) > 1)


def without_corrected(labels: Column, rules: Rules) -> Column:
    """The first mark of correction that a label has ends the list at it: the label stays without the mark, older ones go."""
    out = labels
    for mark, at_start in reversed([(c, True) for c in rules.corrections] + [(c, False) for c in rules.correction_ends]):
        out = _ended_by(labels, mark, at_start, out)
    return out


def _ended_by(labels: Column, mark: str, at_start: bool, otherwise: Column) -> Column:
    at = F.array_position(F.transform(labels, lambda x: x.startswith(mark) if at_start else x.endswith(mark)), True).cast("int")
    hit = F.get(labels, at - 1)
    bare = hit.substr(F.lit(len(mark) + 1), F.length(hit)) if at_start else hit.substr(F.lit(1), F.length(hit) - len(mark))
    return F.when(at > 0, F.concat(F.slice(labels, F.lit(1), at - 1), F.array(bare))).otherwise(otherwise)


def without_side(label: Column, rules: Rules) -> Column:
    """Left and right off each word; words that are nothing else go."""
    ends = [e for end in rules.side_ends for e in (end, end.upper())]
    # a word with none of these stays as it is
    some = "|".join(re.escape(s) for s in (*rules.sides, *ends))

    def bare(w: Column) -> Column:
        for side in rules.sides:
            w = F.replace(w, F.lit(side), F.lit(""))
        for mark in rules.side_marks:
            for end in rules.side_ends:
                for e in (end, end.upper()):
                    w = F.replace(w, F.lit(e + mark), F.lit(mark))
                # one of them off the end
                w = F.regexp_replace(w, rf"(?:{end}|{end.upper()})\z", "")
        return w

    words = _each(F.filter(F.split(label, r"(?U)\s+"), lambda w: w != ""), lambda w: F.when(w.rlike(some), bare(w)).otherwise(w))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*rules.side_marks)), " ")


def distinct_parts(label: Column) -> Column:
    """Parts between ``;`` that come again go."""
    return _bound(_tokens(label, ";"), lambda tokens: F.when(F.size(F.array_distinct(tokens)) < F.size(tokens), F.array_join(F.array_distinct(tokens), "; ")).otherwise(label))


def without_contained_parts(label: Column) -> Column:
    """A part that the next one holds goes: as its start before ``:``, as its last word, or as a word before ``,`` or ``;``. Parts between ``,``, else between ``;``."""

    def held(part: Column, after: Column) -> Column:
        word = F.concat(F.lit(" "), part)
        return F.coalesce(after.startswith(F.concat(part, F.lit(":"))) | after.endswith(word) | after.contains(F.concat(word, F.lit(","))) | after.contains(F.concat(word, F.lit(";"))), F.lit(False))

    def of(mark: str, otherwise: Column) -> Column:
        def chosen(tokens: Column) -> Column:
            kept = F.filter(tokens, lambda p, i: ~held(p, F.get(tokens, i + 1)))
            return _bound(kept, lambda k: F.when(F.size(k) < F.size(tokens), F.array_join(k, f"{mark} ")).otherwise(otherwise))

        return _bound(_tokens(label, mark), chosen)

    return of(",", of(";", label))


def without_lookalikes(labels: Column, rules: Rules) -> Column:
    """A later label goes if it differs from an earlier one, place by place, in slight characters only; what one has beyond the other's end counts as different."""
    # two labels are alike if and only if they are the same once slight characters are spaces and those at the end are off
    bare = F.transform(labels, lambda x: F.rtrim(F.translate(x, rules.slight, " " * len(rules.slight))))
    return _bound(bare, lambda b: F.filter(labels, lambda x, i: F.array_position(b, F.get(b, i)) == i + 1))


def without_prefixes(labels: Column) -> Column:
    """A label that begins another goes, unless a letter from a to z, a digit or ``_`` follows in the other."""
    begins = lambda x, y: (F.length(y) > F.length(x)) & y.startswith(x) & ~y.substr(F.length(x) + 1, F.lit(1)).rlike("[0-9A-Za-z_]")
    return F.filter(labels, lambda x: ~F.exists(labels, lambda y: begins(x, y)))


def spaced(label: Column) -> Column:
    """One space behind each ``;`` and then each ``,``."""
    for mark in (";", ","):
        label = F.array_join(F.transform(F.split(label, mark), lambda p: F.trim(p)), f"{mark} ")
    return label


def without_end_mark(label: Column) -> Column:
    """One of ``; , :`` off the end."""
    return F.trim(F.regexp_replace(F.trim(label), r"[;,:]\z", ""))


def _steps(own: Column, rules: Rules) -> list[Callable[[Column], Column]]:
    return [
        lambda a: _each(_filled(a), lambda x: shortened(x, rules)),
        lambda a: _each(F.filter(a, lambda x: ~unwanted(x, rules)), lambda x: F.trim(x)),
        lambda a: without_known_parts(a, own, rules),
        lambda a: without_corrected(a, rules),
        lambda a: _each(_filled(a), lambda x: without_side(x, rules)),
        lambda a: _each(_filled(a), distinct_parts),
        lambda a: _each(_filled(a), without_contained_parts),
        lambda a: F.array_distinct(without_known_parts(a, own, rules)),
        lambda a: without_lookalikes(a, rules),
        without_prefixes,
        lambda a: F.array_distinct(_each(a, lambda x: without_end_mark(spaced(x)))),
    ]


ROUNDS = 100  #: of cleaning; from then on a change that makes labels no shorter means that steps undo each other


def clean(nodes: DataFrame, rules: Rules = Rules(), edge_types: dict[str, str] | None = None) -> DataFrame:
    """``nodes`` with cleaned labels: the steps are repeated until no label of a node changes.

    ``edge_types`` gives the long names that a label need not repeat. Rows that have settled are put aside, so a round works
    on the others only; each round is written out. A step is a projection of its own, so that none is computed twice. Null
    and empty labels go; a node without labels has an empty array. Labels are long beside what a shuffle counts, so rows are
    dealt out evenly before the first round. There may be any number of rounds, as long as labels get shorter.
    """
    columns, names = nodes.columns, dict(edge_types or {})
    known = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rules.own]
    if names and "nt_type" in rules.own:
        known.append(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("nt_type")), F.lit("")))
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in columns])
    own = F.filter(F.transform(F.array(*known), lambda x: F.lower(x)), lambda x: x != "")
    state = nodes.select(row.alias("row"), own.alias("own"), F.coalesce("label", F.array().cast("array<string>")).alias("label"))
    state = state.repartition(max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # the same expressions for every round
    steps = [step(F.col("label")) for step in _steps(F.col("own"), rules)]
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x) + 1)
    shorter = F.coalesce(size("label") < size(F.filter("before", lambda x: x.isNotNull())), F.lit(False))
    done = []
    for turn in itertools.count(1):
        stepped = state.withColumn("before", F.col("label"))
        for changed in steps:
            stepped = stepped.withColumn("label", changed)
        stepped = stepped.withColumns({"same": F.col("label").eqNullSafe(F.col("before")), "shorter": shorter}).drop("before")
        stepped, _ = written(stepped, f"labels{turn}")
        settled, n, stuck = stepped.agg(F.count_if("same"), F.count_if(~F.col("same")), F.count_if(~F.col("same") & ~F.col("shorter"))).first()
        if settled or not done:
            done.append(stepped.where("same"))
        state = stepped.where("NOT same").select("row", "own", "label")
        if not n:
            break
        if turn >= ROUNDS and stuck:
            some = stepped.where("NOT same AND NOT shorter").select("row").limit(5).collect()
            raise ValueError(f"labels still change after {turn} rounds, those of {some} among them")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select(*[F.col("label") if c == "label" else F.col("row").getField(c).alias(c) for c in columns])


def grouped(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """root_id and its labels, the latest first (by date, then label_id); rows of unknown nodes are left out."""
    known = log.join(nodes.select("root_id").distinct(), "root_id", "left_semi")
    rows = F.sort_array(F.collect_list(F.struct("date_created", "label_id", "label")), asc=False)
    return known.groupBy("root_id").agg(rows.alias("rows")).select("root_id", F.transform("rows", lambda r: r["label"]).alias("label"))


def orphans(log: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent labels of unknown nodes."""
    lost = log.join(nodes.select("root_id").distinct(), "root_id", "left_anti")
    return lost.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top)


def log_of(log: DataFrame, x: int) -> DataFrame:
    """The labelling log of one node, newest first (by date, then label_id): place from 1, label, user_name, user_affiliation, date_created."""
    rows = log.where(F.col("root_id") == x)
    # the rows of one node
    place = F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("date_created"), F.desc("label_id")))
    return rows.select(place.alias("place"), "label_id", "label", "user_name", "user_affiliation", "date_created")
