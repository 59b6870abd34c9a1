"""JSON Schema for values of any depth: references may recur, and may lead to other documents of a registry.

A column has a finite depth, so here values are shredded into a table of nodes, a level at a time, and judged from the
deepest level up. Each schema that can be reached is a spot; a node's verdict is an array with an entry for each spot. What
a spot says of a node's own value is a column; what it says of the node's members is a sum or a minimum over the verdicts of
the level below, grouped by parent, so no node's members are gathered. The plan of a level does not grow with the depth.

Broken rules are then followed from the root down: only nodes that a broken rule leads to are visited. Rules inside anyOf,
oneOf, not and if are reported as these keywords. Names that no schema mentions appear as ``*`` in places.
"""

from __future__ import annotations

import posixpath
from collections.abc import Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settled
from ..functions.conditions import java_pattern
from ..functions.schemas import SILENT, Schema, asserted
from ..functions.values import kind, lookup_static

#: Keywords that apply schemas to the same value, and to its members.
SAME = ("$ref", "allOf", "anyOf", "oneOf", "not", "if", "then", "else")
BELOW = ("properties", "patternProperties", "additionalProperties", "prefixItems", "items", "contains")
#: Levels that a value has at most.
DEEPEST = 64

Place = tuple[str, str]


class Spot(NamedTuple):
    """A schema that applies somewhere: its document and pointer, and the spots that its keywords name."""

    place: Place
    schema: Schema
    same: dict[str, list[Place]]
    below: dict[str, list[tuple[Any, Place]]]


def spots(schema: Schema, registry: Mapping[str, Schema] | None = None) -> dict[Place, Spot]:
    """All schemas that can be reached from the root, those that others need on the same value first."""
    documents = {**(registry or {}), "": schema}
    found: dict[Place, Spot] = {}
    pending: list[Place] = [("", "")]
    while pending:
        place = pending.pop()
        if place in found:
            continue
        document, pointer = place
        own = lookup_static(documents[document], pointer)
        step = lambda *t: (document, pointer + "".join("/" + str(x).replace("~", "~0").replace("/", "~1") for x in t))  # noqa: B023, E731
        same: dict[str, list[Place]] = {}
        below: dict[str, list[tuple[Any, Place]]] = {}
        for word, arg in own.items() if isinstance(own, Mapping) else ():
            if word == "$ref":
                file, _, fragment = arg.partition("#")
                target = posixpath.normpath(posixpath.join(posixpath.dirname(document), file)) if file else document
                if target not in documents:
                    raise ValueError(f"reference to an unknown document: {arg!r}")
                same[word] = [(target, fragment)]
            elif word in ("allOf", "anyOf", "oneOf"):
                same[word] = [step(word, k) for k in range(len(arg))]
            elif word in SAME:
                same[word] = [step(word)]
            elif word in ("properties", "patternProperties"):
                below[word] = [(name, step(word, name)) for name in arg]
            elif word == "prefixItems":
                below[word] = [(k, step(word, k)) for k in range(len(arg))]
            elif word in BELOW:
                below[word] = [(None, step(word))]
        found[place] = Spot(place, own, same, below)
        pending += [p for ps in same.values() for p in ps] + [p for ps in below.values() for _, p in ps]
    order: dict[Place, Spot] = {}

    def put(place: Place, via: tuple[Place, ...]) -> None:
        if place in via:
            raise ValueError(f"schema {place[1] or '#'!r} applies to itself on the same value")
        if place not in order:
            for p in (p for ps in found[place].same.values() for p in ps):
                put(p, (*via, place))
            order[place] = found[place]

    for place in found:
        put(place, ())
    return order


def vocabulary(schema: Any) -> set[str]:
    """Names of properties that a schema mentions."""
    if isinstance(schema, Mapping):
        own = {n for w in ("properties", "dependentRequired") if isinstance(schema.get(w), Mapping) for n in schema[w]}
        return own.union(*(vocabulary(s) for s in schema.values()))
    return set().union(*(vocabulary(s) for s in schema)) if isinstance(schema, (list, tuple)) else set()


def shred(df: DataFrame, value: str, names: set[str] | None = None) -> list[DataFrame]:
    """Nodes (key, at, parent, name, position, shown, value) of the values in df (key and the column), a table for each level.

    at: the JSON pointer of a node; name or position: that in its parent; shown: at, with ``*`` for names that are not in names.
    """
    escaped = lambda c: F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    none = F.lit(None).cast("string")
    level = df.where(F.col(value).isNotNull()).select("key", F.lit("").alias("at"), none.alias("parent"), none.alias("name"), F.lit(None).cast("int").alias("position"), F.lit("").alias("shown"), F.col(value).alias("value"))
    out = [settled(level)]
    while True:
        if len(out) > DEEPEST:
            raise ValueError(f"values nest {DEEPEST} deep at most")
        members = df.sparkSession.tvf.variant_explode(F.col("value").outer()).toDF("pos", "own", "item")
        each = out[-1].select("key", "at", "shown", "value").lateralJoin(members)
        last = F.concat(F.lit("/"), F.coalesce(escaped(F.col("own")), F.col("pos").cast("string")))
        hidden = F.lit("/*") if names is not None else last
        known = F.col("own").isNull() | F.col("own").isin(*(names or {""}))
        level = settled(
            each.select(
                "key", F.concat("at", last).alias("at"), F.col("at").alias("parent"), F.col("own").alias("name"), F.when(F.col("own").isNull(), F.col("pos")).alias("position"),
                F.concat("shown", F.when(known, last).otherwise(hidden)).alias("shown"), F.col("item").alias("value"),
            )
        )
        if level.isEmpty():
            return out
        out.append(level)


def _certain(c: Column, otherwise: bool = False) -> Column:
    return F.coalesce(c, F.lit(otherwise))


def _concerns(word: str, arg: Any, schema: Mapping[str, Any]) -> Column:
    """Whether a keyword's schema is for the member with this name or position."""
    name, position = F.col("name"), F.col("position")
    if word == "properties":
        return _certain(name == arg)
    if word == "patternProperties":
        return _certain(name.rlike(java_pattern(arg)))
    if word == "prefixItems":
        return _certain(position == arg)
    if word == "items":
        return _certain(position >= len(schema.get("prefixItems", [])))
    if word == "contains":
        return position.isNotNull()
    named = name.isin(*schema["properties"]) if schema.get("properties") else F.lit(False)
    for pattern in schema.get("patternProperties", {}):
        named = named | name.rlike(java_pattern(pattern))
    return _certain(~named)


class Judge:
    """The columns of verdicts for the spots of a schema."""

    def __init__(self, schema: Schema, registry: Mapping[str, Schema] | None = None):
        self.spots = list(spots(schema, registry).values())
        self.number = {s.place: k for k, s in enumerate(self.spots)}
        self.root = self.number[("", "")]

    def below(self) -> list[Column]:
        """Aggregates over the members of a node, one for each keyword and spot."""
        out = []
        for k, spot in enumerate(self.spots):
            for word, rules in spot.below.items():
                parts = [(_concerns(word, arg, spot.schema), F.col("fits")[self.number[place]]) for arg, place in rules]
                if word == "contains":
                    out.append(F.sum((parts[0][0] & parts[0][1]).cast("int")).alias(f"{k}_{word}"))
                    continue
                ok = F.lit(True)
                for concerned, fits in parts:
                    ok = ok & (~concerned | fits)
                out.append(F.min(ok).alias(f"{k}_{word}"))
        return out or [F.lit(True).alias("none")]

    def _rules(self, k: int) -> list[tuple[str, Column]]:
        """Keywords of a spot with what they say of a node, over the columns fit_... of spots before it."""
        spot, fit = self.spots[k], lambda p: F.col(f"fit_{self.number[p]}")
        if isinstance(spot.schema, bool):
            return [] if spot.schema else [("false", F.lit(False))]
        value, out = F.col("value"), []
        total = lambda ps: sum((fit(p).cast("int") for p in ps), F.lit(0))
        for word, arg in spot.schema.items():
            if word in SILENT or word in ("then", "else"):
                continue
            if word in ("$ref", "allOf"):
                out.append((word, total(spot.same[word]) == len(spot.same[word])))
            elif word == "anyOf":
                out.append((word, total(spot.same[word]) > 0))
            elif word == "oneOf":
                out.append((word, total(spot.same[word]) == 1))
            elif word == "not":
                out.append((word, ~fit(spot.same[word][0])))
            elif word == "if":
                then, otherwise = (fit(spot.same[w][0]) if w in spot.same else F.lit(True) for w in ("then", "else"))
                out.append((word, F.when(fit(spot.same[word][0]), then).otherwise(otherwise)))
            elif word == "contains":
                found = F.coalesce(F.col(f"{k}_contains"), F.lit(0))
                least, most = spot.schema.get("minContains", 1), spot.schema.get("maxContains")
                out.append((word, (kind(value) != "array") | (found >= least)))
                if most is not None:
                    out.append(("maxContains", (kind(value) != "array") | (found <= most)))
            elif word in BELOW:
                out.append((word, _certain(F.col(f"{k}_{word}"), True)))
            elif word not in ("minContains", "maxContains"):
                out.append((word, asserted(value, word, arg, spot.schema)))
        return out

    def level(self, nodes: DataFrame, below: DataFrame | None) -> DataFrame:
        """Nodes with fits and broken (keywords, without those that only pass on what other spots say) for each spot."""
        if below is not None:
            sums = below.groupBy("key", F.col("parent").alias("at")).agg(*self.below())
            df = nodes.join(sums, ["key", "at"], "left")
        else:
            df = nodes.withColumns({f"{k}_{w}": F.lit(None).cast("int" if w == "contains" else "boolean") for k, s in enumerate(self.spots) for w in s.below} or {"none": F.lit(True)})
        passing = {"$ref", "allOf", *BELOW} - {"contains"}
        for k in range(len(self.spots)):
            rules = self._rules(k)
            ok = F.lit(True)
            for _, c in rules:
                ok = ok & c
            own = [F.when(~c, w) for w, c in rules if w not in passing]
            df = df.withColumns({f"fit_{k}": _certain(ok), f"broken_{k}": F.array_compact(F.array(*own, F.lit(None).cast("string")))})
        every = range(len(self.spots))
        return settled(df.select(*nodes.columns, F.array(*(f"fit_{k}" for k in every)).alias("fits"), F.array(*(f"broken_{k}" for k in every)).alias("broken")))

    def _together(self, k: int) -> list[int]:
        """A spot and those that must hold with it on the same value."""
        out, pending = [], [k]
        while pending:
            at = pending.pop()
            if at not in out:
                out.append(at)
                pending += [self.number[p] for w in ("$ref", "allOf") for p in self.spots[at].same.get(w, [])]
        return sorted(out)

    def broken(self, levels: list[DataFrame]) -> DataFrame:
        """key, place, keyword of broken rules, followed from the roots down."""
        out = None
        front = levels[0].where(~F.col("fits")[self.root]).select("key", "at", F.lit(self.root).alias("spot"))
        for d, level in enumerate(levels):
            together = F.lit([self._together(k) for k in range(len(self.spots))])
            front = settled(front.select("key", "at", F.explode(F.get(together, F.col("spot"))).alias("spot")).distinct())
            here = front.join(level, ["key", "at"])
            rules = here.select("key", F.col("shown").alias("place"), F.explode(F.get("broken", F.col("spot"))).alias("keyword")).distinct()
            out = rules if out is None else out.unionByName(rules)
            if d + 1 == len(levels) or front.isEmpty():
                break
            members = levels[d + 1].select("key", "at", "parent", "name", "position", "fits").join(front.select("key", F.col("at").alias("parent"), "spot"), ["key", "parent"])
            led = [
                F.when((F.col("spot") == k) & _concerns(word, arg, s.schema) & ~F.col("fits")[self.number[p]], F.lit(self.number[p]))
                for k, s in enumerate(self.spots) for word, rules_ in s.below.items() if word != "contains" for arg, p in rules_
            ]
            front = members.select("key", "at", F.explode(F.array_compact(F.array(*led, F.lit(None).cast("int")))).alias("spot")).distinct()
        return out


def validate(df: DataFrame, key: str, value: str, schema: Schema, registry: Mapping[str, Schema] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, valid) of all rows, and (key, place, keyword) of what is broken. Keys are unique; an absent value is not valid."""
    judge = Judge(schema, registry)
    own = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    nodes = shred(own, "value", vocabulary([s.schema for s in judge.spots]))
    levels, below = [], None
    for n in reversed(nodes):
        below = judge.level(n, below)
        levels.insert(0, below)
    good = levels[0].select("key", F.col("fits")[judge.root].alias("ok"))
    verdicts = own.select("key").join(good, "key", "left").select(F.col("key").alias(key), F.coalesce("ok", F.lit(False)).alias("valid"))
    return verdicts, judge.broken(levels).withColumnRenamed("key", key)
