"""A bound on the work of matching a pattern against a text of bounded length, by the ways in which its parts can match.

A pattern is parsed by the standard library, and each part gets two numbers for a text of at most ``longest`` characters: in
how many ways it can match from one position (``ways``; the work of trying them all), and whether two of these ways can cover
the same characters (``vague``). Parts in a row multiply, alternatives add. A part that repeats without bound may not be
vague, and may not hold another repetition without bound: the ways would grow exponentially with the text. A repetition with
a bound may be vague, but then its ways are raised to that bound. A pattern may have as many ways as three independent
repetitions without bound.

Possessive repetitions, atomic groups and assertions give nothing back: they count the work inside, but leave no choice.
"""

from __future__ import annotations

import re
import re._constants as c
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from typing import Any

#: Parts that are tried once and then kept as they matched.
KEPT = {c.ATOMIC_GROUP, c.ASSERT, c.ASSERT_NOT, c.POSSESSIVE_REPEAT}


class UnsafePattern(ValueError):
    """Matching could take longer than the bound allows."""


#: More ways than this are not told apart.
MANY = 1 << 40


@dataclass(frozen=True)
class Part:
    ways: int = 1
    #: Two ways can cover the same characters.
    vague: bool = False
    #: Repeats without a bound somewhere inside.
    endless: bool = False
    #: Alternatives that can both match, which no atomic group encloses.
    forked: bool = False


def _row(parts: list[Part]) -> Part:
    whole = lambda a, b: Part(min(a.ways * b.ways, MANY), a.vague or b.vague, a.endless or b.endless, a.forked or b.forked)
    return reduce(whole, parts, Part())


def _apart(branches: list[Any]) -> bool:
    """Whether at most one branch can match: all have the same fixed width, and begin with different characters."""
    widths = {width for b in branches for width in b.getwidth()}
    heads = [chr(b[0][1]).casefold() if len(b) and b[0][0] is c.LITERAL else None for b in branches]
    return len(widths) == 1 and None not in heads and len(set(heads)) == len(heads)


def _choice(branches: list[Any], longest: int) -> Part:
    parts = [_parts(b, longest) for b in branches]
    forked = len(branches) > 1 and not _apart(branches)
    return Part(sum(p.ways for p in parts), forked or any(p.vague for p in parts), any(p.endless for p in parts), forked or any(p.forked for p in parts))


def _repeated(least: int, most: int, body: Part, longest: int) -> Part:
    endless = most == c.MAXREPEAT
    if endless and body.endless:
        raise UnsafePattern("a repetition without bound inside another")
    if endless and (body.vague or body.forked):
        raise UnsafePattern("an ambiguous part repeats without bound")
    times = min(int(most), longest)
    lengths = max(times - least, 0) + 1
    inner = body.ways ** min(times, 64) if body.vague and not body.endless else body.ways  # 64 doublings pass MANY
    return Part(min(inner * lengths, MANY), body.vague or lengths > 1, endless or body.endless, body.forked)


def _part(op: Any, given: Any, longest: int) -> Part:
    if op in (c.MAX_REPEAT, c.MIN_REPEAT):
        return _repeated(given[0], given[1], _parts(given[2], longest), longest)
    if op in KEPT:
        inside = given if op is c.ATOMIC_GROUP else given[-1]
        return Part(_parts(inside, longest).ways)
    if op is c.SUBPATTERN:
        return _parts(given[-1], longest)
    if op is c.BRANCH:
        return _choice(given[1], longest)
    if op is c.GROUPREF_EXISTS:
        return _choice([b for b in given[1:] if b is not None], longest)
    return Part()


def _parts(parsed: Any, longest: int) -> Part:
    return _row([_part(op, given, longest) for op, given in parsed])


def check_pattern(pattern: str, longest: int) -> None:
    """An error for a pattern that is none, or whose work on texts of at most ``longest`` characters has no fit bound."""
    try:
        parsed = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError) as e:
        raise UnsafePattern("not a pattern") from e
    if _parts(parsed, longest).ways > (longest + 1) ** 3:
        raise UnsafePattern("matching has too many choices")
