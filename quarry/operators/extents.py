"""Interval algebra over word positions: lists of minimal extents (none holds another) as sorted arrays of starts and ends.

Starts and ends of such a list both ascend, so two lists are merged by looking each extent's place up in the other: every operation takes a few
passes over its arrays and one merge, however many positions there are.
"""

from __future__ import annotations

import numpy as np

#: Starts and ends.
Extents = tuple[np.ndarray, np.ndarray]
NONE: Extents = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def minimal(starts: np.ndarray, ends: np.ndarray) -> Extents:
    """The extents that hold no other, in order; equal ones stand once."""
    if not len(starts):
        return NONE
    order = np.lexsort((ends, starts))
    s, e = starts[order], ends[order]
    first = np.append(True, s[1:] != s[:-1])  # of one start the shortest
    s, e = s[first], e[first]
    # an extent holds another if one that begins later ends no later
    after = np.append(np.minimum.accumulate(e[::-1])[::-1][1:], np.iinfo(np.int64).max)
    keep = e < after
    return s[keep], e[keep]


def phrase(places: list[np.ndarray]) -> Extents:
    """Where words stand side by side in this order."""
    at = places[0]
    for k, other in enumerate(places[1:], 1):
        if not len(other):
            return NONE
        i = np.minimum(np.searchsorted(other, at + k), len(other) - 1)
        at = at[other[i] == at + k]
    return at, at + len(places) - 1


def either(lists: list[Extents]) -> Extents:
    return minimal(np.concatenate([s for s, _ in lists]), np.concatenate([e for _, e in lists]))


def together(lists: list[Extents]) -> Extents:
    """The least extents that hold one of each list: for each end, the last extent of every list that has ended by then."""
    if not all(len(s) for s, _ in lists):
        return NONE
    ends = np.unique(np.concatenate([e for _, e in lists]))
    ends = ends[ends >= max(e[0] for _, e in lists)]
    starts = np.min([s[np.searchsorted(e, ends, "right") - 1] for s, e in lists], axis=0)
    return minimal(starts, ends)


def within(xs: Extents, ys: Extents) -> Extents:
    """Those of xs that an extent of ys holds: of the ys that begin no later, the last reaches furthest."""
    if not len(ys[0]):
        return NONE
    at = np.searchsorted(ys[0], xs[0], "right") - 1
    keep = (at >= 0) & (ys[1][at] >= xs[1])
    return xs[0][keep], xs[1][keep]


def containing(xs: Extents, ys: Extents) -> Extents:
    """Those of xs that hold an extent of ys: of the ys that begin no sooner, the first ends soonest."""
    if not len(ys[0]):
        return NONE
    at = np.searchsorted(ys[0], xs[0], "left")
    keep = (at < len(ys[0])) & (ys[1][np.minimum(at, len(ys[0]) - 1)] <= xs[1])
    return xs[0][keep], xs[1][keep]


def of_width(xs: Extents, least: int = 0, most: int | None = None) -> Extents:
    width = xs[1] - xs[0] + 1
    keep = (width >= least) & (width <= (most if most is not None else width))
    return xs[0][keep], xs[1][keep]


def extents(node: tuple, at: dict[str, list[int]]) -> Extents:
    """Minimal extents that satisfy a query node over these positions; windows bound what they are compared with."""
    kind, args = node[0], node[1:]
    places = lambda t: np.asarray(at.get(t, ()), np.int64)
    if kind == "term":
        return places(args[0]), places(args[0])
    if kind == "phrase":
        return phrase([places(t) for t in args])
    if kind == "or":
        return either([extents(a, at) for a in args])
    if kind == "and":
        return together([extents(a, at) for a in args])
    a, b = args
    if b[0] == "window":
        return of_width(extents(a, at), most=b[1]) if kind == "within" else of_width(extents(a, at), least=b[1])
    return (within if kind == "within" else containing)(extents(a, at), extents(b, at))
