"""Suffix arrays by linear grouping, for many texts at once.

The construction has two phases and no recursion:

1. Suffixes begin in groups by first symbol. Groups are taken in descending order. Each
   suffix s of the group at hand gets its previous-smaller pointer: the nearest p < s whose
   group is lower. All suffixes p that s points to grow their Lyndon prefix by the group's
   one, once for each s, and move into new groups directly above their old one: those that
   grow more often stand higher. When all groups are taken, every group holds the suffixes
   of one Lyndon prefix, and the groups stand in lexicographic order.
2. The order within the groups is emitted in one ascending sweep. When suffix j comes up,
   the suffixes whose Lyndon prefix ends just before j (j - 1 and, from there, along the
   previous-smaller pointers) each take the next free place of their group.

Texts are independent, so each step takes the current group of every text together: the
array operations are shared, the order within a text is the one above. For a few large texts
that saves nothing, and the same steps run on plain lists.
"""

from __future__ import annotations

import numpy as np

from stie.llm.kernels import runs, spans_of

FEW = 100


def suffix_arrays(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The suffix array of every text symbols[first[t]:first[t + 1]], one after the other.

    Each text begins with its lowest symbol, which is also where its strings are cut: give
    0 before, between and after the strings. Suffixes stand in the order of what comes
    before their next cut; those equal up to it stand in any order.
    """
    n, texts = len(symbols), len(first) - 1
    if not n:
        return np.zeros(0, dtype=np.int32)
    if texts < FEW:
        return np.concatenate([np.array(suffix_array(symbols[a:b].tolist())) + a for a, b in zip(first[:-1], first[1:], strict=True)])
    first = np.asarray(first, dtype=np.int32)
    text = np.repeat(np.arange(texts, dtype=np.int32), np.diff(first))
    order = np.argsort(symbols.astype(np.uint16), kind="stable").astype(np.int32)
    narrow = text.astype(np.uint16) if texts < 1 << 16 else text
    order = order[np.argsort(narrow[order], kind="stable")]
    start, size_of = runs(text[order], symbols[order])
    group = np.empty(n, dtype=np.int32)
    group[order] = np.repeat(start, size_of)
    size = np.zeros(n, dtype=np.int32)
    size[start] = size_of
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    low = group[first[:-1]]  # the strings' cuts: never above any symbol, so nothing is appended to them
    previous = np.full(n, -1, dtype=np.int32)
    _grouping(first, text, order, place, group, size, low, previous)
    return _emission(first, group, previous)


def _grouping(first, text, order, place, group, size, low, previous) -> None:
    upto = first[1:].copy()
    live = np.flatnonzero(upto > low + size[low])
    moved_flag = np.zeros(len(order), dtype=bool)
    while len(live):
        top = group[order[upto[live] - 1]]
        many = upto[live] - top
        at = np.repeat(top, many)
        members = order[spans_of(top, many)]
        upto[live] = top
        live = live[top > low[live] + size[low[live]]]
        # The nearest lower group to the left; members of the same group pass on what they find.
        previous[members] = members - 1
        todo = np.flatnonzero(group[members - 1] >= at)
        while len(todo):
            s = members[todo]
            previous[s] = previous[previous[s]]
            todo = todo[group[previous[s]] >= at[todo]]
        to = previous[members]
        grows = group[to] != low[text[to]]
        if not grows.any():
            continue
        to = np.sort(to[grows])
        one, times = runs(to)
        p = to[one]
        old = group[p]
        by = np.lexsort((times, old))
        p, times, old = p[by], times[by], old[by]
        h_first, h_many = runs(old)
        begin = old[h_first]
        new_end = begin + size[begin]
        target = spans_of(new_end - h_many, h_many)
        current = place[p]
        moved_flag[p] = True
        there = order[target]
        stay = there[~moved_flag[there]]
        moved_flag[p] = False
        gap = np.sort(current[current < np.repeat(new_end - h_many, h_many)])
        # Both are in the order of the groups and equally many in each.
        order[gap] = stay[np.argsort(place[stay], kind="stable")]
        place[order[gap]] = gap
        order[target] = p
        place[p] = target
        size[begin] -= h_many
        g_first, g_many = runs(old, times)
        begins = target[g_first]
        size[begins] = g_many
        group[p] = np.repeat(begins, g_many)


def _emission(first, group, previous) -> np.ndarray:
    n = len(group)
    out = np.full(n, -1, dtype=np.int32)
    free = np.arange(n, dtype=np.int32)
    done = np.zeros(n, dtype=bool)
    sizes = np.diff(first)
    live = np.argsort(-sizes, kind="stable")
    live = live[sizes[live] > 0]
    # The end of each text is below all: what ends there comes first.
    j = first[1:][live]
    step, ends = 0, sizes[live]
    while True:
        s = j - 1
        base = first[:-1][live[: len(j)]]
        ok = np.flatnonzero((s >= base))
        s, base = s[ok], base[ok]
        while len(s):
            ok = ~done[s]
            s, base = s[ok], base[ok]
            if not len(s):
                break
            spot = free[group[s]]
            free[group[s]] += 1
            out[spot] = s
            done[s] = True
            s = previous[s]
            ok = s >= base
            s, base = s[ok], base[ok]
        keep = int(np.searchsorted(-ends, -step, side="left"))
        if not keep:
            return out
        j = out[first[:-1][live[:keep]] + step]
        step += 1


def suffix_array(symbols: list[int]) -> list[int]:
    """suffix_arrays() of one text, on lists."""
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    place, group, size, previous = [0] * n, [0] * n, [0] * n, [-1] * n
    top, last = 0, None
    for at, s in enumerate(order):
        if symbols[s] != last:
            top, last = at, symbols[s]
        place[s], group[s] = at, top
        size[top] += 1
    low, upto = group[0], n
    while upto > low + size[low]:
        top = group[order[upto - 1]]
        times: dict[int, int] = {}
        for s in sorted(order[top:upto]):
            p = s - 1
            while group[p] >= top:
                p = previous[p]
            previous[s] = p
            if group[p] != low:
                times[p] = times.get(p, 0) + 1
        upto = top
        by_group: dict[int, list[int]] = {}
        for p in times:
            by_group.setdefault(group[p], []).append(p)
        for old, grown in by_group.items():
            grown.sort(key=times.__getitem__, reverse=True)
            end = old + size[old]
            size[old] -= len(grown)
            for k, p in enumerate(grown):
                end -= 1
                q, at = order[end], place[p]
                order[at], order[end], place[q], place[p] = q, p, at, end
                if k + 1 == len(grown) or times[grown[k + 1]] != times[p]:
                    begin, m = end, k
                    while m >= 0 and times[grown[m]] == times[p]:
                        group[grown[m]] = begin
                        m -= 1
                    size[begin] = k - m
    out, free, done = [-1] * n, list(range(n)), [False] * n
    j = n
    for at in range(n + 1):
        s = j - 1
        while s >= 0 and not done[s]:
            done[s] = True
            spot = free[group[s]]
            free[group[s]] = spot + 1
            out[spot] = s
            s = previous[s]
        if at < n:
            j = out[at]
    return out
