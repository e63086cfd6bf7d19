"""Suffix sorting by grouping: linear, without recursive renaming.

First every suffix is put in the group of its longest Lyndon prefix. Groups are
processed in descending order. When a group with prefix ``u`` is processed, each
member points to the nearest place before it that is not processed, its previous
smaller suffix; a place with ``k`` pointers gets ``u`` appended ``k`` times to its
own prefix, that is, moves to a new group right after its old one, behind those with
fewer. In the end the groups lie in order, and one pass emits the order within
them: the suffixes before an emitted one, followed along their pointers, come
next in their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Places of the suffixes of ``symbols`` (integers from 0) in ascending order; a suffix that is a
    beginning of another comes first."""
    n = len(symbols)
    if not n:
        return []
    # groups are numbered; after[g] and before[g] link them in order, 0 is the head
    firsts: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        firsts.setdefault(s, []).append(i)
    members: list[list[int]] = [[]]
    after, before = [0], [0]
    group = [0] * n
    last = 0
    for s in sorted(firsts):
        g = len(members)
        members.append(firsts[s])
        before.append(last)
        after.append(0)
        after[last] = g
        for i in firsts[s]:
            group[i] = g
        last = g
    previous = [-1] * n
    done = bytearray(n)
    current = last
    while current:
        own = [i for i in members[current] if group[i] == current]
        own.sort()
        for i in own:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        members[current] = own
        if pointed:
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in pointed.items():
                key = (k, group[p])
                if key in moved:
                    moved[key].append(p)
                else:
                    moved[key] = [p]
            # most pointers first: each new group goes right behind the old one
            for k, old in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                new = len(members)
                rows = moved[k, old]
                members.append(rows)
                right = after[old]
                before.append(old)
                after.append(right)
                after[old] = new
                before[right] = new
                for p in rows:
                    group[p] = new
        current = before[current]
    # where the next suffix of each group goes
    free = [0] * len(members)
    at, g = 0, after[0]
    while g:
        free[g] = at
        at += sum(1 for i in members[g] if group[i] == g)
        g = after[g]
    order = [-1] * n
    placed = bytearray(n)
    at = n  # the empty suffix comes first
    for k in range(-1, n):
        at = n if k < 0 else order[k]
        p = at - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            p = previous[p]
    return order
