"""Suffix array by linear grouping (Baier, "Linear-time Suffix Sorting", CPM 2016).

Phase 1 groups suffixes by their longest Lyndon prefix.  Groups are taken in descending
order; the previous smaller pointer of a suffix leads to the nearest suffix before it that is
in a lower group, and suffixes that such pointers lead to move to a new group right above
their old one, those with more pointers higher.  Phase 2 emits the order: the smallest
suffix is known, and each suffix that is placed places the one before it and, through the
pointers, those whose groups it opens.  No names are assigned, nothing is recursive, and no
step sorts by comparison: first characters are dealt into buckets, and the members of a
group are taken as they lie, a pointer that another member needs first being found first.
"""

from __future__ import annotations

from collections.abc import Sequence

_UNKNOWN = -2


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` (integers from 0) in order; a shorter prefix sorts first."""
    n = len(text)
    if n < 2:
        return list(range(n))
    buckets: list[list[int]] = [[] for _ in range(max(text) + 1)]
    for i, value in enumerate(text):
        buckets[value].append(i)
    size = n + 1
    order = [n]  # a sentinel below all values ends the text
    start = [0] * size  # of a suffix's group, as a place in ``order``
    place = [0] * size
    members = [0] * size  # of a group, by its start
    members[0] = 1
    for bucket in buckets:
        if bucket:
            head = len(order)
            members[head] = len(bucket)
            for at, i in enumerate(bucket, head):
                start[i], place[i] = head, at
            order += bucket

    before = [_UNKNOWN] * size  # previous smaller pointers
    end = size - 1
    while end >= 0:
        low = start[order[end]]
        if low == end:
            i = order[end]
            j = i - 1
            while j >= 0 and start[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = start[j]
                m = members[g] - 1
                if m:  # to the end of its group, which it leaves
                    tail, p = g + m, place[j]
                    other = order[tail]
                    order[p], order[tail] = other, j
                    place[other], place[j] = p, tail
                    start[j] = tail
                    members[g], members[tail] = m, 1
        else:
            group = order[low : end + 1]
            for i in group:
                waiting = [i] if before[i] == _UNKNOWN else []
                while waiting:
                    k = waiting[-1]
                    j = k - 1
                    while j >= 0 and start[j] >= low:
                        if before[j] == _UNKNOWN:  # an earlier member of the same group
                            waiting.append(j)
                            break
                        j = before[j]
                    else:
                        before[k] = j
                        waiting.pop()
            pointed: dict[int, int] = {}
            for i in group:
                j = before[i]
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: list[list[int]] = [[] for _ in range(max(pointed.values(), default=0) + 1)]
            for j, times in pointed.items():
                by_count[times].append(j)
            for moved in reversed(by_count):
                left: dict[int, int] = {}
                for j in moved:
                    g = start[j]
                    m = members[g] - left.get(g, 0) - 1
                    left[g] = left.get(g, 0) + 1
                    tail, p = g + m, place[j]
                    other = order[tail]
                    order[p], order[tail] = other, j
                    place[other], place[j] = p, tail
                for g, gone in left.items():
                    rest = members[g] - gone
                    if rest:
                        members[g], members[g + rest] = rest, gone
                for j in moved:
                    g = start[j]
                    if place[j] >= g + members[g]:
                        start[j] = g + members[g]
        end = low - 1

    array = [-1] * size
    array[0] = n
    opened = start[:]  # next free place of the group that begins at an index
    free = list(range(size))
    placed = [False] * size
    placed[n] = True
    for at in range(size):
        j = array[at] - 1
        while j >= 0 and not placed[j]:
            g = opened[j]
            array[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return array[1:]
