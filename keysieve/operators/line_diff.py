"""Line differences of two texts: anchors on lines unique in both, shortest edit paths between them."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

Span = tuple[int, int, int, int]        # old from, old to, new from, new to


def _anchors(old: Sequence, new: Sequence, span: Span) -> list[tuple[int, int]]:
    """Lines that occur once in each part, as the longest run of them that rises on both sides."""
    a, b, c, d = span
    once_old, once_new = Counter(old[a:b]), Counter(new[c:d])
    at = {line: i for i, line in enumerate(old[a:b], a) if once_old[line] == 1}
    pairs = [(at[line], j) for j, line in enumerate(new[c:d], c) if once_new[line] == 1 and line in at]
    ends: list[int] = []                # least old place at the end of a run of each length
    last: list[int] = []                # its pair
    before = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        length = bisect_left(ends, i)
        before[k] = last[length - 1] if length else -1
        if length == len(ends):
            ends.append(i)
            last.append(k)
        else:
            ends[length], last[length] = i, k
    run = []
    k = last[-1] if last else -1
    while k >= 0:
        run.append(pairs[k])
        k = before[k]
    return run[::-1]


def _middle(old: Sequence, new: Sequence) -> tuple[int, int, int, int]:
    """A run of equal lines in the middle of a shortest edit path, found from both ends at once: (x, y) to (u, v).

    Memory is linear in the lengths. The run may be empty.
    """
    n, m = len(old), len(new)
    odd = (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and old[x] == new[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            other = n - m - k
            if odd and -(d - 1) <= other <= d - 1 and x + back[other] >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and old[n - 1 - x] == new[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            other = n - m - k
            if not odd and -d <= other <= d and x + ahead[other] >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("every two texts have an edit path")


def _shortest(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """The equal lines of a shortest edit path."""
    found, work = [], [(0, len(old), 0, len(new))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and old[a] == new[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        x, y, u, v = _middle(old[a:b], new[c:d])
        found += [(a + x + i, c + y + i) for i in range(u - x)]
        work += [(a, a + x, c, c + y), (a + u, b, c + v, d)]
    return sorted(found)


def equal_lines(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """Pairs of places of lines that stay, rising on both sides."""
    found: list[tuple[int, int]] = []
    work: list[Span] = [(0, len(old), 0, len(new))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and old[a] == new[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and old[b - 1] == new[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        run = _anchors(old, new, (a, b, c, d))
        if run:
            found += run
            for i, j in run:
                work.append((a, i, c, j))
                a, c = i + 1, j + 1
            work.append((a, b, c, d))
            continue
        # Lines that the other side doesn't have can't stay and only cost time.
        left, right = set(new[c:d]), set(old[a:b])
        here = [i for i in range(a, b) if old[i] in left]
        there = [j for j in range(c, d) if new[j] in right]
        found += [(here[x], there[y]) for x, y in _shortest([old[i] for i in here], [new[j] for j in there])]
    return sorted(found)


def split_lines(text: str | None) -> tuple[list[str], bool]:
    """The lines of a text, and whether it ends with a newline; no text has no line."""
    pieces = (text or "").split("\n")
    return (pieces[:-1], bool(text)) if not pieces[-1] else (pieces, False)


def hunks(old: Sequence[str], new: Sequence[str], ignore_space: bool = False) -> list[dict]:
    """What changes between two lists of lines: places from 0, the removed and the added lines of every gap."""
    def key(line: str) -> str:
        return "".join(line.split()) if ignore_space else line

    found, a, c = [], 0, 0
    for i, j in [*equal_lines([key(x) for x in old], [key(x) for x in new]), (len(old), len(new))]:
        if i > a or j > c:
            found.append({"old_from": a, "removed": list(old[a:i]), "new_from": c, "added": list(new[c:j])})
        a, c = i + 1, j + 1
    return found


def patched(old: str | None, changes: Sequence[dict], newline: bool) -> str:
    """The old text with the changes put in."""
    old, lines, at = split_lines(old)[0], [], 0
    for change in changes:
        lines += [*old[at:change["old_from"]], *change["added"]]
        at = change["old_from"] + len(change["removed"])
    return "\n".join([*lines, *old[at:]]) + "\n" * newline
