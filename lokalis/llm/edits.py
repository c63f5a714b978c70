"""Edit distances on short strings, bounded, and lexicons that find a word within a few edits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable


def _within(a: str, b: str, k: int) -> bool:
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    if i == n:
        return len(a) + len(b) - 2 * n <= k
    if not k or abs(len(a) - len(b)) > k:
        return False
    k -= 1
    x, y = a[i + 1 :], b[i + 1 :]
    if len(a) == len(b) and k == 0:
        return x == y or (len(x) > 0 and len(y) > 0 and a[i] == y[0] and x[0] == b[i] and x[1:] == y[1:])
    return (
        _within(x, y, k) or _within(a[i:], y, k) or _within(x, b[i:], k)
        or (len(x) > 0 and len(y) > 0 and a[i] == y[0] and x[0] == b[i] and _within(x[1:], y[1:], k))
    )


def osa(a: str, b: str, most: int = 2) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap neighbours) up to `most`; `most` + 1 if it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 1, min(len(a), len(b))
    while i <= n and a[-i] == b[-i]:
        i += 1
    if i > 1:
        a, b = a[: len(a) - i + 1], b[: len(b) - i + 1]
    for k in range(max(1, abs(len(a) - len(b))), most + 1):
        if _within(a, b, k):
            return k
    return most + 1


def deletes(word: str, most: int) -> set[str]:
    """The word and what is left of it after up to `most` (0, 1 or 2) deletions."""
    out = {word}
    if most:
        one = [(i, word[:i] + word[i + 1 :]) for i in range(len(word))]
        out.update(w for _, w in one)
        if most > 1:
            for i, w in one:
                out.update([w[:j] + w[j + 1 :] for j in range(i, len(w))])
    return out


class Lexicon:
    """Words found by symmetric deletes."""

    def __init__(self, words: Iterable[str], most: int):
        self.most = most
        self.index: dict[str, list[str]] = defaultdict(list)
        for w in dict.fromkeys(words):
            for k in deletes(w, most):
                self.index[k].append(w)

    def near(self, word: str) -> list[str]:
        """Words within `most` edits."""
        seen: dict[str, None] = {}
        for k in deletes(word, self.most):
            for w in self.index.get(k, ()):
                seen[w] = None
        return [w for w in seen if osa(word, w, self.most) <= self.most]
