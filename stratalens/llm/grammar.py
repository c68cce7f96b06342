"""What the readers of all languages share: errors with places, and tokens."""

from __future__ import annotations

import bisect
import sys
from dataclasses import dataclass, field

#: Nesting the readers follow; their recursion takes no C stack.
_DEPTH = 1_000_000


@dataclass
class Report:
    """All errors of one text, in the order of their finding; ``cause`` is that of the first one."""

    text: str
    errors: list[tuple[int, str]] = field(default_factory=list)

    def add(self, at: int, cause: str) -> None:
        self.errors.append((at, cause))

    @property
    def accepted(self) -> bool:
        return not self.errors

    def placed(self) -> list[tuple[int, int, str]]:
        """(line, column, cause) of each error, by place; both count from 1."""
        if not self.errors:
            return []
        breaks = [i for i, c in enumerate(self.text) if c == "\n"]
        out = []
        for at, cause in sorted(self.errors, key=lambda e: e[0]):
            line = bisect.bisect_left(breaks, at)
            out.append((line + 1, at - (breaks[line - 1] + 1 if line else 0) + 1, cause))
        return out


class Panic(Exception):
    """An error was noted; the reader looks for a place to go on from."""


class Tokens:
    """Tokens (kind, text, place) of one text, and the place among them."""

    def __init__(self, report: Report, tokens: list[tuple[str, str, int]]):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _DEPTH))
        self.report, self.tokens, self.at = report, tokens, 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    def take(self, *kinds: str) -> bool:
        if self.tokens[self.at][0] in kinds:
            self.at += 1
            return True
        return False

    def note(self, cause: str) -> None:
        self.report.add(self.tokens[self.at][2], cause)

    def fail(self, expected: str) -> None:
        """Note what was expected, and panic."""
        kind, text, _ = self.tokens[self.at]
        self.note(f"expected {expected}, found {'end of text' if kind == 'end' else text[:40]}")
        raise Panic

    def need(self, *kinds: str) -> None:
        if not self.take(*kinds):
            self.fail(" or ".join(kinds))
