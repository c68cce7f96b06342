"""A reader of JSON (RFC 8259) by recursive descent that goes on after errors."""

from __future__ import annotations

import re

from stratalens.llm.grammar import Panic, Report, Tokens

_TOKEN = re.compile(
    r"""(?P<blank>[ \t\n\r]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")"""
    r"""|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![\w.+-]))|(?P<word>(?:true|false|null)(?!\w))|(?P<sign>[{}\[\],:])"""
)
_BROKEN = re.compile(r'"[^"\n\r]*"?|[^\s{}\[\],:"]+')


def _tokens(report: Report) -> list[tuple[str, str, int]]:
    text, out, at = report.text, [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m:
            if m.lastgroup != "blank":
                out.append((m.group() if m.lastgroup == "sign" else m.lastgroup, m.group(), at))
            at = m.end()
            continue
        m = _BROKEN.match(text, at)
        report.add(at, "malformed string" if text[at] == '"' else f"unexpected {(m.group() if m else text[at])[:40]}")
        out.append(("string" if text[at] == '"' else "word", m.group() if m else text[at], at))  # stands for what it was meant to be
        at = m.end() if m and m.end() > at else at + 1
    out.append(("end", "", len(text)))
    return out


class _Reader(Tokens):
    def whole(self) -> None:
        try:
            self.value()
        except Panic:
            pass
        if self.kind != "end" and self.report.accepted:
            self.note(f"expected end of text, found {self.tokens[self.at][1][:40]}")

    def value(self) -> None:
        if self.take("string", "number", "word"):
            return
        if self.take("{"):
            self.entries("}", self.member)
        elif self.take("["):
            self.entries("]", self.value)
        else:
            self.fail("a value")

    def member(self) -> None:
        self.need("string")
        self.need(":")
        self.value()

    def entries(self, close: str, entry) -> None:
        """Up to the closing bracket; after an error from the next comma or bracket on."""
        if self.take(close):
            return
        while True:
            try:
                entry()
                if self.take(close):
                    return
                self.need(",", close)
            except Panic:
                nested = 0
                while self.kind != "end" and (nested or self.kind not in (",", "}", "]")):
                    nested += {"{": 1, "[": 1, "}": -1, "]": -1}.get(self.kind, 0)
                    self.at += 1
                if self.kind == "end":
                    raise
                if not self.take(","):
                    if not self.take(close):
                        raise
                    return


def read(text: str) -> Report:
    """All errors of a JSON text: exactly one value."""
    report = Report(text)
    _Reader(report, _tokens(report)).whole()
    return report
