"""A reader of XML markup that goes on after errors.

Any number of roots, and text around them, are no error. What must be well
formed is what XML 1.0 asks of tags, attributes, references, comments, sections,
instructions and characters.
"""

from __future__ import annotations

import re

from stratalens.llm.grammar import Report

_START = ":A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000effff"
_NAME = f"[{_START}][-.0-9·̀-ͯ‿⁀{_START}]*"
_BLANK = r"[ \t\r\n]"
_ATTRIBUTE = re.compile(rf"""{_BLANK}+({_NAME}){_BLANK}*={_BLANK}*("[^"<]*"|'[^'<]*')""")
_TAG = re.compile(rf"""<({_NAME})((?:{_BLANK}+{_NAME}{_BLANK}*={_BLANK}*(?:"[^"<]*"|'[^'<]*'))*){_BLANK}*(/?)>""")
_END = re.compile(rf"</({_NAME}){_BLANK}*>")
_REFERENCE = re.compile(rf"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|({_NAME}));")
_COMMENT = re.compile(r"<!--(?:(?!--).)*-->", re.S)
_CDATA = re.compile(r"<!\[CDATA\[.*?\]\]>", re.S)
_INSTRUCTION = re.compile(rf"<\?({_NAME})(?:{_BLANK}.*?)?\?>", re.S)
_DECLARATION = re.compile(
    rf"""<\?xml{_BLANK}+version{_BLANK}*={_BLANK}*(?:"1\.[0-9]+"|'1\.[0-9]+')"""
    rf"""(?:{_BLANK}+encoding{_BLANK}*={_BLANK}*(?:"[A-Za-z][-A-Za-z0-9._]*"|'[A-Za-z][-A-Za-z0-9._]*'))?"""
    rf"""(?:{_BLANK}+standalone{_BLANK}*={_BLANK}*(?:"(?:yes|no)"|'(?:yes|no)'))?{_BLANK}*\?>"""
)
_DOCTYPE = re.compile(rf"<!DOCTYPE{_BLANK}+{_NAME}[^\[<>]*(?:\[(?:[^\]]|\](?!{_BLANK}*>))*\]{_BLANK}*)?>", re.S)
_ENTITY = re.compile(rf"<!ENTITY{_BLANK}+({_NAME})")
_OUTSIDE = re.compile("[^\t\n\r -퟿-�\U00010000-\U0010ffff]")
# The references XML defines.
_DEFINED = {"amp", "lt", "gt", "quot", "apos"}


class _Reader:
    def __init__(self, report: Report):
        self.report, self.text, self.defined, self.open_ended = report, report.text, set(_DEFINED), False
        self.held: list[tuple[str, int]] = []
        self.names: set[str] = set()
        self.doctype_at = -1

    def references(self, part: str, at: int) -> None:
        """Every ampersand begins a reference to what there is."""
        place = part.find("&")
        while place >= 0:
            m = _REFERENCE.match(part, place)
            if not m:
                self.report.add(at + place, "an ampersand without reference")
            elif m[3]:
                if m[3] not in self.defined and not self.open_ended:
                    self.report.add(at + place, f"undefined reference {m[3][:40]}")
            else:
                number = (m[1] or m[2]).lstrip("0") or "0"
                code = int(number, 16 if m[1] else 10) if len(number) < 8 else 0
                if code > 0x10FFFF or not code or _OUTSIDE.match(chr(code)):
                    self.report.add(at + place, "a reference to no character")
            place = part.find("&", place + 1)

    def characters(self, at: int, end: int) -> None:
        part = self.text[at:end]
        if "&" in part:
            self.references(part, at)
        if (place := part.find("]]>")) >= 0:
            self.report.add(at + place, "]]> outside a section")

    def start_tag(self, m: re.Match) -> None:
        name = m[1]
        self.names.add(name)
        if m[2]:
            seen = set()
            for a in _ATTRIBUTE.finditer(self.text, m.start(2), m.end(2)):
                if a[1] in seen:
                    self.report.add(a.start(1), f"attribute {a[1][:40]} twice")
                seen.add(a[1])
                if "&" in a[2]:
                    self.references(a[2], a.start(2))
        if not m[3]:
            self.held.append((name, m.start()))

    def end_tag(self, m: re.Match) -> None:
        name = m[1]
        if self.held and self.held[-1][0] == name:
            self.held.pop()
            return
        self.report.add(m.start(), f"</{name[:40]}> closes " + (f"<{self.held[-1][0][:40]}>" if self.held else "nothing"))
        for back in range(len(self.held) - 1, -1, -1):  # as if what was left open were closed
            if self.held[back][0] == name:
                del self.held[back:]
                break

    def doctype(self, m: re.Match) -> None:
        if self.names or self.doctype_at >= 0 or self.text[self.begun : m.start()].strip(" \t\r\n") and _stripped(self.text[self.begun : m.start()]):
            self.report.add(m.start(), "a misplaced DOCTYPE")
        self.doctype_at = m.start()
        self.defined |= set(_ENTITY.findall(m[0]))
        self.open_ended = "%" in m[0] or re.search(r"^<!DOCTYPE[^\[]*(?:SYSTEM|PUBLIC)", m[0]) is not None

    def read(self) -> None:
        text, at, end = self.text, 0, len(self.text)
        for m in _OUTSIDE.finditer(text):
            self.report.add(m.start(), "a character that XML has not")
        if text.startswith("<?xml") and text[5:6] in (" ", "\t", "\r", "\n"):
            if m := _DECLARATION.match(text):
                at = m.end()
            else:
                self.report.add(0, "malformed declaration")
                at = max(text.find(">") + 1, 5)
        self.begun = at
        while at < end:
            mark = text.find("<", at)
            if mark < 0:
                mark = end
            if mark > at:
                self.characters(at, mark)
                at = mark
                continue
            if m := _TAG.match(text, at):
                self.start_tag(m)
            elif m := _END.match(text, at):
                self.end_tag(m)
            elif m := _COMMENT.match(text, at) or _CDATA.match(text, at):
                pass
            elif m := _DOCTYPE.match(text, at):
                self.doctype(m)
            elif (m := _INSTRUCTION.match(text, at)) and m[1].lower() != "xml":
                pass
            else:
                self.report.add(at, f"malformed markup {text[at : at + 40]!r}")
                while at < end and text[at] == "<":
                    at += 1
                continue  # what follows is read as text up to the next markup
            at = m.end()
        for name, place in self.held:
            self.report.add(place, f"<{name[:40]}> is never closed")


def _stripped(part: str) -> str:
    """What is left without comments and instructions."""
    return _INSTRUCTION.sub("", _COMMENT.sub("", part)).strip(" \t\r\n")


def read(text: str) -> tuple[Report, bool]:
    """All errors of a text, and whether an element with local name Form was begun."""
    report = Report(text)
    reader = _Reader(report)
    reader.read()
    return report, any(name.rpartition(":")[2] == "Form" for name in reader.names)
