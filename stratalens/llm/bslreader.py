"""A reader of modules of the 1C:Enterprise language, in both keyword languages.

Statements are read by recursive descent, expressions by precedence climbing.
After an error the reader goes on behind the next semicolon or at the next word
that begins or ends a statement, so that all errors of a module are found.
"""

from __future__ import annotations

import re

from stratalens.llm.grammar import Panic, Report, Tokens

# The keywords of the language.
_SPELLINGS = {
    "if": "если if", "then": "тогда then", "elsif": "иначеесли elsif", "else": "иначе else", "endif": "конецесли endif",
    "for": "для for", "each": "каждого each", "in": "из in", "to": "по to", "while": "пока while", "do": "цикл do", "enddo": "конеццикла enddo",
    "procedure": "процедура procedure", "endprocedure": "конецпроцедуры endprocedure", "function": "функция function", "endfunction": "конецфункции endfunction",
    "var": "перем var", "export": "экспорт export", "val": "знач val", "return": "возврат return", "break": "прервать break", "continue": "продолжить continue",
    "try": "попытка try", "except": "исключение except", "endtry": "конецпопытки endtry", "raise": "вызватьисключение raise", "goto": "перейти goto",
    "execute": "выполнить execute", "addhandler": "добавитьобработчик addhandler", "removehandler": "удалитьобработчик removehandler",
    "new": "новый new", "and": "и and", "or": "или or", "not": "не not", "constant": "истина true ложь false неопределено undefined null",
}
_KEYWORDS = {word: key for key, words in _SPELLINGS.items() for word in words.split()}
#: Words that are names elsewhere.
_SOFT = {"async": ("асинх", "async"), "await": ("ждать", "await")}
_OPENS = {"если": "if", "if": "if", "область": "region", "region": "region", "вставка": "insert", "insert": "insert", "удаление": "delete", "delete": "delete"}
_CLOSES = {"конецесли": "if", "endif": "if", "конецобласти": "region", "endregion": "region", "конецвставки": "insert", "endinsert": "insert", "конецудаления": "delete", "enddelete": "delete"}
_CONDITION = re.compile(r"(?:\s|[()]|\w)+(?<!\w)(?:тогда|then)\s*", re.I)
_NAME = re.compile(r"[^\W\d]\w*")

_TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n\r]*)"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<number>\d+(?:\.\d*)?)|(?P<date>'[^'\n\r]*')"""
    r"""|(?P<string>"(?:[^"\n\r]|"")*(?:(?:\r\n?|\n)(?:[ \t ]*(?://[^\n\r]*)?(?:\r\n?|\n))*[ \t ]*\|(?:[^"\n\r]|"")*)*")"""
    r"""|(?P<line>\#[^\n\r]*)|(?P<sign><>|<=|>=|[-=<>+*/%()\[\].,;?:~&])"""
)
#: How tightly operators bind; prefix ones bind their own operand.
_BINDS = {"or": 1, "and": 2, "=": 4, "<>": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}
_PREFIX = ("not", "-", "+")

_ENDS = {"elsif", "else", "endif", "enddo", "except", "endtry", "endprocedure", "endfunction", "procedure", "function", "end"}
_BEGINS = {"if", "for", "while", "try", "return", "raise", "break", "continue", "goto", "execute", "addhandler", "removehandler", "var"}
_VALUE_ENDS = {";", *_ENDS} - {"procedure", "function"}


def _directive(line: str, held: list[tuple[str, int]], at: int, report: Report) -> None:
    """A preprocessor line; it opens, continues or closes a part."""
    line = line.split("//")[0][1:].strip()
    word, rest = (re.split(r"[ \t]+", line, maxsplit=1) + [""])[:2]
    word, rest = word.lower(), rest.strip()
    if word in _OPENS:
        kind = _OPENS[word]
        if kind == "if" and not _CONDITION.fullmatch(rest) or kind == "region" and not _NAME.fullmatch(rest) or kind in ("insert", "delete") and rest:
            report.add(at, f"malformed directive #{line[:40]}")
        held.append((kind, at))
    elif word in _CLOSES:
        if not held or held[-1][0] != _CLOSES[word]:
            report.add(at, f"directive #{word} closes nothing")
        else:
            held.pop()
    elif word in ("иначеесли", "elsif"):
        if not held or held[-1][0] != "if" or not _CONDITION.fullmatch(rest):
            report.add(at, f"misplaced directive #{word}")
    elif word in ("иначе", "else"):
        if not held or held[-1][0] != "if" or rest:
            report.add(at, f"misplaced directive #{word}")
    else:
        report.add(at, f"unknown directive #{line[:40]}")


def _tokens(report: Report) -> list[tuple[str, str, int]]:
    """The tokens; preprocessor lines are checked and left out, what is no token is noted and skipped."""
    text, out, at = report.text, [], 0
    held: list[tuple[str, int]] = []
    match, keyword = _TOKEN.match, _KEYWORDS.get
    while at < len(text):
        m = match(text, at)
        if not m:
            report.add(at, "unclosed text" if text[at] in "\"'" else f"unexpected character {text[at]}")
            stop = re.compile(r"[\n\r]" if text[at] in "\"'" else r"[\s\w;]").search(text, at + 1)
            at = stop.start() if stop else len(text)
            continue
        kind, found = m.lastgroup, m.group()
        if kind == "line":
            if text[max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1 : at].strip():
                report.add(at, "a directive behind other text")
            _directive(found, held, at, report)
        elif kind == "name":
            low = found.lower()
            # after a dot a keyword is a name
            out.append(("name" if out and out[-1][0] == "." else keyword(low, "name"), low, at))
        elif kind in ("number", "date", "string"):
            if kind == "number" and re.match(r"\w", text[m.end() : m.end() + 1]):
                report.add(at, "a number that runs into a name")
            out.append((kind, found, at))
        elif kind == "sign":
            out.append((found, found, at))
        at = m.end()
    for kind, place in held:
        report.add(place, f"directive #{kind} is never closed")
    out.append(("end", "", len(text)))
    return out


class _Reader(Tokens):
    def soft(self, key: str) -> bool:
        """A word that begins what another name or keyword follows."""
        kind, low, _ = self.tokens[self.at]
        if kind == "name" and low in _SOFT[key] and self.tokens[self.at + 1][0] in ("name", "procedure", "function", "new"):
            self.at += 1
            return True
        return False

    # --- expressions

    def expression(self, least: int = 0) -> None:
        while self.take(*_PREFIX):
            pass
        self.operand()
        while (binds := _BINDS.get(self.kind, -1)) >= max(least, 1):
            self.at += 1
            self.expression(binds + 1)

    def operand(self) -> None:
        self.soft("await")
        if self.take("string"):
            while self.take("string"):
                pass
        elif self.take("number", "date", "constant"):
            pass
        elif self.take("?"):
            self.need("(")
            self.expression()
            self.need(",")
            self.expression()
            self.need(",")
            self.expression()
            self.need(")")
            self.chain()
        elif self.take("new"):
            if self.take("name"):
                while self.take("."):
                    self.need("name")
                if self.take("("):
                    self.arguments()
            else:
                self.need("(")
                self.arguments()
            self.chain()
        elif self.take("("):
            self.expression()
            self.need(")")
            self.chain()
        elif self.take("execute", "name"):
            if self.take("("):
                self.arguments()
            self.chain()
        else:
            self.fail("a value")

    def arguments(self) -> None:
        """Up to the closing bracket; positions may be empty."""
        while True:
            if self.kind not in (",", ")"):
                self.expression()
            if self.take(")"):
                return
            self.need(",", ")")

    def chain(self) -> str:
        """Members, indexes and calls; the kind of the last one."""
        last = ""
        while True:
            if self.take("."):
                self.need("name")
                last = "."
                if self.take("("):
                    self.arguments()
                    last = "("
            elif self.take("["):
                self.expression()
                self.need("]")
                last = "["
            else:
                return last

    # --- statements

    def block(self, *ends: str) -> None:
        """Statements up to one of the words, which is not taken; at any other word that ends a block, too."""
        while True:
            while self.take(";"):
                pass
            if self.kind in ends or self.kind in _ENDS:
                return
            begun = self.at
            try:
                if self.take("~"):
                    self.need("name")
                    self.need(":")
                    continue
                self.statement()
                if self.kind not in ends:
                    self.need(";")
            except Panic:
                self.recover(begun)

    def recover(self, begun: int) -> None:
        """To the next statement; always by a token at least."""
        if self.at == begun and self.kind not in _ENDS:
            self.at += 1
        while self.kind != ";" and self.kind not in _ENDS and self.kind not in _BEGINS:
            self.at += 1

    def close(self, end: str) -> None:
        """The word that ends a block; where it is absent that is noted and the reader goes on."""
        if not self.take(end):
            kind, text, _ = self.tokens[self.at]
            self.note(f"expected {end}, found {'end of text' if kind == 'end' else text[:40]}")

    def statement(self) -> None:
        if self.take("if"):
            self.expression()
            self.need("then")
            self.block("elsif", "else", "endif")
            while self.take("elsif"):
                self.expression()
                self.need("then")
                self.block("elsif", "else", "endif")
            if self.take("else"):
                self.block("endif")
            self.close("endif")
        elif self.take("for"):
            if self.take("each"):
                self.need("name")
                self.need("in")
                self.expression()
            else:
                self.need("name")
                self.need("=")
                self.expression()
                self.need("to")
                self.expression()
            self.loop()
        elif self.take("while"):
            self.expression()
            self.loop()
        elif self.take("try"):
            self.block("except")
            self.close("except")
            self.block("endtry")
            self.close("endtry")
        elif self.take("return"):
            if self.kind not in _VALUE_ENDS:
                self.expression()
        elif self.take("raise"):
            if self.take("("):
                self.arguments()
                self.chain()
                if self.kind in _BINDS:
                    self.at += 1
                    self.expression()
            elif self.kind not in _VALUE_ENDS:
                self.expression()
        elif self.take("break", "continue"):
            pass
        elif self.take("goto"):
            self.need("~")
            self.need("name")
        elif self.take("execute"):
            self.expression()
        elif self.take("addhandler", "removehandler"):
            self.expression()
            self.need(",")
            self.expression()
        else:
            self.assignment_or_call()

    def assignment_or_call(self) -> None:
        self.soft("await")
        if self.kind == "new":
            self.operand()
            return
        called = False
        if self.take("("):
            self.expression()
            self.need(")")
        elif self.take("name"):
            if self.take("("):
                self.arguments()
                called = True
        else:
            self.fail("a statement")
        last = self.chain()
        if not (called and not last or last == "("):
            self.need("=")
            self.expression()

    def loop(self) -> None:
        self.need("do")
        self.block("enddo")
        self.close("enddo")

    def variables(self) -> None:
        while True:
            self.need("name")
            self.take("export")
            if not self.take(","):
                break
        self.need(";")

    # --- the module

    def module(self) -> None:
        """Variables, methods and the statements of the module itself, in this order."""
        methods = False
        while self.kind != "end":
            begun = self.at
            try:
                methods = self.part(methods)
            except Panic:
                self.recover(begun)
                self.take(";")
            if self.at == begun:
                self.note(f"unexpected {self.tokens[self.at][1][:40]}")
                self.at += 1

    def part(self, methods: bool) -> bool:
        """One declaration, or the statements up to the next one; whether methods may have begun."""
        marked = False
        while self.take("&"):
            self.need("name")
            if self.take("("):
                while not self.take(")"):
                    if not self.take("name", "=", ",", "string", "number", "date", "constant"):
                        self.fail("an annotation")
            marked = True
        if self.kind == "var":
            if methods:
                self.note("a variable after methods")
            self.at += 1
            self.variables()
            return methods
        self.soft("async")
        if self.kind in ("procedure", "function"):
            if methods is None:
                self.note("a method after statements")
            self.method()
            while self.take(";"):
                pass
            return True if methods is not None else None
        if marked:
            self.fail("a method")
        self.block("end")
        return None if self.kind in ("procedure", "function") else methods

    def method(self) -> None:
        end = "end" + self.kind
        self.at += 1
        begun = self.at
        try:
            self.header()
        except Panic:  # the body is read all the same
            self.recover(begun)
        self.block(end)
        self.close(end)

    def header(self) -> None:
        self.need("name")
        self.need("(")
        if not self.take(")"):
            while True:
                while self.take("&"):
                    self.need("name")
                self.take("val")
                self.need("name")
                if self.take("="):
                    self.take("-", "+")
                    self.need("number", "string", "date", "constant")
                if self.take(")"):
                    break
                self.need(",", ")")
        self.take("export")
        while self.take("var"):
            self.variables()


def read(text: str) -> Report:
    """All errors of a module; an empty one has none."""
    report = Report(text)
    _Reader(report, _tokens(report)).module()
    return report
