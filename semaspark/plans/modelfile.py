"""Reader of semantic-model files, with the line of every parameter.

A file is a list of ``key: value`` entries. A value is a quoted string, a list
in brackets, a word, a block in braces (with or without a name before it), or,
for SQL keys, raw text up to ``;;``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_SQL_KEYS = frozenset({"html", "expression"})
_KEY = re.compile(r"[A-Za-z_][\w]*\s*:")
_WORD = re.compile(r"[^\s{}\[\],:#\"]+")
_EXEMPT = re.compile(r"#\s*lint:\s*disable\s+([A-Z0-9,\s]+?)(?:\s+reason=.*)?$")


class ModelSyntaxError(ValueError):
    """A model file that can't be read."""


@dataclass
class Entry:
    """One ``key: value``; ``body`` is set for blocks."""

    key: str
    line: int
    value: object = None
    name: str = ""
    body: list[Entry] | None = None
    exempt: set[str] = field(default_factory=set)

    def get(self, key: str, default: object = None) -> object:
        found = [e for e in self.body or () if e.key == key]
        return found[-1].value if found else default

    def all(self, key: str) -> list[Entry]:
        return [e for e in self.body or () if e.key == key]


class _Reader:
    def __init__(self, text: str, origin: str):
        self.text, self.origin, self.at = text, origin, 0
        self.exempt: set[str] = set()

    def line(self, at: int | None = None) -> int:
        return self.text.count("\n", 0, self.at if at is None else at) + 1

    def fail(self, what: str) -> ModelSyntaxError:
        return ModelSyntaxError(f"{self.origin}:{self.line()}: {what}")

    def skip(self) -> None:
        while self.at < len(self.text):
            c = self.text[self.at]
            if c.isspace():
                self.at += 1
            elif c == "#":
                end = self.text.find("\n", self.at)
                end = len(self.text) if end < 0 else end
                if m := _EXEMPT.match(self.text[self.at : end].strip()):
                    self.exempt |= set(re.split(r"[,\s]+", m[1].strip()))
                self.at = end
            else:
                return

    def peek(self) -> str:
        self.skip()
        return self.text[self.at : self.at + 1]

    def string(self) -> str:
        out, i = [], self.at + 1
        while i < len(self.text) and self.text[i] != '"':
            if self.text[i] == "\\" and i + 1 < len(self.text):
                i += 1
            out.append(self.text[i])
            i += 1
        if i >= len(self.text):
            raise self.fail("a string isn't closed")
        self.at = i + 1
        return "".join(out)

    def word(self) -> str:
        m = _WORD.match(self.text, self.at)
        if not m:
            raise self.fail(f"unexpected {self.text[self.at : self.at + 1]!r}")
        self.at = m.end()
        return m[0]

    def items(self) -> list:
        out: list = []
        self.at += 1
        while (c := self.peek()) != "]":
            if not c:
                raise self.fail("a list isn't closed")
            if c == ",":
                self.at += 1
                continue
            item = self.string() if c == '"' else self.word()
            if self.peek() == ":":
                self.at += 1
                self.skip()
                value = self.string() if self.peek() == '"' else self.word()
                out.append((item, value))
            else:
                out.append(item)
        self.at += 1
        return out

    def entries(self, nested: bool) -> list[Entry]:
        out: list[Entry] = []
        while c := self.peek():
            if c == "}":
                if not nested:
                    raise self.fail("unexpected '}'")
                self.at += 1
                return out
            if not (m := _KEY.match(self.text, self.at)):
                raise self.fail("expected 'key:'")
            key, line = m[0].rstrip(": \t\n"), self.line()
            exempt, self.exempt = self.exempt, set()
            self.at = m.end()
            e = Entry(key, line, exempt=exempt)
            out.append(e)
            if key.startswith("sql") or key in _SQL_KEYS:
                end = self.text.find(";;", self.at)
                if end < 0:
                    raise self.fail(f"{key} isn't ended by ;;")
                e.value, self.at = self.text[self.at : end].strip(), end + 2
                continue
            c = self.peek()
            if c == '"':
                e.value = self.string()
            elif c == "[":
                e.value = self.items()
            elif c == "{":
                self.at += 1
                e.body = self.entries(True)
            else:
                e.name = self.word()
                if self.peek() == "{":
                    self.at += 1
                    e.body = self.entries(True)
                else:
                    e.value = e.name
        if nested:
            raise self.fail("a block isn't closed")
        return out


def read_model(text: str, origin: str = "<text>") -> list[Entry]:
    """Entries of a model file's text."""
    return _Reader(text, origin).entries(False)
