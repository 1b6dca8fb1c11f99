"""What the four extractors share: text without comments and strings, matching brackets, lines and columns."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_PLAIN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_WITH_TICKS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|r#+\".*?\"#+|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S)


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


@dataclass
class Source:
    """A file's text, and the same with comments and strings blanked out at equal length."""

    text: str
    language: str
    code: str = field(init=False)

    def __post_init__(self) -> None:
        pattern = {"rust": _RUST, "java": _PLAIN}.get(self.language, _WITH_TICKS)
        self.code = pattern.sub(_blank, self.text)
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def place(self, at: int) -> tuple[int, int]:
        """Line, and byte column, both from 1."""
        k = bisect_right(self.lines, at) - 1
        return k + 1, len(self.text[self.lines[k] : at].encode("utf-8", "replace")) + 1

    def close(self, at: int) -> int:
        """The place of the bracket that closes the one at a place; the end of the text if there is none."""
        opening = self.code[at]
        closing = {"{": "}", "(": ")", "<": ">", "[": "]"}[opening]
        depth = 0
        for m in re.compile(f"[{re.escape(opening)}{re.escape(closing)}]").finditer(self.code, at):
            depth += 1 if m[0] == opening else -1
            if not depth:
                return m.start()
        return len(self.code)

    def body(self, at: int) -> tuple[int, int]:
        """Inside of the braces that open next after a place."""
        a = self.code.find("{", at)
        return (a + 1, self.close(a)) if a >= 0 else (at, at)


@dataclass
class Component:
    name: str
    decl: str  # interface, struct, class
    line: int
    col: int
    fields: list[tuple[str, str]] = field(default_factory=list)
    methods: list[tuple[str, str, str]] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    made_type: str | None = None
    made_package: str | None = None
    note: str | None = None


@dataclass
class Dependency:
    kind: str  # import, method_call
    path: str
    line: int
    col: int
    source: str = "<file>"
    target: str = "<package>"


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts between separators outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == by and depth <= 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]
