"""The extractors: each turns a Source into components and dependencies."""

from __future__ import annotations

import re
from collections.abc import Callable

from stratagraph.extract.lexer import Component, Dependency, Source, split_top

Facts = tuple[list[Component], list[Dependency]]
EXTENSIONS = {".go": "go", ".java": "java", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript"}

_WORD = r"[A-Za-z_]\w*"


# Go


def _go_blocks(s: Source, keyword: str):
    """(name, start of name, body) of type declarations, single or grouped."""
    for m in re.finditer(rf"(?m)^\s*(?:type\s+)?({_WORD})(?:\[[^\]]*\])?\s+{keyword}\s*\{{", s.code):
        yield m[1], m.start(1), (m.end(), s.close(m.end() - 1))


def _go_results(text: str) -> str:
    """The first result of a Go function."""
    text = text.strip()
    if text.startswith("("):
        text = split_top(text[1:].rstrip(") "))[0].strip()
        if " " in text and not text.startswith(("*", "func", "map", "chan")):
            text = text.split(None, 1)[1]
    return text.strip()


def go(s: Source) -> Facts:
    components, methods = [], {}
    for m in re.finditer(rf"(?m)^func\s*\(\s*(?:{_WORD}\s+)?\*?\s*({_WORD})(?:\[[^\]]*\])?\s*\)\s*({_WORD})\s*\(", s.code):
        end = s.close(m.end() - 1)
        rest = s.code[end + 1 : s.code.find("{", end) if s.code.find("{", end) >= 0 else end + 1]
        methods.setdefault(m[1], []).append((m[2], s.code[m.end() : end].strip(), rest.strip()))
    made: dict[str, tuple[str, str]] = {}
    for m in re.finditer(rf"(?m)^func\s+(New\w+)\s*(?:\[[^\]]*\])?\(", s.code):
        end = s.close(m.end() - 1)
        brace = s.code.find("{", end)
        first = _go_results(s.code[end + 1 : brace if brace >= 0 else len(s.code)])
        r = re.fullmatch(rf"(\*?)(?:({_WORD})\.)?({_WORD})(?:\[.*\])?", first, re.S)
        if not r or first in ("error", "string", "int", "bool"):
            continue
        base = m[1][3:]
        for name in (base[0].lower() + base[1:], base[0].upper() + base[1:]):
            made.setdefault(name, (r[3], "" if r[1] else r[2] or ""))
    for name, at, (a, b) in _go_blocks(s, "interface"):
        if name[0].islower():
            continue
        own = [(m[1], m[2].strip(), m[3].strip()) for m in re.finditer(rf"(?m)^\s*({_WORD})\s*\(([^)]*)\)\s*([^\n;}}]*)", s.code[a:b])]
        components.append(Component(name, "interface", *s.place(at), methods=own))
    for name, at, (a, b) in _go_blocks(s, "struct"):
        fields = []
        for line in s.code[a:b].replace(";", "\n").split("\n"):
            m = re.match(rf"\s*({_WORD}(?:\s*,\s*{_WORD})*)\s+([^\s`].*?)\s*$", line)
            if m:
                fields += [(n.strip(), m[2]) for n in m[1].split(",")]
        kind, package = made.get(name, (None, None))
        components.append(Component(name, "struct", *s.place(at), fields=fields, methods=methods.get(name, []), made_type=kind, made_package=package))
    deps = []
    for m in re.finditer(r"(?m)^import(?:[ \t]*(\())?", s.code):
        end = s.close(m.end() - 1) if m[1] else s.text.find("\n", m.end()) if s.text.find("\n", m.end()) >= 0 else len(s.text)
        for q in re.finditer(r"\"([^\"\n]+)\"|`([^`\n]+)`", s.text[m.end() : end]):
            if s.code[m.end() + q.start()] == " " and not re.search(r"//[^\n]*$", s.text[m.end() : m.end() + q.start()]):
                deps.append(Dependency("import", q[1] or q[2], *s.place(m.end() + q.start())))
    for m in re.finditer(r"(?m)^func\s+init\s*\(\s*\)\s*\{", s.code):
        for q in re.finditer(rf"({_WORD}(?:\.{_WORD})*)\.{_WORD}\s*\(", s.code[m.end() : s.close(m.end() - 1)]):
            deps.append(Dependency("method_call", q[1], *s.place(m.end() + q.start()), source="<init>"))
    return components, deps


# Rust


def rust(s: Source) -> Facts:
    components = []
    for m in re.finditer(rf"\btrait\s+({_WORD})", s.code):
        a, b = s.body(m.end())
        components.append(Component(m[1], "interface", *s.place(m.start(1)), methods=[(x, "", "") for x in re.findall(rf"\bfn\s+({_WORD})", s.code[a:b])]))
    traits: dict[str, list[str]] = {}
    for m in re.finditer(rf"\bimpl(?:\s*<[^{{;]*?>)?\s+({_WORD})\s+for\s+({_WORD})\s*(?:where[^{{]*)?\{{", s.code):
        own = traits.setdefault(m[2], [])
        if m[1] not in own:
            own.append(m[1])
    for m in re.finditer(rf"\bstruct\s+({_WORD})(?:\s*<[^{{;(]*>)?\s*(?:where[^{{;]*)?([{{;(])", s.code):
        fields = []
        if m[2] == "{":
            for part in split_top(s.code[m.end() : s.close(m.end() - 1)]):
                f = re.match(rf"\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?({_WORD})\s*:\s*(.+?)\s*$", part, re.S)
                if f:
                    fields.append((f[1], re.sub(r"\s+", " ", f[2])))
        components.append(Component(m[1], "struct", *s.place(m.start(1)), fields=fields, implements=traits.get(m[1], [])))
    deps = []
    for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", s.code):
        path = re.sub(r"\s+", " ", m[1]).strip()
        if not path.startswith(("std::", "core::")):
            deps.append(Dependency("import", path, *s.place(m.start(1)), target="<module>"))
    return components, deps


# TypeScript


def _names(text: str | None) -> list[str]:
    return [re.sub(r"<.*", "", x, flags=re.S).strip() for x in split_top(text or "") if x.strip()]


def typescript(s: Source) -> Facts:
    components = []
    for m in re.finditer(rf"\binterface\s+({_WORD})", s.code):
        a, b = s.body(m.end())
        depth, own, inner = 0, [], s.code[a:b]
        for q in re.finditer(rf"[{{}}]|(?:^|[\n;,{{]|readonly\s)\s*({_WORD})\??\s*(?:<[^>]*>)?\s*\(", inner):
            if q[0] == "{":
                depth += 1
            elif q[0] == "}":
                depth -= 1
            elif not depth:
                own.append((q[1], "", ""))
        components.append(Component(m[1], "interface", *s.place(m.start(1)), methods=own))
    for m in re.finditer(rf"\btype\s+({_WORD})\s*(?:<[^=]*>)?\s*=\s*\{{", s.code):
        components.append(Component(m[1], "interface", *s.place(m.start(1))))
    for m in re.finditer(rf"\bclass\s+({_WORD})\s*(?:<[^{{]*?>)?\s*(?:extends\s+[^{{]*?)?(?:implements\s+([^{{]+?))?\s*\{{", s.code):
        components.append(Component(m[1], "class", *s.place(m.start(1)), implements=_names(m[2])))
    deps = []
    for m in re.finditer(r"(?m)^\s*import\b", s.code):
        q = re.compile(r"[\"']([^\"'\n]+)[\"']").search(s.text, m.end())
        if q and ";" not in s.code[m.end() : q.start()] and not re.search(r"\bimport\b", s.code[m.end() : q.start()]):
            deps.append(Dependency("import", q[1], *s.place(q.start()), target="<module>"))
    return components, deps


# Java

_MARKS = {"Repository": "repository", "Service": "service", "Controller": "adapter", "RestController": "adapter"}


def java(s: Source) -> Facts:
    components = []
    for m in re.finditer(rf"(?<![@\w])interface\s+({_WORD})", s.code):
        a, b = s.body(m.end())
        components.append(Component(m[1], "interface", *s.place(m.start(1)), methods=[(x, "", "") for x in re.findall(rf"({_WORD})\s*\([^()]*\)\s*(?:throws[^;{{]*)?[;{{]", s.code[a:b])]))
    for m in re.finditer(rf"((?:@{_WORD}(?:\([^)]*\))?\s*|public\s+|protected\s+|private\s+|abstract\s+|final\s+|static\s+)*)\bclass\s+({_WORD})\s*(?:<[^{{]*?>)?\s*(?:extends\s+[\w.<>, ]+?)?\s*(?:implements\s+([^{{]+?))?\s*\{{", s.code):
        note = next((_MARKS[a] for a in re.findall(rf"@({_WORD})(?!\w*\s*\()", m[1]) if a in _MARKS), None)
        components.append(Component(m[2], "class", *s.place(m.start(2)), implements=_names(m[3]), note=note))
    deps = []
    for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", s.code):
        if not m[1].startswith(("java.", "javax.")):
            deps.append(Dependency("import", m[1], *s.place(m.start(1)), target="<class>"))
    return components, deps


EXTRACTORS: dict[str, Callable[[Source], Facts]] = {"go": go, "java": java, "rust": rust, "typescript": typescript}


def register(language: str, extensions: list[str], extractor: Callable[[Source], Facts]) -> None:
    """Adds a language, or replaces one."""
    EXTRACTORS[language] = extractor
    for x in extensions:
        EXTENSIONS[x] = language


def extract(path: str, language: str, text: str | None) -> Facts:
    if text is None or path.endswith(".d.ts") or language not in EXTRACTORS:
        return [], []
    return EXTRACTORS[language](Source(text, language))
