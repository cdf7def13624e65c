"""Imported names in Python sources, by a lexer that knows strings, comments and line joining."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# One token at a time; what is unterminated ends with its line, or a triple quote with the text.
TOKEN = re.compile(
    r"""
    (?P<blank>[ \t\f\r]+ | \\\r?\n | \#[^\n]*)
  | (?P<end>\n | ;)
  | (?P<string>[A-Za-z]{0,2} (?: '{3} (?:[^\\]|\\.)*? (?:'{3}|\Z) | "{3} (?:[^\\]|\\.)*? (?:"{3}|\Z)
        | ' (?:[^'\\\n]|\\.)* '? | " (?:[^"\\\n]|\\.)* "? ))
  | (?P<name>[^\W\d]\w*)
  | (?P<other>.)
    """,
    re.VERBOSE | re.DOTALL,
)
OPEN, CLOSED = "([{", ")]}"


def statements(source: str) -> Iterator[tuple[int, list[str]]]:
    """First line and tokens of each simple statement; strings are one empty token, and ``:`` ends a header."""
    tokens: list[str] = []
    line = start = 1
    depth = 0
    for found in TOKEN.finditer(source):
        kind, text = found.lastgroup, found.group()
        if kind == "end" and (depth == 0 or text == ";") or (text == ":" and depth == 0):
            if tokens:
                yield start, tokens
            tokens = []
        elif kind not in ("blank", "end"):
            if not tokens:
                start = line
            depth += (text in OPEN) - (text in CLOSED and depth > 0) if kind == "other" else 0
            tokens.append("" if kind == "string" else text)
        line += text.count("\n")
    if tokens:
        yield start, tokens


def _dotted(tokens: list[str], at: int) -> tuple[str, int]:
    """The dotted name at a place, spaces within it left out, and the place behind it."""
    begin, wants_name = at, True
    while at < len(tokens) and (tokens[at] == "." or (wants_name and tokens[at].isidentifier() and tokens[at] != "import")):
        wants_name = tokens[at] == "."
        at += 1
    return "".join(tokens[begin:at]), at


def _named(tokens: list[str], at: int) -> Iterator[tuple[str, str | None]]:
    """Names with aliases in a comma-separated list."""
    while at < len(tokens):
        name, after = _dotted(tokens, at)
        if after == at:
            if tokens[at] != "*":
                return
            name, after = "*", at + 1
        alias = None
        if tokens[after : after + 1] == ["as"] and after + 1 < len(tokens):
            alias, after = tokens[after + 1], after + 2
        yield name, alias
        if tokens[after : after + 1] != [","]:
            return
        at = after + 1


def imports_of(source: str) -> Iterator[tuple[int, str, str | None, str | None]]:
    """Line, module, name taken from it (null for ``import module``) and alias of every import."""
    for line, tokens in statements(source):
        if tokens[0] == "import":
            for module, alias in _named(tokens, 1):
                yield line, module, None, alias
        elif tokens[0] == "from":
            module, at = _dotted(tokens, 1)
            if module and tokens[at : at + 1] == ["import"]:
                listed = [t for t in tokens[at + 1 :] if t not in ("(", ")")]
                for name, alias in _named(listed, 0):
                    yield line, module, name, alias


IMPORT = "array<struct<line: int, module: string, name: string, alias: string>>"


def imported_names(source: Column) -> Column:
    """An array of ``line, module, name, alias`` for each import of a source; null and empty sources have none.

    Only sources that hold the word at all are given to the lexer.
    """

    @F.arrow_udf(IMPORT)
    def lex(sources: pa.Array) -> pa.Array:
        kind = pa.list_(
            pa.struct([("line", pa.int32()), ("module", pa.string()), ("name", pa.string()), ("alias", pa.string())])
        )
        found = []
        for text in sources.to_pylist():
            rows = imports_of(text) if text else ()
            found.append([dict(zip(("line", "module", "name", "alias"), row, strict=True)) for row in rows])
        return pa.array(found, kind)

    # An expression of Python runs on all rows whatever condition stands around it: the others get no text.
    return lex(F.when(F.contains(source, F.lit("import")), source))
