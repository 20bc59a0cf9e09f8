"""Python regular expressions for Java's engine.

`java` rewrites a pattern so that Java finds exactly what Python's `re.search` finds: classes of letters, digits and white
space cover all scripts as Python's do, `.`, `^` and `$` know the line feed alone, and signs that only Java treats as
special are quoted. For what can't be said in Java it gives None: the ASCII and verbose flags, conditional groups, NUL and
octal escapes, two-digit group references, and case-insensitive patterns with signs or classes beyond ASCII.
"""

from __future__ import annotations

import re

WORD, DIGIT, SPACE = r"\p{L}\p{N}_", r"\p{Nd}", r"\t-\r\x1c-\x20\x85\p{Z}"
_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_NO_EDGE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
if re.search(r"\B", "") is None:  # until Python 3.13 an empty text has no place of this kind
    _NO_EDGE = rf"(?!\A\z){_NO_EDGE}"
_OUTSIDE = {"w": f"[{WORD}]", "W": f"[^{WORD}]", "d": DIGIT, "D": r"\P{Nd}", "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "b": _EDGE, "B": _NO_EDGE, "A": r"\A", "Z": r"\z", "v": r"\x0B"}
_INSIDE = {"w": WORD, "W": f"[^{WORD}]", "d": DIGIT, "D": r"\P{Nd}", "s": SPACE, "S": f"[^{SPACE}]", "b": r"\x08", "v": r"\x0B"}
_FLAGS = ((re.I, "i"), (re.M, "m"), (re.S, "s"))


class _NotInJava(Exception):
    pass


def java(pattern: str | re.Pattern) -> str | None:
    """The pattern for Java, None if only Python can run it; raises re.error for what isn't a pattern at all."""
    compiled = re.compile(pattern)
    said = compiled.pattern
    if not isinstance(said, str) or compiled.flags & (re.A | re.X | re.L):
        return None
    if re.search(r"\(\?[a-zA-Z]*i|\(\?[a-zA-Z]*-[a-zA-Z]*i", said) or compiled.flags & re.I:
        # The two engines fold the same letters as long as the pattern names them, but not within ranges or classes.
        if not said.isascii() or re.search(r"\\[uUxN]|\[\^|\\[WDS]", said):
            return None
    flags = "".join(sign for bit, sign in _FLAGS if compiled.flags & bit)
    names = {n: f"n{i}" for n, i in compiled.groupindex.items()}
    try:
        return f"(?ud{flags})" + _Rewriter(said, names).all()
    except _NotInJava:
        return None


class _Rewriter:
    def __init__(self, said: str, names: dict[str, str]):
        self.said, self.names, self.at = said, names, 0

    def all(self) -> str:
        out = []
        while self.at < len(self.said):
            out.append(self.one())
        return "".join(out)

    def one(self) -> str:
        said, at = self.said, self.at
        c = said[at]
        self.at += 1
        if c == "\\":
            return self.escape(_OUTSIDE)
        if c == "[":
            return self.set_()
        if c == "{":
            # A brace that isn't a repetition is a sign.
            if found := re.compile(r"\{(\d*)(,?)(\d*)\}").match(said, at):
                low, comma, high = found.groups()
                if low or high or comma:
                    self.at = found.end()
                    return "{" + (low or "0") + comma + high + "}"
            return r"\{"
        if c == "}":
            return r"\}"
        if c == "(" and said.startswith("?", at + 1):
            if said.startswith("?#", at + 1):
                self.at = said.index(")", at) + 1
                return ""
            if said.startswith("?(", at + 1):
                raise _NotInJava
            if found := re.compile(r"\(\?P<(\w+)>").match(said, at):
                self.at = found.end()
                return f"(?<{self.names[found[1]]}>"
            if found := re.compile(r"\(\?P=(\w+)\)").match(said, at):
                self.at = found.end()
                return rf"\k<{self.names[found[1]]}>"
            if found := re.compile(r"\(\?([a-zA-Z]+(-[a-zA-Z]+)?|-[a-zA-Z]+)").match(said, at):
                if set(found[1]) & set("axLu"):
                    raise _NotInJava
        return c

    def escape(self, classes: dict[str, str]) -> str:
        said = self.said
        c = said[self.at]
        self.at += 1
        if c in classes:
            return classes[c]
        if c.isdigit():
            if c == "0" or said[self.at : self.at + 1].isdigit() or classes is _INSIDE:
                raise _NotInJava
            return "\\" + c
        if c == "U":
            code, self.at = said[self.at : self.at + 8], self.at + 8
            return rf"\x{{{int(code, 16):x}}}"
        if c in "aftnrxu":
            return "\\" + c
        if c == "N":
            raise _NotInJava
        return "\\" + c if not c.isalnum() and c.isascii() else c

    def set_(self) -> str:
        said, out = self.said, ["["]
        if said[self.at] == "^":
            self.at += 1
            out.append("^")
        first = True
        while first or said[self.at] != "]":
            c = said[self.at]
            self.at += 1
            first = False
            if c == "\\":
                out.append(self.escape(_INSIDE))
            elif c in "[]&^":
                out.append("\\" + c)
            else:
                out.append(c)
        self.at += 1
        return "".join(out) + "]"
