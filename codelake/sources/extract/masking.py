"""Source text of C-like languages with comments and literals blanked out, position by position."""

from __future__ import annotations

import bisect
import re

_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_OPENING = re.compile(r"[/\"'`]")
_INK = re.compile(r"[^\n]")
_REGEX_AFTER = set("(,=:[!&|?{};+-*%<>~^")
_KEYWORDS_BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do")


class Source:
    """``code``: the text with comments, strings, templates and regex literals as blanks.
    ``comments``: (start, end) of block comments. Lines count from 1."""

    def __init__(self, text: str, templates: bool = True):
        self.text, self.comments = text, []
        out, i, n = list(text), 0, len(text)

        def blank(a: int, b: int) -> None:
            out[a:b] = _INK.sub(" ", text[a:b])

        def template(i: int) -> int:
            """The end of a template literal that starts at i; code in ``${}`` is blanked too."""
            k, depth = i + 1, 0
            while k < n:
                c = text[k]
                if c == "\\":
                    k += 2
                    continue
                if not depth and c == "`":
                    return k + 1
                if text.startswith("${", k):
                    depth, k = depth + 1, k + 2
                    continue
                if depth and c == "`":
                    k = template(k)
                    continue
                depth += (c == "{") - (c == "}") if depth else 0
                k += 1
            return n

        while opening := _OPENING.search(text, i):
            i = opening.start()
            c = text[i]
            if c in "/\"'":
                m = _TOKEN.match(text, i)
                if m:
                    if m.group().startswith("/*"):
                        self.comments.append((i, m.end()))
                    blank(i, m.end())
                    i = m.end()
                    continue
                if c == "/" and templates:
                    before = "".join(out[max(0, i - 12) : i]).rstrip()
                    word = re.search(r"[A-Za-z]+$", before)
                    if not before or before[-1] in _REGEX_AFTER or word and word.group() in _KEYWORDS_BEFORE_REGEX:
                        m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(text, i)
                        if m:
                            blank(i, m.end())
                            i = m.end()
                            continue
            elif c == "`" and templates:
                end = template(i)
                blank(i, end)
                i = end
                continue
            i += 1
        self.code = "".join(out)
        self._starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self._starts, at)

    def match(self, at: int, pairs: str = "{}") -> int:
        """One past the bracket that closes the one at ``at``; the end of the text if none does."""
        depth = 0
        for m in re.compile("[" + re.escape(pairs) + "]").finditer(self.code, at):
            depth += 1 if m.group() == pairs[0] else -1
            if not depth:
                return m.end()
        return len(self.code)

    def comment_before(self, at: int) -> str | None:
        """The ``/** */`` comment that stands right before, modifiers and annotations between them."""
        k = bisect.bisect_left(self.comments, (at, at)) - 1
        if k < 0:
            return None
        a, b = self.comments[k]
        between = self.code[b:at]
        if self.text.startswith("/**", a) and re.fullmatch(r"(?:\s|@[\w.]+(?:\([^)]*\))?|export|default|async|public|private|protected|static|abstract|final)*", between):
            return self.text[a:b]
        return None


def split_top(text: str, mask: str, separator: str = ",") -> list[tuple[int, int]]:
    """Spans between separators that stand outside all brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(mask):
        arrow = c == ">" and i and mask[i - 1] == "="
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and not arrow:
            depth -= 1
        elif c == separator and depth <= 0:
            out.append((start, i))
            start = i + 1
    out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]
