"""Markdown text and its HTML. Driver side, for single documents."""

from __future__ import annotations

import html
import os
import re


class Markdown:
    """Lines of a Markdown document; every method returns the builder."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def add_line(self, line: str = "") -> "Markdown":
        return self.add_lines(line)

    def add_lines(self, *lines: str) -> "Markdown":
        self.lines.extend(lines)
        return self

    def add_heading(self, text: str, level: int = 1) -> "Markdown":
        return self.add_lines("#" * min(6, max(1, level)) + f" {text}", "")

    def add_paragraph(self, text: str) -> "Markdown":
        return self.add_lines(text, "")

    def add_list_item(self, text: str, indent: int = 0) -> "Markdown":
        return self.add_lines("  " * indent + f"- {text}")

    def add_ordered_item(self, text: str, number: int = 1, indent: int = 0) -> "Markdown":
        return self.add_lines("  " * indent + f"{number}. {text}")

    def add_code_block(self, code: str, language: str = "") -> "Markdown":
        return self.add_lines(f"```{language}", code, "```", "")

    def add_quote(self, text: str) -> "Markdown":
        return self.add_lines(*(f"> {x}" for x in text.split("\n")), "")

    def add_horizontal_rule(self) -> "Markdown":
        return self.add_lines("---", "")

    def add_table_header(self, headers: list[str], alignments: list[str] | None = None) -> "Markdown":
        marks = {"left": ":---", "center": ":---:", "right": "---:"}
        row = [marks.get(a, "---") for a in (alignments or [])] + ["---"] * max(0, len(headers) - len(alignments or []))
        return self.add_table_row(headers).add_table_row(row[: len(headers)])

    def add_table_row(self, cells: list[str]) -> "Markdown":
        return self.add_lines("| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |")

    def add_link(self, text: str, url: str, title: str = "") -> "Markdown":
        return self.add_lines(self.link(text, url, title))

    def add_image(self, alt: str, url: str, title: str = "") -> "Markdown":
        return self.add_lines("!" + self.link(alt, url, title))

    def add_blank_line(self) -> "Markdown":
        return self.add_lines("")

    def build(self) -> str:
        return "\n".join(self.lines)

    def clear(self) -> "Markdown":
        self.lines.clear()
        return self

    @staticmethod
    def bold(text: str) -> str:
        return f"**{text}**"

    @staticmethod
    def italic(text: str) -> str:
        return f"*{text}*"

    @staticmethod
    def code(text: str) -> str:
        return f"`{text}`"

    @staticmethod
    def link(text: str, url: str, title: str = "") -> str:
        return f'[{text}]({url} "{title}")' if title else f"[{text}]({url})"


def _inline(text: str) -> str:
    out = html.escape(text, quote=False)
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(f"<code>{m.group(1)}</code>")
        return f"\x00{len(kept) - 1}\x00"

    out = re.sub(r"`([^`]+)`", keep, out)
    out = re.sub(r'!\[([^\]]*)\]\((\S+?)(?: "([^"]*)")?\)', r'<img src="\2" alt="\1" title="\3">', out)
    out = re.sub(r'\[([^\]]+)\]\((\S+?)(?: "([^"]*)")?\)', r'<a href="\2" title="\3">\1</a>', out)
    out = out.replace(' title=""', "")
    out = re.sub(r"\*\*(.+?)\*\*", r"<strong>\1</strong>", out)
    out = re.sub(r"\*(.+?)\*", r"<em>\1</em>", out)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m.group(1))], out)


def to_html(text: str) -> str:
    """A subset of Markdown as HTML: headings, lists, quotes, tables, rules, code and diagrams, which
    become ``<div class="mermaid">``."""
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        fence = re.match(r"```(\w*)", line)
        if fence:
            end = next((k for k in range(i + 1, len(lines)) if lines[k].startswith("```")), len(lines))
            body = "\n".join(lines[i + 1 : end])
            if fence.group(1) == "mermaid":
                out.append(f'<div class="mermaid">\n{body}\n</div>')
            else:
                css = f' class="language-{fence.group(1)}"' if fence.group(1) else ""
                out.append(f"<pre><code{css}>{html.escape(body)}</code></pre>")
            i = end + 1
            continue
        head = re.match(r"(#{1,6})\s+(.*)", line)
        if head:
            n = len(head.group(1))
            out.append(f"<h{n}>{_inline(head.group(2))}</h{n}>")
        elif re.match(r"\s*(-{3,}|\*{3,})\s*$", line):
            out.append("<hr>")
        elif re.match(r"\s*([-*+]|\d+\.)\s", line):
            tag = "ol" if re.match(r"\s*\d", line) else "ul"
            items = []
            while i < len(lines) and re.match(r"\s*([-*+]|\d+\.)\s", lines[i]):
                items.append("<li>" + _inline(re.sub(r"^\s*([-*+]|\d+\.)\s+", "", lines[i])) + "</li>")
                i += 1
            out.append(f"<{tag}>" + "".join(items) + f"</{tag}>")
            continue
        elif line.startswith(">"):
            said = []
            while i < len(lines) and lines[i].startswith(">"):
                said.append(_inline(lines[i].lstrip("> ")))
                i += 1
            out.append("<blockquote>" + "<br>".join(said) + "</blockquote>")
            continue
        elif line.startswith("|") and i + 1 < len(lines) and re.match(r"\|[\s:|-]+\|\s*$", lines[i + 1]):
            cells = lambda x: [_inline(c.strip()) for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))]
            rows = ["<tr>" + "".join(f"<th>{c}</th>" for c in cells(line)) + "</tr>"]
            i += 2
            while i < len(lines) and lines[i].startswith("|"):
                rows.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells(lines[i])) + "</tr>")
                i += 1
            out.append("<table>" + "".join(rows) + "</table>")
            continue
        elif line.strip():
            said = []
            while i < len(lines) and lines[i].strip() and not re.match(r"#{1,6}\s|```|>|\||\s*([-*+]|\d+\.)\s", lines[i]):
                said.append(_inline(lines[i]))
                i += 1
            out.append("<p>" + "\n".join(said) + "</p>" if said else f"<p>{_inline(line)}</p>")
            i += not said
            continue
        i += 1
    return "\n".join(out)


def load_css(path: str | None) -> str:
    """The style sheet; a short one of our own if there is no file."""
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return "body { max-width: 60rem; margin: 2rem auto; font-family: sans-serif; line-height: 1.5 } pre { padding: 1rem; overflow: auto; background: #f4f4f4 }"


def diagram_script(local: str | None = None) -> str:
    """Where the page loads the diagram library from: a local file, else a public address."""
    return local if local and os.path.isfile(local) else "https://cdn.jsdelivr.net/npm/mermaid/dist/mermaid.min.js"


def page(text: str, title: str = "Documentation", css: str | None = None, script: str | None = None) -> str:
    """A whole HTML page."""
    return f"""<!DOCTYPE html>
<html lang="en">
<head>
<meta charset="utf-8">
<title>{html.escape(title)}</title>
<style>
{load_css(css)}
</style>
<script src="{diagram_script(script)}"></script>
<script>window.mermaid && mermaid.initialize({{ startOnLoad: true }});</script>
</head>
<body>
{to_html(text)}
</body>
</html>
"""


def render_file(source: str, target: str, *, title: str = "Documentation", css: str | None = None) -> str:
    """A Markdown file as an HTML file."""
    with open(source, encoding="utf-8") as f:
        made = page(f.read(), title, css)
    return write(target, made)


def write(target: str, text: str) -> str:
    """Write one text artifact; folders are made."""
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    with open(target, "w", encoding="utf-8") as f:
        f.write(text)
    return target
