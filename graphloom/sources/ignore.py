"""Nested .gitignore rules as regular expressions (SRC-2)."""

from __future__ import annotations

import re


def translate(pattern: str) -> re.Pattern:
    """A gitignore pattern as an expression over paths relative to its folder; a folder ends in a slash."""
    anchored = "/" in pattern.rstrip("/")
    only_folder, body = pattern.endswith("/"), pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + (2 if body.startswith("**", i) else 1)
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + ("/" if only_folder else "/?") + r"\Z", re.S)


def rules(text: str) -> list[tuple[re.Pattern, bool]]:
    """(expression, ignores) of a file's lines in order."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line.removeprefix("\\") if line.startswith(("\\#", "\\!")) else line
        if line.strip("/"):
            out.append((translate(line), not keep))
    return out


def ignored(path: str, is_folder: bool, nested: list[tuple[str, list]]) -> bool:
    """Whether the last matching rule of (folder, rules), outer folders first, ignores the path."""
    out = False
    for folder, own in nested:
        inner = path[len(folder) + 1 :] if folder else path
        for pattern, ignores in own:
            if pattern.match(inner + ("/" if is_folder else "")):
                out = ignores
    return out
