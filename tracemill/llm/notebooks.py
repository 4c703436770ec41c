"""Cells of notebooks written down as JSON, percent script, plain transcript or Markdown."""

from __future__ import annotations

import json
import re

TEXT, CODE, OUTPUT = "text", "code", "output"

_DECODER = json.JSONDecoder(strict=False)
_CELLS = re.compile(r'"cells"\s*:\s*\[')
_GAP = re.compile(r"[\s,]*")
_ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]")
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[ \t]*([^\n`]*)$")
_IN, _OUT = re.compile(r"^In \[[ \d]*\]:"), re.compile(r"^Out(?: ?\[[ \d]*\])?:")


def _joined(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(x for x in value if isinstance(x, str))
    return ""


def _output_texts(outputs) -> list[str]:
    found = []
    for out in outputs if isinstance(outputs, list) else ():
        if not isinstance(out, dict):
            continue
        found.append(_joined(out.get("text")))
        data = out.get("data")
        if isinstance(data, dict):
            found.extend(_joined(v) for k, v in data.items() if not k.startswith(("image/", "audio/", "video/")))
        trace = out.get("traceback")
        found.append("\n".join(x for x in trace if isinstance(x, str)) if isinstance(trace, list) else _joined(trace))
        if not trace:
            found.append(_joined(out.get("evalue")))
    return [x for x in found if x]


def _of_cell(cell) -> list[tuple[str, str]]:
    if not isinstance(cell, dict):
        return []
    kind = CODE if cell.get("cell_type") == "code" else TEXT
    # older notebooks hold code in "input"
    cells = [(kind, _joined(cell.get("source", cell.get("input"))))]
    return cells + [(OUTPUT, x) for x in _output_texts(cell.get("outputs"))]


def _completed(rest: str):
    """The value whose JSON breaks off at the end of ``rest``, closed as it stands; None if it can't be."""
    stack, in_string, escaped, comma = [], False, False, None
    for i, c in enumerate(rest):
        if in_string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                in_string = False
        elif c == '"':
            in_string = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        elif c == ",":
            comma = (i, stack.copy())
    closers = "".join(reversed(stack))
    if in_string:
        rest = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?$", "", rest) if escaped or re.search(r"\\u[0-9a-fA-F]{0,3}$", rest) else rest
        rest += '"'
    attempts = [rest + tail + closers for tail in ("", ":null", "null")]
    if comma:
        attempts.append(rest[: comma[0]] + "".join(reversed(comma[1])))
    for attempt in attempts:
        try:
            return _DECODER.raw_decode(attempt)[0]
        except (ValueError, RecursionError):
            continue
    return None


def _cut_off(text: str) -> list[tuple[str, str]]:
    """The whole cells of JSON that breaks off, and its last cell as far as it goes."""
    start = _CELLS.search(text)
    if not start:
        return [(TEXT, text)]
    found, at = [], start.end()
    while True:
        at = _GAP.match(text, at).end()
        try:
            cell, at = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            break
        found += _of_cell(cell)
    if text.startswith("{", at):
        found += _of_cell(_completed(text[at:]))
    return found


def _from_json(text: str) -> list[tuple[str, str]]:
    try:
        notebook = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return _cut_off(text)
    cells = notebook.get("cells") if isinstance(notebook, dict) else None
    if cells is None and isinstance(notebook, dict) and isinstance(notebook.get("worksheets"), list):
        cells = [c for sheet in notebook["worksheets"] if isinstance(sheet, dict) for c in sheet.get("cells") or []]
    if not isinstance(cells, list):
        return [(TEXT, text)]
    return [part for cell in cells for part in _of_cell(cell)]


def _from_percent(text: str) -> list[tuple[str, str]]:
    found: list[tuple[str, list[str]]] = []
    markdown, current = False, None
    for line in text.split("\n"):
        if line.startswith("# %%"):
            markdown = line.startswith(("# %% [markdown]", "# %% [md]"))
            current = (TEXT if markdown else CODE, [])
            found.append(current)
            continue
        kind = TEXT if markdown else OUTPUT if line.startswith("# >") else CODE
        if current is None or current[0] != kind:
            if not line and current is not None:
                continue
            current = (kind, [])
            found.append(current)
        current[1].append(line[3:].removeprefix(" ") if kind == OUTPUT else line[1:].removeprefix(" ") if kind == TEXT and line.startswith("#") else line)
    return [(kind, "\n".join(lines)) for kind, lines in found]


def _from_plain(text: str) -> list[tuple[str, str]]:
    found = []
    for block in re.split(r"\n[ \t]*(?:\n[ \t]*)+", text):
        if m := _IN.match(block):
            found.append((CODE, block[m.end():]))
        elif m := _OUT.match(block):
            found.append((OUTPUT, block[m.end():]))
        else:
            found.append((TEXT, block))
    return found


def _from_markdown(text: str) -> list[tuple[str, str]]:
    found: list[tuple[str, list[str]]] = [(TEXT, [])]
    fence = None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence is None and m:
            fence = m[1]
            found.append((OUTPUT if m[2].strip() in ("text", "output", "console") else CODE, []))
        elif fence is not None and m and m[1].startswith(fence) and not m[2].strip():
            fence = None
            found.append((TEXT, []))
        else:
            found[-1][1].append(line)
    return [(kind, "\n".join(lines)) for kind, lines in found]


_READERS = {"ipynb": _from_json, "percent": _from_percent, "plain": _from_plain, "md": _from_markdown}


def cells(text: str | None, nb_format: str | None) -> list[tuple[str, str]]:
    """The ordered (kind, text) parts of a notebook; kinds are text, code and output.

    Null and empty texts have none. Line ends become LF and terminal colour codes vanish. JSON that is cut off gives the cells
    before the cut and the readable strings of the last one; a text of unknown format is one text cell, as is JSON that is no notebook.
    """
    if not text:
        return []
    if "\r" in text and nb_format != "ipynb":
        text = text.replace("\r\n", "\n")
    found = _READERS.get(nb_format or "", lambda t: [(TEXT, t)])(text)
    return [(kind, _ANSI.sub("", part) if "\x1b" in part else part) for kind, part in found if part]
