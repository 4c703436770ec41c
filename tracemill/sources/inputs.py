"""Input planning on the driver: list files, globs, staged standard input, and the ranges that readers take."""

from __future__ import annotations

import glob
import os
import re
import sys
import tempfile
from collections.abc import Iterable, Sequence

MAX_LIST_DEPTH = 8


class InputError(Exception):
    """An input or an output can't be used; ``status`` is the process status to report."""

    def __init__(self, message: str, status: int = 3):
        super().__init__(message)
        self.status = status


def expand_lists(names: Iterable[str], depth: int = 0) -> list[str]:
    """``@file`` stands for the paths in it, one per line, recursively; blank lines and ``#`` comments are skipped, ``@@x`` is ``@x``."""
    found: list[str] = []
    for name in names:
        if name.startswith("@@"):
            found.append(name[1:])
        elif name.startswith("@"):
            if depth >= MAX_LIST_DEPTH:
                raise InputError(f"list files are nested more than {MAX_LIST_DEPTH} deep: {name[1:]}", 1)
            try:
                with open(name[1:], encoding="utf-8") as f:
                    lines = [line.rstrip("\r\n") for line in f]
            except OSError as e:
                raise InputError(f"can't read list file {name[1:]}: {e.strerror}", 3) from e
            found += expand_lists([x for x in lines if x and not x.startswith("#")], depth + 1)
        else:
            found.append(name)
    return found


def expand_globs(patterns: Iterable[str], recursive: bool = False, dedupe: bool = False, without: Sequence[str] = ()) -> list[str]:
    """Paths of patterns, the matches of each sorted; a pattern without a match is an error; plain names are kept as they are.

    ``dedupe`` keeps the first of equal real paths, ``without`` drops paths (an output among its own inputs), directories are dropped with either.
    """
    found: list[str] = []
    for pattern in patterns:
        if not any(c in pattern for c in "*?["):
            found.append(pattern)
            continue
        matches = sorted(glob.glob(pattern, recursive=recursive))
        if not matches:
            raise InputError(f"no file matches {pattern}", 1)
        found += matches
    if dedupe or without:
        dropped, seen, kept = {os.path.realpath(x) for x in without}, set(), []
        for path in found:
            real = os.path.realpath(path)
            if os.path.isdir(path) or real in dropped or (dedupe and real in seen):
                continue
            seen.add(real)
            kept.append(path)
        return kept
    return found


def stage_stdin(names: Sequence[str], stream=None, folder: str | None = None) -> list[str]:
    """Replace ``-`` by a copy of standard input at the same position, in a ``folder`` that the workers see too; it may be named once."""
    if names.count("-") > 1:
        raise InputError("standard input may be named once", 1)
    staged = []
    for name in names:
        if name == "-":
            name = f"{folder or tempfile.mkdtemp()}/standard-input.info"
            filesystem, path = filesystem_of(name)
            filesystem.create_dir(os.path.dirname(path), recursive=True)
            with filesystem.open_output_stream(path) as f:
                while data := (stream or sys.stdin.buffer).read(1 << 20):
                    f.write(data)
        staged.append(name)
    return staged


def filesystem_of(name: str):
    """(file system, path in it) of a URI (of any file system that Arrow knows) or of a local path."""
    from pyarrow import fs

    if name.startswith("file:/"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", name)
    if not re.match("[A-Za-z][A-Za-z0-9+.-]+://", name):
        return fs.LocalFileSystem(), os.path.abspath(name)
    return fs.FileSystem.from_uri(name)


def file_sizes(names: Sequence[str]) -> list[int]:
    """Sizes of regular files, asked for in one call per file system."""
    from pyarrow import fs

    placed = [filesystem_of(name) for name in names]
    sizes = [0] * len(names)
    for kind in {f.type_name for f, _ in placed}:
        mine = [k for k, (f, _) in enumerate(placed) if f.type_name == kind]
        for k, info in zip(mine, placed[mine[0]][0].get_file_info([placed[k][1] for k in mine]), strict=True):
            if info.type != fs.FileType.File:
                raise InputError(f"{names[k]}: no such file" if info.type == fs.FileType.NotFound else f"{names[k]}: not a regular file", 3)
            sizes[k] = info.size
    return sizes


def check_regular(names: Sequence[str]) -> None:
    file_sizes(names)


def byte_ranges(size: int, piece: int) -> list[tuple[int, int]]:
    """Ranges of at most ``piece`` bytes; a reader takes the lines that begin in its range."""
    return [(at, min(size, at + piece)) for at in range(0, size, piece)] or [(0, 0)]


def packed(sizes: Sequence[int], piece: int, most: int = 10_000) -> list[list[int]]:
    """The places of files in tasks of about ``piece`` bytes and at most ``most`` files, in order."""
    found: list[list[int]] = []
    room = 0
    for k, size in enumerate(sizes):
        # opening a file counts like reading a few pages
        cost = size + (32 << 10)
        if not found or room < cost or len(found[-1]) >= most:
            found.append([])
            room = piece
        found[-1].append(k)
        room -= cost
    return found


def numbered_lines(stream, start: int, end: int | None, limit: int, piece: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
    """(position, line without LF) of the lines that begin in [start, end), read in pieces.

    A line of more than ``limit`` bytes comes cut to ``limit`` + 1 bytes, whatever its length.
    """
    at = start
    if start:
        stream.seek(start - 1)
        at = start - 1
    rest, skipping, cut = b"", start > 0, 0
    while True:
        data = stream.read(piece)
        lines = (rest + data).split(b"\n")
        last = lines.pop()
        for line in lines:
            if skipping:
                skipping = False
            elif end is not None and at >= end:
                return
            else:
                yield (at, line[: limit + 1])
            at += len(line) + 1 + cut
            cut = 0
        rest = last
        if len(rest) > 2 * limit:
            # only what tells that the line is too long is kept of it
            cut += len(rest) - limit - 1
            rest = rest[: limit + 1]
        if not data:
            break
    if rest and not skipping and (end is None or at < end):
        yield (at, rest[: limit + 1])
