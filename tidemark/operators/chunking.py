"""Chunks of files: sections, packed up to a target size, the oversized ones split at lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.batches import short_batches

TARGET, MOST = 1200, 1600
CHUNKS = "path string, ordinal int, line_start int, line_end int, text string"
#: Characters and rows of chunks that a task holds before it passes them on, about.
HELD, HELD_ROWS = 1 << 20, 1000

# Where sections begin, in Markdown and in C#.
HEADING = re.compile(r"#{1,6}\s+\S")
TYPE = re.compile(r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|ref|unsafe|new)\s+)*(?:class|struct|interface|enum|record)\b")
METHOD_END = re.compile(r"\)\s*(?:=>|\{|where\b|;)?\s*$")
CONTROL = re.compile(r"(?:if|for|foreach|while|switch|catch|using|lock|return|throw|new)\b")
METHOD = re.compile(
    r"(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|extern|unsafe|sealed|new|partial)\s+)+(?:[\w.<>,\[\]?]+\s+)?(?:\w+|operator\s+\S+)\s*\("
    r"|(?:void|bool|byte|short|int|long|float|double|decimal|string|object|[A-Z]\w*(?:<[^>]+>)?)\s+\w+\s*\("
)


def begins_section(extension: str, line: str) -> bool:
    if extension == ".md":
        return HEADING.match(line) is not None
    text = line.strip()
    if extension != ".cs" or not text or len(text) > MOST or text.startswith("//"):
        return False
    if TYPE.match(text):
        return True
    return "(" in text and METHOD_END.search(text) is not None and not CONTROL.match(text) and METHOD.match(text) is not None


def chunks_of(path: str, text: str | None, target: int = TARGET, most: int = MOST) -> list[tuple[int, int, int, str]]:
    """(ordinal, first line, last line, text) of each chunk; blank ones are left out."""
    rows = re.sub("\r\n?", "\n", text or "").split("\n")
    if len(rows) > 1 and not rows[-1]:
        rows.pop()
    if rows == [""]:
        return []
    name = path.rpartition("/")[2]
    kind = f".{name.rpartition('.')[2].lower()}" if "." in name else ""
    before = [0]  # characters before each line, with line ends
    for row in rows:
        before.append(before[-1] + len(row) + 1)
    size = lambda a, b: before[b] - before[a] - 1
    starts = [0, *(i for i in range(1, len(rows)) if begins_section(kind, rows[i]))]
    packed: list[list[int]] = []
    open_ended = False  # whether the last range may grow
    for a, b in zip(starts, [*starts[1:], len(rows)]):
        if open_ended and size(a, b) <= most and size(packed[-1][0], b) <= target:
            packed[-1][1] = b
        else:
            packed.append([a, b])
        open_ended = size(*packed[-1]) <= most
    pieces: list[tuple[int, int, str | None]] = []
    for a, b in packed:
        if size(a, b) <= most:
            pieces.append((a, b, None))
            continue
        held = 0  # characters from a on; blank lines at its beginning don't count
        for i in range(a, b):
            n = len(rows[i])
            if n > most or held and held + 1 + n > most:
                if i > a:
                    pieces.append((a, i, None))
                a, held = i, 0
            if n > most:
                pieces += [(i, i + 1, rows[i][k : k + most]) for k in range(0, n, most)]
                a = i + 1
            else:
                held += n + bool(held)
        if b > a:
            pieces.append((a, b, None))
    texts = ((a, b, "\n".join(rows[a:b]) if own is None else own) for a, b, own in pieces)
    return [(i, a + 1, b, own) for i, (a, b, own) in enumerate(x for x in texts if x[2].strip())]


def cut_batches(batches, target: int, most: int):
    """Arrow batches of chunks, of about HELD characters each, for batches of files (path, text). One text at a time becomes Python strings, so what a task holds doesn't grow with its files."""
    import pyarrow as pa

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["path", "ordinal", "line_start", "line_end", "text"])

    held, size = [], 0
    for batch in batches:
        for path, text in zip(*batch.columns):
            path = path.as_py()
            for c in chunks_of(path or "", text.as_py(), target, most):
                held.append((path, *c))
                size += len(c[3]) + len(path or "")
                if size >= HELD or len(held) >= HELD_ROWS:
                    yield out(held)
                    held, size = [], 0
    if held:
        yield out(held)


def chunk_files(files: DataFrame, target: int = TARGET, most: int = MOST, *, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, ordinal, line_start, line_end, text) of all files. A file is cut by one pass over its lines, so its chunks are made by a small helper in batches; files never leave their tasks."""
    if not 1 <= target <= most:
        raise ValueError("the target is 1 or more, and the most the target or more")
    short_batches(files.sparkSession)
    own = files.select(files[path_col].cast("string").alias("path"), files[text_col].alias("text"))
    return own.mapInArrow(lambda batches: cut_batches(batches, target, most), CHUNKS)
