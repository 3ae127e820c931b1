"""A runner of sqllogictest files over an Engine, and of plain SQL files.

Records are `statement ok`, `statement error`, `query <types> [nosort|rowsort|valuesort]` with the rows behind
a line of dashes, `query error`, `include file` and `halt`. Values are compared as text."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from pathlib import Path

from .engine import Engine


@dataclass
class Record:
    kind: str  # ok, error, query
    sql: str
    sort: str
    rows: list[str]
    line: int


def show_value(v) -> str:
    """A value as these files write it."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, Decimal):
        return format(v.normalize(), "f") if v == v.to_integral_value() or v else "0"
    if isinstance(v, (bytes, bytearray)):
        return "".join(chr(b) if 32 <= b < 127 and b != 92 else f"\\x{b:02X}" for b in v)
    if isinstance(v, list):
        return "[" + ",".join(show_value(x) for x in v) + "]"
    if isinstance(v, str):
        return v or "(empty)"
    return str(v)


def parse(text: str, folder: Path | None = None) -> list[Record]:
    out, lines, k = [], text.split("\n"), 0
    while k < len(lines):
        words = lines[k].split()
        if not words or words[0].startswith("#"):
            k += 1
            continue
        if words[0] == "halt":
            break
        if words[0] == "include":
            for p in sorted((folder or Path(".")).glob(words[1])):
                out += parse(p.read_text(), p.parent)
            k += 1
            continue
        if words[0] not in ("statement", "query"):
            raise ValueError(f"line {k + 1}: unknown record {words[0]}")
        begin, k, body = k + 1, k + 1, []
        while k < len(lines) and lines[k].strip() and lines[k].strip() != "----":
            body.append(lines[k])
            k += 1
        rows = []
        if k < len(lines) and lines[k].strip() == "----":
            k += 1
            while k < len(lines) and lines[k].strip():
                rows.append(" ".join(lines[k].split()))
                k += 1
        failing = len(words) > 1 and words[1] == "error"
        kind = "error" if failing else "ok" if words[0] == "statement" else "query"
        sort = next((w for w in words[1:] if w in ("rowsort", "valuesort", "nosort")), "nosort")
        out.append(Record(kind, "\n".join(body), sort, rows, begin))
    return out


def check(engine: Engine, records: list[Record]) -> list[str]:
    """What went wrong, by line; nothing if all is as the file says."""
    wrong = []
    for r in records:
        try:
            got = [" ".join(show_value(v) for v in row) for row in engine.query(r.sql)] if r.kind == "query" else engine.run(r.sql)
            if r.kind == "error" and got:
                for df in got:
                    df.collect()
        except Exception as e:  # noqa: BLE001  what a statement raises is what is asked
            if r.kind != "error":
                wrong.append(f"line {r.line}: {str(e).splitlines()[0][:200]}")
            continue
        if r.kind == "error":
            wrong.append(f"line {r.line}: no error")
        elif r.kind == "query":
            want = r.rows
            if r.sort == "rowsort":
                got, want = sorted(got), sorted(want)
            elif r.sort == "valuesort":
                got, want = sorted(x for row in got for x in row.split()), sorted(x for row in want for x in row.split())
            if got != want:
                wrong.append(f"line {r.line}: {got[:5]} instead of {want[:5]}")
    return wrong


def run_file(engine: Engine, path: str) -> list[str]:
    """Run a .slt file, or the statements of a .sql file."""
    p = Path(path)
    if p.suffix == ".slt":
        return check(engine, parse(p.read_text(), p.parent))
    engine.run(p.read_text())
    return []
