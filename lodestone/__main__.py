"""python -m lodestone [--memory | --path DIR] [-f FILE] [--output-format human|text]: a shell, or a file's statements."""

from __future__ import annotations

import argparse
import sys
import time

from .engine import Engine
from .slt import check, parse, show_value


def print_rows(df, style: str) -> None:
    rows = [[show_value(v) for v in r] for r in df.collect()]
    if style == "text":
        print("\n".join(" ".join(r) for r in rows))
        return
    table = [df.columns, *rows]
    width = [max(len(r[k]) for r in table) for k in range(len(df.columns))]
    for k, r in enumerate(table):
        print("| " + " | ".join(v.ljust(w) for v, w in zip(r, width)) + " |")
        if k == 0:
            print("|" + "|".join("-" * (w + 2) for w in width) + "|")


def shell(engine: Engine, style: str) -> None:
    held = ""
    while True:
        try:
            line = input("  " if held else "> ")
        except EOFError:
            return
        except KeyboardInterrupt:
            held = ""
            print()
            continue
        held = f"{held}\n{line}" if held else line
        if not held.strip():
            held = ""
        elif held.rstrip().endswith(";") or held.lstrip().startswith("\\"):
            began = time.time()
            try:
                for df in engine.run(held):
                    print_rows(df, style)
                print(f"{time.time() - began:.3f} s")
            except KeyboardInterrupt:
                engine.spark.sparkContext.cancelAllJobs()
            except Exception as e:  # noqa: BLE001  a shell goes on
                print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
            held = ""


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("--path", help="keep tables here")
    p.add_argument("--memory", action="store_true", help="keep tables for this session only (the default)")
    p.add_argument("-f", "--file", help="run this .sql or .slt file")
    p.add_argument("--output-format", choices=("human", "text"), default="human")
    o = p.parse_args(args)
    engine = Engine.open(o.path) if o.path else Engine.open_in_memory()
    if not o.file:
        shell(engine, o.output_format)
        return 0
    with open(o.file, encoding="utf-8") as f:
        text = f.read()
    if o.file.endswith(".slt"):
        wrong = check(engine, parse(text))
        print("\n".join(wrong) or "ok")
        return int(bool(wrong))
    for df in engine.run(text):
        print_rows(df, o.output_format)
    return 0


if __name__ == "__main__":
    sys.exit(main())
