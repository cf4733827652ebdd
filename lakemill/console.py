"""A small SQL console: statements end with a semicolon; .tables, .schema NAME, .explain SQL and .quit."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from lakemill.connection import Connection, connect


def run(con: Connection, lines: Iterable[str], out=sys.stdout) -> None:  # noqa: ANN001
    held = ""
    for line in lines:
        text = line.strip()
        if not held and text.startswith("."):
            word, _, rest = text.partition(" ")
            if word == ".quit":
                return
            if word == ".tables":
                print("\n".join(sorted(t.name for t in con.spark.catalog.listTables())), file=out)
            elif word == ".schema":
                print("\n".join(f"{c} {t}" for c, t in con.table(rest).frame.dtypes), file=out)
            elif word == ".explain":
                print(con.sql(rest.rstrip(";")).explain(), file=out)
            else:
                print(f"unknown command {word}", file=out)
            continue
        held += line if line.endswith("\n") else line + "\n"
        if text.endswith(";"):
            try:
                r = con.sql(held.strip().rstrip(";"))
                if r.columns:
                    print("\t".join(r.columns), file=out)
                    for row in r.fetchmany(100):
                        print("\t".join(map(str, row)), file=out)
            except Exception as e:  # noqa: BLE001  (the console goes on)
                print(f"error: {e}", file=out)
            held = ""


def main(argv: list[str] | None = None) -> None:
    con = connect()
    args = sys.argv[1:] if argv is None else argv
    run(con, [a if a.rstrip().endswith(";") else a + ";" for a in args] if args else sys.stdin)


if __name__ == "__main__":
    main()
