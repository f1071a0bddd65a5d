"""python -m relspark.cli parse|run|explain FILE [--catalog DIR] [--name VARIABLE] [--key NAME --value VALUE ...]; or keywords."""

from __future__ import annotations

import argparse
import pprint
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=["parse", "run", "explain", "datalog", "keywords"])
    p.add_argument("file", nargs="?")
    p.add_argument("--catalog", help="folder of Parquet relations; stored relations go there too")
    p.add_argument("--name", help="variable to explain or show")
    p.add_argument("--key", action="append", default=[])
    p.add_argument("--value", action="append", default=[])
    a = p.parse_args(argv)
    if a.command == "keywords":
        from relspark.lang.lexer import keywords

        pprint.pprint(keywords())
        return 0
    text = Path(a.file).read_text()
    for k, v in zip(a.key, a.value, strict=True):
        text = text.replace("${" + k + "}", v)
    if a.command == "parse":
        from relspark.lang.parser import parse

        statements, functions = parse(text)
        pprint.pprint(functions)
        pprint.pprint(statements)
        return 0
    from pyspark.sql import SparkSession

    from relspark.session import Session

    spark = SparkSession.builder.getOrCreate()
    session = Session(spark, root=a.catalog)
    if a.command == "datalog":
        from relspark.datalog.planner import run

        for name, df in run(session, text).items():
            print(name)
            df.show()
    elif a.command == "explain":
        print(session.explain(text, a.name))
    else:
        for name, df in session.run(text).items():
            print(name)
            df.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
