"""python -m hinoki check FILE|- [--audience A] [--language en|ja] [--json] | explain TYPE | forms VERB | demo"""

import argparse
import sys

from hinoki.functions import tables as T


def show(found, rows, language: str) -> None:
    """A report: each text, its findings with source and forms, then what they are worth."""
    for doc, text, *_ in rows:
        print(text.strip())
        for r in (r for r in found if r.doc_id == doc):
            print(f"  {r.start}-{r.end} {r.verdict} {r.message}")
            for s in r.suggestions or []:
                print(f"    -> {s.text} ({s.cls})")
    print(dict(T.SOURCE_NOTE)[language])
    print(dict(T.DISCLAIMER)[language])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="hinoki")
    sub = p.add_subparsers(dest="command", required=True)
    check = sub.add_parser("check")
    check.add_argument("file")
    check.add_argument("--audience", default="external")
    check.add_argument("--person", action="append", default=[], help="NAME:PARTY")
    check.add_argument("--json", action="store_true")
    demo = sub.add_parser("demo")
    explain = sub.add_parser("explain")
    explain.add_argument("type")
    for x in (check, demo, explain):
        x.add_argument("--language", choices=("en", "ja"), default="en")
    sub.add_parser("forms").add_argument("verb")
    a = p.parse_args(argv)

    from pyspark.sql import SparkSession

    from pyspark.sql import functions as F

    from hinoki.plans.checker import Checker
    from hinoki.plans.messages import MESSAGES

    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    checker = Checker(spark)
    try:
        if a.command == "explain":
            known = checker.explain(a.type)
            for k, v in known.items():
                print(f"{k}: {v}")
            for r in checker.teach(a.language).where(F.col("error_type") == known["error_type"]).orderBy("cls").collect():
                print(f"{r.cls}: {r.definition}")
        elif a.command == "forms":
            for r in checker.forms(a.verb).orderBy("label", "nth").collect():
                print(r.label, r.nth, r.text, r.cls)
        else:
            if a.command == "demo":
                rows = [(i, t, "external", [("田中", "self_group"), ("鈴木", "addressee_group")]) for i, t in enumerate(MESSAGES[:3])]
            else:
                text = sys.stdin.read() if a.file == "-" else open(a.file, encoding="utf-8").read()
                rows = [(0, text, Checker.audience(a.audience), [tuple(x.rsplit(":", 1)) for x in a.person])]
            frame = spark.createDataFrame(rows, "doc_id long, text string, audience string, persons array<struct<name:string,side:string>>")
            if a.command == "check" and a.json:
                print(checker.results(frame).first().result)
            else:
                show(checker.report(frame, a.language).orderBy("doc_id", "start").collect(), rows, a.language)
    except KeyError as e:
        print(f"unknown: {e.args[0]}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
