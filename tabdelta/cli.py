"""Command line: compare two tables, or merge two copies of a base.

``python -m tabdelta compare OLD NEW [--key COLUMN]... [--json]``
``python -m tabdelta merge BASE A B --key COLUMN [--resolve CONFLICT=CHOICE]... --out DIR``

Tables are Parquet files, or CSV files with a header row.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import TabDeltaError
from .operators import checks, merge
from .operators.compare import compare_tables
from .sources.csv import detect_delimiter

#: Findings shown of each severity.
LINES = 50
_CHOICES = {"copy1": "A", "a": "A", "copy2": "B", "b": "B", "base": "base", "original": "base", "both": "both", "delete": "delete", "keepedits": "keepEdits"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".csv"):
        lines = [r["value"] for r in spark.read.text(path).limit(200).collect()]
        return spark.read.csv(path, sep=detect_delimiter(lines), header=True, multiLine=True, quote='"', escape='"', inferSchema=True)
    return spark.read.parquet(path)


def parse_answer(text: str) -> tuple[str, str, str | None, str | None]:
    """``id, choice, typed, b_key`` of CONFLICT=CHOICE; the last = splits, ``both:KEY`` names the second row's key."""
    name, eq, choice = text.rpartition("=")
    if not eq:
        raise ValueError(f"{text} has no =")
    word, _, new_key = choice.partition(":")
    known = _CHOICES.get("".join(word.lower().split()))
    if word.lower() == "typed":
        return name, "typed", new_key, None
    if known is None:
        raise ValueError(f"{choice} is no choice")
    return name, known, None, new_key or None


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    found = compare_tables(read_table(spark, args.old), read_table(spark, args.new), given=args.key)
    findings = found.findings.persist()
    counts = found.counts().first().asDict()
    top = {s: [r["message"] for r in checks.ranked(findings.where(F.col("severity") == s)).where(F.col("rank") <= LINES).orderBy("rank").collect()] for s in checks.SEVERITIES}
    matched_by = ", ".join(sorted(r["matched_by"] for r in found.matched_by.collect())) or "key"
    findings.unpersist()
    found.close()
    columns = [{"old": m.old, "new": m.new, "status": m.status} for m in found.columns]
    if args.json:
        print(json.dumps({"key": found.key.columns, "matched_by": matched_by, "columns": columns, "counts": counts, "findings": top}, ensure_ascii=False))
        return 0
    print(f"{counts['real_changes']} real change(s), {counts['needs_attention']} need attention.")
    if not found.key.columns:
        print(f"No key was found; rows were matched by {matched_by}.")
    for severity, lines in top.items():
        if lines:
            print(f"\n{severity.capitalize()}")
            print("\n".join(f"  {x}" for x in lines))
    return 0


def run_merge(spark: SparkSession, args: argparse.Namespace) -> int:
    base, a, b = (read_table(spark, p) for p in (args.base, args.a, args.b))
    key = args.key[0]
    classes = merge.classify(merge.three_way(base, a, b, key), [c for c in base.columns if c != key]).persist()
    found = merge.conflicts(classes)
    rows = [parse_answer(x) for x in args.resolve]
    answers = spark.createDataFrame([(n, c, t, None, k) for n, c, t, k in rows], "id string, choice string, typed string, a_key string, b_key string")
    answers = answers.join(found.select("id", "key"), "id", "left").withColumn("a_key", F.col("key")).drop("key")
    unknown = answers.join(found, "id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"{unknown[0]['id']} is no conflict")
    merge.check_answers(found, answers)
    changes = merge.change_set(classes, answers)
    merge.merged_table(base, a, b, key, changes, classes).write.mode("overwrite").parquet(f"{args.out}/table")
    merge.merge_log(classes, answers).write.mode("overwrite").parquet(f"{args.out}/log")
    n = merge.proposals(classes).count()
    classes.unpersist()
    print(f"{n} proposal(s) and {len(rows)} answer(s) were applied.")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabdelta")
    commands = parser.add_subparsers(required=True)
    one = commands.add_parser("compare")
    one.add_argument("old")
    one.add_argument("new")
    one.add_argument("--key", action="append")
    one.add_argument("--json", action="store_true")
    one.set_defaults(run=compare)
    two = commands.add_parser("merge")
    for name in ("base", "a", "b"):
        two.add_argument(name)
    two.add_argument("--key", action="append", required=True)
    two.add_argument("--resolve", action="append", default=[])
    two.add_argument("--out", required=True)
    two.set_defaults(run=run_merge)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tabdelta").getOrCreate()
    try:
        return args.run(spark, args)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    except TabDeltaError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
