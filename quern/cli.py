"""Command line: doctor, collection, index, search, get, status, calibrate; a thin wrapper around plans.index."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession


def doctor() -> tuple[list[dict], bool]:
    """Checks of this machine: name, ok, detail, hard. The second value is False if a hard one failed."""
    import importlib.util
    import shutil

    out = [{"name": "python", "ok": sys.version_info >= (3, 10), "detail": sys.version.split()[0], "hard": True}]
    for module, hard in (("pyspark", True), ("pyarrow", True), ("pandas", True), ("numpy", True), ("onnxruntime", False)):
        out.append({"name": module, "ok": importlib.util.find_spec(module) is not None, "detail": module, "hard": hard})
    java = shutil.which("java") or os.environ.get("JAVA_HOME")
    out.append({"name": "java", "ok": bool(java), "detail": java or "not found", "hard": True})
    return out, all(x["ok"] for x in out if x["hard"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description=__doc__)
    p.add_argument("--root", default=os.environ.get("QUERN_ROOT", os.path.expanduser("~/.local/share/quern")))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor").add_argument("--json", action="store_true")
    c = sub.add_parser("collection").add_subparsers(dest="action", required=True)
    add = c.add_parser("add")
    add.add_argument("path")
    add.add_argument("--name", required=True)
    add.add_argument("--glob", action="append")
    c.add_parser("list")
    c.add_parser("remove").add_argument("name")
    i = sub.add_parser("index")
    i.add_argument("-c", "--collection", action="append")
    i.add_argument("--no-calibrate", action="store_true")
    i.add_argument("--recalibrate-after", type=float, default=0.1)
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-c", "--collection", action="append", default=[])
    s.add_argument("-n", "--limit", type=int, default=10)
    s.add_argument("--mode", choices=("hybrid", "lexical", "vector"), default="hybrid")
    s.add_argument("--json", action="store_true")
    s.add_argument("--files", action="store_true")
    s.add_argument("--min-score", type=float)
    s.add_argument("--truncate", default="off")
    g = sub.add_parser("get")
    g.add_argument("target")
    g.add_argument("--head", action="store_true")
    sub.add_parser("status")
    k = sub.add_parser("calibrate")
    k.add_argument("--sample", type=int, default=200)
    k.add_argument("--target", type=float, default=0.85)
    k.add_argument("--reject", type=float, default=0.9)
    k.add_argument("--seed", type=int, default=0)
    k.add_argument("--store", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "doctor":
        checks, good = doctor()
        print(json.dumps({"checks": checks, "ok": good}) if a.json else "\n".join(f"{'ok' if x['ok'] else 'missing'}  {x['name']}  {x['detail']}" for x in checks))
        return 0 if good else 1
    from quern.plans.index import Index
    from quern.sources.files import GLOBS, paths_sink, text_sink

    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    index = Index(spark, a.root)
    if a.command == "collection":
        if a.action == "add":
            index.add_collection(a.name, a.path, a.glob or GLOBS)
        elif a.action == "remove":
            index.remove_collection(a.name)
        else:
            for r in index.collections().toLocalIterator():
                print(f"{r['name']}  {r['documents']}  {r['root']}  {','.join(r['globs'])}")
    elif a.command == "index":
        print(json.dumps(index.index(a.collection, not a.no_calibrate, a.recalibrate_after)))
    elif a.command == "search":
        request = spark.createDataFrame([("q", a.query, a.mode, a.collection, a.limit, a.min_score, a.truncate)], "qid string, query string, mode string, collections array<string>, limit int, min_score double, truncate string")
        if a.json:
            print(index.engine().envelopes(request).first()["envelope"])
        else:
            results = index.engine().search(request)
            for r in (paths_sink(results) if a.files else text_sink(results)).toLocalIterator():
                print(r["value"])
    elif a.command == "get":
        row = index.engine().get(a.target, a.head).orderBy("doc_id").first()
        if row is None:
            print(f"not found: {a.target}", file=sys.stderr)
            return 1
        print(row["body"])
    elif a.command == "status":
        for r in index.engine().status().toLocalIterator():
            print(f"{r['name']}  {r['value']}")
    else:
        report = index.engine().calibrate(a.sample, 100, a.seed, a.target, a.reject).first().asDict(recursive=True)
        if a.store:
            index.store.set_meta(truncate_floor=str(report["floor"]))
        print(json.dumps(report))
    return 0


if __name__ == "__main__":
    sys.exit(main())
