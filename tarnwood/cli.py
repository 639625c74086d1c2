"""Command line: index a file, search an index, list indexes."""

from __future__ import annotations

import argparse
import json
import os
from pathlib import Path

from pyspark.sql import SparkSession

from .search import Search, tool_functions, write_result
from .sources.loaders import load


def user_root() -> Path:
    return Path(os.environ.get("TARNWOOD_HOME", Path.home() / ".tarnwood")) / "indexes"


def list_indexes(root: Path | None = None) -> list[str]:
    """Names of saved indexes, sorted."""
    root = root or user_root()
    return sorted(p.name for p in root.iterdir() if (p / "params").is_dir()) if root.is_dir() else []


def choose_index(names: list[str], ask=input) -> str:
    """By number from 1 or by name."""
    for i, n in enumerate(names, 1):
        print(f"{i}. {n}")
    said = ask("index: ").strip()
    if said.isdigit() and 1 <= int(said) <= len(names):
        return names[int(said) - 1]
    if said in names:
        return said
    raise ValueError(f"no index {said!r}")


def clip(text: str, width: int = 200) -> str:
    return text if len(text) <= width else text[:width] + "..."


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnwood")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index a .txt, .json, .jsonl, .csv or .parquet file")
    i.add_argument("file")
    i.add_argument("-o", "--output")
    i.add_argument("-c", "--column")
    i.add_argument("-u", "--user", action="store_true", help="keep it in the user's folder")
    s = sub.add_parser("search", help="search an index")
    s.add_argument("query")
    s.add_argument("-i", "--index")
    s.add_argument("-k", type=int, default=10)
    s.add_argument("-s", "--save")
    s.add_argument("-u", "--user", action="store_true")
    t = sub.add_parser("tool", help="answer JSON lines {query, k} from standard input")
    t.add_argument("-d", "--dir", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tarnwood").getOrCreate()
    if args.command == "index":
        name = args.output or Path(args.file).stem + "_index"
        at = str(user_root() / name) if args.user else name
        engine = Search(spark, load(spark, args.file, args.column))
        engine.save(at)
        print(f"indexed {engine.index.n_docs} documents into {at}")
        return 0
    if args.command == "tool":
        import sys

        tools = tool_functions(spark, args.dir)
        for line in sys.stdin:
            asked = json.loads(line)
            print(json.dumps(tools["retrieve"](asked["query"], asked.get("k", 10))), flush=True)
        return 0
    at = args.index
    if args.user:
        at = str(user_root() / (at or choose_index(list_indexes())))
    if not at:
        raise SystemExit("give an index with -i, or -u")
    engine = Search.open(spark, at)
    hits = engine.search([args.query], args.k)[0]
    for rank, h in enumerate(hits, 1):
        print(f"{rank}. {h['score']:.4f} {clip(str(h['document'].get('text', h['document'])))}")
    if args.save:
        write_result(args.save, args.query, hits, engine.index.n_docs)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
