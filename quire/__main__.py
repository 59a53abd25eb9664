"""python -m quire: ingest, tree, map, search, find, chapter, stats, list, ask."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quire.plans.ask import ask
from quire.plans.deciders import decider
from quire.plans.store import Store
from quire.sources.config import Settings, load_settings


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quire")
    parser.add_argument("--config")
    parser.add_argument("--store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, args in {"ingest": ["folder"], "list": [], "stats": ["doc"], "tree": ["doc"], "map": ["doc"], "search": ["doc", "keywords"], "find": ["doc", "keywords"], "chapter": ["chapter"], "ask": ["doc", "question"]}.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a, type=int if a in ("doc", "chapter") else str)
    a = parser.parse_args(argv)
    settings = load_settings(a.config)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    store = Store(spark, a.store or settings.store)
    try:
        run(store, settings, a)
    except LookupError as e:  # no such document or chapter
        raise SystemExit(str(e)) from e


def run(store: Store, settings: Settings, a: argparse.Namespace) -> None:
    if a.command == "ask":
        trace = ask(store, a.doc, a.question, rounds=settings.rounds)
        print(json.dumps({"steps": trace.steps, "answer": trace.answer}, ensure_ascii=False))
        return
    found = {
        "ingest": lambda: store.add_folder(a.folder, decider(settings)), "list": store.listing, "stats": lambda: store.stats(a.doc), "tree": lambda: store.tree(a.doc).select("line"), "map": lambda: store.map(a.doc),
        "search": lambda: store.search(a.doc, a.keywords, top_k=settings.top_k), "find": lambda: store.find(a.doc, a.keywords), "chapter": lambda: store.page(a.chapter, settings.max_chars),
    }[a.command]()
    for row in found.toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
