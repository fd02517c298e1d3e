"""Command line: ``index``, ``search`` and ``show``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from . import __version__
from .config import DEFAULT_MODEL_REPO, ENV_PREFIX, Config, env_list, env_value
from .operators.documents import SEPARATOR
from .plans.engine import SearchEngine
from .session import drop_tables, ship_package
from .sources.sinks import to_json, to_text


def _colon_list(value: str) -> list[str]:
    return value.split(":")


def _count(value: str) -> int:
    number = int(value)
    if number < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return number


def _global_flags(defaults: bool) -> argparse.ArgumentParser:
    """Flags accepted before and after the command; only one place sets defaults."""

    def default(value):
        return value if defaults else argparse.SUPPRESS

    flags = argparse.ArgumentParser(add_help=False)
    flags.add_argument("-r", "--root", dest="roots", action="extend", type=_colon_list,
                       metavar="DIR", default=default(None),
                       help=f"directory to ingest; repeatable (or ${ENV_PREFIX}ROOTS)")
    flags.add_argument("--model", default=default(None), help="model repository, owner/name")
    flags.add_argument("--model-dir", default=default(None),
                       help="folder with model.onnx and tokenizer.json")
    flags.add_argument("--lexical-only", action="store_true", default=default(False))
    flags.add_argument("--cache-dir", default=default(None), help="embedding cache folder")
    flags.add_argument("--ignore", action="extend", type=_colon_list, metavar="GLOB",
                       default=default(None), help=f"repeatable (or ${ENV_PREFIX}IGNORE)")
    flags.add_argument("--per-page", type=_count, metavar="N", default=default(1),
                       help="hits per document path, 0 for every matching chunk")
    return flags


def parser() -> argparse.ArgumentParser:
    shared = _global_flags(defaults=False)
    top = argparse.ArgumentParser(
        prog="siftmark", description=__doc__, parents=[_global_flags(defaults=True)]
    )
    top.add_argument("--version", action="version", version=f"siftmark {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("index", parents=[shared], help="build the index and print statistics")
    search = commands.add_parser("search", parents=[shared], help="run one query")
    search.add_argument("query")
    search.add_argument("-k", "--top-k", type=_count, default=8)
    search.add_argument("--json", action="store_true")
    show = commands.add_parser("show", parents=[shared], help="print one chunk or document")
    what = show.add_mutually_exclusive_group(required=True)
    what.add_argument("--chunk", type=_count)
    what.add_argument("--path")
    return top


def config_from(args: argparse.Namespace) -> Config:
    roots = args.roots or env_list("ROOTS")
    if not roots:
        raise ValueError(f"nothing to ingest: use --root or {ENV_PREFIX}ROOTS")
    return Config(
        roots=tuple(roots),
        model_repo=args.model or env_value("MODEL") or DEFAULT_MODEL_REPO,
        model_dir=args.model_dir or env_value("MODEL_DIR"),
        lexical_only=args.lexical_only,
        cache_dir=args.cache_dir or env_value("CACHE_DIR"),
        ignore=tuple(args.ignore or env_list("IGNORE")),
        per_page=args.per_page,
    )


def run(spark: SparkSession, args: argparse.Namespace, out=None) -> None:
    out = out or sys.stdout
    cfg = config_from(args)
    if args.command == "index":
        print(to_json(SearchEngine.build(spark, cfg).stats()), file=out)
    elif args.command == "search":
        found = SearchEngine.build(spark, cfg).search(args.query, args.top_k).collect()
        if args.json or found:
            print(to_json(found) if args.json else to_text(found), file=out)
    else:
        engine = SearchEngine.build(spark, replace(cfg, lexical_only=True))
        if args.chunk is not None:
            chunk = engine.get_chunk(args.chunk)
            if chunk is None:
                raise LookupError(f"chunk {args.chunk} does not exist")
            print(to_json(chunk), file=out)
        else:
            _print_document(engine, args.path, out)


def _print_document(engine: SearchEngine, path: str, out) -> None:
    """Write the parts as they arrive; the whole document is never held."""
    written = 0
    for row in engine.document_chunks(path).select("text").toLocalIterator():
        out.write((SEPARATOR if written else "") + row.text)
        written += 1
    if not written:
        raise LookupError(f"document {path} does not exist")
    out.write("\n")


def main(argv: Sequence[str] | None = None) -> int:
    level = os.environ.get(f"{ENV_PREFIX}LOG", "info").upper()
    logging.basicConfig(stream=sys.stderr, format="%(levelname)s %(message)s")
    logging.getLogger("siftmark").setLevel(level)
    args = parser().parse_args(argv)
    try:
        config_from(args)
        spark = SparkSession.builder.appName("siftmark").getOrCreate()
        ship_package(spark)
        try:
            run(spark, args)
        finally:
            drop_tables(spark)
    except (ValueError, LookupError, OSError, RuntimeError) as err:
        print(f"error: {err}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
