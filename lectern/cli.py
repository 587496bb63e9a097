"""Command line over a store: init, import, add, list, search, read, delete, repair-chapters."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern import cluster, schema
from lectern.functions import text as X
from lectern.operators import catalog, reader, repair, search, shelf
from lectern.sources import epub, files
from lectern.store import Store

SAMPLES = 20


def tables(store: Store):
    return store.table("segments"), store.table("editions"), store.table("works")


def run_init(store, args, out):
    out(f"version {store.init()}")


def run_import(store, args, out):
    out(f"{catalog.import_works(store, args.csv)} works added")


def run_add(store, args, out):
    out(f"edition {catalog.add_edition(store, args.files, args.file, args.work, args.lang, args.notes, encoding=args.encoding)}")


def run_list(store, args, out):
    for r in shelf.shelf(store.table("works"), store.table("editions")).select("id", "year", "title_zh", "edition_count", "indexed_count").toLocalIterator():
        out(f"{r.id}\t{r.year or '-'}\t{r.title_zh}\t{r.indexed_count}/{r.edition_count}")


def run_search(store, args, out):
    rows = search.search(*tables(store), args.query, args.lang, args.genre, args.limit)
    rows = rows.select("title_zh", X.language_label(F.col("language")).alias("lang"), X.locator(F.col("page"), F.col("chapter"), F.col("seq")).alias("place"), X.kwic(F.col("content"), args.query, args.width).alias("kwic")).collect()
    for r in rows:
        for k in r.kwic:
            out(f"{r.title_zh} [{r.lang}] {r.place}: {k.left}[{k.match}]{k.right}")
    out(f"{len(rows)} hits")


def run_read(store, args, out):
    page = reader.read(*tables(store), args.edition, args.segment)
    out(f"{page.edition['title_zh']} / {page.current['title']} (before: {page.current['previous_id']}, after: {page.current['next_id']})")
    for r in page.segments.select("content").toLocalIterator():
        out(r.content)


def run_delete(store, args, out):
    for k, v in catalog.delete_edition(store, args.files, args.work, args.edition).items():
        out(f"{k}: {v}")


def run_repair(store, args, out):
    edition = store.table("editions").where(F.col("id") == args.edition).first()
    if edition is None:
        raise schema.EditionMissing(f"no edition {args.edition}")
    source = catalog.safe_file(args.files, edition["filename"] or "")
    if edition["format"] != "epub" or not source.exists():
        raise schema.CorpusError("chapters are repaired from an EPUB file that is there")
    raw = source.read_bytes()
    parsed = [(n, c, t) for n, c, _, t in epub.epub_segments(raw)]
    report = repair.repair_edition(store, args.edition, parsed, epub.read_documents(raw), args.apply)
    out(f"stored {report.db_count}, parsed {report.parsed_count}, matched {report.matched_count}, old titles {len(report.legacy_titles)}, changes {len(report.changes)}")
    for (old, new), n in sorted(report.mappings.items(), key=str):
        out(f"{old or '(none)'} -> {new or '(none)'}: {n}")
    for line in report.issues[:SAMPLES]:
        out(f"issue: {line}")
    out("applied" if args.apply else "nothing written; use --apply")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("--store", default=os.environ.get("LECTERN_STORE", "data/store"))
    p.add_argument("--files", default=os.environ.get("LECTERN_FILES", "data/files"))
    sub = p.add_subparsers(required=True)

    def command(name, run, *options):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for flags, kw in options:
            s.add_argument(*flags, **kw)

    lang = (["--lang"], {"choices": schema.LANGUAGES})
    command("init", run_init)
    command("import", run_import, (["csv"], {}))
    command("add", run_add, (["file"], {}), (["--work"], {"type": int, "required": True}), (["--lang"], {"choices": schema.LANGUAGES, "required": True}), (["--notes"], {}), (["--encoding"], {}))
    command("list", run_list)
    command("search", run_search, (["query"], {}), lang, (["--genre"], {}), (["--limit"], {"type": int, "default": 50}), (["--width"], {"type": int, "default": 30}))
    command("read", run_read, (["edition"], {"type": int}), (["--segment"], {"type": int}))
    command("delete", run_delete, (["work"], {"type": int}), (["edition"], {"type": int}))
    command("repair-chapters", run_repair, (["edition"], {"type": int}), (["--apply"], {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lectern").getOrCreate()
    cluster.ship(spark)
    try:
        args.run(Store(spark, args.store if "://" in args.store else str(Path(args.store).resolve())), args, out)
    except (schema.CorpusError, ValueError) as e:
        out(f"error: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
