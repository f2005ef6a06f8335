"""Command line over a stored index: ``python -m quarrytext.cli COMMAND INDEX ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrytext.functions import grams as G
from quarrytext.functions import output
from quarrytext.operators import maintain, search, stats
from quarrytext.operators.index import Index, current_version, vacuum
from quarrytext.sources.files import file_states, read_files
from quarrytext.sources.tables import written

#: Exit codes.
NOTHING, MISSING, STALE, USAGE, NO_GROUP, NO_INDEX = 1, 2, 3, 1, 5, 6


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrytext")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *args, help=""):
        made = sub.add_parser(name, help=help)
        for arg, options in args:
            made.add_argument(*(arg if isinstance(arg, tuple) else (arg,)), **options)
        return made

    flag = {"action": "store_true"}
    index = ("index", {})
    command("create", index, help="write an empty index if there is none")
    command("input", ("--org", flag), index, ("files", {"nargs": "+"}), help="index files whose time changed")
    command("chunk", ("--data", {"default": ""}), ("--dx", flag), ("--delimiter", {"default": ","}), ("--gx", flag), index, ("group", {}), ("grams", {}), help="append a chunk with given grams")
    command("data", ("--dx", flag), index, ("group", {}), help="print the data of a group's chunks")
    command("delete", index, ("group", {}), help="mark a group as deleted")
    command("empty", index, ("groups", {"nargs": "+"}), help="make groups without chunks")
    command("compact", index, help="remove what is deleted, and all older versions")
    command("files", index, help="print the names of all groups, in order whatever the case")
    command("update", (("-t", "--test"), flag), index, help="index changed files again, delete missing ones")
    command("grams", ("--gx", flag), ("--partial", flag), ("phrase", {}), help="print the grams of a phrase")
    command("info", ("--grams", flag), ("--groups", flag), ("--chunks", flag), index, ("group", {"nargs": "?"}), help="print statistics")
    command(
        "search",
        ("--partial", flag), ("--fuzzy", {"type": float, "default": 0.0}), ("--sort", flag), ("--candidates", flag), ("--grams", flag), ("--gx", flag), ("--gd", flag), ("--file", flag),
        ("--filter", {"default": None}), ("--limit", {"type": int, "default": None}), (("-n", "--numbers"), flag), ("--sexp", flag), ("--json", flag), ("--format", {"default": None}),
        ("--start-format", {"default": ""}), ("--end-format", {"default": ""}), (("-f", "--force"), flag), (("-u", "--update"), flag), ("--dx", flag), index, ("terms", {"nargs": "+"}),
        help="search",
    )
    return top


def _states(spark: SparkSession, index: Index):
    """``(group_name, last_changed)`` of the indexed files that are still there, from one listing of their
    folders; only the folders' names come to the driver, and no contents are read."""
    files = index.groups.filter("last_changed IS NOT NULL").select("group_name").distinct()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = [r[0] for r in files.select(F.regexp_replace("group_name", "/[^/]*$", "").alias("folder")).distinct().collect()]
    paths = [(f or "/", jvm.org.apache.hadoop.fs.Path(f or "/")) for f in folders]
    present = [f for f, p in paths if p.getFileSystem(conf).exists(p)]
    if not present:
        return spark.createDataFrame([], "group_name string, last_changed timestamp")
    return file_states(spark, *present).join(files, "group_name", "left_semi")


def _update(spark: SparkSession, index: Index) -> Index:
    """Carry out the update plan; only files that changed are read."""
    states = written(_states(spark, index), "states")
    changed = [r[0] for r in maintain.update_plan(index.groups, states).filter("action = 'input'").select("group_name").distinct().collect()]
    texts = states.withColumn("text", F.lit(None).cast("string"))
    if changed:
        read = read_files(spark, *changed).select("group_name", F.col("text").alias("read"))
        texts = states.join(read, "group_name", "left").withColumnRenamed("read", "text")
    return maintain.update(index, texts)


def run(spark: SparkSession, argv: list[str], out=sys.stdout) -> int:
    options = parser().parse_args(argv)
    say = lambda text="": print(text, file=out)
    if options.command == "grams":
        found = G.query_grams([options.phrase], options.partial)
        say(" ".join(f"{G.code_of(g):04x}" if options.gx else g for g in found))
        return 0
    if options.command == "create":
        Index.open_or_create(spark, options.index)
        return 0
    if current_version(spark, options.index) is None and options.command not in ("input", "chunk", "empty"):
        print(f"no index at {options.index}", file=sys.stderr)
        return NO_INDEX
    index = Index.open_or_create(spark, options.index)
    if options.command == "input":
        maintain.put(index, read_files(spark, *options.files), "org" if options.org else "lines").save(options.index)
    elif options.command == "chunk":
        grams = [options.grams[k : k + 4] for k in range(0, len(options.grams), 4)] if options.gx else options.grams.split(options.delimiter)
        data = bytes.fromhex(options.data) if options.dx else options.data.encode()
        maintain.add_chunk(index, options.group, grams, data, "hex" if options.gx else "text").save(options.index)
    elif options.command == "data":
        for row in maintain.chunk_data(index, options.group).orderBy("chunk_no").collect():
            data = bytes(row["data"] or b"")
            say(data.hex() if options.dx else data.decode("utf-8", "replace"))
    elif options.command == "delete":
        maintain.delete(index, F.col("group_name") == options.group).save(options.index)
    elif options.command == "empty":
        maintain.add_empty(index, spark.createDataFrame([(g,) for g in options.groups], "group_name string")).save(options.index)
    elif options.command == "compact":
        maintain.compact(index).save(options.index)
        vacuum(spark, options.index)
    elif options.command == "update":
        if options.test:
            for row in maintain.update_plan(index.groups, _states(spark, index)).orderBy("action", "group_name").collect():
                say(f"{row['action']} {row['group_name']}")
        else:
            _update(spark, index).save(options.index)
    elif options.command == "files":
        for row in stats.file_list(index).collect():
            say(row["group_name"])
    elif options.command == "info":
        return _info(spark, index, options, say)
    elif options.command == "search":
        return _search(spark, index, options, out)
    return 0


def _info(spark, index, options, say) -> int:
    if options.group:
        try:
            row = stats.group_info(index, options.group).first()
        except KeyError:
            return NO_GROUP
        say(f"{row['group_name']}: {row['chunk_count']} chunks" + (" org-mode" if row["org"] else ""))
        for c in stats.group_chunks(index, options.group).orderBy("line").collect() if options.chunks else []:
            say(f"{c['line']}:{c['position']}:{c['offset']}:{c['length']}: {c['text']}")
    elif options.grams:
        for row in stats.coverage(index).orderBy(F.desc("threshold")).collect():
            say(f"{row['threshold'] * 100:g}%: {row['grams']}")
        say(str(stats.posting_sizes(index).first().asDict()))
    elif options.groups:
        for row in stats.group_status(index, _states(spark, index)).orderBy("group_name").collect():
            say(" ".join(x for x in (row["group_name"], "org-mode" if row["org"] else "", row["status"]) if x))
    else:
        states = _states(spark, index)
        for name, value in stats.totals(index, states).first().asDict().items():
            say(f"{name}: {value}")
        for row in stats.stale_groups(index, states).orderBy("group_name").collect():
            print(row["group_name"], file=sys.stderr)
    return 0


def _search(spark, index, options, out) -> int:
    if options.fuzzy and options.file:
        print("fuzzy and file searches do not go together", file=sys.stderr)
        return USAGE
    if options.update:
        _update(spark, index).save(options.index)
        index = Index.load(spark, options.index)
    try:
        index = search.fresh(index, _states(spark, index), "skip" if options.force else "error")
    except search.MissingGroupError as error:
        print(f"missing: {error}", file=sys.stderr)
        return MISSING
    except search.StaleGroupError as error:
        print(f"changed: {error}", file=sys.stderr)
        return STALE
    order = "start"
    if options.candidates:
        form = "hex" if options.gx else "decimal" if options.gd else "text"
        grams = [G.parse_gram(t, form) for t in options.terms] if options.grams else None
        found = search.candidates(index, None if grams is not None else options.terms, grams, options.partial, options.filter)
        data = F.lower(F.hex("data")) if options.dx else F.col("data").cast("string")
        found = found.select("group_name", F.col("n").alias("line"), "start", F.lit(0).cast("bigint").alias("offset"), F.lit(0.0).alias("percent"), F.coalesce("text", data, F.lit("")).alias("text"))
    elif options.fuzzy:
        found = search.fuzzy(index, options.terms, options.fuzzy, options.filter)
        order = "worst" if options.sort else "match"
    elif options.file:
        found = search.file_search(index, options.terms, options.partial)
    else:
        found = search.search(index, options.terms, options.partial, options.filter, options.limit)
    if options.numbers:
        shown = output.numbers(found)
    elif options.json:
        shown = output.as_json(found)
    else:
        template = options.format or (output.SEXP if options.sexp else output.FUZZY_LINE if options.fuzzy else output.LINE)
        shown = output.formatted(found, template)
    plain = order == "worst"
    rows = search.ordered(shown, order).select("group_name", "output").collect()
    out.write(output.printed(rows, "" if plain else options.start_format, "" if plain else options.end_format))
    return 0 if rows else NOTHING


def main() -> None:
    spark = SparkSession.builder.appName("quarrytext").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
