"""The library from a shell: ``python -m curatrix names FOLDER`` and so on.

Every command only plans and reports, unless it is told to apply. Collections are never written back:
``relink`` and ``merge`` write their new tables as Parquet.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from curatrix.functions import text as t
from curatrix.lineage import drop_intermediate, materialize
from curatrix.operators import codec, collection, dedup, health, naming
from curatrix.sources import actions, database, files, library, mapping, settings, sinks


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="curatrix", description=__doc__.splitlines()[0])
    commands = main.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, folder: bool = True) -> argparse.ArgumentParser:
        out = commands.add_parser(name, help=about, description=about)
        if folder:
            out.add_argument("folder")
        return out

    names = command("names", "Plan canonical names of a folder's files, and rename them.")
    names.add_argument("--apply", action="store_true", help="rename, and write a rollback table")
    names.add_argument("--source", choices=["tags", "filename"], default="tags")
    names.add_argument("--no-alphabetical", action="store_true", help="keep the order of artists")
    names.add_argument("--drop-mix", action="store_true", help="leave out a mix that only the name has")
    names.add_argument("--plan", help="where the plan goes (default: rename_plan.csv in the folder)")
    tags = command("tags", "Write artist and title of names into the files.")
    tags.add_argument("--dry-run", action="store_true", help="only count what would be done")
    tags.add_argument("--recursive", action="store_true")
    dups = command("duplicates", "Report duplicate files, and move or delete the extra copies.")
    dups.add_argument("--recursive", action="store_true")
    dups.add_argument("--mode", choices=["exact", "song", "both"], default="both")
    dups.add_argument("--report", help="where the report goes (default: duplicates_report.csv in the folder)")
    dups.add_argument("--move", metavar="FOLDER", help="move extra copies there")
    dups.add_argument("--delete", action="store_true", help="delete extra copies")
    for name, about in (("relink", "Point a collection's entries at renamed files."), ("merge", "Merge a collection's duplicate entries.")):
        sub = command(name, about, folder=False)
        sub.add_argument("--db", required=True, help="the collection's database")
        sub.add_argument("--folder", default="", help="only entries whose path contains this")
        sub.add_argument("--out", help="write the new tables there")
        sub.add_argument("--backup-dir", help="copy the database there first")
        if name == "relink":
            sub.add_argument("--map", required=True, help="a plan or rollback table of ``names``")
            sub.add_argument("--set-title", action="store_true")
        else:
            sub.add_argument("--report", help="where the report goes")
    scan = command("health", "Score a folder and its collection, and list issues.")
    scan.add_argument("--settings", help="an application's settings file")
    return main


def _names(spark: SparkSession, a: argparse.Namespace) -> dict:
    options = naming.Options(a.source, not a.no_alphabetical, not a.drop_mix)
    tags = files.tag_table(spark, a.folder) if a.source == "tags" else None
    plan = materialize(naming.plan_names(files.list_files(spark, a.folder, extensions=t.NAME_EXTENSIONS), tags, options), "plan")
    out = naming.plan_counts(plan).first().asDict() | {"plan": a.plan or f"{a.folder}/rename_plan.csv"}
    sinks.write_single(sinks.plan_rows(plan), out["plan"])
    if a.apply:
        made = actions.rename_all(spark, a.folder, naming.rename_map(plan))
        rollback = f"{a.folder}/rename_rollback.csv"
        done = spark.createDataFrame(made.done, "old string, new string")
        sinks.write_single(sinks.rollback_rows(done), rollback)
        out |= {"renamed": len(made.done), "skipped": len(made.skipped), "rollback": rollback}
    return out


def _tags(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.dry_run:
        found = files.list_files(spark, a.folder, a.recursive, extensions=t.FILE_EXTENSIONS)
        rows = found.select(codec.predicted_status(F.col("name")).alias("status"))
    else:
        found = files.list_files(spark, a.folder, a.recursive, extensions=t.FILE_EXTENSIONS, content=True)
        rows = materialize(actions.write_contents(codec.tag_files(found)), "statuses")  # written once
    return {r["status"]: r["n"] for r in codec.tally(rows).collect()}


def _duplicates(spark: SparkSession, a: argparse.Namespace) -> dict:
    rows = materialize(dedup.duplicates(dedup.with_hashes(files.scan(spark, a.folder, a.recursive)), a.mode), "duplicates")
    out = dedup.summary(rows).first().asDict() | {"report": a.report or f"{a.folder}/duplicates_report.csv"}
    sinks.write_single(dedup.report(rows), out["report"])
    extras = rows.where("role <> 'keep'").select("ord", "path").distinct()
    if a.move:
        actions.Folder(spark, a.move).make()
        occupied = files.all_files(spark, a.move).select(t.split_path(F.col("path"))[1].alias("name"))
        out["moved"] = actions.move_all(spark, materialize(dedup.move_plan(extras, occupied), "moves"), a.move)
    elif a.delete:
        out["deleted"] = actions.delete_all(spark, extras)
    return out


def _collection(spark: SparkSession, a: argparse.Namespace) -> dict:
    out: dict = {"backup": actions.backup(spark, a.db, a.backup_dir)} if a.backup_dir else {}
    tables = database.read_collection(spark, a.db)
    if a.command == "relink":
        plan = materialize(collection.relink_plan(tables["content"], mapping.load_mapping(spark, a.map), a.folder), "plan")
        artists = collection.with_artists(tables["artists"], plan)
        there = files.existing(plan.select(F.col("new_path").alias("path")).distinct())
        new = {"content": collection.apply_relink(tables["content"], plan, a.set_title, True, there, artists), "artists": artists}
        out["entries"] = plan.count()
    else:
        groups = materialize(collection.duplicates(collection.load_entries(tables["content"], tables["cues"], tables["playlists"], a.folder)), "groups")
        new = collection.merge(groups, tables["content"], tables["cues"], tables["playlists"])
        out |= dedup.summary(groups).first().asDict()
        if a.report:
            sinks.write_single(collection.report(groups), a.report)
    for name, df in new.items() if a.out else ():
        df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    return out


def _health(spark: SparkSession, a: argparse.Namespace) -> dict:
    found = library.health_scan(spark, a.folder, settings.load_settings(a.settings) if a.settings else settings.Settings())
    row = found.report.first()
    issues = [f"{r['severity']}: {r['code']} ({r['count']})" for r in found.issues.orderBy("place").collect()]
    return {"score": row["score"], "label": row["label"], "files": found.audio_files} | {c: row[c] for c in health.COUNTS} | {"issues": "; ".join(issues)}


COMMANDS = {"names": _names, "tags": _tags, "duplicates": _duplicates, "relink": _collection, "merge": _collection, "health": _health}


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run a command; what it prints is what it returns."""
    a = parser().parse_args(arguments)
    own = spark is None
    spark = spark or SparkSession.builder.appName("curatrix").getOrCreate()
    try:
        out = COMMANDS[a.command](spark, a)
    finally:
        if own:
            drop_intermediate(spark)
    for name, value in out.items():
        print(f"{name}: {value}")
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
