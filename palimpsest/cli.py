"""Command line: ingest, search, stats, mcp, acp, serve, compress, decompress, bench. Settings come from config.load."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path
from typing import IO

from . import config
from .archive import Archives, hits_json, hits_text, stats_text, totals
from .errors import PalimpsestError, ScopeError
from .plans.query import Flags
from .wire import to_toon
from .zstd_file import compress, decompress


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="palimpsest", description="A personal archive of account-data exports")
    commands = top.add_subparsers(dest="command", required=True)

    def scoped(p: argparse.ArgumentParser) -> None:
        p.add_argument("--service")
        p.add_argument("--account")

    p = commands.add_parser("ingest", help="add exports to archives; without inputs, all below the home folder")
    p.add_argument("-o", "--output", help="folder of the archives")
    scoped(p)
    p.add_argument("inputs", nargs="*")
    p = commands.add_parser("search", help="search all archives, or one")
    p.add_argument("-i", "--ignore-case", action="store_true", default=None)
    p.add_argument("-F", "--fixed-strings", action="store_true", default=None)
    p.add_argument("-w", "--word-regexp", action="store_true", default=None)
    p.add_argument("-m", "--max-count", type=int)
    p.add_argument("--format", choices=("human", "json", "toon"))
    scoped(p)
    p.add_argument("pattern")
    p.add_argument("archive", nargs="?", help="service/account; goes before --service and --account")
    p = commands.add_parser("stats", help="counts of one archive, or of all")
    p.add_argument("--format", choices=("human", "json"))
    scoped(p)
    p.add_argument("archive", nargs="?")
    for name in ("mcp", "acp"):
        p = commands.add_parser(name, help="answer requests on standard input")
        p.add_argument("--toon", action="store_true")
    p = commands.add_parser("serve", help="answer requests over HTTP")
    p.add_argument("--bind")
    p = commands.add_parser("compress")
    p.add_argument("--level", type=int)
    p.add_argument("files", nargs="+")
    p = commands.add_parser("decompress")
    p.add_argument("files", nargs="+")
    p = commands.add_parser("bench", help="sizes and times of files at every level")
    p.add_argument("folder")
    p.add_argument("--jsonl")
    p.add_argument("--report")
    return top


def _passed(a: argparse.Namespace) -> dict:
    """What was given on the command line, nested as the settings are."""
    out: dict = {"scope": {k: v for k in ("service", "account") if (v := getattr(a, k, None)) is not None}}
    if a.command == "search":
        out["search"] = {k: v for k in ("ignore_case", "fixed_strings", "word_regexp", "max_count", "format", "archive") if (v := getattr(a, k)) is not None}
    if a.command == "stats" and a.archive is not None:
        out["stats"] = {"archive": a.archive}
    if a.command == "serve" and a.bind is not None:
        out["serve"] = {"bind": a.bind}
    if a.command == "compress" and a.level is not None:
        out["compress"] = {"level": a.level}
    if a.command == "ingest":
        out |= {"ingest": {"inputs": a.inputs}} if a.inputs else {}
        out |= {"archive_dir": a.output} if a.output else {}
    return out


def scope_of(archive: str | None, scope: dict) -> tuple[str | None, str | None]:
    """An archive that is named goes before a service and account, these before all archives; half of the two is an error."""
    if archive:
        parts = archive.strip("/").split("/")
        if len(parts) != 2:
            raise ScopeError(f"{archive}: not service/account")
        return parts[0].removeprefix("service="), parts[1].removeprefix("account=")
    if (scope["service"] is None) != (scope["account"] is None):
        raise ScopeError("service and account are given together or not at all")
    return scope["service"], scope["account"]


def bench(folder: str, levels: range = range(1, 23)) -> list[dict]:
    """Size, ratio and times of each file at each level."""
    import zstandard

    rows = []
    for path in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
        data = path.read_bytes()
        for level in levels:
            t = time.perf_counter()
            small = zstandard.ZstdCompressor(level=level).compress(data)
            u = time.perf_counter()
            zstandard.ZstdDecompressor().decompress(small)
            rows.append({"file": str(path), "level": level, "bytes": len(small), "ratio": round(len(data) / max(1, len(small)), 3), "compress_ms": round(1000 * (u - t), 2), "decompress_ms": round(1000 * (time.perf_counter() - u), 2)})
    return rows


def run(args: list[str], spark=None, out: IO[str] | None = None, source: IO[str] | None = None, env: dict[str, str] | None = None) -> int:
    """One command. Errors go to standard error with exit code 1; a session is only started for commands that need it."""
    out, a = out or sys.stdout, parser().parse_args(args)
    try:
        settings = config.load(_passed(a), env)
        if a.command in ("compress", "decompress"):
            for f in a.files:
                print(compress(f, settings["compress"]["level"]) if a.command == "compress" else decompress(f), file=out)
            return 0
        if a.command == "bench":
            rows = bench(a.folder)
            if a.jsonl:
                Path(a.jsonl).write_text("".join(json.dumps(r) + "\n" for r in rows))
            table = "\n".join(["| " + " | ".join(rows[0]) + " |", "|" + "-|" * len(rows[0]), *("| " + " | ".join(map(str, r.values())) + " |" for r in rows)]) if rows else ""
            print(table, file=Path(a.report).open("w") if a.report else out)
            return 0
        return _with_archives(a, settings, spark, out, source)
    except (PalimpsestError, OSError) as e:
        print(f"palimpsest: {e}", file=sys.stderr)
        return 1


def _with_archives(a: argparse.Namespace, settings: dict, spark, out: IO[str], source: IO[str] | None) -> int:
    from . import rpc

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("palimpsest").getOrCreate()
    archives = Archives(spark, settings["archive_dir"], level=settings["compress"]["level"], skips=tuple(settings["scan"]["skip_directories"]))
    scope = settings["scope"]
    if a.command == "ingest":
        inputs = settings["ingest"]["inputs"]
        if inputs:
            reports = [archives.ingest(*inputs, service=scope["service"], account=scope["account"])]
        elif a.output or scope["service"] or scope["account"]:
            raise ScopeError("an output, service or account needs inputs")
        else:
            reports = archives.ingest_home(str(Path.home()), settings["scan"]["home_scan_max_depth"])
        for r in reports:
            print(f"{r['output']}: {r['exports']} exports, {r['conversations']} conversations", file=out)
        if len(reports) != 1:
            print(json.dumps(totals(reports)), file=out)
    elif a.command == "search":
        s = settings["search"]
        service, account = scope_of(s["archive"], scope)
        flags = Flags(ignore_case=s["ignore_case"], fixed=s["fixed_strings"], word=s["word_regexp"])
        shown = archives.search(a.pattern, flags, s["max_count"], service, account)
        if s["format"] == "human":
            n = archives.group_count(a.pattern, flags, service, account) if s["max_count"] else 0
            print(hits_text(shown, f"{service}/{account}" if service else None, max(0, n - s["max_count"]), archives.omitted(a.pattern, flags, service, account)), file=out)
        else:
            text = hits_json(shown)
            print(text if s["format"] == "json" else to_toon(json.loads(text)), file=out)
    elif a.command == "stats":
        service, account = scope_of(settings["stats"]["archive"], scope)
        rows = [r.asDict(recursive=True) for r in archives.stats(service, account).collect()]
        print(json.dumps(rows) if a.format == "json" else stats_text(rows), file=out)
    elif a.command == "serve":
        rpc.http_server(archives, settings["serve"]["bind"]).serve_forever()
    else:
        rpc.serve_lines(archives, source or sys.stdin, out, "tools" if a.command == "mcp" else "plain", toon=a.toon)
    return 0
