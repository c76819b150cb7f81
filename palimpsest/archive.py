"""Archives: Parquet tables by service and account.

An ingest writes a version: a folder with what it adds, and a manifest. Dumps and what lies beside them (``ADDED``) are only ever added to, so
a table is what all versions have. Merged conversations, their spans and leaves (``BUCKETED``) are dealt to buckets by their ids; a version
writes those buckets whose conversations have new dumps, and its manifest tells which version holds each bucket. So the work of an ingest is that
of the dumps that it reads and the buckets that they fall in, not that of the archive.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArchiveError, BrokenInputs, NoArchives, ScopeError, SourceError
from .functions.text import path_key
from .operators import index, merkle
from .operators.merge import ITEM, STATE, merge_assets
from .operators.search import MAX_COUNT, duplicate_omitted, group_count, hits, report, suppressed_clause, unique_hits
from .operators.spans import SPANS, spans
from .operators.stats import export_labels, span_stats
from .plans.query import Flags, Query, compile_query
from .sources.discover import by_scope, check_part, discover, discover_home, infer_scope, scoped_path, without_copies, without_unpacked
from .sources import assets as asset_files
from .sources.readers import TAGGED, read_files
from .streaming.ingest import upsert

#: Tables that are added to, and tables by buckets with their columns.
ADDED = ("items", "exports", "tagged", "assets", "asset_bodies")
LEAVES = "place string, leaf string"
BUCKETED = {"conversations": STATE, "spans": SPANS, "leaves": LEAVES}
#: Fixed value: archives of another version aren't read.
VERSION = 4
#: Buckets of a new archive. One bucket is rewritten whole for one new dump in it, and is a folder of files in each of its tables.
BUCKETS = 64
TAGGED_ROW = "service string, account string, export_index int, kind string, path string, value string"
EXPORT_ROW = "service string, account string, export_index int, source_path string, id string"
ADDED_ROWS = {"items": ITEM, "exports": EXPORT_ROW, "tagged": TAGGED_ROW, "assets": asset_files.ASSET, "asset_bodies": asset_files.BODY}


class Archives:
    """All archives below a folder. An archive is a folder of versions; a file names the one that holds."""

    def __init__(self, spark: SparkSession, root: str, codec: str = "zstd", level: int = 3, skips: tuple[str, ...] = (), buckets: int = BUCKETS, part_bytes: int = asset_files.PART):
        self.spark, self.root, self.codec, self.level, self.skips, self.buckets, self.part_bytes = spark, root.rstrip("/"), codec, level, skips, buckets, part_bytes

    # ------------------------------------------------ files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _write(self, df: DataFrame, path: str, by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", self.codec).option("parquet.compression.codec.zstd.level", str(self.level))
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _text(self, path: str, text: str | None = None) -> str:
        """Reads a small file, or writes it."""
        fs, p = self._fs(path)
        if text is None:
            stream = fs.open(p)
            try:
                return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return text

    def _switch(self, at: str, version: str, before: str | None) -> None:
        """Readers see the old version or the new one: a file beside is renamed over the pointer, if that still is as it was when the ingest
        began. The version before stays for those that are reading it; older ones go."""
        jvm = self.spark.sparkContext._jvm
        now = self._text(f"{at}/CURRENT").strip() if self.exists(f"{at}/CURRENT") else None
        if now != before:
            raise ArchiveError(f"{at}: another ingest came between; this one wrote nothing")
        self._text(f"{at}/CURRENT.{version}", version)
        fs, new = self._fs(f"{at}/CURRENT.{version}")
        _, old = self._fs(f"{at}/CURRENT")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(new, old, options)
        self._clear(at, version, before)

    def _manifest(self, at: str, version: str) -> dict:
        return json.loads(self._text(f"{at}/versions/{version}/manifest.json"))

    def _clear(self, at: str, version: str, before: str | None) -> None:
        """The version two before can't be read any more: its buckets that neither of the later two has go, whichever version wrote them.
        What was added by it stays."""
        kept = [self._manifest(at, v) for v in (version, before) if v]
        old = kept[-1]["before"] if before else None
        if not old or not self.exists(f"{at}/versions/{old}/manifest.json"):
            return
        held = {(v, b) for m in kept for b, v in m["holds"].items()}
        gone = {(v, b) for b, v in self._manifest(at, old)["holds"].items()} - held
        for v, b in gone:
            for name in BUCKETED:
                self._delete(f"{at}/versions/{v}/{name}/bucket={b}")
        for v in {v for v, _ in gone} - {v for v, _ in held}:
            for name in ("index", *BUCKETED):
                self._delete(f"{at}/versions/{v}/{name}")
        for name in ("merkle", "manifest.json"):
            self._delete(f"{at}/versions/{old}/{name}")

    def table(self, at: str, name: str) -> DataFrame:
        """A table of the version that holds; its manifest is checked first."""
        return self._table(at, self._open(at), name)

    def _table(self, at: str, manifest: dict, name: str) -> DataFrame:
        if name in ADDED:
            return self.spark.read.schema(ADDED_ROWS[name]).parquet(*[f"{at}/versions/{v}/{name}" for v in manifest["versions"]])
        out = None
        for v, own in _holders(manifest["holds"]).items():
            rows = self._buckets(at, v, name, own).drop("bucket")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], BUCKETED[name]) if out is None else out

    def _buckets(self, at: str, version: str, name: str, own: list[int]) -> DataFrame:
        """Buckets that one version wrote, with their numbers: the folders of others aren't read."""
        return self.spark.read.schema(BUCKETED[name] + ", bucket int").parquet(f"{at}/versions/{version}/{name}").where(F.col("bucket").isin(own))

    def _open(self, at: str) -> dict:
        if not self.exists(f"{at}/CURRENT"):
            raise ArchiveError(f"{at}: not an archive")
        version = self._text(f"{at}/CURRENT").strip()
        try:
            manifest = self._manifest(at, version)
        except Exception as e:
            raise ArchiveError(f"{at}: no manifest: {str(e).splitlines()[0]}") from None
        if manifest.get("version") != VERSION:
            raise ArchiveError(f"{at}: version {manifest.get('version')}, not {VERSION}")
        needed = [f"{v}/{t}" for v in manifest["versions"] for t in ADDED] + [f"{v}/{t}" for v in set(manifest["holds"].values()) for t in BUCKETED]
        if missing := [t for t in needed if not self.exists(f"{at}/versions/{t}")]:
            raise ArchiveError(f"{at}: without {', '.join(missing)}")
        return manifest | {"current": version}

    # ------------------------------------------------ ingest

    def ingest(self, *paths: str, service: str | None = None, account: str | None = None, kind: str | None = None, skip_broken: bool = False) -> dict:
        """Adds exports to an archive: the new dumps are folded, in order, into the conversations of the buckets that they fall in; these
        buckets are written and indexed again, the others stay as they are. The report tells how many were written.

        Local paths are discovered first (a folder is taken for one kind of export), and copies of one export are read once.
        A broken input is an error and nothing is written, unless ``skip_broken``: then the report lists it.
        """
        if (service is None) != (account is None):
            raise ScopeError("service and account are given together or not at all")
        if not paths:
            raise SourceError("no inputs")
        local = all(os.path.exists(p.removeprefix("file://")) for p in paths)
        if local and kind is None:
            own = [p.removeprefix("file://") for p in paths]
            files = set(without_copies([p for p in own if os.path.isfile(p)]))
            paths = tuple(without_unpacked([p for p in own if not os.path.isfile(p) or p in files]))
        if service is None:
            scopes = {infer_scope(p) for p in paths}
            if len(scopes) != 1:
                raise ScopeError("inputs of several archives: " + ", ".join("/".join(s) for s in sorted(scopes)))
            service, account = scopes.pop()
        at = scoped_path(self.root, check_part(service), check_part(account))
        old = self._open(at) if self.exists(f"{at}/CURRENT") else None
        first, base, buckets, part_bytes = (old["exports"], old["next_seq"], old["buckets"], old["part_bytes"]) if old else (0, 0, self.buckets, self.part_bytes)
        version = uuid.uuid4().hex
        new = f"{at}/versions/{version}"
        try:
            rows, listed = None, None
            for k, path in enumerate(paths):
                files = [str(p) for p in discover(path, self.skips)[1]] + self._summaries(path) if local and kind is None and not os.path.isfile(path) else [path]
                own = read_files(self.spark, *files, kind=kind, work=f"{new}/work/{k}", roots=(path,)).withColumn("export_index", F.lit(first + k))
                rows = own if rows is None else rows.union(own)
                if not local or os.path.isdir(path):
                    found = asset_files.listing(self.spark, path, skips=self.skips).withColumn("export_index", F.lit(first + k)).withColumn("seq", F.lit(first + k).cast("long"))
                    listed = found if listed is None else listed.union(found)
            rows = self._write(rows, f"{new}/staged")  # inputs are parsed once
            problems = [f"{r['path']}: {r['problem']}" for r in rows.where("problem is not null").select("path", "problem").orderBy("path").limit(100).collect()]
            if problems and not skip_broken:
                raise BrokenInputs(problems)
            read = rows.where("item is not null")
            tagged = read.where(F.col("kind").isin(*TAGGED)).select(F.lit(service).alias("service"), F.lit(account).alias("account"), "export_index", "kind", "path", F.col("item").alias("value"))
            read = read.where(~F.col("kind").isin(*TAGGED))
            # a number for each item, in the order of dumps, files and places: dealt by ranges, so that no dump is one task's; what is counted is a row a task
            order = ("export_index", "path", "place")
            ranged = self._write(read.repartitionByRange(*order).sortWithinPartitions(*order).select("export_index", "item", F.monotonically_increasing_id().alias("n")), f"{new}/work/ranged")
            starts = ranged.groupBy(F.shiftright("n", 33).alias("task")).agg(F.count("*").alias("c")).selectExpr("task", "coalesce(sum(c) over (order by task rows between unbounded preceding and 1 preceding), 0) as before")
            numbered = ranged.join(F.broadcast(starts), F.shiftright("n", 33) == F.col("task"))
            items = numbered.select(F.lit(service).alias("service"), F.lit(account).alias("account"), (F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1)) + base).cast("long").alias("seq"), "export_index", "item")
            exports = self.spark.createDataFrame([(service, account, first + k, p, None) for k, p in enumerate(paths)], EXPORT_ROW)
            assets, bodies = (self.spark.createDataFrame([], ADDED_ROWS[t]) for t in ("assets", "asset_bodies"))
            if listed is not None and listed.limit(1).count():
                stored = self._table(at, old, "assets") if old else None
                assets, bodies = asset_files.catalog(listed, f"{new}/work/assets", stored, part_bytes, through=() if local else paths)
            kept = self._write(items.select(*[c.split()[0] for c in ITEM.split(", ")]), f"{new}/items")
            self._write(exports, f"{new}/exports")
            self._write(tagged, f"{new}/tagged")
            self._write(assets, f"{new}/assets")
            self._write(bodies, f"{new}/asset_bodies")
            # buckets with new dumps: as many numbers as there are buckets at most
            here = kept.select(_bucket(F.get_json_object("item", "$.conversation.id"), buckets).alias("b")).distinct()
            touched = sorted(r["b"] for r in here.collect())
            state = None
            for v, own in _holders({b: v for b, v in (old["holds"] if old else {}).items() if int(b) in touched}).items():
                rows = self._buckets(at, v, "conversations", own).drop("bucket")
                state = rows if state is None else state.unionByName(rows)
            folded = self._write(upsert(state, kept).withColumn("bucket", _bucket(F.col("id"), buckets)), f"{new}/work/folded")
            # in order of buckets and conversations: a bucket is cut where it is large, and a search by index can leave out most of a file
            merged = self._write(folded.repartitionByRange("bucket", "seq").sortWithinPartitions("bucket", "seq"), f"{new}/conversations", "bucket")
            texts = spans(merged).withColumn("bucket", _bucket(F.col("conversation_id"), buckets))
            own = self._write(texts.repartitionByRange("bucket", "seq").sortWithinPartitions("bucket", "span_index"), f"{new}/spans", "bucket")
            index.build(own.drop("bucket"), f"{new}/index", options={"compression": self.codec, "parquet.compression.codec.zstd.level": str(self.level)})
            leaves = self._write(_leaves(merged, "bucket").repartitionByRange("bucket", "place").sortWithinPartitions("bucket"), f"{new}/leaves", "bucket")
            sizes = {str(r["bucket"]): r["count"] for r in leaves.groupBy("bucket").count().collect()}
            manifest = {
                "version": VERSION,
                "buckets": buckets,
                "part_bytes": part_bytes,
                "exports": first + len(paths),
                "next_seq": base + kept.count(),
                "versions": [*(old["versions"] if old else []), version],
                "holds": (old["holds"] if old else {}) | dict.fromkeys(sizes, version),
                "sizes": (old["sizes"] if old else {}) | sizes,
                "before": old["current"] if old else None,
            }
            n = sum(manifest["sizes"].values())
            depth = merkle.depth_for(n)
            tree = self._write(merkle.nodes(self._table(at, manifest, "leaves"), depth), f"{new}/merkle")
            self._text(f"{new}/manifest.json", json.dumps(manifest | {"conversations": n, "depth": depth, "digest": _root(tree)}))
            for name in ("staged", "work"):
                self._delete(f"{new}/{name}")
            self._switch(at, version, old["current"] if old else None)
        except BaseException:
            fs, p = self._fs(new)
            if fs.exists(p):
                fs.delete(p, True)
            raise
        return {"output": at, "exports": first + len(paths), "conversations": n, "buckets_written": len(sizes)} | ({"problems": problems} if problems else {})

    @staticmethod
    def _summaries(path: str) -> list[str]:
        return [str(p) for p in sorted(Path(path).rglob("summary.json"))]

    def ingest_home(self, home: str, depth: int = 8) -> list[dict]:
        """Every export below a folder, one ingest for each (service, account)."""
        return [self.ingest(*paths, service=s, account=a) for (s, a), paths in by_scope(discover_home(home, depth, self.skips)).items()]

    def _tree(self, service: str, account: str) -> tuple[str, dict, DataFrame]:
        at = scoped_path(self.root, service, account)
        manifest = self._open(at)
        return at, manifest, merkle.nodes(_leaves(self._table(at, manifest, "conversations")), manifest["depth"])

    def verify(self, service: str, account: str) -> bool:
        """Whether the conversations are those that the manifest was written for."""
        _, manifest, tree = self._tree(service, account)
        return _root(tree) == manifest["digest"]

    def _stored_tree(self, at: str, manifest: dict) -> DataFrame:
        return self.spark.read.parquet(f"{at}/versions/{manifest['current']}/merkle")

    def differing(self, service: str, account: str) -> DataFrame:
        """prefix, have, want: the blocks of conversations that aren't as they were written; no rows in a sound archive."""
        at, manifest, tree = self._tree(service, account)
        return merkle.differing(tree, self._stored_tree(at, manifest))

    def proof(self, service: str, account: str, conversation_id: str) -> tuple[str, str, list[dict], str]:
        """(place, leaf, steps, root) for one conversation; see ``merkle.proves``."""
        at, manifest, _ = self._tree(service, account)
        conversations = self._table(at, manifest, "conversations")
        own = _leaves(conversations.where(F.col("id") == conversation_id)).first()
        if own is None:
            raise ArchiveError(f"{service}/{account}: no conversation {conversation_id}")
        steps = merkle.proof(self._table(at, manifest, "leaves"), self._stored_tree(at, manifest), manifest["depth"], own["place"])
        return own["place"], own["leaf"], steps, manifest["digest"]

    def assets(self, service: str, account: str) -> DataFrame:
        """digest, uuid, relative_path, size, mtime, export_indices: a row for each content."""
        return merge_assets(self.table(scoped_path(self.root, service, account), "assets"))

    def asset_bodies(self, service: str, account: str, *digests: str) -> DataFrame:
        """digest, part, body of all contents, or of some. Stored by digest: files without them aren't read."""
        rows = self.table(scoped_path(self.root, service, account), "asset_bodies")
        return rows.where(F.col("digest").isin(*digests)) if digests else rows

    def restore_assets(self, service: str, account: str, folder: str, *digests: str) -> None:
        """Writes bodies as files, named by their digests, to a folder that all executors see; what isn't stored is an error."""
        have = {r["digest"] for r in self.asset_bodies(service, account, *digests).select("digest").distinct().collect()} if digests else set()
        if missing := sorted(set(digests) - have):
            raise ArchiveError(f"{service}/{account}: no asset {', '.join(missing)}")
        asset_files.restore(self.asset_bodies(service, account, *digests), folder, self._open(scoped_path(self.root, service, account))["part_bytes"])

    def broken_assets(self, service: str, account: str) -> DataFrame:
        """digest, own: contents whose stored parts give another digest, or that have none (null); no rows in a sound archive."""
        at = scoped_path(self.root, service, account)
        known = self.table(at, "assets").select("digest").distinct()
        return known.join(asset_files.part_digests(self.table(at, "asset_bodies")), "digest", "left").where(~F.col("own").eqNullSafe(F.col("digest"))).select("digest", "own")

    # ------------------------------------------------ queries

    def list(self) -> list[str]:
        """service/account of each archive, in the order of their parts."""
        fs, p = self._fs(self.root)
        found = fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/service=*/account=*/CURRENT")) if fs.exists(p) else []
        names = [s.getPath().toString().split("/")[-3:-1] for s in found or []]
        return sorted((f"{a.removeprefix('service=')}/{b.removeprefix('account=')}" for a, b in names), key=lambda x: x.split("/"))

    def spans(self, service: str | None = None, account: str | None = None, q: Query | None = None) -> DataFrame:
        """Spans of one archive, or of all that can be read; ``unreadable`` tells of the others. With a query, only those that
        the archives' indexes leave over: all that match are among them."""
        self.unreadable: list[str] = []
        if (service is None) != (account is None):
            raise ScopeError("service and account are given together or not at all")
        names = [f"{service}/{account}"] if service else self.list()
        if not names:
            raise NoArchives(f"no archives in {self.root}")
        out = None
        for n in names:
            at = scoped_path(self.root, *n.split("/"))
            try:
                manifest = self._open(at)
                own = self._table(at, manifest, "spans") if q is None else self._narrowed(at, manifest, q)
            except ArchiveError as e:
                if service:
                    raise
                self.unreadable.append(str(e))
                continue
            out = own if out is None else out.unionByName(own)
        if out is None:
            raise NoArchives(f"no readable archives in {self.root}")
        return out

    def _narrowed(self, at: str, manifest: dict, q: Query) -> DataFrame:
        """Each version's buckets by the index that was written with them. It may tell of buckets that a later version has, too: these
        aren't read."""
        out = self.spark.createDataFrame([], SPANS)
        for v, own in _holders(manifest["holds"]).items():
            terms = index.TermIndex(self.spark, f"{at}/versions/{v}/index")
            out = out.unionByName(terms.narrowed(self._buckets(at, v, "spans", own), q).drop("bucket"))
        return out

    def search(self, pattern: str, flags: Flags | None = None, max_count: int = MAX_COUNT, service: str | None = None, account: str | None = None, status: Callable[[dict], None] | None = None) -> DataFrame:
        """``status`` is told how many archives there are, and of each, in order, how many unique hits there are so far."""
        q = compile_query(pattern, flags)  # a bad pattern fails before anything is read
        found = self.spans(service, account, q)
        if status:
            names = [f"{service}/{account}"] if service else self.list()
            status({"event": "starting", "archives": len(names)})
            counts, so_far = {r["archive"]: r["n"] for r in unique_hits(hits(found, q)).groupBy("archive").agg(F.count("*").alias("n")).collect()}, 0
            for k, name in enumerate(names, 1):
                so_far += counts.get(name, 0)
                status({"event": "archive", "archive": name, "done": k, "of": len(names), "unique_hits": so_far})
        return report(found, q, max_count)

    def group_count(self, pattern: str, flags: Flags | None = None, service: str | None = None, account: str | None = None) -> int:
        """How many groups a report without a cap has."""
        q = compile_query(pattern, flags)
        return group_count(self.spans(service, account, q), q)

    def omitted(self, pattern: str, flags: Flags | None = None, service: str | None = None, account: str | None = None) -> int:
        """How many matches a report leaves out as duplicates."""
        q = compile_query(pattern, flags)
        return duplicate_omitted(self.spans(service, account, q), q).agg(F.coalesce(F.sum("duplicate_omitted"), F.lit(0))).first()[0]

    def stats(self, service: str | None = None, account: str | None = None) -> DataFrame:
        names = [f"{service}/{account}"] if service else self.list()
        exports = None
        for n in names:
            own = self.table(scoped_path(self.root, *n.split("/")), "exports")
            exports = own if exports is None else exports.unionByName(own)
        return span_stats(self.spans(service, account)).join(export_labels(exports), "archive", "left").orderBy(path_key(F.col("archive")))


def _bucket(conversation_id: Column, buckets: int) -> Column:
    """Conversations without an id, which are merged with nothing, are dealt by their numbers."""
    return F.pmod(F.xxhash64(F.coalesce(conversation_id, F.concat(F.lit("seq "), F.col("seq").cast("string")))), F.lit(buckets)).cast("int")


def _holders(holds: dict[str, str]) -> dict[str, list[int]]:
    """bucket -> version as version -> its buckets."""
    out: dict[str, list[int]] = {}
    for b, v in holds.items():
        out.setdefault(v, []).append(int(b))
    return out


def _leaves(conversations: DataFrame, *more: str) -> DataFrame:
    return merkle.leaves(conversations, ["id", "seq"], ["export_indices", "item"], more)


def _root(tree: DataFrame) -> str | None:
    found = tree.where("prefix = ''").first()
    return found["digest"] if found else None


def totals(reports: list[dict]) -> dict:
    """Sums over the reports of several ingests."""
    return {"archives": len(reports), "exports": sum(r["exports"] for r in reports), "conversations": sum(r["conversations"] for r in reports)}


def stats_text(rows: list[dict]) -> str:
    """Counts for people: a line for each figure, archives apart."""
    out = []
    for r in rows:
        out.append(str(r["archive"]))
        out += [f"  {k}: {', '.join(v) if isinstance(v, list) else v}" for k, v in r.items() if k != "archive"]
    return "\n".join(out)


def hits_json(groups: DataFrame) -> str:
    """{"hits": [{snippet, field, occurrences}]} of a capped report."""
    rows = [r.asDict(recursive=True) for r in groups.select("snippet", "field", "occurrences").collect()]
    return json.dumps({"hits": rows}, ensure_ascii=False)


def hits_text(groups: DataFrame, archive: str | None = None, not_shown: int = 0, omitted: int = 0) -> str:
    """The report for people. Of one archive, its name stands above and not in the rows; below, what is left out."""
    out = [archive] if archive else []
    for r in groups.collect():
        out.append(f"{r['field']}: {r['snippet']}\n  present in:")
        out += ["    " + "  ".join([*([] if archive else [o["archive"]]), o["conversation_id"] or "-", o["field"]]) for o in r["occurrences"]]
    if clause := suppressed_clause(not_shown, omitted):
        out.append(clause)
    return "\n".join(out)
