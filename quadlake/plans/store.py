"""Repositories of named graphs with commits, branches, checkouts, a log, documents and synchronisation.

A repository is a folder of Parquet tables. Revisions, commits, log entries and documents are appended and never changed; refs are
rewritten as a whole into a new folder, and a pointer file names the current one, so a reader sees the old refs or the new. One writer
at a time. Without history only the newest revision of each graph is kept.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake._io import materialise
from quadlake.functions.hashes import NIL
from quadlake.functions.iri import graph_id
from quadlake.model import QUADS
from quadlake.operators.closure import closure, common_ancestors, reach
from quadlake.operators.sets import difference, sync_refs
from quadlake.operators.stats import graph_hash

SCHEMAS = {
    "ng_quads": "ng_rev string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in QUADS),
    "ng_revisions": "ng_rev string, graph_iri string",
    "ng_imports": "ng_rev string, imported_iri string",
    "ds_revisions": "ds_rev string, ds_id string, ng_rev string, commit string",
    "ds_rev_graphs": "ds_rev string, graph_iri string, ng_rev string",
    "commits": "commit string, author string, ts timestamp, message string",
    "commit_datasets": "commit string, ds_id string, ds_rev string, parents array<string>",
    "log": "log_key bigint, fields map<string,string>",
    "documents": "hash string, mime_type string, author string, ts timestamp, size bigint, content binary",
}
REFS = "ds_id string, kind string, name string, commit string"


class NothingToCommit(ValueError):
    pass


class Unsupported(NotImplementedError):
    """The repository keeps no history."""


class Files:
    """Small files on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def write(self, name: str, text: str) -> None:
        """To a temporary name first, then renamed."""
        part = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self.path(name), False)
        self.fs.rename(self.path(part), self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def folders(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)) if s.isDirectory())

    def size(self) -> int:
        return self.fs.getContentSummary(self.path("")).getLength()


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        """Opens a repository; see create."""
        self.spark, self.root, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.history = json.loads(self.files.read("repository.json"))["history"]
        #: Called with the modified graphs' IRIs before a commit (may raise), and with the commit's hash after it.
        self.before: list[Callable[[list[str]], None]] = []
        self.after: list[Callable[[str], None]] = []

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, history: bool = True) -> Repository:
        files = Files(spark, path)
        if files.exists("repository.json"):
            raise FileExistsError(path)
        files.fs.mkdirs(files.path(""))
        files.write("repository.json", json.dumps({"history": history}))
        return cls(spark, path)

    # tables

    def table(self, name: str) -> DataFrame:
        if not self.files.exists(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def _append(self, name: str, df: DataFrame) -> None:
        columns = [c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMAS[name])] if name != "ng_quads" else ["ng_rev", *QUADS.fieldNames()]
        df.select(*columns).write.mode("append").parquet(f"{self.root}/{name}")

    def refs(self) -> DataFrame:
        """The newest complete table of references. A table that a crash has cut off lacks its marker and is passed over."""
        if (name := self._newest_refs()) is None:
            return self.spark.createDataFrame([], REFS)
        return self.spark.read.schema(REFS).parquet(f"{self.root}/refs/{name}")

    def _newest_refs(self) -> str | None:
        names = self.files.folders("refs") if self.files.exists("refs") else []
        return next((n for n in sorted(names, key=lambda n: int(n.split("-")[0]), reverse=True) if self.files.exists(f"refs/{n}/_SUCCESS")), None)

    def _set_refs(self, refs: DataFrame) -> None:
        name = f"{int((self._newest_refs() or '0').split('-')[0]) + 1:020d}-{uuid.uuid4().hex[:8]}"
        refs.dropDuplicates(["ds_id", "kind", "name"]).coalesce(1).write.parquet(f"{self.root}/refs/{name}")

    def _need_history(self) -> None:
        if not self.history:
            raise Unsupported("this repository keeps no history")

    # committing

    def commit(self, q: DataFrame, modified: Iterable[str], *, message: str, author: str, branch: str | None = "master", imports: DataFrame | None = None, checked_out: Iterable[str] = (), deleted: Iterable[str] = (), ts: str | None = None) -> str:
        """Writes the modified graphs of q and new revisions of their datasets and of all that import them; returns the commit's hash.

        Parents: with a branch, the branch's tip if it is among the checked-out commits (else the tip becomes a leaf); without one, the
        checked-out commits that are leaves.
        """
        modified, deleted, checked_out = sorted(set(modified)), sorted(set(deleted)), list(checked_out)
        if not modified and not deleted:
            raise NothingToCommit("nothing is modified")
        for hook in self.before:
            hook(modified)
        spark = self.spark
        imports = imports if imports is not None else spark.createDataFrame([], "graph_iri string, imported_iri string")
        edges = imports.select(F.col("graph_iri").alias("a"), F.col("imported_iri").alias("b"))
        above = edges.withColumn("depth", F.lit(1)) if imports.isEmpty() else closure(edges)
        names = spark.createDataFrame([(m,) for m in modified + deleted], "graph_iri string")
        here = q.join(names, "graph_iri", "left_semi")
        content = graph_hash(here)
        listed = imports.groupBy("graph_iri").agg(F.array_join(F.sort_array(F.collect_set("imported_iri")), ",").alias("i"))
        revs = content.join(listed, "graph_iri", "left").select("graph_iri", F.sha2(F.concat_ws("|", "ng_rev", F.coalesce("i", F.lit(""))), 256).alias("ng_rev"))
        gone = spark.createDataFrame([(d, NIL) for d in deleted], "graph_iri string, ng_rev string")
        empty = names.join(content, "graph_iri", "left_anti").join(gone, "graph_iri", "left_anti").select("graph_iri", F.sha2(F.concat(F.lit("empty|"), "graph_iri"), 256).alias("ng_rev"))
        revs = materialise(revs.unionByName(empty).unionByName(gone))
        up = above.join(names.select(F.col("graph_iri").alias("b")), "b", "left_semi").select(F.col("a").alias("graph_iri"))
        datasets = names.union(up).distinct()
        # Current revisions of all graphs: new ones, then those on the branch.
        tips = self.refs().filter((F.col("kind") == "branch") & (F.col("name") == (branch or "master"))).select("ds_id", "commit")
        old = self.table("commit_datasets").join(tips, ["ds_id", "commit"], "left_semi").join(self.table("ds_revisions").select("ds_rev", "ng_rev"), "ds_rev").select(F.col("ds_id").alias("gid"), F.col("ng_rev").alias("old_rev"))
        every = datasets.union(edges.select("b")).distinct().withColumn("gid", graph_id(F.col("graph_iri")))
        now = every.join(revs, "graph_iri", "left").join(old, "gid", "left").select("graph_iri", F.coalesce("ng_rev", "old_rev", F.lit(NIL)).alias("ng_rev"))
        whole = above.select(F.col("a").alias("graph_iri"), F.col("b").alias("member")).union(datasets.select("graph_iri", "graph_iri"))
        members = whole.join(datasets, "graph_iri", "left_semi").join(now.select(F.col("graph_iri").alias("member"), "ng_rev"), "member")
        ds = members.groupBy("graph_iri").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "member", "ng_rev"))), ";"), 256).alias("ds_rev")).join(now, "graph_iri")
        ds = materialise(ds.withColumn("ds_id", graph_id(F.col("graph_iri"))))
        refs = self.refs()
        tip = refs.filter((F.col("kind") == "branch") & (F.col("name") == branch)).select("ds_id", F.col("commit").alias("tip"))
        mine = F.col("tip").isin(*checked_out) if checked_out else F.lit(False)
        leaves = refs.filter("kind = 'leaf'").filter(F.col("commit").isin(*checked_out) if checked_out else F.lit(False)).groupBy("ds_id").agg(F.sort_array(F.collect_set("commit")).alias("leaves"))
        with_parents = ds.join(tip, "ds_id", "left").join(leaves, "ds_id", "left")
        parents = F.when(mine, F.array("tip")).otherwise(F.array().cast("array<string>")) if branch else F.coalesce("leaves", F.array().cast("array<string>"))
        with_parents = materialise(with_parents.withColumn("parents", F.coalesce(parents, F.array().cast("array<string>"))))
        when = F.lit(ts).cast("timestamp") if ts else F.date_trunc("second", F.current_timestamp())
        text = F.array_join(F.sort_array(F.collect_list(F.concat_ws(",", "ds_id", "ds_rev", F.array_join("parents", "+")))), ";")
        head = with_parents.agg(text.alias("d"), when.alias("ts")).select("ts", F.sha2(F.concat_ws("\n", "d", F.lit(author), F.unix_timestamp("ts").cast("string"), F.lit(message)), 256).alias("commit"))
        commit, at = (lambda r: (r["commit"], r["ts"]))(head.first())
        fresh = revs.filter(F.col("ng_rev") != NIL).join(self.table("ng_revisions").select("ng_rev"), "ng_rev", "left_anti")
        fresh = materialise(fresh)
        if self.history:
            self._append("ng_quads", here.join(fresh, "graph_iri"))
        else:
            kept = self.table("ng_quads").join(names, "graph_iri", "left_anti")
            self._rewrite("ng_quads", kept.unionByName(here.join(revs, "graph_iri").select("ng_rev", *QUADS.fieldNames())))
        self._append("ng_revisions", fresh)
        self._append("ng_imports", imports.join(fresh, "graph_iri"))
        self._append("ds_revisions", ds.select("ds_rev", "ds_id", "ng_rev", F.lit(commit).alias("commit")).join(self.table("ds_revisions").select("ds_rev"), "ds_rev", "left_anti"))
        graphs = members.join(ds.select("graph_iri", "ds_rev"), "graph_iri").select("ds_rev", F.col("member").alias("graph_iri"), "ng_rev").distinct()
        self._append("ds_rev_graphs", graphs.join(self.table("ds_rev_graphs").select("ds_rev"), "ds_rev", "left_anti"))
        self._append("commit_datasets", with_parents.select(F.lit(commit).alias("commit"), "ds_id", "ds_rev", "parents"))
        self._append("commits", self.spark.createDataFrame([(commit, author, at, message)], SCHEMAS["commits"]))
        dead = spark.createDataFrame([(d,) for d in deleted], "graph_iri string").select(graph_id(F.col("graph_iri")).alias("ds_id"))
        own = ds.select("ds_id").join(dead, "ds_id", "left_anti")
        if branch:
            new = own.select("ds_id", F.lit("branch").alias("kind"), F.lit(branch).alias("name"), F.lit(commit).alias("commit"))
            lost = with_parents.filter(F.col("tip").isNotNull() & ~mine).select("ds_id", F.lit("leaf").alias("kind"), F.col("tip").alias("name"), F.col("tip").alias("commit"))
        else:
            new = own.select("ds_id", F.lit("leaf").alias("kind"), F.lit(commit).alias("name"), F.lit(commit).alias("commit"))
            lost = self.spark.createDataFrame([], REFS)
        lost = lost.unionByName(dead.select("ds_id", F.lit("leaf").alias("kind"), F.lit(commit).alias("name"), F.lit(commit).alias("commit")))
        used = with_parents.select("ds_id", F.explode("parents").alias("commit"))
        rest = refs.join(new.select("ds_id", "kind", "name"), ["ds_id", "kind", "name"], "left_anti").join(used.withColumn("kind", F.lit("leaf")), ["ds_id", "kind", "commit"], "left_anti").select("ds_id", "kind", "name", "commit")
        rest = rest.join(dead.withColumn("kind", F.lit("branch")).withColumn("name", F.lit(branch)), ["ds_id", "kind", "name"], "left_anti")
        self._set_refs(rest.unionByName(new).unionByName(lost))
        self._log({"message": message, "author": author, "commit": commit, "branch": branch or "", "type": "commit"})
        for hook in self.after:
            hook(commit)
        return commit

    def _rewrite(self, name: str, df: DataFrame) -> None:
        kept = materialise(df)
        kept.write.mode("overwrite").parquet(f"{self.root}/{name}")

    # reading

    def datasets(self) -> DataFrame:
        return self.table("ng_revisions").select(graph_id(F.col("graph_iri")).alias("ds_id"), "graph_iri").distinct()

    def branches(self, ds_id: str) -> DataFrame:
        """name, commit; none without history."""
        return self.refs().filter((F.col("ds_id") == ds_id) & (F.col("kind") == "branch")).select("name", "commit")

    def leaf_commits(self, ds_id: str) -> DataFrame:
        return self.refs().filter((F.col("ds_id") == ds_id) & (F.col("kind") == "leaf")).select("commit")

    def checkout_revision(self, ds_rev: str) -> DataFrame:
        """The quads of a dataset revision: its graph and all that it imports."""
        graphs = self.table("ds_rev_graphs").filter(F.col("ds_rev") == ds_rev).select("graph_iri", "ng_rev").distinct()
        return self.table("ng_quads").join(graphs, ["graph_iri", "ng_rev"], "left_semi").drop("ng_rev")

    def checkout_commit(self, commit: str, ds_id: str | None = None) -> DataFrame:
        """Of one dataset, or of all that the commit has. Where revisions of an import conflict, the smallest dataset's counts."""
        found = self.table("commit_datasets").filter(F.col("commit") == commit)
        found = found.filter(F.col("ds_id") == ds_id) if ds_id else found
        graphs = found.select("ds_id", "ds_rev").join(self.table("ds_rev_graphs"), "ds_rev").groupBy("graph_iri").agg(F.min_by("ng_rev", F.struct("ds_id", "ng_rev")).alias("ng_rev"))
        return self.table("ng_quads").join(graphs, ["graph_iri", "ng_rev"], "left_semi").drop("ng_rev")

    def checkout_branch(self, ds_id: str, branch: str = "master") -> DataFrame:
        tip = self.branches(ds_id).filter(F.col("name") == branch).first()
        if tip is None:
            raise KeyError(branch)
        return self.checkout_commit(tip["commit"], ds_id)

    def graph_revision(self, ng_rev: str) -> DataFrame:
        self._need_history()
        return self.table("ng_quads").filter(F.col("ng_rev") == ng_rev).drop("ng_rev")

    def commit_details(self, commits: Iterable[str]) -> DataFrame:
        """commit, author, ts, message, datasets (id to revision), parents (id to commits); unknown hashes have no row."""
        self._need_history()
        rows = self.table("commit_datasets").filter(F.col("commit").isin(*commits)).groupBy("commit").agg(F.map_from_entries(F.collect_list(F.struct("ds_id", "ds_rev"))).alias("datasets"), F.map_from_entries(F.collect_list(F.struct("ds_id", "parents"))).alias("parents"))
        return self.table("commits").join(rows, "commit")

    def commit_for_revision(self, ds_rev: str) -> str | None:
        row = self.table("ds_revisions").filter(F.col("ds_rev") == ds_rev).select("commit").first()
        return row and row["commit"]

    def parents(self, ds_id: str, *, first_only: bool = False) -> DataFrame:
        """a (commit), b (parent)."""
        rows = self.table("commit_datasets").filter(F.col("ds_id") == ds_id)
        b = F.get("parents", F.lit(0)) if first_only else F.explode("parents")
        return rows.select(F.col("commit").alias("a"), b.alias("b")).filter("b IS NOT NULL")

    def ancestry(self, ds_id: str, commit: str) -> DataFrame:
        return reach(self.parents(ds_id), self.spark.createDataFrame([(commit,)], "node string")).select("node", "depth")

    def commit_history(self, ds_id: str) -> DataFrame:
        """All commits from branch tips and leaves back, oldest first."""
        seeds = self.refs().filter(F.col("ds_id") == ds_id).select(F.col("commit").alias("node")).distinct()
        return reach(self.parents(ds_id), seeds).select(F.col("node").alias("commit")).distinct().join(self.table("commits"), "commit").orderBy("ts", "commit")

    def common_parent(self, ds_id: str, x: str, y: str, *, first_only: bool = False) -> str | None:
        row = common_ancestors(self.parents(ds_id, first_only=first_only), x, y).first()
        return row and row["node"]

    def commit_difference(self, commit: str) -> DataFrame:
        """Statements that a commit changed, against its first parents."""
        rows = self.table("commit_datasets").filter(F.col("commit") == commit)
        before = rows.select("ds_id", F.get("parents", F.lit(0)).alias("commit")).join(self.table("commit_datasets").drop("parents"), ["ds_id", "commit"]).join(self.table("ds_rev_graphs"), "ds_rev").select("graph_iri", "ng_rev").distinct()
        old = self.table("ng_quads").join(before, ["graph_iri", "ng_rev"], "left_semi").drop("ng_rev")
        return difference(old, self.checkout_commit(commit))

    # branches

    def set_branch(self, ds_id: str, branch: str, commit: str) -> None:
        """Moves a branch to a leaf or another branch's tip; the old tip becomes a leaf unless the new one goes back to it."""
        self._need_history()
        refs = materialise(self.refs())
        own = refs.filter(F.col("ds_id") == ds_id)
        if own.filter(F.col("commit") == commit).isEmpty():
            raise ValueError(f"{commit} is neither a leaf nor a tip of the dataset")
        old = own.filter((F.col("kind") == "branch") & (F.col("name") == branch)).first()
        rest = refs.filter(~((F.col("ds_id") == ds_id) & (((F.col("kind") == "branch") & (F.col("name") == branch)) | ((F.col("kind") == "leaf") & (F.col("commit") == commit)))))
        new = [(ds_id, "branch", branch, commit)]
        if old and old["commit"] != commit and self.ancestry(ds_id, commit).filter(F.col("node") == old["commit"]).isEmpty():
            new.append((ds_id, "leaf", old["commit"], old["commit"]))
        self._set_refs(rest.unionByName(self.spark.createDataFrame(new, REFS)))
        self._log({"type": "set branch", "branch": branch, "commit": commit})

    def set_branch_revision(self, ds_id: str, branch: str, ds_rev: str) -> None:
        self.set_branch(ds_id, branch, self.commit_for_revision(ds_rev) or "")

    def remove_branch(self, ds_id: str, branch: str) -> None:
        """The tip becomes a leaf unless another branch has it."""
        self._need_history()
        refs = materialise(self.refs())
        tip = refs.filter((F.col("ds_id") == ds_id) & (F.col("kind") == "branch") & (F.col("name") == branch)).first()
        if tip is None:
            raise KeyError(branch)
        rest = refs.filter(~((F.col("ds_id") == ds_id) & (F.col("kind") == "branch") & (F.col("name") == branch)))
        if rest.filter((F.col("ds_id") == ds_id) & (F.col("commit") == tip["commit"]) & (F.col("kind") == "branch")).isEmpty():
            rest = rest.unionByName(self.spark.createDataFrame([(ds_id, "leaf", tip["commit"], tip["commit"])], REFS))
        self._set_refs(rest)
        self._log({"type": "remove branch", "branch": branch, "commit": tip["commit"]})

    # log, information

    def _log(self, fields: dict[str, str]) -> None:
        key = (self.table("log").agg(F.max("log_key")).first()[0] or 0) + 1
        self._append("log", self.spark.createDataFrame([(key, fields)], SCHEMAS["log"]))

    def log(self, start: int | None = None, end: int | None = None, *, last: int | None = None) -> DataFrame:
        """Newest first: keys from start (the newest if None) down to above end, or the last n."""
        self._need_history()
        rows = self.table("log")
        if start is not None:
            rows = rows.filter(F.col("log_key") <= start)
        if end is not None:
            rows = rows.filter(F.col("log_key") > end)
        rows = rows.orderBy(F.desc("log_key"))
        return rows.limit(last) if last else rows

    def info(self, branch: str | None = None) -> dict:
        refs = self.refs()
        out = {name: self.table(name).count() for name in ("ng_revisions", "ds_revisions", "commits", "log", "documents")}
        out["datasets"] = self.datasets().count()
        out["datasets_in_branch"] = refs.filter((F.col("kind") == "branch") & (F.col("name") == (branch or "master"))).select("ds_id").distinct().count()
        out["document_bytes"] = self.table("documents").agg(F.sum("size")).first()[0] or 0
        return out | {"bytes": self.files.size(), "history": self.history, "version": self.version_hash()}

    def version_hash(self) -> str:
        """Of branches, commits and documents, each sorted: (key, hash) pairs are hashed and summed, so nothing is sorted as a whole."""
        rows = self.refs().filter("kind = 'branch'").select(F.concat_ws("|", "ds_id", "name", "commit").alias("x")).union(self.table("commits").select("commit")).union(self.table("documents").select("hash"))
        h = F.sha2("x", 256)
        sums = rows.distinct().agg(*[F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)], F.count(F.lit(1)))
        return self.spark.createDataFrame([(":".join(map(str, sums.first())),)], "x string").select(F.sha2("x", 256)).first()[0]

    # documents

    def document_set(self, content: bytes, mime_type: str, author: str) -> str:
        self._need_history()
        row = self.spark.createDataFrame([(bytearray(content), mime_type, author)], "content binary, mime_type string, author string")
        row = row.select(F.sha2("content", 256).alias("hash"), "mime_type", "author", F.current_timestamp().alias("ts"), F.octet_length("content").cast("long").alias("size"), "content")
        key = row.first()["hash"]
        if self.table("documents").filter(F.col("hash") == key).isEmpty():
            self._append("documents", row)
        return key

    def documents(self) -> DataFrame:
        self._need_history()
        return self.table("documents").drop("content")

    def document(self, key: str) -> bytes | None:
        row = self.table("documents").filter(F.col("hash") == key).select("content").first()
        return row and bytes(row["content"])

    def document_delete(self, key: str) -> None:
        self._need_history()
        self._rewrite("documents", self.table("documents").filter(F.col("hash") != key))

    # synchronisation

    def sync_from(self, other: Repository, *, datasets: Iterable[str] | None = None, branch: str | None = None) -> None:
        """Copies what is missing: all datasets or the given ones (ids) and their imports; one branch with its ancestry or all."""
        self._need_history()
        other._need_history()
        keep_commits = other.table("commit_datasets")
        refs = other.refs()
        if datasets is not None:
            ids = list(datasets)
            graphs = keep_commits.filter(F.col("ds_id").isin(*ids)).select("ds_rev").join(other.table("ds_rev_graphs"), "ds_rev").select(graph_id(F.col("graph_iri")).alias("ds_id"))
            wanted = materialise(graphs.union(self.spark.createDataFrame([(i,) for i in ids], "ds_id string")).distinct())
            keep_commits, refs = keep_commits.join(wanted, "ds_id", "left_semi"), refs.join(wanted, "ds_id", "left_semi")
        if branch is not None:
            refs = refs.filter((F.col("kind") == "branch") & (F.col("name") == branch))
            edges = keep_commits.select(F.col("commit").alias("a"), F.explode("parents").alias("b")).distinct()
            seen = reach(edges, refs.select(F.col("commit").alias("node")).distinct()).select(F.col("node").alias("commit")).distinct()
            keep_commits = keep_commits.join(seen, "commit", "left_semi")
        keep_commits = materialise(keep_commits)
        revs = keep_commits.select("ds_rev").distinct()
        graph_revs = other.table("ds_rev_graphs").join(revs, "ds_rev", "left_semi").select("ng_rev").distinct()
        parts = [("ng_quads", ["ng_rev"], other.table("ng_quads").join(graph_revs, "ng_rev", "left_semi")), ("ng_revisions", ["ng_rev"], other.table("ng_revisions").join(graph_revs, "ng_rev", "left_semi")), ("ng_imports", ["ng_rev"], other.table("ng_imports").join(graph_revs, "ng_rev", "left_semi"))]
        parts += [(t, ["ds_rev"], other.table(t).join(revs, "ds_rev", "left_semi")) for t in ("ds_revisions", "ds_rev_graphs")]
        parts += [("commit_datasets", ["commit", "ds_id"], keep_commits), ("commits", ["commit"], other.table("commits").join(keep_commits.select("commit"), "commit", "left_semi"))]
        if datasets is None:
            parts.append(("documents", ["hash"], other.table("documents")))
        for name, key, rows in parts:
            self._append(name, materialise(rows.join(self.table(name).select(*key).distinct(), key, "left_anti")))
        self._set_refs(materialise(sync_refs(self.refs(), refs, branch=branch)))
        self._log({"type": "sync", "author": "sync"})


class SuperRepository:
    """A folder of repositories with quotas in bytes and a limit on their number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root, self.files = spark, path.rstrip("/"), Files(spark, path)
        if not self.files.exists():
            self.files.fs.mkdirs(self.files.path(""))
        if not self.files.exists("super.json"):
            self._save({"quotas": {}, "total": None, "most": None})

    def _load(self) -> dict:
        return json.loads(self.files.read("super.json"))

    def _save(self, conf: dict) -> None:
        self.files.write("super.json", json.dumps(conf))

    def names(self) -> list[str]:
        return self.files.folders()

    def create(self, name: str = "default", *, history: bool = True) -> Repository:
        most = self._load()["most"]
        if most is not None and len(self.names()) >= most:
            raise ValueError("too many repositories")
        repo = Repository.create(self.spark, f"{self.root}/{name}", history=history)
        repo.before.append(lambda _: self.check(name))
        return repo

    def get(self, name: str = "default") -> Repository:
        repo = Repository(self.spark, f"{self.root}/{name}")
        repo.before.append(lambda _: self.check(name))
        return repo

    def delete(self, name: str) -> None:
        self.files.delete(name)

    def set_quota(self, name: str | None, size: int | None) -> None:
        """Of one repository, or of all together."""
        conf = self._load()
        if name is None:
            conf["total"] = size
        else:
            conf["quotas"][name] = size
        self._save(conf)

    def set_most(self, n: int | None) -> None:
        self._save(self._load() | {"most": n})

    def check(self, name: str) -> None:
        conf = self._load()
        sizes = {n: Files(self.spark, f"{self.root}/{n}").size() for n in self.names()}
        if (q := conf["quotas"].get(name)) is not None and sizes.get(name, 0) > q:
            raise ValueError(f"{name} is over its quota")
        if conf["total"] is not None and sum(sizes.values()) > conf["total"]:
            raise ValueError("the total quota is used up")


#: Access modes in ascending order.
MODES = ["none", "read-only", "read-write", "admin", "super-admin"]


def access_mode(roles: Iterable[str]) -> str:
    """The highest mode that a role's name contains."""
    found = [m for m in MODES for r in roles if m in r.lower() and not (m == "admin" and "super-admin" in r.lower())]
    return max(found, key=MODES.index, default="none")
