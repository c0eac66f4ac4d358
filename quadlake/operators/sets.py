"""Equality, difference, patching, merging and synchronisation of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlake._io import spread
from quadlake.model import COLUMNS, TRIPLE, as_set


def _held(**graphs: DataFrame) -> DataFrame:
    """Each statement of any of the graphs once, with a column for each graph that says whether it holds it: one shuffle, no joins."""
    rows = None
    for name, q in graphs.items():
        side = q.select(*COLUMNS, *[F.lit(n == name).alias(f"__{n}") for n in graphs])
        rows = side if rows is None else rows.unionByName(side)
    return spread(rows, *TRIPLE).groupBy(*TRIPLE).agg(F.max("o_num").alias("o_num"), *[F.max(f"__{n}").alias(f"__{n}") for n in graphs])


def difference(old: DataFrame, new: DataFrame, *, include_equal: bool = False) -> DataFrame:
    """Statements with flag -1 (removed), +1 (added) or, if asked for, 0. Typed terms are compared, list members by place."""
    flag = F.when(~F.col("__new"), -1).when(~F.col("__old"), 1).otherwise(0)
    out = _held(old=old, new=new).select(flag.alias("flag"), *COLUMNS)
    return out if include_equal else out.filter("flag <> 0")


def equal(old: DataFrame, new: DataFrame) -> bool:
    return difference(old, new).isEmpty()


def table_difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two tables with the same columns: flag -1, 0 or +1 by key, and changed where the other columns differ."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("__a"))
    b = new.select(*key, F.struct(*rest).alias("__b"))
    flag = F.when(F.col("__b").isNull(), -1).when(F.col("__a").isNull(), 1).otherwise(0)
    return a.join(b, key, "full_outer").select(*key, flag.alias("flag"), (F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__a") != F.col("__b"))).alias("changed"))


def node_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """graph_iri, node, state: same, removed, added or modified."""
    d = difference(old, new, include_equal=True).groupBy("graph_iri", F.col("s_id").alias("node")).agg(F.count(F.when(F.col("flag") < 0, 1)).alias("minus"), F.count(F.when(F.col("flag") > 0, 1)).alias("plus"), F.count(F.when(F.col("flag") == 0, 1)).alias("equal"))
    state = F.when((F.col("minus") == 0) & (F.col("plus") == 0), "same").when((F.col("equal") == 0) & (F.col("minus") == 0), "added").when((F.col("equal") == 0) & (F.col("plus") == 0), "removed").otherwise("modified")
    return d.select("graph_iri", "node", state.alias("state"))


def import_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """graph_iri, imported_iri, flag. With a column ng_rev on both sides, a changed revision is flag 2."""
    key = ["graph_iri", "imported_iri"]
    rev = "ng_rev" in old.columns and "ng_rev" in new.columns
    a = old.select(*key, (F.col("ng_rev") if rev else F.lit("")).alias("ra"), F.lit(True).alias("ia"))
    b = new.select(*key, (F.col("ng_rev") if rev else F.lit("")).alias("rb"), F.lit(True).alias("ib"))
    flag = F.when(F.col("ib").isNull(), -1).when(F.col("ia").isNull(), 1).when(F.col("ra") != F.col("rb"), 2).otherwise(0)
    return a.join(b, key, "full_outer").select(*key, flag.alias("flag"))


def collection_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """graph_iri, node, old_items, new_items of collections that differ. Both: graph_iri, node, pos, item."""
    lists = lambda d, n: d.groupBy("graph_iri", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias(n))
    both = lists(old, "old_items").join(lists(new, "new_items"), ["graph_iri", "node"], "full_outer")
    return both.filter(~F.col("old_items").eqNullSafe(F.col("new_items")))


def symbol(flag: Column) -> Column:
    return F.when(flag < 0, "-").when(flag == 1, "+").otherwise("=")


def patch(base: DataFrame, diff: DataFrame) -> DataFrame:
    """base without the statements of flag -1 and with those of flag +1."""
    minus, plus = (diff.filter(f).select(*COLUMNS) for f in ("flag < 0", "flag = 1"))
    return _held(base=base, minus=minus, plus=plus).filter("__plus OR (__base AND NOT __minus)").select(*COLUMNS)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return as_set(a.unionByName(b))


def merge_actions(to: DataFrame, source: DataFrame) -> DataFrame:
    """What merging does with each graph of source. Both tables: graph_iri, state (local, referenced), modified, commit, repository;
    `to` has common_parent too, the nearest commit that both sides' commits go back to. Result: graph_iri, action."""
    a = to.select("graph_iri", *[F.col(c).alias(f"to_{c}") for c in ("state", "modified", "commit", "repository")], "common_parent")
    b = source.select("graph_iri", *[F.col(c).alias(f"from_{c}") for c in ("state", "modified", "commit", "repository")])
    j = b.join(a, "graph_iri", "left")
    c = F.col
    same_repo = c("to_repository").eqNullSafe(c("from_repository"))
    both = c("to_commit").isNotNull() & c("from_commit").isNotNull() & same_repo
    action = (
        F.when(c("to_state").isNull(), "move")
        .when((c("from_state") == "referenced") | (c("to_state") == "referenced"), "union")
        .when(both & (c("to_commit") != c("from_commit")) & (c("common_parent") == c("from_commit")), "keep")
        .when(both & (c("to_commit") != c("from_commit")) & (c("common_parent") == c("to_commit")), "replace")
        .when(both & (c("to_commit") != c("from_commit")), "union")
        .when(both & c("to_modified") & ~c("from_modified"), "keep")
        .when(both & ~c("to_modified") & c("from_modified"), "replace")
        .when(both, "nothing")
        .otherwise("union")
    )
    return j.select("graph_iri", action.alias("action"))


def merge(to: DataFrame, source: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Statements after merging by action; a plain union without actions. Deletions are not propagated."""
    if actions is None:
        return union(to, source)
    act = actions.select("graph_iri", "action")
    kept = to.join(act.filter("action = 'replace'"), "graph_iri", "left_anti")
    added = source.join(act.filter("action IN ('move', 'union', 'replace')"), "graph_iri", "left_semi")
    return union(kept, added)


def align_history(to: DataFrame, source: DataFrame) -> DataFrame:
    """graph_iri, commits, deleted: metadata of source's graphs for those of `to`; a graph that source lacks is deleted."""
    return to.select("graph_iri").join(source.select("graph_iri", "commits", F.lit(True).alias("found")), "graph_iri", "left").select("graph_iri", "commits", F.col("found").isNull().alias("deleted"))


def insert_missing(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """target and those rows of source whose key it lacks."""
    return target.unionByName(source.join(target.select(*key), key, "left_anti"))


def sync_refs(target: DataFrame, source: DataFrame, *, branch: str | None = None) -> DataFrame:
    """refs (ds_id, kind, name, commit) after a sync. All branches: the target's tip stays and a different one of the source becomes a
    leaf. One branch: it is overwritten."""
    key = ["ds_id", "kind", "name"]
    if branch is not None:
        mine = source.filter((F.col("kind") == "branch") & (F.col("name") == branch))
        return mine.unionByName(target.join(mine.select(*key), key, "left_anti"))
    other = source.filter("kind = 'branch'").join(target.filter("kind = 'branch'").select("ds_id", "name", F.col("commit").alias("own")), ["ds_id", "name"], "left")
    new = other.filter("own IS NULL").select("ds_id", "kind", "name", "commit")
    leaves = other.filter("own <> commit").select("ds_id", F.lit("leaf").alias("kind"), F.col("commit").alias("name"), "commit")
    return target.unionByName(new).unionByName(leaves).unionByName(source.filter("kind = 'leaf'")).dropDuplicates(key)


