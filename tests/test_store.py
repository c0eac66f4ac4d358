import pytest
from pyspark.sql import functions as F

from quadlake.functions.iri import graph_id
from quadlake.functions.literals import XSD
from quadlake.operators.mutation import statements
from quadlake.plans.store import NothingToCommit, Repository, SuperRepository, Unsupported, access_mode


def g(spark, iri, *values):
    return statements(spark.createDataFrame([(f"{iri}#a", "p", v, f"{XSD}string") for v in values], "s string, p string, o string, dt string"), iri)


def ds(spark, iri):
    return spark.range(1).select(graph_id(F.lit(iri))).first()[0]


def test_history(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "r"))
    imports = spark.createDataFrame([("http://top", "http://low")], "graph_iri string, imported_iri string")
    low, top = ds(spark, "http://low"), ds(spark, "http://top")
    both = g(spark, "http://low", "1").union(g(spark, "http://top", "t"))
    c1 = repo.commit(both, ["http://low", "http://top"], message="one", author="me", imports=imports, ts="2024-01-01 00:00:00")
    changed = g(spark, "http://low", "2").union(g(spark, "http://top", "t"))
    c2 = repo.commit(changed, ["http://low"], message="two", author="me", imports=imports, checked_out=[c1], ts="2024-01-02 00:00:00")
    # The importer has a new revision too, and a checkout brings the import along.
    assert {r["o_lex"] for r in repo.checkout_branch(top).collect()} == {"2", "t"}
    assert {r["o_lex"] for r in repo.checkout_commit(c1, top).collect()} == {"1", "t"}
    assert [r["b"] for r in repo.parents(low).collect()] == [c1]
    c3 = repo.commit(g(spark, "http://low", "3"), ["http://low"], message="aside", author="you", imports=None, checked_out=[c1], ts="2024-01-03 00:00:00")
    # The tip was not checked out: it becomes a leaf.
    assert {r["commit"] for r in repo.leaf_commits(low).collect()} == {c2}
    assert {r["commit"] for r in repo.branches(low).collect()} == {c3}
    assert repo.common_parent(low, c2, c1) == c1
    repo.set_branch(low, "old", c2)
    assert {(r["name"], r["commit"]) for r in repo.branches(low).collect()} == {("master", c3), ("old", c2)}
    repo.remove_branch(low, "old")
    assert {r["commit"] for r in repo.leaf_commits(low).collect()} == {c2}
    assert [r["fields"]["type"] for r in repo.log(last=2).collect()] == ["remove branch", "set branch"]
    assert sorted(r["flag"] for r in repo.commit_difference(c2).filter("graph_iri = 'http://low'").collect()) == [-1, 1]
    with pytest.raises(NothingToCommit):
        repo.commit(both, [], message="", author="")

    other = Repository.create(spark, str(tmp_path / "s"))
    other.sync_from(repo)
    assert other.version_hash() == repo.version_hash() and other.table("ng_revisions").count() == repo.table("ng_revisions").count()
    other.sync_from(repo)
    assert other.table("commits").count() == 3
    key = repo.document_set(b"abc", "text/plain", "me")
    assert repo.document(key) == b"abc" and repo.documents().count() == 1
    repo.document_delete(key)
    assert repo.document(key) is None and repo.info()["datasets"] == 2


def test_without_history(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "b"), history=False)
    repo.commit(g(spark, "http://x", "1"), ["http://x"], message="", author="")
    repo.commit(g(spark, "http://x", "2"), ["http://x"], message="", author="")
    assert [r["o_lex"] for r in repo.checkout_branch(ds(spark, "http://x")).collect()] == ["2"]
    with pytest.raises(Unsupported):
        repo.log()


def test_super_repository(spark, tmp_path):
    top = SuperRepository(spark, str(tmp_path / "top"))
    top.create("a")
    top.set_most(1)
    with pytest.raises(ValueError):
        top.create("b")
    top.set_quota("a", 1)
    with pytest.raises(ValueError):
        top.get("a").commit(g(spark, "http://x", "1"), ["http://x"], message="", author="")
    top.delete("a")
    assert top.names() == [] and access_mode(["app.read-only", "app.Read-Write"]) == "read-write"


def test_references_survive_a_crash(spark, tmp_path):
    repo = Repository.create(spark, str(tmp_path / "r"))
    first = repo.commit(g(spark, "http://low", "1"), ["http://low"], message="one", author="me")
    # A newer table that was never completed does not count.
    (tmp_path / "r" / "refs" / "00000000000000000009-cut").mkdir()
    assert {r["o_lex"] for r in repo.checkout_branch(ds(spark, "http://low")).collect()} == {"1"}
    repo.commit(g(spark, "http://low", "2"), ["http://low"], message="two", author="me", checked_out=[first])
    assert {r["o_lex"] for r in repo.checkout_branch(ds(spark, "http://low")).collect()} == {"2"}
