"""Two revisions of a repository: hunks, touched declarations, dependencies that came and went, renames."""

import subprocess

import pytest
from pyspark.sql import functions as F

from weftspark import api
from weftspark.model import Graph
from weftspark.operators import changes, history
from weftspark.sources import git

BASE = {
    "src/users.ts": """import { User } from './user';
export class UsersRepository {
  private rows: User[] = [];
  findById(id: string) {
    const found = this.pick(id);
    if (found.deletedAt) { return null; }
    return found;
  }
  pick(id: string) { return lookup(id); }
}
export function total(list) { return list.length + offset(list); }
""",
    "src/user.ts": "export class User {\n  id: string;\n  deletedAt?: string;\n}\n",
    "src/old name.ts": "export function kept(x) {\n  return shout(x);\n}\n\n\nexport function other(y) {\n  return y;\n}\n",
}


def run(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Three commits: the base; ten lines on top; a condition gone, a method renamed, a file moved."""
    repo = tmp_path_factory.mktemp("repo")
    run(repo, "init", "-q")
    for path, text in BASE.items():
        (repo / path).parent.mkdir(exist_ok=True)
        (repo / path).write_text(text)
    run(repo, "add", "-A")
    run(repo, "commit", "-qm", "base")
    run(repo, "tag", "one")
    users = repo / "src/users.ts"
    users.write_text("// note\n" * 10 + BASE["src/users.ts"])
    run(repo, "commit", "-qam", "lines")
    run(repo, "tag", "two")
    text = users.read_text().replace("    if (found.deletedAt) { return null; }\n", "").replace("function total", "function sum")
    users.write_text(text)
    run(repo, "mv", "src/old name.ts", "src/new.ts")
    run(repo, "commit", "-qam", "change")
    run(repo, "tag", "three")
    git_register(repo)
    return repo


def git_register(_):
    from pyspark.sql import SparkSession

    git.register(SparkSession.getActiveSession())


@pytest.fixture(scope="module")
def graphs(spark, repo):
    out = {}
    for rev in ("one", "two", "three"):
        git.register(spark)
        files = spark.read.format("git_files").option("repo", str(repo)).option("rev", rev).load().withColumn("language", F.lit("typescript"))
        out[rev] = api.extract(spark, files, "k"), files
    return out


def test_hunks(spark, repo):
    git.register(spark)
    rows = spark.read.format("git_hunks").option("repo", str(repo)).option("pairs", "one two\ntwo three\none one").load().collect()
    got = {tuple(r) for r in rows}
    assert ("one", "two", "M", "src/users.ts", "src/users.ts", "added", 1, 10) in got
    assert ("two", "three", "M", "src/users.ts", "src/users.ts", "removed", 16, 16) in got
    assert ("two", "three", "M", "src/users.ts", "src/users.ts", "removed", 21, 21) in got and ("two", "three", "M", "src/users.ts", "src/users.ts", "added", 20, 20) in got
    assert ("two", "three", "R", "src/new.ts", "src/old name.ts", None, None, None) in got and len(got) == 5
    below = spark.read.format("git_hunks").option("repo", str(repo)).option("base", "one").option("head", "two").option("subdir", "src").load().collect()
    assert [(r.path, r.side) for r in below] == [("users.ts", "added")]


def test_a_changed_line_is_of_one_declaration(spark, repo, graphs):
    hunks = spark.read.format("git_hunks").option("repo", str(repo)).option("base", "two").option("head", "three").load()
    found = {(r.id, r.side) for r in changes.touched(hunks, graphs["two"][0].nodes, graphs["three"][0].nodes, "k").collect()}
    assert found == {("k:src/users.ts#UsersRepository.findById", "removed"), ("k:src/users.ts#total", "removed"), ("k:src/users.ts#sum", "added")}
    top = spark.read.format("git_hunks").option("repo", str(repo)).option("base", "one").option("head", "two").load()
    assert {(r.id, r.side) for r in changes.touched(top, graphs["one"][0].nodes, graphs["two"][0].nodes, "k").collect()} == {("k:src/users.ts", "added")}


def test_change_set(spark, repo, graphs):
    """Lines on top change nothing; a condition that went is one READS less; what was renamed keeps its dependencies."""
    told = lambda a, b: {r.id: r for r in api.changes(spark, graphs[a], graphs[b], "k", spark.read.format("git_hunks").option("repo", str(repo)).option("base", a).option("head", b).load()).collect()}
    assert told("one", "two") == {}
    found = told("two", "three")
    find = found["k:src/users.ts#UsersRepository.findById"]
    assert find.change == "body" and [(x.type, x.member, x.n) for x in find.lost] == [("READS", "deletedAt", 1)] and find.gained == []
    assert (found["k:src/users.ts#sum"].change, found["k:src/users.ts#sum"].old_id, found["k:src/users.ts#sum"].sure) == ("renamed", "k:src/users.ts#total", True)
    assert found["k:src/new.ts#kept"].change == "renamed" and found["k:src/new.ts#kept"].old_id == "k:src/old name.ts#kept" and found["k:src/new.ts#kept"].lost == []
    assert set(found) == {"k:src/users.ts#UsersRepository.findById", "k:src/users.ts#sum", "k:src/new.ts#kept", "k:src/new.ts#other"}


def test_bags_and_owners(spark):
    nodes = spark.createDataFrame([("f", "File", "f", None, "f"), ("f#a", "Function", "a", "f", "f"), ("f#fn@1:1", "Function", "fn@1:1", "f#a", "f"), ("f#a/call", "Call", "go", "f#fn@1:1", "f"), ("f#v", "Variable", "v", "f", "f"), ("f#a.w", "Variable", "w", "f#a", "f"), ("lost", "Call", "x", "gone", "f")], "id string, type string, name string, owner_id string, file_id string")
    assert {r.id: r.owner for r in changes.declared_owners(nodes).collect()} == {"f": "f", "f#a": "f#a", "f#fn@1:1": "f#a", "f#a/call": "f#a", "f#v": "f#v", "f#a.w": "f#a", "lost": "gone"}
    edges = spark.createDataFrame([("CALLS", "f#a/call", "ext:go", None, None), ("ARGUMENT", "f#a/call", "f#a.w", None, 0), ("READS", "f#a", "f#a/call", None, None), ("CONTAINS", "f#a", "f#a/call", None, None)], "type string, src string, dst string, member string, idx int")
    bags = {tuple(r) for r in changes.dependency_bags(Graph(nodes, edges)).collect()}
    assert bags == {("f#a", "CALLS", "ext:go", "go", None), ("f#a", "ARGUMENT", "f#a/Variable:w", "go", 0), ("f#a", "READS", "f#a/Call:go", None, None)}
    one = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    two = spark.createDataFrame([(1,), (3,), (None,), (None,)], "x int")
    assert {tuple(r) for r in history.bag_difference(one, two).collect()} == {(1, -1), (2, -1), (3, 1), (None, 1)}


def test_change_set_of_small_graphs(spark):
    """A renamed file, a renamed symbol in it, a body that changed, one that came and one that went; dependencies follow names."""
    columns = "id string, type string, name string, owner_id string, file_id string, start_line int"
    node = lambda f, n, line: (f"{f}#{n}", "Function", n, f, f, line)
    base = Graph(spark.createDataFrame([node("k:a", "keep", 1), node("k:a", "old", 5), node("k:a", "gone", 9), node("k:b", "user", 1), node("k:b", "fix", 4)], columns), spark.createDataFrame([("CALLS", "k:b#user", "k:a#old", "old", None), ("READS", "k:b#fix", "k:a#keep", None, None), ("READS", "k:b#user", "x", None, None)], "type string, src string, dst string, member string, idx int"))
    head = Graph(spark.createDataFrame([node("k:n", "keep", 1), node("k:n", "new", 5), node("k:b", "user", 3), node("k:b", "fix", 4), node("k:b", "fresh", 9)], columns), spark.createDataFrame([("CALLS", "k:b#user", "k:n#new", "old", None), ("READS", "k:b#user", "x", None, None), ("READS", "k:b#user", "x", None, None), ("READS", "k:b#fix", "k:n#keep", None, None)], "type string, src string, dst string, member string, idx int"))
    hashes = lambda rows: spark.createDataFrame([(i, "s", b, b) for i, b in rows], "id string, signature string, body string, whole string")
    got = changes.change_set(base, head, hashes([("k:a#keep", "1"), ("k:a#old", "2"), ("k:a#gone", "3"), ("k:b#user", "4"), ("k:b#fix", "5")]), hashes([("k:n#keep", "1"), ("k:n#new", "2"), ("k:b#user", "4"), ("k:b#fix", "6"), ("k:b#fresh", "7")]), spark.createDataFrame([("k:a", "k:n")], "old_file string, new_file string"))
    told = {r.id: r for r in got.collect()}
    assert {(i, r.change, r.old_id) for i, r in told.items()} == {("k:n#keep", "renamed", "k:a#keep"), ("k:n#new", "renamed", "k:n#old"), ("k:n#gone", "removed", None), ("k:b#user", "deps", None), ("k:b#fix", "body", None), ("k:b#fresh", "added", None)}
    assert [(x.type, x.target, x.n) for x in told["k:b#user"].gained] == [("READS", "x", 1)] and told["k:b#user"].lost == [] and told["k:b#fix"].lost == []


def test_patch_of_odd_names():
    out = 'a b\n:100644 100644 1 2 M\t"src/q\\"uote\\tx.ts"\ndiff --git "a/src/q\\"uote" x\n@@ -0,0 +1 @@\n+@@ -9 +9 @@\n+diff --git a b\n:000000 x\n'
    assert list(git.parse_patch(out.split("\n:000000")[0] + "\n", {("a", "b"): ("p", "q")})) == [("p", "q", "M", 'src/q"uote\tx.ts', 'src/q"uote\tx.ts', "added", 1, 1)]
