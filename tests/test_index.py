"""The index over several runs, memory tables and the registry of sources."""
import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from corpusflow.operators import index as ix, runs
from corpusflow.plans.retrieve import document_chunks
from corpusflow.session import scratch_path

c = F.col


def chunks(spark, rows):
    """rows: (namespace, doc_id, text)"""
    df = spark.createDataFrame(rows, "namespace string, doc_id string, page_content string")
    return df.select("namespace", F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id", F.lit(0).alias("ord"), "page_content",
                     F.create_map(F.lit("source"), "namespace").alias("metadata"))


def counts(df):
    return {r.namespace: (r.added, r.updated, r.skipped, r.deleted) for r in df.collect()}


def held(spark, path, namespace=None):
    return sorted((r.namespace, r.page_content) for r in ix.read_index(spark, path, namespace).collect())


FIRST = [("a", "1", "x"), ("a", "2", "y"), ("a", "3", "x"), ("b", "4", "x")]


def test_runs(spark):
    path = scratch_path(spark, "ix")
    assert held(spark, path) == [] and ix.list_indexes(spark, path).count() == 0
    assert counts(ix.build_index(spark, path, chunks(spark, FIRST))) == {"a": (2, 0, 0, 0), "b": (1, 0, 0, 0)}
    assert held(spark, path) == [("a", "x"), ("a", "y"), ("b", "x")]
    # the first of equal documents is the one kept
    assert {r.chunk_id for r in ix.read_index(spark, path, "a").collect()} == {"1#0", "2#0"}
    # again: nothing new
    assert counts(ix.build_index(spark, path, chunks(spark, FIRST))) == {"a": (0, 0, 2, 0), "b": (0, 0, 1, 0)}
    assert held(spark, path) == [("a", "x"), ("a", "y"), ("b", "x")]
    # a changed document is an add and a delete; namespace b is not part of the run
    run = chunks(spark, [("a", "1", "x"), ("a", "2", "y2"), ("c", "9", "z")])
    assert counts(ix.build_index(spark, path, run)) == {"a": (1, 0, 1, 1), "c": (1, 0, 0, 0)}
    assert held(spark, path) == [("a", "x"), ("a", "y2"), ("b", "x"), ("c", "z")]
    assert {(r.namespace, r.key) for r in ix.read_records(spark, path).collect()} == {
        (r.namespace, r.key) for r in ix.read_index(spark, path).collect()}
    assert ix.read_index(spark, path).where("size(embedding) <> 64 or embedding is null").count() == 0
    assert sorted(r.namespace for r in ix.list_indexes(spark, path).collect()) == ["a", "b", "c"]
    # without clean-up nothing goes
    assert counts(ix.build_index(spark, path, chunks(spark, [("a", "7", "new")]), cleanup=None)) == {"a": (1, 0, 0, 0)}
    assert held(spark, path, "a") == [("a", "new"), ("a", "x"), ("a", "y2")]
    with pytest.raises(ValueError):
        ix.build_index(spark, path, chunks(spark, FIRST), cleanup="other")


def test_records_are_touched(spark):
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, FIRST), cleanup=None)
    before = {(r.namespace, r.key): r.updated_at for r in ix.read_records(spark, path).collect()}
    ix.build_index(spark, path, chunks(spark, [("a", "1", "x")]), cleanup=None)
    after = {(r.namespace, r.key): r.updated_at for r in ix.read_records(spark, path).collect()}
    assert set(before) == set(after) and sum(after[k] > before[k] for k in after) == 1


def test_memory_reset(spark):
    path = scratch_path(spark, "mem")
    ix.memory_save(spark, path, chunks(spark, FIRST))
    assert counts(ix.memory_save(spark, path, chunks(spark, FIRST))) == {"a": (0, 0, 2, 0), "b": (0, 0, 1, 0)}
    only = spark.createDataFrame([("a",)], "namespace string")
    assert counts(ix.memory_reset(spark, path, only)) == {"a": (0, 0, 0, 2)}
    assert held(spark, path) == [("b", "x")]
    assert {r.namespace for r in ix.read_records(spark, path).collect()} == {"b"}
    assert counts(ix.memory_save(spark, path, chunks(spark, FIRST))) == {"a": (2, 0, 0, 0), "b": (0, 0, 1, 0)}
    assert held(spark, path) == [("a", "x"), ("a", "y"), ("b", "x")]


URLS = ["https://a.example/x?y=1&z=%20", "c:\\d", "weird = name/with:all%2Fof it"]


def test_namespaces_that_are_addresses_are_emptied(spark):
    path = scratch_path(spark, "ix")
    rows = [(u, str(i), f"t{i}") for i, u in enumerate(URLS)]
    ix.build_index(spark, path, chunks(spark, rows + [("b", "9", "stays")]))
    assert {n for n, _ in held(spark, path)} == {*URLS, "b"}
    names = spark.createDataFrame([(u,) for u in URLS], "namespace string")
    assert counts(ix.memory_reset(spark, path, names)) == {u: (0, 0, 0, 1) for u in URLS}
    assert held(spark, path) == [("b", "stays")] and [r.namespace for r in ix.list_indexes(spark, path).collect()] == ["b"]
    assert counts(ix.build_index(spark, path, chunks(spark, rows[:1]))) == {URLS[0]: (1, 0, 0, 0)}
    other = scratch_path(spark, "ix")
    ix.compact_index(spark, path, other)
    assert held(spark, other) == held(spark, path) == sorted([(URLS[0], "t0"), ("b", "stays")])
    assert counts(ix.build_index(spark, other, chunks(spark, rows[:1]))) == {URLS[0]: (0, 0, 1, 0)}


def test_counts_are_the_rows_stored(spark):
    path = scratch_path(spark, "ix")
    rows = chunks(spark, [("a", "1", "x"), ("a", "2", None), ("a", "3", "x"), ("a", "4", "")])
    plain = rows.withColumn("metadata", F.when(c("doc_id") != "3", c("metadata")))
    got = counts(ix.build_index(spark, path, plain))
    assert got == {"a": (3, 0, 0, 0)} and ix.read_index(spark, path).count() == 3
    assert counts(ix.build_index(spark, path, plain)) == {"a": (0, 0, 3, 0)}
    for missing in (None, ""):
        with pytest.raises(Exception, match="no namespace"):
            ix.build_index(spark, path, chunks(spark, [(missing, "1", "x")]))


def test_no_chunk_without_an_id_is_lost(spark):
    path = scratch_path(spark, "ix")
    rows = chunks(spark, [("a", None, "x"), ("a", None, "y"), ("a", "1", "x"), ("a", None, "x"), ("b", None, "x"), ("b", None, None)])
    assert counts(ix.build_index(spark, path, rows)) == {"a": (2, 0, 0, 0), "b": (2, 0, 0, 0)}
    assert sorted((r.namespace, r.chunk_id or "", r.page_content or "") for r in ix.read_index(spark, path).collect()) == [
        ("a", "", "y"), ("a", "1#0", "x"), ("b", "", ""), ("b", "", "x")]
    assert counts(ix.build_index(spark, path, rows)) == {"a": (0, 0, 2, 0), "b": (0, 0, 2, 0)}
    docs = spark.createDataFrame([(None, "one", "s"), (None, "two", "s"), (7, "one", "s"), (None, None, "s")], "doc_id long, text string, source string")
    found = {(r.chunk_id, r.page_content) for r in document_chunks(docs).collect()}
    assert len({i for i, _ in found}) == 3 and None not in {i for i, _ in found}


class Killed(Exception):
    pass


@pytest.mark.parametrize("table", ["totals", "gone", "chunks", "commit"])
def test_a_run_that_dies_is_never_seen(spark, monkeypatch, table):
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, FIRST))
    before = held(spark, path), runs.snapshot(spark, path)
    store = ix._store

    def dying(rows, path, name, run):
        store(rows, path, name, run)
        if name == table:
            raise Killed

    def dead(*_):
        raise Killed
    changed = chunks(spark, [("a", "1", "x"), ("a", "8", "new"), ("d", "1", "other")])
    with monkeypatch.context() as m:
        m.setattr(*((runs, "commit", dead) if table == "commit" else (ix, "_store", dying)))
        with pytest.raises(Killed):
            ix.build_index(spark, path, changed)
    assert (held(spark, path), runs.snapshot(spark, path)) == before
    assert sorted(r.namespace for r in ix.list_indexes(spark, path).collect()) == ["a", "b"]
    assert counts(ix.build_index(spark, path, changed)) == {"a": (1, 0, 1, 1), "d": (1, 0, 0, 0)}
    assert held(spark, path) == [("a", "new"), ("a", "x"), ("b", "x"), ("d", "other")]
    # what the dead run left is found by age and removed, what is visible stays
    left = runs.vacuum(spark, path, list(ix.TABLES), older_than=-1)
    assert left >= 1 and held(spark, path) == [("a", "new"), ("a", "x"), ("b", "x"), ("d", "other")]
    assert runs.vacuum(spark, path, list(ix.TABLES), older_than=-1) == 0


def test_of_two_writers_one_plans_anew(spark, monkeypatch):
    """The second writer's run becomes visible while the first is about to commit."""
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, FIRST))
    commit, meanwhile = runs.commit, []

    def late(*args):
        if not meanwhile:
            meanwhile.append(1)
            assert counts(ix.build_index(spark, path, chunks(spark, [("a", "5", "both"), ("a", "1", "x")]))) == {"a": (1, 0, 1, 1)}
        return commit(*args)
    monkeypatch.setattr(runs, "commit", late)
    # planned again: what both add is there once, and y is already gone
    assert counts(ix.build_index(spark, path, chunks(spark, [("a", "6", "both"), ("a", "7", "mine")]))) == {"a": (1, 0, 1, 1)}
    assert held(spark, path) == [("a", "both"), ("a", "mine"), ("b", "x")]
    base = runs.snapshot(spark, path)
    assert commit(spark, path, base, list(base.runs)) and not commit(spark, path, base, [])
    assert runs.snapshot(spark, path) == runs.Snapshot(base.number + 1, base.runs)
    monkeypatch.setattr(runs, "commit", lambda *_: False)
    with pytest.raises(runs.RunConflict):
        ix.build_index(spark, path, chunks(spark, [("a", "9", "never")]))
    assert held(spark, path) == [("a", "both"), ("a", "mine"), ("b", "x")]


def test_namespaces_come_from_the_counts(spark):
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, FIRST))
    ix.memory_reset(spark, path, spark.createDataFrame([("a",)], "namespace string"))
    plan = plan_text(ix.list_indexes(spark, path))
    assert "/totals/" in plan and "/chunks/" not in plan and "/gone/" not in plan and "Join" not in plan
    assert [r.namespace for r in ix.list_indexes(spark, path).collect()] == ["b"]


def test_nothing_is_joined_before_the_first_delete(spark):
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, FIRST))
    assert "Join" not in plan_text(ix.read_index(spark, path))
    ix.build_index(spark, path, chunks(spark, [("a", "1", "x")]))
    assert "Join" in plan_text(ix.read_index(spark, path)) and held(spark, path) == [("a", "x"), ("b", "x")]


def test_many_runs_are_merged(spark):
    """Runs that add, touch, delete and add again; what is held never changes by merging."""
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, [("a", str(i), f"t{i}") for i in range(200)] + [("b", "1", "x")]))
    for texts in (["n1"], ["n2", "t3"], ["n3"]):
        ix.build_index(spark, path, chunks(spark, [("a", "1", t) for t in texts]), cleanup=None)
    stay = [*(f"t{i}" for i in range(3, 200)), "n2", "again"]
    ix.build_index(spark, path, chunks(spark, [("a", "1", t) for t in stay]))
    ix.build_index(spark, path, chunks(spark, [("a", "1", "t1"), ("b", "1", "x")]), cleanup=None)
    want = {("a", t) for t in [*stay, "t1"]} | {("b", "x")}
    before = {(r.namespace, r.key): r.updated_at for r in ix.read_records(spark, path).collect()}
    number, many = runs.current_number(spark, path), len(runs.snapshot(spark, path).runs)
    assert ix.merge_runs(spark, path, many=4) and set(held(spark, path)) == want
    state = runs.snapshot(spark, path)
    assert state.number == number + 1 and 1 < len(state.runs) < many and state.having("gone")
    assert {(r.namespace, r.key): r.updated_at for r in ix.read_records(spark, path).collect()} == before
    assert ix.merge_runs(spark, path, many=1) and len(runs.snapshot(spark, path).runs) == 1
    assert set(held(spark, path)) == want and not runs.snapshot(spark, path).having("gone") and not ix.merge_runs(spark, path, many=1)
    assert counts(ix.build_index(spark, path, chunks(spark, [("a", "1", t) for t in ("t3", "t0")]))) == {"a": (1, 0, 1, 199)}
    assert sorted(r.namespace for r in ix.list_indexes(spark, path).collect()) == ["a", "b"]


def test_late_small_runs_are_chosen():
    def state(*rows):
        return runs.Snapshot(len(rows), tuple(runs.Run(str(i), 0.0, ["chunks"], n) for i, n in enumerate(rows)))
    assert runs.late_runs(state(*[1] * 16)) == []
    assert [r.id for r in runs.late_runs(state(1000, *[1] * 16))] == [str(i) for i in range(1, 17)]
    assert [r.rows for r in runs.late_runs(state(10 ** 9, 10 ** 6, *[10] * 20))] == [10] * 20
    assert len(runs.late_runs(state(*[10 ** (20 - i) for i in range(20)]))) >= 5


def test_a_small_run_does_not_shuffle_the_stored_keys(spark):
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, [("a", str(i), f"t{i}") for i in range(50)]))
    stored = ix.read_index(spark, path)
    new = spark.read.parquet(path + "/chunks").select("namespace", "key").limit(1)
    plan = plan_text(stored.select("namespace", "key").join(new, ["namespace", "key"], "left_semi"))
    assert "BroadcastHashJoin LeftSemi" in plan


def test_only_new_keys_are_embedded(spark, tmp_path):
    seen = str(tmp_path / "seen")

    @F.udf("array<float>")
    def note(text):
        with open(seen, "a") as out:
            out.write(text + "\n")
        return [1.0]
    path = scratch_path(spark, "ix")
    ix.build_index(spark, path, chunks(spark, FIRST), embedder=note)
    open(seen, "w").close()
    ix.build_index(spark, path, chunks(spark, FIRST + [("b", "5", "fresh")]), embedder=note)
    assert open(seen).read() == "fresh\n"


def test_namespace_is_pruned(spark):
    path = scratch_path(spark, "ix")
    ix.write_index(ix.fingerprint(chunks(spark, FIRST)).withColumn("embedding", F.lit(None).cast("array<float>")), path)
    plan = plan_text(ix.read_index(spark, path, "a").select("key"))
    assert "PartitionFilters: [isnotnull(namespace" in plan and "page_content" not in plan
    ix.write_index(ix.fingerprint(chunks(spark, [("b", "8", "w")])).withColumn("embedding", F.lit(None).cast("array<float>")), path)
    assert held(spark, path) == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "w")]


def test_refresh_and_labels(spark):
    configured = spark.createDataFrame([("h1", "web"), ("h2", "web"), ("h3", "ftp")], "hash string, source_type string")
    local = spark.createDataFrame([("h1", "One"), ("h9", "Gone")], "hash string, label string")
    assert {r.hash for r in ix.sources_to_refresh(configured, local).collect()} == {"h2", "h3"}
    assert ix.sources_to_refresh(configured, local, force=True).count() == 3
    assert {r.hash for r in ix.orphan_labels(configured, local).collect()} == {"h9"}
    with pytest.raises(Exception, match="Unknown source type: ftp"):
        ix.sources_to_refresh(configured, local, known_types=["web"]).collect()
    assert {r.hash for r in ix.register_labels(local, configured.select("hash")).collect()} == {"h2", "h3"}
    indexes = spark.createDataFrame([("h9",)], "namespace string")
    assert [r.label for r in ix.available_labels(local, indexes).collect()] == ["Gone"]
    twice = spark.createDataFrame([("h2", "L"), ("h1", "L")], "hash string, label string")
    asked = spark.createDataFrame([("L",), ("M",)], "label string")
    assert {r.label: r.hash for r in ix.resolve_label(asked, twice).collect()} == {"L": "h1", "M": "none"}


def test_select_source(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "namespace string, x int")
    assert [ix.select_source(index, s).count() for s in ("all", "none", "a", "zzz")] == [2, 0, 1, 0]


def test_metadata_is_part_of_identity(spark):
    df = spark.createDataFrame([("t", {"a": "1", "b": "2"}), ("t", {"b": "2", "a": "1"}), ("t", {"a": "1"})],
                               "page_content string, metadata map<string,string>")
    keys = [r.key for r in ix.fingerprint(df).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from corpusflow.session import shared_dir
    used = []
    context = SimpleNamespace(master="spark://host:1", getCheckpointDir=lambda: used[-1] if used else None, setCheckpointDir=used.append)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf={}))
    assert shared_dir(SimpleNamespace(sparkContext=context, conf={"spark.checkpoint.dir": "hdfs://x/scratch"})) == "hdfs://x/scratch"


def test_scratch_tables_can_be_dropped(spark):
    from corpusflow.session import drop_scratch, read_or_empty
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert f"/{spark.sparkContext.applicationId}/" in path and read_or_empty(spark, path, "id long").count() == 3
    drop_scratch(spark, path)
    assert read_or_empty(spark, path, "id long").count() == 0


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:1", "localhost", "k8s://local"])
def test_only_local_sessions_may_do_without_a_shared_folder(master):
    from types import SimpleNamespace

    from corpusflow.session import shared_dir
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf={}))
