"""Files through the data source, and runs that write what is new."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.commits import Store
from tidemark.sources import connectors, files
from tidemark.sources.connectors import Connector


def log_connector():
    """Its segmenter is defined within a function, so that it travels to workers that cannot import the tests."""
    return Connector("log", r"^logs/[^/]+\.jsonl$", lambda body, day=None: [(x, True) for x in body.split("\n")], connectors.json_lines("k", "text"))


LOG = log_connector()


@pytest.fixture
def root(tmp_path):
    told = {
        "a.md": "# One\n\nFirst text, dated 2024-05-06.", "interviews/x/b.md": "Second text.", "chat/c.md": "**Mon 10:00 — Ann**\nhello\n\n**Mon 10:05 — Bo**\nyes",
        "email/d.md": "From: Ann\nSubject: Plans\nDate: 3 May 2024\n\nThe body.", "_hidden/e.md": "no", "chat/.f.md": "no", "other.txt": "no",
        "logs/l.jsonl": "\n".join(json.dumps({"k": k, "text": f"line {k}\nnext"}) for k in range(5)),
    }
    for path, text in told.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return str(tmp_path)


def read(spark, root, **options):
    return spark.read.format("tidemark").options(**options).load(root)


def test_standard_files_are_those_of_the_plain_listing(spark, root):
    connectors.register(spark)
    key = lambda df: sorted((r["source_uri"], r["source_type"], bytes(r["content"])) for r in df.collect())
    found = key(read(spark, root))
    assert [x[:2] for x in found] == [("a.md", "markdown"), ("chat/c.md", "chat"), ("email/d.md", "email"), ("interviews/x/b.md", "markdown")]
    assert found == [x for x in key(files.discover(spark, root)) if "hidden" not in x[0] and "/." not in x[0]]
    assert key(read(spark, "file://" + root)) == found
    docs = {r["source_uri"]: r for r in files.documents(read(spark, root)).collect()}
    assert docs["email/d.md"]["title"] == "Plans" and str(docs["a.md"]["as_of"]) == "2024-05-06"


def test_files_are_dealt_by_size_and_kinds_pruned(spark, root):
    connectors.register(spark, [*connectors.STANDARD, LOG])
    assert read(spark, root, partitionBytes="1").rdd.getNumPartitions() == 5
    assert read(spark, root).rdd.getNumPartitions() == 1
    own = read(spark, root, partitionBytes="1", connectors="chat")
    assert own.rdd.getNumPartitions() == 1 and own.count() == 1
    whole = read(spark, root)
    assert whole.where("source_type = 'chat'").unionByName(whole.where("source_type = 'log'")).count() == 6
    assert {r[0] for r in read(spark, root, connectors="chat, email").select("source_type").collect()} == {"chat", "email"}
    with pytest.raises(Exception, match="no such connector: fax"):
        read(spark, root, connectors="fax").count()


def test_a_reader_of_ones_own_gives_many_documents_of_a_file(spark, root):
    connectors.register(spark, [*connectors.STANDARD, LOG])
    own = read(spark, root).where("source_type = 'log'")
    assert sorted((r["source_uri"], bytes(r["content"]).decode()) for r in own.collect()) == [(f"logs/l.jsonl#{k}", f"line {k}\nnext") for k in range(5)]
    cut = files.segments(files.documents(own), connectors.segmenters([LOG]))
    assert all([s["text"] for s in r["segments"]] == r["raw_text"].split("\n") for r in cut.collect())


def test_a_file_that_two_connectors_take_is_an_error(spark, root):
    connectors.register(spark, [*connectors.STANDARD, Connector("talk", r"^chat/")])
    with pytest.raises(Exception, match="more than one connector takes chat/"):
        read(spark, root).count()
    with pytest.raises(ValueError, match="one name"):
        connectors.register(spark, [LOG, LOG])
    connectors.register(spark)


def test_runs_write_what_is_new_and_nothing_twice(spark, root, tmp_path):
    every = [*connectors.STANDARD, LOG]
    connectors.register(spark, every)
    store = Store(spark, str(tmp_path / "_store"))
    run = lambda found, **more: {r["figure"]: r["n"] for r in connectors.ingest(store, found, every, **more).collect()}
    part = read(spark, root, connectors="markdown,chat")
    assert run(part) == {"documents_added": 3, "documents_known": 0, "chunks_added": 3} and store.version() == 1
    assert run(part) == {"documents_added": 0, "documents_known": 3, "chunks_added": 0} and store.version() == 1
    assert run(read(spark, root), mark=("files", 0)) == {"documents_added": 6, "documents_known": 3, "chunks_added": 6}
    (tmp_path / "a.md").write_text("# One\n\nChanged.")
    (tmp_path / "copy.md").write_text("Second text.\n\n")
    assert run(read(spark, root), mark=("files", 0))["documents_added"] == 0 and store.version() == 2
    assert run(read(spark, root), mark=("files", 1)) == {"documents_added": 1, "documents_known": 9, "chunks_added": 1}
    docs, chunks = store.read("documents"), store.read("chunks")
    assert sorted(r["id"] for r in docs.collect()) == list(range(1, 11)) and sorted(r["id"] for r in chunks.collect()) == list(range(1, 11))
    placed = chunks.join(docs, chunks["document_id"] == docs["id"]).select("source_uri", "ordinal", "text").collect()
    assert ("chat/c.md", 0, "**Mon 10:00 — Ann**\nhello\n\n**Mon 10:05 — Bo**\nyes") in [tuple(r) for r in placed]


def test_a_run_that_fails_leaves_the_store(spark, root, tmp_path):
    connectors.register(spark)
    store = Store(spark, str(tmp_path / "_store"))
    connectors.ingest(store, read(spark, root, connectors="email"))
    (tmp_path / "blank.md").write_text("  \n")
    with pytest.raises(Exception, match="no text in blank.md"):
        connectors.ingest(store, read(spark, root))
    assert store.version() == 1 and store.read("documents").count() == 1 and store.read("chunks").count() == 1


def test_texts_are_cut_once_and_known_ones_not_at_all(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(20):
        (tmp_path / "in" / f"{k}.note").write_text(f"note {k}")
    calls = str(tmp_path / "calls")

    def segment(body, day):
        with open(calls, "a") as out:
            out.write(body + "\n")
        return [(body, False)]

    own = [Connector("note", r"\.note$", segment)]
    connectors.register(spark, own)
    store = Store(spark, str(tmp_path / "_store"))
    for _ in range(2):
        connectors.ingest(store, read(spark, str(tmp_path / "in")), own)
    connectors.register(spark)
    assert sorted(open(calls).read().split("\n")[:-1]) == sorted(f"note {k}" for k in range(20))


def test_an_address_that_gives_a_text_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.rows").write_text("".join(json.dumps({"n": n, "t": t}) + "\n" for n, t in (("a", "one"), ("a", "one"), ("a", "two"), ("b", "two"))))
    own = [Connector("rows", r"\.rows$", read=connectors.json_lines("n", "t"))]
    connectors.register(spark, own)
    store = Store(spark, str(tmp_path / "_store"))
    got = {r["figure"]: r["n"] for r in connectors.ingest(store, read(spark, str(tmp_path / "in")), own).collect()}
    connectors.register(spark)
    assert got == {"documents_added": 2, "documents_known": 2, "chunks_added": 2}
    assert sorted(r["raw_text"] for r in store.read("documents").collect()) == ["one", "two"] == sorted(r["text"] for r in store.read("chunks").collect())


def test_no_files_at_all(spark, tmp_path):
    connectors.register(spark)
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "_store"))
    assert {r["n"] for r in connectors.ingest(store, read(spark, str(tmp_path / "in"))).collect()} == {0} and store.version() == 0


def test_documents_are_read_in_batches_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BYTES_AT_ONCE", 1000, raising=False)
    (tmp_path / "a.json").write_text("".join(json.dumps({"n": k, "t": "x" * 300}) + "\n" for k in range(40)))
    own = connectors.Connector("j", r"\.json$", read=connectors.json_lines("n", "t"))
    reader = connectors.FilesReader(str(tmp_path), {"j": own}, {"j"}, 1 << 20)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [4] * 10
    assert [x for b in batches for x in b.column("source_uri").to_pylist()] == [f"a.json#{k}" for k in range(40)]
