import json

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.operators import maintain
from quern.operators.vector import HashEmbedder
from quern.plans.engine import Engine
from quern.plans.index import Index
from quern.sources import files
from quern.streaming import incremental
from tests.small import MAIL, NOTES, write


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """An index of two collections."""
    root = tmp_path_factory.mktemp("index")
    index = Index(spark, str(root / "store"))
    index.add_collection("notes", write(root / "notes", NOTES))
    index.add_collection("mail", write(root / "mail", MAIL))
    counts = index.index(recalibrate=False)
    return index, counts


def request(spark, query, **more):
    row = {"qid": "q", "query": query, "mode": "hybrid", "collections": [], "limit": 10, "min_score": None, "truncate": "off"} | more
    return spark.createDataFrame([tuple(row.values())], "qid string, query string, mode string, collections array<string>, limit int, min_score double, truncate string")


def test_first_index(built):
    index, counts = built
    assert counts == {"added": 4, "updated": 0, "removed": 0, "unchanged": 0, "embedded": 4}
    assert {r.name: r.value for r in index.engine().status().collect()} == {"documents": 4, "chunks": 4, "vectors": 4, "collection:notes": 3, "collection:mail": 1}
    assert [(r["name"], r["documents"]) for r in index.collections().collect()] == [("mail", 1), ("notes", 3)]


def test_search_modes(spark, built):
    e = built[0].engine()
    assert e.search(request(spark, "glaze feldspar whiting", mode="lexical")).orderBy("rank").first().relpath == "glaze.md"
    assert e.search(request(spark, "smoke colony frames")).orderBy("rank").first().relpath == "hives.md"
    hit = e.search(request(spark, "pilots gauge harbour", mode="vector")).orderBy("rank").first()
    assert hit.relpath == "tides.md" and hit.snippet.startswith("# Reading tide tables Harbour") and hit.sources.keys() == {"vector"}
    assert {r.collection for r in e.search(request(spark, "celadon", collections=["mail"])).collect()} == {"mail"}
    with pytest.raises(ValueError):
        e.search(request(spark, "x", mode="other"))
    with pytest.raises(ValueError):
        e.search(request(spark, "x", truncate="nonsense"))


def test_a_batch_of_mixed_requests_equals_single_ones(spark, built):
    e = built[0].engine()
    some = [request(spark, "celadon feldspar", qid="a"), request(spark, "celadon", qid="b", mode="lexical", limit=1), request(spark, "gauge", qid="c", mode="vector", truncate="knee"), request(spark, "smoke", qid="d", min_score=0.05, collections=["notes"])]
    batch = some[0].unionByName(some[1]).unionByName(some[2]).unionByName(some[3])
    shown = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9), r.snippet) for r in df.collect())
    single = []
    for r in some:
        single += shown(e.search(r))
    assert shown(e.search(batch)) == sorted(single)


def test_get(built):
    e = built[0].engine()
    row = e.get("notes/glaze.md").first()
    assert row.body == NOTES["glaze.md"] and e.get(f"#{row.docid}").first().doc_id == row.doc_id
    assert e.get("notes/glaze.md", head=True).first().body == NOTES["glaze.md"].rstrip("\n") and e.get("no/such").count() == 0


def test_incremental_index(spark, tmp_path):
    index = Index(spark, str(tmp_path / "store"))
    root = tmp_path / "notes"
    index.add_collection("notes", write(root, NOTES))
    index.index(recalibrate=False)
    assert index.index(recalibrate=False) == {"added": 0, "updated": 0, "removed": 0, "unchanged": 3, "embedded": 0}
    before = {r.relpath: r.doc_id for r in index.store.read("documents").collect()}
    import os

    (root / "tides.md").write_text("# Reading tide tables\n\nBuoys replace pilots.\n")
    os.utime(root / "tides.md", (2_000_000_000, 2_000_000_000))
    (root / "glaze.md").unlink()
    assert index.index(recalibrate=False) == {"added": 0, "updated": 1, "removed": 1, "unchanged": 1, "embedded": 1}
    after = {r.relpath: r.doc_id for r in index.store.read("documents").collect()}
    assert after["hives.md"] == before["hives.md"] and after["tides.md"] not in before.values() and "glaze.md" not in after
    hits = index.engine().search(request(spark, "buoys", mode="lexical")).collect()
    assert [h.relpath for h in hits] == ["tides.md"] and index.engine().search(request(spark, "whiting", mode="lexical")).count() == 0
    # a lost vector is made again, alone
    v = index.store.read("vectors")
    index.store.write(vectors=v.where(F.col("chunk_id") != v.agg(F.min("chunk_id")).first()[0]))
    assert index.embed() == 1
    index.store.vacuum()
    assert index.store.read("vectors").count() == 2
    index.remove_collection("notes")
    assert index.store.read("documents").count() == index.store.read("postings").count() == 0


def test_pins(spark, built):
    with pytest.raises(maintain.PinError):
        Index(spark, built[0].store.root, HashEmbedder(32)).embed()
    with pytest.raises(maintain.PinError):
        Index(spark, built[0].store.root, profile="other").embed()


def envelope(spark, built, query, floor=None, **more):
    e = built[0].engine()
    e.floor = floor
    return json.loads(e.envelopes(request(spark, query, **more)).first().envelope)


def test_envelope_of_results(spark, built):
    x = envelope(spark, built, "celadon feldspar")
    assert x["status"] == "ok" and x["results"][0]["path"] == "notes/glaze.md" and x["summary"]["confidence"] == "strong"
    assert x["summary"]["source_mix"]["both"] >= 1 and x["diagnostics"]["filters"]["raw_count"] == x["summary"]["result_count"] == 4
    assert x["next_actions"][0]["intent"] == "inspect_best_match" and x["next_actions"][0]["command"][-1] == x["results"][0]["docid"]
    assert x["diagnostics"]["calibration"] == {"floor_available": False, "floor": None}
    assert x["summary"]["truncation_advice"]["score_profile"]["count"] == 4


def test_envelope_without_results(spark, built):
    x = envelope(spark, built, "celadon", min_score=999.0)
    assert x["status"] == "no_results" and x["summary"]["confidence"] == "none" and "remove_min_score" in [a["intent"] for a in x["next_actions"]]
    assert x["summary"]["truncation_advice"]["recommendation"] is None
    x = envelope(spark, built, "celadon", truncate="abs:2")
    assert x["summary"]["truncation_advice"]["primary_action"] == "disable_truncation" and "disable_truncation" in [a["intent"] for a in x["next_actions"]]
    x = envelope(spark, built, "celadon", collections=["nowhere"])
    assert x["diagnostics"]["unknown_collections"] == ["nowhere"] and x["next_actions"][0]["intent"] == "retry_without_scope"
    x = envelope(spark, built, "celadon", truncate="calibrated", floor=5.0)
    assert x["results"] == [] and x["diagnostics"]["calibration"]["floor"] == 5.0


def test_advice_cases():
    from quern.operators.envelope import Case, advice

    r = {"query": "x", "mode": "hybrid", "collections": [], "limit": 10, "min_score": None, "truncate": "off"}
    flat = {"flat": False}
    pick = lambda *c: (lambda a: (a["recommendation"], a["primary_action"], a["lean"]))(advice(r, flat, Case(*c)))
    assert pick("off", 10, 10, True, False, 10, 10, 0) == ("knee", "clean_shortlist", "balanced")
    assert pick("off", 3, 3, False, True, 3, 3, 0) == ("off", "keep_current", "recall")
    assert pick("knee", 3, 10, True, False, 10, 10, 7) == ("knee", "keep_current", "balanced")
    assert pick("knee", 10, 10, False, False, 10, 10, 0) == ("off", "disable_truncation", "recall")
    assert pick("calibrated", 2, 10, True, True, 10, 10, 8) == ("calibrated", "keep_current", "purity")
    assert pick("calibrated", 2, 10, True, False, 10, 10, 8) == ("knee", "clean_shortlist", "balanced")
    assert pick("calibrated", 0, 10, True, True, 10, 10, 10) == ("knee", "clean_shortlist", "balanced")
    assert pick("calibrated", 0, 2, False, True, 2, 2, 2) == ("off", "disable_truncation", "recall")
    assert pick("off", 0, 0, False, False, 0, 0, 0) == (None, None, None)


def test_empty_index(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    x = json.loads(index.engine().envelopes(request(spark, "anything")).first().envelope)
    assert x["status"] == "empty_index" and [a["intent"] for a in x["next_actions"]] == ["add_collection", "index"]


def test_calibration_of_an_index(spark, built):
    got = built[0].engine().calibrate(sample=50, negatives=20).first()
    again = built[0].engine().calibrate(sample=50, negatives=20).first()
    assert got == again and got.n_neg == 20 and got.n_pos >= 3 and got.floor >= 0 and len(got.curve) == 15


def test_stream_of_documents_and_queries(spark, tmp_path):
    index = Index(spark, str(tmp_path / "store"))
    write(tmp_path / "in", {"a.json": json.dumps({"relpath": "x.md", "mtime": 1.0, "body": "# X\n\nfirst wording"})})
    stream = lambda: spark.readStream.schema("relpath string, mtime double, body string").json(str(tmp_path / "in"))
    incremental.follow(stream(), index, "live", str(tmp_path / "cp")).awaitTermination()
    write(tmp_path / "in", {"b.json": json.dumps({"relpath": "x.md", "mtime": 2.0, "body": "# X\n\nsecond wording"}) + "\n" + json.dumps({"relpath": "y.md", "mtime": 2.0, "body": "other"})})
    incremental.follow(stream(), index, "live", str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.relpath, "second" in r.body) for r in index.store.read("documents").collect()) == [("x.md", True), ("y.md", False)]
    write(tmp_path / "q", {"a.json": json.dumps({"qid": "1", "query": "second wording"})})
    q = spark.readStream.schema("qid string, query string").json(str(tmp_path / "q"))
    incremental.answer(q, index.engine(), str(tmp_path / "out"), str(tmp_path / "cq")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).orderBy("rank").first().relpath == "x.md"


def test_files(spark, tmp_path):
    root = write(tmp_path / "r", {"a.md": "x\r\ny\rz", "sub/b.txt": "b", "sub/deep/c.md": "c", "d.py": "d"})
    (tmp_path / "r/bad.txt").write_bytes(b"\xff\xfe ok")
    got = {r.relpath: r.body for r in files.read_texts(spark, root).collect()}
    assert got == {"a.md": "x\ny\nz", "sub/b.txt": "b", "sub/deep/c.md": "c", "bad.txt": "�� ok"}
    names = lambda *g: sorted(r.relpath for r in files.scan(spark, root, g).select("relpath").collect())
    assert names("*.md") == ["a.md"] and names("sub/**") == ["sub/b.txt", "sub/deep/c.md"] and names("**/*.md", "a.*") == ["a.md", "sub/deep/c.md"] and names("*.{py,md}") == ["a.md", "d.py"]
    sized = files.scan(spark, root, ("**",))
    assert sorted(r.relpath for r in files.code_files(sized, [".py", ".md"], ["deep"], 6).select("relpath").collect()) == ["a.md", "d.py"]


def test_archives_and_lines(spark, tmp_path):
    import tarfile
    import zipfile

    write(tmp_path / "m", {"one.txt": "1 +++$+++ a +++$+++ hi", "two.txt": "x"})
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "m/one.txt", "one.txt")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        t.add(tmp_path / "m/two.txt", "in/two.txt")
    found = spark.read.format("binaryFile").load([str(tmp_path / "a.zip"), str(tmp_path / "b.tar.gz")])
    assert {(r.member, r.body[0]) for r in files.archive_members(found).collect()} == {("one.txt", "1"), ("in/two.txt", "x")}
    parts = files.delimited(spark.read.text(str(tmp_path / "m/one.txt")), ["id", "who", "text", "more"]).first()
    assert tuple(parts) == ("1", "a", "hi", None)
    lines = spark.createDataFrame([("L1", "ann", "hi"), ("L2", "bob", "ho")], "line_id string, speaker string, text string")
    convs = spark.createDataFrame([(1, "m1", ["L1", "L9", "L2"])], "conv_id long, movie_id string, line_ids array<string>")
    d = files.dialogs(lines, convs, spark.createDataFrame([], "movie_id string, title string")).orderBy("turn").collect()
    assert [(r.turn, r.role, r.text, r.title) for r in d] == [(0, "ann", "hi", "m1"), (2, "bob", "ho", "m1")]
    files.append_jsonl(lines, str(tmp_path / "j"))
    files.append_jsonl(lines, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j")).count() == 4


def test_diff_and_cascade(spark):
    stored = spark.createDataFrame([(1, "a", "h", 1.0), (2, "b", "h", 1.0), (3, "c", "h", 1.0), (4, "d", "h", 1.0)], "doc_id long, relpath string, hash string, mtime double")
    found = spark.createDataFrame([("a", "other", 1.0), ("b", "h", 2.0), ("c", "new", 2.0), ("e", "h", 1.0)], "relpath string, hash string, mtime double")
    changes = maintain.diff(stored, found)
    assert {r.relpath: r.change for r in changes.collect()} == {"a": "unchanged", "b": "touched", "c": "updated", "d": "removed", "e": "added"}
    assert maintain.diff_counts(changes).first().asDict() == {"added": 1, "updated": 1, "removed": 1, "unchanged": 2}
    nxt = {r.relpath: (r.doc_id, r.mtime) for r in maintain.next_documents(stored, found, changes).collect()}
    assert nxt.keys() == {"a", "b", "c", "e"} and nxt["b"] == (2, 2.0) and nxt["c"][0] > 4 and nxt["e"][0] > 4 and nxt["c"][0] != nxt["e"][0]


def test_command_line(spark, tmp_path, capsys):
    write(tmp_path / "n", NOTES)
    run = lambda *a: cli.main(["--root", str(tmp_path / "s"), *a], spark)
    assert run("doctor", "--json") == 0 and json.loads(capsys.readouterr().out)["ok"]
    assert run("collection", "add", str(tmp_path / "n"), "--name", "n") == 0 and run("index", "--no-calibrate") == 0
    assert json.loads(capsys.readouterr().out)["added"] == 3
    assert run("search", "celadon", "--mode", "lexical", "--files") == 0 and capsys.readouterr().out == "n/glaze.md\n"
    assert run("search", "celadon", "--json", "-n", "2") == 0 and json.loads(capsys.readouterr().out)["summary"]["result_count"] == 2
    assert run("get", "n/tides.md", "--head") == 0 and capsys.readouterr().out.startswith("# Reading tide")
    assert run("get", "n/none.md") == 1
    assert run("status") == 0 and "documents  3" in capsys.readouterr().out
    assert run("calibrate", "--sample", "3", "--store") == 0 and "floor" in json.loads(capsys.readouterr().out)
    assert run("collection", "list") == 0 and capsys.readouterr().out.startswith("n  3")


def test_engine_over_a_generated_corpus(spark):
    """Forty known items among a thousand generated notes."""
    from quern.operators import querygen
    from quern.operators.lexical import build_index

    d = querygen.generated_corpus(spark).withColumns({"collection": F.lit("e2e"), "title": F.lit(""), "hash": F.sha2("body", 256), "active": F.lit(True)}).persist()
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("seq"), F.lit(0).alias("pos"), F.length("body").alias("length"))
    embedder = HashEmbedder()
    vectors = d.select(F.col("doc_id").alias("chunk_id"), embedder.documents(F.col("body")).alias("embedding"))
    q = querygen.generated_queries(spark)
    hits = Engine(d, build_index(d, ["title", "body", "relpath"]), chunks, vectors, embedder).search(q.drop("expected")).join(q.select("qid", "expected"), "qid").where("relpath = expected")
    assert q.count() == 40 and hits.count() >= 24
