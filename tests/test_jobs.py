import json
import sys
import types

from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioweave.functions import sql
from folioweave.operators import retrieval
from folioweave.plans import cli, jobs, logs
from folioweave.sources import files, sinks
from folioweave.streaming import arriving


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pages_of(content):
    if content.startswith(b"bad"):
        raise ValueError("not a document")
    return content.decode().split("\f"), {"title": "T"}


def test_preprocess_then_chunk(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.b.pdf").write_bytes("Page 1\nSatu dua.\f \fTiga   empat.".encode())
    (raw / "bad.pdf").write_bytes(b"bad")
    (raw / "empty.pdf").write_bytes(b"")
    (raw / "note.txt").write_bytes(b"x")
    out = str(tmp_path / "cleaned")
    first = jobs.preprocess(spark, str(raw), out, extractor=pages_of, save_metadata=True).first()
    assert (first["total_files"], first["processed"], first["skipped"], first["failed"]) == (3, 1, 0, 2)
    assert [r[0] for r in jobs.output_files(spark, out).collect()] == ["a.b.pdf"]
    assert {(r["source_file"], r["error"]) for r in jobs.failures(spark, out).collect()} == {("bad.pdf", "ValueError: not a document"), ("empty.pdf", "no text")}
    row = spark.read.parquet(out).first()
    assert (row["stem"], row["text"]) == ("a.b", "Satu dua.\nTiga empat.")
    assert row["metadata_text"].startswith("title: T\nauthor: \n") and row["metadata_text"].endswith("page_count: 3")
    again = jobs.preprocess(spark, str(raw), out, extractor=pages_of).first()
    assert (again["processed"], again["skipped"], again["failed"]) == (0, 1, 2)


def _texts(tmp_path):
    src = tmp_path / "texts"
    src.mkdir()
    (src / "a.txt").write_bytes("Kalimat satu. Kalimat dua.\r\nKalimat tiga.".encode())
    (src / "a_metadata.txt").write_bytes(b"title: T")
    (src / "blank.txt").write_bytes(b"  ")
    (src / "empty.txt").write_bytes(b"")
    return src


def test_texts(spark, tmp_path):
    src = _texts(tmp_path)
    got = {r[0]: r[1] for r in files.read_texts(spark, str(src)).collect()}
    assert got == {"a.txt": "Kalimat satu. Kalimat dua.\nKalimat tiga.", "a_metadata.txt": "title: T", "blank.txt": "  ", "empty.txt": ""}
    assert files.read_texts(spark, str(src), exclude_metadata=True).count() == 3
    assert files.read_texts(spark, str(tmp_path / "missing")).count() == 0


def test_chunk_jobs_and_command_line(spark, tmp_path):
    src = _texts(tmp_path)
    stats = jobs.chunk_recursive(spark, str(src), str(tmp_path / "r"), chunk_size=20, chunk_overlap=0).first()
    assert (stats["total_files"], stats["processed"], stats["failed"]) == (4, 2, 2) and stats["total_chunks"] == spark.read.parquet(str(tmp_path / "r")).count()
    stats = jobs.chunk_maxmin(spark, str(src), str(tmp_path / "m")).first()
    assert (stats["processed"], stats["failed"]) == (2, 2)
    assert cli.run(spark, ["recursive", "-i", str(src), "-o", str(tmp_path / "r")]) == 1  # all was skipped
    assert cli.run(spark, ["recursive", "-i", str(src), "-o", str(tmp_path / "c"), "--no-metadata"]) == 0
    assert "metadata" not in spark.read.parquet(str(tmp_path / "c")).columns
    html = tmp_path / "html"
    html.mkdir()
    (html / "p.html").write_text("<h1>A</h1><p>b</p>")
    stats = jobs.chunk_elements(spark, str(html), str(tmp_path / "e")).first()
    assert (stats["processed"], stats["total_chunks"]) == (1, 2)
    assert jobs.chunk_recursive(spark, str(tmp_path / "none"), str(tmp_path / "n")).first()["total_files"] == 0


def test_files_for_each_document(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "files"
    raw.mkdir()
    (raw / "a.b.pdf").write_bytes("Satu é.\fDua.".encode())
    (raw / "bad.pdf").write_bytes(b"bad")
    jobs.preprocess(spark, str(raw), str(tmp_path / "t"), extractor=pages_of, save_metadata=True, files_to=str(out))
    assert {f.name: f.read_text().splitlines()[0] for f in out.iterdir()} == {"a.b.txt": "Satu é.", "a.b_metadata.txt": "title: T"}
    jobs.chunk_recursive(spark, str(out), str(tmp_path / "c"), files_to=(tmp_path / "json").as_uri(), include_metadata=False)
    assert json.loads((tmp_path / "json" / "a.b_chunks.json").read_text()) == [{"chunk_id": 0, "text": "Satu é.\nDua.", "num_characters": 12}]
    assert cli.run(spark, ["recursive", "-i", str(out), "-o", str(tmp_path / "d"), "--files", str(tmp_path / "more")]) == 0
    assert sorted(f.name for f in (tmp_path / "more").iterdir()) == ["a.b_chunks.json", "a.b_metadata_chunks.json"]


def test_one_file_again(spark, tmp_path):
    src = _texts(tmp_path)
    out = str(tmp_path / "r")
    jobs.chunk_recursive(spark, str(src), out)
    (src / "a.txt").write_text("Baru.")
    stats = jobs.chunk_recursive(spark, str(src), out, only="a.txt").first()
    assert (stats["total_files"], stats["processed"]) == (1, 1)
    rows = spark.read.parquet(out)
    assert [r["text"] for r in rows.where("source_file = 'a.txt'").collect()] == ["Baru."]
    assert rows.where("source_file = 'a_metadata.txt'").count() == 1


def test_functions_in_sql(spark):
    sql.register(spark)
    row = spark.sql("SELECT clean_text('Page 1\na\n12\nb [3]') AS c, split_sentences('A b. C? d') AS s, l2_norm(array(3D, 4D)) AS n, dot_product(array(1D, 2D), array(3D, 4D)) AS d, sigmoid(0D) AS g").first()
    assert (row["c"], row["s"], row["n"], row["d"], row["g"]) == ("a b", ["A b.", "C?", "d"], 5.0, 11.0, 0.5)
    rows = spark.sql("SELECT d.id, c.* FROM VALUES (1, 'one two three'), (2, NULL) AS d(id, t), LATERAL recursive_chunks(d.t, 8, 0) AS c ORDER BY id, chunk_id").collect()
    assert [(r["id"], r["chunk_id"], r["text"]) for r in rows] == [(1, 0, "one two"), (1, 1, "three")]


def test_jobs_log_what_failed(spark, tmp_path):
    src, log = _texts(tmp_path), str(tmp_path / "log")
    jobs.chunk_recursive(spark, str(src), str(tmp_path / "r"), log_dir=log)
    rows = files.read_log(spark, log).collect()
    assert {r["logger"] for r in rows} == {"folioweave.recursive"} and sorted(r["message"] for r in rows if r["level"] == "ERROR") == ["failed: blank.txt: no chunks", "failed: empty.txt: no chunks"]
    assert rows[0]["message"].startswith("started: ") and any(r["message"] == "finished: 4 files, 2 processed, 0 skipped, 2 failed" for r in rows)
    with logs.job_log("quiet") as quiet:
        assert not quiet.handlers


def test_only_new_files_are_read(spark, tmp_path):
    src, out = _texts(tmp_path), str(tmp_path / "r")
    (src / "odd [1]{2}*?.txt").write_text("Lagi.")
    jobs.chunk_recursive(spark, str(src), out)
    assert "odd [1]{2}*?.txt" in {r[0] for r in jobs.output_files(spark, out).collect()}
    (src / "b.txt").write_text("Baru.")
    chosen = files.names(spark, str(src), "*.txt").where("source_file = 'b.txt'")
    found = files.read_some(spark, str(src), "*.txt", chosen)
    assert [(r["source_file"], bytes(r["content"])) for r in found.collect()] == [("b.txt", b"Baru.")]
    plan = found._jdf.queryExecution().executedPlan().toString()  # files without a byte are looked for by length alone
    assert "EqualTo(length,0)" in plan
    stats = jobs.chunk_recursive(spark, str(src), out).first()
    assert (stats["processed"], stats["skipped"], stats["failed"]) == (1, 3, 2)


def test_a_table_that_was_moved_aside_comes_back(spark, tmp_path):
    src, out = _texts(tmp_path), tmp_path / "r"
    jobs.chunk_recursive(spark, str(src), str(out))
    out.rename(tmp_path / "r.old")
    assert jobs.chunk_recursive(spark, str(src), str(out)).first()["skipped"] == 2
    assert not (tmp_path / "r.old").exists()


def test_models_of_the_command_line(monkeypatch):
    seen = {}

    class Llama:
        def __init__(self, **options):
            seen.update(options)

        def embed(self, text):
            return [float(len(text)), 1.0]

    class SentenceTransformer:
        def __init__(self, name, **options):
            seen.update(options, name=name)

        def encode(self, texts, **options):
            seen.update(options)
            return [[1.0, float(len(t))] for t in texts]

    monkeypatch.setitem(sys.modules, "llama_cpp", types.SimpleNamespace(Llama=Llama, LLAMA_POOLING_TYPE_LAST=3))
    monkeypatch.setitem(sys.modules, "sentence_transformers", types.SimpleNamespace(SentenceTransformer=SentenceTransformer))
    model = cli.embedder(cli.parser().parse_args(["maxmin", "--gguf", "m.gguf", "--n-gpu-layers", "4"]))()
    assert model(["ab", "c"]).tolist() == [[2.0, 1.0], [1.0, 1.0]] and (seen["model_path"], seen["n_gpu_layers"], seen["pooling_type"]) == ("m.gguf", 4, 3)
    model = cli.embedder(cli.parser().parse_args(["maxmin", "--no-gguf", "-m", "x/y", "--device", "cpu", "--low-memory", "--batch-size", "2", "-t", "0.5"]))()
    assert model(["abc"]).tolist() == [[1.0, 3.0]] and (seen["name"], seen["device"], seen["batch_size"], seen["model_kwargs"]) == ("x/y", "cpu", 2, {"torch_dtype": "float16"})
    assert cli.embedder(cli.parser().parse_args(["maxmin", "--embedder", "folioweave.operators.embed:hashing"]))()(["a b"]).shape == (1, 64)


def scanned(content, strategy, languages):
    return iter([("NarrativeText", f"{strategy} {languages} {len(content)}", None)])


def test_strategy_reaches_the_partitioner(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF")
    jobs.chunk_elements(spark, str(tmp_path / "in"), str(tmp_path / "e"), partitioner=scanned, pattern="*.pdf", strategy="fast", languages=["ind"])
    assert spark.read.parquet(str(tmp_path / "e")).first()["text"] == "fast ['ind'] 4"
    assert cli.parser().parse_args(["element"]).strategy == "hi_res"


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("s", 1, "é"), ("s", 0, None)], "source_file string, chunk_id int, text string")
    assert sinks.chunks_json(chunks, "source_file", pretty=False).first()["json"] == '[{"chunk_id":0,"text":null},{"chunk_id":1,"text":"é"}]'
    sinks.write_chunks(chunks, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_log(spark, tmp_path):
    (tmp_path / "x.log").write_text("2025-11-20 23:36:02,123 - prep - INFO - done - ok\nTraceback\n")
    rows = files.read_log(spark, str(tmp_path / "x.log")).collect()
    assert [tuple(r)[1:] for r in rows] == [("prep", "INFO", "done - ok"), (None, None, "Traceback")]
    assert str(rows[0]["ts"]) == "2025-11-20 23:36:02.123000"


def test_stream(spark, tmp_path):
    src = _texts(tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        q = arriving.write(arriving.clean_and_chunk(arriving.arriving_texts(spark, str(src))), out, state)
        q.awaitTermination(120)

    run()
    assert {r[0] for r in spark.read.parquet(out).select("source_file").collect()} == {"a.txt", "a_metadata.txt"}
    (src / "b.txt").write_text("Baru.")
    run()
    assert spark.read.parquet(out).where("source_file = 'b.txt'").count() == 1
    assert spark.read.parquet(out).where("source_file = 'a.txt'").count() == 1


def test_retrieval(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    assert [r["id"] for r in retrieval.top_k(rows, "v", [1.0, 0.0], "id", 2).collect()] == [1, 2]
    assert [r["id"] for r in retrieval.mmr(rows, "v", [1.0, 0.0], "id", k=2, weight=0.3).collect()] == [1, 3]
    assert retrieval.above(rows, "v", [1.0, 0.0], 2.0).count() == 0
    changed = retrieval.upsert(rows, spark.createDataFrame([(4, [5.0, 5.0]), (9, [1.0, 1.0])], "id int, v array<double>"), "id")
    assert {r["id"] for r in changed.collect()} == {1, 2, 3, 4, 9} and changed.where(F.col("id") == 4).first()["v"] == [5.0, 5.0]
