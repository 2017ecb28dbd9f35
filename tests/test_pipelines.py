import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant import collections, tasks
from sextant.operators import embed
from sextant.sources import tables, vecs
from sextant.streaming import jobs


@pytest.mark.parametrize("kind, values", [("fvecs", [[0.5, -1.0], [2.0, 3.0]]), ("ivecs", [[1, -2], [3, 4]]), ("bvecs", [[0, 255], [7, 8]])])
def test_vector_files(spark, tmp_path, kind, values):
    df = spark.createDataFrame([([float(x) for x in v],) for v in values] + [(None,)], "embedding array<double>")
    assert vecs.write(df.coalesce(1), str(tmp_path), kind) == 2
    assert [r.vector for r in vecs.read(spark, str(tmp_path), kind=kind).collect()] == values
    assert vecs.read(spark, str(tmp_path), 1, kind).count() == 1
    bad = tmp_path / f"x.{kind}"
    bad.write_bytes(vecs.encode(np.array([[1, 2]]), kind) + vecs.encode(np.array([[1, 2, 3]]), kind))
    with pytest.raises(Exception, match="dimensions"):
        vecs.read(spark, str(bad)).collect()


def test_json_rows_and_updates(spark):
    df = tables.rows_from_json(spark, ["skip", {"id": 1, "v": [0.5], "t": "a"}, {"id": 2, "t": "it's"}])
    assert [tuple(r) for r in df.select("id", "v", "t").collect()] == [(1, [0.5], "a"), (2, None, "it's")]
    changes = spark.createDataFrame([(1, "new"), (2, None), (9, "x")], "id long, t string")
    assert sorted((r.id, r.t) for r in tables.update_from(df, changes, "id", ["t"]).collect()) == [(1, "new"), (2, "it's")]
    with pytest.raises(ValueError):
        tables.rows_from_json(spark, [])


def test_several_changes_of_a_key_dont_mix(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, t string, u string")
    changes = spark.createDataFrame([(1, "p", "z"), (1, "q", "c")], "id long, t string, u string")
    assert [tuple(r) for r in tables.update_from(df, changes, "id", ["t", "u"]).collect()] == [(1, "q", "c")]


def test_range_reads(spark):
    df = spark.range(1, 101)
    asked = []
    out = tables.read_ranges(spark, lambda a, b: asked.append((a, b)) or df.where((F.col("id") >= a) & (F.col("id") < b)), 1, 100, 7)
    assert sorted(r.id for r in out.collect()) == list(range(1, 101)) and len(asked) == 7 and asked[0][0] == 1 and asked[-1][1] == 101
    with pytest.raises(ValueError):
        tables.read_ranges(spark, None, 3, 1, 2)


class Service(http.server.BaseHTTPRequestHandler):
    """Answers as hosted models do; keeps what it was asked."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((self.path, body, dict(self.headers)))
        if self.path.endswith("/embeddings"):
            out = {"data": [{"index": i, "embedding": [float(len(x)), 1.0]} for i, x in reversed(list(enumerate(body["input"])))], "usage": {"total_tokens": 7}}
        elif self.path.endswith("/embed"):
            out = {"embeddings": [[float(len(x))] for x in body["texts"]], "meta": {"billed_units": {"input_tokens": 5}}}
        elif self.path.endswith("/chat"):
            out = {"text": body["message"].upper()}
        else:
            out = {"choices": [{"message": {"content": body["messages"][-1]["content"][::-1]}}]}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_hosted_models(spark, service):
    Service.seen.clear()
    client = embed.OpenAiRuntime("secret", service, count=len, dimensions=2)
    client.MOST_TOKENS, client.GROUP_TOKENS, client.GROUP_INPUTS = 10, 12, 2
    assert client.embed("openai/text-embedding-3-small", ["abc", "x" * 50, "de", "f", "g"]) == [[3.0, 1.0], [10.0, 1.0], [2.0, 1.0], [1.0, 1.0], [1.0, 1.0]]
    assert [b["input"] for _, b, _ in Service.seen] == [["abc"], ["x" * 10, "de"], ["f", "g"]] and client.usage == 21
    assert Service.seen[0][1]["dimensions"] == 2 and Service.seen[0][2]["Authorization"] == "Bearer secret"
    assert client.complete("openai/gpt-4o", ["abc"], "be short") == ["cba"]
    other = embed.CohereRuntime("secret", service)
    assert other.embed("cohere/embed-english-v3.0", ["ab", "c"]) == [[2.0], [1.0]] and other.complete("cohere/command-r", ["hi"]) == ["HI"]
    assert Service.seen[-2][1]["input_type"] == "search_document" and other.usage == 5
    with pytest.raises(ValueError):
        embed.CohereRuntime("secret", service, input_type="other")
    assert embed.OpenAiRuntime("k", "https://a.openai.azure.com/x")._headers() == {"api-key": "k"}
    df = spark.createDataFrame([("abcd",), (None,), (" ",)], "t string")
    assert [r.v for r in df.select(embed.openai_embedding(F.col("t"), token="k", base_url=service).alias("v")).collect()] == [[4.0, 1.0], None, None]
    assert {"onnx", "http", "openai", "cohere", "hash"} <= {r.runtime for r in embed.available_runtimes(spark).collect()}
    assert embed.available_models(spark, "openai", params={"token": "k"}).count() == 3


def test_a_model_is_asked_once_for_each_row(spark, tmp_path, service):
    Service.seen.clear()
    df = spark.createDataFrame([(i, str(i) if i % 2 else f"x{i}") for i in range(10)], "id long, t string")
    good, failed = embed.typed_completions(df, "t", "n", "int", runtime="http", model="m", params={"base_url": service})
    assert good.count() + failed.count() == 10 and failed.count() == 5 and len(Service.seen) == 10


def test_changed_rows_are_embedded_again(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string").write.parquet(f"{tmp_path}/in")
    own = jobs.Jobs(spark, f"file://{tmp_path}/jobs")
    n = own.add_embedding_job(spark.readStream.schema("id long, t string").parquet(f"{tmp_path}/in"), "id", "t", "v")
    own.start(n)
    before = {r.id: r.v for r in own.results(n).collect()}
    spark.createDataFrame([(2, "other words"), (1, "a")], "id long, t string").write.mode("append").parquet(f"{tmp_path}/in")
    assert own.start(n).failure is None
    after = {r.id: r.v for r in own.results(n).collect()}
    assert after[1] == before[1] and after[2] != before[2] and own.usage().first().rows == 3


def test_images(spark, tmp_path, monkeypatch):
    (tmp_path / "a.png").write_bytes(b"abc")
    (tmp_path / "b.png").write_bytes(b"abcdef")
    monkeypatch.setattr(tables, "MAX_IMAGE_BYTES", 4)
    assert sorted((r.readable, bytes(r.content)) for r in tables.read_images(spark, str(tmp_path)).collect()) == [(False, b""), (True, b"abc")]


def test_pooling():
    s, m = np.array([[[1.0, -2.0], [3.0, 4.0]]]), np.array([[1, 0]])
    assert embed.pool(s, m, "cls").tolist() == embed.pool(s, m, "mean").tolist() == [[1.0, -2.0]]
    assert np.allclose(embed.pool(s, m, "relu_log_max"), [[np.log(2), 0]])
    with pytest.raises(ValueError):
        embed.pool(s, m, "other")


def test_embedding_columns(spark):
    df = spark.createDataFrame([(1, "hello wide world"), (2, None), (3, "  "), (4, "Error: Summary failed (llm)")], "id int, t string")
    out = {r.id: r.v for r in embed.create_embeddings(df, "t", "v").collect()}
    assert len(out[1]) == 64 and abs(sum(x * x for x in out[1]) - 1) < 1e-5 and out[2] is out[3] is out[4] is None
    good, failed = embed.typed_completions(spark.createDataFrame([(1, "12"), (2, "x")], "id int, t string"), "t", "n", "int")
    assert [(r.id, r.n) for r in good.collect()] == [(1, 12)] and [tuple(r) for r in failed.collect()] == [(2, "x")]
    with pytest.raises(ValueError, match="unknown runtime"):
        embed.llm_embedding(F.col("t"), runtime="none")
    assert embed.available_models(spark).count() == 2 and embed.available_runtimes(spark).count() >= 1
    assert list(embed.greedy_groups([3, 4, 9, 1], 8)) == [(0, 2), (2, 3), (3, 4)]


def test_retries():
    calls = []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert embed.retried(fails_twice, 3, 0) == "done"
    with pytest.raises(ZeroDivisionError):
        embed.retried(lambda: 1 / 0, 2, 0)


def test_stream_job(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "")], "id long, t string").write.parquet(f"{tmp_path}/in")
    own = jobs.Jobs(spark, f"file://{tmp_path}/jobs", label="here")
    stream = spark.readStream.schema("id long, t string").parquet(f"{tmp_path}/in")
    n, other = own.add_embedding_job(stream, "id", "t", "v"), own.add_embedding_job(stream, "id", "t", "v", label="there")
    assert own.status_of(n) == "queued"
    assert own.start(n).failure is None and own.start(other).started is None
    spark.createDataFrame([(2, "b"), (4, "d")], "id long, t string").write.mode("append").parquet(f"{tmp_path}/in")
    own.start(n)
    assert sorted(r.id for r in own.results(n).collect()) == [1, 2, 4] and own.status_of(n) == "enabled"
    own.cancel(n)
    assert own.status_of(n) == "canceled" and own.resume(n).failure is None


def test_completion_job(spark, tmp_path):
    own = jobs.Jobs(spark, f"file://{tmp_path}/jobs")
    df = spark.createDataFrame([("1", "12"), ("2", "x")], "id string, t string")
    n = own.add_completion_job(df, "id", "t", "n", kind="int")
    own.start(n)
    assert [(r.id, r.n) for r in own.results(n).collect()] == [("1", 12)] and own.failures(n).first().row_id == "2"
    assert [tuple(r) for r in own.usage().collect()] == [(n, 1, 1, 1)]


def test_collections(spark):
    own = collections.Collections(spark)
    own.create("things")
    assert own.insert("things", [{"id": i, "vector": [float(i), 0.0], "data": f'"{i}"'} for i in range(10)]) == 10
    assert [(r.id, r.data) for r in own.search("things", [3.2, 0.0], 2, select=["id", "data"]).collect()] == [(3, '"3"'), (4, '"4"')]
    index = own.create_index("things")
    assert index == "things_vector_idx" and own.search("things", [3.2, 0.0], 1).first().id == 3
    own.drop_index(index)
    assert "things" in [r.name for r in own.list().collect()]
    own.drop("things")
    with pytest.raises(ValueError):
        own.create("bad name; --")


def test_tasks(spark):
    own = tasks.Tasks(spark)
    good, bad = own.run("SELECT 1", "one"), own.run("SELECT nothing_there")
    assert own.wait(good, 60) == "succeeded" and own.wait(bad, 60) == "failed"
    assert {r.job_name: r.status for r in own.list().collect()} == {"one": "succeeded", "async_task_2": "failed"}
    assert own.cancel_all() == 0
