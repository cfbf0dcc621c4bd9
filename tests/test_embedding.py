"""The embedding queue: eligibility, plan, calls, retries, halving, resuming, and hybrid search."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import make_corpus
from gleanery import config
from gleanery.engine import Engine, plan_lines
from gleanery.operators import embedding
from gleanery.plans import embed


class Result:
    def __init__(self, embeddings):
        self.embeddings = embeddings


class Scripted:
    """A client that raises what it is told to, then answers; remembers call sizes."""

    def __init__(self, *errors):
        self.errors, self.sizes = list(errors), []

    def embed(self, texts, model, input_type):
        self.sizes.append(len(texts))
        if self.errors and (error := self.errors.pop(0)):
            raise error
        return Result([[float(len(t))] for t in texts])


def texts(*sizes):
    return [{"doc_id": i, "text": "x" * n} for i, n in enumerate(sizes)]


def sizes(rows, kind="prose", chunks=128, tokens=100_000):
    return [len(c) for c in embedding.calls(iter(rows), kind, chunks, tokens)]


def test_calls_respect_both_limits():
    assert sizes(texts(4, 4, 4), chunks=2) == [2, 1]
    assert sizes(texts(400, 400, 400), tokens=250) == [2, 1]
    assert sizes(texts(400, 400, 400), "code", tokens=250) == [1, 1, 1]  # code counts double
    assert sizes(texts(4000, 4), tokens=10) == [1, 1]  # the first of a call is always taken
    assert sizes([]) == []


def test_retries_wait_longer_each_time():
    client, waits = Scripted(TimeoutError(), TimeoutError()), []
    vectors, retries = embedding.send(client, ["ab"], "m", transient=(TimeoutError,), sleep=waits.append)
    assert (vectors, retries, waits) == ([[2.0]], 2, [1, 2])
    client = Scripted(*[TimeoutError()] * 9)
    with pytest.raises(TimeoutError):
        embedding.send(client, ["a"], "m", max_retries=5, transient=(TimeoutError,), sleep=waits.append)
    assert client.sizes == [1] * 6
    with pytest.raises(ValueError):
        embedding.send(Scripted(ValueError("other")), ["a"], "m", transient=(TimeoutError,))


def test_size_refusals_halve_the_call():
    refusal = RuntimeError("batch over the Max Allowed Tokens limit")
    client = Scripted(refusal, None, refusal)
    vectors, _ = embedding.send(client, ["a", "bb", "ccc"], "m", transient=())
    assert vectors == [[1.0], [2.0], [3.0]] and client.sizes == [3, 1, 2, 1, 1]
    with pytest.raises(RuntimeError):
        embedding.send(Scripted(refusal), ["a"], "m", transient=())


def test_eligibility_and_plan(spark):
    chunks = spark.createDataFrame(
        [(1, "off", "a.md", "x" * 400), (2, "main", "finance/a.md", "x" * 400), (3, "main", "b.md", "x" * 401),
         (4, "main", "c.py", "x" * 800), (5, "main", "commit/1.py", "x" * 40), (6, "main", "done.md", "x")],
        "chunk_id long, source string, path string, text string",
    )
    done = spark.createDataFrame([(6,)], "chunk_id long")
    queue = embedding.eligible(chunks, done, {"main": ("finance/**",)})
    assert {(r.chunk_id, r.kind, r.tokens) for r in queue.collect()} == {(3, "prose", 100), (4, "code", 200), (5, "prose", 10)}
    plan = embedding.plan(queue, {"prose": "voyage-3.5", "code": "voyage-code-3"})
    assert plan_lines(plan) == [
        "main [code]: chunks=1 tokens=200 cost_usd=0.0000", "main [prose]: chunks=2 tokens=110 cost_usd=0.0000",
        "total [prose]: chunks=2 tokens=110 cost_usd=0.0000", "total [code]: chunks=1 tokens=200 cost_usd=0.0000",
        "total: chunks=3 tokens=310 cost_usd=0.0000",
    ]
    costs = {(r.source, r.kind): r.cost_usd for r in plan.collect()}
    assert costs[None, None] == pytest.approx(110 * 0.06e-6 + 200 * 0.18e-6)
    unknown = embedding.plan(queue, {"prose": "own", "code": "own"}).where("kind IS NULL").first()
    assert unknown.cost_usd == 0.0
    nothing = embedding.eligible(chunks, done, {})
    assert plan_lines(embedding.plan(nothing, {"prose": "p", "code": "c"}))[-1] == "total: chunks=0 tokens=0 cost_usd=0.0000"


def fake_factory(log, fail_on=None):
    """A factory whose client logs calls to a folder and embeds words by counting letters."""
    def build():
        class Client:
            def embed(self, batch, model, input_type):
                with open(os.path.join(log, uuid.uuid4().hex), "w") as out:
                    json.dump([model, input_type, batch], out)
                if fail_on and any(fail_on in t for t in batch):
                    raise RuntimeError("service down")
                rows = [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in batch]
                return type("R", (), {"embeddings": rows})()

        return Client()

    return build


def logged(log):
    return [json.loads((log / name).read_text()) for name in os.listdir(log)]


def test_drain_resume_and_hybrid_search(spark, tmp_path):
    root = make_corpus(tmp_path / "corpus")
    text = (root / "gleanery.toml").read_text().replace('root = "files"\n', 'root = "files"\nembed_exclude = ["finance/**"]\n')
    (root / "gleanery.toml").write_text(text)
    settings = config.load(root / "gleanery.toml")
    log = tmp_path / "log"
    log.mkdir()
    engine = Engine(spark, settings, fake_factory(str(log)))
    engine.update(["files", "repo"])
    assert not engine.has_vectors()
    failing = Engine(spark, settings, fake_factory(str(log), fail_on="bill"))
    with pytest.raises(Exception, match="service down"):
        failing.embed()
    assert engine.index.read("vectors").count() == 0  # an open snapshot does not change
    engine.index.refresh()
    saved = engine.index.read("vectors").count()
    assert 0 < saved < 12  # what came before the refused call is kept
    sent_before = len([t for _, _, batch in logged(log) for t in batch if "notice" in t])
    outcome = engine.embed()
    assert saved + outcome.embedded == 12 and outcome.per_model.keys() <= {"prose", "code"}
    assert len([t for _, _, batch in logged(log) for t in batch if "notice" in t]) == sent_before  # not sent twice
    assert not any("Lamp oil,Rope" in t or "Annual summary" in t for _, _, batch in logged(log) for t in batch)
    assert {m for m, _, b in logged(log) if any("def lamp" in t for t in b)} == {settings.code_model}
    assert engine.embed().embedded == 0
    assert {r.source: r.embedded for r in engine.stats().collect()} == {"files": 7, "mail": 0, "repo": 5}

    vectors = engine.query_vectors("lamp oil")
    assert {i for _, i, b in logged(log) if b == ["lamp oil"]} == {"query"}
    near = engine.search("lamp oil", mode="semantic", query_vectors=vectors, limit=50).collect()
    assert near and not any(r.path.startswith("finance/") for r in near)
    both = engine.search("lamp oil", query_vectors=vectors, limit=50).collect()
    words = engine.search("lamp oil", mode="lexical").collect()
    assert {r.path for r in both} == {r.path for r in near} | {r.path for r in words}
    assert [r.score for r in both] == sorted((r.score for r in both), reverse=True)
    top = both[0]
    assert top.score > 1 / 61  # found by words and by meaning
    only = engine.search("lamp oil", mode="semantic", query_vectors=vectors, sources=["repo"]).collect()
    assert {r.source for r in only} == {"repo"}

    (root / "files/tool.py").write_text("def lamp():\n    return 'dark'\n")
    engine.update(["files"])
    assert engine.embed().embedded == 1  # a changed document waits again
    assert engine.stats().where("source = 'files'").first().embedded == 7


def test_prefilter_widens_narrow_scopes(spark):
    from gleanery.operators import vectors

    rows = spark.createDataFrame([(i, [float(i), 0.0], i % 10) for i in range(100)], "id long, embedding array<float>, g int")
    near = vectors.knn(rows, [0.0, 0.0], ["id", "g"], k=5)
    assert [r.id for r in near.collect()] == [0, 1, 2, 3, 4]
    assert near.where("g = 9").count() == 0
    assert [r.id for r in vectors.knn(rows, [0.0, 0.0], ["id"], k=2, prefilter=F.col("g") == 9).collect()] == [9, 19]
    with pytest.raises(Exception, match="3 dimensions"):
        vectors.knn(rows, [0.0, 0.0, 0.0], ["id"]).collect()


def test_api_key(tmp_path, monkeypatch):
    monkeypatch.delenv(embed.KEY_NAME, raising=False)
    with pytest.raises(embed.EmbedError):
        embed.api_key(tmp_path)
    (tmp_path / ".env").write_text(f"# {embed.KEY_NAME}=no\nOTHER=1\n {embed.KEY_NAME} = 'from file' \n")
    assert embed.api_key(tmp_path) == "from file"
    monkeypatch.setenv(embed.KEY_NAME, "from env")
    assert embed.api_key(tmp_path) == "from env"
