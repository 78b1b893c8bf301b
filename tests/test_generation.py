"""Each prompt is sent once; restarts go on from the log; budgets and failures leave rows open."""

import pytest

from marlstone.operators.generation import generate_table, read_log
from marlstone.operators.ports import Generator, Price, Response


def sender(folder):
    """Notes each request as a file, so that all tasks' requests can be counted."""

    def send(request):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(request["prompt"])
        if request["prompt"] == "refused":
            return Response(400, "no")
        if request["prompt"] == "busy":
            return Response(503, "later")
        if request["prompt"].startswith("dies") and not os.path.exists(os.path.join(folder, "..", "calm")):
            raise RuntimeError("the task is killed")
        return Response(200, data=request["prompt"].upper(), input_tokens=len(request["prompt"]), output_tokens=2, reason="stop")

    return send


@pytest.fixture
def port(tmp_path):
    (tmp_path / "sent").mkdir()
    return Generator("p", "m", sender(str(tmp_path / "sent")), Price(1_000_000.0, 0.0))


def sent(tmp_path):
    return sorted(p.read_text() for p in (tmp_path / "sent").iterdir())


def table(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id bigint, prompt string")


def test_once_each(spark, tmp_path, port):
    rows, log = table(spark, ["a", "bb", "a", None, "refused", "busy", ""]), f"file://{tmp_path}/log"
    for k in range(2):
        got = {r.id: (r.text, r.reason, r.cost) for r in generate_table(rows, port, log).collect()}
        assert got == {0: ("A", None, 1.0), 1: ("BB", None, 2.0), 2: ("A", None, 1.0), 3: (None, "no prompt", None), 4: (None, got[4][1], 0.0), 5: (None, "open", None), 6: ("", None, 0.0)} and "400" in got[4][1]
        assert sent(tmp_path) == sorted(["", "a", "bb", "refused", *["busy"] * (k + 1)])


def test_budget(spark, tmp_path, port):
    rows, log = table(spark, [f"word-{k:03d}" for k in range(60)]), f"file://{tmp_path}/log"
    got = generate_table(rows, port, log, budget=100, block=6)
    done = got.where("text is not null").count()
    assert 10 <= done <= 10 + 3 * 6 and got.where("reason = 'open'").count() == 60 - done == 60 - len(sent(tmp_path))
    assert generate_table(rows, port, log).where("text is null").count() == 0 and len(sent(tmp_path)) == 60


def test_restart(spark, tmp_path, port):
    rows, log = table(spark, [f"word-{k:03d}" for k in range(40)] + ["dies here"]), f"file://{tmp_path}/log"
    with pytest.raises(Exception, match="killed"):
        generate_table(rows, port, log, block=5).count()
    logged = {r.text.lower() for r in read_log(spark, log).collect()} if (tmp_path / "log").exists() else set()
    (tmp_path / "calm").touch()
    assert generate_table(rows, port, log, block=5).where("text is null").count() == 0
    times = {p: sent(tmp_path).count(p) for p in set(sent(tmp_path))}
    assert len(times) == 41 and all(times[p] == 1 for p in logged) and sum(times.values()) <= 41 + 15  # what the lost block had sent
