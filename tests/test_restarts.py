"""Logs that begin anew under the same name."""

import json
import os

from corpusloom.streaming import restarts as R

SCHEMA = "step long, loss double"


def put(path, run, seq, start, text):
    to = f"{path}/run={run}/seq={seq}/start={start}"
    os.makedirs(to)
    with open(f"{to}/part.txt", "w") as f:
        f.write(text)
    return start + len(text.encode())


def line(step, loss=1.0):
    return json.dumps({"step": step, "loss": loss}) + "\n"


def test_a_run_starts_anew_under_the_same_id(spark, tmp_path):
    logs, out, seen = (f"{tmp_path}/{x}" for x in ("logs", "out", "seen"))

    def read(most=1000):
        R.follow_generations(spark, logs, out, seen, SCHEMA, most).awaitTermination()
        return sorted((r.run, r.generation, r.step) for r in spark.read.schema("run string, generation int, " + SCHEMA).parquet(out).collect())

    end = put(logs, "a", 0, 0, line(1) + line(2) + '{"st')  # half a line waits
    put(logs, "b", 0, 0, line(7))
    first = read()
    assert first == [("a", 0, 1), ("a", 0, 2), ("b", 0, 7)]
    # the next but one comes first and waits too; broken and NUL lines are skipped
    text = 'ep": 3, "loss": 1.0}\nbroken\n\0\0\n' + line(4)
    put(logs, "a", 2, end + len(text), line(5))
    assert read() == first
    put(logs, "a", 1, end, text)
    second = read()
    assert second == sorted([*first, ("a", 0, 3), ("a", 0, 4), ("a", 0, 5)])
    # the log shrank: a new generation, and the unfinished rest of the old one is gone
    end = put(logs, "a", 3, 0, line(1) + '{"step": 2')
    put(logs, "a", 4, 0, line(10))
    put(logs, "b", 1, len(line(7)), line(8))
    third = read(most=1)
    assert third == sorted([*second, ("a", 1, 1), ("a", 2, 10), ("b", 0, 8)])
    rows = spark.createDataFrame(third, "run string, generation int, step long")
    assert sorted(tuple(r) for r in R.latest_generation(rows).collect()) == [("a", 2, 10), ("b", 0, 7), ("b", 0, 8)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != R.ROCKS
