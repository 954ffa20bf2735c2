"""Chunks of logs as rows of a table."""

import pandas as pd

from corpusloom.streaming import restarts as R


class Held:
    """State of one log, which counts how often it is asked for chunks."""

    def __init__(self):
        self.value, self.map, self.asked = None, {}, 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Early(self)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Early:
    def __init__(self, held):
        self.held = held

    def containsKey(self, key):
        self.held.asked += 1
        return key in self.held.map

    def getValue(self, key):
        return self.held.map[key]

    def updateValue(self, key, value):
        self.held.asked += 1
        self.held.map[key] = value

    def removeKey(self, key):
        del self.held.map[key]


def chunks(seqs):
    return pd.DataFrame({"seq": seqs, "start": [10 * s for s in seqs], "size": [10] * len(seqs), "value": [f"{s:9d}\n" for s in seqs]})


def test_chunks_in_turn_pass_by_the_state():
    held, log = Held(), R.Generations()
    log.init(held)
    read = lambda *parts: [int(x) for out in log.handleInputRows(("a",), iter(map(chunks, parts)), None) for lines in out["lines"] for x in lines]
    assert read([2, 0, 1], [5, 3, 4]) == list(range(6)) and held.asked == 0
    assert read([8, 9], [9, 8, 7]) == [] and len(held.map) == 3
    assert read([6, 3]) == [6, 7, 8, 9] and held.map == {} and held.value[-1] == 0
    before = held.asked
    assert read([10, 11]) == [10, 11] and held.asked == before


def test_rows_in_any_files_are_followed(spark, tmp_path):
    path, out, seen = (f"{tmp_path}/{x}" for x in ("in", "out", "seen"))
    line = lambda step: f'{{"step": {step}}}\n'
    rows, start = [], 0
    for seq in range(40):
        start = 0 if seq == 25 else start  # the log shrank
        rows.append(("a", seq, start, len(line(seq)), line(seq)))
        start += len(line(seq))
    table = spark.createDataFrame(rows, "run string, seq long, start long, size long, value string")
    table.orderBy("value").repartition(8).write.parquet(path)
    R.follow_chunks(R.read_chunk_rows(spark, path, 3), out, seen, "step long").awaitTermination()
    got = spark.read.schema("run string, generation int, step long").parquet(out).collect()
    assert sorted((r.generation, r.step) for r in got) == [(int(s >= 25), s) for s in range(40)]
