"""JSON arrays cut into pieces at any place are read as the multiLine reader reads them whole."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import types as T

from thinkframe.sinks import write_json_arrays
from thinkframe.sources.json_arrays import read_json_arrays

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("ex_id", "prompt", "answer")])


def _text(rng):
    return "".join(rng.choice(["a", "é", "日", " ", "\\", '"', "{", "}", "[", "]", ",", "\n", "},{\"", "\\boxed{2}", "\\\\}", "﻿", "x" * 50]) for _ in range(rng.randrange(0, 40)))


def _examples(rng, n):
    rows = []
    for i in range(n):
        row = {"ex_id": str(i), "prompt": _text(rng), "answer": _text(rng)}
        if i % 5 == 0:
            del row["answer"]
        if i % 7 == 0:
            row["prompt"] = None
        if i % 3 == 0:
            row["other"] = {"deep": [[{}], {"}": "]{"}, [1, 2.5, True, None]], "t": _text(rng)}
        if i % 11 == 0:
            row["answer"] = {"nested": [1, {"a": "}"}]}
        rows.append(row)
    return rows


def _plain(value):
    """An object in a string column, whatever its white space (the whole-file reader keeps it)."""
    return json.dumps(json.loads(value)) if value and '"nested"' in value else value


def _sorted(df):
    return sorted((tuple(map(_plain, r)) for r in df.collect()), key=repr)


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(old, ("3001", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_arrays_equal_the_whole_file_read(spark, tmpdir_path, small_splits, layout):
    rng = random.Random(str(layout))
    rows = _examples(rng, 120)
    rows[60]["prompt"] = "long } \" { " * 2500  # reaches over many splits and pieces
    with open(os.path.join(tmpdir_path, "a.json"), "w", encoding="utf-8") as f:
        json.dump(rows, f, **layout)
    with open(os.path.join(tmpdir_path, "b.json"), "w", encoding="utf-8") as f:
        f.write("﻿ \n")
        json.dump(_examples(rng, 9), f, **layout)
        f.write("\n\n")
    want = _sorted(spark.read.schema(SCHEMA).json(tmpdir_path, multiLine=True))
    assert len(want) == 129
    for piece_bytes in (1, 700, 10**6):
        assert _sorted(read_json_arrays(spark, tmpdir_path, SCHEMA, piece_bytes)) == want
    records = spark.read.option("lineSep", "}").text(tmpdir_path)
    assert records.select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 10


def test_other_files(spark, tmpdir_path):
    def read(name, text, op=open):
        path = os.path.join(tmpdir_path, name)
        with op(path, "wt", encoding="utf-8") as f:
            f.write(text)
        return _sorted(read_json_arrays(spark, path, SCHEMA))

    one = ("1", "}", None)
    assert read("empty.json", "") == read("blank.json", " \n") == read("none.json", "[]") == read("none2.json", "[ ]\n") == []
    assert read("one.json", '{"ex_id": "1", "prompt": "}"}') == read("line.json", '{"ex_id": 1, "prompt": "}"}\n') == [one]
    assert read("two.json", '{"ex_id": "1", "prompt": "}"}\n{"ex_id": "1", "prompt": "}"}') == [one, one]
    assert read("z.json.gz", '[{"ex_id": "1", "prompt": "}"}]', gzip.open) == [one]
    assert read("null.json", '[{}, {"ex_id": null}]') == [(None, None, None)] * 2
    for bad in ('[{"ex_id": "1"}', '[{"ex_id": "1"', '[{"ex_id": "1}]', '{"ex_id": "1', '{"ex_id": {"a": "1"', '[{"ex_id": "1"}, 7]', '["a"]', "nonsense", '[{"ex_id": "1"}]]'):
        with pytest.raises(Exception, match="no whole JSON text|only objects may stand"):
            read("bad.json", bad)


def test_written_arrays(spark, tmpdir_path):
    rows = [(str(i), _text(random.Random(i)) or None, None if i % 4 else "}") for i in range(50)]
    path = os.path.join(tmpdir_path, "out")
    write_json_arrays(spark.createDataFrame(rows, SCHEMA).repartition(3), path)
    files = [os.path.join(path, n) for n in os.listdir(path) if n.startswith("part-")]
    assert len(files) >= 2
    plain = [r for name in files for r in json.load(open(name, encoding="utf-8"))]
    assert sorted((r["ex_id"], r.get("prompt"), r.get("answer")) for r in plain) == sorted(rows, key=lambda r: r[0])
    assert _sorted(read_json_arrays(spark, path, SCHEMA, 100)) == sorted(rows, key=repr)
    write_json_arrays(spark.createDataFrame([], SCHEMA), path)
    assert read_json_arrays(spark, path, SCHEMA).count() == 0
