"""The native JSON path against the helper, and the dispatch of a folder's files by name and size."""

import json
import random

from pyspark.sql import functions as F

from contactrank.sources import clean_json as J
from contactrank.sources import exports as S
from contactrank.sources import uploads as U

FILES = "source_file string, content string"
#: Values of one key; those of the first line are in files that the proof lets pass.
CLEAN = ["1", "-5", "0", "-0", "123456789012345", "1.5", "2.50", "1.0", '"1e21"', '"[1]"', '"{\\"a\\":1}"', '""', '"null"', '"\\u0001"', '"é\\n\\""', "true", "false", "null", "[]", "[1, null, true]", '["a", "b"]', "{}", '{"b": {"c": ["x", 1]}}', '[{"z": 1}]']
ODD = ["1e21", "1234567890123456", "0.0000001", "123456789.1234567", "[[1]]", "[1.50]", '{"b": 2.0}', '{"10": 1, "2": 3}', '{"a": 1, "a": 2}', '{"x": "\\u0001"}', "[1, 1e3]", '["x", 1.0]', '["x", [1]]', '["\\\\", 1]']
BROKEN = ["[1] x", "[] []", "{}", "5", "", "[1,null]", "[{'a':1}]", "[NaN]", '[{"a":01}]', '[{"a":1}', "[[1],[2]", '[1]],[[2]', "[1]}", "[1],", '[1], "y": [2]', '[{"a":1,}]', "﻿", "nul"]


def by_file(frame):
    out = {}
    for r in frame.collect():
        rows, status = out.setdefault(r.source_file, ([], []))
        if r.row_ord is None:
            status.append((r.file_type, r.error, r.row_count))
        else:
            rows.append((r.row_ord, [(c.key, c.value) for c in r.cells]))
    return {k: (sorted(rows), status) for k, (rows, status) in out.items()}


def random_json(rng, depth=0):
    if depth == 3 or rng.random() < 0.6:
        return rng.choice(CLEAN + ODD)
    if rng.random() < 0.4:
        return "[" + ",".join(random_json(rng, depth + 1) for _ in range(rng.randrange(3))) + "]"
    keys = [rng.choice(["a", "b", "Full Name", "é", "1x", "10", "c"]) for _ in range(rng.randrange(4))]
    return "{" + ",".join(f"{json.dumps(k)} :{random_json(rng, depth + 1)}" for k in keys) + "}"


def test_native_json_equals_the_helper(spark):
    rng = random.Random(8)
    texts = [f'[{{"k": {v}, "é": "x"}}]' for v in CLEAN] + [f'[ {{"k" : {v}}} ]' for v in ODD] + BROKEN
    texts += ["﻿ [ ]\n", '["{\\"a\\":1}", {"a": 1}, 5]', '[{"10": 1}]', '[{"a": "\\ud800"}]']
    texts += [rng.choice(["", " ", "﻿"]) + "[" + ",".join(random_json(rng, 1) for _ in range(rng.randrange(3))) + "]" + rng.choice(["", "", "\n", "]", "}", ",[]"]) for _ in range(250)]
    files = spark.createDataFrame([(f"{i}.json", t) for i, t in enumerate(texts)], FILES)
    assert by_file(J.parse_json(files)) == by_file(S.parse_exports(files))
    fine = {int(r.source_file[:-5]) for r in J.prove(files).where(F.forall("rows", lambda r: r["fine"])).collect()}
    assert set(range(len(CLEAN))) <= fine and not fine & set(range(len(CLEAN), len(CLEAN) + len(ODD) + len(BROKEN)))


def test_clean_files_have_no_python_in_their_plan(spark):
    files = spark.createDataFrame([("a.json", '[{"Full Name": "x", "n": 1}, {"n": [null, "y"]}]'), ("b.json", "[]")], FILES)
    out = J.parse_json(files)
    assert "Arrow" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Python" not in plan
    assert by_file(out) == by_file(S.parse_exports(files)) and by_file(out)["b.json"] == ([], [("json", S.NO_ROWS, 0)])
    assert J.parse_json(files.where("false")).count() == 0


def test_a_folder_of_files(spark, tmp_path):
    texts = {
        "a.csv": "First Name,Last Name\nAnn,Lee\n",
        "sub/Big.CSV": "First Name,Last Name\n" + "\n".join(f'"A\n{i}",B' for i in range(300)),
        "sub/blank.csv": "\n" * 3000,
        "near.csv": "\n",
        "c.json": '[{"a": 1}]',
        "odd.json": '[{"a": 1e3}]',
        "bad.json": "{}",
        "d.txt": "First Name\nx",
        "e.csv.gz.bin": "x" * 3000,
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    out = U.parse_folder(spark, str(tmp_path), whole_bytes=1000, range_bytes=500)
    got = {k.rsplit("/", 1)[1]: v for k, v in by_file(out).items()}
    want = {k.rsplit("/", 1)[-1]: v for k, v in by_file(S.parse_exports(spark.createDataFrame(list(texts.items()), FILES))).items()}
    assert got == want and len(got["Big.CSV"][0]) == 300
    assert by_file(S.parse_exports(S.read_files(spark, str(tmp_path)))) == by_file(out)
