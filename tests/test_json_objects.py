"""JSON objects read by byte ranges (A5, A6) and their broken records."""

import json
import random
import tempfile

import pyarrow as pa
import pytest

from gridwork.sources import io, json_objects
from gridwork.sources.json_objects import json_entries


@pytest.fixture()
def small_splits(spark):
    """Files are dealt out in ranges of some thousand bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "2500", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def _folder(**files):
    d = tempfile.mkdtemp(prefix="gridwork-objects-")
    for name, text in files.items():
        with open(f"{d}/{name}.json", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return d


def _questions(n, seed=1):
    rng = random.Random(seed)
    odd = ['}', '{', '"', '\\', ',', ':', '[', ']', 'あ', '\n', ' ', 'x', '\\"', "'"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    return {f"q{i}{text()}": {"question": text(), "doc_id": f"{i:05d}", "table_id": text(), "cell_id": text()} for i in range(n)}


def _read(df):
    return sorted((r["qid"], r["question"], r["doc_id"], r["table_id"], r["cell_id"]) for r in df.collect())


def _wanted(found):
    return sorted((k, v["question"], v["doc_id"], v["table_id"], v["cell_id"]) for k, v in found.items())


def _dealt(data, cuts):
    """The text as Spark deals it out: pieces between braces, in ranges that begin at the given pieces."""
    pieces = data.split(b"}")
    pieces = pieces[:-1] if data.endswith(b"}") else pieces
    start, at, rows = 0, 0, []
    for i, piece in enumerate(pieces):
        start = at if i in cuts else start
        rows.append(("f", start, len(data), piece))
        at += len(piece) + 1
    types = {"file": pa.string(), "start": pa.int64(), "size": pa.int64(), "value": pa.binary()}
    return [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))]


def _segments_of(data, cuts, depth):
    """(kind, level, outer, start, text) of the whole text, from what each range gives."""
    summaries = [r for b in json_objects._summaries(iter(_dealt(data, cuts))) for r in b.to_pylist()]
    portions = json_objects._folded(summaries, False)
    rows = [r for b in json_objects._cut(portions, depth)(iter(_dealt(data, cuts))) for r in b.to_pylist()]
    out, open_text, open_start, outer = [], "", 0, None
    for r in rows:
        if r["place"] in ("head", "through"):
            r["text"], r["start"] = open_text + r["text"], open_start
        open_text, open_start = (r["text"], r["start"]) if r["place"] in ("tail", "through") else ("", 0)
        if r["place"] in ("head", "whole"):
            if r["place"] == "whole" and r["outer_text"] is not None:
                assert r["outer_text"] == outer
            out.append((r["kind"], r["level"], outer, r["start"], r["text"]))
            if r["kind"] == "open":
                outer = r["text"] if r["level"] == 2 else None
    return out + [("rest", 0, None, open_start, open_text)]


@pytest.mark.parametrize("seed", range(40))
def test_any_division_of_any_object(seed):
    rng = random.Random(seed)
    shape = rng.choice([{}, {"indent": 2}, {"ensure_ascii": False}, {"separators": (",", ":")}])
    flat = _questions(rng.randrange(1, 12), seed)
    deep = {k: {f"t{j}": rng.choice([[1, {"a": "}"}], v, 5, "{,}"]) for j in range(rng.randrange(4))} for k, v in flat.items()}
    for depth, found in ((1, flat), (2, deep)):
        data = json.dumps(found, **shape).encode() + rng.choice([b"", b"\n"])
        n = data.count(b"}")
        got = _segments_of(data, {i for i in range(n) if rng.random() < 0.4}, depth)
        entries = [x for x in got if x[0] == "entry" and x[4].strip()]
        assert all(level == depth for _, level, *_ in entries) and not [x for x in got if x[0] in ("broken", "rest") and x[4].strip()]
        for _, _, _, start, text in entries:
            assert data[start:].startswith(text.encode())
        if depth == 1:
            assert json.loads("{" + ",".join(x[4] for x in entries) + "}") == found
        else:
            read = {}
            for _, _, outer, _, text in entries:
                read.setdefault(json.loads("{" + outer + "0}").popitem()[0], {}).update(json.loads("{" + text + "}"))
            assert read == {k: v for k, v in found.items() if v}


def test_one_object_in_many_ranges(spark, small_splits):
    found = _questions(400)
    d = _folder(q=json.dumps(found))
    rows, errors = io.read_questions_checked(spark, d)
    assert _read(rows) == _wanted(found) and errors.count() == 0
    assert spark.read.option("lineSep", "}").text(d).rdd.getNumPartitions() >= 8


def test_large_object_is_shared(spark):
    found = {f"q{i}": {"question": "x" * 500, "doc_id": "D", "table_id": "T", "cell_id": "C"} for i in range(20_000)}
    d = _folder(q=json.dumps(found))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert spark.read.option("lineSep", "}").text(d).rdd.getNumPartitions() >= 10
        assert _read(io.read_questions(spark, d)) == _wanted(found)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_files_marks_of_order_and_missing_braces(spark, small_splits):
    a, b, c = _questions(7, 2), {"z1": {"question": "u", "doc_id": "1", "table_id": "t", "cell_id": "c"}}, _questions(5, 3)
    c = {"c" + k: v for k, v in c.items()}
    d = _folder(a=json.dumps(a) + "\n", b=b"\xef\xbb\xbf" + json.dumps(b).encode(), c=json.dumps(c, indent=1), e="", f="{}", g="\n \n")
    rows, errors = io.read_questions_checked(spark, d)
    assert _read(rows) == _wanted(a | b | c) and errors.count() == 0


def test_objects_of_objects(spark, small_splits):
    rng = random.Random(5)
    gold = {f"{i:04d}": {f"{i:04d}-tab{j}": {"is_include": rng.random() < 0.5, "manual": {
        "row_split": rng.choice(["", "1", "2"]), "col_split": str(j)}} for j in range(rng.randrange(1, 9))} for i in range(40)}
    wanted = sorted((d, t, v["is_include"], v["manual"]["row_split"], v["manual"]["col_split"]) for d, ts in gold.items() for t, v in ts.items())

    def read(path, **how):
        rows, errors = io.read_gold_checked(spark, path, **how)
        assert errors.count() == 0
        return sorted((r["doc_id"], r["table_id"], r["is_include"], "" if r["row_split"] is None else str(r["row_split"]),
                       str(r["col_split"])) for r in rows.collect())

    assert read(_folder(g=json.dumps(gold))) == wanted
    assert read(_folder(g=json.dumps(gold, indent=4))) == wanted
    assert read(_folder(g="\n".join(json.dumps({k: v}) for k, v in gold.items()))) == wanted
    out = tempfile.mkdtemp(prefix="gridwork-objects-") + "/one"
    docs = spark.createDataFrame([(k, json.dumps({k: v})) for k, v in gold.items()], "doc_id string, json string")
    io.write_one_object(docs.repartition(3), out)
    assert read(out, together=True) == wanted
    import glob
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{out}/part-*")))
    assert json.loads(text) == gold


def test_broken_records_stand_alone(spark):
    one = '{"question": "u", "doc_id": "1", "table_id": "t", "cell_id": "c"}'
    lines = [f'{{"q1": {one}}}', '{"q2": {"question": "cut', f'{{"q3": {one}}}', '{"q4": "no object"}', f'{{"q5": {one}}}',
             '{"q6": {"question": 1, "doc_id" "2"}}', f'{{"q7": {one}', f'{{"q8": {one}}}}}', f'{{"q9": {one}}}', '[1, 2]', "plain",
             f'{{"q10": {one}, "q11": null}}', f'{{"q12": {one}}}']
    text = "\n".join(lines)
    d = _folder(q=text)
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows, errors = io.read_questions_checked(spark, d)
            got, bad = [r[0] for r in _read(rows)], errors.collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert {"q1", "q3", "q5", "q8", "q9", "q10", "q12"} <= set(got) and not {"q2", "q4", "q6", "q11"} & set(got)
        assert {r["file"].rsplit("/", 1)[1] for r in bad} == {"q.json"}
        for sign in ('"q2"', '"q4"', '"q6"', "[1, 2]", "plain", '"q11"'):
            own = [r for r in bad if sign in r["text"]]
            assert len(own) == 1, sign
            assert text.encode()[own[0]["start"]:].decode().lstrip().startswith(own[0]["text"].strip()[:5])


def test_entries_of_other_depths_are_broken(spark):
    d = _folder(a='{"x": 1, "y": {"z": {"a": 1}}}')
    entries, broken = json_entries(spark, d, 2)
    assert [(r["outer_text"].strip(), r["text"].strip()) for r in entries.collect()] == [('"y":', '"z": {"a": 1}')]
    assert [r["text"].strip() for r in broken.collect()] == ['"x": 1']
    with pytest.raises(ValueError):
        json_entries(spark, d, 3)
