"""JSON files read in ranges against a whole read."""

import json
import random

import pytest

from lanternlog.sources import readers


@pytest.fixture
def narrow(spark):
    """Ranges of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def made(rng):
    texts = ['plain', 'br}ace{s', 'quo"te', 'back\\slash', '\\"}', 'é日本😀', '[x]', '', '},{', '\\\\', 'tab\t\n']
    value = {f"k{i}": rng.choice([*texts, 1, True, None, [1, {"z": "}"}], {"in": {"ner": "]"}}]) for i in range(rng.randrange(4))}
    return value | {"message": rng.choice(texts) * rng.randrange(1, 9)}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_array_in_ranges(narrow, tmp_path, indent, ascii_only):
    rng = random.Random(7)
    values = [made(rng) for _ in range(300)]
    text = json.dumps(values, indent=indent, ensure_ascii=ascii_only)
    (tmp_path / "a.json").write_text(text)
    frame = readers.json_elements(narrow, str(tmp_path / "a.json"))
    assert narrow.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 20
    got = {r.element: json.loads(r.text) for r in frame.collect()}
    assert got == dict(enumerate(values))
    assert readers.json_rejects(narrow, str(tmp_path / "a.json")).count() == 0


def test_broken_documents_are_told(narrow, tmp_path):
    """Good elements are kept, broken ones come with file, place and reason."""
    files = {
        "inner.json": '[{"message":"a"}, {"message": nope}, {"message":"b"}]',
        "cut.json": '[{"message":"c"},\n{"message":"d"',
        "object.json": ' {"message":"e", "x":{"y":[1]}}',
        "half.json": '{"message":"f"',
        "tail.json": '{"message":"g"} junk',
        "empty.json": "[]\n",
        "blank.json": "  \n",
        "end.json": '[{"message":"h"}',
        "scalar.json": "[1, 2]",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    good = readers.read_json_documents(narrow, str(tmp_path)).collect()
    assert sorted(r.f["message"] for r in good) == ["a", "b", "c", "e", "g", "h"]
    bad = {(r.file.rsplit("/", 1)[1], r.element): (r.reason, r.original) for r in readers.json_rejects(narrow, str(tmp_path)).collect()}
    assert set(bad) == {("inner.json", 1), ("cut.json", 1), ("half.json", 0), ("tail.json", 1), ("scalar.json", 0)}
    assert bad["inner.json", 1] == ("parse_error", '{"message": nope}')
    assert bad["cut.json", 1] == ("parse_error", '{"message":"d"')
    assert bad["tail.json", 1][1] == "junk"
