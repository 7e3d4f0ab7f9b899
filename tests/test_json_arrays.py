"""A4: large JSON arrays by byte ranges against the parser of the standard library."""

import json
import random

import pytest

from charlens.sources.json_arrays import marks, read_json_array

SCHEMA = "i int, t string, n struct<a: array<int>, s: string>"


def test_marks():
    assert marks('{"a}": [1]}', False) == ([(0, 1), (7, 1), (9, -1), (10, -1)], False)
    assert marks('x\\"}', True) == ([], True)
    assert marks('x\\\\"}', True) == ([(4, -1)], False)
    assert marks('{"open}', False) == ([(0, 1)], True)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["200", "3k", "128m"])
def test_array_over_many_ranges(spark, tmp_path, indent, size):
    """Braces, brackets, quotes and escapes in strings; documents larger than a range."""
    rnd = random.Random(size)
    odd = ['}', '{', '"', "\\", "[", "]", "},{", '\\"', "é", "日", "\n", "a"]
    docs = [{"i": i, "t": "".join(rnd.choices(odd, k=rnd.randint(0, 40))) * rnd.choice([1, 1, 1, 60]),
             "n": {"a": list(range(rnd.randint(0, 5))), "s": rnd.choice(odd)}} for i in range(120)]
    (tmp_path / "one.json").write_text(json.dumps(docs, indent=indent, ensure_ascii=bool(indent)))
    (tmp_path / "two.json").write_text(json.dumps(docs[:3], indent=indent) + "\n")
    (tmp_path / "none.json").write_text("[]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = sorted((r["i"], r["t"], r["n"]["a"], r["n"]["s"]) for r in read_json_array(spark, str(tmp_path), SCHEMA).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted((d["i"], d["t"], d["n"]["a"], d["n"]["s"]) for d in docs + docs[:3])
