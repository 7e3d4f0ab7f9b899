"""Sources and sinks: gold JSONL with polymorphic fields, predictions CSV
round trip, appended runs."""

import os

import pytest
from pyspark.sql import functions as F

from charlens.session import scratch_path
from charlens.sources import io


def test_gold_jsonl_variant_fields(spark, tmp_path):
    p = tmp_path / "gold.jsonl"
    p.write_text(
        '{"name": "Ann", "aliases": ["A", "Annie"], "book": {"gutenberg_url": "u1"}, '
        '"attributes": {"age": "adult", "spoken_languages": ["en", "fr"]}}\n'
        '{"name": "Bob", "aliases": "B, Bobby", "book": {"gutenberg_url": "u2"}, "attributes": {"age": null}}\n'
    )
    g = io.read_gold(spark, str(p))
    flat = io.flatten_gold(g, {"age": "string", "spoken_languages": "array<string>", "origin": "string"})
    rows = {r["name"]: r for r in flat.collect()}
    assert rows["Ann"]["age"] == "adult" and rows["Ann"]["spoken_languages"] == ["en", "fr"]
    assert rows["Bob"]["age"] is None and rows["Bob"]["origin"] is None
    assert rows["Bob"]["gutenberg_url"] == "u2"


def test_predictions_csv_round_trip(spark):
    df = spark.createDataFrame(
        [("u1", "Ann", 'a "quoted"; line\nbreak {"x": 1}', 3, ["p1", "p;2"])],
        "Book string, Character string, Output string, Mentions_counter bigint, Selected_passages array<string>")
    path = scratch_path(spark, "csv-test")
    io.write_csv(df, path, sep=";")
    back = io.read_predictions(spark, path).collect()
    assert len(back) == 1
    assert back[0]["output"] == 'a "quoted"; line\nbreak {"x": 1}'
    assert back[0]["selected_passages"] == ["p1", "p;2"]


def test_append_predictions_by_run(spark):
    path = scratch_path(spark, "runs")
    df = spark.createDataFrame([("u", "c", "o")], "book string, character string, output string")
    io.append_predictions(df, path, "r1", model="mock", strategy="all_mentions", attributes=["age"])
    io.append_predictions(df, path, "r2", model="mock", strategy="all_mentions", attributes=["age"])
    assert io.read_run(spark, path, "r1").count() == 1
    assert spark.read.parquet(path).count() == 2
    assert os.path.isdir(os.path.join(path, "run_id=r1"))


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "Age int")
    io.require_columns(df, "age")
    try:
        io.require_columns(df, "origin")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass
    assert io.lower_columns(df).columns == ["age"]



def test_read_books_whole_files(spark, tmp_path):
    d = tmp_path / "books"
    d.mkdir()
    (d / "1.txt").write_text("Call me Ishmael.\nSome years ago")
    (d / "2.txt").write_text("It was the best of times")
    b = io.read_books(spark, str(d), url_prefix="book/")
    rows = {r["url"]: r["text"] for r in b.collect()}
    assert rows == {"book/1.txt": "Call me Ishmael.\nSome years ago", "book/2.txt": "It was the best of times"}


def test_csv_json_readers_and_json_sink(spark, tmp_path):
    c = tmp_path / "books.csv"
    c.write_text('title,author,in_catalog\n"Emma, a novel",Jane Austen,true\nLost,X,false\n')
    df = io.read_csv(spark, str(c), "title string, author string, in_catalog boolean")
    assert df.where("in_catalog").select("title").first()[0] == "Emma, a novel"
    j = tmp_path / "chars.json"
    j.write_text('[{"character_name": "Élise", "attributes": {"sex": "female"}}, {"character_name": "B"}]')
    docs = io.read_json_documents(spark, str(j), "character_name string, attributes map<string,string>")
    assert docs.count() == 2
    out = scratch_path(spark, "json-sink")
    io.write_json(docs, out)
    back = spark.read.json(out).select("character_name").collect()
    assert sorted(r[0] for r in back) == ["B", "Élise"]


@pytest.mark.parametrize("line_sep", ["\n", " "])
def test_book_chunks_rejoin(spark, tmp_path, line_sep):
    """Small byte ranges and chunks: a book is many rows, none larger than a chunk, and rejoins in order."""
    books = {"one": "\n".join(f"line {i} of the book " + "w" * (i % 40) for i in range(3000)), "two": "only words on one line " * 4000, "three": "short"}
    for name, text in books.items():
        (tmp_path / f"{name}.txt").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = io.read_book_chunks(spark, str(tmp_path), F.regexp_extract("_metadata.file_path", r"(\w+)\.txt$", 1), 1000, line_sep).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in books.items():
        mine = sorted((r["chunk_no"], r["text"]) for r in got if r["url"] == name)
        assert " ".join(t for _, t in mine).split() == text.split()
        assert max(len(t) for _, t in mine) <= 1000
    assert sum(r["url"] == "one" for r in got) > 60
    assert len({r["chunk_no"]["start"] for r in got if r["url"] == "one"}) > 3


def test_replayed_batch_adds_no_row(spark, tmp_path):
    """A batch handed out again replaces its first attempt, also a larger or torn one; others stay."""
    path = str(tmp_path / "runs")
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "character string")
    for names, run, batch in (("ab", "r1", 0), ("cd", "r1", 1), ("zz", "r2", 0), ("cde", "r1", 1), ("cd", "r1", 1), ("ab", "r1", 0)):
        io.append_predictions(rows(*names), path, run, batch=batch)
    assert sorted(r["character"] for r in io.read_run(spark, path, "r1").collect()) == ["a", "b", "c", "d"]
    assert io.read_run(spark, path, "r2").count() == 2
