"""Star patterns (C1-C3): cases by hand."""

from charlens.operators.graph import match_books, star_books

ROWS = [
    # everything, two authors, two dates (one too late), repeated statements
    ("book/1", "genre", "g"), ("book/1", "genre", "g"), ("book/1", "date", "1990-01-01"), ("book/1", "date", "2005-01-01"), ("book/1", "author", "p/1"),
    ("book/1", "author", "p/2"), ("book/1", "author", "p/2"), ("book/1", "character", "c/1"), ("book/1", "catalog_id", "7"),
    # no catalogue id
    ("book/2", "genre", "g"), ("book/2", "date", "1990-01-01"), ("book/2", "author", "p/1"), ("book/2", "character", "c/1"), ("book/2", "character", "c/2"),
    # another genre; no character; a date that cannot be read; no author; only null values
    ("book/3", "genre", "h"), ("book/3", "date", "1990-01-01"), ("book/3", "author", "p/1"), ("book/3", "character", "c/1"),
    ("book/4", "genre", "g"), ("book/4", "date", "1990-01-01"), ("book/4", "author", "p/1"),
    ("book/5", "genre", "g"), ("book/5", "date", "soon"), ("book/5", "author", "p/1"), ("book/5", "character", "c/1"),
    ("book/6", "genre", "g"), ("book/6", "date", "1990-01-01"), ("book/6", "character", "c/1"), ("book/6", "author", None),
    (None, "genre", "g"), (None, "date", "1990-01-01"), (None, "author", "p/1"), (None, "character", "c/1"),
    # two genres, the wanted one among them
    ("book/7", "genre", "h"), ("book/7", "genre", "g"), ("book/7", "date", "1990-01-01"), ("book/7", "author", "p/3"), ("book/7", "character", None),
]
LABELS = [("book/1", "One", "en"), ("book/1", "Un", "fr"), ("p/1", "Ann", "en"), ("p/2", "Ann", "en")]


def frames(spark):
    return spark.createDataFrame(ROWS, "s string, p string, o string"), spark.createDataFrame(LABELS, "id string, label string, lang string")


def test_star(spark):
    got = sorted(map(tuple, star_books(*frames(spark), "2000-01-01", "g").collect()))
    # both authors of the first book have one name: one row
    assert got == [("book/1", "One", "Ann", "1990-01-01", True), ("book/2", "2", "Ann", "1990-01-01", False), ("book/7", "7", "3", "1990-01-01", False)]


def test_with_and_without_id(spark):
    with_id, without = (match_books(*frames(spark), "2000-01-01", "g", has_catalog_id=x) for x in (True, False))
    assert [r["book"] for r in with_id.collect()] == ["book/1"]
    assert sorted(r["book"] for r in without.collect()) == ["book/2", "book/7"]


def test_no_statements(spark):
    st, labels = frames(spark)
    assert star_books(st.where("false"), labels, "2000-01-01", "g").count() == 0


def test_source_limit(spark):
    """L2: 1,500 rows in a stated order."""
    from charlens.operators.relational import top_n

    rows = spark.range(4000).selectExpr("id % 2000 as book", "id as date")
    got = [tuple(r) for r in top_n(rows, 1500, "book", "date").collect()]
    assert got == sorted(((i % 2000, i) for i in range(4000)))[:1500]
