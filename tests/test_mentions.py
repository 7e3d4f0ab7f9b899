"""Hand cases and properties of mention extraction (FIXTURES.md section 4)."""

import random
import re

import pytest
from pyspark.sql import functions as F

from charlens.operators.mentions import PhraseBook, extract_mentions, normalize_aliases, token_blocks


def run(spark, text, name, aliases, window):
    books = spark.createDataFrame([("b", text)], "url string, text string")
    chars = spark.createDataFrame([("b", name, aliases)], "url string, name string, aliases array<string>")
    m = extract_mentions(books, chars, window).orderBy("pos").collect()
    return [(r["pos"], r["len"]) for r in m], [r["passage"] for r in m]


@pytest.mark.parametrize("text,name,aliases,window,pos,passages", [
    ("Élise met Jane. Then élise left", "Elise", [], 2, [(0, 1), (4, 1)], ["Élise met", "Then élise left"]),
    ("a Jane. b", "Jane", [], 200, [], []),
    ("x Mary Ann y", "Mary", ["Mary Ann"], 2, [(1, 1)], ["x Mary Ann"]),
    ("x Mary Ann y", "Mary Ann", ["Mary"], 2, [(1, 2)], ["x Mary Ann y"]),
    ("a a a", "a a", [], 2, [(0, 2)], ["a a a"]),
    ("", "any", [], 200, [], []),
])
def test_hand_cases(spark, text, name, aliases, window, pos, passages):
    got_pos, got_pass = run(spark, text, name, aliases, window)
    assert got_pos == pos
    assert got_pass == passages


def test_no_overlap_and_order(spark):
    text = " ".join(["of the the of the and the"] * 50)
    got_pos, _ = run(spark, text, "the", ["of the", "and"], 10)
    ends = [p + n for p, n in got_pos]
    assert all(got_pos[i + 1][0] >= ends[i] for i in range(len(got_pos) - 1))


def test_chain_of_overlapping_candidates(spark):
    # positions 0,1,2,3 all start "x x"; greedy keeps 0 and 2
    got_pos, _ = run(spark, "x x x x x", "x x", [], 2)
    assert got_pos == [(0, 2), (2, 2)]


def test_normalize_aliases_forms(spark):
    df = spark.createDataFrame([(" a, b ,, c ",), (None,)], "aliases string")
    out = [r[0] for r in df.select(normalize_aliases(df, "aliases")).collect()]
    assert out == [["a", "b", "c"], []]
    dv = spark.sql("""select parse_json('["x", " ", "y "]') v union all select parse_json('"p, q"')""")
    out = [r[0] for r in dv.select(normalize_aliases(dv, "v")).collect()]
    assert sorted(out) == sorted([["x", "y"], ["p", "q"]])


def test_book_missing_drops_character(spark):
    books = spark.createDataFrame([("b", "Jane went")], "url string, text string")
    chars = spark.createDataFrame([("b", "Jane", []), ("z", "Jane", [])],
                                  "url string, name string, aliases array<string>")
    m = extract_mentions(books, chars, 4)
    assert [r["url"] for r in m.select("url").collect()] == ["b"]
    assert m.where(F.col("url") == "z").count() == 0


def test_long_overlap_run_uses_linear_pass(spark):
    # 200 tokens "x": every position starts "x x"; one run of 199 candidates
    text = " ".join(["x"] * 200) + " end"
    got_pos, _ = run(spark, text, "x x", [], 2)
    assert got_pos == [(p, 2) for p in range(0, 200, 2)]


def brute(text, cast, window):
    """Mentions of one book, sequentially: (character, pos, len, passage)."""
    toks = text.split()
    low = [t.lower() for t in toks]
    out, half = [], max(1, window // 2)
    for name, aliases in cast:
        end = 0
        for pos in range(len(toks)):
            hit = next((a.lower().split() for a in [name, *aliases] if low[pos:pos + len(a.split())] == a.lower().split()), None)
            if hit and pos >= end:
                end = pos + len(hit)
                out.append((name, pos, len(hit), " ".join(toks[max(0, pos - half):end + half])))
    return sorted(out)


CAST = [("a", ["a b", "b b a"]), ("a a a a", ["b a"]), ("b b", ["a b a"]), ("c", [])]


@pytest.mark.parametrize("block", [4, 5, 7, 1 << 13])
@pytest.mark.parametrize("chunked", [False, True])
def test_blocks_equal_the_whole_book(spark, block, chunked):
    """Runs of overlapping phrases over many blocks, and halos wider than a block."""
    rnd = random.Random(block)
    texts = {f"b{i}": " ".join(rnd.choices("ab" if i % 3 else "abC", k=rnd.randint(1, 90))) for i in range(12)}
    texts |= {"run": "a " * 200, "alternate": "a b " * 120, "none": "x y z", "empty": " "}
    if chunked:
        rows = [(u, n, t[i:j]) for u, t in texts.items() for n, (i, j) in enumerate([(0, 20), (20, 22), (22, 60), (60, 60), (60, len(t))])]
        books = spark.createDataFrame(rows, "url string, chunk_no int, text string")
        texts = {u: " ".join(t[i:j] for i, j in [(0, 20), (20, 22), (22, 60), (60, 60), (60, len(t))]) for u, t in texts.items()}
    else:
        books = spark.createDataFrame(list(texts.items()), "url string, text string")
    cast = spark.createDataFrame([(u, n, a) for u in [*texts, "lost"] for n, a in CAST], "url string, name string, aliases array<string>")
    got = extract_mentions(books, cast, 6, block=block).collect()
    for url, text in texts.items():
        mine = sorted((r["character"], r["pos"], r["len"], r["passage"]) for r in got if r["url"] == url)
        assert mine == brute(text, CAST, 6), url
        for name, _ in CAST:
            own = sorted((r["pos"], r["mention_no"]) for r in got if r["url"] == url and r["character"] == name)
            assert [n for _, n in own] == list(range(len(own)))


def test_no_task_holds_a_whole_book(spark):
    books = spark.createDataFrame([("big", "a b c d " * 50_000), ("small", "a b")], "url string, text string")
    blocks = token_blocks(books, 3, 4, block=1000).select("url", "block", F.size(F.split("text", " ")).alias("n")).collect()
    assert len(blocks) == 201 and max(r["n"] for r in blocks) == 1007
    cast = spark.createDataFrame([("big", "a", ["b c"])], "url string, name string, aliases array<string>")
    assert extract_mentions(books, cast, 2, block=1000).groupBy("character").count().first()["count"] == 100_000


@pytest.mark.parametrize("names", [1, 200])
def test_phrase_book_finds_all(names):
    rnd = random.Random(names)
    phrases = [[rnd.choice("abc") for _ in range(rnd.randint(1, 5))] for _ in range(names)]
    toks = rnd.choices("abcd", k=400)
    which, where = PhraseBook(phrases).find(toks)
    want = [(i, p) for p in range(len(toks)) for i, x in enumerate(phrases) if toks[p:p + len(x)] == x]
    assert sorted(zip(which, where)) == sorted(want)


def test_phrase_book_steps_do_not_grow_with_the_cast():
    """Automaton steps per token stay below two however many phrases there are."""
    rnd = random.Random(3)
    toks = [rnd.choice("abcdefgh") for _ in range(3000)]
    for names in (1, 10, 1000, 10_000):
        book = PhraseBook([[rnd.choice("abcdefgh") for _ in range(6)] for _ in range(names)])
        falls, step = [0], book._step

        def counted(at, key):
            depth = at
            while depth and key not in book.go[depth]:
                depth, falls[0] = book.fall[depth], falls[0] + 1
            return step(at, key)

        book._step = counted
        book.find(toks)
        assert falls[0] <= len(toks)


def test_places_are_found_in_flat_lists():
    """The search keeps no pandas strings: Arrow in, 32-bit lists out."""
    import pyarrow as pa

    from charlens.operators.mentions import _find_batch

    got = _find_batch(pa.array(["a B a b", "x", "Éa b"]), pa.array(["a b\nb", "a b\nb", "ea"]))
    assert got.type == pa.struct([("which", pa.list_(pa.int32())), ("place", pa.list_(pa.int32()))])
    assert got.to_pylist() == [{"which": [0, 1, 0, 1], "place": [0, 1, 2, 3]}, {"which": [], "place": []}, {"which": [0], "place": [0]}]


def test_chunks_are_gathered_once(spark, tmp_path):
    """The branches read a table of the chunks, not the Python step that gathers them."""
    from charlens.sources.io import read_book_chunks

    (tmp_path / "a.txt").write_text("Anna saw\nBo and Anna\n" * 50)
    books = read_book_chunks(spark, str(tmp_path), chunk_chars=100)
    cast = books.select("url").distinct().selectExpr("url", "'Anna' name", "array('Bo') aliases")
    df = extract_mentions(books, cast, 4, block=64)
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 150


def test_inference_stores_no_passage_before_the_choice(spark, monkeypatch):
    """Checkpoints hold places, keys and chosen passages; equal passages and books listed twice are right."""
    from pyspark.sql.classic.dataframe import DataFrame

    from charlens.operators.inference import letter_embed, mock_model
    from charlens.plans.inference_job import run_inference

    seen, plain = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: (seen.append(set(self.columns)), plain(self, *a, **k))[1])
    books = spark.createDataFrame([("u", "Al x Al x Bo"), ("v", "Al x Al x Bo"), ("w", "Bo"), ("w", "Bo")], "url string, text string")
    cast = spark.createDataFrame([(u, n, ["Bo"] if n is None else []) for u in "uvw" for n in ("Al", "Bo", None)], "url string, name string, aliases array<string>")
    for strategy, most in (("all_mentions", 2), ("embedding", 1)):
        out = run_inference(spark, books, cast, ["age"], strategy, mock_model(["age"]), letter_embed("ax"), window=2, k=1)
        got = {(r["book"], r["character"]): (r["status"], r["mentions_counter"], len(r["selected_passages"])) for r in out.collect()}
        assert got == {(u, n): ("ok", 2, most) if n == "Al" else ("ok", 1, 1) for u in "uv" for n in ("Al", "Bo")} | {
            ("w", "Al"): ("skipped", 0, 0), ("w", "Bo"): ("ok", 2, 2)} | {(u, None): ("skipped", 0, 0) for u in "uvw"}
    assert seen and not any({"passage", "prompt"} & c for c in seen)


def test_all_mentions_move_no_passage(spark):
    """Neither an exchange nor a checkpoint holds the overlapping passages or the prompts made of them."""
    from charlens.operators.inference import mock_model
    from charlens.plans.inference_job import run_inference

    books = spark.createDataFrame([(f"u{i}", "Al saw Bo and " * 50) for i in range(4)], "url string, text string")
    cast = spark.createDataFrame([(f"u{i}", n, []) for i in range(4) for n in ("Al", "Bo")], "url string, name string, aliases array<string>")
    out = run_inference(spark, books, cast, ["age"], "all_mentions", mock_model(["age"]))
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    nodes = {m[1]: m[2] for m in re.finditer(r"\(\d+\) ([^\n]+)\n((?:[^\n]+\n)+)", plan) if "Exchange" in m[1] or "Scan" in m[1]}
    assert nodes and not [n for n, text in nodes.items() if re.search(r"\b(passages?|prompt|selected_passages|exc)#", text)]
    rows = out.collect()
    assert len(rows) == 8 and all(r["status"] == "ok" and r["mentions_counter"] == len(r["selected_passages"]) == 50 for r in rows)


@pytest.mark.parametrize("block", [7, 1 << 13])
@pytest.mark.parametrize("form", ["once", "twice", "chunked"])
def test_all_mentions_in_blocks_and_copies(spark, tmp_path, monkeypatch, block, form):
    """Characters of one block, of several and of books listed twice have the passages of the
    mention rows; every distinct prompt is sent once."""
    from charlens.operators import mentions as MN
    from charlens.operators.retrieval import all_passages
    from charlens.plans.inference_job import run_inference

    monkeypatch.setattr(MN, "BLOCK", block)
    rnd = random.Random(block)
    texts = [(f"b{i}", " ".join(rnd.choices(["a", "b", "É", "dé"] if i % 3 else ["a", "C", "x"], k=rnd.randint(20, 60)))) for i in range(8)]
    texts += [("same1", "a x b"), ("same2", "a x b"), ("none", "x y"), ("empty", " "), (None, "a b")]
    if form == "twice":
        texts += [(u, t[::-1]) for u, t in texts[:4]] + texts[4:6]
    names = [*CAST, ("e", ["De"]), ("lost", []), (None, ["b"])]
    cast = spark.createDataFrame([(u, n, a) for u in dict.fromkeys(u for u, _ in texts) for n, a in names] + [("away", "a", [])],
                                 "url string, name string, aliases array<string>")
    if form == "chunked":
        books = spark.createDataFrame([(u, k, t[i:j]) for u, t in texts for k, (i, j) in enumerate([(0, 20), (20, 30), (30, len(t))])], "url string, chunk_no int, text string")
    else:
        books = spark.createDataFrame(texts, "url string, text string")
    log = str(tmp_path / "asked")

    def model(prompts):
        with open(log, "a") as f:
            f.writelines(f"{hash(p)}\n" for p in prompts)
        return [p[:20] for p in prompts]

    out = run_inference(spark, books, cast, ["age"], "all_mentions", model, window=6).collect()
    asked = open(log).read().split()
    want = {(r["url"], r["character"]): r["passages"] for r in all_passages(extract_mentions(books, cast, 6)).collect() if r["character"]}
    pairs = {(u, n) for u, _ in texts if u for n, _ in names}
    assert len(out) == len(pairs) and {(r["book"], r["character"]) for r in out} == pairs
    for r in out:
        passages = want.get((r["book"], r["character"]), [])
        assert (r["selected_passages"], r["mentions_counter"], r["status"]) == (passages, len(passages), "ok" if passages else "skipped")
        assert r["output"] == (f"Character: {r['character']}\nWanted: age"[:20] if passages else None)
    assert len(asked) == len({(n, tuple(p)) for (_, n), p in want.items()})


def test_passages_in_pieces_of_a_text():
    """Bytes of passages in the whole text and in what they cover; behind a text's end they are empty."""
    import pyarrow as pa

    from charlens.operators.mentions import _spans_batch

    text, place = "é b c d e f g h i j", [0, 1, 6, 30]
    rows = [pa.array([text] * 2), pa.array([0, 0]), pa.array([place] * 2), pa.array([[1, 2, 1, 1]] * 2, pa.list_(pa.int32())), pa.array([1, 1]), pa.array([True, False])]
    for r, whole in zip(_spans_batch(*rows).to_pylist(), (text.encode(), "é b c df g h".encode())):
        assert (r["text"] or text.encode()) == whole
        assert [whole[a:z].decode() for a, z in zip(r["low"], r["high"])] == ["é b", "é b c d", "f g h", ""]


def test_long_prompts_go_to_the_model_in_parts(spark, tmp_path, monkeypatch):
    from charlens.operators import inference

    monkeypatch.setattr(inference, "PART", 1000)
    log = str(tmp_path / "sizes")

    def model(prompts):
        with open(log, "a") as f:
            f.write(f"{len(prompts)} {sum(map(len, prompts))}\n")
        return [p[-3:] for p in prompts]

    df = spark.createDataFrame([(i, "x" * 300 + f"{i:03d}") for i in range(40)] + [(40, "y" * 5000 + "040")], "i int, prompt string").coalesce(1)
    got = {r["i"]: (r["output"], r["status"]) for r in inference.infer(df, model).collect()}
    assert got == {i: (f"{i:03d}", "ok") for i in range(41)}
    calls = [tuple(map(int, line.split())) for line in open(log)]
    assert sum(n for n, _ in calls) == 41 and max(size for _, size in calls) <= 6400
