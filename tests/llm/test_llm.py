"""Every operator against a brute-force version, and the defined edge cases."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from charlens.llm import components, ctw, decontam, exchange, hilbert, jaccard, langid, quality, queries, substring, toolcalls, unigram, vptree

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, chunk string"

LONG = " ".join(f"w{i}" for i in range(30000))
EDGE = [(1, None, None, None, None, "x", "y"), (2, "", "en", None, 0, "x", "y"), (3, "   \n ", "en", "s", 5, "x", "y"),
        (4, "one two three", "en", "s", 13, "x", "y"), (5, "one two three", "en", "s", 13, "x", "y"), (5, "one two three", "en", "s", 13, "x", "y"),
        (6, LONG, "en", "s", 1, "x", "y"), (7, LONG + " more", None, "s", 1, "x", "y"), (8, "日本 été ▁ 😀\x00", "fr", "s", 9, "x", "y"),
        (None, "one two three", "en", "s", 13, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").cache()
    yield frame
    frame.unpersist()  # the session is shared: later plans must read the file


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_ctw_base_and_blocks(docs, texts):
    got = {r["doc_id"]: r for r in queries.op1_context_tree(docs.sparkSession, SF).collect()}
    tokens = {i: SPACED.findall(t.translate(LOW)) + ["\0end"] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-12)
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)


def test_ctw_query_without_ids(spark, tmp_path):
    spark.createDataFrame([(None, "a b"), (1, "a c"), (2, None), (4, "b")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op1_context_tree(spark, str(tmp_path)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in (1, 2, 4)}
    assert {i: r["held_out"] for i, r in rows.items()} == {None: False, **held}
    assert rows[None]["train_tokens"] == sum(n for i, n in ((1, 3), (2, 1), (4, 2)) if not held[i])


def brute_ctw(train, text):
    """Trees as dictionaries, weighted and mixed as in the definition."""
    frame = lambda t: [0xFF] * 5 + list(t.translate(LOW).encode()) + [0xFF]
    count = collections.Counter()
    for t in train:
        f = frame(t)
        for i in range(5, len(f)):
            for j in range(8):
                p, b = (1 << j) | (f[i] >> (8 - j)), (f[i] >> (7 - j)) & 1
                for d in range(6):
                    count[tuple(f[i - d:i][::-1]), p, b] += 1
    nodes = {(c, p) for c, p, _ in count}
    log_w, stop = {}, {}
    for c, p in sorted(nodes, key=lambda x: -len(x[0])):
        own = float(ctw.log_kt(np.array([count[c, p, 0]]), np.array([count[c, p, 1]]))[0])
        if len(c) == 5:
            log_w[c, p], stop[c, p] = own, 1.0
        else:
            below = sum(log_w[x] for x in nodes if x[1] == p and len(x[0]) == len(c) + 1 and x[0][:len(c)] == c)
            log_w[c, p] = np.logaddexp(own, below) + np.log(0.5)
            stop[c, p] = np.exp(np.log(0.5) + own - log_w[c, p])
    total, f = 0.0, frame(text)
    for i in range(5, len(f)):
        for j in range(8):
            p, b = (1 << j) | (f[i] >> (8 - j)), (f[i] >> (7 - j)) & 1
            mix, rest, last = 0.0, 1.0, 0.5
            for d in range(6):
                c = tuple(f[i - d:i][::-1])
                if (c, p) not in nodes:
                    break
                last = (count[c, p, 1] + 0.5) / (count[c, p, 0] + count[c, p, 1] + 1)
                mix += rest * stop[c, p] * last
                rest *= 1 - stop[c, p]
            one = mix + rest * last
            total += np.log10(one if b else 1 - one)
    return total


def test_ctw_scores(spark, empty):
    rows = [(1, "the cat sat"), (2, "the dog sat on it"), (3, "A cat, été"), (4, None), (5, "zq")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.scored(df, F.col("doc_id") <= 2).collect()}
    train = [t for i, t in rows if i <= 2]
    for i, t in rows:
        assert got[i] == pytest.approx(brute_ctw(train, t or ""), rel=1e-5)
    untrained = ctw.scored(df, F.lit(False)).where("doc_id = 5").first()
    assert untrained["score"] == pytest.approx(3 * 8 * np.log10(0.5), rel=1e-5)
    assert ctw.scored(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 18])
def test_ctw_framed(piece):
    words = ["", "a", "the cat", "été", "x" * 200, ""]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])])
    got = [(int(k), int(d)) for keys, docs in ctw.framed(data, off, piece) for k, d in zip(keys, docs)]
    want = []
    for d, w in enumerate(words):
        f = bytes([0xFF] * 5) + w.encode() + b"\xff"
        want += [(int.from_bytes(f[i - 5:i][::-1] + f[i:i + 1], "big"), d) for i in range(5, len(f))]
    assert got == want


def test_ctw_rows(spark):
    """Repeated rows, rows without ids, a very long text and columns with the operator's names."""
    long = " ".join(f"w{i % 977} the" for i in range(60000))
    rows = [(1, "a b c", 7, "x"), (1, "a b c", 8, "y"), (None, "a b d", 9, None), (None, None, 1, "z"), (2, long, 3, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score bigint, chunk string")
    got = ctw.scored(df, F.lit(True)).collect()
    words = collections.Counter(w for _, t, *_ in rows for w in SPACED.findall(t or "") + ["\0end"])
    assert len(got) == 5 and {r["train_tokens"] for r in got} == {sum(words.values())}
    assert sorted(r["n_tokens"] for r in got) == [1, 4, 4, 4, 120001]
    one, two = [r["score"] for r in got if r["doc_id"] == 1]
    assert one == two < 0
    assert all(np.isfinite(r["score"]) for r in got)


def test_log_gamma():
    import math
    x = np.array([0.5, 1, 1.5, 7.25, 1e3, 1e7])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-9)


def test_tool_links(spark):
    calls = spark.createDataFrame([
        ("a", 1, "t", '{"n": 1, "s": "x"}', []), ("b", 2, "t", '{"s": 5}', ["a", "gone"]), ("c", 3, "t", "{oops", ["b", "a"]),
        ("d", 4, "t", '{"s":"q","n":2,"z":[1, {"b":1,"a":2}]}', ["e"]), ("e", 5, "free", None, ["d"]), ("a", 1, "t", '{"n": 1, "s": "x"}', []),
        (None, 6, "t", "{}", []), ("f", 7, "t", '{"s":"\\u00e9\\"","n":1}', None)],
        "call_id string, position bigint, tool string, arguments string, after array<string>")
    results = spark.createDataFrame([("a", "two"), ("a", "one"), ("b", None), ("zz", "lost"), (None, "x"), ("f", "ok")], "call_id string, content string")
    schemas = spark.createDataFrame([("t", "n", "number", True), ("t", "s", "string", False)], "tool string, argument string, kind string, required boolean")
    rows = toolcalls.linked(calls, results, schemas).collect()
    got = {r["call_id"]: r for r in rows if r["call_id"]}
    assert [got[x]["status"] for x in "abcdef"] == ["ok", "invalid", "invalid", "cyclic", "cyclic", "ok"]
    assert [got[x]["level"] for x in "abcf"] == [0, 1, 2, 0] and got["a"]["copies"] == 2 and got["b"]["dangling"] == 1
    assert got["b"]["errors"] == ["missing n", "type s"] and got["c"]["errors"] == ["malformed"] and got["d"]["errors"] == ["unknown z"]
    assert got["a"]["message"] == '{"arguments":{"n":1,"s":"x"},"id":"a","name":"t","result":"one"}'
    assert json.loads(got["f"]["message"])["arguments"] == {"n": 1, "s": 'é"'}
    assert '"z":[1,{"a":2,"b":1}]' in got["d"]["message"] and got["zz"]["status"] == "orphan"
    assert sum(r["status"] == "no_id" for r in rows) == 2
    assert toolcalls.linked(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_tool_tables_without_ids(spark, tmp_path):
    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    kinds = dict(talk.dtypes)
    own = talk.select(F.min("conv_id").alias("c")).first()["c"]
    rows = [(c, t, role, f"text {k}") for k, (c, t, role) in enumerate(
        [(own, 0, "user"), (own, 1, "assistant"), (None, 0, "user"), (None, 1, "assistant"), (None, 0, "user"),
         (None, 1, "assistant"), (None, 2, "user"), (own, None, "user"), (own, None, "assistant")])]
    df = spark.createDataFrame(rows, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op2_tool_links(spark, str(tmp_path)).collect()
    linked = [r for r in got if r["call_id"] is not None]
    assert [(r["call_id"], r["copies"]) for r in linked] == [(f"{own}-0", 1)] and '"result":"text 1"' in linked[0]["message"]
    assert len(got) == 8 and sum(r["status"] == "no_id" for r in got) == 7
    calls = [r["position"] for r in got if r["status"] == "no_id" and r["tool"] is not None]
    assert sorted(calls, key=lambda p: (p is None, p)) == [0, 0, 2, None]


def test_language(spark, docs, edge, empty):
    rows = queries.op3_language_masks(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    model = langid.learn(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(edge, model).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in model.langs
    assert langid.learn(empty) is None and langid.predict(edge, None).first()["lang_pred"] == "und"
    data, off = np.frombuffer(b"the cat", np.uint8), np.array([0, 7])
    _, g = langid.grams(data, off)
    assert {int(x).to_bytes(4, "big") for x in g} == {b" the", b"the ", b"he c", b"e ca", b" cat", b"cat "}


@pytest.mark.parametrize("factor,leaf,shard_rows,block", [(1.0, 256, 16384, 2048), (1.0, 8, 60, 3)])
def test_vantage_points(spark, factor, leaf, shard_rows, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vptree.nearest(df, df.where("vec_id % 20 = 0"), 20, factor, leaf, shard_rows, block).orderBy("query_id", "rank").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    y = x.astype(np.float64)
    for q in range(0, 300, 20):
        s = np.zeros(300)
        for j in range(8):
            s += y[:, j] * y[q, j]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        assert [v for v, _ in by[q]] == order and [v for _, v in by[q]] == [s[i] for i in order]
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_vantage_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(rows, asked, leaf=16).collect()}
    loose = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(rows, asked, factor=0.9, leaf=16).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)


def test_unigram(spark, texts, edge, empty):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=unigram.MODEL)
    p = unigram.load()
    pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}

    def best(text):
        s = "▁" + text.replace(" ", "▁")
        top = [0.0] + [-1e300] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 25) + 1):
                k = pieces.get(s[i:j])
                top[j] = max(top[j], top[i] + (p.score[k] if k is not None else p.unknown if j == i + 1 else -1e300))
        return top[-1]

    rows = [(i, t[:400]) for i, t in list(texts.items())[:60]] + [(-1, "a  b "), (-2, "日本 😀x"), (-3, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for r in unigram.encoded(df).collect():
        t = dict(rows)[r["doc_id"]]
        assert r["round_trip"] and (not t or r["score"] == pytest.approx(best(t), rel=1e-9))
    out = unigram.encoded(edge)
    assert out.where("not round_trip").count() == 0 and out.where("doc_id <= 2").agg(F.sum("n_tokens")).first()[0] == 0
    back = {(r["doc_id"], r["text"]) for r in unigram.decoded(out).collect()}
    assert back == {(r[0], (r[1] or "").replace("▁", " ")) for r in EDGE}
    assert unigram.encoded(empty).count() == 0
    long = unigram.encoded(spark.createDataFrame([(1, "x" * 3000)], "doc_id bigint, text string")).first()
    assert long["round_trip"]


def shingles(text):
    w = SPACED.findall(text.translate(LOW))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("rare,often,leaders", [(16, 256, 64), (2, 256, 2), (2, 4, 1), (1, 2, 64)])
def test_jaccard(spark, rare, often, leaders):
    rng = np.random.default_rng(rare)
    base = [f"v{i}" for i in rng.integers(0, 500, 60)]
    texts = {}
    for i in range(60):
        w = list(base[:rng.integers(30, 60)]) if i % 3 else [f"u{x}" for x in rng.integers(0, 40, 12)]
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(len(w))] = f"n{rng.integers(9)}"
        texts[i] = " ".join(w)
    texts |= {100: "", 101: " \n", 102: "a b", 103: "A  b", 104: "a b c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, rare=rare, often=often, leaders=leaders).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("again", [range(40), range(0, 40, 3)])
def test_jaccard_repeated_rows(spark, again):
    rng = np.random.default_rng(7)
    texts = {}
    for i in range(20):
        w = [f"p{i}x{x}" for x in range(60)]
        texts[2 * i] = " ".join(w)
        w[rng.integers(5, 35)] = "other"
        texts[2 * i + 1] = " ".join(w[:58])
    want = brute_components(texts)
    assert len({c for _, c in want.values()}) == 20
    rows = list(texts.items())
    df = spark.createDataFrame(rows + [rows[i] for i in again], "doc_id bigint, text string")
    for often, leaders in ((256, 64), (3, 1)):
        got = jaccard.near_duplicates(df, often=often, leaders=leaders).collect()
        assert len(got) == 40 + len(again) and {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, *v) for i, v in want.items()}


def test_jaccard_member_sets(spark):
    found = spark.createDataFrame([(c, 9, [s]) for s, members in ((1, (5, 5, 6)), (2, (7, 7, 6)), (3, (5, 5, 6)), (4, (8, 8))) for c in members],
                                  "cls bigint, n bigint, signs array<bigint>")
    assert {r["sign"] for r in jaccard.grouped(found).collect()} == {1, 2, 4}


def wide_stages(spark, group, work):
    """Stages of ``work`` with a task for each of 53 shuffle partitions, and its result."""
    tracker, before = spark.sparkContext.statusTracker(), {}
    for k, v in (("spark.sql.shuffle.partitions", "53"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        before[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(getattr(tracker.getStageInfo(s), "numTasks", 0) == 53 for s in stages), got


@pytest.mark.parametrize("rows", [exchange.ROWS, 40])
def test_components_of_few_links(spark, monkeypatch, rows):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(100, 140)] + [tuple(map(int, x)) for x in rng.integers(0, 100, (50, 2))] + [(200, 150 + i) for i in range(45)]
    up = {x: x for link in links for x in link}
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame(links, "a bigint, b bigint")
    whole = exchange.gathered
    monkeypatch.setattr(exchange, "gathered", lambda df, name: whole(df, name, rows))
    wide, got = wide_stages(spark, f"links-{rows}", lambda: components.components(df).collect())
    assert {(r["node"], r["component"]) for r in got} == {(x, c) for x, c in up.items() if any(x in p and p[0] != p[1] for p in links)}
    if rows == exchange.ROWS:  # few links: only the first grouping deals its rows out
        assert wide <= 1


def test_jaccard_members_once(spark):
    posts = spark.createDataFrame([(1, 9, 7)] * 4 + [(2, 9, 7), (3, 9, 8), (4, 9, 8)], "cls bigint, n bigint, sign bigint")
    parts = spark.createDataFrame([(3, 3), (4, 3)], "node bigint, component bigint")
    got = [tuple(r) for r in jaccard._unfinished(posts, parts).collect()]
    assert sorted(got) == [(7, 1, 9, 1, False), (7, 2, 9, 2, True)]


def test_jaccard_edges(edge, empty):
    rows = jaccard.near_duplicates(edge).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows] == [
        (None, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 29996, 6), (7, 29997, 6), (8, 1, 8)]
    assert jaccard.near_duplicates(empty).count() == 0


def brute_leaks(text, windows):
    w = ALNUM.findall(text.translate(LOW))
    hit, items = set(), set()
    for n in {len(k) for k in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in windows:
                items |= windows[tuple(w[k:k + n])]
                hit |= set(range(k, k + n))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("slices", [200_000, 50])
def test_decontamination(spark, docs, texts, slices):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = collections.defaultdict(set)
    for r in bench.collect():
        w = ALNUM.findall((r["text"] or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(str(r["item_id"]))
    for r in decontam.scan(docs, bench, slice_windows=slices, texts=False).collect():
        assert (r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), r["items"]) == brute_leaks(texts[r["doc_id"]], windows)


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_decontamination_clashing_names(spark, mode):
    """Columns named like the operator's own come back as they were."""
    leak = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"before {leak} after", 77, "keep", 5, None, "d"), (2, "clean words", 78, "this", 6, "x", None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "key bigint, body string, n_words bigint, items string, spans bigint, `a.b` string, doc_id string")
    items = spark.createDataFrame([("i1", leak)], "item_id string, text string")
    got = decontam.clean(df, items, mode=mode, id_col="key", text_col="body")
    assert got.columns == df.columns and got.dtypes == df.dtypes
    want = rows[1:] if mode == "documents" else [(1, "before after", *rows[0][2:]), *rows[1:]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "Two, THREE"), (2, None), (3, "..."), (None, "one two")], "item_id bigint, text string")
    got = decontam.scan(edge, items, keep=("lang",)).collect()
    assert {r["doc_id"]: r["items"] for r in got}[4] == ["", "1"] and sum(bool(r["spans"]) for r in got) == 4
    kept = decontam.clean(edge, items, mode="spans")
    assert kept.columns == edge.columns and kept.where("doc_id = 4").first()["text"] == "" and kept.count() == len(EDGE)
    assert decontam.clean(edge, items).count() == len(EDGE) - 4
    assert decontam.scan(empty, items).count() == 0 and decontam.clean(edge, items.limit(0)).count() == len(EDGE)


def test_quality(spark, docs, edge, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = queries.op8_fourier_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in big) >= 0.95 * len(big)
    assert all(0 <= r["score"] <= 1 for r in big)
    none = quality.score(edge, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == len(EDGE)
    ones = spark.createDataFrame([(4, 1), (5, None), (6, 1)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(edge, ones).collect()} == {1.0}
    assert quality.score(empty, labels).count() == 0
    s, r = quality.pool_adjacent(np.array([0.0, 1, 2]), np.array([1.0, 1, 2]), np.array([1.0, 0, 2]))
    assert r.tolist() == [0.5, 1.0] and s.tolist() == [0.5, 2.0]


def test_hilbert(spark, edge, empty, tmp_path):
    g = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1)
    k = hilbert.curve_index(list(g), 3)
    assert sorted(k) == list(range(512)) and (np.abs(np.diff(g[:, np.argsort(k)], axis=1)).sum(axis=0) == 1).all()
    out = queries.op9_hilbert_runs(spark, SF)
    sizes = collections.defaultdict(list)
    for r in out.collect():
        sizes[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(16)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    few = hilbert.sharded(edge.withColumn("shard", F.lit("x")), ["lang", "n_chars"], 16)
    assert few.count() == len(EDGE) and few.select("shard").distinct().count() == len(EDGE)
    assert hilbert.sharded(empty, ["lang"], 4).count() == 0
    hilbert.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == out.count()


def brute_repeats(rows, window=13):
    least = {}
    words = [(i, SPACED.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = {x for k in range(len(w) - window + 1) if least[tuple(w[k:k + window])] < i for x in range(k, k + window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring(spark, seed):
    rng = np.random.default_rng(seed)
    source = [f"s{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = [f"r{x}" for x in rng.integers(0, 10**6, rng.integers(0, 40))]
        for _ in range(rng.integers(0, 3)):
            a, n = rng.integers(0, 180), rng.integers(8, 20)
            w[rng.integers(0, len(w) + 1):0] = source[a:a + n]
        rows.append((i, "\n ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in substring.remove_repeats(df, emit="digest").collect())
    assert got == brute_repeats(rows)


def test_substring_edges(edge, empty):
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["lang"]) for r in substring.remove_repeats(edge, keep=("lang",)).collect()}
    assert got >= {(1, 0, 0, None), (3, 0, 0, "en"), (5, 3, 0, "en"), (6, 30000, 0, "en"), (7, 30001, 30000, None)} and len(got) == 8
    kept = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(edge).collect()}
    assert kept[7] == "more" and kept[3] == "   \n " and kept[8] == EDGE[8][1]
    assert substring.remove_repeats(empty).count() == 0


def test_pipeline(spark, texts):
    import corpus_pipeline
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) <= len(texts) and len({r["doc_id"] for r in rows}) == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "leaks", "pieces"]


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_pipeline_quality_by_row(spark, tmp_path):
    import corpus_pipeline
    good, bad = "the cat sat on the mat and looked at the small dog near the door", "$$ ## 11 !! %% 99 ,, ;; QQ ZZ 00 @@"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(60)]
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows += [(None, good), (None, bad), (101, good), (101, bad)]
    want = [(i, t) for i, t in rows if t.startswith("the")]
    assert pairs(corpus_pipeline.keep_good(spark, rows_of(spark, rows), str(tmp_path))) == sorted(want, key=repr)


def test_pipeline_near_duplicates_by_row(spark):
    import corpus_pipeline
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, a), (1, a), (1, a + " end"), (2, "a " + a), (None, b), (None, b), (3, ""), (None, None), (4, "c d"), (4, "e f")]
    want = [(1, a), (None, b), (3, ""), (None, None), (4, "c d"), (4, "e f")]
    assert pairs(corpus_pipeline.one_of_each(spark, rows_of(spark, rows), "")) == sorted(want, key=repr)


def test_pipeline_repeats_by_row(spark):
    import corpus_pipeline
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(5, p + " one"), (5, p + " two"), (6, "three " + p), (None, p + " four"), (None, "a clean text"), (None, None), (7, "")]
    want = [(5, p + " one"), (5, "two"), (6, "three "), (None, "four"), (None, "a clean text"), (None, ""), (7, "")]
    assert pairs(corpus_pipeline.without_repeats(spark, rows_of(spark, rows), "")) == sorted(want, key=repr)
