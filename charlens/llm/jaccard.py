"""N-gram Jaccard join with token-combination prefixes.

Tokens are a document's distinct word shingles (48-bit hashes).  Documents with equal
token sets form a class; only class representatives are compared.  Tokens have a
global order: rare first (by the number of classes that hold them, then by hash).  Up to
``RARE`` classes a token is rare, up to ``OFTEN`` frequent, beyond that very frequent.

A document indexes a prefix of its tokens in that order: rare tokens one by one, and
where these do not suffice, runs of k neighbours: k = 2 for frequent tokens, k = 3 for
very frequent ones.  The prefix ends where no partner can break all of it.  Say X has
``n`` tokens, Y lacks ``a`` of them and has ``b`` others.  Similarity ``t`` means
``n - a >= t (n + b)``, so ``a + t b <= (1-t) n``.  A missing token breaks one single or
k runs, an extra one up to k - 1 runs; per unit of that budget at most
``B = max(k, (k-1)/t)`` runs.  So ``r`` singles, ``r2`` runs of two and ``r3`` of three
hold one that both have side by side if ``r + r2/B2 + r3/B3 > (1-t) n``.  The argument
holds for the document whose prefix ends first, and all the other's tokens up to there
are in its own prefix.  A document of few tokens cannot fill a prefix of runs of three;
below ``least_for_three`` tokens the runs are of two, and documents whose partners may
be that small index both ways.

Verification and components.  A signature's members form a group; groups with the
same members are one.  A group's members are first compared with its least and its
greatest member only; links become components, and members of one component need no
further comparison.  Groups that still span components go in rounds: leaders meet the
members of other components and leave the group, until no group spans two.  Members
outside the group's largest component lead first, those of most groups in front, so
that groups of one family have the same leaders.  Each round has four times the
leaders of the one before, so rounds grow with the logarithm of the largest group, and
members that a round has connected are not compared by the next.  A pair that many signatures
share meets at the least of them, as far as the ``FIRST`` least signatures of both
tell.  A narrow bitmap bounds the similarity from above where members meet, bitmaps
whose width grows with the set bound that of the distinct pairs; what passes is
verified on the sets.  So every pair that could link is verified,
bounded away or already connected, at every size of group alike.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from charlens.llm import exchange as X
from charlens.llm import textops as T
from charlens.llm.components import components

U = np.uint64
#: words of a shingle, least similarity in hundredths
SHINGLE, SIMILARITY = 5, 75
#: a token in more classes than this is frequent, very frequent
RARE, OFTEN = 16, 256
#: members of a group that meet all others in the first round
LEADERS = 64
#: 64-bit words of the narrow bitmap
NARROW = 16
#: least signatures of a document that tell whether a pair has met before
FIRST = 16


def token_sets(data: np.ndarray, off: np.ndarray, words: int):
    """Sorted (text index, 48-bit token) pairs of distinct shingles of a sub-block."""
    w = T.Words(data, off, T.NON_SPACE)
    at, h = w.windows(words)
    doc = w.doc[at]
    for n in range(1, words):
        few = np.flatnonzero(w.counts == n)
        if len(few):
            doc = np.concatenate([doc, few])
            h = np.concatenate([h, T.run_hash(w, w.bounds[few], n)])
    key = np.unique((doc.astype(np.uint64) << U(48)) | (h >> U(16)))
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1)


def _signatures(words: int):
    """(doc_id, n, s1, s2) of each text: size and two order-free sums of its set."""

    def run(batches):
        for batch in batches:
            data, off = T.text_buffer(batch.column("text"))
            out = [np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.uint64), np.zeros(len(off) - 1, np.uint64)]
            for i, j in T.sub_blocks(off):
                doc, tok = token_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], words)
                first, n = T.run_lengths(doc)
                if len(first):
                    at = doc[first] + i
                    out[0][at] = n
                    out[1][at] = np.add.reduceat(T.mix(tok), first)
                    out[2][at] = np.add.reduceat(T.mix(tok ^ U(0x5DEECE66D1234567)), first)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0]), pa.array(out[1].view(np.int64)), pa.array(out[2].view(np.int64))],
                ["doc_id", "n", "s1", "s2"])

    return run


def _chunk_sets(table: pa.Table, words: int):
    data, off = T.text_buffer(table.column("text"))
    for i, j in T.sub_blocks(off):
        doc, tok = token_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], words)
        yield doc + i, tok


def _once(table: pa.Table) -> pa.Table:
    """The rows of a chunk without those that repeat an id with the same text."""
    if len(table.column("doc_id").unique()) == table.num_rows:
        return table
    return table.group_by(["chunk", "doc_id", "text"], use_threads=False).aggregate([])


def _representatives(docs: pa.Table, ids: np.ndarray) -> pa.Table:
    """The rows of a chunk whose id is among the sorted ids."""
    return _once(docs.filter(pa.array(T.find(ids, docs.column("doc_id").to_numpy()) >= 0)))


def _count_pass(words: int, bits: int):
    """Chunk and its representatives -> packed tokens with the number of texts that hold
    each, and in a bucket of the chunk's own (below zero) the representatives' ids."""
    drop = U(48 - 32 - bits) if bits < 16 else U(0)
    key_bits = min(48, 32 + bits)

    def run(key, docs: pa.Table, reps: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        ids = np.sort(reps.column("rep").to_numpy())
        parts = [tok >> drop for _, tok in _chunk_sets(_representatives(docs, ids), words)]
        tokens = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        first, n = T.run_lengths(tokens)
        packed = X.pack(chunk, bits, key_bits, tokens[first], many=np.minimum(n, 255).astype(np.uint8))
        own = pa.table({"bucket": pa.array([-1 - chunk], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
                        "keys": pa.array([ids.tobytes()], pa.binary()), "many": pa.array([b""], pa.binary())})
        return pa.concat_tables([packed, own])

    return run


def _total(kind):
    """Bucket -> for each chunk its tokens held by several texts, with their number."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["chunk", "bucket", "keys", "many"])
        key, row = X.unpack(table, keys=kind)
        many, _ = X.unpack(table, many=np.uint8)
        order = np.argsort(key, kind="stable")
        key, row, many = key[order], row[order], many[order].astype(np.int64)
        first, n = T.run_lengths(key)
        total = np.repeat(np.add.reduceat(many, first), n) if len(first) else many
        several = total > 1
        return X.answers(table, row[several], keys=key[several], many=np.minimum(total[several], 1 << 30).astype(np.int32))

    return run


def breaks(k: int, similarity: int) -> Fraction:
    """Runs of ``k`` tokens that a unit of the difference can break at most."""
    return max(Fraction(k), Fraction(100 * (k - 1), similarity))


def least_for_three(similarity: int) -> float:
    """Tokens from which runs of three always fill a prefix (three of a document's places start no run)."""
    room = 1 - breaks(3, similarity) * Fraction(100 - similarity, 100)
    return int(3 / room) + 1 if room > 0 else float("inf")


def signatures(t: np.ndarray, d: np.ndarray, similarity: int, rare: int, often: float) -> list[np.ndarray]:
    """Signatures of a set's tokens ``t``, held by ``d`` classes each, in the global order."""
    left = Fraction((100 - similarity) * len(t), 100)
    r, s = (int(np.searchsorted(d, x, "right")) for x in (rare, often))
    one = t[:min(r, int(left) + 1)]
    out = [T.mix(one[d[:len(one)] > 1])]
    left -= r
    for k, part in ((2, t[r:s]), (3, t[s:])):
        if left < 0:
            break
        b = breaks(k, similarity)
        run = part[:int(b * left) + k]
        n = max(0, len(run) - k + 1)
        h = np.full(n, U(k))
        for j in range(k):
            h = T.mix(h + run[j:j + n] * U(0x9E3779B97F4A7C15))
        out.append(h)
        left -= n / b
    return out


def map_words(n: int) -> int:
    """64-bit words of the bitmap of a set of ``n`` tokens: 8 to 32 bits a token."""
    words = NARROW
    while 8 * n > 64 * words:
        words *= 4
    return words


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """A bit per token; maps of one width differ in no more bits than sets do in tokens."""
    out = np.zeros(64 * words, np.uint8)
    out[(T.mix(tokens) % U(64 * words)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def _index_pass(words: int, similarity: int, bits: int, rare: int, often: int):
    """Chunk and token counts -> (cls, n, signs, tokens, narrow, bits, wide) of texts with any signature.

    ``wide``: the bitmap as wide as that of the largest partner, empty where ``bits`` is.
    """
    drop = U(48 - 32 - bits) if bits < 16 else U(0)
    key_bits = min(48, 32 + bits)
    three = least_for_three(similarity)

    def run(key, docs: pa.Table, counts: pa.Table) -> pa.Table:
        rows = sorted(zip(counts.column("bucket").to_pylist(), counts.column("keys").to_pylist(), counts.column("many").to_pylist()))
        reps = np.concatenate([np.frombuffer(k, np.int64) for b, k, _ in rows if b < 0] or [np.zeros(0, np.int64)])
        rows = [r for r in rows if r[0] >= 0]
        rest = key_bits - bits
        kind = np.uint32 if rest <= 32 else np.uint64
        known = np.concatenate([np.frombuffer(k, kind).astype(np.uint64) | U(b << rest) for b, k, _ in rows]) if rows else np.zeros(0, np.uint64)
        many = np.concatenate([np.frombuffer(m, np.int32) for _, _, m in rows]) if rows else np.zeros(0, np.int32)
        del rows
        docs = _representatives(docs, reps)
        ids, out = docs.column("doc_id").to_pylist(), []
        for doc, tok in _chunk_sets(docs, words) if len(known) else ():
            at = T.find(known, tok >> drop)
            held = np.where(at >= 0, many[at], 1)
            first, size = T.run_lengths(doc)
            shared = np.add.reduceat((held > 1).astype(np.int64), first) if len(first) else first
            for f, n, s in zip(first.tolist(), size.tolist(), shared.tolist()):
                if 100 * (n - s) > (100 - similarity) * n:
                    continue  # the prefix is full of tokens that no other class has
                t, d = tok[f:f + n], held[f:f + n]
                order = np.lexsort((t, d))
                t, d = t[order], d[order]
                signs = signatures(t, d, similarity, rare, often) if n >= three else []
                if similarity * n < 100 * three:
                    signs = signs + signatures(t, d, similarity, rare, float("inf"))
                signs = np.unique(np.concatenate(signs))
                if len(signs):
                    own, wide = map_words(n), map_words(100 * n // similarity)
                    out.append((ids[doc[f]], n, signs.view(np.int64), np.sort(t).view(np.int64), bitmap(t, NARROW), bitmap(t, own),
                                bitmap(t, wide) if wide > own else np.zeros(0, np.int64)))
        lists = lambda k: pa.ListArray.from_arrays(
            np.concatenate(([0], np.cumsum([len(x[k]) for x in out]))).astype(np.int32),
            pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64)))
        return pa.table({"cls": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int64()),
                         "signs": lists(2), "tokens": lists(3), "narrow": lists(4), "bits": lists(5), "wide": lists(6)})

    return run


def classes(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls): ``cls`` is the least id with an equal token set, null without tokens or id."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    marks = X.cut(source.mapInArrow(_signatures(words), "doc_id bigint, n bigint, s1 bigint, s2 bigint"))
    reps = marks.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("cls"))
    same = [F.col(f"m.{c}") == F.col(f"r.{c}") for c in ("n", "s1", "s2")]
    return marks.alias("m").join(reps.alias("r"), same, "left").select(
        "m.doc_id", F.col("m.n").alias("n_shingles"), F.when(F.col("m.doc_id").isNotNull(), F.col("r.cls")).alias("cls"))


def candidates(docs: DataFrame, members: DataFrame, words: int = SHINGLE, similarity: int = SIMILARITY, rare: int = RARE,
               often: int = OFTEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(cls, n, signs, tokens, narrow, bits, wide) of the class representatives that could have a partner.

    Texts move once, to their chunks; each chunk is told its representatives.
    """
    chunks = X.chunk_count(docs, text_col)
    bits = X.bucket_bits(chunks)
    kind = np.uint32 if min(48, 32 + bits) - bits <= 32 else np.uint64
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = X.chunked(source, chunks).repartition(chunks, "chunk")
    reps = X.chunked(members.where("doc_id = cls").select("doc_id").distinct(), chunks, text="doc_id").select("chunk", F.col("doc_id").alias("rep"))
    counts = (texts.groupBy("chunk").cogroup(reps.groupBy("chunk"))
              .applyInArrow(_count_pass(words, bits), "bucket int, chunk int, keys binary, many binary")
              .groupBy("bucket").applyInArrow(_total(kind), "chunk int, bucket int, keys binary, many binary"))
    return texts.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(
        _index_pass(words, similarity, bits, rare, often),
        "cls bigint, n bigint, signs array<bigint>, tokens array<bigint>, narrow array<bigint>, bits array<bigint>, wide array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose token sets reach the similarity."""
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb"))
    left = sets.select(F.col("cls").alias("a"), F.col("tokens").alias("ta"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(right, "b").join(left, "a")
            .where(100 * both >= similarity * (F.size("ta") + F.size("tb") - both)).select("a", "b"))


def fits(na, nb, similarity: int):
    """Sizes that allow the similarity."""
    return 100 * F.least(na, nb) >= similarity * F.greatest(na, nb)


def may_link(a, b, na, nb, similarity: int):
    """Narrow bitmaps whose difference allows the similarity."""
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(NARROW)), F.lit(0))
    return (100 + similarity) * apart <= (100 - similarity) * (na + nb)


def near(pairs: DataFrame, maps: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose bitmaps, as wide as the larger set's, allow the similarity."""
    side = lambda x: maps.select(F.col("cls").alias(x), *[F.col(c).alias(c + x) for c in ("n", "bits", "wide")])
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    width = F.when(F.col("na") > F.col("nb"), F.size("bitsa")).otherwise(F.size("bitsb"))
    one, two = (F.when(F.size(f"bits{x}") == width, F.col(f"bits{x}")).otherwise(F.col(f"wide{x}")) for x in "ab")
    apart = F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return both.where((100 + similarity) * apart <= (100 - similarity) * (F.col("na") + F.col("nb"))).select("a", "b")


def grouped(found: DataFrame) -> DataFrame:
    """(sign, cls, n): members of the signatures held by several, one signature for each member set.

    A member set is told by sums of its members' hashes, so members that occur twice
    do not cancel; each hash is summed in two halves, which stay within 64 bits.
    """
    posts = found.select("cls", "n", F.explode("signs").alias("sign"))
    h = F.xxhash64("cls", "n")
    halves = [half for x in (h, F.xxhash64(h, F.lit(1))) for half in (x.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(x, 32))]
    marks = posts.groupBy("sign").agg(F.count("*").alias("c"), *[F.sum(x).alias(f"h{k}") for k, x in enumerate(halves)]).where("c > 1")
    kept = marks.groupBy("c", *[f"h{k}" for k in range(len(halves))]).agg(F.min("sign").alias("sign")).select("sign")
    return posts.join(kept, "sign")


def link_components(found: DataFrame, similarity: int = SIMILARITY, leaders: int = LEADERS) -> DataFrame:
    """(node, component) over the candidates that link with any other."""
    sets, maps = found.select("cls", "n", "tokens"), found.select("cls", "n", "bits", "wide")
    narrow = found.select("cls", "n", "narrow")
    posts = X.cut(grouped(found))
    ends = posts.groupBy("sign").agg(F.min(F.struct("cls", "n")).alias("lo"), F.max(F.struct("cls", "n")).alias("hi"))
    ends = ends.select("sign", F.explode(F.array("lo", "hi")).alias("e")).select("sign", F.col("e.cls").alias("a"), F.col("e.n").alias("na"))
    star = (posts.join(ends, "sign").where((F.col("cls") != F.col("a")) & fits(F.col("n"), F.col("na"), similarity))
            .select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct())
    parts = X.gathered(components(verified(near(star, maps, similarity), sets, similarity)), "parts")
    groups = X.cut(_unfinished(posts, parts))
    while not groups.isEmpty():
        rows = X.cut(_ranked(groups, narrow))
        lead = rows.where(F.col("rank") <= leaders)
        fresh = X.gathered(verified(near(_meetings(lead, rows, similarity), maps, similarity), sets, similarity), "links")
        if not fresh.isEmpty():
            parts = X.gathered(components(fresh.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))), "parts")
        groups = X.cut(_unfinished(rows.where(F.col("rank") > leaders).select("cls", "n", "sign"), parts))
        leaders *= 4
    return parts


def _ranked(groups: DataFrame, narrow: DataFrame) -> DataFrame:
    """Members with their rank in the group, those outside its largest component and of them
    those of most groups in front, with those of their ``FIRST`` least signatures that come before
    the group's, and with their narrow bitmaps."""
    firsts = groups.groupBy("cls", "n").agg(F.slice(F.array_sort(F.collect_set("sign")), 1, FIRST).alias("firsts"), F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy("sign").orderBy("most", F.desc("held"), "cls", "n"))
    before = F.filter("firsts", lambda x: x < F.col("sign"))
    return groups.join(firsts, ["cls", "n"]).join(narrow, ["cls", "n"]).select(
        "sign", "cls", "n", "component", "narrow", before.alias("before"), rank.alias("rank"))


def _meetings(lead: DataFrame, rows: DataFrame, similarity: int) -> DataFrame:
    """(a, b): leaders with the members behind them in other components, at the pair's least signature."""
    x = lead.select("sign", *[F.col(c).alias(c + "_x") for c in ("cls", "n", "component", "before", "rank", "narrow")])
    met = x.join(rows, "sign").where(
        (F.col("component_x") != F.col("component")) & (F.col("rank_x") < F.col("rank"))
        & fits(F.col("n_x"), F.col("n"), similarity) & ~F.arrays_overlap("before_x", "before")
        & may_link(F.col("narrow_x"), F.col("narrow"), F.col("n_x"), F.col("n"), similarity))
    return met.select(F.least("cls_x", "cls").alias("a"), F.greatest("cls_x", "cls").alias("b")).distinct()


def _unfinished(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """(sign, cls, n, component, most): members of the groups that span two components, and
    whether theirs is the group's largest one; a member once, however many of its rows have been met."""
    group = Window.partitionBy("sign")
    named = posts.join(parts.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    split = (named.withColumn("lo", F.min("component").over(group)).withColumn("hi", F.max("component").over(group))
             .where("lo != hi").select("sign", "cls", "n", "component").distinct()
             .withColumn("size", F.count("*").over(Window.partitionBy("sign", "component"))))
    most = F.max(F.struct("size", "component")).over(group)["component"]
    return split.select("sign", "cls", "n", "component", (F.col("component") == most).alias("most"))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, similarity: int = SIMILARITY, rare: int = RARE, often: int = OFTEN,
                    leaders: int = LEADERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls, component_id) of each row.

    ``cls``: least id with the same token set; ``component_id``: least id reachable by
    links of at least ``similarity`` hundredths (50 to 100).  A null or empty text, or
    one of white space, has no tokens, no class (null) and is its own component; a text
    of fewer words than a shingle has one token.  A row without an id is linked with
    nothing: its class and component are null; rows that repeat an id are compared each
    with its own text.  An empty table gives an empty result; extra columns are ignored.
    """
    if not 50 <= similarity <= 100:
        raise ValueError("similarity must lie between 50 and 100 hundredths")
    members = X.cut(classes(docs, words, id_col, text_col))
    path = X.scratch(docs.sparkSession, "jaccard")
    candidates(docs, members, words, similarity, rare, often, id_col, text_col).write.parquet(path)
    parts = link_components(docs.sparkSession.read.parquet(path), similarity, leaders)
    top = parts.select(F.col("node").alias("cls"), "component")
    return members.join(top, "cls", "left").select(
        "doc_id", "n_shingles", "cls", F.coalesce("component", "cls", "doc_id").alias("component_id"))
