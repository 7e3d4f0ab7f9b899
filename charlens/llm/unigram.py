"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a SentencePiece model file.  A space is
written as the whitespace marker (U+2581) and a text starts with one.  The best path
maximises the sum of scores; of equal paths the one whose last piece starts first wins.
A character without a piece of its own costs the least score less 10 and is written as
byte pieces.  Decoding joins pieces and bytes, turns markers into spaces and drops the
first.

Where no piece holds a marker after another character, the best path of a text is that
of its parts (marker run plus word), so each distinct part of a block is encoded once.
All parts of a block step through trie and lattice together, as array operations.

Defined cases: null and empty texts have no pieces and decode to the empty text; U+2581
in a text is the same as a space; bytes that do not form UTF-8 decode to U+FFFD.  Rows
are independent, so repeated rows and missing ids need no rule; an empty table gives an
empty result.  Extra columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlens.llm import textops as T

#: model file of a public tokenizer
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: the marker as one byte; 0xFF does not occur in UTF-8
_MARK = 0xFF
UNKNOWN_COST = 10.0
BLOCK_BYTES = 6 << 20


class DoubleArray:
    """Trie with transitions ``base[state] + byte``, valid where ``check`` names the state."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in words.items():
            node = 0
            for c in word:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = v
        size = len(children) + 512
        base, check, at = [0] * size, [-1] * size, [0] * len(children)
        hint = [1] * 17  # by number of children: where the last one fitted
        queue = [0]
        ids = {0: -1}
        for node in queue:
            kids = sorted(children[node])
            if not kids:
                continue
            few = min(len(kids), 16)
            slot = hint[few]
            while True:
                b = slot - kids[0]
                if b + 512 >= len(check):
                    base += [0] * len(check)
                    check += [-1] * len(check)
                if b >= 0 and check[slot] < 0 and all(check[b + c] < 0 for c in kids):
                    break
                slot += 1
            hint[few] = slot + (few == 1)
            state = at[node]
            base[state] = b
            for c in kids:
                child = children[node][c]
                check[b + c] = state
                at[child] = b + c
                ids[b + c] = value[child]
                queue.append(child)
        last = max(at) + 257
        pad = max(0, last + 257 - len(base))
        self.base = np.array(base + [0] * pad, np.int32)[:last + 257]
        self.check = np.array(check + [-1] * pad, np.int32)[:last + 257]
        self.value = np.full(len(self.base), -1, np.int32)
        self.value[list(ids)] = list(ids.values())


class Pieces:
    """The pieces of a model file, as arrays that are broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        normal = {p.replace(MARK, "\x00").encode().replace(b"\x00", b"\xff"): i
                  for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        self.trie = DoubleArray(normal)
        self.score = np.array(scores, np.float64)
        self.unknown = min((scores[i] for i in normal.values()), default=0.0) - UNKNOWN_COST
        self.longest = max(map(len, normal), default=1)
        self.by_byte = np.full(256, next((i for i, k in enumerate(kinds) if k == "unknown"), 0), np.int32)
        out = []
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.by_byte[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(p.replace(MARK, " ").encode() if k == "normal" else b"")
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.length = np.array([len(b) for b in out], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(pieces, kinds) if k == "normal")


def load(path: str = MODEL) -> Pieces:
    """Pieces, scores and kinds of a SentencePiece model file (read by the driver)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ["unknown" if m.is_unknown(i) else "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal"
             for i in range(m.get_piece_size())]
    return Pieces([m.id_to_piece(i) for i in range(len(kinds))], [m.get_score(i) for i in range(len(kinds))], kinds)


def marked(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with markers (one byte each) for spaces and one in front of each that is not empty."""
    raw = data.tobytes()
    if MARK.encode() in raw:
        texts = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1], off[1:])]
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
    full = np.diff(off) > 0
    out = np.insert(np.where(data == 32, np.uint8(_MARK), data), off[:-1][full], _MARK)
    return out, off + np.concatenate(([0], np.cumsum(full)))


def parts_of(data: np.ndarray, off: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, text index) of each part: a marker run and what follows it."""
    head = np.zeros(len(data) + 1, bool)
    head[off[:-1][np.diff(off) > 0]] = True
    head = head[:-1]
    if split and len(data):
        mark = data == _MARK
        head[1:] |= mark[1:] & ~mark[:-1]
    first = np.flatnonzero(head)
    return first, np.searchsorted(off, first, "right") - 1


def viterbi(p: Pieces, data: np.ndarray, first: np.ndarray, size: np.ndarray):
    """Best paths of parts sorted by falling size.

    Returns (part, start, length, id) of the edges in order and each part's score; id
    -1 is a character without a piece.
    """
    base, check, value = p.trie.base, p.trie.check, p.trie.value
    at = np.concatenate(([0], np.cumsum(size + 1)))
    best = np.full(at[-1], -np.inf)
    best[at[:-1]] = 0.0
    back = np.zeros(at[-1], np.int32)
    piece = np.full(at[-1], -1, np.int32)
    width = np.ones(256, np.int64)
    width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:0xF8] = 2, 3, 4
    falling = -size
    for pos in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(falling, -pos, "left"))
        here = np.flatnonzero(best[at[:live] + pos] > -np.inf)
        if not len(here):
            continue
        score = best[at[here] + pos]
        char = np.minimum(width[data[first[here] + pos]], size[here] - pos)
        alone = np.zeros(len(here), bool)
        who, state, room = np.arange(len(here)), np.zeros(len(here), np.int64), size[here] - pos
        place = first[here] + pos
        for step in range(1, p.longest + 1):
            nxt = base[state] + data[place[who] + step - 1].astype(np.int64)
            ok = check[nxt] == state
            who, state = who[ok], nxt[ok]
            if not len(who):
                break
            v = value[state]
            got = v >= 0
            if got.any():
                g, ids = who[got], v[got]
                new = score[g] + p.score[ids]
                end = at[here[g]] + pos + step
                up = new > best[end]
                end = end[up]
                best[end], back[end], piece[end] = new[up], pos, ids[up]
                alone[g[char[g] == step]] = True
            more = room[who] > step
            who, state = who[more], state[more]
            if not len(who):
                break
        lone = np.flatnonzero(~alone)
        if len(lone):
            new = score[lone] + p.unknown
            end = at[here[lone]] + pos + char[lone]
            up = new > best[end]
            end = end[up]
            best[end], back[end], piece[end] = new[up], pos, -1
    edges = []
    part, end = np.arange(len(size)), size.astype(np.int64)
    while len(part):
        slot = at[part] + end
        start = back[slot].astype(np.int64)
        edges.append((part, start, end - start, piece[slot]))
        go = start > 0
        part, end = part[go], start[go]
    if not edges:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0)
    part, start, length, ids = (np.concatenate([e[k] for e in edges]) for k in range(4))
    order = np.lexsort((start, part))
    return part[order], start[order], length[order], ids[order], best[at[:-1] + size]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i]+1, ... (count[i] of them), for all i in order."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)


def encode(p: Pieces, data: np.ndarray, off: np.ndarray):
    """(ids, first id of each text, score of each text) of a block of texts."""
    docs = len(off) - 1
    data, off = marked(data, off)
    first, doc = parts_of(data, off, p.splits)
    if not len(first):
        return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64), np.zeros(docs)
    size = np.diff(first, append=len(data))
    pos = (np.arange(len(data)) - np.repeat(first, size)) & 0xFFFF
    h = T.mix(np.add.reduceat(T._BYTE[data] * T._POS[pos], first) + size.astype(np.uint64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(-size[one], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    which = rank[which]
    pf, ps = first[one][order], size[one][order]
    part, start, length, ids, score = viterbi(p, data, pf, ps)
    # one id per piece; a character without one gives its bytes (three for a marker)
    lost = ids < 0
    source = pf[part] + start
    count = np.where(lost, np.where(data[source] == _MARK, 3, length), 1)
    tokens = np.repeat(ids, count)
    if lost.any():
        k = np.flatnonzero(np.repeat(lost, count))
        nth = ragged(np.zeros(len(count), np.int64), count)[k]
        byte = data[np.minimum(np.repeat(source, count)[k] + nth, len(data) - 1)]
        mark = np.repeat(data[source] == _MARK, count)[k]
        byte = np.where(mark, np.frombuffer(MARK.encode(), np.uint8)[np.minimum(nth, 2)], byte)
        tokens[k] = p.by_byte[byte]
    per_part = np.bincount(part, weights=count, minlength=len(ps)).astype(np.int64)
    part_first = np.cumsum(per_part) - per_part
    n = per_part[which]
    out = tokens[ragged(part_first[which], n)].astype(np.int32)
    per_doc = np.bincount(doc, weights=n, minlength=docs).astype(np.int64)
    return out, np.concatenate(([0], np.cumsum(per_doc))), np.bincount(doc, weights=score[which], minlength=docs)


def decode(p: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of each list of ids; the first space is dropped."""
    n = p.length[ids]
    raw = p.bytes[ragged(p.first[ids], n)].tobytes()
    ends = np.concatenate(([0], np.cumsum(n)))[bounds]
    if p.is_byte[ids].any() and MARK.encode() in raw:
        out = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(ends[:-1], ends[1:])]
    else:
        out = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return [t[1:] if t[:1] == b" " else t for t in out]


def encoded(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = (), check: bool = True,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *keep, n_tokens, n_byte_tokens, score, ids, round_trip) of each row.

    ``round_trip``: decoding the ids gives the text (markers as spaces); null if
    ``check`` is off.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    keep = [c for c in keep if c not in ("doc_id", "n_tokens", "n_byte_tokens", "score", "ids", "round_trip", "text")]

    def run(batches):
        p = shared.value
        for batch in batches:
            data, off = T.text_buffer(batch.column("text"))
            got = []
            for i, j in T.sub_blocks(off, BLOCK_BYTES):
                part = data[off[i]:off[j]]
                ids, bounds, score = encode(p, part, off[i:j + 1] - off[i])
                same = None
                if check:
                    raw = part.tobytes()
                    o = off[i:j + 1] - off[i]
                    want = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(o[:-1], o[1:])]
                    same = [a == b for a, b in zip(decode(p, ids, bounds), want)]
                spelt = np.concatenate(([0], np.cumsum(p.is_byte[ids])))[bounds]
                got.append((ids, np.diff(bounds), score, np.diff(spelt), same or [None] * (j - i)))
            cat = lambda k, kind: np.concatenate([g[k] for g in got]).astype(kind) if got else np.zeros(0, kind)
            n = cat(1, np.int64)
            out = {c: batch.column(c) for c in ("doc_id", *keep)}
            out["n_tokens"], out["n_byte_tokens"], out["score"] = pa.array(n), pa.array(cat(3, np.int64)), pa.array(cat(2, np.float64))
            out["ids"] = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(cat(0, np.int32)))
            out["round_trip"] = pa.array([x for g in got for x in g[4]], pa.bool_())
            yield pa.RecordBatch.from_pydict(out)

    kinds = dict(docs.dtypes)
    schema = (f"doc_id {kinds[id_col]}" + "".join(f", `{c}` {kinds[c]}" for c in keep)
              + ", n_tokens bigint, n_byte_tokens bigint, score double, ids array<int>, round_trip boolean")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep).mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each list of ids; null for a null list."""
    shared = rows.sparkSession.sparkContext.broadcast(load(model))

    def run(batches):
        p = shared.value
        for batch in batches:
            lists = batch.column("ids")
            n = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode(p, ids, np.concatenate(([0], np.cumsum(n))).astype(np.int64))
            texts = [t.decode("utf-8", "replace") if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kinds = dict(rows.dtypes)
    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(
        run, f"doc_id {kinds[id_col]}, text string")
