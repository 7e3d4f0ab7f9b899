r"""Secrets in texts, and weak credential parts that only count beside their complement.

Base spans (``BASE``) are reported wherever they occur.  The other parts (``WEAK``: a
named login, a mail address, a named pass phrase, a long random run, an address of a
service) are everyday text on their own; one is reported only when the parts that
complete it to a credential stand within ``reach`` code points, its scope:

* an identifier beside a base secret, or beside a weak secret and an endpoint;
* a secret beside a base identifier, or beside a weak identifier and an endpoint;
* an endpoint beside an identifier and a secret.

Parts that overlap do not complete each other; a weak part that overlaps a base span is
that span and is not reported again.

Method: each text gives its matches and the lengths of the gaps between them (native
regular expressions); a running sum per text and kind turns them into code point
intervals.  The interval join cuts positions into bins of ``reach`` code points: a part
lies in the bins of its interval, a weak part probes the bins of its scope.  Matches of
a kind do not overlap and have a least length, so a bin of one text holds a bounded
number of parts whatever the corpus: pairs grow in proportion to the parts, and a text
with very many parts is spread over its bins.  Pairs are folded into flags per weak
part on the map side; none is emitted.  Only parts are shuffled, never texts.

Defined cases.  A null or empty text has no spans and gives zeros and the empty string.
Rows are judged one by one: null or repeated ids and equal texts each get their row.
Texts are read whole.  Only the id and text columns are read, so further columns of any
name do not matter.  Letters match in either case for A-Z only.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from charlens.llm import exchange

#: code points on either side of a weak part in which its complements must lie
REACH = 200


def _any_case(words: str) -> str:
    """The expression with each letter outside classes as a class of both cases (no flag, so only A-Z)."""
    return "".join(f"[{c.upper()}{c}]" if c.islower() else c for c in words)


_SEP = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "([A-Za-z0-9+/_.=-]+)"
ASSIGN = f"({_any_case('password|passwd|secret|token|api_?key')}){_SEP}{_VALUE}"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
_LOGIN, _PHRASE, _PLACE = (_any_case(w) for w in (
    "user|login|account|client_?id|key_?id", "pass|pwd|passphrase|credential|private_?key|signature", "host|endpoint|server|bucket"))
#: a named part: its name decides its role
NAMED = f"({_LOGIN}|{_PHRASE}|{_PLACE}){_SEP}([A-Za-z0-9+/_.=@:-]+)"
#: parts told by their form: a mail address, an address of a service, a long run
LOOSE = (r"""[A-Za-z0-9._+-]{1,64}@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+|[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
         r"""|[A-Za-z0-9+/_-]{32,}""")
#: kinds in the order in which spans with one start are listed; the first three are the base
KINDS = ["assign", "access", "hex", "login", "mail", "phrase", "run", "endpoint"]
#: kinds by role
ROLES = {"id": ["access", "login", "mail"], "secret": ["assign", "hex", "phrase", "run"], "endpoint": ["endpoint"]}
BASE_KINDS = KINDS[:3]


_NONE = "array<struct<grp:int,i:int,gap:int,n:int,kind:string>>"
#: stands in every match of ``ASSIGN`` and ``NAMED``: most texts are told by this one cheap search
_NAME_END = r"""[A-Za-z]["']?\x20*[:=]"""


def _matches(text: Column, group: int, pattern: str, kind, given: Column | bool = True) -> Column:
    """(grp, i, gap, n, kind) of all matches, leftmost and not overlapping; ``kind`` of a match may be null: no part.

    The two whole passes run only where ``given`` holds (else nothing can match) and a first search finds a match.
    """
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), F.when(m.isNotNull(), kind(m)).alias("kind")))
    all_of = F.transform(F.filter(pieces, lambda p: p["n"].isNotNull()), lambda p, i: F.struct(
        F.lit(group).alias("grp"), i.cast("int").alias("i"), p["gap"].alias("gap"), p["n"].alias("n"), p["kind"].alias("kind")))
    return F.when((F.lit(True) if given is True else given) & text.rlike(pattern), all_of).otherwise(F.array().cast(_NONE))


def _named_kind(m: Column) -> Column:
    name = F.regexp_extract(m, NAMED, 1)
    long_enough = F.length(F.regexp_extract(m, NAMED, 2)) >= 4
    role = F.when(name.rlike(f"^({_LOGIN})$"), "login").when(name.rlike(f"^({_PHRASE})$"), "phrase").otherwise("endpoint")
    return F.when(long_enough, role)


def _loose_kind(m: Column) -> Column:
    return F.when(F.contains(m, F.lit("://")), "endpoint").when(F.contains(m, F.lit("@")), "mail").otherwise("run")


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, kind, start, end) of every part of every text, base and weak.

    ``key`` tells the rows of ``docs``; each also gives one row with a null kind, so none is lost.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    strong = lambda m: F.when(F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, "assign")
    found = rows.withColumn("names", text.rlike(_NAME_END)).select(
        "key", "doc_id", "text", _matches(text, 0, ASSIGN, strong, F.col("names")).alias("a"),
        _matches(text, 1, ACCESS, lambda m: F.lit("access")).alias("b"), _matches(text, 2, HEX, lambda m: F.lit("hex")).alias("c"),
        _matches(text, 3, NAMED, _named_kind, F.col("names")).alias("d"))
    # a report needs an identifier: a base one, a named one or a mail address
    needed = F.contains(text, F.lit("@")) | (F.size("b") > 0) | (F.size("d") > 0)
    loose = _matches(text, 4, LOOSE, _loose_kind, needed)
    row = F.array(F.struct(*[F.lit(v).cast("int").alias(n) for n, v in (("grp", -1), ("i", 0), ("gap", 0), ("n", 0))], F.lit(None).cast("string").alias("kind")))
    each = found.select("key", "doc_id", F.explode(F.concat(row, "a", "b", "c", "d", loose)).alias("m")).select("key", "doc_id", "m.*")
    order = Window.partitionBy("key", "grp").orderBy("i")
    end = F.sum(F.col("gap").cast("bigint") + F.col("n")).over(order)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    return placed.where("kind is not null or grp = -1").select("key", "doc_id", "kind", "start", "end")


def _bins(low: Column, high: Column, reach: int) -> Column:
    """The bins that ``[low, high]`` touches."""
    first = F.floor(F.greatest(low, F.lit(0)) / reach)
    return F.explode(F.sequence(first, F.greatest(first, F.floor(high / reach))))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts of ``found`` (as from ``parts``) whose complements lie in their scope."""
    real = found.where("kind is not null")
    beside = real.select(F.col("key"), F.col("kind").alias("near"), F.col("start").alias("s"), F.col("end").alias("e"),
                         _bins(F.col("start"), F.col("end"), reach).alias("bin"))
    weak = real.where(~F.col("kind").isin(BASE_KINDS))
    probes = weak.withColumn("bin", _bins(F.col("start") - reach, F.col("end") + reach, reach))
    gap = F.greatest("start", "s") - F.least("end", "e")
    met = probes.join(beside, ["key", "bin"]).where((gap <= reach) & ~(F.col("kind").eqNullSafe(F.col("near")) & (F.col("start") == F.col("s"))))
    apart, near = gap >= 0, F.col("near")
    has = lambda kinds: F.coalesce(F.max(apart & near.isin(kinds)), F.lit(False))
    flags = met.groupBy("key", "doc_id", "kind", "start", "end").agg(
        F.max(~apart & near.isin(BASE_KINDS)).alias("same"), has(["access"]).alias("base_id"), has(["assign", "hex"]).alias("base_secret"),
        has(ROLES["id"]).alias("any_id"), has(ROLES["secret"]).alias("any_secret"), has(ROLES["endpoint"]).alias("place"))
    role = lambda name: F.col("kind").isin(ROLES[name])
    complete = (F.when(role("id"), F.col("base_secret") | (F.col("any_secret") & F.col("place")))
                .when(role("secret"), F.col("base_id") | (F.col("any_id") & F.col("place")))
                .otherwise(F.col("any_id") & F.col("any_secret")))
    return flags.where(complete & ~F.col("same")).select("key", "doc_id", "kind", "start", "end")


def spans(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (start, rank, end, kind)) of each row: base spans and linked weak parts, in order."""
    found = exchange.cut(parts(docs, id_col, text_col))
    base = found.where(F.col("kind").isNull() | F.col("kind").isin(BASE_KINDS))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "end", "kind"))
    return base.unionByName(linked(found, reach)).groupBy("key", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("key")


def named(span_array: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(span_array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_of(span_array: Column) -> Column:
    return F.filter(span_array, lambda s: s["rank"] <= len(BASE_KINDS))


def count_of(span_array: Column, kind: str) -> Column:
    return F.size(F.filter(span_array, lambda s: s["kind"] == kind)).cast("bigint")
