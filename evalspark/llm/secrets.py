"""Secret scan with multipart credential linking, in DataFrame functions only.

Positions come from cutting a text at the matches of a pattern: the lengths
of the pieces and of the matches add up to the start of each match. Strong
parts (base kinds) are always reported. Weak parts (an identifier, a random
looking key, an endpoint) prove nothing alone: an interval join looks for
complementary parts whose start lies within the scope of theirs and that
share no character with them, and only then are they reported. One string is
never its own complement: an endpoint's identifier and secret don't overlap
either.

The interval join deals parts to bins as wide as the scope. Matches of a kind
don't overlap and have a least length, so a bin holds a bounded number of
parts per role, in one array; a candidate meets three bins of each role it
needs, however many parts a document has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import materialise

SCOPE = 400      # code points between the starts of parts that belong together


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str          # leftmost non-overlapping matches
    hint: str             # a text without a match of this has none of the pattern
    role: str             # ident, secret or endpoint
    least: int = 0        # code points that ``group`` must have, at least
    group: int = 0
    needs: tuple[str, ...] = ()     # roles that must be in scope (none: strong part)
    also: tuple[str, ...] = ()      # further patterns that the match must contain


# [0-9a-f]+ of 24 or more and AKIA[A-Z0-9]+ of 20 or more are written with the
# count in the pattern: a run is taken whole either way, so the matches are the same.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "secret", 6, 2),
    Kind("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}", "ident"),
    Kind("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", "secret"),
    Kind("id", r"""(?i:client_?id|account_?id|user_?name|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}|(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}""",
         r"""(?i:client_?id|account_?id|user_?name|access_?id)["']?\x20*[:=]|(?:ASIA|AIDA|AROA)[A-Z0-9]{12}""", "ident", needs=("secret",)),
    Kind("key", r"[A-Za-z0-9+/]{32,}", r"[A-Za-z0-9+/]{32}", "secret", needs=("ident",), also=("[a-z]", "[A-Z]", "[0-9]")),
    Kind("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", r"https?://[A-Za-z0-9.-]", "endpoint", needs=("ident", "secret")),
)
BASE = ("assign", "access", "hex")
ORDER = {k.name: i for i, k in enumerate(KINDS)}


def _matches(text: Column, kind: Kind) -> Column:
    """array<struct<before, size, ok>>: lengths of the piece before each match and of the match."""
    cut = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    ok = lambda whole, part: F.char_length(part) >= kind.least
    if kind.also:
        ok = lambda whole, part: F.array_min(F.array(*[whole.rlike(p) for p in kind.also]))
    part = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    triple = F.arrays_zip(F.slice(cut, 1, F.size(found)), found, part)  # fields 0, 1, 2
    rows = F.transform(triple, lambda x: F.struct(F.char_length(x["0"]).cast("long").alias("before"),
                                                  F.char_length(x["1"]).cast("long").alias("size"), ok(x["1"], x["2"]).alias("ok")))
    return F.when(text.rlike(kind.hint), rows)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, th, kind, start, end): all candidate parts; th is the text's hash.

    Rows that repeat a doc_id with the same text count once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    per_kind = F.array(*[F.struct(F.lit(k.name).alias("kind"), _matches(F.col("t"), k).alias("m")) for k in KINDS])
    cut = (docs.select(F.col("doc_id").cast("long"), text.alias("t")).select("doc_id", F.xxhash64("t").alias("th"), F.inline(per_kind))
           .filter("m is not null").select("doc_id", "th", "kind", F.posexplode("m").alias("i", "m"))
           .select("doc_id", "th", "kind", "i", "m.*").distinct())
    w = Window.partitionBy("doc_id", "th", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (cut.withColumn("end", F.sum(F.col("before") + F.col("size")).over(w)).filter("ok")
            .select("doc_id", "th", "kind", (F.col("end") - F.col("size")).alias("start"), "end"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Strong parts, and the weak ones whose complements are in scope.

    A complement has the needed role, starts within ``scope`` of the
    candidate's start and doesn't overlap it; where two roles are needed, the
    parts found for them don't overlap each other.
    """
    roles = F.create_map(*[x for k in KINDS for x in (F.lit(k.name), F.lit(k.role))])
    found = found.withColumn("bin", F.floor(F.col("start") / scope))
    bins = (found.groupBy("doc_id", "th", roles[F.col("kind")].alias("role"), "bin")
            .agg(F.collect_set(F.struct("start", "end")).alias("parts"))
            .select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("role"), F.col("bin").alias("at"), "parts"))
    strong = [k.name for k in KINDS if not k.needs]
    needs = F.create_map(*[x for k in KINDS if k.needs for x in (F.lit(k.name), F.array(*map(F.lit, k.needs)))])
    weak = (found.filter(~F.col("kind").isin(strong))
            .withColumn("need", F.explode(needs[F.col("kind")]))
            .withColumn("near", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))))
    fits = F.filter("parts", lambda p: (F.abs(p["start"] - F.col("start")) <= scope)
                    & ((p["end"] <= F.col("start")) | (p["start"] >= F.col("end"))))
    one = ["doc_id", "th", "kind", "start", "end"]
    met = (weak.join(bins, weak.doc_id.eqNullSafe(bins.d) & (weak.th == bins.h) & (weak.need == bins.role) & (weak.near == bins["at"]))
           .select(*one, "need", fits.alias("fits")).filter(F.size("fits") > 0)
           .select(*one, "need", F.array_min(F.col("fits.end")).alias("ends"), F.array_max(F.col("fits.start")).alias("starts")))
    # two sets of intervals have members apart from each other if the first end of one is before the last start of the other
    sides = {r: (F.min(F.when(F.col("need") == r, F.col("ends"))).alias(f"{r}_ends"), F.max(F.when(F.col("need") == r, F.col("starts"))).alias(f"{r}_starts"))
             for r in sorted({n for k in KINDS for n in k.needs})}
    met = met.groupBy(*one).agg(*[c for pair in sides.values() for c in pair])

    def apart(x: str, y: str) -> Column:
        return (F.col(f"{x}_ends") <= F.col(f"{y}_starts")) | (F.col(f"{y}_ends") <= F.col(f"{x}_starts"))

    proven = F.lit(False)
    for k in KINDS:
        if k.needs:
            rule = F.col("kind") == k.name
            for i, r in enumerate(k.needs):
                rule &= F.col(f"{r}_ends").isNotNull()
                for q in k.needs[:i]:
                    rule &= apart(q, r)
            proven |= rule
    return found.filter(F.col("kind").isin(strong)).select(*one).union(met.filter(proven).select(*one))


def _text_form(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found) of every row of ``docs`` (doc_id, text).

    ``found`` has all spans as structs (start, o, kind, end) by start, then
    kind. A null or empty text has none: counts 0, the hash of the empty
    text, spans ''. Rows that repeat a doc_id each get a row, from their own
    text. An empty table gives an empty result; other columns aren't read.
    """
    hits = linked(materialise(parts(docs)), scope)
    order = F.create_map(*[x for n, i in ORDER.items() for x in (F.lit(n), F.lit(i))])
    lists = hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("o"), "kind", "end"))).alias("found"))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "found")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"))
    out = rows.join(lists, rows.doc_id.eqNullSafe(lists.d) & (rows.th == lists.h), "left")
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,o:int,kind:string,end:bigint>>"))
    out = out.select("doc_id", "th", found.alias("found"))
    base = F.filter(F.col("found"), lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(F.col("found"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(_text_form(base), 256).alias("base_sha256"),
                      _text_form(F.col("found")).alias("spans"), "found", "th")


def _merged(spans: DataFrame) -> DataFrame:
    """(d, h, s): each text's spans (start, end) in order, overlapping ones as one."""
    before = Window.partitionBy("doc_id", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    groups = spans.withColumn("fresh", fresh.cast("int")).withColumn("group", F.sum("fresh").over(upto))
    return (groups.groupBy("doc_id", "th", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            .groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
            .select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "s"))


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; overlapping spans are one.

    All columns are kept, whatever they're called; n_chars, if there, is the
    length of the new text. Texts without any hint of a part pass unchanged,
    without a shuffle. A text is cut once, in UTF-32, where a span's
    place follows from its code points: the time grows with the text, not with
    text times spans.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hinted = F.greatest(*[text.rlike(k.hint) for k in KINDS])
    rest, hit = docs.filter(~hinted), docs.filter(hinted)
    spans = _merged(linked(materialise(parts(hit)), scope).select("doc_id", "th", "start", "end").distinct())
    packed = hit.select(F.struct("*").alias("row"), text.alias("t"), F.xxhash64(text).alias("th"))
    both = packed.join(spans, F.col("row.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    from_ = F.concat(F.array(F.lit(0).cast("long")), F.col("s.end"))
    to = F.concat(F.col("s.start"), F.array(F.octet_length("wide") / 4))
    # a leading letter keeps the decoder from taking a piece's first character for a byte order mark
    piece = lambda a, b: F.substring(F.decode(F.concat(F.lit(bytearray(b"\0\0\0A")), F.call_function(
        "substring", F.col("wide"), (4 * a + 1).cast("int"), (4 * (b - a)).cast("int"))), "UTF-32"), 2, 2**31 - 1)
    new = F.when(F.col("s").isNull(), F.col("row.text")).otherwise(F.array_join(F.zip_with(from_, to, piece), mask))
    done = both.withColumn("wide", F.encode("t", "UTF-32")).select("row", new.alias("new"))
    swap = {"text": F.col("new"), "n_chars": F.char_length("new")}
    columns = [(swap[c].cast(docs.schema[c].dataType) if c in swap else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rest.unionByName(done.select(*columns))
