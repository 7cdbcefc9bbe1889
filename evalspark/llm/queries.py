"""Registered queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import collocations, common, edit_embedding, embeddings, katz, langid, mixing, quality, secrets, sentencepiece_codec, simhash, substring_dedup, toxicity, whitening

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, other) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a)
SELECT r.node AS vec_id, coalesce(max(d.n), 0)::BIGINT AS n_links, min(r.other) AS component_id,
  r.node = min(r.other) AS kept
FROM reach r LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) d ON d.a = r.node
GROUP BY r.node
"""


@query("op1_embedding_near_dedup", OP1_SQL)
def op1(spark, sf_dir):
    """Vectors of a label linked at cosine 0.98 or more: links, component, kept."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def _op2_sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    cut, weak = [], []
    for o, k in enumerate(secrets.KINDS):
        ok = f"length(g) >= {k.least}" if not k.also else " AND ".join(f"regexp_matches(w, {quoted(p)})" for p in k.also)
        cut.append(f"""SELECT doc_id, '{k.name}' AS kind, {o} AS o, '{k.role}' AS role, i, length(b) AS before, length(w) AS size, {ok} AS ok
  FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS w, unnest(g) AS g, unnest(s[1:len(m)]) AS b
    FROM (SELECT doc_id, regexp_extract_all(t, {quoted(k.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(k.pattern)}, {k.group}) AS g,
      string_split_regex(t, {quoted(k.pattern)}) AS s FROM d))""")
        names = [f"q{i}" for i in range(len(k.needs))]
        inside = [f"{q}.doc_id = p.doc_id AND {q}.role = '{r}' AND abs({q}.s - p.s) <= {secrets.SCOPE} AND ({q}.e <= p.s OR {q}.s >= p.e)"
                  for q, r in zip(names, k.needs)]
        inside += [f"({a}.e <= {b}.s OR {b}.e <= {a}.s)" for i, b in enumerate(names) for a in names[:i]]
        near = f"EXISTS (SELECT 1 FROM {', '.join(f'p {q}' for q in names)} WHERE {' AND '.join(inside)})"
        if k.needs:
            weak.append(f"(p.kind = '{k.name}' AND {near})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(cut)}),
p AS (SELECT doc_id, kind, o, role, e - size AS s, e FROM (
  SELECT *, sum(before + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM c) WHERE ok),
f AS (SELECT doc_id, kind, o, s, e, o < {len(secrets.BASE)} AS base FROM p
  WHERE o < {len(secrets.BASE)} OR {" OR ".join(weak)}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) FILTER (base) AS b,
  string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


@query("op2_secret_scan", _op2_sql())
def op2(spark, sf_dir):
    """Secrets of every document: base spans, and weak parts linked to their complements."""
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found", "th")


@query("op3_language_id")
def op3(spark, sf_dir):
    """Language of every document; profiles from documents whose crc32 remainder isn't 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = langid.fit(docs, ~held_out)
    return langid.predict(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN low USING (s) WHERE d < doc_id),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(js, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists ON w.doc_id = lists.doc_id
"""


@query("op4_substring_dedup", OP4_SQL)
def op4(spark, sf_dir):
    """Words of every document that no 13-word window of a smaller doc_id covers."""
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("spans")


@query("op5_toxicity")
def op5(spark, sf_dir):
    """Toxicity of every document; the model learns from labels whose crc32 remainder isn't 2."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.train_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(common.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


@query("op6_source_mixing")
def op6(spark, sf_dir):
    """Every document's raked weight, probability and draw, with flattened marginals as targets."""
    drawn = mixing.draw(table(spark, sf_dir, "documents"))
    return drawn.select("row.doc_id", "row.source", "row.lang", "topic", "n_tokens", "weight", "prob", "sampled")


@query("op7_katz_lm")
def op7(spark, sf_dir):
    """Katz bigram score and unigram base score of every document."""
    return katz.score(table(spark, sf_dir, "documents"))


@query("op8_edit_fingerprints")
def op8(spark, sf_dir):
    """Edit-embedding fingerprints of every document and of its edited text."""
    return edit_embedding.with_next(table(spark, sf_dir, "documents"))


@query("op9_sentencepiece")
def op9(spark, sf_dir):
    """Piece ids of every document, with round trip and parity."""
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model(spark, MODEL_PATH))


@query("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    """SimHash of 3-word shingles, linked at 3 or fewer differing bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}') AS t FROM documents),
p AS (SELECT doc_id, lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda z: z <> '') AS ws
  FROM (SELECT doc_id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM d)),
sizes AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
f AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS a, min(doc_id) AS first_doc_id
  FROM (SELECT doc_id, lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, range(1, 6) AS z(m)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
  SELECT lang, a, array_to_string(ws[i:i + z.k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM c, range(2, 5) AS z(k) WHERE k < m) z) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT k.lang, k.phrase, k.m, k.a, k.first_doc_id, k.k, l.a AS l, r.a AS r, s.n,
    (1000 * k.a::HUGEINT * s.n::HUGEINT) // (l.a::HUGEINT * r.a::HUGEINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept) k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ') JOIN sizes s ON s.lang = k.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, m::INT AS words, a, l, r, n::BIGINT AS n, score::BIGINT AS score, first_doc_id
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000
"""


@query("op11_phrase_mining", OP11_SQL)
def op11(spark, sf_dir):
    """Each language's 2,000 best phrases of two to five words with 100 occurrences or more."""
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    """Whitened coordinates of every usable vector for the four leading components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    top = f"length(bin(v)) - {quality.FINE.bit_length()}"
    bucket = f"CASE WHEN v < {2 * quality.FINE} THEN v ELSE ({top}) * {quality.FINE} + (v >> ({top})) END"
    power = f"b // {quality.FINE} - 1"
    low = f"CASE WHEN b < {2 * quality.FINE} THEN b ELSE (b - {quality.FINE} * ({power})) << ({power}) END"
    high = f"CASE WHEN b < {2 * quality.FINE} THEN b ELSE ((b - {quality.FINE} * ({power}) + 1) << ({power})) - 1 END"
    values = " UNION ALL ".join(
        f"SELECT r, lang, source, base_failed, '{m.name}' AS measure, {m.least} AS least, {m.low} AS two_sided, "
        f"({m.scale} * {m.part}) // greatest({m.whole}, 1) AS v FROM counted" for m in quality.MEASURES)

    def quartiles(keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return f"""SELECT {by}, max(docs) AS docs, min(CASE WHEN seen >= (25 * docs + 99) // 100 THEN {low} END) AS q1,
  min(CASE WHEN seen >= (75 * docs + 99) // 100 THEN {high} END) AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by}) AS docs, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS seen
    FROM (SELECT {by}, b, count(*) AS n FROM cells GROUP BY ALL)) GROUP BY ALL"""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + {quality.WINDOW - 1}], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS j FROM twice) GROUP BY r),
counted AS (SELECT w.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^{quality.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  len(ws) < {quality.LEAST_WORDS} OR 100 * coalesce(rep.n, 0) > {quality.MOST_REPEATED} * len(ws) AS base_failed
  FROM w LEFT JOIN rep ON rep.r = w.r),
measured AS ({values}),
cells AS (SELECT lang, source, measure, least, {bucket} AS b FROM measured WHERE NOT base_failed),
own AS ({quartiles('lang, source')}),
langs AS ({quartiles('lang')}),
every AS ({quartiles('')}),
chosen AS (SELECT own.lang, own.source, own.measure,
  CASE WHEN own.docs >= {quality.LEAST_DOCS} THEN own.q1 WHEN langs.docs >= {quality.LEAST_DOCS} THEN langs.q1 ELSE every.q1 END AS q1,
  CASE WHEN own.docs >= {quality.LEAST_DOCS} THEN own.q3 WHEN langs.docs >= {quality.LEAST_DOCS} THEN langs.q3 ELSE every.q3 END AS q3
  FROM own JOIN langs ON own.lang IS NOT DISTINCT FROM langs.lang AND own.measure = langs.measure JOIN every ON every.measure = own.measure),
bad AS (SELECT r, count(*) AS n FROM measured m JOIN chosen c
  ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure
  WHERE v > q3 + {quality.REACH} * greatest(q3 - q1, least) OR (two_sided AND v < q1 - {quality.REACH} * greatest(q3 - q1, least)) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  NOT base_failed AND bad.r IS NULL AS kept
FROM counted LEFT JOIN bad ON bad.r = counted.r
"""


@query("op13_quality_rules", _op13_sql())
def op13(spark, sf_dir):
    """Quality measures of every document, the base rules, and the verdict by adaptive fences."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("failed")
