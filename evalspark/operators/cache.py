"""Keyed response cache and cached batch scoring.

The cache is a table ``key, model, prompt, params, response, created_at,
batch_id``. :class:`LayeredCache` stores it as a base and later deltas, all
bucketed by key: a write-back writes its new rows only, a look-up shuffles the
requests once and joins every layer where it lies, the newest version of a key
wins when it's read, and layers are merged by a separate compaction. Layers are
never changed; a manifest row names a layer once its files are complete, so
readers see a consistent version and a failed write leaves no trace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark import schemas

CACHE_VERSION = "v1"
_SEP = "\x1f"


def canonical_params(df: DataFrame, params_col: str) -> Column:
    """Params (a struct column) as canonical text: ``name=value`` per field in name order, ``;``-joined.

    Arrays render as ``[a,b]``, nulls as ``null``; equal values always give
    equal text, whatever the field order of the struct.
    """
    st = df.schema[params_col].dataType
    parts = []
    for f in sorted(st.fields, key=lambda f: f.name):
        v = F.col(params_col).getField(f.name)
        if isinstance(f.dataType, T.ArrayType):
            txt = F.concat(F.lit("["), F.array_join(v, ","), F.lit("]"))
        else:
            txt = v.cast("string")
        parts.append(F.concat(F.lit(f.name + "="), F.coalesce(txt, F.lit("null"))))
    return F.concat_ws(";", *parts)


def cache_key(model, prompt, params_text, version: str = CACHE_VERSION) -> Column:
    """sha256 over version, model, canonical params and prompt (unit-separator joined).

    Bumping ``version`` changes every key, which invalidates old rows without
    deleting them.
    """
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.sha2(F.concat_ws(_SEP, F.lit(version), c(model), c(params_text), c(prompt)), 256)


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached ``response`` (null on a miss) and a ``hit`` flag.

    One row per request row; of several versions of a key the newest counts.
    """
    c = compact(cache).select("key", F.col("response").alias("_resp"), F.lit(True).alias("_hit"))
    return requests.join(c, "key", "left").select(
        requests["*"], F.col("_resp").alias("response"), F.coalesce(F.col("_hit"), F.lit(False)).alias("hit"))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The requests to compute: keys absent from the cache, one row per distinct key."""
    return requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """C4: insert-or-replace; per key the row with the latest ``(created_at, batch_id)`` wins.

    A partial ``max_by`` aggregate, so hot keys merge map-side.
    """
    cols = [f.name for f in schemas.CACHE.fields]
    return compact(cache.select(*cols).unionByName(new.select(*cols)))


def compact(cache: DataFrame) -> DataFrame:
    """One row per key: the latest ``(created_at, batch_id)`` version."""
    cols = [f.name for f in schemas.CACHE.fields]
    order = F.struct(F.col("created_at"), F.col("batch_id"))
    latest = cache.groupBy("key").agg(F.max_by(F.struct(*[c for c in cols if c != "key"]), order).alias("_r"))
    return latest.select("key", "_r.*")


def corrupt_entries(cache: DataFrame) -> DataFrame:
    """Rows whose stored response is not valid JSON."""
    return cache.filter(F.col("response").isNotNull() & F.try_parse_json("response").isNull())


def cache_stats(cache: DataFrame) -> DataFrame:
    """Size per model and the number of corrupt entries."""
    bad = F.col("response").isNotNull() & F.try_parse_json("response").isNull()
    return cache.groupBy("model").agg(F.count("*").alias("size"), F.count_if(bad).alias("corrupt"))


def write_snapshot(cache: DataFrame, path: str) -> None:
    """Persist a cache version to a new snapshot directory, partitioned by model."""
    cache.write.mode("errorifexists").partitionBy("model").parquet(path)


def read_snapshot(spark, path: str, models: Sequence[str] | None = None) -> DataFrame:
    """Read a cache snapshot; a model list becomes a partition filter (pruned at planning)."""
    df = spark.read.schema(schemas.CACHE).parquet(path)
    return df.filter(F.col("model").isin(list(models))) if models else df


class LayeredCache:
    """C2-C5 over a folder: ``layers/<n>`` bucketed by key, ``manifest`` rows (n, kind).

    The layers in use are the last base and the deltas after it. A layer has
    one row per key. Buckets need a name in the session's catalog; it's an
    external table, so the files stay when it's dropped.
    """

    MANIFEST = "n bigint, kind string, buckets int"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        seen = self._manifest()
        self.buckets = seen[0]["buckets"] if seen else buckets

    def _manifest(self) -> list[Row]:
        try:
            return self.spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest").orderBy("n").collect()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return []
            raise

    def _name(self, n: int) -> str:
        return f"cache_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{n}"

    def _table(self, n: int) -> DataFrame:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.CACHE.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(n)} ({columns}) USING parquet "
                       f"CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/layers/{n}'")
        return self.spark.table(self._name(n))

    def layers(self) -> list[DataFrame]:
        """The last base, if there's one, and the deltas after it, oldest first."""
        rows = self._manifest()
        base = max((r["n"] for r in rows if r["kind"] == "base"), default=-1)
        return [self._table(r["n"]) for r in rows if r["n"] >= base]

    def _write(self, rows: DataFrame, kind: str) -> None:
        n = max((r["n"] for r in self._manifest()), default=-1) + 1
        (compact(rows).repartition(self.buckets, "key").write.option("path", f"{self.path}/layers/{n}").bucketBy(self.buckets, "key")
         .saveAsTable(self._name(n)))
        entry = self.spark.createDataFrame([(n, kind, self.buckets)], self.MANIFEST)
        entry.coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def write_delta(self, new: DataFrame) -> None:
        """C4: add rows; those of known keys replace them if they're newer. What is stored isn't read."""
        self._write(new, "delta")

    def _joined(self, requests: DataFrame) -> DataFrame:
        """Requests with ``_found``: the newest (created_at, batch_id, response) over the layers."""
        out = requests.repartition(self.buckets, "key")
        names = []
        for i, layer in enumerate(self.layers()):
            hit = layer.select(F.col("key").alias(f"_k{i}"), F.struct("created_at", "batch_id", "response").alias(f"_v{i}"))
            out = out.join(hit, F.col("key") == F.col(f"_k{i}"), "left").drop(f"_k{i}")
            names.append(f"_v{i}")
        kind = "struct<created_at:double,batch_id:bigint,response:string>"
        found = F.greatest(F.lit(None).cast(kind), F.lit(None).cast(kind), *names)
        return out.withColumn("_found", found).drop(*names)

    def lookup(self, requests: DataFrame) -> DataFrame:
        """Every request row once, with ``response`` (null on a miss) and ``hit``."""
        return self._joined(requests).select(*requests.columns, F.col("_found.response").alias("response"), F.col("_found").isNotNull().alias("hit"))

    def misses(self, requests: DataFrame) -> DataFrame:
        """One row per distinct key that no layer has."""
        return self._joined(requests).filter(F.col("_found").isNull()).drop("_found").dropDuplicates(["key"])

    def read(self) -> DataFrame:
        """One row per key: the newest version."""
        layers = self.layers()
        if not layers:
            return self.spark.createDataFrame([], schemas.CACHE)
        out = layers[0]
        for layer in layers[1:]:
            out = out.unionByName(layer)
        return compact(out) if len(layers) > 1 else out

    def compact(self) -> None:
        """Merge all layers into a new base; the old layers' files stay for readers that hold them."""
        if len(self.layers()) > 1:
            self._write(self.read(), "base")

    def stats(self) -> DataFrame:
        """Size per model and the number of corrupt entries."""
        return cache_stats(self.read())


ScoreFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
COMPUTED = "key string, model string, prompt string, params string, response string, error string, attempts int"


def isolated(fn: ScoreFn, batch: pd.DataFrame, retries: int = 1, attempts: int = 1) -> Iterator[pd.DataFrame]:
    """``batch`` with ``response``, ``error`` and ``attempts``: failures become rows.

    A call that raises is repeated with either half of its requests, until
    what fails stands alone; that request is tried ``retries`` more times, then
    carries the error. A request that the model leaves out has an error, too.
    """
    answers = list(_answers(fn, batch, retries, attempts))
    whole = batch.iloc[[i for part in answers for i in part[0]]]
    columns = {name: [x for part in answers for x in part[at]] for at, name in ((1, "response"), (2, "error"), (3, "attempts"))}
    yield whole.assign(**{name: pd.Series(values, whole.index, "int64" if name == "attempts" else object) for name, values in columns.items()})


def _answers(fn: ScoreFn, batch: pd.DataFrame, retries: int, attempts: int) -> Iterator[tuple[range, list, list, list]]:
    """(places in the batch, responses, errors, attempts); lists, as frames cost more than a request when many fail."""
    waiting = [(0, len(batch), attempts)]
    while waiting:
        low, high, tried = waiting.pop()
        part = batch.iloc[low:high]
        try:
            said: dict = {}
            for frame in fn(iter([part])):
                for key, response in zip(frame["key"], frame["response"]):
                    said.setdefault(key, response)
        except Exception as e:  # whatever the model raises belongs to its request
            if high - low > 1:
                half = low + (high - low) // 2
                waiting += [(half, high, tried), (low, half, tried)]
            elif tried <= retries:
                waiting.append((low, high, tried + 1))
            else:
                yield range(low, high), [None], [f"{type(e).__name__}: {e}"], [tried]
            continue
        responses = [None if pd.isna(r) else r for r in map(said.get, part["key"])]
        yield range(low, high), responses, [None if r is not None else "the model gave no response" for r in responses], [tried] * (high - low)


def score_with_cache(requests: DataFrame, cache: DataFrame | LayeredCache, fn: ScoreFn, batch_id: int,
                     created_at: Column | None = None, retries: int = 1) -> tuple[DataFrame, DataFrame]:
    """Look up, compute misses with ``fn``, write back, join.

    ``requests`` carry ``key, model, prompt, params``; ``fn`` maps batches of
    ``(key, model, prompt, params)`` to ``(key, response)`` and runs once per
    distinct missing key, in parallel over partitions (``mapInPandas``); the
    request's columns travel with it, so the misses are planned once. A call
    that fails costs its request only (see :func:`isolated`).

    Returns ``(results, new_cache)``: every request with its ``response``,
    ``source`` (cache / computed / failed), ``error`` and ``attempts`` (null
    from the cache), and the cache with what was computed. Failed requests
    aren't cached, so the next run tries them again. A :class:`LayeredCache`
    is written here, as one delta.
    """
    layered = isinstance(cache, LayeredCache)
    todo = (cache.misses(requests) if layered else misses(requests, cache)).select("key", "model", "prompt", "params")
    # Model calls are the expensive part: materialise their output once (a
    # reliable checkpoint in the cluster's checkpoint folder), so the write-back
    # and the result join never call the model twice, and a lost executor does
    # not send the requests again.
    def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from isolated(fn, batch, retries)

    computed = todo.mapInPandas(carried, COMPUTED).checkpoint(eager=True)
    ts = created_at if created_at is not None else F.unix_micros(F.current_timestamp()) / F.lit(1e6)
    new_rows = computed.filter("error is null").select(
        "key", "model", "prompt", "params", "response", ts.cast("double").alias("created_at"),
        F.lit(batch_id).cast("bigint").alias("batch_id"))
    hits = cache.lookup(requests) if layered else lookup(requests, cache)
    fresh = computed.select("key", F.col("response").alias("_new"), "error", "attempts")
    results = hits.join(fresh, "key", "left").select(
        *[F.col(c) for c in requests.columns],
        F.coalesce(F.col("response"), F.col("_new")).alias("response"),
        F.when(F.col("hit"), "cache").when(F.col("error").isNull(), "computed").otherwise("failed").alias("source"),
        "error", "attempts",
    )
    if not layered:
        return results, upsert(cache, new_rows)
    results = results.checkpoint()      # before the delta turns what was computed into hits
    cache.write_delta(new_rows)
    return results, cache.read()
