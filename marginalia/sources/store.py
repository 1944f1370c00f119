"""The stored corpus and its index: ordinary Parquet tables, one folder per load.

    posts/load=K/slice=S/          documents with the ends of their fragments, sliced by doc_id
    postings/load=K/field=F/bucket=B/   sorted by token, then doc_id
    doc_freq/load=K/               document counts of this load's documents
    field_sums/load=K/             document count and field lengths of this load
    days/load=K/                   posts per day of this load
    urls/load=K/bucket=B/          distinct urls, and url_filters/ their bitmaps (sources/urls.py)
    loads/load=K/                  the load report, written last: the commit

A load counts only once its report exists, so a load that died half-way is invisible
and its folders are overwritten by the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators import index as ix
from marginalia.operators.joins import Stage
from marginalia.operators.match import bucket
from marginalia.operators.snippet import ENDS, with_ends
from marginalia.operators.tokens import token_packs
from marginalia.schema import POSTS
from marginalia.sources import urls

SLICE_DOCS = 65536  # documents per slice
FILE_DOCS = 8192  # documents per file of posts at most: texts are cut where they are read, so files are what tasks share
TOKENS_PER_BUCKET = 10_000_000

_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "array<bigint>": T.ArrayType(T.LongType(), False),
    "array<int>": T.ArrayType(T.IntegerType(), False),
}


def _columns(**types: str) -> list[T.StructField]:
    return [T.StructField(name, _TYPES[t]) for name, t in types.items()]


_SCHEMAS = {
    "posts": T.StructType(POSTS.fields + _columns(**dict.fromkeys(ENDS.values(), "array<int>"), load="int", slice="bigint")),
    "postings": T.StructType(
        _columns(
            token="string",
            doc_id="bigint",
            date="timestamp",
            dl="bigint",
            tf="bigint",
            positions="array<bigint>",
            load="int",
            field="string",
            bucket="int",
        )
    ),
    "doc_freq": T.StructType(_columns(field="string", token="string", df="bigint", load="int")),
    "field_sums": T.StructType(
        _columns(n_docs="bigint", title="bigint", content="bigint", tags="bigint", category="bigint", load="int")
    ),
    "days": T.StructType(_columns(day="bigint", n="bigint", load="int")),
    "urls": T.StructType(_columns(url="string", load="int", bucket="int")),
    "url_filters": T.StructType(_columns(cell="int", bits="binary", load="int", bucket="int")),
    "loads": T.StructType(
        _columns(
            at="timestamp",
            added="bigint",
            max_doc_id="bigint",
            buckets="int",
            replaces="boolean",
            url_buckets="int",
            url_cells="int",
            source="string",
            load="int",
        )
    ),
}


@dataclass(frozen=True)
class State:
    """What the reports say: one row per load, no data."""

    last: int  # number of the last load
    max_doc_id: int
    buckets: int | None
    live: list[int]
    layouts: list[urls.Shape]
    sources: set[str]


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def loads(self) -> DataFrame:
        """The committed loads with their reports."""
        return self._read("loads")

    def _read(self, table: str) -> DataFrame:
        schema = _SCHEMAS[table]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _state(self) -> State:
        """The state after the last committed load. A load that replaces the corpus hides all loads before it."""
        rows = self.loads().drop("at", "added").collect()
        base = max((r.load for r in rows if r.replaces), default=0)
        live = sorted((r for r in rows if r.load >= base), key=lambda r: r.load)
        return State(
            max((r.load for r in rows), default=0),
            max((r.max_doc_id for r in live), default=-1),
            live[0].buckets if live else None,
            [r.load for r in live],
            [urls.Shape(r.load, r.url_buckets, r.url_cells) for r in live if r.url_buckets],
            {r.source for r in rows if r.source},
        )

    def last_doc_id(self) -> int:
        return self._state().max_doc_id

    def has_loaded(self, source: str) -> bool:
        """Whether a load of this source (a stream's batch) is committed."""
        return source in self._state().sources

    def known_urls(self, batch: DataFrame, stage: Stage) -> DataFrame:
        """The urls of `batch` that a live load holds."""
        layouts = self._state().layouts
        return urls.known(batch, layouts, self._read("urls"), self._read("url_filters"), stage)

    def next_load(self) -> int:
        return self._state().last + 1

    def quarantine(self) -> DataFrame:
        """Rejected entries of the live loads, with the reason and what the feed said."""
        return self.spark.read.parquet(f"{self.path}/quarantine").where(F.col("load").isin(self._state().live))

    def table(self, name: str) -> DataFrame:
        """A table's committed loads; the others' folders are listed, then left out of the scan."""
        return self._read(name).where(F.col("load").isin(self._state().live))

    def posts(self) -> DataFrame:
        return self.table("posts").drop(*ENDS.values())

    def index(self) -> ix.Index:
        """The committed index. Document frequencies are partial, one row per load."""
        state = self._state()
        of_loads = F.col("load").isin(state.live)
        sums = self._read("field_sums").where(of_loads)
        totals = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", *ix.TEXT_FIELDS, *ix.EXACT_FIELDS)])
        return ix.Index(
            self._read("posts").where(of_loads),
            self._read("postings").where(of_loads),
            self._read("doc_freq").where(of_loads),
            ix.per_field(totals),
            self._read("days").where(of_loads),
            state.buckets or 1,
        )

    def add(self, posts: DataFrame, buckets: int | None = None, replace: bool = False, source: str | None = None, ranged: bool = False) -> int:
        """Write posts that carry their doc_id as one load with its index; returns its number.

        The index is derived from the posts as just stored, so a retry sees the same rows. `source` names what
        was loaded, for has_loaded(). `ranged`: the posts come in ranges of doc_id, and no text is moved to store it.
        """
        state = self._state()
        load = state.last + 1
        max_id, known = (-1, None) if replace else (state.max_doc_id, state.buckets)
        stored = self._write_posts(with_ends(posts), load, ranged)
        sums = self._write("field_sums", load, ix.stored_sums(stored), [])
        size = sums.select("n_docs", *ix.TEXT_FIELDS).first()
        totals = {f: size[f] or 0 for f in ix.TEXT_FIELDS}
        buckets = known or buckets or self._choose_buckets(sum(totals.values()))
        layout = urls.shape(load, size.n_docs or 0)
        written = self._write_new_postings(stored, load, buckets, totals)
        self._write_counts(ix.doc_freq(written), ix.day_counts(stored), load)
        self._write_urls(stored, load, layout)
        report = stored.agg(
            F.current_timestamp().alias("at"),
            F.count("*").alias("added"),
            F.coalesce(F.greatest(F.max("doc_id"), F.lit(max_id)), F.lit(max_id)).cast("bigint").alias("max_doc_id"),
        )
        self._report(load, report, buckets, replace, layout, source)
        return load

    def fold(self) -> int:
        """Fold the live loads into one; returns its number.

        Nothing is cut or counted again: posts are copied with their fragments' ends, the loads' postings are dealt to the buckets their
        joint size asks for and sorted there, frequencies, sums and days are added up, and the quarantine goes along.
        """
        state = self._state()
        load = state.last + 1

        def live(table: str) -> DataFrame:
            return self._read(table).where(F.col("load").isin(state.live))

        self._write_posts(live("posts"), load)
        total = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("n_docs", *ix.TEXT_FIELDS, *ix.EXACT_FIELDS)]
        sums = self._write("field_sums", load, live("field_sums").agg(*total), [])
        size = sums.select("n_docs", (F.col("title") + F.col("content")).alias("tokens")).first()
        buckets, layout = self._choose_buckets(size.tokens), urls.shape(load, size.n_docs)
        self._write_postings(live("postings"), load, buckets)
        frequencies = live("doc_freq").groupBy("field", "token").agg(F.sum("df").alias("df"))
        self._write_counts(frequencies, live("days").groupBy("day").agg(F.sum("n").alias("n")), load)
        self._write_urls(live("urls"), load, layout)
        try:
            self.set_aside(self.quarantine().drop("load"), load)
        except AnalysisException as e:  # nothing was ever set aside
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        report = sums.select(F.current_timestamp().alias("at"), F.col("n_docs").alias("added"), F.lit(state.max_doc_id).cast("bigint").alias("max_doc_id"))
        self._report(load, report, buckets, True, layout, None)
        return load

    def _report(self, load: int, report: DataFrame, buckets: int, replace: bool, layout: urls.Shape | None, source: str | None) -> None:
        facts = {"buckets": buckets, "replaces": replace, "url_buckets": layout and layout.buckets, "url_cells": layout and layout.cells, "source": source}
        kinds = {f.name: f.dataType for f in _SCHEMAS["loads"]}
        self._write("loads", load, report.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in facts.items()}), [])

    def report_nothing(self, source: str | None = None) -> int:
        """A load that added nothing: its report alone."""
        state = self._state()
        row = self.spark.range(1).select(
            F.current_timestamp().alias("at"),
            F.lit(0).cast("bigint").alias("added"),
            F.lit(state.max_doc_id).cast("bigint").alias("max_doc_id"),
        )
        if state.buckets is None:  # the first posts choose the buckets
            return self.add(self.posts(), source=source)
        self._report(state.last + 1, row, state.buckets, False, None, source)
        return state.last + 1

    def vacuum(self) -> int:
        """Delete the folders of loads that are superseded or were never committed; the reports stay."""
        live = set(self._state().live)
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        deleted = 0
        for table in {*_SCHEMAS, "quarantine"} - {"loads"}:
            root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
            files = root.getFileSystem(hadoop)
            for status in files.listStatus(root) if files.exists(root) else []:
                name = status.getPath().getName()
                if name.startswith("load=") and int(name[5:]) not in live:
                    deleted += bool(files.delete(status.getPath(), True))
        return deleted

    def set_aside(self, rows: DataFrame, load: int) -> None:
        """Keep a load's rejected rows beside the corpus."""
        rows.write.mode("overwrite").parquet(f"{self.path}/quarantine/load={load}")

    def _choose_buckets(self, tokens: int) -> int:
        """Enough buckets to prune by, few enough to keep their files large. The first load
        decides; a store that starts small and grows gets new ones when it is compacted."""
        most = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return min(most, max(8, tokens // TOKENS_PER_BUCKET))

    def _write_posts(self, posts: DataFrame, load: int, ranged: bool = False) -> DataFrame:
        """Posts are brought together by slice, unless they lie in ranges of doc_id: a range falls into few slices."""
        sliced = posts.withColumn("slice", F.floor(F.col("doc_id") / SLICE_DOCS))
        return self._write("posts", load, sliced if ranged else sliced.hint("rebalance", "slice"), ["slice"])

    def _write_postings(self, postings: DataFrame, load: int, buckets: int) -> DataFrame:
        """Rebalancing by bucket lets Spark split the ones that hold a very frequent token."""
        entries = (
            postings.withColumn("bucket", bucket(F.col("token"), buckets))
            .hint("rebalance", "field", "bucket")
            .sortWithinPartitions("field", "bucket", "token", "doc_id")
        )
        return self._write("postings", load, entries, ["field", "bucket"])

    def _write_new_postings(self, stored: DataFrame, load: int, buckets: int, totals: dict[str, int]) -> DataFrame:
        """The postings of posts as just stored. Only packed postings are shuffled, and texts where rows share a doc_id."""
        alone = stored.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        exact = ix.exact_postings(stored).withColumn("bucket", bucket(F.col("token"), buckets)).hint("rebalance", "field", "bucket")
        entries = token_packs(stored, buckets, alone, "date", totals=totals).unionByName(exact)
        return self._write("postings", load, entries.sortWithinPartitions("field", "bucket", "token", "doc_id"), ["field", "bucket"])

    def _write_counts(self, doc_freq: DataFrame, days: DataFrame, load: int) -> None:
        self._write("doc_freq", load, doc_freq.sortWithinPartitions("field", "token"), [])
        self._write("days", load, days, [])

    def _write_urls(self, rows: DataFrame, load: int, layout: urls.Shape) -> None:
        keys = self._write("urls", load, urls.keyed(rows, layout), ["bucket"])
        self._write("url_filters", load, urls.filters(keys, layout), ["bucket"])

    def _write(self, table: str, load: int, df: DataFrame, by: list[str]) -> DataFrame:
        """Replace this load's folder of a table and return the rows as stored."""
        path = f"{self.path}/{table}/load={load}"
        names = [f.name for f in _SCHEMAS[table] if f.name not in ("load", *by)]
        schema = T.StructType([_SCHEMAS[table][n] for n in names] + [_SCHEMAS[table][n] for n in by])
        to = df.select(*names, *by).write.mode("overwrite").option("compression", "zstd").partitionBy(*by)
        if table == "posts":
            to = to.option("maxRecordsPerFile", FILE_DOCS)
        if table == "postings":  # doc_ids and positions ascend: this format stores differences
            to = to.option("parquet.writer.version", "v2")
            for column in ("doc_id", "positions.list.element"):
                to = to.option(f"parquet.enable.dictionary#{column}", "false")
        to.parquet(path)
        return self.spark.read.schema(schema).parquet(path)
