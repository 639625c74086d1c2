"""Suffix-array dedup with a logarithmic family of indexes.

Passages of ``length`` words or more that occur in several documents are found with
sparse suffix arrays over words. A suffix is sampled if its first ``gram`` words have the least hash
(the leftmost, of equal ones) among the suffixes that begin in the first half of some window of
``length`` words. The choice depends on the window's words only, so equal windows have the
same sampled suffix, and at least ``length - half - 1`` of its words, ``reach``, lie in both. A word is
known by its hash, as a token by its number; a suffix array holds the sampled
suffixes of a batch in the order of their words, the order kept by two keys, the hashes of the first and the second
half of the ``reach`` words, as a table bucketed and sorted by both in the shared folder.

Batches arrive one after another. A new batch gets its suffix array, which is merge-scanned with each
existing level (both lie in the same buckets in the same order: no shuffle): neighbours whose longest common
prefix is ``reach`` words or more are met. Then it becomes a level, and levels of equal
size are merged, so that after n batches there are at most log2(n) + 1 levels and a suffix is
rewritten log2(n) times. The family lives in a folder and can be opened again to add to it.

What was met is a candidate only. Each window of ``length`` words belongs to one sampled suffix; those of the
met ones are read from the texts again and compared by 64-bit hashes. Equal texts are indexed once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import drop_path, fresh_path, text_hash, whole_groups, written

#: suffixes of one prefix whose windows one task compares; those of more are spread by the windows' hashes
GROUP_ROWS = 20_000


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i:i+w] for each i with a whole window, in linear time."""
    n = len(x)
    cells = np.concatenate([x, np.full(-n % w, x[-1], x.dtype)]).reshape(-1, w)
    prefix = np.minimum.accumulate(cells, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


class Words:
    """The words of a chunk, its windows, and the sampled suffix that each belongs to."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        starts, ends = kernels.runs(kernels.VISIBLE[data], offsets)
        self.bound = np.searchsorted(starts, offsets)
        self.hash = kernels.spans_hash(data, starts, ends)
        n, half = len(starts), length // 2
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bound))
        self.window = self.sample = np.zeros(0, np.int64)
        if n < length:
            return
        at = np.arange(n - length + 1)
        self.window = at[self.row[at] == self.row[at + length - 1]]
        first = np.arange(n - gram + 1)
        prefix = kernels.spans_hash(self.hash, first, first + gram)
        order = np.argsort(prefix, kind="stable")  # the leftmost of equal ones is the least
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.sample = order[_sliding_min(rank, half)[self.window]]

    def spans(self, at: np.ndarray, length: int) -> np.ndarray:
        return kernels.spans_hash(self.hash, at, at + length).view(np.int64)


def _reach(length: int) -> int:
    return length - length // 2 + 1


def _scan(length: int, gram: int):
    reach = _reach(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in kernels.chunks(b.column("text")):
                w = Words(data, offsets, length, gram)
                pick = np.unique(w.sample)
                if len(pick):
                    row = w.row[pick]
                    yield pa.RecordBatch.from_arrays([pa.array(w.spans(pick, reach // 2)), pa.array(w.spans(pick + reach // 2, reach - reach // 2)), b.column("text_key").take(pa.array(first + row)), pa.array((pick - w.bound[row]).astype(np.int32))], ["k1", "k2", "text_key", "pos"])

    return run


class SuffixIndex:
    """The family of levels in a folder; add() takes a batch of suffixes (k1, k2, text_key, pos), common() tells those met in another text.

    A folder that holds a family already is opened: its levels and what was met are kept.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 0):
        self.spark, self.path = spark, path
        self.levels: list[tuple[int, str]] = []
        self.met: list[str] = []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        fs, at = self._file("family.json")
        if fs.exists(at):
            said = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/family.json").collect()))
            self.levels, self.met, self.buckets = [tuple(x) for x in said["levels"]], said["met"], said["buckets"]

    def _file(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _save(self) -> None:
        """The list of levels is written beside the old one and put in its place."""
        (fs, new), (_, at) = self._file("family.new"), self._file("family.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"levels": self.levels, "met": self.met, "buckets": self.buckets}).encode()))
        out.close()
        fs.delete(at, False)
        fs.rename(new, at)

    def _table(self, name: str) -> DataFrame:
        """A level, known to this session as bucketed and sorted."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (k1 BIGINT, k2 BIGINT, text_key BIGINT, pos INT) USING parquet CLUSTERED BY (k1, k2) SORTED BY (k1, k2, text_key, pos) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _store(self, df: DataFrame) -> str:
        name = f"tarnwood_sa_{uuid.uuid4().hex}"
        sorted_ = df.repartition(self.buckets, "k1", "k2").sortWithinPartitions("k1", "k2", "text_key", "pos")
        sorted_.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2", "text_key", "pos").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(self.spark, f"{self.path}/{name}")

    def add(self, batch: DataFrame) -> None:
        size, name = 1, self._store(batch.distinct())
        prefixes = self._table(name).groupBy("k1", "k2").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"))
        met = prefixes.where("a <> b").select("k1", "k2")
        for _, other in self.levels:
            met = met.union(prefixes.join(self._table(other).select("k1", "k2", F.col("text_key").alias("t")), ["k1", "k2"]).where("t <> a or t <> b").select("k1", "k2"))
        self.met.append(f"{self.path}/met-{uuid.uuid4().hex}")
        met.distinct().write.parquet(self.met[-1])
        gone = []
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            merged = self._store(self._table(old).union(self._table(name)).distinct())
            gone += [old, name]
            name, size = merged, size * 2
        self.levels.append((size, name))
        self._save()
        for x in gone:
            self._drop(x)

    def common(self) -> DataFrame:
        """(k1, k2, text_key, pos, n): all suffixes whose prefix was met in another text, n being those of its prefix."""
        met = self.spark.read.schema("k1 bigint, k2 bigint").parquet(*self.met).distinct()
        every = None
        for _, name in self.levels:
            part = self._table(name).join(met, ["k1", "k2"], "left_semi")
            every = part if every is None else every.union(part)
        every = written(every, "met-suffixes")
        counts = every.groupBy("k1", "k2").agg(F.count("*").alias("n"))
        return every.join(counts, ["k1", "k2"])

    def close(self) -> None:
        """Forget and delete the family."""
        for _, name in self.levels:
            self._drop(name)
        drop_path(self.spark, self.path)
        self.levels, self.met = [], []


def _windows(length: int, gram: int):
    """Rows (g, text_key, pos, s, h): for each listed suffix the windows that belong to it, by where they begin and their hashes."""
    reach = _reach(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed = b.column("at")
            of, flat = listed.offsets.to_numpy(), listed.values
            at, spread = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            for first, data, offsets in kernels.chunks(b.column("text")):
                w = Words(data, offsets, length, gram)
                if not len(w.window):
                    continue
                last = first + len(offsets) - 1
                row = np.repeat(np.arange(last - first), np.diff(of[first : last + 1]))
                wanted, parts = w.bound[row] + at[of[first] : of[last]], spread[of[first] : of[last]]
                many = np.zeros(len(w.hash), np.int64)
                many[wanted] = parts
                use = many[w.sample] > 0
                s, sample = w.window[use], w.sample[use]  # windows of one suffix are neighbours
                if not len(s):
                    continue
                h = w.spans(s, length)
                part = h.view(np.uint64) % many[sample].astype(np.uint64)
                if (part > 0).any():
                    order = np.lexsort((s, part, sample))
                    s, sample, h, part = s[order], sample[order], h[order], part[order]
                new = np.flatnonzero(np.append(True, (sample[1:] != sample[:-1]) | (part[1:] != part[:-1])))
                ends = np.append(new, len(s)).astype(np.int32)
                head = sample[new]
                own = w.row[head]
                key = kernels.mix(w.spans(head, reach).view(np.uint64) + part[new]).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((s - w.bound[w.row[s]]).astype(np.int32), h)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *(b.column(c).take(pa.array(first + own)) for c in ("text_key", "low", "high")), *lists], ["g", "text_key", "low", "high", "s", "h"])

    return run


def _compare(t: pa.Table, length: int) -> pa.RecordBatch:
    """Ranges of words whose windows another document has, with a place of the first in the first and in the last such document."""
    t = t.combine_chunks()
    lists = t["s"].chunk(0)
    size = np.diff(lists.offsets.to_numpy())
    flat = lambda c: t[c].chunk(0).flatten().to_numpy()
    s, h = flat("s").astype(np.int64), flat("h")
    entry = np.repeat(np.arange(len(size)), size)
    group, text = t["g"].to_numpy()[entry], t["text_key"].to_numpy()
    # documents by rank: of a null id comes first, as a null sorts in Spark
    low, high = t["low"].to_numpy(), t["high"].to_numpy()
    low_d, high_d = low[entry], high[entry]
    order = np.lexsort((h, group))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (group[order][1:] != group[order][:-1]))
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    name = text[entry]
    head = np.lexsort((s, name, low_d, of))
    least = head[np.flatnonzero(np.append(True, of[head][1:] != of[head][:-1]))]
    tail = np.lexsort((-s, name, high_d, of))
    most = tail[np.append(np.flatnonzero(of[tail][1:] != of[tail][:-1]), len(tail) - 1)]
    shared = ((low_d[least] != high_d[most]) | (name[least] != name[most]))[of]
    e, p, w = entry[shared], s[shared], of[shared]
    a, b = least[w], most[w]
    brk = np.append(True, (e[1:] != e[:-1]) | (p[1:] != p[:-1] + 1) | (a[1:] - a[:-1] != 1) | (b[1:] - b[:-1] != 1)) if len(e) else np.zeros(0, bool)
    at = np.flatnonzero(brk)
    stop = np.append(at[1:], len(e))[: len(at)] - 1
    x, y = a[at], b[at]
    columns = [text[e[at]], p[at], p[stop] + length, low_d[x], name[x], s[x], high_d[y], s[y]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["text_key", "a", "b", "low", "low_t", "low_s", "high", "high_s"])


def repeated_passages(docs: DataFrame, length: int = 50, gram: int = 8, batches: int = 4, path: str | None = None) -> DataFrame:
    """Passages of docs(doc_id, text) that another document has too.

    (doc_id, start_word, n_words, other_doc_id, other_start_word): a maximal run of words,
    each of which lies in a window of ``length`` words that occurs in another document;
    other_* tell the first place of its first window in the first document by id that has it, or, for that first
    document itself, in the last one. A word is a run of visible bytes, compared as it is. Documents fall into
    ``batches`` arrivals by the hash of their text. With ``path`` the family is kept there.

    A document whose whole text another one has is one run; other_doc_id is then chosen among those of the same text.
    Null and short texts have no window. Documents are told apart by id and hash of the
    text: repeated rows are one document; rows of one id with other texts are two. Null ids take part and sort first. Empty table: no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", text_hash(F.col("text")))
    made: list[str] = []

    def stage(df: DataFrame, what: str) -> DataFrame:
        made.append(fresh_path(spark, what))
        return written(df, what, made[-1])

    # who has a text; ids by numbers that sort as they do, the null first
    number = F.coalesce("doc_id", F.lit(-(2**63)))
    scanned = slim.select("text_key", number.alias("doc"), F.regexp_count("text", F.lit(r"[^ \t\n\x0b\f\r]+")).alias("words"))
    members = stage(scanned.where(F.col("words") >= length).distinct(), "members")
    classes = stage(members.groupBy("text_key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.first("words").alias("words")), "classes")

    suffixes_at = fresh_path(spark, "suffixes")
    made.append(suffixes_at)
    schema = "k1 bigint, k2 bigint, text_key bigint, pos int"
    slim.select("text", "text_key").mapInArrow(_scan(length, gram), schema).withColumn("batch", F.pmod(F.hash("text_key"), F.lit(batches))).write.partitionBy("batch").parquet(suffixes_at)
    index = SuffixIndex(spark, path or fresh_path(spark, "family"))
    for b in range(batches):
        index.add(spark.read.schema(schema + ", batch int").parquet(suffixes_at).where(F.col("batch") == b).select("k1", "k2", "text_key", "pos"))
    wanted = index.common().groupBy(F.col("text_key").alias("t")).agg(F.collect_list(F.struct("pos", F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int").alias("parts"))).alias("at"))
    wanted = stage(wanted.join(classes.select("text_key", "low", "high"), F.col("t") == F.col("text_key")).select("t", "low", "high", "at"), "wanted")
    if path is None:
        index.close()

    first = (number == F.col("low")) & (F.col("text_key") == F.col("t"))
    again = slim.join(wanted, first).select("text_key", "text", "low", "high", "at")
    checked = again.mapInArrow(_windows(length, gram), "g bigint, text_key bigint, low bigint, high bigint, s array<int>, h array<bigint>")
    compare = lambda rows: (_compare(t, length) for t in whole_groups(rows, "g", 10_000))
    ranges = checked.repartition("g").sortWithinPartitions("g").mapInArrow(compare, "text_key bigint, a bigint, b bigint, low bigint, low_t bigint, low_s bigint, high bigint, high_s bigint")
    own = Window.partitionBy("text_key").orderBy("a", "b")
    reach = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    runs = ranges.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0)).withColumn("run", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("text_key", "run").agg(F.min("a").alias("start_word"), (F.max("b") - F.min("a")).alias("n_words"), F.min(F.struct("a", "low", "low_t", "low_s", "high", "high_s")).alias("o"))
    merged = merged.select(F.col("text_key").alias("t"), "start_word", "n_words", "o.low", "o.low_t", "o.low_s", "o.high", "o.high_s")
    single = classes.where("low = high").select("text_key", F.col("low").alias("doc")).join(merged, F.col("text_key") == F.col("t"))
    none = F.lit(0).cast("bigint")
    several = classes.where("low <> high").select(F.col("text_key").alias("t"), F.col("words").cast("bigint").alias("n_words"), "low", "high")
    copied = members.select("text_key", "doc").join(several, F.col("text_key") == F.col("t")).select("text_key", "doc", none.alias("start_word"), "n_words", "low", F.col("t").alias("low_t"), none.alias("low_s"), "high", none.alias("high_s"))
    out = single.select(*copied.columns).union(copied)
    id_of = lambda c: F.when(F.col(c) > -(2**63), F.col(c))
    is_first = (F.col("doc") == F.col("low")) & (F.col("text_key") == F.col("low_t"))
    return out.select(id_of("doc").alias("doc_id"), "start_word", "n_words", F.when(is_first, id_of("high")).otherwise(id_of("low")).alias("other_doc_id"), F.when(is_first, F.col("high_s")).otherwise(F.col("low_s")).alias("other_start_word"))
