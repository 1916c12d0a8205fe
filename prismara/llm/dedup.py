"""New batches against all history: exact and near duplicates within a folder.

Content classes. Rows of one folder with the same hash, or with the same vector, form a class that keeps only its smallest history key
and its smallest arrival key, so any number of copies is one row after partial aggregation.

Chunks. Each class of vectors is cut into content-defined chunks (prismara.llm.chunks); the table of (chunk, class) is written to the
shared folder. Chunks that an arriving class shares with another give, summed up, the content they have in common; from ``COVER``
digits on the pair is compared, first with 8-bit components, then exactly. A record hash is a chunk of its own that covers all of it.

Chunks held by more than ``HOT`` classes make no pairs: they are compared in blocks of arriving and held classes, from which only the
smallest keys per arriving class come out. So no link is lost and no hot group is ever written out as pairs or held in one task.

``History`` keeps classes and chunk table between batches: what is pending is cut, looked up and appended. The chunk table (16 bytes a
chunk) is scanned for what the batch touches; of the classes only those touched are grouped and compared; the records behind them are
not read. All results come through it.

Loss: a pair at the threshold itself shares less than ``COVER`` digits in about 1 of 200 cases, at similarity 0.99 in 1 of 4,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismara.llm.chunks import LENGTH, chunks, digits_of
from prismara.llm.vectors import DIM, matrix, pack, unpack
from prismara.storage import materialise, table_path

COVER = 2 * LENGTH
HOT = 256
#: Appends after which a history is joined to one table.
COMPACT = 16
BLOCK = 1_024
SENT = 1_000_000
#: Most chunks of a batch that are looked up by a bit map (16 MB) in every task; beyond, by a shuffled join.
MARKED, MAP_BITS = 4_000_000, 27
HOT_SHARE = 1 / 500
COARSE_ERROR = 0.012


def canonical_hash(column):
    """A SHA-256 in one notation: 64 lower-case hex digits, without a name in front or signs between; other text trimmed, in lower case."""
    low = F.lower(F.trim(column))
    bare = F.regexp_replace(F.regexp_replace(low, r"^(sha-?_?256\s*[:=(]?\s*|0x|\\x)", ""), r"[^0-9a-z]", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare).when(F.length(low) > 0, low)


def records(rows: DataFrame, key: str, folder: str, sha: str | None, vector: str | None, arriving: bool) -> DataFrame:
    """(id, arriving, folder, content, vec): a row for each content of a record, its hash ('s...') or its usable vector ('v...')."""
    base = rows.where(F.col(key).isNotNull() & F.col(folder).isNotNull())
    out = None
    if sha:
        out = base.select(F.col(key).cast("long").alias("id"), F.col(folder).cast("long").alias("folder"), canonical_hash(F.col(sha)).alias("content"), F.lit(None).cast("binary").alias("vec")).where("content is not null")
    if vector:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = matrix(batch.column(2))
                if len(at):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pack(x)], ["id", "folder", "vec"])

        usable = base.where(F.size(vector) == DIM).select(F.col(key).cast("long").alias("id"), F.col(folder).cast("long").alias("folder"), F.col(vector).alias("v"))
        own = usable.mapInArrow(run, "id long, folder long, vec binary").select("id", "folder", F.concat(F.lit("v"), F.md5("vec")).alias("content"), "vec")
        out = own if out is None else out.unionByName(own)
    return out.withColumn("arriving", F.lit(arriving))


def classes(rows: DataFrame) -> DataFrame:
    """(cid, folder, content, held, came, n, vec): per folder and content the smallest history key, the smallest arrival key, and the
    number of arrivals."""
    grouped = rows.groupBy("folder", "content").agg(
        F.min(F.when(~F.col("arriving"), F.col("id"))).alias("held"),
        F.min(F.when(F.col("arriving"), F.col("id"))).alias("came"),
        F.count_if(F.col("arriving")).alias("n"),
        F.min("vec").alias("vec"),
    )
    return grouped.withColumn("cid", F.xxhash64("folder", "content"))


def chunk_table(vectors: DataFrame) -> DataFrame:
    """(chunk, cid) of classes with a vector; chunks of different folders differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                cid, folder = part.column(0).to_numpy(), part.column(1).to_numpy()
                row, mark = chunks(digits_of(unpack(part.column(2))))
                with np.errstate(over="ignore"):
                    mark = (mark.view(np.uint64) ^ (folder[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(cid[row])], ["chunk", "cid"])

    return vectors.select("cid", "folder", "vec").mapInArrow(run, "chunk long, cid long")


def _filtered(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows whose ``name`` is in ``keys``: the keys go to every task up to ``SENT`` of them, beyond that by a shuffled join."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT else keys, name, "left_semi")


def _looked_up(known: DataFrame, chunked: DataFrame) -> DataFrame:
    """Rows of the history's chunk table whose chunk may be among those of a batch. Up to ``SENT`` chunks of a batch go to every task as they
    are, up to ``MARKED`` as a bit map of ``MAP_BITS`` bits of their hashes, through which some others pass by chance, which changes no
    result; either way the table stays where it is. Beyond, both are joined in a shuffle."""
    n = chunked.count()
    if n <= SENT or n > MARKED:
        keys = chunked.select("chunk").distinct()
        return known.join(F.broadcast(keys) if n <= SENT else keys, "chunk", "left_semi").select("chunk", "cid")
    place = lambda c: c.view(np.uint64) >> np.uint64(64 - MAP_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(place(batch.column(0).to_numpy())).astype(np.int32))], ["at"])

    bits = np.zeros(1 << MAP_BITS, bool)
    bits[chunked.select("chunk").mapInArrow(places, "at int").toArrow().column(0).to_numpy()] = True
    shared = known.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(batch.column(0).to_numpy())
            met = shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(met.astype(bool)))

    return known.select("chunk", "cid").mapInArrow(run, "chunk long, cid long")


def near_classes(table: DataFrame, fetch, least: float, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(cid, held, came): for every asked class the smallest keys among the other classes with similarity ``least`` and more; and the
    classes that ``fetch`` gave. ``table``: (chunk, cid, asked), each once; ``fetch`` takes the cids of all classes that have to be compared."""
    counts = table.groupBy("chunk").agg(F.count("*").alias("n"), F.max("asked").alias("any")).where("n > 1 and any").select("chunk", "n")
    live = materialise(counts, "live")
    rows = table.join(F.broadcast(live) if live.count() <= SENT else live, "chunk")
    rows = materialise(rows, "shared")
    cool = rows.where(F.col("n") <= hot)
    pairs = cool.where("asked").select("chunk", F.col("cid").alias("q")).join(cool.select("chunk", F.col("cid").alias("x")), "chunk").where("q <> x")
    pairs = materialise(pairs.groupBy("q", "x").agg((F.count("*") * LENGTH).alias("cover")).where(F.col("cover") >= COVER).select("q", "x"), "pairs")
    every = fetch(pairs.select(F.explode(F.array("q", "x")).alias("cid")).unionByName(rows.where(F.col("n") > hot).select("cid")).distinct())
    vectors = every.where("vec is not null")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpack(batch.column(1))
                small = np.round(x / np.abs(x).max(1)[:, None] * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * DIM), pa.py_buffer(small.tobytes())])], ["cid", "small"])

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int8).reshape(-1, DIM).astype(np.float32) for c in (2, 3))
                sim = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
                good = pa.array(np.flatnonzero(sim >= least - COARSE_ERROR))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], ["q", "x"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("ij,ij->i", unpack(batch.column(3)).astype(np.float64), unpack(batch.column(4)).astype(np.float64))
                good = pa.array(np.flatnonzero(sim >= least))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(good) for c in range(3)], ["q", "held", "came"])

    small = vectors.select("cid", "vec").mapInArrow(shrink, "cid long, small binary")
    close = pairs.join(small.select(F.col("cid").alias("x"), F.col("small").alias("sx")), "x").join(small.select(F.col("cid").alias("q"), F.col("small").alias("sq")), "q")
    close = materialise(close.select("q", "x", "sq", "sx").mapInArrow(coarse, "q long, x long"), "close")
    left = _filtered(vectors.select("cid", F.col("vec").alias("vq")), close.select(F.col("q").alias("cid")).distinct(), "cid").withColumnRenamed("cid", "q")
    right = _filtered(vectors.select("cid", "held", "came", F.col("vec").alias("vx")), close.select(F.col("x").alias("cid")).distinct(), "cid").withColumnRenamed("cid", "x")
    near = close.join(right, "x").join(left, "q").select("q", "held", "came", "vq", "vx").mapInArrow(exact, "q long, held long, came long")
    warm = live.where(F.col("n") > hot)
    if warm.limit(1).count():
        near = near.unionByName(_hot(vectors, rows.where(F.col("n") > hot), least))
    return near.groupBy(F.col("q").alias("cid")).agg(F.min("held").alias("held"), F.min("came").alias("came")), every


def _hot(vectors: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(q, held, came) from chunks of many classes, block by block."""
    full = rows.select("chunk", "cid", "asked", "n").join(_filtered(vectors.select("cid", "held", "came", "vec"), rows.select("cid").distinct(), "cid"), "cid")
    full = materialise(full, "hot")
    asked = full.where("asked").groupBy("chunk").agg(F.count("*").alias("na"))
    wide = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), wide(n) - 1))
    mix = lambda n: F.pmod(F.xxhash64("cid"), wide(n)).cast("int")
    sized = full.join(F.broadcast(asked) if asked.count() <= SENT else asked, "chunk")
    left = sized.where("asked").select("chunk", mix("na").alias("i"), every("n").alias("j"), "cid", "vec")
    right = sized.select("chunk", every("na").alias("i"), mix("n").alias("j"), "cid", "held", "came", "vec")
    left, right = (df.toDF(*df.columns) for df in (left, right))  # both come from one table: new names for the same columns
    none = np.iinfo(np.int64).max

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int | None]] = []
        if a.num_rows and b.num_rows:
            x, y = (unpack(t.column("vec").combine_chunks()).astype(np.float64) for t in (a, b))
            ids, others = a.column("cid").to_numpy(), b.column("cid").to_numpy()
            held, came = (b.column(c).combine_chunks().fill_null(none).to_numpy() for c in ("held", "came"))
            for s in range(0, len(x), 256):
                hit = (x[s : s + 256] @ y.T >= least) & (ids[s : s + 256, None] != others[None, :])
                first = [np.where(hit, c, none).min(1) for c in (held, came)]
                for i in np.flatnonzero(hit.any(1)):
                    out.append((int(ids[s + i]), *[None if c[i] == none else int(c[i]) for c in first]))
        q, h, c = zip(*out) if out else ((), (), ())
        return pa.table({"q": pa.array(q, pa.int64()), "held": pa.array(h, pa.int64()), "came": pa.array(c, pa.int64())})

    return left.groupBy("chunk", "i", "j").cogroup(right.groupBy("chunk", "i", "j")).applyInArrow(compare, "q long, held long, came long")


def _repeats(arrivals: DataFrame, answers: DataFrame) -> DataFrame:
    """(asset_id_a, asset_id_b): per arrival the smallest key that its classes offer. Classes of many arrivals are at most
    ``1/HOT_SHARE``; those go to every task, so that their arrivals stay where they are."""
    answers = answers.where("n > 0 and (held is not null or came is not null)")
    total = arrivals.count()
    hot = answers.where(F.col("n") > max(1_000, total * HOT_SHARE))
    rest = answers.where(F.col("n") <= max(1_000, total * HOT_SHARE))
    wanted = arrivals.select("id", "folder", "content")
    cold_rows = wanted.join(F.broadcast(hot.select("folder", "content")), ["folder", "content"], "left_anti")
    met = cold_rows.join(rest, ["folder", "content"]).select("id", "held", "came").unionByName(wanted.join(F.broadcast(hot), ["folder", "content"]).select("id", "held", "came"))
    first = F.least(F.col("held"), F.when(F.col("came") < F.col("id"), F.col("came")))
    return met.groupBy("id").agg(F.min(first).alias("a")).where("a is not null").select(F.col("a").alias("asset_id_a"), F.col("id").alias("asset_id_b"))


def _answers(every: DataFrame, near: DataFrame) -> DataFrame:
    found = near.select("cid", F.col("held").alias("h"), F.col("came").alias("c"))
    return every.join(found, "cid", "left").select("folder", "content", "n", F.least("held", "h").alias("held"), F.least("came", "c").alias("came"))


def repeats(history: DataFrame, arrivals: DataFrame, least: float, hot: int = HOT) -> DataFrame:
    """(asset_id_a, asset_id_b): for every arrival the smallest record it repeats, if any.

    ``history`` and ``arrivals`` are rows of records(). An arrival repeats a history record or an arrival with a smaller key if both lie
    in the same folder and have the same hash or usable vectors with similarity ``least`` and more. Null keys and folders take no part;
    null, malformed and unusable contents match nothing by that content; repeated rows count once; empty tables give no rows.
    """
    kept = History(history.sparkSession, None, least, hot)
    kept.accept(history, arriving=False)
    return kept.accept(arrivals)


class History:
    """Classes and chunk table of all that was accepted, kept in a shared folder; a batch reads these, not the records behind them.

    ``accept`` returns a batch's repeats and appends the classes and chunks of all its records, so that later batches find the smallest
    key of each content. Each append is a table of its own, named after its number; a lost executor costs only its tasks. Opened on
    a path in use, it goes on from the complete parts, those whose classes and chunks were both written to the end; a batch whose append
    did not finish is accepted again and overwrites what there is of it. Every ``COMPACT`` parts are joined to one, in which a class has
    one row; until that is complete, the parts are read.
    """

    def __init__(self, spark, path: str | None = None, least: float = 0.985, hot: int = HOT):
        self.spark, self.path, self.least, self.hot = spark, path or table_path(spark, "history"), least, hot
        self.parts = self.joined = 0
        while self._whole("joined-classes", self.parts + COMPACT) and self._whole("joined-chunks", self.parts + COMPACT):
            self.joined = self.parts = self.parts + COMPACT
        while self._whole("classes", self.parts) and self._whole("chunks", self.parts):
            self.parts += 1

    def _whole(self, kind: str, part: int) -> bool:
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{part}/_SUCCESS")
        return done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)

    def _read(self, kind: str) -> DataFrame | None:
        paths = [f"{self.path}/joined-{kind}-{self.joined}"] if self.joined else []
        paths += [f"{self.path}/{kind}-{p}" for p in range(self.joined, self.parts)]
        return self.spark.read.parquet(*paths) if paths else None

    def accept(self, batch: DataFrame, arriving: bool = True) -> DataFrame | None:
        """``batch``: rows of records(), of one batch or of all that are pending. Keys must rise from batch to batch."""
        if not arriving:
            self._append(classes(batch))
            return None
        rows = materialise(batch, "pending")
        before, known = self._read("classes"), self._read("chunks")
        own, chunked = self._append(classes(rows))
        table = chunked.withColumn("asked", F.lit(True))
        if before is not None:
            anew = own.where("vec is not null").select("cid")
            touched = _looked_up(known, chunked)
            table = table.unionByName(touched.join(F.broadcast(anew) if anew.count() <= SENT else anew, "cid", "left_anti").distinct().withColumn("asked", F.lit(False)))

        def fetch(cids: DataFrame) -> DataFrame:
            if before is None:
                return own
            old = _filtered(before, cids.unionByName(own.select("cid")).distinct(), "cid")
            return materialise(self._merged(own.unionByName(old.withColumn("n", F.lit(0).cast("long")))), "merged")

        near, every = near_classes(materialise(table, "table"), fetch, self.least, self.hot)
        return materialise(_repeats(rows, _answers(every.drop("vec"), near)), "repeats")

    def _append(self, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Writes a part, and with every COMPACT-th the joined one; returns the part's classes and chunks."""
        paths = [f"{self.path}/{kind}-{self.parts}" for kind in ("classes", "chunks")]
        new.write.mode("overwrite").parquet(paths[0])
        own = self.spark.read.parquet(paths[0])
        chunk_table(own.where("vec is not null")).write.mode("overwrite").parquet(paths[1])
        self.parts += 1
        if self.parts - self.joined == COMPACT:
            self._merged(self._read("classes")).write.mode("overwrite").parquet(f"{self.path}/joined-classes-{self.parts}")
            self._read("chunks").distinct().write.mode("overwrite").parquet(f"{self.path}/joined-chunks-{self.parts}")
            self.joined = self.parts
        return own, self.spark.read.parquet(paths[1])

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cid", "folder", "content").agg(F.min("held").alias("held"), F.min("came").alias("came"), F.sum("n").alias("n"), F.min("vec").alias("vec"))
