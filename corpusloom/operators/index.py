"""The index as buckets of files in generation folders with a manifest: build, incremental update, removal, vectors, freshness.

Every relation is cut into buckets by a hash of the file that a row belongs to. A write never changes what a reader sees: it
fills a new generation folder with the buckets it touches and then replaces the manifest, which names the generation of
each bucket, by an atomic rename. One writer at a time holds a lock file. All files are reached through the cluster's file
system interface, so the folder may lie on any storage that it knows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators import vectors as V
from corpusloom.operators.resolve import resolve
from corpusloom.session import cut, prepare
from corpusloom.sources import extract as X
from corpusloom.sources import files as S

VERSION = 2
STALE_SECONDS = 300  # fixed value of the reference: a state degraded for longer reads as stale
BULK = 200  # fixed value of the reference: more changes than this count as a bulk update
#: A lock that is older was left by a writer that died.
LOCK_SECONDS = 6 * 3600
#: Buckets of a new index.
BUCKETS = 64
RELATIONS = ("files", "symbols", "edges", "chunks", "vectors")
VECTORS = "chunk_id long, embedding array<float>"
# the file of a row: ids of symbols, edges and chunks begin with that of their file
KEY = {"files": "id", "symbols": "file_id", "chunks": "file_id", "edges": "src_id", "vectors": "chunk_id"}


def file_of(name: str) -> Column:
    """The id of the file that a row of relation NAME belongs to."""
    return F.shiftright(KEY[name], 20) if name in ("edges", "vectors") else F.col(KEY[name])


class Folder:
    """Small files below ROOT on any file system that the cluster knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist; whether it did not."""
        try:
            out = self.fs.create(self._path(name), False)
        except Py4JJavaError:
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Write a file so that readers see either its old or its new content."""
        part = name + ".part"
        self.delete(part)
        self.create(part, text)
        fs = self.jvm.org.apache.hadoop.fs
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(part), self._path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self._path(name)):
            return []
        return [f.getPath().getName() for f in self.fs.listStatus(self._path(name))]


@dataclass
class Manifest:
    version: int = VERSION
    generation: int = 0
    freshness: str = "fresh"
    since: float = 0.0
    model_id: str | None = None
    model_dim: int | None = None
    buckets: int = BUCKETS
    #: Per relation its schema and the generation of each bucket that has rows.
    schemas: dict = field(default_factory=dict)
    at: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def state(self, now: float) -> str:
        """The freshness as a reader sees it at time NOW."""
        known = ("fresh", "indexing", "reconciling", "degraded", "stale")
        s = self.freshness if self.freshness in known else "degraded"
        return "stale" if s == "degraded" and now - self.since > STALE_SECONDS else s


class Store:
    """An index below ROOT, a folder that all executors share. A new one has BUCKETS buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        prepare(spark)
        self.spark, self.root, self.buckets, self.folder = spark, root.rstrip("/"), buckets, Folder(spark, root.rstrip("/"))

    def manifest(self, writing: bool = False) -> Manifest:
        """The manifest. Another version is an error for a reader and a fresh start for a writer."""
        text = self.folder.read("manifest.json")
        if text is None:
            return Manifest(buckets=self.buckets)
        try:
            m = Manifest(**json.loads(text))
        except (ValueError, TypeError):
            m = Manifest(version=-1)
        if m.version == VERSION:
            return m
        if writing:
            return Manifest(buckets=self.buckets)
        raise ValueError("the index has another version; rebuild it")

    def _save(self, m: Manifest) -> None:
        self.folder.replace("manifest.json", json.dumps(asdict(m)))

    def set_freshness(self, state: str, now: float | None = None) -> None:
        """Record STATE; its time changes only when the state does."""
        m = self.manifest(writing=True)
        if m.freshness != state:
            m.freshness, m.since = state, time.time() if now is None else now
        self._save(m)

    @contextmanager
    def lock(self, now: float | None = None) -> Iterator[bool]:
        """Yields whether this process is the one writer. A lock older than LOCK_SECONDS is taken over."""
        now = time.time() if now is None else now
        held = self.folder.read("writer.lock")
        if held is not None and now - float(held or 0) > LOCK_SECONDS:
            self.folder.delete("writer.lock")
        mine = self.folder.create("writer.lock", str(now))
        try:
            yield mine
        finally:
            if mine:
                self.folder.delete("writer.lock")

    @contextmanager
    def _writing(self) -> Iterator[None]:
        with self.lock() as mine:
            if not mine:
                raise RuntimeError("another process writes to the index")
            yield

    def read(self, name: str) -> DataFrame:
        """The relation NAME as the manifest has it now; empty if nothing was written to it."""
        m = self.manifest()
        schema = StructType.fromJson(m.schemas[name]) if name in m.schemas else VECTORS
        paths = [f"{self.root}/gen-{g}/{name}/bucket={b}" for b, g in m.at.get(name, {}).items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(file_of(name).cast("long")), F.lit(buckets)).cast("int")

    def _write(self, tables: dict[str, tuple[DataFrame, set[int] | None]], fresh: bool = False, **changes) -> int:
        """Write the named buckets (None: all) of each of TABLES as a new generation; other buckets stay where they are."""
        m = self.manifest(writing=True)
        m.generation += 1
        if fresh:
            m.at, m.schemas = {}, {}
        for name, (df, buckets) in tables.items():
            m.schemas[name] = df.schema.jsonValue()
            old = {} if buckets is None else {b: g for b, g in m.at.get(name, {}).items() if int(b) not in buckets}
            if buckets is None or buckets:
                place = f"gen-{m.generation}/{name}"
                rows = df.withColumn("bucket", self._bucket(name, m.buckets))
                if buckets is not None:
                    rows = rows.where(F.col("bucket").isin(sorted(buckets)))
                rows.repartition(m.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{place}")
                old |= {d.partition("=")[2]: m.generation for d in self.folder.names(place) if d.startswith("bucket=")}
            m.at[name] = old
        for k, v in changes.items():
            setattr(m, k, v)
        self._save(m)
        return m.generation

    def _touched(self, name: str, rows: DataFrame) -> set[int]:
        """The buckets of ROWS of relation NAME, at most as many numbers as the index has buckets."""
        return {r[0] for r in rows.select(self._bucket(name, self.manifest().buckets)).distinct().collect()}

    def build(self, files: DataFrame) -> int:
        """Index all supported FILES (``id, path, hash, content``) from scratch; returns the generation."""
        with self._writing():
            good = files.where(S.file_class(F.col("path"), F.col("content")) == "supported")
            s, e, c = X.relations(cut(X.parse_files(good)))
            kept = good.select("id", "path", S.language(F.col("path")).alias("lang"), "hash")
            none = self.spark.createDataFrame([], VECTORS)
            return self._write({"files": (kept, None), "symbols": (s, None), "edges": (resolve(e, s), None), "chunks": (c, None), "vectors": (none, None)}, True)

    def update(self, files: DataFrame) -> int:
        """Bring the index to the state of FILES, which are all files: hashes decide which are read again, missing ones go.

        Only changed files are parsed. Edges are resolved anew where a name was touched or a target went away, and only
        buckets in which something changed are written. The result equals that of :meth:`build` on the same files, save that
        vectors of unchanged files stay.
        """
        good = files.where(S.file_class(F.col("path"), F.col("content")) == "supported")
        return self._change(good, self.read("files").select(F.col("id").alias("file_id")))

    def update_paths(self, paths: DataFrame, files: DataFrame) -> int:
        """Bring PATHS (``path``) to their state in FILES: changed and new ones are indexed, those not there are removed.

        Repeating it changes nothing, so it may be called for each batch of a stream of changes
        (:func:`corpusloom.streaming.debounce.apply_stream`).
        """
        asked = paths.select("path").distinct()
        good = files.join(asked, "path", "left_semi").where(S.file_class(F.col("path"), F.col("content")) == "supported")
        return self._change(good, self.read("files").join(asked, "path", "left_semi").select(F.col("id").alias("file_id")))

    def remove(self, paths: DataFrame) -> int:
        """Take the files of PATHS (``path``) out of all relations; references to them become unresolved."""
        ids = self.read("files").join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
        none = self.spark.createDataFrame([], "id long, path string, hash binary, content binary")
        return self._change(none, ids)

    def _change(self, good: DataFrame, asked: DataFrame) -> int:
        """Make GOOD the state of the files of ASKED (``file_id``) and of those in GOOD; nothing is written if they are so."""
        with self._writing():
            old = {n: self.read(n) for n in RELATIONS}
            same = good.select("id", "path", "hash").join(old["files"].select("id", "path", "hash"), ["id", "path", "hash"], "left_semi").select(F.col("id").alias("file_id"))
            changed = cut(good.join(same.withColumnRenamed("file_id", "id"), "id", "left_anti"))
            drop = cut(asked.unionByName(changed.select(F.col("id").alias("file_id"))).distinct().join(same, "file_id", "left_anti"))
            if not drop.take(1):
                return self.manifest().generation
            s, e, c = X.relations(cut(X.parse_files(changed)))
            of = lambda n, df, how: df.withColumn("file_id", file_of(n).cast("long")).join(drop, "file_id", how).select(df.columns)
            gone = of("symbols", old["symbols"], "left_semi")
            symbols = of("symbols", old["symbols"], "left_anti").unionByName(s)
            touched = gone.select("name").unionByName(s.select("name")).distinct()
            plain = ["id", "src_id", "kind", "dst_name", "dst_arity"]
            kept = of("edges", old["edges"], "left_anti")
            again = cut(resolve(kept.select(*plain).unionByName(e), symbols, touched))
            rest = kept.unionByName(resolve(e, symbols)).join(again.select("id"), "id", "left_anti")
            kept_files = of("files", old["files"], "left_anti").unionByName(changed.select("id", "path", S.language(F.col("path")).alias("lang"), "hash"))
            own = self._touched("files", drop.select(F.col("file_id").alias("id")))
            return self._write({
                "files": (kept_files, own), "symbols": (symbols, own), "edges": (rest.unionByName(again), own | self._touched("edges", again)),
                "chunks": (of("chunks", old["chunks"], "left_anti").unionByName(c), own), "vectors": (of("vectors", old["vectors"], "left_anti"), own),
            })

    # --- vectors ------------------------------------------------------------------------------------------------------

    def set_model(self, model_id: str, dim: int) -> bool:
        """Record the embedder; whether it differs from the one before, whose vectors are then dropped."""
        m = self.manifest(writing=True)
        if (m.model_id, m.model_dim) == (model_id, dim):
            return False
        with self._writing():
            self._write({"vectors": (self.spark.createDataFrame([], VECTORS), None)}, model_id=model_id, model_dim=dim)
        return True

    def backlog(self) -> DataFrame:
        """Chunks without a vector: ``chunk_id, content``."""
        return V.backlog(self.read("chunks").select(F.col("id").alias("chunk_id"), "content"), self.read("vectors"))

    def put_vectors(self, vectors: DataFrame) -> int:
        """Insert or replace VECTORS (``chunk_id, embedding``); of rows of one chunk any stands. Only their buckets are written.

        Vectors of another length than the model's are an error, and so is an index without a model.
        """
        dim = self.manifest().model_dim
        new = cut(vectors.where(F.col("chunk_id").isNotNull()).select("chunk_id", F.col("embedding").cast("array<float>")).dropDuplicates(["chunk_id"]))
        if dim is None or new.where(F.col("embedding").isNull() | (F.size("embedding") != dim)).take(1):
            raise ValueError(f"vectors must have the {dim} dimensions of the index's model")
        with self._writing():
            rest = self.read("vectors").join(new.select("chunk_id"), "chunk_id", "left_anti")
            return self._write({"vectors": (rest.unionByName(new), self._touched("vectors", new))})

    def embed(self, factory) -> int:
        """Give every chunk a vector by the embedder that FACTORY makes; returns how many were missing.

        Another model than the index's drops the vectors first. Chunks with null content have none.
        """
        model = factory()
        self.set_model(model.id, model.dim)
        new = cut(V.embed(self.backlog(), factory))
        n = new.count()
        if n:
            self.put_vectors(new)
        return n

    def vacuum(self) -> list[str]:
        """Delete generation folders that the manifest no longer names; readers of older manifests must be done."""
        with self._writing():
            used = {f"gen-{g}" for at in self.manifest().at.values() for g in at.values()}
            gone = sorted(n for n in self.folder.names("") if n.startswith("gen-") and n not in used)
            for n in gone:
                self.folder.delete(n)
            return gone
