"""An append-only mutation log in Parquet: records and edges with a logical clock, named memories, compaction.

Statements take DataFrames, or Python rows for a few. Changes are appended to one folder that nothing rewrites, so streams over
it go on; pruning writes a base beside it, valid once Spark has marked it complete. A record's body is a map of tagged
values, so tables need no schema. Reading current or past state is a Spark job; the driver keeps the clocks, the tables'
dimensions and the horizons alone. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import BODY, tag_body
from tessera.operators import temporal
from tessera.stored import stored

SCHEMA = (
    T.StructType().add("mem", "string").add("ts", "long").add("kind", "string").add("tbl", "string").add("id", "string").add("body", BODY)
    .add("json", "string").add("embedding", T.ArrayType(T.FloatType())).add("src", "string").add("dst", "string").add("name", "string").add("weight", "float").add("dim", "integer")
)
BUILT_IN = ("global", "meta")  # fixed values: tables that exist without a declaration
_BODY_TYPE = pa.map_(pa.string(), pa.struct([("t", pa.int32()), ("s", pa.string()), ("k", pa.binary())]))


class UnknownTable(ValueError):
    pass


class DimensionMismatch(ValueError):
    pass


def _bodies(df: DataFrame, kept: list[str]) -> DataFrame:
    """kept, body and json: the other columns of each row as a document, in parallel. A null is an absent key."""
    others = [c for c in df.columns if c not in kept]
    fields = [f for f in df.schema.fields if f.name in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{k: v for k, v in r.items() if v is not None} for r in batch.select(others).to_pylist()] if others else [{}] * batch.num_rows
            bodies = [[(k, dict(zip("tsk", x, strict=True))) for k, x in tag_body(r).items()] for r in rows]
            columns = [*(batch.column(c) for c in kept), pa.array(bodies, _BODY_TYPE), pa.array([json.dumps(r, sort_keys=True) for r in rows])]
            yield pa.record_batch(columns, [*kept, "body", "json"])

    ordered = T.StructType([next(f for f in fields if f.name == c) for c in kept]).add("body", BODY).add("json", "string")
    return df.select(*(f"`{c}`" for c in [*kept, *others])).mapInArrow(run, ordered)


def _pulled_weight(weight: float | None, props: dict) -> tuple[float | None, dict]:
    """A numeric property called weight, in any case, is the edge's weight."""
    for key, value in list(props.items()):
        if key.lower() == "weight" and isinstance(value, (int, float)) and not isinstance(value, bool):
            weight, props = float(value), {k: v for k, v in props.items() if k != key}
    return weight, props


class MutationLog:
    """path: a folder Spark can write; an existing log is read on from its last mutation.

    Table names are known to all memories once declared; dimensions, records, edges, clock and horizon are a memory's own.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.mem = spark, path.rstrip("/"), ""
        self.clock: dict[str, int] = {}
        self.horizon: dict[str, int] = {}
        self.dims: dict[tuple[str, str], int | None] = {}
        self.declared: set[str] = set(BUILT_IN)
        self.base: int | None = None
        self._open()

    def _folder(self) -> str:
        """Where changes are appended."""
        return f"{self.path}/changes"

    def _files(self, path: str) -> list[str]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in store.listStatus(folder)] if store.exists(folder) else []

    def _bases(self) -> list[int]:
        return sorted(int(n[5:]) for n in self._files(self.path) if n.startswith("base-"))

    def _base_folder(self, number: int) -> str:
        return f"{self.path}/base-{number:06d}"

    def _open(self) -> None:
        """The last base that is complete counts; one that a lost job left behind doesn't."""
        whole = [n for n in self._bases() if "_SUCCESS" in self._files(self._base_folder(n))]
        self.base = whole[-1] if whole else None
        if self.base is not None:
            marks = self.spark.read.schema(SCHEMA).parquet(self._base_folder(self.base)).where("kind = 'SNAPSHOT'")
            self.horizon = {r.mem: r.ts for r in marks.select("mem", "ts").collect()}  # a row a memory
        log = self.mutations()
        self.clock = {r.mem: r.ts for r in log.groupBy("mem").agg(F.max("ts").alias("ts")).collect()}  # a row a memory
        for r in log.where("kind = 'CREATE'").groupBy("mem", "tbl").agg(F.max_by("dim", "ts").alias("dim")).collect():  # a row a table
            self.dims[r.mem, r.tbl] = r.dim
            self.declared.add(r.tbl)

    def memory(self, name: str = "") -> MutationLog:
        """Later calls work in the named memory; the empty name is the root."""
        self.mem = name
        return self

    def _after_horizon(self) -> Column:
        pruned = F.lit(True)
        for mem, horizon in self.horizon.items():
            pruned = pruned & ((F.col("mem") != mem) | (F.col("ts") > horizon))
        return pruned

    def mutations(self) -> DataFrame:
        """The log as it reads now: the base, and the changes after each memory's horizon."""
        empty = self.spark.createDataFrame([], SCHEMA)
        changes = self.spark.read.schema(SCHEMA).parquet(self._folder()) if self._files(self._folder()) else empty
        if self.base is None:
            return changes
        return self.spark.read.schema(SCHEMA).parquet(self._base_folder(self.base)).unionByName(changes.where(self._after_horizon()))

    def _write(self, df: DataFrame) -> None:
        df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA)).write.mode("append").parquet(self._folder())

    def _append_rows(self, rows: list[dict]) -> None:
        """A few rows, as one file."""
        clock, out = self.clock.get(self.mem, 0), []
        for k, r in enumerate(rows):
            out.append(tuple(({"mem": self.mem, "ts": clock + 1 + k} | r).get(f.name) for f in SCHEMA))
        self._write(self.spark.createDataFrame(out, SCHEMA).coalesce(1))
        self.clock[self.mem] = clock + len(rows)

    def _append(self, df: DataFrame) -> None:
        """Any number of rows, in parallel; times follow the order of df. A row's time is the clock, the rows of the partitions
        before its own, and its place in that: monotonically_increasing_id() holds partition and place."""
        staged = stored(df.withColumn("_at", F.monotonically_increasing_id()), "staged")
        part = F.shiftright("_at", 33)
        counts = sorted((r[0], r[1]) for r in staged.groupBy(part.alias("part")).count().collect())  # a row a partition
        starts, clock = [], self.clock.get(self.mem, 0)
        for p, n in counts:
            starts.append((p, clock))
            clock += n
        if starts:
            place = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
            timed = staged.join(F.broadcast(self.spark.createDataFrame(starts, "_part long, _start long")), part == F.col("_part"))
            self._write(timed.withColumn("mem", F.lit(self.mem)).withColumn("ts", F.col("_start") + place + 1))
            self.clock[self.mem] = clock

    def create_table(self, name: str, dim: int | None = None) -> None:
        if dim is not None and dim <= 0:
            raise ValueError("a vector dimension is positive")
        self._append_rows([{"kind": "CREATE", "tbl": name, "dim": dim}])
        self.dims[self.mem, name] = dim
        self.declared.add(name)

    def insert(self, tbl: str, rows: list[tuple] | DataFrame) -> None:
        """rows: (id, body) or (id, body, embedding), or a DataFrame with columns id, perhaps embedding, and the body's keys.

        A row replaces the record of its id whole; of rows with one id the later counts. Nothing is written if a table is
        unknown or an embedding has the wrong length. Null columns of a DataFrame are absent keys; its rows need an id.
        """
        if tbl not in self.declared:
            raise UnknownTable(tbl)
        dim = self.dims.get((self.mem, tbl))
        if isinstance(rows, DataFrame):
            self._insert_frame(tbl, rows, dim)
            return
        made = []
        for rid, body, *rest in rows:
            vector = rest[0] if rest else None
            if vector is not None and dim is not None and len(vector) != dim:
                raise DimensionMismatch(f"{tbl}:{rid} has {len(vector)} dimensions, the table {dim}")
            made.append({"kind": "INSERT", "tbl": tbl, "id": f"{tbl}:{rid}", "body": tag_body(body), "json": json.dumps(body, sort_keys=True), "embedding": vector})
        self._append_rows(made)

    def _insert_frame(self, tbl: str, rows: DataFrame, dim: int | None) -> None:
        kept = ["id", *(["embedding"] if "embedding" in rows.columns else [])]
        wrong = F.col("id").isNull()
        if dim is not None and len(kept) > 1:
            wrong = wrong | (F.size("embedding") != dim) & F.col("embedding").isNotNull()
        if bad := rows.where(wrong).select("id").head(1):
            if bad[0].id is None:
                raise ValueError("a record needs an id")
            raise DimensionMismatch(f"{tbl}:{bad[0].id} has not the table's {dim} dimensions")
        made = _bodies(rows, kept).withColumn("id", F.concat(F.lit(f"{tbl}:"), F.col("id").cast("string")))
        if len(kept) > 1:
            made = made.withColumn("embedding", F.col("embedding").cast("array<float>"))
        self._append(made.withColumn("kind", F.lit("INSERT")).withColumn("tbl", F.lit(tbl)))

    def relate(self, src: str, name: str, dst: str, weight: float | None = None, **props) -> None:
        """An edge between records that need not exist yet. A numeric property called weight, in any case, is its weight."""
        weight, props = _pulled_weight(weight, props)
        self._append_rows([{"kind": "RELATE", "src": src, "dst": dst, "name": name.lstrip(":"), "weight": weight, "body": tag_body(props), "json": json.dumps(props, sort_keys=True)}])

    def relate_all(self, edges: DataFrame) -> None:
        """An edge a row: display ids src and dst, name, perhaps weight (in any case); other columns are properties."""
        heavy = [c for c in edges.columns if c.lower() == "weight"]
        kept = ["src", "dst", "name", *(["weight"] if heavy else [])]
        edges = edges.withColumnRenamed(heavy[0], "weight") if heavy else edges
        made = _bodies(edges, kept).withColumn("name", F.ltrim(F.col("name"), F.lit(":")))
        made = made.withColumn("weight", F.col("weight").cast("float")) if heavy else made
        self._append(made.withColumn("kind", F.lit("RELATE")))

    def forget(self, rid: str | DataFrame) -> None:
        """A display id, or a DataFrame with a column id of them; ids that no record has are logged too."""
        if isinstance(rid, DataFrame):
            self._append(rid.select(F.col("id").cast("string").alias("id"), F.lit("FORGET").alias("kind")))
        else:
            self._append_rows([{"kind": "FORGET", "id": rid}])

    def _checked(self, since: int | None) -> DataFrame:
        if since is not None:
            temporal.check_horizon(since, self.horizon.get(self.mem))
        return self.mutations().where(F.col("mem") == self.mem)

    def records(self, tbl: str | None = None, as_of: int | None = None) -> DataFrame:
        """Current or past records: id, tbl, body, json, embedding, created_at."""
        if tbl is not None and tbl not in self.declared:
            raise UnknownTable(tbl)
        live = temporal.records_as_of(self._checked(as_of).where("kind in ('INSERT', 'FORGET')"), ["tbl", "body", "json", "embedding"], as_of)
        return live if tbl is None else live.where(F.col("tbl") == tbl)

    def edges(self, as_of: int | None = None) -> DataFrame:
        """Current or past edges: seq, src, dst, name, weight, body, json; seq is the append order."""
        return temporal.edges_as_of(self._checked(as_of), as_of).select(F.col("ts").alias("seq"), "src", "dst", "name", "weight", "body", "json")

    def history(self, since: int) -> DataFrame:
        return temporal.history_since(self._checked(since), since, ["tbl", "dim", "id", "src", "dst", "name"])

    def prune(self) -> None:
        """Writes a base with the declarations and what is live of each memory as of its clock, in one job. Until Spark marks it
        complete the log reads as before, and a failed attempt is never read. Changes stay where they are, unread up to the horizons."""
        if not self.clock:
            return
        marks = self.spark.createDataFrame([(mem, ts, "SNAPSHOT") for mem, ts in self.clock.items()], "mem string, ts long, kind string")
        live, _ = temporal.compact(self.mutations().where("kind <> 'SNAPSHOT'"), ("mem",))
        number = max([0, *self._bases()]) + 1
        live.select(*SCHEMA.names).unionByName(marks, allowMissingColumns=True).select(*SCHEMA.names).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._base_folder(number))
        self.base, self.horizon = number, dict(self.clock)
