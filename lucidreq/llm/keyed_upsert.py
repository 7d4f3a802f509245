"""Copy-on-write upsert of a keyed table that lies in sorted Parquet files.

The table is a folder of files with at most ``max_rows`` rows each, sorted by the
key over all files. A key's home is the last file that begins at or below it.
An upsert

1. finds the homes that changes go to, and reads only those files,
2. replays the changes on them: a shuffled hash join of rows and changes on the key,
3. compares each home before and after by an ordered SHA-256 of its rows (each
   column tagged null or value, with its length), built as a tree: rows by
   stretches of the key, stretches by longer ones, so no group is large,
4. writes the homes that differ anew, cut by the rows' ranks, small neighbours
   merged, in files beside the untouched ones, and deletes what they replace.

Ranks come from ranges that are sorted apart and offset by the earlier ranges'
sizes. What the driver and broadcasts hold is a row for each file; the number of
files is bounded by the layout (``FILES`` starting files at most), whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.redundancy import numbered
from .common import free_names, materialize, scratch_path, table

#: The starting files of a table are as many at most.
FILES = 1000
#: Keys of a stretch (and stretches of the next longer one) of the digest's tree: 2 to this power.
STRETCH = 10


@dataclass
class Layout:
    """Where a table's files lie: ``path``, the key, rows of a file at most, the table's columns."""

    path: str
    key: str
    max_rows: int
    schema: T.StructType


def rows_per_file(n: int, files: int = FILES) -> int:
    return 1 + n // files


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Data files of the folder, in order of name; as many as the table has."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(str(x.getPath()) for x in found if x.getPath().getName().startswith("part-"))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)


def _at(path: Column) -> Column:
    """A file's place in the write that made it, from its name."""
    return F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).cast("int")


def create(rows: DataFrame, key: str, max_rows: int) -> Layout:
    """Write ``rows`` sorted by the key (an integer), ``max_rows`` in each file but the last, to a new shared folder.

    Rows with a null key have no place and are left out; rows that repeat a key
    stay, next to each other. An empty table has no data files.
    """
    spark = rows.sparkSession
    out = Layout(scratch_path(spark, "upsert"), key, max_rows, rows.schema)
    (place,) = free_names(rows, ["place"])
    own = numbered(rows.where(F.col(f"`{key}`").isNotNull()), place, F.col(f"`{key}`"))
    own = own.withColumn(place, F.floor(F.col(place) / max_rows).cast("int"))
    last = own.agg(F.max(place)).first()[0]
    # A task for each file, in the files' order.
    own.repartitionById((last or 0) + 1, F.col(place)).sortWithinPartitions(f"`{key}`").drop(place).write.parquet(out.path)
    if last is None:
        _delete(spark, _listed(spark, out.path))
    return out


def read(spark: SparkSession, layout: Layout) -> DataFrame:
    return spark.read.schema(layout.schema).parquet(layout.path)


def ends(spark: SparkSession, layout: Layout) -> list[tuple[int, int, int]]:
    """(file, first key, last key) of every file, in order; as many as the table has files."""
    rows = read(spark, layout).select(_at(F.col("_metadata.file_path")).alias("file"), F.col(f"`{layout.key}`").alias("k"))
    return sorted(tuple(r) for r in rows.groupBy("file").agg(F.min("k"), F.max("k")).collect())


def home_of(files: list[tuple[int, int, int]]) -> Callable[[Column], Column]:
    """The home of a key: the last file that begins at or below it, else the first."""
    numbers, firsts = np.array([f[0] for f in files]), np.array([f[1] for f in files])

    @F.pandas_udf("int")
    def home(keys: pd.Series) -> pd.Series:
        return pd.Series(numbers[np.maximum(np.searchsorted(firsts, keys.to_numpy(), side="right") - 1, 0)])

    return home


def tagged(df: DataFrame, columns: list[str], row: str) -> Column:
    """SHA-256 of the columns of struct ``row``: each as N, or V with its length and value, so null and any value differ."""
    parts = []
    for c in columns:
        v, kind = F.col(row)[c], df.schema[row].dataType[c].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            v = v + F.lit(0.0).cast(kind)  # -0.0 equals 0.0
        if isinstance(kind, (T.TimestampType,)):
            v = F.unix_micros(v)  # whatever the session's zone
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            v = F.to_json(v, {"ignoreNullFields": "false"})
        s = v.cast("string")
        parts.append(F.when(v.isNull(), F.lit("N")).otherwise(F.concat(F.lit("V"), F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def home_digests(rows: DataFrame) -> DataFrame:
    """home, b, a: the ordered digest of a home's rows before and after, from rows with home, k and the row's digests b and a (null: no such row).

    A tree of stretches of the key, the same for both: a level gathers at most
    2^STRETCH keys, then stretches, in a group. A home without rows has null.
    """

    def ordered(side: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("at", F.col(side).alias("d")))))
        return F.when(F.count(side) > 0, F.sha2(F.array_join(F.transform(listed, lambda x: x["d"]), "").cast("binary"), 256)).alias(side)

    level = rows.select("home", F.col("k").cast("long").alias("at"), "b", "a")
    for _ in range(0, 64, STRETCH):
        level = level.groupBy("home", F.shiftright("at", STRETCH).alias("up")).agg(ordered("b"), ordered("a"))
        level = materialize(level.select("home", F.col("up").alias("at"), "b", "a"), "upsert-digests")
        if level.agg((F.count(F.lit(1)) == F.count_distinct("home")).alias("one")).first().one:
            break
    # Keys of either sign end in two stretches.
    return level.groupBy("home").agg(ordered("b"), ordered("a"))


def pieces_of(sizes: list[tuple[int, int | None]], max_rows: int) -> list[tuple[int, int, int]]:
    """(home, piece, target) of the homes that are written anew.

    ``sizes``: in order, each file's home and its rows after the replay (None where
    the file stays). A home is cut into the fewest pieces, sizes one apart at most,
    larger first; then each piece joins its remaining left neighbour if that is new
    too and both fit into a file.
    """
    out, target, size = [], -1, None  # size: rows of the left neighbour if it is new
    for home, n in sizes:
        if n is None:
            size = None
            continue
        cuts = -(-n // max_rows)
        for k in range(cuts):
            own = n // cuts + (k < n % cuts)
            if size is not None and size + own <= max_rows:
                size += own
            else:
                target, size = target + 1, own
            out.append((home, k, target))
    return out


def _replayed(spark: SparkSession, layout: Layout, changes: DataFrame, files: list[tuple[int, int, int]], paths: dict[int, str], columns: list[str]) -> DataFrame:
    """home, k, row (null if deleted), b and a (digests of the row before and after) of the homes that ``changes`` (home, k, new, do) go to."""
    goes = {r.home for r in changes.select("home").distinct().collect()}  # a row for a file at most
    # A key that fills its file's end and the next one's beginning is looked for in both.
    for (file, _, last), (after, first, _) in reversed(list(zip(files, files[1:], strict=False))):
        if after in goes and last == first:
            goes.add(file)
    base = spark.read.schema(layout.schema).parquet(*[paths[h] for h in sorted(goes)])
    before = base.select(_at(F.col("_metadata.file_path")).alias("file"), F.col(f"`{layout.key}`").alias("k"), F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("old"))
    met = before.hint("shuffle_hash").join(changes.withColumnRenamed("home", "goes"), "k", "full_outer")
    old = lambda c: F.col("old")[c]
    changed = F.struct(*[(F.col("k") if c == layout.key else F.col("new")[c] if c in columns else old(c)).alias(c) for c in base.columns])
    after = F.when(F.col("do").isNull(), F.col("old")).when(F.col("do") == "set", changed)
    rows = met.select(F.coalesce("file", "goes").alias("home"), "k", "old", after.alias("row"))
    digest = lambda r: F.when(F.col(r).isNotNull(), tagged(rows, base.columns, r))
    return materialize(rows.select("home", "k", "row", digest("old").alias("b"), digest("row").alias("a")), "upsert-replayed")


def upsert(spark: SparkSession, layout: Layout, changes: DataFrame, action: Callable[[Column, Column], Column], columns: list[str]) -> list[str]:
    """Apply ``changes`` to the table; returns the new files' paths.

    changes: one row for each key (column named as the key, rows with a null key
    are left out); ``columns`` are a row's new values, nulls too. action(first, change) says
    from the first key of the home and the change (a struct) what is done: 'set' (also inserts an absent key,
    with the other columns null), 'delete', or null for nothing. A key that the table repeats is
    set or deleted in all its rows. A table without files has no homes and takes
    nothing. Files whose rows stay the same aren't touched. New files are complete
    before those that they replace are deleted.
    """
    files = ends(spark, layout)
    if not files:
        return []
    paths = {int(p.rsplit("/part-", 1)[1].split("-")[0]): p for p in _listed(spark, layout.path)}
    firsts = F.broadcast(spark.createDataFrame([f[:2] for f in files], f"home int, first {layout.schema[layout.key].dataType.simpleString()}"))
    values = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None).cast("string")
    own = changes.select(F.col(f"`{layout.key}`").alias("k"), values.alias("new"), F.struct(*[F.col(f"`{c}`") for c in changes.columns]).alias("change"))
    own = own.where("k is not null").withColumn("home", home_of(files)(F.col("k"))).join(firsts, "home")
    own = own.select("home", "k", "new", action(F.col("first"), F.col("change")).alias("do")).where("do is not null")
    own = materialize(own, "upsert-changes")
    if own.isEmpty():
        return []
    rows = _replayed(spark, layout, own, files, paths, columns)
    other = home_digests(rows.select("home", "k", "b", "a")).where("not (b <=> a)").select("home")
    # A row for a file at most, in the broadcast as on the driver.
    differ = {r.home: r.n for r in rows.join(F.broadcast(other), "home").groupBy("home").agg(F.count("a").alias("n")).collect()}
    pieces = pieces_of([(f[0], differ.get(f[0])) for f in files], layout.max_rows)
    if pieces:
        kept = rows.where(F.col("row").isNotNull() & F.col("home").isin(list(differ))).select("home", "k", "row")
        ranked = numbered(kept, "place", F.col("home"), F.col("k"))
        spans = ranked.groupBy("home").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
        spans = spans.withColumn("cuts", F.ceil(F.col("n") / layout.max_rows)).withColumn("small", F.floor(F.col("n") / F.col("cuts"))).withColumn("more", F.col("n") % F.col("cuts"))
        wide, r = F.col("more") * (F.col("small") + 1), F.col("place") - F.col("start")
        piece = F.when(r < wide, F.floor(r / (F.col("small") + 1))).otherwise(F.col("more") + F.floor((r - wide) / F.col("small"))).cast("long")
        to = spark.createDataFrame(pieces, "home int, piece long, target int")
        dealt = ranked.join(F.broadcast(spans), "home").withColumn("piece", piece).join(F.broadcast(to), ["home", "piece"])
        dealt.repartitionById(pieces[-1][2] + 1, F.col("target")).sortWithinPartitions("home", "k").select("row.*").write.mode("append").parquet(layout.path)
    new = sorted(set(_listed(spark, layout.path)) - set(paths.values()))
    _delete(spark, [paths[h] for h in differ])
    return new


def joined_digests(rows: DataFrame, schema: str, sums: list[str]) -> DataFrame:
    """A row for each file of ``rows`` (file, id, and columns to sum; each file's rows in order in one task): first id, rows, sums, SHA-256 of the joined ids.

    A file is read as a stream; what is held is one hash and the sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            data = batch.to_pandas()
            for path, part in data.groupby("path", sort=False):
                if now is None or now[0] != path:
                    now = [path, int(part["id"].iloc[0]), 0, [0] * len(sums), hashlib.sha256()]
                    out.append(now)
                ids = ",".join(map(str, part["id"]))
                now[4].update((("," if now[2] else "") + ids).encode())
                now[2] += len(part)
                now[3] = [a + int(part[c].sum()) for a, c in zip(now[3], sums, strict=True)]
        if out:
            yield pa.RecordBatch.from_pylist([{"path": p, "first_id": f, "n_rows": n, **dict(zip(sums, s, strict=True)), "ids_sha256": h.hexdigest()} for p, f, n, s, h in out])

    return rows.mapInArrow(run, schema)


def report(spark: SparkSession, layout: Layout, new: list[str], cents: Column, crc: Column) -> DataFrame:
    """Each data file as it is read back: first_id, n_rows, sums of ``cents`` and ``crc``, ids_sha256, columns, path, rewritten."""
    there = _listed(spark, layout.path)
    schema = "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string"
    if not there:
        return spark.createDataFrame([], schema + ", columns string, rewritten boolean").select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", "columns", "path", "rewritten")
    back = spark.read.parquet(layout.path)
    places = spark.createDataFrame([(p, k) for k, p in enumerate(there)], "path string, task int")
    rows = back.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), F.col(f"`{layout.key}`").cast("long").alias("id"), cents.alias("cents"), crc.alias("rows_crc"))
    # Each file to a task of its own, by a row for each file.
    dealt = rows.join(F.broadcast(places), "path").repartitionById(len(there), F.col("task")).sortWithinPartitions("at").select("path", "id", "cents", "rows_crc")
    out = joined_digests(dealt, schema, ["cents", "rows_crc"])
    rewritten = F.col("path").isin(new) if new else F.lit(False)
    return out.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(back.columns)).alias("columns"), "path", rewritten.alias("rewritten"))


def _crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def latest(changes: DataFrame) -> DataFrame:
    """Each client's change with the highest seq, then change_id (nulls lowest); rows equal in both go by their values."""
    order = ["seq", "change_id", "op", "source", "segment", "city", "balance"]
    won = changes.where("client_id is not null").groupBy("client_id").agg(F.max(F.struct(*order)).alias("w"))
    return won.select("client_id", "w.*")


def client_action(first: Column, change: Column) -> Column:
    """The contract's rule: homes with h > 7 take nothing, deletes by op or by the change's hash."""
    h = F.pmod(_crc(first), F.lit(16))
    gone = F.coalesce(change["op"] == "D", F.lit(False)) | F.coalesce(F.pmod(_crc(change["change_id"]), F.lit(8)) < h, F.lit(False))
    return F.when(h <= 7, F.when(gone, F.lit("delete")).otherwise(F.lit("set")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the changes of ``client_changes`` applied to a table made of ``clients``; a row for each data file."""
    clients = table(spark, sf_dir, "clients")
    layout = create(clients.where(F.pmod(_crc(F.col("client_id")), F.lit(7)) > 3), "client_id", rows_per_file(clients.count()))
    new = upsert(spark, layout, latest(table(spark, sf_dir, "client_changes")), client_action, ["source", "segment", "city", "balance"])
    # A balance that is no number counts as null.
    balance = F.when(~F.isnan("balance"), F.col("balance"))
    cents = F.coalesce(F.floor(F.lit(100.0) * balance + 0.5).try_cast("long"), F.lit(0)).cast("long")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return report(spark, layout, new, cents, F.crc32(F.concat_ws("|", text("source"), text("segment"), text("city")).cast("binary")))
