"""JSON arrays read by many tasks, however large the file.

Spark's text reader cuts a file after any ``}``, so one array is read by as many tasks as its size asks for. Whether a
piece begins inside a string, and how deep in brackets, follows from what precedes it: every piece says what it does to both
(for either answer to the first question), and sums over these few numbers in the file's order give each piece its place. Then every
piece yields its whole top-level objects; objects that reach over pieces are put together by the piece that they begin in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Bytes a piece holds at least (the last one of a split may be smaller, one with a longer record larger).
PIECE_BYTES = 4_000_000

_PIECES = ("path string, start long, piece long, data binary, base int, flips int, "
           "rise_out long, rise_in long, low_out long, low_in long")
_OBJECTS = "path string, owner long, nr long, json binary"


def _brackets():
    """The function that finds a piece's brackets: where, +1 or -1, whether an odd number of quotes precedes, and how many quotes there are."""
    import re

    import numpy as np

    escape = re.compile(rb"\\.", re.S)
    kind = np.zeros(256, dtype=np.int8)
    kind[[ord(c) for c in "{["]], kind[[ord(c) for c in "}]"]], kind[ord('"')] = 1, -1, 2

    def find(data):
        kinds = kind[np.frombuffer(escape.sub(b"  ", data), dtype=np.uint8)]
        at = np.flatnonzero(kinds)
        kinds = kinds[at].astype(np.int64)
        quotes = np.cumsum(kinds == 2)
        bracket = kinds != 2
        return at[bracket], kinds[bracket], (quotes[bracket] & 1).astype(bool), int(quotes[-1]) if len(quotes) else 0
    return find


def _cut(piece_bytes: int):
    """Records of the text reader -> pieces, with what each does to the place in the file. Workers import nothing of this package."""
    find = _brackets()

    def run(batches):
        import pyarrow as pa

        key, number, held, room = None, 0, [], 0

        def piece():
            data = b"".join(held)
            base = None
            if key[1] == 0 and number == 0:
                data = data.removeprefix(b"\xef\xbb\xbf")
                base = int(data.lstrip()[:1] == b"[")
            _, step, odd, quotes = find(data)
            sums = [(step * outside).cumsum() for outside in (~odd, odd)]
            return pa.RecordBatch.from_pylist([{
                "path": key[0], "start": key[1], "piece": number, "data": data, "base": base, "flips": quotes & 1,
                "rise_out": int(sums[0][-1]) if len(step) else 0, "rise_in": int(sums[1][-1]) if len(step) else 0,
                "low_out": min(0, int(sums[0].min())) if len(step) else 0, "low_in": min(0, int(sums[1].min())) if len(step) else 0}],
                schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("piece", pa.int64()), ("data", pa.binary()), ("base", pa.int32()),
                                  ("flips", pa.int32()), ("rise_out", pa.int64()), ("rise_in", pa.int64()), ("low_out", pa.int64()), ("low_in", pa.int64())]))

        for batch in batches:
            for path, start, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (path, start) != key or room >= piece_bytes:
                    if held:
                        yield piece()
                    number = number + 1 if (path, start) == key else 0
                    key, held, room = (path, start), [], 0
                held += [value, b"}"]
                room += len(value) + 1
        if held:
            yield piece()
    return run


def _objects(whole: bool):
    """Pieces with their places -> their whole objects, or else the parts of objects that reach over pieces."""
    find = _brackets()

    def run(batches):
        import re

        import pyarrow as pa

        between = re.compile(rb"[\s,\[\]}]*")
        out_schema = pa.schema([("path", pa.string()), ("owner", pa.int64()), ("nr", pa.int64()), ("json", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                data, base = r["data"], r["base"]
                at, step, odd, _ = find(data)
                outside = odd if r["inside"] else ~odd
                at, step = at[outside], step[outside]
                level = r["depth"] + step.cumsum()
                begins = at[(step == 1) & (level == base + 1)].tolist()
                ends = (at[(step == -1) & (level == base)] + 1).tolist()
                parts, last = [], 0
                if r["depth"] > base:
                    last = ends.pop(0) if ends else len(data)
                    parts.append((r["owner"], data[:last]))
                for i, begin in enumerate(begins):
                    if not between.fullmatch(data, last, begin):
                        raise ValueError(f"{r['path']}: only objects may stand at the top of the file or array")
                    last = ends[i] if i < len(ends) else len(data)
                    parts.append((None if i < len(ends) else r["nr"], data[begin:last]))
                if not between.fullmatch(data, last):
                    raise ValueError(f"{r['path']}: only objects may stand at the top of the file or array")
                rows = [{"path": r["path"], "owner": o, "nr": r["nr"], "json": j} for o, j in parts if (o is None) == whole]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out_schema)
    return run


def piece_places(pieces: DataFrame) -> DataFrame:
    """Each piece's number in its file (``nr``), whether it begins inside a string, its depth, the file's own depth of objects (``base``) and
    the piece in which an object open at its begin begins (``owner``). Only these numbers are shuffled, no text. A file whose brackets or strings do not close is an error."""
    in_file = Window.partitionBy("path").orderBy("start", "piece")
    before, file = in_file.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    places = pieces.select("path", "start", "piece", F.row_number().over(in_file).cast("long").alias("nr"), F.max("base").over(file).alias("base"), "flips",
                           (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1).alias("inside"), "rise_out", "rise_in", "low_out", "low_in")
    places = (places.withColumn("rise", F.when(F.col("inside"), F.col("rise_in")).otherwise(F.col("rise_out")))
              .withColumn("low", F.when(F.col("inside"), F.col("low_in")).otherwise(F.col("low_out")))
              .withColumn("depth", F.coalesce(F.sum("rise").over(before), F.lit(0)))
              .withColumn("owner", F.max(F.when(F.col("depth") + F.col("low") <= F.col("base"), F.col("nr"))).over(before))
              .withColumn("total", F.sum("rise").over(file)).withColumn("quotes", F.sum("flips").over(file)))
    # The reader does not tell whether the last record ended in a bracket; one more is taken for granted there.
    closes = (F.col("quotes") % 2 == 0) & ((F.col("total") == -1) | ((F.col("total") == 0) & (F.col("base") == 0)))
    fail = F.raise_error(F.concat(F.col("path"), F.lit(" is no whole JSON text: a bracket or a string does not close")))
    return places.where(F.when(closes, F.lit(True)).otherwise(fail)).select("path", "start", "piece", "nr", "base", "inside", "depth", "owner")


def read_json_arrays(spark: SparkSession, path, schema: T.StructType, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row of ``schema`` for each object of the JSON array in every file of ``path`` (a file, a folder or a list), as ``multiLine`` reads them.

    A file may also hold one object, or several after each other; an empty file or array has no row. Absent keys and explicit
    nulls are NULL; an object or array in a string column is its text without white space between tokens. Raises an error for a file whose brackets or strings do not close (the
    reader cannot tell whether just the last bracket of a file outside an array is there), and for numbers, strings or literals among the objects.
    Files are UTF-8, with or without a byte-order mark; compressed ones are read too, by one task each.
    The pieces are written once below the shared scratch folder, so that executors that reread them agree on where they are cut.
    """
    records = spark.read.option("lineSep", "}").text(path)
    cut = scratch_path(spark, "json-pieces")
    (records.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
     .mapInArrow(_cut(piece_bytes), _PIECES).write.parquet(cut))
    pieces = spark.read.schema(_PIECES).parquet(cut)
    placed_at = scratch_path(spark, "json-places")
    places = piece_places(pieces.drop("data"))
    places.write.parquet(placed_at)
    placed = (pieces.select("path", "start", "piece", "data")
              .join(spark.read.schema(places.schema).parquet(placed_at), ["path", "start", "piece"]))
    parts = placed.mapInArrow(_objects(False), _OBJECTS)
    joined = (parts.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("nr", "json"))).alias("parts"))
              .select(F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["json"])).alias("json")))
    objects = placed.mapInArrow(_objects(True), _OBJECTS).select("json").unionAll(joined)
    return objects.select(F.from_json(F.col("json").cast("string"), schema).alias("r")).select("r.*")
