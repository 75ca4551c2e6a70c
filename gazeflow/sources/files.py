"""Reading recordings: delimited text, JSON lines, key-value headers, binary timestamps, directory indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeflow.series import nan_to_null


def read_delimited(spark: SparkSession, path: str, schema: str, *, sep: str = ",", trim: bool = False) -> DataFrame:
    """A headed CSV, TSV or space-separated file with a declared schema; NaN becomes null. A row that doesn't fit has nulls."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", trim).option("nanValue", "NaN").csv(path)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(nan_to_null(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns))


#: Wearable gaze and motion lines.
GAZE_SCHEMA = "timestamp double, type string, data struct<gaze2d: array<double>, gaze3d: array<double>, eyeleft: struct<gazeorigin: array<double>, gazedirection: array<double>, pupildiameter: double>, eyeright: struct<gazeorigin: array<double>, gazedirection: array<double>, pupildiameter: double>>"
IMU_SCHEMA = "timestamp double, type string, data struct<accelerometer: array<double>, gyroscope: array<double>, magnetometer: array<double>>"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, also gzipped, with a declared schema. What a line lacks is null."""
    return spark.read.schema(schema).json(path)


def flat_vectors(df: DataFrame, prefix: str = "data", name: str = "") -> DataFrame:
    """Fields of a struct as columns, dotted names joined by `_`, arrays of three (or two) as name_0, name_1, ..."""
    out: list[Column] = [F.col(c) for c in df.columns if c != prefix]

    def walk(path: str, flat: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{path}.{f.name}", f"{flat}_{f.name}".strip("_"), f.dataType)
        elif isinstance(kind, T.ArrayType):
            for i in range(2 if path.endswith("2d") else 3):
                out.append(F.get(F.col(path), F.lit(i)).alias(f"{flat}_{i}"))
        else:
            out.append(F.col(path).alias(flat))

    walk(prefix, name, df.schema[prefix].dataType)
    return df.select(*out)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, kv (map). Lines `name, value` or `name: value`; the last of equal names counts; other lines don't."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    pairs = F.expr("filter(transform(split(value, '\\r?\\n'), x -> regexp_extract_all(x, '^([^:,]+?)(?:, |: )(.*)$', 0)), x -> size(x) > 0)")
    line = F.explode_outer(pairs)
    one = text.select("path", line.alias("m")).select("path", F.element_at("m", 1).alias("x"))
    one = one.select("path", F.regexp_extract("x", "^([^:,]+?)(?:, |: )", 1).alias("k"), F.regexp_extract("x", "^[^:,]+?(?:, |: )(.*)$", 1).alias("v"), F.monotonically_increasing_id().alias("i"))
    last = one.where("k IS NOT NULL AND k <> ''").groupBy("path", "k").agg(F.max_by("v", "i").alias("v"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("kv"))


def extract_headers(text: Column, patterns: dict[str, str], numbers: tuple[str, ...] = ()) -> list[Column]:
    """A column for each pattern's first group; '' is null, numbers are doubles or null."""
    found = {n: F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for n, p in patterns.items()}
    return [(c.try_cast("double") if n in numbers else c).alias(n) for n, c in found.items()]


#: First byte of a timestamp file: type of its little-endian values.
TIMESTAMP_TYPES = {0: "<u8", 1: "<f8", 2: "<u4", 3: "<f4"}


def decode_timestamps(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, float)
    if raw[0] not in TIMESTAMP_TYPES:
        raise ValueError(f"unknown timestamp type {raw[0]}")
    kind = np.dtype(TIMESTAMP_TYPES[raw[0]])
    body = raw[1 : 1 + (len(raw) - 1) // kind.itemsize * kind.itemsize]
    return np.frombuffer(body, kind).astype(float)


def read_timestamps(spark: SparkSession, path: str, timebase_hz: float) -> DataFrame:
    """path, idx, raw, sec = raw / timebase of binary timestamp files; an unended last value is left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                raw = decode_timestamps(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(raw), pa.string()), pa.array(np.arange(len(raw))), pa.array(raw), pa.array(raw / timebase_hz)], ["path", "idx", "raw", "sec"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(each, "path string, idx long, raw double, sec double")


def with_line_times(lines: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th line (column line_no) of a file gets the n-th timestamp (idx, sec); lines beyond the last timestamp go; a file with fewer lines than
    timestamps fails."""
    n = times.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t")).join(lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, "left")
    n = n.select(*keys, F.when(F.coalesce("_n", F.lit(0)) < F.col("_t"), F.raise_error(F.lit("fewer lines than timestamps"))).otherwise(F.lit(True)).cast("boolean").alias("_ok"))
    return lines.join(times.withColumnRenamed("idx", "line_no"), [*keys, "line_no"]).join(n, keys).where("_ok").drop("_ok")


def frame_drift(times: DataFrame, keys: list[str], fps: float = 25.0) -> DataFrame:
    """Adds to frame times (idx, sec): dt, drift (the sum of dt - 1 / fps so far), offset from the frame grid."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy("idx")
    dt = F.col("sec") - F.lag("sec").over(w)
    df = times.withColumn("dt", dt)
    return df.withColumn("drift", F.coalesce(F.sum(F.col("dt") - 1 / fps).over(w), F.lit(0.0))).withColumn("offset", F.col("sec") - F.round(F.col("sec") * fps) / fps)


def file_index(spark: SparkSession, path: str, glob: str, patterns: dict[str, str]) -> DataFrame:
    """path, name, length and a column per pattern of all files below a folder; duplicated names have dup true."""
    from pyspark.sql import Window as W

    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    f = f.withColumn("name", F.substring_index("path", "/", -1))
    return f.select("path", "name", "length", *extract_headers(F.col("name"), patterns), (F.count(F.lit(1)).over(W.partitionBy("name")) > 1).alias("dup"))


def resolve_files(index: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """index with found: the listed file of the exact name, or else the only one that ends in the same `_token`; null if none or several."""
    exact = listing.select(F.col("name").alias("_n"), F.col("path").alias("_exact"))
    token = listing.groupBy(F.substring_index("name", "_", -1).alias("_t")).agg(F.count(F.lit(1)).alias("_c"), F.first("path").alias("_other"))
    df = index.join(exact, F.col(name) == F.col("_n"), "left").join(token, F.substring_index(F.col(name), "_", -1) == F.col("_t"), "left")
    return df.withColumn("found", F.coalesce("_exact", F.when(F.col("_c") == 1, F.col("_other")))).drop("_n", "_t", "_c", "_exact", "_other")


def read_through(spark: SparkSession, path: str, make, *, overwrite: bool = False) -> DataFrame:
    """The table at path, made and written first if it isn't there (or always, with overwrite)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if overwrite or not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_artefacts(tables: dict[str, DataFrame], path: str, *, kind: str = "parquet", by: str | None = None) -> None:
    """Each table below path under its name; by: a column to part files by."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w = w.partitionBy(by) if by and by in df.columns else w
        (w.option("header", True).csv if kind == "csv" else w.parquet)(f"{path}/{name}")


def decode_files(spark: SparkSession, path: str, decoder: Callable[[bytes], pa.Table], schema: str) -> DataFrame:
    """Rows of binary files (recordings, workbooks) by a decoder from bytes to a table with the schema's columns: path, status, then these. status:
    ok, or what the decoder raised, in a row of its own with nulls. Files go to tasks one by one."""
    kinds = spark.createDataFrame([], schema).schema
    want = pa.schema([(f.name, _arrow_type(f.dataType)) for f in kinds.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    t, status = decoder(content.as_py()).select(want.names).cast(want), "ok"
                except Exception as e:  # noqa: BLE001  the row says what happened
                    t, status = pa.table({f.name: pa.nulls(1, f.type) for f in want}), f"{type(e).__name__}: {e}"
                for part in t.combine_chunks().to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part), pa.string()), pa.array([status] * len(part), pa.string()), *part.columns], ["path", "status", *want.names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(each, T.StructType([T.StructField("path", T.StringType()), T.StructField("status", T.StringType()), *kinds.fields]))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Names in workbook files.
_SHEETS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINKS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_rows(raw: bytes, sheet: str | None = None, *, skip: int = 0) -> pa.Table:
    """A sheet of an Excel workbook (xlsx; the first by default) as text columns under the header that comes after skip rows, and a boolean column
    `name_filled` for each: whether the cell has a fill colour. Empty cells are null; numbers are as stored."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        tree = lambda n: ElementTree.fromstring(z.read(n))  # noqa: E731, S314
        names = set(z.namelist())
        links = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        sheets = {s.get("name"): links[s.get(f"{_LINKS}id")] for s in tree("xl/workbook.xml").iter(f"{_SHEETS}sheet")}
        target = next(iter(sheets.values())) if sheet is None else sheets[sheet]
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEETS}t")) for s in tree("xl/sharedStrings.xml").iter(f"{_SHEETS}si")] if "xl/sharedStrings.xml" in names else []
        painted: list[bool] = []
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            solid = [f.find(f"{_SHEETS}patternFill") is not None and f.find(f"{_SHEETS}patternFill").get("patternType", "none") not in ("none", "gray125") for f in styles.iter(f"{_SHEETS}fill")]
            formats = styles.find(f"{_SHEETS}cellXfs")
            painted = [solid[int(x.get("fillId", 0))] for x in formats] if formats is not None else []
        rows: dict[int, dict[int, tuple[str | None, bool]]] = {}
        for cell in tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter(f"{_SHEETS}c"):
            letters = cell.get("r").rstrip("0123456789")
            column = 0
            for c in letters:
                column = column * 26 + ord(c) - 64
            value = cell.find(f"{_SHEETS}v")
            text = None if value is None else value.text
            if cell.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif cell.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_SHEETS}t"))
            style = int(cell.get("s", 0))
            rows.setdefault(int(cell.get("r")[len(letters) :]), {})[column] = (text, style < len(painted) and painted[style])
    head = rows.get(skip + 1, {})
    body = [rows.get(i, {}) for i in range(skip + 2, max(rows, default=0) + 1)]
    out: dict[str, pa.Array] = {}
    for c, (name, _) in sorted(head.items()):
        if name:
            out[name] = pa.array([r.get(c, (None, False))[0] for r in body], pa.string())
            out[f"{name}_filled"] = pa.array([r.get(c, (None, False))[1] for r in body], pa.bool_())
    return pa.table(out)


#: The file of a wearable recording's metadata, and the names that hold where there is none.
METADATA_FILE = "recording.g3"
SCENE_NAMES = ("tobii3_scene.mkv", "tobii3_scene.mp4")
GAZE_NAME, IMU_NAME = "gazedata.gz", "imudata.gz"
_CAMERA = "position: array<double>, `focal-length`: array<double>, rotation: array<array<double>>, skew: double, `principal-point`: array<double>, `radial-distortion`: array<double>, `tangential-distortion`: array<double>, resolution: array<int>"
METADATA_SCHEMA = f"scenecamera struct<file: string, `camera-calibration`: struct<{_CAMERA}>>, gaze struct<file: string, samples: long, `valid-samples`: long>, imu struct<file: string>"


def recording_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per folder below path that holds files: folder, has_metadata, scene_file, gaze_file, imu_file, expected_samples, expected_valid, camera. Without a
    metadata file: the scene video that is there (mkv before mp4; none: null), usual names of the others, -1 samples, no camera."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    listed = listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("name"))
    found = lambda n: F.max(F.when(F.col("name") == n, F.lit(n)))
    folders = listed.groupBy("folder").agg(F.max(F.col("name") == METADATA_FILE).alias("has_metadata"), F.coalesce(*map(found, SCENE_NAMES)).alias("scene"))
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", METADATA_FILE).text(path, wholetext=True)
    meta = text.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_f"), F.from_json("value", METADATA_SCHEMA).alias("m"))
    # Both readers name the same folder, one as file:/ and one as file:///.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = folders.withColumn("folder", plain("folder")).join(meta.withColumn("_f", plain("_f")), F.col("folder") == F.col("_f"), "left")
    or_else = lambda c, v: F.when(F.col("has_metadata"), F.col(c)).otherwise(v)
    return both.select(
        "folder", "has_metadata", or_else("m.scenecamera.file", F.col("scene")).alias("scene_file"), or_else("m.gaze.file", F.lit(GAZE_NAME)).alias("gaze_file"), or_else("m.imu.file", F.lit(IMU_NAME)).alias("imu_file"),
        or_else("m.gaze.samples", F.lit(-1)).cast("long").alias("expected_samples"), or_else("m.gaze.`valid-samples`", F.lit(-1)).cast("long").alias("expected_valid"), F.col("m.scenecamera.`camera-calibration`").alias("camera"),
    )
