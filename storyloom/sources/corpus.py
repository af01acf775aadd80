"""Reading, writing and caching story corpora."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.lookup import lookup_join
from storyloom.operators.positions import nth_row, ordered_position, seeded_subset
from storyloom.scratch import store

STORY_SCHEMA = "text string"
KEYED_SCHEMA = "doc_id bigint, text string"


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = _hadoop_path(spark, path)
    return fs.exists(jpath)


def require_text(df: DataFrame) -> DataFrame:
    """A record without text stops the job when it is read."""
    checked = F.when(F.col("text").isNull(), F.raise_error(F.lit("story record without text"))).otherwise(F.col("text"))
    return df.withColumn("text", checked)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = STORY_SCHEMA) -> DataFrame:
    """One JSON object per line; fields outside the schema are ignored, a malformed line stops the job."""
    return require_text(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


# The byte order mark, which readers of text drop from the head of a file.
_ORDER_MARK = "\uFEFF"


def read_lines(spark: SparkSession, path: str, number: str = "line_no", exact: bool = False) -> DataFrame:
    """``value``, a line, and its 0-based ``number`` in the order of the files' names and of the lines in each.

    Lines end at LF, CR or both. With ``exact`` they end at LF only and keep every other byte, so a value and a LF are the bytes
    of the file; what the size of a file has beyond its lines shows that it began with an order mark, which is put back.

    Files are read in pieces by many tasks. Only how many lines each piece has is gathered; a line's number is the sum
    for the pieces before its own and its place in the piece.
    """
    reader = spark.read.option("lineSep", "\n") if exact else spark.read
    lines = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_bytes"), F.monotonically_increasing_id().alias("_at"),
    )
    pieces = lines.groupBy("_file", "_block").agg(
        F.min("_at").alias("_least"), F.count(F.lit(1)).alias("_lines"), F.first("_bytes").alias("_bytes"), F.sum(F.octet_length("value") + 1).alias("_seen")
    )
    placed = ordered_position(store(pieces, "pieces").df, [F.col("_file"), F.col("_block")], "_piece")
    # One row for each piece of a file, a few tens of bytes for every 128 MiB.
    order = placed.orderBy("_piece").collect()
    before, starts, seen = 0, [], {}
    for r in order:
        seen[r["_file"]] = seen.get(r["_file"], 0) + r["_seen"]
    for r in order:
        # The last line may lack its LF; an order mark is three bytes.
        marked = r["_block"] == 0 and r["_bytes"] - seen[r["_file"]] in (2, 3)
        starts.append((r["_file"], r["_block"], before - r["_least"], r["_least"] if exact and marked else None))
        before += r["_lines"]
    table = store(spark.createDataFrame(starts, "_file string, _block bigint, _shift bigint, _mark bigint"), "starts")
    found = lookup_join(lines, table, ["_file", "_block"], ["_at"])
    value = F.when(F.col("_at") == F.col("_mark"), F.concat(F.lit(_ORDER_MARK), "value")).otherwise(F.col("value"))
    return found.select((F.col("_shift") + F.col("_at")).alias(number), value.alias("value"))


def read_keyed_jsonl(spark: SparkSession, path: str, schema: str | T.StructType = STORY_SCHEMA, key: str = "doc_id") -> DataFrame:
    """Records that bring no key of their own, with their place in file order as ``key``."""
    lines = read_lines(spark, path, key)
    parsed = lines.select(key, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_record"))
    return require_text(parsed.select(key, "_record.*"))


def write_subset(spark: SparkSession, source: str, target: str, n: int, seed: int) -> None:
    """Exactly ``n`` lines of a corpus in seeded choice, or all if there are no more, copies included.

    Lines end at LF and are written byte for byte, a CR before it and any alone with them. A last line that lacked its LF gets one,
    which keeps records apart.
    """
    chosen = seeded_subset(read_lines(spark, source, exact=True), n, seed, key="line_no")
    chosen.select("value").write.mode("overwrite").option("lineSep", "\n").text(target)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def first_in_files(spark: SparkSession, path: str, n: int, columns: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of a Parquet corpus in file order: by name of the file, then as they stand in it. No key is needed.

    Files are counted, the one in which the n-th row lies is found without passing rows through one task, and rows are filtered where
    they are read by the file and the place that Spark gives them.
    """
    df = read_table(spark, path, columns)
    if n <= 0:
        return df.filter(F.lit(False))
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    edge = nth_row(placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_copies")), [F.col("_file").asc()], n)
    if edge is None:
        return df
    return placed.filter((F.col("_file") < edge["_file"]) | ((F.col("_file") == edge["_file"]) & (F.col("_row") < edge["_room"]))).select(*df.columns)


def resolve_split(spark: SparkSession, root: str, split: str) -> tuple[str, str]:
    """Format and path of a split: a directory ``split/`` or a file ``split.jsonl``."""
    folder, single = f"{root.rstrip('/')}/{split}", f"{root.rstrip('/')}/{split}.jsonl"
    if path_exists(spark, folder):
        fs, jpath = _hadoop_path(spark, folder)
        names = [status.getPath().getName() for status in fs.listStatus(jpath)]
        return ("parquet" if any(n.endswith(".parquet") for n in names) else "json"), folder
    if path_exists(spark, single):
        return "json", single
    raise FileNotFoundError(f"neither {folder} nor {single} exists")


def read_split(
    spark: SparkSession, root: str, split: str, schema: str = STORY_SCHEMA, max_samples: int | None = None, key: str = "doc_id"
) -> DataFrame:
    """A split's records, whole or the first ``max_samples`` in file order.

    JSON records get a key from their place where the schema names none.
    """
    kind, path = resolve_split(spark, root, split)
    if kind == "json":
        names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names
        if key in names and max_samples is None:
            df = read_jsonl(spark, path, schema)
        else:
            df = read_keyed_jsonl(spark, path, schema, key if key not in names else "_line")
            df = df if max_samples is None else df.filter(F.col("_line" if key in names else key) < max_samples)
            df = df.drop("_line")
    else:
        df = require_text(read_table(spark, path) if max_samples is None else first_in_files(spark, path, max_samples))
    return df.withColumn("split", F.lit(split))


def split_of(key: str = "doc_id"):
    """Every tenth key is validation."""
    return F.when(F.pmod(F.col(key), F.lit(10)) == 0, "validation").otherwise("train")


def stories(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    """The story corpus of a table folder: ``doc_id``, ``text``, ``split``."""
    return require_text(read_table(spark, f"{folder}/{table}.parquet", ["doc_id", "text"])).withColumn("split", split_of())


def records(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    """The corpus with all its columns, and ``split``."""
    return require_text(read_table(spark, f"{folder}/{table}.parquet")).withColumn("split", split_of())


def conversation_stories(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations as a second corpus: every turn is a story, numbered by conversation and turn."""
    turns = read_table(spark, f"{folder}/conversations.parquet", ["conv_id", "turn", "text"])
    placed = ordered_position(turns, [F.col("conv_id"), F.col("turn"), F.col("text")])
    return placed.select((F.col("position") - 1).alias("doc_id"), "text").withColumn("split", split_of())


def write_jsonl(df: DataFrame, path: str, by_split: bool = False) -> None:
    """One JSON object per line; with ``by_split`` one folder for each split, written in one job."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if by_split else writer).json(path)


def write_table(df: DataFrame, path: str, by_split: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if by_split else writer).parquet(path)


def convert(spark: SparkSession, source: str, target: str, to: str, schema: str = STORY_SCHEMA) -> DataFrame:
    """Copy a corpus between JSON lines and Parquet and read the copy."""
    if to == "parquet":
        write_table(read_jsonl(spark, source, schema), target)
        return read_table(spark, target)
    if to == "json":
        write_jsonl(read_table(spark, source), target)
        return read_jsonl(spark, target, schema)
    raise ValueError("convert to 'parquet' or 'json'")


def cache_path(
    root: str,
    *,
    split: str,
    tokenizer: str,
    max_length: int,
    min_length: int,
    offline: bool = True,
    max_samples: int | None = None,
) -> str:
    """A folder named after every setting that changes the processed examples, in the order of their names."""
    settings = {
        "max_length": max_length, "max_samples": max_samples, "min_length": min_length, "offline": offline, "split": split,
        "tokenizer": tokenizer,
    }
    return "/".join([root.rstrip("/"), "processed", *(f"{name}={quote(str(settings[name]), safe='')}" for name in sorted(settings))])


_MANIFEST = "_manifest.json"


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files of a folder with their sizes."""
    fs, jpath = _hadoop_path(spark, path)
    found = fs.listFiles(jpath, True)
    sizes = {}
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString().rpartition(path.rstrip("/").rpartition("/")[2] + "/")[2]
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            sizes[name] = status.getLen()
    return sizes


def _write_text(spark: SparkSession, path: str, content: str) -> None:
    fs, jpath = _hadoop_path(spark, path)
    out = fs.create(jpath, True)
    out.write(bytearray(content.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, jpath = _hadoop_path(spark, path)
    stream = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def is_complete(spark: SparkSession, path: str) -> bool:
    """The folder holds just the files, of just the sizes, that its manifest lists; the manifest is written last."""
    if not path_exists(spark, f"{path}/{_MANIFEST}"):
        return False
    try:
        listed = json.loads(_read_text(spark, f"{path}/{_MANIFEST}"))["files"]
    except (ValueError, KeyError):
        return False
    return listed == _files(spark, path)


_POINTER = "_current"


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that a materialised table points to."""
    if not path_exists(spark, f"{path}/{_POINTER}"):
        return None
    return f"{path}/{_read_text(spark, f'{path}/{_POINTER}').strip()}"


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Swap the pointer in one step: a reader finds the old one or the new one, never none and never half of one."""
    fresh = f"{path}/{_POINTER}-{uuid.uuid4().hex}"
    _write_text(spark, fresh, version)
    fs, source = _hadoop_path(spark, fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), fs.getConf())
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(source), fs.makeQualified(hadoop.Path(f"{path}/{_POINTER}")), options)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the version that ``path`` points to, or build a new one and point to it.

    A version is a folder of its own that is never written again, so several builders and readers at once do not meet: each
    builder writes its own, the last to finish is pointed to, and a reader stays with the version it was given. One that is
    unfinished, or whose files were cut short, taken away or added to, is not read but built anew.
    """
    found = current_version(spark, path)
    if found is None or not is_complete(spark, found):
        name = f"version-{uuid.uuid4().hex}"
        found = f"{path}/{name}"
        build().write.parquet(found)
        _write_text(spark, f"{found}/{_MANIFEST}", json.dumps({"files": _files(spark, found)}))
        _point_to(spark, path, name)
    return spark.read.parquet(found)


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions but the one pointed to, once no reader or builder is at work; how many there were."""
    kept = current_version(spark, path)
    fs, folder = _hadoop_path(spark, path)
    old = [status.getPath() for status in fs.listStatus(folder) if status.getPath().getName().startswith("version-")]
    old = [p for p in old if kept is None or p.getName() != kept.rpartition("/")[2]]
    for version in old:
        fs.delete(version, True)
    return len(old)


def split_sizes(df: DataFrame, name: str = "n") -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias(name))
