"""Sources, sinks, sizes and seeded selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions import text as tx
from storyloom.operators import batching, positions
from storyloom.operators.examples import infill_examples
from storyloom.operators.tokenizers import WordTokenizer
from storyloom.operators.vocabulary import build_vocabulary
from storyloom.plans.registry import query
from storyloom.plans.sql import flat, sent, sql
from storyloom.scratch import new_path
from storyloom.sources import corpus

SEED = 42


def train_vocabulary(docs):
    return build_vocabulary(docs.filter("split = 'train'"), tx.simple_tokens(F.col("text")))


@query("scan_parquet", "SELECT doc_id, text, length(text)::BIGINT AS n_chars FROM documents")
def scan_parquet(spark, sf):
    docs = corpus.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "text"])
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


# Fixed value: the columns of the corpus table.
RECORD = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_FIELDS = "doc_id, text, lang, source, n_chars"


@query("scan_jsonl", f"SELECT {_FIELDS} FROM documents")
def scan_jsonl(spark, sf):
    path = new_path(spark, "jsonl")
    corpus.write_jsonl(corpus.records(spark, sf).drop("split"), path)
    return corpus.read_jsonl(spark, path, RECORD)


def _as_lines(spark, sf):
    """The corpus as JSON lines in key order, none of which tells its key."""
    path = new_path(spark, "lines")
    corpus.write_jsonl(corpus.records(spark, sf).drop("split").orderBy("doc_id").withColumnRenamed("doc_id", "number"), path)
    return path


@query("keyed_jsonl", "SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS doc_id, doc_id AS number, text, lang, source, n_chars FROM documents")
def keyed_jsonl(spark, sf):
    """Records without a key get their place in file order."""
    return corpus.read_keyed_jsonl(spark, _as_lines(spark, sf), RECORD.replace("doc_id", "number"))


@query("subset_lines", """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || no::VARCHAR)) AS rn
    FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS no FROM documents)) WHERE rn <= 75""")
def subset_lines(spark, sf):
    """Chosen lines are written as they were read, with all their fields."""
    target = new_path(spark, "subset")
    corpus.write_subset(spark, _as_lines(spark, sf), target, 75, SEED)
    return corpus.read_jsonl(spark, target, RECORD.replace("doc_id", "number")).withColumnRenamed("number", "doc_id")


@query("sink_by_split", f"SELECT {_FIELDS}, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents")
def sink_by_split(spark, sf):
    path = new_path(spark, "splits")
    corpus.write_jsonl(corpus.records(spark, sf), path, by_split=True)
    return spark.read.schema(f"{RECORD}, split string").json(path)


@query("split_layout", sql("docs", body="SELECT split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM docs GROUP BY split"))
def split_layout(spark, sf):
    """Train kept as a Parquet directory, validation as JSON lines; both found by name."""
    root = new_path(spark, "layout")
    docs = corpus.stories(spark, sf)
    corpus.write_table(docs.filter("split = 'train'").select("doc_id", "text"), f"{root}/train")
    corpus.write_jsonl(docs.filter("split = 'validation'").select("doc_id", "text"), f"{root}/validation.jsonl")
    splits = [
        corpus.read_split(spark, root, s, corpus.KEYED_SCHEMA).select("split", "doc_id", "text")
        for s in ("train", "validation")
    ]
    return splits[0].unionByName(splits[1]).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


@query("head_cap", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def head_cap(spark, sf):
    docs = corpus.read_table(spark, f"{sf}/documents.parquet", ["doc_id", "text"])
    return positions.first_rows(docs, 100)


@query("head_in_files", "SELECT doc_id, text FROM documents LIMIT 100")
def head_in_files(spark, sf):
    """The first rows as they stand in the file, whatever their keys."""
    return corpus.first_in_files(spark, f"{sf}/documents.parquet", 100, ["doc_id", "text"])


_SUBSET = """SELECT doc_id, split, text FROM (SELECT *, row_number() OVER (PARTITION BY split
    ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rn FROM docs) WHERE rn <= 50"""


@query("subset", sql("docs", body=_SUBSET))
def subset(spark, sf):
    return positions.seeded_subset(corpus.stories(spark, sf), 50, SEED, by="split").select("doc_id", "split", "text")


@query("sink_jsonl", f"""SELECT {_FIELDS}, split FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || doc_id::VARCHAR), doc_id) AS rn
    FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents)) WHERE rn <= 50""")
def sink_jsonl(spark, sf):
    path = new_path(spark, "subset")
    corpus.write_jsonl(positions.seeded_subset(corpus.records(spark, sf), 50, SEED, by="split"), path, by_split=True)
    return spark.read.schema(f"{RECORD}, split string").json(path)


@query("convert_format", f"SELECT {_FIELDS} FROM documents")
def convert_format(spark, sf):
    table, lines = new_path(spark, "table"), new_path(spark, "lines")
    corpus.convert(spark, f"{sf}/documents.parquet", lines, "json", RECORD)
    return corpus.convert(spark, lines, table, "parquet", RECORD)


@query(
    "materialized_examples",
    sql(
        "prompts", "pt",
        body="""SELECT p.doc_id, len(p.ids)::BIGINT AS n_input, len(pt.ids[1:128])::BIGINT AS n_target
        FROM (SELECT doc_id, ids[1:128] AS ids FROM prompts) p JOIN pt USING (doc_id)
        WHERE len(p.ids) >= 5 AND len(pt.ids) >= 5""",
    ),
)
def materialized_examples(spark, sf):
    docs = corpus.stories(spark, sf)
    path = corpus.cache_path(
        new_path(spark, "cache"), split="all", tokenizer="simple", max_length=128, min_length=5
    )

    def build():
        return infill_examples(docs, WordTokenizer(train_vocabulary(docs)), max_length=128, min_length=5)

    corpus.materialize(spark, path, build)
    cached = corpus.materialize(spark, path, build)
    return cached.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("n_input"), F.size("target_ids").cast("bigint").alias("n_target")
    )


@query(
    "split_sizes",
    sql("cut", body="SELECT split, count(*) AS stories, (count(*) FILTER (len(s) >= 3)) AS long_enough FROM cut GROUP BY split"),
)
def split_sizes(spark, sf):
    docs = corpus.stories(spark, sf).withColumn("_n", F.size(tx.sentences(F.col("text"))))
    return docs.groupBy("split").agg(
        F.count(F.lit(1)).alias("stories"), F.count(F.when(F.col("_n") >= 3, 1)).alias("long_enough")
    )


@query(
    "conversation_sizes",
    f"""SELECT split, count(*) AS stories, sum(n)::BIGINT AS sentences, (count(*) FILTER (n >= 3)) AS long_enough FROM (
        SELECT len({sent('text')}) AS n, CASE WHEN (row_number() OVER (ORDER BY conv_id, turn, text) - 1) % 10 = 0
        THEN 'validation' ELSE 'train' END AS split FROM conversations) GROUP BY split""",
)
def conversation_sizes(spark, sf):
    told = corpus.conversation_stories(spark, sf).withColumn("_n", F.size(tx.sentences(F.col("text"))))
    return told.groupBy("split").agg(
        F.count(F.lit(1)).alias("stories"),
        F.sum("_n").cast("bigint").alias("sentences"),
        F.count(F.when(F.col("_n") >= 3, 1)).alias("long_enough"),
    )


@query(
    "epoch_shuffle",
    """SELECT e::INT AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY
       md5('42:' || e::VARCHAR || ':' || doc_id::VARCHAR), doc_id) AS position FROM documents, range(3) r(e)""",
)
def epoch_shuffle(spark, sf):
    docs = corpus.read_table(spark, f"{sf}/documents.parquet", ["doc_id"])
    return batching.epoch_order(docs, SEED, 3).select("epoch", "doc_id", "position")


@query(
    "random_example",
    sql("seg2", body="""SELECT doc_id, first_sentence, last_sentence FROM seg2
        ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 1"""),
)
def random_example(spark, sf):
    docs = corpus.stories(spark, sf)
    parts = tx.sentences(F.col("text"))
    pairs = docs.select("doc_id", tx.first_of(parts).alias("first_sentence"), tx.last_of(parts).alias("last_sentence"))
    usable = pairs.filter(F.col("first_sentence").isNotNull() & F.col("last_sentence").isNotNull())
    return positions.seeded_subset(usable, 1, SEED)


_SHARDS = """,
  t AS (SELECT 'train' AS split, 0 AS epoch UNION ALL SELECT 'train', 1),
  ordered AS (
    SELECT d.split, t.epoch, doc_id, row_number() OVER (PARTITION BY t.epoch
      ORDER BY md5('42:' || t.epoch::VARCHAR || ':' || doc_id::VARCHAR), doc_id) AS rn FROM docs d JOIN t ON t.split = d.split
    UNION ALL SELECT split, 0, doc_id, row_number() OVER (ORDER BY doc_id) FROM docs WHERE split = 'validation'),
  sized AS (SELECT *, count(*) OVER (PARTITION BY split, epoch) AS n FROM ordered),
  filled AS (SELECT split, epoch, doc_id, rn FROM sized UNION ALL
    SELECT split, epoch, doc_id, rn + n FROM sized WHERE rn <= ceil(n / 7.0) * 7 - n)
SELECT split, epoch::INT AS epoch, doc_id, ((rn - 1) % 7)::INT AS rank, ((rn - 1) // 7)::BIGINT AS slot FROM filled"""


@query("shards", "WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents)" + _SHARDS)
def shards(spark, sf):
    docs = corpus.read_table(spark, f"{sf}/documents.parquet", ["doc_id"]).withColumn("split", corpus.split_of())
    train = batching.epoch_order(docs.filter("split = 'train'"), SEED, 2).withColumn("split", F.lit("train"))
    held = docs.filter("split = 'validation'")
    total = held.count()
    fixed = (
        positions.ordered_position(held, [F.col("doc_id")])
        .withColumn("total", F.lit(total).cast("bigint"))
        .withColumn("epoch", F.lit(0))
    )
    both = train.unionByName(fixed)
    return batching.shard_positions(both, 7).select("split", "epoch", "doc_id", "rank", "slot")
