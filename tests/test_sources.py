import os

import pytest
from pyspark.sql import functions as F

from storyloom import scratch
from storyloom.sources import corpus
from storyloom.streaming import segment


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = write(f"{tmp_path}/a/train.jsonl", ['{"text": "A. B.", "other": 1}', '{"text": "né"}'])
    assert sorted(r["text"] for r in corpus.read_jsonl(spark, path).collect()) == ["A. B.", "né"]


@pytest.mark.parametrize("line", ['{"text": ', '{"title": "x"}', '{"text": null}'])
def test_bad_records_stop_the_job(spark, tmp_path, line):
    path = write(f"{tmp_path}/b/train.jsonl", ['{"text": "ok"}', line])
    with pytest.raises(Exception):
        corpus.read_jsonl(spark, path).collect()


def test_split_layout(spark, tmp_path):
    write(f"{tmp_path}/c/train.jsonl", ['{"text": "A"}'])
    write(f"{tmp_path}/c/validation/part.jsonl", ['{"text": "B"}', '{"text": "C"}'])
    spark.createDataFrame([("D",)], "text string").write.parquet(f"{tmp_path}/c/extra")
    kinds = {s: corpus.resolve_split(spark, f"{tmp_path}/c", s)[0] for s in ("train", "validation", "extra")}
    assert kinds == {"train": "json", "validation": "json", "extra": "parquet"}
    assert corpus.read_split(spark, f"{tmp_path}/c", "validation").count() == 2
    with pytest.raises(FileNotFoundError):
        corpus.resolve_split(spark, f"{tmp_path}/c", "test")


def test_cache_path_names_every_setting():
    base = dict(split="train", tokenizer="simple", max_length=128, min_length=5)
    paths = {corpus.cache_path("/r", **base)}
    for change in ({"split": "validation"}, {"tokenizer": "bpe"}, {"max_length": 64}, {"min_length": 4}, {"max_samples": 10}, {"offline": False}):
        paths.add(corpus.cache_path("/r", **{**base, **change}))
    assert len(paths) == 7


def test_materialize_builds_once_and_repairs(spark, tmp_path):
    path, calls = f"{tmp_path}/d", []

    def build():
        calls.append(1)
        return spark.range(5)

    assert corpus.materialize(spark, path, build).count() == corpus.materialize(spark, path, build).count() == 5
    assert len(calls) == 1
    now = lambda: corpus.current_version(spark, path)
    parts = lambda: [f"{now()}/{f}" for f in os.listdir(now()) if f.endswith(".parquet")]
    harms = [
        lambda: os.remove(f"{now()}/_manifest.json"), lambda: os.remove(parts()[0]), lambda: os.truncate(parts()[-1], 10),
        lambda: open(f"{now()}/part-x.parquet", "w").close(), lambda: open(f"{now()}/_manifest.json", "w").close(), lambda: os.remove(f"{path}/_current"),
    ]
    for n, harm in enumerate(harms, 2):
        harm()
        assert corpus.materialize(spark, path, build).count() == 5 and len(calls) == n
    assert corpus.drop_old_versions(spark, path) == 6 and corpus.materialize(spark, path, build).count() == 5 and len(calls) == 7


def test_builders_and_a_reader_at_once_never_see_a_mix(spark, tmp_path):
    path = f"{tmp_path}/d"
    reader = corpus.materialize(spark, path, lambda: spark.range(10).withColumn("v", F.lit(0)))
    os.remove(f"{corpus.current_version(spark, path)}/_manifest.json")

    def slow():
        # A second builder begins and ends while this one is at work.
        other = corpus.materialize(spark, path, lambda: spark.range(20).withColumn("v", F.lit(1)))
        assert {r["v"] for r in other.collect()} == {1} and other.count() == 20
        return spark.range(30).withColumn("v", F.lit(2))

    last = corpus.materialize(spark, path, slow)
    assert reader.count() == 10 and {r["v"] for r in reader.collect()} == {0}
    assert last.count() == 30 and corpus.materialize(spark, path, slow).count() == 30
    assert not [f for f in os.listdir(path) if f.startswith("_current-")]


def test_cache_paths_keep_tokenizers_of_one_base_name_apart():
    base = dict(split="train", max_length=128, min_length=5)
    assert corpus.cache_path("/r", tokenizer="a/gpt", **base) != corpus.cache_path("/r", tokenizer="b/gpt", **base)


def test_null_text_stops_tables_too(spark, tmp_path):
    spark.createDataFrame([(1, "A."), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with pytest.raises(Exception, match="without text"):
        corpus.stories(spark, str(tmp_path)).collect()


def test_lines_without_keys(spark, tmp_path):
    for name, low in (("a", 0), ("b", 400)):
        write(f"{tmp_path}/in/{name}.json", [f'{{"text": "story {i}"}}' for i in range(low, low + 400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r["doc_id"]: r["text"] for r in corpus.read_keyed_jsonl(spark, f"{tmp_path}/in").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"story {i}" for i in range(800)}
    write(f"{tmp_path}/train.jsonl", ['{"text": "x"}'] * 7)
    assert corpus.read_split(spark, str(tmp_path), "train", max_samples=3).count() == 3


def test_subset_of_lines_is_unchanged(spark, tmp_path):
    lines = ['{"text":  "a", "b": 1}', '{"text": "a"}', '{"text": "a"}', '{"text": "é"}'] * 5
    write(f"{tmp_path}/in.jsonl", lines)
    for n in (1, 9, 20, 50):
        corpus.write_subset(spark, f"{tmp_path}/in.jsonl", f"{tmp_path}/out{n}", n, 3)
        got = [r["value"] for r in spark.read.text(f"{tmp_path}/out{n}").collect()]
        assert len(got) == min(n, 20) and set(got) <= set(lines)
    assert sorted(got) == sorted(lines)


def test_owner_takes_its_tables_along(spark):
    from storyloom.plans.catalog import REGISTRY

    with scratch.owner(spark) as folder:
        assert REGISTRY["keyed_jsonl"].run(spark, "/root/testdata/sf0.001").count() == 200
        assert corpus.path_exists(spark, folder)
    assert not corpus.path_exists(spark, folder)


def test_scratch_without_a_setting_is_hadoops(spark, monkeypatch):
    real = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: None if key == "spark.checkpoint.dir" else real(key, *rest))
    assert scratch.scratch_root(spark).startswith("file:/")


def test_convert_and_split_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", "train"), (2, "B", "validation")], "doc_id bigint, text string, split string")
    corpus.write_jsonl(df, f"{tmp_path}/e", by_split=True)
    assert sorted(d for d in os.listdir(f"{tmp_path}/e") if "=" in d) == ["split=train", "split=validation"]
    corpus.write_table(df.select("doc_id", "text"), f"{tmp_path}/f")
    corpus.convert(spark, f"{tmp_path}/f", f"{tmp_path}/g", "json", corpus.KEYED_SCHEMA)
    back = corpus.convert(spark, f"{tmp_path}/g", f"{tmp_path}/h", "parquet", corpus.KEYED_SCHEMA)
    assert sorted(tuple(r) for r in back.select("doc_id", "text").collect()) == [(1, "A"), (2, "B")]


def test_scratch_uses_the_session_setting_and_measures(spark):
    assert scratch.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    table = scratch.store(spark.createDataFrame([("abc", [1, 2]), ("é", None)], "s string, a array<bigint>"), "t")
    assert table.rows == 2 and table.path.startswith(scratch.scratch_root(spark))
    assert table.memory_bytes >= 5 + 16 and table.df.count() == 2


def test_stream_of_files(spark, tmp_path):
    write(f"{tmp_path}/in/one.json", ['{"doc_id": 1, "text": "A. B. C."}', '{"doc_id": 2, "text": "A. B."}'])
    run = lambda: segment.write_segments(
        segment.read_story_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp"
    ).awaitTermination()
    run()
    write(f"{tmp_path}/in/two.json", ['{"doc_id": 3, "text": "X. Y. Z. W."}'])
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["first_sentence"], r["middle_part"], r["last_sentence"]) for r in rows] == [
        (1, "A.", "B.", "C."), (3, "X.", "Y. Z.", "W."),
    ]


def test_lines_are_copied_byte_for_byte(spark, tmp_path):
    raw = b'\xef\xbb\xbf{"text": "a"}\r\n{"text":\r"b"}\n\n  {"text": "\xc3\xa9"}\r\r\n{"text": "last"}'
    os.makedirs(f"{tmp_path}/in")
    for name, content in (("a.jsonl", raw), ("b.jsonl", raw[3:] + b"\n"), ("c.jsonl", b"")):
        with open(f"{tmp_path}/in/{name}", "wb") as f:
            f.write(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        corpus.write_subset(spark, f"{tmp_path}/in", f"{tmp_path}/out", 100, 1)
        rows = corpus.read_lines(spark, f"{tmp_path}/in", exact=True).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = raw.split(b"\n") + raw[3:].split(b"\n")
    assert [r["value"].encode() for r in rows] == want and [r["line_no"] for r in rows] == list(range(10))
    written = b"".join(open(f"{tmp_path}/out/{f}", "rb").read() for f in os.listdir(f"{tmp_path}/out") if f.startswith("part-"))
    assert sorted(written.split(b"\n")[:-1]) == sorted(want)


def test_first_rows_in_file_order_need_no_key(spark, tmp_path):
    path = f"{tmp_path}/c/train"
    for k in range(4):
        spark.range(0, 7).select((F.lit(100 - 10 * k) - F.col("id")).alias("doc_id"), F.concat(F.lit(f"t{k}-"), "id").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/p{k}")
        os.makedirs(path, exist_ok=True)
        part = next(f for f in os.listdir(f"{tmp_path}/p{k}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/p{k}/{part}", f"{path}/part-{k}.parquet")
    everything = [f"t{k}-{i}" for k in range(4) for i in range(7)]
    for n in (0, 1, 7, 10, 27, 28, 99):
        got = corpus.first_in_files(spark, path, n)
        assert sorted(r["text"] for r in got.collect()) == sorted(everything[:n]) and got.columns == ["doc_id", "text"]
    assert {r["text"] for r in corpus.read_split(spark, f"{tmp_path}/c", "train", max_samples=9).collect()} == set(everything[:9])
