"""Secret scans with an incremental ledger of blobs.

Every row is one version of a path; its text is addressed by its SHA-256. A ledger folder keeps, for each version of the
rules, the findings of every blob that was ever scanned. A run finds the blobs that the ledger lacks for the current rules,
picks one row for each, scans those whole texts alone, appends what it found, and joins findings back to all rows.

The base rules are ``assign``, ``access`` and ``hex``; further kinds only add spans. Spans are code points, end
exclusive, leftmost and not overlapping within a kind.

Defined results: a null text counts as empty and has no finding; rows that share identifier or text each get the findings
of their own text; no rows give no rows. Other columns of the input take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import ready, schema_of, text_or_empty, type_of
from storyloom.scratch import new_path, store
from storyloom.sources.corpus import path_exists


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``hints``: lower-case strings of which every match holds one; without one the rule is skipped.
    ``least``: characters that ``group`` must have, else the match is dropped."""

    kind: str
    pattern: str
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 1
    flags: int = re.ASCII


BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6, re.ASCII | re.IGNORECASE,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", ("akia",), 0, 20),
    # A run of the class is greedy, so asking for 24 at once finds the same runs as dropping shorter ones afterwards.
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?", ("private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("login", r"[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\s:/@]{1,100}:[^\s:/@]{1,100}@", ("://",)),
)

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
REGIONS = "array<struct<start:bigint,end:bigint>>"


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_secrets(text: str, rules: tuple[tuple[Rule, re.Pattern], ...]) -> list[tuple[str, int, int]]:
    """Kind, start and end of every finding, by start, then in the order of the rules."""
    lowered, found = text.lower(), []
    for order, (rule, pattern) in enumerate(rules):
        if rule.hints and not any(h in lowered for h in rule.hints):
            continue
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, rule.kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The stretches that the spans cover, last first."""
    out: list[list[int]] = []
    for _, start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in reversed(out)]


def _scan(rules: tuple[Rule, ...]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tuple((r, re.compile(r.pattern, r.flags)) for r in rules)
        span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        region_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            blobs, spans = [], []
            for blob, text in zip(batch.column("_blob").to_pylist(), batch.column("_text").to_pylist()):
                # A row of another text may share the identifier that was picked for a blob.
                if hashlib.sha256(text.encode()).digest() == blob:
                    blobs.append(blob)
                    spans.append(find_secrets(text, compiled))
            named = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in spans]
            regions = [[{"start": s, "end": e} for s, e in merged(found)] for found in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.binary()), pa.array(named, span_type), pa.array(regions, region_type)],
                names=["_blob", "spans", "regions"],
            )

    return read


def scan(
    docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each input row: identifier, ``blob`` (SHA-256 of the text), ``spans`` and covered ``regions``.

    ``ledger`` is a folder that outlives the run; without one a new one is begun.
    """
    spark = ready(docs.sparkSession)
    folder = f"{ledger or new_path(spark, 'ledger')}/rules={rules_version(rules)}"
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text_or_empty(text_col).alias("_text"))
    paths = store(source.select("_id", F.unhex(F.sha2("_text", 256)).alias("_blob")), "paths").df
    unseen = paths.groupBy("_blob").agg(F.min("_id").alias("_pick"))
    schema = schema_of(("_blob", "binary"), ("spans", SPANS), ("regions", REGIONS))
    if path_exists(spark, folder):
        unseen = unseen.join(spark.read.schema(schema).parquet(folder).select("_blob"), "_blob", "left_anti")
    # By blob and identifier, so rows without one, or with the same, meet their own text only.
    named = source.withColumn("_own", F.unhex(F.sha2("_text", 256)))
    texts = named.join(unseen, (F.col("_own") == F.col("_blob")) & F.col("_id").eqNullSafe(F.col("_pick"))).select("_blob", "_text")
    texts.mapInArrow(_scan(rules), schema).dropDuplicates(["_blob"]).write.mode("append").parquet(folder)
    # Two runs at once may both have added a blob; their findings are the same.
    known = spark.read.schema(schema).parquet(folder).filter(F.size("spans") > 0).dropDuplicates(["_blob"])
    joined = paths.join(known, "_blob", "left")
    return joined.select(
        F.col("_id").alias(id_col), F.col("_blob").alias("blob"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("regions", F.array().cast(REGIONS)).alias("regions"),
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    shown = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        id_col, *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


def redact(
    docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``docs`` with every covered stretch replaced by ``mark``; all rows and columns stay."""
    hits = scan(docs, ledger, rules, id_col, text_col).filter(F.size("regions") > 0)
    hits = store(hits.select(F.col(id_col).alias("_hit"), "blob", "regions").dropDuplicates(["_hit", "blob"]), "hits").df
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(whole.alias("_row"))
    key, text = F.col(f"_row.{place[id_col]}"), F.col(f"_row.{place[text_col]}")
    same = key.eqNullSafe(F.col("_hit")) & (F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)) == F.col("blob"))
    joined = rows.join(hits, same, "left")
    cut = F.aggregate(
        "regions", text, lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"].cast("int")), F.lit(mark), F.substr(t, (r["end"] + 1).cast("int")))
    )
    clean = F.when(F.col("regions").isNull(), text).otherwise(cut)
    return joined.select(*((clean if c == text_col else F.col(f"_row.{place[c]}")).alias(c) for c in docs.columns))
