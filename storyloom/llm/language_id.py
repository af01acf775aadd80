"""Language identification with blended-spectrum string kernels.

A text is the set of its character n-grams of one to three letters (letters lower-cased, everything else one blank), hashed
into 2**17 slots. The kernel of two texts is the number of slots both have, divided by the root of the product of their
sizes. Nyström landmarks, a fixed number for each language, span the feature space; one ridge regression for each language
against the rest is fitted in it. A batch of whole texts is scored by two matrix products: presence by landmarks, then
kernel values by coefficients.

Fitting learns every label from a sample: at most ``PER_LANGUAGE`` texts of each, chosen by a hash of the identifier, and where
that makes more than ``SAMPLE`` texts an equal part for each, at least ``LEAST_EACH``; only their slots reach the driver. The
model has LANDMARKS rows of 2**17 bits, or one for each language if there are more, and is broadcast; so sample and model grow with the
number of labels, not with that of texts. Everything else runs over all rows.

Defined results: a null text or one without letters is ``und`` with score 0, as is every text if there is nothing to learn
from; a null identifier counts as held out; rows that share an identifier are judged each; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import BASES, ready, schema_of, text_or_empty, type_of

SLOT_BITS = 17
LONGEST = 3
LANDMARKS = 192
PER_LANGUAGE = 400
# All texts of the sample together, unless so many languages have LEAST_EACH.
SAMPLE = 4096
LEAST_EACH = 16
RIDGE = 0.05
UNKNOWN = "und"
# Of the share of known n-grams that all but LOWEST of a language's texts reach, a text must reach TOLERANCE.
LOWEST = 0.01
TOLERANCE = 2 / 3
_BATCH = 256

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def presence(text: str | None) -> np.ndarray | None:
    """Sorted slots of the n-grams of a whole text; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[points]
    if not letter.any():
        return None
    kept = np.where(letter, points, 32)
    kept = np.concatenate(([32], kept, [32])).astype(np.uint64)
    blank = kept == 32
    # Stretches of other characters become one blank.
    padded = kept[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
    seen = np.zeros(1 << SLOT_BITS, dtype=bool)
    grams = np.zeros(len(padded), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        size = len(padded) - n + 1
        if size <= 0:
            break
        grams = (grams[:size] + padded[n - 1 :]) * np.uint64(BASES[0])
        seen[((grams ^ (grams >> np.uint64(29))) * np.uint64(BASES[1] + 2 * n)) >> np.uint64(64 - SLOT_BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Landmarks as rows over the slots they use, and the coefficients of each language."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    # The slots that texts of each language use, as bits, and the least share of a text's slots that must be among them.
    known: np.ndarray | None = None
    least: np.ndarray | None = None

    def known_share(self, slots: np.ndarray, language: int) -> float:
        return float(((self.known[language, slots >> 3] >> (slots & 7)) & 1).mean())

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(found), self.landmarks.shape[1]), dtype=np.float32)
        for row, slots in zip(rows, found):
            own = self.columns[slots]
            row[own[own >= 0]] = 1
        sizes = np.sqrt(np.array([len(s) for s in found], dtype=np.float32))
        kernel = (rows @ self.landmarks.T) / sizes[:, None]
        return kernel @ self.weights


def fit_model(found: list[np.ndarray], labels: list[str]) -> Model | None:
    """Kernel ridge regression on presence sets; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    members = {lang: [i for i, x in enumerate(labels) if x == lang] for lang in languages}
    share = max(1, LANDMARKS // len(languages))
    chosen = [i for lang in languages for i in members[lang][:share]]
    used = np.unique(np.concatenate([found[i] for i in chosen]))
    columns = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
    columns[used] = np.arange(len(used))
    marks = np.zeros((len(chosen), len(used)), dtype=np.float32)
    for row, i in zip(marks, chosen):
        row[columns[found[i]]] = 1 / np.sqrt(len(found[i]))
    whole = Model(languages, columns, marks, np.eye(len(chosen), dtype=np.float32))
    kernel = np.concatenate([whole.scores(found[k : k + _BATCH]) for k in range(0, len(found), _BATCH)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    strong = values > 1e-6 * values.max()
    project = vectors[:, strong] / np.sqrt(values[strong])
    features = kernel @ project
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many texts it has in the sample.
    weight = np.array([1 / len(members[x]) for x in labels])[:, None]
    gram = features.T @ (weight * features) + RIDGE / len(labels) * np.eye(features.shape[1])
    solved = project @ np.linalg.solve(gram, features.T @ (weight * target))
    return Model(languages, columns, marks, solved.astype(np.float32))


def _as_score(values: np.ndarray) -> np.ndarray:
    return np.clip((values.astype(np.float64) + 1) / 2, 0, 1).round(6)


def _with_known(model: Model, found: list[np.ndarray], labels: list[str]) -> Model:
    at = {lang: k for k, lang in enumerate(model.languages)}
    known = np.zeros((len(at), 1 << (SLOT_BITS - 3)), dtype=np.uint8)
    for slots, lang in zip(found, labels):
        np.bitwise_or.at(known[at[lang]], slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return replace(model, known=known)


def with_evidence(model: Model, found: list[np.ndarray], labels: list[str]) -> Model:
    """The model with what a text must share with the texts of a language to count as placed.

    Scores do not tell: short clean texts score as low as random letters. The share of a text's n-grams that are known of its
    language does. Each half of the texts is judged by a model of the other half, and rightly placed texts count; a language
    without any takes the least bound of the others.
    """
    shares: dict[str, list[float]] = {lang: [] for lang in model.languages}
    for part in (0, 1):
        half = fit_model(found[1 - part :: 2], labels[1 - part :: 2])
        if half is None:
            continue
        half = _with_known(half, found[1 - part :: 2], labels[1 - part :: 2])
        own, names = found[part::2], labels[part::2]
        for k in range(0, len(own), _BATCH):
            best = half.scores(own[k : k + _BATCH]).argmax(axis=1).tolist()
            for slots, lang, b in zip(own[k : k + _BATCH], names[k : k + _BATCH], best):
                if half.languages[b] == lang:
                    shares[lang].append(half.known_share(slots, b))
    lows = [np.quantile(x, LOWEST) if x else np.nan for x in shares.values()]
    least = np.nan_to_num(lows, nan=0.0 if np.isnan(lows).all() else float(np.nanmin(lows)))
    return replace(_with_known(model, found, labels), least=TOLERANCE * least)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots = [presence(t) for t in batch.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_rank"), batch.column("_lang"), pa.array(slots, pa.list_(pa.int32()))], names=["_rank", "_lang", "_slots"]
        )


def held_out(id_col: Column) -> Column:
    """Every fifth identifier, by the CRC-32 of its text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from labelled texts that are not held out."""
    ready(docs.sparkSession)
    source = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.col(f"`{lang_col}`").cast("string").alias("_lang"),
    )
    labelled = source.filter(F.col("_lang").isNotNull() & ~held_out(F.col("_id")) & F.col("_text").rlike(r"\p{L}"))
    languages = labelled.select("_lang").distinct().count()
    if not languages:
        return None
    each = min(PER_LANGUAGE, max(LEAST_EACH, SAMPLE // languages))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    ranked = labelled.select("_id", "_lang").withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= each)
    picked = ranked.withColumnRenamed("_id", "_pick").withColumnRenamed("_lang", "_as")
    if languages * each <= SAMPLE:
        picked = F.broadcast(picked)
    sampled = source.join(picked, (F.col("_id") == F.col("_pick")) & (F.col("_lang") == F.col("_as")))
    rows = sampled.select("_rank", "_lang", "_text").mapInArrow(_featurise, "_rank int, _lang string, _slots array<int>").collect()
    rows = sorted((r for r in rows if r["_slots"]), key=lambda r: (r["_lang"], r["_rank"], r["_slots"]))
    found, labels = [np.array(r["_slots"], dtype=np.int32) for r in rows], [r["_lang"] for r in rows]
    model = fit_model(found, labels)
    return model and with_evidence(model, found, labels)


def _predict(shared, placed: bool = False):
    """Names and scores; with ``placed``, texts that share too little with those of their language are unknown."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            named, scored = [UNKNOWN] * len(texts), np.zeros(len(texts))
            found = [presence(t) if model else None for t in texts]
            known = [i for i, s in enumerate(found) if s is not None]
            for k in range(0, len(known), _BATCH):
                part = known[k : k + _BATCH]
                values = model.scores([found[i] for i in part])
                best = values.argmax(axis=1)
                scored[part] = _as_score(values[np.arange(len(part)), best])
                for i, b in zip(part, best.tolist()):
                    if not placed or model.known_share(found[i], b) >= model.least[b]:
                        named[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "_text"), pa.array(named), pa.array(scored)],
                names=[*(c for c in batch.schema.names if c != "_text"), "lang_pred", "score"],
            )

    return read


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: identifier, ``held_out``, ``lang_pred``, ``score`` (0 to 1)."""
    spark = ready(docs.sparkSession)
    source = docs.select(
        F.col(f"`{id_col}`").alias("_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"),
        F.col(f"`{text_col}`").cast("string").alias("_text"),
    )
    schema = schema_of(("_id", type_of(docs, id_col)), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double"))
    return source.mapInArrow(_predict(spark.sparkContext.broadcast(model)), schema).withColumnRenamed("_id", id_col)


def identified(docs: DataFrame, model: Model | None, least: float, text_col: str = "text", placed: bool = False) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least ``least`` of score, with all their columns.

    With ``placed`` the text must also share as many n-grams with those of the language as ``fit`` derives from them.
    """
    spark = ready(docs.sparkSession)
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    kinds = [(f"_c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    scored = source.mapInArrow(
        _predict(spark.sparkContext.broadcast(model), placed), schema_of(*kinds, ("lang_pred", "string"), ("score", "double"))
    )
    kept = scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
