"""Count-based model: scores, filters, losses and epoch reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyloom.functions.text import simple_tokens
from storyloom.operators import batching, examples, metrics, ngram, sampling
from storyloom.plans.corpus_queries import SEED
from storyloom.plans.example_queries import BATCH, tokenizer_for
from storyloom.plans.registry import query
from storyloom.plans.sql import sql, unit
from storyloom.scratch import store, store_made
from storyloom.sources import corpus

WORLD, EPOCHS = 4, 4


def is_train():
    return F.pmod(F.col("doc_id"), F.lit(10)) != 0


def framed_store(docs, tok):
    """Ids of every whole story, stored for scoring."""
    return store_made(docs.sparkSession, lambda: examples.framed_ids(docs, tok, partitions=examples.text_partitions(docs)), "framed").df


def trained(spark, sf, alpha=1.0):
    """Tokenizer and model; pairs are counted from the tokens, so no story is encoded for it."""
    pairs, tok = train_pairs(spark, sf)
    return corpus.stories(spark, sf), tok, ngram.model_from_pairs(pairs, tok.vocab.size, alpha, 2)


def train_pairs(spark, sf):
    docs = corpus.stories(spark, sf)
    tok = tokenizer_for(docs)
    train = docs.filter("split = 'train'")
    return store_made(spark, lambda: ngram.bigram_counts(train, simple_tokens(F.col("text")), tok.vocab), "pairs"), tok


def bigram_scores(spark, sf):
    pairs, _ = train_pairs(spark, sf)
    return pairs.df.select("context", F.col("target").alias("token"), "freq", F.log("freq").alias("score"))


@query("ngram_counts", sql("counts", body="SELECT context, target, freq FROM counts"))
def ngram_counts(spark, sf):
    return train_pairs(spark, sf)[0].df


@query("trigram_counts", sql("framed", body="""SELECT context, target, count(*) AS freq FROM (SELECT unnest([CASE WHEN i = 2 THEN ids[1]::VARCHAR
    ELSE ids[i - 2]::VARCHAR || ' ' || ids[i - 1]::VARCHAR END for i in range(2, len(ids) + 1)]) AS context, unnest(ids[2:]) AS target
    FROM framed WHERE doc_id % 10 <> 0) GROUP BY context, target"""))
def trigram_counts(spark, sf):
    docs = corpus.stories(spark, sf)
    train = docs.filter("split = 'train'")
    parts = examples.text_partitions(train)
    framed = examples.framed_ids(train, tokenizer_for(docs), partitions=parts)
    return ngram.ngram_counts(framed, order=3, partitions=parts)


_TEMPERED = """SELECT context, token, score / 0.7 AS score FROM scores"""


@query("softmax", sql("scores", extra={
    "e": "SELECT context, token, exp(score / 0.7 - max(score / 0.7) OVER (PARTITION BY context)) AS e FROM scores"},
    body="SELECT context, token, round(e / sum(e) OVER (PARTITION BY context), 9) AS p FROM e"))
def softmax(spark, sf):
    scores = bigram_scores(spark, sf)
    cooled = scores.withColumn("score", sampling.tempered(F.col("score"), 0.7))
    return sampling.softmax(cooled, ["context"]).select("context", "token", F.round("p", 9).alias("p"))


@query("sanitize_scores", sql("ctx", "counts", "nv", body="""SELECT context, target AS token, round(CASE WHEN isnan(s) OR isinf(s) THEN 0
    ELSE greatest(least(s, 50), -50) END, 9) AS score FROM (SELECT context, target, CASE WHEN total - freq = 0 THEN 'inf'::DOUBLE
    ELSE 100 * ln(freq / (total - freq)::DOUBLE) END AS s FROM counts JOIN ctx USING (context))"""))
def sanitize_scores(spark, sf):
    """Scaled log odds of a token after its context: infinite for the only successor, beyond the clamp for many."""
    pairs, _ = train_pairs(spark, sf)
    totals = pairs.df.groupBy("context").agg(F.sum("freq").alias("total"))
    rest = F.col("total") - F.col("freq")
    odds = F.when(rest == 0, F.lit(float("inf"))).otherwise(100 * F.log(F.col("freq") / rest))
    return pairs.df.join(totals, "context").select(
        "context", F.col("target").alias("token"), F.round(sampling.sanitize(odds), 9).alias("score")
    )


@query("topk_ties", sql("scores", body="""SELECT context, token, freq FROM (SELECT *, rank() OVER (PARTITION BY context
    ORDER BY score DESC) AS r FROM scores) WHERE r <= 5"""))
def topk_ties(spark, sf):
    return sampling.top_k(bigram_scores(spark, sf), ["context"], 5, ties=True).select("context", "token", "freq")


@query("topk_exact", sql("scores", body="""SELECT context, token, freq FROM (SELECT *, row_number() OVER (PARTITION BY context
    ORDER BY score DESC, token) AS r FROM scores) WHERE r <= 5"""))
def topk_exact(spark, sf):
    return sampling.top_k(bigram_scores(spark, sf), ["context"], 5, ties=False).select("context", "token", "freq")


@query("topk_off", sql("scores", body="SELECT context, count(*) AS n, round(sum(freq)::DOUBLE, 3) AS mass FROM scores GROUP BY context"))
def topk_off(spark, sf):
    """A ``k`` of zero keeps every candidate, as does a mass of one."""
    pairs, _ = train_pairs(spark, sf)
    scores = pairs.df.select("context", F.col("target").alias("token"), F.log("freq").alias("score"))
    kept = sampling.candidates(scores, ["context"], k=0, p_limit=1.0)
    counts = pairs.df.select("context", F.col("target").alias("token"), "freq")
    return kept.join(counts, ["context", "token"]).groupBy("context").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("freq").cast("double"), 3).alias("mass")
    )


def candidate_sql(source: str, by: str, t: str, k: str, p: str, ties: bool, guarded: bool = False) -> dict[str, str]:
    """Temperature, top-k, top-p and normalisation restated; leaves ``cand`` with token, p and high."""
    cooled = f"score / greatest({t}, 0.1)" if guarded else f"score / {t}"
    if guarded:
        cooled = f"greatest(least({cooled}, 50), -50)"
    order = "rank() OVER (PARTITION BY {by} ORDER BY s DESC)" if ties else "row_number() OVER (PARTITION BY {by} ORDER BY s DESC, token)"
    return {
        "c0": f"SELECT *, {cooled} AS s FROM {source}",
        "c1": f"SELECT * FROM (SELECT *, {order.format(by=by)} AS r FROM c0) WHERE r <= {k}",
        "c2": f"SELECT *, exp(s - max(s) OVER (PARTITION BY {by})) AS e FROM c1",
        "c3": f"SELECT *, e / sum(e) OVER (PARTITION BY {by}) AS q FROM c2",
        "c4": f"""SELECT *, coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY q DESC, token
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c3""",
        "c5": f"SELECT * FROM c4 WHERE before <= {p} + 1e-9",
        "c6": f"SELECT *, q / sum(q) OVER (PARTITION BY {by}) AS p FROM c5",
        "cand": f"""SELECT *, sum(p) OVER (PARTITION BY {by} ORDER BY p DESC, token
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM c6""",
    }


@query("topp", sql("scores", extra=candidate_sql("scores", "context", "1.0", "50", "0.9", True),
    body="SELECT context, token, round(p, 9) AS p FROM cand"))
def topp(spark, sf):
    kept = sampling.candidates(bigram_scores(spark, sf), ["context"])
    return kept.select("context", "token", F.round("p", 9).alias("p"))


@query("greedy_next", sql("scores", body="""SELECT context, token FROM (SELECT *, row_number() OVER (PARTITION BY context
    ORDER BY score DESC, token) AS r FROM scores) WHERE r = 1"""))
def greedy_next(spark, sf):
    return sampling.greedy(bigram_scores(spark, sf), ["context"]).select("context", "token")


_LAST_OF_FIRST = "SELECT doc_id, CASE WHEN len(first) > 0 THEN first[-1] END AS context FROM sides"


def back_off_sql(extra: dict[str, str]) -> dict[str, str]:
    """Add the empty context, -1, to the scores under the name ``all_scores``."""
    start = {
        "uni": "SELECT target AS token, sum(freq) AS f FROM counts GROUP BY target",
        "all_scores": """SELECT context, token, score FROM scores UNION ALL SELECT -1, token, ln(f) FROM uni""",
    }
    return {**start, **extra}


@query("sample_next", sql("scores", "sides", extra=back_off_sql({
    **candidate_sql("all_scores", "context", "1.0", "50", "0.9", True),
    "ask": f"SELECT doc_id, CASE WHEN context IN (SELECT context FROM counts) THEN context ELSE -1 END AS context, {unit('42', 'doc_id', '0')} AS u FROM ({_LAST_OF_FIRST})"}),
    body="""SELECT doc_id, arg_min(token, high) AS token FROM ask JOIN cand USING (context) WHERE high > u GROUP BY doc_id"""))
def sample_next(spark, sf):
    docs = corpus.stories(spark, sf)
    pairs, tok = train_pairs(spark, sf)
    sides = tok.encode(examples.segmented(examples.keyed(docs), 2), {"first": F.col("first_sentence")}, 512)
    asked = sides.select("doc_id", F.try_element_at("first", F.lit(-1)).alias("context"))
    table = sampling.draw_table(pairs.df)
    drawn = sampling.draw(asked, table, sampling.prompt_draw(SEED, "doc_id", 0), ["doc_id"])
    return drawn.select("doc_id", "token")


SETTINGS = [
    {"temperature": 0.5}, {"temperature": 1.0}, {"temperature": 1.5},
    {"top_k": 10}, {"top_k": 100}, {"top_p": 0.5}, {"top_p": 0.99},
]
_SETTING_ROWS = ", ".join(
    f"({i}, {s.get('temperature', 1.0)}, {s.get('top_k', 50)}, {s.get('top_p', 0.9)})" for i, s in enumerate(SETTINGS)
)


@query("param_sweep", sql("scores", "sides", extra={
    "settings": f"SELECT i::BIGINT AS setting, t::DOUBLE AS t, k::BIGINT AS k, p::DOUBLE AS lim FROM (VALUES {_SETTING_ROWS}) v(i, t, k, p)",
    "asked": f"SELECT doc_id, context FROM ({_LAST_OF_FIRST}) WHERE context IS NOT NULL",
    "wide": "SELECT setting, t, k, lim, context, token, score FROM scores, settings WHERE context IN (SELECT context FROM asked)",
    **candidate_sql("wide", "setting, context", "t", "k", "lim", True)},
    body="""SELECT doc_id, setting, n_kept, round(top_p, 9) AS top_p, token FROM asked JOIN (SELECT setting, context, count(*) AS n_kept, max(p) AS top_p
    FROM cand GROUP BY setting, context) USING (context) JOIN (SELECT setting, context, token FROM cand WHERE high = p) USING (setting, context)"""))
def param_sweep(spark, sf):
    """Each prompt under every setting: how many candidates stay, and the likeliest one.

    Settings are applied to the distinct contexts that prompts end in; prompts are joined to the outcome.
    """
    docs = corpus.stories(spark, sf)
    pairs, tok = train_pairs(spark, sf)
    sides = tok.encode(examples.segmented(examples.keyed(docs), 2), {"first": F.col("first_sentence")}, 512)
    asked = sides.select("doc_id", F.try_element_at("first", F.lit(-1)).alias("context")).filter("context IS NOT NULL")
    wanted = asked.select("context").distinct()
    scores = pairs.df.join(wanted, "context", "left_semi").select(
        "context", F.col("target").alias("token"), F.log("freq").alias("score")
    )
    swept = sampling.decode_settings(scores, SETTINGS)
    by = ["setting", "context"]
    limits = sampling.candidates(swept, by, F.col("temperature"), F.col("top_k"), F.col("top_p"))
    best = sampling.with_bounds(limits, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.max("p").alias("top_p"),
        F.max(F.when(F.col("place") == 1, F.col("token"))).alias("token"),
    )
    outcome = store(
        best.groupBy("context").agg(F.collect_list(F.struct("setting", "n_kept", "top_p", "token")).alias("runs")), "sweep"
    )
    from storyloom.operators.lookup import lookup_join

    joined = lookup_join(asked, outcome, ["context"], ["doc_id"])
    runs = joined.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")
    return runs.select("doc_id", "setting", "n_kept", F.round("top_p", 9).alias("top_p"), "token")


def _batched_losses(spark, sf, smoothing=0.0, alpha=1.0, batch=BATCH):
    docs, tok, model = trained(spark, sf, alpha)
    losses = store_made(spark, lambda: ngram.document_losses(framed_store(docs, tok), model, smoothing), "losses").df
    placed = batching.assign_batches(docs.select("doc_id"), batch, [], [F.col("doc_id")])
    return ngram.batch_losses(losses, placed, ["batch_id"])


@query("batch_loss", sql("doc_loss", "numbered", body="""SELECT batch_id, round(sum(nll) / sum(n), 9) AS loss, sum(n)::BIGINT AS n_tokens
    FROM numbered JOIN doc_loss USING (doc_id) GROUP BY batch_id"""))
def batch_loss(spark, sf):
    return _batched_losses(spark, sf).select("batch_id", F.round("loss", 9).alias("loss"), "n_tokens")


@query("batch_loss_smoothed", sql("seq_pairs", "counts", "ctx", "nv", "numbered", body="""SELECT batch_id, round(avg(0.9 * nll + 0.1 * mean), 9) AS loss FROM (
    SELECT p.doc_id, -ln((coalesce(c.freq, 0) + 1) / (coalesce(x.total, 0) + v)::DOUBLE) AS nll,
    ln(coalesce(x.total, 0) + v) - coalesce(x.log_sum, 0) / v AS mean FROM seq_pairs p, nv
    LEFT JOIN counts c ON c.context = p.context AND c.target = p.target LEFT JOIN ctx x ON x.context = p.context) JOIN numbered USING (doc_id)
    GROUP BY batch_id"""))
def batch_loss_smoothed(spark, sf):
    return _batched_losses(spark, sf, smoothing=0.1).select("batch_id", F.round("loss", 9).alias("loss"))


_RAW_BATCHES = {
    "raw": """SELECT p.doc_id, count(*) AS n, sum(CASE WHEN x.total IS NULL THEN 'nan'::DOUBLE WHEN c.freq IS NULL THEN 'inf'::DOUBLE
        ELSE -ln(c.freq / x.total::DOUBLE) END) AS nll FROM seq_pairs p
        LEFT JOIN counts c ON c.context = p.context AND c.target = p.target LEFT JOIN ctx x ON x.context = p.context GROUP BY p.doc_id""",
    "small": """SELECT batch_id, sum(nll) / sum(n) AS loss FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 4)::BIGINT
        AS batch_id FROM framed) JOIN raw USING (doc_id) GROUP BY batch_id""",
}


@query("valid_losses", sql("framed", "seq_pairs", "counts", "ctx", extra=_RAW_BATCHES, body="""SELECT batch_id, round(loss, 9) AS loss FROM small
    WHERE NOT isnan(loss) AND NOT isinf(loss) AND loss <= 1000"""))
def valid_losses(spark, sf):
    """Without smoothing, a pair never seen in training has infinite loss; those batches are dropped."""
    raw = _batched_losses(spark, sf, alpha=0.0, batch=4)
    return metrics.valid_losses(raw).select("batch_id", F.round("loss", 9).alias("loss"))


_RUN = {
    "runs": """SELECT e::INT AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY md5('42:' || e::VARCHAR || ':' || doc_id::VARCHAR), doc_id)
        AS rn, count(*) OVER (PARTITION BY e) AS total FROM docs, range(4) r(e) WHERE split = 'train'""",
    "dealt": """SELECT epoch, doc_id, rn FROM runs UNION ALL SELECT epoch, doc_id, rn + total FROM runs
        WHERE rn <= ceil(total / 4.0) * 4 - total""",
    "steps": """SELECT epoch, ((rn - 1) % 4)::INT AS rank, ((rn - 1) // 4 // 32)::BIGINT AS batch_id, sum(nll) / sum(n) AS loss,
        sum(n)::BIGINT AS n_tokens FROM dealt JOIN doc_loss USING (doc_id) GROUP BY ALL""",
}


def training_metrics(spark, sf):
    """Loss of every batch of every rank over a few epochs of the seeded shuffle.

    Stories are scored once; epochs only regroup them.
    """
    docs, tok, model = trained(spark, sf)
    train = docs.filter(is_train())
    losses = store_made(spark, lambda: ngram.document_losses(framed_store(train, tok), model), "losses").df
    order = batching.epoch_order(losses.select("doc_id"), SEED, EPOCHS)
    dealt = batching.shard_positions(order, WORLD).withColumn("batch_id", F.floor(F.col("slot") / BATCH).cast("bigint"))
    return ngram.batch_losses(losses, dealt, ["epoch", "rank", "batch_id"])


def _run_sql(body: str) -> str:
    return sql("doc_loss", "docs", extra=_RUN, body=body)


@query("epoch_loss", _run_sql("SELECT epoch, round(avg(loss), 9) AS epoch_loss, round(avg(loss), 9) AS epoch_loss_valid, count(*) AS batches FROM steps GROUP BY epoch"))
def epoch_loss(spark, sf):
    report = metrics.epoch_loss(training_metrics(spark, sf))
    return report.select("epoch", F.round("epoch_loss", 9).alias("epoch_loss"), F.round("epoch_loss_valid", 9).alias("epoch_loss_valid"), "batches")


@query("rank_mean_loss", _run_sql("""SELECT epoch, round(avg(l), 9) AS loss, count(*) AS ranks FROM
    (SELECT epoch, rank, avg(loss) AS l FROM steps GROUP BY epoch, rank) GROUP BY epoch"""))
def rank_mean_loss(spark, sf):
    return metrics.rank_mean_loss(training_metrics(spark, sf)).select("epoch", F.round("loss", 9).alias("loss"), "ranks")


@query("best_epochs", _run_sql("""SELECT epoch, round(loss, 9) AS loss FROM (SELECT *, min(loss) OVER (ORDER BY epoch
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT epoch, avg(loss) AS loss FROM steps GROUP BY epoch))
    WHERE best IS NULL OR loss < best"""))
def best_epochs(spark, sf):
    by_epoch = metrics.epoch_loss(training_metrics(spark, sf)).select("epoch", F.col("epoch_loss").alias("loss"))
    return metrics.best_epochs(by_epoch).select("epoch", F.round("loss", 9).alias("loss"))


@query("log_interval_rows", _run_sql("SELECT epoch, rank, batch_id, round(loss, 9) AS loss FROM steps WHERE (batch_id + 1) % 3 = 0"))
def log_interval_rows(spark, sf):
    return metrics.every_nth(training_metrics(spark, sf), 3).select("epoch", "rank", "batch_id", F.round("loss", 9).alias("loss"))


_INFILL_LOSS = {
    "steps_of": """SELECT doc_id, unnest((first || middle)[len(first):len(first) + len(middle) - 1]) AS context,
        unnest((first || middle)[len(first) + 1:]) AS target FROM mids WHERE len(middle) > 0 AND len(first) > 0
        UNION ALL SELECT doc_id, unnest(middle[1:len(middle) - 1]), unnest(middle[2:]) FROM mids WHERE len(middle) > 1 AND len(first) = 0""",
    "by_story": """SELECT s.doc_id, count(*) AS n_steps, avg(-ln((coalesce(c.freq, 0) + 1) / (coalesce(x.total, 0) + (SELECT v FROM nv))::DOUBLE)) AS loss
        FROM steps_of s LEFT JOIN counts c ON c.context = s.context AND c.target = s.target LEFT JOIN ctx x ON x.context = s.context GROUP BY s.doc_id""",
}


def story_losses(spark, sf):
    docs, tok, model = trained(spark, sf)
    return store_made(spark, lambda: ngram.infill_losses(examples.middle_truth(docs, tok), model), "losses").df


@query("infill_loss", sql("mids", "counts", "ctx", "nv", extra=_INFILL_LOSS, body="SELECT doc_id, n_steps, round(loss, 9) AS loss FROM by_story"))
def infill_loss(spark, sf):
    return story_losses(spark, sf).select("doc_id", "n_steps", F.round("loss", 9).alias("loss"))


@query("validation_infill_loss", sql("mids", "counts", "ctx", "nv", extra=_INFILL_LOSS, body="""SELECT CASE WHEN doc_id % 10 = 0 THEN 'validation'
    ELSE 'train' END AS split, count(*) AS stories, round(avg(loss), 9) AS loss FROM by_story GROUP BY ALL"""))
def validation_infill_loss(spark, sf):
    scored = story_losses(spark, sf).withColumn("split", corpus.split_of())
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("stories"), F.round(F.avg("loss"), 9).alias("loss"))
