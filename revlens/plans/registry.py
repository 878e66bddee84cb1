"""Every query by name: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.numeric import r6
from revlens.functions.text import count_tokens, tokens
from revlens.operators import by_text as texts
from revlens.operators import classification, prompting, reports, scoring, unify
from revlens.operators.backends import offline_calls, python_backend
from revlens.operators.infer import batch_infer, infer_to_log, log_calls, pending
from revlens.operators.lcs import rouge_l
from revlens.operators.nearest_reference import best_reference
from revlens.operators.noise import add_noise
from revlens.operators.overlap import bleu, meteor, rouge_n
from revlens.operators.perplexity import perplexity
from revlens.operators.polarity import lexicon_from_labels, polarity
from revlens.operators.soft_match import soft_match
from revlens.plans import jobs
from revlens.session import materialise, new_table_path, ship_package
from revlens.sources import corpus
from revlens.sources.prompts import TEMPLATES, render
from revlens.sources.catalog import MODEL_NAMES, MODELS, models_table, tasks_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
UNLISTED = "Unlisted Model"
LOWERED_IN_REPORT = ("Gemini 2.0 Flash",)


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    _QUERIES[fn.__name__.removesuffix("_scores")] = run
    return run


def all_queries() -> dict[str, Query]:
    from revlens.plans import stored, trained  # noqa: F401 - they register their queries here

    return dict(_QUERIES)


def present(df: DataFrame) -> DataFrame:
    """Engine-neutral column types for the result: bigint, double, string."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(name))
    return df.select(*out)


def customer_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.reviews(spark, sf).withColumn("dataset", F.lit("customer"))


def _with_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All reviews, with a label where one is known."""
    return customer_rows(spark, sf).join(corpus.truth(spark, sf), "review_id", "left")


def evaluation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.evaluation_set(
        corpus.reviews(spark, sf), corpus.truth(spark, sf), corpus.edge_cases(spark)
    )


def _sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.scored_sentiment(offline_calls(evaluation_rows(spark, sf), "sentiment"))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.priced_text(offline_calls(customer_rows(spark, sf), "summary"))


def _responses(spark: SparkSession, sf: str, version: int = 1) -> DataFrame:
    open_reviews = unify.unreplied(customer_rows(spark, sf))
    lowered = LOWERED_IN_REPORT if version == 2 else ()
    return jobs.priced_text(offline_calls(open_reviews, "response", version), lowered)


def _summary_pairs(spark: SparkSession, sf: str, ids=None) -> DataFrame:
    refs = corpus.reference_summaries(corpus.reviews(spark, sf))
    return jobs.summary_pairs(_summaries(spark, sf), refs, ids)


def _response_pairs(spark: SparkSession, sf: str, ids=None) -> DataFrame:
    refs = corpus.reference_responses(spark, sf)
    calls = _responses(spark, sf).drop("raw_output")  # its text is in the output, once is enough
    return jobs.response_pairs(calls, refs, ids, replies_per_user(spark, sf))


def replies_per_user(spark: SparkSession, sf: str, n_models: int = len(MODEL_NAMES)) -> DataFrame:
    """How many replies each user gets: open reviews times models, before the fan-out."""
    open_reviews = unify.unreplied(customer_rows(spark, sf))
    n = (F.count("*") * n_models).alias("n_rows")
    return open_reviews.groupBy("user_name").agg(n)


def _pairs(spark: SparkSession, sf: str, ids=None) -> DataFrame:
    """Finished summary and response calls with their references."""
    columns = ("task", "review_id", "model", "output", "reference", "error")
    if ids is not None:
        columns = (*columns, "r_ids")
    both = _summary_pairs(spark, sf, ids).select(*columns).unionByName(
        _response_pairs(spark, sf, ids).select(*columns)
    )
    return _finished(both)


def _finished(calls: DataFrame) -> DataFrame:
    """Calls that have an output. Asked of the error and not of the output, so that
    the filter does not build the output a second time."""
    return calls.filter(F.col("error").isNull())


# --- extraction -----------------------------------------------------------------


@query
def reviews_unified(spark, sf):
    return present(jobs.extract(corpus.raw_google(spark, sf), corpus.raw_appstore(spark, sf)))


@query
def reviews_without_id(spark, sf):
    """English reviews of exports that carry no id: keyed by a digest of what tells a
    review, equal rows counted as copies of one."""
    google = corpus.raw_google(spark, sf).filter("lang = 'en'").drop("review_id")
    appstore = corpus.raw_appstore(spark, sf).filter("lang = 'en'").drop("review_id")
    return present(unify.unify_by_content(google, appstore))


@query
def reviews_titled(spark, sf):
    both = unify.unify(corpus.raw_google(spark, sf), corpus.raw_appstore(spark, sf), titles=True)
    return present(both.select("review_id", "platform", "title", "is_replied"))


@query
def reviews_sample(spark, sf):
    both = jobs.extract(corpus.raw_google(spark, sf), corpus.raw_appstore(spark, sf))
    return present(unify.with_position(unify.sample_per_platform(both, 5)))


@query
def source_profile(spark, sf):
    both = unify.unify(corpus.raw_google(spark, sf), corpus.raw_appstore(spark, sf), titles=True)
    return present(unify.source_profile(both))


@query
def reviews_distinct(spark, sf):
    return present(texts.distinct_reviews(corpus.reviews(spark, sf)))


@query
def by_text_first(spark, sf):
    reviews = corpus.reviews(spark, sf)
    return present(texts.first_reference_by_text(reviews, corpus.reference_summaries(reviews)))


@query
def by_text_last(spark, sf):
    done = _finished(_summaries(spark, sf))
    calls = done.select("review_id", "model", "output")
    return present(texts.last_output_by_text(calls, corpus.reviews(spark, sf)))


# --- prompts, tokens, cost ------------------------------------------------------


@query
def prompts(spark, sf):
    """Each task's prompt per review, in both versions, with its token count and
    output budget."""
    rows = customer_rows(spark, sf).select("dataset", "review_id", "user_name", "review")
    budget = tasks_table(spark).select("task", "max_tokens", "temperature")
    kinds = (("sentiment", 1), ("summary", 1), ("response", 1), ("response", 2))
    made = F.array(
        *[
            F.struct(
                F.lit(task).alias("task"), F.lit(version).alias("version"),
                render(TEMPLATES[task, version]).alias("prompt"),
            )
            for task, version in kinds
        ]
    )  # one scan: the kinds are rows of an array, not further reads
    out = rows.select("review_id", F.explode(made).alias("_p")).select("review_id", "_p.*")
    out = out.withColumn("input_tokens", count_tokens(F.col("prompt")))
    return present(out.join(F.broadcast(budget), "task"))


@query
def prompt_messages(spark, sf):
    """The end-to-end report's chat messages per (review, model); the text is given
    by its digest and length, as each is repeated for every model."""
    reqs = prompting.messages(
        prompting.requests(unify.unreplied(customer_rows(spark, sf)), "response", version=2)
    )
    return present(
        reqs.select("review_id", "model", F.posexplode("messages").alias("pos", "m")).select(
            "review_id", "model", "pos", F.col("m.role").alias("role"),
            F.md5("m.content").alias("content_md5"),
            F.length("m.content").alias("content_length"),
        )
    )


def _all_calls(spark: SparkSession, sf: str) -> DataFrame:
    return (
        jobs.priced_text(offline_calls(_with_labels(spark, sf), "sentiment"))
        .drop("label")
        .unionByName(_summaries(spark, sf))
        .unionByName(_responses(spark, sf))
    )


@query
def token_cost(spark, sf):
    return present(
        _all_calls(spark, sf).select(
            "task", "review_id", "model", "input_tokens", "output_tokens", "cost_usd", "cost_exact"
        )
    )


@query
def llm_response_parse(spark, sf):
    """Chat responses as JSON text, some of them not JSON, read back into calls."""
    calls = offline_calls(customer_rows(spark, sf), "summary").filter(F.col("error").isNull())
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(F.struct(F.col("raw_output").alias("content")).alias("message"))
            ).alias("choices"),
            F.struct(
                F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens")
            ).alias("usage"),
        )
    )
    broken = F.pmod(F.col("review_tokens") + F.length("model"), F.lit(23)) == 5
    sent = calls.select(
        "review_id", "model", F.when(broken, F.lit("<html>502</html>")).otherwise(body).alias("body")
    )
    return present(scoring.parse_chat_response(sent))


@query
def call_errors(spark, sf):
    """Error rows: backend failures and a model that is not in the catalogue, with
    the message also in the output column as the legacy view has it."""
    calls = offline_calls(
        customer_rows(spark, sf), "summary", models=(*MODEL_NAMES, UNLISTED)
    )
    failed = jobs.priced_text(calls).filter(F.col("error").isNotNull())
    legacy = scoring.legacy_error_as_output(failed)
    return present(
        legacy.select("review_id", "model", "raw_output", "output", "error", "elapsed_s", "cost_usd")
    )


# --- sentiment ------------------------------------------------------------------


@query
def sentiment_validated(spark, sf):
    scored = jobs.scored_sentiment(offline_calls(_with_labels(spark, sf), "sentiment"))
    return present(
        scored.select("review_id", "model", "label", "output", "prediction", "ambiguous")
    )


@query
def confusion(spark, sf):
    return present(classification.confusion(_sentiment(spark, sf)))


@query
def sentiment_leaderboard(spark, sf):
    return present(classification.sentiment_leaderboard(_sentiment(spark, sf)))


@query
def model_rank(spark, sf):
    board = classification.rank_models(
        classification.sentiment_leaderboard(_sentiment(spark, sf))
    )
    return present(board.select("dataset", "model", "f1", "model_rank"))


@query
def noisy_reviews(spark, sf):
    reviews = corpus.reviews(spark, sf)
    noisy = add_noise(F.col("review"), F.col("review_id"))
    return present(reviews.select("review_id", noisy.alias("noisy_review")))


@query
def noise_robustness(spark, sf):
    board = classification.sentiment_leaderboard(_sentiment(spark, sf))
    return present(classification.robustness(board))


# --- wide tables ----------------------------------------------------------------


@query
def sentiment_wide(spark, sf):
    return present(
        reports.wide(
            _sentiment(spark, sf),
            ("dataset", "review_id", "label"),
            "prediction",
            (("elapsed_s", "response_time"), ("cost_usd", "cost")),
        )
    )


@query
def summary_wide(spark, sf):
    return present(reports.wide(_summaries(spark, sf), ("review_id",), "output"))


@query
def response_wide(spark, sf):
    return present(reports.wide(_responses(spark, sf), ("review_id",), "output"))


# --- text quality ---------------------------------------------------------------

_PAIR = ("task", "review_id", "model")


def _rouge_n(pairs: DataFrame) -> DataFrame:
    scores = pairs.select(*_PAIR, rouge_n(F.col("output"), F.col("reference")).alias("_s"))
    return scores.select(
        *_PAIR,
        *[
            r6(F.col(f"_s.n{n}.{mode}")).alias(f"rouge_{n}_{mode}")
            for n in (1, 2)
            for mode in ("set", "multiset")
        ],
    )


def _metric(name: str, score: Callable[[Column, Column], Column]):
    def of(pairs: DataFrame) -> DataFrame:
        return pairs.select(*_PAIR, r6(score(F.col("output"), F.col("reference"))).alias(name))

    return of


def _word_ids(n_vectors: int) -> Callable[[Column], Column]:
    def ids(text: Column) -> Column:
        return corpus.word_vector_ids(tokens(F.lower(text)), n_vectors)

    return ids


def _soft_match(spark: SparkSession, sf: str, pairs_of, near=("review_id",), **how) -> DataFrame:
    vectors, n = corpus.word_vectors(spark, sf)
    ids = _word_ids(n)
    pairs = pairs_of(spark, sf, ids).select(*_PAIR, ids(F.col("output")).alias("c_ids"), "r_ids")
    scored = soft_match(pairs, vectors, _PAIR, near=near, **how)
    return present(scored.withColumn("soft_f1", r6(F.col("soft_f1"))))


def _turn_pairs(spark: SparkSession, sf: str, ids=None) -> DataFrame:
    """Whole turns of the conversations as pairs of texts."""
    pairs = corpus.turn_pairs(spark, sf).filter(F.col("output").isNotNull())
    return pairs if ids is None else pairs.withColumn("r_ids", ids(F.col("reference")))


@query
def rouge_n_scores(spark, sf):
    return present(_rouge_n(_pairs(spark, sf)))


@query
def rouge_n_turns(spark, sf):
    return present(_rouge_n(_turn_pairs(spark, sf)))


@query
def rouge_l_scores(spark, sf):
    return present(_metric("rouge_l", rouge_l)(_pairs(spark, sf)))


@query
def rouge_l_turns(spark, sf):
    return present(_metric("rouge_l", rouge_l)(_turn_pairs(spark, sf)))


@query
def bleu_scores(spark, sf):
    return present(_metric("bleu", bleu)(_pairs(spark, sf)))


@query
def bleu_turns(spark, sf):
    return present(_metric("bleu", bleu)(_turn_pairs(spark, sf)))


@query
def meteor_scores(spark, sf):
    return present(_metric("meteor", meteor)(_pairs(spark, sf)))


@query
def meteor_turns(spark, sf):
    return present(_metric("meteor", meteor)(_turn_pairs(spark, sf)))


@query
def soft_match_f1(spark, sf):
    return _soft_match(spark, sf, _pairs)


@query
def soft_match_joined(spark, sf):
    """The same scores by the plan for a vector table too large to broadcast."""
    return _soft_match(spark, sf, _pairs, broadcast_limit=0)


@query
def soft_match_f1_turns(spark, sf):
    return _soft_match(spark, sf, _turn_pairs)


@query
def perplexity_scores(spark, sf):
    columns = (*_PAIR, "output")
    outputs = _finished(_summaries(spark, sf)).select(*columns).unionByName(
        _finished(_responses(spark, sf)).select(*columns)
    )
    model = jobs.bigram_model(corpus.reviews(spark, sf))
    return present(perplexity(outputs, model, _PAIR, near=("review_id",)))


@query
def perplexity_turns(spark, sf):
    model = jobs.bigram_model(corpus.reviews(spark, sf))
    return present(perplexity(_turn_pairs(spark, sf), model, _PAIR))


@query
def best_reference_scores(spark, sf):
    done = _finished(_responses(spark, sf))
    replies = done.select("review_id", "model", "user_name", "output")
    best = best_reference(
        replies, corpus.reference_responses(spark, sf), ("review_id", "model"),
        rows_per_user=replies_per_user(spark, sf),
    )
    return present(
        best.select(
            "review_id", "model", "reference", "ref_no", r6(F.col("similarity")).alias("similarity")
        )
    )


@query
def polarity_scores(spark, sf):
    reviews = corpus.reviews(spark, sf)
    lexicon = lexicon_from_labels(reviews, corpus.truth(spark, sf))
    return present(polarity(reviews, lexicon, ["review_id"]))


@query
def compression(spark, sf):
    both = _summaries(spark, sf).unionByName(_responses(spark, sf))
    ratio = r6(scoring.compression_ratio(F.col("review_tokens"), F.col("output")))
    return present(both.select(*_PAIR, ratio.alias("compression")))


# --- leaderboards and reports ---------------------------------------------------


def quality_of(spark: SparkSession, sf: str, pairs_of) -> DataFrame:
    vectors, n = corpus.word_vectors(spark, sf)
    ids = _word_ids(n)
    return jobs.quality_board(
        pairs_of(spark, sf, ids), corpus.reviews(spark, sf), vectors, ids
    )


@query
def summary_leaderboard(spark, sf):
    return present(quality_of(spark, sf, _summary_pairs))


@query
def response_leaderboard(spark, sf):
    return present(quality_of(spark, sf, _response_pairs))


@query
def leaderboard_long(spark, sf):
    board = classification.sentiment_leaderboard(_sentiment(spark, sf))
    values = ("accuracy", "f1", "recall", "precision", "total_response_time", "total_cost")
    return present(reports.long_metrics(board, ("dataset", "model"), values))


@query
def tone_alignment(spark, sf):
    reviews = corpus.reviews(spark, sf)
    lexicon = lexicon_from_labels(reviews, corpus.truth(spark, sf))
    return present(
        jobs.tone_alignment(unify.unreplied(reviews), _responses(spark, sf), lexicon)
    )


def report_responses(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf, version=2)


def report_sentiment(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    labelled = rows.join(corpus.truth(spark, sf), "review_id", "left")
    return jobs.scored_sentiment(offline_calls(labelled, "sentiment", 2))


@query
def e2e_detail(spark, sf):
    rows = unify.unreplied(customer_rows(spark, sf))
    return present(
        reports.e2e_detail(
            report_sentiment(spark, sf, rows),
            jobs.priced_text(offline_calls(rows, "summary", 2)),
            _responses(spark, sf, version=2),
        )
    )


@query
def e2e_totals(spark, sf):
    rows = customer_rows(spark, sf)
    columns = ("task", "model", "elapsed_s", "cost_usd")
    parts = (
        jobs.priced_text(offline_calls(_with_labels(spark, sf), "sentiment", 2)),
        jobs.priced_text(offline_calls(rows, "summary", 2)),
        _responses(spark, sf, version=2),
    )
    first, *rest = [p.select(*columns) for p in parts]
    for part in rest:
        first = first.unionByName(part)
    return present(reports.e2e_totals(first))


# --- batch calls ----------------------------------------------------------------


def stand_in_factory(model: str, task: str, budget: int):
    return python_backend(model, task, budget)


# The catalogue's pace is meant for a provider; the stand-in is asked a hundred
# thousand times as fast, by the same slots.
QUICK = tuple(dataclasses.replace(m, pace_seconds=m.pace_seconds / 100_000) for m in MODELS)


@query
def batch_infer_log(spark, sf):
    """Summary calls through the batch operator, written as a log and read back."""
    reqs = prompting.requests(customer_rows(spark, sf), "summary")
    factories = {m: stand_in_factory for m in MODEL_NAMES}
    log = log_calls(batch_infer(reqs, "summary", factories, QUICK), "batch-infer-log")
    return present(
        log.select(
            "task", "dataset", "review_id", "model", "review_tokens", "input_tokens",
            "raw_output", "completion_tokens", "error",
        )
    )


def _board_of_log(log: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The leaderboard of written calls; response times come from a clock here."""
    known = evaluation.select("dataset", "review_id", "label")
    board = jobs.sentiment_comparison(log.join(known, ["dataset", "review_id"]))
    return present(board.drop("total_response_time"))


@query
def sentiment_leaderboard_from_log(spark, sf):
    """Requests, batch calls in committed chunks, the written log, then the scores."""
    evaluation = evaluation_rows(spark, sf)
    reqs = prompting.requests(evaluation, "sentiment")
    factories = {m: stand_in_factory for m in MODEL_NAMES}
    path = new_table_path(spark, "sentiment-log")
    log = infer_to_log(reqs, path, "sentiment", factories, QUICK)
    return _board_of_log(log, evaluation)


def _flaky_factory(model: str, task: str, budget: int):
    """Fails every fifth review at its first attempt."""
    call = python_backend(model, task, budget)

    def ask(request):
        if request["attempt"] == 1 and request["review_id"] % 5 == 0:
            raise ConnectionError("first attempt lost")
        return call(request)

    return ask


@query
def rerun_leaderboard(spark, sf):
    """Calls that fail, a second run that asks for them alone, and the scores of both
    runs' log: each call key counts once."""
    evaluation = evaluation_rows(spark, sf)
    reqs = prompting.requests(evaluation, "sentiment")
    factories = {m: _flaky_factory for m in MODEL_NAMES}
    path = new_table_path(spark, "rerun-log")
    infer_to_log(reqs, path, "sentiment", factories, QUICK)
    log = infer_to_log(reqs, path, "sentiment", factories, QUICK)
    return _board_of_log(log, evaluation)


@query
def pending_calls(spark, sf):
    """What a rerun still has to ask: requests whose logged call failed."""
    rows = _with_labels(spark, sf)
    reqs = prompting.requests(rows, "sentiment")
    log = offline_calls(rows, "sentiment")
    left = pending(reqs, log.withColumn("attempt", F.lit(1)))
    return present(left.select("task", "dataset", "review_id", "model", "input_tokens"))


@query
def model_catalog_use(spark, sf):
    """The pricing dimension against the calls it prices."""
    calls = _all_calls(spark, sf).groupBy("model").agg(
        F.count("*").alias("n_calls"), F.sum("cost_usd").cast("decimal(24,6)").alias("total_cost")
    )
    dim = models_table(spark).select("model", "price_in", "price_out", "output_count")
    return present(dim.join(calls, "model", "left"))
