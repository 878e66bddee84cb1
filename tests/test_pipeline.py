"""Sources, calls, scoring, reports and joins on small hand-written rows."""

import datetime as dt
import math
import os
import random
import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlens.functions.skew import hot_key_join
from revlens.operators import by_text, classification, infer, prompting, reports, scoring, unify
from revlens.operators.backends import offline_calls, python_backend
from revlens.operators.noise import REPLACEMENTS, add_noise
from revlens.sources import references, reviews
from revlens.sources.catalog import LABELS, MODEL_NAMES, MODELS, Model, models_table
from revlens.streaming.landing import stream_reviews

ROW = "dataset string, review_id bigint, user_name string, review string, label string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("customer", i, f"u{i % 3}", f"word{i} and {{user_name}} $1 more", LABELS[i % 3])
         for i in range(60)],
        ROW,
    )


# --- sources ---


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_landed_files(spark, tmp_path, fmt):
    raw = spark.sql(
        "SELECT CAST(NULL AS bigint) review_id, timestamp_ntz'2025-03-01 10:00:00' at, "
        "'fine, \"really\"' content, CAST(NULL AS string) reviewCreatedVersion, 'ann' userName, "
        "'thanks' replyContent, 'en' lang, 'us' country UNION ALL "
        "SELECT NULL, timestamp_ntz'2025-03-02 10:00:00', 'bad', 'v1', 'bob', NULL, 'de', 'us'"
    )
    raw.write.mode("overwrite").option("header", True).option("escape", '"').format(fmt).save(
        str(tmp_path / "g")
    )
    got = reviews.read_google(spark, str(tmp_path / "g"), fmt, lang="en", country="us")
    out = unify.unify_google(got, titles=True).collect()
    assert len(out) == 1
    assert (out[0].title, out[0].is_replied, out[0].date) == ("No title", "Yes", dt.date(2025, 3, 1))
    assert out[0].review == 'fine, "really"' and out[0].review_id is not None
    with pytest.raises(ValueError):
        reviews.read_google(spark, "x", "xml")


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.sql(
        "SELECT id AS review_id, timestamp_ntz'2025-03-01 10:00:00' at, concat('t', id) content, "
        "'v' reviewCreatedVersion, 'ann' userName, CAST(NULL AS string) replyContent, 'en' lang, "
        "'us' country FROM range(20)"
    )
    raw.write.parquet(str(tmp_path / "in"))
    query = stream_reviews(
        spark, str(tmp_path / "in"), "google", str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = unify.unify_google(reviews.read_google(spark, str(tmp_path / "in")))
    got = got.select(*want.columns)
    assert got.count() == 20 and got.exceptAll(want).count() == 0


def test_reference_tables(spark):
    table = references.responses_from_map(spark, {"ann": ["x", "y"], "bob": ["z"]})
    assert sorted(map(tuple, table.collect())) == [("ann", 1, "x"), ("ann", 2, "y"), ("bob", 1, "z")]
    sample = spark.createDataFrame([(1, 10), (2, 20)], "position int, review_id bigint")
    bound = references.summaries_by_position(sample, ["s1", "s2"])
    assert sorted(map(tuple, bound.collect())) == [(10, "s1"), (20, "s2")]


def test_newest_first(spark):
    df = spark.createDataFrame(
        [(1, dt.date(2025, 1, 1)), (2, dt.date(2025, 1, 2)), (3, dt.date(2025, 1, 2))],
        "review_id bigint, at date",
    )
    assert [r.review_id for r in reviews.newest_first(df, "at", "review_id").collect()] == [2, 3, 1]


def test_sample_keeps_few_rows_before_the_shuffle(spark):
    df = spark.range(1000).select(
        F.col("id").alias("review_id"),
        F.when(F.col("id") < 900, "App Store").otherwise("Google Play").alias("platform"),
        F.lit(dt.date(2025, 1, 1)).alias("date"),
    )
    sample = unify.with_position(unify.sample_per_platform(df, 5))
    got = [r.review_id for r in sample.orderBy("position").collect()]
    assert got == [0, 1, 2, 3, 4, 900, 901, 902, 903, 904]
    plan = unify.sample_per_platform(df, 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_by_text_first_and_last(spark):
    rv = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "review_id bigint, review string")
    refs = spark.createDataFrame(
        [(1, "r1"), (2, "r2"), (3, "r3")], "review_id bigint, reference_summary string"
    )
    first = {r.review_id: r.reference_summary for r in by_text.first_reference_by_text(rv, refs).collect()}
    assert first == {1: "r1", 2: "r2", 3: "r1"}
    calls = spark.createDataFrame(
        [(1, "m", "o1"), (2, "m", "o2"), (3, "m", "o3")], "review_id bigint, model string, output string"
    )
    last = {r.review_id: (r.output, r.n_calls) for r in by_text.last_output_by_text(calls, rv).collect()}
    assert last == {2: ("o2", 1), 3: ("o3", 2)}
    assert by_text.distinct_reviews(rv).count() == 2
    assert by_text.rows_of_review(calls, 2).count() == 1


# --- skewed joins ---


def test_joins_survive_a_hot_key(spark):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k")
    )
    dim = facts.select("k").distinct().filter("k != 'k0'").withColumn("v", F.length("k"))
    plain = sorted(map(tuple, facts.join(dim, "k", "left").select("id", "k", "v").collect()))
    counts = facts.groupBy("k").agg(F.count("*").alias("n_rows"))
    for large in (False, True):
        hot = hot_key_join(facts, dim, ["k"], counts, ["id"], both_large=large).select("id", "k", "v")
        assert sorted(map(tuple, hot.collect())) == plain


# --- noise ---


def _noisy(text, key, level):
    import hashlib

    chars = list(text)
    for i in range(math.floor(level * len(text))):
        d = hashlib.md5(f"{key}:{i}:noise".encode()).hexdigest()
        chars[int(d[:8], 16) % len(text)] = REPLACEMENTS[int(d[8:16], 16) % 5]
    return "".join(chars)


def test_noise_against_a_plain_loop(spark):
    rng = random.Random(3)
    texts = ["", "a", "héllo wörld 😀 الخدمة", "x" * 500] + [
        "".join(rng.choice("abc é\n😀") for _ in range(rng.randrange(400))) for _ in range(30)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    for level in (0.0, 0.1, 0.9):
        got = df.select("id", add_noise(F.col("t"), F.col("id"), level).alias("n")).collect()
        assert {r.id: r.n for r in got} == {i: _noisy(t, i, level) for i, t in enumerate(texts)}


def test_noise_needs_a_key_and_sorts_no_draws(spark):
    rows = [(None, "x" * 20), (None, "short"), (5, None), (6, "é" * 20)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    noisy = df.select("id", "t", add_noise(F.col("t"), F.col("id")).alias("n"))
    assert [r.n for r in noisy.collect()] == [None, "short", None, _noisy("é" * 20, 6, 0.1)]
    plan = noisy._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "sort_array" not in plan


# --- prompts, calls, cost ---


def test_prompt_keeps_placeholder_like_text(rows):
    prompt = prompting.with_prompt(rows.limit(1), "response").first()
    assert prompt.review in prompt.prompt and prompt.user_name in prompt.prompt


@pytest.mark.parametrize("task", ["sentiment", "summary", "response"])
def test_token_count_by_parts_is_exact(rows, task):
    reqs = prompting.requests(rows, task).select("prompt", "input_tokens").collect()
    assert all(r.input_tokens == len(r.prompt.split()) for r in reqs)


def test_another_token_counter(rows):
    reqs = prompting.requests(rows, "summary", counter=lambda text: F.length(text).cast("bigint"))
    got = reqs.select("prompt", "review", "input_tokens", "review_tokens").collect()
    assert all((r.input_tokens, r.review_tokens) == (len(r.prompt), len(r.review)) for r in got)


def test_messages_by_chat_style(rows):
    got = prompting.messages(prompting.requests(rows.limit(1), "response", 2)).collect()
    roles = {r.model: [m.role for m in r.messages] for r in got}
    assert roles["Claude 3.7 Sonnet"] == ["user"]
    assert roles["OpenAI GPT-4o"] == ["system"]
    assert roles["Grok 2"] == ["system", "user"]


@pytest.mark.parametrize("task", ["sentiment", "summary", "response"])
def test_batch_operator_equals_column_backend(spark, rows, task):
    factories = {m: python_backend for m in MODEL_NAMES}
    columns = ["review_id", "model", "raw_output", "completion_tokens", "error", "input_tokens"]
    batch = infer.batch_infer(prompting.requests(rows, task), task, factories, models=())
    want = offline_calls(rows, task).select(*columns)
    got = infer.log_calls(batch).select(*columns)
    assert got.count() == 60 * 7
    assert got.exceptAll(want).count() == 0


def test_the_log_is_written_as_the_calls_come(spark, rows):
    """No sort by model takes a review's calls, which repeat its prompt, apart."""
    batch = infer.batch_infer(prompting.requests(rows.coalesce(1), "summary"), "summary", {}, models=())
    log = infer.log_calls(batch)
    assert not any("model=" in f for f in log.inputFiles())
    written = [(r.review_id, r.model) for r in log.select("review_id", "model").collect()]
    assert written == [(i, m) for i, _ in written[::7] for m in MODEL_NAMES] and len(written) == 60 * 7
    assert log.filter("prompt is null or task <> 'summary'").isEmpty()


def test_one_client_per_partition(spark, rows, tmp_path):
    marks = str(tmp_path)

    def factory(model, task, budget):
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return lambda row: ("positive", None)

    reqs = prompting.requests(rows, "sentiment", models=("m",)).repartition(2, "review_id")
    assert infer.batch_infer(reqs, "sentiment", {"m": factory}, models=()).count() == 60
    assert 1 <= len(list(tmp_path.iterdir())) <= 2


def test_batch_errors_pace_and_rerun(spark, rows, tmp_path):
    stamps = str(tmp_path / "stamps")

    def flaky(model, task, budget):
        def call(row):
            if row["review_id"] == 1:
                raise RuntimeError("boom")
            with open(f"{stamps}-{row['review_id']}", "w") as f:
                f.write(str(time.monotonic()))
            return "positive", None

        return call

    one = rows.filter("review_id < 4")
    reqs = prompting.requests(one, "sentiment", models=("paced", "ghost"))
    paced = (Model("paced", Decimal(1), Decimal(1), 0.3, "clean", "user"),)
    path = str(tmp_path / "log")
    infer.append_log(
        infer.batch_infer(reqs, "sentiment", {"paced": flaky}, paced, paced_partitions=1), path
    )
    log = infer.read_log(spark, path)
    got = {(r.model, r.review_id): r for r in log.collect()}
    assert got[("paced", 1)].error == "boom" and got[("paced", 1)].raw_output is None
    assert got[("ghost", 2)].error == "Unsupported model" and got[("ghost", 2)].elapsed_s == 0
    assert got[("paced", 2)].elapsed_s < 0.3
    times = sorted(float(open(f"{stamps}-{i}").read()) for i in (0, 2, 3))
    assert all(b - a >= 0.28 for a, b in zip(times, times[1:]))
    left = infer.pending(reqs, log).select("model", "review_id").collect()
    assert sorted(map(tuple, left)) == [("ghost", 0), ("ghost", 1), ("ghost", 2), ("ghost", 3), ("paced", 1)]


def test_rerun_counts_each_call_once(spark, rows, tmp_path):
    """The first attempt of one review fails; the rerun asks for it alone, and a
    leaderboard over the log sees one row for each call."""

    def flaky(model, task, budget):
        def call(request):
            if request["attempt"] == 1 and request["review_id"] == 1:
                raise RuntimeError("boom")
            return "positive", None

        return call

    reqs = prompting.requests(rows.filter("review_id < 4"), "sentiment", models=("m",))
    path = str(tmp_path / "log")
    first = infer.infer_to_log(reqs, path, "sentiment", {"m": flaky}, (), calls_per_commit=2)
    assert sorted((r.review_id, r.error) for r in first.collect()) == [(0, None), (1, "boom"), (2, None), (3, None)]
    again = infer.infer_to_log(reqs, path, "sentiment", {"m": flaky}, ())
    assert sorted((r.review_id, r.attempt, r.error) for r in again.collect()) == [
        (0, 1, None), (1, 2, None), (2, 1, None), (3, 1, None),
    ]
    log = infer.read_log(spark, path)
    assert log.count() == 5 and infer.pending(reqs, log).count() == 0
    assert all(r.prompt for r in log.collect())


def test_a_commit_reads_its_own_requests_alone(spark, rows, tmp_path, monkeypatch):
    """However many commits there are, each request is read for one of them; the requests
    of a review stay together, and prompts move only where they are used."""
    read, ask = [], infer.batch_infer

    def watched(reqs, *args, **how):
        files = reqs.select(F.input_file_name().alias("file")).distinct()
        read.append(({r.file for r in files.collect()}, {r.review_id for r in reqs.collect()}))
        return ask(reqs, *args, **how)

    monkeypatch.setattr(infer, "batch_infer", watched)
    reqs = prompting.requests(rows, "sentiment", models=("m", "n"))
    client = lambda model, task, budget: lambda request: ("positive", None)
    log = infer.infer_to_log(
        reqs, str(tmp_path / "log"), "sentiment", {"m": client, "n": client}, (), calls_per_commit=2
    )
    assert log.count() == reqs.count()
    read = [(files, ids) for files, ids in read if ids]
    assert len(read) > 1
    for i, (files, ids) in enumerate(read):
        for other_files, other_ids in read[i + 1 :]:
            assert not files & other_files and not ids & other_ids
    plan = log.select("review_id", "raw_output")._jdf.queryExecution().optimizedPlan().toString()
    assert "prompt" not in plan.split("Relation")[0]


def test_requests_are_not_dealt_out_and_finished_reviews_stay(spark, rows, tmp_path, monkeypatch):
    """The first run writes its requests as they come; a rerun moves the texts of reviews with
    a missing call alone, with null keys as with others, and removes what it wrote."""
    written, write = {}, infer.materialise

    def watched(df, name, **how):
        written[name] = df._jdf.queryExecution().executedPlan().toString()
        watched.last = write(df, name, **how)
        return watched.last

    def flaky(model, task, budget):
        def call(request):
            if request["attempt"] == 1 and request["review_id"] == 1 and model == "n":
                raise RuntimeError("boom")
            return "positive", None

        return call

    monkeypatch.setattr(infer, "materialise", watched)
    reqs = prompting.requests(rows, "sentiment", models=("m", "n"))
    reqs = reqs.unionByName(reqs.filter("review_id = 2").withColumn("dataset", F.lit(None).cast("string")))
    path = str(tmp_path / "log")
    infer.infer_to_log(reqs, path, "sentiment", {"m": flaky, "n": flaky}, (), calls_per_commit=4)
    assert "Exchange" not in written["due-calls"]
    left = infer._of_open_reviews(reqs, infer.read_log(spark, path))
    assert sorted((r.review_id, r.model) for r in left.collect()) == [(1, "m"), (1, "n")]
    monkeypatch.setattr(infer, "OPEN_REVIEWS", 0)
    again = infer.infer_to_log(reqs, path, "sentiment", {"m": flaky, "n": flaky}, ())
    assert infer.read_log(spark, path).count() == reqs.count() + 1
    assert again.filter("error is not null").count() == 0 and again.count() == reqs.count()
    assert not os.path.exists(os.path.dirname(watched.last.inputFiles()[0].removeprefix("file://")))


def test_a_failing_factory_and_missing_models_become_rows(spark, rows):
    def no_key(model, task, budget):
        raise KeyError("API key")

    reqs = prompting.requests(rows.filter("review_id < 3"), "sentiment", models=("m",))
    reqs = reqs.unionByName(reqs.withColumn("model", F.lit(None).cast("string")))
    for models in ((), (Model("m", Decimal(1), Decimal(1), 0.01, "clean", "user"),)):
        got = infer.batch_infer(reqs, "sentiment", {"m": no_key}, models).collect()
        assert len(got) == 6
        assert {(r.model, r.error) for r in got} == {("m", "'API key'"), (None, "Unsupported model")}


def test_paced_partitions_take_turns(spark, rows, tmp_path):
    stamps = str(tmp_path)

    def timed(model, task, budget):
        def call(request):
            with open(f"{stamps}/{request['review_id']}", "w") as f:
                f.write(str(time.monotonic()))
            return "positive", None

        return call

    reqs = prompting.requests(rows.filter("review_id < 12"), "sentiment", models=("paced",))
    paced = (Model("paced", Decimal(1), Decimal(1), 0.3, "clean", "user"),)
    infer.batch_infer(reqs, "sentiment", {"paced": timed}, paced, paced_partitions=2).collect()
    times = sorted(float(p.read_text()) for p in tmp_path.iterdir())
    assert len(times) == 12
    assert all(b - a >= 0.25 for a, b in zip(times[::2], times[2::2]))  # no opening burst


def test_calls_of_a_partition_run_side_by_side(spark, rows):
    def slow(model, task, budget):
        return lambda request: (time.sleep(0.2), ("positive", None))[1]

    reqs = prompting.requests(rows.filter("review_id < 16"), "sentiment", models=("m",)).coalesce(1)
    start = time.monotonic()
    assert infer.batch_infer(reqs, "sentiment", {"m": slow}, (), at_once=16).count() == 16
    assert time.monotonic() - start < 16 * 0.2


def test_exports_without_ids(spark):
    """Equal rows are one review with a number of copies, others keep apart."""
    google = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2025-03-01 10:00:00', 'ann', 'fine', NULL),"
        "(timestamp_ntz'2025-03-01 10:00:00', 'ann', 'fine', 'thanks'),"
        "(timestamp_ntz'2025-03-01 10:00:01', 'ann', 'fine', NULL) t(at, userName, content, replyContent)"
    )
    apple = spark.sql(
        "SELECT * FROM VALUES (timestamp_ntz'2025-03-01 10:00:00', 'ann', 'fine') t(date, userName, review)"
    )
    got = unify.unify_by_content(google, apple).collect()
    assert sorted((r.platform, r.copies, r.is_replied) for r in got) == [
        ("App Store", 1, "No"), ("Google Play", 1, "No"), ("Google Play", 2, "Yes"),
    ]
    assert len({r.review_key for r in got}) == 3


def _priced(spark, calls):
    schema = (
        "task string, model string, input_tokens bigint, raw_output string, "
        "completion_tokens bigint, elapsed_s double, error string"
    )
    return scoring.price(scoring.with_output(spark.createDataFrame(calls, schema)), models_table(spark))


def test_cost_rounding_and_errors(spark):
    got = _priced(
        spark,
        [
            ("summary", "OpenAI GPT-4o", 1, "x", 0, 1.0, None),
            ("summary", "OpenAI GPT-4o", 3, "x", 0, 1.0, None),
            ("summary", "Claude 3.7 Sonnet", 10, " Two Words\n", None, 1.0, None),
            ("summary", "Nobody", 10, "x", None, 1.0, None),
            ("summary", "Grok 2", 10, None, None, 1.0, "down"),
        ],
    ).collect()
    by = {(r.model, r.input_tokens): r for r in got}
    assert by[("OpenAI GPT-4o", 1)].cost_usd == Decimal("0.000002")
    assert by[("OpenAI GPT-4o", 3)].cost_usd == Decimal("0.000008")
    assert by[("OpenAI GPT-4o", 1)].cost_exact == Decimal("0.0000025")
    claude = by[("Claude 3.7 Sonnet", 10)]
    assert (claude.output, claude.output_tokens, claude.cost_usd) == ("two words", 2, Decimal("0.000060"))
    assert by[("Nobody", 10)].error == "Unsupported model" and by[("Nobody", 10)].cost_usd == 0
    assert by[("Grok 2", 10)].elapsed_s == 0 and by[("Grok 2", 10)].cost_usd == 0


def test_cost_is_additive_and_monotone(spark):
    calls = [("summary", m.model, i, "x", i, 1.0, None) for m in MODELS for i in range(0, 400, 50)]
    for m in MODELS:
        costs = [
            r.cost_exact for r in _priced(spark, [c for c in calls if c[1] == m.model])
            .orderBy("input_tokens").collect()
        ]
        assert costs == sorted(costs)
        assert costs[1] + costs[2] == costs[3]


@pytest.mark.parametrize(
    "text,label,ambiguous",
    [
        ("Positive!", "positive", False), ("it is NEGATIVE.", "negative", False),
        ("negative, not positive", "positive", True), ("no idea", "error", False),
        (None, "error", False), ("neutral", "neutral", False),
    ],
)
def test_validate(spark, text, label, ambiguous):
    df = spark.createDataFrame([(text,)], "output string")
    got = scoring.with_sentiment(df).first()
    assert (got.prediction, got.ambiguous) == (label, ambiguous)


def test_chat_response_parse(spark):
    body = '{"choices":[{"message":{"content":"hi"}}],"usage":{"completion_tokens":3}}'
    df = spark.createDataFrame([(body,), ("<html>",), ('{"choices":[]}',)], "body string")
    got = scoring.parse_chat_response(df).collect()
    assert (got[0].raw_output, got[0].completion_tokens, got[0].error) == ("hi", 3, None)
    assert [r.error for r in got[1:]] == ["malformed response"] * 2


def test_compression_of_an_empty_output(spark):
    df = spark.createDataFrame([(4, "a b"), (4, "")], "n bigint, o string")
    got = df.select(scoring.compression_ratio(F.col("n"), F.col("o"))).collect()
    assert [r[0] for r in got] == [2.0, None]


def test_legacy_and_report_clean_up(spark):
    schema = "task string, model string, raw_output string, error string"
    calls = spark.createDataFrame(
        [("response", "Gemini 2.0 Flash", " Hello ", None), ("response", "Grok 2", " Hello ", None),
         ("response", "Grok 2", None, "down")], schema
    )
    plain = scoring.with_output(calls)
    assert [r.output for r in plain.collect()] == ["Hello", "Hello", None]
    report = scoring.with_output(calls, ("Gemini 2.0 Flash",))
    assert [r.output for r in report.collect()] == ["hello", "Hello", None]
    assert scoring.legacy_error_as_output(plain).collect()[2].output == "down"


# --- classification ---


def _weighted(pairs):
    n = len(pairs)
    p = r = f = 0.0
    for c in LABELS:
        tp = sum(a == b == c for a, b in pairs)
        sup, pred = sum(a == c for a, _ in pairs), sum(b == c for _, b in pairs)
        p += sup * (tp / pred if pred else 0)
        r += sup * (tp / sup if sup else 0)
        f += sup * (2 * tp / (pred + sup) if pred + sup else 0)
    return sum(a == b for a, b in pairs) / n, f / n, r / n, p / n


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from(LABELS), st.sampled_from((*LABELS, "error", None))),
        min_size=1, max_size=30,
    )
)
def test_leaderboard_property(spark, pairs):
    df = spark.createDataFrame(
        [("d", "m", a, b, 0.25, Decimal("0.000001")) for a, b in pairs],
        "dataset string, model string, label string, prediction string, elapsed_s double, "
        "cost_usd decimal(18,6)",
    )
    got = classification.sentiment_leaderboard(df).first()
    acc, f1, rec, prec = _weighted(pairs)
    assert got.accuracy == pytest.approx(acc, abs=1e-6) == got.recall
    assert got.f1 == pytest.approx(f1, abs=1e-6)
    assert got.recall == pytest.approx(rec, abs=1e-6)
    assert got.precision == pytest.approx(prec, abs=1e-6)
    assert got.total_response_time == len(pairs) * 0.25
    assert got.total_cost == Decimal(len(pairs)) / 1000000


# --- reports ---


def test_report_joins_on_keys_with_mixed_replies(spark):
    """Only unreplied reviews appear, each with its own summary."""
    text = "review_id bigint, model string, output string"
    sentiment = spark.createDataFrame(
        [(i, m, "neutral") for i in (1, 2, 3) for m in "ab"],
        "review_id bigint, model string, prediction string",
    )
    summary = spark.createDataFrame([(i, m, f"s{i}{m}") for i in (1, 2, 3) for m in "ab"], text)
    response = spark.createDataFrame([(i, m, f"r{i}{m}") for i in (1, 3) for m in "ab"], text)
    got = reports.e2e_detail(sentiment, summary, response).collect()
    assert len(got) == 4
    assert all(r.summary == f"s{r.review_id}{r.model}" for r in got)
    assert all(r.response == f"r{r.review_id}{r.model}" for r in got)


def test_wide_and_long(spark):
    calls = spark.createDataFrame(
        [(1, "a", "x", 0.5), (1, "b", "y", 1.5), (2, "a", "z", 2.5)],
        "review_id bigint, model string, output string, t double",
    )
    wide = reports.wide(calls, ("review_id",), "output", (("t", "time"),), models=("a", "b"))
    got = {r.review_id: r.asDict() for r in wide.collect()}
    assert got[1]["a"] == "x" and got[1]["b_time"] == 1.5 and got[2]["b"] is None
    board = spark.createDataFrame([("a", 1.0, 2.0)], "model string, p double, q double")
    long = reports.long_metrics(board, ("model",), ("p", "q"))
    assert sorted(map(tuple, long.collect())) == [("a", "p", 1.0), ("a", "q", 2.0)]


def test_open_reviews_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "No"), (2, "Yes")], "review_id bigint, is_replied string").write.parquet(
        str(tmp_path / "rv")
    )
    df = unify.unreplied(spark.read.parquet(str(tmp_path / "rv")))
    assert "EqualTo(is_replied,No)" in df._jdf.queryExecution().toString()
    assert df.count() == 1
