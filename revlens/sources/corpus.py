"""Review tables derived from the generic corpus tables (documents, labels,
conversations, embeddings). Each derivation has a twin in plans/oracle.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.hashing import h32s
from revlens.functions.text import WS_CLASS, strip, tokens

# What a classifier must survive, one purpose to a row, with the label a reader
# would give (ids are negative so that they never meet a real review).
EDGE_CASES = (
    # negation turns praise round, and a double one turns it back
    (-1, "I would not say that the zip is any good.", "negative"),
    (-2, "Not once has the kettle failed to please me.", "positive"),
    # irony
    (-3, "Three remotes in one month, what a triumph of engineering.", "negative"),
    # the label words themselves, as subject matter
    (-4, "The battery has a positive and a negative end, as batteries do.", "neutral"),
    # other languages and scripts
    (-5, "Die Naht hielt, die Farbe auch, ich nehme noch zwei.", "positive"),
    (-6, "تعطل في اليوم الأول ولم يرد أحد", "negative"),
    # no words at all
    (-7, "", "neutral"),
    (-8, "🙂🙂🙂", "positive"),
    (-9, "12 x 4 cm, 250 g", "neutral"),
    # one opinion between long indifferent passages
    (-10, "Bought in May. " * 20 + "I regret it. " + "It is blue. " * 20, "negative"),
)


SENTENCE_END = r"[.!?\n]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# A session may ask for a number of partitions when its input is one file that
# cannot be split (a test, a bench on one machine); nothing is shuffled unless asked.
READ_PARTITIONS = "revlens.read.partitions"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = spark.conf.get(READ_PARTITIONS, None)
    return docs.repartition(int(asked), "doc_id") if asked else docs


def _platform() -> Column:
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return F.when(number % 2 == 0, "Google Play").otherwise("App Store")


def _user() -> Column:
    return F.concat(F.lit("user_"), (F.col("doc_id") % 150).cast("string"))


def _date() -> Column:
    return F.date_add(F.lit("2025-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unified review table in one pass over the documents."""
    platform = _platform()
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("review_id"),
        _date().alias("date"),
        _user().alias("user_name"),
        platform.alias("platform"),
        "lang",
        F.col("text").alias("review"),
        F.when((platform == "Google Play") & (F.col("doc_id") % 3 == 0), "Yes")
        .otherwise("No")
        .alias("is_replied"),
    )


def _noon() -> Column:
    return F.to_timestamp_ntz(
        F.concat(F.date_format(_date(), "yyyy-MM-dd"), F.lit(" 12:00:00")),
        F.lit("yyyy-MM-dd HH:mm:ss"),
    )


def _unless_fifth(prefix: str) -> Column:
    doc = F.col("doc_id")
    return F.when(doc % 5 != 0, F.concat(F.lit(prefix), (doc % 7).cast("string")))


def raw_google(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .filter(_platform() == "Google Play")
        .select(
            F.col("doc_id").alias("review_id"),
            _noon().alias("at"),
            F.col("text").alias("content"),
            _unless_fifth("v").alias("reviewCreatedVersion"),
            _user().alias("userName"),
            F.when(F.col("doc_id") % 3 == 0, "ok").alias("replyContent"),
            "lang",
            F.lit("us").alias("country"),
        )
    )


def raw_appstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .filter(_platform() == "App Store")
        .select(
            F.col("doc_id").alias("review_id"),
            _noon().alias("date"),
            F.col("text").alias("review"),
            _unless_fifth("t").alias("title"),
            _user().alias("userName"),
            "lang",
            F.lit("us").alias("country"),
        )
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("review_id"),
        F.when(F.col("toxic") == 1, "negative")
        .when(F.col("quality") == 1, "positive")
        .otherwise("neutral")
        .alias("label"),
    )


def edge_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, "reader", text, label) for i, text, label in EDGE_CASES],
        "review_id bigint, user_name string, review string, label string",
    )


def sentences(text: Column) -> Column:
    """The sentences of a text in order: what stands between full stops, question and
    exclamation marks and line ends, if it holds a token, which is to say a character that
    is not white space: asked without cutting the sentence into tokens."""
    return F.filter(F.split(text, SENTENCE_END), lambda x: F.rlike(x, F.lit(f"[^{WS_CLASS}]")))


def reference_summaries(reviews_df: DataFrame) -> DataFrame:
    """The sentence of a review with the most different words, whole and in lower
    case, the first of several; null for a review without tokens."""
    told = reviews_df.select("review_id", sentences(F.lower("review")).alias("_s"))
    weighed = F.transform(
        "_s",
        lambda x, i: F.struct(
            F.size(F.array_distinct(tokens(x))).alias("n"), (-i).alias("order"), x.alias("text")
        ),
    )
    return told.select(
        "review_id", strip(F.array_max(weighed)["text"]).alias("reference_summary")
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn (reference) with the assistant turn that follows it (output), both
    whole: pairs of real texts of any length, keyed like calls."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("asked"), F.col("text").alias("reference")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("asked"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "asked"]).select(
        F.lit("turn").alias("task"),
        F.col("conv_id").alias("review_id"),
        F.col("asked").cast("string").alias("model"),
        "output",
        "reference",
    )


def reference_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn is a reference reply of the user named after its
    conversation; the turn number orders them."""
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "assistant")
        .select(
            F.concat(F.lit("user_"), F.col("conv_id").cast("string")).alias("user_name"),
            F.col("turn").alias("ref_no"),
            F.col("text").alias("ref_text"),
        )
    )


def word_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(vec_id, embedding) and the number of rows; see :func:`word_vector_ids`."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors, vectors.count()


def word_vector_ids(words: Column, n_vectors: int) -> Column:
    """The vectors that a list of words is assigned to: every word has one, as in a hashed
    vocabulary. A batch's different words are hashed once each."""
    return F.transform(h32s(words), lambda h: h % F.lit(n_vectors))
