"""Declared schemas of every table the engine reads or writes."""

from __future__ import annotations

RAW_GOOGLE = (
    "review_id bigint, at timestamp_ntz, content string, reviewCreatedVersion string, "
    "userName string, replyContent string, lang string, country string"
)
RAW_APPSTORE = (
    "review_id bigint, date timestamp_ntz, review string, title string, "
    "userName string, lang string, country string"
)
REVIEWS = (
    "review_id bigint, date date, user_name string, platform string, "
    "lang string, review string, is_replied string"
)
MODELS = (
    "model string, price_in decimal(10,4), price_out decimal(10,4), "
    "pace_seconds double, output_count string, chat_style string"
)
TASKS = "task string, max_tokens int, temperature double, lower_output boolean"
CALL_KEYS = ("task", "dataset", "review_id", "model")
CALL_LOG = (
    "task string, dataset string, review_id bigint, model string, attempt int, "
    "user_name string, prompt string, review_tokens bigint, input_tokens bigint, "
    "raw_output string, completion_tokens bigint, elapsed_s double, error string"
)
CHAT_RESPONSE = (
    "choices array<struct<message:struct<content:string>>>, "
    "usage struct<completion_tokens:bigint>"
)
