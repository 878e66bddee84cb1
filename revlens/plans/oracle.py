"""The same results as plain SQL, for a cross-engine check on the same tables.

Derived tables are named parts; a query lists what it needs and gets them as
common table expressions in order. Wherever possible the SQL takes another road
than the Spark job (exploded joins against row-local arrays, a dynamic program
against bit vectors), so that agreement means something.
"""

from __future__ import annotations

from revlens.functions.text import WORD, WS_CHARS, WS_CLASS
from revlens.operators import backends, noise, overlap, perplexity
from revlens.sources import corpus
from revlens.sources.catalog import (
    ERROR_LABEL,
    LABELS,
    MODEL_NAMES,
    MODELS,
    NO_REFERENCE,
    TASK_BY_NAME,
    TASKS,
    UNSUPPORTED,
)
from revlens.sources.prompts import TEMPLATES, render_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def toks(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{WS_CLASS}]+')"


def rouge_toks(x: str) -> str:
    return f"regexp_extract_all({x}, '[^.{WS_CLASS}]+')"


def h(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def r6(x: str) -> str:
    return f"floor(({x})::DOUBLE * 1e6 + 0.5) / 1e6"


def sents(x: str) -> str:
    return (
        f"list_filter(regexp_split_to_array({x}, '{corpus.SENTENCE_END}'), "
        f"lambda s: regexp_matches(s, '[^{WS_CLASS}]'))"
    )


def strip(x: str) -> str:
    return f"trim({x}, {q(WS_CHARS)})"


def quoted(extra: str) -> str:
    """One whole sentence of ``ss``, or two in reading order."""
    one, two = "h % len(ss)", f"(h + {extra}) % len(ss)"
    return (
        f"CASE WHEN len(ss) = 0 THEN '' WHEN {one} = {two} THEN {strip(f'ss[1 + {one}]')} "
        f"ELSE {strip(f'ss[1 + least({one}, {two})]')} || '. ' || "
        f"{strip(f'ss[1 + greatest({one}, {two})]')} END"
    )


PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql)


def build(final: str, *needs: str, instead: dict[str, str] | None = None) -> str:
    """``instead`` puts the named parts in the places of others."""
    parts = PARTS | {name: PARTS[other] for name, other in (instead or {}).items()}
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for dep in parts[name][0]:
            visit(dep)
        seen.append(name)

    for n in needs:
        visit(n)
    body = ",\n".join(f"{n} AS MATERIALIZED ({parts[n][1]})" for n in seen if n != "lcs_steps")
    recursive = ""
    if "lcs_steps" in seen:
        body = ",\n".join(f"{n} AS ({parts[n][1]})" for n in seen)
        recursive = "RECURSIVE "
    return f"WITH {recursive}{body}\n{final}"


_LABEL_LIST = "[" + ", ".join(q(x) for x in LABELS) + "]"
_MODEL_ROWS = ",\n".join(
    f"({q(m.model)}, {m.price_in}::DECIMAL(10,4), {m.price_out}::DECIMAL(10,4), "
    f"{q(m.output_count)}, {q(m.chat_style)}, {backends.SKILL[m.model]})"
    for m in MODELS
)

part(
    "models",
    "SELECT * FROM (VALUES " + _MODEL_ROWS
    + ") t(model, price_in, price_out, output_count, chat_style, skill)",
)
part(
    "reviews",
    """SELECT doc_id AS review_id, DATE '2025-01-01' + (doc_id % 365)::INTEGER AS date,
       'user_' || (doc_id % 150) AS user_name, platform, lang, text AS review,
       CASE WHEN platform = 'Google Play' AND doc_id % 3 = 0 THEN 'Yes' ELSE 'No' END AS is_replied,
       CASE WHEN doc_id % 5 = 0 THEN 'No title'
            ELSE (CASE WHEN platform = 'Google Play' THEN 'v' ELSE 't' END) || (doc_id % 7) END
         AS title
       FROM (SELECT *, CASE WHEN regexp_extract(source, '([0-9]+)', 1)::INTEGER % 2 = 0
                            THEN 'Google Play' ELSE 'App Store' END AS platform
             FROM documents)""",
)
part(
    "truth",
    """SELECT doc_id AS review_id, CASE WHEN toxic = 1 THEN 'negative'
       WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label FROM labels""",
)
part(
    "reference_summaries",
    f"""SELECT r.review_id, {strip("best")} AS reference_summary FROM reviews r LEFT JOIN (
          SELECT review_id, arg_max(s, len(list_distinct({toks("s")})) * 1000000 - i) AS best
          FROM (SELECT review_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i
                FROM (SELECT review_id, {sents("lower(review)")} AS ss FROM reviews))
          GROUP BY review_id) b ON b.review_id = r.review_id""",
    "reviews",
)
part(
    "reference_responses",
    """SELECT 'user_' || conv_id AS user_name, turn AS ref_no, text AS ref_text
       FROM conversations WHERE role = 'assistant'""",
)

# Whole turns: a user's and the assistant's that follows it.
part(
    "turn_pairs",
    """SELECT 'turn' AS task, u.conv_id AS review_id, u.turn::VARCHAR AS model,
         a.text AS output, u.text AS reference
       FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant'""",
)
part(
    "turn_outputs",
    "SELECT task, review_id, model, output AS out_text FROM turn_pairs WHERE output IS NOT NULL",
    "turn_pairs",
)

# --- noise: explode characters and draws, join, aggregate -------------------------

part(
    "noise_draws",
    f"""SELECT review_id, i,
        ('0x' || substr(d, 1, 8))::BIGINT % len AS pos,
        {"[" + ", ".join(q(r) for r in noise.REPLACEMENTS) + "]"}[
          (1 + ('0x' || substr(d, 9, 8))::BIGINT % {len(noise.REPLACEMENTS)})::INTEGER] AS repl
      FROM (SELECT review_id, len, i, md5(review_id || ':' || i || ':noise') AS d
            FROM (SELECT review_id, length(review) AS len,
                  unnest(range(0, floor(0.1::DOUBLE * length(review))::BIGINT)) AS i
                  FROM reviews))""",
    "reviews",
)
part(
    "noisy",
    """SELECT c.review_id, string_agg(coalesce(d.repl, c.ch), '' ORDER BY c.pos) AS noisy_review
       FROM (SELECT review_id, generate_subscripts(chs, 1) - 1 AS pos, unnest(chs) AS ch
             FROM (SELECT review_id, regexp_extract_all(review, '(?s).') AS chs FROM reviews)) c
       LEFT JOIN (SELECT review_id, pos, arg_max(repl, i) AS repl FROM noise_draws GROUP BY ALL) d
         ON d.review_id = c.review_id AND d.pos = c.pos
       GROUP BY c.review_id""",
    "reviews", "noise_draws",
)
_EDGES = ", ".join(f"({i}, 'reader', {q(t)}, {q(x)})" for i, t, x in corpus.EDGE_CASES)
part(
    "evaluation",
    f"""SELECT 'customer' AS dataset, r.review_id, user_name, review, label
        FROM reviews r JOIN truth t ON t.review_id = r.review_id
        UNION ALL SELECT 'edge', * FROM (VALUES {_EDGES}) e(review_id, user_name, review, label)
        UNION ALL SELECT 'noisy', r.review_id, user_name, coalesce(noisy_review, review), label
        FROM reviews r JOIN truth t ON t.review_id = r.review_id
        LEFT JOIN noisy n ON n.review_id = r.review_id""",
    "reviews", "truth", "noisy",
)
part(
    "labelled",
    """SELECT 'customer' AS dataset, r.review_id, user_name, review, label
       FROM reviews r LEFT JOIN truth t ON t.review_id = r.review_id""",
    "reviews", "truth",
)
part(
    "customer",
    "SELECT 'customer' AS dataset, review_id, user_name, review, NULL AS label FROM reviews",
    "reviews",
)
part(
    "open_customer",
    """SELECT 'customer' AS dataset, review_id, user_name, review, NULL AS label
       FROM reviews WHERE is_replied = 'No'""",
    "reviews",
)
part(
    "open_labelled",
    """SELECT l.* FROM labelled l JOIN reviews r ON r.review_id = l.review_id
       WHERE is_replied = 'No'""",
    "labelled", "reviews",
)

# --- the stand-in's answers -------------------------------------------------------

_REPORTED = "output_count = 'reported'"


def _answer(task: str) -> str:
    if task == "summary":
        return f"' ' || ({quoted('h % 3')}) || chr(10)"
    if task == "response":
        return f"'Dear ' || user_name || ', thank you. ' || ({quoted('h % 2')}) || '  '"
    points = f"(skill - CASE WHEN dataset = 'noisy' THEN {backends.NOISE_PENALTY} ELSE 0 END)"
    base = (
        f"CASE WHEN label IS NULL THEN {_LABEL_LIST}[(1 + h % 3)::INTEGER] "
        f"WHEN h % 100 < {points} THEN label "
        f"ELSE {_LABEL_LIST}[(1 + (list_position({_LABEL_LIST}, label) + h % 2) % 3)::INTEGER] END"
    )
    return (
        f"CASE WHEN h % 50 = 7 THEN {q(backends.NO_OPINION)} "
        f"WHEN h % 41 = 5 THEN ({base}) || ' rather than ' || {_LABEL_LIST}[(1 + h % 3)::INTEGER] "
        f"WHEN h % 3 = 0 THEN '  ' || upper(substr({base}, 1, 1)) || substr({base}, 2) || '.' "
        f"|| chr(10) "
        f"WHEN h % 3 = 1 THEN 'Sentiment: ' || upper({base}) || '!' ELSE {base} END"
    )


def calls_part(
    name: str, rows: str, task: str, version: int = 1, lowered: tuple[str, ...] = (),
    unlisted: str | None = None,
) -> None:
    """Answers, clean-up, pricing and errors of one task over ``rows``."""
    extra = f" UNION ALL SELECT {q(unlisted)}, NULL, NULL, NULL, NULL, 50" if unlisted else ""
    strip = f"trim(raw_output, {q(WS_CHARS)})"
    lower_if = "TRUE" if TASK_BY_NAME[task].lower_output else "FALSE"
    if lowered:
        lower_if += " OR model IN (" + ", ".join(q(m) for m in lowered) + ")"
    sql = f"""
      SELECT *, CASE WHEN err IS NOT NULL THEN 0 ELSE
               round_even(input_tokens * price_in + output_tokens * price_out, 0)::BIGINT END
               AS micro,
             CASE WHEN err IS NOT NULL THEN 0 ELSE
               ((input_tokens * price_in + output_tokens * price_out) * 10000)::BIGINT END
               AS exact_units
      FROM (
        SELECT * EXCLUDE (err0), CASE WHEN price_in IS NULL THEN {q(UNSUPPORTED)} ELSE err0 END AS err,
               CASE WHEN price_in IS NULL OR err0 IS NOT NULL THEN 0.0::DOUBLE
                    ELSE (100 + h % 900) / 1000.0::DOUBLE END AS elapsed_s,
               CASE WHEN price_in IS NULL OR err0 IS NOT NULL THEN NULL
                    WHEN completion_tokens IS NOT NULL THEN completion_tokens
                    WHEN output_count = 'raw' THEN len({toks("raw_output")})
                    ELSE len({toks("output")}) END AS output_tokens
        FROM (
          SELECT *, CASE WHEN {lower_if} THEN lower({strip}) ELSE {strip} END AS output,
                 CASE WHEN {_REPORTED} THEN len({toks("raw_output")}) + 2 END AS completion_tokens
          FROM (
            SELECT *, CASE WHEN h % 97 = 3 THEN NULL ELSE {_answer(task)} END AS raw_output,
                   CASE WHEN h % 97 = 3 THEN {q(backends.BACKEND_ERROR)} END AS err0
            FROM (
              SELECT {q(task)} AS task, dataset, review_id, user_name, label, ss,
                     len(ts) AS review_tokens, input_tokens, m.*,
                     {h(f"{q(task + ':')} || dataset || ':' || m.model || ':' || review_id")} AS h
              FROM (SELECT *, {toks("review")} AS ts, {sents("review")} AS ss,
                           len({toks(render_sql(TEMPLATES[(task, version)]))}) AS input_tokens
                    FROM {rows})
              CROSS JOIN (SELECT * FROM models{extra}) m))))"""
    part(name, sql, rows, "models")


def sentiment_part(name: str, calls: str) -> None:
    cases = " ".join(f"WHEN contains(output, {q(x)}) THEN {q(x)}" for x in LABELS)
    count = " + ".join(f"contains(output, {q(x)})::INTEGER" for x in LABELS)
    part(
        name,
        f"""SELECT *, CASE {cases} ELSE {q(ERROR_LABEL)} END AS prediction,
            coalesce({count} > 1, FALSE) AS ambiguous FROM {calls}""",
        calls,
    )


GEMINI = ("Gemini 2.0 Flash",)
calls_part("c_eval", "evaluation", "sentiment")
calls_part("c_labelled", "labelled", "sentiment")
calls_part("c_labelled2", "labelled", "sentiment", 2)
calls_part("c_open_labelled2", "open_labelled", "sentiment", 2)
calls_part("c_summary", "customer", "summary")
calls_part("c_summary2", "customer", "summary", 2)
calls_part("c_summary_unlisted", "customer", "summary", unlisted="Unlisted Model")
calls_part("c_response", "open_customer", "response")
calls_part("c_response2", "open_customer", "response", 2, GEMINI)
sentiment_part("s_eval", "c_eval")
sentiment_part("s_labelled", "c_labelled")
sentiment_part("s_open2", "c_open_labelled2")

# --- sentiment scores, per class first --------------------------------------------

def board_parts(suffix: str, scored: str) -> None:
    """``board`` of the scored calls of one part, with counts per class first."""
    part(
        f"per_class{suffix}",
        f"""SELECT b.dataset, b.model, c.label,
              count(*) FILTER (b.label = c.label) AS support,
              count(*) FILTER (b.prediction = c.label) AS predicted,
              count(*) FILTER (b.label = c.label AND b.prediction = c.label) AS tp
            FROM {scored} b CROSS JOIN (SELECT unnest({_LABEL_LIST}) AS label) c GROUP BY ALL""",
        scored,
    )
    part(
        f"board{suffix}",
        f"""SELECT t.dataset, t.model, n_reviews, {r6("n_right::DOUBLE / n_reviews")} AS accuracy,
              {r6("f1 / n_reviews")} AS f1, {r6("recall / n_reviews")} AS recall,
              {r6("precision / n_reviews")} AS precision, total_response_time, total_cost
            FROM (SELECT dataset, model, count(*) AS n_reviews,
                    count(*) FILTER (label = prediction) AS n_right,
                    sum(floor(elapsed_s * 1e6 + 0.5)::BIGINT)::BIGINT / 1e6 AS total_response_time,
                    sum(micro)::BIGINT / 1e6 AS total_cost
                  FROM {scored} GROUP BY ALL) t
            JOIN (SELECT dataset, model,
                    sum(support * CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE
                        ELSE 2 * tp::DOUBLE / (predicted + support) END
                        ORDER BY list_position({_LABEL_LIST}, label)) AS f1,
                    sum(support * CASE WHEN support = 0 THEN 0.0::DOUBLE
                        ELSE tp::DOUBLE / support END ORDER BY list_position({_LABEL_LIST}, label))
                      AS recall,
                    sum(support * CASE WHEN predicted = 0 THEN 0.0::DOUBLE
                        ELSE tp::DOUBLE / predicted END ORDER BY list_position({_LABEL_LIST}, label))
                      AS precision
                  FROM per_class{suffix} GROUP BY ALL) w
              ON w.dataset = t.dataset AND w.model = t.model""",
        scored, f"per_class{suffix}",
    )


board_parts("", "s_eval")

# --- pairs and text metrics -------------------------------------------------------

part(
    "ref_terms",
    f"""SELECT user_name, ref_no, term, count(*) AS n
        FROM (SELECT user_name, ref_no, unnest({toks("lower(ref_text)")}) AS term
              FROM reference_responses) GROUP BY ALL""",
    "reference_responses",
)
part(
    "reply_terms",
    f"""SELECT review_id, model, user_name, term, count(*) AS n
        FROM (SELECT review_id, model, user_name, unnest({toks("lower(output)")}) AS term
              FROM c_response WHERE output IS NOT NULL) GROUP BY ALL""",
    "c_response",
)
part(
    "best",
    f"""SELECT review_id, model, coalesce(ref_text, {q(NO_REFERENCE)}) AS reference, ref_no,
               similarity
        FROM (SELECT c.review_id, c.model, f.ref_no, f.ref_text,
                CASE WHEN f.ref_no IS NOT NULL THEN
                  coalesce(dot::DOUBLE / nullif(sqrt(cn.n2::DOUBLE) * sqrt(rn.n2::DOUBLE), 0.0),
                           0.0) END AS similarity,
                row_number() OVER (PARTITION BY c.review_id, c.model ORDER BY
                  coalesce(dot::DOUBLE / nullif(sqrt(cn.n2::DOUBLE) * sqrt(rn.n2::DOUBLE), 0.0),
                           0.0) DESC, f.ref_no) AS rn
              FROM (SELECT review_id, model, user_name FROM c_response WHERE output IS NOT NULL) c
              LEFT JOIN reference_responses f ON f.user_name = c.user_name
              LEFT JOIN (SELECT a.review_id, a.model, b.ref_no, sum(a.n * b.n)::BIGINT AS dot
                         FROM reply_terms a JOIN ref_terms b
                           ON a.user_name = b.user_name AND a.term = b.term GROUP BY ALL) d
                ON d.review_id = c.review_id AND d.model = c.model AND d.ref_no = f.ref_no
              LEFT JOIN (SELECT review_id, model, sum(n * n)::BIGINT AS n2 FROM reply_terms
                         GROUP BY ALL) cn ON cn.review_id = c.review_id AND cn.model = c.model
              LEFT JOIN (SELECT user_name, ref_no, sum(n * n)::BIGINT AS n2 FROM ref_terms
                         GROUP BY ALL) rn
                ON rn.user_name = f.user_name AND rn.ref_no = f.ref_no)
        WHERE rn = 1""",
    "c_response", "reference_responses", "ref_terms", "reply_terms",
)
part(
    "summary_pairs",
    """SELECT c.*, reference_summary AS reference FROM c_summary c
       LEFT JOIN reference_summaries r ON r.review_id = c.review_id""",
    "c_summary", "reference_summaries",
)
part(
    "response_pairs",
    """SELECT c.*, b.reference FROM c_response c
       LEFT JOIN best b ON b.review_id = c.review_id AND b.model = c.model""",
    "c_response", "best",
)
part(
    "pairs",
    """SELECT task, review_id, model, output, reference FROM summary_pairs WHERE output IS NOT NULL
       UNION ALL
       SELECT task, review_id, model, output, reference FROM response_pairs
       WHERE output IS NOT NULL""",
    "summary_pairs", "response_pairs",
)
_K = "task, review_id, model"


def _grams(name: str, column: str, tokenizer, orders: range) -> None:
    """(key, n, gram, times) of one side of the pairs."""
    parts = " UNION ALL ".join(
        f"""SELECT {_K}, {n} AS n, unnest(list_transform(range(1, len(ts) - {n - 2}),
            lambda i: array_to_string(ts[i:i + {n - 1}], ' '))) AS gram
            FROM (SELECT {_K}, {tokenizer(column)} AS ts FROM pairs)"""
        for n in orders
    )
    part(name, f"SELECT {_K}, n, gram, count(*) AS times FROM ({parts}) GROUP BY ALL", "pairs")


_grams("rouge_c", "output", rouge_toks, range(1, 3))
_grams("rouge_r", "reference", rouge_toks, range(1, 3))
_grams("bleu_c", "output", toks, range(1, 5))
_grams("bleu_r", "reference", toks, range(1, 5))


def _overlap(name: str, c: str, r: str) -> None:
    part(
        name,
        f"""SELECT {_K}, n, count(*) AS common, sum(least(c.times, r.times))::BIGINT AS clipped
            FROM {c} c JOIN {r} r USING ({_K}, n, gram) GROUP BY ALL""",
        c, r,
    )


_overlap("rouge_o", "rouge_c", "rouge_r")
_overlap("bleu_o", "bleu_c", "bleu_r")


def _f(ov: str, c: str, r: str) -> str:
    p, rr = f"({ov}::DOUBLE / {c})", f"({ov}::DOUBLE / {r})"
    return f"CASE WHEN coalesce({ov}, 0) = 0 THEN 0.0 ELSE 2.0::DOUBLE * {p} * {rr} / ({p} + {rr}) END"


part(
    "rouge_f",
    f"""SELECT p.task, p.review_id, p.model, x.n,
          CASE WHEN p.reference IS NOT NULL THEN {r6(_f("o.common", "c.d", "r.d"))} END AS f_set,
          CASE WHEN p.reference IS NOT NULL THEN {r6(_f("o.clipped", "c.t", "r.t"))} END
            AS f_multiset
        FROM pairs p CROSS JOIN (SELECT unnest([1, 2]) AS n) x
        LEFT JOIN rouge_o o ON o.task = p.task AND o.review_id = p.review_id
          AND o.model = p.model AND o.n = x.n
        LEFT JOIN (SELECT {_K}, n, count(*) AS d, sum(times)::BIGINT AS t FROM rouge_c GROUP BY ALL) c
          ON c.task = p.task AND c.review_id = p.review_id AND c.model = p.model AND c.n = x.n
        LEFT JOIN (SELECT {_K}, n, count(*) AS d, sum(times)::BIGINT AS t FROM rouge_r GROUP BY ALL) r
          ON r.task = p.task AND r.review_id = p.review_id AND r.model = p.model AND r.n = x.n""",
    "pairs", "rouge_c", "rouge_r", "rouge_o",
)

# The textbook table of the longest common subsequence, one candidate token per
# step; the row maximum so far is a window over reference positions.
# Tokens that the other side lacks, and a common start or end, are set aside first:
# the former add nothing, the latter add their length.
def _agreeing(a: str, b: str) -> str:
    least = f"least(len({a}), len({b}))"
    differ = f"list_position(list_transform(range(1, {least} + 1), lambda i: {a}[i] = {b}[i]), FALSE)"
    return f"coalesce(nullif({differ}, 0) - 1, {least})"


part(
    "lcs_pairs",
    f"""SELECT pid, {_K}, n_c, n_r, head + tail AS sure, cs[head + 1:len(cs) - tail] AS cs,
          rs[head + 1:len(rs) - tail] AS rs
        FROM (SELECT *, {_agreeing("list_reverse(cs[head + 1:])", "list_reverse(rs[head + 1:])")} AS tail
              FROM (SELECT *, {_agreeing("cs", "rs")} AS head
                    FROM (SELECT pid, {_K}, len(c0) AS n_c, len(r0) AS n_r,
                            list_filter(c0, lambda x: list_contains(shared, x)) AS cs,
                            list_filter(r0, lambda x: list_contains(shared, x)) AS rs
                          FROM (SELECT *, list_intersect(c0, r0) AS shared
                                FROM (SELECT row_number() OVER () AS pid, {_K},
                                        {rouge_toks("output")} AS c0, {rouge_toks("reference")} AS r0
                                      FROM pairs WHERE reference IS NOT NULL)))))""",
    "pairs",
)
part(
    "lcs_words",
    "SELECT pid, cs, j, w FROM (SELECT pid, cs, generate_subscripts(rs, 1) AS j, unnest(rs) AS w "
    "FROM lcs_pairs)",
    "lcs_pairs",
)
part(
    "lcs_steps",
    """SELECT pid, cs, j, w, 0 AS i, 0::BIGINT AS v FROM lcs_words
       UNION ALL
       SELECT pid, cs, j, w, i + 1, max(greatest(v, g)) OVER (PARTITION BY pid ORDER BY j)::BIGINT
       FROM (SELECT *, CASE WHEN cs[i + 1] = w
               THEN coalesce(lag(v) OVER (PARTITION BY pid ORDER BY j), 0) + 1 ELSE 0 END AS g
             FROM lcs_steps WHERE i < len(cs))""",
    "lcs_words",
)
part(
    "lcs",
    f"""SELECT p.task, p.review_id, p.model, n_c AS c, n_r AS r, sure + coalesce(l.v, 0) AS ov
        FROM lcs_pairs p LEFT JOIN (SELECT pid, max(v) AS v FROM lcs_steps GROUP BY pid) l
          ON l.pid = p.pid""",
    "lcs_pairs", "lcs_steps",
)

part(
    "bleu_f",
    f"""SELECT p.task, p.review_id, p.model,
          CASE WHEN reference IS NULL THEN NULL
               WHEN coalesce(max(o.common) FILTER (x.n = 1), 0) = 0 THEN 0.0
               ELSE (CASE WHEN c > r THEN 1.0::DOUBLE ELSE exp(1.0::DOUBLE - r::DOUBLE / c) END)
                 * exp(sum(ln((CASE WHEN coalesce(o.clipped, 0) = 0
                     THEN {overlap.BLEU_EPSILON}::DOUBLE ELSE o.clipped::DOUBLE END)
                     / greatest(c - x.n + 1, 1)) / 4.0::DOUBLE ORDER BY x.n)) END AS bleu
        FROM (SELECT *, len({toks("output")}) AS c, len({toks("reference")}) AS r FROM pairs) p
        CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) x
        LEFT JOIN bleu_o o ON o.task = p.task AND o.review_id = p.review_id
          AND o.model = p.model AND o.n = x.n
        GROUP BY p.task, p.review_id, p.model, reference, c, r""",
    "pairs", "bleu_o",
)


def _ranked(column: str) -> str:
    return f"""SELECT {_K}, pos, w, row_number() OVER (PARTITION BY {_K}, w ORDER BY pos DESC) AS rk
        FROM (SELECT {_K}, generate_subscripts(ts, 1) AS pos, unnest(ts) AS w
              FROM (SELECT {_K}, {toks(f"lower({column})")} AS ts FROM pairs))"""


part("meteor_c", _ranked("output"), "pairs")
part("meteor_r", _ranked("reference"), "pairs")
part(
    "meteor_m",
    f"""SELECT {_K}, count(*) AS hits, count(*) FILTER (brk) AS chunks
        FROM (SELECT {_K}, coalesce(cp <> lag(cp) OVER o + 1 OR rp <> lag(rp) OVER o + 1, TRUE)
                AS brk
              FROM (SELECT c.task, c.review_id, c.model, c.pos AS cp, r.pos AS rp
                    FROM meteor_c c JOIN meteor_r r USING ({_K}, w, rk))
              WINDOW o AS (PARTITION BY {_K} ORDER BY cp)) GROUP BY ALL""",
    "meteor_c", "meteor_r",
)
_A = f"{overlap.METEOR_ALPHA}::DOUBLE"
part(
    "meteor_f",
    f"""SELECT p.task, p.review_id, p.model,
          CASE WHEN reference IS NULL THEN NULL WHEN hits IS NULL THEN 0.0
            ELSE (1.0::DOUBLE - {overlap.METEOR_GAMMA}::DOUBLE * fr * fr * fr)
                 * (pp * qq / ({_A} * pp + (1.0::DOUBLE - {_A}) * qq)) END AS meteor
        FROM (SELECT p.*, m.hits, m.chunks::DOUBLE / m.hits AS fr,
                m.hits::DOUBLE / len({toks("output")}) AS pp,
                m.hits::DOUBLE / len({toks("reference")}) AS qq
              FROM pairs p LEFT JOIN meteor_m m ON m.task = p.task
                AND m.review_id = p.review_id AND m.model = p.model) p""",
    "pairs", "meteor_m",
)

part(
    "vec_sims",
    """SELECT a.vec_id AS a, b.vec_id AS b,
         list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
       FROM embeddings a CROSS JOIN embeddings b""",
)


def _ids(column: str) -> str:
    return f"""SELECT {_K}, {h("w")} % (SELECT count(*) FROM embeddings) AS id, count(*) AS times
        FROM (SELECT {_K}, unnest({toks(f"lower({column})")}) AS w FROM pairs) GROUP BY ALL"""


part("soft_c", _ids("output"), "pairs")
part("soft_r", _ids("reference"), "pairs")
part(
    "soft_sims",
    f"""SELECT {_K}, c.id AS c_id, c.times AS c_times, r.id AS r_id, r.times AS r_times, s
        FROM soft_c c JOIN soft_r r USING ({_K}) JOIN vec_sims v ON v.a = c.id AND v.b = r.id""",
    "soft_c", "soft_r", "vec_sims",
)
part(
    "soft_f",
    f"""SELECT p.task, p.review_id, p.model,
          CASE WHEN reference IS NULL THEN NULL ELSE coalesce(2 * pr * re / (pr + re), 0.0) END
            AS soft_f1
        FROM pairs p
        LEFT JOIN (SELECT {_K}, sum(m * t) / sum(t) AS pr FROM
              (SELECT {_K}, c_id, any_value(c_times) AS t, max(s) AS m FROM soft_sims GROUP BY ALL)
              GROUP BY ALL) x
          ON x.task = p.task AND x.review_id = p.review_id AND x.model = p.model
        LEFT JOIN (SELECT {_K}, sum(m * t) / sum(t) AS re FROM
              (SELECT {_K}, r_id, any_value(r_times) AS t, max(s) AS m FROM soft_sims GROUP BY ALL)
              GROUP BY ALL) y
          ON y.task = p.task AND y.review_id = p.review_id AND y.model = p.model""",
    "pairs", "soft_sims",
)


def _bigrams(source: str, keep: str, text: str) -> str:
    return f"""SELECT {keep}coalesce(ts[i - 1], {q(perplexity.START)}) AS prev, ts[i] AS word
        FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i
              FROM (SELECT *, {toks(f"lower({text})")} AS ts FROM {source}))"""


part(
    "lm",
    f"SELECT prev, word, count(*) AS n FROM ({_bigrams('reviews', '', 'review')}) GROUP BY ALL",
    "reviews",
)
part(
    "outputs",
    f"""SELECT {_K}, output AS out_text FROM c_summary WHERE output IS NOT NULL
        UNION ALL SELECT {_K}, output FROM c_response WHERE output IS NOT NULL""",
    "c_summary", "c_response",
)
part(
    "ppl",
    f"""SELECT {_K}, count(*) AS n_tokens, {r6("exp(-sum(nano)::DOUBLE / 1e9 / count(*))")}
          AS perplexity
        FROM (SELECT {_K}, floor(ln((coalesce(l.n, 0) + {perplexity.ADD_K}::DOUBLE)
                / (coalesce(c.n_prev, 0) + {perplexity.ADD_K}::DOUBLE * v)) * 1e9 + 0.5)::BIGINT
                AS nano
              FROM ({_bigrams("outputs", _K + ", ", "out_text")}) b
              LEFT JOIN lm l ON l.prev = b.prev AND l.word = b.word
              LEFT JOIN (SELECT prev, sum(n) AS n_prev FROM lm GROUP BY ALL) c ON c.prev = b.prev
              CROSS JOIN (SELECT count(DISTINCT word)::DOUBLE AS v FROM lm))
        GROUP BY ALL""",
    "outputs", "lm",
)


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


part(
    "lexicon",
    f"""SELECT word, {r6("(pos - neg)::DOUBLE / (pos + neg)")} AS polarity FROM
        (SELECT word, count(*) FILTER (label = 'positive') AS pos,
                count(*) FILTER (label = 'negative') AS neg
         FROM (SELECT label, unnest({words("review")}) AS word
               FROM reviews r JOIN truth t ON t.review_id = r.review_id
               WHERE label <> 'neutral') GROUP BY ALL)""",
    "reviews", "truth",
)


def polarity_part(name: str, source: str, key: str, text: str) -> None:
    part(
        name,
        f"""SELECT {", ".join("t." + k for k in key.split(", "))}, coalesce(n_hits, 0) AS n_hits,
              coalesce({r6("micro_sum::DOUBLE / 1e6 / n_hits")}, 0.0) AS polarity
            FROM {source} t LEFT JOIN (
              SELECT {key}, count(*) AS n_hits,
                     sum(floor(polarity * 1e6 + 0.5)::BIGINT)::BIGINT AS micro_sum
              FROM (SELECT {key}, unnest({words(text)}) AS word FROM {source}) w
              JOIN lexicon USING (word) GROUP BY ALL) s USING ({key})""",
        source, "lexicon",
    )


polarity_part("review_polarity", "reviews", "review_id", "review")
part(
    "replies",
    "SELECT review_id, model, output AS out_text FROM c_response WHERE output IS NOT NULL",
    "c_response",
)
polarity_part("reply_polarity", "replies", "review_id, model", "out_text")


def _compression(output: str) -> str:
    return r6(f"review_tokens::DOUBLE / nullif(len({toks(output)}), 0)")


# --- final queries ----------------------------------------------------------------

_TASK_ROWS = ", ".join(
    f"({q(t.task)}, {t.max_tokens}::BIGINT, {t.temperature}::DOUBLE)" for t in TASKS
)


def _prompts() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT {q(task)} AS task, {v}::BIGINT AS version, review_id,
            {render_sql(TEMPLATES[(task, v)])} AS prompt FROM reviews"""
        for task, v in (("sentiment", 1), ("summary", 1), ("response", 1), ("response", 2))
    )
    return build(
        f"""SELECT p.*, len({toks("prompt")}) AS input_tokens, max_tokens, temperature
            FROM ({parts}) p JOIN (VALUES {_TASK_ROWS}) t(task, max_tokens, temperature)
              ON t.task = p.task""",
        "reviews",
    )


def _wide(source: str, keep: str, value: str, extras: tuple[tuple[str, str], ...] = ()) -> str:
    columns = []
    for m in MODEL_NAMES:
        columns.append(f'max({value}) FILTER (model = {q(m)}) AS "{m}"')
        columns += [f'max({c}) FILTER (model = {q(m)}) AS "{m}_{s}"' for c, s in extras]
    return build(f"SELECT {keep}, {', '.join(columns)} FROM {source} GROUP BY {keep}", source)


def _sum6(x: str) -> str:
    return f"sum(floor(({x}) * 1e6 + 0.5)::BIGINT)::BIGINT / 1e6"


def quality(pairs: str, task: str, instead: dict[str, str] | None = None) -> str:
    metrics = ("rouge_1", "rouge_2", "rouge_l", "soft_f1", "meteor", "compression")
    sums = ", ".join(
        f"{_sum6(m)} AS {m}_sum, {r6(f'{_sum6(m)} / nullif(count({m}), 0)')} AS {m}_avg"
        for m in metrics
    )
    on = "USING (task, review_id, model)"
    return build(
        f"""SELECT b.*, perplexity_sum, perplexity_avg FROM (
              SELECT model, count(*) AS n_calls, count(err) AS n_errors, {sums},
                     sum(floor(elapsed_s * 1e6 + 0.5)::BIGINT)::BIGINT / 1e6 AS total_response_time,
                     sum(micro)::BIGINT / 1e6 AS total_cost
              FROM (SELECT p.model, p.err, p.elapsed_s, p.micro,
                      r1.f_set AS rouge_1, r2.f_set AS rouge_2,
                      {r6(_f("l.ov", "l.c", "l.r"))} AS rouge_l_0,
                      CASE WHEN l.c IS NULL THEN NULL ELSE rouge_l_0 END AS rouge_l,
                      {r6("s.soft_f1")} AS soft_f1, {r6("t.meteor")} AS meteor,
                      {_compression("p.output")} AS compression
                    FROM {pairs} p
                    LEFT JOIN (SELECT * FROM rouge_f WHERE n = 1) r1 {on}
                    LEFT JOIN (SELECT * FROM rouge_f WHERE n = 2) r2 {on}
                    LEFT JOIN lcs l {on} LEFT JOIN soft_f s {on} LEFT JOIN meteor_f t {on})
              GROUP BY model) b
            LEFT JOIN (SELECT model, sum(floor(perplexity * 1e6 + 0.5)::HUGEINT)::DOUBLE / 1e6
                         AS perplexity_sum,
                         {r6("sum(floor(perplexity * 1e6 + 0.5)::HUGEINT)::DOUBLE / 1e6 / count(*)")}
                         AS perplexity_avg
                       FROM ppl WHERE task = {q(task)} GROUP BY model) f ON f.model = b.model""",
        pairs, "rouge_f", "lcs", "soft_f", "meteor_f", "ppl", instead=instead,
    )


_ROBUST = ("accuracy", "f1", "recall", "precision")


def _totals() -> str:
    columns = []
    for task in (*(t.task for t in TASKS), None):
        cond = f" FILTER (task = {q(task)})" if task else ""
        name = task or "end_to_end"
        columns += [
            f"coalesce(sum(floor(elapsed_s * 1e6 + 0.5)::BIGINT){cond}, 0)::BIGINT / 1e6 "
            f"AS total_time_{name}",
            f"coalesce(sum(micro){cond}, 0)::BIGINT / 1e6 AS total_cost_{name}",
        ]
    union = " UNION ALL ".join(
        f"SELECT task, model, elapsed_s, micro FROM {c}"
        for c in ("c_labelled2", "c_summary2", "c_response2")
    )
    return build(
        f"SELECT model, {', '.join(columns)} FROM ({union}) GROUP BY model",
        "c_labelled2", "c_summary2", "c_response2",
    )


def _all_calls(columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns} FROM {c}" for c in ("c_labelled", "c_summary", "c_response")
    )


_DAY = "strftime(date, '%Y-%m-%d')"
_MESSAGE = f"""SELECT review_id, model, pos::BIGINT AS pos, role, md5(content) AS content_md5,
      length(content) AS content_length
    FROM (SELECT review_id, model, 0 AS pos,
                 CASE WHEN chat_style = 'user' THEN 'user' ELSE 'system' END AS role,
                 {render_sql(TEMPLATES[("response", 2)])} AS content
          FROM open_customer CROSS JOIN models
          UNION ALL
          SELECT review_id, model, 1, 'user', review FROM open_customer CROSS JOIN models
          WHERE chat_style = 'system_user')"""


def _board_without_times() -> str:
    """Response times come from a clock where calls are really made."""
    return build("SELECT * EXCLUDE (total_response_time) FROM board", "board")


def _text_metrics(suffix: str = "", instead: dict[str, str] | None = None) -> dict[str, str]:
    ids = _K
    return {
        f"rouge_n{suffix}": build(
            f"""SELECT {ids}, max(f_set) FILTER (n = 1) AS rouge_1_set,
                  max(f_multiset) FILTER (n = 1) AS rouge_1_multiset,
                  max(f_set) FILTER (n = 2) AS rouge_2_set,
                  max(f_multiset) FILTER (n = 2) AS rouge_2_multiset
                FROM rouge_f GROUP BY ALL""",
            "rouge_f", instead=instead,
        ),
        f"rouge_l{suffix}": build(
            f"""SELECT p.task, p.review_id, p.model, CASE WHEN l.c IS NOT NULL
                  THEN {r6(_f("l.ov", "l.c", "l.r"))} END AS rouge_l
                FROM pairs p LEFT JOIN lcs l
                  ON l.task = p.task AND l.review_id = p.review_id AND l.model = p.model""",
            "pairs", "lcs", instead=instead,
        ),
        f"bleu{suffix}": build(f"SELECT {ids}, {r6('bleu')} AS bleu FROM bleu_f", "bleu_f", instead=instead),
        f"meteor{suffix}": build(f"SELECT {ids}, {r6('meteor')} AS meteor FROM meteor_f", "meteor_f", instead=instead),
        f"soft_match_f1{suffix}": build(f"SELECT {ids}, {r6('soft_f1')} AS soft_f1 FROM soft_f", "soft_f", instead=instead),
        f"perplexity{suffix}": build("SELECT * FROM ppl", "ppl", instead=instead),
    }


def all_sql() -> dict[str, str]:
    from revlens.plans import oracle_trained  # it builds on the parts above

    own = _own_sql()
    stored = {
        "reviews_landed": own["reviews_unified"],
        "rows_of_review": f"SELECT * FROM ({own['reviews_unified']}) WHERE review_id = (SELECT max(doc_id) FROM documents)",
        "e2e_detail_bucketed": own["e2e_detail"],
    }
    return own | stored | oracle_trained.all_sql()


def _own_sql() -> dict[str, str]:
    confusion_columns = ", ".join(
        f"count(*) FILTER (prediction = {q(x)}) AS pred_{x}" for x in (*LABELS, ERROR_LABEL)
    )
    ids = "task, review_id, model"
    return {
        "reviews_unified": build(
            f"""SELECT review_id, {_DAY} AS date, user_name, platform, lang, review, is_replied
                FROM reviews""",
            "reviews",
        ),
        "reviews_titled": build(
            "SELECT review_id, platform, title, is_replied FROM reviews", "reviews"
        ),
        "reviews_sample": build(
            f"""SELECT review_id, {_DAY} AS date, user_name, platform, lang, review, is_replied,
                  rank_in_platform, platform_order,
                  row_number() OVER (ORDER BY platform_order, rank_in_platform) AS position
                FROM (SELECT *, row_number() OVER (PARTITION BY platform
                              ORDER BY date DESC, review_id) AS rank_in_platform,
                        CASE WHEN platform = 'App Store' THEN 1::BIGINT ELSE 2 END
                          AS platform_order FROM reviews)
                WHERE rank_in_platform <= 5""",
            "reviews",
        ),
        "source_profile": build(
            """SELECT platform, count(*) AS n_reviews,
                 strftime(min(date), '%Y-%m-%d') AS first_date,
                 strftime(max(date), '%Y-%m-%d') AS last_date,
                 count(*) FILTER (review IS NULL) AS null_reviews,
                 count(*) FILTER (user_name IS NULL) AS null_users,
                 count(*) FILTER (is_replied = 'Yes') AS n_replied,
                 count(*) FILTER (title = 'No title') AS untitled
               FROM reviews GROUP BY platform""",
            "reviews",
        ),
        "reviews_distinct": build(
            """SELECT review, min(review_id) AS review_id, count(*) AS copies
               FROM reviews GROUP BY review""",
            "reviews",
        ),
        "by_text_first": build(
            """SELECT r.review_id, f.first_review_id, f.reference_summary FROM reviews r
               JOIN (SELECT review, s.review_id AS first_review_id, reference_summary
                     FROM (SELECT review, review_id, row_number() OVER (PARTITION BY review
                             ORDER BY review_id) AS rn FROM reviews) d
                     JOIN reference_summaries s ON s.review_id = d.review_id WHERE rn = 1) f
                 ON f.review = r.review""",
            "reviews", "reference_summaries",
        ),
        "by_text_last": build(
            """SELECT model, review_id, output, n_calls
               FROM (SELECT model, c.review_id, output,
                       count(*) OVER (PARTITION BY model, review) AS n_calls,
                       row_number() OVER (PARTITION BY model, review ORDER BY c.review_id DESC)
                         AS rn
                     FROM c_summary c JOIN reviews r ON r.review_id = c.review_id
                     WHERE output IS NOT NULL) WHERE rn = 1""",
            "c_summary", "reviews",
        ),
        "prompts": _prompts(),
        "prompt_messages": build(_MESSAGE, "open_customer", "models"),
        "token_cost": build(
            f"""SELECT {ids}, input_tokens, output_tokens, micro / 1e6 AS cost_usd,
                  exact_units / 1e10 AS cost_exact
                FROM ({_all_calls(ids + ", input_tokens, output_tokens, micro, exact_units")})""",
            "c_labelled", "c_summary", "c_response",
        ),
        "llm_response_parse": build(
            """SELECT review_id, model,
                 CASE WHEN json_valid(body)
                   THEN json_extract_string(body, '$.choices[0].message.content') END AS raw_output,
                 CASE WHEN json_valid(body)
                   THEN json_extract(body, '$.usage.completion_tokens')::BIGINT END
                   AS completion_tokens,
                 CASE WHEN NOT json_valid(body) THEN 'malformed response' END AS error
               FROM (SELECT review_id, model,
                       CASE WHEN (review_tokens + length(model)) % 23 = 5 THEN '<html>502</html>'
                       ELSE to_json({'choices': [{'message': {'content': raw_output}}],
                         'usage': {'completion_tokens': coalesce(completion_tokens, 0)}})::VARCHAR
                       END AS body
                     FROM c_summary WHERE err IS NULL)""",
            "c_summary",
        ),
        "call_errors": build(
            """SELECT review_id, model, raw_output, err AS output, err AS error, elapsed_s,
                 micro / 1e6 AS cost_usd FROM c_summary_unlisted WHERE err IS NOT NULL""",
            "c_summary_unlisted",
        ),
        "sentiment_validated": build(
            """SELECT review_id, model, label, output, prediction, ambiguous FROM s_labelled""",
            "s_labelled",
        ),
        "confusion": build(
            f"SELECT dataset, model, label, {confusion_columns} FROM s_eval GROUP BY ALL", "s_eval"
        ),
        "sentiment_leaderboard": build("SELECT * FROM board", "board"),
        "sentiment_leaderboard_from_log": _board_without_times(),
        "rerun_leaderboard": _board_without_times(),
        "reviews_without_id": build(
            f"""SELECT md5(concat_ws(chr(31), platform, user_name, {_DAY} || ' 12:00:00', review)) AS review_key,
                  {_DAY} AS date, user_name, platform, review, max(is_replied) AS is_replied,
                  count(*) AS copies
                FROM reviews WHERE lang = 'en' GROUP BY ALL""",
            "reviews",
        ),
        "model_rank": build(
            """SELECT dataset, model, f1, rank() OVER (PARTITION BY dataset ORDER BY f1 DESC)
                 AS model_rank FROM board""",
            "board",
        ),
        "noisy_reviews": build("SELECT review_id, noisy_review FROM noisy", "noisy"),
        "noise_robustness": build(
            "SELECT c.model, "
            + ", ".join(
                f"c.{m} AS {m}_clean, n.{m} AS {m}_noisy, {r6(f'c.{m} - n.{m}')} AS {m}_drop"
                for m in _ROBUST
            )
            + """ FROM board c JOIN board n ON n.model = c.model
                  WHERE c.dataset = 'customer' AND n.dataset = 'noisy'""",
            "board",
        ),
        "sentiment_wide": _wide(
            "s_eval", "dataset, review_id, label", "prediction",
            (("elapsed_s", "response_time"), ("micro / 1e6", "cost")),
        ),
        "summary_wide": _wide("c_summary", "review_id", "output"),
        "response_wide": _wide("c_response", "review_id", "output"),
        **_text_metrics(),
        **_text_metrics("_turns", {"pairs": "turn_pairs", "outputs": "turn_outputs"}),
        "soft_match_joined": _text_metrics()["soft_match_f1"],
        "best_reference": build(
            f"""SELECT review_id, model, reference, ref_no, {r6("similarity")} AS similarity
                FROM best""",
            "best",
        ),
        "polarity": build("SELECT * FROM review_polarity", "review_polarity"),
        "compression": build(
            f"""SELECT {ids}, {_compression("output")} AS compression
                FROM (SELECT {ids}, output, review_tokens FROM c_summary UNION ALL
                      SELECT {ids}, output, review_tokens FROM c_response)""",
            "c_summary", "c_response",
        ),
        "summary_leaderboard": quality("summary_pairs", "summary"),
        "response_leaderboard": quality("response_pairs", "response"),
        "leaderboard_long": build(
            """UNPIVOT (SELECT dataset, model, accuracy, f1, recall, precision,
                          total_response_time, total_cost FROM board)
               ON accuracy, f1, recall, precision, total_response_time, total_cost
               INTO NAME metric VALUE value""",
            "board",
        ),
        "tone_alignment": build(
            f"""SELECT model, count(*) AS n_replies, count(*) FILTER (same) AS n_aligned,
                  {r6("(count(*) FILTER (same))::DOUBLE / count(*)")} AS aligned_share
                FROM (SELECT model, sign(a.polarity) = sign(b.polarity) AS same
                      FROM reply_polarity a
                      JOIN review_polarity b ON a.review_id = b.review_id) GROUP BY model""",
            "reply_polarity", "review_polarity",
        ),
        "e2e_detail": build(
            """SELECT r.review_id, r.model, prediction AS sentiment, s.output AS summary,
                 r.output AS response
               FROM c_response2 r JOIN c_summary2 s
                 ON s.review_id = r.review_id AND s.model = r.model
               JOIN s_open2 t ON t.review_id = r.review_id AND t.model = r.model""",
            "c_response2", "c_summary2", "s_open2",
        ),
        "e2e_totals": _totals(),
        "batch_infer_log": build(
            """SELECT task, dataset, review_id, model, review_tokens, input_tokens, raw_output,
                 CASE WHEN err IS NULL THEN completion_tokens END AS completion_tokens,
                 err AS error FROM c_summary""",
            "c_summary",
        ),
        "pending_calls": build(
            """SELECT task, dataset, review_id, model, input_tokens FROM c_labelled
               WHERE err IS NOT NULL""",
            "c_labelled",
        ),
        "model_catalog_use": build(
            f"""SELECT m.model, price_in::DOUBLE AS price_in, price_out::DOUBLE AS price_out,
                  output_count, n_calls, total_cost
                FROM models m LEFT JOIN (SELECT model, count(*) AS n_calls,
                    sum(micro)::BIGINT / 1e6 AS total_cost
                  FROM ({_all_calls("model, micro")}) GROUP BY model) c ON c.model = m.model""",
            "models", "c_labelled", "c_summary", "c_response",
        ),
    }
