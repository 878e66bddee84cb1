"""SQL twins of the queries over trained models."""

from __future__ import annotations

import math

from revlens.functions.text import WS_CHARS
from revlens.operators import bootstrap, extractive, latency, naive_bayes, perplexity, retrieval
from revlens.plans.oracle import (
    board_parts,
    build,
    calls_part,
    h,
    part,
    q,
    quality,
    r6,
    sents,
    strip,
    toks,
    words,
)
from revlens.sources.catalog import LABELS

_HELD = f"{h(q('fold:') + ' || review_id')} % {naive_bayes.FOLDS} = 0"


def _ln(x: str) -> str:
    return f"floor(ln(({x})::DOUBLE) * 1e9 + 0.5)::BIGINT"


part(
    "nb_counts",
    f"""SELECT term, {", ".join(f"count(*) FILTER (label = {q(x)}) AS n_{x}" for x in LABELS)}
        FROM (SELECT label, unnest({words("review")}) AS term FROM evaluation
              WHERE dataset = 'customer' AND NOT {_HELD})
        GROUP BY term HAVING count(*) >= {naive_bayes.MIN_COUNT}""",
    "evaluation",
)
part(
    "nb_totals",
    f"""SELECT {", ".join(f"{_ln(f'greatest(coalesce(tokens_{x}, 0) + vocabulary, 1)')} AS base_{x}" for x in LABELS)},
               {", ".join(f"{_ln(f'docs_{x} + 1')} AS prior_{x}" for x in LABELS)}
        FROM (SELECT count(*) AS vocabulary, {", ".join(f"sum(n_{x}) AS tokens_{x}" for x in LABELS)} FROM nb_counts),
             (SELECT {", ".join(f"count(*) FILTER (label = {q(x)}) AS docs_{x}" for x in LABELS)}
              FROM evaluation WHERE dataset = 'customer' AND NOT {_HELD})""",
    "nb_counts", "evaluation",
)
part(
    "nb_sums",
    f"""SELECT e.dataset, e.review_id, e.label, count(n_{LABELS[0]}) AS n_known,
          {", ".join(f"coalesce(sum({_ln(f'n_{x} + 1')}), 0)::BIGINT AS s_{x}" for x in LABELS)}
        FROM evaluation e
        LEFT JOIN (SELECT dataset, review_id, unnest({words("review")}) AS term FROM evaluation) w
          ON w.dataset = e.dataset AND w.review_id = e.review_id
        LEFT JOIN nb_counts USING (term) GROUP BY ALL""",
    "evaluation", "nb_counts",
)
_SCORES = "[" + ", ".join(f"s_{x} + prior_{x} - n_known * base_{x}" for x in LABELS) + "]"
_NAMES = "[" + ", ".join(q(x) for x in LABELS) + "]"
part(
    "nb_answers",
    f"""SELECT dataset, review_id, label, n_known, {_NAMES}[list_position(sc, list_max(sc))] AS prediction,
          list_reverse_sort(sc)[1] - list_reverse_sort(sc)[2] AS margin, {_HELD} AS held_out
        FROM (SELECT *, {_SCORES} AS sc FROM nb_sums, nb_totals)""",
    "nb_sums", "nb_totals",
)
part(
    "s_unseen",
    f"""SELECT dataset, review_id, model, label, prediction, elapsed_s, micro FROM s_eval WHERE {_HELD}
        UNION ALL SELECT dataset, review_id, {q(naive_bayes.NAME)}, label, prediction, 0.0, 0
        FROM nb_answers WHERE held_out""",
    "s_eval", "nb_answers",
)
board_parts("_unseen", "s_unseen")
_N, _TAIL = bootstrap.REPLICATES, bootstrap.TAIL
_DRAW = (
    f"('0x' || substr(sha256('boot:' || dataset || ':' || review_id || ':' || ((r - 1) // {bootstrap.PER_DIGEST})), "
    f"(r - 1) % {bootstrap.PER_DIGEST} * 4 + 1, 4))::BIGINT"
)
part(
    "b_rows",
    f"""SELECT dataset, model, label, prediction, r,
          CASE WHEN r = 0 THEN 1 ELSE len(list_filter({list(bootstrap.THRESHOLDS)}, lambda t: t <= {_DRAW})) END AS n
        FROM (SELECT *, unnest(range(0, {_N + 1})) AS r FROM s_unseen)""",
    "s_unseen",
)
part(
    "b_scores",
    f"""SELECT dataset, model, r, {r6("f1 / n")} AS f1 FROM (
          SELECT dataset, model, r, sum(support)::BIGINT AS n,
            sum(support * CASE WHEN predicted + support = 0 THEN 0.0::DOUBLE
                ELSE 2 * tp::DOUBLE / (predicted + support) END ORDER BY list_position({_NAMES}, label)) AS f1
          FROM (SELECT b.dataset, b.model, b.r, c.label,
                  coalesce(sum(n) FILTER (b.label = c.label), 0)::BIGINT AS support,
                  coalesce(sum(n) FILTER (b.prediction = c.label), 0)::BIGINT AS predicted,
                  coalesce(sum(n) FILTER (b.label = c.label AND b.prediction = c.label), 0)::BIGINT AS tp
                FROM b_rows b CROSS JOIN (SELECT unnest({_NAMES}) AS label) c GROUP BY ALL)
          GROUP BY ALL) WHERE n > 0""",
    "b_rows",
)


def _between(x: str, name: str) -> str:
    values = f"list_sort(list({x}) FILTER (r > 0))"
    return (
        f"{values}[1 + least({_TAIL}, len({values}) - 1)] AS {name}_low, "
        f"{values}[greatest(len({values}) - {_TAIL}, 1)] AS {name}_high"
    )


part(
    "b_ranks",
    f"""SELECT dataset, model, max(f1) FILTER (r = 0) AS f1, {_between("f1", "f1")},
          max(place) FILTER (r = 0) AS model_rank, {_between("place", "rank")},
          {r6("(count(*) FILTER (r > 0 AND place = 1))::DOUBLE / count(*) FILTER (r > 0)")} AS leads
        FROM (SELECT *, rank() OVER (PARTITION BY dataset, r ORDER BY f1 DESC) AS place FROM b_scores)
        GROUP BY ALL""",
    "b_scores",
)
part(
    "s_mixed",
    f"""SELECT dataset, model, label, prediction, 0.0 AS elapsed_s, micro FROM s_eval
        UNION ALL SELECT dataset, {q(naive_bayes.NAME)}, label, prediction, 0.0, 0 FROM nb_answers""",
    "s_eval", "nb_answers",
)
board_parts("_mixed", "s_mixed")


# --- summaries: sentence and term weights step by step, as joins -------------------

part(
    "x_sentences",
    f"""SELECT review_id, i, {strip("s")} AS s FROM (
          SELECT review_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i
          FROM (SELECT review_id, {sents("coalesce(review, '')")} AS ss FROM reviews))""",
    "reviews",
)
part(
    "x_terms",
    f"SELECT DISTINCT review_id, i, unnest({words('s')}) AS term FROM x_sentences",
    "x_sentences",
)
part("x_w0", f"SELECT review_id, i, {extractive.SCALE}::BIGINT AS w FROM x_sentences", "x_sentences")
for _k in range(extractive.STEPS):
    part(
        f"x_w{_k + 1}",
        f"""SELECT review_id, i, g * {extractive.SCALE} // greatest(max(g) OVER (PARTITION BY review_id), 1) AS w
            FROM (SELECT s.review_id, s.i, coalesce(sum(mass)::BIGINT // count(t.term), 0)::BIGINT AS g
                  FROM x_sentences s LEFT JOIN x_terms t ON t.review_id = s.review_id AND t.i = s.i
                  LEFT JOIN (SELECT t.review_id, term, sum(w) AS mass FROM x_terms t
                             JOIN x_w{_k} w ON w.review_id = t.review_id AND w.i = t.i GROUP BY ALL) m
                    ON m.review_id = t.review_id AND m.term = t.term
                  GROUP BY ALL)""",
        "x_sentences", "x_terms", f"x_w{_k}",
    )
part(
    "x_ranked",
    f"""SELECT *, sum(n) OVER o AS upto, row_number() OVER o AS place FROM (
          SELECT review_id, i, s, w, len({toks("s")}) AS n FROM x_sentences JOIN x_w{extractive.STEPS} USING (review_id, i))
        WINDOW o AS (PARTITION BY review_id ORDER BY w DESC, i)""",
    "x_sentences", f"x_w{extractive.STEPS}",
)
part(
    "x_summaries",
    f"""SELECT r.review_id, count(s) AS n_sentences,
          CASE WHEN count(s) = 0 THEN ''
               WHEN min(upto) > {extractive.BUDGET}
                 THEN array_to_string({toks("arg_min(s, place)")}[1:{extractive.BUDGET}], ' ')
               ELSE string_agg(s, '. ' ORDER BY i) FILTER (upto <= {extractive.BUDGET}) END AS summary
        FROM reviews r LEFT JOIN x_ranked x ON x.review_id = r.review_id GROUP BY r.review_id""",
    "reviews", "x_ranked",
)
calls_part("c_summary_others", "customer", "summary")
part(
    "c_summary_all",
    f"""SELECT * FROM c_summary_others UNION ALL BY NAME
        SELECT 'summary' AS task, 'customer' AS dataset, review_id, {q(extractive.NAME)} AS model,
          len({toks("review")}) AS review_tokens, lower(trim(summary, {q(WS_CHARS)})) AS output,
          0.0 AS elapsed_s, 0 AS micro
        FROM x_summaries JOIN reviews USING (review_id)""",
    "c_summary_others", "x_summaries", "reviews",
)


# --- replies: every open review against every known reply --------------------------

part(
    "r_terms",
    f"""SELECT conv_id, turn, term, count(*)::DOUBLE AS tf FROM (
          SELECT conv_id, turn, unnest({words("text")}) AS term
          FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS copy
                FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
          WHERE copy = 1) GROUP BY ALL""",
)
part(
    "r_impacts",
    f"""SELECT conv_id, turn, term, floor(
            ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))
            * (tf * {retrieval.K1 + 1}::DOUBLE / (tf + {retrieval.K1}::DOUBLE
               * ({1 - retrieval.B}::DOUBLE + {retrieval.B}::DOUBLE * (length / (tokens / n)))))
            * 1e6 + 0.5)::BIGINT AS impact
        FROM r_terms
        JOIN (SELECT conv_id, turn, sum(tf)::DOUBLE AS length FROM r_terms GROUP BY ALL) USING (conv_id, turn)
        JOIN (SELECT term, count(*)::DOUBLE AS df FROM r_terms GROUP BY ALL) USING (term)
        CROSS JOIN (SELECT sum(tf)::DOUBLE AS tokens, count(DISTINCT (conv_id, turn))::DOUBLE AS n FROM r_terms)""",
    "r_terms",
)
part(
    "r_best",
    f"""SELECT review_id, conv_id, turn, score FROM (
          SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, conv_id, turn) AS place FROM (
            SELECT review_id, conv_id, turn, sum(impact)::BIGINT AS score
            FROM (SELECT DISTINCT review_id, unnest({words("coalesce(review, '')")}) AS term FROM open_customer)
            JOIN r_impacts USING (term) GROUP BY ALL))
        WHERE place = 1 AND score > 0""",
    "open_customer", "r_impacts",
)
calls_part("c_response_others", "open_customer", "response")
part(
    "c_response_all",
    f"""SELECT * FROM c_response_others UNION ALL BY NAME
        SELECT 'response' AS task, 'customer' AS dataset, o.review_id, o.user_name, {q(retrieval.NAME)} AS model,
          len({toks("review")}) AS review_tokens, trim(text, {q(WS_CHARS)}) AS output, 0.0 AS elapsed_s, 0 AS micro,
          CASE WHEN text IS NULL THEN {q(retrieval.NO_REPLY)} END AS err
        FROM open_customer o LEFT JOIN r_best b ON b.review_id = o.review_id
        LEFT JOIN conversations c ON c.conv_id = b.conv_id AND c.turn = b.turn AND c.role = 'assistant'""",
    "c_response_others", "open_customer", "r_best",
)


# --- Kneser-Ney: every occurrence priced on its own ---------------------------------


def _trigrams(source: str, keep: str, text: str) -> str:
    start = q(perplexity.START)
    return f"""SELECT {keep}CASE WHEN i > 2 THEN ts[i - 2] ELSE {start} END AS u, coalesce(ts[i - 1], {start}) AS v, ts[i] AS w
        FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i
              FROM (SELECT *, {toks(f"lower({text})")} AS ts FROM {source}))"""


part(
    "k3",
    f"SELECT u, v, w, count(*) AS c3 FROM ({_trigrams('reviews', '', 'review')}) GROUP BY ALL",
    "reviews",
)
part("k2", "SELECT v, w, count(*) AS c2 FROM k3 GROUP BY ALL", "k3")
part("k1", "SELECT w, count(*) AS c1 FROM k2 GROUP BY ALL", "k2")
_D = f"{perplexity.DISCOUNT}::DOUBLE"


def _less(n: str) -> str:
    return f"greatest(coalesce({n}, 0)::DOUBLE - {_D}, 0.0::DOUBLE)"


part(
    "ppl_kn",
    f"""SELECT task, review_id, model, count(*) AS n_tokens,
          {r6("exp(-sum(floor(ln(p3) * 1e9 + 0.5)::BIGINT)::DOUBLE / 1e9 / count(*))")} AS perplexity
        FROM (SELECT *, CASE WHEN t3 IS NULL THEN p2 ELSE ({_less("c3")} + {_D} * f3 * p2) / t3::DOUBLE END AS p3
        FROM (SELECT *, CASE WHEN t2 IS NULL THEN p1 ELSE ({_less("c2")} + {_D} * f2 * p1) / t2::DOUBLE END AS p2
        FROM (SELECT *, CASE WHEN t1 = 0 THEN 1.0::DOUBLE
                     ELSE ({_less("c1")} + {_D} * f1 / (f1 + 1.0::DOUBLE)) / t1 END AS p1
        FROM ({_trigrams("turn_pairs", "task, review_id, model, ", "output")})
        LEFT JOIN k3 USING (u, v, w) LEFT JOIN k2 USING (v, w) LEFT JOIN k1 USING (w)
        LEFT JOIN (SELECT u, v, sum(c3) AS t3, count(*) AS f3 FROM k3 GROUP BY ALL) USING (u, v)
        LEFT JOIN (SELECT v, sum(c2) AS t2, count(*) AS f2 FROM k2 GROUP BY ALL) USING (v)
        CROSS JOIN (SELECT coalesce(sum(c1), 0)::DOUBLE AS t1, count(*)::DOUBLE AS f1 FROM k1))))
        GROUP BY ALL""",
    "turn_pairs", "k3", "k2", "k1",
)


# --- response times ----------------------------------------------------------------

part(
    "time_buckets",
    f"""SELECT task, model, n, sum(n) OVER (PARTITION BY task, model ORDER BY bucket) AS upto,
          sum(n) OVER (PARTITION BY task, model) AS total,
          2.0::DOUBLE * pow({latency.GROWTH!r}::DOUBLE, bucket::DOUBLE) / {latency.GROWTH + 1!r}::DOUBLE AS value
        FROM (SELECT task, model, ceil(ln(elapsed_s) / {math.log(latency.GROWTH)!r}::DOUBLE)::BIGINT AS bucket,
                count(*) AS n
              FROM (SELECT task, model, elapsed_s, err FROM c_summary UNION ALL
                    SELECT task, model, elapsed_s, err FROM c_response)
              WHERE err IS NULL GROUP BY ALL)""",
    "c_summary", "c_response",
)
_SHARES = ", ".join(
    f"{r6(f'min(value) FILTER (upto > floor({s}::DOUBLE * (total - 1)))')} AS p{round(100 * s)}" for s in (0.5, 0.9, 0.99)
)


def all_sql() -> dict[str, str]:
    return {
        "sentiment_trained": build("SELECT * FROM nb_answers", "nb_answers"),
        "summary_extracted": build("SELECT * FROM x_summaries", "x_summaries"),
        "summary_leaderboard_extracted": quality("summary_pairs", "summary", {"c_summary": "c_summary_all"}),
        "reply_retrieved": build(
            """SELECT review_id, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, score
               FROM open_customer LEFT JOIN r_best USING (review_id)""",
            "open_customer", "r_best",
        ),
        "response_leaderboard_retrieved": quality("response_pairs", "response", {"c_response": "c_response_all"}),
        "latency_quantiles": build(
            f"SELECT task, model, max(total)::BIGINT AS n_calls, {_SHARES} FROM time_buckets GROUP BY ALL",
            "time_buckets",
        ),
        "model_rank_ci": build("SELECT * FROM b_ranks", "b_ranks"),
        "dispatch_mixed": build("SELECT * EXCLUDE (total_response_time) FROM board_mixed", "board_mixed"),
        "perplexity_kn": build("SELECT * FROM ppl_kn", "ppl_kn"),
        "sentiment_leaderboard_trained": build("SELECT * FROM board_unseen", "board_unseen"),
    }
