"""Scoring of answers and evaluation runs, over documents and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..plans import evaluation
from .registry import Tables, query

_ANSWER = "CASE doc_id % 3 WHEN 0 THEN 'Found ' || n_chars || ' campaigns for ' || lang || ', ' || source || ' (EA23-001)' ELSE text END"
_EXPECTED = """CASE doc_id % 5 WHEN 0 THEN CAST(n_chars AS {t}) WHEN 1 THEN lang || ' | ' || upper(source) || '|campaigns|the|zzzz'
  WHEN 2 THEN ' ' || upper(source) || ' ' WHEN 3 THEN 'TBD:later' ELSE lang || '|' || source END"""
_SOURCE_ID = "CASE doc_id % 4 WHEN 0 THEN 'EA23-001' WHEN 1 THEN 'TSB-' || (10160000 + n_chars) WHEN 2 THEN '' ELSE upper(source) END"


def _answers(t: Tables):
    return t.documents.select(
        "doc_id",
        F.expr(_ANSWER).alias("answer"),
        F.expr(_EXPECTED.format(t="string")).alias("expected"),
        F.expr(_SOURCE_ID).alias("source_id"),
    )


_SQL_ANSWERS = f"answers AS (SELECT doc_id, {_ANSWER} AS answer, {_EXPECTED.format(t='VARCHAR')} AS expected, {_SOURCE_ID} AS source_id FROM documents)"


@query(
    "score_exact",
    f"""WITH {_SQL_ANSWERS}, parts AS (SELECT *, trim(expected) AS want, lower(answer) AS got,
          list_filter(list_transform(string_split(lower(trim(expected)), '|'), lambda x: trim(x)), lambda x: x <> '') AS items FROM answers)
        SELECT doc_id, CASE WHEN contains(want, '|') THEN (len(list_filter(items, lambda x: contains(got, x))) / len(items) >= 0.8)::INTEGER::DOUBLE
          WHEN regexp_full_match(want, '-?[0-9]+([.][0-9]+)?') THEN coalesce(abs(TRY_CAST(regexp_extract(answer, '-?[0-9]+([.][0-9]+)?', 0) AS DOUBLE) - want::DOUBLE) < 1e-6, FALSE)::INTEGER::DOUBLE
          ELSE (want <> '' AND contains(got, lower(want)))::INTEGER::DOUBLE END AS score, starts_with(want, 'TBD:') AS pending FROM parts""",
)
def score_exact(t: Tables):
    return _answers(t).select(
        "doc_id",
        scoring.score_exact("expected", "answer").alias("score"),
        scoring.is_pending("expected").alias("pending"),
    )


_SQUASH = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_CITED = f"""(source_id <> '' AND (contains({_SQUASH.format(x='answer')}, {_SQUASH.format(x='source_id')})
  OR (length(regexp_replace(source_id, '[^0-9]', '', 'g')) >= 6 AND contains({_SQUASH.format(x='answer')}, regexp_replace(source_id, '[^0-9]', '', 'g')))))"""


@query("cite_match", f"WITH {_SQL_ANSWERS} SELECT doc_id, {_CITED} AS cited FROM answers")
def cite_match(t: Tables):
    return _answers(t).select("doc_id", scoring.cite_match("source_id", "answer").alias("cited"))


_JUDGE = "CASE WHEN quality = 1 THEN 4 + doc_id % 2 WHEN toxic = 1 THEN NULL ELSE doc_id % 4 END"


@query(
    "score_grounded",
    f"""WITH {_SQL_ANSWERS}, j AS (SELECT doc_id, {_JUDGE} AS judge FROM labels)
        SELECT doc_id, ({_CITED} AND coalesce(judge, 0) >= 4)::INTEGER::DOUBLE AS score, {_CITED}::INTEGER::DOUBLE AS unjudged
        FROM answers LEFT JOIN j USING (doc_id)""",
)
def score_grounded(t: Tables):
    judged = t.labels.select("doc_id", F.expr(_JUDGE).alias("judge"))
    return _answers(t).join(judged, "doc_id", "left").select(
        "doc_id",
        scoring.score_grounded("source_id", "answer", F.col("judge")).alias("score"),
        scoring.score_grounded("source_id", "answer").alias("unjudged"),
    )


_PARTS = ("n_chars % 6", "doc_id % 6", "(doc_id + n_chars) % 5", "length(lang)", "(n_chars * 7) % 6")


@query(
    "score_rubric",
    f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE {' + '.join(f'({p})' for p in _PARTS)} END AS total, n_chars % 5 AS overall FROM documents)
        SELECT doc_id, round(CASE WHEN total = 0 THEN overall ELSE total / 5.0 END::DOUBLE, 6) AS score, CASE WHEN total = 0 THEN overall ELSE total / 5.0 END >= 3.5 AS passed FROM p""",
)
def score_rubric(t: Tables):
    parts = [F.expr(f"CASE WHEN doc_id % 10 = 0 THEN 0 ELSE {p} END") for p in _PARTS]
    score = scoring.score_rubric(parts, F.expr("n_chars % 5"))
    return t.documents.select(
        "doc_id", F.round(score, 6).alias("score"), scoring.rubric_passed(score).alias("passed")
    )


# Written out on its own, so that an error in the library's pattern shows.
_CITE_SQL = (
    r"(?i)(\b[0-9]{2}[VEITC]-?[0-9]{3,}-?[0-9]*\b|\b(PE|EA|DP|RQ|AQ)[0-9]{2}-?[0-9]{3}\b|\bTSB[- #]*[0-9]{6,}\b"
    r"|\bODI([- ]?ID)?[- #]*[0-9]{6,}\b|\b[0-9]{8}\b)"
)
# Answers that cite in the forms found in the wild, next to the plain ones.
_CITING = """CASE doc_id % 9 WHEN 0 THEN 'see 25C' || (1000 + n_chars) || ' on seats' WHEN 1 THEN 'PE09' || (100 + n_chars % 900) || ' says so'
  WHEN 2 THEN 'RQ21-' || (100 + n_chars % 900) WHEN 3 THEN '24V-' || n_chars WHEN 4 THEN 'ODI ID #' || (100000 + n_chars)
  WHEN 5 THEN 'EA1' || n_chars ELSE text END"""


@query(
    "cite_id_present",
    f"""WITH {_SQL_ANSWERS}, c AS (SELECT doc_id, {_CITING} AS cited FROM documents)
        SELECT doc_id, regexp_matches(answer, '{_CITE_SQL}') AS present, regexp_matches(cited, '{_CITE_SQL}') AS in_the_wild FROM answers JOIN c USING (doc_id)""",
)
def cite_id_present(t: Tables):
    wild = t.documents.select("doc_id", F.expr(_ANSWER).alias("answer"), F.expr(_CITING).alias("cited"))
    return wild.select(
        "doc_id", scoring.cite_id_present("answer").alias("present"), scoring.cite_id_present("cited").alias("in_the_wild")
    )


@query(
    "score_breakdown",
    f"""WITH {_SQL_ANSWERS}, parts AS (SELECT *, trim(expected) AS want, lower(answer) AS got,
          list_filter(list_transform(string_split(lower(trim(expected)), '|'), lambda x: trim(x)), lambda x: x <> '') AS items FROM answers),
        k AS (SELECT *, CASE WHEN contains(want, '|') THEN 'list' WHEN regexp_full_match(want, '-?[0-9]+([.][0-9]+)?') THEN 'number' ELSE 'text' END AS kind FROM parts),
        h AS (SELECT *, CASE kind WHEN 'number' THEN coalesce(abs(TRY_CAST(regexp_extract(answer, '-?[0-9]+([.][0-9]+)?', 0) AS DOUBLE) - want::DOUBLE) < 1e-6, FALSE)
          WHEN 'text' THEN want <> '' AND contains(got, lower(want)) END AS hit FROM k),
        f AS (SELECT *, CASE WHEN kind = 'list' THEN list_filter(items, lambda x: contains(got, x)) WHEN hit THEN [want] ELSE [] END AS found,
          CASE WHEN kind = 'list' THEN list_filter(items, lambda x: NOT contains(got, x)) WHEN hit THEN [] ELSE [want] END AS missing FROM h)
        SELECT doc_id, kind, len(found) / greatest(len(found) + len(missing), 1)::DOUBLE AS coverage, array_to_string(found, '|') AS found,
          array_to_string(missing, '|') AS missing FROM f""",
)
def score_breakdown(t: Tables):
    """What was found of each expected value, and what was not."""
    rows = _answers(t).select("doc_id", scoring.exact_breakdown("expected", "answer").alias("b"))
    return rows.select("doc_id", "b.kind", "b.coverage", F.array_join("b.found", "|").alias("found"), F.array_join("b.missing", "|").alias("missing"))


@query(
    "word_count_under",
    r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INTEGER AS words, len(regexp_extract_all(text, '\S+')) <= 400 AS short_enough FROM documents",
)
def word_count_under(t: Tables):
    return t.documents.select(
        "doc_id", scoring.word_count("text").alias("words"), scoring.word_count_under("text").alias("short_enough")
    )


# Written out on their own, so that a name missing from the library's list shows.
_NAMES_IN_ANSWERS = (
    "tesla|ford|general motors|chevrolet|gmc|cadillac|toyota|lexus|honda|acura|nissan|infiniti|hyundai|kia|genesis|bmw|mercedes-benz|audi"
    "|volkswagen|porsche|stellantis|jeep|ram|dodge|chrysler|subaru|mazda|volvo|rivian|lucid|polestar|cruise|waymo|zoox"
).split("|")


@query(
    "mentions_keyword",
    "SELECT doc_id, "
    + " OR ".join(f"contains(lower(text), '{k}')" for k in _NAMES_IN_ANSWERS)
    + " AS mentions FROM documents",
)
def mentions_keyword(t: Tables):
    return t.documents.select("doc_id", scoring.mentions_any("text").alias("mentions"))


_RESULTS = """'tier' || (1 + doc_id % 3) AS tier, 'Q' || (doc_id % 40) AS question, text AS answer, (n_chars % 40) / 10.0 AS score,
  quality = 1 AS passed, (doc_id % 3 = 0 AND doc_id % 2 = 0) AS pending, n_chars / 1000.0 AS latency_s,
  CAST(n_chars % 5 AS {i}) AS n_tool_calls, CAST(n_chars % 3 AS {i}) AS n_llm_calls, CASE WHEN toxic = 1 THEN 'error' ELSE 'ok' END AS stopped_reason"""
_SQL_RESULTS = f"results AS (SELECT doc_id, {_RESULTS.format(i='INTEGER')} FROM labels JOIN documents USING (doc_id))"


def _results(t: Tables):
    rows = t.labels.join(t.documents, "doc_id").selectExpr("doc_id", *_split(_RESULTS.format(i="int")))
    return rows.withColumns({"score": F.col("score").cast("double"), "latency_s": F.col("latency_s").cast("double")})


def _split(columns: str) -> list[str]:
    """Comma-separated expressions, commas inside brackets kept."""
    out, depth, start = [], 0, 0
    for i, char in enumerate(columns):
        depth += (char == "(") - (char == ")")
        if char == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


@query(
    "eval_aggregate",
    f"""WITH {_SQL_RESULTS}, r AS (SELECT tier, latency_s, row_number() OVER (PARTITION BY tier ORDER BY latency_s) - 1 AS i, count(*) OVER (PARTITION BY tier) AS c FROM results),
        p AS (SELECT tier, max(latency_s) AS p95 FROM r WHERE i = round_even(0.95 * (c - 1)::DOUBLE, 0) GROUP BY tier),
        m AS (SELECT tier, count(*) AS n, count(*) FILTER (WHERE NOT pending) AS n_scored, count(*) FILTER (WHERE pending) AS n_pending,
          count(*) FILTER (WHERE NOT pending AND passed) AS ok, avg(latency_s::DOUBLE) AS lat, avg(n_tool_calls) AS tools, avg(n_llm_calls) AS llm,
          count(*) FILTER (WHERE stopped_reason <> 'ok') AS errors, avg(CASE WHEN NOT pending THEN score::DOUBLE END) AS sc FROM results GROUP BY tier)
        SELECT tier, n, n_scored, n_pending, round(ok / greatest(n_scored, 1), 4) AS pass_rate, round(lat, 3) AS mean_latency_seconds,
          round(p95::DOUBLE, 3) AS p95_latency_seconds, round(tools, 2) AS mean_tool_calls, round(llm, 2) AS mean_llm_calls, round(errors / n, 4) AS error_rate,
          CASE WHEN tier = 'tier1' THEN round(ok / greatest(n_scored, 1), 4) END AS tier1_exact_match_rate,
          CASE WHEN tier = 'tier2' THEN round(ok / greatest(n_scored, 1), 4) END AS tier2_grounded_pass_rate,
          CASE WHEN tier = 'tier3' THEN round(coalesce(sc, 0), 3) END AS tier3_avg_judge_score FROM m JOIN p USING (tier)""",
)
def eval_aggregate(t: Tables):
    return evaluation.tier_metrics(_results(t))


@query(
    "eval_gate",
    f"""WITH {_SQL_RESULTS}, m AS (SELECT tier, round(count(*) FILTER (WHERE stopped_reason <> 'ok') / count(*), 4) AS e FROM results GROUP BY tier)
        SELECT tier, tier || ': error_rate=' || e || ' > 0.2' AS issue FROM m WHERE e > 0.2""",
)
def eval_gate(t: Tables):
    return evaluation.gate(evaluation.tier_metrics(_results(t)))


@query(
    "eval_enrich",
    f"""WITH {_SQL_RESULTS}, truth AS (SELECT CASE WHEN item_id % 5 = 0 THEN 'R' ELSE 'Q' END || item_id AS question, CASE WHEN item_id % 4 = 0 THEN 'TBD:' || item_id ELSE 'value ' || item_id END AS expected_value
          FROM benchmark)
        SELECT doc_id, r.question, expected_value, expected_value IS NOT NULL AS _matched, coalesce(starts_with(expected_value, 'TBD:'), FALSE) AS is_pending
        FROM results r LEFT JOIN truth t ON r.question = t.question""",
)
def eval_enrich(t: Tables):
    """Results and the question set; every fifth question of the results has no counterpart in the set."""
    truth = t.benchmark.selectExpr(
        "CASE WHEN item_id % 5 = 0 THEN 'R' ELSE 'Q' END || CAST(item_id AS string) AS question",
        "CASE WHEN item_id % 4 = 0 THEN 'TBD:' || item_id ELSE 'value ' || item_id END AS expected_value",
    )
    out = evaluation.with_ground_truth(_results(t).select("doc_id", "question"), truth)
    return out.select("doc_id", "question", "expected_value", "_matched", "is_pending")


@query(
    "eval_triage",
    f"""WITH {_SQL_ANSWERS}, f AS (SELECT a.*, {_JUDGE} AS judge FROM answers a JOIN labels USING (doc_id) WHERE quality = 0),
        b AS (SELECT CASE WHEN NOT {_CITED} THEN CASE WHEN regexp_replace(source_id, '[^0-9]', '', 'g') <> ''
            AND contains({_SQUASH.format(x='answer')}, regexp_replace(source_id, '[^0-9]', '', 'g')) THEN 'A' ELSE 'B' END
          WHEN judge IS NULL THEN 'D' WHEN judge < 4 THEN 'C' ELSE 'other' END AS bucket FROM f)
        SELECT bucket, count(*) AS n FROM b GROUP BY bucket""",
)
def eval_triage(t: Tables):
    rows = _answers(t).join(t.labels, "doc_id").withColumn("judge", F.expr(_JUDGE)).withColumn("passed", F.col("quality") == 1)
    return evaluation.triage(rows, scoring.cite_match("source_id", "answer"), F.col("judge").cast("double"))


@query(
    "eval_worst",
    f"WITH {_SQL_RESULTS} SELECT doc_id, score::DOUBLE AS score FROM results WHERE tier = 'tier3' ORDER BY coalesce(score, 0), question, doc_id LIMIT 2",
)
def eval_worst(t: Tables):
    return evaluation.worst(_results(t).where("tier = 'tier3'"), 2, ["question", "doc_id"]).select("doc_id", "score")


@query(
    "retrieved_context",
    """SELECT conv_id, turn, '[' || role || '] ' || text || chr(10) || '[again] ' AS context FROM conversations""",
)
def retrieved_context(t: Tables):
    trace = F.array(
        F.struct(F.col("role").alias("name"), F.col("text").alias("result_preview")),
        F.struct(F.lit("again").alias("name"), F.lit(None).cast("string").alias("result_preview")),
    )
    return t.conversations.select("conv_id", "turn", scoring.retrieved_context(trace).alias("context"))
