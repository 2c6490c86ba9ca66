"""DuckDB oracle SQL for each registered query (independent of the Spark code)."""

from __future__ import annotations

from .oracle_fixtures import with_fixtures

ORACLE: dict[str, str] = {}

_M = ["helpfulness", "correctness", "coherence", "tone_score", "accuracy", "relevance", "completeness", "clarity"]


def _score(k: int) -> str:
    return f"((b + {13 * k}) % 101) / cast(100 as double)"


# --------------------------------------------------------------------------- pairing

ORACLE["fanout_pairs"] = with_fixtures(["prompts", "models"], """
select p.prompt_id, t.model as target_model, e.model as evaluator, t.i as model_idx, e.i as evaluator_idx
from prompts p cross join models t join models e on t.i <> e.i
""")

ORACLE["fanout_selected"] = with_fixtures(["prompts", "models"], """
select p.prompt_id, t.model as target_model, e.model as evaluator
from prompts p cross join models t join models e on t.i <> e.i
where t.model in ('model_a', 'model_c')
""")

# --------------------------------------------------------------------------- judgments
# Expected values per fault class, computed arithmetically (no JSON parsing):
# f 0 -> no_json, 1/7 -> bad_json, 6 -> empty, else ok; f2 helpfulness missing (row 0.5),
# f3 correctness JSON null, f4 coherence the string "0.8", f5 clarity boolean true.


def _judgment_values() -> str:
    rows, nums = [], []
    for k, m in enumerate(_M):
        v = _score(k)
        row, num = v, v
        if m == "helpfulness":
            row = f"case when f = 2 then 0.5 else {v} end"
            num = f"case when f = 2 then null else {v} end"
        elif m == "correctness":
            row = f"case when f = 3 then null else {v} end"
            num = row
        elif m == "coherence":
            row = f"case when f = 4 then 0.8 else {v} end"
            num = f"case when f = 4 then null else {v} end"
        elif m == "clarity":
            row = f"case when f = 5 then 1.0 else {v} end"
            num = row
        rows.append(f"cast(case when f in (0, 1, 6, 7) then null else {row} end as double) as {m}")
        nums.append(f"cast(case when f in (0, 1, 6, 7) then null else {num} end as double) as num_{m}")
    return ",\n  ".join(rows + nums)


_PARSED = f"""
select prompt_id, target_model, evaluator,
  case when f = 0 then 'no_json' when f in (1, 7) then 'bad_json' when f = 6 then 'empty' else 'ok' end as status,
  {_judgment_values()},
  case when f in (0, 1, 6, 7) then null else 'ok' end as reasoning,
  case when f in (0, 1, 6, 7) then null else '' end as notes
from judgments_raw
"""

ORACLE["judgment_parse"] = with_fixtures(["judgments_raw"], _PARSED)

ORACLE["judgment_failures"] = with_fixtures(["judgments_raw"], """
select evaluator, status, count(*) as n,
  round_even(count(*) / sum(count(*)) over (partition by evaluator), 6) as share
from parsed group by evaluator, status
""", [("parsed", _PARSED)])

ORACLE["missing_judgments"] = with_fixtures(["judgments_raw"], """
select prompt_id, target_model, evaluator from judgments_raw where f in (0, 1, 6, 7)
""")


def _py_round(x: str) -> str:
    """Three decimals by formatting: the printed digits come from the double's exact value, as Python's round does."""
    return f"cast(format('{{:.3f}}', {x}) as double)"


def _mean(col: str) -> str:
    """Exact mean of two-decimal scores: whole multiples of 2**-60, added as integers."""
    return f"(cast(cast(sum(cast({col} * 1152921504606846976.0 as bigint)) as bigint) as double) / 1152921504606846976.0 / count({col}))"


def _target_avgs(parsed: str = "parsed") -> str:
    means = ", ".join(f"{_mean(f'num_{m}')} as mean_{m}" for m in _M)
    cols = ",\n  ".join(f"coalesce({_py_round(f'mean_{m}')}, 0.5) as avg_{m}" for m in _M)
    return f"""
select prompt_id, target_model,
  {cols},
  n_evaluators
from (select prompt_id, target_model, {means}, count(*) as n_evaluators
      from {parsed} where status = 'ok' group by prompt_id, target_model) g
"""


ORACLE["target_averages"] = with_fixtures(["judgments_raw"], _target_avgs(), [("parsed", _PARSED)])
ORACLE["target_averages_five"] = with_fixtures(
    ["judgments_raw5"], _target_avgs("parsed5"), [("parsed5", _PARSED.replace("from judgments_raw", "from judgments_raw5"))]
)

ORACLE["evaluations_full"] = with_fixtures(["judgments_raw", "responses"], f"""
select j.prompt_id, r.prompt, j.target_model, j.evaluator, r.response, r.reasoning as explainability,
  {", ".join("j." + m for m in _M)}, j.reasoning, j.notes,
  {", ".join(f"a.avg_{m}" for m in _M)}
from parsed j
join responses r on r.prompt_id = j.prompt_id and r.model = j.target_model
join avgs a on a.prompt_id = j.prompt_id and a.target_model = j.target_model
where j.status = 'ok'
""", [("parsed", _PARSED), ("avgs", _target_avgs())])

ORACLE["evaluation_table"] = with_fixtures(["judgments_raw"], f"""
select prompt_id, target_model, evaluator, {", ".join(_M)} from parsed where status = 'ok'
""", [("parsed", _PARSED)])

ORACLE["model_summary"] = with_fixtures(["judgments_raw", "responses"], """
select r.prompt_id, r.model as target_model,
  case when a.n > 0 then coalesce(a.h, 0.5) end as helpfulness,
  case when a.n > 0 then coalesce(a.c, 0.5) end as correctness,
  case when a.n > 0 then coalesce(a.o, 0.5) end as coherence,
  coalesce(a.evaluators, '') as evaluators
from responses r left join (
  select prompt_id, target_model, """ + ", ".join(f"{_py_round(_mean('num_' + m))} as {k}" for m, k in
    (("helpfulness", "h"), ("correctness", "c"), ("coherence", "o"))) + """,
    string_agg(evaluator, ', ' order by evaluator) as evaluators, count(*) as n
  from parsed where status = 'ok' group by prompt_id, target_model) a
  on a.prompt_id = r.prompt_id and a.target_model = r.model
""", [("parsed", _PARSED)])


# --------------------------------------------------------------------------- analysis (eval_facts)

_C4 = ["helpfulness", "correctness", "coherence", "clarity"]


def _stats(key_cols: str, where: str, std=True, count_of=None, source="eval_facts") -> str:
    cols = []
    for m in _C4:
        cols.append(f"round_even(avg({m}), 3) as {m}_mean")
        if std:
            cols.append(f"round_even(stddev_samp({m}), 3) as {m}_std")
        if count_of == m:
            cols.append(f"count({m}) as {m}_count")
    return f"select {key_cols}, {', '.join(cols)} from {source} where {where} group by {key_cols}"


ORACLE["model_stats"] = with_fixtures(["eval_facts"], _stats("target_model", "target_model is not null", count_of="helpfulness"))
ORACLE["evaluator_stats"] = with_fixtures(["eval_facts"], _stats("evaluator", "evaluator is not null"))
ORACLE["cross_eval"] = with_fixtures(
    ["eval_facts"], _stats("target_model, evaluator", "target_model is not null and evaluator is not null", std=False)
)
ORACLE["simple_stats"] = with_fixtures(
    ["eval_facts"], _stats("model", "model is not null", source="(select target_model as model, * from eval_facts) s")
)


def _gs_part(name, keys, where):
    tm = "target_model" if "target_model" in keys else "cast(null as varchar) as target_model"
    ev = "evaluator" if "evaluator" in keys else "cast(null as varchar) as evaluator"
    cols = []
    for m in _C4:
        cols += [f"round_even(avg({m}), 3) as {m}_mean", f"round_even(stddev_samp({m}), 3) as {m}_std"]
    return f"select '{name}' as grouping, {tm}, {ev}, {', '.join(cols)} from eval_facts where {where} group by {', '.join(keys)}"


ORACLE["stats_grouping_sets"] = with_fixtures(["eval_facts"], "\nunion all\n".join([
    _gs_part("target_model", ["target_model"], "target_model is not null"),
    _gs_part("evaluator", ["evaluator"], "evaluator is not null"),
    _gs_part("target_model,evaluator", ["target_model", "evaluator"], "target_model is not null and evaluator is not null"),
]))


def _overall(key: str) -> str:
    means = ", ".join(f"avg({m}) as {m}" for m in _C4)
    nn = " + ".join(f"(case when {m} is not null then 1 else 0 end)" for m in _C4)
    sm = " + ".join(f"coalesce({m}, 0)" for m in _C4)
    return f"""select {key}, case when ({nn}) > 0 then ({sm}) / ({nn}) end as overall
from (select {key}, {means} from eval_facts where {key} is not null group by {key}) t"""


ORACLE["overall_scores"] = with_fixtures(["eval_facts"], f"""
select 'target_model' as kind, target_model as name, round_even(overall, 6) as overall from ({_overall('target_model')}) a
union all
select 'evaluator' as kind, evaluator as name, round_even(overall, 6) as overall from ({_overall('evaluator')}) b
""")

ORACLE["best_model"] = with_fixtures(["eval_facts"], f"""
select target_model as best_model, round_even(overall, 3) as score
from ({_overall('target_model')}) o where overall is not null
order by overall desc, target_model asc limit 1
""")

ORACLE["lenient_strict"] = with_fixtures(["eval_facts"], f"""
select
  (select evaluator from o order by overall desc, evaluator limit 1) as most_lenient,
  (select round_even(max(overall), 3) from o) as lenient_score,
  (select evaluator from o order by overall asc, evaluator limit 1) as most_strict,
  (select round_even(min(overall), 3) from o) as strict_score
""", [("o", f"select * from ({_overall('evaluator')}) x where overall is not null")])


def _extremes(best: bool) -> str:
    means = ", ".join(f"avg({m}) as {m}" for m in _C4)
    order = "desc" if best else "asc"
    return f"""
select upper(substr(metric, 1, 1)) || substr(metric, 2) as metric, target_model, round_even(mean, 3) as score
from (
  select metric, target_model, mean,
    row_number() over (partition by metric order by mean {order}, target_model) as rn
  from (unpivot (select target_model, {means} from eval_facts where target_model is not null group by target_model)
        on {", ".join(_C4)} into name metric value mean) u
  where mean is not null) r
where rn = 1
"""


ORACLE["strengths"] = with_fixtures(["eval_facts"], _extremes(True))
ORACLE["weaknesses"] = with_fixtures(["eval_facts"], _extremes(False))

ORACLE["flagship_model_stats"] = with_fixtures(["judgments_raw", "responses"], f"""
select s.*, t.n_targets, {", ".join(f"t.{m}_target_mean" for m in _C4)}
from ({_stats("target_model", "target_model is not null", count_of="helpfulness",
    source="(select j.* from parsed j join responses r on r.prompt_id = j.prompt_id and r.model = j.target_model "
           "where j.status = 'ok') s")}) s
join (select target_model, count(*) as n_targets,
        {", ".join(f"round_even(avg(avg_{m}), 6) as {m}_target_mean" for m in _C4)}
      from avgs group by target_model) t on t.target_model = s.target_model
""", [("parsed", _PARSED), ("avgs", _target_avgs())])


# --------------------------------------------------------------------------- charts

ORACLE["cross_pivot"] = with_fixtures(["eval_facts"], """
select target_model,
  round_even(avg(case when evaluator = 'model_a' then helpfulness end), 3) as model_a,
  round_even(avg(case when evaluator = 'model_b' then helpfulness end), 3) as model_b,
  round_even(avg(case when evaluator = 'model_c' then helpfulness end), 3) as model_c
from eval_facts where target_model is not null and evaluator is not null
group by target_model
having count(case when evaluator in ('model_a', 'model_b', 'model_c') and helpfulness is not null then 1 end) > 0
""")

_NUM = ["prompt_id", "line_no"] + _M


def _corr_sql() -> str:
    parts = []
    for a in _NUM:
        for b in _NUM:
            if a == b:
                r = f"case when stddev_pop({a}) > 0 then 1.0 end"
            else:
                r = f"round_even(case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end, 6)"
            parts.append(f"select '{a}' as a, '{b}' as b, cast({r} as double) as r from eval_facts")
    return "\nunion all\n".join(parts)


ORACLE["metric_corr"] = with_fixtures(["eval_facts"], _corr_sql())


def _box_sql(key: str) -> str:
    return f"""
select {key}, metric, n, round_even(q1, 6) as q1, round_even(median, 6) as median, round_even(q3, 6) as q3,
  round_even(q3 - q1, 6) as iqr, round_even(whisker_lo, 6) as whisker_lo, round_even(whisker_hi, 6) as whisker_hi,
  n_outliers
from (
  select l.{key}, l.metric, q.n, q.q1, q.median, q.q3,
    min(case when value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then value end) as whisker_lo,
    max(case when value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then value end) as whisker_hi,
    cast(sum(case when value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) then 0 else 1 end) as bigint) as n_outliers
  from long l join (
    select {key}, metric, count(*) as n,
      quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3
    from long group by {key}, metric) q on q.{key} = l.{key} and q.metric = l.metric
  group by l.{key}, l.metric, q.n, q.q1, q.median, q.q3) s
"""


def _box_long(key: str) -> str:
    return "\nunion all\n".join(
        f"select {key}, '{m}' as metric, cast({m} as double) as value from eval_facts where {key} is not null and {m} is not null"
        for m in _C4
    )


ORACLE["box_by_model"] = with_fixtures(["eval_facts"], _box_sql("target_model"), [("long", _box_long("target_model"))])
ORACLE["box_by_evaluator"] = with_fixtures(["eval_facts"], _box_sql("evaluator"), [("long", _box_long("evaluator"))])

_MEANS = f"select target_model, {', '.join(f'round_even(avg({m}), 6) as {m}' for m in _M)} from eval_facts where target_model is not null group by target_model"
ORACLE["heatmap"] = with_fixtures(["eval_facts"], _MEANS)
ORACLE["radar"] = with_fixtures(["eval_facts"], "\nunion all\n".join(
    f"select target_model, {i} as idx, '{m}' as theta, {m} as r from means" for i, m in enumerate(_M)
), [("means", _MEANS)])
ORACLE["bar_long"] = with_fixtures(["eval_facts"], "\nunion all\n".join(
    f"select target_model, '{m}' as variable, {m} as value from means" for m in _M
), [("means", _MEANS)])


# --------------------------------------------------------------------------- responses

_CARD = "concat('### Response\n\n', response, '\n\n---\n\n**Explainability:**\n', reasoning)"

ORACLE["side_by_side"] = with_fixtures(["responses"], f"""
select prompt_id,
  max(case when model = 'model_a' then {_CARD} end) as model_a,
  max(case when model = 'model_b' then {_CARD} end) as model_b,
  max(case when model = 'model_c' then {_CARD} end) as model_c
from responses group by prompt_id
""")

ORACLE["response_previews"] = with_fixtures(["responses"], """
select prompt_id, model, concat(substr(response, 1, 100), '...') as preview
from responses where coalesce(response, '') <> ''
""")

ORACLE["response_status"] = with_fixtures(["responses"], """
select model, count(*) as n_responses,
  count(case when coalesce(response, '') = '' then 1 end) as n_blank,
  count(case when regexp_matches(response, '^\\[[^\\]]* Error\\] ') then 1 end) as n_error,
  count(case when coalesce(response, '') <> '' then 1 end) as n_kept,
  count(distinct case when coalesce(response, '') <> '' then prompt_id end) as n_prompts
from responses group by model
""")

ORACLE["response_lengths"] = with_fixtures(["responses"], """
select model, count(*) as n, round_even(avg(length(response)), 3) as avg_chars,
  min(length(response)) as min_chars, max(length(response)) as max_chars,
  round_even(quantile_cont(cast(length(response) as double), 0.5), 3) as median_chars,
  round_even(avg(len(regexp_extract_all(response, '\\S+'))), 3) as avg_words
from responses where coalesce(response, '') <> '' group by model
""")


# --------------------------------------------------------------------------- ATS output and search

import string as _string  # noqa: E402

from ..config import (  # noqa: E402
    ATS_FEEDBACK_TEMPLATE,
    ATS_TABLE_HEADER,
    NO_SEARCH_RESULTS,
    SEARCH_HIT_TEMPLATE,
)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_fill(template: str, **exprs: str) -> str:
    parts = []
    for literal, name, _s, _c in _string.Formatter().parse(template):
        if literal:
            parts.append(_lit(literal))
        if name is not None:
            parts.append(exprs[name])
    return "concat(" + ", ".join(parts) + ")"


_ATS_CASES = """
select prompt_id, model, f, score,
  case f when 5 then null when 6 then score + 0.5 when 7 then 1.0 else cast(score as double) end as shown,
  case f when 5 then 'None' when 6 then concat(cast(score as varchar), '.5') when 7 then 'True' else cast(score as varchar) end as score_text,
  case f when 4 then '' when 8 then 's, q, l' else 'sql, spark' end as strong,
  case when f in (0, 1) then 'fallback' when f in (2, 3) then 'na' else 'ok' end as status
from ats_raw
"""

ORACLE["ats_parse"] = with_fixtures(["ats_raw"], """
select prompt_id, model, status,
  case when status = 'fallback' then 50.0 when status = 'ok' then shown end as ats_score,
  case when status = 'fallback' then '' when status = 'ok' then strong end as strengths,
  case when status = 'fallback' then '' when status = 'ok' then 'scala' end as gaps,
  case when status = 'fallback' then 'Check formatting.' when status = 'ok' then 'add dates, quantify' end as suggestions,
  case when status = 'na' then concat('| ', model, ' | N/A | N/A | N/A |')
       when status = 'fallback' then concat('| ', model, ' | 50 |  | Check formatting. |')
       else concat('| ', model, ' | ', score_text, ' | ', strong, ' | add dates, quantify |') end as row_md
from c
""", [("c", _ATS_CASES)])

_FB_SCORE = "case when status = 'fallback' then 50 else shown end"
ORACLE["ats_feedback"] = with_fixtures(["ats_raw"], f"""
select prompt_id, model,
  case when {_FB_SCORE} >= 75 then 'green' when {_FB_SCORE} >= 50 then 'yellow' else 'red' end as band,
  {_sql_fill(ATS_FEEDBACK_TEMPLATE,
             score="case when status = 'fallback' then '50' else score_text end",
             color=f"case when {_FB_SCORE} >= 75 then '\U0001F7E2' when {_FB_SCORE} >= 50 then '\U0001F7E1' else '\U0001F534' end",
             strengths="case when status = 'fallback' or f = 4 then '* None found.' when f = 8 then concat('* s', chr(10), '* q', chr(10), '* l') "
                       "else concat('* sql', chr(10), '* spark') end",
             gaps="case when status = 'fallback' then '* None mentioned.' else '* scala' end",
             suggestions="case when status = 'fallback' then '1. Check formatting.' else concat('1. add dates', chr(10), '1. quantify') end")} as feedback_md
from c where status <> 'na' and (status = 'fallback' or shown is not null)
""", [("c", _ATS_CASES)])

ORACLE["ats_batch"] = with_fixtures(["ats_raw"], f"""
select p.prompt_id, p.prompt, concat({_lit(ATS_TABLE_HEADER)}, t.rows_md) as ats_summary
from prompts p left join (
  select prompt_id, string_agg(row_md, chr(10) order by model) as rows_md from r group by prompt_id) t
  on t.prompt_id = p.prompt_id
""", [("r", "select prompt_id, model, case when f in (2, 3) then concat('| ', model, ' | N/A | N/A | N/A |') "
       "when f in (0, 1) then concat('| ', model, ' | 50 |  | Check formatting. |') "
       "else concat('| ', model, ' | ', score_text, ' | ', strong, ' | add dates, quantify |') end as row_md "
       f"from ({_ATS_CASES}) c")])

_SEARCH_CTX = f"""
select g.prompt_id, g.realtime,
  case when g.realtime then coalesce(t.snippets, {_lit(NO_SEARCH_RESULTS)}) end as search_results,
  coalesce(nullif(case when g.realtime then coalesce(t.snippets, {_lit(NO_SEARCH_RESULTS)}) end, ''), 'N/A') as displayed
from (select prompt_id, contains(lower(trim(raw_text)), 'true') as realtime from realtime_raw) g
left join (
  select prompt_id, string_agg({_sql_fill(SEARCH_HIT_TEMPLATE, title='title', snippet='snippet', link='link')}, chr(10) || chr(10) order by rk) as snippets
  from search_hits where rk <= 3 group by prompt_id) t on t.prompt_id = g.prompt_id
"""

ORACLE["search_context"] = with_fixtures(["search_hits", "realtime_raw"], _SEARCH_CTX)



# --------------------------------------------------------------------------- text matching and retrieval


def _tok(id_col: str, text_col: str, source: str, distinct: bool) -> str:
    inner = f"select {id_col}, unnest(string_split_regex(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) as token from {source}"
    if distinct:
        return f"select distinct {id_col}, token from ({inner}) x where length(token) >= 3"
    return f"select {id_col}, token, count(*) as tf from ({inner}) x where length(token) >= 3 group by {id_col}, token"


def _terms(name: str, matched: bool) -> str:
    cond = "matched" if matched else "not matched"
    return f"""select job_id, resume_id, string_agg(token, ', ' order by rn) as {name} from (
  select job_id, resume_id, token, row_number() over (partition by job_id, resume_id order by tf desc, token) as rn
  from m where {cond}) x where rn <= 5 group by job_id, resume_id"""


ORACLE["keyword_match"] = with_fixtures(["applications"], """
select a.job_id, a.resume_id, coalesce(s.job_tokens, 0) as job_tokens, coalesce(s.matched_tokens, 0) as matched_tokens,
  round_even(cast(100 as double) * s.matched_tokens / s.job_tokens, 1) as score,
  coalesce(st.strengths, '') as strengths, coalesce(g.gaps, '') as gaps
from applications a
left join s on s.job_id = a.job_id and s.resume_id = a.resume_id
left join st on st.job_id = a.job_id and st.resume_id = a.resume_id
left join g on g.job_id = a.job_id and g.resume_id = a.resume_id
""", [
    ("jt", _tok("job_id", "jd", "jobs", False)),
    ("rt", _tok("resume_id", "resume", "resumes", True)),
    ("m", """select a.job_id, a.resume_id, jt.token, jt.tf, rt.token is not null as matched
from applications a join jt on jt.job_id = a.job_id
left join rt on rt.resume_id = a.resume_id and rt.token = jt.token"""),
    ("s", "select job_id, resume_id, count(*) as job_tokens, count(case when matched then 1 end) as matched_tokens from m group by job_id, resume_id"),
    ("st", _terms("strengths", True)),
    ("g", _terms("gaps", False)),
])

ORACLE["semantic_match"] = with_fixtures(["applications"], """
select a.job_id, a.resume_id,
  round_even(case when nj.norm * nr.norm > 0 then coalesce(d.dot, 0) / (nj.norm * nr.norm) end, 6) as cosine
from applications a
left join dots d on d.job_id = a.job_id and d.resume_id = a.resume_id
left join norms nj on nj.doc = 'j' || a.job_id
left join norms nr on nr.doc = 'r' || a.resume_id
""", [
    ("docs", "select 'r' || resume_id as doc, resume as text from resumes union all select 'j' || job_id as doc, jd as text from jobs"),
    ("tf", _tok("doc", "text", "docs", False)),
    ("dfs", "select token, count(*) as df from tf group by token"),
    ("n", "select cast(count(*) as double) as n from docs"),
    ("w", "select tf.doc, tf.token, tf.tf * ln(n.n / dfs.df) as w from tf join dfs on dfs.token = tf.token cross join n"),
    ("norms", "select doc, sqrt(sum(w * w)) as norm from w group by doc"),
    ("dots", """select a.job_id, a.resume_id, sum(wj.w * wr.w) as dot from applications a
join w wj on wj.doc = 'j' || a.job_id join w wr on wr.doc = 'r' || a.resume_id and wr.token = wj.token
group by a.job_id, a.resume_id"""),
])

ORACLE["retrieve_top3"] = with_fixtures(["prompts"], """
select prompt_id, doc_id, cast(rn as integer) as rank, score from (
  select *, row_number() over (partition by prompt_id order by score desc, doc_id) as rn from sc) x
where rn <= 3
""", [
    ("dt", _tok("doc_id", "text", "documents", True)),
    ("n", "select cast(count(*) as double) as n from documents"),
    ("st", "select token, ln(max(n.n) / count(*)) as idf from dt cross join n group by token"),
    ("qt", _tok("prompt_id", "prompt", "prompts", True)),
    ("sc", """select qt.prompt_id, dt.doc_id, round_even(sum(st.idf), 6) as score
from qt join dt on dt.token = qt.token join st on st.token = qt.token group by qt.prompt_id, dt.doc_id"""),
])


# --------------------------------------------------------------------------- prompt construction

from ..config import ATS_SCORE_TEMPLATE, ATS_TASK_TEMPLATE, JUDGE_TEMPLATE, REASONING_TEMPLATE, SEARCH_MARKER  # noqa: E402

ORACLE["prompt_build"] = with_fixtures(["search_hits", "realtime_raw"], f"""
select p.prompt_id, false as is_ats,
  case when coalesce(c.search_results, '') <> '' then concat(p.prompt, {_lit(SEARCH_MARKER)}, c.search_results)
       else p.prompt end as built_prompt
from prompts p left join ctx c on c.prompt_id = p.prompt_id
""", [("ctx", _SEARCH_CTX)])

ORACLE["ats_prompt_build"] = with_fixtures(["applications"], f"""
select a.job_id, a.resume_id, coalesce(r.resume, '') <> '' and coalesce(j.jd, '') <> '' as is_ats,
  case when coalesce(r.resume, '') <> '' and coalesce(j.jd, '') <> ''
       then {_sql_fill(ATS_TASK_TEMPLATE, resume="r.resume", jd="j.jd")} else j.jd end as built_prompt
from applications a join jobs j on j.job_id = a.job_id join resumes r on r.resume_id = a.resume_id
""")

ORACLE["judge_prompts"] = with_fixtures(["responses"], f"""
select r.prompt_id, r.model as target_model, e.model as evaluator,
  {_sql_fill(JUDGE_TEMPLATE, prompt="coalesce(r.prompt, 'None')", target="r.model", response="coalesce(r.response, 'None')")} as judge_prompt
from responses r join models e on e.model <> r.model
""")

ORACLE["reasoning_prompts"] = with_fixtures(["responses"], f"""
select prompt_id, model,
  {_sql_fill(REASONING_TEMPLATE, response="coalesce(response, 'None')", prompt="coalesce(prompt, 'None')")} as reasoning_prompt
from responses
""")



# --------------------------------------------------------------------------- files (write, read back)

_EVALS = f"""
select j.prompt_id, r.prompt, j.target_model, j.evaluator, r.response, r.reasoning as explainability,
  {", ".join("j." + m for m in _M)}, j.reasoning, j.notes, {", ".join(f"a.avg_{m}" for m in _M)}
from parsed j
join responses r on r.prompt_id = j.prompt_id and r.model = j.target_model
join avgs a on a.prompt_id = j.prompt_id and a.target_model = j.target_model
where j.status = 'ok'
"""

ORACLE["runs_union"] = with_fixtures(["judgments_raw", "responses"], f"""
select '20240101_000000' as run_id, 'comprehensive' as layout, '2024-01-01 00:00:00' as eval_ts,
  prompt, target_model, evaluator, response, cast(null as varchar) as explainability,
  {", ".join(_M)}, reasoning, notes, {", ".join(f"avg_{m}" for m in _M)}
from e
union all
select '20240102_000000' as run_id, 'batch' as layout, '2024-01-02 00:00:00' as eval_ts,
  prompt, target_model, evaluator, response, explainability,
  {", ".join(_M)}, cast(null as varchar) as reasoning, cast(null as varchar) as notes, {", ".join(f"avg_{m}" for m in _M)}
from e
union all
select '20240103_000000' as run_id, 'comprehensive' as layout, '2024-01-03 00:00:00' as eval_ts,
  prompt, target_model, evaluator, response, cast(null as varchar) as explainability,
  {", ".join(_M)}, reasoning, notes, {", ".join(f"avg_{m}" for m in _M)}
from e
""", [("parsed", _PARSED), ("avgs", _target_avgs()), ("e", _EVALS)])

ORACLE["latest_run"] = with_fixtures(["judgments_raw", "responses"], f"""
select '20240102_000000' as timestamp, prompt, target_model, evaluator, {", ".join(_M)}, 'rerun' as notes from e
""", [("parsed", _PARSED), ("avgs", _target_avgs()), ("e", _EVALS)])


# --------------------------------------------------------------------------- streaming (batch result as oracle)

ORACLE["stream_running"] = with_fixtures(["eval_facts"], """
select target_model, count(*) as n,
  round_even(avg(helpfulness), 3) as helpfulness_mean, round_even(avg(correctness), 3) as correctness_mean,
  round_even(avg(coherence), 3) as coherence_mean, round_even(avg(clarity), 3) as clarity_mean
from eval_facts where target_model is not null group by target_model
""")

# rows of one order in ten of the first quarter of the time span arrive last and are dropped; a window is
# put out once the latest time less a day has passed its end
ORACLE["stream_hourly"] = with_fixtures(["eval_facts"], """
select strftime(date_trunc('hour', eval_ts), '%Y-%m-%d %H:%M:%S') as window_start, target_model, evaluator, count(*) as n,
  round_even(avg(helpfulness), 6) as helpfulness_mean
from eval_facts, span
where target_model is not null and not (prompt_id % 10 = 3 and epoch(eval_ts) < first_s + floor((last_s - first_s) / 4))
  and epoch(date_trunc('hour', eval_ts)) + 3600 <= last_s - 86400
group by all
""", [("span", "select epoch(min(eval_ts)) as first_s, epoch(max(eval_ts)) as last_s from eval_facts")])

ORACLE["stream_dedup"] = with_fixtures(["judgments_raw"], f"""
select '20240101_000000' as run_id, prompt_id, target_model, evaluator, {", ".join(_M)}
from parsed where status = 'ok'
""", [("parsed", _PARSED)])


# --------------------------------------------------------------------------- report (long form)

_FACT_COLS = ["prompt_id", "line_no", "target_model", "evaluator", *_M, "eval_ts"]


def _report_sql() -> str:
    parts = [
        "select 'overview' as section, 'dataset' as item, 'total_records' as metric, cast(count(*) as double) as value, "
        "cast(null as varchar) as label from eval_facts",
        f"select 'overview', 'dataset', 'n_columns', {float(len(_FACT_COLS))}, {_lit(', '.join(_FACT_COLS))}",
    ]
    for section, key, count_of in (("model_performance", "target_model", "helpfulness"), ("evaluator_analysis", "evaluator", None)):
        for m in _C4:
            stats = [("mean", f"round_even(avg({m}), 3)"), ("std", f"round_even(stddev_samp({m}), 3)")]
            if m == count_of:
                stats.append(("count", f"cast(count({m}) as double)"))
            for name, expr in stats:
                parts.append(
                    f"select '{section}', {key}, '{m}_{name}', {expr}, cast(null as varchar) "
                    f"from eval_facts where {key} is not null group by {key}"
                )
    parts.append("select 'model_performance', 'best_model', 'overall', score, best_model from best")
    parts.append("select 'evaluator_analysis', 'most_lenient', 'overall', lenient_score, most_lenient from ls")
    parts.append("select 'evaluator_analysis', 'most_strict', 'overall', strict_score, most_strict from ls")
    parts.append("select 'insights', 'strength', metric, score, target_model from strong")
    parts.append("select 'insights', 'weakness', metric, score, target_model from weak")
    return "\nunion all\n".join(parts)


def _body(sql: str) -> str:
    """The final select of an oracle built by ``with_fixtures`` (drops its CTE prefix)."""
    return sql[sql.rindex("\n)\n") + 3:]


ORACLE["report_long"] = with_fixtures(["eval_facts"], _report_sql(), [
    ("best", _body(ORACLE["best_model"])),
    ("o", f"select * from ({_overall('evaluator')}) x where overall is not null"),
    ("ls", _body(ORACLE["lenient_strict"])),
    ("strong", _body(ORACLE["strengths"])),
    ("weak", _body(ORACLE["weaknesses"])),
])


ORACLE["prompts_csv_roundtrip"] = with_fixtures(["prompts"], "select prompt_id, prompt from prompts")

ORACLE["prompt_lines_roundtrip"] = with_fixtures(["prompts"], """
select line_no, trim(line) as prompt from (
  select row_number() over (order by prompt_id, k) as line_no, line from (
    select prompt_id, generate_subscripts(string_split(prompt, chr(10)), 1) as k,
           unnest(string_split(prompt, chr(10))) as line
    from prompts) x) y
where trim(line) <> ''
""")

ORACLE["search_json"] = with_fixtures(["search_hits"], "select prompt_id, rk, title, snippet, link from search_hits")

ORACLE["judgment_issues"] = with_fixtures(["judgments_raw"], """
select evaluator, metric, kind, count(*) as n from (
  select evaluator,
    case f when 2 then 'helpfulness' when 3 then 'correctness' when 4 then 'coherence' when 5 then 'clarity' end as metric,
    case f when 2 then 'missing' when 3 then 'null' when 4 then 'numeric_string' when 5 then 'boolean' end as kind
  from judgments_raw where f in (2, 3, 4, 5)) x
group by evaluator, metric, kind
""")

ORACLE["run_counts"] = with_fixtures(["responses", "judgments_raw"], """
select (select count(*) from prompts) as n_prompts,
  (select count(*) from responses where coalesce(response, '') <> '') as n_responses,
  (select count(distinct prompt_id * 10 + case target_model when 'model_a' then 0 when 'model_b' then 1 else 2 end)
     from judgments_raw where f not in (0, 1, 6, 7)) as n_targets_evaluated,
  (select count(*) from judgments_raw where f not in (0, 1, 6, 7)) as n_evaluations
""")

ORACLE["batch_output_roundtrip"] = ORACLE["ats_batch"]

ORACLE["bundle_roundtrip"] = with_fixtures(["eval_facts"], "\nunion all\n".join(
    f"select 'evaluation' as table_name, '20240101_000000' as run_id, target_model, evaluator, '{m}' as metric, {m} as value from eval_facts" for m in _M
) + "\nunion all\n" + "\nunion all\n".join(
    f"select '{t}', '20240101_000000', target_model, cast(null as varchar), '{m}', {m} from means" for t in ("heatmap", "radar", "bar") for m in _M
), [("means", _MEANS)])


def _report_text_sql() -> str:
    num = lambda x: f"coalesce(format('{{:.3f}}', cast({x} as double)), 'NaN')"
    columns = ", ".join(f"''{c}''" for c in ["target_model", "evaluator", *_M])
    total = "(select cast(count(*) as varchar) from eval_facts)"
    lines = [
        (0, "'LLM EVALUATION ANALYSIS REPORT'"), (1, f"'{'=' * 50}'"), (2, "'Generated: 2024-01-03 00:00:00'"), (3, "'Data source: eval_facts'"),
        (4, f"concat('Total records: ', {total})"), (5, "''"), (10, "'DATASET OVERVIEW'"), (11, f"'{'-' * 20}'"),
        (12, f"concat('Shape: (', {total}, ', {len(_M) + 2})')"), (13, f"'Columns: [{columns}]'"), (14, "''"),
        (20, "'MODEL PERFORMANCE SUMMARY'"), (21, f"'{'-' * 30}'"),
        (22, "'target_model helpfulness_mean helpfulness_std helpfulness_count correctness_mean correctness_std coherence_mean coherence_std clarity_mean clarity_std'"),
        (24, "''"), (25, "concat('Best performing model (overall): ', (select best_model from best))"),
        (26, f"concat('Average score: ', (select {num('score')} from best))"), (29, "''"),
        (50, "'EVALUATOR ANALYSIS'"), (51, f"'{'-' * 20}'"),
        (52, "'evaluator helpfulness_mean helpfulness_std correctness_mean correctness_std coherence_mean coherence_std clarity_mean clarity_std'"),
        (54, "''"), (55, "concat('Most lenient evaluator: ', (select most_lenient from ls))"),
        (56, "concat('Most strict evaluator: ', (select most_strict from ls))"), (59, "''"),
        (70, "'KEY INSIGHTS'"), (71, f"'{'-' * 15}'"), (72, "'Model Strengths:'"), (80, "''"), (81, "'Model Weaknesses:'"), (92, "''"),
        (93, f"'{'=' * 50}'"), (94, "'Report generation completed.'"),
    ]
    parts = [f"select {at} as pos, '' as item, {text} as value" for at, text in lines]
    for at, key, counted in ((23, "target_model", True), (53, "evaluator", False)):
        cells = []
        for m in _C4:
            cells += [num(f"round_even(avg({m}), 3)"), num(f"round_even(stddev_samp({m}), 3)")]
            if counted and m == "helpfulness":
                cells.append(f"cast(count({m}) as varchar)")
        parts.append(f"select {at}, {key}, concat_ws(' ', {key}, {', '.join(cells)}) from eval_facts where {key} is not null group by {key}")
    for at, table in ((73, "strong"), (82, "weak")):
        order = " ".join(f"when '{m.capitalize()}' then '{i}'" for i, m in enumerate(_C4))
        parts.append(f"select {at}, case metric {order} end, concat('  ', metric, ': ', target_model, ' (', {num('score')}, ')') from {table}")
    union = "\nunion all\n".join(parts)
    return f"select row_number() over (order by pos, item) as line_no, value from (\n{union}\n) x"


ORACLE["report_text"] = with_fixtures(["eval_facts"], _report_text_sql(), [
    ("best", _body(ORACLE["best_model"])),
    ("o", f"select * from ({_overall('evaluator')}) x where overall is not null"),
    ("ls", _body(ORACLE["lenient_strict"])),
    ("strong", _body(ORACLE["strengths"])),
    ("weak", _body(ORACLE["weaknesses"])),
])

ORACLE["sorted_stats"] = with_fixtures(["eval_facts"], f"""
select *, row_number() over (order by target_model, evaluator) as place from ({_body(ORACLE["cross_eval"])}) x
""")

ORACLE["resume_files"] = with_fixtures(["resumes", "jobs"], """
select cast(resume_id as varchar) as resume_id, '' as source, 'resume' as kind, '.txt' as suffix, false as unsupported, concat(coalesce(resume, ''), chr(10)) as resume from resumes
union all
select '', source, 'batch', '.csv', false, '' from (select distinct source from jobs) s
""")

ORACLE["ats_score_prompts"] = with_fixtures(["applications"], f"""
select a.job_id, a.resume_id,
  {_sql_fill(ATS_SCORE_TEMPLATE, resume="coalesce(r.resume, 'None')", jd="coalesce(j.jd, 'None')", response="coalesce(j.jd, 'None')")} as request
from applications a join jobs j on j.job_id = a.job_id join resumes r on r.resume_id = a.resume_id
""")

ORACLE["error_texts"] = with_fixtures(["responses"], """
select prompt_id, model, role, case role when 'answer' then concat('[', model, ' Error] timeout: ', substr(prompt, 1, 20))
  when 'reasoning' then concat('[Reasoning Error] timeout: ', substr(prompt, 1, 20)) end as text
from responses, (values ('answer'), ('reasoning'), ('judge')) roles(role)
""")

ORACLE["display_tabs"] = with_fixtures(["responses", "search_hits", "realtime_raw"], f"""
select cast(prompt_id % 7 as varchar) as run_id,
  max(case when model = 'model_a' then {_CARD} end) as model_a,
  max(case when model = 'model_b' then {_CARD} end) as model_b,
  max(case when model = 'model_c' then {_CARD} end) as model_c,
  coalesce(nullif(max(search_results), ''), 'N/A') as search_tab, false as is_ats
from responses left join ctx using (prompt_id)
where prompt_id in (select max(prompt_id) from responses group by prompt_id % 7)
group by prompt_id
""", [("ctx", f"select prompt_id, search_results from ({_SEARCH_CTX}) c")])

_EMPTY = ["best_model", "lenient_strict", "report_long", "model_stats", "box_by_model", "metric_corr", "strengths", "heatmap", "cross_pivot", "report_text", "missing_file"]
ORACLE["empty_input"] = with_fixtures(["eval_facts"], "\nunion all\n".join(
    f"select '{x}' as operator, count(*) as n from eval_facts where prompt_id < 0" for x in _EMPTY
))
