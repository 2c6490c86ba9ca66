"""The derived test tables as SQL text that DuckDB runs on the given parquet views.

Used as CTEs in front of every oracle query. Written independently from the
DataFrame builders in ``plans.fixtures``.
"""

from __future__ import annotations

FIXTURE_SQL = {
    "prompts": """
select u.conv_id * 1000000 + u.turn as prompt_id, u.text as prompt, a.text as answer
from conversations u join conversations a
  on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'
""",
    "models": """
select * from (values (0, 'model_a'), (1, 'model_b'), (2, 'model_c')) as x(i, model)
""",
    "responses": """
select p.prompt_id, p.prompt, m.model, m.i as model_idx,
  case when (p.prompt_id * 3 + m.i) % 29 = 0 then ''
       when (p.prompt_id * 3 + m.i) % 29 = 1 then concat('[', m.model, ' Error] timeout')
       else concat(p.answer, repeat(concat(' ', m.model), m.i + 1)) end as response,
  concat('because ', m.model) as reasoning
from prompts p cross join models m
""",
    "judgments_raw": """
with j as (
  select p.prompt_id, tm.i as t, em.i as e, tm.model as target_model, em.model as evaluator,
         (p.prompt_id * 7 + 3 * tm.i + 5 * em.i) % 23 as f,
         p.prompt_id * 31 + tm.i * 17 + em.i * 7 as b
  from prompts p cross join models tm join models em on tm.i <> em.i),
k as (
  select *, concat('{', concat_ws(', ',
    case when f = 2 then '"extra": 1' else concat('"helpfulness": ', cast((b % 101) / cast(100 as double) as string)) end,
    case when f = 3 then '"correctness": null' else concat('"correctness": ', cast(((b + 13) % 101) / cast(100 as double) as string)) end,
    case when f = 4 then '"coherence": "0.8"' else concat('"coherence": ', cast(((b + 26) % 101) / cast(100 as double) as string)) end,
    concat('"tone_score": ', cast(((b + 39) % 101) / cast(100 as double) as string)),
    concat('"accuracy": ', cast(((b + 52) % 101) / cast(100 as double) as string)),
    concat('"relevance": ', cast(((b + 65) % 101) / cast(100 as double) as string)),
    concat('"completeness": ', cast(((b + 78) % 101) / cast(100 as double) as string)),
    case when f = 5 then '"clarity": true' else concat('"clarity": ', cast(((b + 91) % 101) / cast(100 as double) as string)) end,
    '"reasoning": "ok"', '"notes": ""'), '}') as obj
  from j)
select prompt_id, target_model, evaluator, f, b,
  case when f = 0 then 'I cannot score this.'
       when f = 1 then concat('Scores: ', substr(obj, 1, length(obj) - 2), '}')
       when f = 6 then '{}'
       when f = 7 then concat(obj, ' or ', obj)
       else concat('Here is my evaluation: ', obj, ' Thanks.') end as raw_text
from k
""",
    "ats_raw": """
with a as (
  select p.prompt_id, m.model, (p.prompt_id * 5 + m.i) % 11 as f, (p.prompt_id * 37 + m.i * 11) % 101 as score
  from prompts p cross join models m),
o as (
  select *, concat('{', case f when 2 then '' when 5 then '"ats_score": null, ' when 6 then concat('"ats_score": ', cast(score as string), '.5, ')
      when 7 then '"ats_score": true, ' else concat('"ats_score": ', cast(score as string), ', ') end,
    case f when 3 then '"strengths": null, ' when 4 then '' when 8 then '"strengths": "sql", ' else '"strengths": ["sql", "spark"], ' end,
    '"gaps": ["scala"], "suggestions": ["add dates", "quantify"]}') as obj
  from a)
select prompt_id, model, f, score,
  case when f = 0 then 'No score available.' when f = 1 then concat('Result: ', obj) else obj end as raw_text
from o
""",
    "search_hits": """
select p.prompt_id, r.rk, regexp_extract(g.html, '<title>([^<]*)</title>', 1) as title,
  concat('about page ', cast(g.page_id as string)) as snippet, g.url as link
from prompts p
join (select * from (values (1), (2), (3), (4), (5)) as v(rk)) r on r.rk <= p.prompt_id % 6
join pages g on g.page_id = (p.prompt_id * 13 + r.rk * 7) % (select count(*) from pages)
""",
    "realtime_raw": """
select prompt_id, case prompt_id % 3 when 0 then ' TRUE ' when 1 then 'False.' else 'That is untrue' end as raw_text
from prompts
""",
    "resumes": """
select doc_id as resume_id, source, text as resume from documents
where cast(floor(doc_id / 20.0) as int) % 2 = 0
""",
    "jobs": """
select doc_id as job_id, source, text as jd from documents
where cast(floor(doc_id / 20.0) as int) % 2 = 1
""",
    "applications": """
select j.job_id, r.resume_id, j.source from jobs j join resumes r
  on r.resume_id = j.job_id - 20
""",
    "eval_facts": None,  # generated below from a per-metric rule
}

_METRICS = ["helpfulness", "correctness", "coherence", "tone_score", "accuracy", "relevance", "completeness", "clarity"]


def _eval_facts_sql() -> str:
    cols = []
    for k, m in enumerate(_METRICS):
        cols.append(
            f"""  case when (prompt_id + {k}) % 50 = 0 then null
       when (prompt_id + {k}) % 37 = 0 then ((b + {11 * k}) % 11) / cast(100 as double)
       else (60 + 5 * ((t + {k}) % 3) + 2 * e + (b + {11 * k}) % 26) / cast(100 as double) end as {m}"""
        )
    return (
        """
with l as (
  select l_orderkey as prompt_id, l_linenumber as line_no, l_partkey % 3 as t,
    (l_partkey % 3 + 1 + l_suppkey % 2) % 3 as e,
    l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7 as b, l_shipdate as eval_ts
  from lineitem)
select prompt_id, line_no,
  case when prompt_id % 997 = 0 then null else concat('model_', substr('abc', cast(t as int) + 1, 1)) end as target_model,
  concat('model_', substr('abc', cast(e as int) + 1, 1)) as evaluator,
"""
        + ",\n".join(cols)
        + ",\n  eval_ts\nfrom l\n"
    )


FIXTURE_SQL["eval_facts"] = _eval_facts_sql()

FIXTURE_SQL["models5"] = """
select * from (values (0, 'model_a'), (1, 'model_b'), (2, 'model_c'), (3, 'model_d'), (4, 'model_e')) as x(i, model)
"""
FIXTURE_SQL["judgments_raw5"] = FIXTURE_SQL["judgments_raw"].replace("join models ", "join models5 ")

# Which fixtures each fixture needs (CTE order matters).
DEPENDS = {
    "prompts": [],
    "models": [],
    "responses": ["prompts", "models"],
    "judgments_raw": ["prompts", "models"],
    "models5": [],
    "judgments_raw5": ["prompts", "models5"],
    "ats_raw": ["prompts", "models"],
    "search_hits": ["prompts"],
    "realtime_raw": ["prompts"],
    "resumes": [],
    "jobs": [],
    "applications": ["resumes", "jobs"],
    "eval_facts": [],
}


def with_fixtures(names: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (plus dependencies), then ``extra`` CTEs."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS[n]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [(n, FIXTURE_SQL[n]) for n in order] + list(extra)
    ctes = ",\n".join(f"{n} as ({sql.strip()}\n)" for n, sql in parts)
    return f"with {ctes}\n{body.strip()}\n"
