"""The same questions in SQL over the same tables, for checking the registered queries.

Fixtures are stated again as common table expressions. Only the prompt templates are shared
with the operators; the slots are filled here by SQL.
"""

from __future__ import annotations

from collections.abc import Mapping

from rejoinder.operators import prompts
from rejoinder.testing.fixtures import BATCH_IDS, KEYWORDS, MODEL_PRICES, PHRASES, THEMES

LIST = " | "


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fill(template: str, slots: Mapping[str, str]) -> str:
    return " || ".join(
        f"coalesce(cast({slots[piece]} as varchar), 'None')" if is_slot else text(piece)
        for piece, is_slot in prompts.pieces(template)
    )


def words(column: str) -> str:
    return f"len(regexp_extract_all({column}, '\\S+'))"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


FIXTURES = {
    "fx_chat_log": """
        select event_id as id,
               case when event_id % 97 <> 0 then cast(user_id as varchar) end as session_id,
               event_type || chr(10) || props as user_feedback,
               case when event_id % 3 = 0 then 'shorter' else '' end as modification_needed,
               '' as history,
               'reply ' || (event_id % 5) || chr(10) || 'tail' as model_response,
               case when extract(hour from ts) = 5 then ts + interval 1 hour else ts end as log_ts,
               value as latency,
               try_cast(case when event_type = 'error' then 'n/a' else regexp_extract(props, '[0-9]+') end as double) as tokens,
               cast((event_id % 1000) * cast(0.0001 as decimal(18,8)) as decimal(18,8)) as cost
        from events""",
    "fx_messages": """
        select cast(conv_id as varchar) as session_id, turn as ord, role, text
        from conversations where role <> 'system'""",
    "fx_feedback": f"""
        select d.source || '-' || (d.doc_id // {BATCH_IDS}) as session_id,
               d.doc_id as feedback_id, d.doc_id // {BATCH_IDS} as block, d.text as review_text, d.lang, d.n_chars,
               case when d.doc_id % 7 <> 0 then c.c_name end as customer_name,
               case when l.doc_id is null then 0 when d.doc_id % 5 = 0 then 2 else 1 end as n_surveys,
               l.quality, l.toxic,
               l.quality = 1 and l.toxic = 0 as good,
               {words('d.text')} as words,
               row_number() over (partition by d.source, d.doc_id // {BATCH_IDS} order by d.doc_id) - 1 as pos,
               'Be kind to ' || d.source || '-' || (d.doc_id // {BATCH_IDS}) as core_prompt,
               case (d.doc_id // {BATCH_IDS}) % 3 when 0 then 'Shop rules. ' when 1 then 'No marker here' else 'a ' end as context_first,
               case (d.doc_id // {BATCH_IDS}) % 3 when 0 then ' block ' || (d.doc_id // {BATCH_IDS})
                    when 1 then 'No marker here' else ' c' end as context_last,
               case when l.doc_id is not null then
                   '{{"q":"quality","score":' || l.quality || '}},{{"q":"toxic","score":' || l.toxic || '}}' end as survey_1,
               case when l.doc_id is not null and d.doc_id % 5 = 0 then
                   '{{"Question":"recommend","Answer":"' || d.lang || '","Rating":4.5}}' end as survey_2
        from documents d
        left join customer c on c.c_custkey = d.doc_id
        left join labels l on l.doc_id = d.doc_id""",
    "fx_survey_master": """
        select feedback_id as survey_id, customer_name as contact, review_text,
               1 + 4 * quality - toxic as review_rating, feedback_id as pos from fx_feedback
        union all
        select feedback_id, 'SECOND', 'second', 0, feedback_id + 1000000000 from fx_feedback where feedback_id % 10 = 0""",
    "fx_first_survey": """
        select * from (select *, row_number() over (partition by survey_id order by pos) as rn from fx_survey_master)
        where rn = 1""",
    "fx_requests": """
        select doc_id, text as comment,
               case when doc_id % 11 = 0 then 'x' || doc_id when doc_id % 7 = 0 then cast(doc_id + 1000000000 as varchar)
                    else cast(doc_id as varchar) end as survey_id
        from documents""",
    "fx_responses": """
        select session_id, pos, feedback_id,
               'Dear ' || coalesce(customer_name, 'customer') || ', thank you for ' || n_chars || ' characters' as default_reply,
               'Hi ' || coalesce(customer_name, 'customer') as friendly,
               case when good then 'promoter' when not good then 'non-promoter' end as sentiment,
               case when good then [lang] else [] end as positive,
               case when good then [] when not good then [lang, 'survey'] else [] end as negative
        from fx_feedback""",
    "fx_revisions": """
        select feedback_id * 4 + i as request_id, session_id, feedback_id + off as feedback_id, change, field, i
        from fx_feedback, (values (0, 'softer', 'Default', 0), (1, 'shorter', 'Default', 0),
                                  (2, 'softer', 'Default', 1000000000), (3, 'softer', 'No_such_field', 0)) as a(i, change, field, off)
        where toxic = 1""",
    "fx_prices": f"""
        select model, cast(p as decimal(18,8)) as prompt_price, cast(c as decimal(18,8)) as completion_price
        from (values {values(MODEL_PRICES)}) as v(model, p, c)""",
    "fx_taxonomy": f"select theme from (values {values([(x,) for x in THEMES])}) as v(theme)",
    "fx_keywords": f"select theme, keyword from (values {values(KEYWORDS)}) as v(theme, keyword)",
    "fx_history": """
        select session_id, ord, role, text,
               list({'role': role, 'text': text}) over (partition by session_id order by ord rows between 3 preceding and 1 preceding) as before,
               list({'role': role, 'text': text}) over (partition by session_id order by ord rows between 4 preceding and current row) as after
        from fx_messages""",
    "fx_turns": """
        select h.session_id, h.ord, h.text, h.before,
               coalesce(array_to_string(list_transform(h.before, lambda m: m.role || ': ' || m.text), chr(10)), '') as history,
               h.before is null or len(h.before) = 0 as is_first,
               m.contact, m.review_rating, h.text || coalesce(m.review_text, 'None') as review
        from fx_history h left join fx_first_survey m on cast(m.survey_id as varchar) = h.session_id
        where h.role = 'user'""",
    "fx_replies": f"""
        select session_id, ord, text, before, history, is_first,
               case when is_first
                    then 'Dear ' || coalesce(contact, 'None') || ': ' || {words('review')} || ' words read, ' || length(history) || ' characters before'
                    else 'Revised with ' || {words('text')} || ' words after ' || length(history) || ' characters' end as raw
        from fx_turns""",
    "fx_analysis": """
        select session_id, pos, feedback_id, words, words % 13 <> 0 as ok, n_surveys,
               'Dear ' || coalesce(customer_name, 'None') || ', thank you for ' || words || ' words' as default_reply,
               'Hi ' || coalesce(customer_name, 'None') || ', thanks for ' || words || ' words' as friendly,
               'Dear customer ' || coalesce(customer_name, 'None') || ', we read ' || words || ' words' as professional,
               case when words % 3 = 0 then '["Thanks, ' || coalesce(customer_name, 'None') || '"]'
                    else 'Thanks, ' || coalesce(customer_name, 'None') end as concise,
               'A review of ' || words || ' words' as summary,
               case when good then 'promoter' when not good then 'non-promoter' end as sentiment,
               case when good then [case when words > 100 then 'long text' else 'short text' end] else [] end as positive,
               case when good then [] when not good then [case when words > 100 then 'long text' else 'short text' end, 'survey']
                    else ['survey'] end as negative
        from fx_feedback""",
}

_NEEDS = {name: [other for other in FIXTURES if other != name and other in sql] for name, sql in FIXTURES.items()}


def with_fixtures(sql: str) -> str:
    """Put the fixtures a query uses in front of it."""
    used: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS[name]:
            add(other)
        if name not in used:
            used.append(name)

    for name in FIXTURES:
        if name in sql:
            add(name)
    if sql.lstrip().startswith("with "):
        sql = f"select * from ({sql})"
    ctes = ",\n".join(f"{name} as ({FIXTURES[name]})" for name in used)
    return f"with {ctes}\n{sql}" if used else sql


POLICY = {"context_last": "context_last", "context_first": "context_first", "core": "core_prompt", "username": "customer_name"}


def per_review(template: str, survey: str, policy: bool = True) -> str:
    slots = {
        "policy": f"({fill(prompts.POLICY, POLICY)})" if policy else "''",
        "review": "review_text",
        "survey": survey,
        "username": "customer_name",
    }
    return fill(template, slots)


OWN_SURVEYS = "('[' || coalesce(survey_1, '') || coalesce(',' || survey_2, '') || ']')"
DIRECT = fill(prompts.DIRECT, {"feedback": "text"})

SURVEY_ROWS = """
    select session_id, pos, feedback_id, 0 as survey_pos, '[' || survey_1 || ']' as questions from fx_feedback where survey_1 is not null
    union all
    select session_id, pos, feedback_id, 1, '[' || survey_2 || ']' from fx_feedback where survey_2 is not null"""

# name -> SQL over the tables and the fixtures above
SQL = {
    "kpi_overall": """
        select count(*) as total_requests,
               round((select avg(gap) from (select epoch_us(log_ts) - lag(epoch_us(log_ts)) over (order by id) as gap from fx_chat_log)) / 1e6, 4) as avg_gap_s,
               coalesce(sum(tokens), 0.0) as total_tokens,
               coalesce(cast(trunc(avg(tokens)) as bigint), 0) as avg_tokens,
               cast(cast(coalesce(sum(tokens), 0.0) as decimal(18,4)) * cast(0.0001 as decimal(5,4)) as double) as total_cost,
               round(coalesce(sum(tokens), 0.0) * 0.0001 / count(*), 8) as cost_per_request
        from fx_chat_log""",
    "coerce_tokens": "select id, coalesce(tokens, -1.0) as tokens_used from fx_chat_log",
    "parse_times": "select event_id, epoch_us(ts) as ts from events",
    "tokens_by_session": """
        select session_id, coalesce(sum(tokens), 0.0) as tokens_used from fx_chat_log
        where session_id is not null group by session_id""",
    "requests_per_hour": """
        select epoch_us(h.hour) as hour, coalesce(c.n, 0) as requests
        from (select unnest(generate_series(min(date_trunc('hour', log_ts)), max(date_trunc('hour', log_ts)), interval 1 hour)) as hour
              from fx_chat_log) h
        left join (select date_trunc('hour', log_ts) as hour, count(session_id) as n from fx_chat_log group by 1) c on c.hour = h.hour""",
    "session_details": """
        select id, session_id, split_part(user_feedback, chr(10), 1) as user_feedback, modification_needed, history,
               split_part(model_response, chr(10), 1) as model_response, epoch_us(log_ts) as "timestamp", latency,
               coalesce(tokens, -1.0) as tokens_used, cast(cost as double) as cost,
               epoch_us(log_ts) - cast(round(latency * 1e6) as bigint) as start_time,
               case when session_id is not null then epoch_us(first_ts) end as first_token
        from (select *, min(log_ts) over (partition by session_id) as first_ts,
                     row_number() over (partition by session_id, split_part(user_feedback, chr(10), 1),
                                        split_part(model_response, chr(10), 1) order by id) as rn
              from fx_chat_log)
        where rn = 1 order by id limit 10""",
    "latest_by_session": """
        select session_id, id, user_feedback, modification_needed, history, model_response, epoch_us(log_ts) as "timestamp",
               round_even(latency, 2) as latency, coalesce(tokens, -1.0) as tokens_used, cast(cost as double) as cost
        from (select *, row_number() over (partition by session_id order by log_ts desc, id desc) as rn
              from fx_chat_log where session_id is not null)
        where rn = 1""",
    "session_gaps": """
        select session_id, id, coalesce(epoch_us(log_ts) - lag(epoch_us(log_ts)) over (partition by session_id order by log_ts, id), -1) as gap_us
        from fx_chat_log where session_id is not null""",
    "chat_log_append": """
        select id, coalesce(session_id, '') as session_id, model_response, epoch_us(log_ts) as "timestamp", cast(cost as double) as cost
        from fx_chat_log""",
    "word_count": f"select doc_id, {words('text')} as words from documents",
    "token_meter": "select doc_id, len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) as tokens from documents",
    "strip_speaker": """
        select doc_id, split_part(case when doc_id % 4 = 0 then text else 'AI: ' || text end, ': ', 2) as said from documents""",
    "reply_joined_lines": """
        select doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda l: l <> ''), '') as reply from documents""",
    "context_split": """
        select doc_id, split_part(p, 'Context details:', 1) as context_first, split_part(p, 'Context details:', -1) as context_last
        from (select doc_id, case doc_id % 3 when 0 then text when 1 then text || 'Context details:' || source
                     else source || 'Context details:' || text || 'Context details:' || lang end as p from documents)""",
    "nonempty_feedback": """
        select doc_id, text as feedback from documents
        where doc_id % 5 not in (0, 1, 2) and text <> '' and not regexp_full_match(text, '\\s*')""",
    "price_catalog": """
        with p as (select 'model-' || p_partkey as model, p_partkey % 4 as s, p_brand, cast(p_size as varchar) as p_size,
                          cast(cast(p_retailprice / 1000 as decimal(18,8)) as double) as price,
                          cast(cast(2 * cast(p_retailprice / 1000 as decimal(18,8)) as decimal(18,8)) as double) as twice from part)
        select 'embeddings' as section, model, '' as variant, '' as size, 'price' as price_kind, price from p where s = 0
        union all select 'images', model, p_brand, p_size, 'price', price from p where s = 1
        union all select 'audio', model, '', '', 'price', price from p where s = 2
        union all select 'chat', model, '', '', 'prompt', price from p where s = 3
        union all select 'chat', model, '', '', 'completion', twice from p where s = 3""",
    "chat_price_table": """
        select 'model-' || p_partkey as model, cast(cast(p_retailprice / 1000 as decimal(18,8)) as double) as prompt_price,
               cast(cast(2 * cast(p_retailprice / 1000 as decimal(18,8)) as decimal(18,8)) as double) as completion_price
        from part where p_partkey % 4 = 3""",
    "request_cost": f"""
        select doc_id, m as model,
               coalesce(cast(w * prompt_price as double), -1.0) as prompt_cost,
               coalesce(cast(r * completion_price as double), -1.0) as reply_cost,
               coalesce(cast(w * prompt_price + r * completion_price as double), -1.0) as cost
        from (select doc_id, case doc_id % 3 when 0 then 'small-instruct' when 1 then 'large-instruct' else 'no-such-model' end as m,
                     cast({words('text')} as decimal(10,0)) as w, cast({words("'Dear customer from ' || source")} as decimal(10,0)) as r
              from documents) left join fx_prices on model = m""",
    "history_last_n": """
        select session_id, ord, coalesce(array_to_string(list_transform(before, lambda m: m.role || ': ' || m.text), chr(10)), '') as history
        from fx_history""",
    "history_logged": """
        select session_id, ord, array_to_string(list_transform(after, lambda m: m.role || ': ' || m.text), chr(10)) as history
        from fx_history where role = 'assistant'""",
    "feedback_flatten": """
        select session_id, pos, feedback_id, review_text, coalesce(customer_name, '') as customer_name, n_surveys,
               core_prompt, context_first, context_last from fx_feedback""",
    "batch_rejects": "select distinct session_id from fx_feedback where block % 4 = 1",
    "batch_file_rows": """
        select session_id as batch, pos, case when feedback_id % 10 = 4 then 'F-' else '' end || feedback_id as feedback_id, lang as review
        from fx_feedback where block % 4 not in (1, 2) and feedback_id % 10 not in (3, 5, 6)""",
    "batch_file_rejects": f"""
        with entries as (
            select *, case feedback_id % 10 when 3 then '{{"ID":' || feedback_id || ',"Review":"plain text"}}' when 5 then 'lost'
                                            when 6 then '{{"Review":{{"Text":"' || lang || '"}}}}'
                                            when 4 then '{{"ID":"F-' || feedback_id || '","Review":{{"Text":"' || lang || '"}}}}'
                                            else '{{"ID":' || feedback_id || ',"Review":{{"Text":"' || lang || '"}}}}' end as entry
            from fx_feedback
        ), whole as (
            select session_id, block, length('{{"Core Prompt":"' || session_id || '","Feedback Data":[')
                   + sum(length(entry) + case when feedback_id % 10 = 5 then 2 else 0 end) + count(*) - 1 + 2 as n
            from entries group by session_id, block
        )
        select session_id as batch, -1 as pos, 'broken_json' as reason, cast(case when block % 4 = 1 then n // 2 else n + 11 end as int) as characters
        from whole where block % 4 in (1, 2)
        union all
        select session_id, pos, case feedback_id % 10 when 3 then 'review_is_no_object' when 5 then 'not_an_object' else 'no_id' end, length(entry)
        from entries where block % 4 not in (1, 2) and feedback_id % 10 in (3, 5, 6)""",
    "customer_name": """
        select feedback_id, customer_name as name, coalesce(customer_name, 'None') as labelled_name from fx_feedback""",
    "first_survey": "select feedback_id, coalesce('[' || survey_1 || ']', '') as questions from fx_feedback",
    "surveys_flat": SURVEY_ROWS,
    "survey_positional_pair": f"""
        select f.session_id, f.pos, f.feedback_id, f.review_text, s.questions
        from fx_feedback f
        join (select session_id, questions, row_number() over (partition by session_id order by pos, survey_pos) - 1 as place
              from ({SURVEY_ROWS})) s on s.session_id = f.session_id and s.place = f.pos""",
    "survey_lookup": """
        select r.doc_id, coalesce(try_cast(r.survey_id as bigint), -1) as survey_key, coalesce(m.contact, '') as contact,
               coalesce(m.review_rating, -1) as rating, r.comment || coalesce(m.review_text, 'None') as comment_with_review
        from fx_requests r left join fx_first_survey m on m.survey_id = try_cast(r.survey_id as bigint)""",
    "prompt_reply": "select session_id, ord, "
    + fill(prompts.REPLY, {"review": "review", "rating": "review_rating", "history": "history", "username": "contact"})
    + " as prompt from fx_turns",
    "prompt_reply_plain": "select session_id, ord, "
    + fill(prompts.REPLY_WITHOUT_RATING, {"review": "review", "history": "history", "username": "contact"})
    + " as prompt from fx_turns",
    "prompt_analysis": f"select feedback_id, {per_review(prompts.ANALYSIS, OWN_SURVEYS)} as prompt from fx_feedback",
    "prompt_analysis_positional": f"""
        select f.feedback_id, {per_review(prompts.ANALYSIS, 's.questions', policy=False)} as prompt
        from fx_feedback f
        join (select session_id, questions, row_number() over (partition by session_id order by pos, survey_pos) - 1 as place
              from ({SURVEY_ROWS})) s on s.session_id = f.session_id and s.place = f.pos""",
    "prompt_one_reply": f"select feedback_id, {per_review(prompts.ONE_REPLY, chr(40) + chr(39) + '[' + chr(39) + ' || survey_1 || ' + chr(39) + ']' + chr(39) + chr(41))} as prompt from fx_feedback",
    "prompt_tones": f"select feedback_id, {per_review(prompts.TONES, OWN_SURVEYS)} as prompt from fx_feedback",
    "prompt_summary": "select session_id, 0 as part, "
    + fill(
        prompts.SUMMARY,
        {"count": "count(*)", "texts": "('[' || string_agg('\"' || default_reply || '\"', ',' order by pos) || ']')"},
    )
    + " as prompt from fx_responses group by session_id",
    "prompt_themes": "select doc_id, "
    + fill(prompts.THEMES, {"classes": text(", ".join(THEMES)), "comment": "text"})
    + " as prompt from documents",
    "prompt_revise": "select r.request_id, "
    + fill(prompts.REVISE, {"text": "s.default_reply", "change": "r.change"})
    + " as prompt from fx_revisions r join fx_responses s on s.feedback_id = r.feedback_id where r.i in (0, 1)",
    "prompt_chat_revise": "select session_id, ord, "
    + fill(prompts.CHAT_REVISE, {"history": "history", "change": "text"})
    + " as prompt from fx_turns",
    "prompt_direct": f"""
        select doc_id, {DIRECT} as prompt,
               '{{"format_version":"test-1","max_tokens":{prompts.MAX_OUTPUT_TOKENS},"messages":[{{"role":"user","content":'
               || cast(to_json({DIRECT}) as varchar) || '}}]}}' as body
        from documents""",
    "batch_inference": f"""
        select doc_id, case when w % 17 = 0 then '' else 'Thank you for ' || w || ' words' end as raw,
               case when w % 17 = 0 then 'ValueError: no reply for this text' else '' end as error
        from (select doc_id, {words('text')} as w from documents)""",
    "review_analysis": f"""
        select feedback_id, default_reply as "Default", friendly as "More_friendly", professional as "More_Professional",
               concise as "More_Concise", summary as "Summary", coalesce(sentiment, '') as "Sentiment",
               array_to_string(positive, '{LIST}') as "Positive_Themes", array_to_string(negative, '{LIST}') as "Negative_Themes"
        from fx_analysis where ok""",
    "parse_responses": f"""
        select feedback_id, ok as parse_ok,
               case when not ok then array_to_string(['Default', 'More_friendly', 'More_Professional', 'More_Concise', 'Summary',
                                                      'Sentiment', 'Positive_Themes', 'Negative_Themes'], '{LIST}')
                    when n_surveys = 0 then 'Sentiment' else '' end as missing_keys
        from fx_analysis""",
    "parse_rejects": "select feedback_id, 'I can not answer ' || words || ' words' as raw from fx_analysis where not ok",
    "tone_replies": """
        select session_id, pos, feedback_id, default_reply as "Default", friendly as "More_friendly",
               professional as "More_Professional", concise as "More_Concise"
        from fx_analysis where ok""",
    "one_reply_analysis": """
        select feedback_id, default_reply as "Response", summary as "Summary", coalesce(sentiment, '') as "Sentiment",
               case when words > 100 then 'long text' else 'short text' end as "Positive_Themes",
               case when n_surveys = 0 then 'Sentiment' else '' end as missing_keys
        from fx_analysis""",
    "one_reply_document": """
        select feedback_id, default_reply || case when pos = 0 then ' [softer]' else '' end as "Response", summary as "Summary"
        from fx_analysis""",
    "direct_replies": f"""
        select doc_id, 'Thank you for ' || {words('text')} || ' words' as raw from documents
        where doc_id % 9 <> 0 and not regexp_full_match(text, '\\s*')""",
    "theme_tags_model": f"""
        select doc_id, array_to_string(list_sort(hits), '{LIST}') as themes_category, 'Something else' as rejected,
               case when len(hits) > 2 then 'positive' when len(hits) = 0 then 'negative' else 'neutral' end as sentiment
        from (select doc_id, list_filter({THEMES!r}, lambda c: list_contains(regexp_extract_all(text, '\\S+'), c)) as hits from documents)""",
    "theme_tags_keyword": f"""
        select d.doc_id, coalesce(string_agg(distinct k.theme, '{LIST}' order by k.theme), '') as themes
        from documents d left join fx_keywords k on list_contains(regexp_extract_all(d.text, '\\S+'), k.keyword)
        group by d.doc_id""",
    "theme_tags_phrase": f"""
        with phrases as (
            select theme, ' ' || array_to_string(regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' as phrase
            from (values {values(PHRASES)}) as v(theme, phrase)
        ), texts as (
            select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' as run from documents
        )
        select doc_id, coalesce(string_agg(distinct theme, '{LIST}' order by theme), '') as themes
        from texts left join phrases on contains(run, phrase) group by doc_id""",
    "theme_allowlist": """
        select doc_id, theme from (select distinct doc_id, unnest(regexp_extract_all(text, '\\S+')) as theme from documents)
        where theme in (select theme from fx_taxonomy)""",
    "theme_rejects": """
        select doc_id, theme from (select distinct doc_id, unnest(regexp_extract_all(text, '\\S+')) as theme from documents)
        where theme not in (select theme from fx_taxonomy)""",
    "taxonomy_parse": "select distinct p_brand, p_partkey // 100 as block, p_type as theme from part",
    "review_list": f"""
        select session_id, 0 as part, count(*) as reviews, string_agg(default_reply, '{LIST}' order by pos) as items
        from fx_responses group by session_id""",
    "review_list_originals": f"""
        select session_id, 0 as part, count(*) as reviews, string_agg(review_text, '{LIST}' order by pos) as items
        from fx_feedback group by session_id""",
    "sentiment_distinct": """
        select session_id, sentiment, count(*) as n from fx_responses where sentiment is not null group by all""",
    "sentiment_overview": """
        select r.session_id, coalesce(t.sentiment, '') as sentiment, coalesce(t.kinds, 0) as n_sentiments,
               coalesce(t.kinds, 0) <> 1 as conflict, count(*) as reviews
        from fx_responses r
        left join (select session_id, sentiment, count(*) over (partition by session_id) as kinds,
                          row_number() over (partition by session_id order by count(*) desc, sentiment desc) as rn
                   from fx_responses where sentiment is not null group by session_id, sentiment) t
          on t.session_id = r.session_id and t.rn = 1
        group by all""",
    "theme_counts": """
        select session_id, kind, theme, count(*) as n
        from (select session_id, feedback_id, 'positive' as kind, unnest(positive) as theme from fx_responses
              union all select session_id, feedback_id, 'negative', unnest(negative) from fx_responses)
        group by all""",
    "themes_overview": f"""
        select session_id, 0 as part,
               coalesce(array_to_string(list_sort(list_distinct(flatten(list(positive)))), '{LIST}'), '') as positive_themes,
               coalesce(array_to_string(list_sort(list_distinct(flatten(list(negative)))), '{LIST}'), '') as negative_themes
        from fx_responses group by session_id""",
    "consolidated_summary": f"""
        select session_id, count(*) || ' texts with ' || cast(sum({words('default_reply')}) as bigint) || ' words.' as summary,
               count(*) as reviews
        from fx_responses group by session_id""",
    "consolidated_summary_originals": f"""
        select session_id, cast(sum({words('review_text')}) as bigint) as words, count(*) as reviews from fx_feedback group by session_id""",
    "overview": f"""
        with r as (select * from fx_analysis where ok),
        top as (select session_id, sentiment, count(*) over (partition by session_id) as kinds,
                       row_number() over (partition by session_id order by count(*) desc, sentiment desc) as rn
                from r where sentiment is not null group by session_id, sentiment)
        select r.session_id, 0 as part,
               count(*) || ' texts with ' || cast(sum({words('default_reply')}) as bigint) || ' words.' as "Summary",
               coalesce(any_value(t.sentiment), '') as "Sentiment",
               coalesce(array_to_string(list_sort(list_distinct(flatten(list(positive)))), '{LIST}'), '') as "Positive_Themes",
               coalesce(array_to_string(list_sort(list_distinct(flatten(list(negative)))), '{LIST}'), '') as "Negative_Themes",
               coalesce(any_value(t.kinds), 0) <> 1 as conflict, count(*) as reviews
        from r left join top t on t.session_id = r.session_id and t.rn = 1
        group by r.session_id""",
    "result_document": """
        select r.session_id, count(*) || ' replies' as summary, coalesce(any_value(t.sentiment), '') as sentiment,
               arg_min(default_reply, pos) as first_default, arg_min(feedback_id, pos) as first_feedback_id, count(*) as responses
        from fx_responses r
        left join (select session_id, sentiment, row_number() over (partition by session_id order by count(*) desc, sentiment desc) as rn
                   from fx_responses where sentiment is not null group by session_id, sentiment) t
          on t.session_id = r.session_id and t.rn = 1
        group by r.session_id""",
    "result_document_read": """
        select session_id, pos, feedback_id, default_reply as "Default", coalesce(sentiment, '') as "Sentiment" from fx_responses""",
    "revise_match": """
        select r.request_id, case when s.feedback_id is not null and r.field = 'Default' then 200 else 404 end as status,
               case when s.feedback_id is null then 'no_such_feedback' when r.field <> 'Default' then 'no_such_field' else '' end as reason,
               case when r.field = 'Default' then coalesce(s.default_reply, '') else '' end as stored_text
        from fx_revisions r left join fx_responses s on s.session_id = r.session_id and s.feedback_id = r.feedback_id""",
    "revise_status": """
        select r.request_id, case when r.i < 2 then 200 else 404 end as status,
               case r.i when 0 then s.default_reply || ' [softer]' when 1 then s.default_reply || ' [softer] [shorter]' else '' end as revised_text
        from fx_revisions r left join fx_responses s on s.session_id = r.session_id and s.feedback_id = r.feedback_id""",
    "revise_apply": """
        select s.session_id, s.pos, s.feedback_id,
               s.default_reply || case when f.toxic = 1 then ' [softer] [shorter]' else '' end as "Default", s.friendly as "More_friendly",
               count(*) over (partition by s.session_id) || ' replies' as overview
        from fx_responses s join fx_feedback f on f.feedback_id = s.feedback_id""",
    "revise_two_writers": """
        select s.session_id, s.feedback_id, s.default_reply || case when f.toxic = 1 then ' [softer] [shorter]' else '' end as "Default",
               s.friendly || case when s.feedback_id % 4 = 0 then ' [warmer]' else '' end as "More_friendly"
        from fx_responses s join fx_feedback f on f.feedback_id = s.feedback_id where s.feedback_id % 6 <> 1""",
    "chat_replies": "select session_id, ord, is_first, raw from fx_replies",
    "chat_replay": f"""
        with recursive asked as (
            select session_id, ord, text, contact, review, row_number() over (partition by session_id order by ord) as k from fx_turns
        ), chat as (
            select session_id, ord, text, k, cast(null as varchar) as raw_before,
                   'Dear ' || coalesce(contact, 'None') || ': ' || {words('review')} || ' words read, 0 characters before' as raw
            from asked where k = 1
            union all
            select t.session_id, t.ord, t.text, t.k, c.raw,
                   'Revised with ' || {words('t.text')} || ' words after '
                   || length(case when c.k > 1 then 'assistant: ' || c.raw_before || chr(10) else '' end
                             || 'user: ' || c.text || chr(10) || 'assistant: ' || c.raw) || ' characters'
            from chat c join asked t on t.session_id = c.session_id and t.k = c.k + 1
        )
        select session_id, ord, raw from chat""",
    "chat_log_build": f"""
        select session_id, ord, case when is_first then text else '' end as user_feedback,
               case when is_first then '' else text end as modification_needed,
               case when is_first then '' else
                    history || case when history = '' then '' else chr(10) end || 'user: ' || text || chr(10) || 'assistant: ' || raw end as history,
               raw as model_response,
               cast(case when is_first then len(regexp_extract_all(raw, '\\w+|[^\\w\\s]')) else {words('raw')} end as double) as tokens_used,
               coalesce(cast({words('text')} * prompt_price + {words('raw')} * completion_price as double), -1.0) as cost
        from fx_replies left join fx_prices
          on model = case cast(session_id as bigint) % 3 when 0 then 'small-instruct' when 1 then 'large-instruct' else 'no-such-model' end""",
    "delta_assemble": "select doc_id as message_id, text || chr(10) as text from documents",
    "delta_tokens": f"select doc_id as message_id, {words('text')} as tokens from documents",
    "stream_delta_assemble": "select doc_id as message_id, text || chr(10) as text, true as complete from documents",
    "stream_history": """
        select session_id, array_to_string(list(role || ': ' || text order by ord), chr(10)) as history
        from (select *, row_number() over (partition by session_id order by ord desc) as rn from fx_messages)
        where rn <= 3 group by session_id""",
}
SQL["durable_inference"] = SQL["batch_inference"]
SQL["stream_request_log"] = SQL["chat_log_build"].replace("raw as model_response,", "raw as model_response, 3.0 as latency,")
SQL["stream_kpi"] = SQL["kpi_overall"]
SQL["stream_requests_per_hour"] = SQL["requests_per_hour"]
SQL["stream_tokens_by_session"] = SQL["tokens_by_session"]
SQL["stream_chat_log"] = SQL["chat_log_append"]


def oracle_sql() -> dict[str, str]:
    return {name: with_fixtures(sql) for name, sql in SQL.items()}
