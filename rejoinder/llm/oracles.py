"""SQL that gives the same rows as the registered queries, for those that SQL can express."""

WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
with item_words as (
    select cast(item_id as varchar) as item_id, regexp_extract_all({FOLDED}, {WORDS}) as words
    from benchmark where item_id is not null
), windows as (
    select item_id, array_to_string(words[i : i + 9], ' ') as phrase, least(len(words), 10) as n
    from (select *, unnest(generate_series(1, greatest(len(words) - 9, 1))) as i from item_words where len(words) > 0)
), doc_words as (
    select doc_id, regexp_extract_all({FOLDED}, {WORDS}) as words from documents
), starts as (
    select doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) as i
    from doc_words cross join (select distinct n from windows) where len(words) >= n
), spans as (
    select doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') as phrase from starts
), found as (
    select s.doc_id, s.i, s.n, w.item_id from spans s join windows w on s.phrase = w.phrase and s.n = w.n
), hits as (
    select doc_id, count(distinct p) as n_hit
    from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from found) group by doc_id
), items as (
    select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
    from (select distinct doc_id, item_id from found) group by doc_id
)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from doc_words d left join hits h using (doc_id) left join items i using (doc_id)
"""

# the template's control strings around each turn, and what escaping adds: a backslash for each one in a text, and one
# for each control string
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)


def escaped_length(column: str) -> str:
    of = lambda s: f"(length({column}) - length(replace({column}, '{s}', ''))) // {len(s)}"
    return " + ".join([f"length({column})", *map(of, (chr(92), *CONTROLS))])


REPLY_TREES = f"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum({escaped_length('role')} + {escaped_length('text')} + {len("<|im_start|>" + "<|im_end|>") + 2}) as bigint) as formatted_chars
from turns group by conv_id
"""

TOP_K = """
with vectors as (
    select distinct vec_id, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
    from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.x, c.x) as bigint) as score
    from vectors q join vectors c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 5
"""

ORACLES: dict[str, str] = {
    "op3_decontaminate": DECONTAMINATE,
    "op10_reply_trees": REPLY_TREES,
    "op12_pivot_top_k": TOP_K,
}
