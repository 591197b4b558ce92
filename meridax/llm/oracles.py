"""SQL for the queries that it can express over whole tables."""

from __future__ import annotations

from meridax.llm.quality_rules import RULES, STOP_FORMS

_IN = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_FORMS)
_RULES = " and ".join(f"coalesce({r.measure} {sign} {limit}, true)" for r in RULES for sign, limit in ((">=", r.low), ("<=", r.high)) if limit is not None)
_SPACE = "\\x20\\x09-\\x0D"

QUALITY_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (
  select *,
    list_filter(regexp_split_to_array(t, '[{_SPACE}]+'), lambda x: x <> '') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) as lines,
    length(regexp_replace(t, '[{_SPACE}]', '', 'g')) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(t) - length(regexp_replace(t, '[!?#*$%&|<>{{}}\\[\\]~^_=+\\\\]', '', 'g')) as n_marks
  from d),
windows as (
  select rid, i, array_to_string(words[i:i + 7], ' ') as x
  from (select rid, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
twice as (select rid, i from windows qualify count(*) over (partition by rid, x) > 1),
covered as (
  select rid, sum(least(8, coalesce(following - i, 8))) as n
  from (select rid, i, lead(i) over (partition by rid order by i) as following from twice) group by rid),
m as (
  select doc_id, len(words) as n_words, word_chars, n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    word_chars / nullif(len(words), 0) as mean_word_chars, n_symbols / nullif(len(words), 0) as symbols_per_word,
    n_marks / nullif(len(words), 0) as marks_per_word,
    len(list_filter(words, lambda x: x in ({_IN}))) / nullif(len(words), 0) as stop_word_share,
    (len(lines) - len(list_distinct(lines))) / nullif(len(lines), 0) as dup_line_share,
    coalesce(n, 0) / nullif(len(words), 0) as repeat_word_share
  from w left join covered using (rid))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  (not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and {_RULES}) as kept
from m
"""
