"""Queries of this package in DuckDB's SQL, where SQL can express them.

The others are held against plain loops in ``tests/llm``: trained networks, alignments,
dependent rounding and the layout of pages are beyond SQL.
"""

from __future__ import annotations

import re

from .quality_rules import ANY_SENTENCE_MARK, FURNITURE, MARKS, SYMBOL, WORD_BREAK, Rules

_RULES = Rules()
# All sentence marks, code points as this engine writes them.
_ANY_MARK = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", ANY_SENTENCE_MARK)
_PHRASES = " or ".join(f"contains(lower(line), '{p}')" for p in FURNITURE)

# Words are compared as they are, where the query compares hashes of windows.
OP1 = rf"""
with texts as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), cut as (
    select r, doc_id, text,
        list_filter(string_split_regex(text, '{WORD_BREAK}'), lambda w: w <> '') as words,
        list_filter(string_split(text, chr(10)),
            lambda x: length(regexp_replace(x, '{WORD_BREAK}', '', 'g')) > 0) as lines
    from texts
), places as (
    select r, words, unnest(generate_series(1, len(words) - 2)) as i from cut where len(words) >= 3
), windows as (
    select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n from places
), repeated as (
    select r, count(distinct p) as n_repeat_words
    from (select r, unnest([i, i + 1, i + 2]) as p from windows where n > 1) group by r
), line_words as (
    select r, line, list_filter(string_split_regex(line, '{WORD_BREAK}'), lambda w: w <> '') as words
    from (select r, unnest(lines) as line from cut)
), measured as (
    select r, line, len(words) as n,
        len(list_filter(words, lambda w: regexp_full_match(w, '{MARKS}+'))) as menu,
        len(list_filter(words, lambda w: regexp_matches(w, '[!?]{{2,}}$'))) as shouts,
        length(line) - length(regexp_replace(line, '{SYMBOL}', '', 'g')) as symbols,
        length(regexp_replace(regexp_replace(line, '^{WORD_BREAK}', ''), '{WORD_BREAK}$', '')) as chars
    from line_words
), lost as (
    select r, sum(n)::bigint as lost_words from measured
    where 100 * menu >= {_RULES.menu_percent} * n
        or 100 * shouts >= {_RULES.shout_percent} * n
        or (n >= {_RULES.open_words} and not regexp_matches(line, '{_ANY_MARK}'))
        or 100 * symbols >= {_RULES.symbol_percent} * chars
        or (n <= {_RULES.furniture_words} and ({_PHRASES}))
    group by r
), figures as (
    select doc_id, len(words)::bigint as n_words,
        length(array_to_string(words, ''))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')))::bigint as n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        coalesce(lost_words, 0)::bigint as lost_words
    from cut left join repeated using (r) left join lost using (r)
), judged as (
    select *, n_words < {_RULES.least_words}
        or 100 * n_repeat_words > {_RULES.most_repeated_percent} * n_words as base_failed
    from figures
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and 100 * lost_words <= {_RULES.most_lost_percent} * n_words as kept, lost_words
from judged
"""

_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{WORD_BREAK}'), lambda w: w <> '')"

OP3 = f"""
with texts as (
    select row_number() over () as r, doc_id, {_WORDS} as words from documents
), starts as (
    select r, doc_id, unnest(generate_series(1, len(words) - 12)) as i,
        unnest(list_transform(generate_series(1, len(words) - 12),
            lambda k: array_to_string(words[k : k + 12], ' '))) as piece
    from texts where len(words) >= 13
), windows as (
    select r, doc_id, i, min(doc_id) over (partition by piece) as first from starts
), gone as (
    select distinct r, unnest(generate_series(i, i + 12)) as p from windows where first < doc_id
), places as (
    select r, unnest(words) as word, unnest(generate_series(1, len(words))) as p from texts
), kept as (
    select r, string_agg(word, ' ' order by p) as kept from places anti join gone using (r, p) group by r
), removed as (
    select r, count(*) as n from gone group by r
)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
    sha256(coalesce(kept, '')) as kept_sha256
from texts left join kept using (r) left join removed using (r)
"""

# All pairs of texts that share a shingle, then everything that hangs together.
OP4 = f"""
with recursive texts as (
    select doc_id, {_WORDS} as words from documents
), cut as (
    select doc_id, unnest(case when len(words) = 0 then []::varchar[]
        when len(words) < 5 then [array_to_string(words, ' ')]
        else list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i : i + 4], ' ')) end) as s
    from texts
), bags as (
    select doc_id, s, count(*) as c from cut group by doc_id, s
), sizes as (
    select doc_id, sum(c) as n from bags group by doc_id
), shared as (
    select x.doc_id as a, y.doc_id as b, sum(least(x.c, y.c)) as same
    from bags x join bags y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2
), links as (
    select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 5 * same >= 4 * (p.n + q.n - same)
), both_ways as (
    select a, b from links union select b, a from links
), reached(doc_id, other) as (
    select doc_id, doc_id from texts
    union
    select reached.doc_id, b from reached join both_ways on a = other
)
select doc_id, min(other) as class_id from reached group by doc_id
"""

# Every document goes through every order, where the query adds up counts of masks.
OP12 = f"""
with letters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')
), orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps as (
    select filter_order, step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as before
    from orders, (values (1), (2), (3), (4), (5)) as s(step)
), texts as (
    select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, {_WORDS} as words from documents
), told as (
    select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), judged as (
    select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
        case when len(words) < 100 then 'A' else '' end
        || case when 100 * len(list_distinct(words)) < 80 * len(words) then 'B' else '' end
        || case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text)
            then 'C' else '' end
        || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
        || case when min(texts.doc_id) over (partition by text) < texts.doc_id then 'E' else '' end as fails
    from texts left join told on told.doc_id = texts.doc_id
), met as (
    select part, filter_order, step, own, good, toxic, contains(fails, own) as fail, fails = own as alone,
        length(translate(fails, before, '')) < length(fails) as gone
    from judged, steps
), figures as (
    select part, filter_order, step, own, count(*) filter (not gone and not fail) as kept,
        count(*) filter (not gone and fail) as removed, count(*) filter (gone and fail) as redundant,
        count(*) filter (alone) as unique_fails, count(*) filter (not gone and fail and good) as good_lost,
        count(*) filter (not gone and fail and toxic) as toxic_lost
    from met group by part, filter_order, step, own
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, own))::bigint as shapley
from figures
"""

# Sums over dense tables of all terms and sources, in 128-bit integers.
OP13 = r"""
with texts as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), occurrences as (
    select r, lang, source,
        translate(unnest(terms), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
    from texts
), vocabulary as (
    select lang, term, count(*)::hugeint as n from occurrences
    group by lang, term having count(distinct r) >= 10
), sizes as (
    select lang, sum(n)::hugeint as total, count(*)::hugeint as v from vocabulary group by lang
), sources as (
    select distinct lang, source from texts
), counts as (
    select lang, source, term, count(*)::hugeint as n from occurrences semi join vocabulary using (lang, term)
    group by lang, source, term
), totals as (
    select lang, source, sum(n)::hugeint as total from counts group by lang, source
), dense as (
    select s.lang, s.source, y.term, coalesce(c.n, 0) as n,
        1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * z.v) as p,
        1 + 1000000000::hugeint * (y.n + 2) // (z.total + 2 * z.v) as q
    from sources s join vocabulary y on y.lang = s.lang join sizes z on z.lang = s.lang
    left join counts c on c.lang = s.lang and c.source = s.source and c.term = y.term
    left join totals t on t.lang = s.lang and t.source = s.source
), apart as (
    select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
    from dense x join dense y on x.lang = y.lang and x.term = y.term and x.source <> y.source
    group by x.lang, x.source, y.source
), pairs as (
    select x.lang, x.source, y.source as item, coalesce(a.value, 0)::bigint as value
    from sources x join sources y on x.lang = y.lang and x.source <> y.source
    left join apart a on a.lang = x.lang and a.source = x.source and a.item = y.source
), own as (
    select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
    from dense where n > 0 and p > q
), parts as (
    select lang, source, 'pair' as part, item, value from pairs
    union all select lang, source, 'term', item, value from own
), ranked as (
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
    from parts
)
select * from ranked where part = 'pair' or rank <= 10
"""

SQL: dict[str, str] = {
    "op1_quality_rules": OP1, "op3_substring_dedup": OP3, "op4_near_duplicates": OP4,
    "op12_filter_audit": OP12, "op13_source_audit": OP13,
}
