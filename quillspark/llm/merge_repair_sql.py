"""SQL for the rows of the branch merge and of the conversation repair. CRC-32 is a fold over the bytes of ASCII strings."""

from __future__ import annotations

CRC_TABLE = "crc as materialized (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t)"


def _crc(text: str) -> str:
    """Needs the column t of the table."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: cast(ord(ch) as bigint))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


def _column(c: str, k: int) -> str:
    edit = lambda side: f"case {side}[{k}] when 0 then '' when 1 then {c} || '!' when 2 then {c} || '?' else {c} end"
    return f"{edit('l')} as {c}_l, {edit('r')} as {c}_r"


OP11 = rf"""
    with {CRC_TABLE}, d as (
        select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, string_split(coalesce(text, ''), chr(10)) as lines,
            coalesce(cast(doc_id as varchar), '') as key, list_concat(['row', 'lang', 'source'], list_transform(range(len(lines)), lambda i: cast(i as varchar))) as names
        from documents
    ), c as materialized (
        select rid, doc_id, lang, source, lines, list_transform(names, lambda n: {_crc("'L:' || key || ':' || n")} % 7) as l, list_transform(names, lambda n: {_crc("'R:' || key || ':' || n")} % 7) as r from d, crc
    ), e as (
        select *, {_column('lang', 2)}, {_column('source', 3)}, l[1] as row_l, r[1] as row_r from c
    ), u as (
        select rid, row_l, i, lines[i] as line, l[i + 3] as a, r[i + 3] as b from (select *, unnest(range(1, len(lines) + 1)) as i from e)
    ), m as (
        select rid, i, line, a < 5 as change_l, b < 5 as change_r,
            case when row_l = 0 or b < 3 then b else a end as m, case when row_l = 0 or b in (3, 4) then b else a end as g,
            a < 3 and b < 3 and a <> b as clash, least(a, b) = 0 as dropped, a in (3, 4) and b in (3, 4) and a <> b as two, a < 3 or b < 3 as line_change, a in (3, 4) or b in (3, 4) as gap_change
        from u
    ), s as (
        select rid, bool_or(change_l) as change_l, bool_or(change_r) as change_r, count(*) filter (where line_change and not clash) + count(*) filter (where gap_change and not two) as clean,
            count(*) filter (where clash and not dropped) as edit_edit, count(*) filter (where clash and dropped) as edit_delete, count(*) filter (where two) as insert_insert,
            coalesce(string_agg(concat_ws(chr(10), case m when 0 then null when 1 then line || '!' when 2 then line || '?' else line end, case g when 3 then '!' when 4 then '?' end), chr(10) order by i) filter (where m <> 0 or g in (3, 4)), '') as text
        from m group by rid
    ), j as (
        select e.*, s.* exclude (rid), change_l or lang_l <> lang or source_l <> source as touched_l, change_r or lang_r <> lang or source_r <> source as touched_r,
            lang_l <> lang and lang_r <> lang and lang_l <> lang_r as lang_clash, source_l <> source and source_r <> source and source_l <> source_r as source_clash,
            row_l = 0 or row_r = 0 as drop, (row_l = 0 and row_r <> 0 and touched_r) or (row_r = 0 and row_l <> 0 and touched_l) as fought, not drop or (fought and row_r <> 0) as here,
            cast((lang_l <> lang or lang_r <> lang) and not lang_clash as bigint) + cast((source_l <> source or source_r <> source) and not source_clash as bigint) as columns_clean
        from e join s on e.rid = s.rid
    )
    select doc_id, case when here then case when row_l = 0 or lang_r <> lang then lang_r else lang_l end end as lang, case when here then case when row_l = 0 or source_r <> source then source_r else source_l end end as source,
        case when here then sha256(text) end as text_sha256, case when drop then cast(not fought as bigint) else clean + columns_clean end as n_clean,
        case when drop then 0 else edit_edit + cast(lang_clash as bigint) + cast(source_clash as bigint) end as n_edit_edit, case when drop then cast(fought as bigint) else edit_delete end as n_edit_delete, case when drop then 0 else insert_insert end as n_insert_insert
    from j
    union all
    select -1 - doc_id, lang, source, sha256(case when case when row_r in (3, 4) then row_r else row_l end = 3 then '!' else '?' end), case when row_l in (3, 4) and row_r in (3, 4) and row_l <> row_r then 0 else 1 end, 0, 0,
        case when row_l in (3, 4) and row_r in (3, 4) and row_l <> row_r then 1 else 0 end
    from j where row_l in (3, 4) or row_r in (3, 4)
"""


def _then(of: str, cost: str, letter: str, line: str | None = None) -> str:
    out = f"e.t || case when e.t = '' then '' else chr(10) end || {line}" if line else "e.t"
    return f"list_transform({of}, lambda e: {{'c': e.c + {cost}, 's': e.s || '{letter}', 't': {out}}})"


def _inserted(of: str, *roles: str) -> str:
    for role in roles:
        of = _then(of, "5", "I", f"'{role}:'")
    return of


_CLOSED = f"b0 as a0, b1 as a1, list_concat(b2, {_inserted('b0', 'user')}, {_inserted('b1', 'user')}, {_inserted('b3', 'user')}) as a2, list_concat(b3, {_inserted('b2', 'assistant')}, {_inserted('b0', 'user', 'assistant')}, {_inserted('b1', 'user', 'assistant')}) as a3"
_EXTRA = "case when fault = 3 then 5 else 0 end"


def _keep(of: str, initial: str) -> str:
    own = "role || ':' || text"
    return f"case when fault in (0, 3) and initial = '{initial}' then {_then(of, _EXTRA, 'K', own)} else [] end"


def _rerole(of: str, role: str) -> str:
    return f"case when fault in (0, 3) then {_then(of, f'1 + {_EXTRA}', 'R', f'''{chr(39)}{role}:{chr(39)} || text''')} else [] end"


def _best(*lists: str) -> str:
    return f"list_sort(list_concat({', '.join(lists)}))[1:1]"


_EMPTY = "cast([] as struct(c integer, s varchar, t varchar)[])"
OP13 = rf"""
    with recursive {CRC_TABLE}, o as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as code from conversations, crc
    ), dm as (
        select conv_id, turn, case when code = 4 then 'user' else role end as role, case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when code = 3 then 2 else 1 end)) as copy
        from o where code <> 0
    ), w as (
        select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as nth from dm
    ), q as (
        select *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ended, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), nth) as k from w
    ), f as materialized (
        select conv_id, turn, role, text, k, role[1:1] as initial, case when ended = '' then 1 when nth > 1 then 2 when right(ended, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
            lag(role[1:1]) over (partition by conv_id order by k) || role[1:1] as pair
        from q
    ), dp as (
        select conv_id, cast(0 as bigint) as k, [{{'c': 0, 's': '', 't': ''}}] as b0, {_EMPTY} as b1, {_EMPTY} as b2, {_EMPTY} as b3 from (select distinct conv_id from conversations)
        union all
        select conv_id, k, {_best(_then('a0', '2', 'D'))}, {_best(_then('a1', '2', 'D'), _keep('a0', 's'))},
            {_best(_then('a2', '2', 'D'), *(_keep(a, 'u') for a in ('a0', 'a1', 'a3')), *(_rerole(a, 'user') for a in ('a0', 'a1', 'a3')))},
            {_best(_then('a3', '2', 'D'), _keep('a2', 'a'), _rerole('a2', 'assistant'))}
        from (select dp.conv_id, f.k, role, text, initial, fault, {_CLOSED} from dp join f on dp.conv_id is not distinct from f.conv_id and f.k = dp.k + 1)
    ), ends as (
        select conv_id, list_sort(list_concat(a0, a3))[1] as best from (select conv_id, k, {_CLOSED} from dp) qualify row_number() over (partition by conv_id order by k desc) = 1
    ), n as (
        select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate, count(*) filter (where fault = 3) as truncated,
            count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal
        from f group by conv_id
    )
    select ends.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
        cast(best.c as bigint) as cost, best.s as audit, sha256(best.t) as repaired_sha256
    from ends left join n on ends.conv_id is not distinct from n.conv_id
"""
