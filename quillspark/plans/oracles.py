"""SQL for the rows of ``queries``, in plain window and aggregate form."""

from __future__ import annotations

from quillspark.functions import lexicons as L
from quillspark.plans.queries import SEEDS


def _in(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# The word lists once more, apart from those of the operators.
PRONOUN_HEADS = """'myself', 'ourselves', 'yourself', 'yourselves', 'himself', 'herself', 'itself', 'mine', 'ours', 'yours', 'his', 'hers', 'theirs', 'that', 'which', 'who', 'whom', 'whose', 'i', 'me', 'she', 'he', 'her',
    'him', 'it', 'this', 'we', 'us', 'they', 'them', 'these', 'themselves', 'our', 'my', 'your'"""
COMPARATIVES = "'other', 'another', 'such', 'different', 'similar', 'additional', 'comparable', 'same', 'further', 'extra'"
INDEFINITE = "'a', 'an', 'one', 'some', 'any', 'either', 'neither', 'no', 'all', 'each', 'every', 'another', 'whichever', 'which', 'what', 'whatever'"
SPATIAL_TEMPORAL = """'\ufb01nal', '\ufb01rst', 'last', 'next', 'prior', 'succeed', 'second', 'nearby', 'previous', 'close', 'above', 'adjacent', 'behind', 'below', 'bottom', 'early', 'formal', 'future', 'before',
    'after', 'earlier', 'later'"""
NUMBERS = """'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety', 'hundreds', 'thousands', 'millions'"""
SMALL_NUMBERS = "'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'"
DEFINITE, INDEFINITE_FIRST = "'the', 'that', 'this', 'those', 'these', 'one'", "'a', 'an', 'some'"
CLOSED = _in(L.CLOSED_CLASS)
WORDS = r"regexp_extract_all({0}, '[\p{{L}}]+|,')"
TOK = rf"""
    p as (select doc_id, string_split_regex(text, '[.\n]+') as p from documents where lang = 'en'),
    s as (select doc_id, unnest(p) as sentence, unnest(range(len(p))) as sent from p),
    w as (select doc_id, sent, {WORDS.format("sentence")} as w from s),
    t as (select doc_id, sent, unnest(w) as token, unnest(range(1, len(w) + 1)) as pos, len(w) as n, w from w where len(w) > 0)
"""


def _runs(doc: str, sent: str, cut: str, extra: str = "") -> str:
    return f"""
    i as (select *, pos - row_number() over (partition by {doc}, {sent} order by pos) as isl from t where lower(token) not in ({CLOSED}) {cut}),
    r as (select {doc}, {sent}, min(pos) as a, max(pos) as b, arg_max(token, pos) as head, any_value(w) as w {extra} from i group by {doc}, {sent}, isl)
    """


RUNS = TOK + "," + _runs("doc_id", "sent", "and pos < n")
EXT = RUNS + """,
    nx as (select *, lead(a) over x as a2, lead(head) over x as h2 from r window x as (partition by doc_id, sent order by a)),
    g as (select head as h1, h2, array_to_string(w[b + 1 : a2 - 1], ' ') as gap from nx where a2 is not null and a2 - b - 1 <= 3 and head <> h2),
    e as (
        select '<Y> ' || gap || ' <X>' as pattern, h1 as anaphor, h2 as antecedent from g
        union all select '<X> ' || gap || ' <Y>', h2, h1 from g
    ),
    c as (select pattern, anaphor, antecedent, count(*) as cnt from e group by all),
    k as (select * from c where pattern in (select pattern from c group by pattern having sum(cnt) > 6)),
    seed as (select anaphor, antecedent, sum(cnt) as n from c group by all order by n desc, anaphor, antecedent limit %d)
""" % SEEDS
RLOGF = "round(case when sum(case when {0} then cnt else 0 end) > 0 then sum(case when {0} then cnt else 0 end) / sum(cnt) * ln(sum(case when {0} then cnt else 0 end)) else 0.0 end, 9)"
HITS = "cast(sum(case when {0} then cnt else 0 end) as bigint)"
STRICT = "(anaphor, antecedent) in (select (anaphor, antecedent) from {0})"
RELAXED = "lower(anaphor) in (select lower(anaphor) from seed) and lower(antecedent) in (select lower(antecedent) from seed)"


def _scores(hit: str) -> str:
    return f"select pattern, {HITS.format('hit')} as hits, cast(sum(cnt) as bigint) as total, {RLOGF.format('hit')} as score from (select *, {hit} as hit from k) group by pattern"


def _rounds(n: int, frozen: bool = False) -> str:
    parts = ["lex0 as (select anaphor, antecedent from seed)"]
    for r in range(1, n + 1):
        parts.append(f"ps{r} as ({_scores(STRICT.format(f'lex{r - 1}'))})")
        old = f"and pattern not in (select pattern from sel{r - 1})" if r > 1 else ""
        parts.append(f"new{r} as (select pattern, score from ps{r} where score > 0 {old} order by score desc, pattern limit 1)")
        if r == 1:
            parts.append("sel1 as (select * from new1)")
        else:
            kept = f"select * from sel{r - 1}" if frozen else f"select s.pattern, case when p.score > 0 then p.score else s.score end as score from sel{r - 1} s join ps{r} p using (pattern)"
            parts.append(f"sel{r} as ({kept} union all select * from new{r})")
        parts.append(f"add{r} as (select anaphor, antecedent, round(sum(1 + 0.01 * score), 9) as score from k join sel{r} using (pattern) where not ({STRICT.format(f'lex{r - 1}')}) group by all order by 3 desc, 1, 2 limit 10)")
        parts.append(f"lex{r} as (select * from lex{r - 1} union all select anaphor, antecedent from add{r})")
    body = " union all ".join(f"select anaphor, antecedent, score, cast({r} as int) as round from add{r}" for r in range(1, n + 1))
    if n > 2:  # each round reads the one before several times
        parts = [p.replace(" as (", " as materialized (", 1) for p in parts]
        return f"with {EXT.replace('k as (', 'k as materialized (')}, {', '.join(parts)} {body}"
    return f"with {EXT}, {', '.join(parts)} {body}"


TALK = rf"""
    w as (select conv_id as doc, turn as sent, {WORDS.format("text")} as w from conversations),
    t as (select doc, sent, unnest(w) as token, unnest(range(1, len(w) + 1)) as pos, w from w where len(w) > 0),
    {_runs("doc", "sent", "")},
    m as (select doc, sent, a - 1 as "start", b - 1 as "end", head, w[a : b] as toks, row_number() over (partition by doc, sent order by a) - 1 as ord from r),
    mm as (select *, sent || ':' || ord as ment from m)
"""
LEX = """
    lx as (
        select a.head as anaphor, b.head as antecedent, count(*) as n from mm a join mm b on a.doc = b.doc and a.sent = b.sent and b.ord = a.ord + 1
        where a.head <> b.head group by all having count(*) >= 2
    )
"""
SEARCH = TALK + "," + LEX + """,
    tk as (select doc, ment, sent, "start", "end", ord, unnest(toks) as tok, unnest(range(len(toks))) as p from mm),
    key as (select doc, ment, sent, "start", arg_min(tok, p) as word from tk where tok in (select anaphor from lx) group by all),
    hit as (
        select distinct k.doc, k.ment as anaphor, c.ment as antecedent, c.sent, c.ord
        from key k join lx on lx.anaphor = k.word join tk c on c.doc = k.doc and c.tok = lx.antecedent
        where (c.sent = k.sent and c."end" < k."start") or (c.sent < k.sent and c.sent >= 1)
    ),
    best as (select doc, anaphor, antecedent from hit qualify row_number() over (partition by doc, anaphor order by sent desc, ord) = 1)
"""
GEO = """
    edge as (select n_name as child, r_name as parent from nation join region on n_regionkey = r_regionkey union all select r_name, 'WORLD' from region),
    start as (select s_name as word, n_name as synset from supplier join nation on s_nationkey = n_nationkey),
    up as (select word, synset, 0 as depth from start union all select word, parent, depth + 1 from up join edge on child = synset)
"""

CLUSTERS = TALK + f""",
    z as (
        select *, array_to_string(toks, ' ') as txt, lower(array_to_string(toks, ' ')) in ({_in(L.ALL_PRONOUNS)}) as pron from mm),
    zz as (
        select *, count(*) over e as size, row_number() over (e order by sent, "start") as nth, min((sent, "start")) over e as opened from z window e as (partition by doc, txt)),
    cl as (
        select *, case when size > 1 and not pron then dense_rank() over (partition by doc, size > 1 and not pron order by opened) end as cluster, pron or nth = 1 as first from zz),
    nw as (
        select *, coalesce(cluster, coalesce(max(cluster) over (partition by doc), 0) + row_number() over (partition by doc, cluster is null order by sent, "start")) as id from cl)
"""
NODES = TALK + """,
    np as (select doc, sent, a, b, 1 + row_number() over (partition by doc, sent order by a) + a - 1 as node from r),
    lf as (
        select t.doc, t.sent, t.pos, t.token, np.node as parent, 1 + t.pos + (select count(*) from np q where q.doc = t.doc and q.sent = t.sent and q.a <= t.pos) as node
        from t left join np on np.doc = t.doc and np.sent = t.sent and t.pos between np.a and np.b)
"""

ORACLE = {
    "tokens": f"with {TOK} select doc_id, cast(sent as int) as sent, cast(pos - 1 as int) as pos, token from t",
    "sentence_lengths": f"with {TOK} select doc_id, cast(sent as int) as sent, cast(len(w) as int) as n_tokens from w where len(w) > 0",
    "noun_runs": f"with {RUNS} select doc_id, cast(sent as int) as sent, cast(a as int) as first_pos, cast(b as int) as last_pos from r",
    "pattern_extractions": f"with {EXT} select * from c",
    "pattern_candidates_v1": f"""
        with {RUNS}, nx as (select *, lead(a) over (partition by doc_id, sent order by a) as a2 from r),
        gp as (select ' ' || array_to_string(w[b + 1 : a2 - 1], ' ') || ' ' as gap from nx where a2 is not null union all select ' ' from r, range(b - a))
        select pattern, count(*) as cnt from (select '<Y>' || gap || '<X>' as pattern from gp union all select '<X>' || gap || '<Y>' from gp) group by pattern
    """,
    "pattern_prune": f"with {EXT} select pattern, cast(sum(cnt) as bigint) as total from k group by pattern",
    "pattern_rlogf_strict": f"with {EXT} {_scores(STRICT.format('seed'))}",
    "pattern_rlogf_relaxed": f"with {EXT} {_scores(RELAXED)}",
    "extraction_scores": f"with {EXT}, ps as ({_scores(STRICT.format('seed'))}), top as (select pattern, score from ps where score > 0 order by score desc, pattern limit 5) select anaphor, antecedent, round(sum(1 + 0.01 * score), 9) as score from k join top using (pattern) group by all",
    "bootstrap_round1": _rounds(1),
    "bootstrap_round2": _rounds(2),
    "bootstrap_twenty": _rounds(20),
    "bootstrap_frozen": _rounds(2, frozen=True),
    "pattern_match": rf"""
        with {TOK}, {_runs("doc_id", "sent", "")},
        x as (select l.doc_id, l.sent, array_to_string(l.w[l.a : l.b], '_') as anaphor, array_to_string(q.w[q.a : q.b], '_') as antecedent
            from r l join r q on l.doc_id = q.doc_id and l.sent = q.sent and q.a = l.b + 3 where l.w[l.b + 1] = 'of' and l.w[l.b + 2] = 'the')
        select anaphor, antecedent, count(*) as cnt from x group by all
    """,
    "noun_compounds": f"with {TOK}, y as (select *, lead(token) over (partition by doc_id, sent order by pos) as nxt from t) select lower(nxt) as anaphor, lower(token) as antecedent, count(*) as cnt from y where nxt is not null and lower(token) not in ({CLOSED}) and lower(nxt) not in ({CLOSED}) group by all",
    "pair_count_cube": f"with {EXT} select anaphor, antecedent, cast(sum(cnt) as bigint) as cnt from k where pattern not like '%,%' group by all",
    "tfidf_top15": f"""
        with {TOK}, n as (select doc_id, lower(token) as token, count(*) as cnt from t where token <> ',' group by all),
        d as (select *, sum(cnt) over (partition by doc_id) as total, count(*) over (partition by token) as df, (select count(distinct doc_id) from n) as docs from n),
        sc as (select *, round(cnt / total * ln(docs / df), 9) as score from d)
        select doc_id, token, cnt, df, score, cast(row_number() over (partition by doc_id order by score desc, token) as int) as "rank" from sc qualify "rank" <= 15
    """,
    "mentions_noun_runs": f"with {TALK} select doc, sent, cast(\"start\" as int) as \"start\", cast(\"end\" as int) as \"end\", head, array_to_string(toks, '_') as phrase from mm",
    "backward_search": f"with {SEARCH} select * from best",
    "candidate_window": f"""
        with {TALK} select a.doc, a.ment as anaphor, count(*) as n, cast(sum(a.sent - b.sent) as bigint) as earlier from mm a join mm b on a.doc = b.doc
        and (b.sent = a.sent and b."end" < a."start" or b.sent = a.sent - 1 and b.sent >= 1) group by all
    """,
    "possible_anaphors": f"""
        with {TALK}, x as (select *, array_to_string(toks, ' ') as txt from mm)
        select doc, ment from x where lower(head) not in ({PRONOUN_HEADS}) and not list_has_any(toks, [{COMPARATIVES}])
        and not exists (select 1 from x y where y.doc = x.doc and y.sent = x.sent and y.txt <> x.txt and contains(x.txt, y.txt))
    """,
    "previous_mentions": f"""
        with {TALK}, x as (
            select *, cast(rank() over (partition by doc, toks order by sent, "start", "end") - 1 as int) as same_text, cast(rank() over (partition by doc, head order by sent, "start", "end") - 1 as int) as same_head,
            row_number() over (partition by doc order by sent, "start", "end") = 1 as doc_first, "start" = min("start") over (partition by doc, sent) as sent_first from mm)
        select doc, ment, doc_first, sent_first, same_text, same_head, same_text > 0 as fullprevment, case when same_text <= 2 then cast(same_text as varchar) else 'many' end as fullprevtime,
            same_head > 0 as partialpre, case when same_head <= 2 then cast(same_head as varchar) else 'many' end as partialtime from x
    """,
    "mention_features": f"""
        with {TALK}, x as (select *, len(toks) as n, toks[1 : greatest(list_position(toks, head) - 1, 0)] as pre from mm)
        select doc, ment, cast(case when n <= 2 then n when n <= 7 then 4 when n <= 14 then 5 else 6 end as int) as len_anaphor,
            len(list_filter(toks, lambda z: lower(z) in ('the', 'that', 'this', 'those', 'these', 'one'))) > 0 as definite,
            case when toks[1] in ('the', 'that', 'this', 'those', 'these', 'one') then 'def' when toks[1] in ('a', 'an', 'some') then 'indef' else 'no_det' end as determiner_first,
            case when list_has_any(pre, ['my', 'your', 'his', 'her', 'our', 'their', 'its']) then 'pos_pro' when list_has_any(pre, ['the']) then 'def' when list_has_any(pre, [{INDEFINITE}]) then 'indef' when list_has_any(pre, ['that', 'this', 'those', 'these']) then 'demon' else 'no_det' end as determiner,
            not list_has_any(toks, [{COMPARATIVES}]) as no_premod_comp, list_has_any(toks, [{SPATIAL_TEMPORAL}]) as spatial_temporal_mod, regexp_matches(head, '^[0-9]{{4}}$') as is_year,
            list_has_any(pre, ['all', 'no', 'neither', 'every', 'any', 'most']) as premod_gen_quant,
            head in ('one', 'some', 'none', 'many', 'most', {INDEFINITE}, {NUMBERS}) or list_has_any(pre, ['each', 'one']) as set_element from x
    """,
    "between_mentions": f"""
        with {SEARCH} select best.doc, best.anaphor, best.antecedent, cast(count(x.ment) as int) as n_between from best
        join mm a on a.doc = best.doc and a.ment = best.anaphor join mm t on t.doc = best.doc and t.ment = best.antecedent
        left join mm x on x.doc = best.doc and x.ment <> a.ment and x.ment <> t.ment and (x.sent > t.sent and x.sent < a.sent or x.sent = t.sent and x."start" > t."end" and (x.sent < a.sent or x."end" < a."start") or x.sent = a.sent and x.sent > t.sent and x."end" < a."start")
        group by all
    """,
    "negative_pairs": f"""
        with {SEARCH}, pr as (
            select best.doc, best.anaphor, best.antecedent, list(x.ment order by x.sent, x."start", x.ment) as b, count(*) as n from best
            join mm a on a.doc = best.doc and a.ment = best.anaphor join mm t on t.doc = best.doc and t.ment = best.antecedent
            join mm x on x.doc = best.doc and x.ment <> a.ment and x.ment <> t.ment and (x.sent > t.sent and x.sent < a.sent or x.sent = t.sent and x."start" > t."end" and (x.sent < a.sent or x."end" < a."start") or x.sent = a.sent and x.sent > t.sent and x."end" < a."start")
            group by all),
        hs as (select *, list_transform(range(4), lambda j: cast('0x' || md5(concat_ws('|', doc, anaphor, antecedent, j))[1:8] as bigint)) as h from pr where n >= 4),
        d2 as (select *, h[1] % n as i0, h[2] % (n - 1) + cast(h[2] % (n - 1) >= h[1] % n as int) as i1 from hs),
        d3 as (select *, list_reduce(list_prepend(h[3] % (n - 2), list_sort([i0, i1])), lambda x, c: x + cast(x >= c as int)) as i2 from d2),
        d4 as (select *, list_reduce(list_prepend(h[4] % (n - 3), list_sort([i0, i1, i2])), lambda x, c: x + cast(x >= c as int)) as i3 from d3)
        select doc, anaphor, b[1] as antecedent from pr where n = 1 union all select doc, b[2], b[1] from pr where n = 2
        union all select doc, b[1], antecedent from pr where n = 3 union all select doc, b[3], b[2] from pr where n = 3
        union all select doc, b[i0 + 1], b[i1 + 1] from d4 union all select doc, b[i2 + 1], b[i3 + 1] from d4
    """,
    "score_prf": """
        with g as (select doc_id from labels where quality = 1), s as (select doc_id from labels where toxic = 1),
        n as (select (select count(*) from s join g using (doc_id)) as c, (select count(*) from g) as g, (select count(*) from s) as s),
        r as (select c, g, s, coalesce(c / nullif(s, 0), 0) as p, coalesce(c / nullif(g, 0), 0) as q from n)
        select c as correct, g as n_gold, s as n_system, s as n_system_anaphors, round(p, 9) as link_precision, round(q, 9) as link_recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) as link_f1,
            round(p, 9) as anaphor_precision, round(q, 9) as anaphor_recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) as anaphor_f1 from r
    """,
    "lexicon_coverage": f"""
        with {EXT}, gd as (select distinct anaphor, antecedent from k where pattern = '<Y> of <X>'), l as (select distinct anaphor, antecedent from k where pattern = '<Y> in <X>'),
        n as (select (select count(distinct anaphor) from gd where anaphor in (select anaphor from l)) as af, (select count(distinct anaphor) from gd) as ag,
            (select count(distinct antecedent) from gd where antecedent in (select antecedent from l)) as tf, (select count(distinct antecedent) from gd) as tg,
            (select count(*) from gd semi join l using (anaphor, antecedent)) as pf, (select count(*) from gd) as pg)
        select af as anaphor_found, ag as anaphor_gold, round(coalesce(af / nullif(ag, 0), 0), 9) as anaphor_coverage, tf as antecedent_found, tg as antecedent_gold, round(coalesce(tf / nullif(tg, 0), 0), 9) as antecedent_coverage,
            pf as pair_found, pg as pair_gold, round(coalesce(pf / nullif(pg, 0), 0), 9) as pair_coverage from n
    """,
    "cv_folds": "select doc_id as doc_ord, cast(floor(doc_id / 5) as int) as fold from documents",
    "hypernym_closure": f"with recursive {GEO} select word, synset, cast(depth as int) as depth from up",
    "generalise": f"""
        with recursive {GEO}, n as (select synset, word, count(*) as cnt from up group by all),
        cand as (select synset, count(*) as c from (select *, row_number() over (partition by word order by depth desc, synset desc) as rn from (select word, synset, min(depth) as depth from up where depth > 0 group by all)) where rn <= 7 group by synset order by c desc, synset limit 150),
        sh as (select word, synset, cnt / sum(cnt) over (partition by synset) as score from n where synset in (select synset from cand))
        select word, synset, round(score, 9) as score from sh qualify row_number() over (partition by word order by score desc, synset desc) = 1
    """,
    "json_counts": "select event_type, k as key, count(*) as n, cast(sum(cast(json_extract_string(props, '$.' || k) as bigint)) as bigint) as total from (select event_type, props, unnest(json_keys(props)) as k from events) group by all",
    "coref_exact": f"""
        with {TALK}, x as (select *, array_to_string(toks, ' ') as txt from mm)
        select doc, txt as text, count(*) as size, cast(arg_min(sent, (sent, "start")) as bigint) as first_sent, cast(arg_min("start", (sent, "start")) as int) as first_start from x group by doc, txt having count(*) > 1
    """,
    "constituents": f"""
        with {NODES}, n as (
            select doc, sent, 1 as node, null as parent, 'S' as label, 1 as depth, 0 as s, len(w) - 1 as e, false as leaf, array_to_string(w, ' ') as text from w where len(w) > 0
            union all select np.doc, np.sent, node, 1, 'NP', 2, np.a - 1, np.b - 1, false, array_to_string(r.w[np.a : np.b], ' ') from np join r on np.doc = r.doc and np.sent = r.sent and np.a = r.a
            union all select doc, sent, node, coalesce(parent, 1), case when parent is null then 'XX' else 'NN' end, case when parent is null then 2 else 3 end, pos - 1, pos - 1, true, token from lf)
        select doc, sent, cast(node as int) as node, cast(coalesce(parent, 0) as int) as parent, label, cast(depth as int) as depth, cast(s as int) as "start", cast(e as int) as "end", leaf, text from n
    """,
    "name_spans": f"with {NODES} select doc, sent, cast(pos - 1 as int) as word_idx, case when parent is null then '*' else 'RUN' end as name from lf",
    "phrase_heads": f"""
        with {NODES} select doc, sent, cast(node as int) as node, (select arg_max(r.head, r.a) from r where r.doc = np.doc and r.sent = np.sent and r.a = np.a) as head from np
        union all select doc, sent, 1, coalesce((select arg_max(r.head, r.a) from r where r.doc = w.doc and r.sent = w.sent), w[len(w)]) from w where len(w) > 0
    """,
    "seed_patterns": f"""
        with {EXT}, b as (select doc_id, sent, w, anaphor, antecedent from w join seed on list_contains(w, anaphor) and list_contains(w, antecedent)),
        q as (select *, list_position(w, anaphor) as a1, list_position(w, antecedent) as t1, len(w) + 1 - list_position(list_reverse(w), anaphor) as a2, len(w) + 1 - list_position(list_reverse(w), antecedent) as t2 from b),
        f as (
            select anaphor, antecedent, array_to_string(list_concat(['<X>'], w[a1 + 1 : t2 - 1], ['<Y>']), ' ') as pattern from q where t2 > a1
            union all select anaphor, antecedent, array_to_string(list_concat(['<Y>'], w[t1 + 1 : a2 - 1], ['<X>']), ' ') from q where a2 > t1)
        select pattern, anaphor, antecedent, count(*) as cnt from f group by all
    """,
    "coref_pass_exact": f"with {CLUSTERS} select doc, ment, cast(coalesce(cluster, 0) as int) as cluster, first from cl",
    "cluster_column": f"""
        with {CLUSTERS} select doc, sent, cast("start" as int) as word_idx, case when "start" = "end" then '(' || id || ')' else '(' || id end as new_coref from nw
        union all select doc, sent, cast("end" as int), id || ')' from nw where "start" < "end"
    """,
    "coref_column_spans": f"""
        with {CLUSTERS}, o as (select *, min("start") over (partition by doc, sent, id) as first_open from nw)
        select doc, sent, cast("start" as int) as "start", cast("end" as int) as "end", cast(id as int) as chain, cast(row_number() over (partition by doc, sent order by first_open, "start" desc) as int) as k from o
    """,
    "gold_chains": f"with {CLUSTERS} select doc, cast(cluster as int) as chain, string_agg(ment, ',' order by sent, \"start\") as members from cl where cluster is not null group by all",
    "anaphor_features": f"""
        with {CLUSTERS}, {LEX},
        h as (select head as h, count(*) as n from mm group by head),
        tk as (select doc, ment, sent, "start", unnest(list_distinct(toks)) as tok from mm),
        fp as (select doc, tok, min((sent, "start")) as place from tk group by all),
        seen as (select distinct tk.doc, tk.ment from tk join fp on tk.doc = fp.doc and tk.tok = fp.tok where place < (sent, "start")),
        land as (select list(h) as l from h where n > 5 and regexp_matches(h, '^\\p{{Lu}}')),
        sw as (select doc, sent, list_contains(w, 'if') as i, list_has_any(w, ['can', 'will', 'must', 'would', 'may']) as md from w),
        x as (
            select cl.*, toks[1 : greatest(list_position(toks, cl.head) - 1, 0)] as pre, len(toks) as n_toks, regexp_matches(cl.head, '^\\p{{Lu}}') as name, length(cl.head) as letters, h.n as heads,
                cast(rank() over (partition by cl.doc, toks order by cl.sent, "start") - 1 as int) as same_text, cast(rank() over (partition by cl.doc, cl.head order by cl.sent, "start") - 1 as int) as same_head,
                row_number() over (partition by cl.doc order by cl.sent, "start") = 1 as doc_first, "start" = min("start") over (partition by cl.doc, cl.sent) as sent_first
            from cl join h on h.h = cl.head)
        select x.doc, x.ment, len(list_filter(toks, lambda z: lower(z) in ('the', 'that', 'this', 'those', 'these', 'one'))) > 0 as definite,
            case when list_has_any(pre, ['my', 'your', 'his', 'her', 'our', 'their', 'its']) then 'pos_pro' when list_has_any(pre, ['the']) then 'def' when list_has_any(pre, [{INDEFINITE}]) then 'indef' when list_has_any(pre, ['that', 'this', 'those', 'these']) then 'demon' else 'no_det' end as determiner,
            cast(case when n_toks <= 2 then n_toks when n_toks <= 7 then 4 when n_toks <= 14 then 5 else 6 end as int) as len_anaphor, list_has_any(toks, [{SPATIAL_TEMPORAL}]) as spatial_temporal_mod, not list_has_any(toks, [{COMPARATIVES}]) as no_premod_comp,
            head in ('one', 'some', 'none', 'many', 'most', {INDEFINITE}, {NUMBERS}) or list_has_any(pre, ['each', 'one']) as set_element, list_has_any(pre, ['all', 'no', 'neither', 'every', 'any', 'most']) as premod_gen_quant, regexp_matches(head, '^[0-9]{{4}}$') as is_year,
            false as anaphor_pp, case when name then 'proper' else 'common' end as np_type, case when not name and ends_with(head, 's') then 'plural' else 'sing' end as np_num,
            sent_first, doc_first, same_text > 0 as fullprevment, case when same_text <= 2 then cast(same_text as varchar) else 'many' end as fullprevtime, same_head > 0 as partialpre, case when same_head <= 2 then cast(same_head as varchar) else 'many' end as partialtime,
            seen.ment is not null as contentpre, false as has_child, false as is_child, cast(case when cluster is null then 0 else size end as int) as gold_chain_len,
            cluster is null and not list_has_any(toks, [{COMPARATIVES}]) and len(list_filter(toks, lambda z: regexp_matches(z, '^\\p{{Lu}}'))) = 0 as coherence_gap,
            list_has_any(pre, land.l) as premod_countries, letters = 4 as building_parts, letters = 5 as inq_roles, head in (select anaphor from lx) as wordnet_relational,
            case letters when 3 then 'RelPer' when 6 then 'RolePer' when 7 then 'PERSON' when 8 then 'ORG' when 9 then 'LOC' else 'NA' end as sem_category, sw.i as ifclause, sw.md as modalpresent, heads > 3 as arg_ratio, 'na' as gram_category,
            array_to_string(list_sort(list_distinct(toks)), ' ') as unigrams
        from x cross join land join sw on sw.doc = x.doc and sw.sent = x.sent left join seen on seen.doc = x.doc and seen.ment = x.ment
    """,
    "pair_features": f"""
        with {TALK}, {LEX},
        kn as (select distinct anaphor[1:3] as ga, antecedent[1:3] as gt from lx where length(anaphor) > 3 and length(antecedent) > 3),
        ft as (select doc, unnest(toks) as token from mm), fn as (select doc, token, count(*) as cnt from ft group by all),
        fd as (select *, sum(cnt) over (partition by doc) as total, count(*) over (partition by token) as df, (select count(distinct doc) from fn) as docs from fn),
        tp as (select doc, token from fd qualify row_number() over (partition by doc order by round(cnt / total * ln(docs / df), 9) desc, token) <= 15),
        tops as (select doc, list(token) as tops from tp group by doc),
        pr as (
            select a.doc, a.ment as anaphor, b.ment as antecedent, a.head as ah, b.head as th, a.toks as ta, b.toks as tt, a.toks[1 : greatest(list_position(a.toks, a.head) - 1, 0)] as pre
            from mm a join mm b on a.doc = b.doc and (b.sent = a.sent and b."end" < a."start" or b.sent = a.sent - 1 and b.sent >= 1)),
        pf as (select pr.*, list_has_any(tt, tops) as ti, lx.anaphor is not null as known from pr join tops using (doc) left join lx on lx.anaphor = ah and lx.antecedent = th)
        select doc, anaphor, antecedent, known as pair_in_resource, length(ah) > 3 and length(th) > 3 and (ah[1:3], th[1:3]) in (select (ga, gt) from kn) as generalized_resource,
            known and length(ah) % 3 <> 0 as meronym, case when ah = th then 'really_high' when ah[1:2] = th[1:2] then 'higher' when ah[1:1] = th[1:1] then 'high' else 'low' end as wn_dist,
            ti as tfidf_ante, ti and ah in (select anaphor from lx) as ante_tfidf_anap_resource,
            len(list_filter(ta, lambda z: ends_with(z, 'in') and not regexp_matches(z, '^\\p{{Lu}}'))) > 0 as anaphor_pp,
            len(list_filter(ta, lambda z: lower(z) in ({SMALL_NUMBERS}))) > 0 and ends_with(th, 's') and not regexp_matches(th, '^\\p{{Lu}}') as number_plural,
            case when regexp_matches(th, '^\\p{{Lu}}') then 'NAME-' else '*-' end || ah as ante_ne_anap_head, len(list_filter(ta, lambda z: lower(z) in ({DEFINITE}))) > 0 as definite,
            case when ta[1] in ({DEFINITE}) then 'def' when ta[1] in ({INDEFINITE_FIRST}) then 'indef' else 'no_det' end as determiner,
            cast(case when len(ta) <= 2 then len(ta) when len(ta) <= 7 then 4 when len(ta) <= 14 then 5 else 6 end as int) as len_anaphor,
            cast(case when len(tt) <= 2 then len(tt) when len(tt) <= 7 then 4 when len(tt) <= 14 then 5 else 6 end as int) as len_antecedent,
            list_contains(tt, ah) and ah <> th as anaphor_head_in_ante, list_contains(pre, lower(th)) as ante_head_in_anaphor, ah = th as same_head
        from pf
    """,
    "cosine_match": "select s.vec_id as seed, e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(s.embedding as double[])), 6) as cosine from embeddings e join embeddings s on e.vec_id > s.vec_id where round(list_cosine_similarity(cast(e.embedding as double[]), cast(s.embedding as double[])), 6) >= 0.3",
}
