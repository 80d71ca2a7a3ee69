"""DuckDB SQL of the resolver's stages over the driver's tables, as one chain of common table expressions.

The fuzzy ratios are Indel ratios by a bit-parallel longest common subsequence over whole texts: a text's bit vector is a list of words
of WORD bits, and the carry of each word's sum goes on to the next. The attachment fold is a recursion over each case's edges in order.
"""

from __future__ import annotations

from evidentia import config as C


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _folded(x: str) -> str:
    return f"lower({_strip(x)})"


def _norm(x: str) -> str:
    return f"regexp_replace({_folded(x)}, '[^a-z0-9_]', '_', 'g')"


ROLE = "case role when 'user' then 'suspect' when 'assistant' then 'witness' else role end"
MODALITY = "(['video', 'audio', 'text'])[1 + ({0}) % 3]"
PLACE = "(['ATM booth entrance', 'atm booth interior', 'Server room 3', ''])[1 + ({0}) % 4]"


#: name -> SQL; each may read the earlier ones.
CHAIN: dict[str, str] = {
    "raw_conv": f"""
        select cast(conv_id as varchar) case_id, cast(turn * 2 + again as bigint) ord, case when again = 1 then 'R' else 'O' end || turn obs_id,
            case when turn % 4 < 2 then {ROLE} || ' ' || (conv_id % 5) else 'Speaker_' || chr(65 + cast(turn % 3 as int)) end entity, {ROLE} as role,
            {MODALITY.format('turn + conv_id + again')} modality, {PLACE.format('turn + conv_id')} as location, coalesce(text, '') content,
            strftime(make_timestamp((1705312800 + turn * 40 + again * 20) * 1000000), '%Y-%m-%dT%H:%M:%S') "timestamp",
            cast((conv_id * 7 + turn * 13 + again * 29) % 100 / 100.0::double as varchar) confidence
        from conversations, (values (0), (1)) t(again) where again = 0 or (turn + conv_id) % 4 = 0""",
    "raw_event": f"""
        select strftime(ts, '%Y-%m-%d') case_id, cast(event_id as bigint) ord, case when event_id % 97 <> 0 then 'E' || event_id end obs_id,
            'User ' || (user_id % 40) entity, case when event_type in ('click', 'view') then 'suspect' else 'witness' end as role,
            {MODALITY.format('event_id')} modality, {PLACE.format('user_id')} as location, 'saw ' || event_type content,
            case when event_id % 41 = 0 then 'unknown' when event_id % 43 = 0 then strftime(ts, '%Y-%m-%d %H:%M:00') else strftime(ts, '%Y-%m-%dT%H:%M:00Z') end "timestamp",
            case when event_id % 89 = 0 then 'high' when event_id % 83 <> 0 then cast(floor(value) / 100.0::double as varchar) end confidence
        from events""",
}


def _stages(kind: str) -> dict[str, str]:
    epoch = r"""coalesce(epoch(coalesce(
        try_strptime(case when regexp_matches("timestamp", '^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z?$') then replace("timestamp", 'Z', '') end, '%Y-%m-%dT%H:%M:%S'),
        try_strptime(case when regexp_matches("timestamp", '^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$') then "timestamp" end, '%Y-%m-%d %H:%M:%S'))), 0.0)"""
    return {
        "clean": f"""
            select case_id, ord, obs_id, entity, coalesce(role, 'unknown') as role, coalesce(modality, 'unknown') modality, coalesce(location, '') as location, coalesce(content, '') content,
                coalesce("timestamp", '') "timestamp", greatest(0.0, least(1.0, coalesce(try_cast(trim(confidence) as double), 0.5))) confidence
            from raw_{kind} where obs_id is not null and entity is not null and (confidence is null or try_cast(trim(confidence) as double) is not null)""",
        "marked": """select *, sha256(entity || '|' || modality || '|' || location || '|' || content || '|' || "timestamp") fp from clean""",
        "once": """
            select * exclude (ord, fp, rk, first_ord), first_ord ord from (
                select *, row_number() over (partition by case_id, fp order by confidence desc, ord) rk, min(ord) over (partition by case_id, fp) first_ord from marked) where rk = 1""",
        "distinct_obs": "select * exclude (rk) from (select *, row_number() over (partition by case_id, obs_id order by ord desc) rk from once) where rk = 1",
        "timed": f"select *, {_norm('entity')} entity_norm, {epoch} ts_epoch from distinct_obs",
        "obs": """
            select *, case when ts_epoch > 0 then cast(ts_epoch - min(case when ts_epoch > 0 then ts_epoch end) over (partition by case_id) as bigint) else 0 end time_offset_sec from timed""",
    }


def _sides() -> str:
    cols = "ord obs_id entity entity_norm role modality location content confidence time_offset_sec".split()
    return ", ".join(f"{s}.{c} {c}_{s}" for s in "ab" for c in cols)


GAP = "abs(time_offset_sec_a - time_offset_sec_b)"
LA, LB = _folded("location_a"), _folded("location_b")
SAME_PLACE = f"({LA} <> '' and {LA} = {LB})"
SAME_ROLE = f"({_folded('role_a')} = {_folded('role_b')})"
CROSS = "(lower(modality_a) <> lower(modality_b))"


def _tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')))"


#: Bits of a word of a longest common subsequence's vector: the sum of two and a carry fits a signed 128-bit integer.
WORD = 120


def _lcs_table(name: str, source: str) -> dict[str, str]:
    """Tables that give lcs for each pair (x, y) of `source`: the masks of x's characters are made once for each pair and character of y."""
    full = f"((1::hugeint << {WORD}) - 1)"
    words = f"range((length({{0}}) + {WORD - 1}) // {WORD})"
    total = "(e.v + (e.v & e.m) + a.c)"
    one = "{{'v': {0}, 'm': {1}, 'c': 0::hugeint, 'o': []::hugeint[]}}"
    # a character's step over the words of v: sums with carry, and the new words in o
    step = f"""list_reduce(list_concat([{one.format('0::hugeint', '0::hugeint')}], list_transform(range(1, len(v) + 1), lambda k: {one.format('v[k]', 'm[k]')})),
        lambda a, e: {{'v': 0::hugeint, 'm': 0::hugeint, 'c': {total} >> {WORD}, 'o': list_append(a.o, ({total} & {full}) | (e.v - (e.v & e.m)))}}).o"""
    return {
        f"{name}_c": f"select x, y, unnest(regexp_extract_all(y, '(?s).')) c, unnest(range(length(y))) j from {source}",
        f"{name}_u": f"select distinct x, c from {name}_c",
        f"{name}_p": f"select x, c, w, sum(1::hugeint << (i % {WORD})::int)::hugeint m from (select u.x, u.c, i // {WORD} w, i from {name}_u u, unnest(range(length(u.x))) t(i) where substring(u.x, (i + 1)::bigint, 1) = u.c) group by 1, 2, 3",
        f"{name}_w": f"select x, c, list_transform({words.format('x')}, lambda k: coalesce(map_from_entries(list((w, m)))[k], 0::hugeint)) m from {name}_p group by 1, 2",
        f"{name}_m": f"select a.x, a.y, list(coalesce(p.m, list_transform({words.format('a.x')}, lambda k: 0::hugeint)) order by a.j) ms from {name}_c a left join {name}_w p on a.x = p.x and a.c = p.c group by 1, 2",
        name: f"""
            select x, y, (length(x) - list_sum(list_transform({words.format('x')}, lambda k: bit_count(z[k + 1] & ((1::hugeint << least({WORD}, length(x) - k * {WORD})::int) - 1)))))::bigint l
            from (select x, y, list_reduce(list_concat([list_transform({words.format('x')}, lambda k: {full})], ms), lambda v, m: {step}) z from {name}_m where length(x) > 0)""",
    }


def _ratios() -> dict[str, str]:
    """set_ratio(s, t, r) of all pairs of texts in need, and lex(s, t, r) of aliases."""
    out = {
        "need": f"""
            select distinct s, t from (
                select {LA} s, {LB} t from pairs union all select content_a, content_b from pairs
                union all select least(substring(content_a, 1, 120), substring(content_b, 1, 120)), greatest(substring(content_a, 1, 120), substring(content_b, 1, 120)) from pairs)""",
        "toks": f"select s, t, {_tokens('s')} p, {_tokens('t')} q from need",
        "parts": """
            select s, t, p, q, list_intersect(p, q) b, array_to_string(list_filter(p, lambda u: not list_contains(q, u)), ' ') x,
                array_to_string(list_filter(q, lambda u: not list_contains(p, u)), ' ') y from toks""",
        "diff": "select distinct x, y from parts where length(x) > 0 and length(y) > 0",
        **_lcs_table("lcs1", "diff"),
        "sized": """
            select p.s, p.t, len(p.p) np, len(p.q) nq, len(p.b) nb, length(p.x) lx, length(p.y) ly, coalesce(l.l, 0) l, length(array_to_string(p.b, ' ')) sl,
                case when len(p.b) > 0 then 1 else 0 end g from parts p left join lcs1 l on p.x = l.x and p.y = l.y""",
        "set_ratio": """
            select s, t, case when np = 0 or nq = 0 then 0.0::double when nb > 0 and (lx = 0 or ly = 0) then 1.0::double
                when nb = 0 then 1.0::double - (lx + ly - 2 * l) / (lx + ly)::double
                else greatest(1.0::double - (lx + ly - 2 * l) / (2 * (sl + g) + lx + ly)::double, 1.0::double - (g + lx) / (2 * sl + g + lx)::double, 1.0::double - (g + ly) / (2 * sl + g + ly)::double) end r from sized""",
        "lex_need": "select distinct entity_norm_a x, entity_norm_b y from pairs where length(entity_norm_a) > 0 and length(entity_norm_b) > 0",
        **_lcs_table("lcs2", "lex_need"),
        "lex": "select x s, y t, 1.0::double - (length(x) + length(y) - 2 * l) / (length(x) + length(y))::double r from lcs2",
    }
    return out


def _features(cap: int = 500) -> dict[str, str]:
    words = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
    any_ = lambda x, of: f"list_has_any({x}, {_list(of)})"
    acts = lambda x: f"list_intersect(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), {_list(C.ACTIONS)})"
    opposed = " or ".join(f"(list_contains(aa, '{p}') and list_contains(ab, '{q}')) or (list_contains(aa, '{q}') and list_contains(ab, '{p}'))" for p, q in C.OPPOSITES)
    phase = lambda x: f"case when {any_(x, C.EXITING)} then 'exit' when {any_(x, C.ENTERING)} then 'inside' when {any_(x, C.APPROACHING)} then 'approach' else 'other' end"
    d = "::double"
    same_loc = f"(location_a <> '' and location_b <> '' and {LA} = {LB})"
    inter = " ".join(f"when least(lower(modality_a), lower(modality_b)) = '{p}' and greatest(lower(modality_a), lower(modality_b)) = '{q}' then {v}{d}" for (p, q), v in C.MODALITY_PAIRS.items())
    roles = " or ".join(f"(lower(role_a) = '{p}' and lower(role_b) = '{q}') or (lower(role_a) = '{q}' and lower(role_b) = '{p}')" for p, q in C.OPPOSED_ROLES)
    coref = f"""(case when {CROSS} then 0.45{d} else 0.32{d} end) + (case when gap <= 300 then 0.25{d} else 0.10{d} end)
        + (case when {LA} <> '' and {LB} <> '' and location_ratio >= 0.45 then 0.10{d} else 0.0{d} end)
        + (case when {LA} <> '' and {LB} <> '' and len(list_intersect(list_intersect({words(LA)}, {words(LB)}), {_list(C.PLACES)})) > 0 then 0.08{d} else 0.0{d} end)
        + (case when content_ratio >= 0.35 then 0.08{d} else 0.0{d} end)
        + (case when topical > 0 then least(0.14{d}, 0.05{d} * topical) else 0.0{d} end)
        + (case when ({any_('ca', C.ENTERING)} and {any_('cb', C.ENTERING)}) or ({any_('ca', C.EXITING)} and {any_('cb', C.EXITING)}) then 0.10{d} else 0.0{d} end)
        + (case when gap <= 300 and {phase('ca')} = {phase('cb')} and {phase('ca')} <> 'other' then 0.08{d} else 0.0{d} end)"""
    total = " + ".join(f"{C.WEIGHTS[f]}{d} * {f}" for f in C.FEATURES)
    total = f"0.0{d} + {total}"
    reasons = "list_filter([" + ", ".join(f"case when {f} > 0.5 then '{f}' end" for f in C.FEATURES) + "], lambda x: x is not null)"
    return {
        "joined": f"""
            select p.*, {GAP} gap, l.r location_ratio, c.r content_ratio, k.r context_ratio, x.r lexical, {words('content_a')} ca, {words('content_b')} cb, {acts('substring(content_a, 1, 120)')} aa, {acts('substring(content_b, 1, 120)')} ab
            from pairs p join set_ratio l on l.s = {LA} and l.t = {LB} join set_ratio c on c.s = content_a and c.t = content_b
            join set_ratio k on k.s = least(substring(content_a, 1, 120), substring(content_b, 1, 120)) and k.t = greatest(substring(content_a, 1, 120), substring(content_b, 1, 120))
            join lex x on x.s = entity_norm_a and x.t = entity_norm_b""",
        "prepared": f"select *, len(list_intersect(list_intersect(ca, cb), {_list(C.TOPICAL)})) topical, case when {opposed} then 0.5{d} else 1.0{d} end penalty from joined",
        "features": f"""
            select case_id, ord_a, ord_b, obs_id_1, obs_id_2, obs_id_a, obs_id_b, entity_norm_a, entity_norm_b, role_a, role_b, confidence_a, confidence_b, gap, penalty, location_ratio, content_ratio,
                case when entity_norm_a = entity_norm_b then 1.0{d} when not {SAME_ROLE} then 0.12{d} when gap > 3600 then 0.05{d} else least(1.0{d}, {coref}) end entity_coreference,
                case when modality_a = modality_b then case when entity_norm_a = entity_norm_b then case when gap <= 300 and {same_loc} then 0.85{d} when gap <= 3600 then 0.45{d} else 0.20{d} end else 0.30{d} end
                    when gap <= 300 then 0.78{d} when gap <= 3600 then 0.42{d} else 0.10{d} end mention_consistency,
                case when gap > 3600 then 0.0{d} when gap <= 300 then 1.0{d} - gap / 300.0{d} else 0.3{d} * (1.0{d} - (gap - 300.0{d}) / 3300.0{d}) end as temporal,
                case when {LA} = '' or {LB} = '' then 0.35{d} when {LA} = {LB} then 1.0{d} else location_ratio end as location,
                greatest(0.0{d}, least(1.0{d}, context_ratio * penalty * penalty)) context, lexical,
                case when {roles} then 0.55{d} * (case {inter} else 0.30{d} end) else (case {inter} else 0.30{d} end) end interaction,
                case when {CROSS} then 0.82{d} else 0.40{d} end modality
            from prepared""",
        "scored": f"select *, least(1.0{d}, {total}) weight, {reasons} reasons from features",
        "classed": "select *, case when weight >= 0.8 then 'confirmed' when weight >= 0.65 then 'likely' when weight >= 0.5 then 'possible' else 'rejected' end classification from scored",
        "edges": f"""
            select *, case when obs_id_1 = obs_id_a then entity_norm_a else entity_norm_b end alias_1, case when obs_id_1 = obs_id_a then entity_norm_b else entity_norm_a end alias_2,
                (classification = 'confirmed' or (classification <> 'rejected' and gap <= 3600 and weight >= 0.55
                    and (entity_norm_a = entity_norm_b or ({SAME_ROLE} and entity_coreference >= 0.58)))) merges
            from classed""",
    }


def _clusters() -> dict[str, str]:
    return {
        "links": "select case_id, ord_a a, ord_b b from edges where merges union select case_id, ord_b, ord_a from edges where merges",
        "reach": "select case_id, ord a, ord b from obs union select r.case_id, r.a, l.b from reach r join links l on l.case_id = r.case_id and l.a = r.b",
        "component": "select o.case_id, o.obs_id, o.ord, min(r.b) component from obs o join reach r on r.case_id = o.case_id and r.a = o.ord group by 1, 2, 3",
        "clusters": """
            select case_id, 'C' || dense_rank() over (partition by case_id order by component) cluster_id, obs_id,
                row_number() over (partition by case_id, component order by obs_id) member_ord from component""",
    }


def _fold(threshold: float = 0.7) -> dict[str, str]:
    """Likely and possible edges folded over each case's clusters in order: members afterwards, and mentions; of(x): the state's entry of an observation."""
    of = lambda x: f"list_filter(s, lambda e: e.o = {x})[1].c"
    size = lambda c: f"len(list_filter(s, lambda e: e.c = {c}))"
    return {
        "fold_edges": "select case_id, obs_id_1 o1, obs_id_2 o2, alias_1, alias_2, weight, reasons, row_number() over (partition by case_id order by obs_id_1, obs_id_2) n from edges where classification in ('likely', 'possible')",
        "fold": f"""
            select case_id, 0::bigint n, list({{'o': obs_id, 'c': cluster_id, 'r': member_ord::bigint}}) s, null::varchar o1, null::varchar o2, null::varchar a1, null::varchar a2, null::double w, null::varchar[] reasons, false single1, false single2 from clusters group by 1
            union all
            select case_id, n, list_transform(s, lambda e: case when e.o = o1 and single1 and w >= {threshold}::double then {{'o': e.o, 'c': c2, 'r': 1000000 + 2 * n}}
                    when e.o = o2 and single2 and w >= {threshold}::double then {{'o': e.o, 'c': case when single1 then c2 else c1 end, 'r': 1000001 + 2 * n}} else e end) s, o1, o2, a1, a2, w, reasons, single1, single2
            from (select *, {size('c1')} = 1 single1, {size('c2')} = 1 single2 from (
                select f.case_id, e.n, s, e.o1, e.o2, e.alias_1 a1, e.alias_2 a2, e.weight w, e.reasons, {of('e.o1')} c1, {of('e.o2')} c2 from fold f join fold_edges e on e.case_id = f.case_id and e.n = f.n + 1))""",
        "members": """
            select case_id, x.c cluster_id, x.o obs_id, row_number() over (partition by case_id, x.c order by x.r) member_ord
            from (select case_id, unnest(s) x from fold qualify row_number() over (partition by case_id order by n desc) = 1)""",
        "mentions": f"""
            select case_id, obs_id, row_number() over (partition by case_id order by n, slot) - 1 mention_ord, candidate_alias, round(w, 4) score, reasons from (
                select case_id, n, w, reasons, 0 slot, o1 obs_id, a2 candidate_alias from fold where single1 and w < {threshold}::double
                union all select case_id, n, w, reasons, 1, o2, a1 from fold where single1 and w < {threshold}::double
                union all select case_id, n, w, reasons, 2, o2, a1 from fold where single2 and w < {threshold}::double
                union all select case_id, n, w, reasons, 3, o1, a2 from fold where single2 and w < {threshold}::double)""",
    }


def _entities() -> dict[str, str]:
    """What is packaged of members; lists are joined, so that they compare."""
    when = lambda f: f"coalesce(strftime(make_timestamp(cast({f}(case when ts_epoch > 0 then ts_epoch end) * 1000000 as bigint)), '%Y-%m-%dT%H:%M:%SZ'), '')"
    decimals = lambda x, n: f"cast(round(cast(cast({x} as varchar) as decimal(24, 14)), {n}) as decimal(24, {n}))"  # noqa: E731  half up, of the shortest digits
    return {
        "inside": """
            select e.case_id, c1.cluster_id, sum((confidence_a + confidence_b) / 2.0::double) tw, sum((confidence_a + confidence_b) / 2.0::double * weight) ws
            from edges e join members c1 on c1.case_id = e.case_id and c1.obs_id = obs_id_1 join members c2 on c2.case_id = e.case_id and c2.obs_id = obs_id_2
            where classification = 'confirmed' and c1.cluster_id = c2.cluster_id group by 1, 2""",
        "conf": """
            select c.case_id, c.cluster_id, count(*) size, case when count(*) > 1 and coalesce(any_value(tw), 0) > 0 then any_value(ws) / any_value(tw) else avg(confidence) end cluster_confidence
            from members c join obs using (case_id, obs_id) left join inside i on i.case_id = c.case_id and i.cluster_id = c.cluster_id group by 1, 2""",
        "seen": "select case_id, cluster_id, entity, count(*) n, min(member_ord) f from members join obs using (case_id, obs_id) group by 1, 2, 3",
        "named": "select case_id, cluster_id, array_to_string(list(entity order by f), '|') aliases, first(entity order by n desc, f) primary_alias, array_to_string(list(entity order by entity), '|') sorted_aliases from seen group by 1, 2",
        "rolled": f"""
            select case_id, cluster_id, count(*) total_mentions, array_to_string(list_sort(list(distinct modality)), '|') modalities,
                array_to_string(list_sort(coalesce(list(distinct location) filter (location <> ''), [])), '|') locations, array_to_string(list_sort(list(distinct role)), '|') roles, array_to_string(list_sort(list(distinct obs_id)), '|') sources,
                {when('min')} earliest_timestamp, {when('max')} latest_timestamp, coalesce(cast(max(case when ts_epoch > 0 then ts_epoch end) - min(case when ts_epoch > 0 then ts_epoch end) as bigint), 0) time_span_seconds
            from members join obs using (case_id, obs_id) group by 1, 2""",
        "ends": "select *, obs_id_1 obs_id from edges union all select *, obs_id_2 from edges",
        "hits": "select c.case_id, c.cluster_id, c.obs_id, e.obs_id_1, e.obs_id_2, e.alias_1, e.alias_2, e.classification, e.weight, e.reasons from ends e join members c on c.case_id = e.case_id and c.obs_id = e.obs_id",
        "touched": "select distinct on (case_id, cluster_id, obs_id_1, obs_id_2) * exclude (obs_id) from hits",
        "counted": """
            select case_id, cluster_id, count_if(classification = 'confirmed') confirmed_edges, count_if(classification in ('likely', 'possible')) candidate_edges, any_value(yes) confirmed_mentions
            from touched left join (select case_id, cluster_id, array_to_string(list_sort(list(distinct obs_id)), '|') yes from hits where classification = 'confirmed' group by 1, 2) using (case_id, cluster_id) group by 1, 2""",
        "mentioned": """
            select case_id, cluster_id, array_to_string(list(candidate_alias || ':' || round(score * 10000)::bigint || ':' || array_to_string(reasons, '+') order by member_ord, mention_ord), '|') candidate_mentions from (
                select m.*, c.cluster_id, c.member_ord from mentions m join members c using (case_id, obs_id)
                qualify row_number() over (partition by m.case_id, c.cluster_id, candidate_alias, round_even(score, 2) order by c.member_ord, mention_ord) = 1) group by 1, 2""",
        "edge_lists": """
            select case_id, cluster_id, count(*) n_edges, count_if(classification = 'rejected') n_rejected, count_if(classification in ('likely', 'possible')) n_candidate,
                array_to_string(list(alias_1 || '~' || alias_2 || ':' || round(round(weight, 4) * 10000)::bigint || ':' || case when classification = 'rejected' then '' else array_to_string(reasons, '+') end order by obs_id_1, obs_id_2), '|') edges
            from touched group by 1, 2""",
        "entities": """
            select case_id, cluster_id, 'entity_' || row_number() over (partition by case_id order by cluster_id) entity_id, aliases, primary_alias, total_mentions, coalesce(confirmed_mentions, '') confirmed_mentions, coalesce(candidate_mentions, '') candidate_mentions,
                round(cluster_confidence, 4) confidence_score, coalesce(confirmed_edges, 0) confirmed_edges, coalesce(candidate_edges, 0) candidate_edges, modalities, locations, roles, sources, earliest_timestamp, latest_timestamp, time_span_seconds
            from named join rolled using (case_id, cluster_id) join conf using (case_id, cluster_id) left join counted using (case_id, cluster_id) left join mentioned using (case_id, cluster_id)""",
        "per_case": "select case_id, avg(size) m, stddev_pop(size) sd, count(*) k from conf group by 1",
        "big": "select case_id, cluster_id, size, m + 3.0::double * case when k >= 2 then sd else 1.0::double end threshold from conf join per_case using (case_id) where size > m + 3.0::double * case when k >= 2 then sd else 1.0::double end",
        "two_places": f"select case_id, cluster_id, min(time_offset_sec) at_sec from (select case_id, cluster_id, time_offset_sec from members join obs using (case_id, obs_id) where {_folded('location')} <> '' group by 1, 2, 3 having count(distinct {_folded('location')}) > 1) group by 1, 2",
        "conflicts": f"""
            select case_id, cluster_id, 'physical_impossibility' as type, cluster_id || ' is in different places at second ' || at_sec detail, null::double cluster_confidence, null::bigint size, null::double threshold from two_places
            union all select case_id, cluster_id, 'low_confidence', cluster_id || ' has confidence ' || {decimals('cluster_confidence', 3)}, round(cluster_confidence, 4), null, null from conf where cluster_confidence < 0.55
            union all select case_id, cluster_id, 'oversized_cluster', cluster_id || ' has ' || size || ' members', null, size, round(threshold, 1) from big""",
        "results": """
            select case_id, case when coalesce(d, 0) > 0 then 'awaiting_human_validation' else 'success' end status, coalesce(entity_count, 0) entity_count, coalesce(d, 0) conflicts_detected, coalesce(canonical_entities, '') canonical_entities, coalesce(clusters, '') clusters
            from (select distinct case_id from obs)
            left join (select case_id, count(*) entity_count, array_to_string(list(entity_id || ':' || primary_alias || ':' || total_mentions || ':' || round(confidence_score * 10000)::bigint || ':' || sources order by cluster_id), ';') canonical_entities from entities group by 1) using (case_id)
            left join (select case_id, array_to_string(list(cluster_id || ':' || size || ':' || sorted_aliases || ':' || coalesce(edges, '') order by cluster_id), ';') clusters from conf join named using (case_id, cluster_id) left join edge_lists using (case_id, cluster_id) group by 1) using (case_id)
            left join (select case_id, count(*) d from conflicts group by 1) using (case_id)""",
    }


PAIRS = f"""
    select *, least(obs_id_a, obs_id_b) obs_id_1, greatest(obs_id_a, obs_id_b) obs_id_2 from (
        select a.case_id, {_sides()} from obs a join obs b on a.case_id = b.case_id and a.ord < b.ord)
    where {SAME_PLACE} or {GAP} <= 300 or ({CROSS} and {SAME_ROLE} and {GAP} <= 3600)"""


#: Tables that are read more than once.
MATERIALIZED = {"obs", "pairs", "edges", "set_ratio", "lex", "parts", "clusters", "members", "mentions", "conf", "hits", "touched", "entities", *(f"lcs{i}_{t}" for i in (1, 2) for t in "cw")}


def chain(kind: str = "conv", upto: str = "obs", attachment: float = 0.7) -> str:
    """WITH ... of all tables as far as `upto`; attachment: the least weight at which a single observation moves."""
    steps = {f"raw_{kind}": CHAIN[f"raw_{kind}"], **_stages(kind), "pairs": PAIRS, **_ratios(), **_features(), **_clusters(), **_fold(attachment), **_entities()}
    names = list(steps)
    keep = names[: names.index(upto) + 1]
    return "with recursive " + ",\n".join(f"{n} as {'materialized ' if n in MATERIALIZED else ''}({steps[n]})" for n in keep)
