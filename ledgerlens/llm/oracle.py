"""DuckDB SQL for the queries that SQL can express over whole tables.

The others are tested against brute force: merges of tokenizers (4, 6, 8), parsing into phrases (5), sliding windows (7)
and adaptive weights (10).
"""

from . import chat, decontaminate, divergence, mixing, nsbounds, quality

WORD = "[^\\x20\\x09-\\x0D]+"

OP1 = f"""
with words as (
    select doc_id, text, coalesce(regexp_extract_all(text, '{WORD}'), []) as w,
           coalesce(string_split(text, chr(10)), []) as lines
    from documents),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from words),
hashed as (select doc_id, i, word, ('0x' || substr(md5(word), 1, 8))::bigint as h from each),
grams as (
    select doc_id, h % {quality.BUCKETS} as bucket from hashed
    union all
    select a.doc_id, (a.h * 1000003 + b.h + 7) % {quality.BUCKETS} from hashed a join hashed b
        on a.doc_id = b.doc_id and b.i = a.i + 1),
trusted as (
    select doc_id, substr(md5(doc_id::varchar), 1, 1) in {tuple(quality.HELD)} as held
    from (select doc_id from labels where doc_id is not null group by doc_id
          having min(quality) = 1 and max(toxic) = 0 order by md5(doc_id::varchar), doc_id limit {quality.TRUSTED})),
counts as (
    select bucket, count(*) as raw, count(*) filter (t.doc_id is not null) as good
    from grams left join (select doc_id from trusted where not held) t using (doc_id) group by bucket),
sums as (select sum(raw) as raw, sum(good) as good from counts),
weights as (
    select bucket, round_even(1e6 * ln(((counts.good + 1) / (sums.good + {quality.BUCKETS}))
                                       / ((counts.raw + 1) / (sums.raw + {quality.BUCKETS}))), 0)::bigint as weight
    from counts, sums),
scores as (
    select doc_id, sum(weight)::bigint / count(*) / 1e6 as score from grams join weights using (bucket) group by doc_id),
held as (
    select score, row_number() over (order by score) - 1 as pos, count(*) over () as n
    from scores join trusted using (doc_id) where held),
cut as (
    select coalesce(max(score) filter (pos = n // 2) - {quality.WIDTH} * (
        max(score) filter (pos = n // 2) - max(score) filter (pos = n // 20)), {quality.FAR}) as cut from held),
triples as (
    select a.doc_id, a.i, a.word as x, b.word as y, c.word as z from each a
    join each b on a.doc_id = b.doc_id and b.i = a.i + 1 join each c on a.doc_id = c.doc_id and c.i = a.i + 2),
twice as (select *, count(*) over (partition by doc_id, x, y, z) as k from triples),
inside as (
    select doc_id, count(distinct i + step) as n_repeat_words
    from twice, (select unnest([0, 1, 2]) as step) where k > 1 group by doc_id),
lined as (select doc_id, unnest(lines) as line from words),
same as (
    select doc_id, count(*) - count(distinct line) as n_dup_lines from lined
    where regexp_matches(line, '{WORD}') group by doc_id),
base as (
    select doc_id, len(w)::bigint as n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint as word_chars,
           coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::bigint as n_symbols,
           coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from words left join same using (doc_id) left join inside using (doc_id)),
judged as (
    select base.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(score, 0.0) as score, cut
    from base left join scores using (doc_id), cut)
select *, not base_failed and score >= cut as kept from judged
"""

OP2 = f"""
with said as (
    select conv_id, floor(turn / {chat.TURNS})::bigint as piece, turn,
           case when coalesce(role, '') = '' then 'unknown' else role end as name,
           replace(coalesce(text, ''), '<|', '< |') as text
    from conversations),
speakers as (select distinct conv_id, name as perspective from said where name <> 'system'),
seen as (
    select s.*, perspective, coalesce(name = perspective, false) as own,
           '{chat.START}' || case when name = 'system' then 'system' when name = perspective then 'assistant'
                                  else 'user name=' || name end || chr(10) as head,
           s.text || '{chat.END}' as body,
           row_number() over (partition by s.conv_id, perspective, piece
                              order by turn nulls first, name, s.text) as pos
    from said s left join speakers p on s.conv_id is not distinct from p.conv_id),
placed as (
    select *, length(head) + coalesce(sum(length(head) + length(body) + 1) over (
        partition by conv_id, perspective, piece order by pos rows between unbounded preceding and 1 preceding), 0) as start
    from seen)
select conv_id, perspective, piece, count(*) as n_messages, string_agg(head || body || chr(10), '' order by pos) as text,
       coalesce(string_agg(case when own then start::bigint || ':' || (start + length(body))::bigint end, ',' order by pos), '') as mask,
       coalesce(sum(length(body)) filter (own), 0)::bigint as n_learned
from placed group by all
"""

_WEIGHTS = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
OP3 = f"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
           md5('{mixing.SEED}:' || coalesce(doc_id::varchar, 'null')) as place
    from documents),
totals as (
    select source, sum(size)::bigint as source_size,
           ({_WEIGHTS})[((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int]::double as weight
    from sized group by source),
caps as (
    select *, source_size * {mixing.EPOCHS}::double as cap, source_size * {mixing.EPOCHS}::double / weight as ratio from totals),
levels as (
    select *, ((sum(source_size) over ())::double * {mixing.SHARE}::double - coalesce(sum(cap) over filled, 0.0))
              / (sum(weight) over () - coalesce(sum(weight) over filled, 0.0)) as level
    from caps
    window filled as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
    select source, source_size,
           case when top is null or ratio <= top then cap else top * weight end as target
    from (select *, max(case when level <= ratio then level end) over () as top from levels)),
states as (
    select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as times from targets),
ordered as (
    select s.*, t.source_size, t.target, t.times, floor(target)::bigint - times * source_size as due,
           sum(size) over (partition by s.source order by place range between unbounded preceding and current row) as upto,
           sum(size) over (partition by s.source, place) as tied
    from sized s join states t on s.source is not distinct from t.source),
taken as (
    select *, case when due > 0 and upto < due then 1 else 0 end as extra,
           case when due > 0 and size > 0 and upto >= due and upto - tied < due
                then floor(size * (due - upto + tied)::double / tied)::bigint else 0 end as part
    from ordered)
select doc_id, size, source_size, round(target, 6) as target, ((times + extra) * size + part)::bigint as taken, source,
       (times + extra)::bigint as copies, part::bigint as part
from taken
"""

OP9 = """
with recursive words as (
    select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\\x20\\x09-\\x0D]+'), []) as w
    from documents),
sets as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [w]
                                        else [w[i:i + 3] for i in range(1, len(w) - 2)] end) as s
    from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (
    select a.doc_id as a, b.doc_id as b, count(*) as k from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id
    group by all),
near as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * k >= 85 * (x.n + y.n - k)),
both_ways as (select a, b from near union select b, a from near),
reach as (
    select a as doc_id, b as other from both_ways
    union
    select doc_id, b from reach join both_ways on a = other)
select words.doc_id, coalesce(any_value(n), 0)::bigint as n_shingles,
       least(words.doc_id, coalesce(min(other), words.doc_id)) as component_id
from words left join sizes using (doc_id) left join reach using (doc_id) group by words.doc_id
"""

_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12 = f"""
with docs as (
    select row_number() over () as ref, doc_id, coalesce(regexp_extract_all(
        {_FOLDED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
    from documents),
tests as (
    select coalesce(item_id::varchar, '') as item, coalesce(regexp_extract_all(
        {_FOLDED.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w
    from benchmark),
sized as (select item, w, least(len(w), {decontaminate.WINDOW}) as n from tests where len(w) > 0),
windows as (
    select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as words
    from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from sized)),
places as (
    select ref, n, i, array_to_string(w[i:i + n - 1], ' ') as words
    from (select ref, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from windows) where len(w) >= n)),
found as (select distinct ref, places.n, i, item from places join windows on places.words = windows.words and places.n = windows.n),
hit as (
    select ref, count(distinct pos) as n_hit
    from (select ref, unnest(range(i, i + n)) as pos from (select distinct ref, n, i from found)) group by ref),
items as (
    select ref, count(*) as n_items, string_agg(item, ',' order by item) as listed
    from (select distinct ref, item from found) group by ref)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (ref) left join items using (ref)
"""

_SHARE = ("(1 + ({scale}::hugeint * ({{}} + {smooth})) // ({{}} + {smooth} * v))::bigint"
          .format(scale=divergence.SCALE, smooth=divergence.SMOOTH))
OP13 = f"""
with docs as (
    select row_number() over () as ref, coalesce(lang, '') as lang, coalesce(source, '') as source,
           regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
    from documents),
words as (select ref, lang, source, unnest(w) as term from docs),
kept as (select lang, term, count(*) as c from words group by all having count(distinct ref) >= {divergence.LEAST}),
langs as (select lang, count(*) as v, sum(c) as n from kept group by lang),
groups as (select distinct lang, source from docs),
own as (select lang, source, term, count(*) as c from words semi join kept using (lang, term) group by all),
sums as (select lang, source, sum(c) as n from own group by all),
dense as (
    select g.lang, g.source, k.term, coalesce(o.c, 0) as c, {_SHARE.format("coalesce(o.c, 0)", "coalesce(s.n, 0)")} as p,
           {_SHARE.format("k.c", "l.n")} as q
    from groups g join kept k using (lang) join langs l using (lang)
    left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term
    left join sums s on s.lang = g.lang and s.source = g.source),
apart as (
    select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value
    from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source
    union all
    select lang, source, 'term', term, p - q from dense where c > 0 and p > q),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {divergence.TERMS}
"""

_ROUNDS = ",".join(f"""
d{r} as (
    select v.ref, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from cells v join c{r} c on v.dim = c.dim group by v.ref, c.k),
n{r} as (select ref, min(k) as k from (select *, min(d) over (partition by ref) as least from d{r}) where d = least group by ref),
s{r} as (select k, dim, sum(x) as s, count(*) as n from cells join n{r} using (ref) group by k, dim),
c{r + 1} as (
    select c.k, c.dim, coalesce((s - ((s % n) + n) % n) // n, c.x) as x
    from c{r} c left join s{r} s on s.k = c.k and s.dim = c.dim)""" for r in range(nsbounds.ROUNDS))
OP11 = f"""
with kept as (
    select row_number() over () as ref, vec_id, embedding from embeddings
    where len(embedding) = {nsbounds.DIMS} and len(list_filter(embedding, lambda c: abs(c) <= {nsbounds.REACH})) = {nsbounds.DIMS}),
cells as (
    select ref, vec_id, dim, floor({nsbounds.SCALE} * embedding[dim]::double)::hugeint as x
    from (select *, unnest(range(1, {nsbounds.DIMS + 1})) as dim from kept)),
firsts as (
    select ref, row_number() over (order by sha256('{nsbounds.SEED}:' || coalesce(vec_id::varchar, 'null')), list_transform(
        embedding, lambda c: floor({nsbounds.SCALE} * c::double))) - 1 as k
    from kept qualify k < {nsbounds.CLUSTERS}),
c0 as (select k, dim, x from cells join firsts using (ref)),{_ROUNDS},
ends as (select v.ref, c.k, sum((v.x - c.x) * (v.x - c.x)) as d from cells v join c{nsbounds.ROUNDS} c on v.dim = c.dim group by v.ref, c.k),
nearest as (
    select ref, d, min(k) as k from (select *, min(d) over (partition by ref) as least from ends) where d = least group by ref, d),
digests as (select k, sha256(string_agg(x::varchar, ',' order by dim)) as centroid_sha256 from c{nsbounds.ROUNDS} group by k)
select vec_id, k::int as cluster, d::bigint as distance, (sum(d) over (partition by k))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, centroid_sha256
from nearest join kept using (ref) join digests using (k)
"""

ORACLE = {"op1_quality_rules": OP1, "op2_chat_perspectives": OP2, "op3_source_mixing": OP3, "op9_ngram_jaccard_join": OP9,
          "op11_centroid_clustering": OP11, "op12_benchmark_decontamination": OP12, "op13_source_divergence": OP13}
