"""SQL twins of the stream queries: the batch answer over the same events."""

from __future__ import annotations

from oracle import exprs as X
from oracle.match_sql import evidence
from oracle.registry import SQL, sql
from oracle.score_sql import FLAGS

sql("stream_versions", SQL["keep_last_12"])
sql("stream_activity", "select user_id as doc_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*)::bigint as n from events group by 1, 2")
sql("activity_sliding", """select user_id as doc_id, strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - j * interval '6 hours', '%Y-%m-%d %H:%M') as start, count(*)::bigint as n
from events cross join range(4) as r(j) group by 1, 2""")
sql("activity_sessions", """with e as (select user_id as doc_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts) as last from events),
s as (select doc_id, us, sum((last is null or us > last + 21600000000)::int) over (partition by doc_id order by us rows unbounded preceding) as no from e),
w as (select doc_id, min(us) as start_us, max(us) + 21600000000 as end_us, count(*) as n from s group by doc_id, no)
select doc_id, start_us::bigint as start_us, end_us::bigint as end_us, n::bigint as n from w where end_us <= (select max(us) // 1000 * 1000 - 3600000000 from e)""")
sql("stream_rescore", f"""with {FLAGS}, nw as (select user_id as doc_id, arg_max(cast(json_extract_string(props, '$.k') as bigint), {{'t': ts, 'v': event_id}}) as k from events group by 1),
rd as (select o.doc_id, concat_ws(chr(10), o.text, m.text) as text from nw join documents o using (doc_id) left join documents m on m.doc_id = nw.k),
{evidence('pool', 'rd')}, t as (select posting_id, sum(w_job) as t from flags where w_job > 0 group by 1),
h as (select posting_id, doc_id, sum(w_job) as h from flags join ev using (term) where w_job > 0 group by 1, 2)
select posting_id, doc_id, ({X.pct('h', 't')})::bigint as coverage from h join t using (posting_id)""")
