"""Timeline queries: a user's events are the log of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import timeline
from ..session import shared_dir, table
from ..streaming import events as streams
from ..streaming import jobs, progress

LOG, ORDER = ["user_id"], ["ts", "event_id"]


def _events(spark, sf):
    return table(spark, sf, "events")


def _merged(spark, sf):
    e = _events(spark, sf).select((F.col("event_id") % 400).alias("id"), F.unix_micros("ts").alias("us"), "event_type")
    return timeline.merge([e.where("event_type <> 'click'"), e.where("us % 2 = 0 or event_type = 'click'")], "id", ["us", "event_type"])


def _rates(spark, sf):
    e = _events(spark, sf).withColumn("log", F.col("user_id"))
    return timeline.rates(e, ["log"], "ts", "value", 864000).select("event_id", "samples", F.round("rate", 6).alias("rate"))


def _folder(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _windowed(spark, sf):
    got = streams.drained(streams.windowed(streams.source(spark, sf)), _folder(spark), "complete")
    return got.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def _distinct(spark, sf):
    got = streams.drained(streams.distinct_events(streams.source(spark, sf)), _folder(spark), "append")
    return got.select("event_id", "user_id", F.unix_micros("ts").alias("us"))


def _states(spark, sf):
    got = streams.drained(streams.job_states(streams.source(spark, sf)), _folder(spark), "update")
    return got.groupBy("user_id").agg(F.max("events").alias("events"), F.max_by("errors", "events").alias("errors"), F.max_by("last_type", "events").alias("last_type"))


def _sliding(spark, sf):
    got = streams.drained(streams.windowed(streams.source(spark, sf), "10 minutes", slide="5 minutes"), _folder(spark), "complete")
    return got.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


def _admitted(spark, sf):
    return streams.admitted(streams.source(spark, sf), _folder(spark)).select("event_id", "user_id", F.col("place").cast("long").alias("place"))


WANTED = ["queued", "running", "pausing", "paused", "running", "completed", "failed", "cancelled", "queued"]


def _machine(spark, sf):
    wanted = F.element_at(F.array(*map(F.lit, WANTED)), (F.col("event_id") * 7 % 9 + 1).cast("int"))
    rows = streams.source(spark, sf).select(F.col("user_id").alias("job"), "event_id", F.unix_micros("ts").alias("at"), wanted.alias("wanted"))
    return streams.drained(jobs.machine(rows), _folder(spark), "append", once=True)


def _rates_heard(spark, sf):
    rows = streams.source(spark, sf).select(F.col("user_id").alias("job"), F.unix_micros("ts").alias("at"), (F.col("event_id") / 20000).alias("done"))
    return streams.drained(jobs.rates(rows), _folder(spark), "update", once=True).select("job", "samples", F.round(F.col("rate") * 1e6, 4).alias("rate"))


def _progress(spark, sf):
    """Three stages of a stream: what was read, what has a value, what is left of errors; the counts are those that were reported on the way."""
    read = progress.stage(streams.source(spark, sf), "read")
    valued = progress.stage(read.where("value is not null and value >= 20"), "valued")
    errors = progress.stage(valued.where("event_type = 'error'").select("event_id", "value"), "errors")
    counts = progress.run(errors, _folder(spark), f"progress-{uuid.uuid4().hex}")[1]
    return counts.groupBy("stage").agg(F.sum("rows").alias("rows"))


QUERIES = {
    "timeline_collapse": lambda spark, sf: timeline.collapse(_events(spark, sf), LOG, ORDER, "event_type").select("event_id", "user_id", "event_type"),
    "timeline_merge_suffix": _merged,
    "last_attempt": lambda spark, sf: timeline.last_attempt(_events(spark, sf), LOG, ORDER, F.col("event_type").isin("error", "purchase")).select("event_id", "user_id", "attempt"),
    "lifecycle_summary": lambda spark, sf: timeline.lifecycle(_events(spark, sf), LOG, "ts", "event_type", "event_id").withColumn("seconds", F.round("seconds", 3)),
    "eta_window": _rates,
    "thinned_samples": lambda spark, sf: timeline.thinned(_events(spark, sf), LOG, "ts", 86400.0).select("event_id"),
    "time_to_go": lambda spark, sf: timeline.remaining(_events(spark, sf).withColumn("done", F.col("event_id") / 20000), LOG, "ts", "done", 864000).select("event_id", "samples", "eta"),
    "endpoint_release": lambda spark, sf: timeline.last_use(table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use")), "l_partkey", "use"),
    "stream_windowed": _windowed,
    "stream_distinct": _distinct,
    "stream_job_states": _states,
    "stream_sliding": _sliding,
    "stream_late_admitted": _admitted,
    "stream_job_machine": _machine,
    "stream_rates": _rates_heard,
    "stream_progress": _progress,
}
ORACLES = {
    "timeline_collapse": """with e as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b from events)
select event_id, user_id, event_type from e where b is null or b <> event_type""",
    "timeline_merge_suffix": """with e as (select event_id % 400 as id, epoch_us(ts) as us, event_type from events),
u as (select * from e where event_type <> 'click' union select * from e where us % 2 = 0 or event_type = 'click'), n as (select *, row_number() over (partition by id order by us, event_type) as k from u)
select id, us, event_type, case when k = 1 then id::varchar else id || '#' || k end as merged_id from n""",
    "last_attempt": """with e as (select event_id, user_id, coalesce(sum(case when event_type in ('error', 'purchase') then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as attempt from events),
m as (select *, max(attempt) over (partition by user_id) as last from e) select event_id, user_id, attempt from m where attempt = last""",
    "lifecycle_summary": """select user_id, first(event_type order by ts, event_id) as first_state, last(event_type order by ts, event_id) as last_state,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) as seconds, count(*) as events from events group by user_id""",
    "eta_window": """with e as (select event_id, user_id as log, epoch_us(ts) as us, value from events),
w as (select event_id, count(*) over w as samples, (max(us) over w - min(us) over w) / 1e6 as t, last_value(value) over w - first_value(value) over w as gained
  from e window w as (partition by log order by us range between 864000000000 preceding and current row))
select event_id, samples, case when samples >= 3 and t >= 5 then round(gained / t, 6) end as rate from w""",
    "thinned_samples": """with recursive e as (select event_id, user_id, epoch_us(ts) as us from events), k(user_id, us) as (select user_id, min(us) from e group by 1
  union all select k.user_id, (select min(e.us) from e where e.user_id = k.user_id and e.us >= k.us + 86400000000) from k where k.us is not null)
select event_id from e join k using (user_id, us)""",
    "time_to_go": """with e as (select event_id, user_id, epoch_us(ts) as us, event_id / 20000 as done from events), w as (select event_id, done, count(*) over w as samples, (max(us) over w - min(us) over w) / 1e6 as t, last_value(done) over w - first_value(done) over w as g
  from e window w as (partition by user_id order by us range between 864000000000 preceding and current row))
select event_id, samples, case when samples >= 3 and t >= 5 and g / t > 0 then ceil((1 - done) / (g / t))::bigint end as eta from w""",
    "endpoint_release": """select l_partkey, l_orderkey * 10 + l_linenumber as use, l_orderkey * 10 + l_linenumber = max(l_orderkey * 10 + l_linenumber) over (partition by l_partkey) as release from lineitem""",
    "stream_windowed": "select epoch_us(date_trunc('hour', ts)) as start_us, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "stream_distinct": "select distinct event_id, user_id, epoch_us(ts) as us from events",
    "stream_job_states": "select user_id, count(*) as events, count_if(event_type = 'error') as errors, last(event_type order by ts, event_id) as last_type from events group by user_id",
    "stream_sliding": "with w as (select event_type, value, unnest([epoch_us(ts) // 300000000, epoch_us(ts) // 300000000 - 1]) * 300000000 as start_us from events) select start_us, event_type, count(*) as n, round(sum(value), 4) as total from w group by 1, 2",
    "stream_late_admitted": "select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as place from events",
    "stream_job_machine": f"""with recursive e as (select user_id as job, event_id, {WANTED}[event_id * 7 % 9 + 1] as wanted, row_number() over (partition by user_id order by ts, event_id) as k from events),
t(was, wanted) as (values {", ".join(f"({repr(a) if a else chr(39) * 2}, {b!r})" for a, bs in streams.TRANSITIONS.items() for b in sorted(bs))}),
m as (select e.job, e.event_id, e.wanted, e.k, case when t.was is not null then e.wanted end as state, t.was is not null as legal from e left join t on t.was = '' and t.wanted = e.wanted where k = 1
  union all select e.job, e.event_id, e.wanted, e.k, case when t.was is not null then e.wanted else m.state end, t.was is not null from m join e on e.job = m.job and e.k = m.k + 1 left join t on t.was = coalesce(m.state, '') and t.wanted = e.wanted)
select job, event_id, wanted, state, legal from m""",
    "stream_rates": """with s as (select user_id as job, epoch_us(ts) as us, max(event_id / 20000) as done from events group by 1, 2)
select job, count(*) as samples, case when max(us) > min(us) then round((arg_max(done, us) - arg_min(done, us)) / (max(us) - min(us)) * 1e6 * 1e6, 4) end as rate from s group by job""",
    "stream_progress": """select 'read' as stage, count(*) as rows from events union all select 'valued', count(*) from events where value >= 20 union all select 'errors', count(*) from events where value >= 20 and event_type = 'error'""",
}
