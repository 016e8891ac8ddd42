"""The same queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

import re

# Shapes derived from the tables, as common table expressions; each may use the ones before it.
VIEWS = {
    "ev": """
        select *, cast(json_extract_string(props, '$.k') as int) as k, cast(floor(epoch(ts)) as bigint) as sec,
          epoch_us(ts) as us, 64 + 8 * (event_id % 8) as size,
          concat(cast(cast(floor(epoch(ts)) as bigint) as varchar), '_',
                 lpad(cast(event_id % 1000000 as varchar), 10, '0')) as ev_name
        from events""",
    "messages": """
        select event_id as msg_id, user_id as source_id, ts, sec, us, k as cpu_pause_ms, size as message_bytes,
          rpad(concat(printf('C%06d-F', k), ev_name, '-'), cast(size as int),
               'abcdefghijklmnopqrstuvwxyz0123456789') as line
        from ev""",
    "files": """
        select event_id, concat(case when event_type = 'error' then '.COPYING.' when event_type = 'signup' then '_'
          else '' end, ev_name) as name, sec + k as mtime_s from ev""",
    # Four batches of a run for each poll, and one in progress for views.
    "batches": """
        select event_id as fetch_id, user_id as run_id, us, case when j < 4 then sec // 14400 - j else sec end as batch_id,
          case when j < 4 then (sec // 14400 - j) * 14400 else sec - k % 40 end as batch_ts,
          case when j = 4 then 'PROCESSING' when event_type = 'error' and (j = 0 or j = 1 and k < 50) then 'QUEUED'
            else 'COMPLETED' end as status,
          case when j = 4 or (k + 7 * j) % 20 = 19 then null when (k + 7 * j) % 20 = 18 then -1
            else cast(floor(value * 100 / case user_id % 3 when 0 then 1.0::double when 1 then 10.0::double
              else 100.0::double end) as bigint) + 10 * j end as total_delay_ms
        from (select *, unnest(range(5)) as j from ev) where j < 4 or event_type = 'view'""",
    "changes": """
        select event_id as change_id, user_id as run_id, ts, sec, us, cast(1 + k as bigint) as frequency,
          size as message_bytes
        from ev where event_type = 'signup'""",
    "patches": """
        select event_id, user_id as run_id, us, case when event_type in ('purchase', 'signup') then k end as cost,
          case when event_type = 'view' then size when event_type = 'signup' then 200 end as bytes,
          case when event_type = 'signup' then 0.5::double end as period
        from ev where event_type in ('purchase', 'view', 'signup')""",
    "log_lines": """
        select event_id as line_no, user_id as run_id, ts, sec,
          case when event_type in ('click', 'purchase') then concat(strftime(ts, '%Y-%m-%d %H:%M:%S'),
              ' INFO  FileInputDStream:54 - Finding new files took ', cast(k * 60 as varchar), ' ms')
            when event_type = 'view' then concat(strftime(ts, '%Y-%m-%d %H:%M:%S'),
              ' INFO  file-streaming-app:76 - processed: ', cast(k as varchar))
            when event_type = 'signup' then concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' WARN  JobScheduler:66 - slow')
            else ' bla bla' end as line
        from ev""",
    "log_records": r"""
        select line_no, run_id, nullif(regexp_extract(line, p.re, 1), '') as timestamp_str,
          nullif(regexp_extract(line, p.re, 2), '') as level, nullif(regexp_extract(line, p.re, 3), '') as logger_name,
          nullif(regexp_extract(line, p.re, 4), '') as linenumber, nullif(regexp_extract(line, p.re, 5), '') as message,
          cast(epoch(try_cast(nullif(regexp_extract(line, p.re, 1), '') as timestamp)) as bigint) as timestamp_unix
        from log_lines,
          (select '^([0-9]{4}-.{14})\s([A-Z]+)\s+([^:]+):([0-9]+)\s-\s(.*?)[\n\r]*$' as re) p""",
    "bench_lines": """
        select event_id as line_no, user_id as run_id, cast(1 + user_id % 10 as int) as container_count,
          case when event_type = 'click' then concat('benchmarking,benchmark_full_pipeline,full,,', sec, ',',
              sec + 100 + k, ',', 100 + k, ',-1')
            when event_type = 'view' then concat('benchmarking,simulator_no_flask,prepared_to_stream,,', sec, ',',
              sec + k, ',', k, ',-1')
            else 'noise' end as line
        from ev""",
    "bench": """
        select line_no, run_id, container_count, string_split(line, ',') as f
        from bench_lines where starts_with(line, 'benchmarking,')""",
    "durations": """
        select * , total - prepare as net_sec from (
          select run_id, container_count,
            arg_min(cast(f[7] as double), line_no) filter (where f[2] = 'benchmark_full_pipeline' and f[3] = 'full') as total,
            arg_min(cast(f[7] as double), line_no)
              filter (where f[2] = 'simulator_no_flask' and f[3] = 'prepared_to_stream') as prepare
          from bench group by run_id, container_count)
        where total is not null and prepare is not null""",
    "delays": """
        select run_id, batch_ts, arg_min(total_delay_ms, fetch_id) as delay_ms from batches
        where status = 'COMPLETED' and coalesce(total_delay_ms, -1) >= 0 group by run_id, batch_ts""",
    "listings": """
        select r.run_id, l.us, r.line_no, r.timestamp_unix as sec, cast(regexp_extract(message, '[0-9]+') as bigint) as pause_ms
        from log_records r join (select line_no, epoch_us(ts) as us from log_lines) l using (line_no)
        where logger_name = 'FileInputDStream' and message like '%Finding new files took%'""",
    "pauses": "select run_id, sec as ts, arg_max(pause_ms, line_no) as pause_ms from listings group by run_id, sec",
    # What the loop sees at each poll: the rate in force, the age of the oldest batch in progress, ...
    "polls": """
        select p.*, c.us as change_us, c.change_id, c.frequency, c.message_bytes from (
          select fetch_id, run_id, us, greatest(0, coalesce(max(us - batch_ts * 1000000) filter (where status = 'PROCESSING'), 0)) as age_us
          from batches group by fetch_id, run_id, us) p
        asof join changes c on p.run_id = c.run_id and p.us >= c.us""",
    # ... the delays it knows by then, of which the first one fetched stays, ...
    "known": """
        select run_id, batch_ts, us, fetch_id, total_delay_ms as delay_ms from (
          select *, row_number() over (partition by run_id, batch_ts order by us, fetch_id) as nth from batches
          where status = 'COMPLETED' and coalesce(total_delay_ms, -1) >= 0) where nth = 1""",
    "recent": """
        select p.fetch_id, p.run_id, p.us, p.age_us, p.change_us, p.change_id, p.frequency, p.message_bytes, count(*) as n,
          cast(sum(d.delay_ms) as bigint) as total_ms, arg_max(d.delay_ms, d.batch_ts) as latest_ms
        from polls p join known d on d.run_id = p.run_id and d.batch_ts * 1000000 > p.change_us + 13000000
          and (d.us < p.us or d.us = p.us and d.fetch_id <= p.fetch_id)
        group by all""",
    # ... and the listing pauses it knows, of which the last line of a second stays.
    "slow": """
        select fetch_id, count(*) filter (where pause_ms > 4750) as slow_listings from (
          select p.fetch_id, l.sec, arg_max(l.pause_ms, l.line_no) as pause_ms
          from polls p join listings l on l.run_id = p.run_id and l.us <= p.us and l.sec * 1000000 > p.change_us + 13000000
          group by p.fetch_id, l.sec) group by fetch_id""",
    "ruled": """
        select *, case
          when (frequency > 1 and latest_ms > 25000) or age_us > 25000000 then 1
          when frequency > 1 and slow_listings > 2 then 2
          when n > 5 and total_ms > 10000 * n then 3
          when n > 3 and total_ms < 50 * n then 4
          when n > 3 and total_ms < 500 * n then 5
          when n > 3 and total_ms < 2500 * n then 6
          when n > 3 and total_ms < 4500 * n then 7
          when n > 3 and total_ms < 5000 * n then 8
          when n > 3 then 9 else 10 end as rule
        from (select r.*, coalesce(s.slow_listings, 0) as slow_listings from recent r left join slow s using (fetch_id))""",
    "decided": """
        select run_id, fetch_id, us as poll_us, change_us, change_id, frequency, message_bytes, n, total_ms, latest_ms, slow_listings,
          cast(ceil(age_us / 1000.0::double) as bigint) as in_process_ms, rule, new_frequency, reason, reason is not null or new_frequency <> frequency as ends_epoch
        from (select *, case when rule in (1, 3, 9) then greatest(1, frequency // 2)
              when rule = 4 then frequency * 50 when rule = 5 then frequency * 5
              when rule = 6 then cast(floor(frequency * 1.75::double) as bigint) + 1
              when rule = 7 then cast(floor(frequency * 1.03::double) as bigint) + 1
              else frequency end as new_frequency,
            case rule when 2 then 'LIMIT_FILE_LISTNG' when 8 then 'LIMIT_TOTAL_DELAY' end as reason
          from ruled)""",
    "outcomes": """
        select run_id, change_us, change_id, frequency, message_bytes, poll_us, fetch_id, rule, new_frequency, reason
        from (select *, row_number() over (partition by run_id, change_us order by poll_us, fetch_id) as nth
          from decided where ends_epoch) where nth = 1""",
    "bounds": "select min(sec) as lo, max(sec) as hi from ev",
    # Slice of a row when the time span is cut in four, at whole seconds.
    "quarters": """
        select e.event_id, cast(case when sec < lo + (hi + 1 - lo) // 4 then 0
          when sec < lo + (hi + 1 - lo) * 2 // 4 then 1 when sec < lo + (hi + 1 - lo) * 3 // 4 then 2
          else 3 end as bigint) as quarter from ev e cross join bounds""",
    "daily": """
        select line, cpu_pause_ms as k, sec // 86400 as day, quarter // 2 as half from messages join quarters on msg_id = event_id""",
}

_NOW = 1_704_931_200

BODIES = {
    "word_count": r"""
        select word, count(*) as n from (select unnest(string_split_regex(text, '[\n ]')) as word from documents)
        group by word""",
    "reduce_cost_bits": "select source_id, bit_or(cast(cpu_pause_ms as bigint)) as bits from messages group by source_id",
    "statistics_records": """
        select event_id as fetch_id, user_id as run_id,
          concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '.000GMT') as "startTime", 5000::bigint as "batchDuration", 1::bigint as "numReceivers",
          case when event_type = 'error' then 0 else 1 end::bigint as "numActiveReceivers",
          case when event_type = 'error' then 1 else 0 end::bigint as "numInactiveReceivers", k::bigint as "numTotalCompletedBatches",
          least(k, 50)::bigint as "numRetainedCompletedBatches", (event_id % 3)::bigint as "numActiveBatches",
          size as "numProcessedRecords", size + k as "numReceivedRecords", size / 8.0::double as "avgInputRate",
          (event_id % 7)::bigint as "avgSchedulingDelay", k::bigint as "avgProcessingTime",
          case when k < 95 then event_id % 7 + k end::bigint as "avgTotalDelay"
        from ev""",
    "word_count_per_batch": """
        select batch_start_s, word, count(*) as n
        from (select sec // 3600 * 3600 as batch_start_s, unnest(string_split(line, ' ')) as word from log_lines)
        group by batch_start_s, word""",
    "generate_messages": """
        select change_id, seq, name, cpu_pause_ms, message_bytes,
          rpad(concat('C000020-F', name, '-'), cast(message_bytes as int), 'abcdefghijklmnopqrstuvwxyz0123456789') as line
        from (select change_id, cast(seq as int) as seq, 20 as cpu_pause_ms, message_bytes,
            concat(sec, '_', lpad(cast(seq as varchar), 10, '0')) as name
          from (select *, unnest(generate_series(1, cast(floor(1.0::double / (1.0::double / frequency)) as int))) as seq
            from changes))""",
    "parse_cost": """
        select msg_id, try_cast(substring(line, 2, 6) as int) as cpu_pause_ms,
          try_cast(substring(line, 2, 6) as int) / 1000.0::double as pause_sec, cast(length(line) as int) as line_length
        from messages""",
    "parse_header": r"""
        select msg_id, cast(regexp_extract(line, '^C([0-9]{6})-F([^-]+)-', 1) as int) as header_cost_ms,
          regexp_extract(line, '^C([0-9]{6})-F([^-]+)-', 2) as name,
          cast(split_part(regexp_extract(line, '^C([0-9]{6})-F([^-]+)-', 2), '_', 1) as bigint) as name_s
        from messages""",
    "roundtrip_check": """
        select message_bytes, count(*) as messages, count(*) filter (where octet_length(encode(line)) <> message_bytes) as bad_length,
          count(*) filter (where try_cast(substring(line, 2, 6) as int) is distinct from cpu_pause_ms) as bad_cost
        from messages group by message_bytes""",
    "message_filenames": "select event_id, ev_name as name from ev",
    "message_ids": r"""
        select event_id, concat(regexp_replace(printf('%d.%06d', us // 1000000, us % 1000000), '(\.[0-9]+?)0+$', '\1'),
          '_', lpad(cast(event_id & 10000000 as varchar), 8, '0')) as id
        from ev""",
    "params_key": """
        select sec // 86400 * 86400 as interval_start_s, params_key, min(event_id) as first_msg_id, count(*) - 1 as reused
        from (select *, concat('{"cpu_pause_ms":', k % 5, ',"message_bytes":', size, ',"period_sec":',
            cast((k % 4 + 1) / 4.0::double as varchar), '}') as params_key from ev)
        group by sec // 86400, params_key""",
    "effective_rate": """
        select change_id, frequency, 1.0::double / frequency as period_sec,
          cast(floor(1.0::double / (1.0::double / frequency)) as int) as per_second
        from changes""",
    "visible_files": "select event_id, name from files where not starts_with(name, '.')",
    "fresh_files": f"""
        select event_id, name, try_cast(split_part(name, '_', 1) as bigint) as name_s from files
        where not starts_with(name, '.') and {_NOW} < try_cast(split_part(name, '_', 1) as bigint) + 10""",
    "unreadable_names": """
        select event_id, name from files
        where not starts_with(name, '.') and try_cast(split_part(name, '_', 1) as bigint) is null""",
    "expired_files": f"""
        select event_id, name, mtime_s from files where {_NOW} > mtime_s + 60 and name not like '%.COPYING.%'""",
    "new_files_only": f"select event_id, name, mtime_s from files where mtime_s >= {_NOW}",
    "batch_counts": "select sec // 300 * 300 as batch_start_s, count(*) as n from messages group by sec // 300",
    "batch_counts_filled": """
        select b * 300 as batch_start_s, coalesce(n, 0) as n
        from (select unnest(generate_series(min(sec) // 300, max(sec) // 300)) as b from messages)
        left join (select sec // 300 as b, count(*) as n from messages group by sec // 300) using (b)""",
    "running_message_count": """
        select source_id, interval_start_s, messages,
          cast(sum(messages) over (partition by source_id order by interval_start_s) as bigint) as messages_all_time
        from (select source_id, sec // 3600 * 3600 as interval_start_s, count(*) as messages from messages
          group by source_id, sec // 3600)""",
    "interval_message_count": """
        select source_id, sec // 5 * 5 as interval_start_s, count(*) as messages from messages
        group by source_id, sec // 5""",
    "report_message_count": """
        select sec // 3 * 3 as interval_start_s, count(*) as messages from messages group by sec // 3""",
    "batch_preview": """
        select * from (select sec // 3600 * 3600 as batch_start_s,
            cast(row_number() over (partition by sec // 3600 order by msg_id) as int) as row_in_batch, msg_id, line
          from messages) where row_in_batch <= 10""",
    "overrun_report": """
        select msg_id, source_id, elapsed_us, greatest(0, elapsed_us - (cpu_pause_ms + 1) * 600000000::bigint) as overrun_us
        from (select *, us - lag(us) over (partition by source_id order by us, msg_id) as elapsed_us from messages)""",
    "offered_load": """
        select sec // 300 * 300 as batch_start_s, cast(sum(cpu_pause_ms) as bigint) as cost_ms,
          sum(cpu_pause_ms) / 2400000.0::double as load
        from messages group by sec // 300""",
    "batch_records": "select fetch_id, run_id, batch_id, batch_ts, status, total_delay_ms from batches",
    "app_records": """
        select event_id as fetch_id, app_id, name, startTime, duration, sparkUser, completed, startTimeEpoch
        from (select event_id, concat('local-', ms) as app_id, concat('run ', user_id) as name, nth,
            concat(strftime(make_timestamp((ms + nth * k * 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%g'), 'GMT') as startTime,
            cast(k as bigint) * 1000 as duration, concat('user', user_id) as sparkUser, nth = 0 as completed,
            ms + nth * k * 1000 as startTimeEpoch
          from (select *, us // 1000 as ms, unnest(case when event_id % 2 = 0 then [0, 1] else [0] end) as nth
            from ev where event_type = 'signup'))""",
    "parse_log": "select * from log_records",
    "log_tail": "select line_no, run_id, line from log_lines order by ts desc, line_no desc limit 500",
    "file_listing_pauses": "select run_id, ts, pause_ms, pause_ms / 1000.0::double as pause_sec from pauses",
    "app_log_lines": """
        select line_no, run_id, timestamp_unix, message from log_records where logger_name = 'file-streaming-app'""",
    "slow_listing_flags": """
        select run_id, count(*) filter (where pause_ms > 4750) as slow_listings,
          count(*) filter (where pause_ms > 4750) > 2 as listing_limit
        from pauses group by run_id""",
    "completed_delays": "select * from delays",
    "unfinished_batches": f"""
        select run_id, count(*) filter (where status = 'QUEUED') as queued,
          count(*) filter (where status = 'QUEUED') > 1 as has_backlog,
          greatest(0, coalesce(max({_NOW} - batch_ts) filter (where status = 'PROCESSING'), 0)) as in_process_sec
        from batches where (run_id, fetch_id) in (select (run_id, max(fetch_id)) from batches group by run_id) group by run_id""",
    "post_warmup_delays": """
        select d.run_id, d.batch_ts, d.delay_ms, c.us as change_us, c.frequency from delays d
        asof join changes c on d.run_id = c.run_id and d.batch_ts * 1000000 >= c.us
        where d.batch_ts * 1000000 > c.us + 13000000""",
    "delay_stats": """
        select run_id, count(*) as n, cast(sum(delay_ms) as bigint) / count(*) / 1000.0::double as mean_sec,
          round(var_samp(delay_ms / 1000.0::double), 4) as variance,
          round(stddev_samp(delay_ms / 1000.0::double), 4) as stdev
        from delays group by run_id""",
    "longest_delays": """
        select run_id, max(delay_ms) filter (where nth = 1) as longest_ms,
          max(delay_ms) filter (where nth = 2) as second_longest_ms
        from (select *, row_number() over (partition by run_id order by delay_ms desc) as nth from delays) group by run_id""",
    "latest_delay": """
        select run_id, max(batch_ts) as batch_ts, arg_max(delay_ms, batch_ts) as delay_ms from delays group by run_id""",
    "ordered_delays": "select * from delays order by run_id, batch_ts",
    # Each batch as the last poll that listed it shows it.
    "run_statistics": """
        select run_id, min(batch_ts) as start_s, count(*) filter (where status = 'COMPLETED') as completed_batches,
          count(*) filter (where status = 'PROCESSING') as active_batches,
          cast(coalesce(sum(batch_id % 100) filter (where status = 'COMPLETED'), 0) as bigint) as processed_records,
          coalesce(sum(batch_id % 100) filter (where status = 'COMPLETED'), 0)::double
            / nullif(count(*) filter (where status = 'COMPLETED') * 5, 0) as avg_input_rate,
          cast(sum(total_delay_ms // 25) filter (where status = 'COMPLETED')
            // nullif(count(total_delay_ms) filter (where status = 'COMPLETED'), 0) as bigint) as avg_scheduling_ms,
          cast(sum(total_delay_ms - total_delay_ms // 25) filter (where status = 'COMPLETED')
            // nullif(count(total_delay_ms) filter (where status = 'COMPLETED'), 0) as bigint) as avg_processing_ms,
          cast(sum(total_delay_ms) filter (where status = 'COMPLETED')
            // nullif(count(total_delay_ms) filter (where status = 'COMPLETED'), 0) as bigint) as avg_total_ms
        from (select run_id, batch_id, batch_ts, status, case when total_delay_ms >= 0 then total_delay_ms end as total_delay_ms
          from (select *, row_number() over (partition by run_id, batch_id, batch_ts order by fetch_id desc) as nth from batches) where nth = 1)
        group by run_id""",
    "param_patches": """
        select event_id, run_id, coalesce(last_value(cost ignore nulls) over w, 20) as cpu_pause_ms,
          coalesce(last_value(bytes ignore nulls) over w, 200) as message_bytes,
          coalesce(last_value(period ignore nulls) over w, 1.0::double) as period_sec
        from patches window w as (partition by run_id order by us, event_id rows unbounded preceding)""",
    "params_as_of": """
        select m.msg_id, m.source_id, c.frequency, c.message_bytes as setting_bytes, c.us as since_us from messages m
        asof left join changes c on m.source_id = c.run_id and m.us >= c.us""",
    "params_held": """
        select m.msg_id, m.source_id, c.frequency, c.message_bytes as setting_bytes, c.us as since_us
        from (select *, min(us) over (partition by source_id, sec // 86400) as first_us from messages) m
        asof left join changes c on m.source_id = c.run_id and m.first_us >= c.us""",
    "throughput_decisions": "select * from decided",
    "epoch_outcomes": "select * from outcomes",
    "max_throughput": """
        select message_bytes, reason, frequency, frequency * message_bytes as bytes_per_sec
        from (select *, row_number() over (partition by message_bytes order by frequency desc, reason desc) as nth
          from outcomes where reason is not null) where nth = 1 order by message_bytes desc""",
    "bench_rows": """
        select line_no, run_id, container_count, f[1] as benchmarking, f[2] as file, f[3] as topic, f[4] as description,
          f[5] as started_at_time, f[6] as ended_time, f[7] as duration_secs, f[8] as number_of_bytes
        from bench""",
    "run_durations": "select * from durations",
    "result_rows": "select run_id, total, prepare, container_count from durations",
    "scaling_curve": """
        select container_count, count(*) as runs, avg(net_sec) as mean_sec, min(net_sec) as min_sec, max(net_sec) as max_sec
        from durations group by container_count""",
    "append_results": """
        select run_id, container_count, net_sec, run_stamp
        from durations cross join (values ('2024_01_01__00_00_00'), ('2024_01_02__00_00_00')) s(run_stamp)""",
    "publish_messages": "select line from messages",
    "foreach_batch_counts": """
        select quarter as batch_id, count(*) as n, cast(sum(cpu_pause_ms) as bigint) as cost_ms
        from messages m join quarters q on m.msg_id = q.event_id group by quarter""",
    "progress_log": """
        select cast(quarter // 2 as bigint) as batch_id, 'COMPLETED' as status, count(*) as records, true as adds_up
        from messages m join quarters q on m.msg_id = q.event_id group by quarter // 2""",
    "stream_line_count": "select count(*) as n from messages",
    "stream_word_count": """
        select batch_id, word, count(*) as n
        from (select cast(quarter // 2 as bigint) as batch_id, unnest(string_split(line, ' ')) as word
          from log_lines l join quarters q on l.line_no = q.event_id)
        group by batch_id, word""",
    "stream_fresh_lines": f"""
        select concat(day * 86400, '_', lpad(cast(day as varchar), 10, '0'), '_', half) as name, line
        from daily where k % 10 <> 0 and day % 5 <> 0 and {_NOW} < day * 86400 + 10""",
    "stream_unreadable_files": """
        select distinct concat('notes-', day, '_', half) as name from daily where k % 10 = 0 and day % 5 <> 0""",
    "stream_log_tail": """
        select quarter as batch_id, line_no, run_id, line from (
          select t.quarter, l.line_no, l.run_id, l.line, row_number() over (partition by t.quarter order by ts desc, line_no desc) as nth
          from log_lines l join quarters q on l.line_no = q.event_id
          join (select unnest(range(4)) as quarter) t on q.quarter <= t.quarter) where nth <= 500""",
    # Errors come one slice late; by then the newest other event of their slice or before has moved the watermark.
    "stream_late_rows": """
        select sec // 3600 * 3600 as batch_start_s,
          event_type = 'error' and (sec // 3600 * 3600 + 3600) * 1000000 <= newest_us - 3600000000 as is_late, count(*) as n
        from ev join quarters using (event_id)
        join (select t.quarter, max(us) as newest_us from ev join quarters q using (event_id)
          join (select unnest(range(4)) as quarter) t on q.quarter <= t.quarter where event_type <> 'error' group by t.quarter) using (quarter)
        group by all""",
    "stream_batch_counts": """
        select sec // 3600 * 3600 as batch_start_s, count(*) as n from messages group by sec // 3600""",
    "stream_remember_window": """
        select quarter as batch_id, count(*) as n from quarters where quarter < 3 group by quarter""",
    "stream_clean_source": """
        select count(*) as processed, count(*) filter (where quarter = 3) as still_there from quarters""",
    "stream_epoch_outcomes": "select * from outcomes",
    "stream_completed_delays": "select * from delays",
}
BODIES["parse_cost_udf"] = BODIES["parse_cost"]
BODIES["reduce_word_count"] = BODIES["word_count"]


# The same loop, waiting for a full run's batches before it raises the rate.
_FULL_RUN = {f"full_{name}": re.sub(r"\bn > 3\b", "n > 13", re.sub(r"\bfrom ruled\b", "from full_ruled", VIEWS[name])) for name in ("ruled", "decided")}
VIEWS |= _FULL_RUN
BODIES["full_run_decisions"] = "select * from full_decided"


def _needed(body: str) -> list[str]:
    """Views a query uses, directly or through other views, in the order they are defined."""
    wanted: set[str] = set()

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b(from|join)\s+{name}\b", text):
                wanted.add(name)
                add(VIEWS[name])

    add(body)
    return [name for name in VIEWS if name in wanted]


def oracle(name: str) -> str:
    views = [f"{view} as ({VIEWS[view]})" for view in _needed(BODIES[name])]
    return f"with {', '.join(views)} {BODIES[name]}" if views else BODIES[name]


ORACLE = {name: oracle(name) for name in BODIES}
