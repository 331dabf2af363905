"""SQL for the registered queries, to be run by another engine on the same tables."""

from __future__ import annotations

import math

DAY = 86_400_000_000
ROAD = 60 * DAY
HOUR_MS = 3_600_000
DAY_MS = 86_400_000


# Milliseconds are cut, not rounded: rounding could move a row into the next window.


def _start(us: int, time: str = "event_time") -> str:
    return f"make_timestamp(epoch_us({time}) // {us} * {us})"


def _win(us: int, time: str = "event_time") -> str:
    return (
        f"{_start(us, time)} AS window_start,"
        f" make_timestamp(epoch_us({time}) // {us} * {us} + {us}) AS window_end"
    )


VEHICLES = f"""vehicles AS (
  SELECT l_shipdate AS event_time, CAST(l_suppkey AS INTEGER) AS car_id,
         CAST(l_quantity AS INTEGER) AS speed, l_linenumber % 2 AS lane, 0 AS dir,
         CAST(l_suppkey % 25 AS INTEGER) AS abs_seg,
         CAST(l_suppkey % 25 * 5280 + l_partkey % 4 AS INTEGER) AS pos,
         ((l_orderkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT)) * 4096
           + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS arrival,
         {_win(ROAD, 'l_shipdate')}
  FROM lineitem)"""

PRICES = f"""prices AS (
  SELECT user_id AS symbol, value AS price, ts AS event_time, event_id AS arrival,
         (epoch_us(ts) // 1000) AS ts_ms, {_win(DAY, 'ts')}
  FROM events)"""

STOPPED = """stopped AS (
  SELECT window_start, window_end, car_id, abs_seg, lane, pos, count(*) AS n,
         arg_min(speed, arrival) AS first_speed, arg_max(speed, arrival) AS last_speed,
         arg_min(dir, arrival) AS dir
  FROM vehicles GROUP BY ALL HAVING count(*) >= 4)"""

SPEED = """speeds AS (
  SELECT window_start, window_end, abs_seg, count(*) AS n,
         CAST(sum(speed) // count(*) AS BIGINT) AS avg_speed
  FROM vehicles GROUP BY ALL)"""

ACCIDENTS = """accidents AS (
  SELECT window_start, window_end, abs_seg, lane, pos, count(*) AS vehicles
  FROM stopped GROUP BY ALL HAVING count(*) >= 2)"""

TOLLS = f"""WITH {VEHICLES}, {STOPPED}, {SPEED}, {ACCIDENTS}
SELECT s.window_start, s.window_end, s.abs_seg,
       CASE WHEN s.avg_speed > 40 OR s.n <= 50 OR a.abs_seg IS NOT NULL THEN 0.0::DOUBLE
            ELSE 2 * pow(s.n - 50, 2) END AS toll
FROM speeds s LEFT JOIN (SELECT DISTINCT window_start, abs_seg FROM accidents) a
  ON a.window_start = s.window_start AND a.abs_seg = s.abs_seg"""

WARNINGS = """warnings AS (
  SELECT window_start, window_end, symbol, price, event_time, arrival
  FROM (SELECT *, lead(price) OVER (PARTITION BY symbol, window_start ORDER BY arrival) AS nxt
        FROM prices)
  WHERE nxt IS NOT NULL
    AND CASE WHEN nxt = 0 THEN price <> 0 ELSE abs(price / nxt - 1) > 0.05 END)"""

COUNTS = """w AS (SELECT window_start, window_end, symbol, count(*) AS count
               FROM warnings GROUP BY ALL),
     m AS (SELECT p.window_start, p.window_end, p.symbol, count(*) AS count
           FROM prices p JOIN events e ON e.event_id = p.arrival
           WHERE e.event_type = 'view' GROUP BY ALL)"""

FULL = """both_sides AS (
  SELECT coalesce(w.window_start, m.window_start) AS window_start,
         coalesce(w.window_end, m.window_end) AS window_end,
         coalesce(w.symbol, m.symbol) AS symbol, w.count AS wc, m.count AS mc
  FROM w FULL JOIN m ON w.window_start = m.window_start AND w.symbol = m.symbol)"""

MIRROR = (
    "SELECT window_start, window_end, symbol, coalesce(wc, mc) AS warnings,"
    " coalesce(mc, wc) AS tweets FROM both_sides"
)
INNER = (
    "SELECT w.window_start, w.window_end, w.symbol, w.count AS warnings, m.count AS tweets"
    " FROM w JOIN m ON w.window_start = m.window_start AND w.symbol = m.symbol"
)
PAIRS = f"WITH {PRICES}, {WARNINGS}, {COUNTS}, {FULL} "

UTTERANCES = """utterances AS (
  SELECT conv_id // 10 AS bucket, conv_id, turn, text, rtrim(text, ' ') AS trimmed
  FROM conversations)"""

# No words for a text of blanks only; one empty word for the empty text.
WORDS = f"""{UTTERANCES}, words AS (
  SELECT *, CASE WHEN length(text) > 0 AND trimmed = '' THEN [] ELSE string_split(trimmed, ' ') END AS w
  FROM utterances)"""

BIGRAMS = f"""{WORDS}, grams AS (
  SELECT bucket, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]) END) AS ngram
  FROM words), bigrams AS (SELECT bucket, ngram, count(*) AS n FROM grams GROUP BY ALL)"""


MOVED = "CASE WHEN p.price = 0 THEN s.ref <> 0 ELSE abs(s.ref / p.price - 1) > 0.05 END"


def _recursive_delta(partition: str, moved: str = MOVED) -> str:
    same = " AND ".join(f"p.{c} = s.{c}" for c in partition.split(", "))
    return f"""{PRICES}, p AS (
  SELECT *, row_number() OVER (PARTITION BY {partition} ORDER BY arrival) AS rn FROM prices),
s AS (
  SELECT symbol, price, event_time, arrival, ts_ms, window_start, window_end, rn,
         price AS ref, false AS fired
  FROM p WHERE rn = 1
  UNION ALL
  SELECT p.symbol, p.price, p.event_time, p.arrival, p.ts_ms, p.window_start, p.window_end, p.rn,
         CASE WHEN {moved} THEN p.price ELSE s.ref END, {moved}
  FROM s JOIN p ON {same} AND p.rn = s.rn + 1)"""


GAPS = f"""WITH {PRICES}, g AS (
  SELECT window_start, window_end, symbol, arrival, ts_ms - lag(ts_ms) OVER w AS gap,
         CASE WHEN price > lag(price) OVER w THEN 0 ELSE 1 END AS fresh
  FROM prices WINDOW w AS (PARTITION BY symbol, window_start ORDER BY arrival)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, window_start ORDER BY arrival) AS run FROM g),
c AS (SELECT *, count(*) OVER (PARTITION BY symbol, window_start, run) AS len FROM r)
SELECT symbol, window_start, window_end, count(*) AS n, CAST(median(gap) AS DOUBLE) AS median_gap_ms,
       max(len) AS longest_rise FROM c GROUP BY ALL"""

FEED_TOTALS = """SELECT event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total
FROM events GROUP BY ALL"""


def _dft(inverse: bool) -> str:
    sign, scale = ("-", " / n") if inverse else ("", "")
    return f"""WITH x AS (
  SELECT event_type, CAST(ts AS DATE) AS day, value,
         row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY event_id) - 1 AS j,
         count(*) OVER (PARTITION BY event_type, CAST(ts AS DATE)) AS m
  FROM events),
padded AS (SELECT *, CAST(pow(2, ceil(log2(m))) AS BIGINT) AS n FROM x),
bins AS (SELECT *, unnest(range(n)) AS bin FROM padded),
spectrum AS (
  SELECT event_type, day, bin,
         sum(value * cos(2 * pi() * ((j * bin) % n) / n){scale}) AS re,
         sum({sign}value * sin(2 * pi() * ((j * bin) % n) / n){scale}) AS im
  FROM bins GROUP BY ALL)
SELECT event_type, day, bin, round(re + 1e-9, 6) + 0.0 AS re, round(im + 1e-9, 6) + 0.0 AS im,
       CAST(trunc(round(re, 6)) AS INTEGER) AS re_int FROM spectrum"""


LATE = f"""late AS (
  SELECT *, CASE WHEN start_ms + {DAY_MS - 1} + {23 * HOUR_MS} <= wm THEN 'dropped'
                 WHEN start_ms + {DAY_MS - 1} <= wm THEN 'late' ELSE 'on_time' END AS lateness
  FROM (SELECT event_type AS key, value,
               ((epoch_us(ts) // 1000) - event_id % 4 * {12 * HOUR_MS}) // {DAY_MS} * {DAY_MS} AS start_ms,
               (epoch_us(ts) // 1000) // {HOUR_MS} * {HOUR_MS} AS wm
        FROM events))"""


def _skew() -> str:
    cdf = [0.5 * (1 + math.erf(math.log(k + 1.5) / math.sqrt(2))) for k in range(4)]
    steps = " + ".join(f"CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in cdf[:-1])
    return f"""SELECT event_id, ts_ms, ts_ms - ({steps}) * CAST({DAY_MS} AS BIGINT) AS event_ms
FROM (SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms,
             (event_id % 2147483648 * 2654435761 % 4294967296) / 4294967296.0::DOUBLE
               * {cdf[3]!r}::DOUBLE AS u
      FROM events)"""


RECORDS = f"""records AS (
  SELECT concat_ws(' ', event_type, user_id % 10, event_type) AS text,
         CAST(trunc(value) AS INTEGER) AS key, event_id AS arrival, {_win(DAY, 'ts')}
  FROM events)"""

MEAN_BY_VALUE = f"""WITH {RECORDS}
SELECT window_start, window_end, key, arg_min(text, arrival) AS text, count(*) AS n,
       CAST(sum(key) // count(*) AS BIGINT) AS mean_value FROM records GROUP BY ALL"""

WINDOW_BIGRAMS = f"""WITH {RECORDS},
w AS (SELECT window_start, window_end, string_split(text, ' ') AS w FROM records)
SELECT window_start, window_end, ngram, count(*) AS n
FROM (SELECT window_start, window_end, unnest([w[1] || w[2], w[2] || w[3]]) AS ngram FROM w)
GROUP BY ALL"""

SPECTRUM = f"""WITH {RECORDS}, x AS (
  SELECT *, row_number() OVER (PARTITION BY window_start, key ORDER BY arrival) - 1 AS j,
         count(*) OVER (PARTITION BY window_start, key) AS m,
         last_value(text) OVER (PARTITION BY window_start, key ORDER BY arrival
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS label
  FROM records),
padded AS (SELECT *, CAST(pow(2, ceil(log2(m))) AS BIGINT) AS n FROM x),
bins AS (SELECT *, unnest(range(n)) AS bin FROM padded),
spectrum AS (
  SELECT window_start, window_end, key, bin, label AS text,
         sum(key * cos(2 * pi() * ((j * bin) % n) / n)) AS re,
         sum(key * sin(2 * pi() * ((j * bin) % n) / n)) AS im
  FROM bins GROUP BY ALL)
SELECT window_start, window_end, key, bin, text, round(re + 1e-9, 6) + 0.0 AS re,
       round(im + 1e-9, 6) + 0.0 AS im, CAST(trunc(round(re, 6)) AS INTEGER) AS re_int
FROM spectrum"""


def _complex() -> str:
    # a = v + iw, b = u
    exprs = {
        "p_re": "v + u", "p_im": "w", "m_re": "v - u", "m_im": "w",
        "t_re": "v * v - w * w", "t_im": "v * w + w * v", "s_re": "v * 0.5", "s_im": "w * 0.5",
        "q_re": "v / 4", "q_im": "w / 4", "e_re": "exp(v * 0.001) * cos(w * 0.001)",
        "e_im": "exp(v * 0.001) * sin(w * 0.001)",
    }
    columns = ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in exprs.items())
    return f"""SELECT event_id, {columns} FROM (
      SELECT event_id, value AS v, user_id / 8 AS w, user_id / 4 AS u FROM events)"""


def _stopped(which: str) -> str:
    return f"""WITH {VEHICLES}, {STOPPED}
SELECT window_start, window_end, car_id, abs_seg, lane, pos, {which}_speed AS speed, dir, n
FROM stopped"""


def _stream_panes() -> str:
    last = f"start_ms + {DAY_MS - 1}"
    late = 23 * HOUR_MS
    return f"""WITH f AS (
  SELECT event_type AS key, value,
         CAST(trunc(event_id * 3 / (SELECT max(event_id) + 1 FROM events)) AS INTEGER) AS part,
         epoch_us(ts) // 1000 - event_id % 4 * {12 * HOUR_MS} AS ms FROM events),
latest AS (SELECT part, max(ms) AS mx FROM f GROUP BY part),
marks AS (SELECT a.part, (SELECT max(b.mx) FROM latest b WHERE b.part < a.part) AS wm FROM latest a),
c AS (
  SELECT key, value, start_ms,
         CASE WHEN wm IS NULL THEN 'on_time' WHEN {last} + {late} <= wm THEN 'dropped'
              WHEN {last} <= wm THEN 'late' ELSE 'on_time' END AS lateness
  FROM (SELECT f.*, ms // {DAY_MS} * {DAY_MS} AS start_ms, wm FROM f JOIN marks USING (part)))
SELECT key, start_ms AS window_start_ms, 'on_time' AS pane, count(*) AS n,
       round(sum(value), 6) + 0.0 AS total
FROM c WHERE lateness = 'on_time' GROUP BY ALL
UNION ALL
SELECT key, start_ms, 'final', count(*), round(sum(value), 6) + 0.0
FROM c WHERE lateness <> 'dropped' GROUP BY ALL"""


def all_sql() -> dict[str, str]:
    throughput = (
        "SELECT {w}, count(*) AS n, count(*) // {s} AS per_second FROM events GROUP BY ALL"
    )
    correlation = PAIRS + f"""SELECT window_start, window_end,
        round(CASE WHEN stddev_pop(warnings) * stddev_pop(tweets) > 0
              THEN covar_pop(warnings, tweets) / (stddev_pop(warnings) * stddev_pop(tweets))
              ELSE 'NaN'::DOUBLE END, 6) + 0.0 AS correlation
        FROM ({MIRROR}) GROUP BY ALL"""
    prices_with = f"WITH {PRICES}, {WARNINGS}"
    return {
        "segment_speed": f"WITH {VEHICLES}, {SPEED} SELECT * FROM speeds",
        "stopped_vehicles": _stopped("first"),
        "stopped_vehicles_last": _stopped("last"),
        "accidents": f"WITH {VEHICLES}, {STOPPED}, {ACCIDENTS} SELECT * FROM accidents",
        "toll_by_segment": TOLLS,
        "toll_from_parts": TOLLS,
        "fan_out": f"""WITH {VEHICLES} SELECT event_time, speed, abs_seg, arrival,
            unnest([1, 2, 3]) AS car_id FROM vehicles""",
        "price_warnings": f"{prices_with} SELECT * FROM warnings",
        "warnings_per_symbol": PAIRS + "SELECT * FROM w",
        "mentions_per_symbol": PAIRS + "SELECT * FROM m",
        "count_pairs_mirror": PAIRS + MIRROR,
        "count_pairs_zero": PAIRS + """SELECT window_start, window_end, symbol,
            coalesce(wc, 0) AS warnings, coalesce(mc, 0) AS tweets FROM both_sides""",
        "count_pairs_inner": PAIRS + INNER,
        "cogrouped_counts": PAIRS + MIRROR,
        "joined_counts": PAIRS + INNER,
        "correlation_by_window": correlation,
        "word_mentions": f"""WITH {WORDS}
            SELECT bucket, symbol, count(*) AS count FROM (
              SELECT bucket, upper(replace(unnest(w), 'ß', 'ss')) AS symbol FROM words)
            GROUP BY ALL""",
        "symbol_filter": f"""WITH {PRICES} SELECT symbol, price, event_time, arrival FROM prices
            WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
        "symbol_list_filter": f"""WITH {PRICES} SELECT symbol, price, event_time, arrival
            FROM prices WHERE symbol IN (3, 7, 11)""",
        "union_feeds": """SELECT user_id AS symbol, value AS price FROM events
            WHERE event_type IN ('signup', 'click', 'view', 'purchase', 'error')
            UNION ALL SELECT l_suppkey, l_extendedprice FROM lineitem""",
        "rolling_mean": f"""WITH {PRICES} SELECT window_start, window_end, symbol,
            round(avg(price), 6) + 0.0 AS price, window_end - INTERVAL 1 MILLISECOND AS ts
            FROM prices GROUP BY ALL""",
        "lowest_price": f"""WITH {PRICES} SELECT window_start, window_end, symbol, price, arrival
            FROM prices QUALIFY row_number() OVER (
              PARTITION BY symbol, window_start ORDER BY price, arrival) = 1""",
        "highest_price": f"""WITH {PRICES} SELECT window_start, window_end, symbol, price, arrival
            FROM prices QUALIFY row_number() OVER (
              PARTITION BY symbol, window_start ORDER BY price DESC, arrival) = 1""",
        "sliding_mean": f"""WITH {PRICES}, slid AS (
              SELECT symbol, price, unnest(range(4)) AS back, {_start(DAY // 4)} AS s FROM prices)
            SELECT s - back * INTERVAL 6 HOUR AS window_start,
                   s - back * INTERVAL 6 HOUR + INTERVAL 1 DAY AS window_end,
                   symbol, count(*) AS n, round(avg(price), 6) + 0.0 AS mean_price
            FROM slid GROUP BY ALL""",
        "sliding_mean_uneven": f"""WITH {PRICES}, slid AS (
              SELECT symbol, price, event_time, {_start(DAY // 6)} - unnest(range(3)) * INTERVAL 4 HOUR AS s
              FROM prices)
            SELECT s AS window_start, s + INTERVAL 10 HOUR AS window_end, symbol, count(*) AS n,
                   round(avg(price), 6) + 0.0 AS mean_price
            FROM slid WHERE event_time < s + INTERVAL 10 HOUR GROUP BY ALL""",
        "first_of_window": f"""WITH {PRICES} SELECT window_start, window_end, symbol,
            arg_min(price, arrival) AS price, arg_min(event_time, arrival) AS event_time
            FROM prices GROUP BY ALL""",
        "absolute_delta_trigger": f"""WITH RECURSIVE {_recursive_delta('symbol', 'abs(s.ref - p.price) > 25')}
            SELECT symbol, price, event_time, arrival FROM s WHERE fired""",
        "gaps_by_window": GAPS,
        "observed_counts": f"""SELECT {_win(DAY, 'ts')}, count(*) AS n, any_value(t.records) AS records,
            any_value(t.dear) AS dear, any_value(t.newest) AS newest
            FROM events, (SELECT count(*) AS records, count(*) FILTER (value > 50) AS dear,
              max(event_id) AS newest FROM events) t GROUP BY 1, 2""",
        "delta_trigger": f"""WITH RECURSIVE {_recursive_delta('symbol')}
            SELECT symbol, price, event_time, arrival FROM s WHERE fired""",
        "window_delta_trigger": f"""WITH RECURSIVE {_recursive_delta('symbol, window_start')}
            SELECT window_start, window_end, symbol, price, event_time, arrival FROM s WHERE fired""",
        "window_delta_first": f"""WITH RECURSIVE {_recursive_delta('symbol, window_start')}
            SELECT o.window_start, o.window_end, o.symbol, o.price, o.event_time, o.arrival,
                   s.arrival AS fired_arrival
            FROM s JOIN p o ON o.symbol = s.symbol AND o.window_start = s.window_start AND o.rn = 1
            WHERE s.fired""",
        "evictor_delta": f"""WITH RECURSIVE {_recursive_delta('symbol')}
            SELECT f.symbol, f.price, f.arrival, f.ts_ms, min(q.arrival) AS first_arrival,
                   arg_min(q.ts_ms, q.arrival) AS first_ts_ms,
                   arg_min(q.price, q.arrival) AS first_price
            FROM s f JOIN prices q ON q.symbol = f.symbol AND q.arrival <= f.arrival
                 AND q.ts_ms > f.ts_ms - {6 * HOUR_MS}
            WHERE f.fired GROUP BY f.symbol, f.price, f.arrival, f.ts_ms""",
        "int_mean_by_bucket": f"""WITH {UTTERANCES} SELECT bucket,
            arg_min(text, conv_id * 4096 + turn) AS text, count(*) AS n,
            CAST(sum(length(text)) // count(*) AS BIGINT) AS mean_value
            FROM utterances GROUP BY bucket""",
        "elements_per_window": f"SELECT {_win(DAY, 'ts')}, count(*) AS n FROM events GROUP BY ALL",
        "throughput": throughput.format(w=_win(1_000_000, "ts"), s=1),
        "throughput_3s": throughput.format(w=_win(3_000_000, "ts"), s=3),
        "running_total": f"""WITH daily AS (
              SELECT {_win(DAY, 'ts')}, event_type, sum(value) AS total FROM events GROUP BY ALL)
            SELECT window_start, window_end, event_type, round(total, 6) + 0.0 AS total,
                   round(sum(total) OVER (PARTITION BY event_type ORDER BY window_start), 6) + 0.0
                     AS running FROM daily""",
        "counter_rates": """WITH c AS (
              SELECT event_type AS host, (epoch_us(ts) // 1000) AS ts_ms, event_id * 4096 AS read_bytes,
                     event_id * 512 AS write_bytes, event_id AS arrival FROM events),
            d AS (SELECT *, (ts_ms - lag(ts_ms) OVER w) // 1000 AS secs,
                         read_bytes - lag(read_bytes) OVER w AS r,
                         write_bytes - lag(write_bytes) OVER w AS wr
                  FROM c WINDOW w AS (PARTITION BY host ORDER BY arrival))
            SELECT host, ts_ms, read_bytes, write_bytes, arrival,
                   CASE WHEN secs > 0 THEN r // secs ELSE 0 END AS read_bytes_rate,
                   CASE WHEN secs > 0 THEN wr // secs ELSE 0 END AS write_bytes_rate FROM d""",
        "squares_per_window": f"""SELECT {_win(DAY, 'ts')}, count(*) AS n,
            round(sum(value * value), 2) AS squares FROM events GROUP BY ALL""",
        "bigram_counts": f"WITH {BIGRAMS} SELECT * FROM bigrams",
        "top_bigrams": f"""WITH {BIGRAMS} SELECT *, CAST(row_number() OVER (
              PARTITION BY bucket ORDER BY n DESC, ngram) AS INTEGER) AS rank
            FROM bigrams QUALIFY rank <= 10""",
        "dft_by_window": _dft(False),
        "inverse_dft": _dft(True),
        "complex_numbers_as_text": """WITH c AS (
              SELECT event_id, printf('%.3f', CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE value END) AS a,
                     value - floor(value) - 0.5::DOUBLE AS im FROM events),
            d AS (SELECT *, printf('%.3f', abs(im)) AS b FROM c)
            SELECT event_id, CASE WHEN b = '0.000' THEN a WHEN a = '0.000' THEN b || 'i'
              WHEN im > 0 THEN a || ' + ' || b || 'i' ELSE a || ' - ' || b || 'i' END AS c FROM d""",
        "complex_arithmetic": _complex(),
        "mean_by_value": MEAN_BY_VALUE,
        "bigrams_by_window": WINDOW_BIGRAMS,
        "spectrum_by_value": SPECTRUM,
        "late_classification": f"""WITH {LATE} SELECT lateness, start_ms AS window_start_ms,
            count(*) AS n FROM late GROUP BY ALL""",
        "punctuated_watermark": f"""WITH RECURSIVE feed AS (
              SELECT event_id AS arrival, epoch_us(ts) // 1000 AS arrival_ms,
                     epoch_us(ts) // 1000 - (event_id % 4) * 12 * {HOUR_MS} AS ts_ms FROM events),
            moves AS (
              SELECT arrival, CAST(NULL AS BIGINT) AS watermark_ms,
                     (arrival_ms // {2 * HOUR_MS} + 1) * {2 * HOUR_MS} AS boundary_ms
              FROM (SELECT * FROM feed ORDER BY arrival, ts_ms LIMIT 1)
              UNION ALL
              SELECT x.arrival, x.ts_ms, (x.ts_ms // {2 * HOUR_MS} + 1) * {2 * HOUR_MS}
              FROM (SELECT arg_min(f, f.arrival) AS x FROM moves m, feed f
                    WHERE f.arrival > m.arrival AND f.ts_ms > m.boundary_ms) WHERE x IS NOT NULL)
            SELECT * FROM moves WHERE watermark_ms IS NOT NULL""",
        "pane_counts": f"""WITH {LATE}
            SELECT start_ms AS window_start_ms, key, 'on_time' AS pane, count(*) AS n,
                   round(sum(value), 6) + 0.0 AS total
            FROM late WHERE lateness = 'on_time' GROUP BY ALL
            UNION ALL
            SELECT start_ms, key, 'final', count(*), round(sum(value), 6) + 0.0
            FROM late WHERE lateness <> 'dropped' GROUP BY ALL""",
        "firing_log_rows": f"""WITH {LATE}
            SELECT pane, make_timestamp((start_ms + {DAY_MS}) * 1000) AS window_end FROM (
              SELECT DISTINCT 'on_time' AS pane, start_ms, key FROM late WHERE lateness = 'on_time'
              UNION ALL
              SELECT DISTINCT 'final', start_ms, key FROM late WHERE lateness <> 'dropped')""",
        "window_log_rows": f"""SELECT epoch_us(window_end) // 1000 - 1 AS max_ts, n
            FROM (SELECT {_win(DAY, 'ts')}, count(*) AS n FROM events GROUP BY ALL)""",
        "skewed_event_time": _skew(),
        "stock_lines": """SELECT event_id AS arrival, 'SYM' || user_id AS symbol, value AS price,
            (epoch_us(ts) // 1000) AS ts, make_timestamp((epoch_us(ts) // 1000) * 1000) AS event_time FROM events""",
        "stock_lines_permissive": """SELECT event_id AS arrival, 'SYM' || user_id AS symbol,
            value AS price, (epoch_us(ts) // 1000) AS ts, make_timestamp((epoch_us(ts) // 1000) * 1000) AS event_time
            FROM events WHERE event_id % 7 <> 0""",
        "tweet_lines": f"""SELECT {_win(DAY, 'ts')}, symbol, count(*) AS count
            FROM (SELECT ts, unnest(['SYM' || user_id, upper(event_type)]) AS symbol FROM events)
            GROUP BY ALL""",
        "triple_lines": """SELECT event_id AS arrival, event_type AS text,
            CAST(user_id AS INTEGER) AS value, event_id AS seq FROM events""",
        "vehicle_lines": f"""WITH {VEHICLES}
            SELECT arrival, (epoch_us(event_time) // 1000) AS time, car_id, speed, 1 AS xway, lane, dir,
                   abs_seg AS seg, pos, 100 + abs_seg AS abs_seg, event_time
            FROM vehicles WHERE lane = 0""",
        # Streams are fed a row of far-future time at the end, so all windows are closed.
        "stream_two_panes": _stream_panes(),
        "stream_segment_speed": f"WITH {VEHICLES}, {SPEED} SELECT * FROM speeds",
        "stream_tolls": TOLLS,
        "stream_correlation": correlation,
        "stream_joined_counts": PAIRS + INNER,
        "stream_price_warnings": f"""{prices_with}
            SELECT symbol, price, make_timestamp(epoch_us(event_time)) AS event_time, arrival,
                   epoch_us(window_start) // 1000 AS window_start_ms FROM warnings""",
        "stream_mean_by_value": MEAN_BY_VALUE,
        "stream_bigrams": WINDOW_BIGRAMS,
        "stream_lines_to_csv": """SELECT 'SYM' || user_id AS symbol, value AS price,
            (epoch_us(ts) // 1000) AS ts, make_timestamp((epoch_us(ts) // 1000) * 1000) AS event_time FROM events""",
        "stream_running_total": FEED_TOTALS,
        "stream_processing_time": FEED_TOTALS,
        "stream_delta_trigger": f"""WITH RECURSIVE {_recursive_delta('symbol')}
            SELECT symbol, price, event_time, arrival FROM s WHERE fired""",
        "text_lines": """SELECT conv_id, turn, CAST(length(text) + 3501 AS INTEGER) AS width, text,
            1 AS value FROM conversations WHERE length(text) > 0""",
    }
