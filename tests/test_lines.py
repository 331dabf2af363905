import pytest
from pyspark.sql import functions as F

from tideline.sources import lines, sinks


def feed(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_stock_line(spark):
    row = lines.stock_prices(feed(spark, "SYM17 1003.25 1487000000000")).first()
    assert (row.symbol, row.price, row.ts) == ("SYM17", 1003.25, 1487000000000)


def test_tweet_line_keeps_the_blank_before_the_time(spark):
    row = lines.tweets(feed(spark, "SYM1 SYM7 1487000000000")).first()
    assert (row.text, row.ts) == ("SYM1 SYM7 ", 1487000000000)


def test_mentions_are_upper_case_words(spark):
    tweets = lines.tweets(feed(spark, "sym1  Sym7 1487000000000"))
    got = [r.symbol for r in lines.symbol_mentions(tweets).collect()]
    assert got == ["SYM1", "", "SYM7"]


def test_vehicle_line(spark):
    line = "0,7,193,21,2,0,1,43,227378,-1,-1,-1,-1,-1,-1"
    row = lines.with_location(lines.vehicle_reports(feed(spark, line, "2,x"))).collect()
    assert len(row) == 1
    assert (row[0].car_id, row[0].speed, row[0].abs_seg) == (193, 21, 243)
    assert tuple(row[0].location) == (243, 0, 227378)


def test_triple_needs_exactly_three_words(spark):
    good, bad = "XXXX 1 42", "XXXX 1 42 7"
    assert lines.triples(feed(spark, good)).first().value == 1
    with pytest.raises(Exception, match="malformed line"):
        lines.triples(feed(spark, bad)).collect()
    assert lines.triples(feed(spark, good, bad, "a b 1"), permissive=True).count() == 1


def test_texts_drop_empty_lines_and_pad(spark):
    got = lines.texts(feed(spark, "ab", ""), padding=3).collect()
    assert [(r.text, r.value) for r in got] == [("ab XXX", 1)]


def test_fan_out_and_payload(spark):
    df = spark.createDataFrame([(9, 1)], "car_id int, speed int")
    got = lines.with_payload(lines.fan_out(df, 3), 5).collect()
    assert sorted(r.car_id for r in got) == [1, 2, 3]
    assert {r.payload for r in got} == {"XXXXX"}


def test_symbol_filters(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "symbol string")
    listed = spark.createDataFrame([("b",), ("b",), ("c",)], "symbol string")
    assert lines.only_symbols(df, listed).count() == 2
    assert lines.only_symbols(df, ["a"]).count() == 1


def test_text_dump_and_logs(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    sinks.dump_text(feed(spark, "x", "y"), src)
    assert sorted(r.value for r in lines.read_lines(spark, src).collect()) == ["x", "y"]
    stream = lines.stream_lines(spark, src)
    sinks.bounded_run(sinks.dump_text(stream, out, str(tmp_path / "ck"))).awaitTermination()
    assert lines.read_lines(spark, out).count() == 2

    counts = spark.sql("select timestamp '1970-01-01 00:00:10' as window_end, 4L as n")
    assert sinks.window_log(counts).first() == (9999, 4)
    sinks.append_csv(sinks.window_log(counts), str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["9999,4"]
    panes = counts.select(F.lit("final").alias("pane"), "window_end", "n")
    assert sinks.firing_log(panes).columns == ["pane", "window_end"]


def test_memory_sink(spark, tmp_path):
    src = str(tmp_path / "src")
    sinks.dump_text(feed(spark, "x", "y", ""), src)
    texts = lines.texts(lines.stream_lines(spark, src, max_files=1))
    sinks.bounded_run(sinks.memory(texts, "texts_out")).awaitTermination()
    assert spark.table("texts_out").count() == 2
