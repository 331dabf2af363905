"""The punctuated watermark against a loop over arrivals."""

import random

import pytest

from tideline.operators.lateness import punctuated_watermarks

COLUMNS = "arrival bigint, arrival_ms bigint, ts_ms bigint, value double"


def loop(rows, slide):
    """(arrival, watermark, boundary) of each move, one arrival after another."""
    boundary, moves = None, []
    for arrival, clock, time in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[2])):
        if boundary is None:
            boundary = clock - clock % slide + slide
        if time > boundary:
            boundary = time - time % slide + slide
            moves.append((arrival, time, boundary))
    return moves


def moves(spark, rows, slide):
    df = spark.createDataFrame([(*r, 0.5) for r in rows], COLUMNS)
    return sorted(tuple(r) for r in punctuated_watermarks(df, slide).collect())


@pytest.mark.parametrize("seed", range(12))
def test_random_feeds(spark, seed):
    rng = random.Random(seed)
    slide = rng.choice([2, 3, 5, 10])
    clock, rows = rng.randint(0, 30), []
    for i in range(rng.randint(1, 300)):
        clock += rng.choice([0, 0, 1, 1, 2, slide])
        back = rng.choice([0, 0, slide, 2 * slide])
        time = clock - back
        rows.append((i, clock, time - time % slide if rng.random() < 0.5 else time))
    assert moves(spark, rows, slide) == loop(rows, slide)


def test_every_row_ends_a_slide(spark):
    rows = [(i, 10 * i, 10 * i) for i in range(40)]
    assert moves(spark, rows, 10) == loop(rows, 10)
    assert len(loop(rows, 10)) < 40


def test_nulls_repeats_and_negative_times(spark):
    rows = [(0, -25, -25), (0, -25, -25), (1, None, 50), (None, 3, 99), (2, -8, None), (3, -4, -4), (4, 7, 7), (4, 7, 7), (5, 30, 30)]
    assert moves(spark, rows, 10) == loop(rows, 10)


def test_no_rows(spark):
    assert moves(spark, [], 10) == []
