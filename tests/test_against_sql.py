"""Queries beside their SQL on tables made for what the small test tables don't hold."""

from decimal import Decimal

import duckdb
import pytest

from tessera.plans import catalogue


@pytest.fixture
def both(spark, tmp_path):
    con = duckdb.connect(config={"threads": 1})

    def run(name, files=1, **tables):
        for table, sql in tables.items():
            (tmp_path / f"{table}.parquet").mkdir()
            con.execute(f"CREATE TEMP TABLE t_{table} AS {sql}")
            n = con.execute(f"SELECT count(*) FROM t_{table}").fetchall()[0][0]
            for k in range(files):
                con.execute(f"COPY (SELECT * FROM t_{table} LIMIT {n * (k + 1) // files - n * k // files} OFFSET {n * k // files}) TO '{tmp_path}/{table}.parquet/{k}.parquet'")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = catalogue.queries()[name](spark, str(tmp_path))
        plain = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, Decimal) else v for v in row)) for row in rows)
        return plain(df.collect()), plain(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracles()[name]})").fetchall())

    return run


def test_means_on_a_limit(both):
    """A user's events are spread over files, and many means lie on the limit or between two roundings."""
    got, want = both("colour_proposal", files=4, events="SELECT i AS event_id, (hash(i) % 2000)::BIGINT AS user_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 'view' AS event_type, (hash(i + 7) % 10000) / 100 AS value, '' AS props FROM range(80000) r(i)")
    assert not set(got) ^ set(want)


def test_means_of_repeated_and_endless_samples(both):
    """a mean that is endless, no number or beyond a long was cut to a long when it was rounded. Identifiers repeat here, and all their samples count."""
    events = "SELECT i % 500 AS event_id, (i % 500 % 7)::BIGINT AS user_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 'view' AS event_type, CASE i % 500 WHEN 3 THEN 'inf'::DOUBLE WHEN 4 THEN 'nan'::DOUBLE WHEN 5 THEN 1e20 ELSE (hash(i) % 640) * 7.8125 END AS value, '' AS props FROM range(1500) r(i)"
    got, want = both("colour_proposal", events=events)
    assert got == want and len(got) == 7 and any("nan" in row for row in got) and any("inf" in row for row in got)


def test_words_end_at_letters_beyond_ascii(both):
    got, want = both("rule_intents", conversations="SELECT i AS conv_id, 0 AS turn, 'user' AS role, t AS text FROM (VALUES (1, 'ge undüber 12'), (2, 'éde 3'), (3, 'Thé'), (4, 'and_the'), (5, 'DE.')) v(i, t)")
    assert got == want and "(1, 0, 'move', '12')" in got


@pytest.mark.parametrize("name", ["asof_word_sample", "asof_frame_word", "interval_confidence", "beat_window", "widened_window", "face_window_stats"])
def test_words_meet_samples_of_other_numbers(both, name):
    """Ten sources are shared, so words of conversations without a user of their number meet samples, hundreds of words at one time."""
    events = "SELECT i AS event_id, (i % 37 + 100)::BIGINT AS user_id, TIMESTAMP '2024-01-01' + to_seconds(i * 40) AS ts, ['view', 'error', 'purchase', 'click'][(hash(i) % 4 + 1)::BIGINT] AS event_type, (hash(i + 7) % 10000) / 100 AS value, '' AS props FROM range(9000) r(i)"
    talk = "SELECT c AS conv_id, turn, 'user' AS role, 'one word and another, all of them short' AS text FROM range(150) r(c), range(3) s(turn)"
    got, want = both(name, events=events, conversations=talk)
    assert got == want and len(got) > 500
