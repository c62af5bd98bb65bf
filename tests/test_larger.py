"""Queries against their SQL on tables larger in one respect than the test tables are."""

import duckdb

from seriescope.plans import catalogue
from seriescope.plans.spec import load
from seriescope.streaming import job

#: Four generations of half a day, 211 users (more than the limit of 60), 4,001 series that come back.
MANY_SERIES = """select i as event_id, timestamp '2024-01-01' + to_seconds(i * 15) as ts, i % 4001 * 7919 % 211 as user_id, ['view', 'click', 'error'][1 + i % 4001 % 3] as event_type,
    1.0 as value, '{"k": ' || i % 4001 % 1009 || '}' as props from range(9000) t(i)"""


def compare(spark, folder, name, events):
    """Rows of the query and of its SQL over ``events`` (a select statement)."""
    db = duckdb.connect()
    db.sql(f"copy ({events}) to '{folder}/events.parquet'")
    db.sql(f"create view events as select * from '{folder}/events.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    want = db.sql(catalogue.ORACLE_SQL[name]).project(", ".join(f'"{c}"' for c in df.columns)).fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


def test_more_groups_than_the_default_limit(spark, tmp_path):
    events = """select i as event_id, timestamp '2024-01-01' + to_seconds(i) as ts, i % 10007 as user_id, ['view', 'click'][1 + i % 2] as event_type,
        1.0 as value, '{"k": ' || i % 5 || '}' as props from range(12000) t(i)"""
    got, want = compare(spark, tmp_path, "multi_stream_cardinality", events)
    assert len(want) == 1 + 2 + 10_007 and got == want


def test_lines_count_more_series_than_a_small_sketch_holds(spark, tmp_path):
    got, want = compare(spark, tmp_path, "requests_to_lines", MANY_SERIES)
    assert ('cardinality_estimate{interval="24h0m0s",group_by_keys="__global__"} 3200',) in want and got == want


def test_exact_job_in_steps(spark, tmp_path):
    """However requests are dealt to steps (within a generation, by generations), the lines are those of the SQL."""
    db = duckdb.connect()
    db.sql(f"copy ({MANY_SERIES}) to '{tmp_path}/events.parquet'")
    db.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = sorted(db.sql(catalogue.ORACLE_SQL["requests_to_lines"]).fetchall())
    requests = catalogue._requests(spark, str(tmp_path)).localCheckpoint()
    said, start, cuts = [], 0, [20, 58, 75, 90]
    step = job.stepper(str(tmp_path / "job"), load(catalogue.CONFIG), lambda out, epoch: said.append(sorted(map(tuple, out.collect()))), exact=True)
    for epoch, end in enumerate(cuts):
        step(requests.where(f"request >= {start} and request < {end}"), epoch)
        start = end
    step(requests.where(f"request >= {cuts[-2]}"), len(cuts) - 1)  # a step that is repeated
    assert said[-2] == want and said[-1] == want
