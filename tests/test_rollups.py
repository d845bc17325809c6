"""D1-D3 from states: equal to full runs, whatever the order and repetition of loads; an added month writes one partition."""

import datetime as dt
import random

from pyspark.sql import functions as F

from contactrank.operators import portfolio as D
from contactrank.operators import rollups as U

VALUES = "fund string, as_of date, value double"
ACTIVITY = "company_id int, sector string, as_of date, active boolean"


def day(k):
    return dt.date(2022, 11, 3) + dt.timedelta(days=k)


def written(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_sums(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["I", "II", None]), day(rng.randrange(500)), float(rng.randrange(1000))) for _ in range(400)]
    frame = spark.createDataFrame(rows, VALUES)
    path = tmp_path / "v"
    parts = [frame.where(F.pmod(F.hash("value", "as_of"), F.lit(3)) == k) for k in range(3)]
    for k in (0, 2, 1, 2):  # one of them twice
        U.load_valuations(parts[k], str(path), f"load-{k}")
    key = lambda out: sorted(map(str, out.collect()))
    assert key(U.valuation_trend(spark, str(path))) == key(D.valuation_trend(frame))
    assert key(U.aum_yoy(spark, str(path))) == key(D.aum_yoy(frame))
    before = written(path)
    more = spark.createDataFrame([("I", dt.date(2025, 1, 5), 7.0), ("II", dt.date(2025, 1, 9), 1.0), ("I", None, 5.0)], VALUES)
    U.load_valuations(more, str(path), "2025-01")
    after = written(path)
    assert {k for k in after if before.get(k) != after[k]} == {k for k in after if k.startswith("month=2025-01-01/load=2025-01/")} and set(before) <= set(after)
    assert key(U.valuation_trend(spark, str(path))) == key(D.valuation_trend(frame.union(more.where("as_of is not null"))))
    U.load_valuations(more.where("false"), str(path), "none")
    assert written(path) == after


def test_distinct_members(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(300), rng.choice("ABC"), day(rng.randrange(200)), rng.random() < 0.7) for _ in range(2500)] + [(None, "D", day(1), True), (5, "D", None, True), (1, None, day(1), True)]
    path = str(tmp_path / "a")
    for k in (0, 1, 1):
        U.load_activity(spark.createDataFrame(rows[k::2], ACTIVITY), path, str(k))
    active = [(c, s, d.replace(day=1)) for c, s, d, a in rows if a and d and c is not None]
    (r,) = U.active_portfolio(spark, path).collect()
    assert (r.companies, r.sectors) == (len({c for c, _, _ in active}), len({s for _, s, _ in active if s}))
    (r,) = U.active_portfolio(spark, path, since="2023-01-01", until="2023-02-01").collect()
    some = [x for x in active if dt.date(2023, 1, 1) <= x[2] <= dt.date(2023, 2, 1)]
    assert (r.companies, r.sectors) == (len({c for c, _, _ in some}), len({s for _, s, _ in some if s}))
    for r in U.active_by_month(spark, path).collect():
        upto = len({c for c, _, m in active if m <= r.month})
        assert (r.companies, r.companies_so_far) == (len({c for c, _, m in active if m == r.month}), upto) and abs(r.approx_so_far - upto) <= 0.05 * upto
