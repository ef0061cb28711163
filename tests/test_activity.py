"""Week bitmaps: merged parts equal the whole, weeks on either side of a word's border belong together."""

import datetime as dt
import random

from turnlytics.operators import activity as A
from turnlytics.operators import metrics as M


def rows(spark, n=300, seed=2):
    rng = random.Random(seed)
    start = dt.date(2019, 12, 30)  # weeks before and after borders of 64 weeks
    return spark.createDataFrame([(f"u{rng.randrange(25)}", start + dt.timedelta(weeks=rng.randrange(150))) for _ in range(n)] + [(None, start), ("x", None)], "pseudo_user string, week date")


def test_merged_parts_equal_the_whole(spark):
    whole = rows(spark)
    clean = whole.where("pseudo_user IS NOT NULL AND week IS NOT NULL").cache()
    parts = [whole.where(f"pmod(hash(week, pseudo_user), 3) = {k}") for k in range(3)]
    bits = A.merged(*map(A.week_bits, parts), A.week_bits(parts[1]))  # a part twice
    key = lambda f, *c: sorted(tuple(r) for r in f.select(*c).collect())
    assert key(bits, "user", "word", "bits") == key(A.week_bits(clean), "user", "word", "bits")
    columns = ["week", "pseudo_users", "next_week_present", "return_rate"]
    assert key(A.weekly_return(bits), *columns) == key(M.intensity_weekly(clean), *columns)
    assert key(A.persistence(bits), "quarter", "pseudo_users", "avg_weeks_active") == key(M.persistence_quarterly(clean), "quarter", "pseudo_users", "avg_weeks_active")
    spans = {r["user"]: (r["first_week"], r["last_week"], r["weeks"]) for r in A.spans(bits).collect()}
    want = {}
    for r in clean.distinct().collect():
        want.setdefault(r["pseudo_user"], []).append(r["week"])
    assert spans == {u: (min(w), max(w), len(w)) for u, w in want.items()}
    assert bits.select("word").distinct().count() >= 3


def test_every_bit_of_a_word(spark):
    first = dt.date(1970, 1, 5) + dt.timedelta(weeks=64 * 41)
    for k in (0, 62, 63):
        frame = spark.createDataFrame([("u", first + dt.timedelta(weeks=k)), ("u", first + dt.timedelta(weeks=k + 1))], "pseudo_user string, week date")
        got = sorted((r["week"], r["comes_back"]) for r in A.active_weeks(A.week_bits(frame)).collect())
        assert got == [(first + dt.timedelta(weeks=k), True), (first + dt.timedelta(weeks=k + 1), False)]
    assert A.weekly_return(A.week_bits(frame.limit(0))).count() == 0
