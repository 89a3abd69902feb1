"""Property test: the exact order-statistic search equals a plain sort, for
random values with many ties, any tie-break and any partition count."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelsift.operators.quantile import kth_strings, kth_values

values = st.lists(st.tuples(st.integers(-5, 5), st.text(alphabet="abé日", min_size=0, max_size=4)),
                  min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=values, parts=st.integers(1, 5), limit=st.sampled_from([2, 5, 1000]), data=st.data())
def test_kth_matches_sort(spark, rows, parts, limit, data):
    rows = [(v, f"{s}#{i}") for i, (v, s) in enumerate(rows)]  # unique tie-break
    df = spark.createDataFrame(rows, "v long, t string").repartition(parts)
    want = sorted(rows)
    ranks = sorted(set(data.draw(st.lists(st.integers(0, len(rows) - 1), min_size=1, max_size=3))))
    got = kth_values(df, "v", ranks, tiebreak="t", bins=4, exact_limit=limit)
    assert got == {r: want[r] for r in ranks}
    strs = sorted(t for _, t in rows)
    assert kth_strings(df, "t", ranks, exact_limit=limit) == {r: strs[r] for r in ranks}
