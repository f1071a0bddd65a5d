import pytest

from relspark import errors as E
from relspark.functions.evaluate import evaluate
from relspark.pyexpr import column, convert

ROWS = [(1, 2.5, "hello"), (-3, 0.5, "x")]


@pytest.mark.parametrize(
    "f",
    [
        lambda t: t.a + 2 * t.b, lambda t: t[0] * 2 - 1, lambda t: t.a > 0 and not t.b > 1, lambda t: t.s[1:3], lambda t: len(t.s) + abs(t.a), lambda t: "big" if t.a > 0 else "small",
        lambda t: t.a % 2, lambda t: t.a // 2, lambda t: 0 < t.a < 5, lambda t: t["a"] ** 2, lambda t: str(t.a), lambda t: max(t.a, 0), lambda t: -t.a,
    ],
)
def test_like_python(spark, f):
    class Row(dict):
        __getattr__ = dict.__getitem__

        def __getitem__(self, k):
            return list(self.values())[k] if isinstance(k, int) else dict.__getitem__(self, k)

    df = spark.createDataFrame(ROWS, "a long, b double, s string")
    assert [r[0] for r in df.select(column(df, f).col).collect()] == [f(Row(a=a, b=b, s=s)) for a, b, s in ROWS]


def test_values():
    def half(x):
        return x / 2

    assert evaluate(convert(half, scalars=True), {"x": 3}) == 1.5
    with pytest.raises(E.ProgramError):
        convert(lambda t: [t.a])
