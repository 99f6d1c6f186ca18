"""Verbatim copies of items made of slots are found; other values in them are not."""

from test_decontaminate import run

SUMS = "12 + 30 = 42, 7 + 8 = 15, 100 - 1 = 99, 5 kg and 3 kg make 8 kg"
NAMES = "Anna Bert Carla Dora Emil Frida Gustav Hanna Ida Jonas Karl Lena Mia"


def test_verbatim_slots(spark):
    docs = [(1, f"see {SUMS} there"), (2, f"see {NAMES} there"), (3, SUMS.replace("12", "13").replace("7", "6"))]
    got = run(spark, docs, [(1, SUMS), (2, NAMES)])
    assert set(got) == {(1, 1), (2, 2)} and got[1, 1][1] == got[2, 2][1] == 0
