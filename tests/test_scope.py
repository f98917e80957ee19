import os

from spendlens.operators.sharing import settled, shared
from spendlens.session import scope


def test_a_scope_frees_what_it_owns(spark):
    outer = settled(spark.range(3), "outside")
    with scope(spark) as one:
        a = settled(spark.range(5), "a")
        kept = shared(a.groupBy("id").count())
        with scope(spark) as two:
            settled(spark.range(2), "b")
        assert len(two.paths) == 1 and not os.path.exists(two.paths[0])
        assert kept.count() == 5 and kept.storageLevel.useMemory and os.path.exists(one.paths[0])
    assert not os.path.exists(one.paths[0]) and not kept.storageLevel.useMemory
    assert outer.count() == 3


def test_a_scope_ends_with_an_error_too(spark):
    try:
        with scope(spark) as one:
            settled(spark.range(5), "a")
            raise ValueError
    except ValueError:
        pass
    assert not os.path.exists(one.paths[0])
