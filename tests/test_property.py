import json
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowsift.functions import contains_pattern, is_strict_json

WORDS = st.text(alphabet="abcXYZ 1.-", max_size=12)
TERMS = st.text(alphabet="abcXYZ1", min_size=1, max_size=3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=1, max_size=30), TERMS)
def test_f1_matches_python_re(spark, texts, term):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = sorted(r.id for r in df.where(contains_pattern("t", term)).collect())
    want = [i for i, t in enumerate(texts) if re.search(term, t, re.IGNORECASE)]
    assert got == want


JSONISH = st.text(alphabet='[]{}",:0123456789 abtrufnl.-eE', max_size=14)


def _python_valid(s):
    try:
        json.loads(s)
        return True
    except ValueError:
        return False


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(JSONISH, min_size=1, max_size=60))
def test_strict_json_matches_json_loads(spark, texts):
    texts = [t for t in texts if "NaN" not in t and "Infinity" not in t]
    if not texts:
        return
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: r.ok for r in df.select("id", is_strict_json("t").alias("ok")).collect()}
    for i, t in enumerate(texts):
        try:
            obj = json.loads(t)
            dup = False

            def hook(pairs):
                nonlocal dup
                keys = [k for k, _ in pairs]
                dup = dup or len(keys) != len(set(keys))
                return dict(pairs)
            json.loads(t, object_pairs_hook=hook)
            want = not dup
        except ValueError:
            want = False
        assert got[i] == want, (t, obj if want else None)


def _py_strict(t):
    def no_dups(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError("repeated key")
        return dict(pairs)

    def no_constants(c):
        raise ValueError(c)

    try:
        json.loads(t, object_pairs_hook=no_dups, parse_constant=no_constants)
        return True
    except ValueError:
        return False


def test_strict_json_structural_junk(spark):
    """Random strings built from JSON tokens (brackets, commas, values): the
    strict check agrees with json.loads, including junk after a closing
    bracket such as 'true]-2.5' that one lenient parse of '[x]' accepts."""
    import random as _random

    from pyspark.sql import functions as F

    from rowsift.functions import is_strict_json, parse_strict

    rng = _random.Random(5)
    atoms = ['1', '-2.5', '"a"', 'true', 'null', '[', ']', '{', '}', ',', ':', '"k"', ' ', 'x', '[1]',
             '{"a":1}', '""']
    texts = sorted({"".join(rng.choice(atoms) for _ in range(rng.randint(0, 6))) for _ in range(4000)})
    texts += ['true]-2.5', '1}x', '1, 0]', 'null']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", is_strict_json("t").alias("ok"),
                     F.schema_of_variant(parse_strict("t")).alias("kind")).collect()
    got = {r.i: r.ok for r in rows}
    assert [texts[i] for i in range(len(texts)) if got[i] != _py_strict(texts[i])] == []
    kinds = {texts[r.i]: r.kind for r in rows}
    assert kinds["null"] == "VOID" and kinds["true]-2.5"] is None
