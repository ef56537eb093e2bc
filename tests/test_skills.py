"""Skills and labels of long texts."""

import time

from sparkgauge.functions import plain as P
from sparkgauge.functions import text as T
from pyspark.sql import functions as F

ODD = ["", " , ,", "a,b,A,  b ,c", "A,a,B,b,C,D,E,F,G,H,I,J", "x" * 300 + "," + "X" * 300 + ",y", "one\ttwo,ONE TWO, three"]


def test_skills_of_a_long_comma_text_take_one_pass(spark):
    """Each part was compared with all parts, each cleaned anew: a hundred million times for this text."""
    long = ",".join(["same", "Same "] * 5000 + ["other"])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, long])], "k long, t string")
    began = time.time()
    got = [r.s for r in rows.select("k", T.skills(F.col("t"), F.col("t")).alias("s")).orderBy("k").collect()]
    assert time.time() - began < 20
    assert got[:-1] == [P.skills(t, t) for t in ODD] and got[-1] == ["same", "other"]


def test_label_is_the_first_word_that_counts(spark):
    cases = {None: "General", "": "General", "the THE and": "General", "theory": "Theory", "the-x": "The-X", "1the2 you": "The2", "ab abc": "Abc", "9abc the": "Abc", "the_ x": "The ", "éthe you can go été_": "General", "éthé code": "Code"}
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    words = F.filter(T.long_tokens(F.col("t")), lambda x: ~x.isin(*T.LABEL_STOP))
    got = rows.select("t", T.label(F.col("t")).alias("a"), F.get(words, F.lit(0)).alias("w")).collect()
    assert {r.t: r.a for r in got} == cases
    assert all((r.w is None) == (r.a == "General") for r in got)
