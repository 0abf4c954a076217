"""Ninth columns parsed in batches, and numbers given in stretches, are those of the plain ways."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from braidline.operators import interval as iv
from braidline.sources import attributes as at


def test_batches_parse_as_functions_of_arrays_do(spark):
    rng = random.Random(5)
    marks = ["a", "b", "=", ";", '"', ",", " ", "\t", "%2C", "%3B", "+", "%zz", "%", "x", "\n", "\r", " ", "  "]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))) for i in range(2000)] + [(2000, None), (2001, 'Note="a;b",c%2Cd; Dbxref=flag:R,seq:x;Dbxref=more')]
    own = spark.createDataFrame(rows, "id long, a string").select("id", at.parsed(F.col("a")).alias("p"), at.mapped(F.col("a")).alias("m"), at.indexed(F.col("a")).alias("x"), F.flatten(F.transform(at.segments(F.col("a")), at.name_values)).alias("want"))
    for r in own.collect():
        assert r.p == r.want
        assert r.m == {p.name: [q.value for q in r.want if q.name == p.name] for p in r.want}
        assert [(x.name, x.value, x.idx) for x in r.x] == [(p.name, p.value, sum(q.name == p.name for q in r.want[:i])) for i, p in enumerate(r.want)]


def test_a_very_long_segment(spark):
    text = "Note=" + "a b" * 30_000
    assert spark.createDataFrame([(text,)], "a string").select(F.size(at.segments(F.col("a")))).first()[0] == 1


def test_numbers_of_stretches_and_no_task_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["exon", "CDS", None]), n << rng.choice([0, 33])) for n in rng.sample(range(1, 4000), 900)]
    df = spark.createDataFrame(rows, "kind string, at long").distinct()
    got = iv.numbered(df, ["kind"], "at", bits=6)
    want = df.withColumn("number", F.row_number().over(Window.partitionBy("kind").orderBy("at")))
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    plan = iv.numbered(df, ["kind"], "at")._jdf.queryExecution().optimizedPlan().toString()
    assert "[kind#" in plan and plan.count("row_number()") == 1 and "_at#" in plan.split("row_number()")[1].split("\n")[0]
