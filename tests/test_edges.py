"""Workers without the package, bad lines and answers, and groups of any number."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from kinesift.functions import phrases as ph
from kinesift.functions import scores as sc
from kinesift.functions import textfields as tf
from kinesift.operators import metrics
from kinesift.sources import logs

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_card_query_where_workers_lack_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from kinesift.session import get_spark
import __spark_entry__ as e
spark = get_spark(master="local[2]", **{{"spark.ui.enabled": "false"}})
print("rows", e.queries()["evidence_cards"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 131" in done.stdout, done.stderr[-2000:]


def _one(spark, value, build):
    return spark.createDataFrame([(value,)], "v string").select(build(F.col("v")).alias("x")).first().x


def test_logs_survive_bad_and_padded_lines(spark):
    log3 = lambda v: _one(spark, v, logs.parse_log3)
    assert log3("\t33,Jogging,49105962326000,-0.5,12,0.5;\t\r").activity == "jogging"
    assert log3("bad,line") is None and log3("\t") is None and log3("1,A,99999999999999999999,1,2,3") is None
    log21 = lambda label: _one(spark, "\t" + "\t".join(["1.5"] * 23) + f"\t{label}\n", logs.parse_log21)
    assert len(log21("4").values) == 21
    assert [log21(x) for x in ("NaN", "99999999999", "0", "x")] == [None] * 4


def test_answers_survive_odd_numbers(spark):
    # The text "1.7" is no whole number, so the next rule reads the lone 1.
    choice = lambda v: _one(spark, v, lambda c: tf.choice_index(c, F.lit(4)))
    assert [choice(x) for x in ('{"index": 99999999999}', '{"index": "NaN"}', '{"index": "1.7"}', '{"index": 1.7}', '{"index": " 2 "}', "so 99999999999")] == [None, None, 1, 1, 2, None]
    labels = lambda v: _one(spark, v, lambda c: tf.support_labels(c, F.lit(2)))
    assert labels('{"labels": ["2", true]}') is None and labels('{"labels": [2, "no"]}') == [True, False]


def test_decimal_ties_follow_the_number(spark):
    values = [1.0005, 1.0025, -1.0005, 0.0625, 0.1875, 2.0015, -0.0005, 0.0, 1e6 + 0.0005, 3.14159]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(ph.fixed_point(F.col("v"), 3).alias("s")).collect()
    assert [r.s for r in got] == ["%.3f" % v for v in values]


def test_claim_on_a_missing_field_is_a_mismatch(spark):
    fields = ", ".join(f"{f} string" for f in ph.FIELDS)
    card = {f: "low" for f in ph.FIELDS} | {ph.FIELDS[0]: None}
    row = spark.createDataFrame([(card, {f: "low" for f in ph.FIELDS})], f"card struct<{fields.replace(' string', ':string')}>, claims struct<{fields.replace(' string', ':string')}>")
    same, other = sc.claim_matches(F.col("card"), F.col("claims"))
    got = row.select(same.alias("s"), other.alias("o"), sc.field_match(same, other).alias("m")).first()
    assert (got.s, got.o, got.m) == (len(ph.FIELDS) - 1, 1, 0.1)


def test_paired_comparison_of_sixty_datasets(spark):
    rows = [(f"w{i}", f"d{i % 60}", i % 3, i % 2) for i in range(600)]
    own = spark.createDataFrame(rows, "window_id string, dataset string, caption_prediction int, caption_answer_index int")
    other = own.drop("dataset").withColumn("caption_prediction", F.lit(1))
    got = metrics.paired_comparison(own, other, by=["dataset"])
    assert got.count() == 60
    whole = metrics.paired_comparison(own, other).first()
    assert got.agg(F.sum("primary_only_correct")).first()[0] == whole.primary_only_correct
