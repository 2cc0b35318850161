"""References are decoded in a text that is worked out once, with the results of one pass per name."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from perkloom.functions import fixed_values as V
from perkloom.functions import pages


def test_what_is_decoded_is_worked_out_once(spark):
    df = spark.createDataFrame([("a &#x41;&#66; &amp;",)], "t string")
    for use in (pages.decode_entities, pages.html_to_text):
        read = df.select(use(F.regexp_replace("t", "no such mark", "")).alias("t"))
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("no such mark") == 1
        assert read.first()["t"] == "a AB &"


def by_name(text):
    for name in [n for n in V.NAMED_ENTITIES if n != "amp"] + ["amp"]:
        text = re.sub(f"(?i)&{name};", V.NAMED_ENTITIES[name], text)
    return text


def test_names_are_read_as_one_after_another(spark):
    texts = [
        "", "&", "&;", "no mark", "&NBSP;&nbsp;&Lt;b&GT;", "&l&shy;t;", "&nda&shy;sh;", "&sh&SHY;y;&shy;", "&am&shy;p;lt;",
        "&amp;lt;", "&amp;AMP;amp;", "&am&lt;p;", "&AMP;amp;#65;", "&unknown;&copy", "&ils;&agorot;&Euro;" * 50, None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(pages.decode_entities(F.col("t"))).collect()]
    assert got == [None if t is None else by_name(t) for t in texts]
