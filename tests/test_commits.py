"""Several tables committed at once, lists in parts, results as lines, figures of a run."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from perkloom.plans import ingest_queries
from perkloom.plans.domain import Domain
from perkloom.sources import collected, commits

SCHEMA = "id string, value int"


def rows(spark, **values):
    return spark.createDataFrame(list(values.items()), SCHEMA)


def seen(spark, root, commit, table):
    schema = rows(spark, x=1).schema
    return {r.id: r.value for r in commits.read(spark, root, commit, table, schema).collect()}


def test_two_writers_and_a_reader_between_them(spark, tmp_path):
    root = str(tmp_path)
    nothing = commits.latest(spark, root)
    assert nothing == commits.Commit() and seen(spark, root, nothing, "benefits") == {}
    first = commits.commit(spark, root, nothing, {"benefits": rows(spark, a=1), "queue": rows(spark, b=2)})
    reader = commits.latest(spark, root)
    assert reader == first
    one = commits.commit(spark, root, first, {"benefits": rows(spark, a=1, b=2), "queue": rows(spark, c=3)})
    # The second writer read the same commit; its run must not undo the first one's.
    with pytest.raises(commits.ConflictError):
        commits.commit(spark, root, first, {"benefits": rows(spark, a=9), "queue": rows(spark, b=2)})
    assert commits.latest(spark, root) == one
    assert seen(spark, root, one, "benefits") == {"a": 1, "b": 2} and seen(spark, root, one, "queue") == {"c": 3}
    # A reader keeps both tables of the commit it opened.
    assert seen(spark, root, reader, "benefits") == {"a": 1} and seen(spark, root, reader, "queue") == {"b": 2}
    again = commits.commit(spark, root, one, {"queue": rows(spark, d=4)})
    assert again.number == 3 and seen(spark, root, again, "benefits") == {"a": 1, "b": 2}
    # A version may be computed from the one it replaces.
    live = commits.read(spark, root, again, "queue", rows(spark, x=1).schema)
    last = commits.commit(spark, root, again, {"queue": live.withColumn("value", F.col("value") + 1)})
    assert seen(spark, root, last, "queue") == {"d": 5}
    with pytest.raises(commits.ConflictError):
        commits.commit(spark, root, nothing, {"queue": rows(spark, z=0)})


def test_a_list_in_parts_keeps_its_order(spark, tmp_path):
    lines = [(i, json.dumps({"offer_url": f"u{i % 40}", "terms_text": f"t{i}", "content_hash": str(i)})) for i in range(400)]
    lines[7] = (7, "{broken")
    df = spark.createDataFrame(lines, "n int, value string")
    df.repartition(5).repartitionByRange(12, "n").sortWithinPartitions("n").select("value").write.text(f"{tmp_path}/deals")
    got = collected.read_collected(spark, f"{tmp_path}/deals", parts=True).collect()
    assert {r.offer_url: r.terms_text for r in got} == {f"u{i % 40}": f"t{i}" for i in range(400)}
    assert {r.list for r in got} == {"deals"}


def test_results_as_lines_and_as_files(spark, tmp_path):
    results = [{"page_summary": "p", "benefits": [{"merchant_name": f"m{i}", "type": "percent", "value": 5.0}]} for i in range(3)]
    (tmp_path / "files").mkdir()
    (tmp_path / "lines").mkdir()
    for i, r in enumerate(results):
        (tmp_path / "files" / f"{i}.json").write_text(json.dumps(r, indent=2))
    (tmp_path / "lines" / "all.json").write_text("\n".join(map(json.dumps, results)))
    names = lambda df: sorted(r.merchant_name for r in df.collect())
    assert names(collected.read_extraction(spark, f"{tmp_path}/files")) == ["m0", "m1", "m2"]
    assert names(collected.read_extraction(spark, f"{tmp_path}/lines", lines=True)) == ["m0", "m1", "m2"]


def test_figures_of_a_run_come_with_its_writing(spark, sf_dir):
    run = ingest_queries._ingest(Domain(spark, sf_dir))
    report = ingest_queries.ingest.run_report(run.outcomes).where("program_id IS NULL").first()
    found = {name: seen.get for name, seen in run.observed.items()}
    assert found["extracted"]["rows"] == report.extracted > 0
    assert found["published"]["rows"] == run.benefits.count()
    assert 0 < found["extracted"]["confidence"] <= report.extracted
    assert report.scraped == 200 and report.input_tokens > 200 * 200 and report.output_tokens > 0
