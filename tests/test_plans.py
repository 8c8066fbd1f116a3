"""The plans that scale: narrow where nothing has to move, pruned scans, each expensive column once."""

import re

from pyspark.sql import functions as F

from inkwarden import schemas
from inkwarden.operators import heuristics, patterns, report, scoring, surfaces
from inkwarden.sources import files

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return schemas.completed(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("visible_text")))


def test_findings_need_no_exchange(spark):
    docs = documents(spark)
    for df in (surfaces.surfaces(docs), patterns.pattern_findings(surfaces.surfaces(docs)), heuristics.heuristic_findings(docs), report.all_findings(docs)):
        assert "Exchange" not in plan(df) and "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_each_rule_is_in_the_plan_once(spark):
    text = plan(patterns.pattern_findings(surfaces.surfaces(documents(spark))))
    assert text.count("wget") <= 4  # its gate, its pattern and the pattern's literal in the hit


def test_scan_reads_two_columns(spark):
    text = plan(patterns.pattern_findings(surfaces.surfaces(documents(spark))))
    assert re.findall(r"ReadSchema: (\S+)", text) == ["struct<doc_id:bigint,text:string>"] or "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_scores_shuffle_by_document_only(spark):
    docs, name = documents(spark), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as for tables too large to broadcast
    try:
        text = plan(scoring.score(report.all_findings(docs), docs))
    finally:
        spark.conf.set(name, before)
    assert set(re.findall(r"Exchange (\w+\(\w+)", text)) == {"hashpartitioning(doc_id"}


def test_filters_reach_the_scan(spark):
    text = plan(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id > 100").select("doc_id", files.content_hash(F.col("text").cast("binary"))))
    assert "GreaterThan(doc_id,100)" in text


def test_result_does_not_depend_on_partitioning(spark):
    docs = documents(spark)
    one, many = (report.all_findings(docs.repartition(n)) for n in (1, 7))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_filters_on_findings_reach_the_scan(spark):
    docs = documents(spark)
    for df in (surfaces.surfaces(docs), patterns.pattern_findings(surfaces.surfaces(docs)), heuristics.heuristic_findings(docs), report.all_findings(docs)):
        scans = re.findall(r"PushedFilters: \[(.*?)\]", plan(df.where("doc_id = 7")))
        assert scans and all("EqualTo(doc_id,7)" in s for s in scans)


def test_reports_run_rules_once(spark):
    docs, (one,) = documents(spark), {plan(surfaces.surfaces(documents(spark))).count("Generate")}
    rules = plan(patterns.pattern_findings(surfaces.surfaces(docs))).count("Generate") + plan(heuristics.heuristic_findings(docs)).count("Generate")
    assert one == 1 and plan(report.reports(docs.select("doc_id"), docs)).count("Generate") == rules
