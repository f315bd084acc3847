"""Sources and sinks: each query writes a driver table in a format and reads it back."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from quern.sources import files, readers, sinks
from quern.streaming import labeler

from .inputs import ANSWERS, answers
from .registry import Queries, read

Q = Queries()
QUERIES, SQL = Q.QUERIES, Q.SQL

NATION = "n_nationkey int, n_name string, n_regionkey int"
_SAME = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _nation(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


@Q.add("a01_csv_inferred", _SAME)
def a01(spark, sf):
    d = files.scratch_dir(spark, "a01") + "/nation.csv"
    sinks.sorted_csv(_nation(spark, sf), d, ["n_nationkey"])
    return readers.csv(spark, d)


@Q.add("a02_csv_bytes_tolerant", "SELECT n_nationkey AS k, 'caf' || chr(65533) AS v FROM nation")
def a02(spark, sf):
    """Malformed UTF-8 is replaced, the row stays."""
    d = files.scratch_dir(spark, "a02") + "/bad.csv"
    _nation(spark, sf).select("n_nationkey", F.lit("caf\u00e9").alias("v")).write.option("encoding", "ISO-8859-1").csv(d, header=True)
    return readers.csv(spark, d, "k int, v string")


@Q.add("a03_csv_gz", _SAME)
def a03(spark, sf):
    d = files.scratch_dir(spark, "a03") + "/nation.csv"
    sinks.sorted_csv(_nation(spark, sf), d, ["n_nationkey"], gz=True)
    return readers.by_suffix(spark, d, NATION)


@Q.add("a04_json_lines_strict", _SAME)
def a04(spark, sf):
    d = files.scratch_dir(spark, "a04") + "/nation.jsonl"
    sinks.json_lines(_nation(spark, sf), d)
    return readers.json_lines(spark, d, NATION)


@Q.add("a04_line_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders")
def a04n(spark, sf):
    """Lines of a sorted file, numbered from the counts of its parts."""
    d = files.scratch_dir(spark, "a04n") + "/orders.jsonl"
    read(spark, sf, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").coalesce(1).write.json(d)
    lines = readers.numbered_lines(spark, d)
    return lines.select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "line")


@Q.add("a05_json_lines_lenient", "SELECT (SELECT count(*) FROM nation) AS n_good, (SELECT count(*) FROM region) AS n_bad")
def a05(spark, sf):
    d = files.scratch_dir(spark, "a05")
    good = _nation(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    good.union(read(spark, sf, "region").select(F.concat(F.lit('{"n_name": '), "r_name"))).write.text(d)
    ok, bad = readers.split_bad(readers.json_lines(spark, d, NATION, strict=False))
    return ok.agg(F.count("*").alias("n_good")).join(bad.agg(F.count("*").alias("n_bad")))


@Q.add("a06_json_lines_gz", _SAME)
def a06(spark, sf):
    d = files.scratch_dir(spark, "a06") + "/nation.jsonl"
    sinks.json_lines(_nation(spark, sf), d, gz=True)
    return readers.by_suffix(spark, d, NATION)


@Q.add("a07_nested_unnest", "SELECT r_name AS relation_name, n_name AS subject, n_nationkey::VARCHAR AS gold_object, 'Where is ' || n_name || '?' AS prompt FROM region JOIN nation ON n_regionkey = r_regionkey")
def a07(spark, sf):
    """Documents with nested samples, one file each, as prompts."""
    d = files.scratch_dir(spark, "a07")
    s = _nation(spark, sf).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("subject"), F.col("n_nationkey").cast("string").alias("object")))).alias("samples"))
    docs = read(spark, sf, "region").join(s, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("name"), F.array(F.lit("{} is in"), F.lit("Where is {}?")).alias("prompt_templates"), "samples")
    docs.repartition(5, "name").write.json(d + "/factual")
    rows = spark.read.schema(readers.RELATION).json(d + "/factual").select("name", "prompt_templates", F.posexplode("samples").alias("pos", "x"))
    from quern.functions.text import fill_template, question_template

    return rows.select(F.col("name").alias("relation_name"), F.col("x.subject").alias("subject"), F.col("x.object").alias("gold_object"), fill_template(question_template(F.col("prompt_templates")), F.col("x.subject"), "{}").alias("prompt"))


@Q.add("a08_dispatch_by_suffix", _SAME)
def a08(spark, sf):
    d = files.scratch_dir(spark, "a08") + "/nation.parquet"
    _nation(spark, sf).write.parquet(d)
    return readers.by_suffix(spark, d)


@Q.add("a09_glob_order", "SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region")
def a09(spark, sf):
    """Overlapping patterns read each file once."""
    d = files.scratch_dir(spark, "a09")
    _nation(spark, sf).select("n_nationkey").write.parquet(d + "/a.parquet")
    read(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("n_nationkey")).write.parquet(d + "/b.parquet")
    return spark.read.parquet(*files.expand(spark, [d + "/b*", d + "/*.parquet"]))


@Q.add("a10_source_file", "SELECT o_orderpriority, count(*) AS n, 1 AS n_files, count(DISTINCT o_orderstatus) AS n_statuses FROM orders GROUP BY 1")
def a10(spark, sf):
    """Orders sorted into files by priority, and how many files each priority's rows come from."""
    d = files.scratch_dir(spark, "a10")
    read(spark, sf, "orders").select("o_orderpriority", "o_orderstatus").repartitionByRange(5, "o_orderpriority").write.parquet(d)
    rows = readers.with_source(spark.read.parquet(d))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("source_file").cast("int").alias("n_files"), F.countDistinct("o_orderstatus").alias("n_statuses"))


@Q.add("a11_keys_from_names", "SELECT n_regionkey::VARCHAR AS region, count(*) AS n FROM nation GROUP BY 1")
def a11(spark, sf):
    d = files.scratch_dir(spark, "a11")
    sinks.partitioned(_nation(spark, sf).withColumn("r", F.col("n_regionkey")), d, ["r"])
    return readers.with_name_parts(spark.read.parquet(d), r"/r=([0-9]+)/", ["region"]).groupBy("region").agg(F.count("*").alias("n"))


@Q.add("a12_relation_set", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2)")
def a12(spark, sf):
    d = files.scratch_dir(spark, "a12")
    spark.range(1).select(F.explode(F.array(F.lit("# regions"), F.lit(""), F.lit(" 1 "), F.lit("2"))).alias("value")).write.text(d)
    n = _nation(spark, sf).withColumn("relation_key", F.col("n_regionkey").cast("string"))
    return n.join(readers.relation_set(spark, d), "relation_key", "left_semi").select("n_name")


@Q.add("a13_best_candidate", "SELECT CASE WHEN count(DISTINCT o_custkey) FILTER (o_orderpriority < '3') >= count(DISTINCT o_custkey) FILTER (o_orderpriority >= '3') THEN 'a' ELSE 'b' END AS chosen FROM orders")
def a13(spark, sf):
    """Of the orders of high and of low priorities the table that covers more customers; a third one lacks the column."""
    d = files.scratch_dir(spark, "a13")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    o.where("o_orderpriority < '3'").write.parquet(d + "/a.parquet")
    o.where("o_orderpriority >= '3'").write.parquet(d + "/b.parquet")
    o.select("o_custkey").write.parquet(d + "/c.parquet")
    best = readers.best_candidate(spark, [f"{d}/{x}.parquet" for x in "abc"], ["O-OrderKey"], "o_custkey")
    return spark.range(1).select(F.lit(best[-9:-8]).alias("chosen"))


@Q.add("a14_schema_probe", "SELECT n_name FROM nation")
def a14(spark, sf):
    d = files.scratch_dir(spark, "a14")
    _nation(spark, sf).write.parquet(d + "/a.parquet")
    read(spark, sf, "region").write.parquet(d + "/b.parquet")
    return spark.read.parquet(*readers.with_columns_like(spark, files.expand(spark, [d + "/*"]), ["N-Name"])).select("n_name")


@Q.add("a15_union_of_found", "SELECT n_name, n_regionkey, NULL::INT AS extra FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, NULL, n_nationkey FROM nation WHERE n_regionkey = 2")
def a15(spark, sf):
    d = files.scratch_dir(spark, "a15")
    n = _nation(spark, sf)
    n.where("n_regionkey = 1").select("n_name", "n_regionkey").write.parquet(d + "/x1.parquet")
    n.where("n_regionkey = 2").select("n_name", F.col("n_nationkey").alias("extra")).write.parquet(d + "/x2.parquet")
    n.write.parquet(d + "/x3_old.parquet")
    return readers.union_of(spark, [d + "/none*"], [d + "/x*.parquet"], exclude=["_old"])


@Q.add("a18_sorted_csv", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def a18(spark, sf):
    d = files.scratch_dir(spark, "a18")
    sinks.sorted_csv(read(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), d, ["l_returnflag"])
    return readers.csv(spark, d, "l_returnflag string, n long")


@Q.add("a19_partitioned_sink", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def a19(spark, sf):
    """A filter on the partition column reads that partition only."""
    d = files.scratch_dir(spark, "a19")
    sinks.partitioned(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), d, ["o_orderpriority"])
    return spark.read.parquet(d).where("o_orderpriority = '1-URGENT'").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


_CLEAN = "n_name string, subject string"


@Q.add("a16_release_archives", "SELECT 'region_' || n_regionkey AS task_key, n_name AS subject, row_number() OVER w - 1 AS task_idx, 'region_' || n_regionkey || '_' || lpad((row_number() OVER w - 1)::VARCHAR, 4, '0') AS entity_id, 'region_' || n_regionkey || ':region_' || n_regionkey || '_' || lpad((row_number() OVER w - 1)::VARCHAR, 4, '0') AS example_id, NULL::VARCHAR AS n_name FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def a16(spark, sf):
    """An archive for each region, cleaned of a field and read back with the ids of a release."""
    d = files.scratch_dir(spark, "a16")

    def pack(pdf):
        import io
        import json
        import zipfile

        import pandas as pd

        out, region = io.BytesIO(), int(pdf["n_regionkey"].iloc[0])
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            lines = [json.dumps({"n_name": "to drop", "subject": r.n_name}) for r in pdf.sort_values("n_nationkey").itertuples()]
            z.writestr(f"release/region_{region}.jsonl", "\n".join(lines) + "\n")
            z.writestr("release/about.txt", "regions")
        return pd.DataFrame({"name": [f"{region}.zip"], "content": [out.getvalue()]})

    sinks.archives(_nation(spark, sf).groupBy("n_regionkey").applyInPandas(pack, "name string, content binary"), d + "/in")
    sinks.archives(readers.clean_archives(spark, d + "/in", ["subject"]), d + "/out")
    return readers.release_rows(readers.archive_lines(spark, d + "/out"), _CLEAN)


@Q.add(
    "a20_xlsx_sheet",
    """SELECT * FROM (SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment) AS "row", c_nationkey::VARCHAR AS nation, '<' || c_mktsegment || '> & co' AS segment, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY c_nationkey, c_mktsegment)
    UNION ALL SELECT 0, 'nation', 'segment', NULL, NULL""",
)
def a20(spark, sf):
    """A summary as a sheet and read back: its header, numbers, and text without control characters."""
    d = files.scratch_dir(spark, "a20")
    groups = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation"), "c_mktsegment").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("most"))
    segment = F.concat(F.lit("<\x07"), "c_mktsegment", F.lit("> & co\x1f")).alias("segment")
    sinks.xlsx(groups.select("nation", segment, "n", "most"), d + "/summary.xlsx", ["nation", "segment"])
    cell = lambda i: F.col("cells")[i]
    number = lambda i, t: F.when(F.col("row") > 0, cell(i)).cast(t)
    return readers.sheet_rows(spark, d).select("row", cell(0).alias("nation"), cell(1).alias("segment"), number(2, "long").alias("n"), number(3, "double").alias("most"))


@Q.add("a21_markdown_report", "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |' || chr(10), '' ORDER BY r_regionkey) AS report FROM region")
def a21(spark, sf):
    r = read(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.range(1).select(F.lit(sinks.markdown(r)).alias("report"))


@Q.add("a21_latex_report", r"""SELECT '\begin{tabular}{ll}' || chr(10) || 'r\_regionkey & r\_name \\' || chr(10) || string_agg(r_regionkey || ' & ' || r_name || ' \\' || chr(10), '' ORDER BY r_regionkey) || '\end{tabular}' || chr(10) AS report FROM region""")
def a21l(spark, sf):
    r = read(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.range(1).select(F.lit(sinks.latex(r)).alias("report"))


@Q.add("a23_resume_by_partition", "SELECT n_nationkey FROM nation WHERE n_regionkey >= 2")
def a23(spark, sf):
    """Only what the partitions that are there lack."""
    d = files.scratch_dir(spark, "a23")
    n = _nation(spark, sf)
    sinks.partitioned(n.where("n_regionkey < 2"), d, ["n_regionkey"])
    return sinks.todo(n, spark.read.parquet(d), ["n_regionkey"]).select("n_nationkey")


@Q.add("a24_resume_by_position", "SELECT n_nationkey FROM nation WHERE n_nationkey >= 7")
def a24(spark, sf):
    """A run that stopped behind seven rows of its source."""
    d = files.scratch_dir(spark, "a24")
    n = _nation(spark, sf)
    n.where("n_nationkey < 7").write.parquet(d)
    return sinks.after(n, spark.read.parquet(d), "n_nationkey").select("n_nationkey")


@Q.add("a25_resume_by_id", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_ids FROM orders")
def a25(spark, sf):
    """A second run writes what the first did not."""
    d = files.scratch_dir(spark, "a25")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    sinks.append_missing(spark, o.where("o_orderkey % 3 = 0"), d, ["o_orderkey"])
    sinks.append_missing(spark, o, d, ["o_orderkey"])
    return spark.read.parquet(d).agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_ids"))


@Q.add("a26_completeness", "SELECT 'all' AS output, true AS complete UNION ALL SELECT 'part', count(*) = count(*) FILTER (n_regionkey < 3) FROM nation")
def a26(spark, sf):
    d = files.scratch_dir(spark, "a26")
    n = _nation(spark, sf)
    n.write.parquet(d + "/all")
    n.where("n_regionkey < 3").write.parquet(d + "/part")
    one = lambda x: F.struct(F.lit(x).alias("output"), F.lit(sinks.complete(n, spark.read.parquet(f"{d}/{x}"))).alias("complete"))
    return spark.range(1).select(F.inline(F.array(one("all"), one("part"))))


@Q.add("a27_atomic_replace", "SELECT r_regionkey, r_name FROM region")
def a27(spark, sf):
    d = files.scratch_dir(spark, "a27") + "/table"
    r = read(spark, sf, "region").select("r_regionkey", "r_name")
    sinks.replace_table(spark, r.limit(1), d)
    sinks.replace_table(spark, r, d)
    return spark.read.parquet(d)


@Q.add("a27_checkpointed_repair", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'other' ELSE event_type END AS event_type, value FROM events")
def a27c(spark, sf):
    """Events relabelled in slices: the first run stops in the second slice, the next one goes on where it stopped."""
    d = files.scratch_dir(spark, "a27c") + "/table"
    e, calls = read(spark, sf, "events").select("event_id", "event_type", "value"), []

    def relabel(rows, stop):
        calls.append(1)
        if len(calls) == 2 and stop:
            raise InterruptedError("a run that stops")
        return rows.withColumn("event_type", F.when(F.col("event_type") == "error", "other").otherwise(F.col("event_type")))

    for stop in (True, False):
        with contextlib.suppress(InterruptedError):
            sinks.checkpointed(spark, e, d, "event_id", lambda rows: relabel(rows, stop), 4)  # noqa: B023
    return spark.read.parquet(d)


@Q.add("n01_streaming_labels", f"WITH {ANSWERS} SELECT count(*) AS n FROM answers")
def n01(spark, sf):
    """Answers that arrive as files, labelled once each by a stream."""
    d = files.scratch_dir(spark, "n01")
    a = answers(spark, sf).select(F.col("id").cast("string").alias("example_id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), "prompt", "answer", F.col("gold").alias("gold_object"), F.lit("capital").alias("relation_key"))
    a.union(a.limit(50)).write.json(d + "/in")
    s = labeler.answers_stream(spark, d + "/in", "example_id string, ts timestamp, prompt string, answer string, gold_object string, relation_key string")
    labeler.write(labeler.labelled(s), d + "/out", d + "/state").awaitTermination()
    return spark.read.parquet(d + "/out").agg(F.count("*").alias("n"))
