import json

import pytest
from pyspark.sql import functions as F

from flowsight.plans import adapters, files
from flowsight.schema import FEATURES, FLOW_COLUMNS
from flowsight.sources.file_export import export_files
from flowsight.sources import config, dns, flows, logs, packets, sinks


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_flow_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('SourceIP,DestinationIP,Duration,TimeStamp,DoH,Label,FlowSentRate\n"10.0.0.1",10.0.0.2,1.5,2025-08-15 16:03:24,False,Benign,nan\n10.0.0.3,10.0.0.4,abc,,True,Malicious,inf\n')
    (tmp_path / "b.csv").write_text("Label,Duration\nBenign,7\n")
    (tmp_path / "c.csv").write_text("SourceIP,Duration\n10.9.9.9,1\n")
    got = flows.read_flows(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv", "absent.csv")], labelled=True)
    assert got.columns == FLOW_COLUMNS + ["Label"] and got.count() == 3
    rows = {r.Duration: r for r in got.collect()}
    assert rows[1.5].TimeStamp.second == 24 and rows[1.5].DoH is False and rows[1.5].FlowSentRate is None
    assert rows[None].FlowSentRate == float("inf") and rows[7.0].SourceIP is None
    with pytest.raises(ValueError):
        flows.read_flows(spark, [str(tmp_path / "c.csv")], labelled=True)
    scoring = flows.read_for_scoring(spark, str(tmp_path / "a.csv"))
    assert scoring.columns == FEATURES
    nested = flows.read_flows(spark, str(tmp_path), recursive=True)
    found = {(r.source_file.rsplit("/", 1)[1], r.Duration, r.SourceIP) for r in nested.collect()}
    assert found == {("a.csv", 1.5, "10.0.0.1"), ("a.csv", None, "10.0.0.3"), ("b.csv", 7.0, None), ("c.csv", 1.0, "10.9.9.9")}


def test_folder_of_mixed_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text("SourceIP,Duration,Label\n10.0.0.1,1.5,Benign\n")
    (tmp_path / "b.csv").write_text("Label,SourceIP,Duration\nMalicious,10.0.0.2,2.5\n")
    (tmp_path / "c.csv").write_text("SourceIP,Duration\n10.9.9.9,1\n")
    (tmp_path / "empty.csv").write_text("")
    for recursive in (False, True):
        got = flows.read_flows(spark, str(tmp_path), labelled=True, recursive=recursive).collect()
        assert {(r.SourceIP, r.Duration, r.Label) for r in got} == {("10.0.0.1", 1.5, "Benign"), ("10.0.0.2", 2.5, "Malicious")}


def test_packet_sequences(spark, tmp_path):
    write(
        tmp_path, **{
            "one.json": json.dumps([{"features": [[1.0, "x", 100], [3.5, "y", 50]], "meta": {"src_ip": "1.1.1.1"}}, {"features": [[9, 9, 9]]}]),
            "two.json": "[[[1, 0, 10], [2, 0, 20]]]", "empty.json": "[]", "odd.json": '[{"other": 1}]', "skip.txt": "[]",
        }
    )
    rows = packets.read_packet_sequences(spark, str(tmp_path)).orderBy("file", "pos").collect()
    one = [(r.pos, r.ts, r.size, r.src_ip, r.dst_ip) for r in rows if r.file == "one.json"]
    assert one == [(0, 1.0, 100.0, "1.1.1.1", "unknown"), (1, 3.5, 50.0, "1.1.1.1", "unknown")]
    assert [(r.ts, r.size) for r in rows if r.file == "two.json"] == [(1.0, 10.0), (2.0, 20.0)]
    errors = {r.file: r.error for r in rows if r.error}
    assert errors == {"empty.json": packets.EMPTY_FILE, "odd.json": packets.UNSUPPORTED}


SEQUENCES = {
    "a.json": '[{"meta": {"src_ip": "2.2.2.2", "dst_ip": "3.3.3.3"}, "features": [[1, 0, 10], ["2.5", 0, "x"]]}, {"features": [[9, 9, 9]]}]',
    "b.json": '[{"features": [[1,0,10]]}, {"meta": {"src_ip": "9.9.9.9"}, "features": [[7,7,7]]}]', "c.json": '[{"features": [], "meta": {"dst_ip": "4.4.4.4"}}]',
    "d.json": "[[[]]]", "e.json": "", "f.json": "null", "g.json": " [ ] ", "h.json": "{}", "i.json": '{"features": [[1, 2, 3]]}', "j.json": "[[1, 2, 3]]",
    "k.json": '[{"x": {"y": 1}, "features" : [ [1, 2, 3], [4, 5] ], "meta": {}}]', "l.json": '[{"x": 1}, {"features": [[1, 2, 3]]}]', "m.json": "[[[1,2,3]],[[4,5,6]]]",
    "n.json": "[[[1.5, null, 1e3]\n,\n[2,0,-4]]]\n", "o.json": "[1, 2]",
}


def test_packets_record_by_record_equal_whole_texts(spark, tmp_path):
    long = [[i / 7, i % 2, i % 1400] for i in range(20_000)]
    files = {**SEQUENCES, "long.json": json.dumps([{"features": long, "meta": {"src_ip": "5.5.5.5"}}])}
    write(tmp_path, **files)
    texts = spark.createDataFrame(list(files.items()), "file string, value string")
    want = sorted(map(repr, packets.parse_packet_sequences(texts).select("file", "src_ip", "dst_ip", "pos", "ts", "size", "error").collect()))
    # The long file is over a hundred times what a task may read of it.
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        read = packets.read_packet_sequences(spark, str(tmp_path))
        got = sorted(map(repr, read.select("file", "src_ip", "dst_ip", "pos", "ts", "size", "error").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want and len(got) > 20_000


def test_lines_of_a_split_file(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}\r" for i in range(3000)]
    write(tmp_path, **{"run__s__logs__predictor_1.log": "\n".join(lines), "run__s__logs__predictor_2.log": "a\n\nb\n", "run__s__logs__predictor_3.log": ""})
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        got = logs.read_run_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in got:
        by_file.setdefault(r.path[-5], []).append((r.line_no, r.line))
    assert sorted(by_file["1"]) == list(enumerate(lines)) and sorted(by_file["2"]) == [(0, "a"), (1, ""), (2, "b")] and "3" not in by_file


def test_dns_and_http(spark):
    df = spark.createDataFrame([(None, "a.b..",), ("1.1.1.1", "c.d")], "src_ip string, qname string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    assert {(r.src_ip, r.qname) for r in dns.dns_events(df).collect()} == {("unknown", "a.b"), ("1.1.1.1", "c.d")}
    cases = {
        "/dns-query?name=x.exfill.local&type=A": "x.exfill.local", "/dns-query?type=A": None, "/dns-query": None, "/dns-query?name=": None,
        "/dns-query?name=a=b": None, "/dns-query?name=x&q=1=2": None, "/dns-query?name=first?name=second": None, "/dns-query?a&name=b%2Ec": "b%2Ec",
        "/other?name=x": None, "/dns-query?name=x&name=y": "y", "/dns-query?name=p?z": "p",
    }
    made = spark.createDataFrame([(p, "www.doh.local:443") for p in cases] + [("/dns-query?name=x", "example.com")], "path string, host string")
    made = made.withColumns({"ts": F.lit("2025-01-01").cast("timestamp"), "src_ip": F.col("path")})
    got = {r.src_ip: r.qname for r in dns.doh_events(made).collect()}
    # Two equals signs in one parameter spoil the request; the text after a second question mark is not read.
    cases["/dns-query?name=first?name=second"] = "first"
    assert got == {p: n for p, n in cases.items() if n is not None}


def test_config(spark, tmp_path):
    write(tmp_path, **{"t__thresholds.json": '{"a": {"threshold": 0.2, "picked_on": "validation"}, "b": {}}', "bad__x.json": "not json"})
    got = {r.model: r.threshold for r in config.read_thresholds(spark, str(tmp_path / "t")).collect()}
    assert got == {"a": 0.2, "b": 0.5} and config.read_thresholds(spark, str(tmp_path / "bad")).count() == 0
    write(tmp_path, **{
        "s__stealth.json": json.dumps({"name": "n", "exfiltration_config": {"doh_server": "d", "target_domain": "t", "chunk_size": 12, "encoding": "custom", "backup_domains": ["x"], "base_delay": 8}}),
        "s__wrong.json": json.dumps({"exfiltration_config": {"encoding": "rot13", "timing_pattern": "never", "chunk_size": 1}}, indent=2),
    })
    scenarios = {r.scenario: r.config for r in config.read_scenarios(spark, str(tmp_path / "s")).collect()}
    assert (scenarios["stealth"].chunk_size, scenarios["stealth"].base_delay, scenarios["stealth"].backup_domains, scenarios["stealth"].timeout) == (12, 8.0, ["x"], 5.0)
    assert scenarios["wrong"].target_domain == "exfill.local" and scenarios["wrong"].backup_domains == []
    checked = {r.scenario: r.violations for r in config.validate_scenarios(config.whole_files(spark, str(tmp_path / "s"))).collect()}
    assert checked == {"stealth": [], "wrong": ["missing doh_server", "missing target_domain", "invalid encoding", "invalid timing_pattern"]}


def test_logs_and_split(spark, tmp_path):
    write(tmp_path, **{"run-1__burst__logs__predictor_a.log": "one\ntwo", "run-1__burst__logs__client.log": "no"})
    lines = [(r.run, r.scenario, r.line_no, r.line) for r in logs.read_run_logs(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert lines == [("run-1", "burst", 0, "one"), ("run-1", "burst", 1, "two")]
    assert logs.log_files(spark, str(tmp_path)).count() == 1
    table = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "SourceIP string, DestinationIP string")
    sinks.write_split(table, "b", str(tmp_path / "split"))
    assert spark.read.csv(str(tmp_path / "split" / "is_match=true"), header=True).count() == 2
    assert spark.read.csv(str(tmp_path / "split" / "is_match=false"), header=True).count() == 1
    with pytest.raises(ValueError):
        sinks.write_split(spark.range(1), "b", str(tmp_path / "none"))


def test_files_appear_all_or_none(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}.bin", bytes([i])) for i in range(20)], "file_name string, content binary").repartition(4)
    export_files(rows, str(tmp_path / "good"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "good").iterdir()} == {f"f{i}.bin": bytes([i]) for i in range(20)}
    # One name in the last rows cannot be a file's; the files of the tasks that worked do not stay either.
    bad = rows.withColumn("file_name", F.when(F.col("content") == bytes([13]), F.lit("../f13")).otherwise(F.col("file_name")))
    with pytest.raises(Exception, match="no name for a file"):
        export_files(bad, str(tmp_path / "bad"))
    assert list((tmp_path / "bad").iterdir()) == [] and not (tmp_path / "f13").exists()
    with pytest.raises(ValueError):
        export_files(rows, "hdfs://host/folder")


def test_times_of_chunks_of_long_documents(spark, tmp_path):
    """Chunk 8,590 of a document is 2^31 microseconds after its first one."""
    chunks = 8600
    text = "x" * (chunks * adapters.CHUNK_CHARS // 2)
    spark.createDataFrame([(1, text, "en"), (2, "ab", "de")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    times = [F.unix_micros("ts").alias("us"), "seq"]
    for made, shift in ((adapters.encoded_queries, 0), (adapters.repeated_queries, 7_200_000_000)):
        rows = made(spark, str(tmp_path)).where(F.col("qname").startswith("1-")).select(*times)
        last = rows.orderBy(F.desc("us")).first()
        assert (last.seq, last.us) == (chunks - 1, adapters.FIRST_MOMENT_US + 60_000_000 + (chunks - 1) * 250_000 + shift)


def test_trees_of_many_parts_get_few_files_and_one_read(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).repartition(8).select(
        F.lit("10.0.0.1").alias("SourceIP"), F.col("id").cast("double").alias("Duration"), (F.col("id") % 20).cast("int").alias("part")
    )
    sinks.write_parts(rows, f"{tmp_path}/tree", "part")
    assert len(list((tmp_path / "tree").glob("part=*/*.csv"))) == 20
    monkeypatch.setattr(flows, "_HEADER_GROUP", 3)
    read = flows.read_flows(spark, f"{tmp_path}/tree", recursive=True)
    assert "Union" not in read._jdf.queryExecution().optimizedPlan().toString()
    part = F.regexp_extract("source_file", "part=([0-9]+)/", 1)
    found = {(r.part, r.n, r.s) for r in read.groupBy(part.alias("part")).agg(F.count("Duration").alias("n"), F.sum("Duration").alias("s")).collect()}
    assert found == {(str(p), 200, float(sum(range(p, 4000, 20)))) for p in range(20)}
    # Another header in the tree: every file is read by its own again.
    (tmp_path / "tree" / "other.csv").write_text("Duration,SourceIP\n7,10.0.0.2\n")
    both = flows.read_flows(spark, f"{tmp_path}/tree", recursive=True)
    assert both.count() == 4001 and both.where("SourceIP = '10.0.0.2'").first().Duration == 7.0


@pytest.mark.parametrize("name", ["log_files", "packet_files"])
def test_small_files_are_written_by_many_tasks(spark, monkeypatch, name):
    """Rows of many small files have few bytes; their files are not left to one task."""
    partitions, packets_of = [], adapters.event_packets

    class Written(Exception):
        pass

    def text(writer, path, **options):
        partitions.append(writer._df.rdd.getNumPartitions())
        raise Written

    users = spark.range(400).selectExpr(
        "id AS event_id", "timestamp_micros(1700000000000000 + id) AS ts", "id % 50 AS user_id", "'click' AS event_type", "1.0D AS value",
    )
    turns = spark.range(400).selectExpr("id % 50 AS conv_id", "CAST(id DIV 50 AS INT) AS turn", "'user' AS role", "'hello' AS text")
    monkeypatch.setattr(adapters, "table", lambda spark, folder, name: {"events": users, "conversations": turns}[name])
    monkeypatch.setattr(adapters, "event_packets", lambda spark, folder: packets_of(spark, folder, lambda *_: users))
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.text", text)
    with pytest.raises(Written):
        getattr(files, name)(spark, "unused")
    assert partitions[0] >= spark.sparkContext.defaultParallelism


def test_packet_files_are_listed_once(spark, tmp_path, monkeypatch):
    """Listing a tree of many folders takes longer than reading it."""
    from pyspark.sql import DataFrameReader

    read, listed = DataFrameReader.text, []
    monkeypatch.setattr(DataFrameReader, "text", lambda self, *args, **options: listed.append(args) or read(self, *args, **options))
    (tmp_path / "c.json").write_text('[{"features": [[1, 0, 5], [2, 0, 6]], "meta": {"src_ip": "x"}}]')
    (tmp_path / "d.json").write_text("")
    got = packets.read_packet_sequences(spark, str(tmp_path)).collect()
    assert len(listed) == 1
    assert sorted((r.file, r.size, r.error) for r in got if r.size) == [("c.json", 5.0, None), ("c.json", 6.0, None)]
    assert [r.error for r in got if r.file == "d.json"] == [packets.EMPTY_FILE]
