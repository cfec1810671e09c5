import base64
import contextlib
import hashlib
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowsight.functions.codec import alphabet_of, decode_as, decode_cascade
from flowsight.functions.signatures import file_type
from flowsight.operators import reassembly
from flowsight.operators.reassembly import (
    identify, malformed, missing_ranges, parse_chunks, progress, reassemble, session_texts, suspicious, transfer_stats,
)
from flowsight.plans import adapters
from flowsight.sources.sinks import export_payload_files, payload_table

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


def events(spark, rows):
    """rows: (source, qname) in order of arrival, a second apart."""
    made = [(START + timedelta(seconds=i), source, name, i) for i, (source, name) in enumerate(rows)]
    return spark.createDataFrame(made, "ts timestamp, src_ip string, qname string, seq bigint")


def names(session, data: bytes, size=8, total=None):
    text = base64.urlsafe_b64encode(data).decode().rstrip("=")
    parts = [text[i:i + size] for i in range(0, len(text), size)]
    return [f"{session}-{i:04d}-{total or len(parts):04d}-{p}.exfill.local" for i, p in enumerate(parts)]


def payloads(spark, rows, **options):
    found = reassemble(events(spark, rows), **options)
    return {(r["src_ip"] if "src_ip" in found.columns else None, r["session_id"]): bytes(r["payload"]) for r in found.collect()}


def test_names(spark):
    rows = [(None, n) for n in [
        "17552737-0020-0274--29v_x.exfill.local", "17552737-0000-0274-H4sI.ab12cd.exfill.local", "0-dGVzdCBkYXRh.a1b2c.exfill.local",
        "1-2-3-x.cdn-assets.local", "metadata.example.com", "exfill", "1-1-1-A.DATA.local", "99999999999999999999-99999999999999999999-3-x.leak.local",
    ]]
    frame = events(spark, rows)
    assert suspicious(frame).count() == 7
    parsed = {(r.session_id, r.idx, r.total, r.chunk) for r in parse_chunks(frame).collect()}
    assert parsed == {("17552737", 20, 274, "-29v_x"), ("17552737", 0, 274, "H4sI"), ("1", 1, 1, "A"), ("99999999999999999999", 2**63 - 1, 3, "x")}
    assert {r.qname for r in malformed(frame).collect()} == {"0-dGVzdCBkYXRh.a1b2c.exfill.local", "metadata.example.com"}


def test_order_copies_and_gaps(spark):
    data = bytes(range(60))
    whole = names("7", data)
    shuffled = whole * 2
    random.Random(1).shuffle(shuffled)
    assert payloads(spark, [("a", n) for n in shuffled]) == {("a", "7"): data}
    assert payloads(spark, [("a", n) for n in whole if "-0002-" not in n]) == {}
    # The last chunk to arrive under an index wins.
    wrong = whole[1].rsplit("-", 1)[0] + "-AAAA.exfill.local"
    assert payloads(spark, [("a", n) for n in [wrong, *whole]]) == {("a", "7"): data}
    # An index past the end keeps a transfer open, as does a total of zero; after the last chunk it opens the next one.
    stray = "7-0099-0010-AA.exfill.local"
    assert payloads(spark, [("a", n) for n in [whole[0], stray, *whole[1:]]]) == {}
    assert payloads(spark, [("a", n) for n in [*whole, stray]]) == {("a", "7"): data}
    assert payloads(spark, [("a", "8-0000-0000-AAAA.exfill.local")]) == {}
    # The first total seen counts: the transfer ends with the third chunk, and the rest opens one that stays open.
    assert payloads(spark, [("a", n) for n in [names("7", data, total=3)[0], *whole]]) == {("a", "7"): data[:18]}
    late = names("7", data, total=3)[0]
    assert payloads(spark, [("a", n) for n in [*whole, late]]) == {("a", "7"): data}


def test_transfers_one_after_the_other(spark):
    texts = [b"first payload", b"the second one is longer than that", b"3"]
    rows = [("a", n) for text in texts for n in names("7", text)] + [("b", n) for n in names("7", texts[1])]
    rows += [("a", "7-0099-0010-AA.exfill.local")] + [("a", n) for n in names("7", b"after a stray chunk")]
    found = reassemble(events(spark, rows)).collect()
    assert {(r.src_ip, r.transfer, bytes(r.payload)) for r in found} == {("b", 0, texts[1])} | {("a", i, t) for i, t in enumerate(texts)}
    # Copies that arrive before the end belong to the transfer, copies after it open another that stays open.
    copies = names("8", texts[1])
    found = reassemble(events(spark, [("a", n) for n in [copies[0], *copies, *copies[:-1]]])).collect()
    assert [(r.transfer, bytes(r.payload)) for r in found] == [(0, texts[1])]


def plain_transfers(rows):
    """(source, session, transfer, text) by the rule of module transfers, one arrival after the other."""
    state, out = {}, []
    for source, name in rows:
        session, idx, total, chunk = re.match(r"(\d+)-(\d+)-(\d+)-([^.]+)", name).groups()
        idx, total = int(idx), int(total)
        s = state.setdefault((source, session), {"open": None, "number": 0, "last": None, "whole": None})
        if s["last"] == (idx, total, chunk):
            continue
        s["last"] = (idx, total, chunk)
        if s["open"] is None:
            s["open"], s["total"] = {}, total
        s["open"][idx] = chunk
        if sorted(s["open"]) == list(range(s["total"])):
            if s["open"] != s["whole"]:
                out.append((source, session, s["number"], "".join(s["open"][i] for i in sorted(s["open"]))))
            s["whole"], s["open"], s["number"] = s["open"], None, s["number"] + 1
    return sorted(out)


def batch_transfers(frame):
    texts = session_texts(frame, piece_chars=None).collect()
    return sorted((r.src_ip, r.session_id, r.transfer, r.text) for r in texts)


@pytest.mark.parametrize("seed", range(6))
def test_transfers_follow_the_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for source in "ab":
        for session in range(3):
            totals, here = rng.choice([[1], [2], [1, 2], [2, 3], [3, 4, 5]]), []
            for _ in range(rng.randint(5, 60)):
                total = rng.choice(totals)
                stray = 1 if rng.random() < 0.03 else 0
                name = f"{session}-{rng.randrange(total + stray)}-{total}-{rng.choice('AB')}.leak.local"
                here += [name] * (3 if rng.random() < 0.1 else 1)
            rows += [(source, n) for n in here]
    rng.shuffle(rows)
    assert batch_transfers(events(spark, rows)) == plain_transfers(rows)


def test_many_resends(spark):
    """A name sent again and again is one payload; two names in turn are a payload each time, found in log-many rounds."""
    again = spark.range(100_000).select(
        F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.lit("a").alias("src_ip"), F.lit("4-0000-0001-aGVs.exfill.local").alias("qname"),
        F.col("id").alias("seq"),
    )
    found = reassemble(again).collect()
    assert [(r.transfer, bytes(r.payload)) for r in found] == [(0, b"hel")]
    turns = again.limit(5000).withColumn("qname", F.when(F.col("seq") % 2 == 0, F.col("qname")).otherwise(F.lit("4-0000-0001-bG8.exfill.local")))
    counted = session_texts(turns).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max("transfer").alias("last")).collect()
    assert sorted(tuple(r) for r in counted) == [("aGVs", 2500, 4998), ("bG8", 2500, 4999)]


def test_session_key(spark):
    one, two = names("5", b"first payload"), names("5", b"other payload")
    both = [("a", n) for n in one] + [("b", n) for n in two]
    assert payloads(spark, both) == {("a", "5"): b"first payload", ("b", "5"): b"other payload"}
    split = [("a" if i % 2 else "b", n) for i, n in enumerate(one)]
    assert payloads(spark, split) == {}
    assert payloads(spark, split, key="session") == {(None, "5"): b"first payload"}


@pytest.mark.parametrize("size", [1, 7, 30])
def test_pieces_join_to_the_payload(spark, size):
    data = random.Random(2).randbytes(5000)
    found = reassemble(events(spark, [("a", n) for n in names("9", data, size)]), piece_chars=1024).orderBy("piece").collect()
    assert len(found) == found[0].pieces == 7
    assert b"".join(bytes(r.payload) for r in found) == data
    for cut in (1024, 1 << 20):
        identity = identify(reassemble(events(spark, [("a", n) for n in names("9", data, size)]), piece_chars=cut)).first()
        assert identity["payload_id"] == hashlib.sha256(data).hexdigest() and identity["size"] == len(data)


def test_foreign_characters_at_any_size(spark):
    text = base64.urlsafe_b64encode(random.Random(3).randbytes(300)).decode()
    text = "".join(c + "!" * (i % 37 == 5) for i, c in enumerate(text))
    parts = [text[i:i + 7] for i in range(0, len(text), 7)]
    rows = [("a", f"9-{i}-{len(parts)}-{p}.exfill.local") for i, p in enumerate(parts)]
    found = [bytes(reassemble(events(spark, rows), decode_mode="cascade", piece_chars=n).first()["payload"]) for n in (16, 1 << 20)]
    assert found[0] == found[1] == base64.urlsafe_b64decode(text)


def test_decoding_round_trips(spark):
    rng = random.Random(4)
    rows, want = [], []
    for n in range(0, 70):
        data = rng.randbytes(n)
        for name, text in (
            ("hex", data.hex()), ("base32", base64.b32encode(data).decode()), ("base32", base64.b32encode(data).decode().rstrip("=")),
            ("base64url", base64.urlsafe_b64encode(data).decode()), ("base64url", base64.urlsafe_b64encode(data).decode().rstrip("=")),
        ):
            rows.append((len(rows), name, text))
            want.append(data)
    df = spark.createDataFrame(rows, "i int, name string, text string")
    decoded = df.select("i", decode_as(F.col("text"), F.col("name")).alias("d"), alphabet_of(F.col("text")).alias("a")).collect()
    assert all(bytes(r.d) == want[r.i] for r in decoded)
    # Long texts are told apart by their characters.
    assert all(r.a == rows[r.i][1] for r in decoded if len(want[r.i]) > 24)


def test_cascade_agrees_with_the_lenient_decoders(spark):
    fill = lambda text, block: text + "=" * (-len(text) % block)
    attempts = [
        lambda text: base64.urlsafe_b64decode(fill(text, 4)), lambda text: base64.b64decode(fill(text, 4) + "===="),
        lambda text: base64.b32decode(fill(text, 8)), lambda text: fill(text, 8).encode(),
    ]

    def expected(text):
        for attempt in attempts:
            with contextlib.suppress(ValueError):
                return attempt(text)

    rng = random.Random(6)
    texts = ["".join(rng.choices("ABCXYZ234abz019-_", k=n)) for n in range(1, 60)] + ["ABCDE", "ABCDEFGH2", "a!b", "a!b!c!d!e", "ab=c", "ab==cd", "abc=", "é", "MFRGG", "....."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", decode_cascade(F.col("t")).alias("d")).collect():
        assert bytes(r.d.payload) == expected(texts[r.i]), texts[r.i]


def test_file_types(spark):
    cases = {
        b"\x89PNG\r\n\x1a\nx": ("PNG Image", ".png"), b"\xff\xd8\xff\xe0": ("JPEG Image", ".jpg"), b"PK\x03\x04": ("ZIP/Office Document", ".zip"),
        b"\x7fELF": ("ELF Executable", ""), b"RIFF": ("RIFF (Audio/Video)", ".wav/.avi"), b"hello": ("Binary Data", ".bin"), b"": ("empty", None),
        b"MZ": ("Windows Executable", ".exe"), b"BZh9": ("BZIP2 Archive", ".bz2"), b"Rar!": ("RAR Archive", ".rar"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "p binary").select("p", file_type(F.col("p")).alias("t"))
    assert {bytes(r.p): (r.t.type, r.t.extension) for r in df.collect()} == cases


def test_progress_ranges_and_transfer(spark):
    rows = [("a", f"3-{i}-10-abcd.leak.local") for i in (0, 1, 4, 4, 7)]
    got = progress(events(spark, rows)).first()
    assert (got.received, got.total, got.arrivals, got.missing, got.complete) == (4, 10, 5, 6, False)
    ranges = [(r.first_missing, r.last_missing) for r in missing_ranges(events(spark, rows)).orderBy("first_missing").collect()]
    assert ranges == [(2, 3), (5, 6), (8, 9)]
    stats = transfer_stats(events(spark, rows)).first()
    assert (stats.duration, stats.chunks, stats.bytes, stats.repeats, stats.success_rate, stats.throughput) == (4.0, 4, 16, 1, 40.0, 4.0)


def test_payload_sink(spark, tmp_path):
    found = reassemble(events(spark, [("a", n) for n in names("12", b"RIFF....WAVE")]))
    row = payload_table(found).first()
    assert row.file_name == f"exfiltrated_a_12_0_{int(START.timestamp())}000000.wav"
    export_payload_files(found, str(tmp_path / "out"))
    assert (tmp_path / "out" / row.file_name).read_bytes() == b"RIFF....WAVE"


def test_chunk_rows_are_neither_stored_nor_kept_where_counts_do(spark, monkeypatch):
    """Blocks are stored, not rows per chunk; summaries of sessions do not shuffle the chunks nor join them again."""
    rows = [("a", n) for i in range(5) for n in names(str(i), bytes(range(60)))]
    stored = []
    kept = reassembly.cut_lineage
    monkeypatch.setattr(reassembly, "cut_lineage", lambda df: stored.append(df.columns) or kept(df))
    assert len(payloads(spark, rows)) == 5
    assert "text" in stored[0] and all("chunk" not in columns and "idx" not in columns for columns in stored)
    frame = events(spark, [r for r in rows if "-0003-" not in r[1]])
    plan = missing_ranges(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "chunk" not in plan.split("Project")[0].lower()
    assert [(r.session_id, r.missing) for r in progress(frame).orderBy("session_id").collect()] == [(str(i), 1) for i in range(5)]
    del stored[:]
    # An index past the announced ones: the sessions that have one are counted once more.
    strange = events(spark, [*rows[:10], ("a", "0-0099-0010-AAAA.exfill.local"), ("b", "0-0000-0002-AAAA.exfill.local")])
    assert {(r.src_ip, r.received, r.missing) for r in progress(strange).collect()} == {("a", 11, 0), ("b", 1, 1)}
    assert {(r.src_ip, r.first_missing, r.last_missing) for r in missing_ranges(strange).collect()} == {("b", 1, 1)}


def _shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_texts_of_one_block_are_not_shuffled_again(spark):
    rows = [(s, n) for s in "ab" for n in names("7", bytes(range(60)))]
    found = reassemble(events(spark, rows))
    assert _shuffles(found) == 0 and found.count() == 2
    assert _shuffles(payload_table(found).where("pieces = 1")) <= _shuffles(identify(found))


def test_a_block_is_not_whole_if_the_session_has_another(spark):
    data = bytes(range(60))
    whole, late = names("7", data), f"7-{reassembly.BLOCK_CHUNKS + 5}-0010-AAAA.exfill.local"
    rows = [("a", late), *[("a", n) for n in whole], *[("b", n) for n in whole]]
    for options in ({}, {"piece_chars": 16}, {"decode_mode": "cascade"}):
        found = reassemble(events(spark, rows), **options).orderBy("src_ip", "piece").collect()
        assert {r.src_ip for r in found} == {"b"} and b"".join(bytes(r.payload) for r in found) == data


def test_cascade_decodes_once_per_transfer(spark):
    found = reassemble(events(spark, [("a", n) for n in names("7", bytes(range(60)))]), decode_mode="cascade")
    used = found.where(F.col("encoding") == "base64url").select("encoding", F.sha2("payload", 256), F.length("payload"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z0-9+/=]") == found._jdf.queryExecution().optimizedPlan().toString().count("[^A-Za-z0-9+/=]")


def test_names_are_made_once_and_not_in_a_filter(spark, tmp_path):
    rows = [(7, "a b", "en"), (None, "x" * 40, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = adapters.document_queries(spark, str(tmp_path))
    assert "7-0000-0001-YSBi.exfill.local" in {r.qname for r in found.collect()}
    assert {r.qname.split("-")[0] for r in found.collect()} == {"7", "null"}
    plan = parse_chunks(found)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "qname" in line or "format_string" in line]
    assert filters and not any("format_string" in line or "concat(" in line for line in filters)
