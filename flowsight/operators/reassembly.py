"""From DNS queries to payloads: find chunk names, group them into sessions, check, join, decode, identify.

A session may hold any share of the chunks. Chunks are combined per (session, index) before anything
meets, then joined in blocks of a fixed number of indexes. A payload longer than PIECE_CHARS is
returned in aligned pieces, one row each, whose bytes in order are the payload; no row holds more.

A session id can carry several transfers one after the other; module transfers states the rule by which one ends and
the next begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsight.functions.codec import alphabet_flags, choose_alphabet, decode_as, decode_cascade
from flowsight.functions.names import KEYWORDS, chunk_fields, has_parent, is_chunk_name, is_suspicious
from flowsight.functions.numeric import epoch_us
from flowsight.functions.signatures import file_type
from flowsight.operators.ordered import shared
from flowsight.operators.transfers import copies_of_the_one_before, number_transfers
from flowsight.runtime import cut_lineage, stored

BLOCK_CHUNKS = 4096
# A multiple of 8 characters, so pieces decode on their own in every alphabet.
PIECE_CHARS = 1 << 20


def suspicious(events: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    return events.where(is_suspicious(F.col("qname"), keywords))


def parse_chunks(events: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Events of suspicious names with a chunk label, with session_id, idx, total and chunk."""
    named = suspicious(events, keywords).where(is_chunk_name(F.col("qname")))
    return named.withColumns(chunk_fields(F.col("qname")))


def malformed(events: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Events of suspicious names of two labels or more whose first label is no chunk label."""
    return suspicious(events, keywords).where(
        has_parent(F.col("qname")) & ~is_chunk_name(F.col("qname"))
    )


def session_keys(key: str) -> list[str]:
    """Session ids repeat between sources, so the source is part of the key unless key is "session"."""
    return {"source": ["src_ip", "session_id"], "session": ["session_id"]}[key]


def _arrival(df: DataFrame) -> DataFrame:
    if "us" in df.columns:
        return df
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(0)) if "seq" in df.columns else F.lit(0).cast("bigint")
    return df.withColumns({
        "src_ip": F.coalesce(F.col("src_ip"), F.lit("unknown")),
        "us": F.coalesce(epoch_us(F.col("ts")), F.lit(0)), "seq": seq,
    })


def _went_on(blocks: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of sessions in which something arrived after their first transfer had ended; None if there are none."""
    sessions = blocks.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("max_idx").alias("max_idx"), F.min("first").alias("start"), F.sum("arrivals").alias("arrivals"),
        F.max("whole").alias("whole"), F.max("last").alias("last"),
    ).withColumn("total", F.col("start.total"))
    # Only sessions with all announced indexes and something more can have gone on. They are stored, so that Spark knows how
    # few they are.
    more = (F.col("arrivals") > F.col("n")) | (F.col("n") > F.col("total"))
    candidates = cut_lineage(sessions.where(more & (F.col("n") >= F.col("total")) & (F.col("total") > 0)))
    if candidates.isEmpty():
        return None
    clean = (F.col("n") == F.col("total")) & (F.col("max_idx") == F.col("total") - 1)
    plain = candidates.where(clean & (F.col("last") > F.col("whole"))).select(*keys)
    # Where indexes outside the announced ones came too, they must have come after the transfer was whole.
    strange = candidates.where("n > total and max_idx >= total").select(*keys, "total")
    if strange.isEmpty():
        return _some(plain)
    inside = F.col("idx") < F.col("total")
    came = _came(F.col("first"))
    latest = latest_chunks(_arrival(chunks).join(strange.select(*keys), keys, "left_semi"), keys=keys)
    judged = latest.join(strange, keys).groupBy(*keys, "total").agg(
        F.count_if(inside).alias("n"), F.max(F.when(inside, came)).alias("whole"), F.min(F.when(~inside, came)).alias("stray"),
    )
    late = judged.where((F.col("n") == F.col("total")) & (F.col("stray") > F.col("whole"))).select(*keys)
    return _some(plain.unionByName(late))


def _some(sessions: DataFrame) -> DataFrame | None:
    kept = stored(sessions)
    return None if kept.isEmpty() else kept


def _arrivals_by_block(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Arrivals with their block of BLOCK_CHUNKS indexes; those of a block lie in one task, which sorts them and holds none."""
    placed = _arrival(chunks).withColumn("block", F.floor(F.col("idx") / BLOCK_CHUNKS))
    return placed.select(*keys, "block", "us", "seq", "idx", "total", "chunk").repartition(*keys, "block")


def transfer_blocks(chunks: DataFrame, key: str = "source") -> DataFrame:
    """Blocks of chunks per transfer: the number (from 0) of a transfer in its session is in column transfer.

    Most sessions carry one transfer. Their blocks are stored, which takes little more than their texts, and aggregates
    over them tell which sessions went on after a transfer had ended; only the arrivals of those are numbered one by one. Copies of the
    transfer before them keep their number but give no blocks.
    """
    keys = session_keys(key)
    blocks = cut_lineage(_blocks(latest_chunks(_arrivals_by_block(chunks, keys), keys=[*keys, "block"]), keys))
    went_on = _went_on(blocks, chunks, keys)
    if went_on is None:
        return blocks.withColumn("transfer", F.lit(0))
    single = blocks.join(went_on, keys, "left_anti").withColumn("transfer", F.lit(0))
    arrivals = _arrival(chunks).join(went_on, keys, "left_semi").select(*keys, "us", "seq", "idx", "total", "chunk")
    several = cut_lineage(latest_chunks(number_transfers(arrivals, keys), keys=[*keys, "transfer"]))
    copies = copies_of_the_one_before(several, keys)
    several = several.join(copies, [*keys, "transfer"], "left_anti")
    return single.unionByName(stored(_blocks(several, [*keys, "transfer"])))


def transfer_keys(key: str) -> list[str]:
    return [*session_keys(key), "transfer"]


def latest_chunks(chunks: DataFrame, key: str = "source", keys: list[str] | None = None, of: str | None = "chunk") -> DataFrame:
    """One row per session (or other keys) and index: the chunk that arrived last, and the first arrival with its total.

    `of` is what is kept of the chunk, such as "length(chunk)"; None for nothing.
    """
    last = F.max(F.struct("us", "seq", *([] if of is None else [F.expr(of).alias("chunk")]))).alias("last")
    latest = _arrival(chunks).groupBy(*(keys or session_keys(key)), "idx").agg(
        last, F.min(F.struct("us", "seq", "total")).alias("first"), F.sum(F.lit(1)).alias("arrivals"),
    )
    chunk = [] if of is None else [F.col("last.chunk").alias("chunk")]
    return latest.select(*(keys or session_keys(key)), "idx", *chunk, "first", _came(F.col("last")).alias("last"), "arrivals")


def _came(first: Column) -> Column:
    return F.struct(first["us"].alias("us"), first["seq"].alias("seq"))


def _blocks(latest: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks joined in index order per block of BLOCK_CHUNKS indexes, with when the last index first came and the last arrival."""
    if "block" not in latest.columns:
        latest = latest.withColumn("block", F.floor(F.col("idx") / BLOCK_CHUNKS))
    ordered = F.sort_array(F.collect_list(F.struct("idx", "chunk")))
    blocks = latest.groupBy(*keys, "block").agg(
        F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("text"),
        F.sum(F.lit(1)).alias("n"), F.max("idx").alias("max_idx"), F.min("first").alias("first"),
        F.sum("arrivals").alias("arrivals"), F.max(_came(F.col("first"))).alias("whole"), F.max("last").alias("last"),
    )
    return shared(blocks, "n", "max_idx", "first")


def _core_length(text: Column) -> Column:
    return F.length(F.rtrim(text, F.lit("=")))


def _complete_sessions(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Transfers with every index 0..total-1 and no other, total being that of the first chunk seen."""
    flags = alphabet_flags(F.col("text"))
    blocks = blocks.withColumns({f"_{name}": flag for name, flag in flags.items()})
    sessions = blocks.groupBy(*keys).agg(
        F.sum("n").alias("chunks"), F.max("max_idx").alias("max_idx"), F.min("first").alias("first"),
        F.sum(F.length("text")).alias("chars"), F.sum(_core_length(F.col("text"))).alias("core_chars"),
        *[F.bool_and(f"_{name}").alias(name) for name in flags],
    )
    total = F.col("first.total")
    complete = (F.col("chunks") == total) & (F.col("max_idx") == total - 1)
    alphabet = choose_alphabet({name: F.col(name) for name in flags}, F.col("core_chars"))
    return sessions.where(complete).select(
        *keys, "chunks", "chars", F.col("first.us").alias("started_us"), alphabet.alias("alphabet")
    )


def _whole_blocks(blocks: DataFrame) -> DataFrame:
    """Complete transfers of one block each, with what _complete_sessions gives."""
    total = F.col("first.total")
    complete = blocks.where((F.col("n") == total) & (F.col("max_idx") == total - 1))
    alphabet = choose_alphabet(alphabet_flags(F.col("text")), _core_length(F.col("text")))
    return complete.withColumns({
        "chunks": F.col("n"), "chars": F.length("text").cast("bigint"), "started_us": F.col("first.us"), "alphabet": alphabet,
    })


def _long_texts(blocks: DataFrame, keys: list[str], piece_chars: int) -> DataFrame:
    """Block texts cut at multiples of piece_chars and joined again per piece."""
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2^63 / BLOCK_CHUNKS indexes exist but only complete sessions come here, so a session has
    # chars / BLOCK_CHUNKS rows at most, and this window sees numbers only.
    starts = blocks.select(*keys, "block", F.length("text").cast("bigint").alias("_chars"))
    starts = starts.select(
        *keys, "block", F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("start")
    )
    placed = blocks.join(starts, [*keys, "block"])
    end = F.col("start") + F.length("text")
    first_piece = F.floor(F.col("start") / piece_chars)
    last_piece = F.floor((end - 1) / piece_chars)
    cut = placed.withColumn("piece", F.explode(F.sequence(first_piece, last_piece)))
    from_char = F.greatest(F.col("piece") * piece_chars - F.col("start"), F.lit(0))
    to_char = F.least((F.col("piece") + 1) * piece_chars - F.col("start"), F.length("text").cast("bigint"))
    cut = cut.withColumn(
        "part", F.substring("text", (from_char + 1).cast("int"), (to_char - from_char).cast("int"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("block", "part")))
    return cut.groupBy(*keys, "chunks", "chars", "started_us", "alphabet", "piece").agg(
        F.array_join(F.transform(ordered, lambda b: b["part"]), "").alias("text")
    )


def session_texts(
    events: DataFrame, key: str = "source", keywords: Sequence[str] = KEYWORDS, piece_chars: int | None = PIECE_CHARS
) -> DataFrame:
    """Text of every complete transfer: one row, or one row per piece of piece_chars characters (None: never cut)."""
    if piece_chars is not None and piece_chars % 8:
        raise ValueError("piece_chars must be a multiple of 8")
    keys = transfer_keys(key)
    blocks = transfer_blocks(parse_chunks(events, keywords), key)
    columns = [*keys, "chunks", "chars", "started_us", "alphabet"]
    # Most transfers are one block, whose row tells all about them; only the others are gathered.
    about = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.max(F.length("text")).alias("longest"))
    too_long = F.lit(False) if piece_chars is None else F.col("longest") > piece_chars
    gathered = stored(about.where((F.col("blocks") > 1) | too_long).select(*keys))
    whole = _whole_blocks(blocks.join(gathered, keys, "left_anti").dropna(subset=keys))
    whole = whole.select(*columns, F.lit(0).cast("bigint").alias("piece"), "text")
    if gathered.isEmpty():
        return whole
    blocks = stored(blocks.join(gathered, keys, "left_semi"))
    sessions = _complete_sessions(blocks, keys)
    texts = blocks.select(*keys, "block", "text").join(sessions, keys)
    if piece_chars is None:
        ordered = F.sort_array(F.collect_list(F.struct("block", "text")))
        joined = texts.groupBy(*columns).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "").alias("text"))
        return whole.unionByName(joined.select(*columns, F.lit(0).cast("bigint").alias("piece"), "text"))
    return whole.unionByName(_long_texts(texts, keys, piece_chars).select(*columns, "piece", "text"))


def reassemble(
    events: DataFrame,
    key: str = "source",
    decode_mode: str = "alphabet",
    keywords: Sequence[str] = KEYWORDS,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """Payloads of complete transfers: (keys, transfer, chunks, started_us, piece, pieces, encoding, payload).

    decode_mode "alphabet" picks the decoder by the characters of the whole transfer, and every piece decodes by it on its
    own. "cascade" tries base64 first whatever the text. It skips foreign characters, so where a byte starts depends on
    all the text before it: in this mode a transfer is never cut and its text must fit a row.
    """
    if decode_mode not in ("alphabet", "cascade"):
        raise ValueError(f"unknown decode mode: {decode_mode}")
    cascade = decode_mode == "cascade"
    texts = session_texts(events, key, keywords, None if cascade else piece_chars)
    pieces = F.lit(1) if cascade else F.greatest(F.ceil(F.col("chars") / piece_chars), F.lit(1))
    decoded = decode_cascade(F.col("text")) if cascade else F.struct(
        decode_as(F.col("text"), F.col("alphabet")).alias("payload"), F.col("alphabet").alias("encoding")
    )
    # A generated column is made once per row, however often the plans that follow ask for it.
    made = texts.select(*transfer_keys(key), "chunks", "started_us", "piece", pieces.cast("bigint").alias("pieces"), F.inline(F.array(decoded)))
    return made.select(*transfer_keys(key), "chunks", "started_us", "piece", "pieces", "encoding", "payload")


def _digest_in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 over the payloads of each group of rows in the order of piece, one piece in memory at a time."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.select(*keys).schema)}, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out = []
            for *group, payload in zip(*(batch[k].to_pylist() for k in keys), batch["payload"].to_pylist()):
                if group != current:
                    if current is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = group, hashlib.sha256()
                state.update(payload or b"")
            if out:
                yield _as_batch(out, batch)
        if current is not None:
            yield _as_batch([(*current, state.hexdigest())], batch)

    def _as_batch(out: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [like.schema.field(k).type for k in keys] + [pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [*keys, "digest"])

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "piece").select(*keys, "payload")
    return ordered.mapInArrow(run, schema)


def identify(payloads: DataFrame, key: str = "source") -> DataFrame:
    """One row per transfer: size, type, extension and payload_id, the SHA-256 of the whole payload whatever its size."""
    keys = transfer_keys(key)
    about = payloads.groupBy(*keys).agg(
        F.sum(F.length("payload").cast("bigint")).alias("size"), F.max("encoding").alias("encoding"),
        F.max(F.when(F.col("piece") == 0, file_type(F.col("payload")))).alias("kind"), F.max("pieces").alias("pieces"),
        F.max(F.when(F.col("pieces") == 1, F.sha2("payload", 256))).alias("single"),
    )
    # Digests of payloads in pieces are taken in order, a piece at a time.
    long = _digest_in_order(payloads.where("pieces > 1").select(*keys, "piece", "payload"), keys)
    return about.join(long, keys, "left").select(
        *keys, "size", "encoding", F.col("kind.type").alias("type"), F.col("kind.extension").alias("extension"),
        F.coalesce("single", "digest").alias("payload_id"), "pieces",
    )


def distinct_payloads(identified: DataFrame, key: str = "source") -> DataFrame:
    """Each payload once, with the number of sessions that carried it."""
    return identified.groupBy("payload_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.min("size").alias("size"), F.min("type").alias("type"),
    )


def progress(events: DataFrame, key: str = "source", keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Per session: distinct chunks received, expected total, missing count and completeness.

    The counts per session are stored. Only sessions with an index past the announced ones are looked at once more.
    """
    keys, chunks = session_keys(key), parse_chunks(events, keywords)
    latest = latest_chunks(chunks, key, of=None)
    sessions = cut_lineage(latest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.max("idx").alias("max_idx"), F.min("first")["total"].alias("total"),
        F.sum("arrivals").alias("arrivals"),
    ))
    beyond = sessions.where(F.col("max_idx") >= F.col("total")).select(*keys, "total")
    if beyond.isEmpty():
        found = sessions.withColumn("expected", F.col("received"))
    else:
        there = _arrival(chunks).select(*keys, "idx").join(beyond, keys).where(F.col("idx") < F.col("total"))
        inside = there.groupBy(*keys, "idx").agg(F.count(F.lit(1))).groupBy(*keys).agg(F.count(F.lit(1)).alias("inside"))
        expected = F.when(F.col("max_idx") < F.col("total"), F.col("received")).otherwise(F.coalesce("inside", F.lit(0)))
        found = sessions.join(inside, keys, "left").withColumn("expected", expected)
    total = F.col("total")
    complete = (F.col("received") == total) & (F.col("max_idx") == total - 1)
    return found.select(*keys, "received", "total", "arrivals", (total - F.col("expected")).alias("missing"), complete.alias("complete"))


def missing_ranges(events: DataFrame, key: str = "source", keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Runs of missing indexes per session, as (first_missing, last_missing).

    Ranges keep the answer small when a session announces far more chunks than it sends.
    """
    keys = session_keys(key)
    latest = latest_chunks(parse_chunks(events, keywords), key, of=None).withColumn(
        "block", F.floor(F.col("idx") / BLOCK_CHUNKS)
    )
    along = Window.partitionBy(*keys).orderBy("block")
    session = Window.partitionBy(*keys)
    blocks = latest.groupBy(*keys, "block").agg(F.min("first").alias("first"), F.sort_array(F.collect_list("idx")).alias("at"))
    last_idx = F.element_at("at", -1)
    blocks = blocks.select(
        *keys, "at", F.coalesce(F.lag(last_idx).over(along), F.lit(-1)).alias("before"),
        F.min("first").over(session)["total"].alias("total"), F.lead("block").over(along).isNull().alias("ends"),
    )
    # The indexes of a block between the last one before it and, where the session ends, its total.
    none = F.array().cast("array<bigint>")
    marks = F.concat(F.array("before"), "at", F.when(F.col("ends"), F.array("total")).otherwise(none))
    pairs = F.zip_with(F.col("marks"), F.slice("marks", F.lit(2), F.size("marks") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gaps = F.filter(pairs, lambda p: p["b"] - 1 > p["a"])
    holes = blocks.withColumn("marks", marks).select(*keys, "total", F.explode(gaps).alias("g")).select(
        *keys, (F.col("g.a") + 1).alias("first_missing"), F.least(F.col("g.b") - 1, F.col("total") - 1).alias("last_missing")
    )
    return holes.where(F.col("first_missing") <= F.col("last_missing")).withColumn(
        "n_missing", F.col("last_missing") - F.col("first_missing") + 1
    )


def transfer_stats(events: DataFrame, key: str = "source", keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """Per session: duration, chunks, encoded bytes, success rate and throughput, from the observed queries."""
    latest = latest_chunks(parse_chunks(events, keywords), key, of="length(chunk)")
    sessions = latest.groupBy(*session_keys(key)).agg(
        F.min("first").alias("first"), F.max("last.us").alias("last_us"), F.count(F.lit(1)).alias("chunks"),
        F.sum("arrivals").alias("arrivals"), F.sum("chunk").alias("bytes"),
    )
    duration = (F.col("last_us") - F.col("first.us")) / F.lit(1e6)
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return sessions.select(
        *session_keys(key), duration.alias("duration"), "chunks", "bytes",
        (F.col("arrivals") - F.col("chunks")).alias("repeats"),
        (rate(F.col("chunks"), F.col("first.total")) * 100).alias("success_rate"),
        rate(F.col("bytes"), duration).alias("throughput"),
    )
