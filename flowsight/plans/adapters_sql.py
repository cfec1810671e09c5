"""The projections of adapters, as SQL common table expressions for the comparison engine."""

from __future__ import annotations

from flowsight.functions.signatures import SIGNATURES
from flowsight.schema import FEATURES

HALF_DAY_US = 12 * 3600 * 1_000_000
CENTURY_US = 100 * 365 * 86400 * 1_000_000

EVENT_PACKETS = """
pk AS (
  SELECT epoch_us(ts) AS us, event_id AS seq, event_type IN ('click', 'view') AS outb,
         '10.1.0.' || user_id AS cip, CAST(40000 + user_id AS INTEGER) AS cport,
         CAST([53, 443, 8080, 5353][user_id % 4 + 1] AS INTEGER) AS sport,
         '192.0.2.1' AS sip, CAST(40 + floor(value * 10) AS BIGINT) AS len
  FROM events
)"""

ORDER_PACKETS = """
pk AS (
  SELECT epoch_us(l_shipdate) AS us,
         (CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey) * 100000 + l_suppkey AS seq,
         l_returnflag = 'N' AS outb, 'order-' || l_orderkey AS cip,
         CAST(l_orderkey % 60000 + 1024 AS INTEGER) AS cport, CAST(443 AS INTEGER) AS sport,
         '192.0.2.1' AS sip, CAST(40 + 20 * l_quantity AS BIGINT) AS len
  FROM lineitem
)"""


def _mode(name: str, value: str) -> str:
    return f"""
{name} AS (
  SELECT cip, sid, age, {value} AS v FROM (
    SELECT cip, sid, age, {value}, count(*) AS c FROM fl WHERE {value} IS NOT NULL GROUP BY ALL
  ) QUALIFY row_number() OVER (PARTITION BY cip, sid, age ORDER BY c DESC, {value}) = 1
)"""


def _spread(prefix: str) -> str:
    var, std, mean, med, mod = (f"{prefix}_{x}" for x in ("var", "std", "mean", "median", "mode"))
    name = {"len": "PacketLength", "time": "PacketTime", "resp": "ResponseTimeTime"}[prefix]
    return f"""
    {var} AS {name}Variance, {std} AS {name}StandardDeviation, {mean} AS {name}Mean, {med} AS {name}Median,
    {mod} AS {name}Mode,
    CASE WHEN {std} = 0 THEN -10 ELSE 3 * ({mean} - {med}) / {std} + 0.0 END AS {name}SkewFromMedian,
    CASE WHEN {std} = 0 THEN -10 ELSE ({mean} - {mod}) / {std} + 0.0 END AS {name}SkewFromMode,
    CASE WHEN {mean} = 0 THEN -1 ELSE {std} / {mean} END AS {name}CoefficientofVariation"""


def flows(packets: str, gap_us: int, max_age_us: int | None = None) -> str:
    """CTEs ending in flow_table, with the flow record's columns plus flow_id, start_us and packets."""
    age = "CAST(0 AS BIGINT)" if max_age_us is None else f"(us - session_us) // {max_age_us}"
    return f"""{packets},
s1 AS (SELECT *, lag(us) OVER (PARTITION BY cip ORDER BY us, seq) AS pus FROM pk),
s2 AS (
  SELECT *, sum(CASE WHEN pus IS NULL OR us - pus > {gap_us} THEN 1 ELSE 0 END)
    OVER (PARTITION BY cip ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS sid FROM s1
),
s3 AS (SELECT *, min(us) OVER (PARTITION BY cip, sid) AS session_us FROM s2),
s4 AS (SELECT *, {age} AS age FROM s3),
s5 AS (
  SELECT *, min(us) OVER (PARTITION BY cip, sid, age) AS start_us,
    first_value(outb) OVER w AS src_out, lag(us) OVER w AS fus, lag(outb) OVER w AS fout
  FROM s4 WINDOW w AS (PARTITION BY cip, sid, age ORDER BY us, seq)
),
fl AS (
  SELECT *, us - start_us AS rel, CASE WHEN fout <> outb AND fout = src_out THEN us - fus END AS gap FROM s5
),
{_mode("m1", "len")},{_mode("m2", "rel")},{_mode("m3", "gap")},
g AS (
  SELECT cip, sid, age, any_value(cport) AS cport, any_value(sip) AS sip, any_value(sport) AS sport,
    any_value(src_out) AS src_out, min(us) AS start_us, (max(us) - min(us)) / 1e6 AS duration,
    count(*) AS packets,
    CAST(coalesce(sum(len) FILTER (WHERE outb = src_out), 0) AS BIGINT) AS sent,
    CAST(coalesce(sum(len) FILTER (WHERE outb <> src_out), 0) AS BIGINT) AS received,
    var_pop(len) AS len_var, stddev_pop(len) AS len_std, avg(len) AS len_mean,
    median(CAST(len AS DOUBLE)) AS len_median,
    var_pop(rel) / 1e12 AS time_var, stddev_pop(rel) / 1e6 AS time_std, avg(rel) / 1e6 AS time_mean,
    median(CAST(rel AS DOUBLE)) / 1e6 AS time_median,
    coalesce(var_pop(gap) / 1e12, -1) AS resp_var, coalesce(stddev_pop(gap) / 1e6, -1) AS resp_std,
    coalesce(avg(gap) / 1e6, -1) AS resp_mean, median(CAST(gap AS DOUBLE)) / 1e6 AS resp_median
  FROM fl GROUP BY cip, sid, age
),
h AS (
  SELECT g.*, CAST(m1.v AS DOUBLE) AS len_mode, m2.v / 1e6 AS time_mode, coalesce(m3.v / 1e6, -1) AS resp_mode
  FROM g JOIN m1 USING (cip, sid, age) JOIN m2 USING (cip, sid, age) LEFT JOIN m3 USING (cip, sid, age)
),
flow_table AS (
  SELECT
    CASE WHEN cip < sip OR (cip = sip AND cport <= sport)
      THEN cip || '|' || cport || '|' || sip || '|' || sport ELSE sip || '|' || sport || '|' || cip || '|' || cport
      END || '|' || start_us AS flow_id,
    CASE WHEN src_out THEN cip ELSE sip END AS SourceIP, CASE WHEN src_out THEN sip ELSE cip END AS DestinationIP,
    CASE WHEN src_out THEN cport ELSE sport END AS SourcePort,
    CASE WHEN src_out THEN sport ELSE cport END AS DestinationPort,
    date_trunc('second', make_timestamp(start_us)) AS TimeStamp,
    duration AS Duration, sent AS FlowBytesSent, received AS FlowBytesReceived,
    CASE WHEN duration = 0 THEN -1 ELSE sent / duration END AS FlowSentRate,
    CASE WHEN duration = 0 THEN -1 ELSE received / duration END AS FlowReceivedRate,
    {_spread("len")}, {_spread("time")}, {_spread("resp")},
    start_us, packets, cip
  FROM h
)"""


EVENT_FLOWS = flows(EVENT_PACKETS, HALF_DAY_US)
ORDER_FLOWS = flows(ORDER_PACKETS, CENTURY_US) + """,
labelled AS (
  SELECT CAST(split_part(cip, '-', 2) AS BIGINT) AS order_id,
    CASE WHEN o_orderstatus = 'F' THEN 'Malicious' ELSE 'Benign' END AS Label, flow_table.* EXCLUDE (flow_id)
  FROM flow_table JOIN orders ON o_orderkey = CAST(split_part(cip, '-', 2) AS BIGINT)
)"""


def chunk_names(encoded: str, name: str = "dns") -> str:
    return f"""
enc_{name} AS (SELECT doc_id, lang, regexp_extract_all({encoded}, '.{{1,30}}') AS chunks FROM documents),
all_{name} AS (
  SELECT doc_id, lang, len(chunks) AS total, unnest(range(0, len(chunks))) AS idx, unnest(chunks) AS chunk
  FROM enc_{name} WHERE len(chunks) > 0
),
{name} AS (
  SELECT CAST(1700000000000000 + doc_id * 60000000 + idx * 250000 AS BIGINT) AS us,
    '10.2.0.' || lang AS src_ip, printf('%d-%04d-%04d-%s.exfill.local', doc_id, idx, total, chunk) AS qname,
    CAST(idx AS BIGINT) AS seq, idx, total, lang, doc_id
  FROM all_{name}
)"""


BASE64URL = "translate(replace(to_base64(encode(text)), '=', ''), '+/', '-_')"
DOCUMENT_QUERIES = chunk_names(BASE64URL)
ENCODED_QUERIES = chunk_names(f"CASE WHEN lang = 'en' THEN lower(hex(encode(text))) ELSE {BASE64URL} END")
DAMAGED_QUERIES = chunk_names(BASE64URL, "whole") + """,
dns AS (
  SELECT us, src_ip, qname, seq FROM whole WHERE NOT (lang = 'de' AND idx = 1)
  UNION ALL
  SELECT us - 1000, src_ip, printf('%d-0000-%04d-WRONG.exfill.local', doc_id, total), seq
  FROM whole WHERE lang = 'fr' AND idx = 0
)"""
SLOW_QUERIES = chunk_names(BASE64URL, "whole") + """,
slow AS (
  SELECT CASE doc_id % 5 WHEN 1 THEN us + idx // 20 * 40000000 WHEN 2 THEN us + idx * 6750000 ELSE us - idx * 249000 END AS us,
    src_ip, qname, seq FROM whole
)"""
# A transfer holds for 300 seconds: 43 chunks that come every 7 seconds, the next one is too late.
SLOW_AGE_US = 43 * 7_000_000
PAGE_QUERIES = """
pages_dns AS (
  SELECT CAST(1700000000000000 + page_id * 1000000 AS BIGINT) AS us, '10.3.0.1' AS src_ip,
    regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS qname, page_id AS seq FROM pages
)"""
ALL_QUERIES = DOCUMENT_QUERIES + "," + PAGE_QUERIES + """,
queries AS (SELECT us, src_ip, qname, seq FROM dns UNION ALL SELECT us, src_ip, qname, seq FROM pages_dns)"""


def chunks(source: str) -> str:
    """CTE chunk_rows: suspicious names of the source with their label parsed."""
    return f"""
chunk_rows AS (
  SELECT src_ip, us, seq, regexp_extract(qname, p, 1) AS session_id,
    CAST(regexp_extract(qname, p, 2) AS BIGINT) AS idx, CAST(regexp_extract(qname, p, 3) AS BIGINT) AS total,
    regexp_extract(qname, p, 4) AS chunk
  FROM (SELECT *, '^([0-9]+)-([0-9]+)-([0-9]+)-([^.]+)[.]' AS p FROM {source})
  WHERE regexp_matches(lower(qname), 'exfill|data|leak')
    AND regexp_matches(qname, '^([0-9]+)-([0-9]+)-([0-9]+)-([^.]+)[.]')
)"""


SESSIONS = """
latest AS (
  SELECT src_ip, session_id, idx, arg_max(chunk, row(us, seq)) AS chunk, max(us) AS last_us, count(*) AS arrivals
  FROM chunk_rows GROUP BY ALL
),
firsts AS (
  SELECT src_ip, session_id, arg_min(total, row(us, seq)) AS total, min(us) AS first_us
  FROM chunk_rows GROUP BY ALL
),
sess AS (
  SELECT src_ip, session_id, total, first_us, count(*) AS received, max(idx) AS max_idx,
    count(*) FILTER (WHERE idx < total) AS expected_received, CAST(sum(arrivals) AS BIGINT) AS arrivals,
    max(last_us) AS last_us, CAST(sum(length(chunk)) AS BIGINT) AS bytes,
    string_agg(chunk, '' ORDER BY idx) AS txt
  FROM latest JOIN firsts USING (src_ip, session_id) GROUP BY ALL
)"""

#: CTEs after chunk_rows, in a WITH RECURSIVE: transfers, one row per whole transfer that is no copy of the one before it.
TRANSFERS = """
followed AS (
  SELECT *, lag(row(idx, total, chunk)) OVER (PARTITION BY src_ip, session_id ORDER BY us, seq, idx, total, chunk) AS repeated FROM chunk_rows
),
placed AS (
  SELECT src_ip, session_id, us, seq, idx, total, chunk,
    row_number() OVER (PARTITION BY src_ip, session_id ORDER BY us, seq, idx, total, chunk) AS place
  FROM followed WHERE repeated IS DISTINCT FROM row(idx, total, chunk)
),
opened AS (
  SELECT DISTINCT src_ip, session_id, 0 AS transfer, CAST(1 AS BIGINT) AS begins FROM placed
  UNION ALL
  SELECT src_ip, session_id, transfer + 1, max(seen) FILTER (WHERE idx < want) + 1
  FROM (
    SELECT o.src_ip, o.session_id, o.transfer, f.total AS want, p.idx, min(p.place) AS seen
    FROM opened o JOIN placed f ON f.src_ip = o.src_ip AND f.session_id = o.session_id AND f.place = o.begins
    JOIN placed p ON p.src_ip = o.src_ip AND p.session_id = o.session_id AND p.place >= o.begins GROUP BY ALL
  )
  GROUP BY src_ip, session_id, transfer, want
  HAVING count(*) FILTER (WHERE idx < want) = want
    AND max(seen) FILTER (WHERE idx < want) < coalesce(min(seen) FILTER (WHERE idx >= want), 1000000000000)
),
owned AS (
  SELECT p.*, o.transfer FROM placed p ASOF JOIN opened o
    ON p.src_ip = o.src_ip AND p.session_id = o.session_id AND p.place >= o.begins
),
newest AS (
  SELECT src_ip, session_id, transfer, idx, arg_max(chunk, place) AS chunk, min(us) AS first_us,
    min(row(place, total)) AS opener FROM owned GROUP BY ALL
),
every AS (
  SELECT src_ip, session_id, transfer, count(*) AS n, max(idx) AS max_idx, min(opener)[2] AS total, min(first_us) AS first_us,
    list(chunk ORDER BY idx) AS parts FROM newest GROUP BY ALL
),
transfers AS (
  SELECT * FROM every e WHERE n = total AND max_idx = total - 1 AND NOT EXISTS (
    SELECT 1 FROM every b WHERE b.src_ip = e.src_ip AND b.session_id = e.session_id AND b.transfer = e.transfer - 1 AND b.parts = e.parts
  )
)"""

PAGE_REQUESTS = """
http AS (
  SELECT host, '/dns-query?type=A&page=' || page || '&name=' || CASE WHEN page <> '' THEN host ELSE '' END AS path,
    us, '10.3.0.1' AS src_ip
  FROM (
    SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '[?]page=([0-9]+)', 1) AS page,
      CAST(1700000000000000 + page_id * 1000000 AS BIGINT) AS us FROM pages
  )
)"""

SCORES = """
scores AS (
  SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 3) + 0.0 AS p, label % 2 AS label FROM embeddings
)"""

MODELS = """
wide AS (
  SELECT vec_id AS flow_id, label % 2 AS label, 1 / (1 + exp(-CAST(embedding[2] AS DOUBLE))) AS random_forest,
    1 / (1 + exp(-CAST(embedding[3] AS DOUBLE))) AS logistic_regression,
    1 / (1 + exp(-CAST(embedding[4] AS DOUBLE))) AS rules FROM embeddings
),
preds AS (
  SELECT flow_id, label, 'random_forest' AS model, random_forest AS p FROM wide
  UNION ALL SELECT flow_id, label, 'logistic_regression', logistic_regression FROM wide
  UNION ALL SELECT flow_id, label, 'rules', rules FROM wide
),
thr AS (SELECT * FROM (VALUES ('random_forest', 0.52), ('logistic_regression', 0.48)) t(model, limit_value)),
decided AS (
  SELECT flow_id, label, preds.model, p, CAST(coalesce(limit_value, 0.5) AS DOUBLE) AS threshold,
    CASE WHEN p >= coalesce(limit_value, 0.5) THEN 1 ELSE 0 END AS pred, greatest(p, 1 - p) AS confidence
  FROM preds LEFT JOIN thr USING (model)
)"""

LABELS = """
verdicts AS (
  SELECT doc_id, quality AS label, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS pred
  FROM labels JOIN documents USING (doc_id)
)"""

ROC = """
sc AS (
  SELECT p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
  FROM scores GROUP BY p
),
cum AS (
  SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp,
    lead(pos) OVER (ORDER BY p DESC) AS npos, lead(neg) OVER (ORDER BY p DESC) AS nneg,
    row_number() OVER (ORDER BY p DESC) AS place, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM sc
),
roc AS (
  SELECT 'Infinity'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 0 AS fp, 0 AS tp
  UNION ALL
  SELECT p, fp / nn, tp / np, fp, tp FROM cum
  WHERE place = 1 OR npos IS NULL OR NOT (npos = pos AND nneg = neg)
)"""

LOGS = """
turns AS (
  SELECT conv_id, turn, role, length(text) AS n,
    ['RANDOM_FOREST', 'Logistic_Regression', 'rules'][length(text) % 3 + 1] AS model FROM conversations
),
ev AS (
  SELECT conv_id, turn * 2 AS line_no, 'header' AS kind, lower(model) AS model, NULL AS cnt FROM turns WHERE role = 'user'
  UNION ALL SELECT conv_id, turn * 2, 'benign', NULL, n FROM turns WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn * 2 + 1, 'malicious', NULL, turn FROM turns WHERE role = 'assistant'
),
carried AS (
  SELECT *, last_value(model IGNORE NULLS) OVER w AS current,
    lag(kind) OVER (PARTITION BY conv_id ORDER BY line_no) AS before_kind,
    lag(cnt) OVER (PARTITION BY conv_id ORDER BY line_no) AS before_cnt
  FROM ev WINDOW w AS (PARTITION BY conv_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
log_verdicts AS (
  SELECT 'run/' || conv_id AS path, 'run' AS run, CAST(conv_id AS VARCHAR) AS scenario, current AS model,
    CAST(before_cnt AS BIGINT) AS benign, CAST(cnt AS BIGINT) AS malicious
  FROM carried WHERE kind = 'malicious' AND current IS NOT NULL AND before_kind = 'benign'
)"""

SCENARIO_SUMS = """
sums AS (
  SELECT n_name AS scenario, ['consensus', 'random_forest', 'svm', 'rules'][s_suppkey % 4 + 1] AS model,
    count(*) FILTER (WHERE s_acctbal < 5000) AS benign, count(*) FILTER (WHERE s_acctbal >= 5000) AS malicious
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
),
chosen AS (
  SELECT scenario, model, benign, malicious, benign + malicious AS total,
    malicious / (benign + malicious) AS rate
  FROM sums QUALIFY row_number() OVER (
    PARTITION BY scenario ORDER BY CASE model WHEN 'consensus' THEN 0 WHEN 'random_forest' THEN 1 WHEN 'svm' THEN 4
      ELSE 6 END, model) = 1
)"""

SCENARIO_SETTINGS = """
conf AS (
  SELECT s_name, CASE WHEN s_acctbal > 0 THEN 'https://resolver.example/dns-query' END AS doh_server,
    'exfill.local' AS target_domain, CASE WHEN s_acctbal < 8000 THEN CAST(s_suppkey % 50 + 8 AS INTEGER) END AS chunk_size,
    CASE WHEN s_acctbal < 1000 THEN 'base91' WHEN s_acctbal < 4000 THEN 'hex' END AS encoding,
    CASE WHEN s_acctbal > 9000 THEN 'never' END AS timing_pattern,
    CASE WHEN s_acctbal > 5000 THEN 0.5 END AS base_delay
  FROM supplier
)"""


def file_type_case(hex_text: str) -> str:
    arms = " ".join(f"WHEN starts_with({hex_text}, '{prefix}') THEN '{kind}'" for prefix, kind, _ in SIGNATURES)
    return f"CASE WHEN length({hex_text}) = 0 THEN 'empty' {arms} ELSE 'Binary Data' END"


def base64_payload(text: str) -> str:
    return (
        f"from_base64(rpad(translate({text}, '-_', '+/'), "
        f"CAST(((length({text}) + 3) // 4) * 4 AS INTEGER), '='))"
    )


def feature_list(expression: str) -> str:
    return ", ".join(f"{expression.format(c=c)} AS {c}" for c in FEATURES)
