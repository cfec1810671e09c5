"""A few named queries against their SQL on the smallest tables; check_oracle.py runs them all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "rule_score_summary", "reassemble_sha", "roc_points", "log_verdicts", "stratified_split", "label_entropy",
    "payload_identity_long", "reassemble_repeated_sessions", "payload_alphabet", "timing_class_known", "threshold_at_fpr",
    "flows_csv_mixed_headers", "flows_csv_unlabelled_skipped", "payload_files", "stream_counters", "stream_repeated_sessions",
    "stream_damaged_sessions", "stream_expired_partials", "stream_meter", "nearest_vectors", "packet_files", "log_files", "threshold_files",
    "rule_file", "scoring_file", "payload_export", "scenario_defaults",
]
# Sessions of one chunk occur at this scale only.
SESSIONS, SESSION_FOLDER = ["reassemble_last_write_wins", "reassemble_by_session_id", "session_progress"], "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,folder", [(n, FOLDER) for n in NAMES] + [(n, SESSION_FOLDER) for n in SESSIONS])
def test_equals_sql(spark, name, folder):
    good, note = compare(spark, connect(folder), folder, name)
    assert good, note


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
