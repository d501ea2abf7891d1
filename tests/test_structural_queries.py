"""Structural queries over all events and all transcripts."""

from varilume.plans import fixtures as X
from varilume.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_structural_events_and_transcripts(spark):
    tx = [r for r in X.transcripts(spark, SF).select("transcript_index", "coding", "seq_region", "transcript_start", "transcript_end").collect()]
    ev = X.structural_events(spark, SF).select("event_index", "seq_region", "position", "end_position").collect()
    coding = {t.transcript_index for t in tx if t.coding}
    rows = QUERIES["sv_consequence"](spark, SF).collect()
    got = {(r.event_index, r.transcript_index) for r in rows}
    # whatever overlaps has a row
    over = {(e.event_index, t.transcript_index) for e in ev for t in tx if e.seq_region == t.seq_region and t.transcript_start <= e.end_position and e.position < t.transcript_end}
    assert over <= got and any(k[1] in coding for k in over)
    near = {(r.event_index, r.transcript_index) for r in QUERIES["breakend_annotate"](spark, SF).collect()}
    assert {(r.event_index, r.transcript_index) for r in QUERIES["breakend_candidates"](spark, SF).collect()} == near
    assert {k[1] for k in near} & coding
