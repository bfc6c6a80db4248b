"""The dictionary's sample reaches all records of an archive."""

from corpusloom.llm import warc


def test_a_very_large_record_leaves_room_for_the_others():
    records = [b"L" * (8 << 20)] + [bytes([65 + k]) * 80_000 for k in range(5)]
    sample = warc.sampled(records)
    assert {s[:1] for s in sample} == {b"L", b"A", b"B", b"C", b"D", b"E"} and sum(map(len, sample)) <= warc.SAMPLE_BYTES
    assert warc.sampled(records[1:2]) == records[1:2]
    assert [b for _, b in warc.read_archive(warc.archive([warc.record(1, "u", b"x" * 3_000_000)]))][1].endswith(b"x" * 3_000_000)
