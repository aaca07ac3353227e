"""Python tasks of the pipeline give their memory back when they end."""

import pyarrow as pa

from ledgerspark.llm import secrets, simhash


def test_tasks_release_memory(monkeypatch):
    ended = []
    for module in (simhash, secrets):
        monkeypatch.setattr(module, "release", lambda name=module.__name__: ended.append(name))
    docs = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five"], "_key": [7]})
    assert sum(b.num_rows for b in simhash._fingerprints([docs])) == 1
    spans = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["abc secret"], "_spans": pa.array(["hex:4:10"])})
    assert [t.as_py() for b in secrets._redact([spans]) for t in b.column(1)] == ["abc [hex]"]
    assert ended == ["ledgerspark.llm.simhash", "ledgerspark.llm.secrets"]
