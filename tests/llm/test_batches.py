import pyarrow as pa

from pagetrail.llm import batches as B


def test_portions(monkeypatch):
    monkeypatch.setattr(B, "MOST", 10)
    texts = ["abc", None, "", "x" * 30, "de", "fghij", "k" * 6]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["i", "t"])
    got = [p.column("t").to_pylist() for p in B.portions(iter([batch, batch.slice(0, 0)]), "t")]
    assert [t for p in got for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 10 for p in got)
