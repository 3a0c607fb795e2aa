import numpy as np
import pyarrow as pa

from tessera.llm import arrow


def test_other_operators_caches_go():
    own, other = [1], [2]
    arrow.keep("own", own.clear)
    arrow.keep("other", other.clear)
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert list(arrow.tidied("own", lambda batches: batches)(iter([batch, batch]))) == [batch, batch]
    assert own == [1] and other == []
    arrow.enter("third")
    assert own == [] and not arrow._kept


def test_chunks_cover_all_values_once():
    offsets = np.concatenate([[0], np.cumsum([0, 5, 0, 100, 3, 3, 3, 0])])
    parts = list(arrow.chunks(offsets, 6, 2))
    assert [i for a, z in parts for i in range(a, z)] == list(range(8))
    assert all(z - a <= 2 and (z - a == 1 or offsets[z] - offsets[a] <= 6) for a, z in parts)
    data, at = arrow.flat(pa.array(["é", None, "", "ab"]))
    assert bytes(data) == "éab".encode() and at.tolist() == [0, 2, 2, 2, 4]
    data, at = arrow.flat(pa.chunked_array([["x"], ["yz"]]).slice(1))
    assert bytes(data) == b"yz" and at.tolist() == [0, 2]
